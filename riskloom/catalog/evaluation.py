"""Queries over scored rows and attribution tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog.registry import query, r6, rounded, s6
from riskloom.functions import scalars as S
from riskloom.operators import metrics as M
from riskloom.sources.fixtures import view

LABEL, SCORE = "true_label", "fraud_probability"
VIEWS = ["scored"]

CURVE = """pts as (select fraud_probability as score, sum(true_label) as pos, sum(1 - true_label) as neg
    from scored group by 1),
  c as (select *, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp,
    sum(pos) over () as p, sum(neg) over () as n from pts)"""
ROC = "sum(pos * (n - fp + neg / 2.0)) / nullif(max(p) * max(n), 0)"
PR = """sum(pos / nullif(p, 0) * (tp / (tp + fp)
    + coalesce((tp - pos) / nullif(tp - pos + fp - neg, 0), 1)) / 2.0)"""


def scored(spark, sf):
    return view(spark, sf, "scored")


def decided(spark, sf):
    return scored(spark, sf).withColumn("pred", S.decide(F.col(SCORE)))


@query("roc_auc", VIEWS, f"with {CURVE} select {s6(ROC, 'roc_auc')} from c")
def roc_auc(spark, sf):
    return rounded(M.roc_auc(scored(spark, sf), LABEL, SCORE), ["roc_auc"])


@query("pr_auc", VIEWS, f"with {CURVE} select {s6(PR, 'pr_auc')} from c")
def pr_auc(spark, sf):
    return rounded(M.pr_auc(scored(spark, sf), LABEL, SCORE), ["pr_auc"])


@query(
    "roc_curve",
    VIEWS,
    f"""with {CURVE} select score as threshold, {s6('fp / n', 'fpr')}, {s6('tp / p', 'tpr')} from c
        union all select null, 0.0::double, 0.0::double""",
)
def roc_curve(spark, sf):
    return rounded(M.roc_curve(scored(spark, sf), LABEL, SCORE), ["fpr", "tpr"])


@query(
    "pr_curve",
    VIEWS,
    f"""with {CURVE} select score as threshold, {s6('tp / (tp + fp)', 'precision')}, {s6('tp / p', 'recall')} from c
        union all select null, 1.0::double, 0.0::double""",
)
def pr_curve(spark, sf):
    return rounded(M.pr_curve(scored(spark, sf), LABEL, SCORE), ["precision", "recall"])


DECIDED = "d as (select *, cast(fraud_probability >= 0.5 as int) as pred from scored)"
RATES = ", ".join(
    [
        s6("avg(case when true_label = pred then 1 else 0 end)", "accuracy"),
        s6("coalesce(sum(true_label * pred) / nullif(sum(pred), 0), 0)", "precision"),
        s6("coalesce(sum(true_label * pred) / nullif(sum(true_label), 0), 0)", "recall"),
        s6("coalesce(2.0 * sum(true_label * pred) / nullif(sum(true_label) + sum(pred), 0), 0)", "f1_score"),
    ]
)
RATE_NAMES = ["accuracy", "precision", "recall", "f1_score"]


@query("threshold_metrics", VIEWS, f"with {DECIDED} select {RATES} from d")
def threshold_metrics(spark, sf):
    return rounded(M.threshold_metrics(decided(spark, sf), LABEL, "pred"), RATE_NAMES)


@query(
    "confusion_matrix",
    VIEWS,
    f"""with {DECIDED}, grid as (select * from (values (0, 0), (0, 1), (1, 0), (1, 1)) t(t, p))
        select t as true_label, p as predicted_label, count(d.pred) as n
        from grid left join d on t = true_label and p = pred group by 1, 2""",
)
def confusion_matrix(spark, sf):
    return M.confusion_matrix(decided(spark, sf), LABEL, "pred")


@query(
    "classification_report",
    VIEWS,
    f"""with {DECIDED}, k as (select unnest([0, 1]) as cls),
        per as (select cls, sum(case when pred = cls and true_label = cls then 1 else 0 end) as hit,
            sum(case when pred = cls then 1 else 0 end) as called,
            sum(case when true_label = cls then 1 else 0 end) as support from d cross join k group by cls),
        r as (select cls, support, coalesce(hit / nullif(called, 0), 0) as p, coalesce(hit / nullif(support, 0), 0) as r,
            coalesce(2.0 * hit / nullif(called + support, 0), 0) as f, hit from per)
        select cast(cls as varchar) as class, {s6('p', 'precision')}, {s6('r', 'recall')}, {s6('f', 'f1_score')},
            cast(support as bigint) as support from r
        union all select 'accuracy', {s6('sum(hit) / sum(support)', 'a')}, {s6('sum(hit) / sum(support)', 'b')},
            {s6('sum(hit) / sum(support)', 'c')}, cast(sum(support) as bigint) from r
        union all select 'macro avg', {s6('avg(p)', 'a')}, {s6('avg(r)', 'b')}, {s6('avg(f)', 'c')},
            cast(sum(support) as bigint) from r
        union all select 'weighted avg', {s6('sum(p * support) / sum(support)', 'a')},
            {s6('sum(r * support) / sum(support)', 'b')}, {s6('sum(f * support) / sum(support)', 'c')},
            cast(sum(support) as bigint) from r""",
)
def classification_report(spark, sf):
    return rounded(
        M.classification_report(decided(spark, sf), LABEL, "pred"), ["precision", "recall", "f1_score"]
    )


@query(
    "model_comparison",
    VIEWS,
    f"""with long as (
          select 'a' as model, true_label, fraud_probability as s from scored
          union all select 'b', true_label, 1 - fraud_probability from scored
          union all select 'vote', true_label, fraud_probability * 0.25 + (1 - fraud_probability) * 0.75 from scored),
        d as (select *, cast(s >= 0.5 as int) as pred from long),
        pts as (select model, round(s, 9) as score, sum(true_label) as pos, sum(1 - true_label) as neg from long group by 1, 2),
        c as (select *, sum(pos) over (partition by model order by score desc) as tp,
          sum(neg) over (partition by model order by score desc) as fp,
          sum(pos) over (partition by model) as p, sum(neg) over (partition by model) as n from pts),
        areas as (select model, {s6(ROC, 'roc_auc')}, {s6(PR, 'pr_auc')} from c group by model),
        rates as (select model, {RATES} from d group by model)
        select * from areas join rates using (model)""",
)
def model_comparison(spark, sf):
    p = F.col(SCORE)
    df = scored(spark, sf).select(
        LABEL, F.round(p, 9).alias("a"), F.round(1 - p, 9).alias("b"),
        F.round(S.soft_vote([p, 1 - p], [0.25, 0.75]), 9).alias("vote"),
    )
    out = M.model_comparison(df, LABEL, {m: m for m in ("a", "b", "vote")})
    return rounded(out, ["roc_auc", "pr_auc", *RATE_NAMES])


@query(
    "evaluate",
    VIEWS,
    f"""with {CURVE}, {DECIDED} select (select {s6(ROC, 'x')} from c) as roc_auc,
        (select {s6(PR, 'x')} from c) as pr_auc, {RATES} from d""",
)
def evaluate(spark, sf):
    return rounded(M.evaluate(decided(spark, sf), LABEL, "pred", SCORE), ["roc_auc", "pr_auc", *RATE_NAMES])


@query(
    "score_histogram",
    VIEWS,
    f"""with r as (select true_label as label, min(fraud_probability) as lo, max(fraud_probability) as hi,
          count(*) as total from scored group by 1),
        b as (select true_label as label, cast(least(floor((fraud_probability - lo) / (hi - lo) * 50), 49) as int) as bin,
          count(*) as n from scored join r on true_label = label group by 1, 2),
        g as (select *, unnest(range(50)) as bin from r)
        select g.label, cast(g.bin as int) as bin, {s6('lo + g.bin * ((hi - lo) / 50.0)', 'bin_start')},
          coalesce(n, 0) as n, {s6('coalesce(n, 0) / (total * ((hi - lo) / 50.0))', 'density')}
        from g left join b on g.label = b.label and g.bin = b.bin""",
)
def score_histogram(spark, sf):
    return rounded(M.score_histogram(scored(spark, sf), LABEL, SCORE), ["bin_start", "density"])


@query(
    "cv_mean",
    VIEWS,
    f"""with long as (select 'a' as model, TransactionID % 5 as fold, true_label, fraud_probability as s from scored),
        pts as (select model, fold, s as score, sum(true_label) as pos, sum(1 - true_label) as neg from long group by 1, 2, 3),
        c as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by model, fold) as p,
          sum(neg) over (partition by model, fold) as n from pts window w as (partition by model, fold order by score desc)),
        f as (select model, fold, {ROC} as auc from c group by model, fold)
        select model, {s6('avg(auc)', 'mean_auc')}, count(auc) as n_folds from f group by model""",
)
def cv_mean(spark, sf):
    long = scored(spark, sf).select(
        F.lit("a").alias("model"), (F.col("TransactionID") % 5).alias("fold"), F.col(LABEL).alias("label"), F.col(SCORE).alias("p")
    )
    return rounded(M.mean_over_folds(long), ["mean_auc"])


@query(
    "soft_vote",
    VIEWS,
    f"""select TransactionID, {s6('fraud_probability * 0.25 + (1 - fraud_probability) * 0.75', 'serving')},
        {s6('fraud_probability * 0.5 + (1 - fraud_probability) * 0.5', 'training')} from scored""",
)
def soft_vote(spark, sf):
    p = F.col(SCORE)
    return scored(spark, sf).select(
        "TransactionID",
        r6(S.soft_vote([p, 1 - p], [0.25, 0.75]), "serving"),
        r6(S.soft_vote([p, 1 - p], [0.5, 0.5]), "training"),
    )


@query(
    "decide_label",
    VIEWS,
    """select TransactionID, cast(fraud_probability >= 0.5 as int) as at_least,
       cast(fraud_probability > 0.5 as int) as above from scored""",
)
def decide_label(spark, sf):
    return scored(spark, sf).select(
        "TransactionID",
        S.decide(F.col(SCORE)).alias("at_least"),
        S.decide(F.col(SCORE), strict=True).alias("above"),
    )


BAND = "case when fraud_probability > 0.7 then 'High' when fraud_probability > 0.3 then 'Medium' else 'Low' end"


@query("risk_band", VIEWS, f"select TransactionID, {BAND} as risk_level from scored")
def risk_band(spark, sf):
    return scored(spark, sf).select("TransactionID", S.risk_band(F.col(SCORE)).alias("risk_level"))


@query(
    "risk_distribution",
    VIEWS,
    f"""select coalesce(risk_level, 'total') as risk_level, count(*) as n
        from (select {BAND} as risk_level from scored) group by rollup (risk_level)""",
)
def risk_distribution(spark, sf):
    return M.risk_distribution(scored(spark, sf).withColumn("risk_level", S.risk_band(F.col(SCORE))))


@query(
    "first_100",
    VIEWS,
    f"select TransactionID, {s6('fraud_probability', 'fraud_probability')} from scored order by TransactionID limit 100",
)
def first_100(spark, sf):
    return scored(spark, sf).orderBy("TransactionID").limit(100).select("TransactionID", r6(SCORE))


@query(
    "percent_text",
    VIEWS,
    "select TransactionID, printf('%.2f%%', fraud_probability * 100) as percent from scored",
)
def percent_text(spark, sf):
    return scored(spark, sf).select("TransactionID", S.percent_text(F.col(SCORE)).alias("percent"))


@query(
    "submission",
    VIEWS,
    f"select TransactionID, {s6('fraud_probability', 'isFraud')} from scored",
)
def submission(spark, sf):
    from riskloom.sources.sinks import submission_rows

    return rounded(submission_rows(scored(spark, sf)), ["isFraud"])


@query(
    "union_folds",
    VIEWS,
    "select TransactionID, true_label, cast(TransactionID % 5 as int) as fold from scored",
)
def union_folds(spark, sf):
    from riskloom.plans.stack import union_all

    df = scored(spark, sf).select("TransactionID", LABEL, (F.col("TransactionID") % 5).cast("int").alias("fold"))
    return union_all([df.where(F.col("fold") == i) for i in range(5)])


ATTRIB = ["attrib_long"]
IMPORTANCE = "select feature, avg(abs(shap_value)) as importance from attrib_long group by feature"


@query(
    "importance_rank",
    ATTRIB,
    f"""select feature, {s6('importance', 'importance')},
        cast(row_number() over (order by importance desc, feature) as int) as rank from ({IMPORTANCE})""",
)
def importance_rank(spark, sf):
    return rounded(M.importance_rank(view(spark, sf, "attrib_long")), ["importance"])


@query(
    "importance_top10",
    ATTRIB,
    f"""select * from (select feature, {s6('importance', 'importance')},
        cast(row_number() over (order by importance desc, feature) as int) as rank from ({IMPORTANCE})) where rank <= 10""",
)
def importance_top10(spark, sf):
    return rounded(M.importance_rank(view(spark, sf, "attrib_long"), top=10), ["importance"])


@query(
    "direction_top5",
    ATTRIB,
    f"""with m as (select feature, avg(shap_value) as v from attrib_long group by feature),
        d as (select feature, v, case when v > 0 then 'towards' else 'away' end as direction from m where v <> 0)
        select feature, direction, {s6('v', 'mean_value')}, rank from (select *,
          cast(row_number() over (partition by direction order by abs(v) desc, feature) as int) as rank from d)
        where rank <= 5""",
)
def direction_top5(spark, sf):
    return rounded(M.direction_top(view(spark, sf, "attrib_long")), ["mean_value"])


@query(
    "attribution_summary",
    ATTRIB,
    f"""select feature, {s6('avg(abs(shap_value))', 'mean_abs')}, {s6('avg(shap_value)', 'mean_signed')}
        from attrib_long group by feature""",
)
def attribution_summary(spark, sf):
    return rounded(M.attribution_summary(view(spark, sf, "attrib_long")), ["mean_abs", "mean_signed"])
