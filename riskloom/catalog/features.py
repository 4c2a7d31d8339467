"""Queries for scalar features, group ratios, encoders and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog.cleaning import joined
from riskloom.catalog.registry import query, r6, rounded, s6
from riskloom.functions import scalars as S
from riskloom.operators import clean, encode, sampling
from riskloom.operators.group_stats import GroupStats, group_mean_std
from riskloom.sources.fixtures import view

FILLED = """filled as (
  select TransactionID, TransactionDT, TransactionAmt, coalesce(card1, -1) as card1,
    coalesce(card4, 'missing') as card4, coalesce(addr1, -1) as addr1, coalesce(addr2, -1) as addr2,
    coalesce(D15, -1) as D15, coalesce(P_emaildomain, 'missing') as P_emaildomain, isFraud,
    coalesce(id_02, -1) as id_02, coalesce(id_12, 'missing') as id_12
  from txn left join identity using (TransactionID))"""
BOTH = ["txn", "identity"]


def filled(spark, sf):
    return clean.fill_constant(joined(spark, sf))


def ratio_sql(value: str, keys: list[str], kinds: list[str], fill: str) -> str:
    fn = {"mean": "avg", "std": "stddev_samp"}
    columns = ", ".join(
        s6(
            f"coalesce({value} / nullif({fn[k]}({value}) over (partition by {key}), 0), {fill})",
            f"{value}_to_{k}_{key}",
        )
        for k in kinds
        for key in keys
    )
    return f"with {FILLED} select TransactionID, {columns} from filled"


def ratios(spark, sf, specs, kinds):
    df = filled(spark, sf)
    out = GroupStats.fit(df, specs).transform(df, kinds)
    new = [c for c in out.columns if c not in df.columns]
    return out.select("TransactionID", *[r6(c) for c in new])


HOUR = "(TransactionDT / 3600.0) % 24"


@query(
    "txn_ratio_to_mean",
    BOTH,
    f"""with {FILLED}, f as (select *, {HOUR} as h, avg(TransactionAmt) over (partition by card1) as m,
          stddev_samp(TransactionAmt) over (partition by card1) as s from filled)
        select TransactionID, {s6('h', 'hour')}, cast(h >= 22 or h <= 6 as int) as is_night,
          {s6('TransactionAmt / nullif(m, 0)', 'TransactionAmt_to_mean_card1')},
          {s6('TransactionAmt / nullif(s, 0)', 'TransactionAmt_to_std_card1')},
          {s6('(TransactionAmt - m) / case when s = 0 then 1 else s end', 'card1_amt_z')} from f""",
)
def txn_ratio_to_mean(spark, sf):
    df = filled(spark, sf)
    stats = GroupStats.fit(df, {"TransactionAmt": ("card1",)})
    out = stats.transform(df, zscores={"card1_amt_z": ("TransactionAmt", "card1")})
    hour = S.hour_of_day(F.col("TransactionDT"))
    return out.select(
        "TransactionID",
        r6(hour, "hour"),
        S.is_night(hour).alias("is_night"),
        r6("TransactionAmt_to_mean_card1"),
        r6("TransactionAmt_to_std_card1"),
        r6("card1_amt_z"),
    )


@query(
    "time_features",
    ["txn"],
    f"""select TransactionID, {s6('h', 'hour')}, {s6('d', 'day')}, cast(h >= 22 or h <= 6 as int) as is_night,
          cast((h between 7 and 9) or (h between 17 and 19) as int) as is_rush_hour
        from (select TransactionID, {HOUR} as h, (TransactionDT / 86400.0) % 7 as d from txn)""",
)
def time_features(spark, sf):
    hour, day = S.hour_of_day(F.col("TransactionDT")), S.day_of_week(F.col("TransactionDT"))
    return view(spark, sf, "txn").select(
        "TransactionID",
        r6(hour, "hour"),
        r6(day, "day"),
        S.is_night(hour).alias("is_night"),
        S.is_rush_hour(hour).alias("is_rush_hour"),
    )


@query(
    "amount_features",
    ["txn"],
    f"""select TransactionID, {s6('ln(1 + TransactionAmt)', 'TransactionAmt_log')},
          {s6('TransactionAmt % 1', 'TransactionAmt_decimal')},
          cast(TransactionAmt % 1 = 0 as int) as TransactionAmt_round from txn""",
)
def amount_features(spark, sf):
    amount = F.col("TransactionAmt")
    return view(spark, sf, "txn").select(
        "TransactionID",
        r6(S.log_amount(amount), "TransactionAmt_log"),
        r6(S.fraction_of(amount), "TransactionAmt_decimal"),
        S.is_round(amount).alias("TransactionAmt_round"),
    )


@query(
    "group_mean_std",
    ["txn"],
    f"""select card1, count(*) as n, {s6('avg(TransactionAmt)', 'mean')}, {s6('stddev_samp(TransactionAmt)', 'std')}
        from txn group by card1""",
)
def group_stats_table(spark, sf):
    return rounded(group_mean_std(view(spark, sf, "txn"), "card1", "TransactionAmt"), ["mean", "std"])


AMOUNT = {"TransactionAmt": ("card1", "card4")}


@query("ratio_to_mean", BOTH, ratio_sql("TransactionAmt", ["card1", "card4"], ["mean"], "null"))
def ratio_to_mean(spark, sf):
    return ratios(spark, sf, AMOUNT, ("mean",))


@query("ratio_to_std", BOTH, ratio_sql("TransactionAmt", ["card1", "card4"], ["std"], "null"))
def ratio_to_std(spark, sf):
    return ratios(spark, sf, AMOUNT, ("std",))


@query("ratio_id02", BOTH, ratio_sql("id_02", ["card1", "card4"], ["mean", "std"], "-1"))
def ratio_id02(spark, sf):
    return ratios(spark, sf, {"id_02": ("card1", "card4")}, ("mean", "std"))


@query("ratio_d15_addr", BOTH, ratio_sql("D15", ["card1", "card4", "addr1", "addr2"], ["mean", "std"], "-1"))
def ratio_d15_addr(spark, sf):
    return ratios(spark, sf, {"D15": ("card1", "card4", "addr1", "addr2")}, ("mean", "std"))


@query(
    "group_stat_lookup_hot_split",
    BOTH,
    ratio_sql("TransactionAmt", ["card1", "card4"], ["mean", "std"], "null"),
)
def group_stat_lookup_hot_split(spark, sf):
    """The lookup beyond the broadcast limit: hot keys broadcast, the rest shuffled."""
    df = filled(spark, sf)
    out = GroupStats.fit(df, AMOUNT).transform(df, broadcast_bytes=0)
    return out.select("TransactionID", *[r6(c) for c in out.columns if c not in df.columns])


@query(
    "group_zscore",
    BOTH,
    f"""with {FILLED}, f as (select *, avg(TransactionAmt) over (partition by card1) as m,
          stddev_samp(TransactionAmt) over (partition by card1) as s from filled)
        select TransactionID, {s6('(TransactionAmt - m) / case when s = 0 then 1 else s end', 'card1_amt_z')} from f""",
)
def group_zscore(spark, sf):
    df = filled(spark, sf)
    out = GroupStats.fit(df, {"TransactionAmt": ("card1",)}).transform(
        df, kinds=(), zscores={"card1_amt_z": ("TransactionAmt", "card1")}
    )
    return out.select("TransactionID", r6("card1_amt_z"))


@query(
    "split_domain_rest",
    ["hosts"],
    """with p as (select page_id, domain, string_split(domain, '.') as a from hosts)
       select page_id, coalesce(a[1], 'missing') as domain_1, coalesce(a[2], 'missing') as domain_2,
         case when len(a) > 2 then array_to_string(a[3:], '.') else 'missing' end as domain_3 from p""",
)
def split_domain_rest(spark, sf):
    parts = S.domain_parts(F.col("domain"))
    return view(spark, sf, "hosts").select("page_id", *[p.alias(f"domain_{i + 1}") for i, p in enumerate(parts)])


@query(
    "split_domain_strict",
    ["hosts"],
    """with p as (select page_id, string_split(domain, '.') as a from hosts)
       select page_id, case when coalesce(len(a), 0) <= 3 then coalesce(a[1], 'missing') end as domain_1,
         case when coalesce(len(a), 0) <= 3 then coalesce(a[2], 'missing') end as domain_2,
         case when coalesce(len(a), 0) <= 3 then coalesce(a[3], 'missing') end as domain_3 from p""",
)
def split_domain_strict(spark, sf):
    parts = S.domain_parts_strict(F.col("domain"), on_error="null")
    return view(spark, sf, "hosts").select("page_id", *[p.alias(f"domain_{i + 1}") for i, p in enumerate(parts)])


ENCODED = ["card4", "P_emaildomain"]


@query(
    "label_encode",
    BOTH,
    f"with {FILLED} select TransactionID, "
    + ", ".join(f"dense_rank() over (order by {c}) - 1 as {c}" for c in [*ENCODED, "id_12"])
    + " from filled",
)
def label_encode(spark, sf):
    df = filled(spark, sf).select("TransactionID", *ENCODED, "id_12")
    return encode.LabelEncoder.fit(df).transform(df)


@query(
    "label_encode_unseen",
    ["txn", "txn_dup"],
    """with codes as (select card4, dense_rank() over (order by card4) - 1 as code
         from (select distinct card4 from txn where card4 <> 'error'))
       select TransactionID, coalesce(code, -1) as card4 from txn left join codes using (card4)""",
)
def label_encode_unseen(spark, sf):
    df = view(spark, sf, "txn").select("TransactionID", "card4")
    return encode.LabelEncoder.fit(df.where("card4 <> 'error'"), ["card4"]).transform(df)


@query(
    "label_encode_shuffled",
    BOTH,
    f"with {FILLED} select TransactionID, dense_rank() over (order by t) - 1 as t"
    " from (select TransactionID, concat(P_emaildomain, '/', cast(card1 as varchar)) as t from filled)",
)
def label_encode_shuffled(spark, sf):
    """A column with many values, looked up beyond the broadcast limit."""
    df = filled(spark, sf).select(
        "TransactionID", F.concat("P_emaildomain", F.lit("/"), F.col("card1").cast("string")).alias("t")
    )
    return encode.LabelEncoder.fit(df).transform(df, broadcast_bytes=0)


@query(
    "frequency_encode",
    BOTH,
    f"with {FILLED} select TransactionID, "
    + ", ".join(f"count(*) over (partition by {c}) as {c}_freq" for c in ("card4", "addr1", "addr2", "id_12"))
    + ", (select case when count(distinct P_emaildomain) < 50 then 1 end from filled)"
    " * count(*) over (partition by P_emaildomain) as P_emaildomain_freq from filled",
)
def frequency_encode(spark, sf):
    df = filled(spark, sf).select("TransactionID", "card1", "card4", "addr1", "addr2", "id_12", "P_emaildomain")
    out = encode.FrequencyEncoder.fit(df, df.columns[1:]).transform(df)
    wanted = ["card4_freq", "addr1_freq", "addr2_freq", "id_12_freq", "P_emaildomain_freq"]
    return out.select("TransactionID", *[F.col(c) if c in out.columns else F.lit(None).cast("long").alias(c) for c in wanted])


NUM = ["q", "price", "net", "disc", "tax", "flat", "line"]


def _scaled_sql(expression: str) -> str:
    return "select line_id, " + ", ".join(s6(expression.format(c=c), c) for c in NUM) + " from txn_num"


@query(
    "standard_scale",
    ["txn_num"],
    _scaled_sql("({c} - avg({c}) over ()) / case when stddev_pop({c}) over () = 0 then 1 else stddev_pop({c}) over () end"),
)
def standard_scale(spark, sf):
    df = view(spark, sf, "txn_num")
    return rounded(encode.StandardScaler.fit(df, NUM).transform(df), NUM)


@query(
    "minmax_scale",
    ["txn_num"],
    _scaled_sql(
        "({c} - min({c}) over ()) / case when max({c}) over () = min({c}) over () then 1"
        " else max({c}) over () - min({c}) over () end"
    ),
)
def minmax_scale(spark, sf):
    df = view(spark, sf, "txn_num")
    scaler = encode.StandardScaler.fit(df, NUM)
    ranges = encode.MinMaxScaler.fit_after(scaler, df, NUM)
    return rounded(ranges.transform(scaler.transform(df)), NUM)


def _hash(key: str) -> str:
    return f"md5(cast({key} as varchar) || '|42')"


RANKED = f"""ranked as (select *, row_number() over (order by {_hash('TransactionID')}) as r, count(*) over () as n,
    row_number() over (partition by isFraud order by {_hash('TransactionID')}) as rl,
    count(*) over (partition by isFraud) as nl from txn)"""


@query(
    "random_split",
    ["txn"],
    f"with {RANKED} select TransactionID, isFraud, cast(r <= ceil(n * 0.2::double) as int) as is_test from ranked",
)
def random_split(spark, sf):
    return sampling.random_split(view(spark, sf, "txn").select("TransactionID", "isFraud"), "TransactionID")


@query(
    "stratified_split",
    ["txn"],
    f"with {RANKED} select TransactionID, isFraud, cast(rl <= round(nl * 0.2::double) as int) as is_test from ranked",
)
def stratified_split(spark, sf):
    return sampling.stratified_split(view(spark, sf, "txn").select("TransactionID", "isFraud"), "TransactionID")


@query(
    "stratified_kfold",
    ["txn"],
    f"with {RANKED} select TransactionID, isFraud, cast((rl - 1) % 5 as int) as fold from ranked",
)
def stratified_kfold(spark, sf):
    return sampling.stratified_kfold(view(spark, sf, "txn").select("TransactionID", "isFraud"), "TransactionID", k=5)


@query("sample_n", ["txn"], f"with {RANKED} select TransactionID, isFraud from ranked where r <= 1000")
def sample_n(spark, sf):
    return sampling.sample_rows(view(spark, sf, "txn").select("TransactionID", "isFraud"), "TransactionID", 1000)


@query("sample_n_by_rank", ["txn_num"], "with ranked as (select line_id, row_number() over (order by md5(cast(line_id as varchar) || '|42'), line_id) as r, count(*) over () as n from (select distinct line_id from txn_num)) select line_id from ranked where r <= least(n, 20000)")
def sample_n_by_rank(spark, sf):
    ids = view(spark, sf, "txn_num").select("line_id").distinct()
    return sampling.sample_rows(ids, "line_id", 20_000)


@query(
    "class_weights",
    ["txn"],
    f"""select isFraud as label, count(*) as n, {s6('(select count(*) from txn) / (2.0 * count(*))', 'weight')}
        from txn group by isFraud""",
)
def class_weights(spark, sf):
    return rounded(sampling.class_weights(view(spark, sf, "txn")), ["weight"])


@query(
    "scale_pos_weight",
    ["txn"],
    "select TransactionID, case when isFraud = 1 then 20.0::double else 1.0::double end as weight from txn",
)
def scale_pos_weight(spark, sf):
    return sampling.with_class_weight(view(spark, sf, "txn"), positive=20.0).select("TransactionID", "weight")
