"""Queries over the transaction and identity views: join, clean, profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog.registry import query, r6, rounded, s6
from riskloom.operators import clean, profile, reduce
from riskloom.session import checkpoint_dir
from riskloom.sources.fixtures import view
from riskloom.sources.tables import load_joined, read_table

TXN = "TransactionID, TransactionDT, TransactionAmt, card1, card4, addr1, addr2, D15, P_emaildomain, isFraud"
JOINED = f"{TXN}, id_02, id_12"


def joined(spark, sf):
    """Fact and identity, one row per id."""
    return load_joined(view(spark, sf, "txn"), view(spark, sf, "identity"))


@query(
    "left_join_identity",
    ["txn", "identity"],
    f"select {JOINED} from txn left join identity using (TransactionID)",
)
def left_join_identity(spark, sf):
    return joined(spark, sf)


@query("fact_without_identity", ["txn"], f"select {TXN} from txn")
def fact_without_identity(spark, sf):
    return load_joined(view(spark, sf, "txn"), None)


@query(
    "dedup_keep_first",
    ["txn_dup"],
    f"select {TXN} from (select *, row_number() over (partition by TransactionID order by seq) as rn from txn_dup) where rn = 1",
)
def dedup_keep_first(spark, sf):
    return clean.dedup_keep_first(view(spark, sf, "txn_dup"), "TransactionID", ["seq"]).drop("seq")


@query(
    "csv_scan",
    ["txn"],
    f"select {TXN} from txn",
)
def csv_scan(spark, sf):
    import uuid

    path = f"{checkpoint_dir(spark)}/txn-{uuid.uuid4().hex}.csv"
    view(spark, sf, "txn").write.option("header", True).csv(path)
    return read_table(spark, path).withColumns({c: F.col(c).cast("int") for c in ("addr1", "addr2")})


@query(
    "rename_columns",
    ["identity"],
    "select TransactionID, id_02, id_12 from identity",
)
def rename_columns(spark, sf):
    dashed = view(spark, sf, "identity").withColumnsRenamed({"id_02": "id-02", "id_12": "id-12"})
    return clean.rename_columns(dashed)


@query(
    "drop_label",
    ["txn"],
    f"select {TXN.replace(', isFraud', '')} from txn",
)
def drop_label(spark, sf):
    return clean.drop_columns(view(spark, sf, "txn"), ["isFraud"])


@query(
    "fill_constant",
    ["txn", "identity"],
    """select TransactionID, TransactionDT, TransactionAmt, coalesce(card1, -1) as card1,
         coalesce(card4, 'missing') as card4, coalesce(addr1, -1) as addr1, coalesce(addr2, -1) as addr2,
         coalesce(D15, -1) as D15, coalesce(P_emaildomain, 'missing') as P_emaildomain, isFraud,
         coalesce(id_02, -1) as id_02, coalesce(id_12, 'missing') as id_12
       from txn left join identity using (TransactionID)""",
)
def fill_constant(spark, sf):
    return clean.fill_constant(joined(spark, sf))


@query(
    "fill_median",
    ["txn", "identity"],
    """select TransactionID,
         coalesce(D15, (select median(D15) from txn)) as D15,
         coalesce(id_02, (select median(i.id_02) from txn left join identity i using (TransactionID))) as id_02,
         coalesce(cast(addr1 as double), (select median(addr1) from txn)) as addr1,
         coalesce(P_emaildomain, 'missing') as P_emaildomain
       from txn left join identity using (TransactionID)""",
)
def fill_median(spark, sf):
    return clean.fill_median(
        joined(spark, sf).select("TransactionID", "D15", "id_02", "addr1", "P_emaildomain"),
        ["D15", "id_02", "addr1"],
    )


NONFINITE = """case when D15 = 0 then cast('Infinity' as double) when D15 = 1 then cast('-Infinity' as double)
    when D15 = 2 then cast('NaN' as double) else D15 end"""


@query(
    "clean_nonfinite_median",
    ["txn"],
    """select TransactionID, coalesce(case when D15 > 2 then D15 end, (select median(D15) from txn where D15 > 2)) as v,
         cast(-1 as double) as nothing, cast(TransactionAmt as double) as TransactionAmt from txn""",
)
def clean_nonfinite_median(spark, sf):
    df = view(spark, sf, "txn").select(
        "TransactionID", F.expr(NONFINITE).alias("v"), F.lit(None).cast("double").alias("nothing"), "TransactionAmt"
    )
    return clean.fill_nonfinite_median(df, ["v", "nothing", "TransactionAmt"])


@query(
    "clean_nonfinite_constant",
    ["txn"],
    "select TransactionID, coalesce(case when D15 > 2 then D15 end, -1) as v from txn",
)
def clean_nonfinite_constant(spark, sf):
    return clean.fill_nonfinite(view(spark, sf, "txn").select("TransactionID", F.expr(NONFINITE).alias("v")), ["v"])


@query("drop_sparse", ["txn", "identity"], f"select {JOINED} from txn left join identity using (TransactionID)")
def drop_sparse(spark, sf):
    rare = F.when(F.col("D15") == 5, F.col("D15"))
    return clean.drop_sparse(joined(spark, sf).withColumn("rare", rare))


@query("drop_flat", ["txn_num"], "select line_id, q, price, net, disc, tax, line from txn_num")
def drop_flat(spark, sf):
    return clean.drop_flat(view(spark, sf, "txn_num"))


@query(
    "conform_features",
    ["txn"],
    "select TransactionID, D15, cast(-1 as double) as id_02, TransactionAmt from txn",
)
def conform_features(spark, sf):
    return clean.conform(view(spark, sf, "txn"), ["D15", "id_02", "TransactionAmt"], ["TransactionID"])


@query(
    "feature_list_difference",
    ["identity", "attrib_long"],
    "select distinct feature from attrib_long union all select 'TransactionDT'",
)
def feature_list_difference(spark, sf):
    df = view(spark, sf, "identity")
    listed = view(spark, sf, "attrib_long").select("feature").distinct()
    wanted = listed.union(spark.createDataFrame([("id_02",), ("TransactionDT",)], "feature string"))
    return clean.missing_features(df, wanted)


@query(
    "select_by_prefix",
    ["vectors"],
    "select " + ", ".join(f"cast(embedding[{i}] as double) as V{i}" for i in range(1, 65)) + " from vectors",
)
def select_by_prefix(spark, sf):
    block = reduce.block_from_array(view(spark, sf, "vectors"), "embedding", 64)
    return block.select(*clean.columns_with_prefix(block, "V"))


@query(
    "select_by_type",
    ["txn"],
    "select TransactionID, TransactionDT, TransactionAmt, card1, addr1, addr2, D15, isFraud from txn",
)
def select_by_type(spark, sf):
    df = view(spark, sf, "txn")
    return df.select(*clean.numeric_columns(df))


@query(
    "value_frequencies",
    ["txn"],
    """select 'card4' as feature, card4 as value, count(*) as n from txn where card4 is not null group by card4
       union all select 'addr1', cast(addr1 as varchar), count(*) from txn where addr1 is not null group by addr1
       union all select 'P_emaildomain', P_emaildomain, count(*) from txn where P_emaildomain is not null group by P_emaildomain""",
)
def value_frequencies(spark, sf):
    return profile.value_frequencies(view(spark, sf, "txn"), ["card4", "addr1", "P_emaildomain"])


COUNTED = ["TransactionID", "TransactionAmt", "card1", "card4", "addr1", "addr2", "D15", "P_emaildomain"]


@query(
    "distinct_counts",
    ["txn"],
    "with counted as ("
    + " union all ".join(f"select '{c}' as feature, count(distinct {c}) as n from txn" for c in COUNTED)
    + ") select feature, n as n_distinct, n > 0 and n < 50 as categorical from counted",
)
def distinct_counts(spark, sf):
    return profile.distinct_counts(view(spark, sf, "txn"), COUNTED)


NUMERIC = ["TransactionAmt", "addr1", "addr2", "D15", "id_02"]


@query(
    "column_profile",
    ["txn", "identity"],
    "with j as (select * from txn left join identity using (TransactionID)) "
    + " union all ".join(
        f"select '{c}' as feature, count(*) as n_rows, "
        f"{s6(f'avg(case when {c} is null then 1 else 0 end)', 'null_share')}, "
        f"{s6(f'avg({c})', 'mean')}, {s6(f'stddev_samp({c})', 'std')} from j"
        for c in NUMERIC
    ),
)
def column_profile(spark, sf):
    return rounded(profile.column_profile(joined(spark, sf), NUMERIC), ["null_share", "mean", "std"])


@query(
    "column_medians",
    ["txn", "identity"],
    "with j as (select * from txn left join identity using (TransactionID)) "
    + " union all ".join(f"select '{c}' as feature, cast(median({c}) as double) as median from j" for c in NUMERIC),
)
def column_medians(spark, sf):
    medians = profile.exact_medians(joined(spark, sf), NUMERIC)
    return spark.createDataFrame(list(medians.items()), "feature string, median double")


@query(
    "class_ratio",
    ["txn"],
    f"select count(*) as n_rows, {s6('avg(isFraud)', 'positive_ratio')} from txn",
)
def class_ratio(spark, sf):
    return rounded(profile.class_ratio(view(spark, sf, "txn")), ["positive_ratio"])


NUM = ["q", "price", "net", "disc", "tax", "flat", "line"]


@query(
    "corr_matrix",
    ["txn_num"],
    " union all ".join(
        f"select '{NUM[i]}' as feature_i, '{NUM[j]}' as feature_j, {i} as position_i, {j} as position_j, "
        + ("max(cast(null as double))" if "flat" in (NUM[i], NUM[j]) else f"round(corr({NUM[i]}, {NUM[j]}), 6) + 0.0")
        + " as r from txn_num"
        for j in range(len(NUM))
        for i in range(j)
    ),
)
def corr_matrix(spark, sf):
    return rounded(profile.correlation_pairs(view(spark, sf, "txn_num"), NUM), ["r"])


@query(
    "drop_correlated",
    ["txn_num"],
    # net is the only column beyond the limit; no row passes if that were not so.
    "select line_id, q, price, disc, tax, flat, line from txn_num "
    "where (select abs(corr(price, net)) > 0.85 and abs(corr(q, price)) < 0.85 from txn_num)",
)
def drop_correlated(spark, sf):
    return reduce.drop_correlated(view(spark, sf, "txn_num"), NUM, 0.85)


@query(
    "drop_correlated_by_cardinality",
    ["txn_num"],
    """select 'price' as feature from txn_num having count(distinct price) >= 55
       union all select 'net' from txn_num having count(distinct net) >= 55 and abs(corr(price, net)) <= 0.8
       union all select 'q' from txn_num having count(distinct q) >= 55""",
)
def drop_correlated_by_cardinality(spark, sf):
    kept = reduce.drop_correlated_wide(view(spark, sf, "txn_num"), NUM, 0.8, 55)
    return spark.createDataFrame([(c,) for c in kept], "feature string")
