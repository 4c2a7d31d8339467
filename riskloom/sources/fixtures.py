"""Views over the test tables that stand for the transaction inputs.

The text is shared by both engines; ``{epoch_s}`` is the one dialect difference.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

EPOCH_SPARK = "floor(unix_micros(cast(e.ts as timestamp)) / cast(1000000 as double))"
EPOCH_DUCKDB = "floor(epoch_us(e.ts) / cast(1000000 as double))"

VIEWS: dict[str, str] = {
    "txn": """
        select e.event_id as TransactionID,
          cast({epoch_s} - 1704067200 as bigint) as TransactionDT,
          e.value as TransactionAmt, e.user_id as card1, e.event_type as card4,
          c.c_nationkey as addr1, n.n_regionkey as addr2,
          case when e.event_id % 7 = 0 then null else cast(e.event_id % 97 as double) end as D15,
          case when e.event_id % 11 = 0 then null
               else regexp_extract(p.url, 'https?://([^/?#]+)', 1) end as P_emaildomain,
          cast(e.value > 100 as int) as isFraud
        from events e
        left join customer c on e.user_id = c.c_custkey
        left join nation n on c.c_nationkey = n.n_nationkey
        left join pages p on e.event_id % 50 = p.page_id""",
    "identity": """
        select e.event_id as TransactionID, c.c_acctbal as id_02, c.c_mktsegment as id_12
        from events e join customer c on e.user_id = c.c_custkey
        where c.c_mktsegment in ('BUILDING', 'MACHINERY') and e.event_id % 3 <> 0""",
    "txn_dup": """
        select *, 0 as seq from txn union all
        select TransactionID, TransactionDT, TransactionAmt + 1, card1, card4, addr1, addr2, D15,
          P_emaildomain, isFraud, 1 as seq
        from txn where TransactionID % 10 = 0""",
    "hosts": """
        select page_id, regexp_extract(url, 'https?://([^/?#]+)', 1) as domain from pages
        union all select -1, 'missing' union all select -2, 'a.b'
        union all select -3, 'a.b.c.d' union all select -4, null""",
    "txn_num": """
        select l_orderkey * 10 + l_linenumber as line_id, l_quantity as q, l_extendedprice as price,
          l_extendedprice * (1 - l_discount) as net, l_discount as disc, l_tax as tax,
          cast(1.0 as double) as flat, cast(l_linenumber as double) as line from lineitem""",
    "vectors": """
        select vec_id, embedding, cast(label = 0 as int) as isFraud from embeddings""",
    "scored": """
        select o_orderkey as TransactionID, cast(o_totalprice > 400000 as int) as true_label,
          ((o_orderkey * 7919 + 104729) % 1000) / cast(1000 as double) * 0.6
            + case when o_totalprice > 400000 then cast(0.35 as double) else cast(0 as double) end
            as fraud_probability
        from orders""",
    "learnable": """
        select o_orderkey as TransactionID, o_totalprice / cast(500000 as double) as x1,
          (o_custkey % 100) / cast(100 as double) as x2,
          ((o_orderkey * 7919) % 997) / cast(997 as double) as x3,
          cast((o_totalprice / cast(500000 as double)) * ((o_custkey % 100) / cast(100 as double)) > 0.55
               and (o_orderkey * 31 + 7) % 20 <> 0 as int) as isFraud
        from orders""",
    "attrib_long": """
        select l_orderkey * 10 + l_linenumber as row_id,
          concat('f', cast(l_partkey % 12 as varchar(10))) as feature,
          (l_quantity - 25) / cast(100 as double) * (1 + l_partkey % 12)
            + (l_partkey % 12 - 6) / cast(50 as double) as shap_value
        from lineitem""",
}


def with_views(names: list[str], epoch: str) -> str:
    """A ``WITH`` clause defining the named views and the views they use."""
    needed: list[str] = []

    def visit(name: str) -> None:
        for other in VIEWS:
            if other != name and re.search(rf"\b(from|join) {other}\b", VIEWS[name]):
                visit(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        visit(name)
    return "with " + ", ".join(f"{n} as ({VIEWS[n].replace('{epoch_s}', epoch)})" for n in needed)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view as a DataFrame over ``sf_dir``."""
    text = with_views([name], EPOCH_SPARK)
    for base in BASE_TABLES:
        if re.search(rf"\b(from|join) {base}\b", text):
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(f"{text} select * from {name}")
