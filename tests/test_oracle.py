"""Every query with an oracle gives the oracle's rows; every other one runs."""

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare

SLOW = {n for n in entry.queries() if n.startswith(("score_", "train_", "stack_", "contrast_", "importance_from", "risk_report"))}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_oracle(spark, duck, sf, name):
    _, _, verdict = compare(spark, duck, name, sf)
    assert verdict == "equal"


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - SLOW))
def test_runs(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert df.count() > 0
    assert len(set(c.lower() for c in df.columns)) == len(df.columns)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1000
