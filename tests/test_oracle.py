"""Every registered query with a SQL counterpart, whole tables, at the smallest scale."""

import re

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    message, _ = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert message is None, message


def test_queries_without_sql(spark):
    own = {n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)}
    missing = sorted(own - set(entry.oracle_sql()))
    assert missing == [
        "A10_counted_beside_matched", "A10_counted_repeats", "A8_counted_bootstrap",
    ]
    assert entry.queries()["B8_fused_rollup"](spark, SF).count() == 1500


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["arm", "budget", "detection", "censored"]
    assert df.count() == 12
