"""Driver contract: entry() and every registered query run at sf0.001."""

import __spark_entry__ as E
from feedlens.plans.queries import QUERIES
from tests.conftest import SF001


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "avg_engagement" in df.columns


def test_every_query_runs_and_has_stable_columns(spark):
    qs, ors = E.queries(), E.oracle_sql()
    assert set(ors) <= set(qs)
    for name in QUERIES:        # the corpus queries are tested beside their operators
        fn = qs[name]
        df = fn(spark, SF001)
        cols = df.columns
        df.write.format("noop").mode("overwrite").save()
        assert cols == fn(spark, SF001).columns, name
