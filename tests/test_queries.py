"""Every registered query of the library against its SQL twin, and invariants of the plans."""

import pytest
from oracle import connect, same

from lumenlog.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    same(catalog.queries()[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    assert df.columns and df.count() > 0


def test_a_name_is_registered_once():
    with pytest.raises(ValueError):
        catalog.query("rrf_default")(lambda s, d: None)


@pytest.mark.parametrize("name", ["rrf_default", "sessions_rank"])
def test_rows_do_not_depend_on_partitions(spark, sf, name):
    rows = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(tuple, catalog.queries()[name](spark, sf).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1] and rows[0]


def test_nothing_at_or_after_the_decision_is_ranked(spark, sf):
    from pyspark.sql import functions as F

    from lumenlog.plans import stand_ins as T

    cases, s = T.cases(spark, sf), T.statements(spark, sf)
    for name in ("cosine_topk", "rrf_default", "sessions_rank", "compose_lean_score"):
        ranked = catalog.queries()[name](spark, sf)
        late = ranked.join(cases.select("query_id", "decision"), "query_id").join(s.select("id", "micros"), "id").where(F.col("micros") >= F.col("decision"))
        assert late.count() == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
