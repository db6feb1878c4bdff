import os

import pytest

from attestor.plans.queries import ORACLE_SQL, QUERIES
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_duckdb(spark, name):
    oracle.agree(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_returns_rows(spark, name):
    assert QUERIES[name](spark, oracle.DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert not __spark_entry__.entry(spark).isEmpty()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_results_do_not_depend_on_partitions(spark, tmp_path):
    """The same tables dealt out anew give the same rows."""
    for t in ("orders", "customer"):
        spark.read.parquet(f"{oracle.DATA}/{t}.parquet").repartition(5).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("conflict_decisions", "conflict_versions", "recency_rank"):
        a, b = QUERIES[name](spark, oracle.DATA), QUERIES[name](spark, str(tmp_path))
        assert oracle.rows_of(a.columns, a.collect()) == oracle.rows_of(b.columns, b.collect())
