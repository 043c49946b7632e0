"""Every query with SQL against DuckDB on the smallest tables; the others run and have rows."""

import os

import pytest

from corpuslens.plans import queries as plans

from .compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_as_sql(spark, connection, name):
    assert differences(plans.QUERIES[name](spark, FOLDER), plans.ORACLES[name], connection) == []


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_hierarchy_has_a_leaf_for_every_row_up_to_5000(spark, tmp_path):
    rows = [(i, [float(i % 37), float(i * i % 101)], i % 3) for i in range(1200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert plans.QUERIES["hierarchy_nodes"](spark, str(tmp_path)).where("is_leaf").count() == 1200
