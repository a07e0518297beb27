"""Large tables reach the driver as columns, not as a Python object for every row, whatever the session's settings."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimecast.llm.common import marked
from regimecast.operators.forest import UncertainForest


@pytest.fixture
def no_rows(spark, monkeypatch):
    name = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    kind = type(spark.range(0))
    assert issubclass(kind, DataFrame)
    with monkeypatch.context() as patch:
        patch.setattr(kind, "collect", lambda self: pytest.fail("rows were collected"))
        yield
    spark.conf.set(name, before)


@pytest.fixture
def forest(spark):
    rows = spark.range(60).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") * 1.0).alias("b"), F.sin("id").alias("target"))
    return UncertainForest(["a", "b"], trees=9, depth=4).fit(rows)


def test_nodes(spark, forest, no_rows):
    table = forest.nodes(spark)
    assert len(table) == forest.model.totalNumNodes
    assert (table["left"] < 0).sum() == (forest.model.totalNumNodes + 9) // 2
    assert (table.loc[table["left"] < 0, "threshold"].isna()).all()


def test_marked_hashes(spark, no_rows):
    marked(spark.range(5), spark.range(100).select(F.xxhash64("id").alias("th")))
