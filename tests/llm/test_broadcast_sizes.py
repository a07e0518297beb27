"""What Spark may not send to the driver and all executors: rows it sizes too low."""

from pyspark.sql import functions as F

from regimecast.llm import simhash as S
from regimecast.session import materialise


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_exploded_variants_are_not_broadcast(spark):
    """33 variants and more of every value count as one row each, so a few thousand seem small whatever they come to."""
    prints = materialise(spark.range(3000).select(F.xxhash64("id").alias("fp")))
    plan = planned(S.links(prints))
    (met,) = [line for line in plan.splitlines() if "Join" in line and "part#" in line]
    assert "SortMergeJoin" in met
