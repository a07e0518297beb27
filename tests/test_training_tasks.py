"""Training passes are spread by the number of rows, wherever the rows lie."""

import pytest
from pyspark.sql import functions as F

from regimecast.operators import forest


@pytest.mark.parametrize("partitions", [1, 16])
def test_training_tasks_follow_the_rows(spark, partitions):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 120_000, 1, partitions).select(F.rand(1).alias("x"))
    tasks = forest._few_tasks(rows, 20)
    sizes = tasks.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    wanted = min(cores, 5)
    assert tasks.rdd.getNumPartitions() == wanted
    assert len(sizes) == wanted and sizes.sum() == 120_000 and sizes.max() < 1.1 * sizes.min() + 10


def test_few_rows_are_one_task(spark):
    rows = spark.range(0, 1_000, 1, 8).select(F.rand(1).alias("x"))
    assert forest._few_tasks(rows, 20).rdd.getNumPartitions() == 1
