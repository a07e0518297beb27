"""Rows whose times lie before 1970 give what the SQL gives."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SMALL


def test_hours_of_day(spark, tmp_path):
    early = F.expr("ts - INTERVAL 20000 DAYS")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    edges = spark.sql("SELECT explode(array('1969-12-31 23:59:59.9995', '1969-12-31 23:00:00', '1969-12-31 23:00:00.0005', '1969-12-31 22:59:59.9995', '1970-01-01 00:00:00')) AS t")
    one = events.limit(1).join(edges).withColumn("ts", F.col("t").cast(events.schema["ts"].dataType)).drop("t")
    events.withColumn("ts", early.cast(events.schema["ts"].dataType)).unionByName(one).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["agg4_hours_of_day"]).fetchall())
    got = entry.queries()["agg4_hours_of_day"](spark, str(tmp_path)).select("hour", "total_rows").collect()
    assert sorted(map(tuple, got)) == want and want[0][0] < 0
