"""Reading the given tables and writing results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    ts_col: str,
    value_col: str,
    ts_format: str | None = None,
    **options: str,
) -> DataFrame:
    """A delimited source standardised to (ts, y). A missing file fails when the plan is built."""
    raw = spark.read.csv(path, schema=schema, header=True, **options)
    return standardise(raw, ts_col, value_col, ts_format)


def standardise(
    df: DataFrame, ts_col: str, value_col: str, ts_format: str | None = None, keep: Iterable[str] = ()
) -> DataFrame:
    ts = F.to_timestamp(ts_col, ts_format) if ts_format else F.col(ts_col).cast("timestamp")
    return df.select(*keep, ts.cast("timestamp_ntz").alias("ts"), F.col(value_col).cast("double").alias("y"))


def scoped(
    df: DataFrame,
    ts_col: str,
    start: str | None = None,
    end: str | None = None,
    **equal: object,
) -> DataFrame:
    """Rows inside [start, end] with the given column values; both reach the scan as filters."""
    if start is not None:
        df = df.where(F.col(ts_col) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(ts_col) <= F.lit(end).cast("timestamp_ntz"))
    for name, value in equal.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def write_raw_zone(df: DataFrame, path: str, partitions: Iterable[str]) -> None:
    """Raw rows kept as Parquet, one folder per partition value.

    No exchange on the folder columns: a kind that holds most rows stays spread over its tasks.
    """
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def read_raw_zone(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_with_preamble(
    spark: SparkSession, path: str, schema: str, preamble_lines: int = 1
) -> DataFrame:
    """Delimited files with metadata lines above the header line; both are skipped in every file.

    The files stay splittable: the lines to skip are the first ones of the split that starts at
    byte 0, told by the row's place in its task.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_place"),
    )
    first = (
        lines.where(F.col("_at") == 0)
        .groupBy("_file")
        .agg((F.min("_place") + preamble_lines + 1).alias("_rows_from"))
    )
    rows = lines.join(first, "_file").where(
        (F.col("_at") > 0) | (F.col("_place") >= F.col("_rows_from"))
    )
    return rows.where(F.trim("value") != "").select(F.from_csv("value", schema).alias("r")).select("r.*")


class Registry:
    """Named processed tables with the checks an experiment relies on."""

    def __init__(self, frames: dict[str, DataFrame], required: Iterable[str], min_rows: int = 100):
        self.frames = dict(frames)
        self.required = list(required)
        self.min_rows = min_rows

    def load(self, name: str, ts_col: str = "ts", value_col: str = "y") -> DataFrame:
        """The table with its columns checked, numbers coerced and incomplete rows dropped."""
        if name not in self.frames:
            raise KeyError(f"unknown dataset {name!r}; known: {sorted(self.frames)}")
        df = self.frames[name]
        missing = [c for c in self.required if c not in df.columns]
        if missing:
            raise ValueError(f"dataset {name!r} lacks columns {missing}")
        numeric = [f.name for f in df.schema.fields if f.name != ts_col and f.name == value_col]
        df = df.withColumns({c: F.col(c).try_cast("double") for c in numeric}).na.drop(how="any")
        if len(df.limit(self.min_rows).take(self.min_rows)) < self.min_rows:
            raise ValueError(f"dataset {name!r} has fewer than {self.min_rows} rows")
        return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(fmt).save(path)


def null_if_nan(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(column), column)


def write_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Metric rows with NaN written as null."""
    clean = {
        f.name: null_if_nan(f.name)
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    write_table(df.withColumns(clean) if clean else df, path, fmt)
