"""Raw sources to processed tables, and processed tables to one table per kind."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimecast.functions import calendar as cal
from regimecast.functions import scalars as sc
from regimecast.operators import features, summary
from regimecast.sources.tables import write_table

TS, VALUE = "timestamp", "energy_generation"


# --- one function per raw layout; each returns timestamp, energy_generation and extras ---------


def country_load(raw: DataFrame, preferred: str = "DK", order: str = "DateUTC") -> DataFrame:
    """Load values of the preferred country, or of the first one present."""
    kept = features.preferred_category(raw, "CountryCode", preferred, order)
    return kept.select(cal.parse_mixed("DateUTC").alias(TS), F.col("Value").cast("double").alias(VALUE))


def dated_hours(raw: DataFrame) -> DataFrame:
    """Date plus hour 1..24; rows without a load are dropped."""
    return raw.na.drop(subset=["load"]).select(
        cal.date_plus_hour("Date", "Hour").alias(TS), F.col("load").alias(VALUE), F.col("T").alias("temperature")
    )


def plant_power(raw: DataFrame) -> DataFrame:
    """Inverter rows of a timestamp collapsed into one."""
    rows = raw.withColumn(TS, cal.parse_fixed("DATE_TIME", "dd-MM-yyyy HH:mm"))
    return summary.collapse(
        rows, [TS], {VALUE: "AC_POWER", "dc_power": "DC_POWER"}, {"daily_yield": "DAILY_YIELD"}
    )


def wind_vectors(raw: DataFrame) -> DataFrame:
    """Speed and direction from the wind components at both heights."""
    out = {TS: cal.parse_fixed("TIMESTAMP", "yyyyMMdd HH:mm"), VALUE: F.col("TARGETVAR")}
    for height in (10, 100):
        out[f"wind_u{height}"] = F.col(f"U{height}")
        out[f"wind_v{height}"] = F.col(f"V{height}")
    for height in (10, 100):
        out[f"wind_speed_{height}m"] = sc.magnitude(f"U{height}", f"V{height}")
    for height in (10, 100):
        out[f"wind_direction_{height}m"] = sc.bearing(f"U{height}", f"V{height}")
    return raw.select(*[c.alias(n) for n, c in out.items()])


def bearing_series(raw: DataFrame, degrees: str = "wind direction at 100m (deg)") -> DataFrame:
    """Output taken from the step-to-step change of the wind direction, scaled to 0..1000."""
    stamped = raw.select(
        cal.from_parts("Year", "Month", "Day", "Hour", "Minute").alias(TS),
        F.col(f"`{degrees}`").cast("double").alias("wind_direction_100m"),
    )
    out = features.circular_variability(stamped, [], [TS], "wind_direction_100m", 1000.0, VALUE)
    circle = sc.degree_circle("wind_direction", "wind_direction_100m")
    return out.select(TS, VALUE, "wind_direction_100m", *[c.alias(n) for n, c in circle.items()])


def banded_series(raw: DataFrame) -> DataFrame:
    """Generation with its confidence limits and their distance."""
    return raw.select(
        cal.naive(F.to_timestamp("datetime_gmt")).alias(TS),
        F.col("generation_mw").alias(VALUE),
        F.col("lcl_mw").alias("generation_lcl"),
        F.col("ucl_mw").alias("generation_ucl"),
        features.band_width("lcl_mw", "ucl_mw").alias("generation_uncertainty"),
    )


# --- the run ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Source:
    name: str
    kind: str
    build: Callable[[], DataFrame]


def processed(base: DataFrame) -> DataFrame:
    """Calendar, lag and rolling columns; incomplete rows dropped."""
    return features.add_table_features(base, [], TS, VALUE)


def run_sources(spark: SparkSession, sources: Sequence[Source], folder: str) -> DataFrame:
    """Process and write every source; one that fails is reported and does not stop the others."""
    report = []
    for source in sources:
        try:
            path = f"{folder}/{source.name}"
            write_table(processed(source.build()), path)
            done = spark.read.parquet(path)
            row = done.agg(F.count(F.lit(1)), F.min(TS), F.max(TS), F.min(VALUE), F.max(VALUE)).first()
            report.append((source.name, source.kind, True, *row, len(done.columns), None))
        except Exception as error:  # noqa: BLE001 - isolation per source is the feature
            report.append((source.name, source.kind, False, 0, None, None, None, None, 0, str(error)))
    return spark.createDataFrame(
        report,
        "name string, kind string, ok boolean, total_rows bigint, first_ts timestamp_ntz, last_ts timestamp_ntz, "
        "min_value double, max_value double, n_columns int, error string",
    )


def unify(spark: SparkSession, report: DataFrame, folder: str) -> dict[str, DataFrame]:
    """One table per kind from the processed sources, tagged and sorted by time."""
    rows = report.where("ok").select("name", "kind").collect()
    kinds: dict[str, dict[str, DataFrame]] = {}
    for row in rows:
        kinds.setdefault(row["kind"], {})[row["name"]] = spark.read.parquet(f"{folder}/{row['name']}")
    out = {}
    for kind, frames in kinds.items():
        path = f"{folder}/combined_{kind}"
        write_table(features.tagged_union(frames).orderBy(TS), path)
        out[kind] = spark.read.parquet(path)
    return out
