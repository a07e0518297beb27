"""Fill, de-outlier and normalise as one fitted stage."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from regimecast.operators import clean, normalise
from regimecast.operators.ordering import join_params
from regimecast.session import materialise


@dataclass(frozen=True)
class SeriesPreprocessor:
    keys: Sequence[str]
    order: Sequence[str]
    value: str
    fill: str = "linear"
    outlier_z: float = clean.OUTLIER_Z
    method: str = "min_max"

    def fit(self, df: DataFrame) -> "SeriesPreprocessorModel":
        filled = materialise(clean.fill(df, self.keys, self.order, self.value, self.fill))  # for three passes
        outliers = clean.outlier_params(filled, self.keys, self.value)
        repaired = clean.repair_outliers(
            filled, self.keys, self.order, self.value, self.outlier_z, outliers
        )
        scale = normalise.fit(repaired, self.keys, self.value)
        # One row per series, stored: later transforms read it instead of fitting again.
        return SeriesPreprocessorModel(self, materialise(join_params(outliers, scale, self.keys)))


@dataclass(frozen=True)
class SeriesPreprocessorModel:
    """Holds one parameter row per series; new data is scaled with the fitted parameters."""

    settings: SeriesPreprocessor
    params: DataFrame = field(repr=False)

    def transform(self, df: DataFrame, name: str = "y_norm") -> DataFrame:
        s = self.settings
        filled = clean.fill(df, s.keys, s.order, s.value, s.fill)
        stats = self.params.select(*s.keys, "_mu", "_sd")
        repaired = clean.repair_outliers(filled, s.keys, s.order, s.value, s.outlier_z, stats)
        return normalise.apply(repaired, self.params, s.keys, s.value, s.method, name)

    def inverse(self, df: DataFrame, column: str, name: str) -> DataFrame:
        s = self.settings
        return normalise.invert(df, self.params, s.keys, column, s.method, name)

    def save(self, path: str) -> None:
        self.params.write.mode("overwrite").parquet(f"{path}/params")
        spark = self.params.sparkSession
        row = [(json.dumps(asdict(self.settings)),)]
        spark.createDataFrame(row, "settings string").write.mode("overwrite").json(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "SeriesPreprocessorModel":
        row = spark.read.schema("settings string").json(f"{path}/settings").first()
        settings = SeriesPreprocessor(**json.loads(row["settings"]))
        return SeriesPreprocessorModel(settings, spark.read.parquet(f"{path}/params"))

