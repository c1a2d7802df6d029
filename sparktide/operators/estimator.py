"""The feature extractor and the threshold classifier as Spark ML stages."""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Transformer
from pyspark.sql import DataFrame

from sparktide.operators import classifiers, mvar


class MvarFeatures(Transformer):
    """Adds S, or the vector feature's columns, for a signal column."""

    def __init__(self, config: mvar.MvarConfig | None = None, signal: str = "signal", vector: bool = False, per_lag: bool = False):
        super().__init__()
        self.config, self.signal, self.vector, self.per_lag = config or mvar.MvarConfig(), signal, vector, per_lag

    def feature_names(self) -> list[str]:
        return mvar.feature_names(self.config, self.per_lag) if self.vector else ["S"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return mvar.extract(dataset, self.signal, self.config, self.vector, self.per_lag)


class ThresholdClassifier(Estimator):
    """Class medians and the best of a grid of thresholds on one feature."""

    def __init__(self, feature: str = "S", label: str = "y", metric: str = "f1", weight: float | None = None, points: int = 100):
        super().__init__()
        self.feature, self.label, self.metric, self.weight, self.points = feature, label, metric, weight, points

    def _fit(self, dataset: DataFrame) -> ThresholdModel:
        row = classifiers.fit_threshold(dataset, self.feature, self.label, self.points, self.metric, self.weight).first()
        return ThresholdModel(self.feature, row.asDict() if row else {})


class ThresholdModel(Model):
    """A fitted threshold; without one (no rows to fit) transform() raises ValueError."""

    def __init__(self, feature: str, values: dict):
        super().__init__()
        self.feature, self.values = feature, values

    def table(self, spark) -> DataFrame:
        """The model as one row, which is also how it is stored."""
        names = ("m0", "m1", "ascending", "thr")
        return spark.createDataFrame([tuple(self.values[n] for n in names)], "m0 double, m1 double, ascending boolean, thr double")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if not self.values:
            raise ValueError("the model isn't fitted")
        return classifiers.predict_threshold(dataset, self.feature, self.table(dataset.sparkSession))
