"""Fitted models as one-row tables of their kind and values, readable without pickles."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from sparktide.operators.interval_forests import Feature, IntervalForest, Tree
from sparktide.operators.kernels import Kernel, Ridge, transform
from sparktide.operators.networks import Network

SCHEMA = "kind string, version int, body string"
VERSION = 1


@dataclass(frozen=True)
class KernelModel:
    """Kernels, the pools of their features, and the ridge classifier on these."""

    kernels: list[Kernel]
    pools: tuple[str, ...]
    channels: int
    ridge: Ridge

    def score(self, rows: DataFrame, flat: str) -> DataFrame:
        return self.ridge.score(transform(rows, flat, self.channels, self.kernels, self.pools)).drop("features")


Stored = Network | IntervalForest | KernelModel


def _body(model: Stored) -> tuple[str, dict]:
    if isinstance(model, Network):
        params = {k: {"shape": list(v.shape), "values": v.ravel().tolist()} for k, v in model.params.items()}
        return "network", {"kind": model.kind, "params": params, "channels": model.channels, "mean": model.mean, "deviation": model.deviation, "losses": model.losses}
    if isinstance(model, IntervalForest):
        trees = [{"splits": [[k, *v] for k, v in t.splits.items()], "leaves": [[k, v] for k, v in t.leaves.items()]} for t in model.trees]
        return "interval_forest", {"specs": [[asdict(f) for f in s] for s in model.specs], "channels": model.channels, "low": model.low.tolist(), "high": model.high.tolist(), "trees": trees}
    if isinstance(model, KernelModel):
        ridge = {"weights": model.ridge.weights.tolist(), "intercept": model.ridge.intercept, "alpha": model.ridge.alpha, "errors": [[a, e] for a, e in model.ridge.errors.items()]}
        return "kernels", {"kernels": [asdict(k) for k in model.kernels], "pools": list(model.pools), "channels": model.channels, "ridge": ridge}
    raise TypeError(f"models of {type(model).__name__} aren't stored here")


def _model(kind: str, body: dict) -> Stored:
    if kind == "network":
        params = {k: np.array(v["values"]).reshape(v["shape"]) for k, v in body["params"].items()}
        return Network(body["kind"], params, body["channels"], body["mean"], body["deviation"], body["losses"])
    if kind == "interval_forest":
        trees = [Tree({k: (a, b) for k, a, b in t["splits"]}, {k: v for k, v in t["leaves"]}) for t in body["trees"]]
        return IntervalForest([[Feature(**f) for f in s] for s in body["specs"]], body["channels"], np.array(body["low"]), np.array(body["high"]), trees)
    if kind == "kernels":
        kernels = [Kernel(tuple(k["places"]), k["dilation"], tuple(k["channels"]), k["padded"], tuple(k["biases"])) for k in body["kernels"]]
        r = body["ridge"]
        return KernelModel(kernels, tuple(body["pools"]), body["channels"], Ridge(np.array(r["weights"]), r["intercept"], r["alpha"], {a: e for a, e in r["errors"]}))
    raise ValueError(f"unknown kind of model {kind}")


def write_model(spark: SparkSession, model: Stored, path: str) -> None:
    """Stores a model as one row; its numbers come back bit by bit."""
    kind, body = _body(model)
    spark.createDataFrame([(kind, VERSION, json.dumps(body))], SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> Stored:
    """The model stored below path; ValueError if there is none, or one of a later version."""
    row = spark.read.schema(SCHEMA).parquet(path).first()
    if row is None or row.version > VERSION:
        raise ValueError(f"no readable model below {path}")
    return _model(row.kind, json.loads(row.body))
