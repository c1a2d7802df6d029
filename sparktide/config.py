"""Defaults of the engine."""

from __future__ import annotations

from dataclasses import dataclass

# The standard channels of a recording, in order: fixed values.
STANDARD_CHANNELS = ("FP1", "FP2", "F7", "F3", "FZ", "F4", "F8", "T3", "C3", "CZ", "C4", "T4", "T5", "P3", "PZ", "P4", "T6", "O2")


@dataclass(frozen=True)
class EngineConfig:
    """Parameter values that hold unless a call says otherwise; a plain object without side effects on import."""

    window_sec: float = 2.0
    stride_sec: float = 2.0
    sample_rate: float = 256.0
    annotation_rate: float = 512.0
    test_size: float = 0.2
    seed: int = 42
    order: int = 3
    n_basis: int = 10
    basis: str = "bspline"
    regularization: float = 0.1
    norm: str = "fro"
    n_time_points: int = 50
    n_grid_points: int = 100
    threshold_metric: str = "f1"
    smoothing_window: int = 5
    smoothing_threshold: float = 0.5
    required_channels: int = 29


@dataclass(frozen=True)
class Paths:
    """Folders of a project; what a file doesn't name lies below the project's root. Nothing is made or read on import."""

    project_root: str
    raw_data: str
    features: str
    results: str
    logs: str

    @property
    def artifacts(self) -> str:
        """Windows, labels and manifest are kept with the features."""
        return self.features

    @staticmethod
    def from_text(text: str) -> Paths:
        """From lines 'name: folder' (project_root, raw_data_path, features_path, results_path, logs_path; '#' begins a comment); ValueError without a root."""
        named = {}
        for line in text.splitlines():
            name, _, value = line.split("#", 1)[0].partition(":")
            if value.strip():
                named[name.strip()] = value.strip().strip("'\"").rstrip("/")
        root = named.get("project_root")
        if not root:
            raise ValueError("project_root is missing")
        return Paths(root, *[named.get(f"{k}_path", f"{root}/{default}") for k, default in (("raw_data", "data/raw"), ("features", "data/features"), ("results", "results"), ("logs", "logs"))])
