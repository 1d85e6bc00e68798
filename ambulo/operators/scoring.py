"""Scores of windows by networks with stated weights (G7, S16): five heads in one pass over the windows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the domain: what the heads give, and the largest value of each.
HEADS = {"speed": 2.0, "cadence": 180.0, "gait_length": 2.0, "regularity_eldernet": 1.0, "step_count": 40.0}


def expected_shapes(size: int, hidden: int) -> dict[str, tuple[int, ...]]:
    """Names and shapes of the weights: a shared layer, and a layer of one number for each head."""
    shared = {"shared.weight": (hidden, size), "shared.bias": (hidden,)}
    return shared | {f"{h}.{n}": s for h in HEADS for n, s in (("weight", (hidden,)), ("bias", ()))}


@dataclass
class Loaded:
    """Weights that were found, and what a file lacks, has besides, or has in another shape."""

    weights: dict[str, np.ndarray]
    missing: list[str]
    unexpected: list[str]
    mismatched: list[str]


def match_weights(found: dict[str, np.ndarray], shapes: dict[str, tuple[int, ...]], prefixes: tuple[str, ...] = ("module.", "model.")) -> Loaded:
    """Weights by name, without prefixes that a training run adds; those of another shape are not taken."""
    named = {}
    for name, value in found.items():
        for p in prefixes:
            name = name.removeprefix(p)
        named[name] = np.asarray(value, float)
    good = {n: named[n] for n, s in shapes.items() if n in named and named[n].shape == s}
    return Loaded(good, [n for n in shapes if n not in named], [n for n in named if n not in shapes], [n for n in shapes if n in named and named[n].shape != shapes[n]])


def forward(windows: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Each head's largest value times the logistic of a layer over the rectified shared layer of scaled windows."""
    mean, sd = windows.mean(axis=1, keepdims=True), windows.std(axis=1, keepdims=True)
    hidden = np.maximum((windows - mean) / np.where(sd > 0, sd, 1.0) @ w["shared.weight"].T + w["shared.bias"], 0)
    return {h: most / (1 + np.exp(-np.clip(hidden @ w[f"{h}.weight"] + w[f"{h}.bias"], -500, 500))) for h, most in HEADS.items()}


def score_heads(df: DataFrame, keys: list[str], window: str, weights: str, batch: int = 512) -> DataFrame:
    """Keys and the five heads' values of windows, arrays of equal length; windows with a null in them have none.

    weights is the path of an .npz file that all executors see. A task opens it once, before its first batch, and fails
    if a weight is missing or has another shape than the window's length asks for.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*(df.schema[k] for k in keys), *(StructField(h, DoubleType()) for h in HEADS)])

    def run(batches):
        loaded = None
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                rows = b.column(window)
                lists = rows.to_pylist()
                good = [i for i, v in enumerate(lists) if v and None not in v]
                out = {h: np.full(len(lists), np.nan) for h in HEADS}
                if good:
                    values = np.array([lists[i] for i in good], float)
                    if loaded is None:
                        with np.load(weights) as f:
                            held = {n: f[n] for n in f.files}
                        shared = next((v for n, v in held.items() if n.endswith("shared.bias")), np.empty(0))
                        loaded = match_weights(held, expected_shapes(values.shape[1], len(shared)))
                        if loaded.missing or loaded.mismatched:
                            raise ValueError(f"weights missing: {loaded.missing}, of another shape: {loaded.mismatched}")
                    for h, v in forward(values, loaded.weights).items():
                        out[h][good] = v
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *(pa.array(v, pa.float64(), mask=np.isnan(v)) for v in out.values())], [*keys, *HEADS])

    return df.select(*keys, window).mapInArrow(run, schema)
