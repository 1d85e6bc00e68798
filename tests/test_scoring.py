"""Five heads with made weights against a forward pass written out."""

import math

import numpy as np
import pytest

from ambulo.operators import scoring


def made(tmp_path, size=6, hidden=4, prefix="module."):
    rng = np.random.default_rng(5)
    w = {n: rng.normal(size=s) for n, s in scoring.expected_shapes(size, hidden).items()}
    path = str(tmp_path / "weights.npz")
    np.savez(path, **{prefix + n: v for n, v in w.items()})
    return path, w


def test_all_windows_get_five_scores(spark, tmp_path):
    path, w = made(tmp_path)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(50)] + [(50, [3.0] * 6), (51, None), (52, [1.0, None, 2.0, 3.0, 4.0, 5.0])]
    got = {r["k"]: r for r in scoring.score_heads(spark.createDataFrame(rows, "k int, window array<double>").repartition(3), ["k"], "window", path, batch=7).collect()}
    assert len(got) == 53
    for k, x in rows:
        if k > 50:
            assert all(got[k][h] is None for h in scoring.HEADS)
            continue
        m = sum(x) / 6
        sd = math.sqrt(sum((v - m) ** 2 for v in x) / 6) or 1.0
        hidden = [max(0.0, sum(w["shared.weight"][j][i] * (x[i] - m) / sd for i in range(6)) + w["shared.bias"][j]) for j in range(4)]
        for h, most in scoring.HEADS.items():
            want = most / (1 + math.exp(-(sum(a * b for a, b in zip(hidden, w[f"{h}.weight"], strict=True)) + w[f"{h}.bias"])))
            assert abs(got[k][h] - want) < 1e-9 and 0 <= got[k][h] <= most


def test_weights_are_matched_by_name_and_shape(spark, tmp_path):
    _, w = made(tmp_path)
    shapes = scoring.expected_shapes(6, 4)
    found = {f"module.{n}": v for n, v in w.items()} | {"extra": np.zeros(2)}
    del found["module.speed.bias"]
    found["module.cadence.weight"] = np.zeros(3)
    got = scoring.match_weights(found, shapes)
    assert got.missing == ["speed.bias"] and got.unexpected == ["extra"] and got.mismatched == ["cadence.weight"] and len(got.weights) == len(shapes) - 2
    path = str(tmp_path / "bad.npz")
    np.savez(path, **found)
    with pytest.raises(Exception, match="weights missing"):
        scoring.score_heads(spark.createDataFrame([(1, [1.0] * 6)], "k int, window array<double>"), ["k"], "window", path).collect()
