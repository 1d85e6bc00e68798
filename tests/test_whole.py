"""Queries see all of their tables and rows."""

import numpy as np
from pyspark.sql import functions as F

from ambulo.operators import cells, learning, penalized
from ambulo.plans import catalog, kernels

SF = "/root/testdata/sf0.001"


def test_nearest_reindex_has_every_grid_point_of_all_events(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").toPandas()
    e["sec"] = e["ts"].astype("datetime64[us]").astype("int64") // 1_000_000
    want = {}
    for user, rows in e.groupby("user_id"):
        at = sorted(zip(rows["sec"].tolist(), rows["value"].tolist(), strict=True))
        for g in range(at[0][0] // 1800, -(-at[-1][0] // 1800) + 1):
            near = [(abs(sec - g * 1800), sec, v) for sec, v in at if abs(sec - g * 1800) <= 600]
            want[user, g * 1800] = round(min(near)[2], 6) if near else None
    got = {(r["user_id"], r["grid"]): r["value"] for r in catalog.QUERIES["nearest_reindex"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 2e-6) for k, v in want.items())


def test_paired_tests_have_every_family_of_the_lines(spark):
    want = {tuple(r) for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_returnflag", "l_linestatus").distinct().collect()}
    assert ("N", "F") in want
    for name in ("pairwise_tests", "holm_adjust"):
        assert {(r["outcome"], r["model"]) for r in catalog.QUERIES[name](spark, SF).collect()} == want


def _embeddings(spark):
    return np.array([r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("embedding").collect()], float)


def test_the_matrix_has_every_element_of_the_embeddings(spark):
    df, cols = kernels._matrix(spark, SF)
    x = _embeddings(spark)
    assert cols == [f"f{k}" for k in range(x.shape[1])]
    assert np.allclose([df.agg(F.sum(c)).first()[0] for c in (cols[0], cols[-1])], x[:, [0, -1]].sum(axis=0))


def test_block_pca_projects_every_element(spark):
    z = _embeddings(spark)
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    n, want, spread = z.shape[1], [], []
    for block, part in (("a", z[:, : n // 2]), ("b", z[:, n // 2 : n * 7 // 8]), ("c", z[:, n * 7 // 8 :])):
        values = np.linalg.eigvalsh(np.cov(part.T, bias=True))[::-1]
        k = max(2, int(np.searchsorted(np.cumsum(values) / part.shape[1], 0.8)) + 1)
        want, spread = [*want, *(f"{block}_pc{j}" for j in range(k))], [*spread, *values[:k]]
    got = catalog.QUERIES["block_pca"](spark, SF).toPandas()
    assert list(got.columns) == ["vec_id", *want]
    assert np.allclose(got[want].var(ddof=0), spread, atol=1e-4)


def test_nested_cv_tunes_on_inner_folds(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 160)
    x = rng.normal(size=(160, 12))
    x[:, 3] += 2.5 * y
    cols = [f"f{k}" for k in range(12)]
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(160)], f"id int, y int, {', '.join(f'{c} double' for c in cols)}").cache()
    few = lambda label, rows: {"logistic": dict(list(learning.grids(label, rows)["logistic"].items())[::3])}
    rows = learning.nested_cv(df, "id", cols, "y", ("none", "no such"), few, 2, 1, 2).collect()
    assert {(r["strategy"], r["repeat"], r["fold"]) for r in rows} == {(s, 0, f) for s in ("none", "no such") for f in (0, 1)}
    for r in rows:
        assert (r["error"] is None) == (r["strategy"] == "none")
        assert r["error"] or r["choice"] in ("C=0.01", "C=10.0") and r["inner_ap"] > 0.85 and r["ap"] > 0.85 and r["auc"] > 0.85 and r["f1"] > 0.75


def test_nested_cv_query_has_all_folds_strategies_and_strengths(spark, monkeypatch):
    from inspect import signature

    seen = signature(cells.nested_cv)
    monkeypatch.setattr(cells, "nested_cv", lambda *a, **b: seen.bind(*a, **b))
    got = catalog.QUERIES["nested_cv"](spark, SF)
    got.apply_defaults()
    a = got.arguments
    assert (a["k"], a["repeats"], a["inner"]) == (5, 3, 3) and a["strategies"] == learning.STRATEGIES and len(a["strategies"]) == 5
    assert a["strengths"] == (0.01, 0.1, 1.0, 10.0)
    assert {n: len(g) for n, g in learning.grids("y", 100).items()} == {"logistic": 4, "forest": 3, "boosted": 4}


def test_stability_selection_fits_thirty_subsamples(spark, monkeypatch):
    seen, whole = [], penalized.logistic
    monkeypatch.setattr(penalized, "logistic", lambda d, s, sides, models: seen.extend(models) or whole(d, s, sides, models))
    assert catalog.QUERIES["stability_selection"](spark, SF).count() >= 5
    assert sorted(m.sample for m in seen) == list(range(-1, 30))
