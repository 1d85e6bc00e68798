"""Selections and nested cross-validation from shared sums against fits of each fold by itself."""

import numpy as np
from pyspark.sql import functions as F

from ambulo.operators import cells, penalized as pen


def table(spark, n=160, wide=12, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, wide))
    x[:, 3] += 1.5 * y
    x[:, 7] = x[:, 3] * 0.3 + x[:, 7]
    t = 2 * x[:, 3] - x[:, 5] + 0.3 * rng.normal(size=n)
    cols = [f"f{k}" for k in range(wide)]
    rows = [(i, int(y[i]), float(t[i]), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, f"id int, y int, t double, {', '.join(f'{c} double' for c in cols)}").repartition(3), cols, x, y, t


def sides(spark, df, label, k, repeats, inner):
    return {r["id"]: list(r["sides"]) for r in cells.nested_sides(df, "id", label, k, repeats, inner).collect()}


def fitted(z, y, l2, steps=300):
    """A balanced ridge logistic model by Newton's steps."""
    n1 = y.sum()
    w = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * (len(y) - n1)))
    b = np.zeros(z.shape[1])
    ridge = np.diag([0.0, *[l2] * (z.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ b))
        step = np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + ridge, z.T @ (w * (p - y)) + ridge @ b)
        b = b - step
        if np.abs(step).max() < 1e-10:
            return b
    return b


def ap(y, s):
    order = np.argsort(-s, kind="stable")
    hit = y[order] == 1
    return (np.cumsum(hit)[hit] / (np.flatnonzero(hit) + 1)).mean()


def scaled(x, on):
    return np.hstack([np.ones((len(x), 1)), (x - x[on].mean(axis=0)) / x[on].std(axis=0)])


def test_sides_cover_each_row_once_a_repeat(spark):
    df, *_ = table(spark)
    for own in sides(spark, df, "y", 4, 2, 3).values():
        assert len(own) == 4 * 2 * 4
        for r in range(2):
            part = np.array(own[r * 16 : (r + 1) * 16]).reshape(4, 4)
            assert (part[:, 3] == pen.TEST).sum() == 1
            for row in part:
                assert (row[:3] == pen.TEST).sum() == (row[3] == pen.TRAIN) and (row[:3] == 0).all() == (row[3] == pen.TEST)


def test_nested_cv_equals_fits_by_fold(spark):
    df, cols, x, y, _ = table(spark)
    strengths = (0.01, 1.0)
    rows = cells.nested_cv(df, "id", cols, "y", ("none", "k_best", "no such"), strengths, 3, 1, 2).collect()
    assert {(r["strategy"], r["fold"]) for r in rows} == {(s, f) for s in ("none", "k_best", "no such") for f in range(3)}
    assert all((r["error"] is not None) == (r["strategy"] == "no such") for r in rows)
    own = sides(spark, df, "y", 3, 1, 2)
    codes = np.array([own[i] for i in range(len(y))])
    for r in (r for r in rows if r["strategy"] == "none"):
        found = {}
        for c in strengths:
            for i in range(2):
                on, off = codes[:, r["fold"] * 3 + i] == pen.TRAIN, codes[:, r["fold"] * 3 + i] == pen.TEST
                z = scaled(x, on)
                found.setdefault(c, []).append(ap(y[off], z[off] @ fitted(z[on], y[on], 1 / c)))
        best = max(strengths, key=lambda c: np.mean(found[c]))
        assert r["choice"] == f"C={best}" and np.isclose(r["inner_ap"], np.mean(found[best]), atol=1e-6)
        on, off = codes[:, r["fold"] * 3 + 2] == pen.TRAIN, codes[:, r["fold"] * 3 + 2] == pen.TEST
        z = scaled(x, on)
        s = z[off] @ fitted(z[on], y[on], 1 / best)
        tp, fp, fn = (((s > 0) == a) & (y[off] == b) for a, b in ((True, 1), (True, 0), (False, 1)))
        assert np.isclose(r["ap"], ap(y[off], s), atol=1e-6) and np.isclose(r["f1"], 2 * tp.sum() / (2 * tp.sum() + fp.sum() + fn.sum()))
        pairs = s[y[off] == 1][:, None] - s[y[off] == 0][None, :]
        assert np.isclose(r["auc"], ((pairs > 0) + 0.5 * (pairs == 0)).mean(), atol=1e-9)


def test_cells_that_are_done_are_kept(spark):
    df, cols, *_ = table(spark)
    first = cells.nested_cv(df, "id", cols, "y", ("none",), (1.0,), 2, 1, 2)
    marked = first.withColumn("choice", F.lit(None).cast("string"))  # to be told apart
    again = cells.nested_cv(df, "id", cols, "y", ("none", "pca"), (1.0,), 2, 1, 2, done=marked)
    assert sorted((r["strategy"], r["choice"] is None) for r in again.collect()) == [("none", True)] * 2 + [("pca", False)] * 2


def test_selections(spark):
    df, cols, x, y, _ = table(spark)
    assert "f3" in cells.selected(df, "id", cols, "y", "l1") and len(cells.selected(df, "id", cols, "y", "stability")) >= 5
    assert cells.selected(df, "id", cols, "y", "mrmr", "k=10") == sorted(cells.selected(df, "id", cols, "y", "mrmr", "k=10"), key=cols.index)
    assert cells.agreed([(0, 1, 2, 3, 4, 5), (1, 2, 3, 4, 5), (5, 6)], np.arange(8)) == (1, 2, 3, 4, 5)
    assert cells.agreed([(0,), (1,)], np.arange(4)) == (0, 1) and cells.agreed([(), ()], np.arange(3)) == (0, 1, 2)
    assert cells.often_chosen(np.array([30, 30, 30, 30, 18, 17]), np.arange(6), 30) == (0, 1, 2, 3, 4)
    assert cells.often_chosen(np.array([30, 0, 5]), np.arange(3), 30) == (0, 1, 2)


def test_line_models_equal_fits_by_fold(spark):
    df, cols, x, _, t = table(spark)
    rows = cells.nested_cv_line(df, "id", cols, "t", ("none", "k_best", "l1", "pca"), (0.01, 0.5), (0.3,), 3, 1, 2).collect()
    assert len(rows) == 12 and all(r["r2"] > 0.8 for r in rows if r["strategy"] == "none")
    own = sides(spark, df, None, 3, 1, 2)
    codes = np.array([own[i] for i in range(len(t))])
    for r in (r for r in rows if r["strategy"] == "none"):
        on, off = codes[:, r["fold"] * 3 + 2] == pen.TRAIN, codes[:, r["fold"] * 3 + 2] == pen.TEST
        z = scaled(x, on)
        alpha = float(r["choice"].split(",")[0].split("=")[1])
        b = np.zeros(z.shape[1])
        b[0] = t[on].mean()
        for _ in range(2000):  # coordinates, on the rows themselves
            for j in range(1, len(b)):
                rest = t[on] - z[on] @ b + z[on][:, j] * b[j]
                pull = (z[on][:, j] @ rest) / on.sum()
                b[j] = np.sign(pull) * max(abs(pull) - alpha * 0.3, 0) / (1 + alpha * 0.7)
        e = t[off] - z[off] @ b
        assert np.isclose(r["r2"], 1 - (e @ e) / ((t[off] - t[off].mean()) ** 2).sum(), atol=1e-5) and np.isclose(r["mae"], np.abs(e).mean(), atol=1e-5)


def test_components_keep_variance(spark):
    df, cols, x, *_ = table(spark)
    d = pen.design(df, "id", cols, "y")
    s = pen.sums(d)
    side = pen.side_of(s, pen.side_medians(d, s), 0)
    values = np.linalg.eigvalsh(np.corrcoef(x.T))[::-1]
    made = pen.components(side)
    assert len(made.columns) == int(np.searchsorted(np.cumsum(values) / values.sum(), 0.95)) + 1
    assert np.allclose(np.diag(made.moments.sum(axis=0))[1 : len(made.columns) + 1], len(x))
    blocks = pen.components(side, [np.arange(6), np.arange(6, 8), np.arange(8, 12)], 0.8, 2)
    assert 4 <= len(blocks.columns) <= 12


def test_two_rings_are_parted_by_cosines(spark):
    rng = np.random.default_rng(4)
    n = 600
    y = rng.integers(0, 2, n)
    angle, r = rng.uniform(0, 2 * np.pi, n), np.where(y == 1, 2.0, 1.0) + rng.normal(scale=0.15, size=n)
    df = spark.createDataFrame([(i, int(y[i]), float(r[i] * np.cos(angle[i])), float(r[i] * np.sin(angle[i]))) for i in range(n)], "id int, y int, a double, b double")
    made, names = cells.fourier_features(df, ["a", "b"], 1.0, 80)
    x = np.array([[row[c] for c in ("a", "b")] for row in made.orderBy("id").collect()])
    z = np.array([[row[c] for c in names] for row in made.orderBy("id").collect()])
    far = ((x[:50, None] - x[None, :50]) ** 2).sum(axis=2)
    assert np.abs(z[:50] @ z[:50].T - np.exp(-far)).mean() < 0.1

    def auc(rows):
        s, t = np.array([row["score"] for row in rows]), np.array([row["y"] for row in rows])
        return (s[t == 1][:, None] > s[t == 0][None, :]).mean()

    rings = cells.out_of_fold(made, "id", names, "y").collect()
    assert sorted(row["id"] for row in rings) == list(range(n)) and {row["fold"] for row in rings} == set(range(5))
    assert auc(rings) > 0.95 and auc(cells.out_of_fold(df, "id", ["a", "b"], "y").collect()) < 0.7
    assert all(row["predicted"] == (row["score"] > 0) for row in rings)


def test_importances_are_the_falls_of_accuracy(spark):
    df, cols, x, y, _ = table(spark, n=400)
    got = {r["feature"]: r["importance"] for r in cells.importances(df, "id", cols, "y", repeats=8).collect()}
    assert set(got) == set(cols) and max(got, key=got.get) == "f3" and got["f3"] > 0.1
    assert all(abs(v) < 0.1 for c, v in got.items() if c not in ("f3", "f7"))
    d = pen.design(df, "id", cols, "y")
    held = {r["id"] for r in df.select("id").where("pmod(xxhash64(id, 42), 1000) < 250").collect()}
    on = np.array([i not in held for i in range(len(y))])
    z = scaled(x, on)
    b = fitted(z[on], y[on], 1.0)
    rng, falls = np.random.default_rng(0), []
    was = np.mean((z[~on] @ b > 0) == (y[~on] == 1))
    for _ in range(300):
        dealt = z[~on].copy()
        dealt[:, 4] = rng.permutation(dealt[:, 4])
        falls.append(was - np.mean((dealt @ b > 0) == (y[~on] == 1)))
    assert abs(got["f3"] - np.mean(falls)) < 4 * np.std(falls) / 8**0.5 and d.sides == 1


def test_neighbours_of_repeated_values_are_found_on_distinct_ones(spark, monkeypatch):
    """Thirty copies of each row: no step holds more than a row for each value and class; the result is that of all rows."""
    from ambulo.operators import learning

    def digamma(n):  # of whole numbers, less a constant that cancels out
        return sum(1 / i for i in range(1, int(n)))

    held, keep = [], learning.stored
    monkeypatch.setattr(learning, "stored", lambda df: held.append(keep(df)) or held[-1])
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=40), 1)
    y = (x + rng.normal(size=40) > 0).astype(int)
    for copies in (1, 2, 30):
        held.clear()
        xs, ys = np.repeat(x, copies), np.repeat(y, copies)
        df = spark.createDataFrame([(int(b), float(a)) for a, b in zip(xs, ys, strict=True)], "y int, f double")
        got = learning.nearest_information(df, ["f"], "y").first()["mi"]
        assert held and max(t.count() for t in held) <= 3 * len(set(zip(x, y, strict=True)))
        each = []
        for i in range(len(xs)):
            k = min(3, int((ys == ys[i]).sum()) - 1)
            d = np.sort(np.abs(np.delete(xs, i)[np.delete(ys, i) == ys[i]] - xs[i]))[k - 1] * (1 - 1e-12)
            each.append(digamma(k) - digamma((ys == ys[i]).sum()) - digamma(((xs >= xs[i] - d) & (xs <= xs[i] + d)).sum()))
        assert abs(got - max(0.0, digamma(len(xs)) + np.mean(each))) < 1e-9
