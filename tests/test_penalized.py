"""Models from additive sums against plain NumPy fits of the rows themselves."""

import numpy as np
import pytest

from ambulo.operators import penalized as pen


def table(spark, n=300, seed=1, nulls=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)) * [1, 2, 1, 5, 1, 1] + [0, 1, 0, 3, 0, 0]
    x[:, 5] = x[:, 0] + 0.01 * rng.normal(size=n)
    y = (x[:, 0] - 0.4 * x[:, 1] + rng.normal(size=n) > 0).astype(int)
    if nulls:
        x[rng.random(n) < 0.2, 1] = np.nan
        x[rng.random(n) < 0.8, 4] = np.nan
    cols = [f"c{j}" for j in range(6)]
    rows = [(i, int(y[i]), *(None if np.isnan(v) else float(v) for v in x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, y int, " + ", ".join(f"{c} double" for c in cols)).repartition(3)
    return df, cols, x, y


def filled(x):
    out = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    return (out - out.mean(axis=0)) / out.std(axis=0)


def slope(z, y, w, b):
    r = w * (1 / (1 + np.exp(-(z @ b))) - y)
    return z.T @ r


def test_filters_and_moments(spark):
    df, cols, x, y = table(spark)
    d = pen.design(df, "id", cols, "y")
    s = pen.sums(d)
    side = pen.side_of(s, pen.side_medians(d, s), 0)
    assert side.columns.tolist() == [0, 1, 2, 3]  # the fifth lacks values, the sixth repeats the first
    z = filled(x)
    assert np.allclose(side.moments.sum(axis=0)[1:, 1:], z.T @ z, atol=1e-6) and np.allclose(side.rows, [(y == 0).sum(), (y == 1).sum()])
    assert np.allclose(side.correlation, np.corrcoef(z.T), atol=1e-9)
    for j in range(4):
        a, b = z[y == 0, j], z[y == 1, j]
        between = len(a) * a.mean() ** 2 + len(b) * b.mean() ** 2
        within = (((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()) / (len(y) - 2)
        assert np.isclose(side.f[j], between / within)


@pytest.mark.parametrize("l1, l2", [(0.0, 10.0), (0.0, 0.1), (10.0, 0.0), (40.0, 0.0)])
def test_logistic_models_are_at_their_minimum(spark, l1, l2):
    df, cols, x, y = table(spark)
    d = pen.design(df, "id", cols, "y", samples=2)
    s = pen.sums(d)
    side = pen.side_of(s, pen.side_medians(d, s), 0)
    models = [pen.Model(0, (0, 1, 2, 3), l1, l2), pen.Model(0, (0, 2), l1, l2), pen.Model(0, (0, 1, 2, 3), l1, l2, sample=1)]
    got = pen.logistic(d, s, [side], models)
    z = np.hstack([np.ones((len(y), 1)), filled(x)])
    drawn = {r["key"]: r["samples"][1] for r in d.rows.collect()}
    for m, b in zip(models, got, strict=True):
        on = np.array([m.sample < 0 or drawn[i] == 1 for i in range(len(y))])
        counts = np.array([(y[on] == c).sum() for c in (0, 1)])
        w = on * (counts.sum() / (2 * counts))[y]
        g = slope(z, y, w, b)
        assert abs(g[0]) < 1e-3 and all(b[j + 1] == 0 for j in range(6) if j not in m.columns)
        for j in m.columns:  # conditions of the minimum
            total = g[j + 1] + l2 * b[j + 1]
            assert abs(total + l1 * np.sign(b[j + 1])) < 1e-3 if b[j + 1] else abs(total) <= l1 + 1e-3


@pytest.mark.parametrize("alpha, share", [(0.1, 1.0), (0.5, 0.3), (0.01, 0.7)])
def test_least_squares_from_products(spark, alpha, share):
    df, cols, x, y = table(spark, nulls=False)
    d = pen.design(df.withColumn("t", df["c0"] * 3 + df["c3"]), "id", cols, "t")
    s = pen.sums(d)
    side = pen.side_of(s, pen.side_medians(d, s), 0)
    b = pen.least_squares(side, range(5), alpha, share)
    z, t = np.hstack([np.ones((len(y), 1)), filled(x)]), x[:, 0] * 3 + x[:, 3]
    g = z.T @ (z @ b - t) / len(t)
    assert abs(g[0]) < 1e-6
    for j in range(5):
        total = g[j + 1] + alpha * (1 - share) * b[j + 1]
        assert abs(total + alpha * share * np.sign(b[j + 1])) < 1e-5 if b[j + 1] else abs(total) <= alpha * share + 1e-5


def test_binned_information(spark):
    df, cols, x, y = table(spark, nulls=False)
    d = pen.design(df, "id", cols, "y")
    got = pen.binned_information(pen.sums(d), 0)
    for j in range(6):
        b = np.searchsorted(np.unique(np.quantile(x[:, j], np.arange(1, 16) / 16)), x[:, j], "left")
        want = sum(np.mean((b == u) & (y == c)) * np.log(np.mean((b == u) & (y == c)) / np.mean(b == u) / np.mean(y == c)) for u in set(b) for c in (0, 1) if ((b == u) & (y == c)).any())
        assert np.isclose(got[j], want)


def test_one_class_gives_zero_and_empty_tables_run(spark):
    df, cols, *_ = table(spark)
    for some in (df.where("y = 1"), df.where("false")):
        d = pen.design(some, "id", cols, "y")
        s = pen.sums(d)
        side = pen.side_of(s, pen.side_medians(d, s), 0)
        assert not pen.logistic(d, s, [side], [pen.Model(0, (0, 1), 0.0, 1.0)]).any()


def test_blocks_without_nulls_carry_no_null_columns(spark, monkeypatch):
    """every pass carried a column of zeros for each column without nulls; blocks of both kinds add up."""
    assert pen._augmented(np.ones((3, 4))).shape == (3, 5) and pen._augmented(np.array([[1.0, np.nan]])).shape == (1, 5)
    df, cols, x, y = table(spark)
    d = pen.design(df.coalesce(1), "id", cols, "y", samples=1)
    found = []
    for rows in (1, 2048):
        monkeypatch.setattr(pen, "ROWS", rows)
        s = pen.sums(d)
        side = pen.side_of(s, pen.side_medians(d, s), 0)
        models = [pen.Model(0, (0, 1, 2), 0.0, 1.0), pen.Model(0, (0, 1, 2), 0.0, 1.0, sample=0)]
        found.append((s.products, s.bins, s.targets, pen._gradients(d, [side], models, np.full((2, 13), 0.1), np.ones((2, 2)))))
    assert all(np.allclose(a, b) for a, b in zip(*found, strict=True)) and found[0][0].shape == (1, 2, 13, 13)
