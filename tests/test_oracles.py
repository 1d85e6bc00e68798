"""Every row of queries that SQL cannot express, against plain NumPy."""

import math

import numpy as np
import pytest

from ambulo.plans import catalog, kernels, sleep

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def values(spark):
    """Events of each user in order."""
    rows = kernels.positions(spark, SF).select("user_id", "i", "value").orderBy("user_id", "i").collect()
    out = {}
    for r in rows:
        out.setdefault(r["user_id"], []).append(r["value"])
    return {u: np.array(v) for u, v in out.items()}


@pytest.fixture(scope="module")
def matrix(spark):
    df, cols = kernels._matrix(spark, SF)
    rows = df.orderBy("vec_id").collect()
    return np.array([[r[c] for c in cols] for r in rows]), np.array([r["y"] for r in rows]), cols


def test_distance_to_normal(spark, values):
    got = {r["user_id"]: r["w1"] for r in catalog.QUERIES["wasserstein_normal"](spark, SF).collect()}
    assert set(got) == set(values)
    for u, x in values.items():
        if len(x) < 30:
            assert got[u] is None
            continue
        drawn = np.random.RandomState(42).normal(x.mean(), x.std(), len(x))
        # The area between both empirical distributions, over all their steps.
        at = np.sort(np.concatenate([x, drawn]))
        a, b = (np.searchsorted(np.sort(v), at[:-1], "right") / len(v) for v in (x, drawn))
        assert math.isclose(got[u], float((np.abs(a - b) * np.diff(at)).sum()), rel_tol=1e-9)


def test_sample_entropy(spark):
    rows = sleep.recording(spark, SF).select("user_id", "i", "enmo").orderBy("user_id", "i").collect()
    parts = {}
    for r in rows:
        parts.setdefault((r["user_id"], r["i"] // 432), []).append(r["enmo"])
    got = {(r["user_id"], r["part"]): r["entropy"] for r in catalog.QUERIES["sample_entropy"](spark, SF).collect()}
    assert set(got) == set(parts) and sum(v is not None for v in got.values()) > 50
    for k, x in parts.items():
        x = np.array(x)
        if len(x) <= 200 or x.std() == 0:
            assert got[k] is None
            continue
        near = np.abs(x[:, None] - x[None, :]) <= 0.15 * x.std()
        n = len(x) - 2
        two = near[:n, :n] & near[1 : n + 1, 1 : n + 1]
        three = two & near[2:, 2:]
        b, a = (two.sum() - n) / 2, (three.sum() - n) / 2
        assert got[k] is None if not a or not b else math.isclose(got[k], -math.log(a / b), rel_tol=1e-9, abs_tol=1e-12)


def test_spectra(spark, values):
    got = {r["user_id"]: r for r in catalog.QUERIES["psd_features"](spark, SF).collect()}
    for u, x in values.items():
        n, hz = min(256, len(x)), kernels.HZ
        hann = np.array([0.5 - 0.5 * math.cos(2 * math.pi * k / n) for k in range(n)])
        sums, parts = np.zeros(n // 2 + 1), 0
        for at in range(0, len(x) - n + 1, n - n // 2):
            seg = x[at : at + n] - x[at : at + n].mean()
            for f in range(n // 2 + 1):  # the transform written out
                c = sum(hann[k] * seg[k] * np.exp(-2j * math.pi * f * k / n) for k in range(n))
                sums[f] += abs(c) ** 2 / (hz * (hann**2).sum()) * (1 if f == 0 or (n % 2 == 0 and f == n // 2) else 2)
            parts += 1
        density = sums / parts
        freq = np.arange(n // 2 + 1) * hz / n
        band = [k for k in range(len(freq)) if 0.5 <= freq[k] <= 6]
        top = max(band, key=lambda k: density[k])
        assert math.isclose(got[u]["dom_freq"], freq[top]) and math.isclose(got[u]["psd_amp"], density[top], rel_tol=1e-6)
        left = [k for k in band if k < top and density[k] <= density[top] / 2]
        right = [k for k in band if k >= top and density[k] <= density[top] / 2]
        if left and right:
            assert math.isclose(got[u]["psd_width"], freq[right[0]] - freq[left[-1]])
        else:
            assert got[u]["psd_width"] is None


def test_selection_queries(spark, matrix):
    x, y, cols = matrix
    names = lambda q: [r["feature"] for r in catalog.QUERIES[q](spark, SF).orderBy("place").collect()]
    r = np.corrcoef(x.T)
    kept = []
    for j in range(len(cols)):
        if all(abs(r[j, k]) <= 0.3 for k in kept):
            kept.append(j)
    assert names("corr_filter") == [cols[j] for j in kept]
    a, b = x[y == 1], x[y == 0]
    grand = x.mean(axis=0)
    between = len(a) * (a.mean(axis=0) - grand) ** 2 + len(b) * (b.mean(axis=0) - grand) ** 2
    f = between / (((a - a.mean(axis=0)) ** 2).sum(axis=0) + ((b - b.mean(axis=0)) ** 2).sum(axis=0)) * (len(y) - 2)
    assert names("select_k_best") == [cols[j] for j in sorted(np.argsort(-f)[:5])]
    mi = [nearest(x[:, j], y) for j in range(len(cols))]
    chosen = [int(np.argmax(mi))]
    while len(chosen) < 6:
        rest = [j for j in range(len(cols)) if j not in chosen]
        chosen.append(max(rest, key=lambda j: mi[j] - (r[j, chosen] ** 2).mean()))
    assert names("mrmr") == [cols[j] for j in chosen]


def nearest(x, y, k=3):
    """Mutual information by nearest neighbours, with all pairs."""
    psi = lambda n: sum(1 / i for i in range(1, n)) - 0.5772156649015329
    far = np.abs(x[:, None] - x[None, :])
    total = []
    for i in range(len(x)):
        own = np.sort(np.delete(far[i], i)[np.delete(y, i) == y[i]])
        d = own[k - 1] * (1 - 1e-12)
        total.append(psi(k) - psi(int((y == y[i]).sum())) - psi(int((far[i] <= d).sum())))
    return max(0.0, psi(len(x)) + float(np.mean(total)))
