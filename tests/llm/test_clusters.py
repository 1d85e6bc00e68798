"""Operator 12 against its SQL, plain Lloyd in Python integers, and hard rows."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from ambulo.llm import clusters


def plain_lloyd(rows, k, rounds, dims, seed=3):
    """(vec_id, cluster, distance) of each kept row and the centroids, by the definition."""
    kept = [(i, [math.floor(1024 * float(e)) for e in v]) for i, v in rows if v is not None and len(v) == dims and all(e is not None and math.isfinite(e) for e in v)]
    order = sorted((r for r in kept), key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        owner = [nearest(x)[1] for _, x in kept]
        for c in range(len(centroids)):
            own = [x for (_, x), o in zip(kept, owner, strict=True) if o == c]
            if own:
                centroids[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return sorted(((i, nearest(x)[1], nearest(x)[0]) for i, x in kept), key=str), centroids


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in clusters.op12_delta_lloyd(spark, d).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    assert got and got == sorted(con.sql(clusters.OP12_SQL).fetchall())


@pytest.mark.parametrize("k, rounds, dims, block", [(8, 10, 3, 7), (3, 1, 2, 4096), (5, 4, 2, 1), (1, 3, 2, 50), (4, 0, 2, 9)])
def test_equals_plain_lloyd(spark, monkeypatch, k, rounds, dims, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    rng = np.random.default_rng(k + rounds)
    data = [(i, (rng.normal(size=dims) * 0.02 + rng.integers(0, 3, dims)).tolist()) for i in range(150)]
    data += [(i, data[i % 5][1]) for i in range(200, 230)]  # copies, ties
    got, now = clusters.cluster(spark.createDataFrame(data, "vec_id long, embedding array<double>"), k, rounds, dims)
    want, centroids = plain_lloyd(data, k, rounds, dims)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and now.centroids == centroids


def test_deltas_find_what_all_comparisons_find():
    rng = np.random.default_rng(8)
    x = rng.integers(-5, 5, (500, 4))
    old = rng.integers(-5, 5, (6, 4))
    owners, bars = clusters.reassign(x, None, None, old, np.ones(6, bool))
    for moved in ([1], [0, 3], [], [0, 1, 2, 3, 4, 5]):
        new = old.copy()
        new[moved] += rng.integers(-2, 3, (len(moved), 4))
        flags = np.isin(np.arange(6), moved)
        got, want = clusters.reassign(x, owners, bars, new, flags), clusters.reassign(x, None, None, new, flags)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [9.0, 9.0]), (None, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 0.0]), (6, [0.0, -inf]), (7, [-0.0001, 0.0001]), (8, [1.0, 2.0, 3.0]),
        (-(1 << 63), [3e5, -2.0]), ((1 << 63) - 1, [-7e5, 1.0]),
    ]
    docs = spark.createDataFrame([(*r, 1, "b") for r in data], "vec_id long, embedding array<double>, x int, block string")
    got, now = clusters.cluster(docs, 3, 5, 2)
    want, centroids = plain_lloyd(data, 3, 5, 2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and now.centroids == centroids
    assert clusters.cluster(docs.where("false"))[0].count() == 0
    few, now = clusters.cluster(docs.where("vec_id = 7"), 8, 10, 2)
    assert [tuple(r) for r in few.collect()] == [(7, 0, 0)] and len(now.centroids) == 1
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert {r["distance"] for r in clusters.cluster(huge, 1, 2, 2)[0].collect()} <= {clusters.LONGEST, 0} | {r for r in range(10)}
