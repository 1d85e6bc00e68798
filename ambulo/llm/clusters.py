"""Operator 12, centroid clustering by delta Lloyd.

Vectors are cut once into blocks, which stay where they are, dealt to buckets. The assignment of every block (owner and squared distance of
each vector) is a table of its own, written once a round, and the sums and counts of the clusters live from round to
round. A round tells apart which centroids moved: a vector whose own centroid stayed needs only the moved ones, with
its stored distance as the bar; the others are compared with all. A block emits what its vectors carry from owner to
owner as signed integers, and the sums change by the totals of these transfers alone. All numbers are integers, so the
result does not depend on the order of anything.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir, table, tidy

SCALE = 1024
#: Vectors in a block at most; rows of a block stand together in one Arrow batch.
BLOCK = 4096
#: Components are held to this bound either way (a component of a billion), so that their sums stay exact.
MOST = 1 << 40
#: Components up to here have squared distances of 64 components that fit 64 bits; larger ones go by Python's integers.
PLAIN = 1 << 27
LONGEST = (1 << 63) - 1


@dataclass
class Clusters:
    """Centroids as rows of integers, which of them moved last, and the exact sums and counts of their vectors."""

    centroids: list[list[int]]
    moved: list[bool]
    sums: list[list[int]]
    counts: list[int]

    def step(self, sums: dict[tuple[int, int], int], counts: dict[int, int]) -> Clusters:
        """After a round's transfers: new sums and counts, and the centroids that follow; empty clusters keep theirs."""
        total = [[s + sums.get((k, d), 0) for d, s in enumerate(row)] for k, row in enumerate(self.sums)]
        held = [n + counts.get(k, 0) for k, n in enumerate(self.counts)]
        new = [[s // n for s in row] if n else old for row, n, old in zip(total, held, self.centroids, strict=True)]
        return Clusters(new, [a != b for a, b in zip(new, self.centroids, strict=True)], total, held)


def whole_vectors(vectors: DataFrame, dims: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and x, the integers floor(SCALE * component), of the vectors with `dims` finite components."""
    x = F.col(embedding).cast("array<double>")
    good = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    bound = lambda v: F.greatest(F.least(v, F.lit(float(MOST))), F.lit(float(-MOST)))
    return vectors.where(good).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(bound(v * SCALE)).cast("long")).alias("x"))


def first_centroids(whole: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors with the k smallest SHA-256 of `seed:vec_id`, in that order; ties by components, null ids last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["x"]) for r in whole.orderBy(order.asc_nulls_last(), "x").select("x").limit(k).collect()]


def blocks(whole: DataFrame, dims: int) -> DataFrame:
    """The vectors packed, at most BLOCK to a row: block, n, ids (null ones by `nulls`) and x as little-endian integers."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids = part.column("vec_id")
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype("<i8")
                x = x.astype("<i4") if not len(x) or np.abs(x).max() <= PLAIN else x
                yield pa.RecordBatch.from_pydict({"n": [part.num_rows], "ids": [ids.fill_null(0).to_numpy().astype("<i8").tobytes()], "nulls": [np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes()], "x": [x.tobytes()]})

    packed = whole.mapInArrow(tidy(run), "n long, ids binary, nulls binary, x binary")
    return packed.select(F.monotonically_increasing_id().alias("block"), "*")


@contextmanager
def _bucketed(packed: DataFrame, parts: int):
    """A table of the blocks, dealt to buckets by block, as long as it lasts: joins by block read it where it lies."""
    spark = packed.sparkSession
    name = f"blocks_{uuid4().hex}"
    # Exchanged once as the buckets are, so that each is one file.
    packed.repartition(parts, "block").write.bucketBy(parts, "block").option("path", f"{shared_dir(spark).rstrip('/')}/{name}").format("parquet").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")  # the files stay, as those of checkpoints do


def _unpack(data: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, "<i4" if len(data) == 4 * n * dims else "<i8").reshape(n, dims).astype(np.int64)


def _plain(x: np.ndarray, c: np.ndarray) -> bool:
    return max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= PLAIN


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows x from rows c, exact; beyond 64 bits as Python's integers."""
    if _plain(x, c):
        return np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)
    return np.stack([((x.astype(object) - one.astype(object)) ** 2).sum(axis=1) for one in c], axis=1)


def reassign(x: np.ndarray, owners: np.ndarray | None, bars: np.ndarray | None, centroids: np.ndarray, moved: np.ndarray):
    """New owners and squared distances, given those of the round before (None: there was none).

    Whoever's centroid stayed is compared with the moved ones only: the others were no nearer before. Of equal
    distances the smaller number wins.
    """
    if owners is None:
        far = squared(x, centroids)
        new = far.argmin(axis=1)
        return new, far[np.arange(len(x)), new]
    new, near = owners.copy(), bars.astype(np.int64 if _plain(x, centroids) else object)
    lost = np.flatnonzero(moved[owners])
    if len(lost):
        far = squared(x[lost], centroids)
        new[lost] = far.argmin(axis=1)
        near[lost] = far[np.arange(len(lost)), new[lost]]
    kept, rivals = np.flatnonzero(~moved[owners]), np.flatnonzero(moved)
    if len(kept) and len(rivals):
        far = squared(x[kept], centroids[rivals])
        best = far.argmin(axis=1)
        top = far[np.arange(len(kept)), best]
        wins = (top < near[kept]) | ((top == near[kept]) & (rivals[best] < new[kept]))
        new[kept[wins]], near[kept[wins]] = rivals[best[wins]], top[wins]
    return new, near


def _packed_bars(bars: np.ndarray) -> bytes:
    """Distances as 64-bit numbers; those beyond are held at the largest (their vectors are compared anew each round)."""
    return np.array([min(int(b), LONGEST) for b in bars], "<i8").tobytes() if bars.dtype == object else bars.astype("<i8").tobytes()


def _round(packed: DataFrame, state: DataFrame | None, now: Clusters, dims: int) -> DataFrame:
    """The next state: block, owners, bars, and the block's transfers (vectors and components that came or went)."""
    centroids, moved, k = np.array(now.centroids, np.int64), np.array(now.moved), len(now.centroids)
    rows = packed.select("block", "n", "x")
    # Only the state is exchanged, which has under a tenth of the bytes of the blocks.
    rows = rows.join(state.select("block", "owners", "bars"), "block") if state is not None else rows.withColumns({"owners": F.lit(None).cast("binary"), "bars": F.lit(None).cast("binary")})

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x = _unpack(r["x"], r["n"], dims)
                before = None if r["owners"] is None else np.frombuffer(r["owners"], "<u2").astype(np.int64)
                bars = None if r["bars"] is None else np.frombuffer(r["bars"], "<i8")
                known = before is not None and not (bars == LONGEST).any()
                new, near = reassign(x, before if known else None, bars, centroids, moved)
                went = np.flatnonzero(new != before) if before is not None else np.arange(len(x))
                sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
                for sign, owner in ((1, new), (-1, before)):
                    for c in np.unique(owner[went]) if owner is not None else ():
                        own = went[owner[went] == c]
                        sums[c] += sign * x[own].sum(axis=0)
                        counts[c] += sign * len(own)
                shown = len(went) > 0
                yield pa.RecordBatch.from_pydict(
                    {"block": [r["block"]], "owners": [new.astype("<u2").tobytes()], "bars": [_packed_bars(near)], "sums": pa.array([sums.ravel().tolist() if shown else None], pa.list_(pa.int64())), "counts": pa.array([counts.tolist() if shown else None], pa.list_(pa.int64()))}
                )

    return cut(rows.mapInArrow(tidy(run), "block long, owners binary, bars binary, sums array<long>, counts array<long>"))


def _transfers(state: DataFrame, dims: int) -> tuple[dict, dict]:
    """The totals of all blocks' transfers: k * dims sums and k counts."""
    out = []
    for name in ("sums", "counts"):
        each = state.select(F.posexplode(name).alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        out.append({r["i"]: int(r["v"]) for r in each.collect()})
    return {(i // dims, i % dims): v for i, v in out[0].items()}, out[1]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> tuple[DataFrame, Clusters]:
    """vec_id, cluster and distance (squared) of the vectors with `dims` finite components, and the clusters.

    Each of `rounds` rounds assigns all vectors to the nearest centroid (ties: the smaller number) and moves the
    centroids to the floor of their vectors' mean; then all are assigned once more. When no centroid moves any more the
    rounds left would change nothing and are not run. Components are floor(1024 * x), held to 2 ** 40 either way;
    distances beyond a long are given as the largest long. Null vec_ids are vectors like any other but never start a
    cluster while others are left; repeated rows count as often as they come. With fewer than k vectors there are as
    many clusters. An empty table gives an empty result. At most 65,536 clusters.
    """
    whole = whole_vectors(vectors, dims)
    start = first_centroids(whole, k, seed)
    now = Clusters(start, [True] * len(start), [[0] * dims for _ in start], [0] * len(start))
    if not start:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), now
    with _bucketed(blocks(whole, dims), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))) as packed:
        return _clustered(packed, now, rounds, dims)


def _clustered(packed: DataFrame, now: Clusters, rounds: int, dims: int) -> tuple[DataFrame, Clusters]:
    state = None
    for _ in range(rounds):
        state = _round(packed, state, now, dims)
        now = now.step(*_transfers(state, dims))
        if not any(now.moved):
            break
    if any(now.moved):
        state = _round(packed, state, now, dims)

    def spread(batches):
        for batch in batches:
            for r in batch.to_pylist():
                nulls = np.unpackbits(np.frombuffer(r["nulls"], np.uint8), count=r["n"]).astype(bool)
                ids = pa.array(np.frombuffer(r["ids"], "<i8"), pa.int64(), mask=nulls)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.frombuffer(r["owners"], "<u2").astype(np.int32)), pa.array(np.frombuffer(r["bars"], "<i8"), pa.int64())], ["vec_id", "cluster", "distance"])

    rows = packed.select("block", "n", "ids", "nulls").join(state.select("block", "owners", "bars"), "block")
    return cut(rows.mapInArrow(tidy(spread), "vec_id long, cluster int, distance long")), now


def op12_delta_lloyd(spark, sf_dir: str) -> DataFrame:
    rows, now = cluster(table(spark, sf_dir, "embeddings"))
    each = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(now.centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    per = each.join(named, "cluster").crossJoin(each.agg(F.sum("cluster_inertia").alias("inertia")))  # k rows by one row
    return rows.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op12_sql(k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> str:
    """The same rounds spelt out, one pair of tables for each."""
    nearest = """a{r} AS MATERIALIZED (SELECT i, x, vec_id, arg_min(k, d * 100 + k) AS k, min(d) AS d FROM (
       SELECT i, x, vec_id, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r}) GROUP BY ALL)"""
    nearest = nearest.replace("GROUP BY ALL", "GROUP BY i, x, vec_id")
    moved = """s{r} AS MATERIALIZED (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM (SELECT k, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {dims} + 1) t(j) GROUP BY k, j) GROUP BY k),
     c{n} AS MATERIALIZED (SELECT c.k, coalesce(s.c, c.c) AS c FROM c{r} c LEFT JOIN s{r} s USING (k))"""
    steps = [nearest.format(r=r) + ",\n     " + moved.format(r=r, n=r + 1, dims=dims) for r in range(rounds)]
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
       WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
     c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS k, x AS c FROM v WHERE vec_id IS NOT NULL QUALIFY k < {k}),
     {",".join(steps)},
     {nearest.format(r=rounds)}
SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)"""


OP12_SQL = _op12_sql()
