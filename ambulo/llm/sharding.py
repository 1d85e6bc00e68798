"""Operator 1, sharding by histogram sort, in DataFrame functions only.

Documents are ordered by (60 bits of the text's md5, doc_id), so that equal texts stand side by side. Splitters of
this order that give every shard the same number of bytes are found by counting: each round counts the exact bytes
and rows below the boundaries of a finer grid inside the intervals in which splitters still lie, until each splitter
is within tolerance or its interval holds one key. Only then do the documents move, in one exchange.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, crc32_sql, cut, table, text_or_empty, unused

H_BITS = 60
FIRST_BITS = 12
STEP_BITS = 8
#: Most splitters that a run looks for: bounds what is collected and broadcast (some 16 bytes each). 100 TB make pieces
#: of 0.5 GB, which a task sorts by spilling.
MAX_SPLITTERS = 200_000
MIN_LONG, MAX_LONG = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Splitter:
    """All keys from (h, d) on lie above it; bytes and rows count what lies below."""

    h: int
    d: int
    bytes: int
    rows: int


def text_key(text: Column) -> Column:
    """60 bits of the text's md5 as a non-negative long."""
    return F.conv(F.substring(F.md5(text), 1, H_BITS // 4), 16, 10).cast("long")


def _prefix(bits: int, d_bits: int) -> tuple[Column, Column]:
    """The first bits of the key (h, then the low d_bits of d)."""
    if bits <= H_BITS:
        return F.shiftright("_h", H_BITS - bits), F.lit(0).cast("long")
    return F.col("_h"), F.shiftright("_d", max(0, d_bits - (bits - H_BITS)))


def _floor_key(ph: int, pd: int, bits: int, d_bits: int) -> tuple[int, int]:
    """The least key with this prefix."""
    if bits <= H_BITS:
        return ph << (H_BITS - bits), MIN_LONG
    return ph, pd << max(0, d_bits - (bits - H_BITS))


def find_splitters(keys: DataFrame, n: int, tolerance: float = 0.0) -> tuple[list[Splitter], int, int]:
    """n - 1 splitters of keys(_h, _d, _size) into parts of equal bytes; total bytes; rounds taken.

    A splitter is done once its interval holds the rows of one _h alone and an edge is within tolerance (a share of a
    part's bytes) of its target, or once its interval holds a single key; then it is the nearer edge, the lower one on
    a tie. So a group of equal texts is parted only where keeping it together would cost more than the tolerance, and
    rows equal in text and doc_id never are. Cells are counted and summed up on the cluster; only the cells in which
    splitters lie come to the driver, one for each splitter at most.
    """
    ends = keys.agg(F.sum("_size"), F.count("_size"), F.max("_d")).first()
    total, d_bits = ends[0] or 0, max(1, int(ends[2] or 0).bit_length())
    if not total or n < 2:
        return [], total, 0
    slack = tolerance * total / n
    found: dict[int, Splitter] = {}
    #: Prefix of an interval in which splitters still lie -> bytes and rows below it.
    parents: dict[tuple[int, int], tuple[int, int]] = {(0, 0): (0, 0)}
    bits, rounds = 0, 0
    while parents:
        wider = bits + (STEP_BITS if bits else FIRST_BITS)
        if bits < H_BITS < wider:
            wider = H_BITS
        wider = min(wider, H_BITS + d_bits)
        (oh, od), (ph, pd) = (_prefix(bits, d_bits) if bits else (F.lit(0).cast("long"), F.lit(0).cast("long"))), _prefix(wider, d_bits)
        known = keys.sparkSession.createDataFrame([(*p, *v) for p, v in sorted(parents.items())], "oh long, od long, lower long, lower_rows long")
        rows = keys.select(oh.alias("oh"), od.alias("od"), ph.alias("ph"), pd.alias("pd"), "_h", "_d", "_size").join(F.broadcast(known), ["oh", "od"])  # MAX_SPLITTERS rows
        cells = rows.groupBy("oh", "od", "lower", "lower_rows", "ph", "pd").agg(
            F.sum("_size").alias("size"), F.count("_size").alias("count"), (F.min(F.struct("_h", "_d")) == F.max(F.struct("_h", "_d"))).alias("single"), (F.min("_h") == F.max("_h")).alias("group")
        )
        before = Window.partitionBy("oh", "od").orderBy("ph", "pd").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 ** FIRST_BITS cells
        upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
        summed = cells.withColumns({"below": F.col("lower") + upto("size"), "below_rows": F.col("lower_rows") + upto("count")}).withColumn("above", F.col("below") + F.col("size"))
        # Splitter i lies in the cell where below * n <= i * total < above * n.
        number = lambda c: F.expr(f"CAST((({c} * {n}BD) + {total - 1}BD) DIV {total}BD AS long)")
        wide = summed.withColumns({"b20": F.col("below").cast("decimal(20,0)"), "a20": F.col("above").cast("decimal(20,0)")})
        met = wide.select("ph", "pd", "below", "below_rows", "size", "count", "single", "group", F.greatest(F.lit(1), number("b20")).alias("lo"), F.least(F.lit(n), number("a20")).alias("hi")).where("lo < hi")
        rounds += 1
        parents = {}
        for c in met.collect():
            for i in range(c["lo"], c["hi"]):
                below, size = c["below"], c["size"]
                low, high = i * total - below * n, (below + size) * n - i * total  # both scaled by n
                if c["single"] or wider >= H_BITS + d_bits or bits < H_BITS and c["group"] and min(low, high) <= slack * n:
                    if low <= high:
                        found[i] = Splitter(*_floor_key(c["ph"], c["pd"], wider, d_bits), below, c["below_rows"])
                    else:
                        nxt = (c["ph"] + 1, 0) if wider <= H_BITS else (c["ph"], c["pd"] + 1)
                        found[i] = Splitter(*_floor_key(*nxt, wider, d_bits), below + size, c["below_rows"] + c["count"])
                else:
                    parents[c["ph"], c["pd"]] = (below, c["below_rows"])
        bits = wider
    return [found[i] for i in range(1, n)], total, rounds


def place_rows(keyed: DataFrame, splitters: list[Splitter], n: int) -> DataFrame:
    """keyed(_h, _d, ..) with _p, the part (0 to n - 1) of each row: how many splitters are not above its key.

    The first bits of a key give the part at which its bucket starts; the splitters inside a bucket are searched by
    halving.
    """
    buckets = _lookup(splitters, n)
    small = keyed.sparkSession.createDataFrame(buckets, "_b long, _base int, _cuts array<struct<h:long,d:long>>")
    key = F.struct(F.col("_h").alias("h"), F.col("_d").alias("d"))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, max(len(b[2]) for b in buckets).bit_length())))))
    inside = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get("_cuts", at + s - 1) <= key, at + s).otherwise(at))
    met = keyed.withColumn("_b", F.shiftright("_h", H_BITS - FIRST_BITS)).join(F.broadcast(small), "_b")  # 2 ** FIRST_BITS rows, MAX_SPLITTERS keys
    return met.withColumn("_p", (F.col("_base") + inside).cast("int")).drop("_b", "_base", "_cuts")


def shard_documents(docs: DataFrame, n_shards: int, tolerance: float = 0.01, piece_bytes: int = 16 << 20) -> DataFrame:
    """docs with size, shard and slot: n_shards runs of the key order with bytes as equal as whole documents allow.

    size: UTF-8 bytes of the text plus 16 (null: 16). slot: place in the shard, gapless from 0. A shard larger than
    piece_bytes is cut by further splitters into pieces that are sorted apart, so no task holds a shard; the counts
    of the splitters give each piece's first slot. Equal texts are neighbours; a group of them is parted only where a
    shard's bytes end and the group is larger than the tolerance. doc_ids are cast to long; null ones sort as 0; rows
    equal in text and doc_id stay in one shard. Null and empty texts are equal texts. Input columns named size, shard
    or slot are replaced, others pass through, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = text_or_empty()
    docs = docs.drop("size", "shard", "slot")
    names = {n: unused(docs, n) for n in ("row", "text")}
    # Columns travel inside one struct, so that their names cannot clash with those below.
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(names["row"]), F.col("doc_id").cast("long").alias("_id"), text.alias(names["text"]))
    keyed = held.select(names["row"], "_id", text_key(F.col(names["text"])).alias("_h"), F.coalesce("_id", F.lit(0)).bitwiseAND(MAX_LONG).alias("_d"), (F.octet_length(names["text"]).cast("long") + 16).alias("_size"))
    keys = cut(keyed.select("_h", "_d", "_size"))
    total = keys.agg(F.sum("_size")).first()[0] or 0
    pieces = max(1, min(-(-total // (n_shards * piece_bytes)), MAX_SPLITTERS // n_shards))
    splitters, _, _ = find_splitters(keys, n_shards * pieces, tolerance * pieces)
    starts = [0, *(s.rows for s in splitters)] if splitters else [0] * (n_shards * pieces)
    first = spark.createDataFrame([(p, starts[p] - starts[p - p % pieces]) for p in range(n_shards * pieces)], "_p int, _first long")
    placed = place_rows(keyed, splitters, n_shards * pieces).join(F.broadcast(first), "_p")  # MAX_SPLITTERS rows at most
    order = Window.partitionBy("_p").orderBy("_h", "_d", "_id", "_size")
    slot = F.row_number().over(order).cast("long") - 1 + F.col("_first")
    return placed.withColumn("slot", slot).select(f"{names['row']}.*", F.col("_size").alias("size"), F.expr(f"_p div {pieces}").cast("int").alias("shard"), "slot")


def _lookup(splitters: list[Splitter], n: int) -> list[tuple]:
    """For each bucket of the first bits: the part in which it starts, and the splitters inside it."""
    at = [(s.h, s.d) for s in splitters]
    out = []
    for b in range(1 << FIRST_BITS):
        lo, hi = b << (H_BITS - FIRST_BITS), (b + 1) << (H_BITS - FIRST_BITS)
        i, j = bisect_right(at, (lo, MIN_LONG)), bisect_right(at, (hi, MIN_LONG))
        out.append((b, i, at[i:j]))
    return out


def op1_histogram_sort(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    return out.select("doc_id", "size", F.crc32(text_or_empty()).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP1_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
     k AS (SELECT doc_id, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h, (coalesce(doc_id, 0) & 9223372036854775807) AS d,
             strlen(coalesce(text, ''))::BIGINT + 16 AS size, coalesce(text, '') AS text FROM documents),
     c AS (SELECT *, sum(size) OVER (ORDER BY h, d RANGE UNBOUNDED PRECEDING) AS upto,
             sum(size) OVER (PARTITION BY h, d) AS own, sum(size) OVER () AS total FROM k),
     g AS (SELECT *, max(upto) OVER (PARTITION BY h) AS g1, max(upto) OVER (PARTITION BY h) - sum(size) OVER (PARTITION BY h) AS g0 FROM c),
     s AS (SELECT *, len(list_filter(range(1, 40), lambda i: i * total < 40 * g0 OR i * total < 40 * g1 AND CASE
             WHEN least(i * total - 40 * g0, 40 * g1 - i * total) <= 0.01::DOUBLE * total AND (g1 - g0) > own THEN i * total - 40 * g0 <= 40 * g1 - i * total
             ELSE 2 * i * total <= 40 * (2 * upto - own) END))::INTEGER AS shard FROM g)
SELECT doc_id, size, {crc32_sql("text")} AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY h, d, doc_id, size) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s
"""
