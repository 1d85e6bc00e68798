"""Operator 2, near-duplicate detection by b-bit MinHash.

One pass over the texts gives each document its set of word shingles as a 128-bit digest, band keys of its MinHash
minima, and a signature of the low bits of all minima, packed. Documents with equal sets are one node. Nodes that share
a band key are candidates; the number of equal low bits, corrected for chance collisions, estimates their similarity
and drops what is far below the threshold; the rest is confirmed on the full sets. Links make components.

Within a band bucket only components matter, and no bucket is paired out. Every bucket links its members to a pivot,
the member that lies in the largest buckets. Then, for members A and B with the differences D(A), D(B) from a pivot P
(what one has and the other lacks), |A & B| follows from the sizes and from |D(A) & D(B)| alone; and if A is not linked
with P, a link of A with B needs an overlap of the differences that grows with both. So what is still apart after the
pivots meets only over the rarest items of its differences (a prefix join), which edits of a document's own never
share. This is exact: no member, bucket or pair is dropped, and a group of copies costs rows in proportion to its size.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, portions, table, tidy, unused, utf8

HASHES, ROWS, BITS = 128, 4, 4
BANDS = HASHES // ROWS
PACKED = HASHES * BITS // 64
#: Candidates whose estimate is so far below the threshold go no further: seven standard deviations at 128 hashes.
SLACK = 0.25
#: Further pivots are tried while each settles at least this share of the members that are still apart.
WORTH = 0.1
#: Ids are broadcast while they take up to so many bytes (ID_BYTES each); beyond that they are joined by shuffles.
BROADCAST_BYTES, ID_BYTES = 16 << 20, 16
#: Bytes of text that a worker hashes at once.
PORTION = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(1)
def _factors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers and addends of the hash functions, and a random value of each byte."""
    r = np.random.default_rng(20)
    draw = lambda n: r.integers(0, 1 << 63, n, np.uint64)
    return draw(HASHES) * np.uint64(2) + np.uint64(1), draw(HASHES), draw(256) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number, for words of up to n bytes."""
    out = np.full(n, _GOLDEN, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in texts (UTF-8 bytes and their offsets), and the words in each text.

    Words are runs without ASCII white space, A-Z lower-cased.
    """
    blank = _BLANK[data]
    first = ~blank
    first[1:] &= blank[:-1]
    inner = offsets[:-1][(offsets[:-1] < len(data)) & (offsets[:-1] < offsets[1:])]
    first[inner] = ~blank[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    at = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    at[blank[starts[0] :]] = 0
    with np.errstate(over="ignore"):
        value = _factors()[2][_LOWER[data[starts[0] :]]] * _powers(int(at.max()) + 1)[at]
        value[blank[starts[0] :]] = 0
        hashes = _mix(np.add.reduceat(value, starts - starts[0]))
    return hashes, np.diff(np.searchsorted(starts, offsets))


def _pieces(data: np.ndarray):
    """A long text in parts of about PORTION bytes that end at white space."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PORTION)
        if end < len(data):
            stops = np.flatnonzero(_BLANK[data[at:end]])
            while not len(stops) and end < len(data):  # one long word
                lo, end = end, min(len(data), end + PORTION)
                stops = np.flatnonzero(_BLANK[data[lo:end]]) + (lo - at)
            end = at + int(stops[-1]) + 1 if len(stops) and end < len(data) else end
        yield data[at:end]
        at = end


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words_each: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles.

    A text with fewer words than a shingle has one, the whole sequence; one without words has none.
    """
    if len(offsets) == 2 and len(data) > PORTION:
        found = [_word_hashes(p, np.array([0, len(p)]))[0] for p in _pieces(data)]
        h = np.concatenate(found)
        words = np.array([len(h)])
    else:
        h, words = _word_hashes(data, offsets)
    ends = np.cumsum(words)

    def chain(lo: int, hi: int, n: int) -> np.ndarray:
        s = np.full(max(0, hi - lo - n + 1), n, np.uint64)
        for i in range(n):
            s = _mix(s * _GOLDEN + h[lo + i : lo + i + len(s)])
        return s

    out = []
    with np.errstate(over="ignore"):
        whole = chain(0, len(h), words_each)  # those across texts are left out below
        for end, n in zip(ends.tolist(), words.tolist(), strict=True):
            lo = end - n
            out.append(np.unique(whole[lo : end - words_each + 1]) if n >= words_each else chain(lo, end, n) if n else whole[:0])
    return out


def shingle_set(text: str | None, words_each: int) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    return shingle_sets(data, np.array([0, len(data)]), words_each)[0]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row of minima for each set, none of which is empty."""
    a, b, _ = _factors()
    low = np.empty((len(sets), HASHES), np.uint64)
    if not sets:
        return low
    items = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            low[:, k] = np.minimum.reduceat(items * a[k] + b[k], starts)
    return low >> np.uint64(16)  # the high bits of multiply-shift


def band_keys(low: np.ndarray) -> np.ndarray:
    """A row of band keys for each row of minima."""
    rows = low.reshape(len(low), BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
        for i in range(ROWS):
            key = _mix(key * _GOLDEN + rows[:, :, i])
    return key.view(np.int64)


def pack(low: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima in each row, packed into longs."""
    lanes = (low & np.uint64((1 << BITS) - 1)).reshape(len(low), PACKED, 64 // BITS)
    return np.bitwise_or.reduce(lanes << np.arange(0, 64, BITS, dtype=np.uint64), axis=2).view(np.int64)


def _lists(values: list[np.ndarray] | np.ndarray, lengths) -> pa.ListArray:
    flat = np.concatenate(values) if len(values) else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat.view(np.int64)))


def _digest(items: np.ndarray) -> bytes | None:
    import hashlib

    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def _signatures(words_each: int):
    def run(batches):
        for part in portions(batches, most=PORTION):
            sets = shingle_sets(*utf8(part.column("text")), words_each)
            some = np.array([len(s) > 0 for s in sets])
            low = minima([s for s in sets if len(s)])
            columns = [part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_digest, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, _lists(band_keys(low), some * BANDS), _lists(pack(low), some * PACKED)], ["doc_id", "text_key", "n", "set", "bands", "sig"])

    return run


def _sets(words_each: int):
    def run(batches):
        for part in portions(batches, most=PORTION):
            sets = shingle_sets(*utf8(part.column("text")), words_each)
            yield pa.RecordBatch.from_arrays([pa.array(map(_digest, sets), pa.binary()), _lists(sets, [len(s) for s in sets])], ["set", "items"])

    return run


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of the nodes of edges(a, b), distinct and a < b.

    Each round every node joins the neighbour of the least random rank, if that is below its own, and the edges between
    different labels go on as a smaller graph; so a chain of n nodes takes about log n rounds and a star two. Labels
    and edges stay distributed and are checkpointed each round.
    """
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(7)).alias("rank"), F.col(c).alias("id"))
    left, names = edges, None
    while True:
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(rank("b")).alias("near"))
        labels = cut(near.select(F.col("a").alias("node"), F.least("near", rank("a"))["id"].alias("label")))
        if names is None:
            names = labels
        else:
            names = names.join(labels.toDF("_n", "_l"), F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label"))
        named = left.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").where("la <> lb")
        left = cut(named.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
        if left.isEmpty():
            break
    names = cut(names)
    least = names.groupBy("label").agg(F.min("node").alias("component"))
    return cut(names.join(least, "label").select("node", "component"))


def _estimate(a: str, b: str):
    """Similarity by counting equal lanes of two packed signatures, corrected for lanes that collide by chance."""
    ones = int("1" * (64 // BITS), 16)
    unequal = F.lit(0)
    for i in range(PACKED):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        folded = x
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, k))
        unequal = unequal + F.bit_count(folded.bitwiseAND(F.lit(ones)))
    by_chance = 2.0**-BITS
    return ((1 - unequal / F.lit(float(HASHES))) - by_chance) / (1 - by_chance)


class _Linker:
    """Finds links among nodes; a node is the digest of a shingle set. Frames that it keeps are tables."""

    def __init__(self, docs: DataFrame, heads: DataFrame, words_each: int, percent: int):
        self.docs, self.heads, self.words_each, self.percent = docs, heads, words_each, percent
        self.links: list[DataFrame] = []
        self.tried: DataFrame | None = None

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """set, items of the nodes: the texts of their first documents are cut into shingles again."""
        ids = cut(self.heads.join(nodes, "set", "left_semi").select(F.col("doc_id").alias("id")).distinct())
        wanted = F.broadcast(ids) if ids.count() * ID_BYTES <= BROADCAST_BYTES else ids
        texts = self.docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("id"), "left_semi")
        return cut(texts.select("text").mapInArrow(tidy(_sets(self.words_each)), "set binary, items array<long>").dropDuplicates(["set"]))

    def link(self, pairs: DataFrame) -> bool:
        """Links those of pairs(a, b) that are near; whether there are any new ones. Each pair is met once."""
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        at = lambda c: self.heads.select(F.col("set").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
        t = self.percent / 100
        size = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent
        near = cut(pairs.join(at("b"), "b").join(at("a"), "a").where(size & (_estimate("sa", "sb") >= t - SLACK)).select("a", "b"))
        self.tried = near if self.tried is None else self.tried.unionByName(near)
        sets = self.sets_of(near.select(F.col("a").alias("set")).union(near.select("b")))
        items = lambda c: sets.select(F.col("set").alias(c), F.col("items").alias(f"i{c}"))
        shared = F.size(F.array_intersect("ia", "ib"))
        found = cut(near.join(items("b"), "b").join(items("a"), "a").where(100 * shared >= self.percent * (F.size("ia") + F.size("ib") - shared)).select("a", "b"))
        self.links.append(found)
        return not found.isEmpty()

    def labels(self) -> DataFrame:
        return connected_components(reduce(DataFrame.unionByName, self.links))

    def across(self, apart: DataFrame) -> DataFrame:
        """Pairs (a, b) of members of one bucket in apart(key, set, p, label) with different labels that may be linked.

        Buckets whose pivots lie in one component are met together, by the pivot p of most members; it need not lie in
        each bucket. For h items of p that A lacks and e items that p lacks, let w(A) = 100 h + percent e. A and B are linked if
        and only if (100 + percent) |D(A) & D(B)| >= w(A) + w(B) - (100 - percent) |p|, and A is linked with p if and
        only if w(A) <= (100 - percent) |p|. So for A outside the pivot's component the overlap is above
        w(B) / (100 + percent), and as w(B) >= percent |D(B)|, at least (w(A) - (100 - percent) |p|) / 100. Sets with an
        overlap of s share one of the |D| - s + 1 rarest items of each, and after the first such item no more than
        what follows it.
        """
        t = self.percent
        named = cut(apart.join(apart.where("set = p").select("key", F.col("label").alias("main")), "key"))
        centres = cut(named.groupBy("main", "p").count().groupBy("main").agg(F.max(F.struct("count", "p"))["p"].alias("centre")))
        small = F.broadcast(centres) if centres.count() * 4 * ID_BYTES <= BROADCAST_BYTES else centres
        members = cut(named.join(small, "main").select(F.col("centre").alias("p"), "set", "label", "main").distinct())
        sets = self.sets_of(members.select("set").union(members.select("p")).distinct())
        both = members.where("set <> p").join(sets, "set").join(sets.toDF("p", "base"), "p")
        less, more = F.array_except("base", "items"), F.array_except("items", "base")
        diffs = cut(both.select("p", "set", "label", "main", F.size("base").alias("pn"), (100 * F.size(less) + t * F.size(more)).alias("w"), F.concat(less, more).alias("delta")))
        items = diffs.select("p", "set", "label", F.explode("delta").alias("item"))
        counted = items.groupBy("p", "item").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        placed = items.join(counted, ["p", "item"]).select("p", "set", F.struct("c", "item", (F.col("lo") < F.col("hi")).alias("mixed")).alias("i"))
        ordered = placed.groupBy("p", "set").agg(F.sort_array(F.collect_list("i")).alias("order"))
        rows = cut(diffs.drop("delta").join(ordered, ["p", "set"]).withColumn("d", F.size("order")))
        outside = rows.where("label <> main").withColumn("reach", F.col("d") - F.greatest(F.lit(1), F.ceil((F.col("w") - (100 - t) * F.col("pn")) / 100)) + 1)
        anyone = rows.withColumn("reach", F.col("d") - F.floor(F.col("w") / (100 + t)))
        spread = lambda df: df.select("p", "set", "label", "main", "pn", "w", "d", F.posexplode(F.slice("order", F.lit(1), F.greatest(F.lit(0), F.col("reach")).cast("int"))).alias("pos", "i")).where("i.mixed").select("*", "i.item")
        on = f"""x.p = y.p AND x.item = y.item AND x.label <> y.label AND (y.label = y.main OR x.set < y.set)
                 AND x.w + y.w - {100 - t} * x.pn <= {100 + t} * least(x.d - x.pos, y.d - y.pos)"""
        return spread(outside).alias("x").join(spread(anyone).alias("y"), F.expr(on)).select(F.col("x.set").alias("a"), F.col("y.set").alias("b"))


def _classified(docs: DataFrame, words_each: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id of every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    signed = cut(keyed.mapInArrow(tidy(_signatures(words_each)), "doc_id long, text_key long, n long, set binary, bands array<long>, sig array<long>"))
    usable = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("set").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    repeated = cut(classes.where("copies > 1").select("set", "rep"))
    firsts = usable.join(repeated, "set").where("doc_id = rep").drop("rep").dropDuplicates(["set"])
    heads = usable.join(repeated, "set", "left_anti").unionByName(firsts)
    heads = cut(heads.select("set", "doc_id", "n", "sig"))
    # Of equal sets the head's bands; a head's repeated rows change nothing.
    rows = usable.join(repeated, "set", "left").where("rep IS NULL OR rep = doc_id").select("set", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = cut(rows.join(buckets, "key"))
    scores = members.groupBy("set").agg(F.sum("m").alias("score"))
    scored = members.join(scores, "set")
    pivots = scored.groupBy("key").agg(F.max(F.struct("score", "set"))["set"].alias("p"))
    members = cut(members.join(pivots, "key").select("key", "set", "p"))

    linker = _Linker(docs, heads, words_each, percent)
    linker.link(members.select(F.col("p").alias("a"), F.col("set").alias("b")))
    labels, before, tries = linker.labels(), None, 0
    while True:
        apart = _apart(members, labels)
        n = apart.count()
        if not n:
            break
        if before is None or n <= (1 - WORTH) * before:
            # Another pivot for each bucket, at random among the members outside the component of the first.
            before, tries = n, tries + 1
            first = apart.where("set = p").select("key", F.col("label").alias("main"))
            other = apart.join(first, "key").where("label <> main").groupBy("key").agg(F.min_by(F.struct("set", "label"), F.xxhash64("set", F.lit(tries))).alias("q"))
            fresh = linker.link(apart.join(other, "key").where("label <> q.label").select(F.col("q.set").alias("a"), F.col("set").alias("b")))
            if fresh:
                labels = linker.labels()
                continue
        if linker.link(linker.across(apart)):
            labels = linker.labels()
        break

    owners = labels.join(heads.select(F.col("set").alias("node"), "doc_id"), "node")
    least = owners.groupBy("component").agg(F.min("doc_id").alias("least"))
    found = cut(owners.join(least, "component").select(F.col("node").alias("set"), "least"))
    known = signed.select("doc_id", "text_key", "n", "set").join(repeated, "set", "left").join(found, "set", "left")
    return known.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "rep", "doc_id")).alias("component_id"))


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with labels, of the buckets that hold more than one component."""
    named = cut(members.join(labels.toDF("set", "label"), "set", "left").withColumn("label", F.coalesce("label", "set")))
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return cut(named.join(mixed, "key"))


def near_duplicates(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their shingle sets A, B. component_id: smallest
    doc_id reachable over links, itself included; kept: it is the smallest. doc_ids are cast to long.

    Documents without words (null, empty) are linked with nothing. Each row goes by its own text, so rows of one doc_id
    with different texts may lie in different components, and repeated rows get equal results. Rows with null doc_id
    keep component_id null and kept true. Very long texts are hashed in parts. Equal sets are one node, whatever their
    number. Other columns are not read. An empty table gives an empty result.

    With 32 bands of 4 rows a pair at 0.8 shares no band once in 2e7.
    """
    out = _classified(docs, words_each, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_minhash_bbit(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words_each=2, percent=80)


def keep_one_of_each(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """docs without the near duplicates of a document with a smaller doc_id (pipeline stage).

    Rows of the smallest doc_id of a component stay, repeated ones too; rows without words or with null doc_id stay.
    Of two texts under one doc_id each goes by itself. Columns pass through, whatever their names.
    """
    gone = _classified(docs, words_each, percent).where("doc_id <> component_id").select("doc_id", "text_key").distinct()
    i, k = unused(docs, "id"), unused(docs, "key")
    gone = gone.toDF(i, k)
    return docs.join(gone, (docs["doc_id"].cast("long") == gone[i]) & (F.xxhash64(docs["text"].cast("string")) == gone[k]), "left_anti")


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower_ascii, '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
     g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
             ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
     s AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id
             AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
             GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
     e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
     r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
     c AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a)
SELECT g.doc_id, len(g.g)::BIGINT AS n_shingles, coalesce(c.component_id, g.doc_id) AS component_id,
       g.doc_id = coalesce(c.component_id, g.doc_id) AS kept FROM g LEFT JOIN c ON g.doc_id = c.a
"""
