"""Operator 13, the prefix trie of conversations, by mergeable partial tries.

Every conversation is rebuilt as its family's head and its own tail. A node of the trie is a prefix, named by 128 bits:
the exclusive or of a hash of each (position, turn) in it, so prefixes of any length come from running totals of bounded
pieces. Partitions combine their nodes before they send them, and the partial tables are merged by hash of the node in
rounds of FAN. For the rollup the trie is cut into chains: a node belongs to the deepest of its members, so that each
chain is the lower part of one conversation's path. Chains without open branches hand their totals up, round by round,
and running totals along each chain give every node its subtree.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, crc32_sql, cut, salted_join, table, tidy

#: Conversations of one hundred share the head of the first of them, of up to HEAD turns.
FAMILY, HEAD = 100, 5
#: Turns of one conversation that one window sorts; partial tables merged into one; ids in a piece of an end list (2 ** n).
CHUNK, FAN, ENDS = 4096, 64, 13


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text) and n_chars (code points of the text); texts go no further."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("n_chars"))


def numbered(turns: DataFrame) -> DataFrame:
    """turns with pos, from 1 in each conversation by turn (null first), then digest.

    The rows are parted by ranges, which may cut a conversation; ranks inside a range are raised by what its earlier
    ranges hold. At most one conversation goes on across each border, so there are fewer such numbers than ranges.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    ranged = cut(turns.repartitionByRange(F.col("conv_id"), *order).withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    held = ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("held"))
    later = held.withColumn("before", F.sum("held").over(before)).where("before > 0").select("conv_id", "range", "before")
    own = ranged.withColumn("own", F.row_number().over(Window.partitionBy("range", "conv_id").orderBy(*order)).cast("long"))
    placed = own.join(F.broadcast(later), ["conv_id", "range"], "left")
    return placed.select("conv_id", (F.col("own") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "n_chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, digest, n_chars, total) of the rebuilt conversations, and (conv_id, total) of all of them."""
    placed = cut(numbered(turns))
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") <= HEAD)).withColumnRenamed("conv_id", "first")
    lent = F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)
    convs = placed.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumns({"first": first, "lent": lent})
    convs = convs.join(heads.groupBy("first").agg(F.max("pos").alias("there")), "first", "left")
    taken = F.least("lent", F.coalesce("there", F.lit(0)))
    convs = cut(convs.select("conv_id", "first", "lent", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("lent"), F.lit(0))).alias("total")))
    # A family has FAMILY members at most, each of which takes HEAD turns at most.
    head = convs.where("taken > 0").join(heads, "first").where("pos <= taken").select("conv_id", "pos", "digest", "n_chars", "total")
    tail = placed.join(convs, "conv_id").where("pos > lent").select("conv_id", (F.col("pos") - F.col("lent") + F.col("taken")).alias("pos"), "digest", "n_chars", "total")
    return head.unionByName(tail), convs.select("conv_id", "total")


def running(df: DataFrame, key: str, pos: str, values: dict[str, Column], total, down: bool = False) -> DataFrame:
    """df with running totals (name -> aggregate `total` of a column) of each key by pos, ascending or `down`.

    Pieces of CHUNK positions are sorted by themselves; what the earlier pieces of a key hold is added. df keeps a
    column `chunk`.
    """
    df = df.withColumn("chunk", F.floor(F.col(pos) / CHUNK))
    way = (lambda c: F.desc(c)) if down else F.asc
    inside = Window.partitionBy(key, "chunk").orderBy(way(pos)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy(way("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    # Keys within one piece have nothing to add; only the others come to the second table.
    long = df.groupBy(key, "chunk").agg(*(total(v).alias(f"_{n}") for n, v in values.items()), F.count(F.lit(1)).alias("_n"))
    held = long.select(key, "chunk", *(total(F.col(f"_{n}")).over(earlier).alias(f"_{n}") for n in values)).where(" OR ".join(f"_{n} IS NOT NULL" for n in values))
    out = df.withColumns({n: total(v).over(inside) for n, v in values.items()}).join(held, [key, "chunk"], "left")
    join = (lambda a, b: a.bitwiseXOR(b)) if total is F.bit_xor else (lambda a, b: a + b)
    return out.withColumns({n: join(F.col(n), F.coalesce(f"_{n}", F.lit(0).cast("long"))) for n in values}).drop(*(f"_{n}" for n in values))


def _merged(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each node of partial rows: members summed, the smallest and the deepest of them kept."""
    return rows.groupBy(*by).agg(
        *(F.max(c).alias(c) for c in ("depth", "up1", "up2", "n_chars", "deepest")), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs")
    )


def trie(turns: DataFrame, convs: DataFrame, partials: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of rebuilt conversations, and (node, conv_id) of those that end there.

    Nodes: key1, key2, up1, up2 (the parent's key), depth, n_chars (of the last text), conv_id (smallest member),
    n_convs, deepest (total and complement of the deepest member, the smallest of such).
    """
    hashed = turns.withColumns({"one": F.xxhash64("pos", "digest"), "two": F.xxhash64("digest", "pos", F.lit(13))})
    paths = running(hashed, "conv_id", "pos", {"key1": F.col("one"), "key2": F.col("two")}, F.bit_xor)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    rows = paths.select("conv_id", "total", F.col("pos").alias("depth"), "n_chars", "key1", "key2", F.col("key1").bitwiseXOR(F.col("one")).alias("up1"), F.col("key2").bitwiseXOR(F.col("two")).alias("up2"))
    roots = convs.select("conv_id", "total", zero.alias("depth"), zero.alias("n_chars"), zero.alias("key1"), zero.alias("key2"), none.alias("up1"), none.alias("up2"))
    rows = cut(rows.unionByName(roots))
    deepest = F.struct("total", F.bitwise_not("conv_id").alias("but"))
    nodes = rows.select("*", deepest.alias("deepest"), F.lit(1).cast("long").alias("n_convs"), F.spark_partition_id().alias("part"))
    while True:
        nodes = _merged(nodes.withColumn("part", F.floor(F.col("part") / FAN)), ["key1", "key2", "part"])
        partials = -(-partials // FAN)
        if partials <= 1:
            break
    return _merged(nodes, ["key1", "key2"]), rows.where("depth = total").select("key1", "key2", "conv_id")


def end_digests(ends: DataFrame) -> DataFrame:
    """key1, key2 and the SHA-256 of the ascending, comma-joined decimal conv_ids that end there.

    Lists are joined in pieces by ranges of conv_id, and a task reads a node's pieces in order, one at a time.
    """
    piece = F.shiftright("conv_id", ENDS)
    listed = ends.groupBy("key1", "key2", piece.alias("piece")).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids"))
    rows = listed.repartition("key1", "key2").sortWithinPartitions("key1", "key2", "piece").select("key1", "key2", "ids")

    def run(batches):
        key, sha = None, None
        for batch in batches:
            out = []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("key1", "key2", "ids")), strict=True):
                if (k1, k2) == key:
                    sha.update(b"," + ids.encode())
                    continue
                if key:
                    out.append((*key, sha.hexdigest()))
                key, sha = (k1, k2), hashlib.sha256(ids.encode())
            yield _digest_rows(out)
        if key:
            yield _digest_rows([(*key, sha.hexdigest())])

    return rows.mapInArrow(tidy(run), "key1 long, key2 long, ends_sha256 string")


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = {"key1": pa.int64(), "key2": pa.int64(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_pydict({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds.items())})


def _rolled_up(chains: DataFrame) -> DataFrame:
    """chains with saved and leaves of all that hangs below them added; rows of rep, over (null: the root's), saved, leaves.

    Each round takes the chains under which nothing is open, and hands their totals to the chains that they hang on.
    There are at most as many rounds as chains on a way down, each shorter than the rest of the one that it leaves.
    """
    branches = chains.where("over IS NOT NULL").groupBy(F.col("over").alias("rep")).agg(F.count(F.lit(1)).alias("open"))
    waiting, done = cut(chains.join(branches, "rep", "left").fillna(0, "open")), None
    while waiting.count():
        ready = waiting.where("open = 0").drop("open")
        done = ready if done is None else done.unionByName(ready)
        given = ready.where("over IS NOT NULL").groupBy(F.col("over").alias("rep")).agg(F.sum("saved").alias("_saved"), F.sum("leaves").alias("_leaves"), F.count(F.lit(1)).alias("_ready"))
        rest = waiting.where("open > 0").join(given, "rep", "left").fillna(0, ["_saved", "_leaves", "_ready"])
        waiting = cut(rest.withColumns({"saved": F.col("saved") + F.col("_saved"), "leaves": F.col("leaves") + F.col("_leaves"), "open": F.col("open") - F.col("_ready")}).drop("_saved", "_leaves", "_ready"))
    return chains if done is None else done


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations of (conv_id, turn, role, text).

    conv_id (smallest member), depth, parent_conv_id (null: root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Null roles and texts are empty ones; null turns come first; turns of one number stand by a digest of
    role and text, so repeated rows are turns like any other. Rows without a conv_id are in no conversation. Other
    columns are not looked at. An empty table has no conversation, and no root.
    """
    spark = conversations.sparkSession
    turns, convs = rebuilt(digests(conversations))
    nodes, ends = trie(turns, convs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = (F.col("n_convs") - 1) * F.col("n_chars")
    nodes = cut(nodes.select("key1", "key2", "up1", "up2", "depth", "conv_id", "n_convs", own.alias("saved"), F.bitwise_not("deepest.but").alias("rep"), F.col("deepest.total").alias("total")))
    # Chains: the top of each and where it hangs. Many may hang on one node, so they are salted.
    tops = nodes.groupBy("rep").agg(F.min(F.struct("depth", "up1", "up2")).alias("top"), F.sum("saved").alias("saved"))
    tops = cut(tops.select("rep", "top.*", "saved", F.lit(1).cast("long").alias("leaves")))
    hung = tops.where("depth > 0")
    places = nodes.select(F.col("key1").alias("up1"), F.col("key2").alias("up2"), F.col("rep").alias("over"), F.col("conv_id").alias("over_conv"))
    hung = salted_join(hung, places, ["up1", "up2"], hung.groupBy("up1", "up2").count(), hung.count(), F.col("rep"))
    chains = cut(hung.unionByName(tops.where("depth = 0").withColumns({"over": F.lit(None).cast("long"), "over_conv": F.lit(None).cast("long")})))
    rolled = _rolled_up(chains)
    hanging = rolled.where("over IS NOT NULL").groupBy(F.col("up1").alias("key1"), F.col("up2").alias("key2")).agg(F.count(F.lit(1)).alias("branches"), F.sum("saved").alias("_saved"), F.sum("leaves").alias("_leaves"))
    full = nodes.join(hanging, ["key1", "key2"], "left").fillna(0, ["branches", "_saved", "_leaves"]).join(end_digests(ends), ["key1", "key2"], "left")
    summed = running(full, "rep", "depth", {"saved_tokens": F.col("saved") + F.col("_saved"), "below": F.col("_leaves")}, F.sum, down=True)
    # The parent's conv_id stands one step up the chain; at the top of a piece or of the chain it comes from a table.
    above = F.lag("conv_id").over(Window.partitionBy("rep", "chunk").orderBy("depth"))
    step = nodes.where((F.col("depth") + 1) % CHUNK == 0).select("rep", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("over_conv"))
    edges = chains.select("rep", "depth", "over_conv").unionByName(step.join(chains.select("rep", "depth"), ["rep", "depth"], "left_anti"))
    out = summed.withColumn("above", above).join(edges, ["rep", "depth"], "left")
    return out.select(
        "conv_id", "depth", F.coalesce("above", "over_conv").alias("parent_conv_id"), "n_convs", (F.col("branches") + (F.col("depth") < F.col("total")).cast("long")).alias("n_children"),
        (F.col("below") + 1).alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = f"""WITH RECURSIVE {CRC_TABLE_SQL},
     t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
     c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
     l AS (SELECT conv_id, turns, {crc32_sql("conv_id::VARCHAR")} % {HEAD + 1} AS h FROM c),
     r AS MATERIALIZED (SELECT l.conv_id, coalesce(b.turns[1:h], []) || l.turns[h + 1:] AS seq FROM l LEFT JOIN c b ON b.conv_id = l.conv_id - l.conv_id % {FAMILY}),
     p AS (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS depth FROM r),
     n AS MATERIALIZED (SELECT seq[1:depth] AS key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(length(any_value(seq[depth].text)), 0) AS saved,
          sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(seq) = depth), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
     kids AS (SELECT key[1:depth - 1] AS key, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
     f AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (key, depth)),
     a AS (SELECT key[1:d] AS key, d AS depth, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(depth + 1)) AS d FROM f) GROUP BY 1, 2)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, a.n_leaves, a.saved_tokens, f.ends_sha256
FROM f JOIN a USING (key, depth) LEFT JOIN n u ON u.depth = f.depth - 1 AND u.key = f.key[1:f.depth - 1]"""
