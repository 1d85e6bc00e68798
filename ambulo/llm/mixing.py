"""Operator 4, mixing sources to target weights.

Every document gets a hash-random key. Keys are range-sorted within their source in buckets of the key's leading bits
(uniform, so a hot source is many even buckets), words are summed by bucket, prefix sums over the buckets and within
each bucket give the words before every document, and the order is cut at the source's exact budget. Budgets above a
source's size repeat it in whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table, word_count

WEIGHTS = (5, 2, 1)
#: A source's budget stops at so many times its size.
MOST_EPOCHS = 3
KEY_BITS = 60
#: Documents that a bucket of the range sort holds on average.
BUCKET_ROWS = 4096
#: Up to so many sources are broadcast; more are joined.
BROADCAST_SOURCES = 100_000
SEED = "mix"


def mix_key(doc_id: Column, seed: str = SEED) -> Column:
    """60 hash-random bits of a document's id."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string")))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_budgets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """sizes(source, n, size) of all sources, with target (double) and budget (long).

    Weights go round by the source's code points, null last. A target is its share of all words by weight, but at
    most `most` times the source's size; the excess is shared again by weight until no target is above. As the
    sources that stop are those with the least size for their weight, one pass in that order finds them all. The
    windows run over one row for each source.
    """
    by_name, by_need = Window.orderBy(F.col("source").isNull(), "source"), Window.orderBy(F.col("size") / F.col("w"), "rank")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    big = lambda c: c.cast("decimal(30,0)")
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    left = ranked.withColumn("w", w.cast("long")).withColumns({
        "words": F.sum("size").over(everywhere) - most * F.coalesce(F.sum("size").over(before), F.lit(0)),
        "weight": F.sum("w").over(everywhere) - F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    stops = left.withColumn("stops", big(most * F.col("size")) * F.col("weight") <= big(F.col("words")) * F.col("w"))
    # The first source that does not stop has the words and the weight that all later ones share.
    at = F.min(F.when(~F.col("stops"), F.struct(F.col("size") / F.col("w"), "rank", "words", "weight"))).over(everywhere)
    target = F.when(F.col("stops"), (most * F.col("size")).cast("double")).otherwise(at["words"].cast("double") / at["weight"] * F.col("w"))
    return stops.withColumn("target", target).select("source", "n", F.col("size").alias("source_size"), "target", F.floor(F.col("target") + 0.5).cast("long").alias("budget"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, _key, _before, _rest of every document.

    size: words (null text: 0). taken: words that the mix takes, repeats counted: whole epochs plus the words of the
    last, partial epoch up to the exact budget, so one document of a source may be taken in part. copies: epochs that
    have the document at least in part; documents without words cost nothing and come with their neighbours, those
    of a source without words once. Rows equal in doc_id are ordered by size; equal rows are interchangeable. An
    empty table gives an empty result.
    """
    keys = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size")).withColumn("_key", mix_key(F.col("doc_id"), seed)))
    budgets = cut(source_budgets(keys.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), weights, most))
    # The key's leading bits, so many that a bucket has about BUCKET_ROWS documents.
    shift = F.lit(KEY_BITS) - F.ceil(F.greatest(F.lit(0.0), F.log2(F.col("n") / BUCKET_ROWS))).cast("int")
    known = budgets.withColumn("_shift", shift)
    name = lambda c: F.struct(F.coalesce(c, F.lit("")), c.isNull())
    known = known.withColumn("_s", name(F.col("source"))).drop("source")
    known = F.broadcast(known) if known.count() <= BROADCAST_SOURCES else known
    rows = keys.withColumn("_s", name(F.col("source"))).join(known, "_s")
    rows = rows.withColumn("_bucket", F.expr("shiftright(_key, _shift)")).repartition("_s", "_bucket")
    sums = rows.groupBy("_s", "_bucket").agg(F.sum("size").alias("_sum"))
    ordered = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_s", "_bucket", F.coalesce(F.sum("_sum").over(ordered), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_s", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, ["_s", "_bucket"]).withColumn("_before", F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.expr("budget div nullif(source_size, 0)")).otherwise(F.lit(0))
    rest = F.col("budget") - F.col("_whole") * F.col("source_size")
    out = placed.withColumn("_whole", whole).withColumn("_rest", rest)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before")))
    copies = F.when(F.col("source_size") == 0, F.lit(1)).otherwise(F.col("_whole") + (F.col("_before") < F.col("_rest")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("_whole") * F.col("size") + part).alias("taken"), copies.cast("int").alias("copies"), "_key", "_before", "_rest", "_whole")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs as the mix has them: each row so many times as epochs have it, whole.

    From the plan only each source's last key is joined to the documents, one row for each source; the texts are not
    moved. Rows with the key of a cut (equal in doc_id and size) share its lot. Null is a source like any other; null
    doc_ids have one key; null and empty texts cost nothing and come with their neighbours. Columns pass through,
    whatever their names. An empty table gives an empty result.
    """
    plan = mix_plan(docs, weights, most, seed)
    last = F.max(F.when(F.col("_before") < F.col("_rest"), F.struct("_key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "size")))
    cuts = cut(plan.groupBy("source").agg(last.alias("_last"), F.max("_whole").alias("_whole"), F.max("source_size").alias("_words")))
    mark = F.struct(mix_key(F.col("doc_id"), seed).alias("_key"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), word_count(F.col("text").cast("string")).alias("size"))
    joined = docs.alias("d").join(cuts.alias("c"), F.col("d.source").cast("string").eqNullSafe(F.col("c.source")))
    copies = F.when(F.col("c._words") == 0, F.lit(1)).otherwise(F.col("c._whole") + F.coalesce(mark <= F.col("c._last"), F.lit(False)).cast("long"))
    times = joined.select(F.struct("d.*").alias("_row"), F.array_repeat(F.lit(0), copies.cast("int")).alias("_times"))
    return times.select("_row", F.explode("_times")).select("_row.*")


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             ('0x' || substr(md5(concat_ws(':', 'mix', doc_id::VARCHAR)), 1, 15))::BIGINT AS k FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM d GROUP BY source),
     w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
     o AS (SELECT *, sum(size) OVER () - 3 * coalesce(sum(size) OVER p, 0) AS words, sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS weight
             FROM w WINDOW p AS (ORDER BY size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     f AS (SELECT *, 3 * size * weight <= words * w AS stops FROM o),
     a AS (SELECT words, weight FROM f WHERE NOT stops ORDER BY size / w, rank LIMIT 1),
     b AS (SELECT source, size AS source_size, CASE WHEN stops THEN (3 * size)::DOUBLE ELSE (SELECT words::DOUBLE / weight FROM a) * w END AS target FROM f),
     r AS (SELECT d.doc_id, d.size, b.source_size, b.target, floor(b.target + 0.5)::BIGINT AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
             FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size = 0 THEN 0 ELSE
         budget // source_size * size + greatest(0, least(size, budget % source_size - before)) END)::BIGINT AS taken FROM r
"""
