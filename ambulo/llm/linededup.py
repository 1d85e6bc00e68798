"""Operator 8, line deduplication over overlapping three-line windows.

Each run of three consecutive lines is hashed to 128 bits, once, and kept as a table of places. Windows that occur
again anywhere, in another document or later in the same one, are found by one aggregation with partial counts; each
later occurrence covers its three lines, and covered lines go. Texts move once, to meet their covered lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join, table, unused

LINES = 3
#: What tells rows apart: rows equal in both are one document.
ROW = ("doc_id", "text_key")


def _text_key(text: Column) -> Column:
    return F.xxhash64(text)


def _windows(docs: DataFrame, lines: int) -> DataFrame:
    """doc_id, text_key, pos, h1, h2 of every window that holds more than white space; docs has doc_id and text."""
    cells = lambda i: [F.get("_lines", i + k) for k in range(lines)]
    each = F.when(F.size("_lines") >= lines, F.transform(F.sequence(F.lit(0), F.size("_lines") - lines), lambda i: F.struct(
        i.alias("pos"), F.xxhash64(*cells(i)).alias("h1"), F.xxhash64(F.lit("w"), *cells(i)[::-1]).alias("h2"), F.concat(*map(F.trim, cells(i))).rlike(r"[^\x20\x09-\x0D]").alias("solid"))))
    split = docs.select("doc_id", _text_key(F.col("text")).alias("text_key"), F.split("text", "\n").alias("_lines"))
    return split.select(*ROW, F.explode(each).alias("w")).select(*ROW, "w.*").where("solid").drop("solid")


def covered_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """doc_id, text_key, covered: positions (from 0) of the lines that later occurrences of a window cover.

    The first occurrence is the one with the smallest (doc_id, text_key, position), null ids first.
    """
    windows = cut(_windows(docs.select("doc_id", F.col("text").cast("string").alias("text")), lines))
    place = F.struct(*ROW, "pos")
    seen = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")).where("first <> last")
    seen = cut(seen.select("h1", "h2", "first", "n"))
    # The rows of a window that very many documents share are parted among tasks.
    met = salted_join(windows, seen.drop("n"), ["h1", "h2"], seen.select("h1", "h2", "n"), windows.count(), F.struct(*ROW, "pos"))
    later = met.where(~place.eqNullSafe(F.col("first")))
    spots = later.select(*ROW, F.explode(F.transform(F.sequence(F.lit(0), F.lit(lines - 1)), lambda k: F.col("pos") + k)).alias("pos"))
    return spots.groupBy(*ROW).agg(F.collect_set("pos").alias("covered"))


def dedup_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """docs with the covered lines removed from text, and columns n_lines, n_removed (replacing such columns).

    Lines end at line feeds and are compared as they are. Documents of fewer than three lines, windows of white space
    only, empty and null texts (null stays null, no lines) are left alone. A document all of whose lines are covered
    gets an empty text. Rows equal in doc_id and text count as one document: what is covered in one is removed from
    each; two texts under one doc_id are two documents, and null doc_ids are one id. The work is linear in the lines of
    a text. Other columns pass through, whatever their names. An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_removed")
    i, k, c, parts = (unused(docs, n) for n in ("id", "key", "covered", "parts"))
    marks = covered_lines(docs, lines).toDF(i, k, c)
    text = docs["text"].cast("string")
    met = docs.join(marks, docs["doc_id"].eqNullSafe(marks[i]) & (_text_key(text) == marks[k]), "left")
    split = met.withColumn(parts, F.split(F.col("text").cast("string"), "\n"))
    # Positions that stay, by a set difference; then each line is fetched by position.
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), c)
    rest = F.array_join(F.transform(stay, lambda p: F.get(parts, p)), "\n")
    changed = F.col("text").isNotNull() & F.col(c).isNotNull()
    out = {
        "text": F.when(changed, rest).otherwise(F.col("text").cast("string")),
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long"),
        "n_removed": F.when(changed, F.size(c)).otherwise(0).cast("long"),
    }
    return split.select(*(out[n].alias(n) if n == "text" else F.col(f"`{n}`") for n in docs.columns), out["n_lines"].alias("n_lines"), out["n_removed"].alias("n_removed"))


def op8_line_windows(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("kept_md5"))


OP8_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
     w AS (SELECT doc_id, unnest(range(0, len(l) - 2)) AS pos, l FROM l WHERE len(l) >= 3),
     h AS (SELECT doc_id, pos, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] AS w FROM w),
     s AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM h WHERE regexp_matches(w, '[^\x20\x09-\x0D]')),
     c AS (SELECT doc_id, list_distinct(flatten(list([pos, pos + 1, pos + 2]))) AS c FROM s WHERE k > 1 GROUP BY doc_id),
     k AS (SELECT l.doc_id, len(l.l) AS n, coalesce(len(c.c), 0) AS r, text,
             CASE WHEN c.c IS NULL THEN text ELSE coalesce(array_to_string([x FOR x, i IN l.l IF NOT list_contains(c.c, i - 1)], chr(10)), '') END AS kept
             FROM l LEFT JOIN c ON l.doc_id = c.doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE n END::BIGINT AS n_lines, r::BIGINT AS n_removed, length(kept)::BIGINT AS n_chars_kept, md5(kept) AS kept_md5 FROM k
"""
