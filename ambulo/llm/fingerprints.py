"""Operator 6, document fingerprints by invertible Bloom lookup sketches, in DataFrame functions only.

A text is a set of paragraph digests: 64-bit hashes of its lines, cut further at sentence ends and, within long
sentences, every 160 characters. A sketch has three tables of 2 ** level cells; a digest adds one, itself and its
checksum (by exclusive or) to one cell of each. A fingerprint is the sketch at the least level, from one that the number
of digests suggests, at which peeling gives all of its own digests back; so a fingerprint holds its whole set, can be
folded to lower levels (a cell's place is its hash modulo the table) and, by its peeled digests, be made again larger.

Two fingerprints are compared at one level: their cells subtract, what they share vanishes, and cells that hold a single
digest are peeled, table after table, until none is left to peel. A pair that is stuck then goes on at the next level,
without bound. What is recovered are the differing digests, of which likeness follows.

All sketches of a document lie in one partition: after one exchange of the texts (to meet their neighbours) and one of
the digests, inserting, subtracting and peeling are aggregations without shuffles, linear in the digests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table, text_or_empty
from .sharding import H_BITS, find_splitters, place_rows

TABLES = 3
#: Cells of the smallest table, as a power of two.
LEAST_LEVEL = 2
#: Passes over the tables in one job; sketches that still give digests after them go on in the next.
PASSES = 3
#: Bytes of text in one range of neighbours, and most ranges (100 TB make ranges of 0.5 GB, sorted by spilling).
RANGE_BYTES, MOST_RANGES = 8 << 20, 200_000
PIECE = r"[^\n.!?]{1,160}[.!?\n ]*|[.!?\n]+"
KEYS = ["_p", "_r", "v"]


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of the text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    """32 bits that tell a digest from an exclusive or of several."""
    return F.xxhash64(key, F.lit("check")).bitwiseAND(F.lit(0xFFFFFFFF))


def _cell(key: Column, t: int, level: str) -> Column:
    """Place in table t: the hash modulo the table, so that halves of a table fold onto each other."""
    return F.xxhash64(key, F.lit(t)).bitwiseAND(F.expr(f"shiftleft(1L, {level}) - 1"))


def first_level(n: Column) -> Column:
    """Level that a set of n digests is tried at first: one and a half to three cells for each."""
    return F.greatest(F.lit(LEAST_LEVEL), F.ceil(F.log2(F.greatest(F.lit(1), n) / 2.0))).cast("int")


def _add(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))


def _insert(rows: DataFrame) -> DataFrame:
    """Cells (t, c, n, key, check) of the sketches of rows(KEYS, level, key, n): n times the key."""
    key = F.col("key")
    places = F.array(*(F.struct(F.lit(t).alias("t"), _cell(key, t, "level").alias("c")) for t in range(TABLES)))
    spread = rows.select(*KEYS, "level", "n", "key", _check(key).alias("check"), F.explode(places).alias("at")).select(*KEYS, "level", F.col("at.t").alias("t"), F.col("at.c").alias("c"), "n", "key", "check")
    return _add(spread, [*KEYS, "level", "t", "c"])


def _pure(t) -> Column:
    """Whether a cell of table t holds one digest."""
    key = F.col("key")
    return (F.col("t") == t) & (F.abs("n") == 1) & (F.col("check") == _check(key)) & (F.col("c") == _cell(key, t, "level"))


def _peel(cells: DataFrame, passes: int = PASSES) -> DataFrame:
    """Cells after some passes over the tables; a row of table TABLES counts the digests recovered.

    A step takes one table: its pure cells give up their digest, which leaves the other tables and is counted. A digest
    is in one cell of a table, so no step takes it twice.
    """
    full = F.expr("n <> 0 OR key <> 0 OR check <> 0")
    key, n = F.col("key"), F.col("n")
    cell = lambda t, c, n, key, check: F.struct(t.cast("int").alias("t"), c.cast("long").alias("c"), n.cast("long").alias("n"), key.cast("long").alias("key"), check.cast("long").alias("check"))
    cells = cells.where(full)
    for step in range(passes * TABLES):
        t = step % TABLES
        counted = cell(F.lit(TABLES), F.lit(0), F.lit(1), F.lit(0), F.lit(0))
        given = F.array(counted, *(cell(F.lit(o), _cell(key, o, "level"), -n, key, F.col("check")) for o in range(TABLES) if o != t))
        same = F.array(cell(F.col("t"), F.col("c"), n, key, F.col("check")))
        moved = cells.select(*KEYS, "level", F.explode(F.when(_pure(t), given).otherwise(same)).alias("x")).select(*KEYS, "level", "x.*")
        cells = _add(moved, [*KEYS, "level", "t", "c"]).where(full)
    return cells


def _peel_all(cells: DataFrame) -> list[DataFrame]:
    """Tables of KEYS, level, diff (digests recovered) and stuck; sketches without any full cell are not listed.

    Peeling goes on until no sketch has a pure cell left. Each digest peeled empties a cell and fills none; a sketch
    whose full cells do not get fewer has a cell that only looks pure, and is stuck.
    """
    out, before = [], None
    while True:
        state = cut(_peel(cells))
        full = F.col("t") < TABLES
        pure = reduce(Column.__or__, (_pure(t) for t in range(TABLES)))
        ends = state.groupBy(*KEYS, "level").agg(F.sum(F.when(full, 0).otherwise(F.col("n"))).alias("diff"), F.count_if(full).alias("left"), F.max(pure).alias("more"))
        if before is not None:
            ends = ends.join(before, KEYS, "left").withColumn("more", F.col("more") & (F.col("left") < F.col("_left"))).drop("_left")
        ends = cut(ends)
        out.append(ends.where("NOT more").select(*KEYS, "level", "diff", (F.col("left") > 0).alias("stuck")))
        before = ends.where("more").select(*KEYS, F.col("left").alias("_left"))
        if before.isEmpty():
            return out
        cells = state.join(before, KEYS, "left_semi").repartition("_p", "_r")


def _neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text, _p, _r: each row with the text after it by descending doc_id, round the end.

    Ranges of doc_id of equal bytes, found by counting, are sorted apart; the last row of a range meets the first of
    the next by a copy of that row which travels with the range.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ids = docs.select("doc_id", (F.octet_length("text").cast("long") + 16).alias("_size"))
    least, most, total = ids.agg(F.min("doc_id"), F.max("doc_id"), F.sum("_size")).first()
    if total is None:
        return docs.select("doc_id", "text", F.col("text").alias("next_text"), F.lit(0).alias("_p"), F.lit(0).alias("_r"))
    # The key (_h of H_BITS, _d): ids less the least one, null 0; _d has the low bits that do not fit.
    least, most = (0, 0) if least is None else (least, most)
    low = 0
    while ((most >> low) - (least >> low) + 2).bit_length() > H_BITS:
        low += 1
    bits = ((most >> low) - (least >> low) + 2).bit_length()
    place = F.coalesce(F.shiftright("doc_id", low) - F.lit(least >> low) + 1, F.lit(0))
    keyed = lambda df: df.withColumns({"_h": F.shiftleft(place, H_BITS - bits), "_d": F.coalesce(F.col("doc_id").bitwiseAND(F.lit((1 << low) - 1).cast("long")), F.lit(0))})
    ranges = max(1, min(-(-total // RANGE_BYTES), MOST_RANGES))
    splitters, _, _ = find_splitters(cut(keyed(ids).select("_h", "_d", "_size")), ranges)
    ranged = place_rows(keyed(docs), splitters, ranges).select("doc_id", "text", "_p")
    heads = sorted((r["_p"], r["top"]) for r in ranged.groupBy("_p").agg(F.max("doc_id").alias("top")).collect())  # MOST_RANGES rows; only the lowest may be null
    after = [(heads[k][1], heads[(k + 1) % len(heads)][0]) for k in range(len(heads))]  # copied to the range above
    small = spark.createDataFrame(after, "_top long, _to int")
    ghosts = ranged.drop("_p").join(F.broadcast(small), F.col("doc_id").eqNullSafe(F.col("_top"))).select("doc_id", "text", F.col("_to").alias("_p"), F.lit(1).alias("_ghost"))
    order = Window.partitionBy("_p").orderBy("_ghost", F.desc_nulls_last("doc_id"), "text")
    met = ranged.withColumn("_ghost", F.lit(0)).unionByName(ghosts).withColumns({"next_text": F.lead("text").over(order), "_r": F.row_number().over(order)})
    return met.where("_ghost = 0").select("doc_id", "text", "next_text", "_p", "_r")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_digests, level.

    The edited text has the last half of its code points (rounded down) replaced by the first as many (or all) of the
    next document's, by descending doc_id, after the last the first; rows of one doc_id stand by text, null ids last.
    doc_ids are cast to long.

    fingerprint: `level:` and the cells of the three tables, comma-separated, empty where nothing is in them, else
    count, 16 digits of the digests and 8 of the checksums in hexadecimal. n_digests and level (of the fingerprint)
    follow from it. Likeness is the Dice coefficient of the digest sets that two fingerprints hold, 1 for two empty
    ones: 1 - d / (a + b) for the d digests that peeling their difference recovers.

    Null texts count as empty, with no digests; a single row is its own next document; repeated rows are rows like any
    other; other columns are not read; an empty table gives an empty result.
    """
    met = _neighbours(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    sets = met.withColumn("_edited", edited).select(
        "_p", "_r", "doc_id", n.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        paragraph_digests(F.col("text")).alias("own"), paragraph_digests(F.col("_edited")).alias("edited"), paragraph_digests(F.col("next_text")).alias("next"),
    )
    sets = cut(sets)

    # Sketches by v: 0 and 1 are the text and the edited text alone, 2 and 3 the text less the edited and the next one.
    none = F.array().cast("array<bigint>")
    sketch = lambda v, plus, minus: F.struct(F.lit(v).alias("v"), plus.alias("plus"), minus.alias("minus"), first_level(F.size(plus) + F.size(minus)).alias("level"))
    four = F.array(sketch(0, F.col("own"), none), sketch(1, F.col("edited"), none), sketch(2, F.col("own"), F.col("edited")), sketch(3, F.col("own"), F.col("next")))
    signed = lambda c, k: F.transform(c, lambda d: F.struct(d.alias("key"), F.lit(k).cast("long").alias("n")))
    todo = sets.repartition("_p", "_r").select("_p", "_r", F.explode(four).alias("x")).select("_p", "_r", "x.*")
    done = []
    while True:
        inserts = todo.select(*KEYS, "level", F.explode(F.concat(signed("plus", 1), signed("minus", -1))).alias("x")).select(*KEYS, "level", "x.*")
        ends = _peel_all(_insert(inserts))
        done += [e.where("NOT stuck").drop("stuck") for e in ends]
        stuck = cut(reduce(DataFrame.unionByName, ends).where("stuck").select(*KEYS, (F.col("level") + 1).alias("_up")))
        if stuck.isEmpty():
            break
        again = sets.join(stuck.select("_p", "_r").distinct(), ["_p", "_r"], "left_semi").repartition("_p", "_r").select("_p", "_r", F.explode(four).alias("x")).select("_p", "_r", "x.*")
        todo = again.drop("level").join(stuck.withColumnRenamed("_up", "level"), KEYS).repartition("_p", "_r")
    peeled = reduce(DataFrame.unionByName, done)
    of = lambda v, c: F.max(F.when(F.col("v") == v, F.col(c)))
    known = cut(peeled.groupBy("_p", "_r").agg(of(0, "level").alias("level0"), of(1, "level").alias("level1"), of(2, "diff").alias("diff2"), of(3, "diff").alias("diff3")))
    filled = lambda df: df.join(known, ["_p", "_r"], "left").na.fill({"level0": LEAST_LEVEL, "level1": LEAST_LEVEL, "diff2": 0, "diff3": 0})

    shown = filled(sets.select("_p", "_r", "own", "edited").repartition("_p", "_r"))
    both = F.array(*(F.struct(F.lit(v).alias("v"), F.col(c).alias("keys"), F.col(f"level{v}").alias("level")) for v, c in enumerate(("own", "edited"))))
    keys = shown.select("_p", "_r", F.explode(both).alias("x")).select("_p", "_r", "x.v", "x.level", F.explode("x.keys").alias("key")).withColumn("n", F.lit(1).cast("long"))
    wide = lambda c, digits: F.lpad(F.lower(F.hex(c)), digits, "0")
    slot = F.struct((F.expr("shiftleft(CAST(t AS long), level)") + F.col("c")).alias("i"), F.concat(F.lower(F.hex("n")), wide("key", 16), wide("check", 8)).alias("h"))
    marks = _insert(keys).groupBy(*KEYS, "level").agg(F.sort_array(F.collect_list(slot)).alias("slots"))
    # Full cells come in order; the commas before each are the places since the one before.
    at = F.transform("slots", lambda s: s["i"])
    steps = F.zip_with(at, F.concat(F.array(F.lit(0).cast("long")), F.slice(at, F.lit(1), F.size(at) - 1)), lambda a, b: (a - b).cast("int"))
    body = F.array_join(F.zip_with("slots", steps, lambda s, k: F.concat(F.repeat(F.lit(","), k), s["h"])), "")
    tail = F.repeat(F.lit(","), (F.expr(f"shiftleft({TABLES}L, level)") - 1 - F.element_at(at, -1)).cast("int"))
    marks = marks.select("_p", "_r", "v", F.concat(F.col("level").cast("string"), F.lit(":"), body, tail).alias("mark"))
    marks = marks.groupBy("_p", "_r").agg(F.max(F.when(F.col("v") == 0, F.col("mark"))).alias("m0"), F.max(F.when(F.col("v") == 1, F.col("mark"))).alias("m1"))

    sized = filled(sets.select("_p", "_r", "doc_id", "n_chars", "edited_sha256", F.size("own").alias("a"), F.size("edited").alias("b"), F.size("next").alias("c")).repartition("_p", "_r"))
    out = sized.join(marks, ["_p", "_r"], "left")
    empty = F.lit(f"{LEAST_LEVEL}:" + "," * ((TABLES << LEAST_LEVEL) - 1))
    near = lambda other, diff: F.when(F.col("a") + F.col(other) == 0, F.lit(1.0)).otherwise(1 - F.col(diff) / F.greatest(F.lit(1), F.col("a") + F.col(other)))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.coalesce("m0", empty).alias("fingerprint"), F.coalesce("m1", empty).alias("edited_fingerprint"),
        near("b", "diff2").alias("near_edited"), near("c", "diff3").alias("near_next"), F.col("a").cast("long").alias("n_digests"), F.col("level0").alias("level"),
    )


def op6_invertible_sketch(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
