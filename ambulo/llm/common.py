"""Helpers shared by the training-data operators: table access, lineage cuts, text rules."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager
from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset the warehouse.

    Either is for the cluster to name. Only a local session, which has no other machine, takes a folder of its own, as
    its default warehouse is the working folder.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known and sc.master.startswith("local"):
        known = f"file://{tempfile.mkdtemp(prefix='ambulo-')}"
        sc.setCheckpointDir(known)
    return known or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_ambulo"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept as a table beside the checkpoints (survives lost executors).

    A table rather than checkpoint(): plans over it know its size and start anew, where checkpointed frames carry the
    size estimates of the plans they came from, which multiply in loops.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid4().hex}"
    with _small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _small_batches(spark: SparkSession):
    """While it lasts, batches to and from Python workers have BATCH_BYTES at most, which bounds the memory of both."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(run):
    """A function over Arrow batches that gives freed memory back when its partition is done; workers live on."""

    def wrapped(batches):
        import ctypes
        import gc

        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return wrapped


def utf8(texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of strings (null: empty), end to end, and the offsets of each in them."""
    import pyarrow as pa

    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def portions(batches, column: str = "text", most: int = 1 << 18):
    """Slices of Arrow batches, in order, with about `most` bytes of text each and one row at least."""
    for batch in batches:
        ends, at = utf8(batch.column(column))[1], 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


#: A key with more than one in so many rows is hot; there are at most so many hot keys.
HOT = 2_000


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], counts: DataFrame, rows: int, spread: Column) -> DataFrame:
    """big joined with small, which has each of its keys once, by keys that may be hot in big.

    counts(keys, n) has at least the keys of more than rows / HOT rows. Their rows, parted by the hash of `spread`, and
    copies of their row of small go to as many tasks as their share asks for; so HOT rows are broadcast at most.
    """
    n, parts, salt = unused(big, "n"), unused(big.join(small, keys), "parts"), unused(big.join(small, keys), "salt")
    hot = F.broadcast(cut(counts.toDF(*keys, n).where(F.col(n) > rows / HOT).select(*keys, F.ceil(F.col(n) * HOT / max(rows, 1)).cast("int").alias(parts))))
    left = big.join(hot, keys, "left").withColumn(salt, F.when(F.col(parts).isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col(parts)).cast("int"))).drop(parts)
    right = small.join(hot, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
    return left.join(right, [*keys, salt]).drop(salt)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name = f"_{name}"
    return f"_{name}"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words as `WORD` has them; null and empty texts have none.

    White space is made spaces, outer spaces go, and runs of spaces part the words.
    """
    squeezed = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(squeezed == "", F.lit(0)).otherwise(F.size(F.split(squeezed, " +"))).cast("long")


#: DuckDB has no crc32: the byte table as a CTE of one row, and the fold over the bytes of a text.
CRC_TABLE_SQL = """crc_bits(i, c, n) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL
       SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM crc_bits WHERE n < 8),
     crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE n = 8)"""


def crc32_sql(text: str) -> str:
    return f"""(SELECT xor(list_reduce(list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex({text}), 2 * i - 1, 2))::BIGINT),
       lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) FROM crc_table)"""
