"""Ranks and running numbers of large groups: a few keys may hold all rows, and no task sorts a whole key.

Rows are dealt to buckets in the order asked for, by ranges or by the leading digits of a hash; buckets are counted,
counts are summed up over a key's buckets, and each bucket is sorted by itself. The results are exact, wherever the
ranges were cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored

def same_keys(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of small, which has a row for each key; null keys meet each other."""
    named = small.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    on = [df[k].eqNullSafe(named[f"_k{i}"]) for i, k in enumerate(keys)]
    return df.join(named, on).drop(*(f"_k{i}" for i in range(len(keys))))


def _with_buckets(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with _bucket, which ascends with keys and value; equal rows of both share one.

    The buckets are the ranges of a range partitioning, as many as the size of the data asks for; rows are stored with
    them, so that all that is made of them sees the same ones.
    """
    return stored(df.repartitionByRange(*(F.col(k) for k in keys), F.col(value)).withColumn("_bucket", F.spark_partition_id()))


def _starts(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """keys, _bucket and, for each sum, what the buckets before hold."""
    held = df.groupBy(*keys, "_bucket").agg(*(c.alias(n) for n, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return held.select(*keys, "_bucket", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums))


def with_average_rank(df: DataFrame, keys: list[str], value: str, name: str, times: str | None = None) -> DataFrame:
    """df (values not null) with the rank of each value in its key, ties at their mean; rows count `times` times.

    Ranks are found on one row for each distinct value and joined back; a value held by many rows is one small side of
    that join, whose large side is split where it is skewed.
    """
    held = df.groupBy(*keys, value).agg((F.sum(times) if times else F.count(F.lit(1))).alias("_n"))
    run = with_running_sums(held, keys, value, {"_ge": "_n"})
    whole = held.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    ranked = same_keys(run, whole, keys).select(*keys, value, (F.col("_all") - F.col("_ge") + (F.col("_n") + 1) / 2.0).alias(name))
    return same_keys(df, ranked, [*keys, value])


def with_running_sums(df: DataFrame, keys: list[str], value: str, sums: dict[str, str]) -> DataFrame:
    """df, one row for each value of a key, with sums (name -> column) over the rows of the largest values down to its own."""
    rows = _with_buckets(df, keys, value).withColumn("_bucket", -F.col("_bucket"))
    placed = same_keys(rows, _starts(rows, keys, {f"_{n}": F.sum(c) for n, c in sums.items()}), [*keys, "_bucket"])
    down = Window.partitionBy(*keys, "_bucket").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumns({n: F.col(f"_{n}") + F.sum(c).over(down) for n, c in sums.items()}).drop("_bucket", *(f"_{n}" for n in sums))


def with_hash_number(df: DataFrame, keys: list[str], digest: Column, ties: str, name: str) -> DataFrame:
    """df with the number (from 1) of each row in its key by a hexadecimal digest, then `ties`; buckets by three digits."""
    rows = df.withColumn("_h", digest).withColumn("_bucket", F.substring("_h", 1, 3))
    placed = same_keys(rows, _starts(rows, keys, {"_before": F.count(F.lit(1))}), [*keys, "_bucket"])
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_h", ties)
    return placed.withColumn(name, F.col("_before") + F.row_number().over(inside)).drop("_before", "_bucket", "_h")
