"""Clinical merges, cohorts, feature groups and reports over subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import same_keys, with_hash_number

#: Feature groups by column prefix (fixed values of the domain); the rest are gait features.
GROUP_PREFIXES = {"daily_pa_mean_": "pa", "daily_pa_std_": "pa", "tdpa_": "pa", "sleep_": "sleep", "rar_": "rar"}


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """U4: one row of each key, the first in a stated order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def merge_clinical(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", drop: tuple[str, ...] = ()) -> DataFrame:
    """Equi-join by keys; named columns of the right side that the left has too are dropped. Null keys meet nothing."""
    return left.join(right.drop(*drop), keys, how)


def merge_visits(left: DataFrame, visits: DataFrame, keys: list[str], rename: dict[str, str], order: list[Column], demographics: DataFrame, on: list[str]) -> DataFrame:
    """Visits renamed and deduplicated (first kept), joined inner; demographics joined left."""
    return left.join(first_by(visits.withColumnsRenamed(rename), keys, order), keys).join(demographics, on, "left")


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The keys on both sides; a leakage guard expects none."""
    return a.select(key).intersect(b.select(key))


def reconcile(summary: DataFrame, detail: DataFrame, keys: list[str], stated: str) -> DataFrame:
    """Stated count against counted rows."""
    counted = detail.groupBy(*keys).agg(F.count(F.lit(1)).alias("counted"))
    return summary.join(counted, keys, "left").select(*keys, stated, F.coalesce("counted", F.lit(0)).alias("counted"), (F.col(stated) - F.coalesce("counted", F.lit(0))).alias("discrepancy"))


def union_tables(*frames: DataFrame) -> DataFrame:
    """All rows; columns that a table lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What has no finished output yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def check_cohort(df: DataFrame, key: str, required: list[str], n: int | None = None) -> DataFrame:
    """The same rows, or an error if keys repeat, a covariate is null or the size is not n. One aggregation."""
    a = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("k"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required)).first()
    if a["n"] != a["k"] or n is not None and a["n"] != n or any(a[f"null_{c}"] for c in required):
        raise ValueError(f"cohort check failed: {a.asDict()}")
    return df


def feature_groups(columns: list[str], exclude: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Columns by group; histogram shares and excluded names belong to none."""
    out: dict[str, list[str]] = {"gait": [], "pa": [], "sleep": [], "rar": []}
    for c in columns:
        if c in exclude or "_prob_bin" in c:
            continue
        out[next((g for p, g in GROUP_PREFIXES.items() if c.startswith(p)), "gait")].append(c)
    return out


def feature_ladder(groups: dict[str, list[str]], demographics: list[str]) -> dict[str, list[str]]:
    """Demographics, each block added alone, and all blocks together if there are two or more."""
    out = {"Demographics": list(demographics)}
    present = {g: c for g, c in groups.items() if c}
    out |= {f"Demographics + {g}": [*demographics, *c] for g, c in present.items()}
    if len(present) >= 2:
        out["Full Sensor"] = [*demographics, *(x for c in present.values() for x in c)]
    return out


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and their percentage by column; one pass."""
    held = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    long = held.unpivot(["_n"], columns, "column", "n_missing")
    return long.select("column", "n_missing", F.round(100 * F.col("n_missing") / F.col("_n"), 6).alias("pct_missing"))


def bounds_report(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Values outside physiological bounds, by metric; one pass."""
    cols = list(bounds)
    out = df.agg(*(F.struct(F.count(c).alias("n"), F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias("n_out")).alias(c) for c, (lo, hi) in bounds.items()))
    return out.unpivot([], cols, "metric", "x").select("metric", "x.n", "x.n_out", F.round(100 * F.col("x.n_out") / F.col("x.n"), 6).alias("pct_out"))


def outlier_flags(df: DataFrame, keys: list[str], metrics: list[str], k: float = 1.5, z: float = 3.5) -> DataFrame:
    """Per row and metric, outside 1.5 interquartile ranges, beyond 3.5 deviations, and the number of range flags."""
    q = df.agg(*(F.percentile(m, F.array(F.lit(0.25), F.lit(0.75))).alias(f"q_{m}") for m in metrics), *(F.avg(m).alias(f"m_{m}") for m in metrics), *(F.stddev_pop(m).alias(f"s_{m}") for m in metrics))
    both = df.crossJoin(F.broadcast(q))  # one row
    flags = {}
    for m in metrics:
        iqr = F.col(f"q_{m}")[1] - F.col(f"q_{m}")[0]
        flags[f"iqr_{m}"] = F.coalesce((F.col(m) < F.col(f"q_{m}")[0] - k * iqr) | (F.col(m) > F.col(f"q_{m}")[1] + k * iqr), F.lit(False)).cast("int")
        flags[f"z_{m}"] = F.coalesce(F.abs(F.col(m) - F.col(f"m_{m}")) / F.nullif(F.col(f"s_{m}"), F.lit(0.0)) > z, F.lit(False)).cast("int")
    out = both.withColumns(flags)
    return out.select(*keys, *flags, sum((F.col(f"iqr_{m}") for m in metrics[1:]), F.col(f"iqr_{metrics[0]}")).alias("n_flags"))


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """K1 to K4: the first n rows of a stated order."""
    return df.orderBy(*order).limit(n)


def top_in_groups(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def stratified_split(df: DataFrame, key: str, stratum: str, share: float, seed: int) -> DataFrame:
    """held_out for the rows of least hash in each stratum, a stated share of it rounded half up; null is a stratum.

    The hash is an md5 of seed and key, so any engine draws the same rows.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    numbered = with_hash_number(df, [stratum], h, key, "_i")
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    return same_keys(numbered, sizes, [stratum]).select(*df.columns, (F.col("_i") <= F.floor(F.col("_n") * share + 0.5)).alias("held_out"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """K8: n rows of least hash."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def folds(df: DataFrame, key: str, stratum: str | None, k: int, repeats: int, seed: int = 42) -> DataFrame:
    """Repeat and fold of every row, balanced by stratum, by hash ranks."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("repeat").cast("string"), F.col(key).cast("string")))
    many = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    numbered = with_hash_number(many, ["repeat", *([stratum] if stratum else [])], h, key, "_i")
    return numbered.withColumn("fold", ((F.col("_i") - 1) % k).cast("int")).drop("_i")


def in_order(df: DataFrame, column: str, order: list[str], then: list[Column]) -> DataFrame:
    """K6, K7: place of each row by a stated order of categories (others last), then by further columns.

    The place, not the order of rows, carries the result; the window runs over a report's rows.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(column)), F.lit(0))
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.when(rank > 0, rank).otherwise(len(order) + 1), *then)))
