"""Outcomes with fallbacks, labels of extremes, further feature sets, histograms over a data range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .summary import LOG_METRICS, RANGES

#: Fixed values of the domain: outcome, the columns it may come from (the first that is there), and what it exceeds.
OUTCOMES = {"mobility_disability_binary": (("rosbsum",), 0), "falls_binary": (("falls",), 0), "cognitive_impairment": (("dcfdx", "dcfdx_3gp"), 1)}
BINS = 10


def with_outcomes(df: DataFrame) -> DataFrame:
    """Df with 1.0 or 0.0 for each outcome, null where its column is; and the age at the visit where both parts are there.

    Where none of an outcome's columns is there, one of the outcome's own name is kept, else it is null.
    """
    made: dict[str, Column] = {}
    for name, (sources, over) in OUTCOMES.items():
        source = next((c for c in sources if c in df.columns), None)
        if source:
            made[name] = F.when(F.col(source).isNotNull(), (F.col(source) > over).cast("double"))
        elif name not in df.columns:
            made[name] = F.lit(None).cast("double")
    if {"age_bl", "fu_year"} <= set(df.columns):
        made["age_at_visit"] = F.col("age_bl") + F.col("fu_year")
    return df.withColumns(made)


def device_flag(device: Column, devices: tuple[str, ...]) -> Column:
    """The number of a device among those stated; null for others."""
    return F.coalesce(*(F.when(device == d, k) for k, d in enumerate(devices)))


def label_extremes(df: DataFrame, scores: DataFrame, key: str, score: str, least: str, most: str, name: str = "phenotype") -> DataFrame:
    """The rows of the keys with the smallest and the largest score, labelled; the smaller key of equals.

    Null scores do not count. If one key is both, it is the least.
    """
    known = scores.where(F.col(score).isNotNull())
    ends = known.agg(F.min_by(key, F.struct(score, key)).alias("_lo"), F.min_by(key, F.struct((-F.col(score)).alias("s"), key)).alias("_hi"))
    marked = df.crossJoin(F.broadcast(ends))  # one row
    label = F.when(F.col(key) == F.col("_lo"), least).when(F.col(key) == F.col("_hi"), most)
    return marked.withColumn(name, label).where(F.col(name).isNotNull()).drop("_lo", "_hi")


def feature_sets(groups: dict[str, list[str]], baseline: list[str]) -> dict[str, list[str]]:
    """The seven sets of the earlier comparison, of groups gait, pa and sleep and a clinical baseline."""
    gait, pa, night = (list(groups.get(g, ())) for g in ("gait", "pa", "sleep"))
    sets = {"Gait Bout": gait, "Daily PA": pa, "Sleep": night, "Daily PA + Sleep": pa + night, "Combined": gait + pa}
    return sets | {"Baseline": list(baseline), "Combined + Baseline": gait + pa + list(baseline)}


def histograms(long: DataFrame, key: str) -> DataFrame:
    """A5: key, metric, bin, freq and prob: ten bins of each metric of long(key, metric, x), on its shape scale.

    Metrics with a stated range have that one, and values outside do not count; others take a key's own, from its least
    value to its largest (or one above, if they are equal). The last bin is closed. Every metric that a key has a row
    of has all bins; without values in range they are 0.
    """
    logged = F.col("metric").isin(*LOG_METRICS)
    scaled = long.withColumn("v", F.when(logged, F.log1p("x")).otherwise(F.col("x")))
    own = scaled.groupBy(key, "metric").agg(F.min("v").alias("_min"), F.max("v").alias("_max"))
    stated = lambda k: F.coalesce(*(F.when(F.col("metric") == m, float(r[k])) for m, r in RANGES.items()))
    ends = own.select(key, "metric", F.coalesce(stated(0), "_min").alias("lo"), F.coalesce(stated(1), F.when(F.col("_max") > F.col("_min"), F.col("_max")).otherwise(F.col("_min") + 1)).alias("hi"))
    place = F.when(F.col("v").between(F.col("lo"), F.col("hi")), F.least(F.floor((F.col("v") - F.col("lo")) * BINS / (F.col("hi") - F.col("lo"))).cast("int"), F.lit(BINS - 1)))
    held = scaled.join(ends, [key, "metric"]).select(key, "metric", place.alias("bin")).groupBy(key, "metric").agg(*(F.count_if(F.col("bin") == b).alias(f"b{b}") for b in range(BINS)))
    total = sum((F.col(f"b{b}") for b in range(1, BINS)), F.col("b0"))
    bins = F.array(*(F.struct(F.lit(b).alias("bin"), F.col(f"b{b}").alias("freq")) for b in range(BINS)))
    spread = held.select(key, "metric", total.alias("_all"), F.explode(bins).alias("_b"))
    return spread.select(key, "metric", "_b.bin", "_b.freq", F.coalesce(F.try_divide(F.col("_b.freq"), F.col("_all")), F.lit(0.0)).alias("prob"))
