"""Day, hour and epoch features, and the rest-activity rhythm."""

from __future__ import annotations

from math import isclose

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DAY_PARTS, clock_hour


def daily_totals(df: DataFrame, keys: list[str], day: str, value: str, per: float = 1.0) -> DataFrame:
    """Sum by calendar day, as minutes with per=60."""
    return df.where(F.col(day).isNotNull()).groupBy(*keys, day).agg((F.sum(value) / per).alias("total"))


def daily_volume(df: DataFrame, keys: list[str], day: str, duration: str, cuts: tuple[int, ...] = (30, 60)) -> DataFrame:
    """Bouts a day, and those longer than each cut; days without such bouts stay, with 0."""
    return df.where(F.col(day).isNotNull()).groupBy(*keys, day).agg(F.count(F.lit(1)).alias("n_bouts"), *(F.count_if(F.col(duration) > c).alias(f"n_gt{c}") for c in cuts))


def time_of_day(df: DataFrame, keys: list[str], hour: str) -> DataFrame:
    """A10: bouts and their share in each part of the day; rows without an hour count in the denominator."""
    held = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(hour).between(lo, hi)).alias(f"{name}_n") for name, (lo, hi) in DAY_PARTS.items()))
    return held.select("*", *((F.col(f"{name}_n") / F.col("n")).alias(f"{name}_share") for name in DAY_PARTS))


def full_day_stats(df: DataFrame, keys: list[str], i: str, value: str, per_day: int) -> DataFrame:
    """Mean and population deviation of whole days of samples; the partial last day is left out."""
    day = F.floor(F.col(i) / per_day).cast("int")
    return df.groupBy(*keys, day.alias("day")).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("pa_mean"), F.stddev_pop(value).alias("pa_std")).where(F.col("_n") == per_day).drop("_n")


def epoch_totals(df: DataFrame, keys: list[str], i: str, value: str, epoch: int, epochs_a_day: int) -> DataFrame:
    """Sums of whole epochs, and of whole days of epochs."""
    e = df.groupBy(*keys, F.floor(F.col(i) / epoch).cast("int").alias("epoch")).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == epoch)
    return e.groupBy(*keys, F.floor(F.col("epoch") / epochs_a_day).cast("int").alias("day")).agg(F.sum("s").alias("tdpa"), F.count(F.lit(1)).alias("_e")).where(F.col("_e") == epochs_a_day).drop("_e")


def epoch_median(df: DataFrame, keys: list[str], i: str, value: str, epoch: int) -> DataFrame:
    """Median of whole epochs; the remainder is cut off."""
    return df.groupBy(*keys, F.floor(F.col(i) / epoch).cast("int").alias("epoch")).agg(F.percentile(value, F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == epoch).drop("_n")


def mean_in_order(value: str, *order: str):
    """Aggregate: the mean, its sum in a fixed order, so that its last digits do not vary; for groups of bounded size."""
    rows = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).cast("double").alias("_v")))))
    return F.try_divide(F.aggregate(rows, F.lit(0.0), lambda s, r: s + r["_v"]), F.count(value).cast("double"))


def to_grid(df: DataFrame, keys: list[str], at: str, value: str, how: str = "mean", ties: str | None = None) -> DataFrame:
    """One row for each step between a key's first and last, with the mean or maximum of the step, or null.

    With `ties` the rows of a step are added up in the order of that column.
    """
    agg = F.max(value) if how != "mean" else mean_in_order(value, ties) if ties else F.avg(value)
    held = df.groupBy(*keys, at).agg(agg.alias("value"))
    # Each step is followed by the steps up to the next one, so that rows dealt by key are not dealt again.
    until = F.coalesce(F.lead(at).over(Window.partitionBy(*keys).orderBy(at)) - 1, at)
    spread = held.where(F.col(at).isNotNull()).withColumn("_until", until).withColumn("_g", F.explode(F.sequence(F.col(at), F.col("_until"))))
    return spread.select(*keys, F.col("_g").alias(at), F.when(F.col("_g") == F.col(at), F.col("value")).alias("value"))


def nearest_on_grid(df: DataFrame, keys: list[str], at: str, value: str, step: int, tolerance: int, ties: str | None = None) -> DataFrame:
    """For each grid point the nearest row within tolerance, the earlier on ties, of rows at one
    time that of the least `ties`, or else of the least value; points without one are null.

    Rows meet only the grid points around them, so the join is by equal keys.
    """
    ends = df.groupBy(*keys).agg(F.floor(F.min(at) / step).alias("_lo"), F.ceil(F.max(at) / step).alias("_hi"))
    grid = ends.select(*keys, F.explode(F.transform(F.sequence("_lo", "_hi"), lambda g: g * step)).alias("grid"))
    lo, hi = F.ceil((F.col(at) - tolerance) / step), F.floor((F.col(at) + tolerance) / step)
    near = df.where(lo <= hi).select(*keys, at, value, F.col(ties or value).alias("_tie"), F.explode(F.sequence(lo, hi)).alias("_g")).withColumn("grid", F.col("_g") * step)
    best = near.groupBy(*keys, "grid").agg(F.min_by(value, F.struct(F.abs(F.col(at) - F.col("grid")), at, "_tie", value)).alias("value"))
    return grid.join(best, [*keys, "grid"], "left")


def is_iv(grid: DataFrame, keys: list[str], at: str, value: str, period: int, least: int | None = None) -> DataFrame:
    """Interdaily stability n * var(profile) / (period * var(x)), intradaily variability mean(diff^2) / var(x).

    The profile's variance is around its own mean, over the slots that have values. Differences are between successive
    values that are not null. Null below `least` values (two periods).
    """
    known = grid.where(F.col(value).isNotNull())
    diff = known.withColumn("d", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(at)))
    whole = diff.groupBy(*keys).agg(F.count(value).alias("n"), F.var_pop(value).alias("var"), F.avg(F.pow("d", F.lit(2.0))).alias("dd"))
    profile = known.groupBy(*keys, (F.col(at) % period).alias("slot")).agg(F.avg(value).alias("p"))
    joined = whole.join(profile.groupBy(*keys).agg(F.var_pop("p").alias("vp")), keys)
    ok = (F.col("n") >= (2 * period if least is None else least)) & (F.col("var") > 0)
    return joined.select(*keys, "n", F.when(ok, F.col("n") * F.col("vp") / (period * F.col("var"))).alias("rar_is"), F.when(ok, F.col("dd") / F.col("var")).alias("rar_iv"))


def l5_m10(grid: DataFrame, keys: list[str], at: str, value: str, period: int, low: int, high: int, least: int | None = None, equal: float = 1e-9) -> DataFrame:
    """Least and most active spans of the circular daily profile, the hour at which the least one begins, and
    their relative amplitude.

    Slots without a value take the profile's mean. The first of equal spans (no more than `equal` apart) counts. Null
    below `least` values (two periods). Sums go in order of time: a slot's values, and the slots as they are first seen.
    """
    held = grid.where(F.col(value).isNotNull())
    n = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    known = held.groupBy(*keys, (F.col(at) % period).cast("int").alias("slot")).agg(mean_in_order(value, at).alias("p"), F.min(at).alias("_first"))
    mean = known.groupBy(*keys).agg(mean_in_order("p", "_first").alias("pm"))
    slots = mean.select(*keys, "pm", F.explode(F.sequence(F.lit(0), F.lit(period - 1))).alias("slot")).join(known, [*keys, "slot"], "left").select(*keys, "slot", F.coalesce("p", "pm").alias("p"))
    twice = slots.withColumn("turn", F.explode(F.array(F.lit(0), F.lit(period)))).withColumn("slot", F.col("slot") + F.col("turn"))
    order = Window.partitionBy(*keys).orderBy("slot")
    rolled = twice.withColumn("lo", F.avg("p").over(order.rowsBetween(0, low - 1))).withColumn("hi", F.avg("p").over(order.rowsBetween(0, high - 1))).where(F.col("slot") < period)
    # Equal spans differ by the last digits, as their sums begin at other slots.
    least_lo = F.min("lo").over(Window.partitionBy(*keys))
    first = rolled.withColumn("_l5", least_lo)
    out = first.groupBy(*keys).agg(F.min("lo").alias("l5"), F.min(F.when(F.col("lo") <= F.col("_l5") + equal, F.col("slot"))).alias("slot"), F.max("hi").alias("m10")).join(n, keys)
    ok = lambda c: F.when(F.col("n") >= (2 * period if least is None else least), c)
    ra = F.when(F.col("m10") + F.col("l5") > 0, (F.col("m10") - F.col("l5")) / (F.col("m10") + F.col("l5")))
    return out.select(*keys, ok(F.col("l5")).alias("l5"), ok(F.col("slot") * 24.0 / period).alias("l5_onset_hour"), ok(F.col("m10")).alias("m10"), ok(ra).alias("ra"))


def regularity_index(grid: DataFrame, keys: list[str], at: str, state: str, period: int, least: int | None = None) -> DataFrame:
    """200 times the share of equal states a period apart, less 100.

    Null where the grid has fewer steps than `least` (two periods), known or not, or no two known ones a period apart.
    """
    later = F.first(state).over(Window.partitionBy(*keys).orderBy("_at").rangeBetween(period, period))
    same = F.avg((F.col(state) == F.col("_later")).cast("double"))
    held = grid.withColumn("_at", F.col(at).cast("long")).withColumn("_later", later).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), same.alias("same"))
    return held.select(*keys, "n", F.when(F.col("n") >= (2 * period if least is None else least), 200 * F.col("same") - 100).alias("sri"))


def nightly_metrics(epochs: DataFrame, nights: DataFrame, keys: list[str], epoch_hours: float, first_hour: float = 0.0) -> DataFrame:
    """Onset, wake and middle of each night's sleep as clock hours (A24), hours in bed, asleep and awake, efficiency,
    awakenings and fragmentation.

    epochs(keys, i, sib), i from 0 at first_hour o'clock; nights(keys, night, start, end). An awakening is a sleeping
    epoch followed by a waking one. Waking is the epoch after the last, or the last of the recording. The day is taken
    off in epochs: hours since 1970 keep ten digits after the point, which shows where the mean of a clock hour is near 0.
    """
    per_hour = 1 / epoch_hours
    per_hour = float(round(per_hour)) if isclose(per_hour, round(per_hour)) else per_hour
    # The nights of a key are one row, so its epochs do not meet each of them as rows.
    held = nights.groupBy(*keys).agg(F.collect_list(F.struct("night", "start", "end")).alias("_nights"))
    around = F.filter("_nights", lambda n: F.col("i").between(n["start"], n["end"]))
    met = epochs.join(held.hint("merge"), keys).withColumn("_night", F.explode(around)).select(*keys, "i", "sib", "_night.*")
    order = Window.partitionBy(*keys, "night").orderBy("i")
    woke = met.withColumn("_woke", ((F.lag("sib").over(order) == 1) & (F.col("sib") == 0)).cast("int"))
    out = woke.groupBy(*keys, "night", "start", "end").agg((F.count(F.lit(1)) / per_hour).alias("spt_hours"), (F.sum("sib") / per_hour).alias("tst_hours"), F.coalesce(F.sum("_woke"), F.lit(0)).alias("awakenings"))
    last = epochs.groupBy(*keys).agg(F.max("i").alias("_last"))
    wake = F.least(F.col("end") + 1, F.col("_last"))
    clock = lambda i: clock_hour(F.pmod(i + first_hour * per_hour, F.lit(24 * per_hour)) / per_hour)
    return out.join(last, keys).select(
        *keys, "night", clock(F.col("start")).alias("sleep_onset_hour"), clock(wake).alias("wake_time_hour"), clock((F.col("start") + wake) / 2).alias("midsleep_hour"),
        "spt_hours", "tst_hours", (F.col("spt_hours") - F.col("tst_hours")).alias("waso_hours"), (F.col("tst_hours") / F.col("spt_hours")).alias("sleep_efficiency"),
        "awakenings", F.try_divide(F.col("awakenings"), F.col("tst_hours")).alias("frag_index"),
    )


def masked_epochs(samples: DataFrame, keys: list[str], i: str, nonwear: str, epoch: int) -> DataFrame:
    """Epochs in which any sample is non-wear."""
    return samples.groupBy(*keys, F.floor(F.col(i) / epoch).cast("int").alias("epoch")).agg(F.bool_or(nonwear).alias("masked"))


