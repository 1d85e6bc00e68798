"""Ordered operators: bouts, runs, windows, imputation, non-wear, sleep blocks.

Everything positional works on a subject's rows in order; windows partition by subject, and by day where a rule allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(df: DataFrame, keys: list[str], at: str, gap: float, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows with bout_id, 1-based by key; a row joins the bout before it if at most gap later.

    Rows come out in order, those of one time by ties, so that sums over them do not vary from run to run.
    """
    order = Window.partitionBy(*keys).orderBy(at, *ties)
    fresh = df.withColumn("_new", (F.col(at) - F.lag(at).over(order) > gap).cast("int"))
    return fresh.withColumn("bout_id", (F.coalesce(F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) + 1).cast("int")).drop("_new")


def merge_bouts(seconds: DataFrame, key: str = "subject_id", gap: int = 3, least: int = 10, hz: int = 30) -> DataFrame:
    """Walking seconds (subject, sec, walk) to bouts; end exclusive, gaps of up to three seconds close."""
    walking = seconds.where("walk = 1").select(key, "sec")
    runs = sessions(walking, [key], "sec", gap + 1).groupBy(key, "bout_id").agg(F.min("sec").alias("start_sec"), (F.max("sec") + 1).alias("end_sec"))
    kept = runs.withColumn("duration_sec", F.col("end_sec") - F.col("start_sec")).where(F.col("duration_sec") >= least)
    number = F.row_number().over(Window.partitionBy(key).orderBy("start_sec"))
    return kept.select(key, number.alias("bout_id"), "start_sec", "end_sec", "duration_sec", (F.col("start_sec") * hz).cast("long").alias("start_sample"), (F.col("end_sec") * hz).cast("long").alias("end_sample"))


def full_windows(df: DataFrame, keys: list[str], i: str, values: list[str], size: int, step: int) -> DataFrame:
    """Overlapping windows of `size` positions every `step`; only whole ones, with the mean of variances.

    A position i belongs to the windows that start at multiples of step from i - size + 1 to i.
    """
    first = F.greatest(F.lit(0), F.ceil((F.col(i) - size + 1) / step)).cast("int")
    spread = df.select(*keys, i, *values, F.explode(F.sequence(first, F.floor(F.col(i) / step).cast("int"))).alias("w_idx"))
    mean = sum((F.var_pop(v) for v in values[1:]), F.var_pop(values[0])) / len(values)
    return spread.groupBy(*keys, "w_idx").agg(F.count(F.lit(1)).alias("_n"), mean.alias("variance")).where(F.col("_n") == size).drop("_n")


def otsu(df: DataFrame, keys: list[str], value: str, bins: int = 256, log: bool = True, eps: float = 1e-6) -> DataFrame:
    """Threshold that parts a histogram best; the first bin centre of the largest between-class variance.

    Constant input returns its value.
    """
    x = F.ln(F.col(value) + eps) if log else F.col(value)
    base = df.select(*keys, x.alias("x")).where("x IS NOT NULL")
    by = Window.partitionBy(*keys)
    ends = base.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = base.join(ends, keys).where("hi > lo").withColumn("b", F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)).cast("int"))
    held = binned.groupBy(*keys, "lo", "hi", "total", "b").agg(F.count(F.lit(1)).alias("c"))
    centre = F.col("lo") + (F.col("b") + 0.5) * width
    upto = by.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    cum = held.withColumn("centre", centre).withColumns({"w0": F.sum("c").over(upto), "s0": F.sum(F.col("c") * F.col("centre")).over(upto), "s": F.sum(F.col("c") * F.col("centre")).over(by)})
    w1 = F.col("total") - F.col("w0")
    between = F.col("w0") * w1 * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.nullif(w1, F.lit(0)), F.lit(2.0))
    best = cum.withColumn("between", between).groupBy(*keys).agg(F.max_by("centre", F.struct("between", -F.col("b"))).alias("cut"))
    cut = F.coalesce("cut", "lo")
    out = ends.join(best, keys, "left")
    return out.select(*keys, (F.exp(cut) - eps if log else cut).alias("threshold"))


def window_to_second(windows: DataFrame, keys: list[str], size: int = 10) -> DataFrame:
    """A window's prediction stands at its middle second; other seconds up to n + size - 1 are 0."""
    spans = windows.groupBy(*keys).agg((F.max("w_idx") + size).alias("n"))
    grid = spans.select(*keys, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("sec"))
    placed = windows.select(*keys, (F.col("w_idx") + size // 2).alias("sec"), "walk")
    return grid.join(placed, [*keys, "sec"], "left").select(*keys, "sec", F.coalesce("walk", F.lit(0)).alias("walk"))


def runs(df: DataFrame, keys: list[str], at: str, state: str) -> DataFrame:
    """Maximal runs of one state in order: state, start, end, length."""
    by = Window.partitionBy(*keys).orderBy(at)
    marked = df.withColumn("_new", F.coalesce((~F.col(state).eqNullSafe(F.lag(state).over(by))).cast("int"), F.lit(1)))
    numbered = marked.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run", state).agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("length")).drop("_run")


def longest_run(df: DataFrame, keys: list[str], at: str, state: str) -> DataFrame:
    """The longest run in which state is true, the first on ties."""
    found = runs(df, keys, at, state).where(F.col(state))
    place = Window.partitionBy(*keys).orderBy(F.desc("length"), "start")
    return found.withColumn("_k", F.row_number().over(place)).where("_k = 1").select(*keys, "start", "end", "length")


def drop_edge_days(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Without the first and last calendar day of a key."""
    ends = df.groupBy(*keys).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    return df.join(ends, keys).where((F.col(day) > F.col("_lo")) & (F.col(day) < F.col("_hi"))).drop("_lo", "_hi")


def wear_validation(df: DataFrame, keys: list[str], value: str, hour: str, per_hour: int, least_hours: float = 72.0) -> DataFrame:
    """Worn hours, clock hours never seen, and whether the recording is long and complete enough."""
    seen = df.groupBy(*keys).agg((F.count(value) / per_hour).alias("wear_hours"), F.collect_set(F.when(F.col(value).isNotNull(), F.col(hour))).alias("_hours"))
    missing = F.size(F.array_except(F.sequence(F.lit(0), F.lit(23)), F.col("_hours")))
    return seen.select(*keys, "wear_hours", missing.alias("missing_hours"), ((F.col("wear_hours") >= least_hours) & (missing == 0)).alias("valid"))


def impute_levels(df: DataFrame, keys: list[str], values: list[str], levels: list[list[str]], at: str, longest: int) -> DataFrame:
    """W13 for several columns at once, in place: nulls become the mean of their group, level after level.

    Rows are dealt by key, which serves the windows of all levels: they are shuffled once, whatever the number of columns
    and levels.
    """
    out = df.repartition(*keys).withColumns({f"_f_{v}": F.col(v) for v in values})
    for level in levels:
        by = Window.partitionBy(*keys, *level)
        out = out.withColumns({f"_f_{v}": F.coalesce(f"_f_{v}", F.avg(f"_f_{v}").over(by)) for v in values})
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({f"_k_{v}": F.count(v).over(before) for v in values})
    gap = lambda v: F.count_if(F.col(v).isNull()).over(Window.partitionBy(*keys, f"_k_{v}"))
    out = out.withColumns({v: F.when(F.col(v).isNotNull() | (gap(v) <= longest), F.col(f"_f_{v}")) for v in values})
    return out.drop(*(f"_{c}_{v}" for c in "fk" for v in values))


def cascading_impute(df: DataFrame, keys: list[str], value: str, levels: list[list[str]], at: str, longest: int) -> DataFrame:
    """Nulls become the mean of their group, level after level; later levels see earlier fills.

    Gaps of more than `longest` rows, in order of `at`, are null again afterwards.
    """
    return impute_levels(df.withColumn("filled", F.col(value)), keys, ["filled"], levels, at, longest)


def rolling_median(df: DataFrame, keys: list[str], at: str, value: str, width: int) -> DataFrame:
    """Centred median of an even width over what there is: rows -width/2 to width/2 - 1."""
    frame = Window.partitionBy(*keys).orderBy(at).rowsBetween(-(width // 2), width - width // 2 - 1)
    return df.withColumn("rolling", F.percentile(value, F.lit(0.5)).over(frame))


def angle_change(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Absolute change from the row before, 0 at the first."""
    return df.withColumn("change", F.coalesce(F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(at))), F.lit(0.0)))


def sustained(df: DataFrame, keys: list[str], at: str, value: str, below: float, least: int) -> DataFrame:
    """Runs of at least `least` rows in which the value is below a bound."""
    return runs(df.withColumn("calm", F.coalesce(F.col(value) < below, F.lit(False))), keys, at, "calm").where(F.col("calm") & (F.col("length") >= least)).drop("calm")


def nonwear_vote(df: DataFrame, keys: list[str], i: str, axes: list[str], size: int, slide: int, sd: float, spread: float) -> DataFrame:
    """A position is non-wear if any window over it has two still axes; a last window ends at the end."""
    ends = df.groupBy(*keys).agg((F.max(i) + 1).alias("n"))
    starts = F.array_union(F.sequence(F.lit(0), F.col("n") - size, F.lit(slide)), F.array(F.col("n") - size))
    windows = ends.where(F.col("n") >= size).select(*keys, F.explode(F.transform(starts, lambda s: s.cast("int"))).alias("start")).distinct()
    # Each window covers whole blocks of `slide` positions but for its ends, so rows meet windows by block.
    blocked = windows.select(*keys, "start", F.explode(F.sequence(F.floor(F.col("start") / slide), F.floor((F.col("start") + size - 1) / slide))).alias("block"))
    rows = df.withColumn("block", F.floor(F.col(i) / slide))
    met = rows.join(blocked, [*keys, "block"]).where((F.col(i) >= F.col("start")) & (F.col(i) < F.col("start") + size))
    still = sum((((F.stddev_pop(a) < sd) & (F.max(a) - F.min(a) < spread)).cast("int") for a in axes[1:]), ((F.stddev_pop(axes[0]) < sd) & (F.max(axes[0]) - F.min(axes[0]) < spread)).cast("int"))
    voted = met.groupBy(*keys, "start").agg(still.alias("still")).where("still >= 2")
    flagged = met.join(voted, [*keys, "start"], "left_semi").select(*keys, i).distinct().withColumn("nonwear", F.lit(True))
    return df.join(flagged, [*keys, i], "left").withColumn("nonwear", F.coalesce("nonwear", F.lit(False)))


def night_blocks(sib: DataFrame, keys: list[str], start: str, end: str, gap: int, epoch_of_noon: int, per_day: int) -> DataFrame:
    """The longest block of each noon-to-noon night, the first on ties.

    The middle of a run of inactivity decides its night; within a night runs at most gap apart merge.
    """
    middle = F.floor((F.col(start) + F.col(end) + 1) / 2)
    night = sib.withColumn("night", F.floor((middle - epoch_of_noon) / per_day).cast("int"))
    order = Window.partitionBy(*keys, "night").orderBy(start)
    linked = night.withColumn("_new", (F.col(start) - F.lag(end).over(order) - 1 > gap).cast("int"))
    blocks = linked.withColumn("_b", F.sum(F.coalesce("_new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = blocks.groupBy(*keys, "night", "_b").agg(F.min(start).alias("start"), F.max(end).alias("end")).withColumn("length", F.col("end") - F.col("start") + 1)
    best = merged.groupBy(*keys, "night").agg(F.max(F.struct("length", (-F.col("start")).alias("s"), "start", "end")).alias("b"))
    return best.select(*keys, "night", "b.start", "b.end", "b.length")


def moving_average(df: DataFrame, keys: list[str], at: str, value: str, width: int) -> DataFrame:
    """Centred mean of an odd width; where the window is cut by an end the raw value stays."""
    k = width // 2
    frame = Window.partitionBy(*keys).orderBy(at).rowsBetween(-k, k)
    return df.withColumn("smooth", F.when(F.count(value).over(frame) == 2 * k + 1, F.avg(value).over(frame)).otherwise(F.col(value)))


def holm(df: DataFrame, keys: list[str], p: str, alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p-values and rejections within each family; null p-values stay out."""
    fam = Window.partitionBy(*keys)
    tested = df.where(F.col(p).isNotNull())
    raised = tested.withColumn("_r", (F.count(F.lit(1)).over(fam) - F.row_number().over(fam.orderBy(p)) + 1) * F.col(p))
    adj = F.least(F.max("_r").over(fam.orderBy(p).rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    return raised.withColumn("p_holm", adj).withColumn("reject", F.col("p_holm") < alpha).drop("_r")
