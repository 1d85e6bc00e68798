"""From raw samples to recordings that features are made of (G1, G2): calibration, non-wear, resampling, validation,
imputation. A recording that does not pass is a row with its reason, and the others go on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import enmo
from ..sources.stored import stored
from . import sequence

AXES = ("x", "y", "z")
HOUR, DAY = 3600, 86_400
#: A calibration needs still windows beyond so many g on either side of every axis.
COVERED = 0.3
ROUNDS = 4


@dataclass(frozen=True)
class PrepareRule:
    """Settings of the preparation; samples further apart than gap_sec are not joined by interpolation."""

    hz: float
    gap_sec: float = 1.0
    window_sec: float = 10
    patience_min: float = 120
    still_sd: float = 0.013
    wear_hours: float = 72
    all_hours: bool = True
    impute_min: float = 180
    drop_edges: bool = True


@dataclass(frozen=True)
class Prepared:
    """samples(keys, i, start_sec, x, y, z, enmo) of good recordings; report(keys, .., reason), a row for every one."""

    samples: DataFrame
    report: DataFrame


def still_windows(samples: DataFrame, keys: list[str], rule: PrepareRule) -> DataFrame:
    """keys, win, the mean of each axis, and whether no axis moves in that window."""
    sd = [F.coalesce(F.stddev_pop(a) < rule.still_sd, F.lit(False)) for a in AXES]
    return samples.groupBy(*keys, F.floor(F.col("t") / rule.window_sec).alias("win")).agg(*(F.avg(a).alias(a) for a in AXES), (sd[0] & sd[1] & sd[2]).alias("still"))


def _solved(df: DataFrame, keys: list[str], start: bool) -> DataFrame:
    """Offsets and gains from normal equations a (n x n, row by row) and b; start: those of the ellipsoid, else a step."""
    names = [f"o{a}" for a in AXES] + [f"g{a}" for a in AXES]
    kept = [*keys, *names] if not start else keys

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                a, b = (np.array(batch.column(c)[i].as_py(), float) for c in ("a", "b"))
                before = np.array([0.0] * 3 + [1.0] * 3) if start else np.array([batch.column(n)[i].as_py() for n in names])
                found = np.linalg.lstsq(a.reshape(6, 6), b, rcond=1e-12)[0] if np.isfinite(a).all() else np.zeros(6)
                if start:  # sum of q v^2 + p v = 1: an ellipsoid along the axes
                    q, p = found[:3], found[3:]
                    if (q > 0).all():
                        centre = -p / (2 * q)
                        gain = np.sqrt(q / (1 + (q * centre**2).sum()))
                        before = np.concatenate([-gain * centre, gain])
                else:
                    before = before - found
                rows.append(before)
            v = np.array(rows).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(v[:, k]) for k in range(6))], [*keys, *names])

    shown = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*kept, "a", "b").mapInArrow(run, f"{shown}, " + ", ".join(f"{n} double" for n in names))


def _equations(df: DataFrame, keys: list[str], row: list[Column], aim: Column, more: list[str]) -> DataFrame:
    cells = [F.sum(p * q) for p in row for q in row]
    return df.groupBy(*keys, *more).agg(F.array(*cells).alias("a"), F.array(*(F.sum(p * aim) for p in row)).alias("b"))


def gravity(windows: DataFrame, keys: list[str], rounds: int = ROUNDS) -> DataFrame:
    """G1: keys, offsets o and gains g of each axis (calibrated = o + g * raw), n, the mean errors before and after, and
    whether they are to be used.

    windows(keys, x, y, z): means of still windows, which lie on a unit sphere once calibrated. The ellipsoid through
    them gives a start, and Gauss-Newton steps on their distance from the sphere follow; each is one aggregation of
    normal equations by recording, and all of them one plan. They are used if the windows cover both sides of every axis
    and the error falls.
    """
    v = [F.col(a) for a in AXES]
    whole = windows.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND abs(x) < 2 AND abs(y) < 2 AND abs(z) < 2").select(*keys, *AXES).hint("merge")  # not broadcast for a small file
    found = _solved(_equations(whole, keys, [c * c for c in v] + v, F.lit(1.0), []), keys, True)
    names = [f"o{a}" for a in AXES] + [f"g{a}" for a in AXES]
    for _ in range(rounds):
        met = whole.join(found, keys)
        c = [F.col(f"o{a}") + F.col(f"g{a}") * F.col(a) for a in AXES]
        r = F.sqrt(c[0] * c[0] + c[1] * c[1] + c[2] * c[2])
        slope = [x / r for x in c] + [x * F.col(a) / r for x, a in zip(c, AXES, strict=True)]
        found = _solved(_equations(met, keys, slope, r - 1, names), keys, False)
    met = whole.join(found, keys)
    length = lambda x, y, z: F.abs(F.sqrt(x * x + y * y + z * z) - 1)
    after = length(*(F.col(f"o{a}") + F.col(f"g{a}") * F.col(a) for a in AXES))
    sides = [F.min(a) < -COVERED for a in AXES] + [F.max(a) > COVERED for a in AXES]
    covered = sides[0] & sides[1] & sides[2] & sides[3] & sides[4] & sides[5]
    out = met.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("n"), F.avg(length(*v)).alias("before"), F.avg(after).alias("after"), covered.alias("_c"))
    return out.withColumn("used", F.col("_c") & (F.col("after") < F.col("before"))).drop("_c")


def calibrated(samples: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
    """samples with calibrated axes, where the calibration of their recording is to be used."""
    names = [f"{p}{a}" for p in "og" for a in AXES]
    met = samples.join(found.where("used").select(*keys, *names), keys, "left")
    return met.withColumns({a: F.coalesce(F.col(f"o{a}") + F.col(f"g{a}") * F.col(a), F.col(a)) for a in AXES}).drop(*names)


def off_wrist(samples: DataFrame, windows: DataFrame, keys: list[str], rule: PrepareRule) -> DataFrame:
    """samples whose axes are null in runs of still windows that last for the patience or longer."""
    runs = sequence.runs(windows.select(*keys, "win", "still"), keys, "win", "still").where(F.col("still") & (F.col("length") * rule.window_sec >= rule.patience_min * 60))
    off = runs.select(*keys, F.explode(F.sequence("start", "end")).alias("_win")).withColumn("_off", F.lit(True))
    # Runs grow when they are spread out, which a guess of their size does not see: never broadcast.
    marked = samples.withColumn("_win", F.floor(F.col("t") / rule.window_sec)).join(off.hint("merge"), [*keys, "_win"], "left")
    return marked.withColumns({a: F.when(F.col("_off").isNull(), F.col(a)) for a in AXES}).drop("_win", "_off")


def _second(rule: PrepareRule) -> Column:
    """The time of a point of the grid; rounded, so that whole seconds are whole."""
    return F.round(F.col("at") * (1 / rule.hz), 6)


def resampled(samples: DataFrame, keys: list[str], rule: PrepareRule) -> DataFrame:
    """G1: keys, at (whole periods since 1970) and the axes, by straight lines between the samples around each point.

    A point at a sample has its values; between a sample and a null one, or across more than gap_sec, there are none.
    Each sample makes the points up to the next one, so nothing is joined.
    """
    order = Window.partitionBy(*keys).orderBy("t")
    ahead = samples.select(*keys, "t", *AXES, F.lead("t").over(order).alias("_t"), *(F.lead(a).over(order).alias(f"_{a}") for a in AXES))
    # Times and points that differ by the last digits only are the same.
    first = F.ceil(F.col("t") * rule.hz - 1e-9)
    last = F.when(F.col("_t") - F.col("t") <= rule.gap_sec, F.ceil(F.col("_t") * rule.hz - 1e-9) - 1).otherwise(F.floor(F.col("t") * rule.hz + 1e-9))
    points = ahead.withColumns({"_lo": first, "_hi": last}).where("_hi >= _lo").withColumn("at", F.explode(F.sequence("_lo", "_hi")))
    there = _second(rule)
    share = (there - F.col("t")) / (F.col("_t") - F.col("t"))
    value = lambda a: F.when(F.abs(there - F.col("t")) < 1e-6, F.col(a)).otherwise(F.col(a) + (F.col(f"_{a}") - F.col(a)) * share)
    return points.select(*keys, "at", *(value(a).alias(a) for a in AXES))


def prepare(samples: DataFrame, keys: list[str], rule: PrepareRule) -> Prepared:
    """Recordings of samples(keys, t in seconds, x, y, z), one row for each time.

    Calibrated, without off-wrist time, on a uniform grid of whole days; worn long enough and in every hour of the day;
    gaps of up to impute_min filled with the mean of the same minute of the same weekday, else of weekdays or weekends,
    else of all days; of what is whole then the longest piece, without its first and last day. Rows without a time or
    with a null axis are no samples. Reasons: no samples, worn too short, hours missing, nothing left.
    """
    raw = samples.select(*keys, F.col("t").cast("double").alias("t"), *(F.nanvl(F.col(a).cast("double"), F.lit(None).cast("double")).alias(a) for a in AXES))
    real = raw.where(" AND ".join(f"{c} IS NOT NULL" for c in ("t", *AXES)))
    windows = stored(still_windows(real, keys, rule))
    found = stored(gravity(windows.where("still"), keys))
    worn = off_wrist(calibrated(real, keys, found), windows, keys, rule)
    grid = stored(resampled(worn, keys, rule))
    second = _second(rule)
    hour = F.floor(second / HOUR) % 24
    seen = grid.groupBy(*keys).agg((F.count("x") / (rule.hz * HOUR)).alias("wear_hours"), (24 - F.count_distinct(F.when(F.col("x").isNotNull(), hour))).cast("int").alias("missing_hours"))
    valid = (F.col("wear_hours") >= rule.wear_hours) & ((F.col("missing_hours") == 0) | F.lit(not rule.all_hours))
    ends = grid.join(seen.where(valid), keys, "left_semi").groupBy(*keys).agg(F.floor(F.min(second) / DAY).alias("_lo"), F.floor(F.max(second) / DAY).alias("_hi"))
    per_day = round(DAY * rule.hz)
    # The stored grid is far smaller in its file than in memory: never broadcast.
    whole = ends.select(*keys, F.explode(F.sequence(F.col("_lo") * per_day, (F.col("_hi") + 1) * per_day - 1)).alias("at")).join(grid.hint("merge"), [*keys, "at"], "left")
    day = F.floor(second / DAY)
    full = whole.withColumns({"_wd": F.pmod(day + 3, F.lit(7)), "_minute": F.floor(second / 60) % 1440}).withColumn("_we", F.col("_wd") >= 5)
    longest = int(rule.impute_min * 60 * rule.hz)
    full = sequence.impute_levels(full, keys, list(AXES), [["_wd", "_minute"], ["_we", "_minute"], ["_minute"]], "at", longest)
    filled = stored(full.select(*keys, "at", day.alias("day"), *AXES))
    piece = sequence.longest_run(filled.withColumn("there", F.col("x").isNotNull()), keys, "at", "there").select(*keys, F.col("start").alias("_lo"), F.col("end").alias("_hi"))
    inside = filled.hint("merge").join(piece, keys).where(F.col("at").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    good = sequence.drop_edge_days(inside, keys, "day") if rule.drop_edges else inside
    starts = good.groupBy(*keys).agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("n_samples"))
    out = good.join(starts, keys).select(*keys, (F.col("at") - F.col("_first")).cast("int").alias("i"), F.round(F.col("_first") * (1 / rule.hz)).cast("long").alias("start_sec"), *AXES)
    report = raw.select(*keys).distinct().join(seen, keys, "left").join(found.select(*keys, F.col("used").alias("calibrated")), keys, "left").join(starts.drop("_first"), keys, "left")
    reason = (
        F.when(F.col("wear_hours").isNull(), "no samples").when(F.col("wear_hours") < rule.wear_hours, "worn too short")
        .when((F.col("missing_hours") > 0) & F.lit(rule.all_hours), "hours missing").when(F.col("n_samples").isNull(), "nothing left")
    )
    shown = report.select(*keys, "wear_hours", "missing_hours", F.coalesce("calibrated", F.lit(False)).alias("calibrated"), F.coalesce("n_samples", F.lit(0)).alias("n_samples"), reason.alias("reason"))
    return Prepared(out.withColumn("enmo", enmo(F.col("x"), F.col("y"), F.col("z"))), shown)
