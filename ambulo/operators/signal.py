"""Kernels of bout signals that SQL cannot express, as grouped Arrow functions.

One bout is one group: bouts are minutes long, and sample entropy looks at its first two minutes only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pairs of values compared at once; they fit a processor's cache.
BLOCK = 40_000


def by_bout(df: DataFrame, keys: list[str], at: str, value: str, kernel, columns: dict[str, str]) -> DataFrame:
    """kernel(values in order) -> dict of columns, for each group."""
    fields = dict(df.select(*keys).dtypes)
    schema = ", ".join([*(f"{k} {fields[k]}" for k in keys), *(f"{c} {t}" for c, t in columns.items())])
    types = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "double": pa.float64()}

    def run(table):
        x = table[value].to_numpy()[np.argsort(table[at].to_numpy(), kind="stable")].astype(float)
        found = kernel(x[np.isfinite(x)])
        return pa.table({**{k: table[k].slice(0, 1) for k in keys}, **{c: pa.array([found[c]], types[t], from_pandas=True) for c, t in columns.items()}})

    return df.select(*keys, at, value).groupBy(*keys).applyInArrow(run, schema)


def _peaks(x: np.ndarray, apart: int) -> np.ndarray:
    """Local maxima, the middle of flat tops; of those closer than `apart` the higher stays."""
    out, i = [], 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            out.append((i + j) // 2)
        i = j + 1
    alive = dict.fromkeys(out, True)
    for p in sorted(out, key=lambda q: x[q], reverse=True):
        if alive[p]:
            for q in out:
                if q != p and abs(q - p) < apart:
                    alive[q] = False
    return np.array([p for p in out if alive[p]], int)


def stride_regularity(x: np.ndarray, hz: float) -> float:
    """Height of the second peak of the normalized biased autocovariance; 0 for bouts under two seconds or without one."""
    n = len(x)
    if n < int(2 * hz):
        return 0.0
    size = 1 << (2 * n - 1).bit_length()
    spectrum = np.fft.rfft(x - x.mean(), size)
    raw = np.fft.irfft(spectrum * np.conj(spectrum), size)[:n]
    if raw[0] <= 0:
        return 0.0
    raw = raw / raw[0]
    width = int(0.2 * hz) | 1
    smooth = raw.copy()
    if n >= width:
        smooth[width // 2 : n - width // 2] = np.convolve(raw, np.ones(width) / width, "valid")
    found = _peaks(smooth, max(1, int(hz / 4)))
    found = found[smooth[found] > 0]
    heights = smooth[found]
    if len(found) >= 2:
        # Each peak moves to the highest raw value from a reach before it to half a reach after.
        reach = int(np.ceil(0.2 * np.median(np.diff(found))))
        inner = found[(found > reach) & (found < n - reach)]
        moved = [p - reach + int(np.argmax(raw[p - reach : p + reach // 2 + 1])) for p in inner]
        kept: list[int] = []
        for p in reversed(moved):  # of two that moved together the higher stays, the later on ties
            if kept and kept[-1] - p < reach:
                if raw[p] > raw[kept[-1]]:
                    kept[-1] = p
            else:
                kept.append(p)
        heights = raw[kept[::-1]]
    return max(0.0, float(heights[1])) if len(heights) > 1 else 0.0


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.15, most: int = 3600) -> float | None:
    """-ln(B / A) of template matches of m + 1 and m values within r deviations, without self-matches; over 200 values."""
    x = x[:most]
    n = len(x)
    if n <= 200 or x.std() == 0:
        return None
    near = r * x.std()
    last = n - m
    shorter = longer = 0
    # Blocks of rows of the matrix of pairs, so that a long signal does not need all of it at once.
    step = max(1, BLOCK // n)
    for i in range(0, last, step):
        j = min(i + step, last)
        rows, columns = j - i, last - i
        # Pairs of values from row i and column i on; templates match where m of them on a diagonal are close.
        close = np.abs(x[i : j + m, None] - x[None, i:]) <= near
        both = close[:rows, :columns]
        for k in range(1, m):
            both = both & close[k : rows + k, k : columns + k]
        more = both & close[m : rows + m, m : columns + m]
        # The square at the diagonal holds each pair twice and each template with itself.
        count = lambda c: (np.count_nonzero(c[:, :rows]) - rows) // 2 + np.count_nonzero(c[:, rows:])
        shorter, longer = shorter + int(count(both)), longer + int(count(more))
    return -float(np.log(longer / shorter)) if shorter and longer else None


def psd_features(x: np.ndarray, hz: float, segment: int = 256) -> dict:
    """Dominant frequency, density, half-height width and their ratio from 0.5 to 6 Hz, by Welch's method.

    Hann windows with half overlap, mean removed. Width and ratio are null where a side does not fall to half.
    """
    none = dict.fromkeys(("dom_freq", "psd_amp", "psd_width", "psd_slope"))
    if len(x) < 2 * hz:
        return none
    x = x - x.mean()
    size = min(segment, len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    parts = np.lib.stride_tricks.sliding_window_view(x, size)[:: size - size // 2]
    power = np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2 / (hz * (window**2).sum())
    power[:, 1 : None if size % 2 else -1] *= 2
    freq, density = np.fft.rfftfreq(size, 1 / hz), power.mean(axis=0)
    band = (freq >= 0.5) & (freq <= 6.0)
    if not band.any():
        return none
    freq, density = freq[band], density[band]
    top = int(density.argmax())
    low = density <= density[top] / 2
    left, right = np.flatnonzero(low[:top]), np.flatnonzero(low[top:])
    out = {"dom_freq": float(freq[top]), "psd_amp": float(density[top]), "psd_width": None, "psd_slope": None}
    if len(left) and len(right):
        width = float(freq[top + right[0]] - freq[left[-1]])
        if width:
            out |= {"psd_width": width, "psd_slope": out["psd_amp"] / width}
    return out


def wasserstein_to_normal(x: np.ndarray, seed: int = 42, least: int = 30) -> float | None:
    """First Wasserstein distance to as many draws of the fitted normal, from a seeded generator."""
    if len(x) < least:
        return None
    drawn = np.random.RandomState(seed).normal(x.mean(), x.std(), len(x))
    return float(np.abs(np.sort(x) - np.sort(drawn)).mean())


def dip(x: np.ndarray, least: int = 30) -> float | None:
    """Hartigan's dip: the least distance of the empirical distribution to a unimodal one.

    For each mode interval the distance to the convex minorant before and the concave majorant after it; the classical
    algorithm shrinks the interval until the gap between both no longer decides.
    """
    n = len(x)
    if n < least:
        return None
    x = np.sort(x)
    if x[0] == x[-1]:
        return 1 / (2 * n)
    lo, hi, best = 0, n - 1, 1.0
    while True:
        lower = _hull(x[lo : hi + 1], np.arange(lo, hi + 1), -1)
        upper = _hull(x[lo : hi + 1], np.arange(lo, hi + 1), 1)
        at = x[lo : hi + 1]
        gap = np.interp(at, x[lo + upper], lo + upper + 1.0) - np.interp(at, x[lo + lower], lo + lower + 0.0)
        knots = np.unique(np.concatenate([lower, upper]))
        k = knots[int(np.argmax(gap[knots]))]
        widest = gap[k]
        new_lo, new_hi = lo + lower[lower <= k].max(), lo + upper[upper >= k].min()
        side = 0.0
        for a, b, hull in ((lo, new_lo, lower), (new_hi, hi, upper)):
            if b > a:
                span = x[a : b + 1]
                fit = np.interp(span, x[lo + hull], lo + hull + (0.0 if hull is lower else 1.0))
                steps = np.arange(a, b + 1)
                side = max(side, float(np.max(steps + 1 - fit) if hull is lower else np.max(fit - steps)))
        best_here = max(side, 1.0)
        if widest <= max(best, best_here) or (new_lo, new_hi) == (lo, hi):
            return max(best, best_here) / (2 * n)
        best, lo, hi = max(best, best_here), new_lo, new_hi


#: Sizes of the uniform samples whose dips are drawn, and how many of each.
DIP_SIZES, DIP_DRAWS = (30, 45, 70, 110, 180, 300, 550, 1000), 1000


def dip_null(spark: SparkSession, sizes: tuple[int, ...] = DIP_SIZES, draws: int = DIP_DRAWS, seed: int = 42) -> DataFrame:
    """N and dips, the sorted dips times sqrt(n) of uniform samples: a row for each size, drawn in parallel.

    Each sample has its own seed, so the table does not depend on how the work is parted.
    """
    todo = spark.createDataFrame([(n,) for n in sizes], "n int").crossJoin(spark.range(draws).withColumnRenamed("id", "r")).repartition(4 * spark.sparkContext.defaultParallelism, "n", "r")

    def run(batches):
        for b in batches:
            yield b.assign(d=[dip(np.random.default_rng([seed, n, r]).random(n)) * n**0.5 for n, r in zip(b["n"].tolist(), b["r"].tolist(), strict=True)])

    return todo.mapInPandas(run, "n int, r long, d double").groupBy("n").agg(F.sort_array(F.collect_list("d")).alias("dips"))


def with_dip_p(df: DataFrame, n: str, value: str, null: DataFrame) -> DataFrame:
    """Df with p, the share of uniform samples whose dip is at least as large; null dips have none.

    Between two sizes of the table p is interpolated by the logarithm of n, outside them the nearest counts. The table
    has as many rows as there are sizes, a few kilobytes each.
    """
    rows = F.broadcast(null.select(F.collect_list(F.struct(F.col("n").alias("m"), F.col("dips").alias("d"))).alias("_null")).select(F.sort_array("_null").alias("_null")))
    share = lambda s: F.size(F.filter(s["d"], lambda d: d >= F.col("_scaled"))) / F.size(s["d"])
    met = df.crossJoin(rows).withColumn("_scaled", F.col(value) * F.sqrt(n))  # one row
    below = F.filter("_null", lambda s: s["m"] <= F.col(n))
    above = F.filter("_null", lambda s: s["m"] > F.col(n))
    placed = met.withColumns({"_lo": F.when(F.size(below) > 0, F.element_at(below, -1)).otherwise(F.col("_null")[0]), "_hi": F.when(F.size(above) > 0, above[0]).otherwise(F.element_at("_null", -1))})
    step = F.coalesce(F.try_divide(F.ln(n) - F.ln("_lo.m"), F.ln("_hi.m") - F.ln("_lo.m")), F.lit(0.0))
    weight = F.least(F.greatest(step, F.lit(0.0)), F.lit(1.0))
    p = share(F.col("_lo")) * (1 - weight) + share(F.col("_hi")) * weight
    return placed.withColumn("p", F.when(F.col(value).isNotNull(), p)).drop("_null", "_scaled", "_lo", "_hi")


def _hull(x: np.ndarray, y: np.ndarray, sign: int) -> np.ndarray:
    """Indices of the greatest convex minorant (-1) or least concave majorant (1)."""
    out: list[int] = []
    for i in range(len(x)):
        while len(out) >= 2 and sign * ((y[out[-1]] - y[out[-2]]) * (x[i] - x[out[-2]]) - (y[i] - y[out[-2]]) * (x[out[-1]] - x[out[-2]])) <= 0:
            out.pop()
        out.append(i)
    return np.array(out)


def fixed_scorer(windows: np.ndarray) -> np.ndarray:
    """Stand-in for the trained networks, whose weights are not public: mean size of the window, squashed to 0..2."""
    return 2 / (1 + np.exp(-windows.mean(axis=1) / 100))


def score_windows(df: DataFrame, keys: list[str], values: str, scorer=fixed_scorer, batch: int = 512, out: str = "score") -> DataFrame:
    """A pluggable scorer over windows (arrays of equal length), in batches; the model travels with the task."""
    schema = ", ".join([*(f"{k} {t}" for k, t in df.select(*keys).dtypes), f"{out} double"])

    def run(frames):
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                yield part[keys].assign(**{out: scorer(np.stack(part[values].to_numpy()))})

    return df.select(*keys, values).mapInPandas(run, schema)


def match_weights(found: dict[str, tuple], wanted: dict[str, tuple], prefix: str = "", least: float = 0.5) -> dict[str, str]:
    """Names of stored arrays for the model's, by name without prefix and equal shape; an error below half."""
    stripped = {n.removeprefix(prefix): n for n in found}
    out = {n: stripped[n] for n, shape in wanted.items() if n in stripped and found[stripped[n]] == shape}
    if len(out) < least * len(wanted):
        raise ValueError(f"only {len(out)} of {len(wanted)} weights match")
    return out


def windows_of(df: DataFrame, keys: list[str], i: str, value: str, size: int, step: int) -> DataFrame:
    """Whole overlapping windows as arrays in order."""
    first = F.greatest(F.lit(0), F.ceil((F.col(i) - size + 1) / step)).cast("int")
    spread = df.select(*keys, i, value, F.explode(F.sequence(first, F.floor(F.col(i) / step).cast("int"))).alias("w_idx"))
    held = spread.groupBy(*keys, "w_idx").agg(F.sort_array(F.collect_list(F.struct(i, value))).alias("s")).where(F.size("s") == size)
    return held.select(*keys, "w_idx", F.transform("s", lambda s: s[value]).alias("window"))
