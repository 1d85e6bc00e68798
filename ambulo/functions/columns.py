"""Column expressions of the domain; each names its id in the operator inventory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours at which the parts of the day begin; night is the rest.
DAY_PARTS = {"morning": (6, 11), "afternoon": (12, 16), "evening": (17, 23), "night": (0, 5)}


def finite(c: Column) -> Column:
    """The value as double; NaN and infinities become null, as all statistics leave them out."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def half_away(c: Column, digits: int) -> Column:
    """Rounded as SQL engines round doubles: the product with a power of ten to the nearest whole, halves away from 0.

    Spark's round goes by the shortest decimal of the value, which differs where that ends in a 5.
    """
    scaled = c * 10.0**digits
    size = F.abs(scaled)
    low = F.floor(size)
    whole = F.when(size < 2.0**52, F.signum(scaled) * (low + (size - low >= 0.5).cast("int"))).otherwise(scaled)
    return F.when(F.abs(c) < 1e300, whole / 10.0**digits).otherwise(c)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds(ts: Column) -> Column:
    return F.floor(micros(ts) / 1_000_000).cast("long")


def grid_time(start: Column, i: Column, hz: float) -> Column:
    """Start plus i periods of whole milliseconds."""
    return F.timestamp_micros(micros(start) + i * (round(1000 / hz) * 1000)).cast("timestamp_ntz")


def magnitude(x: Column, y: Column, z: Column) -> Column:
    """Length of the acceleration."""
    return F.sqrt(x * x + y * y + z * z)


def enmo(x: Column, y: Column, z: Column) -> Column:
    """Length above one g, at least 0, in mg."""
    return F.greatest(magnitude(x, y, z) - 1, F.lit(0.0)) * 1000


def arm_angle(x: Column, y: Column, z: Column) -> Column:
    """Degrees of z over the xy plane."""
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def stride_length(speed: Column, cadence: Column) -> Column:
    """From median speed and cadence; null where cadence is not positive."""
    return F.when(cadence > 0, 120 * speed / cadence)


def positive(c: Column) -> Column:
    """1.0 above 0, else 0.0; null stays null."""
    return F.when(c.isNotNull(), (c > 0).cast("double"))


def at_least(c: Column, cut: float) -> Column:
    """P5: 1.0 from the cut-point on, else 0.0; null stays null."""
    return F.when(c.isNotNull(), (c >= cut).cast("double"))


def clock_hour(hour: Column) -> Column:
    """Hours from noon on count from the midnight to come, as negative numbers."""
    return F.when(hour >= 12, hour - 24).otherwise(hour)


def day_part(hour: Column) -> Column:
    return F.coalesce(*(F.when(hour.between(lo, hi), F.lit(name)) for name, (lo, hi) in DAY_PARTS.items()))


def normalized_id(c: Column) -> Column:
    """The first two numbers of an id without leading zeros, joined; other ids as they are."""
    parts = F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    first, second = F.get(parts, F.lit(0)).cast("bigint").cast("string"), F.get(parts, F.lit(1)).cast("bigint").cast("string")
    return F.coalesce(F.concat(first, F.lit("_"), second), c)


def subject_from_file(name: Column) -> Column:
    """Subject of a recording's file name; 20dd_ names keep leading zeros of their fourth and fifth parts."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    dated = F.concat_ws("_", F.regexp_extract(stem, r"^20\d\d_[^_]*_[^_]*_(\d+)_(\d+)", 1), F.regexp_extract(stem, r"^20\d\d_[^_]*_[^_]*_(\d+)_(\d+)", 2))
    return F.when(stem.rlike(r"^20\d\d_[^_]*_[^_]*_\d+_\d+"), dated).otherwise(normalized_id(stem))


def id_parts(c: Column) -> tuple[Column, Column]:
    """Participant and visit, split at the first underscore."""
    parts = F.split(c, "_", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
