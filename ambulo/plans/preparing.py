"""Raw recordings of events prepared for features, and still positions calibrated; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import preparing
from .sleep import RECORDING_SQL, recording
from .subjects import S, events, rounded

RULE = preparing.PrepareRule(hz=1 / 150, gap_sec=200, window_sec=900, patience_min=60, wear_hours=48, impute_min=90)


def _raw(spark, sf_dir: str):
    """The recording of the sleep stage with every thirteenth hour missing."""
    r = recording(spark, sf_dir).where("floor(i / 36) % 13 <> 7")
    return r.select("user_id", (F.col("start_sec") + F.col("i") * 100).alias("t"), "x", "y", "z")


def prepared_report(spark, sf_dir):
    """Each recording's worn hours and, if it does not pass, the reason."""
    return rounded(preparing.prepare(_raw(spark, sf_dir), S, RULE).report)


def prepared_days(spark, sf_dir):
    """What good recordings hold, by day."""
    good = preparing.prepare(_raw(spark, sf_dir), S, RULE).samples
    day = F.floor((F.col("start_sec") + F.col("i") * 150) / 86_400).alias("day")
    return rounded(good.groupBy("user_id", day).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in ("x", "y", "z", "enmo"))))


def resampled_points(spark, sf_dir):
    """G1: raw recordings on a grid of 150 seconds."""
    return rounded(preparing.resampled(_raw(spark, sf_dir), S, RULE).withColumnRenamed("at", "place"))


#: Gains and offsets that the still positions are read with.
GAIN, OFFSET = (1.05, 0.97, 1.02), (0.03, -0.02, 0.01)


def gravity_calibration(spark, sf_dir):
    """G1: the device's gains and offsets, from still positions whose direction follows from the event."""
    e = events(spark, sf_dir).where("value IS NOT NULL")
    a, b = F.col("event_id") * 0.7, F.col("value") * 0.9 + F.col("event_id") * 0.11
    turned = (F.cos(a) * F.cos(b), F.sin(a) * F.cos(b), F.sin(b))
    still = e.select("user_id", *(((d - o) / g).alias(n) for n, d, g, o in zip("xyz", turned, GAIN, OFFSET, strict=True)))
    found = preparing.gravity(still, S)
    return found.select("user_id", "n", "used", *((F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("ox", "oy", "oz", "gx", "gy", "gz")))


QUERIES = {f.__name__: f for f in (prepared_report, prepared_days, resampled_points, gravity_calibration)}

_RAW = f"{RECORDING_SQL}, rw AS MATERIALIZED (SELECT user_id, start_sec + i * 100 AS t, x, y, z FROM sm WHERE i // 36 % 13 <> 7)"
_POINTS = """{name} AS MATERIALIZED (SELECT user_id, g, {values} FROM (SELECT *, unnest(range(CAST(ceil(t / 150.0::DOUBLE) AS BIGINT), 1 + CASE WHEN tn - t <= 200 THEN CAST(ceil(tn / 150.0::DOUBLE) AS BIGINT) - 1 ELSE CAST(floor(t / 150.0::DOUBLE) AS BIGINT) END)) AS g
   FROM (SELECT *, lead(t) OVER o AS tn, lead(x) OVER o AS xn, lead(y) OVER o AS yn, lead(z) OVER o AS zn FROM {rows} WINDOW o AS (PARTITION BY user_id ORDER BY t))))"""
_VALUES = ", ".join(f"CASE WHEN g * 150 = t THEN {a} ELSE {a} + ({a}n - {a}) * (g * 150 - t)::DOUBLE / (tn - t) END AS {a}" for a in "xyz")
_FILL = lambda n, key, src: f"f{n} AS (SELECT * REPLACE ({', '.join(f'coalesce({a}, avg({a}) OVER (PARTITION BY user_id, {key})) AS {a}' for a in 'xyz')}) FROM {src})"
_PREPARED = f"""{_RAW},
 wn AS (SELECT user_id, t // 900 AS win, stddev_pop(x) < 0.013 AND stddev_pop(y) < 0.013 AND stddev_pop(z) < 0.013 AS still FROM rw GROUP BY ALL),
 w1 AS (SELECT *, CASE WHEN still IS DISTINCT FROM lag(still) OVER (PARTITION BY user_id ORDER BY win) THEN 1 ELSE 0 END AS new FROM wn),
 w2 AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY win ROWS UNBOUNDED PRECEDING) AS run FROM w1),
 off AS (SELECT user_id, min(win) AS a, max(win) AS b FROM w2 WHERE still GROUP BY user_id, run HAVING count(*) >= 4),
 wo AS MATERIALIZED (SELECT rw.user_id, t, CASE WHEN off.a IS NULL THEN x END AS x, CASE WHEN off.a IS NULL THEN y END AS y, CASE WHEN off.a IS NULL THEN z END AS z FROM rw LEFT JOIN off ON off.user_id = rw.user_id AND t // 900 BETWEEN a AND b),
 {_POINTS.format(name="rs", rows="wo", values=_VALUES)},
 vd AS MATERIALIZED (SELECT user_id, count(x) / 24.0::DOUBLE AS wear_hours, (24 - count(DISTINCT CASE WHEN x IS NOT NULL THEN g // 24 % 24 END))::INTEGER AS missing_hours FROM rs GROUP BY user_id),
 fd AS (SELECT user_id, unnest(range(min(g) // 576 * 576, (max(g) // 576 + 1) * 576)) AS g FROM rs JOIN vd USING (user_id) WHERE wear_hours >= 48 AND missing_hours = 0 GROUP BY user_id),
 f0 AS (SELECT fd.user_id, fd.g, x, y, z, x AS was, (fd.g // 576 + 3) % 7 AS wd, (fd.g // 576 + 3) % 7 >= 5 AS we, fd.g % 576 AS m FROM fd LEFT JOIN rs ON rs.user_id = fd.user_id AND rs.g = fd.g),
 {_FILL(1, "wd, m", "f0")}, {_FILL(2, "we, m", "f1")}, {_FILL(3, "m", "f2")},
 f4 AS (SELECT *, count(was) OVER (PARTITION BY user_id ORDER BY g ROWS UNBOUNDED PRECEDING) AS known FROM f3),
 f5 AS (SELECT user_id, g, g // 576 AS day, CASE WHEN was IS NOT NULL OR count(*) FILTER (WHERE was IS NULL) OVER (PARTITION BY user_id, known) <= 36 THEN x END AS x, y, z FROM f4),
 f6 AS (SELECT *, CASE WHEN (x IS NULL) IS DISTINCT FROM lag(x IS NULL) OVER (PARTITION BY user_id ORDER BY g) THEN 1 ELSE 0 END AS new FROM f5),
 f7 AS MATERIALIZED (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY g ROWS UNBOUNDED PRECEDING) AS run FROM f6),
 lr AS (SELECT user_id, run FROM f7 WHERE x IS NOT NULL GROUP BY user_id, run QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(g)) = 1),
 ip AS (SELECT f7.* FROM f7 JOIN lr USING (user_id, run)),
 gd AS MATERIALIZED (SELECT ip.* FROM ip JOIN (SELECT user_id, min(day) AS lo, max(day) AS hi FROM ip GROUP BY user_id) USING (user_id) WHERE day > lo AND day < hi),
 st2 AS (SELECT user_id, count(*) AS n_samples FROM gd GROUP BY user_id)"""

ORACLE_SQL = {
    "prepared_report": f"""WITH {_PREPARED} SELECT user_id, round(wear_hours, 6) AS wear_hours, missing_hours, false AS calibrated, coalesce(n_samples, 0) AS n_samples,
 CASE WHEN wear_hours < 48 THEN 'worn too short' WHEN missing_hours > 0 THEN 'hours missing' WHEN n_samples IS NULL THEN 'nothing left' END AS reason FROM vd LEFT JOIN st2 USING (user_id)""",
    "prepared_days": f"WITH {_PREPARED} SELECT user_id, day, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, round(avg(greatest(sqrt(x * x + y * y + z * z) - 1, 0) * 1000), 6) AS enmo FROM gd GROUP BY user_id, day",
    "resampled_points": f"WITH {_RAW}, {_POINTS.format(name='rs', rows='rw', values=_VALUES)} SELECT user_id, g AS place, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM rs",
    "gravity_calibration": f"SELECT user_id, count(*) AS n, true AS used, {', '.join(f'{v}::DOUBLE AS {p}{a}' for p, vs in (('o', OFFSET), ('g', GAIN)) for a, v in zip('xyz', vs, strict=True))} FROM events WHERE value IS NOT NULL GROUP BY user_id",
}
