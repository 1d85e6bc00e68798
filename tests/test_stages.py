"""Preparation and sleep of recordings made by hand."""

import numpy as np
from pyspark.sql import functions as F

from ambulo.operators import preparing, sleep


def test_gravity_is_recovered_from_noisy_positions(spark):
    rng = np.random.default_rng(2)
    rows = []
    for user, (gain, off) in enumerate([((1.05, 0.95, 1.02), (0.04, -0.03, 0.02)), ((0.9, 1.1, 1.0), (-0.1, 0.0, 0.1))]):
        d = rng.normal(size=(4000, 3))
        d /= np.linalg.norm(d, axis=1)[:, None]
        v = (d + rng.normal(scale=0.005, size=d.shape) - off) / gain
        rows += [(user, *map(float, x)) for x in v]
    rows += [(2, 0.5 + 0.01 * k, 0.3, 0.8) for k in range(40)] + [(3, None, 1.0, 0.0)]
    got = {r["user"]: r for r in preparing.gravity(spark.createDataFrame(rows, "user int, x double, y double, z double"), ["user"]).collect()}
    assert np.allclose([got[0][c] for c in ("gx", "gy", "gz", "ox", "oy", "oz")], [1.05, 0.95, 1.02, 0.04, -0.03, 0.02], atol=1e-3)
    assert np.allclose([got[1][c] for c in ("gx", "gy", "gz", "ox", "oy", "oz")], [0.9, 1.1, 1.0, -0.1, 0.0, 0.1], atol=1e-3)
    assert got[0]["used"] and got[1]["used"] and not got[2]["used"] and 3 not in got
    assert got[0]["after"] < got[0]["before"] / 3


RULE = preparing.PrepareRule(hz=1 / 600, gap_sec=700, window_sec=1800, patience_min=120, wear_hours=72, impute_min=60)


def test_failing_recordings_are_rows_with_reasons(spark):
    def user(name, hours, keep=lambda h: True):
        return [(name, 600.0 * k, 0.1 * (k % 7), 0.2 * (k % 5), 0.3 * (k % 3)) for k in range(hours * 6) if keep(k // 6)]

    rows = user("good", 144) + user("short", 50) + user("nights only", 300, lambda h: h % 24 < 8) + user("two days", 96, lambda h: not 45 <= h < 61)
    rows += [("null", None, 0.0, 0.0, 0.0), ("null", 5.0, None, 0.0, 0.0), ("nan", 5.0, float("nan"), 0.0, 0.0)]
    rows += user("gap", 168, lambda h: h != 60) + [("still", 600.0 * k, 0.0, 0.0, 1.0) for k in range(900)]
    out = preparing.prepare(spark.createDataFrame(rows, "user string, t double, x double, y double, z double"), ["user"], RULE)
    report = {r["user"]: r for r in out.report.collect()}
    assert {u: r["reason"] for u, r in report.items()} == {
        "good": None, "short": "worn too short", "nights only": "hours missing", "two days": "nothing left", "null": "no samples", "nan": "no samples", "gap": None, "still": "worn too short",
    }
    held = {r["user"]: (r["n"], r["first"], r["last"]) for r in out.samples.groupBy("user").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"), F.max("i").alias("last")).collect()}
    assert held == {"good": (4 * 144, 0, 575), "gap": (5 * 144, 0, 719)}  # without edge days; the hour that is missing is filled
    assert report["good"]["n_samples"] == 576 and report["good"]["wear_hours"] > 143
    assert out.samples.where("x IS NULL").count() == 0
    empty = preparing.prepare(spark.createDataFrame([], "user string, t double, x double, y double, z double"), ["user"], RULE)
    assert empty.report.count() == 0 == empty.samples.count()


def test_points_lie_on_lines_between_samples(spark):
    rule = preparing.PrepareRule(hz=2.0, gap_sec=1.0)
    rows = [(0.0, 1.0), (0.75, 4.0), (1.5, None), (2.0, 2.0), (3.5, 8.0)]
    df = spark.createDataFrame([("u", t, x, x, x) for t, x in rows], "k string, t double, x double, y double, z double")
    got = {r["at"]: r["x"] for r in preparing.resampled(df, ["k"], rule).collect()}
    assert got == {0: 1.0, 1: 3.0, 2: None, 3: None, 4: 2.0, 7: 8.0}


def test_a_night_of_known_length(spark):
    """Two days of one sample a minute: calm from 23:00 to 06:00 but for twenty minutes at 02:00, off the wrist at noon."""
    rows = []
    for i in range(2 * 1440):
        hour = i / 60 % 24
        asleep = (hour >= 23 or hour < 6) and not 2 <= hour < 2 + 1 / 3
        if 12 <= hour < 14:
            x, y, z = 0.9, 0.1, 0.2
        elif asleep:
            x, y, z = 0.9 + 0.04 * (i % 2), 0.1 + 0.04 * (i // 2 % 2), 0.2
        else:
            x, y, z = 0.1 * (i * 7 % 10), 0.3, 0.15 * (i * 3 % 11)
        rows.append(("u", i, 0, x, y, z, 100.0 if not asleep else 1.0))
    df = spark.createDataFrame(rows, "k string, i int, start_sec long, x double, y double, z double, enmo double")
    got = sleep.sleep_features(df, ["k"], sleep.SleepRule(1 / 60, epoch_sec=300, smooth_min=15, grid_min=5))
    nights = {r["night"]: r for r in got.nights.collect()}
    assert set(nights) == {-1, 0}  # the last hour of the second day is no whole hour of calm changes
    full = nights[0]
    assert abs(full["sleep_onset_hour"] - -1) < 0.2 and abs(full["wake_time_hour"] - 6) < 0.2 and abs(full["spt_hours"] - 7) < 0.3
    assert full["awakenings"] == 1 and 0.2 < full["waso_hours"] < 0.6 and abs(full["sleep_efficiency"] - 0.95) < 0.04
    r = got.rhythm.first()
    assert r["rar_m10"] == 100.0 and r["rar_l5"] < 10 and r["rar_ra"] > 0.8 and 22 <= r["rar_l5_onset_hour"] + 24 * (r["rar_l5_onset_hour"] < 12) <= 26 and r["rar_sri"] > 90
    empty = sleep.sleep_features(df.where("false"), ["k"], sleep.SleepRule(1 / 60, epoch_sec=300))
    assert empty.nights.count() == 0 == empty.rhythm.count()
