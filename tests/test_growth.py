"""Steps that failed on larger tables or on rows that tie."""

import math
import time

import numpy as np
from pyspark.sql import functions as F

from ambulo.operators import calendar, preparing, sequence, signal, stats, summary as subject
from ambulo.plans import catalog, sleep, subjects

SF = "/root/testdata/sf0.001"

RULE = preparing.PrepareRule(hz=1.0, window_sec=10, patience_min=1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_samples_are_never_broadcast(spark, tmp_path):
    """a stored table's file is far smaller than its rows, and runs grow when spread out."""
    rows = spark.range(2000).select((F.col("id") % 2).alias("u"), F.floor(F.col("id") / 2).cast("double").alias("t"), *(F.lit(0.5).alias(a) for a in "xyz"))
    rows.write.parquet(f"{tmp_path}/rows")
    samples = spark.read.parquet(f"{tmp_path}/rows")
    windows = preparing.still_windows(samples, ["u"], RULE)
    windows.write.parquet(f"{tmp_path}/windows")
    windows = spark.read.parquet(f"{tmp_path}/windows")
    assert "Broadcast" not in plan(preparing.off_wrist(samples, windows, ["u"], RULE))
    assert "Broadcast" not in plan(preparing.gravity(windows.where("still"), ["u"]))
    assert preparing.off_wrist(samples, windows, ["u"], RULE).where("x IS NOT NULL").count() == 0


def test_imputation_shuffles_once(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0, None), (1, 1, 0, None, 4.0), (1, 2, 0, 3.0, None), (1, 3, 0, None, None)], "u int, at int, g int, a double, b double")
    got = sequence.impute_levels(df, ["u"], ["a", "b"], [["g"], []], "at", 1)
    assert plan(got).count("Exchange hashpartitioning") == 1
    assert [(r["a"], r["b"]) for r in got.orderBy("at").collect()] == [(1.0, 4.0), (2.0, 4.0), (3.0, None), (2.0, None)]
    assert got.columns == df.columns


def test_entropy_of_long_signals_is_quick():
    """half days were compared template by template."""
    x = np.random.default_rng(3).random(432).round(1)
    t = time.perf_counter()
    for _ in range(100):
        found = signal.sample_entropy(x)
    assert time.perf_counter() - t < 0.8
    near = np.abs(x[:, None] - x[None, :]) <= 0.15 * x.std()
    two = near[:430, :430] & near[1:431, 1:431]
    assert np.isclose(found, -np.log(((two & near[2:, 2:]).sum() - 430) / (two.sum() - 430)))


def test_samples_are_dealt_by_events(spark, monkeypatch):
    """parts sized by the bytes of events make a few tasks of all samples."""
    monkeypatch.setattr(sleep, "PART", 100)
    assert sleep.recording(spark, SF).rdd.getNumPartitions() == 10


def test_shapes_need_no_sleep(spark, monkeypatch):
    """the whole summary was computed, twice, for its shapes."""
    from ambulo.plans import summary

    monkeypatch.setattr(summary, "recording", lambda *a: 1 / 0)
    monkeypatch.setattr(summary, "features", lambda *a: 1 / 0)
    got = catalog.QUERIES["subject_shapes"](spark, SF)
    assert "dist_speed_shannon_entropy" in got.columns and "dist_speed_dip_stat" in got.columns and "n_bouts" not in got.columns and got.count() > 0


def test_first_of_rows_that_tie(spark):
    """rows of one time left the choice to the order of arrival."""
    rows = [(1, 0, 7.0), (1, 0, 3.0), (1, 0, 5.0)]
    for r in (rows, rows[::-1]):
        got = calendar.nearest_on_grid(spark.createDataFrame(r, "u int, t long, v double"), ["u"], "t", "v", 10, 4).collect()
        assert [g["value"] for g in got] == [3.0]


def test_first_of_equal_spans(spark):
    """equal spans whose sums differ by the last digits; the first counts."""
    profile = [0.1, 0.2, 0.3, 9.0, 0.3, 0.2, 0.1, 9.0]
    assert profile[0] + profile[1] + profile[2] > profile[4] + profile[5] + profile[6]
    df = spark.createDataFrame([(1, i, profile[i % 8]) for i in range(16)], "u int, h long, value double")
    assert calendar.l5_m10(df, ["u"], "h", "value", 8, 3, 4).first()["l5_onset_hour"] == 0.0


def test_sums_of_bouts_do_not_vary(spark):
    """F8: values of one second are summed in the order of their events."""
    rows = [(1, 5, k, v) for k, v in enumerate([0.1, 0.2, 0.3, 1e16, -1e16, 0.7])]
    found = set()
    for r in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = sequence.sessions(spark.createDataFrame(r, "u int, sec long, event_id int, v double"), ["u"], "sec", 10, ("event_id",))
        found |= {x["s"] for x in df.groupBy("u", "bout_id").agg(F.sum("v").alias("s")).collect()}
    assert len(found) == 1


def test_clock_hours_are_whole_epochs(spark):
    """hours since 1970 lost digits, which showed in the coefficient of variation of hours around midnight."""
    nights = [(1, 0, 5680573, 5680616), (1, 1, 5680801, 5680859), (1, 2, 5680957, 5680991)]
    epochs = spark.createDataFrame([(1, e, 1) for _, _, a, b in nights for e in range(a, b + 2)], "u int, i long, sib int")
    got = calendar.nightly_metrics(epochs, spark.createDataFrame(nights, "u int, night int, start long, end long"), ["u"], 300 / 3600).orderBy("night").collect()
    clock = [(a + min(b + 1, 5680992)) % 576 / 24 for _, _, a, b in nights]
    assert [r["midsleep_hour"] for r in got] == [h - 24 if h >= 12 else h for h in clock]
    assert [r["sleep_onset_hour"] for r in got] == [h - 24 if h >= 12 else h for h in (a % 288 / 12 for _, _, a, _ in nights)]


def test_moments_at_the_middle_of_a_digit(spark):
    """an excess kurtosis of 0.1171875 less the last digits of the SQL's sums; a mean of 0 has no cv."""
    counts = [0, 1, 0, 1, 1, 0, 2, 1, 0, 1, 1, 0, 0, 0, 0, 0, 1, 2, 1, 0, 0, 0, 0, 0, 0, 0, 0]
    rows = [(1, "n", float(v)) for v in counts] + [(1, "h", v) for v in (0.1, 0.2, -0.3)]
    long = spark.createDataFrame(rows, "u int, metric string, x double").withColumn("z", F.col("x")).coalesce(1)
    got = {r["name"]: r["value"] for r in subject.described(long, "u", "", False).collect()}
    mean = sum(counts) / len(counts)
    power = lambda k: sum((c - mean) ** k for c in counts) / len(counts)
    assert round(got["n_kurtosis"] + 0.0, 6) == round(power(4) / math.sqrt(power(2)) ** 4 - 3, 6) == 0.117187
    assert got["h_cv"] is None and got["n_cv"] is not None


def test_onset_hour_keeps_its_digits(spark):
    """the SQL does not round it."""
    got = catalog.QUERIES["sleep_rhythm"](spark, SF).where("rar_l5_onset_hour IS NOT NULL").select("rar_l5_onset_hour").collect()
    assert got and all(r[0] == round(r[0] * 12) / 12 for r in got)


def test_days_are_compared_where_they_are(spark):
    """F4 of round 4: the samples of every two days were shuffled, and statistics as rows; most of the summary's disk."""
    rows = [(u, d, float((u * 7 + d * 3 + k * k) % 11), None if k == 1 and d == 2 else float(k)) for u in range(3) for d in range(4) for k in range(2 + d)]
    df = spark.createDataFrame(rows, "u int, day int, a double, b double").repartition(3, "u")
    got = stats.day_drift(df, "u", "day", ["a", "b"], 3)
    assert plan(got).count("Exchange hashpartitioning") <= 2 and "REPARTITION_BY_NUM" in plan(got) and "ENSURE_REQUIREMENTS" not in plan(got)
    got = {r["u"]: r for r in got.collect()}
    for m in ("a", "b"):
        for r in stats.stability(stats.wasserstein_pairs(df, ["u"], "day", m, 3), ["u"]).collect():
            assert all(math.isclose(r[c], got[r["u"]][f"{m}_{c}"], abs_tol=1e-12) for c in ("mean_w1", "std_w1", "n_pairs"))


def test_summary_deals_each_table_once(spark):
    """F4 of round 4."""
    bouts = spark.range(400).select(F.col("id").alias("user_id"), F.lit(1).alias("bout_id"), F.lit(0).alias("day"), F.lit(3).alias("hour"), *(F.rand(k).alias(m) for k, m in enumerate(("duration_sec", *subject.CORE_METRICS))))
    wide = subject.summarize_subjects(bouts, bouts, None, None, None, "user_id", parts=4)
    assert "ENSURE_REQUIREMENTS" not in plan(wide) and wide.count() == 400


def test_epochs_are_not_dealt_by_epoch(spark):
    """F4 of round 4: epochs and non-wear met in a join by subject and epoch."""
    assert "ENSURE_REQUIREMENTS" not in plan(sleep.sleep_epochs(spark, SF))


def test_rows_of_one_second_go_by_their_events(spark, tmp_path):
    """F1 of round 4: the least value was taken, the SQL on one thread takes the first row."""
    spark.sql("SELECT 1L AS event_id, 1L AS user_id, TIMESTAMP_NTZ '2024-01-01 00:30:00.2' AS ts, 'a' AS event_type, 9.5D AS value UNION ALL SELECT 2L, 1L, TIMESTAMP_NTZ '2024-01-01 00:30:00.7', 'a', 9.25D").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert [r["value"] for r in catalog.QUERIES["nearest_reindex"](spark, str(tmp_path)).collect() if r["value"] is not None] == [9.5]


def test_rounding_is_that_of_the_sql(spark):
    """F2, F3 of round 4: halves of the last digit went by the value's shortest decimal."""
    import duckdb

    x = [65.5533325, 55.6636875, 47.7943975, 64.7026275, -65.5533325, 0.49999999999999994e-6, 7.075126108558942e16, 1e306, 0.0, *(round(k / 32 / 5 + 40, 7) for k in range(400))]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchall()[0][0] for v in x]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*x, None])], "i int, v double")
    assert [r["v"] for r in subjects.rounded(df).orderBy("i").collect()] == [*want, None]


def test_sums_of_a_rhythm_go_in_order_of_time(spark):
    """F2 of round 4: equal spans whose last digits decide, and slots whose sums varied with the order of arrival."""
    profile = [0.1, 0.2, 0.3, 9.0, 0.3, 0.2, 0.1, 9.0]
    rows = [(1, i, profile[i % 8]) for i in range(16)]
    for r in (rows, rows[::-1]):
        got = calendar.l5_m10(spark.createDataFrame(r, "u int, h long, value double"), ["u"], "h", "value", 8, 3, 4, equal=0.0).first()
        assert got["l5_onset_hour"] == 4 * 24 / 8 and got["l5"] == (0.3 + 0.2 + 0.1) / 3
    mixed = [(1, 8 * d, v) for d, v in enumerate((0.1, 1e16, -1e16, 0.7))]
    for r in (mixed, mixed[::-1], mixed[2:] + mixed[:2]):
        df = spark.createDataFrame(r, "u int, h long, value double").repartition(3)
        assert df.groupBy("u").agg(calendar.mean_in_order("value", "h").alias("p")).first()["p"] == (0.1 + 1e16 - 1e16 + 0.7) / 4


def test_statistics_of_a_subject_follow_the_sql(spark):
    """F3 of round 4: a mean of 0 but for its last digits has a cv in the SQL, and sums go in the order of the rows."""
    rows = [(1, i, v) for i, v in enumerate((0.1, 0.2, -0.3, 1e16, -1e16, 0.7, 0.4))]
    for r in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(r, "u int, at int, x double").repartition(3)
        got = subject._statistics(df, ["u"], ["at"], {"s": ("x", "x")}, True, 0.0).first()
        assert got["s_mean"] == (0.1 + 0.2 - 0.3 + 1e16 - 1e16 + 0.7 + 0.4) / 7 and got["s_median"] == 0.2 and got["s_mad"] is None
    near = spark.createDataFrame([(1, i, v) for i, v in enumerate((0.1, 0.2, -0.3))], "u int, at int, x double")
    mean = (0.1 + 0.2 - 0.3) / 3
    want = math.sqrt(sum((v - mean) ** 2 for v in (0.1, 0.2, -0.3)) / 3) / mean
    assert math.isclose(subject._statistics(near, ["u"], ["at"], {"s": ("x", "x")}, False, 0.0).first()["s_cv"], want, rel_tol=1e-12)
    assert subject._statistics(near, ["u"], ["at"], {"s": ("x", "x")}, False, 1e-14).first()["s_cv"] is None
