"""Operators against NumPy and small hand-made cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ambulo.functions import columns
from ambulo.operators import calendar, inference, learning, relational, sequence, signal, stats
from ambulo.sources import recordings
from ambulo.streaming.bouts import stream_bouts


def one(df):
    return df.collect()[0].asDict()


def test_moments_need_more_than_three_values(spark):
    df = spark.createDataFrame([(k, float(v)) for k, n in ((2, 2), (3, 3), (4, 4)) for v in range(n)] + [(9, 5.0)] * 6 + [(8, None)], "k int, v double")
    out = {r["k"]: r for r in stats.describe(df, ["k"], "v", "v").collect()}
    assert out[3]["v_skewness"] is None and out[4]["v_skewness"] == 0.0
    assert out[9]["v_kurtosis"] is None and out[9]["v_std"] == 0.0
    assert out[8]["v_n"] == 0 and out[8]["v_median"] is None
    x = np.arange(4.0)
    assert abs(out[4]["v_kurtosis"] - (((x - x.mean()) ** 4).mean() / x.var() ** 2 - 3)) < 1e-12


def test_mad_and_l_moments_start_at_thirty(spark):
    rng = np.random.default_rng(0)
    x = rng.gamma(2, 3, 30)
    df = spark.createDataFrame([(30, float(v)) for v in x] + [(29, float(v)) for v in x[:29]], "k int, v double")
    mads = {r["k"]: r["mad"] for r in stats.mad(df, ["k"], "v").collect()}
    assert mads[29] is None and abs(mads[30] - np.median(np.abs(x - np.median(x)))) < 1e-12
    out = stats.l_moments(df, ["k"], "v").collect()
    s = np.sort(x)
    n = 30
    b = [s.mean()] + [np.mean([np.prod([(i - j) / (n - 1 - j) for j in range(r)]) * s[i] for i in range(n)]) for r in (1, 2, 3)]
    assert len(out) == 1 and abs(out[0]["l_skewness"] - (6 * b[2] - 6 * b[1] + b[0]) / (2 * b[1] - b[0])) < 1e-9


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.999, 1.0, 9.99, 10.0, 10.001, -0.1)], "v double").withColumn("k", F.lit(1))
    out = one(stats.histogram(df, ["k"], "v", 0.0, 10.0))
    assert [out[f"freq_bin{i}"] for i in range(10)] == np.histogram([0, 0.999, 1, 9.99, 10], 10, (0, 10))[0].tolist()


def test_wasserstein_is_symmetric_and_zero_on_itself(spark):
    a, b = [1.0, 2.0, 5.0, 9.0], [2.0, 2.0, 4.0, 20.0]
    rows = [(d, v) for d, x in ((1, a), (2, b), (3, a)) for v in x]
    out = {(r["a"], r["b"]): r["w1"] for r in stats.wasserstein_pairs(spark.createDataFrame(rows, "d int, v double").withColumn("k", F.lit(1)), ["k"], "d", "v", 4).collect()}
    assert abs(out[1, 2] - np.abs(np.sort(a) - np.sort(b)).mean()) < 1e-12 and out[1, 3] == 0 and out[2, 3] == out[1, 2]


def test_bouts_merge_at_three_seconds_and_last_ten(spark):
    walk = [*range(0, 6), *range(9, 14), *range(18, 27), *range(40, 50)]  # gaps of 3, 4 and 13 seconds
    df = spark.createDataFrame([("a", s, int(s in walk)) for s in range(60)], "subject_id string, sec int, walk int")
    out = [(r["bout_id"], r["start_sec"], r["end_sec"]) for r in sequence.merge_bouts(df).orderBy("start_sec").collect()]
    assert out == [(1, 0, 14), (2, 40, 50)]


def test_runs_and_longest(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([True, True, False, True, True, None, None])], "k int, i int, s boolean")
    assert [(r["start"], r["end"], r["length"]) for r in sequence.runs(df, ["k"], "i", "s").orderBy("start").collect()] == [(0, 1, 2), (2, 2, 1), (3, 4, 2), (5, 6, 2)]
    assert one(sequence.longest_run(df, ["k"], "i", "s"))["start"] == 0


def test_otsu_of_constant_and_two_heaps(spark):
    df = spark.createDataFrame([(1, 5.0)] * 4 + [(2, v) for v in (1.0, 1.1, 0.9, 9.0, 9.1, 8.9)], "k int, v double")
    out = {r["k"]: r["threshold"] for r in sequence.otsu(df, ["k"], "v").collect()}
    assert abs(out[1] - 5.0) < 1e-9 and 1.1 <= out[2] < 8.9


def test_rolling_median_frame(spark):
    import pandas as pd

    x = np.random.default_rng(1).normal(size=50)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, i int, v double")
    got = [r["rolling"] for r in sequence.rolling_median(df, ["k"], "i", "v", 6).orderBy("i").collect()]
    want = pd.Series(x).rolling(6, center=True, min_periods=1).median()
    assert np.allclose(got, want)


def test_imputation_sees_earlier_fills(spark):
    rows = [(1, 0, 0, 0, 4.0), (1, 1, 0, 0, None), (1, 2, 1, 0, None), (1, 3, 1, 0, 8.0), (1, 4, 1, 0, None), (1, 5, 1, 0, None), (1, 6, 1, 0, None), (1, 7, 1, 0, 8.0)]
    df = spark.createDataFrame(rows, "k int, i int, wd int, h int, v double")
    out = sequence.cascading_impute(df, ["k"], "v", [["wd", "h"], ["h"]], "i", 2).orderBy("i").collect()
    assert [r["filled"] for r in out] == [4.0, 4.0, 8.0, 8.0, None, None, None, 8.0]  # three in a row stay null


def test_night_is_decided_by_the_middle(spark):
    df = spark.createDataFrame([(1, 0, 9), (1, 12, 13), (1, 30, 41), (2, 20, 23), (2, 26, 29)], "k int, start int, end int")
    out = sequence.night_blocks(df, ["k"], "start", "end", 2, 5, 20).orderBy("k", "night").collect()
    # Runs on either side of noon do not merge, however close.
    assert [(r["k"], r["night"], r["start"], r["end"]) for r in out] == [(1, 0, 0, 13), (1, 1, 30, 41), (2, 0, 20, 23), (2, 1, 26, 29)]


def test_stability_weighs_the_profile_by_all_values(spark):
    x = [1.0, 5.0, None, 3.0, 7.0, 2.0, 1.0, None, 4.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "k int, i int, v double")
    known = [(i % 3, v) for i, v in enumerate(x) if v is not None]
    values = np.array([v for _, v in known])
    profile = np.array([np.mean([v for s, v in known if s == k]) for k in range(3)])
    r = one(calendar.is_iv(df, ["k"], "i", "v", 3))
    assert abs(r["rar_is"] - len(values) * profile.var() / (3 * values.var())) < 1e-12 and abs(r["rar_iv"] - np.mean(np.diff(values) ** 2) / values.var()) < 1e-12
    assert one(calendar.is_iv(df, ["k"], "i", "v", 4))["rar_is"] is None


def test_holm_is_monotone_and_not_below_raw(spark):
    p = [0.01, 0.04, 0.03, 0.005, None]
    out = sequence.holm(spark.createDataFrame([(1, v) for v in p], "k int, p double"), ["k"], "p").orderBy("p").collect()
    assert np.allclose([r["p_holm"] for r in out], [0.02, 0.03, 0.06, 0.06]) and [r["reject"] for r in out] == [True, True, False, False]


def test_regularity_index_bounds(spark):
    same = spark.createDataFrame([(1, i, (i % 24) < 8) for i in range(96)], "k int, i int, s boolean")
    assert one(calendar.regularity_index(same, ["k"], "i", "s", 24, 48))["sri"] == 100
    flip = spark.createDataFrame([(1, i, i // 24 % 2 == 0) for i in range(96)], "k int, i int, s boolean")
    assert one(calendar.regularity_index(flip, ["k"], "i", "s", 24, 48))["sri"] == -100


def test_nearest_on_grid(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 15, "b"), (1, 41, "c")], "k int, t int, v string")
    assert {r["grid"]: r["value"] for r in calendar.nearest_on_grid(df, ["k"], "t", "v", 10, 5).collect()} == {0: "a", 10: "a", 20: "b", 30: None, 40: "c", 50: None}


def test_metrics(spark):
    y, s = [1, 0, 1, 1, 0, 0], [0.9, 0.8, 0.8, 0.3, 0.2, 0.1]
    df = spark.createDataFrame(list(zip(y, s, strict=True)), "y int, s double").withColumn("k", F.lit(1))
    pairs = [(a > b) + 0.5 * (a == b) for a, i in zip(s, y, strict=True) if i for b, j in zip(s, y, strict=True) if not j]
    assert abs(one(inference.auc(df, ["k"], "s", "y"))["auc"] - np.mean(pairs)) < 1e-12
    assert abs(one(inference.average_precision(df, ["k"], "s", "y"))["ap"] - (1 + 2 / 3 + 3 / 4) / 3) < 1e-12


def test_corrected_test_widens_the_error(spark):
    d = np.random.default_rng(2).normal(0.1, 0.05, 15)
    df = spark.createDataFrame([("a", f, float(v)) for f, v in enumerate(d)] + [("b", f, 0.0) for f in range(15)], "s string, fold int, v double").withColumn("o", F.lit(1))
    r = one(inference.corrected_test(df, ["o"], "s", "fold", "v"))
    assert abs(r["t_stat"] - d.mean() / np.sqrt((1 / 15 + 1 / 4) * d.var(ddof=1))) < 1e-9 and r["df"] == 14


def test_signal_kernels():
    t = np.arange(0, 20, 1 / 30)
    rng = np.random.default_rng(0)
    x = np.sin(4 * np.pi * t) + 0.3 * np.sin(2 * np.pi * t) + 0.05 * rng.normal(size=len(t))
    assert 0.8 < signal.stride_regularity(x, 30) <= 1 and signal.stride_regularity(x[:30], 30) == 0
    assert abs(signal.psd_features(x, 30)["dom_freq"] - 2) < 0.12
    assert signal.sample_entropy(x[:100]) is None and signal.sample_entropy(rng.normal(size=400)) > signal.sample_entropy(np.sin(t))
    assert abs(signal.dip(np.arange(40.0)) - 1 / 80) < 1e-9
    assert signal.dip(np.concatenate([rng.normal(0, 0.01, 100), rng.normal(1, 0.01, 100)])) > 0.2 > 0.05 > signal.dip(rng.normal(size=300))
    assert signal.match_weights({"m.a": (2,), "m.b": (3,)}, {"a": (2,), "b": (9,)}, "m.") == {"a": "m.a"}
    with pytest.raises(ValueError):
        signal.match_weights({}, {"a": (1,)})


def test_selection(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 300)
    a = y + rng.normal(0, 0.3, 300)
    m = np.column_stack([a, a + rng.normal(0, 0.001, 300), rng.normal(size=300), rng.normal(size=300)])
    df = spark.createDataFrame([(int(i), int(v), *map(float, r)) for i, (v, r) in enumerate(zip(y, m, strict=True))], "id int, y int, a double, b double, c double, d double")
    cols = ["a", "b", "c", "d"]
    assert np.allclose(learning.correlations(df, cols), np.corrcoef(m.T))
    assert learning.correlation_filter(df, cols) == ["a", "c", "d"]
    assert set(learning.select_k_best(df, cols, "y", 2)) == {"a", "b"}
    assert learning.mrmr(df, cols, "y", 2)[0] in ("a", "b")
    out, names = learning.block_pca(df, df, {"x": ["a", "b", "c"], "z": ["d"]})
    assert names[0] == "x_pc0" and "d" in names and out.count() == 300
    assert learning.missing_rate_filter(df.withColumn("a", F.lit(None).cast("double")), cols) == ["b", "c", "d"]


def test_columns(spark):
    r = spark.createDataFrame([("2015_x_y_0012_03.mat", "0012_03", "77", 13.0, 5.0)], "f string, i string, j string, h double, v double")
    got = r.select(columns.subject_from_file(F.col("f")), columns.normalized_id(F.col("i")), columns.normalized_id(F.col("j")), columns.clock_hour(F.col("h")), columns.enmo(F.lit(0.0), F.lit(0.0), F.lit(1.5)), columns.finite(F.lit(float("inf")))).first()
    assert tuple(got) == ("0012_03", "12_3", "77", -11.0, 500.0, None)
    assert relational.feature_ladder(relational.feature_groups(["sleep_a", "rar_b", "speed", "x_prob_bin1"]), ["age"])["Full Sensor"] == ["age", "speed", "sleep_a", "rar_b"]


def test_feature_files_and_sinks(spark, tmp_path):
    (tmp_path / "bouts").mkdir()
    (tmp_path / "bouts" / "12_0.csv").write_text("bout_id,start_time,duration_sec,bout_pa_mean\n1,2024-01-01 08:00:00,20,0.5\n2,2024-01-01 09:00:00,bad,0.7\n")
    (tmp_path / "bouts" / "13_0.csv").write_text("\n")
    out = recordings.read_features(spark, f"file://{tmp_path}", "bouts").orderBy("bout_id").collect()
    assert [(r["subject_id"], r["device"], r["duration_sec"], r["pa_amplitude"]) for r in out] == [("12_0", None, 20, 0.5), ("12_0", None, None, 0.7)]
    df = spark.range(3)
    first = recordings.write_new(df, str(tmp_path / "o"))
    second = recordings.write_new(df, str(tmp_path / "o"))
    assert first != second and spark.read.parquet(second).count() == 3
    assert recordings.stages("sleep, gait") == ["gait", "sleep"]
    with pytest.raises(ValueError):
        recordings.stages("nap")


def test_stream_of_bouts(spark, tmp_path):
    import datetime as dt

    rows = [(1, dt.datetime(2024, 1, 1, 8, m), 1.0) for m in (0, 10, 50)] + [(1, dt.datetime(2024, 1, 1, 20, 0), 2.0), (1, dt.datetime(2024, 1, 3), 0.0)]
    spark.createDataFrame(rows, "user_id int, ts timestamp_ntz, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("user_id int, ts timestamp_ntz, value double").parquet(str(tmp_path / "in"))
    q = stream_bouts(source).writeStream.format("memory").queryName("bouts_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n_windows"] for r in spark.table("bouts_out").collect()) == [1, 3]


def test_permutation_importance_finds_the_column_that_matters(spark):
    from pyspark.ml.classification import LogisticRegression

    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3))
    rows = [(i, *map(float, v), int(v[1] > 0)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int")
    found = learning.permutation_importance(df, "id", ["a", "b", "c"], "y", LogisticRegression(labelCol="y", regParam=0.01), 3)
    assert found[0][0] == "b" and found[0][1] > 0.3 and all(abs(v) < 0.1 for _, v in found[1:])


def test_distributions_match_known_values(spark):
    from ambulo.functions import distributions as d

    t = spark.createDataFrame([(2.0, 14.0), (0.5, 3.3), (-7.0, 1.0), (0.0, 5.0)], "t double, df double").select(d.t_two_sided(F.col("t"), F.col("df")).alias("p"), d.t_critical(F.col("df")).alias("c")).collect()
    def tail(t, df):  # the density in the angle, by the trapezoid rule
        x = np.linspace(np.arctan(abs(t) / df**0.5), np.pi / 2, 200_001)
        return 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.pi**0.5 * np.trapezoid(np.cos(x) ** (df - 1), x)

    assert np.allclose([r["p"] for r in t], [tail(*x) for x in ((2.0, 14.0), (0.5, 3.3), (-7.0, 1.0), (0.0, 5.0))], atol=1e-7)
    assert abs(t[0]["c"] - 2.144786688) < 1e-6 and abs(t[2]["c"] - 12.70620474) < 1e-5
    z = spark.createDataFrame([(1.959963985,), (0.3,), (6.0,)], "z double").select(d.normal_two_sided(F.col("z")).alias("p")).collect()
    assert np.allclose([r["p"] for r in z], [0.05, 0.7641771556, 1.973175e-9], rtol=1e-5)


def test_ranks_of_one_large_group_equal_sorting(spark):
    from ambulo.operators import ranks

    rng = np.random.default_rng(9)
    v = rng.integers(0, 300, 3000)
    df = spark.createDataFrame([(None, int(x)) for x in v] + [("k", 1), ("k", 1), ("k", 0)], "g string, v int")
    got = sorted((r["v"], r["r"]) for r in ranks.with_average_rank(df, ["g"], "v", "r").where("g IS NULL").collect())
    order = np.sort(v)
    want = [(int(x), (np.searchsorted(order, x, "left") + np.searchsorted(order, x, "right") + 1) / 2) for x in order]
    assert got == want
    sums = df.where("g IS NULL").groupBy("g", "v").count()
    run = {r["v"]: r["n"] for r in ranks.with_running_sums(sums, ["g"], "v", {"n": "count"}).collect()}
    assert run == {int(x): int((v >= x).sum()) for x in set(v.tolist())}


def test_dips_of_uniform_samples_have_uniform_p(spark):
    rng = np.random.default_rng(12)
    null = signal.dip_null(spark, (30, 60, 120), 400)
    rows = [(int(n), signal.dip(rng.random(n))) for n in rng.integers(30, 121, 300)] + [(20, None)]
    two = np.concatenate([rng.normal(0, 0.1, 50), rng.normal(5, 0.1, 50)])
    one = rng.normal(size=100)
    rows += [(100, signal.dip(two)), (100, signal.dip(one)), (1000, signal.dip(two))]
    got = signal.with_dip_p(spark.createDataFrame(rows, "n int, dip double"), "n", "dip", null).collect()
    p = np.array([r["p"] for r in got[:300]])
    assert np.abs(np.sort(p) - (np.arange(300) + 0.5) / 300).max() < 0.1  # the distance of Kolmogorov and Smirnov
    by = {(r["n"], r["dip"]): r["p"] for r in got[300:]}
    assert by[20, None] is None and by[100, rows[-3][1]] == 0 and by[100, rows[-2][1]] > 0.2 and by[1000, rows[-1][1]] == 0


def test_dip_against_hulls_around_each_mode():
    """The least distance for which hulls on either side of some mode pass: a lower bound, as they may cross at the mode,
    and mostly the dip itself."""
    rng = np.random.default_rng(3)

    def distance(x):
        x, n, best = np.sort(x), len(x), 1.0
        lower, upper = np.arange(n) / n, np.arange(1, n + 1) / n
        for m in range(n):
            lo, hi = 0.0, 1.0
            for _ in range(40):  # the least e for which a convex curve before and a concave one after pass within e
                e = (lo + hi) / 2
                ok = True
                for part, low, high in ((x[: m + 1], upper[: m + 1] - e, lower[: m + 1] + e), (-x[m:][::-1], 1 - lower[m:][::-1] - e, 1 - upper[m:][::-1] + e)):
                    top = part[:, None] == part[None, :]
                    hull = np.array([min((high[i] if i == j else high[i] + (high[j] - high[i]) * (t - part[i]) / (part[j] - part[i])) for i in range(len(part)) for j in range(i, len(part)) if part[i] <= t <= part[j] and (i == j or part[i] < part[j])) for t in part])
                    ok &= bool((hull >= low - 1e-12).all()) and top.any()
                lo, hi = (lo, e) if ok else (e, hi)
            best = min(best, hi)
        return best

    found = []
    for k in range(6):
        x = rng.random(13) if k % 2 else np.concatenate([rng.normal(0, 1, 7), rng.normal(4, 1, 7)])
        found.append(signal.dip(x, 10) - distance(x))
    assert min(found) > -1e-9 and sum(abs(f) < 1e-9 for f in found) >= 4 and max(found) < 1 / 14


def test_models_of_both_kinds_fit_and_are_tuned(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(120, 3))
    rows = [(i, *map(float, v), int(v[0] + v[1] > 0), float(2 * v[0] - v[2])) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y int, t double").coalesce(1).cache()
    zoo = learning.classifiers("y")
    assert set(zoo) == {"lr_l2", "lr_l1", "lr_elastic", "forest", "boosted", "svm"}
    few = lambda label, n: {m: {"": learning.classifiers(label)[m]} for m in ("lr_elastic", "svm")}
    got = learning.nested_cv(df, "id", ["a", "b", "c"], "y", ("none",), few, 2, 1, 2).collect()
    assert {(r["model"], r["fold"]) for r in got} == {(m, f) for m in ("lr_elastic", "svm") for f in (0, 1)} and all(r["error"] is None and r["auc"] > 0.85 for r in got)
    for name, model in learning.regressors("t").items():
        scored = model.fit(learning._vectors(df, ["a", "b", "c"])).transform(learning._vectors(df, ["a", "b", "c"]))
        r = inference.regression_metrics(scored.withColumn("k", F.lit(1)), ["k"], "prediction", "t").first()
        assert r["r2"] > 0.7, name


def test_recordings_are_listed_and_features_written_by_subject(spark, tmp_path):
    for name in ("0012_03.mat", "0012_03_info.mat", "skip/0001_00.mat", "20ab.txt"):
        path = tmp_path / "raw" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * 7)
    got = recordings.list_recordings(spark, str(tmp_path / "raw"), exclude=("_info",), exclude_folders=("skip",)).collect()
    assert [(r["name"], r["length"], r["subject_id"]) for r in got] == [("0012_03.mat", 7, "12_3")]
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "subject_id string, v int")
    path = recordings.write_features(rows, str(tmp_path / "out"), "bouts")
    assert sorted((r["subject_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("a", 3), ("b", 2)]
    assert (tmp_path / "out" / "bouts" / "subject_id=a").is_dir()
