"""Feature sets, labels, histograms and result files by small cases."""

import json
from glob import glob

from ambulo.operators import variants
from ambulo.sources import recordings


def test_outcomes_take_the_first_column_that_is_there(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0, 0.0), (2, None, 2.0, None), (3, 0.0, None, 3.0)], "id int, rosbsum double, dcfdx double, dcfdx_3gp double")
    got = [(r["mobility_disability_binary"], r["falls_binary"], r["cognitive_impairment"]) for r in variants.with_outcomes(df).orderBy("id").collect()]
    assert got == [(1.0, None, 0.0), (None, None, 1.0), (0.0, None, None)] and "age_at_visit" not in variants.with_outcomes(df).columns
    kept = variants.with_outcomes(df.drop("dcfdx").withColumn("falls_binary", df["id"] * 1.0)).orderBy("id").collect()
    assert [r["cognitive_impairment"] for r in kept] == [0.0, None, 1.0] and [r["falls_binary"] for r in kept] == [1.0, 2.0, 3.0]


def test_extremes_ties_and_one_key(spark):
    df = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "k int")
    scores = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, 1.0), (4, 5.0), (5, None)], "k int, s double")
    assert {r["k"]: r["phenotype"] for r in variants.label_extremes(df, scores, "k", "s", "low", "high").collect()} == {2: "low", 1: "high"}
    assert [r["phenotype"] for r in variants.label_extremes(df, scores.where("k = 2"), "k", "s", "low", "high").collect()] == ["low"]
    assert variants.label_extremes(df, scores.where("false"), "k", "s", "low", "high").count() == 0


def test_sets():
    sets = variants.feature_sets({"gait": ["g"], "pa": ["p"], "sleep": ["s"]}, ["speed"])
    assert len(sets) == 7 and sets["Daily PA + Sleep"] == ["p", "s"] and sets["Combined + Baseline"] == ["g", "p", "speed"]


def test_histograms_of_constant_and_missing_values(spark):
    rows = [("a", "pa_variability", 3.0), ("a", "pa_variability", 3.0), ("b", "speed", 9.0), ("b", "speed", 1.5), ("b", "speed", 0.1), ("c", "speed", None)]
    got = {}
    for r in variants.histograms(spark.createDataFrame(rows, "k string, metric string, x double"), "k").collect():
        got.setdefault((r["k"], r["metric"]), {})[r["bin"]] = (r["freq"], r["prob"])
    assert got["a", "pa_variability"] == {b: (2, 1.0) if b == 0 else (0, 0.0) for b in range(10)}
    assert got["b", "speed"] == {b: (1, 0.5) if b in (0, 9) else (0, 0.0) for b in range(10)}
    assert got["c", "speed"] == {b: (0, 0.0) for b in range(10)}


def test_results_have_fold_arrays_and_a_headline(spark, tmp_path):
    rows = [("o", "s", m, r, f, v + 0.1 * f) for m, v in (("x", 0.5), ("y", 0.6)) for r in (0, 1) for f in (0, 1)]
    df = spark.createDataFrame(rows, "outcome string, strategy string, model string, repeat int, fold int, score double").orderBy("score")
    recordings.write_results(df, str(tmp_path / "run"))
    arrays = {r["model"]: r["scores"] for r in spark.read.parquet(str(tmp_path / "run" / "fold_scores")).collect()}
    assert arrays == {"x": [0.5, 0.6, 0.5, 0.6], "y": [0.6, 0.7, 0.6, 0.7]}
    (line,) = open(glob(str(tmp_path / "run" / "headline" / "*.json"))[0]).read().splitlines()
    best = json.loads(line)
    assert best["model"] == "y" and abs(best["mean"] - 0.65) < 1e-12 and best["n_folds"] == 4
    assert spark.read.option("header", "true").csv(str(tmp_path / "run" / "results")).count() == 2
