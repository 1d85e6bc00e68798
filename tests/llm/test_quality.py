"""Operator 11 against plain Python: statistics, traversal, growth, held-out accuracy and hard rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ambulo.llm import quality


def named(text):
    return dict(zip(quality.NAMES, quality.statistics(text).tolist(), strict=True))


def test_statistics_of_a_small_text():
    text = "The cat sat. The cat\n\n- AB 12 , ran!\nThe cat sat. The cat"
    words = text.split()
    got = named(text)
    assert np.isclose(got["log_words"], np.log1p(len(words))) and np.isclose(got["log_lines"], np.log1p(3))
    assert np.isclose(got["distinct_words"], len(set(words)) / len(words)) and np.isclose(got["top_word"], 4 / len(words))
    assert np.isclose(got["top_pair"], 4 / len(words)) and got["same_next"] == 0
    assert np.isclose(got["repeated_lines"], 1 / 3) and np.isclose(got["unended_lines"], 2 / 3) and np.isclose(got["bullets"], 1 / 3)
    assert np.isclose(got["letterless"], 3 / len(words)) and np.isclose(got["bare_marks"], 2 / len(words)) and np.isclose(got["upper_words"], 1 / len(words))
    assert np.isclose(got["share_digit"], 2 / len(text)) and np.isclose(got["share_end"], 3 / len(text)) and np.isclose(got["share_space"], sum(map(str.isspace, text)) / len(text))
    assert np.isclose(sum(got[f"share_{c}"] for c in quality.CLASSES), 1)
    assert np.isclose(got["word_mean"], np.mean([len(w) for w in words])) and np.isclose(got["word_sd"], np.std([len(w) for w in words]))


def test_parts_change_nothing(monkeypatch):
    text = "so it is. " * 400 + "\n" + "näin ON 7 %%% " * 300
    whole = quality.statistics(text)
    monkeypatch.setattr(quality, "PART", 100)
    assert np.allclose(quality.statistics(text), whole)


@pytest.mark.parametrize("text", [None, "", " \n\t", "x", "a" * 5000, "\n" * 50, "𐍈" * 9, "\x00\x85"])
def test_statistics_are_finite(text):
    assert np.isfinite(quality.statistics(text)).all()


def test_flat_trees_walk_as_nested_ones_and_first_split_is_the_best():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 5)), 1)
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = quality.grow(x, y, 12)

    def walk(i, row):
        while model.left[i] != i:
            i = model.right[i] if row[model.feature[i]] > model.threshold[i] else model.left[i]
        return model.value[i]

    want = [model.base + sum(walk(r, row) for r in model.roots) for row in x]
    assert np.allclose(model.margin(x), want)
    # The first split, by trying every feature and threshold.
    p = 1 / (1 + np.exp(-model.base))
    g, h = p - y, np.full(len(y), p * (1 - p))
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.PENALTY)
    every = [(part(x[:, f] <= t) + part(x[:, f] > t), f, t) for f in range(5) for t in np.unique(x[:, f]) if min(h[x[:, f] <= t].sum(), h[x[:, f] > t].sum()) >= quality.LEAST]
    root = model.roots[0]
    chosen = part(x[:, model.feature[root]] <= model.threshold[root]) + part(x[:, model.feature[root]] > model.threshold[root])
    assert np.isclose(chosen, max(e[0] for e in every))
    assert ((quality.grow(x, y).scores(x) >= 0.5) == y.astype(bool)).mean() > 0.97


def test_one_class_or_none_gives_the_log_odds():
    assert quality.grow(np.zeros((3, 2)), np.ones(3)).scores(np.zeros((1, 2)))[0] == pytest.approx(0.8)
    assert quality.grow(np.zeros((0, 2)), np.zeros(0)).scores(np.zeros((2, 2))).tolist() == [0.5, 0.5]


def test_query_scores_all_rows_and_learns_only_from_training_rows(spark):
    d = "/root/testdata/sf0.01"
    rows = quality.op11_histogram_trees(spark, d).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    held = [r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean(held) > 0.95
    # Turned labels of held-out rows change nothing.
    docs, known = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    turned = known.withColumn("quality", F.when(~quality.in_training(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.fit(docs, known).value, quality.fit(docs, turned).value)


def test_hard_rows(spark):
    least = -(1 << 63)
    data = [(None, "so it is", "a"), (1, "same id", "b"), (1, "same id", "b"), (1, "another text", "b"), (2, None, "b"), (3, "", None), (least, "word " * 200_000, "c")]
    docs = spark.createDataFrame(data, "doc_id long, text string, x string").withColumns({"n": F.lit(1), "score": F.lit("old"), "_x": F.lit(2)})
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 1), (least, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.score_quality(docs, model, "score").collect()
    assert len(out) == len(data) and all(0 <= r["score"] <= 1 and r["_x"] == 2 and r["n"] == 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (2, 3)}) == 1
    assert quality.score_quality(docs.where("false"), model).count() == 0
    assert quality.fit(docs, labels.where("false")).scores(np.zeros((1, len(quality.NAMES))))[0] == 0.5
