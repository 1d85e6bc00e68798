"""Stages fitted in a pipeline, saved, loaded, and compared with the functions they stand for."""

import numpy as np
from pyspark.ml import Pipeline, PipelineModel

from ambulo.operators import learning
from ambulo.operators import transformers as tr


def table(spark, n=200):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 8)) + np.arange(8)
    y = (x[:, 0] + 0.5 * rng.normal(size=n) > 0).astype(int)
    x[:, 3] = x[:, 0] * 2 + 0.001 * rng.normal(size=n)  # repeats the first
    x[:, 4] = 7.0  # does not vary
    cols = [f"c{j}" for j in range(8)]
    rows = []
    for i in range(n):
        v = [float(e) for e in x[i]]
        v[1] = None if i % 5 == 0 else v[1]
        v[2] = float("nan") if i % 7 == 0 else v[2]
        v[5] = None if i % 10 else v[5]  # nearly all missing
        rows.append((i, int(y[i]), *v))
    return spark.createDataFrame(rows, "id int, y int, " + ", ".join(f"{c} double" for c in cols)), cols, x


def collected(df, cols):
    return np.array([[r[c] for c in cols] for r in df.orderBy("id").collect()], float)


def test_a_pipeline_is_saved_loaded_and_gives_the_same(spark, tmp_path):
    df, cols, x = table(spark)
    stages = [tr.MissingRateFilter(inputCols=cols), tr.MedianImputer(inputCols=cols), tr.VarianceFilter(inputCols=cols), tr.CorrelationFilter(inputCols=cols), tr.Standardizer(inputCols=cols), tr.Selector(inputCols=cols, labelCol="y", strategy="k_best", choice="k=10")]
    pipeline = Pipeline(stages=stages)
    pipeline.write().overwrite().save(str(tmp_path / "p"))
    model = Pipeline.load(str(tmp_path / "p")).fit(df)
    out = model.transform(df)
    assert [c for c in out.columns if c in cols] == ["c0", "c1", "c2", "c6", "c7"]
    got = collected(out, ["c0", "c1", "c2", "c6", "c7"])
    held = x[:, [0, 1, 2, 6, 7]].copy()
    held[::5, 1], held[::7, 2] = np.nan, np.nan
    held = np.where(np.isnan(held), np.nanmedian(held, axis=0), held)
    assert np.allclose(got, (held - held.mean(axis=0)) / held.std(axis=0))
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert np.allclose(collected(again.transform(df), ["c0", "c1", "c2", "c6", "c7"]), got)
    # Values of the fit, not of the rows transformed.
    few = collected(again.transform(df.where("id < 10")), ["c0", "c7"])
    assert np.allclose(few, got[:10, [0, 4]])


def test_selectors_choose_what_the_functions_choose(spark):
    df, cols, _ = table(spark)
    full = tr.MedianImputer(inputCols=cols).fit(df).transform(df)
    for strategy, choice in (("consensus", ""), ("stability", ""), ("mrmr", "k=10"), ("l1", "")):
        model = tr.Selector(inputCols=cols, labelCol="y", keyCol="id", strategy=strategy, choice=choice).fit(full)
        kept = [c for c in cols if c not in model.value("dropped")]
        assert kept == tr.cells.selected(full, "id", cols, "y", strategy, choice) and "c0" in kept


def test_blocks_become_components(spark, tmp_path):
    df, cols, _ = table(spark)
    full = tr.MedianImputer(inputCols=cols).fit(df).transform(df)
    blocks = {"a": ["c0", "c1", "c3"], "b": ["c6", "c7"], "c": ["c2", "c5", "nowhere"]}
    model = tr.BlockPca(blocks=blocks, variance=0.9).fit(full)
    model.write().overwrite().save(str(tmp_path / "b"))
    out = tr.ComponentColumns.load(str(tmp_path / "b")).transform(full)
    want, names = learning.block_pca(full, full, {"a": blocks["a"]}, 0.9)
    assert [c for c in out.columns if "_pc" in c] == names == ["a_pc0", "a_pc1"] and {"c6", "c7", "c2", "c5"} <= set(out.columns) and "c0" not in out.columns
    assert np.allclose(collected(out, names), collected(want, names), atol=1e-9)
