"""Feature selection, models and nested cross-validation over a subjects table.

Statistics over rows are distributed; what reaches the driver is a columns-by-columns matrix or a list of scores.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import digamma
from ..sources.stored import stored
from . import cells
from .cells import STRATEGIES
from .inference import auc, average_precision, class_metrics
from .ranks import with_hash_number, with_running_sums
from .relational import folds


def missing_rate_filter(df: DataFrame, cols: list[str], threshold: float = 0.6) -> list[str]:
    """M1: columns with a share of nulls below the threshold, else the first."""
    a = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols)).first()
    return [c for c in cols if a[c] is not None and a[c] < threshold] or cols[:1]


def median_impute(train: DataFrame, df: DataFrame, cols: list[str]) -> DataFrame:
    """M2: nulls become the exact median of the training rows."""
    m = train.agg(*(F.percentile(c, F.lit(0.5)).alias(c) for c in cols)).first()
    return df.fillna({c: m[c] for c in cols if m[c] is not None}).fillna(0.0, subset=cols)


def variance_filter(df: DataFrame, cols: list[str], least: float = 1e-8) -> list[str]:
    """M3: columns whose population variance is above the least."""
    v = df.agg(*(F.var_pop(c).alias(c) for c in cols)).first()
    return [c for c in cols if (v[c] or 0) > least]


def standardize(train: DataFrame, df: DataFrame, cols: list[str]) -> DataFrame:
    """M5: less the training mean, over the training population deviation (1 where it is 0)."""
    s = train.agg(*(F.avg(c).alias(f"m_{c}") for c in cols), *(F.stddev_pop(c).alias(f"s_{c}") for c in cols)).first()
    return df.withColumns({c: (F.col(c) - s[f"m_{c}"]) / (s[f"s_{c}"] or 1.0) for c in cols})


def moments(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and population covariance of columns without nulls, in one pass of partial sums."""
    n = len(cols)

    def run(batches):
        count, total, cross = 0, np.zeros(n), np.zeros((n, n))
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols]) if b.num_rows else np.empty((0, n))
            count, total, cross = count + len(x), total + x.sum(axis=0), cross + x.T @ x
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"n": [count], "s": pa.array([total.tolist()], pa.list_(pa.float64())), "q": pa.array([cross.ravel().tolist()], pa.list_(pa.float64()))})

    parts = df.select(*(F.col(c).cast("double") for c in cols)).mapInArrow(run, "n long, s array<double>, q array<double>")
    a = parts.select("n", F.posexplode(F.concat("s", "q")).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("k").collect()
    if not a:
        return 0, np.zeros(n), np.zeros((n, n))
    rows, v = a[0]["n"], np.array([r["v"] for r in a])
    mean = v[:n] / max(rows, 1)
    return rows, mean, v[n:].reshape(n, n) / max(rows, 1) - np.outer(mean, mean)


def correlations(df: DataFrame, cols: list[str]) -> np.ndarray:
    _, _, cov = moments(df, cols)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    return cov / np.where(sd == 0, 1, sd)[:, None] / np.where(sd == 0, 1, sd)[None, :]


def correlation_filter(df: DataFrame, cols: list[str], threshold: float = 0.95) -> list[str]:
    """M4: columns in order, without those that correlate above the threshold with one kept before."""
    r, kept = np.abs(correlations(df, cols)), []
    for i in range(len(cols)):
        if not any(r[i, j] > threshold for j in kept):
            kept.append(i)
    return [cols[i] for i in kept]


def anova_f(df: DataFrame, cols: list[str], label: str) -> dict[str, float]:
    """M6: F of each column between the classes."""
    a = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m_{c}") for c in cols), *(F.var_pop(c).alias(f"v_{c}") for c in cols)).collect()
    n, out = sum(r["n"] for r in a), {}
    for c in cols:
        grand = sum(r["n"] * r[f"m_{c}"] for r in a) / n
        between = sum(r["n"] * (r[f"m_{c}"] - grand) ** 2 for r in a) / max(1, len(a) - 1)
        within = sum(r["n"] * r[f"v_{c}"] for r in a) / max(1, n - len(a))
        out[c] = between / within if within else 0.0
    return out


def select_k_best(df: DataFrame, cols: list[str], label: str, k: int) -> list[str]:
    """M6: the k columns of the largest F, in table order."""
    f = anova_f(df, cols, label)
    top = set(sorted(cols, key=lambda c: (-f[c], cols.index(c)))[:k])
    return [c for c in cols if c in top]


def nearest_information(df: DataFrame, cols: list[str], label: str, neighbours: int = 3) -> DataFrame:
    """M7: feature and mi, the mutual information of each column with the class by nearest neighbours.

    For each row the distance to its `neighbours`-th nearest of its class, and how many rows of any class lie nearer
    (those of its own value where that distance is 0); mi is digamma(rows) + mean digamma(neighbours) - mean
    digamma(class rows) - mean digamma(rows nearer), at least 0. On a line the nearest lie among as many rows before and
    after, and counts follow from running sums over distinct values, so no rows are paired. Classes of one row are left
    out, smaller ones than `neighbours` take as many as there are. Nulls are no rows of their column. Equal values of a
    class are one row with a count; a window sorts a column's distinct values of one class. What is needed more than
    once is stored.
    """
    long = df.select(F.col(label).alias("y"), *(F.col(c).cast("double").alias(c) for c in cols)).unpivot(["y"], cols, "feature", "x").where("x IS NOT NULL AND y IS NOT NULL")
    own = Window.partitionBy("feature", "y")
    order = own.orderBy("x")
    sized = long.groupBy("feature", "y", "x").agg(F.count(F.lit(1)).alias("times")).withColumn("ny", F.sum("times").over(own)).where("ny > 1")

    def beside(f, k):
        """The distance to a value before or after, as often as it is there; nulls where there is none."""
        return F.array_repeat(F.abs(F.col("x") - f("x", k).over(order)), F.least(f("times", k).over(order), F.lit(neighbours)).cast("int"))

    same = F.array_repeat(F.lit(0.0), F.least(F.col("times") - 1, F.lit(neighbours)).cast("int"))
    many = F.least(F.lit(neighbours), F.col("ny") - 1)
    apart = sized.withColumn("k", many).withColumn("_d", F.array_compact(F.concat(same, *(beside(f, k) for k in range(1, neighbours + 1) for f in (F.lag, F.lead)))))
    # Rows at the distance itself are not nearer, whatever the last digit.
    apart = apart.withColumn("d", F.element_at(F.sort_array("_d"), F.col("k").cast("int")) * (1 - 1e-12)).withColumns({"lo": F.col("x") - F.col("d"), "hi": F.col("x") + F.col("d")})
    apart = stored(apart.drop("_d", "d"))
    asked = apart.select("feature", F.explode(F.array("lo", "hi")).alias("x"), F.lit(0).cast("long").alias("n"))
    values = apart.select("feature", "x", F.col("times").alias("n")).unionByName(asked).groupBy("feature", "x").agg(F.sum("n").alias("n"))
    run = stored(with_running_sums(values, ["feature"], "x", {"ge": "n"}).select("feature", "x", "ge", (F.col("ge") - F.col("n")).alias("gt")))
    met = apart.join(run.select("feature", F.col("x").alias("lo"), "ge"), ["feature", "lo"]).join(run.select("feature", F.col("x").alias("hi"), "gt"), ["feature", "hi"])
    mean = lambda c: F.sum(F.col("times") * digamma(c)) / F.sum("times")
    a = met.groupBy("feature").agg(F.sum("times").cast("double").alias("n"), mean(F.col("k")).alias("k"), mean(F.col("ny")).alias("ny"), mean(F.col("ge") - F.col("gt")).alias("m"))
    return a.select("feature", F.greatest(digamma(F.col("n")) + F.col("k") - F.col("ny") - F.col("m"), F.lit(0.0)).alias("mi"))


def mutual_information(df: DataFrame, cols: list[str], label: str) -> dict[str, float]:
    """M7: mutual information of each column with the class; 0 of a column without rows to tell."""
    found = {r["feature"]: r["mi"] for r in nearest_information(df, cols, label).collect()}
    return {c: found.get(c, 0.0) for c in cols}


def mrmr(df: DataFrame, cols: list[str], label: str, k: int = 20) -> list[str]:
    """Greedy: mutual information less the mean squared correlation with what is chosen."""
    relevance, r2, chosen = mutual_information(df, cols, label), correlations(df, cols) ** 2, []
    while len(chosen) < min(k, len(cols)):
        rest = [i for i in range(len(cols)) if i not in chosen]
        chosen.append(max(rest, key=lambda i: relevance[cols[i]] - (r2[i, chosen].mean() if chosen else 0)))
    return [cols[i] for i in chosen]


def _vectors(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out).transform(df)


def l1_selection(df: DataFrame, cols: list[str], label: str) -> list[str]:
    """M8: columns with a weight in a balanced L1-penalized logistic regression on standardized columns."""
    return cells.selected(df, label, cols, label, "l1")


def consensus(df: DataFrame, cols: list[str], label: str, k: int = 30, votes: int = 2) -> list[str]:
    """M9: columns that two of F, mutual information and L1 choose; with under five, those that any does; else all."""
    mi = mutual_information(df, cols, label)
    sets = [set(select_k_best(df, cols, label, k)), set(sorted(cols, key=lambda c: -mi[c])[:k]), set(l1_selection(df, cols, label))]
    count = {c: sum(c in s for s in sets) for c in cols}
    out = [c for c in cols if count[c] >= votes]
    if len(out) < 5:
        out = [c for c in cols if count[c]]
    return out or list(cols)


def stability_selection(df: DataFrame, key: str, cols: list[str], label: str) -> list[str]:
    """Columns that L1 chooses in enough hashed subsamples, all fitted together; with under five, the 20 most often
    chosen."""
    return cells.selected(df, key, cols, label, "stability")


def block_pca(train: DataFrame, df: DataFrame, blocks: dict[str, list[str]], variance: float = 0.8) -> tuple[DataFrame, list[str]]:
    """Each block of more than two columns as the leading components that keep a share of its variance (two at least)."""
    out, names = df, []
    for block, cols in blocks.items():
        if len(cols) <= 2:
            names += cols
            continue
        train_z, out_z = standardize(train, train, cols), standardize(train, out, cols)
        _, _, cov = moments(train_z, cols)
        values, vectors = np.linalg.eigh(cov)
        values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(cols))] < 0, -1, 1)
        k = min(max(int(np.searchsorted(np.cumsum(values) / (values.sum() or 1), variance)) + 1, 2), len(cols))
        # Arrays: as sums of columns, many components of a wide block are more code than a method may have.
        weighed = lambda j, cols=cols, vectors=vectors: F.zip_with(F.array(*cols), F.array(*map(F.lit, vectors[:, j].tolist())), lambda x, w: x * w)
        made = {f"{block}_pc{j}": F.aggregate(weighed(j), F.lit(0.0), lambda a, x: a + x) for j in range(k)}
        out = out_z.withColumns(made).drop(*cols)
        train = train_z.withColumns(made).drop(*cols)
        names += list(made)
    return out, names


def classifiers(label: str) -> dict:
    """Logistic regressions, forest, boosted trees (for the boosting libraries) and a linear SVM (for the kernel one)."""
    return {
        "lr_l2": LogisticRegression(labelCol=label, regParam=0.01), "lr_l1": LogisticRegression(labelCol=label, regParam=0.01, elasticNetParam=1.0), "lr_elastic": LogisticRegression(labelCol=label, regParam=0.01, elasticNetParam=0.5),
        "forest": RandomForestClassifier(labelCol=label, numTrees=50, seed=42), "boosted": GBTClassifier(labelCol=label, maxIter=20, seed=42), "svm": LinearSVC(labelCol=label, regParam=0.01),
    }


def regressors(label: str) -> dict:
    return {"elastic": LinearRegression(labelCol=label, regParam=0.01, elasticNetParam=0.5), "forest": RandomForestRegressor(labelCol=label, numTrees=50, seed=42), "boosted": GBTRegressor(labelCol=label, maxIter=20, seed=42)}


def grids(label: str, rows: int) -> dict:
    """Each model's grid of (choice, estimator). C of the logistic regression is 1 / (rows * regParam); a forest without a depth has MLlib's largest."""
    lr = {f"C={c}": LogisticRegression(labelCol=label, weightCol="_weight", maxIter=2000, regParam=1 / (c * max(rows, 1))) for c in (0.01, 0.1, 1.0, 10.0)}
    rf = {f"max_depth={d}": RandomForestClassifier(labelCol=label, weightCol="_weight", numTrees=200, maxDepth=d or 30, seed=42) for d in (4, 8, None)}
    gbt = {f"max_depth={d},learning_rate={e}": GBTClassifier(labelCol=label, maxIter=200, maxDepth=d, stepSize=e, seed=42) for d in (3, 5) for e in (0.05, 0.1)}
    return {"logistic": lr, "forest": rf, "boosted": gbt}


def _ready(train: DataFrame, test: DataFrame, cols: list[str], label: str) -> tuple[DataFrame, DataFrame, list[str], int]:
    """Both sides filtered, imputed and scaled by the training rows, which get weights that balance the classes."""
    cols = missing_rate_filter(train, cols)
    a, b = median_impute(train, train, cols), median_impute(train, test, cols)
    cols = correlation_filter(a, variance_filter(a, cols))
    n = {r[label]: r["count"] for r in a.groupBy(label).count().collect()}
    weight = F.element_at(F.create_map(*(F.lit(x) for y, c in n.items() for x in (y, sum(n.values()) / (len(n) * c)))), F.col(label))
    return standardize(a, a, cols).withColumn("_weight", weight).cache(), standardize(a, b, cols).cache(), cols, sum(n.values())


def _chosen(train: DataFrame, key: str, cols: list[str], label: str, strategy: str) -> dict[str, list[str]]:
    """The columns of a strategy for each choice in its grid."""
    if strategy == "k_best":
        return {f"k={k}": select_k_best(train, cols, label, k) for k in (10, 20, 40)}
    if strategy == "mrmr":
        ranked = mrmr(train, cols, label, 20)  # greedy: the first ten are those of k = 10
        return {f"k={k}": ranked[:k] for k in (10, 20)}
    return {"": {"none": lambda: cols, "l1": lambda: l1_selection(train, cols, label), "stability": lambda: stability_selection(train, key, cols, label)}[strategy]()}


def _scores(fit, test: DataFrame, cols: list[str], label: str) -> DataFrame:
    scored = fit.transform(_vectors(test, cols))
    return scored.select(F.col(label).alias("y"), vector_to_array("rawPrediction")[1].alias("score"), F.col("prediction").cast("int").alias("p"))


def nested_cv(df: DataFrame, key: str, cols: list[str], label: str, strategies=STRATEGIES, models=grids, k: int = 5, repeats: int = 3, inner: int = 3) -> DataFrame:
    """M17 for any models of pyspark.ml: metrics of each strategy and model on every outer fold, by the choice that inner
    folds found best. Each fit is a job of its own; logistic models alone are fitted together by cells.nested_cv.

    Selection and model are tuned together for average precision on inner folds of the outer training rows, then fitted
    to all of these. A cell that fails keeps its row, with the error.
    """
    placed = folds(df.select(key, label, *cols), key, label, k, repeats).withColumnsRenamed({"repeat": "_repeat", "fold": "_fold"}).cache()
    out = []
    for r, f in product(range(repeats), range(k)):
        here = placed.where(f"_repeat = {r}")
        train, test = here.where(f"_fold <> {f}").drop("_repeat", "_fold"), here.where(f"_fold = {f}").drop("_repeat", "_fold")
        split = folds(train, key, label, inner, 1).cache()
        sides = [_ready(*(split.where(f"fold {sign} {i}").drop("repeat", "fold") for sign in ("<>", "=")), cols, label) for i in range(inner)]
        sides.append(_ready(train, test, cols, label))
        for strategy, name in product(strategies, models(label, 1)):
            row = {"strategy": strategy, "model": name, "repeat": r, "fold": f}
            try:
                out.append({**row, **_tuned(sides, key, label, strategy, name, models)})
            except Exception as e:  # noqa: BLE001
                out.append({**row, "error": str(e)[:500]})
        for d in (split, *(d for side in sides for d in side[:2])):
            d.unpersist()
    placed.unpersist()
    return df.sparkSession.createDataFrame(out, "strategy string, model string, repeat int, fold int, choice string, inner_ap double, ap double, auc double, balanced_accuracy double, f1 double, error string")


def _tuned(sides: list, key: str, label: str, strategy: str, name: str, models) -> dict:
    """The best choice over the inner sides, and the metrics of its fit on the last side, the outer one."""
    found: dict[tuple[str, str], list[float]] = {}
    for train, test, cols, n in sides[:-1]:
        for s, some in _chosen(train, key, cols, label, strategy).items():
            ready = _vectors(train, some)
            for m, model in models(label, n)[name].items():
                ap = average_precision(_scores(model.fit(ready), test, some, label).withColumn("all", F.lit(0)), ["all"], "score", "y").first()["ap"]
                found.setdefault((s, m), []).append(-1.0 if ap is None else ap)
    s, m = max(found, key=lambda c: sum(found[c]))  # the first of equals
    train, test, cols, n = sides[-1]
    some = _chosen(train, key, cols, label, strategy)[s]
    scored = _scores(models(label, n)[name][m].fit(_vectors(train, some)), test, some, label).withColumn("all", F.lit(0)).cache()
    metrics = [average_precision(scored, ["all"], "score", "y").first(), auc(scored, ["all"], "score", "y").first(), class_metrics(scored, ["all"], "p", "y").first()]
    scored.unpersist()
    return {"choice": ",".join(filter(None, (s, m))), "inner_ap": sum(found[s, m]) / len(found[s, m]), **{c: v for x in metrics for c, v in x.asDict().items() if c != "all"}}


def permutation_importance(df: DataFrame, key: str, cols: list[str], label: str, model, repeats: int = 10) -> list[tuple[str, float]]:
    """Fall of accuracy on a hashed quarter when a column's values are dealt to other rows, by rank of a hash."""
    held = F.pmod(F.xxhash64(key, F.lit(42)), F.lit(4)) == 0
    train, test = df.where(~held), df.where(held).withColumn("_all", F.lit(0)).cache()
    fit = model.fit(_vectors(train, cols))
    accuracy = lambda d: fit.transform(_vectors(d, cols)).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0] or 0.0
    order = lambda d, seed: with_hash_number(d, ["_all"], F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key, "_i")
    base, ranked, out = accuracy(test), order(test, -1).cache(), []
    for c in cols:
        falls = []
        for r in range(repeats):
            dealt = order(test, r).select(F.col(c).alias("_v"), "_i")
            falls.append(base - accuracy(ranked.join(dealt, "_i").withColumn(c, F.col("_v"))))
        out.append((c, sum(falls) / repeats))
    for d in (test, ranked):
        d.unpersist()
    return sorted(out, key=lambda x: (-x[1], x[0]))
