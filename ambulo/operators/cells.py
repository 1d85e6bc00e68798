"""Selection and nested cross-validation as tables of cells (M6 to M17): all fits of a kind share the passes over rows."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import penalized as pen
from .inference import auc, average_precision, class_metrics
from .ranks import with_hash_number
from .relational import folds

#: The strategies of the baseline, and those besides.
STRATEGIES = ("none", "k_best", "l1", "mrmr", "stability")
ALL_STRATEGIES = (*STRATEGIES, "information", "consensus", "pca")
#: Inverse strengths of the grid of logistic models, and of the L1 model that selects.
STRENGTHS, L1_STRENGTH = (0.01, 0.1, 1.0, 10.0), 0.1
RESAMPLES, SHARE, OFTEN = 30, 0.7, 0.6


def top(values: np.ndarray, columns: np.ndarray, k: int) -> tuple[int, ...]:
    """The k columns of the largest values, in table order; the first of equals."""
    ranked = sorted(columns, key=lambda j: (-values[j], j))[:k]
    return tuple(sorted(int(j) for j in ranked))


def relevant_and_different(relevance: np.ndarray, correlation: np.ndarray, columns: np.ndarray, k: int) -> list[int]:
    """Greedily the column of the largest relevance less mean squared correlation with those chosen."""
    chosen: list[int] = []
    while len(chosen) < min(k, len(columns)):
        rest = [int(j) for j in columns if j not in chosen]
        chosen.append(max(rest, key=lambda j: relevance[j] - ((correlation[j, chosen] ** 2).mean() if chosen else 0.0)))
    return chosen


def often_chosen(hits: np.ndarray, columns: np.ndarray, resamples: int, often: float = OFTEN) -> tuple[int, ...]:
    """Columns chosen in enough subsamples; with under five, the 20 most often chosen."""
    kept = tuple(int(j) for j in columns if hits[j] >= often * resamples)
    return kept if len(kept) >= 5 else top(hits, columns, 20)


def agreed(votes: list[tuple[int, ...]], columns: np.ndarray, least: int = 2) -> tuple[int, ...]:
    """M9: columns that enough votes name; with under five those that any does; else all."""
    count = {int(j): sum(int(j) in v for v in votes) for j in columns}
    kept = tuple(j for j in count if count[j] >= least)
    if len(kept) < 5:
        kept = tuple(j for j in count if count[j])
    return kept or tuple(count)


def _l1_choices(d: pen.Design, s: pen.Sums, sides: list[pen.Side], which: list[int], samples: int) -> tuple[dict[int, tuple[int, ...]], dict[int, np.ndarray]]:
    """For each side the columns with a weight on all its rows, and how many subsamples chose each column."""
    models = [pen.Model(k, tuple(map(int, sides[k].columns)), l1=1 / L1_STRENGTH, sample=r) for k in which for r in (-1, *range(samples))]
    weights = pen.logistic(d, s, sides, models)[:, 1:]
    whole = {m.side: tuple(int(j) for j in np.flatnonzero(np.abs(w) > 1e-5)) for m, w in zip(models, weights, strict=True) if m.sample < 0}
    hits = {k: np.zeros(weights.shape[1]) for k in which}
    for m, w in zip(models, weights, strict=True):
        if m.sample >= 0:
            hits[m.side] += np.abs(w) > 1e-10
    return whole, hits


def choices(d: pen.Design, s: pen.Sums, sides: list[pen.Side], strategies) -> dict[str, list[dict[str, tuple[int, tuple[int, ...]]]]]:
    """For each strategy and side, the grid of choices: name -> (place of the side to use, columns).

    Sides that a strategy makes (components) are appended to `sides`.
    """
    bare = list(range(len(sides)))
    needs_l1 = {"l1", "stability", "consensus"} & set(strategies)
    whole, hits = _l1_choices(d, s, sides, bare, d.samples if "stability" in strategies else 0) if needs_l1 else ({}, {})
    out: dict[str, list] = {}
    for name in strategies:
        out[name] = []
        for k in bare:
            side = sides[k]
            own = side.columns
            if name == "none":
                grid = {"": (k, tuple(map(int, own)))}
            elif name == "k_best":
                grid = {f"k={n}": (k, top(side.f, own, n)) for n in (10, 20, 40)}
            elif name == "information":
                grid = {f"k={n}": (k, top(pen.binned_information(s, side.k), own, n)) for n in (10, 20, 30)}
            elif name == "mrmr":
                ranked = relevant_and_different(pen.binned_information(s, side.k), side.correlation, own, 20)
                grid = {f"k={n}": (k, tuple(sorted(ranked[:n]))) for n in (10, 20)}
            elif name == "l1":
                grid = {"": (k, whole[k])}
            elif name == "stability":
                grid = {"": (k, often_chosen(hits[k], own, d.samples))}
            elif name == "consensus":
                grid = {"": (k, agreed([top(side.f, own, 30), top(pen.binned_information(s, side.k), own, 30), whole[k]], own))}
            elif name == "pca":
                sides.append(pen.components(side))
                grid = {"": (len(sides) - 1, tuple(map(int, sides[-1].columns)))}
            else:
                raise ValueError(f"no such strategy: {name}")
            out[name].append(grid)
    return out


def selected(df: DataFrame, key: str, cols: list[str], label: str, strategy: str, choice: str = "") -> list[str]:
    """The columns that a strategy selects on all rows of df, without the filters before it."""
    d = pen.design(df, key, cols, label, samples=RESAMPLES if strategy == "stability" else 0, share=SHARE)
    s = pen.sums(d)
    sides = [pen.side_of(s, pen.side_medians(d, s), 0, filters=False)]
    return [cols[j] for j in choices(d, s, sides, (strategy,))[strategy][0][choice][1]]


def nested_sides(df: DataFrame, key: str, label: str | None, k: int = 5, repeats: int = 3, inner: int = 3) -> DataFrame:
    """Key and sides: for each repeat and outer fold `inner` inner sides and the outer one, as codes.

    Outer folds are balanced by label (if one is named), inner folds of the training rows too, by hash ranks within each.
    """
    strata = [label] if label else []
    outer = folds(df.select(key, *strata), key, label, k, repeats)
    cells = outer.withColumn("out", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    digest = F.md5(F.concat_ws(":", F.lit("42"), F.col("repeat").cast("string"), F.col("out").cast("string"), F.col(key).cast("string")))
    learnt = with_hash_number(cells.where("fold <> out"), ["repeat", "out", *strata], digest, key, "_i").withColumn("_g", (F.col("_i") - 1) % inner)
    train = learnt.select(key, "repeat", "out", F.array(*(F.when(F.col("_g") == i, pen.TEST).otherwise(pen.TRAIN) for i in range(inner)), F.lit(pen.TRAIN)).alias("codes"))
    test = cells.where("fold = out").select(key, "repeat", "out", F.array(*(F.lit(0) for _ in range(inner)), F.lit(pen.TEST)).alias("codes"))
    held = train.unionByName(test).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("repeat", "out", "codes"))).alias("_s"))
    return held.select(key, F.flatten(F.transform("_s", lambda s: s["codes"])).cast("array<tinyint>").alias("sides"))


def _by_model(scored: DataFrame, metric, *columns) -> dict[int, dict]:
    return {r["model"]: r.asDict() for r in metric(scored, ["model"], *columns).collect()}


def nested_cv(df: DataFrame, key: str, cols: list[str], label: str, strategies=STRATEGIES, strengths=STRENGTHS, k: int = 5, repeats: int = 3, inner: int = 3, done: DataFrame | None = None) -> DataFrame:
    """Metrics of each strategy on every outer fold, by the choice and strength that inner folds found best.

    strategy, model, repeat, fold, choice, inner_ap, ap, auc, balanced_accuracy, f1, error. Filters, imputation, scaling
    and selection see the training rows of their own side only (bins of mutual information: the quantiles of all rows,
    whatever their label). Balanced logistic models are tuned with the selection for average precision, the first of
    equals winning. A strategy that fails gives its cells the error. Cells of `done`, an earlier result, are kept as they
    are. Needs labels 0 and 1; a fold without both has null metrics.
    """
    spark = df.sparkSession
    kept = {(r["strategy"], r["repeat"], r["fold"]): r.asDict() for r in done.where("error IS NULL").collect()} if done is not None else {}
    cells = list(product(range(repeats), range(k)))
    rows = [kept[c] for c in product(strategies, range(repeats), range(k)) if c in kept]
    todo = [t for t in strategies if any((t, *c) not in kept for c in cells)]
    schema = "strategy string, model string, repeat int, fold int, choice string, inner_ap double, ap double, auc double, balanced_accuracy double, f1 double, error string"
    if not todo:
        return spark.createDataFrame(rows, schema)
    d = pen.design(df, key, cols, label, nested_sides(df, key, label, k, repeats, inner), len(cells) * (inner + 1), RESAMPLES if "stability" in todo else 0, SHARE)
    s = pen.sums(d)
    medians = pen.side_medians(d, s)
    sides = [pen.side_of(s, medians, n) for n in range(d.sides)]
    grids, failed = {}, {}
    for name in todo:
        try:
            grids |= choices(d, s, sides, (name,))
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)[:500]
    models, place = [], {}
    for name, per_side in grids.items():
        for n, grid in enumerate(per_side):
            if (name, *cells[n // (inner + 1)]) in kept:
                continue
            for (choice, (where, columns)), c in product(grid.items(), strengths):
                place[name, n, choice, c] = len(models)
                models.append(pen.Model(where, columns, l2=1 / c))
    weights = pen.logistic(d, s, sides, models)
    by_inner = {i: n for n, i in enumerate(i for (name, n, *_), i in place.items() if n % (inner + 1) < inner)}
    inside = pen.scores(d, sides, [models[i] for i in by_inner], weights[list(by_inner)]) if by_inner else None
    found = _by_model(inside, average_precision, "score", "y") if inside is not None else {}
    best: dict[tuple, tuple] = {}
    for name in grids:
        for n, cell in enumerate(cells):
            if (name, *cell) in kept:
                continue
            base = n * (inner + 1)
            tried = []
            for choice, c in product(grids[name][base + inner], strengths):
                aps = [found.get(by_inner[place[name, base + i, choice, c]], {}).get("ap") for i in range(inner)]
                tried.append((float(np.mean([-1.0 if a is None else a for a in aps])), choice, c))
            best[name, cell] = max(tried, key=lambda t: t[0])
    order = list(best)
    outer = [place[name, cells.index(cell) * (inner + 1) + inner, best[name, cell][1], best[name, cell][2]] for name, cell in order]
    metrics: list[dict] = []
    if outer:
        scored = pen.stored(pen.scores(d, sides, [models[i] for i in outer], weights[outer]).withColumn("p", (F.col("score") > 0).cast("int")))
        metrics = [_by_model(scored, average_precision, "score", "y"), _by_model(scored, auc, "score", "y"), _by_model(scored, class_metrics, "p", "y")]
    for n, (name, cell) in enumerate(order):
        ap, choice, c = best[name, cell]
        own = {m: v for part in metrics for m, v in part.get(n, {}).items()}
        rows.append({"strategy": name, "model": "logistic", "repeat": cell[0], "fold": cell[1], "choice": ",".join(filter(None, (choice, f"C={c}"))), "inner_ap": ap, **{m: own.get(m) for m in ("ap", "auc", "balanced_accuracy", "f1")}, "error": None})
    rows += [{"strategy": name, "model": "logistic", "repeat": r, "fold": f, "error": e} for name, e in failed.items() for r, f in cells]
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema)


def fourier_features(df: DataFrame, cols: list[str], width: float, many: int = 100, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """Df with `many` columns whose products approximate exp(-width * squared distance) of two rows' columns.

    Each is a cosine of a random direction (drawn from a seeded generator) at a random phase, as an expression; a linear
    model on them is a machine with that kernel. Columns are to be scaled before; a null in any gives nulls.
    """
    rng = np.random.default_rng(seed)
    ways, phases = rng.normal(scale=np.sqrt(2 * width), size=(many, len(cols))), rng.uniform(0, 2 * np.pi, many)
    names = [f"fourier_{j}" for j in range(many)]
    angle = lambda j: F.aggregate(F.zip_with(F.col("_x"), F.array(*map(F.lit, ways[j].tolist())), lambda x, w: x * w), F.lit(0.0), lambda a, v: a + v)
    held = df.withColumn("_x", F.array(*(F.col(c).cast("double") for c in cols)))
    return held.withColumns({n: F.cos(angle(j) + float(phases[j])) * float(np.sqrt(2 / many)) for j, n in enumerate(names)}).drop("_x"), names


def out_of_fold(df: DataFrame, key: str, cols: list[str], label: str, strength: float = 1.0, k: int = 5, repeats: int = 1) -> DataFrame:
    """Key, repeat, fold, y, the score (log odds) of a balanced logistic model that did not see the row's fold, and
    the class it says. All folds' models are fitted together; filters, imputation and scaling are of their own rows.
    """
    cells = list(product(range(repeats), range(k)))
    d = pen.design(df, key, cols, label, nested_sides(df, key, label, k, repeats, 0), len(cells))
    s = pen.sums(d)
    medians = pen.side_medians(d, s)
    sides = [pen.side_of(s, medians, n) for n in range(d.sides)]
    models = [pen.Model(n, tuple(map(int, side.columns)), l2=1 / strength) for n, side in enumerate(sides)]
    scored = pen.scores(d, sides, models, pen.logistic(d, s, sides, models))
    return scored.select(F.col("key").alias(key), F.floor(F.col("model") / k).cast("int").alias("repeat"), (F.col("model") % k).alias("fold"), "y", "score", (F.col("score") > 0).cast("int").alias("predicted"))


def importances(df: DataFrame, key: str, cols: list[str], label: str, strength: float = 1.0, repeats: int = 10, share: float = 0.25, seed: int = 42) -> DataFrame:
    """Feature and importance: how much the accuracy of a balanced logistic model on held-out rows falls, on average
    over repeats, when the feature's values are dealt to other held-out rows.

    A hashed share of the rows is held out. Every repeat deals by the ranks of a hash, to all features at once: a row
    meets the one row whose values it gets, and as the model is linear, each feature's change of score is a product. So
    all features and repeats are one join and one aggregation. Nulls are imputed as in the fit; features that the
    filters drop have importance 0.
    """
    held = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1000)) < round(share * 1000)
    sides = df.select(key, F.array(F.when(held, pen.TEST).otherwise(pen.TRAIN)).alias("sides"))
    d = pen.design(df, key, cols, label, sides, 1)
    s = pen.sums(d)
    medians = pen.side_medians(d, s)
    side = pen.side_of(s, medians, 0)
    (w,) = pen.logistic(d, s, [side], [pen.Model(0, tuple(map(int, side.columns)), l2=1 / strength)])
    c = side.to @ w
    p = len(cols)
    slope, base = c[1 : p + 1], float(c[0])
    filled = F.transform(F.arrays_zip("x", F.array(*map(F.lit, medians[0].tolist())).alias("m")), lambda e: F.coalesce(e["x"], e["m"]))
    # Null rows of the fit carry the median by their own weight, which is the slope times the median.
    rows = d.rows.where(F.col("sides")[0] == pen.TEST).select("key", "y", filled.alias("v"))
    score = F.aggregate(F.zip_with("v", F.array(*map(F.lit, slope.tolist())), lambda x, b: x * b), F.lit(base), lambda a, t: a + t)
    test = pen.stored(rows.withColumn("score", score))
    order = lambda frame, tag: with_hash_number(frame, ["repeat"], F.md5(F.concat_ws(":", F.lit(f"{seed}{tag}"), F.col("repeat").cast("string"), F.col("key").cast("string"))), "key", "_i")
    many = test.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    takes, gives = order(many, "a"), order(many, "b").select("repeat", "_i", F.col("v").alias("_v"))
    met = takes.join(gives, ["repeat", "_i"]).withColumn("_d", F.zip_with(F.zip_with("_v", "v", lambda a, b: a - b), F.array(*map(F.lit, slope.tolist())), lambda x, b: x * b))
    right = lambda z: ((z > 0).cast("double") == (F.col("y") > 0).cast("double")).cast("double")
    each = met.select("y", "score", F.posexplode("_d").alias("j", "change")).groupBy("j").agg(F.avg(right(F.col("score"))).alias("_was"), F.avg(right(F.col("score") + F.col("change"))).alias("_is"))
    return each.select(F.array(*map(F.lit, cols))[F.col("j")].alias("feature"), (F.col("_was") - F.col("_is")).alias("importance"))


#: Penalties and L1 shares of the grid of least-squares models; the penalty of the lasso that selects.
ALPHAS, L1_SHARES, LASSO = (0.01, 0.1, 0.5, 1.0), (0.3, 0.5, 0.7), 0.1
LINE_STRATEGIES = ("none", "k_best", "l1", "pca")


def _line_choices(side: pen.Side, name: str) -> dict[str, tuple[pen.Side, tuple[int, ...]]]:
    own = side.columns
    if name == "none":
        return {"": (side, tuple(map(int, own)))}
    if name == "k_best":
        return {f"k={n}": (side, top(side.f_line, own, n)) for n in (10, 20, 40)}
    if name == "l1":
        return {"": (side, tuple(int(j) for j in np.flatnonzero(np.abs(pen.least_squares(side, own, LASSO, 1.0)[1:]) > 1e-5)))}
    if name == "pca":
        made = pen.components(side)
        return {"": (made, tuple(map(int, made.columns)))}
    raise ValueError(f"no such strategy: {name}")


def nested_cv_line(df: DataFrame, key: str, cols: list[str], target: str, strategies=LINE_STRATEGIES, alphas=ALPHAS, l1_shares=L1_SHARES, k: int = 5, repeats: int = 3, inner: int = 3) -> DataFrame:
    """M17 for a number: strategy, model, repeat, fold, choice, inner_r2, r2, mae of least-squares models.

    Models, their tuning (by R squared on inner folds, the first of equals) and R squared follow from the sums of both
    parts of every side, without another pass; the mean absolute error takes one. Selection is M6 by straight lines, M8 by
    the lasso, or M13. A fold whose target does not vary has no R squared, which counts as -1 where it is tuned by.
    """
    cells = list(product(range(repeats), range(k)))
    d = pen.design(df, key, cols, target, nested_sides(df, key, None, k, repeats, inner), len(cells) * (inner + 1))
    s, held = pen.sums(d), pen.sums(d, code=pen.TEST)
    medians = pen.side_medians(d, s)
    sides = [pen.side_of(s, medians, n) for n in range(d.sides)]

    def r2(side: pen.Side, w: np.ndarray) -> float | None:
        c, both = side.to @ w, held.products[side.k].sum(axis=0)
        n, total = both[0, 0], held.targets[side.k][0]
        spread = held.squares[side.k] - total * total / n if n else 0.0
        return float(1 - (held.squares[side.k] - 2 * c @ held.targets[side.k] + c @ both @ c) / spread) if spread > 1e-12 else None

    rows, models, weights, made = [], [], [], []
    for name, (n, cell) in product(strategies, enumerate(cells)):
        own = sides[n * (inner + 1) : (n + 1) * (inner + 1)]
        grids = [_line_choices(side, name) for side in own]
        best = (-np.inf, "", 0.0, 0.0)
        for choice, alpha, share in product(grids[-1], alphas, l1_shares):
            found = [r2(grids[i][choice][0], pen.least_squares(*grids[i][choice], alpha, share)) for i in range(inner)]
            mean = float(np.mean([-1.0 if r is None else r for r in found]))
            if mean > best[0]:
                best = mean, choice, alpha, share
        side, columns = grids[-1][best[1]]
        w = pen.least_squares(side, columns, best[2], best[3])
        made.append(side)
        models.append(pen.Model(len(made) - 1, columns))
        weights.append(w)
        rows.append((len(models) - 1, name, "elastic", *cell, ",".join(filter(None, (best[1], f"alpha={best[2]},l1_ratio={best[3]}"))), best[0], r2(side, w)))
    errors = pen.scores(d, made, models, np.array(weights)).groupBy("model").agg(F.avg(F.abs(F.col("score") - F.col("y"))).alias("mae"))
    table = df.sparkSession.createDataFrame(rows, "n int, strategy string, model string, repeat int, fold int, choice string, inner_r2 double, r2 double")
    return table.join(errors.withColumnRenamed("model", "n"), "n", "left").drop("n")
