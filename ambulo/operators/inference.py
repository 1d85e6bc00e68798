"""Effect sizes, correlations, model metrics and corrected tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi_square_rest, normal_two_sided, t_critical, t_two_sided
from .ranks import same_keys, with_average_rank, with_running_sums
from .sequence import holm


def cohens_d(df: DataFrame, keys: list[str], value: str, group: str, least: int = 10) -> DataFrame:
    """Difference of means (group 1 less group 0) over the pooled sample deviation, with at least `least` in each."""
    g = lambda agg, k: agg(F.when(F.col(group) == k, F.col(value)))
    a = df.groupBy(*keys).agg(g(F.count, 1).alias("n1"), g(F.count, 0).alias("n0"), g(F.avg, 1).alias("m1"), g(F.avg, 0).alias("m0"), g(F.var_samp, 1).alias("v1"), g(F.var_samp, 0).alias("v0"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    return a.where((F.col("n1") >= least) & (F.col("n0") >= least)).select(*keys, "n1", "n0", ((F.col("m1") - F.col("m0")) / F.nullif(pooled, F.lit(0.0))).alias("d"))


def mann_whitney(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """U of group 1 by average ranks, and its two-sided p by the normal law, corrected for ties and continuity.

    p is null where a group is empty or all values are equal.
    """
    known = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    ranked = with_average_rank(known, keys, value, "_r")
    a = ranked.groupBy(*keys).agg(F.sum(F.when(F.col(group) == 1, F.col("_r"))).alias("r1"), F.count_if(F.col(group) == 1).alias("n1"), F.count_if(F.col(group) == 0).alias("n0"))
    t = F.count(F.lit(1)).cast("double")
    ties = known.groupBy(*keys, value).agg((t * t * t - t).alias("_t")).groupBy(*keys).agg(F.sum("_t").alias("_ties"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    n, pairs = (F.col("n1") + F.col("n0")).cast("double"), F.col("n1").cast("double") * F.col("n0")
    spread = F.sqrt(pairs / 12 * (n + 1 - F.try_divide(F.col("_ties"), n * (n - 1))))
    z = (F.greatest(u, pairs - u) - pairs / 2 - 0.5) / F.nullif(spread, F.lit(0.0))
    return same_keys(a, ties, keys).select(*keys, "n1", "n0", u.alias("u"), F.when(z <= 0, 1.0).otherwise(normal_two_sided(z)).alias("p"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks over rows without nulls, and its two-sided p by t with n - 2 degrees."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = known.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_t"))
    ranked = with_average_rank(with_average_rank(pairs, keys, x, "rx", "_t"), keys, y, "ry", "_t")
    whole = pairs.groupBy(*keys).agg(F.sum("_t").alias("n"))
    # Both ranks have the mean (n + 1) / 2.
    u, v = (F.col(c) - (F.col("n") + 1) / 2 for c in ("rx", "ry"))
    sums = same_keys(ranked, whole, keys).groupBy(*keys).agg(F.max("n").alias("n"), *(F.sum(F.col("_t") * p).alias(c) for c, p in (("_uv", u * v), ("_uu", u * u), ("_vv", v * v))))
    a = sums.select(*keys, "n", F.when((F.col("_uu") > 0) & (F.col("_vv") > 0), F.col("_uv") / F.sqrt(F.col("_uu") * F.col("_vv"))).alias("rho"))
    rho, left = F.col("rho"), F.col("n") - 2
    return a.withColumn("p", F.when(F.col("n") > 2, t_two_sided(rho * F.sqrt(left / F.greatest(1 - rho * rho, F.lit(1e-300))), left.cast("double"))))


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete correlations of every two columns; one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    out = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    long = out.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    return long.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "r")


def line_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line."""
    return df.groupBy(*keys).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def selection_bias(df: DataFrame, group: str, continuous: list[str], binary: list[str]) -> DataFrame:
    """Welch t and pooled standardized difference of each continuous variable; Yates chi-square and Cohen's h of each
    binary one; with their p-values."""
    rows = []
    for c in continuous:
        g = lambda f, k, c=c: f(F.when(F.col(group) == k, F.col(c)))
        a = df.agg(*(g(f, k).alias(f"{n}{k}") for k in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
        t = (F.col("m1") - F.col("m0")) / F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))
        smd = (F.col("m1") - F.col("m0")) / F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
        e1, e0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
        free = (e1 + e0) * (e1 + e0) / (e1 * e1 / (F.col("n1") - 1) + e0 * e0 / (F.col("n0") - 1))
        rows.append(a.select(F.lit(c).alias("variable"), F.lit("continuous").alias("kind"), t.alias("statistic"), smd.alias("effect"), t_two_sided(t, free).alias("p")))
    for c in binary:
        a = df.where(F.col(c).isNotNull()).agg(*(F.count_if((F.col(group) == k) & (F.col(c) == v)).cast("double").alias(f"c{k}{v}") for k in (0, 1) for v in (0, 1)))
        n = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
        off = F.greatest(F.abs(F.col("c00") * F.col("c11") - F.col("c01") * F.col("c10")) - n / 2, F.lit(0.0))
        chi = n * off * off / ((F.col("c00") + F.col("c01")) * (F.col("c10") + F.col("c11")) * (F.col("c00") + F.col("c10")) * (F.col("c01") + F.col("c11")))
        h = 2 * F.asin(F.sqrt(F.col("c11") / (F.col("c10") + F.col("c11")))) - 2 * F.asin(F.sqrt(F.col("c01") / (F.col("c00") + F.col("c01"))))
        rows.append(a.select(F.lit(c).alias("variable"), F.lit("binary").alias("kind"), chi.alias("statistic"), h.alias("effect"), chi_square_rest(chi).alias("p")))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def average_precision(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Sum of precision over the recall steps of distinct scores."""
    held = df.groupBy(*keys, score).agg(F.sum(label).alias("tp"), F.count(F.lit(1)).alias("n"))
    run = with_running_sums(held, keys, score, {"ctp": "tp", "cn": "n"})
    return run.groupBy(*keys).agg((F.sum(F.col("tp") * F.col("ctp") / F.col("cn")) / F.nullif(F.sum("tp"), F.lit(0))).alias("ap"))


def auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Area under the curve by ranks."""
    ranked = with_average_rank(df, keys, score, "_r")
    a = ranked.groupBy(*keys).agg(F.sum(F.when(F.col(label) == 1, F.col("_r"))).alias("r"), F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    return a.select(*keys, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))


def class_metrics(df: DataFrame, keys: list[str], predicted: str, label: str) -> DataFrame:
    """Balanced accuracy and F1."""
    c = lambda p, y: F.count_if((F.col(predicted) == p) & (F.col(label) == y))
    a = df.groupBy(*keys).agg(c(1, 1).alias("tp"), c(1, 0).alias("fp"), c(0, 1).alias("fn"), c(0, 0).alias("tn"))
    recall, specificity = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))
    return a.select(*keys, ((recall + specificity) / 2).alias("balanced_accuracy"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def regression_metrics(df: DataFrame, keys: list[str], predicted: str, actual: str) -> DataFrame:
    """R squared and mean absolute error."""
    e = F.col(actual) - F.col(predicted)
    a = df.groupBy(*keys).agg(F.sum(e * e).alias("sse"), F.var_pop(actual).alias("v"), F.count(actual).alias("n"), F.avg(F.abs(e)).alias("mae"))
    return a.select(*keys, (1 - F.col("sse") / F.nullif(F.col("v") * F.col("n"), F.lit(0.0))).alias("r2"), "mae")


def fold_summary(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Mean and population deviation over folds."""
    return df.groupBy(*keys).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count(score).alias("n_folds"))


def best_per_group(df: DataFrame, keys: list[str], score: str, ties: str) -> DataFrame:
    """The row of the best score; the first by `ties` among equals."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), ties))).where("_k = 1").drop("_k")


def corrected_test(df: DataFrame, family: list[str], sets: str, fold: str, score: str, k: int = 5) -> DataFrame:
    """Paired t of every two feature sets over folds, with the variance corrected for shared training rows.

    The standard error is sqrt((1 / n + 1 / (k - 1)) * s^2), n the number of pairs without nulls; p is two-sided with
    n - 1 degrees, and low to high is the 95 % interval of the difference. Without spread they are null.
    """
    rows = df.select(*family, F.col(sets).alias("s"), fold, F.col(score).alias("v")).where("v IS NOT NULL")
    a, b = rows.withColumnsRenamed({"s": "set_a", "v": "va"}), rows.withColumnsRenamed({"s": "set_b", "v": "vb"})
    d = a.join(b, [*family, fold]).where("set_a < set_b").withColumn("d", F.col("va") - F.col("vb"))
    return paired_test(d, [*family, "set_a", "set_b"], k)


def paired_test(d: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """The corrected test of differences d(by, d), one for each fold."""
    out = d.groupBy(*by).agg(F.count("d").alias("n"), F.avg("d").alias("delta"), F.var_samp("d").alias("var"))
    se = F.sqrt((1 / F.col("n") + 1 / F.lit(k - 1)) * F.col("var"))
    out = out.withColumn("se", se).withColumn("t_stat", F.try_divide("delta", "se")).withColumn("df", F.col("n") - 1).drop("var")
    free, width = F.col("df").cast("double"), F.col("_t") * F.col("se")
    critical = out.select("df").distinct().select(F.col("df").alias("_df"), F.when(F.col("df") > 0, t_critical(free)).alias("_t"))
    tested = out.join(critical, F.col("df") == F.col("_df")).withColumn("p", F.when(F.col("t_stat").isNotNull(), t_two_sided(F.col("t_stat"), free)))
    return tested.select(*out.columns, "p", (F.col("delta") - width).alias("low"), (F.col("delta") + width).alias("high"))


def contrasts(best: DataFrame, named: DataFrame, outcome: str, sets: str, fold: str, score: str, k: int = 5) -> DataFrame:
    """Tests of named pairs of feature sets, A less B, for each outcome; p adjusted within each primary contrast.

    best(outcome, sets, fold, score): fold scores of the best model of each cell; named(contrast, family, set_a, set_b).
    Pairs of which a cell is missing have no row. Contrasts of another family than `primary` are not adjusted.
    """
    rows = best.select(outcome, F.col(sets).alias("s"), fold, F.col(score).alias("v"))
    a, b = rows.withColumnsRenamed({"s": "set_a", "v": "va"}), rows.withColumnsRenamed({"s": "set_b", "v": "vb"})
    met = F.broadcast(named).join(a, "set_a").join(b, [outcome, "set_b", fold]).withColumn("d", F.col("va") - F.col("vb"))
    tested = paired_test(met, ["contrast", "family", outcome, "set_a", "set_b"], k)
    primary = holm(tested.where("family = 'primary'"), ["contrast"], "p")
    return primary.unionByName(tested.where("family <> 'primary'"), allowMissingColumns=True)


def headline(tests: DataFrame, set_a, set_b, family: list[str]) -> DataFrame:
    """Of pairwise tests(family, set_a, set_b, delta, low, high, p) those of two sets, turned so that delta is
    set_a less set_b; p adjusted over the rows found."""
    turned = F.col("set_a") != F.lit(set_a)
    found = tests.where(F.col("set_a").isin(set_a, set_b) & F.col("set_b").isin(set_a, set_b))
    side = lambda c, other: F.when(turned, -F.col(other)).otherwise(F.col(c)).alias(c)
    out = found.select(*family, F.lit(set_a).alias("set_a"), F.lit(set_b).alias("set_b"), side("delta", "delta"), side("low", "high"), side("high", "low"), "p")
    return holm(out, ["set_a"], "p")


def curves(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """For each distinct score as threshold the true and false positive rate (= recall) and the precision."""
    held = df.groupBy(*keys, score).agg(F.sum(label).alias("tp"), F.sum(1 - F.col(label)).alias("fp"))
    run = with_running_sums(held, keys, score, {"ctp": "tp", "cfp": "fp"})
    ends = held.groupBy(*keys).agg(F.sum("tp").alias("_p"), F.sum("fp").alias("_n"))
    return same_keys(run, ends, keys).select(*keys, score, F.try_divide("ctp", "_p").alias("tpr"), F.try_divide("cfp", "_n").alias("fpr"), F.try_divide(F.col("ctp"), F.col("ctp") + F.col("cfp")).alias("precision"))


def density(df: DataFrame, keys: list[str], value: str, points: int) -> DataFrame:
    """Gaussian kernel density of each group at points between its ends, with Scott's bandwidth n^(-1/5) * s."""
    ends = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), (F.stddev_samp(value) * F.pow(F.count(value), F.lit(-0.2))).alias("h"))
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(i.alias("i"), (F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1)).alias("x"))))
    spread = same_keys(df.where(F.col(value).isNotNull()).select(*keys, value), ends, keys).where("h > 0").select(*keys, value, "n", "h", grid.alias("g"))
    z = (F.col("g.x") - F.col(value)) / F.col("h")
    return spread.groupBy(*keys, F.col("g.i").alias("i"), F.col("g.x").alias("x"), "n", "h").agg(F.sum(F.exp(-z * z / 2)).alias("_s")).select(*keys, "i", "x", (F.col("_s") / (F.col("n") * F.col("h") * 2.5066282746310002)).alias("density"))
