"""Queries over relational tables: merges, cohorts, profiles, effect sizes, metrics and corrected tests; with their SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import inference, learning, relational, sequence, stats
from .subjects import E_SQL, events, rounded


def _t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def merge_inner(spark, sf_dir):
    """Orders as visits with the customer's clinical row."""
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return relational.merge_clinical(o.select("o_orderkey", "o_custkey", "o_totalprice"), c, ["o_custkey"])


def merge_left_demographics(spark, sf_dir):
    """Inner, then left demographics."""
    c, n = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    s = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    out = relational.merge_clinical(relational.merge_clinical(c.select("c_custkey", "c_nationkey"), n, ["c_nationkey"]), s, ["c_nationkey"], "left")
    return out.select("c_custkey", "c_nationkey", "n_name", "n_suppliers")


def merge_visits_dedup(spark, sf_dir):
    """The first order of each customer and year, renamed, with demographics."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("projid"), "c_mktsegment")
    o = _t(spark, sf_dir, "orders").withColumn("fu_year", F.year("o_orderdate"))
    visits = o.select(F.col("o_custkey").alias("projid"), "fu_year", "o_orderkey", "o_totalprice")
    years = visits.select("projid", "fu_year").distinct()
    return relational.merge_visits(years, visits, ["projid", "fu_year"], {"o_totalprice": "gait_speed"}, [F.col("o_orderkey")], c, ["projid"])


def semi_dev(spark, sf_dir):
    """Customers with orders."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, sf_dir, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


def anti_done(spark, sf_dir):
    """Customers not processed yet."""
    return relational.not_done(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), _t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


def split_disjoint(spark, sf_dir):
    """Keys on both sides of a split; none."""
    s = relational.stratified_split(_t(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", 0.15, 20260414)
    return relational.assert_disjoint(s.where("held_out"), s.where("NOT held_out"), "c_custkey")


def split_overlap(spark, sf_dir):
    """Keys held out by one split and kept by another, which the guard must find."""
    one, two = (relational.stratified_split(_t(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", 0.15, seed) for seed in (20260414, 7))
    return relational.assert_disjoint(one.where("held_out"), two.where("NOT held_out"), "c_custkey")


def reconcile_counts(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 8).alias("stated"))
    return relational.reconcile(o, _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"], "stated")


def union_devices(spark, sf_dir):
    a = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.lit("left").alias("device"))
    b = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    return relational.union_tables(a, b)


def binary_outcomes(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return c.select("c_custkey", columns.positive(F.col("c_acctbal")).alias("positive"), columns.positive(F.nullif(F.col("c_nationkey"), F.lit(3))).alias("nation_yn"))


def ordinal_cutpoints(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", *(columns.at_least(F.col("p_size"), t).alias(f"ge{t}") for t in (10, 25, 40)))


def cohort(spark, sf_dir):
    """A checked cohort and its rows with the outcome."""
    c = relational.check_cohort(_t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), "c_custkey", ["c_acctbal", "c_nationkey"])
    return c.where("c_acctbal > 0").select("c_custkey", "c_acctbal")


def id_split(spark, sf_dir):
    """Participant and visit of an id, normalised."""
    o = _t(spark, sf_dir, "orders").select(F.concat(F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit("_0"), (F.col("o_orderkey") % 10).cast("string")).alias("sub_id"))
    ids = o.distinct().withColumn("norm", columns.normalized_id(F.col("sub_id")))
    projid, year = columns.id_parts(F.col("norm"))
    return ids.select("sub_id", "norm", projid.alias("projid"), year.alias("fu_year"))


def _gappy(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select(F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("b"), "user_id")


def missingness_profile(spark, sf_dir):
    return relational.missingness(_gappy(spark, sf_dir), ["a", "b", "user_id"])


def value_counts(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"))


def bounds_report(spark, sf_dir):
    return relational.bounds_report(_t(spark, sf_dir, "lineitem").select("l_quantity", "l_discount"), {"l_quantity": (2, 45), "l_discount": (0.01, 0.08)})


def outlier_flags(spark, sf_dir):
    u = events(spark, sf_dir).groupBy("user_id").agg(F.avg("value").alias("m"), F.max("value").alias("top"), F.count(F.lit(1)).cast("double").alias("n"))
    return relational.outlier_flags(u, ["user_id"], ["m", "top", "n"])


def topn_flags(spark, sf_dir):
    """K3, K4: the subjects with most flags."""
    return relational.top_n(outlier_flags(spark, sf_dir).select("user_id", "n_flags"), [F.desc("n_flags"), F.col("user_id")], 15)


def topn_groups(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return relational.top_in_groups(o, ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 30)


def group_profile(spark, sf_dir):
    """Medians and means of normal and outlying groups."""
    li = _t(spark, sf_dir, "lineitem").withColumn("outlier", (F.col("l_quantity") > 45).cast("int"))
    g = lambda f, k: f(F.when(F.col("outlier") == k, F.col("l_extendedprice")))
    a = li.groupBy("l_returnflag").agg(g(F.avg, 0).alias("mean_normal"), g(F.avg, 1).alias("mean_outlier"), F.percentile(F.when(F.col("outlier") == 0, F.col("l_extendedprice")), F.lit(0.5)).alias("median_normal"), F.percentile(F.when(F.col("outlier") == 1, F.col("l_extendedprice")), F.lit(0.5)).alias("median_outlier"))
    return rounded(a.withColumn("ratio", F.col("mean_outlier") / F.col("mean_normal")), 4)


def class_balance(spark, sf_dir):
    """Classes of each outcome, missing share, and tripwires."""
    y = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    long = y.unpivot(["doc_id", "lang"], ["quality", "toxic"], "outcome", "y")
    a = long.groupBy("lang", "outcome").agg(F.count("y").alias("n"), F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"), F.avg(F.col("y").isNull().cast("double")).alias("missing"))
    return a.withColumn("ok", (F.col("n") >= 100) & (F.least("pos", "neg") >= 25) & (F.col("missing") <= 0.3))


def cohort_means(spark, sf_dir):
    """Mean of proportions, melted."""
    li = _t(spark, sf_dir, "lineitem").agg(*(F.avg((F.col("l_returnflag") == f).cast("double")).alias(f) for f in ("A", "N", "R")))
    return rounded(li.unpivot([], ["A", "N", "R"], "part", "share"))


def _graded(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars")), "doc_id")


def cohens_d(spark, sf_dir):
    return rounded(inference.cohens_d(_graded(spark, sf_dir), ["lang"], "n_chars", "quality"))


def mann_whitney_u(spark, sf_dir):
    return rounded(inference.mann_whitney(_graded(spark, sf_dir), ["lang"], "n_chars", "quality"))


def spearman(spark, sf_dir):
    return rounded(inference.spearman(_t(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_quantity", "l_extendedprice"))


def pearson_matrix(spark, sf_dir):
    return rounded(inference.pearson_matrix(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


def ols_line(spark, sf_dir):
    return rounded(inference.line_fit(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), 4)


def selection_bias(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select((F.col("c_nationkey") < 10).cast("int").alias("g"), F.col("c_acctbal").alias("bal"), (F.col("c_acctbal") > 0).cast("int").alias("pos"))
    return rounded(inference.selection_bias(c, "g", ["bal"], ["pos"]))


def contingency(spark, sf_dir):
    """2 x 2 counts."""
    y = _t(spark, sf_dir, "labels")
    return y.groupBy("quality").pivot("toxic", [0, 1]).count().select("quality", F.coalesce("0", F.lit(0)).alias("toxic_0"), F.coalesce("1", F.lit(0)).alias("toxic_1"))


def stratified_split(spark, sf_dir):
    return relational.stratified_split(_t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 0.15, 20260414)


def split_balance(spark, sf_dir):
    """Sizes, means and quartile buckets (edges of the whole sample) of both sides of the split."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    q = c.agg(F.percentile("c_acctbal", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"))
    s = relational.stratified_split(c, "c_custkey", "c_mktsegment", 0.15, 20260414).crossJoin(F.broadcast(q))  # one row
    b = F.when(F.col("c_acctbal").isNull(), "missing").when(F.col("c_acctbal") <= F.col("q")[0], "q1").when(F.col("c_acctbal") <= F.col("q")[1], "q2").when(F.col("c_acctbal") <= F.col("q")[2], "q3").otherwise("q4")
    return rounded(s.groupBy("held_out", b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("mean")), 4)


def hash_sample(spark, sf_dir):
    return relational.hash_sample(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 3000, 42)


def fold_assignment(spark, sf_dir):
    return relational.folds(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality", 5, 3)


def _cells(spark, sf_dir) -> DataFrame:
    """Scores by outcome, feature set, model and fold: mean prices of order lines in hashed folds."""
    li = _t(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("outcome"), F.col("l_linenumber").alias("features"), F.col("l_linestatus").alias("model"), (F.col("l_orderkey") % 15).cast("int").alias("fold")).agg((F.avg("l_discount") * 10).alias("score"))


CELLS_SQL = "cells AS (SELECT l_returnflag AS outcome, l_linenumber AS features, l_linestatus AS model, (l_orderkey % 15)::INTEGER AS fold, avg(l_discount) * 10 AS score FROM lineitem GROUP BY ALL)"


def fold_summary(spark, sf_dir):
    return rounded(inference.fold_summary(_cells(spark, sf_dir), ["outcome", "features", "model"], "score"))


def best_per_group(spark, sf_dir):
    s = inference.fold_summary(_cells(spark, sf_dir), ["outcome", "features", "model"], "score")
    return rounded(inference.best_per_group(s, ["outcome", "features"], "mean", "model").select("outcome", "features", "model", "mean"))


def _tests(spark, sf_dir):
    return inference.corrected_test(_cells(spark, sf_dir), ["outcome", "model"], "features", "fold", "score")


def simpson(f: str, lo: str, hi: str, n: int = 2000) -> str:
    """Integral of f(x) by Simpson's rule, in SQL."""
    at = f"(({lo}) + (({hi}) - ({lo})) * i / {n}.0::DOUBLE)"
    return f"((({hi}) - ({lo})) / {3 * n}.0::DOUBLE * list_sum(list_transform(range({n + 1}), lambda i: (CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({f.format(x=at)}))))"


def t_two_sided_sql(t: str, df: str) -> str:
    """Two-sided chance of t: the density in the angle atan(t / sqrt(df)), integrated from the angle on."""
    return f"(2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi()) * {simpson(f'power(cos({{x}}), ({df}) - 1)', f'atan(abs({t}) / sqrt({df}))', f'least(pi() / 2, atan(abs({t}) / sqrt({df})) + 15 / sqrt({df}))')})"


def normal_two_sided_sql(z: str) -> str:
    return f"(2 / sqrt(2 * pi()) * {simpson('exp(-{x} * {x} / 2)', f'abs({z})', f'abs({z}) + 12.0')})"


#: The t whose two-sided chance is 0.05, by degrees of freedom (fixed values of 13 digits).
T_CRITICAL_SQL = "CASE df WHEN 14 THEN 2.1447866879178 END"


def pairwise_tests(spark, sf_dir):
    return rounded(_tests(spark, sf_dir))


TESTS_SQL = f"""{CELLS_SQL}, d AS (SELECT a.outcome, a.model, a.features AS set_a, b.features AS set_b, a.score - b.score AS d FROM cells a JOIN cells b ON a.outcome = b.outcome AND a.model = b.model AND a.fold = b.fold AND a.features < b.features),
 t AS (SELECT outcome, model, set_a, set_b, count(d) AS n, avg(d) AS delta, sqrt((1.0::DOUBLE / count(d) + 0.25) * var_samp(d)) AS se FROM d GROUP BY ALL)"""


def holm_adjust(spark, sf_dir):
    """M21, W21 over the p-values of the corrected tests."""
    return rounded(sequence.holm(_tests(spark, sf_dir).select("outcome", "model", "set_a", "set_b", "p"), ["outcome", "model"], "p"))


def _scored(spark, sf_dir) -> DataFrame:
    return _graded(spark, sf_dir).select("lang", "n_chars", F.col("quality").alias("y"), (F.col("n_chars") > 1500).cast("int").alias("p"))


def average_precision(spark, sf_dir):
    return rounded(inference.average_precision(_scored(spark, sf_dir), ["lang"], "n_chars", "y"))


def auc_rank(spark, sf_dir):
    return rounded(inference.auc(_scored(spark, sf_dir), ["lang"], "n_chars", "y"))


def balanced_accuracy_f1(spark, sf_dir):
    return rounded(inference.class_metrics(_scored(spark, sf_dir), ["lang"], "p", "y"))


def r2_mae(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    return rounded(inference.regression_metrics(li, ["l_returnflag"], "p", "y"), 4)


def mode_params(spark, sf_dir):
    """The most common value, the least of equals."""
    c = _t(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").count()
    return c.groupBy("c_nationkey").agg(F.min_by("c_mktsegment", F.struct(-F.col("count"), "c_mktsegment")).alias("mode"))


def selection_summary(spark, sf_dir):
    """Mean metric by strategy, three digits."""
    return _cells(spark, sf_dir).groupBy(F.col("features").alias("strategy")).agg(F.round(F.avg("score"), 3).alias("mean_score"), F.count(F.lit(1)).alias("n"))


def missing_rate_filter(spark, sf_dir):
    """M1: columns with fewer nulls than the threshold, else the first."""
    e = _gappy(spark, sf_dir)
    return spark.createDataFrame([(c,) for c in learning.missing_rate_filter(e, e.columns, 0.12)], "column string")


def events_described(spark, sf_dir):
    """Report over all events."""
    return rounded(stats.describe_percentiles(events(spark, sf_dir).withColumn("all", F.lit("all")), ["all"], "value"))


QUERIES = {f.__name__: f for f in (
    merge_inner, merge_left_demographics, merge_visits_dedup, semi_dev, anti_done, split_disjoint, split_overlap, reconcile_counts, union_devices, binary_outcomes, ordinal_cutpoints, cohort, id_split, missingness_profile, value_counts,
    bounds_report, outlier_flags, topn_flags, topn_groups, group_profile, class_balance, cohort_means, cohens_d, mann_whitney_u, spearman, pearson_matrix, ols_line, selection_bias, contingency, stratified_split,
    split_balance, hash_sample, fold_assignment, fold_summary, best_per_group, pairwise_tests, holm_adjust, average_precision, auc_rank, balanced_accuracy_f1, r2_mae, mode_params, selection_summary, missing_rate_filter, events_described)}

_SPLIT = "sp AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('20260414:' || c_custkey), c_custkey) <= floor(count(*) OVER (PARTITION BY c_mktsegment) * 0.15::DOUBLE + 0.5) AS held_out FROM customer)"
_GR = "gr AS (SELECT l.doc_id, quality, lang, n_chars::DOUBLE AS n_chars FROM labels l JOIN documents d USING (doc_id))"
_RANK = "(rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2.0)::DOUBLE"
_U = "u AS (SELECT user_id, avg(value) AS m, max(value) AS top, count(*)::DOUBLE AS n FROM e GROUP BY user_id)"
_FLAGS = f"""{E_SQL}, {_U}, q AS (SELECT {', '.join(f'quantile_cont({c}, 0.25) AS l_{c}, quantile_cont({c}, 0.75) AS h_{c}, avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}' for c in ('m', 'top', 'n'))} FROM u),
 fl AS (SELECT user_id, {', '.join(f'({c} < l_{c} - 1.5 * (h_{c} - l_{c}) OR {c} > h_{c} + 1.5 * (h_{c} - l_{c}))::INTEGER AS iqr_{c}, (abs({c} - a_{c}) / s_{c} > 3.5)::INTEGER AS z_{c}' for c in ('m', 'top', 'n'))} FROM u, q),
 ff AS (SELECT *, iqr_m + iqr_top + iqr_n AS n_flags FROM fl)"""
_MISS = "SELECT 'a' AS \"column\", count(*) FILTER (WHERE event_id % 7 = 0) AS n_missing, round(100 * (count(*) FILTER (WHERE event_id % 7 = 0)) / count(*), 6) AS pct_missing FROM events UNION ALL SELECT 'b', count(*) FILTER (WHERE event_id % 11 = 0), round(100 * (count(*) FILTER (WHERE event_id % 11 = 0)) / count(*), 6) FROM events UNION ALL SELECT 'user_id', 0, 0.0 FROM (SELECT 1)"

ORACLE_SQL = {
    "merge_inner": "SELECT o_custkey, o_orderkey, o_totalprice, c_name, c_nationkey, c_acctbal, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
    "merge_left_demographics": "SELECT c_custkey, c_nationkey, n_name, s.n AS n_suppliers FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s.s_nationkey = c_nationkey",
    "merge_visits_dedup": "SELECT o_custkey AS projid, year(o_orderdate)::INTEGER AS fu_year, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS gait_speed, any_value(c_mktsegment) AS c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "semi_dev": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "anti_done": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "split_disjoint": f"WITH {_SPLIT} SELECT c_custkey FROM sp WHERE held_out INTERSECT SELECT c_custkey FROM sp WHERE NOT held_out",
    "split_overlap": f"WITH {_SPLIT}, s2 AS ({_SPLIT.removeprefix('sp AS (').removesuffix(')').replace('20260414:', '7:')}) SELECT c_custkey FROM sp WHERE held_out INTERSECT SELECT c_custkey FROM s2 WHERE NOT held_out",
    "reconcile_counts": "SELECT o_orderkey, o_orderkey % 8 AS stated, count(l_orderkey) AS counted, o_orderkey % 8 - count(l_orderkey) AS discrepancy FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "union_devices": "SELECT c_custkey AS id, c_acctbal AS bal, 'left' AS device FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier",
    "binary_outcomes": "SELECT c_custkey, (c_acctbal > 0)::DOUBLE AS positive, (nullif(c_nationkey, 3) > 0)::DOUBLE AS nation_yn FROM customer",
    "ordinal_cutpoints": "SELECT p_partkey, (p_size >= 10)::DOUBLE AS ge10, (p_size >= 25)::DOUBLE AS ge25, (p_size >= 40)::DOUBLE AS ge40 FROM part",
    "cohort": "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0",
    "id_split": "SELECT DISTINCT lpad(o_custkey::VARCHAR, 8, '0') || '_0' || (o_orderkey % 10) AS sub_id, o_custkey || '_' || (o_orderkey % 10) AS norm, o_custkey::VARCHAR AS projid, (o_orderkey % 10)::VARCHAR AS fu_year FROM orders",
    "missingness_profile": _MISS,
    "value_counts": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type",
    "bounds_report": "SELECT 'l_quantity' AS metric, count(l_quantity) AS n, count(*) FILTER (WHERE l_quantity < 2 OR l_quantity > 45) AS n_out, round(100 * (count(*) FILTER (WHERE l_quantity < 2 OR l_quantity > 45)) / count(l_quantity), 6) AS pct_out FROM lineitem UNION ALL SELECT 'l_discount', count(l_discount), count(*) FILTER (WHERE l_discount < 0.01::DOUBLE OR l_discount > 0.08::DOUBLE), round(100 * (count(*) FILTER (WHERE l_discount < 0.01::DOUBLE OR l_discount > 0.08::DOUBLE)) / count(l_discount), 6) FROM lineitem",
    "outlier_flags": f"WITH {_FLAGS} SELECT * FROM ff",
    "topn_flags": f"WITH {_FLAGS} SELECT user_id, n_flags FROM ff ORDER BY n_flags DESC, user_id LIMIT 15",
    "topn_groups": "SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders QUALIFY rank <= 30",
    "group_profile": "SELECT l_returnflag, round(avg(l_extendedprice) FILTER (WHERE l_quantity <= 45), 4) AS mean_normal, round(avg(l_extendedprice) FILTER (WHERE l_quantity > 45), 4) AS mean_outlier, round(quantile_cont(l_extendedprice, 0.5) FILTER (WHERE l_quantity <= 45), 4) AS median_normal, round(quantile_cont(l_extendedprice, 0.5) FILTER (WHERE l_quantity > 45), 4) AS median_outlier, round(avg(l_extendedprice) FILTER (WHERE l_quantity > 45) / avg(l_extendedprice) FILTER (WHERE l_quantity <= 45), 4) AS ratio FROM lineitem GROUP BY l_returnflag",
    "class_balance": "WITH y AS (SELECT lang, 'quality' AS outcome, quality AS y FROM labels JOIN documents USING (doc_id) UNION ALL SELECT lang, 'toxic', toxic FROM labels JOIN documents USING (doc_id)), a AS (SELECT lang, outcome, count(y) AS n, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg, avg((y IS NULL)::INTEGER::DOUBLE) AS missing FROM y GROUP BY ALL) SELECT *, n >= 100 AND least(pos, neg) >= 25 AND missing <= 0.3 AS ok FROM a",
    "cohort_means": "WITH a AS (SELECT l_returnflag AS part, count(*) AS c FROM lineitem GROUP BY 1) SELECT part, round(c / (SELECT count(*) FROM lineitem), 6) AS share FROM a",
    "cohens_d": f"WITH {_GR}, a AS (SELECT lang, count(n_chars) FILTER (WHERE quality = 1) AS n1, count(n_chars) FILTER (WHERE quality = 0) AS n0, avg(n_chars) FILTER (WHERE quality = 1) AS m1, avg(n_chars) FILTER (WHERE quality = 0) AS m0, var_samp(n_chars) FILTER (WHERE quality = 1) AS v1, var_samp(n_chars) FILTER (WHERE quality = 0) AS v0 FROM gr GROUP BY lang) SELECT lang, n1, n0, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS d FROM a WHERE n1 >= 10 AND n0 >= 10",
    "mann_whitney_u": f"""WITH {_GR}, r AS (SELECT *, {_RANK.format(k='lang', v='n_chars')} AS r, count(*) OVER (PARTITION BY lang, n_chars)::DOUBLE AS c FROM gr),
 a AS (SELECT lang, count(*) FILTER (WHERE quality = 1) AS n1, count(*) FILTER (WHERE quality = 0) AS n0, sum(r) FILTER (WHERE quality = 1) AS r1, sum(c * c - 1) AS ties, count(*)::DOUBLE AS n FROM r GROUP BY lang),
 u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM a), z AS (SELECT *, (greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / nullif(sqrt(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1)))), 0) AS z FROM u)
 SELECT lang, n1, n0, u, round(CASE WHEN z <= 0 THEN 1 ELSE {normal_two_sided_sql("z")} END, 6) AS p FROM z""",
    "spearman": f"""WITH r AS (SELECT l_returnflag, {_RANK.format(k='l_returnflag', v='l_quantity')} AS a, {_RANK.format(k='l_returnflag', v='l_extendedprice')} AS b FROM lineitem), c AS (SELECT l_returnflag, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY l_returnflag)
 SELECT l_returnflag, n, round(rho, 6) AS rho, round({t_two_sided_sql("(rho * sqrt((n - 2) / (1 - rho * rho)))", "(n - 2)")}, 6) AS p FROM c""",
    "pearson_matrix": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in combinations(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), 2)),
    "ols_line": "SELECT l_returnflag, regr_count(l_extendedprice, l_quantity)::BIGINT AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY l_returnflag",
    "selection_bias": f"""WITH c AS (SELECT c_nationkey < 10 AS g, c_acctbal AS bal, c_acctbal > 0 AS pos FROM customer),
 a AS (SELECT count(bal) FILTER (WHERE g) AS n1, count(bal) FILTER (WHERE NOT g) AS n0, avg(bal) FILTER (WHERE g) AS m1, avg(bal) FILTER (WHERE NOT g) AS m0, var_samp(bal) FILTER (WHERE g) AS v1, var_samp(bal) FILTER (WHERE NOT g) AS v0,
   (count(*) FILTER (WHERE g AND pos))::DOUBLE AS a11, (count(*) FILTER (WHERE g AND NOT pos))::DOUBLE AS a10, (count(*) FILTER (WHERE NOT g AND pos))::DOUBLE AS a01, (count(*) FILTER (WHERE NOT g AND NOT pos))::DOUBLE AS a00 FROM c)
 SELECT 'bal' AS variable, 'continuous' AS kind, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS statistic, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS effect,
   round({t_two_sided_sql("((m1 - m0) / sqrt(v1 / n1 + v0 / n0))", "(power(v1 / n1 + v0 / n0, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v0 / n0, 2) / (n0 - 1)))")}, 6) AS p FROM a
 UNION ALL SELECT 'pos', 'binary', round((a00 + a01 + a10 + a11) * power(greatest(abs(a00 * a11 - a01 * a10) - (a00 + a01 + a10 + a11) / 2, 0), 2) / ((a00 + a01) * (a10 + a11) * (a00 + a10) * (a01 + a11)), 6), round(2 * asin(sqrt(a11 / (a10 + a11))) - 2 * asin(sqrt(a01 / (a00 + a01))), 6),
   round({normal_two_sided_sql("sqrt((a00 + a01 + a10 + a11) * power(greatest(abs(a00 * a11 - a01 * a10) - (a00 + a01 + a10 + a11) / 2, 0), 2) / ((a00 + a01) * (a10 + a11) * (a00 + a10) * (a01 + a11)))")}, 6) FROM a""",
    "contingency": "SELECT quality, count(*) FILTER (WHERE toxic = 0) AS toxic_0, count(*) FILTER (WHERE toxic = 1) AS toxic_1 FROM labels GROUP BY quality",
    "stratified_split": f"WITH {_SPLIT} SELECT c_custkey, c_mktsegment, held_out FROM sp",
    "split_balance": f"WITH {_SPLIT}, q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS c FROM customer) SELECT held_out, CASE WHEN c_acctbal IS NULL THEN 'missing' WHEN c_acctbal <= a THEN 'q1' WHEN c_acctbal <= b THEN 'q2' WHEN c_acctbal <= c THEN 'q3' ELSE 'q4' END AS bucket, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM sp, q GROUP BY 1, 2",
    "hash_sample": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 3000",
    "fold_assignment": "SELECT doc_id, quality, r.repeat::INTEGER AS repeat, ((row_number() OVER (PARTITION BY r.repeat, quality ORDER BY md5('42:' || r.repeat || ':' || doc_id), doc_id) - 1) % 5)::INTEGER AS fold FROM labels, (SELECT unnest(range(3)) AS repeat) r",
    "fold_summary": f"WITH {CELLS_SQL} SELECT outcome, features, model, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, count(score) AS n_folds FROM cells GROUP BY ALL",
    "best_per_group": f"WITH {CELLS_SQL}, s AS (SELECT outcome, features, model, avg(score) AS mean FROM cells GROUP BY ALL) SELECT outcome, features, model, round(mean, 6) AS mean FROM s QUALIFY row_number() OVER (PARTITION BY outcome, features ORDER BY mean DESC, model) = 1",
    "pairwise_tests": f"""WITH {TESTS_SQL}, u AS (SELECT *, delta / nullif(se, 0) AS t_stat, n - 1 AS df FROM t), v AS (SELECT *, {t_two_sided_sql("t_stat", "df")} AS p, {T_CRITICAL_SQL} * se AS width FROM u)
 SELECT outcome, model, set_a, set_b, n, round(delta, 6) AS delta, round(se, 6) AS se, round(t_stat, 6) AS t_stat, df, round(p, 6) AS p, round(delta - width, 6) AS low, round(delta + width, 6) AS high FROM v""",
    "holm_adjust": f"""WITH {TESTS_SQL}, p AS (SELECT outcome, model, set_a, set_b, {t_two_sided_sql("(delta / se)", "(n - 1)")} AS p FROM t), r AS (SELECT *, (count(*) OVER (PARTITION BY outcome, model) - row_number() OVER (PARTITION BY outcome, model ORDER BY p) + 1) * p AS r FROM p),
 h AS (SELECT *, least(max(r) OVER (PARTITION BY outcome, model ORDER BY p ROWS UNBOUNDED PRECEDING), 1.0) AS h FROM r) SELECT outcome, model, set_a, set_b, round(p, 6) AS p, round(h, 6) AS p_holm, h < 0.05 AS reject FROM h""",
    "average_precision": f"WITH {_GR}, s AS (SELECT lang, n_chars, sum(quality) AS tp, count(*) AS n FROM gr GROUP BY ALL), r AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM s WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING)) SELECT lang, round(sum(tp * ctp / cn) / nullif(sum(tp), 0), 6) AS ap FROM r GROUP BY lang",
    "auc_rank": f"WITH {_GR}, r AS (SELECT *, {_RANK.format(k='lang', v='n_chars')} AS r FROM gr), a AS (SELECT lang, sum(r) FILTER (WHERE quality = 1) AS r, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS q FROM r GROUP BY lang) SELECT lang, round((r - p * (p + 1) / 2) / nullif(p * q, 0), 6) AS auc FROM a",
    "balanced_accuracy_f1": f"WITH {_GR}, a AS (SELECT lang, count(*) FILTER (WHERE n_chars > 1500 AND quality = 1) AS tp, count(*) FILTER (WHERE n_chars > 1500 AND quality = 0) AS fp, count(*) FILTER (WHERE n_chars <= 1500 AND quality = 1) AS fn, count(*) FILTER (WHERE n_chars <= 1500 AND quality = 0) AS tn FROM gr GROUP BY lang) SELECT lang, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM a",
    "r2_mae": "SELECT l_returnflag, round(1 - sum(power(l_extendedprice - l_quantity * 1500, 2)) / (var_pop(l_extendedprice) * count(*)), 4) AS r2, round(avg(abs(l_extendedprice - l_quantity * 1500)), 4) AS mae FROM lineitem GROUP BY l_returnflag",
    "mode_params": "SELECT c_nationkey, c_mktsegment AS mode FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1",
    "selection_summary": f"WITH {CELLS_SQL} SELECT features AS strategy, round(avg(score), 3) AS mean_score, count(*) AS n FROM cells GROUP BY features",
    "missing_rate_filter": f"SELECT \"column\" FROM ({_MISS}) WHERE pct_missing < 12",
    "events_described": "SELECT 'all' AS \"all\", count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{round(q * 100)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + ", max(value) AS max FROM events",
}
