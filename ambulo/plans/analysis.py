"""Queries of named contrasts, curves, densities, reports in stated orders and column expressions; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import calendar, inference, learning, relational
from .kernels import _matrix
from .reports import _GR, CELLS_SQL, TESTS_SQL, _cells, _graded, _scored, _t, _tests, t_two_sided_sql
from .subjects import E_SQL, POS_SQL, S, events, positions, rounded

CONTRASTS = (("three_vs_one", "primary", 3, 1), ("five_vs_two", "primary", 5, 2), ("seven_vs_one", "sensitivity", 7, 1))


def contrasts(spark, sf_dir):
    """Named pairs of feature sets, by the folds of the best model of each."""
    cells = _cells(spark, sf_dir)
    best = inference.best_per_group(inference.fold_summary(cells, ["outcome", "features", "model"], "score"), ["outcome", "features"], "mean", "model").select("outcome", "features", "model")
    named = spark.createDataFrame(CONTRASTS, "contrast string, family string, set_a int, set_b int")
    return rounded(inference.contrasts(cells.join(best, ["outcome", "features", "model"]), named, "outcome", "features", "fold", "score").drop("se"))


def headline(spark, sf_dir):
    """Set 6 less set 2, whichever way round they were tested."""
    return rounded(inference.headline(_tests(spark, sf_dir), 6, 2, ["outcome", "model"]))


def selection_sensitivity(spark, sf_dir):
    """Two ways of selection compared on the folds of each outcome and feature set."""
    return rounded(inference.corrected_test(_cells(spark, sf_dir), ["outcome", "features"], "model", "fold", "score").select("outcome", "features", "set_a", "set_b", "n", "delta", "p"))


def roc_pr_curves(spark, sf_dir):
    return rounded(inference.curves(_scored(spark, sf_dir), ["lang"], "n_chars", "y"))


def value_density(spark, sf_dir):
    return rounded(inference.density(events(spark, sf_dir), ["event_type"], "value", 20))


def _effects(spark, sf_dir) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select("l_linenumber", "l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("g"))
    return inference.cohens_d(li, ["l_linenumber"], "l_extendedprice", "g")


def topn_effect(spark, sf_dir):
    """K1: the features of the largest effect."""
    return rounded(relational.top_n(_effects(spark, sf_dir).withColumn("abs_d", F.abs("d")), [F.desc("abs_d"), F.col("l_linenumber")], 3))


def topn_correlation(spark, sf_dir):
    """K2: the features of the largest rank correlation."""
    rho = inference.spearman(_t(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", "l_extendedprice"), ["l_linenumber"], "l_quantity", "l_extendedprice").drop("p")
    return rounded(relational.top_n(rho.withColumn("abs_rho", F.abs("rho")), [F.desc("abs_rho"), F.col("l_linenumber")], 3))


def multi_flags(spark, sf_dir):
    """K4: suppliers with two flags and more, the first 20."""
    s = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("e"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.count(F.lit(1)).cast("double").alias("n"))
    flags = relational.outlier_flags(s, ["l_suppkey"], ["q", "e", "d", "t", "n"])
    return relational.top_n(flags.where("n_flags >= 2").select("l_suppkey", "n_flags"), [F.desc("n_flags"), F.col("l_suppkey")], 20)


def priority_report(spark, sf_dir):
    """K6, K7: order priorities in their stated order, with their share of orders."""
    o = _t(spark, sf_dir, "orders")
    held = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    shares = held.join(held.agg(F.sum("n").alias("_all")), F.lit(True)).select("o_orderpriority", (F.col("n") / F.col("_all")).alias("share"))  # one row
    named = relational.in_order(shares, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], [F.desc("share")])
    return rounded(relational.in_order(named.withColumnRenamed("place", "stated"), "o_orderpriority", [], [F.desc("share"), F.col("o_orderpriority")]).withColumnRenamed("place", "by_share"))


def quarter_split(spark, sf_dir):
    """A quarter of the labels held out, by class."""
    return relational.stratified_split(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality", 0.25, 42)


def merge_postmortem(spark, sf_dir):
    """Lines with their order by two keys, then with the customer by one; a column of the right that is not wanted goes."""
    li, o = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders")
    gait = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity")).withColumnRenamed("l_orderkey", "o_orderkey").join(o.select("o_orderkey", "o_custkey"), "o_orderkey")
    both = relational.merge_clinical(gait, o.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey", "o_custkey"])
    c = _t(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey").drop("study", "c_comment")
    return rounded(relational.merge_clinical(both, c.select("o_custkey", "c_mktsegment"), ["o_custkey"]))


def signal_columns(spark, sf_dir):
    """Column expressions over events as samples of three axes."""
    e = events(spark, sf_dir)
    x, y, z = F.col("value") / 300, (F.col("event_id") % 100) / 100.0, 1 - F.col("value") / 500
    return rounded(e.select(
        "event_id", columns.magnitude(x, y, z).alias("vm"), columns.enmo(x, y, z).alias("enmo"), columns.arm_angle(x, y, z).alias("angle"), columns.stride_length(x, F.col("event_id") % 3).alias("stride"),
        columns.clock_hour(F.col("hour")).alias("clock"), columns.day_part(F.col("hour")).alias("part"), columns.grid_time(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("event_id"), 30.0).alias("grid"),
    ))


def parsed_times(spark, sf_dir):
    """Day and hour of texts that may not be times."""
    text = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    e = events(spark, sf_dir).select("event_id", F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).alias("t"))
    return e.select("event_id", F.to_date("t").cast("string").alias("day"), F.hour("t").alias("hour"))


def hourly_max(spark, sf_dir):
    """The greatest state of each hour."""
    e = events(spark, sf_dir).withColumn("h", F.floor(F.col("sec") / 3600)).withColumn("state", (F.col("value") > 50).cast("int"))
    return calendar.to_grid(e, S, "h", "state", "max")


def epoch_mask(spark, sf_dir):
    """Epochs of five samples in which any is non-wear."""
    return calendar.masked_epochs(positions(spark, sf_dir).withColumn("nonwear", F.col("value") > 150), S, "i", "nonwear", 5)


def variance_filter(spark, sf_dir):
    """M3: columns that vary, of the embeddings and a constant."""
    df, cols = _matrix(spark, sf_dir)
    kept = learning.variance_filter(df.withColumn("flat", F.lit(1.0)), [*cols[:2], "flat", *cols[2:]])
    return spark.createDataFrame([(c,) for c in kept], "feature string")


QUERIES = {f.__name__: f for f in (
    contrasts, headline, selection_sensitivity, roc_pr_curves, value_density, topn_effect, topn_correlation, multi_flags, priority_report, quarter_split, merge_postmortem, signal_columns, parsed_times, hourly_max, epoch_mask, variance_filter)}

_TESTED = f"u AS (SELECT *, delta / nullif(se, 0) AS t_stat, n - 1 AS df FROM t), v AS (SELECT *, {t_two_sided_sql('t_stat', 'df')} AS p, 2.1447866879178 * se AS width FROM u)"
_HOLM = "least(max(r) OVER (PARTITION BY {0} ORDER BY p ROWS UNBOUNDED PRECEDING), 1.0)"
_RAISED = "(count(*) OVER (PARTITION BY {0}) - row_number() OVER (PARTITION BY {0} ORDER BY p) + 1) * p"
_NAMED = ", ".join(f"('{c}', '{f}', {a}, {b})" for c, f, a, b in CONTRASTS)
_AVG_RANK = "(rank() OVER (PARTITION BY l_linenumber ORDER BY {0}) + (count(*) OVER (PARTITION BY l_linenumber, {0}) - 1) / 2.0)::DOUBLE"
_M = ("q", "e", "d", "t", "n")

ORACLE_SQL = {
    "contrasts": f"""WITH {CELLS_SQL}, s AS (SELECT outcome, features, model, avg(score) AS mean FROM cells GROUP BY ALL), bs AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY outcome, features ORDER BY mean DESC, model) = 1),
 bf AS (SELECT cells.* FROM cells JOIN bs USING (outcome, features, model)), nm(contrast, family, set_a, set_b) AS (VALUES {_NAMED}),
 d AS (SELECT contrast, family, a.outcome, set_a, set_b, a.score - b.score AS d FROM nm JOIN bf a ON a.features = set_a JOIN bf b ON b.features = set_b AND b.outcome = a.outcome AND b.fold = a.fold),
 t AS (SELECT contrast, family, outcome, set_a, set_b, count(d) AS n, avg(d) AS delta, sqrt((1.0::DOUBLE / count(d) + 0.25) * var_samp(d)) AS se FROM d GROUP BY ALL), {_TESTED},
 r AS (SELECT *, {_RAISED.format('contrast')} AS r FROM v), h AS (SELECT *, {_HOLM.format('contrast')} AS h FROM r)
 SELECT contrast, family, outcome, set_a, set_b, n, round(delta, 6) AS delta, round(t_stat, 6) AS t_stat, df, round(p, 6) AS p, round(delta - width, 6) AS low, round(delta + width, 6) AS high,
   CASE WHEN family = 'primary' THEN round(h, 6) END AS p_holm, CASE WHEN family = 'primary' THEN h < 0.05 END AS reject FROM h""",
    "headline": f"""WITH {TESTS_SQL}, {_TESTED}, o AS (SELECT outcome, model, -delta AS delta, -delta - width AS low, -delta + width AS high, p FROM v WHERE set_a = 2 AND set_b = 6),
 r AS (SELECT *, {_RAISED.format('1')} AS r FROM o), h AS (SELECT *, {_HOLM.format('1')} AS h FROM r)
 SELECT outcome, model, 6 AS set_a, 2 AS set_b, round(delta, 6) AS delta, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p, round(h, 6) AS p_holm, h < 0.05 AS reject FROM h""",
    "selection_sensitivity": f"""WITH {CELLS_SQL}, d AS (SELECT a.outcome, a.features, a.model AS set_a, b.model AS set_b, a.score - b.score AS d FROM cells a JOIN cells b ON a.outcome = b.outcome AND a.features = b.features AND a.fold = b.fold AND a.model < b.model),
 t AS (SELECT outcome, features, set_a, set_b, count(d) AS n, avg(d) AS delta, sqrt((1.0::DOUBLE / count(d) + 0.25) * var_samp(d)) AS se FROM d GROUP BY ALL), {_TESTED}
 SELECT outcome, features, set_a, set_b, n, round(delta, 6) AS delta, round(p, 6) AS p FROM v""",
    "roc_pr_curves": f"""WITH {_GR}, s AS (SELECT lang, n_chars, sum(quality) AS tp, count(*) - sum(quality) AS fp FROM gr GROUP BY ALL), r AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, sum(tp) OVER (PARTITION BY lang) AS p, sum(fp) OVER (PARTITION BY lang) AS q FROM s WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING))
 SELECT lang, n_chars, round(ctp / nullif(p, 0), 6) AS tpr, round(cfp / nullif(q, 0), 6) AS fpr, round(ctp / nullif(ctp + cfp, 0), 6) AS precision FROM r""",
    "value_density": f"""WITH {E_SQL}, n AS (SELECT event_type, count(value) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) * power(count(value), -0.2::DOUBLE) AS h FROM e GROUP BY event_type),
 g AS (SELECT *, unnest(range(20))::INTEGER AS i FROM n), x AS (SELECT *, lo + (hi - lo) * i / 19 AS x FROM g) SELECT x.event_type, i, round(x, 6) AS x, round(sum(exp(-power((x - value) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density FROM x JOIN e USING (event_type) GROUP BY x.event_type, i, x""",
    "topn_effect": """WITH a AS (SELECT l_linenumber, count(*) FILTER (WHERE l_returnflag = 'R') AS n1, count(*) FILTER (WHERE l_returnflag <> 'R') AS n0, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS m1, avg(l_extendedprice) FILTER (WHERE l_returnflag <> 'R') AS m0,
   var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS v1, var_samp(l_extendedprice) FILTER (WHERE l_returnflag <> 'R') AS v0 FROM lineitem GROUP BY 1), d AS (SELECT *, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS d FROM a WHERE n1 >= 10 AND n0 >= 10)
 SELECT l_linenumber, n1, n0, round(d, 6) AS d, round(abs(d), 6) AS abs_d FROM d ORDER BY abs(d) DESC, l_linenumber LIMIT 3""",
    "topn_correlation": f"""WITH r AS (SELECT l_linenumber, {_AVG_RANK.format('l_quantity')} AS a, {_AVG_RANK.format('l_extendedprice')} AS b FROM lineitem), c AS (SELECT l_linenumber, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY l_linenumber)
 SELECT l_linenumber, n, round(rho, 6) AS rho, round(abs(rho), 6) AS abs_rho FROM c ORDER BY abs(rho) DESC, l_linenumber LIMIT 3""",
    "multi_flags": f"""WITH u AS (SELECT l_suppkey, avg(l_quantity) AS q, avg(l_extendedprice) AS e, avg(l_discount) AS d, avg(l_tax) AS t, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), w AS (SELECT {', '.join(f'quantile_cont({c}, 0.25) AS l_{c}, quantile_cont({c}, 0.75) AS h_{c}' for c in _M)} FROM u),
 f AS (SELECT l_suppkey, {' + '.join(f'({c} < l_{c} - 1.5 * (h_{c} - l_{c}) OR {c} > h_{c} + 1.5 * (h_{c} - l_{c}))::INTEGER' for c in _M)} AS n_flags FROM u, w) SELECT l_suppkey, n_flags FROM f WHERE n_flags >= 2 ORDER BY n_flags DESC, l_suppkey LIMIT 20""",
    "priority_report": """WITH a AS (SELECT o_orderpriority, count(*) / sum(count(*)) OVER () AS share FROM orders GROUP BY 1)
 SELECT o_orderpriority, round(share, 6) AS share, row_number() OVER (ORDER BY coalesce(nullif(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority), 0), 6), share DESC)::INTEGER AS stated, row_number() OVER (ORDER BY share DESC, o_orderpriority)::INTEGER AS by_share FROM a""",
    "quarter_split": "SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) <= floor(count(*) OVER (PARTITION BY quality) * 0.25::DOUBLE + 0.5) AS held_out FROM labels",
    "merge_postmortem": "SELECT o_orderkey, o_custkey, round(sum(l_quantity), 6) AS quantity, o_totalprice, c_mktsegment FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL",
    "signal_columns": f"""WITH {E_SQL}, a AS (SELECT event_id, hour, value / 300 AS x, (event_id % 100) / 100.0::DOUBLE AS y, 1 - value / 500 AS z FROM e)
 SELECT event_id, round(sqrt(x * x + y * y + z * z), 6) AS vm, round(greatest(sqrt(x * x + y * y + z * z) - 1, 0) * 1000, 6) AS enmo, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS angle, CASE WHEN event_id % 3 > 0 THEN round(120 * x / (event_id % 3), 6) END AS stride,
   hour - 24 * (hour >= 12)::INTEGER AS clock, CASE WHEN hour < 6 THEN 'night' WHEN hour < 12 THEN 'morning' WHEN hour < 17 THEN 'afternoon' ELSE 'evening' END AS part, TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(event_id * 33) AS grid FROM a""",
    "parsed_times": "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN ts::DATE::VARCHAR END AS day, CASE WHEN event_id % 5 <> 0 THEN hour(ts) END AS hour FROM events",
    "hourly_max": f"""WITH {E_SQL}, hh AS (SELECT user_id, sec // 3600 AS h, max((value > 50)::INTEGER) AS value FROM e GROUP BY ALL), gr AS (SELECT user_id, unnest(range(min(h), max(h) + 1)) AS h FROM hh GROUP BY user_id) SELECT gr.user_id, gr.h, hh.value FROM gr LEFT JOIN hh USING (user_id, h)""",
    "epoch_mask": f"WITH {POS_SQL} SELECT user_id, (i // 5)::INTEGER AS epoch, bool_or(value > 150) AS masked FROM q GROUP BY ALL",
    "variance_filter": "SELECT 'f' || k AS feature FROM (SELECT unnest(range(len(embedding))) AS k, unnest(embedding) AS v FROM embeddings) GROUP BY k HAVING var_pop(v) > 1e-8",
}
