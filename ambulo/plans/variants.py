"""Queries of outcomes, labels and histograms over customers and events; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import variants
from .subjects import E_SQL, events, rounded


def visit_outcomes(spark, sf_dir):
    """Outcomes with their fallback, and the age at the visit."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    visits = c.select("c_custkey", F.nullif(F.floor(F.col("c_acctbal") / 3000).cast("int"), F.lit(1)).alias("rosbsum"), F.nullif(F.col("c_nationkey") % 4, F.lit(3)).alias("dcfdx_3gp"), (60.5 + F.col("c_nationkey")).alias("age_bl"), (F.col("c_custkey") % 10).alias("fu_year"))
    return variants.with_outcomes(visits).drop("rosbsum", "dcfdx_3gp", "age_bl", "fu_year")


def phenotype_labels(spark, sf_dir):
    """The events of the users with the smallest and the largest spread, and a flag of the event's kind."""
    e = events(spark, sf_dir)
    scores = e.groupBy("user_id").agg(F.stddev_pop("value").alias("spread"))
    rows = variants.label_extremes(e.select("user_id", "event_id", "event_type"), scores, "user_id", "spread", "stable", "unstable")
    return rows.select("user_id", "event_id", "phenotype", variants.device_flag(F.col("event_type"), ("click", "view")).alias("flag"))


def histogram_ranges(spark, sf_dir):
    """A5: histograms by stated ranges, on a logarithmic scale where the metric has one, and by the data's own range."""
    e = events(spark, sf_dir)
    long = e.select("user_id", (F.col("value") / 100).alias("speed"), (F.col("value") / 83).alias("pa_variability"), (F.col("value") * 3).alias("total_steps")).unpivot(["user_id"], ["speed", "pa_variability", "total_steps"], "metric", "x")
    return rounded(variants.histograms(long, "user_id"))


QUERIES = {f.__name__: f for f in (visit_outcomes, phenotype_labels, histogram_ranges)}

ORACLE_SQL = {
    "visit_outcomes": """SELECT c_custkey, (r > 0)::DOUBLE AS mobility_disability_binary, NULL::DOUBLE AS falls_binary, (d > 1)::DOUBLE AS cognitive_impairment, 60.5::DOUBLE + c_nationkey + c_custkey % 10 AS age_at_visit
 FROM (SELECT *, nullif(floor(c_acctbal / 3000)::INTEGER, 1) AS r, nullif(c_nationkey % 4, 3) AS d FROM customer)""",
    "phenotype_labels": f"""WITH {E_SQL}, s AS (SELECT user_id, stddev_pop(value) AS spread FROM e GROUP BY user_id), lo AS (SELECT user_id FROM s ORDER BY spread, user_id LIMIT 1), hi AS (SELECT user_id FROM s ORDER BY spread DESC, user_id LIMIT 1)
 SELECT user_id, event_id, CASE WHEN user_id = (SELECT user_id FROM lo) THEN 'stable' ELSE 'unstable' END AS phenotype, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 END AS flag FROM e WHERE user_id IN (SELECT user_id FROM lo UNION ALL SELECT user_id FROM hi)""",
    "histogram_ranges": f"""WITH {E_SQL}, l AS (SELECT user_id, 'speed' AS metric, value / 100 AS v FROM e UNION ALL SELECT user_id, 'pa_variability', value / 83 FROM e UNION ALL SELECT user_id, 'total_steps', ln(1 + value * 3) FROM e),
 r AS (SELECT user_id, metric, CASE WHEN metric = 'speed' THEN 0.1::DOUBLE ELSE min(v) END AS lo, CASE WHEN metric = 'speed' THEN 1.5::DOUBLE WHEN max(v) > min(v) THEN max(v) ELSE min(v) + 1 END AS hi FROM l GROUP BY user_id, metric),
 b AS (SELECT user_id, metric, least(floor((v - lo) * 10 / (hi - lo))::INTEGER, 9) AS bin FROM l JOIN r USING (user_id, metric) WHERE v BETWEEN lo AND hi),
 c AS (SELECT user_id, metric, t.k::INTEGER AS bin, (SELECT count(*) FROM b WHERE b.user_id = r.user_id AND b.metric = r.metric AND b.bin = t.k) AS freq FROM r, range(10) t(k))
 SELECT user_id, metric, bin, freq, round(coalesce(freq / nullif(sum(freq) OVER (PARTITION BY user_id, metric), 0), 0), 6) AS prob FROM c""",
}
