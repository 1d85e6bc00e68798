"""Queries whose operators SQL cannot express: signal kernels, scorers, selection and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cells, learning, signal
from ..sources.stored import stored
from .sleep import recording
from .subjects import S, positions, rounded

HZ = 4.0


def _by_user(spark, sf_dir, kernel, columns) -> DataFrame:
    return signal.by_bout(positions(spark, sf_dir), S, "i", "value", kernel, columns)


def stride_regularity(spark, sf_dir):
    return _by_user(spark, sf_dir, lambda x: {"regularity_sp": signal.stride_regularity(x, HZ)}, {"regularity_sp": "double"})


def sample_entropy(spark, sf_dir):
    """Of each half day of a recording's activity."""
    parts = recording(spark, sf_dir).withColumn("part", F.floor(F.col("i") / 432).cast("int"))
    return signal.by_bout(parts, ["user_id", "part"], "i", "enmo", lambda x: {"entropy": signal.sample_entropy(x)}, {"entropy": "double"})


def psd_features(spark, sf_dir):
    return _by_user(spark, sf_dir, lambda x: signal.psd_features(x, HZ), {"dom_freq": "double", "psd_amp": "double", "psd_width": "double", "psd_slope": "double"})


def wasserstein_normal(spark, sf_dir):
    return _by_user(spark, sf_dir, lambda x: {"w1": signal.wasserstein_to_normal(x)}, {"w1": "double"})


def dip_statistic(spark, sf_dir):
    """Dip and its p-value."""
    found = _by_user(spark, sf_dir, lambda x: {"dip": signal.dip(x), "n": len(x)}, {"dip": "double", "n": "int"})
    return signal.with_dip_p(found, "n", "dip", stored(signal.dip_null(spark)))


def score_windows(spark, sf_dir):
    return signal.score_windows(signal.windows_of(positions(spark, sf_dir), S, "i", "value", 10, 5), ["user_id", "w_idx"], "window")


def _matrix(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """Embeddings as a feature matrix: a column for each element and a binary class."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cols = [f"f{k}" for k in range(e.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    return e.select("vec_id", (F.col("label") < 5).cast("int").alias("y"), *(F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(cols))), cols


def _names(spark, names: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "place int, feature string")


def corr_filter(spark, sf_dir):
    df, cols = _matrix(spark, sf_dir)
    return _names(spark, learning.correlation_filter(df, cols, 0.3))


def select_k_best(spark, sf_dir):
    df, cols = _matrix(spark, sf_dir)
    return _names(spark, learning.select_k_best(df, cols, "y", 5))


def mrmr(spark, sf_dir):
    df, cols = _matrix(spark, sf_dir)
    return _names(spark, learning.mrmr(df, cols, "y", 6))


def nearest_information(spark, sf_dir):
    """M7: mutual information of each element with the class, by three nearest neighbours."""
    df, cols = _matrix(spark, sf_dir)
    return rounded(learning.nearest_information(df, cols, "y"))


def consensus_selection(spark, sf_dir):
    df, cols = _matrix(spark, sf_dir)
    return _names(spark, learning.consensus(df, cols, "y", 6))


def stability_selection(spark, sf_dir):
    df, cols = _matrix(spark, sf_dir)
    return _names(spark, learning.stability_selection(df, "vec_id", cols, "y"))


def block_pca(spark, sf_dir):
    df, cols = _matrix(spark, sf_dir)
    b, c = len(cols) // 2, len(cols) * 7 // 8
    out, names = learning.block_pca(df, df, {"a": cols[:b], "b": cols[b:c], "c": cols[c:]})
    return out.select("vec_id", *(F.round(n, 6).alias(n) for n in names))


def rbf_out_of_fold(spark, sf_dir):
    """Each row's score by a kernel machine that did not see its fold."""
    df, cols = _matrix(spark, sf_dir)
    made, names = cells.fourier_features(df, cols, 0.5)
    return cells.out_of_fold(made, "vec_id", names, "y")


def importances(spark, sf_dir):
    """The thirty features whose values matter most on held-out rows."""
    df, cols = _matrix(spark, sf_dir)
    return rounded(cells.importances(df, "vec_id", cols, "y").orderBy(F.desc("importance"), "feature").limit(30))


def nested_cv(spark, sf_dir):
    """The five strategies with balanced logistic models."""
    df, cols = _matrix(spark, sf_dir)
    return cells.nested_cv(df, "vec_id", cols, "y")


def nested_cv_line(spark, sf_dir):
    """The last element from the others, by least squares."""
    df, cols = _matrix(spark, sf_dir)
    return cells.nested_cv_line(df, "vec_id", cols[:-1], cols[-1])


def nested_sides(spark, sf_dir):
    """On which part of each inner and outer side every row is."""
    df, _ = _matrix(spark, sf_dir)
    held = cells.nested_sides(df, "vec_id", "y")
    return held.select("vec_id", F.array_join(F.col("sides").cast("array<string>"), "").alias("sides"))


QUERIES = {f.__name__: f for f in (stride_regularity, sample_entropy, psd_features, wasserstein_normal, dip_statistic, score_windows, corr_filter, select_k_best, mrmr, consensus_selection, stability_selection, block_pca, rbf_out_of_fold, importances, nested_cv, nested_cv_line, nested_sides, nearest_information)}

_SIDES = "".join(f" || CASE WHEN g = {i} THEN '2' ELSE '1' END" for i in range(3))[4:]

_LONG_SQL = "l AS MATERIALIZED (SELECT vec_id, (label < 5)::INTEGER AS y, j, embedding[j + 1]::DOUBLE AS x FROM embeddings, range(64) t(j))"
_CORR_SQL = "c AS MATERIALIZED (SELECT a.j AS i, b.j AS j, corr(a.x, b.x) AS r FROM l a JOIN l b USING (vec_id) GROUP BY a.j, b.j)"
#: psi(n) of whole numbers is the harmonic number of n - 1 less Euler's constant, which cancels out.
ORACLE_SQL = {
    "nearest_information": """WITH l AS (SELECT 'f' || j AS feature, (label < 5)::INTEGER AS y, embedding[j + 1]::DOUBLE AS x FROM embeddings, range(64) t(j)),
 s AS (SELECT *, count(*) OVER (PARTITION BY feature, y) AS ny FROM l WHERE x IS NOT NULL AND y IS NOT NULL),
 d AS (SELECT *, list_sort([z FOR z IN [abs(x - lag(x, 1) OVER o), abs(x - lag(x, 2) OVER o), abs(x - lag(x, 3) OVER o), abs(x - lead(x, 1) OVER o), abs(x - lead(x, 2) OVER o), abs(x - lead(x, 3) OVER o)] IF z IS NOT NULL])[least(3, ny - 1)] * (1 - 1e-12) AS d
   FROM s WHERE ny > 1 WINDOW o AS (PARTITION BY feature, y ORDER BY x)),
 m AS (SELECT a.feature, a.x, a.y, any_value(a.ny) AS ny, count(*) // count(DISTINCT a.r) AS m, count(DISTINCT a.r) AS times FROM (SELECT *, row_number() OVER () AS r FROM d) a JOIN d b ON a.feature = b.feature AND b.x BETWEEN a.x - a.d AND a.x + a.d GROUP BY a.feature, a.x, a.y),
 h AS (SELECT n, coalesce(sum(1.0::DOUBLE / (n - 1)) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS psi FROM (SELECT n FROM range(2, 1 + (SELECT count(*) FROM embeddings)) t(n))), p AS (SELECT 1 AS n, 0.0::DOUBLE AS psi UNION ALL SELECT n, psi FROM h)
SELECT feature, round(greatest(any_value(pn.psi) + sum(times * pk.psi) / sum(times) - sum(times * py.psi) / sum(times) - sum(times * pm.psi) / sum(times), 0), 6) AS mi
FROM m JOIN (SELECT feature, count(*) AS n FROM d GROUP BY feature) c USING (feature) JOIN p pn ON pn.n = c.n JOIN p pk ON pk.n = least(3, ny - 1) JOIN p py ON py.n = ny JOIN p pm ON pm.n = m.m GROUP BY feature """,
    "nested_sides": f"""WITH m AS (SELECT vec_id, (label < 5)::INTEGER AS y FROM embeddings),
 o AS (SELECT vec_id, y, r, (row_number() OVER (PARTITION BY r, y ORDER BY md5('42:' || r || ':' || vec_id), vec_id) - 1) % 5 AS f FROM m, range(3) t(r)),
 c AS (SELECT *, q FROM o, range(5) t(q)),
 i AS (SELECT *, (row_number() OVER (PARTITION BY r, q, y ORDER BY md5('42:' || r || ':' || q || ':' || vec_id), vec_id) - 1) % 3 AS g FROM c WHERE f <> q),
 s AS (SELECT vec_id, r, q, {_SIDES} || '1' AS codes FROM i UNION ALL SELECT vec_id, r, q, '0002' FROM c WHERE f = q)
SELECT vec_id, string_agg(codes, '' ORDER BY r, q) AS sides FROM s GROUP BY vec_id""",
    "select_k_best": f"""WITH {_LONG_SQL}, g AS (SELECT j, y, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM l GROUP BY j, y), a AS (SELECT j, sum(n) AS n, sum(n * m) / sum(n) AS grand FROM g GROUP BY j),
 f AS (SELECT j, sum(g.n * power(m - grand, 2)) / (count(*) - 1) / (sum(g.n * v) / (any_value(a.n) - count(*))) AS f FROM g JOIN a USING (j) GROUP BY j)
SELECT (row_number() OVER (ORDER BY j) - 1)::INTEGER AS place, 'f' || j AS feature FROM (SELECT j FROM f ORDER BY f DESC, j LIMIT 5)""",
    "corr_filter": f"""WITH RECURSIVE {_LONG_SQL}, {_CORR_SQL}, far AS (SELECT i, list(j) AS js FROM c WHERE abs(r) > 0.3 AND j < i GROUP BY i),
 k(i, kept) AS (SELECT -1::BIGINT, []::BIGINT[] UNION ALL SELECT k.i + 1, CASE WHEN list_has_any(kept, coalesce(js, [])) THEN kept ELSE list_append(kept, k.i + 1) END FROM k LEFT JOIN far ON far.i = k.i + 1 WHERE k.i < 63)
SELECT place::INTEGER AS place, 'f' || j AS feature FROM (SELECT unnest(kept) AS j, generate_subscripts(kept, 1) - 1 AS place FROM k WHERE i = 63)""",
}
# Greedily, the feature of the largest information less its mean squared correlation with those chosen.
ORACLE_SQL["mrmr"] = f"""WITH RECURSIVE {_LONG_SQL}, {_CORR_SQL}, mi AS MATERIALIZED ({ORACLE_SQL["nearest_information"].replace("round(greatest(", "(greatest(").replace(", 0), 6) AS mi", ", 0)) AS mi")}),
 w AS MATERIALIZED (SELECT c.i AS j, list(r * r ORDER BY c.j) AS rr, any_value(mi.mi) AS mi FROM c JOIN mi ON mi.feature = 'f' || c.i GROUP BY c.i),
 k(n, chosen) AS (SELECT 0, []::BIGINT[] UNION ALL SELECT any_value(n) + 1, list_append(any_value(chosen), arg_max(j, mi - CASE WHEN n = 0 THEN 0 ELSE list_avg(list_transform(chosen, lambda o: rr[o + 1])) END)) FROM k, w WHERE n < 6 AND NOT list_contains(chosen, j) GROUP BY n)
SELECT place::INTEGER AS place, 'f' || j AS feature FROM (SELECT unnest(chosen) AS j, generate_subscripts(chosen, 1) - 1 AS place FROM k WHERE n = 6)"""
