"""Queries over events as recordings: user_id is the subject, value the metric; and the SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, half_away, seconds
from ..operators import calendar, sequence, stats

GAP = 3600
S = ["user_id"]


def events(spark, sf_dir: str) -> DataFrame:
    """Subject, time in seconds, day, hour and the finite metric of every event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", "user_id", "ts", "event_type", seconds(F.col("ts")).alias("sec"), F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), finite(F.col("value")).alias("value"))


E_SQL = "e AS (SELECT event_id, user_id, ts, event_type, floor(epoch(ts))::BIGINT AS sec, ts::DATE AS day, hour(ts) AS hour, value::DOUBLE AS value FROM events)"


def rounded(df: DataFrame, digits: int = 6, whole: tuple[str, ...] = ()) -> DataFrame:
    """Doubles at a fixed precision, rounded as SQL does, negative zero as zero; those of `whole` as they are."""
    return df.select(*((half_away(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" and c not in whole else F.col(c) for c, t in df.dtypes))


def bouts(spark, sf_dir: str) -> DataFrame:
    """One row for each bout: events of a subject no further apart than GAP seconds."""
    linked = sequence.sessions(events(spark, sf_dir), S, "sec", GAP)
    return linked.groupBy("user_id", "bout_id").agg(
        F.min("sec").alias("start_sec"), (F.max("sec") + 1).alias("end_sec"), (F.max("sec") - F.min("sec") + 1).alias("duration_sec"), F.count(F.lit(1)).alias("n_windows"),
        F.percentile("value", F.lit(0.5)).alias("speed"), F.avg("value").alias("pa_amplitude"), F.stddev_pop("value").alias("pa_variability"), F.min("day").alias("day"), F.min_by("hour", "sec").alias("hour"),
    )


BOUTS_SQL = f"""{E_SQL},
 g AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec) > {GAP} THEN 1 ELSE 0 END AS new FROM e),
 n AS (SELECT *, (sum(new) OVER (PARTITION BY user_id ORDER BY sec ROWS UNBOUNDED PRECEDING) + 1)::INTEGER AS bout_id FROM g),
 b AS (SELECT user_id, bout_id, min(sec) AS start_sec, max(sec) + 1 AS end_sec, max(sec) - min(sec) + 1 AS duration_sec, count(*) AS n_windows,
   quantile_cont(value, 0.5) AS speed, avg(value) AS pa_amplitude, stddev_pop(value) AS pa_variability, min(day) AS day, arg_min(hour, sec) AS hour FROM n GROUP BY user_id, bout_id)"""


def stats_sql(rows: str, key: str, value: str, prefix: str, log_shape: bool = False) -> str:
    """SELECT of the descriptive statistics, with moments written out around the group's mean."""
    shape = f"ln(1 + {value})" if log_shape else value
    moment = lambda k: f"avg(power(z - mz, {k}))"
    sd = f"sqrt({moment(2)})"
    many = f"count(x) > 3 AND {sd} > 0"
    return f"""SELECT {key}, count(x) AS {prefix}_n, round(quantile_cont(x, 0.5), 6) AS {prefix}_median, round(avg(x), 6) AS {prefix}_mean, round(stddev_pop(x), 6) AS {prefix}_std,
 round(quantile_cont(x, 0.1), 6) AS {prefix}_p10, round(quantile_cont(x, 0.9), 6) AS {prefix}_p90, round((max(x) - min(x))::DOUBLE, 6) AS {prefix}_range,
 round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS {prefix}_iqr, round(CASE WHEN {many} THEN {moment(3)} / power({sd}, 3) END, 6) AS {prefix}_skewness,
 round(CASE WHEN {many} THEN {moment(4)} / power({sd}, 4) - 3 END, 6) AS {prefix}_kurtosis, round({sd} / nullif(any_value(mz), 0), 6) AS {prefix}_cv
 FROM (SELECT *, avg(z) OVER (PARTITION BY {key}) AS mz FROM (SELECT *, {value}::DOUBLE AS x, {shape} AS z FROM {rows})) GROUP BY {key}"""


def bout_assembly(spark, sf_dir):
    return rounded(bouts(spark, sf_dir))


def descriptive_stats(spark, sf_dir):
    return rounded(stats.describe(events(spark, sf_dir), ["event_type"], "value", "v"))


def shape_stats_log1p(spark, sf_dir):
    return rounded(stats.describe(events(spark, sf_dir), S, "value", "v", True))


def mad_stats(spark, sf_dir):
    return rounded(stats.mad(events(spark, sf_dir), S, "value"))


def l_moments(spark, sf_dir):
    return rounded(stats.l_moments(events(spark, sf_dir), S, "value"))


def histogram_fixed_bins(spark, sf_dir):
    return rounded(stats.histogram(events(spark, sf_dir), ["event_type"], "value", 0.0, 200.0))


def shannon_entropy(spark, sf_dir):
    return rounded(stats.shannon_entropy(events(spark, sf_dir), S, "value", 0.0, 200.0))


def within_group_variability(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_quantity")
    return rounded(stats.within_variability(li, ["l_suppkey"], "l_orderkey", "l_quantity", 2))


def wasserstein_day_pairs(spark, sf_dir):
    return rounded(stats.wasserstein_pairs(events(spark, sf_dir), S, "day", "value", 4))


def day_stability(spark, sf_dir):
    return rounded(stats.stability(stats.wasserstein_pairs(events(spark, sf_dir), S, "day", "value", 4), S))


def describe_percentiles(spark, sf_dir):
    return rounded(stats.describe_percentiles(events(spark, sf_dir), ["event_type"], "value"))


def daily_totals(spark, sf_dir):
    b = bouts(spark, sf_dir).withColumn("duration_sec", F.col("duration_sec").cast("double"))
    return rounded(stats.describe(calendar.daily_totals(b, S, "day", "duration_sec", 60.0), S, "total", "min"))


def daily_volume(spark, sf_dir):
    return calendar.daily_volume(bouts(spark, sf_dir), S, "day", "duration_sec")


def time_of_day(spark, sf_dir):
    return rounded(calendar.time_of_day(bouts(spark, sf_dir), S, "hour"))


def positions(spark, sf_dir, parts: int | None = None) -> DataFrame:
    """Events of a subject in order, numbered from 0; subjects are dealt to as many parts as given."""
    e = events(spark, sf_dir)
    return (e.repartition(parts, *S) if parts else e).withColumn("i", (F.row_number().over(Window.partitionBy("user_id").orderBy("sec", "event_id")) - 1).cast("int"))


POS_SQL = f"{E_SQL}, q AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) - 1)::INTEGER AS i FROM e)"


def full_day_stats(spark, sf_dir):
    return rounded(calendar.full_day_stats(positions(spark, sf_dir), S, "i", "value", 20))


def epoch_totals(spark, sf_dir):
    return rounded(calendar.epoch_totals(positions(spark, sf_dir), S, "i", "value", 5, 4))


def epoch_median(spark, sf_dir):
    return rounded(calendar.epoch_median(positions(spark, sf_dir), S, "i", "value", 5))


def overlapping_windows(spark, sf_dir):
    return rounded(sequence.full_windows(positions(spark, sf_dir), S, "i", ["value", "hour"], 10, 2), 9)


def otsu_threshold(spark, sf_dir):
    return rounded(sequence.otsu(events(spark, sf_dir), ["event_type"], "value"))


def otsu_linear(spark, sf_dir):
    return rounded(sequence.otsu(events(spark, sf_dir), S, "value", 64, False), 9)


def active_windows(spark, sf_dir):
    """Windows of a variance above the subject's threshold."""
    w = sequence.full_windows(positions(spark, sf_dir), S, "i", ["value"], 10, 2)
    t = sequence.otsu(w, S, "variance")
    return rounded(w.join(t, S).select("user_id", "w_idx", "variance", (F.col("variance") > F.col("threshold")).cast("int").alias("walk")))


def window_seconds(spark, sf_dir):
    w = sequence.full_windows(positions(spark, sf_dir), S, "i", ["value"], 10, 1).select("user_id", "w_idx", (F.col("variance") > 2000).cast("int").alias("walk"))
    return sequence.window_to_second(w, S)


def merged_bouts(spark, sf_dir):
    q = positions(spark, sf_dir).select(F.col("user_id").alias("subject_id"), F.col("i").alias("sec"), (F.col("value") > 30).cast("int").alias("walk"))
    return sequence.merge_bouts(q)


def gap_runs(spark, sf_dir):
    return sequence.runs(positions(spark, sf_dir).withColumn("low", F.col("value") < 40), S, "i", "low")


def longest_run(spark, sf_dir):
    return sequence.longest_run(positions(spark, sf_dir).withColumn("low", F.col("value") < 60), S, "i", "low")


def edge_days_dropped(spark, sf_dir):
    return rounded(sequence.drop_edge_days(events(spark, sf_dir), S, "day").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


def wear_validation(spark, sf_dir):
    return rounded(sequence.wear_validation(events(spark, sf_dir), S, "value", "hour", 1, 60.0))


def cascading_impute(spark, sf_dir):
    """Gaps of two rows and more stay null."""
    e = positions(spark, sf_dir).withColumn("gappy", F.when(F.col("event_id") % 3 != 0, F.col("value"))).withColumns({"wd": F.weekday("ts"), "we": F.weekday("ts") >= 5})
    return rounded(sequence.cascading_impute(e, S, "gappy", [["wd", "hour"], ["we", "hour"], ["hour"]], "i", 1).select("event_id", "gappy", "filled"))


def rolling_median(spark, sf_dir):
    return rounded(sequence.rolling_median(positions(spark, sf_dir), S, "i", "value", 6).select("user_id", "i", "rolling"))


def angle_change(spark, sf_dir):
    return rounded(sequence.angle_change(positions(spark, sf_dir), S, "i", "value").select("user_id", "i", "change"))


def sustained_inactivity(spark, sf_dir):
    return sequence.sustained(positions(spark, sf_dir), S, "i", "value", 60.0, 3)


def nonwear_vote(spark, sf_dir):
    q = positions(spark, sf_dir).select("user_id", "i", "value", F.col("hour").cast("double").alias("h"), (F.col("value") / 2).alias("v2"))
    return sequence.nonwear_vote(q, S, "i", ["value", "h", "v2"], 8, 2, 40.0, 120.0).select("user_id", "i", "nonwear")


def night_blocks(spark, sf_dir):
    calm = sequence.sustained(positions(spark, sf_dir), S, "i", "value", 60.0, 2)
    return sequence.night_blocks(calm, S, "start", "end", 1, 5, 20)


def nightly_metrics(spark, sf_dir):
    q = positions(spark, sf_dir)
    calm = sequence.sustained(q, S, "i", "value", 60.0, 2)
    nights = sequence.night_blocks(calm, S, "start", "end", 2, 5, 20).select("user_id", "night", "start", "end")
    return rounded(calendar.nightly_metrics(q.select("user_id", "i", (F.col("value") < 60).cast("int").alias("sib")), nights, S, 0.25, 10.75))


def moving_average(spark, sf_dir):
    return rounded(sequence.moving_average(positions(spark, sf_dir), S, "i", "value", 5).select("user_id", "i", "smooth"))


def _hours(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).withColumn("h", F.floor(F.col("sec") / 3600))
    return calendar.to_grid(e, S, "h", "value", ties="event_id")


HOURS_SQL = f"""{E_SQL}, hh AS (SELECT user_id, sec // 3600 AS h, avg(value) AS value FROM e GROUP BY ALL),
 gr AS (SELECT user_id, unnest(range(min(h), max(h) + 1)) AS h FROM hh GROUP BY user_id), gh AS (SELECT gr.user_id, gr.h, hh.value FROM gr LEFT JOIN hh USING (user_id, h))"""


def hourly_grid(spark, sf_dir):
    return rounded(_hours(spark, sf_dir))


def rhythm_is_iv(spark, sf_dir):
    return rounded(calendar.is_iv(_hours(spark, sf_dir), S, "h", "value", 24))


def rhythm_l5_m10(spark, sf_dir):
    return rounded(calendar.l5_m10(_hours(spark, sf_dir), S, "h", "value", 24, 5, 10, equal=0.0))


def regularity_index(spark, sf_dir):
    return rounded(calendar.regularity_index(_hours(spark, sf_dir).withColumn("value", F.when(F.col("value").isNotNull(), (F.col("value") > 50).cast("int"))), S, "h", "value", 24))


def nearest_reindex(spark, sf_dir):
    return rounded(calendar.nearest_on_grid(events(spark, sf_dir), S, "sec", "value", 1800, 600, "event_id"))


R = "round({}, 6)"
_ENT = " + ".join(f"p{k} * ln(p{k})" for k in range(10))
_BIN = "CASE WHEN value BETWEEN 0 AND 200 THEN least(floor(value * 10 / 200)::INTEGER, 9) END"
_FREQ = ", ".join(f"count(*) FILTER (WHERE b = {k}) AS freq_bin{k}" for k in range(10))
_TOTAL = " + ".join(f"freq_bin{k}" for k in range(10))
_PROB = ", ".join(f"round(coalesce(freq_bin{k} / nullif({_TOTAL}, 0), 0.0), 6) AS prob_bin{k}" for k in range(10))
_RUN = "sum(new) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING)"


def runs_sql(state: str) -> str:
    return f"""{POS_SQL}, st AS (SELECT *, {state} AS st FROM q), nw AS (SELECT *, CASE WHEN st IS NOT DISTINCT FROM lag(st) OVER (PARTITION BY user_id ORDER BY i) AND i > 0 THEN 0 ELSE 1 END AS new FROM st),
 rn AS (SELECT *, {_RUN} AS run FROM nw), ru AS (SELECT user_id, st, run, min(i) AS start, max(i) AS "end", count(*) AS length FROM rn GROUP BY user_id, st, run)"""


def blocks_sql(gap: int) -> str:
    return f"""{runs_sql("value < 60")}, sb AS (SELECT user_id, start, "end", floor(((start + "end" + 1) // 2 - 5) / 20)::INTEGER AS night FROM ru WHERE st AND length >= 2),
 lk AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY user_id, night ORDER BY start) - 1 > {gap} THEN 1 ELSE 0 END AS new2 FROM sb),
 bl AS (SELECT *, sum(new2) OVER (PARTITION BY user_id, night ORDER BY start ROWS UNBOUNDED PRECEDING) AS blk FROM lk),
 mg AS (SELECT user_id, night, blk, min(start) AS start, max("end") AS "end" FROM bl GROUP BY ALL), nt AS (SELECT *, "end" - start + 1 AS length FROM mg),
 nb AS (SELECT * FROM nt QUALIFY row_number() OVER (PARTITION BY user_id, night ORDER BY length DESC, start) = 1)"""


def otsu_sql(rows: str, key: str, x: str, back: str, bins: int) -> str:
    return f"""xs AS (SELECT {key}, {x} AS x FROM {rows}), en AS (SELECT {key}, min(x) AS lo, max(x) AS hi, count(*) AS total FROM xs GROUP BY {key}),
 bn AS (SELECT {key}, lo, hi, total, least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1})::INTEGER AS b, count(*) AS c FROM xs JOIN en USING ({key}) WHERE hi > lo GROUP BY ALL),
 cu AS (SELECT *, lo + (b + 0.5) * ((hi - lo) / {bins}) AS centre FROM bn),
 ww AS (SELECT *, sum(c) OVER u AS w0, sum(c * centre) OVER u AS s0, sum(c * centre) OVER (PARTITION BY {key}) AS s FROM cu WINDOW u AS (PARTITION BY {key} ORDER BY b ROWS UNBOUNDED PRECEDING)),
 vb AS (SELECT *, w0 * (total - w0) * power(s0 / w0 - (s - s0) / nullif(total - w0, 0), 2) AS v FROM ww),
 ct AS (SELECT {key}, centre AS cut FROM vb QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY v DESC NULLS LAST, b) = 1),
 th AS (SELECT en.{key}, {back.format("coalesce(cut, lo)")} AS threshold FROM en LEFT JOIN ct USING ({key}))"""


def windows_sql(size: int, step: int, variance: str) -> str:
    return f"""{POS_SQL}, sp AS (SELECT *, unnest(range(greatest(0, ceil((i - {size - 1}) / {step}.0))::BIGINT, i // {step} + 1)) AS w_idx FROM q),
 w AS (SELECT user_id, w_idx::INTEGER AS w_idx, {variance} AS variance FROM sp GROUP BY user_id, w_idx HAVING count(*) = {size})"""


QUERIES = {f.__name__: f for f in (
    bout_assembly, descriptive_stats, shape_stats_log1p, mad_stats, l_moments, histogram_fixed_bins, shannon_entropy, within_group_variability, wasserstein_day_pairs, day_stability,
    describe_percentiles, daily_totals, daily_volume, time_of_day, full_day_stats, epoch_totals, epoch_median, overlapping_windows, otsu_threshold, otsu_linear, active_windows, window_seconds, merged_bouts,
    gap_runs, longest_run, edge_days_dropped, wear_validation, cascading_impute, rolling_median, angle_change, sustained_inactivity, nonwear_vote, night_blocks, nightly_metrics, moving_average,
    hourly_grid, rhythm_is_iv, rhythm_l5_m10, regularity_index, nearest_reindex)}

_W1 = f"""{E_SQL}, fu AS (SELECT user_id, day, value AS x, count(*) OVER (PARTITION BY user_id, day) AS n FROM e QUALIFY n >= 4),
 dd AS (SELECT DISTINCT user_id, day, n FROM fu), pr AS (SELECT a.user_id, a.day AS a, b.day AS b, a.n AS na, b.n AS nb FROM dd a JOIN dd b ON a.user_id = b.user_id AND a.day < b.day),
 bo AS (SELECT pr.user_id, a, b, x, 1.0::DOUBLE / na AS d FROM pr JOIN fu ON fu.user_id = pr.user_id AND fu.day = a UNION ALL SELECT pr.user_id, a, b, x, -1.0::DOUBLE / nb FROM pr JOIN fu ON fu.user_id = pr.user_id AND fu.day = b),
 wk AS (SELECT user_id, a, b, lead(x) OVER p - x AS gap, abs(sum(d) OVER (p ROWS UNBOUNDED PRECEDING)) AS off FROM bo WINDOW p AS (PARTITION BY user_id, a, b ORDER BY x)),
 w1 AS (SELECT user_id, a, b, sum(gap * off) AS w1 FROM wk GROUP BY user_id, a, b)"""

ORACLE_SQL = {
    "bout_assembly": f"WITH {BOUTS_SQL} SELECT user_id, bout_id, start_sec, end_sec, duration_sec, n_windows, round(speed, 6) AS speed, round(pa_amplitude, 6) AS pa_amplitude, round(pa_variability, 6) AS pa_variability, day, hour FROM b",
    "descriptive_stats": f"WITH {E_SQL} {stats_sql('e', 'event_type', 'value', 'v')}",
    "shape_stats_log1p": f"WITH {E_SQL} {stats_sql('e', 'user_id', 'value', 'v', True)}",
    "mad_stats": f"WITH {E_SQL}, c AS (SELECT user_id, quantile_cont(value, 0.5) AS c FROM e GROUP BY user_id) SELECT user_id, count(value) AS n, CASE WHEN count(value) >= 30 THEN round(quantile_cont(abs(value - c), 0.5), 6) END AS mad FROM e JOIN c USING (user_id) GROUP BY user_id",
    "l_moments": f"""WITH {E_SQL}, r AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY value)::DOUBLE AS i, count(*) OVER (PARTITION BY user_id)::DOUBLE AS n FROM e WHERE value IS NOT NULL),
 b AS (SELECT user_id, avg(x) AS b0, avg(x * (i - 1) / (n - 1)) AS b1, avg(x * (i - 1) * (i - 2) / ((n - 1) * (n - 2))) AS b2, avg(x * (i - 1) * (i - 2) * (i - 3) / ((n - 1) * (n - 2) * (n - 3))) AS b3 FROM r WHERE n >= 30 GROUP BY user_id)
 SELECT user_id, round((6 * b2 - 6 * b1 + b0) / (2 * b1 - b0), 6) AS l_skewness, round((20 * b3 - 30 * b2 + 12 * b1 - b0) / (2 * b1 - b0), 6) AS l_kurtosis FROM b""",
    "histogram_fixed_bins": f"WITH {E_SQL}, bb AS (SELECT event_type, {_BIN} AS b FROM e), h AS (SELECT event_type, {_FREQ} FROM bb GROUP BY event_type) SELECT event_type, {', '.join(f'freq_bin{k}' for k in range(10))}, {_PROB} FROM h",
    "shannon_entropy": f"WITH {E_SQL}, bb AS (SELECT user_id, {_BIN} AS b FROM e), h AS (SELECT user_id, {_FREQ} FROM bb GROUP BY user_id), t AS (SELECT *, {_TOTAL} AS t FROM h), p AS (SELECT user_id, {', '.join(f'(freq_bin{k} / t + 1e-10) / (1 + 1e-9) AS p{k}' for k in range(10))} FROM t WHERE t >= 30) SELECT user_id, round(-({_ENT}), 6) AS entropy FROM p",
    "within_group_variability": "WITH s AS (SELECT l_suppkey, l_orderkey, stddev_pop(l_quantity) AS sd FROM lineitem GROUP BY ALL HAVING count(l_quantity) >= 2) SELECT l_suppkey, count(*) AS n_groups, round(quantile_cont(sd, 0.5), 6) AS var_median, round(stddev_pop(sd), 6) AS var_std FROM s GROUP BY l_suppkey",
    "wasserstein_day_pairs": f"WITH {_W1} SELECT user_id, a, b, round(w1, 6) AS w1 FROM w1",
    "day_stability": f"WITH {_W1} SELECT user_id, round(avg(w1), 6) AS mean_w1, round(stddev_pop(w1), 6) AS std_w1, count(*) AS n_pairs FROM w1 GROUP BY user_id",
    "describe_percentiles": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{round(q * 100)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + ", max(value) AS max FROM events GROUP BY event_type",
    "daily_totals": f"WITH {BOUTS_SQL}, t AS (SELECT user_id, day, sum(duration_sec) / 60.0::DOUBLE AS total FROM b GROUP BY user_id, day) {stats_sql('t', 'user_id', 'total', 'min')}",
    "daily_volume": f"WITH {BOUTS_SQL} SELECT user_id, day, count(*) AS n_bouts, count(*) FILTER (WHERE duration_sec > 30) AS n_gt30, count(*) FILTER (WHERE duration_sec > 60) AS n_gt60 FROM b GROUP BY user_id, day",
    "time_of_day": f"WITH {BOUTS_SQL}, t AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE hour BETWEEN 6 AND 11) AS morning_n, count(*) FILTER (WHERE hour BETWEEN 12 AND 16) AS afternoon_n, count(*) FILTER (WHERE hour BETWEEN 17 AND 23) AS evening_n, count(*) FILTER (WHERE hour BETWEEN 0 AND 5) AS night_n FROM b GROUP BY user_id) SELECT *, " + ", ".join(f"round({p}_n / n, 6) AS {p}_share" for p in ("morning", "afternoon", "evening", "night")) + " FROM t",
    "full_day_stats": f"WITH {POS_SQL} SELECT user_id, i // 20 AS day, round(avg(value), 6) AS pa_mean, round(stddev_pop(value), 6) AS pa_std FROM q GROUP BY user_id, i // 20 HAVING count(*) = 20",
    "epoch_totals": f"WITH {POS_SQL}, ep AS (SELECT user_id, i // 5 AS epoch, sum(value) AS s FROM q GROUP BY ALL HAVING count(*) = 5) SELECT user_id, epoch // 4 AS day, round(sum(s), 6) AS tdpa FROM ep GROUP BY ALL HAVING count(*) = 4",
    "epoch_median": f"WITH {POS_SQL} SELECT user_id, i // 5 AS epoch, round(quantile_cont(value, 0.5), 6) AS median FROM q GROUP BY ALL HAVING count(*) = 5",
    "overlapping_windows": f"WITH {windows_sql(10, 2, '(var_pop(value) + var_pop(hour)) / 2')} SELECT user_id, w_idx, round(variance, 9) AS variance FROM w",
    "otsu_threshold": f"WITH {E_SQL}, {otsu_sql('e', 'event_type', 'ln(value + 1e-6)', 'exp({}) - 1e-6', 256)} SELECT event_type, round(threshold, 6) AS threshold FROM th",
    "otsu_linear": f"WITH {E_SQL}, {otsu_sql('e', 'user_id', 'value', '{}', 64)} SELECT user_id, round(threshold, 9) AS threshold FROM th",
    "active_windows": f"WITH {windows_sql(10, 2, 'var_pop(value)')}, {otsu_sql('w', 'user_id', 'ln(variance + 1e-6)', 'exp({}) - 1e-6', 256)} SELECT user_id, w_idx, round(variance, 6) AS variance, (variance > threshold)::INTEGER AS walk FROM w JOIN th USING (user_id)",
    "window_seconds": f"WITH {windows_sql(10, 1, 'var_pop(value)')}, gd AS (SELECT user_id, unnest(range(max(w_idx) + 10)) AS sec FROM w GROUP BY user_id) SELECT gd.user_id, gd.sec::INTEGER AS sec, coalesce((variance > 2000)::INTEGER, 0) AS walk FROM gd LEFT JOIN w ON w.user_id = gd.user_id AND w.w_idx + 5 = gd.sec",
    "merged_bouts": f"""WITH {POS_SQL}, wk AS (SELECT user_id, i FROM q WHERE value > 30), nw AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY user_id ORDER BY i) - 1 > 3 THEN 1 ELSE 0 END AS new FROM wk),
 rn AS (SELECT *, {_RUN} AS run FROM nw), bt AS (SELECT user_id, min(i) AS s, max(i) + 1 AS t FROM rn GROUP BY user_id, run HAVING max(i) + 1 - min(i) >= 10)
 SELECT user_id AS subject_id, row_number() OVER (PARTITION BY user_id ORDER BY s)::INTEGER AS bout_id, s AS start_sec, t AS end_sec, t - s AS duration_sec, (s * 30)::BIGINT AS start_sample, (t * 30)::BIGINT AS end_sample FROM bt""",
    "gap_runs": f"WITH {runs_sql('value < 40')} SELECT user_id, st AS low, start, \"end\", length FROM ru",
    "longest_run": f"WITH {runs_sql('value < 60')} SELECT user_id, start, \"end\", length FROM ru WHERE st QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) = 1",
    "edge_days_dropped": f"WITH {E_SQL}, m AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM e GROUP BY user_id) SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM e JOIN m USING (user_id) WHERE day > lo AND day < hi GROUP BY user_id",
    "wear_validation": f"WITH {E_SQL} SELECT user_id, count(value)::DOUBLE AS wear_hours, (24 - count(DISTINCT hour) FILTER (WHERE value IS NOT NULL))::INTEGER AS missing_hours, count(value) >= 60 AND count(DISTINCT hour) FILTER (WHERE value IS NOT NULL) = 24 AS valid FROM e GROUP BY user_id",
    "cascading_impute": f"""WITH {POS_SQL}, g0 AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS gappy, isodow(ts) AS wd, isodow(ts) >= 6 AS we FROM q),
 g1 AS (SELECT *, coalesce(gappy, avg(gappy) OVER (PARTITION BY user_id, wd, hour)) AS f1 FROM g0), g2 AS (SELECT *, coalesce(f1, avg(f1) OVER (PARTITION BY user_id, we, hour)) AS f2 FROM g1), g3 AS (SELECT *, coalesce(f2, avg(f2) OVER (PARTITION BY user_id, hour)) AS f3 FROM g2),
 g4 AS (SELECT *, lag(gappy) OVER o AS p, lead(gappy) OVER o AS n, i > 0 AS hp, i < max(i) OVER (PARTITION BY user_id) AS hn FROM g3 WINDOW o AS (PARTITION BY user_id ORDER BY i))
 SELECT event_id, round(gappy, 6) AS gappy, CASE WHEN gappy IS NOT NULL OR (hp AND p IS NULL OR hn AND n IS NULL) IS NOT TRUE THEN round(f3, 6) END AS filled FROM g4""",
    "rolling_median": f"WITH {POS_SQL} SELECT user_id, i, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 6) AS rolling FROM q",
    "angle_change": f"WITH {POS_SQL} SELECT user_id, i, round(coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY i)), 0.0), 6) AS change FROM q",
    "sustained_inactivity": f"WITH {runs_sql('value < 60')} SELECT user_id, start, \"end\", length FROM ru WHERE st AND length >= 3",
    "nonwear_vote": f"""WITH {POS_SQL}, ln AS (SELECT user_id, max(i) + 1 AS n FROM q GROUP BY user_id), ws AS (SELECT user_id, unnest(range(0, n - 7, 2)) AS s FROM ln WHERE n >= 8 UNION SELECT user_id, n - 8 FROM ln WHERE n >= 8),
 vt AS (SELECT ws.user_id, s, (stddev_pop(value) < 40 AND max(value) - min(value) < 120)::INTEGER + (stddev_pop(hour) < 40 AND max(hour) - min(hour) < 120)::INTEGER + (stddev_pop(value / 2) < 40 AND max(value / 2) - min(value / 2) < 120)::INTEGER AS still
   FROM ws JOIN q ON q.user_id = ws.user_id AND i >= s AND i < s + 8 GROUP BY ws.user_id, s),
 fl AS (SELECT DISTINCT vt.user_id, i FROM vt JOIN q ON q.user_id = vt.user_id AND i >= s AND i < s + 8 WHERE still >= 2) SELECT q.user_id, q.i, fl.i IS NOT NULL AS nonwear FROM q LEFT JOIN fl ON fl.user_id = q.user_id AND fl.i = q.i""",
    "night_blocks": f"WITH {blocks_sql(1)} SELECT user_id, night, start, \"end\", length FROM nb",
    "nightly_metrics": f"""WITH {blocks_sql(2)}, ls AS (SELECT user_id, max(i) AS last FROM q GROUP BY user_id),
 mt AS (SELECT q.user_id, night, start, least("end" + 1, last) AS wake, (value < 60)::INTEGER AS sib, lag((value < 60)::INTEGER) OVER (PARTITION BY q.user_id, night ORDER BY i) AS prev
   FROM q JOIN nb ON nb.user_id = q.user_id AND i BETWEEN start AND "end" JOIN ls ON ls.user_id = q.user_id),
 tt AS (SELECT user_id, night, start, wake, count(*) * 0.25::DOUBLE AS spt, sum(sib) * 0.25::DOUBLE AS tst, count(*) FILTER (WHERE prev = 1 AND sib = 0) AS awakenings FROM mt GROUP BY ALL),
 hh AS (SELECT *, (start * 0.25::DOUBLE + 10.75) % 24 AS h0, (wake * 0.25::DOUBLE + 10.75) % 24 AS h1, ((start + wake) / 2.0 * 0.25::DOUBLE + 10.75) % 24 AS h2 FROM tt)
 SELECT user_id, night, h0 - 24 * (h0 >= 12)::INTEGER AS sleep_onset_hour, h1 - 24 * (h1 >= 12)::INTEGER AS wake_time_hour, h2 - 24 * (h2 >= 12)::INTEGER AS midsleep_hour,
   spt AS spt_hours, tst AS tst_hours, awakenings, spt - tst AS waso_hours, round(tst / spt, 6) AS sleep_efficiency, round(awakenings / nullif(tst, 0), 6) AS frag_index FROM hh""",
    "moving_average": f"WITH {POS_SQL} SELECT user_id, i, round(CASE WHEN count(value) OVER f = 5 THEN avg(value) OVER f ELSE value END, 6) AS smooth FROM q WINDOW f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "hourly_grid": f"WITH {HOURS_SQL} SELECT user_id, h, round(value, 6) AS value FROM gh",
    "rhythm_is_iv": f"""WITH {HOURS_SQL}, k AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY h) AS d FROM gh WHERE value IS NOT NULL), w AS (SELECT user_id, count(*) AS n, var_pop(value) AS v, avg(d * d) AS dd FROM k GROUP BY user_id),
 p AS (SELECT user_id, h % 24 AS slot, avg(value) AS p FROM k GROUP BY ALL), m AS (SELECT user_id, avg(p) AS pm FROM p GROUP BY user_id), s AS (SELECT user_id, sum(power(p - pm, 2)) / count(*) AS vp FROM p JOIN m USING (user_id) GROUP BY user_id)
 SELECT user_id, n, CASE WHEN n >= 48 AND v > 0 THEN round(n * vp / (24 * v), 6) END AS rar_is, CASE WHEN n >= 48 AND v > 0 THEN round(dd / v, 6) END AS rar_iv FROM w JOIN s USING (user_id)""",
    "rhythm_l5_m10": f"""WITH {HOURS_SQL}, p AS (SELECT user_id, (h % 24)::INTEGER AS slot, avg(value) AS p FROM gh WHERE value IS NOT NULL GROUP BY ALL), m AS (SELECT user_id, avg(p) AS pm FROM p GROUP BY user_id), kn AS (SELECT user_id, count(value) >= 48 AS ok FROM gh GROUP BY user_id),
 sl AS (SELECT m.user_id, r.slot, coalesce(p, pm) AS p FROM m CROSS JOIN (SELECT unnest(range(24))::INTEGER AS slot) r LEFT JOIN p ON p.user_id = m.user_id AND p.slot = r.slot),
 tw AS (SELECT user_id, slot, p FROM sl UNION ALL SELECT user_id, slot + 24, p FROM sl),
 ro AS (SELECT user_id, slot, avg(p) OVER (PARTITION BY user_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS lo, avg(p) OVER (PARTITION BY user_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS hi FROM tw),
 mn AS (SELECT user_id, min(lo) AS l5, max(hi) AS m10 FROM ro WHERE slot < 24 GROUP BY user_id), os AS (SELECT user_id, slot AS l5_onset FROM ro WHERE slot < 24 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY lo, slot) = 1)
 SELECT user_id, CASE WHEN ok THEN round(l5, 6) END AS l5, CASE WHEN ok THEN l5_onset::DOUBLE END AS l5_onset_hour, CASE WHEN ok THEN round(m10, 6) END AS m10, CASE WHEN ok AND m10 + l5 > 0 THEN round((m10 - l5) / (m10 + l5), 6) END AS ra FROM mn JOIN os USING (user_id) JOIN kn USING (user_id)""",
    "regularity_index": f"""WITH {HOURS_SQL}, k AS (SELECT user_id, h, (value > 50)::INTEGER AS s FROM gh WHERE value IS NOT NULL), n AS (SELECT user_id, count(*) AS n FROM gh GROUP BY user_id),
 c AS (SELECT a.user_id, avg((a.s = b.s)::INTEGER) AS same FROM k a JOIN k b ON a.user_id = b.user_id AND b.h = a.h + 24 GROUP BY a.user_id) SELECT user_id, n, CASE WHEN n >= 48 THEN round(200 * same - 100, 6) END AS sri FROM n LEFT JOIN c USING (user_id)""",
    "nearest_reindex": f"""WITH {E_SQL}, g AS (SELECT user_id, unnest(range(floor(min(sec) / 1800)::BIGINT, ceil(max(sec) / 1800)::BIGINT + 1)) * 1800 AS grid FROM e GROUP BY user_id),
 m AS (SELECT g.user_id, g.grid, e.value FROM g JOIN e ON e.user_id = g.user_id AND abs(e.sec - g.grid) <= 600 QUALIFY row_number() OVER (PARTITION BY g.user_id, g.grid ORDER BY abs(e.sec - g.grid), e.sec) = 1)
 SELECT g.user_id, g.grid, round(m.value, 6) AS value FROM g LEFT JOIN m USING (user_id, grid)""",
}
