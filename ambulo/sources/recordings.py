"""Sources and sinks of recordings and feature tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import subject_from_file

#: Schemas of the feature tables; columns that a file lacks are null.
SCHEMAS = {
    "bouts": "bout_id int, start_time timestamp_ntz, duration_sec int, n_windows int, total_steps double, speed double, cadence double, gait_length double, gait_length_indirect double, regularity_eldernet double, regularity_sp double, entropy double, dom_freq double, psd_amp double, psd_width double, psd_slope double, pa_amplitude double, pa_variability double, day int",
    "windows": "bout_id int, window_id int, window_start_time timestamp_ntz, speed double, cadence double, gait_length double, regularity_eldernet double, step_count double",
    "daily_pa": "day int, daily_pa_mean double, daily_pa_std double, tdpa double",
    "daily_sleep": "night int, sleep_onset_hour double, wake_time_hour double, midsleep_hour double, spt_hours double, tst_hours double, waso_hours double, sleep_efficiency double, awakenings int, frag_index double",
    "rar": "rar_is double, rar_iv double, rar_l5 double, rar_m10 double, rar_l5_onset_hour double, rar_ra double, rar_sri double",
}
#: Older names of bout columns.
RENAMED = {"bout_pa_mean": "pa_amplitude", "bout_pa_std": "pa_variability"}


def list_recordings(spark: SparkSession, folder: str, pattern: str = "*.mat", exclude: tuple[str, ...] = (), exclude_folders: tuple[str, ...] = ()) -> DataFrame:
    """Path, size and subject of the recordings below a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    out = files.withColumn("name", name)
    for e in exclude:
        out = out.where(~F.col("name").contains(e))
    for e in exclude_folders:
        out = out.where(~F.array_contains(F.split("path", "/"), e))
    return out.withColumn("subject_id", subject_from_file(F.col("name")))


def read_features(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """All subjects' files of a table, with subject_id from the file and device from the layout.

    Files lie in <folder>/<table>/ or, with several devices, in <folder>/<device>/<table>/ (device null in the first).
    Empty files have no rows, so a subject without bouts is not there. Columns are matched by name; older names count.
    """
    wanted = spark.createDataFrame([], SCHEMAS[table]).schema
    base = spark.read.option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").option("enforceSchema", "false")
    raw = base.csv(folder).select("*", F.col("_metadata.file_path").alias("_path"))
    parts = F.split("_path", "/")
    raw = raw.where(F.element_at(parts, -2) == table).withColumnsRenamed(RENAMED)
    kept = [F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]
    depth = len([p for p in folder.split("://")[-1].split("/") if p])
    device = F.when(F.size(F.filter(parts, lambda p: (p != "") & (~p.rlike("^[a-z]+:$")))) - depth >= 3, F.element_at(parts, -3))
    return raw.select(subject_from_file(F.element_at(parts, -1)).alias("subject_id"), device.alias("device"), *kept)


def read_sheets(spark: SparkSession, path: str, sheets: list[str]) -> dict[str, DataFrame]:
    """Clinical sheets of a workbook, read on the driver (a few thousand rows)."""
    import pandas as pd

    return {s: spark.createDataFrame(pd.read_excel(path, sheet_name=s)) for s in sheets}


def write_features(df: DataFrame, folder: str, table: str) -> str:
    """A table as Parquet by subject."""
    path = f"{folder}/{table}"
    df.write.mode("append").partitionBy("subject_id").parquet(path)
    return path


def write_new(df: DataFrame, path: str) -> str:
    """To the path, or where it is taken to the path with the time added; nothing is overwritten."""
    from pyspark.errors import AnalysisException

    try:
        df.write.mode("errorifexists").parquet(path)
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
        path = f"{path}_{datetime.datetime.now():%Y%m%d_%H%M%S_%f}"
        df.write.mode("errorifexists").parquet(path)
    return path


def write_results(results: DataFrame, folder: str, score: str = "score", fold: tuple[str, ...] = ("repeat", "fold")) -> None:
    """fold_scores (a row for each cell with its scores in order of folds), results (CSV, mean and deviation of each
    cell), and headline (one line of JSON: the best cell of each outcome). Nothing is overwritten.
    """
    cell = [c for c in ("outcome", "features", "strategy", "model") if c in results.columns]
    order = [c for c in fold if c in results.columns]
    arrays = results.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct(*order, score))).alias("_f"))
    arrays.select(*cell, F.transform("_f", lambda f: f[score]).alias("scores")).write.mode("errorifexists").parquet(f"{folder}/fold_scores")
    summary = results.groupBy(*cell).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count(score).alias("n_folds"))
    summary.coalesce(1).write.mode("errorifexists").option("header", "true").csv(f"{folder}/results")  # a row for each cell
    first = cell[:1] if cell[:1] == ["outcome"] else []
    best = summary.groupBy(*first).agg(F.max(F.struct("mean", *cell, "std", "n_folds")).alias("b")).select("b.*")
    best.coalesce(1).write.mode("errorifexists").json(f"{folder}/headline")


def stages(requested: str) -> list[str]:
    """The stages of a run, in order; an unknown one is an error. Tables that none of them needs are never computed."""
    known = ("gait", "pa", "sleep")
    names = [s.strip() for s in requested.split(",") if s.strip()]
    if unknown := set(names) - set(known):
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    return [s for s in known if s in names]
