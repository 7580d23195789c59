"""CSV, JSON and corpus readers with their column contracts, and the result sinks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lessonlens.functions import pose, text
from lessonlens.schemas import POSE_JSON, conform, require_columns

TRIAL_COLUMNS = {"school_id", "class_id", "session_id", "phase", "time_bin", "classroom_score"}
PAIR_COLUMNS = {"school_id", "phase", "human_score", "model_score"}


def check_distinct_stores(paths: Iterable[str]) -> list[str]:
    """The same store listed twice would leak identical windows between training and validation."""
    seen: dict[str, int] = {}
    for position, path in enumerate(p.rstrip("/") for p in paths):
        if path in seen:
            raise ValueError(f"store listed twice, at positions {seen[path] + 1} and {position + 1}: {path}")
        seen[path] = position
    return list(seen)


def plain_path(path: Column) -> Column:
    """A file's address as Spark reports it, decoded; local ones without their scheme, as they are written in settings."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/*(?=/)", "")


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme and authority that its files will show; local ones without."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/*(?=/)", "", whole)


def read_corpus(spark: SparkSession, stores: Mapping[str, str], tables: Sequence[str]) -> dict[str, DataFrame]:
    """The named parquet tables of many lesson stores, each row tagged with its ``dataset_id``.

    ``stores`` maps a dataset id to a folder. All folders go into one scan; the id is looked up from the file's path, and
    a file that belongs to no folder is an error.
    """
    folders = check_distinct_stores(stores.values())
    ids = spark.createDataFrame(
        [(_qualified(spark, f), name) for f, name in zip(folders, stores)], "__folder string, dataset_id string")
    out = {}
    for name in tables:
        scan = spark.read.option("mergeSchema", "true").parquet(*[f"{p}/{name}.parquet" for p in folders])
        folder = F.regexp_extract(plain_path(F.col("_metadata.file_path")), rf"^(.*?)/{name}\.parquet", 1)
        found = scan.withColumn("__folder", folder).join(ids, "__folder", "left")
        unknown = F.raise_error(F.concat(F.lit("file outside the stores, below "), F.col("__folder"))).cast("string")
        out[name] = found.withColumn("dataset_id", F.coalesce("dataset_id", unknown)).drop("__folder")
    return out


def read_csv_contract(spark: SparkSession, path: str, table: str, required: set[str]) -> DataFrame:
    """CSV with a header; required columns must exist, extra ones are dropped, types follow the table's schema."""
    raw = spark.read.option("header", "true").option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    return conform(require_columns(raw, required, table), table)


def require_phases(df: DataFrame, needed: Sequence[str] = ("pre", "post")) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col("phase") == p).alias(p) for p in needed]).first()
    absent = [p for p in needed if not counts[p]]
    if absent:
        raise ValueError(f"rows of these phases are required: {absent}")
    return df


def read_trial(spark: SparkSession, path: str) -> DataFrame:
    return require_phases(read_csv_contract(spark, path, "trial", TRIAL_COLUMNS))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_contract(spark, path, "pairs", PAIR_COLUMNS).where(F.col("phase").isin("pre", "post"))


def chart_rows(df: DataFrame, situation: str, x: str, score: str) -> DataFrame:
    """Rows for the situation chart: named columns, rows without x or score left out."""
    require_columns(df, {situation, x, score}, "chart")
    picked = df.select(
        F.col(situation).alias("situation"), F.col(x).cast("double").alias("x"), F.col(score).cast("double").alias("score"))
    return picked.na.drop(subset=["x", "score"])


def parse_pose_json(df: DataFrame, column: str, out: str = "kpts") -> DataFrame:
    """Pose JSON to padded keypoints; missing, malformed or empty JSON gives all zeros."""
    return df.withColumn(out, pose.pad_points(F.from_json(F.col(column), POSE_JSON)["keypoints"]))


def read_pose_files(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("wholetext", "true").text(path).select(
        plain_path(F.col("_metadata.file_path")).alias("pose_path"), F.col("value"))
    return parse_pose_json(raw, "value").drop("value")


def existing_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the files below a folder, without reading their content."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.select(F.regexp_replace("path", "^file:/*(?=/)", "").alias("path"))


def store_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each store file, to recognise one that was imported before."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        text.base_name(F.col("path")).alias("source_name"), text.content_fingerprint(F.col("content")).alias("source_sha256"))


def append_predictions(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Append scored rows, one folder per video, in files of about ``rows_per_file`` rows.

    The rows of a video are dealt to as many parts as its count asks for, each part to one task: a small video gets one file
    per append, a large one is written by several tasks.
    """
    rows = conform(df, "predictions")
    parts = rows.groupBy(F.col("video_path").alias("__video")).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_file)).alias("__parts"))
    dealt = rows.join(parts, rows.video_path.eqNullSafe(F.col("__video"))).withColumn("__part", F.pmod(F.xxhash64("t", "track_id", "frame_idx"), F.col("__parts")))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number is not joined to fewer
    dealt.repartition(tasks, "video_path", "__part").drop("__video", "__parts", "__part").write.mode("append").option(
        "maxRecordsPerFile", 2 * rows_per_file).partitionBy("video_path").parquet(path)


def write_tables(tables: Mapping[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """One folder per named table; the array and struct columns of a CSV become JSON text."""
    for name, df in tables.items():
        writer_in = df
        if kind == "csv":
            nested = {c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))}
            writer_in = df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])
        writer = writer_in.write.mode("errorifexists")
        (writer.option("header", "true") if kind == "csv" else writer).format(kind).save(f"{path.rstrip('/')}/{name}")


