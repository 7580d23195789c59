"""The reference shapes derived from the generated tables, over all of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lessonlens.functions import pose

LISTEN, WRITE, TALK = "聞く", "書く", "話し合う"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _base(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.concat(F.lit("lesson_"), F.lpad(F.dayofmonth(ts).cast("string"), 2, "0")).alias("video_path"),
        F.col("event_id").alias("frame_idx"),
        (seconds.cast("double") / F.lit(24.0)).alias("t"),
        F.col("user_id").alias("track_id"),
        F.least(F.lit(7.0), F.lit(1.0) + F.sqrt("value") / F.lit(3.7)).alias("score"),
        F.when(kind == "click", WRITE).when(kind == "purchase", TALK).otherwise(LISTEN).alias("situation"),
        "value", "event_type")


def pred(spark: SparkSession, d: str) -> DataFrame:
    """Prediction log: one lesson per day, the day squeezed to an hour."""
    return _base(spark, d).drop("value", "event_type")


def predlog(spark: SparkSession, d: str) -> DataFrame:
    """The offline log layout with a clamped score, a confidence and an override column."""
    score = F.col("score")
    ab = (F.col("t") >= 1800.0) & (F.col("t") < 2100.0)
    return _base(spark, d).select(
        "video_path", "frame_idx", "t", "track_id", score.alias("score"),
        F.least(F.lit(7), F.greatest(F.lit(1), F.rint(score).cast("int"))).alias("score_clamped"),
        "situation",
        (F.lit(0.5) + F.sqrt(F.pmod(F.col("frame_idx"), F.lit(50)).cast("double")) / F.lit(15.0)).alias("situation_confidence"),
        F.when(ab, "AB").alias("situation_override"))


def detections(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return _base(spark, d).select(
        F.col("frame_idx").alias("id"), F.col("video_path"), "frame_idx", "t", "track_id",
        v.alias("x1"), v.alias("y1"), (v + 50.0).alias("x2"), (v + 100.0).alias("y2"), (v / 500.0).alias("conf"))


def _rating(quantity: Column) -> Column:
    return F.lit(1) + (quantity.cast("int") - 1) % 7


def rate(spark: SparkSession, d: str) -> DataFrame:
    """Ratings before deduplication."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("segment_id"),
        F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("rater"),
        _rating(F.col("l_quantity")).alias("score"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("updated_at"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """One rating per segment and rater: the latest one, the higher score on equal times."""
    latest = F.max(F.struct("updated_at", "score")).alias("v")
    return rate(spark, d).groupBy("segment_id", "rater").agg(latest).select(
        "segment_id", "rater", "v.score", "v.updated_at")


def win(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("o_orderkey") % 500
    kind = F.floor(w / F.lit(20.0)).cast("int") % 3
    return table(spark, d, "orders").select(
        w.alias("window_id"), (w * 5).cast("double").alias("t_start"), (w * 5 + 5).cast("double").alias("t_end"),
        F.when(kind == 0, LISTEN).when(kind == 1, WRITE).otherwise(TALK).alias("situation")).distinct()


def locked_win(spark: SparkSession, d: str) -> DataFrame:
    """Windows with a setter and a lock flag; every seventh is open, every thirteenth unset."""
    w = F.col("window_id")
    return win(spark, d).select(
        w, F.lit(1).cast("bigint").alias("video_id"), "t_start", "t_end",
        F.when(w % 13 != 0, F.col("situation")).alias("situation"),
        F.when(w % 13 != 0, F.concat(F.lit("teacher"), (w % 2).cast("string"))).alias("situation_set_by"),
        (w % 7 != 0).alias("situation_locked"))


def stores(df: DataFrame) -> DataFrame:
    """The rows in two stores with equal ids."""
    return df.withColumn("dataset_id", F.explode(F.array(F.lit("a"), F.lit("b"))))


def seg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("segment_id"), (F.col("o_orderkey") % 500).alias("window_id"),
        F.col("o_custkey").alias("track_id"))


def excluded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderstatus") == "P").select(
        F.col("o_orderkey").alias("segment_id"), F.lit("adult").alias("reason"))


def skips(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("o_orderkey") % 500
    return table(spark, d, "orders").where(w % 11 == 0).select(F.lit("r1").alias("rater"), w.alias("window_id")).distinct()


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Segment frames: the segment's lines as frames inside its window."""
    li = table(spark, d, "lineitem")
    start = (F.col("l_orderkey") % 500 * 5).cast("double")
    return li.select(
        F.col("l_orderkey").alias("segment_id"),
        (start + (F.col("l_partkey") % 11).cast("double") * F.lit(0.5)).alias("t"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("frame_idx"),
        F.concat(F.lit("data/assets/crops/P"), F.col("l_partkey").cast("string"), F.lit("_s"),
                 (F.col("l_suppkey") % 3).cast("string"), F.lit(".jpg")).alias("crop_path"))


def _phase(date: str) -> Column:
    return F.when(F.col(date).cast("timestamp_ntz") < F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"), "pre").otherwise("post")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    human = _rating(F.col("l_quantity")).cast("double")
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return table(spark, d, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("school_id"), _phase("l_shipdate").alias("phase"), human.alias("human_score"),
        (human + (F.col("l_discount") - F.lit(0.05)) * F.lit(20.0)).alias("model_score"))


def trial(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("school_id"), F.col("c_mktsegment").alias("class_id"), _phase("o_orderdate").alias("phase"),
        (F.lit(1.0) + F.col("o_totalprice") % F.lit(6.0)).alias("classroom_score"))


def poses(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    points = F.transform(
        F.sequence(F.lit(0), F.lit(16)),
        lambda i: pose.point(F.get(e, 3 * i), F.get(e, 3 * i + 1), F.abs(F.get(e, 3 * i + 2))))
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("segment_id"), points.alias("kpts"))


def faces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        "vec_id", F.concat(F.lit("p"), F.col("label").cast("string")).alias("name"), F.col("embedding").alias("emb"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Training histories: one row per variant, seed, fold and epoch."""
    c = table(spark, d, "orders")
    key = F.col("o_orderkey")
    price = F.col("o_totalprice")
    return c.groupBy(
        F.col("o_orderpriority").alias("variant"), (key % 2).cast("int").alias("seed"), (key % 4).cast("int").alias("fold"),
        (key % 25).cast("int").alias("epoch"),
    ).agg(
        F.avg(F.sqrt(price) / 700.0).alias("val_exact_accuracy"),
        F.avg(F.sqrt(price + 1.0) / 400.0).alias("val_mae"),
        F.avg(F.sqrt(price + 2.0) / 800.0).alias("val_qwk"),
        F.avg(F.sqrt(price + 3.0) / 300.0).alias("val_mse"))
