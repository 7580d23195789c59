"""Readers and sinks, run over data written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lessonlens.plans.catalogue import query
from lessonlens.plans.intervention_queries import _until, course_steps
from lessonlens.plans.tools import rounded
from lessonlens.session import scratch_path
from lessonlens.sources import files, fixtures as fx


@query("S1_read_corpus", "SELECT 'first' AS dataset_id, segment_id, window_id, track_id FROM seg UNION ALL SELECT 'second', segment_id, window_id, NULL FROM seg")
def s1(spark, d):
    base = scratch_path(spark, "corpus")
    fx.seg(spark, d).write.parquet(f"{base}/lesson one/segments.parquet")
    fx.seg(spark, d).drop("track_id").write.parquet(f"{base}/50%+/segments.parquet")
    corpus = files.read_corpus(spark, {"first": f"{base}/lesson one", "second": f"{base}/50%+"}, ["segments"])
    return corpus["segments"].select("dataset_id", "segment_id", "window_id", "track_id")


@query("S4_S8_csv_contract", "SELECT CAST(school_id AS VARCHAR) AS school_id, class_id, phase, count(*) AS n, round(avg(classroom_score),6) AS score FROM trial GROUP BY 1,2,3")
def s4(spark, d):
    base = scratch_path(spark, "trial")
    rows = fx.trial(spark, d).withColumn("session_id", F.lit("s")).withColumn("time_bin", F.lit("0")).withColumn("extra", F.array(F.lit(1)))
    files.write_tables({"trial": rows}, base, "csv")
    read = files.read_trial(spark, f"{base}/trial")
    return rounded(read.groupBy("school_id", "class_id", "phase").agg(F.count(F.lit(1)).alias("n"), F.avg("classroom_score").alias("score")))


@query("S4_phase_pairs_contract", "SELECT phase, count(*) AS n, round(avg(model_score),6) AS model FROM pairs GROUP BY 1")
def s4_pairs(spark, d):
    base = scratch_path(spark, "pairs")
    files.write_tables({"pairs": fx.pairs(spark, d)}, base, "csv")
    read = files.read_pairs(spark, f"{base}/pairs")
    return rounded(read.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.avg("model_score").alias("model")))


@query("S7_append_log", "SELECT video_path, CAST(count(*)*2 AS BIGINT) AS n, round(avg(score),6) AS score FROM predlog GROUP BY 1")
def s7(spark, d):
    base = scratch_path(spark, "log")
    for _ in range(2):
        files.append_predictions(fx.predlog(spark, d), base)
    return rounded(spark.read.parquet(base).groupBy("video_path").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score")))


@query("S9_report_tables", "SELECT cooldown_sec, event_id, n_pre_bins, n_post_bins FROM un", **_until(course_steps([90, 120]), "un"))
def s9(spark, d):
    from lessonlens.operators import intervention as iv
    from lessonlens.sources.predictions import read_predictions_ab
    log = read_predictions_ab(fx.predlog(spark, d))
    events = iv.resolve_events(log, explicit=(1800.0, 2100.0))
    tables = iv.report_tables(log, events, iv.Design(600.0, 0.0, 600.0, 300.0, cooldowns=(90.0, 120.0)), iterations=500)
    base = scratch_path(spark, "report")
    files.write_tables(tables, base)
    return spark.read.parquet(f"{base}/effects").select("cooldown_sec", "event_id", "n_pre_bins", "n_post_bins")
