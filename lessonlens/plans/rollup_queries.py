"""Readers, filters and roll-ups of the prediction log."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lessonlens.operators import rollups, scans
from lessonlens.plans.catalogue import query
from lessonlens.plans.tools import rounded
from lessonlens.sources import fixtures as fx, predictions as pr
from lessonlens.sources.files import chart_rows

BIN = 300.0


def log(spark, d, video_filter=None):
    return pr.read_predictions(fx.predlog(spark, d), video_filter)


PLOG = """SELECT video_path, frame_idx, t, track_id, coalesce(situation_override, situation) AS situation,
  situation_confidence, score, score_clamped FROM predlog"""


@query("S2_read_predictions", """SELECT video_path, frame_idx, round(t,6) AS t, track_id, situation,
  round(situation_confidence,6) AS situation_confidence, round(score,6) AS score, score_clamped FROM plog""", plog=PLOG)
def s2(spark, d):
    return rounded(log(spark, d).select(
        "video_path", "frame_idx", "t", "track_id", "situation", "situation_confidence", "score", "score_clamped"))


@query("S3_read_predictions_ab", """SELECT video_path, round(t,6) AS t, track_id, round(score,6) AS score,
  CAST(score_clamped AS DOUBLE) AS score_clamped, situation AS base_situation, situation_override IS NOT NULL AS is_ab,
  round(situation_confidence,6) AS situation_confidence FROM predlog""")
def s3(spark, d):
    return rounded(pr.read_predictions_ab(fx.predlog(spark, d)))


@query("S3_read_predictions_ab_live_layout", """SELECT CAST(substr(video_path, 8) AS VARCHAR) AS video_path, round(t,6) AS t, track_id,
  round(score,6) AS score, CAST(score_clamped AS DOUBLE) AS score_clamped, situation AS base_situation, false AS is_ab,
  CAST(NULL AS DOUBLE) AS situation_confidence FROM predlog""")
def s3_live(spark, d):
    live = fx.predlog(spark, d).select(
        F.substring("video_path", 8, 9).alias("video_id"), "t", "track_id", F.col("score").alias("yhat"),
        F.col("score_clamped").alias("score_int"), "situation")
    return rounded(pr.read_predictions_ab(live))


def _count_by_video(df):
    return df.groupBy("video_path").agg(F.count(F.lit(1)).alias("n"))


@query("P1_video_filter_regex", "SELECT video_path, count(*) AS n FROM predlog WHERE regexp_matches(video_path, 'lesson_[01].') GROUP BY 1")
def p1(spark, d):
    return _count_by_video(log(spark, d, "lesson_[01]."))


@query("P2_video_filter_literal", "SELECT video_path, count(*) AS n FROM predlog WHERE contains(video_path, 'lesson_2') GROUP BY 1")
def p2(spark, d):
    return _count_by_video(pr.read_predictions_ab(fx.predlog(spark, d), "lesson_2"))


@query("P3_video_filter_like", "SELECT video_path, count(*) AS n FROM predlog WHERE video_path ILIKE '%LESSON_0_%' GROUP BY 1")
def p3(spark, d):
    return _count_by_video(fx.predlog(spark, d).where(pr.like_text(F.col("video_path"), F.lit("LESSON_0_"))))


@query("P4_half_open_interval", "SELECT video_path, count(*) AS n FROM predlog WHERE t >= 1800 AND t < 2100 GROUP BY 1")
def p4(spark, d):
    return _count_by_video(fx.predlog(spark, d).where(pr.in_interval(F.col("t"), 1800.0, 2100.0)))


@query("A1_overall_stats", """SELECT count(*) AS n_rows, count(DISTINCT track_id) AS n_tracks, round(min(t),6) AS t_min, round(max(t),6) AS t_max,
  round(avg(score),6) AS score_mean, round(stddev_pop(score),6) AS score_std, round(quantile_cont(score,0.1),6) AS score_p10,
  round(quantile_cont(score,0.5),6) AS score_p50, round(quantile_cont(score,0.9),6) AS score_p90,
  round(avg(score_clamped),6) AS clamped_mean FROM predlog""")
def a1(spark, d):
    return rounded(rollups.overall_stats(log(spark, d)))


@query("A2_by_track", """SELECT situation, track_id, count(*) AS n, round(min(t),6) AS t_min, round(max(t),6) AS t_max, round(avg(score),6) AS score_mean,
  round(stddev_samp(score),6) AS score_std, round(median(score),6) AS score_p50, round(avg(score_clamped),6) AS clamped_mean,
  round(max(t)-min(t),6) AS duration_sec FROM plog GROUP BY 1,2 HAVING count(*) >= 10""", plog=PLOG)
def a2(spark, d):
    return rounded(rollups.by_track(log(spark, d), 10))


@query("A3_timeseries_per_sec", """SELECT situation, sec, count(*) AS n_tracks, round(avg(score),6) AS score_mean, round(median(score),6) AS score_p50,
  round(avg(clamped),6) AS clamped_mean FROM (SELECT situation, CAST(floor(t) AS INT) AS sec, track_id, avg(score) AS score,
  avg(score_clamped) AS clamped FROM plog GROUP BY 1,2,3) GROUP BY 1,2""", plog=PLOG)
def a3(spark, d):
    return rounded(rollups.timeseries_per_sec(log(spark, d)))


TRIM = """avg(CASE WHEN rn > floor(n*CAST(0.1 AS DOUBLE)) AND rn <= n-floor(n*CAST(0.1 AS DOUBLE)) THEN score END)"""


@query("A4_timeseries_binned", f"""SELECT situation, bin*CAST(300 AS DOUBLE) AS bin_start, (bin+1)*CAST(300 AS DOUBLE) AS bin_end, count(*) AS n_tracks,
  round(avg(score),6) AS score_mean, round({TRIM},6) AS score_trimmed_mean, round(median(score),6) AS score_p50,
  round(stddev_samp(score),6) AS score_std, round(avg(CASE WHEN score<=3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) AS low_score_ratio,
  round(avg(situation_confidence),6) AS situation_confidence, round(avg(clamped),6) AS clamped_mean FROM rk GROUP BY situation, bin""",
  plog=PLOG,
  pt="""SELECT situation, CAST(floor(t/CAST(300 AS DOUBLE)) AS INT) AS bin, track_id, avg(score) AS score, avg(score_clamped) AS clamped,
  avg(situation_confidence) AS situation_confidence FROM plog GROUP BY 1,2,3""",
  rk="""SELECT *, row_number() OVER (PARTITION BY situation,bin ORDER BY score, track_id) AS rn,
  count(*) OVER (PARTITION BY situation,bin) AS n FROM pt""")
def a4(spark, d):
    return rounded(rollups.timeseries_binned(log(spark, d), BIN))


@query("A5_trimmed_mean", f"""SELECT video_path, situation, round({TRIM},6) AS trimmed_mean, CAST(max(n) AS BIGINT) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY video_path, situation ORDER BY score) AS rn,
  count(*) OVER (PARTITION BY video_path, situation) AS n FROM pred) GROUP BY 1,2""")
def a5(spark, d):
    return rounded(rollups.trimmed_means(fx.pred(spark, d), ["video_path", "situation"], "score", 0.1))


@query("T1_top_tracks", """SELECT situation, track_id, count(*) AS n, round(avg(score),6) AS score_mean FROM plog GROUP BY 1,2 HAVING count(*) >= 10
  ORDER BY avg(score) DESC, n DESC, situation, track_id LIMIT 10""", plog=PLOG)
def t1(spark, d):
    tracks = rollups.by_track(log(spark, d), 10)
    top = tracks.orderBy(F.desc("score_mean"), F.desc("n"), "situation", "track_id").limit(10)
    return rounded(top.select("situation", "track_id", "n", "score_mean"))


@query("T4_top_confident_tracks", """SELECT video_path, track_id, round(conf,6) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY video_path
  ORDER BY conf DESC, track_id) AS k FROM (SELECT video_path, track_id, max(conf) AS conf FROM detections GROUP BY 1,2)) WHERE k <= 5""")
def t4(spark, d):
    best = fx.detections(spark, d).groupBy("video_path", "track_id").agg(F.max("conf").alias("conf"))
    order = Window.partitionBy("video_path").orderBy(F.desc("conf"), "track_id")
    return rounded(best.withColumn("k", F.row_number().over(order)).where("k <= 5").drop("k"))


@query("T5_latest_video", "SELECT video_path, count(*) AS n FROM detections WHERE video_path = (SELECT video_path FROM detections ORDER BY id DESC LIMIT 1) GROUP BY 1")
def t5(spark, d):
    det = fx.detections(spark, d)
    return _count_by_video(det.join(det.agg(F.max_by("video_path", "id").alias("video_path")), "video_path"))


@query("T6_presentation_order", """SELECT situation, track_id, round(score_mean,6) AS score_mean, row_number() OVER (ORDER BY situation, score_mean DESC, track_id) AS position
  FROM (SELECT situation, track_id, avg(score) AS score_mean FROM pred GROUP BY 1,2)""")
def t6(spark, d):
    means = fx.pred(spark, d).groupBy("situation", "track_id").agg(F.avg("score").alias("score_mean"))
    chunk = [F.struct("situation", (-F.floor(F.col("score_mean") * 64)).alias("c")), -F.floor(F.col("score_mean") * 65536)]
    return rounded(scans.row_index(means, [], ["situation", F.desc("score_mean"), "track_id"], "position", chunk))


SPAN_STEPS = {
    "r": "SELECT t_start AS x, situation, lag(situation) OVER (ORDER BY t_start) AS p, lag(t_start) OVER (ORDER BY t_start) AS px FROM win",
    "g": "SELECT x, situation, x - px AS gap, sum(CASE WHEN p IS NULL OR p <> situation THEN 1 ELSE 0 END) OVER (ORDER BY x) AS run FROM r",
    "sp": "SELECT run, min(x) AS span_start, max(x) AS last_x, any_value(situation) AS situation FROM g GROUP BY 1",
    "dt": "SELECT gap FROM (SELECT gap, row_number() OVER (ORDER BY gap) - 1 AS i, count(*) OVER () AS n FROM g WHERE gap > 0) WHERE i = n // 2",
}


@query("W8_situation_spans", """SELECT span_start, coalesce(lead(span_start) OVER (ORDER BY span_start), last_x + (SELECT gap FROM dt)) AS span_end, situation FROM sp""",
       **SPAN_STEPS)
def w8(spark, d):
    return rollups.situation_spans(fx.win(spark, d).select(F.col("t_start").alias("x"), "situation"), [])


@query("S5_chart_rows", "SELECT situation, t AS x, round(score,6) AS score FROM (SELECT situation, round(t,6) AS t, CASE WHEN frame_idx % 3 > 0 THEN score END AS score FROM pred) WHERE score IS NOT NULL")
def s5(spark, d):
    raw = fx.pred(spark, d).select("situation", F.round("t", 6).alias("sec"), F.when(F.col("frame_idx") % 3 > 0, F.col("score")).alias("mean"))
    return rounded(chart_rows(raw, "situation", "sec", "mean"))


@query("F24_axis_ticks", """SELECT situation, unnest(ticks) AS tick FROM (SELECT situation, list_filter(list_transform(range(0, CAST(floor((hi+step*0.5)/step - f0) AS BIGINT)+1),
  lambda i: round((f0+i)*step,6)), lambda v: v >= lo-step*0.5) AS ticks FROM b)""",
  a="SELECT situation, min(t) AS lo, max(t) AS hi, (max(t)-min(t))/6 AS raw FROM pred GROUP BY 1",
  b="""SELECT situation, lo, hi, step, floor(lo/step) AS f0 FROM (SELECT *, CASE WHEN raw/ten<=1 THEN 1 WHEN raw/ten<=2 THEN 2 WHEN raw/ten<=5 THEN 5 ELSE 10 END * ten AS step
  FROM (SELECT *, pow(CAST(10 AS DOUBLE), floor(log10(raw))) AS ten FROM a))""")
def f24(spark, d):
    return rollups.nice_ticks(fx.pred(spark, d), ["situation"], "t").select("situation", F.explode("ticks").alias("tick"))
