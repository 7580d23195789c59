"""Streams over the whole events table, checked against their batch counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lessonlens.plans.catalogue import query
from lessonlens.plans.tools import rounded
from lessonlens.sources import fixtures as fx
from lessonlens.streaming import live



def _events(spark, d):
    """The events table as a stream."""
    schema = fx.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 64).parquet(d)


def _instant():
    """The wall-clock time of an event as an instant in UTC, whatever the session's time zone."""
    return F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))"))


def _wall(column):
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({column}), timestamp_ntz'1970-01-01 00:00:00')").alias(column)


def _log(spark, d, *more):
    """The fixture log over the streamed events; lesson n begins on day n of a month."""
    ts = F.col("ts").cast("timestamp_ntz")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    kind = F.col("event_type")
    log = _events(spark, d).select(
        F.concat(F.lit("lesson_"), F.lpad(F.dayofmonth(ts).cast("string"), 2, "0")).alias("video_path"),
        F.col("event_id").alias("frame_idx"), (seconds.cast("double") / F.lit(24.0)).alias("t"), F.col("user_id").alias("track_id"),
        F.least(F.lit(7.0), F.lit(1.0) + F.sqrt("value") / F.lit(3.7)).alias("score"),
        F.when(kind == "click", fx.WRITE).when(kind == "purchase", fx.TALK).otherwise(fx.LISTEN).alias("situation"),
        F.dayofmonth(ts).alias("day"), *more)
    return live.lesson_clock(log, F.timestamp_seconds(F.col("day") * 86400)).drop("day")


EMA_STEPS = {"ord": "SELECT *, frame_idx % 7 = 0 AS gone, row_number() OVER (PARTITION BY video_path, track_id ORDER BY t, frame_idx) AS i FROM pred"}
# The state of a track after its i-th row, with a prediction at most every two minutes, from the second row of its buffer on.
TRACK_STEPS = {**EMA_STEPS, "st": """SELECT DISTINCT video_path, track_id, 0::BIGINT AS i, 0::BIGINT AS n, NULL::DOUBLE AS smooth, NULL::DOUBLE AS last_, false AS due, NULL::BIGINT AS frame_idx, NULL::DOUBLE AS score, NULL::DOUBLE AS t FROM pred
  UNION ALL SELECT video_path, track_id, i, n, CASE WHEN gone THEN NULL WHEN due THEN 0.7::DOUBLE*coalesce(smooth, score) + 0.3::DOUBLE*score ELSE smooth END, CASE WHEN gone THEN NULL WHEN due THEN t ELSE last_ END, due, frame_idx, score, t FROM (
    SELECT o.video_path, o.track_id, o.i, o.frame_idx, o.score, o.t, o.gone, s.smooth, s.last_, CASE WHEN o.gone THEN 0 ELSE least(2, s.n+1) END AS n, NOT o.gone AND s.n+1 >= 2 AND coalesce(o.t - s.last_ >= 120 - 1e-9, true) AS due
    FROM st s JOIN ord o ON o.video_path=s.video_path AND o.track_id=s.track_id AND o.i=s.i+1)"""}


def _track_scores(stream):
    return live.track_scores(stream.withColumn("excluded", F.col("frame_idx") % 7 == 0), every=120.0, buffer=2, ttl=live.LESSON_TTL)


@query("R4_R10_track_scores_stream", "SELECT video_path, track_id, frame_idx, round(score,6) AS raw_score, round(smooth,6) AS smooth_score FROM st WHERE due", **TRACK_STEPS)
def r4(spark, d):
    out = live.drain_closed(_log(spark, d), _track_scores, "track-scores")
    return rounded(out.select("video_path", "track_id", "frame_idx", "raw_score", "smooth_score"))


@query("R3_track_eviction_stream", "SELECT video_path, track_id, frame_idx, round(smooth,6) AS smooth_score FROM ev", **EMA_STEPS,
       ev="""SELECT video_path, track_id, i, frame_idx, t, score AS smooth FROM ord WHERE i = 1 UNION ALL SELECT o.video_path, o.track_id, o.i, o.frame_idx, o.t, CASE WHEN o.t - e.t > 600 THEN o.score ELSE 0.7::DOUBLE*e.smooth + 0.3::DOUBLE*o.score END
         FROM ev e JOIN ord o ON o.video_path=e.video_path AND o.track_id=e.track_id AND o.i=e.i+1""")
def r3(spark, d):
    out = live.drain_closed(_log(spark, d), lambda log: live.track_scores(log, every=0.0, ttl=600.0), "track-eviction")
    return rounded(out.select("video_path", "track_id", "frame_idx", "smooth_score"))


@query("R1_throttled_stream", "SELECT video_path, track_id, round(t,6) AS t FROM em",
       em="""SELECT video_path, track_id, min(t) AS t FROM pred GROUP BY 1,2 UNION ALL SELECT video_path, track_id, nt FROM (SELECT e.video_path, e.track_id, min(p.t) AS nt FROM em e JOIN pred p
         ON p.video_path=e.video_path AND p.track_id=e.track_id AND p.t - e.t >= 900 - 1e-9 GROUP BY 1,2)""")
def r1(spark, d):
    return rounded(live.drain_closed(_log(spark, d), lambda log: live.throttled(log, 1.0 / 900.0), "throttled").select("video_path", "track_id", "t"))


@query("R2_buffered_stream", """SELECT video_path, track_id, frame_idx, i >= 3 AS ready, list_transform(list(score) OVER (PARTITION BY video_path, track_id ORDER BY t, frame_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), lambda v: round(v,6)) AS items FROM ord""", **EMA_STEPS)
def r2(spark, d):
    rows = _log(spark, d).withColumn("item", F.col("score"))
    out = live.drain_closed(rows, lambda log: live.buffered(log, 3, ttl=live.LESSON_TTL), "buffered")
    return out.select("video_path", "track_id", "frame_idx", "ready", F.transform("items", lambda v: F.round(v, 6)).alias("items"))


@query("R5_class_average_stream", """SELECT a.video_path, a.t, round(any_value(a.v),6) AS class_score, round(sum(CASE WHEN b.i = 1 THEN pow(0.8::DOUBLE, a.i-1) ELSE 0.2*pow(0.8::DOUBLE, a.i-b.i) END * b.v),6) AS smooth_score
  FROM num a JOIN num b ON a.video_path=b.video_path AND b.i <= a.i GROUP BY 1,2""", **TRACK_STEPS,
       spn="SELECT video_path, floor(t/6) AS span, round(min(t),6) AS t, avg(smooth) AS v FROM st WHERE due GROUP BY 1,2",
       num="SELECT *, row_number() OVER (PARTITION BY video_path ORDER BY span) AS i FROM spn")
def r5(spark, d):
    out = live.drain_closed(_log(spark, d), lambda log: live.class_scores(_track_scores(log), frame_sec=6.0), "class-average")
    return rounded(out.select("video_path", "t", "class_score", "smooth_score"))


@query("R5_live_average_stream", """SELECT a.video_path, round(any_value(a.t),6) AS t, any_value(a.n) AS n_alive, round(any_value(a.v),6) AS class_score,
  round(sum(CASE WHEN b.i = 1 THEN pow(0.8::DOUBLE, a.i-1) ELSE 0.2*pow(0.8::DOUBLE, a.i-b.i) END * b.v),6) AS smooth_score FROM num a JOIN num b ON a.video_path=b.video_path AND b.i <= a.i GROUP BY a.video_path, a.i""", **TRACK_STEPS,
       fr="SELECT video_path, floor(t/6) AS span, max(t) AS t FROM st WHERE due GROUP BY 1,2",
       las="""SELECT f.video_path, f.span, f.t, s.track_id, max(s.t) AS seen, max_by(s.smooth, struct_pack(t := s.t, i := s.i)) AS v FROM fr f JOIN st s ON s.due AND s.video_path=f.video_path AND floor(s.t/6) <= f.span GROUP BY 1,2,3,4""",
       num="SELECT video_path, span, t, CAST(count(*) AS INT) AS n, avg(v) AS v, row_number() OVER (PARTITION BY video_path ORDER BY span) AS i FROM las WHERE t - seen <= 300 GROUP BY 1,2,3")
def r5_live(spark, d):
    out = live.drain_closed(_log(spark, d), lambda log: live.live_class_scores(_track_scores(log), frame_sec=6.0, track_ttl=300.0), "live-average")
    return rounded(out)


@query("R6_situation_stream", """SELECT frame_idx, round(p0,6) AS p0, round(p1,6) AS p1, round(1-p0-p1,6) AS p2 FROM (SELECT a.frame_idx, """ + ", ".join(
    f"sum(CASE WHEN b.i = 1 THEN pow(0.85::DOUBLE, a.i-1) ELSE 0.15*pow(0.85::DOUBLE, a.i-b.i) END * b.{p}) AS {p}" for p in ("p0", "p1")) + """ FROM ord a JOIN ord b ON a.video_path=b.video_path AND b.i<=a.i GROUP BY 1)""",
       ord="SELECT *, score/(score+2+t/1000) AS p0, 2/(score+2+t/1000) AS p1, row_number() OVER (PARTITION BY video_path ORDER BY t, frame_idx) AS i FROM pred")
def r6(spark, d):
    rows = _log(spark, d).withColumn("probs", F.array(F.col("score"), F.lit(2.0), F.col("t") / 1000))
    out = live.drain_closed(rows, live.situations, "situations")
    return rounded(out.select("frame_idx", *[F.element_at("probs", i + 1).alias(f"p{i}") for i in range(3)]))


@query("R8_exclusion_stream", """SELECT video_path, track_id, frame_idx, c >= 2 AND c >= 0.5*n AS excluded, CASE WHEN c >= 2 AND c >= 0.5*n THEN CASE WHEN c0 > c1 THEN 'p0' WHEN c1 > c0 THEN 'p1' ELSE f END END AS name FROM (SELECT *, greatest(c0,c1) AS c FROM (
  SELECT video_path, track_id, frame_idx, count(*) OVER w AS n, count(*) FILTER (name='p0') OVER w AS c0, count(*) FILTER (name='p1') OVER w AS c1, list_filter(list(name) OVER w, lambda x: x IS NOT NULL)[1] AS f FROM (
    SELECT *, CASE WHEN frame_idx % 3 > 0 THEN concat('p', CAST(frame_idx % 2 AS VARCHAR)) END AS name FROM pred) WINDOW w AS (PARTITION BY video_path, track_id ORDER BY t, frame_idx ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)))""")
def r8(spark, d):
    i = F.col("frame_idx")
    rows = _log(spark, d).withColumn("matched_name", F.when(i % 3 > 0, F.concat(F.lit("p"), (i % 2).cast("string"))))
    return live.drain_closed(rows, lambda log: live.exclusions(log, ttl=live.LESSON_TTL), "exclusions").select("video_path", "track_id", "frame_idx", "excluded", "name")


@query("R7_rolling_history_stream", """SELECT video_path, round(t,6) AS t, CAST(len(p) AS INT) AS n_points, CAST(len(list_filter(p, lambda x: x.v IS NOT NULL)) AS INT) AS n_known,
  round(list_avg(list_transform(p, lambda x: x.v)),6) AS mean FROM his WHERE i > 0""",
       ord="SELECT *, row_number() OVER (PARTITION BY video_path ORDER BY t, frame_idx) AS i FROM pred",
       his="""SELECT DISTINCT video_path, 0::BIGINT AS i, NULL::DOUBLE AS t, []::STRUCT(t DOUBLE, v DOUBLE)[] AS p FROM pred
         UNION ALL SELECT video_path, i, t, CASE WHEN len(q) = 0 OR t >= q[-1].t + 0.5 - 1e-6 THEN list_append(q, struct_pack(t := t, v := greatest(1.0, least(7.0, score))::DOUBLE)) ELSE q END FROM (
           SELECT o.video_path, o.i, o.t, o.score, list_filter(h.p, lambda x: x.t >= o.t - 60) AS q FROM his h JOIN ord o ON o.video_path=h.video_path AND o.i=h.i+1)""")
def r7(spark, d):
    return rounded(live.drain_closed(_log(spark, d), live.history, "history"))


@query("R9_stable_id_stream")
def r9(spark, d):
    v, i = F.col("value"), F.col("frame_idx")
    vector = lambda *parts: F.array(*[p.cast("double") for p in parts])
    boxes = _log(spark, d, "value").select(
        "video_path", "t", "at", i.alias("det_id"), v.alias("x1"), (v / 2).alias("y1"), (v + 50).alias("x2"), (v / 2 + 100).alias("y2"),
        F.when(i % 3 > 0, vector(F.col("track_id") % 5 + 1, v % 7)).alias("pose_vec"), vector(F.col("track_id") % 3, i % 2).alias("colour_vec"))
    out = live.drain_closed(boxes, lambda log: live.stable_ids(live.frames_of(log, "30 seconds"), 90.0, delay=None), "stable-ids")
    return out.select("video_path", "det_id", "stable_id")


@query("R11_binned_stream", """SELECT situation, bin AS bin_start, count(*) AS n_tracks, round(avg(score),6) AS score_mean, round(median(score),6) AS score_p50, round(stddev_samp(score),6) AS score_std, round(list_avg(list_sort(list(score))[1 + floor(count(score)*0.1)::INT : count(score) - floor(count(score)*0.1)::INT]),6) AS score_trimmed_mean,
    round(avg(CASE WHEN score <= 3 THEN 1.0 ELSE 0.0 END),6) AS low_score_ratio, round(avg(confidence),6) AS situation_confidence, round(avg(clamped),6) AS clamped_mean FROM (
  SELECT p.situation, date_trunc('day', e.ts) AS bin, p.video_path, p.track_id, avg(p.score) AS score, avg(p.score_clamped) AS clamped, avg(p.situation_confidence) AS confidence FROM predlog p JOIN events e ON e.event_id = p.frame_idx GROUP BY 1,2,3,4) GROUP BY 1,2""")
def r11(spark, d):
    rows = _log(spark, d, _instant().alias("ts")).withColumn("at", F.col("ts"))
    rows = rows.withColumn("score_clamped", F.least(F.lit(7), F.greatest(F.lit(1), F.rint("score").cast("int")))).withColumn(
        "situation_confidence", F.lit(0.5) + F.sqrt((F.col("frame_idx") % 50).cast("double")) / F.lit(15.0))
    out = live.drain_closed(rows, lambda log: live.binned_scores(log, "1 day", delay="2 days"), "binned", keyed=False)
    return rounded(out.select("situation", _wall("bin_start"), *[c for c in out.columns if c not in ("situation", "bin_start", "bin_end")]))


@query("R12_flagged_session_stream", """SELECT track_id, min(ts) AS session_start, count(*) AS n FROM (
  SELECT user_id AS track_id, ts, sum(CASE WHEN ts - p < INTERVAL 12 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
    SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE event_type = 'click')) GROUP BY track_id, run""")
def r12(spark, d):
    rows = _events(spark, d).select(
        _instant().alias("at"), F.col("user_id").alias("track_id"), (F.col("event_type") == "click").alias("is_ab"))
    out = live.drain_closed(
        rows, lambda log: live.flagged_sessions(log, "12 hours", ["track_id"], delay="2 days"), "sessions", keyed=False, is_ab=F.lit(True))
    return out.select("track_id", _wall("session_start"), "n")
