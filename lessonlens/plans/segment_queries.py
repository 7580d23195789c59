"""Segments, samples, nearest detections and frame sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from lessonlens.functions import boxes
from lessonlens.operators import segments as sg
from lessonlens.plans.catalogue import query
from lessonlens.plans.tools import DS, TWO_STORES, rounded
from lessonlens.session import cut_lineage
from lessonlens.sources import fixtures as fx

TRACK = ["video_path", "track_id"]

# One lesson squeezed into an hour leaves a few detections per track, so windows are 900 s long.
SEG_STEPS = {
    "tb": "SELECT video_path, track_id, min(t) AS lo, max(t) AS hi FROM detections GROUP BY 1,2",
    "tw": """SELECT video_path, track_id, lo + k*CAST(450 AS DOUBLE) AS t_start, lo + k*CAST(450 AS DOUBLE) + 900 AS t_end FROM tb, range(0, 10) AS r(k)
      WHERE lo + k*CAST(450 AS DOUBLE) + 900 <= hi + 1e-6""",
    "sgm": """SELECT w.video_path, w.track_id, w.t_start, w.t_end, count(*) AS n_detections FROM tw w JOIN detections d
      ON d.video_path=w.video_path AND d.track_id=w.track_id AND d.t >= w.t_start AND d.t <= w.t_end GROUP BY 1,2,3,4 HAVING count(*) >= 2""",
}


def _segments(spark, d):
    # 900 s at two per second and this ratio asks for two detections.
    return sg.build_segments(fx.detections(spark, d), TRACK, 900.0, 450.0, 2.0 / 1800.0)


@query("W1_build_segments", """SELECT video_path, track_id, round(t_start,6) AS t_start, round(t_end,6) AS t_end, n_detections FROM sgm""", **SEG_STEPS)
def w1(spark, d):
    return rounded(_segments(spark, d))


@query("W2_materialise_segments", """SELECT w.video_path, round(w.t_start,6) AS t_start, w.n_tracks FROM (SELECT video_path, t_start, t_end,
  count(DISTINCT track_id) AS n_tracks FROM sgm GROUP BY 1,2,3) w""", **SEG_STEPS)
def w2(spark, d):
    windows, pairs = sg.materialise(_segments(spark, d))
    n = pairs.groupBy(F.col("window_id").alias("id")).agg(F.count(F.lit(1)).alias("n_tracks"))
    return rounded(windows.join(n, "id").select("video_path", "t_start", "n_tracks"))


GRID = """SELECT video_path, track_id, t_start, t_end, k, least(greatest(t_start + (k + CAST(0.5 AS DOUBLE))*CAST(50 AS DOUBLE), t_start), t_end) AS sample_t
  FROM sgm, range(0, 18) AS r(k) WHERE k < greatest(1, floor((t_end - t_start) * CAST(0.02 AS DOUBLE)))"""


@query("W3_sample_grid", "SELECT video_path, track_id, round(t_start,6) AS t_start, k, round(sample_t,6) AS sample_t FROM grid", **SEG_STEPS, grid=GRID)
def w3(spark, d):
    return rounded(sg.sample_grid(_segments(spark, d), 0.02).select("video_path", "track_id", "t_start", "k", "sample_t"))


@query("J9_nearest_detection", """SELECT g.video_path, g.track_id, round(g.t_start,6) AS t_start, g.k, arg_min(x.id, struct_pack(d := abs(x.t - g.sample_t), t := x.t, id := x.id)) AS id
  FROM grid g JOIN detections x ON x.video_path=g.video_path AND x.track_id=g.track_id GROUP BY 1,2,3,4,g.t_start""", **SEG_STEPS, grid=GRID)
def j9(spark, d):
    samples = sg.sample_grid(_segments(spark, d), 0.02).select("video_path", "track_id", "t_start", "k", "sample_t")
    hits = sg.sampled_detections(samples, fx.detections(spark, d), TRACK)
    return rounded(hits.select(*TRACK, "t_start", "k", F.col("hit.id").alias("id")))


AUDIT = {
    "sa": """SELECT s.segment_id, w.t_start, w.t_end, count(f.t) AS frames, count(DISTINCT f.t) AS distinct_t,
      CAST(coalesce(sum(CASE WHEN f.t < w.t_start OR f.t >= w.t_end THEN 1 ELSE 0 END), 0) AS BIGINT) AS outside, max(f.t) - min(f.t) AS span
      FROM seg s JOIN win w ON s.window_id = w.window_id LEFT JOIN frames f ON f.segment_id = s.segment_id GROUP BY 1,2,3""",
}


def _audit(spark, d):
    segments = fx.seg(spark, d).join(fx.win(spark, d), "window_id").select("segment_id", "t_start", "t_end")
    return sg.sequence_audit(fx.stores(segments), fx.stores(fx.frames(spark, d)), DS)


@query("A35_sequence_audit", f"SELECT dataset_id, segment_id, t_start, t_end, frames, distinct_t, outside, span FROM sa, {TWO_STORES}", **AUDIT)
def a35(spark, d):
    return _audit(spark, d)


SUMMARY = """count(*) AS segments, count_if(abs(t_end-t_start-5) > 1e-5) AS off_length_windows, count_if(frames=0) AS no_frames,
  count_if(frames<5) AS fewer_frames, count_if(frames=5) AS exact_frames, count_if(frames>5) AS more_frames, count_if(frames<>distinct_t) AS duplicate_timestamps,
  CAST(sum(outside) AS BIGINT) AS frames_outside_window, min(span) AS span_min_sec, max(span) AS span_max_sec, round(median(span),6) AS span_median_sec"""


@query("A35_sequence_summary", f"SELECT dataset_id, labelled, {SUMMARY} FROM {TWO_STORES}, (SELECT 'all' AS labelled, * FROM sa UNION ALL SELECT 'labelled', * FROM sa WHERE segment_id IN (SELECT segment_id FROM ratings)) GROUP BY 1, 2", **AUDIT)
def a35_summary(spark, d):
    audit = cut_lineage(_audit(spark, d))  # read by both counts and by the median's ranks
    labelled = audit.join(fx.rate(spark, d), "segment_id", "left_semi").withColumn("labelled", F.lit("labelled"))
    both = cut_lineage(audit.withColumn("labelled", F.lit("all")).unionByName(labelled))
    return rounded(sg.sequence_summary(both, [*DS, "labelled"], expected=5))


@query("Q6_sequence_completeness", f"""SELECT dataset_id, count_if(frames < 5) AS short_segments, count_if(frames <> distinct_t) AS duplicated_segments,
  count_if(outside > 0) AS outside_segments, count_if(frames < 5 OR frames <> distinct_t OR outside > 0) > 0 AS failed FROM sa, {TWO_STORES} GROUP BY 1""", **AUDIT)
def q6(spark, d):
    from lessonlens.operators import quality
    return quality.sequence_completeness(_audit(spark, d), 5, DS)


POS = {"pos": """SELECT segment_id, t, frame_idx, crop_path, row_number() OVER (PARTITION BY segment_id ORDER BY t, frame_idx, crop_path) - 1 AS i,
  count(*) OVER (PARTITION BY segment_id) AS n FROM frames"""}


@query("W14_uniform_sampling", """SELECT segment_id, n AS n_frames, k, CASE WHEN n >= 4 THEN CAST(round_even(k*((n-1)/CAST(3 AS DOUBLE)), 0) AS INT)
  ELSE CAST(least(k, n-1) AS INT) END AS i FROM (SELECT segment_id, count(*) AS n FROM frames GROUP BY 1), range(0,4) AS r(k)""")
def w14(spark, d):
    counts = fx.frames(spark, d).groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_frames"))
    slots = counts.select("segment_id", "n_frames", F.posexplode(sg.uniform_positions(F.col("n_frames"), 4)).alias("k", "i"))
    return slots.withColumn("k", F.col("k").cast("bigint"))


@query("W15_sequence_assembly", f"""SELECT dataset_id, s.segment_id, s.n AS n_frames, s.k, p.t FROM {TWO_STORES}, (SELECT segment_id, n, k, CASE WHEN n >= 4 THEN round_even(k*((n-1)/CAST(3 AS DOUBLE)), 0)
  ELSE least(k, n-1) END AS i FROM (SELECT segment_id, count(*) AS n FROM frames GROUP BY 1), range(0,4) AS r(k)) s JOIN pos p ON p.segment_id=s.segment_id AND p.i=s.i""", **POS)
def w15(spark, d):
    built = sg.assemble(fx.stores(fx.frames(spark, d)), 4, ["t"], ds=DS)
    return built.select(*DS, "segment_id", "n_frames", F.explode("sequence").alias("f")).select(
        *DS, "segment_id", "n_frames", F.col("f.k").cast("bigint").alias("k"), "f.t")


@query("W14_contiguous_sampling", """SELECT s.segment_id, s.n AS n_frames, s.k, p.t FROM (SELECT segment_id, n, k, least(CAST('0x' || substr(md5('42:' || segment_id), 1, 15) AS BIGINT) % greatest(1, n - 4 + 1) + k, n - 1) AS i
  FROM (SELECT segment_id, count(*) AS n FROM frames GROUP BY 1), range(0,4) AS r(k)) s JOIN pos p ON p.segment_id=s.segment_id AND p.i=s.i""", **POS)
def w14_random(spark, d):
    built = sg.assemble(fx.frames(spark, d), 4, ["t"], seed=42)
    return built.select("segment_id", "n_frames", F.explode("sequence").alias("f")).select(
        "segment_id", "n_frames", F.col("f.k").cast("bigint").alias("k"), "f.t")


@query("W19_animation_frames", f"""SELECT dataset_id, segment_id, clip_start, clip_end, CAST(k AS INT) AS position, t, crop_path FROM {TWO_STORES}, (
  SELECT u.*, r.k FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY t, crop_path) - 1 AS i, count(*) OVER (PARTITION BY segment_id) AS n FROM uniq) u, range(0, 3) AS r(k)
  WHERE r.k < least(3, n) AND u.i = CASE WHEN least(3, n) = 1 THEN n // 2 ELSE round_even(r.k*(n-1)/CAST(least(3, n)-1 AS DOUBLE), 0) END)""",
  uniq="""SELECT f.segment_id, w.t_start AS clip_start, w.t_end AS clip_end, f.crop_path, min(f.t) AS t FROM frames f JOIN seg s ON f.segment_id=s.segment_id
  JOIN win w ON s.window_id=w.window_id WHERE f.t >= w.t_start AND f.t < w.t_end GROUP BY 1,2,3,4""")
def w19(spark, d):
    clips = fx.seg(spark, d).join(fx.win(spark, d), "window_id").select(
        "segment_id", F.col("t_start").alias("clip_start"), F.col("t_end").alias("clip_end"))
    return sg.animation_frames(fx.stores(fx.frames(spark, d)), fx.stores(clips), fps=2.0, max_frames=3, ds=DS)


@query("W21_overlay_boxes", """SELECT video_path, track_id, label_frame, x1, y1, x2, y2, label_frame/CAST(1 AS DOUBLE) AS label_start, label_frame/CAST(1 AS DOUBLE)+1 AS label_end FROM (
  SELECT video_path, track_id, CAST(round_even(t, 0) AS INT) AS label_frame, CAST(round_even(x1*CAST(0.5 AS DOUBLE),0) AS INT) AS x1, CAST(round_even(y1*CAST(0.25 AS DOUBLE),0) AS INT) AS y1,
  CAST(round_even(x2*CAST(0.5 AS DOUBLE),0) AS INT) AS x2, CAST(round_even(y2*CAST(0.25 AS DOUBLE),0) AS INT) AS y2,
  row_number() OVER (PARTITION BY video_path, track_id, round_even(t,0) ORDER BY t DESC, id DESC) AS k FROM detections) WHERE k = 1""")
def w21(spark, d):
    return sg.overlay_boxes(fx.detections(spark, d), ["video_path"], 1.0, F.lit(0.5), F.lit(0.25))


@query("W23_slot_samples", """SELECT video_path, track_id, CAST(floor(t*CAST(0.01 AS DOUBLE) + 1e-9) AS BIGINT) AS slot, round(min(t),6) AS t FROM pred GROUP BY 1,2,3""")
def w23_slots(spark, d):
    return rounded(sg.slot_samples(fx.pred(spark, d), TRACK, 0.01).select(*TRACK, "slot", "t"))


@query("W23_rate_limited_rows", """SELECT video_path, track_id, round(t,6) AS t FROM em""",
       em="""SELECT video_path, track_id, min(t) AS t FROM pred GROUP BY 1,2 UNION ALL
       SELECT video_path, track_id, nt AS t FROM (SELECT e.video_path, e.track_id, min(p.t) AS nt FROM em e JOIN pred p
         ON p.video_path=e.video_path AND p.track_id=e.track_id AND p.t - e.t >= 900 - 1e-9 GROUP BY 1,2)""")
def w23(spark, d):
    return rounded(sg.rate_limited(fx.pred(spark, d), TRACK, 900.0).select(*TRACK, "t"))


@query("T3_nearest_frames", f"""SELECT dataset_id, segment_id, t, frame_idx, CAST(k AS INT) AS rank, round(distance,6) AS distance FROM {TWO_STORES}, (SELECT f.segment_id, f.t, f.frame_idx, abs(f.t - (w.t_start+w.t_end)/2) AS distance,
  row_number() OVER (PARTITION BY f.segment_id ORDER BY abs(f.t - (w.t_start+w.t_end)/2), f.t, f.frame_idx) AS k
  FROM frames f JOIN seg s ON s.segment_id=f.segment_id JOIN win w ON w.window_id=s.window_id) WHERE k <= 3""")
def t3(spark, d):
    centres = fx.seg(spark, d).join(fx.win(spark, d), "window_id").select(
        "segment_id", ((F.col("t_start") + F.col("t_end")) / 2).alias("centre"))
    near = sg.nearest_frames(fx.stores(fx.frames(spark, d)), fx.stores(centres), 3, DS)
    return rounded(near.select(*DS, "segment_id", "t", "frame_idx", "rank", "distance"))


@query("P10_clamp_boxes", """SELECT id, a AS x1, b AS y1, c AS x2, e AS y2 FROM (SELECT id, greatest(0, least(399, CAST(trunc(x1-20) AS INT))) AS a, greatest(0, least(299, CAST(trunc(y1-20) AS INT))) AS b,
  greatest(0, least(399, CAST(trunc(x2) AS INT))) AS c, greatest(0, least(299, CAST(trunc(y2) AS INT))) AS e FROM detections) WHERE c > a AND e > b""")
def p10(spark, d):
    det = fx.detections(spark, d)
    corners = boxes.box(F.col("x1") - 20, F.col("y1") - 20, F.col("x2"), F.col("y2"))
    return det.select("id", boxes.clamp_box(corners, F.lit(400), F.lit(300)).alias("b")).where("b IS NOT NULL").select("id", "b.*")


@query("F13_upper_body_box", """SELECT id, CAST(trunc(y1) AS INT) + greatest(1, least(h, CAST(round_even(h*CAST(0.68 AS DOUBLE),0) AS INT))) AS bottom
  FROM (SELECT id, y1, CAST(trunc(y2) AS INT) - CAST(trunc(y1) AS INT) AS h FROM detections)""")
def f13(spark, d):
    det = fx.detections(spark, d)
    whole = F.struct(F.col("y1").cast("int").alias("y1"), F.col("y2").cast("int").alias("y2"))
    return det.select("id", boxes.upper_body_bottom(whole).cast("int").alias("bottom"))


def _consecutive(spark, d):
    """Detections with the next one of the same lesson."""
    from lessonlens.operators import scans
    det = fx.detections(spark, d)
    corner = ["x1", "y1", "x2", "y2"]
    near = scans.neighbours(det, ["video_path"], ["t", "id"], corner, scans.time_chunk("t", 300.0))
    return near.where(F.col("next_row").isNotNull()).select(
        "id", boxes.box(*[F.col(c) for c in corner]).alias("a"), F.col("next_row").alias("b"))


NEXT = {"nx": """SELECT * FROM (SELECT id, x1 AS a1, y1 AS a2, x2 AS a3, y2 AS a4, lead(x1) OVER w AS b1, lead(y1) OVER w AS b2, lead(x2) OVER w AS b3, lead(y2) OVER w AS b4
  FROM detections WINDOW w AS (PARTITION BY video_path ORDER BY t, id)) WHERE b1 IS NOT NULL"""}


@query("F14_box_overlap", """SELECT id, round(inter / greatest(1e-6, (a3-a1)*(a4-a2) + (b3-b1)*(b4-b2) - inter), 6) AS iou FROM (SELECT *, greatest(0, least(a3,b3)-greatest(a1,b1)) *
  greatest(0, least(a4,b4)-greatest(a2,b2)) AS inter FROM nx)""", **NEXT)
def f14(spark, d):
    return rounded(_consecutive(spark, d).select("id", boxes.iou(F.col("a"), F.col("b")).alias("iou")))


@query("F15_centre_distance", "SELECT id, round(sqrt(pow((a1+a3)/2-(b1+b3)/2,2) + pow((a2+a4)/2-(b2+b4)/2,2))/500,6) AS distance FROM nx", **NEXT)
def f15(spark, d):
    return rounded(_consecutive(spark, d).select("id", boxes.centre_distance(F.col("a"), F.col("b")).alias("distance")))


@query("F22_clock_text", """SELECT frame_idx, concat(CAST(h AS VARCHAR), ':', lpad(CAST(m AS VARCHAR),2,'0'), ':', lpad(CAST(s + CASE WHEN cs >= 100 THEN 1 ELSE 0 END AS VARCHAR),2,'0'), '.',
  lpad(CAST(cs % 100 AS VARCHAR),2,'0')) AS clock FROM (SELECT frame_idx, CAST(floor(t/3600) AS BIGINT) AS h, CAST(floor((t - floor(t/3600)*3600)/60) AS BIGINT) AS m,
  CAST(floor(r) AS BIGINT) AS s, CAST(round_even((r - floor(r))*100, 0) AS INT) AS cs FROM (SELECT *, (t - floor(t/3600)*3600) - floor((t - floor(t/3600)*3600)/60)*60 AS r FROM pred))""")
def f22(spark, d):
    from lessonlens.functions.text import clock_text
    return fx.pred(spark, d).select("frame_idx", clock_text(F.col("t")).alias("clock"))


@query("F1_parse_clock", """SELECT frame_idx, round(CASE WHEN frame_idx % 3 = 0 THEN floor(t) WHEN frame_idx % 3 = 1 THEN floor(t/60)*60 + floor(t)%60 ELSE NULL END, 6) AS seconds FROM pred""")
def f1(spark, d):
    from lessonlens.functions.text import parse_clock
    whole = F.floor("t")
    text = F.when(F.col("frame_idx") % 3 == 0, F.format_string("%d", whole)).when(
        F.col("frame_idx") % 3 == 1, F.format_string("%d:%d:%02d", F.lit(0), F.floor(whole / 60).cast("int"), whole % 60)).otherwise("1:x")
    return fx.pred(spark, d).select("frame_idx", parse_clock(text).alias("seconds"))
