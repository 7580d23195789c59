"""Ratings: joins, progress, series, consensus, clips, merging and table changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lessonlens.operators import clips as cl, merging as mg, mutations as mu, quality as ql, ratings as rt
from lessonlens.plans.catalogue import query
from lessonlens.plans.tools import DS, TWO_STORES, rounded
from lessonlens.schemas import DDL
from lessonlens.session import cut_lineage
from lessonlens.sources import fixtures as fx

CLIP = ["clip_start", "clip_end"]


def _tables(spark, d):
    return fx.win(spark, d), fx.seg(spark, d), fx.labels(spark, d), fx.skips(spark, d), fx.excluded(spark, d)


def _videos(spark, d):
    """Three videos; a window belongs to the one its number names."""
    v = (F.col("o_orderkey") % 3)
    return fx.table(spark, d, "orders").select(v.alias("video_id")).distinct().select(
        "video_id", (F.lit(24.0) + F.col("video_id")).alias("fps"), F.lit(1920).alias("width"), F.lit(1080).alias("height"),
        (F.col("video_id") * 1000).alias("frame_count"))


VID = "SELECT DISTINCT o_orderkey % 3 AS video_id, CAST(24 AS DOUBLE) + o_orderkey % 3 AS fps, 1920 AS width, 1080 AS height, (o_orderkey % 3)*1000 AS frame_count FROM orders"


@query("J1_star_join", """SELECT s.segment_id, s.track_id, w.t_start, w.situation, v.fps FROM seg s JOIN win w ON s.window_id=w.window_id JOIN vid v ON v.video_id = w.window_id % 3""", vid=VID)
def j1(spark, d):
    w, s, *_ = _tables(spark, d)
    return rt.star(s, w.withColumn("video_id", F.col("window_id") % 3), _videos(spark, d)).select(
        "segment_id", "track_id", "t_start", "situation", "fps")


@query("J2_semi_joins", "SELECT segment_id, window_id, track_id FROM seg WHERE segment_id IN (SELECT segment_id FROM frames) AND segment_id IN (SELECT segment_id FROM rate WHERE rater='r1')")
def j2(spark, d):
    return rt.with_frames_and_labels(fx.seg(spark, d), fx.frames(spark, d), fx.rate(spark, d).where("rater = 'r1'"))


@query("J3_without_excluded", "SELECT segment_id, window_id, track_id FROM seg s WHERE NOT EXISTS (SELECT 1 FROM excluded e WHERE e.segment_id=s.segment_id)")
def j3(spark, d):
    return rt.without_excluded(fx.seg(spark, d), fx.excluded(spark, d))


@query("J4_without_skips", """SELECT r.segment_id, r.rater, r.score FROM ratings r JOIN seg s ON s.segment_id=r.segment_id
  WHERE NOT EXISTS (SELECT 1 FROM skips k WHERE k.window_id=s.window_id AND k.rater=r.rater)""")
def j4(spark, d):
    placed = fx.labels(spark, d).join(fx.seg(spark, d), "segment_id")
    return rt.without_skips(placed, fx.skips(spark, d)).select("segment_id", "rater", "score")


PROGRESS = """SELECT w.window_id, w.t_start, w.t_end, w.situation, count(s.segment_id) AS total, count(l.score) AS labelled, round(avg(l.score),6) AS score_mean,
  min(l.score) AS score_min, max(l.score) AS score_max, w.window_id IN (SELECT window_id FROM skips WHERE rater='r1') AS skipped
  FROM win w JOIN seg s ON s.window_id=w.window_id LEFT JOIN ratings l ON l.segment_id=s.segment_id AND l.rater='r1' GROUP BY 1,2,3,4"""


@query("J5_A22_window_progress", "SELECT * FROM prog", prog=PROGRESS)
def a22(spark, d):
    w, s, l, k, _ = _tables(spark, d)
    return rounded(rt.window_progress(w, s, l, k, "r1"))


@query("A22_unlabelled_windows", "SELECT * FROM prog WHERE NOT skipped AND labelled < total", prog=PROGRESS)
def a22_open(spark, d):
    w, s, l, k, _ = _tables(spark, d)
    return rounded(rt.window_progress(w, s, l, k, "r1", only_unlabelled=True))


UNFINISHED = """SELECT w.window_id, w.t_start, w.t_end, w.situation FROM win w WHERE NOT EXISTS (SELECT 1 FROM skips k WHERE k.rater='r1' AND k.window_id=w.window_id)
  AND EXISTS (SELECT 1 FROM seg s LEFT JOIN ratings l ON l.segment_id=s.segment_id AND l.rater='r1' WHERE s.window_id=w.window_id AND l.segment_id IS NULL
    AND NOT EXISTS (SELECT 1 FROM excluded e WHERE e.segment_id=s.segment_id))"""


@query("J6_unfinished_windows", UNFINISHED)
def j6(spark, d):
    w, s, l, k, e = _tables(spark, d)
    return rt.unfinished_windows(w, s, l, k, e, "r1")


@query("W22_next_unfinished_window", """SELECT window_id, t_start, t_end, situation FROM unf WHERE t_start >= 333 ORDER BY situation <> '話し合う', t_start, window_id LIMIT 1""", unf=UNFINISHED)
def w22(spark, d):
    w, s, l, k, e = _tables(spark, d)
    return rt.next_unfinished(w, rt.unfinished_windows(w, s, l, k, e, "r1"), 333.0, "話し合う")


SERIES = """SELECT w.window_id, w.t_start, w.t_end, n.rater, v.score, coalesce(v.n_labeled,0) AS n_labeled FROM win w CROSS JOIN (SELECT DISTINCT rater FROM ratings) n
  LEFT JOIN (SELECT s.window_id, l.rater, avg(l.score) AS score, count(*) AS n_labeled FROM ratings l JOIN seg s ON s.segment_id=l.segment_id
    WHERE NOT EXISTS (SELECT 1 FROM skips k WHERE k.window_id=s.window_id AND k.rater=l.rater) AND NOT EXISTS (SELECT 1 FROM excluded e WHERE e.segment_id=s.segment_id)
    GROUP BY 1,2) v ON v.window_id=w.window_id AND v.rater=n.rater"""


def _series(spark, d):
    return rt.rater_series(*_tables(spark, d))


@query("J7_A17_rater_series", "SELECT window_id, t_start, t_end, rater, round(score,6) AS score, n_labeled FROM ser", ser=SERIES)
def a17(spark, d):
    return rounded(_series(spark, d))


@query("W9_line_points", """SELECT rater, round((t_start+t_end)/120,6) AS x, round(score,6) AS score FROM ser WHERE n_labeled > 0
  UNION ALL SELECT rater, round((p+t_start)/120,6), NULL FROM (SELECT rater, t_start, lag(t_end) OVER (PARTITION BY rater ORDER BY t_start) AS p FROM ser WHERE n_labeled > 0) WHERE t_start > p + 1e-6""", ser=SERIES)
def w9(spark, d):
    return rounded(rt.line_points(_series(spark, d).where("n_labeled > 0"), ["rater"]))


@query("W10_smoothed_series", """SELECT rater, t_start, round(score,6) AS score, round(CASE WHEN score IS NOT NULL THEN avg(score) OVER (PARTITION BY rater, g, score IS NULL ORDER BY t_start ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END,6) AS smoothed
  FROM (SELECT *, count(*) FILTER (score IS NULL) OVER (PARTITION BY rater ORDER BY t_start) AS g FROM ser)""", ser=SERIES)
def w10(spark, d):
    smooth = rt.smooth_series(_series(spark, d), ["rater"], 5)
    return rounded(smooth.select("rater", "t_start", "score", "smoothed"))


PLACED = """SELECT l.rater, l.score, s.track_id, w.t_start, w.situation, w.window_id FROM ratings l JOIN seg s ON s.segment_id=l.segment_id JOIN win w ON w.window_id=s.window_id
  WHERE NOT EXISTS (SELECT 1 FROM skips k WHERE k.window_id=w.window_id AND k.rater=l.rater)"""


def _placed(spark, d):
    w, s, l, k, _ = _tables(spark, d)
    return rt.labels_in_windows(l, s, w, k)


@query("A18_rater_summary", "SELECT rater, count(*) AS n, round(avg(score),6) AS score_mean, min(score) AS score_min, max(score) AS score_max FROM ratings GROUP BY 1")
def a18(spark, d):
    return rounded(rt.rater_summary(fx.labels(spark, d)))


@query("A36_rater_label_range", "SELECT rater, count(*) AS n, min(score) AS score_min, max(score) AS score_max FROM ratings GROUP BY 1")
def a36(spark, d):
    return rt.rater_summary(fx.labels(spark, d)).drop("score_mean")


@query("A19_minute_heatmap", """SELECT b.rater, CAST(b.m AS INT) AS minute, coalesce(c.n,0) AS n, c.score_mean, CAST(floor((b.m-lo)/10.0) AS INT) AS grid_row, CAST((b.m-lo)%10 AS INT) AS grid_col FROM (
  SELECT rater, lo, unnest(range(lo, hi+1)) AS m FROM (SELECT rater, CAST(min(floor(t_start/60)) AS INT) AS lo, CAST(max(floor(t_start/60)) AS INT) AS hi FROM pl GROUP BY 1)) b
  LEFT JOIN (SELECT rater, floor(t_start/60) AS m, count(*) AS n, round(avg(score),6) AS score_mean FROM pl GROUP BY 1,2) c ON c.rater=b.rater AND c.m=b.m""", pl=PLACED)
def a19(spark, d):
    return rounded(rt.minute_heatmap(_placed(spark, d)))


HIST = ", ".join(f"count_if(score={i}) AS score_{i}" for i in range(1, 8))


@query("A20_person_stats", f"SELECT rater, track_id, count(*) AS n, round(avg(score),6) AS score_mean, min(score) AS score_min, max(score) AS score_max, {HIST} FROM pl GROUP BY 1,2", pl=PLACED)
def a20(spark, d):
    return rounded(rt.person_stats(_placed(spark, d)))


@query("A21_situation_cross", """SELECT rater, coalesce(CASE WHEN window_id % 9 > 0 THEN situation END, '(未設定)') AS situation, track_id, count(*) AS n, round(avg(score),6) AS score_mean FROM pl GROUP BY 1,2,3""", pl=PLACED)
def a21(spark, d):
    rows = _placed(spark, d).withColumn("situation", F.when(F.col("window_id") % 9 > 0, F.col("situation")))
    return rounded(rt.situation_cross(rows))


CONSENSUS = """SELECT segment_id, avg(score) AS mean_score, count(*) AS rater_count, stddev_pop(score) AS score_std, min(score) AS score_min, max(score) AS score_max FROM ratings GROUP BY 1"""


@query("A15_consensus", "SELECT segment_id, round(mean_score,6) AS mean_score, rater_count, round(score_std,6) AS score_std, score_min, score_max FROM con", con=CONSENSUS)
def a15(spark, d):
    return rounded(rt.consensus(fx.labels(spark, d)))


@query("A16_chosen_median", "SELECT segment_id, round(median(score),6) AS label FROM ratings WHERE rater IN ('r1','r2','r3') GROUP BY 1")
def a16(spark, d):
    return rounded(rt.chosen_scores(fx.labels(spark, d), ["r1", "r2", "r3"], "median"))


RLE = {
    "l0": """SELECT *, lag(coalesce(situation,'-')||CAST(situation_locked AS VARCHAR)) OVER (ORDER BY t_start) AS pc, lag(t_end) OVER (ORDER BY t_start) AS pe FROM lwin""",
    "l1": "SELECT *, sum(CASE WHEN pc IS NULL OR pc <> coalesce(situation,'-')||CAST(situation_locked AS VARCHAR) OR t_start > pe + 1e-4 THEN 1 ELSE 0 END) OVER (ORDER BY t_start) AS run FROM l0",
    "l2": "SELECT run, min(t_start) AS s, max(t_end) AS e FROM l1 GROUP BY 1",
    "l3": "SELECT run, k, s + k*CAST(12 AS DOUBLE) AS a, least(s + (k+1)*CAST(12 AS DOUBLE), e) AS b FROM (SELECT *, unnest(range(0, CAST(ceil((e-s-1e-6)/12) AS BIGINT))) AS k FROM l2)",
    "l4": """SELECT *, EXISTS (SELECT 1 FROM lwin w WHERE (w.t_start+w.t_end)/2 >= a AND (w.t_start+w.t_end)/2 < b) AS full_ FROM l3""",
    "l5": "SELECT *, sum(CASE WHEN full_ OR coalesce(abs(pb - a) >= 1e-4, true) THEN 1 ELSE 0 END) OVER (ORDER BY run, k) AS g FROM (SELECT *, lag(b) OVER (ORDER BY run, k) AS pb FROM l4)",
    "clip": "SELECT min(a) AS clip_start, max(b) AS clip_end FROM l5 GROUP BY g HAVING bool_or(full_)",
}


def _clips(spark, d):
    return cl.rating_clips(fx.locked_win(spark, d), [], 12.0)


@query("W7_rating_clips", "SELECT clip_start, clip_end FROM clip", **RLE)
def w7(spark, d):
    return _clips(spark, d)


INCLIP = """SELECT w.*, (w.t_start+w.t_end)/2 AS centre, c.clip_start, c.clip_end FROM lwin w JOIN clip c ON (w.t_start+w.t_end)/2 >= c.clip_start AND (w.t_start+w.t_end)/2 < c.clip_end"""


def _in_clips(spark, d):
    return cut_lineage(rt.windows_in_clips(fx.locked_win(spark, d), cut_lineage(_clips(spark, d)), [], 12.0))


@query("J8_windows_in_clips", "SELECT window_id, centre, clip_start, clip_end FROM inc", **RLE, inc=INCLIP)
def j8(spark, d):
    return _in_clips(spark, d).select("window_id", "centre", "clip_start", "clip_end")


@query("A23_clip_progress", """SELECT i.clip_start, i.clip_end, count(DISTINCT i.window_id) AS n_windows, count(s.segment_id) AS total, count(l.score) AS labelled, round(avg(l.score),6) AS score_mean, min(l.score) AS score_min, max(l.score) AS score_max,
  count(DISTINCT k.window_id) = count(DISTINCT i.window_id) AS skipped, count(DISTINCT k.window_id) < count(DISTINCT i.window_id) AND count_if(e.segment_id IS NULL AND l.score IS NOT NULL) < count_if(e.segment_id IS NULL AND s.segment_id IS NOT NULL) AS remaining
  FROM inc i LEFT JOIN seg s ON s.window_id=i.window_id LEFT JOIN ratings l ON l.segment_id=s.segment_id AND l.rater='r1' LEFT JOIN excluded e ON e.segment_id=s.segment_id
  LEFT JOIN (SELECT window_id FROM skips WHERE rater='r1') k ON k.window_id=i.window_id GROUP BY 1,2""", **RLE, inc=INCLIP)
def a23(spark, d):
    _, s, l, k, e = _tables(spark, d)
    return rounded(rt.clip_progress(_in_clips(spark, d), s, l, k, e, "r1", CLIP))


@query("A24_clip_situations", """SELECT clip_start, clip_end, CASE WHEN count(situation)=count(*) AND min(situation)=max(situation) THEN min(situation) END AS situation,
  CASE WHEN count(situation_set_by)=count(*) AND min(situation_set_by)=max(situation_set_by) THEN min(situation_set_by) END AS situation_set_by,
  bool_and(situation_locked) AND count(situation)=count(*) AND coalesce(min(situation)=max(situation), false) AS locked FROM inc GROUP BY 1,2""", **RLE, inc=INCLIP)
def a24(spark, d):
    return rt.clip_situations(_in_clips(spark, d), CLIP)


BLIND = """SELECT r.rater, s.segment_id, upper(substr(sha256(r.rater||':'||CAST(s.segment_id AS VARCHAR)||':classroom_engagement_v2'),1,12)) AS blind_code,
  row_number() OVER (PARTITION BY r.rater ORDER BY w.video_id, w.t_start, w.t_end, s.track_id, s.segment_id) AS display_order
  FROM seg s JOIN lwin w ON w.window_id=s.window_id CROSS JOIN (SELECT DISTINCT rater FROM ratings WHERE rater <> 'r2') r WHERE w.situation IS NOT NULL AND w.situation_locked"""


def _blind(spark, d):
    raters = fx.rate(spark, d).select("rater")
    # One rater has an order already and keeps it.
    have = raters.where("rater = 'r2'")
    return rt.blind_assignments(fx.locked_win(spark, d), fx.seg(spark, d), raters, have)


@query("W16_F7_blind_assignments", "SELECT rater, segment_id, blind_code, display_order FROM bl", bl=BLIND)
def w16(spark, d):
    return _blind(spark, d)


@query("W17_clip_blind_order", """SELECT i.clip_start, i.clip_end, b.rater, min(b.display_order) AS display_order FROM inc i JOIN seg s ON s.window_id=i.window_id JOIN bl b ON b.segment_id=s.segment_id GROUP BY 1,2,3""",
       **RLE, inc=INCLIP, bl=BLIND)
def w17(spark, d):
    return rt.clip_blind_order(_in_clips(spark, d), fx.seg(spark, d), _blind(spark, d), CLIP)


@query("W18_representative_segments", """SELECT clip_start, clip_end, track_id, segment_id, round(distance,6) AS distance FROM (SELECT i.clip_start, i.clip_end, s.track_id, s.segment_id, abs(i.centre-(i.clip_start+i.clip_end)/2) AS distance,
  row_number() OVER (PARTITION BY i.clip_start, i.clip_end, s.track_id ORDER BY abs(i.centre-(i.clip_start+i.clip_end)/2), s.segment_id) AS k FROM inc i JOIN seg s ON s.window_id=i.window_id) WHERE k=1""", **RLE, inc=INCLIP)
def w18(spark, d):
    return rounded(rt.representatives(_in_clips(spark, d), fx.seg(spark, d), CLIP))


@query("U4_clip_score_fan_out", f"""SELECT dataset_id, s.segment_id, 'r9' AS rater, CAST(1 + s.track_id % 7 AS BIGINT) AS score, i.clip_start AS source_clip_start, i.clip_end AS source_clip_end, i.clip_end-i.clip_start AS source_clip_sec FROM inc i JOIN seg s ON s.window_id=i.window_id, {TWO_STORES}""", **RLE, inc=INCLIP)
def u4(spark, d):
    placed = _in_clips(spark, d).join(fx.seg(spark, d), "window_id").select(*CLIP, "track_id", "segment_id")
    scores = placed.select(*CLIP, "track_id").distinct().select(
        *CLIP, "track_id", F.lit("r9").alias("rater"), (F.lit(1) + F.col("track_id") % 7).alias("score"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"))
    labels, observations = mu.fan_out_scores(fx.stores(scores), fx.stores(placed), CLIP, DS)
    return labels.join(observations.drop("updated_at"), [*DS, "segment_id", "rater"]).drop("updated_at")


@query("U5_rating_preconditions", """SELECT s.segment_id, CASE WHEN k.window_id IS NOT NULL THEN 'skipped' WHEN e.segment_id IS NOT NULL THEN 'excluded' WHEN w.situation IS NULL THEN 'situation unset' WHEN NOT w.situation_locked THEN 'situation unlocked' END AS verdict
  FROM seg s JOIN lwin w ON w.window_id=s.window_id LEFT JOIN skips k ON k.window_id=s.window_id LEFT JOIN excluded e ON e.segment_id=s.segment_id""")
def u5(spark, d):
    rows = fx.seg(spark, d).join(fx.locked_win(spark, d), "window_id")
    rows = rows.join(fx.skips(spark, d).select("window_id", F.lit(True).alias("k")), "window_id", "left")
    rows = rows.join(fx.excluded(spark, d).select("segment_id", F.lit(True).alias("e")), "segment_id", "left")
    no = F.lit(False)
    verdict = mu.rating_verdict(F.coalesce("k", no), F.coalesce("e", no), F.col("situation"), F.col("situation_locked"))
    return rows.select("segment_id", verdict.alias("verdict"))


@query("S10_label_export", """SELECT r.rater, r.segment_id, s.track_id, w.t_start, w.t_end, r.score, w.situation, CASE WHEN k.window_id IS NULL THEN 0 ELSE 1 END AS skipped_window
  FROM ratings r JOIN seg s ON s.segment_id=r.segment_id JOIN win w ON w.window_id=s.window_id LEFT JOIN skips k ON k.window_id=w.window_id AND k.rater=r.rater""")
def s10(spark, d):
    w, s, l, k, _ = _tables(spark, d)
    return rt.label_export(l, s, w, k)


@query("T2_latest_label_events", """SELECT rater, id, segment_id, new_score, CAST(k AS INT) AS position FROM (SELECT rater, l_suppkey*1000000000 + id0 AS id, segment_id, new_score, row_number() OVER (PARTITION BY rater ORDER BY l_suppkey*1000000000 + id0 DESC) AS k
  FROM (SELECT DISTINCT concat('r', CAST(l_linenumber AS VARCHAR)) AS rater, l_suppkey, l_orderkey AS id0, l_orderkey AS segment_id, 1 + (CAST(l_quantity AS INT)-1)%7 AS new_score, l_linenumber FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_linenumber, l_suppkey, l_orderkey ORDER BY l_quantity DESC) = 1)) WHERE k <= 60""")
def t2(spark, d):
    li = fx.table(spark, d, "lineitem").groupBy("l_linenumber", "l_suppkey", "l_orderkey").agg(F.max("l_quantity").alias("q"))
    events = li.select(
        F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("rater"),
        (F.col("l_suppkey") * 1000000000 + F.col("l_orderkey")).alias("id"), F.col("l_orderkey").alias("segment_id"),
        (F.lit(1) + (F.col("q").cast("int") - 1) % 7).alias("new_score"))
    return rt.latest_events(events, ["rater"])


# Merging: three stores, the labels of a supplier going to store supplier % 3.
STORES = """SELECT CAST(l_suppkey % 3 AS INT) AS source_order, l_partkey*100 + CAST(l_quantity AS INT) AS id, l_orderkey AS segment_id, concat('r', CAST(l_linenumber AS VARCHAR)) AS rater, 1 + (CAST(l_quantity AS INT)-1)%7 AS score FROM lineitem"""


def _stores(spark, d):
    q = F.col("l_quantity").cast("int")
    return fx.table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 3).cast("int").alias("source_order"), (F.col("l_partkey") * 100 + q).alias("id"),
        F.col("l_orderkey").alias("segment_id"), F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("rater"),
        (F.lit(1) + (q - 1) % 7).alias("score"))


@query("U6_merge_accepted", """SELECT segment_id, rater, min(score) AS score, min(source_order) AS source_order, count(*)-1 AS duplicates FROM sto GROUP BY 1,2 HAVING min(score)=max(score)""", sto=STORES)
def u6(spark, d):
    return mg.merge_labels(_stores(spark, d))[0]


@query("U6_merge_conflicts", "SELECT segment_id, rater FROM sto GROUP BY 1,2 HAVING min(score)<>max(score)", sto=STORES)
def u6_conflicts(spark, d):
    return mg.merge_labels(_stores(spark, d))[1]


@query("U9_merge_provenance", """SELECT source_order, CAST(sum(n) AS BIGINT) AS label_count, string_agg(rater, ',' ORDER BY rater) AS raters FROM (SELECT source_order, rater, count(*) AS n FROM (
  SELECT segment_id, rater, min(source_order) AS source_order FROM sto GROUP BY 1,2 HAVING min(score)=max(score)) GROUP BY 1,2) GROUP BY 1""", sto=STORES)
def u9(spark, d):
    return mg.provenance(mg.merge_labels(_stores(spark, d))[0])


NATURAL = """SELECT v.fps, w.t_start, w.t_end, s.track_id, min(s.segment_id) AS segment_id FROM seg s JOIN win w ON w.window_id=s.window_id JOIN vid v ON v.video_id=w.window_id % 3 GROUP BY 1,2,3,4"""


def _natural(spark, d, shift):
    s = fx.seg(spark, d).groupBy("window_id", "track_id").agg((F.min("segment_id") * (10 if shift else 1) + shift).alias("segment_id"))
    w = fx.win(spark, d).withColumn("video_id", F.col("window_id") % 3).withColumn("situation_locked", F.lit(True))
    return mg.segment_keys(s, w, _videos(spark, d))


@query("J12_natural_key_remap", "SELECT segment_id*10+7 AS source_segment, segment_id FROM nat", vid=VID, nat=NATURAL)
def j12(spark, d):
    return mg.remap(_natural(spark, d, 7), _natural(spark, d, 0))


@query("J13_topology_differences", """SELECT window_id, track_id, side FROM (SELECT DISTINCT window_id, track_id, 'source' AS side FROM seg WHERE segment_id IN (SELECT segment_id FROM excluded)
  AND (window_id, track_id) NOT IN (SELECT (window_id, track_id) FROM seg WHERE segment_id NOT IN (SELECT segment_id FROM excluded)))""")
def j13(spark, d):
    everything = fx.seg(spark, d)
    return mg.topology_differences(everything, rt.without_excluded(everything, fx.excluded(spark, d)), ["window_id", "track_id"])


@query("U7_merge_exclusions", """SELECT segment_id, coalesce(nullif(reason,''),'adult') AS reason, excluded_by FROM (SELECT l_orderkey AS segment_id, CASE WHEN l_suppkey%2=0 THEN '' ELSE l_returnflag END AS reason, concat('s', CAST(l_suppkey AS VARCHAR)) AS excluded_by,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey DESC, l_returnflag DESC) AS k FROM lineitem) WHERE k=1""")
def u7(spark, d):
    rows = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("segment_id"), "l_suppkey").agg(F.max("l_returnflag").alias("f"))
    return mg.merge_exclusions(rows.select(
        "segment_id", F.when(F.col("l_suppkey") % 2 == 0, "").otherwise(F.col("f")).alias("reason"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("excluded_by"), F.col("l_suppkey").alias("source_order")))


@query("U8_merge_observations", """SELECT segment_id, rater, source_clip_start, CAST(NULL AS DOUBLE) AS source_clip_end, CAST(NULL AS DOUBLE) AS source_clip_sec FROM (SELECT l_orderkey AS segment_id, concat('r', CAST(l_linenumber AS VARCHAR)) AS rater, max(l_quantity) AS source_clip_start,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey DESC) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber, l_suppkey) WHERE k=1""")
def u8(spark, d):
    rows = fx.table(spark, d, "lineitem").groupBy(
        F.col("l_orderkey").alias("segment_id"), F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("rater"),
        F.col("l_suppkey").alias("source_order")).agg(F.max("l_quantity").alias("source_clip_start"))
    return mg.merge_observations(rows).drop("updated_at")


@query("F8_new_sources", "SELECT sha256(text) AS source_sha256, min(doc_id) AS source_order FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0) GROUP BY 1")
def f8(spark, d):
    docs = fx.table(spark, d, "documents").select(
        F.sha2("text", 256).alias("source_sha256"), F.col("doc_id").alias("source_order"), F.col("source").alias("source_name"))
    done = docs.where(F.col("source_order") % 10 == 0).select("source_sha256")
    return mg.new_sources(docs, done).select("source_sha256", "source_order")


LEGACY = """SELECT o_orderkey AS segment_id, o_custkey % 3 AS video_id, CAST((o_orderkey % 500)*5 AS DOUBLE) AS t_start, CAST((o_orderkey % 500)*5+5 AS DOUBLE) AS t_end, o_orderpriority AS situation, o_custkey AS track_id FROM orders"""


@query("U11_legacy_windows", """SELECT l.video_id, l.t_start, max(l.situation) AS situation, count(*) AS n_segments, count(DISTINCT track_id) AS n_tracks, CAST(coalesce(max(k.n),0) AS BIGINT) AS n_skips FROM leg l
  LEFT JOIN (SELECT window_id, count(*) AS n FROM skips GROUP BY 1) k ON k.window_id*5 = l.t_start GROUP BY 1,2""", leg=LEGACY)
def u11(spark, d):
    start = (F.col("o_orderkey") % 500 * 5).cast("double")
    flat = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("segment_id"), (F.col("o_custkey") % 3).alias("video_id"), start.alias("t_start"), (start + 5).alias("t_end"),
        F.col("o_orderpriority").alias("situation"), F.col("o_custkey").alias("track_id"))
    old = fx.skips(spark, d).select("rater", (F.col("window_id") * 5).cast("double").alias("t_start"), (F.col("window_id") * 5 + 5).cast("double").alias("t_end"))
    windows, segments, skips = mg.normalise_legacy(flat, old)
    counts = segments.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_segments"), F.countDistinct("track_id").alias("n_tracks"))
    skipped = skips.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_skips"))
    out = windows.join(counts, "window_id").join(skipped, "window_id", "left")
    return out.select("video_id", "t_start", "situation", "n_segments", "n_tracks", F.coalesce("n_skips", F.lit(0)).alias("n_skips"))


@query("U1_union_of_stores", """SELECT source_order, count(*) AS n FROM (SELECT 0 AS source_order FROM orders UNION ALL SELECT 1 FROM lineitem) GROUP BY 1""")
def u1(spark, d):
    a = fx.seg(spark, d).withColumn("source_order", F.lit(0))
    b = fx.rate(spark, d).withColumn("source_order", F.lit(1))
    return a.unionByName(b, allowMissingColumns=True).groupBy("source_order").agg(F.count(F.lit(1)).alias("n"))


@query("U2_insert_or_ignore", """SELECT window_id, track_id, min(segment_id) AS segment_id FROM (SELECT *, min(segment_id) OVER (PARTITION BY window_id, track_id) AS first_, segment_id % 2 = 0 AS target FROM seg)
  WHERE target OR (window_id, track_id) NOT IN (SELECT (window_id, track_id) FROM seg WHERE segment_id % 2 = 0) GROUP BY window_id, track_id, CASE WHEN target THEN segment_id ELSE -1 END""")
def u2(spark, d):
    s = fx.seg(spark, d)
    return mu.insert_or_ignore(
        s.where("segment_id % 2 = 0"), s.where("segment_id % 2 <> 0"), ["window_id", "track_id"], ["segment_id"])


@query("U3_upsert_latest", """SELECT segment_id, rater, score, updated_at FROM ratings""")
def u3(spark, d):
    r = fx.rate(spark, d)
    old = r.where("segment_id % 2 = 0").groupBy("segment_id", "rater").agg(F.min(F.struct("updated_at", "score")).alias("v"))
    new = r.groupBy("segment_id", "rater").agg(F.max(F.struct("updated_at", "score")).alias("v"))
    columns = ["segment_id", "rater", "v.score", "v.updated_at"]
    return mu.upsert(old.select(*columns), new.select(*columns), ["segment_id", "rater"], ["updated_at"])


@query("U10_automatic_exclusions", f"""SELECT dataset_id, segment_id, CASE WHEN hand THEN 'adult' ELSE 'face_db:p1' END AS reason, CASE WHEN hand THEN 'teacher' ELSE 'face_recognition' END AS excluded_by FROM (
  SELECT o_orderkey AS segment_id, o_orderstatus='P' AND o_orderkey%2=0 AS hand, o_orderstatus='P' AND o_orderkey%2=1 AS auto, o_custkey % 3 AS v FROM orders), {TWO_STORES} WHERE hand OR v = 0 OR (auto AND v = 2)""")
def u10(spark, d):
    o = fx.table(spark, d, "orders")
    key = F.col("o_orderkey")
    current = o.where("o_orderstatus = 'P'").select(
        key.alias("segment_id"), F.when(key % 2 == 0, "adult").otherwise("face_db:p1").alias("reason"),
        F.when(key % 2 == 0, "teacher").otherwise(mu.AUTOMATIC).alias("excluded_by"))
    verdicts = o.where("o_custkey % 3 < 2").select(key.alias("segment_id"), (F.col("o_custkey") % 3 == 0).alias("excluded"), F.lit("p1").alias("name"))
    return mu.merge_automatic_exclusions(fx.stores(current), fx.stores(verdicts), DS)


@query("U12_set_situations", f"""SELECT dataset_id, window_id, CASE WHEN NOT situation_locked AND window_id%2=0 THEN '書く' ELSE situation END AS situation, NOT situation_locked AND window_id%2=0 AS changed, situation_locked AND window_id%2=0 AS refused FROM lwin, {TWO_STORES}""")
def u12(spark, d):
    w = fx.locked_win(spark, d)
    wanted = w.where("window_id % 2 = 0").select("window_id", F.lit("書く").alias("new_situation"), F.lit("t").alias("setter"))
    return mu.set_situation(fx.stores(w), fx.stores(wanted), DS).select(*DS, "window_id", "situation", "changed", "refused")


@query("U12_lock_stores", """SELECT 'a' AS dataset_id, window_id, situation_locked FROM lwin UNION ALL SELECT 'b', window_id, true FROM lwin WHERE window_id % 13 <> 0""")
def u12_locks(spark, d):
    # Store a has windows without a situation and stays as it is; store b has none.
    w = fx.stores(fx.locked_win(spark, d)).where("dataset_id = 'a' OR window_id % 13 <> 0")
    return mu.set_locks(w, True, DS).select(*DS, "window_id", "situation_locked")


@query("U14_delete_rater", "SELECT segment_id, rater, score FROM ratings WHERE rater <> 'r1' UNION ALL SELECT window_id, rater, NULL FROM skips WHERE rater <> 'r1'")
def u14_rater(spark, d):
    left = mu.delete_rater({"labels": fx.labels(spark, d), "skips": fx.skips(spark, d)}, "r1")
    skips = left["skips"].select(F.col("window_id").alias("segment_id"), "rater")
    return left["labels"].select("segment_id", "rater", "score").unionByName(skips, allowMissingColumns=True)


@query("U13_metadata_upsert", """SELECT dataset_id, school_id, phase FROM (SELECT c_mktsegment AS dataset_id, c_nationkey AS school_id, CASE WHEN c_custkey%2=0 THEN 'pre' ELSE 'post' END AS phase, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey DESC) AS k FROM customer) WHERE k=1""")
def u13(spark, d):
    c = fx.table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("dataset_id"), F.col("c_nationkey").alias("school_id"),
        F.when(F.col("c_custkey") % 2 == 0, "pre").otherwise("post").alias("phase"), F.col("c_custkey").alias("version"))
    return mu.upsert(c.where("version < 100"), c.where("version >= 100"), ["dataset_id"], ["version"]).drop("version")


@query("U14_delete_window_labels", """SELECT segment_id, rater, score FROM ratings r WHERE NOT (rater='r1' AND segment_id IN (SELECT segment_id FROM seg WHERE window_id % 5 = 0))""")
def u14(spark, d):
    doomed = fx.seg(spark, d).where("window_id % 5 = 0").select("segment_id", F.lit("r1").alias("rater"))
    return mu.delete_labels(fx.labels(spark, d), doomed).select("segment_id", "rater", "score")


@query("U14_undo_delete", "SELECT segment_id, rater, score FROM ratings")
def u14_undo(spark, d):
    labels = fx.labels(spark, d)
    doomed = fx.seg(spark, d).where("window_id % 5 = 0").select("segment_id", F.lit("r1").alias("rater"))
    before = labels.join(doomed, ["segment_id", "rater"], "left_semi")
    return mu.undo(mu.delete_labels(labels, doomed), before).select("segment_id", "rater", "score")


@query("U15_append_runs", "SELECT variant, seed, fold, epoch FROM runs")
def u15(spark, d):
    r = fx.runs(spark, d).select("variant", "seed", "fold", "epoch")
    return mu.append_runs(r.where("epoch < 15"), r.where("epoch >= 12"), ("variant", "seed", "fold", "epoch"))[0]


@query("U15_refused_runs", "SELECT variant, seed, fold, epoch FROM runs WHERE epoch BETWEEN 12 AND 14")
def u15_refused(spark, d):
    r = fx.runs(spark, d).select("variant", "seed", "fold", "epoch")
    return mu.append_runs(r.where("epoch < 15"), r.where("epoch >= 12"), ("variant", "seed", "fold", "epoch"))[1]


@query("J17_orphans", "SELECT segment_id, rater, score FROM rate WHERE segment_id NOT IN (SELECT segment_id FROM excluded)")
def j17(spark, d):
    return ql.orphans(fx.rate(spark, d).select("segment_id", "rater", "score"), fx.excluded(spark, d), ["segment_id"])


REQUIRED = ["videos", "windows", "segments", "labels"]
WANTED = [(t, f.split()[0]) for t in REQUIRED for f in DDL[t].split(", ") if f.split()[0] != "dataset_id"]


# Every fifth lesson's store has no labels, and every seventh one lacks the windows' lock.
@query("Q1_schema_gaps", """SELECT dataset_id, t AS "table", CASE WHEN day % 5 = 0 AND t = 'labels' THEN NULL ELSE c END AS "column" FROM sto, want
  WHERE (day % 5 = 0 AND t = 'labels' AND c = 'score') OR (day % 7 = 0 AND t = 'windows' AND c = 'situation_locked')""",
       sto="SELECT DISTINCT video_path AS dataset_id, CAST(substr(video_path, 8, 2) AS INT) AS day FROM pred",
       want="SELECT unnest(" + str([list(w) for w in WANTED]) + ") AS p, p[1] AS t, p[2] AS c")
def q1(spark, d):
    day = F.substring("dataset_id", 8, 2).cast("int")
    found = fx.pred(spark, d).select(F.col("video_path").alias("dataset_id")).distinct().select(
        "dataset_id", F.inline(F.array(*[F.struct(F.lit(t).alias("table"), F.lit(c).alias("column")) for t, c in WANTED])))
    gone = ((day % 5 == 0) & (F.col("table") == "labels")) | ((day % 7 == 0) & (F.col("table") == "windows") & (F.col("column") == "situation_locked"))
    return ql.schema_report(found.where(~gone), REQUIRED)


@query("Q2_rule_violations", """SELECT 'score in 1..7' AS rule, count_if(NOT (score BETWEEN 1 AND 7)) AS violations FROM (SELECT l_quantity - 20 AS score FROM lineitem) UNION ALL SELECT 'rater not blank', 0""")
def q2(spark, d):
    rows = fx.table(spark, d, "lineitem").select((F.col("l_quantity") - 20).alias("score"), F.col("l_returnflag").alias("rater"))
    return ql.rule_counts(rows, ql.label_rules())


@query("Q3_duplicate_keys", "SELECT segment_id, rater, count(*) AS n FROM rate GROUP BY 1,2 HAVING count(*) > 1")
def q3(spark, d):
    return ql.duplicate_keys(fx.rate(spark, d), ["segment_id", "rater"])


@query("Q4_metadata_rules", """SELECT 'no blank ids' AS rule, 0 AS violations UNION ALL SELECT 'phase known', count_if(o_orderstatus NOT IN ('O','F')) FROM orders UNION ALL SELECT 'role known', 0
  UNION ALL SELECT 'minutes given after intervention', count_if(o_orderstatus='F' AND o_orderkey%3=0) FROM orders""")
def q4(spark, d):
    s = F.col("o_orderstatus")
    rows = fx.table(spark, d, "orders").select(
        F.lit("a").alias("school_id"), F.lit("b").alias("grade"), F.lit("c").alias("class_id"), F.col("o_orderpriority").alias("session_id"),
        F.when(s == "O", "pre").when(s == "F", "post").otherwise("?").alias("intervention_phase"), F.lit("trial").alias("study_role"),
        F.when(F.col("o_orderkey") % 3 > 0, 1.0).alias("minutes_since_intervention"))
    return ql.rule_counts(rows, ql.metadata_rules())


@query("Q5_release_gate", f"SELECT dataset_id, count(*) AS windows, count_if(situation IS NULL OR situation_set_by IS NULL OR NOT situation_locked) AS pending FROM lwin, {TWO_STORES} GROUP BY 1")
def q5(spark, d):
    return ql.release_gate(fx.stores(fx.locked_win(spark, d)), DS)


ASSETS = """SELECT *, CASE WHEN sk = 1 THEN NULL WHEN l_partkey % 4 = 0 THEN '/data/x/assets/crops/'||nm WHEN l_partkey % 4 = 1 THEN '/data/x/data/assets/crops/'||nm END AS resolved FROM (
  SELECT DISTINCT l_partkey, l_suppkey % 3 AS sk, concat('P', CAST(l_partkey AS VARCHAR), '_s', CAST(l_suppkey % 3 AS VARCHAR), '.jpg') AS nm FROM lineitem)"""


def _assets(spark, d):
    from lessonlens.functions.text import asset_candidates
    rows = fx.frames(spark, d).select("crop_path").distinct()
    number = F.regexp_extract("crop_path", r"P(\d+)_", 1).cast("int")
    files = rows.where(~F.col("crop_path").contains("_s1")).select(F.when(
        number % 4 == 0, F.concat(F.lit("/data/x/assets/crops/"), F.element_at(F.split("crop_path", "/"), -1))).when(
        number % 4 == 1, F.concat(F.lit("/data/x/"), F.col("crop_path"))).alias("path")).where("path IS NOT NULL")
    listed = rows.withColumn("candidates", asset_candidates(F.col("crop_path"), F.lit("/data/x"), F.lit("/data/x/db")))
    return ql.first_existing(listed, files, "candidates", ["crop_path"])


@query("F6_resolved_assets", "SELECT 'data/assets/crops/'||nm AS crop_path, resolved FROM ast", ast=ASSETS)
def f6(spark, d):
    return _assets(spark, d)


@query("Q7_missing_assets", """SELECT count(*) AS missing, (SELECT list(p ORDER BY p) FROM (SELECT 'data/assets/crops/'||nm AS p FROM ast WHERE resolved IS NULL ORDER BY 1 LIMIT 10)) AS examples FROM ast WHERE resolved IS NULL""", ast=ASSETS)
def q7(spark, d):
    return ql.missing_assets(_assets(spark, d), "crop_path")


@query("S11_labelling_extract", f"""SELECT dataset_id, source, packaged, n FROM {TWO_STORES}, (SELECT crop_path AS source, CASE WHEN crop_path = first_value(crop_path) OVER (PARTITION BY nm ORDER BY fid, crop_path) THEN nm0 ELSE concat('sf', CAST(fid AS VARCHAR), '_', nm0) END AS packaged, n FROM (
  SELECT crop_path, lower(regexp_extract(crop_path, '[^/]*$')) AS nm, regexp_extract(crop_path, '[^/]*$') AS nm0, min(fid) AS fid, count(*) AS n FROM (
    SELECT concat(CASE WHEN l_suppkey % 2 = 0 THEN 'a/P' ELSE 'b/p' END, CAST(l_partkey AS VARCHAR), '.jpg') AS crop_path, l_orderkey*10+l_linenumber AS fid FROM lineitem) GROUP BY 1,2,3))""")
def s11(spark, d):
    from lessonlens.operators import packaging
    rows = fx.table(spark, d, "lineitem").select(
        F.concat(F.when(F.col("l_suppkey") % 2 == 0, "a/P").otherwise("b/p"), F.col("l_partkey").cast("string"), F.lit(".jpg")).alias("crop_path"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    rows = fx.stores(rows)
    names = packaging.packaged_names(rows, "crop_path", "id", DS)
    return rows.join(names, [*DS, "crop_path"]).groupBy(*DS, F.col("crop_path").alias("source"), "packaged").agg(F.count(F.lit(1)).alias("n"))
