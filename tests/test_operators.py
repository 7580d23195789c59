"""Micro-tables, and properties checked against plain restatements of the rules."""

import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lessonlens.operators import (
    agreement as ag, clips as cl, identity as idn, intervention as iv, joins, linking as ln, merging as mg, mutations as mu,
    quality as ql, ranks, ratings as rt, resample as rs, rollups as ru, scans, segments as sg, training as tr)
from lessonlens.sources import predictions as pr


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# Ranks

@pytest.mark.parametrize("n, expected", [(10, 5.5), (9, 5.0)])
def test_trimmed_mean(rows, n, expected):
    df = rows([(float(i),) for i in range(1, n + 1)], "v double")
    assert ranks.group_stats(df, [], "v", m=ranks.trimmed_mean(0.1)).first().m == expected


@pytest.mark.parametrize("per_bucket", [2, 40, 10**6])
def test_ranks_match_plain_statistics(rows, per_bucket):
    rng = random.Random(3)
    data = [(g, round(rng.gauss(0, 3), 2)) for g in "abc" for _ in range({"a": 300, "b": 7, "c": 1}[g])]
    data += [("a", 1.0)] * 150
    df = rows(data, "g string, v double")
    out = {r.g: r for r in ranks.group_stats(
        df, ["g"], "v", per_bucket, mid=ranks.median(), q=ranks.quantile(0.9), up=ranks.upper_median(), t=ranks.trimmed_mean(0.1),
        sd=ranks.deviation(0.0), mean=ranks.mean(), low=ranks.share_at_most(0.0)).collect()}
    for g in "abc":
        v = sorted(x for k, x in data if k == g)
        cut = math.floor(len(v) * 0.1)
        pos = 0.9 * (len(v) - 1)
        assert out[g].mid == pytest.approx(statistics.median(v)) and out[g].up == v[len(v) // 2]
        assert out[g].t == pytest.approx(statistics.mean(v[cut:len(v) - cut])) and out[g].mean == pytest.approx(statistics.mean(v))
        assert out[g].q == pytest.approx(v[math.floor(pos)] + (v[math.ceil(pos)] - v[math.floor(pos)]) * (pos - math.floor(pos)))
        assert out[g].low == pytest.approx(sum(x <= 0 for x in v) / len(v))
        assert (out[g].sd is None) if len(v) == 1 else out[g].sd == pytest.approx(statistics.stdev(v))


def test_overall_stats_of_empty_log(rows):
    log = rows([], "t double, track_id bigint, score double, score_clamped int")
    r = ru.overall_stats(log).first()
    assert r.n_rows == 0 and r.n_tracks == 0 and r.score_mean is None and r.score_p50 is None


# Scans: the answer may not depend on where chunks are cut.

def _walk(seed=5, n=200):
    rng = random.Random(seed)
    t, out = 0.0, []
    for i in range(n):
        t += rng.choice([0.1, 0.5, 1.0, 40.0])
        out.append(("k" if i % 7 else "h", round(t, 3), float(rng.randint(1, 7)) if rng.random() > 0.2 else None, i))
    return out


@pytest.mark.parametrize("width", [0.5, 10.0, 1e6])
def test_scans_do_not_depend_on_chunks(rows, width):
    data = _walk()
    df = rows(data, "k string, t double, v double, i int")
    chunk = scans.time_chunk("t", width)
    near = {(r.k, r.i): r for r in scans.neighbours(df, ["k"], ["t"], ["i"], chunk).collect()}
    total = {(r.k, r.i): r.s for r in scans.running_total(df, ["k"], ["t"], F.coalesce("v", F.lit(0.0)), "s", chunk).collect()}
    top = {(r.k, r.i): r.m for r in scans.running_max(df, ["k"], ["t"], F.col("v"), "m", chunk).collect()}
    sides = {(r.k, r.i): r for r in scans.fill_sides(df, ["k"], ["t"], F.col("v"), chunk).collect()}
    for key in "kh":
        mine = [r for r in data if r[0] == key]
        for j, (_, _t, v, i) in enumerate(mine):
            prev, nxt = near[(key, i)].prev_row, near[(key, i)].next_row
            assert (prev.i if prev else None) == (mine[j - 1][3] if j else None)
            assert (nxt.i if nxt else None) == (mine[j + 1][3] if j + 1 < len(mine) else None)
            assert total[(key, i)] == pytest.approx(sum(r[2] or 0.0 for r in mine[:j + 1]))
            earlier = [r[2] for r in mine[:j] if r[2] is not None]
            assert top[(key, i)] == (max(earlier) if earlier else None)
            seen = [r[2] for r in mine[:j + 1] if r[2] is not None]
            later = [r[2] for r in mine[j:] if r[2] is not None]
            assert sides[(key, i)].before == (seen[-1] if seen else None) and sides[(key, i)].after == (later[0] if later else None)


@pytest.mark.parametrize("alpha", [0.01, 0.3, 0.97, 1.0])
def test_exponential_average(rows, alpha, monkeypatch):
    data = [(k, t, v if v is not None else 2.0, i) for k, t, v, i in _walk(n=300)]
    df = rows(data, "k string, t double, v double, i int")
    out = {(r.k, r.i): r.s for r in scans.exponential_average(df, ["k"], ["t"], {"s": "v"}, alpha, scans.time_chunk("t", 20.0)).collect()}
    state = {}
    for k, _t, v, i in data:
        state[k] = v if k not in state else (1 - alpha) * state[k] + alpha * v
        assert out[(k, i)] == pytest.approx(state[k], rel=1e-9)


def test_moving_mean_across_blocks(rows):
    vals = [float(i * i % 11) for i in range(50)]
    df = rows([(i + 1, v) for i, v in enumerate(vals)], "i int, v double")
    out = [r.m for r in scans.moving_mean(df, [], "i", "v", "m", 3, block=5).orderBy("i").collect()]
    for i, m in enumerate(out):
        part = vals[max(0, i - 3):i + 4]
        assert m == pytest.approx(sum(part) / len(part))


# Segments

def test_segments_micro(rows):
    det = rows([(1, i * 0.5) for i in range(21)] + [(2, float(i)) for i in range(6)], "track_id int, t double")
    out = values(sg.build_segments(det, ["track_id"], 5.0, 5.0, 0.6), "track_id", "t_start", "t_end", "n_detections")
    assert out == [(1, 0.0, 5.0, 11), (1, 5.0, 10.0, 11), (2, 0.0, 5.0, 6)]
    sparse = rows([(1, i * 1.25) for i in range(5)], "track_id int, t double")
    assert sg.build_segments(sparse, ["track_id"]).count() == 0


@pytest.mark.parametrize("window, step, ratio", [(5.0, 5.0, 0.6), (4.0, 1.5, 0.3), (2.0, 7.0, 0.1)])
def test_segments_against_restatement(rows, window, step, ratio):
    rng = random.Random(11)
    times = {k: sorted({round(rng.uniform(0, 60), 2) for _ in range(n)}) for k, n in ((1, 200), (2, 40), (3, 2), (4, 1))}
    df = rows([(k, t) for k, ts in times.items() for t in ts], "track_id int, t double")
    want, need = [], max(1, int(window * 2 * ratio))
    for k, ts in times.items():
        i = 0
        while ts[0] + i * step + window <= ts[-1] + 1e-6:
            s = ts[0] + i * step
            c = sum(s <= t <= s + window for t in ts)
            if c >= need:
                want.append((k, s, s + window, c))
            i += 1
    assert values(sg.build_segments(df, ["track_id"], window, step, ratio), "track_id", "t_start", "t_end", "n_detections") == sorted(want)


@pytest.mark.parametrize("width", [0.7, 1000.0])
def test_nearest_in_time_against_brute_force(rows, width):
    rng = random.Random(2)
    det = [(k, round(rng.uniform(0, 30), 1), i) for i in range(150) for k in [rng.choice("ab")]]
    smp = [(k, round(rng.uniform(-5, 40), 2), j) for j in range(80) for k in [rng.choice("abc")]] + [("a", 3.0, 900), ("a", 3.0, 900)]
    out = joins.nearest_in_time(
        rows(smp, "k string, s double, j int"), rows(det, "k string, t double, id int"), ["k"], "s", "t", ["id"], width)
    want = []
    for k, s, j in smp:
        mine = [(abs(t - s), t, i) for kk, t, i in det if kk == k]
        if mine:
            want.append((k, j, min(mine, key=lambda m: (round(m[0], 9), m[1], m[2]))[2]))
    got = sorted((r.k, r.j, r.hit.id) for r in out.collect())
    assert got == sorted(want)


@pytest.mark.parametrize("n, expected", [(4, [0, 1, 2, 3, 3, 3, 3, 3, 3, 3]), (19, list(range(0, 19, 2))), (10, list(range(10)))])
def test_uniform_positions(spark, n, expected):
    assert spark.range(1).select(sg.uniform_positions(F.lit(n), 10)).first()[0] == expected


def test_contiguous_positions_stay_inside(rows):
    df = rows([(i, 30) for i in range(50)], "k int, n int")
    for (p,) in df.select(sg.contiguous_positions(F.col("n"), 10, 7, F.col("k"))).collect():
        assert p == list(range(p[0], p[0] + 10)) and 0 <= p[0] <= 20


def test_rate_limit_greedy(rows):
    rng = random.Random(8)
    data = [(k, i, round(t, 2)) for k in "ab" for i, t in enumerate(sorted(rng.uniform(0, 40) for _ in range(120)))]
    out = values(sg.rate_limited(rows(data, "k string, frame_idx int, t double"), ["k"], 0.9, 5.0), "k", "t")
    want, last = [], {}
    for k, _i, t in data:
        if k not in last or t - last[k] >= 0.9 - 1e-9:
            want.append((k, t))
            last[k] = t
    assert out == sorted(want)


def test_interval_join_with_long_intervals(rows):
    pts = [("a", float(i)) for i in range(50)]
    ivs = [("a", 3.0, 3.5, 1), ("a", 0.0, 49.0, 2), ("a", 10.0, 10.0, 3), ("b", 0.0, 99.0, 4)]
    out = joins.interval_join(rows(pts, "k string, t double"), rows(ivs, "k string, s double, e double, id int"), ["k"], "t", "s", "e", 4.0)
    assert values(out, "t", "id") == sorted([(3.0, 1)] + [(float(i), 2) for i in range(49)])


@pytest.mark.parametrize("limit", [500, 1])
def test_substring_matches_at_any_block_count(rows, monkeypatch, limit):
    monkeypatch.setattr(joins, "FILTER_BLOCKS", limit)
    names = rows([("x/lesson_1.mp4",), ("x/other.mp4",)], "v string")
    filters = rows([("lesson", 1), (None, 2), ("zzz", 3), ("", 4)], "f string, id int")
    out = joins.substring_matches(names, "v", filters, "f")
    assert values(out, "v", "id") == [("x/lesson_1.mp4", 1), ("x/lesson_1.mp4", 2), ("x/lesson_1.mp4", 4), ("x/other.mp4", 2), ("x/other.mp4", 4)]


def test_three_video_filters_differ(rows):
    df = rows([("a.b_c",), ("aXbYc",), ("A.B_C",), (None,)], "v string")
    pick = lambda c: [r.v for r in df.where(c).collect()]
    assert pick(pr.matches_regex(F.col("v"), "a.b")) == ["a.b_c", "aXbYc"]
    assert pick(pr.contains_text(F.col("v"), "a.b")) == ["a.b_c"]
    assert pick(pr.like_text(F.col("v"), F.lit("b_c"))) == ["a.b_c", "aXbYc", "A.B_C"]


# Situations, runs and events

def test_situation_spans(rows):
    df = rows([(0.0, "A"), (1.0, "A"), (2.0, "B"), (3.0, "B")], "x double, situation string")
    assert values(ru.situation_spans(df, []), "span_start", "span_end", "situation") == [(0.0, 2.0, "A"), (2.0, 4.0, "B")]


def test_ab_runs(rows):
    log = rows([("v", t, True) for t in (0.0, 1.0, 2.0, 30.0, 31.0)] + [("v", 10.0, False), ("w", 5.0, True)], "video_path string, t double, is_ab boolean")
    out = values(iv.inferred_runs(log, 7.0), "video_path", "ab_start_sec", "ab_end_sec")
    assert out == [("v", 0.0, 3.0), ("v", 30.0, 32.0), ("w", 5.0, 5.0 + 2.0 / 3.0)]


def test_event_precedence(rows):
    log = rows([("v1", 1.0, True), ("v2", 1.0, False)], "video_path string, t double, is_ab boolean")
    ddl = "video_path string, start_sec double, end_sec double, situation string"
    over = rows([(None, 5.0, 9.0, "AB"), ("v1", 5.0, 9.0, "AB"), ("v2", 3.0, 3.0, "AB"), ("v2", 1.0, 2.0, "x")], ddl)
    assert [r.event_source for r in iv.resolve_events(log, over, (1.0, 2.0)).collect()] == ["explicit"] * 2
    assert values(iv.resolve_events(log, over), "event_id", "video_path", "ab_start_sec") == [("AB001", "v1", 5.0), ("AB002", "v2", 5.0)]
    assert values(iv.resolve_events(log, over.where("false")), "event_id", "event_source") == [("AB001", "prediction rows")]


def test_phases(spark):
    design = iv.Design(50.0, 0.0, 50.0, 5.0)
    times = [49.0, 50.0, 99.9, 100.0, 200.0, 210.0, 259.0, 260.0]
    df = spark.createDataFrame([(t,) for t in times], "t double")
    out = [r[0] for r in df.select(iv.phase_of(F.col("t"), F.lit(100.0), F.lit(200.0), design, 10.0)).collect()]
    assert out == ["outside", "pre", "pre", "AB", "cooldown", "post", "post", "outside"]


def test_course_agrees_between_one_and_many_cooldowns(rows):
    rng = random.Random(4)
    log = rows([("v", rng.uniform(0, 400), rng.randint(1, 5), rng.uniform(1, 7), 4.0, rng.choice(["聞く", "書く"]), False, 0.5) for _ in range(400)],
               "video_path string, t double, track_id int, score double, score_clamped double, base_situation string, is_ab boolean, situation_confidence double")
    events = iv.number_events(iv.explicit_events(rows([("v",)], "video_path string"), 100.0, 150.0))
    many = iv.event_course(log, events, iv.Design(80.0, 5.0, 60.0, 10.0, cooldowns=(0.0, 17.0, 60.0)))
    for c in (0.0, 17.0, 60.0):
        single = iv.event_course(log, events, iv.Design(80.0, 5.0, 60.0, 10.0, cooldowns=(c,)))
        cols = ("phase", "relative_bin", "base_situation", "n_tracks")
        assert values(many.where(F.col("cooldown_sec") == c), *cols) == values(single, *cols)
        a = [r.score_trimmed_mean for r in many.where(F.col("cooldown_sec") == c).orderBy(*cols).collect()]
        assert a == pytest.approx([r.score_trimmed_mean for r in single.orderBy(*cols).collect()])


def test_track_in_two_situations_counts_once_for_all(rows):
    log = rows([("v", 101.0, 1, 2.0, 2.0, "聞く", False, None), ("v", 102.0, 1, 4.0, 4.0, "書く", False, None)],
               "video_path string, t double, track_id int, score double, score_clamped double, base_situation string, is_ab boolean, situation_confidence double")
    events = iv.number_events(iv.explicit_events(rows([("v",)], "video_path string"), 100.0, 150.0))
    out = iv.event_course(log, events, iv.Design(min_tracks=1, bin_sec=50.0)).where("base_situation = 'ALL'").first()
    assert out.n_tracks == 1 and out.score_mean == 3.0 and out.score_std == 1.0


def test_standardised_effect(rows):
    ddl = "cooldown_sec double, event_id string, video_path string, phase string, base_situation string, quality_ok boolean, score_trimmed_mean double, n_tracks int, situation_confidence double"
    def b(phase, sit, score):
        return (0.0, "AB001", "v", phase, sit, True, score, 5, None)
    course = rows([b("pre", "聞く", 4.0)] * 3 + [b("pre", "書く", 2.0), b("post", "聞く", 5.0), b("post", "話し合う", 7.0), b("pre", "ALL", 4.0), b("post", "ALL", 6.0)], ddl)
    r = iv.effect_table(course, iv.situation_summary(course)).first()
    assert (r.pre_weight_coverage, r.effect_standardized, r.shared_situations, r.effect_unadjusted) == (0.75, 1.0, "聞く", 2.0)


def test_stamp_latest_wins(rows):
    log = rows([("a", float(t)) for t in range(6)] + [("b", 2.0)], "video_path string, t double")
    ivs = rows([(1, None, 0.0, 4.0, "AB", "n"), (2, "A", 2.0, 3.0, "X", "m"), (3, "zzz", 0.0, 9.0, "Y", None)],
               "id int, video_filter string, start_sec double, end_sec double, situation string, note string")
    out = {(r.video_path, r.t): r.situation_override for r in iv.stamp_overrides(log, ivs).collect()}
    assert out == {("a", 0.0): "AB", ("a", 1.0): "AB", ("a", 2.0): "X", ("a", 3.0): "AB", ("a", 4.0): None, ("a", 5.0): None, ("b", 2.0): "AB"}


# Bootstrap

def test_resample_is_the_same_in_any_layout_and_unbiased(rows):
    rng = random.Random(1)
    data = [(i, rng.uniform(0, 10)) for i in range(60)]
    df = rows(data, "u int, v double")
    one = rs.resample_totals(df, [], ["u"], ["v"], 400, 7)
    again = rs.resample_totals(df.repartition(5), [], ["u"], ["v"], 400, 7)
    assert values(one, "replicate", "v") == values(again, "replicate", "v")
    chunked = rs.resample_totals(df, [], ["u"], ["v"], 400, 7, chunk_units=13)
    assert {r.draws for r in chunked.collect()} == {60} and chunked.count() == 400
    mean, sd = statistics.mean(v for _, v in data), statistics.pstdev(v for _, v in data) / math.sqrt(60)
    for totals in (one, chunked):
        means = [r.v / r.draws for r in totals.collect()]
        assert statistics.mean(means) == pytest.approx(mean, abs=4 * sd / math.sqrt(400))
        assert statistics.stdev(means) == pytest.approx(sd, rel=0.2)


def test_mean_interval_edge_cases(rows):
    df = rows([("a", 1, 2.0), ("b", 1, 1.0), ("b", 2, 3.0), ("b", 3, float("nan")), ("b", 4, None)], "g string, u int, v double")
    out = {r.g: r for r in rs.mean_interval(df, ["g"], ["u"], "v", 300, 1).collect()}
    assert out["a"].n == 1 and out["a"].ci95_low is None and out["b"].n == 2 and out["b"].mean == 2.0
    assert out["b"].ci95_low == 1.0 and out["b"].ci95_high == 3.0
    assert rs.mean_interval(df, ["g"], ["u"], "v", 0, 1).where("ci95_low IS NOT NULL").count() == 0


def test_bias_shift_needs_both_phases(rows):
    df = rows([("s1", "pre", 3.0, 4.0), ("s1", "post", 3.0, 6.0), ("s2", "pre", 3.0, 4.0), ("s2", "post", 3.0, 6.0)],
              "school_id string, phase string, human_score double, model_score double")
    r = iv.bias_shift(df, 50).first()
    assert (r.post_minus_pre_bias, r.ci95_low, r.ci95_high) == (2.0, 2.0, 2.0)


# Ratings

def test_smoothing_never_bridges(rows):
    df = rows([("r", float(i), v) for i, v in enumerate([1.0, 2.0, None, 4.0, 6.0])], "rater string, t_start double, score double")
    out = [r.smoothed for r in rt.smooth_series(df, ["rater"], 3, chunk_width=2.0).orderBy("t_start").collect()]
    assert out == [1.5, 1.5, None, 5.0, 5.0]
    with pytest.raises(ValueError):
        rt.smooth_series(df, ["rater"], 2)


def test_line_points_gap(rows):
    df = rows([("r", 0.0, 5.0, 1.0), ("r", 5.0, 10.0, 2.0), ("r", 20.0, 25.0, 3.0)], "rater string, t_start double, t_end double, score double")
    out = {r.x: r.score for r in rt.line_points(df, ["rater"]).collect()}
    assert out[15.0 / 60.0] is None and len(out) == 4


def test_consensus(rows):
    df = rows([(1, "a", 3), (1, "b", 5)], "segment_id int, rater string, score int")
    r = rt.consensus(df).first()
    assert (r.mean_score, r.rater_count, r.score_std, r.score_min, r.score_max) == (4.0, 2, 1.0, 3, 5)


def test_rater_series_keeps_unlabelled_windows(rows):
    w = rows([(1, 0.0, 5.0), (2, 5.0, 10.0)], "window_id int, t_start double, t_end double")
    s = rows([(10, 1, 7), (20, 2, 7)], "segment_id int, window_id int, track_id int")
    l = rows([(10, "a", 4)], "segment_id int, rater string, score int")
    none_s, none_e = rows([], "window_id int, rater string"), rows([], "segment_id int")
    out = {(r.window_id, r.rater): (r.score, r.n_labeled) for r in rt.rater_series(w, s, l, none_s, none_e).collect()}
    assert out == {(1, "a"): (4.0, 1), (2, "a"): (None, 0)}


def test_blind_assignments_are_kept(rows):
    w = rows([(1, 1, 5.0, 10.0, "聞く", True), (2, 1, 0.0, 5.0, "聞く", True), (3, 1, 9.0, 14.0, None, True), (4, 1, 9.0, 14.0, "聞く", False)],
             "window_id int, video_id int, t_start double, t_end double, situation string, situation_locked boolean")
    s = rows([(10, 1, 7), (20, 2, 7), (30, 3, 7), (40, 4, 7)], "segment_id int, window_id int, track_id int")
    out = rt.blind_assignments(w, s, rows([(" a ",), ("b",), (" ",)], "rater string"), rows([("b",)], "rater string"))
    assert values(out, "rater", "display_order", "segment_id") == [("a", 1, 20), ("a", 2, 10)]
    assert all(len(r.blind_code) == 12 and r.blind_code == r.blind_code.upper() for r in out.collect())


def plain_clips(windows, longest):
    """The clip rules over one video's windows in order, in passes over whole lists."""
    from itertools import accumulate, groupby

    middles = [(s + e) / 2 for s, e, _ in windows]
    # Pass 1: number the runs; a window joins the run before it when it touches that run and shares its context.
    number, reach = [0], windows[0][1]
    links = [False]
    for (s, e, context), (_, _, context_before) in zip(windows[1:], windows):
        touches = s <= reach + 1e-4
        new = not (touches and context == context_before)
        number.append(number[-1] + new)
        reach = e if new else max(reach, e)
        if new:
            links.append(touches)
    members = [[i for i, _ in g] for _, g in groupby(enumerate(number), key=lambda p: p[1])]
    ends = [max(windows[i][1] for i in m) for m in members]
    # Pass 2: starts, moved to the middle of two centres where runs touch, never before the start of the run they close.
    def move(start, k):
        first = members[k][0]
        if not links[k]:
            return windows[first][0]
        return max(start, min((middles[first - 1] + middles[first]) / 2, max(ends[k - 1], windows[first][1])))

    starts = list(accumulate(range(1, len(members)), move, initial=windows[0][0]))
    stops = [starts[k + 1] if k + 1 < len(members) and links[k + 1] else ends[k] for k in range(len(members))]
    # Pass 3: pieces of the allowed length, then empty ones glued to the left or dropped.
    pieces = [
        (a + longest * j, min(a + longest * (j + 1), b))
        for a, b in zip(starts, stops) for j in range(max(0, math.ceil((b - 1e-6 - a) / longest)))]
    full = [any(a <= m < b for m in middles) for a, b in pieces]
    glued = [not f and k > 0 and abs(pieces[k - 1][1] - pieces[k][0]) < 1e-4 for k, f in enumerate(full)]
    heads = list(accumulate(not g for g in glued))
    groups = [[i for i, _ in g] for _, g in groupby(enumerate(heads), key=lambda p: p[1])]
    return [(pieces[g[0]][0], pieces[g[-1]][1]) for g in groups if full[g[0]]]


def test_clips_micro(rows):
    ddl = "window_id int, t_start double, t_end double, situation string, situation_locked boolean"
    w = rows([(1, 0.0, 5.0, "A", True), (2, 5.0, 10.0, "A", True), (3, 10.0, 15.0, "B", True)], ddl)
    assert values(cl.rating_clips(w, [], 15.0), "clip_start", "clip_end") == [(0.0, 10.0), (10.0, 15.0)]
    assert cl.rating_clips(w, [], 0.0).count() == 3


@pytest.mark.parametrize("seed", range(6))
def test_clips_against_restatement(rows, seed):
    rng = random.Random(seed)
    data = []
    for video in ("v", "w"):
        t = 0.0
        for _ in range(60):
            t = round(t + rng.choice([0.0, 0.5, 2.5, 5.0, 5.0, 9.0]), 3)
            data.append((video, len(data), t, t + rng.choice([5.0, 5.0, 4.0]), rng.choice(["A", "A", "A", "B", None]), rng.random() > 0.1))
    df = rows(data, "video_id string, window_id int, t_start double, t_end double, situation string, situation_locked boolean")
    longest = rng.choice([4.0, 7.0, 12.0])
    want = []
    for video in ("v", "w"):
        mine = sorted((r for r in data if r[0] == video), key=lambda r: (r[2], r[3], r[1]))
        want += [(video, round(a, 6), round(b, 6)) for a, b in plain_clips([(r[2], r[3], (r[4], r[5])) for r in mine], longest)]
    got = sorted((r.video_id, round(r.clip_start, 6), round(r.clip_end, 6)) for r in cl.rating_clips(df, ["video_id"], longest).collect())
    assert got == sorted(want)


# Merging and changes

def test_merge_duplicate_and_conflict(rows):
    ddl = "source_order int, id int, segment_id int, rater string, score int"
    same = rows([(0, 1, 1, "a", 4), (1, 1, 1, " a", 4), (1, 2, 2, "a", 5)], ddl)
    out = mg.checked_merge(same)
    assert values(out, "segment_id", "rater", "score", "source_order", "duplicates") == [(1, "a", 4, 0, 1), (2, "a", 5, 1, 0)]
    with pytest.raises(ValueError, match="conflicting"):
        mg.checked_merge(rows([(0, 1, 1, "a", 4), (1, 1, 1, "a", 5)], ddl))
    with pytest.raises(ValueError, match="blank"):
        mg.checked_merge(rows([(0, 1, 1, " ", 4)], ddl))


def test_merge_is_idempotent(rows):
    ddl = "source_order int, id int, segment_id int, rater string, score int"
    once = mg.checked_merge(rows([(0, 1, 1, "a", 4), (1, 2, 2, "b", 5)], ddl))
    again = once.select("source_order", F.lit(1).alias("id"), "segment_id", "rater", "score")
    assert values(mg.checked_merge(again.unionByName(again)), "segment_id", "rater", "score") == values(once, "segment_id", "rater", "score")


def test_automatic_exclusion_spares_manual_rows(rows):
    current = rows([(1, "adult", "teacher"), (2, "face_db:x", "face_recognition"), (3, "face_db:x", "face_recognition")],
                   "segment_id int, reason string, excluded_by string")
    verdicts = rows([(1, False, None), (2, False, None), (3, True, "y"), (4, True, None), (5, False, None)], "segment_id int, excluded boolean, name string")
    out = values(mu.merge_automatic_exclusions(current, verdicts), "segment_id", "reason", "excluded_by")
    assert out == [(1, "adult", "teacher"), (3, "face_db:y", "face_recognition"), (4, "face_db:unknown", "face_recognition")]


def test_toggle_exclusion(rows):
    ddl = "segment_id int, reason string, excluded_by string"
    chosen = rows([(0.0, 1), (0.0, 2)], "clip_start double, segment_id int")
    part = mu.toggle_exclusion(rows([(1, "x", "t"), (9, "x", "t")], ddl), chosen, ["clip_start"], "me")
    assert values(part, "segment_id", "excluded_by") == [(1, "me"), (2, "me"), (9, "t")]
    assert values(mu.toggle_exclusion(part, chosen, ["clip_start"], "me"), "segment_id") == [(9,)]


def test_lock_needs_complete_situations(rows):
    ddl = "window_id int, situation string, situation_set_by string, situation_locked boolean"
    assert mu.set_locks(rows([(1, "A", "t", False), (2, None, None, False)], ddl), True).where("situation_locked").count() == 0
    assert mu.set_locks(rows([(1, "A", "t", False)], ddl), True).where("situation_locked").count() == 1
    assert mu.set_locks(rows([(1, "A", "t", True)], ddl), False).where("situation_locked").count() == 0


def test_delete_rater_and_replace_runs(rows):
    tables = {"labels": rows([(1, "a"), (2, "b")], "segment_id int, rater string")}
    assert values(mu.delete_rater(tables, "a")["labels"], "segment_id") == [(2,)]
    ddl = "variant string, seed int, fold int, epoch int"
    out = mu.replace_runs(rows([("x", 1, None, 3), ("y", 1, 0, 4)], ddl), rows([("x", 1, None, 9)], ddl))
    assert values(out, "variant", "epoch") == [("x", 9), ("y", 4)]


def test_legacy_skips_with_and_without_video(rows):
    flat = rows([(1, 1, 0.0, 5.0, "A", 7), (2, 2, 0.0, 5.0, "B", 7)], "segment_id int, video_id int, t_start double, t_end double, situation string, track_id int")
    no_video = rows([("r", 0.0, 5.0)], "rater string, t_start double, t_end double")
    assert mg.normalise_legacy(flat, no_video)[2].count() == 2
    assert mg.normalise_legacy(flat, no_video.withColumn("video_id", F.lit(1)))[2].count() == 1


def test_source_reimport(rows):
    src = rows([("h1", 0, "a"), ("h1", 1, "b"), ("h2", 2, "c")], "source_sha256 string, source_order int, source_name string")
    assert values(mg.new_sources(src, rows([("h2",)], "source_sha256 string")), "source_name") == [("a",)]


# Agreement

def test_kappa(rows):
    df = rows([(1, 1), (3, 3), (7, 7)], "a int, b int")
    k = ag.weighted_kappa(F.col("a"), F.col("b"))
    assert df.agg(k).first()[0] == 1.0
    assert rows([(3, 3), (3, 3)], "a int, b int").agg(k).first()[0] == 0.0
    assert rows([], "a int, b int").agg(k).first()[0] is None


def test_spearman_constant(rows):
    df = rows([(1.0, 2.0), (2.0, 2.0)], "a double, b double")
    assert ag.spearman(df, [], "a", "b").first().spearman is None
    assert ag.spearman(df, [], "a", "b", constant=0.0).first().spearman == 0.0


def test_evaluation_of_perfect_scores(rows):
    df = rows([(1.0, 1.0), (2.0, 2.0), (5.0, 5.0)], "y double, p double")
    r = ag.evaluation_metrics(df, [], "y", "p").first()
    assert (r.mae, r.r2, r.exact_accuracy, r.quadratic_weighted_kappa) == (0.0, 1.0, 1.0, 1.0)
    assert r.spearman == pytest.approx(1.0) and r.weighted_f1 == 1.0


def test_training_metrics_floor_and_nonfinite(rows):
    df = rows([(3.0, 3.0), (3.0, float("nan")), (float("inf"), 2.0)], "y double, p double")
    r = ag.training_metrics(df, [], "y", "p").first()
    assert (r.nonfinite_pred, r.nonfinite_target, r.mse, r.r2, r.qwk) == (1, 1, 0.0, 1.0, 0.0)


# Training sets

def test_split_is_disjoint_and_stable(rows):
    items = rows([(i, f"g{i % 17}") for i in range(200)], "segment_id int, g string")
    a = tr.split_by_group(items, F.col("g"), 5, 0.3)
    assert values(a, "segment_id", "split") == values(tr.split_by_group(items.repartition(7), F.col("g"), 5, 0.3), "segment_id", "split")
    assert tr.leaks(a, ["g"]).count() == 0
    assert a.where("split = 'validation'").select("g").distinct().count() == round(17 * 0.3)
    assert values(tr.split_by_group(items, F.col("g"), no_validation=True), "split")[0] == ("train",)


def test_split_errors(rows):
    items = rows([(1, "g")], "segment_id int, g string")
    with pytest.raises(ValueError, match="at least 2"):
        tr.split_by_group(items, F.col("g"))
    with pytest.raises(ValueError, match="at least 2"):
        tr.split_by_group(items, F.col("g"), holdouts=["g"])
    with pytest.raises(ValueError, match="unknown"):
        tr.split_by_group(rows([(1, "g"), (2, "i")], "segment_id int, g string"), F.col("g"), holdouts=["h"])


def test_class_weights(rows):
    df = rows([(1.0,)] * 1 + [(2.0,)] * 100, "label double")
    out = {r["class"]: (r["count"], r.weight) for r in tr.class_weights(df).collect()}
    mean = (1 * 1 + 100 * 0.1) / 101
    assert out[1] == (1, 3.0) and out[2] == (100, pytest.approx(0.1 / mean)) and out[7] == (0, 0.0)


def test_cv_summary(rows):
    ddl = "variant string, seed int, fold int, epoch int, val_exact_accuracy double, val_mae double, val_qwk double"
    out = {r.variant: r for r in tr.cv_summary(rows([("a", 1, 0, 3, 0.5, 1.0, 0.1), ("a", 1, 1, 6, 0.7, 1.0, 0.1), ("b", 1, 0, 2, 0.6, 0.9, 0.2)], ddl)).collect()}
    assert out["a"].recommended_epochs == 5 and out["b"].std_exact_accuracy == 0.0 and out["a"].fold_best_epochs == [3, 6]
    assert out["b"].selected and not out["a"].selected


def test_examples_flip_whole_sequences(spark):
    d = "/root/testdata/sf0.001"
    from lessonlens.plans.agreement_queries import _items, _pose_frames
    plain = tr.training_examples(_pose_frames(spark, d), _items(spark, d), 10).select("segment_id", "poses")
    flipped = tr.training_examples(_pose_frames(spark, d), _items(spark, d), 10, flip_seed=3).select("segment_id", "poses")
    a, b = {r.segment_id: r.poses for r in plain.collect()}, {r.segment_id: r.poses for r in flipped.collect()}
    coins = {r.segment_id: r.f for r in plain.select("segment_id", tr.flips(F.col("segment_id"), 3).alias("f")).collect()}
    for k in a:
        assert len(b[k]) == 10
        for p, q in zip(a[k], b[k]):
            assert q[0].x == pytest.approx(-p[0].x if coins[k] else p[0].x)


def test_baseline_model(rows):
    from pyspark.ml.functions import array_to_vector
    rng = random.Random(0)
    data = [(i, [float(y) + rng.gauss(0, 0.1), float(i % 3)], ["聞く", "書く", "話し合う"][i % 3], float(y)) for i in range(210) for y in [1 + i % 7]]
    df = rows(data, "id int, f array<double>, situation string, label double").withColumn("vector", array_to_vector("f"))
    models = tr.fit_baseline(df)
    out = tr.apply_baseline(df, models)
    r = out.agg(F.corr("label", "pred_score").alias("c"), F.min("pred_score").alias("lo"), F.max("pred_score").alias("hi"),
                F.avg((F.col("situation") == F.col("predicted_situation")).cast("int")).alias("acc")).first()
    assert r.c > 0.9 and 1.0 <= r.lo and r.hi <= 7.0 and r.acc > 0.9


# Identities and linking

def test_face_votes(rows):
    data = [(1, i, n) for i, n in enumerate(["X", "X", None, None])] + [(2, i, n) for i, n in enumerate(["X", None, None])]
    data += [(3, i, n) for i, n in enumerate(["B", "A", "A", "B"])] + [(4, 0, None)]
    out = values(idn.face_votes(rows(data, "s int, i int, matched_name string"), ["s"], "i"), "s", "name", "matches", "ratio", "excluded")
    assert [o for o in out if o[0] != 4] == [(1, "X", 2, 0.5, True), (2, "X", 1, pytest.approx(1 / 3), False), (3, "B", 2, 0.5, True)]
    assert [o[1:] for o in out if o[0] == 4] == [(None, 0, 0.0, False)]


def test_nearest_identity_whatever_the_blocks(rows):
    """The nearest of all people, ties to the first name, however people and faces are cut; far blocks are passed over."""
    import numpy as np
    rng = random.Random(6)
    groups = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    near = lambda g, s: [x + rng.gauss(0, s) for x in g]
    names = [(f"n{i:02d}", near(groups[i % 6], 0.1)) for i in range(90)] + [("n90", [1.0] * 8), ("n89b", [2.0] * 8)]
    seen = [(i, near(groups[i % 6], 0.3)) for i in range(57)] + [(57, [1.0] * 8), (58, [-3.0, 0.0, 1.0, 5.0, 0.0, 0.0, 0.0, 0.1])]
    people, faces = rows(names, "name string, emb array<double>"), rows(seen, "face_id int, emb array<double>")
    unit = np.array([v for _, v in names]) / np.linalg.norm([v for _, v in names], axis=1, keepdims=True)
    want = {}
    for i, v in seen:
        scores = unit @ np.array(v)
        top = scores.max()
        want[i] = (min(n for (n, _), x in zip(names, scores) if x > top - 1e-12), top)
    for block_people, block_faces in ((10**6, 10**6), (9, 10), (1, 57)):
        got = {r.face_id: (r.matched_name, r.similarity) for r in idn.nearest_identity(faces, people, -1e9, block_people, block_faces).collect()}
        assert got.keys() == want.keys() and all(got[i][0] == n and got[i][1] == pytest.approx(x) for i, (n, x) in want.items())
    blocks = idn.people_blocks(people, 9)
    visits = [len(r.centres) for r in idn.visited_blocks(faces, blocks).collect()]
    assert min(visits) >= 1 and sum(visits) < 0.8 * len(visits) * len(blocks.centres)
    assert idn.nearest_identity(faces, people.where("false")).where("matched_name IS NOT NULL").count() == 0


def _plain_links(dets, rules):
    """Restatement: open tracks keep their last box; each box asks for its cheapest track and the cheapest asks win."""
    tracks, new, out = {}, 1, {}
    for frame in sorted({d[0] for d in dets}):
        tracks = {k: v for k, v in tracks.items() if frame - v[1] <= rules.max_age}
        asks, boxes = [], sorted(d[1:] for d in dets if d[0] == frame)
        for det, *b in boxes:
            best = None
            for sid, (a, _f) in tracks.items():
                inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
                size = lambda q: (q[2] - q[0]) * (q[3] - q[1])
                iou = inter / max(1e-6, size(a) + size(b) - inter)
                if iou >= rules.iou_min:
                    gap = math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2) / rules.centre_norm
                    cost = 2.5 * (1 - iou) + gap + 1.6 + 0.7
                    if best is None or cost < best[0]:
                        best = (cost, sid)
            if best:
                asks.append((best[0], det, best[1]))
        won = {}
        for _c, det, sid in sorted(asks, key=lambda a: a[0]):
            if sid not in won.values():
                won[det] = sid
        for det, *b in boxes:
            if det not in won:
                won[det], new = new, new + 1
            tracks[won[det]] = (b, frame)
            out[det] = won[det]
    return out


@pytest.mark.parametrize("page", [2, 10000])
def test_linking_is_cut_only_at_pauses(spark, rows, page):
    rng = random.Random(9)
    dets, frame, n = [], 0, 0
    for _ in range(60):
        frame += rng.choice([1, 1, 1, 2, 30])
        for person in range(3):
            x = person * 60 + frame * 0.4 % 50 + rng.uniform(-4, 4)
            dets.append((frame, n, x, 0.0, x + 50, 100.0))
            n += 1
    df = rows([("v", *d) for d in dets], "video_path string, frame_idx bigint, det_id bigint, x1 double, y1 double, x2 double, y2 double")
    rules = ln.LinkRules(max_age=10)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, page)
    try:
        got = {r.det_id: r.stable_id for r in ln.link_detections(df, rules, 25.0).collect()}
    finally:
        spark.conf.set(setting, before)
    assert got == _plain_links(dets, rules)


def test_a_frame_goes_to_the_cheapest_asks():
    rules = ln.LinkRules(max_age=5)
    boxes = np.array([[0.0, 0, 50, 100], [2.0, 0, 52, 100]])
    ids, tracks = ln.link_frame(ln.OpenTracks(), 0, boxes, [[1.0, 0.0], [0.0, 1.0]], [[], None], rules)
    assert ids.tolist() == [1, 2]
    # poses outweigh the boxes; a third box and one with a missing corner begin tracks
    more = np.array([[2.0, 0, 52, 100], [0.0, 0, 50, 100], [1.0, 0, 51, 100], [np.nan, 0, 1, 1]])
    ids, tracks = ln.link_frame(tracks, 1, more, [[1.0, 0.0], [0.0, 1.0], [], None], [[]] * 4, rules)
    assert ids.tolist() == [1, 2, 3, 4] and tracks.ids.tolist() == [1, 2, 3, 4] and tracks.next_id == 5
    ids, tracks = ln.link_frame(tracks, 20, boxes[:1], [[1.0, 0.0]], [[]], rules)
    assert ids.tolist() == [5] and tracks.ids.tolist() == [5]
    ids, tracks = ln.link_frame(tracks, 21, boxes[:0], [], [], rules)
    assert len(ids) == 0 and tracks.ids.tolist() == [5]


def test_vector_gaps():
    a, b = [[3.0, 4.0], [], [1.0], None], [[4.0, 3.0], None, [2.0]]
    assert ln.vector_gaps(a, b, ln._cosine_gaps).round(3).tolist() == [[0.04, 1, 1], [1, 1, 1], [1, 1, 0], [1, 1, 1]]
    assert ln.vector_gaps(a, b, ln._mean_gaps).tolist() == [[1, 1, 1], [1, 1, 1], [1, 1, 1], [1, 1, 1]]


def test_stepwise_links_equal_those_of_the_batch():
    import json
    from lessonlens.streaming import steps
    rng = random.Random(4)
    dets = [(frame, 4 * frame + k, 60.0 * k + rng.uniform(-20, 20), 0.0) for frame in range(40) for k in range(3)]
    dets = [(f, i, x, y, x + 50, y + 100) for f, i, x, y in dets]
    rules = ln.LinkRules(max_age=3.0)
    step, state, got = steps.stable_ids(rules), None, {}
    for frame in range(40):
        here = [dict(zip(("det_id", "x1", "y1", "x2", "y2"), d[1:])) for d in dets if d[0] == frame]
        state, out = step(state, {"t": float(frame), "dets": here})
        state = json.loads(json.dumps(state))
        got |= {q["det_id"]: q["stable_id"] for q in out["links"]}
    assert got == _plain_links(dets, rules)


# Quality

def test_quality_reports(rows):
    gaps = ql.schema_gaps({"labels": rows([], "segment_id int, rater string")}, ["labels", "videos"])
    assert gaps["videos"] == ["<table>"] and "score" in gaps["labels"]
    meta = rows([("s", " ", "c", "x", "post", "trial", None), ("s", "1", "c", "x", "normal", "development", None)],
                "school_id string, grade string, class_id string, session_id string, intervention_phase string, study_role string, minutes_since_intervention double")
    assert {r.rule: r.violations for r in ql.rule_counts(meta, ql.metadata_rules()).collect()} == {
        "no blank ids": 1, "phase known": 0, "role known": 0, "minutes given after intervention": 1}
    with pytest.raises(ValueError):
        ql.require_empty(meta, "rows left")


def test_row_and_sequence_motion_features_agree(spark):
    from lessonlens.functions import pose
    from lessonlens.plans.agreement_queries import _pose_frames
    frames = _pose_frames(spark, "/root/testdata/sf0.001").where("segment_id < 3")
    rows_ = {r.frame_idx: r.features for r in sg.motion_feature_rows(frames, 7.0).collect()}
    seq = frames.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("t", "frame_idx", "kpts"))).alias("s"))
    for r in seq.select("s.frame_idx", pose.motion_features(F.transform("s", lambda q: q.kpts)).alias("f")).collect():
        for k, f in zip(r.frame_idx, r.f):
            assert rows_[k] == pytest.approx(f)


def test_running_total_over_two_levels(rows):
    data = [(i % 3, float(i % 17), i) for i in range(300)]
    df = rows(data, "k int, t double, i int")
    chunks = [scans.time_chunk("t", 5.0), scans.time_chunk("t", 1.0)]
    out = {r.i: r.n for r in scans.row_index(df, ["k"], ["t", "i"], "n", chunks).collect()}
    for k in range(3):
        mine = sorted((t, i) for kk, t, i in data if kk == k)
        assert [out[i] for _t, i in mine] == list(range(1, len(mine) + 1))


@pytest.mark.parametrize("per_bucket", [3, 10**6])
def test_overall_quantiles(rows, per_bucket):
    rng = random.Random(12)
    v = sorted([round(rng.gauss(0, 5), 1) for _ in range(331)] + [2.0] * 200)
    r = ranks.overall_quantiles(rows([(x,) for x in v], "v double"), "v", per_bucket, a=0.1, b=0.5, c=1.0).first()
    pos = 0.1 * (len(v) - 1)
    assert r.a == pytest.approx(v[math.floor(pos)] + (v[math.ceil(pos)] - v[math.floor(pos)]) * (pos % 1))
    assert r.b == statistics.median(v) and r.c == v[-1]
    assert ranks.overall_quantiles(rows([], "v double"), "v", a=0.5).first().a is None


def test_one_key_with_a_third_of_all_rows(spark):
    """The hot track's rows are spread: no partition of the rank windows holds them all."""
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000 + 1).alias("k"), (1 + F.rand(1) * 6).alias("v"))
    local = ranks.value_ranks(df, ["k"], "v").where("k = 0")
    assert local.count() == 10000
    r = ranks.group_stats(df, ["k"], "v", m=ranks.median()).where("k = 0").first()
    assert r.m == pytest.approx(sorted(x.v for x in df.where("k = 0").collect())[4999], abs=0.01)


def test_values_close_together_are_spread(spark):
    """A million distinct values within 0.003, one key's among them: no bucket has more than a few times the rows asked for."""
    df = spark.range(1_000_000).select((F.col("id") % 3).alias("k"), (3.0 + F.col("id") * 3e-9).alias("v"))
    borders = ranks._borders(df, "v", 20_000)
    sizes = df.groupBy(ranks._bucket(F.col("v"), borders).alias("b")).count().collect()
    assert len(sizes) >= 50 and max(r["count"] for r in sizes) <= 40_000
    r = ranks.group_stats(df, ["k"], "v", 20_000, m=ranks.median(), n=F.max("n")).where("k = 0").first()
    assert r.n == 333_334 and r.m == pytest.approx(3.0 + 3e-9 * 499_999.5, abs=1e-12)


def test_buckets_know_every_value(rows):
    values_ = [float("-inf"), -1e300, -0.0, 0.0, 0.1, 2.5, 1e300, float("inf"), float("nan")]
    out = rows([(v,) for v in values_], "v double").select(ranks._bucket(F.col("v"), [-1.0, 0.0, 0.1, 2.5, 3.0])).collect()
    assert [r[0] for r in out] == [0, 0, 2, 2, 3, 4, 5, 5, 5]


def test_rows_are_numbered_by_ranges(spark):
    """Names with a long common beginning fall into many ranges, and numbers are whole."""
    names = spark.range(5000).select(F.concat(F.lit("lesson_of_the_school_in_the_town_"), F.lpad(F.expr("pmod(hash(id), 100000)").cast("string"), 6, "0")).alias("name"), "id")
    got = scans.number_rows(names, ["name", "id"], "n").collect()
    assert [r.n for r in sorted(got, key=lambda r: (r.name, r.id))] == list(range(1, 5001))
    assert scans.number_rows(names.where("id < 0"), ["name"], "n").collect() == []
    assert names.repartitionByRange(8, "name").select(F.spark_partition_id().alias("p")).groupBy("p").count().where("count > 1500").isEmpty()


@pytest.mark.parametrize("width", [None, 1.0, 3.7, 1e6])
def test_limiter_follows_pointers(rows, width):
    """The limiter equals the plain one whatever the chunks; bursts, ties, pauses and NULL keys included."""
    rng = random.Random(8)
    data = [(k, i, round(rng.uniform(0, 60) // 20 * 30 + rng.uniform(0, 14), 1)) for k in ("a", "b", None) for i in range(400)]
    data += [("c", 0, -2.5), ("c", 1, -2.0), ("c", 2, -1.2), ("d", 0, 1.0)]
    got = values(sg.rate_limited(rows(data, "k string, frame_idx int, t double"), ["k"], 0.9, width).fillna("none"), "k", "frame_idx", "t")
    want, last = [], {}
    for k, i, t in sorted(data, key=lambda r: (r[2], r[1])):
        if k not in last or t - last[k] >= 0.9 - 1e-9:
            last[k] = t
            want.append((k or "none", i, t))
    assert got == sorted(want)


@pytest.mark.parametrize("alpha", [0.5, 1.0])
def test_averages_pass_over_nulls(rows, alpha):
    data = [("a", float(i), v) for i, v in enumerate([None, 4.0, None, 8.0, None, None, 2.0])]
    df = rows(data, "k string, t double, v double")
    got = scans.exponential_average(df, ["k"], ["t"], {"s": "v"}, alpha, scans.time_chunk("t", 2.0)).orderBy("t").collect()
    want, last = [], None
    for _, _, v in data:
        last = last if v is None else v if last is None else (1 - alpha) * last + alpha * v
        want.append(last)
    assert [r["s"] for r in got] == want


def test_tracks_without_score_count(rows):
    log = rows([("x", 1, float(t), None if t % 2 else 3.0, 3, 0.5) for t in range(12)] + [("x", 2, 1.0, None, None, 0.1)],
               "situation string, track_id long, t double, score double, score_clamped int, situation_confidence double")
    from lessonlens.operators import rollups

    track = rollups.by_track(log, 10).collect()
    assert [(r["n"], r["t_min"], r["t_max"], r["score_mean"]) for r in track] == [(12, 0.0, 11.0, 3.0)]
    one = rollups.timeseries_binned(log, 100.0).collect()[0]
    assert (one["n_tracks"], one["score_mean"], one["low_score_ratio"]) == (2, 3.0, 0.5)


def test_like_filter_is_literal_but_for_wildcards(rows):
    from lessonlens.sources.predictions import like_text

    df = rows([(r"C:\Lesson!1.MP4", r"c:\lesson!1"), ("abc", "A_C"), ("abc", "x"), ("É", "é"), ("abc", None)], "p string, f string")
    assert [r[0] for r in df.select(like_text(df.p, df.f)).collect()] == [True, True, False, False, True]


def test_logits_of_any_length(rows):
    from lessonlens.functions.probs import monotone_logits

    df = rows([([0.0] * 70,), ([1.0],), ([],)], "v array<double>")
    assert [len(r[0]) for r in df.select(monotone_logits(df.v)).collect()] == [70, 1, 0]


def test_stores_are_not_mixed(rows):
    """Two stores with the same ids keep their own sequences, locks and exclusions."""
    from lessonlens.operators import segments as sg
    ds = ["dataset_id"]
    frames = rows([("a", 1, 0.0, 1), ("a", 1, 1.0, 2), ("b", 1, 0.5, 1)], "dataset_id string, segment_id int, t double, frame_idx int")
    built = {r.dataset_id: (r.n_frames, [f.t for f in r.sequence]) for r in sg.assemble(frames, 2, ["t"], ds=ds).collect()}
    assert built == {"a": (2, [0.0, 1.0]), "b": (1, [0.5, 0.5])}
    windows = rows([("a", 1, "A", "t", False), ("b", 1, None, None, False)],
                   "dataset_id string, window_id int, situation string, situation_set_by string, situation_locked boolean")
    assert {r.dataset_id: r.situation_locked for r in mu.set_locks(windows, True, ds).collect()} == {"a": True, "b": False}
    chosen = rows([("a", 0.0, 1), ("b", 0.0, 1)], "dataset_id string, clip_start double, segment_id int")
    current = rows([("a", 1, "x", "t")], "dataset_id string, segment_id int, reason string, excluded_by string")
    assert values(mu.toggle_exclusion(current, chosen, ["clip_start"], "me", ds), "dataset_id", "segment_id") == [("b", 1)]


def test_resample_does_not_depend_on_the_cut_into_tasks(rows):
    """The tree of draws is the same whether one task holds it or many, and every replicate draws as many units as there are."""
    rng = random.Random(2)
    data = [(k, i, rng.uniform(0, 10), 1.0) for k, n in (("a", 3000), ("b", 700), ("c", 1)) for i in range(n)]
    df = rows(data, "k string, u int, v double, w double")
    runs = []
    for chunk in (256, 500, 10**6):
        out = rs.resample_totals(df, ["k"], ["k", "u"], ["v", "w"], 60, 7, chunk_units=chunk).collect()
        assert len(out) == 180 and all(r.draws == {"a": 3000, "b": 700, "c": 1}[r.k] == round(r.w) for r in out)
        runs.append({(r.k, r.replicate): r.v for r in out})
    for other in runs[1:]:
        assert other.keys() == runs[0].keys() and all(other[k] == pytest.approx(v, rel=1e-12) for k, v in runs[0].items())
    for k, n in (("a", 3000), ("b", 700)):
        v = [x for kk, _, x, _ in data if kk == k]
        means = [t / n for (kk, _), t in runs[0].items() if kk == k]
        se = statistics.pstdev(v) / math.sqrt(n)
        assert statistics.mean(means) == pytest.approx(statistics.mean(v), abs=4 * se / math.sqrt(60))
        assert statistics.stdev(means) == pytest.approx(se, rel=0.35)


def test_live_average_counts_tracks_until_they_expire():
    from lessonlens.streaming import steps
    step, state, out = steps.live_average(3.0, 0.5), None, []
    for t, scores in [(0.0, [(0.0, 1, 2.0), (0.0, 2, 4.0)]), (2.0, [(2.0, 1, 6.0)]), (4.0, [(3.5, 3, None), (4.0, 1, 7.0)]), (9.0, [(9.0, 4, float("nan"))])]:
        state, r = step(state, {"t": t, "scores": scores})
        out.append(r and (r["n_alive"], r["class_score"], r["smooth_score"]))
    assert out == [(2, 3.0, 3.0), (2, 5.0, 4.0), (1, 7.0, 5.5), None]


def test_fitted_thresholds_score_held_out_rows(spark):
    rng = random.Random(6)
    data = []
    for i in range(600):
        x = [rng.gauss(0, 1) for _ in range(4)]
        data.append((i, x, float(min(7, max(1, round(4 + 1.5 * x[0] - x[2]))))))
    examples = spark.createDataFrame(data, "id int, features array<double>, label double")
    model = tr.fit_ordinal(examples.where("id % 3 > 0"))
    held = examples.where("id % 3 = 0").withColumn("by_column", model.score(F.col("features")))
    out = tr.score_ordinal(held, model, ["id", "label", "by_column"]).collect()
    assert len(out) == 200 and all(1 <= r.pred_score <= 7 and r.pred_score == pytest.approx(r.by_column) for r in out)
    assert statistics.mean(abs(r.pred_score - r.label) for r in out) < 0.6
    assert tr.score_ordinal(held.where("id < 0"), model, ["id"]).collect() == []
    constant = tr.fit_ordinal(examples.where("label = 4"), iterations=3)
    assert tr.score_ordinal(held.limit(1), constant, []).first().pred_score == pytest.approx(4.0, abs=1e-6)


def test_appends_cluster_the_rows_of_a_video(spark, tmp_path):
    from lessonlens.sources import files
    log = spark.range(20_000).select(
        F.when(F.col("id") < 18_000, "big").otherwise(F.concat(F.lit("v"), (F.col("id") % 20).cast("string"))).alias("video_path"),
        F.col("id").cast("double").alias("t"), F.col("id").alias("frame_idx"), (F.col("id") % 7).alias("track_id"), F.lit(3.0).alias("score")).repartition(8)
    for _ in range(2):
        files.append_predictions(log, str(tmp_path / "log"), rows_per_file=5000)
    found = {p.name.split("=")[1]: len(list(p.glob("*.parquet"))) for p in (tmp_path / "log").glob("video_path=*")}
    assert found.pop("big") in range(4, 9) and set(found.values()) == {2} and len(found) == 20
    assert spark.read.parquet(str(tmp_path / "log")).count() == 40_000


def test_schema_report_lists_tables_and_columns(rows):
    from lessonlens.schemas import schema
    have = [("a", t, f.name) for t in ("videos", "labels") for f in schema(t).fields] + [("b", "labels", f.name) for f in schema("labels").fields if f.name != "score"]
    got = ql.schema_report(rows(have, "dataset_id string, table string, column string"), ["videos", "labels"]).fillna("-")
    assert values(got, "dataset_id", "table", "column") == [("b", "labels", "score"), ("b", "videos", "-")]


def test_overrides_are_logged_and_must_have_a_length(rows):
    from lessonlens.operators import intervention as iv
    ddl = "id int, video_filter string, start_sec double, end_sec double, situation string, note string"
    log = rows([("v", 1.0), ("v", 5.0)], "video_path string, t double")
    good = rows([(3, None, 0.0, 2.0, None, None), (7, "v", 4.0, 6.0, "AB", "n"), (9, "w", 0.0, 1.0, "AB", None)], ddl)
    kept = rows([(4, "old", 1.0, 2.0, "AB", None)], ddl)
    assert values(iv.override_log(kept, good), "id", "video_filter", "start_sec") == [(4, "old", 1.0), (5, "v", 4.0), (6, "w", 0.0)]
    assert values(iv.override_log(kept.limit(0), good), "id") == [(1,), (2,)]
    assert values(iv.stamp_overrides(log, good, True).fillna("-"), "t", "situation_override") == [(1.0, "-"), (5.0, "AB")]
    for end in (4.0, 3.0, None):
        with pytest.raises(Exception, match="must end after it starts"):
            iv.stamp_overrides(log, rows([(7, "v", 4.0, end, "AB", "n")], ddl)).collect()


def test_linking_takes_a_crowd_block_by_block(monkeypatch):
    import numpy as np
    from lessonlens.operators import linking as ln
    rng, seen = np.random.default_rng(7), []
    corners = lambda n: (lambda v: np.stack([v, v / 2, v + 50, v / 2 + 100], axis=1))(rng.uniform(0, 500, n).round(1))
    vectors = lambda n: [None if i % 4 == 0 else rng.uniform(0, 1, 2 + i % 2).tolist() for i in range(n)]
    a, b, sides = corners(300), corners(200), [vectors(n) for n in (300, 200, 300, 200)]
    costs = ln.link_costs
    monkeypatch.setattr(ln, "link_costs", lambda x, y, *more: seen.append(len(x) * len(y)) or costs(x, y, *more))
    got = ln.cheapest_tracks(a, b, *sides, ln.LinkRules(), pairs=3000)
    assert max(seen) <= 3000 and sum(seen) < 300 * 200 / 2
    want = costs(a, b, *sides, ln.LinkRules())
    assert (got[0] == want.argmin(axis=0))[np.isfinite(got[1])].all() and np.allclose(got[1], want.min(axis=0))


def _crowd(rng, n, repeated=False):
    v = rng.exponential(50, n).round(2)
    v = rng.choice(v[:40], n) if repeated else v
    kind, corners = rng.integers(0, 30, n), np.stack([v, v / 2, v + 50, v / 2 + 100], axis=1)
    return corners, [None if k % 3 == 0 else [k % 5 + 1.0, x % 7] for k, x in zip(kind.tolist(), v)], [[k % 3, k % 2] for k in kind.tolist()]


def _compared(monkeypatch, a, b, rules):
    """Pairs that are compared, after a look at the results against those of all pairs."""
    seen, costs = [], ln.link_costs
    with monkeypatch.context() as m:
        m.setattr(ln, "link_costs", lambda *sides: seen.append(costs(*sides)) or seen[-1])
        wanted, price = ln.cheapest_tracks(a[0], b[0], a[1], b[1], a[2], b[2], rules, pairs=20_000)
    want = costs(a[0], b[0], a[1], b[1], a[2], b[2], rules)
    linked = np.isfinite(price)
    assert (price == want.min(axis=0)).all() and (wanted[linked] == want.argmin(axis=0)[linked]).all()
    assert max(c.size for c in seen) <= 20_000
    return sum(c.size for c in seen)


def test_a_crowd_is_not_compared_pair_by_pair(monkeypatch):
    """A box meets few of the tracks, also where all boxes of the frame overlap; more tracks are hardly more work."""
    rng, rules = np.random.default_rng(11), ln.LinkRules()
    few, many, boxes = _crowd(rng, 1000), _crowd(rng, 4000), _crowd(rng, 1500)
    small, large = _compared(monkeypatch, few, boxes, rules), _compared(monkeypatch, many, boxes, rules)
    assert small < 0.2 * 1000 * 1500 and large < 0.08 * 4000 * 1500 and large < 2.5 * small


@pytest.mark.parametrize("rules", [ln.LinkRules(), ln.LinkRules(iou_min=-1.0), ln.LinkRules(w_pose=-1.0)])
def test_bounds_of_a_crowd_keep_ties_and_odd_boxes(monkeypatch, rules):
    """Equal tracks go by their order; corners and values that are missing or not finite, turned boxes and vectors of any size."""
    rng = np.random.default_rng(12)
    a, b = _crowd(rng, 700, repeated=True), _crowd(rng, 300, repeated=True)
    for corners, poses, colours in (a, b):
        for i, odd in zip(range(0, len(corners), 9), itertools.cycle([np.nan, np.inf, -np.inf, 1e9])):
            corners[i, i % 4] = odd
        corners[::13] = corners[::13][:, [2, 3, 0, 1]]
        poses[5::17], colours[3::19] = [[0.0, 0.0, float("nan"), 1.0]] * len(poses[5::17]), [[]] * len(colours[3::19])
    with np.errstate(all="ignore"):
        _compared(monkeypatch, a, b, rules)


def _plan(df, capfd):
    capfd.readouterr()
    df.explain("formatted")
    return capfd.readouterr().out


def test_sides_of_a_difference_are_met_once(rows, capfd):
    """One grouping finds the rows of both sides, NULL being equal to NULL; each input is read once."""
    from lessonlens.operators.merging import topology_differences
    a, b = rows([(1, "x"), (1, "x"), (None, "y"), (3, None)], "k int, s string"), rows([(1, "x"), (None, "y"), (4, None)], "k int, s string")
    got = topology_differences(a, b, ["k", "s"])
    assert sorted(got.collect(), key=str) == [(3, None, "source"), (4, None, "base")] and got.columns == ["k", "s", "side"]
    plan = _plan(got, capfd)
    assert "Generate" not in plan and "Sort" not in plan


def test_split_counts_sort_no_rows(spark, tmp_path, capfd):
    import __spark_entry__ as entry
    orders = spark.range(1, 4001).selectExpr("id AS o_orderkey", "id % 50 AS o_custkey")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    got = entry.queries()["M1_F23_grouped_split_counts"](spark, str(tmp_path))
    assert got.collect() == [(500, 100, 0)] and "SortAggregate" not in _plan(got, capfd)


def test_sensitivity_sweeps_once(rows, monkeypatch):
    from lessonlens.plans import intervention_queries as iq
    calls, table = [], rows([(0.0, "AB001", 1.0, 2.0), (0.0, "AB002", 2.0, 2.0)], "cooldown_sec double, event_id string, effect_unadjusted double, effect_standardized double")
    monkeypatch.setattr(iq, "_sweep", lambda spark, d: calls.append(d) or (None, None, table))
    got = {r.effect_type: (r.n_events, r.mean_effect) for r in iq.a12(None, "x").collect()}
    assert calls == ["x"] and got == {"effect_unadjusted": (2, 1.5), "effect_standardized": (2, 2.0)}


def test_sequence_summary_reads_the_audit_once(spark, rows, monkeypatch):
    from lessonlens.plans import segment_queries as sq
    spark.range(1, 4).selectExpr("id AS segment_id").createOrReplaceTempView("rated")
    audit = rows([("a", i, 0.0, 5.0, 5, 5, 0, float(i)) for i in range(1, 5)],
                 "dataset_id string, segment_id bigint, t_start double, t_end double, frames bigint, distinct_t bigint, outside bigint, span double")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(sq, "_audit", lambda spark, d: audit.mapInArrow(counted, audit.schema))
    monkeypatch.setattr(sq.fx, "rate", lambda spark, d: spark.table("rated"))
    got = {r.labelled: (r.segments, r.span_median_sec) for r in sq.a35_summary(spark, "x").collect()}
    assert got == {"all": (4, 2.5), "labelled": (3, 2.0)} and reads.value == 4


def _segment_frames(rows):
    rng = random.Random(9)
    data = [(ds, seg, rng.choice([0.5 * i for i in range(40)]), i, f"p{rng.randint(0, n)}") for ds in "ab" for seg, n in ((1, 1), (2, 5), (3, 60), (4, 9))
            for i in range(n)]
    data += [("a", None, 1.0, 1, "p"), ("a", 2, None, 99, "p")]
    return data, rows(data, "dataset_id string, segment_id int, t double, frame_idx int, crop_path string")


def _shuffles(df):
    """Shuffles of the plan that ran in the end."""
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


@pytest.mark.parametrize("seed", [None, 3])
def test_vast_and_ordinary_segments_are_assembled_alike(rows, seed):
    data, frames = _segment_frames(rows)
    whole = sg.assemble(frames, 4, ["t"], seed, ["dataset_id"])
    want = sorted(tuple(map(str, r)) for r in whole.collect())
    assert _shuffles(whole) == 1  # frames go to their segment once, nothing is gathered again
    for most in (0, 5, 9):
        assert sorted(tuple(map(str, r)) for r in sg.assemble(frames, 4, ["t"], seed, ["dataset_id"], most).collect()) == want
    if seed is None:
        for r in whole.collect():
            times = sorted((x[2] if x[2] is not None else -1.0, x[3]) for x in data if x[:2] == (r.dataset_id, r.segment_id))
            n = len(times)
            at = [round(k * ((n - 1) / 3.0)) if n >= 4 else min(k, n - 1) for k in range(4)]
            assert r.n_frames == n and [f.t for f in r.sequence] == [times[i][0] for i in at if times[i][0] >= 0]


def test_vast_and_ordinary_clips_are_animated_alike(rows):
    data, frames = _segment_frames(rows)
    clips = rows([(ds, seg, a, a + 9.0) for ds in "ab" for seg in range(1, 5) for a in (0.0, 4.0)],
                 "dataset_id string, segment_id int, clip_start double, clip_end double")
    columns = ["dataset_id", "segment_id", "clip_start", "position", "t", "crop_path"]
    whole = sg.animation_frames(frames, clips, 2.0, 3, ["dataset_id"])
    whole.collect()
    got = values(whole, *columns)
    assert _shuffles(whole) <= 3  # counted by hash, by path, numbered: no reader makes the frames meet their clips again
    for most in (0, 5):
        assert values(sg.animation_frames(frames, clips, 2.0, 3, ["dataset_id"], most), *columns) == got
    want = []
    for ds, seg, a in ((ds, seg, a) for ds in "ab" for seg in range(1, 5) for a in (0.0, 4.0)):
        first = {}
        for x in data:
            if x[:2] == (ds, seg) and x[2] is not None and a <= x[2] < a + 9.0:
                first[x[4]] = min(first.get(x[4], 99.0), x[2])
        line = sorted((t, p) for p, t in first.items())
        m = min(3, len(line))
        want += [(ds, seg, a, k, *line[len(line) // 2 if m == 1 else round(k * (len(line) - 1) / (m - 1))]) for k in range(m)]
    assert got == sorted(want)


def test_cooldowns_share_what_they_have_in_common(rows):
    """Times on the borders of bins and phases count once in each cooldown's phase, however many cooldowns share the figures."""
    cooldowns = (60.0, 0.0, 17.0, 30.0, 17.0)
    design = iv.Design(80.0, 5.0, 60.0, 20.0, cooldowns=cooldowns)
    known, ways, sharers = iv._ways(design, sorted({b for c in cooldowns for b in (c, c + 60.0)}))
    assert known == [0.0, 17.0, 30.0, 60.0] and [30.0, 60.0] in sharers
    rng = random.Random(6)
    times = [150.0 + x for x in range(-140, 130)] + [150.0 + 0.1 * x for x in range(1300)]
    log = rows([("v", t, rng.randint(1, 9), rng.uniform(1, 7), 4.0, rng.choice(["聞く", "書く"]), False, 0.5) for t in times],
               "video_path string, t double, track_id int, score double, score_clamped double, base_situation string, is_ab boolean, situation_confidence double")
    events = iv.number_events(iv.explicit_events(rows([("v",)], "video_path string"), 100.0, 150.0))
    got = values(iv.event_course(log, events, design), "cooldown_sec", "phase", "relative_bin", "base_situation", "n_tracks")
    want = {}
    for t, track, sit in [(r.t, r.track_id, r.base_situation) for r in log.collect()]:
        for c in set(cooldowns):
            phase = "pre" if 15 <= t < 95 else "AB" if 100 <= t < 150 else "cooldown" if 150 <= t < 150 + c else "post" if 150 + c <= t < 210 + c else None
            for s in (sit, "ALL") if phase else ():
                want.setdefault((c, phase, math.floor((t - 150.0) / 20.0), s), set()).add(track)
    assert got == sorted((*k, len(v)) for k, v in want.items())
