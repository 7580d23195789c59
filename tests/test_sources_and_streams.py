"""Readers, sinks, and streams that must equal their batch counterparts."""

import datetime
import sqlite3

import pytest
from pyspark.sql import functions as F

from lessonlens.operators import scans
from lessonlens.schemas import conform
from lessonlens.session import keyed_state
from lessonlens.sources import files, fixtures as fx, predictions as pr
from lessonlens.sources.sqlite import read_stores
from lessonlens.streaming import live

SF = "/root/testdata/sf0.001"


def _store(path, n, with_lock=True):
    path.parent.mkdir(parents=True)
    con = sqlite3.connect(path)
    lock = ", situation_locked INTEGER" if with_lock else ""
    con.execute(f"CREATE TABLE windows(id INTEGER PRIMARY KEY, video_id INTEGER, t_start REAL, t_end REAL, situation TEXT, situation_set_by TEXT, situation_updated_at TEXT{lock})")
    for i in range(n):
        con.execute("INSERT INTO windows(id, video_id, t_start, t_end, situation, situation_updated_at) VALUES(?,1,?,?,?,?)",
                    (i + 1, i * 5, i * 5 + 5, "聞く", "2024-01-01 10:00:00"))
    con.commit()
    con.close()
    return str(path)


def test_sqlite_stores(spark, tmp_path):
    a = _store(tmp_path / "lesson_a" / "db" / "dataset.sqlite", 25)
    b = _store(tmp_path / "lesson_b" / "db" / "dataset.sqlite", 7, with_lock=False)
    df = read_stores(spark, [a, b], "windows", rows=4)
    assert {(r.dataset_id, r["count"]) for r in df.groupBy("dataset_id").count().collect()} == {("lesson_a", 25), ("lesson_b", 7)}
    assert df.rdd.getNumPartitions() == 7 + 2
    assert df.where("situation = '聞く' AND t_end - t_start = 5 AND year(situation_updated_at) = 2024").count() == 32
    with pytest.raises(ValueError, match="twice"):
        read_stores(spark, [a, a], "windows")


def test_csv_contract(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿school_id,class_id,session_id,phase,time_bin,classroom_score\ns,c,1,pre,0,3.5\n", encoding="utf-8")
    with pytest.raises(ValueError, match="post"):
        files.read_trial(spark, str(tmp_path / "t.csv"))
    (tmp_path / "p.csv").write_text("school_id,phase\ns,pre\n", encoding="utf-8")
    with pytest.raises(ValueError, match="human_score"):
        files.read_pairs(spark, str(tmp_path / "p.csv"))


def test_pose_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"keypoints": [[1, 2, 0.5]]}')
    (tmp_path / "b.json").write_text("not json")
    out = {r.pose_path.rsplit("/", 1)[1]: r.kpts for r in files.read_pose_files(spark, str(tmp_path)).collect()}
    assert tuple(out["a.json"][0]) == (1.0, 2.0, 0.5) and len(out["b.json"]) == 17 and tuple(out["b.json"][3]) == (0.0, 0.0, 0.0)


def test_conform(rows):
    df = conform(rows([("v", "1.5", "gone")], "video_path string, t string, retired string"), "predictions", {"score": 2.0})
    r = df.first()
    assert r.t == 1.5 and r.score == 2.0 and r.situation is None and "retired" not in df.columns


def test_ab_reader_drops_unusable_rows(rows):
    df = rows([("v", 1.0, 1, float("nan"), 3, "A"), ("v", None, 1, 2.0, 3, "A"), ("v", 1.0, 1, 2.0, 3, None)],
              "video_path string, t double, track_id int, score double, score_clamped int, situation string")
    assert pr.read_predictions_ab(df).count() == 1
    with pytest.raises(ValueError):
        pr.read_predictions_ab(df.drop("score"))


def test_missing_assets_report(spark, tmp_path):
    from lessonlens.functions.text import asset_candidates
    from lessonlens.operators import quality as ql
    (tmp_path / "assets" / "crops").mkdir(parents=True)
    (tmp_path / "assets" / "crops" / "a.jpg").write_text("x")
    rows_ = spark.createDataFrame([("data/assets/crops/a.jpg",), ("crops/b.jpg",), ("",)], "crop_path string")
    listed = rows_.withColumn("c", asset_candidates(F.col("crop_path"), F.lit(str(tmp_path)), F.lit(f"{tmp_path}/db")))
    out = ql.first_existing(listed, files.existing_files(spark, str(tmp_path)), "c", ["crop_path"])
    assert {r.crop_path: r.resolved for r in out.collect()}["data/assets/crops/a.jpg"] == f"{tmp_path}/assets/crops/a.jpg"
    r = ql.missing_assets(out, "crop_path").first()
    assert r.missing == 2 and r.examples == ["(empty)", "crops/b.jpg"]


@pytest.fixture(scope="module")
def replay(spark, tmp_path_factory):
    """The fixture log, each lesson beginning 1,000 seconds after the one before, in files that follow one another in time."""
    path = str(tmp_path_factory.mktemp("replay"))
    log = fx.pred(spark, SF)
    log = live.lesson_clock(log, F.timestamp_seconds(F.substring("video_path", 8, 2).cast("int") * 1000))
    edges = log.select(F.col("at").cast("double").alias("s")).approxQuantile("s", [0.25, 0.5, 0.75], 0.0)
    for low, high in zip([-1.0, *edges], [*edges, 1e12]):
        log.where((F.col("at").cast("double") > low) & (F.col("at").cast("double") <= high)).coalesce(1).write.mode("append").parquet(path)
    return path, log


def _stream(spark, replay):
    path, log = replay
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_track_scores_across_batches(spark, replay):
    _, log = replay
    out = live.drain_closed(_stream(spark, replay), lambda log: live.track_scores(log, every=0.0, ttl=live.LESSON_TTL), "t")
    batch = scans.exponential_average(
        log, ["video_path", "track_id"], ["t", "frame_idx"], {"s": "score"}, 0.3, scans.time_chunk("t", 500.0))
    a = {r.frame_idx: r.smooth_score for r in out.collect()}
    b = {r.frame_idx: r.s for r in batch.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_first_row_of_a_lesson_and_late_rows(spark, tmp_path):
    """Rows at t = 0 count whenever their lesson begins; a row is late by its instant alone. Rows wait until the watermark has
    passed them, so the last one is there only once the stream is closed."""
    path = str(tmp_path / "log")
    ddl = "video_path string, track_id bigint, frame_idx bigint, t double, score double, start bigint"
    for rows_ in ([("a", 1, 1, 0.0, 4.0, 5000), ("a", 1, 2, 60.0, 4.0, 5000)], [("b", 1, 3, 0.0, 4.0, 5100)], [("a", 1, 4, 1.0, 4.0, 5000)]):
        spark.createDataFrame(rows_, ddl).coalesce(1).write.mode("append").parquet(path)
    stream = live.lesson_clock(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path), F.timestamp_seconds("start"))
    chain = lambda log: live.track_scores(log, every=0.0)
    with keyed_state(spark):
        running = chain(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    assert live.LateRows(running).to_the_end() == 1
    assert {r.frame_idx for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 2}
    assert {r.frame_idx for r in live.drain_closed(stream, chain, "closed").collect()} == {1, 2, 3}


def _folded(rows_, step, keys=("video_path", "track_id"), ttl=1e9):
    """The step over each key's rows in time order."""
    held, out = {}, []
    for r in sorted(rows_, key=lambda r: (r["t"], r["frame_idx"])):
        key = tuple(r[k] for k in keys)
        state, last = held.get(key, (None, None))
        state, found = step(None if last is not None and r["t"] - last > ttl else state, r)
        held[key] = state, r["t"]
        if found is not None:
            out.append({**dict(zip(keys, key)), **found})
    return out


def _same(got, want, columns):
    plain = lambda r: tuple(round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in (r[c] for c in columns))
    assert sorted(map(plain, got), key=repr) == sorted(map(plain, want), key=repr) and len(want) > 0


@pytest.mark.parametrize("files_", [1, 10])
def test_rows_out_of_order_within_the_delay(spark, tmp_path, files_):
    """Every row comes up to nine seconds after its instant, in ten micro-batches or in one: no row is lost or out of place."""
    import random
    from lessonlens.streaming import steps
    rng = random.Random(11)
    ddl = "video_path string, track_id bigint, frame_idx bigint, t double, score double, excluded boolean, matched_name string, item double, start bigint"
    data = []
    for i in range(400):
        t = round(rng.uniform(0, 100), 2)
        data.append((f"v{i % 2}", i % 3, i, t, rng.choice([None, 1.0, 4.0, 6.5]), rng.random() < 0.05, rng.choice([None, "a", "b"]), float(i), 5000 * (i % 2)))
    rows_ = [dict(zip([f.split()[0] for f in ddl.split(", ")], r)) for r in data]
    arrival = sorted(data, key=lambda r: (r[8], r[3] + rng.uniform(0, 9)))
    path, size = str(tmp_path / "log"), -(-len(arrival) // files_)
    for k in range(0, len(arrival), size):
        spark.createDataFrame(arrival[k:k + size], ddl).coalesce(1).write.mode("append").parquet(path)
    stream = live.lesson_clock(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path), F.timestamp_seconds("start"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        run = lambda build: [r.asDict() for r in live.drain_closed(stream, build, "order").collect()]
        _same(run(lambda s: live.track_scores(s, every=0.0, ttl=20.0)), _folded(rows_, steps.track_score(0.3, 0.0), ttl=20.0), ["frame_idx", "t", "raw_score", "smooth_score"])
        _same(run(lambda s: live.throttled(s, 0.5)), _folded(rows_, steps.throttle(0.5)), ["video_path", "track_id", "frame_idx"])
        if files_ > 1:
            _same(run(lambda s: live.buffered(s, 4, ttl=8.0)), _folded(rows_, steps.ring_buffer(4), ttl=8.0), ["frame_idx", "ready", "items"])
            _same(run(lambda s: live.exclusions(s, ttl=1000.0)), _folded(rows_, steps.face_vote()), ["frame_idx", "excluded", "name"])
            _same(run(live.history), _folded(rows_, steps.rolling_history(), ["video_path"]), ["video_path", "t", "n_points", "n_known"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stable_ids_of_frames_with_several_boxes(spark, tmp_path):
    """The stream links the boxes of each frame as the batch does, whatever the order in which they come."""
    import random
    from lessonlens.operators import linking as ln
    rng = random.Random(3)
    ddl = "video_path string, frame_idx bigint, det_id bigint, x1 double, y1 double, x2 double, y2 double, pose_vec array<double>, colour_vec array<double>, t double, at timestamp"
    data = []
    for frame in range(40):
        for k in range(rng.randrange(4)):
            x, y = 40.0 * k + rng.uniform(-25, 25), rng.uniform(-10, 10)
            data.append(("v", frame, 10 * frame + k, x, y, x + 50, y + 100, rng.choice([None, [1.0, rng.random()]]), [rng.random(), 1.0], float(frame),
                         datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=frame)))
    path = str(tmp_path / "boxes")
    for part in (data[1::2], data[::2]):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 2).parquet(path).drop("frame_idx")
    got = live.drain_closed(stream, lambda s: live.stable_ids(live.frames_of(s, "1 second", "60 seconds"), 3.0, delay=None), "ids")
    want = ln.link_detections(spark.createDataFrame(data, ddl), ln.LinkRules(max_age=3.0))
    assert {r.det_id: r.stable_id for r in got.collect()} == {r.det_id: r.stable_id for r in want.collect()}
    assert len({r.stable_id for r in want.collect()}) < len(data)


def test_silent_tracks_begin_anew(spark, replay):
    _, log = replay
    out = live.drain_closed(_stream(spark, replay).withColumn("item", F.col("t")), lambda log: live.buffered(log, 5, ttl=600.0), "b")
    rows_ = {}
    for r in sorted(log.collect(), key=lambda r: (r.t, r.frame_idx)):
        rows_.setdefault((r.video_path, r.track_id), []).append(r)
    want = {}
    for mine in rows_.values():
        held = []
        for r in mine:
            held = ([] if held and r.t - held[-1] > 600.0 else held) + [r.t]
            want[r.frame_idx] = held[-5:]
    got = {r.frame_idx: r["items"] for r in out.collect()}
    assert got == want


def test_class_scores_behind_track_scores(spark, replay):
    """Every lesson's spans are there to the last one, in one batch or in several."""
    _, log = replay
    chain = lambda stream: live.class_scores(live.track_scores(stream, every=0.0, ttl=600.0), frame_sec=50.0)
    got = {}
    for r in live.drain_closed(_stream(spark, replay), chain, "c").collect():
        got.setdefault(r.video_path, []).append((r.t, r.class_score, r.smooth_score))
    tracks, spans = {}, {}
    for r in sorted(log.collect(), key=lambda r: (r.t, r.frame_idx)):
        last, smooth = tracks.get((r.video_path, r.track_id), (None, None))
        smooth = r.score if last is None or r.t - last > 600.0 else 0.7 * smooth + 0.3 * r.score
        tracks[r.video_path, r.track_id] = (r.t, smooth)
        spans.setdefault(r.video_path, {}).setdefault(r.t // 50, []).append((r.t, smooth))
    assert got.keys() == spans.keys()
    for video, found in got.items():
        held = None
        assert len(found) == len(spans[video])
        for (t, value, s), (_, members) in zip(sorted(found), sorted(spans[video].items())):
            mean = sum(v for _, v in members) / len(members)
            held = mean if held is None else 0.8 * held + 0.2 * mean
            assert (t, value, s) == (members[0][0], pytest.approx(mean), pytest.approx(held))


def test_bins_and_sessions_are_complete(spark, replay):
    """Built-in windows over several batches hold what a batch query over all rows finds."""
    _, log = replay
    more = {"score_clamped": F.lit(4), "situation_confidence": F.lit(0.5), "is_ab": F.col("frame_idx") % 3 == 0}
    stream = _stream(spark, replay).withColumns(more)
    bins = live.drain_closed(stream, lambda s: live.binned_scores(s, "1000 seconds"), "bins", keyed=False)
    by_track = log.groupBy(F.window("at", "1000 seconds").alias("w"), "situation", "video_path", "track_id").agg(F.avg("score").alias("s"))
    want = by_track.groupBy("w", "situation").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("m"))
    assert {(r.situation, r.bin_start): (r.n_tracks, pytest.approx(r.score_mean)) for r in bins.collect()} == {
        (r.situation, r.w.start): (r.n, r.m) for r in want.collect()}
    runs = live.drain_closed(stream, lambda s: live.flagged_sessions(s, "30 seconds"), "runs", keyed=False, is_ab=F.lit(True))
    want = log.withColumns(more).where("is_ab").groupBy(F.session_window("at", "30 seconds").alias("w"), "video_path").count()
    assert sorted((r.video_path, r.session_start, r.n) for r in runs.collect()) == sorted(
        (r.video_path, r.w.start, r["count"]) for r in want.collect())


def test_rolling_history_and_votes(spark, rows):
    from lessonlens.streaming import steps
    step, state, seen = steps.rolling_history(2.0, 0.5), None, []
    for t, v in [(0.0, 9.0), (0.2, 3.0), (0.5, None), (1.0, 2.0), (3.0, 4.0), (1.0, 5.0)]:
        state, out = step(state, {"t": t, "score": v})
        seen.append((out["n_points"], out["n_known"], out["mean"]))
    assert seen == [(1, 1, 7.0), (1, 1, 7.0), (2, 1, 7.0), (3, 2, 4.5), (2, 2, 3.0), (1, 1, 5.0)]
    step, state, verdicts = steps.face_vote(4), None, []
    for n in ["x", "x", None, None, None]:
        state, out = step(state, {"frame_idx": 0, "t": 0.0, "matched_name": n})
        verdicts.append(out["excluded"])
    assert verdicts == [False, True, True, True, False]


def test_exclusion_resets_a_track():
    from lessonlens.streaming import steps
    step, state, out = steps.track_score(0.5, 0.0), None, []
    for score, gone in [(2.0, False), (4.0, False), (9.0, True), (6.0, False)]:
        state, r = step(state, {"frame_idx": 0, "t": 0.0, "score": score, "excluded": gone})
        out.append(r and r["smooth_score"])
    assert out == [2.0, 3.0, None, 6.0]


def test_sliding_mean_and_log_sink(spark, replay, tmp_path):
    out = live.drain(live.rolling_mean(_stream(spark, replay), "1200 seconds", "600 seconds"), "r", keyed=False)
    assert out.count() > 0
    source = spark.readStream.schema(replay[1].schema).option("maxFilesPerTrigger", 1).parquet(replay[0])
    end = spark.range(1).select(*[F.lit(datetime.datetime(9999, 1, 1) if f.name == "at" else None).cast(f.dataType).alias(f.name) for f in replay[1].schema])
    marks = str(tmp_path / "marks")
    end.limit(0).write.parquet(marks)
    log = source.unionByName(spark.readStream.schema(replay[1].schema).parquet(marks))
    running = live.append_log(live.track_scores(log, every=0.0), str(tmp_path / "log"), str(tmp_path / "ckpt"))
    running.processAllAvailable()
    end.write.mode("append").parquet(marks)  # closes the stream: the last rows are passed by the watermark
    running.processAllAvailable()
    running.stop()
    assert spark.read.parquet(str(tmp_path / "log")).count() == replay[1].count()


def test_waiting_rows_lie_in_pieces(spark, monkeypatch):
    """However many rows a cell holds, only a run or the pieces that are reached are read; the order is that of the rows."""
    import pickle
    import types
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T
    from lessonlens.streaming import folds
    monkeypatch.setattr(folds, "RUN", 64)
    monkeypatch.setattr(folds, "PIECE", 16)
    monkeypatch.setattr(folds, "PAGE", 32)

    def step(state, row):
        return (state or 0) + 1, {"n": (state or 0) + 1, "frame_idx": row["frame_idx"]}

    step.state, step.reads = "bigint", ("frame_idx",)
    names = {"video": T.StringType(), "frame_idx": T.LongType(), "t": T.DoubleType(), folds.DUE: T.LongType(), folds.AT: T.LongType()}
    fold = folds.StepFold(step, ["video", "n", "frame_idx"], ["video"], ["t", "frame_idx"], 1e9, [T.StructField(n, k) for n, k in names.items()])
    store, held = {}, {}
    fold.handle = types.SimpleNamespace(registerTimer=lambda at: None)
    fold.held = types.SimpleNamespace(get=lambda: held.get("v"), update=lambda v: held.update(v=v), clear=held.clear)
    fold.pieces = types.SimpleNamespace(
        updateValue=lambda k, v: store.update({k: v}), getValue=lambda k: store[k], removeKey=lambda k: store.pop(k))
    t = np.random.default_rng(5).permutation(1000)
    rows = pd.DataFrame({"c0": "v", "c1": t * 2, "c2": t.astype(float), "c3": t * 1000, "c4": t * 1_000_000, "gaps": 0})
    fold.handleInputRows(None, iter([rows[:300], rows[300:]]), None)
    assert len(store) > 50 and max(len(pickle.loads(v[0])) for v in store.values()) <= 16
    pages = []
    for mark in (400_500, 10**9):
        now = types.SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark)
        found = list(fold.handleExpiredTimer(None, now, None))
        pages += found
        assert sum(map(len, found)) == (401 if mark < 10**6 else 599)
    out = pd.concat(pages)
    assert max(map(len, pages)) <= 32 and out["frame_idx"].tolist() == list(range(0, 2000, 2)) and out["n"].tolist() == list(range(1, 1001)) and not store


def test_an_open_state_lasts_for_all_rows_that_are_due(spark):
    """Large states are opened once and closed once, and rows reach the step as arrays, gaps as no number; results are the step's."""
    import types
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T
    from lessonlens.streaming import folds
    from lessonlens.streaming import steps
    rng, step = np.random.default_rng(8), steps.stable_ids()
    opened, advance, closed = step.inside
    calls = []

    def inside(state, row):
        assert all(isinstance(row[c], np.ndarray) for c in steps.FRAME)
        return advance(state, row)

    step.inside = lambda s: calls.append("open") or opened(s), inside, lambda s: calls.append("close") or closed(s)
    whole = lambda c: c == "det_id" or c.endswith("_sizes")
    kinds = {"video_path": T.StringType(), "t": T.DoubleType(), folds.DUE: T.LongType(), folds.AT: T.LongType(),
             **{c: T.ArrayType(T.LongType() if whole(c) else T.DoubleType()) for c in steps.FRAME}}
    fold = folds.StepFold(step, ["t", "det_ids", "stable_ids"], ["video_path"], ["t"], 1e9, [T.StructField(n, k) for n, k in kinds.items()])
    store, held, frames, state, want = {}, {}, [], None, {}
    fold.handle = types.SimpleNamespace(registerTimer=lambda at: None)
    fold.held = types.SimpleNamespace(get=lambda: held.get("v"), update=lambda v: held.update(v=v), clear=held.clear)
    fold.pieces = types.SimpleNamespace(
        updateValue=lambda k, v: store.update({k: v}), getValue=lambda k: store[k], removeKey=lambda k: store.pop(k))
    for t in range(20):
        x = rng.uniform(0, 200, 6)
        dets = [{"det_id": 10 * t + int(k), "x1": x[k], "y1": 0.0, "x2": x[k] + 50 if k else None, "y2": 99.0, "pose_vec": [None, [1.0, x[k]], []][k % 3],
                 "colour_vec": [x[k]]} for k in rng.permutation(6)]
        state, out = step(state, {"t": float(t), "dets": dets})
        want |= {q["det_id"]: q["stable_id"] for q in out["links"]}
        frames.append(("v", float(t), t * 1000, t * 1_000_000, *[np.array([q[c] for q in dets], float if c != "det_id" else int) for c in steps.DETECTION[:5]],
                       *[np.array([v for q in dets for v in q[c] or []], float) for c in steps.VECTORS],
                       *[np.array([len(q[c] or []) for q in dets]) for c in steps.VECTORS], 0))
    fold.handleInputRows(None, iter([pd.DataFrame(frames[::-1], columns=[*[f"c{i}" for i in range(len(kinds))], "gaps"])]), None)
    got = {}
    for mark in (9_500, 10**9):
        now = types.SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark)
        for page in fold.handleExpiredTimer(None, now, None):
            got |= {d: s for ids, stable in zip(page["det_ids"], page["stable_ids"]) for d, s in zip(ids.tolist(), stable.tolist())}
    assert got == want and len(set(want.values())) < len(want) and not store
    assert calls == ["open", "close", "open", "close"]


def test_gathered_frames_are_few_at_once(spark):
    """A task sorts what it gathers instead of holding many large frames as objects; the session keeps its own choice."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    with keyed_state(spark):
        assert int(spark.conf.get(name)) <= 8
    assert spark.conf.get(name) == before
