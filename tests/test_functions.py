"""Hand-computed cases for the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from lessonlens.functions import boxes, numeric, pose, probs, text


def one(df, *cols):
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


@pytest.fixture
def unit(spark):
    return spark.range(1)


def test_half_even_class(rows):
    df = rows([(2.5,), (3.5,), (0.2,), (9.0,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(numeric.score_class(F.col("x"))).collect()] == [2, 4, 1, 7, None]


def test_clock(rows):
    df = rows([("90",), ("1:30",), ("0:01:30",), ("x",), ("1.5:30",), ("",), ("1:2:3:4",)], "x string")
    assert [r[0] for r in df.select(text.parse_clock(F.col("x"))).collect()] == [90.0, 90.0, 90.0, None, None, None, None]
    shown = rows([(3725.456,), (59.999,), (-1.0,)], "x double").select(text.clock_text(F.col("x"))).collect()
    assert [r[0] for r in shown] == ["1:02:05.46", "0:00:60.00", "0:00:00.00"]


def test_number_list(rows):
    df = rows([("30, 0,30,90",), ("-1,2",), (" ,",), ("a",)], "x string")
    assert [r[0] for r in df.select(text.number_list(F.col("x"))).collect()] == [[0.0, 30.0, 90.0], None, None, None]


def test_pearson_of_constant_is_null(rows):
    df = rows([(1.0, 2.0), (2.0, 2.0)], "x double, y double")
    assert df.agg(numeric.pearson(F.col("x"), F.col("y"))).first()[0] is None


def test_boxes(unit):
    a = boxes.box(*[F.lit(v) for v in (0.0, 0.0, 10.0, 10.0)])
    b = boxes.box(*[F.lit(v) for v in (5.0, 0.0, 15.0, 10.0)])
    r = one(unit, boxes.iou(a, b), boxes.centre_distance(a, b), boxes.clamp_box(a, F.lit(5), F.lit(5)),
            boxes.clamp_box(boxes.box(*[F.lit(v) for v in (-5.0, 0.0, -1.0, 4.0)]), F.lit(5), F.lit(5)))
    assert r.c0 == pytest.approx(1 / 3) and r.c1 == pytest.approx(0.01)
    assert tuple(r.c2) == (0, 0, 4, 4) and r.c3 is None


def _points(values):
    return F.array(*[pose.point(F.lit(float(x)), F.lit(float(y)), F.lit(float(c))) for x, y, c in values])


def test_normalise_pose(unit):
    p = _points([(0, 0, 1), (2, 0, 1), (50, 50, 0.1)])
    out = one(unit, pose.normalise_pose(p)).c0
    assert [(round(q.x, 6), round(q.y, 6)) for q in out[:2]] == [(-1.0, 0.0), (1.0, 0.0)]
    hidden = one(unit, pose.normalise_pose(_points([(3, 4, 0.1)]))).c0
    assert tuple(hidden[0]) == (0.0, 0.0, 0.1)


def test_normalised_pose_ignores_shift_and_scale(unit):
    base = [(0, 0, 1), (2, 1, 1), (1, 5, 1), (4, 2, 0.5)]
    moved = [(3 * x + 7, 3 * y - 2, c) for x, y, c in base]
    r = one(unit, pose.normalise_pose(_points(base)), pose.normalise_pose(_points(moved)))
    for p, q in zip(r.c0, r.c1):
        assert p.x == pytest.approx(q.x) and p.y == pytest.approx(q.y)


def test_mirror_twice_is_identity(unit):
    p = _points([(i, i + 1, 0.5) for i in range(17)])
    r = one(unit, pose.mirror_pose(p), pose.mirror_pose(pose.mirror_pose(p)))
    assert r.c0[1].x == -2.0 and [tuple(q) for q in r.c1] == [(float(i), float(i + 1), 0.5) for i in range(17)]


def test_pose_distances(unit):
    v = F.array(F.lit(1.0), F.lit(0.0))
    w = F.array(F.lit(0.0), F.lit(1.0))
    empty = F.array().cast("array<double>")
    r = one(unit, pose.cosine_distance(v, w), pose.cosine_distance(v, empty), pose.mean_l1(v, w), pose.mean_l1(empty, empty))
    assert (r.c0, r.c1, r.c2, r.c3) == (1.0, 1.0, 1.0, 1.0)
    few = one(unit, pose.match_vector(_points([(0, 0, 1), (1, 1, 1), (2, 2, 1)])))
    assert few.c0 == []


def test_motion_features(unit):
    def person(dx):
        values = [(float(i), float(i % 4), 0.9) for i in range(17)]
        values[5], values[6] = (1.0 + dx, 0.0, 0.9), (-1.0 + dx, 0.0, 0.9)
        return [(x + dx if i not in (5, 6) else x, y, c) for i, (x, y, c) in enumerate(values)]

    seq = F.array(_points(person(0.0)), _points(person(3.0)))
    out = one(unit, pose.motion_features(seq)).c0
    assert [len(v) for v in out] == [103, 103]
    # Moving the whole body changes neither the relative points nor their displacement.
    assert out[0][:34] == pytest.approx(out[1][:34]) and out[1][34:68] == pytest.approx([0.0] * 34)
    assert all(-5 <= v <= 5 for v in out[0][:34])


def test_probabilities(unit):
    z = F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))
    nan = F.array(*[F.lit(float("nan"))] * 3)
    r = one(unit, probs.softmax(z), probs.best_situation(probs.softmax(z)), probs.softmax(nan), probs.one_hot(F.lit(" 書く ")), probs.one_hot(F.lit("x")))
    assert sum(r.c0) == pytest.approx(1.0) and r.c1 == "書く"
    assert r.c2 == pytest.approx([1 / 3] * 3) and r.c3 == [0.0, 1.0, 0.0] and r.c4 is None


def test_ordinal(unit):
    raw = F.array(*[F.lit(v) for v in (0.5, -1.0, 2.0)])
    r = one(unit, probs.monotone_logits(raw), probs.expected_score(raw), probs.ordinal_entropy(F.array(F.lit(0.0))))
    soft = [math.log1p(math.exp(v)) for v in (-1.0, 2.0)]
    assert r.c0 == pytest.approx([0.5, 0.5 - soft[0], 0.5 - soft[0] - soft[1]])
    assert r.c1 == pytest.approx(1 + sum(1 / (1 + math.exp(-v)) for v in (0.5, -1.0, 2.0))) and r.c2 == pytest.approx(1.0)


def test_asset_candidates(unit):
    r = one(unit, text.asset_candidates(F.lit("data\\assets\\crops\\a.jpg "), F.lit("/d/one"), F.lit("/d/one/db")))
    assert r.c0[:2] == ["/d/one/data/assets/crops/a.jpg", "/d/one/db/data/assets/crops/a.jpg"]
    assert "/d/one/assets/crops/a.jpg" in r.c0 and r.c0.index("/d/one/data/assets/crops/a.jpg") < r.c0.index("/d/one/assets/crops/a.jpg")


def test_upper_body(unit):
    r = one(unit, boxes.upper_body_bottom(F.struct(F.lit(10).alias("y1"), F.lit(110).alias("y2"))),
            boxes.upper_body_bottom(F.struct(F.lit(10).alias("y1"), F.lit(10).alias("y2"))))
    assert r.c0 == 78


def test_to_frame_keeps_points_of_empty_crop(unit):
    p = _points([(1, 2, 1)])
    r = one(unit, pose.to_frame(p, F.lit(0), F.lit(10), F.lit(10), F.lit(10), F.lit(5), F.lit(5)))
    assert tuple(r.c0[0]) == (1.0, 2.0, 1.0)
