"""The fixture views as DuckDB text, used only to check results."""

from __future__ import annotations

import re

SIT = "CASE event_type WHEN 'click' THEN '書く' WHEN 'purchase' THEN '話し合う' ELSE '聞く' END"
_RATING = "1 + (CAST(l_quantity AS INT) - 1) % 7"

VIEWS: dict[str, str] = {
    "pred": f"""SELECT concat('lesson_', lpad(CAST(day(ts) AS VARCHAR), 2, '0')) AS video_path, event_id AS frame_idx,
        CAST(hour(ts)*3600 + minute(ts)*60 + second(ts) AS DOUBLE) / CAST(24 AS DOUBLE) AS t, user_id AS track_id,
        least(CAST(7 AS DOUBLE), CAST(1 AS DOUBLE) + sqrt(value) / CAST(3.7 AS DOUBLE)) AS score,
        {SIT} AS situation FROM events""",
    "predlog": """SELECT video_path, frame_idx, t, track_id, score,
        CAST(least(7, greatest(1, round_even(score, 0))) AS INT) AS score_clamped, situation,
        CAST(0.5 AS DOUBLE) + sqrt(CAST(frame_idx % 50 AS DOUBLE)) / CAST(15 AS DOUBLE) AS situation_confidence,
        CASE WHEN t >= 1800 AND t < 2100 THEN 'AB' END AS situation_override FROM pred""",
    "detections": """SELECT e.event_id AS id, p.video_path, p.frame_idx, p.t, p.track_id, e.value AS x1, e.value AS y1,
        e.value + 50 AS x2, e.value + 100 AS y2, e.value / CAST(500 AS DOUBLE) AS conf
        FROM events e JOIN pred p ON p.frame_idx = e.event_id""",
    "rate": f"""SELECT l_orderkey AS segment_id, concat('r', CAST(l_linenumber AS VARCHAR)) AS rater,
        {_RATING} AS score, l_shipdate AS updated_at FROM lineitem""",
    "ratings": """SELECT segment_id, rater, score, updated_at FROM (SELECT *, row_number() OVER (
        PARTITION BY segment_id, rater ORDER BY updated_at DESC, score DESC) AS k FROM rate) WHERE k = 1""",
    "win": """SELECT DISTINCT o_orderkey % 500 AS window_id, CAST((o_orderkey % 500)*5 AS DOUBLE) AS t_start,
        CAST((o_orderkey % 500)*5+5 AS DOUBLE) AS t_end,
        CASE CAST(floor((o_orderkey % 500)/CAST(20 AS DOUBLE)) AS INT) % 3
          WHEN 0 THEN '聞く' WHEN 1 THEN '書く' ELSE '話し合う' END AS situation FROM orders""",
    "lwin": """SELECT window_id, 1 AS video_id, t_start, t_end,
        CASE WHEN window_id % 13 <> 0 THEN situation END AS situation,
        CASE WHEN window_id % 13 <> 0 THEN concat('teacher', CAST(window_id % 2 AS VARCHAR)) END AS situation_set_by,
        window_id % 7 <> 0 AS situation_locked FROM win""",
    "seg": "SELECT o_orderkey AS segment_id, o_orderkey % 500 AS window_id, o_custkey AS track_id FROM orders",
    "excluded": "SELECT o_orderkey AS segment_id, 'adult' AS reason FROM orders WHERE o_orderstatus = 'P'",
    "skips": "SELECT DISTINCT 'r1' AS rater, o_orderkey % 500 AS window_id FROM orders WHERE (o_orderkey % 500) % 11 = 0",
    "frames": """SELECT l_orderkey AS segment_id,
        CAST(l_orderkey % 500 * 5 AS DOUBLE) + (l_partkey % 11) * CAST(0.5 AS DOUBLE) AS t,
        l_partkey * 10 + l_linenumber AS frame_idx,
        concat('data/assets/crops/P', CAST(l_partkey AS VARCHAR), '_s', CAST(l_suppkey % 3 AS VARCHAR), '.jpg') AS crop_path
        FROM lineitem""",
    "pairs": f"""SELECT s_nationkey AS school_id,
        CASE WHEN l_shipdate < TIMESTAMP '1998-06-01 00:00:00' THEN 'pre' ELSE 'post' END AS phase,
        CAST({_RATING} AS DOUBLE) AS human_score,
        CAST({_RATING} AS DOUBLE) + (l_discount - CAST(0.05 AS DOUBLE)) * CAST(20 AS DOUBLE) AS model_score
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "trial": """SELECT c_nationkey AS school_id, c_mktsegment AS class_id,
        CASE WHEN o_orderdate < TIMESTAMP '1998-06-01 00:00:00' THEN 'pre' ELSE 'post' END AS phase,
        CAST(1 AS DOUBLE) + o_totalprice % CAST(6 AS DOUBLE) AS classroom_score
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "points": """SELECT vec_id, label AS segment_id, i AS k, CAST(embedding[3*i+1] AS DOUBLE) AS x,
        CAST(embedding[3*i+2] AS DOUBLE) AS y, abs(CAST(embedding[3*i+3] AS DOUBLE)) AS conf
        FROM embeddings, range(0, 17) AS r(i)""",
    "faces": "SELECT vec_id, concat('p', CAST(label AS VARCHAR)) AS name, embedding AS emb FROM embeddings",
    "runs": """SELECT o_orderpriority AS variant, CAST(o_orderkey % 2 AS INT) AS seed, CAST(o_orderkey % 4 AS INT) AS fold,
        CAST(o_orderkey % 25 AS INT) AS epoch, avg(sqrt(o_totalprice) / CAST(700 AS DOUBLE)) AS val_exact_accuracy,
        avg(sqrt(o_totalprice + 1) / CAST(400 AS DOUBLE)) AS val_mae, avg(sqrt(o_totalprice + 2) / CAST(800 AS DOUBLE)) AS val_qwk,
        avg(sqrt(o_totalprice + 3) / CAST(300 AS DOUBLE)) AS val_mse FROM orders GROUP BY 1, 2, 3, 4""",
}


def _uses(text: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{v}\b|,\s*{v}\b(?=\s*(?:,|WHERE|\)|$))", text, re.IGNORECASE)]


def with_views(sql: str, **extra: str) -> str:
    """Prefix ``sql`` with the views (and named extra steps) it reads."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for v in _uses(text):
            if v not in needed:
                visit(VIEWS[v])
                needed.append(v)

    for step in extra.values():
        visit(step)
    visit(sql)
    steps = [f"{v} AS ({VIEWS[v]})" for v in needed] + [f"{n} AS ({s})" for n, s in extra.items()]
    return f"WITH RECURSIVE {', '.join(steps)} {sql}" if steps else sql
