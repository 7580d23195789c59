"""Queries over the operators of this subpackage and the pipeline, with check texts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lessonlens.llm.collocations import collocation_report
from lessonlens.llm.jaccard_join import near_copies
from lessonlens.llm.license_scan import BASE, TEMPLATES, license_report, template_pattern
from lessonlens.llm.mixing import mix_report
from lessonlens.llm.packing import pack_documents
from lessonlens.llm.periodic_runs import run_report
from lessonlens.llm.pivot_search import top_k
from lessonlens.llm.prefix_counts import count_report
from lessonlens.llm.quality_rules import quality_report
from lessonlens.llm.rule_ensemble import quality_score_report
from lessonlens.llm.substring_dedup import dedup_report
from lessonlens.llm.toxic_spans import toxicity_report
from lessonlens.llm.warc import archive_report

QUERIES, CHECKS = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


@query("op10_mixing", """
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                      ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS ord FROM documents),
src AS (SELECT source, sum(size)::DOUBLE AS s, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)] AS w
        FROM sized GROUP BY source),
lev AS (SELECT *, 2 * s AS lim, ((SELECT sum(s) FROM src) * 1.5 - coalesce(sum(2 * s) OVER below, 0)) / sum(w) OVER rest AS level FROM src
        WINDOW below AS (ORDER BY 2 * s / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               rest AS (ORDER BY 2 * s / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
cutoff AS (SELECT (SELECT level FROM lev WHERE level * w <= lim ORDER BY lim / w LIMIT 1) AS level),
tgt AS (SELECT source, s, CASE WHEN cutoff.level IS NULL OR cutoff.level * w > lim THEN lim ELSE cutoff.level * w END AS target FROM lev, cutoff),
line AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
         FROM sized),
plan AS (SELECT *, sum(need) OVER (ORDER BY source IS NULL, source) AS upto, sum(need) OVER () AS total FROM (
  SELECT *, (goal // s) * ceil(s / 2048)::BIGINT + ceil((goal % s) / 2048)::BIGINT AS need
  FROM (SELECT source, s::BIGINT AS s, floor(target + 0.5)::BIGINT AS goal FROM tgt) WHERE s > 0 AND goal > 0)),
point AS (SELECT range AS slot, range * 0.6180339887498949::DOUBLE - floor(range * 0.6180339887498949::DOUBLE) AS point FROM range((SELECT max(total) FROM plan)::BIGINT)),
drawn AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
          FROM point JOIN plan ON point >= (upto - need)::DOUBLE / total::DOUBLE AND point < upto::DOUBLE / total::DOUBLE),
got AS (SELECT source, count(*) AS got FROM drawn GROUP BY source),
slots AS (SELECT d.source, slot, rank FROM drawn d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source WHERE rank < need UNION ALL
          SELECT source, total + upto - need + rank, rank FROM (SELECT p.*, unnest(range(coalesce(got, 0), need)) AS rank FROM plan p LEFT JOIN got g ON p.source IS NOT DISTINCT FROM g.source)),
took AS (SELECT line.*, s, target, least(greatest(floor(target + 0.5) - b, 0), size) + least(greatest(floor(target + 0.5) - s - b, 0), size) AS taken
         FROM line JOIN tgt ON line.source IS NOT DISTINCT FROM tgt.source)
SELECT doc_id, size::BIGINT AS size, s::BIGINT AS source_size, target, taken::BIGINT AS taken, slot::BIGINT AS first_slot
FROM took LEFT JOIN slots ON took.source IS NOT DISTINCT FROM slots.source AND rank = b // 2048 AND taken > 0""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


BASE_32_SQL = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {1 + 10 * part}, 10))::BIGINT >> {35 - 5 * digit}) & 31)::INT + 1, 1)"
    for part in range(4) for digit in range(8))


@query("op5_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, {BASE_32_SQL} AS payload_digest, max(page_id) OVER (PARTITION BY html) AS original FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to FROM d""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(table(spark, sf_dir, "pages"))


@query("op8_pivot_search", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 5""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


@query("op2_prefix_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_report(table(spark, sf_dir, "documents"))


@query("op3_toxic_spans")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_rule_ensemble")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_score_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_jaccard_join", """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')) AS g
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
          JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 5 * count(*) >= 4 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT r.a AS doc_id, min(r.b) AS class_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links
FROM reach r LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = r.a GROUP BY r.a""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


@query("op6_substring_dedup", """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
hit AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS low FROM win) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, range(0, 50) r(j)),
lists AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN w ELSE
              list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN lists l ON l.doc_id = w.doc_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query("op11_collocations", f"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w
               FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {A_TO_Z}), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY lang),
f AS (SELECT lang, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece), (SELECT unnest([1, 2, 3, 4]) AS k)
      WHERE i + k - 1 <= len(w) GROUP BY ALL),
c AS (SELECT lang, k AS m, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 30),
cut AS (SELECT lang, m, phrase, w, a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
        FROM c, (SELECT unnest([1, 2, 3]) AS k) WHERE k < m),
best AS (SELECT cut.lang, cut.phrase, a, x.f AS l, y.f AS r, ((2000000 * a::HUGEINT) // (x.f + y.f))::BIGINT AS score
         FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail
         QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY ((2000000 * a::HUGEINT) // (x.f + y.f)), cut.k) = 1),
inner_ AS (SELECT lang, array_to_string(w[s:s + size - 1], ' ') AS phrase, max(a) AS a
           FROM c, (SELECT unnest([1, 2, 3]) AS s), (SELECT unnest([2, 3]) AS size) WHERE size < m AND s + size - 1 <= m GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, n, score
FROM best b JOIN n ON n.lang = b.lang LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE i.a IS NULL OR 100 * i.a < 80 * b.a QUALIFY rank <= 2000""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation_report(table(spark, sf_dir, "documents"))


def license_sql() -> str:
    """The base rule over word lists; the templates as regular expressions over the words, a blank behind each."""
    words = "regexp_extract_all(translate(coalesce(text, ''), " + A_TO_Z + "), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    at = {p: "list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) + ")" for p in BASE}
    base = ", ".join(f"{places} AS {label}" for (p, label), places in zip(BASE.items(), at.values()))
    named_ = "list_filter([" + ", ".join(f"CASE WHEN len({x}) > 0 THEN '{x}' END" for x in BASE.values()) + "], lambda x: x IS NOT NULL)"
    own = "list_filter([" + ", ".join(
        f"CASE WHEN regexp_matches(words, '(^| )(?:{'|'.join(map(template_pattern, group))})') THEN '{label}' END"
        for label, group in TEMPLATES.items()) + "], lambda x: x IS NOT NULL)"
    return f"""
WITH t AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT doc_id, w, {base}, array_to_string(w, ' ') || ' ' AS words FROM t),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, list_concat(list_concat({', '.join(list(BASE.values())[:2])}), {list(BASE.values())[2]}) AS places,
             {named_} AS named, {own} AS own FROM b)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
       array_to_string(list_sort(named), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(named, own))), ',') AS labels,
       CASE WHEN len(own) > 0 THEN 1.0 WHEN len(places) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM m"""


@query("op12_license_templates", license_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
