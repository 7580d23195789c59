"""Collocations, license templates and periodic runs against plain versions, and on nulls, empties, long texts, repeats, odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lessonlens.llm import collocations as co, license_scan as li, periodic_runs as pr

DOCS = "doc_id long, text string, lang string"


# collocations

def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def plain_collocations(rows, o):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= o.min_count}
        hidden = {}
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    hidden[p[i:i + size]] = max(hidden.get(p[i:i + size], 0), a)
        found = []
        for p, a in candidates.items():
            if 100 * hidden.get(p, 0) >= o.contained_percent * a:
                continue
            score, k = min((o.scale * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:o.top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return Counter(out)


def spoken(seed, n=80):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "é", "city", "in", "日本", "a\x0bb", "x" * 100, "state"] + [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(n):
        out = []
        for _ in range(rng.choice([0, 1, 5, 30, 90])):
            out += rng.choice([["new", "York", "city"], ["of", "the"], ["new", "york"], ["the", "the", "the", "the", "the"], [rng.choice(words)]])
            if rng.random() < 0.1:
                out.append(rng.choice([".", ",", "!\n", "?"]))
        texts.append(" ".join(out))
    texts += [None, "", " \t ", ".,;", texts[3], texts[3], " ".join(words * 400)]
    return [(i, t, rng.choice(["en", "de", None, "und"])) for i, t in enumerate(texts)]


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("options", [
    co.Mining(min_count=4), co.Mining(min_count=3, listed=3, bucket_windows=150, hot=0.2), co.Mining(min_count=1, listed=0, top=25),
    co.Mining(min_count=2, listed=500, listed_bytes=3, hot=0.0, bucket_windows=400)])
def test_collocations_equal_the_plain_count(spark, options):
    rows = spoken(options.listed)
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = Counter(tuple(r) for r in co.collocation_report(docs, options).select(COLUMNS).collect())
    assert got == plain_collocations([(t, lang) for _, t, lang in rows], options)


def test_collocations_of_nothing_and_of_clashing_columns(spark):
    none = spark.createDataFrame([], DOCS)
    assert co.collocation_report(none).collect() == []
    docs = spark.createDataFrame([(None, "a b", None, 1, 2, "x")] * 31, DOCS + ", n long, c1 long, phrase string")
    assert [tuple(r) for r in co.collocation_report(docs).collect()] == [("und", 1, "a b", 31, 31, 31, 62, 1_000_000)]


def test_numbers_that_collide_get_another_seed(spark, monkeypatch):
    true = co.fingerprint
    rows = spoken(5)
    docs = spark.createDataFrame(rows, DOCS)
    options = co.Mining(min_count=4, listed=0)
    counts = co.word_counts(docs)
    first = co.numbers(counts, options)[0]
    assert first.seed == 0

    def clashing(lang, word, seed):
        return true(b"", b"same", 0) if seed < 2 and word in (b"the", b"of") else true(lang, word, seed)

    code = clashing.__code__
    assert code is not None
    monkeypatch.setattr(co, "_numbered", _numbered_by(clashing))
    assert co.numbers(counts, options)[0].seed == 2


def _numbered_by(mark):
    def numbered(counts, listed, seed, ranks):
        spark = counts.sparkSession
        rows = [(r.lang, r.word, r.n, ranks.get((bytes(r.lang), bytes(r.word))) or mark(bytes(r.lang), bytes(r.word), seed)) for r in counts.collect()]
        return spark.createDataFrame(rows, "lang binary, word binary, n long, id long")
    return numbered


def test_scores_past_64_bits(spark):
    huge = 2**61
    rows = [(1, 0, 0, 0, 3 * huge), (2, 0, 0, 0, huge + 7), (1, 2, 0, 0, huge)]
    counts = spark.createDataFrame(rows, "c1 long, c2 long, c3 long, c4 long, f long")
    [row] = co.scored(counts, co.Mining()).collect()
    assert row.score == 2_000_000 * huge // (4 * huge + 7) and (row.l, row.r) == (3 * huge, huge + 7)


def test_windows_survive_packing():
    rows = np.array([[-2**63 + 5, 70000, 3, 9], [1, 2, 0, 0], [1, 2, 5, 7], [1, 2, 5, 2**40], [1, 3, -9, 0], [2, 3, 4, 4]], np.int64)
    counts = np.array([3, 2**40, 1, 1, 5, 1])
    assert co.unpacked(co.packed(rows, counts)).tolist() == [*rows.T.tolist(), counts.tolist()]
    assert co.unpacked(co.packed(rows[:1], counts[:1])).tolist() == [*rows[:1].T.tolist(), [3]]


# license templates

def filled(markup, rng):
    def of(parts):
        out = []
        for p in parts:
            if p.word:
                out.append(p.word)
            elif p.parts is not None:
                out += of(p.parts) if rng.random() < 0.5 else []
            else:
                out += [rng.choice(["alice", "bob", "é", "the"]) for _ in range(rng.randint(p.lo, p.hi))]
        return out
    return of(li.regions(markup))


def licensed(seed=2):
    rng = random.Random(seed)
    every = [(label, t) for label, group in li.TEMPLATES.items() for t in group]
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(4)):
            words += [rng.choice(["foo", "mit", "license", "apache", "licensed", "under", "the", "BAR", "é9"]) for _ in range(rng.randrange(6))]
            own = filled(rng.choice(every)[1], rng)
            if rng.random() < 0.4:
                k = rng.randrange(len(own))
                own[k:k + 1] = rng.choice([[], ["other"], [own[k], own[k]]])
            words += own
        texts.append("".join((w.upper() if rng.random() < 0.1 else w) + rng.choice([" ", "\n", ", ", "-"]) for w in words))
    texts += [None, "", " .. ", "mit license", "MIT\x00License mit license", "general public license\n" * 3, "mit", "license mit", texts[0], "a " * 50_000 + "apache license"]
    return texts


def plain_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places = [(i, label) for phrase, label in li.BASE.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    line = "".join(w + " " for w in words)
    own = {label for label, group in li.TEMPLATES.items() if any(re.search(f"(?:^| ){li.template_pattern(t)}", line) for t in group)}
    base = {label for _, label in places}
    return (len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
            ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if own else 0.5 if base else 0.0)


def test_licenses_equal_regular_expressions(spark):
    texts = licensed()
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in li.license_report(docs).collect()}
    assert got == {i: plain_license(t) for i, t in enumerate(texts)}
    assert sum(1 for v in got.values() if v[6] == 1) > 50 and sum(1 for v in got.values() if v[6] == 0) > 10


def test_license_matches_keep_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "x Licensed under CC BY-NC 4.0. y", "a"), (None, None, "b"), (1, "x Licensed under CC BY-NC 4.0. y", "a")],
                                 "doc_id long, body string, text_ string")
    rows = li.license_matches(docs, "body").collect()
    assert rows[0].asDict(True) == {"doc_id": 1, "body": docs.first().body, "text_": "a", "matches": [{"label": "cc-by-nc", "start": 1, "words": 7}]}
    assert rows[1].matches == [] and rows[2] == rows[0]
    assert li.license_report(spark.createDataFrame([], DOCS)).collect() == []


def test_templates_nest_and_refuse_bad_markup():
    own = {"t": ("a <<beginOptional>>b <<beginOptional>>c<<endOptional>> <<endOptional>> <<var 1 2>> d",)}
    scan = li.Scanner(own, {})
    texts = ["a b c x d", "a x d", "a b x y d", "a d", "a x y z d", "a b c d", "a c d", "a b b c d d"]
    got = [[(start, size) for _, start, size in m] for _, _, m in li.scanned(pa.array([t.encode() for t in texts]), scan)]
    plain = [[(0, m.end() // 2)] if (m := re.match(li.template_pattern(own["t"][0]), t + " ")) else [] for t in texts]
    assert [bool(g) for g in got] == [bool(p) for p in plain] and got[0] == [(0, 5)] and got[3] == [] and got[4] == []
    for bad in ("<<beginOptional>>a", "a<<endOptional>>b", "<<var 1 2>> a", "a <<var 3 2>> b", ""):
        with pytest.raises(ValueError):
            li.regions(bad)


# periodic runs

def plain_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.add((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeating(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        kind = rng.randrange(5)
        if kind == 0:
            yield [rng.choice("ab") for _ in range(rng.randrange(150))]
        elif kind == 1:
            p = [rng.choice("abc") for _ in range(rng.randrange(1, 40))]
            yield [rng.choice("abc") for _ in range(rng.randrange(9))] + p * rng.randrange(1, 9) + p[:rng.randrange(len(p))] + [rng.choice("ab")] * rng.randrange(9)
        elif kind == 2:
            p = (["x"] * rng.randrange(1, 8) + ["y"]) * rng.randrange(1, 6) + ["é"]
            yield p * rng.randrange(1, 8)
        elif kind == 3:
            a, b = "a", "ab"
            for _ in range(rng.randrange(2, 11)):
                a, b = b, b + a
            yield list(b)
        else:
            yield [rng.choice("abcdefgh") for _ in range(rng.randrange(60))]


def test_runs_equal_brute_force():
    for seed in range(40):
        texts = list(repeating(seed, 6))
        column = pa.array([None, *[" \n".join(t).encode() for t in texts]], pa.binary())
        got = [[(int(a), int(b - a), int(q)) for a, b, q in runs] for part in pr.parts(column, lambda i, n: None, pr.Runs()) for runs in part.runs]
        assert got == [[], *map(plain_runs, texts)]


def test_wavelet_tree_answers_ranges():
    rng = np.random.default_rng(1)
    values = rng.permutation(300)
    tree = pr.WaveletTree(values, 299)
    for _ in range(300):
        lo, hi = sorted(rng.choice(301, 2, replace=False))
        x = int(rng.choice(values[lo:hi]))
        own = np.sort(values[lo:hi])
        k = int(np.searchsorted(own, x))
        larger, smaller = tree.neighbours(np.array([lo]), np.array([hi]), np.array([x]), 1000)
        assert larger[0] == (own[k + 1] if k + 1 < len(own) else x + 1000) and smaller[0] == (own[k - 1] if k else x - 1000)


def plain_report(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_run_report_equals_brute_force(spark):
    rows = [(i, " ".join(t), i) for i, t in enumerate(repeating(77, 200))]
    rows += [(900, None, 1), (901, "", 1), (902, " \t\n", 1), (None, "a a a a a a a", 1), (903, "é\x85b \x1cq " * 9, 1), rows[3], rows[3],
             (904, " ".join(f"w{k % 7}" if k < 6000 else f"v{k}" for k in range(9000)), 1), (905, "same " * 3000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period long").repartition(3)
    got = Counter((r[0], *r[1:]) for r in pr.run_report(docs).collect())
    assert got == Counter((i, *plain_report(i, t)) for i, t, _ in rows)
    assert sum(1 for i, _, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 10 == 0) > 5
    assert pr.run_report(spark.createDataFrame([], DOCS)).collect() == []


def test_periodic_runs_give_spans_and_texts(spark):
    docs = spark.createDataFrame([(1, "x a b a b a b a b y", "r", 5), (2, None, "s", 6)], "`doc.id` long, text string, runs string, at_ long")
    one, two = periodic = pr.periodic_runs(docs).collect()
    assert ["doc.id", "text", "at_", "runs", "collapsed_text"] == list(periodic[0].asDict())
    assert [tuple(r) for r in one.runs] == [(1, 8, 2)] and one.collapsed_text == "x a b y" and one.text == docs.first().text and one.at_ == 5
    assert two.runs == [] and two.collapsed_text == "" and two.text is None
    assert pr.periodic_runs(docs.where(F.lit(False))).collect() == []
    with pytest.raises(ValueError):
        pr.runs_of(np.zeros(20, np.int64), 20, pr.Runs(min_exponent=2))
