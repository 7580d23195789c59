"""The ten operators against plain versions on small tables, and their behaviour on nulls, empties, ties and odd columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from lessonlens.llm import jaccard_join, mixing, packing, pivot_search, prefix_counts, quality_rules, rule_ensemble
from lessonlens.llm import substring_dedup, toxic_spans, warc, words
from lessonlens.llm.components import components
from lessonlens.llm.tokenizing import WordIds, load, vocabulary
from lessonlens.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def split(text):
    return WORD.findall(text or "")


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, nulls, empties, odd white space, one long text and repeated rows."""
    rng = random.Random(seed)
    vocabulary_ = ["a", "the", "thon", "é", "ßü", "x1", "ing,", "It's", "日本", "zero", "seven", "*%$", "Inth", "of"]
    passage = [rng.choice(vocabulary_) + str(rng.randrange(50)) for _ in range(64)]
    texts = []
    for k in range(n):
        own = [rng.choice(vocabulary_) + str(rng.randrange(400)) for _ in range(rng.choice([3, 12, 60, 150]))]
        if k % 4 == 1:
            at = rng.randrange(len(own))
            own[at:at] = passage
        if k % 5 == 2 and texts:
            own = split(rng.choice(texts))
            for _ in range(rng.randrange(3)):
                if own:
                    own[rng.randrange(len(own))] = "edit"
        texts.append("".join(w + rng.choice([" ", " ", "  ", "\n", "\t"]) for w in own))
    texts += [None, "", "   ", "\x1c\x85 a b", " ".join(f"w{i % 977}" for i in range(30000)), texts[0], texts[1]]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[2], None, "s1", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def bag(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_words_match_the_pattern():
    texts = [t for _, t, *_ in corpus()]
    column = pa.array([t.encode() if t is not None else None for t in texts], pa.binary()).slice(2)
    got = []
    for b in words.blocks(column):
        for i in range(b.size):
            k = range(b.cuts[i], b.cuts[i + 1])
            got.append([(b.data[b.starts[j]:b.ends[j]].tobytes().decode(), int(b.hashes[j])) for j in k])
    assert [[w for w, _ in g] for g in got] == [split(t) for t in texts[2:]]
    meaning = {}
    for w, h in itertools.chain(*got):
        assert meaning.setdefault(h, w) == w
    assert len(set(meaning.values())) == len(meaning)


def test_words_longer_than_a_block(monkeypatch):
    text = ("abc " * 50 + "y" * 5000 + " abc " * 30).encode()
    whole = next(words.blocks(pa.array([text]))).hashes
    monkeypatch.setattr(words, "BLOCK", 64)
    cut = next(words.blocks(pa.array([text])))
    assert (cut.hashes == whole).all()


@pytest.mark.parametrize("width", [1, 2, 5, 8, 10, 50])
def test_rolling_tells_windows_apart(width):
    h = words.mix(np.random.default_rng(3).integers(0, 6, 400).astype(np.uint64))
    windows = [tuple(h[i:i + width]) for i in range(len(h) - width + 1)]
    assert len(set(zip(windows, words.rolling(h, width).tolist()))) == len(set(windows)) == len(set(words.rolling(h, width).tolist()))
    assert len(words.rolling(h[:width - 1], width)) == 0


# --- 7


def plain_quality(text, bands=quality_rules.Bands()):
    w, raw = split(text), (text or "").encode()
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    inside = {p for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    zipped = lambda x: len(zstandard.ZstdCompressor(level=3).compress(x)) / len(x)
    _, low, high = next(b for b in bands.limits if len(raw) < b[0])
    chunks = [raw[i:i + 2048] for i in range(0, len(raw) - 2047, 2048)]
    bad = sum(not bands.chunk_limits[0] <= zipped(c) <= bands.chunk_limits[1] for c in chunks)
    fits = bool(raw) and low <= zipped(raw) <= high and bad <= 0.5 * len(chunks)
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), failed,
            not failed and fits)


def test_quality_rules(docs, none):
    got = bag(quality_rules.quality_report(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
              "base_failed", "kept")
    assert got == Counter((i, *plain_quality(t)) for i, t, *_ in corpus())
    assert quality_rules.quality_report(none).collect() == []
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert bag(kept, *docs.columns) == Counter(r for r in corpus() if plain_quality(r[1])[-1])


def test_quality_rejects_repetition_and_noise(spark):
    rng = random.Random(5)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(12)) for _ in range(400))
    alike = " ".join(f"{w}!!" for w in ["ERST", "THE"] * 3 + [f"Q{i % 9}" for i in range(7)] for _ in range(1)) * 40
    df = spark.createDataFrame([(1, noise), (2, alike)], "doc_id long, text string")
    assert not any(r["kept"] for r in quality_rules.quality_report(df).collect())


BASE_64 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"


def noise_words(rng, size):
    out = ""
    while len(out) < size:
        out += "".join(rng.choice(BASE_64) for _ in range(rng.randrange(4, 9))) + " "
    return out[:size]


def prose_words(rng, size):
    syllables = ["ta", "ren", "mo", "sil", "ver", "en", "the", "ing", "ko", "lu"]
    known, out = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(900)], ""
    while len(out) < size:
        out += rng.choice(known) + " "
    return out[:size]


def test_quality_rejects_noise_of_every_length(spark):
    rng = random.Random(11)
    sizes, made = [150, 300, 800, 1500], {}
    for k in range(10):
        made |= {("noise", n, k): noise_words(rng, n) for n in sizes} | {("prose", n, k): prose_words(rng, n) for n in [*sizes, 8192]}
        made |= {("half", 8192, k): prose_words(rng, 4096) + noise_words(rng, 4096), ("tail", 4000, k): prose_words(rng, 2048) + noise_words(rng, 1952)}
    keys = list(made)
    df = spark.createDataFrame([(i, made[key]) for i, key in enumerate(keys)], "doc_id long, text string")
    rows = {keys[r["doc_id"]]: r for r in quality_rules.quality_report(df).collect()}
    # the twenty-words rule is not what is tested: 150 bytes of noise hold about as many words
    fits = [key for key in keys if not rows[key]["base_failed"]]
    assert {key[:2] for key in fits} == {key[:2] for key in keys}
    assert {key for key in fits if rows[key]["kept"]} == {key for key in fits if key[0] == "prose"}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b " * 30, 5, True)], "doc_id long, text string, n_words int, Kept boolean")
    assert quality_rules.quality_verdicts(df).columns.count("n_words") == 1
    assert quality_rules.keep_good(df).columns == df.columns


def test_any_column_name_is_carried(spark):
    """The rows that stay keep the values of columns that are called like the operators' own."""
    inner = ["size", "pass", "cut_", "row_", "gone_", "__starts", "starts", "source_size", "begin", "block", "slot", "i_", "r_", "got_", "a.b", "d_", "x0",
             "order_", "words", "digest", "text_", "c0", "m0", "kept"]
    data = [(i, " ".join(f"w{i}x{k}" for k in range(70)), "s", *[f"{i}{n}" for n in inner]) for i in range(6)]
    data.append((9, data[0][1], "s", *[f"9{n}" for n in inner]))
    df = spark.createDataFrame(data, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in inner))
    rest = {i: tuple(r) for i, _, _, *r in data}
    for out, ids in ((jaccard_join.one_of_each(df), range(6)), (substring_dedup.without_repeats(df), range(6)), (mixing.mix_documents(df), None)):
        rows_ = out.collect()
        assert out.columns == df.columns and len(rows_) > 3
        assert all(tuple(r)[3:] == rest[r["doc_id"]] for r in rows_)
        assert ids is None or sorted(r["doc_id"] for r in rows_) == list(ids)


# --- 10


def test_mixing(docs, none):
    rows = corpus()
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(split(t))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: 2.0 * sizes[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    mix = mixing.Mix(block_tokens=64, chunk_rows=5, slot_chunk=50, cells=8)
    got = mixing.mix_report(docs, mix).collect()
    assert len(got) == len(rows)
    by_id = {i: (len(split(t)), s) for i, t, _, s, _ in rows}
    taken = defaultdict(int)
    for r in got:
        size, source = by_id[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size, sizes[source]) and 0 <= r["taken"] <= 2 * size
        assert r["target"] == pytest.approx(target[source])
        taken[source] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.mix_report(docs.repartition(7), mix)
    assert bag(again, "doc_id", "taken") == Counter((r["doc_id"], r["taken"]) for r in got)
    assert mixing.mix_report(none).collect() == []


def test_schedule_is_even(spark):
    targets = spark.createDataFrame([("a", 1000, 3.0, 1500.0), ("b", 4000, 1.0, 500.0), (None, 9000, 2.0, 1000.0), ("z", 0, 1.0, 0.0)],
                                    "source string, source_size long, w double, target double")
    slots = mixing.schedule(targets, mixing.Mix(block_tokens=10)).orderBy("slot").collect()
    for source, tokens in (("a", 1500), ("b", 500), (None, 1000)):
        own = [r for r in slots if r["source"] == source]
        assert sum(r["tokens"] for r in own) == tokens and sorted(r["rank"] for r in own) == list(range(len(own)))
    for cut in (30, 100, 200):
        share = sum(r["source"] == "a" for r in slots[:cut]) / cut
        assert abs(share - 0.5) < 0.1


def test_mixed_documents(docs, spark):
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    mix = mixing.Mix(block_tokens=64)
    report = {r["doc_id"]: r["taken"] for r in mixing.mix_report(plain, mix).collect()}
    out = mixing.mix_documents(plain, mix)
    corpus_ = sorted(mixing.mixed_corpus(plain, mix).collect(), key=lambda r: (r["slot"], r["place"]))
    whole = {r["doc_id"]: split(r["text"]) for r in plain.collect()}
    got_ = Counter()
    for r in corpus_:
        assert split(r["text"]) == whole[r["doc_id"]][r["first_word"]:r["first_word"] + r["words"]] and r["words"] > 0
        got_[r["doc_id"]] += r["words"]
    assert got_ == Counter({i: n for i, n in report.items() if n})
    by_slot = Counter()
    for r in corpus_:
        by_slot[r["slot"]] += r["words"]
    assert max(by_slot.values()) <= 64
    first = {}
    for r in corpus_:
        first.setdefault(r["doc_id"], r["slot"])
    assert {r["doc_id"]: r["first_slot"] for r in mixing.mix_report(plain, mix).collect() if r["taken"]} == first
    assert out.columns == docs.columns
    taken = defaultdict(int)
    whole = {r[0]: r[1] for r in corpus()}
    for r in out.collect():
        assert split(whole[r["doc_id"]])[:len(split(r["text"]))] == split(r["text"])
        taken[r["doc_id"]] += len(split(r["text"]))
    assert {i: n for i, n in report.items() if n} == dict(taken)


# --- 9


@pytest.mark.parametrize("seed", range(4))
def test_best_fit(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(1, 64) for _ in range(400)), reverse=True)
    sequences, offsets = packing.best_fit(lengths, 64)
    rooms = []
    for length, sequence, offset in zip(lengths, sequences, offsets):
        fits = [room for room in rooms if room >= length]
        if fits:
            assert 64 - offset == min(fits) == rooms[sequence]
        else:
            assert sequence == len(rooms) and offset == 0
            rooms.append(64)
        rooms[sequence] -= length


def test_packing(docs, none):
    tokenizer = load(vocabulary("word_bpe_49k.json"))
    want = Counter()
    for i, t, *_ in corpus():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            own = ids[start:start + 2048]
            want[i, piece, start, len(own), zlib.crc32(own.tobytes())] += 1
    got = packing.pack_documents(docs)
    assert bag(got, "doc_id", "piece", "start", "length", "ids_crc32") == want
    filled = defaultdict(int)
    for r in got.orderBy("sequence_id", "offset").collect():
        assert filled[r["sequence_id"]] == r["offset"]
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048
    assert len(filled) <= sum(k[3] * n for k, n in want.items()) / 2048 + 2
    assert packing.pack_documents(none).collect() == []


def test_word_ids_equal_the_library():
    own = WordIds.of(vocabulary("word_bpe_49k.json"))
    rng = random.Random(2)
    bits = ["The", " ", "  ", "\n", "'S", "'ll", "Σ", "İx", "é", "\x1c", " ", "<|endoftext|>", "12", "..,", "日本", "x" * 100, "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    assert [own.ids(t) for t in texts] == own.direct(texts)


# --- 2


def test_counts_of_every_prefix():
    path = vocabulary("byte_bpe_50k.json")
    counter, tokenizer = prefix_counts.PrefixCounter.of(path), load(path)
    n = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    rng = random.Random(4)
    bits = ["a", "the", " ", "  ", "\n", "\t", "'re", "'ll", "'s", "'", "é", "日本", "<|endoftext|>", "<|end", "123", "!?", " ", "\x1c",
            "\r\n", "😀", "thtionble", " Ing", "'VE"]
    for _ in range(250):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        assert np.cumsum(counter.steps(t), dtype=np.int64).tolist() == [n(t[:i]) for i in range(1, len(t) + 1)], repr(t)
        assert counter.total(t) == n(t)


def test_token_counts(docs, none):
    tokenizer = load(vocabulary("byte_bpe_50k.json"))
    n = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    got = prefix_counts.count_report(docs)
    assert bag(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == Counter(
        (i, len((t or "").encode()), n(t or ""), n(t or "") > 1024) for i, t, *_ in corpus())
    for r in got.where("over_limit").collect():
        text = {i: t for i, t, *_ in corpus()}[r["doc_id"]]
        assert n(text[:r["fitting_chars"]]) <= 1024 < n(text[:r["fitting_chars"] + 1])
    stored = prefix_counts.prefix_counts(docs.where("doc_id < 5"))
    marks = {r["doc_id"]: r["steps_crc32"] for r in got.collect()}
    assert {r["doc_id"]: zlib.crc32(r["prefix_steps"]) for r in stored.collect()} == {i: marks[i] for i in range(5)}
    for r in prefix_counts.budget_answers(stored, 20, 30).collect():
        assert r["prefix_tokens"] == n(r["text"][:30]) and n(r["text"][:r["fitting_chars"]]) <= 20
    assert prefix_counts.count_report(none).collect() == []


# --- 5


def test_archive_times_names_and_file_sizes(spark, tmp_path):
    """Dates are in UTC whatever the session's zone; names of revisits are unique; a file holds a bounded number of bytes."""
    import datetime

    pages = [(i, f"http://h/{i}", "same" if i < 40 else "x" * (1000 + i)) for i in range(60)] + [(3, "http://h/3", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        warc.write_archives(df, str(tmp_path / "w"), warc.Archive(codec="none", file_bytes=60_000))
        now = datetime.datetime.now(datetime.timezone.utc)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    files = [f.read_bytes() for f in (tmp_path / "w").glob("part-*")]
    assert len(files) >= 4 and max(map(len, files)) < 60_000
    names = re.findall(rb"WARC-Record-ID: (\S+)", b"".join(files))
    assert len(names) == 61 and len(set(names)) == 61
    dates = {datetime.datetime.fromisoformat(d.decode()) for d in re.findall(rb"WARC-Date: (\S+)", b"".join(files))}
    assert all(abs((now - d).total_seconds()) < 600 for d in dates)
    assert set(re.findall(rb"WARC-Refers-To: (\S+)", b"".join(files))) <= set(names)


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/", "<p>one"), (2, "http://b/\r\nX: y", "<p>one"), (3, None, None), (4, "u", ""), (5, "u", "WARC/1.1\r\nWARC-Type: x\r\n\r\n" * 3),
             (6, "u", "é\r\n\r\n"), (7, "u", "<p>one"), (8, "u", "long " * 5000), (9, "u", "last"), (9, "u", "last"), (None, "u", "<p>one")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    groups = defaultdict(list)
    for i, _, html in pages:
        groups[html or ""].append(i)
    import base64

    want = Counter()
    for i, _, html in pages:
        top = max(x for x in groups[html or ""] if x is not None)
        raw = (html or "").encode()
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == top else "revisit", None if i == top else top] += 1
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert bag(warc.archive_report(df), *columns) == want
    path = scratch_path(spark, "warc-test")
    warc.write_archives(df, path, warc.Archive(min_bytes=5, records_per_file=2, codec="none"))
    rows = warc.read_archives(spark, path).collect()
    assert {r["page_id"] for r in rows if r["record_type"] == "response"} >= {3, 4, 9}
    assert {r["payload"].decode() for r in rows if r["payload"] is not None} == {html or "" for _, _, html in pages}
    assert warc.archive_report(df.limit(0)).collect() == []


# --- 8


def test_pivot_search(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, (rng.normal(size=6) if i % 3 else np.ones(6) * 0.5).astype(np.float32).tolist()) for i in range(300)]
    odd = [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] + [0.0] * 5), (403, [float("inf")] + [0.0] * 5),
           (None, vectors[1][1]), vectors[7], (450, [1.0, 2.0]), (451, [2.0, 1.0]), (500, [])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>")
    usable = {i: [int(np.floor(256 * np.float64(np.float32(x)))) for x in v] for i, v in vectors + [(450, [1.0, 2.0]), (451, [2.0, 1.0]), (500, [])]}
    want = set()
    for q in usable:
        if q % 50 == 0:
            hits = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(hits[:5])}
    got = pivot_search.top_k(df, pivot_search.Search(vector_block=70, query_block=2, step=8))
    assert bag(got, "query_id", "rank", "vec_id", "score") == Counter(want)
    assert pivot_search.top_k(df.limit(0)).collect() == []


# --- 1


def plain_groups(rows):
    sets = {}
    for k, (i, t, *_) in enumerate(rows):
        w = split(t)
        n = min(5, len(w))
        sets[k] = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} if w and i is not None else set()
    links, root = Counter(), {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for k in sets:
        if rows[k][0] is not None:
            least[find(k)] = min(least.get(find(k), 10**9), rows[k][0])
    return Counter((rows[k][0], least.get(find(k)) if rows[k][0] is not None else None, links[k]) for k in sets)


@pytest.mark.parametrize("block", [4, 512])
def test_near_copies(docs, none, block):
    got = jaccard_join.near_copies(docs, jaccard_join.Join(block_texts=block))
    assert bag(got, "doc_id", "class_id", "n_links") == plain_groups(corpus())
    assert jaccard_join.near_copies(none).collect() == []


def test_one_of_each(docs):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = {i for i, c, _ in plain_groups(corpus()) if i == c}
    assert bag(kept, "doc_id") == Counter((i,) for i, *_ in corpus() if i in ids)


def test_band_recall():
    join = jaccard_join.Join()
    assert 1 - (1 - join.threshold**join.rows) ** join.bands >= join.recall


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (60, 60), (5, 20)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 60: 60}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 6


def plain_repeats(rows, window=50):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            w = split(t)
            for j in range(len(w) - window + 1):
                key = tuple(w[j:j + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        w = split(t)
        gone = {p for j in range(len(w) - window + 1) if i is not None and least[tuple(w[j:j + window])] < i for p in range(j, j + window)}
        out.append((i, w, [x for p, x in enumerate(w) if p not in gone]))
    return out


@pytest.mark.parametrize("repeats", [substring_dedup.Repeats(), substring_dedup.Repeats(window=9, gram=3, hot=2, group_windows=50)])
def test_repeats(docs, none, repeats):
    want = Counter((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
                   for i, w, kept in plain_repeats(corpus(), repeats.window))
    assert bag(substring_dedup.dedup_report(docs, repeats), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert substring_dedup.dedup_report(none, repeats).collect() == []


def test_settled_starts_of_copies_spread(spark):
    text = " ".join(f"w{i}" for i in range(120))
    rows = [(i, text, "en", "s", len(text)) for i in range(400)]
    df, repeats = spark.createDataFrame(rows, DOCS).repartition(3), substring_dedup.Repeats(group_windows=200)
    keyed = substring_dedup.keyed(df)
    found = substring_dedup.shared_anchors(substring_dedup.anchors(df, repeats), repeats)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        starts = substring_dedup.repeated_starts(keyed, found, repeats).select(F.spark_partition_id().alias("p"), F.length("starts").alias("n"))
        shares = [r["n"] for r in starts.groupBy("p").agg(F.sum("n").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(shares) >= 4 * 399 * 71
    assert max(shares) < sum(shares) / 2


def test_rows_that_repeat_id_and_text_give_places_once(spark):
    text = " ".join(f"w{i}" for i in range(120))
    rows = [(i, text, "en", "s", len(text)) for i in [1] + [2] * 60]
    df, repeats = spark.createDataFrame(rows, DOCS).repartition(4), substring_dedup.Repeats()
    found = substring_dedup.shared_anchors(substring_dedup.anchors(df, repeats), repeats).collect()
    assert len(found) == 2 and all(len(r["places"]) == len(set(r["places"])) for r in found)
    got = substring_dedup.dedup_report(df, repeats).collect()
    assert Counter((r["doc_id"], r["n_removed"]) for r in got) == {(1, 0): 1, (2, 120): 60}


def test_documents_without_repeats(docs):
    got = substring_dedup.without_repeats(docs)
    assert got.columns == docs.columns
    want = Counter((i, " ".join(kept)) for i, w, kept in plain_repeats(corpus()) if kept)
    assert Counter((r["doc_id"], " ".join(split(r["text"]))) for r in got.collect()) == want


# --- 3 and 4


def labelled(n=240, seed=8):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice(["th", "on", "er", "ing", "ea"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(25, 90))]
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["scoundrel", "Vermin,", "halfwit."])
        rows.append((i, " ".join(w) if good else " ".join(x + "$$$" for x in w), "en", "s", 0))
        labels.append((i, int(good), int(toxic)))
    return rows + [(1000, None, None, None, 0), (1001, "", None, None, 0)], labels


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    e, step, start = rng.normal(size=9), rng.normal(size=(2, 2)), 0.3
    cuts = np.array([0, 4, 4, 5, 9])
    p, _, _ = toxic_spans.marginals(e, cuts, step, start)
    for a, b in zip(cuts[:-1], cuts[1:]):
        total, marked = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a) if b > a else ():
            s = sum(e[a + i] for i in range(b - a) if y[i]) + start * y[0] + sum(step[y[i], y[i + 1]] for i in range(b - a - 1))
            total += np.exp(s)
            marked += np.exp(s) * np.array(y)
        if b > a:
            assert np.allclose(marked / total, p[a:b])


def test_toxicity(spark, none):
    rows, labels = labelled()
    df, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxic_spans.toxicity_report(df, marks).collect()
    assert len(got) == len(rows)
    truth, text = {i: t for i, _, t in labels}, {r[0]: r[1] for r in rows}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["predicted"] == (r["score"] >= 0.3) == truth.get(r["doc_id"], 0)
        if r["held_out"] and truth.get(r["doc_id"]):
            found = {text[r["doc_id"]][s["begin"]:s["end"]].strip("$,.") for s in r["spans"]}
            assert any(f in x for x in found for f in ("scoundrel", "Vermin", "halfwit"))
    assert toxic_spans.toxicity_report(none, marks).collect() == []
    assert {r["predicted"] for r in toxic_spans.toxicity_report(df, marks.limit(0)).collect()} == {0}


def test_rare_marks_are_labelled():
    rows = [(1, ["common"])] * 600 + [(1, ["plain", "rarity"])] * 8 + [(0, ["plain"])] * 2500 + [(1, ["once"])]
    made = toxic_spans.token_labels(rows, toxic_spans.Toxicity())
    assert all(list(x) == [0, 1] for x in made[600:608])
    assert not any(x.any() for x in made[608:])


def test_training_texts_are_whole(spark):
    text = " ".join(["a", "--"] * 400) + " Scoundrel!"
    df = spark.createDataFrame([(i, text if i else None, "en", "s", 0) for i in range(8)], DOCS)
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(8)], "doc_id long, quality int, toxic int")
    got = toxic_spans.training_texts(df, marks, toxic_spans.Toxicity(held=9))
    assert sorted(map(len, (words for _, words in got))) == [0] + [801] * 7
    assert all(words[-3:] == ["a", "", "scoundrel"] for _, words in got if words)


def test_quality_scores(spark, none):
    rows, labels = labelled()
    df, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = rule_ensemble.quality_score_report(df, marks).collect()
    truth = {i: q for i, q, _ in labels}
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if r["doc_id"] in truth:
            assert r["predicted"] == truth[r["doc_id"]]
    assert rule_ensemble.quality_score_report(none, marks).collect() == []
    assert len(rule_ensemble.quality_score_report(df, marks.limit(0)).collect()) == len(rows)


def test_compiled_rules_equal_the_matrix(spark):
    rng = np.random.default_rng(2)
    x = rng.random((300, 2))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.7)).astype(float)
    rules, intercept = rule_ensemble.fit_rules(x, y, ["a", "b"], rule_ensemble.Ensemble())
    z = intercept + sum(w * np.all([(x[:, "ab".index(n)] > e) == up for n, up, e in c], axis=0) for c, w in rules)
    df = spark.createDataFrame(x.tolist(), "a double, b double").select(rule_ensemble.compiled(rules, intercept).alias("s"))
    assert np.allclose(sorted(r["s"] for r in df.collect()), np.sort(1 / (1 + np.exp(-z))))
    assert np.mean((z > 0) == y) > 0.97


# --- the pipeline


def test_pipeline_stages(spark, docs):
    rows = [r for r in corpus() if r[0] is not None]
    df = spark.createDataFrame(rows, DOCS).dropDuplicates()
    rows = [tuple(r) for r in df.collect()]
    good = [r for r in rows if plain_quality(r[1])[-1]]
    groups = {(i, c) for i, c, _ in plain_groups(good)}
    one = [r for r in good if (r[0], r[0]) in groups]
    left = {i: kept for i, w, kept in plain_repeats(one) if kept}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = scratch_path(spark, "pipeline-test")
        stage(spark, df, "").write.parquet(path)
        df = spark.read.parquet(path)
        if k < 4:
            assert df.columns == docs.columns
        if k == 0:
            assert bag(df, *docs.columns) == Counter(good)
        if k == 1:
            assert bag(df, *docs.columns) == Counter(one)
        if k == 2:
            assert {r["doc_id"]: split(r["text"]) for r in df.collect()} == left
        if k == 3:
            taken = df.collect()
            assert {r["doc_id"] for r in taken} <= set(left)
            total = sum(len(split(r["text"])) for r in taken)
            assert abs(total - 1.5 * sum(map(len, left.values()))) <= 3
    assert df.selectExpr("count(distinct doc_id) n").first()["n"] == len({r["doc_id"] for r in taken})


def test_scores_past_64_bits_name_the_vectors(spark):
    df = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1e17, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="vectors 0 and 1"):
        pivot_search.top_k(df).collect()


def test_equal_ids_spread_over_the_line(spark):
    """Rows without an id lie all over their source's line, by their texts."""
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    order = docs.select(F.shiftright(mixing.line_order(mixing.Mix()), 57).alias("part")).groupBy("part").count().collect()
    assert len(order) == 8 and max(r["count"] for r in order) < 600
