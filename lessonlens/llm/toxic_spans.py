"""Toxic spans by a linear-chain conditional random field.

Labels mark documents; tokens get labels from them: a token of a toxic training document is toxic if its word, or the
beginning of its word, occurs in far more toxic than clean training documents, and in too many toxic ones for chance. The
field has features of the word (form, beginnings, ending) and transitions between clean and toxic; it is fitted by
gradient steps on the exact likelihood of the labelled texts. Scoring runs forward-backward over whole documents; the marginals give the offending spans, and a
logistic curve fitted on the training documents turns their sum and maximum into the document's score.

Fitting reads at most ``per_class`` documents of each label, chosen by a hash (a documented bound), and their whole texts,
which the driver holds as lists of shared words; scoring reads everything. Labels, language, source and id are never inputs.

Defined cases: a null or empty text has no tokens and gets the score of that; without training rows of both labels every
score is the share of toxic training rows (0 without any); repeated rows are scored each; an empty table gives an empty
result; further columns are not carried.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lessonlens.llm.batches import slices
from lessonlens.llm.labelled import fold, training_rows
from lessonlens.llm.words import flat

STRIP = ".,;:!?\"'()[]{}<>|*#$%&-_"
BITS = 18
KEPT = 400_000
SCORES = ("doc_id long, held_out boolean, score double, predicted int, n_toxic long, "
          "spans array<struct<begin: long, end: long, probability: double>>")


@dataclass(frozen=True)
class Toxicity:
    per_class: int = 2500
    chance: float = 1e-3
    ratio: float = 20.0
    epochs: int = 60
    rate: float = 0.3
    shrink: float = 1e-3
    span_from: float = 0.5
    threshold: float = 0.3
    folds: int = 4
    held: int = 2


def core(word: bytes) -> str:
    return word.decode("utf-8", "replace").strip(STRIP).lower()


def beginnings(word: str) -> list[str]:
    return [f"w {word}", *[f"{n} {word[:n]}" for n in (4, 5, 6) if len(word) >= n], f"e {word[-4:]}"]


def feature_ids(word: str) -> list[int]:
    return [zlib.crc32(f.encode()) >> (32 - BITS) for f in beginnings(word)]


@dataclass
class Field:
    """Weights of the toxic against the clean state, log transitions [from, to], log start odds, and the score's curve."""

    weights: np.ndarray
    step: np.ndarray
    start: float
    curve: np.ndarray
    scores: dict[bytes, float] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "scores": {}}

    def emission(self, word: bytes) -> float:
        e = float(np.clip(self.weights[feature_ids(core(word))].sum(), -30, 30))
        if len(self.scores) >= KEPT:
            self.scores.clear()
        if len(word) <= 64:
            self.scores[word] = e
        return e


def marginals(e: np.ndarray, cuts: np.ndarray, step: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of every token, and the forward and backward odds; the sequences are ``cuts[i]:cuts[i+1]``.

    Sequences advance together, the longest first, so a step is one vector operation over those that still run.
    """
    t = np.exp(step)
    sizes = np.diff(cuts)
    order = np.argsort(-sizes, kind="stable")
    begins, lengths = cuts[:-1][order], sizes[order]
    running = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")  # sequences longer than t
    x = np.exp(e)
    ahead, back = np.empty(len(e)), np.ones(len(e))
    odds = None
    for at, m in enumerate(running):
        place = begins[:m] + at
        if at:
            o = odds[:m]
            odds = x[place] * (t[0, 1] + t[1, 1] * o) / (t[0, 0] + t[1, 0] * o)
        else:
            odds = x[place] * np.exp(start)
        ahead[place] = odds
    ends = begins + lengths - 1
    odds = np.ones(len(begins))
    for at, m in enumerate(running[1:]):
        place = ends[:m] - at
        seen = x[place] * odds[:m]
        odds[:m] = (t[1, 0] + t[1, 1] * seen) / (t[0, 0] + t[0, 1] * seen)
        back[place - 1] = odds[:m]
    joint = ahead * back
    return joint / (1 + joint), ahead, back


def by_chance(n: int, m: int, share: float) -> float:
    """The probability that ``n`` or more of ``n + m`` documents are toxic when the share of toxic ones is ``share``."""
    total, log = n + m, math.lgamma
    return sum(math.exp(log(total + 1) - log(k + 1) - log(total - k + 1) + k * math.log(share) + (total - k) * math.log1p(-share))
               for k in range(n, total + 1))


def token_labels(rows: list[tuple[int, list[str]]], config: Toxicity) -> list[np.ndarray]:
    """Labels of the tokens of (document label, words): 1 for words, or beginnings, that mark toxic documents.

    A mark is ``config.ratio`` times as frequent in toxic as in clean documents, and ``by_chance`` at most
    ``config.chance``; how many other toxic documents there are does not matter.
    """
    known: dict[str, int] = {}
    texts = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)) for _, words in rows]
    found: dict[str, int] = {}
    heads = np.empty((len(known), 4), np.int32)
    for i, w in enumerate(known):
        own = [found.setdefault(f, len(found)) for f in beginnings(w)[:-1]]
        heads[i] = own + own[:1] * (4 - len(own))
    seen = np.zeros((2, len(found)), np.int64)
    for (y, _), text in zip(rows, texts):
        seen[y, np.unique(heads[np.unique(text)])] += 1
    sizes = [max(1, sum(1 for r in rows if r[0] == y)) for y in (0, 1)]
    share = sizes[1] / sum(sizes)
    marks = (seen[1] >= 3) & (seen[1] / sizes[1] >= config.ratio * (seen[0] + 0.5) / sizes[0])
    for f in np.flatnonzero(marks):
        marks[f] = by_chance(int(seen[1, f]), int(seen[0, f]), share) <= config.chance
    marked = marks[heads].any(axis=1)
    return [(marked[text] & bool(y)).astype(np.int8) for (y, _), text in zip(rows, texts)]


def fit_field(rows: list[tuple[int, list[str]]], config: Toxicity) -> Field:
    rows = [r for r in rows if r[1]]
    weights = np.zeros(1 << BITS)
    share = sum(y for y, _ in rows) / len(rows) if rows else 0.0
    if share in (0.0, 1.0):
        flat_score = np.log((share + 1e-9) / (1 - share + 1e-9))
        return Field(weights, np.zeros((2, 2)), 0.0, np.array([flat_score, 0.0, 0.0]))
    y = np.concatenate(token_labels(rows, config))
    known: dict[str, int] = {}
    words_at = np.fromiter((known.setdefault(w, len(known)) for _, words in rows for w in words), np.int32, len(y))
    word = np.repeat(np.arange(len(known), dtype=np.int32), np.fromiter((len(beginnings(w)) for w in known), np.int32, len(known)))
    used, feature = np.unique(np.fromiter((f for w in known for f in feature_ids(w)), np.int32, len(word)), return_inverse=True)
    emissions = lambda w: np.bincount(word, w[feature], len(known))[words_at]
    cuts = np.concatenate([[0], np.cumsum([len(words) for _, words in rows])])
    inner = np.ones(len(y), bool)
    inner[cuts[1:] - 1] = False
    pairs = np.flatnonzero(inner).astype(np.int32)
    first = cuts[:-1]
    counted = np.bincount(2 * y[pairs] + y[pairs + 1], minlength=4).reshape(2, 2)
    w, bias, step, start = np.zeros(len(used)), -3.0, np.log(np.array([[0.97, 0.03], [0.7, 0.3]])), 0.0
    speed, speed_bias, speed_step = np.zeros(len(used)), 0.0, np.zeros((2, 2))
    for _ in range(config.epochs):
        e = np.clip(bias + emissions(w), -30, 30)
        p, ahead, back = marginals(e, cuts, step, start)
        gap = y - p
        # expected transitions: forward odds, transition, emission and backward odds of neighbours
        t, expected = np.exp(step), np.zeros((2, 2))
        for at in range(0, len(pairs), 1 << 16):
            own = pairs[at:at + (1 << 16)]
            a, b = ahead[own], np.exp(e[own + 1]) * back[own + 1]
            mass = np.stack([t[0, 0] + 0 * a, t[0, 1] * b, a * t[1, 0], a * t[1, 1] * b])
            expected += (mass / mass.sum(0)).sum(1).reshape(2, 2)
        # per-document scale; adaptive steps
        g = np.bincount(feature, np.bincount(words_at, gap, len(known))[word], len(used)) / len(rows) - config.shrink * w
        speed += g * g
        w += config.rate * g / np.sqrt(speed + 1e-8)
        del p, ahead, back, e
        g = gap.sum() / len(rows)
        speed_bias += g * g
        bias += config.rate * g / np.sqrt(speed_bias + 1e-8)
        g = (counted - expected) / len(rows)
        speed_step += g * g
        step = step + config.rate * g / np.sqrt(speed_step + 1e-8)
        start += 0.05 * gap[first].mean()
    weights[used] = w
    # the bias goes into the transitions, so that an emission is the sum of a word's weights alone
    step = step + np.array([[0.0, bias], [0.0, bias]])
    model = Field(weights, step, start + bias, np.zeros(3))
    p, _, _ = marginals(np.clip(emissions(w), -30, 30), cuts, step, model.start)
    model.curve = fit_curve(document_figures(p, cuts), np.array([r[0] for r in rows], float))
    return model


def document_figures(p: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """(log of 1 + expected toxic tokens, greatest marginal) of every sequence.

    Marginals below a tenth are left out of the sum: over a long clean text they would add up to a toxic token.
    """
    sums = np.concatenate([[0.0], np.cumsum(np.where(p >= 0.1, p, 0.0))])
    total = np.maximum(sums[cuts[1:]] - sums[cuts[:-1]], 0)
    top = np.zeros(len(cuts) - 1)
    full = np.diff(cuts) > 0
    if full.any():
        top[full] = np.maximum.reduceat(p, cuts[:-1][full])
    return np.stack([np.log1p(total), top], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression with an intercept, by Newton steps on a lightly shrunk likelihood."""
    x = np.hstack([np.ones((len(x), 1)), x])
    c, pull = np.zeros(x.shape[1]), np.diag([1e-3, 0.05, 0.05])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        c = c + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pull, x.T @ (y - p) - pull @ c)
    return c


def training_texts(docs: DataFrame, labels: DataFrame, config: Toxicity) -> list[tuple[int, list[str]]]:
    """(label, words) of every training document, collected: the number of documents is bounded, their texts are whole."""
    chosen = training_rows(labels, "toxic", config.folds, config.held, config.per_class)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            words = [[core(w)[:64] for w in (text.as_py() or b"").split()] for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()),
                                              pa.array([" ".join(w) for w in words], pa.string())], names=["doc_id", "y", "n", "words"])

    found = rows.mapInArrow(run, "doc_id long, y int, n long, words string").collect()
    known: dict[str, str] = {}
    return [(r["y"], [known.setdefault(w, w) for w in r["words"].split(" ")] if r["n"] else [])
            for r in sorted(found, key=lambda r: (r["doc_id"], r["words"]))]


def score_batch(model: Field, column: pa.Array, config: Toxicity) -> dict[str, list]:
    data, bounds = flat(column)
    raw = data.tobytes()
    made: dict[str, list] = {"score": [], "n_toxic": [], "spans": []}
    at = 0
    while at < len(bounds) - 1:
        texts, n = [], 0
        while at + len(texts) < len(bounds) - 1 and (not texts or n < 1_000_000):
            i = at + len(texts)
            texts.append(raw[int(bounds[i]):int(bounds[i + 1])].split())
            n += len(texts[-1])
        kept, new = model.scores, model.emission
        e = np.fromiter((s if (s := kept.get(w)) is not None else new(w) for t in texts for w in t), float, n)
        cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        p, _, _ = marginals(e, cuts, model.step, model.start)
        z = np.hstack([np.ones((len(texts), 1)), document_figures(p, cuts)]) @ model.curve
        made["score"].extend((1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist())
        hot = np.flatnonzero(p >= config.span_from)
        owner = np.searchsorted(cuts, hot, "right") - 1
        groups = np.split(hot, np.searchsorted(owner, np.arange(1, len(texts))))
        for k, places in enumerate(groups):
            made["n_toxic"].append(len(places))
            made["spans"].append(spans(raw[int(bounds[at + k]):int(bounds[at + k + 1])], texts[k], places - cuts[k], p[places]) if len(places) else [])
        at += len(texts)
    return made


def spans(text: bytes, words: list[bytes], places: np.ndarray, p: np.ndarray) -> list[dict]:
    """Character offsets of the words at ``places``, neighbours joined, with the greatest marginal."""
    out, at, chars, word = [], 0, 0, 0
    last = -2
    for place, probability in zip(places.tolist(), p.tolist()):
        while word <= place:
            begin = text.index(words[word], at)
            chars_begin = chars + len(text[at:begin].decode("utf-8", "replace"))
            chars = chars_begin + len(words[word].decode("utf-8", "replace"))
            at, word = begin + len(words[word]), word + 1
        if place == last + 1:
            out[-1] = {**out[-1], "end": chars, "probability": max(out[-1]["probability"], probability)}
        else:
            out.append({"begin": chars_begin, "end": chars, "probability": probability})
        last = place
    return out


def toxicity_scores(docs: DataFrame, model: Field, config: Toxicity = Toxicity()) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_toxic, spans) of every document."""
    source = docs.select("doc_id", (fold(config.folds) == config.held).alias("held_out"), F.col("text").cast("binary").alias("text"))
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = score_batch(model, batch.column(2), config)
            score = np.array(made["score"], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= config.threshold).astype(np.int32)),
                 pa.array(made["n_toxic"], pa.int64()), pa.array(made["spans"], span)],
                names=["doc_id", "held_out", "score", "predicted", "n_toxic", "spans"])

    return source.mapInArrow(run, SCORES)


def toxicity_report(docs: DataFrame, labels: DataFrame, config: Toxicity = Toxicity()) -> DataFrame:
    return toxicity_scores(docs, fit_field(training_texts(docs, labels, config), config), config)
