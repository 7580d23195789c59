"""Quality by a sparse ensemble of rules.

Statistics of a text are Spark column expressions. Boosted shallow trees are grown on the statistics of labelled rows;
every path from a root to a node is a conjunction of comparisons, a rule. A logistic regression with a lasso penalty over
the rules keeps few of them, and the kept rules with their weights are compiled back into one Spark column expression, so
scoring is a projection inside the JVM.

Fitting reads at most ``per_class`` labelled rows of each label (a documented bound); scoring reads every text whole.
Labels, language, source and id are never inputs.

Defined cases: a null text counts as empty; an empty text has all statistics 0 and gets their score; without rows of both
labels every score is the share of good training rows (0.5 without any); repeated rows are scored each; an empty table
gives an empty result; further columns are not carried.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lessonlens.llm.labelled import fold, training_rows


@dataclass(frozen=True)
class Ensemble:
    per_class: int = 4000
    trees: int = 24
    depth: int = 3
    cuts: int = 32
    least: int = 10
    rate: float = 0.3
    lasso: float = 2e-3
    steps: int = 400
    threshold: float = 0.3
    folds: int = 5
    held: int = 0


Rule = tuple[tuple[str, bool, float], ...]  # (statistic, above the value or not, value)


def statistics(text: Column) -> dict[str, Column]:
    """Numbers per text: sizes, and shares that do not depend on the size."""
    size = F.char_length(text).cast("double")
    words = F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("double")
    lines = F.size(F.split(text, "\n", -1)).cast("double")
    per = lambda x, n: F.when(n > 0, x / n).otherwise(0.0)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    pieces = F.array_distinct(F.split(text, " ", -1))
    return {
        "n_words": words,
        "chars_per_word": per(size, words),
        "distinct_words": per(F.size(pieces).cast("double"), words),
        "symbols": per(count(r"[#*$%&|<>@^~=_{}\\\[\]]"), size),
        "capitals": per(count(r"\p{Lu}"), size),
        "marks": per(count(r"[!?]"), size),
        "digits": per(count(r"[0-9]"), size),
        "words_per_line": per(words, lines),
        "distinct_lines": per(F.size(F.array_distinct(F.split(text, "\n", -1))).cast("double"), lines),
    }


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    source = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text_"))
    return source.select(*keep, *[c.alias(n) for n, c in statistics(F.col("text_")).items()])


def grow(x: np.ndarray, target: np.ndarray, hess: np.ndarray, config: Ensemble) -> list[tuple[list[tuple[int, bool, float]], np.ndarray, float]]:
    """A tree on gradients: every node but the root as (conditions, rows, step)."""
    nodes, open_nodes = [], [([], np.arange(len(x)))]
    for _ in range(config.depth):
        below = []
        for conditions, rows in open_nodes:
            g, h, best = target[rows], hess[rows], (1e-6, None)
            base = g.sum() ** 2 / (h.sum() + 1)
            for j in range(x.shape[1]):
                values = x[rows, j]
                edges = np.unique(np.quantile(values, np.linspace(0, 1, config.cuts + 1)[1:-1], method="lower"))
                place = np.searchsorted(edges, values, "left")  # values <= edges[k] have place <= k
                sums = [np.cumsum(np.bincount(place, w, len(edges) + 1)) for w in (g, h, np.ones(len(rows)))]
                for k, edge in enumerate(edges):
                    gl, hl, nl = (s[k] for s in sums)
                    if min(nl, len(rows) - nl) < config.least:
                        continue
                    gain = gl**2 / (hl + 1) + (sums[0][-1] - gl) ** 2 / (sums[1][-1] - hl + 1) - base
                    if gain > best[0]:
                        best = (gain, (j, float(edge)))
            if best[1] is None:
                continue
            j, edge = best[1]
            low = x[rows, j] <= edge
            for above, part in ((False, rows[low]), (True, rows[~low])):
                node = ([*conditions, (j, above, edge)], part)
                nodes.append((*node, float(target[part].sum() / (hess[part].sum() + 1))))
                below.append(node)
        open_nodes = below
    return nodes


def extract_rules(x: np.ndarray, y: np.ndarray, config: Ensemble) -> list[list[tuple[int, bool, float]]]:
    """The rules of boosted trees, each set of conditions once."""
    score, found = np.full(len(y), math.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))), {}
    for _ in range(config.trees):
        p = 1 / (1 + np.exp(-score))
        nodes = grow(x, y - p, p * (1 - p), config)
        for conditions, rows, step in nodes:
            found.setdefault(tuple(sorted(conditions)), conditions)
            if len(conditions) == config.depth:
                score[rows] += config.rate * step
    return list(found.values())


def holds(conditions: list[tuple[int, bool, float]], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, edge in conditions:
        out &= (x[:, j] > edge) == above
    return out


def lasso_weights(r: np.ndarray, y: np.ndarray, config: Ensemble) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient steps on the logistic likelihood with an absolute penalty on the weights."""
    n = len(y)
    pace = 4 * n / (np.linalg.norm(np.hstack([r, np.ones((n, 1))]), 2) ** 2 + 1e-9)
    w, b, before_w, before_b, t = np.zeros(r.shape[1]), math.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)), None, None, 1.0
    at_w, at_b = w, b
    for _ in range(config.steps):
        gap = (1 / (1 + np.exp(-np.clip(r @ at_w + at_b, -30, 30))) - y) / n
        before_w, before_b = w, b
        w = at_w - pace * (r.T @ gap)
        w = np.sign(w) * np.maximum(np.abs(w) - pace * config.lasso, 0)
        b = at_b - pace * gap.sum()
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        at_w, at_b, t = w + (t - 1) / t_next * (w - before_w), b + (t - 1) / t_next * (b - before_b), t_next
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], config: Ensemble) -> tuple[list[tuple[Rule, float]], float]:
    """Kept rules with their weights, and the intercept."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return [], math.log((share + 1e-9) / (1 - share + 1e-9))
    rules = extract_rules(x, y, config)
    weights, intercept = lasso_weights(np.stack([holds(c, x) for c in rules], axis=1).astype(float), y, config)
    return [(tuple((names[j], above, edge) for j, above, edge in c), float(w)) for c, w in zip(rules, weights) if abs(w) > 1e-6], float(intercept)


def compiled(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    """The score of the statistics' columns: a logistic curve over the weights of the rules that hold."""
    total = F.lit(intercept)
    for conditions, weight in rules:
        met = F.lit(True)
        for name, above, edge in conditions:
            met = met & (F.col(name) > edge if above else F.col(name) <= edge)
        total = total + F.when(met, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, config: Ensemble = Ensemble()) -> tuple[list[tuple[Rule, float]], float]:
    chosen = training_rows(labels, "quality", config.folds, config.held, config.per_class)
    rows = with_statistics(docs.join(F.broadcast(chosen), "doc_id"), ["doc_id", "y"]).orderBy("doc_id").collect()
    names = [n for n in rows[0].asDict() if n not in ("doc_id", "y")] if rows else []
    x = np.array([[r[n] for n in names] for r in rows], float)
    return fit_rules(x, np.array([r["y"] for r in rows], float), names, config)


def quality_scores(docs: DataFrame, model: tuple[list[tuple[Rule, float]], float], config: Ensemble = Ensemble()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = with_statistics(docs, ["doc_id"]).select("doc_id", compiled(*model).alias("score"))
    return scored.select("doc_id", (fold(config.folds) == config.held).alias("held_out"), "score",
                         (F.col("score") >= config.threshold).cast("int").alias("predicted"))


def quality_score_report(docs: DataFrame, labels: DataFrame, config: Ensemble = Ensemble()) -> DataFrame:
    return quality_scores(docs, train(docs, labels, config), config)
