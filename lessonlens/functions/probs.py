"""Class probabilities and ordinal scores as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from lessonlens.functions.numeric import array_sum, clamp, let
from lessonlens.schemas import SITUATIONS


def valid_situation(name: Column) -> Column:
    """The trimmed name when it is one of the three situations, else NULL."""
    trimmed = F.trim(name)
    return F.when(trimmed.isin(*SITUATIONS), trimmed)


def one_hot(name: Column) -> Column:
    return F.when(
        valid_situation(name).isNotNull(),
        F.array(*[F.when(F.trim(name) == s, 1.0).otherwise(0.0) for s in SITUATIONS]),
    )


def parse_probs(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def softmax(logits: Column) -> Column:
    """Stable softmax; undefined entries become the uniform share."""
    uniform = 1.0 / len(SITUATIONS)
    exps = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return let(exps, lambda e: let(array_sum(e), lambda total: F.transform(
        e, lambda v: F.coalesce(F.nanvl(F.try_divide(v, total), F.lit(uniform)), F.lit(uniform)))))


def confidence(probs: Column) -> Column:
    return F.array_max(probs)


def best_situation(probs: Column) -> Column:
    """Name with the highest probability, the first one on ties."""
    names = F.array(*[F.lit(s) for s in SITUATIONS])
    return F.element_at(names, F.array_position(probs, F.array_max(probs)).cast("int"))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def monotone_logits(raw: Column) -> Column:
    """First logit kept, each later one lowered by a positive step, so that thresholds never cross."""
    steps = F.slice(raw, F.lit(2), F.greatest(F.size(raw) - 1, F.lit(0)))
    lowered = F.transform(steps, lambda _x, i: F.element_at(raw, 1) - array_sum(F.slice(steps, 1, i + 1), softplus))
    return F.concat(F.slice(raw, 1, 1), lowered)


def expected_score(logits: Column) -> Column:
    """1 plus the summed probabilities of exceeding each threshold."""
    return F.lit(1.0) + array_sum(logits, sigmoid)


def ordinal_entropy(logits: Column) -> Column:
    """Mean binary entropy of the thresholds, 0..1."""
    def entropy(x: Column) -> Column:
        return let(clamp(sigmoid(x), 1e-6, 1 - 1e-6), lambda p: p * F.log(p) + (1 - p) * F.log(1 - p))

    return -array_sum(logits, entropy) / F.size(logits) / math.log(2)
