"""Leakage-safe training sets: eligibility, splits, folds, labels, examples and the tables kept about runs."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lessonlens.functions import pose, probs
from lessonlens.functions.numeric import drawn, half_even, score_class
from lessonlens.operators import ratings, scans
from lessonlens.operators.segments import assemble
from lessonlens.schemas import SCORES, SITUATIONS
from lessonlens.session import cut_lineage

MAXIMISED = ("exact_accuracy", "qwk")
WEIGHT_CAP = 3.0


def role_of_phase(phase: Column) -> Column:
    return F.when(phase.isin("pre", "post"), "trial").otherwise("development")


def eligible_dataset(role: Column, phase: Column, include_pilot_post: bool = False) -> Column:
    phases = ("normal", "pilot_post") if include_pilot_post else ("normal",)
    return F.coalesce((role == "development") & phase.isin(*phases), F.lit(False))


def eligible_labels(consensus: DataFrame, min_raters: int = 1, max_std: float | None = None) -> DataFrame:
    ok = F.col("situation").isin(*SITUATIONS) & (F.col("rater_count") >= min_raters)
    return consensus.where(ok if max_std is None else ok & (F.col("score_std") <= max_std))


def split_by_group(
    items: DataFrame, group: Column, seed: int = 42, val_ratio: float = 0.2, holdouts: Sequence[str] = (),
    no_validation: bool = False,
) -> DataFrame:
    """Add ``split``; a group lies wholly on one side.

    The groups are ordered by a seeded hash and the first share of them validates. The groups are numbered once, in a
    written table; only the hash of the last validating one reaches the driver, so marking the items is a projection
    without a join.
    """
    d = items.withColumn("split_group", group)
    if no_validation:
        return d.withColumn("split", F.lit("train"))
    mark = F.struct(drawn(F.col("split_group"), seed).alias("h"), F.col("split_group").alias("g"))
    groups = scans.number_rows(d.select("split_group").distinct().withColumn("h", mark.h), ["h", "split_group"], "n")
    total = groups.count()
    if total < 2:
        raise ValueError(f"{total} split group(s); at least 2 are required")
    if holdouts:
        known = {r.split_group for r in groups.where(F.col("split_group").isin(*holdouts)).collect()}
        unknown = sorted(set(holdouts) - known)
        if unknown:
            raise ValueError(f"unknown hold-out groups: {unknown}")
        return d.withColumn("split", F.when(F.col("split_group").isin(*holdouts), "validation").otherwise("train"))
    wanted = min(max(1, round(total * val_ratio)), total - 1)
    last = groups.where(F.col("n") == wanted).first()
    border = F.struct(F.lit(last.h).cast("bigint").alias("h"), F.lit(last.split_group).alias("g"))
    return d.withColumn("split", F.when(mark <= border, "validation").otherwise("train"))


def dataset_folds(datasets: DataFrame, folds: int = 0) -> DataFrame:
    """Whole datasets in turn to ``folds`` folds; 0 leaves one dataset out at a time."""
    placed = scans.number_rows(datasets.select("dataset_id").distinct(), ["dataset_id"], "__n")
    total = placed.count()
    k = folds or total
    if not 2 <= k <= total:
        raise ValueError("folds must be between 2 and the number of datasets")
    return placed.select("dataset_id", F.pmod(F.col("__n") - 1, F.lit(k)).cast("int").alias("fold"))


def leaks(split: DataFrame, key: Sequence[str]) -> DataFrame:
    """Natural keys found on both sides of a split."""
    sides = split.groupBy(*key).agg(F.min("split").alias("a"), F.max("split").alias("b"), F.count(F.lit(1)).alias("n"))
    return sides.where(F.col("a") != F.col("b")).select(*key, "n")


def split_manifest(split: DataFrame) -> DataFrame:
    return split.groupBy("dataset_id").agg(
        F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "validation").alias("validation"))


def label_lookup(
    items: DataFrame, labels: DataFrame | None = None, raters: Sequence[str] = (), how: str = "mean",
    consensus: DataFrame | None = None, ds: Sequence[str] = (),
) -> DataFrame:
    """Attach ``label``: the consensus mean, or the mean or median of the chosen raters; items without one drop out."""
    key = [*ds, "segment_id"]
    if consensus is not None:
        found = consensus.select(*key, F.col("mean_score").alias("label"))
    else:
        found = ratings.chosen_scores(labels, raters, how, ds)
    return items.join(found.where(F.col("label").isNotNull()), key)


def training_examples(
    frames: DataFrame, items: DataFrame, length: int = 10, flip_seed: int | None = None, ds: Sequence[str] = (),
) -> DataFrame:
    """One row per item: normalised pose sequence, motion features, one-hot situation and label.

    ``frames``: ``segment_id, t, frame_idx, kpts``; ``items``: ``segment_id, situation, label``.
    """
    built = assemble(frames, length, ["t", "kpts"], ds=ds)
    sequence = F.transform("sequence", lambda f: pose.normalise_pose(f.kpts))
    rows = built.join(items, [*ds, "segment_id"]).withColumn("poses", sequence).drop("sequence")
    if flip_seed is not None:
        mirrored = F.transform("poses", lambda p: pose.mirror_pose(p))
        rows = rows.withColumn("poses", F.when(flips(F.col("segment_id"), flip_seed), mirrored).otherwise(F.col("poses")))
    return rows.withColumn("features", pose.motion_features(F.col("poses"))).withColumn(
        "situation_one_hot", probs.one_hot(F.col("situation")))


def flips(segment: Column, seed: int) -> Column:
    """One coin per segment, so that all frames of a sequence are mirrored together."""
    return drawn(segment, seed) % 2 == 0


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and weight of every class: 1/sqrt(count), scaled to mean 1 over the samples, at most 3."""
    counted = df.groupBy(score_class(F.col(label)).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    # Seven rows from here on.
    rows = [F.struct(F.lit(s).alias("class"), F.sum(F.when(F.col("c") == s, F.col("n")).otherwise(0)).alias("count")) for s in SCORES]
    mean = F.sum(F.sqrt("n")) / F.sum("n")
    dense = counted.where(F.col("c").isNotNull()).agg(F.array(*rows).alias("r"), mean.alias("m")).select("m", F.inline("r"))
    raw = F.when(F.col("count") > 0, 1.0 / F.sqrt(F.greatest(F.lit(1), F.col("count")))).otherwise(0.0)
    return dense.select("class", "count", F.least(F.lit(WEIGHT_CAP), raw / F.greatest(F.lit(1e-8), F.col("m"))).alias("weight"))


def majority_baseline(train: DataFrame, validation: DataFrame, label: str = "label") -> DataFrame:
    """The most frequent training class (the lowest on ties) and the share of validation labels that round to it."""
    top = train.groupBy(score_class(F.col(label)).alias("c")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.max_by("c", F.struct("n", -F.col("c"))).alias("majority"))
    counts = validation.groupBy(half_even(F.col(label)).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    joined = counts.join(top, how="left")
    return joined.groupBy("majority").agg(
        F.try_divide(F.sum(F.when(F.col("c") == F.col("majority"), F.col("n")).otherwise(0)).cast("double"), F.sum("n")).alias("baseline"))


def signed_metric(metric: str, prefix: str = "val_") -> Column:
    """The metric so that smaller is better."""
    c = F.col(f"{prefix}{metric}")
    return -c if metric in MAXIMISED else c


def best_epochs(history: DataFrame, metric: str = "exact_accuracy", keys: Sequence[str] = ("variant", "seed", "fold")) -> DataFrame:
    """The best epoch of each run, the earliest on ties."""
    rest = [c for c in history.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(signed_metric(metric), "epoch"))
    return history.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def cv_summary(runs: DataFrame) -> DataFrame:
    """Per variant over its runs (seeds times folds), ranked by accuracy, then by error."""
    epochs = F.transform(F.array_sort(F.collect_list(F.struct("seed", "fold", "epoch"))), lambda r: r.epoch)
    out = runs.groupBy("variant").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("val_exact_accuracy").alias("mean_exact_accuracy"),
        F.coalesce(F.stddev_samp("val_exact_accuracy"), F.lit(0.0)).alias("std_exact_accuracy"),
        F.avg("val_mae").alias("mean_mae"), F.avg("val_qwk").alias("mean_qwk"),
        F.greatest(F.lit(1).cast("bigint"), F.ceil(F.median("epoch"))).alias("recommended_epochs"), epochs.alias("fold_best_epochs"))
    best = out.agg(F.min_by("variant", F.struct(-F.col("mean_exact_accuracy"), "mean_mae")).alias("__best"))
    return out.join(best, how="left").withColumn("selected", F.col("variant") == F.col("__best")).drop("__best")


def experiment_grid(variants: DataFrame, seeds: Sequence[int], folds: Sequence[int]) -> DataFrame:
    return variants.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).withColumn(
        "fold", F.explode(F.array(*[F.lit(f) for f in folds])))


def score_batches(df: DataFrame, scorer: Callable[["object"], "object"], schema: str) -> DataFrame:
    """Run a batch scorer (pandas frame in, pandas frame out) over the rows, page by page."""
    def pages(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield scorer(pdf)

    return df.mapInPandas(pages, schema)


@dataclass(frozen=True)
class OrdinalModel:
    """Six threshold models (score above 1, .., above 6) over one feature vector; small, and sent to the tasks as it is."""

    weights: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]

    def scores(self, features):
        """Expected scores of a batch, a feature vector a row."""
        import numpy as np
        logits = np.asarray(features, float).reshape(-1, len(self.weights[0])) @ np.array(self.weights).T + np.array(self.intercepts)
        return 1.0 + (1.0 / (1.0 + np.exp(-np.clip(logits, -500, 500)))).sum(axis=1)

    def score(self, features: Column) -> Column:
        """The same as a column expression."""
        out = F.lit(1.0)
        for w, b in zip(self.weights, self.intercepts):
            z = pose.dot(features, F.array(*[F.lit(float(v)) for v in w])) + F.lit(max(-500.0, min(500.0, b)))
            out = out + F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        return out


def fit_ordinal(examples: DataFrame, features: str = "features", label: str = "label", iterations: int = 30) -> OrdinalModel:
    """Fit the thresholds on examples with a vector as an array column; Spark sums the gradients, only coefficients reach the driver."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = cut_lineage(examples.select(array_to_vector(F.col(features)).alias("__x"), score_class(F.col(label)).alias("__c")))
    weights, intercepts = [], []
    for k in SCORES[:-1]:
        target = rows.select("__x", (F.col("__c") > k).cast("double").alias("__y"))
        model = LogisticRegression(featuresCol="__x", labelCol="__y", maxIter=iterations, regParam=0.01, family="binomial").fit(target)
        weights.append(tuple(float(v) for v in model.coefficients.toArray()))
        intercepts.append(float(model.intercept))
    return OrdinalModel(tuple(weights), tuple(intercepts))


def score_ordinal(examples: DataFrame, model: OrdinalModel, keep: Sequence[str], features: str = "features") -> DataFrame:
    """``keep`` and ``pred_score``: Arrow batches in and out, one matrix product each."""
    source = examples.select(*keep, F.col(features).cast("array<double>").alias("__x"))
    weights, names = model, [*keep, "pred_score"]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(np.asarray(weights.scores(flat)))], names=names)

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:len(keep)], T.StructField("pred_score", T.DoubleType())]))


def linear_ordinal_score(features: Column, weights: Sequence[float], thresholds: Sequence[float]) -> Column:
    """Expected score of a linear model with six ordered thresholds."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    z = pose.dot(features, w)
    raw = F.array(*[z - F.lit(float(t)) for t in thresholds])
    return probs.expected_score(raw)


def fit_baseline(examples: DataFrame, features: str = "vector", label: str = "label", iterations: int = 30):
    """Six logistic threshold models (score above 1, .., above 6) and a multinomial situation model."""
    from pyspark.ml.classification import LogisticRegression

    def fit(target: Column, family: str):
        model = LogisticRegression(featuresCol=features, labelCol="__y", maxIter=iterations, regParam=0.01, family=family)
        return model.fit(examples.withColumn("__y", target.cast("double")))

    thresholds = [fit(score_class(F.col(label)) > k, "binomial") for k in SCORES[:-1]]
    order = F.array(*[F.lit(s) for s in SITUATIONS])
    return thresholds, fit(F.array_position(order, F.col("situation")) - 1, "multinomial")


def apply_baseline(examples: DataFrame, models, features: str = "vector") -> DataFrame:
    """Expected score, situation probabilities, situation and confidence from the fitted baseline."""
    from pyspark.ml.functions import vector_to_array

    thresholds, situation = models
    out, score = examples, F.lit(1.0)
    for k, model in enumerate(thresholds):
        keep = [*out.columns, f"__p{k}"]
        model.setPredictionCol("__pred").setProbabilityCol(f"__v{k}").setRawPredictionCol("__raw")
        scored = model.transform(out).withColumn(f"__p{k}", vector_to_array(f"__v{k}"))
        out = scored.select(*keep)
        # With one class only in training the vector may name just that class.
        score = score + F.coalesce(F.get(F.col(f"__p{k}"), F.lit(1)), F.lit(0.0))
    situation.setPredictionCol("__pred").setProbabilityCol("__sv").setRawPredictionCol("__raw")
    out = situation.transform(out.withColumn("pred_score", score)).withColumn("situation_probs", vector_to_array("__sv"))
    out = out.withColumns({
        "predicted_situation": probs.best_situation(F.col("situation_probs")),
        "situation_confidence": probs.confidence(F.col("situation_probs"))})
    return out.select(*examples.columns, "pred_score", "situation_probs", "predicted_situation", "situation_confidence")


# The model travels with the tasks, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
