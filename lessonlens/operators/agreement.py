"""Agreement between two score columns, between raters, and between whole series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lessonlens.functions.numeric import concordance, finite, pearson, score_class, share
from lessonlens.operators import ranks
from lessonlens.session import cut_lineage
from lessonlens.schemas import SCORES, SITUATIONS

SS_FLOOR = 1e-8
LIMIT_Z = 1.96


def finite_pairs(df: DataFrame, keys: Sequence[str], truth: str, guess: str) -> DataFrame:
    """Counts of unusable predictions and targets per key."""
    bad = {f"nonfinite_{name}": F.count_if(finite(F.col(c)).isNull()) for name, c in (("pred", guess), ("target", truth))}
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in bad.items()])


def regression(truth: str, guess: str) -> dict[str, Column]:
    """Aggregates over finite pairs."""
    y, p = F.col(truth).cast("double"), F.col(guess).cast("double")
    error = p - y
    r2 = F.lit(1.0) - F.try_divide(F.sum(error * error), F.var_pop(y) * F.count(y))
    return {
        "n": F.count(error), "mae": F.avg(F.abs(error)), "rmse": F.sqrt(F.avg(error * error)), "bias": F.avg(error),
        "r2": F.when(F.count(error) >= 2, r2), "pearson": pearson(y, p),
    }


def ordinal(truth: str, guess: str) -> dict[str, Column]:
    gap = F.abs(score_class(F.col(guess)) - score_class(F.col(truth)))
    return {
        "exact_accuracy": share(gap == 0), "within_1_accuracy": share(gap <= 1), "within_2_accuracy": share(gap <= 2),
        "mean_absolute_class_error": F.avg(gap),
    }


def weighted_kappa(a: Column, b: Column) -> Column:
    """Quadratic weighted kappa from moments in one pass; 0 when all classes are equal, NULL without rows."""
    gap = F.avg(a) - F.avg(b)
    chance = F.var_pop(a) + F.var_pop(b) + gap * gap
    return F.when(F.count(a) > 0, F.when(chance > 0, 1.0 - F.avg((a - b) * (a - b)) / F.when(chance > 0, chance)).otherwise(0.0))


def phase_metrics(pairs: DataFrame, keys: Sequence[str] = ("phase",)) -> DataFrame:
    parts = regression("human_score", "model_score")
    return pairs.groupBy(*keys).agg(*[parts[k].alias(k) for k in ("n", "mae", "bias", "rmse", "pearson")])


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, constant: float | None = None, rows: int = ranks.BUCKET_ROWS) -> DataFrame:
    """Rank correlation with shared ranks for ties; ``constant`` is the answer when a side does not vary.

    Equal pairs are counted before ranks are attached, and the ranks come from the bucketed rank tables.
    """
    keys = list(keys)
    # the pairs are read once for each side's borders and ranks, and once more
    clean = cut_lineage(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")))
    pairs = clean.groupBy(*keys, "__x", "__y").agg(F.count(F.lit(1)).alias("__c"))

    def ranked(column: str, out: str) -> DataFrame:
        return ranks.value_ranks(clean, keys, column, rows).select(*keys, F.col("value").alias(column), ranks.average_rank().alias(out))

    r = pairs.join(ranked("__x", "rx"), [*keys, "__x"]).join(ranked("__y", "ry"), [*keys, "__y"])
    c = F.col("__c").cast("double")
    rx, ry = F.col("rx"), F.col("ry")
    n, sx, sy = F.sum(c), F.sum(c * rx), F.sum(c * ry)
    cov = F.sum(c * rx * ry) - sx * sy / n
    vx, vy = F.sum(c * rx * rx) - sx * sx / n, F.sum(c * ry * ry) - sy * sy / n
    sums = r.groupBy(*keys).agg(n.alias("n"), cov.alias("cov"), vx.alias("vx"), vy.alias("vy"))
    varies = (F.col("vx") > 0) & (F.col("vy") > 0)
    rho = F.when(varies, F.col("cov") / F.sqrt(F.when(varies, F.col("vx") * F.col("vy")))).otherwise(F.lit(constant).cast("double"))
    return sums.select(*keys, F.when(F.col("n") >= 2, rho).alias("spearman"))


def evaluation_metrics(df: DataFrame, keys: Sequence[str], truth: str, guess: str) -> DataFrame:
    """All figures of the evaluation report in one row per key."""
    t, g = score_class(F.col(truth)), score_class(F.col(guess))
    parts = {**regression(truth, guess), **ordinal(truth, guess), "quadratic_weighted_kappa": weighted_kappa(t, g)}
    plain = df.groupBy(*keys).agg(*[c.alias(n) for n, c in parts.items()])
    return _attach(_attach(plain, spearman(df, keys, truth, guess), keys), weighted_scores(class_scores(confusion(df, keys, truth, guess), keys), keys), keys)


def _attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left") if keys else left.join(right, how="left")


def training_metrics(df: DataFrame, keys: Sequence[str], truth: str, guess: str) -> DataFrame:
    """Figures logged per training epoch; non-finite pairs are counted and left out."""
    y, p = finite(F.col(truth)), finite(F.col(guess))
    clean = df.select(*keys, y.alias("__y"), p.alias("__p")).where(F.col("__y").isNotNull() & F.col("__p").isNotNull())
    error = F.col("__p") - F.col("__y")
    total = F.greatest(F.lit(SS_FLOOR), F.var_pop("__y") * F.count("__y"))
    a, b = score_class(F.col("__y")), score_class(F.col("__p"))
    plain = clean.groupBy(*keys).agg(
        F.avg(error * error).alias("mse"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        (1.0 - F.sum(error * error) / total).alias("r2"), weighted_kappa(a, b).alias("qwk"),
        share(a == b).alias("exact_accuracy"), share(F.abs(a - b) <= 1).alias("within_one_accuracy"))
    out = _attach(finite_pairs(df, keys, truth, guess), plain, keys)
    return _attach(out, spearman(clean, keys, "__y", "__p", constant=0.0), keys)


def confusion(df: DataFrame, keys: Sequence[str], truth: str, guess: str) -> DataFrame:
    """Counts per true and predicted class, without the empty cells."""
    t, g = score_class(F.col(truth)), score_class(F.col(guess))
    return df.groupBy(*keys, t.alias("true_class"), g.alias("pred_class")).agg(F.count(F.lit(1)).alias("count"))


def confusion_matrix(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per true class with a column per predicted class, all 49 cells present; ``row_<c>`` are row shares."""
    cells = [F.sum(F.when((F.col("true_class") == t) & (F.col("pred_class") == p), F.col("count")).otherwise(0)) for t in SCORES for p in SCORES]
    rows = [
        F.struct(F.lit(t).alias("true_class"), *[cells[(t - 1) * 7 + p - 1].alias(f"pred_{p}") for p in SCORES]) for t in SCORES]
    dense = counts.groupBy(*keys).agg(F.array(*rows).alias("r")).select(*keys, F.inline("r"))
    total = sum((F.col(f"pred_{p}") for p in SCORES), F.lit(0))
    return dense.withColumns({f"row_{p}": F.coalesce(F.try_divide(F.col(f"pred_{p}").cast("double"), total), F.lit(0.0)) for p in SCORES})


def class_scores(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support for each of the seven classes; an undefined ratio counts as 0."""
    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("count")).otherwise(0)).cast("double")

    t, p = F.col("true_class"), F.col("pred_class")
    rows = [F.struct(
        F.lit(c).alias("class"), total((t == c) & (p == c)).alias("tp"), total(t == c).alias("support"), total(p == c).alias("claimed"),
    ) for c in SCORES]
    dense = counts.groupBy(*keys).agg(F.array(*rows).alias("r")).select(*keys, F.inline("r"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    scored = dense.withColumns({
        "precision": ratio(F.col("tp"), F.col("claimed")), "recall": ratio(F.col("tp"), F.col("support"))})
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both))


def weighted_scores(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    def weighted(c: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(f"weighted_{c}")

    return scores.groupBy(*keys).agg(weighted("precision"), weighted("recall"), weighted("f1"))


def classification_report(df: DataFrame, keys: Sequence[str], truth: str, guess: str) -> DataFrame:
    """Rows for the classes, then accuracy (repeated in every column), macro and weighted averages."""
    scores = class_scores(confusion(df, keys, truth, guess), keys)
    figures = ("precision", "recall", "f1")
    per_class = scores.select(*keys, F.col("class").cast("string").alias("label"), *figures, "support")
    accuracy = F.coalesce(F.try_divide(F.sum("tp"), F.sum("support")), F.lit(0.0))

    def weighted(c: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0))

    rows = F.array(
        F.struct(F.lit("accuracy").alias("label"), *[accuracy.alias(c) for c in (*figures, "support")]),
        F.struct(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in figures], F.sum("support").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), *[weighted(c).alias(c) for c in figures], F.sum("support").alias("support")))
    return per_class.unionByName(scores.groupBy(*keys).agg(rows.alias("r")).select(*keys, F.inline("r")))


def situation_accuracy(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), share(F.col("situation").eqNullSafe(F.col("predicted_situation"))).alias("accuracy"))


def situation_confusion(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    rows = [F.struct(F.lit(t).alias("situation"), *[
        F.count_if((F.col("situation") == t) & (F.col("predicted_situation") == p)).alias(f"pred_{i}") for i, p in enumerate(SITUATIONS)
    ]) for t in SITUATIONS]
    return df.groupBy(*keys).agg(F.array(*rows).alias("r")).select(*keys, F.inline("r"))


def concordance_table(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(concordance(F.col(x), F.col(y)).alias("ccc"))


def bland_altman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Bias of ``y`` against ``x`` and the limits within which 95% of the differences are expected."""
    d = F.col(y) - F.col(x)
    out = df.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd"))
    return out.withColumns({
        "lower_limit": F.col("bias") - LIMIT_Z * F.col("sd"), "upper_limit": F.col("bias") + LIMIT_Z * F.col("sd")})


def intraclass(df: DataFrame, subject: str, rater: str, score: str, raters: Sequence[str]) -> DataFrame:
    """ICC(2,1), two-way random effects, absolute agreement, over the subjects that all ``raters`` scored."""
    k = len(raters)
    rows = df.where(F.col(rater).isin(*raters) & F.col(score).isNotNull())
    subjects = rows.groupBy(subject).agg(F.avg(score).alias("m"), F.count(F.lit(1)).alias("c")).where(F.col("c") == k)
    complete = rows.join(subjects.select(subject), subject, "left_semi")
    row_part = subjects.agg(F.count(F.lit(1)).alias("n"), F.var_pop("m").alias("row_var"))
    col_part = complete.groupBy(rater).agg(F.avg(score).alias("m")).agg(F.var_pop("m").alias("col_var"))
    all_part = complete.agg(F.var_pop(score).alias("all_var"))
    one = row_part.join(col_part, how="left").join(all_part, how="left")
    n = F.col("n")
    msr = F.try_divide(n * k * F.col("row_var"), n - 1)
    msc = F.try_divide(n * k * F.col("col_var"), F.lit(k - 1))
    mse = F.try_divide(n * k * (F.col("all_var") - F.col("row_var") - F.col("col_var")), (n - 1) * (k - 1))
    icc = F.try_divide(msr - mse, msr + (k - 1) * mse + F.try_divide(k * (msc - mse), n))
    return one.select(n.alias("n_subjects"), F.lit(k).alias("n_raters"), icc.alias("icc"))


def class_series(log: DataFrame, keys: Sequence[str], bin_sec: float = 300.0) -> DataFrame:
    """Mean per student in each bin, then over students, with the number of students."""
    b = F.floor(F.col("t") / F.lit(float(bin_sec))).cast("int").alias("bin")
    students = log.groupBy(*keys, b, "track_id").agg(F.avg("score").alias("s"))
    return students.groupBy(*keys, "bin").agg(F.avg("s").alias("value"), F.count(F.lit(1)).alias("n"))


def compare_series(long: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Pearson, Spearman, MAE and bias of every pair of series over the units both cover.

    ``long``: ``series``, the unit columns and ``value``; there are a handful of series, each with one value per unit.
    """
    a = long.select(*unit, F.col("series").alias("series_a"), F.col("value").alias("a"))
    b = long.select(*unit, F.col("series").alias("series_b"), F.col("value").alias("b"))
    pairs = a.join(b, list(unit)).where(F.col("series_a") < F.col("series_b"))
    key = ["series_a", "series_b"]
    parts = regression("a", "b")
    plain = pairs.groupBy(*key).agg(*[parts[c].alias(c) for c in ("n", "pearson", "mae", "bias")])
    return plain.join(spearman(pairs, key, "a", "b"), key, "left")
