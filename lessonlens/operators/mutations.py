"""Changes to rating tables as new versions of the table: inserts, upserts, deletes and their undo."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

AUTOMATIC = "face_recognition"
AUTOMATIC_PREFIX = "face_db:"


def insert_or_ignore(target: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add rows whose key is new; among equal new keys the first in ``order`` is taken."""
    rest = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")
    return target.unionByName(first.join(target, list(key), "left_anti"), allowMissingColumns=True)


def upsert(target: DataFrame, rows: DataFrame, key: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The row with the highest version per key; a new row beats an equally old one."""
    both = target.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*key, "__new")]
    latest = F.max_by(F.struct(*rest), F.struct(*version, "__new"))
    return both.groupBy(*key).agg(latest.alias("r")).select(*key, "r.*").select(*target.columns)


def rating_verdict(skipped: Column, excluded: Column, situation: Column, locked: Column) -> Column:
    """Why a rating cannot be taken, NULL when it can."""
    return (
        F.when(skipped, "skipped").when(excluded, "excluded").when(situation.isNull(), "situation unset")
        .when(~F.coalesce(locked, F.lit(False)), "situation unlocked"))


def fan_out_scores(
    clip_scores: DataFrame, clip_segments: DataFrame, clip: Sequence[str], ds: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """One score for a track in a clip becomes a label and an observation for each of its segments.

    ``clip_scores``: clip key, ``track_id, rater, score, updated_at``; ``clip_segments``: clip key, ``track_id, segment_id``; both with the
    store's key where there are several.
    """
    rows = clip_segments.join(clip_scores, list(dict.fromkeys([*ds, *clip, "track_id"])))
    labels = rows.select(*ds, "segment_id", "rater", "score", "updated_at")
    observations = rows.select(
        *ds, "segment_id", "rater", F.col("clip_start").alias("source_clip_start"), F.col("clip_end").alias("source_clip_end"),
        (F.col("clip_end") - F.col("clip_start")).alias("source_clip_sec"), "updated_at")
    return labels, observations


def toggle_exclusion(current: DataFrame, chosen: DataFrame, clip: Sequence[str], rater: str, ds: Sequence[str] = ()) -> DataFrame:
    """Include the segments of a clip again when all of them are excluded, else exclude all of them.

    ``chosen``: clip key and ``segment_id``; the result is the new exclusion table.
    """
    key, clip = [*ds, "segment_id"], list(dict.fromkeys([*ds, *clip]))
    marked = chosen.join(current.select(*key, F.lit(1).alias("__x")), key, "left")
    state = marked.groupBy(*clip).agg((F.count("__x") == F.count(F.lit(1))).alias("__all"))
    decided = chosen.join(state, clip)
    added = decided.where(~F.col("__all")).select(*key, F.lit("adult").alias("reason"), F.lit(rater).alias("excluded_by"))
    return current.join(decided.select(*key), key, "left_anti").unionByName(added.distinct(), allowMissingColumns=True)


def merge_automatic_exclusions(current: DataFrame, verdicts: DataFrame, ds: Sequence[str] = ()) -> DataFrame:
    """Apply automatic verdicts (``segment_id, excluded, name``) without touching exclusions made by hand."""
    joined = current.withColumn("__have", F.lit(True)).join(verdicts, [*ds, "segment_id"], "full_outer")
    have = F.coalesce("__have", F.lit(False))
    automatic = ~have | F.coalesce(F.col("excluded_by") == AUTOMATIC, F.lit(False))
    judged = F.col("excluded").isNotNull()
    out = F.coalesce("excluded", F.lit(False))
    stays = have & (~automatic | ~judged | out)
    set_now = automatic & out
    kept = joined.where(stays | set_now)
    reason = F.concat(F.lit(AUTOMATIC_PREFIX), F.coalesce("name", F.lit("unknown")))
    return kept.select(
        *ds, "segment_id", F.when(set_now, reason).otherwise(F.col("reason")).alias("reason"),
        F.when(set_now, F.lit(AUTOMATIC)).otherwise(F.col("excluded_by")).alias("excluded_by"))


def set_situation(windows: DataFrame, wanted: DataFrame, ds: Sequence[str] = ()) -> DataFrame:
    """Set situations (``window_id, new_situation, setter, at``) where a window is not locked; ``changed`` and ``refused`` tell which."""
    joined = windows.join(wanted, [*ds, "window_id"], "left")
    asked, open_ = F.col("new_situation").isNotNull(), ~F.coalesce("situation_locked", F.lit(False))
    hit = asked & open_
    out = joined.withColumns({
        "situation": F.when(hit, F.col("new_situation")).otherwise(F.col("situation")),
        "situation_set_by": F.when(hit, F.col("setter")).otherwise(F.col("situation_set_by")),
        "changed": hit, "refused": asked & ~open_})
    return out.drop("new_situation", "setter", "at")


def set_locks(windows: DataFrame, locked: bool, ds: Sequence[str] = ()) -> DataFrame:
    """Lock or unlock the windows of every store; locking changes nothing in a store that still has unset or unconfirmed windows."""
    if not locked:
        return windows.withColumn("situation_locked", F.lit(False))
    pending = windows.groupBy(*ds).agg(
        F.count_if(F.col("situation").isNull() | F.col("situation_set_by").isNull()).alias("__pending"))
    ready = F.col("__pending") == 0
    return windows.join(pending, list(ds) or None, "left").withColumn(
        "situation_locked", F.when(ready, True).otherwise(F.col("situation_locked"))).drop("__pending")


def delete_labels(labels: DataFrame, doomed: DataFrame, key: Sequence[str] = ("segment_id", "rater")) -> DataFrame:
    return labels.join(doomed.select(*key).distinct(), list(key), "left_anti")


def delete_rater(tables: dict[str, DataFrame], rater: str) -> dict[str, DataFrame]:
    """All of a rater's labels, observations, skips and events; shared window situations stay."""
    return {name: df.where(~F.col("rater").eqNullSafe(rater)) for name, df in tables.items()}


def undo(labels: DataFrame, before: DataFrame, key: Sequence[str] = ("segment_id", "rater")) -> DataFrame:
    """Put back the state recorded before an action: ``before`` has the keys touched and the old score, NULL for none."""
    restored = before.where(F.col("score").isNotNull())
    return delete_labels(labels, before, key).unionByName(restored, allowMissingColumns=True).select(*labels.columns)


def append_runs(existing: DataFrame, rows: DataFrame, key: Sequence[str] = ("variant", "seed", "fold")) -> tuple[DataFrame, DataFrame]:
    """All results, and the new rows refused because their key is already there."""
    def same(a: str, b: str) -> Column:
        out = F.lit(True)
        for k in key:
            out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return out

    old, new = existing.alias("old"), rows.alias("new")
    refused = new.join(old, same("new", "old"), "left_semi")
    fresh = new.join(old, same("new", "old"), "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True), refused


def replace_runs(existing: DataFrame, rerun: DataFrame, key: Sequence[str] = ("variant", "seed", "fold")) -> DataFrame:
    """Drop the stale rows of the runs about to be repeated, then add their new results."""
    condition = F.lit(True)
    for k in key:
        condition = condition & F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))
    kept = existing.alias("old").join(rerun.alias("new"), condition, "left_anti")
    return kept.unionByName(rerun, allowMissingColumns=True)
