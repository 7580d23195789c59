"""Data-quality reports: every check is an aggregate or an anti join, not a constraint."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lessonlens.schemas import PHASES, ROLES, SITUATIONS, schema


def schema_gaps(tables: Mapping[str, DataFrame], required: Sequence[str]) -> dict[str, list[str]]:
    """Missing tables and columns by table name; empty when all is there."""
    gaps: dict[str, list[str]] = {}
    for name in required:
        if name not in tables:
            gaps[name] = ["<table>"]
            continue
        absent = sorted({f.name for f in schema(name).fields} - set(tables[name].columns) - {"dataset_id"})
        if absent:
            gaps[name] = absent
    return gaps


def schema_report(stores: DataFrame, required: Sequence[str]) -> DataFrame:
    """Per store the required tables and columns it lacks, one row each (``column`` is NULL for a whole table).

    ``stores`` lists what the stores have: ``dataset_id, table, column``, a row per column. Stores are checked side by side, so any
    number of them is one anti join. The key ``dataset_id`` of merged tables is not asked for.
    """
    wanted = [(name, f.name) for name in required for f in schema(name).fields if f.name != "dataset_id"]
    needs = F.inline(F.array(*[F.struct(F.lit(t).alias("table"), F.lit(c).alias("column")) for t, c in wanted]))
    asked = stores.select("dataset_id").distinct().select("dataset_id", needs)
    here = stores.select("dataset_id", "table").distinct()
    absent = asked.select("dataset_id", "table").distinct().join(here, ["dataset_id", "table"], "left_anti").withColumn("column", F.lit(None).cast("string"))
    columns = asked.join(here, ["dataset_id", "table"], "left_semi").join(stores, ["dataset_id", "table", "column"], "left_anti")
    return absent.unionByName(columns)


def rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row per rule with the number of rows that break it; a rule that is NULL counts as broken."""
    rows = [F.struct(F.lit(name).alias("rule"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("violations")) for name, ok in rules.items()]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def label_rules() -> dict[str, Column]:
    return {"score in 1..7": F.col("score").between(1, 7), "rater not blank": F.trim("rater") != ""}


def window_rules() -> dict[str, Column]:
    return {
        "situation known": F.col("situation").isNull() | F.col("situation").isin(*SITUATIONS),
        "lock flag set": F.col("situation_locked").isNotNull(),
        "end after start": F.col("t_end") > F.col("t_start"),
    }


def metadata_rules() -> dict[str, Column]:
    minutes = F.col("minutes_since_intervention")
    filled = [F.coalesce(F.trim(c), F.lit("")) != "" for c in ("school_id", "grade", "class_id", "session_id")]
    after = F.col("intervention_phase").isin("post", "pilot_post")
    return {
        "no blank ids": reduce(lambda a, b: a & b, filled),
        "phase known": F.col("intervention_phase").isin(*PHASES),
        "role known": F.col("study_role").isin(*ROLES),
        "minutes given after intervention": ~after | (minutes.isNotNull() & (minutes >= 0)),
    }


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def orphans(child: DataFrame, parent: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``child`` without a parent."""
    return child.join(parent.select(*on), list(on), "left_anti")


def release_gate(windows: DataFrame, ds: Sequence[str] = ()) -> DataFrame:
    """Number of windows (per store) that are unset, unconfirmed or unlocked; none may be left before raters start."""
    pending = F.col("situation").isNull() | F.col("situation_set_by").isNull() | ~F.coalesce("situation_locked", F.lit(False))
    return windows.groupBy(*ds).agg(F.count(F.lit(1)).alias("windows"), F.count_if(pending).alias("pending"))


def sequence_completeness(audit: DataFrame, expected: int = 10, ds: Sequence[str] = ()) -> DataFrame:
    short, doubled = F.col("frames") < expected, F.col("frames") != F.col("distinct_t")
    outside = F.col("outside") > 0
    return audit.groupBy(*ds).agg(
        F.count_if(short).alias("short_segments"), F.count_if(doubled).alias("duplicated_segments"),
        F.count_if(outside).alias("outside_segments"), (F.count_if(short | doubled | outside) > 0).alias("failed"))


def first_existing(assets: DataFrame, files: DataFrame, candidates: str, keep: Sequence[str]) -> DataFrame:
    """Attach ``resolved``: the first candidate path that exists, NULL when none does."""
    listed = assets.select(*keep, F.posexplode_outer(candidates).alias("__rank", "__path"))
    found = listed.join(files.select(F.col("path").alias("__path"), F.lit(True).alias("__there")).distinct(), "__path", "left")
    there = F.coalesce("__there", F.lit(False))
    return found.groupBy(*keep).agg(F.min_by(F.when(there, F.col("__path")), F.when(there, F.col("__rank"))).alias("resolved"))


def missing_assets(resolved: DataFrame, path: str, examples: int = 10) -> DataFrame:
    """How many assets are missing and a few of their paths in alphabetical order."""
    gone = resolved.where(F.col("resolved").isNull()).select(F.coalesce(F.nullif(F.col(path), F.lit("")), F.lit("(empty)")).alias("p"))
    sample = gone.distinct().orderBy("p").limit(examples).agg(F.array_sort(F.collect_list("p")).alias("examples"))
    return gone.agg(F.count(F.lit(1)).alias("missing")).join(sample, how="left")


def require_empty(df: DataFrame, message: str) -> None:
    """Stop a job, before it writes anything, when a report has rows."""
    first = df.limit(3).collect()
    if first:
        raise ValueError(f"{message}: {[r.asDict() for r in first]}")

