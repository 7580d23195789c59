"""Intervention events in a lesson, the phases around them and the effects measured between phases."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lessonlens.operators import ranks, resample, scans
from lessonlens.operators.joins import interval_join, substring_matches, text_matches
from lessonlens.operators.rollups import LOW_SCORE
from lessonlens.schemas import SITUATIONS
from lessonlens.session import cut_lineage
from lessonlens.sources.predictions import AB, like_text

# Fixed value: the note stored with a stamped intervention interval.
AB_NOTE = "Acti-Break"
ALL = "ALL"
PIECE_WIDTH = 300.0
EVENT = ["event_id", "video_path", "ab_start_sec", "ab_end_sec"]


@dataclass(frozen=True)
class Design:
    """Lengths around an event, in seconds, and the rules for a usable bin."""

    pre_sec: float = 300.0
    pre_gap_sec: float = 0.0
    post_sec: float = 300.0
    bin_sec: float = 5.0
    trim: float = 0.10
    min_tracks: int = 3
    cooldowns: tuple[float, ...] = (90.0,)

    def __post_init__(self) -> None:
        lengths = (self.pre_sec, self.pre_gap_sec, self.post_sec, *self.cooldowns)
        if min(lengths) < 0 or self.bin_sec <= 0 or self.min_tracks < 1 or not 0 <= self.trim < 0.5 or not self.cooldowns:
            raise ValueError(f"invalid design: {self}")


def override_pieces(videos: DataFrame, intervals: DataFrame) -> DataFrame:
    """Override intervals per video cut into disjoint pieces, each carrying the latest interval that covers it.

    ``intervals``: ``id, video_filter, start_sec, end_sec, situation, note``; the filter is a LIKE text, NULL for all videos.
    """
    late = F.coalesce(F.col("end_sec") > F.col("start_sec"), F.lit(False))
    checked = F.when(late, F.col("end_sec")).otherwise(F.raise_error(F.concat(
        F.lit("an override must end after it starts: "), F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in ("id", "start_sec", "end_sec")]))).cast("double"))
    placed = text_matches(videos, "video_path", intervals.withColumn("end_sec", checked), "video_filter", like_text)
    cuts = placed.select("video_path", F.explode(F.array("start_sec", "end_sec")).alias("cut")).distinct()
    near = scans.neighbours(cuts, ["video_path"], ["cut"], ["cut"], scans.time_chunk("cut", PIECE_WIDTH))
    pieces = near.select("video_path", F.col("cut").alias("piece_start"), F.col("next_row.cut").alias("piece_end"))
    covered = interval_join(
        pieces.where(F.col("piece_end").isNotNull()),
        placed.select("video_path", "id", "start_sec", "end_sec", "situation", "note"),
        ["video_path"], "piece_start", "start_sec", "end_sec", PIECE_WIDTH)
    return covered.groupBy("video_path", "piece_start", "piece_end").agg(
        F.max(F.struct("id", "situation", "note")).alias("latest"))


def stamp_overrides(log: DataFrame, intervals: DataFrame, clear_existing: bool = False) -> DataFrame:
    """Set ``situation_override`` and its note on the rows inside the intervals; the latest interval wins.

    ``clear_existing`` is the same for rows that are stamped; it is kept for callers that blank intervals with a NULL situation.
    """
    base = log
    for name in ("situation_override", "situation_override_note"):
        if name not in base.columns:
            base = base.withColumn(name, F.lit(None).cast("string"))
    pieces = override_pieces(log.select("video_path").distinct(), intervals)
    joined = interval_join(base, pieces, ["video_path"], "t", "piece_start", "piece_end", PIECE_WIDTH, how="left")
    hit = F.col("latest").isNotNull()
    if not clear_existing:
        hit = hit & F.col("latest.situation").isNotNull()
    return joined.withColumns({
        "situation_override": F.when(hit, F.col("latest.situation")).otherwise(F.col("situation_override")),
        "situation_override_note": F.when(hit, F.col("latest.note")).otherwise(F.col("situation_override_note")),
    }).drop("piece_start", "piece_end", "latest")


def override_log(kept: DataFrame, intervals: DataFrame) -> DataFrame:
    """The table of overrides after ``intervals`` were applied: a row is added for each that stamps a situation, in order of ``id``.

    ``kept``: ``id, video_filter, start_sec, end_sec, situation, note``; new rows are numbered on from its largest id.
    """
    columns = ["video_filter", "start_sec", "end_sec", "situation", "note"]
    new = scans.number_rows(intervals.where(F.col("situation").isNotNull()).select("id", *columns), ["id"], "__n")
    top = kept.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    added = new.join(F.broadcast(top), how="left").select((F.col("__top") + F.col("__n")).cast("int").alias("id"), *columns)
    return kept.select(F.col("id").cast("int").alias("id"), *columns).unionByName(added)


def inferred_runs(log: DataFrame, chunk_width: float = 600.0) -> DataFrame:
    """Runs of flagged seconds per video; a run may pause for three typical gaps (at least 2 s) and ends a third of that late."""
    key = ["video_path"]
    seconds = log.where("is_ab").select("video_path", "t").distinct()
    chunk = scans.time_chunk("t", chunk_width)
    near = scans.neighbours(seconds, key, ["t"], ["t"], chunk).select(
        "video_path", "t", (F.col("t") - F.col("prev_row.t")).alias("gap"))
    typical = ranks.group_stats(near.where(F.col("gap") > 0), key, "gap", typical=ranks.median())
    paced = near.join(typical, key, "left").withColumn(
        "tolerance", F.greatest(F.lit(2.0), F.coalesce(F.col("typical") * 3.0, F.lit(2.0))))
    begins = F.when(F.col("gap").isNull() | (F.col("gap") > F.col("tolerance")), 1).otherwise(0)
    runs = scans.running_total(paced, key, ["t"], begins, "run", chunk)
    return runs.groupBy("video_path", "run").agg(
        F.min("t").alias("ab_start_sec"), (F.max("t") + F.max("tolerance") / 3.0).alias("ab_end_sec"),
    ).select("video_path", "ab_start_sec", "ab_end_sec", F.lit("prediction rows").alias("event_source"))


def override_events(videos: DataFrame, overrides: DataFrame) -> DataFrame:
    """Events of an override table: intervention rows with a positive length, on every video whose path contains the filter."""
    rows = overrides.where((F.col("situation") == AB) & (F.col("end_sec") > F.col("start_sec"))).select(
        F.col("video_path").alias("video_filter"), "start_sec", "end_sec")
    matched = substring_matches(videos, "video_path", rows, "video_filter")
    return matched.select(
        "video_path", F.col("start_sec").alias("ab_start_sec"), F.col("end_sec").alias("ab_end_sec")).distinct().withColumn(
        "event_source", F.lit("situation_overrides"))


def explicit_events(videos: DataFrame, start: float, end: float) -> DataFrame:
    if end <= start:
        raise ValueError("the intervention must end after it starts")
    return videos.select(
        "video_path", F.lit(float(start)).alias("ab_start_sec"), F.lit(float(end)).alias("ab_end_sec"),
        F.lit("explicit").alias("event_source"))


def number_events(events: DataFrame) -> DataFrame:
    """Ids ``AB001``.. in order of video, start and end."""
    order = ["video_path", "ab_start_sec", "ab_end_sec"]
    numbered = scans.number_rows(events, order, "__n")
    return numbered.select(F.format_string("AB%03d", F.col("__n")).alias("event_id"), *order, "event_source")


def resolve_events(
    log: DataFrame, overrides: DataFrame | None = None, explicit: tuple[float, float] | None = None,
) -> DataFrame:
    """An explicit interval goes before the override table, and that before runs inferred from flagged rows."""
    videos = log.select("video_path").where(F.col("video_path").isNotNull()).distinct()
    if explicit is not None:
        return number_events(explicit_events(videos, *explicit))
    if overrides is not None:
        events = override_events(videos, overrides)
        if not events.isEmpty():
            return number_events(events)
    return number_events(inferred_runs(log))


def event_bounds(events: DataFrame, design: Design) -> DataFrame:
    cooldown = float(design.cooldowns[0])
    start, end = F.col("ab_start_sec"), F.col("ab_end_sec")
    return events.select(
        "event_id", "video_path", start, end, (end - start).alias("ab_duration_sec"),
        (start - F.lit(design.pre_gap_sec) - F.lit(design.pre_sec)).alias("pre_start_sec"),
        (start - F.lit(design.pre_gap_sec)).alias("pre_end_sec"),
        (end + F.lit(cooldown)).alias("cooldown_end_sec"),
        (end + F.lit(cooldown) + F.lit(design.post_sec)).alias("post_end_sec"), "event_source")


def phase_of(t: Column, start: Column, end: Column, design: Design, cooldown: Column | float) -> Column:
    """Phase of a time around one event; the first that fits, else ``outside``."""
    c = F.lit(float(cooldown)) if isinstance(cooldown, (int, float)) else cooldown
    pre_start = start - F.lit(design.pre_gap_sec) - F.lit(design.pre_sec)
    pre_end = start - F.lit(design.pre_gap_sec)
    return (
        F.when((t >= pre_start) & (t < pre_end), "pre").when((t >= start) & (t < end), AB)
        .when((t >= end) & (t < end + c), "cooldown")
        .when((t >= end + c) & (t < end + c + F.lit(design.post_sec)), "post").otherwise("outside"))


# Seconds by which the time buckets of the event join are wider than the phases around an event.
NEAR_EVENT = 600.0
# Seconds by which a time may be off its bin or its piece through rounding.
BIN_SLACK = 1e-3


def _ways(design: Design, borders: list[float]) -> tuple[list[float], list[list[dict]], list[list[float]]]:
    """The ways in which the cooldowns share out the pieces of each bin after an event.

    A phase takes pieces ``[first, stop)`` of a bin, held to those that may lie in it; cooldowns with the same pieces have the same
    way, named by the first of them. Returns the cooldowns, the ways of each bin and piece, and the cooldowns of each bin, phase and way.
    """
    cooldowns, width = sorted({float(c) for c in design.cooldowns}), float(design.bin_sec)
    ways, sharers = [], []
    for k in range(int(borders[-1] / width) + 3):
        low = sum(k * width - BIN_SLACK >= b for b in borders)
        high = sum((k + 1) * width + BIN_SLACK >= b for b in borders)
        spans = {}
        for phase in ("cooldown", "post"):
            named = [[] for _ in cooldowns]
            for i, c in enumerate(cooldowns):
                begins, ends = borders.index(c) + 1, borders.index(c + design.post_sec) + 1
                first, stop = (0, begins) if phase == "cooldown" else (begins, ends)
                way = spans.setdefault((phase, max(first, low), min(stop, high + 1)), i)
                named[way].append(c)
            sharers += named
        ways += [[{"phase": phase, "way": way} for (phase, first, stop), way in spans.items() if first <= piece < stop]
                 for piece in range(len(borders) + 1)]
    return cooldowns, ways, sharers


def event_course(log: DataFrame, events: DataFrame, design: Design) -> DataFrame:
    """Per cooldown, event, phase, bin after the event's end and situation (``ALL`` included): class figures over tracks.

    The log is read once for all cooldown lengths: rows are first summed per track into the pieces of time between
    all phase borders, and only these sums are assigned to a phase for each cooldown. Cooldowns whose phase takes the same
    pieces of a bin share its figures: they are computed once and handed to each of them at the end.
    """
    borders = sorted({b for c in design.cooldowns for b in (float(c), float(c) + design.post_sec)})
    events = cut_lineage(events.select(*EVENT))
    t, start, end = F.col("t"), F.col("ab_start_sec"), F.col("ab_end_sec")
    pre_start = start - F.lit(design.pre_gap_sec) - F.lit(design.pre_sec)
    pre_end = start - F.lit(design.pre_gap_sec)
    last = end + F.lit(borders[-1])
    # a row meets the events near it in time, not all of its lesson
    spans = events.withColumns({"__from": pre_start, "__until": last})
    reach = design.pre_gap_sec + design.pre_sec + borders[-1] + NEAR_EVENT
    near = interval_join(log, spans, ["video_path"], "t", "__from", "__until", reach).drop("__from", "__until")
    zone = F.when((t >= pre_start) & (t < pre_end), "pre").when((t >= start) & (t < end), AB).when(t >= end, "after")
    # Number of borders passed, as plain comparisons.
    passed = sum((F.when(t >= end + F.lit(b), 1).otherwise(0) for b in borders), F.lit(0))
    piece = F.when(t >= end, passed).otherwise(0)
    cells = near.withColumn("zone", zone).where(F.col("zone").isNotNull()).groupBy(
        "event_id", "zone", piece.alias("piece"),
        F.floor((t - end) / F.lit(design.bin_sec)).cast("int").alias("relative_bin"),
        F.coalesce("base_situation", F.lit("None")).alias("base_situation"), "track_id",
    ).agg(
        F.sum("score").alias("s"), F.count("score").alias("n"), F.sum("score_clamped").alias("sc"),
        F.count("score_clamped").alias("nc"), F.sum("situation_confidence").alias("sf"), F.count("situation_confidence").alias("nf"))

    cooldowns, ways, sharers = _ways(design, borders)
    # Up to the event's end there is one way for all cooldowns.
    whole = F.array(F.struct(F.col("zone").alias("phase"), F.lit(-1).alias("way")))
    place = F.col("relative_bin") * F.lit(len(borders) + 1) + F.col("piece")
    options = F.when(F.col("zone") != "after", whole).otherwise(
        F.get(F.from_json(F.lit(json.dumps(ways)), "array<array<struct<phase:string,way:int>>>"), place))
    cell = ["event_id", "phase", "relative_bin", "way"]
    once = Window.partitionBy(*cell, "track_id").orderBy("base_situation")
    tracks = (
        # One shuffle serves the track means and the mark on one row per track, which counts tracks over all situations.
        cells.withColumn("o", F.explode(options)).select("*", "o.*").repartition(*cell, "track_id")
        .groupBy(*cell, "base_situation", "track_id").agg(
            F.try_divide(F.sum("s"), F.sum("n")).alias("score"), F.try_divide(F.sum("sc"), F.sum("nc")).alias("clamped"),
            F.try_divide(F.sum("sf"), F.sum("nf")).alias("situation_confidence"))
        .withColumn("one", F.when(F.row_number().over(once) == 1, 1).otherwise(0)))
    # One row per track, bin and situation; the rank table reads it twice.
    tracks = cut_lineage(tracks)
    both = tracks.withColumn("base_situation", F.explode(F.array(F.lit(ALL), F.col("base_situation"))))
    keys = [*cell, "base_situation"]
    values = ranks.value_ranks(
        both, keys, "score", firsts=F.sum("one"), clamped=F.sum("clamped"), n_clamped=F.count("clamped"),
        conf=F.sum("situation_confidence"), n_conf=F.count("situation_confidence"))
    out = values.groupBy(*keys).agg(
        F.when(F.col("base_situation") == ALL, F.sum("firsts")).otherwise(F.sum("cnt")).alias("n_tracks"),
        ranks.mean().alias("score_mean"), ranks.trimmed_mean(design.trim).alias("score_trimmed_mean"),
        ranks.median().alias("score_p50"), ranks.deviation(population=True).alias("score_std"),
        ranks.share_at_most(LOW_SCORE).alias("low_score_ratio"),
        F.try_divide(F.sum("conf"), F.sum("n_conf")).alias("situation_confidence"),
        F.try_divide(F.sum("clamped"), F.sum("n_clamped")).alias("clamped_mean"))
    width = F.lit(float(design.bin_sec))
    bin_start = F.col("relative_bin") * width
    mine = (F.col("relative_bin") * F.lit(2) + F.when(F.col("phase") == "post", 1).otherwise(0)) * F.lit(len(cooldowns)) + F.col("way")
    takers = F.when(F.col("way") < 0, F.array(*[F.lit(c) for c in cooldowns])).otherwise(
        F.get(F.from_json(F.lit(json.dumps(sharers)), "array<array<double>>"), mine))
    out = out.withColumn("cooldown_sec", F.explode(takers)).select("cooldown_sec", *[c for c in out.columns if c != "way"])
    return out.join(events, "event_id").withColumns({
        "bin_start_relative_sec": bin_start, "bin_center_relative_sec": bin_start + width / 2.0,
        "quality_ok": F.col("n_tracks") >= design.min_tracks})


def situation_summary(course: DataFrame) -> DataFrame:
    """Per phase and situation of an event, over its usable bins (at most phase length / bin length of them)."""
    usable = course.where(F.col("quality_ok") & F.col("phase").isin("pre", "post") & F.col("base_situation").isin(*SITUATIONS))
    return usable.groupBy("cooldown_sec", "event_id", "video_path", "phase", "base_situation").agg(
        F.count(F.lit(1)).alias("n_bins"), F.avg("score_trimmed_mean").alias("mean_score"),
        F.median("score_trimmed_mean").alias("median_score"), F.avg("n_tracks").alias("mean_tracks"),
        F.avg("situation_confidence").alias("mean_situation_confidence"))


def effect_table(course: DataFrame, summary: DataFrame) -> DataFrame:
    """Post minus pre per event, plain and standardised to the situation mix of the pre phase."""
    key = ["cooldown_sec", "event_id", "video_path"]
    usable = F.col("quality_ok") & (F.col("base_situation") == ALL)

    def during(phase: str) -> Column:
        return usable & (F.col("phase") == phase)

    plain = course.groupBy(*key).agg(
        F.count_if(during("pre")).alias("n_pre_bins"), F.count_if(during("post")).alias("n_post_bins"),
        F.avg(F.when(during("pre"), F.col("score_trimmed_mean"))).alias("pre_unadjusted"),
        F.avg(F.when(during("post"), F.col("score_trimmed_mean"))).alias("post_unadjusted"))

    def pick(phase: str, column: str) -> Column:
        return F.max(F.when(F.col("phase") == phase, F.col(column)))

    wide = summary.groupBy(*key, "base_situation").agg(
        pick("pre", "n_bins").alias("w"), pick("pre", "mean_score").alias("pre"), pick("post", "mean_score").alias("post"))
    shared = F.col("pre").isNotNull() & F.col("post").isNotNull()
    weight = F.when(shared, F.col("w"))
    have = F.collect_set(F.when(shared, F.col("base_situation")))
    mixed = wide.groupBy(*key).agg(
        F.try_divide(F.sum(weight * F.col("pre")), F.sum(weight)).alias("pre_standardized"),
        F.try_divide(F.sum(weight * F.col("post")), F.sum(weight)).alias("post_standardized"),
        F.try_divide(F.coalesce(F.sum(weight), F.lit(0)), F.sum("w")).alias("pre_weight_coverage"),
        have.alias("__have"))
    names = F.array(*[F.lit(s) for s in SITUATIONS])
    listed = F.array_join(F.filter(names, lambda s: F.array_contains("__have", s)), ", ")
    out = plain.join(mixed, key, "left")
    return out.select(
        *key, "n_pre_bins", "n_post_bins", "pre_unadjusted", "post_unadjusted",
        (F.col("post_unadjusted") - F.col("pre_unadjusted")).alias("effect_unadjusted"),
        "pre_standardized", "post_standardized",
        (F.col("post_standardized") - F.col("pre_standardized")).alias("effect_standardized"),
        F.coalesce(listed, F.lit("")).alias("shared_situations"), "pre_weight_coverage")


def long_effects(effects: DataFrame) -> DataFrame:
    return effects.unpivot(
        ["cooldown_sec", "event_id"], ["effect_unadjusted", "effect_standardized"], "effect_type", "effect")


def sensitivity(effects: DataFrame, iterations: int = 10000, seed: int = 42) -> DataFrame:
    """Mean effect with its bootstrap interval over events, per cooldown length and effect type."""
    out = resample.mean_interval(
        long_effects(effects), ["cooldown_sec", "effect_type"], ["event_id"], "effect", iterations, seed)
    return out.withColumnsRenamed({"n": "n_events", "mean": "mean_effect"})


def chart_time_course(course: DataFrame) -> DataFrame:
    by_phase = course.where(F.col("quality_ok") & (F.col("base_situation") == ALL)).groupBy(
        "cooldown_sec", "bin_center_relative_sec", "phase").agg(F.avg("score_trimmed_mean").alias("m"))
    return by_phase.groupBy("cooldown_sec", "bin_center_relative_sec").agg(F.avg("m").alias("score_trimmed_mean"))


def chart_situations(summary: DataFrame) -> DataFrame:
    return summary.groupBy("cooldown_sec", "base_situation").pivot("phase", ["pre", "post"]).agg(F.avg("mean_score"))


def chart_effects(effects: DataFrame) -> DataFrame:
    def row(label: str, kind: str) -> Column:
        return F.struct(F.lit(label).alias("effect_type"), *[F.avg(f"{p}_{kind}").alias(p) for p in ("pre", "post", "effect")])

    packed = effects.groupBy("cooldown_sec").agg(
        F.array(row("unadjusted", "unadjusted"), row("situation-standardized", "standardized")).alias("r"))
    return packed.select("cooldown_sec", F.inline("r"))


def paired_class_effects(trial: DataFrame) -> DataFrame:
    """Mean per class and phase, for classes seen both before and after, and their difference."""
    wide = trial.groupBy("school_id", "class_id").pivot("phase", ["pre", "post"]).agg(
        F.avg("classroom_score").alias("score"), F.count("classroom_score").alias("n"))
    return wide.where(F.col("pre_score").isNotNull() & F.col("post_score").isNotNull()).select(
        "school_id", "class_id", F.col("pre_score").alias("pre"), F.col("post_score").alias("post"),
        (F.col("post_score") - F.col("pre_score")).alias("effect_post_minus_pre"),
        F.col("pre_n").alias("n_pre"), F.col("post_n").alias("n_post"))


def class_effect_summary(effects: DataFrame, iterations: int = 10000, seed: int = 42) -> DataFrame:
    """Mean and median class effect with the bootstrap interval over classes; NULL interval below two classes."""
    value = "effect_post_minus_pre"
    mean = resample.mean_interval(effects, [], ["school_id", "class_id"], value, iterations, seed)
    middle = ranks.overall_quantiles(effects, value, median_class_effect=0.5)
    return mean.join(middle, how="left").select(
        F.col("n").alias("n_classes"), F.col("mean").alias("mean_effect"), "median_class_effect", "ci95_low", "ci95_high",
        F.lit(iterations).alias("bootstrap_iterations"))


def difference_in_differences(effects: DataFrame, treated: Column) -> DataFrame:
    """Mean change of treated classes minus mean change of control classes."""
    change = F.col("effect_post_minus_pre")
    out = effects.agg(
        F.count_if(treated).alias("n_treated"), F.count_if(~treated).alias("n_control"),
        F.avg(F.when(treated, change)).alias("treated_change"), F.avg(F.when(~treated, change)).alias("control_change"))
    return out.withColumn("effect", F.col("treated_change") - F.col("control_change"))


def school_errors(pairs: DataFrame) -> DataFrame:
    """Per school the summed model error and row count of both phases: all a resample of schools needs."""
    error = F.col("model_score") - F.col("human_score")

    def of(phase: str, c: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("phase") == phase, c)), F.lit(0.0))

    return pairs.groupBy("school_id").agg(
        of("pre", error).alias("pre_error"), of("pre", F.lit(1.0)).alias("pre_n"),
        of("post", error).alias("post_error"), of("post", F.lit(1.0)).alias("post_n"))


def bias_shift(pairs: DataFrame, iterations: int = 10000, seed: int = 42) -> DataFrame:
    """Change of the model's bias after the intervention, with an interval from resampling whole schools."""
    totals = resample.resample_totals(
        school_errors(pairs), [], ["school_id"], ["pre_error", "pre_n", "post_error", "post_n"], iterations, seed)
    shift = F.try_divide("post_error", "post_n") - F.try_divide("pre_error", "pre_n")
    return resample.interval(totals, [], shift).withColumnRenamed("resampled_mean", "post_minus_pre_bias")


def report_tables(
    log: DataFrame, events: DataFrame, design: Design, iterations: int = 10000, seed: int = 42,
) -> dict[str, DataFrame]:
    """The sheets of the intervention report as named tables (``design.cooldowns`` holds every length to try)."""
    course = cut_lineage(event_course(log, events, design))
    summary = situation_summary(course)
    effects = cut_lineage(effect_table(course, summary))
    cooldowns = sensitivity(effects, iterations, seed)
    return {
        "events": event_bounds(events, design), "time_course": course, "situation_summary": summary, "effects": effects,
        "cooldown_events": long_effects(effects), "cooldown_summary": cooldowns,
        "chart_time_course": chart_time_course(course), "chart_situations": chart_situations(summary),
        "chart_effects": chart_effects(effects),
        "chart_cooldowns": cooldowns.where(F.col("effect_type") == "effect_standardized"),
    }


