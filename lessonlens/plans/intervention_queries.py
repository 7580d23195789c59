"""Intervention events, phases, effects and bootstraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lessonlens.operators import intervention as iv
from lessonlens.plans.catalogue import query
from lessonlens.plans.tools import rounded
from lessonlens.session import cut_lineage
from lessonlens.sources import fixtures as fx, predictions as pr

DESIGN = iv.Design(pre_sec=600.0, post_sec=600.0, bin_sec=300.0, min_tracks=3, cooldowns=(90.0,))
SWEEP = iv.Design(pre_sec=600.0, post_sec=600.0, bin_sec=300.0, min_tracks=3, cooldowns=(0.0, 30.0, 60.0, 90.0, 120.0, 180.0))


def _log(spark, d):
    return pr.read_predictions_ab(fx.predlog(spark, d))


def _videos(spark, d):
    return fx.pred(spark, d).select("video_path").distinct()


def _overrides(spark, d):
    """One intervention per lesson, and a second one on the lessons of the second decade."""
    first = _videos(spark, d).select(F.col("video_path"), F.lit(1800.0).alias("start_sec"), F.lit(2100.0).alias("end_sec"))
    second = first.where(F.col("video_path").contains("lesson_1")).select(
        "video_path", F.lit(900.0).alias("start_sec"), F.lit(1000.0).alias("end_sec"))
    return first.unionByName(second).withColumn("situation", F.lit("AB"))


def _events(spark, d):
    return iv.resolve_events(_log(spark, d), explicit=(1800.0, 2100.0))


OVR = """SELECT DISTINCT video_path, CAST(1800 AS DOUBLE) AS start_sec, CAST(2100 AS DOUBLE) AS end_sec FROM pred
  UNION ALL SELECT DISTINCT video_path, CAST(900 AS DOUBLE), CAST(1000 AS DOUBLE) FROM pred WHERE contains(video_path, 'lesson_1')"""
EV = """SELECT concat('AB', lpad(CAST(row_number() OVER (ORDER BY video_path) AS VARCHAR), 3, '0')) AS event_id, video_path,
  CAST(1800 AS DOUBLE) AS ab_start_sec, CAST(2100 AS DOUBLE) AS ab_end_sec FROM (SELECT DISTINCT video_path FROM pred)"""


@query("J10_interval_stamp", """SELECT frame_idx, CASE WHEN t >= 1200 AND t < 1500 AND contains(video_path, 'lesson_0') THEN 'X' WHEN t >= 1000 AND t < 1300 THEN 'AB'
  ELSE situation_override END AS situation_override, CASE WHEN t >= 1200 AND t < 1500 AND contains(video_path, 'lesson_0') THEN 'later' WHEN t >= 1000 AND t < 1300 THEN 'Acti-Break' END AS note FROM predlog""")
def j10(spark, d):
    log = fx.predlog(spark, d)
    everywhere = _videos(spark, d).agg(F.count(F.lit(1)).alias("n"))
    rows = everywhere.select(F.inline(F.array(
        F.struct(F.lit(1).alias("id"), F.lit(None).cast("string").alias("video_filter"), F.lit(1000.0).alias("start_sec"),
                 F.lit(1300.0).alias("end_sec"), F.lit("AB").alias("situation"), F.lit(iv.AB_NOTE).alias("note")),
        F.struct(F.lit(2).alias("id"), F.lit("LESSON_0").alias("video_filter"), F.lit(1200.0).alias("start_sec"),
                 F.lit(1500.0).alias("end_sec"), F.lit("X").alias("situation"), F.lit("later").alias("note")))))
    return iv.stamp_overrides(log, rows).select(
        "frame_idx", "situation_override", F.col("situation_override_note").alias("note"))


@query("U16_clear_then_stamp", """SELECT frame_idx, CASE WHEN t >= 1700 AND t < 1900 THEN NULL WHEN t >= 2000 AND t < 2300 THEN 'AB' ELSE situation_override END AS situation_override FROM predlog""")
def u16(spark, d):
    return iv.stamp_overrides(fx.predlog(spark, d), _clear_then_stamp(spark, d), clear_existing=True).select("frame_idx", "situation_override")


def _clear_then_stamp(spark, d):
    return _videos(spark, d).agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(
        F.struct(F.lit(1).alias("id"), F.lit(None).cast("string").alias("video_filter"), F.lit(1700.0).alias("start_sec"),
                 F.lit(1900.0).alias("end_sec"), F.lit(None).cast("string").alias("situation"), F.lit(None).cast("string").alias("note")),
        F.struct(F.lit(2).alias("id"), F.lit(None).cast("string").alias("video_filter"), F.lit(2000.0).alias("start_sec"),
                 F.lit(2300.0).alias("end_sec"), F.lit("AB").alias("situation"), F.lit(iv.AB_NOTE).alias("note")))))


@query("U16_override_log", """SELECT CAST(id AS INT) AS id, video_path AS video_filter, start_sec, end_sec, 'AB' AS situation FROM old UNION ALL SELECT CAST((SELECT max(id) FROM old) + 1 AS INT), NULL, 2000, 2300, 'AB'""",
       ovr=OVR, old="SELECT row_number() OVER (ORDER BY video_path, start_sec, end_sec) AS id, * FROM ovr")
def u16_log(spark, d):
    from lessonlens.operators import scans
    old = _overrides(spark, d).withColumn("video_filter", F.col("video_path"))
    old = scans.number_rows(old, ["video_path", "start_sec", "end_sec"], "id").withColumn("note", F.lit(None).cast("string"))
    return iv.override_log(old, _clear_then_stamp(spark, d)).drop("note")


@query("J14_override_filters", "SELECT video_path, start_sec, end_sec FROM ovr", ovr=OVR)
def j14(spark, d):
    return iv.override_events(_videos(spark, d), _overrides(spark, d)).select(
        "video_path", F.col("ab_start_sec").alias("start_sec"), F.col("ab_end_sec").alias("end_sec"))


RUNS = {
    "sec": "SELECT DISTINCT video_path, t FROM predlog WHERE situation_override = 'AB'",
    "gp": "SELECT *, t - lag(t) OVER (PARTITION BY video_path ORDER BY t) AS gap FROM sec",
    "tol": "SELECT video_path, greatest(2, coalesce(3*median(gap), 2)) AS tolerance FROM gp GROUP BY 1",
    "rn": """SELECT g.video_path, g.t, tolerance, sum(CASE WHEN gap IS NULL OR gap > tolerance THEN 1 ELSE 0 END) OVER (PARTITION BY g.video_path ORDER BY g.t) AS run
      FROM gp g JOIN tol ON tol.video_path = g.video_path""",
}


@query("W4_inferred_runs", """SELECT video_path, round(min(t),6) AS ab_start_sec, round(max(t)+max(tolerance)/3,6) AS ab_end_sec FROM rn GROUP BY video_path, run""", **RUNS)
def w4(spark, d):
    return rounded(iv.inferred_runs(_log(spark, d)).drop("event_source"))


@query("W5_resolved_events", """SELECT concat('AB', lpad(CAST(row_number() OVER (ORDER BY video_path, start_sec, end_sec) AS VARCHAR), 3, '0')) AS event_id, video_path,
  start_sec AS ab_start_sec, end_sec AS ab_end_sec, 'situation_overrides' AS event_source FROM ovr""", ovr=OVR)
def w5(spark, d):
    return iv.resolve_events(_log(spark, d), _overrides(spark, d))


@query("W6_event_bounds", """SELECT event_id, video_path, ab_start_sec, ab_end_sec, ab_end_sec-ab_start_sec AS ab_duration_sec, ab_start_sec-600 AS pre_start_sec,
  ab_start_sec AS pre_end_sec, ab_end_sec+90 AS cooldown_end_sec, ab_end_sec+690 AS post_end_sec FROM ev""", ev=EV)
def w6(spark, d):
    return iv.event_bounds(_events(spark, d), DESIGN).drop("event_source")


@query("J11_phase_join", """SELECT video_path, phase, count(*) AS n FROM (SELECT video_path, CASE WHEN t>=1200 AND t<1800 THEN 'pre' WHEN t>=1800 AND t<2100 THEN 'AB'
  WHEN t>=2100 AND t<2190 THEN 'cooldown' WHEN t>=2190 AND t<2790 THEN 'post' ELSE 'outside' END AS phase FROM predlog) GROUP BY 1,2""")
def j11(spark, d):
    joined = _log(spark, d).join(_events(spark, d), "video_path")
    phase = iv.phase_of(F.col("t"), F.col("ab_start_sec"), F.col("ab_end_sec"), DESIGN, 90.0)
    return joined.groupBy("video_path", phase.alias("phase")).agg(F.count(F.lit(1)).alias("n"))


def course_steps(cooldowns):
    return {
        "ev": EV, "cd": " UNION ALL ".join(f"SELECT CAST({c} AS DOUBLE) AS cooldown_sec" for c in cooldowns),
        "ph": """SELECT cooldown_sec, event_id, e.video_path, CASE WHEN t>=1200 AND t<1800 THEN 'pre' WHEN t>=1800 AND t<2100 THEN 'AB' WHEN t>=2100 AND t<2100+cooldown_sec THEN 'cooldown'
          WHEN t>=2100+cooldown_sec AND t<2700+cooldown_sec THEN 'post' END AS phase, CAST(floor((t-2100)/300) AS INT) AS relative_bin, situation AS base_situation, track_id, score,
          score_clamped, situation_confidence FROM predlog p JOIN ev e ON e.video_path = p.video_path, cd""",
        "pt": """SELECT cooldown_sec, event_id, video_path, phase, relative_bin, base_situation, track_id, avg(score) AS score, avg(score_clamped) AS clamped, avg(situation_confidence) AS conf
          FROM ph WHERE phase IS NOT NULL GROUP BY ALL""",
        "bo": "SELECT * FROM pt UNION ALL SELECT cooldown_sec, event_id, video_path, phase, relative_bin, 'ALL', track_id, score, clamped, conf FROM pt",
        "rk": """SELECT *, row_number() OVER (PARTITION BY cooldown_sec, event_id, phase, relative_bin, base_situation ORDER BY score) AS rn,
          count(*) OVER (PARTITION BY cooldown_sec, event_id, phase, relative_bin, base_situation) AS n FROM bo""",
        "course": """SELECT cooldown_sec, event_id, video_path, phase, relative_bin, base_situation, count(DISTINCT track_id) AS n_tracks, avg(score) AS score_mean,
          avg(CASE WHEN rn > floor(n*CAST(0.1 AS DOUBLE)) AND rn <= n-floor(n*CAST(0.1 AS DOUBLE)) THEN score END) AS score_trimmed_mean, median(score) AS score_p50,
          stddev_pop(score) AS score_std, avg(CASE WHEN score<=3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS low_score_ratio, avg(conf) AS situation_confidence, avg(clamped) AS clamped_mean
          FROM rk GROUP BY 1,2,3,4,5,6""",
        "summ": """SELECT cooldown_sec, event_id, video_path, phase, base_situation, count(*) AS n_bins, avg(score_trimmed_mean) AS mean_score, median(score_trimmed_mean) AS median_score,
          avg(n_tracks) AS mean_tracks, avg(situation_confidence) AS mean_situation_confidence FROM course WHERE n_tracks >= 3 AND phase IN ('pre','post') AND base_situation <> 'ALL' GROUP BY 1,2,3,4,5""",
        "un": """SELECT cooldown_sec, event_id, video_path, count_if(ok AND phase='pre') AS n_pre_bins, count_if(ok AND phase='post') AS n_post_bins,
          avg(CASE WHEN ok AND phase='pre' THEN score_trimmed_mean END) AS pre_unadjusted, avg(CASE WHEN ok AND phase='post' THEN score_trimmed_mean END) AS post_unadjusted
          FROM (SELECT *, n_tracks >= 3 AND base_situation='ALL' AS ok FROM course) GROUP BY 1,2,3""",
        "wd": """SELECT cooldown_sec, event_id, base_situation, max(CASE WHEN phase='pre' THEN n_bins END) AS w, max(CASE WHEN phase='pre' THEN mean_score END) AS pre,
          max(CASE WHEN phase='post' THEN mean_score END) AS post FROM summ GROUP BY 1,2,3""",
        "st": """SELECT cooldown_sec, event_id, sum(CASE WHEN sh THEN w*pre END)/sum(CASE WHEN sh THEN w END) AS pre_standardized, sum(CASE WHEN sh THEN w*post END)/sum(CASE WHEN sh THEN w END) AS post_standardized,
          coalesce(sum(CASE WHEN sh THEN w END),0)/sum(w) AS pre_weight_coverage,
          string_agg(CASE WHEN sh THEN base_situation END, ', ' ORDER BY CASE base_situation WHEN '聞く' THEN 0 WHEN '書く' THEN 1 ELSE 2 END) AS shared_situations
          FROM (SELECT *, pre IS NOT NULL AND post IS NOT NULL AS sh FROM wd) GROUP BY 1,2""",
        "eff": """SELECT un.*, post_unadjusted-pre_unadjusted AS effect_unadjusted, pre_standardized, post_standardized, post_standardized-pre_standardized AS effect_standardized,
          coalesce(shared_situations,'') AS shared_situations, pre_weight_coverage FROM un LEFT JOIN st ON st.cooldown_sec=un.cooldown_sec AND st.event_id=un.event_id""",
    }


ONE = course_steps([90])
ALLC = course_steps([0, 30, 60, 90, 120, 180])


def _until(steps, last):
    names = list(steps)
    return {n: steps[n] for n in names[:names.index(last) + 1]}


@query("A6_event_course", """SELECT event_id, phase, relative_bin, base_situation, n_tracks, round(score_mean,6) AS score_mean, round(score_trimmed_mean,6) AS score_trimmed_mean,
  round(score_p50,6) AS score_p50, round(score_std,6) AS score_std, round(low_score_ratio,6) AS low_score_ratio, round(situation_confidence,6) AS situation_confidence,
  round(clamped_mean,6) AS clamped_mean, n_tracks >= 3 AS quality_ok, relative_bin*CAST(300 AS DOUBLE)+150 AS bin_center_relative_sec FROM course""", **_until(ONE, "course"))
def a6(spark, d):
    course = iv.event_course(_log(spark, d), _events(spark, d), DESIGN)
    return rounded(course.select(
        "event_id", "phase", "relative_bin", "base_situation", "n_tracks", "score_mean", "score_trimmed_mean", "score_p50", "score_std",
        "low_score_ratio", "situation_confidence", "clamped_mean", "quality_ok", "bin_center_relative_sec"))


@query("P8_quality_gate", "SELECT phase, n_tracks >= 3 AS quality_ok, count(*) AS n FROM course GROUP BY 1,2", **_until(ONE, "course"))
def p8(spark, d):
    course = iv.event_course(_log(spark, d), _events(spark, d), DESIGN)
    return course.groupBy("phase", "quality_ok").agg(F.count(F.lit(1)).alias("n"))


@query("A7_situation_summary", """SELECT event_id, video_path, phase, base_situation, n_bins, round(mean_score,6) AS mean_score, round(median_score,6) AS median_score, round(mean_tracks,6) AS mean_tracks,
  round(mean_situation_confidence,6) AS mean_situation_confidence FROM summ""", **_until(ONE, "summ"))
def a7(spark, d):
    course = iv.event_course(_log(spark, d), _events(spark, d), DESIGN)
    return rounded(iv.situation_summary(course).drop("cooldown_sec"))


EFFECTS = """SELECT cooldown_sec, event_id, video_path, n_pre_bins, n_post_bins, round(pre_unadjusted,6) AS pre_unadjusted, round(post_unadjusted,6) AS post_unadjusted, round(effect_unadjusted,6) AS effect_unadjusted,
  round(pre_standardized,6) AS pre_standardized, round(post_standardized,6) AS post_standardized, round(effect_standardized,6) AS effect_standardized, shared_situations, round(pre_weight_coverage,6) AS pre_weight_coverage FROM eff"""


@query("A8_effect_table", EFFECTS, **ONE)
def a8(spark, d):
    course = cut_lineage(iv.event_course(_log(spark, d), _events(spark, d), DESIGN))
    return rounded(iv.effect_table(course, iv.situation_summary(course)))


def _sweep(spark, d):
    # One row per event, cooldown, bin and situation; read several times below.
    course = cut_lineage(iv.event_course(_log(spark, d), _events(spark, d), SWEEP))
    summary = iv.situation_summary(course)
    return course, summary, iv.effect_table(course, summary)


@query("A9_cooldown_effects", EFFECTS, **ALLC)
def a9_effects(spark, d):
    return rounded(_sweep(spark, d)[2])


LONG = """SELECT cooldown_sec, event_id, 'effect_unadjusted' AS effect_type, effect_unadjusted AS effect FROM eff
  UNION ALL SELECT cooldown_sec, event_id, 'effect_standardized', effect_standardized FROM eff"""


@query("A9_sensitivity_means", "SELECT cooldown_sec, effect_type, count(effect) AS n_events, round(avg(effect),6) AS mean_effect FROM lng WHERE effect IS NOT NULL GROUP BY 1,2", **ALLC, lng=LONG)
def a9_means(spark, d):
    return rounded(iv.sensitivity(_sweep(spark, d)[2], iterations=0).select("cooldown_sec", "effect_type", "n_events", "mean_effect"))


# An interval's width must be within a tenth (and what few units cannot give) of that of a normal mean, and hold the mean.
@query("A12_sensitivity_intervals", """SELECT cooldown_sec, effect_type, count(effect) AS n_events, round(avg(effect),6) AS mean_effect, CASE WHEN count(effect) > 1 THEN true END AS inside,
  CASE WHEN count(effect) > 1 THEN true END AS width_ok FROM lng WHERE effect IS NOT NULL GROUP BY 1,2""", **ALLC, lng=LONG)
def a12(spark, d):
    table = cut_lineage(_sweep(spark, d)[2])  # one row per event and cooldown, read twice
    spread = iv.long_effects(table).groupBy("cooldown_sec", "effect_type").agg(F.stddev_pop("effect").alias("sd"))
    out = iv.sensitivity(table, iterations=2000).join(spread, ["cooldown_sec", "effect_type"])
    return rounded(out.select("cooldown_sec", "effect_type", "n_events", "mean_effect", *_interval_checks("mean_effect", "n_events", 0.3)))


def _interval_checks(mean, n, tolerance):
    expected = F.lit(3.92) * F.col("sd") / F.sqrt(F.col(n))
    return [F.col(mean).between(F.col("ci95_low") - 1e-9, F.col("ci95_high") + 1e-9).alias("inside"),
            (F.abs(F.col("ci95_high") - F.col("ci95_low") - expected) <= tolerance * expected + 1e-9).alias("width_ok")]


@query("A40_chart_time_course", """SELECT cooldown_sec, bin_center_relative_sec, round(avg(m),6) AS score_trimmed_mean FROM (SELECT cooldown_sec, relative_bin*CAST(300 AS DOUBLE)+150 AS bin_center_relative_sec, phase,
  avg(score_trimmed_mean) AS m FROM course WHERE n_tracks>=3 AND base_situation='ALL' GROUP BY 1,2,3) GROUP BY 1,2""", **_until(ONE, "course"))
def a40_course(spark, d):
    return rounded(iv.chart_time_course(iv.event_course(_log(spark, d), _events(spark, d), DESIGN)))


@query("A40_chart_situations", """SELECT cooldown_sec, base_situation, round(avg(CASE WHEN phase='pre' THEN mean_score END),6) AS pre, round(avg(CASE WHEN phase='post' THEN mean_score END),6) AS post FROM summ GROUP BY 1,2""", **_until(ALLC, "summ"))
def a40_situations(spark, d):
    return rounded(iv.chart_situations(_sweep(spark, d)[1]))


@query("A40_chart_effects", """SELECT cooldown_sec, 'unadjusted' AS effect_type, round(avg(pre_unadjusted),6) AS pre, round(avg(post_unadjusted),6) AS post, round(avg(effect_unadjusted),6) AS effect FROM eff GROUP BY 1
  UNION ALL SELECT cooldown_sec, 'situation-standardized', round(avg(pre_standardized),6), round(avg(post_standardized),6), round(avg(effect_standardized),6) FROM eff GROUP BY 1""", **ALLC)
def a40_effects(spark, d):
    return rounded(iv.chart_effects(_sweep(spark, d)[2]))


PAIRED = """SELECT school_id, class_id, avg(CASE WHEN phase='pre' THEN classroom_score END) AS pre, avg(CASE WHEN phase='post' THEN classroom_score END) AS post,
  count_if(phase='pre') AS n_pre, count_if(phase='post') AS n_post FROM trial GROUP BY 1,2"""


@query("A10_paired_class_effects", "SELECT school_id, class_id, round(pre,6) AS pre, round(post,6) AS post, round(post-pre,6) AS effect_post_minus_pre, n_pre, n_post FROM pc WHERE pre IS NOT NULL AND post IS NOT NULL", pc=PAIRED)
def a10(spark, d):
    return rounded(iv.paired_class_effects(fx.trial(spark, d)))


@query("A11_class_effect_bootstrap", """SELECT count(*) AS n_classes, round(avg(post-pre),6) AS mean_effect, round(median(post-pre),6) AS median_class_effect, true AS inside, true AS width_ok,
  10000 AS bootstrap_iterations FROM pc WHERE pre IS NOT NULL AND post IS NOT NULL""", pc=PAIRED)
def a11(spark, d):
    effects = iv.paired_class_effects(fx.trial(spark, d))
    out = iv.class_effect_summary(effects, 10000, 42).join(effects.agg(F.stddev_pop("effect_post_minus_pre").alias("sd")), how="left")
    return rounded(out.select("n_classes", "mean_effect", "median_class_effect", "bootstrap_iterations", *_interval_checks("mean_effect", "n_classes", 0.1)))


@query("A11_class_effect_centre", "SELECT count(*) AS n_classes, round(avg(post-pre),6) AS mean_effect, round(median(post-pre),6) AS median_class_effect FROM pc WHERE pre IS NOT NULL AND post IS NOT NULL", pc=PAIRED)
def a11_centre(spark, d):
    out = iv.class_effect_summary(iv.paired_class_effects(fx.trial(spark, d)), 0)
    return rounded(out.select("n_classes", "mean_effect", "median_class_effect"))


# The shift is a difference of ratios of school totals: its error follows from the schools' deviations (the delta method).
@query("A14_bias_shift_bootstrap", """SELECT round(sum(post_error)/sum(post_n) - sum(pre_error)/sum(pre_n), 2) AS shift, true AS inside, true AS width_ok FROM (SELECT school_id,
  coalesce(sum(CASE WHEN phase='pre' THEN model_score-human_score END),0) AS pre_error, CAST(count_if(phase='pre') AS DOUBLE) AS pre_n,
  coalesce(sum(CASE WHEN phase='post' THEN model_score-human_score END),0) AS post_error, CAST(count_if(phase='post') AS DOUBLE) AS post_n FROM pairs GROUP BY 1)""")
def a14(spark, d):
    schools = iv.school_errors(fx.pairs(spark, d))
    s = schools.agg(F.count(F.lit(1)).alias("schools"), *[F.sum(c).alias(c) for c in ("pre_error", "pre_n", "post_error", "post_n")])
    both = schools.select(*[F.col(c).alias(f"own_{c}") for c in ("pre_error", "pre_n", "post_error", "post_n")]).join(F.broadcast(s))
    part = lambda p: (F.col(f"own_{p}_error") - F.col(f"{p}_error") / F.col(f"{p}_n") * F.col(f"own_{p}_n")) * F.col("schools") / F.col(f"{p}_n")
    shift = F.col("post_error") / F.col("post_n") - F.col("pre_error") / F.col("pre_n")
    facts = both.agg(F.max("schools").alias("n"), F.stddev_pop(part("post") - part("pre")).alias("sd"), F.max(shift).alias("shift"))
    out = iv.bias_shift(fx.pairs(spark, d), 10000, 42).join(facts, how="left")
    return out.select(F.round("shift", 2).alias("shift"), *_interval_checks("shift", "n", 0.1))


@query("A14_school_errors", """SELECT school_id, round(coalesce(sum(CASE WHEN phase='pre' THEN model_score-human_score END),0),4) AS pre_error, CAST(count_if(phase='pre') AS DOUBLE) AS pre_n,
  round(coalesce(sum(CASE WHEN phase='post' THEN model_score-human_score END),0),4) AS post_error, CAST(count_if(phase='post') AS DOUBLE) AS post_n FROM pairs GROUP BY 1""")
def a14_sums(spark, d):
    return rounded(iv.school_errors(fx.pairs(spark, d)), 4)


@query("A46_difference_in_differences", """SELECT count_if(tr) AS n_treated, count_if(NOT tr) AS n_control, round(avg(CASE WHEN tr THEN e END),6) AS treated_change, round(avg(CASE WHEN NOT tr THEN e END),6) AS control_change,
  round(avg(CASE WHEN tr THEN e END) - avg(CASE WHEN NOT tr THEN e END),6) AS effect FROM (SELECT school_id % 2 = 0 AS tr, post-pre AS e FROM pc WHERE pre IS NOT NULL AND post IS NOT NULL)""", pc=PAIRED)
def a46(spark, d):
    return rounded(iv.difference_in_differences(iv.paired_class_effects(fx.trial(spark, d)), F.col("school_id") % 2 == 0))
