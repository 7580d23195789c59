"""Agreement figures, training-set tables, poses and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from lessonlens.functions import numeric, pose, probs, text
from lessonlens.operators import agreement as ag, identity as idn, linking as ln, training as tr
from lessonlens.operators.segments import motion_feature_rows, pose_changes
from lessonlens.plans.catalogue import query
from lessonlens.plans.tools import DS, TWO_STORES, rounded
from lessonlens.sources import files, fixtures as fx

CLS = "CAST(least(7, greatest(1, round_even({0}, 0))) AS INT)"
EVA = f"SELECT phase, human_score AS y, model_score AS p, {CLS.format('human_score')} AS tc, {CLS.format('model_score')} AS pc FROM pairs"
CORR = "CASE WHEN isnan(corr({0},{1})) THEN NULL ELSE corr({0},{1}) END"
RNK = """SELECT phase, rank() OVER (PARTITION BY phase ORDER BY y) + (count(*) OVER (PARTITION BY phase, y) - 1)/2.0::DOUBLE AS ry,
  rank() OVER (PARTITION BY phase ORDER BY p) + (count(*) OVER (PARTITION BY phase, p) - 1)/2.0::DOUBLE AS rp FROM eva"""


@query("A13_phase_metrics", f"""SELECT phase, count(*) AS n, round(avg(abs(p-y)),6) AS mae, round(avg(p-y),6) AS bias, round(sqrt(avg((p-y)*(p-y))),6) AS rmse, round({CORR.format('y','p')},6) AS pearson FROM eva GROUP BY 1""", eva=EVA)
def a13(spark, d):
    return rounded(ag.phase_metrics(fx.pairs(spark, d)))


@query("A25_regression_metrics", f"""SELECT phase, count(*) AS n, round(avg(abs(p-y)),6) AS mae, round(sqrt(avg((p-y)*(p-y))),6) AS rmse, round(avg(p-y),6) AS bias, round(1 - sum((p-y)*(p-y))/(var_pop(y)*count(*)),6) AS r2, round({CORR.format('y','p')},6) AS pearson FROM eva GROUP BY 1""", eva=EVA)
def a25(spark, d):
    parts = ag.regression("human_score", "model_score")
    return rounded(fx.pairs(spark, d).groupBy("phase").agg(*[c.alias(n) for n, c in parts.items()]))


@query("A26_ordinal_agreement", """SELECT phase, round(avg(CASE WHEN tc=pc THEN 1.0::DOUBLE ELSE 0 END),6) AS exact_accuracy, round(avg(CASE WHEN abs(tc-pc)<=1 THEN 1.0::DOUBLE ELSE 0 END),6) AS within_1_accuracy,
  round(avg(CASE WHEN abs(tc-pc)<=2 THEN 1.0::DOUBLE ELSE 0 END),6) AS within_2_accuracy, round(avg(abs(tc-pc)),6) AS mean_absolute_class_error FROM eva GROUP BY 1""", eva=EVA)
def a26(spark, d):
    parts = ag.ordinal("human_score", "model_score")
    return rounded(fx.pairs(spark, d).groupBy("phase").agg(*[c.alias(n) for n, c in parts.items()]))


PERCLASS = {
    "eva": EVA, "cls": "SELECT phase, c, count_if(tc=c AND pc=c) AS tp, count_if(tc=c) AS sup, count_if(pc=c) AS cl FROM eva, range(1,8) AS r(c) GROUP BY 1,2",
    "prf": """SELECT *, CASE WHEN pr+re > 0 THEN 2*pr*re/(pr+re) ELSE 0 END AS f1 FROM (SELECT phase, c, tp, sup, CASE WHEN cl>0 THEN tp/CAST(cl AS DOUBLE) ELSE 0 END AS pr, CASE WHEN sup>0 THEN tp/CAST(sup AS DOUBLE) ELSE 0 END AS re FROM cls)""",
}


@query("A27_classification_report", """SELECT phase, CAST(c AS VARCHAR) AS label, round(pr,6) AS precision, round(re,6) AS recall, round(f1,6) AS f1, CAST(sup AS DOUBLE) AS support FROM prf
  UNION ALL SELECT phase, 'accuracy', round(sum(tp)/sum(sup),6), round(sum(tp)/sum(sup),6), round(sum(tp)/sum(sup),6), round(sum(tp)/sum(sup),6) FROM prf GROUP BY 1
  UNION ALL SELECT phase, 'macro avg', round(avg(pr),6), round(avg(re),6), round(avg(f1),6), CAST(sum(sup) AS DOUBLE) FROM prf GROUP BY 1
  UNION ALL SELECT phase, 'weighted avg', round(sum(pr*sup)/sum(sup),6), round(sum(re*sup)/sum(sup),6), round(sum(f1*sup)/sum(sup),6), CAST(sum(sup) AS DOUBLE) FROM prf GROUP BY 1""", **PERCLASS)
def a27(spark, d):
    return rounded(ag.classification_report(fx.pairs(spark, d), ["phase"], "human_score", "model_score"))


CELLS = ", ".join(f"count_if(pc={i} AND tc=c) AS pred_{i}, round(coalesce(count_if(pc={i} AND tc=c)/nullif(CAST(count_if(tc=c) AS DOUBLE),0),0),6) AS row_{i}" for i in range(1, 8))


@query("A28_confusion_matrix", f"SELECT phase, CAST(c AS INT) AS true_class, {CELLS} FROM eva, range(1,8) AS r(c) GROUP BY 1,2", eva=EVA)
def a28(spark, d):
    counts = ag.confusion(fx.pairs(spark, d), ["phase"], "human_score", "model_score")
    return rounded(ag.confusion_matrix(counts, ["phase"]))


@query("A29_weighted_kappa", """SELECT o.phase, round(1 - o.o/e.e, 6) AS kappa FROM (SELECT phase, sum((tc-pc)*(tc-pc)) AS o FROM eva GROUP BY 1) o JOIN (
  SELECT a.phase, sum((a.c-b.c)*(a.c-b.c)*a.n*b.n)/CAST(max(t.n) AS DOUBLE) AS e FROM (SELECT phase, tc AS c, count(*) AS n FROM eva GROUP BY 1,2) a JOIN (SELECT phase, pc AS c, count(*) AS n FROM eva GROUP BY 1,2) b ON a.phase=b.phase
  JOIN (SELECT phase, count(*) AS n FROM eva GROUP BY 1) t ON t.phase=a.phase GROUP BY 1) e ON e.phase=o.phase""", eva=EVA)
def a29(spark, d):
    k = ag.weighted_kappa(numeric.score_class(F.col("human_score")), numeric.score_class(F.col("model_score")))
    return rounded(fx.pairs(spark, d).groupBy("phase").agg(k.alias("kappa")))


@query("A30_spearman", "SELECT phase, round(corr(ry, rp),6) AS spearman FROM rnk GROUP BY 1", eva=EVA, rnk=RNK)
def a30(spark, d):
    return rounded(ag.spearman(fx.pairs(spark, d), ["phase"], "human_score", "model_score"))


@query("A25_A29_evaluation_report", f"""SELECT m.*, round(s.sp,6) AS spearman, round(w.wp,6) AS weighted_precision, round(w.wr,6) AS weighted_recall, round(w.wf,6) AS weighted_f1 FROM (
  SELECT phase, count(*) AS n, round(avg(abs(p-y)),6) AS mae, round(sqrt(avg((p-y)*(p-y))),6) AS rmse, round(avg(p-y),6) AS bias, round(1 - sum((p-y)*(p-y))/(var_pop(y)*count(*)),6) AS r2, round({CORR.format('y','p')},6) AS pearson,
  round(avg(CASE WHEN tc=pc THEN 1.0::DOUBLE ELSE 0 END),6) AS exact_accuracy, round(avg(CASE WHEN abs(tc-pc)<=1 THEN 1.0::DOUBLE ELSE 0 END),6) AS within_1_accuracy, round(avg(CASE WHEN abs(tc-pc)<=2 THEN 1.0::DOUBLE ELSE 0 END),6) AS within_2_accuracy,
  round(avg(abs(tc-pc)),6) AS mean_absolute_class_error, round(1 - avg((tc-pc)*(tc-pc))/(var_pop(tc)+var_pop(pc)+pow(avg(tc)-avg(pc),2)),6) AS quadratic_weighted_kappa FROM eva GROUP BY 1) m
  JOIN (SELECT phase, corr(ry, rp) AS sp FROM rnk GROUP BY 1) s ON s.phase=m.phase JOIN (SELECT phase, sum(pr*sup)/sum(sup) AS wp, sum(re*sup)/sum(sup) AS wr, sum(f1*sup)/sum(sup) AS wf FROM prf GROUP BY 1) w ON w.phase=m.phase""",
  **PERCLASS, rnk=RNK)
def evaluation(spark, d):
    return rounded(ag.evaluation_metrics(fx.pairs(spark, d), ["phase"], "human_score", "model_score"))


def _noisy(spark, d):
    """Pairs with a NaN or infinite prediction here and there."""
    bad = F.when(F.abs(F.col("model_score") - F.col("human_score") - 1.0) < 1e-9, F.lit(float("nan")))
    return fx.pairs(spark, d).withColumn("model_score", F.coalesce(bad, F.col("model_score")))


CLEAN = "SELECT * FROM eva WHERE NOT abs(p-y-1.0) < 1e-9"


@query("P9_A31_training_metrics", """SELECT e.phase, count(*) - max(c.n) AS nonfinite_pred, 0 AS nonfinite_target, round(max(c.mse),6) AS mse, round(max(c.rmse),6) AS rmse, round(max(c.mae),6) AS mae, round(max(c.r2),6) AS r2, round(max(c.qwk),6) AS qwk,
  round(max(c.ea),6) AS exact_accuracy, round(max(c.w1),6) AS within_one_accuracy, round(max(s.sp),6) AS spearman FROM eva e JOIN (
  SELECT phase, count(*) AS n, avg((p-y)*(p-y)) AS mse, sqrt(avg((p-y)*(p-y))) AS rmse, avg(abs(p-y)) AS mae, 1 - sum((p-y)*(p-y))/greatest(1e-8, var_pop(y)*count(*)) AS r2,
  1 - avg((tc-pc)*(tc-pc))/(var_pop(tc)+var_pop(pc)+pow(avg(tc)-avg(pc),2)) AS qwk, avg(CASE WHEN tc=pc THEN 1.0::DOUBLE ELSE 0 END) AS ea, avg(CASE WHEN abs(tc-pc)<=1 THEN 1.0::DOUBLE ELSE 0 END) AS w1 FROM cle GROUP BY 1) c ON c.phase=e.phase
  JOIN (SELECT phase, corr(ry, rp) AS sp FROM rk2 GROUP BY 1) s ON s.phase=e.phase GROUP BY 1""", eva=EVA, cle=CLEAN, rk2=RNK.replace("FROM eva", "FROM cle"))
def a31(spark, d):
    return rounded(ag.training_metrics(_noisy(spark, d), ["phase"], "human_score", "model_score"))


@query("A32_situation_accuracy", "SELECT video_path, count(*) AS n, round(avg(CASE WHEN situation = CASE WHEN track_id % 3 = 0 THEN '聞く' ELSE situation END THEN 1.0::DOUBLE ELSE 0 END),6) AS accuracy FROM pred GROUP BY 1")
def a32(spark, d):
    rows = fx.pred(spark, d).withColumn("predicted_situation", F.when(F.col("track_id") % 3 == 0, "聞く").otherwise(F.col("situation")))
    return rounded(ag.situation_accuracy(rows, ["video_path"]))


@query("A32_situation_confusion", """SELECT s AS situation, count_if(t=s AND p='聞く') AS pred_0, count_if(t=s AND p='書く') AS pred_1, count_if(t=s AND p='話し合う') AS pred_2 FROM (
  SELECT situation AS t, CASE WHEN track_id % 3 = 0 THEN '聞く' ELSE situation END AS p FROM pred), (SELECT unnest(['聞く','書く','話し合う']) AS s) GROUP BY 1""")
def a32_confusion(spark, d):
    rows = fx.pred(spark, d).withColumn("predicted_situation", F.when(F.col("track_id") % 3 == 0, "聞く").otherwise(F.col("situation")))
    return ag.situation_confusion(rows)


@query("A43_concordance", "SELECT phase, round(2*covar_pop(y,p)/(var_pop(y)+var_pop(p)+pow(avg(y)-avg(p),2)),6) AS ccc FROM eva GROUP BY 1", eva=EVA)
def a43(spark, d):
    return rounded(ag.concordance_table(fx.pairs(spark, d), ["phase"], "human_score", "model_score"))


@query("A44_intraclass_correlation", """SELECT n AS n_subjects, 3 AS n_raters, round((msr-mse)/(msr+2*mse+3*(msc-mse)/n),6) AS icc FROM (SELECT n, ssr/(n-1) AS msr, ssc/2 AS msc, (sst-ssr-ssc)/((n-1)*2) AS mse FROM (
  SELECT (SELECT count(*) FROM sm) AS n, (SELECT 3*sum(pow(m-g,2)) FROM sm, gm) AS ssr, (SELECT sum(pow(m-g,2))*(SELECT count(*) FROM sm) FROM rm, gm) AS ssc, (SELECT sum(pow(score-g,2)) FROM cmp, gm) AS sst))""",
  cmp="SELECT segment_id, rater, score FROM (SELECT *, count(*) OVER (PARTITION BY segment_id) AS k FROM ratings WHERE rater IN ('r1','r2','r3')) WHERE k = 3",
  sm="SELECT segment_id, avg(score) AS m FROM cmp GROUP BY 1", rm="SELECT rater, avg(score) AS m FROM cmp GROUP BY 1", gm="SELECT avg(score) AS g FROM cmp")
def a44(spark, d):
    return rounded(ag.intraclass(fx.labels(spark, d), "segment_id", "rater", "score", ["r1", "r2", "r3"]))


@query("A45_bland_altman", """SELECT phase, count(*) AS n, round(avg(p-y),6) AS bias, round(stddev_samp(p-y),6) AS sd, round(avg(p-y)-1.96*stddev_samp(p-y),6) AS lower_limit, round(avg(p-y)+1.96*stddev_samp(p-y),6) AS upper_limit FROM eva GROUP BY 1""", eva=EVA)
def a45(spark, d):
    return rounded(ag.bland_altman(fx.pairs(spark, d), ["phase"], "human_score", "model_score"))


CSER = """SELECT CASE track_id % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'students' ELSE 'teacher' END AS series, CAST(floor(t/300) AS INT) AS bin, track_id, avg(score) AS s FROM pred GROUP BY 1,2,3"""


@query("A47_lesson_comparison", """SELECT x.*, round(sp,6) AS spearman FROM (SELECT a.series AS series_a, b.series AS series_b, count(*) AS n, round(corr(a.v,b.v),6) AS pearson, round(avg(abs(b.v-a.v)),6) AS mae, round(avg(b.v-a.v),6) AS bias
  FROM cs a JOIN cs b ON a.bin=b.bin AND a.series<b.series GROUP BY 1,2) x JOIN (SELECT sa, sb, corr(ra, rb) AS sp FROM (SELECT a.series AS sa, b.series AS sb, rank() OVER (PARTITION BY a.series, b.series ORDER BY a.v) AS ra, rank() OVER (PARTITION BY a.series, b.series ORDER BY b.v) AS rb
  FROM cs a JOIN cs b ON a.bin=b.bin AND a.series<b.series) GROUP BY 1,2) y ON y.sa=x.series_a AND y.sb=x.series_b""", cse=CSER, cs="SELECT series, bin, avg(s) AS v FROM cse GROUP BY 1,2")
def a47(spark, d):
    k = F.col("track_id") % 3
    rows = fx.pred(spark, d).withColumn("series", F.when(k == 0, "model").when(k == 1, "students").otherwise("teacher"))
    return rounded(ag.compare_series(ag.class_series(rows, ["series"]), ["bin"]))


# Training-set tables.

@query("P5_eligible_datasets", """SELECT dataset_id, role, phase, CASE WHEN role='development' AND phase IN ('normal','pilot_post') THEN true ELSE false END AS eligible FROM (
  SELECT o_orderkey AS dataset_id, CASE WHEN o_orderstatus='F' THEN 'trial' ELSE 'development' END AS role, CASE WHEN o_orderpriority LIKE '1%' THEN 'normal' WHEN o_orderpriority LIKE '2%' THEN 'pilot_post' ELSE 'pre' END AS phase FROM orders)""")
def p5(spark, d):
    pr = F.col("o_orderpriority")
    rows = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("dataset_id"), F.when(F.col("o_orderstatus") == "F", "trial").otherwise("development").alias("role"),
        F.when(pr.like("1%"), "normal").when(pr.like("2%"), "pilot_post").otherwise("pre").alias("phase"))
    return rows.withColumn("eligible", tr.eligible_dataset(F.col("role"), F.col("phase"), True))


@query("P6_role_of_phase", "SELECT phase, CASE WHEN phase IN ('pre','post') THEN 'trial' ELSE 'development' END AS role, count(*) AS n FROM (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'normal' WHEN o_orderpriority LIKE '2%' THEN 'post' ELSE 'pre' END AS phase FROM orders) GROUP BY 1,2")
def p6(spark, d):
    pr = F.col("o_orderpriority")
    phase = F.when(pr.like("1%"), "normal").when(pr.like("2%"), "post").otherwise("pre")
    rows = fx.table(spark, d, "orders").select(phase.alias("phase"))
    return rows.groupBy("phase", tr.role_of_phase(F.col("phase")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


CONS = """SELECT r.segment_id, avg(score) AS mean_score, count(*) AS rater_count, sqrt(count(*)*sum(score*score) - sum(score)*sum(score))/count(*) AS score_std FROM ratings r GROUP BY 1"""


def _consensus(spark, d):
    from lessonlens.operators import ratings as rt
    placed = fx.seg(spark, d).join(fx.win(spark, d), "window_id")
    return rt.consensus(fx.labels(spark, d)).join(placed, "segment_id")


@query("P7_eligible_labels", "SELECT c.segment_id, round(mean_score,6) AS mean_score FROM con c JOIN seg s ON s.segment_id=c.segment_id JOIN win w ON w.window_id=s.window_id WHERE rater_count >= 2 AND score_std <= 1.5 AND w.situation IN ('聞く','書く','話し合う')", con=CONS)
def p7(spark, d):
    return rounded(tr.eligible_labels(_consensus(spark, d), 2, 1.5).select("segment_id", "mean_score"))


def _split(spark, d, **kw):
    items = fx.seg(spark, d).join(fx.win(spark, d), "window_id")
    group = text.window_group(F.lit("0"), F.lit(1).cast("bigint"), F.col("t_start"), F.col("t_end"))
    return tr.split_by_group(items, group, **kw)


@query("M1_F23_grouped_split_counts", """SELECT CAST(count(DISTINCT window_id) AS BIGINT) AS groups, CAST(round_even(count(DISTINCT window_id)*0.2, 0) AS BIGINT) AS validation_groups, 0 AS straddling FROM seg""")
def m1_counts(spark, d):
    # counts, as the least and the greatest of texts would sort every row
    s = _split(spark, d).groupBy("split_group").agg(F.count_if(F.col("split") == "validation").alias("v"), F.count("split").alias("n"))
    return s.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("v") > 0).alias("validation_groups"),
                 F.count_if((F.col("v") > 0) & (F.col("v") < F.col("n"))).alias("straddling"))


DRAW = "CAST('0x' || substr(md5('42:' || {}), 1, 15) AS BIGINT)"


@query("M1_grouped_split", """SELECT segment_id, split_group, CASE WHEN n <= (SELECT round_even(max(n)*0.2, 0) FROM num) THEN 'validation' ELSE 'train' END AS split FROM named JOIN num USING (split_group)""",
       named="SELECT segment_id, printf('window:0:1:%.6f:%.6f', t_start, t_end) AS split_group FROM seg JOIN win USING (window_id)",
       num=f"SELECT split_group, row_number() OVER (ORDER BY {DRAW.format('split_group')}, split_group) AS n FROM (SELECT DISTINCT split_group FROM named)")
def m1(spark, d):
    return _split(spark, d).select("segment_id", "split_group", "split")


@query("M1_explicit_holdout", "SELECT segment_id, CASE WHEN window_id IN (10, 20) THEN 'validation' ELSE 'train' END AS split FROM seg")
def m1_holdout(spark, d):
    return _split(spark, d, holdouts=["window:0:1:50.000000:55.000000", "window:0:1:100.000000:105.000000"]).select("segment_id", "split")


@query("M2_dataset_folds", "SELECT dataset_id, CAST((dense_rank() OVER (ORDER BY dataset_id) - 1) % 4 AS INT) AS fold FROM (SELECT DISTINCT video_path AS dataset_id FROM pred)")
def m2(spark, d):
    return tr.dataset_folds(fx.pred(spark, d).select(F.col("video_path").alias("dataset_id")), 4)


@query("M3_leakage_audit", "SELECT window_id, track_id, count(*) AS n FROM seg GROUP BY 1,2 HAVING min(segment_id % 7 = 0) <> max(segment_id % 7 = 0)")
def m3(spark, d):
    s = fx.seg(spark, d).withColumn("split", F.when(F.col("segment_id") % 7 == 0, "validation").otherwise("train"))
    return tr.leaks(s, ["window_id", "track_id"])


@query("M4_label_lookup", "SELECT s.segment_id, round(avg(r.score),6) AS label FROM seg s JOIN ratings r ON r.segment_id=s.segment_id WHERE r.rater IN ('r1','r4') GROUP BY 1")
def m4(spark, d):
    return rounded(tr.label_lookup(fx.seg(spark, d), fx.labels(spark, d), ["r1", "r4"]).select("segment_id", "label"))


@query("M4_consensus_lookup", "SELECT s.segment_id, round(mean_score,6) AS label FROM seg s JOIN con c ON c.segment_id=s.segment_id", con=CONS)
def m4_consensus(spark, d):
    return rounded(tr.label_lookup(fx.seg(spark, d), consensus=_consensus(spark, d)).select("segment_id", "label"))


@query("M6_experiment_grid", "SELECT variant, seed, fold FROM (SELECT DISTINCT o_orderpriority AS variant FROM orders), (SELECT unnest([1,2]) AS seed), (SELECT unnest([0,1,2]) AS fold)")
def m6(spark, d):
    variants = fx.table(spark, d, "orders").select(F.col("o_orderpriority").alias("variant")).distinct()
    return tr.experiment_grid(variants, [1, 2], [0, 1, 2])


@query("M7_split_differences", "SELECT segment_id, split, side FROM (SELECT segment_id, 'validation' AS split, 'source' AS side FROM seg WHERE segment_id % 5 = 0 AND segment_id % 7 > 0 UNION ALL SELECT segment_id, 'train', 'base' FROM seg WHERE segment_id % 5 = 0 AND segment_id % 7 > 0 UNION ALL SELECT segment_id, 'train', 'source' FROM seg WHERE segment_id % 5 > 0 AND segment_id % 35 = 0)")
def m7(spark, d):
    from lessonlens.operators.merging import topology_differences
    s = fx.seg(spark, d)
    a = s.withColumn("split", F.when(F.col("segment_id") % 5 == 0, "validation").otherwise("train"))
    b = s.withColumn("split", F.when(F.col("segment_id") % 35 == 0, "validation").otherwise("train"))
    return topology_differences(a, b, ["segment_id", "split"])


@query("M8_sequence_flips", f"SELECT segment_id, {DRAW.format('segment_id')} % 2 = 0 AS flip FROM seg")
def m8(spark, d):
    return fx.seg(spark, d).select("segment_id", tr.flips(F.col("segment_id"), 42).alias("flip"))


@query("A33_majority_baseline", f"""SELECT m.c AS majority, round(avg(CASE WHEN round_even(mean_score,0)=m.c THEN 1.0::DOUBLE ELSE 0 END),6) AS baseline FROM con, (SELECT c FROM (SELECT {CLS.format('mean_score')} AS c, count(*) AS n FROM con WHERE segment_id % 5 > 0 GROUP BY 1) ORDER BY n DESC, c LIMIT 1) m WHERE segment_id % 5 = 0 GROUP BY 1""", con=CONS)
def a33(spark, d):
    c = _consensus(spark, d).withColumnRenamed("mean_score", "label")
    return rounded(tr.majority_baseline(c.where("segment_id % 5 > 0"), c.where("segment_id % 5 = 0")))


@query("A34_class_weights", f"""SELECT CAST(g AS INT) AS class, coalesce(n,0) AS count, round(least(3, CASE WHEN n > 0 THEN 1/sqrt(n) ELSE 0 END / (SELECT sum(sqrt(n))/sum(n) FROM cc)),6) AS weight FROM range(1,8) AS r(g) LEFT JOIN cc ON cc.c=g""",
       con=CONS, cc=f"SELECT {CLS.format('mean_score')} AS c, count(*) AS n FROM con GROUP BY 1")
def a34(spark, d):
    return rounded(tr.class_weights(_consensus(spark, d), "mean_score"))


@query("A38_best_epochs", "SELECT variant, seed, fold, epoch, round(val_exact_accuracy,6) AS val_exact_accuracy FROM (SELECT *, row_number() OVER (PARTITION BY variant, seed, fold ORDER BY val_exact_accuracy DESC, epoch) AS k FROM runs) WHERE k=1")
def a38(spark, d):
    return rounded(tr.best_epochs(fx.runs(spark, d)).select("variant", "seed", "fold", "epoch", "val_exact_accuracy"))


@query("A38_best_epochs_by_error", "SELECT variant, seed, fold, epoch, round(val_mae,6) AS val_mae FROM (SELECT *, row_number() OVER (PARTITION BY variant, seed, fold ORDER BY val_mae, epoch) AS k FROM runs) WHERE k=1")
def a38_error(spark, d):
    return rounded(tr.best_epochs(fx.runs(spark, d), "mae").select("variant", "seed", "fold", "epoch", "val_mae"))


BEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant, seed, fold ORDER BY val_exact_accuracy DESC, epoch) AS k FROM runs) WHERE k=1"


@query("A37_cross_validation_summary", """SELECT variant, runs, round(acc,6) AS mean_exact_accuracy, round(sd,6) AS std_exact_accuracy, round(mae,6) AS mean_mae, round(qwk,6) AS mean_qwk, epochs AS recommended_epochs, list_ AS fold_best_epochs, row_number() OVER (ORDER BY acc DESC, mae) = 1 AS selected FROM (
  SELECT variant, count(*) AS runs, avg(val_exact_accuracy) AS acc, coalesce(stddev_samp(val_exact_accuracy),0) AS sd, avg(val_mae) AS mae, avg(val_qwk) AS qwk, CAST(greatest(1, ceil(median(epoch))) AS BIGINT) AS epochs, list(epoch ORDER BY seed, fold) AS list_ FROM bst GROUP BY 1)""", bst=BEST)
def a37(spark, d):
    return rounded(tr.cv_summary(tr.best_epochs(fx.runs(spark, d))))


@query("A39_split_manifest", "SELECT CAST(track_id % 4 AS VARCHAR) AS dataset_id, count_if(segment_id % 5 > 0) AS train, count_if(segment_id % 5 = 0) AS validation FROM seg GROUP BY 1")
def a39(spark, d):
    s = fx.seg(spark, d).select((F.col("track_id") % 4).cast("string").alias("dataset_id"),
                                F.when(F.col("segment_id") % 5 == 0, "validation").otherwise("train").alias("split"))
    return tr.split_manifest(s)


def _pose_frames(spark, d):
    e = fx.poses(spark, d)
    return e.select("segment_id", F.col("vec_id").cast("double").alias("t"), F.col("vec_id").alias("frame_idx"), "kpts")


def _items(spark, d):
    s = F.col("segment_id")
    kind = F.when(s % 3 == 0, "聞く").when(s % 3 == 1, "書く").otherwise("話し合う")
    return fx.poses(spark, d).select("segment_id").distinct().select("segment_id", kind.alias("situation"), (1 + s % 7).cast("double").alias("label"))


@query("M5_training_examples", f"""SELECT dataset_id, segment_id, count(*) AS n_frames, 10 AS frames, 103 AS width, CAST(1 + segment_id % 7 AS DOUBLE) AS label, CAST(CASE WHEN segment_id % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS listen FROM (SELECT label AS segment_id FROM embeddings), {TWO_STORES} GROUP BY 1, 2""")
def m5(spark, d):
    x = tr.training_examples(fx.stores(_pose_frames(spark, d)), fx.stores(_items(spark, d)), 10, ds=DS)
    return x.select(*DS, "segment_id", "n_frames", F.size("features").alias("frames"), F.size(F.element_at("features", 1)).alias("width"), "label",
                    F.element_at("situation_one_hot", 1).alias("listen"))


@query("X1_linear_ordinal_scores")
def x1(spark, d):
    x = tr.training_examples(_pose_frames(spark, d), _items(spark, d), 10)
    last = F.element_at("features", -1)
    score = tr.linear_ordinal_score(last, [0.05] * 103, [-2.0, -1.0, 0.0, 1.0, 2.0, 3.0])
    return rounded(x.select("segment_id", score.alias("pred_score")))


# The label to learn is told by the pose: how far the first joint lies to one side. A third of the items is held out.
@query("X1_batch_scorer", """SELECT segment_id, count(*) AS n_frames, true AS as_columns, true AS on_scale FROM (SELECT label AS segment_id FROM embeddings) WHERE segment_id % 3 = 0 GROUP BY 1""")
def x1_batch(spark, d):
    x = tr.training_examples(_pose_frames(spark, d), _items(spark, d), 10).select("segment_id", "n_frames", F.element_at("features", -1).alias("features"))
    labels = x.withColumn("label", F.least(F.lit(7.0), F.greatest(F.lit(1.0), F.rint(4 + 2 * F.element_at("features", 1)))))
    model = tr.fit_ordinal(labels.where("segment_id % 3 > 0"))
    held = x.where("segment_id % 3 = 0")
    scored = tr.score_ordinal(held.withColumn("by_column", model.score(F.col("features"))), model, ["segment_id", "n_frames", "by_column"])
    return scored.select("segment_id", "n_frames", (F.abs(F.col("pred_score") - F.col("by_column")) < 1e-9).alias("as_columns"),
                         F.col("pred_score").between(1, 7).alias("on_scale"))


# Poses and identities.

VIS = "SELECT vec_id, avg(x) AS mx, avg(y) AS my FROM points WHERE conf >= 0.05 GROUP BY 1"
RAD = "SELECT p.vec_id, any_value(mx) AS mx, any_value(my) AS my, sqrt(greatest(1e-6, avg(pow(x-mx,2)+pow(y-my,2)))) AS s FROM points p JOIN vis v ON v.vec_id=p.vec_id WHERE conf >= 0.05 GROUP BY 1"


@query("F9_normalised_poses", "SELECT p.vec_id, CAST(p.k AS INT) AS k, round((x-mx)/s,6) AS x, round((y-my)/s,6) AS y, round(conf,6) AS conf FROM points p JOIN rad r ON r.vec_id=p.vec_id", vis=VIS, rad=RAD)
def f9(spark, d):
    p = fx.poses(spark, d).select("vec_id", F.posexplode(pose.normalise_pose(F.col("kpts"), 0.05)).alias("k", "p"))
    return rounded(p.select("vec_id", "k", "p.*"))


@query("F10_mirrored_poses", "SELECT p.vec_id, CAST(CASE WHEN p.k = 0 THEN 0 WHEN p.k % 2 = 1 THEN p.k + 1 ELSE p.k - 1 END AS INT) AS k, round(-x,6) + 0 AS x, round(y,6) AS y FROM points p")
def f10(spark, d):
    p = fx.poses(spark, d).select("vec_id", F.posexplode(pose.mirror_pose(F.col("kpts"))).alias("k", "p"))
    return rounded(p.select("vec_id", "k", "p.x", "p.y"))


@query("F12_frame_coordinates", "SELECT vec_id, CAST(k AS INT) AS k, round(x*2+10,6) AS x, round(y*CAST(1.5 AS DOUBLE)+20,6) AS y FROM points")
def f12(spark, d):
    moved = pose.to_frame(F.col("kpts"), F.lit(100), F.lit(200), F.lit(200), F.lit(300), F.lit(10), F.lit(20))
    p = fx.poses(spark, d).select("vec_id", F.posexplode(moved).alias("k", "p"))
    return rounded(p.select("vec_id", "k", "p.x", "p.y"))


BONE = {"bn": """SELECT a.vec_id, a.segment_id, (a.x+b.x)/2 AS cx, (a.y+b.y)/2 AS cy, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) AS w, a.conf >= 0.2 AND b.conf >= 0.2 AS both_
  FROM points a JOIN points b ON a.vec_id=b.vec_id AND a.k=5 AND b.k=6""",
        "rl": """SELECT p.vec_id, p.segment_id, p.k, both_ AND conf >= 0.2 AND w > 1e-4 AS ok, CASE WHEN both_ AND conf >= 0.2 AND w > 1e-4 THEN greatest(-5, least(5, (x-cx)/greatest(w,1e-4))) ELSE 0 END AS x,
  CASE WHEN both_ AND conf >= 0.2 AND w > 1e-4 THEN greatest(-5, least(5, (y-cy)/greatest(w,1e-4))) ELSE 0 END AS y FROM points p JOIN bn ON bn.vec_id=p.vec_id"""}


@query("F11_motion_features", """SELECT vec_id, CAST(c AS INT) AS i, round(v,6) + 0 AS v FROM (
  SELECT vec_id, 2*k AS c, x AS v FROM rl UNION ALL SELECT vec_id, 2*k+1, y FROM rl
  UNION ALL SELECT vec_id, 34+2*k, dx FROM dl UNION ALL SELECT vec_id, 35+2*k, dy FROM dl
  UNION ALL SELECT vec_id, 68+k, least(1, conf) FROM points
  UNION ALL SELECT a.vec_id, 85+2*e, CASE WHEN a.conf>=0.2 AND b.conf>=0.2 THEN (b.x-a.x)/greatest(sqrt(pow(b.x-a.x,2)+pow(b.y-a.y,2)),1e-4) ELSE 0 END FROM eg JOIN points a ON a.k=p0 JOIN points b ON b.k=p1 AND b.vec_id=a.vec_id
  UNION ALL SELECT a.vec_id, 86+2*e, CASE WHEN a.conf>=0.2 AND b.conf>=0.2 THEN (b.y-a.y)/greatest(sqrt(pow(b.x-a.x,2)+pow(b.y-a.y,2)),1e-4) ELSE 0 END FROM eg JOIN points a ON a.k=p0 JOIN points b ON b.k=p1 AND b.vec_id=a.vec_id)""", **BONE,
  dl="""SELECT vec_id, k, CASE WHEN ok AND pok THEN x-px ELSE 0 END AS dx, CASE WHEN ok AND pok THEN y-py ELSE 0 END AS dy FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, coalesce(lag(ok) OVER w, false) AS pok FROM rl WINDOW w AS (PARTITION BY segment_id, k ORDER BY vec_id))""",
  eg="SELECT unnest(range(0,9)) AS e, unnest([5,5,6,5,7,6,8,5,6]) AS p0, unnest([6,11,12,7,9,8,10,0,0]) AS p1")
def f11(spark, d):
    rows = motion_feature_rows(_pose_frames(spark, d), chunk_width=100.0)
    return rounded(rows.select(F.col("frame_idx").alias("vec_id"), F.posexplode("features").alias("i", "v")))


@query("W20_pose_changes", """SELECT vec_id, CAST(k AS INT) AS k, round(CASE WHEN ok AND pok THEN x-px ELSE 0 END,6) + 0 AS dx, round(CASE WHEN ok AND pok THEN y-py ELSE 0 END,6) + 0 AS dy FROM (SELECT vec_id, k, x, y, conf >= 0.2 AS ok, lag(x) OVER w AS px, lag(y) OVER w AS py,
  coalesce(lag(conf) OVER w >= 0.2, false) AS pok FROM points WINDOW w AS (PARTITION BY segment_id, k ORDER BY vec_id))""")
def w20(spark, d):
    flagged = F.transform("kpts", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"), (p.conf >= 0.2).alias("ok")))
    frames = _pose_frames(spark, d).select("segment_id", "t", "frame_idx", flagged.alias("kpts"))
    moved = pose_changes(frames, chunk_width=100.0)
    return rounded(moved.select(F.col("frame_idx").alias("vec_id"), F.posexplode("change").alias("k", "c")).select("vec_id", "k", "c.*"))


PAIRV = {"nb": "SELECT a.vec_id, a.embedding AS u, b.embedding AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"}


def _vector_pairs(spark, d):
    e = fx.faces(spark, d)
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("emb").alias("v"))
    return e.select("vec_id", F.col("emb").alias("u")).join(after, "vec_id")


@query("F17_cosine_distance", """SELECT vec_id, round(1 - d/((sqrt(a)+1e-6)*(sqrt(b)+1e-6)),6) AS distance FROM (SELECT vec_id, sum(x*y) AS d, sum(x*x) AS a, sum(y*y) AS b FROM (SELECT vec_id, CAST(unnest(u) AS DOUBLE) AS x, CAST(unnest(v) AS DOUBLE) AS y FROM nb) GROUP BY 1)""", **PAIRV)
def f17(spark, d):
    return rounded(_vector_pairs(spark, d).select("vec_id", pose.cosine_distance(F.col("u"), F.col("v")).alias("distance")))


@query("F18_mean_l1_distance", "SELECT vec_id, round(avg(abs(x-y)),6) AS distance FROM (SELECT vec_id, CAST(unnest(u) AS DOUBLE) AS x, CAST(unnest(v) AS DOUBLE) AS y FROM nb) GROUP BY 1", **PAIRV)
def f18(spark, d):
    return rounded(_vector_pairs(spark, d).select("vec_id", pose.mean_l1(F.col("u"), F.col("v")).alias("distance")))


@query("F16_match_vectors", """SELECT vec_id, count(*)*2 AS length, round(sum(abs((x-mx)/s) + abs((y-my)/s)),6) AS total FROM (SELECT p.*, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM (SELECT *, count(*) FILTER (conf >= 0.1) OVER (PARTITION BY vec_id) AS vis FROM points) p
  WHERE conf >= 0.1 OR vis < 4 WINDOW w AS (PARTITION BY vec_id)) q JOIN (SELECT vec_id, sqrt(avg(pow(x-mx,2)+pow(y-my,2)))+1e-6 AS s FROM (SELECT p.*, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM (SELECT *, count(*) FILTER (conf >= 0.1) OVER (PARTITION BY vec_id) AS vis FROM points) p
  WHERE conf >= 0.1 OR vis < 4 WINDOW w AS (PARTITION BY vec_id)) GROUP BY 1) r USING (vec_id) GROUP BY 1""")
def f16(spark, d):
    rows = fx.poses(spark, d).select("vec_id", pose.match_vector(F.col("kpts"), 0.1).alias("v"))
    return rounded(rows.select("vec_id", F.size("v").cast("bigint").alias("length"), numeric.array_sum(F.col("v"), F.abs).alias("total")))


@query("S6_pose_json", "SELECT vec_id, CAST(k AS INT) AS k, CASE WHEN vec_id % 7 = 0 OR k >= 15 THEN 0 ELSE round(x,4) END AS x, CASE WHEN vec_id % 7 = 0 OR k >= 15 THEN 0 ELSE round(conf,4) END AS conf FROM points")
def s6(spark, d):
    triples = F.transform(F.slice("kpts", 1, 15), lambda p: F.array(p.x, p.y, p.conf))
    text_ = F.when(F.col("vec_id") % 7 == 0, "{broken").otherwise(F.to_json(F.struct(triples.alias("keypoints"))))
    parsed = files.parse_pose_json(fx.poses(spark, d).select("vec_id", text_.alias("j")), "j")
    return rounded(parsed.select("vec_id", F.posexplode("kpts").alias("k", "p")).select("vec_id", "k", "p.x", "p.conf"), 4)


CENT = """SELECT name, i, v / CASE WHEN sqrt(sum(v*v) OVER (PARTITION BY name)) > 1e-6 THEN sqrt(sum(v*v) OVER (PARTITION BY name)) ELSE 1 END AS v FROM (
  SELECT name, i, avg(v) AS v FROM (SELECT name, generate_subscripts(emb, 1) - 1 AS i, CAST(unnest(emb) AS DOUBLE) AS v FROM faces) GROUP BY 1,2)"""


@query("A42_identity_centroids", "SELECT name, CAST(i AS INT) AS i, round(v,6) AS v FROM cen", cen=CENT)
def a42(spark, d):
    return rounded(idn.centroids(fx.faces(spark, d)).select("name", F.posexplode("emb").alias("i", "v")))


NEAR = """SELECT vec_id, arg_max(name, struct_pack(s := s, n := name)) AS name, max(s) AS s FROM (SELECT f.vec_id, c.name, sum(f.v*c.v) AS s FROM (SELECT vec_id, generate_subscripts(emb,1) - 1 AS i, CAST(unnest(emb) AS DOUBLE) AS v FROM faces) f JOIN cen c ON c.i=f.i GROUP BY 1,2) GROUP BY 1"""


def _matches(spark, d, **kw):
    faces = fx.faces(spark, d)
    return idn.nearest_identity(faces.select(F.col("vec_id").alias("face_id"), "emb"), idn.centroids(faces), 0.3, **kw)


@query("J15_nearest_identity", "SELECT vec_id AS face_id, CASE WHEN s >= 0.3 THEN name END AS matched_name, round(s,6) AS similarity FROM nr", cen=CENT, nr=NEAR)
def j15(spark, d):
    return rounded(_matches(spark, d).select("face_id", "matched_name", "similarity"))


@query("J15_nearest_identity_in_blocks", "SELECT vec_id AS face_id, CASE WHEN s >= 0.3 THEN name END AS matched_name, round(s,6) AS similarity FROM nr", cen=CENT, nr=NEAR)
def j15_blocks(spark, d):
    return rounded(_matches(spark, d, block_people=4, block_faces=200).select("face_id", "matched_name", "similarity"))


@query("A41_face_votes", """SELECT segment_id, name, coalesce(c,0) AS matches, round(coalesce(c,0)/CAST(frames AS DOUBLE),6) AS ratio, coalesce(c,0) >= 2 AND coalesce(c,0)/CAST(frames AS DOUBLE) >= 0.5 AS excluded FROM (SELECT segment_id, count(*) AS frames FROM vt GROUP BY 1) LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY c DESC, f) AS k FROM (SELECT segment_id, name, count(*) AS c, min(frame_idx) AS f FROM vt WHERE name IS NOT NULL GROUP BY 1,2)) WHERE k=1) USING (segment_id)""",
  vt="SELECT track_id % 40 AS segment_id, frame_idx, CASE WHEN track_id % 40 < 5 AND frame_idx % 10 > 0 THEN 'px' WHEN frame_idx % 3 > 0 THEN concat('p', CAST(frame_idx % 4 AS VARCHAR)) END AS name FROM pred")
def a41(spark, d):
    i = F.col("frame_idx")
    seg = F.col("track_id") % 40
    rows = fx.pred(spark, d).select(seg.alias("segment_id"), "frame_idx", F.when((seg < 5) & (i % 10 > 0), "px").when(
        i % 3 > 0, F.concat(F.lit("p"), (i % 4).cast("string"))).alias("matched_name"))
    return rounded(idn.face_votes(rows, ["segment_id"], "frame_idx"))


@query("J16_linked_detections")
def j16(spark, d):
    det = fx.detections(spark, d).select("video_path", F.floor("t").cast("bigint").alias("frame_idx"), F.col("id").alias("det_id"), "x1", "y1", "x2", "y2")
    return ln.link_detections(det).select("video_path", "frame_idx", "det_id", "stable_id")


# Scalar functions over the prediction log.

@query("F2_F3_score_classes", f"SELECT frame_idx, {CLS.format('score*2-3')} AS class FROM pred")
def f2(spark, d):
    return fx.pred(spark, d).select("frame_idx", numeric.score_class(F.col("score") * 2 - 3).alias("class"))


@query("F4_one_hot", "SELECT situation, CAST(k AS INT) AS place, count_if(situation = ['聞く','書く','話し合う'][k+1]) AS hits FROM pred, range(0,3) AS r(k) GROUP BY 1,2")
def f4(spark, d):
    padded = probs.one_hot(F.concat(F.lit(" "), F.col("situation")))
    hits = fx.pred(spark, d).select("situation", F.posexplode(padded).alias("place", "h"))
    return hits.groupBy("situation", "place").agg(F.sum("h").cast("bigint").alias("hits"))


@query("F5_clean_paths", "SELECT url, regexp_extract(trim(replace(url, '\\', '/')), '[^/]*$') AS name FROM pages")
def f5(spark, d):
    c = text.clean_path(F.col("url"))
    return fx.table(spark, d, "pages").select("url", F.element_at(F.split(c, "/"), -1).alias("name"))


LOGITS = "SELECT frame_idx, score-3 AS a, 2-score AS b, t/1000 AS c FROM pred"


def _logits(spark, d):
    return fx.pred(spark, d).select("frame_idx", F.array(F.col("score") - 3, 2 - F.col("score"), F.col("t") / 1000).alias("z"))


@query("F21_F25_softmax", """SELECT frame_idx, round(exp(a-m)/(exp(a-m)+exp(b-m)+exp(c-m)),6) AS p0, round(exp(c-m)/(exp(a-m)+exp(b-m)+exp(c-m)),6) AS p2, CASE WHEN a=m THEN '聞く' WHEN b=m THEN '書く' ELSE '話し合う' END AS best FROM (SELECT *, greatest(a,b,c) AS m FROM lg)""", lg=LOGITS)
def f21(spark, d):
    p = _logits(spark, d).select("frame_idx", probs.parse_probs(F.to_json(probs.softmax(F.col("z")))).alias("p"))
    return rounded(p.select("frame_idx", F.element_at("p", 1).alias("p0"), F.element_at("p", 3).alias("p2"), probs.best_situation(F.col("p")).alias("best")))


@query("F19_ordinal_expected_score", """SELECT frame_idx, round(1 + 1/(1+exp(-a)) + 1/(1+exp(-(a-ln(1+exp(b))))) + 1/(1+exp(-(a-ln(1+exp(b))-ln(1+exp(c))))),6) AS score FROM lg""", lg=LOGITS)
def f19(spark, d):
    return rounded(_logits(spark, d).select("frame_idx", probs.expected_score(probs.monotone_logits(F.col("z"))).alias("score")))


@query("F20_ordinal_entropy", """SELECT frame_idx, round(-(list_sum(list_transform([a,b,c], lambda z: greatest(1e-6,least(1-1e-6,1/(1+exp(-z))))*ln(greatest(1e-6,least(1-1e-6,1/(1+exp(-z))))) + (1-greatest(1e-6,least(1-1e-6,1/(1+exp(-z)))))*ln(1-greatest(1e-6,least(1-1e-6,1/(1+exp(-z))))))))/3/ln(2),6) AS entropy FROM lg""", lg=LOGITS)
def f20(spark, d):
    return rounded(_logits(spark, d).select("frame_idx", probs.ordinal_entropy(F.col("z")).alias("entropy")))


@query("F26_number_lists", "SELECT frame_idx, CASE WHEN frame_idx % 4 = 0 THEN NULL ELSE list_sort(list_distinct([CAST(frame_idx % 7 AS DOUBLE), CAST(frame_idx % 3 AS DOUBLE), 2.0::DOUBLE])) END AS numbers FROM pred")
def f26(spark, d):
    i = F.col("frame_idx")
    written = F.format_string("%d, %d,,2.0", i % 7, i % 3)
    return fx.pred(spark, d).select("frame_idx", text.number_list(F.when(i % 4 == 0, "-1,2").otherwise(written)).alias("numbers"))


@query("F27_finite_values", "SELECT frame_idx, CASE WHEN frame_idx % 3 = 0 THEN NULL ELSE round(score,6) END AS score FROM pred")
def f27(spark, d):
    i = F.col("frame_idx") % 6
    dirty = F.when(i == 0, float("nan")).when(i == 3, float("inf")).otherwise(F.col("score"))
    return rounded(fx.pred(spark, d).select("frame_idx", numeric.finite(dirty).alias("score")))


# Averages along time.

@query("W11_score_average", """SELECT a.frame_idx, round(sum(CASE WHEN b.i = 1 THEN pow(0.7::DOUBLE, a.i-1) ELSE 0.3*pow(0.7::DOUBLE, a.i-b.i) END * b.score),6) AS smooth FROM ord a JOIN ord b ON a.track_id=b.track_id AND b.i<=a.i GROUP BY 1""",
       ord="SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY video_path, t, frame_idx) AS i FROM pred")
def w11(spark, d):
    from lessonlens.operators import scans
    chunk = F.struct("video_path", scans.time_chunk("t", 600.0).alias("c"))
    return rounded(scans.exponential_average(
        fx.pred(spark, d), ["track_id"], ["video_path", "t", "frame_idx"], {"smooth": "score"}, 0.3, chunk).select("frame_idx", "smooth"))


@query("W12_situation_average", """SELECT a.frame_idx, round(sum(CASE WHEN b.i = 1 THEN pow(0.85::DOUBLE, a.i-1) ELSE 0.15*pow(0.85::DOUBLE, a.i-b.i) END * b.p0),6) AS p0 FROM ord a JOIN ord b ON a.video_path=b.video_path AND b.i<=a.i GROUP BY 1""",
       ord="SELECT *, score/(score+2+t/1000) AS p0, row_number() OVER (PARTITION BY video_path ORDER BY t, frame_idx) AS i FROM pred")
def w12(spark, d):
    from lessonlens.operators.smoothing import smooth_situations
    raw = fx.pred(spark, d).withColumn("probs", F.array(F.col("score"), F.lit(2.0), F.col("t") / 1000))
    out = smooth_situations(raw, ["video_path"], ["t", "frame_idx"], "probs", 0.15)
    return rounded(out.select("frame_idx", F.element_at("smoothed_probs", 1).alias("p0")))


@query("W13_box_average", """SELECT a.id, round(sum(CASE WHEN b.i = 1 THEN pow(2::DOUBLE/3, a.i-1) ELSE pow(2::DOUBLE/3, a.i-b.i)/3 END * b.x1),6) AS x1 FROM ord a JOIN ord b ON a.track_id=b.track_id AND a.video_path=b.video_path AND b.i<=a.i GROUP BY 1""",
       ord="SELECT *, row_number() OVER (PARTITION BY video_path, track_id ORDER BY t, id) AS i FROM detections")
def w13(spark, d):
    from lessonlens.operators.smoothing import smooth_boxes
    return rounded(smooth_boxes(fx.detections(spark, d), ["video_path", "track_id"], ["t", "id"], 1.0 / 3.0).select("id", F.col("smooth_x1").alias("x1")))
