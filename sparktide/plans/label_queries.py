"""Queries over labels and predictions: smoothing, metrics, splits and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparktide.operators import classifiers, coverage, intervals, metrics, smoothing, splits, validation
from sparktide.plans.mapping import STRIDE, WINDOW, embedding_labels, episodes, events, features, predictions, recordings, utc, windows, with_
from sparktide.plans.registry import query

SEED = 42
_P = with_("pred")
_EP = with_("emb", "ep")


def _rounded(df, *names, digits=9):
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if c in names else c for c in df.columns])


def _metrics_sql(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    r = lambda a, b: f"round(coalesce(({a})::DOUBLE / nullif({b}, 0), 0), 9)"
    return f"""SELECT {k}tp, fp, fn, tn, {r('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {r('tp', 'tp + fp')} AS precision_1, {r('tp', 'tp + fn')} AS recall_1, {r('2 * tp', '2 * tp + fp + fn')} AS f1_1,
 {r('tn', 'tn + fn')} AS precision_0, {r('tn', 'tn + fp')} AS recall_0, {r('2 * tn', '2 * tn + fp + fn')} AS f1_0, {r('tp', 'tp + fn')} AS sensitivity, {r('tn', 'tn + fp')} AS specificity"""


_COUNT = "count(*) FILTER (pred = 1 AND y = 1) AS tp, count(*) FILTER (pred = 1 AND y = 0) AS fp, count(*) FILTER (pred = 0 AND y = 1) AS fn, count(*) FILTER (pred = 0 AND y = 0) AS tn"
_SHARES = ("accuracy", "precision_1", "recall_1", "f1_1", "precision_0", "recall_0", "f1_0", "sensitivity", "specificity")
_CURVE = "c AS (SELECT score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM {0} GROUP BY 1), cv AS (SELECT score, p, n, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM c)"


@query(_P + """, s AS (SELECT doc_id, pred, CASE WHEN avg(pred) OVER (ORDER BY doc_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) >= 0.5 THEN 1 ELSE 0 END AS smoothed FROM pred) SELECT * FROM s""")
def q13_smooth_global(spark, sf_dir):
    return smoothing.smooth(predictions(spark, sf_dir), "doc_id", "pred", 5).select("doc_id", "pred", "smoothed")


_Q14 = _P + """, s AS (SELECT doc_id, subject, pred, CASE WHEN avg(pred) OVER (PARTITION BY subject ORDER BY doc_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) >= 0.5 THEN 1 ELSE 0 END AS smoothed FROM pred)"""


@query(_Q14 + " SELECT doc_id, subject, pred, smoothed FROM s")
def q14_smooth_per_subject(spark, sf_dir):
    return smoothing.smooth(predictions(spark, sf_dir), "doc_id", "pred", 5, by=["subject"]).select("doc_id", "subject", "pred", "smoothed")


@query(_Q14 + " SELECT subject, count(*) AS n, count(*) FILTER (pred <> smoothed) AS changed, round(avg((pred = smoothed)::INTEGER), 9) AS equal_share FROM s GROUP BY 1")
def q69_smoothing_change_rate(spark, sf_dir):
    out = smoothing.smooth(predictions(spark, sf_dir), "doc_id", "pred", 5, by=["subject"])
    return out.groupBy("subject").agg(F.count("*").alias("n"), smoothing.changed("pred").alias("changed"), F.round(F.avg((F.col("pred") == F.col("smoothed")).cast("int")), 9).alias("equal_share"))


@query(_P + " SELECT l.y AS label, count(pred.y) AS n, count(DISTINCT subject) AS subjects FROM (VALUES (0), (1)) l(y) LEFT JOIN pred USING (y) GROUP BY 1")
def q15_class_counts(spark, sf_dir):
    counts = predictions(spark, sf_dir).groupBy(F.col("y").alias("label")).agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))
    return spark.range(2).select(F.col("id").cast("int").alias("label")).join(counts, "label", "left").fillna(0)


def _split(spark, sf_dir, test_size=0.4):
    return splits.stratified_subject_split(splits.subject_rates(windows(spark, sf_dir).withColumn("y", F.col("y")), "subject", "y"), "subject", test_size)


_SPLIT = with_("emb") + """, r AS (SELECT subject, count(*) AS n_windows, sum(y)::BIGINT AS n_positive, avg(y) AS rate FROM emb GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY rate, subject) - 1 AS pos, count(*) OVER () AS n FROM r),
k AS (SELECT max(n) AS n, greatest(1, floor(max(n) * 0.4::DOUBLE)::INTEGER) AS k FROM o), picks AS (SELECT DISTINCT floor(i * (n::DOUBLE / k))::BIGINT AS pos FROM (SELECT n, k, unnest(generate_series(0, k - 1)) AS i FROM k)),
split AS (SELECT subject, n_windows, n_positive, rate, CASE WHEN pos IN (SELECT pos FROM picks) THEN 'test' ELSE 'train' END AS split FROM o)"""


@query(_SPLIT + " SELECT subject, n_windows, n_positive, round(rate, 9) AS rate, split FROM split")
def q39_stratified_subject_split(spark, sf_dir):
    return _rounded(_split(spark, sf_dir).select("subject", "n_windows", "n_positive", "rate", "split"), "rate")


@query(_SPLIT + """ SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test, (SELECT count(*) FROM (SELECT subject FROM split WHERE split = 'train' INTERSECT SELECT subject FROM split WHERE split = 'test')) AS leaked,
 (SELECT count(*) FROM emb WHERE subject IN (SELECT subject FROM split WHERE split = 'test')) AS test_windows FROM split""")
def q40_leakage_check(spark, sf_dir):
    split = _split(spark, sf_dir)
    leaked = splits.leakage(split, "subject").agg(F.count("*").alias("leaked"))
    test = windows(spark, sf_dir).join(split.where("split = 'test'"), "subject", "left_semi").agg(F.count("*").alias("test_windows"))
    return split.agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test")).crossJoin(leaked).crossJoin(test)


@query(_SPLIT + """ SELECT 256.0::DOUBLE AS sample_rate, 4 AS n_channels, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (split = 'train' AND y = 1) AS train_class_1, count(*) FILTER (split = 'test' AND y = 1) AS test_class_1,
 count(DISTINCT CASE WHEN split = 'train' THEN subject END) AS n_subjects_train, count(DISTINCT CASE WHEN split = 'test' THEN subject END) AS n_subjects_test FROM emb JOIN split USING (subject)""")
def q16_manifest(spark, sf_dir):
    from sparktide.sources.artifacts import manifest

    rows = windows(spark, sf_dir).join(_split(spark, sf_dir).select("subject", "split"), "subject")
    return manifest(rows, 256.0, 4).select("sample_rate", "n_channels", "n_train", "n_test", "train_class_1", "test_class_1", "n_subjects_train", "n_subjects_test")


@query(with_("emb") + " SELECT vec_id, subject, row_number() OVER (PARTITION BY subject ORDER BY vec_id) - 1 AS pos FROM emb")
def q17_subject_map_roundtrip(spark, sf_dir):
    from sparktide.sources.artifacts import subject_index

    index = subject_index(windows(spark, sf_dir), "subject", "vec_id")
    return windows(spark, sf_dir).select("vec_id").join(index, "vec_id").select("vec_id", "subject", "pos")


@query("SELECT source, count(*) FILTER (l.doc_id IS NOT NULL) AS n_ok, count(*) FILTER (l.doc_id IS NULL) AS n_missing, CASE WHEN bool_or(l.doc_id IS NULL) THEN 'no label' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def q18_dead_letters(spark, sf_dir):
    docs = utc(spark, sf_dir, "documents").select("doc_id", "source")
    fine, dead = coverage.dead_letters(docs, utc(spark, sf_dir, "labels").select("doc_id"), "doc_id", "no label")
    both = fine.select("source", F.lit(None).cast("string").alias("reason")).union(dead.select("source", "reason"))
    return both.groupBy("source").agg(F.count_if(F.col("reason").isNull()).alias("n_ok"), F.count_if(F.col("reason").isNotNull()).alias("n_missing"), F.max("reason").alias("reason"))


@query(_SPLIT + " SELECT split.split AS split, subject, count(*) AS n, sum(y)::BIGINT AS n_positive, round(avg(y), 9) AS rate FROM emb JOIN split USING (subject) GROUP BY ROLLUP (split.split, subject)")
def q19_split_statistics(spark, sf_dir):
    rows = windows(spark, sf_dir).join(_split(spark, sf_dir).select("subject", "split"), "subject")
    return rows.rollup("split", "subject").agg(F.count("*").alias("n"), F.sum("y").alias("n_positive"), F.round(F.avg("y"), 9).alias("rate"))


@query(_SPLIT + """, c AS (SELECT split.split AS split, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM emb JOIN split USING (subject) GROUP BY 1), m AS (SELECT split, avg(rate) AS mean_rate FROM split GROUP BY 1)
SELECT split, n0, n1, round(n0::DOUBLE / nullif(n1, 0), 9) AS imbalance, round(100.0::DOUBLE * n1 / (n0 + n1), 9) AS percent_1, round(mean_rate, 9) AS mean_rate FROM c JOIN m USING (split)""")
def q20_imbalance_report(spark, sf_dir):
    split = _split(spark, sf_dir)
    counts = windows(spark, sf_dir).join(split.select("subject", "split"), "subject").groupBy("split").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    means = split.groupBy("split").agg(F.avg("rate").alias("mean_rate"))
    return counts.join(means, "split").select("split", "n0", "n1", F.round(F.try_divide(F.col("n0").cast("double"), F.col("n1")), 9).alias("imbalance"), F.round(100.0 * F.col("n1") / (F.col("n0") + F.col("n1")), 9).alias("percent_1"), F.round("mean_rate", 9).alias("mean_rate"))


@query(f"WITH x AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CASE WHEN l_quantity / 50 >= 0.5 THEN 1 ELSE 0 END AS pred FROM lineitem), k AS (SELECT {_COUNT} FROM x) {_metrics_sql()} FROM k")
def q33_window_metrics(spark, sf_dir):
    rows = utc(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50 >= 0.5).cast("int").alias("pred"))
    return _rounded(metrics.classification(metrics.confusion(rows, "y", "pred")), *_SHARES)


_AUC = "round(sum(n * ((tp - p) + p / 2.0::DOUBLE)) / nullif(max(pp) * max(nn), 0), 9) AS roc_auc, round(sum(p::DOUBLE / nullif(pp, 0) * tp / (tp + fp)), 9) AS average_precision"


@query(f"WITH x AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity / 50 AS score FROM lineitem), {_CURVE.format('x')} SELECT {_AUC} FROM cv")
def q34_auc_ap(spark, sf_dir):
    rows = utc(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("score"))
    return _rounded(metrics.ranking(metrics.curve(rows, "y", "score")), "roc_auc", "average_precision")


@query(f"{_P}, {_CURVE.format('pred')} SELECT score, round(fp / nn::DOUBLE, 9) AS fpr, round(tp / pp::DOUBLE, 9) AS tpr FROM cv")
def q35_roc_points(spark, sf_dir):
    return _rounded(metrics.roc_points(metrics.curve(predictions(spark, sf_dir), "y", "score")), "fpr", "tpr")


@query(f"{_P}, {_CURVE.format('pred')} SELECT score, round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / pp::DOUBLE, 9) AS recall, round(2.0::DOUBLE * tp / (tp + fp + pp), 9) AS f1, round(pp::DOUBLE / (pp + nn), 9) AS prevalence FROM cv")
def q36_pr_points(spark, sf_dir):
    return _rounded(metrics.precision_recall_points(metrics.curve(predictions(spark, sf_dir), "y", "score")), "precision", "recall", "f1", "prevalence")


@query(f"""{_P}, {_CURVE.format('pred')}, b AS (SELECT score AS threshold, 2.0::DOUBLE * tp / (tp + fp + pp) AS f1, pp FROM cv ORDER BY f1 DESC, threshold LIMIT 1),
a AS (SELECT sum(p::DOUBLE / pp * (tp::DOUBLE / (tp + fp) + CASE WHEN tp + fp - p - n > 0 THEN (tp - p)::DOUBLE / (tp + fp - p - n) ELSE 1 END) / 2) AS pr_area FROM cv)
SELECT CASE WHEN pp > 0 THEN threshold ELSE 0.5 END AS threshold, round(f1, 9) AS f1, round(pr_area, 9) AS pr_area FROM b, a""")
def q36b_best_f1_threshold(spark, sf_dir):
    points = metrics.curve(predictions(spark, sf_dir), "y", "score")
    return _rounded(metrics.best_f1(points).crossJoin(metrics.trapezoid(points)), "f1", "pr_area")


_SUBJ = "CASE WHEN 2 * sum(y) > count(*) THEN 1 ELSE 0 END AS y"


@query(f"{_EP}, s AS (SELECT subject, {_SUBJ}, CASE WHEN 2 * sum(pred) > count(*) THEN 1 ELSE 0 END AS pred FROM ep GROUP BY 1), k AS (SELECT {_COUNT}, count(*) AS n_subjects FROM s) {_metrics_sql('n_subjects')} FROM k")
def q37_subject_majority_metrics(spark, sf_dir):
    subjects = metrics.by_subject(embedding_labels(spark, sf_dir), "subject", "y", "pred", None)
    out = metrics.classification(metrics.confusion(subjects, "y", "pred")).crossJoin(subjects.agg(F.count("*").alias("n_subjects")))
    return _rounded(out, *_SHARES)


@query(f"""{_EP}, s AS (SELECT 'mean_proba' AS how, subject, {_SUBJ}, avg(score) AS score FROM ep GROUP BY subject UNION ALL SELECT 'max_proba', subject, {_SUBJ}, max(score) FROM ep GROUP BY subject), t AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM s),
k AS (SELECT how, {_COUNT} FROM t GROUP BY 1) {_metrics_sql('how')} FROM k""")
def q38_subject_proba_metrics(spark, sf_dir):
    out = None
    for how in ("mean_proba", "max_proba"):
        subjects = metrics.by_subject(embedding_labels(spark, sf_dir), "subject", "y", "pred", "score", how).withColumn("how", F.lit(how))
        part = metrics.classification(metrics.confusion(subjects, "y", "pred", ["how"]), ["how"])
        out = part if out is None else out.union(part)
    return _rounded(out, *_SHARES)


_FOLD = "f AS (SELECT subject, maj, (row_number() OVER (PARTITION BY maj ORDER BY md5('42-' || subject), subject) - 1) % 3 AS fold FROM (SELECT subject, CASE WHEN 2 * sum(y) > count(*) THEN 1 ELSE 0 END AS maj FROM ep GROUP BY 1))"


def _folds(spark, sf_dir):
    subjects = metrics.by_subject(embedding_labels(spark, sf_dir), "subject", "y", "pred", None).select("subject", F.col("y").alias("maj"))
    return splits.subject_folds(subjects, "subject", "maj", 3, SEED)


@query(f"{_EP}, {_FOLD} SELECT subject, maj, fold FROM f")
def q53_subject_kfold(spark, sf_dir):
    return _folds(spark, sf_dir).select("subject", "maj", F.col("fold").cast("long").alias("fold"))


@query(f"{_EP}, {_FOLD}, k AS (SELECT fold, {_COUNT} FROM ep JOIN f USING (subject) GROUP BY 1), m AS ({_metrics_sql('fold')} FROM k), l AS (UNPIVOT (SELECT accuracy, f1_1, sensitivity, specificity FROM m) ON accuracy, f1_1, sensitivity, specificity INTO NAME metric VALUE v) SELECT metric, round(avg(v), 7) AS mean, round(stddev_pop(v), 7) AS std FROM l GROUP BY 1")
def q43_cv_summary(spark, sf_dir):
    rows = embedding_labels(spark, sf_dir).join(_folds(spark, sf_dir).select("subject", "fold"), "subject")
    per_fold = _rounded(metrics.classification(metrics.confusion(rows, "y", "pred", ["fold"]), ["fold"]), *_SHARES)
    return _rounded(validation.summary(per_fold, ["accuracy", "f1_1", "sensitivity", "specificity"]), "mean", "std", digits=7)


@query(f"""{_EP}, {_FOLD}, g AS (SELECT (row_number() OVER (ORDER BY c, o, k, r) - 1)::INTEGER AS param_idx, c AS "C", o AS mvar_order, k AS n_basis, r AS regularization FROM (VALUES (0.1::DOUBLE), (1.0)) a(c), (VALUES (2::BIGINT), (3)) b(o), (VALUES (5::BIGINT), (10)) d(k), (VALUES (0.1::DOUBLE), (1.0)) e(r))
SELECT param_idx, "C", mvar_order, n_basis, regularization, fold, count(*) AS n_fit FROM g, (SELECT DISTINCT fold FROM f) h JOIN (SELECT fold AS other, vec_id FROM ep JOIN f USING (subject)) t ON t.other <> h.fold GROUP BY ALL""")
def q44_param_grid(spark, sf_dir):
    rows = embedding_labels(spark, sf_dir).join(_folds(spark, sf_dir).select("subject", "fold"), "subject").groupBy(F.col("fold").alias("other")).agg(F.count("*").alias("n"))
    tasks = rows.select(F.col("other").alias("fold")).join(rows, F.col("fold") != F.col("other")).groupBy("fold").agg(F.sum("n").alias("n_fit"))
    grid = validation.parameter_grid(spark, validation.FULL_GRID)
    return tasks.crossJoin(F.broadcast(grid)).select("param_idx", "C", "mvar_order", "n_basis", "regularization", F.col("fold").cast("long").alias("fold"), "n_fit")


@query(f"""{_EP}, {_FOLD}, i AS (SELECT fold, p AS param_idx, subject, round(avg(CASE WHEN (CASE WHEN score >= p / 10.0::DOUBLE THEN 1 ELSE 0 END) = y THEN 1 ELSE 0 END), 9) AS score FROM ep JOIN f USING (subject), (SELECT unnest(generate_series(0, 10)) AS p) GROUP BY 1, 2, 3),
m AS (SELECT fold, param_idx, avg(score) AS score FROM i GROUP BY 1, 2) SELECT fold, param_idx, round(score, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(score, 6) DESC, param_idx) = 1""")
def q45_best_param_per_fold(spark, sf_dir):
    """The cut-off that is right for most windows, from the mean over each fold's subjects."""
    rows = embedding_labels(spark, sf_dir).join(_folds(spark, sf_dir).select("subject", "fold"), "subject").withColumn("param_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))))
    right = ((F.col("score") >= F.col("param_idx") / 10.0).cast("int") == F.col("y")).cast("int")
    inner = rows.groupBy("fold", "param_idx", "subject").agg(F.round(F.avg(right), 9).alias("score")).groupBy("fold", "param_idx").agg(F.round(F.avg("score"), 6).alias("score"))
    return validation.best_parameters(inner).select(F.col("fold").cast("long").alias("fold"), "param_idx", F.round("score", 6).alias("score"))


@query(_SPLIT + " SELECT subject, n_windows, n_positive FROM split WHERE split = 'train' ORDER BY n_positive DESC, subject LIMIT 5")
def q46_topk_subjects(spark, sf_dir):
    return _split(spark, sf_dir).where("split = 'train'").orderBy(F.desc("n_positive"), "subject").limit(5).select("subject", "n_windows", "n_positive")


@query(_SPLIT + " SELECT vec_id, subject, y, split.split AS split FROM emb JOIN split USING (subject)")
def q47_union_train_test(spark, sf_dir):
    rows = windows(spark, sf_dir).select("vec_id", "subject", "y").join(_split(spark, sf_dir).select("subject", "split"), "subject")
    return rows.where("split = 'train'").unionByName(rows.where("split = 'test'")).select("vec_id", "subject", "y", "split")


@query(_SPLIT + """, z AS (SELECT subject, split, CASE WHEN n_positive > 25 THEN n_positive ELSE 0 END AS n_positive FROM split), a AS (SELECT count(*) FILTER (split = 'test' AND n_positive > 0) AS has, min(CASE WHEN split = 'train' AND n_positive > 0 THEN subject END) AS i, min(CASE WHEN split = 'test' AND n_positive = 0 THEN subject END) AS o FROM z)
SELECT subject, CASE WHEN has = 0 AND i IS NOT NULL AND subject = i THEN 'test' WHEN has = 0 AND i IS NOT NULL AND subject = o THEN 'train' ELSE split END AS split FROM z, a""")
def q48_subject_swap(spark, sf_dir):
    some = _split(spark, sf_dir).withColumn("n_positive", F.when(F.col("n_positive") > 25, F.col("n_positive")).otherwise(0))
    return splits.swap_for_positives(some, "subject").select("subject", "split")


_LABELS = "(SELECT doc_id, toxic AS y FROM labels)"


@query(f"SELECT doc_id, y FROM {_LABELS} QUALIFY row_number() OVER (PARTITION BY y ORDER BY md5('42-' || doc_id), doc_id) <= CASE y WHEN 0 THEN 90 ELSE 30 END")
def q49_class_caps(spark, sf_dir):
    rows = utc(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"))
    return splits.cap_classes(rows, "y", "doc_id", spark.createDataFrame([(0, 90), (1, 30)], "y int, cap long"), SEED)


@query(f"SELECT doc_id, y FROM {_LABELS} QUALIFY row_number() OVER (PARTITION BY y ORDER BY md5('42-' || doc_id), doc_id) <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic))")
def q50_undersample(spark, sf_dir):
    return splits.undersample(utc(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y")), "y", "doc_id", SEED).select("doc_id", "y")


@query(f"WITH r AS (SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('42-' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY y) AS n FROM {_LABELS}), m AS (SELECT max(n) AS m FROM r) SELECT doc_id, y, unnest(generate_series(0, (m - r) // n)) AS copy FROM r, m")
def q51_oversample(spark, sf_dir):
    return splits.oversample(utc(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y")), "y", "doc_id", SEED).select("doc_id", "y", "copy")


@query("""WITH c AS (SELECT toxic AS y, count(*) AS n FROM labels GROUP BY 1), t AS (SELECT sum(n) AS total FROM c)
SELECT size, y, n, CASE WHEN total <= 2 * size THEN n ELSE round_even(2.0::DOUBLE * size * n / total, 0)::BIGINT END AS quota, (CASE WHEN total <= 2 * size THEN n ELSE round_even(2.0::DOUBLE * size * n / total, 0)::BIGINT END) < 30 AND y = 1 AS few FROM c, t, (VALUES (50), (100), (500), (1000), (2000)) s(size)""")
def q52_stratified_quota(spark, sf_dir):
    out = splits.quotas(utc(spark, sf_dir, "labels").select(F.col("toxic").alias("y")), "y", [50, 100, 500, 1000, 2000])
    return out.withColumn("few", (F.col("quota") < 30) & (F.col("y") == 1))


@query("WITH c AS (SELECT toxic AS y, count(*) AS n FROM labels GROUP BY 1) SELECT y, n, round((SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n), 9) AS weight, round(power((SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n), 2), 9) AS squared FROM c")
def q54_balanced_weights(spark, sf_dir):
    return _rounded(splits.balanced_weights(utc(spark, sf_dir, "labels").select(F.col("toxic").alias("y")), "y"), "weight", "squared")


@query(f"""{_P}, {_CURVE.format('pred')}, k AS (SELECT {_COUNT} FROM pred), a AS (SELECT sum(n * ((tp - p) + p / 2.0::DOUBLE)) / (max(pp) * max(nn)) AS auc FROM cv),
s AS (SELECT count(*) AS missed FROM (SELECT subject FROM pred GROUP BY 1 HAVING sum(y) > 0 AND sum(y * pred) = 0))
SELECT tp / (tp + fn)::DOUBLE > 0.5 AND tp / (tp + fp)::DOUBLE < 0.05 AS many_false_alarms, auc < 0.5 AS worse_than_chance, missed > 0 AS misses_subjects, missed AS n_missed FROM k, a, s""")
def q55_diagnosis_flags(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    m = metrics.classification(metrics.confusion(rows, "y", "pred")).select("sensitivity", F.col("precision_1"))
    auc = metrics.ranking(metrics.curve(rows, "y", "score")).select("roc_auc")
    missed = rows.groupBy("subject").agg(F.sum("y").alias("a"), F.sum(F.col("y") * F.col("pred")).alias("b")).agg(F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("n_missed"))
    return m.crossJoin(auc).crossJoin(missed).select(((F.col("sensitivity") > 0.5) & (F.col("precision_1") < 0.05)).alias("many_false_alarms"), (F.col("roc_auc") < 0.5).alias("worse_than_chance"), (F.col("n_missed") > 0).alias("misses_subjects"), "n_missed")


@query("""WITH s AS (SELECT source, count(*) AS n, CASE WHEN sum(toxic) > 0 THEN 1 ELSE 0 END AS has FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, has, CASE WHEN row_number() OVER (ORDER BY md5('42-' || source), source) <= ceil(count(*) OVER () * 0.2::DOUBLE - 1e-9) THEN 'test' ELSE 'train' END AS plain, CASE WHEN row_number() OVER (PARTITION BY has ORDER BY md5('42-' || source), source) <= ceil(count(*) OVER (PARTITION BY has) * 0.2::DOUBLE - 1e-9) THEN 'test' ELSE 'train' END AS stratified FROM s""")
def q67_group_shuffle_split(spark, sf_dir):
    docs = utc(spark, sf_dir, "documents").select("doc_id", "source").join(utc(spark, sf_dir, "labels"), "doc_id")
    subjects = docs.groupBy("source").agg((F.sum("toxic") > 0).cast("int").alias("has"))
    plain = splits.group_shuffle_split(subjects, "source", 0.2, SEED).withColumnRenamed("split", "plain")
    return splits.group_shuffle_split(plain, "source", 0.2, SEED, ["has"]).withColumnRenamed("split", "stratified")


@query(f"""{_P}, t AS (SELECT subject, i, i / 10.0::DOUBLE AS thr, count(*) FILTER (score >= i / 10.0::DOUBLE AND y = 1) AS tp, count(*) FILTER (score >= i / 10.0::DOUBLE AND y = 0) AS fp, count(*) FILTER (score < i / 10.0::DOUBLE AND y = 1) AS fn FROM pred, (SELECT unnest(generate_series(0, 10)) AS i) GROUP BY 1, 2),
u AS (SELECT *, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM t), b AS (SELECT subject, thr FROM u QUALIFY row_number() OVER (PARTITION BY subject ORDER BY f1 DESC, i) = 1), a AS (SELECT i, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM t GROUP BY 1)
SELECT i::INTEGER AS i, tp, fp, fn, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall, round((SELECT median(thr) FROM b), 9) AS median_best FROM a""")
def q68_threshold_table(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(10))))
    hit, y = F.col("score") >= F.col("i") / 10.0, F.col("y")
    t = rows.groupBy("subject", "i").agg(F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit & (y == 0)).alias("fp"), F.count_if(~hit & (y == 1)).alias("fn"))
    f1 = F.round(metrics.or_zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 9)
    best = t.groupBy("subject").agg((-F.max(F.struct(f1.alias("f1"), (-F.col("i")).alias("low")))["low"] / 10.0).alias("thr")).agg(F.round(F.median("thr"), 9).alias("median_best"))
    total = t.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return total.crossJoin(best).select("i", "tp", "fp", "fn", F.round(metrics.or_zero(F.col("tp"), F.col("tp") + F.col("fp")), 9).alias("precision"), F.round(metrics.or_zero(F.col("tp"), F.col("tp") + F.col("fn")), 9).alias("recall"), "median_best")


_MED = with_("emb", "feat") + ", m AS (SELECT median(f) FILTER (y = 0) AS m0, median(f) FILTER (y = 1) AS m1 FROM feat)"


@query(_MED + " SELECT round(m0, 6) AS m0, round(m1, 6) AS m1, m0 < m1 AS ascending FROM m")
def q29_class_medians(spark, sf_dir):
    return _rounded(classifiers.class_medians(features(spark, sf_dir), "f", "y"), "m0", "m1", digits=6)


_GRID = _MED + """, b AS (SELECT min(f) AS lo, max(f) AS hi FROM feat), g AS (SELECT i::INTEGER AS i, CASE WHEN i = 99 THEN hi ELSE lo + i * ((hi - lo) / 99) END AS thr, m0 < m1 AS up FROM b, m, (SELECT unnest(generate_series(0, 99)) AS i)),
x AS (SELECT i, thr, y, CASE WHEN (up AND f > thr) OR (NOT up AND f < thr) THEN 1 ELSE 0 END AS pred FROM feat, g), k AS (SELECT i, thr, """ + _COUNT + """ FROM x GROUP BY 1, 2),
e AS (SELECT *, tp / (tp + fp + 1e-9::DOUBLE) AS pr, tp / (tp + fn + 1e-9::DOUBLE) AS se, tn / (tn + fp + 1e-9::DOUBLE) AS sp FROM k),
sc AS (SELECT 'f1' AS metric, i, thr, 2 * pr * se / (pr + se + 1e-9::DOUBLE) AS score FROM e UNION ALL SELECT 'f1_weighted', i, thr, 2 * pr * se / (pr + se + 1e-9::DOUBLE) + 0.7::DOUBLE * se * 0.01::DOUBLE FROM e UNION ALL SELECT 'youden', i, thr, se + sp - 1 FROM e UNION ALL SELECT 'youden_weighted', i, thr, 0.7::DOUBLE * se + 0.3::DOUBLE * sp FROM e),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY metric ORDER BY round(score, 9) DESC, i) = 1)"""
_VARIANTS = {"f1": ("f1", None), "f1_weighted": ("f1", 0.7), "youden": ("youden", None), "youden_weighted": ("youden", 0.7)}


def _models(spark, sf_dir):
    rows = features(spark, sf_dir)
    medians = classifiers.class_medians(rows, "f", "y")
    counts = classifiers.threshold_counts(rows, "f", "y", medians)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.round(classifiers.score_expression(*v), 9).alias("score")) for name, v in _VARIANTS.items()])).alias("s")
    scored = counts.select("i", "thr", each).select("i", "thr", "s.*")
    first = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("score"), "i"))  # one row for each step
    return rows, scored.withColumn("first", first).where("first = 1").drop("first").crossJoin(medians)


@query(_GRID + " SELECT metric, i, round(thr, 6) AS thr, round(score, 7) AS score FROM best")
def q30_threshold_search(spark, sf_dir):
    return _models(spark, sf_dir)[1].select("metric", "i", F.round("thr", 6).alias("thr"), F.round("score", 7).alias("score"))


@query(_GRID + " SELECT vec_id, y, CASE WHEN (m0 < m1 AND f > thr) OR (NOT m0 < m1 AND f < thr) THEN 1 ELSE 0 END AS pred FROM feat, best, m WHERE metric = 'f1'")
def q31_threshold_predict(spark, sf_dir):
    rows, models = _models(spark, sf_dir)
    return classifiers.predict_threshold(rows, "f", models.where("metric = 'f1'")).select("vec_id", "y", "pred")


@query(_MED + " SELECT vec_id, round(abs(f - m0) / (abs(f - m0) + abs(f - m1) + 1e-10::DOUBLE), 6) AS proba FROM feat, m")
def q32_distance_proba(spark, sf_dir):
    rows = features(spark, sf_dir)
    model = classifiers.class_medians(rows, "f", "y").withColumn("thr", F.lit(0.0))
    return classifiers.predict_threshold(rows, "f", model).select("vec_id", F.round("proba", 6).alias("proba"))


@query(with_("ev", "rec", "epi") + f""", w AS (SELECT w.user_id, w.start, max(CASE WHEN epi.b IS NULL THEN 0 ELSE 1 END) AS label
FROM (SELECT user_id, unnest(generate_series(0, n - {WINDOW}, {STRIDE})) AS start FROM rec WHERE n >= {WINDOW}) w LEFT JOIN epi ON epi.user_id = w.user_id AND w.start < epi.e AND w.start + {WINDOW} > epi.b GROUP BY 1, 2)
SELECT user_id, count(*) AS n_windows, sum(label)::BIGINT AS n_positive, round(avg(label), 9) AS rate FROM w GROUP BY 1""")
def flagship_seizure_rate(spark, sf_dir):
    """Hopping windows of each user's recording, labelled by overlap with error episodes, and their rate."""
    ev = events(spark, sf_dir)
    labelled = intervals.label_by_overlap(intervals.hop_starts(recordings(ev), "n", WINDOW, STRIDE), episodes(ev), ["user_id"], WINDOW, STRIDE)
    return _rounded(splits.subject_rates(labelled, "user_id", "label"), "rate")


_RANKED = f"WITH r AS (SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('42-' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY y) AS n, count(*) OVER () AS total FROM {_LABELS})"


def _toxic(spark, sf_dir):
    return utc(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"))


@query(_RANKED + " SELECT doc_id, y FROM r WHERE r <= CASE WHEN total <= 200 THEN n ELSE round_even(200.0::DOUBLE * n / total, 0)::BIGINT END")
def q80_proportional_sample(spark, sf_dir):
    """A sample of 200 rows, each class by its share."""
    return splits.proportional_sample(_toxic(spark, sf_dir), "y", "doc_id", 100, SEED).select("doc_id", "y")


@query(_RANKED + " SELECT doc_id, y, unnest(generate_series(0, (120 - r) // n)) AS copy FROM r WHERE r <= 120")
def q81_balance_to_target(spark, sf_dir):
    """120 rows of each class, with repeats where a class has fewer."""
    return splits.balance_to(_toxic(spark, sf_dir), "y", "doc_id", 120, SEED).select("doc_id", "y", "copy")


@query(_RANKED + " SELECT doc_id, y FROM r WHERE r <= 120")
def q82_balance_without_repeats(spark, sf_dir):
    return splits.balance_to(_toxic(spark, sf_dir), "y", "doc_id", 120, SEED, replace=False).select("doc_id", "y")


@query("""WITH h AS (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type FROM events)
SELECT user_id, day, event_type FROM (SELECT DISTINCT user_id, day FROM h), (SELECT DISTINCT event_type FROM h) EXCEPT SELECT user_id, day, event_type FROM h""")
def q83_missing_kinds(spark, sf_dir):
    """The event types, in place of channels, that a user lacks on a day."""
    held = utc(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").distinct()
    return coverage.missing_channels(held, ["user_id", "day"], "event_type")
