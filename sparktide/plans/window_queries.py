"""Queries over windows of signals: bases, autoregression, models and baselines."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sparktide.functions import channels
from sparktide.operators import baselines, classifiers, kernels, metrics, mvar, splits, validation
from sparktide.plans.mapping import features, windows, with_
from sparktide.plans.registry import query

_LONG = with_("emb") + ", s AS (SELECT vec_id, (p - 1) // {0} AS ch, (p - 1) % {0} AS t, v[p] AS x FROM (SELECT vec_id, v, unnest(generate_series(1, 64)) AS p FROM emb))"
_Z = ", z AS (SELECT vec_id, ch, t, (x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w = 0 THEN 1 ELSE stddev_pop(x) OVER w END AS z FROM s WINDOW w AS (PARTITION BY vec_id, ch))"


def _samples(spark, sf_dir, n_samples):
    return mvar.long_form(windows(spark, sf_dir), "vec_id", "v", n_samples)


def _r(c, name=None, digits=6):
    return (F.round(c, digits) + 0.0).alias(name or c)


@query(_LONG.format(16) + " SELECT vec_id, ch::INTEGER AS ch, k::INTEGER AS k, round(sum(x * power(2.0::DOUBLE * t / 15 - 1, k)), 6) + 0.0 AS projection FROM s, (SELECT unnest(generate_series(0, 3)) AS k) GROUP BY 1, 2, 3")
def q21_poly_basis(spark, sf_dir):
    """Each channel's products with the powers of normalised time."""
    rows = _samples(spark, sf_dir, 16).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return rows.groupBy("vec_id", "ch", "k").agg(_r(F.sum(F.col("x") * mvar.polynomial(F.col("t"), 16, F.col("k"))), "projection"))


@query(_LONG.format(16) + """, u AS (SELECT vec_id, ch, x, t / 15.0::DOUBLE AS u FROM s) SELECT vec_id, ch::INTEGER AS ch, round(sum(x * (1 - u) * (1 - u) * (1 - u)), 6) + 0.0 AS b0, round(sum(x * 3 * u * (1 - u) * (1 - u)), 6) + 0.0 AS b1,
round(sum(x * 3 * u * u * (1 - u)), 6) + 0.0 AS b2, round(sum(x * u * u * u), 6) + 0.0 AS b3 FROM u GROUP BY 1, 2""")
def q22_bspline_basis_k4(spark, sf_dir):
    """Each channel's products with the four clamped cubic B-splines."""
    basis = mvar.bernstein(F.col("t"), 16)
    return _samples(spark, sf_dir, 16).groupBy("vec_id", "ch").agg(*[_r(F.sum(F.col("x") * b), f"b{k}") for k, b in enumerate(basis)])


@query(_LONG.format(16) + _Z + " SELECT vec_id, ch::INTEGER AS ch, t::INTEGER AS t, round(z, 6) + 0.0 AS z FROM z")
def q23_zscore_window(spark, sf_dir):
    return mvar.standardised(_samples(spark, sf_dir, 16), "vec_id").select("vec_id", "ch", "t", _r("z"))


@query(_LONG.format(16) + _Z + """, l AS (SELECT vec_id, ch, t, j, CASE j WHEN 1 THEN lag(z, 1) OVER w ELSE lag(z, 2) OVER w END AS v FROM z, (VALUES (1), (2)) n(j) WINDOW w AS (PARTITION BY vec_id, ch, j ORDER BY t))
SELECT vec_id, t::INTEGER AS t, (((j - 1) * 4 + ch) * 2 + k)::INTEGER AS col, round(v * power(2.0::DOUBLE * t / 15 - 1, k), 6) + 0.0 AS value FROM l, (VALUES (0), (1)) b(k) WHERE t >= 2""")
def q24_design_matrix(spark, sf_dir):
    z = mvar.standardised(_samples(spark, sf_dir, 16), "vec_id")
    return mvar.design_rows(z, "vec_id", 16, 2, 2).select("vec_id", "t", F.col("col").cast("int").alias("col"), _r("value"))


_CLOSED = _LONG.format(64) + _Z + """, l AS (SELECT vec_id, z, lag(z) OVER (PARTITION BY vec_id ORDER BY t) AS u, 2.0::DOUBLE * t / 63 - 1 AS h FROM z),
g AS (SELECT vec_id, sum(u * u) + 0.1::DOUBLE AS a, sum(u * u * h) AS b, sum(u * h * u * h) + 0.1::DOUBLE AS d, sum(u * z) AS e, sum(u * h * z) AS f FROM l WHERE u IS NOT NULL GROUP BY 1), mv AS (SELECT vec_id, (d * e - b * f) / (a * d - b * b) AS c0, (a * f - b * e) / (a * d - b * b) AS c1 FROM g)"""


def _closed(spark, sf_dir):
    return mvar.closed_form_variation(mvar.standardised(_samples(spark, sf_dir, 64), "vec_id"), "vec_id", 64, 0.1)


@query(_CLOSED + " SELECT vec_id, round(c0, 6) + 0.0 AS c0, round(c1, 6) + 0.0 AS c1, round(2 * abs(c1), 6) AS variation FROM mv")
def q25_mvar_closed_form(spark, sf_dir):
    return _closed(spark, sf_dir).select("vec_id", _r("c0"), _r("c1"), F.round("variation", 6).alias("variation"))


_PATH = with_("emb") + """, c AS (SELECT vec_id, (p - 1) // 16 % 4 AS lag, (p - 1) // 8 % 2 AS i, (p - 1) // 4 % 2 AS j, (p - 1) % 4 AS k, v[p] AS c FROM (SELECT vec_id, v, unnest(generate_series(1, 64)) AS p FROM emb)),
a AS (SELECT vec_id, lag, i, j, m, sum(c * power(2.0::DOUBLE * m / 4 - 1, k)) AS a FROM c, (SELECT unnest(generate_series(0, 4)) AS m) GROUP BY ALL), n AS (SELECT x.vec_id, x.lag, x.m, y.m AS m2, sqrt(sum((x.a - y.a) * (x.a - y.a))) AS norm FROM a x JOIN a y ON x.vec_id = y.vec_id AND x.lag = y.lag AND x.i = y.i AND x.j = y.j AND x.m < y.m GROUP BY ALL),
pv AS (SELECT vec_id, lag, max(norm) AS variation FROM n GROUP BY ALL)"""


def _path(spark, sf_dir):
    """The 64 values of a window taken as coefficients: 4 lags of 2 x 2 matrices with 4 basis functions."""
    at = windows(spark, sf_dir).select("vec_id", F.posexplode("v").alias("p", "c"))
    at = at.select("vec_id", *[F.floor(F.col("p") / d % m).cast("int").alias(n) for n, d, m in (("lag", 16, 4), ("i", 8, 2), ("j", 4, 2), ("k", 1, 4))], "c")
    return mvar.path_variation(at, ["vec_id"], 5)


@query(_PATH + " SELECT vec_id, lag::INTEGER AS lag, round(variation, 6) AS variation FROM pv")
def q26_pairwise_variation(spark, sf_dir):
    return _path(spark, sf_dir).select("vec_id", "lag", F.round("variation", 6).alias("variation"))


@query(_PATH + " SELECT vec_id, round(max(variation) FILTER (lag >= 2), 6) AS s, round(avg(variation), 6) AS mean_d, round(stddev_pop(variation), 6) AS std_d FROM pv GROUP BY 1")
def q74_two_level_sup(spark, sf_dir):
    return _path(spark, sf_dir).groupBy("vec_id").agg(F.round(F.max(F.when(F.col("lag") >= 2, F.col("variation"))), 6).alias("s"), F.round(F.avg("variation"), 6).alias("mean_d"), F.round(F.stddev_pop("variation"), 6).alias("std_d"))


_CONFIG = mvar.MvarConfig(order=2, n_basis=4)


def _signals(spark, sf_dir):
    return windows(spark, sf_dir).select("vec_id", "subject", "y", channels.as_matrix(F.col("v"), 4, 16).alias("signal"))


@query()
def q27_mvar_scalar_feature(spark, sf_dir):
    return mvar.extract(_signals(spark, sf_dir), "signal", _CONFIG).select("vec_id", "y", "S")


@query()
def q28_mvar_vector_feature(spark, sf_dir):
    return mvar.extract(_signals(spark, sf_dir), "signal", _CONFIG, vector=True, per_lag=True).drop("signal")


@query()
def q56_logistic_pipeline(spark, sf_dir):
    """Weighted logistic regression on scaled autoregression features, trained on one split and applied to the other."""
    from sparktide.operators.splits import balanced_weights, stratified_subject_split, subject_rates

    names = mvar.feature_names(_CONFIG)
    rows = mvar.extract(_signals(spark, sf_dir), "signal", _CONFIG, vector=True).select("vec_id", "subject", "y", *names)
    split = stratified_subject_split(subject_rates(rows, "subject", "y"), "subject", 0.4).select("subject", "split")
    rows = rows.join(split, "subject").cache()
    rows = classifiers.scaled(rows, names, rows.where("split = 'train'"))
    train = rows.where("split = 'train'")
    train = train.join(F.broadcast(balanced_weights(train, "y").select("y", "weight")), "y").cache()
    model = classifiers.logistic(train, names, "y", "weight")
    return classifiers.positive_probability(model.transform(rows.where("split = 'test'"))).select("vec_id", "subject", "y", "proba")


@query(with_("emb") + " SELECT vec_id, t::INTEGER AS t, round((v[t + 1] + v[t + 17] + v[t + 33] + v[t + 49]) / 4, 6) + 0.0 AS x FROM emb, (SELECT unnest(generate_series(0, 15)) AS t)")
def q57_channel_mean(spark, sf_dir):
    rows = windows(spark, sf_dir).select("vec_id", F.posexplode(baselines.channel_mean(F.col("v"), 4, 16)).alias("t", "x"))
    return rows.select("vec_id", "t", _r("x"))


@query(with_("emb") + """, p AS (SELECT vec_id, a, i, v[a + i + 1] AS x FROM emb, (VALUES (0), (16), (32), (48)) s(a), (SELECT unnest(generate_series(0, 15)) AS i))
SELECT vec_id, a AS first, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) AS std, round(regr_slope(x, i), 6) + 0.0 AS slope FROM p GROUP BY 1, 2""")
def q58_interval_summary(spark, sf_dir):
    parts = []
    for first in (0, 16, 32, 48):
        mean, std, slope = baselines.interval_statistics(F.col("v"), first, 16)
        parts.append(F.struct(F.lit(first).alias("first"), _r(mean, "mean"), F.round(std, 6).alias("std"), _r(slope, "slope")))
    return windows(spark, sf_dir).select("vec_id", F.explode(F.array(*parts)).alias("part")).select("vec_id", "part.*")


@query()
def q70_nested_cv(spark, sf_dir):
    names = mvar.feature_names(_CONFIG)
    rows = mvar.extract(_signals(spark, sf_dir), "signal", _CONFIG, vector=True).select(F.col("vec_id").alias("window_id"), "subject", "y", *names).cache()
    return validation.nested_cv(rows, names, [0.1, 1.0])


_KERNEL = [2.0, -1.0, -1.0, 2.0, -1.0, -1.0, 2.0, -1.0, -1.0]


@query(with_("emb") + """, c AS (SELECT vec_id, i, 2 * v[i] - v[i + 1] - v[i + 2] + 2 * v[i + 3] - v[i + 4] - v[i + 5] + 2 * v[i + 6] - v[i + 7] - v[i + 8] AS x FROM emb, (SELECT unnest(generate_series(1, 56)) AS i))
SELECT vec_id, round(count(*) FILTER (x > 0) / 56.0::DOUBLE, 6) AS ppv FROM c GROUP BY 1""")
def q71_random_kernel_ppv(spark, sf_dir):
    return windows(spark, sf_dir).select("vec_id", F.round(baselines.kernel_ppv(F.col("v"), _KERNEL), 6).alias("ppv"))


_SHAPELET = [0.1, -0.1, 0.2, 0.0, -0.2]


@query(with_("emb") + """, d AS (SELECT vec_id, power(v[i] - 0.1::DOUBLE, 2) + power(v[i + 1] + 0.1::DOUBLE, 2) + power(v[i + 2] - 0.2::DOUBLE, 2) + power(v[i + 3], 2) + power(v[i + 4] + 0.2::DOUBLE, 2) AS d FROM emb, (SELECT unnest(generate_series(1, 60)) AS i))
SELECT vec_id, round(min(d), 6) AS distance FROM d GROUP BY 1""")
def q72_shapelet_min_distance(spark, sf_dir):
    return windows(spark, sf_dir).select("vec_id", F.round(baselines.shapelet_distance(F.col("v"), _SHAPELET), 6).alias("distance"))


@query()
def q73_neural_standin(spark, sf_dir):
    """A perceptron trained on one part of the subjects and applied to the other."""
    rows = _held_out(windows(spark, sf_dir))
    model, _ = baselines.network(rows.where("split = 'train'"), "v", "y", 64)
    return model.transform(baselines.as_vector(rows.where("split = 'test'"), "v")).select("vec_id", "y", vector_to_array("probability")[1].alias("proba"))


@query(with_("emb") + " SELECT vec_id, t::INTEGER AS t, c::INTEGER AS c, v[c * 16 + t + 1] AS x FROM emb, (SELECT unnest(generate_series(0, 15)) AS t), (VALUES (0), (1), (2), (3)) k(c)")
def q75_orientation_transpose(spark, sf_dir):
    tall = channels.transposed(channels.as_matrix(F.col("v"), 4, 16), 16)
    rows = windows(spark, sf_dir).select("vec_id", F.posexplode(tall).alias("t", "row"))
    return rows.select("vec_id", "t", F.posexplode("row").alias("c", "x"))


@query()
def q76_random_kernel_ridge(spark, sf_dir):
    """Random kernels and a ridge classifier, its penalty by leave-one-out errors, on one part of the subjects, applied to the other."""
    rows = _held_out(windows(spark, sf_dir))
    fitted = kernels.fit_biases(rows.where("split = 'train'"), "v", "vec_id", 4, kernels.plan_kernels(4, 16, 168))
    rows = kernels.transform(rows, "v", 4, fitted).persist()
    return kernels.fit_ridge(rows.where("split = 'train'"), "y").score(rows.where("split = 'test'")).select("vec_id", "subject", "y", "pred")


@query()
def q77_subject_threshold_model(spark, sf_dir):
    """The threshold model fitted on one part of the subjects, and the metrics of the others."""
    rows = _held_out(features(spark, sf_dir))
    scored = classifiers.predict_threshold(rows.where("split = 'test'"), "f", classifiers.fit_threshold(rows.where("split = 'train'"), "f", "y"))
    subjects = metrics.by_subject(scored, "subject", "y", "pred", "proba", "mean_proba")
    return metrics.classification(metrics.confusion(subjects, "y", "pred"))


def _held_out(rows):
    held = splits.group_shuffle_split(rows.select("subject").distinct(), "subject", 0.3, 42)
    return rows.join(held, "subject").cache()


#: Sizes of the methods in queries.
_SIZES = baselines.Sizes(kernel_features=168, members=2, trees=20, depth=4, epochs=5, batches=2)


def _predicted(spark, sf_dir, kind, sizes=_SIZES):
    rows = _held_out(windows(spark, sf_dir))
    return baselines.predict(kind, rows.where("split = 'train'"), rows.where("split = 'test'"), "v", "y", "vec_id", 4, 16, sizes).select("vec_id", "subject", "y", "pred")


@query()
def q78_interval_forest(spark, sf_dir):
    """A forest on intervals chosen by class separation, trained on one part of the subjects and applied to the other."""
    return _predicted(spark, sf_dir, "supervised_intervals")


@query()
def q79_baseline_methods(spark, sf_dir):
    """The accuracy of each kind of baseline on held-out subjects, or the error that ended it."""

    def train(kind: str) -> float:
        return _predicted(spark, sf_dir, kind).agg(F.avg((F.col("pred") == F.col("y")).cast("int"))).first()[0]

    return baselines.run_methods(["multirocket", "tsf", "drcif", "shapelet", "perceptron", "dwt"], train, spark)


@query()
def q91_nested_grid(spark, sf_dir):
    """Nested validation over the 16 settings of the autoregression and the classifier."""
    rows = _signals(spark, sf_dir).select("vec_id", "subject", "y", "signal")
    return validation.nested_cv_grid(rows, "signal", None, mvar.MvarConfig(n_time_points=10), 3, 2)


@query()
def q92_conv_network(spark, sf_dir):
    """A convolutional network trained on one part of the subjects and applied to the other."""
    return _predicted(spark, sf_dir, "conv")


@query()
def q93_recurrent_network(spark, sf_dir):
    """A network of long short-term memory trained on one part of the subjects and applied to the other."""
    return _predicted(spark, sf_dir, "lstm")


@query()
def q94_canonical_interval_forest(spark, sf_dir):
    """A forest on random intervals of values, differences and spectra with canonical statistics, trained on one part of the subjects and applied to the other."""
    return _predicted(spark, sf_dir, "canonical_views")
