"""Splits, samples and folds. Draws are orders by md5(seed, id): the same wherever and however often they run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def subject_rates(windows: DataFrame, subject: str, label: str) -> DataFrame:
    return windows.groupBy(subject).agg(F.count("*").alias("n_windows"), F.sum(F.col(label).cast("long")).alias("n_positive"), F.avg(F.col(label).cast("double")).alias("rate"))


def stratified_subject_split(rates: DataFrame, subject: str, test_size: float) -> DataFrame:
    """Adds split: subjects sorted by (rate, subject), evenly spaced ones in test.

    The picks are floor(i * (n / n_test)) for i < n_test, n_test the larger of 1 and the whole part of n * test_size.
    rates has one row for each subject, so the one order runs over subjects, not windows.
    """
    ranked = rates.withColumn("__pos", F.row_number().over(Window.orderBy("rate", subject)) - 1)
    size = rates.agg(F.count("*").alias("n")).where("n > 0").withColumn("__k", F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(float(test_size))).cast("int")))
    picks = size.select(F.explode(F.sequence(F.lit(0), F.col("__k") - 1)).alias("i"), (F.col("n").cast("double") / F.col("__k")).alias("step")).select(F.floor(F.col("i") * F.col("step")).cast("int").alias("__pos")).distinct().withColumn("__test", F.lit(True))
    return ranked.join(picks, "__pos", "left").withColumn("split", F.when(F.col("__test"), "test").otherwise("train")).drop("__pos", "__test")


def group_shuffle_split(subjects: DataFrame, subject: str, test_size: float, seed: int, strata: list[str] | None = None) -> DataFrame:
    """Adds split: the first ceil(n * test_size) subjects of a random order in test, within each stratum if given."""
    strata = strata or []
    order = Window.partitionBy(*strata).orderBy(draw(seed, subject), subject)
    n = F.count("*").over(Window.partitionBy(*strata))
    test = F.row_number().over(order) <= F.ceil(n * F.lit(float(test_size)) - 1e-9)
    return subjects.withColumn("split", F.when(test, "test").otherwise("train"))


def leakage(split: DataFrame, subject: str) -> DataFrame:
    """Subjects that stand in train and in test."""
    return split.where("split = 'train'").select(subject).intersect(split.where("split = 'test'").select(subject))


def swap_for_positives(split: DataFrame, subject: str) -> DataFrame:
    """If test holds no positive subject (n_positive > 0), the smallest positive one of train and the smallest negative one of test change places."""
    facts = split.agg(
        F.count_if((F.col("split") == "test") & (F.col("n_positive") > 0)).alias("has"),
        F.min(F.when((F.col("split") == "train") & (F.col("n_positive") > 0), F.col(subject))).alias("__in"),
        F.min(F.when((F.col("split") == "test") & (F.col("n_positive") == 0), F.col(subject))).alias("__out"),
    )
    swap = (F.col("has") == 0) & F.col("__in").isNotNull()
    new = F.when(swap & (F.col(subject) == F.col("__in")), "test").when(swap & (F.col(subject) == F.col("__out")), "train").otherwise(F.col("split"))
    return split.crossJoin(F.broadcast(facts)).withColumn("split", new).drop("has", "__in", "__out")


def random_rank(rows: DataFrame, by: list[str], key: str, seed: int) -> DataFrame:
    """Adds rank: the place (from 1) of each row in the random order of its group.

    The draws are cut into 4,096 slices by their first digits; the slices' sizes are summed up and rows are numbered
    within their slice, so no group is ordered in one task.
    """
    cut = rows.withColumn("__draw", draw(seed, key)).withColumn("__slice", F.substring("__draw", 1, 3))
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.groupBy(*by, "__slice").agg(F.count("*").alias("__n")).select(*by, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = cut.withColumn("__row", F.row_number().over(Window.partitionBy(*by, "__slice").orderBy("__draw", key)))
    return own.join(bases, [*by, "__slice"]).withColumn("rank", F.col("__base") + F.col("__row")).drop("__draw", "__slice", "__row", "__base")


def cap_classes(rows: DataFrame, label: str, key: str, caps: DataFrame, seed: int) -> DataFrame:
    """The first `cap` rows of each class in a random order, by caps(label, cap); classes without a row there stay whole."""
    ranked = random_rank(rows, [label], key, seed).join(F.broadcast(caps.select(label, "cap")), label, "left")
    return ranked.where("cap IS NULL OR rank <= cap").drop("rank", "cap")


def undersample(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """As many random rows of each class as the smallest class has."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("__n"))
    return cap_classes(rows, label, key, sizes.crossJoin(F.broadcast(sizes.agg(F.min("__n").alias("cap")))), seed)


def oversample(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Adds copy: rows of smaller classes repeat, in turn by a random order, until each class has as many as the largest."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("__n"))
    most = sizes.agg(F.max("__n").alias("__m"))
    joined = random_rank(rows, [label], key, seed).join(F.broadcast(sizes), label).crossJoin(F.broadcast(most))
    times = F.floor((F.col("__m") - F.col("rank")) / F.col("__n"))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), times))).drop("rank", "__n", "__m")


def balance_to(rows: DataFrame, label: str, key: str, target: int, seed: int, replace: bool = True) -> DataFrame:
    """Adds copy: `target` rows of each class, in a random order; smaller classes repeat in turn if replace, else stay as they are."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("__n"))
    joined = random_rank(rows, [label], key, seed).join(F.broadcast(sizes), label).where(F.col("rank") <= target)
    times = F.floor((F.lit(target) - F.col("rank")) / F.col("__n")) if replace else F.lit(0).cast("long")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), times))).drop("rank", "__n")


def proportional_sample(rows: DataFrame, label: str, key: str, size: int, seed: int) -> DataFrame:
    """2 * size random rows, each class by its share (see quotas()); all rows if there aren't more."""
    return cap_classes(rows, label, key, quotas(rows, label, [size]).select(label, F.col("quota").alias("cap")), seed)


def quotas(rows: DataFrame, label: str, sizes: list[int]) -> DataFrame:
    """(size, label, n, quota): the rows of each class in a proportional sample of 2 * size rows, all if there aren't more."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    grid = F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size")
    share = F.when(F.col("total") <= 2 * F.col("size"), F.col("n")).otherwise(F.bround(2.0 * F.col("size") * F.col("n") / F.col("total"), 0).cast("long"))
    return counts.crossJoin(F.broadcast(total)).select("*", grid).select("size", label, "n", share.alias("quota"))


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, weight, squared): n_all / (classes * n), and its square for models that apply it twice."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__all"), F.count("*").alias("__k"))
    w = F.col("__all").cast("double") / (F.col("__k") * F.col("n"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", w.alias("weight"), (w * w).alias("squared"))


def subject_folds(subjects: DataFrame, subject: str, label: str, folds: int, seed: int) -> DataFrame:
    """Adds fold: subjects of each majority label dealt in turn by a random order."""
    order = Window.partitionBy(label).orderBy(draw(seed, subject), subject)
    return subjects.withColumn("fold", (F.row_number().over(order) - 1) % folds)


def greedy_group_folds(counts: list[tuple[object, int]], folds: int) -> dict[object, int]:
    """The largest group goes to the lightest fold, and so on; sequential by nature, over one entry for each subject."""
    load, out = [0] * folds, {}
    for group, n in sorted(counts, key=lambda x: (-x[1], x[0])):
        k = load.index(min(load))
        out[group], load[k] = k, load[k] + n
    return out
