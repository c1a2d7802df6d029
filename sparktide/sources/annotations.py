"""Annotation texts of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktide.functions.clock import after_colon, clock_seconds, rate_hz, wrapped_difference

# Channel entries that aren't signals: fixed values.
NOT_SIGNALS = ("1", "O1")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of whole text files, lines numbered from 1."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("k", "text")).select("file", (F.col("k") + 1).alias("line"), "text")


def start_end_pairs(lines: DataFrame, keys: list[str], line: str, text: str) -> DataFrame:
    """(keys, line, start_s, end_s): each readable start line with the first end line among the next four, if that is readable and later."""
    low = F.lower(text)
    end = F.when(F.contains(low, F.lit("seizure end time:")), F.struct(clock_seconds(F.col(text), False).alias("s")))
    ahead = Window.partitionBy(*keys).orderBy(line).rowsBetween(1, 4)
    marked = lines.withColumn("__end", end).withColumn("__next", F.first("__end", ignorenulls=True).over(ahead))
    starts = marked.where(F.contains(F.lower(text), F.lit("seizure start time:"))).select(*keys, line, clock_seconds(F.col(text), False).alias("start_s"), F.col("__next.s").alias("end_s"))
    return starts.where("start_s IS NOT NULL AND end_s > start_s")


def blocks(lines: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """(keys, file_name, reg_end_s, start_s, end_s, sample_rate) of complete blocks, times relative to the registration's start.

    Every field carries forward from its last line to the block's end line; the default rate is 512. For texts with incomplete blocks, whose
    fields leak into the next block, see blocks_exact().
    """
    t = F.col(text)
    rate = F.contains(t, F.lit("Sampling Rate"))
    name = ~rate & F.contains(t, F.lit("File name"))

    def kind(words: str):
        return ~rate & ~name & F.contains(t, F.lit(words))

    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seconds = clock_seconds(t)
    fields = {
        "sample_rate": F.when(rate, rate_hz(t)), "file_name": F.when(name, after_colon(t)),
        "reg_start": F.when(kind("Registration start"), seconds), "reg_end": F.when(kind("Registration end"), seconds), "s": F.when(kind("Seizure start"), seconds), "e": F.when(kind("Seizure end"), seconds),
    }
    rows = lines.select("*", *[F.last(v, ignorenulls=True).over(so_far).alias(k) for k, v in fields.items()], kind("Seizure end").alias("__closes"))
    done = rows.where("__closes AND file_name IS NOT NULL AND reg_start IS NOT NULL AND reg_end IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL")
    start = F.col("reg_start")
    return done.select(*keys, "file_name", *[wrapped_difference(F.col(a), start).cast("double").alias(b) for a, b in (("reg_end", "reg_end_s"), ("s", "start_s"), ("e", "end_s"))], F.coalesce("sample_rate", F.lit(512.0)).alias("sample_rate"))


#: Lines that are combined into one transition.
RANGE = 1_024
_FIELDS = {"file_name": 1, "reg_start": 2, "reg_end": 4, "s": 8, "e": 16}
_ALL, _CLOSES_BEFORE, _CLOSES_AFTER = 31, 32, 64


def _next_mask(mask: Column, code: Column) -> Column:
    """The fields known after a line, of those known before it: a closing line empties them if none is missing, before or after it adds its own."""
    full = lambda m, flag: (code.bitwiseAND(flag) != 0) & (m == _ALL)
    held = F.when(full(mask, _CLOSES_BEFORE), 0).otherwise(mask).bitwiseOR(code.bitwiseAND(_ALL))
    return F.when(full(held, _CLOSES_AFTER), 0).otherwise(held)


def blocks_exact(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """As blocks(), with the rule that a block's fields empty only once it is complete; a block closes ahead of a file's name, behind a seizure's end, and at the end of the text.

    What counts is which of the five fields are known, one of 32 masks. A range of lines maps masks to masks; the maps of a text's ranges are composed to find the mask before each range, and within it the lines
    that close a complete block. The values there are the last ones known, which windows carry along. One shuffle by key, and no Python.
    """
    t, seconds = F.col(text), clock_seconds(F.col(text))
    words = {"Sampling Rate": "sample_rate", "File name": "file_name", "Registration start": "reg_start", "Registration end": "reg_end", "Seizure start": "s", "Seizure end": "e"}
    kind = F.coalesce(*[F.when(F.contains(t, F.lit(w)), F.lit(name)) for w, name in words.items()])
    value = {"sample_rate": rate_hz(t), "file_name": after_colon(t)}
    values = {name: F.when(F.col("__kind") == name, value.get(name, seconds)) for name in words.values()}
    along = Window.partitionBy(key).orderBy(order)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    own = sum((F.when(F.col(f"__{name}").isNotNull(), bit).otherwise(0) for name, bit in _FIELDS.items()), F.lit(0))
    closes = F.when(F.col("__kind") == "file_name", _CLOSES_BEFORE).otherwise(0) + F.when((F.col("__kind") == "e") | F.lead(F.lit(1)).over(along).isNull(), _CLOSES_AFTER).otherwise(0)
    marked = lines.select(key, order, t, kind.alias("__kind")).select("*", *[v.alias(f"__{name}") for name, v in values.items()])
    known = F.struct(*[F.last(f"__{name}", ignorenulls=True).over(upto).alias(name) for name in values])
    rows = marked.select(key, (own + closes).cast("int").alias("code"), F.row_number().over(along).alias("pos"), known.alias("known")).withColumn("before", F.lag("known").over(Window.partitionBy(key).orderBy("pos")))
    rows = rows.where("code <> 0").withColumn("range", F.floor((F.col("pos") - 1) / RANGE))
    ranges = rows.groupBy(key, "range").agg(F.array_sort(F.collect_list(F.struct("pos", "code", "known", "before"))).alias("items"))
    step = F.aggregate("items", F.sequence(F.lit(0), F.lit(_ALL)), lambda masks, x: F.transform(masks, lambda m: _next_mask(m, x["code"])))
    earlier = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    entered = ranges.withColumn("step", step).withColumn("steps", F.collect_list("step").over(earlier))
    entry = F.aggregate("steps", F.lit(0), lambda mask, f: F.get(f, mask))

    def walk(state: Column, x: Column) -> Column:
        mask, code = state["mask"], x["code"]
        ahead = (code.bitwiseAND(_CLOSES_BEFORE) != 0) & (mask == _ALL)
        behind = ~ahead & (code.bitwiseAND(_CLOSES_AFTER) != 0) & (mask.bitwiseOR(code.bitwiseAND(_ALL)) == _ALL)
        done = F.when(ahead, F.concat(state["done"], F.array(x["before"]))).when(behind, F.concat(state["done"], F.array(x["known"]))).otherwise(state["done"])
        return F.struct(_next_mask(mask, code).alias("mask"), done.alias("done"))

    none = F.slice(F.transform("items", lambda x: x["known"]), 1, 0)
    found = entered.select(key, F.explode(F.aggregate("items", F.struct(entry.alias("mask"), none.alias("done")), walk)["done"]).alias("x")).select(key, "x.*")
    times = [wrapped_difference(F.col(a), F.col("reg_start")).cast("double").alias(b) for a, b in (("reg_end", "reg_end_s"), ("s", "start_s"), ("e", "end_s"))]
    return found.select(key, "file_name", *times, F.coalesce("sample_rate", F.lit(512.0)).alias("sample_rate"))


def channel_names(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, channel): names of 'Channel k: NAME' lines, in upper or lower case as written, without EKG and NOT_SIGNALS."""
    names = F.regexp_extract_all(F.col(text), F.lit(r"Channel\s+\d+:\s+(\S+)"), 1)
    return texts.select(*keys, F.explode(names).alias("channel")).where(~F.contains("channel", F.lit("EKG")) & ~F.col("channel").isin(*NOT_SIGNALS))


def file_metadata(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, total, first_begin, first_end): number and length of a file's intervals, and the first of them, by sums alone."""
    first = F.min(F.struct("begin", "end"))
    return intervals.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("begin")).alias("total"), first["begin"].alias("first_begin"), first["end"].alias("first_end"))


def nest(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, intervals): the intervals of a file as one sorted array; a file has a handful."""
    return intervals.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("intervals"))
