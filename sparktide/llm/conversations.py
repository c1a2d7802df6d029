"""Quotation linking: messages without their quotes, in reply order, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktide.llm.common import let, partitions, write_once

#: Turns of a range within which the latest original is looked for.
WIDTH = 65_536
_MARKS = r"^(?:[ \t]{0,3}>)+"
_BLANK = r"[ \t\n\f\r]+"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_BLANK}|{_BLANK}$", "")


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), _BLANK, " "))


def parse(text: Column) -> Column:
    """struct(own, blocks): the text without quotes, and its maximal runs of lines of one quote level as (level, body).

    The level of a line is the number of > before it, each after at most three blanks.
    """

    def blocks(lines: Column) -> Column:
        def level(i: Column) -> Column:
            return F.get(lines, i)["level"]

        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))
        return let(starts, lambda at: F.transform(at, lambda s, j: F.struct(
            level(s).alias("level"),
            F.array_join(F.transform(F.slice(lines, s + 1, F.coalesce(F.get(at, j + 1), F.size(lines)) - s), lambda x: x["body"]), "\n").alias("body"),
        )))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, _MARKS + " ?", "").alias("body")
    ))
    return let(let(lines, blocks), lambda b: F.struct(
        stripped(F.array_join(F.transform(F.filter(b, lambda x: x["level"] == 0), lambda x: x["body"]), "\n")).alias("own"), b.alias("blocks")
    ))


def _roots(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root) of replies(conv_id, turn, parent): each round doubles the stretch of the chain that is known."""
    known = write_once(replies.select("conv_id", "turn", F.col("parent").alias("root")), "roots")
    while True:
        further = known.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"))
        if known.join(further, ["conv_id", "root"], "left_semi").isEmpty():
            return known
        known = write_once(known.join(further, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("above", "root").alias("root")), "roots")


def _lines(text: Column) -> Column:
    """The normalised lines of a text that hold more than white space."""
    return F.filter(F.transform(F.split(text, "\n"), normalised), lambda x: x != "")


def _passages(parsed: Column) -> Column:
    return F.filter(parsed["blocks"], lambda b: (b["level"] > 0) & (normalised(b["body"]) != ""))


def _latest_earlier(originals: DataFrame, quotes: DataFrame) -> DataFrame:
    """(conv_id, turn, level, source) of quotes(conv_id, turn, level, hash): the latest earlier turn of originals(conv_id, turn, hash) with that hash, if any.

    Turns are cut into ranges of WIDTH, so that one much-quoted line of a long conversation fills many groups; only each range's latest turn meets in one place.
    """
    both = originals.select("conv_id", "hash", "turn", F.col("turn").alias("source"), F.lit(None).cast("int").alias("level")).union(
        quotes.select("conv_id", "hash", "turn", F.lit(None).cast("long"), F.col("level"))
    ).withColumn("range", F.floor(F.col("turn") / WIDTH))
    before = Window.partitionBy("conv_id", "hash").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    tops = both.groupBy("conv_id", "hash", "range").agg(F.max("source").alias("top")).withColumn("top", F.max("top").over(before))
    earlier = Window.partitionBy("conv_id", "hash", "range").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("source", F.max("source").over(earlier)).where("level IS NOT NULL").join(tops, ["conv_id", "hash", "range"])
    return found.select("conv_id", "turn", "level", F.coalesce("source", "top").alias("source")).where("source IS NOT NULL")


def link_quotations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, parent_turn, root_turn, n_quoted) of each row of messages(conv_id, turn, role, text, ...).

    text: the message without its quoted lines; n_quoted: its quoted passages, a passage being a run of lines of one
    level with a character other than white space. parent_turn: the message it replies to. A quoted passage is joined by the hash of its normalised text
    to earlier turns of the conversation that hold it as their whole own text, a paragraph or any run of whole lines (blank ones aside), and goes to the latest of them; the least
    quoted passage that finds one decides, the latest turn among equals. root_turn: the end of the chain of parents, the own turn without a parent.
    Rows are dealt and sorted by (conv_id, root_turn, turn): threads follow each other, replies their parents, and a
    long conversation may fill many partitions. Repeated turns share their links. Null texts are empty; null ids or turns link nothing; very long texts are read whole;
    an empty table gives no rows; other columns are ignored. Runs of lines are hashed in the numbers of lines that the conversation's passages have.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("raw"))
    known = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    passages = known.where(F.contains("raw", F.lit(">"))).select("conv_id", "turn", F.explode(let(parse(F.col("raw")), _passages)).alias("q"))
    quotes = write_once(passages.select("conv_id", "turn", F.col("q.level").alias("level"), F.size(_lines(F.col("q.body"))).alias("size"), F.unhex(F.sha2(normalised(F.col("q.body")), 256)).alias("hash")).distinct(), "quotes")
    talks = quotes.groupBy("conv_id").agg(F.collect_set("size").alias("sizes"))
    own, digest = F.col("own"), lambda s: F.unhex(F.sha2(s, 256))
    whole = F.transform(F.filter(F.transform(F.concat(F.array(own), F.split(own, r"\n[ \t\f\r]*\n")), normalised), lambda s: s != ""), digest)
    # Runs are hashed as they are made: a row holds 32 bytes for each run, not its text.
    runs = let(_lines(own), lambda ls: F.flatten(F.transform(F.filter("sizes", lambda n: n <= F.size(ls)), lambda n: F.transform(
        F.sequence(F.lit(1), F.size(ls) - n + 1), lambda i: digest(F.array_join(F.slice(ls, i, n), " "))))))
    talk = known.join(talks, "conv_id").select("conv_id", "turn", parse(F.col("raw"))["own"].alias("own"), "sizes")
    originals = talk.select("conv_id", "turn", F.explode(F.array_distinct(F.concat(whole, runs))).alias("hash"))
    originals = originals.join(quotes.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").distinct()
    found = _latest_earlier(originals, quotes)
    replies = write_once(found.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("source")).alias("back")))["back"].alias("back")).select("conv_id", "turn", (-F.col("back")).alias("parent")), "replies")
    linked = replies.join(_roots(replies), ["conv_id", "turn"])
    out = rows.join(linked, ["conv_id", "turn"], "left").withColumn("root_turn", F.coalesce("root", "turn"))
    order = ["conv_id", "root_turn", "turn", F.xxhash64("raw")]
    dealt = out.repartitionByRange(partitions(messages.sparkSession), *order).sortWithinPartitions(*order)
    parsed = dealt.withColumn("p", let(parse(F.col("raw")), lambda p: F.struct(p["own"].alias("own"), F.size(_passages(p)).cast("long").alias("n"))))
    return parsed.select("conv_id", "turn", "role", F.col("p.own").alias("text"), F.col("parent").alias("parent_turn"), "root_turn", F.col("p.n").alias("n_quoted"))
