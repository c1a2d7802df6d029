"""Quality rules: a learned decision list over text statistics, in DataFrame functions only."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktide.llm.common import let, write_once

_SPACE = r"[\x20\x09-\x0D]"
#: The statistics that rules look at; all but the first are shares.
FEATURES = ("n_words", "mean_word", "symbols", "dup_lines", "repeats", "distinct", "upper")
#: Cut points of each statistic: these quantiles over all labelled rows of either class.
QUANTILES = (0.0, 0.005, 0.02, *(k / 20 for k in range(1, 20)), 0.98, 0.995, 1.0)
#: Digits to which statistics are rounded for the quantiles, which are exact; so they need memory for the different rounded values alone.
DIGITS = 4
MAX_RULES, MAX_LITERALS = 12, 4
#: Least share of bad rows among those a rule meets, and least number of bad rows.
PRECISION, SUPPORT = 0.8, 5


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows found twice or more. Windows are sorted by hash and place; neighbours of equal hash are compared word by word."""
    n = F.size(w) - 2

    def repeated(mask: Column, keys: Column) -> Column:
        def same(k: Column, j: Column) -> Column:
            a, b = F.get(keys, k), F.get(keys, j)
            p, q = a.bitwiseAND(mask).cast("int"), b.bitwiseAND(mask).cast("int")
            equal = F.lit(True)
            for d in range(3):
                equal = equal & (F.get(w, p + d) == F.get(w, q + d))
            return F.coalesce(a.bitwiseXOR(b).between(0, mask) & equal, F.lit(False))

        hits = F.filter(F.sequence(F.lit(0), n - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        places = F.sort_array(F.transform(hits, lambda k: F.get(keys, k).bitwiseAND(mask)))
        return let(places, lambda at: F.aggregate(
            F.transform(at, lambda p, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, j + 1) - p, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda total, x: total + x
        ))

    def of(hashes: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(hashes)))) - 1
        keys = let(mask, lambda m: let(F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("long")))), lambda k: repeated(m, k)))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), keys).otherwise(F.lit(0).cast("long"))

    windows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n >= 2, let(windows, of)).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, FEATURES) of each row of docs(doc_id, text, ...), repeated rows included.

    Words are maximal runs without ASCII white space; a null text has none. word_chars: code points in words; n_symbols: characters of #*$%&|<>; n_lines: lines
    with a word; n_dup_lines: those equal to an earlier one; n_repeat_words: words in 3-word windows found twice or more; n_distinct: different words;
    n_upper: upper-case letters. Shares of an empty text are 0. Very long texts are counted whole; equal lines and windows count as often as they stand; an empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def without(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, "")).cast("long")

    size = F.length(text).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(F.array_remove(F.split(text, _SPACE + "+"), ""), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), _repeat_words(w).alias("n_repeat_words")
    ))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), counts.alias("w"), of_lines.alias("l"),
        without(_SPACE + "+").alias("word_chars"), (size - without(r"[#*$%&|<>]")).alias("n_symbols"), (size - without(r"\p{Lu}")).alias("n_upper"),
    ).select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "n_upper")

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))

    return rows.select(
        "*", share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "word_chars").alias("symbols"), share("n_dup_lines", "n_lines").alias("dup_lines"),
        share("n_repeat_words", "n_words").alias("repeats"), share("n_distinct", "n_words").alias("distinct"), share("n_upper", "word_chars").alias("upper"),
    )


Literal = tuple[str, str, float]
RuleList = list[list[Literal]]


def condition(rule: list[Literal]) -> Column:
    out = F.lit(True)
    for name, side, cut in rule:
        out = out & (F.col(name) >= cut if side == ">=" else F.col(name) < cut)
    return out


def decision(rules: RuleList) -> Column:
    """False for rows that a rule meets, the first that does deciding; else true."""
    if not rules:
        return F.lit(True)
    out = F.when(condition(rules[0]), False)
    for rule in rules[1:]:
        out = out.when(condition(rule), False)
    return out.otherwise(True)


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, int], tuple[float, float]]:
    """Bad and good rows in each interval between cut points; one small aggregate reaches the driver."""
    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), _bin(name, at).alias("bin")) for name, at in cuts.items()]))
    got = rows.select("bad", cells.alias("c")).select("bad", "c.*").groupBy("name", "bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
    return {(r["name"], r["bin"]): (float(r.p), float(r.n)) for r in got}


def _bin(name: str, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(name)))


def _best_literal(counts: dict, cuts: dict[str, list[float]]) -> tuple[float, Literal | None, float, float]:
    """The threshold of greatest information gain over bad rows, by running sums over the intervals; the middle of those that part the rows alike."""
    best: tuple[float, Literal | None, float, float] = (0.0, None, 0.0, 0.0)
    top = 0.0
    for name, at in cuts.items():
        p_all = sum(counts.get((name, b), (0, 0))[0] for b in range(len(at) + 1))
        n_all = sum(counts.get((name, b), (0, 0))[1] for b in range(len(at) + 1))
        if not p_all:
            continue
        before = log2(p_all / (p_all + n_all))
        p = n = 0.0
        for k, cut in enumerate(at):
            p += counts.get((name, k), (0, 0))[0]
            n += counts.get((name, k), (0, 0))[1]
            for side, a, b in (("<", p, n), (">=", p_all - p, n_all - n)):
                if a >= SUPPORT and (gain := a * (log2(a / (a + b)) - before)) > best[0] + 1e-9:
                    best, top = (gain, (name, side, cut), a, b), cut
                elif best[1] and (name, side, a, b) == (*best[1][:2], *best[2:]):
                    top = cut
    gain, literal, a, b = best
    return (gain, (*literal[:2], (literal[2] + top) / 2), a, b) if literal else best


def learn(labelled: DataFrame) -> RuleList:
    """Sequential covering on labelled(doc_id, FEATURES, bad): conjunctions of thresholds that meet bad rows, in order.

    Two thirds of the rows grow a rule by the literal of greatest gain until it meets no good row; the other third prunes its last literals
    for the best (bad - good) / (bad + good). A rule that isn't precise or supported enough ends the list; covered rows leave before the next.
    Every step is one aggregate over all labelled rows; nothing but counts reaches the driver. No rows, or one class, give no rules.
    """
    prune = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    rows = write_once(labelled.select(prune.alias("prune"), "bad", *FEATURES), "labelled")
    quantiles = F.array(*map(F.lit, QUANTILES))
    points = rows.groupBy("bad").agg(*[F.percentile(F.round(c, DIGITS), quantiles).alias(c) for c in FEATURES]).collect()
    half = 0.5 * 10.0**-DIGITS  # to either side of a rounded value lies what was rounded to it
    cuts = {c: sorted({round(x + side, DIGITS + 2) for p in points for x in p[c] for side in (-half, half)}) for c in FEATURES if points}
    rules: RuleList = []
    while cuts and len(rules) < MAX_RULES:
        left = rows.where(decision(rules))
        rule: list[Literal] = []
        while len(rule) < MAX_LITERALS:
            _, literal, _, good = _best_literal(_counts(left.where(~F.col("prune") & condition(rule)), cuts), cuts)
            if literal is None:
                break
            rule.append(literal)
            if not good:
                break
        if not rule:
            break
        prefixes = [rule[: k + 1] for k in range(len(rule))]
        met = left.agg(*[F.count_if(condition(r) & F.col("prune") & (F.col("bad") == bad)).alias(f"{'p' if bad else 'n'}{k}") for k, r in enumerate(prefixes) for bad in (True, False)],
                       *[F.count_if(condition(r) & (F.col("bad") == bad)).alias(f"{'P' if bad else 'N'}{k}") for k, r in enumerate(prefixes) for bad in (True, False)]).first()
        worth = [(met[f"p{k}"] - met[f"n{k}"]) / max(1, met[f"p{k}"] + met[f"n{k}"]) for k in range(len(rule))]
        k = max(range(len(rule)), key=lambda k: (worth[k], -k))
        if met[f"P{k}"] < SUPPORT or met[f"P{k}"] < PRECISION * (met[f"P{k}"] + met[f"N{k}"]):
            break
        rules.append(prefixes[k])
    return rules


def judge(docs: DataFrame, labels: DataFrame, learned: RuleList | None = None) -> DataFrame:
    """statistics() of docs and base_failed, kept for each row; rules learned from labels(doc_id, quality, ...) unless given.

    base_failed: fewer than 50 words, or over half of the words repeat; kept: not base_failed and no rule meets the row. Labels of
    null id or quality are left out; repeated labels count as often as they stand. Null and empty texts fail the base rules; very long texts are judged whole; a value at a rule's threshold meets it as the
    condition says; of rules of equal worth the first learned decides. An empty table gives no rows, empty labels no rules. Other columns are ignored.
    """
    stats = write_once(statistics(docs), "statistics")
    if learned is None:
        marks = labels.where("quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).alias("bad"))
        learned = learn(stats.join(marks, "doc_id"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & decision(learned))
