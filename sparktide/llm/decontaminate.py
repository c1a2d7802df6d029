"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktide.llm.common import let, write_once

SHINGLE = 5
CONTAINMENT = 0.8
#: Rows up to which the sketches of the items, or the candidate pairs, are broadcast; beyond, the joins shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Lower-case words of letters, digits and non-ASCII characters; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _window(w: Column, i: Column, size: int) -> list[Column]:
    return [F.get(w, i + k) for k in range(size)]


def _hashes(w: Column, size: int) -> Column:
    """struct<size, n, hs>: hashes of all shingles of that many words, and their number; of as many arguments as words, so that those of two sizes differ."""
    n = F.size(w) - size + 1
    hs = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*_window(w, i, size)))).otherwise(F.array().cast("array<bigint>"))
    return F.struct(F.lit(size).alias("size"), n.alias("n"), hs.alias("hs"))


def shingle_texts(text: Column, size: int) -> Column:
    return let(words(text), lambda w: F.when(
        F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.concat_ws(" ", *_window(w, i, size)))
    ).otherwise(F.array().cast("array<string>")))


def item_shingles(items: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, len, shingle, h, q, k): distinct shingles of each item; q their number, k the size of the item's sketch.

    An item of fewer words than `shingle` is one shingle of its own length; one without words gives no rows.
    """
    own = items.where("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    own = own.withColumn("len", F.least(F.size("w"), F.lit(shingle)))
    each = F.transform(F.sequence(F.lit(0), F.size("w") - F.col("len")), lambda i: F.slice("w", i + 1, F.col("len")))
    parts = own.select("item_id", "len", F.explode(each).alias("s")).select("item_id", "len", F.concat_ws(" ", "s").alias("shingle"), F.when(
        F.col("len") == shingle, F.xxhash64(*[F.get("s", F.lit(k)) for k in range(shingle)])).alias("h5"), "s").distinct()
    h = F.col("h5")
    for size in range(1, shingle):
        h = F.when(F.col("len") == size, F.xxhash64(*[F.get("s", F.lit(k)) for k in range(size)])).otherwise(h)
    return parts.select("item_id", "len", "shingle", h.alias("h"))


def sketches(shingles: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, len, h, least): the smallest hashes of each item, as many as its size partition needs, and the fewest shingles of a text that its partition is probed for.

    Items are partitioned by size, each partition reaching from a power of 2**(1/4) to the next. With the upper
    bound u of a partition, a text that holds the wanted share of an item of q <= u shingles misses at most
    u - ceil(share * u) of them, so it holds one of that many and one more smallest hashes. With its lower bound l, such a text
    has ceil(share * l) shingles or more: shorter ones aren't probed for the partition. The search loses nothing by either.
    """
    sizes = shingles.groupBy("item_id").agg(F.count("*").alias("q"))
    step = F.ceil(F.log2(F.col("q").cast("double")) * 4 - 1e-9)
    ranked = sizes.withColumn("upper", F.greatest(F.floor(F.pow(F.lit(2.0), step / 4) + 1e-9), "q")).withColumn("lower", F.least(F.floor(F.pow(F.lit(2.0), (step - 1) / 4) + 1e-9) + 1, F.col("q")))
    ranked = ranked.withColumn("k", F.least(F.col("upper") - F.ceil(F.col("upper") * containment - 1e-9) + 1, F.col("q"))).withColumn("least", F.ceil(F.col("lower") * containment - 1e-9))
    smallest = shingles.join(ranked, "item_id").groupBy("item_id", "len", "k", "least").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    return smallest.select("item_id", "len", "least", F.explode(F.slice("hs", F.lit(1), F.col("k").cast("int"))).alias("h"))


def contained_items(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each text that holds at least that share of an item's distinct shingles.

    docs(doc_id, text, ...), items(item_id, text, ...). Null and empty texts match nothing; repeated rows of docs
    give one result row; null item ids are left out; very long texts are searched whole; an empty table on either side gives no rows; other columns are ignored. Items are expected to be small next to docs: an
    item's own shingles meet in one group. Documents are never gathered.
    """
    own = write_once(item_shingles(items, shingle), "item-shingles")
    index = write_once(sketches(own, containment), "item-sketches")
    lengths = sorted(r.len for r in own.select("len").distinct().collect())  # at most `shingle` values
    small = F.broadcast if index.count() <= broadcast_rows else (lambda df: df)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    if not lengths:
        return docs.sparkSession.createDataFrame([], f"doc_id long, item_id {items.schema['item_id'].dataType.simpleString()}, n_shared long, n_item long, containment double")
    of_size = rows.select("doc_id", "th", F.explode(let(words(F.col("text")), lambda w: F.array(*[_hashes(w, size) for size in lengths]))).alias("p"))
    hashes = of_size.select("doc_id", "th", "p.size", "p.n", F.explode("p.hs").alias("h"))
    pairs = hashes.join(small(index), "h").where("len = size AND n >= least").select("doc_id", "th", "item_id", "len").distinct()
    pairs = write_once(pairs, "candidates")
    small_pairs = F.broadcast if pairs.count() <= broadcast_rows else (lambda df: df)
    keys = pairs.select(F.col("doc_id").alias("c_doc"), F.col("th").alias("c_th"), "len").distinct()
    chosen = rows.join(small_pairs(keys), F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("th") == F.col("c_th")))
    texts = F.lit(None).cast("array<string>")
    for size in lengths:
        texts = F.when(F.col("len") == size, shingle_texts(F.col("text"), size)).otherwise(texts)
    held = chosen.select("doc_id", "th", "len", F.explode(F.array_distinct(texts)).alias("shingle")).distinct()
    wanted = pairs.join(own.select("item_id", "len", "shingle"), ["item_id", "len"])
    shared = held.alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.th") == F.col("w.th")) & (F.col("d.len") == F.col("w.len")) & (F.col("d.shingle") == F.col("w.shingle")))
    counts = shared.groupBy("d.doc_id", "d.th", "w.item_id").agg(F.count("*").alias("n_shared"))
    sizes = own.groupBy("item_id").agg(F.count("*").alias("n_item"))
    out = counts.join(sizes, "item_id").withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= containment - 1e-12)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"), F.max("containment").alias("containment"))
