"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktide.llm import decontaminate, language, pieces, simhash, suffix_dedup
from sparktide.llm.common import forget, table, write_once
from sparktide.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (null, empty, or no letter) go; the rest get the language found where theirs is null.

    Learned from the rows outside fold 0, null ids aside; repeated rows and very long texts stay whole; an empty table gives no rows; columns beyond those of documents go, in every stage.
    """
    model = language.train(docs.where(language.fold() != 0))
    found = language.identify(docs, model, keep=COLUMNS).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (five-word shingles, Jaccard similarity 0.8 or more) the one of the smallest id stays, once; rows without an id come last.

    Texts without words are one group; repeated rows stay once; very long texts are compared whole; an empty table gives no rows. Candidates come from op1's fingerprint links and from bands of
    least hashes, which the wider reach of 0.8 needs (see the README).
    """
    found = simhash.similar_documents(docs).where("first").select("doc_id", "th").distinct()
    own = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"))
    kept = own.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("own") == F.col("th")), "left_semi")
    return kept.dropDuplicates(["doc_id", "own"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes and passages of more than 50 words that start at two places or more are cut out; what remains of a character cut in two goes as well.

    Null texts stay null; texts that lose nothing stay as they are, n_chars included; of a text that is cut, n_chars counts what remains. Rows of equal ids and texts that near-dedup has left would lose all that
    they share; very long texts are searched whole; an empty table gives no rows.
    """
    cut = suffix_dedup.remove_repeats(docs, suffix_dedup.BYTES, suffix_dedup.PASSAGES, keep=tuple(c for c in COLUMNS if c != "text"))
    chars = F.when(F.size("spans") > 0, F.length("rest").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", chars).withColumnRenamed("rest", "text").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's shingles go; rows are told apart by id and text, so that rows without an id and of equal ids are judged by themselves.

    Null and empty texts hold nothing and stay; repeated rows go or stay together; very long texts are searched whole; an empty table of documents or of items drops nothing.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row"))
    items = decontaminate.contained_items(keyed.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    found = write_once(items.select(F.col("doc_id").alias("row")).distinct(), "contaminated")
    return keyed.join(found, "row", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the ids of each text with begin and end, and the text decoded from them; every row, as pieces.encode_decode() states for nulls and the like."""
    return pieces.encode_decode(docs, tokenizer_file("piece_bpe_32k.model")).select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode),
]

#: Expectation-maximisation, fingerprints and piece merges have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents, each written to the shared folder as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_once(docs, f"stage-{k}")
            if k:
                forget(before)
    return docs
