"""Token counts by two look-ups on the map side, without a shuffle of pre-tokens."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktide.llm.pieces import CACHE_CHARS, slices, split_words

#: Pre-tokens whose lengths are broadcast, and those that each task proposes for it; both only save work.
TABLE_SIZE = 65_536
PROPOSALS = 8_192
#: Pre-tokens that a worker counts or remembers at a time.
WORKER_WORDS = 400_000


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def lengths(path: str, words: list[str]) -> list[int]:
    """Tokens of each pre-token; the library puts a space mark before a text, which stands for its first space."""
    rest = [w[1:] for w in words]
    return [len(ids) or 1 for ids in _processor(path).encode(rest, num_threads=1)] if rest else []


def frequent_words(docs: DataFrame, proposals: int = PROPOSALS, size: int = TABLE_SIZE) -> list[str]:
    """At most `size` frequent pre-tokens of up to CACHE_CHARS characters of all texts: each task counts its own, dropping rare ones when it has many, and proposes the leading ones."""

    def propose(batches):
        counts: Counter = Counter()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                for text in texts[a:b]:
                    if text:
                        counts.update(w for w in split_words(text) if len(w) <= CACHE_CHARS)
                if len(counts) > WORKER_WORDS:
                    floor = sorted(counts.values(), reverse=True)[WORKER_WORDS // 2]
                    counts = Counter({w: n for w, n in counts.items() if n > floor})
        top = counts.most_common(proposals)
        yield pa.record_batch([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    top = docs.select(F.col("text").cast("string")).mapInArrow(propose, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in top.orderBy(F.desc("n"), "word").limit(size).collect()]


def token_counts(docs: DataFrame, model_path: str, size: int = TABLE_SIZE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row of docs(doc_id, text, ...), repeated rows included.

    A null or empty text has 0 bytes and 0 tokens; very long texts are counted whole. An empty table gives no rows; other columns are ignored. The model
    must be one that pieces.PieceModel accepts, whose tokens never reach across the place before a run of spaces. The broadcast table holds at most
    `size` pre-tokens of CACHE_CHARS characters; of equally frequent ones the first in order. It only saves work.
    """
    words = frequent_words(docs, size=size)
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(words, lengths(model_path, words), strict=True)))

    def count(batches):
        known = dict(table.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                part = [t or "" for t in texts[a:b]]
                split = [split_words(t) for t in part]
                missing = list(set().union(*split).difference(known))
                if len(known) + len(missing) > len(table.value) + WORKER_WORDS:
                    known = dict(table.value)
                    missing = list(set().union(*split).difference(known))
                known.update(zip(missing, lengths(model_path, missing), strict=True))
                of = known.__getitem__
                sums = [sum(map(of, ws)) for ws in split]
                for w in missing:
                    if len(w) > CACHE_CHARS:
                        del known[w]
                sizes = [len(t.encode("utf-8", "surrogatepass")) for t in part]
                yield pa.record_batch([batch.column(0)[a:b], pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
