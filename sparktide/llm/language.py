"""Language identification by mixtures of n-gram models."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktide.llm.common import write_once

#: Byte trigrams are hashed to this many buckets; a model is one number for each language and bucket.
BUCKETS = 1 << 15
#: Added to each count, so that unseen trigrams keep a chance.
SMOOTHING = 0.5
ROUNDS = 12
#: Languages that a task counts at a time, and counts (of a language and a bucket) of a block of languages: the driver holds one block at a time, tasks map the files of several.
LANGUAGES_AT_A_TIME = 64
BLOCK_COUNTS = 1 << 21
#: Languages up to which their chances are also laid out in full, 8 bytes for each bucket: the same numbers, found sooner.
LAID_OUT = 32
#: Chances of one text that a task holds in all; of more it reads a block at a time, twice a round.
HELD = 1 << 22
#: Cost of each further language of a text, in units of the logarithm of its trigrams.
PENALTY = 3.0
_LETTER = re.compile(r"[^\W\d_]")


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of the lower-cased text between two spaces, and their counts."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    coded = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)
    counts = np.bincount(coded >> np.uint32(17), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass(frozen=True)
class Model:
    """The written table (block, lang, bucket, n) of trigram counts, in blocks of whole languages."""

    counts: DataFrame
    blocks: int


class Block:
    """The languages of a block, by name, with the chance of an unseen bucket each, and by bucket the languages that have seen it and their chances."""

    def __init__(self, names: list[str], unseen: np.ndarray, start: np.ndarray, seen: np.ndarray):
        self.names, self.unseen, self.start, self.seen = names, unseen, start, seen

    @property
    def language(self) -> np.ndarray:
        return self.seen["language"]

    @property
    def chance(self) -> np.ndarray:
        return self.seen["chance"]

    def sizes(self, at: np.ndarray) -> np.ndarray:
        return self.start[at + 1] - self.start[at]

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in at, language, chance) of the languages that have seen the buckets, in order of the first two."""
        size = self.sizes(at)
        place = np.repeat(np.arange(len(at)), size)
        found = self.seen[np.arange(len(place)) + np.repeat(self.start[at] - np.cumsum(size) + size, size)]
        return place, found["language"].copy(), found["chance"].copy()

    def contenders(self, at: np.ndarray, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Names of all languages of the block, and the log-likelihood of the counts under each alone."""
        place, language, chance = self.entries(at)
        gain = counts[place] * np.log(chance / self.unseen[language])
        return self.names, counts.sum() * np.log(self.unseen) + np.bincount(language, weights=gain, minlength=len(self.names))


class Languages:
    """All languages of a model in the order of their names, whatever blocks they are in."""

    def __init__(self, blocks: list[Block]):
        self.blocks, self.names = blocks, sorted(name for block in blocks for name in block.names)
        rank = {name: k for k, name in enumerate(self.names)}
        self.ranks = [np.array([rank[name] for name in block.names], np.int64) for block in blocks]
        self.unseen = np.empty(len(self.names))
        for block, ranks in zip(blocks, self.ranks, strict=True):
            self.unseen[ranks] = block.unseen
        self.whole = None
        if len(self.names) <= LAID_OUT:
            self.whole = Chances(self, np.arange(BUCKETS)).rows(np.arange(len(self.names)))


class Chances:
    """The chances of the buckets `at` under all languages: that of an unseen bucket, but for the entries of those that have seen it."""

    def __init__(self, languages: Languages, at: np.ndarray):
        self.languages, self.at, self.held = languages, at, None
        self.seen = sum(int(block.sizes(at).sum()) for block in languages.blocks)
        if self.seen <= HELD:
            parts = list(self.parts())
            self.held = parts[0]
            if len(parts) > 1:
                place, language, chance = (np.concatenate(c) for c in zip(*parts, strict=True))
                order = np.lexsort((language, place))
                self.held = place[order], language[order], chance[order]

    def parts(self):
        if self.held is not None:
            yield self.held
            return
        for block, ranks in zip(self.languages.blocks, self.languages.ranks, strict=True):
            place, language, chance = block.entries(self.at)
            yield place, ranks[language], chance

    def rows(self, chosen: np.ndarray) -> np.ndarray:
        """The chances under the chosen languages, laid out in full."""
        out = np.repeat(self.languages.unseen[chosen][:, None], len(self.at), axis=1)
        row = np.full(len(self.languages.names), -1)
        row[chosen] = np.arange(len(chosen))
        for place, language, chance in self.parts():
            own = np.flatnonzero(row[language] >= 0)
            out[row[language[own]], place[own]] = chance[own]
        return out

    def shares(self, counts: np.ndarray, rounds: int) -> np.ndarray:
        """As _shares() over all languages; where few have seen a bucket, from the entries alone."""
        unseen, cells = self.languages.unseen, len(self.languages.names) * len(self.at)
        if cells <= HELD and cells <= 16 * self.seen:
            return _shares(self.rows(np.arange(len(unseen))), counts, rounds)
        shares, total = np.full(len(unseen), 1.0 / len(unseen)), counts.sum()
        for _ in range(rounds):
            mixed = np.full(len(self.at), shares @ unseen)
            for place, language, chance in self.parts():
                mixed += np.bincount(place, weights=shares[language] * (chance - unseen[language]), minlength=len(mixed))
            due = counts / mixed
            taken = unseen * due.sum()
            for place, language, chance in self.parts():
                taken += np.bincount(language, weights=(chance - unseen[language]) * due[place], minlength=len(taken))
            shares = shares * taken / total
        return shares


def train(docs: DataFrame) -> Model:
    """Trigram counts of every language from all rows of docs(text, lang) with both, however many languages there are.

    Each task adds up the counts of its rows for each language; their sums are written as a table, whose languages are dealt to blocks of about BLOCK_COUNTS rows.
    """

    def batch_of(sums: dict[str, np.ndarray]):
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at])], names=["lang", "bucket", "n"])

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, n = trigrams(text)
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))[at] += n
                if len(sums) > LANGUAGES_AT_A_TIME:
                    yield from batch_of(sums)
                    sums = {}
        yield from batch_of(sums)

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    counts = write_once(rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    blocks = max(1, -(-counts.count() // BLOCK_COUNTS))
    return Model(counts.withColumn("block", F.pmod(F.xxhash64("lang"), F.lit(blocks))), blocks)


def load(model: Model, block: int) -> Block:
    got = model.counts.where(F.col("block") == block).select("lang", "bucket", "n").toArrow()
    coded = got.column("lang").combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist() if len(got) else []
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    language = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(got) else np.empty(0, np.int64)
    bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy().astype(float)
    totals = np.bincount(language, weights=n, minlength=len(names)) + SMOOTHING * BUCKETS
    by_bucket = np.lexsort((language, bucket))
    seen = np.empty(len(n), [("language", "<i4"), ("chance", "<f8")])
    seen["language"], seen["chance"] = language[by_bucket], ((n + SMOOTHING) / totals[language])[by_bucket]
    return Block([names[k] for k in order], SMOOTHING / totals, np.searchsorted(bucket[by_bucket], np.arange(BUCKETS + 1)), seen)


def share_model(spark: SparkSession, model: Model):
    """A function that gives tasks the Languages of the model.

    One block is broadcast. The entries of several are files that Spark brings to each executor and tasks map, so that neither they nor the driver hold them
    all in memory; names, chances of unseen buckets and the buckets' places in the files are broadcast. The driver's files go when it ends.
    """
    if model.blocks == 1:
        block = spark.sparkContext.broadcast(load(model, 0))
        return lambda: Languages([block.value])
    folder, heads = tempfile.mkdtemp(prefix="languages-"), []
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    for k in range(model.blocks):
        block, name = load(model, k), f"languages-{uuid.uuid4().hex}.npy"
        np.save(f"{folder}/{name}", block.seen)
        spark.sparkContext.addFile(f"{folder}/{name}")
        heads.append((name, block.names, block.unseen, block.start.astype(np.int32)))
    held = spark.sparkContext.broadcast(heads)
    return lambda: Languages([Block(names, unseen, start, np.load(SparkFiles.get(name), mmap_mode="r")) for name, names, unseen, start in held.value])


def _shares(chances: np.ndarray, counts: np.ndarray, rounds: int) -> np.ndarray:
    """Shares of the languages (rows of chances) by expectation-maximisation."""
    shares = np.full(len(chances), 1.0 / len(chances))
    if len(chances) > 1:
        total = counts.sum()
        for _ in range(rounds):
            shares = shares * (chances @ (counts / (shares @ chances))) / total
    return shares


def mixture(languages: Languages, at: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> tuple[np.ndarray, list[int]]:
    """Shares of all languages, and the chosen set, the largest share first.

    Sets grow by falling share in the mixture of all; each is fitted anew, and the one of greatest likelihood
    less the penalty for each language beyond the first is chosen.
    """
    if languages.whole is not None:
        laid_out = languages.whole[:, at]
        shares, rows = _shares(laid_out, counts, rounds), laid_out.__getitem__
    else:
        chances = Chances(languages, at)
        shares, rows = chances.shares(counts, rounds), chances.rows
    ranked = np.argsort(-shares, kind="stable")
    best = None
    for size in range(1, len(ranked) + 1):
        chosen = ranked[:size]
        own = rows(chosen)
        part = _shares(own, counts, rounds)
        fit = float(counts @ np.log(part @ own)) - penalty * np.log(counts.sum() + 1.0) * (size - 1)
        if best is not None and fit <= best[0]:
            break
        best = (fit, chosen[np.argsort(-part, kind="stable")].tolist())
    return shares, best[1]


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs and (lang_pred, score, languages) for each row, repeated rows included.

    lang_pred: the language of the largest share in the chosen set; score: its share in the mixture of all
    languages learned, however many; languages: the chosen set. Null texts and texts without a letter, or any text where no language was learned,
    give `und`, 0 and an empty list. Only the text is looked at; very long texts are read whole. An empty table gives no rows. One pass over the rows.
    """
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    shared = share_model(docs.sparkSession, model)

    def run(batches):
        languages = shared()
        for batch in batches:
            out = []
            for text in batch.column("__text").to_pylist():
                if text is None or not languages.names or not _LETTER.search(text):
                    out.append(("und", 0.0, []))
                    continue
                at, counts = trigrams(text)
                shares, chosen = mixture(languages, at, counts.astype(np.float64))
                out.append((languages.names[chosen[0]], min(1.0, float(shares[chosen[0]])), [languages.names[x] for x in chosen]))
            found = list(zip(*out, strict=True)) if out else [(), (), ()]
            columns = [batch.column(c) for c in keep]
            yield pa.record_batch([*columns, pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.list_(pa.string()))], names=[*keep, "lang_pred", "score", "languages"])

    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, languages array<string>")


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def train_and_identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages) of each row of docs(doc_id, text, lang, ...), repeated rows included.

    Learned from rows outside fold 0 with text and lang (rows of null id belong to no fold and aren't learned from), applied to all. Null texts and texts without a letter are `und`; very long texts are
    read whole; of equal shares the first language in order wins; an empty table gives no rows; other columns are ignored.
    """
    model = train(docs.where(fold() != 0))
    return identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).withColumn("held_out", F.coalesce(fold() == 0, F.lit(False)))
