"""The pipeline's stages against brute force."""

import random
import time
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from sparktide.llm import simhash, suffix_dedup

from .test_text_operators import brute_containment, brute_fingerprint, documents


def tables(spark, folder):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abdeginorst") for _ in range(r.randint(3, 8)))
    passage = " ".join(word() for _ in range(90))
    items = [(k, " ".join(word() for _ in range(20))) for k in range(4)]
    rows = [(0, None, "en"), (1, "", "en"), (2, "123 456 !", "en"), (None, "words without an id stay in", "en"), (3, "words without a language stay in", None), (4, "x" * 30, "en"), (4, "x" * 30, "en")]
    for k in range(40):
        body = [word() for _ in range(120)]
        if k % 5 == 0:
            body += [passage, *(word() for _ in range(40))]
        if k % 7 == 0:
            body[10:10] = items[k % 4][1].split()
        rows.append((10 + k, " ".join(body), "en"))
        if k % 6 == 0:
            rows.append((100 + k, " ".join(body), "en"))
    docs = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def brute(rows, items):
    kept = [(i, t) for i, t, _ in rows if t is not None and re.search(r"[^\W\d_]", t)]
    marks = [brute_fingerprint(t) for _, t in kept]
    parent = list(range(len(kept)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(kept)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= 4:
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(kept):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    single = sorted({(i, t) for k, (i, t) in enumerate(kept) if i is not None and i == low[find(k)]}) + [x for x in kept if x[0] is None]
    count = Counter(b[k : k + 400] for _, t in single for b in [t.encode()] for k in range(len(b) - 399))
    cut = []
    for i, t in single:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if count[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        cut.append((i, np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "replace").replace("�", "")))
    leaked = {x[0] for x in brute_containment(cut, items)}
    return [(i, t) for i, t in cut if i not in leaked]


def test_stages_and_run(spark, tmp_path):
    import sentencepiece

    folder = f"file://{tmp_path}"
    rows, items = tables(spark, folder)
    want = brute(rows, items)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, folder).collect()
    coded = Counter((i, np.array(library.encode(t, add_bos=True, add_eos=True), "<u4").tobytes(), t) for i, t in want)
    assert Counter((x.doc_id, bytes(x.ids), x.decoded) for x in got) == coded
    assert len(want) < len(rows) and any(len(t) < len(s) for (i, t) in want for (j, s, _) in rows if i == j and s)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert {x.doc_id: x.lang for x in docs.collect()}[3] == "en"


def test_passages_of_short_words(spark):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 4)))
    many, few = ([word() for _ in range(n)] for n in (51, 50))
    rows = [(k, "  ".join([word() for _ in range(60)]) + "\n" + " ".join(many if k % 2 else few) + f" é{k} " + " ".join(word() for _ in range(60))) for k in range(12)]
    rows += [(50, "again " * 60), (51, "once " * 51), (None, "é" + " ".join(many[:30] + few)), (60, None), (61, "")]
    rows += [(70 + k, " ".join(r.choice(["p", "q"]) for _ in range(4)) + " " + " ".join((many + few)[: 53 + r.randint(0, 40)])) for k in range(6)]
    count = Counter(tuple(w[k : k + 51]) for _, t in rows for w in [(t or "").split()] for k in range(len(w) - 50))
    want = {}
    for i, t in rows:
        at = [m.span() for m in re.finditer(r"\S+", t or "")]
        words = (t or "").split()
        gone = np.zeros(len(t or ""), bool)
        for k in range(len(words) - 50):
            if count[tuple(words[k : k + 51])] > 1:
                gone[at[k][0] : at[k + 50][1]] = True
        want[i] = None if t is None else "".join(c for c, g in zip(t, gone) if not g)
    assert len(" ".join(many)) < 400 and " ".join(many) not in want[1] and " ".join(few) in want[0] and want[50] == " " and want[51] == rows[13][1]
    docs = documents(spark, rows).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    passages = suffix_dedup.repeated_passages(docs).collect()
    spans = {x.doc_id: [(s.start, s.end) for s in x.spans] for x in passages}
    for i, t in rows:
        b, kept, last = (t or "").encode(), b"", 0
        for start, end in spans.get(i, []):
            kept, last = kept + b[last:start], end
        assert (kept + b[last:]).decode() == (want[i] or ""), i
    got = {x.doc_id: x for x in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert " ".join(many) not in got[1].text and got[1].text == want[1] and got[0].text == rows[0][1] and got[1].n_chars == len(want[1])


def brute_components(rows):
    """Counts of (doc_id, component_id) by the Jaccard similarity of five-word shingles, and the pairs between 0.8 and 0.9."""
    sets = [{tuple(w[x : x + 5]) for x in range(max(1, len(w) - 4))} if w else set() for _, t in rows for w in [(t or "").lower().split()]]
    root = list(range(len(rows)))
    border = 0
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                border += rows[a][0] is not None and len(sets[a] & sets[b]) < 0.9 * len(sets[a] | sets[b])
                root = [root[b] if x == root[a] else x for x in root]
    low = {k: min((i for (i, _), x in zip(rows, root) if x == k and i is not None), default=None) for k in root}
    return Counter((i, low[x]) for (i, _), x in zip(rows, root)), border


@pytest.mark.parametrize("bucket", [32, 2])
def test_similar_documents(spark, bucket):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abdeginorst") for _ in range(6)) for _ in range(4000)]
    rows = [(900, "Too few words"), (901, "too  few words"), (902, None), (903, ""), (None, "no id here")]
    for k in range(30):
        base = [r.choice(vocabulary) for _ in range(150)]
        for j in range(4):
            words = list(base)
            for at in r.sample(range(150), j and r.randint(1, 6)):
                words[at] = r.choice(vocabulary)
            rows.append((10 * k + j, " ".join(words)))
    want, border = brute_components(rows)
    docs = documents(spark, rows).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    assert border > 20 and Counter((x.doc_id, x.component_id) for x in simhash.similar_documents(docs, bucket=bucket).collect()) == want
    if bucket > 2:
        kept = {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
        assert kept == {i for i, _ in want if i is None} | {c for i, c in want if i == c}


def test_crowded_buckets(spark, monkeypatch):
    """Chains of texts a few words apart, whose ends are not similar: one hub a bucket misses links, the search behind it finds them all."""
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abdeginorst") for _ in range(6)) for _ in range(4000)]
    rows = []
    for k in range(4):
        words = [r.choice(vocabulary) for _ in range(60)] if k % 2 == 0 else list(words)
        for j in range(40):
            rows.append((100 * k + j, " ".join(words)))
            words[r.randrange(60)] = r.choice(vocabulary)
            if j % 13 == 12:
                for at in r.sample(range(60), 4):
                    words[at] = r.choice(vocabulary)
    want, border = brute_components(rows)
    find = lambda: Counter((x.doc_id, x.component_id) for x in simhash.similar_documents(documents(spark, rows), bucket=2, hubs=1).collect())
    assert border > 40 and 4 < len({c for _, c in want}) < 40 and find() == want
    monkeypatch.setattr(simhash, "crowded_links", lambda *a: None)
    assert find() != want


def test_rows_of_null_and_equal_ids(spark, tmp_path):
    r = random.Random(3)
    text = lambda n=40: " ".join("".join(r.choice("abdeginorst") for _ in range(6)) for _ in range(n))
    item, copied, other, lone = text(20), text(), text(), text()
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    clean = text()
    rows = [(None, "x " + item), (7, item), (7, clean), (3, copied), (5, copied), (5, other), (None, lone), (None, lone), (None, copied), (9, lone + " end"), (2, other)]
    docs = documents(spark, rows).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    got = Counter((x.doc_id, x.text) for x in corpus_pipeline.drop_contaminated(spark, docs, f"file://{tmp_path}").collect())
    assert got == Counter(x for x in rows if item not in x[1])
    got = Counter((x.doc_id, x.text) for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == Counter([(7, item), (7, clean), (3, copied), (2, other), (9, lone + " end")])


def test_clashing_columns_nulls_and_empty_tables(spark, tmp_path):
    """Columns named like those the stages use inside change nothing; nor do rows of nulls; empty tables give no rows."""
    tables(spark, f"file://{tmp_path}/plain")
    plain = spark.read.parquet(f"file://{tmp_path}/plain/documents.parquet")
    wide = plain
    for name in ("th", "own", "first", "row", "start", "anchor", "fp", "h", "n", "len", "lang_pred", "spans", "rest", "kept", "octets", "ids", "decoded", "component_id", "item_id", "__text", "block"):
        wide = wide.withColumn(name, F.lit(7))
    nothing = spark.createDataFrame([(None, None, None, None, None)], plain.schema)
    wide.unionByName(nothing, allowMissingColumns=True).write.parquet(f"file://{tmp_path}/wide/documents.parquet")
    spark.read.parquet(f"file://{tmp_path}/plain/benchmark.parquet").withColumn("h", F.lit(1)).write.parquet(f"file://{tmp_path}/wide/benchmark.parquet")
    find = lambda folder: Counter((x.doc_id, x.n_tokens, bytes(x.ids), x.decoded) for x in corpus_pipeline.run(spark, f"file://{tmp_path}/{folder}").collect())
    assert find("wide") == find("plain")
    plain.limit(0).write.parquet(f"file://{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"file://{tmp_path}/plain/benchmark.parquet").limit(0).write.parquet(f"file://{tmp_path}/none/benchmark.parquet")
    began = time.time()
    assert not find("none")
    assert time.time() - began < 60
