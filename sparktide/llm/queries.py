"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktide.llm import conversations, decontaminate, language, licenses, periodic_runs, personal_data, pieces, quality, simhash, suffix_dedup, token_counts, token_files, vector_codes
from sparktide.llm.common import table
from sparktide.llm.decontaminate import BROADCAST_ROWS


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their groups; see simhash.near_duplicates() for nulls, ties, repeats and the like."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages without their quotes and with the message that each replies to; see conversations.link_quotations()."""
    return conversations.link_quotations(table(spark, sf_dir, "conversations"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds; see decontaminate.contained_items()."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, base phrases, labels and score of every document; see licenses.scan_licenses()."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document, by rules learned from the labels; see quality.judge()."""
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from the token files; see token_files.token_files()."""
    return token_files.token_files(spark, table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document; see token_counts.token_counts()."""
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to repeated strings of 400 bytes, and the text that remains; see suffix_dedup.remove_repeats()."""
    return suffix_dedup.removal(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text decoded from them; see pieces.encode_decode()."""
    coded = pieces.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by a model of the rows outside fold 0; see language.train_and_identify()."""
    found = language.train_and_identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.concat_ws(",", "languages").alias("languages"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and all spans of personal data of every document, counts of the base ones; see personal_data.find_personal_data()."""
    found = personal_data.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.base)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, personal_data.KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, longest run and digests of the runs of words of every document, some with a stretch that repeats; see periodic_runs.find_runs()."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", periodic_runs.planted(F.col("doc_id"), periodic_runs.words_of(F.col("text"))).alias("words"))
    found = periodic_runs.find_runs(words)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    top = F.array_max(F.transform("runs", lambda r: F.struct(r.length, (-r.start).alias("start"), (-r.period).alias("period"))))
    each = found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"))
    longest = [(-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period")]
    exponent = F.expr("-(1000 * top.length) div top.period").alias("exponent_milli")
    return each.select("doc_id", "n_runs", *longest, exponent, "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, error and digests of every usable vector; see vector_codes.compress_vectors(). label_error is null where no error of the label is known."""
    coded, books = vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "own_label")
    few = sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("own_label")), "left")
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


# Columns of the operators that SQL can express, as queries of their own beside it.


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2_licenses that don't depend on its rules."""
    return op2_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of op3_quality, without what is learned."""
    found = quality.statistics(table(spark, sf_dir, "documents"))
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words").alias("base_failed")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed)


def language_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows op10_language holds out, and which of them it finds no language in."""
    found = op10_language(spark, sf_dir)
    return found.select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("undetermined"))


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op11_personal_data that its field doesn't add to."""
    return op11_personal_data(spark, sf_dir).drop("spans", "base_sha256")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_licenses": op2_licenses,
    "op3_quality": op3_quality,
    "op4_token_files": op4_token_files,
    "op5_conversations": op5_conversations,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_counts": op7_token_counts,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_language": op10_language,
    "op11_personal_data": op11_personal_data,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_vector_codes": op13_vector_codes,
    "licenses_base": licenses_base,
    "quality_statistics": quality_statistics,
    "language_folds": language_folds,
    "personal_data_base": personal_data_base,
}

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_NORM = r"trim(regexp_replace(lower({0}), '[ \t\n\f\r]+', ' ', 'g'))"

# XXH64 in SQL: 64-bit arithmetic on 128-bit integers. The primes are the algorithm's fixed values.
_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
_MOD = f"{1 << 64}::UHUGEINT"


def _times(a: str, b: int) -> str:
    return f"(({a}) * {b}::UHUGEINT % {_MOD})"


def _plus(a: str, b: str) -> str:
    return f"((({a}) + ({b})) % {_MOD})"


def _turned(x: str, r: int) -> str:
    return f"(({x}) * {1 << r}::UHUGEINT % {_MOD} + ({x}) // {1 << 64 - r}::UHUGEINT)"


def _mixed(a: str, k: str) -> str:
    return _times(_turned(_plus(a, _times(k, _PRIMES[1])), 31), _PRIMES[0])


def _xxh64_sql(source: str, text: str, seed: int = 42) -> str:
    """CTEs that end in hashed(text, n bytes, h UHUGEINT) for the distinct values of a text column."""
    p1, p2, p3, p4, p5 = _PRIMES
    starts = [(seed + p1 + p2) % (1 << 64), (seed + p2) % (1 << 64), seed, (seed - p1) % (1 << 64)]
    lanes = ", ".join(
        f"list_reduce(list_concat([{v}::UHUGEINT], list_transform(generate_series(0, n // 32 - 1), lambda i: w[4 * i + {k + 1}])), lambda a, x: {_mixed('a', 'x')}) AS v{k}" for k, v in enumerate(starts)
    )
    joined = _plus(_plus(_turned("v0", 1), _turned("v1", 7)), _plus(_turned("v2", 12), _turned("v3", 18)))
    steps = []
    for k in range(4):
        fold = _plus(_times(f"xor(h, {_mixed('0::UHUGEINT', f'v{k}')})", p1), f"{p4}::UHUGEINT")
        steps.append(f"m{k} AS (SELECT * REPLACE ({fold} AS h) FROM {'joined' if not k else f'm{k - 1}'})")
    eight = _plus(_times(_turned(f"xor(a, {_mixed('0::UHUGEINT', 'x')})", 27), p1), f"{p4}::UHUGEINT")
    one = _times(_turned(f"xor(a, {_times('x', p5)})", 11), p1)
    return f"""texts AS (SELECT DISTINCT {text} AS text FROM {source}),
octets AS (SELECT text, len(x) // 2 AS n, list_transform(generate_series(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::UTINYINT) AS b FROM (SELECT text, hex(encode(text)) AS x FROM texts)),
eights AS (SELECT *, list_transform(generate_series(0, n // 8 - 1), lambda i: b[8 * i + 1]::UHUGEINT + {' + '.join(f'b[8 * i + {j + 1}]::UHUGEINT * {256 ** j}::UHUGEINT' for j in range(1, 8))}) AS w FROM octets),
lanes AS (SELECT *, {lanes} FROM eights),
joined AS (SELECT *, {joined} AS h FROM lanes), {', '.join(steps)},
sized AS (SELECT text, n, b, w, {_plus(f'CASE WHEN n >= 32 THEN h ELSE {(seed + p5) % (1 << 64)}::UHUGEINT END', 'n::UHUGEINT')} AS h FROM m3),
long_tail AS (SELECT * REPLACE (list_reduce(list_concat([h], w[n // 32 * 4 + 1 :]), lambda a, x: {eight}) AS h) FROM sized),
half AS (SELECT *, b[n // 8 * 8 + 1]::UHUGEINT + b[n // 8 * 8 + 2]::UHUGEINT * 256 + b[n // 8 * 8 + 3]::UHUGEINT * 65536 + b[n // 8 * 8 + 4]::UHUGEINT * 16777216 AS k FROM long_tail),
halved AS (SELECT text, n, CASE WHEN n % 8 >= 4 THEN xor(h, {_times('k', p1)}) ELSE h END AS h, b[n // 4 * 4 + 1 :] AS rest FROM half),
turned AS (SELECT text, n, rest, CASE WHEN n % 8 >= 4 THEN {_plus(_times(_turned('h', 23), p2), f'{p3}::UHUGEINT')} ELSE h END AS h FROM halved),
ended AS (SELECT text, n, list_reduce(list_concat([h], list_transform(rest, lambda x: x::UHUGEINT)), lambda a, x: {one}) AS h FROM turned),
a1 AS (SELECT text, n, {_times(f'xor(h, h // {1 << 33}::UHUGEINT)', p2)} AS h FROM ended),
a2 AS (SELECT text, n, {_times(f'xor(h, h // {1 << 29}::UHUGEINT)', p3)} AS h FROM a1),
hashed AS (SELECT text, n, xor(h, h // {1 << 32}::UHUGEINT)::UBIGINT AS h FROM a2)"""


def _vector_codes_sql(rounds: int = 4) -> str:
    """One CTE for each assignment and each set of codebooks."""
    out = ["""k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
           "x AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS v FROM k, range(4) AS t(p))",
           "c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM x QUALIFY e < 256)"]
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, label, p, v, min((d, e)) AS best FROM (SELECT x.*, c{r}.e, list_sum(list_transform(list_zip(x.v, c{r}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
FROM x JOIN c{r} USING (p)) GROUP BY vec_id, label, p, v)""")
        if r < rounds:
            out.append(f"""m{r} AS (SELECT p, e, list(m::BIGINT ORDER BY i) AS v FROM (SELECT p, best[2] AS e, i, floor(sum(v[i]) / count(*)) AS m FROM a{r}, range(1, 1 + (SELECT max(len(v)) FROM x)) AS t(i) GROUP BY ALL) GROUP BY p, e)""")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (p, e))")
    out.append(f"r AS (SELECT vec_id, label, string_agg(lpad(lower(hex(best[2])), 2, '0'), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label)")
    out.append(f"h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM c{rounds})")
    return f"WITH {', '.join(out)}\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM r, h"


ORACLE_SQL = {
    "op1_simhash": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (SELECT id, array_to_string(w[k : k + 3], ' ') AS s FROM (SELECT id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS k FROM d WHERE len(w) > 0)),
{_xxh64_sql('s', 's')},
c AS (SELECT id, count(*) AS n, {', '.join(f'sum((h >> {b}) & 1)::BIGINT AS c{b}' for b in range(64))} FROM s JOIN hashed ON hashed.text = s.s GROUP BY id),
f AS (SELECT d.id, d.doc_id, CASE WHEN c.id IS NULL THEN 0::UBIGINT ELSE ({' + '.join(f'CASE WHEN 2 * c{b} > n THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END' for b in range(64))})::UBIGINT END AS fp FROM d LEFT JOIN c USING (id)),
u AS (SELECT DISTINCT fp FROM f), link AS (SELECT x.fp AS a, y.fp AS b FROM u x, u y WHERE x.fp <> y.fp AND bit_count(xor(x.fp, y.fp)) <= 4),
reach AS (SELECT fp AS a, fp AS b FROM u UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
low AS (SELECT reach.a AS fp, min(f.doc_id) AS component_id FROM reach JOIN f ON f.fp = reach.b GROUP BY 1)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM f JOIN low USING (fp)""",
    "op5_conversations": r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) AS text FROM conversations),
l AS (SELECT id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS k, unnest(string_split(text, chr(10))) AS line FROM m),
v AS (SELECT id, k, len(regexp_replace(regexp_extract(line, '^(?:[ \t]{0,3}>)+'), '[^>]', '', 'g')) AS level, regexp_replace(line, '^(?:[ \t]{0,3}>)+ ?', '') AS body FROM l),
g AS (SELECT *, k - row_number() OVER (PARTITION BY id, level ORDER BY k) AS run FROM v),
own AS (SELECT id, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (level = 0), ''), '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g') AS text FROM v GROUP BY id),
quoted AS (SELECT id, level, NORM(string_agg(body, chr(10) ORDER BY k)) AS s, count(*) FILTER (NORM(body) <> '') AS size FROM g WHERE level > 0 GROUP BY id, level, run),
sizes AS (SELECT DISTINCT conv_id, size FROM quoted JOIN m USING (id) WHERE s <> ''),
own_lines AS (SELECT id, list_filter(list_transform(string_split(text, chr(10)), lambda x: NORM(x)), lambda x: x <> '') AS ls FROM own),
runs AS (SELECT id, array_to_string(ls[k : k + size - 1], ' ') AS s FROM (SELECT id, ls, size, unnest(generate_series(1, len(ls) - size + 1)) AS k FROM own_lines JOIN m USING (id) JOIN sizes USING (conv_id) WHERE len(ls) >= size)),
held AS (SELECT id, s FROM runs UNION ALL SELECT id, NORM(s) AS s FROM (SELECT id, text AS s FROM own UNION ALL SELECT id, unnest(string_split_regex(text, '\n[ \t\f\r]*\n')) FROM own)),
found AS (SELECT a.conv_id, a.turn, q.level, max(b.turn) AS source FROM quoted q JOIN m a USING (id) JOIN held h ON h.s = q.s JOIN m b ON b.id = h.id AND b.conv_id = a.conv_id AND b.turn < a.turn WHERE q.s <> '' GROUP BY a.conv_id, a.turn, q.level, q.s),
replies AS (SELECT conv_id, turn, source AS parent FROM found QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, source DESC) = 1),
up AS (SELECT conv_id, turn, parent AS root FROM replies UNION ALL SELECT up.conv_id, up.turn, r.parent FROM up JOIN replies r ON r.conv_id = up.conv_id AND r.turn = up.root),
roots AS (SELECT conv_id, turn, min(root) AS root FROM up GROUP BY 1, 2)
SELECT m.conv_id, m.turn, m.role, own.text, replies.parent AS parent_turn, coalesce(roots.root, m.turn) AS root_turn,
       (SELECT count(*) FROM quoted q WHERE q.id = m.id AND q.s <> '') AS n_quoted
FROM m JOIN own USING (id) LEFT JOIN replies ON replies.conv_id = m.conv_id AND replies.turn = m.turn LEFT JOIN roots ON roots.conv_id = m.conv_id AND roots.turn = m.turn
""".replace("NORM(string_agg(body, chr(10) ORDER BY k))", _NORM.format("string_agg(body, chr(10) ORDER BY k)")).replace("NORM(body)", _NORM.format("body")).replace("NORM(x)", _NORM.format("x")).replace("NORM(s)", _NORM.format("s")),
    "op6_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     i AS (SELECT item_id, {_WORDS} AS w, least(len({_WORDS}), 5) AS n FROM benchmark),
     ds AS (SELECT DISTINCT doc_id, n, array_to_string(w[k : k + n - 1], ' ') AS s
            FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k
                  FROM d, (SELECT DISTINCT n FROM i WHERE n > 0) WHERE len(w) >= n)),
     qs AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS s
            FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM i WHERE n > 0)),
     q AS (SELECT item_id, count(*) AS n_item FROM qs GROUP BY 1)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item::DOUBLE AS containment
FROM (SELECT ds.doc_id, qs.item_id, count(*) AS n_shared FROM ds JOIN qs USING (n, s) GROUP BY 1, 2) JOIN q USING (item_id)
WHERE n_shared >= 0.8 * n_item""",
    "op8_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT id, h, unnest(generate_series(0, len(h) // 2 - 400)) AS i FROM d WHERE len(h) >= 800)),
hit AS (SELECT id, i FROM p WHERE k IN (SELECT k FROM p GROUP BY k HAVING count(*) > 1)),
g AS (SELECT id, i, CASE WHEN i - lag(i) OVER (PARTITION BY id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM hit),
s AS (SELECT id, min(i) AS a, max(i) + 400 AS b FROM (SELECT id, i, sum(new) OVER (PARTITION BY id ORDER BY i) AS run FROM g) GROUP BY id, run),
piece AS (SELECT id, coalesce(lag(b) OVER (PARTITION BY id ORDER BY a), 0) AS x, a AS y FROM s UNION ALL SELECT d.id, coalesce(m, 0), len(h) // 2 FROM d LEFT JOIN (SELECT id, max(b) AS m FROM s GROUP BY id) USING (id)),
part AS (SELECT id, x, substr(h, 2 * x + 1, 2 * (y - x)) AS h FROM piece JOIN d USING (id)),
whole AS (SELECT id, x, h, regexp_replace(regexp_replace(h, '^([89AB].)+', ''), '([CD].|E.([89AB].)?|F.([89AB].){0,2})$', '') AS c FROM part),
kept AS (SELECT id, string_agg(h, '' ORDER BY x) AS h, decode(unhex(string_agg(c, '' ORDER BY x))) AS text FROM whole GROUP BY id),
lost AS (SELECT id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY id)
SELECT doc_id, len(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256, kept.text FROM d JOIN kept USING (id) LEFT JOIN lost USING (id)""",
    "op13_vector_codes": _vector_codes_sql(),
    "licenses_base": rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT * FROM (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')) t(p, label)),
h AS (SELECT id, k - 1 AS k, label FROM (SELECT id, w, p, label, unnest(generate_series(1, len(w) - len(p) + 1)) AS k FROM d, b) WHERE w[k : k + len(p) - 1] = p),
g AS (SELECT id, count(*) AS n, min(k) AS a, max(k) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g USING (id)""",
    "quality_statistics": r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT id, line FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
u AS (SELECT id, sum(n - 1)::BIGINT AS dup FROM (SELECT id, line, count(*) AS n FROM l GROUP BY id, line) GROUP BY id),
t AS (SELECT id, k, w[k] || chr(10) || w[k + 1] || chr(10) || w[k + 2] AS s FROM (SELECT id, w, unnest(generate_series(1, len(w) - 2)) AS k FROM d)),
m AS (SELECT id, k FROM t QUALIFY count(*) OVER (PARTITION BY id, s) > 1),
r AS (SELECT id, count(DISTINCT x) AS n FROM (SELECT id, unnest([k, k + 1, k + 2]) AS x FROM m) GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
       coalesce(r.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed FROM d LEFT JOIN u USING (id) LEFT JOIN r USING (id)""",
    "language_folds": f"""
WITH RECURSIVE bits AS (SELECT b AS n, b::BIGINT AS c, 0 AS k FROM range(256) t(b) UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
t AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, text, list_reduce(list_concat([{0xFFFFFFFF}::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(t[xor(c & 255, x) + 1], c >> 8)) AS c FROM documents, t)
SELECT doc_id, coalesce(xor(c, {0xFFFFFFFF}) % 5 = 0, false) AS held_out, NOT regexp_matches(coalesce(text, ''), '\\pL') AS undetermined FROM d""",
    "personal_data_base": r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS n FROM d),
i AS (SELECT id, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)')) AS m FROM d) WHERE len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR try_cast(x AS INTEGER) > 255)) = 0 GROUP BY id),
c AS (SELECT id, regexp_replace(m, '[^0-9]', '', 'g') AS m FROM (SELECT id, unnest(regexp_extract_all(text, '[0-9](?:[ -]?[0-9])+')) AS m FROM d)),
k AS (SELECT id, count(*) AS n FROM c WHERE length(m) BETWEEN 12 AND 19 AND list_sum(list_transform(generate_series(1, length(m)), lambda j: CASE WHEN (length(m) - j) % 2 = 0 THEN substr(m, j, 1)::INTEGER WHEN substr(m, j, 1)::INTEGER > 4 THEN 2 * substr(m, j, 1)::INTEGER - 9 ELSE 2 * substr(m, j, 1)::INTEGER END)) % 10 = 0 GROUP BY id),
p AS (SELECT id, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(text, '\+[0-9][ ().0-9-]+[0-9]')) AS m FROM d) WHERE length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15 GROUP BY id)
SELECT doc_id, coalesce(e.n, 0)::BIGINT AS n_email, coalesce(i.n, 0) AS n_ip, coalesce(k.n, 0) AS n_card, coalesce(p.n, 0) AS n_phone FROM d LEFT JOIN e USING (id) LEFT JOIN i USING (id) LEFT JOIN k USING (id) LEFT JOIN p USING (id)""",
}
