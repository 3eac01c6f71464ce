"""The queries of this subpackage over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import binary_ids, decontamination, filter_audit, fingerprints, language, near_dup, packing, quality, secrets, sentencepiece_ids, substring_dedup, token_counts, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op2_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_documents(spark, sf_dir), shingle_words=3, percent=85)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_ids.digests(_documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"), size=2048, end_id=0)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_documents(spark, sf_dir))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_documents(spark, sf_dir))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_words(_documents(spark, sf_dir), window=20)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_documents(spark, sf_dir))


def op10_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_ids.binary_ids(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), end_id=0)


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"), window=10)
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compressed(_table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6)
    digest = hashlib.sha256(vector_codes.listed(books).encode()).hexdigest()
    return codes.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


_ALL = (
    op1_token_counts, op2_minhash_near_dup, op3_sentencepiece, op4_best_fit_packing, op5_quality_rules, op6_secret_scans, op7_document_fingerprints, op8_substring_dedup, op9_language_id, op10_binary_ids,
    op11_benchmark_decontamination, op12_filter_audit, op13_vector_codes,
)
QUERIES = {f.__name__: f for f in _ALL}

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

_OP2 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 3 THEN ws ELSE ws[i:i + 2] END, ' ') AS g FROM w, unnest(range(1, greatest(2, len(ws) - 1))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT a AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b) AS component_id, a = min(b) AS kept FROM reach LEFT JOIN n ON a = doc_id GROUP BY a"""

_OP5 = rf"""WITH w AS (SELECT doc_id, text, {_WORDS.format("text")} AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
three AS (SELECT doc_id, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM three WHERE c IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat FROM win, range(3) r(d) WHERE k > 1 GROUP BY ALL),
most AS (SELECT doc_id, max(k) AS most FROM (SELECT doc_id, word, count(*) AS k FROM word GROUP BY ALL) GROUP BY ALL),
figures AS (SELECT doc_id, count(*) AS n, sum(length(word)) AS chars, count(*) FILTER (length(regexp_replace(word, '[^A-Z]', '', 'g')) >= 2 AND NOT regexp_matches(word, '[a-z]|[^\x00-\x7F]')) AS caps,
    count(*) FILTER (regexp_matches(word, '[A-Za-z]|[^\x00-\x7F]')) AS letters FROM word GROUP BY ALL),
f AS (SELECT w.doc_id, coalesce(n, 0) AS n, coalesce(chars, 0) AS chars, coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0) AS symbols, coalesce(n_dup, 0) AS n_dup, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat, 0) AS n_repeat, caps, letters, most
    FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN most USING (doc_id) LEFT JOIN figures USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, n_dup::BIGINT AS n_dup_lines, n_repeat::BIGINT AS n_repeat_words, n < 50 OR 100 * n_repeat > 50 * n AS base_failed,
    n >= 50 AND 100 * n_repeat <= 50 * n AND 5 * symbols < n AND chars BETWEEN 2 * n AND 20 * n AND 2 * n_dup <= n_lines AND 2 * caps <= n AND 10 * letters >= 6 * n AND 10 * most <= 3 * n AS kept FROM f"""

_OP8 = f"""WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM w, unnest(range(1, len(ws) - 18)) t(i)),
again AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i, true AS hit FROM again, range(20) r(k)),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w)
SELECT w.doc_id, count(word)::BIGINT AS n_words, count(hit)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY word.i) FILTER (hit IS NULL), '')) AS kept_sha256
FROM w LEFT JOIN word USING (doc_id) LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = word.i GROUP BY w.doc_id"""

_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP11 = f"""WITH i AS (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[k:k + 9], ' ') AS g FROM i, unnest(range(1, greatest(2, len(ws) - 8))) t(k) WHERE len(ws) > 0),
d AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS g FROM d, unnest(range(1, len(ws) + 1)) t(k), (SELECT DISTINCT n FROM g) WHERE k + n - 1 <= len(ws)),
h AS (SELECT doc_id, k, n, item_id FROM p JOIN g USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM h, range(10) r(j) WHERE j < h.n GROUP BY ALL),
item AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY ALL)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(item.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)"""

_OP12 = rf"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS.format("text")} AS ws, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
f AS (SELECT part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), doc_id > least] AS fails,
    coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM w LEFT JOIN labels USING (doc_id)),
m AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
r AS (SELECT m.*, filter_order, CASE {" ".join(f"WHEN fails[instr('ABCDE', filter_order[{k}])] THEN {k}" for k in range(1, 6))} ELSE 6 END AS first FROM m, o),
s AS (SELECT part, filter_order, step::INTEGER AS step, sum(n) FILTER (first > step) AS kept, sum(n) FILTER (first = step) AS removed, sum(n) FILTER (first < step AND fails[instr('ABCDE', filter_order[step])]) AS redundant,
    sum(n) FILTER (fails[instr('ABCDE', filter_order[step])] AND fails[1]::INT + fails[2]::INT + fails[3]::INT + fails[4]::INT + fails[5]::INT = 1) AS alone,
    sum(n) FILTER (first = step AND good) AS good, sum(n) FILTER (first = step AND toxic) AS toxic FROM r, range(1, 6) k(step) GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(alone, 0)::BIGINT AS unique_fails,
    coalesce(good, 0)::BIGINT AS good_lost, coalesce(toxic, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, filter_order[step]), 0)::BIGINT AS shapley FROM s"""


def _rounds(n: int) -> str:
    """SQL of n rounds of assigning parts to their nearest entries and moving these, and of the last assignment."""
    one = """d{k} AS MATERIALIZED (SELECT vec_id, p, e, sum((x - b) * (x - b)) AS d FROM v JOIN b{k} USING (p, j) GROUP BY ALL),
a{k} AS MATERIALIZED (SELECT vec_id, p, e, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)"""
    move = """b{k1} AS MATERIALIZED (SELECT p, e, j, coalesce(mean, b) AS b FROM b{k} LEFT JOIN (SELECT p, e, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS mean FROM v JOIN a{k} USING (vec_id, p) GROUP BY ALL) USING (p, e, j))"""
    return ",\n".join([f"{one.format(k=k)},\n{move.format(k=k, k1=k + 1)}" for k in range(n)] + [one.format(k=n)])


_OP13 = f"""WITH c AS MATERIALIZED (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // 8 AS size FROM embeddings),
v AS MATERIALIZED (SELECT vec_id, i // size AS p, i % size AS j, floor(4096 * x)::BIGINT AS x FROM c ANTI JOIN (SELECT vec_id FROM c WHERE x IS NULL OR NOT isfinite(x)) USING (vec_id)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT DISTINCT vec_id FROM v) ORDER BY vec_id LIMIT 16),
b0 AS MATERIALIZED (SELECT p, e, j, x AS b FROM v JOIN s USING (vec_id)),
{_rounds(6)},
codes AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(b::VARCHAR, ',' ORDER BY p, e, j)) FROM b6) AS codebooks_sha256
FROM codes JOIN embeddings USING (vec_id)"""

#: By the figures' definitions alone, for tables with distinct ids. The others have no SQL: it can't express tokenizers,
#: profiles, trees and places of matches.
ORACLE_SQL: dict[str, str] = {"op2_minhash_near_dup": _OP2, "op5_quality_rules": _OP5, "op8_substring_dedup": _OP8, "op11_benchmark_decontamination": _OP11, "op12_filter_audit": _OP12, "op13_vector_codes": _OP13}
