"""One text of some 5 MB beside short ones, for each operator that reads texts."""

import random

import pytest
from pyspark.sql import functions as F

from quadloom.llm import binary_ids, fingerprints, language, near_dup, packing, quality, secrets, substring_dedup, token_counts
from quadloom.llm.queries import _tokenizer


@pytest.fixture(scope="module")
def long_text():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnopé") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    return " ".join(r.choice(words) + r.choice(["", "", "", ".", ".\n", ".\n\n"]) for _ in range(760_000))


@pytest.fixture(scope="module")
def docs(spark, long_text):
    rows = [(1, long_text, "xx"), (2, "short text of a few words", "xx"), (3, long_text[:2_000] + " changed", "yy")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).cache()


def _by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_ids(docs, long_text):
    from tokenizers import Tokenizer

    assert len(long_text.encode()) > 4_500_000
    n = len(Tokenizer.from_file(_tokenizer("byte_bpe_50k.json")).encode(long_text, add_special_tokens=False))
    assert _by_id(token_counts.token_counts(docs, _tokenizer("byte_bpe_50k.json")))[1].n_tokens == n
    assert _by_id(binary_ids.binary_ids(docs, _tokenizer("byte_bpe_50k.json"), end_id=0))[1].n_tokens == n + 1


def test_packing(docs):
    pieces = packing.pack_documents(docs, _tokenizer("word_bpe_49k.json"), size=2048, end_id=0)
    own = pieces.where("doc_id = 1").agg(F.max("piece"), F.sum("length"), F.min("length")).first()
    assert own[1] > 2048 * own[0] and own[1] - 2048 * own[0] == own[2]


def test_quality_and_language(docs, long_text):
    got = _by_id(quality.quality(docs))
    assert got[1].n_words == len(long_text.split()) and not got[1].base_failed
    assert _by_id(language.predict(docs, language.profiles(docs)))[1].lang_pred in ("xx", "yy")


def test_duplicates(docs, long_text):
    got = _by_id(near_dup.near_duplicates(docs.unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(9).cast("long")))))
    assert (got[9].component_id, got[1].kept, got[3].component_id) == (1, True, 3)
    kept = _by_id(substring_dedup.repeated_words(docs, window=20))
    assert kept[1].n_removed == 0 and kept[3].n_removed > 250


def test_secrets_and_fingerprints(docs):
    assert _by_id(secrets.secret_report(docs))[1].n_access == 0
    got = _by_id(fingerprints.edited_fingerprints(docs))
    assert got[1].fingerprint != got[1].edited_fingerprint and 0 < got[1].near_edited < 1
