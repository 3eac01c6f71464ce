"""Terms, text, vectors and evidence against known values."""

import pytest
from pyspark.sql import functions as F

from quadloom.functions import terms, text, vectors
from quadloom.operators import evidence


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("label", "slug"), [("cold exposure", "cold_exposure"), ("PostgreSQL", "postgresql"), ("vitamin D3", "vitamin_d3"), ("a--b  c", "a_b_c"), ("__test__", "test"), ("café", "caf")])
def test_slugs(spark, label, slug):
    assert one(spark, terms.slugify("v"), v=label) == slug


def test_uris(spark):
    assert one(spark, terms.to_entity_uri("v"), v="cold_exposure") == "http://knowledge.local/data/cold_exposure"
    assert one(spark, terms.to_predicate_uri("v"), v="leadTo") == "http://knowledge.local/schema/leadto"
    assert one(spark, terms.to_entity_uri("v"), v="urn:x:Y") == "urn:x:Y"
    assert one(spark, terms.display_label("v"), v="http://x/a%20b") == "a b"


@pytest.mark.parametrize(("value", "is_entity"), [("dopamine", True), ("cold_exposure", True), ("vitamin_d3", True), ("250%", False), ("COVID-19", False), ("3.14159", False), ("", False), ("two words", False), ("a" * 61, False)])
def test_entities(spark, value, is_entity):
    assert one(spark, terms.is_object_entity("v"), v=value) is is_entity


def test_hints_win(spark):
    assert one(spark, terms.is_object_entity("v", F.lit("entity")), v="COVID-19") is True
    assert one(spark, terms.is_object_entity("v", F.lit("literal")), v="dopamine") is False


def test_hash_escapes_literals(spark):
    import hashlib

    got = one(spark, terms.triple_hash(F.lit("urn:s"), F.lit("urn:p"), "v"), v='say "x"\n')
    assert got == hashlib.sha256(b'<urn:s> <urn:p> "say \\"x\\"\\n"').hexdigest()


@pytest.mark.parametrize(("confidences", "combined"), [([0.8], 0.8), ([0.7, 0.8], 0.94), ([0.5, 0.6, 0.7], 0.94), ([0.0, 0.8], 0.8), ([1.0, 0.5], 1.0), ([1.5, 0.5], 1.0)])
def test_noisy_or(spark, confidences, combined):
    df = spark.createDataFrame([(c,) for c in confidences], "c double")
    assert df.agg(evidence.noisy_or("c").alias("x")).first().x == pytest.approx(combined)


def test_no_evidence(spark):
    none = spark.createDataFrame([], "k int, c double")
    assert none.agg(evidence.noisy_or("c").alias("x")).first().x == 0.0
    assert evidence.ask_confidence(spark.createDataFrame([(1, None)], "k int, c double"), ["k"], "c").first().confidence is None


def test_single_sources_stand_as_they_are(spark):
    df = spark.createDataFrame([(1, 1.2), (2, 1.2), (2, 0.1)], "k int, confidence double")
    assert {r.k: r.combined for r in evidence.combine_evidence(df, ["k"]).collect()} == {1: 1.2, 2: 1.0}


def test_penalty(spark):
    assert one(spark, evidence.penalised(F.lit(0.8), F.lit(None).cast("double"))) == 0.8
    assert one(spark, evidence.penalised(F.lit(0.8), F.lit(0.9))) == pytest.approx(0.44)


def test_ranks(spark):
    words = text.analyze(F.lit("The cats and the cats of dogs"))
    assert one(spark, words) == ["cats", "cats", "dogs"]
    assert one(spark, text.ts_rank(words, ["cats", "mice"])) == pytest.approx(0.1 * 1.25 / 1.64493406685 / 2)
    assert one(spark, text.ts_rank(words, [])) == 0.0
    assert one(spark, text.or_query(F.lit("What's up, doc?"))) == "What | s | up | doc"


def test_json_in_answers(spark):
    answer = 'noise <think>{"no": 1}</think> ```json\n{"a": {"b": [1]}} trailing```'
    assert one(spark, text.first_json_object("v"), v=answer) == '{"a": {"b": [1]}}'
    assert one(spark, text.first_json_object("v"), v="{broken") is None
    for answer, want in {
        'a {odd} then {"x": "}{", "y": "\\"}"} {"z": 1}': '{"x": "}{", "y": "\\"}"}', '{"a": 1': None, '{ {"b": {"c": []}}': '{"b": {"c": []}}', "": None, 'say "{ {"k": null}': '{"k": null}', "[1, 2]": None, '[{"q": 1}]': '{"q": 1}',
    }.items():
        assert one(spark, text.first_json_object("v"), v=answer) == want, answer


def test_cosine(spark):
    v = vectors.literal([1.0, 0.0])
    assert one(spark, vectors.cosine(v, vectors.literal([1.0, 1.0]))) == pytest.approx(0.5**0.5)
    assert one(spark, vectors.cosine(v, vectors.literal([0.0, 0.0]))) is None
    embedded = one(spark, vectors.hashing_embedder(16)("v"), v="some words")
    assert sum(x * x for x in embedded) == pytest.approx(1, abs=1e-5)
