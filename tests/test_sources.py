"""Formats, chunks, dumps and the outbox."""

import pytest
from pyspark.sql import functions as F

from quadloom.operators import quads
from quadloom.operators.store import Store
from quadloom.schemas import OUTBOX, QUADS
from quadloom.sources import chunking, formats
from quadloom.streaming import job_states, outbox


@pytest.mark.parametrize(
    ("kind", "url", "head", "expected"),
    [("Text/HTML; charset=x", "http://a/b.pdf", b"", "html"), ("image/tiff", None, b"", "image"), (None, "http://a/b.PDF?x=1", b"", "pdf"), (None, "http://a/b", b"%PDF-1.7", "pdf"), (None, "http://a/b", b"<html>", "text"), (None, None, b"plain", "text")],
)
def test_formats(spark, kind, url, head, expected):
    df = spark.createDataFrame([(kind, url, head)], "k string, u string, d binary")
    assert df.select(formats.detect_format(F.col("k"), F.col("u"), F.col("d")).alias("f")).first().f == expected


def test_parsers(spark):
    html = b"<html><head><title>T</title><script>x()</script></head><body><nav>menu</nav><article><h2>Head</h2><p>Body <b>text</b></p></article></body></html>"
    rows = [(1, "html", html), (2, "csv", b"entity,value\ncold,1\nwarm,2\n"), (3, "json", b'{"a": [1]}'), (4, "pdf", b"%PDF"), (5, "text", b"\xff"), (6, "text", b"  "), (7, "text", None)]
    got = {r.id: r for r in formats.parse(spark.createDataFrame(rows, "id int, format string, data binary")).collect()}
    assert (got[1].text, got[1].title) == ("Head\nBody\ntext", "T")
    assert got[2].text == "entity: cold\nvalue: 1\n\nentity: warm\nvalue: 2"
    assert got[3].text == '{\n  "a": [\n    1\n  ]\n}'
    assert got[4].error == "no parser for pdf" and got[5].text is None and "utf-8" in got[5].error and got[6].error == "empty text" and got[7].error == "no data"


@pytest.mark.parametrize(("url", "safe"), [("https://example.com/x", True), ("http://localhost/x", False), ("http://10.0.0.1/", False), ("http://127.0.0.1:80/", False), ("ftp://example.com", False), ("http://[::1]/", False), ("http://8.8.8.8/", True), (None, False)])
def test_urls(spark, url, safe):
    assert spark.createDataFrame([(url,)], "u string").select(formats.url_is_safe("u").alias("x")).first().x is safe


def test_lists(spark):
    df = spark.createDataFrame([('["a", "b"]',), (" a , b,",), (None,)], "t string")
    assert [r.x for r in df.select(formats.string_list("t").alias("x")).collect()] == [["a", "b"], ["a", "b"], []]


def test_files_and_lists(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.md").write_text("# hello")
    (tmp_path / "in" / "b.bin").write_text("no")
    (tmp_path / "urls.txt").write_text("# note\n\nhttp://x/1\n")
    assert [r.text for r in formats.parse(formats.read_files(spark, str(tmp_path / "in"))).collect()] == ["# hello"]
    assert [r.url for r in formats.read_url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["http://x/1"]


def test_markdown_chunks():
    text = "# One\nintro\n## Two\n" + "word " * 300 + "\n```\n# not a heading\n```\n# Three\nend"
    got = chunking.chunks_of(text, size=400, overlap=40)
    assert [c["section_header"] for c in got][0] == "One" and got[-1]["section_header"] == "Three"
    assert {c["section_header"] for c in got} == {"One", "One > Two", "Three"}
    assert all(len(c["chunk_text"]) <= 400 for c in got)
    assert not chunking.is_markdown("```\n# x\n```\n") and not chunking.is_markdown("a" * 2001 + "\n# x")


def test_plain_chunks():
    assert [c["chunk_text"] for c in chunking.chunks_of("short text")] == ["short text"]
    text = "\n\n".join("sentence one here. " * 20 for _ in range(10))
    got = chunking.chunks_of(text, size=500, overlap=50)
    assert all(len(c["chunk_text"]) <= 500 for c in got)
    assert all(text[c["char_start"] :].startswith(c["chunk_text"][:50]) for c in got)
    assert [len(c["chunk_text"]) for c in chunking.chunks_of("x" * 1000, size=300, overlap=50)] == [300, 300, 300, 250]


def test_fixed_chunks(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "id int, text string")
    assert [r.chunk_text for r in chunking.fixed_chunks(df, size=4, overlap=1).orderBy("chunk_index").collect()] == ["abcd", "defg", "ghij"]


def _row(i, operation, h="h1", confidence=None, payload=None, graph="extracted"):
    return (i, h, operation, "urn:s", "urn:p", "urn:" + h, confidence, "claim", None, None, graph, payload, None, None)


def test_outbox(spark, tmp_path):
    store = spark.createDataFrame([], QUADS)
    rows = [_row(1, "insert", confidence=0.5), _row(2, "insert", confidence=0.9), _row(3, "update_confidence", confidence=0.7), _row(4, "insert_inferred", "h2", 0.4, '{"derived_from":["h1"],"inference_method":"inverse"}', "inferred"), _row(5, "insert", "h3", 0.6)]
    pending = spark.createDataFrame(rows, OUTBOX)
    once = outbox.apply(store, pending)
    state = lambda df: {(r.graph, r.triple_hash, r.confidence) for r in df.collect()}
    assert state(once) == {("extracted", "h1", 0.7), ("inferred", "h2", 0.4), ("extracted", "h3", 0.6)}
    assert state(outbox.apply(once, pending)) == state(once)
    gone = outbox.apply(once, spark.createDataFrame([_row(6, "retract_inference", "h1")], OUTBOX))
    assert state(gone) == {("extracted", "h1", 0.7), ("extracted", "h3", 0.6)}
    box, held = str(tmp_path / "box"), Store(spark, str(tmp_path / "quads")).create(store, buckets=2)
    outbox.stage(spark, pending.coalesce(1), box)
    for _ in range(2):
        outbox.drain(spark, box, held, str(tmp_path / "checkpoint")).awaitTermination()
    assert state(held.read()) == state(once)


def test_dumps(spark, tmp_path):
    rows = [("urn:g", "urn:s", "urn:p", 'a "b"', "literal"), ("urn:g", "urn:s", "urn:p", "urn:o", "iri")]
    df = quads.with_hash(spark.createDataFrame(rows, "graph string, s string, p string, o string, o_kind string"))
    formats.write_nquads(df, str(tmp_path / "nq"))
    assert {r.value for r in spark.read.text(str(tmp_path / "nq")).collect()} == {'<urn:s> <urn:p> "a \\"b\\"" <urn:g> .', "<urn:s> <urn:p> <urn:o> <urn:g> ."}


def test_job_states(spark, tmp_path):
    import datetime as dt

    at = str(tmp_path / "events")
    rows = [(1, 7, "accepted", dt.datetime(2024, 1, 1, 1)), (2, 7, "completed", dt.datetime(2024, 1, 1, 2)), (2, 7, "completed", dt.datetime(2024, 1, 1, 2))]
    spark.createDataFrame(rows, "event_id long, content_id long, status string, ts timestamp").write.parquet(at)
    events = spark.readStream.schema("event_id long, content_id long, status string, ts timestamp").parquet(at)
    job_states.latest_status(events).writeStream.format("memory").queryName("latest").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r)[:2] for r in spark.table("latest").collect()] == [(7, "completed")]


def test_claims(spark, tmp_path):
    from quadloom.operators import extraction

    one = '{"source_url": "u1", "source_type": "api", "extractor": "me", "knowledge": [{"subject": "a", "predicate": "is_a", "object": "b"}, {"subject": "e", "occurred_at": "2024-01-01", "properties": {"k": "v"}}]}'
    two = '[{"source_url": "u2", "knowledge": [{"uri": "x", "rdf_type": "T", "label": "X", "confidence": 0.4}]}, {"source_url": "u3", "knowledge": []}]'
    (tmp_path / "claims.jsonl").write_text(one + "\n" + two + "\n\nnot json\n")
    got = extraction.items_of(formats.read_claims(spark, str(tmp_path / "claims.jsonl")).drop("item_index")).orderBy("source_url", "shape").collect()
    assert [(r.source_url, r.extractor, r.shape, r.confidence, r.rejected) for r in got] == [("u1", "me", "event", 1.0, None), ("u1", "me", "triple", 0.8, None), ("u2", "api", "entity", 0.4, None)]


def test_dump_is_compressed(spark, tmp_path):
    lines = spark.range(20_000).selectExpr("'asserted' AS graph", "concat('http://knowledge.local/data/order_', id) AS s", "'http://knowledge.local/schema/contains' AS p", "concat('http://knowledge.local/data/part_', id % 99) AS o", "'iri' AS o_kind")
    formats.write_nquads(lines, str(tmp_path / "nq"))
    back = spark.read.text(str(tmp_path / "nq"))
    assert back.distinct().count() == 20_000
    assert back.where("value = '<http://knowledge.local/data/order_7> <http://knowledge.local/schema/contains> <http://knowledge.local/data/part_7> <asserted> .'").count() == 1
    assert sum(f.stat().st_size for f in (tmp_path / "nq").iterdir()) < 20_000 * 130 / 5


def test_views_shuffle_keys_not_terms(spark):
    from quadloom.plans import views

    plan = views.quads(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_suppkey#" in plan and "hashpartitioning(l_orderkey#" in plan
