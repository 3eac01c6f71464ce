"""The pipeline's stages, each on what the one before it kept."""

import sys
from pathlib import Path

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quadloom.llm.common import written  # noqa: E402

sys.path.insert(0, str(Path(__file__).parent))

from test_duplicates import brute_components, brute_repeats, WORD  # noqa: E402
from test_texts import base_spans  # noqa: E402


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
        seen.append(docs)
    start, language, near, passages, safe, packed = ([tuple(r) for r in x.select(*("doc_id", "text") if "text" in x.columns else ("doc_id", "length", "sequence_id")).collect()] for x in seen)
    assert all(x.columns == seen[0].columns for x in seen[:5])
    assert set(language) <= set(start) and len(language) >= 0.98 * len(start)
    gone = {i for i, _, c in brute_components(language, 5, 80) if i != c}
    assert sorted(near) == sorted(x for x in language if x[0] not in gone)
    repeats = brute_repeats(near)
    want = []
    for i, t in near:
        words = tuple(WORD.findall(t))
        cut = repeats[(False, i), words]
        text = " ".join(w for w, g in zip(words, cut, strict=True) if not g) if cut.any() else t
        want += [(i, text)] if text else []
    assert sorted(passages) == sorted(want)
    assert [i for i, _ in sorted(safe)] == [i for i, _ in sorted(passages)]
    assert not any(base_spans(t) for _, t in safe)
    assert {i for i, *_ in packed} == {i for i, _ in safe}


@pytest.mark.parametrize("without", [(), ("n_chars",), ("source", "a.b")])
def test_odd_documents(spark, documents, rows, without):
    """Nulls, empty and long texts, repeated rows and clashing names go through every stage; extra columns stay until the last."""
    docs = documents.select(*(f"`{c}`" for c in documents.columns if c not in without))
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, ""), "stage")
        if k < 4:
            assert docs.columns == columns
            kept.append(docs.select("doc_id", "text", *(["n_chars"] if "n_chars" in columns else [])).collect())
    assert {1, 2, 3, 18}.isdisjoint(r.doc_id for r in kept[0])
    # Both rows of a repeated document stay as one document's; its near copies go.
    assert [r.doc_id for r in kept[1] if r.doc_id in (6, 7, 8)] == [6]
    assert all(r.text for r in kept[2])
    if "n_chars" in columns:
        assert all(r.n_chars == len(r.text) for r in kept[3])
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in kept[3]}


def test_no_documents(spark, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), "stage")
        assert docs.isEmpty()
