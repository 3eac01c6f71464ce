"""Tokenizers, packing and binary ids against the libraries themselves."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from quadloom.llm import binary_ids, packing, sentencepiece_ids, token_counts  # noqa: E402
from quadloom.llm.common import id_cache  # noqa: E402

BYTE, WORD, PIECE = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def library(path, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("path", "spaced"), [(BYTE, True), (WORD, False)])
def test_pieces_of_text_are_independent(path, spaced):
    r = random.Random(3)
    parts = [*"abZé9.,!?;:'$# \n\t\x1c\x85\xa0", "  ", "'s", "'ll", " ", "́", "²", "Σ", "<|endoftext|>", "日", "İ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in id_cache(path, spaced).ids(texts)]
    assert got == library(path, texts)


@pytest.mark.parametrize("often", [1, 8])
def test_token_counts(documents, rows, often):
    got = token_counts.token_counts(documents, BYTE, often=often).collect()
    expected = [(i, len((t or "").encode()), len(ids)) for (i, t), ids in zip(rows, library(BYTE, [t for _, t in rows]), strict=True)]
    assert Counter(map(tuple, got)) == Counter(expected)


def test_steps_of_places_come_back():
    lists = [[0, 0, 3], [700, 701, 5000], [255], [254, 510]]
    data, ends = token_counts._steps(*token_counts._flat(lists))
    begins = np.concatenate([[0], ends[:-1]])
    for own, a, b in zip(lists, begins, ends, strict=True):
        step = data[a:b].astype(int)
        assert np.cumsum(step)[step != 255].tolist() == own


def test_packing(documents, rows):
    got = packing.pack_documents(documents, WORD, size=64).collect()
    pieces = []
    for (i, _), ids in zip(rows, library(WORD, [t for _, t in rows]), strict=True):
        ids = [*ids, 0]
        pieces += [(i, k // 64, k, len(ids[k : k + 64]), crc(ids[k : k + 64])) for k in range(0, len(ids), 64)]
    assert Counter(tuple(r)[:5] for r in got) == Counter(pieces)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by_sequence) <= -(-sum(p[3] for p in pieces) // 64) + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_plans_use_every_piece_once(counts):
    plan = packing.plan_packing(counts, 40)
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 40
        used.update({k: v * times for k, v in Counter(pattern).items()})
    assert used == Counter(counts)
    total = sum(k * v for k, v in counts.items())
    assert sum(t for _, t in plan) <= max(1, 2 * total // 40 + 1)


def test_fills_need_as_many_pieces_as_there_are():
    assert packing._Counts({20: 1, 12: 1, 8: 1}, 40).fill(20) == (12, 8)
    assert packing._Counts({20: 2, 12: 1, 8: 1}, 40).fill(20) == (20,)
    assert packing._Counts({30: 1, 5: 1, 6: 1, 4: 1}, 40).fill(30) == (6, 4)
    assert packing._Counts({30: 1, 5: 1}, 40).fill(30) is None
    counts = {8: 1, 14: 2, 4: 2, 21: 2, 24: 1, 20: 2}
    plan = packing.plan_packing(counts, 40)
    assert sum(t for _, t in plan) == 4
    assert sum((Counter({k: t * n for k, n in Counter(p).items()}) for p, t in plan), Counter()) == Counter(counts)


@pytest.mark.parametrize("width", [1, 3, 13, 16, 17])
def test_bits_come_back(width):
    ids = np.random.default_rng(1).integers(0, 1 << width, 1000)
    packed = binary_ids.pack_bits(ids, width)
    assert len(packed) == -(-1000 * width // 8)
    assert binary_ids.unpack_bits(packed, width, 0, 1000).tolist() == ids.tolist()
    assert binary_ids.unpack_bits(packed, width, 333, 77).tolist() == ids[333:410].tolist()


def test_binary_ids(spark, documents, rows, tmp_path):
    at = str(tmp_path / "ids")
    got = binary_ids.binary_ids(documents, BYTE, at, block_ids=500).orderBy("start").collect()
    encoded = [(i, [*ids, 0]) for (i, _), ids in zip(rows, library(BYTE, [t for _, t in rows]), strict=True)]
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), crc(x)) for i, x in encoded)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert binary_ids.document_ids(spark, at, 12) == dict(encoded)[12]
    with pytest.raises(KeyError):
        binary_ids.document_ids(spark, at, 999)


def test_sentencepiece(documents, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    encoded = sentencepiece_ids.encode(documents, PIECE)
    expected = [(i, sp.encode(t or "")) for i, t in rows]
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter((i, tuple(x)) for i, x in expected)
    texts = Counter((i, (t or "").replace("▁", " ")) for i, t in rows)
    assert Counter(map(tuple, sentencepiece_ids.decode(encoded, PIECE).collect())) == texts


def test_empty_tables(none):
    assert token_counts.token_counts(none, BYTE).count() == 0
    assert packing.pack_documents(none, WORD).count() == 0
    assert binary_ids.binary_ids(none, BYTE).count() == 0
    assert sentencepiece_ids.encode(none, PIECE).count() == 0
