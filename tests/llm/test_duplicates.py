"""Near duplicates and repeated passages against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from quadloom.llm import near_dup, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (sets[a] or sets[b]) and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return [(i, len(sets[a]), least.get(root(a)) if sets[a] else i) for a, (i, _) in enumerate(rows)]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_components(documents, rows, k, percent):
    got = near_dup.near_duplicates(documents, shingle_words=k, percent=percent, bands=40).collect()
    expected = brute_components(rows, k, percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(expected)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chains_and_stars_of_near_copies(spark):
    r = np.random.default_rng(7)
    rows = []
    for chain in range(6):
        w = [f"w{x}" for x in r.integers(0, 5000, 80)]
        for _ in range(15):
            rows.append((len(rows), " ".join(w)))
            w = [*w]
            for _ in range(2):
                w[r.integers(0, 80)] = f"e{r.integers(0, 10**6)}"
    base = [f"b{x}" for x in range(100)]
    for _ in range(60):
        w = [*base]
        w[r.integers(0, 100)] = f"s{r.integers(0, 10**6)}"
        rows.append((len(rows), " ".join(w)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == Counter(brute_components(rows, 3, 85))


def test_one_document_of_each_group_stays(documents, rows):
    got = near_dup.without_near_duplicates(documents, shingle_words=3, percent=85)
    assert got.columns == documents.columns
    gone = {i for i, _, c in brute_components(rows, 3, 85) if i != c}
    assert Counter(r.doc_id for r in got.select("doc_id").collect()) == Counter(i for i, _ in rows if i not in gone)


def test_signatures_estimate_likeness():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], r.integers(0, 1 << 63, 200, dtype=np.uint64)])
    same = (near_dup.signature(a, 512) == near_dup.signature(b, 512)).mean()
    assert abs(same - 800 / 1200) < 0.08


def brute_repeats(rows, k=20):
    order = sorted({(i is None, i or 0, tuple(WORD.findall(t or ""))) for i, t in rows})
    seen, out = {}, {}
    by_id = {}
    for absent, i, words in order:
        by_id.setdefault((absent, i), []).append(words)
    for key, texts in by_id.items():
        assert len(texts) < 2 or sum(len(t) >= k for t in texts) < 2 or key == (False, 15)
        for words in texts:
            gone = np.zeros(len(words), bool)
            for s in range(len(words) - k + 1):
                w = words[s : s + k]
                if w in seen:
                    gone[s : s + k] = True
                else:
                    seen[w] = key
            out[key, words] = gone
    return out


def test_repeated_words(documents, rows):
    expected = brute_repeats(rows)
    want = Counter()
    for i, t in rows:
        words = tuple(WORD.findall(t or ""))
        gone = expected[(i is None, i or 0), words]
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        want[i, len(words), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert Counter(map(tuple, substring_dedup.repeated_words(documents).collect())) == want


def test_texts_without_repeats(documents, rows):
    got = substring_dedup.without_repeats(documents)
    assert got.columns == documents.columns
    expected = brute_repeats(rows)
    want = Counter()
    for i, t in rows:
        words = tuple(WORD.findall(t or ""))
        gone = expected[(i is None, i or 0), words]
        want[i, t if not gone.any() else " ".join(w for w, g in zip(words, gone, strict=True) if not g)] += 1
    assert Counter(map(tuple, got.select("doc_id", "text").collect())) == want


def test_empty_tables(none):
    assert near_dup.near_duplicates(none).count() == 0
    assert near_dup.without_near_duplicates(none).count() == 0
    assert substring_dedup.repeated_words(none).count() == 0
    assert substring_dedup.without_repeats(none).count() == 0


def test_large_buckets_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 1)
    monkeypatch.setattr(near_dup, "TILE_BYTES", 5 * 100 * 8)
    r = np.random.default_rng(9)
    base, rows = [f"b{x}" for x in range(100)], []
    for k in range(70):
        w = [*base]
        for _ in range(1 + k % 6):
            w[r.integers(0, 100)] = f"s{r.integers(0, 10**6)}"
        rows.append((len(rows), " ".join(w)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=40, star_rounds=1).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == Counter(brute_components(rows, 3, 85))


def test_heads_that_fit_no_other_member(spark):
    w = [f"s4_{i}" for i in range(100)]
    rows = [(0, " ".join(w + [f"x4_{i}" for i in range(40)])), (1, " ".join(w)), (2, " ".join([*w[:-1], "other"]))]
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # so that the one bucket's head is the long text
    try:
        got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=1, rows=1).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == Counter(brute_components(rows, 3, 85))
