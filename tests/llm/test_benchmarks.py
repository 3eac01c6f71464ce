"""Decontamination, the filter audit and vector codes against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadloom.llm import decontamination, filter_audit, vector_codes

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(t):
    return [(m[0], m.start(), m.end()) for m in ITEM_WORD.finditer((t or "").translate(LOW))]


def plain_contamination(docs, items, window=10):
    grams = defaultdict(set)
    for i, t in items:
        w = [x[0] for x in item_words(t)]
        for k in range(max(1, len(w) - window + 1) if w else 0):
            grams[tuple(w[k : k + window])].add(i)
    out = Counter()
    for d, t in docs:
        found = item_words(t)
        w = [x[0] for x in found]
        hit, ids = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit |= set(range(k, k + n))
                    ids |= {str(i) for i in grams[g] if i is not None}
        spans = []
        for k in sorted(hit):
            if k - 1 in hit and spans:
                spans[-1] = (spans[-1][0], found[k][2])
            else:
                spans.append((found[k][1], found[k][2]))
        out[d, len(w), len(hit), tuple(sorted(ids)), tuple(spans)] += 1
    return out


def contaminated(spark, r, n=60):
    words = ["Ab", "c", "dé", "E9", "日本", "f", "g-h", "i'j", "k", "l"]
    prose = lambda k: "".join(r.choice(words) + r.choice([" ", "  ", ", ", "\n", "_"]) for _ in range(k))
    items = [(i, prose(r.choice([1, 3, 9, 10, 11, 14, 25]))) for i in range(30)] + [(None, prose(12)), (7, None), (8, ""), (9, "?!"), (3, prose(10)), (3, prose(10))]
    docs = [(k, prose(r.randint(0, 40)) + (r.choice(items)[1] or "").swapcase() + prose(r.randint(0, 40))) for k in range(n)]
    docs += [(None, items[5][1]), (1, None), (2, ""), (3, "x"), (3, "x"), (4, items[0][1] * 3)]
    as_items = spark.createDataFrame([(i, t, "d") for i, t in items], "item_id long, text string, gram string")
    as_docs = spark.createDataFrame([(i, t, "i", 1) for i, t in docs], "doc_id long, text string, items string, own int")
    return docs, items, as_docs, as_items


def as_rows(df):
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(map(tuple, r.spans))) for r in df.collect())


@pytest.mark.parametrize("window", [10, 3])
def test_contamination(spark, window):
    docs, items, as_docs, as_items = contaminated(spark, random.Random(window))
    want = plain_contamination(docs, items, window)
    assert as_rows(decontamination.contamination(as_docs, as_items, window=window)) == want
    # Several automata, one after the other.
    assert as_rows(decontamination.contamination(as_docs, as_items, window=window, most_words=400)) == want


def test_contamination_of_pieces(monkeypatch):
    r = random.Random(2)
    text = " ".join(r.choice("abcd") for _ in range(3000)).encode()
    grams = [(" ".join(r.choice("abcd") for _ in range(k)), str(k)) for k in (1, 2, 4, 5, 6) for _ in range(3)]
    found = decontamination.Automaton(grams)
    whole = found.scan(text)
    for size in (1, 7, 50):
        monkeypatch.setattr(decontamination, "SEGMENT", size)
        assert found.scan(text) == whole


def test_contamination_odd(spark, documents, none):
    items = spark.createDataFrame([(1, "two words")], "item_id int, text string")
    got = decontamination.contamination(documents, items)
    assert got.count() == documents.count()
    assert [tuple(r)[:4] for r in got.where("n_hit > 0").collect()] == [(5, 2, 2, ["1"])]
    assert decontamination.contamination(documents, items.limit(0)).where("n_hit > 0 OR size(items) > 0").isEmpty()
    assert decontamination.contamination(none, items).isEmpty()
    left = decontamination.decontaminated(documents, items)
    assert left.columns == documents.columns and left.count() == documents.count() - 1
    assert decontamination.decontaminated(documents, items, most=1.0).count() == documents.count()


def test_contamination_of_a_long_text(spark):
    text = "filler words, " * 400_000 + "The Question is: what?" + " more" * 10
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(5, "the question is what")], "item_id long, text string")
    r = decontamination.contamination(docs, items).first()
    assert (r.n_words, r.n_hit, r["items"]) == (800_014, 4, ["5"])
    assert text[r.spans[0].start : r.spans[0].end] == "The Question is: what"


def plain_failures(docs):
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    out = []
    for d, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        e = d is not None and first[t] < d
        out.append((d, lang or "", {x for x, bad in zip("ABCDE", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), e], strict=True) if bad}))
    return out


def plain_audit(docs, labels):
    rows = plain_failures(docs)
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in range(2))
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in rows}:
        own = [(d, f) for d, p, f in rows if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(d, f) for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                shapley[part, x] += len(gone)
                failing = sum(x in f for _, f in own)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(f == {x} for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark):
    r = random.Random(3)
    words = ["alpha", "BETA", "c", "d|", "é", "f#"]
    prose = lambda n, k: " ".join(r.choice(words[:k]) + (str(i) if r.random() < 0.6 else "") for i in range(n))
    some = [prose(r.choice([0, 5, 199, 200, 260]), r.choice([1, 2, 3, 6])) for _ in range(25)] + [None, "", " \n", "日本 " * 210]
    docs = [(r.choice([None, *range(40)]), r.choice(some), r.choice([None, "", "en", "de"])) for _ in range(150)]
    labels = [(r.choice([None, *range(40)]), r.choice([0, 1, None]), r.choice([0, 1])) for _ in range(40)]
    as_docs = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, part int, digest string")
    as_labels = spark.createDataFrame([(*x, "p") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.filter_audit(as_docs, as_labels).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == plain_audit(docs, labels)
    assert len(got) == 3 * 600
    assert filter_audit.filter_audit(as_docs.limit(0), as_labels).isEmpty()
    assert filter_audit.filter_audit(as_docs, as_labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_filter_audit_of_a_long_text(spark, monkeypatch):
    text = "many words here and there " * 200_000
    docs = spark.createDataFrame([(1, text, "en"), (2, text, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    got = {(r.filter_order, r.step): r for r in filter_audit.filter_audit(docs, labels).collect()}
    assert (got["BACDE", 1].removed, got["EABCD", 1].removed, got["EABCD", 1].good_lost, got["EABCD", 3].removed, got["BACDE", 5].redundant) == (2, 1, 1, 1, 1)
    for size in (1, 5, 64):
        monkeypatch.setattr(filter_audit, "SEGMENT", size)
        assert filter_audit._words(b"ab a  b\tab\nc" * 9) == (37, 5)


def test_more_parts_than_a_chunk(spark):
    rows = [(f"p{k}", k % 32, k + 1, k % 3, 0) for k in range(200)]
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(spark.createDataFrame(rows, "part string, bits int, n long, good long, toxic long")).collect()}
    assert len(got) == 200 * 600
    for part, bits, n, good, _ in rows[::17]:
        assert sum(got[part, "CABDE", s].removed for s in range(1, 6)) == (n if bits else 0)
        assert got[part, "CABDE", 1].good_lost == (good if bits & 4 else 0)


def plain_codes(vectors, parts=8, entries=16, rounds=6):
    kept = sorted((v, [math.floor(4096 * x) for x in e], label) for v, e, label in vectors if e and all(x is not None and math.isfinite(x) for x in e))
    size = len(kept[0][1]) // parts
    cut = lambda e, p: e[p * size : (p + 1) * size]
    books = [[cut(e, p) for _, e, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for _, e, _ in kept:
                held[near(cut(e, p), books[p])[1]].append(cut(e, p))
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k], strict=True)] if k in held else e for k, e in enumerate(books[p])]
    found = [(v, [near(cut(e, p), books[p]) for p in range(parts)], label) for v, e, label in kept]
    errors = Counter()
    for _, ns, label in found:
        errors[label] += sum(d for d, _ in ns)
    listed = ",".join(str(c) for b in books for e in b for c in e)
    return Counter((v, bytes(k for _, k in ns).hex(), sum(d for d, _ in ns), errors[label]) for v, ns, label in found), listed


@pytest.mark.parametrize(("n", "size"), [(150, 16), (9, 24), (1, 8)])
def test_vector_codes(spark, n, size):
    r = random.Random(n)
    few = lambda: [r.choice([0.0, 0.25, -0.1, 1.0, r.gauss(0, 1)]) for _ in range(size)]
    vectors = [(v, few(), r.choice([None, 1, 2])) for v in range(3, n + 3)]
    vectors += [(0, None, 1), (1, [], 1), (2, [None, *few()[1:]], 2), (900, [math.nan, *few()[1:]], 1), (901, [math.inf, *few()[1:]], 1), (vectors[0])]
    df = spark.createDataFrame([(*v, "e", 1) for v in vectors], "vec_id long, embedding array<double>, label int, error string, code int")
    want, listed = plain_codes(vectors)
    for bits in (3, 1):
        codes, books = vector_codes.compressed(df, bits=bits)
        assert Counter((r.vec_id, bytes(r.code).hex(), r.error, r.label_error) for r in codes.collect()) == want
        assert vector_codes.listed(books) == listed
    back = {r.vec_id: r.embedding for r in vector_codes.decode(codes, books).collect()}
    assert all(len(back[v[0]]) == size for v in vectors[:n])


def test_vector_codes_odd(spark, monkeypatch):
    schema = "vec_id long, embedding array<float>, label string"
    assert vector_codes.compressed(spark.createDataFrame([], schema))[0].isEmpty()
    rows = [(1, [1.0] * 8, "a"), (2, [2.0] * 9, "a"), (3, [2.0] * 16, "a"), (None, [3e38] * 8, None), (4, [-3e38] * 8, None), (4, [0.5] * 8, "b")]
    codes, books = vector_codes.compressed(spark.createDataFrame(rows, schema))
    assert sorted((r.vec_id or -1, r.error) for r in codes.collect()) == [(-1, 0), (1, 0), (4, 0), (4, 0)] and books.shape == (8, 4, 1)
    rows = [(i, [float(i % 7), *[0.0] * 7], None if i % 3 == 0 else f"l{i % 5}") for i in range(300)]
    df = spark.createDataFrame(rows, schema)
    wide = Counter(map(tuple, vector_codes.compressed(df, entries=2)[0].select("vec_id", "error", "label_error").collect()))
    monkeypatch.setattr(vector_codes, "SMALL_LABELS", 2)
    assert Counter(map(tuple, vector_codes.compressed(df, entries=2)[0].select("vec_id", "error", "label_error").collect())) == wide


def test_bounds_hold_and_refining_is_rare():
    r = np.random.default_rng(1)
    book, x = r.integers(-2000, 2000, (16, 8)), r.integers(-2500, 2500, (500, 8))
    found = vector_codes.Filter(book, 4)
    lower, upper = found.bounds(x)
    d = ((x[:, None] - book) ** 2).sum(axis=2)
    assert (lower <= d).all() and (d <= upper).all()
    assert (lower <= upper.min(axis=1)[:, None]).mean() < 0.3
    at, least = found.nearest(x)
    assert (at == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()


def test_digest_of_no_items(spark):
    assert spark.range(1).select(F.sha2(F.array_join(F.array().cast("array<string>"), ",").cast("binary"), 256)).first()[0] == hashlib.sha256(b"").hexdigest()
