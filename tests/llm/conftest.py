"""Documents that are out of the ordinary: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

import random

import pytest


def made_documents():
    r = random.Random(5)
    words = ["".join(r.choice("abcdeé.,") for _ in range(r.randint(1, 6))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = prose(120), prose(30)
    near = base.split()
    near[50] = "changed"
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, base), (7, base), (7, base), (8, " ".join(near)), (9, prose(40) + " " + passage + " " + prose(20)),
        (10, passage + "\n\n" + prose(15)), (11, "A " * 90), (12, prose(3000)), (13, "x" * 5000), (14, "日本語 のテキスト\n改行 ÀÉ"), (None, prose(25)), (15, passage), (15, prose(22)),
        (16, base.upper()), (17, "line one\nline one\n\nline two\nline one"), (18, "# $ % & *" * 20), (19, "<|endoftext|> and <s> ▁ marks"), (20, "".join(chr(c) for c in range(1, 130))), (-4, prose(60) + passage),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return made_documents()


@pytest.fixture(scope="session")
def documents(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, rank string, node string, bucket int, key int, tie int, own int, `a.b` string, _rank int"
    return spark.createDataFrame([(i, t, "en" if k % 2 else "fr", "s", len(t or ""), "r", "n", 1, 2, 3, 4, "d", 5) for k, (i, t) in enumerate(rows)], schema)


@pytest.fixture(scope="session")
def none(documents):
    return documents.limit(0)
