"""The recursive splitter and the HTML reader against plain versions, on random texts."""

import random
import re

import pytest

from quadloom.sources import chunking, formats


def plain_split(text, size, overlap, separators):
    """Pieces by the rules, from places alone: cut before each separator, long parts by the next one, merged greedily with a tail carried over."""
    if len(text) <= size:
        return [text] if text.strip() else []
    mark = next(s for s in separators if s == "" or s in text)
    rest = separators[separators.index(mark) + 1 :]
    if mark == "":
        ends = [size + k * (size - overlap) for k in range(len(text)) if k == 0 or size + (k - 1) * (size - overlap) < len(text)]
        return [w for e in ends if (w := text[e - size : e].strip())]
    else:
        cuts = [0] + [i for i in range(1, len(text)) if text.startswith(mark, i)] + [len(text)]
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
    out, window = [], []
    for part in parts:
        if len(part) > size:
            out += ["".join(window)] + plain_split(part, size, overlap, rest)
            window = []
        elif sum(map(len, window)) + len(part) <= size:
            window = [*window, part]
        else:
            out.append("".join(window))
            while window and (len("".join(window)) > overlap or len("".join(window)) + len(part) > size):
                window = window[1:]
            window = [*window, part]
    pieces = [x.strip() if x in ("".join(window), *out) else x for x in [*out, "".join(window)]]
    return [p for p in pieces if p]


def prose(r, n):
    return "".join(r.choice(["word ", "longerword ", "end. ", "\n", "\n\n", "## Head\n", "x" * r.randint(1, 40), "# ", "é"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(30))
def test_split(seed):
    r = random.Random(seed)
    text, size = prose(r, r.randint(1, 150)), r.choice([20, 50, 120])
    overlap = r.choice([0, 5, size // 3])
    for separators in (chunking.PLAIN, chunking.HEADED):
        got = chunking.split_text(text, size, overlap, separators)
        assert [p.strip() for p in got] == [p.strip() for p in plain_split(text, size, overlap, separators)]
        assert all(len(p) <= size and p in text for p in got)
        assert re.sub(r"\s", "", text) == "" or got


@pytest.mark.parametrize("seed", range(20))
def test_chunks_have_their_places(seed):
    r = random.Random(100 + seed)
    text = ("# Title\n" if seed % 2 else "") + prose(r, 120)
    got = chunking.chunks_of(text, 60, 10)
    assert [c["chunk_index"] for c in got] == list(range(len(got)))
    for c in got:
        assert text[c["char_start"] : c["char_end"]] == c["chunk_text"] or c["chunk_text"] in text
        assert c["char_end"] - c["char_start"] == len(c["chunk_text"])
    # Sections: the headings above each chunk, from the text alone.
    if seed % 2:
        assert got[0]["section_header"].startswith("Title")
    assert chunking.chunks_of("  \n ", 60, 10)[0]["chunk_text"] == "  \n "


def test_documents_without_text(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "a")], "content_id int, text string")
    assert sorted((r.content_id, r.chunk_text) for r in chunking.chunk_documents(docs).collect()) == [(2, ""), (3, " "), (4, "a")]


def test_html_of_random_pages():
    r = random.Random(5)
    for _ in range(50):
        want, body = [], ""
        for k in range(r.randint(0, 12)):
            tag = r.choice(["p", "div", "h1", "script", "style", "nav", "b"])
            body += f"<{tag}>piece {k} &amp; more</{tag}>\n"
            if tag not in ("script", "style", "nav"):
                want.append(f"piece {k} & more")
        main = r.random() < 0.5
        page = f"<html><head><title>T {r.randrange(9)}</title></head><body>{'<p>outside</p><article>' + body + '</article>' if main and want else body}</body></html>"
        text, title = formats.text_of_html(page)
        assert text == "\n".join(want) and title.startswith("T ")
