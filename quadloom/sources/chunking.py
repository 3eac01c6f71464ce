"""Documents as chunks: by fixed steps, or along headings, paragraphs, lines, sentences and words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 4000, 200
# What text is split at, in this order of preference.
PLAIN = ("\n\n", "\n", ". ", " ", "")
HEADED = ("# ", "## ", "### ", *PLAIN)
CHUNK = "chunk_index int, chunk_text string, section_header string, char_start int, char_end int"


def fixed_chunks(documents: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of `size` characters, each beginning size - overlap after the one before; an empty text has none."""
    step = size - overlap
    n = F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / step)).cast("int")
    n = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(n, F.lit(1)))
    return documents.withColumn("chunk_index", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))).withColumn("chunk_text", F.substring(F.col(text), F.col("chunk_index") * step + 1, F.lit(size)))


def is_markdown(text: str) -> bool:
    """Whether a heading of level 1 to 3 stands in the first 2000 characters, outside fences."""
    return bool(re.search(r"^#{1,3}\s", re.sub(r"```.*?(```|\Z)", "", text[:2000], flags=re.S), re.M))


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = PLAIN) -> list[str]:
    """Pieces of at most `size` characters, cut at the first separator that occurs and, where pieces stay too long, at the next;
    neighbouring pieces are merged up to the size, and repeat up to `overlap` characters of the one before."""
    if len(text) <= size:
        return [text] if text.strip() else []
    at = next(k for k, s in enumerate(separators) if s == "" or s in text)
    mark, rest = separators[at], separators[at + 1 :]
    if not mark:
        # Windows that overlap as they are; the last one is that which reaches the end.
        return [w for i in range(0, len(text) - overlap, size - overlap) if (w := text[i : i + size].strip())]
    parts = re.split(f"(?={re.escape(mark)})", text)
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        piece = "".join(held).strip()
        if piece:
            out.append(piece)

    for part in filter(None, parts):
        if len(part) > size:
            flush()
            held = []
            out.extend(split_text(part, size, overlap, rest))
            continue
        if sum(map(len, held)) + len(part) > size:
            flush()
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(part) > size):
                held.pop(0)
        held.append(part)
    flush()
    return out


def sections(text: str) -> Iterator[tuple[str, str]]:
    """The path of headings (levels 1 to 3) and the text of each section, its heading included."""
    path, lines, fence = ["", "", ""], [], False
    for line in text.split("\n"):
        fence ^= line.lstrip().startswith("```")
        m = None if fence else re.match(r"(#{1,3})\s+(.*)", line)
        if m:
            if "".join(lines).strip():
                yield " > ".join(h for h in path if h), "\n".join(lines)
            level = len(m[1]) - 1
            path = [*path[:level], m[2].strip(), "", ""][:3]
            lines = []
        lines.append(line)
    if "".join(lines).strip():
        yield " > ".join(h for h in path if h), "\n".join(lines)


def chunks_of(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[dict]:
    """The chunks of one text with their section and place in it; places are looked for from a cursor that only moves on, then from the beginning.

    A text that fits is one chunk, blank or not."""
    if is_markdown(text):
        parts = [(head, piece) for head, body in sections(text) for piece in split_text(body, size, overlap)]
    elif len(text) <= size:
        parts = [(None, text)]
    else:
        parts = [(None, piece) for piece in split_text(text, size, overlap, HEADED)]
    out, cursor = [], 0
    for k, (head, piece) in enumerate(parts):
        at = text.find(piece[:100], cursor)
        if at < 0:
            at = text.find(piece[:100])
        begin = at if at >= 0 else cursor
        out.append({"chunk_index": k, "chunk_text": piece, "section_header": head, "char_start": begin, "char_end": begin + len(piece)})
        cursor = max(cursor, begin + 1)
    return out


def chunk_documents(documents: DataFrame, key: str = "content_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key and the chunks of each document, in one pass without a shuffle; a null text has none."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{key: i, **c} for i, t in zip(pdf[key], pdf[text], strict=True) for c in (() if t is None else chunks_of(t, size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "chunk_text", "section_header", "char_start", "char_end"])

    return documents.select(key, text).mapInPandas(run, f"`{key}` {kind}, {CHUNK}")
