"""Turtle files as triples: read by Spark as whole texts, so from any store that Spark reads, and parsed one file a row.

Prefixes and bases in both spellings, `a`, lists of objects and of predicates, typed and tagged literals, numbers, booleans, long strings, blank nodes
with and without properties, collections. Blank nodes are named after their file, so those of several files don't meet. A file that isn't Turtle gives one row
with its error, and no triples."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Namespaces that the syntax itself stands for.
RDF, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
TRIPLES = "file string, s string, p string, o string, o_kind string, datatype string, lang string, error string"

_TOKEN = re.compile(
    r"""(?P<skip>[ \t\r\n]+|\#[^\r\n]*)
    |(?P<iri><[^\x00-\x20<>"{}|^`]*>)
    |(?P<text>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*')
    |(?P<word>@[A-Za-z]+(?:-[A-Za-z0-9]+)*|(?:PREFIX|BASE|prefix|base)(?=[ \t<:]))
    |(?P<number>[+-]?(?:[0-9]+\.[0-9]*[eE][+-]?[0-9]+|\.?[0-9]+[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+))
    |(?P<blank>_:[\w](?:[\w.-]*[\w-])?)
    |(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?\#@%])(?:(?:[\w.:-]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?\#@%])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?\#@%]))?)?)
    |(?P<bare>true|false|a(?=[\s<\["':_]))
    |(?P<mark>\^\^|[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescaped(text: str) -> str:
    code = lambda m: chr(int(m[0][2:], 16)) if m[0][1] in "uU" else _ESCAPES[m[0][1]]
    return re.sub(r"\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[tbnrf\"'\\])", code, text)


class _Document:
    """One file's tokens, and the triples read so far."""

    def __init__(self, text: str, name: str):
        self.text, self.name, self.at, self.n = text, name, 0, 0
        self.prefixes: dict[str, str] = {}
        self.base, self.out = "", []
        self.next()

    def next(self) -> None:
        """Goes to the next token: its kind and text."""
        self.kind = "skip"
        while self.kind == "skip":
            if self.at >= len(self.text):
                self.kind, self.token = "end", ""
                return
            m = _TOKEN.match(self.text, self.at)
            if not m:
                raise self.wrong()
            self.kind, self.token, self.at = m.lastgroup, m[0], m.end()

    def wrong(self) -> ValueError:
        return ValueError(f"not Turtle in line {self.text.count(chr(10), 0, self.at) + 1}")

    def take(self, token: str) -> None:
        if self.token != token:
            raise self.wrong()
        self.next()

    def new_blank(self) -> tuple:
        self.n += 1
        return f"_:{self.name}.{self.n}", "blank", None, None

    def iri(self) -> str:
        kind, token = self.kind, self.token
        if kind == "iri":
            found = _unescaped(token[1:-1])
            if not re.match("[A-Za-z][A-Za-z0-9+.-]*:", found):
                from urllib.parse import urljoin

                found = urljoin(self.base, found) if found else self.base
        elif kind == "name":
            prefix, local = token.split(":", 1)
            if prefix not in self.prefixes:
                raise self.wrong()
            found = self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        else:
            raise self.wrong()
        self.next()
        return found

    def node(self) -> tuple:
        """A subject or object: value, kind, datatype, language."""
        kind, token = self.kind, self.token
        if kind == "blank":
            self.next()
            return f"_:{self.name}.{token[2:]}", "blank", None, None
        if token == "[" and kind == "mark":
            self.next()
            own = self.new_blank()
            if self.token != "]":
                self.properties(own)
            self.take("]")
            return own
        if token == "(" and kind == "mark":
            return self.collection()
        if kind == "text":
            cut = 3 if token[:3] in ('"""', "'''") else 1
            self.next()
            value = _unescaped(token[cut:-cut])
            if self.kind == "word" and self.token.startswith("@"):
                lang = self.token[1:]
                self.next()
                return value, "literal", RDF + "langString", lang
            if self.token == "^^":
                self.next()
                return value, "literal", self.iri(), None
            return value, "literal", XSD + "string", None
        if kind == "number":
            self.next()
            return token, "literal", XSD + ("double" if re.search("[eE]", token) else "decimal" if "." in token else "integer"), None
        if kind == "bare" and token != "a":
            self.next()
            return token, "literal", XSD + "boolean", None
        return self.iri(), "iri", None, None

    def collection(self) -> tuple:
        self.next()
        cells = []
        while self.token != ")":
            cells.append((self.new_blank(), self.node()))
        self.next()
        after = (RDF + "nil", "iri", None, None)
        for cell, item in reversed(cells):
            self.out += [(cell, RDF + "first", item), (cell, RDF + "rest", after)]
            after = cell
        return after

    def properties(self, subject: tuple) -> None:
        while True:
            if self.kind == "bare" and self.token == "a":
                self.next()
                predicate = RDF + "type"
            else:
                predicate = self.iri()
            while True:
                self.out.append((subject, predicate, self.node()))
                if self.token != ",":
                    break
                self.next()
            if self.token != ";":
                return
            while self.token == ";":
                self.next()
            if self.token in (".", "]") and self.kind == "mark":
                return

    def directive(self) -> None:
        word = self.token.lstrip("@").lower()
        dotted = self.token.startswith("@")
        self.next()
        if word == "prefix":
            if self.kind != "name" or not self.token.endswith(":"):
                raise self.wrong()
            name = self.token[:-1]
            self.next()
            self.prefixes[name] = self.iri()
        elif word == "base":
            self.base = self.iri()
        else:
            raise self.wrong()
        if dotted:
            self.take(".")

    def triples(self) -> list[tuple]:
        while self.kind != "end":
            if self.kind == "word":
                self.directive()
                continue
            bare = self.token == "["
            subject = self.node()
            if subject[1] == "literal":
                raise self.wrong()
            if not (bare and self.token == "."):
                self.properties(subject)
            self.take(".")
        return self.out


def parse_turtle(text: str, name: str = "") -> list[tuple]:
    """(s, p, o, o_kind, datatype, lang) of one text; a ValueError names the line that isn't Turtle."""
    return [(s[0], p, *o) for s, p, o in _Document(text, name).triples()]


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = TRIPLES.replace(" string", "").split(", ")
    for batch in batches:
        for file, text in zip(batch["file"], batch["text"], strict=True):
            try:
                rows = [(file, *t, None) for t in parse_turtle(text or "", re.sub(r"\W+", "_", file or ""))]
            except ValueError as e:
                rows = [(file, *[None] * 6, str(e))]
            for i in range(0, len(rows), 10_000):
                yield pd.DataFrame(rows[i : i + 10_000], columns=names)


def parsed(texts: DataFrame) -> DataFrame:
    """Triples of Turtle texts (file, text)."""
    return texts.select("file", "text").mapInPandas(_parsed, TRIPLES)


def read_turtle(spark: SparkSession, *paths: str, glob: str = "*.ttl") -> DataFrame:
    """file, s, p, o, o_kind (iri, literal or blank), datatype, lang and error of the files and folders at the paths."""
    texts = spark.read.option("pathGlobFilter", glob).text(list(paths), wholetext=True)
    return parsed(texts.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


def literal(value: Column | str, datatype: str | None = None) -> Column:
    """A text as a Turtle literal."""
    out = F.col(value).cast("string") if isinstance(value, str) else value
    for find, put in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(find), F.lit(put))
    return F.concat(F.lit('"'), out, F.lit('"' if datatype is None else f'"^^<{datatype}>'))
