"""Documents of several formats as text: detection by declared type, URL and first bytes; parsers by format."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats by declared type, by the URL's ending, and by the first bytes (hexadecimal), in order.
BY_TYPE = {"application/pdf": "pdf", "text/html": "html", "text/csv": "csv", "application/json": "json", "text/plain": "text"}
BY_ENDING = {".pdf": "pdf", ".html": "html", ".htm": "html", ".csv": "csv", ".json": "json", ".txt": "text", ".md": "text", ".png": "image", ".jpg": "image", ".jpeg": "image", ".gif": "image", ".webp": "image"}
BY_BYTES = {"25504446": "pdf", "89504E47": "image", "FFD8FF": "image", "474946383761": "image", "474946383961": "image"}

MOST_BYTES = 50 * 1024 * 1024
PARSED = "text string, title string, error string"


def detect_format(content_type: Column, url: Column, data: Column) -> Column:
    """The declared type wins, images by their prefix, then the URL's ending, then the first bytes; else text."""
    kind = F.lower(F.trim(F.split(content_type, ";")[0]))
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    head = F.upper(F.hex(F.substring(data, 1, 6)))
    out = F.when(kind.startswith("image/"), "image")
    for k, v in BY_TYPE.items():
        out = out.when(kind == k, v)
    for k, v in BY_ENDING.items():
        out = out.when(path.endswith(k), v)
    for k, v in BY_BYTES.items():
        out = out.when(head.startswith(k), v)
    return out.otherwise("text")


def text_of_html(html: str) -> tuple[str, str]:
    """The main text, a line for each piece of it, and the title; scripts, styles, navigation and the page's frame are left out."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.skip, self.in_title, self.article, self.all, self.main, self.title = 0, False, 0, [], [], ""

        def handle_starttag(self, tag, attrs):
            self.skip += tag in SKIPPED
            self.article += tag in ("article", "main")
            self.in_title = tag == "title"

        def handle_endtag(self, tag):
            self.skip -= tag in SKIPPED and self.skip > 0
            self.article -= tag in ("article", "main") and self.article > 0
            self.in_title = False

        def handle_data(self, data):
            if self.in_title:
                self.title += data
            elif not self.skip and (piece := data.strip()):
                self.all.append(piece)
                if self.article:
                    self.main.append(piece)

    r = Reader()
    r.feed(html)
    r.close()
    return "\n".join(r.main or r.all), r.title.strip()


SKIPPED = ("script", "style", "nav", "header", "footer", "aside", "noscript", "template")


def text_of_csv(data: str) -> str:
    """Each row as `name: value` lines, rows apart by an empty line."""
    import csv
    import io

    return "\n\n".join("\n".join(f"{k}: {v}" for k, v in row.items()) for row in csv.DictReader(io.StringIO(data)))


def text_of_json(data: str) -> str:
    import json

    return json.dumps(json.loads(data), indent=2, ensure_ascii=False)


def _structured(data: str) -> str:
    try:
        return text_of_json(data)
    except ValueError:
        return text_of_csv(data)


#: Parsers by format, of the decoded text; the last one registered for a format counts. PDF and images have none here.
PARSERS: dict[str, Callable[[str], str | tuple[str, str]]] = {"text": str, "html": text_of_html, "csv": text_of_csv, "json": _structured}


def register(format_: str, parser: Callable[[str], str | tuple[str, str]]) -> None:
    PARSERS[format_] = parser


def _parse(parsers: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(kind: str, data: bytes | None) -> tuple:
            if data is None or len(data) > MOST_BYTES:
                return None, None, "no data" if data is None else "too large"
            if kind not in parsers:
                return None, None, f"no parser for {kind}"
            try:
                out = parsers[kind](data.decode("utf-8", "strict" if kind == "text" else "replace"))
            except (ValueError, UnicodeError) as e:
                return None, None, str(e)[:200]
            text, title = out if isinstance(out, tuple) else (out, "")
            return (text, title, None) if text.strip() else (None, None, "empty text")

        for pdf in batches:
            rows = [one(k, d) for k, d in zip(pdf.pop("format"), pdf.pop("data"), strict=True)]
            yield pdf.assign(text=[r[0] for r in rows], title=[r[1] for r in rows], error=[r[2] for r in rows])

    return run


def parse(files: DataFrame) -> DataFrame:
    """text, title and error of each file (format, data: binary, any others); what can't be parsed stays as a row with its error."""
    others = [f for f in files.schema if f.name not in ("format", "data")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), PARSED])
    return files.select(*(f.name for f in others), "format", "data").mapInPandas(_parse(dict(PARSERS)), schema)


def read_files(spark: SparkSession, at: str, endings: tuple[str, ...] = ("txt", "md", "html", "json", "csv")) -> DataFrame:
    """All files below a folder with one of the endings: path, format, data."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(endings) + "}").load(at)
    return files.select("path", detect_format(F.lit(None).cast("string"), F.regexp_replace("path", "^(file|hdfs|s3a?):/*", "file://x/"), F.col("content")).alias("format"), F.col("content").alias("data"))


def read_url_list(spark: SparkSession, at: str) -> DataFrame:
    """The lines of a list, without empty ones and comments."""
    return spark.read.text(at).select(F.trim("value").alias("url")).where("url <> '' AND NOT url LIKE '#%'")


def read_requests(spark: SparkSession, at: str, schema: str, *, whole: bool = False) -> DataFrame:
    """Requests as JSON lines, or (whole) as files of one request or array each over any number of lines; what isn't one has its text in _corrupt_record."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").option("multiLine", whole).json(at)


_ITEMS = "array<struct<source_url:string, source_type:string, extractor:string, knowledge:array<struct<subject:string, predicate:string, object:string, uri:string, rdf_type:string, label:string, occurred_at:string, properties:map<string,string>, confidence:double, knowledge_type:string>>>>"


def read_claims(spark: SparkSession, at: str) -> DataFrame:
    """Claims as JSON, a request or a list of requests on each line: a row for each knowledge item (item_index), its request's source
    beside the items as JSON (answer) that extraction.items_of() takes; a line that isn't JSON gives a row with its text as error alone."""
    lines = spark.read.text(at).where("trim(value) <> ''")
    bad = lines.where(F.try_parse_json("value").isNull()).select(F.col("value").alias("error"))
    requests = lines.where(F.try_parse_json("value").isNotNull()).select(F.explode(F.from_json("value", _ITEMS)).alias("r")).select("r.*")
    own = requests.where("knowledge IS NOT NULL").select("source_url", F.coalesce("source_type", F.lit("api")).alias("source_type"), F.coalesce("extractor", F.lit("api")).alias("extractor"), F.posexplode("knowledge").alias("item_index", "item"))
    own = own.select("source_url", "source_type", "extractor", F.to_json(F.struct(F.array("item").alias("items"))).alias("answer"), F.lit(None).cast("string").alias("error"))
    return own.unionByName(bad, allowMissingColumns=True)


def csv_lines(*columns: str) -> Column:
    """A row of columns as `name: value` lines."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in columns))


def string_list(c: Column | str) -> Column:
    """A list given as JSON, or else separated by commas; null or empty give an empty list."""
    c = F.col(c) if isinstance(c, str) else c
    split = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.from_json(F.when(F.trim(c).startswith("["), c), "array<string>"), split, F.array().cast("array<string>"))


def _is_safe(url: str | None) -> bool:
    import ipaddress
    from urllib.parse import urlsplit

    try:
        parts = urlsplit(url or "")
        host = parts.hostname or ""
    except ValueError:
        return False
    if parts.scheme not in ("http", "https") or not host or host == "localhost" or host.endswith(".localhost"):
        return False
    try:
        return ipaddress.ip_address(host).is_global
    except ValueError:
        return not re.fullmatch(r"[\d.]+|0x[\da-f]+", host)


def url_is_safe(url: Column | str) -> Column:
    """Whether a URL is http(s) and names no local, private or reserved address."""

    def safe(urls: pd.Series) -> pd.Series:
        return urls.map(_is_safe)

    return F.pandas_udf(safe, "boolean")(url)


def write_nquads(quads: DataFrame, at: str) -> None:
    """A dump, a line for each quad, in gzip files of a million lines at most: these are read by a task each, and lines repeat most of their terms."""
    from quadloom.functions.terms import term_text

    line = F.concat_ws(" ", F.concat(F.lit("<"), "s", F.lit(">")), F.concat(F.lit("<"), "p", F.lit(">")), term_text("o", F.col("o_kind") == "iri"), F.concat(F.lit("<"), "graph", F.lit(">")), F.lit("."))
    quads.select(line.alias("value")).write.option("maxRecordsPerFile", 1_000_000).text(at, compression="gzip")
