"""Secrets in texts, with DataFrame functions only: strong patterns, and weak parts of credentials that occur together.

Strong kinds (`assign`, `access`, `hex`) are reported wherever they match. Weak parts (`weak_id`: account names and
short access identifiers; `weak_secret`: tokens of 16 characters or more with letters and digits; `endpoint`:
URLs and host:port) are reported only where complementary parts start at most `scope` code points away in the same
document: an identifier needs a secret, a secret an identifier or an endpoint, an endpoint both; strong spans count
as parts too. This is an interval join over buckets of `scope` code points, with each bucket's first and
last start of a class instead of all its parts, so its rows grow with the number of parts and not with pairs.

Places are counted in code points, ends exclusive. Matches of a kind come leftmost first and don't overlap; weak spans
that overlap a strong one are left out. A null text counts as empty and has no spans; each row stands for itself, an empty table has no
rows, extra columns of any name take no part, and the time for a text grows with its length and its number of matches alone.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadloom.llm.common import whole_rows, written

SCOPE = 200
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
_NAME, _VALUE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+"
# Matches of a run of characters begin where the run does, so nothing is tried within runs.
PATTERNS = {
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "weak_id": r"""(?:AKIA|ASIA)[A-Z0-9]{4,}+|\b(?i:username|user|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}+""",
    "weak_secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+",
    "endpoint": r"""\bhttps?://[^\s"'<>]++|(?<![A-Za-z0-9.-])[A-Za-z0-9][A-Za-z0-9-]*+(?:\.[A-Za-z0-9-]++){1,4}+:[0-9]{2,5}\b""",
}
#: What a text must hold, as it is or in lower case, for a pattern to match: looked for first, as it costs little.
_NEEDS = {"assign": ((), ("passw", "secret", "token", "api")), "access": (("AKIA",), ()), "weak_id": (("AKIA", "ASIA"), ("user", "login", "account", "client")), "endpoint": ((":",), ())}
_ID, _SECRET, _ENDPOINT = 1, 2, 4
_PART = {"assign": _SECRET, "access": _ID, "hex": _SECRET, "weak_id": _ID, "weak_secret": _SECRET, "endpoint": _ENDPOINT}

_SPANS = "array<struct<start:bigint,end:bigint>>"


#: Put around matches; a text's own are taken for another code point, which no pattern tells from it.
_MARK, _OTHER = chr(0xFDD0), chr(0xFDD1)


def _marked(kind: str) -> Column:
    """The text with marks around each match, so that it splits into gap, match, gap, match, ..., gap; a value assigned is a part of its own. Null if no match can be there."""
    if kind == "assign":
        pattern, put = f"({_NAME})({_VALUE})", f"{_MARK}$1{_MARK}$2{_MARK}"
    else:
        pattern, put = PATTERNS[kind], f"{_MARK}$0{_MARK}"
    own = F.when(F.contains(F.col("text"), F.lit(_MARK)), F.translate("text", _MARK, _OTHER)).otherwise(F.col("text"))
    out = F.regexp_replace(own, pattern, put)
    if kind in _NEEDS:
        cased, lower = _NEEDS[kind]
        some = [F.contains(F.col("text"), F.lit(x)) for x in cased] + [F.contains(F.lower("text"), F.lit(x)) for x in lower]
        out = F.when(functools.reduce(Column.__or__, some), out)
    return out


def _places(kind: str) -> Column:
    """The places of a kind's matches: running sums over the lengths of the parts, by blocks of 256 matches.

    What depends on the text is bound to a variable before a loop over matches begins, so the text is split once."""
    n, match, ok = 2, "char_length(p[2 * i + 1])", "true"
    if kind == "assign":
        n, match, ok = 3, "char_length(p[3 * i + 1]) + char_length(p[3 * i + 2])", "char_length(p[3 * i + 2]) >= 6"
    if kind == "weak_secret":
        ok = "p[2 * i + 1] RLIKE '[0-9]' AND p[2 * i + 1] RLIKE '[A-Za-z]'"
    pairs = f"transform(sequence(0, (size(p) - 1) div {n} - 1), i -> struct(cast(char_length(p[{n} * i]) as bigint) as g, cast({match} as bigint) as m, {ok} as ok))"
    block = f"""aggregate(slice(q, b * 256 + 1, 256), struct(0L as at, cast(array() as {_SPANS}) as found),
        (acc, x) -> struct(acc.at + x.g + x.m as at, CASE WHEN x.ok THEN concat(acc.found, array(struct(acc.at + x.g as start, acc.at + x.g + x.m as end))) ELSE acc.found END as found))"""
    blocks = f"transform(sequence(0, (size(q) - 1) div 256), b -> {block})"
    shifted = f"""aggregate({blocks}, struct(0L as at, cast(array() as array<{_SPANS}>) as found),
        (acc, d) -> struct(acc.at + d.at as at, concat(acc.found, array(transform(d.found, s -> struct(s.start + acc.at as start, s.end + acc.at as end)))) as found), acc -> flatten(acc.found))"""
    whole = f"transform(array({pairs}), q -> {shifted})[0]"
    split = f"transform(array(split(t, '{_MARK}', -1)), p -> {whole})[0]"
    return F.expr(f"transform(array(marked_{kind}), t -> CASE WHEN contains(t, '{_MARK}') THEN {split} ELSE cast(array() as {_SPANS}) END)[0]")


def _matched(documents: DataFrame) -> DataFrame:
    """doc_id, key (the text's hash) and the spans of each kind, as arrays; nothing is linked yet."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    two = one.select("doc_id", F.md5("text").alias("key"), *(_marked(k).alias(f"marked_{k}") for k in KINDS))
    return two.select("doc_id", "key", *(_places(k).alias(k) for k in KINDS))


def _as_parts(n: int, kind: str) -> Column:
    return F.expr(f"transform({kind}, s -> struct(s.start as start, s.end as end, {n} as kind, {_PART[kind]} as part))")


def _as_listed(n: int, kind: str) -> Column:
    return F.expr(f"transform({kind}, s -> struct(s.start as start, {n} as place, '{kind}' as kind, s.end as end))")


def _linked(found: DataFrame, scope: int) -> DataFrame:
    """row and the weak spans (start, place in KINDS, kind, end) that no strong span overlaps and that have complementary parts within the scope."""
    ids, secrets = "(size(access) + size(weak_id))", "(size(assign) + size(hex) + size(weak_secret))"
    some = found.where(f"size(weak_id) + size(weak_secret) + size(endpoint) > 0 AND ({ids} > 0 OR size(endpoint) > 0) AND {secrets} > 0")
    parts = some.select("row", F.explode(F.concat(*(_as_parts(n, k) for n, k in enumerate(KINDS)))).alias("p")).select("row", "p.*")
    # A strong span that begins before a weak one or with it and ends in it, or the next one that begins, if it does so in it.
    strong = lambda c: F.when(F.col("kind") < 3, F.col(c))
    before = F.coalesce(F.max(strong("end")).over(W.partitionBy("row").orderBy("start")) > F.col("start"), F.lit(False))
    after = F.coalesce(F.min(strong("start")).over(W.partitionBy("row").orderBy(F.desc("start"))) < F.col("end"), F.lit(False))
    parts = parts.withColumn("hit", before | after).where("kind < 3 OR NOT hit").withColumn("bucket", F.expr(f"start div {scope}"))
    parts = written(parts.select("row", "start", "end", "kind", "part", "bucket"), "parts")
    ends = parts.groupBy("row", "bucket", "part").agg(F.min("start").alias("least"), F.max("start").alias("most"))
    weak = parts.where(F.col("kind") >= 3).withColumn("near", F.explode(F.expr("array(bucket - 1, bucket, bucket + 1)")))
    ends = ends.select("row", F.col("bucket").alias("near"), F.col("part").alias("other"), "least", "most")
    close = (F.col("near") == F.col("bucket")) | ((F.col("near") > F.col("bucket")) & (F.col("least") - F.col("start") <= scope)) | ((F.col("near") < F.col("bucket")) & (F.col("start") - F.col("most") <= scope))
    met = weak.join(ends, ["row", "near"]).where(close & (F.col("part") != F.col("other")))
    met = met.groupBy("row", "kind", "start", "end", "part").agg(F.bit_or("other").alias("others"))
    enough = F.expr(f"CASE part WHEN {_ID} THEN others & {_SECRET} > 0 WHEN {_SECRET} THEN others > 0 ELSE others & {_ID | _SECRET} = {_ID | _SECRET} END")
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    return met.where(enough).groupBy("row").agg(F.collect_list(F.struct("start", F.col("kind").alias("place"), name.alias("kind"), "end")).alias("linked"))


_LISTED = "array<struct<start:bigint,place:int,kind:string,end:bigint>>"


def find_secrets(documents: DataFrame, *, scope: int = SCOPE) -> DataFrame:
    """doc_id, key (md5 of the text), base and all: sorted spans (start, place, kind, end) of the strong kinds and of all."""
    found = written(_matched(documents).withColumn("row", F.monotonically_increasing_id()), "spans")
    base = F.concat(*(_as_listed(n, k) for n, k in enumerate(KINDS[:3])))
    out = found.select("row", "doc_id", "key", F.array_sort(base).alias("base")).join(_linked(found, scope), "row", "left")
    return out.select("doc_id", "key", "base", F.array_sort(F.concat("base", F.coalesce("linked", F.expr(f"cast(array() as {_LISTED})")))).alias("all"))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(documents: DataFrame, *, scope: int = SCOPE) -> DataFrame:
    """doc_id, numbers of strong spans by kind, base_sha256 (of the strong spans' list) and spans (all, listed)."""
    found = find_secrets(documents, scope=scope)
    n = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *n, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("all").alias("spans"))


def _cut() -> Column:
    """The column text with each run of overlapping _spans replaced by the kind of its first, in brackets.

    A run begins where a span starts at the greatest end before it or later; these ends are running maxima by blocks of 256 spans. What
    lies between runs is taken from pieces of 256 code points, so no place is counted from the text's start again."""
    maxima = """transform(sequence(0, (size(_spans) - 1) div 256), b -> aggregate(slice(_spans, b * 256 + 1, 256), struct(0L as at, cast(array() as array<bigint>) as before),
        (acc, s) -> struct(greatest(acc.at, s.end) as at, concat(acc.before, array(acc.at)) as before)))"""
    over = "aggregate(d, struct(0L as at, cast(array() as array<bigint>) as before), (acc, x) -> struct(greatest(acc.at, x.at) as at, concat(acc.before, array(acc.at)) as before))"
    runs = "filter(transform(_spans, (s, i) -> struct(s.start as start, s.kind as kind, greatest(d[i div 256].before[i % 256], o.before[i div 256]) as before)), r -> r.start >= r.before)"
    at = lambda x: f"coalesce(get(c, cast({x} div 256 as int)), '')"
    between = lambda a, b: f"""CASE WHEN {a} div 256 = {b} div 256 THEN substring({at(a)}, cast({a} % 256 as int) + 1, cast({b} - {a} as int))
        ELSE concat(substring({at(a)}, cast({a} % 256 as int) + 1), array_join(slice(c, cast({a} div 256 as int) + 2, cast({b} div 256 - {a} div 256 as int) - 1), ''), substring({at(b)}, 1, cast({b} % 256 as int))) END"""  # noqa: E731
    told = f"concat(array_join(transform({runs}, r -> concat({between('r.before', 'r.start')}, '[', r.kind, ']')), ''), {between('o.at', 'l')})"
    bound = [("cast(char_length(text) as bigint)", "l"), ("regexp_extract_all(text, '(?s).{1,256}', 0)", "c"), (maxima, "d"), (over, "o")]
    for value, name in reversed(bound):
        told = f"transform(array({value}), {name} -> {told})[0]"
    return F.expr(told)


def redacted(documents: DataFrame, *, scope: int = SCOPE) -> DataFrame:
    """The documents, all columns, each run of overlapping spans in their texts replaced by its first kind in brackets."""
    some = find_secrets(documents, scope=scope).where(F.size("all") > 0).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("all").alias("_spans")).distinct()
    own = documents.select(whole_rows(documents), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.md5(F.col("text").cast("string")).alias("key"))
    out = own.join(some, own.id.eqNullSafe(some._id) & (own.key == some._key), "left")
    text = F.when(F.col("_spans").isNotNull(), _cut()).otherwise(F.col("text"))
    return out.select(F.col("own").withField("text", text).alias("own")).select("own.*")
