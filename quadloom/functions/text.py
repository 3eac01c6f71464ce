"""Text analysis for full-text ranking, and JSON found in model answers."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that ranking ignores.
STOP_WORDS = """a about above after again against all am an and any are as at be because been before being below between both
but by can did do does doing don down during each few for from further had has have having he her here hers herself him
himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our
ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these
they this those through to too under until up very was we were what when where which while who whom why will with you
your yours yourself yourselves""".split()

#: The sum of 1/j^2 over all j, by which repeated words are scaled.
_LIMIT = 1.64493406685


def query_terms(text: str) -> list[str]:
    """A question's distinct words in lower case, without stop words, in their order."""
    import re

    return list(dict.fromkeys(w for w in re.findall("[a-z0-9]+", text.lower()) if w not in STOP_WORDS))


def or_query(c: Column | str) -> Column:
    """A question's words (A-Z, a-z, 0-9) joined by |."""
    return F.array_join(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0)), " | ")


def analyze(c: Column | str) -> Column:
    """The words that count, in order."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def _word(terms: list[str]) -> str:
    return "(?<![a-z0-9])(?:" + "|".join(terms) + ")(?![a-z0-9])"


def holds_any(c: Column | str, terms: list[str]) -> Column:
    """Whether a text has one of the terms (words of query_terms()) as a word: one pass, without its list of words."""
    return F.lower(c).rlike(_word(terms)) if terms else F.lit(False)


def text_rank(c: Column | str, terms: list[str]) -> Column:
    """As ts_rank(), from the terms' numbers in the text itself."""
    return _rank([F.regexp_count(F.lower(c), F.lit(_word([t]))) for t in terms])


def matches(words: Column | str, terms: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, terms)).cast("array<string>")) if terms else F.lit(False)


def ts_rank(words: Column, terms: list[str]) -> Column:
    """Each term adds 0.1 times the sum of 1/j^2 up to its number of places, over the limit of that sum; then the mean over the terms."""
    return _rank([F.size(words) - F.size(F.array_remove(words, t)) for t in terms])


def term_rank(n: Column) -> Column:
    """What a term that occurs n times gives."""
    squares = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, j: a + 1.0 / (j * j).cast("double"))
    return 0.1 * squares / _LIMIT


def _rank(counts: list[Column]) -> Column:
    if not counts:
        return F.lit(0.0)
    return functools.reduce(Column.__add__, map(term_rank, counts)) / len(counts)


#: Strings, braces and what is between them.
_TOKENS = r'"(?:[^"\\]|\\.)*+"|[{}]|[^"{}]++|"'


def _held(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _balanced(t: Column) -> Column:
    """Of a text that begins with a brace, all up to the brace that closes it, those in strings aside; null if none does."""

    def step(a: Column, token: Column) -> Column:
        depth = a["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        return F.struct(depth.alias("depth"), (a["n"] + 1).alias("n"), F.when((a["end"] == 0) & (depth == 0), a["n"] + 1).otherwise(a["end"]).alias("end"))

    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("end"))
    end = lambda tokens: F.nullif(F.aggregate(tokens, begin, step, lambda a: a["end"]), F.lit(0))
    return _held(F.regexp_extract_all(t, F.lit(_TOKENS), F.lit(0)), lambda tokens: F.array_join(F.slice(tokens, F.lit(1), end(tokens)), ""))


def first_json_object(c: Column | str) -> Column:
    """The first JSON object in each answer, as its text, after fences and thinking blocks are taken out; null without one.

    What the first brace opens is tried first; only where that isn't JSON are the other braces tried in turn."""
    plain = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?s)<think>.*?</think>|```(?:json)?", "")
    whole = lambda x: F.try_parse_json(x).isNotNull()

    def each(t: Column) -> Column:
        braces = F.filter(F.sequence(F.lit(1), F.char_length(t)), lambda i: F.substr(t, i, F.lit(1)) == "{")
        return F.get(F.filter(F.transform(braces, lambda i: _balanced(F.substr(t, i))), whole), F.lit(0))

    first = lambda t: _held(_balanced(F.substr(t, F.locate("{", t))), lambda x: F.when(whole(x), x).otherwise(each(t)))
    return F.when(F.contains(plain, F.lit("{")), _held(plain, first))
