"""English stems by the published Porter2 (Snowball English) rules, for ranking: a plain function for one word, meant to run once per distinct word."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the algorithm: vowels, doubled letters, endings before which "li" goes, words of their own, and the endings of each step.
_VOWEL = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
_OWN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_OWN_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant that follows a vowel, and the same again from there."""
    after = lambda at: m.end() if (m := re.compile("[aeiouy][^aeiouy]").search(word, at)) else len(word)
    special = re.match("gener|commun|arsen", word)
    r1 = special.end() if special else after(0)
    return r1, after(r1)


def _short_end(word: str) -> bool:
    return bool(re.search("(^|.*[^aeiouy])[aeiouy][^aeiouywxY]$", word)) and (len(word) == 2 or word[-3] not in _VOWEL)


def _short(word: str, r1: int) -> bool:
    return r1 >= len(word) and _short_end(word)


@functools.lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of other than Latin letters and apostrophes come back as they are."""
    if len(word) <= 2:
        return word
    if word in _OWN:
        return _OWN[word]
    w = word.removeprefix("'")
    # A y that begins a word or follows a vowel is a consonant.
    w = re.sub("(^|(?<=[aeiouy]))y", "Y", w)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy].+s$", w):
        w = w[:-1]
    if w in _OWN_1A:
        return w
    # 1b: past and present forms
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and re.search("[aeiouy]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif _short(w, r1):
            w += "e"
    # 1c: a final y after a consonant
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    end = _longest(w, _STEP_2)
    at = len(w) - len(end)
    if end and at >= r1 and (end != "ogi" or w[:at].endswith("l")) and (end != "li" or w[at - 1 : at] in tuple(_LI)):
        w = w[:at] + _STEP_2[end]
    end = _longest(w, _STEP_3)
    at = len(w) - len(end)
    if end and at >= r1 and (end != "ative" or at >= r2):
        w = w[:at] + _STEP_3[end]
    end = _longest(w, _STEP_4)
    at = len(w) - len(end)
    if end and at >= r2 and (end != "ion" or w[:at].endswith(("s", "t"))):
        w = w[:at]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stemmed(c: Column | str) -> Column:
    def each(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else stem(w))

    return F.pandas_udf(each, "string")(c)


def stems(words: DataFrame) -> DataFrame:
    """word and stem of the distinct words (word)."""
    return words.select("word").distinct().withColumn("stem", stemmed("word"))
