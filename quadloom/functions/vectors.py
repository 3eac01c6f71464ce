"""Vectors as arrays: cosine similarity, and an embedding by hashed words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """1 less the cosine distance; null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity(a: Column | str, query: list[float]) -> Column:
    """cosine() with a vector at hand, whose length is taken once."""
    import math

    length = math.sqrt(math.fsum(float(x) ** 2 for x in query))
    return F.try_divide(dot(a, literal(query)), norm(a) * F.lit(length))


def literal(v: list[float]) -> Column:
    return F.lit([float(x) for x in v]).cast("array<double>")


def hashing_embedder(width: int = 64):
    """A pandas UDF from texts to unit vectors: each word adds or takes one at a place that its hash names."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        import re
        import zlib

        import numpy as np

        def one(t: str | None) -> list[float]:
            v = np.zeros(width)
            for w in re.findall(r"\w+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                v[h % width] += 1 if h >> 31 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).astype("float32").tolist()

        return pd.Series([one(t) for t in texts], dtype=object)

    return embed
