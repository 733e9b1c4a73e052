"""Vectors as arrays of doubles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidecast.functions.text import normalize_name

DIMS = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def features(name: Column, orders: tuple[int, ...] = (3, 4), cleaned: bool = False) -> Column:
    """The marked runs of characters and, twice, the words of a name once cleaned; ``cleaned`` tells that it is."""
    text = F.concat(F.lit(" "), name if cleaned else normalize_name(name), F.lit(" "))

    def runs(n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(f"c{n}:"), F.substring(text, i, F.lit(n))))

    words = F.transform(F.filter(F.split(F.trim(text), " "), lambda w: w != ""), lambda w: F.concat(F.lit("w:"), w))
    return F.concat(*map(runs, orders), words, words)


def hash_embedding(name: Column, dims: int = DIMS, cleaned: bool = False) -> Column:
    """Signed feature hashing by CRC-32, of length one (zero for a name without letters): the sign is the hash's 17th bit.

    The hashes are found by built-in functions; adding them up in the places of a vector is one numpy call for each name of an Arrow batch."""

    @F.pandas_udf("array<double>")
    def place(hashes: pd.Series) -> pd.Series:
        out = []
        for h in hashes:
            h = np.asarray(h, np.int64)
            v = np.bincount(h % dims, weights=np.where((h >> 16) & 1, 1.0, -1.0), minlength=dims)
            n = np.sqrt((v * v).sum())
            out.append(v / n if n > 0 else v)
        return pd.Series(out)

    return place(F.transform(features(name, cleaned=cleaned), lambda f: F.crc32(f)))
