"""Word n-grams as arrays of distinct 64-bit hashes.

A slice and join for each position inside a higher-order function costs the square of a long text,
so this is an Arrow function: one pass over the words of each text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def word_grams(words: Column, n: int) -> Column:
    """Distinct hashes of the n-word grams of a blank-separated text; empty if it has fewer words."""

    @F.pandas_udf("array<long>")
    def run(s: pd.Series) -> pd.Series:
        from xxhash import xxh64_intdigest

        def one(text):
            w = (text or "").encode().split(b" ")
            return [h - (1 << 63) for h in {xxh64_intdigest(b" ".join(g)) for g in zip(*(w[k:] for k in range(n)))}]

        return s.map(one)

    return run.asNondeterministic()(words)  # so that no filter on it is pushed down and it runs once
