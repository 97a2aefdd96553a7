"""Words and runs of words as array columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    return F.split(text, r"\s+")


def grams(tokens: Column, k: int) -> Column:
    """Each run of k tokens, joined by blanks; empty where there are fewer. The token array is
    shifted as a whole, so it is computed once and not once for each run."""
    n = F.greatest(F.size(tokens) - (k - 1), F.lit(0))
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat_ws(" ", x, y)), [F.slice(tokens, F.lit(i + 1), n) for i in range(k)])
