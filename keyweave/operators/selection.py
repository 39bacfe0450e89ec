"""Selections: samples and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import uniform


def bernoulli(df: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """Each row with probability `ratio`, by Spark's own sampling."""
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must lie between 0 and 1")
    return df if ratio == 1 else df.sample(False, ratio, seed)


def by_key(df: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """All rows of the keys whose hash lies below `ratio`: the same rows in any run, order or engine."""
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must lie between 0 and 1")
    return df.where(uniform(F.col(key), seed) < ratio)


def earlier(first: str, second: str) -> Column:
    """A date before another; false where one is missing."""
    return F.coalesce(F.col(first).cast("date") < F.col(second).cast("date"), F.lit(False))
