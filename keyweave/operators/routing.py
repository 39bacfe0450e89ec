"""Rows sent to the partitions that a layout names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import partition_id
from ..plans.layout import Layout


def routes(spark, keys: list, layout: Layout, key_type: str) -> DataFrame:
    """(__key, __parts) of the tracked keys. As many rows as keys are tracked, so it can be broadcast whatever the relations' size."""
    return F.broadcast(spark.createDataFrame([(k, list(p)) for k, p in zip(keys, layout.parts, strict=True)], f"__key {key_type}, __parts array<int>"))


def _rest(key: str, layout: Layout, fn: str):
    return partition_id(F.col(key), layout.rest, fn) + layout.designated


def built(r: DataFrame, key: str, known: DataFrame, layout: Layout, fn: str = "xxhash64") -> DataFrame:
    """R with `__route`: a row for each partition that its key's rows of S are dealt to."""
    both = r.join(known, r[key] == known["__key"], "left")
    parts = F.array_distinct(F.coalesce("__parts", F.array(_rest(key, layout, fn))))
    return both.withColumn("__route", F.explode(parts)).drop("__key", "__parts").repartitionById(layout.partitions, F.col("__route"))


def probing(s: DataFrame, key: str, known: DataFrame, layout: Layout, fn: str = "xxhash64") -> DataFrame:
    """S without null keys, with `__to`: the partition of its key, or the next one of several."""
    both = s.withColumn("__row", F.monotonically_increasing_id()).join(known, s[key] == known["__key"], "left")
    part = F.get("__parts", F.pmod("__row", F.size("__parts")).cast("int"))
    # Nulls go only here, past the row number: a filter next to the scan would compute the key once more.
    both = both.withColumn("__to", F.coalesce(part, F.when(F.col(key).isNotNull(), _rest(key, layout, fn)))).where("__to is not null")
    return both.drop("__key", "__parts", "__row").repartitionById(layout.partitions, F.col("__to"))
