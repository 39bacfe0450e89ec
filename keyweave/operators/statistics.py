"""How often each key of a relation is referred to, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def correlation_table(r: DataFrame, s: DataFrame, r_key: str, s_key: str) -> DataFrame:
    """(key, m) for every key of R: the rows of S that refer to it, 0 if none does.

    S is counted before it is shuffled, so a key with very many rows costs one row per task.
    """
    counts = s.where(F.col(s_key).isNotNull()).groupBy(F.col(s_key).alias("key")).agg(F.count("*").alias("m"))
    keys = r.select(F.col(r_key).alias("key")).where("key is not null")
    return keys.join(counts, "key", "left").select("key", F.coalesce("m", F.lit(0)).alias("m"))


def top_keys(ct: DataFrame, k: int) -> DataFrame:
    """The k keys with the most rows, ties by key."""
    return ct.orderBy(F.desc("m"), "key").limit(k)


def ranked(ct: DataFrame) -> DataFrame:
    """(key, m, rank, so_far) of all keys, those with the most rows first, ties by key.

    Keys are dealt out in ranges of this order. Each range is ranked and summed by
    itself, beginning with the keys and rows of the ranges before it.
    """
    order = [F.desc("m"), F.col("key")]
    # Kept, since another run might cut the ranges elsewhere.
    ranges = ct.select("key", "m").repartitionByRange(*order).withColumn("range", F.spark_partition_id()).persist()
    before, keys, rows = [], 0, 0
    for r in ranges.groupBy("range").agg(F.count("*").alias("keys"), F.sum("m").alias("rows")).orderBy("range").collect():
        before.append((r["range"], keys, rows))
        keys, rows = keys + r["keys"], rows + r["rows"]
    begin = F.broadcast(ct.sparkSession.createDataFrame(before, "range int, keys long, rows long"))
    w = Window.partitionBy("range").orderBy(*order)
    own = {"rank": F.row_number().over(w), "so_far": F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0))}
    return ranges.withColumns(own).join(begin, "range").select("key", "m", (F.col("keys") + F.col("rank")).alias("rank"), (F.col("rows") + F.col("so_far")).alias("so_far"))


def coverage(ct: DataFrame, k: int) -> DataFrame:
    """One row (covered, total, ratio): the part of S that refers to the top k keys."""
    total = ct.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("total"))
    return top_keys(ct, k).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("covered")).crossJoin(F.broadcast(total)).select("covered", "total", F.when(F.col("total") > 0, F.col("covered") / F.col("total")).alias("ratio"))


def multiplicity_histogram(ct: DataFrame) -> DataFrame:
    """(m, keys): how many keys have each multiplicity."""
    return ct.groupBy("m").agg(F.count("*").alias("keys"))


def partition_counts(df: DataFrame, pid: str = "pid") -> DataFrame:
    return df.groupBy(pid).agg(F.count("*").alias("rows"))


def partition_histogram(assigned: DataFrame) -> DataFrame:
    """(size, partitions, keys, rows) from (key, m, pid): how many partitions hold so many keys, with how many rows of S."""
    sizes = assigned.groupBy("pid").agg(F.count("*").alias("size"), F.sum("m").alias("rows"))
    return sizes.groupBy("size").agg(F.count("*").alias("partitions"), F.sum("size").alias("keys"), F.sum("rows").alias("rows"))


def partition_statistics(assigned: DataFrame) -> DataFrame:
    """(key, m, pid, size) from (key, m, pid): each key with the number of keys in its partition."""
    sizes = assigned.groupBy("pid").agg(F.count("*").alias("size"))
    return assigned.join(sizes, "pid").select("key", "m", "pid", "size")
