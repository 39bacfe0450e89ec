"""Helpers that the text operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, shared_dir  # noqa: F401

#: The separators of a word, `[^\x20\x09-\x0D]+`: exactly what bytes.split() splits on.
WORD_SPACE = r"[\x20\x09-\x0D]+"

#: Rows that one Arrow record batch hands to Python; with long texts the byte limit below ends a batch earlier.
BATCH_ROWS = 2_000
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of a Python worker: Arrow batches end at a number of rows or bytes, whichever comes first."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Stash:
    """Intermediate tables written to the shared folder: lineage ends there, and a lost executor costs only its own tasks."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.setdefault(name, []).append(path)
        return out

    def drop_all(self, *but: str) -> None:
        """Delete everything but the tables kept under these names."""
        for name in [n for n in self.paths if n not in but]:
            self.drop(name)

    def drop(self, name: str, but: int = 0) -> None:
        """Delete the tables kept under a name, except the latest `but`."""
        paths = self.paths.get(name, [])
        gone, self.paths[name] = paths[: len(paths) - but], paths[len(paths) - but :]
        for path in gone:
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Keys that a broadcast for hot keys can have at most.
HOT_KEYS = 1 << 14


def by_counts(left: DataFrame, counts: DataFrame, on: list[str], total: int) -> DataFrame:
    """left joined with counts, which has one row for each key and the key's number of rows of left in m; left has `total` rows.

    Keys with more than one of HOT_KEYS parts of all rows are broadcast: there can be no
    more than HOT_KEYS of them, whatever the input. So their rows stay where they are,
    and only keys with few rows are shuffled. Both tables are read twice, so they should
    have been written.
    """
    hot = F.broadcast(counts.where(F.col("m") * HOT_KEYS > total))
    cold = left.join(hot.select(*on), on, "left_anti").join(counts.where(F.col("m") * HOT_KEYS <= total), on)
    return left.join(hot, on).unionByName(cold)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores in front as long as df has a column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def fold(column: str, mod: int) -> Column:
    """crc32 of an id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def valid(column: str) -> Column:
    """A column as text in which bytes that are no UTF-8 became U+FFFD."""
    return F.make_valid_utf8(F.col(column).cast("string"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
