"""Delimited text and correlation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import Layout


def read_delimited(spark: SparkSession, path: str, layout: Layout, columns: list[str] | None = None, sep: str = "|") -> DataFrame:
    """Rows of a delimited file whose fields come in the order of `columns` (default: the layout's); empty fields are null. A separator within quotes is text."""
    fields = {f.name: f for f in layout.struct}
    names = columns or list(fields)
    read = spark.read.schema(T.StructType([fields[c] for c in names]))
    return read.csv(path, sep=sep, quote='"', escape="\\", nullValue="", mode="FAILFAST").select(*fields)


def write_delimited(df: DataFrame, path: str, sep: str = "|") -> None:
    df.write.csv(path, sep=sep, quote='"', escape="\\", nullValue="")


def export_joined(df: DataFrame, r: Layout, s: Layout, path: str, sep: str = "|") -> None:
    """Joined records as delimited text: the attributes of S, then those of R without its key."""
    write_delimited(df.select(*(a.name for a in s.joined(r).attributes)), path, sep)


def write_flat(df: DataFrame, path: str, sep: str = "|") -> None:
    """Lines in which the separator follows every field, the last one too; null is an empty field."""
    df.select(F.concat(*(x for c in df.columns for x in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(sep))))).write.text(path)


def read_flat(spark: SparkSession, path: str, layout: Layout, columns: list[str] | None = None, sep: str = "|") -> DataFrame:
    """What write_flat wrote, fields in the order of `columns` (default: the layout's). Nothing is quoted, so no field may hold the separator."""
    fields = {f.name: f for f in layout.struct}
    named = [fields[c] for c in columns or fields]
    read = spark.read.schema(T.StructType([*named, T.StructField("__end", T.StringType())]))
    return read.csv(path, sep=sep, quote="", nullValue="", mode="FAILFAST").select(*fields)


def write_correlation(ct: DataFrame, path: str) -> None:
    """(key, m) as lines `key m`, the most frequent first."""
    ct.orderBy(F.desc("m"), "key").select(F.concat_ws(" ", F.col("key").cast("string"), F.col("m").cast("string"))).write.text(path)


def read_correlation(spark: SparkSession, path: str, key_type: str = "bigint") -> DataFrame:
    return spark.read.schema(f"key {key_type}, m bigint").csv(path, sep=" ", mode="FAILFAST")
