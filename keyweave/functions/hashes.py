"""Hashes of a join key, and the partition that a hash names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _leading(hex_digest: Column, digits: int) -> Column:
    return F.conv(F.substring(hex_digest, 1, digits), 16, 10).cast("long")


def _text(key: Column) -> Column:
    return key.cast("string")


#: Selectable by name; all are Spark's own functions and give a long. md5 and crc32 have twins in other engines.
HASHES: dict[str, Callable[[Column], Column]] = {
    "xxhash64": F.xxhash64,
    "murmur3": lambda key: F.hash(key).cast("long"),
    "crc32": lambda key: F.crc32(_text(key).cast("binary")),
    "md5": lambda key: _leading(F.md5(_text(key).cast("binary")), 8),
    "sha256": lambda key: _leading(F.sha2(_text(key), 256), 15),
}


def hashed(key: Column, fn: str = "xxhash64") -> Column:
    if fn not in HASHES:
        raise ValueError(f"no hash named {fn}; there are {', '.join(HASHES)}")
    return HASHES[fn](key)


def partition_id(key: Column, partitions: int, fn: str = "xxhash64") -> Column:
    return F.pmod(hashed(key, fn), F.lit(partitions)).cast("int")


def rounded_partition_id(key: Column, partitions: int, chunks: int, fn: str = "xxhash64") -> Column:
    """The hash modulo the number of memory-sized chunks, and that modulo the partitions: each partition is a whole number of chunks."""
    return F.pmod(F.pmod(hashed(key, fn), F.lit(chunks)), F.lit(partitions)).cast("int")


def uniform(key: Column, seed: int = 0) -> Column:
    """A number from 0 up to 1 that a key always gets, whatever engine computes it."""
    return _leading(F.md5(F.concat(_text(key), F.lit(f":{seed}")).cast("binary")), 8) / F.lit(float(1 << 32))
