"""Near-duplicate documents by SimHash, found through segment popcounts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Stash, as_bytes, small_batches, table, unused
from .components import components

SHINGLE = 3
SEED = 42
#: Shingles whose bits are unpacked at a time, so a very long text needs no more memory than a page of them.
PAGE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a UTF-8 text, as a signed long; 0 for a text with no word."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    if n == 1:
        grams: Iterator[bytes] = iter([line])
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        grams = map(line.__getitem__, map(slice, starts[:n].tolist(), ends[shingle - 1 :].tolist()))
    hashes = np.fromiter(map(xxh64_intdigest, grams, repeat(seed)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, PAGE):
        page = hashes[at : at + PAGE].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(page, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * votes > n).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row; fp is the fingerprint as a long. A null text counts as empty."""
    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return picked.mapInArrow(run, "id long, fp long")


def popcounts(fp: Column) -> Column:
    """The embedding: the bit counts of the 16 four-bit segments, each held in its own four bits of a long."""
    odd, low = F.lit(0x5555555555555555), F.lit(0x3333333333333333)
    a, b = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    # Two-bit sums without a carry into the sign, which ANSI arithmetic would reject.
    pairs = a.bitwiseXOR(b).bitwiseOR(F.call_function("shiftleft", a.bitwiseAND(b), F.lit(1)))
    return pairs.bitwiseAND(low) + F.shiftrightunsigned(pairs, 2).bitwiseAND(low)


def near_links(distinct: DataFrame) -> DataFrame:
    """(u, v) links that connect all fingerprints (column fp, distinct) at two or fewer differing bits.

    Two fingerprints that differ in d bits have segment bit counts at a Manhattan
    distance of d at most. So two within 2 bits both lie within 1 of a common grid
    cell: each is put in its own cell and the cells one step away, and a cell with a
    single fingerprint is dropped (the lower bound). What is left is verified exactly:
    in a cell each fingerprint names the words of that very bit count that differ from
    it in one bit at most, and two fingerprints name the same word if and only if they
    differ in two bits or fewer. All that name a word are linked to the smallest of
    them, so a crowded cell gives links in proportion to its fingerprints, never pairs.
    """
    own, one = popcounts(F.col("fp")), F.lit(1).cast("long")

    def beside(i: Column) -> Column:
        count, step = F.call_function("shiftrightunsigned", own, 4 * i).bitwiseAND(F.lit(15)), F.call_function("shiftleft", one, 4 * i)
        return F.array(F.when(count < 4, own + step), F.when(count > 0, own - step))

    # Fingerprints are small and their cells many, so tasks sized by what they read would be too few.
    spark = distinct.sparkSession
    distinct = distinct.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")
    around = F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), beside)))
    cells = distinct.select("fp", F.explode(F.concat(F.array(own), around)).alias("cell"))
    shared = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    # 33 cells at most for a fingerprint, so this list is bounded.
    found = cells.join(shared, "cell").groupBy("fp").agg(F.collect_list("cell").alias("cells"))
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", one, i)))
    near = F.filter(F.concat(F.array(F.col("fp")), flips), lambda w: F.array_contains(F.col("cells"), popcounts(w)))
    words = found.select("fp", F.explode(near).alias("word"))
    heads = words.groupBy("word").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1").select("word", "head")
    pairs = words.join(heads, "word").where("fp <> head").select(F.col("fp").alias("u"), F.col("head").alias("v"))
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): the smallest id that can be reached over fingerprints at two or fewer differing bits.

    Rows with equal fingerprints are one node, so copies cost nothing beyond the count
    of rows. Null and empty texts have fingerprint 0 and are linked like any other.
    Repeated ids give repeated rows; a null id gets its group's smallest other id, or
    null if there is none. An empty table gives no rows.
    """
    spark = docs.sparkSession
    stash = Stash(spark)
    rows = stash.keep(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = stash.keep(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(near_links(nodes.select("fp")))
    joined = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = joined.groupBy("root").agg(F.min("least").alias("component"))
    of_fp = joined.join(first, "root").select("fp", "component")
    return rows.join(of_fp, "fp").select("id", "fp", "component")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex_fingerprint(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those that have a near-duplicate with a smaller id; all columns stay.

    Rows that repeat an id all stay or all go; rows with a null id stay.
    """
    found = near_duplicates(docs, id_col, text_col)
    (name,) = unused(docs, "gone")
    gone = found.where("id <> component").select(F.col("id").alias(name)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone[name], "left_anti")
