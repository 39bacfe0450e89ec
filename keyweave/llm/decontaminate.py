"""Benchmark items in documents, by SimHash of item-sized windows and exact similarity of word shingles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stash, table, unused

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints are searched within so many of 64 bits. At a similarity of 0.8, shingles differ in 9.7 bits on average
#: with a deviation of 2.9, so this is beyond two and a half deviations.
RADIUS = 17
#: Blocks of the index: first bit, number of bits, and within how many bits it is searched. Each of two fingerprints that
#: differ by more than the limit in every block would make RADIUS + 1 bits at least.
BLOCKS = ((0, 13, 3), (13, 13, 3), (26, 13, 3), (39, 13, 2), (52, 12, 2))
#: Bytes up to which a table is broadcast, estimated from its rows and columns; above, the join is shuffled.
BROADCAST_BYTES = 64 << 20
#: The bits of a hash are counted two at a time, in the halves of a long.
HALVES = 0x0000000100000001
LOW = 0xFFFFFFFF


def words_of(text: Column) -> Column:
    """The hashes of lower-case runs of letters and digits."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def sized(df: DataFrame) -> DataFrame:
    """df, whose columns are numbers, marked for broadcast if its rows take few enough bytes."""
    rows = BROADCAST_BYTES // (16 + 8 * len(df.columns))
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def counted_bits(h: Column) -> list[Column]:
    """32 longs whose sums over many hashes hold the numbers of bit b and bit b + 32 in their halves."""
    return [F.shiftrightunsigned(h, b).bitwiseAND(F.lit(HALVES)) for b in range(32)]


def majority(sums: list[Column], n: Column) -> Column:
    """The fingerprint: a bit is set if more than half of the n hashes have it."""
    fp = F.lit(0).cast("long")
    for b in range(64):
        votes = sums[b].bitwiseAND(F.lit(LOW)) if b < 32 else F.shiftrightunsigned(sums[b - 32], 32)
        fp = fp.bitwiseOR(F.when(2 * votes > n, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)))
    return fp


def block(fp: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1))


def flips(bits: int, distance: int) -> list[int]:
    """The words of so many bits with `distance` bits set at most."""
    return [x for x in range(1 << bits) if x.bit_count() <= distance]


def near_items(contents: DataFrame, items: DataFrame) -> DataFrame:
    """(wid, iid): windows (wid, k, l, fp) and items (iid, k, l, fp) of one size whose fingerprints differ in RADIUS bits at most, all of them."""
    spark = contents.sparkSession
    near = spark.createDataFrame([(i, x) for i, (_, bits, limit) in enumerate(BLOCKS) for x in flips(bits, limit)], "i int, x long")
    own = F.posexplode(F.array(*(block(F.col("fp"), at, bits) for at, bits, _ in BLOCKS)))
    probes = items.select("iid", F.col("fp").alias("item_fp"), "k", "l", own.alias("i", "own")).join(F.broadcast(near), "i")
    probes = probes.select("iid", "item_fp", "k", "l", "i", F.col("own").bitwiseXOR(F.col("x")).alias("v"))
    index = contents.select("wid", "fp", "k", "l", own.alias("i", "v"))
    found = index.join(sized(probes), ["k", "l", "i", "v"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    return found.select("wid", "iid").distinct()


def rolled(positions: DataFrame, windows: DataFrame) -> DataFrame:
    """windows (id, copy, k, l, s, count) with the fingerprint `fp` and `mix`, which tells windows with other shingles apart, from positions (id, copy, k, p, h).

    The sums of a window are the running sums of its document at its end less those
    before its beginning, so a document costs its shingles and windows, whatever their length.
    """
    doc = ["id", "copy", "k"]
    h2 = F.xxhash64("h")
    parts = [*counted_bits(F.col("h")), *(x for h in (F.col("h"), h2) for x in (h.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(h, 32)))]
    marks = F.explode(F.array(F.col("s") - 1, F.col("s") + F.col("count") - 1))
    rows = positions.select(*doc, "p", "h", F.lit(None).cast("int").alias("l"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("count"))
    rows = rows.unionByName(windows.select(*doc, marks.alias("p"), F.lit(None).cast("long").alias("h"), "l", "s", "count"))
    # Marks come after the shingle of their place.
    before = Window.partitionBy(*doc).orderBy("p", F.col("h").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    sums = [f"x{i}" for i in range(len(parts))]
    rows = rows.select(*doc, "l", "s", "count", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(name) for x, name in zip(parts, sums, strict=True))).where("s is not null")
    # Sums never fall.
    both = rows.groupBy(*doc, "l", "s", "count").agg(*((F.max(x) - F.min(x)).alias(x) for x in sums))
    return both.select(*doc, "l", "s", "count", majority([F.col(x) for x in sums[:32]], F.col("count")).alias("fp"), F.xxhash64(*sums[32:]).alias("mix"))


def benchmark_matches(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(id, item, start, n_words, similarity): for each document and item the window, as long as the item, that is most similar to it, if that reaches `similarity`.

    Similarity is that of the shingles' counts: the sum of the lesser over the sum of the
    greater. Shingles have five words; an item with fewer is one shingle, one without
    words is never found. A document shorter than the item is one window.

    A window can only be so similar to an item of its size if enough of its shingles
    occur in items of that size, whichever. Every such window gets a fingerprint, equal
    ones are searched once, and the fingerprints alone tell which items are compared.

    Null texts count as empty; repeated rows give one result; null ids are kept apart
    from others and reported as null. Of equally similar windows the first counts.
    """
    stash = Stash(docs.sparkSession)
    b = items.select(F.col(item_col).cast("long").alias("item"), F.xxhash64(item_col, item_text_col).alias("iid"), words_of(F.col(item_text_col)).alias("words"))
    b = b.where("size(words) > 0").dropDuplicates(["iid"]).withColumns({"l": F.size("words"), "k": F.least(F.size("words"), F.lit(SHINGLE))})
    b = b.withColumn("t", F.col("l") - F.col("k") + 1)
    b = b.select("item", "iid", "l", "k", "t", F.explode(F.transform(F.sequence(F.lit(1), "t"), lambda i: F.xxhash64(F.slice("words", i, F.col("k"))))).alias("h"))
    b = stash.keep(b, "items")

    doc = ["id", "copy"]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("copy"), words_of(text).alias("words"))
    found = []
    for (k,) in b.select("k").distinct().collect():  # five lengths at most
        places = own.where(F.size("words") >= k).select(*doc, "words", F.size("words").alias("n"), F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("p"))
        shingle = F.xxhash64(*(F.get("words", F.col("p") + j) for j in range(k)))
        found.append(places.select(*doc, "n", F.lit(k).alias("k"), "p", shingle.alias("h")).join(sized(b.where(F.col("k") == k).select("h").distinct()), "h"))
    none = own.select(F.lit(0).cast("long").alias("h"), *doc, *(F.lit(0).alias(x) for x in ("n", "k", "p"))).where(F.lit(False))
    anchors = stash.keep(reduce(DataFrame.unionByName, found, none), "anchors")

    # For each size of items: where a document has shingles of such items, and the windows with enough of them.
    held = anchors.join(sized(b.select("k", "h", "l", "t").distinct()), ["k", "h"]).groupBy(*doc, "n", "k", "l", "t").agg(F.array_sort(F.collect_set("p")).alias("at"))
    held = held.withColumn("count", F.least("l", "n") - F.col("k") + 1)
    # Of two windows with x and t shingles, y in common, the similarity is y / (x + t - y).
    held = held.withColumn("need", F.ceil((F.col("count") + F.col("t")) * similarity / (1 + similarity) - 1e-9).cast("int")).where(F.size("at") >= F.col("need"))
    first = F.when(F.col("j") > 0, F.get("at", F.col("j") - 1) + 1).otherwise(0)
    held = held.withColumn("j", F.explode(F.sequence(F.lit(0), F.size("at") - F.col("need"))))
    # Windows whose first such shingle is the j-th one.
    low, high = F.greatest(first, F.get("at", F.col("j") + F.col("need") - 1) - F.col("count") + 1), F.least(F.get("at", "j"), F.greatest(F.lit(0), F.col("n") - F.col("l")))
    windows = held.select(*doc, "k", "l", "count", low.alias("low"), high.alias("high")).where("low <= high").select(*doc, "k", "l", "count", F.explode(F.sequence("low", "high")).alias("s"))
    windows = stash.keep(windows, "starts")
    stash.drop("anchors")

    spans = windows.groupBy(*doc, "k").agg(F.min("s").alias("low"), F.max(F.col("s") + F.col("count") - 1).alias("high"))
    positions = own.join(sized(stash.keep(spans, "spans")), doc).select(*doc, "k", "words", F.explode(F.sequence("low", "high")).alias("p"))
    positions = stash.keep(positions.select(*doc, "k", "p", F.xxhash64(F.slice("words", F.col("p") + 1, F.col("k"))).alias("h")).distinct(), "positions")
    windows = stash.keep(rolled(positions, windows), "windows")
    stash.drop("starts")
    stash.drop("spans")

    content = ["k", "l", "count", "fp", "mix"]
    contents = windows.groupBy(*content).agg(F.min(F.struct(*doc, "s")).alias("x")).select(*content, "x.*", F.monotonically_increasing_id().alias("wid"))
    contents = stash.keep(contents, "contents")
    prints = b.groupBy("iid", "k", "l", "t").agg(*(F.sum(x).alias(f"x{i}") for i, x in enumerate(counted_bits(F.col("h")))))
    prints = stash.keep(prints.select("iid", "k", "l", "t", majority([F.col(f"x{i}") for i in range(32)], F.col("t")).alias("fp")), "prints")
    candidates = stash.keep(near_items(contents, prints), "candidates")

    asked = contents.join(candidates.select("wid").distinct(), "wid").select("wid", *doc, "k", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("count") - 1)).alias("p"))
    of_window = asked.join(positions, [*doc, "k", "p"]).groupBy("wid", "h").agg(F.count("*").alias("x"))
    of_item = b.groupBy("iid", "h").agg(F.count("*").alias("y"))
    common = candidates.join(of_window, "wid").join(of_item, ["iid", "h"]).groupBy("wid", "iid").agg(F.sum(F.least("x", "y")).alias("both"))
    alike = common.join(contents.select("wid", *content), "wid").join(prints.select("iid", "t"), "iid")
    alike = alike.withColumn("similarity", F.col("both") / (F.col("count") + F.col("t") - F.col("both"))).where(F.col("similarity") >= similarity - 1e-12)
    alike = stash.keep(alike.join(b.select("iid", "item").distinct(), "iid").select(*content, "item", "similarity"), "alike")
    hits = windows.join(sized(alike), content)
    best = hits.groupBy("id", "item").agg(F.max(F.struct("similarity", -F.col("s"), F.col("count") + F.col("k") - 1)).alias("best"))
    best = best.select(F.when(F.col("id") != -(1 << 63), F.col("id")).alias("id"), "item", (-F.col("best.col2")).cast("long").alias("start"), F.col("best.col3").cast("long").alias("n_words"), "best.similarity")
    best = stash.keep(best, "matches")
    stash.drop_all("matches")
    return best


def without_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs in which no item was found, with all their columns; rows that share an id stay or go together."""
    (gone,) = unused(docs, "gone")
    found = benchmark_matches(docs, items, id_col, text_col).select(F.col("id").alias(gone)).distinct()
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(found[gone]), "left_anti")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("start").alias("start_word"), "n_words", "similarity")
