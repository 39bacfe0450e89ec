"""Repeated runs of lines, found with a suffix array over line ids, and removed except where they come first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_SPACE, Stash, by_counts, table, unused

#: A run of lines counts as a repeated passage from so many words on; shorter ones, such as a common heading, stay.
MIN_WORDS = 50

DOC = ["id", "copy"]


def document_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, copy, i, h1, h2, w) of every line: its document, number, two hashes and words. copy tells documents with one id apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    picked = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("copy"), F.posexplode(F.split(text, "\n", -1)).alias("i", "line"))
    words = F.regexp_count("line", F.lit(WORD_SPACE.replace("[", "[^")))
    return picked.select(*DOC, "i", F.xxhash64("line").alias("h1"), F.crc32(F.col("line").cast("binary")).alias("h2"), words.alias("w"))


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """lines (id, copy, i, h1, h2, w) that lie in segments with enough words, with `to` and `since`: where the shortest run of min_words words that begins here ends, and where that begins which ends here.

    A segment is a run of lines whose numbers follow each other. Where no such run fits
    in, the column is null. since is null, too, if the run would lose nothing but its
    last line's words by being shorter: the one that begins there says it already.
    """
    by_doc = Window.partitionBy(*DOC).orderBy("i")
    lines = lines.repartition(*DOC).dropDuplicates([*DOC, "i"]).withColumn("run", F.col("i") - F.row_number().over(by_doc))
    run = Window.partitionBy(*DOC, "run")
    before = run.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"words": F.sum("w").over(run), "begin": F.min("i").over(run), "end": F.max("i").over(run), "c": F.sum("w").over(before)})
    lines = lines.where(F.col("words") >= min_words).withColumn("b", F.col("c") - F.col("w"))
    # Frames that only grow: lines with min_words words more before them, and lines up to which there are min_words words less.
    beyond = run.orderBy(F.desc("b")).rangeBetween(Window.unboundedPreceding, -min_words)
    behind = run.orderBy("c").rangeBetween(Window.unboundedPreceding, -min_words)
    lines = lines.withColumns({"next": F.min("i").over(beyond), "last": F.max("i").over(behind), "c_last": F.max("c").over(behind)})
    to = F.when(F.col("next").isNotNull(), F.col("next") - 1).when(F.col("words") - F.col("b") >= min_words, F.col("end"))
    since = F.when((F.col("c") >= min_words) & (F.col("b") - F.coalesce("c_last", F.lit(0)) >= min_words), F.coalesce(F.col("last") + 1, "begin"))
    return lines.select(*DOC, "i", "h1", "h2", to.alias("to"), since.alias("since"))


def ranked(rows: DataFrame, by: list[str], total: int, stash: Stash) -> DataFrame:
    """(id, copy, i, r) of the rows, `total` at most, whose `by` occurs twice or more: r rises with `by` and is equal for equal ones. rows should have been written."""
    kinds = rows.groupBy(*by).agg(F.count("*").alias("m")).where("m > 1").orderBy(*by)
    # Written, so that the numbers stay as they are.
    kinds = stash.keep(kinds.withColumn("r", F.monotonically_increasing_id()), "kinds")
    out = stash.keep(by_counts(rows, kinds, by, total).select(*DOC, "i", "r"), "ranks")
    stash.drop("kinds")
    return out


def suffix_ranks(lines: DataFrame, longest: int, total: int, stash: Stash) -> list[DataFrame]:
    """By prefix doubling, tables (id, copy, i, r) for 1, 2, 4, ... lines up to `longest`: the rank of the suffix of a document from line i on, among all suffixes, by its first so many lines.

    Suffixes that share these lines have one rank and lie together in the suffix array.
    One that shares them with no other is left out, as nothing longer from it on is
    repeated. lines (id, copy, i, h1, h2) should have been written.
    """
    ranks = [ranked(lines, ["h1", "h2"], total, stash)]
    while 1 << len(ranks) <= longest:
        half = 1 << (len(ranks) - 1)
        then = F.first("r").over(Window.partitionBy(*DOC).orderBy("i").rangeBetween(half, half))
        pairs = stash.keep(ranks[-1].select(*DOC, "i", F.col("r").alias("a"), then.alias("b")).where("b is not null"), "pairs")
        level = ranked(pairs, ["a", "b"], total, stash)
        stash.drop("pairs")
        if level.isEmpty():
            break
        ranks.append(level)
    return ranks


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, copy, first, last): the maximal runs of consecutive lines in which every line belongs to a run, min_words words long or longer, that occurs before.

    Before means in a document with a smaller id, or further up in the same one; the
    occurrences may overlap. Null ids come first. Rows equal in id and text are one document.

    Only lines that occur twice or more can be part of such a run, and only segments of
    them with enough words. A line of a repeated run with enough words lies in one that
    cannot be shortened at its end or, if not so, in one that cannot be shortened at its
    beginning; these shortest runs, two for each line at most, are looked up in the
    suffix array: the suffixes that share so many lines form an interval whose longest
    common prefix is at least that long, and two ranks, of the powers of two that cover
    the run from its two ends, tell the intervals apart. All but the first occurrence
    of an interval are later copies. Overlapping ones are joined to maximal runs.
    """
    stash = Stash(docs.sparkSession)
    lines = stash.keep(document_lines(docs, id_col, text_col), "lines")
    often = stash.keep(lines.groupBy("h1", "h2").agg(F.count("*").alias("m")).where("m > 1"), "often")
    lines = stash.keep(shortest_runs(by_counts(lines, often, ["h1", "h2"], lines.count()).drop("m"), min_words), "segments")
    stash.drop_all("segments")

    ends = F.array(F.struct(F.col("i").alias("first"), F.col("to").alias("last")), F.struct(F.col("since").alias("first"), F.col("i").alias("last")))
    runs = lines.select(*DOC, F.explode(ends).alias("x")).select(*DOC, "x.first", "x.last").where("first is not null and last is not null")
    runs = runs.withColumn("n", F.col("last") - F.col("first") + 1)
    longest, total = runs.agg(F.max("n"), F.count("*")).first()
    levels = suffix_ranks(lines.select(*DOC, "i", "h1", "h2"), longest or 0, lines.count(), stash)

    every = None
    for k, level in enumerate(levels):
        rows = level.select(F.lit(k).alias("k"), *DOC, "i", "r")
        every = rows if every is None else every.union(rows)
    runs = runs.withColumn("k", F.floor(F.log2("n")).cast("int")).withColumn("middle", F.expr("last + 1 - shiftleft(1, k)"))
    runs = runs.join(every.select("k", *DOC, F.col("i").alias("first"), F.col("r").alias("a")), ["k", *DOC, "first"])
    runs = runs.join(every.select("k", *DOC, F.col("i").alias("middle"), F.col("r").alias("b")), ["k", *DOC, "middle"])
    runs = stash.keep(runs.select(*DOC, "first", "last", "n", "a", "b"), "runs")
    here = F.struct(*DOC, "first")
    intervals = stash.keep(runs.groupBy("n", "a", "b").agg(F.count("*").alias("m"), F.min(here).alias("origin")).where("m > 1"), "intervals")
    later = by_counts(runs, intervals, ["n", "a", "b"], total).where(F.col("origin") < here)

    in_order = Window.partitionBy(*DOC).orderBy("first", "last")
    so_far = F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    apart = later.withColumn("new", F.when(F.col("first") <= so_far, 0).otherwise(1)).withColumn("island", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    out = stash.keep(apart.groupBy(*DOC, "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island"), "found")
    stash.drop_all("found")
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text that is left, and two columns more: __lines (how many there were) and __removed (the numbers of those that went, from 0).

    All columns of docs stay; where docs has a column of one of these names, the new one
    gets more underscores. Null text stays null. Rows equal in id and text are one
    document and treated alike; a null id comes before all others. An empty table
    gives no rows.
    """
    key, copy, gone, n_lines, removed = unused(docs, "key", "copy", "gone", "__lines", "__removed")
    found = repeated_runs(docs, id_col, text_col, min_words).groupBy(F.col("id").alias(key), F.col("copy").alias(copy)).agg(F.collect_list(F.sequence("first", "last")).alias(gone))
    text = F.col(text_col).cast("string")
    keyed = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), copy: F.xxhash64(F.coalesce(text, F.lit("")))})
    # Shuffled at every size: the documents with repeats grow with the corpus.
    both = keyed.join(found.hint("shuffle_hash"), [key, copy], "left").withColumn(removed, F.array_sort(F.array_distinct(F.flatten(gone))))
    lines = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(removed))
    kept = F.when(F.col(removed).isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: lines[i]), "\n"))
    return both.select(*(kept.alias(c) if c == text_col else c for c in docs.columns), F.coalesce(F.size(lines), F.lit(0)).alias(n_lines), F.coalesce(removed, F.array().cast("array<int>")).alias(removed))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.size("__removed").cast("long").alias("n_removed"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


#: Two documents' equal lines on one diagonal, without a gap, are a run that both have; the later copy goes.
OP8_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), counted AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM lines
), pairs AS (
  SELECT a.doc_id AS d, a.i AS i, b.doc_id AS e, a.i - b.i AS diagonal, a.w AS w
  FROM counted a JOIN counted b ON a.line = b.line AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.i < a.i)
), islands AS (
  SELECT *, i - row_number() OVER (PARTITION BY d, e, diagonal ORDER BY i) AS island FROM pairs
), runs AS (
  SELECT *, sum(w) OVER (PARTITION BY d, e, diagonal, island) AS words FROM islands
), gone AS (SELECT DISTINCT d, i FROM runs WHERE words >= {MIN_WORDS})
SELECT c.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
  md5(coalesce(string_agg(c.line, chr(10) ORDER BY c.i) FILTER (WHERE g.i IS NULL), '')) AS text_md5
FROM counted c LEFT JOIN gone g ON c.doc_id = g.d AND c.i = g.i GROUP BY c.doc_id
"""
