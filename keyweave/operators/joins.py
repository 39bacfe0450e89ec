"""Inner joins of R, whose key is unique, with S, which refers to it. Every strategy gives the same rows."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.hashes import hashed, partition_id
from ..plans.layout import Layout, plan
from .routing import built, probing, routes
from .statistics import top_keys

STRATEGIES = ("auto", "nbj", "smj", "ghj", "dhh", "dhh_skew", "ocap", "ocap_hybrid", "correlated", "correlated_hybrid")
#: Bytes of R that are broadcast at a time, as measured before. Chunks of R that are broadcast in one plan count together: the driver builds and holds them all.
CHUNK_BYTES = 64 << 20
#: Passes over S beyond which both sides are hashed instead.
PASSES = 4
#: Tracked keys at most, whatever the strategy asks for.
TRACKED = 50_000
#: The part of S in which frequent keys are sought where the counts of all keys aren't needed.
SAMPLE = 1 / 16
#: A key is tracked from this part of a partition's share of rows on.
WORTH = 1 / 16
#: Parts of the keys, of which as many stay at hand as there is room for.
PARTS = 64
#: Rows of both sides, about, that come together in a partition where `enough` tells how many there are.
ROWS = 1 << 19


@dataclass
class Choice:
    """What a strategy made of a join."""

    how: str = ""


def plain(r: DataFrame, s: DataFrame, r_key: str, s_key: str, hint: str | None = None) -> DataFrame:
    return (r.hint(hint) if hint else r).join(s, r[r_key] == s[s_key])


def unique_key(r: DataFrame, r_key: str) -> None:
    """Raise if a key of R is repeated."""
    twice = r.where(F.col(r_key).isNotNull()).groupBy(r_key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{r_key} is not unique: {twice[0][0]} occurs {twice[0][1]} times")


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a relation: what its texts hold, and eight bytes for every column and sixteen for every row."""
    texts = [F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary") or "<" in kind]
    rows, held = df.agg(F.count("*"), reduce(lambda a, b: a + b, texts, F.lit(0))).first()
    return rows, held + rows * (16 + 8 * len(df.columns))


def nested_blocks(r: DataFrame, s: DataFrame, r_key: str, s_key: str, chunk_bytes: int = CHUNK_BYTES, choice: Choice | None = None) -> DataFrame:
    """R in chunks of about chunk_bytes, each broadcast to one pass over S. With more than PASSES of them, or more than CHUNK_BYTES in all, both sides are hashed instead."""
    choice = choice or Choice()
    held = measured(r)[1]
    chunks = max(1, ceil(held / chunk_bytes))
    if chunks > PASSES or held > CHUNK_BYTES:
        return grace_hash(r, s, r_key, s_key, choice=choice)
    choice.how = f"R broadcast in {chunks} chunks"
    if chunks == 1:
        return plain(F.broadcast(r), s, r_key, s_key)
    parts = [r.where(partition_id(F.col(r_key), chunks) == i) for i in range(chunks)]
    return reduce(DataFrame.unionByName, [plain(F.broadcast(p), s, r_key, s_key) for p in parts])


def sort_merge(r: DataFrame, s: DataFrame, r_key: str, s_key: str) -> DataFrame:
    """Both sides sorted. S comes first: Spark holds the rows of the second side that have the key at hand, one row of R, not all of S with a hot key."""
    return s.join(r.hint("merge"), r[r_key] == s[s_key]).select(*(r[c] for c in r.columns), *(s[c] for c in s.columns))


def grace_hash(r: DataFrame, s: DataFrame, r_key: str, s_key: str, partitions: int | None = None, choice: Choice | None = None) -> DataFrame:
    """Both sides hashed by key, a hash table of R in each partition."""
    (choice or Choice()).how = "both sides hashed"
    if partitions:
        r, s = r.repartition(partitions, r_key), s.repartition(partitions, s_key)
    return plain(r, s, r_key, s_key, "shuffle_hash")


def enough(*sides: DataFrame) -> int:
    """Partitions by key in which about ROWS rows of all sides come together, whatever number the session has and however few bytes the rows are once compressed."""
    return max(1, ceil(sum(df.count() for df in sides) / ROWS))


def hot_and_cold(r: DataFrame, s: DataFrame, r_key: str, s_key: str, hot: DataFrame) -> DataFrame:
    """Rows of S with a hot key (column `key`, few enough to broadcast) meet a broadcast of R's rows; the others are shuffled. No hot row is shuffled.

    Rows of S are marked by the very join that gives the hot rows' results. Hot rows of R
    may stay among the cold ones, where no row of S meets them.
    """
    hot_r = F.broadcast(r.join(F.broadcast(hot.select("key")), r[r_key] == F.col("key"), "left_semi").withColumn("__hot", F.lit(True)))
    marked = s.join(hot_r, hot_r[r_key] == s[s_key], "left")
    own, theirs = [s[c] for c in s.columns], [hot_r[c] for c in r.columns]
    cold = marked.where("__hot is null").select(*own)
    return marked.where("__hot").select(*theirs, *own).unionByName(plain(r, cold, r_key, s_key, "shuffle_hash"))


def hybrid_hash(r: DataFrame, s: DataFrame, r_key: str, s_key: str, room: int = CHUNK_BYTES, choice: Choice | None = None) -> DataFrame:
    """Of PARTS parts of the keys, by hash, as many are broadcast as R has room for in `room` bytes: their rows of S aren't shuffled. The others are hashed."""
    choice = choice or Choice()
    kept = min(PARTS, PARTS * room // max(1, measured(r)[1]))
    if not kept:
        return grace_hash(r, s, r_key, s_key, choice=choice)
    choice.how = f"{kept} of {PARTS} parts of R broadcast, the others hashed"
    if kept == PARTS:
        return plain(F.broadcast(r), s, r_key, s_key)
    stays = lambda df, key: partition_id(F.col(key), PARTS) < kept
    at_hand = plain(F.broadcast(r.where(stays(r, r_key))), s.where(stays(s, s_key)), r_key, s_key)
    return at_hand.unionByName(plain(r.where(~stays(r, r_key)), s.where(~stays(s, s_key)), r_key, s_key, "shuffle_hash"))


def frequent(s: DataFrame, s_key: str, k: int, part: float = 1.0) -> tuple[list, np.ndarray, int]:
    """(keys, rows of each, all rows) of the k most frequent keys of S, the most frequent first, in one pass over it; from a part of its rows, scaled up, if part is below 1."""
    keys = s.select(F.col(s_key).alias("key"))
    # Before anything else, so that a key which is computed is computed for these rows only.
    keys = keys.sample(False, part, 1) if part < 1 else keys
    seen = Observation()
    counts = keys.where("key is not null").groupBy("key").agg(F.count("*").alias("m")).observe(seen, F.coalesce(F.sum("m"), F.lit(0)).alias("rows"))
    top = top_keys(counts, k).collect()
    return [x["key"] for x in top], np.array([x["m"] for x in top], float) / part, round(seen.get["rows"] / part)


def skew_aware(
    r: DataFrame, s: DataFrame, r_key: str, s_key: str, keys: int = 1024, least: float = 0.01, room: int = CHUNK_BYTES, choice: Choice | None = None
) -> DataFrame:
    """Hash join that keeps the rows of R with the most frequent keys at hand, if those keys have the part `least` of S."""
    choice = choice or Choice()
    top, m, rows = frequent(s, s_key, keys, SAMPLE)
    heavy = [x for x, n in zip(top, m, strict=True) if n * keys > rows]  # more than a `keys`-th each, so never more than that many
    if sum(m[: len(heavy)]) < least * max(1, rows):
        return hybrid_hash(r, s, r_key, s_key, room, choice)
    choice.how = f"{len(heavy)} hot keys broadcast, the others hashed"
    return hot_and_cold(r, s, r_key, s_key, r.sparkSession.createDataFrame([(x,) for x in heavy], f"key {s.schema[s_key].dataType.simpleString()}"))


def semi_reduced(r: DataFrame, s: DataFrame, r_key: str, s_key: str) -> DataFrame:
    """Rows of R that nothing refers to are dropped before they are shuffled with their payload."""
    referred = s.select(F.col(s_key).alias("__k")).where("__k is not null").distinct()
    return plain(r.join(referred, r[r_key] == referred["__k"], "left_semi"), s, r_key, s_key)


def correlation_aware(
    r: DataFrame, s: DataFrame, r_key: str, s_key: str, k: int = TRACKED, hybrid: bool = True, exact: bool = False, fn: str = "xxhash64", choice: Choice | None = None
) -> DataFrame:
    """Frequent keys get the partitions that a layout names, the others are hashed.

    exact counts every key of S and tracks the k most frequent ones. Otherwise a part of
    S tells which keys are worth tracking, k at most: those with some part of a
    partition's share of rows. Without any, both sides are simply hashed. Which keys
    are tracked changes where rows go, never what comes out.
    """
    spark, choice = r.sparkSession, choice or Choice()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys, m, s_rows = frequent(s, s_key, min(k, TRACKED) if exact else min(k, TRACKED, ceil(n / WORTH)), 1.0 if exact else SAMPLE)
    r_rows = r.count()
    if not exact:
        worth = int((m * n > WORTH * (r_rows + s_rows)).sum())
        keys, m = keys[:worth], m[:worth]
    if not keys:
        return grace_hash(r, s, r_key, s_key, choice=choice)
    layout: Layout = plan(m, r_rows, s_rows, n, hybrid)
    choice.how = str(layout)
    known = routes(spark, keys, layout, s.schema[s_key].dataType.simpleString())
    left = built(r.where(F.col(r_key).isNotNull()), r_key, known, layout, fn)
    right = probing(s, s_key, known, layout, fn)
    return left.hint("shuffle_hash").join(right, (left["__route"] == right["__to"]) & (left[r_key] == right[s_key])).drop("__route", "__to")


def join_pkfk(
    r: DataFrame, s: DataFrame, r_key: str, s_key: str, strategy: str = "auto", k: int = TRACKED, room: int = CHUNK_BYTES, partitions: int | None = None,
    fn: str = "xxhash64", check_unique: bool = False, choice: Choice | None = None,
) -> DataFrame:
    """R and S joined on r_key = s_key by the named strategy. Null keys meet nothing.

    auto broadcasts R if it has room in `room` bytes and otherwise looks for frequent keys. choice tells, afterwards, what was done.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy named {strategy}; there are {', '.join(STRATEGIES)}")
    hashed(F.lit(1), fn)  # an unknown name fails here
    choice = choice or Choice()
    if check_unique:
        unique_key(r, r_key)
    if strategy == "auto":
        strategy = "nbj" if measured(r)[1] <= room else "correlated_hybrid"
    if strategy == "nbj":
        return nested_blocks(r, s, r_key, s_key, choice=choice)
    if strategy == "smj":
        choice.how = "both sides sorted"
        return sort_merge(r, s, r_key, s_key)
    if strategy == "ghj":
        return grace_hash(r, s, r_key, s_key, partitions, choice)
    if strategy == "dhh":
        return hybrid_hash(r, s, r_key, s_key, room, choice)
    if strategy == "dhh_skew":
        return skew_aware(r, s, r_key, s_key, room=room, choice=choice)
    return correlation_aware(r, s, r_key, s_key, k, strategy.endswith("hybrid"), strategy.startswith("ocap"), fn, choice)


@dataclass(frozen=True)
class JoinReport:
    strategy: str
    how: str
    r_rows: int
    s_rows: int
    rows: int
    seconds: float


def reported(r: DataFrame, s: DataFrame, r_key: str, s_key: str, strategy: str, sink: Callable[[DataFrame], None], **options) -> JoinReport:
    """Join, hand the result to `sink`, which writes it, and tell what was done, how many rows there were and how long it took, choosing included."""
    choice, seen, began = Choice(), Observation(), time.perf_counter()
    sink(join_pkfk(r, s, r_key, s_key, strategy, choice=choice, **options).observe(seen, F.count("*").alias("rows")))
    took = time.perf_counter() - began
    return JoinReport(strategy, choice.how, r.count(), s.count(), seen.get["rows"], took)
