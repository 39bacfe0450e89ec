"""Language-model scores by prediction by partial matching over bytes, beside a unigram model of words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stash, as_bytes, fold, small_batches, table

#: Bytes of the longest context.
ORDER = 5
#: Stands before a text's first byte and after its last; it occurs in no UTF-8 text.
END = 0xFF
#: The longest entries of the trie whose probabilities every task holds; the other bytes of a text are joined.
ENTRIES = 1 << 21
#: Bytes of a context and the byte after it, of which every task holds all counts; their number is bounded by the bytes, not by the corpus.
LOW = 3
#: Words whose counts every task holds; the other words are joined.
FREQUENT = 1 << 17
#: Bytes that are turned into contexts at a time, and distinct entries that a task holds before it hands them on.
PAGE = 1 << 20
FLUSH = 1 << 20


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of some lower-case texts and their ends: the ORDER bytes before it and itself, as one number; and where each text begins.

    A text begins after ORDER ends, of which the first is that of the text before it.
    """
    gap = bytes([END]) * ORDER
    s = np.frombuffer(gap + gap.join(texts) + gap, np.uint8).astype(np.uint64)
    n = len(s) - ORDER
    key = s[:n]
    for k in range(1, ORDER + 1):
        key = key << np.uint64(8) | s[k : k + n]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes + ORDER)[:-1]))
    own = np.ones(n, bool)
    for k in range(1, ORDER):
        own[np.minimum(starts + sizes + k, n)[:-1]] = False
    own[starts[-1] + sizes[-1] + 1 :] = False
    return key[own], np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))


def pages(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in groups of about PAGE bytes; a longer one is alone."""
    page: list[bytes] = []
    size = 0
    for text in texts:
        if page and size + len(text) > PAGE:
            yield page
            page, size = [], 0
        page.append(text)
        size += len(text)
    if page:
        yield page


def _tally(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(key, word, n) over all docs (text): counts of grams() where word is null, counts of words where key is null.

    The end of a text is the word of a single byte END.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def out_words() -> Iterator[pa.RecordBatch]:
            yield _rows([None] * len(words), list(words), list(words.values()))
            words.clear()

        def out_grams() -> Iterator[pa.RecordBatch]:
            if parts:
                keys, n = _tally(parts)
                yield _rows(keys.astype(np.int64), [None] * len(keys), n)
                parts.clear()

        for batch in batches:
            texts = [t.lower() for t in as_bytes(batch.column(0))]
            for text in texts:
                words.update(text.split())
            words[bytes([END])] += len(texts)
            parts += [_runs(grams(page)[0]) for page in pages(texts)]
            if sum(len(k) for k, _ in parts) > FLUSH:
                parts = [_tally(parts)]
                if len(parts[0][0]) > FLUSH:
                    yield from out_grams()
            if len(words) > FLUSH // 4:
                yield from out_words()
        yield from out_words()
        yield from out_grams()

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, word binary, n long")
    return found.groupBy("key", "word").agg(F.sum("n").alias("n"))


def _rows(keys: list | np.ndarray, words: list, n: list | np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["key", "word", "n"])


class Slots:
    """A hash table of keys with their log10 probability; nan for a key that it doesn't have."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        self.keys, self.logs = keys, logs.astype(np.float32)

    @cached_property
    def _slots(self) -> tuple[np.ndarray, np.ndarray, int]:
        keys = self.keys
        bits = max(4, int(2 * len(keys)).bit_length())
        slot_keys, slot_logs = np.full(1 << bits, ~np.uint64(0)), np.zeros(1 << bits, np.float32)
        todo, at = np.arange(len(keys)), self._home(keys, bits)
        while len(todo):
            free = slot_keys[at] == ~np.uint64(0)
            slot_keys[at[free]] = keys[todo[free]]  # of those for one slot the last stays
            won = slot_keys[at] == keys[todo]
            slot_logs[at[won]] = self.logs[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & ((1 << bits) - 1)
        return slot_keys, slot_logs, bits

    @staticmethod
    def _home(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot_keys, slot_logs, bits = self._slots
        at = self._home(keys, bits)
        out = slot_logs[at].astype(np.float64)
        todo = np.flatnonzero(slot_keys[at] != keys)
        at = at[todo]
        while len(todo):
            here = slot_keys[at]
            hit, empty = here == keys[todo], here == ~np.uint64(0)
            out[todo[hit]] = slot_logs[at[hit]]
            out[todo[empty]] = np.nan
            go = ~(hit | empty)
            todo, at = todo[go], (at[go] + 1) & ((1 << bits) - 1)
        return out


class Trie:
    """Counts by order: sorted keys of a context followed by a byte, and how often each was seen.

    If a context had a byte, so had each of its endings, as often at least. That makes
    the symbols that a context excludes a subset of those of the next shorter one, and
    all that an escape needs can be stored with the context that is left.
    """

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray]]):
        self.orders = orders

    @cached_property
    def contexts(self) -> list[dict[str, np.ndarray]]:
        """For each order: sorted contexts with the log10 of their total (z) and escape (e), and of those that hold in the next shorter context after escaping (z_next, e_next)."""
        out = []
        for k, (keys, n) in enumerate(self.orders):
            ctx = keys >> np.uint64(8)
            first = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(ctx) else np.zeros(0, int)
            total, kinds = (np.add.reduceat(n, first), np.diff(np.append(first, len(ctx)))) if len(first) else (n, n)
            c = {"ctx": ctx[first], "z": np.log10(total + kinds), "e": np.log10(kinds / (total + kinds))}
            if k:
                shorter, counts = self.orders[k - 1]
                mask = np.uint64((1 << 8 * k) - 1)
                excluded = np.add.reduceat(counts[np.searchsorted(shorter, keys & mask)], first) if len(first) else n
                lower = out[-1]
                at = np.searchsorted(lower["ctx"], c["ctx"] & np.uint64((1 << 8 * (k - 1)) - 1))
                left, left_kinds = lower["total"][at] - excluded, lower["kinds"][at] - kinds
                rest = np.maximum(left + left_kinds, 1)
                # With nothing left the shorter context is passed over at no cost.
                c["z_next"], c["e_next"] = np.log10(rest), np.where(left_kinds > 0, np.log10(np.maximum(left_kinds, 1) / rest), 0.0)
            c["total"], c["kinds"] = total, kinds
            out.append(c)
        return out

    @cached_property
    def _longest(self) -> Slots:
        """The longest entries: most bytes need one look there."""
        keys, n = self.orders[-1]
        top = self.contexts[-1]
        return Slots(keys, np.log10(np.maximum(n, 1)) - top["z"][np.searchsorted(top["ctx"], keys >> np.uint64(8))])

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last byte of each key after its other bytes."""
        out = self._longest(keys)
        rest = np.flatnonzero(np.isnan(out))
        if len(rest):
            out[rest] = self._escaped(keys[rest])
        return out

    def _escaped(self, keys: np.ndarray) -> np.ndarray:
        """The same for keys that the longest contexts don't have, from the longest context that was seen down to the empty one."""
        out = np.zeros(len(keys))
        live = np.arange(len(keys))
        z_next, e_next = np.full(len(keys), np.nan), np.zeros(len(keys))  # nan: no context was left yet
        for k in range(len(self.orders) - 1, -1, -1):
            grams_, n = self.orders[k]
            c = self.contexts[k]
            gram = keys[live] & np.uint64((1 << 8 * (k + 1)) - 1)
            ctx = gram >> np.uint64(8)
            at = np.minimum(np.searchsorted(c["ctx"], ctx), max(0, len(c["ctx"]) - 1))
            seen = c["ctx"][at] == ctx if len(c["ctx"]) else np.zeros(len(ctx), bool)
            found_at = np.minimum(np.searchsorted(grams_, gram), max(0, len(grams_) - 1))
            found = grams_[found_at] == gram if len(grams_) else np.zeros(len(gram), bool)
            first = np.isnan(z_next[live])
            if found.any():
                i = live[found]
                z = np.where(first[found], c["z"][at[found]], z_next[i])
                out[i] += np.log10(n[found_at[found]]) - z
            left = seen & ~found
            i = live[left]
            out[i] += np.where(first[left], c["e"][at[left]], e_next[i])
            if k and len(i):
                z_next[i], e_next[i] = c["z_next"][at[left]], c["e_next"][at[left]]
            live = live[~found]
        # What no text had: all other byte values alike.
        others = 256 - len(self.orders[0][0])
        out[live] -= np.log10(max(1, others))
        return out

    def scores(self, texts: list[bytes]) -> list[float]:
        """log10 of the probability of each lower-case text and its end."""
        out: list[float] = []
        for page in pages(texts):
            keys, starts = grams(page)
            logs = np.concatenate([self.logs(keys[at : at + PAGE]) for at in range(0, len(keys), PAGE)])
            out += np.add.reduceat(logs, starts).tolist()
        return out


def _least(df: DataFrame, want: int) -> int:
    """The least power of two so that at most `want` rows have such an n."""
    sizes = df.select(F.floor(F.log2("n")).cast("int").alias("log")).groupBy("log").count().collect()
    left, least = sum(r["count"] for r in sizes), 1
    for r in sorted(sizes, key=lambda r: r["log"]):
        if left <= want:
            break
        left, least = left - r["count"], 2 << r["log"]
    return least


def train_trie(counts: DataFrame, entries: int = ENTRIES) -> Trie:
    """The trie of the counts (key, n) of grams() in one place, without its rarest entries if there are more than `entries`."""
    by_order = None
    for k in range(ORDER, -1, -1):
        rows = counts.select(F.lit(k).alias("k"), F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("key"), "n")
        rows = rows.groupBy("k", "key").agg(F.sum("n").alias("n")) if k < ORDER else rows
        by_order = rows if by_order is None else by_order.union(rows)
    stash = Stash(counts.sparkSession)
    by_order = stash.keep(by_order, "orders")
    kept = by_order.where(F.col("n") >= _least(by_order, entries)).toArrow()
    stash.drop("orders")
    order, keys, n = (kept[x].to_numpy() for x in ("k", "key", "n"))
    out = []
    for k in range(ORDER + 1):
        own, m = keys[order == k].astype(np.uint64), n[order == k]
        at = np.argsort(own)
        out.append((own[at], m[at]))
    return Trie(out)


def frequent_entries(counts: DataFrame) -> Slots:
    """The most frequent of the counts (key, n) of grams(), ENTRIES at most, with the probability that the whole trie gives them."""
    least = _least(counts, ENTRIES)
    ctx = Window.partitionBy(F.shiftright("key", 8))
    z = F.log10(F.sum("n").over(ctx) + F.count("*").over(ctx))
    found = counts.withColumn("z", z).where(F.col("n") >= least).select("key", (F.log10("n") - F.col("z")).alias("log")).toArrow()
    return Slots(found["key"].to_numpy().astype(np.uint64), found["log"].to_numpy())


def _shorter(keys: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return _tally([(keys & np.uint64((1 << 8 * size) - 1), n)])


def resolved(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, log) for each distinct key of wanted, by the whole trie of the counts (key, n) of grams().

    All contexts of LOW bytes or more from which a byte is sought end alike, so rows
    meet by those bytes; the shorter contexts are few and reach every task.
    """
    end = (1 << 8 * LOW) - 1
    low = counts.groupBy(F.col("key").bitwiseAND(F.lit(end)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    low_keys, low_n = low["key"].to_numpy().astype(np.uint64), low["n"].to_numpy()
    short = counts.sparkSession.sparkContext.broadcast([_shorter(low_keys, low_n, k + 1) for k in range(LOW)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _whole_ends(batches):
            seek, had = keys[n == 0], n > 0
            keys, n = keys[had], n[had]
            needed = np.isin(keys >> np.uint64(8) & np.uint64(end), np.unique(seek >> np.uint64(8) & np.uint64(end)))
            longer = [_shorter(keys[needed], n[needed], k + 1) for k in range(LOW, ORDER + 1)]
            logs = Trie([*short.value, *longer])._escaped(seek)
            yield pa.RecordBatch.from_arrays([pa.array(seek.astype(np.int64)), pa.array(logs, pa.float64())], ["key", "log"])

    # A count of 0 marks what is sought.
    rows = counts.select("key", "n").union(wanted.select("key").distinct().select("key", F.lit(0).cast("long").alias("n")))
    rows = rows.withColumn("end", F.shiftright("key", 8).bitwiseAND(F.lit(end)))
    return rows.repartition("end").sortWithinPartitions("end").mapInArrow(run, "key long, log double")


def _whole_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of batches (key, n, end) sorted by end, some FLUSH rows at a time, cut only where another end begins."""
    parts: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        parts.append([batch.column(i).to_numpy() for i in range(3)])
        size += len(batch)
        if size > FLUSH:
            key, n, end = (np.concatenate(x) for x in zip(*parts, strict=True))
            at = int(np.searchsorted(end, end[-1]))
            if at:
                yield key[:at].astype(np.uint64), n[:at]
            parts, size = [[key[at:], n[at:], end[at:]]], 0
    if parts:
        key, n, _ = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield key.astype(np.uint64), n


def held_scores(held: Slots, texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """For each lower-case text: the sum over the bytes that are held, and the others' distinct keys with their number."""
    scores, of, missed, m = [], [], [], []
    before = 0
    for page in pages(texts):
        keys, starts = grams(page)
        logs = np.concatenate([held(keys[at : at + PAGE]) for at in range(0, len(keys), PAGE)])
        at = np.flatnonzero(np.isnan(logs))
        logs[at] = 0
        scores.append(np.add.reduceat(logs, starts))
        text, rest = np.searchsorted(starts, at, "right") - 1, keys[at]
        order = np.lexsort((rest, text))
        text, rest = text[order], rest[order]
        first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (rest[1:] != rest[:-1])))) if len(at) else at
        of.append(text[first] + before)
        missed.append(rest[first].astype(np.int64))
        m.append(np.diff(np.append(first, len(at))))
        before += len(page)
    offsets = np.searchsorted(np.concatenate(of), np.arange(before + 1))
    pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(missed)), pa.array(np.concatenate(m), pa.int64())], ["key", "m"])
    return np.concatenate(scores), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)


FIGURES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def language_model_scores(docs: DataFrame, learn_from: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, FIGURES) for every row of docs, learned from the column `text` of learn_from.

    n_tokens counts a text's words and its end, n_known those that were learned;
    base_score is the unigram model's log10 probability with one added to every count,
    score that of the byte model. Texts are lower-cased in A-Z; null counts as an empty
    text, which still has its end. Repeated rows are scored alike. With nothing to
    learn from every byte is equally likely. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    stash = Stash(spark)
    counts = stash.keep(corpus_counts(learn_from), "counts")
    words = counts.where("word is not null").select("word", "n")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = words.where(F.col("n") >= _least(words, FREQUENT)).toArrow()
    often = dict(zip(frequent["word"].to_pylist(), frequent["n"].to_pylist(), strict=True))
    often.setdefault(bytes([END]), 0 if not n else words.where(F.col("word") == F.lit(bytearray([END]))).first()["n"])
    entries = counts.where("key is not null").select("key", "n")
    known = spark.sparkContext.broadcast((frequent_entries(entries), often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, often = known.value
        end = often[bytes([END])]
        for batch in batches:
            rows = []
            texts = [t.lower() for t in as_bytes(batch.column(2))]
            if not texts:
                continue
            scores, missed = held_scores(held, texts)
            for text, score in zip(texts, scores.tolist(), strict=True):
                here = Counter(text.split())
                rare = [w for w in here if w not in often]
                common = [(m, c) for w, m in here.items() if (c := often.get(w)) is not None]
                m, c = np.array([x for x, _ in common], float), np.array([x for _, x in common], float)
                rows.append((sum(here.values()) + 1, int(m.sum()) + (end > 0), float((m * np.log10(c + 1)).sum() + np.log10(end + 1)), score, [{"word": w, "m": here[w]} for w in rare]))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("m", pa.int64())]))]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)), missed], ["uid", "id", "n_tokens", "n_often", "sum_often", "held", "rare", "missed"]
            )

    picked = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = "uid long, id long, n_tokens long, n_often long, sum_often double, held double, rare array<struct<word: binary, m: long>>, missed array<struct<key: long, m: long>>"
    scored = stash.keep(picked.mapInArrow(run, kinds), "scored")
    # No word or entry among these is frequent in what was learned, so no key of the joins is hot.
    rare = scored.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.m").join(words, "word")
    rare = rare.select("uid", "m", (F.col("m") * F.log10(F.col("n") + 1)).alias("sum"), F.lit(0.0).alias("score"))
    missed = scored.select("uid", F.explode("missed").alias("r")).select("uid", "r.key", "r.m")
    logs = stash.keep(resolved(entries, missed), "logs")
    missed = missed.join(logs, "key").select("uid", F.lit(0).cast("long").alias("m"), F.lit(0.0).alias("sum"), (F.col("m") * F.col("log")).alias("score"))
    joined = rare.union(missed).groupBy("uid").agg(F.sum("m").alias("n_rare"), F.sum("sum").alias("sum_rare"), F.sum("score").alias("rest"))
    both = scored.drop("rare", "missed").join(joined, "uid", "left")
    spread = float(np.log10(n + v + 1))
    return both.select(
        "id",
        "n_tokens",
        (F.col("n_often") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("sum_often") + F.coalesce("sum_rare", F.lit(0.0)) - F.col("n_tokens") * spread).alias("base_score"),
        (F.col("held") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_model_scores(docs, docs.where(fold("doc_id", 7) != 2)).withColumnRenamed("id", "doc_id")
    return found.withColumn("held_out", fold("doc_id", 7) == 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
