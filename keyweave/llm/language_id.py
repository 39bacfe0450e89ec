"""Language of a document by a mixture of languages, fitted with expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, fold, small_batches, table, valid

#: n-grams are three bytes within a word and its borders, put into so many buckets.
BITS = 16
BUCKETS = 1 << BITS
#: Bytes that are turned into n-grams at a time.
PAGE = 1 << 20
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """smoothing: added to each n-gram's count. rounds: of expectation-maximisation.

    A further language must raise the log-likelihood by cost_log * ln(words) and by cost_share for each word: a
    part of any text fits some other language better by chance.
    """

    smoothing: float = 0.5
    rounds: int = 12
    cost_log: float = 1.0
    cost_share: float = 0.02


@dataclass
class Languages:
    names: list[str]
    logs: np.ndarray  # BUCKETS x languages, log probability of an n-gram


def _grams(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram, and where each word's n-grams begin. text: lower-case bytes that begin with a blank and end with one."""
    letter = (text >= 0x80) | (text >= ord("a")) & (text <= ord("z"))
    plain = np.where(letter, text, ord(" ")).astype(np.uint32)
    before = np.concatenate(([False], letter[:-1]))
    at = np.flatnonzero(letter | before)  # a word's bytes, and the blank after it
    starts = (letter & ~before)[at]
    # Nothing of the word before is looked at.
    code = np.where(starts, np.uint32(ord(" ")), plain[at - 2]) << 16 | plain[at - 1] << 8 | plain[at]
    first = np.flatnonzero(starts)
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS), first


def _pages(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Texts joined to pages: (how many bytes of the page belong to each text from the first on, bytes). A longer text is cut at blanks."""
    for i, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > PAGE:
                end = at + PAGE
                blank = text.rfind(b" ", at + PAGE // 2, end)
                end = blank if blank > 0 else end
            yield i, text[at:end]
            at = end
            if at >= len(text):
                break


def word_logs(texts: list[bytes], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood of each word under each language, number of words of each text)."""
    parts, counts = [np.zeros((0, logs.shape[1]), np.float32)], np.zeros(len(texts), np.int64)
    hold: list[tuple[int, bytes]] = []

    def flush() -> None:
        joined = b" ".join([b" ", *(t for _, t in hold), b" "])
        page = np.frombuffer(joined, np.uint8)
        grams, first = _grams(page)
        if len(first):
            parts.append(np.add.reduceat(logs[grams], first, axis=0))
            # Each piece begins one blank after the end of the one before.
            starts = 2 + np.concatenate(([0], np.cumsum([len(t) + 1 for _, t in hold])[:-1]))
            letter = (page >= 0x80) | (page >= ord("a")) & (page <= ord("z"))
            begins = np.flatnonzero(letter & ~np.concatenate(([False], letter[:-1])))
            owner = np.searchsorted(starts, begins, side="right") - 1
            np.add.at(counts, np.array([i for i, _ in hold])[owner], 1)
        hold.clear()

    size = 0
    for i, piece in _pages(texts):
        if size + len(piece) > PAGE and hold:
            flush()
            size = 0
        hold.append((i, piece))
        size += len(piece) + 1
    if hold:
        flush()
    return np.concatenate(parts), counts


def _fit(likely: np.ndarray, doc: np.ndarray, first: np.ndarray, n: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood above each word's best) of the texts when each may use its allowed languages."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for step in range(rounds + 1):
        mixed = likely * share[doc]
        total = np.maximum(mixed.sum(axis=1, keepdims=True), 1e-30)
        if step == rounds:
            return share, np.add.reduceat(np.log(total[:, 0]), first)
        share = np.add.reduceat(mixed / total, first, axis=0) / n[:, None]
    raise AssertionError


def mixtures(texts: list[bytes], known: Languages, s: Settings = Settings()) -> np.ndarray:
    """Proportions of the languages in each text, zero for a text without words and for languages that aren't selected.

    The most likely single language comes first. The others are added in the order of
    their proportions when all are allowed, as long as the penalised likelihood rises.
    """
    out = np.zeros((len(texts), len(known.names)))
    logs, counts = word_logs(texts, known.logs)
    has = np.flatnonzero(counts)
    if not len(has):
        return out
    n = counts[has]
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    best = logs.max(axis=1, keepdims=True)
    likely = np.exp(np.maximum(logs - best, -30)).astype(np.float64)
    alone = np.add.reduceat(logs - best, first, axis=0, dtype=np.float64)
    top = alone.argmax(axis=1)
    rows = np.arange(len(has))
    share = np.zeros((len(has), len(known.names)))
    share[rows, top] = 1
    reached = alone[rows, top]
    price = s.cost_log * np.log(n) + s.cost_share * n
    # A mixture can at best give each word its own best language, which is 0 here.
    live = np.flatnonzero(reached < -price)
    if len(live) and len(known.names) > 1:
        def of(which: np.ndarray) -> tuple[np.ndarray, ...]:
            at = np.concatenate([np.arange(first[i], first[i] + n[i]) for i in which])
            m = n[which]
            return likely[at], np.repeat(np.arange(len(which)), m), np.concatenate(([0], np.cumsum(m)[:-1])), m

        every, _ = _fit(*of(live), np.ones((len(live), len(known.names))), s.rounds)
        every[np.arange(len(live)), top[live]] = 2  # stays first
        order = np.argsort(-every, axis=1, kind="stable")
        for k in range(2, len(known.names) + 1):
            allowed = np.zeros((len(live), len(known.names)))
            np.put_along_axis(allowed, order[:, :k], 1, axis=1)
            found, fits = _fit(*of(live), allowed, s.rounds)
            better = fits > reached[live] + price[live]
            share[live[better]], reached[live[better]] = found[better], fits[better]
            live, order = live[better], order[better]
            if not len(live):
                break
    out[has] = share
    return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", s: Settings = Settings()) -> Languages:
    """n-gram counts of every language over all docs; texts and languages that are null are left out. BUCKETS counts per language reach the driver."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, n in counts.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])
            counts.clear()

        for batch in batches:
            of: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(pc.utf8_lower(batch.column(1))), strict=True):
                of.setdefault(lang, []).append(text)
            for lang, texts in of.items():
                n = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, piece in _pages([b" ".join(texts)]):
                    n += np.bincount(_grams(np.frombuffer(b"  " + piece + b" ", np.uint8))[0], minlength=BUCKETS)
            if len(counts) > 64:
                yield from out()
        yield from out()

    picked = docs.select(valid(lang_col).alias("lang"), valid(text_col).alias("text")).where("lang is not null and text is not null")
    found = picked.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names, of = np.unique(found["lang"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True) if found.num_rows else (np.zeros(0, str), np.zeros(0, int))
    counts = np.full((BUCKETS, len(names)), s.smoothing)
    if found.num_rows:
        counts[found["bucket"].to_numpy(), of] += found["n"].to_numpy()
    return Languages([str(x) for x in names], np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32))


def predict(docs: DataFrame, known: Languages, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """(id, lang_pred, score, proportions) for every row: the language with the largest proportion, that proportion, and all above zero.

    A null text, one without a letter, and any text where nothing was learned, gets `und`
    and 0. Among equal proportions the first name wins. Repeated rows are judged alike; an
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            texts = [t if has else b"" for t, has in zip(as_bytes(pc.utf8_lower(batch.column(1))), batch.column(2).to_pylist(), strict=True)]
            found = mixtures(texts, m, s) if m.names else np.zeros((len(texts), 1))
            some, top = found.sum(axis=1) > 0, found.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([m.names[t] if y else UNKNOWN for y, t in zip(some, top, strict=True)], pa.string()),
                    pa.array(np.minimum(1.0, found.max(axis=1)), pa.float64()),
                    pa.array([[(m.names[i], float(row[i])) for i in np.flatnonzero(row)] for row in found], pa.map_(pa.string(), pa.float64())),
                ],
                ["id", "lang_pred", "score", "proportions"],
            )

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(valid(text_col), F.lit("")).alias("text"))
    picked = picked.withColumn("has", F.col("text").rlike(r"\p{L}"))
    return picked.mapInArrow(run, "id long, lang_pred string, score double, proportions map<string, double>")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = train(docs.where(fold("doc_id", 5) != 0).select("text", "lang"))
    found = predict(docs.select("doc_id", "text"), known).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
