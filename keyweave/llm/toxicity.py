"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, as_bytes, fold, small_batches, table

#: Punctuation parts words, and A-Z is lowered, in one pass over the bytes.
PLAIN = bytes(ord(" ") if c < 0x80 and not chr(c).isalnum() else c + 32 if ord("A") <= c <= ord("Z") else c for c in range(256))


@dataclass(frozen=True)
class Training:
    """The bound of the labelled sample, and the settings of the fit.

    positives: confirmed texts, drawn by a hash of the id, so many on average at any size
    of the corpus. All texts are the unlabelled ones. A word is a feature if its shares of the
    confirmed and of all texts lie min_z standard errors apart, whatever its rank.
    """

    positives: int = 4_000
    min_z: float = 6.0
    rounds: int = 80
    rate: float = 0.3
    decay: float = 1e-4
    slack: float = 0.0  # below minus this the estimated risk of the negatives is pushed up again


@dataclass
class Model:
    words: np.ndarray  # sorted 32-bit codes of words and beginnings
    weights: np.ndarray
    bias: float
    prior: float


#: Features that a task counts before it hands them on.
FLUSH = 1 << 22
#: Bytes of a word's beginnings that are features beside the word itself: inflected and compound forms share them.
BEGINNINGS = (5, 6, 7, 8)


def features(text: bytes) -> np.ndarray:
    """The distinct words of a text and their beginnings, as the CRC-32 of their lower-case bytes, in order."""
    words = {*text.translate(PLAIN).split()}
    parts = {w[:k] for k in BEGINNINGS for w in words if len(w) > k}
    codes = np.fromiter(map(crc32, words), np.uint32, len(words))
    return np.unique(np.concatenate([codes, ~np.fromiter(map(crc32, parts), np.uint32, len(parts))]))


def text_counts(docs: DataFrame) -> DataFrame:
    """(code, n_u, n_p): in how many of all docs (text, confirmed), and in how many confirmed ones, each feature occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[list[np.ndarray], list[np.ndarray]] = [], []

        def out() -> Iterator[pa.RecordBatch]:
            for i, lists in enumerate(kept):
                if lists:
                    codes, n = np.unique(np.concatenate(lists), return_counts=True)
                    yield _batch(code=codes.astype(np.int64), n_u=n * (1 - i), n_p=n * i)
                    lists.clear()

        size = 0
        for batch in batches:
            for text, confirmed in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                x = features(text)
                kept[0].append(x)
                if confirmed:
                    kept[1].append(x)
                size += len(x)
                if size > FLUSH:
                    yield from out()
                    size = 0
        yield from out()

    found = docs.select(F.col("text").cast("string"), "confirmed").mapInArrow(run, "code long, n_u long, n_p long")
    return found.groupBy("code").agg(F.sum("n_u").alias("n_u"), F.sum("n_p").alias("n_p"))


def telling(counts: DataFrame, n_u: int, n_p: int, min_z: float) -> np.ndarray:
    """The sorted codes of the features that tell confirmed texts from all.

    They are bounded though the counts are not: one that is rarer in confirmed texts must
    occur in min_z² of n_p texts, one that is more frequent in min_z of the n_p confirmed ones.
    """
    p, u = F.col("n_p") / max(1, n_p), (F.col("n_u") + 1) / (n_u + 2)
    # One text more or less may be chance even where the expected number is near none.
    error = F.sqrt((u * (1 - u) + 1 / max(1, n_p)) * (1 / max(1, n_p) + 1 / max(1, n_u)))
    return np.sort(counts.where(F.abs(p - u) >= min_z * error).select("code").toArrow()["code"].to_numpy().astype(np.uint32))


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


def encoded(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """(x, confirmed, n): how many docs (text, confirmed) have these of the words; x packs their 32-bit places in `words`."""
    known = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [places(known.value, features(t)).astype(np.int32).tobytes() for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], ["x", "confirmed"])

    found = docs.select(F.col("text").cast("string"), "confirmed").mapInArrow(run, "x binary, confirmed boolean")
    return found.groupBy("x", "confirmed").agg(F.count("*").alias("n"))


def places(words: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where in the sorted words those of x stand that are among them."""
    if not len(words):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(words, x), len(words) - 1)
    return at[words[at] == x]


#: What a round sums over texts, for each feature and, at their end, for the bias: slopes of calling a text clean over all
#: texts and over the confirmed ones, and of calling the confirmed ones toxic. The last row holds the losses of these.
SUMS = ("all_clean", "confirmed_clean", "confirmed_toxic")


def part_sums(rows: list[bytes], confirmed: np.ndarray, n: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The SUMS of some rows of encoded(), by the logistic loss: an array of 3 by len(weights) + 1. The bias is the last weight."""
    sizes = np.array([len(x) // 4 for x in rows], np.int64)
    column = np.frombuffer(b"".join(rows), np.int32)
    row = np.repeat(np.arange(len(rows)), sizes)
    score = weights[-1] + np.bincount(row, weights=weights[column], minlength=len(rows))
    p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    clean, toxic = np.logaddexp(0, score), np.logaddexp(0, -score)
    known = n * confirmed
    out = np.zeros((3, len(weights) + 1))
    for i, (slope, loss, times) in enumerate(((p, clean, n), (p, clean, known), (p - 1, toxic, known))):
        slope = slope * times
        out[i, : len(weights) - 1] = np.bincount(column, weights=slope[row], minlength=len(weights) - 1)
        out[i, -2:] = slope.sum(), (loss * times).sum()
    return out


def summed(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """The SUMS over all rows of encoded(). Tasks add up theirs, the sums of tasks meet by feature; as many rows as features reach the driver."""
    known = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(known.value) + 1))
        for batch in batches:
            total += part_sums(batch.column(0).to_pylist(), *(batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2)), known.value)
        yield _batch(j=np.arange(total.shape[1], dtype=np.int64), **dict(zip(SUMS, total, strict=True)))

    sums = rows.mapInArrow(run, "j long, " + ", ".join(f"{x} double" for x in SUMS))
    found = sums.groupBy("j").agg(*(F.sum(x).alias(x) for x in SUMS)).toArrow()
    known.destroy()
    out = np.zeros((3, len(weights) + 1))
    if len(found):
        out[:, found["j"].to_numpy()] = [found[x].to_numpy() for x in SUMS]
    return out


def risk(sums: np.ndarray, n_u: int, n_p: int, prior: float, slack: float = 0.0) -> tuple[float, np.ndarray]:
    """prior * R+(P) + max(0, R-(U) - prior * R-(P)) and the way to go, from the SUMS.

    R-(U) counts the toxic texts among the unlabelled as clean; the share `prior` of
    them is taken off again by what the confirmed ones would cost. Where that
    difference falls below -slack the fit has begun to remember single texts, and the
    step is taken against it instead.
    """
    clean = sums[0] / n_u - prior * sums[1] / n_p
    toxic = prior * sums[2] / n_p
    value = toxic[-1] + max(0.0, clean[-1])
    return float(value), (toxic + clean)[:-1] if clean[-1] >= -slack else -clean[:-1]


def fit(rows: DataFrame, words: np.ndarray, n_u: int, n_p: int, prior: float, t: Training = Training()) -> Model:
    """Weights that minimise the risk over all rows of encoded(), by Adam; each round is one pass of Spark over them."""
    if not n_u or not n_p or not len(words):
        p = min(max(prior, 1e-3), 0.49)
        return Model(np.zeros(0, np.uint32), np.zeros(0), float(np.log(p / (1 - p))), prior)
    w = np.zeros(len(words) + 1)
    w[-1] = -1.0
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, t.rounds + 1):
        grad = risk(summed(rows, w), n_u, n_p, prior, t.slack)[1]
        grad[:-1] += t.decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        rate = t.rate * (1 - (step - 1) / t.rounds)
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(words, w[:-1], float(w[-1]), prior)


def score(model: Model, texts: list[bytes]) -> np.ndarray:
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        out[i] = model.bias + model.weights[places(model.words, features(text))].sum()
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, t: Training = Training()) -> Model:
    """Fit on docs (doc_id, text) and labels (doc_id, toxic); the caller has taken out what must not be learned from.

    A document with several labels counts as toxic if one says so. Rows with a null id or label, and labels without a document,
    are not learned from. The prior is the toxic part of the labelled documents.
    """
    small_batches(docs.sparkSession)
    stash = Stash(docs.sparkSession)
    said = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = said.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    prior = (toxic or 0) / n if n else 0.0
    # About t.positives ids, whatever the size of the corpus.
    some = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, t.positives / max(1, toxic or 0)))
    confirmed = F.broadcast(said.where("toxic = 1").where(some).select(F.col("doc_id").alias("confirmed")))
    marked = docs.select("doc_id", "text").join(confirmed, F.col("doc_id") == F.col("confirmed"), "left").select("text", F.col("confirmed").isNotNull().alias("confirmed"))
    n_u, n_p = marked.agg(F.count("*"), F.count_if("confirmed")).first()
    words = telling(text_counts(marked), n_u, n_p, t.min_z)
    model = fit(stash.keep(encoded(marked, words), "encoded"), words, n_u, n_p, prior, t)
    stash.drop("encoded")
    return model


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row: the probability that the text is toxic, between 0 and 1.

    Null counts as an empty text and gets the score of a text without known words.
    Repeated rows score alike; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(known.value, as_bytes(batch.column(1))), pa.float64())], ["id", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, score double")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs.where(fold("doc_id", 5) != 0).select("doc_id", "text"), labels.where(fold("doc_id", 5) != 0).select("doc_id", "toxic"))
    found = scores(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
