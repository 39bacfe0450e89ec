"""Quality rules: how far a document's characters and common words lie from its language's."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, as_bytes, small_batches, table, unused, valid

#: Classes of a code point, told by its first UTF-8 byte. Fixed values, in this order.
CLASSES = ["lower", "upper", "digit", "space", "stop", "symbol", "other_ascii", "beyond_ascii"]
STOPS = b".,;:!?'\"()-"
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"


def _byte_classes() -> np.ndarray:
    of = np.full(256, CLASSES.index("other_ascii"))
    of[0xC0:] = CLASSES.index("beyond_ascii")
    of[0x80:0xC0] = len(CLASSES)  # the rest of a code point, counted with its first byte
    of[ord("a") : ord("z") + 1] = CLASSES.index("lower")
    of[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    of[ord("0") : ord("9") + 1] = CLASSES.index("digit")
    for name, chars in (("stop", STOPS), ("symbol", SYMBOLS), ("space", SPACES)):
        of[list(chars)] = CLASSES.index(name)
    return of


BYTE_CLASS = _byte_classes()


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. min_*: a text shorter than this has too little to compare, so the distance isn't held against it."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    common_share: float = 0.002  # a common word is at least so large a part of its language's words: 1 / common_share words at most
    min_chars: int = 200
    max_char_distance: float = 0.30
    min_common_words: int = 60
    max_word_distance: float = 0.45


@dataclass
class Reference:
    """A language's shares of character classes, and of its common words with all other words last."""

    chars: np.ndarray
    words: dict[bytes, int] = field(default_factory=dict)
    shares: np.ndarray = field(default_factory=lambda: np.ones(1))


def char_counts(text: bytes) -> np.ndarray:
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    return np.bincount(BYTE_CLASS, weights=by_byte, minlength=len(CLASSES) + 1)[: len(CLASSES)].astype(np.int64)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance with logarithms to base 2: 0 for equal, 1 for disjoint distributions."""
    m = (p + q) / 2

    def half(x: np.ndarray) -> float:
        at = x > 0
        return float(np.sum(x[at] * np.log2(x[at] / m[at])))

    return float(np.sqrt(min(1.0, max(0.0, (half(p) + half(q)) / 2))))


def repeat_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window of so many words which the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    key, kinds = ids[:n], len(names)
    for j in range(1, window):  # the kinds of each length are numbered anew before the product could overflow
        if kinds >= (1 << 62) // len(names):
            key, kinds = _numbered(key)
        key, kinds = key * len(names) + ids[j : j + n], kinds * len(names)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int(np.count_nonzero(np.cumsum(edge)))


def _numbered(key: np.ndarray) -> tuple[np.ndarray, int]:
    kinds, at = np.unique(key, return_inverse=True)
    return at, len(kinds)


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    full = [x for x in lines if x.strip(SPACES)]
    return len(full) - len(set(full))


def measure(text: bytes, reference: Reference | None, rules: Rules) -> tuple[int, int, int, int, int, bool, float | None, float | None, bool]:
    """The base figures, base_failed, the two distances (null where the text is too short or has no reference) and kept."""
    words, chars = text.split(), char_counts(text)
    n = len(words)
    repeated = repeat_words(words, rules.window)
    failed = n < rules.min_words or 100 * repeated > rules.max_repeat_percent * n
    by_char = by_word = None
    if reference is not None and chars.sum() >= rules.min_chars:
        by_char = js_distance(chars / chars.sum(), reference.chars)
    if reference is not None and n >= rules.min_common_words:
        at = np.fromiter((reference.words.get(w, -1) for w in words), np.int64, n)
        by_word = js_distance(np.bincount(np.where(at < 0, len(reference.words), at), minlength=len(reference.shares)) / n, reference.shares)
    kept = not failed and (by_char or 0) <= rules.max_char_distance and (by_word or 0) <= rules.max_word_distance
    n_chars = int(chars.sum() - chars[CLASSES.index("space")])
    return n, n_chars, int(chars[CLASSES.index("symbol")]), dup_lines(text), repeated, failed, by_char, by_word, kept


#: Distinct words that a task holds before it hands its counts on.
FLUSH = 400_000


def language_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, kind, item, n) over all documents: n characters of a class or n of a word; null languages are one of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        chars: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, count in words.items():
                yield _counts(lang, "word", list(count), list(count.values()))
            for lang, count in chars.items():
                yield _counts(lang, "char", [x.encode() for x in CLASSES], count.tolist())
            words.clear()
            chars.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                lang = lang or ""
                words.setdefault(lang, Counter()).update(text.split())
                chars[lang] = chars.get(lang, 0) + char_counts(text)
            if sum(map(len, words.values())) > FLUSH:
                yield from out()
        yield from out()

    picked = docs.select(valid(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    parts = picked.mapInArrow(run, "lang string, kind string, item binary, n long")
    return parts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def _counts(lang: str, kind: str, items: list[bytes], counts: list[int]) -> pa.RecordBatch:
    n = len(items)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([kind] * n, pa.string()), pa.array(items, pa.binary()), pa.array(counts, pa.int64())], ["lang", "kind", "item", "n"])


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()) -> dict[str, Reference]:
    """A reference per language over all documents. What reaches the driver is bounded: 1 / common_share words and the classes for a language."""
    stash = Stash(docs.sparkSession)
    counts = stash.keep(language_counts(docs, text_col, lang_col), "counts")
    totals = counts.where("kind = 'word'").groupBy("lang").agg(F.sum("n").alias("total"))
    words = counts.where("kind = 'word'").join(totals, "lang").where(F.col("n") >= rules.common_share * F.col("total"))
    rows = words.select("lang", "kind", "item", "n").union(counts.where("kind = 'char'").select("lang", "kind", "item", "n"))
    rows = rows.union(totals.select("lang", F.lit("total"), F.lit("").cast("binary"), "total"))
    out: dict[str, Reference] = {}
    by_lang: dict[str, dict[str, list]] = {}
    for r in rows.collect():
        by_lang.setdefault(r.lang, {}).setdefault(r.kind, []).append((bytes(r.item), r.n))
    for lang, kinds in by_lang.items():
        chars = dict(kinds.get("char", []))
        seen = np.array([chars.get(x.encode(), 0) for x in CLASSES], float)
        if not seen.sum():
            continue
        total = dict(kinds.get("total", [])).get(b"", 0)
        common = sorted(kinds.get("word", []), key=lambda x: (-x[1], x[0]))
        counted = np.array([n for _, n in common] + [total - sum(n for _, n in common)], float)
        out[lang] = Reference(seen / seen.sum(), {w: i for i, (w, _) in enumerate(common)}, counted / max(1.0, counted.sum()))
    stash.drop("counts")
    return out


VERDICT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, char_distance double, word_distance double, kept boolean"
)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """(id, VERDICT) for every row of docs.

    A document is compared with the reference of its own language; without a language,
    or with one that nothing was learned of, it has no distances and only the base rules
    hold. A null text counts as empty and fails for having too few words. Repeated
    rows are judged alike; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(references(docs, text_col, lang_col, rules))
    picked = docs.select(F.col(id_col).cast("long").alias("id"), valid(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    names = [x.split()[0] for x in VERDICT.split(", ")]
    kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[x.split()[1]] for x in VERDICT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = known.value
        for batch in batches:
            texts, langs = as_bytes(batch.column(2)), batch.column(1).to_pylist()
            rows = [measure(t, refs.get(x) if x else None, rules) for t, x in zip(texts, langs, strict=True)]
            found = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(v), k) for v, k in zip(found, kinds, strict=True))], ["id", *names])

    return picked.mapInArrow(run, f"id long, {VERDICT}")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; rows that share an id and differ in text stand or fall together."""
    (gone,) = unused(docs, "gone")
    bad = judge(docs, id_col, text_col, lang_col, rules).where("not kept").select(F.col("id").alias(gone)).distinct()
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(bad[gone]), "left_anti")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
