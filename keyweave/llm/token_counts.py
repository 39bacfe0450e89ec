"""Token counts under a unigram vocabulary, with one forward pass over a trie of distinct pre-tokens."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import e as E
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, small_batches, table

#: What marks a word's start in the vocabulary file.
START = "▁"
#: Pre-tokens whose counts a worker remembers; the memory starts anew when it is full.
REMEMBERED = 300_000


@dataclass(frozen=True)
class Pieces:
    """Log probabilities of pieces, and of a byte of a character that no piece has."""

    scores: dict[str, float]
    byte: float

    @property
    def longest(self) -> int:
        return max(map(len, self.scores), default=1)


def read_pieces(path: str | None = None) -> Pieces:
    """Pieces of a vocabulary file in the order of their ranks.

    The file's own scores are merge ranks, not probabilities. A piece of rank r gets the
    log probability of Zipf's law, -ln(r + e), and a lone byte that of the last rank.
    """
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    ranked = sorted(plain, key=lambda i: (-sp.get_score(i), i))
    return Pieces({sp.id_to_piece(i): -log(r + E) for r, i in enumerate(ranked)}, -log(len(ranked) + E))


def trie_counts(tokens: Iterable[str], pieces: Pieces) -> dict[str, int]:
    """The number of pieces in the likeliest segmentation of each pre-token.

    Sorted, the pre-tokens come in the order of a walk through their trie: the stack
    holds the nodes from the root to the current one, each with its forward score, and
    going to the next pre-token drops the nodes that it doesn't share. So a shared
    prefix is scored once. The count is stored where a pre-token ends. Of equally
    likely segmentations that with the fewer pieces counts.
    """
    scores, longest, byte = pieces.scores, pieces.longest, pieces.byte
    out: dict[str, int] = {}
    best, count, last = [0.0], [0], ""
    for token in sorted(tokens):
        shared = 0
        for a, b in zip(last, token):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for j in range(shared + 1, len(token) + 1):
            lone = len(token[j - 1].encode("utf-8", "replace"))
            top, n = best[j - 1] + lone * byte, count[j - 1] + lone
            for i in range(max(0, j - longest), j):
                s = scores.get(token[i:j])
                if s is not None and ((s := s + best[i]) > top or s == top and count[i] + 1 < n):
                    top, n = s, count[i] + 1
            best.append(top)
            count.append(n)
        out[token] = count[-1]
        last = token
    return out


class Counter:
    def __init__(self, pieces: Pieces):
        self.pieces, self.known = pieces, {}

    def count(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        words = [t.split() for t in texts]
        new = {w for ws in words for w in ws}.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, {w for ws in words for w in ws}
        tokens = {w: START + w.decode("utf-8", "replace") for w in new}
        counts = trie_counts(set(tokens.values()), self.pieces)
        self.known.update((w, counts[token]) for w, token in tokens.items())
        return [(len(ws), sum(map(self.known.__getitem__, ws))) for ws in words]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_pretokens, n_tokens) for every row. Pre-tokens are the words between ASCII white space, with the start mark.

    Bytes that are no UTF-8 count as U+FFFD. Null counts as an empty text, which has none. Repeated rows count alike; an empty
    table gives no rows.
    """
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(read_pieces(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(known.value)
        for batch in batches:
            found = counter.count(as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["id", "n_pretokens", "n_tokens"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, n_pretokens long, n_tokens long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
