"""Byte-pair encoding and decoding with word ends, and joining the encodings of pieces."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, small_batches, table

#: The vocabulary file's own values: its pre-token pattern, with white space as Unicode has it, and its end-of-word mark.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: The same for ASCII texts in lower case.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+"
WORD_END = "</w>"
#: Letters and numbers that the regex module knows and the vocabulary's library, with older Unicode tables, takes for neither. Fixed values.
NEWER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 "
    "A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F "
    "12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 "
    "1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F "
    "2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: A text with no character from here on has none of them.
FIRST_NEWER = "\u0558"

#: Symbols of a pre-token from which its halves are encoded on their own, and of the leaves that the halving ends at.
LONG = 4096
LEAF = 1024
#: Bytes of a text from which its halves are encoded on their own, and characters of the leaves that the halving ends at.
LONG_TEXT = 16_384
LEAF_TEXT = 8_192  # below 65,536
#: Pre-tokens whose encoding a worker remembers; the memory starts anew when it is full.
REMEMBERED = 600_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable, else the next free one from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def older_pattern() -> str:
    """PATTERN with the NEWER characters among the others."""
    newer = "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in NEWER.split())
    return f"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\\p{{L}}--[{newer}]]+|[\\p{{N}}--[{newer}]]|(?:[^\\p{{White_Space}}\\p{{L}}\\p{{N}}]|[{newer}])+"


class Vocabulary:
    """Tokens, merges and special tokens of a vocabulary file."""

    def __init__(self, text: str):
        self.text = text

    def __reduce__(self):  # a worker parses the text anew; the tables are several times its size
        return Vocabulary, (self.text,)

    @cached_property
    def _model(self) -> dict:
        return json.loads(self.text)

    @cached_property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        ids = self._model["model"]["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in self._model["model"]["merges"])
        return {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}

    @cached_property
    def tokens(self) -> dict[int, str]:
        return {i: t for t, i in self._model["model"]["vocab"].items()} | {i: t for t, i in self.special.items()}

    @cached_property
    def special(self) -> dict[str, int]:
        return {x["content"]: x["id"] for x in self._model["added_tokens"]}

    @property
    def width(self) -> str:
        """The numpy type of the fewest bytes that holds every id."""
        return "<u2" if max(self.tokens) < 1 << 16 else "<u4"

    @cached_property
    def symbols(self) -> tuple[list[int], list[int]]:
        """The id of each byte within a word, and at its end."""
        ids, letters = self._model["model"]["vocab"], byte_letters()
        return [ids[c] for c in letters], [ids[c + WORD_END] for c in letters]


def merge(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Join the pair of least rank, the leftmost first, until no pair has one."""
    if len(symbols) < 64:
        # (rank, id) compares by rank, which is unique to a pair.
        out, none = list(symbols), (1 << 60, 0)
        ranks = [merges.get(p, none) for p in zip(out, out[1:])]
        while ranks and (best := min(ranks)) is not none:
            i = ranks.index(best)
            out[i : i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = merges.get((out[i - 1], best[1]), none)
            if i < len(ranks):
                ranks[i] = merges.get((best[1], out[i + 1]), none)
        return out
    ids, after, before = list(symbols), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    heap = [(merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if ids[i] != pair[0] or j >= len(ids) or ids[j] != pair[1]:
            continue
        ids[i], ids[j] = merges[pair][1], -1
        after[i] = after[j]
        if after[i] < len(ids):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(ids) and (p := (ids[a], ids[b])) in merges:
                heapq.heappush(heap, (merges[p][0], a, p))
    return [x for x in ids if x >= 0]


def join(left: list[int], right: list[int], merges: dict, parts: dict[int, list[int]], window: int = 4) -> list[int]:
    """The encoding of two adjacent pieces from their own encodings.

    The last tokens of the left and the first of the right are taken apart into
    symbols and encoded together. Once the outcome starts with the same token as the
    left part of the window and ends with the same as the right part, every adjacent
    pair of tokens in the whole is one that an encoder leaves alone, and such a
    sequence is the encoding. Until then the window doubles, at most to both pieces.
    """
    while True:
        a, b = left[-window:], right[:window]
        whole = window >= max(len(left), len(right))
        middle = merge([s for t in a + b for s in parts[t]], merges)
        if whole or (len(left) <= window or middle[0] == a[0]) and (len(right) <= window or middle[-1] == b[-1]):
            return left[:-window] + middle + right[window:]
        window *= 2


def join_all(pieces: list[list[int]], merges: dict, parts: dict[int, list[int]]) -> list[int]:
    """The encoding of the symbols of one pre-token from those of its leaves."""
    return join_tree(pieces, lambda a, b: join(a, b, merges, parts)) if pieces else []


@dataclass
class Stretch:
    """A text in normal form with its encoding: where each pre-token begins and ends, how many ids it has, and the ids."""

    text: str
    begin: np.ndarray
    end: np.ndarray
    counts: np.ndarray
    ids: np.ndarray

    def places(self) -> bytes:
        """For each pre-token the blanks before it, its length and its number of ids. A leaf has so few characters that 16 bits hold each."""
        before = np.concatenate(([0], self.end[:-1]))[: len(self.end)]
        return np.concatenate((self.begin - before, self.end - self.begin, self.counts)).astype("<u2").tobytes()

    @staticmethod
    def placed(text: str, places: bytes, ids: np.ndarray) -> Stretch:
        gaps, lengths, counts = np.frombuffer(places, "<u2").reshape(3, -1).astype(np.int64)
        end = np.cumsum(gaps + lengths)
        return Stretch(text, end - lengths, end, counts, ids)

    def part(self, first: int, last: int) -> Stretch:
        """The pre-tokens from first to last - 1, with the places they have in the whole text."""
        skip, have = int(self.counts[:first].sum()), int(self.counts[first:last].sum())
        return Stretch(self.text, self.begin[first:last], self.end[first:last], self.counts[first:last], self.ids[skip : skip + have])

    def same(self, at: int, other: Stretch, there: int, shift: int) -> bool:
        """Whether a pre-token is the same as one of a stretch that begins `shift` characters further on."""
        a, b = self.part(at, at + 1), other.part(there, there + 1)
        return a.begin[0] == b.begin[0] + shift and a.end[0] == b.end[0] + shift and np.array_equal(a.ids, b.ids)


def join_texts(left: Stretch, right: Stretch, encode: Callable[[str], Stretch], window: int = 4) -> Stretch:
    """The encoding of two adjacent pieces of a text from their own encodings.

    The text from the last pre-tokens of the left to the first of the right is encoded
    anew. Once the outcome begins with the same pre-token and ids as the left part of
    the window and ends with the same as the right part, all that lies outside is right
    as well: what a pre-token is depends on the text that follows where it begins, and
    the cut lies several pre-tokens beyond the first one. Until then the window
    doubles, at most to both pieces.
    """
    while True:
        i, j = max(0, len(left.begin) - window), min(window, len(right.begin))
        all_left, all_right = i == 0, j == len(right.begin)
        start, stop = 0 if all_left else int(left.begin[i]), len(right.text) if all_right else int(right.end[j - 1])
        middle = encode(left.text[start:] + right.text[:stop])
        offset = len(left.text) - start  # where the right piece begins in the window
        if (all_left or left.same(i, middle, 0, start)) and (all_right or right.same(j - 1, middle, len(middle.begin) - 1, -offset)):
            break
        window *= 2
    a, b = left.part(0, i), right.part(j, len(right.begin))
    return Stretch(
        left.text + right.text,
        np.concatenate((a.begin, middle.begin + start, b.begin + len(left.text))),
        np.concatenate((a.end, middle.end + start, b.end + len(left.text))),
        np.concatenate((a.counts, middle.counts, b.counts)),
        np.concatenate((a.ids, middle.ids, b.ids)),
    )


def join_tree(pieces: list, join_two: Callable):
    """Concatenate neighbours pairwise, level by level, up to the root of the tree."""
    while len(pieces) > 1:
        paired = [join_two(a, b) for a, b in zip(pieces[::2], pieces[1::2])]
        pieces = paired + pieces[len(paired) * 2 :]
    return pieces[0]


class Encoder:
    """Encodes texts pre-token by pre-token and remembers what each became."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.merges, self.inner, self.last = v.merges, *v.symbols
        self.shown = {i: t.encode() for i, t in v.tokens.items()}
        self.pattern, self.ascii_pattern, self.older_pattern = regex.compile(PATTERN), re.compile(ASCII_PATTERN), regex.compile(older_pattern())
        self.split_special = re.compile("(" + "|".join(map(re.escape, v.special)) + ")").split if v.special else None
        self.known: dict[str, bytes] = {}

    @cached_property
    def parts(self) -> dict[int, list[int]]:
        """The symbols of each token."""
        whole = {merged: pair for pair, (_, merged) in self.merges.items()}
        out: dict[int, list[int]] = {}
        for token in self.vocabulary.tokens:
            stack, symbols = [token], []
            while stack:
                t = stack.pop()
                if t in whole:
                    stack += reversed(whole[t])
                else:
                    symbols.append(t)
            out[token] = symbols
        return out

    def pieces(self, text: bytes) -> list[str]:
        """A text in normal form, and in every second place the special tokens that it holds, as they stand."""
        plain = text.decode("utf-8", "replace")
        if self.split_special and any(t in plain for t in self.vocabulary.special):
            return [piece if i % 2 else normal(piece) for i, piece in enumerate(self.split_special(plain))]
        return [normal(plain)]

    def matcher(self, plain: str):
        """The pattern that finds the pre-tokens of a text in normal form."""
        if plain.isascii():
            return self.ascii_pattern
        return self.pattern if max(plain) < FIRST_NEWER else self.older_pattern

    def pretokens(self, text: bytes) -> list[str]:
        """The pre-tokens of a text in normal form; the special tokens in it stand as they are."""
        return [t for i, piece in enumerate(self.pieces(text)) for t in ([piece] if i % 2 else self.matcher(piece).findall(piece))]

    def symbols(self, pretoken: str) -> list[int]:
        raw = pretoken.encode()
        out = list(map(self.inner.__getitem__, raw))
        out[-1] = self.last[raw[-1]]
        return out

    def encode_unit(self, symbols: list[int]) -> list[int]:
        if len(symbols) < LONG:
            return merge(symbols, self.merges)
        return join_all([merge(symbols[i : i + LEAF], self.merges) for i in range(0, len(symbols), LEAF)], self.merges, self.parts)

    def token(self, token: str) -> bytes:
        """The ids of a pre-token or special token, little-endian unsigned 32-bit integers."""
        special = self.vocabulary.special.get(token)
        return pack([special] if special is not None else self.encode_unit(self.symbols(token)))

    def codes(self, tokens: list[str]) -> list[bytes]:
        """The ids of each pre-token."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for t in {*tokens}.difference(self.known):
            self.known[t] = self.token(t)
        return list(map(self.known.__getitem__, tokens))

    def encode(self, text: bytes) -> bytes:
        """The ids of a text, as token() has them."""
        return b"".join(self.codes(self.pretokens(text)))

    def stretch(self, plain: str) -> Stretch:
        """A text in normal form without special tokens, and its encoding."""
        found = list(self.matcher(plain).finditer(plain))
        codes = self.codes([m.group() for m in found])
        places = np.array([m.span() for m in found], np.int64).reshape(-1, 2)
        return Stretch(plain, places[:, 0], places[:, 1], np.array([len(c) // 4 for c in codes], np.int64), np.frombuffer(b"".join(codes), "<u4"))

    def units(self, text: bytes) -> Iterator[tuple[str, list]]:
        """What a text is put together from, in order, each cut into leaves.

        ("special", [token]); ("text", leaves of a text in normal form); ("word", leaves
        of symbols of one pre-token that has LONG of them or more).
        """
        for i, piece in enumerate(self.pieces(text)):
            if i % 2:
                yield "special", [piece]
                continue
            at = 0
            for m in self.matcher(piece).finditer(piece) if UNSPLIT.search(piece) else ():
                if 4 * (m.end() - m.start()) < LONG or len(symbols := self.symbols(m.group())) < LONG:
                    continue
                if m.start() > at:
                    yield "text", [piece[k : min(k + LEAF_TEXT, m.start())] for k in range(at, m.start(), LEAF_TEXT)]
                yield "word", [symbols[k : k + LEAF] for k in range(0, len(symbols), LEAF)]
                at = m.end()
            if at < len(piece):
                yield "text", [piece[k : k + LEAF_TEXT] for k in range(at, len(piece), LEAF_TEXT)]

    def decode(self, ids: bytes) -> bytes:
        """Without a decoder in the vocabulary file, a text decodes to its tokens joined by blanks."""
        return b" ".join(map(self.shown.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: A stretch that may hold a pre-token of LONG symbols.
UNSPLIT = regex.compile(rf"[^\p{{White_Space}}]{{{LONG // 4}}}")


def normal(text: str) -> str:
    """A text as the vocabulary's normal form has it, but for its blanks, which belong to no pre-token."""
    if text.isascii():
        return text.lower()
    # A capital sigma is lowered as within a word wherever it stands.
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def read_vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of a public vocabulary file; it stays outside the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


_ENCODER: dict[int, Encoder] = {}


def _encoder(v: Vocabulary) -> Encoder:
    """A worker's encoder of this vocabulary; one at a time."""
    if id(v) not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[id(v)] = Encoder(v)
    return _ENCODER[id(v)]


CODES = "ids binary, decoded binary"
#: The leaves of long texts, and the same with their ids and, of a text, where its pre-tokens begin and end and how many ids each has.
PIECES = "key long, id long, unit long, leaf long, kind string, text string, symbols array<int>"
CODED = "key long, id long, unit long, leaf long, kind string, text string, ids binary, places binary"
#: Leaves that are handed on at a time.
LEAVES = 256


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, digest: bool = False) -> DataFrame:
    """(id, n_tokens, ids, decoded) for every row: the token ids as little-endian unsigned 32-bit integers and the decoded text in UTF-8.

    digest: (id, n_tokens, ids_sha256, decoded_sha256) instead, lower-case hex.
    Null counts as an empty text, which has no tokens. Repeated rows are encoded alike;
    an empty table gives no rows. A text of LONG_TEXT bytes or more, or one that may
    have a pre-token of LONG symbols, is set apart: the leaves of its halving become
    rows of their own, encoded wherever there is room, and are joined again per text,
    windows of pre-tokens around each cut of the text and of tokens around each cut within a long pre-token.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(path or read_vocabulary(), encoding="utf-8") as f:
        known = spark.sparkContext.broadcast(Vocabulary(f.read()))
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = F.octet_length("text")
    large = F.coalesce((size >= LONG_TEXT) | (size >= LONG) & F.col("text").rlike(rf"[^\x20\x09-\x0D]{{{LONG // 4},}}+"), F.lit(False))
    out = "id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else CODES)

    def row(e: Encoder, ids: list[int], codes: list[bytes]) -> pa.RecordBatch:
        found = [codes, [e.decode(x) for x in codes]]
        columns = [pa.array([hashlib.sha256(x).hexdigest() for x in f], pa.string()) if digest else pa.array(f, pa.binary()) for f in found]
        names = [x.split()[0] for x in out.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) // 4 for x in codes], pa.int64()), *columns], names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = _encoder(known.value)
            yield row(e, batch.column(0).to_pylist(), [e.encode(t) for t in as_bytes(batch.column(1))])

    # Between the leaves and their texts, ids are as wide as the vocabulary needs.
    width = known.value.width

    def narrow(ids: np.ndarray) -> bytes:
        return ids.astype(width).tobytes()

    def wide(ids: bytes) -> np.ndarray:
        return np.frombuffer(ids, width).astype("<u4")

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each leaf of each unit of a text; one of kind "none" for a text that has no unit."""
        for batch in batches:
            e = _encoder(known.value)
            for key, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                rows = ((unit, k, kind, leaf) for unit, (kind, pieces) in enumerate(e.units(text)) for k, leaf in enumerate(pieces))
                while part := list(islice(rows, LEAVES)):
                    yield leaf_rows(key, i, part)
                yield leaf_rows(key, i, [(-1, 0, "none", None)])

    def leaf_rows(key: int, i: int, part: list[tuple]) -> pa.RecordBatch:
        unit, leaf, kind, held = zip(*part)
        texts, symbols = [x if isinstance(x, str) else None for x in held], [x if isinstance(x, list) else None for x in held]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))
        columns = ([key] * len(part), [i] * len(part), unit, leaf, kind, texts, symbols)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in PIECES.split(", ")])

    def encode_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = _encoder(known.value)
            ids, places = [], []
            for kind, text, symbols in zip(*(batch.column(c).to_pylist() for c in ("kind", "text", "symbols")), strict=True):
                place = b""
                if kind == "text":
                    found = e.stretch(text)
                    code, place = narrow(found.ids), found.places()
                elif kind == "word":
                    code = narrow(np.array(merge(symbols, e.merges)))
                else:
                    code = e.token(text) if kind == "special" else b""
                ids.append(code)
                places.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(ids, pa.binary()), pa.array(places, pa.binary())], [x.split()[0] for x in CODED.split(", ")])

    def joined(found: pa.Table) -> pa.Table:
        e = _encoder(known.value)
        found = found.sort_by([("unit", "ascending"), ("leaf", "ascending")])
        units: dict[int, tuple[str, list]] = {}
        for unit, kind, text, ids, places in zip(*(found[c].to_pylist() for c in ("unit", "kind", "text", "ids", "places")), strict=True):
            piece = Stretch.placed(text, places, wide(ids)) if kind == "text" else wide(ids).tolist() if kind == "word" else ids
            units.setdefault(unit, (kind, []))[1].append(piece)
        codes = []
        for kind, pieces in units.values():
            if kind == "text":
                codes.append(join_tree(pieces, lambda a, b: join_texts(a, b, e.stretch)).ids.tobytes())
            else:
                codes.append(pack(join_all(pieces, e.merges, e.parts)) if kind == "word" else pieces[0])
        return pa.Table.from_batches([row(e, [found["id"][0].as_py()], [b"".join(codes)])])

    short = picked.where(~large).mapInArrow(whole, out)
    apart = picked.where(large).select(F.monotonically_increasing_id().alias("key"), "id", "text")
    coded = apart.mapInArrow(leaves, PIECES).repartition("key", "unit", "leaf").mapInArrow(encode_leaf, CODED)
    return short.unionByName(coded.groupBy("key").applyInArrow(joined, out))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("id", "doc_id")
