import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from keyweave.llm import bpe
from tokenizers import Tokenizer

LIBRARY = Tokenizer.from_file(bpe.read_vocabulary())
with open(bpe.read_vocabulary(), encoding="utf-8") as f:
    ENCODER = bpe.Encoder(bpe.Vocabulary(f.read()))


def expected(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return bpe.pack(ids), LIBRARY.decode(ids, skip_special_tokens=False).encode()


def found(text):
    ids = ENCODER.encode(text.encode())
    return ids, ENCODER.decode(ids)


PIECES = st.sampled_from([*"abcdefghinorst", "the", "ing", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "'s", "'LL", "'", "!!", "7", "½", "É", "é", "Σ", "İ", "ß", "ǅ", "ﬁ", "Å", "가", "ᄀ", "漢", "😀", "​", "­", "<|endoftext|>", "<|startoftext|>", "<|endof"])


@settings(max_examples=600, deadline=None)
@given(st.lists(PIECES, max_size=40).map("".join))
def test_same_as_the_library(text):
    assert found(text) == expected(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_same_as_the_library_on_any_text(text):
    if all(not 0xD800 <= ord(c) < 0xE000 for c in text):
        assert found(text) == expected(text)


@settings(max_examples=200, deadline=None)
@given(st.text("aeinthrso", min_size=8, max_size=150), st.integers(1, 20))
def test_joined_halves(text, leaf):
    symbols = ENCODER.symbols(text)
    pieces = [bpe.merge(symbols[i : i + leaf], ENCODER.merges) for i in range(0, len(symbols), leaf)]
    assert bpe.pack(bpe.join_all(pieces, ENCODER.merges, ENCODER.parts)) == expected(text)[0]


def tree(text, leaf):
    ids = b""
    for i, piece in enumerate(ENCODER.pieces(text.encode())):
        if i % 2:
            ids += ENCODER.token(piece)
        elif piece:
            leaves = [ENCODER.stretch(piece[k : k + leaf]) for k in range(0, len(piece), leaf)]
            ids += bpe.join_tree(leaves, lambda a, b: bpe.join_texts(a, b, ENCODER.stretch, 4)).ids.tobytes()
    return ids


@settings(max_examples=600, deadline=None)
@given(st.lists(PIECES, min_size=3, max_size=80).map("".join), st.integers(1, 25))
def test_joined_texts(text, leaf):
    assert tree(text, leaf) == expected(text)[0]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["'", "'l", "'ll", "'r", "e", "l", "s", "'ve", "v", "-", " ", "7", "a"]), min_size=8, max_size=60).map("".join), st.integers(1, 9))
def test_cuts_within_short_forms(text, leaf):
    assert tree(text, leaf) == expected(text)[0]


def test_window_grows():
    """A cut within a run of marks, whose halves look alike on both sides."""
    for text in ["ab " + "'" * 300 + "ll x", "-" * 500 + "'s" + "l" * 500, " " * 700 + "'ll" * 90, "''" * 100 + " " + "'d" * 100]:
        for leaf in (1, 7, 64, 301):
            assert tree(text, leaf) == expected(text)[0]


def test_stretches_keep_places():
    text = "the cat's 12 hats!! sat"
    whole = ENCODER.stretch(text)
    out = bpe.join_texts(ENCODER.stretch(text[:6]), ENCODER.stretch(text[6:]), ENCODER.stretch)
    for stretch in (out, bpe.Stretch.placed(text, whole.places(), whole.ids)):
        for a in ("begin", "end", "counts", "ids"):
            assert getattr(stretch, a).tolist() == getattr(whole, a).tolist()
    assert [text[a:b] for a, b in zip(out.begin, out.end)] == ["the", "cat", "'s", "1", "2", "hats", "!!", "sat"]


def test_long_and_short_merges_agree():
    symbols = ENCODER.symbols("abracadabrathinge" * 40)
    assert bpe.pack(bpe.merge(symbols, ENCODER.merges)) == expected("abracadabrathinge" * 40)[0]


def rows(df):
    return sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in df.collect())


def test_frame(frame, documents):
    digest = lambda x: hashlib.sha256(x).hexdigest()
    want = sorted((i if i is not None else -1, len(expected(t or "")[0]) // 4, *map(digest, expected(t or ""))) for i, t in documents)
    assert rows(bpe.encode(frame, digest=True)) == want


def test_unsplit_texts_are_spread_and_joined(spark):
    texts = ["x" * 9000, "the cat " + "abcdefgh" * 2000 + " sat " + "é" * 5000 + "!", "<|endoftext|>" + "q" * 5000, "short", ("z" * 1500 + " ") * 3, "İ" * 1400]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    want = sorted((i, len(expected(t)[0]) // 4, *expected(t)) for i, t in [*enumerate(texts), (0, texts[0])])
    assert [(a, b, bytes(c), bytes(d)) for a, b, c, d in rows(bpe.encode(df))] == want


def test_long_texts_are_cut_and_joined(spark):
    texts = ["the cat's hat. " * 3000, ("Été ΣΑΣ ǅ 漢字 " * 900 + "<|endoftext|>") * 2 + "q" * 6000 + " end" * 3000, " " * 40_000, "\n" * 20_000 + "a", "<|endoftext|>" * 1500, "naïve—" * 4000]
    assert all(len(t.encode()) >= bpe.LONG_TEXT for t in texts)
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0])], "doc_id long, text string")
    want = sorted((i, len(expected(t)[0]) // 4, *expected(t)) for i, t in [*enumerate(texts), (-1, texts[0])])
    assert [(a, b, bytes(c), bytes(d)) for a, b, c, d in rows(bpe.encode(df))] == want


def test_no_rows(no_rows):
    assert bpe.encode(no_rows).count() == 0


@pytest.mark.parametrize("full", [1, 3])
def test_forgetting(monkeypatch, full):
    monkeypatch.setattr(bpe, "REMEMBERED", full)
    ENCODER.known.clear()
    for text in ["a b c d e", "a b f", "g h i"]:
        assert found(text) == expected(text)
