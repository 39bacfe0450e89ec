from functools import cache

from hypothesis import given, settings
from hypothesis import strategies as st
from keyweave.llm import token_counts
from keyweave.llm.token_counts import Pieces, read_pieces, trie_counts

PIECES = read_pieces()


def plain(token, pieces):
    @cache
    def best(n):
        if not n:
            return 0.0, 0
        lone = len(token[n - 1].encode())
        options = [(best(n - 1)[0] + lone * pieces.byte, best(n - 1)[1] + lone)]
        for i in range(n):
            if token[i:n] in pieces.scores:
                options.append((best(i)[0] + pieces.scores[token[i:n]], best(i)[1] + 1))
        return max(options, key=lambda x: (x[0], -x[1]))

    return best(len(token))[1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("▁theringaé漢", min_size=1, max_size=12), max_size=30))
def test_counts(tokens):
    assert trie_counts(tokens, PIECES) == {t: plain(t, PIECES) for t in tokens}


def test_ties_take_the_fewer_pieces():
    pieces = Pieces({"ab": -2.0, "a": -1.0, "b": -1.0}, -9.0)
    assert trie_counts(["ab", "aba", "c"], pieces) == {"ab": 1, "aba": 2, "c": 1}
    assert trie_counts([], pieces) == {}


def test_frame(frame, no_rows, documents, monkeypatch):
    want = sorted((i if i is not None else -1, len((t or "").encode().split()), sum(plain("▁" + w.decode(), PIECES) for w in (t or "").encode().split() if len(w) < 500)) for i, t in documents)
    found = token_counts.token_counts(frame).collect()
    got = sorted((r.id if r.id is not None else -1, r.n_pretokens, r.n_tokens) for r in found)
    assert [x for x in got if x[0] != 131] == [x for x in want if x[0] != 131]
    assert token_counts.token_counts(no_rows).count() == 0


def test_forgetting(monkeypatch):
    counter = token_counts.Counter(PIECES)
    texts = [b"the cat sat", b"on the mat", b"", b"the end of it all"]
    whole = counter.count(texts)
    monkeypatch.setattr(token_counts, "REMEMBERED", 2)
    assert [token_counts.Counter(PIECES).count([t])[0] for t in texts] == whole
