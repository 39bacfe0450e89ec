import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from keyweave.llm import ppm


def trained(texts):
    node = defaultdict(Counter)
    for t in texts:
        s = bytes([ppm.END]) * ppm.ORDER + (t or "").encode().lower() + bytes([ppm.END])
        for p in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER + 1):
                node[s[p - k : p]][s[p]] += 1
    return node


def plain(node, text):
    s = bytes([ppm.END]) * ppm.ORDER + (text or "").encode().lower() + bytes([ppm.END])
    total = 0.0
    for p in range(ppm.ORDER, len(s)):
        gone = set()
        for k in range(ppm.ORDER, -1, -1):
            here = {c: n for c, n in node.get(s[p - k : p], {}).items() if c not in gone}
            if not here:
                continue
            size = sum(here.values()) + len(here)
            if s[p] in here:
                total += math.log10(here[s[p]] / size)
                break
            total += math.log10(len(here) / size)
            gone |= here.keys()
        else:
            total -= math.log10(max(1, 256 - len(node.get(b"", {}))))
    return total


def test_against_brute_force(frame, documents):
    learned = [t for i, t in documents if i is None or i % 4]
    node = trained(learned)
    counts = Counter(w for t in learned for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    found = ppm.language_model_scores(frame, frame.where("doc_id is null or doc_id % 4 <> 0")).collect()
    key = lambda x: (x[0] if x[0] is not None else -1, x[1], x[2], round(x[4], 4))
    want = []
    for i, t in documents:
        words = [*(t or "").encode().lower().split(), None]
        want.append((i, len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), plain(node, t)))
    got = sorted((tuple(r) for r in found), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]) and a[5] == pytest.approx(b[5], rel=1e-4, abs=1e-3)


def test_words_beyond_the_frequent(frame, monkeypatch):
    whole = {(r.id, r.n_tokens): r.base_score for r in ppm.language_model_scores(frame, frame).collect()}
    monkeypatch.setattr(ppm, "FREQUENT", 3)
    for r in ppm.language_model_scores(frame, frame).collect():
        assert r.base_score == pytest.approx(whole[r.id, r.n_tokens])


def test_entries_beyond_the_frequent(frame, documents, monkeypatch):
    node = trained([t for i, t in documents if i is None or i % 4])
    monkeypatch.setattr(ppm, "ENTRIES", 50)
    monkeypatch.setattr(ppm.train_trie, "__defaults__", (50,))
    found = ppm.language_model_scores(frame, frame.where("doc_id is null or doc_id % 4 <> 0")).collect()
    assert sorted(r.score for r in found) == pytest.approx(sorted(plain(node, t) for _, t in documents), rel=1e-4, abs=1e-3)


def test_ends_stay_whole(monkeypatch):
    monkeypatch.setattr(ppm, "FLUSH", 5)
    ends = [1, 1, 2, 3, 3, 3, 3, 3, 3, 3, 4, 5, 5, 5, 6]
    rows = pa.RecordBatch.from_arrays([pa.array(range(15), pa.int64()), pa.array(ends, pa.int64()), pa.array(ends, pa.int64())], ["key", "n", "end"])
    found = list(ppm._whole_ends(rows.slice(i, 2) for i in range(0, 15, 2)))
    assert np.concatenate([k for k, _ in found]).tolist() == list(range(15))
    assert len(found) > 1 and sum(len(set(n)) for _, n in found) == 6


def test_a_smaller_trie_is_still_a_distribution(frame, monkeypatch):
    small = ppm.train_trie(ppm.corpus_counts(frame).where("key is not null").select("key", "n"), 2000)
    assert sum(len(k) for k, _ in small.orders) <= 2000
    keys = ppm.grams([b"the and"])[0][-1:]
    every = (keys & ~np.uint64(0xFF)) | np.arange(256, dtype=np.uint64)
    assert float((10.0 ** small.logs(every)).sum()) == pytest.approx(1, abs=0.02)


def test_pages_of_a_long_text(frame, monkeypatch):
    trie = ppm.train_trie(ppm.corpus_counts(frame).where("key is not null").select("key", "n"))
    texts = [b"the reti of anea " * 30, b"", b"the", b"", b"anea ing of " * 9]
    whole = trie.scores(texts)
    monkeypatch.setattr(ppm, "PAGE", 16)
    assert trie.scores(texts) == pytest.approx(whole)
    assert [trie.scores([t])[0] for t in texts] == pytest.approx(whole)


def test_nothing_to_learn_from(frame, no_rows, documents):
    found = ppm.language_model_scores(frame, no_rows).collect()
    assert len(found) == len(documents) and all(r.n_known == 0 and r.train_tokens == 0 for r in found)
    assert any(r.id == 121 and r.score == pytest.approx(-math.log10(256)) for r in found)
    assert ppm.language_model_scores(no_rows, frame).count() == 0
