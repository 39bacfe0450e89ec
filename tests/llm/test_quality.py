import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from keyweave.llm.quality_rules import CLASSES, Rules, char_counts, js_distance, judge, keep_good, references, repeat_words


def plain_repeats(words):
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)})


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeated_words(words):
    assert repeat_words(words) == plain_repeats([bytes(w) for w in words])


def test_many_kinds_of_words_do_not_overflow():
    words = [b"%d" % (i % 40_000) for i in range(80_000)]
    assert repeat_words(words) == 80_000


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = (text or "").split("\n")
    full = [x for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
    repeated = plain_repeats(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(full) - len(set(full)), repeated, len(words) < 10 or 100 * repeated > 20 * len(words)


def test_base_figures(frame, documents):
    found = judge(frame).collect()
    assert sorted((r.id if r.id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == sorted((i if i is not None else -1, *base(t)) for i, t in documents)
    assert all(not r.kept for r in found if r.base_failed)


def plain_js(p, q):
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        total += (a * np.log2(a / m) if a else 0) / 2 + (b * np.log2(b / m) if b else 0) / 2
    return total**0.5


def test_distances(spark):
    prose = [(i, f"the cat and the dog of house {i} went to the river and saw the boat again number {i * 7} today " * 1, "en") for i in range(50)]
    prose += [(90, " | ".join(f"q{i}z{i * 3}" for i in range(120)), "en"), (91, "word " * 9 + "##$$ %% && " * 60, "en"), (92, " | ".join(f"q{i}" for i in range(120)), None), (93, "a | b # c", "en")]
    df = spark.createDataFrame(prose, "doc_id long, text string, lang string")
    refs = references(df)
    assert set(refs) == {"", "en"} and refs["en"].shares.sum() == pytest.approx(1) and refs["en"].chars.sum() == pytest.approx(1)
    found = {r.id: r for r in judge(df, rules=Rules(max_word_distance=0.5)).collect()}
    assert not found[90].kept and found[90].word_distance > 0.5
    assert found[92].word_distance is None and found[93].char_distance is None
    counts = char_counts(prose[90 - 40][1].encode())
    assert found[90].char_distance == pytest.approx(plain_js(counts / counts.sum(), refs["en"].chars))
    assert {r.doc_id for r in keep_good(df).collect()} == {i for i, r in judge_ids(df).items() if r}


def judge_ids(df):
    return {r.id: r.kept for r in judge(df).collect()}


def test_classes():
    assert dict(zip(CLASSES, char_counts("aB9 .#~é漢\n".encode()).tolist())) == {"lower": 1, "upper": 1, "digit": 1, "space": 2, "stop": 1, "symbol": 1, "other_ascii": 1, "beyond_ascii": 2}
    assert js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1 and js_distance(np.array([0.5, 0.5]), np.array([0.5, 0.5])) == 0


def test_no_rows(no_rows):
    assert judge(no_rows).count() == keep_good(no_rows).count() == 0
