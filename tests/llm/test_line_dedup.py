import random

import pytest
from keyweave.llm.line_dedup import remove_repeats, repeated_runs


def words(line):
    return len((line or "").encode().split())


def plain(documents, least):
    """{(id, text): removed lines} by comparing every pair of places."""
    docs = sorted({(i if i is not None else -(10**9), t or "") for i, t in documents}, key=lambda d: (d[0],))
    places = [(d, k) for d, (_, t) in enumerate(docs) for k in range(len(t.split("\n")))]
    lines = [t.split("\n") for _, t in docs]
    gone = {d: set() for d in docs}
    for d, k in places:
        for e, j in places:
            if (e, j) >= (d, k):
                break
            n = 0
            while k + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][k + n] == lines[e][j + n]:
                n += 1
            if n and sum(map(words, lines[d][k : k + n])) >= least:
                gone[docs[d]] |= set(range(k, k + n))
    return gone


def check(spark, documents, least):
    df = spark.createDataFrame(documents, "doc_id long, text string")
    want = plain(documents, least)
    found = remove_repeats(df, min_words=least).collect()
    assert len(found) == len(documents)
    sources = {}
    for i, t in documents:
        sources.setdefault(i, set()).add(t)
    for r in found:
        options = []
        for t in sources[r.doc_id]:
            gone = want[(r.doc_id if r.doc_id is not None else -(10**9), t or "")]
            left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
            options.append((left, sorted(gone)))
        assert (r.text, list(r["__removed"])) in options


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    letters = [f"{c} " * rng.randint(0, 4) + c for c in "abcd"] + ["", " "]
    documents = [(i, "\n".join(rng.choice(letters) for _ in range(rng.randint(1, 14)))) for i in range(25)]
    check(spark, documents, rng.choice([1, 4, 9, 15]))


def test_awkward_documents(spark, documents):
    one_id = [d for d in documents if d[0] is not None and d[0] != 131]
    check(spark, [*one_id, (None, documents[4][1])], 20)


def test_columns_and_no_rows(frame, no_rows):
    found = remove_repeats(frame)
    assert found.columns == [*frame.columns, "__lines", "__removed"]
    assert found.count() == frame.count()
    assert remove_repeats(no_rows).count() == repeated_runs(no_rows).count() == 0


def test_first_copy_stays(spark):
    passage = "\n".join(f"line {k} with a few words more" for k in range(10))
    df = spark.createDataFrame([(1, "own start\n" + passage), (2, passage + "\nown end"), (3, "x\n" + passage + "\ny\n" + passage)], "doc_id long, text string")
    found = {r.doc_id: r.text for r in remove_repeats(df).collect()}
    assert found == {1: "own start\n" + passage, 2: "own end", 3: "x\ny"}


def test_frequent_lines_are_broadcast_and_others_shuffled(spark, documents, monkeypatch):
    one_id = [d for d in documents if d[0] is not None and d[0] != 131]
    for hot in (1, 20):
        monkeypatch.setattr("keyweave.llm.common.HOT_KEYS", hot)
        check(spark, one_id, 20)


def test_lines_without_words_within_a_run(spark):
    passage = "a b c\n\n\n\nd e f\n\n"
    df = [(1, passage + "own"), (2, "x\n" + passage + passage), (3, "\n\n" + passage), (4, "d e f\n\n\na b c")]
    for least in (1, 3, 6, 7):
        check(spark, df, least)
