"""Small documents with every awkward case, and helpers to run an operator on them."""

import random

import pytest

WORDS = "the of and to in on for with that this by it is was are as be at from or an ed er ing ion ble thor anea ndhe reti".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward(seed=7, n=60):
    """(doc_id, text): prose, copies, near copies, repeated lines, nulls, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    shared = [sentence(rng, 60), sentence(rng, 25), sentence(rng, 30)]
    rows = []
    for i in range(n):
        lines = [sentence(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 6))]
        if i % 5 == 0:
            lines.insert(rng.randint(0, len(lines)), shared[0])
        if i % 7 == 0:
            lines[1:1] = shared[1:]
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    rows += [(110 + i, rows[i][1].replace("the", "THE", 1) + " more") for i in range(5)]
    rows += [(120, None), (121, ""), (122, " \n\t \n"), (123, "one"), (124, "two words"), (125, "A.\nA.\nA."), (126, None), (127, "…—“”"), (128, "É" * 50 + " ÀÇ ß ǅ İ")]
    rows += [(130, "\n".join(sentence(rng, 30) for _ in range(400))), (131, "x" * 9000), (132, ("ab" * 40 + "\n") * 30)]
    rows += [rows[3], rows[3], (None, rows[4][1]), (None, None)]
    return rows


@pytest.fixture(scope="session")
def documents():
    return awkward()


@pytest.fixture(scope="session")
def frame(spark, documents):
    """The documents with the columns of the real table, and columns whose names operators use themselves."""
    rng = random.Random(1)
    rows = [(i, t, rng.choice(["en", "fr", None]), "src", len(t or ""), 1, 2, "x", 3, 4, 5, None) for i, t in documents]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, n int, word string, key long, h long, s long, score double")


@pytest.fixture(scope="session")
def no_rows(frame):
    return frame.limit(0)
