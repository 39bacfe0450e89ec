import random
from collections import Counter

import regex
from keyweave.llm.decontaminate import BLOCKS, RADIUS, benchmark_matches, flips, without_items

VOCABULARY = [f"w{i}" for i in range(400)]


def words(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def plain(documents, items, least=0.8):
    out = {}
    for i, t in documents:
        w = words(t)
        for item, s in items:
            x = words(s)
            k = min(5, len(x))
            if not x or len(w) < k:
                continue
            want = Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
            length = min(len(x), len(w))
            for start in range(len(w) - length + 1):
                here = Counter(tuple(w[j : j + k]) for j in range(start, start + length - k + 1))
                both = sum((want & here).values())
                alike = both / (sum(want.values()) + sum(here.values()) - both)
                if alike >= least - 1e-12 and alike > out.get((i, item), (0, 0, 0))[2] + 1e-12:
                    out[i, item] = (start, length, alike)
    return out


def fixture():
    rng = random.Random(11)
    some = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([12, 20, 35, 60])))) for i in range(12)] + [(20, "alpha beta gamma"), (21, "solo"), (22, None), (23, ""), (24, "ha " * 30), (25, "x y " * 15), (26, "A, b! c? d. E")]
    docs = []
    for i in range(120):
        w = some(rng.randint(0, 80))
        if i % 2:
            piece = words(items[rng.randrange(12)][1])
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(piece))
                piece[at : at + rng.randint(0, 1)] = some(rng.randint(0, 1))
            at = rng.randint(0, len(w))
            w[at:at] = piece
        docs.append((i, " ".join(w)))
    docs += [(200, "Alpha, BETA; gamma"), (201, "solo"), (202, "beta gamma alpha"), (203, None), (204, ""), (205, "ha " * 29), (206, "ha " * 200), (207, "y x " * 20), (208, " ".join(words(items[3][1])[:-2])), (209, "a b c d e f"), (200, "Alpha, BETA; gamma")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = fixture()
    found = benchmark_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain(docs, items)
    assert {(r.id, r.item) for r in found} == set(want) and len(want) > 40
    for r in found:
        assert abs(r.similarity - want[r.id, r.item][2]) < 1e-9 and r.n_words == want[r.id, r.item][1]


def test_filter_and_awkward_tables(spark, frame, no_rows, documents):
    items = spark.createDataFrame([(1, documents[0][1], 1), (None, "nothing of the kind here at all", 2)], "item_id long, text string, h int")
    kept = without_items(frame, items)
    found = {r.id for r in benchmark_matches(frame, items).collect()}
    assert {0, 100} <= found and kept.columns == frame.columns
    assert kept.count() == sum(1 for i, _ in documents if i not in found)
    assert benchmark_matches(no_rows, items).count() == benchmark_matches(frame, items.limit(0)).count() == 0


def test_blocks_cover_the_radius():
    rng = random.Random(1)
    assert sum(bits for _, bits, _ in BLOCKS) == 64 and sum(limit + 1 for _, _, limit in BLOCKS) > RADIUS
    near = [set(flips(bits, limit)) for _, bits, limit in BLOCKS]
    for _ in range(300):
        x = sum(1 << b for b in rng.sample(range(64), RADIUS))
        assert any((x >> at) & ((1 << bits) - 1) in close for (at, bits, _), close in zip(BLOCKS, near, strict=True))


def test_shuffled_when_tables_are_large(spark, monkeypatch):
    docs, items = fixture()
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(tuple(r) for r in benchmark_matches(*frames).collect())
    monkeypatch.setattr("keyweave.llm.decontaminate.BROADCAST_BYTES", 0)
    assert sorted(tuple(r) for r in benchmark_matches(*frames).collect()) == want


def test_long_repetitive_text(spark):
    """As many windows as words, and few different ones."""
    docs = spark.createDataFrame([(1, "ha " * 20_000), (2, "ho hum " * 9_000), (3, "ha " * 29)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ha " * 30), (2, "hum ho " * 20), (3, "ha ho " * 20)], "item_id long, text string")
    found = {(r.id, r.item): (r.start, r.n_words) for r in benchmark_matches(docs, items).collect()}
    assert found == {(1, 1): (0, 30), (2, 2): (0, 40), (3, 1): (0, 29)}
