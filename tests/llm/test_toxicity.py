import random

import numpy as np
import pytest
from keyweave.llm.toxicity import Training, encoded, features, part_sums, risk, score, scores, summed, telling, text_counts, train

CLEAN = [f"w{i}" for i in range(300)]
INSULTS = [f"insult{i}" for i in range(8)]


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            for w in rng.sample(INSULTS, 3):
                words[rng.randrange(60)] = w
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_held_out_texts(spark):
    rows = texts(3000, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2] + [(i, y) for i, _, y in rows if i % 12 == 0] + [(None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    model = train(docs.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 <> 0"))
    found = {r.id: r.score for r in scores(docs.where("doc_id % 5 = 0"), model).collect()}
    right = [(found[i] >= 0.5) == bool(y) for i, _, y in rows if i % 5 == 0]
    assert len(found) == 600 and np.mean(right) > 0.95


def test_the_sample_is_bounded(spark):
    rows = texts(3000, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = train(docs, labels, Training(positives=50))
    assert len(model.words) < 400 and abs(model.prior - 1 / 6) < 1e-9


def some_rows(seed, n=60, words=12):
    """Packed lists of places, which of them are confirmed, how often each occurs, and weights."""
    rng = np.random.default_rng(seed)
    x = [np.sort(rng.choice(words, rng.integers(0, 6), replace=False)).astype(np.int32) for _ in range(n)]
    return x, rng.random(n) < 0.3, rng.integers(1, 4, n), rng.normal(size=words + 1)


def plain_risk(x, confirmed, n, w, prior):
    """The risk and its part that is cut off at zero, text by text."""
    loss = lambda y, s: np.log1p(np.exp(-y * s))
    s = [w[-1] + sum(w[i] for i in row) for row in x]
    n_u, n_p = sum(n), sum(k for k, c in zip(n, confirmed, strict=True) if c)
    toxic = sum(k * loss(1, v) for k, v, c in zip(n, s, confirmed, strict=True) if c) / n_p
    as_clean = sum(k * loss(-1, v) for k, v, c in zip(n, s, confirmed, strict=True) if c) / n_p
    clean = sum(k * loss(-1, v) for k, v in zip(n, s, strict=True)) / n_u - prior * as_clean
    return prior * toxic + max(0, clean), prior * toxic, clean


@pytest.mark.parametrize("prior", [0.2, 0.95])
def test_risk_and_slopes_against_brute_force(prior):
    for seed in range(4):
        x, confirmed, n, w = some_rows(seed)
        if prior > 0.9:  # only confirmed texts look toxic, which pushes the rest below zero
            confirmed = np.array([0 in row for row in x])
            w[0], w[-1] = 4.0, -3.0
        of = lambda v: part_sums([r.tobytes() for r in x], confirmed.astype(float), n.astype(float), v)  # noqa: E731, B023
        n_u, n_p = int(n.sum()), int(n[confirmed].sum())
        value, slope = risk(of(w), n_u, n_p, prior)
        want, toxic, clean = plain_risk(x, confirmed, n, w, prior)
        assert value == pytest.approx(want) and value >= 0
        for i in range(len(w)):
            e = np.zeros(len(w))
            e[i] = 1e-5
            up, down = plain_risk(x, confirmed, n, w + e, prior), plain_risk(x, confirmed, n, w - e, prior)
            # Below zero the step goes against the slope of the part that was cut off.
            along = (up[1] + up[2] - down[1] - down[2]) if clean >= 0 else -(up[2] - down[2])
            assert slope[i] == pytest.approx(along / 2e-5, abs=1e-6)
    assert prior < 0.9 or clean < 0


def test_sums_of_all_texts(spark):
    rows = texts(200, 3)
    marked = spark.createDataFrame([(t, y == 1 and i % 4 == 0) for i, t, y in rows], "text string, confirmed boolean").repartition(5)
    n_p = sum(y == 1 and i % 4 == 0 for i, _, y in rows)
    counts = {r.code: (r.n_u, r.n_p) for r in text_counts(marked).collect()}
    lists = [features(t.encode()) for _, t, _ in rows]
    for code in list(counts)[:50]:
        assert counts[code] == (sum(code in x for x in lists), sum(code in x for x, (i, _, y) in zip(lists, rows, strict=True) if y == 1 and i % 4 == 0))
    words = telling(text_counts(marked), 200, n_p, 3.0)
    assert len(words) and set(words.tolist()) <= set(counts)
    w = np.random.default_rng(0).normal(size=len(words) + 1)
    own = [np.flatnonzero(np.isin(words, x)).astype(np.int32).tobytes() for x in lists]
    want = part_sums(own, np.array([float(y == 1 and i % 4 == 0) for i, _, y in rows]), np.ones(200), w)
    assert summed(encoded(marked, words), w) == pytest.approx(want)


def test_awkward_texts(spark, frame, no_rows, documents):
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = train(frame.select("doc_id", "text"), labels)
    found = scores(frame, model).collect()
    assert len(found) == len(documents) and all(0 <= r.score <= 1 for r in found)
    assert scores(no_rows, model).count() == 0
    none = train(no_rows.select("doc_id", "text"), labels.limit(0))
    assert {round(r.score, 6) for r in scores(frame, none).collect()} == {round(float(score(none, [b""])[0]), 6)}


def test_features():
    assert len(features(b"A a, a. B")) == 2 and len(features(b"")) == 0
