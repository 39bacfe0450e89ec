import random

import numpy as np
from keyweave.llm import language_id
from keyweave.llm.language_id import UNKNOWN, Languages, Settings, mixtures, predict, train, word_logs

SYLLABLES = {"aa": "ka to mi re su no".split(), "bb": "sch ung heit ver ich".split(), "cc": "é eau oux tion qu".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(spark, n=300):
    rng = random.Random(4)
    rows = [(i, prose(rng, lang := rng.choice(list(SYLLABLES)), 60).capitalize(), lang) for i in range(n)]
    return spark.createDataFrame([*rows, (900, None, "aa"), (901, "katomi", None)], "doc_id long, text string, lang string"), rng


def test_languages_and_mixtures(spark):
    docs, rng = corpus(spark)
    known = train(docs)
    assert known.names == ["aa", "bb", "cc"] and np.allclose(np.exp(known.logs.astype(float)).sum(axis=0), 1, atol=1e-3)
    tests = [(i, prose(rng, lang, 40), lang) for i, lang in enumerate(list(SYLLABLES) * 20)]
    mixed = prose(rng, "aa", 150) + " " + prose(rng, "cc", 50)
    odd = [(100, mixed, "aa"), (101, None, UNKNOWN), (102, "", UNKNOWN), (103, "123 ... !", UNKNOWN), (104, "—…", UNKNOWN)]
    df = spark.createDataFrame([*tests, *odd, tests[0]], "doc_id long, text string, want string").drop("want")
    found = {r.id: r for r in predict(df, known).collect()}
    assert all(found[i].lang_pred == want for i, _, want in [*tests, *odd])
    assert all(0 <= r.score <= 1 for r in found.values())
    assert set(found[100].proportions) == {"aa", "cc"} and 0.65 < found[100].score < 0.85
    assert all(len(found[i].proportions) == 1 for i, _, _ in tests)


def test_words_of_pages(monkeypatch):
    rng = random.Random(2)
    logs = np.log(np.random.default_rng(0).dirichlet(np.ones(language_id.BUCKETS), 2).T).astype(np.float32)
    texts = [prose(rng, "cc", rng.randint(0, 30)).encode() for _ in range(20)] + [b"", b"...", b"a"]
    whole, counts = word_logs(texts, logs)
    assert counts.tolist() == [len(t.split()) if t != b"..." else 0 for t in texts]
    alone = [word_logs([t], logs)[0] for t in texts]
    assert np.allclose(np.concatenate(alone), whole, atol=1e-4)
    monkeypatch.setattr(language_id, "PAGE", 64)
    assert np.allclose(word_logs(texts, logs)[0], whole, atol=1e-4)
    assert word_logs(texts, logs)[1].tolist() == counts.tolist()


def test_plain_expectation_maximisation():
    rng = np.random.default_rng(1)
    logs = np.log(rng.dirichlet(np.ones(language_id.BUCKETS) * 0.05, 2).T + 1e-9).astype(np.float32)
    text = b"kato miresu noka verich heitung quoux tion kato"
    words = word_logs([text], logs)[0].astype(float)
    p = np.exp(words - words.max(axis=1, keepdims=True))
    share = np.array([0.5, 0.5])
    for _ in range(30):
        r = p * share
        share = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
    found = mixtures([text], Languages(["a", "b"], logs), Settings(rounds=30, cost_log=-10, cost_share=0))
    assert np.allclose(found[0], share, atol=1e-3)


def test_awkward_texts(frame, no_rows, documents):
    known = train(frame)
    assert predict(frame, known).count() == len(documents)
    assert predict(no_rows, known).count() == 0
    nothing = train(no_rows)
    assert {r.lang_pred for r in predict(frame, nothing).collect()} == {UNKNOWN}


def plain_mixture(logs, s):
    """One text at a time: the likeliest language, then others while the likelihood, less the price of each, rises."""
    n, kinds = logs.shape
    above = logs - logs.max(axis=1, keepdims=True)
    likely = np.exp(np.maximum(above, -30))

    def fitted(allowed):
        share = np.array([1 / len(allowed) if i in allowed else 0.0 for i in range(kinds)])
        for _ in range(s.rounds):
            share = np.mean([w * share / (w * share).sum() for w in likely], axis=0)
        return share, sum(np.log((w * share).sum()) for w in likely)

    top = int(above.sum(axis=0).argmax())
    share, reached = np.eye(kinds)[top], above.sum(axis=0)[top]
    price = s.cost_log * np.log(n) + s.cost_share * n
    if reached < -price:
        every = fitted(range(kinds))[0]
        order = [top] + sorted((i for i in range(kinds) if i != top), key=lambda i: (-every[i], i))
        for k in range(2, kinds + 1):
            more, fit = fitted(order[:k])
            if fit <= reached + price:
                break
            share, reached = more, fit
    return share


def test_three_languages_and_the_price():
    logs = np.log(np.random.default_rng(3).dirichlet(np.ones(language_id.BUCKETS) * 0.05, 3).T + 1e-9).astype(np.float32)
    rng = random.Random(5)
    texts = [prose(rng, rng.choice(list(SYLLABLES)), rng.randint(1, 25)).encode() for _ in range(40)]
    sizes = set()
    for settings in (Settings(), Settings(rounds=20, cost_log=0.1, cost_share=0.0), Settings(rounds=20, cost_log=5.0, cost_share=0.5)):
        found = mixtures(texts, Languages(["a", "b", "c"], logs), settings)
        for text, row in zip(texts, found, strict=True):
            want = plain_mixture(word_logs([text], logs)[0].astype(float), settings)
            assert np.allclose(row, want, atol=1e-3)
            sizes.add(int((want > 0).sum()))
    assert sizes == {1, 2, 3}
