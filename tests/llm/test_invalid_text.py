"""Texts with bytes that are no UTF-8, through every operator."""

import pytest
from keyweave.llm import bpe, decontaminate, language_id, line_dedup, ppm, quality_rules, simhash_dedup, token_counts, toxicity, warc
from keyweave.llm.token_counts import Counter, read_pieces


@pytest.fixture(scope="module")
def broken(spark):
    rows = "values (1, 'FFFE20616263', '656E'), (2, '61C3', 'FF'), (3, 'E2820A61626320C328', '656E'), (4, '61626320646566', null), (5, null, null)"
    return spark.sql(f"select cast(a as long) doc_id, cast(unhex(b) as string) text, cast(unhex(c) as string) lang from {rows} as t(a, b, c)")


RUNS = {
    "toxicity": lambda d, s: toxicity.scores(d, toxicity.train(d, s.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))),
    "token_counts": lambda d, s: token_counts.token_counts(d),
    "bpe": lambda d, s: bpe.encode(d),
    "quality_rules": lambda d, s: quality_rules.judge(d),
    "decontaminate": lambda d, s: decontaminate.without_items(d, d.selectExpr("doc_id item_id", "text").limit(0)),
    "warc": lambda d, s: warc.page_records(d.selectExpr("doc_id page_id", "text url", "text html")),
    "ppm": lambda d, s: ppm.language_model_scores(d, d),
    "line_dedup": lambda d, s: line_dedup.remove_repeats(d, min_words=1),
    "language_id": lambda d, s: language_id.predict(d, language_id.train(d)),
    "simhash_dedup": lambda d, s: simhash_dedup.near_duplicates(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_every_row_has_a_result(spark, broken, name):
    out = RUNS[name](broken, spark)
    if name == "warc":
        path = warc.fresh_path(spark, "broken")
        warc.write_warc(out, path)
        assert warc.read_warc(spark, path).count() == 5
    else:
        out.write.format("noop").mode("overwrite").save()
        assert out.count() == 5


def test_words_that_are_no_text():
    counter = Counter(read_pieces())
    assert counter.count([b"\xff\xfe abc", "\ufffd\ufffd abc".encode()])[0][1] == counter.count(["\ufffd\ufffd abc".encode()])[0][1]
