import corpus_pipeline
import pytest
from keyweave.llm.bpe import read_vocabulary
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def steps(spark, data, tmp_path_factory):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], data).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_every_stage_has_its_effect(steps):
    docs, good, lines, copies, clean, codes = steps
    for df in (good, lines, copies, clean):
        assert df.columns == docs.columns
    sizes = [df.count() for df in steps]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] > sizes[-1] > 0.5 * sizes[0]
    assert lines.agg({"n_chars": "sum"}).first()[0] < good.agg({"n_chars": "sum"}).first()[0]


def test_codes_are_the_librarys(steps):
    library = Tokenizer.from_file(read_vocabulary())
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    found = steps[5].collect()
    assert {r.doc_id for r in found} == texts.keys()
    for r in found:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids) and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_run_gives_the_same(spark, data, steps):
    assert corpus_pipeline.run(spark, data).exceptAll(steps[-1]).isEmpty()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_awkward_documents(spark, frame, no_rows, data, name, stage):
    """Nulls, empty, long and repeated texts, repeated rows, and columns with the names that operators use."""
    df = frame.withColumns({c: frame["n"] for c in ("__removed", "__lines", "gone", "copy", "row", "words", "fp")})
    out = stage(spark, df, data)
    rows = out.collect()
    if name == "bpe_encoding":
        assert len(rows) == frame.count()
    else:
        assert out.columns == df.columns and {r.doc_id for r in rows} <= {r.doc_id for r in frame.collect()} and rows
        assert all(r["__removed"] == 2 and r.h == 4 for r in rows)
    assert stage(spark, df.limit(0), data).count() == 0


def test_ties_and_repeated_rows(spark, data):
    text = " ".join(f"word{i} and more of it" for i in range(30))
    docs = spark.createDataFrame([(2, text), (1, text), (1, text), (None, text), (3, None)], "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) lang", "'s' source", "length(text) n_chars")
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, data).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in kept if r.doc_id is not None) == [(False, 1), (False, 1), (False, 3)] and sum(r.doc_id is None for r in kept) == 1
    lines = dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, data).collect()
    # A null id comes first and keeps the passage; what consisted of it alone goes. Null text stays.
    assert sorted(r.doc_id or 0 for r in lines) == [0, 3]
