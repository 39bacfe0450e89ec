import datetime as dt

import pytest
from keyweave.sources.delimited import read_correlation, read_delimited, read_flat, write_correlation, write_delimited, write_flat
from keyweave.sources.fixedrec import FixedRecords
from keyweave.sources.schema import parse

TEXT = "6 1\nname 4 12\nid 2 8\nn 1 4\nx 3 8\nday 5 10\nsmall 3 4\n"
ROWS = [(1, "ab", -5, 1.5, dt.date(1996, 2, 29), 0.5), (2, 'a|"b"', 7, -2.25, None, 2.0), (3, None, 0, 0.0, dt.date(2000, 1, 1), 0.0)]


@pytest.fixture
def frame(spark):
    layout = parse(TEXT)
    return layout, spark.createDataFrame(ROWS, layout.struct)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_key_comes_first():
    layout = parse(TEXT)
    assert layout.key == "id" and [a.name for a in layout.attributes] == ["id", "name", "n", "x", "day", "small"]
    assert parse(layout.text) == layout
    assert len(layout.joined(layout).attributes) == 11
    for bad in ("2 0\na 1 4\n", "1 1\na 1 4\n", "1 0\na 1 3\n", "1 0\na 9 4\n"):
        with pytest.raises(ValueError):
            parse(bad)


def test_fixed_records(spark, frame, tmp_path):
    layout, df = frame
    spark.dataSource.register(FixedRecords)
    many = df.unionByName(spark.range(4, 5000).selectExpr("id", "cast(id as string) name", "cast(id as int) n", "id / 2.0D x", "date'1999-01-01' day", "cast(1 as float) small")).repartition(3)
    path = f"file://{tmp_path}/rec"
    many.write.format("fixedrec").option("schemaText", layout.text).mode("append").save(path)
    back = spark.read.format("fixedrec").load(path)
    assert back.columns == ["id", "name", "n", "x", "day", "small"]
    assert sorted(map(str, back.collect())) == sorted(map(str, many.collect()))


def test_fixed_records_reject_long_text(spark, frame, tmp_path):
    layout, df = frame
    spark.dataSource.register(FixedRecords)
    with pytest.raises(Exception, match="has room for 12 bytes"):
        df.selectExpr("id", "repeat('x', 13) name", "n", "x", "day", "small").write.format("fixedrec").option("schemaText", layout.text).mode("append").save(f"file://{tmp_path}/rec")


def test_no_records(spark, frame, tmp_path):
    layout, df = frame
    spark.dataSource.register(FixedRecords)
    df.limit(0).write.format("fixedrec").option("schemaText", layout.text).mode("append").save(f"{tmp_path}/rec")
    assert spark.read.format("fixedrec").load(f"{tmp_path}/rec").count() == 0


def test_delimited(spark, frame, tmp_path):
    layout, df = frame
    write_delimited(df, f"{tmp_path}/csv")
    assert sorted(map(str, read_delimited(spark, f"{tmp_path}/csv", layout).collect())) == sorted(map(str, df.collect()))


def test_correlation_file(spark, tmp_path):
    ct = spark.createDataFrame([(1, 5), (2, 9), (3, 0)], "key bigint, m bigint")
    write_correlation(ct, f"{tmp_path}/ct")
    assert rows(read_correlation(spark, f"{tmp_path}/ct")) == rows(ct)


def test_flat_files(spark, frame, tmp_path):
    layout, df = frame
    df = df.where("name is null or name not like '%|%'")
    order = ["name", "id", "small", "n", "x", "day"]
    write_flat(df.select(*order), f"{tmp_path}/flat")
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/flat").collect())
    assert lines == ["ab|1|0.5|-5|1.5|1996-02-29|", "|3|0.0|0|0.0|2000-01-01|"]
    assert rows(read_flat(spark, f"{tmp_path}/flat", layout, order)) == rows(df)
