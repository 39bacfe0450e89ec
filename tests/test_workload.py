from bisect import bisect_right
from math import comb
from statistics import NormalDist

import pytest
from keyweave.functions.hashes import HASHES, hashed, partition_id, rounded_partition_id
from keyweave.operators import selection, statistics, workload
from keyweave.streaming.refresh import apply_stream, current, refreshed
from pyspark.sql import functions as F


@pytest.mark.parametrize("dist", workload.DISTRIBUTIONS)
def test_drawn_keys_are_in_range(spark, dist):
    r, s = workload.pair(spark, 50, 4000, dist, payload=4)
    ct = statistics.correlation_table(r, s, "key", "key")
    assert ct.agg(F.sum("m")).first()[0] == 4000
    assert s.agg(F.min("key"), F.max("key")).first()[0] >= 0
    m = [x.m for x in statistics.top_keys(ct, 50).collect()]
    assert (m[0] > 5 * m[25]) == (dist == "zipf")
    assert sorted(x[0] for x in s.repartition(7).select("key").collect()) == sorted(x[0] for x in s.select("key").collect())


@pytest.mark.parametrize("dev", [0.2, 1.0, 5.0])
def test_normal_keys_as_if_those_out_of_range_were_rejected(spark, dev):
    n = 20000
    keys = sorted(r[0] for r in spark.range(n).select(workload.drawn(F.col("id"), 1000, "normal", dev=dev)).collect())
    d = NormalDist(500, dev * 250)
    low, high = d.cdf(0), d.cdf(1000)
    assert 0 <= keys[0] and keys[-1] < 1000
    assert max(abs((d.cdf(k + 1) - low) / (high - low) - bisect_right(keys, k) / n) for k in range(1000)) < 0.012


def test_normal_without_deviation(spark):
    assert spark.range(50).select(workload.drawn(F.col("id"), 1000, "normal", dev=0.0)).distinct().collect() == [(500,)]


def test_maps_of_keys(spark):
    n = spark.range(1000)
    assert n.select(workload.scattered(F.col("id"), 1000)).distinct().count() == 1000
    assert [r[0] for r in n.select(workload.sparse(F.col("id"))).limit(17).collect()] == [*range(8), *range(32, 40), 64]


def test_noise(spark):
    ct = spark.range(2000).select(F.col("id").alias("key"), F.lit(10).alias("m"))
    lo, hi, mean = workload.noisy(ct, 0.5).agg(F.min("m"), F.max("m"), F.avg("m")).first()
    assert lo >= 0 and hi > 15 and abs(mean - 10) < 1
    assert workload.noisy(ct, 0.0).where("m <> 10").count() == 0


def test_hashes(spark):
    df = spark.range(3000)
    for fn in HASHES:
        pid = df.select(partition_id(F.col("id"), 8, fn).alias("p")).groupBy("p").count().collect()
        assert len(pid) == 8 and min(r["count"] for r in pid) > 200
        assert df.select(hashed(F.col("id"), fn)).schema[0].dataType.simpleString() == "bigint"
    assert df.select(rounded_partition_id(F.col("id"), 4, 10)).distinct().count() == 4


def test_samples(spark):
    df = spark.range(5000)
    assert 1700 < selection.by_key(df, "id", 0.4).count() < 2300
    assert selection.by_key(df, "id", 0).count() == 0 and selection.by_key(df, "id", 1).count() == 5000
    assert selection.bernoulli(df, 0.4, 3).count() == selection.bernoulli(df, 0.4, 3).count()
    with pytest.raises(ValueError):
        selection.bernoulli(df, 1.5)


def test_refresh(spark):
    df = spark.range(10).withColumn("v", F.lit("old"))
    out = refreshed(df, "id", spark.createDataFrame([(20, "new")], df.schema), spark.createDataFrame([(3,), (3,), (99,)], "key bigint"))
    assert sorted(r.id for r in out.collect()) == [0, 1, 2, 4, 5, 6, 7, 8, 9, 20]


def test_refresh_stream(spark, tmp_path):
    changes = spark.createDataFrame([(1, "a", False), (2, "b", False)], "id bigint, v string, deleted boolean")
    changes.write.parquet(f"{tmp_path}/in/b=0")
    stream = lambda: spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in/*")
    apply_stream(stream(), "id", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    spark.createDataFrame([(1, "", True), (3, "c", False)], changes.schema).write.parquet(f"{tmp_path}/in/b=1")
    apply_stream(stream(), "id", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    written = spark.read.parquet(f"{tmp_path}/out")
    assert written.where("__batch = 1").count() == 2  # the second batch wrote its own changes alone
    assert sorted(tuple(r) for r in current(written, "id").collect()) == [(2, "b"), (3, "c")]
    base = spark.createDataFrame([(1, "z"), (7, "y"), (None, "x")], "id bigint, v string")
    assert sorted((r.id or 0, r.v) for r in current(written, "id", base).collect()) == [(0, "x"), (2, "b"), (3, "c"), (7, "y")]


def test_current_is_what_refreshes_give(spark):
    """Deleted and inserted again, deleted twice, inserted and deleted in one batch: as one refresh after the other."""
    columns = "id bigint, w string, deleted boolean"
    batches = [
        [(1, "a", False), (2, "b", False), (None, "n", False)],
        [(1, "", True), (1, "c", False), (4, "d", False)],
        [(4, "", True), (4, "", True), (2, "", True), (None, "", True)],
        [(2, "e", False), (1, "f", False)],
    ]
    state = spark.createDataFrame([(9, "base"), (1, "base")], "id bigint, w string")
    base, log = state, None
    for n, b in enumerate(batches):
        change = spark.createDataFrame(b, columns)
        state = refreshed(state, "id", change.where("not deleted").drop("deleted"), change.where("deleted").select(F.col("id").alias("key")))
        change = change.withColumn("__batch", F.lit(n))
        log = change if log is None else log.unionByName(change)
    out = lambda df: sorted((r.id or 0, r.w) for r in df.collect())
    assert out(current(log, "id", base)) == out(state)
    assert out(current(log.limit(0), "id", base)) == out(base)


@pytest.mark.parametrize("alpha, beta", [(1, 1), (2, 2), (2, 5), (4, 1)])
def test_beta_keys(spark, alpha, beta):
    n = 20000
    keys = sorted(r[0] for r in spark.range(n).select(workload.drawn(F.col("id"), 500, "beta_order", alpha=alpha, beta=beta)).collect())
    assert 0 <= keys[0] and keys[-1] < 500
    of = alpha + beta - 1
    cdf = lambda x: sum(comb(of, j) * x**j * (1 - x) ** (of - j) for j in range(alpha, of + 1))
    assert max(abs(cdf((k + 1) / 500) - bisect_right(keys, k) / n) for k in range(500)) < 0.012
    with pytest.raises(ValueError):
        workload.drawn(F.col("id"), 500, "beta_order", alpha=1.5)
