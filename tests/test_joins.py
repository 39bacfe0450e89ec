import re

import pytest
from keyweave.operators import joins
from keyweave.operators.statistics import correlation_table, top_keys
from keyweave.operators.workload import hot_rekeyed, pair
from keyweave.queries import QUERIES
from pyspark.sql import functions as F

#: Bytes of R that are kept at hand.
TINY = 20_000


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def picked(df):
    return df.select("k", "a", "b")


def relations(spark, r_rows, s_rows, dist="zipf"):
    r, s = pair(spark, r_rows, s_rows, dist, payload=8)
    return r.select(F.col("key").alias("k"), F.col("value").alias("a")), s.select(F.col("key").alias("f"), F.col("value").alias("b"))


@pytest.mark.parametrize("strategy", joins.STRATEGIES)
def test_strategies_agree(spark, strategy):
    r, s = relations(spark, 3000, 9000)
    s = s.where("f % 7 <> 0").unionByName(spark.createDataFrame([(None, "x"), (10**9, "y")], "f bigint, b string"))
    r = r.unionByName(spark.createDataFrame([(None, "n")], "k bigint, a string"))
    found = joins.join_pkfk(r, s, "k", "f", strategy, 500, TINY, check_unique=True)
    assert same(picked(found), picked(joins.plain(r, s, "k", "f")))


@pytest.mark.parametrize("strategy", joins.STRATEGIES)
@pytest.mark.parametrize("r_rows,s_rows", [(0, 5), (5, 0), (1, 40)])
def test_small_inputs(spark, strategy, r_rows, s_rows):
    r, s = relations(spark, max(1, r_rows), max(1, s_rows), "uniform")
    found = joins.join_pkfk(r.limit(r_rows), s.limit(s_rows), "k", "f", strategy, room=TINY)
    assert found.count() == (s_rows if r_rows else 0)


def test_one_hot_key(spark):
    r, s = relations(spark, 100, 5000, "uniform")
    s = hot_rekeyed(s, "f", F.col("b"), 1.0, 1)
    assert joins.join_pkfk(r, s, "k", "f", "correlated_hybrid").count() == 5000


def test_repeated_key_is_refused(spark):
    r, s = relations(spark, 10, 10)
    with pytest.raises(ValueError, match="not unique"):
        joins.join_pkfk(r.unionAll(r), s, "k", "f", "smj", check_unique=True)
    with pytest.raises(ValueError, match="no strategy"):
        joins.join_pkfk(r, s, "k", "f", "fastest")
    with pytest.raises(ValueError, match="no hash"):
        joins.join_pkfk(r, s, "k", "f", "smj", fn="rot13")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_physical_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r, s = relations(spark, 1000, 3000)
        assert "BroadcastHashJoin" in plan_of(joins.join_pkfk(r, s, "k", "f", "nbj"))
        assert "SortMergeJoin" in plan_of(joins.join_pkfk(r, s, "k", "f", "smj"))
        assert "ShuffledHashJoin" in plan_of(joins.join_pkfk(r, s, "k", "f", "ghj"))
        hot = top_keys(correlation_table(r, s, "k", "f"), 5)
        both = plan_of(joins.hot_and_cold(r, s, "k", "f", hot))
        assert "BroadcastHashJoin" in both and "ShuffledHashJoin" in both
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_chunks_fall_back_to_hashing(spark):
    r, s = relations(spark, 1000, 3000)
    held = joins.measured(r)[1]
    assert "Union" not in plan_of(joins.nested_blocks(r, s, "k", "f", held // 100))
    assert plan_of(joins.nested_blocks(r, s, "k", "f", held // 3 + 1)).count("BroadcastHashJoin") == 3


def test_chunks_count_together(spark, monkeypatch):
    """The driver holds all chunks of a plan at once, so smaller ones don't let more of R be broadcast."""
    r, s = relations(spark, 1000, 3000)
    held = joins.measured(r)[1]
    monkeypatch.setattr(joins, "CHUNK_BYTES", held)
    assert plan_of(joins.nested_blocks(r, s, "k", "f", held // 4 + 1)).count("BroadcastHashJoin") == 4
    monkeypatch.setattr(joins, "CHUNK_BYTES", held - 1)
    found = joins.nested_blocks(r, s, "k", "f", held // 4 + 1)
    assert "Broadcast" not in plan_of(found) and "ShuffledHashJoin" in plan_of(found)
    assert same(picked(found), picked(joins.plain(r, s, "k", "f")))


def test_what_was_done(spark):
    r, s = relations(spark, 3000, 9000)
    s = hot_rekeyed(s, "f", F.col("b"), 0.9, 2)
    of = lambda x, **o: joins.reported(r, s, "k", "f", x, lambda df: df.write.format("noop").mode("overwrite").save(), **o)
    assert {of(x).rows for x in joins.STRATEGIES} == {9000}
    assert "2 hot keys in every partition" in of("correlated_hybrid").how
    assert "hot keys broadcast" in of("dhh_skew").how and "R broadcast in 1 chunks" in of("auto").how
    assert "parts of R broadcast" in of("dhh", room=TINY).how and of("dhh", room=0).how == "both sides hashed"
    report = of("smj")
    assert (report.r_rows, report.s_rows, report.how) == (3000, 9000, "both sides sorted") and report.seconds > 0


def test_no_task_gets_a_heavy_key(spark):
    r, s = relations(spark, 3000, 60_000)
    s = hot_rekeyed(s, "f", F.col("b"), 0.6, 2)
    for strategy in ("correlated", "correlated_hybrid", "ocap", "ocap_hybrid"):
        rows = [x["count"] for x in joins.join_pkfk(r, s, "k", "f", strategy).groupBy(F.spark_partition_id()).count().collect()]
        assert max(rows) < 3 * sorted(rows)[len(rows) // 2]


def test_union_of_joins_gets_partitions_by_rows(spark, data, monkeypatch):
    """No task of the united joins gets all rows because they are few bytes."""
    monkeypatch.setattr(joins, "ROWS", 500, raising=False)
    rows = [x["count"] for x in QUERIES["union_partitions"](spark, data).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == spark.read.parquet(f"{data}/lineitem.parquet").count() and max(rows) < 1000
    assert joins.enough(spark.range(0)) == 1 and joins.enough(spark.range(501), spark.range(500)) == 3


def test_report_computes_keys_once(spark, data, monkeypatch):
    """The joins that are compared read the drawn keys; none draws them again."""
    real, plans = joins.reported, []
    monkeypatch.setattr(joins, "reported", lambda r, s, *a, **o: plans.append(plan_of(s)) or real(r, s, *a, **o))
    QUERIES["join_report"](spark, data)
    assert len(plans) == 4 and not any("md5" in x for x in plans)


def test_sort_merge_holds_rows_of_the_unique_side(spark):
    r, s = relations(spark, 100, 3000)
    found = joins.join_pkfk(r, s, "k", "f", "smj")
    assert found.columns == ["k", "a", "f", "b"] and same(found, joins.plain(r, s, "k", "f"))
    assert re.search(r"SortMergeJoin \[f#\d+L\], \[k#\d+L\]", plan_of(found))
