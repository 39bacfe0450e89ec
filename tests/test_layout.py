from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from keyweave.operators.routing import built, probing, routes
from keyweave.plans.layout import cut, plan
from pyspark.sql import functions as F

SIZES = st.lists(st.integers(1, 400), min_size=1, max_size=9).map(lambda x: sorted(x, reverse=True))


@settings(max_examples=100, deadline=None)
@given(SIZES, st.integers(1, 600))
def test_cuts_are_the_fewest(m, most):
    cuts = cut(np.array(m, float), most, len(m))
    runs = [m[a:b] for a, b in zip(cuts, [*cuts[1:], len(m)])]
    assert sum(runs, []) == m and all(len(x) == 1 or sum(x) <= most for x in runs)
    fewer = (c for k in range(len(cuts) - 1) for c in combinations(range(1, len(m)), k))
    assert not any(all(len(m[a:b]) == 1 or sum(m[a:b]) <= most for a, b in zip((0, *c), (*c, len(m)))) for c in fewer)
    assert cut(np.array(m, float), most, len(cuts) - 1) == [] if len(cuts) > 1 else True


@settings(max_examples=100, deadline=None)
@given(SIZES, st.integers(0, 300), st.integers(0, 900), st.integers(2, 7))
def test_no_layout_has_a_smaller_largest_partition(m, more_r, more_s, n):
    layout = plan(np.array(m, float), len(m) + more_r, sum(m) + more_s, n, False)
    share = (len(m) + more_r + sum(m) + more_s) / n
    pieces = [max(1, min(n, -(-x // share))) for x in m]
    loads = [x / p + 1 for x, p in zip(m, pieces, strict=True) for _ in range(int(p))]
    best = min(
        max([(more_r + more_s) / (n - d), *(sum(loads[a:b]) for a, b in zip((0, *c), (*c, len(loads))))])
        for d in range(1, n) for c in combinations(range(1, len(loads)), d - 1)
    ) if len(loads) < 16 else layout.most
    assert layout.most <= best * (1 + 1e-6) + 1e-6
    assert layout.partitions == n and layout.rest >= 1 and layout.hot == 0
    assert all(0 <= p < layout.designated for parts in layout.parts for p in parts)


def test_hot_keys_are_everywhere():
    layout = plan(np.array([9000.0, 500, 80, 10, 9, 8, 1, 1]), 100, 11_000, 8, True)
    assert layout.hot == 1 and layout.parts[0] == tuple(range(8)) and all(len(x) == 1 for x in layout.parts[1:])
    assert len(plan(np.array([9000.0, 500]), 100, 11_000, 8, False).parts[0]) == 7
    assert plan(np.array([5.0]), 1, 5, 1).partitions == 1


def test_rows_meet_in_their_partitions(spark):
    layout = plan(np.array([900.0, 500, 80]), 50, 2000, 4, True)
    known = routes(spark, [0, 1, 2], layout, "bigint")
    r = spark.range(50).withColumnRenamed("id", "k")
    s = spark.range(2000).select((F.when(F.col("id") < 900, 0).when(F.col("id") < 1400, 1).when(F.col("id") < 1480, 2).otherwise(F.col("id") % 50)).cast("long").alias("f"))
    to = probing(s, "f", known, layout).withColumn("at", F.spark_partition_id())
    sizes = [x["count"] for x in to.groupBy("at").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 3 * np.median(sizes)
    assert to.where("at <> __to").isEmpty()
    there = {(x.k, x["__route"]) for x in built(r, "k", known, layout).collect()}
    assert {k for k, _ in there} == set(range(50))
    assert {(x.f, x["__to"]) for x in to.select("f", "__to").distinct().collect()} <= there


@pytest.mark.parametrize("hybrid", [True, False])
def test_fewer_partitions_than_hot_keys(hybrid):
    layout = plan(np.array([100.0] * 5), 5, 500, 3, hybrid)
    assert layout.partitions == 3 and len(layout.parts) == 5
