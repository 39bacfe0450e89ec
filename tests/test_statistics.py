"""Statistics of a correlation table."""

import pytest
from keyweave.operators import statistics
from keyweave.queries import QUERIES


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_ranks_and_sums_of_all_keys(spark, coalesce):
    rows = [(k, 1000 if k == 77 else k % 3) for k in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        found = statistics.ranked(spark.createDataFrame(rows, "key long, m long")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, so_far = [], 0
    for rank, (k, m) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        so_far += m
        want.append((k, m, rank, so_far))
    assert sorted(map(tuple, found), key=lambda r: r[2]) == want


def test_no_keys_to_rank(spark):
    assert statistics.ranked(spark.createDataFrame([], "key long, m long")).collect() == []


@pytest.mark.parametrize("name", ["ct_prefix_sum_whole", "ct_rank_whole"])
def test_every_order_has_a_row(spark, data, name):
    assert QUERIES[name](spark, data).count() == QUERIES["ct_full"](spark, data).count() > 1000
