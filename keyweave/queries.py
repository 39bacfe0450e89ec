"""Registered queries over the relational tables, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import load
from .functions.hashes import partition_id, rounded_partition_id
from .operators import joins, selection, statistics, workload
from .plans import tpch
from .session import fresh_path
from .sources.delimited import export_joined, read_delimited, read_flat, write_flat
from .sources.schema import parse
from .streaming.refresh import current, refreshed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Room for R that is small against the tables, so that only a part of it is kept at hand.
SMALL = 1 << 18


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def orders(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("prio"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("qty"))


def line_row() -> F.Column:
    """What tells the rows of lineitem apart as far as they differ, as text that any engine writes alike."""
    return F.concat_ws("-", *(F.col(c).cast("bigint").cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")))


def hot_lines(spark: SparkSession, d: str) -> DataFrame:
    """About 60 % of the rows refer to the keys 0 to 4."""
    return workload.hot_rekeyed(load(spark, d, "lineitem"), "l_orderkey", line_row()).select("l_orderkey", F.col("l_quantity").alias("qty"))


JOIN_SQL = "SELECT o_orderkey AS key, o_orderpriority AS prio, l_quantity AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
_ROW = "concat_ws('-', cast(l_orderkey AS bigint), cast(l_partkey AS bigint), cast(l_suppkey AS bigint), cast(l_linenumber AS bigint))"


def uniform_sql(key: str, seed: int = 0) -> str:
    return f"(('0x' || substr(md5(cast({key} AS varchar) || ':{seed}'), 1, 8))::bigint / 4294967296.0)"


HOT_SQL = f"SELECT CASE WHEN {uniform_sql(_ROW)} < 0.6 THEN cast(floor({uniform_sql(_ROW, 1)} * 5) AS bigint) ELSE l_orderkey END AS l_orderkey, l_quantity FROM lineitem"
HOT_JOIN_SQL = f"SELECT o_orderkey AS key, o_orderpriority AS prio, l_quantity AS qty FROM orders JOIN ({HOT_SQL}) ON o_orderkey = l_orderkey"


def result(df: DataFrame) -> DataFrame:
    return df.select(F.col("o_orderkey").alias("key"), "prio", "qty")


def _join(strategy: str, s: Query) -> Query:
    return lambda spark, d: result(joins.join_pkfk(orders(spark, d), s(spark, d), "o_orderkey", "l_orderkey", strategy, 2000, SMALL))


for _strategy in joins.STRATEGIES:
    query(f"join_{_strategy}", JOIN_SQL)(_join(_strategy, lines))
    query(f"join_skewed_{_strategy}", HOT_JOIN_SQL)(_join(_strategy, hot_lines))


@query("join_nbj_chunks", JOIN_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    r = orders(spark, d)
    return result(joins.nested_blocks(r, lines(spark, d), "o_orderkey", "l_orderkey", joins.measured(r)[1] // 4 + 1))


@query("join_hotcold", HOT_JOIN_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    r, s = orders(spark, d), hot_lines(spark, d)
    hot = statistics.top_keys(statistics.correlation_table(r, s, "o_orderkey", "l_orderkey"), 64)
    return result(joins.hot_and_cold(r, s, "o_orderkey", "l_orderkey", hot))


@query("join_semi_reduced", JOIN_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    return result(joins.semi_reduced(orders(spark, d), lines(spark, d), "o_orderkey", "l_orderkey"))


@query("join_fk_gap", JOIN_SQL + " WHERE o_orderkey % 5 <> 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return result(joins.join_pkfk(orders(spark, d).where("o_orderkey % 5 <> 0"), lines(spark, d), "o_orderkey", "l_orderkey", "correlated_hybrid", 2000))


@query("join_part", "SELECT p_partkey AS key, p_brand AS brand, l_quantity AS qty FROM part JOIN lineitem ON p_partkey = l_partkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    r, s = load(spark, d, "part"), load(spark, d, "lineitem")
    out = joins.join_pkfk(r.select("p_partkey", "p_brand"), s.select("l_partkey", "l_quantity"), "p_partkey", "l_partkey", "dhh_skew", room=SMALL)
    return out.select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand"), F.col("l_quantity").alias("qty"))


@query("join_customer", "SELECT c_custkey AS key, c_mktsegment AS segment, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    r, s = load(spark, d, "customer").select("c_custkey", "c_mktsegment"), load(spark, d, "orders").select("o_custkey", "o_orderkey")
    return joins.join_pkfk(r, s, "c_custkey", "o_custkey", "auto").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), "o_orderkey")


for _how, _sql in {
    "left": "SELECT o_orderkey AS key, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    "left_semi": "SELECT o_orderkey AS key, count(*) AS n FROM orders WHERE EXISTS (SELECT * FROM lineitem WHERE o_orderkey = l_orderkey) GROUP BY 1",
    "left_anti": "SELECT o_orderkey AS key, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT * FROM lineitem WHERE o_orderkey = l_orderkey) GROUP BY 1",
}.items():

    @query(f"join_{_how}", _sql)
    def _(spark: SparkSession, d: str, how: str = _how) -> DataFrame:
        r, s = orders(spark, d), lines(spark, d)
        n = F.count("l_orderkey") if how == "left" else F.count("*")
        return r.join(s, r.o_orderkey == s.l_orderkey, how).groupBy(F.col("o_orderkey").alias("key")).agg(n.alias("n"))


@query("join_cardinality", "SELECT count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    return joins.join_pkfk(orders(spark, d), lines(spark, d), "o_orderkey", "l_orderkey", "ghj").agg(F.count("*").alias("n"))


_REPORTED = ("smj", "ghj", "dhh", "correlated_hybrid")


@query(
    "join_report",
    f"SELECT strategy, (SELECT count(*) FROM orders) AS r_rows, (SELECT count(*) FROM lineitem) AS s_rows, (SELECT count(*) FROM ({HOT_JOIN_SQL})) AS rows "
    f"FROM (VALUES {', '.join(f"('{x}')" for x in _REPORTED)}) AS t(strategy)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "lines")
    hot_lines(spark, d).write.parquet(path)  # each join would compute the keys anew, most of them twice a row
    r, s = orders(spark, d), spark.read.parquet(path)
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    reports = [joins.reported(r, s, "o_orderkey", "l_orderkey", x, sink, k=2000, room=SMALL) for x in _REPORTED]
    return spark.createDataFrame([(x.strategy, x.r_rows, x.s_rows, x.rows) for x in reports], "strategy string, r_rows long, s_rows long, rows long")


@query("joined_export", "SELECT l_orderkey, l_quantity AS qty, o_orderpriority AS prio FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Joined records as delimited text, and read back."""
    r, s = parse("2 0\no_orderkey 1 8\nprio 4 16"), parse("2 0\nl_orderkey 1 8\nqty 3 8")
    path = fresh_path(spark, "joined")
    export_joined(joins.join_pkfk(orders(spark, d), lines(spark, d), "o_orderkey", "l_orderkey"), r, s, path)
    return read_delimited(spark, path, s.joined(r))


@query("flat_orders", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Orders as flat files with a separator after every field, and read back."""
    layout = parse("4 0\no_orderkey 1 8\no_custkey 1 8\no_totalprice 3 8\no_orderpriority 4 16")
    path = fresh_path(spark, "flat")
    write_flat(load(spark, d, "orders").select(*(a.name for a in layout.attributes)), path)
    return read_flat(spark, path, layout)


# Statistics.

CT_SQL = "SELECT o_orderkey AS key, count(l_orderkey) AS m FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"


def ct(spark: SparkSession, d: str) -> DataFrame:
    return statistics.correlation_table(orders(spark, d), lines(spark, d), "o_orderkey", "l_orderkey")


def md5_pid_sql(key: str, n: int) -> str:
    return f"cast(('0x' || substr(md5(cast({key} AS varchar)), 1, 8))::bigint % {n} AS integer)"


def rounded_pid_sql(key: str, n: int, chunks: int) -> str:
    return f"cast((('0x' || substr(md5(cast({key} AS varchar)), 1, 8))::bigint % {chunks}) % {n} AS integer)"


query("ct_full", CT_SQL)(ct)
query("ct_topk", f"{CT_SQL} ORDER BY m DESC, key LIMIT 100")(lambda s, d: statistics.top_keys(ct(s, d), 100))
query("ct_prefix_sum", f"SELECT key, m, cast(sum(m) OVER (ORDER BY m DESC, key ROWS UNBOUNDED PRECEDING) AS bigint) AS so_far FROM ({CT_SQL} ORDER BY m DESC, key LIMIT 1000)")(
    lambda s, d: statistics.ranked(statistics.top_keys(ct(s, d), 1000)).select("key", "m", "so_far")
)
query("ct_rank", f"SELECT key, m, cast(row_number() OVER (ORDER BY m DESC, key) AS integer) AS rank FROM ({CT_SQL} ORDER BY m DESC, key LIMIT 1000)")(
    lambda s, d: statistics.ranked(statistics.top_keys(ct(s, d), 1000)).select("key", "m", F.col("rank").cast("int"))
)
query("ct_prefix_sum_whole", f"SELECT key, m, cast(sum(m) OVER (ORDER BY m DESC, key ROWS UNBOUNDED PRECEDING) AS bigint) AS so_far FROM ({CT_SQL})")(
    lambda s, d: statistics.ranked(ct(s, d)).select("key", "m", "so_far")
)
query("ct_rank_whole", f"SELECT key, m, row_number() OVER (ORDER BY m DESC, key) AS rank FROM ({CT_SQL})")(lambda s, d: statistics.ranked(ct(s, d)).select("key", "m", "rank"))
query("ct_coverage", f"WITH ct AS ({CT_SQL}) SELECT cast(sum(m) AS bigint) AS covered, (SELECT cast(sum(m) AS bigint) FROM ct) AS total, sum(m) / (SELECT sum(m) FROM ct) AS ratio FROM (SELECT * FROM ct ORDER BY m DESC, key LIMIT 500)")(
    lambda s, d: statistics.coverage(ct(s, d), 500)
)
query("ct_histogram", f"SELECT m, count(*) AS keys FROM ({CT_SQL}) GROUP BY m")(lambda s, d: statistics.multiplicity_histogram(ct(s, d)))
query("partition_counts_hash", f"SELECT {md5_pid_sql('l_orderkey', 16)} AS pid, count(*) AS rows FROM lineitem GROUP BY 1")(
    lambda s, d: statistics.partition_counts(lines(s, d).withColumn("pid", partition_id(F.col("l_orderkey"), 16, "md5")))
)
query("partition_counts_rounded", f"SELECT {rounded_pid_sql('l_orderkey', 16, 40)} AS pid, count(*) AS rows FROM lineitem GROUP BY 1")(
    lambda s, d: statistics.partition_counts(lines(s, d).withColumn("pid", rounded_partition_id(F.col("l_orderkey"), 16, 40, "md5")))
)
query("partition_stats", f"WITH a AS (SELECT key, m, {md5_pid_sql('key', 64)} AS pid FROM ({CT_SQL})) SELECT key, m, pid, count(*) OVER (PARTITION BY pid) AS size FROM a")(
    lambda s, d: statistics.partition_statistics(ct(s, d).withColumn("pid", partition_id(F.col("key"), 64, "md5")))
)
query(
    "partition_histogram",
    f"WITH a AS (SELECT key, m, {md5_pid_sql('key', 64)} AS pid FROM ({CT_SQL})), p AS (SELECT pid, count(*) AS size, sum(m) AS rows FROM a GROUP BY pid) "
    "SELECT size, count(*) AS partitions, cast(sum(size) AS bigint) AS keys, cast(sum(rows) AS bigint) AS rows FROM p GROUP BY size",
)(lambda s, d: statistics.partition_histogram(ct(s, d).withColumn("pid", partition_id(F.col("key"), 64, "md5"))))

# Selections.

query("sample_left", f"SELECT o_orderkey, o_orderpriority AS prio FROM orders WHERE {uniform_sql('o_orderkey', 1)} < 0.4")(lambda s, d: selection.by_key(orders(s, d), "o_orderkey", 0.4, 1))
query("sample_right", f"SELECT l_orderkey, l_quantity AS qty FROM lineitem WHERE {uniform_sql('l_orderkey', 2)} < 0.3")(lambda s, d: selection.by_key(lines(s, d), "l_orderkey", 0.3, 2))
query("sample_join", f"{JOIN_SQL} WHERE {uniform_sql('o_orderkey', 1)} < 0.4 AND {uniform_sql('l_orderkey', 2)} < 0.3")(
    lambda s, d: result(joins.join_pkfk(selection.by_key(orders(s, d), "o_orderkey", 0.4, 1), selection.by_key(lines(s, d), "l_orderkey", 0.3, 2), "o_orderkey", "l_orderkey", "ghj"))
)
_DATES = "SELECT o_orderkey AS key, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE "
for _name, _first, _second in (("date_filter_hi", "o_orderdate", "l_shipdate"), ("date_filter_lo", "l_shipdate", "o_orderdate")):

    @query(_name, f"{_DATES} cast({_first} AS date) < cast({_second} AS date)")
    def _(spark: SparkSession, d: str, first: str = _first, second: str = _second) -> DataFrame:
        r, s = load(spark, d, "orders"), load(spark, d, "lineitem")
        return r.join(s, r.o_orderkey == s.l_orderkey).where(selection.earlier(first, second)).select(F.col("o_orderkey").alias("key"), "l_linenumber")


# Order and sets.

query("topk_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")(
    lambda s, d: load(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").limit(100)
)
query("sorted_orders", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderkey")(
    lambda s, d: load(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice").orderBy("o_custkey", "o_orderkey")
)


@query("union_partitions", JOIN_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Spark zips the partitions of the joins that are united: one task gets a partition of each, so their number follows from the rows of all."""
    r, s = orders(spark, d), lines(spark, d)
    n = joins.enough(r, s)
    even, odd = (joins.grace_hash(r.where(f"o_orderkey % 2 {x} 0"), s, "o_orderkey", "l_orderkey", n) for x in ("=", "<>"))
    return result(even.unionByName(odd))


query("except_unmatched", "SELECT o_orderkey AS key FROM orders EXCEPT SELECT l_orderkey FROM lineitem")(
    lambda s, d: orders(s, d).select(F.col("o_orderkey").alias("key")).exceptAll(lines(s, d).select("l_orderkey").distinct())
)

# Skewed relations and refreshes.

query("hot_ct", f"SELECT l_orderkey AS key, count(*) AS m FROM ({HOT_SQL}) GROUP BY 1")(lambda s, d: hot_lines(s, d).groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("m")))


def _drawn_ct(dist: str, **shape: float) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        n = load(spark, d, "part").count()
        return workload.rekeyed(load(spark, d, "lineitem"), "l_partkey", line_row(), n, dist, **shape).groupBy(F.col("l_partkey").alias("key")).agg(F.count("*").alias("m"))

    return run


_N = "(SELECT count(*) FROM part)"


def _within_sql(u: str) -> str:
    """A normal deviate between -2 and 2 below which lies a part u of those between them, as workload draws it."""
    low = NormalDist().cdf(-2)
    poly = lambda x, f: reduce(lambda out, y: f"({out} * {x} + ({y!r}))", f[1:], f"({f[0]!r})")
    p = f"({low!r} + ({u} + {2.0**-33!r}) * {1 - 2 * low!r})"
    q, t = f"({p} - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    near = f"({q} * {poly(f'({q} * {q})', workload.NEAR[0])} / {poly(f'({q} * {q})', workload.NEAR[1])})"
    far = f"({poly(t, workload.FAR[0])} / {poly(t, workload.FAR[1])})"
    return f"(CASE WHEN least({p}, 1 - {p}) >= {workload.TAIL!r} THEN {near} WHEN {q} < 0 THEN {far} ELSE -{far} END)"


_DRAWN = {
    "uniform_ct": (_drawn_ct("uniform"), f"{uniform_sql(_ROW)} * {_N}"),
    "zipf_ct": (_drawn_ct("zipf", alpha=1.0), f"exp({uniform_sql(_ROW)} * ln({_N} + 1)) - 1"),
    "beta_ct": (_drawn_ct("beta", alpha=2.0, beta=2.0), f"pow(1 - pow(1 - {uniform_sql(_ROW)}, 0.5), 0.5) * {_N}"),
    "beta_order_ct": (
        _drawn_ct("beta_order", alpha=2.0, beta=3.0),
        f"list_sort([{', '.join(uniform_sql(_ROW, i) for i in range(4))}])[2] * {_N}",
    ),
    "normal_ct": (_drawn_ct("normal"), f"greatest({_N} / 2.0 + {_within_sql(uniform_sql(_ROW))} * {_N} / 4.0, 0)"),
}
for _name, (_q, _x) in _DRAWN.items():
    query(_name, f"SELECT least(cast(floor({_x}) AS bigint), {_N} - 1) AS key, count(*) AS m FROM lineitem GROUP BY 1" if _x else None)(_q)

_NOISE = f"sqrt(-2 * ln(1 - {uniform_sql('key')})) * cos(2 * 3.141592653589793::double * {uniform_sql('key', 1)})"
query("noisy_ct", f"WITH ct AS ({CT_SQL}) SELECT key, cast(greatest(0, round(m + {_NOISE} * 0.08 * (SELECT avg(m) FROM ct))) AS bigint) AS m FROM ct")(lambda s, d: workload.noisy(ct(s, d), 0.08))
query("scattered_keys", "SELECT o_orderkey, cast((cast(o_orderkey AS hugeint) * 1000003 + 7) % (SELECT count(*) FROM orders) AS bigint) AS scattered, cast(floor(o_orderkey / 8) * 32 + o_orderkey % 8 AS bigint) AS sparse FROM orders")(
    lambda s, d: load(s, d, "orders").select("o_orderkey", workload.scattered(F.col("o_orderkey"), load(s, d, "orders").count(), shift=7).alias("scattered"), workload.sparse(F.col("o_orderkey")).alias("sparse"))
)


@query(
    "refresh_insert_delete",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 100 <> 3 UNION ALL SELECT o_orderkey + (SELECT max(o_orderkey) + 1 FROM orders), o_custkey FROM orders WHERE o_orderkey % 100 = 5",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    next_key = o.agg(F.max("o_orderkey") + 1).first()[0] or 0
    new = o.where("o_orderkey % 100 = 5").withColumn("o_orderkey", F.col("o_orderkey") + next_key)
    return refreshed(o, "o_orderkey", new, o.where("o_orderkey % 100 = 3").select(F.col("o_orderkey").alias("key")))


@query("refresh_changes", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 <> 1 OR o_orderkey % 4 >= 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Orders that came in four batches, of which the third deletes some of those before it."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    came = o.select("*", F.lit(False).alias("deleted"), (F.col("o_orderkey") % 4).cast("int").alias("batch"))
    gone = o.where("o_orderkey % 10 = 1").select("*", F.lit(True).alias("deleted"), F.lit(2).alias("batch"))
    return current(came.unionByName(gone), "o_orderkey", version="batch")


# The decision-support queries.

for _q in (*tpch.QUERIES, *tpch.VARIANTS, *tpch.REBOUND):
    _name = _q if _q.startswith("jcch") else f"tpch_{_q}"
    query(_name, tpch.standard_sql(_q))(lambda s, d, q=_q: tpch.run(s, d, q))

for _q in tpch.DRAWS:
    query(f"drawn_{_q}", tpch.standard_sql(_q, **tpch.drawn(_q, 1)))(lambda s, d, q=_q: tpch.run(s, d, q, **tpch.drawn(q, 1)))
