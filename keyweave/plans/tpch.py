"""The decision-support query set, with parameters, over the tables that are at hand.

A query is SQL text with {table} for its tables and :name for its parameters, so one
text serves Spark and any other engine. Where a table or column is missing (partsupp,
receipt and commit dates, ship modes, containers, phone numbers), the nearest one
takes its place and the operators stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from random import Random

from pyspark.sql import DataFrame, SparkSession

from ..catalog import TABLES, load

REVENUE = "l_extendedprice * (1 - l_discount)"
#: Offers of a part by a supplier, from what was sold.
PARTSUPP = "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice / l_quantity) AS ps_cost, sum(l_quantity) AS ps_qty FROM {lineitem} GROUP BY l_partkey, l_suppkey)"


@dataclass(frozen=True)
class Query:
    text: str
    params: dict[str, object] = field(default_factory=dict)


QUERIES: dict[str, Query] = {
    "q01": Query(
        f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
          round(sum({REVENUE}), 2) AS sum_disc_price, round(sum({REVENUE} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty,
          round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
        FROM {{lineitem}} WHERE l_shipdate <= date '1998-12-01' - interval :days day GROUP BY l_returnflag, l_linestatus""",
        {"days": "90"},
    ),
    "q02": Query(
        f"""WITH ps AS {PARTSUPP}
        SELECT round(s_acctbal, 2) AS s_acctbal, s_name, n_name, p_partkey, p_brand, s_suppkey
        FROM {{part}}, {{supplier}}, ps, {{nation}}, {{region}}
        WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size BETWEEN :low AND :high AND p_type LIKE :type
          AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = :region
          AND ps_cost = (SELECT min(ps_cost) FROM ps, {{supplier}}, {{nation}}, {{region}} WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey
            AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = :region)
        ORDER BY s_acctbal DESC, n_name, s_name, p_partkey, s_suppkey LIMIT 100""",
        {"low": 10, "high": 20, "type": "%O%", "region": "ASIA"},
    ),
    "q03": Query(
        f"""SELECT l_orderkey, round(sum({REVENUE}), 2) AS revenue, o_orderdate
        FROM {{customer}}, {{orders}}, {{lineitem}}
        WHERE c_mktsegment = :segment AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < cast(:date AS date) AND l_shipdate > cast(:date AS date)
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
        {"segment": "BUILDING", "date": "1998-03-15"},
    ),
    "q04": Query(
        """SELECT o_orderpriority, count(*) AS order_count FROM {orders}
        WHERE o_orderdate >= cast(:date AS date) AND o_orderdate < cast(:date AS date) + interval '3' month
          AND EXISTS (SELECT * FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
        GROUP BY o_orderpriority""",
        {"date": "1997-07-01"},
    ),
    "q05": Query(
        f"""SELECT n_name, round(sum({REVENUE}), 2) AS revenue
        FROM {{customer}}, {{orders}}, {{lineitem}}, {{supplier}}, {{nation}}, {{region}}
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
          AND n_regionkey = r_regionkey AND r_name = :region AND o_orderdate >= cast(:date AS date) AND o_orderdate < cast(:date AS date) + interval '1' year
        GROUP BY n_name""",
        {"region": "ASIA", "date": "1997-01-01"},
    ),
    "q06": Query(
        """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem}
        WHERE l_shipdate >= cast(:date AS date) AND l_shipdate < cast(:date AS date) + interval '1' year AND l_discount BETWEEN :low AND :high AND l_quantity < :quantity""",
        {"date": "1997-01-01", "low": 0.045, "high": 0.075, "quantity": 24},
    ),
    "q07": Query(
        f"""SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM (
          SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, cast(extract(year FROM l_shipdate) AS bigint) AS l_year, {REVENUE} AS volume
          FROM {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} n1, {{nation}} n2
          WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
            AND ((n1.n_name = :one AND n2.n_name = :two) OR (n1.n_name = :two AND n2.n_name = :one))
            AND l_shipdate BETWEEN cast(:first AS date) AND cast(:last AS date)) AS shipping
        GROUP BY supp_nation, cust_nation, l_year""",
        {"one": "NATION_3", "two": "NATION_7", "first": "1995-01-01", "last": "1998-12-31"},
    ),
    "q08": Query(
        f"""SELECT o_year, round(sum(CASE WHEN nation = :nation THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
          SELECT cast(extract(year FROM o_orderdate) AS bigint) AS o_year, {REVENUE} AS volume, n2.n_name AS nation
          FROM {{part}}, {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} n1, {{nation}} n2, {{region}}
          WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
            AND n1.n_regionkey = r_regionkey AND r_name = :region AND s_nationkey = n2.n_nationkey
            AND o_orderdate BETWEEN cast(:first AS date) AND cast(:last AS date) AND p_type = :type) AS all_nations
        GROUP BY o_year""",
        {"nation": "NATION_3", "region": "AMERICA", "first": "1995-01-01", "last": "2001-12-31", "type": "ECONOMY"},
    ),
    "q09": Query(
        f"""WITH ps AS {PARTSUPP}
        SELECT nation, o_year, round(sum(amount), 2) AS sum_profit FROM (
          SELECT n_name AS nation, cast(extract(year FROM o_orderdate) AS bigint) AS o_year, {REVENUE} - 0.1 * ps_cost * l_quantity AS amount
          FROM {{part}}, {{supplier}}, {{lineitem}}, ps, {{orders}}, {{nation}}
          WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey
            AND s_nationkey = n_nationkey AND p_name LIKE :name) AS profit
        GROUP BY nation, o_year""",
        {"name": "%widget%"},
    ),
    "q10": Query(
        f"""SELECT c_custkey, c_name, round(sum({REVENUE}), 2) AS revenue, round(c_acctbal, 2) AS c_acctbal, n_name
        FROM {{customer}}, {{orders}}, {{lineitem}}, {{nation}}
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= cast(:date AS date) AND o_orderdate < cast(:date AS date) + interval '3' month
          AND l_returnflag = 'R' AND c_nationkey = n_nationkey
        GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
        {"date": "1997-10-01"},
    ),
    "q11": Query(
        f"""WITH ps AS {PARTSUPP}
        SELECT ps_partkey, round(sum(ps_cost * ps_qty), 2) AS value FROM ps, {{supplier}}, {{nation}}
        WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = :nation GROUP BY ps_partkey
        HAVING sum(ps_cost * ps_qty) > (SELECT sum(ps_cost * ps_qty) * :fraction FROM ps, {{supplier}}, {{nation}}
          WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = :nation)""",
        {"nation": "NATION_7", "fraction": 0.001},
    ),
    "q12": Query(
        """SELECT l_returnflag AS l_shipmode,
          cast(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS bigint) AS high_line_count,
          cast(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS bigint) AS low_line_count
        FROM {orders}, {lineitem}
        WHERE o_orderkey = l_orderkey AND l_returnflag IN (:one, :two) AND o_orderdate < l_shipdate
          AND l_shipdate >= cast(:date AS date) AND l_shipdate < cast(:date AS date) + interval '1' year
        GROUP BY l_returnflag""",
        {"one": "A", "two": "R", "date": "1997-01-01"},
    ),
    "q13": Query(
        """SELECT c_count, count(*) AS custdist FROM (
          SELECT c_custkey, count(o_orderkey) AS c_count FROM {customer} LEFT OUTER JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority NOT LIKE :word
          GROUP BY c_custkey) AS c_orders GROUP BY c_count""",
        {"word": "%URGENT%"},
    ),
    "q14": Query(
        f"""SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) / sum({REVENUE}), 6) AS promo_revenue
        FROM {{lineitem}}, {{part}} WHERE l_partkey = p_partkey AND l_shipdate >= cast(:date AS date) AND l_shipdate < cast(:date AS date) + interval '1' month""",
        {"date": "1997-09-01"},
    ),
    "q15": Query(
        f"""WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum({REVENUE}), 2) AS total_revenue FROM {{lineitem}}
          WHERE l_shipdate >= cast(:date AS date) AND l_shipdate < cast(:date AS date) + interval '3' month GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total_revenue FROM {{supplier}}, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue)""",
        {"date": "1997-01-01"},
    ),
    "q16": Query(
        f"""WITH ps AS {PARTSUPP}
        SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM ps, {{part}}
        WHERE p_partkey = ps_partkey AND p_brand <> :brand AND p_type NOT LIKE :type AND p_size IN (1, 4, 7, 14, 23, 36, 45, 49)
          AND ps_suppkey NOT IN (SELECT s_suppkey FROM {{supplier}} WHERE s_acctbal < 0)
        GROUP BY p_brand, p_type, p_size""",
        {"brand": "Brand#13", "type": "PROMO%"},
    ),
    "q17": Query(
        """SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM {lineitem}, {part}
        WHERE p_partkey = l_partkey AND p_brand = :brand AND p_size <= :size
          AND l_quantity < (SELECT 0.2 * avg(l_quantity) FROM {lineitem} WHERE l_partkey = p_partkey)""",
        {"brand": "Brand#13", "size": 25},
    ),
    "q18": Query(
        """SELECT c_name, c_custkey, o_orderkey, o_orderdate, round(o_totalprice, 2) AS o_totalprice, round(sum(l_quantity), 2) AS sum_qty
        FROM {customer}, {orders}, {lineitem}
        WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > :quantity) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
        GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
        {"quantity": 200},
    ),
    "q19": Query(
        f"""SELECT round(sum({REVENUE}), 2) AS revenue FROM {{lineitem}}, {{part}}
        WHERE (p_partkey = l_partkey AND p_brand = :one AND l_quantity >= 1 AND l_quantity <= 11 AND p_size BETWEEN 1 AND 5)
          OR (p_partkey = l_partkey AND p_brand = :two AND l_quantity >= 10 AND l_quantity <= 20 AND p_size BETWEEN 1 AND 10)
          OR (p_partkey = l_partkey AND p_brand = :three AND l_quantity >= 20 AND l_quantity <= 30 AND p_size BETWEEN 1 AND 15)""",
        {"one": "Brand#12", "two": "Brand#23", "three": "Brand#5"},
    ),
    "q20": Query(
        f"""WITH ps AS {PARTSUPP}
        SELECT s_suppkey, s_name FROM {{supplier}}, {{nation}}
        WHERE s_suppkey IN (SELECT ps_suppkey FROM ps WHERE ps_partkey IN (SELECT p_partkey FROM {{part}} WHERE p_name LIKE :name)
            AND ps_qty > (SELECT 0.5 * sum(l_quantity) FROM {{lineitem}} WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey
              AND l_shipdate >= cast(:date AS date) AND l_shipdate < cast(:date AS date) + interval '1' year))
          AND s_nationkey = n_nationkey AND n_name IN (:one, :two, :three)""",
        {"name": "blue%", "date": "1997-01-01", "one": "NATION_3", "two": "NATION_7", "three": "NATION_15"},
    ),
    "q21": Query(
        """SELECT s_name, count(*) AS numwait FROM {supplier}, {lineitem} l1, {orders}, {nation}
        WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R'
          AND EXISTS (SELECT * FROM {lineitem} l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
          AND NOT EXISTS (SELECT * FROM {lineitem} l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
          AND s_nationkey = n_nationkey AND n_regionkey = :region
        GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
        {"region": 2},
    ),
    "q22": Query(
        """SELECT cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM (
          SELECT substring(c_mktsegment FROM 1 FOR 2) AS cntrycode, c_acctbal FROM {customer}
          WHERE substring(c_mktsegment FROM 1 FOR 2) IN ('AU', 'BU', 'FU', 'HO', 'MA')
            AND c_acctbal > (SELECT avg(c_acctbal) FROM {customer} WHERE c_acctbal > 0.00)
            AND NOT EXISTS (SELECT * FROM {orders} WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')) AS custsale
        GROUP BY cntrycode"""
    ),
}

#: Variants that state a query in another form: decode() for CASE, a common table expression or a derived table for a view.
VARIANTS: dict[str, tuple[str, str]] = {
    "q08a": ("q08", QUERIES["q08"].text.replace("CASE WHEN nation = :nation THEN volume ELSE 0 END", "decode(nation, :nation, volume, 0)")),
    "q12a": (
        "q12",
        """SELECT l_returnflag AS l_shipmode,
          cast(sum(decode(o_orderpriority, '1-URGENT', 1, '2-HIGH', 1, 0)) AS bigint) AS high_line_count,
          cast(sum(decode(o_orderpriority, '1-URGENT', 0, '2-HIGH', 0, 1)) AS bigint) AS low_line_count"""
        + QUERIES["q12"].text[QUERIES["q12"].text.index("\n        FROM") :],
    ),
    "q13a": (
        "q13",
        """WITH c_orders (c_custkey, c_count) AS (
          SELECT c_custkey, count(o_orderkey) FROM {customer} LEFT OUTER JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority NOT LIKE :word GROUP BY c_custkey)
        SELECT c_count, count(*) AS custdist FROM c_orders GROUP BY c_count""",
    ),
    "q14a": ("q14", QUERIES["q14"].text.replace(f"CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END", f"decode(substring(p_type FROM 1 FOR 5), 'PROMO', {REVENUE}, 0)")),
    "q15a": (
        "q15",
        f"""WITH revenue (supplier_no, total_revenue) AS (SELECT l_suppkey, round(sum({REVENUE}), 2) FROM {{lineitem}}
          WHERE l_shipdate >= cast(:date AS date) AND l_shipdate < cast(:date AS date) + interval '3' month GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total_revenue FROM {{supplier}}, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue)""",
    ),
}

#: The skewed benchmark asks the same with other bounds.
REBOUND: dict[str, tuple[str, dict[str, object]]] = {
    "jcch_q07": ("q07", {"first": "1996-01-01", "last": "1997-12-31"}),
    "jcch_q08": ("q08", {"first": "1996-01-01", "last": "1999-12-31"}),
    "jcch_q10": ("q10", {"date": "1998-04-01"}),
    "jcch_q18": ("q18", {"quantity": 250}),
}


#: What the tables hold, as the draws below need it. Fixed values.
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
PRIORITIES = ("URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW")
FLAGS = ("A", "N", "R")
FIRST_WORDS = ("blue", "cold", "hot", "large", "new", "old", "red", "small")
LAST_WORDS = ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")


def _month(r: Random, first: int = 1995, last: int = 2000) -> str:
    return f"{r.randint(first, last)}-{r.randint(1, 12):02d}-01"


def _year(r: Random, first: int = 1995, last: int = 2000) -> str:
    return f"{r.randint(first, last)}-01-01"


def _nations(r: Random, n: int) -> list[str]:
    return [f"NATION_{i}" for i in r.sample(range(25), n)]


def _brands(r: Random, n: int) -> list[str]:
    return [f"Brand#{i}" for i in r.sample(range(1, 26), n)]


def _discount(r: Random) -> dict[str, object]:
    """Bounds between the hundredths, so that no discount lies on one."""
    about = r.randint(2, 9)
    return {"date": _year(r), "low": (10 * about - 15) / 1000, "high": (10 * about + 15) / 1000, "quantity": r.choice((24, 25))}


def _share(r: Random) -> dict[str, object]:
    """A nation and the region that it lies in."""
    nation = r.randrange(25)
    return {"nation": f"NATION_{nation}", "region": REGIONS[nation % 5], "type": r.choice(TYPES)}


def _sizes(r: Random) -> dict[str, object]:
    low = r.randint(1, 40)
    return {"low": low, "high": low + 10, "type": f"%{r.choice('AEO')}%", "region": r.choice(REGIONS)}


#: How the parameters of each query are drawn; those that aren't named keep their values.
DRAWS: dict[str, Callable[[Random], dict[str, object]]] = {
    "q01": lambda r: {"days": str(r.randint(60, 120))},
    "q02": _sizes,
    "q03": lambda r: {"segment": r.choice(SEGMENTS), "date": f"1998-03-{r.randint(1, 31):02d}"},
    "q04": lambda r: {"date": _month(r)},
    "q05": lambda r: {"region": r.choice(REGIONS), "date": _year(r)},
    "q06": _discount,
    "q07": lambda r: dict(zip(("one", "two"), _nations(r, 2), strict=True)),
    "q08": _share,
    "q09": lambda r: {"name": f"%{r.choice(LAST_WORDS)}%"},
    "q10": lambda r: {"date": _month(r)},
    "q11": lambda r: {"nation": _nations(r, 1)[0]},
    "q12": lambda r: {**dict(zip(("one", "two"), r.sample(FLAGS, 2), strict=True)), "date": _year(r)},
    "q13": lambda r: {"word": f"%{r.choice(PRIORITIES)}%"},
    "q14": lambda r: {"date": _month(r)},
    "q15": lambda r: {"date": _month(r)},
    "q16": lambda r: {"brand": _brands(r, 1)[0], "type": f"{r.choice(TYPES)}%"},
    "q17": lambda r: {"brand": _brands(r, 1)[0], "size": r.randint(1, 50)},
    "q18": lambda r: {"quantity": r.randint(180, 220)},
    "q19": lambda r: dict(zip(("one", "two", "three"), _brands(r, 3), strict=True)),
    "q20": lambda r: {"name": f"{r.choice(FIRST_WORDS)}%", "date": _year(r), **dict(zip(("one", "two", "three"), _nations(r, 3), strict=True))},
    "q21": lambda r: {"region": r.randrange(5)},
}


def drawn(name: str, seed: int) -> dict[str, object]:
    """Parameters of a query drawn at random: the same ones for the same seed, on any machine."""
    return DRAWS[name](Random(f"{name}:{seed}"))


def literal(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def render(name: str, /, **params: object) -> str:
    """A query's text with its parameters bound; the tables are left as {table}."""
    if name in REBOUND:
        name, own = REBOUND[name]
        params = {**own, **params}
    if name in VARIANTS:
        base, text = VARIANTS[name]
    else:
        base, text = name, QUERIES[name].text
    known = QUERIES[base].params
    if unknown := params.keys() - known.keys():
        raise ValueError(f"{name} has no parameter {sorted(unknown)}")
    bound = {**known, **params}
    return re.sub(r":([a-z]+)\b", lambda m: literal(bound[m[1]]), text)


def run(spark: SparkSession, sf_dir: str, name: str, /, **params: object) -> DataFrame:
    text = render(name, **params)
    used = {t: load(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def standard_sql(name: str, /, **params: object) -> str:
    """The text for an engine that has the tables under their own names; a variant is given in its plain form."""
    if name in VARIANTS:
        name = VARIANTS[name][0]
    return re.sub(r"\{(\w+)\}", r"\1", render(name, **params))
