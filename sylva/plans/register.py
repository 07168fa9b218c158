"""The tables of queries, filled by the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (session, folder), with its SQL where there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


# Shared parts of the SQL. Vertices of the customer-supplier graph as in sources.tables.
CS = """e AS (SELECT 2 * o_custkey AS src, 2 * l_suppkey + 1 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
e1 AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, CAST(count(*) AS DOUBLE) AS w FROM e GROUP BY 1, 2)"""
COP = """e1 AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, CAST(count(*) AS DOUBLE) AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2)"""
NATIONS = """lab AS (SELECT 2 * c_custkey AS id, CAST(c_nationkey AS BIGINT) AS c FROM customer UNION ALL SELECT 2 * s_suppkey + 1, CAST(s_nationkey AS BIGINT) FROM supplier)"""
EV = """e AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
e1 AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, CAST(count(*) AS DOUBLE) AS w FROM e WHERE dst IS NOT NULL GROUP BY 1, 2)"""
DEG = """inc AS (SELECT src AS id, dst AS nbr, w FROM e1 UNION ALL SELECT dst, src, w FROM e1),
deg AS (SELECT id, sum(w) AS d FROM inc GROUP BY id), tot AS (SELECT sum(d) AS m2 FROM deg)"""
COMM = """cut AS (SELECT a.c, sum(w) AS g FROM inc JOIN lab a ON a.id = inc.id JOIN lab b ON b.id = inc.nbr WHERE a.c <> b.c GROUP BY a.c),
comm AS (SELECT lab.c, coalesce(sum(d), 0.0) AS v, count(*) AS n, coalesce(any_value(g), 0.0) AS g
         FROM lab LEFT JOIN deg USING (id) LEFT JOIN cut ON cut.c = lab.c GROUP BY lab.c)"""
CS_ALL = f"WITH {CS}, {NATIONS}, {DEG}, {COMM}"
H1 = "(SELECT -sum(CASE WHEN d > 0 THEN d / m2 * log2(d / m2) ELSE 0 END) FROM deg, tot)"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def term_sql(v: str, g: str) -> str:
    return f"((CASE WHEN {v} > 0 THEN {v} * log2({v}) ELSE 0 END - CASE WHEN {g} > 0 AND {v} > 0 THEN {g} * log2({v} / m2) ELSE 0 END) / m2)"
