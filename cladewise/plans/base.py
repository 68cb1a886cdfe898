"""The model's tables, made from the star schema: the same statements serve Spark and SQL.

Species are customers below nations below regions; molecules are parts below (type, brand) below type below one root. A customer and
a part are linked by their order lines: Y holds those with a line that wasn't returned, L those with one that isn't new. Customer and part
keys run from 0 without gaps, so they are the leaf indices. Runs are orders, their features line numbers, their candidates the order's
parts. All tables are used whole; what is unknown in them (filters, assignments) is so by size or likelihood.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cladewise.operators.sparse import Shape

N_BINS = 20
GAMMA, EPSILON = 5.0, 0.001

BASE = {
    "sp": """SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent, CAST(n_nationkey % 7 + 1 AS DOUBLE) AS length, CAST(n_nationkey AS BIGINT) AS ord FROM nation
             UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, abs(c_acctbal) + CAST(1 AS DOUBLE), CAST(100 + c_custkey AS BIGINT) FROM customer""",
    "mo": """SELECT 't:' || p_type AS child, 'm' AS parent, CAST(length(p_type) AS DOUBLE) AS length, CAST(min(p_partkey) AS BIGINT) AS ord FROM part GROUP BY p_type
             UNION ALL SELECT 'b:' || p_type || '/' || p_brand, 't:' || p_type, CAST(1.5 AS DOUBLE), CAST(100000000 + min(p_partkey) AS BIGINT) FROM part GROUP BY p_type, p_brand
             UNION ALL SELECT 'p' || p_partkey, 'b:' || p_type || '/' || p_brand, CAST(p_size AS DOUBLE), CAST(1000000000 + p_partkey AS BIGINT) FROM part""",
    "cells": """SELECT o_custkey AS r, l_partkey AS c, max(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS y, max(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) AS l,
                       CAST(count(*) AS INT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey""",
    "papers_r": "SELECT 'c' || o_custkey AS leaf, count(*) AS n, CAST(0 AS BIGINT) AS ord FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey",
    "papers_c": "SELECT 'p' || l_partkey AS leaf, count(*) AS n, CAST(0 AS BIGINT) AS ord FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey",
    "runs": "SELECT o_orderkey AS run, o_custkey AS species, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS filter FROM orders WHERE o_orderpriority IS NOT NULL",
    "features": "SELECT DISTINCT l_orderkey AS run, CAST(l_linenumber AS BIGINT) AS feature FROM lineitem",
    "parts_of": "SELECT l_orderkey AS run, l_partkey AS molecule, CAST(max(5 * l_quantity) AS INT) AS bin FROM lineitem GROUP BY l_orderkey, l_partkey",
    "filters": "SELECT CAST(f.filter AS BIGINT) AS filter, p_partkey AS molecule, CAST((p_size * 5 + f.filter * 11) % 255 + 1 AS INT) AS index FROM part CROSS JOIN (SELECT 1 AS filter UNION ALL SELECT 2 UNION ALL SELECT 3) f WHERE p_size > 16",
}
_NEEDS = {"sp": ("nation", "customer"), "mo": ("part",), "cells": ("lineitem", "orders"), "papers_r": ("orders",), "papers_c": ("lineitem",), "runs": ("orders",), "features": ("lineitem",), "parts_of": ("lineitem",), "filters": ("part",)}
#: Each feature takes the candidate whose rank by molecule is its own rank, if there is one: so no molecule is taken twice.
BASE["assigned"] = """SELECT f.run, f.feature, p.molecule, COALESCE(p.bin, 60) AS bin
    FROM (SELECT run, feature, row_number() OVER (PARTITION BY run ORDER BY feature) AS k FROM features) f
    LEFT JOIN (SELECT run, molecule, bin, row_number() OVER (PARTITION BY run ORDER BY molecule) AS k FROM parts_of WHERE bin > 60) p ON p.run = f.run AND p.k = f.k"""
_NEEDS["assigned"] = ("lineitem",)
_BUILT_ON = {"assigned": ("features", "parts_of")}


def base(spark: SparkSession, where: str, name: str) -> DataFrame:
    """One of the tables above."""
    views = {t: spark.read.parquet(f"{where}/{t}.parquet") for t in _NEEDS[name]}
    views |= {b: base(spark, where, b) for b in _BUILT_ON.get(name, ())}
    text = BASE[name]
    for t in sorted(views, key=len, reverse=True):
        for before in (" FROM ", " JOIN "):
            text = text.replace(f"{before}{t} ", f"{before}{{{t}}} ").replace(f"{before}{t})", f"{before}{{{t}}})")
            if text.endswith(f"{before}{t}"):
                text = text[: -len(t)] + f"{{{t}}}"
            text = text.replace(f"{before}{t}\n", f"{before}{{{t}}}\n")
    return spark.sql(text, **{t: v for t, v in views.items() if f"{{{t}}}" in text})


def shape_of(spark: SparkSession, where: str) -> Shape:
    return Shape(*(spark.read.parquet(f"{where}/{t}.parquet").count() for t in ("customer", "part")))


def with_base(sql: str, *names: str, recursive: bool = False) -> str:
    """SQL with the named base tables in front."""
    all_names = [n for name in names for n in (*_BUILT_ON.get(name, ()), name)]
    ctes = ", ".join(f"{n} AS MATERIALIZED ({BASE[n]})" for n in dict.fromkeys(all_names))
    inner = sql.lstrip()
    if inner.startswith("WITH "):
        inner = f", {inner[5:]}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {inner}"


#: SQL of the node table of a tree: nodes_sql("sp") gives sp_nodes.
def nodes_sql(t: str) -> str:
    return f"""{t}_o AS (SELECT id, min(o) AS o FROM (SELECT parent AS id, 2 * ord AS o FROM {t} UNION ALL SELECT child, 2 * ord + 1 FROM {t}) GROUP BY id),
{t}_k AS (SELECT parent AS id, count(*) AS k FROM {t} GROUP BY parent),
{t}_n AS (SELECT o.id, e.parent, coalesce(e.length, 0) AS length, coalesce(k.k, 0) AS n_children, e.parent IS NULL AS is_root,
    CASE WHEN coalesce(k.k, 0) = 0 THEN 'leaf' WHEN e.parent IS NULL THEN 'root' ELSE 'internal' END AS kind, row_number() OVER (ORDER BY o.o) - 1 AS node_ix
    FROM {t}_o o LEFT JOIN {t} e ON e.child = o.id LEFT JOIN {t}_k k ON k.id = o.id),
{t}_nodes AS MATERIALIZED (SELECT *, CASE WHEN kind = 'leaf' THEN row_number() OVER (PARTITION BY kind = 'leaf' ORDER BY node_ix) - 1 END AS leaf_ix,
    CASE WHEN kind <> 'leaf' THEN row_number() OVER (PARTITION BY kind = 'leaf' ORDER BY node_ix) - 1 END AS internal_ix,
    CASE WHEN kind = 'root' THEN row_number() OVER (PARTITION BY kind = 'root' ORDER BY node_ix) - 1 END AS root_ix,
    CASE WHEN NOT is_root THEN row_number() OVER (PARTITION BY is_root ORDER BY node_ix) - 1 END AS branch_ix FROM {t}_n)"""
