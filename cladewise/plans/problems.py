"""Queries of the general operators on links and forests: hot keys, hierarchies, dangling references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.functions.names import spelled, spelled_sql
from cladewise.operators import hierarchy as H
from cladewise.operators.hot_keys import dominant_keys, key_profiles
from cladewise.operators.references import dangling, dangling_report
from cladewise.store import Cuts


def read(spark: SparkSession, where: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{where}/{table}.parquet")


def _profiles(spark: SparkSession, where: str) -> tuple[DataFrame, DataFrame]:
    links = read(spark, where, "acol_lotus")
    papers = read(spark, where, "paper_counts").select(F.col("tree").alias("key_field"), spelled("leaf").alias("key_name"), F.col("number_of_papers").alias("amount"))
    return key_profiles(links, spelled("species"), spelled("molecules"), F.col("reported_at"), papers, "species", "molecules"), links


def p2_keys(spark: SparkSession, where: str) -> DataFrame:
    """Per name of a species or molecule: rows, distinct partners, first and last report, and the join with paper counts."""
    found, _ = _profiles(spark, where)
    return found.withColumnsRenamed({"first_at": "first_report", "last_at": "last_report", "amount_joined": "papers_joined"})


def p2_found(spark: SparkSession, where: str) -> DataFrame:
    """Keys with at least 2 % of all rows, read from the whole profiles of all keys: the join of both inputs is made."""
    found, links = _profiles(spark, where)
    return dominant_keys(Cuts(spark, "profiles").save("profiles", found), links, 0.02).select("key_field", "key_name")


def _ways(spark: SparkSession, where: str, table: str = "molecules") -> DataFrame:
    rows = read(spark, where, table)
    links = H.current_links(rows, spelled("child"), spelled("parent"), F.col("length"), F.col("loaded_at"), F.col("edge_id"))
    return H.solve(spark, links)


def p4_found(spark: SparkSession, where: str) -> DataFrame:
    return _ways(spark, where).where("cycle_key is not null").select("node", "cycle_key")


def p4_hierarchy(spark: SparkSession, where: str) -> DataFrame:
    """Each molecule's path, depth, root, length from the root and number of descendants; or the key of its circle."""
    return H.hierarchy(_ways(spark, where)).withColumn("length", F.round("length", 6))


def p4_descendants(spark: SparkSession, where: str) -> DataFrame:
    """All pairs of a molecule and one below it."""
    return H.ancestors(_ways(spark, where))


def p4_species_hierarchy(spark: SparkSession, where: str) -> DataFrame:
    """As p4_hierarchy, of the species forest."""
    return H.hierarchy(_ways(spark, where, "species")).withColumn("length", F.round("length", 6))


def _dangling(spark: SparkSession, where: str) -> DataFrame:
    links = read(spark, where, "acol_lotus")
    fields = ("species", "molecules")
    refs = links.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), spelled(f).alias("key"), F.col("link_id").alias("id"), F.col("loaded_at").alias("at")) for f in fields))).alias("x")).select("x.*")
    rows = [read(spark, where, f).select(F.lit(f).alias("field"), spelled("child").alias("key"), F.col("loaded_at").alias("since"), F.col("removed_at").alias("until")) for f in fields]
    return dangling(refs, rows[0].unionByName(rows[1]))


def p5_found(spark: SparkSession, where: str) -> DataFrame:
    return _dangling(spark, where).select(F.col("field").alias("ref_field"), F.col("id").alias("link_id"))


def p5_links(spark: SparkSession, where: str) -> DataFrame:
    """The dangling references with their name and the reason."""
    return _dangling(spark, where).select(F.col("field").alias("ref_field"), F.col("id").alias("link_id"), F.col("key").alias("ref_name"), "reason")


def p5_report(spark: SparkSession, where: str) -> DataFrame:
    """Dangling references per referenced table, month and reason."""
    return dangling_report(_dangling(spark, where)).select(F.col("field").alias("ref_field"), "month", "reason", "n")


_S, _M, _C, _P, _L = (spelled_sql(c) for c in ("species", "molecules", "child", "parent", "leaf"))
_KEYS = f"""
WITH f AS (SELECT {_S} AS s, {_M} AS m, reported_at FROM acol_lotus),
u AS (SELECT 'species' AS key_field, s AS key_name, m AS partner, reported_at FROM f
      UNION ALL SELECT 'molecules', m, s, reported_at FROM f),
k AS (SELECT key_field, key_name, count(*) AS n_rows, count(DISTINCT partner) AS n_partners,
             min(reported_at) AS first_report, max(reported_at) AS last_report
      FROM u WHERE key_name IS NOT NULL GROUP BY 1, 2),
o AS (SELECT tree AS key_field, {_L} AS key_name, count(*) AS n, coalesce(sum(number_of_papers), 0) AS papers
      FROM paper_counts GROUP BY 1, 2)
SELECT k.*, k.n_rows * coalesce(o.n, 0) AS n_joined, CAST(k.n_rows * coalesce(o.papers, 0) AS BIGINT) AS papers_joined
FROM k LEFT JOIN o USING (key_field, key_name)
"""


def _ways_sql(table: str) -> str:
    return f"""
r AS (SELECT {_C} AS node, {_P} AS parent, loaded_at, edge_id,
             CASE WHEN length >= 0 AND isfinite(length) THEN length ELSE 0 END AS length FROM {table}),
c AS (SELECT node, parent, length FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY loaded_at DESC NULLS LAST, edge_id DESC) AS k
      FROM r WHERE node IS NOT NULL) WHERE k = 1),
tops AS (SELECT node FROM c WHERE parent IS NULL UNION SELECT parent FROM c WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM c)),
w AS (SELECT node, node AS path, 0 AS depth, node AS root, CAST(0 AS DOUBLE) AS length, [node] AS line FROM tops
      UNION ALL SELECT c.node, w.path || '/' || c.node, w.depth + 1, w.root, w.length + c.length, list_append(w.line, c.node) FROM w JOIN c ON c.parent = w.node),
stuck AS (SELECT node, parent FROM c WHERE node NOT IN (SELECT node FROM w)),
reach AS (SELECT node, parent AS y FROM stuck UNION SELECT reach.node, stuck.parent FROM reach JOIN stuck ON stuck.node = reach.y),
keys AS (SELECT node, min(y) AS cycle_key FROM reach WHERE y IN (SELECT node FROM reach WHERE node = y) GROUP BY node),
below AS (SELECT line[i] AS node, count(*) AS n FROM w, unnest(generate_series(1, len(line) - 1)) AS g(i) GROUP BY 1)"""


def _hierarchy_sql(table: str) -> str:
    return f"""
WITH RECURSIVE {_ways_sql(table)}
SELECT w.node, w.path, CAST(w.depth AS BIGINT) AS depth, w.root, round(w.length, 6) AS length, coalesce(below.n, 0) AS n_descendants,
       CAST(NULL AS VARCHAR) AS cycle_key FROM w LEFT JOIN below ON below.node = w.node
UNION ALL SELECT node, NULL, NULL, NULL, NULL, NULL, cycle_key FROM keys
"""


_DANGLING = f"""
WITH refs AS (SELECT 'species' AS ref_field, link_id, {_S} AS ref_name, loaded_at FROM acol_lotus
              UNION ALL SELECT 'molecules', link_id, {_M}, loaded_at FROM acol_lotus),
parents AS (SELECT 'species' AS ref_field, {_C} AS ref_name, loaded_at AS since, removed_at AS until FROM species
            UNION ALL SELECT 'molecules', {_C}, loaded_at, removed_at FROM molecules),
j AS (SELECT r.ref_field, r.link_id, r.ref_name, r.loaded_at, count(p.ref_name) AS n, count(CASE WHEN p.since <= r.loaded_at THEN 1 END) AS started,
             count(CASE WHEN p.since <= r.loaded_at AND (p.until IS NULL OR r.loaded_at < p.until) THEN 1 END) AS valid
      FROM refs r LEFT JOIN parents p USING (ref_field, ref_name) WHERE r.ref_name IS NOT NULL GROUP BY ALL)
SELECT ref_field, link_id, ref_name, CASE WHEN n = 0 THEN 'missing' WHEN started = 0 THEN 'late' ELSE 'deleted' END AS reason, loaded_at
FROM j WHERE valid = 0
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_keys": p2_keys,
    "p4_found": p4_found,
    "p4_hierarchy": p4_hierarchy,
    "p4_descendants": p4_descendants,
    "p4_species_hierarchy": p4_species_hierarchy,
    "p5_found": p5_found,
    "p5_links": p5_links,
    "p5_report": p5_report,
}

SQL: dict[str, str] = {
    "p2_found": f"SELECT key_field, key_name FROM ({_KEYS}) WHERE n_rows >= 0.02 * (SELECT count(*) FROM acol_lotus)",
    "p2_keys": _KEYS,
    "p4_found": f"WITH RECURSIVE {_ways_sql('molecules')} SELECT node, cycle_key FROM keys",
    "p4_hierarchy": _hierarchy_sql("molecules"),
    "p4_descendants": f"""WITH RECURSIVE {_ways_sql('molecules')}
SELECT line[i] AS ancestor, node AS descendant, CAST(len(line) - i AS BIGINT) AS distance FROM w, unnest(generate_series(1, len(line) - 1)) AS g(i)""",
    "p4_species_hierarchy": _hierarchy_sql("species"),
    "p5_found": f"SELECT ref_field, link_id FROM ({_DANGLING})",
    "p5_links": f"SELECT ref_field, link_id, ref_name, reason FROM ({_DANGLING})",
    "p5_report": f"SELECT ref_field, strftime(loaded_at, '%Y-%m') AS month, reason, count(*) AS n FROM ({_DANGLING}) GROUP BY ALL",
}
