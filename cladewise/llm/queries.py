"""The registered queries of this package, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.functions.names import spelled, spelled_sql
from cladewise.llm.cooccurrence import items_together
from cladewise.llm.encode import encode_corpus
from cladewise.llm.mixing import mix_sources
from cladewise.llm.spam import chunk_pairs, corpus_chunks, pair_information, stuffed_pages
from cladewise.llm.topn import top_items
from cladewise.store import Cuts


def _read(spark: SparkSession, where: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{where}/{table}.parquet")


def p1_pairs(spark: SparkSession, where: str) -> DataFrame:
    """Pairs of molecules in at least 20 species and three times as often as by chance, with their counts."""
    pairs = items_together(_read(spark, where, "acol_lotus"), spelled("species"), spelled("molecules"))
    return pairs.select(F.col("item_a").alias("molecule_a"), F.col("item_b").alias("molecule_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p1_found(spark: SparkSession, where: str) -> DataFrame:
    return p1_pairs(spark, where).select("molecule_a", "molecule_b")


def p3_top5(spark: SparkSession, where: str) -> DataFrame:
    return top_items(_read(spark, where, "edges"), "feature", "molecule", "score", 5).withColumn("rank", F.col("rank").cast("long"))


def p3_found(spark: SparkSession, where: str) -> DataFrame:
    return p3_top5(spark, where).select("feature", "molecule")


def p6_ids(spark: SparkSession, where: str) -> DataFrame:
    """Token ids of every document under byte_bpe_50k."""
    return encode_corpus(_read(spark, where, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, where: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(_read(spark, where, "documents"), "doc_id", "text", spelled("source"), _read(spark, where, "mix_targets"), spelled("source"))


def p7_mix(spark: SparkSession, where: str) -> DataFrame:
    """Documents of the mix with their tokens and copies."""
    return _mix(spark, where)[0]


def p7_report(spark: SparkSession, where: str) -> DataFrame:
    """Targets and the shares reached."""
    return _mix(spark, where)[1]


def p7_targets(spark: SparkSession, where: str) -> DataFrame:
    """What the mix aims at, as far as SQL can count it: a source's documents, and its share among the sources that have text."""
    return p7_report(spark, where).select("source", "target_share", "max_repeat", "source_documents", F.round("goal_share", 9).alias("goal_share"))


def p8_pages(spark: SparkSession, where: str) -> DataFrame:
    """Stuffed pages with the share of their characters that is stuffed, and their mean PMI."""
    return stuffed_pages(_read(spark, where, "documents"), "doc_id", "text", _read(spark, where, "doc_labels"))


def p8_information(spark: SparkSession, where: str) -> DataFrame:
    """The corpus' pairs of neighbouring words as problem 8 counts them: how many have which counts and which information."""
    cuts = Cuts(spark, "information")
    info = pair_information(cuts, chunk_pairs(corpus_chunks(cuts, _read(spark, where, "documents"), "doc_id", "text")))
    return info.groupBy("n", "n_a", "n_b").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.max(F.col("pmi").cast("double")), 3).alias("pmi"))


def p8_found(spark: SparkSession, where: str) -> DataFrame:
    return p8_pages(spark, where).select("doc_id")


_PAIRS = f"""
WITH b AS (SELECT DISTINCT s, m FROM (SELECT {spelled_sql('species')} AS s, {spelled_sql('molecules')} AS m FROM acol_lotus)
           WHERE s IS NOT NULL AND m IS NOT NULL),
n AS (SELECT m, count(*) AS n FROM b GROUP BY m),
k AS (SELECT b.s, b.m, n.n FROM b JOIN n ON b.m = n.m WHERE n.n >= 20),
total AS (SELECT count(DISTINCT s) AS t FROM b),
p AS (SELECT x.m AS molecule_a, y.m AS molecule_b, count(*) AS n_ab, min(x.n) AS n_a, min(y.n) AS n_b
      FROM k x JOIN k y ON x.s = y.s AND x.m < y.m GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT molecule_a, molecule_b, n_ab, n_a, n_b, round(n_ab / (CAST(n_a AS DOUBLE) * n_b / t), 6) AS lift
FROM p, total WHERE CAST(n_ab AS HUGEINT) * t >= 3 * CAST(n_a AS HUGEINT) * n_b
"""
_TARGETS = f"""
WITH w AS (SELECT source, max((target_share, greatest(coalesce(max_repeat, 0), 0))) AS x FROM (SELECT {spelled_sql('source')} AS source, target_share, max_repeat FROM mix_targets)
           WHERE source IS NOT NULL AND target_share > 0 AND isfinite(target_share) GROUP BY source),
d AS (SELECT {spelled_sql('source')} AS source, count(DISTINCT doc_id) AS n, count(CASE WHEN text <> '' THEN 1 END) AS filled FROM documents GROUP BY 1),
j AS (SELECT w.source, x[1] AS target_share, CAST(x[2] AS INT) AS max_repeat, coalesce(n, 0) AS source_documents, coalesce(filled, 0) > 0 AND x[2] > 0 AS usable FROM w LEFT JOIN d ON d.source = w.source)
SELECT source, target_share, max_repeat, source_documents, round(CASE WHEN usable THEN target_share / (SELECT sum(target_share) FROM j WHERE usable) ELSE 0 END, 9) AS goal_share FROM j
"""
# SQL's white space has ASCII only, so the pattern names all of it
_MARK = r"[^\p{L}\p{N}\p{M}\p{Z}\t\n\v\f\r\x1c-\x1f\x85]"
_WORDS = r"[\p{Han}\p{Hiragana}\p{Katakana}ー]|[\p{L}\p{M}]+(?:[''’][\p{L}]+)*|\p{N}+|" + _MARK
_INFORMATION = f"""
WITH w AS (SELECT row_number() OVER () AS d, regexp_extract_all(lower(text), '{_WORDS}') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
t AS (SELECT d, i, CASE WHEN regexp_matches(w[i], '^\\p{{N}}') THEN '0' ELSE w[i] END AS w FROM w, unnest(generate_series(1, len(w))) AS g(i)),
p AS (SELECT w AS a, lead(w) OVER (PARTITION BY d ORDER BY i) AS b FROM t),
c AS (SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY 1, 2),
m AS (SELECT *, CAST(sum(n) OVER (PARTITION BY a) AS BIGINT) AS n_a, CAST(sum(n) OVER (PARTITION BY b) AS BIGINT) AS n_b, sum(n) OVER () AS t FROM c)
SELECT n, n_a, n_b, count(*) AS pairs, round(max(CAST(ln(CAST(n AS DOUBLE) * t / (CAST(n_a AS DOUBLE) * n_b)) * n / (n + 1) AS FLOAT))::DOUBLE, 3) AS pmi FROM m WHERE n >= 2 GROUP BY 1, 2, 3
"""
_TOP = """
WITH r AS (SELECT feature, molecule, max(score) AS score FROM edges
           WHERE feature IS NOT NULL AND molecule IS NOT NULL AND score > 0 AND isfinite(score) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY score DESC, molecule) AS "rank" FROM r)
SELECT feature, molecule, score, "rank" FROM k WHERE "rank" <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_pairs": p1_pairs,
        "p3_found": p3_found,
        "p3_top5": p3_top5,
        "p6_ids": p6_ids,
        "p7_mix": p7_mix,
        "p7_report": p7_report,
        "p7_targets": p7_targets,
        "p8_found": p8_found,
        "p8_pages": p8_pages,
        "p8_information": p8_information,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"SELECT molecule_a, molecule_b FROM ({_PAIRS})",
        "p1_pairs": _PAIRS,
        "p3_found": f"SELECT feature, molecule FROM ({_TOP})",
        "p3_top5": _TOP,
        "p7_targets": _TARGETS,
        "p8_information": _INFORMATION,
    }
