"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladewise.llm.encode import token_counts, vocabulary_path
from cladewise.store import Cuts

#: More sources than this are refused: targets and parameters of all sources are held by the driver.
MOST_SOURCES = 10_000
#: Bands of an octave of document sizes, and slots of a band, that rounding runs through.
BANDS, SLOTS = 8, 64
#: Rounds in which one document of each source settles what rounding left over.
REPAIRS = 4
TOLERANCE, ITERATIONS = 1e-9, 60


def read_targets(targets: DataFrame, source: Column) -> dict[str, tuple[float, int]]:
    """Share and largest number of copies by source. Rows without a source, or with a share that isn't above 0, don't count.

    Of several rows of a source the largest share, then the largest repeat holds; a null or negative repeat is 0.
    """
    share = F.col("target_share").cast("double")
    rows = targets.select(source.alias("source"), share.alias("share"), F.greatest(F.coalesce("max_repeat", F.lit(0)), F.lit(0)).alias("most"))
    rows = rows.where("source is not null and share > 0 and not isnan(share) and share < double('infinity')").groupBy("source").agg(F.max(F.struct("share", "most")).alias("x"))
    found = rows.select("source", "x.*").limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return {r.source: (r.share, int(r.most)) for r in found}


def goals(sizes: dict[str, float], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens that each source shall give.

    Shares are taken among the sources that have tokens and may be used. Without ``total`` the mix is the largest in which
    all these shares are met exactly; with it a source that can't give its part gives all it may.
    """
    usable = {s: (share, most * sizes[s]) for s, (share, most) in targets.items() if sizes.get(s, 0) > 0 and most > 0}
    whole = sum(share for share, _ in usable.values())
    if total is None:
        total = min((cap * whole / share for share, cap in usable.values()), default=0.0)
    return {s: float(min(cap, total * share / whole)) for s, (share, cap) in usable.items()}


def balance(spark: SparkSession, sizes: DataFrame, goal: dict[str, float], cap: dict[str, int]) -> dict[str, tuple[float, float]]:
    """Parameters (lambda, mean size) by source: a document of n tokens is taken at rate min(cap, exp(lambda * n / mean)).

    Of all rates up to the caps whose tokens sum to each source's goal these have the least divergence from taking each
    document once; lambda is the multiplier of the source's token constraint. So a source that must shrink gives up long
    documents first, one that must grow repeats them first: the tokens move with the fewest changes to documents.

    The dual of all sources together is concave and separates by lambda. Each step sums tokens and their slope of all open
    sources over ``sizes`` (source, n_tokens, n), the exact numbers of documents by size, and takes Newton's step on the
    logarithm of the tokens; where it leaves what is known to hold the solution, it halves that instead. The driver gets a row
    per source and step. Sources that must be repeated to the limit need no step: lambda is infinite. Sources that are still
    open after ``ITERATIONS`` steps are an error.
    """
    mass = F.col("n") * F.col("n_tokens")
    base = {r.source: r for r in sizes.where("n_tokens > 0").groupBy("source").agg(F.sum(mass).alias("t"), F.sum("n").alias("n")).collect()}
    wanted = [s for s in sorted(goal) if goal[s] > 0]
    full = {s for s in wanted if goal[s] >= cap[s] * base[s].t * (1 - TOLERANCE)}
    lam = {s: math.inf if s in full else 0.0 for s in wanted}
    low, high = dict.fromkeys(wanted, -math.inf), dict.fromkeys(wanted, math.inf)
    open_ = [s for s in wanted if s not in full]
    for _ in range(ITERATIONS):
        if not open_:
            break
        params = spark.createDataFrame([(s, lam[s], base[s].t / base[s].n, float(cap[s])) for s in open_], "source string, lam double, mean double, cap double")
        z = F.col("n_tokens") / F.col("mean")
        rate = F.exp(F.col("lam") * z)
        rows = sizes.where("n_tokens > 0").join(F.broadcast(params), "source").select("source", "cap", z.alias("z"), rate.alias("rate"), mass.alias("mass"))
        tokens, slope = F.sum(F.col("mass") * F.least("cap", "rate")), F.sum(F.when(F.col("rate") < F.col("cap"), F.col("mass") * F.col("rate") * F.col("z")).otherwise(0.0))
        sums = {r.source: r for r in rows.groupBy("source").agg(tokens.alias("tokens"), slope.alias("slope")).collect()}
        still = []
        for s in open_:
            now, r = lam[s], sums[s]
            if abs(r.tokens - goal[s]) <= TOLERANCE * goal[s]:
                continue
            still.append(s)
            if r.tokens > goal[s]:
                high[s] = now
            else:
                low[s] = now
            new = now - math.log(r.tokens / goal[s]) * r.tokens / r.slope if r.tokens > 0 and r.slope > 0 else math.nan
            if not low[s] < new < high[s]:
                new = (low[s] + high[s]) / 2 if math.isfinite(low[s] + high[s]) else now + (1 if math.isinf(high[s]) else -1) * max(1.0, abs(now))
            lam[s] = new
        open_ = still
    if open_:
        raise RuntimeError(f"no rates found for {', '.join(open_[:5])}")
    return {s: (lam[s], base[s].t / base[s].n) for s in wanted}


def rate_of(size: Column, lam: Column, mean: Column, most: Column) -> Column:
    """The rate of a document; an infinite lambda means the largest."""
    return F.when(lam == float("inf"), most.cast("double")).otherwise(F.least(most.cast("double"), F.exp(lam * size / mean)))


def rounded(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """Copies by systematic rounding: (key, source, n_tokens, most, copies).

    Rates are summed along the documents of a source by size band, slot of the key's hash, size and key; a document gets as
    many copies as whole numbers are passed, so sums of copies and rates differ by less than one in every stretch. Bands
    and slots are cells whose sums are added up first; a window sees one cell, never a whole source.
    """
    rate = rate_of(F.col("n_tokens"), F.col("lam"), F.col("mean"), F.col("most"))
    cell = ["source", "band", "slot"]
    rows = docs.where("n_tokens > 0").join(F.broadcast(rates), "source").select(
        "key", "source", "n_tokens", "most", rate.alias("rate"), F.floor(F.log2("n_tokens") * BANDS).cast("int").alias("band"), F.pmod(F.xxhash64("key"), F.lit(SLOTS)).cast("int").alias("slot")
    )
    sums = rows.groupBy(*cell).agg(F.sum(F.col("rate").cast("decimal(38,12)")).alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("source").orderBy("band", "slot").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*cell, F.coalesce(before, F.lit(0).cast("decimal(38,12)")).alias("offset"))
    inside = F.sum(F.col("rate").cast("decimal(38,12)")).over(Window.partitionBy(*cell).orderBy("n_tokens", F.xxhash64("key"), "key").rowsBetween(Window.unboundedPreceding, 0))
    # offsets hold at most sources x 8 bands an octave x 64 octaves x SLOTS rows, whatever the corpus
    up = rows.withColumn("sum", inside).join(F.broadcast(offsets), cell).withColumn("to", F.col("offset") + F.col("sum"))
    half = F.lit("0.5").cast("decimal(2,1)")
    copies = F.floor(F.col("to") + half) - F.floor(F.col("to") - F.col("rate").cast("decimal(38,12)") + half)
    return up.select("key", "source", "n_tokens", "most", F.least(F.col("most").cast("long"), copies.cast("long")).alias("copies"))


def repaired(cuts: Cuts, mix: DataFrame, goal: dict[str, float]) -> DataFrame:
    """``mix`` after a few single copies more or less that bring each source's tokens next to its goal.

    Per round and source the largest document that still fits what is missing gets a copy, or loses one if there are too
    many; candidates are compared in the map tasks, and the driver gets one row per source.
    """
    for k in range(REPAIRS + 1):
        sums = {r.source: r.t for r in mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect()}
        gaps = [(s, float(round(goal[s] - sums.get(s, 0)))) for s in sorted(goal) if s in sums]
        if k == REPAIRS or not any(gap for _, gap in gaps):
            break
        want = cuts.spark.createDataFrame(gaps, "source string, gap double")
        fits = (F.col("n_tokens") <= F.abs("gap")) & (((F.col("gap") > 0) & (F.col("copies") < F.col("most"))) | ((F.col("gap") < 0) & (F.col("copies") > 0)))
        best = mix.join(F.broadcast(want), "source").where(fits).groupBy("source").agg(F.max(F.struct("n_tokens", "key", F.signum("gap").cast("long").alias("by"))).alias("x")).select("source", "x.*").collect()
        if not best:
            break
        moved = cuts.spark.createDataFrame([(r.source, r.n_tokens, r.key, r.by) for r in best], mix.select("source", "n_tokens", "key", F.col("copies").alias("by")).schema)
        mix = mix.join(F.broadcast(moved), ["source", "n_tokens", "key"], "left").select("key", "source", "n_tokens", "most", (F.col("copies") + F.coalesce("by", F.lit(0))).alias("copies"))
    return mix


def mix_sources(df: DataFrame, key: str, text: str, source: Column, targets: DataFrame, target_source: Column, total: float | None = None, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A mix in which each source holds its share of the tokens: (documents, report).

    Documents: (key, source, n_tokens, copies), copies >= 1 and <= the source's ``max_repeat``. Report, a row per target:
    (source, target_share, max_repeat, source_documents, source_tokens, goal_tokens, goal_share, mix_documents, mix_copies,
    mix_tokens, mix_share). Shares of sources without tokens are spread over the others in proportion; their rows report 0. Documents
    without a key, without a source, of a source without a target, or without tokens (null and empty texts) are left out.
    Rows that repeat a key with the same source and number of tokens are one document. Empty tables give no documents.

    Sizes are counted once and written to the shared folder with their keys only; texts don't move. What follows uses that
    table: the numbers of documents by source and size for Newton's steps, then cells for rounding.
    """
    spark = df.sparkSession
    cuts = Cuts(spark, "mixing")
    wanted = read_targets(targets, target_source)
    path = vocabulary or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()
    known = spark.createDataFrame([(s, most) for s, (_, most) in wanted.items()], "source string, most int")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return token_counts(batches, path)

    rows = df.select(F.col(f"`{key}`").alias("key"), source.alias("source"), F.col(f"`{text}`").cast("string").alias("text")).where("key is not null and source is not null")
    counted = rows.join(F.broadcast(known), "source").select("key", "source", "most", "text").mapInArrow(count, f"key {kind}, source string, most int, n_tokens long")
    docs = cuts.save("docs", counted.distinct())
    sizes = cuts.save("sizes", docs.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")))
    have = {r.source: r.t for r in sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("t")).collect()}
    goal = goals(have, wanted, total)
    found = balance(spark, sizes, goal, {s: most for s, (_, most) in wanted.items()})
    rates = spark.createDataFrame([(s, *found[s]) for s in sorted(found)], "source string, lam double, mean double")
    mix = repaired(cuts, cuts.save("rounded", rounded(docs, rates)), goal)
    taken = mix.where("copies > 0")
    all_tokens = taken.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("copies")), F.lit(0))).scalar()
    listed = spark.createDataFrame([(s, share, most, goal.get(s, 0.0)) for s, (share, most) in wanted.items()], "source string, target_share double, max_repeat int, goal_tokens double")
    given = docs.groupBy("source").agg(F.count(F.lit(1)).alias("source_documents"), F.sum("n_tokens").alias("source_tokens"))
    used = taken.groupBy("source").agg(F.count(F.lit(1)).alias("mix_documents"), F.sum("copies").alias("mix_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"))
    counts = ["source_documents", "source_tokens", "mix_documents", "mix_copies", "mix_tokens"]
    joined = listed.join(F.broadcast(given), "source", "left").join(F.broadcast(used), "source", "left").fillna(0, counts)
    share = F.when(all_tokens > 0, F.col("mix_tokens") / all_tokens).otherwise(0.0)
    all_goals = sum(goal.values())
    goal_share = F.col("goal_tokens") / all_goals if all_goals else F.lit(0.0)
    report = joined.select("source", "target_share", "max_repeat", "source_documents", "source_tokens", "goal_tokens", goal_share.alias("goal_share"), "mix_documents", "mix_copies", "mix_tokens", share.alias("mix_share"))
    return taken.select(F.col("key").alias(key), "source", "n_tokens", "copies"), report
