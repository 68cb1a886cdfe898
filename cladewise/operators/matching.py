"""Assignment of features to molecules: a maximum-weight bipartite matching.

Up to ``most_packed`` edges are solved exactly in arrays of numbers by one task. Beyond that connected components are solved exactly, each in
one task, and those that are larger themselves by an auction in rounds of joins and aggregations, down to steps so small that the total is the
largest to less than ``RESOLUTION``.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.store import Cuts

MOST_EDGES = 300_000
#: Edges that one task holds in arrays, the rounds of bids before what is still free takes shortest paths, and the edges that bids look
#: at in one go.
MOST_PACKED, BID_ROUNDS, AT_ONCE = 2**24, 3_000, 2**20
EPSILON = 1e-3
#: The unit of reported scores.
RESOLUTION = 1e-6
_MATCHED = "feature string, molecule string, score double"
#: The factor between the steps of an auction.
SHRINK = 8.0
#: The headers, in any case and with blanks around, under which edge lists are accepted.
ALIASES = {"feature": ("feat", "feature_id", "feature"), "molecule": ("mol", "molecule_id", "molecule", "compound"), "score": ("score", "probability", "prob", "p", "value")}


def read_edges(df: DataFrame) -> DataFrame:
    """(feature, molecule, score) under any of the known headers; scores that aren't numbers, null or not above 0 are dropped."""
    lower = {c.strip().lower(): c for c in df.columns}
    picked = []
    for name, known in ALIASES.items():
        found = next((lower[a] for a in known if a in lower), None)
        if found is None:
            raise ValueError(f"no column for {name}: one of {', '.join(known)}")
        col = F.col(f"`{found}`")
        picked.append(F.expr(f"try_cast(`{found}` as double)").alias(name) if name == "score" else col.cast("string").alias(name))
    rows = df.select(*picked)
    return rows.where("feature is not null and molecule is not null and score > 0 and not isnan(score) and score < double('infinity')")


def best_edges(edges: DataFrame) -> DataFrame:
    """One edge per pair, with its highest score."""
    return edges.groupBy("feature", "molecule").agg(F.max("score").alias("score"))


def edge_summary(edges: DataFrame) -> DataFrame:
    """(n_features, n_molecules, n_edges, density_percent)."""
    counts = edges.agg(F.count_distinct("feature").alias("n_features"), F.count_distinct("molecule").alias("n_molecules"), F.count(F.lit(1)).alias("n_edges"))
    return counts.withColumn("density_percent", 100 * F.col("n_edges") / (F.col("n_features") * F.col("n_molecules")))


def components(cuts: Cuts, edges: DataFrame) -> DataFrame:
    """(feature, component): the least feature name reached. Labels hop over molecules and, through the label's own label, along
    chains, so the number of rounds grows with the logarithm of the longest one."""
    label = cuts.save("labels", edges.select("feature").distinct().withColumn("component", F.col("feature")))
    while True:
        low = edges.join(label, "feature").groupBy("molecule").agg(F.min("component").alias("m"))
        near = edges.join(low, "molecule").groupBy("feature").agg(F.min("m").alias("m"))
        hooks = label.join(near, "feature").groupBy("component").agg(F.min("m").alias("m"))
        step = label.join(near, "feature").join(hooks.withColumnRenamed("m", "h"), "component").select("feature", F.col("component").alias("old"), F.least("m", "h").alias("component"))
        over = step.select("feature", "old", F.col("component").alias("c")).join(step.select(F.col("feature").alias("c"), F.col("component").alias("up")), "c")
        new = cuts.save("steps", over.select("feature", "old", F.col("up").alias("component")))
        changed = new.where("component != old").limit(1).count()
        label = cuts.save("labels", new.select("feature", "component"))
        if not changed:
            return label


def solve_component(edges: pd.DataFrame) -> pd.DataFrame:
    """Exact maximum-weight matching by shortest augmenting paths with potentials; ties go to the first names.

    Every feature may stay free at a score of 0.
    """
    edges = edges.sort_values(["feature", "molecule"])
    rows, names_r = pd.factorize(edges["feature"])
    cols, names_c = pd.factorize(edges["molecule"], sort=True)
    score = edges["score"].to_numpy(float)
    top, n, m = score.max(), len(names_r), len(names_c)
    adj: list[list[tuple[int, float]]] = [[(m + i, top)] for i in range(n)]
    for r, c, s in zip(rows, cols, score, strict=True):
        adj[r].append((int(c), top - s))
    u, v = [0.0] * n, [0.0] * (m + n)
    row_of, col_of = [-1] * (m + n), [-1] * n
    for start in range(n):
        dist, via, done = {}, {}, {}
        heap: list[tuple[float, int]] = []
        row, base = start, 0.0
        while True:
            for c, cost in adj[row]:
                if c not in done:
                    d = base + cost - u[row] - v[c]
                    if d < dist.get(c, float("inf")):
                        dist[c], via[c] = d, row
                        heapq.heappush(heap, (d, c))
            while True:
                base, c = heapq.heappop(heap)
                if c not in done and base <= dist[c]:
                    break
            done[c] = base
            if row_of[c] < 0:
                break
            row = row_of[c]
        u[start] += base
        for j, d in done.items():
            if j != c:
                u[row_of[j]] += base - d
                v[j] -= base - d
        while True:
            row = via[c]
            row_of[c], col_of[row], c = row, c, col_of[row]
            if row == start:
                break
    weight = {(r, c): s for r, c, s in zip(rows, cols, score, strict=True)}
    out = [(names_r[r], names_c[col_of[r]], weight[r, col_of[r]]) if col_of[r] < m else (names_r[r], None, 0.0) for r in range(n)]
    return pd.DataFrame(out, columns=["feature", "molecule", "score"])


def _wishes(start: np.ndarray, cols: np.ndarray, score: np.ndarray, price: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best gain of each free row, its object, and how much more it is than the second best."""
    n = start[free + 1] - start[free]
    before = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat(start[free] - before, n)
    gain = score[at] - price[cols[at]]
    best = np.maximum.reduceat(gain, before)
    first = np.minimum.reduceat(np.where(gain == np.repeat(best, n), np.arange(len(gain)), len(gain)), before)
    gain[first] = -np.inf
    return best, cols[at[first]], best - np.maximum(np.maximum.reduceat(gain, before), 0.0)


def _bids(start: np.ndarray, cols: np.ndarray, score: np.ndarray, price: np.ndarray, owner: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Rounds of bids without a step, all free rows at once; sets prices and owners and returns the rows that are still free.

    A bid goes to the object of the best gain and makes it as good as the second best, 0 for staying free among them. An object that has an owner
    isn't taken without a raise. So everyone has a best object at all times, and objects without an owner keep a price of 0.
    """
    free, stuck = np.arange(len(mine)), []
    for _ in range(BID_ROUNDS):
        if not len(free):
            break
        ends = np.cumsum(start[free + 1] - start[free])
        cuts = [0, *np.flatnonzero(np.diff(ends // AT_ONCE)) + 1, len(free)]
        best, wanted, more = (np.concatenate(x) for x in zip(*(_wishes(start, cols, score, price, free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a), strict=True))
        bids = (best > 0) & ((more > 0) | (owner[wanted] < 0))
        stuck.append(free[(best > 0) & ~bids])
        row, col, offer = free[bids], wanted[bids], price[wanted[bids]] + more[bids]
        by = np.lexsort((row, -offer, col))
        row, col, offer = row[by], col[by], offer[by]
        won = np.r_[True, col[1:] != col[:-1]][: len(col)]
        lost, (row, col, offer) = row[~won], (x[won] for x in (row, col, offer))
        out = owner[col][owner[col] >= 0]
        mine[out] = -1
        mine[row], owner[col], price[col] = col, row, offer
        free = np.sort(np.concatenate([lost, out]))
    return np.sort(np.concatenate([free, *stuck]))


def solve_arrays(rows: np.ndarray, cols: np.ndarray, score: np.ndarray, n: int, m: int) -> np.ndarray:
    """The column of each of ``n`` rows in an exact maximum-weight matching, -1 if it stays free; edges are sorted by row, each row has one.

    Bids match most rows, and their prices stay valid for shortest augmenting paths, which match the rest.
    """
    start = np.searchsorted(rows, np.arange(n + 1))
    price, owner, mine = np.zeros(m), np.full(m, -1), np.full(n, -1)
    rest = _bids(start, cols, score, price, owner, mine)
    profit = np.zeros(n)
    held = mine[rows] == cols
    profit[rows[held]] = score[held] - price[cols[held]]
    for s in rest.tolist():
        a, b = start[s], start[s + 1]
        profit[s] = max(0.0, (score[a:b] - price[cols[a:b]]).max())
        dist: dict[int, float] = {}
        via: dict[int, int] = {}
        done: dict[int, float] = {}
        heap: list[tuple[float, int]] = []
        reached, row, base, end, last, goal = [(s, 0.0)], s, 0.0, np.inf, s, -1
        while True:
            a, b, low = start[row], start[row + 1], base + float(profit[row])
            if low < end:
                end, last = low, row
            d = low - score[a:b] + price[cols[a:b]]
            near = np.flatnonzero(d < end)
            for c, x in zip(cols[a:b][near].tolist(), np.maximum(d[near], base).tolist(), strict=True):
                if c not in done and x < dist.get(c, np.inf):
                    dist[c], via[c] = x, row
                    heapq.heappush(heap, (x, c))
            while heap and (heap[0][1] in done or heap[0][0] > dist[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= end:
                break
            base, c = heapq.heappop(heap)
            done[c] = base
            if owner[c] < 0:
                end, goal = base, c
                break
            row = int(owner[c])
            reached.append((row, base))
        for r, d in reached:
            profit[r] -= max(0.0, end - d)
        for c, d in done.items():
            price[c] += max(0.0, end - d)
        if goal < 0:  # the last row stays free and leaves its column
            goal, mine[last] = int(mine[last]), -1
            if last == s:
                continue
        while True:
            row = via[goal]
            owner[goal], mine[row], goal = row, goal, int(mine[row])
            if row == s:
                break
    return mine


def solve_packed(edges: pa.Table) -> pa.Table:
    """As solve_component, for (feature, molecule, score) in Arrow; names are numbered by rising name."""
    codes, names = [], []
    for name in ("feature", "molecule"):
        found = edges[name].combine_chunks().dictionary_encode()
        by = np.argsort(np.array(found.dictionary.to_pylist(), object))
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        codes.append(place[found.indices.to_numpy()])
        names.append(found.dictionary.take(pa.array(by)))
    by = np.lexsort((codes[1], codes[0]))
    rows, cols, score = codes[0][by], codes[1][by], edges["score"].to_numpy()[by]
    mine = solve_arrays(rows, cols, score, len(names[0]), len(names[1]))
    won = np.zeros(len(mine))
    held = mine[rows] == cols
    won[rows[held]] = score[held]
    return pa.table({"feature": names[0], "molecule": names[1].take(pa.array(mine, mask=mine < 0)), "score": won})


def solve_coded(edges: pa.Table) -> pa.Table:
    """(row, col, score) of each row in an exact matching of edges between dense numbers, the column null if the row stays free."""
    rows, cols, score = (edges[x].to_numpy() for x in ("row", "col", "score"))
    by = np.lexsort((cols, rows))
    rows, cols, score = rows[by], cols[by], score[by]
    mine = solve_arrays(rows, cols, score, int(rows.max()) + 1, int(cols.max()) + 1)
    won = np.zeros(len(mine))
    held = mine[rows] == cols
    won[rows[held]] = score[held]
    return pa.table({"row": np.arange(len(mine)), "col": pa.array(mine, mask=mine < 0), "score": won})


def doubled(edges: DataFrame) -> DataFrame:
    """(person, object, weight): the edges and a mirrored copy of them, each node linked to its copy at weight 0.

    Everyone can be matched there, and the best perfect matching has twice the total of the best matching of ``edges``, in which nodes may
    stay free. So prices of an earlier phase stay valid starting prices.
    """
    f, m = F.concat(F.lit("f"), "feature"), F.concat(F.lit("m"), "molecule")
    zero = F.lit(0.0).alias("weight")
    there = edges.select(f.alias("person"), m.alias("object"), F.col("score").alias("weight"))
    back = edges.select(m.alias("person"), f.alias("object"), F.col("score").alias("weight"))
    own = edges.select(f.alias("person")).unionByName(edges.select(m.alias("person"))).distinct().select("person", F.col("person").alias("object"), zero)
    return there.unionByName(back).unionByName(own)


def _gains(links: DataFrame, owners: DataFrame) -> DataFrame:
    return links.join(owners.select("object", "price"), "object").select("person", "object", "weight", (F.col("weight") - F.col("price")).alias("gain"))


def auction(cuts: Cuts, edges: DataFrame, epsilon: float, most_rounds: int = 100_000) -> DataFrame:
    """(feature, molecule, score) of matched features, with the largest total to less than ``RESOLUTION``.

    In a round everyone free bids for the object of the best gain (weight less price), so much that the second best is the step better off; an
    object goes to its highest bid, ties to the last name. When all have an object the step shrinks; those whose object is no longer
    within the step of their best give it up, prices stay. The last step is at most ``epsilon`` and so small that the steps of all
    together are half of RESOLUTION: where scores are multiples of it, the matching is a best one. At the end the total is compared with
    its upper bound, the sum of prices and gains. Running out of rounds or missing the bound is an error.
    """
    links = cuts.save("doubled", doubled(edges))
    size, step = links.agg(F.count_distinct("person").alias("n"), F.max("weight").alias("top")).first()
    last = min(epsilon, RESOLUTION / (2 * max(size, 1)))
    owners = cuts.save("owners", links.select("object").distinct().select("object", F.lit(None).cast("string").alias("person"), F.lit(0.0).alias("price")))
    step, n_owned, rounds = max(step or 0.0, last), 0, 0
    by_gain = Window.partitionBy("person").orderBy(F.desc("gain"), "object")
    while True:
        while n_owned < size:
            if rounds == most_rounds:
                raise RuntimeError(f"the auction didn't end within {most_rounds} rounds")
            rounds += 1
            free = links.join(owners.where("person is not null").select("person"), "person", "left_anti")
            # the limit to two rows a person is applied in the map tasks already
            two = _gains(free, owners).withColumn("k", F.row_number().over(by_gain)).where("k <= 2")
            bids = two.groupBy("person").agg(F.max_by("object", -F.col("k")).alias("object"), F.max_by("weight", -F.col("k")).alias("weight"), F.min("gain").alias("second"))
            won = bids.groupBy("object").agg(F.max(F.struct((F.col("weight") - F.col("second") + step).alias("price"), "person")).alias("w"))
            owners = cuts.save("owners", owners.join(won, "object", "left").select("object", F.coalesce("w.person", "person").alias("person"), F.coalesce("w.price", "price").alias("price")))
            n_owned = owners.where("person is not null").count()
        if step <= last:
            break
        step = max(step / SHRINK, last)
        most = _gains(links, owners).groupBy("person").agg(F.max("gain").alias("most"))
        kept = owners.where("person is not null").join(links, ["person", "object"]).join(most, "person").where(F.col("weight") - F.col("price") >= F.col("most") - step)
        owners = cuts.save("owners", owners.select("object", "price").join(kept.select("object", "person"), "object", "left").select("object", "person", "price"))
        n_owned = owners.where("person is not null").count()
    bound = owners.agg(F.sum("price")).first()[0] or 0.0
    bound += _gains(links, owners).groupBy("person").agg(F.max("gain").alias("most")).agg(F.sum("most")).first()[0] or 0.0
    pairs = owners.join(links, ["person", "object"])
    total = pairs.agg(F.sum("weight")).first()[0] or 0.0
    if not bound - total < RESOLUTION:
        raise RuntimeError(f"the auction's total may be {bound - total} below the largest")
    cut = pairs.where("person like 'f%' and object like 'm%'")
    return cuts.save("auctioned", cut.select(F.substring("person", 2, 2**31 - 1).alias("feature"), F.substring("object", 2, 2**31 - 1).alias("molecule"), F.col("weight").alias("score")))


def assign(edges: DataFrame, min_score: float = 0.0, most_edges: int = MOST_EDGES, epsilon: float = EPSILON, most_packed: int = MOST_PACKED) -> DataFrame:
    """(Feature, Assigned_Molecule, Score, Low_Confidence, Unassigned) of every feature with an edge.

    Rows are sorted by feature, scores rounded to six digits. Features without a molecule have a null one and score 0. Repeated pairs count once, with their
    highest score; an empty edge list gives no rows. Edges that one task can hold are solved there, all components at once.
    """
    cuts = Cuts(edges.sparkSession, "matching")
    best = cuts.save("edges", best_edges(edges))
    if 0 < best.count() <= most_packed:
        return report_rows(_coded(cuts, best), min_score).orderBy("Feature")
    label = components(cuts, best)
    marked = cuts.save("marked", best.join(label, "feature"))
    sizes = marked.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    sized = marked.join(sizes, "component")
    exact = sized.where(F.col("n") <= most_edges).groupBy("component").applyInPandas(lambda x: solve_component(x[["feature", "molecule", "score"]]), _MATCHED)
    packed = _packed(sized.where((F.col("n") > most_edges) & (F.col("n") <= most_packed)), F.col("component"))
    big = cuts.save("big", sized.where(F.col("n") > max(most_edges, most_packed)).select("feature", "molecule", "score"))
    found = exact.unionByName(packed)
    if big.limit(1).count():
        won = auction(cuts, big, epsilon)
        found = found.unionByName(won).unionByName(big.select("feature").distinct().join(won.select("feature"), "feature", "left_anti").select("feature", F.lit(None).cast("string").alias("molecule"), F.lit(0.0).alias("score")))
    return report_rows(found, min_score).orderBy("Feature")


def _coded(cuts: Cuts, edges: DataFrame) -> DataFrame:
    """(feature, molecule, score) of all features, solved in one task, which is sent numbers instead of names."""
    rows, cols = cuts.save("rows", codes(cuts, edges, "feature", "row")), cuts.save("cols", codes(cuts, edges, "molecule", "col"))
    named = edges.join(rows, "feature").join(cols, "molecule").select(F.lit(0).alias("_g"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "score")
    found = cuts.save("packed", named.groupBy("_g").applyInArrow(lambda x: solve_coded(x), "row long, col long, score double"))
    return rows.join(found, "row").join(cols, "col", "left").select("feature", "molecule", "score")


def _packed(edges: DataFrame, by: Column) -> DataFrame:
    groups = edges.select(by.alias("_g"), "feature", "molecule", "score").groupBy("_g")
    return groups.applyInArrow(lambda x: solve_packed(x), _MATCHED)


def report_rows(found: DataFrame, min_score: float) -> DataFrame:
    free: Column = F.col("molecule").isNull()
    return found.select(
        F.col("feature").alias("Feature"), F.col("molecule").alias("Assigned_Molecule"), F.round("score", 6).alias("Score"),
        (~free & (F.col("score") < min_score)).alias("Low_Confidence"), free.alias("Unassigned"),
    )


def assignment_summary(result: DataFrame) -> DataFrame:
    """(n_features, n_assigned, percent_assigned, n_unassigned, n_low_confidence, total_score, mean_score)."""
    free = F.col("Unassigned")
    n, k = F.count(F.lit(1)), F.count_if(~free)
    return result.agg(
        n.alias("n_features"), k.alias("n_assigned"), F.try_divide(100.0 * k, n).alias("percent_assigned"), F.count_if(free).alias("n_unassigned"),
        F.count_if("Low_Confidence").alias("n_low_confidence"), F.sum("Score").alias("total_score"), F.avg(F.when(~free, F.col("Score"))).alias("mean_score"),
    )


def encoded(edges: DataFrame) -> DataFrame:
    """Edges with dense codes of their names in byte order: (row, col, score, feature, molecule)."""
    cuts = Cuts(edges.sparkSession, "codes")
    return edges.join(codes(cuts, edges, "feature", "row"), "feature").join(codes(cuts, edges, "molecule", "col"), "molecule").select("row", "col", "score", "feature", "molecule")


def codes(cuts: Cuts, edges: DataFrame, name: str, code: str) -> DataFrame:
    """The names of a column with dense numbers from 0 in byte order.

    Names are brought into ranges of about equal size, whose bounds Spark samples, and the ranges are written with their numbers. Names
    are ranked inside of their range, and names in the ranges before are added; the window over ranges sees a row per range.
    """
    names = edges.select(name).distinct()
    ranges = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = cuts.save(name, names.repartitionByRange(ranges, name).withColumn("_p", F.spark_partition_id()))
    counts = kept.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_p", F.coalesce(before, F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(name)) - 1
    return kept.withColumn("_i", inside).join(offsets, "_p").select(name, (F.col("_o") + F.col("_i")).cast("long").alias(code))
