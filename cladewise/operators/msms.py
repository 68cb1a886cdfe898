"""Mass-spectrum runs: features, candidate molecules, assignments and their likelihood.

Runs: (run, species, filter). Candidates: (run, feature, molecule, bin). Assignments: (run, feature, molecule or null, bin); null is the
unknown molecule, whose bin is given per feature.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.functions import prob as P

_ASSIGN = "run long, feature long, molecule long, bin int"


def all_unknown(unknowns: DataFrame) -> DataFrame:
    """Every feature on the unknown molecule; ``unknowns`` has (run, feature, bin)."""
    return unknowns.select("run", "feature", F.lit(None).cast("long").alias("molecule"), "bin")


def features_without_bin(candidates: DataFrame, unknowns: DataFrame) -> DataFrame:
    """Features of the candidates that have no bin for the unknown molecule: none in good data."""
    return candidates.select("run", "feature").distinct().join(unknowns, ["run", "feature"], "left_anti")


def nested(candidates: DataFrame) -> DataFrame:
    """(run, feature, candidates): candidates of a feature as an array sorted by molecule."""
    return candidates.groupBy("run", "feature").agg(F.array_sort(F.collect_list(F.struct("molecule", "bin"))).alias("candidates"))


def free_candidates(candidates: DataFrame, assigned: DataFrame) -> DataFrame:
    """Candidates whose molecule isn't assigned in their run."""
    return candidates.join(assigned.where("molecule is not null").select("run", "molecule"), ["run", "molecule"], "left_anti")


def assigned_in_run(assigned: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (run, molecule) that are assigned."""
    return wanted.join(assigned.where("molecule is not null").select("run", "molecule"), ["run", "molecule"], "left_semi")


def candidate_of_feature(candidates: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (run, feature, molecule) that are candidates, with the bin."""
    return wanted.join(candidates, ["run", "feature", "molecule"])


def assignment_kinds(assigned: DataFrame) -> DataFrame:
    """(run, n_real, n_unknown)."""
    real = F.col("molecule").isNotNull()
    return assigned.groupBy("run").agg(F.count_if(real).alias("n_real"), F.count_if(~real).alias("n_unknown"))


def molecules_twice(assigned: DataFrame) -> DataFrame:
    """Molecules on more than one feature of a run: none, ever."""
    return assigned.where("molecule is not null").groupBy("run", "molecule").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def present_per_species(y: DataFrame) -> DataFrame:
    """(species, molecules): sorted array of the molecules that are one."""
    return y.where("state").groupBy(F.col("r").alias("species")).agg(F.array_sort(F.collect_list("c")).alias("molecules"))


def special_cells(y: DataFrame, runs: DataFrame, assigned: DataFrame) -> DataFrame:
    """Molecules that are present or assigned, per run: (run, species, filter, molecule, y, ms). All others are neither."""
    present = runs.join(y.where("state").select(F.col("r").alias("species"), F.col("c").alias("molecule")), "species").select("run", "molecule", F.lit(True).alias("y"))
    taken = assigned.where("molecule is not null").select("run", "molecule", F.lit(True).alias("ms"))
    both = present.join(taken, ["run", "molecule"], "full").fillna({"y": False, "ms": False})
    return both.join(runs.select("run", "species", "filter"), "run")


def log_likelihood(y: DataFrame, runs: DataFrame, assigned: DataFrame, filters: DataFrame, n_molecules: int, contamination: float) -> DataFrame:
    """(run, n_special, log_likelihood) of each run that has features.

    Features count with their bin's probability, present or assigned molecules with their detection, and all other molecules as one
    term. ``filters`` has (filter, molecule, index); pairs without a row have the starting index 128.
    """
    feature = assigned.groupBy("run").agg(F.sum(P.safe_ln(P.phred_proba("bin"))).alias("ln_features"))
    cells = special_cells(y, runs, assigned).join(filters, ["filter", "molecule"], "left").fillna({"index": 128})
    p = P.p_detection("y", "ms", P.linear_proba("index"), F.lit(contamination))
    detection = cells.groupBy("run").agg(F.count(F.lit(1)).alias("n_special"), F.sum(P.safe_ln(p)).alias("ln_special"))
    bulk = (F.lit(float(n_molecules)) - F.col("n_special")) * math.log1p(-contamination)
    rows = feature.join(detection, "run", "left").fillna({"n_special": 0, "ln_special": 0.0})
    return rows.select("run", "n_special", (F.col("ln_features") + F.col("ln_special") + bulk).alias("log_likelihood"))


def contamination_ratio(y: DataFrame, runs: DataFrame, assigned: DataFrame, n_molecules: int, old: float, new: float) -> DataFrame:
    """(log_ratio) of a new contamination: only absent molecules depend on it, so their numbers are enough."""
    cells = special_cells(y, runs, assigned)
    with_features = runs.join(assigned.select("run").distinct(), "run").agg(F.count(F.lit(1))).scalar()
    n1 = F.count_if(~F.col("y") & F.col("ms"))
    n0 = with_features * F.lit(float(n_molecules)) - F.count_if(F.col("y")) - n1
    return cells.join(assigned.select("run").distinct(), "run").agg((n1 * (math.log(new) - math.log(old)) + n0 * (math.log1p(-new) - math.log1p(-old))).alias("log_ratio"))


def filter_ratios(y: DataFrame, runs: DataFrame, assigned: DataFrame, filters: DataFrame, proposed: DataFrame) -> DataFrame:
    """(filter, molecule, log_ratio) of proposed indices (filter, molecule, new): only present molecules depend on the filter."""
    cells = special_cells(y, runs, assigned).where("y").groupBy("filter", "molecule").agg(F.count_if("ms").alias("hit"), F.count_if(~F.col("ms")).alias("miss"))
    rows = proposed.join(filters, ["filter", "molecule"], "left").fillna({"index": 128}).join(cells, ["filter", "molecule"], "left").fillna({"hit": 0, "miss": 0})

    def ln(ix: str) -> Column:  # no hits must not turn the guard value for 0 into a term
        return F.when(F.col("hit") > 0, F.col("hit") * P.log_linear_proba(ix)).otherwise(0.0) + F.when(F.col("miss") > 0, F.col("miss") * P.log_linear_proba_reversed(ix)).otherwise(0.0)

    return rows.select("filter", "molecule", (ln("new") - ln("index")).alias("log_ratio"))


def cell_log_ratio(y_cells: DataFrame, runs: DataFrame, assigned: DataFrame, filters: DataFrame, contamination: float) -> DataFrame:
    """(r, c, log0, log1): what the runs of a species say about cells (r, c) of Y."""
    rows = y_cells.select("r", "c").join(runs.withColumnRenamed("species", "r"), "r").withColumn("molecule", F.col("c"))
    rows = rows.join(assigned.where("molecule is not null").select("run", "molecule", F.lit(True).alias("ms")), ["run", "molecule"], "left").fillna({"ms": False})
    rows = rows.join(filters, ["filter", "molecule"], "left").fillna({"index": 128})
    ln = [P.safe_ln(P.p_detection(F.lit(s), "ms", P.linear_proba("index"), F.lit(contamination))) for s in (False, True)]
    return rows.groupBy("r", "c").agg(F.sum(ln[0]).alias("log0"), F.sum(ln[1]).alias("log1"))


def changed_molecules(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Molecules (run, molecule) that left and that came, net of those that only changed their feature."""
    a, b = (x.where("molecule is not null").select("run", "molecule") for x in (old, new))
    return a.exceptAll(b), b.exceptAll(a)


# -- moves inside a run --------------------------------------------------------------------------------------------------------
class Run:
    """A run in one task: candidates by feature, current assignment, and the four moves. A run is one measurement; what grows is
    the number of runs."""

    def __init__(self, candidates: dict[int, dict[int, int]], unknown: np.ndarray, molecule: np.ndarray, bins: np.ndarray):
        self.candidates, self.unknown, self.molecule, self.bins = candidates, unknown, molecule.copy(), bins.copy()
        self.taken = {int(m) for m in molecule if m >= 0}

    def free(self, f: int) -> list[int]:
        return [m for m in self.candidates.get(f, {}) if m not in self.taken]

    def _real(self) -> np.ndarray:
        return np.flatnonzero(self.molecule >= 0)

    def propose(self, u: np.ndarray) -> tuple[list[tuple[int, int, int]], float] | None:
        """Changes (feature, molecule, bin) and the log of the proposal ratio, or None; ``u`` holds four uniforms."""
        pick = lambda seq, x: seq[min(int(x * len(seq)), len(seq) - 1)]
        kind, real = int(u[0] * 4), self._real()
        n_real, n_unknown = len(real), len(self.molecule) - len(real)
        if kind == 0:  # to unknown
            if not n_real:
                return None
            f = int(pick(real, u[1]))
            return [(f, -1, int(self.unknown[f]))], math.log(n_real / ((n_unknown + 1) * (len(self.free(f)) + 1)))
        if kind == 1:  # from unknown
            if not n_unknown:
                return None
            f = int(pick(np.flatnonzero(self.molecule < 0), u[1]))
            free = self.free(f)
            if not free:
                return None
            m = pick(free, u[2])
            return [(f, m, self.candidates[f][m])], math.log(n_unknown * len(free) / (n_real + 1))
        if kind == 2:  # swap
            if n_real < 2:
                return None
            i = int(pick(real, u[1]))
            j = int(pick(real[real != i], u[2]))
            a, b = int(self.molecule[i]), int(self.molecule[j])
            if b not in self.candidates.get(i, {}) or a not in self.candidates.get(j, {}):
                return None
            return [(i, b, self.candidates[i][b]), (j, a, self.candidates[j][a])], 0.0
        if not n_real:  # move to a free candidate
            return None
        f = int(pick(real, u[1]))
        free = self.free(f)
        if not free:
            return None
        m = pick(free, u[2])
        return [(f, m, self.candidates[f][m])], 0.0

    def log_ratio(self, move: list[tuple[int, int, int]], y: set[int], passes: dict[int, float], contamination: float) -> float:
        """Log-likelihood ratio: the features' bins, and molecules whose assignment changes."""
        ln = lambda p: math.log(p) if p > 0 else -P.LARGEST_DOUBLE
        phred = lambda b: 1 - 1.1 ** (-b / 10)

        def seen(m: int, ms: bool) -> float:
            f = passes.get(m, 128 / 255)
            return ln((f if ms else 1 - f) if m in y else (contamination if ms else 1 - contamination))

        out = sum(ln(phred(b)) - ln(phred(self.bins[f])) for f, _, b in move)
        gone, come = {int(self.molecule[f]) for f, _, _ in move} - {-1}, {m for _, m, _ in move} - {-1}
        return out + sum(seen(m, False) - seen(m, True) for m in gone - come) + sum(seen(m, True) - seen(m, False) for m in come - gone)

    def apply(self, move: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Make the move; what comes back undoes it."""
        back = [(f, int(self.molecule[f]), int(self.bins[f])) for f, _, _ in move]
        for f, _, _ in move:
            self.taken.discard(int(self.molecule[f]))
        for f, m, b in move:
            self.molecule[f], self.bins[f] = m, b
        self.taken |= {m for _, m, _ in move if m >= 0}
        return back


def run_uniforms(run: int, n_moves: int, seed: int, iteration: int) -> np.ndarray:
    """Four numbers in (0, 1) per move that depend on run, seed and iteration only."""
    return np.random.Generator(np.random.Philox(key=[run & (2**64 - 1), (seed << 32) + iteration])).random((n_moves, 4))


def lattice_run_uniforms(run: int, n_moves: int, seed: int, iteration: int) -> np.ndarray:
    """The same from integer arithmetic that SQL has too."""
    return ((run * 7919 + np.arange(4 * n_moves).reshape(n_moves, 4) * 104729) % 1000003 + 0.5) / 1000003.0


def updated_assignments(candidates: DataFrame, unknowns: DataFrame, assigned: DataFrame, runs: DataFrame, y: DataFrame, filters: DataFrame, contamination: float, seed: int, iteration: int, n_moves: int = 1, uniforms: Callable[[int, int, int, int], np.ndarray] | None = None) -> DataFrame:
    """Assignments after ``n_moves`` proposed moves per run, each taken by likelihood and proposal ratio.

    Randomness depends on run, seed, iteration and move. Runs without features have no rows. What a run needs from Y and the filters is
    joined to its candidates first, so each run is one row of arrays.
    """
    draw_uniforms = uniforms or run_uniforms
    info = candidates.join(runs.select("run", "species", "filter"), "run")
    info = info.join(y.where("state").select(F.col("r").alias("species"), F.col("c").alias("molecule"), F.lit(True).alias("y")), ["species", "molecule"], "left")
    info = info.join(filters, ["filter", "molecule"], "left").fillna({"y": False, "index": 128}).select("run", "feature", "molecule", "bin", "y", "index")
    state = assigned.select("run", "feature", F.coalesce("molecule", F.lit(-1)).alias("molecule"), "bin").join(unknowns.select("run", "feature", F.col("bin").alias("unknown")), ["run", "feature"])

    # one row per run, with its candidates and features as arrays: grouped by Spark, moved in batches
    cands = info.groupBy("run").agg(F.collect_list(F.struct("feature", "molecule", "bin", "y", "index")).alias("cands"))
    now = state.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("feature", "molecule", "bin", "unknown"))).alias("now"))

    def moved(number: int, cands: list[dict], now: list[dict]) -> Run:
        at = {x["feature"]: k for k, x in enumerate(now)}
        lists: dict[int, dict[int, int]] = {}
        for c in sorted(cands, key=lambda c: (c["feature"], c["molecule"])):
            if c["feature"] in at:
                lists.setdefault(at[c["feature"]], {})[c["molecule"]] = c["bin"]
        present = {c["molecule"] for c in cands if c["y"]}
        passes = {c["molecule"]: c["index"] / 255 for c in cands}
        run = Run(lists, *(np.array([x[k] for x in now], np.int64) for k in ("unknown", "molecule", "bin")))
        us = draw_uniforms(number, n_moves, seed, iteration)
        for u in us:
            move = run.propose(u)
            if move and math.log(u[3]) < run.log_ratio(move[0], present, passes, contamination) + move[1]:
                run.apply(move[0])
        return run

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                run = moved(row["run"], row["cands"] or [], row["now"])
                out += [(row["run"], x["feature"], int(m) if m >= 0 else None, int(b)) for x, m, b in zip(row["now"], run.molecule, run.bins, strict=True)]
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["run", "feature", "molecule", "bin"])

    return now.join(cands, "run", "left").select("run", "cands", "now").mapInArrow(go, _ASSIGN)
