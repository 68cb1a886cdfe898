"""Probabilities of the model as column expressions; everything stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the model: rates above the cutoff give the stationary matrix; molecule indices take 24 bits.
STATIONARY_CUTOFF = 25.0
MOLECULE_BITS = 24
UNKNOWN_MOLECULE = 2**MOLECULE_BITS - 1
LARGEST_DOUBLE = 1.7976931348623157e308


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def delta(n_bins: int) -> float:
    """Width of a branch-length bin: 2 / (n + 1)."""
    return 2.0 / (n_bins + 1)


def safe_ln(p: Column | str) -> Column:
    """Natural logarithm with -1.797e308 for 0, where Spark's would be null and silently leave a sum."""
    p = _c(p)
    return F.when(p > 0, F.ln(p)).when(p == 0, -LARGEST_DOUBLE)


# -- two-state chains -------------------------------------------------------------------------------------------------
def decay(nu: Column | str, bin_: Column | str, n_bins: int, cutoff: float = STATIONARY_CUTOFF) -> Column:
    """exp(-nu t) at the middle of a bin, 0 above the cutoff."""
    t = (_c(bin_) + F.lit(0.5)) * F.lit(delta(n_bins))
    return F.when(_c(nu) > cutoff, 0.0).otherwise(F.exp(-_c(nu) * t))


def transition(alpha: Column | str, nu: Column | str, bin_: Column | str, n_bins: int, cutoff: float = STATIONARY_CUTOFF) -> dict[str, Column]:
    """The 2x2 transition matrix of a bin in closed form: p00, p01, p10, p11 (from, to)."""
    a, e = _c(alpha), decay(nu, bin_, n_bins, cutoff)
    return {"p00": 1 - a + a * e, "p01": a * (1 - e), "p10": (1 - a) * (1 - e), "p11": a + (1 - a) * e}


def transition_to(parent: Column | str, child: Column | str, p: dict[str, Column]) -> Column:
    """P(child state | parent state)."""
    parent, child = _c(parent), _c(child)
    return F.when(parent & child, p["p11"]).when(parent, p["p10"]).when(child, p["p01"]).otherwise(p["p00"])


def given_parent(parent: Column | str, p: dict[str, Column]) -> tuple[Column, Column]:
    """P(0 | parent) and P(1 | parent)."""
    parent = _c(parent)
    return F.when(parent, p["p10"]).otherwise(p["p00"]), F.when(parent, p["p11"]).otherwise(p["p01"])


def given_node(child: Column | str, p: dict[str, Column]) -> tuple[Column, Column]:
    """P(child | 0) and P(child | 1)."""
    child = _c(child)
    return F.when(child, p["p01"]).otherwise(p["p00"]), F.when(child, p["p11"]).otherwise(p["p10"])


def stationary(state: Column | str, alpha: Column | str) -> Column:
    return F.when(_c(state), _c(alpha)).otherwise(1 - _c(alpha))


# -- observations -----------------------------------------------------------------------------------------------------
def log_count(n: Column | str) -> Column:
    """log(count + 1); null counts as 0."""
    return F.log1p(F.coalesce(_c(n).cast("double"), F.lit(0.0)))


def effort(gamma: float | Column, occurrence: Column | str) -> Column:
    """Share of what is present that research of this intensity finds: 1 - exp(-gamma occ)."""
    return 1 - F.exp(-_c(gamma) * _c(occurrence))


def p_link(x: Column | str, link: Column | str, efforts: Column | None, epsilon: float | Column, simple: bool = False) -> Column:
    """P(link | presence). The simple model errs with epsilon whatever the presence."""
    x, link, eps = _c(x), _c(link), _c(epsilon)
    if simple:
        return F.when(x == link, 1 - eps).otherwise(eps)
    return F.when(x & link, efforts).when(x, 1 - efforts).when(link, eps).otherwise(1 - eps)


def p_detection(y: Column | str, ms: Column | str, passes: Column | str, contamination: float | Column) -> Column:
    """P(assigned or not | presence): filters let present molecules through, contamination brings in absent ones."""
    y, ms, f, c = _c(y), _c(ms), _c(passes), _c(contamination)
    return F.when(y & ms, f).when(y, 1 - f).when(ms, c).otherwise(1 - c)


# -- binned probabilities ----------------------------------------------------------------------------------------------
def linear_proba(i: Column | str) -> Column:
    return _c(i) / 255.0


def log_linear_proba(i: Column | str) -> Column:
    return safe_ln(linear_proba(i))


def log_linear_proba_reversed(i: Column | str) -> Column:
    return safe_ln(1 - linear_proba(i))


def phred_proba(i: Column | str) -> Column:
    """1 - 1.1^(-i / 10); bin 0 has probability 0."""
    return 1 - F.pow(F.lit(1.1), -_c(i) / 10.0)


def pack(molecule: Column | str, bin_: Column | str) -> Column:
    """Molecule index and likelihood bin in one integer; a null molecule is the unknown one."""
    return F.coalesce(_c(molecule).cast("long"), F.lit(UNKNOWN_MOLECULE)).bitwiseOR(F.shiftleft(_c(bin_).cast("long"), MOLECULE_BITS))


def unpack(packed: Column | str) -> tuple[Column, Column]:
    """(molecule or null, bin)."""
    ix = _c(packed).bitwiseAND(F.lit(UNKNOWN_MOLECULE).cast("long"))
    return F.when(ix != UNKNOWN_MOLECULE, ix), F.shiftright(_c(packed), MOLECULE_BITS).cast("int")


# -- text ---------------------------------------------------------------------------------------------------------------
def name_and_path(option: Column | str) -> tuple[Column, Column]:
    """The parts of ``name:path``."""
    return F.split(_c(option), ":", 2)[0], F.split(_c(option), ":", 2)[1]


def before_last_dot(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"^(.*)\.", 1)


#: Trees of the model, and the kinds of their parameters; a name is <tree>_<kind>, with _<leaf or node> behind the first
#: three kinds. Apart from them there are gamma_<tree> and epsilon.
TREES = ("species", "molecules")
KINDS = ("alpha", "log_nu", "branch_lengths", "mean_log_nu", "var_log_nu")
_OF_TREE = f"^(.+?)_(?:({'|'.join(KINDS[3:])})$|({'|'.join(KINDS[:3])})_)"


def parameter_class(name: Column | str) -> Column:
    """The kind of parameter that a name tells: one of KINDS, ``gamma``, ``epsilon`` or ``other``."""
    n = _c(name)
    kind = F.concat(F.regexp_extract(n, _OF_TREE, 2), F.regexp_extract(n, _OF_TREE, 3))
    whole = F.regexp_extract(n, "^(?:(gamma)_.*|(epsilon))$", 1)
    return F.coalesce(F.nullif(kind, F.lit("")), F.nullif(whole, F.lit("")), F.when(n == "epsilon", n), F.lit("other"))


def parameter_dimension(name: Column | str) -> Column:
    """The tree that a parameter's name tells, or ``other``."""
    known = "|".join(TREES)
    tree = F.concat(*(F.regexp_extract(_c(name), f"^(?:gamma_({known})$|({known})_)", k) for k in (1, 2)))
    return F.coalesce(F.nullif(tree, F.lit("")), F.lit("other"))


# -- randomness ----------------------------------------------------------------------------------------------------------
def uniform(*keys: Column | str | int, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the keys and the seed only, not on partitions or attempts."""
    cols = [F.lit(k) if isinstance(k, int) else _c(k) for k in keys]
    return (F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(2**53)).cast("double") + 0.5) / float(2**53)


def lattice(i: Column | str, j: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1) from integer arithmetic that any SQL engine has."""
    k = (_c(i).cast("long") * 7919 + _c(j).cast("long") * 104729 + F.lit(seed * 15485863)) % 1000003
    return (k + 0.5) / 1000003.0


def draw(log0: Column, log1: Column, u: Column) -> Column:
    """True with odds e^(log1 - log0)."""
    return u < 1 / (1 + F.exp(log0 - log1))


def accepted(log_ratio: Column, u: Column) -> Column:
    """A Metropolis-Hastings step is taken if u < min(1, e^ratio)."""
    return F.coalesce(F.ln(u) < log_ratio, F.lit(False))


def normal(*keys: Column | str | int, seed: int = 0) -> Column:
    """A standard normal number from two uniforms of the keys."""
    return F.sqrt(-2 * F.ln(uniform(*keys, seed=seed))) * F.cos(2 * math.pi * uniform(*keys, seed=seed + 104_729))


# -- priors ----------------------------------------------------------------------------------------------------------------
def ln_gamma_density(x: Column | str, shape: float, rate: float) -> Column:
    return F.when(_c(x) > 0, shape * math.log(rate) - math.lgamma(shape) + (shape - 1) * F.ln(_c(x)) - rate * _c(x)).otherwise(-LARGEST_DOUBLE)


def ln_beta_density(x: Column | str, a: float, b: float) -> Column:
    norm = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return F.when((_c(x) > 0) & (_c(x) < 1), norm + (a - 1) * F.ln(_c(x)) + (b - 1) * F.ln(1 - _c(x))).otherwise(-LARGEST_DOUBLE)


def ln_normal_density(x: Column | str, mean: float | Column, var: float | Column) -> Column:
    return -0.5 * F.ln(2 * math.pi * _c(var)) - F.pow(_c(x) - _c(mean), 2) / (2 * _c(var))


def ln_exponential_density(x: Column | str, rate: float) -> Column:
    return F.when(_c(x) >= 0, math.log(rate) - rate * _c(x)).otherwise(-LARGEST_DOUBLE)
