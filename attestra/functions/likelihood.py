"""Column expressions for likelihood ratios: natural logs inside, log10 at the edge, absent values stay null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN10 = math.log(10)
#: Upper ends of |log10 LR| for the verbal bands, in order, and the open last band.
BANDS = ((0.3, "no_support"), (1.0, "weak"), (2.0, "moderate"), (3.0, "moderately_strong"), (4.0, "strong"), (6.0, "very_strong"))
LAST_BAND = "extremely_strong"


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def logistic(x: Column) -> Column:
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def log_logistic(x: Column) -> Column:
    return -softplus(-x)


def band(log10_lr: Column) -> Column:
    size = F.abs(log10_lr)
    out = None
    for top, name in BANDS:
        out = F.when(size < top, name) if out is None else out.when(size < top, name)
    return F.when(log10_lr.isNull(), None).otherwise(out.otherwise(LAST_BAND))


def clipped(x: Column, lower: Column | float, upper: Column | float) -> Column:
    lower, upper = (v if isinstance(v, Column) else F.lit(v) for v in (lower, upper))
    return F.when(x.isNotNull(), F.least(F.greatest(x, lower), upper))


def uniform_prior(n: Column) -> Column:
    """Log odds that one of the n - 1 others is the source."""
    return F.when(n >= 2, -F.log(n - 1))


def _prior(log_odds: Column, basis: str, mode: str, justification: Column, supplied_by: Column) -> Column:
    """struct<log_odds, basis, search_mode, justification, supplied_by>; null where the odds, the reason or the name is missing."""
    said = F.coalesce(F.trim(justification) != "", F.lit(False)) & F.coalesce(supplied_by != "system", F.lit(False))  # such a prior is a judgement of a person
    return F.when(log_odds.isNotNull() & said, F.struct(log_odds.alias("log_odds"), F.lit(basis).alias("basis"), F.lit(mode).alias("search_mode"), justification.alias("justification"), supplied_by.alias("supplied_by")))


def restricted_prior(n: Column, justification: Column, supplied_by: Column) -> Column:
    """That one of the others in a population of n that an investigator narrowed is the source; n is at least 2."""
    return _prior(F.when(n >= 2, -F.log(n - 1)), "restricted_population", "database_search", justification, supplied_by)


def circumstances_prior(odds: Column, justification: Column, supplied_by: Column) -> Column:
    """Positive odds that an investigator states for a verification; a search over a database takes none."""
    return _prior(F.when(odds > 0, F.log(odds)), "case_circumstances", "verification", justification, supplied_by)


def cost(score: Column, label: Column) -> Column:
    """What a trial adds to C_llr, in bits."""
    return F.when(label == 1, softplus(-score)).otherwise(softplus(score)) / math.log(2)


def lgamma(x: Column) -> Column:
    """ln Gamma for positive x: Stirling's series seven steps up, then back down by the recurrence."""
    z = x + 7
    r = 1 / (z * z)
    series = (1 / z) * (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188))))
    product = x
    for k in range(1, 7):
        product = product * (x + k)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


#: Fixed values of the published algorithm AS 241 for the normal quantile: numerator and denominator (from the constant
#: term on) about the middle, in the tails, and far out.
QUANTILE_MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
QUANTILE_TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
QUANTILE_FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of a probability strictly between 0 and 1."""

    def ratio(x: Column, both: tuple) -> Column:
        up, down = (F.lit(c[-1]) for c in both)
        for k in range(6, -1, -1):
            up, down = up * x + both[0][k], down * x + both[1][k]
        return up / down

    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(r <= 5, ratio(r - 1.6, QUANTILE_TAIL)).otherwise(ratio(r - 5, QUANTILE_FAR))
    return F.when(F.abs(q) <= 0.425, q * ratio(0.180625 - q * q, QUANTILE_MIDDLE)).otherwise(F.signum(q) * tail)


def rising(a: Column, n: Column) -> Column:
    """ln Gamma(a + n) - ln Gamma(a)."""
    return F.when(n == 0, F.lit(0.0)).otherwise(lgamma(a + n) - lgamma(a))


def normal_marginal(n: Column, mean: Column, m2: Column, prior: dict[str, Column]) -> Column:
    """Log marginal of n observations (mean, sum of squares about it) under a normal-inverse-gamma prior."""
    k = prior["precision"] + n
    shape = prior["shape"] + n / 2
    scale = prior["scale"] + 0.5 * m2 + prior["precision"] * n * (mean - prior["mean"]) ** 2 / (2 * k)
    return (
        -0.5 * n * math.log(math.pi)
        + 0.5 * (F.log(prior["precision"]) - F.log(k))
        + lgamma(shape)
        - lgamma(prior["shape"])
        + prior["shape"] * F.log(prior["scale"])
        - shape * F.log(scale)
    )


def merged_moments(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Moments of two samples together, without reading either again."""
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n


def plda(a: Column, b: Column, psi: Column) -> Column:
    """Closed-form log LR of two vectors in the space where within is 1 and between is psi, per dimension and summed."""
    terms = F.zip_with(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), psi, lambda v, p: F.struct(v["x"].alias("x"), v["y"].alias("y"), p.alias("p")))

    def one(t: Column) -> Column:
        x, y, p = t["x"], t["y"], t["p"]
        det = 2 * p + 1
        same = ((p + 1) * (x * x + y * y) - 2 * p * x * y) / det
        apart = (x * x + y * y) / (p + 1)
        return 0.5 * (2 * F.log(p + 1) - F.log(det)) - 0.5 * same + 0.5 * apart

    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + one(t))


def plda_sides(unit: Column, psi: list[float]) -> tuple[Column, Column]:
    """Two vectors of a recording: the dot product of one's first and another's second is their ``plda``.

    The log LR is bilinear beside squares of either side, which stand in two further components.
    """
    p = F.array(*[F.lit(float(x)) for x in psi])
    own = F.aggregate(F.zip_with(unit, p, lambda x, v: x * x * (0.5 / (v + 1) - 0.5 * (v + 1) / (2 * v + 1))), F.lit(0.0), lambda s, t: s + t)
    fixed = sum(math.log(x + 1) - 0.5 * math.log(2 * x + 1) for x in map(float, psi))
    cross = F.zip_with(unit, p, lambda x, v: x * v / (2 * v + 1))
    whole = F.size(unit) == len(psi)
    return F.when(whole, F.concat(cross, F.array(own + fixed, F.lit(1.0)))), F.when(whole, F.concat(unit, F.array(F.lit(1.0), own)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def pair_side(a: Column, b: Column) -> Column:
    """0 or 1: which of the two ids, in order, the pair is attributed to."""
    return F.conv(F.substring(F.sha2(pair_key(a, b), 256), 2, 1), 16, 10).cast("int") % 2


def hashed_normal(*parts: Column | str) -> Column:
    """A standard normal number from a hash of the parts: the same in any engine and any order of rows."""
    return normal_of(digest_of(*parts))


def digest_of(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]), 256)


def normal_of(digest: Column) -> Column:
    first, second = ((F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 0.5) / 2.0**32 for at in (1, 9))
    return F.sqrt(-2 * F.log(first)) * F.cos(2 * math.pi * second)
