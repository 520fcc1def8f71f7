"""Pair scoring: a stated probe set against a whole population.

Profiles are one row an entity (counts in a map, moments beside it). Probes go to the population's partitions if their
number is within bounds, so a pair is scored where the population row lies and nothing else is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.likelihood import LN10, band, lgamma, merged_moments, normal_marginal, rising
from ..sources.tables import small, stored
from .profiles import UNSEEN_MASS

#: A probe is an entity whose id this number divides.
PROBE_EVERY = 50


def is_probe(entity: Column) -> Column:
    return entity % PROBE_EVERY == 0


def weighted(counted: DataFrame, frequencies: DataFrame, concentration: float) -> DataFrame:
    """entity, category, n, alpha: categories unknown to the background share a bucket, named by the empty string."""
    unseen = max(concentration * UNSEEN_MASS, 1e-6)
    known = counted.join(frequencies.select("category", "frequency"), "category", "left")
    known = known.select("entity", F.when(F.col("frequency").isNull(), "").otherwise(F.col("category")).alias("category"), "n", F.coalesce(F.col("frequency") * concentration, F.lit(unseen)).alias("alpha"))
    return known.groupBy("entity", "category").agg(F.sum("n").alias("n"), F.first("alpha").alias("alpha"))


def with_weights(counted: DataFrame, frequencies: DataFrame, concentration: float, name: str) -> DataFrame:
    """entity, name: map category -> (n, alpha, start, own), name_n: the total, name_own.

    start is ln Gamma(alpha) and own the entity's own share of the log LR, so that a pair needs one ln Gamma for a
    shared category. Categories unknown to the background share a bucket.
    """
    known = weighted(counted, frequencies, concentration)
    known = known.withColumn("start", lgamma(F.col("alpha"))).withColumn("own", lgamma(F.col("alpha") + F.col("n")) - F.col("start"))
    entry = F.struct("category", F.struct("n", "alpha", "start", "own"))
    out = known.groupBy("entity").agg(F.map_from_entries(F.collect_list(entry)).alias(name), F.sum("n").alias(f"{name}_n"))
    return out.withColumn(f"{name}_own", rising(F.lit(_mass(concentration)), F.col(f"{name}_n")))


def _mass(concentration: float) -> float:
    return concentration + max(concentration * UNSEEN_MASS, 1e-6)


def multinomial(name: str, concentration: float) -> Column:
    """Dirichlet-multinomial log LR of p's and q's counts: only shared categories and the totals count."""
    mp, mq, np_, nq, rp, rq = (F.col(f"{s}.{name}{c}") for c in ("", "_n", "_own") for s in ("p", "q"))
    # look each category up once, then sum over the found entries
    shared = F.transform(F.array_intersect(F.map_keys(mp), F.map_keys(mq)), lambda k: F.struct(mp[k].alias("x"), mq[k]["n"].alias("n"), mq[k]["own"].alias("own")))
    shared = F.transform(shared, lambda t: F.struct((t["x"]["alpha"] + t["x"]["n"] + t["n"]).alias("end"), (t["x"]["start"] + t["x"]["own"] + t["own"]).alias("less")))
    gain = lambda s, t: s + lgamma(t["end"]) - t["less"]
    total = F.aggregate(shared, F.lit(0.0), gain) - rising(F.lit(_mass(concentration)), np_ + nq) + rp + rq
    return F.when(mp.isNotNull() & mq.isNotNull(), total)


def with_marginals(moments: DataFrame, prior: DataFrame, prefix: str) -> DataFrame:
    """Moments (n, mean, m2) under a prefix, with the entity's own log marginal under a one-row prior."""
    names = ("mean", "precision", "shape", "scale")
    rows = moments.crossJoin(F.broadcast(prior.select(*[F.col(c).alias(f"_{c}") for c in names])))
    own = normal_marginal(F.col("n"), F.col("mean"), F.col("m2"), {c: F.col(f"_{c}") for c in names})
    return rows.select("entity", *[F.col(c).alias(f"{prefix}_{c}") for c in ("n", "mean", "m2")], own.alias(f"{prefix}_own"), F.struct(*[F.col(f"_{c}").alias(c) for c in names]).alias(f"{prefix}_prior"))


def normal(prefix: str) -> Column:
    """Normal-inverse-gamma log LR from p's and q's rows of moments."""
    x, y = (tuple(F.col(f"{s}.{prefix}_{c}") for c in ("n", "mean", "m2")) for s in ("p", "q"))
    prior = {c: F.col(f"p.{prefix}_prior.{c}") for c in ("mean", "precision", "shape", "scale")}
    return normal_marginal(*merged_moments(x, y), prior) - F.col(f"p.{prefix}_own") - F.col(f"q.{prefix}_own")


def probe_pairs(profiles: DataFrame) -> DataFrame:
    """Every probe with every other entity; a pair of two probes once. Columns p and q hold the profiles.

    Profiles are written once: the probe side, its size check and the population all read them.
    """
    profiles = stored(profiles, "profiles").repartition("entity")
    whole = F.struct(*profiles.columns)
    probes = profiles.where(is_probe(F.col("entity"))).select(whole.alias("p"))
    other = profiles.select(whole.alias("q"))
    once = (F.col("p.entity") != F.col("q.entity")) & (~is_probe(F.col("q.entity")) | (F.col("p.entity") < F.col("q.entity")))
    return other.join(small(probes, 20_000), once)


def shared(counted: DataFrame, frequencies: DataFrame) -> DataFrame:
    """a, b, n, rarest of pairs (a a probe) with a category in common: how many, and the reported frequency of the rarest.

    Probes' categories go to the population's if their number is within bounds, so that a pair is counted where the
    population's rows lie before anything is shuffled.
    """
    rare = counted.select("entity", "category").join(small(frequencies.select("category", "reported_frequency")), "category")
    rows = stored(rare, "categories").repartition("entity")
    probes = rows.where(is_probe(F.col("entity"))).select(F.col("entity").alias("a"), "category")
    b = F.col("entity")
    pairs_ = rows.join(small(probes), "category").where((F.col("a") != b) & (~is_probe(b) | (F.col("a") < b)))
    return pairs_.groupBy("a", b.alias("b")).agg(F.count("*").alias("n"), F.min("reported_frequency").alias("rarest"))


def sides() -> tuple[Column, Column]:
    """The ids of a scored pair as columns a and b."""
    return F.col("p.entity").alias("a"), F.col("q.entity").alias("b")


def searched(scored: DataFrame, n: int, prior_log_odds: float) -> DataFrame:
    """The n best candidates by posterior; equal posteriors in id order."""
    posterior = F.col("log_lr") + prior_log_odds
    rows = scored.where("log_lr is not null").select("candidate", "log_lr", posterior.alias("posterior_log_odds"), band(F.col("log_lr") / LN10).alias("strength"), ((F.col("log_lr") > 0) & (posterior < 0)).alias("prior_dominates"))
    return rows.orderBy(F.desc("posterior_log_odds"), "candidate").limit(n)
