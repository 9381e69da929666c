"""Priors of partitions, and weights of an ensemble of particles (pairs of partitions)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ln_gamma, ln_gamma_int
from .graph import clustered_edges
from .partitions import cluster_sizes


def _rising(start: float, steps: Column, by: float = 1.0) -> Column:
    """Σ ln(start + i · by) for i in 0..steps-1; start above 0."""
    if by == 0:
        return steps * math.log(start)
    return steps * math.log(by) + ln_gamma(steps + start / by) - math.lgamma(start / by)


def prior_py(assignment: DataFrame, keys: list[str], eta: float = 1.0, sigma: float = 0.0) -> DataFrame:
    """Log prior of the Pitman-Yor form: Σ_k [ln Γ(n_k - σ) - ln Γ(1 - σ)] + Σ_{k<K} ln(η + kσ) - Σ_{i<n} ln(η + i).

    sigma = 0 is the Ewens form.
    """
    sizes = cluster_sizes(assignment, keys)
    term = F.when(F.col("n") > 1, ln_gamma(F.col("n") - sigma) - math.lgamma(1 - sigma)).otherwise(0.0)
    sums = sizes.groupBy(*keys).agg(F.sum(term).alias("inner"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    return sums.select(*keys, (F.col("inner") + _rising(eta, F.col("k"), sigma) - _rising(eta, F.col("n"))).alias("log_prior"))


def prior_areal(edges: DataFrame, assignment: DataFrame, keys: list[str], a: int = 200, b: int = 10, eta: float = 1.0) -> DataFrame:
    """K ln η + Σ_k [ln Γ(n_k) + ln C(E, e_k) + ln B(e_k + a, E - e_k + b) - ln B(a, b)], e_k the edges within a cluster, E all edges."""
    total = edges.count() // 2
    inner = clustered_edges(edges, assignment, keys).where(F.col("c_src") == F.col("c_dst")).groupBy(*keys, F.col("c_src").alias("cluster_id")).agg(F.expr("count(*) div 2").alias("e"))
    rows = cluster_sizes(assignment, keys).join(inner, [*keys, "cluster_id"], "left").withColumn("e", F.coalesce("e", F.lit(0)))
    lg, e = ln_gamma_int, F.col("e")
    rest = F.lit(total) - e
    beta0 = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    term = F.lit(math.log(eta)) + lg(F.col("n")) + F.lit(math.lgamma(total + 1)) - lg(e + 1) - lg(rest + 1) + lg(e + a) + lg(rest + b) - F.lit(math.lgamma(total + a + b)) - F.lit(beta0)
    return rows.groupBy(*keys).agg(F.sum(term).alias("log_prior"))


def prior_edges(edges: DataFrame, assignment: DataFrame, keys: list[str], eta: float = 1.0) -> DataFrame:
    """Σ_k [ln η + ln Γ(n_k) + 2 · edges within the cluster]."""
    inner = clustered_edges(edges, assignment, keys).where(F.col("c_src") == F.col("c_dst")).groupBy(*keys, F.col("c_src").alias("cluster_id")).agg(F.count(F.lit(1)).alias("e"))
    rows = cluster_sizes(assignment, keys).join(inner, [*keys, "cluster_id"], "left")
    return rows.groupBy(*keys).agg(F.sum(F.lit(math.log(eta)) + ln_gamma_int(F.col("n")) + F.coalesce("e", F.lit(0))).alias("log_prior"))


def prior_uniform(assignment: DataFrame, keys: list[str]) -> DataFrame:
    """0 for every partition."""
    return assignment.select(*keys).distinct().withColumn("log_prior", F.lit(0.0))


def tempered_weights(particles: DataFrame, temper: float = 10.0) -> DataFrame:
    """w of each particle: exp((LP - max LP)/λ) normalised over the distinct particles of a run; equal particles share it.

    particles: run_id, particle_id, signature, log_post. Particles with a null log_post get weight 0.
    """
    run = Window.partitionBy("run_id")
    same = Window.partitionBy("run_id", "signature")
    p = F.exp((F.col("log_post") - F.max("log_post").over(run)) / temper)
    rows = particles.withColumn("_p", F.coalesce(p, F.lit(0.0))).withColumn("_copies", F.count(F.lit(1)).over(same))
    share = F.col("_p") / F.col("_copies")
    return rows.withColumn("w", share / F.nullif(F.sum(share).over(run), F.lit(0.0))).drop("_p", "_copies")


def unique_particles(weighted: DataFrame) -> DataFrame:
    """Distinct particles with their pooled weight, number of copies and least particle_id."""
    return weighted.groupBy("run_id", "signature").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("copies"), F.min("particle_id").alias("particle_id"), F.max("log_post").alias("log_post"))


def weight_entropy(weighted: DataFrame) -> DataFrame:
    """-Σ p ln p over the distinct particles of each run; weights of 0 add nothing."""
    p = F.col("w")
    return unique_particles(weighted).groupBy("run_id").agg((-F.sum(F.when(p > 0, p * F.ln(p)).otherwise(0.0))).alias("entropy"))


def model_average(weighted: DataFrame, estimates: DataFrame, value: str) -> DataFrame:
    """Σ w · value of each unit."""
    return weighted.select("run_id", "particle_id", "w").join(estimates, ["run_id", "particle_id"]).groupBy("run_id", "unit_id").agg(F.sum(F.col("w") * F.col(value)).alias(value))


def progressive_average(weighted: DataFrame, estimates: DataFrame, value: str) -> DataFrame:
    """The average over the 1, 2, ... heaviest particles, weights made to sum to 1; of equal weights the least particle_id first."""
    rows = weighted.select("run_id", "particle_id", "w").join(estimates, ["run_id", "particle_id"])
    w = Window.partitionBy("run_id", "unit_id").orderBy(F.desc("w"), "particle_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("run_id", "unit_id", F.row_number().over(Window.partitionBy("run_id", "unit_id").orderBy(F.desc("w"), "particle_id")).alias("top"), (F.sum(F.col("w") * F.col(value)).over(w) / F.nullif(F.sum("w").over(w), F.lit(0.0))).alias(value))


def top_particles(weighted: DataFrame, k: int = 1) -> DataFrame:
    """The k distinct particles of greatest log_post of each run; of equals the least particle_id first."""
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("log_post"), "particle_id"))
    return unique_particles(weighted).withColumn("rank", rank).where(F.col("rank") <= k)


def drawn_particle(weighted: DataFrame, u: float) -> DataFrame:
    """The particle that the uniform number u falls on: the first whose cumulative weight, by particle_id, exceeds it."""
    run = Window.partitionBy("run_id").orderBy("particle_id").rowsBetween(Window.unboundedPreceding, 0)
    return weighted.withColumn("cdf", F.sum("w").over(run)).where(F.col("cdf") > u).groupBy("run_id").agg(F.min("particle_id").alias("particle_id"))
