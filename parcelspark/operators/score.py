"""Marginal likelihood and posterior of particles (pairs of partitions), in batch over any number of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import cluster_stats, packed
from .panel import default_hyperparameters
from .weights import prior_py


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """unit_id, neighbours."""
    return edges.groupBy(F.col("src").alias("unit_id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def side_units(units: DataFrame, hyper: DataFrame) -> DataFrame:
    """run_id, side, unit_id, b, w, c1, c2: the sums of each unit for both sides (A levels, B slopes)."""
    rows = units.join(hyper, "run_id")
    sides = F.array(
        F.struct(F.lit("A").alias("side"), F.col("sum_y").alias("b"), F.col("periods").cast("double").alias("w"), F.col("a1").alias("c1"), F.col("a2").alias("c2")),
        F.struct(F.lit("B").alias("side"), F.col("sum_xy").alias("b"), F.col("sum_xx").alias("w"), F.col("b1").alias("c1"), F.col("b2").alias("c2")),
    )
    return rows.select("run_id", "unit_id", F.explode(sides).alias("s")).select("run_id", "unit_id", "s.*")


def totals(units: DataFrame, hyper: DataFrame) -> DataFrame:
    """run_id, yy (sum of squares of y), obs, alpha_sigma, beta_sigma."""
    return units.groupBy("run_id").agg(F.sum("sum_yy").alias("yy"), F.sum("periods").alias("obs")).join(hyper.select("run_id", "alpha_sigma", "beta_sigma"), "run_id")


def log_likelihood(quad, log_det, yy, alpha_sigma, beta_sigma, obs):
    """½ Σ logdet - (as + N/2) ln(bs + Q/2) + as ln bs, Q = Σy² + Σ quad. The terms in ln Γ are the same for all particles of a run and are left out."""
    return log_det / 2 - (alpha_sigma + obs / 2) * F.ln(beta_sigma + (yy + quad) / 2) + alpha_sigma * F.ln(beta_sigma)


def scored_clusters(assignment: DataFrame, units: DataFrame, edges: DataFrame, hyper: DataFrame, keys: list[str], rho: float = 0.9) -> DataFrame:
    """cluster_stats of every cluster of an assignment with keys (run_id, side among them)."""
    return cluster_stats(packed(assignment, side_units(units, hyper), neighbour_lists(edges), keys), keys, rho)


def scored_particles(assignment: DataFrame, units: DataFrame, edges: DataFrame, hyper: DataFrame | None = None, rho: float = 0.9, eta: float = 1.0) -> DataFrame:
    """run_id, particle_id, log_like, log_prior, log_post of every particle.

    assignment: run_id, particle_id, side (A, B), unit_id, cluster_id. Needs centred x (unit_ols
    centres it). A run with an unusable hyperparameter has nulls.
    """
    hyper = default_hyperparameters(units, rho) if hyper is None else hyper
    keys = ["run_id", "particle_id", "side"]
    stats = scored_clusters(assignment, units, edges, hyper, keys, rho)
    whole = F.count("quad") == F.count(F.lit(1))
    sums = stats.groupBy("run_id", "particle_id").agg(F.when(whole, F.sum("quad")).alias("quad"), F.when(whole, F.sum("log_det")).alias("log_det"))
    prior = prior_py(assignment, keys, eta).groupBy("run_id", "particle_id").agg(F.sum("log_prior").alias("log_prior"))
    rows = sums.join(totals(units, hyper), "run_id").join(prior, ["run_id", "particle_id"])
    like = log_likelihood(*[F.col(c) for c in ("quad", "log_det", "yy", "alpha_sigma", "beta_sigma", "obs")])
    return rows.select("run_id", "particle_id", like.alias("log_like"), "log_prior", (like + F.col("log_prior")).alias("log_post"))


def posterior_means(stats: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cluster_id, unit_id, mean: the posterior mean of every unit given the partition."""
    cells = F.explode(F.arrays_zip("units", "means")).alias("m")
    return stats.where(F.col("means").isNotNull()).select(*keys, "cluster_id", cells).select(*keys, "cluster_id", F.col("m.units").alias("unit_id"), F.col("m.means").alias("mean"))
