"""Queries that fit or compare over the panels. SQL cannot express most; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, graph, joint, mean_only, panel, partitions, parts, score
from ..session import written
from .panel_queries import SIDE, _asg, _classes, _edges, _needed, _panel, _units, _values
from .search import Fit, Problem, drawn_starts, ensemble_fit, map_fit, start_grid, tuned


def _problem(spark, sf_dir, **options):
    return Problem.of(_panel(spark, sf_dir), _edges(spark, sf_dir), **options)


def _start(spark, sf_dir):
    """All particles, their clusters made connected."""
    return partitions.relabelled(graph.connected_clusters(_edges(spark, sf_dir), _asg(spark, sf_dir), SIDE), SIDE)


_fits: dict[tuple, Fit] = {}


def _fitted(spark, sf_dir, kind, make) -> Fit:
    """A fit over a folder of tables, made once an application for the queries that look at it."""
    at = (spark.sparkContext.applicationId, sf_dir, kind)
    if at not in _fits:
        _fits[at] = make(_problem(spark, sf_dir))
    return _fits[at]


def map_search(spark, sf_dir):
    """The best pair that the moves reach from a drawn start: cluster and means of every unit."""
    fit = _fitted(spark, sf_dir, "map", map_fit)
    return fit.assignment.join(fit.estimates, [*SIDE, "unit_id"])


def ensemble_start(spark, sf_dir):
    """The k-means starts of every pair of numbers of classes, with the chance of each."""
    return start_grid(_problem(spark, sf_dir))[1]


def ensemble_search(spark, sf_dir):
    """Particles of an ensemble of ten, with their weights: drawn starts, all families, sweeps until nothing changes, then every unit as an island."""
    return _fitted(spark, sf_dir, "ensemble", ensemble_fit).particles


def ensemble_faults(spark, sf_dir):
    """Of each run's ensemble: particles, sum of their weights, units left out or held twice, clusters that are not connected, particles whose score is not that of their partitions."""
    fit, units, edges = _fitted(spark, sf_dir, "ensemble", ensemble_fit), _units(spark, sf_dir), _edges(spark, sf_dir)
    labels = written(fit.assignment, "labels")
    count = lambda df, c: df.groupBy("run_id").agg(F.count(F.lit(1)).alias(c))
    scored = score.scored_particles(labels, units, edges).join(fit.particles.select("run_id", "particle_id", F.col("log_post").alias("held")), ["run_id", "particle_id"])
    pieces = count(graph.connected_clusters(edges, labels, SIDE).select(*SIDE, "cluster_id").distinct(), "pieces").join(count(labels.select(*SIDE, "cluster_id").distinct(), "clusters"), "run_id")
    out = fit.particles.groupBy("run_id").agg(F.count(F.lit(1)).alias("particles"), F.round(F.sum("w"), 6).alias("w"))
    for more in (count(mean_only.uncovered(labels, units, SIDE), "uncovered"), pieces.select("run_id", (F.col("pieces") - F.col("clusters")).alias("parted")), count(scored.where(F.abs(F.col("log_post") - F.col("held")) > 1e-6), "misjudged")):
        out = out.join(more, "run_id", "left")
    return out.na.fill(0, ["uncovered", "parted", "misjudged"])


def equal_sides_search(spark, sf_dir):
    """The best partition that serves levels and slopes alike, from the common refinement of a start for both."""
    own = drawn_starts(_problem(spark, sf_dir), 1)
    a, b = (own.where(F.col("side") == s).drop("side") for s in "AB")
    start = partitions.meet(a, b, ["run_id", "particle_id"]).withColumn("side", F.lit("A"))
    return map_fit(_problem(spark, sf_dir, equal=True), start).assignment


def levels_search(spark, sf_dir):
    """Particles of an ensemble of the model with levels alone; every unit is tried as an island where nothing else is better."""
    from .mean_queries import _hyper

    return ensemble_fit(Problem.of_levels(_panel(spark, sf_dir), _edges(spark, sf_dir), _hyper(spark, sf_dir))).particles


def posterior_estimates(spark, sf_dir):
    """Posterior means of every unit's level and slope in every particle."""
    units, edges = _units(spark, sf_dir), _edges(spark, sf_dir)
    stats = score.scored_clusters(_start(spark, sf_dir), units, edges, panel.default_hyperparameters(units), SIDE)
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("mean")))
    return score.posterior_means(stats, SIDE).groupBy("run_id", "particle_id", "unit_id").agg(pick("A").alias("alpha"), pick("B").alias("beta"))


def hyperparam_tuning(spark, sf_dir):
    """Hyperparameters where the likelihood of the best pair found by map_fit is greatest."""
    return tuned(_problem(spark, sf_dir), _fitted(spark, sf_dir, "map", map_fit).assignment)


def _packed(spark, sf_dir, rows):
    return joint.packed_particles(_asg(spark, sf_dir), rows, score.neighbour_lists(_edges(spark, sf_dir)), panel.default_hyperparameters(_units(spark, sf_dir)))


def exact_score(spark, sf_dir):
    """Likelihood of every particle on the panel as recorded."""
    return joint.exact_likelihood(_packed(spark, sf_dir, _panel(spark, sf_dir)))


def poisson_score(spark, sf_dir):
    """Laplace evidence of every particle on counts made from the panel."""
    return joint.poisson_laplace(_packed(spark, sf_dir, joint.counts(_panel(spark, sf_dir))))


def joint_score(spark, sf_dir):
    """Density of the data with the posterior means, of every particle."""
    return joint.joint_likelihood(_packed(spark, sf_dir, _panel(spark, sf_dir)))


def joint_estimates(spark, sf_dir):
    """Posterior means of levels and slopes at once, on the panel as recorded."""
    return joint.joint_means(_packed(spark, sf_dir, _panel(spark, sf_dir)))


def ascent_estimates(spark, sf_dir):
    """Levels and slopes after two sweeps of coordinate ascent."""
    return joint.ascent_means(_packed(spark, sf_dir, _panel(spark, sf_dir)))


def kmeans_path(spark, sf_dir):
    """Best classes of levels and slopes, 1 to 5 of them."""
    return compare.kmeans_path(_values(spark, sf_dir), ["run_id", "side"])


def spectral_split(spark, sf_dir):
    """Spectral cut of every cluster in two."""
    rows = _classes(_units(spark, sf_dir)).join(score.neighbour_lists(_edges(spark, sf_dir)), "unit_id", "left")
    member = F.struct(F.col("unit_id").cast("int").alias("unit_id"), "value", "neighbours")
    packed = rows.groupBy(*SIDE, "cluster_id").agg(F.array_sort(F.collect_list(member), lambda p, q: p["unit_id"] - q["unit_id"]).alias("members"))
    return compare.spectral_parts(packed, SIDE)


def silhouette(spark, sf_dir):
    """Mean silhouette of every partition."""
    return compare.silhouettes(_asg(spark, sf_dir), _values(spark, sf_dir), SIDE).withColumn("silhouette", F.round("silhouette", 6))


def comparator_scores(spark, sf_dir):
    """Scores of the k-means (up to 5) and the spectral classes (up to 10) of greatest silhouette, cut into connected clusters, of one cluster and of singletons."""
    keys, edges, values = ["run_id", "side"], _edges(spark, sf_dir), written(_values(spark, sf_dir), "values")
    whole = values.select(*keys, F.lit(1).alias("k"), "unit_id", F.lit(1).alias("cluster_id"))
    cuts = compare.spectral_path(parts.packed_values(whole, values, score.neighbour_lists(edges), keys), keys, lambda n: range(2, 11))
    spectral = whole.unionByName(cuts.select(*keys, "k", "unit_id", F.col("part").alias("cluster_id")))
    paths = compare.kmeans_path(values, keys).withColumn("particle_id", F.lit(1)).unionByName(spectral.withColumn("particle_id", F.lit(2)))
    picked = compare.chosen_classes(written(paths, "paths"), values, SIDE).drop("k")
    connected = graph.connected_clusters(edges, written(picked, "picked"), SIDE).select(*SIDE, "unit_id", F.col("cluster_id").cast("int").alias("cluster_id"))
    one = whole.select("run_id", F.lit(3).alias("particle_id"), "side", "unit_id", "cluster_id")
    alone = one.withColumns({"particle_id": F.lit(4), "cluster_id": F.col("unit_id").cast("int")})
    method = F.element_at(F.array(*map(F.lit, ("kmeans", "spectral", "one cluster", "singletons"))), F.col("particle_id")).alias("method")
    scored = score.scored_particles(connected.unionByName(one).unionByName(alone), _units(spark, sf_dir), edges)
    return scored.select("run_id", method, "log_like", "log_prior", "log_post")


QUERIES = {f.__name__: f for f in (map_search, ensemble_start, ensemble_search, ensemble_faults, equal_sides_search, levels_search, posterior_estimates, hyperparam_tuning, exact_score, poisson_score, joint_score, joint_estimates, ascent_estimates, kmeans_path, spectral_split, silhouette, comparator_scores)}
_PAIRS = "SELECT a.run_id, a.particle_id, a.side, a.unit_id, a.cluster_id AS own, b.cluster_id AS other, sum(abs(a.value - b.value)) AS d, count(*) AS n FROM class a JOIN class b ON (a.run_id, a.particle_id, a.side) = (b.run_id, b.particle_id, b.side) GROUP BY ALL"
_SILHOUETTE = f"SELECT run_id, particle_id, side, round(avg(CASE WHEN b IS NULL THEN NULL WHEN size = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 6) AS silhouette FROM (SELECT run_id, particle_id, side, unit_id, max(d / nullif(n - 1, 0)) FILTER (own = other) AS a, min(d / n) FILTER (own <> other) AS b, max(n) FILTER (own = other) AS size FROM ({_PAIRS}) GROUP BY ALL) GROUP BY ALL"
SQL = {"ensemble_faults": "SELECT DISTINCT run_id, 10::BIGINT AS particles, 1.0::DOUBLE AS w, 0::BIGINT AS uncovered, 0::BIGINT AS parted, 0::BIGINT AS misjudged FROM panel", "silhouette": "WITH " + ", ".join(_needed(_SILHOUETTE)) + " " + _SILHOUETTE}
