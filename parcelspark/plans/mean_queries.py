"""Queries of the model with levels alone, of equal sides, and of checks on partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, mean_only, panel, parts, score
from ..session import written
from .panel_queries import SIDE, _asg, _edges, _needed, _panel, _units, _values


def _hyper(spark, sf_dir):
    h = panel.default_hyperparameters(_units(spark, sf_dir))
    return h.select("run_id", "a1", "a2", (2 * F.col("alpha_sigma")).alias("nu"), (F.col("beta_sigma") / F.col("alpha_sigma")).alias("lambda"))


def mean_only_score(spark, sf_dir):
    """Score of side A's partitions in the model with levels alone."""
    return mean_only.mean_only_scores(_asg(spark, sf_dir), _panel(spark, sf_dir), _edges(spark, sf_dir), _hyper(spark, sf_dir))


def equal_sides_score(spark, sf_dir):
    """Score of every particle with side A's partition on both sides."""
    return score.scored_particles(mean_only.equal_sides(_asg(spark, sf_dir)), _units(spark, sf_dir), _edges(spark, sf_dir))


def mean_only_candidates(spark, sf_dir):
    """Units by candidate of the moves of that model."""
    asg = written(_asg(spark, sf_dir), "assignment")
    return mean_only.candidates(_edges(spark, sf_dir), asg, _values(spark, sf_dir), SIDE).groupBy(*SIDE, "cand").agg(F.count(F.lit(1)).alias("units"), F.count_distinct("cluster_id").alias("clusters"))


def mean_only_local_candidates(spark, sf_dir):
    """Units and clusters by candidate when every unit is tried as an island in that model."""
    asg = written(_asg(spark, sf_dir), "assignment")
    return mean_only.local_candidates(_edges(spark, sf_dir), asg, _values(spark, sf_dir), SIDE).groupBy(*SIDE, "cand").agg(F.count(F.lit(1)).alias("units"), F.count_distinct("cluster_id").alias("clusters"))


def split_merge_candidates(spark, sf_dir):
    """Units and clusters by candidate of the cuts of that model, with the merges that follow a cut."""
    asg = written(graph.connected_clusters(_edges(spark, sf_dir), _asg(spark, sf_dir), SIDE), "assignment")
    return mean_only.split_candidates(_edges(spark, sf_dir), asg, _values(spark, sf_dir), SIDE).groupBy(*SIDE, "cand").agg(F.count(F.lit(1)).alias("units"), F.count_distinct("cluster_id").alias("clusters"))


def class_path_scores(spark, sf_dir):
    """Scores of the best classes of the units' means, 1 to 5, raw and connected."""
    return mean_only.class_paths(_panel(spark, sf_dir), _edges(spark, sf_dir), _hyper(spark, sf_dir))


def both_tails(spark, sf_dir):
    """Units in the low, the high and both tails of every cluster."""
    return parts.both_tails(_asg(spark, sf_dir), _values(spark, sf_dir), SIDE)


def far_units(spark, sf_dir):
    """Units farthest from their cluster's mean."""
    return mean_only.far_units(_asg(spark, sf_dir), _values(spark, sf_dir), SIDE)


def nearest_merges(spark, sf_dir):
    """Units of each cluster with its nearest adjacent cluster of a greater label."""
    return mean_only.nearest_merges(_edges(spark, sf_dir), _asg(spark, sf_dir), _values(spark, sf_dir), SIDE).groupBy(*SIDE, "cand").agg(F.count(F.lit(1)).alias("units"))


def cover_faults(spark, sf_dir):
    """Faults of the partitions when the run's first unit is taken from particle 1 and given twice to particle 2."""
    asg = _asg(spark, sf_dir)
    broken = asg.where("particle_id > 1 OR unit_id > 1").unionByName(asg.where("particle_id = 2 AND unit_id = 1"))
    return mean_only.uncovered(broken, _units(spark, sf_dir), SIDE)


QUERIES = {f.__name__: f for f in (mean_only_score, equal_sides_score, mean_only_candidates, mean_only_local_candidates, split_merge_candidates, class_path_scores, both_tails, far_units, nearest_merges, cover_faults)}

_FAR = "SELECT run_id, particle_id, side, unit_id, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, particle_id, side, cluster_id ORDER BY off DESC, unit_id) AS r FROM (SELECT *, abs(value - avg(value) OVER w) AS off, count(*) OVER w AS n FROM class WINDOW w AS (PARTITION BY run_id, particle_id, side, cluster_id))) WHERE n > 1 AND r <= ceil(n * 0.05)"
_MEAN = "SELECT run_id, particle_id, side, cluster_id, avg(value) AS m, count(*) AS n FROM class GROUP BY ALL"
_NEAR = f"SELECT run_id, particle_id, side, 'merge:' || c1 || ':' || c2 AS cand, n1 + n2 AS units FROM (SELECT a.run_id, a.particle_id, a.side, a.c_src AS c1, arg_min(a.c_dst, (abs(m1.m - m2.m), a.c_dst)) AS c2, any_value(m1.n) AS n1, arg_min(m2.n, (abs(m1.m - m2.m), a.c_dst)) AS n2 FROM (SELECT DISTINCT run_id, particle_id, side, c_src, c_dst FROM ce WHERE c_src < c_dst) a JOIN ({_MEAN}) m1 ON (m1.run_id, m1.particle_id, m1.side, m1.cluster_id) = (a.run_id, a.particle_id, a.side, a.c_src) JOIN ({_MEAN}) m2 ON (m2.run_id, m2.particle_id, m2.side, m2.cluster_id) = (a.run_id, a.particle_id, a.side, a.c_dst) GROUP BY ALL)"
_FAULTS = "SELECT run_id, 1 AS particle_id, side, 1 AS unit_id, 'left out' AS fault FROM class WHERE particle_id = 1 AND unit_id = 1 UNION ALL SELECT run_id, 2, side, 1, 'held twice' FROM class WHERE particle_id = 2 AND unit_id = 1"
_RANKED = "SELECT *, row_number() OVER (PARTITION BY run_id, particle_id, side, cluster_id ORDER BY value, unit_id) AS r, count(*) OVER (PARTITION BY run_id, particle_id, side, cluster_id) AS n FROM class"
_ENDS = f"SELECT run_id, particle_id, side, 'ends:' || cluster_id || ':' || name AS cand, unit_id, CASE name WHEN 'left' THEN low WHEN 'right' THEN high ELSE low + 2 * high END AS part FROM (SELECT *, (r <= ceil(n * 0.025))::INT AS low, (r > n - ceil(n * 0.025))::INT AS high, unnest(['left', 'right', 'both']) AS name FROM ({_RANKED}) WHERE n > 1)"
SQL = {name: "WITH RECURSIVE " + ", ".join(_needed(sql)) + " " + sql for name, sql in {"far_units": _FAR, "nearest_merges": _NEAR, "cover_faults": _FAULTS, "both_tails": _ENDS}.items()}
