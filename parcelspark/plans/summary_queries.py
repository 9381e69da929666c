"""Queries that sum up ensembles: distances between particles, averages of metrics, predictions of counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel, partitions
from .panel_queries import _asg, _compared, _estimates, _needed, _panel, _units, _weighted


def pairwise_vi(spark, sf_dir):
    """Mean variation of information over the pairs of a run's particles, both sides added. A run has few particles; pairs meet cluster by cluster."""
    asg = _asg(spark, sf_dir)
    a, b = (asg.withColumnRenamed("particle_id", n).withColumnRenamed("cluster_id", c) for n, c in (("p", "c1"), ("q", "c2")))
    table = a.join(b, ["run_id", "side", "unit_id"]).where(F.col("p") < F.col("q")).groupBy("run_id", "side", "p", "q", "c1", "c2").agg(F.count(F.lit(1)).alias("n"))
    vi = partitions.comparison(table, ["run_id", "side", "p", "q"]).groupBy("run_id", "p", "q").agg(F.sum("vi").alias("vi"))
    return vi.groupBy("run_id").agg(F.round(F.avg("vi"), 6).alias("vi"))


def metric_average(spark, sf_dir):
    """Rand index against particle 1 over the other particles: mean, weighted mean, and the share that equals it."""
    rows = _compared(spark, sf_dir, "rand").join(_weighted(spark, sf_dir).select("run_id", "particle_id", "w"), ["run_id", "particle_id"])
    return rows.groupBy("run_id", "side").agg(F.round(F.avg("rand"), 6).alias("mean"), F.round(F.sum(F.col("w") * F.col("rand")) / F.sum("w"), 6).alias("weighted"), F.avg((F.col("rand") == 1).cast("int")).alias("equal"))


def draw_mean(spark, sf_dir):
    """Mean estimate of each unit over the particles."""
    return _estimates(spark, sf_dir).groupBy("run_id", "unit_id").agg(F.round(F.avg("alpha"), 6).alias("alpha"))


def predict_counts(spark, sf_dir):
    """exp(alpha + beta x) for the last period of each run."""
    rows = panel.predicted(_units(spark, sf_dir), panel.held_out(_panel(spark, sf_dir))[1])
    return rows.select("run_id", "unit_id", F.round(F.exp("fit"), 4).alias("expected"))


def error_ratio(spark, sf_dir):
    """Mean squared error of each particle's estimates against the units' own, as a ratio to particle 1's."""
    own = _units(spark, sf_dir).select("run_id", "unit_id", F.col("alpha").alias("own"))
    mse = _estimates(spark, sf_dir).join(own, ["run_id", "unit_id"]).groupBy("run_id", "particle_id").agg(F.avg(F.pow(F.col("alpha") - F.col("own"), 2)).alias("mse"))
    first = mse.where("particle_id = 1").select("run_id", F.col("mse").alias("first"))
    return mse.join(first, "run_id").select("run_id", "particle_id", F.round(F.col("mse") / F.nullif(F.col("first"), F.lit(0.0)), 6).alias("ratio"))


def posterior_gap(spark, sf_dir):
    """Of each run: the greatest log posterior less that of particle 1, and whether another particle has particle 1's partitions."""
    rows = _weighted(spark, sf_dir)
    first = rows.where("particle_id = 1").select("run_id", F.col("log_post").alias("own"), F.col("signature").alias("truth"))
    met = F.max(((F.col("signature") == F.col("truth")) & (F.col("particle_id") > 1)).cast("int"))
    return rows.join(first, "run_id").groupBy("run_id").agg(F.round(F.max(F.col("log_post") - F.col("own")), 6).alias("gap"), met.alias("met"))


QUERIES = {f.__name__: f for f in (pairwise_vi, metric_average, draw_mean, predict_counts, error_ratio, posterior_gap)}

_PAIRS = "SELECT a.run_id, a.side, a.particle_id AS p, b.particle_id AS q, a.cluster_id AS c1, b.cluster_id AS c2, count(*) AS n FROM class a JOIN class b ON a.run_id = b.run_id AND a.side = b.side AND a.unit_id = b.unit_id AND a.particle_id < b.particle_id GROUP BY ALL"
_E = lambda c: f"(SELECT run_id, side, p, q, sum(m * ln(m)) AS e FROM (SELECT run_id, side, p, q, {c}, sum(n) AS m FROM pairs GROUP BY ALL) GROUP BY ALL)"
_SQL = {
    "posterior_gap": "SELECT run_id, round(max(log_post) - max(log_post) FILTER (particle_id = 1), 6) AS gap, max((same = 1 AND particle_id > 1)::INT) AS met FROM wt GROUP BY run_id",
    "pairwise_vi": f"SELECT run_id, round(avg(vi), 6) AS vi FROM (SELECT run_id, p, q, sum(greatest((x.e + y.e - 2 * z.e) / z.n, 0)) AS vi FROM {_E('c1')} x JOIN {_E('c2')} y USING (run_id, side, p, q) JOIN (SELECT run_id, side, p, q, sum(n * ln(n)) AS e, sum(n) AS n FROM pairs GROUP BY ALL) z USING (run_id, side, p, q) GROUP BY ALL) GROUP BY run_id",
    "metric_average": "SELECT run_id, side, round(avg(rand), 6) AS mean, round(sum(w * rand) / sum(w), 6) AS weighted, avg((rand = 1)::INT) AS equal FROM (SELECT run_id, side, particle_id, round(1 - (p1 + p2 - 2 * p12) / p, 6) AS rand FROM cmp) JOIN wt USING (run_id, particle_id) GROUP BY ALL",
    "draw_mean": "SELECT run_id, unit_id, round(avg(alpha), 6) AS alpha FROM est GROUP BY ALL",
    "predict_counts": "SELECT run_id, unit_id, round(exp(alpha + beta * x), 4) AS expected FROM panel JOIN ols USING (run_id, unit_id) QUALIFY t = max(t) OVER (PARTITION BY run_id)",
    "error_ratio": "SELECT run_id, particle_id, round(mse / nullif(max(mse) FILTER (particle_id = 1) OVER (PARTITION BY run_id), 0), 6) AS ratio FROM (SELECT e.run_id, e.particle_id, avg((e.alpha - o.alpha) ** 2) AS mse FROM est e JOIN ols o USING (run_id, unit_id) GROUP BY ALL)",
}
SQL = {}
for _name, _sql in _SQL.items():
    _with = _needed(_sql + (" FROM class" if _name == "pairwise_vi" else "")) + ([f"pairs AS ({_PAIRS})"] if _name == "pairwise_vi" else [])
    SQL[_name] = "WITH " + ", ".join(_with) + " " + _sql
