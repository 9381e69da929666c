"""Scores, means and cuts on partitions for which SQL has closed forms: pairs of neighbours and single units.

Dominoes are the pairs (1, 2), (3, 4), ... of units, which are neighbours on lattices of even width; a cluster's
matrices are then 2 × 2. For single units the joint model is 2 × 2 by unit.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import compare, joint, mean_only, panel, partitions, score
from ..session import written
from .panel_queries import SIDE, _asg, _edges, _needed, _panel, _r, _units, _values

QUERIES, SQL = {}, {}
RHO = 0.9


def _registered(sql: str, **ctes: str):
    def add(f):
        needed = _needed(sql + " " + " ".join(ctes.values()))
        QUERIES[f.__name__], SQL[f.__name__] = f, "WITH RECURSIVE " + ", ".join(needed + [f"{n} AS ({q})" for n, q in ctes.items()]) + " " + sql
        return f

    return add


_MOMENTS = "SELECT run_id, round(ln(count(*))) AS k, avg(v) AS mu, var_samp(v) AS var, max(alpha) - min(alpha) AS ra, max(abs(alpha)) AS ta, max(beta) - min(beta) AS rb, max(abs(beta)) AS tb FROM (SELECT *, greatest(syy - beta * sxy, 0) / (periods - 1) AS v FROM ols) GROUP BY run_id"
_FIRST = "SELECT *, pow(ra / (k + 1) / 2, 2) / mu * 0.2 AS a1, pow(rb / (k + 1) / 2, 2) / mu * 0.2 AS b1 FROM moments"
_HYP = f"SELECT run_id, a1, pow(ta / 2, 2) / mu - a1 / (1 - {RHO}) AS a2, b1, pow(tb / 2, 2) / mu - b1 / (1 - {RHO}) AS b2, mu * mu / var + 2 AS sa, mu * (mu * mu / var + 1) AS sb FROM firsts"
_H = {"moments": _MOMENTS, "firsts": _FIRST, "hyp": _HYP}


def _pairs(units: str) -> dict[str, str]:
    """Numbers of dominoes from units: run_id, side, unit_id, b, w, c1, c2."""
    both = f"SELECT x.run_id, x.side, x.unit_id // 2 + 1 AS cluster_id, x.unit_id AS u1, y.unit_id AS u2, x.b AS b1, y.b AS b2, x.w AS w1, y.w AS w2, 1 / x.c1 AS ic, pow({1 - RHO} / x.c1, 2) / (2 * {1 - RHO} / x.c1 + 1 / x.c2) AS q FROM ({units}) x JOIN ({units}) y ON (x.run_id, x.side, x.unit_id + 1) = (y.run_id, y.side, y.unit_id) AND x.unit_id % 2 = 1"
    solved = "SELECT *, (p + w1) * (p + w2) - r * r AS det FROM (SELECT *, ic - q AS p, -0.9 * ic - q AS r FROM both_of)"
    means = "SELECT *, ((p + w2) * b1 - r * b2) / det AS m1, ((p + w1) * b2 - r * b1) / det AS m2 FROM solved"
    domino = "SELECT *, -(b1 * m1 + b2 * m2) AS quad, ln(p * p - r * r) - ln(det) AS log_det FROM meant"
    return {"both_of": both, "solved": solved, "meant": means, "domino": domino}


_SIDES = "SELECT run_id, 'A' AS side, unit_id, periods * alpha AS b, periods::DOUBLE AS w, a1 AS c1, a2 AS c2 FROM ols JOIN hyp USING (run_id) UNION ALL SELECT run_id, 'B', unit_id, sxy, sxx, b1, b2 FROM ols JOIN hyp USING (run_id)"
_DOMINO = _H | _pairs(_SIDES)


def _dominoes(spark, sf_dir):
    ids = _units(spark, sf_dir).select("run_id", F.lit(1).alias("particle_id"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("side"), "unit_id")
    return ids.withColumn("cluster_id", F.expr("(unit_id - 1) div 2 + 1").cast("int"))


@_registered("SELECT run_id, side, cluster_id::INT AS cluster_id, 2 AS n, round(quad, 4) AS quad, round(log_det, 4) AS log_det FROM domino", **_DOMINO)
def domino_clusters(spark, sf_dir):
    """Quadratic form and log determinant of every domino."""
    units = _units(spark, sf_dir)
    stats = score.scored_clusters(_dominoes(spark, sf_dir), units, _edges(spark, sf_dir), panel.default_hyperparameters(units), SIDE)
    return stats.select("run_id", "side", "cluster_id", "n", F.round("quad", 4).alias("quad"), F.round("log_det", 4).alias("log_det"))


@_registered("SELECT run_id, side, u1 AS unit_id, round(m1, 6) AS mean FROM domino UNION ALL SELECT run_id, side, u2, round(m2, 6) FROM domino", **_DOMINO)
def domino_means(spark, sf_dir):
    """Posterior means of the units of dominoes."""
    units = _units(spark, sf_dir)
    stats = score.scored_clusters(_dominoes(spark, sf_dir), units, _edges(spark, sf_dir), panel.default_hyperparameters(units), SIDE)
    return score.posterior_means(stats, SIDE).select("run_id", "side", "unit_id", F.round("mean", 6).alias("mean"))


_LIKE = "SELECT run_id, sum(log_det) / 2 - (any_value(sa) + any_value(obs) / 2) * ln(any_value(sb) + (any_value(yy) + sum(quad)) / 2) + any_value(sa) * ln(any_value(sb)) AS log_like, -2 * lgamma(1 + any_value(n)) AS log_prior FROM domino JOIN hyp USING (run_id) JOIN whole USING (run_id) GROUP BY run_id"
_WHOLE = {"whole": "SELECT run_id, sum(syy + periods * alpha * alpha) AS yy, sum(periods) AS obs, count(*) AS n FROM ols GROUP BY run_id"}


@_registered(f"SELECT run_id, round(log_like, 4) AS log_like, round(log_prior, 4) AS log_prior, round(log_like + log_prior, 4) AS log_post FROM ({_LIKE})", **_DOMINO, **_WHOLE)
def domino_particles(spark, sf_dir):
    """Score of the particle of dominoes on both sides."""
    return score.scored_particles(_dominoes(spark, sf_dir), _units(spark, sf_dir), _edges(spark, sf_dir)).select("run_id", *[F.round(c, 4).alias(c) for c in ("log_like", "log_prior", "log_post")])


_LEVEL = "SELECT run_id, 'A' AS side, unit_id, sum(y) AS b, count(y)::DOUBLE AS w, any_value(a1) AS c1, any_value(a2) AS c2 FROM panel JOIN hyp USING (run_id) GROUP BY run_id, unit_id"
_LEVEL_SUMS = {"level": "SELECT run_id, unit_id, avg(y) AS m, count(y) AS t, var_samp(y) * (count(y) - 1) AS ss FROM panel GROUP BY ALL", "level_sum": "SELECT run_id, sum(ss) AS ss, sum(t * m * m) AS yy, sum(t) AS obs, sum(ln(t)) AS ln_t FROM level GROUP BY run_id"}
_LEVEL_LIKE = "SELECT run_id, round((sum(log_det) + any_value(ln_t)) / 2 - (any_value(2 * sa) + any_value(obs)) / 2 * ln((any_value(2 * sa * sb / sa) + any_value(yy) + sum(quad) + any_value(ss)) / 2), 4) AS log_like, 0.0::DOUBLE AS log_prior FROM domino JOIN hyp USING (run_id) JOIN level_sum USING (run_id) GROUP BY run_id"


@_registered(_LEVEL_LIKE, **_H, **_pairs(_LEVEL), **_LEVEL_SUMS)
def domino_levels(spark, sf_dir):
    """Score of the dominoes in the model with levels alone."""
    from .mean_queries import _hyper

    rows = mean_only.mean_only_scores(_dominoes(spark, sf_dir), _panel(spark, sf_dir), _edges(spark, sf_dir), _hyper(spark, sf_dir))
    return rows.select("run_id", F.round("log_like", 4).alias("log_like"), F.round("log_prior", 4).alias("log_prior"))


_ONE = _H | {
    "raw": "SELECT run_id, unit_id, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy, sum(y * y) AS yy FROM panel GROUP BY ALL",
    "one": f"SELECT r.*, 1 / (a1 / {1 - RHO} + a2) AS oa, 1 / (b1 / {1 - RHO} + b2) AS ob, sa, sb FROM raw r JOIN hyp USING (run_id)",
    "two": "SELECT *, (n + oa) * (sxx + ob) - sx * sx AS det FROM one",
    "three": "SELECT *, ((sxx + ob) * sy - sx * sxy) / det AS al, ((n + oa) * sxy - sx * sy) / det AS be FROM two",
}


def _singles(spark, sf_dir):
    """The particle of single units, with the panel as recorded."""
    ids = _dominoes(spark, sf_dir).withColumn("cluster_id", F.col("unit_id").cast("int"))
    return joint.packed_particles(ids, _panel(spark, sf_dir), score.neighbour_lists(_edges(spark, sf_dir)), panel.default_hyperparameters(_units(spark, sf_dir)))


@_registered("SELECT run_id, round(0.5 * sum(ln(oa) + ln(ob) - ln(det)) - (any_value(sa) + sum(n) / 2) * ln(any_value(sb) + sum(yy - sy * al - sxy * be) / 2) + any_value(sa) * ln(any_value(sb)), 4) AS log_like FROM three GROUP BY run_id", **_ONE)
def singles_exact(spark, sf_dir):
    """Likelihood of the particle of single units, x as recorded."""
    return joint.exact_likelihood(_singles(spark, sf_dir)).select("run_id", F.round("log_like", 4).alias("log_like"))


@_registered("SELECT run_id, round(0.5 * sum(ln(oa) + ln(ob)) + lgamma(any_value(sa) + sum(n) / 2 + count(*)) - lgamma(any_value(sa)) + any_value(sa) * ln(any_value(sb)) - (any_value(sa) + sum(n) / 2 + count(*)) * ln(any_value(sb) + sum(yy - 2 * al * sy - 2 * be * sxy + n * al * al + 2 * al * be * sx + be * be * sxx + oa * al * al + ob * be * be) / 2), 3) AS log_like FROM three GROUP BY run_id", **_ONE)
def singles_joint(spark, sf_dir):
    """Density of the data with the posterior means, of the particle of single units."""
    return joint.joint_likelihood(_singles(spark, sf_dir)).select("run_id", F.round("log_like", 3).alias("log_like"))


@_registered("SELECT run_id, unit_id, round(al, 6) AS alpha, round(be, 6) AS beta FROM three", **_ONE)
def singles_means(spark, sf_dir):
    """Posterior means of levels and slopes at once, of single units."""
    return _r(joint.joint_means(_singles(spark, sf_dir)), "alpha", "beta").drop("particle_id")


_ASCENT = _ONE | {
    "b0": "SELECT *, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS be0 FROM one",
    "s1": "SELECT *, (sxy - sx * al1) / (sxx + ob) AS be1 FROM (SELECT *, (sy - sx * be0) / (n + oa) AS al1 FROM b0)",
    "s2": "SELECT *, (sxy - sx * al2) / (sxx + ob) AS be2 FROM (SELECT *, (sy - sx * be1) / (n + oa) AS al2 FROM s1)",
}


@_registered("SELECT run_id, unit_id, round(al2, 6) AS alpha, round(be2, 6) AS beta FROM s2", **_ASCENT)
def singles_ascent(spark, sf_dir):
    """Levels and slopes of single units after two sweeps of coordinate ascent."""
    return _r(joint.ascent_means(_singles(spark, sf_dir)), "alpha", "beta").drop("particle_id")


_SORTED = "SELECT run_id, side, value, row_number() OVER w AS i, sum(value) OVER (w ROWS UNBOUNDED PRECEDING) AS h, sum(value * value) OVER (w ROWS UNBOUNDED PRECEDING) AS s, count(*) OVER (PARTITION BY run_id, side) AS n FROM class WHERE particle_id = 1 WINDOW w AS (PARTITION BY run_id, side ORDER BY value, unit_id)"
_COST = "SELECT run_id, side, 0 AS i, 0.0::DOUBLE AS h, 0.0::DOUBLE AS s, max(n) AS n FROM sorted GROUP BY ALL UNION ALL SELECT run_id, side, i, h, s, n FROM sorted"
_COSTS = "SELECT a.run_id, a.side, a.i AS lo, b.i AS hi, a.n, b.s - a.s - pow(b.h - a.h, 2) / (b.i - a.i) AS cost FROM ends a JOIN ends b ON (a.run_id, a.side) = (b.run_id, b.side) AND a.i < b.i"
_BEST = {
    "sorted": _SORTED,
    "ends": _COST,
    "costs": _COSTS,
    "k1": "SELECT run_id, side, hi, n, cost AS best FROM costs WHERE lo = 0",
    "k2": "SELECT c.run_id, c.side, c.hi, any_value(c.n) AS n, min(k.best + c.cost) AS best FROM costs c JOIN k1 k ON (k.run_id, k.side, k.hi) = (c.run_id, c.side, c.lo) GROUP BY ALL",
    "k3": "SELECT c.run_id, c.side, c.hi, any_value(c.n) AS n, min(k.best + c.cost) AS best FROM costs c JOIN k2 k ON (k.run_id, k.side, k.hi) = (c.run_id, c.side, c.lo) GROUP BY ALL",
}


@_registered("SELECT run_id, side, k, round(best, 5) AS within_ss FROM (SELECT *, 1 AS k FROM k1 UNION ALL SELECT *, 2 FROM k2 UNION ALL SELECT *, 3 FROM k3) WHERE hi = n", **_BEST)
def kmeans_path_squares(spark, sf_dir):
    """Sums of squares of the best 1, 2 and 3 classes of levels and slopes."""
    keys = ["run_id", "side"]
    path = compare.kmeans_path(_values(spark, sf_dir), keys, 3)
    return partitions.within_squares(path, _values(spark, sf_dir), [*keys, "k"], "value").select(*keys, "k", F.round("within_ss", 5).alias("within_ss"))


_CUT = {
    "run_of": "SELECT *, row_number() OVER o AS i, sum(value) OVER (o ROWS UNBOUNDED PRECEDING) AS head, sum(value) OVER p AS total, count(*) OVER p AS n, max(value) OVER p - min(value) OVER p AS spread FROM class WINDOW p AS (PARTITION BY run_id, particle_id, side, cluster_id), o AS (PARTITION BY run_id, particle_id, side, cluster_id ORDER BY value, unit_id)",
    "cut_of": "SELECT run_id, particle_id, side, cluster_id, arg_max(i, (round(head * head / i + pow(total - head, 2) / (n - i), 9), -i)) AS at FROM run_of WHERE n > 2 AND spread > 0 AND i < n GROUP BY ALL",
}


@_registered("SELECT r.run_id, r.particle_id, r.side, r.cluster_id, r.unit_id, (r.i > c.at)::INT AS part FROM run_of r JOIN cut_of c ON (r.run_id, r.particle_id, r.side, r.cluster_id) = (c.run_id, c.particle_id, c.side, c.cluster_id)", **_CUT)
def kmeans_split(spark, sf_dir):
    """Two-means cut of every cluster."""
    from ..operators.moves import kmeans_splits

    return kmeans_splits(_asg(spark, sf_dir), _values(spark, sf_dir), SIDE, "value")


# An edge is in the least spanning tree just if lighter edges do not join its ends.
_TREE = {
    "weighed": "SELECT a.run_id, e.src, e.dst, abs(a.alpha - b.alpha) AS weight FROM edge e JOIN ols a ON a.unit_id = e.src JOIN ols b ON b.unit_id = e.dst AND b.run_id = a.run_id",
    "walk": "SELECT run_id, src, dst, weight, src AS v FROM weighed WHERE src < dst UNION SELECT w.run_id, w.src, w.dst, w.weight, e.dst FROM walk w JOIN weighed e ON e.run_id = w.run_id AND e.src = w.v AND (e.weight, least(e.src, e.dst), greatest(e.src, e.dst)) < (w.weight, w.src, w.dst)",
}


@_registered("SELECT run_id, src, dst, round(any_value(weight), 6) AS weight FROM walk GROUP BY run_id, src, dst HAVING count(*) FILTER (v = dst) = 0", **_TREE)
def spanning_tree(spark, sf_dir):
    """Least spanning tree of each run's lattice, edges weighted by the difference of levels."""
    units = written(_units(spark, sf_dir).select("run_id", "unit_id", "alpha"), "levels")
    a = units.select("run_id", F.col("unit_id").alias("src"), F.col("alpha").alias("p"))
    b = units.select("run_id", F.col("unit_id").alias("dst"), F.col("alpha").alias("q"))
    weighted = a.join(_edges(spark, sf_dir), "src").join(b, ["run_id", "dst"]).select("run_id", "src", "dst", F.abs(F.col("p") - F.col("q")).alias("weight"))
    return _r(compare.spanning_tree(weighted, ["run_id"]), "weight")


@_registered("SELECT run_id, unit_id, 1 AS component FROM ols")
def tree_components(spark, sf_dir):
    """Components of the spanning tree: the whole lattice of each run."""
    tree = spanning_tree(spark, sf_dir)
    return compare.strong_parts(tree, _units(spark, sf_dir).select("run_id", "unit_id"), ["run_id"], tolerance=float("inf")).withColumn("component", F.col("component").cast("int"))


@_registered("SELECT run_id, count(*) AS units, 0::BIGINT AS off FROM ols GROUP BY run_id")
def tree_identity(spark, sf_dir):
    """Cells in which the product of the spanning tree's matrix and its inverse is not the identity, by run."""
    keys = ["run_id"]
    tree = written(spanning_tree(spark, sf_dir).select(*keys, "src", "dst"), "tree")
    units = written(_units(spark, sf_dir).select(*keys, "unit_id"), "units")
    name = F.concat_ws(":", "src", "dst")
    rows = compare.tree_basis(tree, units, keys).select(*keys, name.alias("row"), "unit_id", F.col("value").alias("x"))
    columns = compare.tree_inverse(tree, units, keys).select(*keys, name.alias("column"), "unit_id", F.col("value").alias("y"))
    product = rows.join(columns, [*keys, "unit_id"]).groupBy(*keys, "row", "column").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    off = F.count_if(F.abs(F.col("v") - (F.col("row") == F.col("column")).cast("int")) > 1e-9)
    return product.groupBy(*keys).agg(F.count_distinct("row").alias("units"), off.alias("off"))


@_registered("SELECT n, round(lgamma(n), 6) AS gamma, round(lgamma(n / 4.0), 6) AS quarter, round(lgamma(n) + lgamma(3.5) - lgamma(n + 3.5), 6) AS beta, round(lgamma(n + 6) - lgamma(4) - lgamma(n + 3), 6) AS choose, round(1.5 * ln(pi()) + lgamma(n + 1) + lgamma(n + 0.5) + lgamma(n), 6) AS multi FROM (SELECT DISTINCT n FROM sized)")
def lgamma_family(spark, sf_dir):
    """ln Γ, ln B, ln of binomials and ln of the multivariate Γ at the sizes of clusters."""
    sizes = partitions.cluster_sizes(_asg(spark, sf_dir), SIDE).select("n").distinct()
    n = F.col("n").cast("double")
    values = {"gamma": scalars.ln_gamma(n), "quarter": scalars.ln_gamma(n / 4), "beta": scalars.ln_beta(n, F.lit(3.5)), "choose": scalars.ln_choose(n + 5, F.lit(3)), "multi": scalars.ln_gamma_multi(n + 1, 3)}
    return sizes.select("n", *[F.round(v, 6).alias(c) for c, v in values.items()])
