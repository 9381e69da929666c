"""Queries over panels of many runs, partitions of their units, and incident counts, with their SQL.

The partitions come from the data: particle p of a run puts its units into k classes of equal
width by intercept (side A) and slope (side B), k = 2, 3, 4, and particle 4 is particle 1 with its
labels reversed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import ihs_count, plain_kind
from ..operators import graph, incidents, moves, panel, partitions, score, weights
from ..operators.current import current_rows
from ..sources.tables import table

SIDE = ["run_id", "particle_id", "side"]
FIRST, LAST = 2006, 2018


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "panel")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.unit_ols(_panel(spark, sf_dir))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.lattice_edges(_panel(spark, sf_dir))


def _classes(units: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    run = Window.partitionBy("run_id", "side")
    sides = F.array(F.struct(F.lit("A").alias("side"), F.col("alpha").alias("value")), F.struct(F.lit("B").alias("side"), F.col("beta").alias("value")))
    rows = units.select("run_id", "unit_id", F.explode(sides).alias("s")).select("run_id", "unit_id", "s.*")
    place = (F.col("value") - F.min("value").over(run)) / (F.max("value").over(run) - F.min("value").over(run))
    rows = rows.withColumn("place", place).withColumn("particle_id", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))))
    k = F.when(F.col("particle_id") == 4, 2).otherwise(F.col("particle_id") + 1)
    label = F.least(k - 1, F.floor(F.col("place") * k).cast("int"))
    return rows.withColumn("cluster_id", F.when(F.col("particle_id") == 4, k - 1 - label).otherwise(label)).select(*SIDE, "unit_id", "cluster_id", "value")


def _asg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(_units(spark, sf_dir)).drop("value")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(_units(spark, sf_dir)).where("particle_id = 1").select("run_id", "side", "unit_id", "value")


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles with a stand-in log posterior that SQL can compute too: prior less half the sums of squares."""
    asg = _asg(spark, sf_dir)
    prior = weights.prior_py(asg, SIDE).groupBy("run_id", "particle_id").agg(F.sum("log_prior").alias("log_prior"))
    ss = partitions.within_squares(asg, _values(spark, sf_dir), SIDE, "value").groupBy("run_id", "particle_id").agg(F.sum("within_ss").alias("ss"))
    sig = partitions.signatures(asg, SIDE).groupBy("run_id", "particle_id").agg(F.max_by("signature", "side").alias("b"), F.min_by("signature", "side").alias("a"))
    rows = prior.join(ss, ["run_id", "particle_id"]).join(sig, ["run_id", "particle_id"])
    rows = rows.select("run_id", "particle_id", F.concat("a", "b").alias("signature"), F.round(F.col("log_prior") - F.col("ss") / 2, 6).alias("log_post"))
    return weights.tempered_weights(rows)


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*SIDE, "cluster_id")
    rows = _classes(_units(spark, sf_dir)).where("side = 'A'").withColumn("alpha", F.avg("value").over(w))
    return rows.select("run_id", "particle_id", "unit_id", "alpha")


QUERIES, SQL = {}, {}


def query(sql: str | None):
    """Register a query under its name with the SQL that it equals."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = "WITH RECURSIVE " + ", ".join(_needed(sql)) + " " + sql if _needed(sql) else sql
        return f

    return add


_CTE = {
    "ols": "ols AS (SELECT run_id, unit_id, count(*) AS periods, avg(x) AS mean_x, avg(y) AS mean_y, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM panel WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL)",
    "ids": "ids AS (SELECT DISTINCT unit_id::INT AS u FROM panel), size AS (SELECT ceil(sqrt(max(u)))::INT AS w, max(u) AS n FROM ids)",
    "edge": "edge AS (SELECT a.u AS src, b.u AS dst FROM ids a, ids b, size WHERE (abs(a.u - b.u) = w) OR (abs(a.u - b.u) = 1 AND (a.u - 1) // w = (b.u - 1) // w))",
    "class": "class AS (SELECT run_id, side, unit_id, value, p AS particle_id, CASE WHEN p = 4 THEN 1 - least(1, floor(place * 2)) ELSE least(p, floor(place * (p + 1))) END::INT AS cluster_id FROM (SELECT *, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) AS place FROM (SELECT run_id, unit_id, 'A' AS side, alpha AS value FROM ols UNION ALL SELECT run_id, unit_id, 'B', beta FROM ols) WINDOW w AS (PARTITION BY run_id, side)), (SELECT unnest([1, 2, 3, 4]) AS p))",
    "ce": "ce AS (SELECT a.run_id, a.particle_id, a.side, e.src, e.dst, a.cluster_id AS c_src, b.cluster_id AS c_dst FROM class a JOIN edge e ON e.src = a.unit_id JOIN class b ON b.unit_id = e.dst AND b.run_id = a.run_id AND b.particle_id = a.particle_id AND b.side = a.side)",
    "reach": "reach AS (SELECT run_id, particle_id, side, unit_id, unit_id AS other FROM class UNION SELECT r.run_id, r.particle_id, r.side, r.unit_id, ce.dst FROM reach r JOIN ce ON ce.run_id = r.run_id AND ce.particle_id = r.particle_id AND ce.side = r.side AND ce.src = r.other AND ce.c_src = ce.c_dst)",
    "sized": "sized AS (SELECT run_id, particle_id, side, cluster_id, count(*) AS n FROM class GROUP BY ALL)",
    "cont": "cont AS (SELECT a.run_id, a.side, b.particle_id, a.cluster_id AS c1, b.cluster_id AS c2, count(*) AS n FROM class a JOIN class b ON a.run_id = b.run_id AND a.side = b.side AND a.unit_id = b.unit_id AND a.particle_id = 1 AND b.particle_id > 1 GROUP BY ALL)",
    "marg": "marg AS (SELECT run_id, side, particle_id, sum(n)::DOUBLE AS n, sum(n * (n - 1) / 2.0) AS p12, sum(n * ln(n)) AS e12 FROM cont GROUP BY ALL), m1 AS (SELECT run_id, side, particle_id, sum(n * (n - 1) / 2.0) AS p1, sum(n * ln(n)) AS e1 FROM (SELECT run_id, side, particle_id, c1, sum(n) AS n FROM cont GROUP BY ALL) GROUP BY ALL), m2 AS (SELECT run_id, side, particle_id, sum(n * (n - 1) / 2.0) AS p2, sum(n * ln(n)) AS e2 FROM (SELECT run_id, side, particle_id, c2, sum(n) AS n FROM cont GROUP BY ALL) GROUP BY ALL), cmp AS (SELECT run_id, side, particle_id, n, p12, p1, p2, n * (n - 1) / 2 AS p, e12, e1, e2 FROM marg JOIN m1 USING (run_id, side, particle_id) JOIN m2 USING (run_id, side, particle_id))",
    "ep": "ep AS (SELECT run_id, particle_id, side, sum(lgamma(n)) - lgamma(1 + sum(n)) + lgamma(1) AS log_prior FROM sized GROUP BY ALL)",
    "wss": "wss AS (SELECT run_id, particle_id, side, sum(ss) AS within_ss FROM (SELECT run_id, particle_id, side, cluster_id, var_pop(value) * count(*) AS ss FROM class GROUP BY ALL) GROUP BY ALL)",
    "part": "part AS (SELECT run_id, particle_id, round(sum(log_prior) - sum(within_ss) / 2, 6) AS log_post, CASE WHEN particle_id = 4 THEN 1 ELSE particle_id END AS same FROM ep JOIN wss USING (run_id, particle_id, side) GROUP BY ALL)",
    "wt": "wt AS (SELECT run_id, particle_id, same, log_post, p / sum(p) OVER (PARTITION BY run_id) AS w FROM (SELECT *, exp((log_post - max(log_post) OVER (PARTITION BY run_id)) / 10) / count(*) OVER (PARTITION BY run_id, same) AS p FROM part))",
    "uniq": "uniq AS (SELECT run_id, same, sum(w) AS w, count(*) AS copies, min(particle_id) AS particle_id, max(log_post) AS log_post FROM wt GROUP BY ALL)",
    "est": "est AS (SELECT run_id, particle_id, unit_id, avg(value) OVER (PARTITION BY run_id, particle_id, cluster_id) AS alpha FROM class WHERE side = 'A')",
    "years": f"spine AS (SELECT region_id, unnest(range({FIRST}, {LAST + 1}))::INT AS year FROM tract), current_row AS (SELECT * FROM clean_crime QUALIFY row_number() OVER (PARTITION BY dc_key ORDER BY loaded_at DESC NULLS LAST, crime_id DESC) = 1), years AS (SELECT s.region_id, s.year, count(*) FILTER (ucr_general <= 400 OR ucr_general IN (800, 1700)) AS violent, count(*) FILTER (ucr_general IN (500, 600)) AS nonviolent FROM spine s LEFT JOIN current_row c ON c.ngbh = s.region_id AND c.year = s.year GROUP BY ALL)",
    "dens": "dens AS (SELECT region_id, year, geoid, violent, aland / 1e6 / 2.59 AS area_sqmile, violent / (aland / 1e6 / 2.59) AS density FROM years JOIN tract USING (region_id))",
}
_FROM = {"class": ["ols"], "edge": ["ids"], "ce": ["class", "edge"], "reach": ["ce"], "sized": ["class"], "cont": ["class"], "marg": ["cont"], "ep": ["sized"], "wss": ["class"], "part": ["ep", "wss"], "wt": ["part"], "uniq": ["wt"], "est": ["class"], "dens": ["years"], "cmp": ["marg"]}


def _needed(sql: str) -> list[str]:
    import re

    out: list[str] = []

    def add(name: str) -> None:
        for x in _FROM.get(name, []):
            add(x)
        if name in _CTE and _CTE[name] not in out:
            out.append(_CTE[name])

    for name in re.findall(r"\b(?:FROM|JOIN) (\w+)", sql):
        add(name)
    return out


# Panels


@query("SELECT run_id, unit_id, t, round(x - avg(x) OVER (PARTITION BY run_id, unit_id), 6) AS x, y FROM panel")
def panel_center(spark, sf_dir):
    return _r(panel.centred(_panel(spark, sf_dir)), "x")


@query("SELECT run_id, unit_id, t, round((x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0), 6) AS x, y FROM panel WINDOW w AS (PARTITION BY run_id, unit_id)")
def panel_standardize(spark, sf_dir):
    return _r(panel.standardised(_panel(spark, sf_dir)), "x")


@query("SELECT run_id, unit_id, t, round(x - mean_x, 6) AS x, round(y - beta * mean_x, 6) AS y FROM panel JOIN ols USING (run_id, unit_id)")
def panel_shift(spark, sf_dir):
    return _r(panel.shifted(_panel(spark, sf_dir)), "x", "y")


@query("SELECT run_id, unit_id, periods, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y FROM ols")
def unit_ols(spark, sf_dir):
    return _r(_units(spark, sf_dir), "alpha", "beta", "mean_x", "mean_y").select("run_id", "unit_id", "periods", "alpha", "beta", "mean_x", "mean_y")


@query("SELECT run_id, unit_id, round(sqrt(greatest(syy - beta * sxy, 0) / (periods - 1)), 6) AS resid_sd FROM ols")
def unit_resid_sd(spark, sf_dir):
    return _r(_units(spark, sf_dir), "resid_sd").select("run_id", "unit_id", "resid_sd")


@query("SELECT run_id, coalesce(sum(abs(s)) < 1e-10, false) AS raw, coalesce(sum(abs(c)) < 1e-10, false) AS centred FROM (SELECT run_id, unit_id, sum(x) AS s, sum(x - m) AS c FROM (SELECT *, avg(x) OVER (PARTITION BY run_id, unit_id) AS m FROM panel) GROUP BY ALL) GROUP BY run_id")
def orthogonality_check(spark, sf_dir):
    raw, centred = (panel.orthogonality(p) for p in (_panel(spark, sf_dir), panel.centred(_panel(spark, sf_dir))))
    return raw.withColumnRenamed("orthogonal", "raw").join(centred.withColumnRenamed("orthogonal", "centred"), "run_id")


_V = "SELECT run_id, greatest(syy - beta * sxy, 0) / (periods - 1) AS v, alpha, beta FROM ols"
_HYPER = f"SELECT run_id, round(a1, 6) AS a1, round((max_a / 2) ** 2 / mu - a1 / (1 - 0.9), 6) AS a2, round(b1, 6) AS b1, round((max_b / 2) ** 2 / mu - b1 / (1 - 0.9), 6) AS b2, round(mu * mu / var + 2, 6) AS alpha_sigma, round(mu * (mu * mu / var + 1), 6) AS beta_sigma FROM (SELECT *, ((range_a) / (k + 1) / 2) ** 2 / mu * 0.2 AS a1, ((range_b) / (k + 1) / 2) ** 2 / mu * 0.2 AS b1 FROM (SELECT run_id, avg(v) AS mu, var_samp(v) AS var, round(ln(count(*))) AS k, max(alpha) - min(alpha) AS range_a, max(beta) - min(beta) AS range_b, max(abs(alpha)) AS max_a, max(abs(beta)) AS max_b FROM ({_V}) GROUP BY run_id))"


@query(_HYPER)
def hyperparam_moments(spark, sf_dir):
    return _r(panel.default_hyperparameters(_units(spark, sf_dir)), "a1", "a2", "b1", "b2", "alpha_sigma", "beta_sigma")


@query("SELECT run_id, unit_id, y FROM panel QUALIFY t = max(t) OVER (PARTITION BY run_id)")
def year_holdout(spark, sf_dir):
    return panel.held_out(_panel(spark, sf_dir))[1].select("run_id", "unit_id", "y")


_LAST = "SELECT *, max(t) OVER (PARTITION BY run_id) AS last FROM panel"


@query(f"SELECT run_id, round(sqrt(avg((y - a - b * x) ** 2)), 6) AS rmse, round(1 - avg((y - a - b * x) ** 2) / var_pop(y), 6) AS r2 FROM ({_LAST}) JOIN (SELECT run_id, unit_id, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM ({_LAST}) WHERE t < last GROUP BY ALL) USING (run_id, unit_id) WHERE t = last GROUP BY run_id")
def predict_accuracy(spark, sf_dir):
    known, new = panel.held_out(_panel(spark, sf_dir))
    return _r(panel.accuracy(panel.predicted(panel.unit_ols(known), new), ["run_id"], F.col("y"), F.col("fit")), "rmse", "r2")


# Graphs


@query("SELECT src, dst FROM edge")
def lattice_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query("SELECT src AS unit_id, count(*) AS degree FROM edge GROUP BY src")
def degree(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@query("SELECT src, dst FROM tract_edge")
def region_contiguity(spark, sf_dir):
    return graph.contiguity(table(spark, sf_dir, "tract"))


@query("SELECT run_id, particle_id, side, c_src AS c1, c_dst AS c2, count(*) AS edges FROM ce WHERE c_src < c_dst GROUP BY ALL")
def cluster_adjacency(spark, sf_dir):
    return graph.cluster_adjacency(_edges(spark, sf_dir), _asg(spark, sf_dir), SIDE)


@query("SELECT run_id, particle_id, side, src, dst FROM ce WHERE src < dst AND c_src <> c_dst")
def cluster_border_pairs(spark, sf_dir):
    return graph.border_pairs(_edges(spark, sf_dir), _asg(spark, sf_dir), SIDE)


@query("SELECT DISTINCT run_id, particle_id, side, src AS unit_id, c_src AS cluster_id, c_dst AS neighbour FROM ce WHERE c_src <> c_dst")
def unit_neighbor_clusters(spark, sf_dir):
    return graph.neighbour_clusters(_edges(spark, sf_dir), _asg(spark, sf_dir), SIDE)


@query("SELECT s.run_id, s.particle_id, s.side, s.cluster_id, coalesce(x.c2, -1) AS nearest FROM sized s LEFT JOIN (SELECT a.run_id, a.particle_id, a.side, a.c_src AS c1, arg_min(a.c_dst, (abs(m1.m - m2.m), a.c_dst)) AS c2 FROM (SELECT DISTINCT run_id, particle_id, side, c_src, c_dst FROM ce WHERE c_src <> c_dst) a JOIN (SELECT run_id, particle_id, side, cluster_id, avg(value) AS m FROM class GROUP BY ALL) m1 ON (m1.run_id, m1.particle_id, m1.side, m1.cluster_id) = (a.run_id, a.particle_id, a.side, a.c_src) JOIN (SELECT run_id, particle_id, side, cluster_id, avg(value) AS m FROM class GROUP BY ALL) m2 ON (m2.run_id, m2.particle_id, m2.side, m2.cluster_id) = (a.run_id, a.particle_id, a.side, a.c_dst) GROUP BY ALL) x ON (x.run_id, x.particle_id, x.side, x.c1) = (s.run_id, s.particle_id, s.side, s.cluster_id)")
def nearest_adjacent_cluster(spark, sf_dir):
    return graph.nearest_clusters(_edges(spark, sf_dir), _asg(spark, sf_dir), _values(spark, sf_dir), SIDE)


@query("SELECT run_id, particle_id, side, unit_id, min(other) AS cluster_id FROM reach GROUP BY ALL")
def connectivity_repair(spark, sf_dir):
    return graph.connected_clusters(_edges(spark, sf_dir), _asg(spark, sf_dir), SIDE)


@query("SELECT run_id, particle_id, side, count(DISTINCT first) AS components FROM (SELECT run_id, particle_id, side, unit_id, min(other) AS first FROM reach GROUP BY ALL) GROUP BY ALL")
def connected_components(spark, sf_dir):
    parts = graph.connected_clusters(_edges(spark, sf_dir), _asg(spark, sf_dir), SIDE)
    return parts.groupBy(*SIDE).agg(F.count_distinct("cluster_id").alias("components"))


# Partitions


@query("SELECT run_id, particle_id, side, cluster_id, n FROM sized")
def cluster_size(spark, sf_dir):
    return partitions.cluster_sizes(_asg(spark, sf_dir), SIDE)


@query("SELECT run_id, particle_id, side, cluster_id, round(avg(value), 6) AS mean, count(*) AS n FROM class GROUP BY ALL")
def cluster_mean(spark, sf_dir):
    return _classes(_units(spark, sf_dir)).groupBy(*SIDE, "cluster_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("SELECT run_id, particle_id, side, cluster_id, round((0.1 / 0.5 * sum(value)) / (1 / 2.0 + count(*) * 0.1 / 0.5), 6) AS mean FROM class GROUP BY ALL")
def cluster_shrunk_mean(spark, sf_dir):
    """(1-ρ)/a1 Σ value over 1/a2 + m(1-ρ)/a1, at ρ = 0.9, a1 = 0.5, a2 = 2."""
    pull = F.lit(0.1 / 0.5)
    return _classes(_units(spark, sf_dir)).groupBy(*SIDE, "cluster_id").agg(F.round(pull * F.sum("value") / (F.lit(0.5) + F.count(F.lit(1)) * pull), 6).alias("mean"))


@query("SELECT run_id, particle_id, side, unit_id, dense_rank() OVER (PARTITION BY run_id, particle_id, side ORDER BY first) AS cluster_id FROM (SELECT *, min(unit_id) OVER (PARTITION BY run_id, particle_id, side, cluster_id) AS first FROM class)")
def dense_relabel(spark, sf_dir):
    return partitions.relabelled(_asg(spark, sf_dir), SIDE)


@query("SELECT run_id, particle_id, side, unit_id, CASE WHEN cluster_id = 2 THEN 0 WHEN cluster_id > 2 THEN cluster_id - 1 ELSE cluster_id END AS cluster_id FROM class")
def merge_relabel(spark, sf_dir):
    return partitions.merged_labels(_asg(spark, sf_dir), F.lit(0), F.lit(2))


@query("SELECT run_id, particle_id, side, md5(string_agg(first::VARCHAR, ',' ORDER BY unit_id)) AS signature, count(*) AS units FROM (SELECT *, min(unit_id) OVER (PARTITION BY run_id, particle_id, side, cluster_id) AS first FROM class) GROUP BY ALL")
def partition_signature(spark, sf_dir):
    return partitions.signatures(_asg(spark, sf_dir), SIDE)


@query("SELECT run_id, side, particle_id, count(DISTINCT (c1, c2)) = count(DISTINCT c1) AND count(DISTINCT (c1, c2)) = count(DISTINCT c2) AS equal FROM cont GROUP BY ALL")
def partition_equal(spark, sf_dir):
    sig = partitions.signatures(_asg(spark, sf_dir), SIDE)
    first = sig.where("particle_id = 1").select("run_id", "side", F.col("signature").alias("first"))
    return sig.where("particle_id > 1").join(first, ["run_id", "side"]).select("run_id", "side", "particle_id", (F.col("signature") == F.col("first")).alias("equal"))


@query("SELECT run_id, side, unit_id, dense_rank() OVER (PARTITION BY run_id, side ORDER BY c1, c2) AS cluster_id FROM (SELECT a.run_id, a.side, a.unit_id, a.cluster_id AS c1, b.cluster_id AS c2 FROM class a JOIN (SELECT * FROM class WHERE particle_id = 2) b ON a.run_id = b.run_id AND a.side = b.side AND a.unit_id = b.unit_id AND a.particle_id = 1)")
def partition_meet(spark, sf_dir):
    asg = _asg(spark, sf_dir)
    one, two = (asg.where(F.col("particle_id") == p).drop("particle_id") for p in (1, 2))
    return partitions.meet(one, two, ["run_id", "side"])


@query("SELECT a.run_id, a.particle_id, a.side, count(*) AS pairs FROM class a JOIN class b ON (a.run_id, a.particle_id, a.side, a.cluster_id) = (b.run_id, b.particle_id, b.side, b.cluster_id) AND a.unit_id < b.unit_id GROUP BY ALL")
def comembership_counts(spark, sf_dir):
    sizes = partitions.cluster_sizes(_asg(spark, sf_dir), SIDE)
    return sizes.groupBy(*SIDE).agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs")).where("pairs > 0")


def _contingency(spark, sf_dir):
    asg = _asg(spark, sf_dir)
    first = asg.where("particle_id = 1").drop("particle_id")
    others = asg.where("particle_id > 1")
    pairs = first.withColumn("particle_id", F.explode(F.array(*map(F.lit, (2, 3, 4)))))
    return partitions.contingency(pairs, others, ["run_id", "side", "particle_id"])


@query("SELECT run_id, side, particle_id, c1, c2, n FROM cont")
def contingency(spark, sf_dir):
    return _contingency(spark, sf_dir)


def _compared(spark, sf_dir, *columns):
    return _r(partitions.comparison(_contingency(spark, sf_dir), ["run_id", "side", "particle_id"]), *columns).select("run_id", "side", "particle_id", *columns)


@query("SELECT run_id, side, particle_id, round(1 - (p1 + p2 - 2 * p12) / p, 6) AS rand FROM cmp")
def rand_index(spark, sf_dir):
    return _compared(spark, sf_dir, "rand")


@query("SELECT run_id, side, particle_id, round((p12 - p1 * p2 / p) / nullif((p1 + p2) / 2 - p1 * p2 / p, 0), 6) AS adjusted_rand FROM cmp")
def adjusted_rand(spark, sf_dir):
    return _compared(spark, sf_dir, "adjusted_rand")


@query("SELECT run_id, side, particle_id, p1 + p2 - 2 * p12 AS binder, round((p1 + p2 - 2 * p12) * 2 / (n * n), 6) AS binder_scaled FROM cmp")
def binder_loss(spark, sf_dir):
    return _compared(spark, sf_dir, "binder", "binder_scaled")


@query("SELECT run_id, side, particle_id, round(greatest((e1 + e2 - 2 * e12) / n, 0), 6) AS vi FROM cmp")
def vi_ln(spark, sf_dir):
    return _compared(spark, sf_dir, "vi")


@query("SELECT run_id, side, particle_id, round(greatest((e1 + e2 - 2 * e12) / n, 0) / ln(2), 6) AS vi_log2 FROM cmp")
def vi_log2(spark, sf_dir):
    return _compared(spark, sf_dir, "vi_log2")


@query("SELECT run_id, particle_id, side, round(within_ss, 6) AS within_ss FROM wss")
def within_ss(spark, sf_dir):
    return _r(partitions.within_squares(_asg(spark, sf_dir), _values(spark, sf_dir), SIDE, "value"), "within_ss")


@query("SELECT run_id, side, arg_max(k, (bend, -k)) AS elbow FROM (SELECT run_id, side, particle_id + 1 AS k, lag(v) OVER w - 2 * v + lead(v) OVER w AS bend FROM (SELECT *, within_ss AS v FROM wss WHERE particle_id < 4) WINDOW w AS (PARTITION BY run_id, side ORDER BY particle_id)) WHERE bend IS NOT NULL GROUP BY ALL")
def elbow_k(spark, sf_dir):
    path = partitions.within_squares(_asg(spark, sf_dir), _values(spark, sf_dir), SIDE, "value").where("particle_id < 4").withColumn("k", F.col("particle_id") + 1)
    return partitions.elbow(path, ["run_id", "side"], "k", "within_ss")


@query("SELECT side, unit_id, arg_max(cluster_id, (n, -cluster_id)) AS mode, max(n) AS n FROM (SELECT side, unit_id, cluster_id, count(*) AS n FROM class GROUP BY ALL) GROUP BY ALL")
def mode_label(spark, sf_dir):
    return partitions.mode_labels(_asg(spark, sf_dir), ["side", "unit_id"], "cluster_id")


# Priors and weights


@query("SELECT run_id, particle_id, side, round(log_prior, 6) AS log_prior FROM ep")
def prior_ep(spark, sf_dir):
    return _r(weights.prior_py(_asg(spark, sf_dir), SIDE), "log_prior")


@query("SELECT run_id, particle_id, side, round(sum(lgamma(n - 0.25) - lgamma(0.75)) + sum(ln(2 + k * 0.25)) - lgamma(2 + sum(n)) + lgamma(2), 6) AS log_prior FROM (SELECT *, row_number() OVER (PARTITION BY run_id, particle_id, side ORDER BY cluster_id) - 1 AS k FROM sized) GROUP BY ALL")
def prior_py(spark, sf_dir):
    return _r(weights.prior_py(_asg(spark, sf_dir), SIDE, 2.0, 0.25), "log_prior")


@query("SELECT DISTINCT run_id, particle_id, side, 0.0::DOUBLE AS log_prior FROM class")
def prior_uniform(spark, sf_dir):
    return weights.prior_uniform(_asg(spark, sf_dir), SIDE)


_INNER = "SELECT s.run_id, s.particle_id, s.side, s.cluster_id, s.n, (SELECT count(*) // 2 FROM edge) AS total, (SELECT count(*) // 2 FROM ce WHERE (ce.run_id, ce.particle_id, ce.side, ce.c_src) = (s.run_id, s.particle_id, s.side, s.cluster_id) AND c_src = c_dst) AS e FROM sized s"


@query(f"SELECT run_id, particle_id, side, round(sum(lgamma(n) + lgamma(total + 1) - lgamma(e + 1) - lgamma(total - e + 1) + lgamma(e + 200) + lgamma(total - e + 10) - lgamma(total + 210) - (lgamma(200) + lgamma(10) - lgamma(210))), 4) AS log_prior FROM ({_INNER}) GROUP BY ALL")
def cohesion_areal(spark, sf_dir):
    return weights.prior_areal(_edges(spark, sf_dir), _asg(spark, sf_dir), SIDE).withColumn("log_prior", F.round("log_prior", 4))


@query(f"SELECT run_id, particle_id, side, round(sum(lgamma(n) + 2 * e), 6) AS log_prior FROM ({_INNER}) GROUP BY ALL")
def edge_prior(spark, sf_dir):
    return _r(weights.prior_edges(_edges(spark, sf_dir), _asg(spark, sf_dir), SIDE), "log_prior")


@query("SELECT run_id, particle_id, log_post, round(w, 6) AS w FROM wt")
def softmax_weights(spark, sf_dir):
    return _r(_weighted(spark, sf_dir), "w").drop("signature")


@query("SELECT run_id, round(-sum(w * ln(w)), 6) AS entropy FROM uniq WHERE w > 0 GROUP BY run_id")
def weight_entropy(spark, sf_dir):
    return _r(weights.weight_entropy(_weighted(spark, sf_dir)), "entropy")


@query("SELECT run_id, particle_id, round(w, 6) AS w, copies FROM uniq")
def unique_particles(spark, sf_dir):
    return _r(weights.unique_particles(_weighted(spark, sf_dir)), "w").select("run_id", "particle_id", "w", "copies")


@query("SELECT run_id, unit_id, round(sum(w * alpha), 6) AS alpha FROM est JOIN wt USING (run_id, particle_id) GROUP BY ALL")
def bma_estimate(spark, sf_dir):
    return _r(weights.model_average(_weighted(spark, sf_dir), _estimates(spark, sf_dir), "alpha"), "alpha")


@query("SELECT run_id, unit_id, row_number() OVER w AS top, round(sum(w * alpha) OVER w / sum(w) OVER w, 6) AS alpha FROM est JOIN wt USING (run_id, particle_id) WINDOW w AS (PARTITION BY run_id, unit_id ORDER BY w DESC, particle_id ROWS UNBOUNDED PRECEDING)")
def progressive_bma(spark, sf_dir):
    return _r(weights.progressive_average(_weighted(spark, sf_dir), _estimates(spark, sf_dir), "alpha"), "alpha")


@query("SELECT run_id, particle_id, log_post FROM uniq QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY log_post DESC, particle_id) = 1")
def top_particle(spark, sf_dir):
    return weights.top_particles(_weighted(spark, sf_dir)).select("run_id", "particle_id", "log_post")


@query("SELECT run_id, particle_id, log_post, row_number() OVER (PARTITION BY run_id ORDER BY log_post DESC, particle_id) AS rank FROM uniq QUALIFY rank <= 2")
def topk_particles(spark, sf_dir):
    return weights.top_particles(_weighted(spark, sf_dir), 2).select("run_id", "particle_id", "log_post", "rank")


@query("SELECT run_id, min(particle_id) AS particle_id FROM (SELECT *, sum(w) OVER (PARTITION BY run_id ORDER BY particle_id ROWS UNBOUNDED PRECEDING) AS cdf FROM wt) WHERE cdf > 0.6 GROUP BY run_id")
def cdf_sample(spark, sf_dir):
    return weights.drawn_particle(_weighted(spark, sf_dir), 0.6)


@query("SELECT particle_id, round(sqrt(avg((e.alpha - o.alpha) ** 2)), 6) AS rmse FROM est e JOIN ols o USING (run_id, unit_id) GROUP BY ALL")
def rmse(spark, sf_dir):
    joined = _estimates(spark, sf_dir).withColumnRenamed("alpha", "fit").join(_units(spark, sf_dir), ["run_id", "unit_id"])
    return _r(panel.accuracy(joined, ["particle_id"], F.col("alpha"), F.col("fit")), "rmse").select("particle_id", "rmse")


@query("SELECT side, particle_id, round(avg(within_ss), 6) AS mean, round(quantile_cont(within_ss, 0.5), 6) AS median, round(quantile_cont(within_ss, 0.25), 6) AS low, round(quantile_cont(within_ss, 0.75), 6) AS high FROM wss GROUP BY ALL")
def method_summary(spark, sf_dir):
    ss = partitions.within_squares(_asg(spark, sf_dir), _values(spark, sf_dir), SIDE, "value")
    q = lambda p, n: F.round(F.percentile("within_ss", p), 6).alias(n)
    return ss.groupBy("side", "particle_id").agg(F.round(F.avg("within_ss"), 6).alias("mean"), q(0.5, "median"), q(0.25, "low"), q(0.75, "high"))


# Candidates


@query("SELECT run_id, particle_id, side, unit_id, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, particle_id, side, cluster_id ORDER BY value, unit_id) AS low, row_number() OVER (PARTITION BY run_id, particle_id, side, cluster_id ORDER BY value DESC, unit_id) AS high, count(*) OVER (PARTITION BY run_id, particle_id, side, cluster_id) AS n FROM class) WHERE n > 1 AND (low <= ceil(n * 0.05) OR high <= ceil(n * 0.05))")
def island_candidates(spark, sf_dir):
    return moves.island_units(_asg(spark, sf_dir), _values(spark, sf_dir), SIDE, "value")


@query("SELECT DISTINCT ce.run_id, ce.particle_id, ce.side, src AS unit_id, c_src AS from_cluster, c_dst AS to_cluster FROM ce JOIN sized s ON (s.run_id, s.particle_id, s.side, s.cluster_id) = (ce.run_id, ce.particle_id, ce.side, ce.c_src) WHERE c_src <> c_dst AND n > 1")
def border_candidates(spark, sf_dir):
    asg = _asg(spark, sf_dir)
    near = graph.neighbour_clusters(_edges(spark, sf_dir), asg, SIDE)
    return near.join(partitions.cluster_sizes(asg, SIDE).where("n > 1"), [*SIDE, "cluster_id"]).select(*SIDE, "unit_id", F.col("cluster_id").alias("from_cluster"), F.col("neighbour").alias("to_cluster"))


@query("SELECT p.run_id, p.particle_id, p.side, 'merge:' || c1 || ':' || c2 AS cand, count(*) AS units FROM (SELECT DISTINCT run_id, particle_id, side, c_src AS c1, c_dst AS c2 FROM ce WHERE c_src < c_dst) p JOIN class c ON (c.run_id, c.particle_id, c.side) = (p.run_id, p.particle_id, p.side) AND c.cluster_id IN (c1, c2) GROUP BY ALL")
def merge_candidates(spark, sf_dir):
    return moves.merges(_edges(spark, sf_dir), _asg(spark, sf_dir), SIDE).groupBy(*SIDE, "cand").agg(F.count(F.lit(1)).alias("units"))


@query("SELECT run_id, particle_id, side, cluster_id, tail, size, unit_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, particle_id, side, cluster_id, tail ORDER BY CASE WHEN tail = 'left' THEN value ELSE -value END, unit_id) AS rank, ceil(count(*) OVER (PARTITION BY run_id, particle_id, side, cluster_id, tail) * 0.1)::INT AS most FROM class, (SELECT unnest(['left', 'right']) AS tail)) r JOIN (SELECT unnest(range(2, 101))::INT AS size) z ON size <= most AND rank <= size")
def tail_sets(spark, sf_dir):
    return moves.tail_sets(_asg(spark, sf_dir), _values(spark, sf_dir), SIDE, "value").withColumnRenamed("end", "tail")


# Incidents


def _current(spark, sf_dir):
    return current_rows(table(spark, sf_dir, "clean_crime"), "dc_key", ["loaded_at", "crime_id"], ["ngbh", "year", "ucr_general"])


def _region_years(spark, sf_dir):
    return incidents.region_years(_current(spark, sf_dir), table(spark, sf_dir, "tract"), "ngbh", FIRST, LAST)


@query("SELECT region_id, year, violent FROM years")
def panel_melt(spark, sf_dir):
    wide = incidents.crosstab(_region_years(spark, sf_dir), FIRST, LAST)
    return incidents.melted(wide, FIRST, LAST).withColumnRenamed("n", "violent")


@query("SELECT region_id, " + ", ".join(f"sum(violent) FILTER (year = {y})::BIGINT AS y{y}" for y in range(FIRST, LAST + 1)) + " FROM years GROUP BY region_id")
def incident_crosstab(spark, sf_dir):
    return incidents.crosstab(_region_years(spark, sf_dir), FIRST, LAST)


@query("SELECT region_id, year, violent, nonviolent FROM years")
def incident_crosstab_two(spark, sf_dir):
    return _region_years(spark, sf_dir)


@query("SELECT region_id, year, geoid, violent, round(area_sqmile, 6) AS area_sqmile, round(density, 6) AS density, round(asinh(density) - ln(2), 6) AS tr_density FROM dens")
def ihs_density(spark, sf_dir):
    out = incidents.densities(_region_years(spark, sf_dir), table(spark, sf_dir, "tract"))
    return _r(out, "area_sqmile", "density", "tr_density").select("region_id", "year", "geoid", "violent", "area_sqmile", "density", "tr_density")


@query("SELECT region_id, year, violent::DOUBLE AS back FROM dens")
def ihs_inverse(spark, sf_dir):
    out = incidents.densities(_region_years(spark, sf_dir), table(spark, sf_dir, "tract"))
    return out.select("region_id", "year", ihs_count(F.col("tr_density"), F.col("area_sqmile")).alias("back"))


@query("SELECT c.crime_id, c.ucr_general, lower(trim(k.crimetype)) AS kind FROM clean_crime c LEFT JOIN crime_code k ON k.ucr_general = c.ucr_general")
def incident_type_lookup(spark, sf_dir):
    return incidents.with_kind(table(spark, sf_dir, "clean_crime"), table(spark, sf_dir, "crime_code")).select("crime_id", "ucr_general", plain_kind(F.col("kind")).alias("kind"))


_DAY = "CASE WHEN contains(dispatch_date, '/') THEN try_strptime(dispatch_date, '%m/%d/%Y')::DATE ELSE try_cast(dispatch_date[:10] AS DATE) END"


@query(f"SELECT crime_id, strftime(d, '%Y-%m-%d') AS day, strftime(try_cast(strftime(d, '%Y-%m-%d') || ' ' || dispatch_time AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS moment, dayname(d) AS weekday_name, year(d)::INT AS year_of_day, strftime(try_cast('2016-05-08 ' || dispatch_time AS TIMESTAMP), '%H:%M:%S') AS week_time FROM (SELECT *, {_DAY} AS d FROM clean_crime WHERE point_x IS NOT NULL AND point_y IS NOT NULL AND NOT isnan(point_x) AND NOT isnan(point_y))")
def incident_times(spark, sf_dir):
    rows = incidents.with_times(incidents.with_points(table(spark, sf_dir, "clean_crime")))
    moment = F.when(F.col("day").isNotNull(), F.date_format("moment", "yyyy-MM-dd HH:mm:ss"))
    return rows.select("crime_id", F.date_format("day", "yyyy-MM-dd").alias("day"), moment.alias("moment"), "weekday_name", "year_of_day", F.date_format("week_time", "HH:mm:ss").alias("week_time"))


@query("SELECT region_id, year, violent, row_number() OVER (PARTITION BY year ORDER BY violent DESC, region_id) AS place FROM years")
def region_order(spark, sf_dir):
    """Regions of each year from the most to the least violent incidents, in that order."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("violent"), "region_id"))
    return _region_years(spark, sf_dir).select("region_id", "year", "violent", place.alias("place")).orderBy("year", "place")


@query("SELECT crime_id, strftime(loaded_at, '%Y-%m-%d') AS loaded FROM clean_crime")
def incident_order(spark, sf_dir):
    """Incidents in the order of their time."""
    rows = incidents.in_order(table(spark, sf_dir, "clean_crime").select("crime_id", "loaded_at", "timedate"), "timedate")
    return rows.select("crime_id", F.date_format("loaded_at", "yyyy-MM-dd").alias("loaded"))


def incident_clean(spark, sf_dir):
    """Incidents with known points inside of a region, their kind, times and region."""
    rows = incidents.with_times(incidents.with_points(table(spark, sf_dir, "clean_crime")))
    rows = incidents.with_kind(rows.select("crime_id", "ucr_general", "point_x", "point_y", "day", "year_of_day", "weekday_name"), table(spark, sf_dir, "crime_code"))
    out = incidents.with_region(rows, table(spark, sf_dir, "tract"))
    return out.select("crime_id", "kind", F.date_format("day", "yyyy-MM-dd").alias("day"), "year_of_day", "weekday_name", "region")


def _incident_clean_sql() -> str:
    from .problems import _BOXES, _POINTS, _SIDES, _WITHIN

    return f"WITH {_POINTS}, {_SIDES}, {_BOXES}, {_WITHIN} SELECT c.crime_id, k.crimetype AS kind, strftime({_DAY}, '%Y-%m-%d') AS day, year({_DAY})::INT AS year_of_day, dayname({_DAY}) AS weekday_name, region_id AS region FROM within_tract w JOIN clean_crime c ON c.crime_id = w.crime_id LEFT JOIN crime_code k ON k.ucr_general = c.ucr_general"


QUERIES["incident_clean"], SQL["incident_clean"] = incident_clean, _incident_clean_sql()


# Scores


def cluster_score(spark, sf_dir):
    """Quadratic form and log determinant of every cluster."""
    units = _units(spark, sf_dir)
    return score.scored_clusters(_asg(spark, sf_dir), units, _edges(spark, sf_dir), panel.default_hyperparameters(units), SIDE).select(*SIDE, "cluster_id", "n", "quad", "log_det")


def particle_score(spark, sf_dir):
    """Log likelihood, prior and posterior of every particle."""
    return score.scored_particles(_asg(spark, sf_dir), _units(spark, sf_dir), _edges(spark, sf_dir))


QUERIES |= {f.__name__: f for f in (cluster_score, particle_score)}
