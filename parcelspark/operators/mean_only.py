"""The model with levels alone: its score, and its own candidate moves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ln_gamma_int
from ..session import over_cores, written
from .compare import kmeans_path, spectral_path
from .graph import cluster_adjacency, connected_clusters, nearest_clusters
from .kernel import cluster_stats, packed
from .local import Graph, local_islands
from .moves import cut
from .parts import both_tails, join_all, join_in_turn, kmeans_parts, nearest_outside, packed_values, spectral_cuts, wide_down, wide_up
from .score import neighbour_lists

#: The most units of a partition whose candidates one task lists; candidates of one batch.
ONE_TASK, LISTED = 2_000, 500


def level_units(panel: DataFrame, hyper: DataFrame) -> DataFrame:
    """run_id, side, unit_id, b, w, c1, c2 of the levels, and ss (squares around the unit's mean), mean, periods.

    hyper: run_id, a1, a2. Rows with a null y do not count.
    """
    units = panel.where(F.col("y").isNotNull()).groupBy("run_id", "unit_id").agg(F.count(F.lit(1)).alias("periods"), F.avg("y").alias("mean"), (F.var_pop("y") * F.count(F.lit(1))).alias("ss"))
    return units.join(hyper.select("run_id", F.col("a1").alias("c1"), F.col("a2").alias("c2")), "run_id").withColumns({"side": F.lit("A"), "b": F.col("periods") * F.col("mean"), "w": F.col("periods").cast("double")})


def mean_only_scores(assignment: DataFrame, panel: DataFrame, edges: DataFrame, hyper: DataFrame, rho: float = 0.9, eta: float = 1.0) -> DataFrame:
    """run_id, particle_id, log_like, log_prior, log_post of partitions of the levels.

    hyper: run_id, a1, a2, nu, lambda. With S = a1 M⁻¹ + a2 11ᵀ + I/T, ȳᵀS⁻¹ȳ and ln|S⁻¹| follow from
    the cluster numbers: T Σȳ² + quad, and logdet + n ln T. The likelihood is ½ Σ logdet - (nu + NT)/2 ·
    ln((nu·lambda + Σ quad + SS)/2), and a cluster's prior ln η + ln Γ(n).
    """
    keys = ["run_id", "particle_id", "side"]
    units = level_units(panel, hyper)
    stats = cluster_stats(packed(assignment.where(F.col("side") == "A"), units, neighbour_lists(edges), keys), keys, rho)
    sums = stats.groupBy("run_id", "particle_id").agg(F.sum("quad").alias("quad"), F.sum("log_det").alias("log_det"), F.sum(F.lit(math.log(eta)) + ln_gamma_int(F.col("n"))).alias("log_prior"))
    whole = units.groupBy("run_id").agg(F.sum("ss").alias("ss"), F.sum(F.col("periods") * F.col("mean") ** 2).alias("yy"), F.sum("periods").alias("obs"), F.sum(F.ln("periods")).alias("ln_t"))
    rows = sums.join(whole, "run_id").join(hyper.select("run_id", "nu", F.col("lambda").alias("_lambda")), "run_id")
    like = (F.col("log_det") + F.col("ln_t")) / 2 - (F.col("nu") + F.col("obs")) / 2 * F.ln((F.col("nu") * F.col("_lambda") + F.col("yy") + F.col("quad") + F.col("ss")) / 2)
    return rows.select("run_id", "particle_id", like.alias("log_like"), "log_prior", (like + F.col("log_prior")).alias("log_post"))


def equal_sides(assignment: DataFrame) -> DataFrame:
    """Side A's partition on both sides."""
    return assignment.where(F.col("side") == "A").withColumn("side", F.explode(F.array(F.lit("A"), F.lit("B"))))


def nearest_merges(edges: DataFrame, assignment: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Parts: each cluster joins the nearest of its adjacent clusters with a greater label."""
    on = [c for c in values.columns if c in (*keys, "unit_id")]
    means = assignment.join(values.select(*on, "value"), on).groupBy(*keys, "cluster_id").agg(F.avg("value").alias("mean"))
    side = lambda c, m: means.select(*keys, F.col("cluster_id").alias(c), F.col("mean").alias(m))
    pairs = cluster_adjacency(edges, assignment, keys).join(side("c1", "m1"), [*keys, "c1"]).join(side("c2", "m2"), [*keys, "c2"])
    best = pairs.groupBy(*keys, "c1").agg(F.min_by("c2", F.struct(F.abs(F.col("m1") - F.col("m2")), "c2")).alias("c2"))
    touched = best.select(*keys, "c1", "c2", F.explode(F.array("c1", "c2")).alias("cluster_id")).join(assignment, [*keys, "cluster_id"])
    return touched.select(*keys, F.concat_ws(":", F.lit("merge"), "c1", "c2").alias("cand"), "unit_id", F.lit(1).alias("part"))


def border_blocks(edges: DataFrame, assignment: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Parts: each cluster takes in all units of its nearest adjacent cluster that touch it; none if nothing would be left there."""
    near = nearest_clusters(edges, assignment, values, keys).where(F.col("nearest") >= 0)
    cross = edges.join(assignment.withColumnRenamed("unit_id", "src").withColumnRenamed("cluster_id", "c1"), "src").join(assignment.withColumnRenamed("unit_id", "dst").withColumnRenamed("cluster_id", "c2"), [*keys, "dst"])
    takes = cross.join(near.select(*keys, F.col("cluster_id").alias("c1"), F.col("nearest").alias("c2")), [*keys, "c1", "c2"]).select(*keys, "c1", "c2", F.col("dst").alias("unit_id")).distinct()
    few = takes.groupBy(*keys, "c1", "c2").agg(F.count(F.lit(1)).alias("taken")).join(assignment.groupBy(*keys, F.col("cluster_id").alias("c2")).agg(F.count(F.lit(1)).alias("n")), [*keys, "c2"]).where(F.col("taken") < F.col("n"))
    touched = few.select(*keys, "c1", "c2", F.explode(F.array("c1", "c2")).alias("cluster_id")).join(assignment, [*keys, "cluster_id"])
    marked = touched.join(takes.withColumn("goes", F.lit(1)), [*keys, "c1", "c2", "unit_id"], "left")
    part = F.when((F.col("cluster_id") == F.col("c1")) | F.col("goes").isNotNull(), 1).otherwise(0)
    return marked.select(*keys, F.concat_ws(":", F.lit("block"), "c1", "c2").alias("cand"), "unit_id", part.alias("part"))


def far_units(assignment: DataFrame, values: DataFrame, keys: list[str], share: float = 0.05) -> DataFrame:
    """The ceil(share · n) units of each cluster of over one unit whose value is farthest from the cluster's mean; of equals the lower unit_id first."""
    on = [c for c in values.columns if c in (*keys, "unit_id")]
    w = Window.partitionBy(*keys, "cluster_id")
    rows = assignment.join(values.select(*on, "value"), on).withColumns({"_off": F.abs(F.col("value") - F.avg("value").over(w)), "_n": F.count(F.lit(1)).over(w)})
    ranked = rows.withColumn("_rank", F.row_number().over(w.orderBy(F.desc("_off"), "unit_id")))
    return ranked.where((F.col("_n") > 1) & (F.col("_rank") <= F.ceil(F.col("_n") * share))).select(*keys, "unit_id", "cluster_id")


def _island_parts(assignment: DataFrame, values: DataFrame, keys: list[str], share: float) -> DataFrame:
    far = far_units(assignment, values, keys, share).select(*keys, "cluster_id", F.col("unit_id").alias("alone")).join(assignment, [*keys, "cluster_id"])
    return far.select(*keys, F.concat_ws(":", F.lit("island"), "alone").alias("cand"), "unit_id", (F.col("unit_id") == F.col("alone")).cast("int").alias("part"))


def _with_all_joined(edges: DataFrame, assignment: DataFrame, values: DataFrame, keys: list[str], cands: DataFrame) -> DataFrame:
    """cands, and for each island of them the candidate ">>all": the island and every piece of the rest join their nearest outside clusters at once; pieces that have none stay."""
    cands = written(cands, "cands")
    islands = cands.where(F.col("cand").startswith("island:"))
    nearest = written(nearest_outside(edges, assignment, values, keys, islands), "nearest")
    return cands.unionByName(join_all(assignment, keys, islands, nearest))


def candidates(edges: DataFrame, assignment: DataFrame, values: DataFrame, keys: list[str], share: float = 0.05) -> DataFrame:
    """Nearest merges, border blocks, and far units alone: beside the rest, in components, and with all of these pieces joined to their nearest outside clusters."""
    parts = nearest_merges(edges, assignment, values, keys).unionByName(border_blocks(edges, assignment, values, keys)).unionByName(_island_parts(assignment, values, keys, share))
    return _with_all_joined(edges, assignment, values, keys, cut(edges, parts, keys))


def local_candidates(edges: DataFrame, assignment: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """The island candidates of every unit, for where no other candidate is better.

    Partitions of at most ONE_TASK units are one row each, whose candidates a task lists one after the other; nothing is joined or broadcast for
    them. Larger ones go through joins.
    """
    largest = assignment.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"]
    if (largest or 0) <= ONE_TASK:
        return _local_in_tasks(edges, assignment, values, keys)
    return _with_all_joined(edges, assignment, values, keys, cut(edges, _island_parts(assignment, values, keys, 1.0), keys))


def _local_in_tasks(edges: DataFrame, assignment: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    on = [c for c in values.columns if c in (*keys, "unit_id")]
    own = values.select(*on, F.col("value").cast("double").alias("value"), F.lit(True).alias("has"))
    rows = assignment.join(own.hint("merge"), on, "left").join(neighbour_lists(edges), "unit_id", "left")
    member = F.struct("unit_id", F.col("cluster_id").cast("bigint").alias("label"), "value", F.coalesce("has", F.lit(False)).alias("has"), "neighbours")
    m = F.array_sort(F.collect_list(member), lambda p, q: (p["unit_id"] - q["unit_id"]).cast("int"))
    flat = rows.groupBy(*keys).agg(m.alias("m")).select(*keys, *[F.col("m")[c].alias(f"_{c}") for c in ("unit_id", "label", "value", "has", "neighbours")])
    types = dict(assignment.dtypes)
    unit = types["unit_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                graph = Graph(r["_unit_id"], r["_neighbours"])
                made: list[tuple[str, list[int], list[int]]] = []
                value = np.array([np.nan if v is None else v for v in r["_value"]], float)
                for cand in local_islands(graph, np.array(r["_label"], np.int64), value, np.array(r["_has"])):
                    made.append(cand)
                    if len(made) == LISTED:
                        yield listed(batch, r, graph, made)
                        made = []
                if made:
                    yield listed(batch, r, graph, made)

    def listed(batch: pa.RecordBatch, r: dict, graph: Graph, made: list[tuple[str, list[int], list[int]]]) -> pa.RecordBatch:
        sizes = [len(at) for _, at, _ in made]
        kind = batch.schema.field("_unit_id").type.value_type
        head = [pa.repeat(pa.scalar(r[k], batch.schema.field(k).type), sum(sizes)) for k in keys]
        names = pa.array([name for name, *_ in made]).take(pa.array(np.repeat(np.arange(len(made)), sizes)))
        units = graph.units[np.concatenate([at for _, at, _ in made])]
        return pa.RecordBatch.from_arrays([*head, names, pa.array(units).cast(kind), pa.array(np.concatenate([label for *_, label in made]).astype(np.int64)).cast(kind)], names=[*keys, "cand", "unit_id", "cluster_id"])

    return over_cores(flat).mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + f", cand string, unit_id {unit}, cluster_id {unit}")


def split_candidates(edges: DataFrame, assignment: DataFrame, values: DataFrame, keys: list[str], share: float = 0.025) -> DataFrame:
    """Cuts of every cluster by spectral parts, k-means and tails, and after each cut its first 1, 2, ... pieces joined to their nearest outside clusters."""
    parts = spectral_cuts(assignment, values, neighbour_lists(edges), keys, wide_up).unionByName(kmeans_parts(assignment, values, keys, wide_down)).unionByName(both_tails(assignment, values, keys, share))
    pieces = written(cut(edges, parts, keys), "pieces")
    nearest = written(nearest_outside(edges, assignment, values, keys, pieces), "nearest")
    return pieces.unionByName(join_in_turn(assignment, keys, pieces, nearest))


def class_paths(panel: DataFrame, edges: DataFrame, hyper: DataFrame, most: int = 5, rho: float = 0.9, eta: float = 1.0) -> DataFrame:
    """run_id, method (kmeans, spectral), k, connected, clusters, log_like, log_prior, log_post: the best 1..most classes of the units' means, as they are and cut into connected clusters.

    hyper as in mean_only_scores. A run whose means are all equal has no spectral classes.
    """
    units = level_units(panel, hyper).select("run_id", "unit_id", F.col("mean").alias("value"))
    whole = units.select("run_id", F.lit(1).alias("cluster_id"), "unit_id")
    spectral = spectral_path(packed_values(whole, units, neighbour_lists(edges), ["run_id"]), ["run_id"], lambda n: range(1, most + 1))
    made = kmeans_path(units, ["run_id"], most).select("run_id", F.lit("kmeans").alias("method"), "k", "unit_id", "cluster_id")
    made = made.unionByName(spectral.select("run_id", F.lit("spectral").alias("method"), "k", "unit_id", F.col("part").alias("cluster_id")))
    coded = F.when(F.col("method") == "kmeans", 0).otherwise(2 * most) + 2 * (F.col("k") - 1)
    raw = written(made.select("run_id", (coded + 1).cast("int").alias("particle_id"), F.lit("A").alias("side"), "unit_id", "cluster_id"), "classes")
    keys = ["run_id", "particle_id", "side"]
    joined = connected_clusters(edges, raw, keys).withColumn("particle_id", (F.col("particle_id") + 1).cast("int"))
    both = written(raw.unionByName(joined.select(*raw.columns)), "paths")
    count = both.groupBy("run_id", "particle_id").agg(F.count_distinct("cluster_id").alias("clusters"))
    code = F.col("particle_id") - 1
    rows = mean_only_scores(both, panel, edges, hyper, rho, eta).join(count, ["run_id", "particle_id"])
    method = F.when(code < 2 * most, "kmeans").otherwise("spectral")
    return rows.select("run_id", method.alias("method"), (F.floor(code / 2) % most + 1).cast("int").alias("k"), (code % 2 == 1).alias("connected"), "clusters", "log_like", "log_prior", "log_post")


def uncovered(assignment: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """keys, unit_id, fault: units of a run that a partition leaves out, holds twice or that the run does not have; none if all is well. units: run_id, unit_id."""
    have = assignment.groupBy(*keys, "unit_id").agg(F.count(F.lit(1)).alias("n"))
    want = assignment.select(*keys).distinct().join(units.select("run_id", "unit_id").distinct().withColumn("_known", F.lit(1)), "run_id")
    both = have.join(want, [*keys, "unit_id"], "full")
    fault = F.when(F.col("n").isNull(), "left out").when(F.col("_known").isNull(), "unknown").when(F.col("n") > 1, "held twice")
    return both.withColumn("fault", fault).where(F.col("fault").isNotNull()).select(*keys, "unit_id", "fault")
