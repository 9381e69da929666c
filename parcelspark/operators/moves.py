"""Candidate changes of partitions, all runs and particles at once.

A candidate is a set of rows keys, cand, unit_id, cluster_id: the new labels of the units of the
clusters that it touches (its other units keep theirs). Labels of new clusters are the negative of
a unit of theirs, so they cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import over_cores
from .graph import cluster_adjacency, neighbour_clusters


def _named(kind: str, *parts: str):
    return F.concat_ws(":", F.lit(kind), *parts)


def valued(assignment: DataFrame, values: DataFrame | None, keys: list[str], value: str = "value") -> DataFrame:
    """The assignment with the units' values; values has any of the keys. Without values the assignment has the column itself."""
    if values is None:
        return assignment
    on = [c for c in values.columns if c in (*keys, "unit_id")]
    return assignment.join(values.select(*on, value), on)


def island_units(assignment: DataFrame, values: DataFrame, keys: list[str], value: str, share: float = 0.05) -> DataFrame:
    """The ceil(share · n) lowest and highest units of each cluster of over one unit; of equals the lower unit_id first, each unit once."""
    rows = valued(assignment, values, keys, value)
    w = Window.partitionBy(*keys, "cluster_id")
    ranked = rows.withColumns({"low": F.row_number().over(w.orderBy(F.asc(value), "unit_id")), "high": F.row_number().over(w.orderBy(F.desc(value), "unit_id")), "n": F.count(F.lit(1)).over(w)})
    few = F.ceil(F.col("n") * share)
    return ranked.where((F.col("n") > 1) & ((F.col("low") <= few) | (F.col("high") <= few))).select(*keys, "unit_id", "cluster_id")


def tail_sets(assignment: DataFrame, values: DataFrame, keys: list[str], value: str, share: float = 0.1) -> DataFrame:
    """end, size, unit_id: growing sets of 2..ceil(share · n) lowest (left) and highest (right) units of each cluster."""
    rows = valued(assignment, values, keys, value)
    w = Window.partitionBy(*keys, "cluster_id")
    ranked = rows.withColumn("most", F.ceil(F.count(F.lit(1)).over(w) * share).cast("int"))
    sides = [ranked.withColumn("end", F.lit(s)).withColumn("rank", F.row_number().over(w.orderBy(o, "unit_id"))) for s, o in (("left", F.asc(value)), ("right", F.desc(value)))]
    both = sides[0].unionByName(sides[1]).where((F.col("most") >= 2) & (F.col("rank") <= F.col("most")))
    sizes = F.explode(F.sequence(F.greatest(F.col("rank"), F.lit(2)), F.col("most"))).alias("size")
    return both.select(*keys, "cluster_id", "end", sizes, "unit_id")


def merges(edges: DataFrame, assignment: DataFrame, keys: list[str]) -> DataFrame:
    """Parts: each pair of adjacent clusters becomes one."""
    pairs = cluster_adjacency(edges, assignment, keys)
    touched = pairs.select(*keys, "c1", "c2", F.explode(F.array("c1", "c2")).alias("cluster_id"))
    return touched.join(assignment, [*keys, "cluster_id"]).select(*keys, _named("merge", "c1", "c2").alias("cand"), "unit_id", F.lit(1).alias("part"))


def _pieces(units: np.ndarray, part: np.ndarray, near: list) -> np.ndarray:
    """The least unit of each unit's component within its part; units ascend."""
    place = {int(u): i for i, u in enumerate(units)}
    label = np.zeros(len(units), int)
    for i, u in enumerate(units):
        if not label[i]:
            label[i], todo = u, [i]
            while todo:
                j = todo.pop()
                for v in near[j] if near[j] is not None else ():
                    k = place.get(int(v))
                    if k is not None and not label[k] and part[k] == part[j]:
                        label[k] = u
                        todo.append(k)
    return label


def cut(edges: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates from parts (keys, cand, unit_id, part): each part is cut into its components; the new labels are negative. One call serves all families.

    The units of one candidate, which are those of the clusters that it touches, are cut in one task; unit ids are above 0.
    """
    by = [*keys, "cand"]
    types = dict(parts.dtypes)
    near = edges.groupBy(F.col("src").alias("unit_id")).agg(F.collect_set("dst").alias("near"))
    packed = parts.join(near, "unit_id", "left").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("unit_id").cast("int").alias("unit_id"), F.col("part").cast("int").alias("part"), "near"))).alias("m"))
    flat = packed.select(*by, F.col("m.unit_id").alias("units"), F.col("m.part").alias("part"), F.col("m.near").alias("near"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            labels = [_pieces(np.asarray(u), np.asarray(p), n) for u, p, n in zip(batch["units"], batch["part"], batch["near"])]
            yield batch[[*by, "units"]].assign(labels=labels)

    made = over_cores(flat).mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in by) + ", units array<int>, labels array<int>")
    rows = made.select(*by, F.explode(F.arrays_zip("units", "labels")).alias("u"))
    return rows.select(*by, F.col("u.units").cast(types["unit_id"]).alias("unit_id"), (-F.col("u.labels")).cast(types["unit_id"]).alias("cluster_id"))


def islands(assignment: DataFrame, values: DataFrame, keys: list[str], value: str, share: float = 0.05) -> DataFrame:
    """Parts: each unit of island_units alone, and the rest of its cluster."""
    chosen = island_units(assignment, values, keys, value, share).select(*keys, "cluster_id", F.col("unit_id").alias("alone"))
    return chosen.join(assignment, [*keys, "cluster_id"]).select(*keys, _named("island", "alone").alias("cand"), "unit_id", (F.col("unit_id") == F.col("alone")).cast("int").alias("part"))


def borders(edges: DataFrame, assignment: DataFrame, keys: list[str]) -> DataFrame:
    """Parts: a unit of a cluster of over one unit goes to an adjacent cluster, and what it leaves."""
    sizes = assignment.groupBy(*keys, "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    movers = neighbour_clusters(edges, assignment, keys).join(sizes.where(F.col("n") > 1), [*keys, "cluster_id"]).select(*keys, "cluster_id", "neighbour", F.col("unit_id").alias("mover"))
    name = _named("border", "mover", "neighbour").alias("cand")
    touched = movers.select(*keys, name, "mover", "neighbour", F.explode(F.array("cluster_id", "neighbour")).alias("cluster_id")).join(assignment, [*keys, "cluster_id"])
    goes = (F.col("unit_id") == F.col("mover")) | (F.col("cluster_id") == F.col("neighbour"))
    return touched.select(*keys, "cand", "unit_id", goes.cast("int").alias("part"))


def kmeans_splits(assignment: DataFrame, values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, cluster_id, unit_id, part: the exact two-means split of each cluster of over two units by value.

    In one dimension the best split is a cut in sorted order; sums before each cut give its
    sum of squares. Of equal cuts the lowest is taken. A cluster whose values are all equal has none.
    """
    rows = valued(assignment, values, keys, value)
    w = Window.partitionBy(*keys, "cluster_id")
    before = w.orderBy(value, "unit_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"rank": F.row_number().over(w.orderBy(value, "unit_id")), "head": F.sum(value).over(before), "all": F.sum(value).over(w), "n": F.count(F.lit(1)).over(w), "spread": F.max(value).over(w) - F.min(value).over(w)})
    rows = rows.where((F.col("n") > 2) & (F.col("spread") > 0))
    between = F.when(F.col("rank") < F.col("n"), F.pow("head", 2) / F.col("rank") + F.pow(F.col("all") - F.col("head"), 2) / F.nullif(F.col("n") - F.col("rank"), F.lit(0)))
    best = F.max(F.struct(F.round(between, 9).alias("between"), (-F.col("rank")).alias("minus"))).over(w)
    return rows.withColumn("cut", -best["minus"]).select(*keys, "cluster_id", "unit_id", (F.col("rank") > F.col("cut")).cast("int").alias("part"))


def splits(assignment: DataFrame, values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Parts of the clusters cut by kmeans_splits."""
    return kmeans_splits(assignment, values, keys, value).select(*keys, _named("split", "cluster_id").alias("cand"), "unit_id", "part")


def tails(assignment: DataFrame, values: DataFrame, keys: list[str], value: str, share: float = 0.1) -> DataFrame:
    """Parts: a tail of tail_sets, and the rest of its cluster."""
    sets = tail_sets(assignment, values, keys, value, share)
    names = sets.select(*keys, "cluster_id", "end", "size").distinct()
    all_units = names.join(assignment, [*keys, "cluster_id"])
    marked = all_units.join(sets.withColumn("part", F.lit(1)), [*keys, "cluster_id", "end", "size", "unit_id"], "left")
    return marked.select(*keys, _named("tail", "cluster_id", "end", "size").alias("cand"), "unit_id", F.coalesce("part", F.lit(0)).alias("part"))
