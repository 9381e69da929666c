"""Graphs of units (src, dst, both directions) and partitions on them.

An assignment has key columns, unit_id and cluster_id: one partition of the units per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, written

#: Places for the edges of one graph; vertices that a task holds before it hands stars on; the most stars of a graph that is finished in one place.
SALTS, HELD, ONE_TASK = 16, 1_000_000, 1_000_000


def lattice_edges(units: DataFrame, unit: str = "unit_id") -> DataFrame:
    """The square lattice over the ids 1..n in rows of ceil(sqrt n): neighbours left, right, above, below; the last row may be short."""
    ids = units.select(F.col(unit).cast("int").alias("src")).where(F.col("src").isNotNull()).distinct()
    side = ids.agg(F.ceil(F.sqrt(F.max("src"))).cast("int").alias("side"), F.max("src").alias("n")).first()
    if side["n"] is None:
        return ids.select("src", F.col("src").alias("dst"))
    width, n = F.lit(side["side"]), side["n"]
    column = (F.col("src") - 1) % width
    near = F.array(F.when(column > 0, F.col("src") - 1), F.when(column < width - 1, F.col("src") + 1), F.col("src") - width, F.col("src") + width)
    edges = ids.select("src", F.explode(near).alias("dst")).where(F.col("dst").between(1, n))
    return edges.join(ids.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")


def contiguity(regions: DataFrame, region: str = "region_id", ring: str = "ring") -> DataFrame:
    """Regions that share a corner, both directions, by an equi-join on the corners."""
    corners = regions.select(F.col(region).alias("src"), F.explode(ring).alias("p")).select("src", F.col("p.x").alias("x"), F.col("p.y").alias("y")).distinct()
    return corners.join(corners.withColumnRenamed("src", "dst"), ["x", "y"]).where(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """unit_id, degree."""
    return edges.groupBy(F.col("src").alias("unit_id")).agg(F.count(F.lit(1)).alias("degree"))


def clustered_edges(edges: DataFrame, assignment: DataFrame, keys: list[str]) -> DataFrame:
    """keys, src, dst, c_src, c_dst: each edge with the clusters of its ends, in every partition."""
    a = assignment.select(*keys, F.col("unit_id").alias("src"), F.col("cluster_id").alias("c_src"))
    b = assignment.select(*keys, F.col("unit_id").alias("dst"), F.col("cluster_id").alias("c_dst"))
    return a.join(edges.select("src", "dst"), "src").join(b, [*keys, "dst"]).select(*keys, "src", "dst", "c_src", "c_dst")


def cluster_adjacency(edges: DataFrame, assignment: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of adjacent clusters, c1 < c2, with the number of edges between them."""
    cross = clustered_edges(edges, assignment, keys).where(F.col("c_src") < F.col("c_dst"))
    return cross.groupBy(*keys, F.col("c_src").alias("c1"), F.col("c_dst").alias("c2")).agg(F.count(F.lit(1)).alias("edges"))


def border_pairs(edges: DataFrame, assignment: DataFrame, keys: list[str]) -> DataFrame:
    """Edges src < dst whose ends lie in different clusters."""
    return clustered_edges(edges, assignment, keys).where((F.col("src") < F.col("dst")) & (F.col("c_src") != F.col("c_dst"))).select(*keys, "src", "dst")


def neighbour_clusters(edges: DataFrame, assignment: DataFrame, keys: list[str]) -> DataFrame:
    """unit_id, cluster_id, neighbour: the other clusters that touch each unit."""
    cross = clustered_edges(edges, assignment, keys).where(F.col("c_src") != F.col("c_dst"))
    return cross.select(*keys, F.col("src").alias("unit_id"), F.col("c_src").alias("cluster_id"), F.col("c_dst").alias("neighbour")).distinct()


def nearest_clusters(edges: DataFrame, assignment: DataFrame, values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """cluster_id, nearest: the adjacent cluster whose mean of value is nearest, the lowest id of equals, -1 if there is none.

    values: keys (or some of them), unit_id and value. A cluster without a mean is nobody's nearest.
    """
    on = [c for c in values.columns if c in (*keys, "unit_id")]
    means = assignment.join(values, on).groupBy(*keys, "cluster_id").agg(F.avg(value).alias("mean"))
    pairs = cluster_adjacency(edges, assignment, keys)
    both = pairs.select(*keys, "c1", "c2").unionByName(pairs.select(*keys, F.col("c2").alias("c1"), F.col("c1").alias("c2")))
    own = means.select(*keys, F.col("cluster_id").alias("c1"), F.col("mean").alias("m1"))
    other = means.select(*keys, F.col("cluster_id").alias("c2"), F.col("mean").alias("m2"))
    gaps = both.join(own, [*keys, "c1"]).join(other, [*keys, "c2"]).withColumn("gap", F.abs(F.col("m1") - F.col("m2"))).where(F.col("gap").isNotNull())
    best = gaps.groupBy(*keys, F.col("c1").alias("cluster_id")).agg(F.min_by("c2", F.struct("gap", "c2")).alias("nearest"))
    return assignment.select(*keys, "cluster_id").distinct().join(best, [*keys, "cluster_id"], "left").select(*keys, "cluster_id", F.coalesce("nearest", F.lit(-1)).alias("nearest"))


def _contracted(keys: list[str], types: dict[str, str]):
    """Edges of a task as stars: each vertex with the least one that the task's edges join it to. Graphs of a task that hold more than HELD vertices are handed on in turns, which leaves more stars, never wrong ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def root(v: tuple) -> tuple:
            top = v
            while above[top] != top:
                top = above[top]
            while above[v] != top:
                above[v], v = top, above[v]
            return top

        def stars() -> pa.RecordBatch:
            rows = [(*v, root(v)[-1]) for v in above if above[v] != v]
            columns = list(zip(*rows)) if rows else [()] * (len(keys) + 2)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[*keys, "src", "dst"])

        kinds = None
        for batch in batches:
            kinds = [f.type for f in batch.schema]
            for *graph, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                ends = [(*graph, v) for v in (a, b)]
                for v in ends:
                    above.setdefault(v, v)
                low, high = sorted(map(root, ends), key=lambda v: v[-1])
                above[high] = low
            if len(above) > HELD:
                yield stars()
                above.clear()
        if kinds is not None:
            yield stars()

    return run, ", ".join(f"`{k}` {types[k]}" for k in [*keys, "src", "dst"])


def components(vertices: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, unit_id, component: the least unit of each connected component, in every graph at once.

    edges: keys, src, dst, in both directions. Tasks first turn their share of the edges into stars, a graph's share
    in SALTS places. Graphs of at most ONE_TASK stars are finished in one more pass, a graph in a place; the stars of larger ones go
    through rounds: each takes the least label among the neighbours, then the label of the label, so the rounds
    grow with the logarithm of the longest path, and no task holds a component.
    """
    types = dict(edges.dtypes)
    work, schema = _contracted(keys, types)
    shares = edges.select(*keys, "src", "dst").where(F.col("src") != F.col("dst")).repartition(*keys, F.pmod(F.xxhash64("src"), F.lit(SALTS)))
    stars = written(shares.mapInArrow(work, schema), "stars")
    sizes = stars.groupBy(*keys).agg((F.count(F.lit(1)) > ONE_TASK).alias("_large"))
    sized = stars.join(sizes, keys)
    labels = sized.where(~F.col("_large")).select(*keys, "src", "dst").repartition(*keys).mapInArrow(work, schema)
    large = sized.where("_large").select(*keys, "src", "dst")
    if not sizes.where("_large").isEmpty():
        labels = labels.unionByName(_by_rounds(large, keys))
    labels = labels.groupBy(*keys, F.col("src").alias("unit_id")).agg(F.min("dst").alias("_least"))
    return vertices.join(labels, [*keys, "unit_id"], "left").select(*keys, "unit_id", F.least("unit_id", F.col("_least").cast(dict(vertices.dtypes)["unit_id"])).alias("component"))


def _by_rounds(stars: DataFrame, keys: list[str]) -> DataFrame:
    """keys, src, dst: each vertex with the least one of its component; every second round is written to the shared folder, which cuts lineage."""
    both = stars.unionByName(stars.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")))
    edges = written(both.distinct(), "edges")
    labels = edges.select(*keys, F.col("src").alias("unit_id")).distinct().withColumn("component", F.col("unit_id"))
    salt = F.pmod(F.xxhash64("unit_id"), F.lit(SALTS))

    def spread(labels: DataFrame) -> DataFrame:
        near = edges.join(labels.withColumnRenamed("unit_id", "dst"), [*keys, "dst"]).groupBy(*keys, F.col("src").alias("unit_id")).agg(F.min("component").alias("near"))
        low = labels.join(near, [*keys, "unit_id"]).select(*keys, "unit_id", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        held = low.select(*keys, "low").distinct().join(low.select(*keys, F.col("unit_id").alias("low"), F.col("low").alias("far")), [*keys, "low"])
        jump = held.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a label may be that of most vertices
        return low.withColumn("_salt", salt).join(jump, [*keys, "low", "_salt"]).select(*keys, "unit_id", "old", F.least("low", "far").alias("component"))

    while True:
        labels, before = written(spread(spread(labels).drop("old")), "labels"), labels
        if labels.where(F.col("old") != F.col("component")).isEmpty():
            return labels.select(*keys, F.col("unit_id").alias("src"), F.col("component").alias("dst"))
        if "old" in before.columns:
            dropped(before)


def connected_clusters(edges: DataFrame, assignment: DataFrame, keys: list[str]) -> DataFrame:
    """The assignment with every cluster cut into its connected components; cluster_id is then the component's least unit."""
    inner = clustered_edges(edges, assignment, keys).where(F.col("c_src") == F.col("c_dst"))
    return components(assignment, inner, keys).withColumnRenamed("component", "cluster_id")
