"""Simpler ways to group units, to compare with."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .graph import components


def _cuts(v: np.ndarray, most: int) -> list[np.ndarray]:
    """Exact one-dimensional k-means for k = 1..most on sorted values: the first index of each class, by dynamic programming."""
    n = len(v)
    head, square = np.concatenate([[0], np.cumsum(v)]), np.concatenate([[0], np.cumsum(v * v)])
    i, j = np.arange(n)[:, None], np.arange(1, n + 1)[None, :]
    size = np.maximum(j - i, 1)
    cost = np.where(j > i, square[j] - square[i] - (head[j] - head[i]) ** 2 / size, np.inf)  # of i..j-1
    best, back, out = cost[0], [np.zeros(n, int)], [np.array([0])]
    for k in range(2, most + 1):
        total = np.concatenate([[np.inf], best[:-1]])[:, None] + cost
        back.append(total.argmin(axis=0))
        best = total.min(axis=0)
        starts, end = [], n
        for m in range(k, 1, -1):
            end = back[m - 1][end - 1]
            starts.append(end)
        out.append(np.array([0, *reversed(starts)]))
    return out


def kmeans_path(values: DataFrame, keys: list[str], most: int | Callable[[int], int] = 5) -> DataFrame:
    """keys, k, unit_id, cluster_id: the best k classes of value, k = 1..most (no more than distinct units), for each key.

    values: keys, unit_id, value; a key's units (one panel) are one group. Null values are left out.
    most may depend on the number of units.
    """
    types = dict(values.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", k int, unit_id {types['unit_id']}, cluster_id int"

    def path(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["value", "unit_id"])
        made = _cuts(group["value"].to_numpy(float), min(most(len(group)) if callable(most) else most, len(group)))
        at = np.arange(len(group))
        return pd.concat([group[[*keys]].assign(k=k, unit_id=group["unit_id"], cluster_id=np.searchsorted(starts, at, side="right")) for k, starts in enumerate(made, 1)])

    return values.where(F.col("value").isNotNull()).select(*keys, "unit_id", "value").groupBy(*keys).applyInPandas(path, schema)


def spectral_parts(clusters: DataFrame, keys: list[str], k: int = 2, squared: bool = True) -> DataFrame:
    """keys, cluster_id, unit_id, part: the cut of spectral_path into k parts."""
    return spectral_path(clusters, keys, lambda n: [k], squared).drop("k")


def spectral_vectors(units: np.ndarray, v: np.ndarray, near: list, squared: bool = True) -> np.ndarray:
    """Eigenvectors of the normalised Laplacian of spectral_path, by ascending eigenvalues."""
    place = {int(u): i for i, u in enumerate(units)}
    w = np.eye(len(units))
    for i, other in enumerate(near):
        for u in other if other is not None else ():
            if int(u) in place:
                gap = abs(v[i] - v[place[int(u)]])
                w[i, place[int(u)]] = np.exp(-(gap**2) / (2 * v.var(ddof=1)) if squared else -gap / (2 * v.std(ddof=1)))
    d = 1 / np.sqrt(w.sum(axis=1))
    return np.linalg.eigh(np.eye(len(units)) - d[:, None] * w * d)[1]


def spectral_part(rows: np.ndarray, k: int) -> np.ndarray:
    """The part of each row of the first k eigenvectors."""
    rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    seeds = [0]
    while len(seeds) < k:
        seeds.append(int(np.min([((rows - rows[s]) ** 2).sum(axis=1) for s in seeds], axis=0).argmax()))
    centres = rows[seeds]
    for _ in range(10):
        part = ((rows[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([rows[part == c].mean(axis=0) if (part == c).any() else centres[c] for c in range(k)])
    return part


def spectral_path(clusters: DataFrame, keys: list[str], ks: Callable[[int], Iterable[int]], squared: bool = True) -> DataFrame:
    """keys, cluster_id, k, unit_id, part: spectral cuts of a cluster of n units into k parts, for each k of ks(n) that is under n.

    clusters: keys, cluster_id, members ARRAY<STRUCT<unit_id, value, neighbours>>, one row per cluster. Similarity is
    exp(-(v_i - v_j)² / (2 var)), or where not squared exp(-|v_i - v_j| / (2 sd)), on neighbours, with 1 on the diagonal; rows of the first k
    eigenvectors of the normalised Laplacian, at unit length, are grouped by farthest-first seeds and
    ten means steps. Clusters whose values are all equal have no cut.
    """
    types = dict(clusters.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, "cluster_id"]) + ", k int, unit_id int, part int"
    m = F.col("members")
    flat = clusters.where(F.size(m) > 1).select(*keys, "cluster_id", m["unit_id"].alias("units"), m["value"].alias("value"), m["neighbours"].alias("near"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                v = np.array(row["value"], float)
                wanted = [k for k in ks(len(v)) if k < len(v)] if v.var() > 0 else []
                if wanted:
                    found = spectral_vectors(row["units"], v, row["near"], squared)
                for k in wanted:
                    yield pd.DataFrame({**{c: row[c] for c in [*keys, "cluster_id"]}, "k": k, "unit_id": row["units"], "part": spectral_part(found[:, :k], k)})

    return flat.mapInPandas(run, schema)


def silhouettes(assignment: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Mean silhouette width of each key by |difference of value|; units alone in a cluster count 0, and a key of one cluster is null.

    Sums of distances to a sorted cluster follow from ranks and running sums, so each unit meets
    each cluster once instead of each other unit.
    """
    on = [c for c in values.columns if c in (*keys, "unit_id")]
    rows = assignment.join(values.select(*on, "value"), on).where(F.col("value").isNotNull())
    sizes = rows.groupBy(*keys, "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("all"))
    probes = rows.withColumnRenamed("cluster_id", "own").join(sizes.select(*keys, F.col("cluster_id").alias("other"), "n", "all"), keys)
    w = Window.partitionBy(*keys, "other").orderBy("value").rangeBetween(Window.unboundedPreceding, 0)
    member = F.col("own") == F.col("other")
    below, head = F.sum(member.cast("int")).over(w), F.sum(F.when(member, F.col("value")).otherwise(0.0)).over(w)
    d = probes.withColumn("below", below).withColumn("head", head).withColumn("distance", F.col("value") * F.col("below") - F.col("head") + (F.col("all") - F.col("head")) - F.col("value") * (F.col("n") - F.col("below")))
    own = F.max(F.when(member, F.col("distance") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("a")
    alone = F.max(F.when(member, F.col("n"))).alias("size")
    by = d.groupBy(*keys, "unit_id").agg(own, F.min(F.when(~member, F.col("distance") / F.col("n"))).alias("b"), alone)
    s = F.when(F.col("b").isNull(), None).when(F.col("size") == 1, 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    return by.groupBy(*keys).agg(F.avg(s).alias("silhouette"))


def chosen_classes(paths: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, k, unit_id, cluster_id: of the classes of each k (paths) those of the greatest mean silhouette; one class counts 0, of equal ones the least k is taken."""
    widths = silhouettes(paths, values, [*keys, "k"])
    best = widths.groupBy(*keys).agg(F.max_by("k", F.struct(F.round(F.coalesce("silhouette", F.lit(0.0)), 9), -F.col("k"))).alias("k"))
    return paths.join(best, [*keys, "k"]).select(*keys, "k", "unit_id", "cluster_id")


def spanning_tree(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, src, dst (src < dst), weight: a least spanning tree (or forest) of each graph, by Borůvka's rounds.

    edges: keys, src, dst, weight, both directions. Each round every component takes its lightest
    way out; equal weights are told apart by the ends, so no cycle can arise.
    """
    edges = written(edges.select(*keys, "src", "dst", "weight"), "weighted")
    tree = None
    labels = edges.select(*keys, F.col("src").alias("unit_id")).distinct().withColumn("component", F.col("unit_id"))
    while True:
        a = labels.select(*keys, F.col("unit_id").alias("src"), F.col("component").alias("ca"))
        b = labels.select(*keys, F.col("unit_id").alias("dst"), F.col("component").alias("cb"))
        out = edges.join(a, [*keys, "src"]).join(b, [*keys, "dst"]).where(F.col("ca") != F.col("cb"))
        key = F.struct("weight", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), "cb")
        taken = written(out.groupBy(*keys, "ca").agg(F.min(key).alias("e")).select(*keys, "ca", "e.*"), "taken")
        if taken.isEmpty():
            return tree if tree is not None else edges.limit(0)
        added = taken.select(*keys, F.col("lo").alias("src"), F.col("hi").alias("dst"), "weight").distinct()
        tree = added if tree is None else tree.unionByName(added)
        ways = taken.select(*keys, F.col("ca").alias("src"), F.col("cb").alias("dst"))
        joined = components(labels.select(*keys, F.col("component").alias("unit_id")).distinct(), ways, keys)  # of components, each round fewer
        joined = joined.select(*keys, F.col("unit_id").alias("component"), F.col("component").alias("_new"))
        labels = written(labels.join(joined, [*keys, "component"]).select(*keys, "unit_id", F.col("_new").alias("component")), "labels")


def strong_parts(tree: DataFrame, vertices: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """keys, unit_id, component: the parts of a tree that edges of weight up to tolerance hold together."""
    near = tree.where(F.abs("weight") <= tolerance)
    both = near.select(*keys, "src", "dst").unionByName(near.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")))
    return components(vertices, both, keys)


def tree_basis(tree: DataFrame, vertices: DataFrame, keys: list[str]) -> DataFrame:
    """keys, src, dst, unit_id, value: the rows of a spanning tree's incidence matrix (1 at src, -1 at dst), and a row of 1/N (src and dst null) that makes it square; zeros are left out."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("unit_id"), F.lit(1.0).alias("value")), F.struct(F.col("dst").alias("unit_id"), F.lit(-1.0).alias("value")))).alias("e")
    rows = tree.select(*keys, "src", "dst", ends).select(*keys, "src", "dst", "e.*")
    types = dict(tree.dtypes)
    none = [F.lit(None).cast(types[c]).alias(c) for c in ("src", "dst")]
    share = 1 / F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.unionByName(vertices.select(*keys, *none, "unit_id", share.alias("value")))


def tree_inverse(tree: DataFrame, vertices: DataFrame, keys: list[str]) -> DataFrame:
    """keys, src, dst, unit_id, value: the inverse of tree_basis, by column (src, dst; null for the last).

    Without an edge the tree falls apart; units on the side of src have the share of the other side, those of dst minus the share of src's
    side, and the last column is 1. As many rows as the square of a graph's units, since the inverse is dense.
    """
    cut = tree.select(*keys, F.col("src").alias("_s"), F.col("dst").alias("_d"))
    rest = cut.join(tree.select(*keys, "src", "dst"), keys).where((F.col("src") != F.col("_s")) | (F.col("dst") != F.col("_d")))
    both = rest.select(*keys, "_s", "_d", "src", "dst").unionByName(rest.select(*keys, "_s", "_d", F.col("dst").alias("src"), F.col("src").alias("dst")))
    by = [*keys, "_s", "_d"]
    sides = components(cut.join(vertices.select(*keys, "unit_id"), keys), both, by)
    edge = Window.partitionBy(*by)
    own = F.max(F.when(F.col("unit_id") == F.col("_s"), F.col("component"))).over(edge)
    marked = sides.withColumn("_near", (F.col("component") == own).cast("double")).withColumn("_share", F.avg("_near").over(edge))
    cells = marked.select(*keys, F.col("_s").alias("src"), F.col("_d").alias("dst"), "unit_id", (F.col("_near") - F.col("_share")).alias("value"))
    types = dict(tree.dtypes)
    return cells.unionByName(vertices.select(*keys, *[F.lit(None).cast(types[c]).alias(c) for c in ("src", "dst")], "unit_id", F.lit(1.0).alias("value")))
