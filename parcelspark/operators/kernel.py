"""Numbers of one cluster: small dense algebra on the units of a cluster, called on batches of packed clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within_precision(units: np.ndarray, neighbours: list, rho: float, c1: float, c2: float) -> np.ndarray:
    """Prior precision Ω of a cluster: M/c1 less the rank-one part of the shared level, M = ρ(D - A) + (1 - ρ)I over edges within the cluster."""
    m = len(units)
    place = {int(u): i for i, u in enumerate(units)}
    a = np.zeros((m, m))
    for i, near in enumerate(neighbours):
        for v in near if near is not None else ():
            j = place.get(int(v))
            if j is not None:
                a[i, j] = 1.0
    return precision_of(a, rho, c1, c2)


def precision_of(a: np.ndarray, rho: float, c1: float, c2: float) -> np.ndarray:
    """within_precision from the adjacency matrix of the cluster."""
    m = len(a)
    precision = rho * (np.diag(a.sum(axis=1)) - a) + (1 - rho) * np.eye(m)
    return precision / c1 - ((1 - rho) / c1) ** 2 / (m * (1 - rho) / c1 + 1 / c2)


def cluster_numbers(omega: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(quad, logdet, mean) for data sums b and weights w (diagonal): quad = -bᵀ(W+Ω)⁻¹b, logdet = ln|Ω| - ln|W+Ω|, mean = (W+Ω)⁻¹b."""
    lower = np.linalg.cholesky(omega + np.diag(w))
    mean = np.linalg.solve(lower.T, np.linalg.solve(lower, b))
    logdet = np.linalg.slogdet(omega)[1] - 2 * np.log(np.diag(lower)).sum()
    return -float(b @ mean), float(logdet), mean


def cluster_stats(clusters: DataFrame, keys: list[str], rho: float = 0.9) -> DataFrame:
    """keys, cluster_id, n, quad, log_det, means (per unit, in the order of units).

    clusters: keys, cluster_id, members ARRAY<STRUCT<unit_id, b, w, neighbours>>, c1, c2: one row per
    cluster, so a row is as large as one cluster. c1 or c2 that is not above 0 gives nulls.
    """
    types = dict(clusters.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in [*keys, "cluster_id"]) + ", units array<int>, n int, quad double, log_det double, means array<double>"
    m = F.col("members")
    flat = clusters.select(*keys, "cluster_id", m["unit_id"].alias("units"), m["b"].alias("b"), m["w"].alias("w"), m["neighbours"].alias("near"), "c1", "c2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            quads, dets, means = [], [], []
            for units, b, w, near, c1, c2 in zip(batch["units"], batch["b"], batch["w"], batch["near"], batch["c1"], batch["c2"]):
                if not (c1 > 0 and c2 > 0):
                    q, d, v = None, None, None
                else:
                    q, d, v = cluster_numbers(within_precision(units, near, rho, c1, c2), np.array(b, float), np.array(w, float))
                quads.append(q)
                dets.append(d)
                means.append(v)
            yield batch[[*keys, "cluster_id", "units"]].assign(n=[len(u) for u in batch["units"]], quad=quads, log_det=dets, means=means)

    return flat.mapInPandas(run, schema)


def packed(assignment: DataFrame, units: DataFrame, neighbours: DataFrame, keys: list[str]) -> DataFrame:
    """The clusters of an assignment as one row each.

    assignment: keys (with run_id and side), unit_id, cluster_id. units: run_id, side, unit_id, b, w, c1, c2.
    neighbours: unit_id, neighbours ARRAY<INT>.
    """
    rows = assignment.join(units, ["run_id", "side", "unit_id"]).join(neighbours, "unit_id", "left")
    member = F.struct(F.col("unit_id").cast("int").alias("unit_id"), "b", "w", "neighbours")
    return rows.groupBy(*keys, "cluster_id").agg(F.array_sort(F.collect_list(member), lambda p, q: p["unit_id"] - q["unit_id"]).alias("members"), F.first("c1").alias("c1"), F.first("c2").alias("c2"))
