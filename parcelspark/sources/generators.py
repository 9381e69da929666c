"""Made-up parameters and panels of the model, for studies; Spark's seeded random columns, one draw per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kernel import within_precision


def parameters(clusters: DataFrame, keys: list[str], rho: float = 0.95, scale: float = 1.0, seed: int = 0) -> DataFrame:
    """keys, unit_id, value: cluster mean plus noise of covariance scale · (c1 M⁻¹ + c2 11ᵀ), by the Cholesky factor of each cluster.

    clusters: keys, cluster_id, members ARRAY<STRUCT<unit_id, neighbours>>, mean, c1, c2, one row per cluster. The
    draw depends on the seed, the keys and cluster_id only, not on how rows are spread.
    """
    types = dict(clusters.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", unit_id int, value double"
    m = F.col("members")
    flat = clusters.select(*keys, F.xxhash64(F.lit(seed), *keys, "cluster_id").alias("own"), m["unit_id"].alias("units"), m["neighbours"].alias("near"), "mean", "c1", "c2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                covariance = np.linalg.inv(within_precision(r["units"], r["near"], rho, r["c1"], r["c2"])) * scale
                noise = np.linalg.cholesky(covariance) @ np.random.default_rng(r["own"] % 2**63).standard_normal(len(r["units"]))
                yield pd.DataFrame({**{k: r[k] for k in keys}, "unit_id": r["units"], "value": r["mean"] + noise})

    return flat.mapInPandas(run, schema)


def gaussian_panel(truth: DataFrame, periods: int, sd: float, seed: int = 0) -> DataFrame:
    """run_id, unit_id, t, x, y: x the scaled periods, y = alpha + beta x + noise. truth: run_id, unit_id, alpha, beta."""
    t = np.arange(1, periods + 1)
    x = (t - t.mean()) / t.std(ddof=1)
    points = F.explode(F.array(*[F.struct(F.lit(int(a)).alias("t"), F.lit(float(b)).alias("x")) for a, b in zip(t, x)]))
    rows = truth.withColumn("p", points).select("run_id", "unit_id", "p.t", "p.x", "alpha", "beta")
    return rows.select("run_id", "unit_id", "t", "x", (F.col("alpha") + F.col("beta") * F.col("x") + sd * F.randn(seed)).alias("y"))


def poisson_panel(truth: DataFrame, periods: int, seed: int = 0) -> DataFrame:
    """The same with counts of mean exp(alpha + beta x). The draw depends on the seed, run_id, unit_id and t only, not on how rows are spread; a null mean has a null count."""
    rows = gaussian_panel(truth, periods, 0.0, seed).withColumn("_own", F.xxhash64(F.lit(seed), "run_id", "unit_id", "t")).withColumn("y", F.exp("y"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "_own")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            drawn = [float(np.random.default_rng(own % 2**63).poisson(m)) if m == m else None for own, m in zip(batch["_own"], batch["y"])]
            yield batch.drop(columns="_own").assign(y=drawn)

    return rows.mapInPandas(run, schema)
