"""Scores that need both sides of a particle at once: x that is not centred, and counts.

A particle is packed into one row (as large as one panel's units); the helpers are small dense
algebra on it. Spark spreads the particles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ihs_count
from .kernel import within_precision

HYPER = ["a1", "a2", "b1", "b2", "alpha_sigma", "beta_sigma"]


def packed_particles(assignment: DataFrame, panel: DataFrame, neighbours: DataFrame, hyper: DataFrame) -> DataFrame:
    """run_id, particle_id, units ARRAY<STRUCT<unit_id, ca, cb, xs, ys, near>>, hyperparameters. Rows of the panel with a null are left out."""
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("cluster_id")))
    return packed_pairs(assignment.groupBy("run_id", "particle_id", "unit_id").agg(pick("A").alias("ca"), pick("B").alias("cb")), panel, neighbours, hyper)


def packed_pairs(both: DataFrame, panel: DataFrame, neighbours: DataFrame, hyper: DataFrame) -> DataFrame:
    """The same from run_id, particle_id, unit_id and the clusters ca and cb of both sides."""
    known = panel.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    series = known.groupBy("run_id", "unit_id").agg(F.array_sort(F.collect_list(F.struct("t", "x", "y"))).alias("o")).select("run_id", "unit_id", F.col("o.x").alias("xs"), F.col("o.y").alias("ys"))
    rows = both.join(series, ["run_id", "unit_id"]).join(neighbours.withColumnRenamed("neighbours", "near"), "unit_id", "left")
    units = F.array_sort(F.collect_list(F.struct("unit_id", "ca", "cb", "xs", "ys", "near")))
    return rows.groupBy("run_id", "particle_id").agg(units.alias("units")).join(hyper.select("run_id", *HYPER), "run_id")


def _precision(units: np.ndarray, labels: np.ndarray, near: list, rho: float, c1: float, c2: float) -> tuple[np.ndarray, float]:
    """Block precision of one side, and its log determinant."""
    omega, logdet = np.zeros((len(units), len(units))), 0.0
    for c in np.unique(labels):
        at = np.flatnonzero(labels == c)
        block = within_precision(units[at], [near[i] for i in at], rho, c1, c2)
        omega[np.ix_(at, at)] = block
        logdet += np.linalg.slogdet(block)[1]
    return omega, logdet


def _flat(particles: DataFrame) -> DataFrame:
    u = F.col("units")
    return particles.select("run_id", "particle_id", *HYPER, u["unit_id"].alias("ids"), u["ca"].alias("ca"), u["cb"].alias("cb"), u["xs"].alias("xs"), u["ys"].alias("ys"), u["near"].alias("near"))


def _called(row, helper):
    """helper(ids, ca, cb, xs, ys, near, hyper) of a row, or None for unusable hyperparameters."""
    hyper = {h: getattr(row, h) for h in HYPER}
    good = all(hyper[h] is not None and hyper[h] > 0 for h in HYPER)
    return helper(np.array(row.ids), np.array(row.ca), np.array(row.cb), list(row.xs), list(row.ys), list(row.near), hyper) if good else None


def _apply(particles: DataFrame, helper) -> DataFrame:
    """run_id, particle_id, log_like by helper, null for unusable hyperparameters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [_called(r, helper) for r in batch.itertuples(index=False)]
            yield batch[["run_id", "particle_id"]].assign(log_like=pd.Series(out, index=batch.index, dtype=float))

    return _flat(particles).mapInPandas(run, "run_id int, particle_id int, log_like double")


def _apply_units(particles: DataFrame, helper) -> DataFrame:
    """run_id, particle_id, unit_id, alpha, beta by helper; no rows for unusable hyperparameters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                means = _called(r, helper)
                if means is not None:
                    yield pd.DataFrame({"run_id": r.run_id, "particle_id": r.particle_id, "unit_id": r.ids, "alpha": means[0], "beta": means[1]})

    return _flat(particles).mapInPandas(run, "run_id int, particle_id int, unit_id int, alpha double, beta double")


def _sums(xs: list, ys: list) -> tuple[np.ndarray, ...]:
    """Per unit: periods, Σx, Σx², Σy, Σxy."""
    pairs = [(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(xs, ys)]
    return tuple(np.array([f(x, y) for x, y in pairs], float) for f in (lambda x, y: len(x), lambda x, y: x.sum(), lambda x, y: x @ x, lambda x, y: y.sum(), lambda x, y: x @ y))


def _solved(oa: np.ndarray, ob: np.ndarray, sums: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior means of levels and slopes together, and the log determinant of their precision."""
    n, sx, sxx, sy, sxy = sums
    whole = np.block([[np.diag(n) + oa, np.diag(sx)], [np.diag(sx), np.diag(sxx) + ob]])
    means = np.linalg.solve(whole, np.concatenate([sy, sxy]))
    return means[: len(n)], means[len(n) :], float(np.linalg.slogdet(whole)[1])


def joint_means(particles: DataFrame, rho: float = 0.9) -> DataFrame:
    """run_id, particle_id, unit_id, alpha, beta: posterior means of levels and slopes at once, also where x is not centred."""

    def helper(ids, ca, cb, xs, ys, near, h):
        oa, ob = _precision(ids, ca, near, rho, h["a1"], h["a2"])[0], _precision(ids, cb, near, rho, h["b1"], h["b2"])[0]
        return _solved(oa, ob, _sums(xs, ys))[:2]

    return _apply_units(particles, helper)


def ascent_means(particles: DataFrame, rho: float = 0.9, sweeps: int = 2) -> DataFrame:
    """run_id, particle_id, unit_id, alpha, beta: levels given slopes and slopes given levels in turns, from least-squares slopes (0 where x does not vary); many sweeps reach joint_means."""

    def helper(ids, ca, cb, xs, ys, near, h):
        oa, ob = _precision(ids, ca, near, rho, h["a1"], h["a2"])[0], _precision(ids, cb, near, rho, h["b1"], h["b2"])[0]
        n, sx, sxx, sy, sxy = _sums(xs, ys)
        spread = sxx - sx * sx / n
        beta = np.where(spread > 1e-12, (sxy - sx * sy / n) / np.where(spread > 1e-12, spread, 1), 0.0)
        alpha = sy / n
        for _ in range(sweeps):
            alpha = np.linalg.solve(np.diag(n) + oa, sy - sx * beta)
            beta = np.linalg.solve(np.diag(sxx) + ob, sxy - sx * alpha)
        return alpha, beta

    return _apply_units(particles, helper)


def joint_likelihood(particles: DataFrame, rho: float = 0.9) -> DataFrame:
    """run_id, particle_id, log_like: density of the data and of the posterior means together, the variance integrated out.

    With N observations of n units, ν = N/2 + n and Q the squared residuals plus αᵀΩα + βᵀΩβ, it is
    ½ Σ ln|Ω| + ln Γ(as + ν) - ln Γ(as) + as ln bs - (as + ν) ln(bs + Q/2). It favours many clusters;
    exact_likelihood is the one to choose by.
    """

    def helper(ids, ca, cb, xs, ys, near, h):
        (oa, da), (ob, db) = _precision(ids, ca, near, rho, h["a1"], h["a2"]), _precision(ids, cb, near, rho, h["b1"], h["b2"])
        alpha, beta, _ = _solved(oa, ob, _sums(xs, ys))
        rest = sum(float(((np.asarray(y) - p - q * np.asarray(x)) ** 2).sum()) for x, y, p, q in zip(xs, ys, alpha, beta))
        quad, a, s = rest + alpha @ oa @ alpha + beta @ ob @ beta, h["alpha_sigma"], h["beta_sigma"]
        more = sum(len(x) for x in xs) / 2 + len(ids)
        return 0.5 * (da + db) + math.lgamma(a + more) - math.lgamma(a) + a * np.log(s) - (a + more) * np.log(s + quad / 2)

    return _apply(particles, helper)


def exact_likelihood(particles: DataFrame, rho: float = 0.9) -> DataFrame:
    """Marginal log likelihood of each particle, also where x is not centred (the terms in ln Γ left out, as elsewhere)."""

    def helper(ids, ca, cb, xs, ys, near, h):
        oa, da = _precision(ids, ca, near, rho, h["a1"], h["a2"])
        ob, db = _precision(ids, cb, near, rho, h["b1"], h["b2"])
        sums = _sums(xs, ys)
        alpha, beta, det = _solved(oa, ob, sums)
        q = sum(float(np.dot(y, y)) for y in ys) - sums[3] @ alpha - sums[4] @ beta
        a, s = h["alpha_sigma"], h["beta_sigma"]
        return 0.5 * (da + db - det) - (a + sums[0].sum() / 2) * np.log(s + q / 2) + a * np.log(s)

    return _apply(particles, helper)


def counts(panel: DataFrame) -> DataFrame:
    """The panel with y as counts: half-even rounding of sinh(y + ln 2), negative ones 0."""
    return panel.withColumn("y", ihs_count(F.col("y"), F.lit(1.0)))


def poisson_laplace(particles: DataFrame, rho: float = 0.9, steps: int = 50) -> DataFrame:
    """Laplace approximation of the log evidence of counts y ~ Poisson(exp(alpha + beta x)), ln y! left out.

    The variance is taken at its prior mode. The mode is found by damped Newton steps. The
    Gaussian's normalising terms enter once per unit and side, and so do the terms of the variance.
    """

    def helper(ids, ca, cb, xs, ys, near, h):
        oa, da = _precision(ids, ca, near, rho, h["a1"], h["a2"])
        ob, db = _precision(ids, cb, near, rho, h["b1"], h["b2"])
        n, s2 = len(ids), h["beta_sigma"] / (h["alpha_sigma"] + 1)
        prior = np.zeros((2 * n, 2 * n))
        prior[:n, :n], prior[n:, n:] = oa / s2, ob / s2
        owner = np.repeat(np.arange(n), [len(x) for x in xs])
        x, y = np.concatenate(xs), np.concatenate(ys)

        def value(v):
            eta = np.clip(v[owner] + v[n + owner] * x, -50, 50)
            return float(y @ eta - np.exp(eta).sum() - 0.5 * v @ prior @ v), np.exp(eta)

        add = lambda z: np.bincount(owner, z, n)
        v = np.zeros(2 * n)
        v[:n] = np.log(np.maximum(add(y) / np.maximum(add(np.ones_like(y)), 1), 0.1))
        best, mu = value(v)
        for _ in range(steps):
            g = np.concatenate([add(y - mu), add((y - mu) * x)]) - prior @ v
            d0, d1, d2 = add(mu), add(mu * x), add(mu * x * x)
            hess = prior + np.block([[np.diag(d0), np.diag(d1)], [np.diag(d1), np.diag(d2)]])
            move, size = np.linalg.solve(hess, g), 1.0
            while size > 1e-6:
                new, mu_new = value(v + size * move)
                if new >= best:
                    break
                size /= 2
            gain, v, best, mu = new - best, v + size * move, new, mu_new
            if size <= 1e-6 or gain < 1e-9:
                break
        d0, d1, d2 = add(mu), add(mu * x), add(mu * x * x)
        hess = prior + np.block([[np.diag(d0), np.diag(d1)], [np.diag(d1), np.diag(d2)]])
        return best + 0.5 * (da + db) - n * np.log(s2) - 0.5 * np.linalg.slogdet(hess)[1]

    return _apply(particles, helper)
