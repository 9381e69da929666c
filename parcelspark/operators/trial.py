"""Numbers of candidate changes of partitions, and the choice among them; all runs and particles at once.

A candidate lists the units of the clusters that it touches with their new labels. Its numbers are
differences: those of its clusters less those of the clusters that they take the place of, so
nothing else of the partition is looked at. The numbers of a whole partition are those of the
candidate that makes it from nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import over_cores
from .kernel import cluster_numbers, within_precision

#: Differences of the quadratic form, the log determinant, the number of clusters, the prior's sum over clusters, and the signature.
SUMS = "quad double, log_det double, k int, inner double, sig bigint"
#: What a particle's side is known by when the particles take turns.
TURN = ["run_id", "particle_id", "side", "quad", "log_det", "k", "inner", "sig", "units", "w", "a", "d", "c"]


@dataclass(frozen=True)
class Prior:
    """Log prior of a partition: Σ_k inner(n_k) + outer(K) − rising(n).

    form: "pitman" (eta, sigma; sigma = 0 is the Ewens form), "uniform" (0), or "levels" (ln eta + ln Γ(n_k)).
    """

    form: str = "pitman"
    eta: float = 1.0
    sigma: float = 0.0

    def __post_init__(self) -> None:
        if self.form not in ("pitman", "uniform", "levels"):
            raise ValueError(f"no prior of the form {self.form!r}")
        if not (self.eta > 0 and 0 <= self.sigma < 1):
            raise ValueError("eta has to be above 0 and sigma in [0, 1)")

    def inner(self, n: int) -> float:
        if self.form == "pitman":
            return math.lgamma(n - self.sigma) - math.lgamma(1 - self.sigma)
        return math.log(self.eta) + math.lgamma(n) if self.form == "levels" else 0.0

    def outer(self, k: np.ndarray | int, n: int) -> np.ndarray:
        """outer(k) − rising(n) for numbers of clusters k of n units."""
        if self.form != "pitman":
            return np.zeros(np.shape(k))
        steps = np.concatenate([[0.0], np.cumsum(np.log(self.eta + self.sigma * np.arange(np.max(k, initial=1))))])
        return steps[k] - (math.lgamma(self.eta + n) - math.lgamma(self.eta))


def mark(unit: np.ndarray, label: np.ndarray) -> int:
    """A number that equal partitions share: the exclusive or of a hash of each unit with its cluster's least unit."""
    h = (unit.astype(np.uint64) << np.uint64(32)) ^ label.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return int(np.bitwise_xor.reduce(h ^ (h >> np.uint64(31))).astype(np.int64)) if len(h) else 0


def tried(cands: DataFrame, at: DataFrame, facts: DataFrame, keys: list[str], prior: Prior, rho: float) -> DataFrame:
    """keys, cand, units, labels (each cluster's least unit), means, own_quad, own_det, own_n (of each unit's new cluster), and the differences SUMS; one row a candidate.

    cands: keys, cand, unit_id, cluster_id. at: keys, unit_id, cluster_id, quad, log_det, n: the partition as it is, with its clusters' numbers (null
    where there is none yet). facts: run_id, unit_id, near, terms ARRAY<STRUCT<side, b, w, c1, c2>>; the terms of the candidate's side are summed,
    the means are of the first. A row is as large as the clusters that one candidate touches. A c1 or c2 that is not above 0 gives no row.
    """
    types = dict(cands.dtypes)
    rows = cands.join(at.select(*keys, "unit_id", F.col("cluster_id").alias("old"), "quad", "log_det", "n"), [*keys, "unit_id"]).join(facts, ["run_id", "unit_id"])
    rows = rows.withColumn("t", F.filter("terms", lambda t: t["side"] == F.col("side")))
    member = F.struct("unit_id", F.col("cluster_id").cast("int").alias("label"), "old", "quad", "log_det", "n", "near", F.col("t.b").alias("b"), F.col("t.w").alias("w"))
    packed = rows.groupBy(*keys, "cand").agg(F.array_sort(F.collect_list(member)).alias("m"), F.first("t").alias("t"))
    m = F.col("m")
    flat = packed.select(*keys, "cand", *[m[c].alias(c) for c in ("unit_id", "label", "old", "quad", "log_det", "n", "near", "b", "w")], F.col("t.c1").alias("c1"), F.col("t.c2").alias("c2"))
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", cand string, units array<int>, labels array<int>, means array<double>, own_quad array<double>, own_det array<double>, own_n array<int>, " + SUMS

    def numbers(r) -> list | None:
        if not all(c > 0 for c in [*r.c1, *r.c2]):
            return None
        units, label = np.asarray(r.unit_id, int), np.asarray(r.label, int)
        b, w = (np.array([np.asarray(v, float) for v in x]) for x in (r.b, r.w))
        new = np.empty(len(units), int)
        own = np.zeros((3, len(units)))
        means = np.empty(len(units))
        k, inner = 0, 0.0
        for c in np.unique(label):
            mine = np.flatnonzero(label == c)
            near = [r.near[i] for i in mine]
            quad = det = 0.0
            for t, (c1, c2) in enumerate(zip(r.c1, r.c2)):
                q, d, mean = cluster_numbers(within_precision(units[mine], near, rho, c1, c2), b[mine, t], w[mine, t])
                quad, det = quad + q, det + d
                if t == 0:
                    means[mine] = mean
            new[mine] = units[mine].min()
            own[:, mine] = np.array([[quad], [det], [len(mine)]])
            k, inner = k + 1, inner + prior.inner(len(mine))
        firsts = np.unique(new, return_index=True)[1]
        quad, det, sig = own[0, firsts].sum(), own[1, firsts].sum(), mark(units, new)
        if r.quad[0] is not None and r.quad[0] == r.quad[0]:
            old = np.asarray(r.old, int)
            firsts = np.unique(old, return_index=True)[1]
            quad, det, k = quad - sum(r.quad[i] for i in firsts), det - sum(r.log_det[i] for i in firsts), k - len(firsts)
            inner -= sum(prior.inner(int(r.n[i])) for i in firsts)
            sig ^= mark(units, old)
        return [units, new, means, own[0], own[1], own[2].astype(int), quad, det, k, inner, sig]

    names = ["units", "labels", "means", "own_quad", "own_det", "own_n", "quad", "log_det", "k", "inner", "sig"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, x) for i, r in enumerate(batch.itertuples(index=False)) if (x := numbers(r)) is not None]
            heads = batch[[*keys, "cand"]].iloc[[i for i, _ in found]].reset_index(drop=True)
            yield pd.concat([heads, pd.DataFrame([x for _, x in found], columns=names)], axis=1)

    return over_cores(flat).mapInPandas(run, schema)


def spread_out(tried_rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, unit_id, cluster_id, mean, quad, log_det, n: the units of candidates, with the numbers of their new clusters."""
    zipped = F.explode(F.arrays_zip("units", "labels", "means", "own_quad", "own_det", "own_n")).alias("u")
    return tried_rows.select(*keys, zipped).select(*keys, F.col("u.units").alias("unit_id"), F.col("u.labels").alias("cluster_id"), F.col("u.means").alias("mean"), F.col("u.own_quad").alias("quad"), F.col("u.own_det").alias("log_det"), F.col("u.own_n").alias("n"))


def log_posterior(quad, log_det, prior, law: pd.Series):
    """½ log_det − a ln(d + quad/2) + c + prior, with the numbers a, d, c of the run."""
    return log_det / 2 - law.a * np.log(law.d + quad / 2) + law.c + prior


def _entropies(pairs: dict, weight: float, pooled: np.ndarray) -> np.ndarray:
    """Entropy of weights where one particle joins others: pairs are the others' weights by partition, pooled what each choice finds there."""
    plogp = lambda p: np.where(p > 0, p * np.log(np.maximum(p, 1e-300)), 0.0)
    rest = sum(float(plogp(np.array(v))) for v in pairs.values())
    return -(rest - plogp(pooled) + plogp(weight + pooled))


def turns(mine: pd.DataFrame, cands: pd.DataFrame, sides: str, prior: Prior, temper: float) -> pd.DataFrame:
    """chosen for one run."""
    if not len(mine):
        return pd.DataFrame(columns=[*TURN, "cand", "was"])
    options = {at: g.sort_values("cand", ignore_index=True) for at, g in cands.groupby(["side", "of"])}
    rows = {(r.particle_id, r.side): r for r in mine.sort_values(["particle_id", "side"]).itertuples(index=False)}
    slots = list(dict.fromkeys(l for l, _ in rows))
    law = mine.iloc[0]
    now = {at: {"quad": r.quad, "log_det": r.log_det, "k": int(r.k), "inner": r.inner, "sig": int(r.sig), "units": int(r.units)} for at, r in rows.items()}
    prior_of = lambda x: x["inner"] + float(prior.outer(int(x["k"]), int(x["units"])))
    weight = {l: rows[l, sides[0]].w for l in slots}
    picked = {}
    for l in slots:
        pairs: dict = {}
        for o in slots:
            if o != l:
                pairs[tuple(now[o, s]["sig"] for s in sides)] = pairs.get(tuple(now[o, s]["sig"] for s in sides), 0.0) + weight[o]
        for s in sides:
            got, x = options.get((s, now[l, s]["sig"])), now[l, s]
            if got is None:
                continue
            rest = [now[l, o] for o in sides if o != s]
            quad, det, fixed = sum(o["quad"] for o in rest), sum(o["log_det"] for o in rest), sum(map(prior_of, rest))
            new = log_posterior(quad + x["quad"] + got["quad"].to_numpy(), det + x["log_det"] + got["log_det"].to_numpy(), fixed + x["inner"] + got["inner"].to_numpy() + prior.outer(got["k"].to_numpy() + int(x["k"]), int(x["units"])), law)
            old = log_posterior(quad + x["quad"], det + x["log_det"], fixed + prior_of(x), law)
            sigs = got["sig"].to_numpy() ^ np.int64(x["sig"])
            full = lambda sig: tuple(int(sig) if o == s else now[l, o]["sig"] for o in sides)  # noqa: B023, E731
            there = np.array([pairs.get(full(v), 0.0) for v in sigs]) if pairs else np.zeros(len(sigs))
            gain = weight[l] * (new - old) + temper * (_entropies(pairs, weight[l], there) - _entropies(pairs, weight[l], np.array(pairs.get(full(x["sig"]), 0.0))))
            gain = np.round(np.nan_to_num(gain, nan=-1.0), 9)
            best = int(gain.argmax())
            if gain[best] > 0:
                row = got.iloc[best]
                picked[l, s] = row["cand"]
                now[l, s] = {"quad": x["quad"] + row["quad"], "log_det": x["log_det"] + row["log_det"], "k": x["k"] + int(row["k"]), "inner": x["inner"] + row["inner"], "sig": int(sigs[best]), "units": x["units"]}
    out = [{**r._asdict(), **now[at], "cand": picked.get(at), "was": int(r.sig)} for at, r in rows.items()]
    return pd.DataFrame(out)[[*TURN, "cand", "was"]]


def chosen(sums: DataFrame, candidates: DataFrame, sides: str, prior: Prior, temper: float) -> DataFrame:
    """sums after each particle in turn, side by side, took its best change: the columns of sums, cand (null where nothing is better) and was (the signature before).

    sums: run_id, particle_id, side, quad, log_det, k, inner, sig, units, w, a, d, c. candidates: run_id, side, of (the
    signature of the partition that they change), cand and SUMS. The objective is w · log posterior + temper · entropy of the weights over
    distinct particles, w as it is for all turns; a change has to be strictly better, of equal ones the first by name is taken. A
    partition's candidates depend on itself alone, so those made before the turns hold for all of them. One run's
    particles and candidates, as numbers, are one group, however many units there are.
    """
    types = dict(sums.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in TURN) + ", cand string, was bigint"
    return sums.select(*TURN).groupBy("run_id").cogroup(candidates.groupBy("run_id")).applyInPandas(lambda mine, cands: turns(mine, cands, sides, prior, temper), schema)
