"""Search for good pairs of partitions, for all runs and particles at once.

A sweep makes the candidates of all move families, for every partition that has none yet, as rows; scores
the clusters that they touch; and lets the particles of each run take their best change in turns. With
x centred a side's candidates depend on that side's partition alone, so they are made ahead of the turns, once
for all particles that share the partition, and kept as long as a particle has it. A sweep is
a handful of Spark jobs whatever the number of runs and particles. What it leaves is written to
the shared folder, so lineage stays short and a lost executor costs one sweep at most.

Runs of at most IN_TASK units, which one task holds, are searched whole inside of a task each (operators/local.py), by the same moves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import local, mean_only, moves, parts
from ..operators.compare import kmeans_path
from ..operators.joint import packed_pairs, poisson_laplace
from ..operators.kernel import cluster_numbers, cluster_stats, precision_of
from ..operators.panel import default_hyperparameters, unit_ols
from ..operators.partitions import relabelled
from ..operators.score import log_likelihood, neighbour_lists, totals
from ..operators.trial import Prior, chosen, log_posterior, spread_out, tried
from ..operators.weights import prior_py, tempered_weights
from ..session import dropped, over_cores, written

PARTICLE = ["run_id", "particle_id"]
KEYS = [*PARTICLE, "side"]
#: A partition of a run's side, by its signature.
PARTITION = ["run_id", "side", "of"]
#: The most units of a run that is searched inside of one task.
IN_TASK = 2_000
FAMILIES = ("island", "border", "merge", "split", "spectral", "tail", "onward")


@dataclass
class Problem:
    """What does not change in a search.

    units: unit_ols of the panel; hyper: one row per run; facts: run_id, unit_id, near, terms, values (level and slope by least squares);
    law: run_id, a, d, c of the log likelihood. sides: "AB", or "A" where one partition serves the whole model. levels: the model with levels alone.
    """

    units: DataFrame
    edges: DataFrame
    hyper: DataFrame
    facts: DataFrame
    law: DataFrame
    prior: Prior = field(default_factory=Prior)
    rho: float = 0.9
    sides: str = "AB"
    levels: bool = False

    @classmethod
    def of(cls, panel: DataFrame, edges: DataFrame, hyper: DataFrame | None = None, rho: float = 0.9, prior: Prior | None = None, equal: bool = False) -> Problem:
        """Levels and slopes, each with a partition, or (equal) one for both; hyperparameters by default from the least-squares fits.

        hyper: run_id, a1, a2, b1, b2, alpha_sigma, beta_sigma. A run whose hyperparameters are not all above 0, or are missing, is not searched.
        """
        if not 0 <= rho < 1:
            raise ValueError("rho has to be in [0, 1)")
        units, edges = written(unit_ols(panel), "units"), written(edges, "graph")
        hyper = written(default_hyperparameters(units, rho) if hyper is None else hyper, "hyper")
        term = lambda side, b, w, c: F.struct(F.lit(side).alias("side"), F.col(b).alias("b"), F.col(w).cast("double").alias("w"), F.col(f"{c}1").alias("c1"), F.col(f"{c}2").alias("c2"))
        terms = F.array(term("A", "sum_y", "periods", "a"), term("A" if equal else "B", "sum_xy", "sum_xx", "b"))
        values = F.create_map(F.lit("A"), F.col("alpha"), F.lit("B"), F.col("beta"))
        usable = [F.col(c) > 0 for c in ("a1", "a2", "b1", "b2", "alpha_sigma", "beta_sigma")]
        rows = units.join(hyper.where(reduce(lambda p, q: p & q, usable)), "run_id").join(neighbour_lists(edges), "unit_id", "left")
        facts = written(rows.select("run_id", "unit_id", F.col("neighbours").alias("near"), terms.alias("terms"), values.alias("values")), "facts")
        sums = totals(units, hyper)
        law = sums.select("run_id", (F.col("alpha_sigma") + F.col("obs") / 2).alias("a"), (F.col("beta_sigma") + F.col("yy") / 2).alias("d"), F.when(F.col("beta_sigma") > 0, F.col("alpha_sigma") * F.ln("beta_sigma")).alias("c"))
        return cls(units, edges, hyper, facts, written(law, "law"), prior or Prior(), rho, "A" if equal else "AB")

    @classmethod
    def of_levels(cls, panel: DataFrame, edges: DataFrame, hyper: DataFrame, rho: float = 0.9, eta: float = 1.0) -> Problem:
        """Levels alone, with one partition. hyper: run_id, a1, a2, nu, lambda."""
        units, edges = written(mean_only.level_units(panel, hyper), "units"), written(edges, "graph")
        rows = units.where((F.col("c1") > 0) & (F.col("c2") > 0)).join(neighbour_lists(edges), "unit_id", "left")
        terms = F.array(F.struct("side", "b", "w", "c1", "c2"))
        facts = rows.select("run_id", "unit_id", F.col("neighbours").alias("near"), terms.alias("terms"), F.create_map(F.lit("A"), F.col("mean")).alias("values"))
        whole = units.groupBy("run_id").agg(F.sum("ss").alias("ss"), F.sum(F.col("periods") * F.col("mean") ** 2).alias("yy"), F.sum("periods").alias("obs"), F.sum(F.ln("periods")).alias("ln_t"))
        law = whole.join(hyper.select("run_id", "nu", F.col("lambda").alias("_lambda")), "run_id").select("run_id", ((F.col("nu") + F.col("obs")) / 2).alias("a"), ((F.col("nu") * F.col("_lambda") + F.col("yy") + F.col("ss")) / 2).alias("d"), (F.col("ln_t") / 2).alias("c"))
        return cls(units, edges, hyper, written(facts, "facts"), written(law, "law"), Prior("levels", eta), rho, "A", True)

    def values(self) -> DataFrame:
        """run_id, side, unit_id, value: least-squares levels (A) and slopes (B), of the sides that are searched."""
        sides = F.explode(F.array(*map(F.lit, self.sides))).alias("side")
        return self.facts.select("run_id", "unit_id", sides, "values").select("run_id", "side", "unit_id", F.col("values")[F.col("side")].alias("value"))

    def tried(self, cands: DataFrame, at: DataFrame, keys: list[str]) -> DataFrame:
        """Numbers of candidates."""
        return tried(cands, at, self.facts, keys, self.prior, self.rho)


def one_cluster(units: DataFrame, particles: int = 1, sides: str = "AB") -> DataFrame:
    """Every unit in cluster 1, on each side of each particle."""
    ids = F.explode(F.sequence(F.lit(1), F.lit(particles))).alias("particle_id")
    return units.select("run_id", "unit_id", ids).select("run_id", "particle_id", F.explode(F.array(*map(F.lit, sides))).alias("side"), "unit_id", F.lit(1).alias("cluster_id"))


def _whole(problem: Problem, assignment: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of whole partitions, their clusters cut into connected ones first."""
    labels = moves.cut(problem.edges, assignment.select(*keys, F.lit("whole").alias("cand"), "unit_id", F.col("cluster_id").alias("part")), keys)
    none = F.lit(None).cast("double")
    at = labels.select(*keys, "unit_id", F.lit(0).alias("cluster_id"), none.alias("quad"), none.alias("log_det"), F.lit(None).cast("int").alias("n"))
    return problem.tried(labels, at, keys)


def start_grid(problem: Problem, most: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(classes, grid) of the k-means starts: run_id, side, k and the numbers of the best k classes, made connected; run_id, k_<side>..., log_post, p of each combination.

    k goes up to floor(most · ln units), at least 1; p is exp(log_post − greatest), normalised.
    """
    paths = kmeans_path(problem.values(), ["run_id", "side"], lambda n: max(1, math.floor(most * math.log(n))))
    classes = written(_classes(problem, paths), "classes")
    sides, prior = problem.sides, problem.prior

    def combined(rows: pd.DataFrame) -> pd.DataFrame:  # a few classes by side
        law = rows.iloc[0]
        score = rows["inner"] + [float(prior.outer(int(k), int(n))) for k, n in zip(rows["clusters"], rows["n_units"])]
        by = [rows.assign(prior=score)[rows["side"] == s] for s in sides]
        if any(not len(x) for x in by):
            return pd.DataFrame(columns=["run_id", *[f"k_{s}" for s in sides], "log_post", "p"])
        at = np.meshgrid(*[np.arange(len(x)) for x in by], indexing="ij")
        total = lambda c: sum(x[c].to_numpy()[i.ravel()] for x, i in zip(by, at))
        post = log_posterior(total("quad"), total("log_det"), total("prior"), law)
        p = np.exp(post - post.max())
        return pd.DataFrame({"run_id": law.run_id, **{f"k_{s}": x["k"].to_numpy()[i.ravel()] for s, x, i in zip(sides, by, at)}, "log_post": post, "p": p / p.sum()})

    schema = "run_id int, " + ", ".join(f"k_{s} int" for s in sides) + ", log_post double, p double"
    rows = classes.select("run_id", "side", "k", "clusters", "quad", "log_det", "inner", F.size("units").alias("n_units")).join(problem.law, "run_id")
    return classes, rows.groupBy("run_id").applyInPandas(combined, schema)


def _classes(problem: Problem, paths: DataFrame) -> DataFrame:
    """Numbers of the partitions of a path: run_id, side, k, clusters and the columns of tried."""
    rows = _whole(problem, paths.withColumnRenamed("k", "_k"), ["run_id", "side", "_k"])
    return rows.withColumnRenamed("k", "clusters").withColumnRenamed("_k", "k").drop("cand")


def drawn_starts(problem: Problem, particles: int, most: float = 1.0, seed: int = 0) -> DataFrame:
    """KEYS, unit_id, cluster_id: a start for each particle, drawn from start_grid by its cumulative p; the draw depends on seed, run and particle only."""
    classes, grid = start_grid(problem, most)
    ks = [f"k_{s}" for s in problem.sides]
    run = Window.partitionBy("run_id").orderBy(*ks)
    ranked = grid.select("run_id", *ks, F.sum("p").over(run.rowsBetween(Window.unboundedPreceding, 0)).alias("cdf"), F.row_number().over(run).alias("at"), F.count(F.lit(1)).over(Window.partitionBy("run_id")).alias("all"))
    slots = F.explode(F.sequence(F.lit(1), F.lit(particles))).alias("particle_id")
    u = F.xxhash64(F.lit(seed), "run_id", "particle_id") / F.lit(2.0**64) + 0.5
    fits = ranked.select("*", slots).where((F.col("cdf") > u) | (F.col("at") == F.col("all")))
    first = fits.groupBy(*PARTICLE).agg(F.min_by(F.struct(*ks), "at").alias("k"))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"k.k_{s}").alias("k")) for s in problem.sides])).alias("s")
    picks = first.select(*PARTICLE, sides).select(*PARTICLE, "s.*")
    held = picks.join(classes.select("run_id", "side", "k", "units", "labels"), ["run_id", "side", "k"])
    return held.select(*KEYS, F.explode(F.arrays_zip("units", "labels")).alias("u")).select(*KEYS, F.col("u.units").alias("unit_id"), F.col("u.labels").alias("cluster_id"))


def candidates(problem: Problem, at: DataFrame, share: float = 0.05, families: tuple[str, ...] = FAMILIES, keys: list[str] = PARTITION) -> DataFrame:
    """All candidate changes of partitions: keys, cand, unit_id, cluster_id.

    at: keys, unit_id, cluster_id, mean (the current posterior mean), value (least squares). split and spectral cut by value and,
    named ":now", by mean; island, tail and onward rank by mean. onward: each piece of a split, and each
    piece of a tail, joins the nearest cluster outside.
    """
    plain, means = at.select(*keys, "unit_id", "cluster_id"), plain_with(at, keys, "mean")
    near = neighbour_lists(problem.edges)
    kinds = F.explode(F.array(F.struct(F.lit("").alias("_by"), "value"), F.struct(F.lit(":now").alias("_by"), F.col("mean").alias("value")))).alias("_kind")
    both, cuts_by = at.select(*keys, "unit_id", "cluster_id", kinds).select(*keys, "unit_id", "cluster_id", "_kind.*"), [*keys, "_by"]
    named = lambda made: made.withColumn("cand", F.concat("cand", "_by")).drop("_by")
    made = {
        "island": lambda: moves.islands(means, None, keys, "value", share),
        "border": lambda: moves.borders(problem.edges, plain, keys),
        "merge": lambda: moves.merges(problem.edges, plain, keys),
        "split": lambda: named(parts.kmeans_parts(both, None, cuts_by)),
        "spectral": lambda: named(parts.spectral_cuts(both, None, near, cuts_by)),
        "tail": lambda: moves.tails(means, None, keys, "value"),
    }
    cands = moves.cut(problem.edges, reduce(DataFrame.unionByName, [made[name]() for name in families if name != "onward"]), keys)
    if "onward" not in families:
        return cands
    cands = written(cands, "cuts")
    cuts = cands.where(F.split("cand", ":")[0].isin("kmeans", "spectral", "tail"))
    nearest = parts.nearest_outside(problem.edges, means, None, keys, cuts)
    ends = moves.tail_sets(means, None, keys, "value").select(*keys, F.concat_ws(":", F.lit("tail"), "cluster_id", "end", "size").alias("cand"), "unit_id")
    peeled = cuts.join(ends, [*keys, "cand", "unit_id"]).select(*keys, "cand", F.col("cluster_id").alias("piece")).distinct()
    movable = nearest.where(~F.col("cand").startswith("tail:")).unionByName(nearest.join(peeled, [*keys, "cand", "piece"]).select(*nearest.columns))
    return cands.unionByName(parts.join_one(plain, keys, cuts, movable))


def plain_with(at: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, unit_id, cluster_id, and a column as value."""
    return at.select(*keys, "unit_id", "cluster_id", F.col(column).alias("value"))


def level_candidates(problem: Problem, at: DataFrame, keys: list[str] = PARTITION, local: bool = False) -> DataFrame:
    """The candidates of the model with levels alone, by the current means; local: every unit as an island instead."""
    plain, means = at.select(*keys, "unit_id", "cluster_id"), at.select(*keys, "unit_id", F.col("mean").alias("value"))
    if local:
        return mean_only.local_candidates(problem.edges, plain, means, keys)
    return mean_only.candidates(problem.edges, plain, means, keys).unionByName(mean_only.split_candidates(problem.edges, plain, means, keys))


@dataclass
class Fit:
    """What a search leaves.

    assignment: KEYS, unit_id, cluster_id (1, 2, ... by least unit). estimates: KEYS, unit_id, mean. particles: run_id, particle_id, k_<side>..., log_post, w.
    sweeps: how many were made; settled: whether the last one changed nothing.
    """

    assignment: DataFrame
    estimates: DataFrame
    particles: DataFrame
    sweeps: int
    settled: bool


def _particles(problem: Problem, sums: DataFrame, temper: float) -> DataFrame:
    """run_id, particle_id, k_<side>..., log_post, w."""
    prior = problem.prior

    def posts(rows: pd.DataFrame) -> pd.DataFrame:  # the sides of a run's particles
        own = rows["inner"] + [float(prior.outer(int(k), int(n))) for k, n in zip(rows["k"], rows["units"])]
        by = rows.assign(prior=own).groupby("particle_id")[["quad", "log_det", "prior"]].sum()
        return pd.DataFrame({"run_id": rows["run_id"].iloc[0], "particle_id": by.index, "log_post": log_posterior(by["quad"].to_numpy(), by["log_det"].to_numpy(), by["prior"].to_numpy(), rows.iloc[0])})

    post = sums.groupBy("run_id").applyInPandas(posts, "run_id int, particle_id int, log_post double")
    pick = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    rows = sums.groupBy(*PARTICLE).agg(*[pick("k", s).alias(f"k_{s}") for s in problem.sides], F.concat_ws(":", *[pick("sig", s).cast("string") for s in problem.sides]).alias("signature"))
    return tempered_weights(rows.join(post, PARTICLE), temper or 1.0).drop("signature")


class _Search:
    """Particles (sums), the partitions they have had (book), and the candidates of these (tables)."""

    def __init__(self, problem: Problem, start: DataFrame, temper: float):
        self.problem, self.temper = problem, temper
        whole = written(_whole(problem, start, KEYS), "start")
        slots = whole.groupBy("run_id").agg(F.count_distinct("particle_id").alias("slots"))
        rows = whole.select(*KEYS, "quad", "log_det", "k", "inner", "sig", F.size("units").alias("units")).join(slots, "run_id").join(problem.law, "run_id")
        self.sums = written(rows.withColumn("w", 1 / F.col("slots")).drop("slots"), "sums")
        one = whole.groupBy("run_id", "side", F.col("sig").alias("of")).agg(F.min("particle_id").alias("particle_id"))
        self.fresh = written(spread_out(whole.join(one, KEYS), PARTITION), "book")
        self.book, self.options = [self.fresh], {}

    def _all(self, tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, tables)

    def turn(self, kind: str, make) -> bool:
        """Make the candidates of the partitions that have none of this kind, let all particles take their best; whether any did."""
        problem = self.problem
        todo, tables = self.options.setdefault(kind, [list(self.book), []])
        if todo:
            at = self._all(todo).join(self.sums.select("run_id", "side", F.col("sig").alias("of")).distinct(), PARTITION, "left_semi")
            at = at.join(problem.values(), ["run_id", "side", "unit_id"])
            at = written(at, "at")
            tables.append(written(problem.tried(make(at), at, PARTITION), "tried"))
            todo.clear()
        options = self._all(tables)
        moved = written(chosen(self.sums, options.select(*PARTITION, "cand", "quad", "log_det", "k", "inner", "sig"), problem.sides, problem.prior, self.temper), "moved")
        taken = moved.where(F.col("cand").isNotNull()).select("run_id", "side", F.col("was").alias("of"), "cand", F.col("sig").alias("new")).distinct()
        known = self._all(self.book).select("run_id", "side", F.col("of").alias("new")).distinct()
        changed = not moved.where(F.col("cand").isNotNull()).isEmpty()
        if changed:
            taken = written(taken.groupBy("run_id", "side", "new").agg(F.min(F.struct("of", "cand")).alias("t")).select("run_id", "side", "new", "t.*").join(known, ["run_id", "side", "new"], "left_anti"), "taken")
            own = ["run_id", "side", "new"]
            touched = spread_out(options.join(taken.select(*PARTITION, "cand", "new"), [*PARTITION, "cand"]), own)
            before = self._all(self.book).join(taken.select(*PARTITION, "new"), PARTITION).select(*own, "unit_id", "cluster_id", "mean", "quad", "log_det", "n")
            after = before.join(touched.select(*own, "unit_id"), [*own, "unit_id"], "left_anti").unionByName(touched)
            self.fresh = written(after.withColumnRenamed("new", "of"), "book")
            self.book.append(self.fresh)
            for todo, _ in self.options.values():
                todo.append(self.fresh)
        self.sums = moved.drop("cand", "was")
        return changed

    def particles(self) -> DataFrame:
        """run_id, particle_id, k_<side>..., log_post, w."""
        return _particles(self.problem, self.sums, self.temper)

    def reweighed(self) -> None:
        """The weights by the particles as they are now."""
        self.sums = written(self.sums.drop("w").join(self.particles().select(*PARTICLE, "w"), PARTICLE), "sums")

    def fit(self, sweeps: int, settled: bool) -> Fit:
        units = self._all(self.book).withColumnRenamed("of", "sig").join(self.sums.select(*KEYS, "sig"), ["run_id", "side", "sig"])
        units = written(units.select(*KEYS, "unit_id", "cluster_id", "mean"), "found")
        particles = written(self.particles(), "particles")
        dropped(*self.book, *[t for _, tables in self.options.values() for t in tables])
        return Fit(relabelled(units.drop("mean"), KEYS), units.drop("cluster_id"), particles, sweeps, settled)


def _small(problem: Problem) -> bool:
    """Whether every run may be held by a task."""
    largest = problem.facts.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"]
    return (largest or 0) <= IN_TASK


def _in_tasks(problem: Problem, start: DataFrame, temper: float, most_sweeps: int, last_islands: bool, families: tuple[str, ...]) -> Fit:
    """ensemble_fit with every run inside of a task; each run's sweeps end when nothing changes in it."""
    prior, rho, levels, sides = problem.prior, problem.rho, problem.levels, problem.sides
    labels = moves.cut(problem.edges, start.select(*KEYS, F.lit("whole").alias("cand"), "unit_id", F.col("cluster_id").alias("part")), KEYS)
    held = labels.groupBy(*KEYS).agg(F.collect_list(F.struct("unit_id", "cluster_id")).alias("m")).select(*KEYS, F.col("m.unit_id").alias("members"), F.col("m.cluster_id").alias("labels"))
    held = held.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("particle_id", "side", "members", "labels"))).alias("s"))
    t = F.col("terms")
    unit = F.struct("unit_id", "near", t["side"].alias("sides"), t["b"].alias("b"), t["w"].alias("w"), t["c1"].alias("c1"), t["c2"].alias("c2"), F.array(*[F.col("values")[s].cast("double") for s in sides]).alias("values"))
    facts = problem.facts.groupBy("run_id").agg(F.array_sort(F.collect_list(unit), lambda p, q: p["unit_id"] - q["unit_id"]).alias("f"))
    rows = held.join(facts, "run_id").join(problem.law, "run_id")
    flat = rows.select("run_id", *[F.col("s")[c].alias(c) for c in ("particle_id", "side", "members", "labels")], *[F.col("f")[c].alias(f"f_{c}") for c in ("unit_id", "near", "sides", "b", "w", "c1", "c2", "values")], "a", "d", "c")

    def found(r) -> pd.DataFrame | None:
        terms = {s: [t for t, x in enumerate(r.f_sides[0]) if x == s] for s in sides}
        laws = {s: [(float(r.f_c1[0][t]), float(r.f_c2[0][t])) for t in ts] for s, ts in terms.items()}
        if not all(c1 > 0 and c2 > 0 for some in laws.values() for c1, c2 in some):
            return None
        graph = local.Graph(r.f_unit_id, r.f_near)
        column = lambda cells, t: np.array([x[t] for x in cells], float)
        data = {s: ([(column(r.f_b, t), column(r.f_w, t)) for t in ts], laws[s]) for s, ts in terms.items()}
        run = local.Run(graph, data, {s: column(r.f_values, i) for i, s in enumerate(sides)}, pd.Series({"a": r.a, "d": r.d, "c": r.c}), prior, rho, levels, families)
        starts = []
        for particle, side, members, own in zip(r.particle_id, r.side, r.members, r.labels):
            of = dict(zip(members.tolist(), own.tolist()))
            label = np.array([of.get(u, local.NONE) for u in graph.ids], np.int64)
            for c in set(label.tolist()) - {local.NONE}:
                label[label == c] = graph.units[np.flatnonzero(label == c)[0]]
            starts.append((int(particle), side, label))
        sums, labels, sweeps, settled = local.searched(run, starts, int(r.run_id), temper, most_sweeps, last_islands)
        at = [labels[s, g] for s, g in zip(sums["side"], sums["sig"].tolist())]
        means = []
        for side, label in zip(sums["side"], at):
            mean = np.full(len(label), np.nan)
            for own in local.Partition(graph, label).clusters.values():
                mean[own] = run.cluster(side, tuple(own))[2]
            means.append(mean[label != local.NONE])
        return sums.assign(members=[graph.units[x != local.NONE] for x in at], labels=[x[x != local.NONE] for x in at], means=means, sweeps=sweeps, settled=settled)

    def work(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                if (made := found(r)) is not None:
                    yield made

    schema = "run_id int, particle_id int, side string, quad double, log_det double, k int, inner double, sig bigint, units int, w double, a double, d double, c double, members array<int>, labels array<int>, means array<double>, sweeps int, settled boolean"
    made = written(flat.repartition(8 * flat.sparkSession.sparkContext.defaultParallelism).mapInPandas(work, schema), "searched")
    zipped = F.explode(F.arrays_zip("members", "labels", "means")).alias("u")
    units = made.select(*KEYS, zipped).select(*KEYS, F.col("u.members").alias("unit_id"), F.col("u.labels").alias("cluster_id"), F.col("u.means").alias("mean"))
    ended = made.agg(F.max("sweeps").alias("sweeps"), F.coalesce(F.bool_and("settled"), F.lit(True)).alias("settled")).first()
    return Fit(relabelled(units.drop("mean"), KEYS), units.drop("cluster_id"), written(_particles(problem, made, temper), "particles"), ended["sweeps"] or 0, ended["settled"])


def ensemble_fit(problem: Problem, particles: int = 10, temper: float = 10.0, start: DataFrame | None = None, most_sweeps: int = 25, last_islands: bool = True, families: tuple[str, ...] = FAMILIES) -> Fit:
    """An ensemble of particles per run, from drawn_starts or the given start (KEYS, unit_id, cluster_id; clusters are made connected).

    In a sweep the particles take turns, and the weights stay as they are; after it they are
    computed anew. Sweeps end when nothing changes. In the model with levels alone, where nothing else is better every unit is
    tried as an island, and the sweeps go on if that is. last_islands: every unit is tried as an
    island in the end, and the weights are computed once more.
    """
    start = drawn_starts(problem, particles) if start is None else start
    if _small(problem):
        return _in_tasks(problem, start, temper, most_sweeps, last_islands, families)
    search = _Search(problem, start, temper)
    make = (lambda at: level_candidates(problem, at)) if problem.levels else (lambda at: candidates(problem, at, families=families))
    sweeps, settled = 0, False
    while sweeps < most_sweeps and not settled:
        sweeps += 1
        changed = search.turn("all", make)
        if not changed and problem.levels:
            changed = search.turn("local", lambda at: level_candidates(problem, at, local=True))
        settled = not changed
        if temper:  # without, a particle's choice is its own, whatever its weight
            search.reweighed()
    if last_islands and not problem.levels:
        search.turn("islands", lambda at: candidates(problem, at, 1.0, ("island",)))
        search.reweighed()
    return search.fit(sweeps, settled)


def map_fit(problem: Problem, start: DataFrame | None = None, most_sweeps: int = 100, families: tuple[str, ...] = FAMILIES) -> Fit:
    """The particle of greatest log posterior that the moves reach, of each run, from one drawn start or the given one."""
    return ensemble_fit(problem, 1, 0.0, start, most_sweeps, False, families)


def poisson_fit(problem: Problem, counts: DataFrame, start: DataFrame | None = None, most_rounds: int = 25, families: tuple[str, ...] = FAMILIES) -> tuple[DataFrame, DataFrame]:
    """(assignment, run_id and log_post) of the pair of greatest Laplace evidence of counts that the moves reach, for each run.

    problem: of the counts on the scale of a logarithm; its means and values make the candidates. counts: run_id, unit_id, t, x, y. A
    candidate is scored as a whole particle, since the evidence of counts does not part into clusters; the sides take their best
    change by turns until neither has one. Runs that a round left as they were are left out of later rounds.
    """
    start = drawn_starts(problem, 1) if start is None else start
    labels = _whole(problem, start, KEYS)
    now = written(spread_out(labels, KEYS).join(problem.values(), ["run_id", "side", "unit_id"]), "now")
    near, done = neighbour_lists(problem.edges), None
    for _ in range(most_rounds):
        moved = None
        for side in problem.sides:
            at = now if done is None else now.join(done, "run_id", "left_anti")
            cands = candidates(problem, at.where(F.col("side") == side), families=families, keys=KEYS).drop("particle_id", "side")
            names = cands.select("run_id", "cand").distinct().unionByName(at.select("run_id", F.lit("").alias("cand")).distinct())
            names = written(names.withColumn("particle_id", F.row_number().over(Window.partitionBy("run_id").orderBy("cand")).cast("int")), "names")
            cands = written(cands, "cands")
            pick = lambda s: F.max(F.when(F.col("side") == s, F.col("cluster_id")))
            base = at.groupBy("run_id", "unit_id").agg(pick("A").alias("ca"), pick("B").alias("cb"))
            own = F.coalesce(F.col("cluster_id"), F.col("ca" if side == "A" else "cb"))
            both = names.join(base, "run_id").join(cands, ["run_id", "cand", "unit_id"], "left")
            both = both.withColumn("ca" if side == "A" else "cb", own).drop("cluster_id")
            like = poisson_laplace(over_cores(packed_pairs(both, counts, near, problem.hyper)), problem.rho)
            prior = prior_py(both.select(*PARTICLE, "unit_id", F.col("ca" if side == "A" else "cb").alias("cluster_id")), PARTICLE, problem.prior.eta, problem.prior.sigma)
            scored = like.join(prior, PARTICLE).join(names, PARTICLE).select("run_id", "cand", F.round(F.col("log_like") + F.col("log_prior"), 9).alias("post"))
            best = scored.groupBy("run_id").agg(F.min_by("cand", F.struct(-F.col("post"), "cand")).alias("cand"))
            best = written(best.where(F.col("cand") != ""), "best")
            if not best.isEmpty():
                new = cands.join(best, ["run_id", "cand"]).select("run_id", F.lit(side).alias("side"), "unit_id", F.col("cluster_id").alias("_new"))
                label = now.select(*KEYS, "unit_id", "cluster_id").join(new, ["run_id", "side", "unit_id"], "left").select(*KEYS, "unit_id", F.coalesce("_new", "cluster_id").alias("cluster_id"))
                now = written(spread_out(_whole(problem, label, KEYS), KEYS).join(problem.values(), ["run_id", "side", "unit_id"]), "now")
                moved = best.select("run_id") if moved is None else moved.unionByName(best.select("run_id"))
        if moved is None:
            break
        done = now.select("run_id").distinct().join(moved, "run_id", "left_anti")
    pairs = now.groupBy(*PARTICLE, "unit_id").agg(F.max(F.when(F.col("side") == "A", F.col("cluster_id"))).alias("ca"), F.max(F.when(F.col("side") == "B", F.col("cluster_id"))).alias("cb"))
    like = poisson_laplace(packed_pairs(pairs, counts, near, problem.hyper), problem.rho)
    prior = prior_py(now, KEYS, problem.prior.eta, problem.prior.sigma).groupBy(*PARTICLE).agg(F.sum("log_prior").alias("log_prior"))
    return relabelled(now.select(*KEYS, "unit_id", "cluster_id"), KEYS), like.join(prior, PARTICLE).select("run_id", (F.col("log_like") + F.col("log_prior")).alias("log_post"))


def whole_fit(panel: DataFrame, edges: DataFrame, particles: int = 10, temper: float = 10.0, rho: float = 0.9, prior: Prior | None = None) -> tuple[Fit, Fit, DataFrame]:
    """(ensemble, best particle, hyperparameters): map_fit, tuned at what it finds, and an ensemble from there with the tuned hyperparameters."""
    problem = Problem.of(panel, edges, None, rho, prior)
    best = map_fit(problem)
    hyper = written(tuned(problem, best.assignment), "tuned")
    start = best.assignment.drop("particle_id").withColumn("particle_id", F.explode(F.sequence(F.lit(1), F.lit(particles))))
    return ensemble_fit(Problem.of(panel, edges, hyper, rho, prior), particles, temper, start), best, hyper


def tuned(problem: Problem, assignment: DataFrame, most_rounds: int = 40, width: float = 4.0, tolerance: float = 0.01) -> DataFrame:
    """The hyperparameters with a1 and b1 moved to where the likelihood of particle 1 is greatest, and settled; a2 and b2 stay.

    A round scores 5 × 5 factors, up to width either way at first, of all unsettled runs in one batch
    and moves the centre to the best. The factors narrow, their logarithm by half, unless the best
    lies on the grid's edge. A run is settled when the centre beats factors of at most 1 + tolerance;
    it is not if most_rounds were too few, or if a hyperparameter is not above 0 (all then stay).
    """
    names = ["run_id", "a1", "a2", "b1", "b2", "alpha_sigma", "beta_sigma"]
    usable = F.coalesce((F.col("a1") > 0) & (F.col("a2") > 0) & (F.col("b1") > 0) & (F.col("b2") > 0), F.lit(False))
    out = problem.hyper.where(~usable).select(*names, F.lit(False).alias("settled"))
    todo = problem.hyper.where(usable).select(*names, F.lit(math.log(width) / 2).alias("gap"))
    if problem.sides == "AB" and _small(problem):
        return out.unionByName(_tuned_in_tasks(problem, assignment, todo.drop("gap"), most_rounds, width, tolerance))
    near = neighbour_lists(problem.edges)
    for _ in range(most_rounds):
        steps = F.array(*[F.lit(i) for i in (-2, -1, 0, 1, 2)])
        grid = todo.withColumn("ia", F.explode(steps)).withColumn("ib", F.explode(steps))
        grid = grid.withColumn("a1", F.col("a1") * F.exp(F.col("ia") * F.col("gap"))).withColumn("b1", F.col("b1") * F.exp(F.col("ib") * F.col("gap")))
        grid = written(grid.withColumn("point", (5 * F.col("ia") + F.col("ib") + 13).cast("int")), "grid")
        a = assignment.where("particle_id = 1").drop("particle_id").join(grid.select("run_id", F.col("point").alias("particle_id")), "run_id")
        sides = F.array(F.struct(F.lit("A").alias("side"), F.col("sum_y").alias("b"), F.col("periods").cast("double").alias("w"), F.col("a1").alias("c1"), F.col("a2").alias("c2")), F.struct(F.lit("B").alias("side"), F.col("sum_xy").alias("b"), F.col("sum_xx").alias("w"), F.col("b1").alias("c1"), F.col("b2").alias("c2")))
        units = problem.units.join(grid.select("run_id", F.col("point").alias("particle_id"), "a1", "a2", "b1", "b2"), "run_id").select(*PARTICLE, "unit_id", F.explode(sides).alias("s")).select(*PARTICLE, "unit_id", "s.*")
        member = F.struct(F.col("unit_id").cast("int").alias("unit_id"), "b", "w", "neighbours")
        rows = a.join(units, [*KEYS, "unit_id"]).join(near, "unit_id", "left")
        clusters = rows.groupBy(*KEYS, "cluster_id").agg(F.collect_list(member).alias("members"), F.first("c1").alias("c1"), F.first("c2").alias("c2"))
        sums = cluster_stats(clusters, KEYS, problem.rho).groupBy(*PARTICLE).agg(F.sum("quad").alias("quad"), F.sum("log_det").alias("log_det")).join(totals(problem.units, problem.hyper), "run_id")
        like = log_likelihood(*[F.col(c) for c in ("quad", "log_det", "yy", "alpha_sigma", "beta_sigma", "obs")])
        best = sums.groupBy("run_id").agg(F.max_by("particle_id", F.struct(F.round(like, 9), -F.abs(F.col("particle_id") - 13), "particle_id")).alias("point"))
        edge = F.greatest(F.abs("ia"), F.abs("ib")) == 2
        moved = written(grid.join(best, ["run_id", "point"]).withColumn("settled", ~edge & (F.col("gap") <= math.log(1 + tolerance))).withColumn("gap", F.when(edge, F.col("gap")).otherwise(F.col("gap") / 2)).select(*names, "gap", "settled"), "tuned")
        out = out.unionByName(moved.where("settled").select(*names, "settled"))
        todo = moved.where(~F.col("settled")).select(*names, "gap")
        if todo.isEmpty():
            return out
    return out.unionByName(todo.select(*names, F.lit(False).alias("settled")))


def _tuned_in_tasks(problem: Problem, assignment: DataFrame, hyper: DataFrame, most_rounds: int, width: float, tolerance: float) -> DataFrame:
    """tuned, with all rounds of a run inside of a task. A side's numbers depend on its own factor alone, so a round has 5 + 5 of them for its 25 points."""
    rho, names = problem.rho, ["run_id", "a1", "a2", "b1", "b2", "alpha_sigma", "beta_sigma"]
    own = assignment.where("particle_id = 1").select("run_id", "unit_id", "side", "cluster_id")
    rows = own.join(problem.facts.select("run_id", "unit_id", "near", F.explode("terms").alias("t")), ["run_id", "unit_id"]).where(F.col("side") == F.col("t.side"))
    packed = rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("side", "cluster_id", "unit_id", "near", "t.b", "t.w"))).alias("m"))
    flat = hyper.join(packed, "run_id").join(problem.law, "run_id").select(*names, "a", "d", "c", *[F.col("m")[c].alias(f"m_{c}") for c in ("side", "cluster_id", "unit_id", "near", "b", "w")])

    def moved(r) -> list:
        clusters: dict = {"A": {}, "B": {}}
        for side, c, *unit in zip(r.m_side, r.m_cluster_id, r.m_unit_id, r.m_near, r.m_b, r.m_w):
            clusters[side].setdefault(c, []).append(unit)
        ready = {}
        for side, by in clusters.items():
            ready[side] = [(local.Graph([u[0] for u in some], [u[1] for u in some]).matrix(list(range(len(some)))), *(np.array([u[i] for u in some], float) for i in (2, 3))) for some in by.values()]

        def of(side: str, c1: float, c2: float) -> np.ndarray:
            return np.sum([cluster_numbers(precision_of(a, rho, c1, c2), b, w)[:2] for a, b, w in ready[side]], axis=0)

        a1, b1, gap, steps = r.a1, r.b1, math.log(width) / 2, (-2, -1, 0, 1, 2)
        for _ in range(most_rounds):
            by_a, by_b = ({i: of(side, c1 * math.exp(i * gap), c2) for i in steps} for side, c1, c2 in (("A", a1, r.a2), ("B", b1, r.b2)))
            like = lambda i, j: log_posterior(by_a[i][0] + by_b[j][0], by_a[i][1] + by_b[j][1], 0.0, r)  # noqa: B023, E731
            *_, i, j = max((round(like(i, j), 9), -abs(5 * i + j), 5 * i + j, i, j) for i in steps for j in steps)
            a1, b1 = a1 * math.exp(i * gap), b1 * math.exp(j * gap)
            edge = 2 in (abs(i), abs(j))
            if not edge and gap <= math.log(1 + tolerance):
                return [r.run_id, a1, r.a2, b1, r.b2, r.alpha_sigma, r.beta_sigma, True]
            gap = gap if edge else gap / 2
        return [r.run_id, a1, r.a2, b1, r.b2, r.alpha_sigma, r.beta_sigma, False]

    def work(batches):
        for batch in batches:
            yield pd.DataFrame([moved(r) for r in batch.itertuples(index=False)], columns=[*names, "settled"])

    types = dict(hyper.dtypes)
    found = flat.repartition(8 * flat.sparkSession.sparkContext.defaultParallelism).mapInPandas(work, ", ".join(f"{n} {types[n]}" for n in names) + ", settled boolean")
    lost = hyper.join(own.select("run_id").distinct(), "run_id", "left_semi").join(packed.select("run_id"), "run_id", "left_anti")
    return written(found.unionByName(lost.select(*names, F.lit(False).alias("settled"))), "tuned")
