"""Whole searches against all partitions of a small lattice, and their parts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_panels import lattice

from parcelspark.operators import joint, kernel, mean_only, score, weights
from parcelspark.operators.trial import Prior, chosen, mark
from parcelspark.plans import search
from parcelspark.session import written

HYPER = (0.5, 2.0, 0.3, 1.5, 3.0, 0.7)
SCHEMA = "run_id int, a1 double, a2 double, b1 double, b2 double, alpha_sigma double, beta_sigma double"


def connected_partitions(n, edges):
    """All partitions of 1..n into connected clusters, as lists of frozensets."""
    near = {u: {b for a, b in edges if a == u} for u in range(1, n + 1)}

    def connected(units):
        reached = {min(units)}
        while more := {v for u in reached for v in near[u] if v in units} - reached:
            reached |= more
        return reached == units

    good = [frozenset(u for u in range(1, n + 1) if mask >> (u - 1) & 1) for mask in range(1, 1 << n)]
    good = [c for c in good if connected(set(c))]
    by_least = {u: [c for c in good if min(c) == u] for u in range(1, n + 1)}

    def grow(left):
        if not left:
            yield []
            return
        for c in by_least[min(left)]:
            if c <= left:
                for rest in grow(left - c):
                    yield [c, *rest]

    return list(grow(frozenset(range(1, n + 1))))


@pytest.fixture(scope="module")
def small_world(spark):
    """A 3 × 3 lattice, two runs; levels in two groups, slopes in two others."""
    rng = np.random.default_rng(21)
    rows = []
    for r in (1, 2):
        for u in range(1, 10):
            level, slope = (0.0 if u <= 3 else 2.0 + r), (1.0 if u % 3 else -1.0)
            rows += [(r, u, k, float(k), float(level + slope * k + rng.normal(0, 0.4))) for k in range(-2, 3)]
    panel = spark.createDataFrame(rows, "run_id int, unit_id int, t int, x double, y double")
    edges = spark.createDataFrame(sorted(lattice(3)), "src int, dst int")
    hyper = spark.createDataFrame([(1, *HYPER), (2, *HYPER), (3, *HYPER)], SCHEMA)
    return written(panel, "panel"), edges, hyper


def numbers(problem, run, side, partitions, edges, inner):
    """quad, log_det, prior and number of clusters of each partition."""
    facts = {r["unit_id"]: next(t for t in r["terms"] if t["side"] == side) for r in problem.facts.where(F.col("run_id") == run).collect()}
    near = {u: [b for a, b in edges if a == u] for u in facts}
    memo = {}

    def of(c):
        if c not in memo:
            units = np.array(sorted(c))
            t = [facts[u] for u in units]
            q, d, _ = kernel.cluster_numbers(kernel.within_precision(units, [near[u] for u in units], problem.rho, t[0]["c1"], t[0]["c2"]), np.array([x["b"] for x in t]), np.array([x["w"] for x in t]))
            memo[c] = (q, d, inner(len(c)))
        return memo[c]

    return np.array([np.sum([of(c) for c in p], axis=0) for p in partitions])


@pytest.mark.parametrize("prior", [Prior("uniform"), Prior("pitman", 2.0, 0.25)])
def test_map_is_the_best_of_all(spark, small_world, prior):
    """The search ends at the pair of greatest log posterior among all 1,434 × 1,434 pairs."""
    panel, edges, hyper = small_world
    problem = search.Problem.of(panel, edges, hyper, prior=prior)
    fit = search.map_fit(problem)
    assert fit.settled
    found = {r["run_id"]: r for r in fit.particles.collect()}
    every = connected_partitions(9, lattice(3))
    assert len(every) == 1434 and set(found) == {1, 2}
    k = np.array([len(p) for p in every])
    law = {r["run_id"]: r for r in problem.law.collect()}
    for run in (1, 2):
        a, b = (numbers(problem, run, s, every, sorted(lattice(3)), prior.inner) for s in "AB")
        p = [x[:, 2] + prior.outer(k, 9) for x in (a, b)]
        quad, det = a[:, None, 0] + b[None, :, 0], a[:, None, 1] + b[None, :, 1]
        post = det / 2 - law[run]["a"] * np.log(law[run]["d"] + quad / 2) + law[run]["c"] + p[0][:, None] + p[1][None, :]
        assert math.isclose(found[run]["log_post"], post.max(), rel_tol=1e-9)
        i, j = np.unravel_index(post.argmax(), post.shape)
        for side, best in (("A", every[i]), ("B", every[j])):
            rows = fit.assignment.where((F.col("run_id") == run) & (F.col("side") == side)).toPandas()
            assert sorted(map(sorted, (g.unit_id.tolist() for _, g in rows.groupby("cluster_id")))) == sorted(map(sorted, best))


def test_ensemble(spark, small_world):
    panel, edges, hyper = small_world
    problem = search.Problem.of(panel, edges, hyper)
    fit = search.ensemble_fit(problem, 4, 3.0)
    rows = fit.particles.toPandas()
    assert fit.settled and len(rows) == 8 and np.allclose(rows.groupby("run_id").w.sum(), 1)
    want = {(r["run_id"], r["particle_id"]): r["log_post"] for r in score.scored_particles(fit.assignment, problem.units, problem.edges, hyper.where("run_id < 3")).collect()}
    assert all(math.isclose(want[r.run_id, r.particle_id], r.log_post, rel_tol=1e-9) for r in rows.itertuples())
    labels = fit.assignment.toPandas()
    assert all(sorted(g.unit_id) == list(range(1, 10)) for _, g in labels.groupby(["run_id", "particle_id", "side"]))
    pairs = labels.sort_values("unit_id").groupby(["run_id", "particle_id"]).cluster_id.apply(tuple)
    assert all(len(set(pairs[r])) > 1 for r in (1, 2))  # the entropy holds particles apart
    best = search.map_fit(problem).particles.toPandas().set_index("run_id").log_post
    assert (rows.groupby("run_id").log_post.max() <= best + 1e-6).all()
    stats = {(r["run_id"], r["particle_id"], r["side"], r["unit_id"]): r["mean"] for r in score.posterior_means(score.scored_clusters(fit.assignment, problem.units, edges, hyper, search.KEYS), search.KEYS).collect()}
    assert all(math.isclose(stats[r["run_id"], r["particle_id"], r["side"], r["unit_id"]], r["mean"], rel_tol=1e-9) for r in fit.estimates.collect())


def test_starts(spark, small_world):
    panel, edges, hyper = small_world
    problem = search.Problem.of(panel, edges, hyper)
    grid = search.start_grid(problem)[1].toPandas()
    assert np.allclose(grid.groupby("run_id").p.sum(), 1) and set(grid.k_A) == {1, 2}
    for r in grid.itertuples():
        same = grid[grid.run_id == r.run_id]
        assert math.isclose(r.p, math.exp(r.log_post - same.log_post.max()) / np.exp(same.log_post - same.log_post.max()).sum(), rel_tol=1e-9)
    drawn = search.drawn_starts(problem, 300).groupBy("run_id", "particle_id", "side").agg(F.count_distinct("cluster_id").alias("k")).toPandas().pivot(index=["run_id", "particle_id"], columns="side", values="k")
    one = (drawn["A"] == 1) & (drawn["B"] == 1)
    want = grid[(grid.k_A == 1) & (grid.k_B == 1)].set_index("run_id").p
    assert len(drawn) == 600 and (abs(one.groupby("run_id").mean() - want) < 0.08).all()
    again = search.drawn_starts(problem, 300).toPandas()
    assert len(again) == 600 * 18


def test_other_models(spark, small_world):
    """Equal sides and levels alone: the search ends at the best of all partitions of the one side."""
    panel, edges, hyper = small_world
    every = connected_partitions(9, lattice(3))
    equal = search.map_fit(search.Problem.of(panel, edges, hyper, equal=True))
    both = equal.assignment.withColumn("side", F.explode(F.array(F.lit("A"), F.lit("B"))))
    want = {r["run_id"]: r for r in score.scored_particles(both, search.Problem.of(panel, edges, hyper).units, edges, hyper).collect()}
    for r in equal.particles.collect():
        assert math.isclose(r["log_post"], want[r["run_id"]]["log_like"] + want[r["run_id"]]["log_prior"] / 2, rel_tol=1e-9)  # one partition, one prior
    plain = search.Problem.of(panel, edges, hyper)
    law = {r["run_id"]: r for r in plain.law.collect()}
    for run in (1, 2):
        a, b = (numbers(plain, run, s, every, sorted(lattice(3)), Prior().inner) for s in "AB")
        post = (a[:, 1] + b[:, 1]) / 2 - law[run]["a"] * np.log(law[run]["d"] + (a[:, 0] + b[:, 0]) / 2) + law[run]["c"] + a[:, 2] + Prior().outer(np.array([len(p) for p in every]), 9)
        assert math.isclose(post.max(), equal.particles.where(F.col("run_id") == run).first()["log_post"], rel_tol=1e-9)

    one = spark.createDataFrame([(r, 0.5, 2.0, 3.0, 0.7) for r in (1, 2)], "run_id int, a1 double, a2 double, nu double, lambda double")
    levels = search.Problem.of_levels(panel, edges, one)
    fit = search.map_fit(levels)
    got = {r["run_id"]: r["log_post"] for r in fit.particles.collect()}
    scores = {r["run_id"]: r["log_post"] for r in mean_only.mean_only_scores(fit.assignment, panel, edges, one).collect()}
    law = {r["run_id"]: r for r in levels.law.collect()}
    for run in (1, 2):
        x = numbers(levels, run, "A", every, sorted(lattice(3)), levels.prior.inner)
        post = x[:, 1] / 2 - law[run]["a"] * np.log(law[run]["d"] + x[:, 0] / 2) + law[run]["c"] + x[:, 2]
        assert math.isclose(got[run], scores[run], rel_tol=1e-9) and math.isclose(got[run], post.max(), rel_tol=1e-9)


def test_turns_by_brute_force(spark):
    """Particles in turn, against the objective computed from whole weights."""
    law = {"a": 4.0, "d": 30.0, "c": 0.5}
    sums = [(1, p, s, -3.0 - p, 0.5, 2, 0.1, sig, 5, w) for p, w in ((1, 0.5), (2, 0.3), (3, 0.2)) for s, sig in (("A", 10 if p < 3 else 20), ("B", 7))]
    df = spark.createDataFrame([(*r, *law.values()) for r in sums], "run_id int, particle_id int, side string, quad double, log_det double, k int, inner double, sig bigint, units int, w double, a double, d double, c double")
    cands = [(1, "A", 10, "x", -0.4, 0.3, 1, 0.2, 10 ^ 20), (1, "A", 10, "y", -0.1, 0.1, 0, 0.0, 3), (1, "B", 7, "z", 0.1, 0.0, 0, 0.1, 5), (1, "A", 20, "u", -0.1, 0.1, 0, 0.0, 20 ^ 10)]
    options = spark.createDataFrame(cands, "run_id int, side string, of bigint, cand string, quad double, log_det double, k int, inner double, sig bigint")
    prior, temper = Prior("pitman", 2.0, 0.5), 3.0
    got = {(r["particle_id"], r["side"]): (r["cand"], r["sig"]) for r in chosen(df, options, "AB", prior, temper).collect()}
    state = {(p, s): [q, d, k, i, sig] for _, p, s, q, d, k, i, sig, _, _ in sums}
    weight = {1: 0.5, 2: 0.3, 3: 0.2}

    def objective(st):
        total = 0.0
        pooled = {}
        for p in weight:
            a, b = st[p, "A"], st[p, "B"]
            post = (a[1] + b[1]) / 2 - law["a"] * math.log(law["d"] + (a[0] + b[0]) / 2) + law["c"] + sum(x[3] + float(prior.outer(x[2], 5)) for x in (a, b))
            total += weight[p] * post
            pooled[a[4], b[4]] = pooled.get((a[4], b[4]), 0.0) + weight[p]
        return total - temper * sum(w * math.log(w) for w in pooled.values())

    want = {}
    for p in (1, 2, 3):
        for s in "AB":
            best, pick = objective(state) + 1e-9, None
            for _, side, of, name, *d in cands:
                if side == s and of == state[p, s][4]:
                    x = state[p, s]
                    trial = {**state, (p, s): [x[0] + d[0], x[1] + d[1], x[2] + d[2], x[3] + d[3], x[4] ^ d[4]]}
                    if objective(trial) > best:
                        best, pick = objective(trial), trial
                        want[p, s] = name
            state = pick or state
    assert {at: c for at, (c, _) in got.items() if c} == want and {at: sig for at, (_, sig) in got.items()} == {at: x[4] for at, x in state.items()}
    assert len(want) >= 2


def test_counts(spark):
    """The search on counts ends at the best of all pairs of partitions of four units."""
    rng = np.random.default_rng(8)
    rows = [(1, u, k, float(k), float(rng.poisson(np.exp(1.0 + (u > 2) * 1.5 + 0.2 * k)))) for u in range(1, 5) for k in range(-2, 3)]
    counts = written(spark.createDataFrame(rows, "run_id int, unit_id int, t int, x double, y double"), "counts")
    edges, hyper = spark.createDataFrame(sorted(lattice(2)), "src int, dst int"), spark.createDataFrame([(1, *HYPER)], SCHEMA)
    problem = search.Problem.of(counts.withColumn("y", F.asinh("y") - math.log(2)), edges, hyper)
    found = search.poisson_fit(problem, counts)[1].first()["log_post"]
    every = connected_partitions(4, lattice(2))
    rows = [(1, i * len(every) + j + 1, s, u, c) for i, a in enumerate(every) for j, b in enumerate(every) for s, p in (("A", a), ("B", b)) for c, us in enumerate(p) for u in us]
    asg = spark.createDataFrame(rows, "run_id int, particle_id int, side string, unit_id int, cluster_id int")
    like = joint.poisson_laplace(joint.packed_particles(asg, counts, score.neighbour_lists(edges), hyper))
    prior = weights.prior_py(asg, search.KEYS).groupBy("run_id", "particle_id").agg(F.sum("log_prior").alias("log_prior"))
    best = like.join(prior, search.PARTICLE).select((F.col("log_like") + F.col("log_prior")).alias("p")).agg(F.max("p")).first()[0]
    assert math.isclose(found, best, rel_tol=1e-7)


def test_marks():
    a = mark(np.array([1, 2, 3]), np.array([1, 1, 3]))
    assert a == mark(np.array([3, 1]), np.array([3, 1])) ^ mark(np.array([2]), np.array([1])) and a != mark(np.array([1, 2, 3]), np.array([1, 2, 3]))


def test_wrong_arguments(spark, small_world):
    panel, edges, hyper = small_world
    for wrong in (dict(rho=1.0), dict(prior=Prior("pitman"), rho=-0.1)):
        with pytest.raises(ValueError):
            search.Problem.of(panel, edges, hyper, **wrong)
    for wrong in (("none",), ("pitman", 0.0), ("pitman", 1.0, 1.0)):
        with pytest.raises(ValueError):
            Prior(*wrong)
    bad = spark.createDataFrame([(1, -0.5, 2.0, 0.3, 1.5, 3.0, 0.7), (2, *HYPER)], SCHEMA)
    fit = search.map_fit(search.Problem.of(panel, edges, bad))
    assert {r["run_id"] for r in fit.particles.collect()} == {2}  # a run without usable hyperparameters is not searched
    none = search.map_fit(search.Problem.of(panel.limit(0), edges, hyper))
    assert none.particles.count() == 0 and none.assignment.count() == 0


def test_candidates_by_current_means(spark):
    """Where shrinkage reorders the units, islands, tails, cuts and merge partners follow the current means; cuts on the least-squares values come beside them."""
    panel = spark.createDataFrame([(1, u, k, float(k), y + (u == 9) * k) for u, y in enumerate([4.0, 0.1, 0.0, 0.2, 2.0, 2.1, 2.2, 2.3, 2.4], 1) for k in range(-2, 3)], "run_id int, unit_id int, t int, x double, y double")
    # Unit 1 has the greatest level, but low neighbours; 5..9 are a chain of levels about 2.
    pairs = [(1, 2), (1, 3), (1, 4), (4, 5), (5, 6), (6, 7), (7, 8), (8, 9)]
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src int, dst int")
    hyper = spark.createDataFrame([(1, 0.02, 2.0, 0.3, 1.5, 3.0, 0.7)], "run_id int, a1 double, a2 double, b1 double, b2 double, alpha_sigma double, beta_sigma double")
    problem = search.Problem.of(panel, edges, hyper)
    asg = spark.createDataFrame([(1, "A", u, 1 if u < 9 else 2) for u in range(1, 10)], "run_id int, side string, unit_id int, cluster_id int")
    keys = ["run_id", "side"]
    whole = search._whole(problem, asg, keys)
    at = written(search.spread_out(whole, keys).join(problem.values(), [*keys, "unit_id"]).withColumn("cluster_id", F.when(F.col("unit_id") < 9, 1).otherwise(2)), "at")
    means = {r["unit_id"]: r["mean"] for r in at.collect()}
    level = {r["unit_id"]: r["value"] for r in at.collect()}
    own = [u for u in means if u < 9]
    top = max(own, key=lambda u: (means[u], -u))
    assert max(own, key=level.get) == 1 and top != 1
    made = {}
    for r in search.candidates(problem, at, families=("island", "split", "spectral"), keys=keys).collect():
        made.setdefault(r["cand"], {}).setdefault(r["cluster_id"], set()).add(r["unit_id"])
    assert {c for c in made if c.startswith("island")} == {f"island:{top}", f"island:{min(own, key=lambda u: (means[u], u))}"}
    assert {"kmeans:1:2", "kmeans:1:2:now", "spectral:1:2", "spectral:1:2:now"} <= set(made)
    order = sorted(own, key=means.get)
    cost = lambda us: sum((means[u] - sum(means[v] for v in us) / len(us)) ** 2 for u in us)
    k = min(range(1, 8), key=lambda k: cost(order[:k]) + cost(order[k:]))
    low = set(order[:k])
    assert all(us <= low or not us & low for us in made["kmeans:1:2:now"].values())
    assert made["kmeans:1:2:now"] != made["kmeans:1:2"]
