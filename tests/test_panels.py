"""Cluster likelihood against the dense model, graphs against plain searches, and small cases."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelspark.operators import compare, graph, joint, kernel, mean_only, moves, panel, partitions, score, weights
from parcelspark.sources import generators


def lattice(side):
    return {(u, v) for u in range(1, side * side + 1) for v in range(1, side * side + 1) if abs(u - v) == side or (abs(u - v) == 1 and (u - 1) // side == (v - 1) // side)}


def dense(n, edges, labels, c1, c2, rho):
    out = np.zeros((n, n))
    for c in set(labels):
        at = [i for i in range(n) if labels[i] == c]
        a = np.array([[float((i + 1, j + 1) in edges) for j in at] for i in at])
        m = rho * (np.diag(a.sum(1)) - a) + (1 - rho) * np.eye(len(at))
        out[np.ix_(at, at)] = c1 * np.linalg.inv(m) + c2
    return out


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(5)
    n, t, edges = 9, 6, lattice(3)
    x = rng.normal(0, 1, (n, t))
    y = rng.normal(1, 1, (n, 1)) + rng.normal(0, 1, (n, 1)) * x + rng.normal(0, 0.3, (n, t))
    rows = [(1, i + 1, k + 1, float(x[i, k]), float(y[i, k])) for i in range(n) for k in range(t)]
    df = spark.createDataFrame(rows, "run_id int, unit_id int, t int, x double, y double")
    la, lb = [1, 1, 1, 2, 2, 2, 3, 3, 3], [1, 1, 2, 1, 1, 2, 2, 2, 2]
    asg = spark.createDataFrame([(1, 1, s, i + 1, lab[i]) for s, lab in (("A", la), ("B", lb)) for i in range(n)], "run_id int, particle_id int, side string, unit_id int, cluster_id int")
    hyper = spark.createDataFrame([(1, 0.5, 2.0, 0.3, 1.5, 3.0, 0.7)], "run_id int, a1 double, a2 double, b1 double, b2 double, alpha_sigma double, beta_sigma double")
    e = spark.createDataFrame(sorted(edges), "src int, dst int")
    return df, asg, hyper, e, x, y, la, lb, edges


def marginal(x, y, la, lb, edges, h=(0.5, 2.0, 0.3, 1.5, 3.0, 0.7), rho=0.9):
    n, t = x.shape
    za, zb = np.kron(np.eye(n), np.ones((t, 1))), np.zeros((n * t, n))
    for i in range(n):
        zb[i * t : (i + 1) * t, i] = x[i]
    s = np.eye(n * t) + za @ dense(n, edges, la, h[0], h[1], rho) @ za.T + zb @ dense(n, edges, lb, h[2], h[3], rho) @ zb.T
    v = y.ravel()
    return -0.5 * np.linalg.slogdet(s)[1] - (h[4] + n * t / 2) * np.log(h[5] + v @ np.linalg.solve(s, v) / 2) + h[4] * np.log(h[5])


def test_likelihoods(spark, world):
    df, asg, hyper, e, x, y, la, lb, edges = world
    near = score.neighbour_lists(e)
    exact = joint.exact_likelihood(joint.packed_particles(asg, df, near, hyper)).first()["log_like"]
    assert math.isclose(exact, marginal(x, y, la, lb, edges), rel_tol=1e-9)
    units = panel.unit_ols(df)
    got = score.scored_particles(asg, units, e, hyper).first()
    slope = np.array([np.polyfit(x[i], y[i], 1)[0] for i in range(len(x))])
    centred = x - x.mean(1, keepdims=True)
    want = marginal(centred, y - (slope * x.mean(1))[:, None], la, lb, edges)
    assert math.isclose(got["log_like"], want, rel_tol=1e-9)
    prior = sum(sum(math.lgamma(lab.count(c)) for c in set(lab)) - math.lgamma(10) for lab in (la, lb))
    assert math.isclose(got["log_prior"], prior, rel_tol=1e-9)


def test_unusable_hyperparameters(spark, world):
    df, asg, hyper, e, *_ = world
    bad = hyper.withColumn("a2", F.lit(-1.0))
    assert score.scored_particles(asg, panel.unit_ols(df), e, bad).first()["log_like"] is None
    assert joint.exact_likelihood(joint.packed_particles(asg, df, score.neighbour_lists(e), bad)).first()["log_like"] is None


def test_poisson_against_quadrature():
    h = {"a1": 0.5, "a2": 1.0, "b1": 1e-8, "b2": 1e-8, "alpha_sigma": 3.0, "beta_sigma": 2.0}
    captured = {}

    class Fake:
        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):
            captured["run"] = run

    Fake.__getitem__ = lambda self, k: self
    x, y = np.array([0.0, 0.0, 0.0, 0.0]), np.array([3.0, 5.0, 4.0, 6.0])
    joint.poisson_laplace(Fake())
    row = pd.DataFrame([{"run_id": 1, "particle_id": 1, **h, "ids": [1], "ca": [1], "cb": [1], "xs": [x], "ys": [y], "near": [[]]}])
    got = next(captured["run"](iter([row])))["log_like"][0]
    s2 = 2.0 / 4.0
    var = s2 * (h["a1"] / 0.1 + h["a2"])
    grid = np.linspace(-10, 10, 200001)
    f = np.exp(y.sum() * grid - 4 * np.exp(grid) - grid**2 / (2 * var)) / math.sqrt(2 * math.pi * var)
    assert abs(got - math.log(np.trapezoid(f, grid))) < 0.02


def test_components(spark):
    random.seed(2)
    rows, edges = [], []
    for g in range(3):
        n = 60
        ids = list(range(1, n + 1))
        random.shuffle(ids)
        pairs = list(zip(ids, ids[1:])) if g == 0 else [(random.choice(ids), random.choice(ids)) for _ in range(40)]
        rows += [(g, i) for i in ids]
        edges += [(g, a, b) for p in pairs for a, b in (p, p[::-1])]
    got = {(r["g"], r["unit_id"]): r["component"] for r in graph.components(spark.createDataFrame(rows, "g int, unit_id int"), spark.createDataFrame(edges, "g int, src int, dst int"), ["g"]).collect()}
    label = {v: v[1] for v in rows}
    for _ in range(60):
        for g, a, b in edges:
            label[g, a] = label[g, b] = min(label[g, a], label[g, b])
    assert got == label


def test_partition_algebra(spark):
    base = spark.createDataFrame([(1, u, c) for u, c in enumerate([1, 1, 2, 2, 3, 3], 1)], "k int, unit_id int, cluster_id int")
    other = base.withColumn("cluster_id", 10 - F.col("cluster_id"))
    row = partitions.comparison(partitions.contingency(base, other, ["k"]), ["k"]).first()
    assert (row["rand"], row["adjusted_rand"], row["binder"], row["vi"]) == (1.0, 1.0, 0.0, 0.0)
    one, alone = base.withColumn("cluster_id", F.lit(1)), base.withColumn("cluster_id", F.col("unit_id"))
    row = partitions.comparison(partitions.contingency(one, alone, ["k"]), ["k"]).first()
    assert row["rand"] == 0 and row["binder"] == 15 and math.isclose(row["vi"], math.log(6)) and math.isclose(row["vi_log2"], math.log2(6))
    assert partitions.comparison(partitions.contingency(one, one, ["k"]), ["k"]).first()["adjusted_rand"] is None
    assert partitions.signatures(base, ["k"]).first()["signature"] == partitions.signatures(other, ["k"]).first()["signature"]
    assert partitions.cluster_sizes(base.limit(0), ["k"]).count() == 0


def test_weights(spark):
    df = spark.createDataFrame([(1, 1, "s", 0.0), (1, 2, "s", 0.0), (1, 3, "t", None)], "run_id int, particle_id int, signature string, log_post double")
    w = weights.tempered_weights(df)
    assert [r["w"] for r in w.orderBy("particle_id").collect()] == [0.5, 0.5, 0.0]
    assert weights.unique_particles(w).where("w > 0").count() == 1
    assert abs(weights.weight_entropy(w).first()["entropy"]) < 1e-12


def test_kmeans(spark):
    random.seed(3)
    values = [round(random.gauss(0, 1), 3) for _ in range(11)] + [0.5, 0.5]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values, 1)], "g int, unit_id int, value double")
    ss = lambda parts: sum(sum((v - sum(p) / len(p)) ** 2 for v in p) for p in parts if p)
    rows = compare.kmeans_path(df, ["g"], 4).toPandas()
    ordered = sorted(values)
    for k in (1, 2, 3, 4):
        own = rows[rows.k == k]
        got = ss([[values[u - 1] for u in g.unit_id] for _, g in own.groupby("cluster_id")])
        best = min(ss([ordered[a:b] for a, b in zip((0, *cut), (*cut, len(ordered)))]) for cut in itertools.combinations(range(1, len(ordered)), k - 1))
        assert math.isclose(got, best, abs_tol=1e-9)
    two = moves.kmeans_splits(df.select("g", "unit_id", F.lit(1).alias("cluster_id")), df, ["g"], "value").toPandas()
    assert math.isclose(ss([[values[u - 1] for u in g.unit_id] for _, g in two.groupby("part")]), min(ss([ordered[:c], ordered[c:]]) for c in range(1, len(ordered))), abs_tol=1e-9)


def test_spanning_tree(spark):
    random.seed(4)
    pairs = [(a, b, float(random.randint(1, 4))) for a, b in itertools.combinations(range(1, 13), 2) if random.random() < 0.4]
    df = spark.createDataFrame([(1, *p) for a, b, w in pairs for p in ((a, b, w), (b, a, w))], "k int, src int, dst int, weight double")
    tree = compare.spanning_tree(df, ["k"]).collect()
    root = list(range(13))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    total, n = 0, 0
    for w, a, b in sorted((w, a, b) for a, b, w in pairs):
        if find(a) != find(b):
            root[find(a)] = find(b)
            total, n = total + w, n + 1
    assert len(tree) == n and sum(r["weight"] for r in tree) == total


def test_kernel_identity():
    omega = kernel.within_precision(np.array([1, 2, 3]), [[2], [1, 3], [2]], 0.9, 0.5, 2.0)
    a = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0.0]])
    m = 0.9 * (np.diag(a.sum(1)) - a) + 0.1 * np.eye(3)
    assert np.allclose(np.linalg.inv(omega), 0.5 * np.linalg.inv(m) + 2.0)


def test_mean_only(spark, world):
    df, asg, hyper, e, x, y, la, lb, edges = world
    h = spark.createDataFrame([(1, 0.5, 2.0, 3.0, 0.7)], "run_id int, a1 double, a2 double, nu double, lambda double")
    got = mean_only.mean_only_scores(asg, df, e, h).first()
    n, t = y.shape
    s = dense(n, edges, la, 0.5, 2.0, 0.9) + np.eye(n) / t
    mean = y.mean(1)
    rest = ((y - mean[:, None]) ** 2).sum()
    # Squares around the means enter as they are, the means' part on their own scale.
    want = -0.5 * np.linalg.slogdet(s)[1] - (3.0 + n * t) / 2 * np.log((3.0 * 0.7 + mean @ np.linalg.solve(s, mean) + rest) / 2)
    assert math.isclose(got["log_like"], want, rel_tol=1e-9)
    assert math.isclose(got["log_prior"], 3 * math.log(2), rel_tol=1e-9)
    both = mean_only.equal_sides(asg).toPandas()
    assert len(both) == 18 and sorted(both[both.side == "B"].cluster_id) == sorted(la)


def test_block_candidates(spark, world):
    df, asg, hyper, e, x, y, la, lb, edges = world
    values = spark.createDataFrame([(1, i + 1, float(v)) for i, v in enumerate([0, 0, 0, 1, 1, 1, 5, 5, 5])], "run_id int, unit_id int, value double")
    a = asg.where("side = 'A'")
    keys = ["run_id", "particle_id", "side"]
    got = mean_only.candidates(e, a, values, keys).toPandas()
    assert {"merge:1:2", "merge:2:3", "island:1"} <= set(got.cand)
    assert not any(c.startswith("block:1:2") for c in got.cand)  # nothing of cluster 2 would be left


def test_generators(spark):
    e = spark.createDataFrame(sorted(lattice(3)), "src int, dst int")
    near = score.neighbour_lists(e)
    member = F.collect_list(F.struct(F.col("unit_id").cast("int").alias("unit_id"), "neighbours"))
    runs = spark.range(1, 401).select(F.col("id").cast("int").alias("run_id"))
    rows = runs.join(near)
    packed = rows.groupBy("run_id", F.lit(1).alias("cluster_id")).agg(member.alias("members"), F.lit(3.0).alias("mean"), F.lit(0.5).alias("c1"), F.lit(0.2).alias("c2"))
    draws = generators.parameters(packed, ["run_id"], rho=0.9, seed=1).toPandas().pivot(index="run_id", columns="unit_id", values="value").to_numpy()
    want = dense(9, lattice(3), [1] * 9, 0.5, 0.2, 0.9)
    assert np.abs(np.cov(draws.T) - want).max() < 0.35 and np.abs(draws.mean(0) - 3).max() < 0.2
    truth = runs.select("run_id", F.lit(1).alias("unit_id"), F.lit(1.0).alias("alpha"), F.lit(0.5).alias("beta"))
    counts = generators.poisson_panel(truth, 4, seed=2).groupBy("t").agg(F.first("x").alias("x"), F.avg("y").alias("m"), F.var_samp("y").alias("v")).toPandas()
    assert (abs(counts.m - np.exp(1 + 0.5 * counts.x)) < 0.6).all() and (abs(counts.v / counts.m - 1) < 0.5).all()
