"""Cuts into several parts and the merges that follow, against plain searches; joint means against the dense model."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_panels import dense, lattice

from parcelspark.operators import joint, mean_only, moves, parts, score
from parcelspark.plans import search
from parcelspark.session import written

KEYS = ["run_id", "particle_id", "side"]
H = (0.5, 2.0, 0.3, 1.5, 3.0, 0.7)


@pytest.fixture(scope="module")
def board(spark):
    """A 4 × 4 lattice in three connected clusters, with values (two equal, one null)."""
    rng = np.random.default_rng(8)
    labels = {u: 1 if u <= 8 else 2 if u <= 12 else 3 for u in range(1, 17)}
    value = {u: round(float(rng.normal(labels[u], 1)), 3) for u in labels}
    value[2] = value[1]
    value[16] = None
    edges = lattice(4)
    e = spark.createDataFrame(sorted(edges), "src int, dst int")
    asg = spark.createDataFrame([(1, 1, "A", u, c) for u, c in labels.items()], "run_id int, particle_id int, side string, unit_id int, cluster_id int")
    v = spark.createDataFrame([(1, "A", u, x) for u, x in value.items()], "run_id int, side string, unit_id int, value double")
    return e, asg, v, edges, labels, value


def groups(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], {}).setdefault(r["cluster_id"], set()).add(r["unit_id"])
    return out


def connected(units, edges):
    seen, todo = set(), [min(units)]
    while todo:
        u = todo.pop()
        if u not in seen:
            seen.add(u)
            todo += [b for a, b in edges if a == u and b in units]
    return seen == units


def test_cuts_and_onward(spark, board):
    e, asg, v, edges, labels, value = board
    made = parts.kmeans_parts(asg, v, KEYS, parts.wide_down)
    assert {r["cand"] for r in made.select("cand").distinct().collect()} == {"kmeans:1:2", "kmeans:2:2"} | ({"kmeans:3:2"} if len([u for u in labels if labels[u] == 3 and value[u] is not None]) > 3 else set())
    pieces = moves.cut(e, made, KEYS)
    got = groups(pieces.collect(), "cand")
    for cand, by in got.items():
        assert all(connected(us, edges) for us in by.values())
        assert set().union(*by.values()) == {u for u in labels if labels[u] == int(cand.split(":")[1])}
    mean = lambda us: np.mean([value[u] for u in us if value[u] is not None])
    clusters = {c: {u for u in labels if labels[u] == c} for c in (1, 2, 3)}
    want = {}
    for cand, by in got.items():
        for piece, us in by.items():
            near = {labels[b] for a, b in edges if a in us} - {int(cand.split(":")[1])}
            if near:
                want[cand, piece] = min(near, key=lambda c: (abs(mean(us) - mean(clusters[c])), c))
    nearest = parts.nearest_outside(e, asg, v, KEYS, pieces)
    assert {(r["cand"], r["piece"]): r["to"] for r in nearest.collect()} == want
    one = groups(parts.join_one(asg, KEYS, pieces, nearest).collect(), "cand")
    assert set(one) == {f"{c}>{p}" for c, p in want}
    for (cand, piece), to in want.items():
        new = [us for us in one[f"{cand}>{piece}"].values()]
        old = [us for p, us in got[cand].items() if p != piece] + [got[cand][piece] | clusters[to]]
        assert sorted(map(sorted, new)) == sorted(map(sorted, old))
    turn = groups(parts.join_in_turn(asg, KEYS, pieces, nearest).collect(), "cand")
    for cand in got:
        order = sorted((p for c, p in want if c == cand), key=lambda p: min(got[cand][p]))
        assert len([c for c in turn if c.startswith(cand + ">>")]) == len(order)
        for k in range(1, len(order) + 1):
            joined = {}
            for p in order[:k]:
                joined.setdefault(want[cand, p], set(clusters[want[cand, p]])).update(got[cand][p])
            old = [us for p, us in got[cand].items() if p not in order[:k]] + list(joined.values())
            assert sorted(map(sorted, turn[f"{cand}>>{k}"].values())) == sorted(map(sorted, old))


def test_spectral_and_ends(board):
    e, asg, v, *_ = board
    rows = parts.spectral_cuts(asg, v, score.neighbour_lists(e), KEYS, parts.wide_up).collect()
    assert {r["cand"] for r in rows} == {"spectral:1:2", "spectral:1:3", "spectral:2:2", "spectral:3:2"}
    assert max(r["part"] for r in rows if r["cand"] == "spectral:1:3") == 2
    ends = parts.both_tails(asg, v, KEYS).where("cand = 'ends:1:both'").groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in ends} == {0: 6, 1: 1, 2: 1}
    for n, most in ((3, 2), (400, 2), (961, 3), (10000, 9)):
        assert parts.narrow(n) == most


def test_nothing_to_cut(board):
    e, asg, v, *_ = board
    same = v.withColumn("value", F.lit(1.0))
    for values in (same, v.limit(0)):
        assert parts.kmeans_parts(asg, values, KEYS).count() == 0
        assert parts.spectral_cuts(asg, values, score.neighbour_lists(e), KEYS).count() == 0
    none = moves.cut(e, parts.kmeans_parts(asg, same, KEYS), KEYS)
    nearest = parts.nearest_outside(e, asg, v, KEYS, none)
    assert parts.join_in_turn(asg, KEYS, none, nearest).count() == 0
    one = asg.withColumn("cluster_id", F.lit(1))
    pieces = moves.cut(e, parts.kmeans_parts(one, v, KEYS), KEYS)
    assert pieces.count() > 0 and parts.nearest_outside(e, one, v, KEYS, pieces).count() == 0


def test_joint_means(spark):
    rng = np.random.default_rng(4)
    n, t, edges = 9, 5, lattice(3)
    x, y = rng.normal(1, 1, (n, t)), rng.normal(2, 1, (n, t))
    df = spark.createDataFrame([(1, i + 1, k + 1, float(x[i, k]), float(y[i, k])) for i in range(n) for k in range(t)] + [(1, 1, 9, None, 1.0)], "run_id int, unit_id int, t int, x double, y double")
    la, lb = [1, 1, 1, 2, 2, 2, 3, 3, 3], [1] * 9
    asg = spark.createDataFrame([(1, 1, s, i + 1, lab[i]) for s, lab in (("A", la), ("B", lb)) for i in range(n)], "run_id int, particle_id int, side string, unit_id int, cluster_id int")
    hyper = spark.createDataFrame([(1, *H)], "run_id int, a1 double, a2 double, b1 double, b2 double, alpha_sigma double, beta_sigma double")
    e = spark.createDataFrame(sorted(edges), "src int, dst int")
    packed = joint.packed_particles(asg, df, score.neighbour_lists(e), hyper)
    oa, ob = (np.linalg.inv(dense(n, edges, lab, c1, c2, 0.9)) for lab, c1, c2 in ((la, H[0], H[1]), (lb, H[2], H[3])))
    z = np.zeros((n * t, 2 * n))
    for i in range(n):
        z[i * t : (i + 1) * t, i], z[i * t : (i + 1) * t, n + i] = 1, x[i]
    prior = np.block([[oa, np.zeros((n, n))], [np.zeros((n, n)), ob]])
    want = np.linalg.solve(z.T @ z + prior, z.T @ y.ravel())
    for rows in (joint.joint_means(packed), joint.ascent_means(packed, sweeps=400)):
        got = rows.orderBy("unit_id").toPandas()
        assert np.allclose(np.concatenate([got.alpha, got.beta]), want, atol=1e-8)
    rest = y.ravel() - z @ want
    more = n * t / 2 + n
    expected = 0.5 * np.linalg.slogdet(prior)[1] + math.lgamma(3 + more) - math.lgamma(3) + 3 * math.log(0.7) - (3 + more) * math.log(0.7 + (rest @ rest + want @ prior @ want) / 2)
    assert math.isclose(joint.joint_likelihood(packed).first()["log_like"], expected, rel_tol=1e-9)
    bad = joint.packed_particles(asg, df, score.neighbour_lists(e), hyper.withColumn("b1", F.lit(None).cast("double")))
    assert joint.joint_means(bad).count() == 0 and joint.joint_likelihood(bad).first()["log_like"] is None


def test_class_paths(spark):
    rng = np.random.default_rng(9)
    panel = spark.createDataFrame([(1, u, k, float(k), float(rng.normal(u % 3, 0.2))) for u in range(1, 10) for k in range(1, 5)], "run_id int, unit_id int, t int, x double, y double")
    e = spark.createDataFrame(sorted(lattice(3)), "src int, dst int")
    hyper = spark.createDataFrame([(1, 0.5, 2.0, 3.0, 0.5)], "run_id int, a1 double, a2 double, nu double, lambda double")
    rows = {(r["method"], r["k"], r["connected"]): r for r in mean_only.class_paths(panel, e, hyper, most=3).collect()}
    assert len(rows) == 12
    one = spark.createDataFrame([(1, 1, "A", u, 1) for u in range(1, 10)], "run_id int, particle_id int, side string, unit_id int, cluster_id int")
    want = mean_only.mean_only_scores(one, panel, e, hyper).first()["log_post"]
    assert all(math.isclose(rows[m, 1, c]["log_post"], want, rel_tol=1e-9) for m in ("kmeans", "spectral") for c in (False, True))
    assert rows["kmeans", 3, False]["clusters"] == 3 and rows["kmeans", 3, True]["clusters"] >= 3


def test_candidates_of_the_search(spark):
    """Every candidate, onward ones as well, gets the score that the whole changed partition has, and stays connected."""
    rng = np.random.default_rng(6)
    edges = lattice(5)
    panel = spark.createDataFrame([(1, u, k, float(k), float(rng.normal(u % 4, 0.5))) for u in range(1, 26) for k in range(1, 5)], "run_id int, unit_id int, t int, x double, y double")
    e = spark.createDataFrame(sorted(edges), "src int, dst int")
    hyper = spark.createDataFrame([(1, *H)], "run_id int, a1 double, a2 double, b1 double, b2 double, alpha_sigma double, beta_sigma double")
    problem = search.Problem.of(panel, e, hyper)
    label = {u: 1 if u <= 15 else 2 for u in range(1, 26)}
    asg = spark.createDataFrame([(1, "A", u, c) for u, c in label.items()], "run_id int, side string, unit_id int, cluster_id int")
    keys = ["run_id", "side"]
    whole = search._whole(problem, asg, keys)
    at = written(search.spread_out(whole, keys).join(problem.values(), [*keys, "unit_id"]), "at")
    cands = written(search.candidates(problem, at, families=("split", "spectral", "tail", "onward"), keys=keys), "candidates")
    base = score.scored_particles(spark.createDataFrame([(1, 1, s, u, c) for s in "AB" for u, c in label.items()], "run_id int, particle_id int, side string, unit_id int, cluster_id int"), problem.units, e, hyper).first()
    other = search._whole(problem, asg.withColumn("side", F.lit("B")), keys).first()
    law, first = problem.law.first(), whole.first()
    post = lambda r: float(search.log_posterior(first["quad"] + other["quad"] + r["quad"], first["log_det"] + other["log_det"] + r["log_det"], first["inner"] + other["inner"] + r["inner"] + float(problem.prior.outer(first["k"] + r["k"], 25)) + float(problem.prior.outer(other["k"], 25)), law))
    assert math.isclose(post({"quad": 0, "log_det": 0, "inner": 0, "k": 0}), base["log_post"], rel_tol=1e-9)
    scores = {r["cand"]: post(r) for r in problem.tried(cands, at, keys).collect()}
    kinds = {c.split(":")[0] + (">" if ">" in c else "") for c in scores}
    assert kinds == {"kmeans", "spectral", "tail", "kmeans>", "spectral>", "tail>"}
    names = {c: i for i, c in enumerate(sorted(scores), 1)}
    rows = []
    for cand, by in groups(cands.collect(), "cand").items():
        label = {u: 1 if u <= 15 else 2 for u in range(1, 26)}
        for c, us in by.items():
            assert connected(us, edges)
            label |= dict.fromkeys(us, c)
        rows += [(1, names[cand], "A", u, c) for u, c in label.items()] + [(1, names[cand], "B", u, 1 if u <= 15 else 2) for u in label]
    whole = spark.createDataFrame(rows, "run_id int, particle_id int, side string, unit_id int, cluster_id int")
    want = {r["particle_id"]: r["log_post"] for r in score.scored_particles(whole, problem.units, e, hyper).collect()}
    assert len(want) == len(scores) and all(math.isclose(scores[c], want[i], rel_tol=1e-9) for c, i in names.items())
