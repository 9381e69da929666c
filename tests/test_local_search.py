"""Searches inside of tasks: the same candidates with the same numbers as the batched moves, and no Spark jobs by sweep."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_panels import lattice

from parcelspark.operators import local, mean_only
from parcelspark.operators.trial import spread_out
from parcelspark.plans import search
from parcelspark.session import written


@pytest.fixture(scope="module")
def world(spark):
    """A 5 × 5 lattice with levels and slopes in groups."""
    rng = np.random.default_rng(5)
    rows = [(1, u, k, float(k), float((u > 9) * 2 + (u % 5) * k * 0.4 + rng.normal(0, 0.6))) for u in range(1, 26) for k in range(-2, 3)]
    return written(spark.createDataFrame(rows, "run_id int, unit_id int, t int, x double, y double"), "panel"), spark.createDataFrame(sorted(lattice(5)), "src int, dst int")


def label_of(u):
    return 1 if u <= 10 else 11 if u % 5 in (1, 2) else 13 if u < 20 and u % 5 else 15 if u % 5 == 0 else 23


def in_spark(problem, spark, side, make):
    """Candidates by the batched moves: name -> (clusters, numbers)."""
    start = spark.createDataFrame([(1, 1, side, u, label_of(u)) for u in range(1, 26)], "run_id int, particle_id int, side string, unit_id int, cluster_id int")
    whole = search._whole(problem, start, search.KEYS)
    at = written(spread_out(whole.withColumn("of", F.col("sig")), search.PARTITION).join(problem.values(), ["run_id", "side", "unit_id"]), "at")
    out = {}
    for r in problem.tried(make(at), at, search.PARTITION).collect():
        by = {}
        for u, c in zip(r["units"], r["labels"]):
            by.setdefault(c, []).append(u)
        out[r["cand"]] = sorted(map(sorted, by.values())), [r["quad"], r["log_det"], r["k"], r["inner"], r["sig"]]
    return out


def in_task(problem, side, kind, levels, families=search.FAMILIES):
    facts = problem.facts.orderBy("unit_id").collect()
    terms = [[t for t in r["terms"] if t["side"] == side] for r in facts]
    data = [(np.array([t[i]["b"] for t in terms]), np.array([t[i]["w"] for t in terms])) for i in range(len(terms[0]))]
    graph = local.Graph([r["unit_id"] for r in facts], [r["near"] for r in facts])
    run = local.Run(graph, {side: (data, [(t["c1"], t["c2"]) for t in terms[0]])}, {side: np.array([r["values"][side] for r in facts], float)}, pd.Series({"a": 1.0, "d": 1.0, "c": 0.0}), problem.prior, problem.rho, levels, families)
    pieces = graph.pieces(list(range(25)), [label_of(u) for u in graph.ids])
    options = run.options(side, -np.array(pieces, np.int64), kind)
    return {name: (sorted([graph.ids[i] for i in c] for c in x[1]), list(x[3])) for name, x in options.items()}


def same(want, got):
    assert set(want) == set(got) and want
    for name, (clusters, numbers) in want.items():
        assert clusters == got[name][0], name
        assert np.allclose(numbers[:4], got[name][1][:4], rtol=1e-8, atol=1e-8) and numbers[4] == got[name][1][4], name


@pytest.mark.parametrize("side", ["A", "B"])
def test_candidates_with_slopes(spark, world, side):
    problem = search.Problem.of(*world)
    same(in_spark(problem, spark, side, lambda at: search.candidates(problem, at)), in_task(problem, side, "all", False))
    if side == "A":
        same(in_spark(problem, spark, side, lambda at: search.candidates(problem, at, 1.0, ("island",))), in_task(problem, side, "islands", False))


@pytest.mark.parametrize("kind", ["all", "local"])
def test_candidates_of_levels(spark, world, kind):
    hyper = spark.createDataFrame([(1, 0.4, 1.5, 4.0, 0.5)], "run_id int, a1 double, a2 double, nu double, lambda double")
    problem = search.Problem.of_levels(*world, hyper)
    same(in_spark(problem, spark, "A", lambda at: search.level_candidates(problem, at, local=kind == "local")), in_task(problem, "A", kind, True))


def jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    found = work()
    spark.sparkContext.setJobGroup("other", "other")
    return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_map_search_has_no_jobs_by_sweep(spark, world):
    """map_search: one start, whole searches in tasks; and it ends where the batched search does."""
    problem = search.Problem.of(*world)
    start = written(search.one_cluster(problem.units), "start")
    fit, number = jobs(spark, "map", lambda: search.map_fit(problem, start))
    assert fit.settled and fit.sweeps > 2 and number < 40, number
    batched, search.IN_TASK = search.IN_TASK, 0
    try:
        want = search.map_fit(problem, start)
    finally:
        search.IN_TASK = batched
    assert want.sweeps == fit.sweeps
    a, b = (sorted(map(tuple, f.assignment.select(*search.KEYS, "unit_id", "cluster_id").collect())) for f in (fit, want))
    assert a == b
    assert abs(fit.particles.first()["log_post"] - want.particles.first()["log_post"]) < 1e-7


def test_levels_search_has_no_jobs_by_sweep(spark, world):
    """levels_search: the plans and tables of sweeps do not gather in the driver."""
    hyper = spark.createDataFrame([(1, 0.4, 1.5, 4.0, 0.5)], "run_id int, a1 double, a2 double, nu double, lambda double")
    problem = search.Problem.of_levels(*world, hyper)
    start = written(search.one_cluster(problem.units, 3, "A"), "start")
    fit, number = jobs(spark, "levels", lambda: search.ensemble_fit(problem, 3, start=start))
    assert fit.settled and fit.sweeps > 2 and number < 40, (fit.sweeps, number)
    assert fit.particles.count() == 3
