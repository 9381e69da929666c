"""Islands of every unit of the levels, listed inside of tasks."""

import numpy as np
from test_panels import lattice

from parcelspark.operators import mean_only

KEYS = ["run_id", "particle_id", "side"]


def test_local_candidates_without_joins_of_candidates(spark):
    """mean_only_local_candidates: as by joins, clusters that are not connected and units without values included, and nothing is broadcast that grows."""
    rng = np.random.default_rng(3)
    edges = spark.createDataFrame(sorted(lattice(4)), "src int, dst int")
    rows = [(r, p, "A", u, int(rng.integers(1, 4))) for r in (1, 2) for p in (1, 2) for u in range(1, 17)]
    asg = spark.createDataFrame(rows, "run_id int, particle_id int, side string, unit_id int, cluster_id int")
    values = [(r, u, None if u == 5 else float(rng.normal())) for r in (1, 2) for u in range(1, 17) if u != 9]
    v = spark.createDataFrame(values, "run_id int, unit_id int, value double")
    got = mean_only.local_candidates(edges, asg, v, KEYS)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "BroadcastHashJoin [run_id" not in plan
    was, mean_only.ONE_TASK = mean_only.ONE_TASK, 0
    try:
        want = mean_only.local_candidates(edges, asg, v, KEYS)
    finally:
        mean_only.ONE_TASK = was
    assert got.dtypes == want.dtypes
    columns = got.columns
    a, b = (sorted(map(tuple, df.select(*columns).collect())) for df in (got, want))
    assert a == b and len(a) > 500
