"""The number of classes by greatest silhouette, and the scores of the comparators."""

import math

from parcelspark.operators import compare, score
from parcelspark.plans import fit_queries, panel_queries, search


def test_classes_of_greatest_silhouette(spark):
    sets = {1: [0, 0.1, 0.2, 9, 9.1, 9.2], 2: [0, 0.1, 5, 5.1, 9, 9.1], 3: [1.0] * 6}
    values = spark.createDataFrame([(r, u, float(x)) for r, xs in sets.items() for u, x in enumerate(xs, 1)], "run_id int, unit_id int, value double")
    got = compare.chosen_classes(compare.kmeans_path(values, ["run_id"]), values, ["run_id"]).collect()
    assert {(r["run_id"], r["k"]) for r in got} == {(1, 2), (2, 3), (3, 1)} and len(got) == 18


def test_comparator_scores(spark, small):
    rows = {r["method"]: r for r in fit_queries.comparator_scores(spark, small).collect()}
    assert set(rows) == {"kmeans", "spectral", "one cluster", "singletons"}
    units, edges = panel_queries._units(spark, small), panel_queries._edges(spark, small)
    one = score.scored_particles(search.one_cluster(units), units, edges).first()["log_post"]
    assert math.isclose(rows["one cluster"]["log_post"], one, rel_tol=1e-9)
    assert rows["singletons"]["log_prior"] < rows["one cluster"]["log_prior"]
    assert all(math.isfinite(r["log_post"]) for r in rows.values())


def test_spectral_cut_by_absolute_difference(spark):
    """Both similarities part a line of units where its values jump."""
    line = [(u, [v for v in (u - 1, u + 1) if 1 <= v <= 8], 0.1 * u if u <= 4 else 5 + 0.1 * u) for u in range(1, 9)]
    df = spark.createDataFrame([(1, 1, [(u, v, near) for u, near, v in line])], "run_id int, cluster_id int, members array<struct<unit_id:int,value:double,neighbours:array<int>>>")
    parts = {s: {r["unit_id"]: r["part"] for r in compare.spectral_parts(df, ["run_id"], squared=s).collect()} for s in (True, False)}
    for made in parts.values():
        assert len({made[u] for u in range(1, 5)}) == 1 and len({made[u] for u in range(5, 9)}) == 1 and made[1] != made[8]
