"""Islands of the model with levels alone whose pieces all join at once."""

from test_panels import lattice

from parcelspark.operators import mean_only

KEYS = ["run_id", "particle_id", "side"]


def test_islands_with_all_pieces_joined(spark):
    edges = spark.createDataFrame(sorted(lattice(3)), "src int, dst int")
    label = {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 7: 3, 8: 3, 9: 3}
    value = {1: 0.0, 2: 0.0, 3: 0.0, 4: 1.0, 5: 9.0, 6: 4.5, 7: 5.0, 8: 5.0, 9: 5.0}
    asg = spark.createDataFrame([(1, 1, "A", u, c) for u, c in label.items()], "run_id int, particle_id int, side string, unit_id int, cluster_id int")
    v = spark.createDataFrame([(1, u, x) for u, x in value.items()], "run_id int, unit_id int, value double")

    def made(df):
        out = {}
        for r in df.collect():
            out.setdefault(r["cand"], {}).setdefault(r["cluster_id"], set()).add(r["unit_id"])
        return {c: sorted(map(sorted, by.values())) for c, by in out.items()}

    got = made(mean_only.candidates(edges, asg, v, KEYS))
    # Unit 5 is farthest; it leaves 4, nearer to cluster 1, and 6, nearer to cluster 3, as it is itself.
    assert got["island:5"] == [[4], [5], [6]]
    assert got["island:5>>all"] == [[1, 2, 3, 4], [5, 6, 7, 8, 9]]
    local = made(mean_only.local_candidates(edges, asg, v, KEYS))
    assert set(local) == {f"island:{u}{end}" for u in label for end in ("", ">>all")}
    assert local["island:4>>all"] == [[1, 2, 3, 4], [5, 6, 7, 8, 9]]
    one = asg.withColumn("cluster_id", asg["cluster_id"] * 0 + 1)
    assert not any(c.endswith(">>all") for c in made(mean_only.local_candidates(edges, one, v, KEYS)))
