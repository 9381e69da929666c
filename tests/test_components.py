"""Components of many graphs at once: in one place, and by rounds."""

import random

import pytest
from pyspark.sql import functions as F

from parcelspark.operators import graph


def brute(vertices, edges):
    label = {v: v for v in vertices}
    changed = True
    while changed:
        changed = False
        for g, a, b in edges:
            low = min(label[g, a], label[g, b])
            if label[g, a] != low or label[g, b] != low:
                label[g, a] = label[g, b] = low
                changed = True
    return {(g, u): c[1] for (g, u), c in label.items()}


@pytest.mark.parametrize("one_task, held", [(graph.ONE_TASK, graph.HELD), (0, 3), (20, 5)])
def test_components(spark, monkeypatch, one_task, held):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    monkeypatch.setattr(graph, "HELD", held)
    r = random.Random(5)
    vertices = [(g, u) for g in (1, 2, 3) for u in range(1, 40)]
    pairs = [(1, u, u + 1) for u in range(1, 39)] + [(2, r.randint(1, 39), r.randint(1, 39)) for _ in range(25)] + [(3, 5, 5)]
    both = pairs + [(g, b, a) for g, a, b in pairs] + pairs[:5]
    v = spark.createDataFrame(vertices, "g int, unit_id int")
    e = spark.createDataFrame(both, "g int, src int, dst int")
    got = {(r["g"], r["unit_id"]): r["component"] for r in graph.components(v, e, ["g"]).collect()}
    assert got == brute(vertices, both)
    assert graph.components(v.limit(0), e.limit(0), ["g"]).count() == 0
    alone = graph.components(v, e.limit(0), ["g"])
    assert alone.where(F.col("unit_id") != F.col("component")).count() == 0 and alone.count() == len(vertices)
