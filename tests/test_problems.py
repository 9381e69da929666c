"""Small cases of the general problems: nulls, ties, repeated rows, empty tables, clashing names."""

import csv
import datetime as dt
import io
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelspark.operators import nearby
from parcelspark.operators.current import current_rows
from parcelspark.operators.features import entity_features
from parcelspark.operators.rejects import load_incidents
from parcelspark.operators.rolling import rolling_totals


def test_current_rows(spark):
    df = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 2, "b"), (1, None, 9, "c"), (None, 7, 7, "d"), (2, None, 1, "e"), (2, None, 1, "e")], "k int, at int, id int, v string")
    assert sorted(map(tuple, current_rows(df, "k", ["at", "id"], ["v"]).collect())) == [(1, "b"), (2, "e")]
    assert current_rows(df.limit(0), "k", ["at", "id"], ["v"]).count() == 0


def test_features(spark):
    df = spark.createDataFrame([("x", "a", 1), ("x", "a", 1), ("x", "a", 3), ("x", "z", 2), ("y", "b", 2), (None, "a", 1), ("x", None, 1), ("x", "a", None), ("x", "a", 9)], "name string, total string, latest int")
    f = entity_features(df, "name", "total", "latest", ["a", "b"], [1, 2, 3])
    rows = {r["name"]: r.asDict() for r in f.wide.collect()}
    assert rows["x"]["n|a|1"] == 2 and rows["x"]["n|a|2"] == 0 and rows["x"]["total|a"] == 3 and rows["x"]["latest|a"] == 3 and rows["x"]["latest|b"] is None
    assert rows["x"]["total"] == 4 and rows["x"]["latest"] == 3 and rows["y"]["total|a"] == 0
    assert sorted(map(tuple, f.unpivoted().collect())) == [("x", "a", 3, 3), ("x", "z", 1, 2), ("y", "b", 1, 2)]
    empty = entity_features(df.limit(0), "name", "total", "latest", ["a", "b"], [1, 2, 3])
    assert empty.wide.count() == 0 and empty.unpivoted().count() == 0


def test_rolling(spark):
    random.seed(1)
    begin, days = dt.date(2020, 1, 1), 60
    events = [(random.choice("ab"), begin + dt.timedelta(random.randrange(days))) for _ in range(80)] + [(None, begin), ("a", None), ("a", begin - dt.timedelta(1)), ("c", begin + dt.timedelta(days))]
    df = spark.createDataFrame(events, "day string, t7 date").withColumn("_entity", F.lit(0))
    got = {(r[0], r[1]): (r[2], r[3], r[4]) for r in rolling_totals(df, "day", "t7", "2020-01-01", "2020-02-29", (7, 30)).collect()}
    assert len(got) == 2 * days
    for (e, d), (t7, t30, avg7) in got.items():
        n = lambda p: sum(1 for x, y in events if x == e and y is not None and begin <= y and d - dt.timedelta(p) < y <= d)  # noqa: B023, E731
        assert (t7, t30) == (n(7), n(30)) and math.isclose(avg7, n(7) / 7)
    assert rolling_totals(df.limit(0), "day", "t7", "2020-01-01", "2020-02-29").count() == 0


GOOD = '1,02,3,2010-01-01,10:00:00,600,Theft,-41.1,38.9'
LINES = [
    (GOOD, True), (GOOD + "\r", True), (GOOD + "\r\r", False), ('1,02,3,,,600,"a, b\nc ""q""",-41.1,38.9', True), ('1,02,3,,,"600","",  -4.1e+1 ,', True), ('1,02,3,,,600,"a"b,-41.1,38.9', False), ('1,02,3,,,600,a"b,-41.1,38.9', False),
    ('1,02,3,,,600,"a,-41.1,38.9', False), ("1,02,3,,,600,a,-41.1", False), (GOOD + ",", False), ("", False), (None, False), ('1,02,3,,,60,a,-41.1,38.9', False), ("1,02,3,,,６００,a,-41.1,38.9", False), ("1,02,3,,,600,a,-181,38.9", False), ("1,02,3,,,600,a,180,-90", True),
    ("1,02,3,,,600,a,1e2,9.1e1", False), ("1,02,3,,,600,a,.5,1", False), ("1,02,3,,,600,a,5.,1", False), ("1,02,3,,,600,a,NaN,1", False), ("1,02,3,,,600,a,1e400,1", False), ("1,02,3,,,600,a\\,1,1", True), ("1,02,3,,,600,\u0001a,1,1", True), ('1,02,3,,,600,"\u0001,\u0001b",1,1', True), ('"","","","","",600,"","",""', True), ('""""', False), ("1,02,3,,,600,a, ,1", False),
    ('1,02,3,,,600,"' + 'x""' * 20000 + '",1,1', True),
]


def test_rejects(spark):
    raw = spark.createDataFrame([(i, "f", i, line) for i, (line, _) in enumerate(LINES)], "raw_id bigint, batch_file string, line_no int, line string").withColumn("errors", F.lit("clash")).withColumn("f", F.lit(1))
    codes = spark.createDataFrame([(600, "theft"), (600, "theft"), (None, "x")], "ucr_general int, crimetype string")
    loaded, rejected = load_incidents(raw, codes)
    bad = {r["raw_id"]: r["errors"] for r in rejected.collect()}
    assert {i for i, (_, good) in enumerate(LINES) if not good} == set(bad) and all(bad.values())
    rows = {r["raw_id"]: r for r in loaded.collect()}
    assert set(rows) == {i for i, (_, good) in enumerate(LINES) if good}
    for i, (line, good) in enumerate(LINES):
        if good:
            bare = line[:-1] if line.endswith("\r") else line
            fields = next(csv.reader(io.StringIO(bare, newline=""), doublequote=True))
            assert rows[i]["text_general_code"] == fields[6] and rows[i]["ucr_general"] == 600
            assert rows[i]["point_x"] == (float(fields[7]) if fields[7].strip() else None)
    assert bad[11] == ["null line"] and bad[7] == ["broken quoting"] and bad[8] == ["wrong number of fields"]
    assert load_incidents(raw.limit(0), codes)[1].count() == 0
    assert load_incidents(raw, codes.limit(0))[0].count() == 0


@pytest.fixture(scope="module")
def shapes(spark):
    rings = [(1, [(0, 0), (0.4, 0), (0.4, 0.4), (0.2, 0.1), (0, 0.4)]), (2, [(1, 1), (1.01, 1), (1.01, 1.01), (1, 1.01)]), (3, None), (4, [(0, 0), (1, 1)])]
    return rings, spark.createDataFrame([(i, None if r is None else [(float(x), float(y)) for x, y in r]) for i, r in rings], "region_id int, ring array<struct<x:double,y:double>>")


def in_ring(ring, x, y):
    """By the angles under which the point sees the sides."""
    turn = 0.0
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        turn += math.atan2((x1 - x) * (y2 - y) - (x2 - x) * (y1 - y), (x1 - x) * (x2 - x) + (y1 - y) * (y2 - y))
    return abs(turn) > 3


@pytest.mark.parametrize("limit", [nearby.BROADCAST_ROWS, 0])
@pytest.mark.parametrize("target", [1.0, 0.1])
def test_regions(spark, shapes, limit, target, monkeypatch):
    monkeypatch.setattr(nearby, "BROADCAST_ROWS", limit)
    rings, df = shapes
    df = df.unionByName(df.where("region_id = 2"))  # a shape that occurs twice matches twice
    rng = np.random.default_rng(3)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([rng.uniform(-0.1, 0.5, (1500, 2)), rng.uniform(0.99, 1.02, (300, 2))]))]
    pts += [(5000, None, 0.1), (5001, float("nan"), 0.1), (5002, float("inf"), 0.1), (5003, 0.05, 0.05), (5003, 0.05, 0.05), (5004, -1e300, 0.1)]
    points = spark.createDataFrame(pts, "id int, px double, py double").withColumn("shape_id", F.lit(-1)).withColumn("level", F.lit(0)).withColumn("edge", F.lit(0))
    cover, exact = nearby.cover_polygons(df, "region_id", "ring", target), nearby.polygons(df, "region_id", "ring")
    got = sorted((r["id"], r["shape_id"]) for r in nearby.match_cover(points, "px", "py", cover, exact).collect())
    want = []
    for i, x, y in pts:
        for sid, ring in rings:
            if ring and len(ring) > 2 and x is not None and np.isfinite(x) and abs(x) < 1e6 and in_ring(ring, x, y):
                want.extend([(i, sid)] * (2 if sid == 2 else 1))
    assert got == sorted(want) and len(want) > 300
    assert all(r["edge_share"] <= target for r in nearby.edge_share(cover, ["shape_id"]).where("shape_id < 4").collect())
    assert nearby.match_cover(points.limit(0), "px", "py", cover, exact).count() == 0
    assert nearby.match_cover(points, "px", "py", nearby.cover_polygons(df.limit(0), "region_id", "ring"), exact.limit(0)).count() == 0


def test_region_of_two_forms(spark):
    """An id with two different outlines holds the points of both."""
    square = lambda a: [(float(x), float(y)) for x, y in [(a, 0), (a + 0.1, 0), (a + 0.1, 0.1), (a, 0.1)]]
    df = spark.createDataFrame([(1 << 40, square(0)), (1 << 40, square(5))], "region_id bigint, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 0.001, 0.05), (2, 5.05, 0.0999), (3, 3.0, 0.05)], "id int, px double, py double")
    got = nearby.match_cover(points, "px", "py", nearby.cover_polygons(df, "region_id", "ring"), nearby.polygons(df, "region_id", "ring")).collect()
    assert sorted((r["id"], r["shape_id"]) for r in got) == [(1, 1 << 40), (2, 1 << 40)]


def test_large_region(spark):
    """Sixty degrees across, of 4,000 corners: starts from coarse cells, ends in few."""
    at = np.linspace(0, 2 * np.pi, 4000, endpoint=False)
    ring = [(float(x), float(y)) for x, y in zip(30 * np.cos(at) * (1 + 0.05 * np.sin(40 * at)), 30 * np.sin(at) * (1 + 0.05 * np.sin(40 * at)))]
    df = spark.createDataFrame([(1, ring)], "region_id int, ring array<struct<x:double,y:double>>")
    cover = nearby.cover_polygons(df, "region_id", "ring")
    share = nearby.edge_share(cover, ["shape_id"]).first()
    assert share["cells"] < 5000 and share["edge_share"] <= 0.1
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.random.default_rng(5).uniform(-33, 33, (400, 2)))]
    got = nearby.match_cover(spark.createDataFrame(pts, "id int, px double, py double"), "px", "py", cover, nearby.polygons(df, "region_id", "ring"))
    assert sorted(r["id"] for r in got.collect()) == [i for i, x, y in pts if in_ring(ring, x, y)]


@pytest.mark.parametrize("target", [1.0, 0.15])
def test_discs(spark, target):
    rng = np.random.default_rng(4)
    sites = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-0.01, 0.01, (20, 2)))] + [(50, 179.9999, 60.0), (51, 0.0, 89.99), (52, None, 0.0), (53, 0.005, 0.005), (54, 0.005, 0.005)]
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-0.012, 0.012, (3000, 2)))] + [(9000, -179.9995, 60.0), (9001, 179.9999, 60.002), (9002, 1.0, 89.991), (9003, 0.005, 0.005), (9004, None, None)]
    centres = spark.createDataFrame(sites, "s int, x double, y double")
    cover = nearby.cover_discs(centres, "s", "x", "y", 300.0, target)
    points = spark.createDataFrame(pts, "id int, px double, py double")
    got = sorted((r["id"], r["shape_id"]) for r in nearby.match_cover(points, "px", "py", cover, nearby.discs(centres, "s", "x", "y", 300.0)).collect())
    want = sorted((i, s) for i, x, y in pts for s, a, b in sites if x is not None and a is not None and nearby._metres(x, y, a, b) <= 300.0)
    assert got == want and len(want) > 1000
