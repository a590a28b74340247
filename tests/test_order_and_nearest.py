"""Rank selection against sorting, and snapping past exclusions, on small and on large groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import graph as A
from furrow.operators import logistics as L
from furrow.operators import nearest as N
from furrow.operators.order import summarise

WANTS = {"p0": ("v", 0.0), "p05": ("v", 0.05), "p50": ("v", 0.5), "p999": ("v", 0.999), "p1": ("v", 1.0), "w50": ("w", 0.5)}


def test_rank_selection_is_sorting(spark):
    rng = random.Random(2)
    odd = [1e308, -1e308, 5e-324, -5e-324, 0.0, -0.0, 1e-300]
    groups = {"ties": [rng.choice([1.0, 2.0, 2.0, 7.5]) for _ in range(900)], "wide": [rng.choice(odd) * rng.random() for _ in range(700)], "one": [3.25] * 600, None: [rng.gauss(0, 1) for _ in range(800)], "few": [4.0, 9.0], "none": []}
    rows = [(g, x, -x, 1) for g, v in groups.items() for x in v] + [(g, None, None, 1) for g in groups] + [("few", float("nan"), float("inf"), 1)]
    df = spark.createDataFrame(rows, "g0 string, v double, w double, n int").repartition(5)
    for most in (500, 10**9):
        got = {r["g0"]: r for r in summarise(df, ["g0"], [F.sum("n").alias("rows")], WANTS, most).collect()}
        assert set(got) == set(groups)
        for g, v in groups.items():
            assert got[g]["rows"] == len(v) + (2 if g == "few" else 1)
            for name, (col, p) in WANTS.items():
                own = np.array(v if col == "v" else [-x for x in v])
                if not len(own):
                    assert got[g][name] is None
                elif g == "wide":
                    at = np.sort(own)[[int((len(own) - 1) * p), min(len(own) - 1, int((len(own) - 1) * p) + 1)]]
                    assert at[0] <= got[g][name] <= at[1]
                else:
                    assert got[g][name] == pytest.approx(np.percentile(own, p * 100), rel=1e-12, abs=1e-12)


def test_a_million_values_of_one_group_without_gathering_them(spark):
    df = spark.range(1_200_000).select(F.lit("a").alias("g0"), (F.col("id") * 7919 % 1_200_007 / 3).alias("v"), F.col("id").cast("double").alias("w"))
    out = summarise(df, ["g0"], [F.count(F.lit(1)).alias("n")], WANTS, 1_000_000)
    v = np.array([i * 7919 % 1_200_007 / 3 for i in range(1_200_000)])
    r = out.collect()[0]
    assert r["n"] == 1_200_000 and r["w50"] == pytest.approx(599_999.5)
    for name, (col, p) in WANTS.items():
        if col == "v":
            assert r[name] == pytest.approx(np.percentile(v, p * 100), rel=1e-12)


def test_without_groups(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"), F.col("id").cast("double").alias("w"))
    for most in (10, 10**6):
        (r,) = summarise(df, [], [F.max("v").alias("top")], WANTS, most).collect()
        assert (r["top"], r["p50"], r["p05"], r["p1"]) == (1000, 500, 50, 1000)


SEGMENTS = [(1, 0.0, 0.0, 20.0, 0.0), (2, 0.0, 10.0, 20.0, 10.0), (3, 0.0, 500.0, 0.0, 520.0), (4, 30.0, 0.0, 30.0, 10.0)]
SQUARE = [(7, 1, k, x, y) for k, (x, y) in enumerate([(4.0, 1.0), (8.0, 1.0), (8.0, 3.0), (4.0, 3.0), (4.0, 1.0)])]
HOLE = [(7, 2, k, x, y) for k, (x, y) in enumerate([(5.0, 1.5), (7.0, 1.5), (7.0, 2.5), (5.0, 2.5), (5.0, 1.5)])]


def snapped(spark, points, exclusions):
    p = spark.createDataFrame(points, "point_id string, x double, y double")
    s = spark.createDataFrame(SEGMENTS, "segment_id int, x0 double, y0 double, x1 double, y1 double")
    e = N.ring_edges(spark.createDataFrame(exclusions, "polygon_id int, ring int, seq int, x double, y double")) if exclusions else None
    return {r["point_id"]: r for r in A.snap(p, s, 8.0, e, 5.0).collect()}


def test_snap_goes_on_past_an_exclusion(spark):
    out = snapped(spark, [("behind", 6.0, 4.0), ("clear", 2.0, 4.0), ("within", 4.5, 2.0), ("hole", 6.0, 2.0), ("far", 0.0, 700.0), ("on", 5.0, 0.0)], SQUARE + HOLE)
    r = out["behind"]  # 4 m to the nearest through the square, 6 m to the next
    assert (r["segment_id"], r["gap"], r["reasons"]) == (1, 4.0, "ACCESS_CONNECTOR_INTERSECTS_EXCLUSION")
    assert (r["legal_segment_id"], r["legal_station"], r["legal_gap"], r["passed_over"]) == (2, 6.0, 6.0, 1)
    assert out["clear"]["reasons"] == "" and out["clear"]["legal_segment_id"] == 1 and out["clear"]["passed_over"] == 0
    assert out["within"]["legal_segment_id"] is None and out["within"]["passed_over"] == 2
    assert out["hole"]["legal_segment_id"] is None  # its way out crosses the ring
    assert (out["far"]["segment_id"], out["far"]["gap"], out["far"]["reasons"]) == (3, 180.0, "ACCESS_CONNECTOR_EXCEEDS_TOLERANCE") and out["far"]["legal_segment_id"] is None
    assert (out["on"]["gap"], out["on"]["reasons"]) == (0.0, "")


def test_snap_without_exclusions_or_segments(spark):
    assert snapped(spark, [("a", 6.0, 4.0)], [])["a"]["reasons"] == ""
    none = spark.createDataFrame([], "segment_id int, x0 double, y0 double, x1 double, y1 double")
    (r,) = A.snap(spark.createDataFrame([("a", 0.0, 0.0)], "point_id string, x double, y double"), none, 8.0).collect()
    assert r["segment_id"] is None and r["reasons"] == "NO_ROAD"


def test_inside_of_random_polygons(spark):
    rng = random.Random(8)
    corners, points = [], [(i, rng.uniform(-5, 105), rng.uniform(-5, 105)) for i in range(300)]
    shapes = {}
    for k in range(12):
        n, cx, cy = rng.randint(3, 9), rng.uniform(0, 100), rng.uniform(0, 100)
        ring = [(cx + rng.uniform(2, 40) * np.cos(2 * np.pi * a / n), cy + rng.uniform(2, 40) * np.sin(2 * np.pi * a / n)) for a in range(n)]
        shapes[k] = ring
        corners += [(k, 1, i, float(x), float(y)) for i, (x, y) in enumerate([*ring, ring[0]])]
    edges = N.ring_edges(spark.createDataFrame(corners, "polygon_id int, ring int, seq int, x double, y double"))
    p = spark.createDataFrame(points, "point_id int, x double, y double")

    def holds(ring, x, y):
        return sum((y0 > y) != (y1 > y) and x < x0 + (x1 - x0) * (y - y0) / (y1 - y0) for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True)) % 2 == 1

    got = {(r["point_id"], r["polygon_id"]) for r in N.inside(p, edges, 7.0).collect()}
    assert got == {(i, k) for i, x, y in points for k, ring in shapes.items() if holds(ring, x, y)}


def test_nearest_site_of_many(spark):
    rng = random.Random(3)
    sites = [(i, rng.uniform(0, 4000), rng.uniform(0, 50)) for i in range(60)]
    demand = [(i, rng.uniform(-9000, 9000), rng.uniform(-50, 90), 1.0, "FULL") for i in range(150)]
    out = L.assign_nearest(spark.createDataFrame(demand, "demand_id int, x double, y double, mass_t double, kind string"), spark.createDataFrame(sites, "site_id int, x double, y double"), 3.0)
    got = {r["demand_id"]: r["site_id"] for r in out.collect()}
    assert got == {i: min(sites, key=lambda s: ((s[1] - x) ** 2 + (s[2] - y) ** 2, s[0]))[0] for i, x, y, *_ in demand}
