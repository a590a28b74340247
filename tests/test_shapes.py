"""Hulls, meshes and connectors on shapes with known answers and against plain versions."""

import math
import random

import numpy as np
import pytest

from furrow.operators import geometry as G
from furrow.operators import grid as R
from furrow.operators import nearest as N


def test_hull_is_the_plain_one():
    rng = random.Random(1)
    for n in (1, 2, 3, 4, 30, 300):
        for spread in (3, 1000):
            xy = np.array([(rng.randint(0, spread), rng.randint(0, spread)) for _ in range(n)], dtype=float)
            got = G.hull(xy)
            u = np.unique(xy, axis=0)
            assert {tuple(p) for p in got} <= {tuple(p) for p in u}
            for a, b in zip(got, np.roll(got, -1, axis=0), strict=True):
                if len(got) > 2:
                    assert ((b[0] - a[0]) * (u[:, 1] - a[1]) - (b[1] - a[1]) * (u[:, 0] - a[0]) >= -1e-6).all()


def boxes(corners):
    """Every side's rectangle, the plain way."""
    out = []
    for a, b in zip(corners, np.roll(corners, -1, axis=0), strict=True):
        t = math.atan2(b[1] - a[1], b[0] - a[0])
        u, w = corners @ [math.cos(t), math.sin(t)], corners @ [-math.sin(t), math.cos(t)]
        out.append((np.ptp(u) * np.ptp(w), min(np.ptp(u), np.ptp(w))))
    return min(out)


def test_calipers_are_the_best_side():
    rng = random.Random(2)
    for n in (3, 4, 5, 12, 100, 700):
        corners = G.hull(np.array([(rng.gauss(0, 5), rng.gauss(0, 2)) for _ in range(n)]))
        area, width, length, _ = G.narrowest_box(corners)
        assert area == pytest.approx(boxes(corners)[0], abs=2e-6) and width * length == pytest.approx(area, abs=2e-6)


def test_extent_of_a_turned_rectangle_a_circle_and_less(spark):
    t = math.radians(25)
    turned = [("box", x * math.cos(t) - y * math.sin(t), x * math.sin(t) + y * math.cos(t)) for x in np.linspace(0, 40, 81) for y in np.linspace(0, 10, 21)]
    circle = [("circle", 50 * math.cos(2 * math.pi * k / 10_000), 50 * math.sin(2 * math.pi * k / 10_000)) for k in range(10_000)]
    rest = [("line", float(k), float(k)) for k in range(9)] + [("point", 1.0, 1.0)] * 3 + [("none", None, 1.0), (None, 0.0, 0.0), (None, 2.0, 0.0), (None, 0.0, 1.0)]
    df = spark.createDataFrame([(k, None if x is None else float(x), float(y)) for k, x, y in turned + circle + rest], "feature_id string, x double, y double").repartition(6)
    got = {r["feature_id"]: r for r in G.oriented_extent(df).collect()}
    assert set(got) == {"box", "circle", "line", "point", None}
    b = got["box"]
    assert (b["width"], b["length"], b["axis_deg"]) == (pytest.approx(10), pytest.approx(40), pytest.approx(25, abs=1e-6))
    assert got["circle"]["width"] == pytest.approx(100, abs=1e-4)
    assert got["line"]["length"] == pytest.approx(8 * math.sqrt(2)) and got["line"]["axis_deg"] == pytest.approx(45) and got["point"]["area"] == 0
    assert got[None]["area"] == pytest.approx(2)
    assert G.convex_hulls(df.filter("feature_id = 'box'")).count() == 4  # collinear points are no corners


def mesh(spark, rows, cols, hole=(), missing=(), axis=129):
    cells = [(0, r, k, None if (r, k) in hole else 100.0 + cols * r + k) for r in range(rows) for k in range(cols) if (r, k) not in missing]
    return R.decimate_mesh(spark.createDataFrame(cells, "grid_id int, row int, col int, v double"), axis)


def test_a_small_mesh_with_and_without_a_hole(spark):
    verts, _, total = mesh(spark, 5, 5, axis=3)
    (t,) = total.collect()
    v = sorted((r["row"], r["col"], r["v"]) for r in verts.collect())
    assert (t["vertices"], t["triangles"], t["omitted_quads"]) == (9, 8, 0) and v[0][2] == 100 and v[-1][2] == 124
    for odd in ({"hole": {(1, 1)}}, {"missing": {(1, 1)}}):  # a cell that isn't sampled
        (t,) = mesh(spark, 5, 5, axis=3, **odd)[2].collect()
        assert (t["vertices"], t["triangles"], t["omitted_quads"]) == (9, 6, 1)


def test_a_long_axis_gives_129_samples_with_both_ends(spark):
    verts, quads, total = mesh(spark, 300, 4)
    (t,) = total.collect()
    assert (t["sampled_rows"], t["sampled_cols"], t["omitted_quads"], t["triangles"]) == (129, 4, 0, 2 * 128 * 3)
    rows = sorted({r["row"] for r in verts.select("row").collect()})
    assert rows == sorted({i * 299 // 128 for i in range(129)}) and rows[0] == 0 and rows[-1] == 299
    (t,) = mesh(spark, 300, 4, hole={(150, 2)})[2].collect()
    sampled = 150 in rows
    assert t["omitted_quads"] == (2 if not sampled else 4) and t["vertices"] == 129 * 4 - sampled
    with pytest.raises(ValueError):
        mesh(spark, 3, 3, axis=2)


def ring(key, corners, n=1):
    return [(key, n, k, float(x), float(y)) for k, (x, y) in enumerate([*corners, corners[0]])]


def areas(spark, *rings):
    return N.ring_edges(spark.createDataFrame([r for x in rings for r in x], "polygon_id int, ring int, seq int, x double, y double"))


def test_connectors_in_a_union(spark):
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    both = areas(spark, ring(1, box(0, 0, 10, 10)), ring(2, box(10, 0, 20, 10)), ring(3, box(23, 0, 30, 10)), ring(3, box(24, 4, 26, 6), 2))
    rows = [("touching", 5, 5, 15, 5), ("gap", 15, 5, 25, 2), ("on side", 2, 0, 18, 0), ("corner", 1, 9, 12, 11), ("hole", 23.5, 5, 29, 5), ("inside", 27, 1, 29, 9), ("none", 50, 50, 51, 51), ("point", 5, 5, 5, 5)]
    c = spark.createDataFrame([(n, *map(float, v)) for n, *v in rows], "connector_id string, x double, y double, sx double, sy double")
    assert {r[0] for r in N.uncovered(c, both, 7.0).collect()} == {"gap", "corner", "hole", "none"}


def test_connections_need_the_nearest_ends_the_other_field_and_the_union(spark):
    schema = "row_id int, line_id int, x0 double, y0 double, x1 double, y1 double"
    a = [(k, 1, 0.0, 10.0 * k, 88.0, 10.0 * k) for k in range(5)] + [(2, 2, 0.0, 21.0, 89.5, 21.0)]
    b = [(k, 1, 112.0, 10.0 * k, 200.0, 10.0 * k) for k in range(5)]
    left, right = [(-1, -5), (100, -5), (100, 55), (-1, 55)], [(100, -5), (210, -5), (210, 25), (103, 25), (103, 55), (100, 55)]
    right_cut = [(100, -5), (210, -5), (210, 25), (100, 25)], [(103, 25), (210, 25), (210, 55), (103, 55)]
    df = lambda rows: spark.createDataFrame(rows, schema)
    got = {r["row_id"]: r for r in G.infer_connections(df(a), df(b), areas(spark, ring(1, left)), areas(spark, *[ring(k, r) for k, r in enumerate(right_cut)])).collect()}
    assert set(got) == {0, 1, 2}  # rows 3 and 4 cross the lane between x = 100 and 103
    assert got[2]["a_line"] == 2 and got[2]["gap"] == pytest.approx(math.hypot(22.5, 1)) and (got[0]["a_end"], got[0]["b_end"]) == (1, 0)
    assert got[0]["angle"] == pytest.approx(90) and got[2]["angle"] == pytest.approx(90)
    far = [(-1, -5), (90, -5), (90, 55), (-1, 55)]
    assert G.infer_connections(df(a), df(b), areas(spark, ring(1, far)), areas(spark, ring(1, right))).collect() == []  # ends are 22 m from it
    assert {r["row_id"] for r in G.infer_connections(df(a), df(b)).collect()} == set(range(5))
    (s,) = G.connection_summary(G.infer_connections(df(a), df(b)).withColumn("grade", G.c("gap") * 0 + 6), 20.0, 5.0).collect()
    assert (s["pairs"], s["segments"], s["over_alert"], s["gap_max"]) == (5, 10, 5, 24.0) and s["break_even_kmh"] == pytest.approx(s["gap_total"] / 100 * 3.6)
    (none,) = G.connection_summary(G.infer_connections(df(a), df(b)).limit(0).withColumn("grade", G.c("gap")), 20.0, 5.0).collect()
    assert none["pairs"] == 0 and none["gap_p50"] is None and none["break_even_kmh"] is None
