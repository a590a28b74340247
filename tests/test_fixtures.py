"""Small analytic cases with known answers."""

import heapq
import math

import pytest
from pyspark.sql import functions as F

from furrow.functions import expr as X
from furrow.operators import geometry as G
from furrow.operators import graph as A
from furrow.operators import grid as R
from furrow.operators import hydrology as H
from furrow.operators import logistics as L
from furrow.operators import quality as Q
from furrow.operators import scenario as S
from furrow.sources import files as I


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_rusle(spark):
    df = spark.createDataFrame([(1, 1000.0, 0.02, 1.5, 0.1, 0.5, 2.0), (2, 500.0, 0.03, 2.0, 0.2, 0.8, None), (3, 500.0, 0.03, 2.0, 1.1, 0.8, None), (4, None, 0.03, 2.0, 0.1, 0.8, None)], "u int, r double, k double, ls double, c double, p double, tolerance double")
    a, b, bad, none = sorted(rows(X.rusle(df)), key=lambda r: r["u"])
    assert a["soil_loss"] == pytest.approx(1.5) and a["tolerance_ratio"] == pytest.approx(0.75) and a["status"].startswith("WITHIN")
    assert b["soil_loss"] == pytest.approx(4.8) and b["status"] == "TOLERANCE_NOT_DECLARED"
    assert bad["reject_reason"] == "C_OUTSIDE_0_1" and bad["soil_loss"] is None
    assert none["reject_reason"] == "R_NOT_POSITIVE"


def test_mass_balance(spark):
    cols = "event_id string, idx int, duration_s double, rainfall_excess_mm double, external_inflow_m3 double, controlled_outflow_m3 double, storage_start_m3 double, storage_end_m3 double"
    iv = spark.createDataFrame([("A", 0, 600.0, 10.0, 0.0, 40.0, 0.0, 60.0), ("A", 1, 600.0, 0.0, 20.0, 50.0, 60.0, 30.0), ("B", 0, 600.0, 10.0, 0.0, 20.0, 0.0, 60.0), ("C", 0, 600.0, 0.0, 0.0, 0.0, 0.0, 10.0), ("C", 1, 600.0, 0.0, 0.0, 0.0, 9.0, 10.0)], cols)
    ha = spark.createDataFrame([("A", 1.0), ("B", 1.0), ("C", 1.0)], "event_id string, area_ha double")
    e = {r["event_id"]: r for r in rows(H.mass_balance(iv, ha, 0.01)[1])}
    assert (e["A"]["inflow_m3"], e["A"]["outflow_m3"], e["A"]["storage_change_m3"], e["A"]["status"]) == (120, 90, 30, "PASS")
    assert e["B"]["residual_m3"] == 20 and e["B"]["status"] == "FAIL"
    assert [(r["event_id"], r["gap_m3"]) for r in rows(H.storage_breaks(iv))] == [("C", -1.0)]


def test_rainfall_excess(spark):
    iv = spark.createDataFrame([("a", 0, 600.0, 5.0), ("a", 1, 600.0, 10.0), ("b", 0, 600.0, 8.0), ("b", 1, 600.0, 17.0), ("b", 2, 600.0, 25.0)], "event_id string, idx int, duration_s double, rain_mm double")
    p = spark.createDataFrame([("a", 2.0, 100.0, 0.2), ("b", 10.0, 80.0, 0.2)], "event_id string, area_ha double, curve_number double, ia_ratio double")
    per, ev = H.rainfall_excess(iv, p)
    e = {r["event_id"]: r for r in rows(ev)}
    assert e["a"]["excess_mm"] == 15 and e["a"]["excess_m3"] == 300
    assert e["b"]["excess_mm"] == pytest.approx((50 - 12.7) ** 2 / (50 - 12.7 + 63.5), abs=1e-12)
    assert all(r["excess_mm"] >= 0 for r in rows(per))


def test_hydrograph_and_its_volume(spark):
    ex = spark.createDataFrame([("a", 0, 0.0, 600.0, 100.0)], "event_id string, idx int, start_s double, duration_s double, volume_m3 double")
    out = rows(H.series_balance(H.hydrograph(ex, 900.0, 60.0, 2.5), ex.select("event_id", F.col("volume_m3").alias("input_m3"))))[0]
    assert out["volume_m3"] == pytest.approx(100, abs=1e-10) and out["peak_flow"] == pytest.approx(200 / 3000) and out["time_to_peak_s"] == 1200 and out["status"] == "PASS"


def test_lag_routing(spark):
    r = spark.createDataFrame([("R1", "A", "C", 10.0), ("R2", "B", "C", 20.0), ("R3", "C", "D", 5.0)], "reach_id string, up string, down string, travel_s double")
    lat = spark.createDataFrame([(n, t, q * k) for n, k in (("A", 1), ("B", 0.5)) for t, q in ((0.0, 0.0), (10.0, 2.0), (20.0, 0.0))], "node string, time_s double, flow double")
    s = {x["reach_id"]: x for x in rows(H.routing_summary(r, H.route_by_lag(r, lat)))}
    assert s["R3"]["volume_m3"] == pytest.approx(30, abs=1e-9) and s["R3"]["peak_flow"] > 0
    bad = spark.createDataFrame([("x", "A", "B"), ("y", "B", "A"), ("z", "A", "C")], "reach_id string, up string, down string")
    found = {(x["rule"], x["key"]) for x in rows(H.check_network(bad, lat.select("node")))}
    assert ("CYCLE", "A") in found and ("SPLIT", "A") in found


def test_normal_depth(spark):
    q = (1 / 0.03) * 2 * 0.5 ** (2 / 3) * 0.1
    d = spark.range(1).select(X.normal_depth(F.lit(q), F.lit(2.0), F.lit(0.0), F.lit(0.01), F.lit(0.03)).alias("d")).first()["d"]
    assert d == pytest.approx(1.0, abs=1e-12)


def test_grade_alerts(spark):
    p = spark.createDataFrame([("a", i, 10.0 * i, z) for i, z in enumerate((0.0, 1.0, 0.0, 0.0, 1.0))] + [("b", 0, 0.0, 1.0), ("b", 1, 0.0, 2.0)], "row_id string, seq int, chainage double, elevation double")
    for limit, status, length in ((5.0, "SAMPLED_EXCEEDANCE", 30.0), (10.0, "NO_SAMPLED_EXCEEDANCE_NOT_APPROVED", 0.0), (None, "NOT_EVALUATED", None)):
        out = {r["row_id"]: r for r in rows(G.grade_alerts(p, spark.createDataFrame([("a", limit), ("b", limit)], "row_id string, threshold double")))}
        assert (out["a"]["status"], out["a"]["alert_length"]) == (status, length)
        assert out["b"]["status"] == "INVALID_SOURCE_PROFILE" and out["b"]["length"] is None


def test_crossing_diagonals_and_circle(spark):
    v = spark.createDataFrame([("g", "a", 1, 0.0, 0.0), ("g", "a", 2, 100.0, 50.0), ("g", "b", 1, 0.0, 50.0), ("g", "b", 2, 100.0, 0.0)], "group_id string, line_id string, seq int, x double, y double")
    assert [(r["a_id"], r["b_id"], r["relation"]) for r in rows(G.row_relations(v, ["group_id"]))] == [("a", "b", "CROSSING")]
    c = spark.createDataFrame([("c", i + 1, 10 * math.cos(math.tau * i / 36), 10 * math.sin(math.tau * i / 36)) for i in range(20)], "line_id string, seq int, x double, y double")
    out = rows(G.curvature(c, 15.0))[0]
    assert out["min_radius"] == pytest.approx(10) and out["verdict"] == "FAIL_STATIC_PATH_RADIUS"


def test_isolines_of_a_plane(spark):
    cells = spark.createDataFrame([(0, r, k, r + 0.5) for r in range(20) for k in range(20)], "grid_id int, row int, col int, v double")
    out = {r["level"]: r["len"] for r in rows(R.isoline_segments(cells, 5.0).groupBy("level").agg(F.sum("len").alias("len")))}
    assert sorted(out) == [5.0, 10.0, 15.0] and all(x == pytest.approx(19) for x in out.values())


def test_smoothing_keeps_what_is_valid(spark):
    cells = spark.createDataFrame([(0, r, k, None if (r, k) == (3, 3) else 120.0 if (r, k) == (10, 10) else 100.0) for r in range(21) for k in range(21)], "grid_id int, row int, col int, v double")
    at = lambda s, rc: [r["smooth"] for r in rows(R.smooth(cells, s)) if (r["row"], r["col"]) == rc][0]
    assert at(0, (10, 10)) == 120 and 100 < at(2, (10, 10)) < 120 and at(2, (3, 3)) is None


def test_components_of_two_islands(spark):
    m = spark.createDataFrame([("f", 0, 0, 0), ("f", 0, 1, 1), ("g", 0, 0, 0), ("g", 0, 0, 1)], "field string, grid_id int, row int, col int")
    assert {r["field"]: r["components"] for r in rows(R.grid_components(m))} == {"f": 2, "g": 1}


def test_load_events_and_nearest_site(spark):
    s = spark.createDataFrame([("r", 1, 1, 1.0, 10.0), ("r", 2, 2, 1.0, 8.0)], "run_id string, sequence int, segment_id int, mass_t double, length_m double")
    events = lambda capacity: [(r["segment_id"], r["kind"], r["station_m"], r["mass_t"]) for r in rows(L.load_events(s, capacity).orderBy("k"))]
    assert events(1.0) == [(1, "FULL", 10.0, 1.0), (2, "FULL", 8.0, 1.0)] and events(0.75) == [(1, "FULL", 7.5, 0.75), (2, "FULL", 4.0, 0.75), (2, "PARTIAL", 8.0, 0.5)]
    d = spark.createDataFrame([(1, 10.0, 20.0, 1.0), (2, 20.0, 20.0, 1.0)], "demand_id int, x double, y double, mass_t double")
    assert {r["site_id"] for r in rows(L.assign_nearest(d, spark.createDataFrame([("A", 0.0, 0.0), ("B", 100.0, 0.0)], "site_id string, x double, y double")))} == {"A"}


def test_shortest_paths_against_a_queue(spark):
    edges = [(i, (i * 7 + 3) % 40, 1.0 + i % 5) for i in range(40)] + [(i, i + 1, 2.0 + i % 3) for i in range(30)]
    got = {r["target"]: r["distance"] for r in rows(A.shortest_paths(spark.createDataFrame(edges, "a int, b int, weight double"), spark.createDataFrame([(0,)], "node int"), spark.createDataFrame([(i,) for i in range(45)], "node int")))}
    near: dict = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    best, q = {}, [(0.0, 0)]
    while q:
        d, n = heapq.heappop(q)
        if n not in best:
            best[n] = d
            for m, w in near[n]:
                heapq.heappush(q, (d + w, m))
    assert all(got[i] == (pytest.approx(best[i]) if i in best else None) for i in range(45))


def test_crossing_candidates(spark):
    cells = spark.createDataFrame([(0, r, k, 9.0 if (r, k) == (0, 0) else 8.0 if (r, k) == (0, 2) else 7.0 if (r, k) == (0, 15) else 1e-3 * (r + k)) for r in range(20) for k in range(20)], "grid_id int, row int, col int, v double")
    out = rows(R.crossing_candidates(cells, cells, 8, 5.0))
    assert [(r["row"], r["col"]) for r in out[:2]] == [(0, 0), (0, 15)]


def test_adjacent_spacing(spark):
    v = spark.createDataFrame([("a", 1, 0.0, 10.0), ("a", 2, 100.0, 10.0), ("b", 1, 0.0, 11.5), ("b", 2, 100.0, 11.5)], "line_id string, seq int, x double, y double")
    out = rows(G.adjacent_spacing(v, spark.createDataFrame([("a", 1, 0), ("b", 1, 1)], "line_id string, group_id int, level int"), 1.5))[0]
    assert out["p50"] == pytest.approx(1.5) and out["unpaired"] == 0 and out["outside_share"] == 0
    far = v.withColumn("y", F.when(F.col("line_id") == "b", 30.0).otherwise(F.col("y")))
    out = rows(G.adjacent_spacing(far, spark.createDataFrame([("a", 1, 0), ("b", 1, 1)], "line_id string, group_id int, level int"), 1.5))[0]
    assert out["outside_share"] == 1 and out["p50"] is None


def test_scenario_scores(spark):
    df = spark.createDataFrame([("r", "E0A", 10.0, 2.0, 10.0, 0.1, 0.4, 0.5, 0, None), ("r", "E0A", 10.0, 3.0, 15.0, 0.1, 0.4, 0.5, 0, None), ("r", "E0B", 10.0, 4.0, 10.0, 0.4, 0.1, 0.0, 0, None), ("r", "E0B", 10.0, 6.0, 15.0, 0.4, 0.1, 0.0, 0, None)], "run_id string, scenario_id string, area double, km double, shots double, loss_cons double, loss_harv double, loss_perf double, violations int, codes string")
    out = {r["scenario_id"]: r for r in rows(S.scenario_scores(df))}
    assert out["E0A"]["mean_shot_m"] == 200 and out["E0A"]["comparison"] == pytest.approx(60) and out["E0B"]["comparison"] == pytest.approx(90) and out["E0B"]["recommended"]


def test_select_trial(spark):
    df = spark.createDataFrame([("a", 0.0, "FAIL", 999.0, 0.0, 0.0, 1.0), ("a", 0.25, "PASS", 8.0, 0.0, 0.0, 1.0), ("b", 0.5, "FAIL", 8.0, 0.0, 0.0, 1.0), ("b", 0.0, "FAIL", 8.0, 0.0, 0.0, 1.0)], "group_id string, fraction double, status string, radius double, outside double, error double, coverage double")
    assert {r["group_id"]: (r["fraction"], r["role"]) for r in rows(S.select_trial(df, ["group_id"]))} == {"a": (0.25, "SELECTED"), "b": (0.0, "DIAGNOSTIC_ONLY")}


def test_files(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]},"properties":{"n":1}},{"geometry":null},{"geometry":{"type":"Point","coordinates":[5,6,7]}}]}')
    f, v = I.read_features(spark, str(tmp_path / "a.geojson"))
    assert f.count() == 2 and v.count() == 5 and v.filter("z = 7").count() == 1
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "c.pdf").write_bytes(b"nope")
    assert {r["path"][-5:]: r["signature_ok"] for r in rows(I.scan_files(spark, str(tmp_path / "*.pdf")))} == {"b.pdf": True, "c.pdf": False}
    bad = spark.createDataFrame([(1, 1, 0.0, 0.0, None), (1, 2, float("nan"), 0.0, 1.0)], "feature_id int, seq int, x double, y double, z double")
    assert rows(I.to_geojson(bad, spark.createDataFrame([(1, "s")], "feature_id int, status string")))[0]["error"] == "NON_FINITE_COORDINATE"
    with pytest.raises(ValueError):
        I.find_id_column(spark.createDataFrame([(1,)], "a int"), ["1", "1"])


def test_check_values_lists_what_is_missing(spark):
    v = spark.createDataFrame([(1, "n", "x"), (2, "n", "5")], "row_id int, name string, value string")
    r = spark.createDataFrame([("n", "number", 0.0, 4.0, None, None, True), ("m", "text", None, None, "^a", None, True)], "name string, kind string, low double, high double, pattern string, choices array<string>, required boolean")
    assert {(x["row_id"], x["rule"]) for x in rows(Q.check_values(v, r))} == {(1, "NOT_A_NUMBER"), (2, "ABOVE_MAXIMUM"), (1, "MISSING"), (2, "MISSING")}
