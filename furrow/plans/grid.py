"""GR1-GR25 over the given tables: cells are parts, 50 to a row; prices and sizes are the two surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import grid as G
from furrow.plans.feeds import FEEDS, feed, oracle

FEEDS["cells"] = """SELECT 0 AS grid_id, CAST(floor(p_partkey / 5e1) AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col, CASE WHEN p_size = 1 THEN NULL ELSE p_retailprice / 1e1 + p_size * p_size * 1e-2 END AS v FROM part"""
FEEDS["cells_b"] = """SELECT 0 AS grid_id, CAST(floor(p_partkey / 5e1) AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col, CASE WHEN p_size = 2 THEN NULL ELSE p_retailprice / 1e1 + p_size * 1e-1 END AS v FROM part"""
# the corners of two fields, one with a hole, once in each block of twenty grid rows
FEEDS["outlines"] = """SELECT 'F1' AS f, 1 AS ring, 1 AS seq, 2e0 AS x, 1.25e0 AS y UNION ALL SELECT 'F1', 1, 2, 30e0, 1.25e0 UNION ALL SELECT 'F1', 1, 3, 33e0, 17.75e0 UNION ALL SELECT 'F1', 1, 4, 4e0, 15.25e0 UNION ALL SELECT 'F1', 1, 5, 2e0, 1.25e0
UNION ALL SELECT 'F1', 2, 1, 10e0, 5.25e0 UNION ALL SELECT 'F1', 2, 2, 16e0, 5.25e0 UNION ALL SELECT 'F1', 2, 3, 16e0, 9.75e0 UNION ALL SELECT 'F1', 2, 4, 10e0, 5.25e0
UNION ALL SELECT 'F2', 1, 1, 36e0, 2.25e0 UNION ALL SELECT 'F2', 1, 2, 48.5e0, 2.25e0 UNION ALL SELECT 'F2', 1, 3, 42e0, 18.25e0 UNION ALL SELECT 'F2', 1, 4, 36e0, 2.25e0"""
FEEDS["corners"] = """SELECT concat(f, '.', b) AS field, ring, seq, x, y + 2e1 * b AS y FROM outlines CROSS JOIN (SELECT DISTINCT CAST(floor(p_partkey / 1e3) AS INT) AS b FROM part) q"""
FEEDS["field_edges"] = """SELECT a.field, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM corners a JOIN corners b ON a.field = b.field AND a.ring = b.ring AND b.seq = a.seq + 1"""
FEEDS["field_mask"] = """SELECT field, grid_id, row, col FROM (SELECT e.field, k.grid_id, k.row, k.col, count(*) AS n FROM cells k JOIN field_edges e ON (y0 > k.row + 5e-1) <> (y1 > k.row + 5e-1) AND k.col + 5e-1 < x0 + (x1 - x0) * (k.row + 5e-1 - y0) / (y1 - y0) GROUP BY e.field, k.grid_id, k.row, k.col) q WHERE n % 2 = 1"""
FEEDS["grads"] = """SELECT grid_id, row, col, v, CASE WHEN v IS NOT NULL THEN coalesce((vr - vl) / 2, vr - v, v - vl) END AS gx, CASE WHEN v IS NOT NULL THEN coalesce((vd - vu) / 2, vd - v, v - vu) END AS gy FROM (SELECT a.grid_id, a.row, a.col, a.v, r.v AS vr, l.v AS vl, d.v AS vd, u.v AS vu
FROM cells a LEFT JOIN cells r ON r.row = a.row AND r.col = a.col + 1 LEFT JOIN cells l ON l.row = a.row AND l.col = a.col - 1 LEFT JOIN cells d ON d.row = a.row + 1 AND d.col = a.col LEFT JOIN cells u ON u.row = a.row - 1 AND u.col = a.col) q"""
FEEDS["axes"] = """SELECT grid_id, row, col, (row * 7 + col * 13) % 18 * 1e1 AS v FROM cells WHERE v IS NOT NULL"""
FEEDS["phases"] = """SELECT grid_id, row, col, v / 1e1 AS phi, (row + col) % 5 * 5e-1 AS grad FROM cells WHERE v IS NOT NULL"""
FEEDS["levels"] = """SELECT 0 AS grid_id, l AS level FROM (SELECT n_nationkey * n_nationkey * 1e0 AS l FROM nation) q"""
FEEDS["cloud"] = """SELECT l_orderkey AS point_id, (l_partkey % 400) * 1e-1 + l_linenumber * 1e-2 AS x, (l_suppkey % 100) * 2e-1 + l_quantity * 1e-3 AS y, l_extendedprice / 1e3 AS z, CAST(CASE WHEN l_returnflag = 'N' THEN 2 ELSE 5 END AS INT) AS classification, l_linenumber AS returns, l_tax AS time, 0 AS red, CASE WHEN l_linenumber = 7 THEN 40 ELSE 0 END AS green, CAST(NULL AS INT) AS blue FROM lineitem"""
FEEDS["ground"] = """SELECT x, y, z FROM cloud WHERE classification = 2"""
FEEDS["probes"] = """SELECT s_suppkey AS point_id, (s_suppkey % 47) * 1e0 + 8e-1 AS x, (s_suppkey % 17) * 1e0 + 7e-1 AS y FROM supplier"""

QUERIES, ORACLES = {}, {}
R = lambda c, n=6: F.round(c, n)


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = oracle(sql)
        return fn

    return add


def rounded(df, cols, n=6):
    return df.withColumns({c: R(c, n) for c in cols})


_Q = "round(quantile_cont(v, {p}), 6) AS {n}"


@query("gr1_quantiles", "SELECT field, count(*) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, " + ", ".join(_Q.format(p=p, n=n) for n, p in (("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))) + " FROM field_mask JOIN cells USING (grid_id, row, col) WHERE v IS NOT NULL GROUP BY field")
def gr1(spark, d):
    df = G.mask_cells(feed(spark, d, "cells"), feed(spark, d, "field_edges")).join(feed(spark, d, "cells"), G.RC)
    return rounded(G.quantiles(df, "v", ["field"]), ["min", "max", "mean", "std", "p05", "p25", "median", "p75", "p90", "p95", "p99"])


@query("gr2_bands", """SELECT grid_id, lo, round(count(*) FILTER (v >= lo AND v < hi) * 1e2 / count(v), 6) AS percent FROM cells, (VALUES (0e0, 90e0), (90e0, 1e2), (1e2, 1.1e2), (1.1e2, 1e9)) b(lo, hi) GROUP BY grid_id, lo""")
def gr2(spark, d):
    return rounded(G.bands(feed(spark, d, "cells"), "v", [0.0, 90.0, 100.0, 110.0], ["grid_id"]), ["percent"])


@query("gr3_mask_cells", "SELECT field, grid_id, row, col FROM field_mask")
def gr3(spark, d):
    return G.mask_cells(feed(spark, d, "cells"), feed(spark, d, "field_edges"))


@query("gr4_coverage", """SELECT field, count(*) AS cells, count(*) FILTER (v IS NULL) AS invalid, CASE WHEN count(*) FILTER (v IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM field_mask JOIN cells USING (grid_id, row, col) GROUP BY field""")
def gr4(spark, d):
    return G.coverage(G.mask_cells(feed(spark, d, "cells"), feed(spark, d, "field_edges")), feed(spark, d, "cells"))


@query("gr5_compare_surfaces", """SELECT count(*) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(sqrt(avg(d * d)), 6) AS rmse, round(quantile_cont(abs(d), 0.5), 6) AS abs_median, round(quantile_cont(abs(d), 0.95), 6) AS abs_p95, round(quantile_cont(abs(d), 0.99), 6) AS abs_p99, round(max(abs(d)), 6) AS abs_max
FROM (SELECT a.v - b.v AS d FROM cells a JOIN cells_b b USING (row, col) WHERE a.v IS NOT NULL AND b.v IS NOT NULL)""")
def gr5(spark, d):
    out = G.compare_surfaces(feed(spark, d, "cells"), feed(spark, d, "cells_b"))
    return rounded(out, [x for x in out.columns if x != "n"])


@query("gr6_gradient", "SELECT row, col, round(gx, 6) AS gx, round(gy, 6) AS gy FROM grads")
def gr6(spark, d):
    return rounded(G.gradient(feed(spark, d, "cells")).select("row", "col", "gx", "gy"), ["gx", "gy"])


_HORN = """h AS (SELECT a.row, a.col, CASE WHEN count(b.v) = 9 THEN sum(b.v * (b.col - a.col) * (CASE WHEN b.row = a.row THEN 2 ELSE 1 END)) / 8 END AS gx, CASE WHEN count(b.v) = 9 THEN sum(b.v * (b.row - a.row) * (CASE WHEN b.col = a.col THEN 2 ELSE 1 END)) / 8 END AS gy FROM cells a JOIN cells b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.row, a.col)"""


@query("gr7_slope", f"WITH {_HORN} SELECT row, col, round(sqrt(gx * gx + gy * gy) * 100, 5) AS slope_percent, round(degrees(atan(sqrt(gx * gx + gy * gy))), 5) AS slope_degrees FROM h")
def gr7(spark, d):
    return rounded(G.slope(feed(spark, d, "cells")).select("row", "col", "slope_percent", "slope_degrees"), ["slope_percent", "slope_degrees"], 5)


@query("gr7_hillshade", f"WITH {_HORN} SELECT row, col, round(greatest(0, (sqrt(0.5e0) - sqrt(0.5e0) * (gx * cos(radians(135e0)) + gy * sin(radians(135e0)))) / sqrt(1 + gx * gx + gy * gy)) * 255, 4) AS shade FROM h WHERE gx IS NOT NULL")
def gr7h(spark, d):
    return G.hillshade(feed(spark, d, "cells")).filter("dzdx IS NOT NULL").select("row", "col", R("shade", 4).alias("shade"))


@query("gr8_smooth", """SELECT row, col, CASE WHEN v IS NOT NULL THEN round(s / w, 5) END AS smooth FROM (SELECT a.row, a.col, a.v, sum(b.v * exp(-((b.row - a.row) * (b.row - a.row) + (b.col - a.col) * (b.col - a.col)) / 4.5e0)) AS s, sum(exp(-((b.row - a.row) * (b.row - a.row) + (b.col - a.col) * (b.col - a.col)) / 4.5e0)) AS w
FROM cells a JOIN cells b ON b.row BETWEEN a.row - 6 AND a.row + 6 AND b.col BETWEEN a.col - 6 AND a.col + 6 AND b.v IS NOT NULL GROUP BY a.row, a.col, a.v)""")
def gr8(spark, d):
    return G.smooth(feed(spark, d, "cells"), 1.5).select("row", "col", R("smooth", 5).alias("smooth"))


_AX = """s AS (SELECT a.row, a.col, sqrt(power(sum(cos(radians(2 * b.v)) * k) / sum(k), 2) + power(sum(sin(radians(2 * b.v)) * k) / sum(k), 2)) AS q FROM axes a JOIN (SELECT * FROM axes) b ON b.row BETWEEN a.row - 4 AND a.row + 4 AND b.col BETWEEN a.col - 4 AND a.col + 4, LATERAL (SELECT exp(-((b.row - a.row) * (b.row - a.row) + (b.col - a.col) * (b.col - a.col)) / 2e0) AS k) GROUP BY a.row, a.col)"""


@query("gr9_smooth_axial", f"""WITH {_AX} SELECT 0 AS grid_id, count(*) AS n, round(count(*) FILTER (q < 0.3e0) * 1e0 / count(*), 6) AS low_share, CASE WHEN count(*) FILTER (q < 0.3e0) * 1e0 / count(*) > 1e-1 THEN 'AXIAL_COHERENCE_TOO_LOW' END AS blocker FROM s""")
def gr9(spark, d):
    df = feed(spark, d, "axes").withColumn("qx", F.cos(F.radians(F.col("v") * 2))).withColumn("qy", F.sin(F.radians(F.col("v") * 2)))
    return rounded(G.axial_quality(G.smooth_axial(df, 1.0), 0.3, 0.1), ["low_share"])


@query("gr10_axial_jumps", """SELECT grid_id, count(*) AS pairs, round(quantile_cont(j, 0.95), 6) AS p95, max(j) AS max, round(count(*) FILTER (j > 45) * 1e0 / count(*), 6) AS share_over FROM (SELECT a.grid_id, least(abs(a.v - b.v), 180 - abs(a.v - b.v)) AS j FROM axes a JOIN axes b ON (b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col = a.col)) GROUP BY grid_id""")
def gr10(spark, d):
    return rounded(G.axial_jumps(feed(spark, d, "axes"), 45.0), ["p95", "share_over"])


_SECOND = """x AS (SELECT a.row, a.col, a.gx, a.gy, CASE WHEN a.gx IS NOT NULL THEN coalesce((r.gx - l.gx) / 2, r.gx - a.gx, a.gx - l.gx) END AS gxx, CASE WHEN a.gy IS NOT NULL THEN coalesce((d.gy - u.gy) / 2, d.gy - a.gy, a.gy - u.gy) END AS gyy FROM grads a LEFT JOIN grads r ON r.row = a.row AND r.col = a.col + 1 LEFT JOIN grads l ON l.row = a.row AND l.col = a.col - 1 LEFT JOIN grads d ON d.row = a.row + 1 AND d.col = a.col LEFT JOIN grads u ON u.row = a.row - 1 AND u.col = a.col)"""


@query("gr11_critical_indicators", f"""WITH {_SECOND} SELECT 0 AS grid_id, count(*) AS n, round(count(*) FILTER (sqrt(gx * gx + gy * gy) < 3.0001e0) / count(*), 6) AS flat_share, round(count(*) FILTER (abs(gxx + gyy) > 2.0001e0) / count(*), 6) AS bent_share,
concat_ws(',', CASE WHEN count(*) FILTER (sqrt(gx * gx + gy * gy) < 3.0001e0) / count(*) > 5e-2 THEN 'GRADIENT_BELOW_FLOOR' END, CASE WHEN count(*) FILTER (abs(gxx + gyy) > 2.0001e0) / count(*) > 5e-2 THEN 'CURVATURE_ABOVE_LIMIT' END) AS blockers FROM x WHERE gxx IS NOT NULL AND gyy IS NOT NULL""")
def gr11(spark, d):
    return rounded(G.critical_indicators(feed(spark, d, "cells"), 3.0001, 2.0001, 0.05), ["flat_share", "bent_share"])


@query("gr12_normal_spacing", """SELECT grid_id, count(*) AS n, round(quantile_cont(s, 0.05), 6) AS p05, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.95), 6) AS p95, round(count(*) FILTER (abs(s - 3e-1) > 3.00001e-2) / count(*), 6) AS outside_share FROM (SELECT grid_id, 1.5e0 / sqrt(gx * gx + gy * gy) AS s FROM grads WHERE sqrt(gx * gx + gy * gy) > 1e-9) GROUP BY grid_id""")
def gr12(spark, d):
    return rounded(G.normal_spacing(feed(spark, d, "cells"), 1.5, 0.3, 0.100001 / 1.0), ["p05", "p50", "p95", "outside_share"])


@query("gr13_spacing_from_levels", """WITH i AS (SELECT level AS lo, lead(level) OVER (ORDER BY level) AS up FROM levels) SELECT p.row, p.col, CASE WHEN grad > 1e-6 THEN round((up - lo) / grad, 6) END AS spacing, grad <= 1e-6 AS infinite FROM phases p JOIN i ON up IS NOT NULL AND least(greatest(phi, (SELECT min(level) FROM levels)), (SELECT max(level) FROM levels) - 1e-9) >= lo AND least(greatest(phi, (SELECT min(level) FROM levels)), (SELECT max(level) FROM levels) - 1e-9) < up""")
def gr13(spark, d):
    out = G.spacing_from_levels(feed(spark, d, "phases"), feed(spark, d, "levels"))
    inf = F.col("spacing") == float("inf")
    return out.select("row", "col", F.when(~inf, R("spacing")).alias("spacing"), inf.alias("infinite"))


@query("gr14_orientation_sweep", """WITH p AS (SELECT a * 5e0 AS theta, l * 3e0 AS lam, cos(radians(a * 5e0)) AS bx, sin(radians(a * 5e0)) AS by_ FROM (SELECT unnest(range(0, 36)) AS a), (SELECT unnest(range(-2, 3)) AS l)),
m AS (SELECT field, theta, lam, bx, by_, gx / 100 AS gx, gy / 100 AS gy, -by_ + lam * gx / 100 AS px, bx + lam * gy / 100 AS py FROM field_mask JOIN grads USING (grid_id, row, col), p WHERE gx IS NOT NULL AND gy IS NOT NULL),
u AS (SELECT *, sqrt(px * px + py * py) AS mag FROM m), t AS (SELECT *, CASE WHEN mag > 1e-6 THEN -py / mag ELSE 0 END AS tx, CASE WHEN mag > 1e-6 THEN px / mag ELSE 0 END AS ty FROM u),
s AS (SELECT *, abs(gx * tx + gy * ty) * 100 AS along, abs(gx * ty - gy * tx) * 100 AS crossing, degrees(acos(least(1, abs(tx * bx + ty * by_)))) AS turn, 1.5e0 * median(mag) OVER (PARTITION BY field, theta, lam) AS step FROM t)
SELECT field, theta, lam, count(*) AS n, round(quantile_cont(along, 0.5), 5) AS along_p50, round(quantile_cont(along, 0.9), 5) AS along_p90, round(quantile_cont(along, 0.95), 5) AS along_p95, round(max(along), 5) AS along_max, round(quantile_cont(crossing, 0.95), 5) AS cross_p95, round(max(crossing), 5) AS cross_max, round(quantile_cont(turn, 0.95), 4) AS deflection_p95,
round(count(*) FILTER (along > 2.00001e0) * 1e2 / count(*), 6) AS over_target, round(count(*) FILTER (along > 5.00001e0) * 1e2 / count(*), 6) AS over_alert, round(count(*) FILTER (mag < 0.35) * 1e2 / count(*), 6) AS singular, round(max(step), 5) AS level_step,
round(quantile_cont(step / mag, 0.05) FILTER (mag > 1e-6), 5) AS spacing_p05, round(quantile_cont(step / mag, 0.5) FILTER (mag > 1e-6), 5) AS spacing_p50, round(quantile_cont(step / mag, 0.95) FILTER (mag > 1e-6), 5) AS spacing_p95, round(count(*) FILTER (mag <= 1e-6 OR abs(step / mag / 1.5e0 - 1) > 1.00001e-1) * 1e2 / count(*), 6) AS spacing_outside FROM s GROUP BY field, theta, lam""")
def gr14(spark, d):
    cells = G.mask_cells(feed(spark, d, "cells"), feed(spark, d, "field_edges")).join(G.gradient(feed(spark, d, "cells")), G.RC).withColumns({"gx": F.col("gx") / 100, "gy": F.col("gy") / 100})
    out = G.orientation_sweep(cells, [5.0 * a for a in range(36)], [-6.0, -3.0, 0.0, 3.0, 6.0], 1.5, 2.00001, 5.00001, 0.100001)
    five = [f"along_{k}" for k in ("p50", "p90", "p95", "max")] + ["cross_p95", "cross_max", "level_step"] + [f"spacing_{k}" for k in ("p05", "p50", "p95")]
    return rounded(rounded(rounded(out, five, 5), ["deflection_p95"], 4), ["over_target", "over_alert", "singular", "spacing_outside"])


@query("gr15_sample", """WITH p AS (SELECT *, CAST(floor(x - 5e-1) AS INT) AS c0, CAST(floor(y - 5e-1) AS INT) AS r0, x - 5e-1 - floor(x - 5e-1) AS fx, y - 5e-1 - floor(y - 5e-1) AS fy FROM probes), o AS (SELECT p.*, r0 + a AS row, c0 + b AS col, (CASE a WHEN 1 THEN fy ELSE 1 - fy END) * (CASE b WHEN 1 THEN fx ELSE 1 - fx END) AS w FROM p, (VALUES (0), (1)) x(a), (VALUES (0), (1)) z(b)),
h AS (SELECT o.*, k.v FROM o LEFT JOIN cells k ON k.row = o.row AND k.col = o.col), g AS (SELECT point_id, max(v) FILTER (row = floor(y) AND col = floor(x)) AS nearest, sum(v * w) / sum(w) FILTER (v IS NOT NULL) AS b FROM h GROUP BY point_id) SELECT point_id, round(nearest, 6) AS nearest, CASE WHEN nearest IS NOT NULL THEN round(b, 6) END AS bilinear FROM g""")
def gr15(spark, d):
    return rounded(G.sample(feed(spark, d, "cells"), feed(spark, d, "probes")), ["nearest", "bilinear"])


_IDW = """g AS (SELECT CAST(floor(y) AS INT) + a AS row, CAST(floor(x) AS INT) + b AS col, z, sqrt(power(x - (floor(x) + b + 5e-1), 2) + power(y - (floor(y) + a + 5e-1), 2)) AS dist FROM ground, (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS b))"""


@query("gr16_idw_grid", f"WITH {_IDW} SELECT row, col, round(sum(z / greatest(dist, 1e-9)) / sum(1 / greatest(dist, 1e-9)), 5) AS v, count(*) AS n FROM g WHERE dist <= 1.5e0 GROUP BY row, col")
def gr16(spark, d):
    return rounded(G.idw_grid(feed(spark, d, "ground"), 1.0), ["v"], 5)


@query("gr16_density_grid", f"WITH {_IDW} SELECT row, col, count(*) AS n FROM g WHERE dist <= 1 / sqrt(2e0) GROUP BY row, col")
def gr16d(spark, d):
    return G.density_grid(feed(spark, d, "ground"), 1.0)


@query("gr17_point_profile", """SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, min(classification) AS min_class, max(classification) AS max_class, count(*) FILTER (classification = 2) AS ground, round(avg(returns), 6) AS mean_returns, min(time) AS min_time, max(time) AS max_time, coalesce(bool_or(red <> 0 OR green <> 0 OR blue <> 0), false) AS has_rgb FROM cloud""")
def gr17(spark, d):
    return rounded(G.point_profile(feed(spark, d, "cloud")), ["mean_returns"])


_IN = "m AS (SELECT k.*, f.row IS NOT NULL AS inside FROM cells k LEFT JOIN (SELECT DISTINCT grid_id, row, col FROM field_mask) f USING (grid_id, row, col))"


def _mask(spark, d):
    return G.mask_cells(feed(spark, d, "cells"), feed(spark, d, "field_edges"))


@query("gr18_flow_sensitivity", f"WITH {_IN} SELECT threshold, count(*) FILTER (v >= threshold) AS active, count(*) FILTER (v >= threshold AND inside) AS active_in_fields, round(count(*) FILTER (v >= threshold) * 5e0 / 1000, 6) AS length_km FROM m, (VALUES (9e1), (9.5e1), (1e2), (1.1e2), (1.2e2)) t(threshold) GROUP BY threshold")
def gr18(spark, d):
    return rounded(G.flow_sensitivity(feed(spark, d, "cells"), _mask(spark, d), [90.0, 95.0, 100.0, 110.0, 120.0], 5.0), ["length_km"])


_IDS = "SELECT grid_id, row, col, CAST((row * 3 + col) % 40 AS INT) AS v FROM cells"


@query("gr19_basin_summary", f"WITH {_IN}, b AS (SELECT (row * 3 + col) % 40 AS v, inside FROM m) SELECT count(DISTINCT v) FILTER (v > 0) AS basins, count(DISTINCT v) FILTER (v > 0 AND inside) AS basins_inside, round(count(*) FILTER (v > 0 AND inside) * 1e2 / count(*) FILTER (inside), 6) AS classified_percent FROM b")
def gr19(spark, d):
    return rounded(G.basin_summary(feed(spark, d, _IDS), _mask(spark, d)), ["classified_percent"])


@query("gr19_path_summary", f"WITH {_IN} SELECT count(*) FILTER ((row * 3 + col) % 40 > 0) AS cells, count(*) FILTER ((row * 3 + col) % 40 > 0 AND inside) AS inside, count(*) FILTER ((row * 3 + col) % 40 > 0 AND inside) * 5e0 AS length_m FROM m")
def gr19p(spark, d):
    return G.path_summary(feed(spark, d, _IDS), _mask(spark, d), 5.0)


FEEDS["two_grids"] = """SELECT grid_id, row, col, v FROM cells UNION ALL SELECT grid_id + 1, row, col, v * 1.1e0 - col * 1e-1 FROM cells_b"""


def _picks(k, radius):
    """k rounds: the best of each grid that is left, and what is out of its reach."""
    out = ["""peaks AS (SELECT a.grid_id, a.row, a.col, a.v FROM two_grids a JOIN two_grids b ON b.grid_id = a.grid_id AND b.row BETWEEN a.row - 3 AND a.row + 3 AND b.col BETWEEN a.col - 3 AND a.col + 3 GROUP BY ALL HAVING a.v = max(b.v) AND a.v >= 0.5)""",
        """u AS (SELECT DISTINCT row, col FROM field_mask)""", """rim AS (SELECT a.row, a.col FROM u a JOIN u b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY ALL HAVING count(*) < 9)""",
        """l0 AS (SELECT peaks.* FROM peaks JOIN rim USING (row, col))"""]  # fmt: skip
    for i in range(1, k + 1):
        out.append(f"b{i} AS (SELECT {i} AS rank, * FROM l{i - 1} QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY v DESC, row, col) = 1)")
        out.append(f"l{i} AS (SELECT l.* FROM l{i - 1} l JOIN b{i} b USING (grid_id) WHERE sqrt(power(l.row - b.row, 2) + power(l.col - b.col, 2)) > {radius})")
    return "WITH " + ",\n".join(out) + "\n" + " UNION ALL ".join(f"SELECT rank, grid_id, row, col, round(v, 6) AS v FROM b{i}" for i in range(1, k + 1))


@query("gr20_crossing_candidates", _picks(8, 6))
def gr20(spark, d):
    mask = _mask(spark, d)
    both = mask.unionByName(mask.withColumn("grid_id", F.col("grid_id") + 1))
    return rounded(G.crossing_candidates(feed(spark, d, "two_grids"), both, 8, 6.0), ["v"])


@query("gr21_focal_max", "SELECT a.row, a.col, round(max(b.v), 6) AS focal FROM cells a LEFT JOIN cells b ON b.row BETWEEN a.row - 3 AND a.row + 3 AND b.col BETWEEN a.col - 3 AND a.col + 3 GROUP BY a.row, a.col")
def gr21(spark, d):
    return G.focal_max(feed(spark, d, "cells"), 7).select("row", "col", R("focal").alias("focal"))


@query("gr21_mask_boundary", "WITH u AS (SELECT DISTINCT row, col FROM field_mask) SELECT 0 AS grid_id, a.row, a.col FROM u a JOIN u b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.row, a.col HAVING count(*) < 9")
def gr21b(spark, d):
    return G.mask_boundary(_mask(spark, d))


_ISO = """q AS (SELECT a.row, a.col, a.v AS va, b.v AS vb, d.v AS vd, e.v AS ve FROM cells a JOIN cells b ON b.row = a.row AND b.col = a.col + 1 JOIN cells d ON d.row = a.row + 1 AND d.col = a.col JOIN cells e ON e.row = a.row + 1 AND e.col = a.col + 1 WHERE a.v IS NOT NULL AND b.v IS NOT NULL AND d.v IS NOT NULL AND e.v IS NOT NULL),
t AS (SELECT row, col, 0 AS t, 5e-1 AS x1, 5e-1 AS y1, va AS z1, 1.5e0 AS x2, 5e-1 AS y2, vb AS z2, 5e-1 AS x3, 1.5e0 AS y3, vd AS z3 FROM q UNION ALL SELECT row, col, 1, 1.5e0, 5e-1, vb, 1.5e0, 1.5e0, ve, 5e-1, 1.5e0, vd FROM q),
l AS (SELECT t.*, k * 7e0 + 1e-3 AS level FROM t, LATERAL (SELECT unnest(range(CAST(floor((least(z1, z2, z3) - 1e-3) / 7) AS BIGINT) + 1, CAST(ceil((greatest(z1, z2, z3) - 1e-3) / 7) AS BIGINT))) AS k)),
c AS (SELECT row, col, t, level, x1 + (x2 - x1) * (level - z1) / (z2 - z1) AS x, y1 + (y2 - y1) * (level - z1) / (z2 - z1) AS y FROM l WHERE (z1 - level) * (z2 - level) < 0 UNION ALL SELECT row, col, t, level, x2 + (x3 - x2) * (level - z2) / (z3 - z2), y2 + (y3 - y2) * (level - z2) / (z3 - z2) FROM l WHERE (z2 - level) * (z3 - level) < 0
 UNION ALL SELECT row, col, t, level, x1 + (x3 - x1) * (level - z1) / (z3 - z1), y1 + (y3 - y1) * (level - z1) / (z3 - z1) FROM l WHERE (z1 - level) * (z3 - level) < 0),
s AS (SELECT row, col, t, level, sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2)) AS len FROM c GROUP BY row, col, t, level)"""


@query("gr22_isoline_segments", f"WITH {_ISO} SELECT row, col, t, round(level, 6) AS level, round(len, 6) AS len FROM s")
def gr22(spark, d):
    return G.isoline_segments(feed(spark, d, "cells"), 7.0, 1e-3).select("row", "col", "t", R("level").alias("level"), R("len").alias("len"))


@query("gr23_contour_summary", f"WITH {_ISO}, u AS (SELECT DISTINCT row, col, true AS inside FROM field_mask) SELECT count(*) AS segments, count(*) FILTER (inside) AS inside, count(DISTINCT round(level, 6)) AS levels, round(min(level), 6) AS lowest, round(max(level), 6) AS highest, round(sum(len), 4) AS length, round(sum(len) FILTER (inside), 4) AS length_inside FROM s LEFT JOIN u USING (row, col)")
def gr23(spark, d):
    out = G.contour_summary(G.isoline_segments(feed(spark, d, "cells"), 7.0, 1e-3), _mask(spark, d))
    return rounded(rounded(out, ["lowest", "highest"]), ["length", "length_inside"], 4)


@query("gr24_decimate_mesh", """WITH s AS (SELECT grid_id, max(row) + 1 AS nr, max(col) + 1 AS nc, least(max(row) + 1, 12) AS m, least(max(col) + 1, 12) AS n FROM cells GROUP BY grid_id),
r AS (SELECT grid_id, i * (nr - 1) // (m - 1) AS lo, (i + 1) * (nr - 1) // (m - 1) AS hi FROM s, LATERAL (SELECT unnest(range(0, m - 1)) AS i)), c AS (SELECT grid_id, i * (nc - 1) // (n - 1) AS lo, (i + 1) * (nc - 1) // (n - 1) AS hi FROM s, LATERAL (SELECT unnest(range(0, n - 1)) AS i)),
q AS (SELECT r.grid_id, r.lo, c.lo AS k, (r.hi - r.lo + 1) * (c.hi - c.lo + 1) AS need, count(v) AS n FROM r JOIN c USING (grid_id) LEFT JOIN cells x ON x.grid_id = r.grid_id AND x.row BETWEEN r.lo AND r.hi AND x.col BETWEEN c.lo AND c.hi GROUP BY ALL),
v AS (SELECT count(*) AS n FROM cells x, s WHERE x.grid_id = s.grid_id AND v IS NOT NULL AND row IN (SELECT i * (nr - 1) // (m - 1) FROM (SELECT unnest(range(0, 12)) AS i) WHERE i < m) AND col IN (SELECT i * (nc - 1) // (n - 1) FROM (SELECT unnest(range(0, 12)) AS i) WHERE i < s.n))
SELECT s.grid_id, m AS sampled_rows, s.n AS sampled_cols, v.n AS vertices, 2 * count(*) FILTER (need = q.n) AS triangles, count(*) FILTER (need > q.n) AS omitted_quads FROM s JOIN q USING (grid_id), v GROUP BY s.grid_id, m, s.n, v.n""")
def gr24(spark, d):
    return G.decimate_mesh(feed(spark, d, "cells"), 12)[2]


@query("gr25_grid_components", """WITH RECURSIVE k AS (SELECT field, row, col, row * 100 + col AS id FROM field_mask WHERE (row + col) % 7 <> 0 OR field LIKE 'F2%'), w AS (SELECT field, id, id AS seen, row, col FROM k UNION SELECT w.field, w.id, k.id, k.row, k.col FROM w JOIN k ON k.field = w.field AND abs(k.row - w.row) + abs(k.col - w.col) = 1)
SELECT field, count(DISTINCT low) AS components, CASE WHEN count(DISTINCT low) = 1 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT field, id, min(seen) AS low FROM w GROUP BY field, id) GROUP BY field""")
def gr25(spark, d):
    return G.grid_components(_mask(spark, d).filter("(row + col) % 7 != 0 OR field LIKE 'F2%'"))
