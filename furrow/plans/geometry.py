"""GE1-GE28 over the given tables: lines are orders, vertices their items; rows, fields and strips are made from parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import geometry as G
from furrow.operators import nearest as N
from furrow.plans.feeds import FEEDS, feed, oracle

FEEDS["chains"] = """SELECT line_id, seq, x, y, z, coalesce(sum(step) OVER (PARTITION BY line_id ORDER BY seq), 0) AS chainage FROM (SELECT *, sqrt(power(x - lag(x) OVER (PARTITION BY line_id ORDER BY seq), 2) + power(y - lag(y) OVER (PARTITION BY line_id ORDER BY seq), 2)) AS step FROM steps) q"""
FEEDS["legs"] = """SELECT a.line_id, a.seq, a.x AS x0, a.y AS y0, a.z AS z0, a.chainage AS c0, b.x AS x1, b.y AS y1, b.z AS z1, b.chainage AS c1 FROM chains a JOIN chains b ON a.line_id = b.line_id AND b.seq = a.seq + 1"""
FEEDS["line_ends"] = """SELECT line_id, max(chainage) AS len, count(*) AS n FROM chains GROUP BY line_id HAVING count(*) > 1"""
FEEDS["exclusions"] = """SELECT l_orderkey AS line_id, l_extendedprice / 1e2 AS lo, l_extendedprice / 1e2 + l_quantity AS hi FROM lineitem WHERE l_linenumber % 2 = 1"""
FEEDS["merged_ex"] = """SELECT line_id, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY line_id ORDER BY lo, hi) AS g FROM (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY line_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-9 THEN 0 ELSE 1 END AS fresh FROM exclusions) q) r GROUP BY line_id, g"""
FEEDS["plain_rows"] = """SELECT p_partkey AS line_id, p_partkey % 40 AS group_id, CAST(floor(p_partkey / 4e1) AS BIGINT) % 10 AS level, CASE WHEN p_size % 7 = 0 THEN 3e1 ELSE 0e0 END AS xa, (CAST(floor(p_partkey / 4e1) AS BIGINT) % 10) * 1.5e0 + (p_size % 3) * 5e-2 + CAST(floor(p_partkey / 4e2) AS BIGINT) * 4e2 AS y, CASE WHEN p_size % 5 = 0 THEN 6e1 ELSE 1e2 END AS xb FROM part"""
FEEDS["row_vertices"] = """SELECT line_id, 1 AS seq, xa AS x, y FROM plain_rows UNION ALL SELECT line_id, 2, xb, y FROM plain_rows"""
FEEDS["bent"] = """SELECT s_suppkey AS line_id, s_suppkey % 10 AS group_id, k + 1 AS seq, ((s_suppkey * 7 + k * 13) % 37) * 1e0 AS x, ((s_suppkey * 11 + k * k * 5) % 31) * 1e0 + 3e-1 * k AS y FROM supplier CROSS JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 4) q"""
FEEDS["bent_legs"] = """SELECT a.group_id, a.line_id, a.seq, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM bent a JOIN bent b ON a.line_id = b.line_id AND b.seq = a.seq + 1"""
FEEDS["axes_ge"] = """SELECT s_suppkey AS id, 1 AS seq, s_suppkey * 1e1 AS x0, 0e0 AS y0, s_suppkey * 1e1 AS x1, 5.5e1 AS y1 FROM supplier WHERE s_suppkey % 10 = 4"""
FEEDS["rings"] = """SELECT p_partkey AS feature_id, 0 AS part_no, 0 AS ring, k AS seq, CASE WHEN k IN (0, 3, 4) THEN 0e0 ELSE p_size * 1e1 END AS x, CASE WHEN k IN (0, 1, 4) THEN 0e0 ELSE p_retailprice / 1e1 END AS y FROM part CROSS JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5) q
UNION ALL SELECT p_partkey, 0, 1, k, CASE WHEN k IN (0, 3, 4) THEN 1e0 ELSE 3e0 END, CASE WHEN k IN (0, 1, 4) THEN 1e0 ELSE 2e0 END FROM part CROSS JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5) q WHERE p_partkey % 3 = 0"""
FEEDS["parcels"] = """SELECT s_suppkey AS feature_id, ((s_suppkey * 13 + k * 29) % 50) * 1e0 AS x, ((s_suppkey * 17 + k * k * 7) % 30) * 1e0 AS y FROM supplier CROSS JOIN (SELECT n_nationkey AS k FROM nation) q"""
FEEDS["field_poly"] = """SELECT p_brand AS field, k AS seq, ((k * 37 + CAST(substr(p_brand, 7) AS INT) * 5) % 11) * 0e0 + CASE k WHEN 0 THEN 0e0 WHEN 1 THEN 8e1 + CAST(substr(p_brand, 7) AS INT) WHEN 2 THEN 9.5e1 WHEN 3 THEN 4e1 WHEN 4 THEN 1e1 ELSE 0e0 END AS x, CASE k WHEN 0 THEN 0e0 WHEN 1 THEN 3e0 WHEN 2 THEN 6e1 WHEN 3 THEN 3e1 WHEN 4 THEN 7e1 ELSE 0e0 END AS y
FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 6) q"""
FEEDS["poly_edges"] = """SELECT a.field, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM field_poly a JOIN field_poly b ON a.field = b.field AND b.seq = a.seq + 1"""
FEEDS["strips_ge"] = """SELECT s_suppkey AS strip_id, k, s_suppkey * 2e1 + CASE WHEN k IN (0, 3, 4) THEN 0e0 ELSE 1.2e1 END AS x, CASE WHEN k IN (0, 1, 4) THEN -1e1 ELSE 5e2 END AS y FROM supplier CROSS JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5) q"""
FEEDS["strip_edges"] = """SELECT a.strip_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM strips_ge a JOIN strips_ge b ON a.strip_id = b.strip_id AND b.k = a.k + 1"""
FEEDS["cut_rows"] = """SELECT line_id AS row_id, xa + 5e-1 AS x0, y AS y0, xb + 2.5e-1 AS x1, y + 3e0 AS y1 FROM plain_rows"""
FEEDS["rows_a"] = """SELECT p_partkey AS row_id, 0e0 AS x0, p_partkey * 1.5e0 AS y0, 1e2 AS x1, p_partkey * 1.5e0 + p_size AS y1 FROM part"""
FEEDS["rows_b"] = """SELECT p_partkey AS row_id, 1.1e2 + p_size AS x0, p_partkey * 1.5e0 + 3e0 AS y0, 2.6e2 + p_size * 2 AS x1, p_partkey * 1.5e0 AS y1 FROM part WHERE p_partkey % 4 <> 0"""
FEEDS["links_ge"] = """SELECT a.row_id, sqrt(power(b.x0 - a.x1, 2) + power(b.y0 - a.y1, 2)) AS gap, a.*, b.x0 AS bx, b.y0 AS by_ FROM rows_a a JOIN rows_b b ON a.row_id = b.row_id"""
# rows of some ids in two lines; fields that touch, that leave a lane of two between them, and that lie too far apart, in turn
FEEDS["lines_a"] = """SELECT row_id, row_id * 10 AS line_id, x0, y0, x1, y1 FROM rows_a UNION ALL SELECT row_id, row_id * 10 + 1, x0 + 5e0, y0 + 1e0, x1 - 4e0, y1 + 1e0 FROM rows_a WHERE row_id % 5 = 0"""
FEEDS["lines_b"] = """SELECT row_id, row_id * 10 AS line_id, x0, y0, x1, y1 FROM rows_b UNION ALL SELECT row_id, row_id * 10 + 1, x0 - 5e-1, y0, x1 - 9e1, y1 FROM rows_b WHERE row_id % 7 = 0"""
FEEDS["area_blocks"] = """SELECT DISTINCT CAST(floor(p_partkey * 1.5e0 / 6e1) AS BIGINT) + n_nationkey AS b FROM part CROSS JOIN nation WHERE n_nationkey < 2"""
FEEDS["areas"] = """SELECT b * 10 AS polygon_id, 'a' AS side, -5e0 AS lo_x, b * 6e1 - 1e0 AS lo_y, CASE b % 3 WHEN 0 THEN 1.153e2 WHEN 1 THEN 1.123e2 ELSE 1.1e2 END AS hi_x, b * 6e1 + 5.93e1 AS hi_y FROM area_blocks
UNION ALL SELECT b * 10 + 1, 'b', CASE b % 3 WHEN 0 THEN 1.153e2 WHEN 1 THEN 1.143e2 ELSE 1.177e2 END, b * 6e1 - 1e0, 4e2, b * 6e1 + 5.93e1 FROM area_blocks"""
FEEDS["area_rings"] = """SELECT polygon_id, side, 1 AS ring, 1 AS seq, lo_x AS x, lo_y AS y FROM areas UNION ALL SELECT polygon_id, side, 1, 2, hi_x, lo_y FROM areas UNION ALL SELECT polygon_id, side, 1, 3, hi_x, hi_y FROM areas UNION ALL SELECT polygon_id, side, 1, 4, lo_x, hi_y FROM areas UNION ALL SELECT polygon_id, side, 1, 5, lo_x, lo_y FROM areas"""
FEEDS["reported_areas"] = """SELECT CASE WHEN p_partkey % 29 = 0 THEN -p_partkey ELSE p_partkey END AS feature_id, CASE WHEN p_partkey % 11 = 0 THEN 0e0 ELSE p_size * p_retailprice / 1e4 * (1 + (p_partkey % 9 - 4) * 8e-3) END AS reported_ha FROM part WHERE p_partkey % 13 <> 0"""
# tracks of length 12 over the grid of parts, in five directions
FEEDS["tracks"] = """SELECT line_id, ax, ay, ax + dx AS bx, ay + dy AS by_ FROM (SELECT p_partkey AS line_id, (p_partkey % 43) * 1e0 + 3.3e-1 AS ax, floor(p_partkey / 5e1) + 2.1e-1 AS ay, CASE p_partkey % 5 WHEN 0 THEN 1.2e1 WHEN 1 THEN -1.2e1 WHEN 2 THEN 7.2e0 WHEN 3 THEN 0e0 ELSE 9.6e0 END AS dx, CASE p_partkey % 5 WHEN 0 THEN 0e0 WHEN 1 THEN 0e0 WHEN 2 THEN 9.6e0 WHEN 3 THEN 1.2e1 ELSE -7.2e0 END AS dy FROM part) q"""
FEEDS["slope_cells"] = """SELECT CAST(floor(p_partkey / 5e1) AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col, CASE WHEN p_size = 1 THEN NULL ELSE (p_size - 25) * 2e-3 END AS gx, (p_retailprice - 1000) * 1e-4 AS gy FROM part WHERE p_size <> 1"""
FEEDS["trials_ge"] = """SELECT p_brand AS pair_id, p_partkey AS trial, (p_partkey % 9 - 4) * 1e0 AS delta, (p_partkey % 5) * 3e-1 + p_partkey * 1e-6 AS phase, p_size AS pairs, p_retailprice AS paired_m, (p_partkey % 13) * 1e0 AS median_gap FROM part"""
FEEDS["sides"] = """SELECT s_suppkey AS id, 1 AS seq, s_suppkey % 5 AS field, s_suppkey * 3e1 AS x0, 0e0 AS y0, s_suppkey * 3e1 + 2.5e1 AS x1, (s_suppkey % 3) * 1e0 AS y1 FROM supplier"""
FEEDS["sides_b"] = """SELECT s_suppkey AS id, 1 AS seq, s_suppkey % 4 AS field, s_suppkey * 3e1 AS x0, 8e0 AS y0, s_suppkey * 3e1 + 2.5e1 AS x1, 4e0 + (s_suppkey % 6) AS y1 FROM supplier"""

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


@query("ge1_chainage", "SELECT line_id, max(round(chainage, 6)) AS length, count(*) AS vertices FROM chains GROUP BY line_id")
def ge1(spark, d):
    return rounded(G.line_lengths(feed(spark, d, "steps")).select("line_id", "length", "vertices"), ["length"])


_ST = """n AS (SELECT line_id, len, greatest(2, CAST(ceil(len / 150) AS BIGINT) + 1) AS n FROM line_ends WHERE len > 0), st AS (SELECT line_id, len, least(len, len * i / (n - 1)) AS station FROM n, LATERAL (SELECT unnest(range(0, n)) AS i)),
p AS (SELECT s.line_id, station, x0 + (x1 - x0) * t AS x, y0 + (y1 - y0) * t AS y, z0 + (z1 - z0) * t AS z FROM (SELECT s.line_id, s.station, l.*, (s.station - c0) / (c1 - c0) AS t FROM st s JOIN legs l ON l.line_id = s.line_id AND c1 > c0 AND c0 <= s.station AND (s.station < c1 OR (s.station = len AND c1 = len))) s)"""


@query("ge2_resample", f"WITH {_ST} SELECT line_id, round(station, 7) AS station, round(x, 8) AS x, round(y, 8) AS y, round(z, 8) AS z FROM p")
def ge2(spark, d):
    return rounded(G.resample(feed(spark, d, "steps"), 150.0).select("line_id", "station", "x", "y", "z"), ["x", "y", "z"], 8).withColumn("station", R("station", 7))


@query("ge3_z_at", """SELECT line_id, station, CASE WHEN abs(z0 + (z1 - z0) * (least(station, len) - c0) / (c1 - c0)) < 1e-9 THEN 0e0 ELSE round(z0 + (z1 - z0) * (least(station, len) - c0) / (c1 - c0), 6) END AS z FROM (SELECT e.line_id, s.station, e.len, l.* FROM line_ends e, (VALUES (7e1), (3e2), (5e3)) s(station), legs l WHERE l.line_id = e.line_id AND c1 > c0 AND c0 <= least(station, len) AND (least(station, len) < c1 OR c1 = len AND station >= len)) q""".replace("e.line_id, s.station, e.len, l.*", "e.line_id AS lid, s.station, e.len, l.*").replace("SELECT line_id, station", "SELECT lid AS line_id, station", 1))
def ge3(spark, d):
    st = feed(spark, d, "SELECT DISTINCT line_id FROM steps").withColumn("station", F.explode(F.array(F.lit(70.0), F.lit(300.0), F.lit(5000.0))))
    return G.z_at(feed(spark, d, "steps"), st).select("line_id", "station", R("z").alias("z"))


_PD = lambda px, py, a: f"sqrt(power({px} - ({a}x0 + greatest(0, least(1, (({px} - {a}x0) * ({a}x1 - {a}x0) + ({py} - {a}y0) * ({a}y1 - {a}y0)) / (({a}x1 - {a}x0) * ({a}x1 - {a}x0) + ({a}y1 - {a}y0) * ({a}y1 - {a}y0)))) * ({a}x1 - {a}x0)), 2) + power({py} - ({a}y0 + greatest(0, least(1, (({px} - {a}x0) * ({a}x1 - {a}x0) + ({py} - {a}y0) * ({a}y1 - {a}y0)) / (({a}x1 - {a}x0) * ({a}x1 - {a}x0) + ({a}y1 - {a}y0) * ({a}y1 - {a}y0)))) * ({a}y1 - {a}y0)), 2))"
_CR = lambda a, b, c: f"((({b[0]}) - ({a[0]})) * (({c[1]}) - ({a[1]})) - (({b[1]}) - ({a[1]})) * (({c[0]}) - ({a[0]})))"
_A0, _A1, _B0, _B1 = ("a.x0", "a.y0"), ("a.x1", "a.y1"), ("b.x0", "b.y0"), ("b.x1", "b.y1")
_PROPER = f"({_CR(_A0, _A1, _B0)} * {_CR(_A0, _A1, _B1)} < -1e-9 AND {_CR(_B0, _B1, _A0)} * {_CR(_B0, _B1, _A1)} < -1e-9)"
_SEGD = f"CASE WHEN {_PROPER} THEN 0 ELSE least({_PD('a.x0', 'a.y0', 'b.')}, {_PD('a.x1', 'a.y1', 'b.')}, {_PD('b.x0', 'b.y0', 'a.')}, {_PD('b.x1', 'b.y1', 'a.')}) END"
_LIVE = "WHERE (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) > 0"


@query("ge4_segments_within", f"""SELECT a.line_id AS a_id, a.seq AS a_seq, b.line_id AS b_id, b.seq AS b_seq, round({_SEGD}, 6) AS dist FROM (SELECT * FROM bent_legs {_LIVE}) a, (SELECT * FROM bent_legs {_LIVE}) b WHERE a.line_id % 2 = 0 AND b.line_id % 2 = 1 AND {_SEGD} <= 0.5001""")
def ge4(spark, d):
    s = feed(spark, d, f"SELECT line_id AS id, seq, x0, y0, x1, y1 FROM bent_legs {_LIVE}")
    return G.copied_segments_within(s.filter("id % 2 = 0"), s.filter("id % 2 = 1"), 0.5001, 5.0, digits=6)


@query("ge5_barrier_spans", """WITH h AS (SELECT l.line_id, l.c0, l.c1, l.x0, l.x1, a.x0 AS bx FROM legs l JOIN axes_ge a ON greatest(l.x0, l.x1) > a.x0 - 2 AND least(l.x0, l.x1) < a.x0 + 2 WHERE abs(l.x1 - l.x0) > 1e-9), s AS (SELECT line_id, c0 + (c1 - c0) * greatest(0, least((bx - 2 - x0) / (x1 - x0), (bx + 2 - x0) / (x1 - x0))) AS lo, c0 + (c1 - c0) * least(1, greatest((bx - 2 - x0) / (x1 - x0), (bx + 2 - x0) / (x1 - x0))) AS hi FROM h),
m AS (SELECT line_id, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(f) OVER (PARTITION BY line_id ORDER BY lo, hi) AS g FROM (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY line_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-6 THEN 0 ELSE 1 END AS f FROM s WHERE hi > lo + 1e-9)) GROUP BY line_id, g)
SELECT line_id, count(*) AS spans, round(sum(hi - lo), 4) AS inside_m FROM m GROUP BY line_id""")
def ge5(spark, d):
    v = feed(spark, d, "SELECT line_id, seq, x, y FROM steps")
    return G.barrier_spans(v, feed(spark, d, "axes_ge"), 2.0).groupBy("line_id").agg(F.count(F.lit(1)).alias("spans"), R(F.sum(F.col("hi") - F.col("lo")), 4).alias("inside_m"))


@query("ge6_merge_intervals", "SELECT line_id, round(lo, 6) AS lo, round(hi, 6) AS hi FROM merged_ex")
def ge6(spark, d):
    return rounded(G.merge_intervals(feed(spark, d, "exclusions"), ["line_id"]), ["lo", "hi"])


@query("ge7_split_lines", """WITH i AS (SELECT m.line_id, greatest(lo, 0) AS lo, least(hi, len) AS hi, len FROM merged_ex m JOIN line_ends e ON e.line_id = m.line_id WHERE least(hi, len) > greatest(lo, 0)), g AS (SELECT line_id, coalesce(lag(hi) OVER w, 0) AS lo, lo AS hi FROM i WINDOW w AS (PARTITION BY line_id ORDER BY lo) UNION ALL SELECT line_id, max(hi), max(len) FROM i GROUP BY line_id UNION ALL SELECT line_id, 0, len FROM line_ends WHERE line_id NOT IN (SELECT line_id FROM i)),
k AS (SELECT line_id, count(*) FILTER (hi - lo >= 20) AS pieces, coalesce(sum(hi - lo) FILTER (hi - lo >= 20), 0) AS kept, coalesce(sum(hi - lo) FILTER (hi - lo < 20), 0) AS disc FROM g WHERE hi > lo + 1e-9 GROUP BY line_id), r AS (SELECT line_id, sum(hi - lo) AS rem FROM i GROUP BY line_id)
SELECT e.line_id, coalesce(pieces, 0) AS pieces, round(coalesce(kept, 0), 5) AS kept_m, round(coalesce(disc, 0), 5) AS discarded_m, round(coalesce(rem, 0), 5) AS removed, true AS balanced FROM line_ends e LEFT JOIN k ON k.line_id = e.line_id LEFT JOIN r ON r.line_id = e.line_id""")
def ge7(spark, d):
    lengths = feed(spark, d, "SELECT line_id, len AS length FROM line_ends")
    kept, _, bal = G.split_lines(lengths, feed(spark, d, "merged_ex"), 20.0)
    n = kept.groupBy("line_id").agg(F.count(F.lit(1)).alias("pieces"))
    out = bal.join(n, "line_id", "left").fillna(0, ["pieces"])
    return rounded(out.select("line_id", "pieces", "kept_m", "discarded_m", "removed", "balanced"), ["kept_m", "discarded_m", "removed"], 5)


@query("ge7_pieces", """WITH i AS (SELECT m.line_id, greatest(lo, 0) AS lo, least(hi, len) AS hi, len FROM merged_ex m JOIN line_ends e ON e.line_id = m.line_id WHERE least(hi, len) > greatest(lo, 0)), g AS (SELECT line_id, coalesce(lag(hi) OVER w, 0) AS lo, lo AS hi, lag(hi) OVER w IS NOT NULL AS cut0, true AS cut1 FROM i WINDOW w AS (PARTITION BY line_id ORDER BY lo) UNION ALL SELECT line_id, max(hi), max(len), true, false FROM i GROUP BY line_id UNION ALL SELECT line_id, 0, len, false, false FROM line_ends WHERE line_id NOT IN (SELECT line_id FROM i)),
k AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY lo) AS n FROM g WHERE hi - lo >= 20)
SELECT line_id || ':W' || lpad(CAST(n AS VARCHAR), 4, '0') AS piece_id, CAST(n AS INT) AS piece, round(lo, 5) AS lo, round(hi, 5) AS hi, CASE WHEN cut0 THEN 'WORK_TERMINATION_REQUIRED_BY_BARRIER' ELSE 'SOURCE_TERMINATION_PRESERVED' END AS start_termination, CASE WHEN cut1 THEN 'WORK_TERMINATION_REQUIRED_BY_BARRIER' ELSE 'SOURCE_TERMINATION_PRESERVED' END AS end_termination,
CASE WHEN cut0 THEN 'PROHIBITED_BARRIER' ELSE 'SOURCE_STATUS_PRESERVED' END AS start_maneuver, CASE WHEN cut1 THEN 'PROHIBITED_BARRIER' ELSE 'SOURCE_STATUS_PRESERVED' END AS end_maneuver FROM k""")
def ge7p(spark, d):
    kept, _, _ = G.split_lines(feed(spark, d, "SELECT line_id, len AS length FROM line_ends"), feed(spark, d, "merged_ex"), 20.0)
    return rounded(kept.select("piece_id", "piece", "lo", "hi", *[f"{e}_{n}" for n in ("termination", "maneuver") for e in ("start", "end")]), ["lo", "hi"], 5)


@query("ge8_line_metrics", f"""WITH {_ST}, e AS (SELECT line_id, arg_min(z, station) AS za, arg_max(z, station) AS zb, max(station) AS len FROM p GROUP BY line_id), g AS (SELECT p.line_id, (CASE WHEN zb > za THEN 1 ELSE -1 END) * (z - lag(z) OVER w) / (station - lag(station) OVER w) * 100 AS g, abs(za - zb) / len * 100 AS eg FROM p JOIN e ON e.line_id = p.line_id WINDOW w AS (PARTITION BY p.line_id ORDER BY station))
SELECT line_id, round(quantile_cont(abs(g), 0.5), 5) AS grade_p50, round(quantile_cont(abs(g), 0.95), 5) AS grade_p95, round(max(abs(g)), 5) AS grade_max, round(max(eg), 5) AS end_grade, round(count(*) FILTER (abs(g) > 2.00001e0) / count(*), 6) AS over_target, round(count(*) FILTER (abs(g) > 5.00001e0) / count(*), 6) AS over_alert, round(count(*) FILTER (g < -1e-9) / count(*), 6) AS adverse FROM g WHERE g IS NOT NULL GROUP BY line_id""")
def ge8(spark, d):
    out = G.line_metrics(feed(spark, d, "steps"), 150.0, 2.00001, 5.00001)
    return rounded(rounded(out, ["grade_p50", "grade_p95", "grade_max", "end_grade"], 5), ["over_target", "over_alert", "adverse"])


@query("ge8_cross_grades", """WITH h AS (SELECT line_id, abs(gy * tx - gx * ty) * 100 AS cr, abs(gx * tx + gy * ty) * 100 AS al FROM (SELECT line_id, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my, (x1 - x0) / sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) AS tx, (y1 - y0) / sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) AS ty
FROM (SELECT line_id, ax + (bx - ax) * i / 6 AS x0, ay + (by_ - ay) * i / 6 AS y0, ax + (bx - ax) * (i + 1) / 6 AS x1, ay + (by_ - ay) * (i + 1) / 6 AS y1 FROM tracks, (SELECT unnest(range(0, 6)) AS i))) q JOIN slope_cells k ON k.row = CAST(floor(my) AS INT) AND k.col = CAST(floor(mx) AS INT))
SELECT line_id, count(*) AS pieces, round(quantile_cont(cr, 0.5), 5) AS cross_p50, round(quantile_cont(cr, 0.95), 5) AS cross_p95, round(max(cr), 5) AS cross_max, round(quantile_cont(al, 0.95), 5) AS along_p95, round(max(al), 5) AS along_max FROM h GROUP BY line_id""")
def ge8c(spark, d):
    v = feed(spark, d, "SELECT line_id, 1 AS seq, ax AS x, ay AS y FROM tracks UNION ALL SELECT line_id, 2, bx, by_ FROM tracks")
    return rounded(G.cross_grades(v, feed(spark, d, "slope_cells"), 2.1), ["cross_p50", "cross_p95", "cross_max", "along_p95", "along_max"], 5)


@query("ge9_reversals", """SELECT line_id, count(*) FILTER (s <> p) AS reversals FROM (SELECT line_id, sign(g) AS s, lag(sign(g)) OVER (PARTITION BY line_id ORDER BY seq) AS p FROM (SELECT line_id, seq, (z1 - z0) / (c1 - c0) * 100 AS g FROM legs WHERE c1 > c0) q WHERE abs(g) > 0.2000001) r GROUP BY line_id""")
def ge9(spark, d):
    return G.reversals(feed(spark, d, "SELECT line_id, seq, (z1 - z0) / (c1 - c0) * 1e2 AS grade FROM legs WHERE c1 > c0"), 0.2000001)


@query("ge10_grade_alerts", """WITH p AS (SELECT line_id, min(c1 - c0) AS least, count(*) + 1 AS n, max(c1) AS len, max(abs((z1 - z0) / nullif(c1 - c0, 0))) * 100 AS mx FROM legs GROUP BY line_id), o AS (SELECT line_id, seq, c0, c1, seq - row_number() OVER (PARTITION BY line_id ORDER BY seq) AS g FROM legs WHERE c1 > c0 AND abs(z1 - z0) / (c1 - c0) * 100 > 1.0000001), a AS (SELECT line_id, sum(c1 - c0) AS alert, count(DISTINCT g) AS k FROM o GROUP BY line_id),
s AS (SELECT DISTINCT line_id FROM steps) SELECT s.line_id AS row_id, CASE WHEN n >= 2 AND least > 0 THEN round(len, 5) END AS length, CASE WHEN n >= 2 AND least > 0 AND s.line_id % 5 <> 0 THEN round(coalesce(alert, 0), 5) END AS alert_length, CASE WHEN n >= 2 AND least > 0 AND s.line_id % 5 <> 0 THEN coalesce(k, 0) END AS intervals,
CASE WHEN n IS NULL OR least <= 0 THEN 'INVALID_SOURCE_PROFILE' WHEN s.line_id % 5 = 0 THEN 'NOT_EVALUATED' WHEN k > 0 THEN 'SAMPLED_EXCEEDANCE' ELSE 'NO_SAMPLED_EXCEEDANCE_NOT_APPROVED' END AS status FROM s LEFT JOIN p ON p.line_id = s.line_id LEFT JOIN a ON a.line_id = s.line_id""")
def ge10(spark, d):
    prof = feed(spark, d, "SELECT line_id AS row_id, seq, chainage, z AS elevation FROM chains")
    refs = feed(spark, d, "SELECT DISTINCT line_id AS row_id, CASE WHEN line_id % 5 = 0 THEN NULL ELSE 1.0000001e0 END AS threshold FROM steps")
    return rounded(G.grade_alerts(prof, refs).drop("max_grade"), ["length", "alert_length"], 5)


@query("ge11_axis_profile", """WITH v AS (SELECT line_id, abs(z - 5) AS off, abs(z - lag(z) OVER w) / nullif(chainage - lag(chainage) OVER w, 0) * 100 AS g FROM chains WINDOW w AS (PARTITION BY line_id ORDER BY seq)) SELECT line_id, round(quantile_cont(off, 0.95), 6) AS off_p95, round(quantile_cont(g, 0.95), 4) AS grade_p95 FROM v GROUP BY line_id""")
def ge11(spark, d):
    out = G.axis_profile(feed(spark, d, "steps"), feed(spark, d, "SELECT DISTINCT line_id, 5e0 AS target_z FROM steps"))
    return out.select("line_id", R("off_p95").alias("off_p95"), R("grade_p95", 4).alias("grade_p95"))


_RAD = """r AS (SELECT line_id, CASE WHEN a > 1e-9 AND b > 1e-9 AND c > 1e-9 AND k > 1e-9 THEN a * b * c / (2 * k) END AS r FROM (SELECT line_id, sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) AS a, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS b, sqrt(power(x2 - x0, 2) + power(y2 - y0, 2)) AS c, abs((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) AS k FROM (SELECT line_id, lag(x) OVER w AS x0, lag(y) OVER w AS y0, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM bent WINDOW w AS (PARTITION BY line_id ORDER BY seq)) q) t)"""


@query("ge12_curvature", f"WITH {_RAD} SELECT line_id, round(min(r), 5) AS min_radius, round(quantile_cont(r, 0.05), 5) AS p05, round(quantile_cont(r, 0.5), 5) AS p50, count(*) FILTER (r < 9.0001) AS violations, CASE WHEN count(*) FILTER (r < 9.0001) > 0 THEN 'FAIL_STATIC_PATH_RADIUS' ELSE 'PASS_STATIC_PATH_RADIUS' END AS verdict FROM r GROUP BY line_id")
def ge12(spark, d):
    return rounded(G.curvature(feed(spark, d, "bent"), 9.0001), ["min_radius", "p05", "p50"], 5)


_REL = f"""rel AS (SELECT a.group_id, a.line_id AS a_id, b.line_id AS b_id, max(CASE WHEN {_PROPER} THEN 3 WHEN abs({_CR(_A0, _A1, _B0)}) <= 1e-9 AND abs({_CR(_A0, _A1, _B1)}) <= 1e-9 AND (CASE WHEN abs(a.x1 - a.x0) >= abs(a.y1 - a.y0) THEN least(greatest(a.x0, a.x1), greatest(b.x0, b.x1)) - greatest(least(a.x0, a.x1), least(b.x0, b.x1)) ELSE least(greatest(a.y0, a.y1), greatest(b.y0, b.y1)) - greatest(least(a.y0, a.y1), least(b.y0, b.y1)) END) > 1e-6 THEN 2 ELSE 1 END) AS k
FROM (SELECT * FROM bent_legs {_LIVE}) a JOIN (SELECT * FROM bent_legs {_LIVE}) b ON a.group_id = b.group_id AND a.line_id < b.line_id WHERE {_SEGD} <= 1e-9 GROUP BY a.group_id, a.line_id, b.line_id)"""


@query("ge12_resampled_curvature", f"""WITH {_ST}, q AS (SELECT line_id, lag(x) OVER w AS x0, lag(y) OVER w AS y0, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY line_id ORDER BY station)),
t AS (SELECT line_id, sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) AS a, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS b, sqrt(power(x2 - x0, 2) + power(y2 - y0, 2)) AS c, abs((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) AS k FROM q), r AS (SELECT line_id, CASE WHEN a > 1e-9 AND b > 1e-9 AND c > 1e-9 AND k > 1e-9 THEN a * b * c / (2 * k) END AS r FROM t)
SELECT line_id, CASE WHEN min(r) < 1e7 THEN round(min(r), 3) END AS min_radius, count(*) FILTER (r < 90.001) AS violations, CASE WHEN count(*) FILTER (r < 90.001) > 0 THEN 'FAIL_STATIC_PATH_RADIUS' ELSE 'PASS_STATIC_PATH_RADIUS' END AS verdict FROM r GROUP BY line_id""")
def ge12r(spark, d):
    out = G.resampled_curvature(feed(spark, d, "steps"), 150.0, 90.001)
    # a radius of a hundred million metres is a straight line that rounding bends
    return out.select("line_id", F.when(F.col("min_radius") < 1e7, R("min_radius", 3)).alias("min_radius"), "violations", "verdict")


@query("ge13_row_relations", f"WITH {_REL} SELECT group_id, a_id, b_id, CASE k WHEN 3 THEN 'CROSSING' WHEN 2 THEN 'OVERLAP' ELSE 'TOUCH' END AS relation FROM rel")
def ge13(spark, d):
    return G.row_relations(feed(spark, d, "bent"), ["group_id"], 5.0)


@query("ge13_relation_counts", f"""WITH {_REL}, both_ AS (SELECT a_id AS line_id, k FROM rel UNION ALL SELECT b_id, k FROM rel), n AS (SELECT line_id, count(*) FILTER (k = 3) AS x, count(*) FILTER (k = 2) AS o, count(*) FILTER (k = 1) AS t FROM both_ GROUP BY line_id)
SELECT s.line_id, coalesce(x, 0) AS crossings, coalesce(o, 0) AS overlaps, coalesce(t, 0) AS touches, concat_ws(',', CASE WHEN x > 0 THEN 'ROW_CROSSING' END, CASE WHEN o > 0 THEN 'ROW_OVERLAP' END, CASE WHEN t > 0 THEN 'ROW_TOUCH' END) AS codes FROM (SELECT DISTINCT line_id FROM bent) s LEFT JOIN n ON n.line_id = s.line_id""")
def ge13c(spark, d):
    bent = feed(spark, d, "bent")
    return G.relation_counts(G.relations_of_lines(bent, ["group_id"], 5.0), bent.select("line_id"))


@query("ge14_simplicity", f"""WITH x AS (SELECT a.line_id, count(*) AS n FROM (SELECT * FROM bent_legs {_LIVE}) a JOIN (SELECT * FROM bent_legs {_LIVE}) b ON a.line_id = b.line_id AND b.seq > a.seq + 1 WHERE {_SEGD} <= 1e-9 GROUP BY a.line_id), e AS (SELECT line_id, arg_min(x, seq) = arg_max(x, seq) AND arg_min(y, seq) = arg_max(y, seq) AS ring FROM bent GROUP BY line_id) SELECT e.line_id, ring, coalesce(n, 0) AS self_intersections FROM e LEFT JOIN x ON x.line_id = e.line_id""")
def ge14(spark, d):
    return G.simplicity(feed(spark, d, "bent"), cell=5.0)


_ENDS = """en AS (SELECT line_id, 'START' AS which, xa AS x, y FROM plain_rows UNION ALL SELECT line_id, 'END', xb, y FROM plain_rows), dist AS (SELECT *, abs(x - 60) AS o, least(abs(x), abs(x - 100)) AS h FROM en),
k AS (SELECT line_id, which, CASE WHEN least(o, h) > 0.25 THEN 'INTERNAL_UNSUPPORTED_ENDPOINT' WHEN o <= h + 1e-6 THEN 'UNCLASSIFIED_OBSTACLE_EDGE' ELSE 'HEADLAND_WORK_EDGE' END AS kind, round(CASE WHEN o <= h + 1e-6 THEN o ELSE h END, 6) AS distance,
CASE WHEN least(o, h) > 0.25 THEN 'UNSUPPORTED_INTERNAL_TERMINATION' WHEN o <= h + 1e-6 THEN 'WORK_TERMINATION_REQUIRED_BY_OBSTACLE' ELSE 'WORK_TERMINATION_GEOMETRICALLY_SUPPORTED' END AS termination,
CASE WHEN least(o, h) > 0.25 THEN 'PROHIBITED_NO_MANEUVER_SURFACE' WHEN o <= h + 1e-6 THEN 'NOT_AUTHORIZED_UNCLASSIFIED_OBSTACLE' ELSE 'NOT_EVALUATED_MISSING_FLEET_ENVELOPE' END AS maneuver FROM dist)"""


def _edges(spark, d):
    """Edges that run past every row, however many there are."""
    top = "(SELECT max(y) + 1e2 FROM plain_rows)"
    return feed(spark, d, f"SELECT 'HEADLAND' AS surface, 1 AS id, 1 AS seq, 0e0 AS x0, -1e2 AS y0, 0e0 AS x1, {top} AS y1 UNION ALL SELECT 'HEADLAND', 2, 1, 1e2, -1e2, 1e2, {top} UNION ALL SELECT 'OBSTACLE', 3, 1, 6e1, -1e2, 6e1, {top}")


@query("ge15_classify_endpoints", f"WITH {_ENDS} SELECT * FROM k")
def ge15(spark, d):
    return rounded(G.classify_endpoints(feed(spark, d, "row_vertices"), _edges(spark, d), 0.25), ["distance"])


@query("ge15_line_diagnostics", f"""WITH {_REL}, {_RAD}, v AS (SELECT line_id, arg_min(y, seq) AS ya, arg_max(y, seq) AS yb, arg_min(x, seq) = arg_max(x, seq) AND arg_min(y, seq) = arg_max(y, seq) AS ring FROM bent GROUP BY line_id), en AS (SELECT line_id, abs(y) AS h, abs(y - 30) AS o FROM (SELECT line_id, ya AS y FROM v UNION ALL SELECT line_id, yb FROM v)),
e AS (SELECT line_id, bool_or(least(h, o) > 4.01) AS loose, bool_or(h <= 4.01 AND NOT o <= h + 1e-6) AS head, bool_or(o <= 4.01 AND o <= h + 1e-6) AS obst FROM en GROUP BY line_id), rv AS (SELECT line_id, count(*) FILTER (r < 9.0001) AS n FROM r GROUP BY line_id), sx AS (SELECT DISTINCT a.line_id FROM (SELECT * FROM bent_legs {_LIVE}) a JOIN (SELECT * FROM bent_legs {_LIVE}) b ON a.line_id = b.line_id AND b.seq > a.seq + 1 WHERE {_SEGD} <= 1e-9),
b2 AS (SELECT a_id AS line_id, k FROM rel UNION ALL SELECT b_id, k FROM rel), n AS (SELECT line_id, count(*) FILTER (k = 3) AS x, count(*) FILTER (k = 2) AS ov, count(*) FILTER (k = 1) AS t FROM b2 GROUP BY line_id),
q AS (SELECT v.line_id, concat_ws(',', CASE WHEN ring THEN 'CLOSED_LOOP_WITHOUT_APPROVED_ENTRY' END, CASE WHEN loose THEN 'INTERNAL_UNSUPPORTED_ENDPOINT' END, CASE WHEN rv.n > 0 THEN 'MINIMUM_RADIUS_VIOLATION' END, CASE WHEN x > 0 THEN 'ROW_CROSSING' END, CASE WHEN ov > 0 THEN 'ROW_OVERLAP' END, CASE WHEN t > 0 THEN 'ROW_TOUCH' END, CASE WHEN sx.line_id IS NOT NULL THEN 'SELF_INTERSECTION' END) AS blockers,
concat_ws(',', CASE WHEN head THEN 'HEADLAND_MANEUVER_NOT_VERIFIED' END, CASE WHEN obst THEN 'OBSTACLE_ACCESS_AND_MANEUVER_NOT_VERIFIED' END) AS warnings FROM v JOIN e ON e.line_id = v.line_id LEFT JOIN rv ON rv.line_id = v.line_id LEFT JOIN sx ON sx.line_id = v.line_id LEFT JOIN n ON n.line_id = v.line_id)
SELECT *, CASE WHEN blockers = '' THEN 'PASS' ELSE 'FAIL' END AS topology, CASE WHEN blockers = '' THEN 'E0_GEOMETRY_ONLY_PENDING_FLEET_AND_MANEUVER_REVIEW' ELSE 'FAIL_GEOMETRY' END AS continuity FROM q""")
def ge15l(spark, d):
    bent = feed(spark, d, "bent")
    ends = G.classify_endpoints(bent, _bent_edges(spark, d), 4.01)
    out = G.line_diagnostics(ends, G.simplicity(bent, cell=5.0), G.relations_of_lines(bent, ["group_id"], 5.0), G.curvature(bent, 9.0001), bent.select("line_id"))
    return out.drop("crossings", "overlaps", "touches")


@query("ge16_adjacent_spacing")
def ge16(spark, d):
    out = G.adjacent_spacing(feed(spark, d, "row_vertices"), feed(spark, d, "SELECT line_id, group_id, level + 100 * CAST(floor(line_id / 4e2) AS BIGINT) AS level FROM plain_rows"), 1.5)
    return rounded(out, ["p05", "p50", "p95", "outside_share"])


@query("ge17_ray_spacing", """WITH s AS (SELECT a.line_id, a.group_id, min(b.y - a.y) AS dist FROM plain_rows a LEFT JOIN plain_rows b ON b.group_id = a.group_id AND b.level = a.level + 1 AND b.y >= a.y AND b.y - a.y <= 6 AND 50.5 BETWEEN b.xa AND b.xb GROUP BY a.line_id, a.group_id)
SELECT group_id, count(*) AS samples, count(*) FILTER (dist IS NULL) AS unpaired, round(quantile_cont(abs(dist - 1.5), 0.95), 6) AS error_p95, round(count(*) FILTER (dist IS NULL OR abs(dist - 1.5) > 0.0501) * 100 / count(*), 6) AS outside_percent FROM s GROUP BY group_id""")
def ge17(spark, d):
    samples = feed(spark, d, "SELECT line_id AS sample_id, group_id, level, 5.05e1 AS x, y, 0e0 AS nx, 1e0 AS ny FROM plain_rows")
    rows = feed(spark, d, "SELECT group_id, level, xa AS x0, y AS y0, xb AS x1, y AS y1 FROM plain_rows")
    return rounded(G.ray_spacing(samples, rows, 1.5, 0.0501), ["error_p95", "outside_percent"])


def _bent_edges(spark, d):
    return feed(spark, d, "SELECT 'HEADLAND' AS surface, 1 AS id, 1 AS seq, -1e0 AS x0, 0e0 AS y0, 4e1 AS x1, 0e0 AS y1 UNION ALL SELECT 'OBSTACLE', 2, 1, -1e0, 3e1, 4e1, 3e1")


def _summary(spark, d):
    bent = feed(spark, d, "bent")
    groups = bent.select("line_id", "group_id").distinct()
    edges = _bent_edges(spark, d)
    return G.continuity_summary(G.classify_endpoints(bent, edges, 4.01), G.simplicity(bent, cell=5.0), G.relations_of_lines(bent, ["group_id"], 5.0), G.curvature(bent, 9.0001), groups)


_CONT = f"""{_REL}, {_RAD}, v AS (SELECT line_id, group_id, arg_min(y, seq) AS ya, arg_max(y, seq) AS yb FROM bent GROUP BY line_id, group_id), en AS (SELECT group_id, ya AS y FROM v UNION ALL SELECT group_id, yb FROM v),
e AS (SELECT group_id, count(*) FILTER (abs(y) <= 4.01 AND NOT (abs(y - 30) <= 4.01)) AS h, count(*) FILTER (abs(y - 30) <= 4.01) AS o, count(*) FILTER (abs(y) > 4.01 AND abs(y - 30) > 4.01) AS u FROM en GROUP BY group_id), rr AS (SELECT group_id, count(*) FILTER (k = 3) AS c, count(*) FILTER (k = 2) AS ov, count(*) FILTER (k = 1) AS t FROM rel GROUP BY group_id),
rv AS (SELECT v.group_id, count(*) FILTER (r < 9.0001) AS n FROM r JOIN v ON v.line_id = r.line_id GROUP BY v.group_id)"""


@query("ge18_continuity_summary", f"WITH {_CONT} SELECT e.group_id, h AS headland_ends, o AS obstacle_ends, u AS unsupported_ends, coalesce(c, 0) AS crossings, coalesce(ov, 0) AS overlaps, coalesce(t, 0) AS touches, n AS radius_violations FROM e LEFT JOIN rr USING (group_id) JOIN rv USING (group_id)")
def ge18(spark, d):
    return _summary(spark, d).select("group_id", "headland_ends", "obstacle_ends", "unsupported_ends", "crossings", "overlaps", "touches", "radius_violations")


@query("ge19_family_gate", f"""WITH {_CONT}, sx AS (SELECT DISTINCT a.group_id FROM (SELECT * FROM bent_legs {_LIVE}) a JOIN (SELECT * FROM bent_legs {_LIVE}) b ON a.line_id = b.line_id AND b.seq > a.seq + 1 WHERE {_SEGD} <= 1e-9),
g AS (SELECT e.group_id, concat_ws(',', CASE WHEN u > 0 THEN 'INTERNAL_UNSUPPORTED_ENDPOINT' END, CASE WHEN n > 0 THEN 'MINIMUM_RADIUS_VIOLATION' END, CASE WHEN c > 0 THEN 'ROW_CROSSING' END, CASE WHEN t > 0 THEN 'ROW_TOUCH' END, CASE WHEN sx.group_id IS NOT NULL THEN 'SELF_INTERSECTION' END) AS blockers FROM e LEFT JOIN rr USING (group_id) JOIN rv USING (group_id) LEFT JOIN sx ON sx.group_id = e.group_id)
SELECT group_id, blockers, CASE WHEN blockers = '' THEN 'GEOMETRIC_PASS' ELSE 'GEOMETRIC_FAIL' END AS verdict FROM g""")
def ge19(spark, d):
    return G.family_gate(_summary(spark, d))


@query("ge20_polygon_measures", """SELECT p_partkey AS feature_id, round((p_size * 10 * p_retailprice / 10 - CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END) / 1e4, 8) AS area_ha, round(2 * (p_size * 10 + p_retailprice / 10) + CASE WHEN p_partkey % 3 = 0 THEN 6 ELSE 0 END, 6) AS perimeter, 1 AS parts, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS holes FROM part""")
def ge20(spark, d):
    return rounded(rounded(G.polygon_measures(feed(spark, d, "rings").withColumnRenamed("part_no", "part")), ["area_ha"], 8), ["perimeter"])


@query("ge20_area_agreement", """WITH m AS (SELECT p_partkey AS feature_id, (p_size * 10 * p_retailprice / 10 - CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END) / 1e4 AS area_ha FROM part), j AS (SELECT *, (area_ha - reported_ha) * 100 / nullif(reported_ha, 0) AS off FROM m FULL JOIN reported_areas USING (feature_id))
SELECT feature_id, round(area_ha, 8) AS area_ha, round(reported_ha, 8) AS reported_ha, round(off, 5) + 0e0 AS difference_percent, CASE WHEN area_ha IS NULL THEN 'NO_GEOMETRY' WHEN reported_ha IS NULL THEN 'NOT_REPORTED' WHEN reported_ha <= 0 THEN 'REPORTED_NOT_POSITIVE' WHEN abs(off) <= 2.00001 THEN 'AGREES' ELSE 'DIFFERS' END AS area_status FROM j""")
def ge20a(spark, d):
    out = G.area_agreement(G.polygon_measures(feed(spark, d, "rings").withColumnRenamed("part_no", "part")), feed(spark, d, "reported_areas"), 2.00001)
    return rounded(rounded(out, ["area_ha", "reported_ha"], 8), ["difference_percent"], 5)


# directions of all pairs of vertices, which contain those of the hull's sides
_BOX = """u AS (SELECT DISTINCT feature_id, x, y FROM parcels), t AS (SELECT DISTINCT a.feature_id, atan2(b.y - a.y, b.x - a.x) AS t FROM u a JOIN u b ON a.feature_id = b.feature_id AND (a.x < b.x OR (a.x = b.x AND a.y < b.y))), b AS (SELECT t.feature_id, t.t, max(x * cos(t.t) + y * sin(t.t)) - min(x * cos(t.t) + y * sin(t.t)) AS l, max(y * cos(t.t) - x * sin(t.t)) - min(y * cos(t.t) - x * sin(t.t)) AS w FROM t JOIN u ON u.feature_id = t.feature_id GROUP BY t.feature_id, t.t),
r AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY round(l * w, 6), round(least(l, w), 6)) AS rn, CASE WHEN l >= w THEN degrees(t) ELSE degrees(t) + 90 END AS deg FROM b)"""


@query("ge21_oriented_extent", f"WITH {_BOX} SELECT feature_id, round(l * w, 5) AS area, round(least(l, w), 5) AS width, round(greatest(l, w), 5) AS length, round(deg - 180 * floor(deg / 180), 4) AS axis_deg, round(p, 5) AS projection_width FROM r JOIN (SELECT feature_id, max(x * cos(radians(3e1)) + y * sin(radians(3e1))) - min(x * cos(radians(3e1)) + y * sin(radians(3e1))) AS p FROM parcels GROUP BY feature_id) q USING (feature_id) WHERE rn = 1")
def ge21(spark, d):
    v = feed(spark, d, "parcels")
    out = G.oriented_extent(v).join(G.projection_width(v, F.lit(30.0)), "feature_id")
    return rounded(rounded(out, ["area", "width", "length", "projection_width"], 5), ["axis_deg"], 4)


@query("ge22_filter_blocks", """SELECT field, component, row_number() OVER (PARTITION BY field ORDER BY area DESC, component) AS number, concat_ws(',', CASE WHEN area < 9 THEN 'AREA_BELOW_NINE_CELLS' END, CASE WHEN width < 2 THEN 'WIDTH_BELOW_MINIMUM' END) AS reasons, NOT (area < 9 OR width < 2) AS kept FROM (SELECT p_brand AS field, p_partkey AS component, p_size % 30 AS area, p_partkey % 5 AS width FROM part)""")
def ge22(spark, d):
    comp = feed(spark, d, "SELECT p_brand AS field, p_partkey AS component, p_size % 30 AS area, p_partkey % 5 AS width FROM part")
    return G.filter_blocks(comp, 1.0, 1.0).select("field", "component", "number", "reasons", "kept")


@query("ge23_clip_lattice", """WITH k AS (SELECT field, k, x0 + (x1 - x0) * (k * 1.5e0 + 0.7e0 - y0) / (y1 - y0) AS u FROM poly_edges, (SELECT unnest(range(0, 60)) AS k) WHERE y0 <> y1 AND least(y0, y1) <= k * 1.5e0 + 0.7e0 AND k * 1.5e0 + 0.7e0 < greatest(y0, y1)), n AS (SELECT *, row_number() OVER (PARTITION BY field, k ORDER BY u) AS n, lead(u) OVER (PARTITION BY field, k ORDER BY u) AS hi FROM k)
SELECT field, k, CAST((n + 1) / 2 AS INT) AS piece, round(u, 6) AS lo, round(hi, 6) AS hi FROM n WHERE n % 2 = 1 AND hi - u >= 8""")
def ge23(spark, d):
    return rounded(G.clip_lattice(feed(spark, d, "poly_edges"), 0.0, 1.5, 0.7), ["lo", "hi"])


@query("ge24_strip_clip", """WITH b AS (SELECT strip_id, min(x) AS xa, max(x) AS xb, max(y) AS yb FROM strips_ge GROUP BY strip_id), p AS (SELECT row_id, strip_id, greatest(0, (xa - x0) / (x1 - x0), 0) AS t, least(1, (xb - x0) / (x1 - x0), (yb - y0) / (y1 - y0)) AS u, sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) AS len FROM cut_rows, b WHERE y0 < yb)
, k AS (SELECT row_id, (u - t) * len AS m FROM p WHERE (u - t) * len >= 1)
SELECT count(*) AS pieces, round(sum(m), 3) AS total, round(max(m), 5) AS max, round(quantile_cont(m, 0.05), 5) AS p05, round(quantile_cont(m, 0.5), 5) AS p50, round(quantile_cont(m, 0.95), 5) AS p95, (SELECT count(*) FROM (SELECT row_id FROM k GROUP BY row_id HAVING count(*) > 1)) AS split_rows FROM k""")
def ge24(spark, d):
    _, out = G.clip_to_strips(feed(spark, d, "cut_rows"), feed(spark, d, "strip_edges"), 1.0)
    return rounded(rounded(out, ["total"], 3), ["max", "p05", "p50", "p95"], 5)


# boxes of a field clip a connector to stretches of its length, and the stretches of both fields are merged
_LINKS = """pr AS (SELECT a.row_id, a.line_id AS a_line, b.line_id AS b_line, i AS a_end, j AS b_end, CASE i WHEN 0 THEN a.x0 ELSE a.x1 END AS ax, CASE i WHEN 0 THEN a.y0 ELSE a.y1 END AS ay, CASE j WHEN 0 THEN b.x0 ELSE b.x1 END AS bx, CASE j WHEN 0 THEN b.y0 ELSE b.y1 END AS by_, sqrt(power(a.x1 - a.x0, 2) + power(a.y1 - a.y0, 2)) AS a_length, sqrt(power(b.x1 - b.x0, 2) + power(b.y1 - b.y0, 2)) AS b_length FROM lines_a a JOIN lines_b b USING (row_id), (VALUES (0), (1)) p(i), (VALUES (0), (1)) q(j)),
g AS (SELECT *, sqrt(power(ax - bx, 2) + power(ay - by_, 2)) AS gap FROM pr), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY gap, a_line, b_line, a_end, b_end) AS rn FROM g) WHERE rn = 1 AND gap <= 45.00001),
d AS (SELECT n.row_id, min(CASE WHEN side = 'b' THEN sqrt(power(greatest(lo_x - ax, 0, ax - hi_x), 2) + power(greatest(lo_y - ay, 0, ay - hi_y), 2)) END) AS da, min(CASE WHEN side = 'a' THEN sqrt(power(greatest(lo_x - bx, 0, bx - hi_x), 2) + power(greatest(lo_y - by_, 0, by_ - hi_y), 2)) END) AS db FROM n, areas GROUP BY n.row_id),
cl AS (SELECT row_id, greatest(0, CASE WHEN bx <> ax THEN least((lo_x - ax) / (bx - ax), (hi_x - ax) / (bx - ax)) ELSE 0 END, CASE WHEN by_ <> ay THEN least((lo_y - ay) / (by_ - ay), (hi_y - ay) / (by_ - ay)) ELSE 0 END) AS t0, least(1, CASE WHEN bx <> ax THEN greatest((lo_x - ax) / (bx - ax), (hi_x - ax) / (bx - ax)) ELSE 1 END, CASE WHEN by_ <> ay THEN greatest((lo_y - ay) / (by_ - ay), (hi_y - ay) / (by_ - ay)) ELSE 1 END) AS t1 FROM n, areas WHERE (bx <> ax OR ax BETWEEN lo_x AND hi_x) AND (by_ <> ay OR ay BETWEEN lo_y AND hi_y)),
st AS (SELECT *, coalesce(max(t1) OVER (PARTITION BY row_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM cl WHERE t0 <= t1), cov AS (SELECT row_id, max(t0 - so_far) <= 1e-9 AND max(t1) >= 1 - 1e-9 AS whole FROM st GROUP BY row_id),
con AS (SELECT n.*, degrees(asin(least(1, 24 / gap))) AS angle, (row_id % 17) * 5e-1 AS grade FROM n JOIN d USING (row_id) JOIN cov USING (row_id) WHERE da <= 15.5 AND db <= 15.5 AND whole)"""


def _connections(spark, d):
    area = lambda side: F.col("side") == side
    rings = feed(spark, d, "area_rings")
    edges = lambda side: N.ring_edges(rings.filter(area(side)).drop("side"))
    return G.infer_connections(feed(spark, d, "lines_a"), feed(spark, d, "lines_b"), edges("a"), edges("b"), 45.00001)


@query("ge25_connections", f"WITH {_LINKS} SELECT row_id, a_line, b_line, round(gap, 6) AS gap, a_end, b_end, round(a_length, 6) AS a_length, round(b_length, 6) AS b_length, round(angle, 6) AS angle FROM con")
def ge25(spark, d):
    return rounded(_connections(spark, d), ["gap", "angle", "a_length", "b_length"])


_FIVE = ", ".join(f"round(quantile_cont({v}, {p}), 5) AS {v}_{k}" for v in ("gap", "angle", "grade") for k, p in G.FIVE.items())


@query("ge26_connection_summary", f"WITH {_LINKS} SELECT count(*) AS pairs, 2 * count(*) AS segments, count(*) FILTER (grade > 5) AS over_alert, 2e1 * count(*) AS turn_seconds, round(coalesce(sum(gap), 0), 4) AS gap_total, round(coalesce(sum(gap), 0) / nullif(2e1 * count(*), 0) * 3.6e0, 6) AS break_even_kmh, {_FIVE} FROM con")
def ge26(spark, d):
    con = _connections(spark, d).withColumn("grade", F.col("row_id") % 17 * 0.5)
    out = rounded(G.connection_summary(con, 20.0, 5.0), [f"{v}_{k}" for v in ("gap", "angle", "grade") for k in G.FIVE], 5)
    return rounded(rounded(out, ["gap_total"], 4), ["break_even_kmh"])


@query("ge26_speed_cases", f"WITH {_LINKS} SELECT speed, count(*) AS pairs, round(sum(gap / (speed / 3.6e0)) / 60, 5) AS minutes, round(sum(20 - gap / (speed / 3.6e0)) / 60, 5) AS net_minutes, count(*) FILTER (20 > gap / (speed / 3.6e0)) AS gaining FROM con, (VALUES (4e0), (6e0), (8e0)) s(speed) GROUP BY speed")
def ge26s(spark, d):
    return rounded(G.speed_cases(_connections(spark, d), [4.0, 6.0, 8.0], 20.0), ["minutes", "net_minutes"], 5)


@query("ge26_length_cases", f"WITH {_LINKS} SELECT min_length, count(*) FILTER (least(a_length, b_length) >= min_length) AS pairs, 2 * count(*) FILTER (least(a_length, b_length) >= min_length) AS segments, round(coalesce(sum(a_length + b_length) FILTER (least(a_length, b_length) >= min_length), 0) / 1e3, 6) AS paired_km, round(coalesce(sum(gap) FILTER (least(a_length, b_length) >= min_length), 0) / 1e3, 6) AS gap_km FROM con, (VALUES (0e0), (1.02e2), (1.6e2), (9e2)) s(min_length) GROUP BY min_length")
def ge26l(spark, d):
    return rounded(G.length_cases(_connections(spark, d), [0.0, 102.0, 160.0, 900.0]), ["paired_km", "gap_km"])


@query("ge27_rank_trials", """SELECT trial, row_number() OVER (PARTITION BY pair_id ORDER BY pairs DESC, paired_m DESC, median_gap, abs(delta), phase, delta) AS rank FROM trials_ge""")
def ge27(spark, d):
    return G.rank_trials(feed(spark, d, "trials_ge")).select("trial", "rank")


# a point at t on a's edge is within r of b's: ends, crossings with the circles round b's ends and with b's line moved by r, those of them that are near
_AT = "(a.x0 + (a.x1 - a.x0) * t)", "(a.y0 + (a.y1 - a.y0) * t)"
_ROOT = lambda p, q, s: f"(-((a.x0 - {p}) * (a.x1 - a.x0) + (a.y0 - {q}) * (a.y1 - a.y0)) {s} sqrt(greatest(0, power((a.x0 - {p}) * (a.x1 - a.x0) + (a.y0 - {q}) * (a.y1 - a.y0), 2) - (power(a.x1 - a.x0, 2) + power(a.y1 - a.y0, 2)) * (power(a.x0 - {p}, 2) + power(a.y0 - {q}, 2) - power(5.0001, 2))))) / (power(a.x1 - a.x0, 2) + power(a.y1 - a.y0, 2))"
_OFF = lambda n: f"((b.x1 - b.x0) * (a.y{n} - b.y0) - (b.y1 - b.y0) * (a.x{n} - b.x0)) / sqrt(power(b.x1 - b.x0, 2) + power(b.y1 - b.y0, 2))"
_CUTS = ", ".join(["0", "1"] + [_ROOT(f"b.x{n}", f"b.y{n}", s) for n in (0, 1) for s in "+-"] + [f"({s}5.0001 - {_OFF(0)}) / nullif({_OFF(1)} - {_OFF(0)}, 0)" for s in ("", "-")])


@query("ge28_interface", f"""WITH m AS (SELECT a.field AS a_field, b.field AS b_field, a.id, b.id AS bid, degrees(atan2(a.y1 - a.y0, a.x1 - a.x0)) AS turn, sqrt(power(a.x1 - a.x0, 2) + power(a.y1 - a.y0, 2)) AS len, {_SEGD} AS dist, list_filter([{_CUTS}], lambda t: t >= 0 AND t <= 1 AND {_PD(*_AT, 'b.')} <= 5.0001 + 1e-7) AS ts FROM sides a, sides_b b WHERE {_SEGD} <= 20.0001),
i AS (SELECT a_field, b_field, id, list_min(ts) * len AS lo, list_max(ts) * len AS hi FROM m WHERE len(ts) > 0), j AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY a_field, b_field, id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM i), k AS (SELECT *, sum(fresh) OVER (PARTITION BY a_field, b_field, id ORDER BY lo, hi) AS g FROM j),
s AS (SELECT a_field, b_field, sum(hi - lo) AS near_m FROM (SELECT a_field, b_field, id, g, min(lo) AS lo, max(hi) AS hi FROM k GROUP BY ALL) GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY a_field, b_field ORDER BY round(dist, 9), id, bid) AS rn FROM m)
SELECT a_field, b_field, round(dist, 6) AS min_dist, id AS near_a, bid AS near_b, round(turn - 180 * floor(turn / 180), 6) AS direction, round(coalesce(near_m, 0), 5) AS near_m FROM n LEFT JOIN s USING (a_field, b_field) WHERE rn = 1""")
def ge28(spark, d):
    return rounded(rounded(G.interface(feed(spark, d, "sides"), feed(spark, d, "sides_b"), 20.0001, 5.0001), ["min_dist", "direction"]), ["near_m"], 5)
