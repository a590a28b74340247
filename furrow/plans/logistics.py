"""LO1-LO9, GA1-GA6 over the given tables: runs are orders, sites are suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import graph as A
from furrow.operators import logistics as L
from furrow.operators import nearest as N
from furrow.plans.feeds import FEEDS, feed, oracle

FEEDS["run_segments"] = """SELECT l_orderkey AS run_id, l_linenumber AS sequence, l_partkey * 1000 + l_suppkey AS segment_id, l_quantity AS mass_t, l_extendedprice / 1e2 AS length_m FROM lineitem"""
FEEDS["mass_rows"] = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 1e2 AS length_m, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 0e0 ELSE l_quantity * 2 END AS yield_t_ha FROM lineitem"""
FEEDS["sites_lo"] = """SELECT s_suppkey AS site_id, CASE WHEN s_suppkey % 13 = 5 THEN NULL ELSE s_acctbal END AS capacity_t, CASE WHEN s_suppkey % 11 = 3 THEN -1e0 ELSE (s_suppkey % 7) * 1e2 END AS penalty, (s_suppkey % 10) * 1e1 AS x, floor(s_suppkey / 1e1) * 1e1 AS y FROM supplier"""
FEEDS["site_hits"] = """SELECT s_suppkey AS site_id, CASE WHEN s_suppkey % 6 = 0 THEN 'POWER_LINE' ELSE 'EXCLUSION' END AS kind FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'EXCLUSION' FROM supplier WHERE s_suppkey % 12 = 0"""
FEEDS["demand"] = """SELECT o_orderkey AS demand_id, (o_custkey % 97) * 1e0 AS x, (o_orderkey % 89) * 1e0 + 2.5e-1 AS y, 1e0 + o_custkey % 20 AS mass_t FROM orders"""
FEEDS["loads"] = """SELECT demand_id, x, y, mass_t, CASE WHEN mass_t >= 20 THEN 'FULL' ELSE 'PARTIAL' END AS kind FROM demand"""
FEEDS["open_sites"] = """SELECT site_id, capacity_t, penalty, x, y FROM sites_lo WHERE capacity_t > 0 AND penalty >= 0"""
FEEDS["few_sites"] = """SELECT site_id, capacity_t, penalty, x, y FROM sites_lo WHERE site_id IN (2, 17, 34, 51, 68, 85, 97)"""
FEEDS["cost_rows"] = """SELECT demand_id, mass_t, site_id, sqrt(power(d.x - s.x, 2) + power(d.y - s.y, 2)) AS dist FROM demand d, few_sites s"""
FEEDS["cost_gaps"] = """SELECT demand_id, mass_t, site_id, CASE WHEN (demand_id + site_id) % 5 < 2 OR demand_id % 50 = 0 AND site_id > 40 THEN NULL ELSE dist END AS dist FROM cost_rows"""
FEEDS["few_subsets"] = """SELECT CAST(a.site_id AS VARCHAR(20)) AS subset_id, 1 AS size, a.site_id AS m1, a.site_id AS m2, a.site_id AS m3 FROM few_sites a UNION ALL SELECT concat(a.site_id, ',', b.site_id), 2, a.site_id, b.site_id, b.site_id FROM few_sites a JOIN few_sites b ON a.site_id < b.site_id
UNION ALL SELECT concat(a.site_id, ',', b.site_id, ',', c.site_id), 3, a.site_id, b.site_id, c.site_id FROM few_sites a JOIN few_sites b ON a.site_id < b.site_id JOIN few_sites c ON b.site_id < c.site_id"""
FEEDS["roads_lo"] = """SELECT l_orderkey * 10 + l_linenumber AS line_id, max(l_quantity) * 1e1 AS length_m FROM lineitem GROUP BY l_orderkey, l_linenumber"""
FEEDS["removed_lo"] = """SELECT line_id, 0e0 AS lo, length_m / 4 AS hi FROM roads_lo WHERE line_id % 3 = 0"""
FEEDS["road_nodes"] = """SELECT c_custkey AS n, CAST(floor(c_custkey / 2e0) AS BIGINT) AS m, 1e0 + c_nationkey AS w FROM customer WHERE c_custkey % 97 <> 1 AND c_custkey > 0"""
FEEDS["chords"] = """SELECT c_custkey AS n, c_custkey + 7 AS m, 3e0 + c_nationkey AS w FROM customer WHERE c_custkey % 5 = 0 AND c_custkey + 7 <= (SELECT max(c_custkey) FROM customer)"""
FEEDS["road_graph"] = """SELECT n AS a, m AS b, w AS weight FROM road_nodes UNION ALL SELECT n, m, w FROM chords"""
FEEDS["needs_ga"] = """SELECT s_suppkey AS a, CAST(floor(s_suppkey / 3e0) AS BIGINT) AS b FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT s_suppkey, s_suppkey - 5 FROM supplier WHERE s_suppkey % 20 = 5"""
FEEDS["street"] = """SELECT s_suppkey AS segment_id, (s_suppkey % 9) * 1e1 AS x0, (s_suppkey % 4) * 2e1 + floor(s_suppkey / 3.6e1) * 8e1 AS y0, (s_suppkey % 9) * 1e1 + 2e1 AS x1, (s_suppkey % 4) * 2e1 + floor(s_suppkey / 3.6e1) * 8e1 AS y1 FROM supplier"""
FEEDS["blocks"] = """SELECT segment_id AS polygon_id, x0 + 6.37e0 AS lo_x, y0 + 1.21e0 AS lo_y, x0 + 13.61e0 AS hi_x, y0 + 2.83e0 AS hi_y FROM street WHERE segment_id % 3 <> 1"""
FEEDS["block_rings"] = """SELECT polygon_id, 1 AS ring, 1 AS seq, lo_x AS x, lo_y AS y FROM blocks UNION ALL SELECT polygon_id, 1, 2, hi_x, lo_y FROM blocks UNION ALL SELECT polygon_id, 1, 3, hi_x, hi_y FROM blocks UNION ALL SELECT polygon_id, 1, 4, lo_x, hi_y FROM blocks UNION ALL SELECT polygon_id, 1, 5, lo_x, lo_y FROM blocks"""
FEEDS["stops_ga"] = """SELECT segment_id, 4e0 + segment_id % 3 * 1e0 AS station FROM street WHERE segment_id % 4 = 1"""

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


@query("lo1_segment_mass", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN yield_t_ha > 0 THEN round(yield_t_ha * length_m * 12 / 10000, 8) END AS mass_t, CASE WHEN coalesce(yield_t_ha, 0) <= 0 THEN 'YIELD_MISSING_OR_NOT_POSITIVE' END AS reject_reason FROM mass_rows""")
def lo1(spark, d):
    return rounded(L.segment_mass(feed(spark, d, "mass_rows"), 12.0), ["mass_t"], 8).drop("length_m", "yield_t_ha")


@query("lo2_load_events", """WITH s AS (SELECT *, sum(mass_t) OVER (PARTITION BY run_id ORDER BY sequence, segment_id, mass_t ROWS UNBOUNDED PRECEDING) AS m1, row_number() OVER (PARTITION BY run_id ORDER BY sequence DESC, segment_id DESC, mass_t DESC) AS back FROM run_segments)
SELECT run_id, k, 'FULL' AS kind, segment_id, round((k * 4e1 - (m1 - mass_t)) / mass_t * length_m, 6) AS station_m, 4e1 AS mass_t FROM s, LATERAL (SELECT unnest(range(CAST(floor((m1 - mass_t) / 40) AS BIGINT) + 1, CAST(floor(m1 / 40) AS BIGINT) + 1)) AS k)
UNION ALL SELECT run_id, CAST(floor(m1 / 40) AS BIGINT) + 1, 'PARTIAL', segment_id, round(length_m, 6), m1 - 40 * floor(m1 / 40) FROM s WHERE back = 1 AND m1 - 40 * floor(m1 / 40) > 0""")
def lo2(spark, d):
    return rounded(L.load_events(feed(spark, d, "run_segments"), 40.0), ["station_m"])


@query("lo3_road_metrics", """SELECT sum(length_m) AS original_m, sum(CASE WHEN line_id % 3 = 0 THEN length_m / 4 ELSE 0 END) AS removed_m, sum(CASE WHEN line_id % 3 = 0 THEN length_m * 3 / 4 ELSE length_m END) AS allowed_m, count(*) FILTER (line_id % 9 = 0) AS power_lines, sum(length_m / 4) FILTER (line_id % 9 = 0) AS power_m FROM roads_lo""")
def lo3(spark, d):
    return L.road_metrics(feed(spark, d, "roads_lo"), feed(spark, d, "removed_lo"), feed(spark, d, "removed_lo").filter("line_id % 9 = 0"))


@query("lo4_candidate_eligibility", """SELECT site_id, concat_ws(',', CASE WHEN site_id % 6 = 0 THEN 'INTERSECTS_POWER_LINE_BARRIER' WHEN site_id % 3 = 0 THEN 'INTERSECTS_EXCLUSION' END, CASE WHEN coalesce(capacity_t, 0) <= 0 THEN 'CAPACITY_MISSING_OR_NOT_POSITIVE' END, CASE WHEN penalty < 0 THEN 'PENALTY_NEGATIVE' END) AS reasons,
site_id % 3 <> 0 AND coalesce(capacity_t, 0) > 0 AND penalty >= 0 AS eligible FROM sites_lo""")
def lo4(spark, d):
    return L.candidate_eligibility(feed(spark, d, "sites_lo"), feed(spark, d, "site_hits")).select("site_id", "reasons", "eligible")


_NEAR = "cost_all AS (SELECT demand_id, mass_t, kind, site_id, sqrt(power(d.x - s.x, 2) + power(d.y - s.y, 2)) AS dist FROM loads d, open_sites s), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY demand_id ORDER BY dist, site_id) AS rn FROM cost_all) WHERE rn = 1)"


@query("lo5_assign_nearest", f"WITH {_NEAR} SELECT demand_id, kind, mass_t, site_id, round(dist, 6) AS dist, round(mass_t * dist, 6) AS tonne_m FROM n")
def lo5(spark, d):
    return rounded(L.assign_nearest(feed(spark, d, "loads"), feed(spark, d, "open_sites"), 8.0), ["dist", "tonne_m"])


@query("lo6_score_subsets", """SELECT subset_id, size, round(sum(mass_t * dist) + max(fixed), 4) AS objective FROM (SELECT subset_id, size, demand_id, mass_t, min(dist) AS dist, max(f) AS fixed FROM few_subsets JOIN cost_rows c ON c.site_id IN (m1, m2, m3) JOIN (SELECT s.subset_id AS sid, sum(penalty) AS f FROM few_subsets s JOIN few_sites t ON t.site_id IN (m1, m2, m3) GROUP BY s.subset_id) p ON p.sid = subset_id GROUP BY subset_id, size, demand_id, mass_t) GROUP BY subset_id, size""")
def lo6(spark, d):
    sites = feed(spark, d, "few_sites")
    cost = L.costs(feed(spark, d, "demand"), sites)
    return rounded(L.score_subsets(cost, L.subsets(sites.select("site_id"), 3), sites.select("site_id", "penalty")), ["objective"], 4)


@query("lo7_coverage_score", """WITH r AS (SELECT 20 * max(dist) + 1 AS rate FROM cost_gaps), tot AS (SELECT sum(mass_t) AS total FROM demand), x AS (SELECT subset_id, demand_id, mass_t, min(dist) AS dist FROM few_subsets JOIN cost_gaps c ON c.site_id IN (m1, m2, m3) GROUP BY subset_id, demand_id, mass_t),
p AS (SELECT s.subset_id, sum(penalty) AS fixed, sum(capacity_t) AS cap FROM few_subsets s JOIN few_sites t ON t.site_id IN (m1, m2, m3) GROUP BY s.subset_id), g AS (SELECT subset_id, coalesce(sum(mass_t * dist), 0) AS moved, coalesce(sum(mass_t) FILTER (dist IS NULL), 0) AS lost FROM x GROUP BY subset_id)
SELECT g.subset_id, lost AS unreachable_t, round(greatest(total - cap, 0), 4) AS shortfall_t, round(moved + fixed + rate * (lost + greatest(total - cap, 0)), 2) AS score FROM g JOIN p ON p.subset_id = g.subset_id, r, tot""")
def lo7(spark, d):
    sites = feed(spark, d, "few_sites")
    out = L.coverage_score(feed(spark, d, "cost_gaps"), L.subsets(sites.select("site_id"), 3), sites.select("site_id", "penalty"), sites.select("site_id", "capacity_t"))
    return rounded(rounded(out, ["shortfall_t"], 4), ["score"], 2)


@query("lo8_feasibility", """WITH x AS (SELECT subset_id, demand_id, mass_t, count(dist) AS n FROM few_subsets JOIN cost_gaps c ON c.site_id IN (m1, m2, m3) GROUP BY subset_id, demand_id, mass_t), p AS (SELECT s.subset_id, sum(capacity_t) AS cap FROM few_subsets s JOIN few_sites t ON t.site_id IN (m1, m2, m3) GROUP BY s.subset_id)
SELECT x.subset_id, max(cap) >= sum(mass_t) AND min(n) > 0 AS feasible FROM x JOIN p ON p.subset_id = x.subset_id GROUP BY x.subset_id""")
def lo8(spark, d):
    sites = feed(spark, d, "few_sites")
    return L.feasibility(feed(spark, d, "cost_gaps"), L.subsets(sites.select("site_id"), 3), sites.select("site_id", "capacity_t"))


@query("lo8_regret", """SELECT demand_id, CASE WHEN count(*) > 1 THEN round(max(dist) - min(dist), 6) END AS regret FROM (SELECT *, row_number() OVER (PARTITION BY demand_id ORDER BY dist) AS rn FROM cost_gaps WHERE dist IS NOT NULL) WHERE rn <= 2 GROUP BY demand_id""")
def lo8r(spark, d):
    out = L.regret(feed(spark, d, "cost_gaps"))
    return out.select("demand_id", F.when(F.col("regret") != float("inf"), R("regret")).alias("regret"))


@query("lo9_routing_metrics", f"""WITH {_NEAR} SELECT count(*) AS n, count(*) FILTER (kind = 'FULL') AS full_loads, count(*) FILTER (kind = 'PARTIAL') AS partial_loads, sum(mass_t) AS mass_t, round(sum(mass_t * dist), 3) AS tonne_m, round(quantile_cont(dist, 0.5), 6) AS p50, round(quantile_cont(dist, 0.95), 6) AS p95, round(max(dist), 6) AS max_dist, round(sum(mass_t * dist) / sum(mass_t), 6) AS mean_dist FROM n""")
def lo9(spark, d):
    total, _ = L.routing_metrics(L.assign_nearest(feed(spark, d, "loads"), feed(spark, d, "open_sites"), 8.0), feed(spark, d, "open_sites"))
    return rounded(rounded(total, ["tonne_m"], 3), ["p50", "p95", "max_dist", "mean_dist"])


@query("lo9_site_use", f"""WITH {_NEAR} SELECT s.site_id, capacity_t, count(n.demand_id) AS events, count(*) FILTER (kind = 'FULL') AS full_loads, count(*) FILTER (kind = 'PARTIAL') AS partial_loads, coalesce(sum(n.mass_t), 0) AS mass_t, round(coalesce(sum(n.mass_t), 0) / capacity_t, 6) AS utilisation FROM open_sites s LEFT JOIN n ON n.site_id = s.site_id GROUP BY s.site_id, capacity_t""")
def lo9s(spark, d):
    _, use = L.routing_metrics(L.assign_nearest(feed(spark, d, "loads"), feed(spark, d, "open_sites"), 8.0), feed(spark, d, "open_sites"))
    return rounded(use, ["utilisation"])


@query("ga1_components")
def ga1(spark, d):
    e = feed(spark, d, "road_graph")
    return A.components(feed(spark, d, "SELECT c_custkey AS node FROM customer"), e)


ORACLES["ga1_components"] = oracle("""WITH RECURSIVE e AS (SELECT a, b FROM road_graph UNION SELECT b, a FROM road_graph), w AS (SELECT c_custkey AS root, c_custkey AS node FROM customer WHERE c_custkey % 97 IN (0, 1) OR c_custkey < 3 UNION SELECT w.root, e.b FROM w JOIN e ON e.a = w.node)
SELECT c_custkey AS node, coalesce(min(root), c_custkey) AS component FROM customer LEFT JOIN w ON w.node = c_custkey GROUP BY c_custkey""")


@query("ga2_split_runs", """WITH s AS (SELECT l_orderkey AS run, l_linenumber AS sequence, l_partkey * 1000 + l_suppkey AS sid, l_linenumber <= 3 AS head FROM lineitem), h AS (SELECT run, head, row_number() OVER (PARTITION BY run ORDER BY min(sequence * 1e12 + sid)) AS rn, count(*) OVER (PARTITION BY run) AS n FROM s GROUP BY run, head)
SELECT sid AS segment_id, CAST(s.run AS VARCHAR) AS run_id, CASE WHEN n > 1 THEN s.run || ':C' || lpad(CAST(rn AS VARCHAR), 3, '0') ELSE CAST(s.run AS VARCHAR) END AS new_run_id, sequence FROM s JOIN h ON s.run = h.run AND s.head = h.head""")
def ga2(spark, d):
    df = feed(spark, d, "SELECT CAST(l_orderkey AS STRING) AS run_id, l_linenumber AS sequence, l_partkey * 1000 + l_suppkey AS segment_id, CASE WHEN l_linenumber <= 3 THEN 0e0 ELSE 1e3 END AS x0, 0e0 AS y0, CASE WHEN l_linenumber <= 3 THEN 1e0 ELSE 2e3 END AS x1, l_quantity AS y1 FROM lineitem")
    return A.split_runs(df)[0]


@query("ga3_build_edges", """WITH p AS (SELECT segment_id, 0e0 AS s FROM street UNION SELECT segment_id, 2e1 FROM street UNION SELECT segment_id, station FROM stops_ga), q AS (SELECT segment_id, s, lead(s) OVER (PARTITION BY segment_id ORDER BY s) AS t FROM p),
e AS (SELECT printf('%.3f,%.3f', x0 + s, y0) AS p, printf('%.3f,%.3f', x0 + t, y0) AS q, t - s AS w FROM q JOIN street USING (segment_id) WHERE t IS NOT NULL) SELECT least(p, q) AS a, greatest(p, q) AS b, min(w) AS weight FROM e GROUP BY ALL""")
def ga3(spark, d):
    return A.build_edges(feed(spark, d, "street"), feed(spark, d, "stops_ga"))


@query("ga4_snap", """WITH g AS (SELECT demand_id, segment_id, d.x, d.y, greatest(x0, least(x1, d.x)) AS sx, y0 AS sy, sqrt(power(d.x - greatest(x0, least(x1, d.x)), 2) + power(d.y - y0, 2)) AS gap, greatest(x0, least(x1, d.x)) - x0 AS st FROM demand d, street),
o AS (SELECT *, row_number() OVER (PARTITION BY demand_id ORDER BY round(gap, 9), segment_id) AS rn FROM g),
near AS (SELECT * FROM o WHERE gap <= 12 OR rn = 1),
clip AS (SELECT demand_id, segment_id, greatest(0, CASE WHEN sx <> x THEN least((lo_x - x) / (sx - x), (hi_x - x) / (sx - x)) ELSE 0 END, CASE WHEN sy <> y THEN least((lo_y - y) / (sy - y), (hi_y - y) / (sy - y)) ELSE 0 END) AS t0,
 least(1, CASE WHEN sx <> x THEN greatest((lo_x - x) / (sx - x), (hi_x - x) / (sx - x)) ELSE 1 END, CASE WHEN sy <> y THEN greatest((lo_y - y) / (sy - y), (hi_y - y) / (sy - y)) ELSE 1 END) AS t1
 FROM near, blocks WHERE gap > 1e-9 AND (sx <> x OR x BETWEEN lo_x AND hi_x) AND (sy <> y OR y BETWEEN lo_y AND hi_y) AND greatest(x, sx) >= lo_x AND least(x, sx) <= hi_x AND greatest(y, sy) >= lo_y AND least(y, sy) <= hi_y),
cut AS (SELECT DISTINCT demand_id, segment_id FROM clip WHERE t0 <= t1),
t AS (SELECT n.*, concat_ws(',', CASE WHEN gap > 12 THEN 'ACCESS_CONNECTOR_EXCEEDS_TOLERANCE' END, CASE WHEN c.demand_id IS NOT NULL THEN 'ACCESS_CONNECTOR_INTERSECTS_EXCLUSION' END) AS why FROM near n LEFT JOIN cut c USING (demand_id, segment_id)),
l AS (SELECT demand_id, min(rn) AS rn FROM t WHERE why = '' GROUP BY demand_id), k AS (SELECT demand_id, count(*) AS n FROM t GROUP BY demand_id)
SELECT a.demand_id AS point_id, a.segment_id, round(a.st, 6) AS station, round(a.gap, 6) AS gap, a.why AS reasons, b.segment_id AS legal_segment_id, round(b.st, 6) AS legal_station, round(b.gap, 6) AS legal_gap, CAST(coalesce(l.rn - 1, k.n) AS INT) AS passed_over
FROM t a JOIN k ON k.demand_id = a.demand_id LEFT JOIN l ON l.demand_id = a.demand_id LEFT JOIN t b ON b.demand_id = a.demand_id AND b.rn = l.rn WHERE a.rn = 1""")
def ga4(spark, d):
    edges = N.ring_edges(feed(spark, d, "block_rings"))
    out = A.snap(feed(spark, d, "SELECT demand_id AS point_id, x, y FROM demand"), feed(spark, d, "street"), 12.0, edges, 10.0)
    return rounded(out, ["station", "gap", "legal_station", "legal_gap"])


@query("ga5_shortest_paths")  # relaxation has no bounded SQL form; tests hold it against a priority queue
def ga5(spark, d):
    src = feed(spark, d, "SELECT c_custkey AS node FROM customer WHERE c_custkey IN (1, 700)")
    tgt = feed(spark, d, "SELECT c_custkey AS node FROM customer WHERE c_custkey % 10 = 3")
    return rounded(A.shortest_paths(feed(spark, d, "road_graph"), src, tgt), ["distance"])


@query("ga6_closure", """WITH RECURSIVE w AS (SELECT a, b FROM needs_ga UNION SELECT w.a, n.b FROM w JOIN needs_ga n ON n.a = w.b) SELECT a, b FROM w""")
def ga6(spark, d):
    return A.closure(feed(spark, d, "needs_ga"))
