"""HY1-HY19 over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import expr as X
from furrow.operators import hydrology as H
from furrow.plans.feeds import FEEDS, feed, oracle

FEEDS["intervals"] = """SELECT user_id AS event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS idx, 6e2 AS duration_s, value / 1e2 AS rain_mm FROM events"""
FEEDS["event_params"] = """SELECT DISTINCT user_id AS event_id, 1e0 + user_id % 9 AS area_ha, 8e1 AS curve_number, 2e-1 AS ia_ratio FROM events"""
FEEDS["balance_intervals"] = """SELECT event_id, idx, duration_s, rain_mm AS rainfall_excess_mm, (idx % 3) * 1e0 AS external_inflow_m3, rain_mm * 5e0 AS controlled_outflow_m3,
idx * 2e0 + event_id % 3 + CASE WHEN event_id % 10 = 0 AND idx = 3 THEN 1e0 ELSE 0e0 END AS storage_start_m3, (idx + 1) * 2e0 + event_id % 3 AS storage_end_m3 FROM intervals"""
FEEDS["pulses"] = """SELECT i.event_id, i.idx, i.idx * 6e2 AS start_s, i.duration_s, i.rain_mm * p.area_ha * 1e1 AS volume_m3 FROM intervals i JOIN event_params p ON i.event_id = p.event_id"""
FEEDS["reaches"] = """SELECT n_nationkey AS reach_id, n_nationkey AS up, CAST(floor(n_nationkey / 2e0) AS INT) AS down, 6e1 * (n_nationkey + 1) AS travel_s FROM nation WHERE n_nationkey > 0"""
FEEDS["reaches_bad"] = """SELECT reach_id, up, down FROM reaches UNION ALL SELECT 100, 3, 3 UNION ALL SELECT 101, 5, 1 UNION ALL SELECT 102, 0, 7 UNION ALL SELECT 7, 30, 31"""
FEEDS["turns"] = """SELECT CAST(user_id % 13 + 12 AS INT) AS node, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k, value FROM events"""
FEEDS["inflows"] = """SELECT node, time_s, flow FROM (SELECT node, k * 6e2 AS time_s, sum(value) / 1e2 AS flow FROM turns GROUP BY node, k UNION ALL SELECT DISTINCT node, 0e0, 0e0 FROM turns UNION ALL SELECT node, (max(k) + 1) * 6e2, 0e0 FROM turns GROUP BY node)"""
# laterals at upper nodes, and one at the outlet itself
FEEDS["laterals"] = """SELECT node, time_s, flow FROM inflows UNION ALL SELECT 0, time_s, flow FROM inflows WHERE node = 12"""
FEEDS["peaks"] = """SELECT p_partkey AS section_id, p_retailprice / 4e2 AS peak_flow FROM part"""
FEEDS["limits"] = """SELECT p_partkey AS section_id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 1e0 + p_partkey % 3 END AS vmax, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 2e1 + p_partkey % 30 END AS tau_max,
CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'SURVEY' END AS source, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_partkey % 13) * 1e-1 END AS d_depth, (p_partkey % 6) * 1e-1 AS d_velocity, 3e-1 AS loss_coef,
CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 8e-1 + (p_partkey % 9) * 1e-1 END AS bankfull, CASE WHEN p_partkey % 6 = 0 OR p_partkey % 17 = 1 THEN NULL ELSE 2e-1 END AS freeboard FROM part"""
FEEDS["full_state"] = """SELECT s.*, a, t, a / w AS radius, 2 / a AS v, 1e3 * 9.80665e0 * a / w * slope AS tau FROM (SELECT *, max_depth * (width + side * max_depth) AS a, width + 2 * max_depth * sqrt(1 + side * side) AS w, width + 2 * side * max_depth AS t FROM sections) s"""
FEEDS["statuses"] = """SELECT f.section_id, f.condition, CASE WHEN peak_flow / (a * pow(radius, 2e0 / 3) * sqrt(slope) / rough) <= 1 THEN 'WITHIN_CAPACITY' ELSE 'EXCEEDS_CAPACITY' END AS status,
CASE WHEN vmax IS NULL AND tau_max IS NULL THEN 'NOT_EVALUATED' WHEN source IS NULL THEN 'INVALID_LIMIT_WITHOUT_SOURCE' WHEN coalesce(v > vmax, false) AND coalesce(tau > tau_max, false) THEN 'EXCEEDS_BOTH' WHEN coalesce(v > vmax, false) THEN 'EXCEEDS_VELOCITY'
 WHEN coalesce(tau > tau_max, false) THEN 'EXCEEDS_SHEAR' ELSE 'WITHIN_DECLARED_LIMITS' END AS stability,
CASE WHEN bankfull IS NULL AND freeboard IS NULL THEN 'NOT_EVALUATED' WHEN bankfull IS NULL OR freeboard IS NULL THEN 'INVALID_PARTIAL_DECLARATION' WHEN bankfull < max_depth - 1e-9 THEN 'OVERTOPS' WHEN bankfull - max_depth < freeboard - 1e-9 THEN 'BELOW_FREEBOARD' ELSE 'WITHIN_FREEBOARD' END AS board
FROM full_state f JOIN peaks p ON f.section_id = p.section_id JOIN limits l ON f.section_id = l.section_id"""
FEEDS["overflow_states"] = """SELECT p_partkey AS section_id, CASE WHEN p_size % 3 = 0 THEN 'NOT_DECLARED' WHEN p_size % 3 = 1 THEN 'DECLARED_UNCHECKED' ELSE 'SCREENED' END AS overflow_state FROM part"""
FEEDS["profile_points"] = """SELECT p_partkey AS section_id, k AS step, k * 25e0 AS station, 5e-1 + (p_partkey % 10) * 1e-1 + k * 1e-2 AS depth, p_size * 1e-1 AS width, 1.5e0 AS side, 5e-3 AS slope, 4e-2 AS rough
FROM part CROSS JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 6)"""
FEEDS["path_vertices"] = """SELECT line_id AS path_id, seq, x, y, 2e1 - seq + z * 1e-1 AS z FROM steps"""
FEEDS["path_ends"] = """SELECT path_id, max(seq) AS last FROM path_vertices GROUP BY path_id"""
FEEDS["overflow_paths"] = """SELECT path_id, path_id % 25 AS reach_id, path_id AS receiver_id FROM path_ends WHERE last >= 2"""
FEEDS["receivers"] = """SELECT v.path_id AS receiver_id, x + (v.path_id % 4) AS x, y, z + CASE WHEN v.path_id % 7 = 0 THEN 1e0 ELSE 0e0 END AS z FROM path_vertices v JOIN path_ends e ON v.path_id = e.path_id AND v.seq = e.last"""
FEEDS["path_barriers"] = """SELECT s_suppkey AS barrier_id, s_suppkey * 1e1 AS x0, 5e0 AS y0, s_suppkey * 1e1 AS x1, 2e1 AS y1, 1.5e0 AS buffer_m FROM supplier WHERE s_suppkey % 4 = 0"""

QUERIES, ORACLES = {}, {}
R = lambda c, n=6: F.round(c, n)


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = oracle(sql)
        return fn

    return add


@query("hy1_mass_balance", """SELECT event_id, round(inflow, 6) AS inflow_m3, round(outflow, 6) AS outflow_m3, round(ds, 6) AS storage_change_m3, round(inflow - outflow - ds, 6) AS residual_m3, round(peak, 6) AS peak_inflow_rate,
CASE WHEN abs(inflow - outflow - ds) / greatest(inflow, outflow + abs(ds), 1e-12) <= 5e-2 + 1e-15 THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT b.event_id, sum(rainfall_excess_mm * area_ha * 10 + external_inflow_m3) AS inflow, sum(controlled_outflow_m3) AS outflow, arg_max(storage_end_m3, idx) - arg_min(storage_start_m3, idx) AS ds,
 max((rainfall_excess_mm * area_ha * 10 + external_inflow_m3) / duration_s) AS peak FROM balance_intervals b JOIN event_params p ON b.event_id = p.event_id GROUP BY b.event_id)""")
def hy1(spark, d):
    _, events = H.mass_balance(feed(spark, d, "balance_intervals"), feed(spark, d, "event_params").select("event_id", "area_ha"))
    return events.select("event_id", *[R(c).alias(c) for c in ("inflow_m3", "outflow_m3", "storage_change_m3", "residual_m3", "peak_inflow_rate")], "status")


@query("hy2_storage_breaks", """SELECT b.event_id, b.idx, round(b.storage_start_m3 - a.storage_end_m3, 6) AS gap_m3 FROM balance_intervals a JOIN balance_intervals b ON a.event_id = b.event_id AND b.idx = a.idx + 1 WHERE abs(b.storage_start_m3 - a.storage_end_m3) > 1e-9""")
def hy2(spark, d):
    return H.storage_breaks(feed(spark, d, "balance_intervals")).withColumn("gap_m3", R("gap_m3"))


_EXCESS = """e AS (SELECT event_id, idx, rain_mm, duration_s, area_ha, cum, CASE WHEN cum <= 12.7e0 THEN 0e0 ELSE (cum - 12.7e0) * (cum - 12.7e0) / (cum - 12.7e0 + 63.5e0) END AS q FROM (SELECT i.event_id, idx, rain_mm, duration_s, area_ha,
 CAST(sum(CAST(rain_mm * 100 AS DECIMAL(18, 2))) OVER (PARTITION BY i.event_id ORDER BY idx) AS DOUBLE) / 100 AS cum FROM intervals i JOIN event_params p ON i.event_id = p.event_id)),
x AS (SELECT *, greatest(0e0, q - coalesce(lag(q) OVER (PARTITION BY event_id ORDER BY idx), 0)) AS excess FROM e)"""


@query("hy3_rainfall_excess", f"""WITH {_EXCESS} SELECT event_id, idx, round(cum, 5) AS cumulative_mm, round(q, 5) AS runoff_mm, round(excess, 5) AS excess_mm, round(rain_mm - excess, 5) AS loss_mm, round(rain_mm * 6, 5) AS intensity_mm_h, (idx + 1) * 6e2 AS elapsed_s FROM x""")
def hy3(spark, d):
    rows, _ = H.rainfall_excess(feed(spark, d, "intervals"), feed(spark, d, "event_params"))
    return rows.select("event_id", "idx", *[R(c, 5).alias(c) for c in ("cumulative_mm", "runoff_mm", "excess_mm", "loss_mm", "intensity_mm_h")], "elapsed_s")


@query("hy3_excess_events", f"""WITH {_EXCESS} SELECT event_id, round(sum(rain_mm), 5) AS rain_mm, round(sum(excess), 5) AS excess_mm, round(sum(excess) * area_ha * 10, 4) AS excess_m3, round(sum(excess) / sum(rain_mm), 5) AS runoff_coefficient FROM x GROUP BY event_id, area_ha""")
def hy3e(spark, d):
    _, ev = H.rainfall_excess(feed(spark, d, "intervals"), feed(spark, d, "event_params"))
    return ev.select("event_id", R("rain_mm", 5).alias("rain_mm"), R("excess_mm", 5).alias("excess_mm"), R("excess_m3", 4).alias("excess_m3"), R("runoff_coefficient", 5).alias("runoff_coefficient"))


_HYDRO = """p AS (SELECT event_id, start_s AS t0, start_s + 1200e0 AS tp, start_s + 3204e0 AS t1, volume_m3 * 2 / 3204e0 AS qp FROM pulses),
ends AS (SELECT event_id, max(t1) AS fin FROM p GROUP BY event_id),
t AS (SELECT event_id, t0 AS time_s FROM p UNION SELECT event_id, tp FROM p UNION SELECT event_id, t1 FROM p UNION SELECT event_id, k * 9e2 FROM ends, LATERAL (SELECT unnest(range(0, CAST(floor(fin / 9e2) AS BIGINT) + 1)) AS k) UNION SELECT event_id, fin FROM ends),
h AS (SELECT t.event_id, t.time_s, coalesce(sum(CASE WHEN time_s <= tp THEN qp * (time_s - t0) / (tp - t0) ELSE qp * (t1 - time_s) / (t1 - tp) END), 0) AS flow FROM t LEFT JOIN p ON p.event_id = t.event_id AND t0 < time_s AND time_s < t1 GROUP BY t.event_id, t.time_s)"""


def _hydro(spark, d):
    return H.hydrograph(feed(spark, d, "pulses"), 900.0, 900.0, 2.67)


@query("hy4_hydrograph", f"WITH {_HYDRO} SELECT event_id, round(time_s, 3) AS time_s, round(flow, 6) AS flow FROM h")
def hy4(spark, d):
    return _hydro(spark, d).select("event_id", R("time_s", 3).alias("time_s"), R("flow").alias("flow"))


@query("hy5_series_balance", f"""WITH {_HYDRO}, s AS (SELECT event_id, sum(piece) AS volume FROM (SELECT event_id, (flow + lag(flow) OVER w) / 2 * (time_s - lag(time_s) OVER w) AS piece FROM h WINDOW w AS (PARTITION BY event_id ORDER BY time_s)) GROUP BY event_id)
SELECT s.event_id, round(volume, 4) AS volume_m3, round(max(flow), 6) AS peak_flow, CASE WHEN abs(volume - max(v)) / max(v) <= 1e-10 THEN 'PASS' ELSE 'FAIL' END AS status FROM s JOIN h ON h.event_id = s.event_id JOIN (SELECT event_id, sum(volume_m3) AS v FROM pulses GROUP BY event_id) i ON i.event_id = s.event_id GROUP BY s.event_id, volume""")
def hy5(spark, d):
    volumes = feed(spark, d, "pulses").groupBy("event_id").agg(F.sum("volume_m3").alias("input_m3"))
    return H.series_balance(_hydro(spark, d), volumes).select("event_id", R("volume_m3", 4).alias("volume_m3"), R("peak_flow").alias("peak_flow"), "status")


@query("hy6_check_series", """SELECT node, true AS enough_points, true AS increasing, true AS non_negative_time, true AS non_negative_flow, node % 5 <> 0 AS zero_ends, node % 5 <> 0 AS valid FROM (SELECT DISTINCT node FROM inflows)""")
def hy6(spark, d):
    df = feed(spark, d, "SELECT node, time_s, CASE WHEN node % 5 = 0 AND time_s = 0 THEN 1e0 ELSE flow END AS flow, row_number() OVER (PARTITION BY node ORDER BY time_s) AS seq FROM inflows")
    return H.check_series(df, "node")


@query("hy7_network_checks", """WITH RECURSIVE walk AS (SELECT up AS a, down AS b FROM reaches_bad WHERE up <> down UNION SELECT w.a, r.down FROM walk w JOIN reaches_bad r ON r.up = w.b WHERE r.up <> r.down),
loose AS (SELECT DISTINCT node FROM inflows UNION SELECT 77), nodes AS (SELECT up AS node FROM reaches_bad UNION SELECT down FROM reaches_bad),
fed AS (SELECT b AS node FROM walk JOIN loose ON a = node UNION SELECT node FROM loose)
SELECT DISTINCT rule, CAST(key AS VARCHAR) AS key FROM (SELECT 'DUPLICATE_REACH' AS rule, reach_id AS key FROM reaches_bad GROUP BY reach_id HAVING count(*) > 1 UNION ALL SELECT 'SELF_LOOP', reach_id FROM reaches_bad WHERE up = down
UNION ALL SELECT 'SPLIT', up FROM reaches_bad GROUP BY up HAVING count(*) > 1 UNION ALL SELECT 'CYCLE', a FROM walk WHERE a = b UNION ALL SELECT 'UNKNOWN_NODE', node FROM loose WHERE node NOT IN (SELECT node FROM nodes)
UNION ALL SELECT 'OUTLET', node FROM nodes WHERE node NOT IN (SELECT up FROM reaches_bad) UNION ALL SELECT 'DRY', reach_id FROM reaches_bad WHERE up NOT IN (SELECT node FROM fed))""")
def hy7(spark, d):
    return H.check_network(feed(spark, d, "reaches_bad"), feed(spark, d, "SELECT node FROM inflows UNION SELECT 77"))


_ROUTE = """WITH RECURSIVE paths AS (SELECT up AS node, reach_id, travel_s AS lag_s, down AS at_ FROM reaches UNION ALL SELECT p.node, r.reach_id, p.lag_s + r.travel_s, r.down FROM paths p JOIN reaches r ON r.up = p.at_),
moved AS (SELECT reach_id, l.node, time_s + lag_s AS time_s, flow FROM inflows l JOIN paths p ON p.node = l.node),
seg AS (SELECT reach_id, node, time_s AS t0, flow AS q0, lead(time_s) OVER w AS t1, lead(flow) OVER w AS q1 FROM moved WINDOW w AS (PARTITION BY reach_id, node ORDER BY time_s)),
times AS (SELECT DISTINCT reach_id, time_s FROM moved),
routed AS (SELECT t.reach_id, t.time_s, coalesce(sum(q0 + (q1 - q0) * (time_s - t0) / (t1 - t0)), 0) AS flow FROM times t LEFT JOIN seg s ON s.reach_id = t.reach_id AND t0 <= time_s AND time_s < t1 GROUP BY t.reach_id, t.time_s)"""


@query("hy8_route_by_lag", f"{_ROUTE} SELECT reach_id, round(time_s, 3) AS time_s, round(flow, 6) AS flow FROM routed")
def hy8(spark, d):
    return H.route_by_lag(feed(spark, d, "reaches"), feed(spark, d, "inflows")).select("reach_id", R("time_s", 3).alias("time_s"), R("flow").alias("flow"))


@query("hy9_routing_summary", f"""{_ROUTE}, vol AS (SELECT reach_id, sum(piece) AS v, max(flow) AS q FROM (SELECT reach_id, flow, (flow + lag(flow) OVER w) / 2 * (time_s - lag(time_s) OVER w) AS piece FROM routed WINDOW w AS (PARTITION BY reach_id ORDER BY time_s)) GROUP BY reach_id)
SELECT r.reach_id, round(v, 3) AS volume_m3, round(q, 6) AS peak_flow, CASE WHEN q > 0 THEN 'ROUTED' ELSE 'DRY' END AS status FROM reaches r LEFT JOIN vol ON vol.reach_id = r.reach_id""")
def hy9(spark, d):
    r = feed(spark, d, "reaches")
    return H.routing_summary(r, H.route_by_lag(r, feed(spark, d, "inflows"))).select("reach_id", R("volume_m3", 3).alias("volume_m3"), R("peak_flow").alias("peak_flow"), "status")


@query("hy9_routing_balance", f"""{_ROUTE}, vol AS (SELECT reach_id, sum((flow + q) / 2 * (time_s - t)) AS v FROM (SELECT *, lag(flow) OVER w AS q, lag(time_s) OVER w AS t FROM routed WINDOW w AS (PARTITION BY reach_id ORDER BY time_s)) GROUP BY reach_id),
own AS (SELECT node, sum((flow + q) / 2 * (time_s - t)) AS v FROM (SELECT *, lag(flow) OVER w AS q, lag(time_s) OVER w AS t FROM laterals WINDOW w AS (PARTITION BY node ORDER BY time_s)) GROUP BY node),
b AS (SELECT (SELECT sum(v) FROM own) AS i, (SELECT sum(v) FROM vol JOIN reaches r USING (reach_id) WHERE r.down NOT IN (SELECT up FROM reaches)) + (SELECT sum(v) FROM own WHERE node NOT IN (SELECT up FROM reaches)) AS o)
SELECT round(i, 3) AS input_volume_m3, round(o, 3) AS outlet_volume_m3, CASE WHEN abs(o - i) / greatest(i, 1e-12) <= 1e-10 THEN 'PASS' ELSE 'FAIL' END AS balance_status FROM b""".replace("FROM inflows", "FROM laterals"))
def hy9b(spark, d):
    r, lateral = feed(spark, d, "reaches"), feed(spark, d, "laterals")
    out = H.routing_balance(r, lateral, H.route_by_lag(r, lateral))
    return out.select(R("input_volume_m3", 3).alias("input_volume_m3"), R("outlet_volume_m3", 3).alias("outlet_volume_m3"), "balance_status")


def _capacity(spark, d):
    return H.reach_capacity(feed(spark, d, "peaks"), feed(spark, d, "sections"))


@query("hy10_reach_capacity", """SELECT f.section_id, condition, round(cap, 6) AS capacity, round(peak_flow / cap, 6) AS ratio, round(cap - peak_flow, 6) AS margin, round(peak_flow, 6) AS flow_at_depth, CASE WHEN peak_flow / cap <= 1 THEN 'WITHIN_CAPACITY' ELSE 'EXCEEDS_CAPACITY' END AS status
FROM (SELECT *, a * pow(radius, 2e0 / 3) * sqrt(slope) / rough AS cap FROM full_state) f JOIN peaks p ON f.section_id = p.section_id""")
def hy10(spark, d):
    c = F.col
    back = X.manning_q(c("normal_depth"), c("width"), c("side"), c("slope"), c("rough"))  # the flow at the depth that was found
    return _capacity(spark, d).select("section_id", "condition", R("capacity").alias("capacity"), R("ratio").alias("ratio"), R("margin").alias("margin"), R(back).alias("flow_at_depth"), "status")


@query("hy11_stability_status", "SELECT section_id, stability FROM statuses")
def hy11(spark, d):
    c = F.col
    df = feed(spark, d, "SELECT s.*, l.vmax, l.tau_max, l.source FROM sections s JOIN limits l ON s.section_id = l.section_id").withColumn("s", X.flow_state(F.lit(2.0), c("max_depth"), c("width"), c("side"), c("slope")))
    return df.select("section_id", H.stability_status(c("s.velocity"), c("s.shear"), c("vmax"), c("tau_max"), c("source")).alias("stability"))


@query("hy12_downstream_control", """SELECT section_id, round(loss, 8) AS head_loss, round(coalesce(greatest(max_depth, d_depth), max_depth) + loss, 8) AS control_depth, CASE WHEN d_depth IS NULL THEN 'NOT_EVALUATED' WHEN greatest(max_depth, d_depth) + loss > max_depth + 1e-12 THEN 'RAISES' ELSE 'DOES_NOT_RAISE' END AS control_status
FROM (SELECT f.section_id, max_depth, d_depth, loss_coef * abs(v * v - d_velocity * d_velocity) / (2 * 9.80665e0) AS loss FROM full_state f JOIN limits l ON f.section_id = l.section_id)""")
def hy12(spark, d):
    c = F.col
    df = feed(spark, d, "SELECT s.*, l.d_depth, l.d_velocity, l.loss_coef FROM sections s JOIN limits l ON s.section_id = l.section_id").withColumn("s", X.flow_state(F.lit(2.0), c("max_depth"), c("width"), c("side"), c("slope")))
    out = df.select("section_id", H.downstream_control(c("max_depth"), c("s.velocity"), c("d_depth"), c("d_velocity"), c("loss_coef")).alias("r")).select("section_id", "r.*")
    return out.withColumns({"head_loss": R("head_loss", 8), "control_depth": R("control_depth", 8)})


@query("hy13_freeboard_status", "SELECT section_id, board FROM statuses")
def hy13(spark, d):
    df = feed(spark, d, "SELECT s.section_id, max_depth, bankfull, freeboard FROM sections s JOIN limits l ON s.section_id = l.section_id")
    return df.select("section_id", H.freeboard_status(F.col("max_depth") - 1e-9, F.col("bankfull"), F.col("freeboard")).alias("board"))


@query("hy14_capacity_summary", """SELECT count(*) FILTER (status = 'WITHIN_CAPACITY') AS within, count(*) FILTER (status = 'EXCEEDS_CAPACITY') AS exceeds, count(*) FILTER (stability <> 'NOT_EVALUATED') AS stability_evaluated, count(*) FILTER (stability LIKE 'EXCEEDS%') AS stability_exceeded,
count(*) FILTER (board = 'OVERTOPS') AS overtopping, count(*) FILTER (board = 'BELOW_FREEBOARD') AS freeboard_short, count(*) FILTER (s.condition = 'NEW') AS n_new, count(*) FILTER (s.condition = 'CURRENT') AS n_current, count(*) FILTER (s.condition = 'DEGRADED') AS n_degraded,
count(*) AS reaches, count(*) FILTER (board <> 'NOT_EVALUATED') AS freeboard_evaluated, count(*) FILTER (overflow_state <> 'NOT_DECLARED') AS overflow_declared, count(*) FILTER (d_depth IS NOT NULL) AS downstream_evaluated,
count(*) FILTER (greatest(max_depth, d_depth) + loss_coef * abs(v * v - d_velocity * d_velocity) / (2 * 9.80665e0) > max_depth + 1e-12 AND d_depth IS NOT NULL) AS downstream_controlled
FROM statuses s JOIN overflow_states USING (section_id) JOIN limits USING (section_id) JOIN full_state f USING (section_id)""")
def hy14(spark, d):
    cap = _capacity(spark, d).select("section_id", "condition", "status")
    more = hy11(spark, d).join(hy12(spark, d).select("section_id", "control_status"), "section_id").join(hy13(spark, d), "section_id").join(feed(spark, d, "overflow_states"), "section_id")
    return H.capacity_summary(cap.join(more, "section_id"))


@query("hy15_rating_curve", """SELECT section_id, k AS step, round(d, 6) AS depth, round(d * (width + side * d) * pow(d * (width + side * d) / (width + 2 * d * sqrt(1 + side * side)), 2e0 / 3) * sqrt(slope) / rough, 6) AS discharge FROM (SELECT *, max_depth * k / 10 AS d FROM sections, (SELECT unnest(range(1, 11)) AS k))""")
def hy15(spark, d):
    return H.rating_curve(feed(spark, d, "sections"), 10).withColumns({"depth": R("depth"), "discharge": R("discharge")})


@query("hy16_profile_audit", """WITH p AS (SELECT *, depth * (width + side * depth) AS a, width + 2 * depth * sqrt(1 + side * side) AS w, width + 2 * side * depth AS t FROM profile_points), q AS (SELECT *, 2 / a AS v, depth + (2 / a) * (2 / a) / (2 * 9.80665e0) AS head, power(rough * (2 / a) / pow(a / w, 2e0 / 3), 2) AS sf FROM p),
r AS (SELECT section_id, depth, v / sqrt(9.80665e0 * a / t) AS froude, lag(head) OVER w + slope * 25 - head - (sf + lag(sf) OVER w) / 2 * 25 AS residual FROM q WINDOW w AS (PARTITION BY section_id ORDER BY step))
SELECT section_id, round(max(depth), 6) AS max_depth, round(max(froude), 6) AS max_froude, round(max(abs(residual)), 6) AS max_residual, count(*) FILTER (froude >= 1) AS supercritical FROM r GROUP BY section_id""")
def hy16(spark, d):
    _, out = H.profile_audit(feed(spark, d, "profile_points"), 2.0)
    return out.select("section_id", R("max_depth").alias("max_depth"), R("max_froude").alias("max_froude"), R("max_residual").alias("max_residual"), "supercritical")


_SCREEN = """WITH s AS (SELECT a.path_id, a.seq, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS len FROM path_vertices a JOIN path_vertices b ON a.path_id = b.path_id AND b.seq = a.seq + 1),
v AS (SELECT path_id, max(z - low) AS acc, arg_min(z, seq) - arg_max(z, seq) AS dropm, arg_max(x, seq) AS ex, arg_max(y, seq) AS ey, arg_max(z, seq) AS ez FROM (SELECT *, min(z) OVER (PARTITION BY path_id ORDER BY seq) AS low FROM path_vertices) GROUP BY path_id),
g AS (SELECT path_id, sum(len) AS length_m, max(greatest(z1 - z0, 0)) AS max_rise, count(*) FILTER (z1 - z0 > 5e-2) AS adverse FROM s GROUP BY path_id),
bb AS (SELECT barrier_id, x0 AS bx, y0 AS by0, y1 AS by1, buffer_m FROM path_barriers),
m AS (SELECT s.*, bb.*, CASE WHEN len > 0 THEN greatest(0, least(1, ((bx - x0) * (x1 - x0) + (by0 - y0) * (y1 - y0)) / (len * len))) ELSE 0 END AS u0,
 CASE WHEN len > 0 THEN greatest(0, least(1, ((bx - x0) * (x1 - x0) + (by1 - y0) * (y1 - y0)) / (len * len))) ELSE 0 END AS u1, CASE WHEN x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (bx - x0) / (x1 - x0) END AS yc FROM s, bb),
near AS (SELECT DISTINCT path_id, barrier_id FROM m WHERE CASE WHEN (x0 - bx) * (x1 - bx) <= 0 AND yc BETWEEN by0 AND by1 THEN 0
 ELSE least(sqrt(power(x0 - bx, 2) + power(y0 - greatest(by0, least(by1, y0)), 2)), sqrt(power(x1 - bx, 2) + power(y1 - greatest(by0, least(by1, y1)), 2)),
 sqrt(power(bx - (x0 + u0 * (x1 - x0)), 2) + power(by0 - (y0 + u0 * (y1 - y0)), 2)), sqrt(power(bx - (x0 + u1 * (x1 - x0)), 2) + power(by1 - (y0 + u1 * (y1 - y0)), 2))) END <= buffer_m),
n AS (SELECT path_id, string_agg(CAST(barrier_id AS VARCHAR), ',' ORDER BY CAST(barrier_id AS VARCHAR)) AS barriers FROM near GROUP BY path_id),
r AS (SELECT p.path_id, p.reach_id, p.receiver_id, round(length_m, 6) AS length_m, round(dropm, 6) AS drop_m, round(max_rise, 6) AS max_rise, adverse, round(acc, 6) AS accumulated_rise, round(sqrt(power(ex - r.x, 2) + power(ey - r.y, 2)), 6) AS gap_xy, barriers,
CASE WHEN sqrt(power(ex - r.x, 2) + power(ey - r.y, 2)) > 2 OR abs(ez - r.z) > 5e-2 THEN 'NOT_CONNECTED' WHEN acc > 5e-2 OR barriers IS NOT NULL THEN 'REVIEW' ELSE 'CLEAR' END AS status
FROM overflow_paths p JOIN g ON g.path_id = p.path_id JOIN v ON v.path_id = p.path_id JOIN receivers r ON r.receiver_id = p.receiver_id LEFT JOIN n ON n.path_id = p.path_id)"""


def _screen(spark, d):
    return H.screen_paths(feed(spark, d, "path_vertices"), feed(spark, d, "overflow_paths"), feed(spark, d, "receivers"), feed(spark, d, "path_barriers"))


@query("hy17_screen_paths", f"{_SCREEN} SELECT * FROM r")
def hy17(spark, d):
    return _screen(spark, d).select("path_id", "reach_id", "receiver_id", *[R(c).alias(c) for c in ("length_m", "drop_m", "max_rise", "accumulated_rise", "gap_xy")], "adverse", "barriers", "status")


@query("hy18_paths_summary", f"""{_SCREEN} SELECT count(*) FILTER (status = 'CLEAR') AS clear, count(*) FILTER (status = 'REVIEW') AS review, count(*) FILTER (status <> 'NOT_CONNECTED') AS connected, count(*) FILTER (barriers IS NOT NULL) AS barrier_conflict, count(*) FILTER (path_id % 3 <> 0) AS undeclared FROM r""")
def hy18(spark, d):
    return H.paths_summary(_screen(spark, d), feed(spark, d, "SELECT reach_id, receiver_id FROM overflow_paths WHERE path_id % 3 = 0"))


@query("hy19_stage_blockers", """SELECT e.event_id, array_to_string(list_sort(list_filter(['OUTLET_NOT_APPROVED', CASE WHEN bad THEN 'SOURCE_NOT_PROJECT_EVIDENCE' END, CASE WHEN e.event_id % 4 = 0 THEN 'MASS_BALANCE_FAILED' END, CASE WHEN e.event_id % 6 = 0 THEN 'TOLERANCE_NOT_DECLARED' END], lambda x: x IS NOT NULL)), ',') AS blockers
FROM event_params e JOIN (SELECT user_id, bool_or(event_type = 'error') AS bad FROM events GROUP BY user_id) s ON s.user_id = e.event_id""")
def hy19(spark, d):
    ev = feed(spark, d, "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN event_id % 6 = 0 THEN NULL ELSE 5e-2 END AS tolerance FROM event_params")
    src = feed(spark, d, "SELECT user_id AS event_id, CASE WHEN event_type = 'error' THEN 'REFERENCE' ELSE 'PROJECT_EVIDENCE' END AS evidence FROM events")
    return H.stage_blockers(ev, src, answered=("OVERFLOW_NOT_ROUTED",))
