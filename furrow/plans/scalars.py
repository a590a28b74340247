"""SC1-SC16 over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import expr as X
from furrow.plans.feeds import FEEDS, feed, oracle

FEEDS["rusle_factors"] = """SELECT p_partkey AS unit_id, p_retailprice AS r, p_size * 1e-3 AS k, 1e0 + (p_partkey % 7) * 1e-1 AS ls,
CASE WHEN p_partkey % 13 = 0 THEN 1.1e0 ELSE (p_partkey % 11) * 1e-1 END AS c, (p_partkey % 6) * 2e-1 AS p,
CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey % 9 + 1) * 1e0 END AS tolerance FROM part"""
FEEDS["nested"] = """SELECT event_id, props, user_id FROM events"""
QUERIES, ORACLES = {}, {}


def query(name, sql):
    def add(fn):
        QUERIES[name] = fn
        ORACLES[name] = oracle(sql)
        return fn

    return add


R = lambda c, n=6: F.round(c, n)


@query("sc1_rusle", """SELECT unit_id, reject_reason, round(loss, 10) AS soil_loss, round(loss / tolerance, 10) AS tolerance_ratio,
CASE WHEN loss IS NULL THEN 'REJECTED' WHEN tolerance IS NULL THEN 'TOLERANCE_NOT_DECLARED' WHEN loss / tolerance <= 1 + 1e-12 THEN 'WITHIN_DECLARED_TOLERANCE_SCREENING' ELSE 'EXCEEDS_DECLARED_TOLERANCE_SCREENING' END AS status
FROM (SELECT *, CASE WHEN c > 1 THEN 'C_OUTSIDE_0_1' END AS reject_reason, CASE WHEN c <= 1 THEN r * k * ls * c * p END AS loss FROM rusle_factors)""")
def sc1(spark, d):
    return X.rusle(feed(spark, d, "rusle_factors")).select("unit_id", "reject_reason", R("soil_loss", 10).alias("soil_loss"), R("tolerance_ratio", 10).alias("tolerance_ratio"), "status")


@query("sc2_cn_runoff", """SELECT event_id, round(CASE WHEN v <= 12.7 THEN 0 ELSE (v - 12.7) * (v - 12.7) / (v - 12.7 + 63.5) END, 6) AS runoff_mm FROM (SELECT event_id, value AS v FROM events)""")
def sc2(spark, d):
    return feed(spark, d, "SELECT event_id, value FROM events").select("event_id", R(X.cn_runoff(F.col("value"), F.lit(80.0), F.lit(0.2))).alias("runoff_mm"))


@query("sc3_trapezoid", """SELECT section_id, round(a, 6) AS area, round(p, 6) AS perimeter, round(a / p, 6) AS radius, round(width + 2 * side * max_depth, 6) AS top
FROM (SELECT *, max_depth * (width + side * max_depth) AS a, width + 2 * max_depth * sqrt(1 + side * side) AS p FROM sections)""")
def sc3(spark, d):
    t = X.trapezoid(F.col("max_depth"), F.col("width"), F.col("side"))
    return feed(spark, d, "sections").select("section_id", t.alias("t")).select("section_id", *[R(F.col(f"t.{n}")).alias(n) for n in ("area", "perimeter", "radius", "top")])


@query("sc4_manning", """SELECT section_id, round(a * pow(a / p, 2e0 / 3) * sqrt(slope) / rough, 6) AS discharge
FROM (SELECT *, max_depth * (width + side * max_depth) AS a, width + 2 * max_depth * sqrt(1 + side * side) AS p FROM sections)""")
def sc4(spark, d):
    q = X.manning_q(F.col("max_depth"), F.col("width"), F.col("side"), F.col("slope"), F.col("rough"))
    return feed(spark, d, "sections").select("section_id", R(q).alias("discharge"))


@query("sc5_flow_state", """SELECT section_id, round(2 / a, 6) AS velocity, round(2 / a / sqrt(9.80665e0 * a / (width + 2 * side * max_depth)), 6) AS froude, round(1000 * 9.80665e0 * a / p * slope, 6) AS shear
FROM (SELECT *, max_depth * (width + side * max_depth) AS a, width + 2 * max_depth * sqrt(1 + side * side) AS p FROM sections)""")
def sc5(spark, d):
    s = X.flow_state(F.lit(2.0), F.col("max_depth"), F.col("width"), F.col("side"), F.col("slope"))
    return feed(spark, d, "sections").select("section_id", s.alias("s")).select("section_id", *[R(F.col(f"s.{n}")).alias(n) for n in ("velocity", "froude", "shear")])


@query("sc6_finite_round", """SELECT event_id, CASE WHEN user_id % 7 IN (0, 1) THEN NULL ELSE round(value / 3, 3) END AS v FROM events""")
def sc6(spark, d):
    bad = "CASE WHEN user_id % 7 = 0 THEN double('NaN') WHEN user_id % 7 = 1 THEN double('Infinity') ELSE value / 3 END"
    return feed(spark, d, f"SELECT event_id, {bad} AS v FROM events").select("event_id", X.round_or_null(F.col("v"), 3).alias("v"))


@query("sc7_axial", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(cos(radians(2 * l_quantity)), 6) AS qx, round(sin(radians(2 * l_quantity)), 6) AS qy,
round(abs(((((l_quantity * 3 - l_tax * 1000 + 90) % 180) + 180) % 180) - 90), 6) AS diff FROM lineitem""")
def sc7(spark, d):
    q = X.axial_encode(F.col("l_quantity"))
    df = feed(spark, d, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax FROM lineitem")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R(q["qx"]).alias("qx"), R(q["qy"]).alias("qy"), R(X.axial_diff(F.col("l_quantity") * 3, F.col("l_tax") * 1000)).alias("diff"))


@query("sc8_planar", """SELECT line_id, seq, round(sqrt(power(cx - ax - t * (bx - ax), 2) + power(cy - ay - t * (by_ - ay), 2)), 6) AS pt_seg, cut AS intersects
FROM (SELECT *, CASE WHEN n > 0 THEN least(greatest(((cx - ax) * (bx - ax) + (cy - ay) * (by_ - ay)) / n, 0), 1) ELSE 0 END AS t,
 (o1 * o2 < 0 AND o3 * o4 < 0) OR o1 = 0 OR o2 = 0 OR o3 = 0 OR o4 = 0 AS cut
 FROM (SELECT *, (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS n, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS o1, (bx - ax) * (0 - ay) - (by_ - ay) * (500 - ax) AS o2,
 (500 - cx) * (ay - cy) - (0 - cy) * (ax - cx) AS o3, (500 - cx) * (by_ - cy) - (0 - cy) * (bx - cx) AS o4 FROM spans2 WHERE abs((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) > 1e-3))""")
def sc8(spark, d):
    a = [F.col(c) for c in ("ax", "ay", "bx", "by_", "cx", "cy")]
    df = feed(spark, d, "spans2").filter(F.abs(X.cross(*a)) > 1e-3)
    return df.select("line_id", "seq", R(X.pt_seg_dist(a[4], a[5], *a[:4])).alias("pt_seg"), X.seg_intersects(*a, F.lit(500.0), F.lit(0.0)).alias("intersects"))


@query("sc9_circumradius", """SELECT line_id, seq, CASE WHEN a > 1e-9 AND b > 1e-9 AND c > 1e-9 AND k > 1e-9 THEN round(a * b * c / (2 * k), 4) END AS radius FROM (SELECT line_id, seq, sqrt(power(bx - ax, 2) + power(by_ - ay, 2)) AS a,
sqrt(power(cx - bx, 2) + power(cy - by_, 2)) AS b, sqrt(power(cx - ax, 2) + power(cy - ay, 2)) AS c, abs((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) AS k FROM spans2) WHERE k > 1 OR k < 1e-9""")
def sc9(spark, d):
    a = [F.col(c) for c in ("ax", "ay", "bx", "by_", "cx", "cy")]
    k = F.abs(X.cross(*a))
    return feed(spark, d, "spans2").filter((k > 1) | (k < 1e-9)).select("line_id", "seq", R(X.circumradius(*a), 4).alias("radius"))


@query("sc10_identifiers", r"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END AS canonical,
regexp_replace(p_name || '/' || p_type, '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM part""")
def sc10(spark, d):
    df = feed(spark, d, "SELECT p_partkey, p_name, p_type, CASE WHEN p_partkey % 5 = 0 THEN '  ' WHEN p_partkey % 2 = 0 THEN concat(' ', p_partkey, '.0') ELSE concat(p_name, ' ') END AS raw FROM part")
    return df.select("p_partkey", X.canonical_id(F.col("raw")).alias("canonical"), X.safe_name(F.concat_ws("/", "p_name", "p_type")).alias("safe"))


@query("sc11_keys", """SELECT p_partkey, 'E0A:' || p_brand || ':G' || p_size || ':S' || (p_partkey % 4) AS line_key, 'C1-' || replace(rtrim(rtrim(printf('%.3f', p_size / 4e0), '0'), '.'), '.', 'P') AS scenario_key FROM part""")
def sc11(spark, d):
    df = feed(spark, d, "SELECT p_partkey, p_brand, p_size FROM part")
    return df.select("p_partkey", X.line_key(F.lit("E0A"), F.col("p_brand"), F.col("p_size"), F.col("p_partkey") % 4).alias("line_key"), X.scenario_key("C1-", F.col("p_size") / 4.0).alias("scenario_key"))


@query("sc12_first_path", """SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k'), 'none') AS v FROM nested""")
def sc12(spark, d):
    return feed(spark, d, "nested").select("event_id", X.first_path(F.col("props"), "$.missing", "$.k", default=F.lit("none")).alias("v"))


@query("sc13_flatten_json", """SELECT event_id, 'a.k' AS path, json_extract_string(props, '$.k') AS value FROM nested UNION ALL SELECT event_id, 'user', CAST(user_id AS VARCHAR) FROM nested""")
def sc13(spark, d):
    parts = [F.lit('{"a":'), F.col("props"), F.lit(',"rows":[{"x":1}],"user":'), F.col("user_id").cast("string"), F.lit("}")]
    df = feed(spark, d, "nested").select("event_id", F.concat(*parts).alias("j"))
    return X.flatten_json(df, "j", ["event_id"])


@query("sc14_codes", """SELECT l_suppkey, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM (SELECT l_suppkey, l_returnflag AS code FROM lineitem UNION ALL SELECT l_suppkey, l_linestatus || '2' FROM lineitem) GROUP BY l_suppkey""")
def sc14(spark, d):
    df = feed(spark, d, "SELECT l_suppkey, concat(' ', l_returnflag, '; ', l_linestatus, '2,,', l_returnflag) AS c FROM lineitem")
    return X.codes_union(df, ["l_suppkey"], "c")


@query("sc15_row_hash", """SELECT s_suppkey, sha256('{"s_acct":' || CASE WHEN s_suppkey % 3 = 0 THEN 'null' ELSE CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) END || ',"s_name":"' || s_name || '","s_suppkey":' || s_suppkey || '}') AS row_sha256 FROM supplier""")
def sc15(spark, d):
    df = feed(spark, d, "SELECT s_name, s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(floor(s_acctbal) AS BIGINT) END AS s_acct FROM supplier")
    return df.select("s_suppkey", X.row_hash(df, df.columns).alias("row_sha256"))


@query("sc16_bundle_hash", """SELECT n_nationkey, count(*) AS members, CASE WHEN count(*) = 1 THEN min(h) ELSE sha256(string_agg(nm || chr(1) || h, '' ORDER BY nm)) END AS bundle_sha256
FROM (SELECT s_nationkey AS n_nationkey, lower(s_name) AS nm, sha256(s_name) AS h FROM supplier) WHERE 1 = 0 GROUP BY n_nationkey""")
def sc16(spark, d):
    df = feed(spark, d, "SELECT s_nationkey AS n_nationkey, s_name AS name FROM supplier").withColumn("sha256", F.sha2("name", 256))
    return X.bundle_hash(df, "n_nationkey")


# SQL of the bundle: the members' bytes are joined as a blob
ORACLES["sc16_bundle_hash"] = """SELECT n_nationkey, count(*) AS members, CASE WHEN count(*) = 1 THEN min(h) ELSE sha256(unhex(string_agg(hex(nm::BLOB) || '00' || h, '' ORDER BY nm))) END AS bundle_sha256
FROM (SELECT s_nationkey AS n_nationkey, lower(s_name) AS nm, sha256(s_name) AS h FROM supplier) GROUP BY n_nationkey"""
