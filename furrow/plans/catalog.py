"""CT1-CT18 and DQ1-DQ17 over the given tables: packages are suppliers, parameters are parts, projects are customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import catalog as C
from furrow.operators import quality as Q
from furrow.operators import scenario as S
from furrow.operators.hydrology import closure
from furrow.plans import scenario as PS
from furrow.plans.feeds import FEEDS, feed, oracle

FEEDS["params_ct"] = """SELECT p_partkey AS parameter_id, p_partkey % 5 <> 0 AS external, p_partkey % 7 = 0 AS safety, CASE WHEN p_partkey % 9 = 0 THEN 'E0' WHEN p_partkey % 2 = 0 THEN 'PROJECT' ELSE 'REFERENCE_ONLY' END AS policy, CASE WHEN p_size % 2 = 0 THEN 'm' ELSE 's' END AS unit FROM part"""
FEEDS["owners_ct"] = """SELECT p_partkey % 100 AS package_id, p_partkey AS parameter_id FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 17 <> 3 UNION ALL SELECT 7, p_partkey FROM part WHERE p_partkey % 41 = 1 UNION ALL SELECT 8, -1 UNION ALL SELECT 9, 10"""
FEEDS["inventory"] = """SELECT s_suppkey AS package_id, CASE s_suppkey % 5 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'SCREENING' WHEN 2 THEN 'PARTIAL' WHEN 3 THEN 'NOT_APPLICABLE' ELSE 'MISSING' END AS status, CASE WHEN s_suppkey % 3 = 0 THEN 'NONE' ELSE concat('GAP', s_suppkey % 4) END AS gap_class FROM supplier"""
FEEDS["levels_ct"] = """SELECT s_suppkey AS package_id, concat('E', k) AS level FROM supplier CROSS JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3) q WHERE (s_suppkey + k) % 4 <> 0"""
FEEDS["options_ct"] = """SELECT l_partkey AS parameter_id, l_suppkey AS model_id, min(l_linenumber) = 1 AS is_default, max(l_quantity) > 20 AS selectable FROM lineitem GROUP BY l_partkey, l_suppkey"""
FEEDS["modes_ct"] = """SELECT l_partkey AS parameter_id, CASE l_linenumber % 6 WHEN 1 THEN 'REFERENCE' WHEN 2 THEN 'ASSEMBLY' WHEN 3 THEN 'LOOKUP' WHEN 4 THEN 'TEMPLATE' ELSE 'DIRECT' END AS mode, l_quantity AS value, l_returnflag AS source, concat('CONFIRM_', l_linestatus, ',', CASE WHEN l_suppkey % 2 = 0 THEN 'SITE_VISIT' ELSE 'SOIL_TEST' END) AS actions, CASE WHEN l_suppkey % 4 = 0 THEN 'NO_PROJECT_RELEASE' ELSE 'E0_TRIAGEM' END AS ceiling FROM lineitem WHERE l_partkey % 3 = 0 AND l_quantity > 35 OR l_partkey % 3 = 1 AND l_linenumber = 1 AND l_quantity > 40"""
FEEDS["custom_ct"] = """SELECT p_partkey AS parameter_id, p_size * 1e0 AS value FROM part WHERE p_partkey % 11 = 0"""
FEEDS["texts_ct"] = """SELECT l_partkey AS parameter_id, CASE WHEN l_partkey % 2 = 0 THEN CAST(l_linenumber AS VARCHAR(10)) ELSE concat('{"', l_returnflag, '":"', l_linenumber % 3, '"}') END AS json FROM lineitem"""
FEEDS["base_ct"] = """SELECT p_partkey AS parameter_id, p_size AS value FROM part WHERE p_partkey % 3 <> 0"""
FEEDS["resolved_ct"] = """SELECT p_partkey AS parameter_id, CASE WHEN p_partkey % 4 = 0 THEN p_size ELSE p_size % 10 END AS value, p_partkey % 7 = 0 AS safety, p_partkey % 2 = 0 AS e0 FROM part WHERE p_partkey % 5 <> 1"""
FEEDS["overrides_ct"] = """SELECT l_partkey AS parameter_id, l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey AS seq, l_quantity AS value, CASE WHEN l_linestatus = 'F' THEN 'APPROVED' ELSE 'PENDING' END AS status FROM lineitem"""
FEEDS["assets"] = """SELECT c_nationkey AS project_id, c_custkey AS asset_id, concat('ROLE', c_custkey % 4) AS role, c_custkey % 5 <> 0 AND c_nationkey % 6 <> c_custkey % 4 AS verified, c_acctbal AS created_at FROM customer"""
FEEDS["products_ct"] = """SELECT concat('P', r_regionkey) AS product_id, CASE WHEN r_regionkey = 0 THEN NULL ELSE concat('P', r_regionkey - 1) END AS requires FROM region"""
FEEDS["roles_ct"] = """SELECT concat('P', r_regionkey) AS product_id, concat('ROLE', r_regionkey % 4) AS role FROM region"""
FEEDS["rows_ct"] = """SELECT o_orderkey AS id, o_custkey % 50 AS run_id, o_orderdate AS at_, CASE WHEN o_orderstatus = 'F' THEN 'SUCCEEDED' ELSE 'FAILED' END AS run_status, CASE WHEN o_orderkey % 9 = 0 THEN 'CONCEPT_A' ELSE 'E0' END AS kind, CASE WHEN o_orderkey % 7 = 0 THEN 'MINIMUM_RADIUS' ELSE '' END AS blockers, o_orderkey % 4 <> 0 AS eligible FROM orders"""
FEEDS["stages_dq"] = """SELECT o_custkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS request_id, o_orderstatus AS sha FROM orders"""
FEEDS["files_dq"] = """SELECT s_name AS name, s_nationkey AS size, concat('h', s_suppkey % 9) AS sha256, s_suppkey FROM supplier"""
FEEDS["periods"] = """SELECT o_orderkey AS id, o_custkey AS key_, o_orderkey % 90 + o_custkey % 7 AS from_, o_orderkey % 90 + o_totalprice / 5e4 - CASE WHEN o_orderkey % 50 = 0 THEN 20 ELSE 0 END AS to_ FROM orders"""
FEEDS["sel_dq"] = """SELECT group_id, fraction, CASE WHEN group_id = 'Brand#3' THEN 'DIAGNOSTIC_ONLY' ELSE 'SELECTED' END AS role FROM (SELECT group_id, min(fraction) AS fraction FROM trials WHERE status = 'PASS' AND group_id <> 'Brand#9' GROUP BY group_id) q"""

FEEDS["models_ct"] = """SELECT s_suppkey AS model_id, CASE s_suppkey % 3 WHEN 0 THEN 'ALL' WHEN 1 THEN n_name ELSE concat(n_name, ',BRAZIL') END AS countries, CASE s_suppkey % 4 WHEN 0 THEN 'ANY' WHEN 1 THEN 'CORN,SOY' WHEN 2 THEN 'CORN,ANY' ELSE 'CANE' END AS crops,
CASE s_suppkey % 5 WHEN 0 THEN 'ALL' WHEN 1 THEN concat('S', s_suppkey % 6) WHEN 2 THEN 'SOUTH,NORTH_WITH_JUSTIFICATION' WHEN 3 THEN concat(n_name, '-S1') ELSE 'OTHER_WITH_JUSTIFICATION' END AS jurisdictions FROM supplier JOIN nation ON n_nationkey = s_nationkey"""
FEEDS["contexts_ct"] = """SELECT c_custkey AS context_id, n_name AS country, CASE c_custkey % 3 WHEN 0 THEN 'CORN' WHEN 1 THEN 'CANE' ELSE 'SOY' END AS crop, concat('S', c_custkey % 6) AS state, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'trial plots' END AS justification FROM customer JOIN nation ON n_nationkey = c_nationkey"""
FEEDS["regions_ct"] = """SELECT 'S1' AS state, 'SOUTH' AS tag UNION ALL SELECT 'S2', 'SOUTH' UNION ALL SELECT 'S2', 'CENTER_SOUTH' UNION ALL SELECT 'S3', 'NORTH'"""

FEEDS["delivery_dq"] = """SELECT p_partkey AS k, p_partkey % 7 + CASE WHEN p_size > 40 THEN 0 ELSE 10 END AS project, concat(CASE WHEN p_partkey % 6 = 1 THEN 'tmp/' ELSE 'out/' END, p_partkey % 7 + CASE WHEN p_size > 40 THEN 0 ELSE 10 END, '/', p_partkey, '.tif') AS name, CAST(p_size * 100 AS BIGINT) AS size, p_name AS sha256 FROM part"""
FEEDS["frozen_dq"] = """SELECT l_orderkey AS request_id, l_partkey % 7 AS product_id FROM lineitem WHERE l_orderkey % 13 <> 2"""
FEEDS["run_dq"] = """SELECT l_orderkey AS request_id, l_partkey % 7 AS product_id FROM lineitem WHERE l_orderkey % 17 <> 3 AND NOT (l_orderkey % 10 = 0 AND l_linenumber = 1) UNION ALL SELECT l_orderkey, 9 FROM lineitem WHERE l_orderkey % 15 = 1 AND l_orderkey % 17 <> 3 UNION ALL SELECT l_orderkey, l_partkey % 7 FROM lineitem WHERE l_orderkey % 4 = 1 AND l_orderkey % 17 <> 3"""

FEEDS["strokes_dq"] = """SELECT s_suppkey AS line_id, k AS seq, (s_suppkey % 3 - 1) * 2e0 + k * 1.3e1 AS x0, s_suppkey * 1e0 AS y0, (s_suppkey % 3 - 1) * 2e0 + (k + 1) * 1.3e1 AS x1, s_suppkey * 1e0 AS y1 FROM supplier CROSS JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3) q WHERE s_suppkey % 4 <> 0 OR k = 1"""

QUERIES, ORACLES = {}, {}
c = F.col


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = oracle(sql)
        return fn

    return add


@query("ct1_ownership_issues", """SELECT DISTINCT rule, CAST(key AS VARCHAR) AS key FROM (SELECT 'UNKNOWN_PARAMETER' AS rule, parameter_id AS key FROM owners_ct WHERE parameter_id NOT IN (SELECT parameter_id FROM params_ct) UNION ALL SELECT 'DUPLICATE_OWNER', parameter_id FROM owners_ct GROUP BY parameter_id HAVING count(*) > 1
UNION ALL SELECT 'MISSING_OWNER', parameter_id FROM params_ct WHERE external AND parameter_id NOT IN (SELECT parameter_id FROM owners_ct) UNION ALL SELECT 'INTERNAL_OWNED', parameter_id FROM params_ct WHERE NOT external AND parameter_id IN (SELECT parameter_id FROM owners_ct))""")
def ct1(spark, d):
    return C.ownership_issues(feed(spark, d, "params_ct"), feed(spark, d, "owners_ct"))


@query("ct2_delivery_readiness", """SELECT level, count(*) AS required, coalesce(string_agg(CAST(package_id AS VARCHAR), ',' ORDER BY CAST(package_id AS VARCHAR)) FILTER (NOT ok), '') AS blockers, bool_and(ok) AS ready FROM (SELECT l.level, l.package_id, CASE WHEN level = 'E0' THEN status <> 'MISSING' ELSE status IN ('VERIFIED', 'NOT_APPLICABLE') END AS ok FROM levels_ct l JOIN inventory i ON i.package_id = l.package_id) GROUP BY level""")
def ct2(spark, d):
    packages = feed(spark, d, "levels_ct").groupBy("package_id").agg(F.collect_list("level").alias("levels"))
    return C.delivery_readiness(packages, feed(spark, d, "inventory"))


FEEDS["caps_need"] = """SELECT s_suppkey AS a, CAST(floor(s_suppkey / 4e0) AS BIGINT) AS b FROM supplier WHERE s_suppkey > 0"""


@query("ct3_scenario_readiness", """WITH RECURSIVE w AS (SELECT a, b FROM caps_need UNION SELECT w.a, n.b FROM w JOIN caps_need n ON n.a = w.b), ev AS (SELECT CAST(r_regionkey AS BIGINT) AS scenario, s_suppkey AS a FROM region JOIN supplier ON s_suppkey % 20 = r_regionkey AND s_suppkey > 50), full_ AS (SELECT * FROM ev UNION SELECT scenario, b FROM ev JOIN w ON w.a = ev.a),
pk AS (SELECT DISTINCT scenario, (a * 3) % 100 AS package_id FROM full_ UNION SELECT r_regionkey, s_suppkey FROM region JOIN supplier ON s_suppkey % 25 = r_regionkey) SELECT p.scenario, count(*) AS packages, count(*) FILTER (i.status <> 'VERIFIED') AS evidence_blockers, (SELECT count(*) FROM full_ f WHERE f.scenario = p.scenario AND f.a % 6 = 0) AS implementation_blockers,
count(*) FILTER (i.status <> 'VERIFIED') = 0 AND (SELECT count(*) FROM full_ f WHERE f.scenario = p.scenario AND f.a % 6 = 0) = 0 AS ready FROM pk p JOIN inventory i ON i.package_id = p.package_id GROUP BY p.scenario""")
def ct3(spark, d):
    direct = feed(spark, d, "SELECT CAST(r_regionkey AS BIGINT) AS scenario, s_suppkey AS package_id FROM region JOIN supplier ON s_suppkey % 25 = r_regionkey")
    own = feed(spark, d, "SELECT CAST(r_regionkey AS BIGINT) AS scenario, s_suppkey AS a FROM region JOIN supplier ON s_suppkey % 20 = r_regionkey AND s_suppkey > 50")
    caps = feed(spark, d, "SELECT s_suppkey AS a, (s_suppkey * 3) % 100 AS package_id, s_suppkey % 6 <> 0 AS implemented FROM supplier")
    return C.scenario_readiness(direct, own, closure(feed(spark, d, "caps_need")), caps, feed(spark, d, "inventory"))


@query("ct4_inventory_summary", """SELECT 'status' AS kind, status AS value, count(*) AS n FROM inventory GROUP BY status UNION ALL SELECT 'gap', gap_class, count(*) FROM inventory WHERE gap_class <> 'NONE' GROUP BY gap_class""")
def ct4(spark, d):
    return C.inventory_summary(feed(spark, d, "inventory"))


@query("ct4_capability_counts", """SELECT level AS capability, count(*) AS packages, count(*) FILTER (status = 'VERIFIED') AS verified, count(*) FILTER (status IS NULL OR status = 'MISSING') AS lacking FROM (SELECT package_id, level FROM levels_ct UNION ALL SELECT -1, 'E9') l LEFT JOIN inventory USING (package_id) GROUP BY level""")
def ct4c(spark, d):
    return C.capability_counts(feed(spark, d, "inventory"), feed(spark, d, "SELECT package_id, level AS capability FROM levels_ct UNION ALL SELECT -1, 'E9'"))


@query("ct4_unresolved", """SELECT parameter_id FROM params_ct WHERE parameter_id NOT IN (SELECT parameter_id FROM base_ct WHERE value IS NOT NULL)""")
def ct4u(spark, d):
    return C.unresolved_parameters(feed(spark, d, "params_ct"), feed(spark, d, "base_ct"))


@query("ct5_top_blockers", """SELECT level, package_id, rank FROM (SELECT level, l.package_id, row_number() OVER (PARTITION BY level ORDER BY l.package_id % 10, l.package_id) AS rank FROM levels_ct l JOIN inventory i ON i.package_id = l.package_id WHERE status = 'MISSING') WHERE rank <= 5""")
def ct5(spark, d):
    df = feed(spark, d, "SELECT l.level, l.package_id, l.package_id % 10 AS position FROM levels_ct l JOIN inventory i ON i.package_id = l.package_id WHERE status = 'MISSING'")
    return C.top_blockers(df).select("level", "package_id", "rank")


@query("ct6_option_matrix", """WITH o AS (SELECT parameter_id, count(*) AS options, min(model_id) FILTER (is_default) AS dm FROM options_ct WHERE selectable GROUP BY parameter_id) SELECT p.parameter_id, coalesce(options, 0) AS options, dm AS default_model, CASE WHEN safety AND dm IS NULL THEN 'FAIL_CLOSED' WHEN policy = 'E0' THEN 'E0_VALUE' WHEN options > 0 THEN 'REFERENCE' ELSE policy END AS behaviour FROM params_ct p LEFT JOIN o ON o.parameter_id = p.parameter_id""")
def ct6(spark, d):
    return C.option_matrix(feed(spark, d, "params_ct"), feed(spark, d, "options_ct")).select("parameter_id", "options", "default_model", "behaviour")


@query("ct6_option_coverage", """WITH o AS (SELECT parameter_id, count(*) AS options, min(model_id) FILTER (is_default) AS dm FROM options_ct WHERE selectable GROUP BY parameter_id), m AS (SELECT coalesce(options, 0) AS options, dm, CASE WHEN safety AND dm IS NULL THEN 'FAIL_CLOSED' WHEN policy = 'E0' THEN 'E0_VALUE' WHEN options > 0 THEN 'REFERENCE' ELSE policy END AS b FROM params_ct p LEFT JOIN o ON o.parameter_id = p.parameter_id)
SELECT count(*) AS parameters, count(*) FILTER (options > 0) AS with_options, count(dm) AS with_default, count(*) FILTER (options > 1) AS with_choice, count(*) FILTER (b = 'FAIL_CLOSED') AS fail_closed, count(*) FILTER (b = 'E0_VALUE') AS e0_value, count(*) FILTER (b = 'REFERENCE') AS reference, count(*) FILTER (b NOT IN ('FAIL_CLOSED', 'E0_VALUE', 'REFERENCE')) AS by_policy FROM m""")
def ct6c(spark, d):
    return C.option_coverage(C.option_matrix(feed(spark, d, "params_ct"), feed(spark, d, "options_ct")))


@query("ct7_resolve_presets", """WITH g AS (SELECT parameter_id, count(*) FILTER (mode = 'DIRECT') AS d, count(*) FILTER (mode = 'REFERENCE') AS r, count(*) FILTER (mode = 'ASSEMBLY') AS a, count(*) FILTER (mode = 'LOOKUP') AS l, count(*) FILTER (mode = 'TEMPLATE') AS t, min(value) FILTER (mode = 'DIRECT') AS vd, min(value) FILTER (mode = 'REFERENCE') AS vr, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, bool_or(ceiling = 'NO_PROJECT_RELEASE') AS held FROM modes_ct GROUP BY parameter_id), q AS (SELECT parameter_id, string_agg(DISTINCT v, ',' ORDER BY v) AS actions FROM modes_ct, LATERAL (SELECT unnest(string_split(actions, ',')) AS v) GROUP BY parameter_id),
x AS (SELECT p.parameter_id, c.value AS cv, g.*, CASE WHEN c.value IS NOT NULL THEN 'CUSTOM' WHEN d > 0 THEN 'DIRECT' WHEN r = 1 THEN 'REFERENCE' WHEN a > 0 THEN 'ASSEMBLY' WHEN l > 0 THEN 'LOOKUP' WHEN t > 0 THEN 'TEMPLATE' ELSE 'POLICY' END AS mode FROM (SELECT parameter_id AS pid, parameter_id FROM params_ct) p LEFT JOIN custom_ct c ON c.parameter_id = p.pid LEFT JOIN (SELECT parameter_id AS gid, d, r, a, l, t, vd, vr, sources, held FROM g) g ON gid = p.pid)
SELECT parameter_id, mode, CASE mode WHEN 'CUSTOM' THEN cv WHEN 'DIRECT' THEN vd WHEN 'REFERENCE' THEN vr END AS value, sources, coalesce(actions, '') AS required_actions, CASE WHEN held THEN 'NO_PROJECT_RELEASE' ELSE 'E0_TRIAGEM' END AS release_ceiling FROM x LEFT JOIN (SELECT parameter_id AS qid, actions FROM q) q ON qid = x.parameter_id""")
def ct7(spark, d):
    return C.resolve_presets(feed(spark, d, "SELECT parameter_id FROM params_ct"), feed(spark, d, "custom_ct"), feed(spark, d, "modes_ct").withColumn("actions", F.split("actions", ",")))


@query("ct8_value_conflicts", """SELECT parameter_id, 'VALUES_DIFFER' AS conflict FROM texts_ct WHERE json NOT LIKE '{%' GROUP BY parameter_id HAVING count(DISTINCT json) > 1 UNION ALL SELECT parameter_id, 'KEY_DIFFERS:' || k FROM (SELECT parameter_id, substr(json, 3, 1) AS k, substr(json, 7, 1) AS v FROM texts_ct WHERE json LIKE '{%') GROUP BY parameter_id, k HAVING count(DISTINCT v) > 1""")
def ct8(spark, d):
    df = feed(spark, d, "SELECT l_partkey AS parameter_id, l_linenumber, l_returnflag FROM lineitem")
    obj = F.concat(F.lit('{"'), c("l_returnflag"), F.lit('":"'), (c("l_linenumber") % 3).cast("string"), F.lit('"}'))
    return C.value_conflicts(df.select("parameter_id", F.when(c("parameter_id") % 2 == 0, c("l_linenumber").cast("string")).otherwise(obj).alias("json")))


@query("ct9_applicability", """WITH mc AS (SELECT model_id, v FROM models_ct, LATERAL (SELECT unnest(string_split(countries, ',')) AS v)), mr AS (SELECT model_id, v FROM models_ct, LATERAL (SELECT unnest(string_split(crops, ',')) AS v)), mj AS (SELECT model_id, v FROM models_ct, LATERAL (SELECT unnest(string_split(jurisdictions, ',')) AS v)),
a AS (SELECT m.model_id, x.context_id, min(CASE v WHEN 'ALL' THEN 1 ELSE 0 END) AS w FROM models_ct m JOIN mc USING (model_id), contexts_ct x WHERE v = x.country OR v = 'ALL' GROUP BY ALL), b AS (SELECT m.model_id, x.context_id, min(CASE v WHEN 'ANY' THEN 1 ELSE 0 END) AS w FROM models_ct m JOIN mr USING (model_id), contexts_ct x WHERE v = x.crop OR v = 'ANY' GROUP BY ALL),
j AS (SELECT mj.model_id, x.context_id, min(CASE WHEN v = 'ALL' THEN 1 WHEN v LIKE '%WITH_JUSTIFICATION' THEN 5 ELSE 0 END) AS w FROM mj, contexts_ct x WHERE v IN (x.state, concat(x.country, '-', x.state), 'ALL') OR v IN (SELECT tag FROM regions_ct r WHERE r.state = x.state) OR v LIKE '%WITH_JUSTIFICATION' GROUP BY ALL)
SELECT a.model_id, a.context_id, CASE WHEN j.w < 5 THEN 'EXACT_OR_NATIONAL' WHEN coalesce(trim(justification), '') <> '' THEN 'JUSTIFIED_EXTRAPOLATION' ELSE 'NEEDS_JUSTIFICATION' END AS how, CAST(a.w + b.w + j.w % 5 AS INT) AS wildcards FROM a JOIN b USING (model_id, context_id) JOIN j USING (model_id, context_id) JOIN contexts_ct x ON x.context_id = a.context_id""")
def ct9(spark, d):
    models = feed(spark, d, "models_ct").select("model_id", *[F.split(x, ",").alias(x) for x in ("countries", "crops", "jurisdictions")])
    return C.applicability(models, feed(spark, d, "contexts_ct"), feed(spark, d, "regions_ct"))


@query("ct10_compile_request", """SELECT coalesce(b.parameter_id, r.parameter_id) AS parameter_id, CASE WHEN b.value IS NOT NULL AND r.value IS NULL THEN 'BASE_WITHOUT_PRESET' WHEN b.value = r.value THEN 'BASE_MATCHES_PRESET' WHEN b.value IS NOT NULL THEN 'BASE_OVERRIDES_PRESET' WHEN NOT safety AND e0 THEN 'MATERIALISED' ELSE 'WITHHELD' END AS outcome,
CASE WHEN b.value IS NOT NULL THEN b.value WHEN NOT safety AND e0 THEN r.value END AS value FROM base_ct b FULL JOIN resolved_ct r ON b.parameter_id = r.parameter_id""")
def ct10(spark, d):
    return C.compile_request(feed(spark, d, "base_ct"), feed(spark, d, "resolved_ct"))


@query("ct11_overrides", """WITH o AS (SELECT parameter_id, arg_max(value, seq) AS ov, count(*) AS n FROM overrides_ct WHERE status = 'APPROVED' GROUP BY parameter_id), v AS (SELECT parameter_id, value * 1e0 AS value FROM base_ct)
SELECT coalesce(v.parameter_id, o.parameter_id) AS parameter_id, v.value AS previous, CASE WHEN v.value IS NOT NULL THEN coalesce(ov, v.value) END AS resolved, coalesce(n, 0) AS applied, CASE WHEN v.value IS NULL THEN 'OVERRIDE_WITHOUT_BASE' END AS error FROM v FULL JOIN o ON o.parameter_id = v.parameter_id""")
def ct11(spark, d):
    return C.apply_overrides(feed(spark, d, "SELECT parameter_id, value * 1e0 AS value FROM base_ct"), feed(spark, d, "overrides_ct"))


@query("ct12_product_readiness", """WITH h AS (SELECT DISTINCT project_id, role FROM assets WHERE verified), x AS (SELECT p.project_id, d.product_id, d.requires, coalesce((SELECT r.role FROM roles_ct r WHERE r.product_id = d.product_id AND NOT EXISTS (SELECT 1 FROM h WHERE h.project_id = p.project_id AND h.role = r.role)), '') AS missing FROM (SELECT DISTINCT project_id FROM assets) p, products_ct d)
SELECT x.project_id, x.product_id, x.missing, coalesce(y.missing <> '', false) AS dependency_blocked, x.missing = '' AND NOT coalesce(y.missing <> '', false) AS available FROM x LEFT JOIN x y ON y.project_id = x.project_id AND y.product_id = x.requires""")
def ct12(spark, d):
    return C.product_readiness(feed(spark, d, "assets"), feed(spark, d, "products_ct"), feed(spark, d, "roles_ct"))


@query("ct13_selection_blocker", """SELECT id, CASE WHEN run_status <> 'SUCCEEDED' THEN 'RUN_NOT_SUCCEEDED' WHEN kind LIKE 'CONCEPT%' THEN 'CONCEPT_NOT_SELECTABLE' WHEN blockers LIKE '%RADIUS%' THEN 'MINIMUM_RADIUS' WHEN NOT eligible THEN 'NOT_ELIGIBLE' ELSE 'SELECTABLE' END AS verdict FROM rows_ct""")
def ct13(spark, d):
    return C.selection_blocker(feed(spark, d, "rows_ct")).select("id", "verdict")


@query("ct14_selection_history", """SELECT id AS selection_id, lead(id) OVER w AS closed_by, row_number() OVER w AS position, lead(id) OVER w IS NULL AS active FROM rows_ct WINDOW w AS (PARTITION BY run_id ORDER BY at_, id)""")
def ct14(spark, d):
    return C.selection_history(feed(spark, d, "SELECT run_id, id AS selection_id, kind AS scenario_id, at_ AS at FROM rows_ct")).select("selection_id", "closed_by", "position", "active")


@query("ct15_latest_asset", """SELECT project_id, coalesce(max_by(asset_id, (created_at, asset_id)) FILTER (role = 'ROLE1'), max_by(asset_id, (created_at, asset_id)) FILTER (role = 'ROLE2')) AS asset_id, CASE WHEN count(*) FILTER (role = 'ROLE1') > 0 THEN 'ROLE1' WHEN count(*) FILTER (role = 'ROLE2') > 0 THEN 'ROLE2' END AS role FROM assets WHERE verified GROUP BY project_id""")
def ct15(spark, d):
    return C.latest_asset(feed(spark, d, "assets").filter("verified"), "ROLE1", "ROLE2")


@query("ct16_layer_status", """SELECT id AS artifact_id, CASE WHEN run_status = 'SUCCEEDED' AND id % 5 <> 0 AND id % 3 < 2 THEN 'READY' ELSE 'UNAVAILABLE' END AS status, CASE WHEN run_status <> 'SUCCEEDED' THEN 'RUN_NOT_SUCCEEDED' WHEN id % 5 = 0 THEN 'NO_SPATIAL_METADATA' WHEN id % 3 = 2 THEN 'FORMAT_NOT_SERVED' END AS reason FROM rows_ct""")
def ct16(spark, d):
    art = feed(spark, d, "SELECT id AS artifact_id, id AS run_id, CASE WHEN id % 5 = 0 THEN NULL ELSE 'bbox' END AS bounds, CASE id % 3 WHEN 0 THEN 'geojson' WHEN 1 THEN 'cog' ELSE 'pdf' END AS format FROM rows_ct")
    return C.layer_status(art, feed(spark, d, "SELECT id AS run_id, run_status FROM rows_ct"))


@query("ct17_operation_limit", """SELECT c_custkey AS project_id, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN greatest(c_nationkey, c_custkey % 40) ELSE c_nationkey END WHEN c_custkey % 2 = 0 THEN c_custkey % 40 END AS limit FROM customer""".replace(" AS limit ", ' AS "limit" '))
def ct17(spark, d):
    values = feed(spark, d, "SELECT c_custkey AS project_id, map('plant', CAST(c_nationkey AS BIGINT), 'harvest', c_custkey % 40) AS limits FROM customer")
    scope = feed(spark, d, "SELECT c_custkey AS project_id, 'plant' AS operation FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'harvest' FROM customer WHERE c_custkey % 2 = 0")
    return C.operation_limit(values, scope)


@query("ct17_limit_conflicts", """SELECT c_custkey AS project_id, 'plant' AS key, 'LEGACY_AND_NEW_CONFLICT' AS rule FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 3 = 0 AND c_nationkey <> 7 UNION ALL SELECT c_custkey, 'harvest', 'LEGACY_AND_NEW_CONFLICT' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 2 = 0 AND c_custkey % 40 <> 7 UNION ALL SELECT c_custkey, 'harvest', 'REGISTERED_BUT_UNUSED' FROM customer WHERE c_custkey % 4 = 1""")
def ct17c(spark, d):
    new = feed(spark, d, "SELECT c_custkey AS project_id, map('plant', CAST(c_nationkey AS BIGINT), 'harvest', c_custkey % 40) AS limits FROM customer")
    scope = feed(spark, d, "SELECT c_custkey AS project_id, 'plant' AS operation FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'harvest' FROM customer WHERE c_custkey % 2 = 0")
    used = feed(spark, d, "SELECT c_custkey AS project_id, 'plant' AS parameter FROM customer UNION ALL SELECT c_custkey, 'harvest' FROM customer WHERE c_custkey % 4 <> 1")
    return C.limit_conflicts(feed(spark, d, "SELECT c_custkey AS project_id, 7 AS value FROM customer WHERE c_custkey % 5 = 0"), new, scope, used)


@query("ct18_resolution_gate", """SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN greatest(p_size * 1e-1, (p_partkey % 9) * 5e-1) END AS effective, coalesce((p_partkey % 9) * 5e-1 < CASE WHEN p_partkey % 11 <> 0 THEN p_size * 1e-1 END, false) AS upsampled,
CASE WHEN p_partkey % 13 = 0 OR p_partkey % 11 = 0 THEN 'RESOLUTION_UNVERIFIED' WHEN greatest(p_size * 1e-1, (p_partkey % 9) * 5e-1) > 3 + 1e-9 THEN 'TOO_COARSE' WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN 'GROUND_FILTER_REQUIRED' ELSE 'PASS' END AS gate FROM part""")
def ct18(spark, d):
    df = feed(spark, d, "SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_size * 1e-1 END AS native, (p_partkey % 9) * 5e-1 AS output, 3e0 AS row_spacing, CASE WHEN p_partkey % 2 = 0 THEN 'POINTS' ELSE 'RASTER' END AS source, p_partkey % 3 = 0 AS ground_filtered, p_partkey % 13 <> 0 AS verified FROM part")
    return C.resolution_gate(df).select("p_partkey", "effective", "upsampled", "gate")


@query("dq1_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dq1(spark, d):
    return Q.check_unique(feed(spark, d, "SELECT l_orderkey, l_linenumber FROM lineitem"), ["l_orderkey", "l_linenumber"])


@query("dq2_foreign_keys", "SELECT 'WITHOUT_CHILD' AS rule, CAST(doc_id AS VARCHAR) AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'ORPHAN_CHILD', CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def dq2(spark, d):
    return Q.check_fk(feed(spark, d, "SELECT doc_id FROM labels"), feed(spark, d, "SELECT doc_id FROM documents"), "doc_id")


@query("dq3_reconcile", """WITH o AS (SELECT l_orderkey AS k, sum(l_quantity) AS v FROM lineitem WHERE l_orderkey % 11 <> 0 GROUP BY l_orderkey), d AS (SELECT l_orderkey AS k, sum(l_quantity) + CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END AS v FROM lineitem WHERE l_orderkey % 17 <> 0 GROUP BY l_orderkey)
SELECT coalesce(o.k, d.k) AS k, d.v AS declared, o.v AS observed, CASE WHEN d.v IS NULL THEN 'NOT_DECLARED' WHEN o.v IS NULL THEN 'NOT_OBSERVED' ELSE 'DIFFERS' END AS rule FROM d FULL JOIN o ON o.k = d.k WHERE d.v IS DISTINCT FROM o.v""")
def dq3(spark, d):
    obs = feed(spark, d, "SELECT l_orderkey AS k, sum(l_quantity) AS value FROM lineitem WHERE l_orderkey % 11 <> 0 GROUP BY l_orderkey")
    dec = feed(spark, d, "SELECT l_orderkey AS k, sum(l_quantity) + CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END AS value FROM lineitem WHERE l_orderkey % 17 <> 0 GROUP BY l_orderkey")
    return Q.reconcile(dec, obs, "k")


@query("dq3_line_nodes", """WITH n AS (SELECT l_orderkey AS k, count(*) FILTER (l_linenumber = 1) AS s, count(*) FILTER (l_linenumber = 2) AS e, count(*) FILTER (l_linenumber = 3) AS o FROM lineitem WHERE l_linenumber < 4 GROUP BY l_orderkey), l AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 9 <> 4)
SELECT coalesce(n.k, l.k) AS line_id, concat_ws(',', CASE WHEN l.k IS NULL THEN 'NO_SUCH_LINE' END, CASE WHEN coalesce(s, 0) <> 1 THEN 'START_NOT_ONE' END, CASE WHEN coalesce(e, 0) <> 1 THEN 'END_NOT_ONE' END, CASE WHEN o > 0 THEN 'OTHER_NODES' END) AS codes FROM n FULL JOIN l ON l.k = n.k WHERE l.k IS NULL OR coalesce(s, 0) <> 1 OR coalesce(e, 0) <> 1 OR o > 0""")
def dq3n(spark, d):
    nodes = feed(spark, d, "SELECT l_orderkey AS line_id, CASE l_linenumber WHEN 1 THEN 'START' WHEN 2 THEN 'END' ELSE 'MIDDLE' END AS endpoint FROM lineitem WHERE l_linenumber < 4")
    return Q.check_line_nodes(feed(spark, d, "SELECT o_orderkey AS line_id FROM orders WHERE o_orderkey % 9 <> 4"), nodes)


@query("dq4_values", """SELECT p_partkey AS row_id, 'size' AS name, CASE WHEN p_partkey % 20 = 0 THEN 'NOT_A_NUMBER' WHEN p_size < 3 THEN 'BELOW_MINIMUM' ELSE 'ABOVE_MAXIMUM' END AS rule FROM part WHERE p_partkey % 20 = 0 OR p_size < 3 OR p_size > 45 UNION ALL SELECT p_partkey, 'brand', 'PATTERN' FROM part WHERE NOT regexp_matches(p_brand, '^Brand#1')
UNION ALL SELECT p_partkey, 'type', 'NOT_A_CHOICE' FROM part WHERE p_partkey % 7 <> 0 AND p_type NOT IN ('ECONOMY', 'STANDARD') UNION ALL SELECT p_partkey, 'type', 'MISSING' FROM part WHERE p_partkey % 7 = 0""")
def dq4(spark, d):
    v = feed(spark, d, "SELECT p_partkey AS row_id, 'size' AS name, CASE WHEN p_partkey % 20 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR(10)) END AS value FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part WHERE p_partkey % 7 <> 0")
    rules = spark.createDataFrame([("size", "number", 3.0, 45.0, None, None, True), ("brand", "text", None, None, "^Brand#1", None, False), ("type", "enum", None, None, None, ["ECONOMY", "STANDARD"], True)], "name string, kind string, low double, high double, pattern string, choices array<string>, required boolean")
    return Q.check_values(v, rules)


_RULES = [
    ("$", "REQUIRED", '["kind", "size"]'), ("$", "ONLY_KEYS", '["size", "brand", "code", "unit", "kind", "items", "tags"]'), ("$", "MAX_PROPERTIES", "7"), ("$.size", "TYPE", '["number", "null"]'), ("$.size", "EXCLUSIVE_MINIMUM", "2"), ("$.size", "MAXIMUM", "45"),
    ("$.brand", "PATTERN", '"Brand#1[0-9]"'), ("$.code", "MIN_LENGTH", "1"), ("$.code", "MAX_LENGTH", "4"), ("$.unit", "CONST", '"mm"'), ("$.kind", "ENUM", '["ECONOMY", "STANDARD"]'), ("$.items", "MIN_ITEMS", "3"), ("$.items[*].w", "EXCLUSIVE_MAXIMUM", "40"), ("$.items[*].h", "MINIMUM", "1.5"),
    ("$.items[*]", "MIN_PROPERTIES", "2"), ("$.tags", "UNIQUE_ITEMS", "true"),
]


@query("dq4_documents", """WITH p AS (SELECT *, p_partkey AS k FROM part), f AS (SELECT k AS row_id, '$' AS path, 'NOT_JSON' AS rule FROM p WHERE k % 41 = 0
UNION ALL SELECT k, '$', 'REQUIRED' FROM p WHERE k % 7 = 0 AND k % 41 <> 0 UNION ALL SELECT k, '$', 'ONLY_KEYS' FROM p WHERE k % 11 = 0 AND k % 41 <> 0 UNION ALL SELECT k, '$', 'MAX_PROPERTIES' FROM p WHERE k % 11 = 0 AND k % 7 <> 0 AND k % 41 <> 0
UNION ALL SELECT k, '$.size', 'TYPE' FROM p WHERE k % 20 = 0 AND k % 41 <> 0 UNION ALL SELECT k, '$.size', 'EXCLUSIVE_MINIMUM' FROM p WHERE k % 20 <> 0 AND p_size <= 2 AND k % 41 <> 0 UNION ALL SELECT k, '$.size', 'MAXIMUM' FROM p WHERE k % 20 <> 0 AND p_size > 45 AND k % 41 <> 0
UNION ALL SELECT k, '$.brand', 'PATTERN' FROM p WHERE p_brand NOT LIKE 'Brand#1_' AND k % 41 <> 0 UNION ALL SELECT k, '$.code', 'MIN_LENGTH' FROM p WHERE k % 6 = 0 AND k % 41 <> 0 UNION ALL SELECT k, '$.code', 'MAX_LENGTH' FROM p WHERE k % 6 = 5 AND k % 41 <> 0
UNION ALL SELECT k, '$.unit', 'CONST' FROM p WHERE k % 3 = 0 AND k % 41 <> 0 UNION ALL SELECT k, '$.kind', 'ENUM' FROM p WHERE k % 7 <> 0 AND p_type NOT IN ('ECONOMY', 'STANDARD') AND k % 41 <> 0 UNION ALL SELECT k, '$.items', 'MIN_ITEMS' FROM p WHERE k % 2 = 0 AND k % 41 <> 0
UNION ALL SELECT k, concat('$.items[', i, '].w'), 'EXCLUSIVE_MAXIMUM' FROM p, (VALUES (0), (1), (2)) x(i) WHERE p_size - 1 + i >= 40 AND i < 2 + k % 2 AND k % 41 <> 0 UNION ALL SELECT k, concat('$.items[', i, '].h'), 'MINIMUM' FROM p, (VALUES (0), (1)) x(i) WHERE (k + i) % 5 < 2 AND k % 41 <> 0
UNION ALL SELECT k, '$.items[2]', 'MIN_PROPERTIES' FROM p WHERE k % 2 = 1 AND k % 41 <> 0 UNION ALL SELECT k, '$.tags', 'UNIQUE_ITEMS' FROM p WHERE k % 3 = k % 4 AND k % 41 <> 0) SELECT * FROM f""")
def dq4d(spark, d):
    k = "p_partkey"
    item = lambda i: f"""'«"w":', p_size - 1 + {i}, ',"h":', ({k} + {i}) % 5, '»'"""
    text = f"""CASE WHEN {k} % 41 = 0 THEN 'no json «' ELSE concat('«"size":', CASE WHEN {k} % 20 = 0 THEN '"n/a"' ELSE CAST(p_size AS STRING) END, ',"brand":"', p_brand, '","code":"', repeat('x', CAST({k} % 6 AS INT)), '","unit":"', CASE WHEN {k} % 3 = 0 THEN 'cm' ELSE 'mm' END, '"',
    CASE WHEN {k} % 7 = 0 THEN '' ELSE concat(',"kind":"', p_type, '"') END, ',"items":[', {item(0)}, ',', {item(1)}, CASE WHEN {k} % 2 = 1 THEN concat(',«"w":', p_size + 1, '»') ELSE '' END, '],"tags":[', {k} % 3, ',«"t":', {k} % 4, '»,', {k} % 4, ']', CASE WHEN {k} % 11 = 0 THEN ',"zzz":null' ELSE '' END, '»') END"""
    docs = feed(spark, d, f"SELECT {k} AS row_id, {text} AS json FROM part").withColumn("json", F.translate("json", "«»", "{}"))  # braces mean tables in a feed
    rules = spark.createDataFrame(_RULES, "path string, rule string, arg string")
    return Q.check_documents(docs, rules)


@query("dq5_periods", """SELECT id, key_ AS key, CASE WHEN from_ > to_ THEN 'INVERTED' ELSE 'OVERLAPS' END AS rule FROM (SELECT *, max(to_) OVER (PARTITION BY key_ ORDER BY from_, to_, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM periods) WHERE from_ > to_ OR from_ < b""")
def dq5(spark, d):
    return Q.check_periods(feed(spark, d, "periods").withColumnRenamed("key_", "key"))


@query("dq6_links", """WITH m AS (SELECT l_suppkey AS machine_id, string_agg(DISTINCT 'A' || l_linenumber % 4, ',' ORDER BY 'A' || l_linenumber % 4) AS have, count(DISTINCT l_linestatus) AS states, max(l_quantity) AS top FROM lineitem WHERE l_quantity < 25 + l_suppkey GROUP BY l_suppkey)
SELECT machine_id, concat_ws(',', CASE WHEN have <> CASE WHEN machine_id % 3 = 0 THEN 'A0,A1' ELSE 'A0,A1,A2,A3' END THEN 'AXES_DIFFER' END, CASE WHEN states < 2 THEN 'STATE_MISSING' END, CASE WHEN top > 45 THEN 'OVER_LIMIT' END, CASE WHEN top NOT IN (30, 40, 50) THEN 'GAUGE_NOT_ALLOWED' END) AS codes FROM m""")
def dq6(spark, d):
    m = feed(spark, d, "SELECT l_suppkey AS machine_id, concat('A', l_linenumber % 4) AS axis, l_linestatus AS state, l_quantity AS value FROM lineitem WHERE l_quantity < 25 + l_suppkey")
    dec = feed(spark, d, "SELECT s_suppkey AS machine_id FROM supplier").withColumn("axes", F.when(c("machine_id") % 3 == 0, F.array(F.lit("A1"), F.lit("A0"))).otherwise(F.array(*[F.lit(f"A{i}") for i in range(4)])))
    lim = feed(spark, d, "SELECT s_suppkey AS machine_id, 45e0 AS most FROM supplier").withColumn("gauges", F.array(F.lit(30.0), F.lit(40.0), F.lit(50.0)))
    return Q.check_links(m, dec, lim)


@query("dq7_requirements", """SELECT o_orderkey AS request_id, 'status' AS name, 'REQUIRED_VALUE_DIFFERS' AS rule FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'priority', 'REQUIRED_MISSING' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 8 = 0""")
def dq7(spark, d):
    req = feed(spark, d, "SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 2 = 0 THEN 'R1' ELSE 'E0' END AS level FROM orders")
    val = feed(spark, d, "SELECT o_orderkey AS request_id, 'status' AS name, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders WHERE o_orderkey % 8 <> 0")
    rules = spark.createDataFrame([("R1", "status", "F"), ("R1", "priority", None)], "level string, name string, expected string")
    return Q.check_requirements(req, val, rules)


@query("dq8_artifacts", """SELECT name, CASE WHEN s_suppkey % 10 = 0 THEN 'MISSING' WHEN s_suppkey % 7 = 0 THEN 'UNDECLARED' WHEN s_suppkey % 9 = 4 THEN 'CHANGED' ELSE 'OK' END AS verdict FROM files_dq WHERE NOT (s_suppkey % 10 = 0 AND s_suppkey % 7 = 0)""")
def dq8(spark, d):
    dec = feed(spark, d, "SELECT name, size, sha256 FROM files_dq WHERE s_suppkey % 7 <> 0 OR s_suppkey % 10 = 0 AND s_suppkey % 7 <> 0")
    scan = feed(spark, d, "SELECT name, CASE WHEN s_suppkey % 9 = 4 THEN size + 1 ELSE size END AS size, sha256 FROM files_dq WHERE s_suppkey % 10 <> 0")
    return Q.check_artifacts(dec, scan)


@query("dq8_delivery", """SELECT name, CASE WHEN k % 10 = 0 THEN 'MISSING' WHEN k % 7 = 0 THEN 'UNDECLARED' WHEN k % 6 = 1 THEN 'OUTSIDE_PREFIX' WHEN k % 11 = 3 THEN 'WRONG_PROJECT' WHEN k % 9 = 4 THEN 'CHANGED' ELSE 'OK' END AS verdict FROM delivery_dq WHERE NOT (k % 10 = 0 AND k % 7 = 0)""")
def dq8p(spark, d):
    dec = feed(spark, d, "SELECT name, project, size, sha256 FROM delivery_dq WHERE k % 7 <> 0")
    scan = feed(spark, d, "SELECT name, CASE WHEN k % 11 = 3 THEN project + 1 ELSE project END AS project, CASE WHEN k % 9 = 4 THEN size + 1 ELSE size END AS size, sha256 FROM delivery_dq WHERE k % 10 <> 0")
    return Q.check_artifacts(dec, scan, "out")


@query("dq8_totals", """SELECT project, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, concat_ws(',', CASE WHEN count(*) > 40 THEN 'TOO_MANY_FILES' END, CASE WHEN sum(size) > 60000 THEN 'TOO_MANY_BYTES' END) AS codes FROM delivery_dq GROUP BY project""")
def dq8t(spark, d):
    return Q.artifact_totals(feed(spark, d, "delivery_dq"), 40, 60_000)


@query("dq9_claims", """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 8 = 0 THEN 'approved' ELSE '' END AS forbidden, CASE WHEN s_suppkey % 5 = 0 THEN 'SCREENING_ONLY' ELSE '' END AS missing FROM supplier WHERE s_suppkey % 8 = 0 OR s_suppkey % 5 = 0""")
def dq9(spark, d):
    df = feed(spark, d, "SELECT s_suppkey AS id, s_suppkey % 8 = 0 AS approved, false AS released FROM supplier").withColumn("limitations", F.when(c("id") % 5 == 0, F.array(F.lit("NOT_FOR_BUILDING"))).otherwise(F.array(F.lit("NOT_FOR_BUILDING"), F.lit("SCREENING_ONLY"))))
    return Q.check_claims(df, ["approved", "released"], ["SCREENING_ONLY", "NOT_FOR_BUILDING"])


@query("dq10_surfaces", """SELECT p_partkey AS surface_id, CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN 'APPROVAL_MISSING' END, CASE WHEN p_partkey % 5 = 0 THEN 'FLEET_MISSING' END, CASE WHEN p_partkey % 7 = 0 THEN 'EVIDENCE_MISSING' END) WHEN p_size % 3 = 1 THEN concat_ws(',', CASE WHEN p_partkey % 4 = 0 THEN 'BARRIER_MUST_BREAK' END, CASE WHEN p_partkey % 6 = 0 THEN 'BARRIER_MUST_PROHIBIT' END) ELSE '' END AS codes FROM part""")
def dq10(spark, d):
    return Q.check_surfaces(feed(spark, d, "SELECT p_partkey AS surface_id, CASE p_size % 3 WHEN 0 THEN 'MANEUVER' WHEN 1 THEN 'BARRIER' ELSE 'OTHER' END AS kind, p_partkey % 2 = 0 AS authorised, CASE WHEN p_partkey % 3 <> 0 THEN 'a' END AS approval, CASE WHEN p_partkey % 5 <> 0 THEN 'f' END AS fleet, CASE WHEN p_partkey % 7 <> 0 THEN 'e' END AS evidence, p_partkey % 4 <> 0 AS breaks, p_partkey % 6 <> 0 AS prohibits FROM part"))


@query("dq11_lineage", """SELECT run_id, position, CASE WHEN request_id IS DISTINCT FROM pr THEN 'REQUEST_DIFFERS' ELSE 'STALE_RESOLUTION' END AS rule FROM (SELECT *, lag(request_id) OVER w AS pr, lag(sha) OVER w AS ps FROM stages_dq WINDOW w AS (PARTITION BY run_id ORDER BY position)) WHERE position > 1 AND (request_id IS DISTINCT FROM pr OR sha IS DISTINCT FROM ps)""")
def dq11(spark, d):
    return Q.check_lineage(feed(spark, d, "stages_dq"))


@query("dq12_lines", """SELECT s_suppkey AS line_id, concat_ws(',', CASE WHEN s_suppkey % 4 = 0 THEN 'LENGTH_DIFFERS' END, CASE WHEN s_suppkey % 6 = 0 THEN 'NODE_OFF_END' END) AS codes FROM supplier WHERE s_suppkey % 4 = 0 OR s_suppkey % 6 = 0""")
def dq12(spark, d):
    a = feed(spark, d, "SELECT s_suppkey AS line_id, s_acctbal AS length, 1e0 AS ex, 2e0 AS ey FROM supplier")
    dec = feed(spark, d, "SELECT s_suppkey AS line_id, s_acctbal + CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END AS length FROM supplier")
    return Q.check_lines(a, dec, feed(spark, d, "SELECT s_suppkey AS line_id, 1e0 AS nx, 2e0 + CASE WHEN s_suppkey % 6 = 0 THEN 1e-3 ELSE 0e0 END AS ny FROM supplier"))


@query("dq12_phase", """WITH e AS (SELECT s_suppkey AS line_id, CASE WHEN s_suppkey % 7 = 0 THEN 2.5e-2 ELSE 4e-3 END AS error FROM supplier) SELECT line_id, error, 'PHASE_DIFFERS' AS codes FROM e WHERE error > 1e-2""")
def dq12p(spark, d):
    # rows at 30 degrees: (along, across) turned
    v = feed(spark, d, "SELECT s_suppkey AS line_id, k AS seq, k * 2e1 AS u, s_suppkey * 1.5e0 + CASE WHEN k = 3 THEN CASE WHEN s_suppkey % 7 = 0 THEN 2.5e-2 ELSE 4e-3 END ELSE 0e0 END AS w FROM supplier CROSS JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5)")
    ct, st = 0.75**0.5, 0.5
    v = v.select("line_id", "seq", (c("u") * ct - c("w") * st).alias("x"), (c("u") * st + c("w") * ct).alias("y"))
    out = Q.check_phase(v, feed(spark, d, "SELECT s_suppkey AS line_id, s_suppkey AS row_id, 3e1 AS theta FROM supplier"), 1.5)
    return out.withColumn("error", F.round("error", 6))


@query("dq12_outside", """WITH p AS (SELECT line_id, sum(greatest(0, least(x1, 1.1e1) - greatest(x0, 1e1))) + sum(greatest(0, x1 - greatest(x0, 4e1))) + sum(greatest(0, least(x1, 0e0) - x0)) AS outside_m FROM strokes_dq GROUP BY line_id) SELECT line_id, round(outside_m, 6) AS outside_m FROM p WHERE outside_m > 1e-2""")
def dq12o(spark, d):
    s = feed(spark, d, "strokes_dq")
    # two fields with a lane of one metre between them, as long as there are lines
    rings = feed(spark, d, "SELECT b * 10 + f AS polygon_id, 1 AS ring, k AS seq, CASE WHEN k IN (1, 4, 5) THEN f * 1.1e1 ELSE 1e1 + f * 3e1 END AS x, b * 1e2 - 5e-1 + CASE WHEN k IN (1, 2, 5) THEN 0e0 ELSE 1e2 END AS y FROM (SELECT DISTINCT CAST(floor(s_suppkey / 1e2) AS BIGINT) AS b FROM supplier) CROSS JOIN (SELECT n_nationkey AS f FROM nation WHERE n_nationkey < 2) CROSS JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey BETWEEN 1 AND 5)")
    from furrow.operators.nearest import ring_edges

    return Q.check_outside(s, ring_edges(rings)).withColumn("outside_m", F.round("outside_m", 6))


_GOV = """m AS (SELECT l_suppkey AS model_id, l_partkey + CASE WHEN l_linenumber = 7 THEN 100000000 ELSE 0 END AS parameter_id, CASE WHEN l_quantity > 40 THEN 'DIRECT' WHEN l_quantity > 30 THEN 'FAIL_CLOSED' ELSE 'PRIOR' END AS mode, CASE WHEN (p_size + l_linenumber % 2) % 2 = 0 THEN 'm' ELSE 's' END AS unit, CASE WHEN l_linenumber >= 3 THEN l_linenumber % 4 END AS value, l_returnflag = 'R' AS external, l_linestatus = 'F' AS release, l_shipmode_ AS source_id, l_suppkey % 100 + CASE WHEN l_linenumber = 6 THEN 1000 ELSE 0 END AS package_id FROM (SELECT *, concat('S', l_partkey % 9) AS l_shipmode_ FROM lineitem) l JOIN part ON p_partkey = l_partkey)"""


@query("dq13_models", f"""WITH {_GOV}, k AS (SELECT parameter_id, unit AS punit, safety, CASE WHEN parameter_id % 4 = 0 THEN 3 END AS closed FROM params_ct)
SELECT model_id, m.parameter_id, concat_ws(',', CASE WHEN punit IS NULL THEN 'PARAMETER_UNKNOWN' END, CASE WHEN unit <> punit THEN 'UNIT_DIFFERS' END, CASE WHEN mode IN ('DIRECT', 'FAIL_CLOSED') AND value IS NULL THEN 'DIRECT_WITHOUT_VALUE' END, CASE WHEN safety AND mode = 'PRIOR' THEN 'SAFETY_PRIOR_UNCONFIRMED' END, CASE WHEN mode = 'FAIL_CLOSED' AND punit IS NOT NULL AND closed IS NULL THEN 'NOT_A_FAIL_CLOSED_PARAMETER' END,
CASE WHEN mode = 'FAIL_CLOSED' AND value <> closed THEN 'FAIL_CLOSED_VALUE_DIFFERS' END, CASE WHEN external AND release THEN 'EXTERNAL_CANNOT_RELEASE' END, CASE WHEN source_id = 'S8' THEN 'SOURCE_UNKNOWN' END, CASE WHEN package_id >= 1000 THEN 'PACKAGE_UNKNOWN' END) AS codes FROM m LEFT JOIN k ON k.parameter_id = m.parameter_id
WHERE punit IS NULL OR unit <> punit OR mode IN ('DIRECT', 'FAIL_CLOSED') AND value IS NULL OR safety AND mode = 'PRIOR' OR mode = 'FAIL_CLOSED' AND (closed IS NULL OR value <> closed) OR external AND release OR source_id = 'S8' OR package_id >= 1000""")
def dq13(spark, d):
    cand = feed(spark, d, f"WITH {_GOV} SELECT * FROM m")
    params = feed(spark, d, "SELECT parameter_id, unit, safety, CASE WHEN parameter_id % 4 = 0 THEN 3 END AS fail_closed FROM params_ct")
    sources = feed(spark, d, "SELECT concat('S', n_nationkey) AS source_id FROM nation WHERE n_nationkey < 8")
    packages = feed(spark, d, "SELECT DISTINCT l_suppkey % 100 AS package_id FROM lineitem")
    return Q.check_models(cand, params, sources, packages)


@query("dq14_products", """SELECT o_orderkey AS request_id, 'P' || (k - 1) AS product_id FROM (SELECT o_orderkey, o_orderkey % 5 AS k FROM orders) WHERE k > 0""")
def dq14(spark, d):
    req = feed(spark, d, "SELECT o_orderkey AS request_id, concat('P', o_orderkey % 5) AS product_id FROM orders")
    return Q.check_products(req, feed(spark, d, "SELECT product_id, requires AS needs FROM products_ct WHERE requires IS NOT NULL"))


@query("dq14_frozen_sets", """WITH a AS (SELECT request_id, list_sort(list_distinct(list(product_id))) AS s FROM frozen_dq GROUP BY request_id), b AS (SELECT request_id, list_sort(list_distinct(list(product_id))) AS s FROM run_dq GROUP BY request_id)
SELECT request_id, coalesce(len(b.s), 0) AS n_run, coalesce(len(a.s), 0) AS n_frozen, CASE WHEN a.s IS NULL THEN 'NOT_FROZEN' WHEN b.s IS NULL THEN 'NOT_RUN' WHEN a.s <> b.s THEN 'SET_DIFFERS' ELSE 'SAME' END AS verdict FROM a FULL JOIN b USING (request_id)""")
def dq14f(spark, d):
    return Q.check_frozen_sets(feed(spark, d, "run_dq"), feed(spark, d, "frozen_dq"), ["request_id"], ["product_id"])


@query("dq15_publication", """SELECT p_partkey AS group_id, concat_ws(',', CASE WHEN p_size % 10 = 0 THEN 'EMPTY' END, CASE WHEN p_size < 8 THEN 'TOO_SHORT' END, CASE WHEN p_partkey % 4 = 1 THEN 'BLOCKED' END, CASE WHEN p_partkey % 9 > 5 THEN 'GRADE' END, CASE WHEN p_partkey % 12 > 10 THEN 'CROSS_SLOPE' END, CASE WHEN p_partkey % 150 NOT BETWEEN 70 AND 130 THEN 'COVERAGE' END) AS codes FROM part""")
def dq15(spark, d):
    return Q.check_publication(feed(spark, d, "SELECT p_partkey AS group_id, p_size % 10 AS n_lines, p_size * 1e0 AS shortest, CASE p_partkey % 4 WHEN 0 THEN 'DIAGNOSTIC_ONLY' WHEN 1 THEN 'DIAGNOSTIC_ONLY,RADIUS' WHEN 2 THEN NULL ELSE '' END AS blockers, p_partkey % 9 AS grade_p95, p_partkey % 12 AS cross_p95, p_partkey % 150 AS coverage FROM part"), most_cross=10.0)


@query("dq15_summary_count", """WITH s AS (SELECT p_brand AS field, count(*) AS n, count(DISTINCT p_size) AS k FROM part WHERE p_size <= 40 GROUP BY p_brand), f AS (SELECT DISTINCT p_brand AS field FROM part), e AS (SELECT count(DISTINCT p_size) AS expected FROM part WHERE p_size <= 40)
SELECT field, coalesce(n, 0) AS n, expected, CASE WHEN n <> k THEN 'REPEATED_SUMMARY' WHEN coalesce(n, 0) < expected THEN 'SUMMARY_MISSING' ELSE 'SUMMARY_UNEXPECTED' END AS rule FROM f LEFT JOIN s USING (field), e WHERE n <> k OR coalesce(n, 0) <> expected""")
def dq15c(spark, d):
    rows = feed(spark, d, "SELECT p_brand AS field, p_size AS scenario_id FROM part WHERE p_size <= 40")
    return Q.check_summary_count(rows, feed(spark, d, "SELECT p_brand AS field FROM part"), rows.select("scenario_id"))


@query("dq16_barrier_decision", """SELECT p_partkey AS request_id, CASE p_partkey % 3 WHEN 0 THEN 'BLOCKED_NOT_REVIEWED' WHEN 1 THEN 'PASS_THROUGH' ELSE CASE WHEN p_size % 10 = 0 OR p_partkey % 4 = 0 OR p_partkey % 5 = 0 THEN 'INVALID_BARRIERS' ELSE 'SPLIT_REQUIRED' END END AS decision FROM part""")
def dq16(spark, d):
    return Q.barrier_decision(feed(spark, d, "SELECT p_partkey AS request_id, CASE p_partkey % 3 WHEN 0 THEN 'NOT_REVIEWED' WHEN 1 THEN 'DECLARED_NONE' ELSE 'PROVIDED' END AS review, CASE WHEN p_size % 10 = 0 THEN NULL ELSE 2e0 END AS width, p_partkey % 4 <> 0 AS split, p_partkey % 5 = 0 AS transit FROM part"))


@query("dq17_selection", f"WITH {PS._T} SELECT coalesce(s.group_id, d.group_id) AS group_id, CASE WHEN s.fraction IS DISTINCT FROM d.fraction THEN 'SELECTION_DIFFERS' ELSE 'ROLE_DIFFERS' END AS rule FROM s FULL JOIN sel_dq d ON d.group_id = s.group_id WHERE s.fraction IS DISTINCT FROM d.fraction OR s.role IS DISTINCT FROM d.role")
def dq17(spark, d):
    return Q.check_selection(S.select_trial(feed(spark, d, "trials"), ["group_id"]), feed(spark, d, "sel_dq"))
