"""SN1-SN16 over the given tables: groups are suppliers, candidates are parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import scenario as S
from furrow.plans.feeds import FEEDS, feed, oracle

FEEDS["candidates"] = """SELECT p_brand AS field, p_partkey AS cand, (p_partkey % 36) * 5e0 AS theta, (p_partkey % 5 - 2) * 3e0 AS lam, p_retailprice / 2e2 AS grade, (p_size % 13) * 5e-1 AS cross_, p_size * 1.5e-2 AS singular, (p_partkey % 41) * 1e0 AS spacing, p_size * 1e1 + p_partkey % 7 AS length FROM part"""
FEEDS["lines_sn"] = """SELECT CASE WHEN l_returnflag = 'N' THEN 'E0A' ELSE 'E0B' END AS scenario, l_suppkey % 20 AS field, l_partkey % 300 AS row_id, l_orderkey, l_linenumber, l_extendedprice / 1e2 AS length, l_discount * 1e2 AS grade, l_linenumber % 4 AS reversals FROM lineitem"""
FEEDS["fields_sn"] = """SELECT s_suppkey AS field, 4e1 + s_suppkey AS area_ha, 1.5e0 AS row_m FROM supplier WHERE s_suppkey < 20"""
FEEDS["scenario_fields"] = """SELECT c_nationkey AS run_id, concat('S', c_custkey % 6) AS scenario_id, c_custkey AS cust, 5e0 + c_custkey % 10 AS area, 1e0 + c_custkey % 7 AS km, 1e0 + c_custkey % 4 AS shots, (c_custkey % 11) * 1e-1 AS loss_cons, (c_custkey % 7) * 1e-1 AS loss_harv, (c_custkey % 9) * 1e-1 AS loss_perf,
CASE WHEN c_custkey % 23 = 0 THEN 2 ELSE 0 END AS violations, CASE WHEN c_custkey % 23 = 0 THEN 'RADIUS,CROSSING' WHEN c_custkey % 31 = 0 THEN 'SPACING' ELSE NULL END AS codes FROM customer"""
FEEDS["report_rows"] = """SELECT c_nationkey AS scenario_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 13) * 1e0 END AS value, 1e0 + c_custkey % 10 AS area, CASE WHEN c_nationkey % 4 = 0 THEN NULL WHEN c_nationkey % 4 = 1 THEN true ELSE c_custkey % 3 = 0 END AS flag FROM customer"""
FEEDS["blocks_sn"] = """SELECT p_brand AS candidate_id, p_partkey % 6 AS field, p_partkey, p_partkey % 10 > 2 OR p_brand = 'Brand#3' AS passed, p_size AS n_rows, p_retailprice AS length_m, (p_partkey % 8) * 1e-1 AS spacing_error, 8e0 + p_partkey % 5 AS radius FROM part"""
FEEDS["trials"] = """SELECT p_brand AS group_id, p_partkey AS trial, (p_partkey % 40) * 25e-3 AS fraction, CASE WHEN p_partkey % 3 = 0 AND p_brand <> 'Brand#5' THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN p_partkey % 30 = 0 THEN NULL ELSE 8e0 + p_size % 4 END AS radius, (p_size % 5) * 1e-2 AS outside, (p_size % 3) * 1e-1 AS error, 9e-1 + (p_size % 4) * 1e-1 AS coverage FROM part"""
FEEDS["metric_rows"] = """SELECT floor(c_custkey / 4e0) AS comparison_id, c_custkey, 'P1' AS project_id, CASE WHEN c_custkey % 41 = 0 THEN 'R2' ELSE 'R1' END AS run_id, CASE WHEN c_custkey % 53 = 0 THEN NULL ELSE 'h' END AS request_sha, CASE WHEN c_custkey % 2 = 0 THEN 'F1,F2' ELSE 'F2,F1' END AS fields, c_nationkey AS score FROM customer"""
FEEDS["hyd_lines"] = """SELECT l_suppkey AS group_id, l_orderkey, l_linenumber, l_quantity AS length, l_discount * 1e2 AS grade, l_linenumber % 4 = 0 AS adverse FROM lineitem"""
FEEDS["hyd_params"] = """SELECT s_suppkey AS group_id, name, CASE WHEN s_suppkey % k = 0 THEN NULL ELSE s_acctbal END AS value FROM supplier CROSS JOIN (SELECT 'rain' AS name, 3 AS k UNION ALL SELECT 'soil', 5 UNION ALL SELECT 'slope', 7) q"""
FEEDS["interval_rows"] = """SELECT p_size % 8 AS interval, p_partkey, p_size AS axes, p_retailprice / 1e3 AS km, p_partkey % 19 AS segments, CASE WHEN p_size % 8 = 3 THEN 0 ELSE p_partkey % 7 END AS n_rows, p_retailprice / 1e1 AS p50, p_size * 9e0 AS kept_m, p_size * 1e1 AS base_m, p_partkey % 3 AS split_rows FROM part"""

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


def _cand(spark, d):
    return feed(spark, d, "candidates").withColumnRenamed("cross_", "cross")


_N = ", ".join(f"CASE WHEN {x}_hi <= {x}_lo + 1e-9 THEN 0 ELSE {'1 - ' if x == 'length' else ''}least(greatest(({x} - {x}_lo) / ({x}_hi - {x}_lo), 0), 1) END AS {x}_n" for x in ("grade", "cross_", "singular", "spacing", "length"))
_L = f"""q AS (SELECT field, {", ".join(f"quantile_cont({x}, 0.05) AS {x}_lo, quantile_cont({x}, 0.95) AS {x}_hi" for x in ("grade", "cross_", "singular", "spacing", "length"))} FROM candidates GROUP BY field), n AS (SELECT c.*, {_N} FROM candidates c JOIN q USING (field)),
l AS (SELECT *, 0.45 * cross__n + 0.25 * grade_n + 0.2 * singular_n + 0.1 * spacing_n AS cons, 0.55 * grade_n + 0.25 * cross__n + 0.2 * spacing_n AS harv FROM n), b AS (SELECT *, 0.4 * cons + 0.25 * harv + 0.25 * length_n + 0.1 * spacing_n AS bal FROM l)"""


@query("sn1_normalise", f"WITH {_L} SELECT field, cand, round(grade_n, 6) AS grade_n, round(length_n, 6) AS length_n FROM n")
def sn1(spark, d):
    df = S.normalise(S.normalise(_cand(spark, d), ["field"], "grade"), ["field"], "length", True)
    return df.select("field", "cand", R("grade_n").alias("grade_n"), R("length_n").alias("length_n"))


@query("sn2_losses", f"WITH {_L} SELECT cand, round(cons, 6) AS loss_conservation, round(harv, 6) AS loss_harvest, round(greatest(grade_n, cross__n), 6) AS loss_grade, round(bal, 6) AS loss_balanced FROM b")
def sn2(spark, d):
    return S.add_losses(_cand(spark, d), ["field"]).select("cand", *[R(x).alias(x) for x in ("loss_conservation", "loss_harvest", "loss_grade", "loss_balanced")])


_G = "g AS (SELECT c.*, singular <= 0.5 AND spacing <= 9 AS gated, bool_or(singular <= 0.5 AND spacing <= 9) OVER (PARTITION BY field, theta) AS any_ok FROM candidates c)"


@query("sn3_gate", f"WITH {_G} SELECT cand, gated FROM g WHERE gated OR NOT any_ok")
def sn3(spark, d):
    return S.gate(_cand(spark, d), ["field", "theta"], 0.5, 9.0).select("cand", "gated")


@query("sn3_gate_limits", """WITH g AS (SELECT *, singular <= 0.5 AND spacing <= 30 AND grade <= 9.2 AND cross_ <= 5 AS gated FROM candidates), a AS (SELECT *, bool_or(gated) OVER (PARTITION BY field) AS any_ok FROM g) SELECT cand, gated FROM a WHERE gated OR NOT any_ok""")
def sn3l(spark, d):
    df = feed(spark, d, "candidates").withColumn("grade_max", F.col("grade")).withColumn("cross_max", F.col("cross_"))
    return S.gate(df, ["field"], 0.5, 30.0, True, 9.2, 5.0).select("cand", "gated")


@query("sn4_select_candidate", f"""WITH {_L}, x AS (SELECT *, bool_or(lam = 0) OVER (PARTITION BY field) AS any0 FROM b), y AS (SELECT *, bool_or(grade <= 4.8e0) OVER (PARTITION BY field) AS any1 FROM x WHERE lam = 0 OR NOT any0),
z AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY bal, theta, lam) AS rn FROM y WHERE grade <= 4.8e0 OR NOT any1) SELECT field, round(bal, 6) AS loss, theta, lam FROM z WHERE rn = 1""")
def sn4(spark, d):
    return rounded(S.select_candidate(S.add_losses(_cand(spark, d), ["field"]), ["field"], "loss_balanced", 4.8), ["loss"])


@query("sn5_shared_axis")
def sn5(spark, d):
    df = S.add_losses(_cand(spark, d).withColumn("field", F.floor(F.col("cand") / 36) % 2), ["field"])
    return rounded(S.select_shared_axis(df), ["score"])


ORACLES["sn5_shared_axis"] = oracle(f"""WITH candidates2 AS (SELECT CAST(floor(cand / 36e0) AS BIGINT) % 2 AS field, cand, theta, lam, grade, cross_, singular, spacing, length FROM candidates), {_L.replace('FROM candidates GROUP', 'FROM candidates2 GROUP').replace('FROM candidates c', 'FROM candidates2 c')},
a AS (SELECT theta, avg(bal) * 0.5 + max(bal) * 0.5 AS s FROM b WHERE lam = 0 GROUP BY theta HAVING count(DISTINCT field) = 2) SELECT DISTINCT f.field, round(s, 6) AS score, w.theta FROM b f JOIN (SELECT * FROM a ORDER BY s, theta LIMIT 1) w ON true""")


@query("sn6_aggregate_lines", """SELECT scenario, l.field, count(*) AS segments, count(DISTINCT row_id) AS rows, round(sum(length), 4) AS length_m, round(avg(length), 5) AS mean_m, round(quantile_cont(length, 0.1), 5) AS p10, round(quantile_cont(length, 0.5), 5) AS p50, round(quantile_cont(length, 0.9), 5) AS p90, round(count(*) FILTER (length < 50) / count(*), 6) AS short_share, round(count(*) FILTER (length > 200) / count(*), 6) AS long_share,
round(sum(grade * length) / sum(length), 5) AS weighted_grade, round(sum(reversals) * 1000 / sum(length), 5) AS reversals_km, count(*) - count(DISTINCT row_id) AS fragmentation, round(sum(length) * 1.5 / (max(area_ha) * 1e4), 5) AS coverage, round(sum(length) / (sum(length) + count(*) * 12), 6) AS efficiency FROM lines_sn l JOIN fields_sn f ON f.field = l.field GROUP BY scenario, l.field""")
def sn6(spark, d):
    out = S.aggregate_lines(feed(spark, d, "lines_sn"), feed(spark, d, "fields_sn")).drop("area_ha", "row_m")
    out = rounded(rounded(out, ["length_m"], 4), ["mean_m", "p10", "p50", "p90", "weighted_grade", "reversals_km", "coverage"], 5)
    return rounded(out, ["short_share", "long_share", "efficiency"])


@query("sn7_scenario_scores", """WITH g AS (SELECT run_id, scenario_id, sum(area) AS area, sum(km) * 1000 / sum(shots) AS shot, sum((1 - loss_cons) * area) / sum(area) * 100 AS co, sum((1 - loss_harv) * area) / sum(area) * 100 AS ha, sum((1 - loss_perf) * area) / sum(area) * 100 AS pe, sum(violations) AS violations FROM scenario_fields GROUP BY ALL),
k AS (SELECT run_id, scenario_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM (SELECT run_id, scenario_id, unnest(string_split(codes, ',')) AS code FROM scenario_fields WHERE codes IS NOT NULL) GROUP BY ALL),
x AS (SELECT g.*, coalesce(codes, '') AS codes, (co + ha + 3 * pe) / 5 AS cmp, violations = 0 AND codes IS NULL AS eligible FROM g LEFT JOIN k USING (run_id, scenario_id)), y AS (SELECT *, row_number() OVER (PARTITION BY run_id, eligible ORDER BY cmp DESC, scenario_id) AS rn FROM x)
SELECT run_id, scenario_id, area, round(shot, 9) AS mean_shot_m, round(co, 9) AS conservation, round(ha, 9) AS harvest, round(pe, 9) AS performance, violations, codes, round(cmp, 9) AS comparison, eligible, eligible AND rn = 1 AS recommended FROM y""")
def sn7(spark, d):
    return rounded(S.scenario_scores(feed(spark, d, "scenario_fields")), ["mean_shot_m", "conservation", "harvest", "performance", "comparison"], 9)


@query("sn8_scenario_report", """SELECT scenario_id, round(sum(value * area) / sum(area) FILTER (value IS NOT NULL), 6) AS mean, count(value) AS numeric, count(*) AS n, CASE WHEN count(flag) = 0 THEN 'NOT_EVALUATED' WHEN count(*) FILTER (flag) = count(*) THEN 'ELIGIBLE' WHEN count(*) FILTER (flag) > 0 THEN 'PARTIAL' ELSE 'NOT_ELIGIBLE' END AS status FROM report_rows GROUP BY scenario_id""")
def sn8(spark, d):
    return rounded(S.scenario_report(feed(spark, d, "report_rows")), ["mean"])


@query("sn9_family_scores", """SELECT candidate_id, count(*) AS blocks, count(*) FILTER (passed) AS passes, sum(n_rows) FILTER (passed) AS pass_rows, round(sum(length_m) FILTER (passed) / 1000, 5) AS pass_km, round(sum(length_m) FILTER (NOT passed) / 1000, 5) AS diagnostic_km, count(DISTINCT field) AS fields, round(avg(spacing_error), 6) AS mean_error, min(radius) AS min_radius, CASE WHEN bool_and(passed) THEN 'PASS' WHEN bool_or(passed) THEN 'PARTIAL' ELSE 'NONE' END AS status FROM blocks_sn GROUP BY candidate_id""")
def sn9(spark, d):
    return rounded(rounded(S.family_scores(feed(spark, d, "blocks_sn")), ["pass_km", "diagnostic_km"], 5), ["mean_error"])


@query("sn10_concept_summary", """SELECT kind, count(*) AS concepts, sum(axes) AS axes, sum(strips) AS strips, false AS selectable, 'SCREENING_NOT_SELECTABLE' AS status FROM (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'BLOCKED' ELSE 'CANDIDATE' END AS kind, p_size AS axes, p_size + 1 AS strips FROM part) GROUP BY kind""")
def sn10(spark, d):
    one = lambda w: feed(spark, d, f"SELECT p_partkey AS concept_id, p_size AS axes, p_size + 1 AS strips FROM part WHERE {w}")
    return S.concept_summary(one("p_partkey % 4 <> 0"), one("p_partkey % 4 = 0"))


_T = """r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY coalesce(radius, 1e300) DESC, outside, error, abs(coverage - 1), fraction) AS rn FROM trials WHERE status = 'PASS'), s AS (SELECT group_id, coalesce(max(r.fraction), min(t.fraction)) AS fraction, CASE WHEN max(r.fraction) IS NULL THEN 'DIAGNOSTIC_ONLY' ELSE 'SELECTED' END AS role, count(*) FILTER (t.status = 'PASS') AS passing FROM trials t LEFT JOIN r USING (group_id) WHERE r.rn = 1 OR r.rn IS NULL GROUP BY group_id)"""


@query("sn11_select_trial", f"WITH {_T} SELECT * FROM s")
def sn11(spark, d):
    return S.select_trial(feed(spark, d, "trials"), ["group_id"])


@query("sn12_invariant_blockers", "SELECT group_id, trial FROM trials WHERE group_id NOT IN ('Brand#1', 'Brand#7')")
def sn12(spark, d):
    b = feed(spark, d, "SELECT DISTINCT p_brand AS group_id, 'RADIUS' AS code, p_brand IN ('Brand#1', 'Brand#7') AS invariant FROM part")
    return S.invariant_blockers(feed(spark, d, "trials"), b).select("group_id", "trial")


@query("sn13_best_metric", """SELECT c_custkey, coalesce(n >= 2 AND k = n AND b = 1 AND score = m, false) AS best FROM (SELECT c_custkey, score, min(score) OVER w AS m, count(*) OVER w AS n, count(request_sha) OVER w AS k, CASE WHEN min(run_id) FILTER (request_sha IS NOT NULL) OVER w = max(run_id) FILTER (request_sha IS NOT NULL) OVER w THEN 1 ELSE 2 END AS b FROM metric_rows WINDOW w AS (PARTITION BY comparison_id))""")
def sn13(spark, d):
    return S.best_metric(feed(spark, d, "metric_rows"), "score").select("c_custkey", "best")


@query("sn14_hydraulic_precheck", """WITH m AS (SELECT group_id, string_agg(name, ',' ORDER BY name) AS missing FROM hyd_params WHERE value IS NULL GROUP BY group_id), g AS (SELECT group_id, sum(length) FILTER (adverse) / sum(length) AS a, quantile_cont(grade, 0.95) AS p, max(grade) AS x FROM hyd_lines GROUP BY group_id)
SELECT group_id, round(coalesce(a, 0), 6) AS adverse_share, round(p, 6) AS grade_p95, round(x, 6) AS grade_max, coalesce(missing, '') AS missing, concat_ws(',', CASE WHEN missing IS NOT NULL THEN 'HYDRAULIC_INPUT_MISSING' END, CASE WHEN a > 0.25 THEN 'ADVERSE_GRADE_SHARE' END) AS blockers FROM g LEFT JOIN m USING (group_id)""")
def sn14(spark, d):
    return rounded(S.hydraulic_precheck(feed(spark, d, "hyd_lines"), feed(spark, d, "hyd_params"), ["rain", "soil", "slope"]), ["adverse_share", "grade_p95", "grade_max"])


@query("sn15_interval_summary", """SELECT interval, count(*) AS candidates, sum(axes) AS axes, round(sum(km), 5) AS km, round(sum(segments) / nullif(sum(n_rows), 0), 6) AS fragmentation, round(median(p50), 6) AS median_p50, round(sum(kept_m) / nullif(sum(base_m), 0) * 100, 6) AS retained_percent, sum(split_rows) AS split_rows FROM interval_rows GROUP BY interval""")
def sn15(spark, d):
    return rounded(rounded(S.interval_summary(feed(spark, d, "interval_rows")), ["km"], 5), ["fragmentation", "median_p50", "retained_percent"])


@query("sn15_candidate_ratios", """SELECT p_partkey AS candidate, round(segments / nullif(n_rows, 0), 6) AS fragmentation, round(kept_m * 100 / nullif(base_m, 0), 6) AS retained_percent, round(split_rows * 1e2 / nullif(n_rows, 0), 6) AS split_percent FROM interval_rows""")
def sn15c(spark, d):
    return rounded(S.candidate_ratios(feed(spark, d, "interval_rows").withColumnRenamed("p_partkey", "candidate"), "candidate"), ["fragmentation", "retained_percent", "split_percent"])


@query("sn16_shortlist", """SELECT run_id, scenario_id, eligible, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY eligible DESC, score DESC, scenario_id) AS rank FROM (SELECT c_nationkey AS run_id, c_custkey AS scenario_id, c_custkey % 3 = 0 AS eligible, c_acctbal AS score FROM customer)) WHERE rank <= 3""")
def sn16(spark, d):
    return S.shortlist(feed(spark, d, "SELECT c_nationkey AS run_id, c_custkey AS scenario_id, c_custkey % 3 = 0 AS eligible, c_acctbal AS score FROM customer"))


@query("sn16_portfolio", "SELECT count(*) FILTER (p_size > 20) AS active_projects, round(sum(p_retailprice) FILTER (p_size > 20), 3) AS area_ha, sum(p_size) AS runs FROM part")
def sn16p(spark, d):
    return rounded(S.portfolio(feed(spark, d, "SELECT p_size > 20 AS active, p_retailprice AS area_ha, p_size AS runs FROM part")), ["area_ha"], 3)
