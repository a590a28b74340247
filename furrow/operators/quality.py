"""Checks as rows: (rule, key, detail) of what is wrong, instead of an exception."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.catalog import codes_when, issue
from furrow.operators.order import spread

c = F.col


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_fk(child: DataFrame, parent: DataFrame, key: str, both: bool = True) -> DataFrame:
    """Keys of either side that the other lacks."""
    out = issue(child.select(key).distinct().join(parent, key, "left_anti"), "ORPHAN_CHILD", key)
    return out.unionByName(issue(parent.select(key).distinct().join(child, key, "left_anti"), "WITHOUT_CHILD", key)) if both else out


def reconcile(declared: DataFrame, observed: DataFrame, key: str, tol: float = 1e-6) -> DataFrame:
    """Keys whose declared value (key, value) isn't what is observed, or that one side lacks."""
    df = declared.select(key, c("value").alias("declared")).join(observed.select(key, c("value").alias("observed")), key, "full")
    why = F.when(c("declared").isNull(), "NOT_DECLARED").when(c("observed").isNull(), "NOT_OBSERVED").when(F.abs(c("declared") - c("observed")) > tol, "DIFFERS")
    return df.withColumn("rule", why).filter("rule IS NOT NULL")


def check_line_nodes(lines: DataFrame, nodes: DataFrame, key: str = "line_id") -> DataFrame:
    """key, rule of lines that don't have exactly one START and one END node (nodes: key, endpoint), and of nodes without a line."""
    n = lambda k: F.count_if(c("endpoint") == k).alias(k)
    g = nodes.groupBy(key).agg(n("START"), n("END"), F.count(F.lit(1)).alias("all")).withColumn("__node", F.lit(True))
    df = lines.select(key).distinct().withColumn("__line", F.lit(True)).join(g, key, "full")
    one = lambda k: F.coalesce(c(k), F.lit(0)) != 1
    codes = codes_when(("NO_SUCH_LINE", c("__line").isNull()), ("START_NOT_ONE", one("START")), ("END_NOT_ONE", one("END")), ("OTHER_NODES", F.coalesce(c("all") > c("START") + c("END"), F.lit(False))))
    return df.select(key, codes.alias("codes")).filter("codes != ''")


def check_values(values: DataFrame, rules: DataFrame) -> DataFrame:
    """values: row_id, name, value (text); rules: name, kind (number, text, enum), low, high, pattern, choices (array),
    required. First violated rule of each value; and required names that a row lacks."""
    df = values.join(rules, "name")
    num = F.expr("try_cast(value AS DOUBLE)")
    why = (
        F.when((c("kind") == "number") & num.isNull(), "NOT_A_NUMBER").when(num < c("low"), "BELOW_MINIMUM").when(num > c("high"), "ABOVE_MAXIMUM").when((c("kind") == "text") & ~F.rlike(c("value"), F.coalesce("pattern", F.lit(""))), "PATTERN")
        .when((c("kind") == "enum") & ~F.array_contains("choices", c("value")), "NOT_A_CHOICE")
    )
    bad = df.withColumn("rule", why).filter("rule IS NOT NULL").select("row_id", "name", "rule")
    need = values.select("row_id").distinct().crossJoin(rules.filter("required").select("name"))  # rules are a fixed, small table
    return bad.unionByName(need.join(values, ["row_id", "name"], "left_anti").select("row_id", "name", F.lit("MISSING").alias("rule")))


def _canonical(x: Column) -> Column:
    return F.to_json(x)


def _held(v: Column, steps: list[str]) -> Column:
    """array<struct<at, v>>: the values that a path leads to, with the place of each; none where a step is missing."""
    here = F.array(F.struct(F.lit("$").alias("at"), v.alias("v")))
    for step in steps:
        if step == "[*]":
            items = lambda x: F.coalesce(F.try_variant_get(x["v"], "$", "array<variant>"), F.array().cast("array<variant>"))
            here = F.flatten(F.transform(here, lambda x: F.transform(items(x), lambda y, i: F.struct(F.concat(x["at"], F.lit("["), i.cast("string"), F.lit("]")).alias("at"), y.alias("v")))))  # noqa: B023
        else:
            here = F.transform(here, lambda x: F.struct(F.concat(x["at"], F.lit(f".{step}")).alias("at"), F.try_variant_get(x["v"], f"$.{step}", "variant").alias("v")))  # noqa: B023
            here = F.filter(here, lambda x: x["v"].isNotNull())
    return here


def _broken(check: str, arg: str | None) -> Callable[[Column], Column]:
    """Of a value (variant), whether it breaks a rule; a rule for another type of value doesn't apply."""
    kind = lambda x: F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0)
    number = lambda x: F.when(kind(x).isin("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), F.try_variant_get(x, "$", "double"))
    text = lambda x: F.when(kind(x) == "STRING", F.try_variant_get(x, "$", "string"))
    items = lambda x: F.when(kind(x) == "ARRAY", F.try_variant_get(x, "$", "array<variant>"))
    keys = lambda x: F.when(kind(x) == "OBJECT", F.map_keys(F.try_variant_get(x, "$", "map<string,variant>")))
    value = json.loads(arg) if arg is not None else None
    types = {"string": ("STRING",), "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "integer": ("BIGINT",), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",), "null": ("VOID",)}

    def equals(x: Column, v: object) -> Column:
        if isinstance(v, int | float) and not isinstance(v, bool):
            return F.coalesce(number(x) == float(v), F.lit(False))
        return _canonical(x) == _canonical(F.parse_json(F.lit(json.dumps(v))))

    any_of = lambda x, vs: reduce(lambda a, b: a | b, [equals(x, v) for v in vs], F.lit(False))
    named = value if isinstance(value, list) else [value]
    rules = {
        "TYPE": lambda x: ~kind(x).isin(*[t for n in named for t in types[n]]), "CONST": lambda x: ~equals(x, value), "ENUM": lambda x: ~any_of(x, named),
        "MINIMUM": lambda x: number(x) < value, "EXCLUSIVE_MINIMUM": lambda x: number(x) <= value, "MAXIMUM": lambda x: number(x) > value, "EXCLUSIVE_MAXIMUM": lambda x: number(x) >= value,
        "MIN_LENGTH": lambda x: F.length(text(x)) < value, "MAX_LENGTH": lambda x: F.length(text(x)) > value, "PATTERN": lambda x: ~F.rlike(text(x), F.lit(rf"\A(?:{value})\z")),
        "MIN_ITEMS": lambda x: F.size(items(x)) < value, "MAX_ITEMS": lambda x: F.size(items(x)) > value,
        "UNIQUE_ITEMS": lambda x: F.size(F.array_distinct(F.transform(items(x), _canonical))) < F.size(items(x)),
        "MIN_PROPERTIES": lambda x: F.size(keys(x)) < value, "MAX_PROPERTIES": lambda x: F.size(keys(x)) > value,
        "REQUIRED": lambda x: F.size(F.array_except(F.array(*[F.lit(n) for n in named]), keys(x))) > 0, "ONLY_KEYS": lambda x: F.size(F.array_except(keys(x), F.array(*[F.lit(n) for n in named]).cast("array<string>"))) > 0,
    }
    if check not in rules:
        raise ValueError(f"no such check: {check}")
    return lambda x: F.coalesce(rules[check](x), F.lit(False))


def check_documents(docs: DataFrame, rules: DataFrame, most: int = 2000) -> DataFrame:
    """row_id, path, rule: a row for each rule that a value breaks, with the value's place. docs: row_id, json; rules: path
    ($, keys by dots, [*] for all items of an array), rule, arg (JSON). A text that isn't JSON breaks NOT_JSON.

    The rules, which a schema has a bounded number of, are compiled to expressions over the parsed document, so any number
    of documents is one pass without a join. Checking costs much more than reading, so documents are dealt over all tasks,
    however few files they come from."""
    table = sorted({(r["path"], r["rule"], r["arg"]) for r in rules.limit(most + 1).collect()}, key=str)
    if len(table) > most:
        raise ValueError(f"more than {most} rules")
    v = spread(docs.select("row_id", "json")).select("row_id", F.try_parse_json("json").alias("v"), c("json").isNotNull().alias("there"))
    found = [F.when(c("there") & c("v").isNull(), F.array(F.struct(F.lit("$").alias("path"), F.lit("NOT_JSON").alias("rule"))))]
    for path, check, arg in table:
        steps = re.findall(r"\[\*\]|[^.\[\]$]+", path)
        bad = F.filter(_held(c("v"), steps), lambda x: _broken(check, arg)(x["v"]))  # noqa: B023
        found.append(F.when(c("v").isNotNull(), F.transform(bad, lambda x: F.struct(x["at"].alias("path"), F.lit(check).alias("rule")))))  # noqa: B023
    none = F.array().cast("array<struct<path:string,rule:string>>")
    return v.select("row_id", F.explode(F.flatten(F.array(*[F.coalesce(f, none) for f in found]))).alias("f")).select("row_id", "f.path", "f.rule")


def check_periods(df: DataFrame) -> DataFrame:
    """key, from_, to_: inverted periods, and those that start before an earlier one of the key has ended."""
    w = Window.partitionBy("key").orderBy("from_", "to_", "id").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("before", F.max("to_").over(w))
    why = F.when(c("from_") > c("to_"), "INVERTED").when(c("from_") < c("before"), "OVERLAPS")
    return df.withColumn("rule", why).filter("rule IS NOT NULL").select("id", "key", "rule")


def check_links(measured: DataFrame, declared: DataFrame, limits: DataFrame, tol: float = 0.01) -> DataFrame:
    """measured: machine_id, axis, state, value; declared: machine_id, axes (array); limits: machine_id, most, gauges
    (array). Codes per machine: axis sets differ, a state is missing, over the limit, no allowed gauge is near."""
    m = measured.groupBy("machine_id").agg(F.array_sort(F.collect_set("axis")).alias("have"), F.countDistinct("state").alias("states"), F.max("value").alias("top"))
    df = m.join(declared, "machine_id").join(limits, "machine_id")
    near = F.exists("gauges", lambda g: F.abs(g - c("top")) <= tol)
    return df.select("machine_id", codes_when(("AXES_DIFFER", c("have") != F.array_sort("axes")), ("STATE_MISSING", c("states") < 2), ("OVER_LIMIT", c("top") > c("most")), ("GAUGE_NOT_ALLOWED", ~near)).alias("codes"))


def check_requirements(requests: DataFrame, values: DataFrame, rules: DataFrame) -> DataFrame:
    """requests: request_id, level; rules: level, name, expected (null: any); values: request_id, name, value."""
    df = requests.join(rules, "level").join(values, ["request_id", "name"], "left")
    why = F.when(c("value").isNull(), "REQUIRED_MISSING").when(c("expected").isNotNull() & (c("value") != c("expected")), "REQUIRED_VALUE_DIFFERS")
    return df.withColumn("rule", why).filter("rule IS NOT NULL").select("request_id", "name", "rule")


def check_artifacts(declared: DataFrame, scan: DataFrame, prefix: str | None = None) -> DataFrame:
    """name, verdict of files (name, size, sha256 on both sides). With a prefix both sides also have a project: a declared
    name must lie under prefix/project/, and a file that another project declares is told."""
    more = ["project"] if prefix is not None else []
    d = declared.select("name", c("size").alias("ds"), c("sha256").alias("dh"), *[c(x).alias(f"d_{x}") for x in more])
    s = scan.select("name", c("size").alias("ss"), c("sha256").alias("sh"), *[c(x).alias(f"s_{x}") for x in more])
    df = d.join(s, "name", "full")
    why = F.when(c("ss").isNull(), "MISSING").when(c("ds").isNull(), "UNDECLARED")
    if prefix is not None:
        why = why.when(~c("name").startswith(F.concat(F.lit(f"{prefix.rstrip('/')}/"), c("d_project").cast("string"), F.lit("/"))), "OUTSIDE_PREFIX").when(c("d_project") != c("s_project"), "WRONG_PROJECT")
    return df.select("name", why.when((c("ds") != c("ss")) | (c("dh") != c("sh")), "CHANGED").otherwise("OK").alias("verdict"))


def artifact_totals(scan: DataFrame, most_files: int = 2000, most_bytes: int = 2 << 30) -> DataFrame:
    """Per project: files, bytes, and which of the limits of a delivery they pass."""
    g = scan.groupBy("project").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return g.select("project", "files", "bytes", codes_when(("TOO_MANY_FILES", c("files") > most_files), ("TOO_MANY_BYTES", c("bytes") > most_bytes)).alias("codes"))


def set_digests(rows: DataFrame, by: list[str], items: list[str]) -> DataFrame:
    """by, n, digest: how many distinct items each group has, and 128 bits that don't depend on their order or repeats.
    Partial digests merge, so a group of any size is never gathered."""
    half = lambda k: F.bit_xor(F.xxhash64(F.lit(k), *items))
    g = rows.select(*by, *items).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n"), half(1).alias("__a"), half(2).alias("__b"))
    return g.select(*by, "n", F.concat(F.hex("__a"), F.lit("-"), F.hex("__b")).alias("digest"))


def check_frozen_sets(run: DataFrame, frozen: DataFrame, by: list[str], items: list[str]) -> DataFrame:
    """by, n_run, n_frozen, verdict: whether a run's set is the one that was frozen."""
    a, b = (set_digests(df, by, items).select(*by, c("n").alias(f"n_{k}"), c("digest").alias(f"d_{k}")) for df, k in ((run, "run"), (frozen, "frozen")))
    df = a.join(b, by, "full")
    why = F.when(c("n_frozen").isNull(), "NOT_FROZEN").when(c("n_run").isNull(), "NOT_RUN").when((c("n_run") != c("n_frozen")) | (c("d_run") != c("d_frozen")), "SET_DIFFERS").otherwise("SAME")
    return df.select(*by, F.coalesce("n_run", F.lit(0)).alias("n_run"), F.coalesce("n_frozen", F.lit(0)).alias("n_frozen"), why.alias("verdict"))


def check_claims(df: DataFrame, flags: list[str], required: list[str]) -> DataFrame:
    """Rows (id, flags as columns, limitations array) that claim what no screening may, or lack a limitation."""
    bad = F.array_compact(F.array(*[F.when(F.coalesce(c(f), F.lit(False)), f) for f in flags]))
    lack = F.array_except(F.array(*[F.lit(r) for r in required]), F.coalesce("limitations", F.array().cast("array<string>")))
    out = df.select("id", F.array_join(bad, ",").alias("forbidden"), F.array_join(F.array_sort(lack), ",").alias("missing"))
    return out.filter("forbidden != '' OR missing != ''")


def check_surfaces(df: DataFrame) -> DataFrame:
    """surface_id, kind, authorised, approval, fleet, evidence, breaks, prohibits: codes of each surface."""
    m = (c("kind") == "MANEUVER") & c("authorised")
    b = c("kind") == "BARRIER"
    return df.select("surface_id", codes_when(("APPROVAL_MISSING", m & c("approval").isNull()), ("FLEET_MISSING", m & c("fleet").isNull()), ("EVIDENCE_MISSING", m & c("evidence").isNull()), ("BARRIER_MUST_BREAK", b & ~c("breaks")), ("BARRIER_MUST_PROHIBIT", b & ~c("prohibits"))).alias("codes"))


def check_lineage(stages: DataFrame) -> DataFrame:
    """run_id, position, request_id, sha: stages whose request differs from the stage before, null-safe."""
    w = Window.partitionBy("run_id").orderBy("position")
    df = stages.withColumn("pr", F.lag("request_id").over(w)).withColumn("ps", F.lag("sha").over(w))
    why = F.when(~c("request_id").eqNullSafe(c("pr")), "REQUEST_DIFFERS").when(~c("sha").eqNullSafe(c("ps")), "STALE_RESOLUTION")
    return df.filter("position > 1").withColumn("rule", why).filter("rule IS NOT NULL").select("run_id", "position", "rule")


def check_lines(lengths: DataFrame, declared: DataFrame, nodes: DataFrame, tol: float = 0.01) -> DataFrame:
    """line_id, length against declared (line_id, length), and ends (line_id, ex, ey) against nodes (line_id, nx, ny)."""
    df = lengths.join(declared.withColumnRenamed("length", "declared"), "line_id").join(nodes, "line_id")
    off = F.greatest(F.abs(c("ex") - c("nx")), F.abs(c("ey") - c("ny")))
    return df.select("line_id", codes_when(("LENGTH_DIFFERS", F.abs(c("length") - c("declared")) > tol), ("NODE_OFF_END", off > 1e-6)).alias("codes")).filter("codes != ''")


def check_phase(vertices: DataFrame, lines: DataFrame, spacing: float, tol: float = 0.01) -> DataFrame:
    """line_id, error, codes of lines whose vertices (line_id, seq, x, y) aren't on the level of their row: the phase along
    the normal of theta (degrees) is row_id * spacing. lines: line_id, row_id, theta."""
    t = F.radians("theta")
    off = F.abs(c("y") * F.cos(t) - c("x") * F.sin(t) - c("row_id") * spacing)
    g = vertices.join(lines, "line_id").groupBy("line_id").agg(F.max(off).alias("error"))
    return g.withColumn("codes", codes_when(("PHASE_DIFFERS", c("error") > tol))).filter("codes != ''")


def check_outside(segments: DataFrame, edges: DataFrame, tol: float = 0.01, cell: float = 50.0) -> DataFrame:
    """line_id, outside_m of lines (line_id, seq, x0, y0, x1, y1) that run outside the union of the polygons (edges:
    polygon_id, x0, y0, x1, y1) for more than tol."""
    from furrow.operators.nearest import outside_pieces

    parts = segments.select(F.struct("line_id", "seq").alias("connector_id"), c("x0").alias("x"), c("y0").alias("y"), c("x1").alias("sx"), c("y1").alias("sy"))
    return outside_pieces(parts, edges, cell).groupBy("connector_id.line_id").agg(F.sum("length").alias("outside_m")).filter(c("outside_m") > tol)


def check_models(candidates: DataFrame, params: DataFrame, sources: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """model_id, parameter_id, codes. candidates: model_id, parameter_id, mode, unit, value, external, release, source_id,
    package_id; params: parameter_id, unit, safety, fail_closed (null: the catalog has no such value). Sources and packages
    are looked up where they are given."""
    df = candidates.join(params.select("parameter_id", c("unit").alias("punit"), "safety", "fail_closed"), "parameter_id", "left")
    more = []
    for table, key, code in ((sources, "source_id", "SOURCE_UNKNOWN"), (packages, "package_id", "PACKAGE_UNKNOWN")):
        if table is not None:
            df = df.join(table.select(key).distinct().withColumn(f"__{key}", F.lit(True)), key, "left")
            more.append((code, c(f"__{key}").isNull()))
    closed = c("mode") == "FAIL_CLOSED"
    codes = codes_when(
        ("PARAMETER_UNKNOWN", c("punit").isNull()), ("UNIT_DIFFERS", c("unit") != c("punit")), ("DIRECT_WITHOUT_VALUE", c("mode").isin("DIRECT", "FAIL_CLOSED") & c("value").isNull()), ("SAFETY_PRIOR_UNCONFIRMED", c("safety") & (c("mode") == "PRIOR")),
        ("NOT_A_FAIL_CLOSED_PARAMETER", closed & c("punit").isNotNull() & c("fail_closed").isNull()), ("FAIL_CLOSED_VALUE_DIFFERS", closed & (c("value") != c("fail_closed"))), ("EXTERNAL_CANNOT_RELEASE", c("external") & c("release")), *more,
    )
    return df.select("model_id", "parameter_id", codes.alias("codes")).filter("codes != ''")


def check_products(requested: DataFrame, deps: DataFrame) -> DataFrame:
    """request_id, product_id; deps: product_id, needs. Dependencies that a request doesn't name."""
    need = requested.join(deps, "product_id").select("request_id", c("needs").alias("product_id")).distinct()
    return need.join(requested, ["request_id", "product_id"], "left_anti")


def check_publication(summaries: DataFrame, min_lines: int = 1, cover: tuple[float, float] = (70.0, 130.0), most_grade: float = 5.0, most_cross: float | None = None) -> DataFrame:
    """group_id, n_lines, shortest, blockers, grade_p95, coverage (and cross_p95 where there is a limit to it): codes against
    publication."""
    real = F.filter(F.split(F.coalesce("blockers", F.lit("")), ","), lambda x: (x != "") & (x != "DIAGNOSTIC_ONLY"))
    cross = [("CROSS_SLOPE", c("cross_p95") > most_cross)] if most_cross is not None else []
    return summaries.select("group_id", codes_when(("EMPTY", c("n_lines") < min_lines), ("TOO_SHORT", c("shortest") < 8), ("BLOCKED", F.size(real) > 0), ("GRADE", c("grade_p95") > most_grade), *cross, ("COVERAGE", ~c("coverage").between(*cover))).alias("codes"))


def check_summary_count(summaries: DataFrame, fields: DataFrame, scenarios: DataFrame) -> DataFrame:
    """field, n, expected, rule of the fields that don't have one summary for each scenario."""
    want = scenarios.agg(F.countDistinct("scenario_id").alias("expected"))  # one row
    n = summaries.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("scenario_id").alias("distinct"))
    df = fields.select("field").distinct().join(n, "field", "full").fillna(0, ["n", "distinct"]).crossJoin(want)
    why = F.when(c("n") != c("distinct"), "REPEATED_SUMMARY").when(c("n") < c("expected"), "SUMMARY_MISSING").when(c("n") > c("expected"), "SUMMARY_UNEXPECTED")
    return df.select("field", "n", "expected", why.alias("rule")).filter("rule IS NOT NULL")


def barrier_decision(df: DataFrame) -> DataFrame:
    """request_id, review, width, split, transit."""
    bad = (F.coalesce(c("width"), F.lit(0.0)) <= 0) | ~c("split") | c("transit")
    return df.select("request_id", F.when(c("review") == "NOT_REVIEWED", "BLOCKED_NOT_REVIEWED").when(c("review") == "DECLARED_NONE", "PASS_THROUGH").when(bad, "INVALID_BARRIERS").otherwise("SPLIT_REQUIRED").alias("decision"))


def check_selection(recomputed: DataFrame, declared: DataFrame) -> DataFrame:
    """group_id, fraction, role on both sides; groups where they differ, null-safe."""
    d = declared.select("group_id", c("fraction").alias("df"), c("role").alias("dr"))
    df = recomputed.join(d, "group_id", "full")
    why = F.when(~c("fraction").eqNullSafe(c("df")), "SELECTION_DIFFERS").when(~c("role").eqNullSafe(c("dr")), "ROLE_DIFFERS")
    return df.withColumn("rule", why).filter("rule IS NOT NULL").select("group_id", "rule")
