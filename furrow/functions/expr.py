"""Column expressions: erosion, runoff, sections, planar geometry, identifiers, nested values, hashes. No UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Standard gravity, m/s2, and the weight of water, N/m3 per g.
GRAVITY = 9.80665
WATER = 1000.0


def finite(c: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def round_or_null(c: Column, digits: int) -> Column:
    """HALF_UP rounding; null for null, NaN and infinities."""
    return F.when(finite(c), F.round(c, digits))


def reject(df: DataFrame, reasons: dict[str, Column], name: str = "reject_reason") -> DataFrame:
    """df with the first reason whose condition holds (or is null), else null."""
    out = F.lit(None).cast("string")
    for code, bad in reversed(list(reasons.items())):
        out = F.when(F.coalesce(bad, F.lit(True)), code).otherwise(out)
    return df.withColumn(name, out)


def rusle(df: DataFrame, r: str = "r", k: str = "k", ls: str = "ls", c: str = "c", p: str = "p", tol: str = "tolerance") -> DataFrame:
    """df with soil_loss, tolerance_ratio, status, reject_reason. A rejected row has no loss; a loss without a declared
    tolerance has no ratio."""
    pos = lambda n: ~(finite(F.col(n)) & (F.col(n) > 0))
    unit = lambda n: ~(finite(F.col(n)) & F.col(n).between(0, 1))
    df = reject(df, {"R_NOT_POSITIVE": pos(r), "K_NOT_POSITIVE": pos(k), "LS_NOT_POSITIVE": pos(ls), "C_OUTSIDE_0_1": unit(c), "P_OUTSIDE_0_1": unit(p)})
    loss = F.when(F.col("reject_reason").isNull(), F.col(r) * F.col(k) * F.col(ls) * F.col(c) * F.col(p))
    df = df.withColumn("soil_loss", loss).withColumn("tolerance_ratio", F.when(F.col(tol) > 0, F.col("soil_loss") / F.col(tol)))
    ratio = F.col("tolerance_ratio")
    status = F.when(F.col("soil_loss").isNull(), "REJECTED").when(ratio.isNull(), "TOLERANCE_NOT_DECLARED").when(ratio <= 1 + 1e-12, "WITHIN_DECLARED_TOLERANCE_SCREENING").otherwise("EXCEEDS_DECLARED_TOLERANCE_SCREENING")
    return df.withColumn("status", status)


def cn_runoff(p: Column, cn: Column, ratio: Column) -> Column:
    """Curve-number runoff depth, mm; null outside CN (0, 100] or ratio [0, 0.30]."""
    s = F.lit(25400.0) / cn - 254.0
    ia = ratio * s
    q = F.when(p <= ia, 0.0).otherwise((p - ia) * (p - ia) / (p - ia + s))
    return F.when((cn > 0) & (cn <= 100) & ratio.between(0, 0.30) & (p >= 0), q)


def trapezoid(d: Column, b: Column, z: Column) -> Column:
    """area, perimeter, radius and top width of a trapezoidal section at depth d."""
    area, wet = d * (b + z * d), b + d * 2 * F.sqrt(1 + z * z)
    return F.struct(area.alias("area"), wet.alias("perimeter"), F.when(wet > 0, area / wet).otherwise(0.0).alias("radius"), (b + z * d * 2).alias("top"))


def manning_q(d: Column, b: Column, z: Column, s: Column, n: Column) -> Column:
    """Discharge at uniform flow; null unless slope and roughness are positive."""
    t = trapezoid(d, b, z)
    return F.when((s > 0) & (n > 0), t["area"] * F.pow(t["radius"], F.lit(2.0) / 3) * F.sqrt(s) / n)


def flow_state(q: Column, d: Column, b: Column, z: Column, s: Column) -> Column:
    """velocity, froude and shear of discharge q at depth d; zeros where there is no depth."""
    t = trapezoid(d, b, z)
    v = q / t["area"]
    wet = d > 0
    zero = lambda c: F.when(wet, c).otherwise(0.0)
    return F.struct(zero(v).alias("velocity"), zero(v / F.sqrt(t["area"] * GRAVITY / t["top"])).alias("froude"), zero(t["radius"] * (WATER * GRAVITY) * s).alias("shear"))


def normal_depth(q: Column, b: Column, z: Column, s: Column, n: Column) -> Column:
    """Depth of uniform flow by bisection: the bracket doubles from 1 until it holds q, then 100 halvings. 0 for q = 0."""
    upper = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.lit(1.0), lambda hi, _: F.when(manning_q(hi, b, z, s, n) < q, hi * 2).otherwise(hi))
    halve = lambda a, _: F.when(
        manning_q((a["lo"] + a["hi"]) / 2, b, z, s, n) < q, F.struct(((a["lo"] + a["hi"]) / 2).alias("lo"), a["hi"].alias("hi"))
    ).otherwise(F.struct(a["lo"].alias("lo"), ((a["lo"] + a["hi"]) / 2).alias("hi")))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.struct(F.lit(0.0).alias("lo"), upper.alias("hi")), halve, lambda a: (a["lo"] + a["hi"]) / 2)
    return F.when(q <= 0, 0.0).otherwise(found)


def axial_encode(theta: Column) -> Column:
    """An unoriented axis in degrees as a unit vector of the doubled angle."""
    t = F.radians(theta) * 2
    return F.struct(F.cos(t).alias("qx"), F.sin(t).alias("qy"))


def axial_diff(a: Column, b: Column) -> Column:
    """Smallest angle between two unoriented axes, 0..90 degrees."""
    return F.abs(F.pmod(a - b + 90, F.lit(180.0)) - 90)


def cross(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def pt_seg_dist(px, py, ax, ay, bx, by) -> Column:
    """Distance of a point to a segment (clamped projection)."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / n, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return distance(px, py, ax + dx * t, ay + dy * t)


def seg_intersects(ax, ay, bx, by, cx, cy, dx, dy, eps: float = 1e-9) -> Column:
    """Whether two segments cross or touch; collinear touch counts."""
    o1, o2 = cross(ax, ay, bx, by, cx, cy), cross(ax, ay, bx, by, dx, dy)
    o3, o4 = cross(cx, cy, dx, dy, ax, ay), cross(cx, cy, dx, dy, bx, by)
    proper = (((o1 > eps) & (o2 < -eps)) | ((o1 < -eps) & (o2 > eps))) & (((o3 > eps) & (o4 < -eps)) | ((o3 < -eps) & (o4 > eps)))

    def on(o, px, py, qx, qy, rx, ry):
        return (F.abs(o) <= eps) & rx.between(F.least(px, qx) - eps, F.greatest(px, qx) + eps) & ry.between(F.least(py, qy) - eps, F.greatest(py, qy) + eps)

    return proper | on(o1, ax, ay, bx, by, cx, cy) | on(o2, ax, ay, bx, by, dx, dy) | on(o3, cx, cy, dx, dy, ax, ay) | on(o4, cx, cy, dx, dy, bx, by)


def seg_seg_dist(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    apart = F.least(pt_seg_dist(ax, ay, cx, cy, dx, dy), pt_seg_dist(bx, by, cx, cy, dx, dy), pt_seg_dist(cx, cy, ax, ay, bx, by), pt_seg_dist(dx, dy, ax, ay, bx, by))
    return F.when(seg_intersects(ax, ay, bx, by, cx, cy, dx, dy), 0.0).otherwise(apart)


def circumradius(x0, y0, x1, y1, x2, y2, eps: float = 1e-9) -> Column:
    """Radius through three points; null where a side or the turn is too small."""
    a, b, c, k = distance(x0, y0, x1, y1), distance(x1, y1, x2, y2), distance(x0, y0, x2, y2), F.abs(cross(x0, y0, x1, y1, x2, y2))
    return F.when((a > eps) & (b > eps) & (c > eps) & (k > eps), a * b * c / (k * 2))


def canonical_id(c: Column) -> Column:
    """Trimmed text; integral numbers lose their fraction; empty is null."""
    text = F.trim(c.cast("string"))
    return F.nullif(F.regexp_replace(text, r"^(-?[0-9]+)\.0+$", "$1"), F.lit(""))


def safe_name(c: Column) -> Column:
    """A file name of safe characters, stem cut at 120."""
    safe = F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "_")
    ext = F.regexp_extract(safe, r"(\.[A-Za-z0-9]+)$", 1)
    return F.concat(F.substring(safe, F.lit(1), F.least(F.length(safe) - F.length(ext), F.lit(120))), ext)


def line_key(scenario: Column, field: Column, level: Column, segment: Column) -> Column:
    return F.concat_ws(":", scenario, field, F.concat(F.lit("G"), level.cast("string")), F.concat(F.lit("S"), segment.cast("string")))


def scenario_key(prefix: str, interval: Column) -> Column:
    """prefix and an interval whose decimal point is a P: 1.50 gives 1P5, 2.00 gives 2."""
    return F.concat(F.lit(prefix), F.replace(F.regexp_replace(F.format_string("%.3f", interval), r"\.?0+$", ""), F.lit("."), F.lit("P")))


def first_path(json: Column, *paths: str, default: Column | None = None) -> Column:
    """First of several paths in a JSON text that is there and not null."""
    found = [F.get_json_object(json, p) for p in paths]
    return F.coalesce(*found, *([default] if default is not None else []))


def codes(c: Column) -> Column:
    """Sorted distinct codes of a comma or semicolon list."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")))


def codes_union(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """All codes of each group, sorted and joined."""
    one = df.select(*keys, F.explode_outer(codes(F.col(c))).alias("code")).groupBy(*keys)
    return one.agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


def row_hash(df: DataFrame, cols: list[str]) -> Column:
    """SHA-256 of a row's named values, whatever the order of the columns."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"}), 256)


def bundle_hash(files: DataFrame, key: str, name: str = "name", digest: str = "sha256") -> DataFrame:
    """One hash for the members of each bundle, by lower-case name; a single member keeps its own."""
    members = F.array_sort(F.collect_list(F.struct(F.lower(name).alias("n"), F.col(digest).alias("d"))))
    g = files.groupBy(key).agg(members.alias("m"), F.count(F.lit(1)).alias("members"))
    joined = F.aggregate("m", F.lit("").cast("binary"), lambda acc, x: F.concat(acc, x["n"].cast("binary"), F.unhex(F.lit("00")), F.unhex(x["d"])))
    return g.select(key, "members", F.when(F.col("members") == 1, F.col("m")[0]["d"]).otherwise(F.sha2(joined, 256)).alias("bundle_sha256"))


def flatten_json(df: DataFrame, json: str, keys: list[str], depth: int = 4, short: int = 8) -> DataFrame:
    """keys, path, value of the scalars and short scalar lists under a JSON object; lists of objects are dropped."""
    level = df.select(*keys, F.lit("").alias("path"), F.try_parse_json(F.col(json)).alias("v"))
    out = None
    for _ in range(depth):
        level.createOrReplaceTempView("__level")
        opened = level.sparkSession.sql(f"SELECT {', '.join('l.`' + k + '`' for k in keys)}, concat_ws('.', nullif(l.path, ''), e.key) AS path, e.value AS v FROM __level l, LATERAL variant_explode(l.v) e WHERE schema_of_variant(l.v) LIKE 'OBJECT%'")
        kind = F.expr("schema_of_variant(v)")
        text = F.col("v").cast("string")
        plain = ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY")
        listed = kind.startswith("ARRAY") & ~kind.contains("OBJECT") & (F.size(F.expr("try_variant_get(v, '$', 'array<string>')")) <= short)
        found = opened.filter(plain | listed).select(*keys, "path", F.when(plain, text).otherwise(F.to_json(F.col("v"))).alias("value"))
        out = found if out is None else out.unionByName(found)
        level = opened.filter(kind.startswith("OBJECT"))
    return out
