"""Grids as rows of cells (grid_id, row, col, v). A cell's neighbours are reached by equal keys, never by position in memory.

Unit spacing unless res says otherwise; the centre of cell (row, col) is ((col + 0.5) res, (row + 0.5) res).
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import expr as X
from furrow.operators.order import MOST, spread, summarise
from furrow.session import ship

RC = ["grid_id", "row", "col"]
c = F.col


def load_cells(df: DataFrame, nodata: float | None = None) -> DataFrame:
    """Cells whose v is null where it isn't a valid number."""
    bad = ~X.finite(c("v")) if nodata is None else ~X.finite(c("v")) | (F.abs(c("v") - nodata) < 1e-9)
    return df.withColumn("v", F.when(~bad, c("v")))


def quantiles(df: DataFrame, v: str, by: list[str]) -> DataFrame:
    """count, extremes, mean, population deviation, and exact percentiles of the valid values."""
    ps = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    aggs = [F.count(F.lit(1)).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")]
    return summarise(df.filter(X.finite(c(v))), by, aggs, {n: (v, p) for n, p in ps.items()})


def bands(df: DataFrame, v: str, breaks: list[float], by: list[str]) -> DataFrame:
    """Percentage of values in [breaks[i], breaks[i+1]), the last band open."""
    ends = [*breaks[1:], None]
    share = lambda lo, hi: F.count_if((c(v) >= lo) if hi is None else (c(v) >= lo) & (c(v) < hi)) * 100.0 / F.count(v)
    wide = df.groupBy(*by).agg(*[share(lo, hi).alias(f"b{i}") for i, (lo, hi) in enumerate(zip(breaks, ends, strict=True))])
    rows = F.explode(F.array(*[F.struct(F.lit(lo).alias("lo"), c(f"b{i}").alias("percent")) for i, lo in enumerate(breaks)]))
    return wide.select(*by, rows.alias("b")).select(*by, "b.*")


def mask_cells(cells: DataFrame, edges: DataFrame, all_touched: bool = False, res: float = 1.0) -> DataFrame:
    """field, grid_id, row, col of cells whose centre is in a polygon (holes respected). The crossings of each grid row
    with a field's edges (field, x0, y0, x1, y1), in order, pair up to the stretches that lie inside; these give the
    columns, which meet the cells by row and column. all_touched adds cells that an edge passes."""
    y0, y1 = F.least("y0", "y1"), F.greatest("y0", "y1")
    banded = edges.withColumn("row", F.explode(F.sequence(F.floor(y0 / res).cast("int"), F.floor(y1 / res).cast("int"))))
    y = (c("row") + 0.5) * res
    keys = cells.select(*RC)
    at = banded.filter((c("y0") > y) != (c("y1") > y)).select("field", "row", (c("x0") + (c("x1") - c("x0")) * (y - c("y0")) / (c("y1") - c("y0"))).alias("x"))
    w = Window.partitionBy("field", "row").orderBy("x")
    inside = at.withColumn("n", F.row_number().over(w)).withColumn("to", F.lead("x").over(w)).filter("n % 2 = 1 AND to IS NOT NULL")
    # the first column whose centre isn't left of an end
    first = lambda x: F.ceil(x / res - 0.5).cast("int")
    cols = inside.filter(first(c("to")) > first(c("x"))).select("field", "row", F.explode(F.sequence(first(c("x")), first(c("to")) - 1)).alias("col"))
    out = keys.join(cols.distinct(), ["row", "col"]).select("field", *RC)
    if all_touched:
        # an edge's columns in a row lie between its ends there
        e = lambda y: c("x0") + F.when(c("y1") != c("y0"), (c("x1") - c("x0")) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - c("y0")) / (c("y1") - c("y0"))))).otherwise(F.lit(None))
        low, high = e(c("row") * res), e((c("row") + 1) * res)
        a, b = F.least(F.coalesce(low, c("x0")), F.coalesce(high, c("x1"))), F.greatest(F.coalesce(low, c("x0")), F.coalesce(high, c("x1")))
        passed = banded.withColumn("col", F.explode(F.sequence(F.floor(a / res - 1e-9).cast("int"), F.floor(b / res + 1e-9).cast("int"))))
        met = keys.join(passed, ["row", "col"])
        dx, dy = c("x1") - c("x0"), c("y1") - c("y0")
        # the part of the edge within the cell's square has positive length or is a point
        t = lambda lo, d, a: (lo - a) / d
        low = F.greatest(F.when(dx != 0, F.least(t(c("col") * res, dx, c("x0")), t((c("col") + 1) * res, dx, c("x0")))).otherwise(0.0), F.when(dy != 0, F.least(t(c("row") * res, dy, c("y0")), t((c("row") + 1) * res, dy, c("y0")))).otherwise(0.0), F.lit(0.0))
        high = F.least(F.when(dx != 0, F.greatest(t(c("col") * res, dx, c("x0")), t((c("col") + 1) * res, dx, c("x0")))).otherwise(1.0), F.when(dy != 0, F.greatest(t(c("row") * res, dy, c("y0")), t((c("row") + 1) * res, dy, c("y0")))).otherwise(1.0), F.lit(1.0))
        in_x = (dx != 0) | c("x0").between(c("col") * res, (c("col") + 1) * res)
        in_y = (dy != 0) | c("y0").between(c("row") * res, (c("row") + 1) * res)
        out = out.unionByName(met.filter((low <= high) & in_x & in_y).select("field", *RC)).distinct()
    return out


def coverage(mask: DataFrame, cells: DataFrame) -> DataFrame:
    """Per field: cells, those without a value, and PASS only if there are cells and all have one."""
    out = mask.join(cells.select(*RC, "v"), RC, "left").groupBy("field").agg(F.count(F.lit(1)).alias("cells"), F.count_if(c("v").isNull()).alias("invalid"))
    return out.withColumn("verdict", F.when((c("cells") > 0) & (c("invalid") == 0), "PASS").otherwise("FAIL"))


def compare_surfaces(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences of two grids on their common valid cells."""
    d = a.select("row", "col", c("v").alias("a")).join(b.select("row", "col", c("v").alias("b")), ["row", "col"]).filter("a IS NOT NULL AND b IS NOT NULL").select((c("a") - c("b")).alias("d"), F.abs(c("a") - c("b")).alias("m"))
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.sqrt(F.avg(c("d") * c("d"))).alias("rmse"), F.max("m").alias("abs_max")]
    out = summarise(d, [], aggs, {"median": ("d", 0.5), "abs_median": ("m", 0.5), "abs_p95": ("m", 0.95), "abs_p99": ("m", 0.99)})
    return out.select("n", "mean", "median", "rmse", "abs_median", "abs_p95", "abs_p99", "abs_max")


def neighbour(cells: DataFrame, drow: int, dcol: int, name: str, v: str = "v") -> DataFrame:
    """cells with the value at (row + drow, col + dcol)."""
    other = cells.select("grid_id", (c("row") - drow).alias("row"), (c("col") - dcol).alias("col"), c(v).alias(name))
    return cells.join(other, RC, "left")


SIDES = ((0, 1), (0, -1), (1, 0), (-1, 0))


def beside(cells: DataFrame, values: list[str]) -> DataFrame:
    """cells with, for each of the values, those of the four cells beside it: right, left, up, down as __v0 to __v3. Each
    cell sends its values to its neighbours, and they meet in one aggregation."""
    sent = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(k).alias("k"), F.lit(i).alias("i")) for i, (r, k) in enumerate(SIDES)]))
    s = cells.select("grid_id", "row", "col", *values, sent.alias("o")).select("grid_id", (c("row") - c("o.r")).alias("row"), (c("col") - c("o.k")).alias("col"), c("o.i").alias("i"), *values)
    met = s.groupBy(*RC).agg(*[F.max(F.when(c("i") == i, c(v))).alias(f"__{v}{i}") for v in values for i in range(4)])
    # as large as the cells, so it isn't sent whole to the driver and every task while its compressed size seems small
    return cells.join(met.hint("shuffle_merge"), RC, "left")


def slopes(v: str, res: float) -> tuple[Column, Column]:
    """Centred difference along columns and along rows where both neighbours are valid, else the one-sided one that is, else
    null; of a value that beside() has seen."""
    here = c(v)
    one = lambda f, b: F.when(here.isNotNull(), F.coalesce((c(f"__{v}{f}") - c(f"__{v}{b}")) / (2 * res), (c(f"__{v}{f}") - here) / res, (here - c(f"__{v}{b}")) / res))
    return one(0, 1), one(2, 3)


def gradient(cells: DataFrame, res: float = 1.0, v: str = "v", gx: str = "gx", gy: str = "gy") -> DataFrame:
    """cells with the slopes of v."""
    x, y = slopes(v, res)
    return beside(cells, [v]).withColumns({gx: x, gy: y}).drop(*[f"__{v}{i}" for i in range(4)])


def horn(cells: DataFrame, res: float = 1.0) -> DataFrame:
    """Third-order finite differences over the full 3x3 neighbourhood: dzdx, dzdy (null where a neighbour lacks)."""
    w = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(k).alias("k"), F.lit(float(k * (2 if r == 0 else 1))).alias("wx"), F.lit(float(r * (2 if k == 0 else 1))).alias("wy")) for r in (-1, 0, 1) for k in (-1, 0, 1)])
    spread = cells.filter(c("v").isNotNull()).select("grid_id", "row", "col", "v", F.explode(w).alias("o"))
    at = spread.select("grid_id", (c("row") - c("o.r")).alias("row"), (c("col") - c("o.k")).alias("col"), (c("v") * c("o.wx")).alias("x"), (c("v") * c("o.wy")).alias("y"))
    s = at.groupBy(*RC).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")).filter("n = 9")
    return cells.join(s.select(*RC, (c("x") / (8 * res)).alias("dzdx"), (c("y") / (8 * res)).alias("dzdy")), RC, "left")


def slope(cells: DataFrame, res: float = 1.0) -> DataFrame:
    g = horn(cells, res).withColumn("slope_percent", F.sqrt(c("dzdx") * c("dzdx") + c("dzdy") * c("dzdy")) * 100)
    return g.withColumn("slope_degrees", F.degrees(F.atan(c("slope_percent") / 100)))


def hillshade(cells: DataFrame, res: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Shade 0..255 of light from azimuth and altitude; rows grow northwards."""
    zen, az = math.radians(90 - altitude), math.radians((450 - azimuth) % 360)
    dot = F.lit(math.cos(zen)) - F.lit(math.sin(zen)) * (c("dzdx") * math.cos(az) + c("dzdy") * math.sin(az))
    return horn(cells, res).withColumn("shade", F.greatest(F.lit(0.0), dot / F.sqrt(1 + c("dzdx") * c("dzdx") + c("dzdy") * c("dzdy"))) * 255)


def smooth(cells: DataFrame, sigma: float, v: str = "v", out: str = "smooth") -> DataFrame:
    """Gaussian mean over valid cells with weights that sum over valid cells only; null where the weight is next to
    nothing or the cell itself is invalid. The kernel ends at 4 sigma and is applied along rows, then columns."""
    if sigma <= 0:
        return cells.withColumn(out, c(v))
    n = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-n, n + 1)]
    kernel = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x / sum(raw)).alias("w")) for k, x in zip(range(-n, n + 1), raw, strict=True)])
    s = cells.filter(c(v).isNotNull()).select("grid_id", "row", "col", c(v).alias("s"), F.lit(1.0).alias("w"))
    for axis in ("col", "row"):
        keep = [x for x in RC if x != axis]
        s = s.select(*keep, c(axis), "s", "w", F.explode(kernel).alias("o")).select(*keep, (c(axis) + c("o.k")).alias(axis), (c("s") * c("o.w")).alias("s"), (c("w") * c("o.w")).alias("w"))
        s = s.groupBy(*RC).agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    return cells.join(s, RC, "left").withColumn(out, F.when(c(v).isNotNull() & (c("w") > 1e-6), c("s") / c("w"))).drop("s", "w")


def smooth_axial(cells: DataFrame, sigma: float) -> DataFrame:
    """Axis vectors (qx, qy) normalised and smoothed; coherence is the length of what is left."""
    n = F.sqrt(c("qx") * c("qx") + c("qy") * c("qy"))
    df = cells.withColumn("ux", F.when(n > 0, c("qx") / n)).withColumn("uy", F.when(n > 0, c("qy") / n))
    df = smooth(smooth(df, sigma, "ux", "sx"), sigma, "uy", "sy")
    return df.withColumn("coherence", F.sqrt(c("sx") * c("sx") + c("sy") * c("sy"))).drop("ux", "uy")


def axial_quality(smoothed: DataFrame, low: float, most_low: float) -> DataFrame:
    out = smoothed.filter("coherence IS NOT NULL").groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"), (F.count_if(c("coherence") < low) / F.count(F.lit(1))).alias("low_share"))
    return out.withColumn("blocker", F.when(c("low_share") > most_low, "AXIAL_COHERENCE_TOO_LOW"))


def axial_jumps(cells: DataFrame, limit: float) -> DataFrame:
    """Angle differences between 4-neighbours (v: axis in degrees): pairs, p95, max, share over the limit."""
    j = None
    for r, k in ((0, 1), (1, 0)):
        one = neighbour(cells, r, k, "other").filter("v IS NOT NULL AND other IS NOT NULL").select("grid_id", X.axial_diff(c("v"), c("other")).alias("jump"))
        j = one if j is None else j.unionByName(one)
    aggs = [F.count(F.lit(1)).alias("pairs"), F.max("jump").alias("max"), (F.count_if(c("jump") > limit) / F.count(F.lit(1))).alias("share_over")]
    return summarise(j, ["grid_id"], aggs, {"p95": ("jump", 0.95)}).select("grid_id", "pairs", "p95", "max", "share_over")


def critical_indicators(cells: DataFrame, floor: float, curve: float, most: float, res: float = 1.0) -> DataFrame:
    """Shares of cells with next to no gradient, and with a strongly curved phase; codes where they pass `most`."""
    g = beside(gradient(cells, res), ["gx", "gy"]).withColumns({"gxx": slopes("gx", res)[0], "gyy": slopes("gy", res)[1]})
    flat = F.sqrt(c("gx") * c("gx") + c("gy") * c("gy")) < floor
    bent = F.abs(c("gxx") + c("gyy")) * res > curve
    out = g.filter("gxx IS NOT NULL AND gyy IS NOT NULL").groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"), (F.count_if(flat) / F.count(F.lit(1))).alias("flat_share"), (F.count_if(bent) / F.count(F.lit(1))).alias("bent_share"))
    codes = F.array_compact(F.array(F.when(c("flat_share") > most, "GRADIENT_BELOW_FLOOR"), F.when(c("bent_share") > most, "CURVATURE_ABOVE_LIMIT")))
    return out.withColumn("blockers", F.array_join(codes, ","))


def normal_spacing(cells: DataFrame, step: float, nominal: float, tol: float, res: float = 1.0) -> DataFrame:
    """Spacing of levels `step` apart along the gradient: percentiles, and the share farther than tol from nominal."""
    g = gradient(cells, res).withColumn("g", F.sqrt(c("gx") * c("gx") + c("gy") * c("gy"))).filter("g > 1e-9").withColumn("s", F.lit(step) / c("g"))
    aggs = [F.count(F.lit(1)).alias("n"), (F.count_if(F.abs(c("s") - nominal) > tol * nominal) / F.count(F.lit(1))).alias("outside_share")]
    out = summarise(g, ["grid_id"], aggs, {"p05": ("s", 0.05), "p50": ("s", 0.5), "p95": ("s", 0.95)})
    return out.select("grid_id", "n", "p05", "p50", "p95", "outside_share")


def spacing_from_levels(cells: DataFrame, levels: DataFrame) -> DataFrame:
    """Each cell (phi, grad) takes the interval between declared levels that holds its phase, clipped to the first and
    last; spacing is interval over gradient, infinite where the gradient is next to nothing. levels: grid_id, level."""
    every = levels.groupBy("grid_id").agg(F.sort_array(F.collect_set("level")).alias("__levels")).filter(F.size("__levels") > 1)
    # how many levels aren't above the phase, by bisection: steps of falling powers of two
    steps = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.lit(1 << 30) / F.pow(F.lit(2.0), k)).cast("array<int>")
    below = lambda at, step: F.when((at + step <= F.size("__levels")) & (F.get("__levels", at + step - 1) <= c("phi")), at + step).otherwise(at)
    n = F.aggregate(steps, F.lit(0), below)
    # the interval that begins with the last of them, and no further than the last interval
    at = F.greatest(F.lit(1), F.least(n, F.size("__levels") - 1))
    gap = F.get("__levels", at) - F.get("__levels", at - 1)
    out = cells.join(every, "grid_id").filter(c("phi").isNotNull())
    return out.withColumn("spacing", F.when(c("grad") > 1e-6, gap / c("grad")).otherwise(float("inf"))).drop("__levels")


#: Cells of a field that a task may gather.
GATHER = 50_000


def orientation_sweep(cells: DataFrame, angles: list[float], lambdas: list[float], spacing: float, target: float, alert: float, tol: float, most: int = MOST, gather: int = GATHER) -> DataFrame:
    """Cells (field, gx, gy: rise over run) x angles x lambdas. The rows of an orientation are the level lines of a phase
    whose gradient is the normal of angle theta plus lambda times the terrain's; returned are the grades along and across
    them (percent), how far they turn from theta, their spacing if levels are `spacing` times the median phase gradient
    apart, and the shares (percent) over target and alert, outside the spacing's tolerance, and next to singular.

    Fields of up to `gather` cells are dealt by field, so a cell is shuffled once, and tasks make its 180 or so orientations.
    Those of larger fields are made where a cell is read, and made again by each pass; what is shuffled are counts and
    extremes, or, of groups of at most `most` cells, their distinct values."""
    cells = cells.filter("gx IS NOT NULL AND gy IS NOT NULL").select("field", "gx", "gy")
    plain = (F.abs(c("gx")) < 1e100) & (F.abs(c("gy")) < 1e100)  # neither infinite nor NaN
    cells = cells.checkpoint()
    large = cells.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.bool_and(plain).alias("plain")).filter(c("field").isNull() | (c("n") > gather) | ~c("plain")).select("field").checkpoint()
    if large.isEmpty():
        return _sweep_fields(cells, angles, lambdas, spacing, target, alert, tol)
    same = cells["field"].eqNullSafe(large["field"])
    out = _sweep_fields(cells.join(large, same, "left_anti"), angles, lambdas, spacing, target, alert, tol)
    return out.unionByName(_sweep_cells(cells.join(large, same, "left_semi"), angles, lambdas, spacing, target, alert, tol, most))


#: Percentiles of a sweep: name, measure, share.
_SWEPT = (("along_p50", "along", 0.5), ("along_p90", "along", 0.9), ("along_p95", "along", 0.95), ("cross_p95", "cross", 0.95), ("deflection_p95", "deflection", 0.95), ("mag_p50", "mag", 0.5), ("spacing_p05", "inverse", 0.05), ("spacing_p50", "inverse", 0.5), ("spacing_p95", "inverse", 0.95))


def _at_share(v: np.ndarray, p: float) -> np.ndarray:
    """Percentile of each row of sorted values, of those that are finite; NaN where there is none."""
    n = np.isfinite(v).sum(1)
    at = np.maximum(n - 1, 0) * p
    low, high = np.floor(at).astype(int), np.ceil(at).astype(int)
    k = np.arange(len(v))
    with np.errstate(invalid="ignore"):
        between = (high - at) * v[k, low] + (at - low) * v[k, high]
    return np.where(n == 0, np.nan, np.where(low == high, v[k, low], between))


def _sweep_fields(cells: DataFrame, angles: list[float], lambdas: list[float], spacing: float, target: float, alert: float, tol: float) -> DataFrame:
    """orientation_sweep() of fields that are gathered."""
    ship(cells.sparkSession)
    params = [(float(a), float(k), math.cos(math.radians(a)), math.sin(math.radians(a))) for a in angles for k in lambdas]
    shares = ["along_max", "cross_max", "over_target", "over_alert", "singular", *[n for n, _, _ in _SWEPT if n != "mag_p50"], "level_step", "spacing_outside"]
    kind = f"field {cells.schema['field'].dataType.simpleString()}, theta double, lam double, n bigint, " + ", ".join(f"{n} double" for n in shares)

    def some(gx: np.ndarray, gy: np.ndarray, theta: np.ndarray, lam: np.ndarray, bx: np.ndarray, by: np.ndarray) -> dict[str, np.ndarray]:
        lam, bx, by = lam[:, None], bx[:, None], by[:, None]
        px, py = lam * gx - by, lam * gy + bx
        mag = np.sqrt(px * px + py * py)
        steep = mag > 1e-6
        size = np.where(steep, mag, 1.0)
        nx, ny = np.where(steep, px / size, 0.0), np.where(steep, py / size, 0.0)
        m = {"along": np.abs(gy * nx - gx * ny) * 100, "cross": np.abs(gx * nx + gy * ny) * 100, "deflection": np.degrees(np.arccos(np.minimum(1.0, np.abs(by * nx - bx * ny)))), "mag": mag, "inverse": np.where(steep, 1 / size, np.inf)}
        percent = lambda cond: cond.sum(1) * 100.0 / len(gx)
        out = {"over_target": percent(m["along"] > target), "over_alert": percent(m["along"] > alert), "singular": percent(mag < 0.35)}
        inverse = m["inverse"]
        ordered = {k: np.sort(v, axis=1) for k, v in m.items()}
        out |= {n: _at_share(ordered[v], p) for n, v, p in _SWEPT}
        out |= {f"{v}_max": ordered[v][:, -1] for v in ("along", "cross")}
        step = out["level_step"] = out.pop("mag_p50") * spacing
        with np.errstate(invalid="ignore"):
            out["spacing_outside"] = percent(~(np.abs(inverse * step[:, None] / spacing - 1) <= tol))
        # a level interval is the same everywhere, so spacing is in proportion to the inverse gradient
        return out | {n: out[n] * step for n in ("spacing_p05", "spacing_p50", "spacing_p95")}

    def swept(t: pa.Table) -> pa.Table:
        gx, gy = t.column("gx").to_numpy(), t.column("gy").to_numpy()
        p = np.array(params)
        each = max(1, 500_000 // len(gx))
        parts = [some(gx, gy, *p[k : k + each].T) for k in range(0, len(p), each)]
        told = {n: pa.array(np.concatenate([x[n] for x in parts]), from_pandas=True) for n in shares}
        return pa.table({"field": pa.repeat(t.column("field")[0], len(p)), "theta": p[:, 0], "lam": p[:, 1], "n": np.full(len(p), len(gx)), **told})

    return spread(cells, "field").groupBy("field").applyInArrow(swept, kind)


def _sweep_cells(cells: DataFrame, angles: list[float], lambdas: list[float], spacing: float, target: float, alert: float, tol: float, most: int) -> DataFrame:
    """orientation_sweep() of fields of any size."""
    params = F.array(*[F.struct(F.lit(float(a)).alias("theta"), F.lit(float(k)).alias("lam"), *[F.lit(f(math.radians(a))).alias(n) for f, n in ((math.cos, "bx"), (math.sin, "by"))]) for a in angles for k in lambdas])
    p = cells.select("field", "gx", "gy", F.explode(params).alias("p")).select("field", "gx", "gy", "p.*")
    px, py = c("lam") * c("gx") - c("by"), c("lam") * c("gy") + c("bx")
    p = p.withColumn("px", px).withColumn("py", py).withColumn("mag", F.sqrt(c("px") * c("px") + c("py") * c("py")))
    unit = lambda x: F.when(c("mag") > 1e-6, x / c("mag")).otherwise(0.0)
    nx, ny = unit(c("px")), unit(c("py"))
    p = p.withColumn("along", F.abs(c("gy") * nx - c("gx") * ny) * 100).withColumn("cross", F.abs(c("gx") * nx + c("gy") * ny) * 100)
    p = p.withColumn("deflection", F.degrees(F.acos(F.least(F.lit(1.0), F.abs(c("by") * nx - c("bx") * ny))))).withColumn("inverse", F.when(c("mag") > 1e-6, 1 / c("mag")).otherwise(float("inf")))
    by, n = ["field", "theta", "lam"], F.count(F.lit(1))
    percent = lambda cond: F.count_if(cond) * 100.0 / n
    aggs = [n.alias("n"), F.max("along").alias("along_max"), F.max("cross").alias("cross_max"), percent(c("along") > target).alias("over_target"), percent(c("along") > alert).alias("over_alert"), percent(c("mag") < 0.35).alias("singular")]
    wants = {n: (v, p) for n, v, p in _SWEPT}
    out = summarise(p, by, aggs, wants, most, write=False)
    out = out.withColumn("level_step", c("mag_p50") * spacing).checkpoint()
    # a level interval is the same everywhere, so spacing is in proportion to the inverse gradient
    off = F.abs(c("inverse") * c("level_step") / spacing - 1) > tol
    outside = p.join(out.select(*by, "level_step"), by).groupBy(*by).agg(percent(off).alias("spacing_outside"))
    return out.join(outside, by).withColumns({f"spacing_{k}": c(f"spacing_{k}") * c("level_step") for k in ("p05", "p50", "p95")}).drop("mag_p50")


def sample(cells: DataFrame, points: DataFrame, res: float = 1.0) -> DataFrame:
    """points (point_id, x, y) with bilinear and nearest values; null where the nearest cell isn't valid. Corners
    without a value take no part in the mean."""
    u, v = c("x") / res - 0.5, c("y") / res - 0.5
    p = points.withColumn("k0", F.floor(u).cast("int")).withColumn("r0", F.floor(v).cast("int")).withColumn("fx", u - F.floor(u)).withColumn("fy", v - F.floor(v))
    four = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(k).alias("k"), ((c("fy") if r else 1 - c("fy")) * (c("fx") if k else 1 - c("fx"))).alias("w")) for r in (0, 1) for k in (0, 1)])
    own = p.withColumn("o", F.explode(four)).select("point_id", "x", "y", (c("r0") + c("o.r")).alias("row"), (c("k0") + c("o.k")).alias("col"), c("o.w").alias("w"))
    near = (c("row") == F.floor(c("y") / res)) & (c("col") == F.floor(c("x") / res))
    hit = own.join(cells.select("row", "col", "v"), ["row", "col"], "left")
    out = hit.groupBy("point_id").agg(F.max(F.when(near, c("v"))).alias("nearest"), F.sum(F.when(c("v").isNotNull(), c("v") * c("w"))).alias("s"), F.sum(F.when(c("v").isNotNull(), c("w"))).alias("w"))
    return out.select("point_id", "nearest", F.when(c("nearest").isNotNull(), c("s") / F.nullif(c("w"), F.lit(0.0))).alias("bilinear"))


def idw_grid(points: DataFrame, res: float, reach: float = 1.5) -> DataFrame:
    """Inverse-distance mean of the ground points (x, y, z) within reach * res of each cell centre."""
    n = math.ceil(reach)
    off = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(k).alias("k")) for r in range(-n, n + 1) for k in range(-n, n + 1)]))
    df = points.select("x", "y", "z", F.floor(c("y") / res).alias("r0"), F.floor(c("x") / res).alias("k0"), off.alias("o")).select("x", "y", "z", (c("r0") + c("o.r")).cast("int").alias("row"), (c("k0") + c("o.k")).cast("int").alias("col"))
    d = X.distance(c("x"), c("y"), (c("col") + 0.5) * res, (c("row") + 0.5) * res)
    df = df.withColumn("d", d).filter(c("d") <= reach * res).withColumn("w", 1 / F.greatest(c("d"), F.lit(1e-9)))
    return df.groupBy("row", "col").agg((F.sum(c("w") * c("z")) / F.sum("w")).alias("v"), F.count(F.lit(1)).alias("n"))


def density_grid(points: DataFrame, res: float) -> DataFrame:
    """Points within res / sqrt(2) of each cell centre."""
    out = idw_grid(points, res, 1 / math.sqrt(2))
    return out.select("row", "col", "n")


def point_profile(points: DataFrame) -> DataFrame:
    """One row: extremes, classes, returns and times of a point table, and whether it has colours: the columns red, green
    and blue with a value other than zero in any row."""
    rgb = [n for n in ("red", "green", "blue") if n in points.columns]
    coloured = F.coalesce(F.max(reduce(lambda a, b: a | b, [F.coalesce(c(n) != 0, F.lit(False)) for n in rgb])), F.lit(False)) if len(rgb) == 3 else F.lit(False)
    return points.agg(
        coloured.alias("has_rgb"),
        F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{n}_{a}") for a in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))], F.min("classification").alias("min_class"), F.max("classification").alias("max_class"),
        F.count_if(c("classification") == 2).alias("ground"), F.avg("returns").alias("mean_returns"), F.min("time").alias("min_time"), F.max("time").alias("max_time"),
    )


def flow_sensitivity(cells: DataFrame, mask: DataFrame, thresholds: list[float], pixel: float) -> DataFrame:
    """Active cells (area in v, ha) per threshold, in all and in fields, and the upper bound of channel length in km."""
    m = cells.join(mask.select(*RC).distinct().withColumn("inside", F.lit(True)), RC, "left").filter("v IS NOT NULL")
    wide = m.agg(*[x for i, t in enumerate(thresholds) for x in (F.count_if(c("v") >= t).alias(f"n{i}"), F.count_if((c("v") >= t) & c("inside")).alias(f"f{i}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), c(f"n{i}").alias("active"), c(f"f{i}").alias("active_in_fields")) for i, t in enumerate(thresholds)]))
    return wide.select(rows.alias("r")).select("r.*").withColumn("length_km", c("active") * pixel / 1000)


def basin_summary(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Distinct positive ids in all and in fields, and the share of field cells with an id (v: id)."""
    m = cells.join(mask.select(*RC).distinct().withColumn("inside", F.lit(True)), RC, "left")
    pos = c("v") > 0
    return m.agg(F.countDistinct(F.when(pos, c("v"))).alias("basins"), F.countDistinct(F.when(pos & c("inside"), c("v"))).alias("basins_inside"), (F.count_if(pos & c("inside")) * 100.0 / F.count_if(c("inside"))).alias("classified_percent"))


def path_summary(cells: DataFrame, mask: DataFrame, pixel: float) -> DataFrame:
    m = cells.join(mask.select(*RC).distinct().withColumn("inside", F.lit(True)), RC, "left").filter("v > 0")
    return m.agg(F.count(F.lit(1)).alias("cells"), F.count_if("inside").alias("inside"), (F.count_if("inside") * pixel).alias("length_m"))


def focal_max(cells: DataFrame, k: int) -> DataFrame:
    """Largest valid value in the k x k window (cells beyond the edge repeat the edge, so they add nothing): of k cells along
    the row first, of k such along the column then."""
    h = k // 2
    far = lambda df, x: df.select("grid_id", *[c(n) if n != x else (c(n) + c("o")).alias(n) for n in ("row", "col")], "v").groupBy(*RC).agg(F.max("v").alias("v"))
    spread = lambda df: df.withColumn("o", F.explode(F.sequence(F.lit(-h), F.lit(h))))
    s = far(spread(far(spread(cells.filter("v IS NOT NULL").select(*RC, "v")), "col")), "row")
    return cells.select(*RC, "v").join(s.withColumnRenamed("v", "focal"), RC, "left")


def mask_boundary(mask: DataFrame) -> DataFrame:
    """Cells of a mask that lack one of their eight neighbours."""
    off = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(k).alias("k")) for r in (-1, 0, 1) for k in (-1, 0, 1)]))
    cells = mask.select(*RC).distinct()
    s = cells.select("grid_id", "row", "col", off.alias("o")).select("grid_id", (c("row") + c("o.r")).alias("row"), (c("col") + c("o.k")).alias("col"))
    return cells.join(s.groupBy(*RC).agg(F.count(F.lit(1)).alias("n")), RC).filter("n < 9").drop("n")


def crossing_candidates(cells: DataFrame, mask: DataFrame, k: int = 8, radius: float = 40.0, least: float = 0.5, res: float = 1.0) -> DataFrame:
    """Of each grid, the k best boundary cells that are local maxima of area (v), best first, none within radius of a
    better pick of that grid: rank, grid_id, row, col, v. k rounds for all grids at once; each takes the best cell that a
    grid has left (of equal ones the first by row and column) and drops what is near it."""
    peak = focal_max(cells, 7).filter("v = focal AND v >= " + str(least)).drop("focal")
    left, out = peak.join(mask_boundary(mask), RC).select(*RC, "v").checkpoint(), None
    for rank in range(1, k + 1):
        best = left.groupBy("grid_id").agg(F.max(F.struct("v", -c("row"), -c("col"))).alias("b"))
        best = best.select(F.lit(rank).alias("rank"), "grid_id", (-c("b")["col2"]).alias("row"), (-c("b")["col3"]).alias("col"), c("b.v").alias("v"))
        out = best if out is None else out.unionByName(best)
        if rank < k:
            at = best.select("grid_id", c("row").alias("__r"), c("col").alias("__c"))
            far = X.distance(c("row").cast("double"), c("col").cast("double"), c("__r").cast("double"), c("__c").cast("double")) * res > radius
            left = left.join(at, "grid_id").filter(far).drop("__r", "__c").checkpoint()
    return out


def isoline_segments(cells: DataFrame, interval: float, offset: float = 0.0, res: float = 1.0) -> DataFrame:
    """level, x0, y0, x1, y1, len: in each square of four valid centres, two triangles, and in each triangle one straight
    segment for every level strictly between its lowest and highest corner."""
    q = neighbour(neighbour(neighbour(cells, 0, 1, "b"), 1, 0, "d"), 1, 1, "e").filter("v IS NOT NULL AND b IS NOT NULL AND d IS NOT NULL AND e IS NOT NULL")
    corner = lambda r, k, z: F.struct(((c("col") + k + 0.5) * res).alias("x"), ((c("row") + r + 0.5) * res).alias("y"), z.alias("z"))
    A, B, D, E = corner(0, 0, c("v")), corner(0, 1, c("b")), corner(1, 0, c("d")), corner(1, 1, c("e"))
    tri = q.select(*RC, F.posexplode(F.array(F.array(A, B, D), F.array(B, E, D))).alias("t", "p"))
    p = tri.select(*RC, "t", F.array_sort("p", lambda m, n: F.when(m["z"] < n["z"], -1).when(m["z"] > n["z"], 1).when(m["x"] < n["x"], -1).when(m["x"] > n["x"], 1).when(m["y"] < n["y"], -1).otherwise(1)).alias("p"))
    lo, mid, hi = c("p")[0], c("p")[1], c("p")[2]
    first, last = F.floor((lo["z"] - offset) / interval) + 1, F.ceil((hi["z"] - offset) / interval) - 1
    lv = p.withColumn("k", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))).withColumn("level", c("k") * interval + offset)
    cut = lambda m, n: F.struct((m["x"] + (n["x"] - m["x"]) * (c("level") - m["z"]) / (n["z"] - m["z"])).alias("x"), (m["y"] + (n["y"] - m["y"]) * (c("level") - m["z"]) / (n["z"] - m["z"])).alias("y"))
    lv = lv.withColumn("s", cut(lo, hi)).withColumn("u", F.when(c("level") < mid["z"], cut(lo, mid)).when(c("level") == mid["z"], F.struct(mid["x"].alias("x"), mid["y"].alias("y"))).otherwise(cut(mid, hi)))
    return lv.select(*RC, "t", "level", c("s.x").alias("x0"), c("s.y").alias("y0"), c("u.x").alias("x1"), c("u.y").alias("y1"), X.distance(c("s.x"), c("s.y"), c("u.x"), c("u.y")).alias("len"))


def contour_summary(segments: DataFrame, mask: DataFrame) -> DataFrame:
    m = segments.join(mask.select(*RC).distinct().withColumn("inside", F.lit(True)), RC, "left")
    return m.agg(F.count(F.lit(1)).alias("segments"), F.count_if("inside").alias("inside"), F.countDistinct("level").alias("levels"), F.min("level").alias("lowest"), F.max("level").alias("highest"), F.sum("len").alias("length"), F.sum(F.when(c("inside"), c("len"))).alias("length_inside"))


def decimate_mesh(cells: DataFrame, max_axis: int = 129) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of each grid at most max_axis evenly spaced rows and columns, the first and the last among them: vertices (valid
    sampled cells); quads between neighbouring samples, kept if all their source cells are there and valid; and a row a
    grid with the sampled size, vertices, triangles and quads left out.

    A source cell meets the blocks that hold it by its row's and its column's own sample, so no cell is compared with
    blocks that it isn't in."""
    if not 3 <= max_axis <= 257:
        raise ValueError("mesh dimension must be between 3 and 257")
    size = cells.groupBy("grid_id").agg((F.max("row") + 1).cast("int").alias("rows"), (F.max("col") + 1).cast("int").alias("cols"))
    size = size.withColumn("m", F.least(c("rows"), F.lit(max_axis))).withColumn("n", F.least(c("cols"), F.lit(max_axis)))
    # the i-th of m samples over 0..rows - 1, rounded down
    sample_at = lambda i, m, last: F.when(m > 1, F.floor(i * (last - 1) / (m - 1) + 1e-9)).otherwise(0).cast("int")
    axis = lambda count, last, name: size.select("grid_id", count.alias("m"), last.alias("last"), F.explode(F.sequence(F.lit(0), count - 1)).alias("i")).select("grid_id", "i", sample_at(c("i"), c("m"), c("last")).alias(name))
    rows, cols = axis(c("m"), c("rows"), "row"), axis(c("n"), c("cols"), "col")
    verts = cells.filter(c("v").isNotNull()).join(rows.withColumnRenamed("i", "mr"), ["grid_id", "row"]).join(cols.withColumnRenamed("i", "mc"), ["grid_id", "col"]).select("grid_id", "mr", "mc", "row", "col", "v")

    # the blocks of a row: that between the samples around it; a sampled row ends one block and begins the next
    def blocks(x: str, m: Column, last: Column) -> Column:
        i = F.floor(c(x) * (m - 1) / F.greatest(last - 1, F.lit(1))).cast("int")
        held = lambda k: (k >= 0) & (k <= m - 2) & (sample_at(k, m, last) <= c(x)) & (c(x) <= sample_at(k + 1, m, last))
        return F.filter(F.sequence(i - 2, i + 2), held)

    own = cells.join(size, "grid_id").withColumn("br", F.explode(blocks("row", c("m"), c("rows")))).withColumn("bc", F.explode(blocks("col", c("n"), c("cols"))))
    span = lambda k, m, last: sample_at(k + 1, m, last) - sample_at(k, m, last) + 1
    need = span(c("br"), c("m"), c("rows")) * span(c("bc"), c("n"), c("cols"))
    quads = own.groupBy("grid_id", "br", "bc").agg(F.count_if(c("v").isNotNull()).alias("valid"), F.first(need).alias("cells"))
    quads = quads.withColumn("kept", c("valid") == c("cells"))
    all_quads = size.select("grid_id", c("m").alias("sampled_rows"), c("n").alias("sampled_cols"), ((c("m") - 1).cast("bigint") * (c("n") - 1)).alias("quads"))
    kept = quads.groupBy("grid_id").agg(F.count_if("kept").alias("kept"))
    total = all_quads.join(kept, "grid_id", "left").join(verts.groupBy("grid_id").agg(F.count(F.lit(1)).alias("vertices")), "grid_id", "left").fillna(0, ["kept", "vertices"])
    return verts, quads, total.select("grid_id", "sampled_rows", "sampled_cols", "vertices", (2 * c("kept")).alias("triangles"), (c("quads") - c("kept")).alias("omitted_quads"))


def grid_components(mask: DataFrame, work: str | None = None) -> DataFrame:
    """field, components: 4-connected parts of each field's mask, and PASS only if there is one."""
    from furrow.operators.graph import components

    key = lambda r, k: F.struct("field", "grid_id", (c("row") + r).alias("row"), (c("col") + k).alias("col"))
    nodes = mask.select(key(0, 0).alias("n"), "field").distinct()
    right = nodes.select("n", F.explode(F.array(*[F.struct(c("n.field").alias("field"), c("n.grid_id").alias("grid_id"), (c("n.row") + r).alias("row"), (c("n.col") + k).alias("col")) for r, k in ((0, 1), (1, 0))])).alias("m"))
    edges = right.join(nodes.select(c("n").alias("m")), "m").select(c("n").alias("a"), c("m").alias("b"))
    label = components(nodes.select(c("n").alias("node")), edges)
    out = label.groupBy("node.field").agg(F.countDistinct("component").alias("components"))
    return out.withColumn("verdict", F.when(c("components") == 1, "PASS").otherwise("FAIL"))
