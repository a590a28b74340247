"""Lines, rings and segments as vertex rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import expr as X
from furrow.operators.copies import blocks, member_pairs, packed
from furrow.operators.order import spread, summarise
from furrow.session import ship


def segments(vertices: DataFrame, key: str | list[str]) -> DataFrame:
    """Keys, seq, x0, y0, x1, y1 (z0, z1 if there is a z) and len of each pair of neighbouring vertices."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy("seq")
    cols = [c for c in ("x", "y", "z") if c in vertices.columns]
    out = vertices.select(*keys, "seq", *[F.col(c).alias(f"{c}0") for c in cols], *[F.lead(c).over(w).alias(f"{c}1") for c in cols]).filter("x1 IS NOT NULL")
    return out.withColumn("len", X.distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


def _column(prefix: str, k: Column, pad: Column, cell: float) -> tuple[Column, Column]:
    """First and last grid row of the cells that a segment passes, widened by pad, in grid column k."""
    c = lambda n: F.col(f"{prefix}{n}")
    left, right = k * cell - pad, (k + 1) * cell + pad
    dx = c("x1") - c("x0")
    at = lambda x: F.when(F.abs(dx) < 1e-12, F.lit(None)).otherwise(c("y0") + (c("y1") - c("y0")) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - c("x0")) / dx)))
    low = F.coalesce(F.least(at(left), at(right)), F.least(c("y0"), c("y1"))) - pad
    high = F.coalesce(F.greatest(at(left), at(right)), F.greatest(c("y0"), c("y1"))) + pad
    return F.floor(low / cell), F.floor(high / cell)


def _cells(df: DataFrame, pad: Column, cell: float, prefix: str) -> DataFrame:
    """A row for each grid cell that a segment passes, widened by pad. The segment is cut at cell columns, so a long one
    takes the cells along it, not its whole bounding box."""
    c = lambda n: F.col(f"{prefix}{n}")
    lo, hi = F.least(c("x0"), c("x1")) - pad, F.greatest(c("x0"), c("x1")) + pad
    df = df.withColumn("__cx", F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell))))
    low, high = _column(prefix, F.col("__cx"), pad, cell)
    return df.withColumn("__cy", F.explode(F.sequence(low, high)))


def _first_shared(a: list[np.ndarray], b: list[np.ndarray], pad: np.ndarray, cx: np.ndarray, cy: np.ndarray, cell: float) -> np.ndarray:
    """Whether a cell that two segments (x0, y0, x1, y1) share is the first by column, then row; the second is widened by pad.
    The same steps as in _column(), so that both tell the same cells."""

    def column(s: list[np.ndarray], k: np.ndarray, pad: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        x0, y0, x1, y1 = s
        dx = x1 - x0
        steep = np.abs(dx) < 1e-12
        at = lambda x: y0 + (y1 - y0) * np.maximum(0.0, np.minimum(1.0, (x - x0) / np.where(steep, 1.0, dx)))
        p, q = at(k * cell - pad), at((k + 1) * cell + pad)
        low, high = np.where(steep, np.minimum(y0, y1), np.minimum(p, q)), np.where(steep, np.maximum(y0, y1), np.maximum(p, q))
        return np.floor((low - pad) / cell), np.floor((high + pad) / cell)

    def shared(i: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (a0, a1), (b0, b1) = column([v[i] for v in a], k, 0.0), column([v[i] for v in b], k, pad[i])
        return np.maximum(a0, b0), np.minimum(a1, b1)

    i = np.arange(len(cx))
    out = cy == shared(i, cx)[0]
    k = np.maximum(np.floor(np.minimum(a[0], a[2]) / cell), np.floor((np.minimum(b[0], b[2]) - pad) / cell))
    while True:
        i = i[out[i] & (k[i] < cx[i])]
        if not len(i):
            return out
        low, high = shared(i, k[i])
        out[i] = low > high
        k[i] += 1


def _distance(cell: float) -> Callable[..., Column]:
    """expr.seg_seg_dist over batches of rows, null where it is over the buffer or the cell isn't the first that both share. As a
    Spark expression it is longer than what the JVM compiles, and Spark would look for the first cell of pairs that aren't
    near as well: it moves filters that don't need the distance before it."""

    def between(
        ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, cx: pd.Series, cy: pd.Series, dx: pd.Series, dy: pd.Series, buffer: pd.Series, column: pd.Series, row: pd.Series
    ) -> pd.Series:
        far = buffer.to_numpy(dtype=float)
        ends = [v.to_numpy(dtype=float) for v in (ax, ay, bx, by, cx, cy, dx, dy)]
        with np.errstate(all="ignore"):
            d = _apart(*ends)
            near = np.flatnonzero(d <= far)
            at = [v[near] for v in ends]
            first = _first_shared(at[:4], at[4:], far[near] + 1e-6, column.to_numpy(dtype=float)[near], row.to_numpy(dtype=float)[near], cell)
        out = np.full(len(d), np.nan)
        out[near[first]] = d[near[first]]
        return pd.Series(out)  # NaN becomes null

    return F.pandas_udf(between, "double")


def _apart(ax, ay, bx, by, cx, cy, dx, dy) -> np.ndarray:
    """Distances of segments from a to b and from p to q, as in expr.seg_seg_dist."""
    a, b, p, q = (ax, ay), (bx, by), (cx, cy), (dx, dy)
    eps = 1e-9

    def away(o, s, e):
        ux, uy = e[0] - s[0], e[1] - s[1]
        n = ux * ux + uy * uy
        t = np.where(n > 0, np.minimum(np.maximum(((o[0] - s[0]) * ux + (o[1] - s[1]) * uy) / np.where(n > 0, n, 1.0), 0.0), 1.0), 0.0)
        vx, vy = o[0] - (s[0] + ux * t), o[1] - (s[1] + uy * t)
        return np.sqrt(vx * vx + vy * vy)

    turn = lambda s, e, o: (e[0] - s[0]) * (o[1] - s[1]) - (e[1] - s[1]) * (o[0] - s[0])
    beside = lambda x, y: ((x > eps) & (y < -eps)) | ((x < -eps) & (y > eps))
    held = lambda v, x, y: (v >= np.minimum(x, y) - eps) & (v <= np.maximum(x, y) + eps)
    on = lambda t, s, e, o: (np.abs(t) <= eps) & held(o[0], s[0], e[0]) & held(o[1], s[1], e[1])
    t = turn(a, b, p), turn(a, b, q), turn(p, q, a), turn(p, q, b)
    meet = (beside(t[0], t[1]) & beside(t[2], t[3])) | on(t[0], a, b, p) | on(t[1], a, b, q) | on(t[2], p, q, a) | on(t[3], p, q, b)
    return np.where(meet, 0.0, np.minimum(np.minimum(away(a, p, q), away(b, p, q)), np.minimum(away(p, a, b), away(q, a, b))))


def segments_within(a: DataFrame, b: DataFrame, buffer: str | float, cell: float = 50.0, on: list[str] | None = None, more: tuple[list[str], list[str]] = ([], []), ends: bool = False) -> DataFrame:
    """a_id, a_seq, b_id, b_seq, dist of segments (id, seq, x0, y0, x1, y1) no farther apart than the buffer (a number,
    or a column of b). Both sides are spread over grid cells and meet by equal cell (and by equal `on` columns). more:
    columns of a and of b to carry along; ends: carry the coordinates (a_x0 and so on).

    A pair counts in the first cell that both share (by column, then row), which either row can tell from the two
    segments; so nothing is shuffled after it is measured."""
    on = on or []
    ship(a.sparkSession)
    side = lambda df, p, extra: df.select(*on, *[F.col(c).alias(f"{p}_{c}") for c in ("id", "seq", "x0", "y0", "x1", "y1")], *extra)
    width = F.col(buffer) if isinstance(buffer, str) else F.lit(float(buffer))
    pad = F.col("__buffer") + 1e-6
    left = _cells(side(a, "a", more[0]), F.lit(0.0), cell, "a_")
    right = _cells(side(b, "b", [width.alias("__buffer"), *more[1]]), pad, cell, "b_")
    x = lambda f, p, n: f(F.col(f"{p}_{n}0"), F.col(f"{p}_{n}1"))
    apart = reduce(lambda p, q: p | q, [(x(F.least, "a", n) > x(F.greatest, "b", n) + pad) | (x(F.least, "b", n) - pad > x(F.greatest, "a", n)) for n in "xy"])

    d = _distance(cell)(*[F.col(f"{p}_{c}") for p in "ab" for c in ("x0", "y0", "x1", "y1")], F.col("__buffer"), F.col("__cx"), F.col("__cy"))
    hit = left.join(right, [*on, "__cx", "__cy"]).filter(~apart).withColumn("dist", d).filter("dist IS NOT NULL")
    coordinates = [f"{p}_{n}" for p in "ab" for n in ("x0", "y0", "x1", "y1")] if ends else []
    return hit.select(*on, "a_id", "a_seq", "b_id", "b_seq", "dist", *coordinates, *more[0], *more[1])


c = F.col


def copied_segments_within(a: DataFrame, b: DataFrame, buffer: float, cell: float = 50.0, digits: int | None = None) -> DataFrame:
    """segments_within() for sides that hold many copies of the same segments: one of each is measured, and what holds of it
    is told of all its copies; digits: those that distances are rounded to, once for all copies. Every pair is a row of the answer,
    so that grows with the square of the copies; it is made row by row and shuffled no further."""
    place = ["x0", "y0", "x1", "y1"]
    own = [df.select(F.struct(*place).alias("place"), F.struct("id", "seq").alias("member")) for df in (a, b)]
    sizes = [df.groupBy("place").agg(F.count(F.lit(1)).alias("n")).checkpoint() for df in own]
    total = [df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in sizes]
    sides = blocks(a, *total)
    (at_a, all_a), (at_b, all_b) = (packed(df, ["place"], size, k, n) for df, size, k, n in zip(own, sizes, sides, total, strict=True))
    one = lambda at, p: spread(at.select(F.monotonically_increasing_id().alias("id"), F.lit(1).alias("seq"), "place.*", c("at").alias(f"{p}_at")), *place)
    near = segments_within(one(at_a, "a"), one(at_b, "b"), buffer, cell, more=(["a_at"], ["b_at"]))
    dist = c("dist") if digits is None else F.round("dist", digits)
    told = [c("a.id").alias("a_id"), c("a.seq").alias("a_seq"), c("b.id").alias("b_id"), c("b.seq").alias("b_seq"), "dist"]
    return member_pairs(near.select(dist.alias("dist"), "a_at", "b_at"), all_a, all_b, sides, told)


def chainage(vertices: DataFrame, key: str = "line_id") -> DataFrame:
    """vertices with the distance along their line, and whether one repeats the vertex before it."""
    w = Window.partitionBy(key).orderBy("seq")
    step = X.distance(c("x"), c("y"), F.lag("x").over(w), F.lag("y").over(w))
    v = vertices.withColumn("step_m", F.coalesce(step, F.lit(0.0))).withColumn("repeated", F.coalesce(step <= 1e-12, F.lit(False)))
    return v.withColumn("chainage", F.sum("step_m").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step_m")


def line_lengths(vertices: DataFrame, key: str = "line_id") -> DataFrame:
    """length, vertex count and repeated vertices of each line; a line with repeats is rejected."""
    g = chainage(vertices, key).groupBy(key).agg(F.max("chainage").alias("length"), F.count(F.lit(1)).alias("vertices"), F.count_if("repeated").alias("repeats"))
    return g.withColumn("valid", (c("repeats") == 0) & (c("vertices") >= 2))


def z_at(vertices: DataFrame, stations: DataFrame, bucket: float = 100.0, key: str = "line_id") -> DataFrame:
    """stations (line, station) with x, y, z interpolated on their line, clamped to its ends. A station meets the
    segments of its line that share its chainage bucket."""
    w = Window.partitionBy(key).orderBy("seq")
    seg = chainage(vertices, key)
    axes = [n for n in "xyz" if n in vertices.columns]
    seg = seg.select(key, c("chainage").alias("c0"), F.lead("chainage").over(w).alias("c1"), *[x for n in axes for x in (c(n).alias(f"{n}0"), F.lead(n).over(w).alias(f"{n}1"))]).filter("c1 > c0")
    ends = seg.groupBy(key).agg(F.max("c1").alias("len"))
    seg = seg.join(ends, key).withColumn("b", F.explode(F.sequence(F.floor(c("c0") / bucket), F.floor(c("c1") / bucket))))
    s = stations.join(ends, key).withColumn("at", F.greatest(F.lit(0.0), F.least(c("station"), c("len")))).withColumn("b", F.floor(c("at") / bucket)).drop("len")
    hit = s.join(seg, [key, "b"]).filter((c("c0") <= c("at")) & ((c("at") < c("c1")) | ((c("at") == c("len")) & (c("c1") == c("len")))))
    t = (c("at") - c("c0")) / (c("c1") - c("c0"))
    return hit.select(*stations.columns, *[(c(f"{n}0") + (c(f"{n}1") - c(f"{n}0")) * t).alias(n) for n in axes])


def stations_along(vertices: DataFrame, n: Column, at: Callable[[Column], Column], key: str = "line_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, station, x, y, z of n stations of each line, the i-th (from 0) at at(i), which grows evenly; n and at may use the
    line's length, len. keep: columns that are the same for all vertices of a line, to carry along.

    Each segment makes the stations on it, so vertices are dealt once, by line, and nothing is joined."""
    w = Window.partitionBy(key).orderBy("seq")
    axes = [a for a in "xyz" if a in vertices.columns]
    seg = chainage(vertices, key).withColumn("len", F.max("chainage").over(Window.partitionBy(key)))
    seg = seg.select(key, *keep, "len", c("chainage").alias("c0"), F.lead("chainage").over(w).alias("c1"), *[x for a in axes for x in (c(a).alias(f"{a}0"), F.lead(a).over(w).alias(f"{a}1"))]).filter("c1 > c0")
    seg = seg.withColumn("n", n.cast("int"))
    step = at(F.lit(1)) - at(F.lit(0))
    place = lambda x: F.when(c("n") > 1, (x - at(F.lit(0))) / step).otherwise(0.0)
    # one more on either side, for rounding; what lies on the segment is told below
    first, last = F.greatest(F.lit(0), F.floor(place(c("c0"))).cast("int") - 1), F.least(c("n") - 1, F.ceil(place(c("c1"))).cast("int") + 1)
    st = seg.withColumn("i", F.explode(F.when(first <= last, F.sequence(first, last)))).withColumn("station", at(c("i")))
    on = F.greatest(F.lit(0.0), F.least(c("station"), c("len")))
    hit = st.filter((c("c0") <= on) & ((on < c("c1")) | ((on == c("len")) & (c("c1") == c("len")))))
    t = (on - c("c0")) / (c("c1") - c("c0"))
    return hit.select(key, *keep, "station", *[(c(f"{a}0") + (c(f"{a}1") - c(f"{a}0")) * t).alias(a) for a in axes])


def resample(vertices: DataFrame, step: float, key: str = "line_id", keep_vertices: bool = False) -> DataFrame:
    """Evenly spaced stations no farther apart than step (two at least) with x, y, z; with the source vertices if asked."""
    n = F.greatest(F.lit(2), F.ceil(c("len") / step) + 1)
    even = stations_along(vertices, n, lambda i: c("len") * i / (c("n") - 1), key)
    if not keep_vertices:
        return even
    own = chainage(vertices, key).withColumn("len", F.max("chainage").over(Window.partitionBy(key))).filter("len > 0").select(key, c("chainage").alias("station"))
    return z_at(vertices, even.select(key, "station").union(own).distinct(), key=key)


def merge_intervals(df: DataFrame, key: list[str], lo: str = "lo", hi: str = "hi", tol: float = 1e-9) -> DataFrame:
    """The union of overlapping or touching intervals of each key."""
    w = Window.partitionBy(*key).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.select(*key, lo, hi).withColumn("__new", F.when(before.isNull() | (c(lo) > before + tol), 1).otherwise(0))
    df = df.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*key, "__g").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("__g")


def barrier_spans(vertices: DataFrame, barriers: DataFrame, half_width: float, key: str = "line_id", cell: float = 50.0) -> DataFrame:
    """Chainage spans of lines within half_width of barrier axes (id, seq, x0, y0, x1, y1), merged. A segment's stay in a
    capsule is an interval, because the capsule is convex: it is bounded by its crossings with the two end circles and
    the two sides, in closed form."""
    w = Window.partitionBy(key).orderBy("seq")
    ch = chainage(vertices, key)
    seg = ch.select(key, "seq", "chainage", *[x for n in "xy" for x in (c(n).alias(f"{n}0"), F.lead(n).over(w).alias(f"{n}1"))]).filter("x1 IS NOT NULL").withColumn("len", X.distance(c("x0"), c("y0"), c("x1"), c("y1")))
    near = segments_within(seg.withColumnRenamed(key, "id"), barriers, half_width, cell, more=(["chainage", "len"], []), ends=True)
    df = near.withColumnsRenamed({"a_id": key, **{f"a_{n}": n for n in ("x0", "y0", "x1", "y1")}, "b_x0": "p0", "b_y0": "q0", "b_x1": "p1", "b_y1": "q1"})
    stay = capsule_stay(half_width)(*[c(n) for n in ("x0", "y0", "x1", "y1", "p0", "q0", "p1", "q1")])
    df = df.withColumn("stay", stay).filter("stay.first IS NOT NULL").select(key, (c("chainage") + c("stay.first") * c("len")).alias("lo"), (c("chainage") + c("stay.last") * c("len")).alias("hi"))
    return merge_intervals(df.filter("hi > lo + 1e-9"), [key], tol=1e-6)


def capsule_stay(half_width: float) -> Callable[..., Column]:
    """Of batches of segments (x0, y0, x1, y1) and axes (p0, q0, p1, q1): the parameters, from 0 to 1 along a segment, that bound
    its stay within half_width of the axis, null where it has none. They are the first and the last of its ends and its
    crossings with the capsule's rim that are inside. Arrays of expressions would be interpreted, and again by each filter."""
    r = float(half_width)

    def stay(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series, p0: pd.Series, q0: pd.Series, p1: pd.Series, q1: pd.Series) -> pd.DataFrame:
        x0, y0, x1, y1, p0, q0, p1, q1 = (v.to_numpy(dtype=float) for v in (x0, y0, x1, y1, p0, q0, p1, q1))
        dx, dy, ex, ey = x1 - x0, y1 - y0, p1 - p0, q1 - q0
        a, long = dx * dx + dy * dy, ex * ex + ey * ey
        axis = np.sqrt(long)
        first, last = np.full(len(a), np.nan), np.full(len(a), np.nan)

        def inside(t):
            """Takes t in where it is on the segment and within half_width of the axis."""
            x, y = x0 + dx * t, y0 + dy * t
            u = np.where(long > 0, np.minimum(np.maximum(((x - p0) * ex + (y - q0) * ey) / long, 0.0), 1.0), 0.0)
            vx, vy = x - (p0 + ex * u), y - (q0 + ey * u)
            t = np.where((t >= 0) & (t <= 1) & (np.sqrt(vx * vx + vy * vy) <= r + 1e-7), t, np.nan)
            return np.fmin(first, t), np.fmax(last, t)

        with np.errstate(all="ignore"):
            for end in (0.0, 1.0):
                first, last = inside(np.full(len(a), end))
            for px, py in ((p0, q0), (p1, q1)):  # where it meets a circle
                fx, fy = x0 - px, y0 - py
                b, k = fx * dx + fy * dy, fx * fx + fy * fy - r * r
                root = np.where(a > 0, np.sqrt(b * b - a * k), np.nan)
                for sign in (-1, 1):
                    first, last = inside((-b + sign * root) / a)
            # signed distance from the axis' line grows linearly along the segment
            s0, s1 = (ex * (y0 - q0) - ey * (x0 - p0)) / axis, (ex * (y1 - q0) - ey * (x1 - p0)) / axis
            slant = np.where((axis > 0) & (np.abs(s1 - s0) > 1e-12), s1 - s0, np.nan)
            for side in (r, -r):
                first, last = inside((side - s0) / slant)
        return pd.DataFrame({"first": first, "last": last})

    return F.pandas_udf(stay, "first double, last double")


def split_lines(lengths: DataFrame, spans: DataFrame, min_len: float, key: str = "line_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines (key, length) without their merged spans: kept pieces with numbers, ids, and state, termination and maneuver
    status of either end; breaks (what was taken out and pieces too short to keep, numbered along the line); and each
    line's length balance."""
    # lines and spans meet once; each span makes the gap before it, a line's last span its tail as well
    own = lengths.select(key, "length").join(spans.select(key, c("lo").alias("__lo"), c("hi").alias("__hi"), F.lit(True).alias("__span")), key, "left")
    own = own.withColumns({"lo": F.greatest("__lo", F.lit(0.0)), "hi": F.least("__hi", "length")})
    own = own.select(key, "length", "lo", "hi", F.coalesce(c("__span") & (c("hi") > c("lo")), F.lit(False)).alias("inner"))
    w = Window.partitionBy(key).orderBy(F.desc("inner"), "lo")
    before = F.when(c("inner"), F.lag("hi").over(w))
    own = own.withColumns({"before": before, "place": F.row_number().over(w), "after": F.lead("inner").over(w), "most": F.max(F.when(c("inner"), c("hi"))).over(Window.partitionBy(key))})
    part = lambda lo, hi, start, end, piece: F.struct(lo.alias("lo"), hi.alias("hi"), start.alias("start_state"), F.lit(end).alias("end_state"), F.lit(piece).alias("is_piece"))
    gap = part(F.coalesce("before", F.lit(0.0)), c("lo"), F.when(c("before").isNull(), "SOURCE").otherwise("BARRIER"), "BARRIER", True)
    tail = F.when(~F.coalesce("after", F.lit(False)), part(c("most"), c("length"), F.lit("BARRIER"), "SOURCE", True))
    free = F.when(c("place") == 1, part(F.lit(0.0), c("length"), F.lit("SOURCE"), "SOURCE", True))
    span = part(c("lo"), c("hi"), F.lit("BARRIER"), "BARRIER", False)
    parts = own.select(key, "length", F.explode(F.array_compact(F.when(c("inner"), F.array(gap, tail, span)).otherwise(F.array(free)))).alias("p")).select(key, "length", "p.*")
    inner = parts.filter("NOT is_piece")
    piece = c("is_piece") & (c("hi") > c("lo") + 1e-9)
    long = (c("hi") - c("lo")) >= min_len
    pieces = parts.filter(piece).select(key, "lo", "hi", "start_state", "end_state", long.alias("kept"))
    numbered = lambda df, name, mark: df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy("lo"))).withColumn(f"{name}_id", F.concat(c(key).cast("string"), F.lit(f":{mark}"), F.lpad(c(name).cast("string"), 4, "0")))
    kept = numbered(pieces.filter("kept").drop("kept"), "piece", "W")
    for end in ("start", "end"):
        cut = c(f"{end}_state") == "BARRIER"
        kept = kept.withColumn(f"{end}_termination", F.when(cut, "WORK_TERMINATION_REQUIRED_BY_BARRIER").otherwise("SOURCE_TERMINATION_PRESERVED"))
        kept = kept.withColumn(f"{end}_maneuver", F.when(cut, "PROHIBITED_BARRIER").otherwise("SOURCE_STATUS_PRESERVED"))
    total = lambda cond, name: F.sum(F.when(cond, c("hi") - c("lo")).otherwise(0.0)).alias(name)
    bal = parts.groupBy(key, "length").agg(total(piece & long, "kept_m"), total(piece & ~long, "discarded_m"), total(~c("is_piece"), "removed"))
    bal = bal.withColumn("balanced", F.abs(c("length") - c("kept_m") - c("discarded_m") - c("removed")) <= 1e-5)
    short = pieces.filter("NOT kept").select(key, "lo", "hi", F.lit("TOO_SHORT").alias("why"))
    breaks = numbered(inner.select(key, "lo", "hi", F.lit("BARRIER").alias("why")).unionByName(short), "break", "B")
    return kept, breaks, bal


def line_metrics(vertices: DataFrame, step: float, target: float, alert: float, key: str = "line_id") -> DataFrame:
    """Grades (percent) of lines resampled at step, taken in the direction in which z falls: percentiles, shares over
    target and alert, adverse share, and the grade from end to end."""
    r = resample(vertices, step, key)
    w = Window.partitionBy(key).orderBy("station")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    g = r.withColumns({"za": F.first("z").over(whole), "zb": F.last("z").over(whole), "len": F.last("station").over(whole), "ds": c("station") - F.lag("station").over(w), "dz": c("z") - F.lag("z").over(w)})
    g = g.filter("ds > 0").withColumn("grade", F.when(c("zb") > c("za"), -1.0).otherwise(1.0) * c("dz") / c("ds") * -100)
    m, n = F.abs(c("grade")), F.count(F.lit(1))
    q = F.percentile(m, [0.5, 0.95])
    out = g.groupBy(key).agg(q.alias("q"), F.max(m).alias("grade_max"), (F.count_if(m > target) / n).alias("over_target"), (F.count_if(m > alert) / n).alias("over_alert"), (F.count_if(c("grade") < -1e-9) / n).alias("adverse"), F.first((F.abs(c("za") - c("zb")) / c("len") * 100)).alias("end_grade"))
    return out.select(key, c("q")[0].alias("grade_p50"), c("q")[1].alias("grade_p95"), "grade_max", "over_target", "over_alert", "adverse", "end_grade")


def cross_grades(vertices: DataFrame, cells: DataFrame, step: float, res: float = 1.0, key: str = "line_id") -> DataFrame:
    """Per line: median, p95 and greatest grade (percent) of the terrain across the line and along it, from the slopes (gx,
    gy: rise over run) of the cell under the middle of each resampled piece. Pieces over no valid cell take no part, and
    `pieces` counts those that do."""
    w = Window.partitionBy(key).orderBy("station")
    r = resample(vertices, step, key)
    p = r.select(key, *[x for n in "xy" for x in (c(n).alias(f"{n}0"), F.lead(n).over(w).alias(f"{n}1"))]).filter("x1 IS NOT NULL")
    d = X.distance(c("x0"), c("y0"), c("x1"), c("y1"))
    p = p.filter(d > 1e-9).withColumns({"tx": (c("x1") - c("x0")) / d, "ty": (c("y1") - c("y0")) / d, "row": F.floor((c("y0") + c("y1")) / (2 * res)).cast("int"), "col": F.floor((c("x0") + c("x1")) / (2 * res)).cast("int")})
    hit = p.join(cells.select("row", "col", "gx", "gy").filter("gx IS NOT NULL AND gy IS NOT NULL").hint("merge"), ["row", "col"])
    hit = hit.withColumns({"cross": F.abs(c("gy") * c("tx") - c("gx") * c("ty")) * 100, "along": F.abs(c("gx") * c("tx") + c("gy") * c("ty")) * 100})
    aggs = [F.count(F.lit(1)).alias("pieces"), F.max("cross").alias("cross_max"), F.max("along").alias("along_max")]
    return summarise(hit, [key], aggs, {"cross_p50": ("cross", 0.5), "cross_p95": ("cross", 0.95), "along_p95": ("along", 0.95)})


def reversals(segs: DataFrame, deadband: float = 0.20, key: str = "line_id") -> DataFrame:
    """Sign changes of grade (percent) between neighbouring segments that aren't flat; flat ones are passed over."""
    s = segs.filter(F.abs("grade") > deadband).withColumn("sign", F.signum("grade"))
    w = Window.partitionBy(key).orderBy("seq")
    return s.withColumn("turn", F.lag("sign").over(w) != c("sign")).groupBy(key).agg(F.count_if("turn").alias("reversals"))


def grade_alerts(profiles: DataFrame, refs: DataFrame, key: str = "row_id") -> DataFrame:
    """Profiles (row_id, seq, chainage, elevation) against a reference grade (row_id, threshold; null: none): alert
    length and intervals of neighbouring segments over it. A profile with a null, a repeat or fewer than two points is
    invalid; staying under the reference is no approval."""
    w = Window.partitionBy(key).orderBy("seq")
    p = profiles.withColumn("ds", c("chainage") - F.lag("chainage").over(w)).withColumn("dz", c("elevation") - F.lag("elevation").over(w)).withColumn("c0", F.lag("chainage").over(w))
    ok = p.groupBy(key).agg((F.count(F.lit(1)) >= 2).alias("enough"), F.count_if(c("elevation").isNull() | c("chainage").isNull()).alias("nulls"), F.count_if(c("ds") <= 0).alias("repeats"), F.max("chainage").alias("length"), F.max(F.abs(c("dz") / F.nullif(c("ds"), F.lit(0.0))) * 100).alias("max_grade"))
    ok = ok.withColumn("valid", c("enough") & (c("nulls") == 0) & (c("repeats") == 0)).join(refs, key, "left")
    over = p.join(ok.filter("valid AND threshold IS NOT NULL").select(key, "threshold"), key).filter((c("ds") > 0) & (F.abs(c("dz") / c("ds")) * 100 > c("threshold") + 1e-9))
    merged = merge_intervals(over.select(key, c("c0").alias("lo"), c("chainage").alias("hi")), [key])
    alerts = merged.groupBy(key).agg(F.sum(c("hi") - c("lo")).alias("alert_length"), F.count(F.lit(1)).alias("intervals"))
    out = ok.join(alerts, key, "left")
    rated = c("valid") & c("threshold").isNotNull()
    status = F.when(~c("valid"), "INVALID_SOURCE_PROFILE").when(c("threshold").isNull(), "NOT_EVALUATED").when(c("intervals") > 0, "SAMPLED_EXCEEDANCE").otherwise("NO_SAMPLED_EXCEEDANCE_NOT_APPROVED")
    return out.select(key, F.when(c("valid"), c("length")).alias("length"), F.when(c("valid"), c("max_grade")).alias("max_grade"), F.when(rated, F.coalesce("alert_length", F.lit(0.0))).alias("alert_length"), F.when(rated, F.coalesce("intervals", F.lit(0))).alias("intervals"), status.alias("status"))


def axis_profile(vertices: DataFrame, target: DataFrame, key: str = "line_id") -> DataFrame:
    """|z - target| p95 and grade p95 and max of draped axes. target: line_id, target_z.

    A line's vertices are together and in order when its grades are told, so its percentiles are told there as well: an
    aggregation would sort them again, and hold that beside the first sort."""
    w = Window.partitionBy(key).orderBy("seq")
    v = vertices.join(target, key).withColumn("off", F.abs(c("z") - c("target_z")))
    ds = X.distance(c("x"), c("y"), F.lag("x").over(w), F.lag("y").over(w))
    v = v.withColumn("g", F.abs(c("z") - F.lag("z").over(w)) / F.nullif(ds, F.lit(0.0)) * 100)
    return _per_line(v, key, {"off_p95": F.percentile("off", 0.95), "grade_p95": F.percentile("g", 0.95), "grade_max": F.max("g")})


def _per_line(v: DataFrame, key: str, aggs: dict[str, Column]) -> DataFrame:
    """key and the aggregates of each line, of vertices that a window by line and seq has dealt and sorted."""
    whole = Window.partitionBy(key)
    told = v.select(key, *[a.over(whole).alias(n) for n, a in aggs.items()], F.row_number().over(whole.orderBy("seq")).alias("__k"))
    return told.filter("__k = 1").drop("__k")


def curvature(vertices: DataFrame, min_radius: float | None, key: str = "line_id") -> DataFrame:
    """Circumradii at interior vertices: least, p05, p50, those under the requirement, and the verdict."""
    w = Window.partitionBy(key).orderBy("seq")
    r = X.circumradius(F.lag("x").over(w), F.lag("y").over(w), c("x"), c("y"), F.lead("x").over(w), F.lead("y").over(w))
    low = F.count_if(c("radius") < min_radius) if min_radius is not None else F.max(F.lit(None).cast("bigint"))
    g = _per_line(vertices.withColumn("radius", r), key, {"min_radius": F.min("radius"), "q": F.percentile("radius", [0.05, 0.5]), "violations": low})
    verdict = F.when(c("violations").isNull(), "NOT_EVALUATED").when(c("violations") > 0, "FAIL_STATIC_PATH_RADIUS").otherwise("PASS_STATIC_PATH_RADIUS")
    return g.select(key, "min_radius", c("q")[0].alias("p05"), c("q")[1].alias("p50"), "violations", verdict.alias("verdict"))


def resampled_curvature(vertices: DataFrame, step: float, min_radius: float | None, key: str = "line_id") -> DataFrame:
    """curvature() of the lines resampled at even stations no farther apart than step, which doesn't depend on how densely a
    line was drawn."""
    return curvature(resample(vertices, step, key).withColumn("seq", c("station")), min_radius, key)


RELATIONS = {3: "CROSSING", 2: "OVERLAP", 1: "TOUCH"}


def _relation(k: Column) -> Column:
    return F.when(k == 3, RELATIONS[3]).when(k == 2, RELATIONS[2]).otherwise(RELATIONS[1])


def relation_classes(vertices: DataFrame, group: list[str], cell: float = 50.0, key: str = "line_id") -> tuple[DataFrame, DataFrame]:
    """Lines of a group that are copies of each other, vertex by vertex, are a class, named by its smallest id. Classes: group,
    lo, hi (lo <= hi), k and back, of pairs that meet: the greatest kind (3 CROSSING, 2 OVERLAP, 1 TOUCH) of any two of
    their segments, with lo's as the first and with hi's (null: they don't meet so); of a class with itself too, which is
    what its copies have. Members: group, key, one, the class of each line."""
    shape = vertices.groupBy(*group, key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("shape"))
    ones = shape.groupBy(*group, "shape").agg(F.min(key).alias("one")).checkpoint()
    members = shape.join(ones.hint("merge"), [*group, "shape"]).select(*group, key, "one").checkpoint()
    s = segments(ones.select(*group, "one", F.posexplode("shape").alias("seq", "v")).select(*group, "one", "seq", "v.x", "v.y"), [*group, "one"]).select(*group, c("one").alias("id"), "seq", "x0", "y0", "x1", "y1")
    # either side may be the one that is sent to the other's tasks, so both are dealt over all; the distance is the same both ways
    s = spread(s, *group, "id", "seq")
    both = segments_within(s, s, 1e-9, cell, group, ends=True).filter("a_id <= b_id")
    a, b, p, q = (c("a_x0"), c("a_y0")), (c("a_x1"), c("a_y1")), (c("b_x0"), c("b_y0")), (c("b_x1"), c("b_y1"))
    both = both.withColumns({"o0": X.cross(*a, *b, *p), "o1": X.cross(*a, *b, *q), "o2": X.cross(*p, *q, *a), "o3": X.cross(*p, *q, *b)})
    eps = 1e-9
    proper = (c("o0") * c("o1") < -eps) & (c("o2") * c("o3") < -eps)
    common = lambda i: F.least(F.greatest(a[i], b[i]), F.greatest(p[i], q[i])) - F.greatest(F.least(a[i], b[i]), F.least(p[i], q[i]))

    def kind(s, e, t, u):
        line = (F.abs(t) <= eps) & (F.abs(u) <= eps)
        along = F.when(F.abs(e[0] - s[0]) >= F.abs(e[1] - s[1]), common(0)).otherwise(common(1))
        return F.when(proper, 3).when(line & (along > 1e-6), 2).otherwise(1)

    pairs = both.groupBy(*group, c("a_id").alias("lo"), c("b_id").alias("hi"))
    return pairs.agg(F.max(kind(a, b, c("o0"), c("o1"))).alias("k"), F.max(kind(p, q, c("o2"), c("o3"))).alias("back")), members


def _line_pairs(classes: DataFrame, members: DataFrame, group: list[str], key: str) -> DataFrame:
    """group, a_id, b_id (a_id < b_id), k of all pairs of lines whose classes meet."""
    ways = F.array(F.struct(c("lo").alias("a"), c("hi").alias("b"), c("k").alias("k")), F.when(c("lo") < c("hi"), F.struct(c("hi").alias("a"), c("lo").alias("b"), c("back").alias("k"))))
    way = classes.select(*group, F.explode(F.array_compact(ways)).alias("w")).select(*group, "w.*").filter("k IS NOT NULL")
    of = lambda p: members.select(*group, c("one").alias(p), c(key).alias(f"{p}_id")).hint("shuffle_hash")
    return way.join(of("a"), [*group, "a"]).join(of("b"), [*group, "b"]).filter("a_id < b_id").select(*group, "a_id", "b_id", "k")


def row_relations(vertices: DataFrame, group: list[str], cell: float = 50.0, key: str = "line_id") -> DataFrame:
    """group, a_id, b_id, relation of pairs of lines of one group that meet (each pair once): CROSSING if any two
    segments cross properly, else OVERLAP if any two share more than a point, else TOUCH. Copies are measured once."""
    classes, members = relation_classes(vertices, group, cell, key)
    return _line_pairs(classes, members, group, key).select(*group, "a_id", "b_id", _relation(c("k")).alias("relation"))


def relations_of_lines(vertices: DataFrame, group: list[str], cell: float = 50.0, key: str = "line_id") -> DataFrame:
    """group, key, relation, n: with how many lines of its group a line has each relation of row_relations(). Counted by
    classes of copies, so that pairs of lines are made only where it matters which of both is the first."""
    classes, members = relation_classes(vertices, group, cell, key)
    classes = classes.checkpoint()
    even = F.coalesce(c("k") == c("back"), F.lit(False))
    size = members.groupBy(*group, "one").agg(F.count(F.lit(1)).alias("size"))
    both = F.array_distinct(F.array(F.struct(c("lo").alias("one"), c("hi").alias("other")), F.struct(c("hi").alias("one"), c("lo").alias("other"))))
    seen = classes.filter(even).select(*group, "k", F.explode(both).alias("w")).select(*group, "k", "w.*")
    seen = seen.join(size.withColumnRenamed("one", "other").hint("shuffle_hash"), [*group, "other"]).groupBy(*group, "one", "k").agg(F.sum(c("size") - (c("one") == c("other")).cast("int")).alias("n"))
    same = members.join(seen.hint("shuffle_hash"), [*group, "one"]).select(*group, key, "k", "n")
    odd = _line_pairs(classes.filter(~even), members, group, key).select(*group, F.explode(F.array("a_id", "b_id")).alias(key), "k", F.lit(1).cast("bigint").alias("n"))
    total = same.unionByName(odd).groupBy(*group, key, "k").agg(F.sum("n").alias("n"))
    return total.filter("n > 0").select(*group, key, _relation(c("k")).alias("relation"), "n")


def simplicity(vertices: DataFrame, key: str = "line_id", cell: float = 50.0) -> DataFrame:
    """Whether a line's segments meet where they aren't neighbours, and whether it closes on itself."""
    s = segments(vertices, key)
    ends = vertices.groupBy(key).agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"), F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))
    ends = ends.withColumn("ring", (c("a") == c("b")) & (c("n") > 2))
    t = s.select(c(key).alias("id"), "seq", "x0", "y0", "x1", "y1", c(key).alias("__line"))
    hit = segments_within(t, t, 1e-9, cell, ["__line"]).filter("b_seq > a_seq + 1").join(ends.select(c(key).alias("a_id"), "ring", "last"), "a_id")
    hit = hit.filter(~(c("ring") & (c("a_seq") == 1) & (c("b_seq") == c("last") - 1)))  # where a ring closes
    n = hit.groupBy(c("a_id").alias(key)).agg(F.count(F.lit(1)).alias("self_intersections"))
    return ends.select(key, "ring").join(n, key, "left").fillna(0, ["self_intersections"])


def classify_endpoints(vertices: DataFrame, edges: DataFrame, tol: float, key: str = "line_id", cell: float = 50.0) -> DataFrame:
    """Both ends of each line: kind of the nearest surface, distance to it, and what that says of ending work and of turning
    there. edges: surface (HEADLAND, OBSTACLE, BOUNDARY), x0..y1. Ties within 1e-6 go to the obstacle; a boundary counts
    only where there is neither headland nor obstacle at all; beyond tol the end is unsupported."""
    from furrow.operators import nearest as N

    e = vertices.groupBy(key).agg(F.min_by(F.struct("x", "y"), "seq").alias("START"), F.max_by(F.struct("x", "y"), "seq").alias("END"))
    pts = e.select(key, F.expr("stack(2, 'START', START, 'END', END) AS (which, p)")).select(F.struct(key, "which").alias("point_id"), c("p.x").alias("x"), c("p.y").alias("y")).checkpoint()
    segs = edges.select("surface", F.monotonically_increasing_id().alias("segment_id"), *N.ENDS).checkpoint()
    away = lambda surface, name: N.nearest(pts, segs.filter(c("surface") == surface), max(cell, tol)).select("point_id", c("gap").alias(name))
    out = pts.select("point_id").join(away("HEADLAND", "head"), "point_id", "left").join(away("OBSTACLE", "obst"), "point_id", "left").join(away("BOUNDARY", "edge"), "point_id", "left")
    far = F.lit(float("inf"))
    h, o = F.coalesce("head", far), F.coalesce("obst", far)
    b = F.when(c("head").isNull() & c("obst").isNull(), F.coalesce("edge", far)).otherwise(far)
    d = F.least(h, o, b)
    kind = F.when(o <= d + 1e-6, F.struct(F.lit("UNCLASSIFIED_OBSTACLE_EDGE").alias("k"), o.alias("d"))).when(b <= d + 1e-6, F.struct(F.lit("WORK_AREA_BOUNDARY_UNCLASSIFIED").alias("k"), b.alias("d"))).otherwise(F.struct(F.lit("HEADLAND_WORK_EDGE").alias("k"), h.alias("d")))
    out = out.withColumn("n", kind).withColumn("kind", F.when(c("n.d") > tol, "INTERNAL_UNSUPPORTED_ENDPOINT").otherwise(c("n.k")))
    pick = lambda head, obst, edge, none: F.when(c("kind") == "HEADLAND_WORK_EDGE", head).when(c("kind") == "UNCLASSIFIED_OBSTACLE_EDGE", obst).when(c("kind") == "WORK_AREA_BOUNDARY_UNCLASSIFIED", edge).otherwise(none)
    ends = pick("WORK_TERMINATION_GEOMETRICALLY_SUPPORTED", "WORK_TERMINATION_REQUIRED_BY_OBSTACLE", "WORK_TERMINATION_GEOMETRICALLY_SUPPORTED", "UNSUPPORTED_INTERNAL_TERMINATION")
    turns = pick("NOT_EVALUATED_MISSING_FLEET_ENVELOPE", "NOT_AUTHORIZED_UNCLASSIFIED_OBSTACLE", "NOT_EVALUATED_UNCLASSIFIED_BOUNDARY", "PROHIBITED_NO_MANEUVER_SURFACE")
    return out.select(f"point_id.{key}", "point_id.which", "kind", F.when(c("n.d") < far, c("n.d")).alias("distance"), ends.alias("termination"), turns.alias("maneuver"))


def relation_counts(relations: DataFrame, groups: DataFrame, key: str = "line_id") -> DataFrame:
    """Per line (of groups): in how many pairs it crosses, overlaps and touches others, and the codes of that; a pair counts
    for both of its rows. relations: of row_relations() or relations_of_lines()."""
    own = relations if "n" in relations.columns else relations.select(F.explode(F.array("a_id", "b_id")).alias(key), "relation", F.lit(1).alias("n"))
    n = own.groupBy(key).agg(*[F.sum(F.when(c("relation") == k, c("n")).otherwise(0)).alias(name) for k, name in (("CROSSING", "crossings"), ("OVERLAP", "overlaps"), ("TOUCH", "touches"))])
    out = groups.select(key).distinct().join(n.hint("merge"), key, "left").fillna(0, ["crossings", "overlaps", "touches"])
    codes = F.array_compact(F.array(F.when(c("crossings") > 0, "ROW_CROSSING"), F.when(c("overlaps") > 0, "ROW_OVERLAP"), F.when(c("touches") > 0, "ROW_TOUCH")))
    return out.withColumn("codes", F.array_join(codes, ","))


def line_diagnostics(ends: DataFrame, simple: DataFrame, relations: DataFrame, radii: DataFrame, groups: DataFrame, key: str = "line_id") -> DataFrame:
    """Per line: blockers and warnings of its ends, its own shape, its radii and its relations to others of its group."""
    e = ends.groupBy(key).agg(*[F.max(c("kind") == k).alias(n) for k, n in (("INTERNAL_UNSUPPORTED_ENDPOINT", "loose"), ("HEADLAND_WORK_EDGE", "head"), ("UNCLASSIFIED_OBSTACLE_EDGE", "obst"), ("WORK_AREA_BOUNDARY_UNCLASSIFIED", "edge"))])
    rel = relation_counts(relations, groups, key)
    df = rel.join(e, key, "left").join(simple, key, "left").join(radii.select(key, "violations"), key, "left")
    some = lambda *pairs: F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(False)), F.lit(n)) for x, n in pairs])), ",")
    blockers = some(
        (c("ring"), "CLOSED_LOOP_WITHOUT_APPROVED_ENTRY"), (c("loose"), "INTERNAL_UNSUPPORTED_ENDPOINT"), (c("violations") > 0, "MINIMUM_RADIUS_VIOLATION"), (c("crossings") > 0, "ROW_CROSSING"), (c("overlaps") > 0, "ROW_OVERLAP"), (c("touches") > 0, "ROW_TOUCH"),
        (c("self_intersections") > 0, "SELF_INTERSECTION"),
    )
    warnings = some((c("head"), "HEADLAND_MANEUVER_NOT_VERIFIED"), (c("obst"), "OBSTACLE_ACCESS_AND_MANEUVER_NOT_VERIFIED"), (c("edge"), "TERMINAL_SURFACE_NOT_CLASSIFIED"))
    out = df.select(key, blockers.alias("blockers"), warnings.alias("warnings"), "crossings", "overlaps", "touches")
    return out.withColumn("topology", F.when(c("blockers") == "", "PASS").otherwise("FAIL")).withColumn("continuity", F.when(c("blockers") == "", "E0_GEOMETRY_ONLY_PENDING_FLEET_AND_MANEUVER_REVIEW").otherwise("FAIL_GEOMETRY"))


def adjacent_spacing(vertices: DataFrame, levels: DataFrame, spacing: float, factor: float = 2.0, step: float = 12.0, trim: float = 3.0, outside: float = 0.15, key: str = "line_id") -> DataFrame:
    """Distances of interior samples of each row to rows of the next level of its group, both ways. levels: line_id,
    group_id, level. A sample farther than factor * spacing from any is unpaired and counts as outside."""
    span, reach = c("len") - 2 * trim, factor * spacing
    n = F.when(span > 0, F.greatest(F.lit(1), F.ceil(span / step) + 1)).otherwise(0)
    pts = stations_along(vertices.select(key, "seq", "x", "y"), n, lambda i: F.when(c("n") > 1, i * span / (c("n") - 1)).otherwise(span / 2) + trim, key)
    # tables of lines and of cells both grow: they are dealt by key, none is sent whole to every task
    have = levels.select("group_id", c("level").alias("other")).distinct()
    beside = levels.select(key, "group_id", F.explode(F.array(c("level") - 1, c("level") + 1)).alias("other")).join(have.hint("merge"), ["group_id", "other"])
    both = pts.join(beside.hint("merge"), key).withColumn("__cx", F.floor(c("x") / (4 * reach))).withColumn("__cy", F.floor(c("y") / (4 * reach)))
    seg = segments(vertices.select(key, "seq", "x", "y"), key).join(levels.hint("merge"), key)
    seg = _cells(seg.select("group_id", c("level").alias("other"), *[c(k).alias(f"s_{k}") for k in ("x0", "y0", "x1", "y1")]), F.lit(reach), 4 * reach, "s_")
    d = X.pt_seg_dist(c("x"), c("y"), c("s_x0"), c("s_y0"), c("s_x1"), c("s_y1"))
    met = both.join(seg.hint("merge"), ["group_id", "other", "__cx", "__cy"], "left").withColumn("d", d)
    # a sample is in one cell, so naming the cell keeps its rows where the join has them
    every = met.groupBy("group_id", "other", "__cx", "__cy", key, "station").agg(F.min(F.when(c("d") <= reach, c("d"))).alias("d")).select("group_id", "d").checkpoint()
    aggs = [F.count(F.lit(1)).alias("samples"), F.count_if(c("d").isNull()).alias("unpaired"), (F.count_if(c("d").isNull() | (F.abs(c("d") - spacing) > outside * spacing)) / F.count(F.lit(1))).alias("outside_share")]
    g = summarise(every, ["group_id"], aggs, {"p05": ("d", 0.05), "p50": ("d", 0.5), "p95": ("d", 0.95)}, write=False)
    return g.select("group_id", "samples", "unpaired", "p05", "p50", "p95", "outside_share")


def ray_spacing(samples: DataFrame, rows: DataFrame, spacing: float, tol: float) -> DataFrame:
    """Rays from samples (sample_id, group_id, level, x, y, nx, ny: unit normal) towards the next level, at most 4 * spacing
    long: first hit on a row (group_id, level, x0, y0, x1, y1); error p95, share outside, unpaired."""
    reach = 4 * spacing
    cell = 4 * reach
    s = samples.withColumns({"ex": c("x") + c("nx") * reach, "ey": c("y") + c("ny") * reach})
    left = _cells(s.select("sample_id", "group_id", (c("level") + 1).alias("level"), c("x").alias("r_x0"), c("y").alias("r_y0"), c("ex").alias("r_x1"), c("ey").alias("r_y1")), F.lit(0.0), cell, "r_")
    right = _cells(rows.select("group_id", "level", *[c(k).alias(f"s_{k}") for k in ("x0", "y0", "x1", "y1")]), F.lit(1e-6), cell, "s_")
    m = left.join(right, ["group_id", "level", "__cx", "__cy"])
    dx, dy = c("r_x1") - c("r_x0"), c("r_y1") - c("r_y0")
    ex, ey = c("s_x1") - c("s_x0"), c("s_y1") - c("s_y0")
    den = dx * ey - dy * ex
    fx, fy = c("s_x0") - c("r_x0"), c("s_y0") - c("r_y0")
    t, u = F.try_divide(fx * ey - fy * ex, den), F.try_divide(fx * dy - fy * dx, den)
    hit = m.filter(F.abs(den) > 1e-12).withColumn("t", t).withColumn("u", u).filter((c("t") >= 0) & (c("t") <= 1) & (c("u") >= -1e-9) & (c("u") <= 1 + 1e-9)).groupBy("sample_id").agg((F.min("t") * reach).alias("d"))
    every = samples.select("sample_id", "group_id").join(hit, "sample_id", "left").withColumn("err", F.abs(c("d") - spacing))
    n = F.count(F.lit(1))
    return every.groupBy("group_id").agg(n.alias("samples"), F.count_if(c("d").isNull()).alias("unpaired"), F.percentile("err", 0.95).alias("error_p95"), (F.count_if(c("d").isNull() | (c("err") > tol)) * 100.0 / n).alias("outside_percent"))


def continuity_summary(ends: DataFrame, simple: DataFrame, relations: DataFrame, radii: DataFrame, groups: DataFrame, key: str = "line_id") -> DataFrame:
    """Per group: end kinds, loops, self-intersections, relations, radius violations, codes, status. groups: line_id, group_id;
    relations: of row_relations() or relations_of_lines(), where a pair counts for both lines."""
    e = ends.join(groups, key).groupBy("group_id").agg(F.count_if(c("kind") == "HEADLAND_WORK_EDGE").alias("headland_ends"), F.count_if(c("kind") == "UNCLASSIFIED_OBSTACLE_EDGE").alias("obstacle_ends"), F.count_if(c("kind") == "INTERNAL_UNSUPPORTED_ENDPOINT").alias("unsupported_ends"))
    s = simple.join(groups, key).groupBy("group_id").agg(F.count_if("ring").alias("loops"), F.count_if(c("self_intersections") > 0).alias("self_crossing"))
    pairs = (c("n") / 2) if "n" in relations.columns else F.lit(1)
    r = relations.groupBy("group_id").agg(*[F.sum(F.when(c("relation") == k, pairs).otherwise(0)).cast("bigint").alias(name) for k, name in (("CROSSING", "crossings"), ("OVERLAP", "overlaps"), ("TOUCH", "touches"))])
    k = radii.join(groups, key).groupBy("group_id").agg(F.sum("violations").alias("radius_violations"))
    out = groups.select("group_id").distinct().join(e, "group_id", "left").join(s, "group_id", "left").join(r, "group_id", "left").join(k, "group_id", "left").fillna(0)
    codes = F.array_compact(F.array(
        F.when(c("loops") > 0, "CLOSED_LOOP_WITHOUT_APPROVED_ENTRY"), F.when(c("unsupported_ends") > 0, "INTERNAL_UNSUPPORTED_ENDPOINT"), F.when(c("radius_violations") > 0, "MINIMUM_RADIUS_VIOLATION"),
        F.when(c("crossings") > 0, "ROW_CROSSING"), F.when(c("overlaps") > 0, "ROW_OVERLAP"), F.when(c("touches") > 0, "ROW_TOUCH"), F.when(c("self_crossing") > 0, "SELF_INTERSECTION"),
    ))
    warn = F.when(c("obstacle_ends") > 0, "OBSTACLE_EDGE_UNCLASSIFIED").otherwise("")
    return out.withColumn("blockers", F.array_join(codes, ",")).withColumn("warnings", warn).withColumn("status", F.when(c("blockers") == "", "CONTINUOUS_SCREENING").otherwise("BLOCKED"))


def family_gate(summary: DataFrame) -> DataFrame:
    """GEOMETRIC_PASS iff no code of the acceptance list stands against a group."""
    accept = F.array(*[F.lit(x) for x in ("INTERNAL_UNSUPPORTED_ENDPOINT", "MINIMUM_RADIUS_VIOLATION", "ROW_CROSSING", "ROW_TOUCH", "SELF_INTERSECTION")])
    hit = F.array_intersect(F.split("blockers", ","), accept)
    return summary.select("group_id", F.array_join(F.array_sort(hit), ",").alias("blockers"), F.when(F.size(hit) == 0, "GEOMETRIC_PASS").otherwise("GEOMETRIC_FAIL").alias("verdict"))


def polygon_measures(vertices: DataFrame) -> DataFrame:
    """Closed rings (feature_id, part, ring, seq, x, y; ring 0 is the outer one): area in ha, perimeter, parts, holes."""
    w = Window.partitionBy("feature_id", "part", "ring").orderBy("seq")
    v = vertices.withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w)).filter("nx IS NOT NULL")
    ring = v.groupBy("feature_id", "part", "ring").agg(F.abs(F.sum(c("x") * c("ny") - c("nx") * c("y")) / 2).alias("a"), F.sum(X.distance(c("x"), c("y"), c("nx"), c("ny"))).alias("p"))
    area = F.sum(F.when(c("ring") == 0, c("a")).otherwise(-c("a")))
    return ring.groupBy("feature_id").agg((area / 1e4).alias("area_ha"), F.sum("p").alias("perimeter"), F.countDistinct("part").alias("parts"), F.count_if(c("ring") > 0).alias("holes"))


def area_agreement(measures: DataFrame, reported: DataFrame, tol_percent: float) -> DataFrame:
    """feature_id, computed and reported area (ha), difference in percent of the reported one, and status; a feature on one
    side only is told."""
    m = measures.select("feature_id", "area_ha").join(reported.select("feature_id", "reported_ha"), "feature_id", "full")
    off = (c("area_ha") - c("reported_ha")) * 100 / F.nullif(c("reported_ha"), F.lit(0.0))
    why = F.when(c("area_ha").isNull(), "NO_GEOMETRY").when(c("reported_ha").isNull(), "NOT_REPORTED").when(c("reported_ha") <= 0, "REPORTED_NOT_POSITIVE")
    return m.withColumn("difference_percent", off).withColumn("area_status", why.when(F.abs("difference_percent") <= tol_percent, "AGREES").otherwise("DIFFERS"))


def hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points (n x 2), counter-clockwise from the lowest of the leftmost; without repeats and
    without points on a side."""
    xy = np.unique(xy, axis=0)
    if len(xy) < 3:
        return xy
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    flat = 1e-13 * float(np.ptp(xy, axis=0).max()) ** 2  # what rounding makes of points on a side
    out: list[np.ndarray] = []
    for points in (xy, xy[::-1]):
        side: list[np.ndarray] = []
        for p in points:
            while len(side) > 1 and turn(side[-2], side[-1], p) <= flat:
                side.pop()
            side.append(p)
        out += side[:-1]
    return np.array(out)


def narrowest_box(corners: np.ndarray) -> tuple[float, float, float, float]:
    """Of a hull: least area of a rectangle around it, its width, its length, and the angle of its long side (degrees, 0 to
    180). The rectangle lies along a side of the hull; the corners farthest in each direction come from the order of the
    sides' angles (calipers)."""
    if len(corners) < 2:
        return 0.0, 0.0, 0.0, 0.0
    side = np.roll(corners, -1, axis=0) - corners
    angle = np.unwrap(np.arctan2(side[:, 1], side[:, 0])) if len(corners) > 2 else np.arctan2(side[:, 1], side[:, 0])
    if len(corners) == 2:
        n = float(np.hypot(*side[0]))
        return 0.0, 0.0, n, float(np.degrees(angle[0]) % 180)
    u = side / np.hypot(side[:, 0], side[:, 1])[:, None]

    def reach(turned: float, d: np.ndarray) -> np.ndarray:
        # the farthest corner in direction d is where the sides' angles pass d's angle plus 90 degrees
        at = np.searchsorted(angle, (angle + turned + np.pi / 2 - angle[0]) % (2 * np.pi) + angle[0] - 1e-12) % len(corners)
        best = np.full(len(corners), -np.inf)
        for k in (-1, 0, 1):
            best = np.maximum(best, (corners[(at + k) % len(corners)] * d).sum(1))
        return best

    n = np.stack([-u[:, 1], u[:, 0]], 1)
    along = reach(0.0, u) + reach(np.pi, -u)
    across = reach(np.pi / 2, n) + reach(-np.pi / 2, -n)
    area = np.round(along * across, 6)
    k = int(np.lexsort((np.minimum(along, across), area))[0])
    long_side = u[k] if along[k] >= across[k] else n[k]
    return float(area[k]), float(min(along[k], across[k])), float(max(along[k], across[k])), float(np.degrees(np.arctan2(long_side[1], long_side[0])) % 180)


def convex_hulls(vertices: DataFrame, key: str = "feature_id", parts: int = 64, gather: int = 10_000) -> DataFrame:
    """key, x, y of the corners of each feature's convex hull. Features of up to `gather` vertices are dealt by feature and
    reduced at once. The hull of hulls is the hull, so of larger ones tasks first reduce what they hold, then `parts` groups
    of a feature are reduced, and what is left of these is one group a feature."""
    ship(vertices.sparkSession)
    kind = f"{key} {vertices.schema[key].dataType.simpleString()}, x double, y double"
    v = vertices.select(key, c("x").cast("double").alias("x"), c("y").cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")

    def reduce_table(table: pa.Table) -> pa.Table:
        xy = hull(np.stack([table.column(n).to_numpy() for n in ("x", "y")], 1))
        return pa.table({key: pa.repeat(table.column(key)[0], len(xy)), "x": xy[:, 0], "y": xy[:, 1]}, schema=pa.schema([table.schema.field(key), ("x", pa.float64()), ("y", pa.float64())]))

    def reduce_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).dictionary_encode()
            own = ids.indices.to_numpy(zero_copy_only=False) if not ids.indices.null_count else ids.indices.fill_null(len(ids.dictionary)).to_numpy()
            for k in np.unique(own):
                yield from reduce_table(pa.Table.from_batches([b.filter(pa.array(own == k))])).to_batches()

    v = v.select(c(key), "x", "y")
    large = v.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((c("n") > gather) | c(key).isNull()).select(key).checkpoint()
    if large.isEmpty():
        return spread(v, key).groupBy(key).applyInArrow(reduce_table, kind)
    same = v[key].eqNullSafe(large[key])
    few, v = v.join(large, same, "left_anti"), v.join(large, same, "left_semi")
    small = v.mapInArrow(reduce_batches, kind)
    again = small.withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(parts))).groupBy(key, "part").applyInArrow(lambda t: reduce_table(t.select([key, "x", "y"])), kind)
    return spread(few, key).groupBy(key).applyInArrow(reduce_table, kind).unionByName(again.groupBy(key).applyInArrow(reduce_table, kind))


def oriented_extent(vertices: DataFrame, key: str = "feature_id") -> DataFrame:
    """area, width, length and axis_deg (direction of the long side, 0 to 180) of the narrowest rectangle around each
    feature's points. Corners of hulls are all that is looked at."""
    kind = f"{key} {vertices.schema[key].dataType.simpleString()}, area double, width double, length double, axis_deg double"

    def boxed(table: pa.Table) -> pa.Table:
        box = narrowest_box(hull(np.stack([table.column(n).to_numpy() for n in ("x", "y")], 1)))
        return pa.table({key: table.column(key).slice(0, 1), **{n: [v] for n, v in zip(("area", "width", "length", "axis_deg"), box, strict=True)}})

    return convex_hulls(vertices, key).groupBy(key).applyInArrow(boxed, kind)


def projection_width(vertices: DataFrame, angle: Column, key: str = "feature_id") -> DataFrame:
    """How wide each feature is along a direction (degrees; may depend on the row's columns)."""
    t = F.radians(angle)
    u = c("x") * F.cos(t) + c("y") * F.sin(t)
    return vertices.groupBy(key).agg((F.max(u) - F.min(u)).alias("projection_width"))


def filter_blocks(components: DataFrame, cell: float, spacing: float) -> DataFrame:
    """Components (field, component, area, width), numbered by falling area before any is dropped; reasons for rejects."""
    w = Window.partitionBy("field").orderBy(c("area").desc(), "component")
    least = max(cell, 2 * spacing)
    why = F.array_compact(F.array(F.when(c("area") < 9 * cell * cell, "AREA_BELOW_NINE_CELLS"), F.when(c("width") < least, "WIDTH_BELOW_MINIMUM")))
    return components.withColumn("number", F.row_number().over(w)).withColumn("reasons", F.array_join(why, ",")).withColumn("kept", c("reasons") == "")


def clip_lattice(edges: DataFrame, theta: float, spacing: float, phase: float, min_len: float = 8.0) -> DataFrame:
    """field, k, piece, lo, hi: straight rows k * spacing + phase across direction theta, clipped to polygons (field, x0,
    y0, x1, y1): the crossings of a row with the edges, sorted, pair up inside and outside."""
    import math

    ct, st = math.cos(math.radians(theta)), math.sin(math.radians(theta))
    u = lambda i: c(f"x{i}") * ct + c(f"y{i}") * st
    v = lambda i: c(f"y{i}") * ct - c(f"x{i}") * st
    e = edges.select("field", u(0).alias("u0"), v(0).alias("v0"), u(1).alias("u1"), v(1).alias("v1"))
    lo, hi = F.least("v0", "v1"), F.greatest("v0", "v1")
    k0, k1 = F.ceil((lo - phase) / spacing), F.ceil((hi - phase) / spacing) - 1  # the upper end belongs to the next edge
    x = e.withColumn("k", F.explode(F.when(k1 >= k0, F.sequence(k0, k1)).otherwise(F.array().cast("array<bigint>"))))
    at = c("k") * spacing + phase
    x = x.select("field", "k", (c("u0") + F.try_divide((c("u1") - c("u0")) * (at - c("v0")), c("v1") - c("v0"))).alias("u"))
    w = Window.partitionBy("field", "k").orderBy("u")
    x = x.withColumn("n", F.row_number().over(w)).withColumn("hi", F.lead("u").over(w)).filter("n % 2 = 1 AND hi IS NOT NULL").filter(c("hi") - c("u") >= min_len)
    return x.select("field", "k", ((c("n") + 1) / 2).cast("int").alias("piece"), c("u").alias("lo"), "hi")


def clip_to_strips(rows: DataFrame, strip_edges: DataFrame, min_len: float) -> tuple[DataFrame, DataFrame]:
    """Rows (row_id, x0, y0, x1, y1) cut into strips (strip_id, x0..y1 edges of closed rings): pieces, and their summary."""
    from furrow.operators import nearest as N

    r = rows.select("row_id", *[c(k).alias(f"r_{k}") for k in ("x0", "y0", "x1", "y1")])
    a = _cells(r, F.lit(0.0), 50.0, "r_")
    b = _cells(strip_edges.select("strip_id", F.monotonically_increasing_id().alias("edge"), *[c(k).alias(f"s_{k}") for k in ("x0", "y0", "x1", "y1")]), F.lit(1e-6), 50.0, "s_")
    dx, dy = c("r_x1") - c("r_x0"), c("r_y1") - c("r_y0")
    ex, ey = c("s_x1") - c("s_x0"), c("s_y1") - c("s_y0")
    den = dx * ey - dy * ex
    fx, fy = c("s_x0") - c("r_x0"), c("s_y0") - c("r_y0")
    hit = a.join(b, ["__cx", "__cy"]).filter(F.abs(den) > 1e-12).withColumn("t", F.try_divide(fx * ey - fy * ex, den)).withColumn("u", F.try_divide(fx * dy - fy * dx, den))
    hit = hit.filter((c("u") >= 0) & (c("u") < 1)).dropDuplicates(["row_id", "strip_id", "edge"])
    # crossings of the whole line pair up; the row is the part between 0 and 1. A row's far crossings lie in cells it doesn't pass, so ends inside a strip are told by parity of those it does pass
    starts = N.inside(rows.select(c("row_id").alias("point_id"), c("x0").alias("x"), c("y0").alias("y")), strip_edges, 50.0, "strip_id").select(c("point_id").alias("row_id"), "strip_id", F.lit(0.0).alias("t"))
    cuts = hit.filter((c("t") > 0) & (c("t") < 1)).select("row_id", "strip_id", "t").unionByName(starts)
    w = Window.partitionBy("row_id", "strip_id").orderBy("t")
    p = cuts.withColumn("n", F.row_number().over(w)).withColumn("to", F.coalesce(F.lead("t").over(w), F.lit(1.0))).filter("n % 2 = 1").join(r, "row_id")
    p = p.withColumn("len", (c("to") - c("t")) * F.sqrt(dx * dx + dy * dy)).filter(c("len") >= min_len).select("row_id", "strip_id", "t", "to", "len")
    many = p.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(c("n") > 1).alias("split_rows"))
    total = summarise(p, [], [F.count(F.lit(1)).alias("pieces"), F.sum("len").alias("total"), F.max("len").alias("max")], {"p05": ("len", 0.05), "p50": ("len", 0.5), "p95": ("len", 0.95)})
    return p, total.crossJoin(many)  # one row each


def infer_connections(
    a: DataFrame, b: DataFrame, area_a: DataFrame | None = None, area_b: DataFrame | None = None, max_gap: float = 100.0, headland: float = 12.0, proximity: float = 15.5, cell: float = 50.0
) -> DataFrame:
    """Rows of two fields that share an id (row_id, line_id, x0, y0, x1, y1: ends of each line; several lines may share it):
    of all pairs of lines and the four pairs of their ends the nearest, if not farther apart than max_gap. With the fields'
    outlines (edges: polygon_id, x0, y0, x1, y1) it also takes that either end lies within `proximity` of the other field,
    and that the connector lies within the union of both. angle: of the crossing, by the headlands on either side."""
    from furrow.operators import nearest as N

    ends = lambda df, p: df.select("row_id", c("line_id").alias(f"{p}_line"), X.distance(c("x0"), c("y0"), c("x1"), c("y1")).alias(f"{p}_length"), F.posexplode(F.array(*[F.struct(c(f"x{i}").alias("x"), c(f"y{i}").alias("y")) for i in (0, 1)])).alias(f"{p}_end", f"{p}_at"))
    # both dealt by row before ends are paired: lines come from few files, and pairs of a few tasks would be sorted there
    m = ends(spread(a, "row_id"), "a").join(ends(spread(b, "row_id"), "b").hint("shuffle_merge"), "row_id")
    gap = X.distance(c("a_at.x"), c("a_at.y"), c("b_at.x"), c("b_at.y"))
    best = m.withColumn("gap", gap).groupBy("row_id").agg(F.min(F.struct("gap", "a_line", "b_line", "a_end", "b_end", "a_at", "b_at", "a_length", "b_length")).alias("m")).filter(c("m.gap") <= max_gap).select("row_id", "m.*")
    if area_a is not None and area_b is not None:
        best = best.checkpoint()
        facing = lambda at, area: N.near_area(best.select(c("row_id").alias("point_id"), c(f"{at}.x").alias("x"), c(f"{at}.y").alias("y")), area, proximity, cell).withColumnRenamed("point_id", "row_id")
        best = best.join(facing("a_at", area_b), "row_id", "left_semi").join(facing("b_at", area_a), "row_id", "left_semi")
        connectors = best.select(c("row_id").alias("connector_id"), c("a_at.x").alias("x"), c("a_at.y").alias("y"), c("b_at.x").alias("sx"), c("b_at.y").alias("sy"))
        both = area_a.select(F.concat(F.lit("a"), c("polygon_id").cast("string")).alias("polygon_id"), *N.ENDS).unionByName(area_b.select(F.concat(F.lit("b"), c("polygon_id").cast("string")).alias("polygon_id"), *N.ENDS))
        best = best.join(N.uncovered(connectors, both, cell).withColumnRenamed("connector_id", "row_id"), "row_id", "left_anti")
    angle = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(2 * headland) / F.greatest(c("gap"), F.lit(1e-9)))))
    return best.select("row_id", "a_line", "b_line", "gap", "a_end", "b_end", "a_length", "b_length", angle.alias("angle"))


#: The five numbers by which connections are summed up.
FIVE = {"min": 0.0, "p05": 0.05, "p50": 0.5, "p95": 0.95, "max": 1.0}


def connection_summary(df: DataFrame, turn_s: float, alert: float, values: tuple[str, ...] = ("gap", "angle", "grade")) -> DataFrame:
    """One row: pairs, five numbers of each of the values (columns of df), connections whose grade is over the alert, the time
    that turns would take, and the speed (km/h) at which crossing takes as long."""
    n = F.count(F.lit(1))
    aggs = [n.alias("pairs"), (2 * n).alias("segments"), F.coalesce(F.count_if(c("grade") > alert), F.lit(0)).alias("over_alert"), (n * turn_s).alias("turn_seconds"), F.coalesce(F.sum("gap"), F.lit(0.0)).alias("gap_total")]
    out = summarise(df, [], aggs, {f"{v}_{k}": (v, p) for v in values for k, p in FIVE.items()})
    return out.withColumn("break_even_kmh", F.try_divide(c("gap_total"), c("turn_seconds")) * 3.6)


def speed_cases(df: DataFrame, speeds: list[float], turn_s: float) -> DataFrame:
    """Per speed (km/h): minutes of crossing, net minutes against turning, and connections that gain."""
    s = df.select("gap", F.explode(F.array(*[F.lit(float(v)) for v in speeds])).alias("speed"))
    took = c("gap") / (c("speed") / 3.6)
    return s.groupBy("speed").agg(F.count(F.lit(1)).alias("pairs"), (F.sum(took) / 60).alias("minutes"), (F.sum(F.lit(turn_s) - took) / 60).alias("net_minutes"), F.count_if(F.lit(turn_s) > took).alias("gaining"))


def length_cases(df: DataFrame, lengths: list[float]) -> DataFrame:
    """Per minimum length of both lines: pairs, segments, and kilometres of lines and of gaps; zeros where none is left."""
    every = df.select("a_length", "b_length", "gap", F.explode(F.array(*[F.lit(float(v)) for v in lengths])).alias("min_length"))
    kept = (c("a_length") >= c("min_length")) & (c("b_length") >= c("min_length"))
    km = lambda x: F.sum(F.when(kept, x).otherwise(0.0)) / 1000
    return every.groupBy("min_length").agg(F.count_if(kept).alias("pairs"), (2 * F.count_if(kept)).alias("segments"), km(c("a_length") + c("b_length")).alias("paired_km"), km(c("gap")).alias("gap_km"))


def rank_trials(df: DataFrame) -> DataFrame:
    """Trials (delta, phase, pairs, paired_m, median_gap) in order of preference."""
    order = [c("pairs").desc(), c("paired_m").desc(), c("median_gap").asc(), F.abs("delta").asc(), c("phase").asc(), c("delta").asc()]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("pair_id").orderBy(*order)))


def interface(a: DataFrame, b: DataFrame, reach: float, tol: float, cell: float = 50.0) -> DataFrame:
    """Of two sets of field edges (field, id, seq, x0..y1) per pair of fields within reach: least distance, the pair of
    edges that has it (of equal ones the first), the direction of a's edge there (degrees, mod 180), and the length of those parts of
    a's edges that run within tol of b's."""
    near = segments_within(a.withColumn("a_field", c("field")), b.withColumn("b_field", c("field")), reach, cell, more=(["a_field"], ["b_field"]), ends=True)
    m = near.withColumnsRenamed({**{f"a_{n}": n for n in ("x0", "y0", "x1", "y1")}, "b_x0": "p0", "b_y0": "q0", "b_x1": "p1", "b_y1": "q1"})
    length = X.distance(c("x0"), c("y0"), c("x1"), c("y1"))
    stay = capsule_stay(tol)(*[c(n) for n in ("x0", "y0", "x1", "y1", "p0", "q0", "p1", "q1")])
    part = m.filter(c("dist") <= tol).withColumn("stay", stay).filter("stay.first IS NOT NULL")
    part = part.select("a_field", "b_field", "a_id", "a_seq", (c("stay.first") * length).alias("lo"), (c("stay.last") * length).alias("hi"))
    shared = merge_intervals(part, ["a_field", "b_field", "a_id", "a_seq"], tol=1e-9).groupBy("a_field", "b_field").agg(F.sum(c("hi") - c("lo")).alias("near_m"))
    turn = F.degrees(F.atan2(c("y1") - c("y0"), c("x1") - c("x0")))
    best = F.min(F.struct(F.round("dist", 9).alias("dist"), "a_id", "a_seq", "b_id", "b_seq", F.pmod(turn, F.lit(180.0)).alias("direction"))).alias("b")
    out = m.groupBy("a_field", "b_field").agg(best).select("a_field", "b_field", c("b.dist").alias("min_dist"), c("b.a_id").alias("near_a"), c("b.b_id").alias("near_b"), c("b.direction").alias("direction"))
    return out.join(shared, ["a_field", "b_field"], "left").fillna(0.0, ["near_m"])
