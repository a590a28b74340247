"""Nearest segments by ring growth, and tests of connectors against polygons; everything meets by grid cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import expr as X

c = F.col
ENDS = ("x0", "y0", "x1", "y1")


def _met(points: DataFrame, segs: DataFrame, reach: float) -> DataFrame:
    """point_id, segment_id, station, gap of all pairs no farther apart than reach. Cells are as wide as the reach."""
    from furrow.operators.geometry import _cells

    seg = _cells(segs.select("segment_id", *[c(k).alias(f"s_{k}") for k in ENDS]), F.lit(reach * (1 + 1e-9)), reach, "s_")
    pt = points.select("point_id", "x", "y", F.floor(c("x") / reach).alias("__cx"), F.floor(c("y") / reach).alias("__cy"))
    s = [c(f"s_{k}") for k in ENDS]
    dx, dy = s[2] - s[0], s[3] - s[1]
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.least(F.greatest(((c("x") - s[0]) * dx + (c("y") - s[1]) * dy) / n, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    met = pt.join(seg, ["__cx", "__cy"]).withColumn("gap", X.pt_seg_dist(c("x"), c("y"), *s)).filter(c("gap") <= reach)
    # a point is in one cell, so a pair meets once
    return met.select("point_id", "x", "y", "segment_id", (t * F.sqrt(n)).alias("station"), "gap", (s[0] + dx * t).alias("sx"), (s[1] + dy * t).alias("sy"))


def within(points: DataFrame, segs: DataFrame, reach: float) -> DataFrame:
    """All segments (segment_id, x0, y0, x1, y1) within reach of points (point_id, x, y): point_id, x, y, segment_id,
    station, gap, and sx, sy, the nearest place on the segment."""
    return _met(points, segs, reach)


def nearest(points: DataFrame, segs: DataFrame, start: float) -> DataFrame:
    """The nearest segment of each point, however far (of equally near ones the least id); the columns of within().

    Rings grow: points that have nothing within the reach go on with twice the reach, and cells of that width. All
    segments within a reach are seen, so the nearest of those is the nearest of all."""
    first = lambda met: met.groupBy("point_id").agg(F.min(F.struct("gap", "segment_id", "station", "sx", "sy", "x", "y")).alias("b")).select("point_id", "b.x", "b.y", "b.segment_id", "b.station", "b.gap", "b.sx", "b.sy")
    some = segs.limit(1).count()
    left, out, reach = points.select("point_id", "x", "y"), None, float(start)
    while True:
        found = first(_met(left, segs, reach)).checkpoint()
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select("point_id"), "point_id", "left_anti").filter("x IS NOT NULL AND y IS NOT NULL").checkpoint()
        if not some or left.isEmpty():
            return out
        reach *= 2


def ring_edges(corners: DataFrame, key: str = "polygon_id") -> DataFrame:
    """key, x0, y0, x1, y1 of rings (key, ring, seq, x, y) whose last vertex repeats the first."""
    from furrow.operators.geometry import segments

    return segments(corners, [key, "ring"]).select(key, *ENDS)


def inside(points: DataFrame, edges: DataFrame, cell: float, key: str = "polygon_id") -> DataFrame:
    """point_id, key of the polygons that hold a point, by the parity of crossings to its left (holes respected).

    A polygon is known to each cell of the stretch that it takes in a row of cells; points there are held against its
    edges in that row."""
    row = lambda y: F.floor(y / cell)
    banded = edges.withColumn("__r", F.explode(F.sequence(row(F.least("y0", "y1")), row(F.greatest("y0", "y1")))))
    stretch = banded.groupBy(key, "__r").agg(F.min(F.least("x0", "x1")).alias("lo"), F.max(F.greatest("x0", "x1")).alias("hi"))
    # a row that a polygon passes without a vertex or slope within still has its edges banded, so it has a stretch
    near = stretch.withColumn("__c", F.explode(F.sequence(F.floor(c("lo") / cell), F.floor(c("hi") / cell)))).select(key, "__r", "__c")
    pt = points.select("point_id", "x", "y", row(c("y")).alias("__r"), F.floor(c("x") / cell).alias("__c"))
    pairs = pt.join(near, ["__r", "__c"]).select("point_id", "x", "y", "__r", key)
    at = c("x0") + (c("x1") - c("x0")) * F.try_divide(c("y") - c("y0"), c("y1") - c("y0"))
    crossed = pairs.join(banded, [key, "__r"]).filter((c("y0") > c("y")) != (c("y1") > c("y"))).filter(c("x") < at)
    return crossed.groupBy("point_id", key).agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").select("point_id", key)


def blocked(connectors: DataFrame, edges: DataFrame, cell: float, key: str = "polygon_id") -> DataFrame:
    """connector_id of the connectors (connector_id, x, y, sx, sy) that touch a polygon (edges: key, x0, y0, x1, y1): they
    cross or touch an edge, or begin inside. A connector without length touches nothing."""
    from furrow.operators.geometry import segments_within

    some = connectors.filter(X.distance(c("x"), c("y"), c("sx"), c("sy")) > 1e-9)
    seq = F.lit(0).alias("seq")
    a = some.select(c("connector_id").alias("id"), seq, c("x").alias("x0"), c("y").alias("y0"), c("sx").alias("x1"), c("sy").alias("y1"))
    b = edges.select(c(key).alias("id"), F.monotonically_increasing_id().alias("seq"), *ENDS)
    cut = segments_within(a, b, 0.0, cell).select(c("a_id").alias("connector_id"))
    held = inside(some.select(c("connector_id").alias("point_id"), "x", "y"), edges, cell, key).select(c("point_id").alias("connector_id"))
    return cut.unionByName(held).distinct()


def on_edges(points: DataFrame, edges: DataFrame, reach: float, cell: float, key: str = "polygon_id") -> DataFrame:
    """point_id of the points within reach of an edge."""
    from furrow.operators.geometry import segments_within

    seq = F.lit(0).alias("seq")
    a = points.select(c("point_id").alias("id"), seq, c("x").alias("x0"), c("y").alias("y0"), c("x").alias("x1"), c("y").alias("y1"))
    b = edges.select(c(key).alias("id"), F.monotonically_increasing_id().alias("seq"), *ENDS)
    return segments_within(a, b, reach, cell).select(c("a_id").alias("point_id")).distinct()


def near_area(points: DataFrame, edges: DataFrame, reach: float, cell: float, key: str = "polygon_id") -> DataFrame:
    """point_id of the points that lie in a polygon or within reach of one."""
    return inside(points, edges, cell, key).select("point_id").union(on_edges(points, edges, reach, cell, key)).distinct()


def outside_pieces(connectors: DataFrame, edges: DataFrame, cell: float, key: str = "polygon_id", tol: float = 1e-7) -> DataFrame:
    """connector_id, length of the pieces of connectors (connector_id, x, y, sx, sy) that lie outside the union of the
    polygons. A connector is cut where it crosses an edge of any polygon; a piece is inside if its middle lies in a polygon
    or on an edge."""
    from furrow.operators.geometry import _cells

    a = _cells(connectors.select("connector_id", c("x").alias("a_x0"), c("y").alias("a_y0"), c("sx").alias("a_x1"), c("sy").alias("a_y1")), F.lit(0.0), cell, "a_")
    b = _cells(edges.select(*[c(n).alias(f"b_{n}") for n in ENDS]), F.lit(1e-6), cell, "b_")
    dx, dy, ex, ey = c("a_x1") - c("a_x0"), c("a_y1") - c("a_y0"), c("b_x1") - c("b_x0"), c("b_y1") - c("b_y0")
    den, fx, fy = dx * ey - dy * ex, c("b_x0") - c("a_x0"), c("b_y0") - c("a_y0")
    t, u = F.try_divide(fx * ey - fy * ex, den), F.try_divide(fx * dy - fy * dx, den)
    cuts = a.join(b, ["__cx", "__cy"]).select("connector_id", t.alias("t"), u.alias("u")).filter("t > 0 AND t < 1 AND u >= -1e-9 AND u <= 1 + 1e-9")
    cuts = cuts.groupBy("connector_id").agg(F.collect_set("t").alias("ts"))  # as many as a connector crosses edges
    whole = connectors.join(cuts, "connector_id", "left").withColumn("ts", F.sort_array(F.array_union(F.coalesce("ts", F.array().cast("array<double>")), F.array(F.lit(0.0), F.lit(1.0)))))
    piece = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ts") - 1))).withColumn("t0", F.get("ts", c("k") - 1)).withColumn("t1", F.get("ts", c("k")))
    piece = piece.withColumn("length", (c("t1") - c("t0")) * X.distance(c("x"), c("y"), c("sx"), c("sy"))).filter(c("length") > tol)
    middle = (c("t0") + c("t1")) / 2
    points = piece.select(F.struct("connector_id", "k").alias("point_id"), "length", (c("x") + (c("sx") - c("x")) * middle).alias("x"), (c("y") + (c("sy") - c("y")) * middle).alias("y")).checkpoint()
    return points.join(near_area(points, edges, tol, cell, key), "point_id", "left_anti").select("point_id.connector_id", "length")


def uncovered(connectors: DataFrame, edges: DataFrame, cell: float, key: str = "polygon_id", tol: float = 1e-7) -> DataFrame:
    """connector_id of the connectors (connector_id, x, y, sx, sy) that leave the union of the polygons."""
    return outside_pieces(connectors, edges, cell, key, tol).select("connector_id").distinct()


def reasons(*pairs: tuple[Column, str]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(cond, code) for cond, code in pairs])), ",")
