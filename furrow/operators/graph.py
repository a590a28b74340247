"""Graphs as edge rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import expr as X
from furrow.operators import nearest as N
from furrow.operators.hydrology import closure
from furrow.session import ship

__all__ = ["closure", "components", "split_runs", "build_edges", "snap", "shortest_paths"]
c = F.col


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable): each node takes the smallest label around it, then that label's own
    label, until nothing changes; every step is checkpointed."""
    both = edges.select("a", "b").unionAll(edges.select(c("b").alias("a"), c("a").alias("b"))).distinct().checkpoint()
    label = nodes.select("node", c("node").alias("component")).distinct().checkpoint()
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("near"))
        low = label.join(near, label["node"] == near["a"], "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        up = label.select(c("node").alias("low"), c("component").alias("lowest"))
        new = low.join(up, "low").select("node", F.least("low", "lowest").alias("component"), c("component").alias("was")).checkpoint()
        label = new.select("node", "component")
        if new.filter("component < was").isEmpty():
            return label


#: Segments of a run that a task may gather.
MOST = 200


def _parts_of_runs(starts: np.ndarray, run: np.ndarray, ends: list[np.ndarray]) -> np.ndarray:
    """The part (from 1, by the first segment) that each segment belongs to: segments lie run by run, run r from starts[r] on;
    those of a run that share a node (ends: x0, y0, x1, y1) are one part."""
    n = len(run)
    x, y = np.concatenate([ends[0], ends[2]]), np.concatenate([ends[1], ends[3]])
    own = np.concatenate([run, run])
    order = np.lexsort((y, x, own))
    xs, ys, rs = x[order], y[order], own[order]
    same = lambda v: (v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1]))
    node = np.empty(2 * n, np.int64)
    node[order] = np.cumsum(np.append(0, ~(same(xs) & same(ys) & (rs[1:] == rs[:-1])))) if n else 0
    a, b = node[:n], node[n:]
    # each segment's label is the first segment that it is known to reach
    label = np.arange(n)
    while n:
        low = np.full(node.max() + 1, n)
        np.minimum.at(low, a, label)
        np.minimum.at(low, b, label)
        new = np.minimum(low[a], low[b])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        # what a segment reached, its old label reaches as well
        np.minimum.at(new, label, new.copy())
        label = new
    first = np.cumsum(label == np.arange(n))
    return first[label] - (first[starts] - 1)[run] if n else label


def split_runs(segments: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Segments (run_id, sequence, segment_id, x0, y0, x1, y1) whose runs fall apart get run ids with :C001 and so on,
    parts ordered by (sequence, segment). Ends are the same node if equal after rounding to 6 digits.

    Nodes are shared within a run only, so runs of up to `most` segments are gathered, and tasks tell the parts of many at a
    time; longer ones go by rounds over their nodes."""
    ends = ["x0", "y0", "x1", "y1"]
    s = segments.filter("run_id IS NOT NULL").select("run_id", "sequence", "segment_id", *[F.round(c(e), 6).cast("double").alias(e) for e in ends])
    long = s.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > most).select("run_id").checkpoint()
    out = None
    if not long.isEmpty():
        out = _split_long(s.join(long, "run_id", "left_semi"))
        s = s.join(long, "run_id", "left_anti")
    short = _split_short(s)
    out = short if out is None else short.unionByName(out)
    return out, out.agg(F.countDistinct("run_id").alias("before"), F.countDistinct("new_run_id").alias("after"))


def _name(n: Column, rank: Column) -> Column:
    return F.when(n > 1, F.concat("run_id", F.lit(":C"), F.lpad(rank.cast("string"), 3, "0"))).otherwise(c("run_id"))


def _split_short(s: DataFrame) -> DataFrame:
    """Rows are dealt by run and sorted; a batch's last run goes on with the next batch."""
    ship(s.sparkSession)
    names = ["run_id", "sequence", "segment_id", "x0", "y0", "x1", "y1"]

    def told(t: pa.Table) -> pa.RecordBatch:
        runs = t.column("run_id").combine_chunks()
        new = np.append(True, pc.not_equal(runs[1:], runs[:-1]).to_numpy(zero_copy_only=False))
        starts, run = np.flatnonzero(new), np.cumsum(new) - 1
        # a zero is one node whatever its sign
        part = _parts_of_runs(starts, run, [t.column(e).to_numpy().astype(float) + 0.0 for e in names[3:]])
        n = np.maximum.reduceat(part, starts)[run]
        return pa.RecordBatch.from_arrays([runs, t.column("sequence").combine_chunks(), t.column("segment_id").combine_chunks(), pa.array(part, pa.int64()), pa.array(n, pa.int64())], names=[*names[:3], "part", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0)
            last = ids[-1]
            if held and held[0].column(0)[0] != last:
                # the first row of the batch's last run
                cut = b.num_rows - int(np.argmin(np.append(pc.equal(ids, last).to_numpy(zero_copy_only=False)[::-1], False)))
                yield told(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = [b.slice(cut)]
            else:
                held.append(b)
        if held:
            yield told(pa.Table.from_batches(held))

    kinds = ", ".join(f"{n} {s.schema[n].dataType.simpleString()}" for n in names[:3])
    out = s.select(*names).repartition("run_id").sortWithinPartitions("run_id", "sequence", "segment_id").mapInArrow(run, f"{kinds}, part bigint, n bigint")
    return out.select("segment_id", "run_id", _name(c("n"), c("part")).alias("new_run_id"), "sequence")


def _split_long(s: DataFrame) -> DataFrame:
    # a zero is one node whatever its sign
    at = lambda x, y: F.concat_ws("|", "run_id", F.format_number(c(x) + 0.0, 6), F.format_number(c(y) + 0.0, 6))
    s = s.withColumn("na", at("x0", "y0")).withColumn("nb", at("x1", "y1"))
    label = components(s.select(c("na").alias("node")).union(s.select("nb")), s.select(c("na").alias("a"), c("nb").alias("b")))
    s = s.join(label.withColumnRenamed("node", "na"), "na")
    parts = s.groupBy("run_id", "component").agg(F.min(F.struct("sequence", "segment_id")).alias("first"))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy("first"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("run_id")))
    return s.join(parts.select("run_id", "component", _name(c("n"), c("rank")).alias("new_run_id")), ["run_id", "component"]).select("segment_id", "run_id", "new_run_id", "sequence")


def build_edges(segments: DataFrame, stops: DataFrame) -> DataFrame:
    """a, b, weight of an undirected network: segments (segment_id, x0, y0, x1, y1) are cut at stops (segment_id,
    station in 0..length); of parallel edges the shortest stays, loops go."""
    length = X.distance(c("x0"), c("y0"), c("x1"), c("y1"))
    s = segments.withColumn("length", length)
    marks = s.select("segment_id", F.explode(F.array(F.lit(0.0), c("length"))).alias("station")).union(stops.select("segment_id", "station")).distinct()
    w = Window.partitionBy("segment_id").orderBy("station")
    piece = marks.withColumn("to", F.lead("station").over(w)).filter("to IS NOT NULL").join(s, "segment_id")
    at = lambda t, a, b: F.round(c(a) + (c(b) - c(a)) * F.when(c("length") > 0, c(t) / c("length")).otherwise(0.0), 6)
    node = lambda t: F.format_string("%.3f,%.3f", at(t, "x0", "x1"), at(t, "y0", "y1"))
    e = piece.select(node("station").alias("p"), node("to").alias("q"), (c("to") - c("station")).alias("weight"))
    return e.filter("p != q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "weight").groupBy("a", "b").agg(F.min("weight").alias("weight"))


def snap(points: DataFrame, segments: DataFrame, tol: float, exclusions: DataFrame | None = None, cell: float = 50.0) -> DataFrame:
    """Where points (point_id, x, y) join a network of segments (segment_id, x0, y0, x1, y1): the nearest segment, however
    far, with station, gap and the reasons against it (farther than tol; its connector touches an exclusion); and the
    nearest one that has none (legal_segment_id, legal_station, legal_gap), with the number of nearer ones passed over.

    exclusions: edges (polygon_id, x0, y0, x1, y1) of polygons. The nearest comes by rings that grow until they hold one;
    all others within tol are tried in the order of their gaps."""
    near = N.nearest(points, segments, tol)
    legal = N.within(points, segments, tol)
    every = near.unionByName(legal).dropDuplicates(["point_id", "segment_id"])
    every = every.withColumn("connector_id", F.struct("point_id", "segment_id")).checkpoint()
    if exclusions is None:
        every = every.withColumn("cut", F.lit(False))
    else:
        every = every.join(N.blocked(every, exclusions, cell).withColumn("cut", F.lit(True)), "connector_id", "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    far = c("gap") > tol
    w = Window.partitionBy("point_id").orderBy("gap", "segment_id")
    tried = every.withColumn("place", F.row_number().over(w)).withColumn("why", N.reasons((far, "ACCESS_CONNECTOR_EXCEEDS_TOLERANCE"), (c("cut"), "ACCESS_CONNECTOR_INTERSECTS_EXCLUSION")))
    own = F.struct("segment_id", "station", "gap", "why")
    best = tried.groupBy("point_id").agg(F.min(F.when(c("place") == 1, own)).alias("n"), F.min(F.when(c("why") == "", F.struct("place", "segment_id", "station", "gap"))).alias("l"), F.count(F.lit(1)).alias("all"))
    out = points.select("point_id").join(best, "point_id", "left")
    none = F.when(c("n").isNull(), "NO_ROAD").otherwise(c("n.why"))
    return out.select(
        "point_id", "n.segment_id", "n.station", "n.gap", none.alias("reasons"), c("l.segment_id").alias("legal_segment_id"), c("l.station").alias("legal_station"), c("l.gap").alias("legal_gap"),
        F.coalesce(c("l.place") - 1, c("all"), F.lit(0)).cast("int").alias("passed_over"),
    )


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target, distance (null: unreachable). Frontier relaxation: only nodes whose distance fell go on; each
    round is one join and one aggregation, checkpointed."""
    both = edges.select("a", "b", "weight").unionAll(edges.select(c("b").alias("a"), c("a").alias("b"), "weight")).checkpoint()
    best = sources.select(c("node").alias("source"), c("node").alias("at"), F.lit(0.0).alias("d")).checkpoint()
    front = best
    while not front.isEmpty():
        step = front.join(both, front["at"] == both["a"]).select("source", c("b").alias("at"), (c("d") + c("weight")).alias("d")).groupBy("source", "at").agg(F.min("d").alias("d"))
        known = best.select("source", "at", c("d").alias("had"))
        front = step.join(known, ["source", "at"], "left").filter("had IS NULL OR d < had - 1e-12").select("source", "at", "d").checkpoint()
        best = best.unionByName(front).groupBy("source", "at").agg(F.min("d").alias("d")).checkpoint()
    every = sources.select(c("node").alias("source")).crossJoin(targets.select(c("node").alias("target")))  # the answer asked for
    return every.join(best.select("source", c("at").alias("target"), c("d").alias("distance")), ["source", "target"], "left")
