"""Rain to overflow: balances, excess, hydrographs, lag routing, section capacity, profiles, overflow paths.

Every operator handles many events or reaches in one job, keyed by their ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import expr as X
from furrow.operators.order import spread

EPS = 1e-12


def _event() -> Window:
    return Window.partitionBy("event_id").orderBy("idx")


def mass_balance(intervals: DataFrame, catchments: DataFrame, tol: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Intervals with volumes, residual and mean rates; events with totals and PASS or FAIL."""
    rows = intervals.join(catchments, "event_id")
    rain = F.col("rainfall_excess_mm") / 1000 * F.col("area_ha") * 1e4
    rows = rows.withColumn("rain_m3", rain).withColumn("inflow_m3", F.col("rain_m3") + F.col("external_inflow_m3"))
    rows = rows.withColumn("storage_change_m3", F.col("storage_end_m3") - F.col("storage_start_m3"))
    rows = rows.withColumn("residual_m3", F.col("inflow_m3") - F.col("controlled_outflow_m3") - F.col("storage_change_m3"))
    rows = rows.withColumn("inflow_rate", F.col("inflow_m3") / F.col("duration_s")).withColumn("outflow_rate", F.col("controlled_outflow_m3") / F.col("duration_s"))
    events = rows.groupBy("event_id").agg(
        F.sum("inflow_m3").alias("inflow_m3"), F.sum("controlled_outflow_m3").alias("outflow_m3"), (F.max_by("storage_end_m3", "idx") - F.min_by("storage_start_m3", "idx")).alias("storage_change_m3"),
        F.max("inflow_rate").alias("peak_inflow_rate"), F.max("outflow_rate").alias("peak_outflow_rate"),
    )
    residual = F.col("inflow_m3") - F.col("outflow_m3") - F.col("storage_change_m3")
    base = F.greatest(F.col("inflow_m3"), F.col("outflow_m3") + F.abs("storage_change_m3"), F.lit(EPS))
    events = events.withColumn("residual_m3", residual).withColumn("relative_residual", F.abs("residual_m3") / base)
    return rows, events.withColumn("status", F.when(F.col("relative_residual") <= tol + 1e-15, "PASS").otherwise("FAIL"))


def storage_breaks(intervals: DataFrame) -> DataFrame:
    """Intervals that don't start where the one before ended."""
    before = F.lag("storage_end_m3").over(_event())
    gap = F.col("storage_start_m3") - F.col("before_m3")
    return intervals.withColumn("before_m3", before).withColumn("gap_m3", gap).filter(F.abs("gap_m3") > 1e-9).select("event_id", "idx", "gap_m3")


def rainfall_excess(intervals: DataFrame, params: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Incremental excess of the running curve-number runoff; and the event roll-up.
    params: event_id, area_ha, curve_number, ia_ratio."""
    run = _event().rowsBetween(Window.unboundedPreceding, 0)
    rows = intervals.join(params, "event_id").withColumn("cumulative_mm", F.sum("rain_mm").over(run)).withColumn("elapsed_s", F.sum("duration_s").over(run))
    rows = rows.withColumn("runoff_mm", X.cn_runoff(F.col("cumulative_mm"), F.col("curve_number"), F.col("ia_ratio")))
    rows = rows.withColumn("excess_mm", F.greatest(F.lit(0.0), F.col("runoff_mm") - F.coalesce(F.lag("runoff_mm").over(_event()), F.lit(0.0))))
    rows = rows.withColumn("loss_mm", F.col("rain_mm") - F.col("excess_mm")).withColumn("intensity_mm_h", F.col("rain_mm") / F.col("duration_s") * 3600)
    events = rows.groupBy("event_id", "area_ha").agg(F.sum("rain_mm").alias("rain_mm"), F.sum("excess_mm").alias("excess_mm"), F.max("intensity_mm_h").alias("peak_intensity_mm_h"))
    events = events.withColumn("excess_m3", F.col("excess_mm") * F.col("area_ha") * 10)
    return rows, events.withColumn("runoff_coefficient", F.when(F.col("rain_mm") > 0, F.col("excess_mm") / F.col("rain_mm")).otherwise(0.0))


def hydrograph(excess: DataFrame, lag_s: float, step_s: float, base_ratio: float) -> DataFrame:
    """event_id, time_s, flow: triangular pulses of all intervals, added on the union of their corners and a step grid.
    excess: event_id, idx, start_s, duration_s, volume_m3. Pulses and times meet by time bucket, so no event is a
    nested loop over its own length."""
    peak = F.col("start_s") + lag_s + F.col("duration_s") / 2
    length = (F.lit(lag_s) + F.col("duration_s") / 2) * base_ratio
    pulses = excess.select("event_id", F.col("start_s").alias("t0"), peak.alias("tp"), (F.col("start_s") + length).alias("t1"), (F.col("volume_m3") * 2 / length).alias("qp"), length.alias("len"))
    ends = pulses.groupBy("event_id").agg(F.max("t1").alias("end"), F.max("len").alias("width"))
    corners = pulses.select("event_id", F.explode(F.array("t0", "tp", "t1")).alias("time_s"))
    grid = ends.select("event_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.col("end") / step_s).cast("int")), lambda k: k * step_s)).alias("time_s"))
    times = corners.unionByName(grid).unionByName(ends.select("event_id", F.col("end").alias("time_s"))).distinct()
    bucket = lambda t: F.floor(t / F.col("width"))
    wide = pulses.join(ends.select("event_id", "width"), "event_id").withColumn("b", F.explode(F.sequence(bucket(F.col("t0")), bucket(F.col("t1")))))
    at = times.join(ends.select("event_id", "width"), "event_id").withColumn("b", bucket(F.col("time_s")))
    hit = at.join(wide.drop("width"), ["event_id", "b"]).filter("t0 < time_s AND time_s < t1")
    t = F.col("time_s")
    q = F.when(t <= F.col("tp"), F.col("qp") * (t - F.col("t0")) / (F.col("tp") - F.col("t0"))).otherwise(F.col("qp") * (F.col("t1") - t) / (F.col("t1") - F.col("tp")))
    flow = hit.groupBy("event_id", "time_s").agg(F.sum(q).alias("flow"))
    return times.join(flow, ["event_id", "time_s"], "left").select("event_id", "time_s", F.coalesce("flow", F.lit(0.0)).alias("flow"))


def integrate_series(series: DataFrame, key: str = "event_id") -> DataFrame:
    """series with the trapezoidal running volume."""
    w = Window.partitionBy(key).orderBy("time_s")
    piece = (F.col("flow") + F.lag("flow").over(w)) / 2 * (F.col("time_s") - F.lag("time_s").over(w))
    return series.withColumn("piece", F.coalesce(piece, F.lit(0.0))).withColumn("cumulative_m3", F.sum("piece").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("piece")


def series_balance(series: DataFrame, volumes: DataFrame, key: str = "event_id", tol: float = 1e-10) -> DataFrame:
    """Volume, peak and its earliest time, and the balance against the volume put in (key, input_m3)."""
    s = integrate_series(series, key).groupBy(key).agg(F.max("cumulative_m3").alias("volume_m3"), F.max_by(F.struct("flow", "time_s"), F.struct("flow", -F.col("time_s"))).alias("p"))
    s = s.select(key, "volume_m3", F.col("p.flow").alias("peak_flow"), F.col("p.time_s").alias("time_to_peak_s")).join(volumes, key)
    rel = F.abs(F.col("volume_m3") - F.col("input_m3")) / F.greatest(F.abs("input_m3"), F.lit(EPS))
    return s.withColumn("relative_residual", rel).withColumn("status", F.when(F.col("relative_residual") <= tol, "PASS").otherwise("FAIL"))


def check_series(series: DataFrame, key: str = "event_id") -> DataFrame:
    """One row a series: whether it has points enough, ordered times, no negative flow, and zero ends."""
    w = Window.partitionBy(key).orderBy("seq")
    rows = series.withColumn("dt", F.col("time_s") - F.lag("time_s").over(w))
    out = rows.groupBy(key).agg(
        (F.count(F.lit(1)) >= 2).alias("enough_points"), F.coalesce(F.min("dt") > 0, F.lit(False)).alias("increasing"), (F.min("time_s") >= 0).alias("non_negative_time"), (F.min("flow") >= 0).alias("non_negative_flow"),
        ((F.min_by("flow", "seq") == 0) & (F.max_by("flow", "seq") == 0)).alias("zero_ends"),
    )
    return out.withColumn("valid", F.col("enough_points") & F.col("increasing") & F.col("non_negative_time") & F.col("non_negative_flow") & F.col("zero_ends"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def closure(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """All (a, b) with a way from a to b, of any length. What a round finds new is joined to all that is known, so ways get
    twice as long each round and the rounds are as many as the logarithm of the depth; cycles end by themselves. Each
    round's finds are written once."""
    new = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct().checkpoint()
    parts = []
    while not new.isEmpty():
        parts.append(new)
        known = _union(parts)
        longer = new.select("a", F.col("b").alias("m")).join(known.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
        new = longer.join(known, ["a", "b"], "left_anti").checkpoint()
    return _union(parts) if parts else new


def doubled(step: DataFrame, lags: list[str]) -> tuple[list[DataFrame], DataFrame | None]:
    """Pointers (node, to, lags) one step down, two steps, four, and so on, until no node has one that far; step has one row
    a node at most. If some go on past as many steps as there are nodes, they go round: the last pointers, else None."""
    out, n = [step.select("node", "to", *lags).checkpoint()], step.count()
    while True:
        far = out[-1]
        then = far.select(F.col("node").alias("to"), F.col("to").alias("end"), *[F.col(c).alias(f"__{c}") for c in lags])
        new = far.join(then, "to").select("node", F.col("end").alias("to"), *[(F.col(c) + F.col(f"__{c}")).alias(c) for c in lags]).checkpoint()
        if new.isEmpty():
            return out, None
        if 2 ** len(out) > n:
            return out, new
        out.append(new)


def below(marks: DataFrame, pointers: list[DataFrame]) -> DataFrame:
    """marks (node) and all nodes down from them along the pointers."""
    for p in pointers:
        marks = marks.unionAll(marks.join(p, "node").select(F.col("to").alias("node"))).distinct().checkpoint()
    return marks


def check_network(reaches: DataFrame, lateral_nodes: DataFrame) -> DataFrame:
    """(rule, key) of what is wrong with a drainage network, and OUTLET and DRY facts.

    Nodes with one way down are followed by doubled pointers, so a main stem of any length takes as many rounds as the
    logarithm of its reaches. Only splits, which are faults, need a closure, and that is of the splits alone."""
    r = reaches.select("reach_id", "up", "down")
    fact = lambda df, rule, key: df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
    many = lambda c: r.groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    edges = r.filter("up != down").select(F.col("up").alias("node"), F.col("down").alias("to")).distinct().checkpoint()
    ways = edges.groupBy("node").agg(F.count(F.lit(1)).alias("ways"))
    single = edges.join(ways.filter("ways = 1"), "node").select("node", "to")
    split = edges.join(ways.filter("ways > 1"), "node").select("node", "to").checkpoint()
    pointers, round_ = doubled(single, [])
    loose = lateral_nodes.select("node").distinct()
    fed = below(loose.checkpoint(), pointers)
    cycles = [] if round_ is None else [round_.select(F.col("to").alias("node")).distinct()]
    if not split.isEmpty():
        # where the way from each branch of a split ends: the next split, an outlet, or nowhere (a cycle without splits)
        splits = split.select("node").distinct()
        ends = pointers[0].select("node", F.col("to").alias("end"))
        for _ in pointers:
            ends = ends.join(ends.select(F.col("node").alias("end"), F.col("end").alias("later")), "end", "left").select("node", F.coalesce("later", "end").alias("end")).checkpoint()
        branch = split.join(ends.withColumnRenamed("node", "to"), "to", "left").select("node", "to", F.coalesce("end", "to").alias("end"))
        branch = branch.join(splits.withColumnRenamed("node", "end"), "end", "left_semi").checkpoint()
        ways_on = closure(branch, "node", "end")
        back = ways_on.select(F.col("a").alias("end"), F.col("b").alias("node")).unionAll(splits.select("node", F.col("node").alias("end")).select("end", "node"))
        around = branch.join(back, ["node", "end"], "left_semi")
        cycles.append(below(around.select("node").union(around.select(F.col("to").alias("node"))).distinct().checkpoint(), pointers))
        met = fed.join(splits, "node", "left_semi")
        more = met.unionAll(met.join(ways_on, met["node"] == ways_on["a"]).select(F.col("b").alias("node"))).distinct()
        heads = split.join(more, "node", "left_semi").select(F.col("to").alias("node"))
        fed = below(fed.unionAll(more).unionAll(heads).distinct().checkpoint(), pointers)
    nodes = r.select(F.col("up").alias("node")).union(r.select("down")).distinct()
    out = [
        fact(many("reach_id"), "DUPLICATE_REACH", "reach_id"), fact(r.filter("up = down"), "SELF_LOOP", "reach_id"), fact(many("up"), "SPLIT", "up"), *[fact(x, "CYCLE", "node") for x in cycles],
        fact(loose.join(nodes, "node", "left_anti"), "UNKNOWN_NODE", "node"), fact(nodes.join(r.select(F.col("up").alias("node")), "node", "left_anti"), "OUTLET", "node"),
        fact(r.join(fed, r["up"] == fed["node"], "left_anti"), "DRY", "reach_id"),
    ]
    return reduce(DataFrame.unionAll, out).distinct()


def path_lags(reaches: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, reach_id, lag_s: for each of the nodes (default: all) the reaches downstream of it and the travel time to their
    ends. Ways double in each round, so there are as many rounds as the logarithm of the depth. Each node must have one
    way down at most and no cycle may be; else this is an error that names a node."""
    step = reaches.select(F.col("up").alias("node"), F.col("down").alias("to"), F.col("travel_s").alias("lag_s"), "reach_id").checkpoint()
    twice = step.groupBy("node").count().filter("count > 1").first()
    if twice:
        raise ValueError(f"flow splits at node {twice['node']}")
    pointers, round_ = doubled(step, ["lag_s"])
    if round_ is not None:
        raise ValueError(f"the network must be acyclic; node {round_.first()['to']} lies on a cycle")
    # at: a node that a start's flow passes, and when
    start = (step.select("node") if nodes is None else nodes.select("node")).distinct()
    passed = start.select("node", F.col("node").alias("at"), F.lit(0.0).alias("so_far")).checkpoint()
    for p in pointers:
        far = passed.join(p.withColumnRenamed("node", "at"), "at").select("node", F.col("to").alias("at"), (F.col("so_far") + F.col("lag_s")).alias("so_far"))
        passed = passed.unionAll(far).checkpoint()
    return passed.join(step.select(F.col("node").alias("at"), "reach_id", "lag_s"), "at").select("node", "reach_id", (F.col("so_far") + F.col("lag_s")).alias("lag_s"))


def route_by_lag(reaches: DataFrame, lateral: DataFrame, bucket_s: float = 3600.0) -> DataFrame:
    """reach_id, time_s, flow at each reach's end. Pure lag is linear, so every lateral series (node, time_s, flow) is
    shifted by its path's travel time and added to the others on the union of all their times; between its own times
    a series is a straight line, outside it is zero."""
    moved = lateral.join(path_lags(reaches, lateral), "node").select("reach_id", "node", (F.col("time_s") + F.col("lag_s")).alias("time_s"), "flow")
    w = Window.partitionBy("reach_id", "node").orderBy("time_s")
    seg = moved.withColumn("t1", F.lead("time_s").over(w)).withColumn("q1", F.lead("flow").over(w)).filter("t1 IS NOT NULL").withColumnsRenamed({"time_s": "t0", "flow": "q0"})
    b = lambda t: F.floor(t / bucket_s)
    seg = seg.withColumn("b", F.explode(F.sequence(b(F.col("t0")), b(F.col("t1")))))
    times = moved.select("reach_id", "time_s").distinct().withColumn("b", b(F.col("time_s")))
    hit = times.join(seg, ["reach_id", "b"]).filter("t0 <= time_s AND time_s < t1")
    q = F.col("q0") + (F.col("q1") - F.col("q0")) * (F.col("time_s") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    flow = hit.groupBy("reach_id", "time_s").agg(F.sum(q).alias("flow"))
    return times.drop("b").join(flow, ["reach_id", "time_s"], "left").select("reach_id", "time_s", F.coalesce("flow", F.lit(0.0)).alias("flow"))


def routing_summary(reaches: DataFrame, routed: DataFrame) -> DataFrame:
    """Peak, its earliest time, volume, and ROUTED or DRY of every reach."""
    s = integrate_series(routed, "reach_id").groupBy("reach_id").agg(F.max("cumulative_m3").alias("volume_m3"), F.max("flow").alias("peak_flow"), F.max_by("time_s", F.struct("flow", -F.col("time_s"))).alias("time_to_peak_s"))
    return reaches.select("reach_id").join(s, "reach_id", "left").withColumn("status", F.when(F.col("peak_flow") > 0, "ROUTED").otherwise("DRY"))


def routing_balance(reaches: DataFrame, lateral: DataFrame, routed: DataFrame) -> DataFrame:
    """One row: the volume of all lateral series, the volume that comes out at outlet nodes (by their reaches, and by
    laterals at the outlet itself), the residual, and PASS if it is next to nothing."""
    volume = lambda df, key: integrate_series(df, key).groupBy(key).agg(F.max("cumulative_m3").alias("v"))
    ends = reaches.select(F.col("down").alias("node")).distinct().join(reaches.select(F.col("up").alias("node")), "node", "left_anti")
    own = volume(lateral, "node")
    known = reaches.select(F.col("up").alias("node")).union(reaches.select("down")).distinct()
    into = volume(routed, "reach_id").join(reaches.select("reach_id", F.col("down").alias("node")), "reach_id").join(ends, "node", "left_semi").select("v")
    out = into.unionAll(own.join(ends, "node", "left_semi").select("v")).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("outlet_volume_m3"))
    total = own.join(known, "node", "left_semi").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("input_volume_m3"))
    both = total.crossJoin(out).withColumn("residual_m3", F.col("outlet_volume_m3") - F.col("input_volume_m3"))  # one row each
    both = both.withColumn("relative_residual", F.abs("residual_m3") / F.greatest(F.col("input_volume_m3"), F.lit(1e-12)))
    return both.withColumn("balance_status", F.when(F.col("relative_residual") <= 1e-10, "PASS").otherwise("FAIL"))


def reach_capacity(peaks: DataFrame, sections: DataFrame) -> DataFrame:
    """Capacity, ratio, margin, normal depth and flow state at the peak of each (reach, condition).

    Finding the depth costs much more than reading, so rows are dealt over all tasks, however few files they come from."""
    c = F.col
    df = spread(peaks.join(sections, "section_id")).withColumn("capacity", X.manning_q(c("max_depth"), c("width"), c("side"), c("slope"), c("rough")))
    df = df.withColumn("ratio", c("peak_flow") / c("capacity")).withColumn("margin", c("capacity") - c("peak_flow"))
    df = df.withColumn("normal_depth", X.normal_depth(c("peak_flow"), c("width"), c("side"), c("slope"), c("rough")))
    df = df.withColumn("state", X.flow_state(c("peak_flow"), c("normal_depth"), c("width"), c("side"), c("slope")))
    return df.withColumn("status", F.when(c("ratio") <= 1, "WITHIN_CAPACITY").otherwise("EXCEEDS_CAPACITY")).select("*", "state.*").drop("state")


def stability_status(v: Column, tau: Column, vmax: Column, tau_max: Column, source: Column) -> Column:
    """Against declared limits; a limit without a source is invalid, none at all is not evaluated."""
    fast, strong = F.coalesce(v > vmax, F.lit(False)), F.coalesce(tau > tau_max, F.lit(False))
    declared = vmax.isNotNull() | tau_max.isNotNull()
    return (
        F.when(~declared, "NOT_EVALUATED").when(source.isNull(), "INVALID_LIMIT_WITHOUT_SOURCE").when(fast & strong, "EXCEEDS_BOTH").when(fast, "EXCEEDS_VELOCITY").when(strong, "EXCEEDS_SHEAR").otherwise("WITHIN_DECLARED_LIMITS")
    )


def downstream_control(normal: Column, v: Column, d_depth: Column, d_velocity: Column, k: Column) -> Column:
    """loss, control depth, and whether the boundary raises the water above normal depth."""
    loss = k * F.abs(v * v - d_velocity * d_velocity) / (2 * X.GRAVITY)
    control = F.greatest(normal, d_depth) + loss
    return F.struct(loss.alias("head_loss"), control.alias("control_depth"), F.when(d_depth.isNull(), "NOT_EVALUATED").when(control > normal + EPS, "RAISES").otherwise("DOES_NOT_RAISE").alias("control_status"))


def freeboard_status(control: Column, bankfull: Column, freeboard: Column) -> Column:
    left = bankfull - control
    return (
        F.when(bankfull.isNull() & freeboard.isNull(), "NOT_EVALUATED").when(bankfull.isNull() | freeboard.isNull(), "INVALID_PARTIAL_DECLARATION").when(left < 0, "OVERTOPS").when(left < freeboard, "BELOW_FREEBOARD").otherwise("WITHIN_FREEBOARD")
    )


def capacity_summary(df: DataFrame, conditions: tuple[str, ...] = ("NEW", "CURRENT", "DEGRADED")) -> DataFrame:
    """Counts per status, and per condition, zeros included. df: status, stability, board, overflow_state, control_status
    and condition of each reach."""
    n = lambda c, name: F.count_if(c).alias(name)
    return df.agg(
        F.count(F.lit(1)).alias("reaches"), n(F.col("board") != "NOT_EVALUATED", "freeboard_evaluated"), n(F.col("overflow_state") != "NOT_DECLARED", "overflow_declared"),
        n(F.col("control_status") != "NOT_EVALUATED", "downstream_evaluated"), n(F.col("control_status") == "RAISES", "downstream_controlled"), n(F.col("status") == "WITHIN_CAPACITY", "within"), n(F.col("status") == "EXCEEDS_CAPACITY", "exceeds"), n(F.col("stability") != "NOT_EVALUATED", "stability_evaluated"), n(F.col("stability").startswith("EXCEEDS"), "stability_exceeded"),
        n(F.col("board") == "OVERTOPS", "overtopping"), n(F.col("board") == "BELOW_FREEBOARD", "freeboard_short"), *[n(F.col("condition") == c, f"n_{c.lower()}") for c in conditions],
    )


def rating_curve(sections: DataFrame, steps: int) -> DataFrame:
    """Discharge at `steps` even depths of each section."""
    c = F.col
    df = sections.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("depth", c("max_depth") * c("step") / steps)
    return df.select("section_id", "step", "depth", X.manning_q(c("depth"), c("width"), c("side"), c("slope"), c("rough")).alias("discharge"))


def profile_audit(points: DataFrame, flow: float) -> tuple[DataFrame, DataFrame]:
    """Points of water profiles (section_id, step, station, depth, section columns) with energy residuals to the next
    station upstream of them; and largest depth and Froude number of each profile."""
    c = F.col
    t = X.trapezoid(c("depth"), c("width"), c("side"))
    rows = points.withColumn("s", X.flow_state(F.lit(flow), c("depth"), c("width"), c("side"), c("slope"))).withColumn("radius", t["radius"])
    rows = rows.withColumn("head", c("depth") + c("s.velocity") * c("s.velocity") / (2 * X.GRAVITY)).withColumn("friction", F.pow(c("rough") * c("s.velocity") / F.pow(c("radius"), F.lit(2.0) / 3), F.lit(2.0)))
    w = Window.partitionBy("section_id").orderBy("step")
    dx = c("station") - F.lag("station").over(w)
    residual = F.lag("head").over(w) + c("slope") * dx - c("head") - (c("friction") + F.lag("friction").over(w)) / 2 * dx
    rows = rows.withColumn("energy_residual", residual).withColumn("froude", c("s.froude")).withColumn("supercritical", c("froude") >= 1)
    return rows, rows.groupBy("section_id").agg(F.max("depth").alias("max_depth"), F.max("froude").alias("max_froude"), F.max(F.abs("energy_residual")).alias("max_residual"), F.count_if("supercritical").alias("supercritical"))


def stage_blockers(events: DataFrame, sources: DataFrame, fixed: tuple[str, ...] = ("OVERFLOW_NOT_ROUTED", "OUTLET_NOT_APPROVED"), answered: tuple[str, ...] = ()) -> DataFrame:
    """Codes that block each event: the stage's own, and one per condition; answered ones are left out.
    events: event_id, status, tolerance; sources: event_id, evidence."""
    weak = sources.groupBy("event_id").agg((~F.bool_and(F.col("evidence") == "PROJECT_EVIDENCE")).alias("weak"))
    df = events.join(weak, "event_id", "left")
    found = F.array_compact(F.array(
        F.when(F.coalesce("weak", F.lit(True)), "SOURCE_NOT_PROJECT_EVIDENCE"), F.when(F.col("status") != "PASS", "MASS_BALANCE_FAILED"), F.when(F.col("tolerance").isNull(), "TOLERANCE_NOT_DECLARED"),
    ))
    every = F.array_union(F.array(*[F.lit(x) for x in fixed]), found)
    return df.select("event_id", F.array_join(F.array_sort(F.array_except(every, F.array(*[F.lit(x) for x in answered]).cast("array<string>"))), ",").alias("blockers"))


def screen_paths(vertices: DataFrame, paths: DataFrame, receivers: DataFrame, barriers: DataFrame, tol_xy: float = 2.0, tol_z: float = 0.05, cell: float = 50.0) -> DataFrame:
    """Overflow paths (path_id, seq, x, y, z) towards receivers: length, drop, rises, gaps, barriers within their
    buffers, and CLEAR only if connected, without adverse rise and without barrier.
    barriers: barrier_id, x0, y0, x1, y1, buffer_m."""
    from furrow.operators.geometry import segments, segments_within

    w = Window.partitionBy("path_id").orderBy("seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    v = vertices.withColumn("low", F.min("z").over(so_far)).withColumn("rise", F.col("z") - F.col("low"))
    s = segments(v, "path_id").withColumn("slope", F.when(F.col("len") > 0, (F.col("z0") - F.col("z1")) / F.col("len")))
    by_seg = s.groupBy("path_id").agg(F.sum("len").alias("length_m"), F.min("slope").alias("min_slope"), F.max(F.greatest(F.col("z1") - F.col("z0"), F.lit(0.0))).alias("max_rise"), F.count_if(F.col("z1") - F.col("z0") > tol_z).alias("adverse"))
    by_vert = v.groupBy("path_id").agg(F.max("rise").alias("accumulated_rise"), (F.min_by("z", "seq") - F.max_by("z", "seq")).alias("drop_m"), F.max_by(F.struct("x", "y", "z"), "seq").alias("e"))
    near = segments_within(s.select(F.col("path_id").alias("id"), "seq", "x0", "y0", "x1", "y1"), barriers.withColumnRenamed("barrier_id", "id").withColumn("seq", F.lit(1)), "buffer_m", cell)
    near = near.groupBy(F.col("a_id").alias("path_id")).agg(F.array_join(F.array_sort(F.collect_set(F.col("b_id").cast("string"))), ",").alias("barriers"))
    df = paths.join(by_seg, "path_id").join(by_vert, "path_id").join(receivers.select("receiver_id", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("z").alias("rz")), "receiver_id").join(near, "path_id", "left")
    df = df.withColumn("gap_xy", X.distance(F.col("e.x"), F.col("e.y"), F.col("rx"), F.col("ry"))).withColumn("gap_z", F.abs(F.col("e.z") - F.col("rz")))
    status = F.when((F.col("gap_xy") > tol_xy) | (F.col("gap_z") > tol_z), "NOT_CONNECTED").when((F.col("accumulated_rise") > tol_z) | F.col("barriers").isNotNull(), "REVIEW").otherwise("CLEAR")
    return df.withColumn("status", status).drop("e")


def paths_summary(screened: DataFrame, declared: DataFrame) -> DataFrame:
    """Counts, and paths of pairs that nobody declared. declared: reach_id, receiver_id."""
    undeclared = screened.join(declared, ["reach_id", "receiver_id"], "left_anti").agg(F.count(F.lit(1)).alias("undeclared"))
    n = screened.agg(F.count_if(F.col("status") == "CLEAR").alias("clear"), F.count_if(F.col("status") == "REVIEW").alias("review"), F.count_if(F.col("status") != "NOT_CONNECTED").alias("connected"), F.count_if(F.col("barriers").isNotNull()).alias("barrier_conflict"))
    return n.crossJoin(undeclared)
