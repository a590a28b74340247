"""Masses, load events and collection sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import expr as X
from furrow.operators.nearest import nearest
from furrow.operators.order import summarise

c = F.col


def segment_mass(df: DataFrame, width: float, uniform: float | None = None) -> DataFrame:
    """mass_t of each segment (length_m) at a yield in t/ha, uniform or its own; others are rejected."""
    y = F.lit(uniform) if uniform is not None else c("yield_t_ha")
    ok = X.finite(y) & (y > 0)
    return df.withColumn("mass_t", F.when(ok, y * c("length_m") * width / 10000)).withColumn("reject_reason", F.when(~ok, "YIELD_MISSING_OR_NOT_POSITIVE"))


def load_events(segments: DataFrame, capacity: float, tol: float = 1e-8) -> DataFrame:
    """run_id, k, kind, segment_id, station_m, mass_t: a FULL event each time a run's mass reaches a multiple of the capacity,
    at its station in the segment (run_id, sequence, segment_id, mass_t, length_m) that reaches it, and what is left as
    PARTIAL at the end of the run's last segment. The multiples come from running sums, not from a loop. Order within a
    run: (sequence, segment_id), then mass."""
    w = Window.partitionBy("run_id").orderBy("sequence", "segment_id", "mass_t")
    s = segments.withColumn("m1", F.sum("mass_t").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("m0", c("m1") - c("mass_t"))
    k0, k1 = F.floor((c("m0") + tol) / capacity), F.floor((c("m1") + tol) / capacity)
    full = s.filter(k1 > k0).withColumn("k", F.explode(F.sequence(k0 + 1, k1)))
    station = F.least(c("length_m"), F.coalesce(F.try_divide(c("k") * capacity - c("m0"), c("mass_t")), F.lit(1.0)) * c("length_m"))
    full = full.select("run_id", "k", F.lit("FULL").alias("kind"), "segment_id", F.greatest(station, F.lit(0.0)).alias("station_m"), F.lit(float(capacity)).alias("mass_t"))
    last = s.groupBy("run_id").agg(F.max_by(F.struct("segment_id", "m1", "length_m"), F.struct("sequence", "segment_id", "m1")).alias("e")).select("run_id", "e.*")
    done = F.floor((c("m1") + tol) / capacity)
    part = last.withColumn("rest", c("m1") - done * capacity).filter(c("rest") > tol)
    part = part.select("run_id", (done + 1).alias("k"), F.lit("PARTIAL").alias("kind"), "segment_id", c("length_m").alias("station_m"), c("rest").alias("mass_t"))
    return full.unionByName(part)


def road_metrics(lines: DataFrame, removed: DataFrame, power: DataFrame) -> DataFrame:
    """Total, removed and allowed length of lines (line_id, length_m) given removed spans (line_id, lo, hi, merged); and
    lines that the power barrier touches, with their length inside it."""
    r = removed.groupBy("line_id").agg(F.sum(c("hi") - c("lo")).alias("removed_m"))
    p = power.groupBy("line_id").agg(F.sum(c("hi") - c("lo")).alias("power_m"))
    df = lines.join(r, "line_id", "left").join(p, "line_id", "left").fillna(0.0, ["removed_m"])
    return df.agg(F.sum("length_m").alias("original_m"), F.sum("removed_m").alias("removed_m"), (F.sum("length_m") - F.sum("removed_m")).alias("allowed_m"), F.count("power_m").alias("power_lines"), F.coalesce(F.sum("power_m"), F.lit(0.0)).alias("power_m"))


def candidate_eligibility(sites: DataFrame, hits: DataFrame) -> DataFrame:
    """Reasons against each site (site_id, capacity_t, penalty); eligible iff there is none. hits: site_id, kind."""
    h = hits.groupBy("site_id").agg(F.collect_set("kind").alias("kinds"))
    df = sites.join(h, "site_id", "left")
    has = lambda k: F.coalesce(F.array_contains("kinds", k), F.lit(False))
    why = F.array_compact(F.array(
        F.when(has("POWER_LINE"), "INTERSECTS_POWER_LINE_BARRIER").when(has("EXCLUSION"), "INTERSECTS_EXCLUSION"), F.when(c("capacity_t").isNull() | (c("capacity_t") <= 0), "CAPACITY_MISSING_OR_NOT_POSITIVE"), F.when(c("penalty") < 0, "PENALTY_NEGATIVE"),
    ))
    return df.withColumn("reasons", F.array_join(why, ",")).withColumn("eligible", F.size(why) == 0).drop("kinds")


def costs(demand: DataFrame, sites: DataFrame) -> DataFrame:
    """Distance of every demand (demand_id, x, y, mass_t) to every site of a site table that is known to be small
    (a decision's candidates, at most a few dozen)."""
    s = sites.select("site_id", c("x").alias("sx"), c("y").alias("sy"))
    return demand.crossJoin(s).select("demand_id", "mass_t", "site_id", X.distance(c("x"), c("y"), c("sx"), c("sy")).alias("dist"))


def assign_nearest(demand: DataFrame, sites: DataFrame, start: float = 50.0) -> DataFrame:
    """Each demand (demand_id, x, y, mass_t) with its nearest site, of equally near ones the least id; any number of
    either. Extra columns of the demand stay."""
    place = sites.select(c("site_id").alias("segment_id"), c("x").alias("x0"), c("y").alias("y0"), c("x").alias("x1"), c("y").alias("y1"))
    near = nearest(demand.select(c("demand_id").alias("point_id"), "x", "y"), place, start)
    near = near.select(c("point_id").alias("demand_id"), c("segment_id").alias("site_id"), c("gap").alias("dist"))
    return demand.drop("x", "y").join(near, "demand_id").withColumn("tonne_m", c("mass_t") * c("dist"))


def subsets(sites: DataFrame, k: int, most: int = 50_000) -> DataFrame:
    """subset_id (member ids joined), size, site_id: all subsets of up to k sites; an error if there are more than most."""
    one = sites.select(c("site_id").alias("last"), F.array("site_id").alias("members"))
    level, every = one, one
    for _ in range(k - 1):
        level = level.join(sites, sites["site_id"] > level["last"]).select(c("site_id").alias("last"), F.concat("members", F.array("site_id")).alias("members"))
        every = every.unionByName(level)
    if every.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} subsets")
    return every.select(F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("subset_id"), F.size("members").alias("size"), F.explode("members").alias("site_id"))


def by_demand(cost: DataFrame, subset: DataFrame) -> DataFrame:
    """A row for each demand and subset, with the least distance to its members (dist, null if none is reached).

    A demand's distances (to a decision's few candidate sites) become one map, and the subsets, of which subsets() makes a
    bounded number, are broadcast: the product of both is aggregated where it is made and never shuffled."""
    own = cost.groupBy("demand_id", "mass_t").agg(F.map_from_entries(F.collect_list(F.struct("site_id", "dist"))).alias("far"))
    few = subset.groupBy("subset_id").agg(F.first("size").alias("size"), F.collect_list("site_id").alias("members")) if "size" in subset.columns else subset.groupBy("subset_id").agg(F.collect_list("site_id").alias("members"))
    return own.crossJoin(F.broadcast(few)).withColumn("dist", F.array_min(F.transform("members", lambda m: F.try_element_at("far", m))))


def score_subsets(cost: DataFrame, subset: DataFrame, penalties: DataFrame) -> DataFrame:
    """subset_id, size, objective: mass times least distance over members, summed, plus the members' penalties.
    cost: demand_id, mass_t, site_id, dist."""
    moved = by_demand(cost, subset).groupBy("subset_id", "size").agg(F.sum(c("mass_t") * c("dist")).alias("moved"))
    fixed = subset.join(penalties, "site_id").groupBy("subset_id").agg(F.sum("penalty").alias("fixed"))
    return moved.join(fixed, "subset_id").select("subset_id", "size", (c("moved") + c("fixed")).alias("objective"))


def coverage_score(cost: DataFrame, subset: DataFrame, penalties: DataFrame, capacities: DataFrame) -> DataFrame:
    """Like score_subsets where some demands can't reach some sites (dist null): mass that reaches no member, and mass
    beyond the members' capacity, cost (20 x the largest distance + 1) each."""
    far = cost.agg((F.max("dist") * 20 + 1).alias("rate"))
    moved = F.sum(F.when(c("dist").isNotNull(), c("mass_t") * c("dist")).otherwise(0.0)).alias("moved")
    g = by_demand(cost, subset).groupBy("subset_id").agg(moved, F.sum(F.when(c("dist").isNull(), c("mass_t")).otherwise(0.0)).alias("lost"), F.sum("mass_t").alias("total"))
    fixed = subset.join(penalties, "site_id").join(capacities, "site_id").groupBy("subset_id").agg(F.sum("penalty").alias("fixed"), F.sum("capacity_t").alias("capacity"))
    df = g.join(fixed, "subset_id").crossJoin(far)
    short = F.greatest(c("total") - c("capacity"), F.lit(0.0))
    return df.select("subset_id", c("lost").alias("unreachable_t"), short.alias("shortfall_t"), (c("moved") + c("fixed") + c("rate") * (c("lost") + short)).alias("score"))


def feasibility(cost: DataFrame, subset: DataFrame, capacities: DataFrame) -> DataFrame:
    """Whether each subset reaches all demands and holds their mass."""
    g = by_demand(cost, subset).groupBy("subset_id").agg(F.sum("mass_t").alias("mass"), F.bool_and(c("dist").isNotNull()).alias("all_reached"))
    cap = subset.join(capacities, "site_id").groupBy("subset_id").agg(F.sum("capacity_t").alias("capacity"))
    return g.join(cap, "subset_id").select("subset_id", ((c("capacity") >= c("mass")) & c("all_reached")).alias("feasible"))


def regret(cost: DataFrame) -> DataFrame:
    """Second best minus best distance of each demand; infinite where only one site is reached."""
    two = F.slice(F.array_sort(F.collect_list("dist")), 1, 2)
    g = cost.filter("dist IS NOT NULL").groupBy("demand_id").agg(two.alias("d"))
    return g.select("demand_id", F.when(F.size("d") > 1, c("d")[1] - c("d")[0]).otherwise(float("inf")).alias("regret"))


def routing_metrics(assigned: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of all assigned demands (with kind FULL or PARTIAL): counts, mass, distances; and the use of each site."""
    full, part = (F.count_if(c("kind") == k) for k in ("FULL", "PARTIAL"))
    aggs = [F.count(F.lit(1)).alias("n"), full.alias("full_loads"), part.alias("partial_loads"), F.sum("mass_t").alias("mass_t"), F.sum("tonne_m").alias("tonne_m"), F.max("dist").alias("max_dist"), F.try_divide(F.sum("tonne_m"), F.sum("mass_t")).alias("mean_dist")]
    total = summarise(assigned, [], aggs, {"p50": ("dist", 0.5), "p95": ("dist", 0.95)})
    use = assigned.groupBy("site_id").agg(F.count(F.lit(1)).alias("events"), full.alias("full_loads"), part.alias("partial_loads"), F.sum("mass_t").alias("mass_t"))
    use = sites.select("site_id", "capacity_t").join(use, "site_id", "left").fillna(0, ["events", "full_loads", "partial_loads", "mass_t"])
    return total, use.withColumn("utilisation", F.try_divide(c("mass_t"), c("capacity_t")))
