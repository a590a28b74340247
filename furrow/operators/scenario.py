"""Candidate scoring, gates, selections, and comparison of scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
#: Weights of the composite losses.
CONSERVATION = {"cross_n": 0.45, "grade_n": 0.25, "singular_n": 0.20, "spacing_n": 0.10}
HARVEST = {"grade_n": 0.55, "cross_n": 0.25, "spacing_n": 0.20}
BALANCED = {"loss_conservation": 0.40, "loss_harvest": 0.25, "loss_performance": 0.25, "loss_spacing": 0.10}


def normalise(df: DataFrame, by: list[str], col: str, reverse: bool = False, out: str | None = None) -> DataFrame:
    """(v - p05) / (p95 - p05) within each group, cut to 0..1; 0 where the spread is nothing. The percentiles are one
    aggregation joined back, so no group is held in one window."""
    q = df.groupBy(*by).agg(F.percentile(col, [0.05, 0.95]).alias("__q"))
    lo, hi = c("__q")[0], c("__q")[1]
    v = F.when(hi <= lo + 1e-9, 0.0).otherwise(F.least(F.greatest((c(col) - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)))
    v = F.when(hi <= lo + 1e-9, 0.0).otherwise(1 - v) if reverse else v
    return df.join(q, by).withColumn(out or f"{col}_n", v).drop("__q")


def weighted(weights: dict[str, float]) -> Column:
    return sum((c(k) * w for k, w in weights.items()), F.lit(0.0))


def add_losses(df: DataFrame, by: list[str]) -> DataFrame:
    """Losses of candidates with grade, cross, singular, spacing, length: 0 is best within the group."""
    for col, rev in (("grade", False), ("cross", False), ("singular", False), ("spacing", False), ("length", True)):
        df = normalise(df, by, col, rev)
    df = df.withColumn("loss_conservation", weighted(CONSERVATION)).withColumn("loss_harvest", weighted(HARVEST)).withColumn("loss_performance", c("length_n")).withColumn("loss_spacing", c("spacing_n"))
    return df.withColumn("loss_grade", F.greatest("grade_n", "cross_n")).withColumn("loss_balanced", weighted(BALANCED))


def gate(df: DataFrame, by: list[str], most_singular: float = 0.5, most_spacing: float = 35.0, fall_back: bool = True, most_grade: float | None = None, most_cross: float | None = None) -> DataFrame:
    """Rows under the limits (singular, spacing; grade_max and cross_max where a limit is given). A group without any falls
    back to all its rows; without fall_back that is an error that names such a group."""
    ok = (c("singular") <= most_singular) & (c("spacing") <= most_spacing)
    for name, most in (("grade_max", most_grade), ("cross_max", most_cross)):
        ok = ok & (c(name) <= most) if most is not None else ok
    ok = F.coalesce(ok, F.lit(False))
    any_ok = df.groupBy(*by).agg(F.max(ok).alias("__any"))
    if not fall_back and (none := any_ok.filter("NOT __any").first()):
        raise ValueError(f"no feasible candidate in {', '.join(f'{n}={none[n]}' for n in by)}")
    out = df.join(any_ok, by).withColumn("gated", ok)
    return out.filter(c("gated") | ~c("__any")).drop("__any")


def select_candidate(df: DataFrame, by: list[str], loss: str, alert: float | None = None) -> DataFrame:
    """The least loss of each group. Preferences (lambda 0, then within the alert) narrow a group only if rows are left."""
    for want in [c("lam") == 0] + ([c("grade") <= alert] if alert is not None else []):
        have = df.groupBy(*by).agg(F.max(want).alias("__any"))
        df = df.join(have, by).filter(want | ~c("__any")).drop("__any")
    best = df.groupBy(*by).agg(F.min(F.struct(loss, "theta", "lam")).alias("b"))
    return best.select(*by, c(f"b.{loss}").alias("loss"), "b.theta", "b.lam")


def select_shared_axis(df: DataFrame, weight: float = 0.5) -> DataFrame:
    """One axis for all groups: mean and worst loss over groups at lambda 0, least weighted score, set on every group."""
    axes = df.filter("lam = 0").groupBy("theta").agg(F.avg("loss_balanced").alias("mean_loss"), F.max("loss_balanced").alias("max_loss"), F.countDistinct("field").alias("fields"))
    all_fields = df.agg(F.countDistinct("field").alias("fields"))
    best = axes.join(all_fields, "fields").agg(F.min(F.struct((c("mean_loss") * weight + c("max_loss") * (1 - weight)).alias("score"), "theta")).alias("b"))
    return df.select("field").distinct().crossJoin(best.select("b.score", "b.theta"))


def aggregate_lines(lines: DataFrame, fields: DataFrame) -> DataFrame:
    """Lines (scenario, field, row_id, length, grade, reversals) per field and scenario. fields: field, area_ha, row_m."""
    n, long = F.count(F.lit(1)), F.sum("length")
    q = F.percentile("length", [0.1, 0.5, 0.9])
    out = lines.groupBy("scenario", "field").agg(
        n.alias("segments"), F.countDistinct("row_id").alias("rows"), long.alias("length_m"), F.avg("length").alias("mean_m"), q.alias("q"), (F.count_if(c("length") < 50) / n).alias("short_share"), (F.count_if(c("length") > 200) / n).alias("long_share"),
        (F.sum(c("grade") * c("length")) / long).alias("weighted_grade"), (F.sum("reversals") * 1000 / long).alias("reversals_km"),
    )
    out = out.join(fields, "field").withColumn("fragmentation", c("segments") - c("rows")).withColumn("coverage", c("length_m") * c("row_m") / (c("area_ha") * 1e4)).withColumn("efficiency", c("length_m") / (c("length_m") + c("segments") * 12))
    return out.select("*", c("q")[0].alias("p10"), c("q")[1].alias("p50"), c("q")[2].alias("p90")).drop("q")


def scenario_scores(df: DataFrame, w_cons: float = 1.0, w_harv: float = 1.0, w_perf: float = 3.0) -> DataFrame:
    """Fields (run_id, scenario_id, area, km, shots, losses, violations, codes) rolled up by scenario: area-weighted
    scores, the comparison score, codes, eligibility, and the one recommended per run (best eligible, ties by id)."""
    mean = lambda x: F.sum((1 - c(x)) * c("area")) / F.sum("area") * 100
    codes = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.split(F.coalesce("codes", F.lit("")), ","), lambda x: x != "")))))
    g = df.groupBy("run_id", "scenario_id").agg(F.sum("area").alias("area"), (F.sum("km") * 1000 / F.sum("shots")).alias("mean_shot_m"), mean("loss_cons").alias("conservation"), mean("loss_harv").alias("harvest"), mean("loss_perf").alias("performance"), F.sum("violations").alias("violations"), F.array_join(codes, ",").alias("codes"))
    total = w_cons + w_harv + w_perf
    g = g.withColumn("comparison", (c("conservation") * w_cons + c("harvest") * w_harv + c("performance") * w_perf) / total).withColumn("eligible", (c("violations") == 0) & (c("codes") == ""))
    best = g.filter("eligible").groupBy("run_id").agg(F.min(F.struct((-c("comparison")).alias("s"), "scenario_id")).alias("b")).select("run_id", c("b.scenario_id").alias("best_id"))
    return g.join(best, "run_id", "left").withColumn("recommended", F.coalesce(c("scenario_id") == c("best_id"), F.lit(False))).drop("best_id")


def scenario_report(df: DataFrame) -> DataFrame:
    """Weighted means over rows that have a number; status from the fields' flags (null: not evaluated)."""
    num = c("value").isNotNull() & ~F.isnan("value")
    g = df.groupBy("scenario_id").agg(
        (F.sum(F.when(num, c("value") * c("area"))) / F.sum(F.when(num, c("area")))).alias("mean"), F.count_if(num).alias("numeric"), F.count(F.lit(1)).alias("n"), F.count_if(c("flag").isNotNull()).alias("known"), F.count_if("flag").alias("ok"),
    )
    return g.withColumn("status", F.when(c("known") == 0, "NOT_EVALUATED").when(c("ok") == c("n"), "ELIGIBLE").when(c("ok") > 0, "PARTIAL").otherwise("NOT_ELIGIBLE")).drop("known", "ok")


def family_scores(df: DataFrame) -> DataFrame:
    """Blocks (candidate_id, field, passed, n_rows, length_m, spacing_error, radius) per candidate."""
    n = F.count(F.lit(1))
    g = df.groupBy("candidate_id").agg(
        n.alias("blocks"), F.count_if("passed").alias("passes"), F.sum(F.when(c("passed"), c("n_rows"))).alias("pass_rows"), (F.sum(F.when(c("passed"), c("length_m"))) / 1000).alias("pass_km"), (F.sum(F.when(~c("passed"), c("length_m"))) / 1000).alias("diagnostic_km"),
        F.countDistinct("field").alias("fields"), F.avg("spacing_error").alias("mean_error"), F.min("radius").alias("min_radius"),
    )
    return g.withColumn("status", F.when(c("passes") == c("blocks"), "PASS").when(c("passes") > 0, "PARTIAL").otherwise("NONE"))


def concept_summary(candidates: DataFrame, blocked: DataFrame) -> DataFrame:
    """Candidates and blocked variants in one table, none selectable; and totals by kind."""
    rows = candidates.select("concept_id", F.lit("CANDIDATE").alias("kind"), "axes", "strips").unionByName(blocked.select("concept_id", F.lit("BLOCKED").alias("kind"), "axes", "strips"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("concepts"), F.sum("axes").alias("axes"), F.sum("strips").alias("strips")).withColumn("selectable", F.lit(False)).withColumn("status", F.lit("SCREENING_NOT_SELECTABLE"))


def trial_key() -> Column:
    """Order of passing trials: unbounded radius first, then large radius, small outside share, error, distance from full coverage, offset."""
    radius = F.coalesce(c("radius"), F.lit(float("inf")))
    return F.struct((-radius).alias("r"), c("outside"), c("error"), F.abs(c("coverage") - 1).alias("dev"), c("fraction"))


def select_trial(df: DataFrame, by: list[str]) -> DataFrame:
    """The best passing trial of each group; without one the lowest offset, as diagnostic only."""
    ok = c("status") == "PASS"
    g = df.groupBy(*by).agg(F.min(F.when(ok, trial_key())).alias("p"), F.min("fraction").alias("f"), F.count_if(ok).alias("passing"))
    return g.select(*by, F.coalesce("p.fraction", "f").alias("fraction"), F.when(c("passing") > 0, "SELECTED").otherwise("DIAGNOSTIC_ONLY").alias("role"), "passing")


def invariant_blockers(trials: DataFrame, blockers: DataFrame) -> DataFrame:
    """Trials of groups without a blocker that no trial can change. blockers: group_id, code, invariant."""
    return trials.join(blockers.filter("invariant").select("group_id").distinct(), "group_id", "left_anti")


def best_metric(df: DataFrame, metric: str, prefer: str = "min") -> DataFrame:
    """Marks of the best rows in each comparison, only if two or more rows share project, run, request and field set."""
    basis = F.sha2(F.concat_ws("|", "project_id", "run_id", "request_sha", F.array_join(F.array_sort(F.split("fields", ",")), ",")), 256)
    df = df.withColumn("__basis", F.when(c("request_sha").isNotNull(), basis))
    best = F.min(metric) if prefer == "min" else F.max(metric)
    g = df.groupBy("comparison_id").agg(best.alias("__best"), F.countDistinct("__basis").alias("__bases"), F.count("__basis").alias("__known"), F.count(F.lit(1)).alias("__n"))
    ok = (c("__bases") == 1) & (c("__known") == c("__n")) & (c("__n") >= 2)
    return df.join(g, "comparison_id").withColumn("best", F.coalesce(ok & (c(metric) == c("__best")), F.lit(False))).drop("__basis", "__best", "__bases", "__known", "__n")


def hydraulic_precheck(lines: DataFrame, params: DataFrame, required: list[str]) -> DataFrame:
    """Per group: which required inputs are missing, length-weighted adverse share, grade percentiles and codes.
    params: group_id, name, value."""
    have = params.filter("value IS NOT NULL").groupBy("group_id").agg(F.collect_set("name").alias("have"))
    g = lines.groupBy("group_id").agg((F.sum(F.when(c("adverse"), c("length")).otherwise(0.0)) / F.sum("length")).alias("adverse_share"), F.percentile("grade", 0.95).alias("grade_p95"), F.max("grade").alias("grade_max"))
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), F.coalesce("have", F.array().cast("array<string>")))
    g = g.join(have, "group_id", "left").withColumn("missing", F.array_join(F.array_sort(missing), ","))
    codes = F.array_compact(F.array(F.when(c("missing") != "", "HYDRAULIC_INPUT_MISSING"), F.when(c("adverse_share") > 0.25, "ADVERSE_GRADE_SHARE")))
    return g.withColumn("blockers", F.array_join(codes, ",")).drop("have")


def interval_summary(df: DataFrame) -> DataFrame:
    """Per vertical interval: candidates, axes, km, fragmentation, median of medians, retained length percent."""
    return df.groupBy("interval").agg(
        F.count(F.lit(1)).alias("candidates"), F.sum("axes").alias("axes"), F.sum("km").alias("km"), F.try_divide(F.sum("segments"), F.sum("n_rows")).alias("fragmentation"), F.median("p50").alias("median_p50"),
        (F.try_divide(F.sum("kept_m"), F.sum("base_m")) * 100).alias("retained_percent"), F.sum("split_rows").alias("split_rows"),
    )


def candidate_ratios(df: DataFrame, key: str) -> DataFrame:
    """Per candidate the ratios of interval_summary: fragmentation, retained length and split source rows in percent; null
    where there is nothing to compare with."""
    return df.select(key, F.try_divide(c("segments"), c("n_rows")).alias("fragmentation"), (F.try_divide(c("kept_m"), c("base_m")) * 100).alias("retained_percent"), (F.try_divide(c("split_rows"), c("n_rows")) * 100).alias("split_percent"))


def shortlist(df: DataFrame, n: int = 3) -> DataFrame:
    """The first n rows of each run, eligible ones first, then by score."""
    w = Window.partitionBy("run_id").orderBy(c("eligible").desc(), c("score").desc(), "scenario_id")
    return df.withColumn("rank", F.row_number().over(w)).filter(c("rank") <= n)


def portfolio(projects: DataFrame) -> DataFrame:
    return projects.agg(F.count_if("active").alias("active_projects"), F.sum(F.when(c("active"), c("area_ha"))).alias("area_ha"), F.sum("runs").alias("runs"))
