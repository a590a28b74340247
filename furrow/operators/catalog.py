"""Parameter catalogs, readiness, presets, selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.copies import blocks, member_pairs, packed

c = F.col


def issue(df: DataFrame, rule: str, key: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), c(key).cast("string").alias("key"))


def ownership_issues(params: DataFrame, owners: DataFrame) -> DataFrame:
    """params: parameter_id, external; owners: package_id, parameter_id. Every external parameter has one owner."""
    dup = owners.groupBy("parameter_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ext = params.filter("external").select("parameter_id")
    return reduce(DataFrame.unionAll, [
        issue(owners.join(params, "parameter_id", "left_anti"), "UNKNOWN_PARAMETER", "parameter_id"), issue(dup, "DUPLICATE_OWNER", "parameter_id"), issue(ext.join(owners, "parameter_id", "left_anti"), "MISSING_OWNER", "parameter_id"),
        issue(owners.select("parameter_id").distinct().join(params.filter("NOT external").select("parameter_id"), "parameter_id"), "INTERNAL_OWNED", "parameter_id"),
    ]).distinct()


#: Statuses that satisfy a level.
ACCEPTED = {"E0": ("VERIFIED", "SCREENING", "PARTIAL", "NOT_APPLICABLE"), "OTHER": ("VERIFIED", "NOT_APPLICABLE")}


def delivery_readiness(packages: DataFrame, inventory: DataFrame) -> DataFrame:
    """packages: package_id, levels (array); inventory: package_id, status. Per level: required, blockers, ready."""
    need = packages.select("package_id", F.explode("levels").alias("level")).join(inventory, "package_id", "left")
    ok = F.when(c("level") == "E0", c("status").isin(*ACCEPTED["E0"])).otherwise(c("status").isin(*ACCEPTED["OTHER"]))
    g = need.withColumn("ok", F.coalesce(ok, F.lit(False))).groupBy("level").agg(F.count(F.lit(1)).alias("required"), F.array_join(F.array_sort(F.collect_list(F.when(~c("ok"), c("package_id").cast("string")))), ",").alias("blockers"))
    return g.withColumn("ready", c("blockers") == "")


def scenario_readiness(direct: DataFrame, capabilities: DataFrame, needs: DataFrame, caps: DataFrame, inventory: DataFrame) -> DataFrame:
    """direct: scenario, package_id; capabilities: scenario, a; needs: all (a, b) that a requires, transitively; caps: a,
    package_id, implemented. Evidence blockers, and capabilities that aren't implemented."""
    every = capabilities.unionByName(capabilities.join(needs, "a").select("scenario", c("b").alias("a"))).distinct()
    pk = direct.unionByName(every.join(caps, "a").select("scenario", "package_id")).distinct()
    ev = pk.join(inventory.filter(c("status") == "VERIFIED"), "package_id", "left_anti").groupBy("scenario").agg(F.count(F.lit(1)).alias("evidence_blockers"))
    im = every.join(caps.filter("implemented").select("a").distinct(), "a", "left_anti").groupBy("scenario").agg(F.count(F.lit(1)).alias("implementation_blockers"))
    out = pk.groupBy("scenario").agg(F.count(F.lit(1)).alias("packages")).join(ev, "scenario", "left").join(im, "scenario", "left").fillna(0)
    return out.withColumn("ready", (c("evidence_blockers") == 0) & (c("implementation_blockers") == 0))


def inventory_summary(inventory: DataFrame) -> DataFrame:
    """kind, value, n: by status, and by gap class other than NONE."""
    a = inventory.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.lit("status").alias("kind"), c("status").alias("value"), "n")
    b = inventory.filter(c("gap_class") != "NONE").groupBy("gap_class").agg(F.count(F.lit(1)).alias("n")).select(F.lit("gap").alias("kind"), c("gap_class").alias("value"), "n")
    return a.unionByName(b)


def capability_counts(inventory: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Per capability (package_id, capability): packages, verified ones, and those that lack (MISSING or not in the inventory)."""
    df = capabilities.join(inventory, "package_id", "left")
    lack = c("status").isNull() | (c("status") == "MISSING")
    return df.groupBy("capability").agg(F.count(F.lit(1)).alias("packages"), F.count_if(c("status") == "VERIFIED").alias("verified"), F.count_if(lack).alias("lacking"))


def unresolved_parameters(params: DataFrame, resolved: DataFrame) -> DataFrame:
    """parameter_id of the parameters without a value."""
    return params.select("parameter_id").join(resolved.filter("value IS NOT NULL").select("parameter_id"), "parameter_id", "left_anti")


def option_coverage(matrix: DataFrame) -> DataFrame:
    """Of an option matrix: parameters, those with options, with a default, with several options, and per behaviour."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    return matrix.agg(
        F.count(F.lit(1)).alias("parameters"), n(c("options") > 0, "with_options"), n(c("default_model").isNotNull(), "with_default"), n(c("options") > 1, "with_choice"), n(c("behaviour") == "FAIL_CLOSED", "fail_closed"), n(c("behaviour") == "E0_VALUE", "e0_value"),
        n(c("behaviour") == "REFERENCE", "reference"), n(~c("behaviour").isin("FAIL_CLOSED", "E0_VALUE", "REFERENCE"), "by_policy"),
    )


def top_blockers(df: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("level").orderBy("position", "package_id")
    return df.withColumn("rank", F.row_number().over(w)).filter(c("rank") <= n)


def option_matrix(params: DataFrame, options: DataFrame) -> DataFrame:
    """params: parameter_id, policy, safety; options: parameter_id, model_id, is_default, selectable. One row a parameter:
    options, default, behaviour."""
    o = options.filter("selectable").groupBy("parameter_id").agg(F.count(F.lit(1)).alias("options"), F.min(F.when(c("is_default"), c("model_id"))).alias("default_model"))
    df = params.join(o, "parameter_id", "left").fillna(0, ["options"])
    how = F.when(c("safety") & c("default_model").isNull(), "FAIL_CLOSED").when(c("policy") == "E0", "E0_VALUE").when(c("options") > 0, "REFERENCE").otherwise(c("policy"))
    return df.withColumn("behaviour", how)


def resolve_presets(params: DataFrame, custom: DataFrame, candidates: DataFrame) -> DataFrame:
    """Precedence for each parameter: a custom value; a direct value (DIRECT); one single reference (REFERENCE); assembly;
    lookup; template; else its policy. candidates: parameter_id, mode, value, source, actions (array: what must be confirmed
    locally), ceiling. Sources and actions are the union of all candidates', and one candidate that may not release a project
    keeps its parameter from it."""
    n = lambda m: F.count_if(c("mode") == m).alias(m)
    modes = ("DIRECT", "REFERENCE", "ASSEMBLY", "LOOKUP", "TEMPLATE")
    pick = lambda m: F.min(F.when(c("mode") == m, c("value"))).alias(f"v_{m}")
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    none = F.array().cast("array<string>")
    g = candidates.groupBy("parameter_id").agg(*[n(m) for m in modes], pick("DIRECT"), pick("REFERENCE"), joined(F.collect_set("source")).alias("sources"), joined(F.flatten(F.collect_set(F.coalesce("actions", none)))).alias("required_actions"), F.max(c("ceiling") == "NO_PROJECT_RELEASE").alias("held"))
    df = params.join(custom.withColumnRenamed("value", "custom_value"), "parameter_id", "left").join(g, "parameter_id", "left").fillna(0, list(modes))
    mode = F.when(c("custom_value").isNotNull(), "CUSTOM").when(c("DIRECT") > 0, "DIRECT").when(c("REFERENCE") == 1, "REFERENCE").when(c("ASSEMBLY") > 0, "ASSEMBLY").when(c("LOOKUP") > 0, "LOOKUP").when(c("TEMPLATE") > 0, "TEMPLATE").otherwise("POLICY")
    value = F.when(mode == "CUSTOM", c("custom_value")).when(mode == "DIRECT", c("v_DIRECT")).when(mode == "REFERENCE", c("v_REFERENCE"))
    ceiling = F.when(F.coalesce("held", F.lit(False)), "NO_PROJECT_RELEASE").otherwise("E0_TRIAGEM")  # fixed values
    return df.select("parameter_id", mode.alias("mode"), value.alias("value"), "sources", F.coalesce("required_actions", F.lit("")).alias("required_actions"), ceiling.alias("release_ceiling"))


def value_conflicts(df: DataFrame) -> DataFrame:
    """Parameters (parameter_id, json) whose direct values differ. Objects merge if they agree on common keys."""
    obj = c("json").startswith("{")
    plain = df.filter(~obj).groupBy("parameter_id").agg(F.countDistinct("json").alias("n")).filter("n > 1").select("parameter_id", F.lit("VALUES_DIFFER").alias("conflict"))
    keys = df.filter(obj).select("parameter_id", F.explode(F.from_json("json", "map<string,string>"))).groupBy("parameter_id", "key").agg(F.countDistinct("value").alias("n")).filter("n > 1")
    return plain.unionByName(keys.select("parameter_id", F.concat(F.lit("KEY_DIFFERS:"), "key").alias("conflict")))


def applicability(models: DataFrame, contexts: DataFrame, regions: DataFrame) -> DataFrame:
    """model_id, context_id, how, wildcards. models: model_id, countries, crops, jurisdictions (arrays; ALL and ANY are
    wildcards, jurisdictions that end in WITH_JUSTIFICATION are conditional); contexts: context_id, country, crop, state,
    justification; regions: state, tag.

    how: EXACT_OR_NATIONAL; or, where only a conditional jurisdiction fits, JUSTIFIED_EXTRAPOLATION if the context gives a
    justification, NEEDS_JUSTIFICATION if not. Models with the same lists are a class, and so are contexts of the same place and
    crop; a class is named by its smallest id. Each class of contexts yields its keys with every subset of country, crop and
    jurisdiction replaced by the wildcard (a state also by its regions' tags), and classes of models meet them by equal key.
    What holds of two classes is told of all their members, whose pairs are shuffled no further: a wildcard model meets every
    context, which is the answer asked for. wildcards: how many parts of the best match are wildcards."""
    wild, conditional = F.lit("*"), F.lit("*CONDITIONAL")
    folded = lambda x: F.when(x.isin("ALL", "ANY"), wild).when(x.endswith("WITH_JUSTIFICATION"), conditional).otherwise(x)
    lists, place = ("countries", "crops", "jurisdictions"), ("country", "crop", "state")

    def classes(df: DataFrame, key: str, own: Column, *more: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
        """one, own.* of each class (a row for each of the rows that its members have); its members; and the sizes of its parts by more."""
        kinds = df.groupBy(c(key).alias("member")).agg(F.array_sort(F.collect_set(own)).alias("kind"), *more)
        sizes = kinds.groupBy(*[x for x in kinds.columns if x != "member"]).agg(F.min("member").alias("least"), F.count(F.lit(1)).alias("n"))
        sizes = sizes.withColumn("one", F.min("least").over(Window.partitionBy("kind"))).drop("least").checkpoint()
        return sizes.select("one", "kind").distinct().select("one", F.explode("kind").alias("k")).select("one", "k.*"), kinds, sizes

    opened, all_models, model_sizes = classes(models, "model_id", F.struct(*[F.array_sort(F.array_distinct(F.transform(x, folded))).alias(x) for x in lists]))
    ctx, all_contexts, context_sizes = classes(contexts, "context_id", F.struct(*place), F.max(F.coalesce(F.length(F.trim("justification")) > 0, F.lit(False))).alias("given"))
    for name in lists:
        opened = opened.select(*[x for x in opened.columns if x != name], F.explode(name).alias(name))
    tags = regions.groupBy("state").agg(F.collect_set("tag").alias("tags"))
    ctx = ctx.join(tags, "state", "left")
    places = F.array_union(F.array("state", F.concat_ws("-", "country", "state"), wild, conditional), F.coalesce("tags", F.array().cast("array<string>")))
    ctx = ctx.select(c("one").alias("c_one"), F.explode(F.array("country", wild)).alias("countries"), "crop", places.alias("places"))
    ctx = ctx.select("c_one", "countries", F.explode(F.array("crop", wild)).alias("crops"), "places").withColumn("jurisdictions", F.explode("places")).drop("places")
    met = opened.withColumnRenamed("one", "m_one").join(ctx, [*lists])
    stars = sum(((c(x) == wild).cast("int") for x in lists), F.lit(0))
    only = (c("jurisdictions") == conditional).alias("conditional")
    best = met.groupBy("m_one", "c_one").agg(F.min(F.struct(only, stars.alias("wildcards"))).alias("b")).select("m_one", "c_one", "b.*")
    total = [x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for x in (model_sizes, context_sizes)]
    sides = blocks(models, *total)
    at_m, held_m = packed(all_models, ["kind"], model_sizes, sides[0], total[0])
    at_c, held_c = packed(all_contexts, ["kind", "given"], context_sizes, sides[1], total[1])
    named = lambda at, sizes, by, p: at.join(sizes, by).select(c("one").alias(f"{p}_one"), c("at").alias(f"{'a' if p == 'm' else 'b'}_at"), *by[1:])
    how = F.when(~c("conditional"), "EXACT_OR_NATIONAL").when(c("given"), "JUSTIFIED_EXTRAPOLATION").otherwise("NEEDS_JUSTIFICATION")
    near = best.join(named(at_m, model_sizes, ["kind"], "m"), "m_one").join(named(at_c, context_sizes, ["kind", "given"], "c"), "c_one").select(how.alias("how"), "wildcards", "a_at", "b_at")
    return member_pairs(near, held_m, held_c, sides, [c("a").alias("model_id"), c("b").alias("context_id"), "how", "wildcards"], few=True)


def compile_request(base: DataFrame, resolved: DataFrame) -> DataFrame:
    """Base values win; a preset fills what is missing unless it is safety-critical or no E0 value."""
    df = base.select("parameter_id", c("value").alias("base_value")).join(resolved.select("parameter_id", c("value").alias("preset"), "safety", "e0"), "parameter_id", "full")
    how = (
        F.when(c("base_value").isNotNull() & c("preset").isNull(), "BASE_WITHOUT_PRESET").when(c("base_value") == c("preset"), "BASE_MATCHES_PRESET").when(c("base_value").isNotNull(), "BASE_OVERRIDES_PRESET")
        .when(c("preset").isNull(), "UNRESOLVED").when(~c("safety") & c("e0"), "MATERIALISED").otherwise("WITHHELD")
    )
    return df.withColumn("outcome", how).withColumn("value", F.coalesce("base_value", F.when(c("outcome") == "MATERIALISED", c("preset")))).select("parameter_id", "outcome", "value")


def apply_overrides(values: DataFrame, overrides: DataFrame) -> DataFrame:
    """Approved overrides (parameter_id, seq, value, status), the last of each parameter wins; one without a base is an error row."""
    last = overrides.filter(c("status") == "APPROVED").groupBy("parameter_id").agg(F.max_by("value", "seq").alias("override"), F.count(F.lit(1)).alias("applied"))
    df = values.withColumnRenamed("value", "previous").join(last, "parameter_id", "full")
    return df.select("parameter_id", "previous", F.when(c("previous").isNotNull(), F.coalesce("override", "previous")).alias("resolved"), F.coalesce("applied", F.lit(0)).alias("applied"), F.when(c("previous").isNull(), "OVERRIDE_WITHOUT_BASE").alias("error"))


def product_readiness(assets: DataFrame, products: DataFrame, roles: DataFrame) -> DataFrame:
    """assets: project_id, role, verified; products: product_id, requires (product or null); roles: product_id, role.
    Per project and product: missing roles, blocked dependency, available."""
    have = assets.filter("verified").select("project_id", "role").distinct()
    proj = assets.select("project_id").distinct()
    need = proj.crossJoin(roles)  # one row for each thing a project needs: the answer itself
    lack = need.join(have, ["project_id", "role"], "left_anti").groupBy("project_id", "product_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("missing"))
    df = proj.crossJoin(products).join(lack, ["project_id", "product_id"], "left").fillna("", ["missing"])
    dep = df.select("project_id", c("product_id").alias("requires"), (c("missing") != "").alias("dep_blocked"))
    df = df.join(dep, ["project_id", "requires"], "left")
    return df.select("project_id", "product_id", "missing", F.coalesce("dep_blocked", F.lit(False)).alias("dependency_blocked"), ((c("missing") == "") & ~F.coalesce("dep_blocked", F.lit(False))).alias("available"))


def selection_blocker(df: DataFrame) -> DataFrame:
    """First reason to refuse a scenario, else SELECTABLE."""
    why = F.when(c("run_status") != "SUCCEEDED", "RUN_NOT_SUCCEEDED").when(c("kind").startswith("CONCEPT"), "CONCEPT_NOT_SELECTABLE").when(c("blockers").contains("RADIUS"), "MINIMUM_RADIUS").when(~c("eligible"), "NOT_ELIGIBLE").otherwise("SELECTABLE")
    return df.withColumn("verdict", why)


def selection_history(events: DataFrame) -> DataFrame:
    """events: run_id, selection_id, scenario_id, at. Each selection with when and by what it was superseded."""
    w = Window.partitionBy("run_id").orderBy("at", "selection_id")
    df = events.withColumn("closed_at", F.lead("at").over(w)).withColumn("closed_by", F.lead("selection_id").over(w)).withColumn("position", F.row_number().over(w))
    return df.withColumn("active", c("closed_at").isNull())


def latest_asset(assets: DataFrame, first_role: str, second_role: str) -> DataFrame:
    """Newest asset of each project by (created_at, id), of the preferred role if there is one, else of the other."""
    best = lambda r: F.max(F.when(c("role") == r, F.struct("created_at", "asset_id"))).alias(r)
    g = assets.groupBy("project_id").agg(best(first_role), best(second_role))
    return g.select("project_id", F.coalesce(c(first_role), c(second_role))["asset_id"].alias("asset_id"), F.when(c(first_role).isNotNull(), first_role).when(c(second_role).isNotNull(), second_role).alias("role"))


def layer_status(artifacts: DataFrame, runs: DataFrame) -> DataFrame:
    df = artifacts.join(runs, "run_id", "left")
    why = F.when(F.coalesce(c("run_status"), F.lit("")) != "SUCCEEDED", "RUN_NOT_SUCCEEDED").when(c("bounds").isNull(), "NO_SPATIAL_METADATA").when(~c("format").isin("geojson", "cog"), "FORMAT_NOT_SERVED")
    return df.select("artifact_id", F.when(why.isNull(), "READY").otherwise("UNAVAILABLE").alias("status"), why.alias("reason"))


def operation_limit(values: DataFrame, scope: DataFrame, how: str = "max") -> DataFrame:
    """values: project_id, limits (map operation to value); only operations in the project's scope count."""
    df = values.select("project_id", F.explode_outer("limits").alias("operation", "value")).join(scope, ["project_id", "operation"], "left_semi")
    g = df.groupBy("project_id").agg((F.max if how == "max" else F.min)("value").alias("limit"))
    return values.select("project_id").join(g, "project_id", "left")


def limit_conflicts(legacy: DataFrame, new: DataFrame, scope: DataFrame, consumed: DataFrame) -> DataFrame:
    """project_id, key, rule. legacy: project_id, value (one limit for all operations); new: project_id, limits (map operation
    to value); scope: project_id, operation; consumed: project_id, parameter. A legacy limit must not differ from the new
    one of an operation in scope, and a registered operation that nothing consumes is told."""
    ops = new.select("project_id", F.explode("limits").alias("operation", "value"))
    both = ops.join(scope, ["project_id", "operation"], "left_semi").join(legacy.select("project_id", c("value").alias("old")), "project_id")
    differ = both.filter("value != old").select("project_id", c("operation").alias("key"), F.lit("LEGACY_AND_NEW_CONFLICT").alias("rule"))
    unused = ops.join(consumed.select("project_id", c("parameter").alias("operation")), ["project_id", "operation"], "left_anti").select("project_id", c("operation").alias("key"), F.lit("REGISTERED_BUT_UNUSED").alias("rule"))
    return differ.unionByName(unused)


def resolution_gate(df: DataFrame) -> DataFrame:
    """native, output, row_spacing, source, ground_filtered, verified: whether the terrain is fine enough."""
    eff = F.when(c("native").isNotNull() & c("output").isNotNull(), F.greatest("native", "output"))
    why = F.when(~c("verified") | eff.isNull(), "RESOLUTION_UNVERIFIED").when(eff > c("row_spacing") + 1e-9, "TOO_COARSE").when((c("source") == "POINTS") & ~c("ground_filtered"), "GROUND_FILTER_REQUIRED").otherwise("PASS")
    return df.withColumn("effective", eff).withColumn("upsampled", F.coalesce(c("output") < c("native"), F.lit(False))).withColumn("gate", why)


def codes_when(*pairs: tuple[str, Column]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(cond, code) for code, cond in pairs])), ",")
