"""What went wrong on larger tables, on the smallest tables that show it."""

import re

import pytest
from pyspark.sql import functions as F

from furrow.functions import expr as X
from furrow.operators import catalog as C
from furrow.operators import geometry as G
from furrow.operators import graph as A
from furrow.operators import grid as GR
from furrow.operators import hydrology as H
from furrow.operators import quality as Q
from furrow.plans import geometry as P
from furrow.plans.feeds import FEEDS, feed


def test_nodes_of_far_streets_have_no_thousands_marks(spark):
    segs = spark.createDataFrame([(1, 0.0, 13300.0, 20.0, 13300.0)], "segment_id int, x0 double, y0 double, x1 double, y1 double")
    got = A.build_edges(segs, spark.createDataFrame([], "segment_id int, station double")).collect()
    assert [tuple(r) for r in got] == [("0.000,13300.000", "20.000,13300.000", 20.0)]


def test_edges_run_past_the_last_row(spark, tmp_path):
    parts = [(1_200_003, "Brand#11", 1), (7, "Brand#11", 2)]
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {(r["line_id"], r["which"]): r["kind"] for r in P.ge15(spark, str(tmp_path)).collect()}
    assert got == {(k, w): "HEADLAND_WORK_EDGE" for k in (7, 1_200_003) for w in ("START", "END")}


def widest(df):
    """The joins of a plan that send one side to every task."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def wave(spark, n=40):
    rows = [(k, s, 9.0 * s + k % 3, 1.5 * (k % 10) + 0.1 * (s % 2), float(s * k % 7)) for k in range(n) for s in range(1, 6)]
    return spark.createDataFrame(rows, "line_id long, seq int, x double, y double, z double")


def test_stations_are_those_of_the_join(spark):
    v = wave(spark)
    v = v.unionByName(spark.createDataFrame([(99, 1, 0.0, 0.0, 1.0), (99, 2, 0.0, 0.0, 2.0), (98, 1, 0.0, 0.0, 0.0), (98, 2, 3.0, 4.0, 1.0), (98, 3, 3.0, 4.0, 9.0)], v.schema))
    st = G.resample(v, 4.0)
    want = G.z_at(v, st.select("line_id", "station").checkpoint())
    assert sorted(map(tuple, st.collect())) == sorted(map(tuple, want.collect()))
    lengths = {r["line_id"]: r["length"] for r in G.line_lengths(v).collect()}
    n = {r["line_id"]: r["count"] for r in st.groupBy("line_id").count().collect()}
    assert n == {k: max(2, -int(-length // 4.0) + 1) for k, length in lengths.items() if length > 0}
    assert st._jdf.queryExecution().executedPlan().toString().count("Join") == 0


def test_spacing_and_cross_grades_send_no_table_to_every_task(spark, monkeypatch):
    seen = []
    kept = G.summarise
    monkeypatch.setattr(G, "summarise", lambda df, *a, **b: seen.append(df) or kept(df, *a, **b))
    checkpoint = type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda df, *a, **b: seen.append(df) or checkpoint(df, *a, **b))
    levels = spark.createDataFrame([(k, k // 10, k % 10) for k in range(40)], "line_id long, group_id long, level long")
    got = {r["group_id"]: r for r in G.adjacent_spacing(wave(spark), levels, 1.5).collect()}
    assert {k: (r["samples"], r["unpaired"]) for k, r in got.items()} == {k: (72, 0) for k in range(4)}
    assert got[0]["p50"] == pytest.approx(1.5, abs=0.05)
    cells = spark.createDataFrame([(r, k, 0.01 * (r % 3), 0.01) for r in range(20) for k in range(60)], "row int, col int, gx double, gy double")
    assert G.cross_grades(wave(spark).drop("z"), cells, 4.0).count() == 40
    assert seen and not any(widest(df) for df in seen)


def test_applicability_makes_pairs_without_dealing_them(spark):
    lists = [("ALL", "ANY", "ALL"), ("BRAZIL", "CORN,ANY", "SOUTH,NORTH_WITH_JUSTIFICATION"), ("PERU", "CANE", "OTHER_WITH_JUSTIFICATION")]
    models = spark.createDataFrame([(k, *lists[k % 3]) for k in range(12)], "model_id long, a string, b string, c string").select("model_id", *[F.split(x, ",").alias(n) for x, n in (("a", "countries"), ("b", "crops"), ("c", "jurisdictions"))])
    contexts = spark.createDataFrame([(k, ("BRAZIL", "PERU", None)[k % 3], ("CANE", "CORN")[k % 2], f"S{k % 4}", ("why", " ", None)[k % 5 % 3]) for k in range(60)], "context_id long, country string, crop string, state string, justification string")
    regions = spark.createDataFrame([("S1", "SOUTH")], "state string, tag string")
    got = C.applicability(models, contexts, regions)
    assert not re.search(r"Aggregate\(keys=\[model_id#\w+, context_id", got._jdf.queryExecution().executedPlan().toString())
    rows = {(r["model_id"], r["context_id"]): (r["how"], r["wildcards"]) for r in got.collect()}
    assert sorted(k for k in rows if k[0] % 3 == 0) == [(m, x) for m in (0, 3, 6, 9) for x in range(60)] and rows[0, 2] == ("EXACT_OR_NATIONAL", 3)
    assert rows[1, 9] == ("EXACT_OR_NATIONAL", 0) and rows[1, 21] == ("EXACT_OR_NATIONAL", 0) and rows[1, 0] == ("JUSTIFIED_EXTRAPOLATION", 1) and rows[1, 12][0] == "NEEDS_JUSTIFICATION"
    assert {x % 6 for m, x in rows if m % 3 == 2} == {4} and len(rows) == got.count()


def copied(spark):
    shapes = [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)], [(0.0, 3.0), (12.0, 3.0)], [(3.0, 0.0), (20.0, 0.0)], [(9.0, 9.0), (14.0, 14.0)], [(0.0, 40.0), (1.0, 40.0)], [(0.0, 0.0), (9.0, 9.0), (9.0, 0.0), (0.0, 9.0)]]
    rows = [(i % 2, i, k + 1, *xy) for i in range(36) for k, xy in enumerate(shapes[i // 2 % 6])]
    return spark.createDataFrame(rows, "group_id int, line_id int, seq int, x double, y double")


def test_copies_of_lines_are_measured_once(spark, monkeypatch):
    v, measured, kept = copied(spark), [], G.segments_within
    monkeypatch.setattr(G, "segments_within", lambda a, b, *x, **y: measured.append(b.count()) or kept(a, b, *x, **y))
    n = {(r["line_id"], r["relation"]): r["n"] for r in G.relations_of_lines(v, ["group_id"], 5.0).collect()}
    assert measured == [18]  # nine segments of six shapes in two groups, not three times as many
    pairs = G.row_relations(v, ["group_id"], 5.0).collect()
    want = {}
    for r in pairs:
        assert r["a_id"] < r["b_id"] and (r["b_id"] - r["a_id"]) % 2 == 0
        for k in (r["a_id"], r["b_id"]):
            want[k, r["relation"]] = want.get((k, r["relation"]), 0) + 1
    assert n == want and len({(r["a_id"], r["b_id"]) for r in pairs}) == len(pairs)
    assert n[2, "CROSSING"] == 6 and n[0, "OVERLAP"] == 8 and n[8, "OVERLAP"] == 2 and (8, "TOUCH") not in n


def test_copies_of_segments_are_measured_once(spark, monkeypatch):
    s = G.segments(copied(spark), "line_id").select(F.col("line_id").alias("id"), "seq", "x0", "y0", "x1", "y1").checkpoint()
    a, b = s.filter("id % 2 = 0"), s.filter("id % 2 = 1")
    want = sorted(map(tuple, G.segments_within(a, b, 0.5, 5.0).collect()))
    measured, kept = [], G.segments_within
    monkeypatch.setattr(G, "segments_within", lambda a, b, *x, **y: measured.extend((a.count(), b.count())) or kept(a, b, *x, **y))
    assert sorted(map(tuple, G.copied_segments_within(a, b, 0.5, 5.0).collect())) == want
    assert measured == [9, 9] and len(want) > 9 * 9


def test_first_shared_cells_and_stays_are_told_in_batches(spark):
    """As filters over arrays they were interpreted, for each pair of segments of a cell, near or not."""
    rows = [(k, k % 3, 7.0 * (k % 5), 3.0 * (k % 7), 7.0 * (k % 4) + 11.0 * (k % 3 - 1), 5.0 * (k % 6) + 0.5) for k in range(60)]
    s = spark.createDataFrame(rows, "id int, seq int, x0 double, y0 double, x1 double, y1 double")
    near = G.segments_within(s, s, 1.25, 2.0)
    assert "lambda" not in near._jdf.queryExecution().executedPlan().toString()
    got = near.collect()
    both = s.select(*[F.col(c).alias(f"a_{c}") for c in s.columns]).crossJoin(s.select(*[F.col(c).alias(f"b_{c}") for c in s.columns]))
    d = X.seg_seg_dist(*[F.col(f"{p}_{c}") for p in "ab" for c in ("x0", "y0", "x1", "y1")])
    want = {(r["a_id"], r["b_id"]): r["d"] for r in both.withColumn("d", d).filter("d <= 1.25").collect()}
    assert len(got) == len(want) > 300 and {(r["a_id"], r["b_id"]): pytest.approx(r["dist"]) for r in got} == want
    spans = G.barrier_spans(wave(spark).drop("z"), s, 2.0)
    assert "lambda" not in spans._jdf.queryExecution().executedPlan().toString()
    inside = spans.selectExpr("sum(hi - lo) AS m").first()["m"]
    # by stations a hundredth apart
    st = G.resample(wave(spark).drop("z"), 0.01).withColumn("h", F.lit(0.01))
    close = X.pt_seg_dist(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) <= 2.0
    n = st.select("line_id", "station", "x", "y").join(F.broadcast(s), close).select("line_id", "station").distinct().count()
    assert inside == pytest.approx(n * 0.01, rel=0.01)


def test_both_sides_of_measured_copies_are_dealt_over_all_tasks(spark):
    """Few rows that each meet many: the side that isn't sent to the others' tasks was read by one task."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(G.relation_classes(copied(spark), ["group_id"], 5.0)[0]).count("REPARTITION_BY_NUM") == 2
    s = G.segments(copied(spark), "line_id").select(F.col("line_id").alias("id"), "seq", "x0", "y0", "x1", "y1")
    assert plan(G.copied_segments_within(s.filter("id % 2 = 0"), s.filter("id % 2 = 1"), 0.5, 5.0)).count("REPARTITION_BY_NUM") == 2


def test_steps_are_dealt_once(spark):
    d = "/root/testdata/sf0.001"
    own, sql = feed(spark, d, "steps"), feed(spark, d, f"SELECT * FROM ({FEEDS['steps']}) q")
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, sql.collect()))
    for q in (P.ge2, P.ge12r):
        assert q(spark, d)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_percentiles_of_lines_are_told_where_they_are_sorted(spark):
    v = wave(spark)
    target = v.select("line_id").distinct().withColumn("target_z", F.lit(2.0))
    for out, n in ((G.axis_profile(v, target), 40), (G.curvature(v, 9.0), 40)):
        assert out.count() == n
        assert "percentile" not in "".join(x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate" in x)


def test_runs_fall_apart_alike_by_tasks_and_by_rounds(spark):
    import random

    r = random.Random(4)
    rows = [(f"r{k}", r.randrange(9), k * 100 + i, *[float(r.randrange(-2, 6)) + r.choice([0.0, 4e-7, -4e-7]) for _ in range(4)]) for k in range(60) for i in range(r.randrange(1, 14))]
    s = spark.createDataFrame(rows, "run_id string, sequence int, segment_id long, x0 double, y0 double, x1 double, y1 double")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for run in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == run), key=lambda x: x[1:3])
        nodes = [{(round(x[3]), round(x[4])), (round(x[5]), round(x[6]))} for x in own]
        part = list(range(len(own)))
        for _ in own:
            part = [min(part[j] for j in range(len(own)) if nodes[i] & nodes[j]) for i in range(len(own))]
        order = sorted(set(part))
        want |= {x[2]: f"{run}:C{order.index(p) + 1:03d}" if len(order) > 1 else run for x, p in zip(own, part, strict=True)}
    try:
        for most, batch in ((200, 10_000), (200, 3), (5, 10_000), (0, 10_000)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            got = {x["segment_id"]: x["new_run_id"] for x in A.split_runs(s, most)[0].collect()}
            assert got == want, (most, batch)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_costly_rows_of_one_file_are_dealt_over_all_tasks(spark):
    docs = spark.range(40).coalesce(1).selectExpr("id AS row_id", "'{\"a\": 1}' AS json")
    rules = spark.createDataFrame([("$.a", "MAXIMUM", "0")], "path string, rule string, arg string")
    out = Q.check_documents(docs, rules)
    assert out.rdd.getNumPartitions() == 4 and out.count() == 40
    sections = spark.range(40).coalesce(1).selectExpr("id AS section_id", "'NEW' AS condition", "2e0 AS width", "1.5e0 AS side", "5e-3 AS slope", "4e-2 AS rough", "1e0 AS max_depth")
    peaks = spark.range(40).coalesce(1).selectExpr("id AS section_id", "1e0 + id AS peak_flow")
    out = H.reach_capacity(peaks, sections)
    assert out.rdd.getNumPartitions() == 4 and out.count() == 40


def test_sweeps_of_gathered_fields_are_those_of_any_field(spark):
    import random

    r = random.Random(2)
    rows = [(f"f{k}", r.gauss(0, 1) * (k != 3), r.gauss(0, 1) * (k != 3)) for k in range(5) for _ in range(k * k * 9 + 1)]
    cells = spark.createDataFrame([*rows, ("f1", None, 1.0), ("odd", float("nan"), 1.0), ("odd", 0.1, 0.2)], "field string, gx double, gy double")
    sweep = lambda gather: {(x["field"], x["theta"], x["lam"]): x for x in GR.orientation_sweep(cells, [0.0, 35.0, 90.0], [-3.0, 0.0, 1.0], 1.5, 2.0, 5.0, 0.1, gather=gather).collect()}
    any_, some, all_ = sweep(0), sweep(20), sweep(1000)
    assert len(any_) == 6 * 9 and any_.keys() == some.keys() == all_.keys()
    for k, want in any_.items():
        for got in (some[k], all_[k]):
            for n, v in want.asDict().items():
                assert got[n] == v if v is None or isinstance(v, str) else got[n] == pytest.approx(v, rel=1e-9, abs=1e-7, nan_ok=True), (k, n)


def test_values_beside_are_not_sent_whole_to_all_tasks(spark):
    cells = spark.range(100).selectExpr("0 AS grid_id", "CAST(id AS INT) AS row", "0 AS col", "1e0 * id AS v")
    out = GR.gradient(cells)
    assert widest(out) == 0 and out.filter("gy = 1").count() == 100


def test_hulls_of_small_features_are_reduced_at_once(spark):
    import random

    r = random.Random(7)
    v = spark.createDataFrame([(k, r.gauss(0, 9), r.gauss(0, 9)) for k in range(9) for _ in range(3 + 5 * k)], "feature_id long, x double, y double")
    corners = lambda gather: sorted(map(tuple, G.convex_hulls(v, gather=gather).collect()))
    assert corners(10_000) == corners(20) == corners(0)
    # dealt over all tasks, once by feature
    plan = G.convex_hulls(v.coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(feature_id") == 1 and "FlatMapGroupsInArrow" in plan


def test_pairs_of_ends_are_made_where_their_rows_are_dealt(spark):
    lines = lambda x: spark.range(50).coalesce(1).selectExpr("id AS row_id", "id * 10 AS line_id", f"{x}e0 AS x0", "id * 1e0 AS y0", f"{x + 9}e0 AS x1", "id * 1e0 AS y1")
    out = G.infer_connections(lines(0), lines(12))
    assert widest(out) == 0 and out.rdd.getNumPartitions() == 4 and {r["gap"] for r in out.collect()} == {3.0}
