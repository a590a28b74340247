"""Members of classes that are matched once a class: their pairs are those of the plain join, and few rows are dealt for them."""

import re

from pyspark.sql import functions as F

from furrow.operators import catalog as C
from furrow.operators import copies
from furrow.operators import geometry as G


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_members_are_those_of_the_plain_join(spark, monkeypatch):
    monkeypatch.setattr(copies, "LEAST", 50)
    # a class with most of the members, small ones, one that nothing matches, a member that is null and one that comes twice
    a = spark.createDataFrame([(min(k // 3, 5), k) for k in range(60)] + [(2, None), (1, 3)], "kind int, member long")
    b = spark.createDataFrame([(k % 4, f"x{k}") for k in range(23)] + [(9, "y")], "kind int, member string")
    near = spark.createDataFrame([(0, 0, "p"), (1, 3, "q"), (2, 1, "r"), (5, 0, "s"), (5, 2, "t"), (5, 2, "u"), (8, 1, "v")], "m int, n int, told string")
    sizes = [x.groupBy("kind").agg(F.count(F.lit(1)).alias("n")) for x in (a, b)]
    sides = copies.blocks(a, 62, 24)
    assert sides[0] > 1 and sides[1] > 1
    (at_a, held_a), (at_b, held_b) = (copies.packed(x, ["kind"], s, k, n) for x, s, k, n in zip((a, b), sizes, sides, (62, 24), strict=True))
    met = near.join(at_a.select(F.col("kind").alias("m"), F.col("at").alias("a_at")), "m").join(at_b.select(F.col("kind").alias("n"), F.col("at").alias("b_at")), "n")
    assert met.filter("m = 5").select(F.size("a_at").alias("lists")).first()["lists"] > 1
    got = copies.member_pairs(met.select("told", "a_at", "b_at"), held_a, held_b, sides, ["told", "a", "b"])
    want = near.join(a.withColumnRenamed("kind", "m"), "m").join(b.withColumnRenamed("kind", "n").withColumnRenamed("member", "other"), "n").select("told", "member", "other")
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert order(got) == order(want) and got.count() > 500


def test_members_are_repeated_little(spark):
    for a, b in ((360_000, 5_400_000), (540_000, 540_000), (0, 7), (5, 0), (1, 10_000_000), (10_000_000, 1)):
        first, second = copies.blocks(spark.range(1), a, b)
        assert first >= 1 and second >= 1 and a * second + b * first <= 30_000_000
        assert -(-a // first) <= copies.MOST and -(-b // second) <= copies.MOST


def test_models_are_not_dealt_for_each_class_of_contexts(spark):
    models = spark.createDataFrame([(k, ["ALL"], ["ANY"], ["ALL"]) for k in range(9)], "model_id long, countries array<string>, crops array<string>, jurisdictions array<string>")
    contexts = spark.createDataFrame([(k, "PERU", f"C{k % 5}", "S1", "why") for k in range(20)], "context_id long, country string, crop string, state string, justification string")
    got = C.applicability(models, contexts, spark.createDataFrame([], "state string, tag string"))
    assert not re.search(r"hashpartitioning\(c_one#\w+, part#", plan(got)) and "tile" in plan(got)
    assert sorted((r["model_id"], r["context_id"]) for r in got.collect()) == [(m, x) for m in range(9) for x in range(20)]


def test_copies_of_segments_are_not_dealt_for_each_pair_of_classes(spark):
    s = spark.createDataFrame([(k, 1, float(k % 3), 0.0, float(k % 3) + 1.04, 0.3) for k in range(30)], "id long, seq int, x0 double, y0 double, x1 double, y1 double")
    a, b = s.filter("id % 2 = 0"), s.filter("id % 2 = 1")
    got = G.copied_segments_within(a, b, 0.5, 5.0, digits=2)
    assert "__b_id" not in plan(got) and "tile" in plan(got)
    want = G.segments_within(a, b, 0.5, 5.0).withColumn("dist", F.round("dist", 2))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100
