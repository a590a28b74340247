"""Lines without their spans: gaps, tails, lines that no span touches, and that lines and spans meet once."""

from furrow.operators import geometry as G


def test_lines_and_spans_meet_once(spark):
    lengths = spark.createDataFrame([(1, 100.0), (2, 50.0), (3, 30.0), (4, 10.0)], "line_id bigint, length double").repartition(2)
    spans = spark.createDataFrame([(1, -5.0, 10.0), (1, 40.0, 45.0), (1, 60.0, 200.0), (2, 60.0, 70.0), (3, 0.0, 30.0), (9, 0.0, 1.0)], "line_id bigint, lo double, hi double").repartition(2)
    kept, breaks, bal = G.split_lines(lengths, spans, 20.0)
    rows = {(r["piece_id"], r["lo"], r["hi"], r["start_state"], r["end_state"]) for r in kept.collect()}
    assert rows == {("1:W0001", 10.0, 40.0, "BARRIER", "BARRIER"), ("2:W0001", 0.0, 50.0, "SOURCE", "SOURCE")}
    assert sorted((r["line_id"], r["break"], r["lo"], r["hi"], r["why"]) for r in breaks.collect()) == [
        (1, 1, 0.0, 10.0, "BARRIER"), (1, 2, 40.0, 45.0, "BARRIER"), (1, 3, 45.0, 60.0, "TOO_SHORT"), (1, 4, 60.0, 100.0, "BARRIER"), (3, 1, 0.0, 30.0, "BARRIER"), (4, 1, 0.0, 10.0, "TOO_SHORT"),
    ]
    assert sorted((r["line_id"], r["kept_m"], r["discarded_m"], r["removed"], r["balanced"]) for r in bal.collect()) == [(1, 30.0, 15.0, 55.0, True), (2, 50.0, 0.0, 0.0, True), (3, 0.0, 0.0, 30.0, True), (4, 0.0, 10.0, 0.0, True)]
    plan = bal._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
