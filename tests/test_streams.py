"""The excess stream: what is late, what has ended, and that ended events leave no state."""

from pyspark.sql import functions as F

from furrow.plans import io
from furrow.streaming import rain as ST


def test_late_intervals_are_told_and_ended_events_leave_no_state(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "event_id bigint, idx int, minute int, rain_mm double").select("event_id", "idx", "rain_mm", F.timestamp_seconds(1_700_000_000 + F.col("minute") * 60).alias("ts"))
    parts = [
        rows((1, 0, 0, 20.0), (1, 1, 10, 20.0), (2, 0, 5, 30.0)),
        rows((1, 2, 20, 10.0), (2, 1, 200, 5.0)),  # the watermark is ten minutes behind the latest
        rows((3, 0, 10_000, 1.0)),
        rows((1, 3, 30, 99.0), (4, 0, 40, 99.0), (2, 2, 20_000, 7.0)),
        rows((9, 0, 90_000, 0.0)),
    ]
    done = []
    out = io.run_stream(parts, lambda s: ST.stream_excess(s, 80.0, 0.2, "10 minutes", 3_600_000), "t", done).collect()
    at = lambda kind: sorted((r["event_id"], r["idx"], r["cumulative_mm"]) for r in out if r["kind"] == kind)
    assert at("INTERVAL") == [(1, 0, 20.0), (1, 1, 40.0), (1, 2, 50.0), (2, 0, 30.0), (2, 1, 35.0), (2, 2, 7.0), (3, 0, 1.0), (9, 0, 0.0)]
    assert at("LATE") == [(1, 3, None), (4, 0, None)]
    assert at("ENDED") == [(1, 2, 50.0), (2, 1, 35.0), (2, 2, 7.0), (3, 0, 1.0)]
    excess = {(r["event_id"], r["idx"]): r["excess_mm"] for r in out if r["kind"] == "INTERVAL"}
    whole = {(r["event_id"], r["idx"]): r["excess_mm"] for r in out if r["kind"] == "ENDED"}
    assert abs(sum(v for (e, _), v in excess.items() if e == 1) - whole[(1, 2)]) < 1e-9
    last = [p for run in done for p in run][-1]
    kept = sum(s.numRowsTotal for s in last.stateOperators)
    most = max(sum(s.numRowsTotal for s in p.stateOperators) for run in done for p in run)
    assert kept <= 1 < most  # the last record's own event


def test_events_of_a_part_share_a_state_and_end_on_their_own(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "event_id bigint, idx int, minute int, rain_mm double").select("event_id", "idx", "rain_mm", F.timestamp_seconds(1_700_000_000 + F.col("minute") * 60).alias("ts"))
    big = 2**53 + 1
    parts = [
        rows(*[(e, 0, e % 50, 10.0) for e in range(200)], (big, 0, 0, 20.0), (None, 0, 0, 5.0)),
        rows((big, 1, 55, 30.0), (7, 1, 80, 10.0), (None, 1, 50, 5.0)),
        rows((7, 2, 135, 1.0)),  # the watermark is at 125 then: events that brought nothing since 65 have ended
        rows((big, 2, 60, 9.0)),
    ]
    done = []
    out = io.run_stream(parts, lambda s: ST.stream_excess(s, 80.0, 0.2, "10 minutes", 3_600_000, parts=1), "t", done).collect()
    at = lambda kind: {(r["event_id"], r["idx"]): r["cumulative_mm"] for r in out if r["kind"] == kind}
    want = {(e, 0): 10.0 for e in range(200)} | {(big, 0): 20.0, (big, 1): 50.0, (None, 0): 5.0, (None, 1): 10.0, (7, 1): 20.0, (7, 2): 21.0}
    assert at("INTERVAL") == want and len(out) == len(want) + 201 + 1
    assert at("ENDED") == {(e, 0): 10.0 for e in range(200) if e != 7} | {(big, 1): 50.0, (None, 1): 10.0}
    assert at("LATE") == {(big, 2): None}
    assert max(sum(s.numRowsTotal for s in p.stateOperators) for run in done for p in run) <= 4  # 202 events, and two parts
