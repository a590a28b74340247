"""Networks of any depth: closures, cycles, dry reaches and routing against plain walks."""

import random
from collections import defaultdict

import pytest

from furrow.operators import hydrology as H


def edges_of(spark, pairs, name="a int, b int"):
    return spark.createDataFrame(pairs, name)


def reach(pairs, start):
    out, stack = set(), [start]
    while stack:
        for b in pairs[stack.pop()]:
            if b not in out:
                out.add(b)
                stack.append(b)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randint(0, 25), rng.randint(0, 25)) for _ in range(26)] + [(30 + i, 31 + i) for i in range(40)]
    to = defaultdict(list)
    for a, b in pairs:
        to[a].append(b)
    got = {(r["a"], r["b"]) for r in H.closure(edges_of(spark, pairs)).collect()}
    assert got == {(a, b) for a in list(to) for b in reach(to, a)}
    assert H.closure(edges_of(spark, [])).collect() == []


def facts(spark, reaches, lateral):
    r = spark.createDataFrame(reaches, "reach_id int, up int, down int")
    out = defaultdict(set)
    for x in H.check_network(r, spark.createDataFrame([(n,) for n in lateral], "node int")).collect():
        out[x["rule"]].add(int(x["key"]))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_network_facts_of_random_networks(spark, seed):
    rng = random.Random(seed)
    n = 40
    reaches = [(i, i, rng.randint(max(0, i - 6), i - 1) if rng.random() < 0.93 else rng.randint(0, n)) for i in range(1, n)]
    reaches += [(100 + k, rng.randint(0, n), rng.randint(0, n)) for k in range(seed * 2)] + [(200, 7, 7), (3, 60, 61)]
    lateral = [rng.randint(0, n) for _ in range(6)] + [999]
    to, ups = defaultdict(list), [u for _, u, _ in reaches]
    for _, u, d in reaches:
        if u != d:
            to[u].append(d)
    nodes = {x for _, u, d in reaches for x in (u, d)}
    fed = set(lateral).union(*(reach(to, x) for x in lateral))
    got = facts(spark, reaches, lateral)
    assert got["CYCLE"] == {x for x in nodes if x in reach(to, x)}
    assert got["DRY"] == {i for i, u, _ in reaches if u not in fed}
    assert got["SPLIT"] == {u for u in ups if ups.count(u) > 1} and got["SELF_LOOP"] == {i for i, u, d in reaches if u == d}
    assert got["OUTLET"] == {x for x in nodes if x not in ups} and got["UNKNOWN_NODE"] == {x for x in lateral if x not in nodes} and got["DUPLICATE_REACH"] == {3}


def test_a_main_stem_of_five_thousand_reaches(spark):
    n = 5000
    r = spark.createDataFrame([(i, i, i - 1, 1.0) for i in range(1, n + 1)], "reach_id int, up int, down int, travel_s double")
    lateral = spark.createDataFrame([(node, t, q) for node in (n, n // 2) for t, q in ((0.0, 0.0), (10.0, 2.0), (20.0, 0.0))], "node int, time_s double, flow double")
    facts_ = {(x["rule"], x["key"]) for x in H.check_network(r, spark.createDataFrame([(n,)], "node int")).collect()}
    assert facts_ == {("OUTLET", "0")}
    routed = H.route_by_lag(r, lateral)
    last = {x["time_s"]: x["flow"] for x in routed.filter("reach_id = 1").collect()}
    assert last[n + 10.0] == pytest.approx(2) and last[n // 2 + 10.0] == pytest.approx(2)
    (b,) = H.routing_balance(r, lateral, routed).collect()
    assert b["input_volume_m3"] == pytest.approx(40) and b["outlet_volume_m3"] == pytest.approx(40) and b["balance_status"] == "PASS"


def test_routing_names_a_cycle_and_a_split(spark):
    schema, lateral = "reach_id int, up string, down string, travel_s double", spark.createDataFrame([("A", 0.0, 1.0)], "node string, time_s double, flow double")
    with pytest.raises(ValueError, match="acyclic; node [AB]"):
        H.route_by_lag(spark.createDataFrame([(1, "A", "B", 1.0), (2, "B", "A", 1.0)], schema), lateral)
    with pytest.raises(ValueError, match="splits at node A"):
        H.route_by_lag(spark.createDataFrame([(1, "A", "B", 1.0), (2, "A", "C", 1.0)], schema), lateral)


def test_balance_counts_laterals_at_the_outlet(spark):
    r = spark.createDataFrame([("R1", "A", "B", 30.0)], "reach_id string, up string, down string, travel_s double")
    lateral = spark.createDataFrame([(k, t, q) for k in ("A", "B") for t, q in ((0.0, 0.0), (10.0, 2.0), (20.0, 0.0))], "node string, time_s double, flow double")
    (b,) = H.routing_balance(r, lateral, H.route_by_lag(r, lateral)).collect()
    assert (b["input_volume_m3"], b["outlet_volume_m3"], b["balance_status"]) == (40, 40, "PASS")
