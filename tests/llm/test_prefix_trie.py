"""The trie of conversations against a plain one, on tables with nulls, repeats, long and turnless conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from furrow.llm import prefix_trie
from furrow.llm.common import run_dir

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, n_convs string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        path = own.get(c - c % 100, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)

    def below(n):
        """Leaves and saved characters, without recursion along long conversations."""
        leaves, saved, stack = 0, 0, [n]
        while stack:
            m = stack.pop()
            leaves += not children[m]
            saved += (len(members[m]) - 1) * len(m[-1][1] if m else "")
            stack += children[m]
        return leaves, saved

    return {
        (m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(children[n]), *below(n), hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, m in list(members.items())
    }


def table(seed=5):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 12), *range(95, 130), *range(250, 262), 400]:  # 2xx: the first of the hundred is absent
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", None, ""]), rng.choice(["a", "b", "", None, "éü", "long " * 300])))
    rows += [(100, None, "user", "before all"), (101, None, None, None), (None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(400, t, "user", f"turn {t % 7}") for t in range(9, 160)] + [(401, t, "user", f"turn {t % 7}") for t in range(9, 160)]
    rows += [(c, t, "user", f"same {t}") for c in range(500, 590) for t in range(4)]
    return rows


def nodes(rows):
    return [(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows]


@pytest.mark.parametrize("widest", [1 << 24, 256])
def test_same_as_a_plain_trie(spark, widest):
    rows = table()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    got = nodes(prefix_trie.prefix_trie(df, run_dir(spark, "t"), widest).collect())
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_empty_table_and_only_lost_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    lost = spark.createDataFrame([(None, 1, "user", "x", 1, "x")], SCHEMA)
    assert prefix_trie.prefix_trie(none, run_dir(spark, "t")).collect() == [] and prefix_trie.prefix_trie(lost, run_dir(spark, "t")).collect() == []


def test_one_long_conversation_lies_in_several_tasks(spark):
    rows = [(7, t, "user", f"t{t}") for t in range(3000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    work = run_dir(spark, "t")
    got = prefix_trie.numbered_turns(df, work).collect()
    assert sorted(r["pos"] for r in got) == list(range(1, 3001))
    assert spark.read.parquet(f"{work}/cut").select("__part").distinct().count() > 1


def test_the_sketch_never_counts_too_low(spark):
    rng = np.random.default_rng(1)
    names = [(int(d), int(a), int(b)) for d, a, b in zip(rng.integers(1, 9, 3000), rng.integers(-(2**63), 2**63, 3000), rng.integers(-(2**63), 2**63, 3000), strict=True)]
    names += names[:40] * 300
    df = spark.createDataFrame(names, "depth bigint, p1 bigint, p2 bigint").repartition(6)
    for width in (256, 1 << 14):
        counts = prefix_trie.sketch(df, width)
        true = defaultdict(int)
        for n in names:
            true[n] += 1
        at = prefix_trie.cells(*(np.array(c, dtype=np.int64) for c in zip(*true, strict=True)), width)
        assert (counts[at].min(0) >= np.minimum(list(true.values()), 255)).all()
        if width > 256:
            assert (counts[at].min(0) == np.minimum(list(true.values()), 255)).mean() > 0.95
