"""The similarity join against all pairs, and the pigeonhole promise on random sets of many sizes."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from furrow.llm import ngram_join
from furrow.llm.common import mix, run_dir

WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper kapok larch maple nutmeg oak pine".split()


def sets_apart(rng, n, share):
    """Two linked sets, the smaller of n, as far apart as may be or nearer."""
    num, den = share
    m = rng.randint(n, n * den // num)
    common = rng.choice([ngram_join.shared_least(n + m, share)] * 3 + [min(n, ngram_join.shared_least(n + m, share) + 1), n])
    fresh = lambda k: [rng.getrandbits(64) for _ in range(k)]
    both = fresh(common)
    return [mix(np.unique(np.array(both + fresh(k - common), dtype=np.uint64))) for k in (n, m)]


@pytest.mark.parametrize("share", [(4, 5), (3, 4), (9, 10), (1, 2)])
def test_linked_sets_share_a_key_whatever_the_choice(share):
    rng = random.Random(4)
    for n in [*range(1, 70)] * 12 + [100, 253, 254, 316, 317, 999, 2500] * 3:
        x, y = (np.sort(s) for s in sets_apart(rng, n, share))
        keys, asks, needs = ngram_join.keys_of(x, share)
        others = set(ngram_join.keys_of(y, share)[0].tolist())
        missed = sum(k not in others for k in keys[:asks].tolist())
        if ngram_join.bands_of(n, share)[0] < 0:
            assert missed < asks  # a small set asks with all its keys
        elif needs <= asks:
            assert missed < needs
        elif missed == asks:
            band, twice, empty = ngram_join.wanted(x, share)
            asked = {band: {*twice, *empty}}
            mine = {k for _, k, a in ngram_join.keys_within_one(x, asked, share) if a}
            assert mine & {k for _, k, _ in ngram_join.keys_within_one(y, asked, share)}


def test_sets_short_of_segments_find_partners_that_differ_in_all_of_them(spark):
    rng, short = random.Random(9), []
    while len(short) < 20:
        x = np.unique(np.array([rng.getrandbits(64) for _ in range(rng.choice([12, 16, 20]))], dtype=np.uint64))
        keys, asks, needs = ngram_join.keys_of(x)
        if needs > asks:
            short.append((x, asks))
    for x, asks in short:
        band, twice, empty = ngram_join.wanted(x)
        places = set(ngram_join.cut(x, band, ngram_join.SHARE)[0].tolist())
        y = list(x)
        while places:  # one more item in each segment that x has
            item = np.array([rng.getrandbits(64)], dtype=np.uint64)
            at = int(ngram_join.cut(item, band, ngram_join.SHARE)[0][0])
            if at in places:
                places.remove(at)
                y.append(item[0])
        y = np.unique(np.array(y, dtype=np.uint64))
        assert 5 * len(x) >= 4 * len(y) and not set(ngram_join.keys_of(x)[0][:asks].tolist()) & set(ngram_join.keys_of(y)[0].tolist())
        asked = {band: {*twice, *empty}}
        mine = {k for _, k, a in ngram_join.keys_within_one(x, asked) if a}
        assert mine & {k for _, k, _ in ngram_join.keys_within_one(y, asked)}


def test_bounds_of_differences():
    for share in ((4, 5), (3, 4), (2, 3)):
        num, den = share
        for n in range(1, 200):
            partners = range(n, n * den // num + 1)
            assert ngram_join.most_apart(n, share) == max(n + m - 2 * ngram_join.shared_least(n + m, share) for m in partners)


def shingles(t):
    w = [x.decode() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    at = list(range(len(sets)))

    def find(k):
        while at[k] != k:
            at[k] = at[at[k]]
            k = at[k]
        return k

    for (a, (i, x)), (b, (j, y)) in combinations(enumerate(sets), 2):
        if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
            at[find(b)] = find(a)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[find(k)] = i if find(k) not in low or i is not None and i < low[find(k)] else low[find(k)]
    return sorted(((i, len(s), low[find(k)] if i is not None else None) for k, (i, s) in enumerate(sets)), key=str)


def corpus(seed):
    """Families of copies with few edits, texts that share a passage, chains of ever further copies, and what is odd."""
    rng = random.Random(seed)
    out, passage = [], rng.choices(WORDS, k=60)
    for n in [1, 2, 4, 5, 6, 8, 9, 10, 12, 14, 15, 16, 17, 18, 20, 24, 30, 34, 40, 60, 90, 150, 300]:
        base = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n)]
        for k in range(5):
            text = list(base)
            for _ in range(rng.randint(0, 1 + n // 40)):
                text[rng.randrange(len(text)) if rng.random() < 0.5 else -1] = f"new{rng.randint(0, 999)}"
            out.append(" ".join(text + [f"more{j}" for j in range(rng.choice([0, 0, 1, 2, n // 8]))]))
        for k in range(6):  # a chain: each drops some words at the front and adds some at the end
            out.append(" ".join((base + [f"end{n}x{j}" for j in range(6)])[k : n + k]))
    out += [" ".join(passage + [f"own{k}x{j}" for j in range(rng.randint(0, 30))]) for k in range(40)]
    out += [None, "", " \t\n", "one", "ONE", "one  ", "a b c d", "A b\x0bc d", "long " * 8000, "z" * 20_000, out[20], out[20]]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_same_components_as_all_pairs(spark, seed):
    texts = corpus(seed)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    rows = [*zip(ids, texts, strict=True), (None, texts[30]), (None, None), (3, texts[40]), (ids[50], texts[50])]
    df = spark.createDataFrame([(i, t, 0, "x", 0.5) for i, t in rows], "doc_id bigint, text string, n_shingles int, keys string, class double").repartition(4)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, run_dir(spark, "t")).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert ngram_join.join(none, run_dir(spark, "t")).collect() == []


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.op12_ngram_join(spark, sf).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components_of_graphs(spark, kind):
    rng = random.Random(3)
    ids = rng.sample(range(10_000), 300)
    links = {
        "chain": [*zip(ids, ids[1:], strict=False), *((k, k + 1) for k in range(20_000, 20_200))], "star": [(ids[0], k) for k in ids[1:]] + [(20_000, 20_001)],
        "random": [(rng.choice(ids), rng.choice(ids)) for _ in range(260)], "none": [],
    }[kind]
    at = {k: k for pair in links for k in pair}

    def find(k):
        while at[k] != k:
            k = at[k]
        return k

    for a, b in links:
        x, y = find(a), find(b)
        at[max(x, y)] = min(x, y)
    out = ngram_join.components(spark.createDataFrame(links, "a bigint, b bigint"), run_dir(spark, "t")).collect()
    assert {r["node"]: r["component"] for r in out} == {k: find(k) for a, b in links if a != b for k in (a, b)} and len(out) == len({r["node"] for r in out})


def test_keys_of_copies_are_not_counted_as_shared(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(str(rng.randrange(10**9)) for _ in range(60)) for _ in range(8)]
    docs = spark.createDataFrame([(i, texts[i % 8]) for i in range(40)], "doc_id bigint, text string").repartition(3)
    out = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs, str(tmp_path)).collect()}
    assert out == {i: i % 8 for i in range(40)}
    assert spark.read.parquet(f"{tmp_path}/often").count() == 0
