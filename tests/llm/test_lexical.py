"""Ranked search against a plain count of every document's terms, on small tables with all that is odd in them."""

import math
import re
from collections import Counter, defaultdict

import pytest

from furrow.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = [
    (5, "The cat sat on the mat. Cat!"), (2, "the cat sat on the mat cat"), (9, "mat"), (None, "the cat sat on the mat cat"), (7, None), (8, ""), (3, " \t..,, \x00"), (4, "CAT_cat-cat'cat"),
    (11, "Éclair éclair ECLAIR世界 naïve cat\x0bcat"), (12, "word " * 30_000 + "cat"), (13, "concatenate cats scatter"), (2, "the cat sat on the mat cat"), (20, "z" * 50_000),
]
ITEMS = [(1, "Cat on the MAT, cat"), (2, None), (3, ""), (4, "éclair 世界 ECLAIR世界"), (5, "unheard-of nothing"), (1, "Cat on the MAT, cat"), (6, "word cat word"), (7, "É")]


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms, df = len(held), sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    out = defaultdict(list)
    for item, text in set(items):
        scored = []
        for i, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scored)[:k], 1):
            out[item].append((rank, i, -score))
    return out


@pytest.mark.parametrize(("k", "most_bytes", "most_items"), [(10, 4 << 20, 4096), (3, 60, 2), (1, 1, 1)])
def test_same_as_a_plain_count(spark, k, most_bytes, most_items):
    docs = spark.createDataFrame([(i, t, 1.0, 2, "x") for i, t in DOCS], "doc_id bigint, text string, score double, rank int, item_id string").repartition(4)
    items = spark.createDataFrame([(i, t, 0.5) for i, t in ITEMS], "item_id bigint, text string, score double")
    got = defaultdict(list)
    for r in lexical.search(docs, items, k, most_bytes=most_bytes, most_items=most_items).collect():
        got[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    assert {i: sorted(v, key=lambda x: x[0]) for i, v in got.items()} == dict(brute(DOCS, ITEMS, k))


def test_small_steps_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 8)
    docs = spark.createDataFrame(DOCS * 7, "doc_id bigint, text string").coalesce(1)
    items = spark.createDataFrame([(str(i), t) for i, t in ITEMS], "item_id string, text string")
    got = defaultdict(list)
    for r in lexical.search(docs, items, 4).orderBy("rank").collect():
        got[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    assert dict(got) == {str(i): v for i, v in brute(DOCS * 7, ITEMS, 4).items()}


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame(r, s) for r, s in ((DOCS, "doc_id bigint, text string"), (ITEMS, "item_id bigint, text string")))
    assert lexical.search(docs.limit(0), items).collect() == [] and lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]
