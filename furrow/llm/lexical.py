"""Ranked lexical search by a document scan: an Aho-Corasick automaton of all item terms, and no index of documents.

Terms are runs of ASCII letters, digits and characters beyond ASCII. A text is rewritten so that every other character is
a blank and A-Z is small, with a blank before and after; a term goes into the automaton with a blank on either side.
These guards make it match whole terms only, and a match's output is the term's number, which leads to the items that
hold it. Documents are scanned twice, once for the statistics (documents, terms, and documents a term) and once for the
scores. Nothing of a document is written or shuffled: a task keeps the best K of each item and sends these on.

Items are the queries. They are taken in blocks whose terms fit BLOCK_BYTES and whose number is at most BLOCK_ITEMS, so
what tasks carry is bounded whatever the table of items holds; a block takes two scans.

Defined cases: a null text has no terms, as document (never returned) and as item (no rows); equal scores rank by
ascending id, null ids after all others; repeated documents are ranked each on its own; item rows alike in id and text
are answered once, and rows that share an id only are answered each on its own; an empty table gives an empty result;
other columns are not looked at. Document ids are integers, item ids of any type.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.llm.common import load, raw_texts, small_batches

#: Documents that an item is answered with.
K = 10
#: Of the terms of a block of items (each counted once for every item that holds it), and items of a block.
BLOCK_BYTES, BLOCK_ITEMS = 4 << 20, 4096
#: Scores that a task holds at once.
CELLS = 1 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def folded(text: bytes) -> bytes:
    """A text with blanks for all that is in no term, and a guard at either end."""
    return b" " + text.translate(_FOLD) + b" "


class Scan:
    """Counts of a block's terms in texts."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self.automaton.add_word(f" {t} ", i)
        self.automaton.make_automaton()
        self.any = bool(terms)

    def __call__(self, text: bytes) -> tuple[int, dict[int, int]]:
        """How many terms a text has, and how often it has each of the block's."""
        t = folded(text)
        n = len(t.split())
        if not n or not self.any:
            return n, {}
        return n, Counter(map(itemgetter(1), self.automaton.iter(t.decode("utf-8", "replace"))))


class Block:
    """Some items: their terms, and for each term the items that hold it and how often."""

    def __init__(self, items: list[tuple[object, dict[str, int]]]):
        self.ids = [i for i, _ in items]
        self.terms = sorted({t for _, held in items for t in held})
        number = {t: i for i, t in enumerate(self.terms)}
        rows = sorted((number[t], at, times) for at, (_, held) in enumerate(items) for t, times in held.items())
        term, self.item, self.times = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))


def blocks(items: DataFrame, item_id: str, text: str, most_bytes: int, most_items: int) -> Iterator[Block]:
    """The items, block after block; the driver holds one block at a time."""
    held, size = [], 0
    for row in items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).filter("text IS NOT NULL").distinct().toLocalIterator():
        terms = Counter(folded(row["text"].encode()).decode().split(" "))
        terms.pop("", None)
        if not terms:
            continue
        more = sum(len(t.encode()) + 16 for t in terms)
        if held and (size + more > most_bytes or len(held) == most_items):
            yield Block(held)
            held, size = [], 0
        held.append((row["id"], dict(terms)))
        size += more
    if held:
        yield Block(held)


def statistics(texts: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms with repeats, and the documents that hold each of the block's terms."""
    small_batches(texts.sparkSession)
    terms = block.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, df, some, every = Scan(terms), np.zeros(len(terms), dtype=np.int64), 0, 0
        for b in batches:
            for t in raw_texts(b.column(0)):
                n, found = scan(t)
                some, every = some + (n > 0), every + n
                df[list(found)] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, [-1, -2])), pa.array(np.append(df[held], [some, every]))], names=["term", "n"])

    got = {r["term"]: r["n"] for r in texts.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return got.get(-1, 0), got.get(-2, 0), np.array([got.get(i, 0) for i in range(len(terms))], dtype=np.int64)


class Best:
    """The best k documents of each item so far: score descending, then documents with an id before those without, then
    the id ascending."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, dtype=np.int64)
        self.rows = [np.empty(0, dtype=np.int64) for _ in range(4)]  # item, score, whether the id is null, id

    def offer(self, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        """scores: documents x items."""
        doc, item = np.nonzero(scores >= self.least)
        if not len(doc):
            return
        new = (item, scores[doc, item], null[doc].astype(np.int64), ids[doc])
        item, score, no_id, own = (np.concatenate(x) for x in zip(self.rows, new, strict=True))
        order = np.lexsort((own, no_id, -score, item))
        item = item[order]
        starts = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        place = np.arange(len(item)) - np.repeat(starts, np.diff(np.append(starts, len(item))))
        stays = place < self.k
        self.rows = [item[stays], *(x[order][stays] for x in (score, no_id, own))]
        full = place == self.k - 1
        self.least[item[full]] = score[order][full]


def best_of_tasks(docs: DataFrame, block: Block, n_docs: int, n_terms: int, weight: np.ndarray, k: int) -> DataFrame:
    """item (its place in the block), doc_id, score: the best k of each task for each item."""
    small_batches(docs.sparkSession)
    terms, first, item, times, items = block.terms, block.first, block.item, block.times, len(block.ids)
    rows = max(1, CELLS // items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, best = Scan(terms), Best(items, k)
        for b in batches:
            texts, null = raw_texts(b.column(1)), np.asarray(b.column(0).is_null())
            ids = b.column(0).fill_null(0).to_numpy()
            for lo in range(0, len(texts), rows):
                counted = [scan(t) for t in texts[lo : lo + rows]]
                m = np.array([25 + 75 * n * n_docs // max(n_terms, 1) for n, _ in counted], dtype=np.int64)
                owner = np.repeat(np.arange(len(counted)), [len(c) for _, c in counted])
                term = np.array([t for _, c in counted for t in c], dtype=np.int64)
                tf = np.array([x for _, c in counted for x in c.values()], dtype=np.int64)
                value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[owner]))
                # each count goes to all items that hold its term
                spread = first[term + 1] - first[term]
                at = np.repeat(first[term] - np.cumsum(spread) + spread, spread) + np.arange(spread.sum())
                scores = np.zeros(len(counted) * items, dtype=np.int64)
                np.add.at(scores, np.repeat(owner, spread) * items + item[at], np.repeat(value, spread) * times[at])
                best.offer(scores.reshape(-1, items), null[lo : lo + rows], ids[lo : lo + rows])
        at, score, no_id, own = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own, mask=no_id.astype(bool)), pa.array(score)], names=["item", "doc_id", "score"])

    return docs.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_bytes: int = BLOCK_BYTES, most_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score of the k documents that answer each item best."""
    spark, kind = docs.sparkSession, items.schema[item_id].dataType.simpleString()
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for block in blocks(items, item_id, item_text, most_bytes, most_items):
        n_docs, n_terms, df = statistics(own.select("text"), block)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
        rows = best_of_tasks(own, block, n_docs, n_terms, weight, k)
        place = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        rows = rows.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item bigint, item_id {kind}")  # at most most_items rows
        out = out.unionAll(rows.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
s AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM len),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, nd),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
r AS (
    SELECT q.item_id, tf.doc_id, sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * n * nd) // l))))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN tf USING (term) JOIN len USING (doc_id), s GROUP BY ALL
),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= 10
"""
