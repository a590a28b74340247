"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels exist for documents only, so tokens are labelled first: a greedy cover picks words and stems that occur in toxic
documents and next to never in others. Each must be significant: the toxic documents that it explains and no other word
does must be more than chance would give, at a level that is divided by the number of words that could pass. Tokens with
one of these in toxic documents are the toxic tokens. The field has two states; a token's features are its word and two
beginnings of it, and transitions join neighbours. It is fitted by forward-backward gradients on windows around all toxic
tokens of the sample, a document's windows weighing as much as one, and on windows elsewhere. Scoring takes whole texts: forward and backward messages of a two-state chain are ratios that each
token maps by a fraction (a x + b) / (c x + d), so blocks of tokens are composed side by side and then chained.

A document's score is the largest marginal of its tokens; the spans are the runs of tokens whose marginal is at least
one half, as code-point offsets.

The fit uses a bounded sample: at most SAMPLE labelled rows of either class (those with the smallest hash of their id),
of which tasks send words once a document, and then windows. Repeated texts of the sample count once in the choice of
words. Every row is scored on its whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import KEY_BYTES, Bounded, load, map_texts, materialise, remainder, run_dir
from furrow.llm.quality import labelled_sample

SAMPLE = 4_000
WINDOW = 5
THRESHOLD = 0.5
#: A word must explain at least this share of the toxic documents that are still unexplained at the start.
LEAST_SHARE = 0.004
#: Chance that any word at all is taken for toxic by accident, and how much likelier a word must be in toxic documents.
ALPHA, ODDS = 0.05, 20
#: Words of toxic documents that are explained already are taken too from this share of the toxic documents on.
KNOWN_SHARE = 0.02
#: Weight of all windows around a document's toxic tokens; its two other windows weigh one each.
HEAVY = 4.0
WORD = re.compile(r"\w+")


def lowered(raw: bytes) -> str:
    """In lower case, with as many code points as before."""
    t = raw.decode("utf-8", "replace")
    low = t.lower()
    return low if len(low) == len(t) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in t))


def tokens(raw: bytes) -> list[str]:
    return WORD.findall(lowered(raw))


def names(w: str) -> tuple[str, str, str]:
    """Feature names of a token: the word and two beginnings, so that inflected forms share what is learned of a stem."""
    return "w=" + w, "4=" + w[:4], "5=" + w[:5]


def chance(k: int, n: int, share: float) -> float:
    """A bound from above (Chernoff's) on the chance that of n documents with a word k or more are toxic, if share of all
    documents are; exact for k = n."""
    x = k / n
    if x <= share:
        return 1.0
    rest = (1 - x) * math.log((1 - x) / (1 - share)) if x < 1 else 0.0
    return math.exp(-n * (x * math.log(x / share) + rest))


def level(sizes: dict[int, int], share: float, alpha: float = ALPHA) -> float:
    """alpha over the number of words that could pass: those in so many documents that chance() can be low enough at all.
    sizes: number of words by the number of documents that have them."""
    k, more = 1, sum(sizes.values())
    while more and share**k > alpha / more:
        more -= sizes.get(k, 0)
        k += 1
    return alpha / max(more, 1)


def cover(toxic: list[set[str]], other_counts: dict[str, int], others: int, at: float, least: float = LEAST_SHARE) -> list[str]:
    """Words that explain the toxic documents, most first (of equal ones, the last in order). A word qualifies if it is
    at least ODDS times as frequent (in documents, by share) in toxic ones as in others; it is taken if its chance among
    the documents that are not explained yet is at most `at`."""
    where: dict[str, list[int]] = {}
    for i, words in enumerate(toxic):
        for w in words:
            where.setdefault(w, []).append(i)
    need = max(3, round(least * len(toxic)))
    where = {w: d for w, d in where.items() if len(d) >= need and len(d) / len(toxic) >= ODDS * other_counts.get(w, 0) / max(others, 1)}
    open_, chosen = np.ones(len(toxic), dtype=bool), []
    gains = {w: len(d) for w, d in where.items()}
    while gains:
        w = max(gains, key=lambda k: (gains[k], k))
        now = int(open_[where[w]].sum())
        if now < need:
            del gains[w]
        elif now < gains[w]:  # gains only fall, so the largest is right once it is up to date
            gains[w] = now
        else:
            del gains[w]
            left, c = int(open_.sum()), other_counts.get(w, 0)
            if chance(now, now + c, left / (left + others)) <= at:
                chosen.append(w)
                open_[where[w]] = False
    # words that the cover passed over, because their documents were explained already
    share = len(toxic) / (len(toxic) + others)
    known = {w for w, d in where.items() if not other_counts.get(w) and len(d) >= KNOWN_SHARE * len(toxic) and chance(len(d), len(d), share) <= at}
    return chosen + sorted(known - set(chosen))


def blocks(hits: list[int], size: int, wide: int = WINDOW) -> list[tuple[int, int]]:
    """The tokens within wide of a hit, in blocks of at most 2 * wide + 1 that don't overlap."""
    out: list[tuple[int, int]] = []
    end = 0
    for i in hits:
        while (start := max(i - wide, end)) <= min(i + wide, size - 1):
            end = min(start + 2 * wide + 1, i + wide + 1, size)
            out.append((start, end))
    return out


@dataclass(frozen=True)
class Field:
    """weights: log-odds of the toxic state by feature; bias; trans: the same-or-change weights [from][to]."""

    weights: dict = field(default_factory=dict)
    bias: float = -12.0
    trans: tuple = ((0.0, 0.0), (0.0, 0.0))
    start: float = 0.0

    def emission(self, w: str) -> float:
        g = self.weights.get
        return self.bias + sum(g(n, 0.0) for n in names(w))


def fit(windows: list[list[str]], tags: list[list[int]], weights: list[float] | None = None, rounds: int = 150, ridge: float = 1e-3) -> Field:
    """Adaptive gradient ascent on the conditional likelihood of the windows, all windows side by side."""
    if not windows or not any(map(any, tags)):
        return Field()
    index: dict[str, int] = {}
    longest = max(map(len, windows))
    ids = np.zeros((len(windows), longest, 3), dtype=np.int64)
    y = np.zeros((len(windows), longest), dtype=np.int64)
    n = np.array(list(map(len, windows)))
    for i, (ws, ts) in enumerate(zip(windows, tags, strict=True)):
        for t, w in enumerate(ws):
            ids[i, t] = [index.setdefault(k, len(index)) for k in names(w)]
        y[i, : len(ts)] = ts
    inside = np.arange(longest)[None, :] < n[:, None]
    heavy = np.ones(len(windows)) if weights is None else np.array(weights)
    mass = heavy.sum()
    size = len(index)
    theta = np.zeros(size + 6)  # features, bias, start, four transitions
    theta[size] = -2.0
    second = np.full(size + 6, 1e-8)
    flat = ids[inside]
    for _ in range(rounds):
        e = theta[ids].sum(2) + theta[size]
        a = theta[size + 2 :].reshape(2, 2)
        lf = np.zeros((len(windows), longest, 2))
        lb = np.zeros((len(windows), longest, 2))
        lf[:, 0, 1] = e[:, 0] + theta[size + 1]
        for t in range(1, longest):
            step = np.logaddexp(lf[:, t - 1, :1] + a[None, 0], lf[:, t - 1, 1:] + a[None, 1])
            step[:, 1] += e[:, t]
            lf[:, t] = np.where(inside[:, t, None], step, lf[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = lb[:, t + 1] + np.stack([np.zeros(len(windows)), e[:, t + 1]], 1)
            step = np.logaddexp(nxt[:, :1] + a[None, :, 0], nxt[:, 1:] + a[None, :, 1])
            lb[:, t] = np.where(inside[:, t + 1, None], step, lb[:, t + 1])
        whole = np.logaddexp(lf[:, -1, 0], lf[:, -1, 1])
        p = np.exp(np.clip(lf[:, :, 1] + lb[:, :, 1] - whole[:, None], -60, 0))
        miss = np.where(inside, y - p, 0.0) * heavy[:, None]
        up = np.zeros_like(theta)
        up[:size] = np.bincount(flat.ravel(), weights=np.repeat(miss[inside], 3), minlength=size)
        up[size] = miss.sum()
        up[size + 1] = miss[:, 0].sum()
        both = inside[:, 1:]
        for i in (0, 1):
            for j in (0, 1):
                joint = lf[:, :-1, i] + a[i, j] + (e[:, 1:] if j else 0) + lb[:, 1:, j] - whole[:, None]
                seen = (y[:, :-1] == i) & (y[:, 1:] == j)
                up[size + 2 + 2 * i + j] = (np.where(both, seen - np.exp(np.clip(joint, -60, 0)), 0.0) * heavy[:, None]).sum()
        up = up / mass - ridge * theta / mass
        second += up * up
        theta += 0.4 * up / np.sqrt(second)
    w = {k: float(theta[i]) for k, i in index.items() if abs(theta[i]) > 1e-4}
    a = theta[size + 2 :]
    return Field(w, float(theta[size]), ((float(a[0]), float(a[1])), (float(a[2]), float(a[3]))), float(theta[size + 1]))


def _ratios(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray, block: int = 64) -> np.ndarray:
    """x[t] = (p[t] x[t-1] + q[t]) / (r[t] x[t-1] + s[t]) for all t, from x[-1] = 1; blocks are composed side by side."""
    n = len(p)
    rows = -(-n // block)
    fill = rows * block - n
    m = [np.concatenate([v, np.full(fill, c)]).reshape(rows, block) for v, c in ((p, 1.0), (q, 0.0), (r, 0.0), (s, 1.0))]
    a, b, c, d = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for t in range(block):
        p, q, r, s = (v[:, t] for v in m)
        a, b, c, d = p * a + q * c, p * b + q * d, r * a + s * c, r * b + s * d
        big = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / big, b / big, c / big, d / big
    x, into = 1.0, np.empty(rows)
    for k, (ka, kb, kc, kd) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
        into[k] = x
        x = (ka * x + kb) / (kc * x + kd)
    out = np.empty((rows, block))
    for t in range(block):
        into = (m[0][:, t] * into + m[1][:, t]) / (m[2][:, t] * into + m[3][:, t])
        out[:, t] = into
    return out.ravel()[:n]


def marginals(e: np.ndarray, first: np.ndarray, model: Field) -> np.ndarray:
    """P(toxic) of each token of texts laid end to end. e: emissions; first: whether a token begins its text."""
    if not len(e):
        return e
    odds = np.exp(np.clip(e, -50, 50))
    (t00, t01), (t10, t11) = np.exp(np.array(model.trans))
    # forward: toxic over clean at t, of that at t-1; where a text begins, whatever came before doesn't count
    p, q = odds * t11, odds * t01
    r, s = np.full(len(e), t10), np.full(len(e), t00)
    p[first], q[first], r[first], s[first] = 0.0, odds[first] * np.exp(model.start), 0.0, 1.0
    f = _ratios(p, q, r, s)
    # backward: toxic over clean message into t, of that into t+1
    nxt, last = np.append(odds[1:], 1.0), np.append(first[1:], True)
    p, q = nxt * t11, np.full(len(e), t10)
    r, s = nxt * t01, np.full(len(e), t00)
    p[last], q[last], r[last], s[last] = 0.0, 1.0, 0.0, 1.0
    b = _ratios(p[::-1], q[::-1], r[::-1], s[::-1])[::-1]
    x = f * b
    return x / (1 + x)


class Tagger:
    """Marginals of whole texts; emissions of words seen lately are kept."""

    def __init__(self, model: Field, cached: int = 300_000):
        self.model, self.cache = model, Bounded(cached)

    def __call__(self, texts: list[bytes]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        c, emission = self.cache, self.model.emission
        c.room()
        all_words = [tokens(t) for t in texts]
        n = np.array(list(map(len, all_words)), dtype=np.int64)
        e = np.empty(int(n.sum()))
        at = 0
        for words in all_words:
            got = list(map(c.get, words))
            if None in got:
                for i, v in enumerate(got):
                    if v is None:
                        w = words[i]
                        v = c.get(w)
                        if v is None:
                            v = emission(w)
                            if len(w) <= KEY_BYTES:
                                c[w] = v
                        got[i] = v
            e[at : at + len(got)] = got
            at += len(got)
        first = np.zeros(len(e), dtype=bool)
        starts = np.cumsum(n) - n
        first[starts[n > 0]] = True
        return all_words, marginals(e, first, self.model), np.cumsum(n)


def learn(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> Field:
    """Words first, windows then: the driver gets words of toxic sample rows, counts for the others, and windows."""
    work = run_dir(docs.sparkSession, "toxic")
    sample = materialise(labelled_sample(docs, labels, label, size, doc_id, text), f"{work}/sample")

    def distinct(batches: Iterator[list[bytes]]) -> Iterator[list[pa.Array]]:
        for texts in batches:
            yield [pa.array([sorted({k for w in set(tokens(t)) for k in names(w)}) for t in texts], pa.list_(pa.string()))]

    words = map_texts(sample.dropDuplicates(["label", "text"]), distinct, [("words", "array<string>")], ["doc_id", "label"])
    words = materialise(words, f"{work}/words")
    n = {r["label"]: r["n"] for r in words.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Field()
    long = words.select("doc_id", "label", F.explode("words").alias("word"))
    tally = long.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("other"))
    tally = materialise(tally, f"{work}/tally")
    # one row for each number of documents, of which the sample has few
    sizes = {r["size"]: r["n"] for r in tally.groupBy((F.col("toxic") + F.col("other")).alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    at = level(sizes, n[1] / (n[0] + n[1]))
    need = max(3, round(LEAST_SHARE * n[1]))
    telling = tally.filter((F.col("toxic") >= need) & (F.col("toxic") * n[0] >= ODDS * F.col("other") * n[1])).toPandas()
    other = dict(zip(telling["word"], telling["other"].astype(int), strict=True))
    some = long.filter("label = 1").join(telling_frame(docs.sparkSession, list(other)), "word").groupBy("doc_id").agg(F.sort_array(F.collect_set("word")).alias("words")).orderBy("doc_id").toPandas()
    found = [set(w) for w in some["words"]]
    chosen = set(cover(found + [set()] * (n[1] - len(found)), other, n[0], at))
    if not chosen:
        return Field()

    def windows(batches: Iterator[list[bytes]]) -> Iterator[list[pa.Array]]:
        for texts in batches:
            out = []
            for t in texts:
                ws = tokens(t)
                hits = [i for i, w in enumerate(ws) if not chosen.isdisjoint(names(w))]
                # around all hits; and at two places of every text
                near = Counter(" ".join(ws[i:j]) for i, j in blocks(hits, len(ws)))
                far = [" ".join(ws[max(0, i - WINDOW) : i + WINDOW + 1]) for i in ((len(ws) // 3, len(ws) * 2 // 3) if ws else ())]
                many = sum(near.values())
                out.append([{"words": w, "weight": HEAVY * k / many} for w, k in sorted(near.items())] + [{"words": w, "weight": 1.0} for w in far])
            yield [pa.array(out, pa.list_(pa.struct([("words", pa.string()), ("weight", pa.float64())])))]

    rows = map_texts(sample, windows, [("windows", "array<struct<words:string,weight:double>>")], ["doc_id", "label"]).orderBy("doc_id").collect()
    seqs, tags, weights = [], [], []
    for r in rows:
        for one in r["windows"]:
            ws = one["words"].split(" ")
            seqs.append(ws)
            tags.append([int(r["label"] == 1 and not chosen.isdisjoint(names(w))) for w in ws])
            weights.append(one["weight"])
    return fit(seqs, tags, weights)


def telling_frame(spark: SparkSession, words: list[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


def score(docs: DataFrame, model: Field, keep: list[str] | None = None, text: str = "text", spans: bool = True, clean_only: bool = False) -> DataFrame:
    """The rows of docs with toxic_score, toxic_predicted and, if asked for, toxic_spans (array of start, end in code points).

    Defined cases: null and empty texts score 0; repeated rows are scored each; an empty table gives an empty result;
    columns with the names of the new ones are replaced, all others pass through.
    """

    def run(batches: Iterator[list[bytes]]) -> Iterator[list[pa.Array]]:
        tag = Tagger(model)
        for texts in batches:
            words, p, ends = tag(texts)
            scores, found, at = np.zeros(len(texts)), [], 0
            for i, end in enumerate(ends.tolist()):
                own, at = p[at:end], end
                scores[i] = own.max() if len(own) else 0.0
                found.append(offsets(texts[i], own) if spans and scores[i] >= THRESHOLD else [])
            new = [pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))]
            yield new + ([pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))] if spans else [])

    import pyarrow.compute as pc

    fields = [("toxic_score", "double"), ("toxic_predicted", "int")] + ([("toxic_spans", "array<struct<start:int,end:int>>")] if spans else [])
    where = (lambda new: pc.equal(new[1], 0)) if clean_only else None
    return map_texts(docs, run, fields, docs.columns if keep is None else keep, text, where)


def offsets(raw: bytes, p: np.ndarray) -> list[dict[str, int]]:
    """Runs of toxic tokens as offsets into the text."""
    out: list[dict[str, int]] = []
    for i, m in enumerate(WORD.finditer(lowered(raw))):
        if p[i] >= THRESHOLD:
            if i and p[i - 1] >= THRESHOLD and out:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
    return out


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, load(spark, sf_dir, "labels"))
    out = score(docs, model, ["doc_id"])
    return out.select(
        "doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"), F.col("toxic_spans").alias("spans")
    )
