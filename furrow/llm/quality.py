"""Quality scores learned from preference pairs (Bradley-Terry).

A labelled document of quality 1 is preferred to one of quality 0. The score is linear in features of the whole text;
logistic loss on feature differences of pairs fits it. The cut between keeping and rejecting is a quantile of the
training scores, and a logistic curve maps scores to 0..1 so that the cut lies at the stated threshold.

The fit uses a bounded sample: at most SAMPLE labelled rows of either class, those with the smallest hash of their id.
Nothing else is bounded: every row is scored on its whole text.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import load, map_texts, remainder

#: Labelled rows of either class that a fit uses at most.
SAMPLE = 8_000
PAIRS = 120_000
THRESHOLD = 0.3

_CLASS = np.zeros(256, dtype=np.int64)
for _i, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b"\t\r\x0b\x0c", b".,;:", b"!?", b"'\"()-", b"|", b"#$%&*+/<=>@[]^_`{}~\\", range(128, 192), range(192, 256)), start=1):
    _CLASS[list(_chars)] = _i
_KINDS = 14


def features(raw: bytes) -> np.ndarray:
    """Shares of kinds of bytes, lengths, and how much words and lines repeat. Empty texts have all zeros but the first."""
    n = len(raw)
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256), minlength=_KINDS)
    share = kinds / max(n, 1)
    words = raw.split()
    w = len(words)
    out = np.zeros(_KINDS + 16)
    out[0] = 1.0 if n else 0.0
    out[1 : _KINDS + 1] = share
    if w:
        counts = Counter(words)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        top = counts.most_common(3)
        letters = kinds[1] + kinds[2] + kinds[13]
        more = out[_KINDS + 1 :]
        more[0] = np.log1p(w)
        more[1] = len(counts) / w
        more[2] = top[0][1] / w
        more[3] = sum(c for _, c in top) / w
        more[4] = sum(map(operator.eq, words, words[1:])) / w
        more[5] = len(set(lines)) / len(lines)
        more[6] = np.log1p(n / w)
        more[7] = kinds[2] / max(letters, 1)
        more[8] = np.log1p(len(lines)) - np.log1p(w)
        more[9] = (n - letters - kinds[4] - kinds[5]) / n
        more[10] = sum(len(x) == 1 for x in words) / w
        more[11] = np.log1p(max(map(len, words)))
        more[12] = np.sqrt(share[10] + share[11])
        more[13] = np.sqrt(share[8])
        more[14] = np.sqrt(1 - len(counts) / w)
    return out


WIDTH = _KINDS + 16


@dataclass(frozen=True)
class Ranker:
    """weights over standardised features; cut: the score at the threshold; slope of the curve."""

    mean: tuple
    scale: tuple
    weights: tuple
    cut: float
    slope: float
    threshold: float = THRESHOLD

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - np.array(self.mean)) / np.array(self.scale), -6, 6)
        return np.hstack([z, z * z]) @ np.array(self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.cut) * self.slope + at, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, rounds: int = 300, seed: int = 7) -> Ranker:
    """Fit by full-batch adaptive gradient steps on pairs drawn from (preferred, other). With one class only, every
    text counts as that class."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        kept = 40.0 if len(good) or not len(x) else -40.0
        return Ranker((0.0,) * WIDTH, (1.0,) * WIDTH, (0.0,) * (2 * WIDTH), -kept, 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    z = np.hstack([z, z * z])
    rng = np.random.default_rng(seed)
    g, b = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    i, j = rng.choice(g, pairs), rng.choice(b, pairs)
    w, second, speed = np.zeros(z.shape[1]), np.full(z.shape[1], 1e-8), 0.1
    for _ in range(rounds):
        s = z @ w
        p = 1 / (1 + np.exp(np.clip(s[i] - s[j], -40, 40)))  # how wrong each pair is
        pull = (np.bincount(i, weights=p, minlength=len(z)) - np.bincount(j, weights=p, minlength=len(z))) / pairs
        step = z.T @ pull - 1e-4 * w
        second += step * step
        w += speed * step / np.sqrt(second)
    s = z @ w
    cut = _quantile_cut(s, y)
    spread = float(np.median(s[y == 1]) - np.median(s[y == 0])) or 1.0
    return Ranker(tuple(mean), tuple(scale), tuple(w), cut, 8.0 / abs(spread))


def _quantile_cut(s: np.ndarray, y: np.ndarray) -> float:
    """The score quantile with the fewest errors in either class's share; between two scores it lies in the middle."""
    order = np.argsort(s, kind="stable")
    s, y = s[order], y[order]
    lost = np.concatenate([[0], np.cumsum(y == 1)]) / (y == 1).sum()
    caught = np.concatenate([[0], np.cumsum(y == 0)]) / (y == 0).sum()
    wrong = 2.0 * lost + (1 - caught)
    least = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    k = int(least[len(least) // 2])
    if k == 0:
        return float(s[0] - 1e-6)
    if k == len(s):
        return float(s[-1] + 1e-6)
    return float((s[k - 1] + s[k]) / 2)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, label of at most `size` learnable rows of either class (crc32(doc_id) mod 5 not 0, label known; of labels
    that contradict each other the greater counts)."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.filter(remainder(F.col("doc_id")) != 0)
    some = known.filter("label = 1").orderBy(F.xxhash64("doc_id")).limit(size).unionAll(known.filter("label = 0").orderBy(F.xxhash64("doc_id")).limit(size))
    # at most 2 x size rows of two numbers
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(some), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Ranker:
    """The driver gets the features of at most 2 x size rows, never their texts."""

    def measure(batches: Iterator[list[bytes]]) -> Iterator[list[pa.Array]]:
        for texts in batches:
            yield [pa.array([features(t).tolist() for t in texts], pa.list_(pa.float64()))]

    sample = labelled_sample(docs, labels, label, size, doc_id, text)
    rows = map_texts(sample, measure, [("features", "array<double>")], ["doc_id", "label"]).orderBy("doc_id").toPandas()
    x = np.array(rows["features"].tolist(), dtype=np.float64).reshape(-1, WIDTH)
    return fit(x, rows["label"].to_numpy())


def score(docs: DataFrame, model: Ranker, keep: list[str] | None = None, text: str = "text", accepted_only: bool = False) -> DataFrame:
    """The rows of docs with quality_score and quality_predicted (1 if the score reaches the threshold).

    Defined cases: null and empty texts are scored by their (zero) features; repeated rows are scored each; an empty
    table gives an empty result; columns with the names of the new ones are replaced, all others pass through.
    """

    def run(batches: Iterator[list[bytes]]) -> Iterator[list[pa.Array]]:
        for texts in batches:
            s = model.score(np.array([features(t) for t in texts]).reshape(-1, WIDTH))
            yield [pa.array(s), pa.array((s >= model.threshold).astype(np.int32))]

    import pyarrow.compute as pc

    where = (lambda new: pc.equal(new[1], 1)) if accepted_only else None
    return map_texts(docs, run, [("quality_score", "double"), ("quality_predicted", "int")], docs.columns if keep is None else keep, text, where)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, load(spark, sf_dir, "labels"))
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))
