"""Interpolated modified Kneser-Ney scores of whole texts: word trigrams, with two begin marks and an end mark.

Counting: tasks turn their texts into word hashes and reduce runs of texts to distinct trigrams with counts, packed by
bucket of the middle word. So one task has all trigrams of its middle words: it sums them, and knows of each context (first
and middle word) its total and how many of its trigrams occur once, twice and more, and of each bigram (middle and last
word) in how many trigrams it stands last. It writes these as sorted arrays of hashes beside their counts, and sends on,
for each word, what it adds to the word's own sums: how often it occurs, in how many distinct bigrams it stands last, and
the sums of the bigrams that it begins. One task a bucket of words adds these up and writes sorted arrays of them. Middle
words so frequent that they would make a bucket outgrow the others are spread over several buckets by the last word, and a
context's sums are then added over these; the sample that finds such words steers only where rows go, never a result.

The highest order has the counts themselves, the lower ones the numbers of distinct words before a bigram or a word, and
every order has its own three discounts from its own counts of counts; the words' level falls back to the uniform
distribution.

Scoring: workers map these files into memory and look up the hashes of many texts at a time. An array of hashes is sorted;
it keeps 32 bits of each behind a table of where each group of first bits begins. What is gathered grows with the training
text, and so does the number of buckets; the driver gets one row of totals.

Defined cases: a null text counts as empty and is its end mark alone; repeated rows count and are scored each; a null
id is in the training part; an empty training part gives the uniform distribution; other columns are not looked at.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import load, map_texts, materialise, mix, mounted, publish, remainder, run_dir, small_batches

#: Words go by 48 bits of their hash, as do arrays of some millions of n-grams.
WORD_BITS = 48
#: Hashes that stand for the begin and the end of a text.
BEGIN, END = np.uint64(0x51ED270B27D4), np.uint64(0x8CB92BA72F3D)
#: Distinct trigrams are found over runs of so many bytes of text before anything is sent.
RUN_BYTES = 8 << 20
#: Bytes of training text whose trigrams make a bucket, about.
BUCKET_BYTES = 14 << 20
#: Words that would fill more than this share of a bucket are spread; it takes this share of the rows to find them.
HOT_SHARE, SAMPLE_SHARE = 0.25, 0.02

_MUL = np.uint64(0x9E3779B97F4A7C15)


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts laid end to end, each as two begin marks, its words and an end mark: index into the distinct hashes of
    each, these hashes (begin and end mark first), and how many there are of each text."""
    import xxhash

    if not texts:
        return np.empty(0, dtype=np.int64), np.array([BEGIN, END]), np.empty(0, dtype=np.int64)
    low = [t.lower() for t in texts]
    split = pc.ascii_split_whitespace(pa.array(low, pa.large_binary()).cast(pa.large_string(), safe=False))
    # a blank at either end leaves an empty string there
    flat = split.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    edge = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[split.offsets.to_numpy()]
    numbered = flat.filter(some).dictionary_encode()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, numbered.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(numbered.dictionary)) >> np.uint64(64 - WORD_BITS)
    n = np.diff(edge)
    sizes = n + 3
    ids = np.zeros(int(sizes.sum()), dtype=np.int64)
    ids[np.cumsum(sizes) - 1] = 1
    ids[np.arange(int(n.sum())) + np.repeat(3 * np.arange(len(n)) + 2, n)] = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 2
    return ids, np.concatenate([[BEGIN, END], h]), sizes


def trigrams(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the last words of trigrams stand: everywhere but at begin marks."""
    last = np.ones(len(ids), dtype=bool)
    starts = np.cumsum(sizes) - sizes
    last[starts] = last[starts + 1] = False
    return np.flatnonzero(last)


def distinct(ids: np.ndarray, at: np.ndarray, words: int, **more) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """First, middle and last word (indexes) of the distinct trigrams that end at these places, in order, and what else
    np.unique is asked for."""
    a, b, c = ids[at - 2], ids[at - 1], ids[at]
    if words < 1 << 21:
        key, *rest = np.unique((a * words + b) * words + c, **more)
        return key // (words * words), key // words % words, key % words, rest
    pair, of = np.unique(a * words + b, return_inverse=True)
    key, *rest = np.unique(of * words + c, **more)
    first = pair[key // words]
    return first // words, first % words, key % words, rest


def chained(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of a hash and what follows it."""
    return mix(x * _MUL + mix(y))


@dataclass(frozen=True)
class Deal:
    """Which bucket trigrams go to: that of their middle word, or, where it is hot, one of its own by their last word."""

    buckets: int
    hot: tuple = ()  # hashes, in order
    parts: tuple = ()  # into how many each is spread

    def spread(self, middle: np.ndarray) -> np.ndarray:
        out = np.ones(len(middle), dtype=np.uint64)
        if self.hot:
            hot = np.array(self.hot, dtype=np.uint64)
            at = np.minimum(np.searchsorted(hot, middle), len(hot) - 1)
            out = np.where(hot[at] == middle, np.array(self.parts, dtype=np.uint64)[at], out)
        return out

    def part(self, middle: np.ndarray, which: np.ndarray) -> np.ndarray:
        return (((middle >> np.uint64(16)) + which * np.uint64(0x3779B1)) % np.uint64(self.buckets)).astype(np.int64)

    def bucket(self, middle: np.ndarray, last: np.ndarray) -> np.ndarray:
        return self.part(middle, (last >> np.uint64(16)) % self.spread(middle))


def sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each value over them."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    head = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, dtype=np.int64)
    return (k[head], *(np.add.reduceat(v[order], head) if len(k) else v[:0] for v in values))


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays in few bytes: all first bytes of an array's numbers, then all second ones, and so on, compressed."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], dtype="<i8").tobytes()
    planes = [np.ascontiguousarray(a).view("u1").reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unsqueeze(blob: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(raw, "<i8", len(kinds) + 1)[1:], 8 * (len(kinds) + 1), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        w = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, "u1", n * w, at).reshape(w, n).T).view(kind).reshape(n))
        at += n * w
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """How far each number is from the one before it; the first as it is."""
    return np.diff(x, prepend=x[:1] * x.dtype.type(0))


def in_groups(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Sums along each run of equal groups: the inverse of steps_in_groups."""
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    c = np.cumsum(x.astype(np.int64))
    return c - np.repeat(c[head] - x[head], np.diff(np.append(head, len(x))))


def steps_in_groups(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How far each number is from the one before it in its run of equal groups; the first of a run as it is."""
    out = np.diff(x, prepend=x[:1] * 0)
    head = np.append(True, group[1:] != group[:-1])
    return np.where(head, x, out).astype(x.dtype)


#: Of a bucket's share of a run: common words, steps of the others, and of each trigram three indexes into these (the first by its step), and its count.
_NARROW, _WIDE = ("<u8", "<u8", "<u2", "<u2", "<u2", "<u4"), ("<u8", "<u8", "<u4", "<u4", "<u4", "<u4")
#: Of words: hash (by its steps), how often, distinct words before it, of the bigrams it begins: the sum of their distinct words before, and how many have one, two and more.
_WORDS = ("<u8", "<i8", "<i8", "<i8", "<i8", "<i8", "<i8")
_TABLE = np.dtype([("word", "<u8"), ("n", "<i8"), ("before", "<u4"), ("total", "<i8"), ("one", "<u4"), ("two", "<u4"), ("more", "<u4")])


def table_parts(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Arrays of a table of sorted hashes: where each group of first bits begins, 32 bits of each hash after these, and of
    each value a byte, with the places and values of those that don't fit."""
    bits = max(0, int(len(keys)).bit_length() - 6)
    groups = (keys >> np.uint64(64 - bits)) if bits else np.zeros(len(keys), dtype=np.uint64)
    out = [np.searchsorted(groups, np.arange((1 << bits) + 1, dtype=np.uint64)).astype("<u4"), (keys >> np.uint64(32 - bits)).astype("<u4")]
    for v in values:
        big = np.flatnonzero(v >= 255)
        out += [np.minimum(v, 255).astype("u1"), big.astype("<u4"), v[big].astype("<i8")]
    return out


def write_arrays(path: str, arrays: list[np.ndarray]) -> None:
    def write(f: str) -> None:
        with open(f, "wb") as out:
            out.write(np.array([len(arrays), *(len(a) for a in arrays)], dtype="<i8").tobytes())
            for a in arrays:
                out.write(np.ascontiguousarray(a).tobytes())

    publish(path, write)


def map_arrays(path: str, kinds: list[str]) -> list[np.ndarray]:
    raw = np.memmap(path, dtype="u1", mode="r")
    sizes, at, out = np.frombuffer(raw, "<i8", len(kinds) + 1)[1:].tolist(), 8 * (len(kinds) + 1), []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n, at) if n else np.empty(0, dtype=kind))
        at += n * np.dtype(kind).itemsize
    return out


_VALUE = ["u1", "<u4", "<i8"]
#: Values of the tables of trigrams, contexts and bigrams.
_VALUES = (1, 4, 1)
_KINDS = [k for n in _VALUES for k in ["<u4", "<u4"] + _VALUE * n]


class Table:
    """A table of sorted hashes, as table_parts lays it out."""

    def __init__(self, arrays: list[np.ndarray]):
        self.begins, self.keys, *rest = arrays
        self.values = [rest[i : i + 3] for i in range(0, len(rest), 3)]
        self.bits = (len(self.begins) - 1).bit_length() - 1

    def find(self, q: np.ndarray) -> np.ndarray:
        """The places of hashes, -1 where there is none: bisection within their groups, all side by side."""
        if not len(self.keys) or not len(q):
            return np.full(len(q), -1, dtype=np.int32)
        group = (q >> np.uint64(64 - self.bits)).astype(np.int32) if self.bits else np.zeros(len(q), dtype=np.int32)
        key = (q >> np.uint64(32 - self.bits)).astype(np.uint32)
        lo, end = self.begins[group].astype(np.int32), self.begins[group + 1].astype(np.int32)
        hi, top = end, np.int32(len(self.keys) - 1)
        for _ in range(int((hi - lo).max()).bit_length()):
            mid = (lo + hi) >> 1
            less = (self.keys[np.minimum(mid, top)] < key) & (lo < hi)
            lo, hi = np.where(less, mid + np.int32(1), lo), np.where(less, hi, mid)
        return np.where((lo < end) & (self.keys[np.minimum(lo, top)] == key), lo, np.int32(-1))

    def get(self, q: np.ndarray) -> list[np.ndarray]:
        """The values of hashes, 0 where there is none."""
        at = self.find(q)
        hit = at >= 0
        out = []
        for small, place, big in self.values:
            v = np.zeros(len(q), dtype=np.int64)
            v[hit] = small[at[hit]]
            large = np.flatnonzero(v == 255)
            if len(large):
                v[large] = big[np.searchsorted(place, at[large])]
            out.append(v)
        return out


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the totals. discounts: of counts 1, 2 and more, at orders 1 to 3; rest: the share of the
    words' level that goes to the uniform distribution."""

    path: str
    deal: Deal
    tokens: int
    vocabulary: int
    bigrams: int
    discounts: tuple
    rest: float


def hot_words(docs: DataFrame, work: str, buckets: int, share: float = SAMPLE_SHARE, text: str = "text") -> Deal:
    """The words that make up more of a sample than HOT_SHARE of a bucket's share, of which there are few."""
    least = HOT_SHARE / buckets

    def count(batches: Iterator[list[bytes]]) -> Iterator[list[pa.Array]]:
        for texts in batches:
            ids, h, _ = word_ids(texts)
            c = np.bincount(ids, minlength=len(h))
            many = np.flatnonzero(c > least / 4 * max(len(ids), 1))
            rows = [[] for _ in texts]
            if rows:
                rows[0] = [{"w": int(h[i].view(np.int64)), "n": int(c[i])} for i in many] + [{"w": None, "n": len(ids)}]
            yield [pa.array(rows, pa.list_(pa.struct([("w", pa.int64()), ("n", pa.int64())])))]

    found = map_texts(docs.sample(share, 11), count, [("c", "array<struct<w:bigint,n:bigint>>")], [], text).select(F.explode("c").alias("c")).select("c.*")
    found = materialise(found.groupBy("w").agg(F.sum("n").alias("n")), f"{work}/hot")
    every = found.filter("w IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # at most buckets / HOT_SHARE rows
    words = found.filter(F.col("w").isNotNull() & (F.col("n") > least * every)).collect()
    parts = sorted((int(np.int64(r["w"]).view(np.uint64)), int(-(-r["n"] // (least * every)))) for r in words) if every else []
    return Deal(buckets, tuple(w for w, _ in parts), tuple(min(n, buckets) for _, n in parts))


def train(docs: DataFrame, work: str, buckets: int | None = None, text: str = "text") -> Model:
    """Count the texts of docs and write the arrays under work (in the mounted shared folder)."""
    at = mounted(work)
    if buckets is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("n")).first()["n"]
        buckets = max(6, -(-size // BUCKET_BYTES))
    deal = hot_words(docs, work, buckets, text=text)
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def send() -> pa.RecordBatch:
            ids, h, sizes = word_ids(held)
            held.clear()
            a, b, c, (n,) = distinct(ids, trigrams(ids, sizes), len(h), return_counts=True)
            to = deal.bucket(h[b], h[c])
            order = np.argsort(to * np.int64(len(h)) + b, kind="stable")
            a, b, c, n, to = (v[order] for v in (a, b, c, n, to))
            edge = np.searchsorted(to, np.arange(buckets + 1))
            rows = []
            for k in range(buckets):
                i, j = edge[k], edge[k + 1]
                if i < j:
                    # the commonest words get the smallest numbers, the others are told by the steps of their hashes in
                    # order, and first words by their steps
                    own, of, often = np.unique(np.concatenate([a[i:j], b[i:j], c[i:j]]), return_inverse=True, return_counts=True)
                    rare = np.flatnonzero(often <= 2)
                    rare = rare[np.argsort(h[own[rare]])]
                    common = np.argsort(-often, kind="stable")[: len(own) - len(rare)]
                    first = np.concatenate([common, rare])
                    kind = "<u2" if len(own) <= 1 << 16 else "<u4"
                    number = np.empty(len(own), dtype=kind)
                    number[first] = np.arange(len(own))
                    x, y, z = number[of].reshape(3, -1)
                    order = np.lexsort((x, y))
                    x, y, z = x[order], y[order], z[order]
                    rows.append((k, kind == "<u4", squeeze(h[own[common]], steps(h[own[rare]]), steps_in_groups(x, y), y, z, n[i:j][order].astype("<u4"))))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["bucket", "wide", "blob"])

        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                held.append(t or b"")
                size += len(held[-1])
                if size >= RUN_BYTES:
                    yield send()
                    size = 0
        if held:
            yield send()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        for batch in batches:
            for k, wide, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                parts.setdefault(k, []).append((wide, blob))
        for k in list(parts):
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for wide, blob in parts.pop(k):
                common, rare, x, y, z, n = unsqueeze(blob, _WIDE if wide else _NARROW)
                h = np.concatenate([common, np.cumsum(rare, dtype=np.uint64)])
                context = chained(h[in_groups(x, y)], h[y])
                for col, v in zip(cols, (context, chained(context, h[z]), h[y], h[z], n), strict=True):
                    col.append(v)
            whole = np.concatenate(cols[1])
            order = np.argsort(whole)
            whole = whole[order]
            head = np.flatnonzero(np.append(True, whole[1:] != whole[:-1]))
            n = np.add.reduceat(np.concatenate(cols[4])[order].astype(np.int64), head)
            first, whole = order[head], whole[head]
            del order
            context, b, c = (np.concatenate(cols[i])[first] for i in (0, 2, 3))
            del cols, first
            classes = lambda v: ((v == 1).astype(np.int64), (v == 2).astype(np.int64), (v > 2).astype(np.int64))
            contexts, *sums = sum_by(context, n, *classes(n))
            bigram = chained(b, c)
            order = np.argsort(bigram, kind="stable")
            bigram = bigram[order]
            head = np.flatnonzero(np.append(True, bigram[1:] != bigram[:-1]))
            m = np.diff(np.append(head, len(bigram)))
            last, often = sum_by(c, n)
            b, c, bigram = b[order[head]], c[order[head]], bigram[head]
            write_arrays(f"{at}/grams/{k}.bin", table_parts(whole, n) + table_parts(contexts, *sums) + table_parts(bigram, m))
            begun, *own = sum_by(b, m, *classes(m))
            ended, before = sum_by(c, np.ones(len(c), dtype=np.int64))
            every = np.concatenate([last, ended, begun])
            blank = [np.zeros(len(v), dtype=np.int64) for v in (last, ended, begun)]
            w, *sums = sum_by(every, np.concatenate([often, *blank[1:]]), np.concatenate([blank[0], before, blank[2]]), *[np.concatenate([*blank[:2], v]) for v in own])
            to = (w >> np.uint64(24)) % np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            edge = np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64))
            rows, blobs = [], []
            for j in range(buckets):
                pick = order[edge[j] : edge[j + 1]]
                if len(pick):
                    rows.append(j)
                    blobs.append(squeeze(steps(w[pick]), *[v[pick] for v in sums]))
            rows.append(-1 - k)
            blobs.append(np.concatenate([np.bincount(np.minimum(v, 5), minlength=6) for v in (n, m)]).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        counts, own = np.zeros(12, dtype=np.int64), np.zeros(6, dtype=np.int64)
        words = tokens = bigrams = more = 0
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k < 0:
                    counts += np.frombuffer(blob, "<i8")
                else:
                    parts.setdefault(k, []).append(unsqueeze(blob, _WORDS))
        for k in list(parts):
            some = parts.pop(k)
            w = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in some])
            w, *sums = sum_by(w, *[np.concatenate([p[i] for p in some]) for i in range(1, len(_WORDS))])
            table = np.zeros(len(w), dtype=_TABLE)
            for name, v in zip(_TABLE.names, (w, *sums), strict=True):
                table[name] = v
            publish(f"{at}/words/{k}.bin", lambda f, x=table: x.tofile(f))
            words += int((sums[0] > 0).sum())
            tokens += int(sums[0].sum())
            bigrams += int(sums[1].sum())
            more += int((sums[1] > 2).sum())
            own += np.bincount(np.minimum(sums[1], 5), minlength=6)
        totals = [words, tokens, bigrams, more, *own[1:5].tolist(), *counts[7:11].tolist(), *counts[1:5].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in totals], names=names)

    names = ["words", "tokens", "bigrams", "more", *[f"c{o}{k}" for o in (1, 2, 3) for k in (1, 2, 3, 4)]]
    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket int, wide boolean, blob binary").repartitionById(buckets, F.col("bucket"))
    by_word = counted.mapInArrow(gather, "bucket int, blob binary").repartitionById(buckets, F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket")))
    totals = by_word.mapInArrow(finish, ", ".join(f"{n} bigint" for n in names))
    t = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    d = tuple(discounts(*(t[f"c{o}{k}"] for k in (1, 2, 3, 4))) for o in (1, 2, 3))
    rest = (d[0][0] * t["c11"] + d[0][1] * t["c12"] + d[0][2] * t["more"]) / max(t["bigrams"], 1)
    return Model(work, deal, t["tokens"], t["words"], t["bigrams"], d, rest)


def discounts(c1: int, c2: int, c3: int, c4: int) -> tuple[float, float, float]:
    """From counts of counts; where one is missing, the usual middle values."""
    if not c1 or not c2:
        return 0.5, 0.75, 0.9
    y = c1 / (c1 + 2 * c2)
    d = (1 - 2 * y * c2 / c1, 2 - 3 * y * c3 / c2 if c3 else 0.75, 3 - 4 * y * c4 / c3 if c3 and c4 else 0.9)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, start=1))


class Arrays:
    """The mapped files, opened when first needed."""

    def __init__(self, path: str):
        self.path, self.open = mounted(path), {}

    def grams(self, k: int) -> list[Table]:
        if k not in self.open:
            f = f"{self.path}/grams/{k}.bin"
            arrays = map_arrays(f, _KINDS) if os.path.exists(f) else [np.zeros(2, "<u4") if i in (0, 5, 19) else np.empty(0, kind) for i, kind in enumerate(_KINDS)]
            own, at = [], 0
            for n in _VALUES:
                own.append(Table(arrays[at : at + 2 + 3 * n]))
                at += 2 + 3 * n
            self.open[k] = own
        return self.open[k]

    def get(self, which: int, bucket: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Values (a row each) of hashes in the trigrams (0), contexts (1) or bigrams (2) of their buckets; 0 where there
        is none."""
        out = np.zeros((_VALUES[which], len(q)), dtype=np.int64)
        if not len(q):
            return out
        order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket, kind="stable")
        edge = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
        for i, j in zip(edge, [*edge[1:], len(q)], strict=True):
            pick = order[i:j]
            out[:, pick] = self.grams(int(bucket[pick[0]]))[which].get(q[pick])
        return out

    def words(self, hashes: np.ndarray, buckets: int) -> np.ndarray:
        """Rows of the word table; zeros for words that it lacks."""
        out = np.zeros(len(hashes), dtype=_TABLE)
        which = (hashes >> np.uint64(24)) % np.uint64(buckets)
        order = np.lexsort((hashes, which))
        edge = np.searchsorted(which[order], np.arange(buckets + 1, dtype=np.uint64))
        for k in range(buckets):
            pick = order[edge[k] : edge[k + 1]]
            if len(pick):
                name = f"words/{k}.bin"
                if name not in self.open:
                    f = f"{self.path}/{name}"
                    self.open[name] = np.memmap(f, dtype=_TABLE, mode="r") if os.path.exists(f) and os.path.getsize(f) else np.empty(0, dtype=_TABLE)
                table = self.open[name]
                if len(table):
                    at = np.minimum(np.searchsorted(table["word"], hashes[pick]), len(table) - 1)
                    hit = table["word"][at] == hashes[pick]
                    out[pick[hit]] = table[at[hit]]
        return out

    def contexts(self, deal: Deal, middle: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Sums of contexts over all buckets that their middle word is spread over."""
        out = np.zeros((_VALUES[1], len(q)), dtype=np.int64)
        spread = deal.spread(middle).astype(np.int64)
        before = np.empty((0, len(q)), dtype=np.int64)
        for part in range(int(spread.max(initial=0))):
            bucket = deal.part(middle, np.full(len(middle), part, dtype=np.uint64))
            pick = np.flatnonzero((spread > part) & (before != bucket).all(0))
            out[:, pick] += self.get(1, bucket[pick], q[pick])
            before = np.concatenate([before, bucket[None]])
        return out


def log_scores(texts: list[bytes], model: Model, arrays: Arrays) -> tuple[np.ndarray, ...]:
    """Of each text: tokens, tokens with c > 0, base score, model score."""
    ids, h, sizes = word_ids(texts)
    if not len(sizes):
        return tuple(np.empty(0) for _ in range(4))
    w = arrays.words(h, model.deal.buckets)
    at = trigrams(ids, sizes)
    token = ids[at]
    a, b, c, (back,) = distinct(ids, at, len(h), return_inverse=True)
    d1, d2, d3 = (np.array((0.0, *d)) for d in model.discounts)
    # words: in how many distinct bigrams they stand last, discounted towards the uniform distribution
    space = model.vocabulary + 1
    before = w["before"].astype(np.int64)
    p1 = (np.maximum(before - d1[np.minimum(before, 3)], 0) / model.bigrams + model.rest / space) if model.bigrams else np.full(len(h), 1 / space)
    # bigrams: in how many distinct trigrams they stand last
    pair, of = np.unique(b * np.int64(len(h)) + c, return_inverse=True)
    v, x = pair // len(h), pair % len(h)
    (m,) = arrays.get(2, model.deal.bucket(h[v], h[x]), chained(h[v], h[x]))
    total = w["total"][v].astype(np.float64)
    freed = d2[1] * w["one"][v] + d2[2] * w["two"][v] + d2[3] * w["more"][v]
    p2 = np.where(total > 0, (np.maximum(m - d2[np.minimum(m, 3)], 0) + freed * p1[x]) / np.maximum(total, 1), p1[x])
    # trigrams, of which those of one context are neighbours
    head = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    own = np.cumsum(head) - 1
    context = chained(h[a[head]], h[b[head]])
    total, one, two, more = arrays.contexts(model.deal, h[b[head]], context)
    (n,) = arrays.get(0, model.deal.bucket(h[b], h[c]), chained(context[own], h[c]))
    freed = d3[1] * one + d3[2] * two + d3[3] * more
    p3 = np.where(total[own] > 0, (np.maximum(n - d3[np.minimum(n, 3)], 0) + freed[own] * p2[of]) / np.maximum(total[own], 1), p2[of])
    n_word = w["n"].astype(np.float64)
    base = np.log10((n_word + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1)))
    sizes = sizes - 2
    cut = np.cumsum(sizes) - sizes
    add = lambda v: np.add.reduceat(v, cut)
    return sizes, add((n_word[token] > 0).astype(np.int64)), add(base[token]), add(np.log10(p3)[back])


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    def run(batches: Iterator[list[bytes]]) -> Iterator[list[pa.Array]]:
        arrays = Arrays(model.path)
        for texts in batches:
            n, known, base, own = log_scores(texts, model, arrays)
            yield [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())]

    return map_texts(docs, run, [("n_tokens", "bigint"), ("n_known", "bigint"), ("base_score", "double"), ("score", "double")], keep, text)


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id")) == 1).alias("held_out"))
    model = train(docs.filter("NOT held_out"), run_dir(spark, "kneser-ney"))
    out = score(docs, model, ["doc_id", "held_out"])
    per_token = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score", per_token)
