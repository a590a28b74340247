"""Similarity join of shingle sets by partitions of the universe and the pigeonhole principle; exact at any threshold.

Two sets of sizes a <= b that link differ in few items, at most `most_apart(a)`. Shingles are hashed to the segments of a
band of sizes. If a set takes part in more segments than it may have differences, a partner equals it in at least one of
any `most_apart + 1` of them. So each set has a key for the contents of each of its segments, it may choose which of these
to ask with, and it chooses the cheapest by how many sets hold the same key. A key that no other set holds costs nothing,
so a set with enough of such keys has no partner and asks for none; that is the fate of nearly all sets.

A band holds the sizes from its bound to 25/16 of it; the smaller set of a pair asks in its own band, and sets just above
a band are indexed there as well. A set too small for segments (at most two differences) has one segment, with the
contents less any one or two items as further keys. An empty segment is no key: all sets that lack items there would meet.
A set that is left with too few segments that way asks in some of them twice, for the contents and for the contents less
any one item, which finds partners with one difference there; these one-deletion keys are made, for the segments asked,
in another pass over the texts, which is left out where no set is short. Last, and only if that is not enough, a set asks
in segments that it has empty.

Sets that share a key which one of them asks with are candidates, and are verified on their full sets: each with the
smallest one of the bucket first, which closes most buckets; what stays open is compared exactly in pairs of chunks.
By the triangle inequality of the Jaccard distance, a set that is linked to the smallest one can be linked to one that
isn't only if that one is near it (3/5 for a share of 4/5), so other sets leave the bucket.

Defined cases: a null text or one without words has an empty set and is its own component; fewer than five words are one
shingle; repeated rows are linked as equal sets; rows that share an id but not a set are told apart; a null id is left out
of links (component null); an empty table gives an empty result; columns other than id and text are not looked at.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import WordHashes, load, map_texts, materialise, mix, run_dir, small_batches
from furrow.llm.near_dup import block_links, chunk_pairs, components, full_sets, shingles

SHARE = (4, 5)
#: Spare segments of a band, as a part of those needed, and besides: what a set may leave empty, or be free to choose from.
SPARE, BESIDES = 0.15, 2
#: Differences of sets that have one segment.
FEW = 2
#: Bits of a key, and of the table that thins out keys before they are shuffled a second time (8 MB).
KEY_BITS, TABLE_BITS = 48, 1 << 26

_VALUE, _PLACE = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def shared_least(total: int, share: tuple[int, int]) -> int:
    """Items that two linked sets of `total` items together have in common at least."""
    num, den = share
    return -(-num * total // (num + den))


@lru_cache(1 << 16)
def most_apart(n: int, share: tuple[int, int] = SHARE) -> int:
    """Differences of a set of n items and a linked one of as many or more, at most."""
    num, den = share
    top = n + n * den // num
    return max(t - 2 * shared_least(t, share) for t in range(max(2 * n, top - num - den), top + 1))


@lru_cache(1 << 10)
def lost(n: int, share: tuple[int, int] = SHARE) -> int:
    """Items of a small set of n that a linked one may lack, at most (the smaller of the two is small)."""
    num, den = share
    partners = range(-(-n * num // den), n * den // num + 1)
    return max((n - shared_least(n + z, share) for z in partners if min(n, z) < bounds(share)[0]), default=0)


@lru_cache(8)
def bounds(share: tuple[int, int] = SHARE) -> tuple[int, ...]:
    """Lower bounds of the bands; sets under the first are small."""
    first = 1
    while most_apart(first, share) <= FEW:
        first += 1
    out = [first]
    while out[-1] < 1 << 40:
        out.append(out[-1] * share[1] ** 2 // share[0] ** 2 if out[-1] * share[1] ** 2 // share[0] ** 2 > out[-1] else out[-1] + 1)
    return tuple(out)


@lru_cache(1 << 10)
def segments_of(band: int, share: tuple[int, int] = SHARE) -> int:
    need = most_apart(bounds(share)[band + 1] - 1, share) + 1
    return need + int(SPARE * need) + BESIDES


def bands_of(n: int, share: tuple[int, int] = SHARE) -> tuple[int, bool]:
    """The band that a set of n asks in (-1: small), and whether it is indexed in the band below as well."""
    num, den = share
    b = bisect.bisect_right(bounds(share), n) - 1
    return b, b >= 0 and n <= (bounds(share)[b] - 1) * den // num


def digest(sums: np.ndarray, band: int, segment: np.ndarray, kind: int) -> np.ndarray:
    tag = mix(np.asarray(segment, dtype=np.uint64) + np.uint64((band + 2) << 40 | kind << 56))
    return mix(np.asarray(sums, dtype=np.uint64) + tag) >> np.uint64(64 - KEY_BITS)


def cut(items: np.ndarray, band: int, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a set: the segments that it has items in, the sums of their items' values, and these values by segment, which
    start at the places returned last."""
    m = segments_of(band, share)
    at = (mix(items ^ _PLACE) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
    order = np.argsort(at.astype(np.uint16) if m < 1 << 16 else at, kind="stable")
    at, value = at[order], mix(items ^ _VALUE)[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[first], value, first


def own_keys(items: np.ndarray, band: int, share: tuple[int, int]) -> np.ndarray:
    segment, value, first = cut(items, band, share)
    return digest(np.add.reduceat(value, first), band, segment, 0)


def small_keys(items: np.ndarray, deletions: int) -> np.ndarray:
    """Of the set, less any `deletions` items or fewer."""
    value = mix(items ^ _VALUE)
    total = value.sum(dtype=np.uint64)
    without = [value[list(c)].sum(dtype=np.uint64) for k in range(deletions + 1) for c in combinations(range(len(items)), k)]
    return digest(total - np.array(without, dtype=np.uint64), -1, np.zeros(len(without)), 0)


def keys_of(items: np.ndarray, share: tuple[int, int] = SHARE) -> tuple[np.ndarray, int, int]:
    """The keys of a set, how many of them (the first) it may ask with, and how many it needs; it needs more than it may
    ask with where it is short of segments."""
    n = len(items)
    band, below = bands_of(n, share)
    if band < 0:
        keys = small_keys(items, lost(n, share))
        return keys, len(keys), len(keys)
    own = own_keys(items, band, share)
    more = [own_keys(items, band - 1, share)] if below and band else [small_keys(items, lost(n, share))] if below else []
    return np.concatenate([own, *more]), len(own), most_apart(n, share) + 1


def wanted(items: np.ndarray, share: tuple[int, int] = SHARE) -> tuple[int, list[int], list[int]]:
    """For a set that is short: its band, the segments in which it asks twice, and the empty ones in which it asks."""
    n = len(items)
    band, _ = bands_of(n, share)
    if band < 0:
        return band, [], []
    segment, _, first = cut(items, band, share)
    short = most_apart(n, share) + 1 - len(segment)
    if short <= 0:
        return band, [], []
    size = np.diff(np.append(first, n))
    # a segment of one item would meet all that have none there, so those of several items come first
    twice = segment[np.lexsort((segment, size < 2))][:short].tolist()
    empty = np.setdiff1d(np.arange(segments_of(band, share)), segment)[: max(0, short - len(twice))].tolist()
    return band, [int(s) for s in twice], empty


def keys_within_one(items: np.ndarray, asked: dict[int, set[int]], share: tuple[int, int] = SHARE) -> Iterator[tuple[int, int, bool]]:
    """(segment, key, whether the set itself asks there) of the asked segments (by band): contents, and contents less any
    one item."""
    n = len(items)
    own, below = bands_of(n, share)
    band, twice, empty = wanted(items, share)
    for b in [own, own - 1] if below else [own]:
        here = asked.get(b)
        if b < 0 or not here:
            continue
        segment, value, first = cut(items, b, share)
        held = {int(s): value[i:j] for s, i, j in zip(segment, first, [*first[1:], n], strict=True)}
        for s in here:
            v = held.get(s, value[:0])
            total = v.sum(dtype=np.uint64)
            for key in digest(np.append(total - v, total), b, np.full(len(v) + 1, s), 1):
                yield s, int(key), b == band and (s in twice or s in empty)


#: A band and one of its segments as one number.
PLACE_BITS = 40


def signatures(docs: DataFrame, share: tuple[int, int]) -> DataFrame:
    """id, n_shingles, class (128-bit name of the set; null if it is empty), keys, asks, needs of every row, and of sets that
    are short of segments: where they ask besides (places) and with what (more)."""

    def run(batches: Iterator[list[bytes]]) -> Iterator[list[pa.Array]]:
        import xxhash

        hashes = WordHashes()
        for texts in batches:
            sets = [shingles(t, hashes) for t in texts]
            found = [keys_of(s, share) if len(s) else (np.empty(0, dtype=np.uint64), 0, 0) for s in sets]
            ends = np.cumsum([0, *(len(k) for k, _, _ in found)])
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([k for k, _, _ in found]).astype(np.int64) if found else [], pa.int64()))
            names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            places, more = [], []
            for s, (_, asks, needs) in zip(sets, found, strict=True):
                band, twice, empty = wanted(s, share) if needs > asks else (0, [], [])
                places.append([band << PLACE_BITS | k for k in twice + empty] or None)
                more.append([k for _, k, a in keys_within_one(s, {band: {*twice, *empty}}, share) if a] if needs > asks else None)
            yield [pa.array(list(map(len, sets)), pa.int64()), pa.array(names, pa.binary()), keys, *(pa.array([f[k] for f in found], pa.int64()) for k in (1, 2)), *(pa.array(x, pa.list_(pa.int64())) for x in (places, more))]

    arrays = [(n, "array<bigint>") for n in ("places", "more")]
    return map_texts(docs, run, [("n_shingles", "bigint"), ("class", "binary"), ("keys", "array<bigint>"), ("asks", "bigint"), ("needs", "bigint"), *arrays], ["id"], "text")


def thinned(rows: DataFrame, often: DataFrame) -> DataFrame:
    """The rows (with key) that may have one of the keys that occur often, by a bit table of fixed size."""
    place = lambda k: F.col(k) % TABLE_BITS  # noqa: E731  keys are hashes already, and not negative
    mask = lambda k: F.expr(f"shiftleft(1L, CAST({k} % {TABLE_BITS} % 63 AS INT))")
    bits = often.select(F.floor(place("key") / 63).alias("__word"), mask("key").alias("__mask")).groupBy("__word").agg(F.bit_or("__mask").alias("__mask"))
    marked = rows.withColumn("__w", F.floor(place("key") / 63))
    return marked.join(F.broadcast(bits), F.col("__w") == F.col("__word")).filter(F.col("__mask").bitwiseAND(mask("key")) != 0).drop("__w", "__word", "__mask")


def first_rows(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows that stand for their class, told by a bit a row that is sent to all tasks; keys are shuffled by no join."""
    mask = lambda k: F.expr(f"shiftleft(1L, CAST({k} % 63 AS INT))")
    bits = classes.select(F.expr("rep div 63").alias("__word"), mask("rep").alias("__mask")).groupBy("__word").agg(F.bit_or("__mask").alias("__mask"))
    marked = rows.withColumn("__w", F.expr("row div 63"))
    return marked.join(F.broadcast(bits), F.col("__w") == F.col("__word")).filter(F.col("__mask").bitwiseAND(mask("row")) != 0).drop("__w", "__word", "__mask")


def asked_buckets(rows: DataFrame, classes: DataFrame, work: str) -> DataFrame:
    """key, rep: all sets that share a key which one of them asks with, by the cheapest choice of each set. Of equal sets one
    takes part: all keys of a copy would else count as shared."""
    rows = first_rows(rows, classes)
    keys = rows.select(F.explode("keys").alias("key"))
    often = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), f"{work}/often")
    exploded = rows.select("row", "asks", F.posexplode("keys").alias("pos", "key")).select("row", "key", (F.col("pos") < F.col("asks")).alias("own"))
    held = materialise(thinned(exploded, often).select("row", "key", "own"), f"{work}/held")
    cost = held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = materialise(held.join(cost, "key"), f"{work}/shared")
    # what no other set holds is free; of the rest a set takes the cheapest that it still needs
    own = held.filter("own").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("shared"))
    take = F.greatest(F.lit(0), F.col("needs") - F.col("asks") + F.size("shared")).cast("int")
    asked = own.join(rows.select("row", "asks", "needs"), "row").select(F.explode(F.slice("shared", F.lit(1), take)).alias("c")).select("c.key").distinct()
    return held.join(asked, "key", "left_semi").select("key", F.col("row").alias("rep"))


def short_buckets(docs: DataFrame, rows: DataFrame, classes: DataFrame, share: tuple[int, int]) -> DataFrame | None:
    """key, rep of the buckets in which sets ask that are short of segments; None if there is no such set.

    The driver gets which segments of which bands are asked: no more than bands have segments. Another pass over the texts
    makes the keys of these segments, and those that nobody asks for are dropped before anything is shuffled."""
    asked: dict[int, set[int]] = {}
    for r in rows.select(F.explode("places").alias("p")).distinct().collect():
        asked.setdefault(r["p"] >> PLACE_BITS, set()).add(r["p"] & (1 << PLACE_BITS) - 1)
    if not asked:
        return None
    longest = bounds(share)[max(asked) + 2]  # no larger set lies in the bands asked, nor is indexed there

    def run(batches: Iterator[list[bytes]]) -> Iterator[list[pa.Array]]:
        import xxhash

        hashes = WordHashes()
        for texts in batches:
            names, keys = [], []
            for t in texts:
                items = shingles(t, hashes)
                held = [k for _, k, _ in keys_within_one(items, asked, share)] if 0 < len(items) < longest else []
                names.append(xxhash.xxh3_128_digest(items.tobytes()) if held else None)
                keys.append(held)
            yield [pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]

    wanted_keys = rows.select(F.explode("more").alias("key")).distinct()
    found = map_texts(docs, run, [("class", "binary"), ("keys", "array<bigint>")], ["id"]).filter("id IS NOT NULL").select("class", F.explode("keys").alias("key"))
    found = thinned(found, wanted_keys).join(wanted_keys, "key").select("key", "class").distinct()
    return found.join(classes.select("class", "rep"), "class").select("key", "rep")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """hub, rep, n, m, common: sizes of the two full sets, and what they have in common."""
    rows = pairs.join(sets.select("rep", F.col("items").alias("rep_items")), "rep")
    rows = rows.join(sets.select(F.col("rep").alias("hub"), F.col("items").alias("hub_items")), "hub").select("hub", "rep", "hub_items", "rep_items")
    small_batches(pairs.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                at = np.searchsorted(q, p)
                out.append((len(p), len(q), int((q[np.minimum(at, len(q) - 1)] == p).sum())))
            more = [pa.array([o[k] for o in out], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *more], names=["hub", "rep", "n", "m", "common"])

    return rows.mapInArrow(run, "hub bigint, rep bigint, n bigint, m bigint, common bigint")


def at_least(num: int, den: int) -> Column:
    return F.col("common") * den >= (F.col("n") + F.col("m") - F.col("common")) * num


def join(docs: DataFrame, work: str, share: tuple[int, int] = SHARE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    num, den = share
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = materialise(signatures(own, share).withColumn("row", F.monotonically_increasing_id()), f"{work}/signatures")
    usable = rows.filter("id IS NOT NULL AND class IS NOT NULL")
    # a class goes by its first row's number: ids may repeat, numbers don't
    classes = usable.groupBy("class").agg(F.min(F.struct("row", "id")).alias("first"), F.min("id").alias("low"))
    classes = materialise(classes.select("class", F.col("first.row").alias("rep"), F.col("first.id").alias("id"), "low"), f"{work}/classes")
    buckets = asked_buckets(usable, classes, work)
    more = short_buckets(own, usable, classes, share)
    if more is not None:
        buckets = buckets.unionAll(more)
    buckets = materialise(buckets, f"{work}/buckets")
    hubs = buckets.groupBy("key").agg(F.min("rep").alias("hub"))
    member = materialise(buckets.join(hubs, "key").filter("rep != hub"), f"{work}/members")
    pairs = materialise(member.select("hub", "rep").distinct(), f"{work}/pairs")
    reps = pairs.select(F.explode(F.array("hub", "rep")).alias("rep")).distinct()
    sets = materialise(full_sets(own, classes.select("rep", "id", "class").join(reps, "rep", "left_semi")), f"{work}/sets")
    seen = overlaps(pairs, sets).select("hub", "rep", at_least(num, den).alias("linked"), at_least(2 * num - den, den).alias("near"))
    seen = materialise(seen, f"{work}/seen")
    links = seen.filter("linked").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    label = components(links, f"{work}/first")
    # what is still open: buckets whose members lie in several components, without those that can't be linked across
    told = member.join(seen, ["hub", "rep"]).select("key", "rep", "linked", (F.col("near") & ~F.col("linked")).alias("half"))
    told = told.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    told = materialise(told, f"{work}/told")
    several = (F.min("component") != F.max("component")).alias("several")
    by_key = told.groupBy("key").agg(F.max("half").alias("any_half"), several).filter("several")
    left = told.join(by_key.select("key", "any_half"), "key").filter("any_half OR NOT linked").select("key", "rep", "component")
    again = left.groupBy("key").agg(several, F.min("rep").alias("first")).filter("several").select("key", "first")
    left = materialise(left.join(again, "key"), f"{work}/left")
    star = left.groupBy("rep").agg(F.min("first").alias("low"))
    ties = left.join(star, "rep").select(F.col("low").alias("a"), F.col("first").alias("b")).unionAll(star.select(F.col("low").alias("a"), F.col("rep").alias("b")))
    cluster = components(ties.filter("a != b").distinct(), f"{work}/clusters")
    few = left.select("rep", "component").distinct().join(cluster.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep")
    few = materialise(few.join(sets, "rep"), f"{work}/few")
    more_links = materialise(block_links(chunk_pairs(few), share), f"{work}/more")
    if not more_links.isEmpty():
        label = components(links.unionAll(more_links.select(F.col("hub").alias("a"), F.col("rep").alias("b"))), f"{work}/second")
    named = classes.select("class", "rep", "low").join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = materialise(named.select("class", "low", "component"), f"{work}/named")
    smallest = named.groupBy("component").agg(F.min("low").alias("smallest"))
    by_class = named.select("class", "component").join(smallest, "component").select("class", "smallest")
    out = rows.select("id", "n_shingles", "class").join(by_class, "class", "left")
    return out.select(F.col("id").alias(doc_id), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("smallest", "id")).alias("component_id"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(load(spark, sf_dir, "documents"), run_dir(spark, "join"))
