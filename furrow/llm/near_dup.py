"""Near-duplicate groups by HyperMinHash signatures, banding, and verification on full shingle sets.

A document's set is its distinct five-word shingles. Equal sets are one class from the start, so a group of copies of
any size is one row in all that follows. Each class gets REGISTERS HyperMinHash registers: an item's hash picks a
register and leaves the number of leading zeros of its rest and some mantissa bits behind that; the register keeps the
smallest rest in that short form. Sets of few items would leave registers empty, so they enter several times under
different seeds; the number of seeds is a power of two that follows from the set's size, and a set near the border of
two such powers is banded under both, so that sets similar enough to be linked always share one.

ROWS neighbouring registers make a band; classes that agree in a band share a bucket. Buckets are not turned into all
pairs. First each bucket's smallest member is its hub, and the other members are compared with it: the estimate from the
registers, corrected for chance collisions, first; then, where it doesn't rule a link out, the full sets. Links merge
components. Most buckets then lie within one component and are closed. In the others a member that is linked to the hub
can still be the bridge to one that is not, but by the triangle inequality of the Jaccard distance only if that one is
at least half similar to the hub; without such a member the linked ones leave the bucket. What is left of the open
buckets hangs together in clusters; a cluster is cut into chunks of about CHUNK members and CHUNK_BYTES at most, and each pair of chunks
is one task, which intersects their full sets exactly (as products of 0/1 matrices) and sends on one link for each two
components that have any. The work of this step grows with the square of a cluster of members that resemble each other
without being linked, but no task, and no row count between tasks, does.

Defined cases: a null text or one without words has an empty set and is its own component; fewer than five words are
one shingle; repeated rows are linked as equal sets; rows that share an id but not a set are told apart, and each has the
smallest id of its own component; a null id is left out of links (component null, kept true); an empty table gives an
empty result; columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import WordHashes, load, map_texts, materialise, mix, run_dir, small_batches

SHINGLE = 5
REGISTERS = 128
ROWS = 4
MANTISSA = 10
#: Items that a set should have, seeds counted, so that next to no register stays empty.
FULL = 512
SHARE = (3, 4)
#: Estimates under this leave no doubt that a pair isn't linked (over five standard errors at 128 registers).
SURELY_NOT = 0.55
#: Estimates under this leave no doubt that a pair isn't half similar.
SURELY_FAR = 0.30
#: Members of a cluster on either side of one task.
CHUNK = 512
#: And bytes of their sets.
CHUNK_BYTES = 32 << 20
#: Of the table that thins out documents; 2.1 MB of bits.
BITS = 1 << 24

_ODD = np.array([0x9E3779B97F4A7C15 * k % 2**64 | 1 for k in (1, 3, 5, 7, 11)], dtype=np.uint64)


def shingles(raw: bytes, hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word runs."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = hashes(words)
    m = max(n - k + 1, 1)
    out = h[:m] * _ODD[0]
    for j in range(1, min(k, n)):
        out += h[j : j + m] * _ODD[j % 5]
    if n < k:
        out += np.uint64(n)
    return np.unique(mix(out))


def seeds(n: int) -> int:
    """How many seeds a set of n items enters under: the power of two that fills FULL items."""
    t = 1
    while n * t < FULL:
        t *= 2
    return t


def seed_classes(n: int, num: int = SHARE[0], den: int = SHARE[1]) -> list[int]:
    """Of every size that a set of n items can be linked with."""
    return sorted({seeds(n), seeds(max(1, -(-n * num // den))), seeds(n * den // num)})


def smallest_rests(items: np.ndarray, ts: list[int]) -> np.ndarray:
    """For each number of seeds, the smallest rest of a hash that each of the REGISTERS registers has seen."""
    x = mix(items[None, :] ^ _SEEDS[: max(ts), None])
    bucket = (x >> np.uint64(57)).astype(np.int64)
    rest = (x << np.uint64(7)) | np.uint64(64)  # ends the run of zeros at last
    least = np.full((len(ts), REGISTERS), _NONE, dtype=np.uint64)
    for row, t in zip(least, ts, strict=True):
        np.minimum.at(row, bucket[:t].ravel(), rest[:t].ravel())
    return least


_NONE = np.uint64(2**64 - 1)
_SEEDS = np.array([0xA24BAED4963EE407 * (2 * s + 1) % 2**64 for s in range(FULL)], dtype=np.uint64)


def shortened(least: np.ndarray) -> np.ndarray:
    """Registers of 16 bits: 6 bits of leading zeros (more is rarer, kept inverted) over MANTISSA bits. 0xFFFF: empty."""
    # leading zeros from the exponent of the value; the top bit is then cut off and the mantissa follows it
    top = np.floor(np.log2(np.maximum(least, 1).astype(np.float64) * (1 - 2**-53))).astype(np.int64)
    top = np.minimum(top, 63)
    short = np.where(top > MANTISSA, least >> np.maximum(top - MANTISSA, 0).astype(np.uint64), least) & np.uint64((1 << MANTISSA) - 1)
    out = (top.astype(np.uint64) << np.uint64(MANTISSA)) | short
    return np.where(least == _NONE, 0xFFFF, out).astype("<u2")


def collisions(n: np.ndarray, m: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Chance that registers of disjoint sets of n and m items agree. Smallest rests fall off exponentially with rates in
    proportion to n and m; one at x shares its short form with a stretch of x / (2 ln 2) / 2^MANTISSA on average."""
    x = np.minimum(n, m) / np.maximum(n, m)
    return 2.0**-MANTISSA / (2 * np.log(2)) * x / (1 + x) ** 2 * np.ones_like(t, dtype=np.float64)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of registers (pairs x REGISTERS), corrected for chance collisions."""
    used = (a != 0xFFFF) | (b != 0xFFFF)
    same = ((a == b) & used).sum(1) / np.maximum(used.sum(1), 1)
    c = collisions(n.astype(np.float64), m.astype(np.float64), n)
    return np.clip((same - c) / (1 - c), 0, 1)


def bands(regs: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key for each band of each row of registers (t: its number of seeds), and which of them count: bands
    with an empty register don't."""
    r = regs.reshape(len(regs), -1, ROWS).astype(np.uint64)
    key = np.zeros(r.shape[:2], dtype=np.uint64)
    for j in range(ROWS):
        key = key << np.uint64(16) | r[:, :, j]
    place = np.arange(1, r.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = mix(mix(key) + place[None, :] + (t.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))[:, None])
    return key.astype(np.int64), (r != 0xFFFF).all(2)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, class (128-bit name of the set; null if it is empty)."""

    def run(batches: Iterator[list[bytes]]) -> Iterator[list[pa.Array]]:
        import xxhash

        hashes = WordHashes()
        for texts in batches:
            sets = [shingles(t, hashes) for t in texts]
            names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            classes = [seed_classes(len(s)) if len(s) else [] for s in sets]
            least = [smallest_rests(s, ts) for s, ts in zip(sets, classes, strict=True) if ts]
            regs = iter(shortened(np.concatenate(least)) if least else ())
            sigs = [[{"t": t, "regs": next(regs).tobytes()} for t in ts] for ts in classes]
            yield [pa.array(list(map(len, sets)), pa.int64()), pa.array(names, pa.binary()), pa.array(sigs, _SIGNATURE)]

    return map_texts(docs, run, [("n_shingles", "bigint"), ("class", "binary"), ("signatures", "array<struct<t:int,regs:binary>>")], [doc_id], text)


_SIGNATURE = pa.list_(pa.struct([("t", pa.int32()), ("regs", pa.binary())]))


def banded(classes: DataFrame) -> DataFrame:
    """key, rep of every band of every class under each of its seed classes."""
    small_batches(classes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(rep, s["t"], s["regs"]) for rep, sigs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for s in sigs]
            if rows:
                regs = np.frombuffer(b"".join(r[2] for r in rows), "<u2").reshape(len(rows), REGISTERS)
                key, counts = bands(regs, np.array([r[1] for r in rows], dtype=np.int64))
                rep = np.repeat(np.array([r[0] for r in rows], dtype=np.int64)[:, None], key.shape[1], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(key[counts]), pa.array(rep[counts])], names=["key", "rep"])

    return classes.select("rep", "signatures").mapInArrow(run, "key bigint, rep bigint")


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """hub, rep, guess: the estimate under the seeds that both have."""
    side = lambda p: classes.select(F.col("rep").alias(p), F.col("n_shingles").alias(f"{p}_n"), F.col("signatures").alias(f"{p}_s"))
    rows = pairs.join(side("rep"), "rep").join(side("hub"), "hub").select("hub", "rep", "hub_n", "rep_n", "hub_s", "rep_s")
    small_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in (2, 3))
            left, right = [], []
            for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                own = {s["t"]: s["regs"] for s in x}
                both = next(((own[s["t"]], s["regs"]) for s in y if s["t"] in own), None)
                left.append(both[0] if both else b"\x00" * 2 * REGISTERS)
                right.append(both[1] if both else b"\x01" * 2 * REGISTERS)
            a, c = (np.frombuffer(b"".join(v), "<u2").reshape(-1, REGISTERS) for v in (left, right))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(estimate(a, c, n, m))], names=["hub", "rep", "guess"])

    return rows.mapInArrow(run, "hub bigint, rep bigint, guess double")


def block_links(members: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """hub, rep: a link for each two components that have one within the pair of chunks. members: block (a pair of
    chunks), side (0, 1; 2: both, where a chunk meets itself), rep, component, items."""
    num, den = share

    def run(table: pa.Table) -> pa.Table:
        rep, component, side = (np.asarray(table.column(c).to_numpy()) for c in ("rep", "component", "side"))
        sets = [np.frombuffer(v.as_buffer(), "<u8") for v in table.column("items").combine_chunks()]
        size = np.array(list(map(len, sets)), dtype=np.int64)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        common = np.zeros((len(left), len(right)), dtype=np.float32)
        if len(left) and len(right):
            items, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(sets)), size)
            shared = often[at] > 1  # an item of one member is in no intersection
            column = np.cumsum(often > 1) - 1
            at, owner = column[at[shared]], owner[shared]
            order = np.argsort(at, kind="stable")
            at, owner = at[order], owner[order]
            for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 8192):
                i, j = np.searchsorted(at, [lo, lo + 8192])
                x = np.zeros((len(sets), 8192), dtype=np.float32)
                x[owner[i:j], at[i:j] - lo] = 1
                common += x[left] @ x[right].T
        union = size[left][:, None] + size[right][None, :] - common
        hit = (den * common >= num * union) & (component[left][:, None] != component[right][None, :])
        a, b = np.nonzero(hit)
        a, b = left[a], right[b]
        low, high = np.minimum(component[a], component[b]), np.maximum(component[a], component[b])
        _, one = np.unique(np.stack([low, high], 1), axis=0, return_index=True)
        return pa.table({"hub": pa.array(rep[a[one]], pa.int64()), "rep": pa.array(rep[b[one]], pa.int64())})

    return members.groupBy("block").applyInArrow(run, "hub bigint, rep bigint")


def chunk_pairs(members: DataFrame) -> DataFrame:
    """members (rep, component, cluster, items) once for each pair of chunks of its cluster that its chunk is in."""
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum(F.length("items")) / CHUNK_BYTES)).alias("chunks"))
    m = members.join(sizes, "cluster").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    own, other = F.col("chunk"), F.col("other")
    return m.select(F.struct("cluster", F.least(own, other).alias("i"), F.greatest(own, other).alias("j")).alias("block"), F.when(own == other, 2).when(own < other, 0).otherwise(1).alias("side"), "rep", "component", "items")


def full_sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, items (sorted 64-bit shingle hashes, little-endian) of the given classes (rep, id, class), from the whole texts
    of the documents of those ids.

    A bit table of fixed size, at most BITS / 63 rows, thins the documents out before their sets are shuffled to the
    ids; where there are more ids than it can tell apart it lets more through, and the join drops them."""

    def run(batches: Iterator[list[bytes]]) -> Iterator[list[pa.Array]]:
        import xxhash

        hashes = WordHashes()
        for texts in batches:
            items = [shingles(t, hashes).astype("<u8").tobytes() for t in texts]
            yield [pa.array(list(map(xxhash.xxh3_128_digest, items)), pa.binary()), pa.array(items, pa.binary())]

    place = F.pmod(F.xxhash64("id"), F.lit(BITS))
    word, mask = F.floor(place / 63), F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(id), {BITS}L) % 63 AS INT))")
    bits = reps.select(word.alias("__word"), mask.alias("__mask")).groupBy("__word").agg(F.bit_or("__mask").alias("__mask"))
    some = docs.withColumn("__w", word).join(F.broadcast(bits), F.col("__w") == F.col("__word")).filter(F.col("__mask").bitwiseAND(mask) != 0).select("id", "text")
    sets = map_texts(some, run, [("class", "binary"), ("items", "binary")], ["id"])
    # a class has one set, whichever of its rows with that id it is read from; by the join's keys, where its rows lie already
    return sets.join(reps.hint("merge"), ["class", "id"]).dropDuplicates(["class", "id"]).select("rep", "items")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """hub, rep, linked: whether SHARE[1] * intersection >= SHARE[0] * union on the full sets."""
    num, den = SHARE
    rows = pairs.join(sets.select("rep", F.col("items").alias("rep_items")), "rep")
    rows = rows.join(sets.select(F.col("rep").alias("hub"), F.col("items").alias("hub_items")), "hub").select("hub", "rep", "hub_items", "rep_items")
    small_batches(pairs.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yes = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                common = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0
                yes.append(den * common >= num * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(yes, pa.bool_())], names=["hub", "rep", "linked"])

    return rows.mapInArrow(run, "hub bigint, rep bigint, linked boolean")


def components(links: DataFrame, work: str) -> DataFrame:
    """node, component (smallest node reachable) of every node of links (a, b), by contraction. Each node points to the
    smallest around it; pointers are followed to their ends; nodes with one end become one node, and only links between
    different ones go on, so the links of a round are fewer than those before. Each step is written, so no lineage grows."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    both, rounds = materialise(both, f"{work}/both0"), []
    while not rounds or not both.isEmpty():
        k = len(rounds)
        label = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), f"{work}/label{k}")
        jump = 0
        while True:
            end = label.select(F.col("node").alias("component"), F.col("component").alias("end"))
            moved = materialise(label.join(end, "component").select("node", F.col("end").alias("component"), F.col("component").alias("was")), f"{work}/label{k}-{jump}")
            label, jump = moved.select("node", "component"), jump + 1
            if moved.filter("component < was").isEmpty():
                break
        rounds.append(label)
        of = lambda n: label.select(F.col("node").alias(n), F.col("component").alias(f"c{n}"))  # noqa: B023, E731
        both = both.join(of("a"), "a").join(of("b"), "b").filter("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        both = materialise(both, f"{work}/both{k + 1}")
    out = rounds.pop()
    for label in reversed(rounds):
        further = out.select(F.col("node").alias("component"), F.col("component").alias("end"))
        out = label.join(further, "component", "left").select("node", F.coalesce("end", "component").alias("component"))
    return materialise(out, f"{work}/components") if rounds else out


def groups(docs: DataFrame, work: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    # rows are numbered, and a class goes by its first row's number: ids may repeat, numbers don't
    rows = materialise(signatures(own, "id").withColumn("row", F.monotonically_increasing_id()), f"{work}/signatures")
    usable = rows.filter("id IS NOT NULL AND class IS NOT NULL")
    classes = usable.groupBy("class").agg(F.min("row").alias("rep"), F.min("id").alias("id"))
    # the signature is a function of the class, so any row's will do
    classes = materialise(classes.join(usable.select(F.col("row").alias("rep"), "n_shingles", "signatures"), "rep"), f"{work}/classes")
    named = classes.select("rep", "id", "class")
    open_ = materialise(banded(classes), f"{work}/bands")
    shared = open_.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    open_ = materialise(open_.join(shared.select("key"), "key", "left_semi"), f"{work}/open0")
    # most buckets of a group agree on their first member, so it is the hub of all of them
    hubs = open_.groupBy("key").agg(F.min("rep").alias("hub"))
    member = materialise(open_.join(hubs, "key").filter("rep != hub"), f"{work}/members")
    guess = materialise(estimated(member.select("hub", "rep").distinct(), classes), f"{work}/guess")
    close = guess.filter(F.col("guess") >= SURELY_NOT).select("hub", "rep")
    wanted = close.select(F.explode(F.array("hub", "rep")).alias("rep")).distinct()
    sets = materialise(full_sets(own, named.join(wanted, "rep", "left_semi")), f"{work}/sets")
    seen = guess.join(verified(close, sets), ["hub", "rep"], "left").select("hub", "rep", "guess", F.coalesce("linked", F.lit(False)).alias("linked"))
    seen = materialise(seen, f"{work}/seen")
    links = seen.filter("linked").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    label = components(links, f"{work}/first")
    # what is still open
    told = member.join(seen, ["hub", "rep"]).select("key", "rep", "linked", (~F.col("linked") & (F.col("guess") >= SURELY_FAR)).alias("half"))
    told = told.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    told = materialise(told, f"{work}/told")
    several = (F.min("component") != F.max("component")).alias("several")
    by_key = told.groupBy("key").agg(F.max("half").alias("any_half"), several).filter("several")
    left = told.join(by_key, "key").filter("any_half OR NOT linked").select("key", "rep", "component")
    again = left.groupBy("key").agg(several, F.min("rep").alias("first")).filter("several").select("key", "first")
    left = materialise(left.join(again, "key"), f"{work}/left")
    # a member ties its buckets' first members together: as a star around the smallest of them, not bucket by bucket
    star = left.groupBy("rep").agg(F.min("first").alias("low"))
    ties = left.join(star, "rep").select(F.col("low").alias("a"), F.col("first").alias("b")).unionAll(star.select(F.col("low").alias("a"), F.col("rep").alias("b")))
    cluster = components(ties.filter("a != b").distinct(), f"{work}/clusters")
    few = left.select("rep", "component").distinct().join(cluster.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep")
    few = materialise(few, f"{work}/open")
    few = materialise(few.join(full_sets(own, named.join(few.select("rep"), "rep", "left_semi")), "rep"), f"{work}/few")
    more = materialise(block_links(chunk_pairs(few)), f"{work}/more")
    if not more.isEmpty():
        label = components(links.unionAll(more), f"{work}/second")
    named = named.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = materialise(named.select("class", "id", "component"), f"{work}/named")
    # a component is told by its smallest id
    smallest = named.groupBy("component").agg(F.min("id").alias("smallest"))
    by_class = materialise(named.select("class", "component").join(smallest, "component").select("class", "smallest"), f"{work}/by_class")
    out = rows.select("id", "n_shingles", "class").join(by_class.hint("merge"), "class", "left")
    at = F.coalesce("smallest", "id")
    return out.select(F.col("id").alias(doc_id), "n_shingles", F.when(F.col("id").isNull(), None).otherwise(at).alias("component_id"), F.coalesce(F.col("id") == at, F.lit(True)).alias("kept"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(load(spark, sf_dir, "documents"), run_dir(spark, "near"))
