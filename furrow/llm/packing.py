"""Packing pieces of texts into as few fixed-capacity sequences as possible.

The pieces enter the optimisation only as a histogram over lengths, which has at most `capacity` entries whatever the
corpus. The configuration linear program over it
(one variable for each way to fill a sequence) is solved by multiplicative weights: every length has a price; a round
prices the best configurations by a knapsack dynamic program over the capacity, and the prices of the lengths that they
cover fall. The fractional solution is rounded to whole sequences and solved again for what is left, a few times; what
then remains is filled pattern by pattern, largest lengths first, each pattern repeated as often as the counts allow.
Both steps work on counts, so their cost doesn't grow with the number of pieces. Ranks of pieces within a length then
say which sequence and which place each piece gets.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from furrow.llm.common import load, map_texts, materialise, run_dir, small_batches
from furrow.llm.tokens import IdCoder, kept, vocabulary_path

CAPACITY = 4096
END_ID = 1
ROUNDS = 240
#: Rooms of the knapsack that are worked out at once.
BLOCK = 32
#: Fillings whose values differ by less count as equal, so rounding errors give up no length.
TIED = 1e-9
#: Of the linear program: how strongly prices follow the cover, how near the best and how many the
#: configurations of a round are, how much of a length may stay uncovered, and how often the program is solved.
WEIGHT, PRICED, WIDE, ERROR, SOLVED = 1.0, 0.05, 256, 0.05, 4


def best_fillings(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: for every room up to capacity the best value, and the length (its
    index) to take first, -1 where one unit is better left over. lengths are in order.

    A length is given up where the room of just that length is filled better without it: whatever fills that room can
    then stand for it anywhere, so the table stays exact. Rooms are worked out BLOCK at a time for the lengths of at least
    BLOCK, which only need rooms of earlier blocks, and one by one for the shorter ones.
    """
    short = int(np.searchsorted(lengths, BLOCK))
    starts = np.searchsorted(lengths, np.arange(0, capacity + 1 + BLOCK, BLOCK)).tolist()
    # rooms below nothing are worth less than nothing
    padded = np.full(BLOCK + capacity + BLOCK, -np.inf)
    rows = np.lib.stride_tricks.sliding_window_view(padded, BLOCK)
    best, take = [0.0], [-1]
    alive = np.empty(0, dtype=np.int64)
    few: list[tuple[int, float, int]] = []
    for k, lo in enumerate(range(0, capacity + 1, BLOCK)):
        hi = min(lo + BLOCK, capacity + 1)
        new = np.arange(max(starts[k], short), max(starts[k + 1], short))
        at = np.concatenate([alive, new])
        if len(at):
            with_one = rows[BLOCK + lo - lengths[at]] + values[at][:, None]
            which = with_one.argmax(0)
            top, which = with_one[which, np.arange(BLOCK)].tolist(), at[which].tolist()
        else:
            top, which = [-np.inf] * BLOCK, [-1] * BLOCK
        own = dict(zip(lengths[:short].tolist(), range(short), strict=True)) if not k else {}
        for c in range(max(lo, 1), hi):
            value, i = -np.inf, -1
            for n, v, j in few:
                x = best[c - n] + v
                if x > value:
                    value, i = x, j
            if c in own and values[own[c]] > value:
                value, i = float(values[own[c]]), own[c]
            if top[c - lo] > value:
                value, i = top[c - lo], which[c - lo]
            if value > best[c - 1]:
                best.append(value)
                take.append(i)
            else:
                best.append(best[c - 1])
                take.append(-1)
            if c in own and values[own[c]] >= (1 - TIED) * best[c]:
                few.append((c, float(values[own[c]]), own[c]))
        padded[BLOCK + lo : BLOCK + hi] = best[lo:hi]
        if len(new):
            alive = np.concatenate([alive, new[values[new] >= (1 - TIED) * np.array(best[lo:hi])[lengths[new] - lo]]])
    return np.array(best), np.array(take, dtype=np.int64)


def fractional_solution(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Configurations (indexes of lengths and how many of each) and how often to use each, by multiplicative weights on
    the covering constraints; and the share of its count to which the least covered length is covered.

    Prices start at the lengths, which are the dual solution where sequences can be filled to the end, and fall
    exponentially with what is covered. A round takes steps of equal size: one knapsack prices the best configuration
    around every length, and the step is shared among those within PRICED of the best, by how far the cover of that
    length lags behind: the WIDE that lag most. Rounds go on, to four times as many, until every length is covered to within ERROR.
    """
    covered = np.zeros(len(lengths))
    found: dict[tuple, float] = {}
    step = float((lengths * counts).sum()) / capacity / rounds
    last = np.arange(capacity + 1)
    limit = counts.astype(np.int64).tolist()
    for done in range(1, 4 * rounds + 1):
        values = lengths * np.exp(-WEIGHT * np.clip(covered / counts - (done - 1) / rounds, -1.0, 1.0))
        best, take = best_fillings(values, lengths, capacity)
        np.maximum.accumulate(np.where(take >= 0, np.arange(capacity + 1), 0), out=last)
        behind = np.maximum(min(done / rounds, 1.0) * counts - covered, 0) * lengths
        behind[values + best[capacity - lengths] < (1 - PRICED) * best[capacity]] = 0
        around = np.argsort(-behind, kind="stable")[:WIDE]
        around = around[behind[around] > 0]
        if not len(around):
            around, behind = np.array([take[last[capacity]]]), np.ones(len(lengths))
        often = step * behind[around] / behind[around].sum()
        # the configurations around all these lengths are read off the same table at once
        members, room = [around], last[capacity - lengths[around]]
        while (open_ := room > 0).any():
            i = np.where(open_, take[room], -1)
            members.append(i)
            room = np.where(open_, last[np.maximum(room - np.where(open_, lengths[i], 0), 0)], 0)
        for row, x in zip(np.stack(members, axis=1).tolist(), often.tolist(), strict=True):
            config = Counter(row)
            config.pop(-1, None)
            key = tuple(sorted((i, min(k, limit[i])) for i, k in config.items()))
            found[key] = found.get(key, 0.0) + x
            for i, k in key:
                covered[i] += k * x
        if done >= rounds and (covered / counts).min() >= 1 - ERROR:
            break
    return [(dict(k), v) for k, v in found.items()], float((covered / counts).min())


def planned(left: dict[int, int], capacity: int, rounds: int) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of sequences from the linear program; takes their pieces out of left.

    Every configuration takes part in the rounding: the fractions are summed in order and a sequence is made whenever
    the sum passes a whole number, as long as its pieces last; room that it leaves is filled. The program is solved again for what is left.
    """
    out = []
    for again in range(SOLVED):
        lengths = np.array(sorted(n for n, c in left.items() if c > 0), dtype=np.int64)
        if not len(lengths):
            break
        counts = np.array([left[int(n)] for n in lengths], dtype=np.float64)
        found, _ = fractional_solution(lengths, counts, capacity, rounds if not again else max(1, rounds // 4))
        # scaled once to the bound; where that is short of the cover, the next solution makes up for it
        scale = float((lengths * counts).sum()) / capacity / sum(v for _, v in found)
        plan = [({int(lengths[i]): k for i, k in c.items()}, v * scale) for c, v in found]
        plan = sorted(plan, key=lambda p: (-sum(n * k for n, k in p[0].items()), -max(p[0])))
        made, total = 0, 0.5
        for config, often in plan:
            times = min([int(total + often) - int(total), *(left[n] // k for n, k in config.items())])
            total += often
            if times > 0:
                made += times
                # what a configuration leaves open is filled with pieces that are left
                room = capacity - sum(n * k for n, k in config.items())
                if room:
                    spare = {n: (left[n] - config.get(n, 0) * times) // times for n in lengths[: np.searchsorted(lengths, room, side="right")].tolist()}
                    config = dict(Counter(config) + Counter(_closest(room, {n: c for n, c in spare.items() if c > 0})))
                out.append((config, times))
                for n, k in config.items():
                    left[n] -= k * times
        if made < total / 50:
            break
    return out


def patterns(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in one sequence, number of such sequences); every piece of the histogram is in one."""
    return [p for part in parts(histogram, capacity, rounds) for p in part]


def parts(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[list[tuple[dict[int, int], int]]]:
    """The patterns of pieces that are full already, of the linear program, and of the filling."""
    left = {int(n): int(c) for n, c in histogram.items() if c > 0}
    full = left.pop(capacity, 0)
    return [[({capacity: 1}, full)] if full else [], planned(left, capacity, rounds), _fill(left, capacity)]


def _fill(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """The rest: the largest piece, then the subset of the others that fills the gap best, as often as counts allow."""
    out = []
    open_ = sorted((n for n, c in left.items() if c > 0), reverse=True)
    while open_:
        config: dict[int, int] = {}
        room = capacity
        for n in open_:
            # the largest pieces first; a short list keeps the last gaps for the exact fit below
            k = min(room // n, left[n] - config.get(n, 0))
            if k > 0 and room - n >= 0:
                if room < capacity // 2:
                    break
                config[n] = config.get(n, 0) + 1
                room -= n
                if room < capacity // 2:
                    break
        for n, k in _closest(room, {n: left[n] - config.get(n, 0) for n in open_ if n <= room}).items():
            config[n] = config.get(n, 0) + k
        times = max(1, min(left[n] // k for n, k in config.items()))
        out.append((config, times))
        for n, k in config.items():
            left[n] -= k * times
        open_ = [n for n in open_ if left[n] > 0]
    return out


def _closest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """Pieces whose lengths sum as near below room as can be (bounded subset sum over bit sets, few largest kinds first)."""
    if not counts or room <= 0:
        return {}
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for n in sorted(counts, reverse=True):
        k, part = min(counts[n], room // n), 1
        while k > 0:
            m = min(part, k)
            new = (reach | reach << (n * m)) & mask
            if new != reach:
                steps.append((n, m, reach))
                reach = new
            k -= m
            part *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for n, m, before in reversed(steps):
        if not before >> at & 1:
            out[n] = out.get(n, 0) + m
            at -= n * m
    return out


def slots(chosen: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length in each pattern: from which rank of that length on, the first sequence, the first offset, how
    many of it a sequence has. Sorted by (length, first rank)."""
    rows, first, ranks = [], 0, {}
    for config, times in chosen:
        offset = 0
        for n in sorted(config, reverse=True):
            k = config[n]
            rows.append((n, ranks.get(n, 0), first, offset, k))
            ranks[n] = ranks.get(n, 0) + k * times
            offset += n * k
        first += times
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {k: a[:, i] for i, k in enumerate(("length", "rank", "sequence", "offset", "each"))}


def tokenised_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Each text's ids and then end_id, cut into pieces of at most capacity: doc_id, piece, start, length, ids_crc32
    and, if asked for, ids (little-endian unsigned 32-bit)."""
    path = path or vocabulary_path()
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[list[bytes]]) -> Iterator[list[pa.Array]]:
        coder = kept(IdCoder, path)
        for texts in batches:
            out = []
            for b in coder.batch(texts):
                b += end
                parts = [b[i : i + 4 * capacity] for i in range(0, len(b), 4 * capacity)]
                out.append([{"piece": i, "start": i * capacity, "length": len(p) // 4, "ids_crc32": zlib.crc32(p)} | ({"ids": p} if ids else {}) for i, p in enumerate(parts)])
            kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.binary())] if ids else [])))
            yield [pa.array(out, kind)]

    kind = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint" + (",ids:binary" if ids else "") + ">>"
    return map_texts(docs, cut, [("pieces", kind)], [doc_id], text).select(F.col(doc_id).alias("doc_id"), F.explode("pieces").alias("p")).select("doc_id", "p.*")


def pack(pieces: DataFrame, work: str, capacity: int = CAPACITY, rounds: int = ROUNDS, length: str = "length") -> DataFrame:
    """The rows of pieces with sequence_id and offset. work: a folder in the shared folder.

    Defined cases: an empty table packs to an empty table; repeated pieces are packed each; equal lengths are placed in
    the order of their partitions; columns named sequence_id or offset are replaced; other columns, nulls in them
    included, pass through (names that begin with two underscores are kept for the operator). Lengths outside 1..capacity are an error.
    """
    pieces = pieces.drop("sequence_id", "offset")
    spark = pieces.sparkSession
    small_batches(spark)
    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            ns = b.column(names.index(length)).to_pylist()
            rank = []
            for n in ns:
                if n is None or not 0 < n <= capacity:
                    raise ValueError(f"a piece of length {n} doesn't fit into sequences of {capacity}")
                seen[n] = r = seen.get(n, -1) + 1
                rank.append(r)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rank, pa.int64())], names=[*names, "__rank"])

    # ranks within a partition, and the partition; both are written, so that they stay what they are
    ranked = pieces.mapInArrow(numbered, schema + ", `__rank` bigint").withColumn("__part", F.spark_partition_id())
    ranked = materialise(ranked, f"{work}/pieces")
    by_part = ranked.groupBy(F.col(length).cast("bigint").alias("__n"), "__part").agg(F.count(F.lit(1)).alias("count"))
    before = Window.partitionBy("__n").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = materialise(by_part.withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0))), f"{work}/counts")
    # at most `capacity` rows, one for each length
    histogram = {r["__n"]: r["c"] for r in by_part.groupBy("__n").agg(F.sum("count").alias("c")).collect()}
    place = spark.sparkContext.broadcast(slots(patterns(histogram, capacity, rounds)))
    joined = ranked.join(by_part.drop("count").hint("merge"), (ranked[length] == by_part["__n"]) & (ranked["__part"] == by_part["__part"]))
    joined = joined.select(*[ranked[c] for c in names], (F.col("__rank") + F.col("__before")).alias("__rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = place.value
        wide = np.int64(1 << 40)
        keys = s["length"] * wide + s["rank"]
        for b in batches:
            n = np.asarray(b.column(names.index(length)).to_numpy(zero_copy_only=False), dtype=np.int64)
            r = np.asarray(b.column(len(names)).to_numpy(zero_copy_only=False), dtype=np.int64)
            i = np.searchsorted(keys, n * wide + r, side="right") - 1
            inside = r - s["rank"][i]
            seq, nth = s["sequence"][i] + inside // s["each"][i], inside % s["each"][i]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(s["offset"][i] + nth * n)], names=[*names, "sequence_id", "offset"])

    return joined.mapInArrow(placed, schema + ", `sequence_id` bigint, `offset` bigint")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every text (null: empty)."""
    work = run_dir(docs.sparkSession, "pack")
    return pack(tokenised_pieces(docs, capacity=capacity), work, capacity, rounds)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))
