"""Token sequences in training order, in binary shards of fixed stride.

The texts' ids, each text followed by an end id, form one tape: the texts of each task of the scan in their order, task
after task. It is written once, by the tasks that make the ids and without a shuffle, and is then what it is, whatever is
lost or run again. The tape is cut into sequences of a fixed number of tokens (the last one is padded). A keyed Feistel
permutation with cycle walking gives every sequence its slot: any worker computes it from the sequence's number alone, no
shuffle order is stored, and another key is another order. A shard holds a range of slots; slot s lies at
(s mod slots-per-shard) * stride in shard s div slots-per-shard, so a reader seeks to any step and a stopped training run
resumes there. The one shuffle moves the sequences to the tasks that write their ranges of shards; a task has at most
SHARDS_A_TASK of them, whatever the input.

write_shards is an action: when it returns, every shard is there, and so is the manifest, which it returns as a table.
Shards are written under another name and renamed, so a task that is lost or repeated leaves whole shards only. Folders
may be in any store that pyarrow can write to.

Defined cases: a null text counts as empty and gives its end id; the order of rows is that of the scan, whatever their
ids, null or repeated; repeated rows are written each; ids of the vocabulary that don't fit into the width are an error;
an empty table gives no sequence and no shard; other columns are not looked at, so their names can't clash.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import load, materialise, raw_texts, run_dir, small_batches
from furrow.llm.tokens import IdCoder, kept, vocabulary_path

LENGTH = 1024
END_ID = 1
PAD_ID = 0
#: Bytes of a shard, about.
SHARD_BYTES = 8 << 20
#: A task that writes shards holds the sequences of so many at most.
SHARDS_A_TASK = 4
KEY = 0x5DEECE66D
ROUNDS = 4


def feistel(x: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """The slot of each number under size: a keyed permutation of 0..size-1. Halves of equal width are mixed for
    ROUNDS rounds over the next even power of two; a number that lands at or above size walks on until it doesn't."""
    half = max(1, -(-int(max(size - 1, 1)).bit_length() // 2))
    h, mask = np.uint64(half), np.uint64((1 << half) - 1)
    rounds = [np.uint64((key * (2 * r + 1) + 0x9E3779B97F4A7C15 * (r + 1)) % 2**64) for r in range(ROUNDS)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> h, v & mask
        for k in rounds:
            f = (right + k) * np.uint64(0xD6E8FEB86659FD93)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xCA5A826395121157)
            left, right = right, left ^ (f >> np.uint64(32)) & mask
        return left << h | right

    out = once(x.astype(np.uint64))
    while (over := out >= np.uint64(size)).any():
        out[over] = once(out[over])
    return out.astype(np.int64)


@dataclass(frozen=True)
class Shape:
    """Of a set of shards: tokens a sequence, sequences, slots a shard, bytes a token."""

    length: int
    sequences: int
    slots: int
    width: int
    key: int

    @property
    def stride(self) -> int:
        return self.length * self.width

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.slots)


def tape(docs: DataFrame, work: str, width: int = 2, path: str | None = None, text: str = "text") -> tuple[DataFrame, int, dict[int, int]]:
    """The ids of all texts, written once: part (a task of the scan), start within it, number and ids (zstandard) of a run
    of texts; the number of all ids; and where each part starts on the tape. The driver gets one number a part."""
    path = path or vocabulary_path()
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, squeeze = kept(IdCoder, path, f"<u{width}"), zstandard.ZstdCompressor(level=6).compress
        if len(coder.ends) > 1 << 8 * width:
            raise ValueError(f"ids of this vocabulary don't fit into {width} bytes")
        at = 0
        for b in batches:
            ids, edge = coder.coded(raw_texts(b.column(0)))
            ids = np.insert(ids, edge[1:], END_ID)
            if len(ids):
                yield pa.RecordBatch.from_arrays([b.column(1)[:1], pa.array([at], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([squeeze(ids.tobytes())], pa.binary())], names=["part", "start", "n", "ids"])
            at += len(ids)

    source = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.spark_partition_id().alias("part"))
    runs = materialise(source.mapInArrow(encode, "part int, start bigint, n bigint, ids binary"), f"{work}/tape")
    starts, at = {}, 0
    for r in runs.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        starts[r["part"]] = at
        at += r["n"]
    return runs, at, starts


def write_shards(
    docs: DataFrame, out: str, work: str, length: int = LENGTH, key: int = KEY, shard_bytes: int = SHARD_BYTES, width: int = 2, path: str | None = None, text: str = "text"
) -> tuple[DataFrame, Shape]:
    """Write the shards of all texts under out, and return the manifest, which says of each sequence where it is:
    sequence_id, slot, shard, byte_offset, n_tokens (without padding), ids_crc32 (over the stride). work: a folder in the
    shared folder."""
    spark = docs.sparkSession
    runs, total, starts = tape(docs, work, width, path, text)
    sequences = -(-total // length)
    slots = max(1, shard_bytes // (length * width))
    shape = Shape(length, sequences, slots, width, key)
    small_batches(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, unsqueeze = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        for b in batches:
            for part, start, n, ids in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                # a run of texts is mostly whole sequences; only its two ends are parts of one
                first, ids = starts[part] + start, unsqueeze(ids)
                last = first + n
                s = np.arange(first // length, -(-last // length))
                low, high = np.maximum(s * length, first), np.minimum((s + 1) * length, last)
                slot = feistel(s, sequences, key)
                cuts = zip(((low - first) * width).tolist(), ((high - first) * width).tolist(), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((slot // slots).astype(np.int32)), pa.array(slot), pa.array(s), pa.array((low - s * length).astype(np.int32)), pa.array([squeeze(ids[i:j]) for i, j in cuts], pa.binary())],
                    names=["shard", "slot", "seq", "offset", "part"],
                )

    parts = runs.mapInArrow(cut, "shard int, slot bigint, seq bigint, offset int, part binary")
    # neighbouring shards go to one task
    tasks = max(1, -(-shape.shards // SHARDS_A_TASK))
    parts = parts.repartitionById(tasks, F.floor(F.col("shard").cast("bigint") * tasks / max(shape.shards, 1)).cast("int")).sortWithinPartitions("slot", "offset")
    pad = int(PAD_ID).to_bytes(width, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unsqueeze = zstandard.ZstdDecompressor().decompress
        done: list[tuple] = []
        shard, body, slot, seq, have = None, bytearray(), None, None, []

        def end_sequence() -> None:
            if slot is not None:
                ids = b"".join(have)
                whole = ids + pad * (length - len(ids) // width)
                body.extend(whole)
                done.append((seq, slot, shard, (slot - shard * slots) * length * width, len(ids) // width, zlib.crc32(whole)))

        def end_shard() -> None:
            if shard is not None:
                publish_shard(out, shard, bytes(body))
                body.clear()

        def told() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [[]] * 6
            done.clear()
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["sequence_id", "slot", "shard", "byte_offset", "n_tokens", "ids_crc32"])

        for b in batches:
            for h, s, q, part in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if s != slot:
                    end_sequence()
                    if h != shard:
                        end_shard()
                        shard = h
                    slot, seq, have = s, q, []
                have.append(unsqueeze(part))
            if done:
                yield told()
        end_sequence()
        end_shard()
        if done:
            yield told()

    rows = parts.mapInArrow(write, "sequence_id bigint, slot bigint, shard int, byte_offset bigint, n_tokens int, ids_crc32 bigint")
    return materialise(rows, f"{work}/manifest"), shape


def store(out: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    return fs.FileSystem.from_uri(out if "://" in out else "file://" + out.removeprefix("file:"))


def publish_shard(out: str, shard: int, body: bytes) -> None:
    """Write a shard under another name and rename it, so that a repeated or lost task leaves a whole one or none."""
    files, folder = store(out)
    files.create_dir(folder, recursive=True)
    at = f"{folder}/shard-{shard:06d}.bin"
    part = f"{at}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as f:
        f.write(body)
    files.move(part, at)


def read_slots(out: str, shape: Shape, first: int, count: int) -> Iterator[np.ndarray]:
    """Sequences in training order from slot `first` on, as a trainer reads them: a shard is opened once, at the first
    slot that is wanted of it, and read on."""
    files, folder = store(out)
    end = min(first + count, shape.sequences)
    while first < end:
        shard, place = divmod(first, shape.slots)
        n = min(shape.slots - place, end - first)
        with files.open_input_file(f"{folder}/shard-{shard:06d}.bin") as f:
            f.seek(place * shape.stride)
            for _ in range(n):
                yield np.frombuffer(f.read(shape.stride), dtype=f"<u{shape.width}")
        first += n


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = run_dir(spark, "order")
    rows, _ = write_shards(load(spark, sf_dir, "documents"), f"{work}/shards", work)
    return rows
