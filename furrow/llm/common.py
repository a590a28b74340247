"""Small helpers that the corpus operators share: shared folders, Arrow mapping over texts, word hashing."""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.session import ship

#: White space of every contract: blank and the five ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch; keeps a batch of very long texts within a worker's memory.
BATCH_ROWS = 512


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and
    driver and executors are one process (elsewhere a folder of the driver's is an error, as executors can't read it)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.sparkContext.getCheckpointDir()
        if not at:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            at = "file://" + tempfile.mkdtemp(prefix="furrow-")
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def run_dir(spark: SparkSession, kind: str) -> str:
    """A new folder for one run, in the shared folder."""
    return f"{shared_dir(spark)}/furrow/{kind}-{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """The path under which tasks open files of the shared folder. Memory mapping needs a mounted folder, so other
    schemes than file: are an error."""
    u = urlparse(path)
    if u.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {u.scheme}:")
    return u.path


def publish(path: str, write: Callable[[str], None]) -> None:
    """Write a file under another name and rename it, so that a repeated or lost task leaves a whole file or none."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    write(part)
    os.replace(part, path)


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Cut the lineage with a written table in the shared folder; it outlives the executors that made it."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Before Python tasks: the package is sent, and Arrow batches are kept small."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def raw_texts(column: pa.Array) -> list[bytes]:
    """The texts of a batch in UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_texts(
    df: DataFrame, fn: Callable[[Iterator[list[bytes]]], Iterator[list[pa.Array]]], fields: list[tuple[str, str]], keep: list[str], text: str = "text", where: Callable[[list[pa.Array]], pa.Array] | None = None
) -> DataFrame:
    """Columns made of whole texts, beside the columns to keep, row by row.

    fn takes the texts of each batch and yields its new columns; where, if given, says from these which rows stay.
    A kept column with the name of a new one is replaced by it.
    """
    small_batches(df.sparkSession)
    names = [f for f, _ in fields]
    keep = [c for c in keep if c not in names]
    # a text that is kept is sent once
    own = [] if text in keep else [F.col(f"`{text}`").cast("string").alias("__text")]
    source = df.select(*[F.col(f"`{c}`") for c in keep], *own)
    at = keep.index(text) if text in keep else len(keep)
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]] + [f"`{n}` {k}" for n, k in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[list[bytes]]:
            for b in batches:
                held.append(b)
                yield raw_texts(b.column(at))

        for new in fn(texts()):
            b = held.pop(0)
            if b.num_rows:
                out = pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + new, names=keep + names)
                yield out.filter(where(new)) if where else out

    return source.mapInArrow(run, kinds)


def remainder(doc_id: Column, by: int = 5) -> Column:
    """crc32 of the id as text, modulo by; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal in, equal out, and all output bits depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Longer keys stay out of caches, which bounds these in bytes: texts without blanks are few long keys that never come back.
KEY_BYTES = 48


class Bounded(dict):
    """A cache that drops the older half of its entries when it is full (looked at once a batch).

    Keys have at most KEY_BYTES; an entry takes some 200 bytes, and no more than about 500, so size bounds it in bytes."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def room(self) -> None:
        if len(self) > self.size:
            young = list(itertools.islice(self.items(), len(self) - self.size // 2, None))
            self.clear()
            self.update(young)


class WordHashes:
    """64-bit hashes of words, kept for the words seen lately."""

    def __init__(self, size: int = 400_000):
        import xxhash

        self.cache, self.hash = Bounded(size), xxhash.xxh3_64_intdigest

    def __call__(self, words: list[bytes]) -> np.ndarray:
        c, h = self.cache, self.hash
        c.room()
        got = list(map(c.get, words))
        if None in got:
            for i, v in enumerate(got):
                if v is None:
                    w = words[i]
                    got[i] = v = h(w)
                    if len(w) <= KEY_BYTES:
                        c[w] = v
        return np.array(got, dtype=np.uint64)
