"""Exact duplicates by a persistent index of text digests (DataFrame and SQL functions only).

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row per digest, held against the
index by a sort-merge anti-join that shuffles the batch alone, and what is new is appended under the batch's name. A group of copies of any
size is one row before anything is joined, and the last join, which gives each row its group, reads both sides through
plain exchanges, so that Spark splits hot groups there.

Defined cases: a null text counts as empty; a null id sorts after all others; repeated rows (same id, same text) are
copies of each other, and one of them stays; an empty table gives an empty result and leaves the index as it is; other
columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import SPACE, load, materialise, run_dir

BUCKETS = 64
#: Digests of a bucket after compaction, about; and files of a bucket, on average, that call for one.
BUCKET_ROWS, BUCKET_FILES = 4_000_000, 8


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


class DigestIndex:
    """The index under one path. Another session that opens the same path goes on with the same digests.

    Each version of the index is a folder of its own, named by its number and its buckets; the last that was written to
    its end counts. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        whole = [v for v in self._versions() if v[2]]
        self._open(*(max(whole)[:2] if whole else (0, buckets)))

    def _versions(self) -> list[tuple[int, int, bool]]:
        """Number, buckets, and whether it is whole (a version that batches are still appended to counts from its first)."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        found = [re.fullmatch(r"v(\d+)-b(\d+)", f.getPath().getName()) for f in files.listStatus(at)]
        return [(int(m[1]), int(m[2]), files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{m[0]}/_SUCCESS"))) for m in found if m]

    def _open(self, version: int, buckets: int) -> None:
        self.version, self.buckets = version, buckets
        self.table = self._create(version, buckets)

    def _create(self, version: int, buckets: int) -> str:
        at = f"{self.path}/v{version}-b{buckets}"
        table = "digest_index_" + hashlib.md5(at.encode()).hexdigest()
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{table}` (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{at}'"
        )
        return table

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, groups: DataFrame, batch: str) -> None:
        """Append the digests that the index lacks, under the name of their batch. groups: digest (once each), keep_id.
        Adding a batch again, after a job that died at whatever point, appends only what is still missing."""
        new = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        self._append(new.select("digest", "keep_id", F.lit(batch).alias("batch")), self.table, self.buckets)
        if len(self.rows().inputFiles()) > BUCKET_FILES * self.buckets:
            self.compact()

    def _append(self, rows: DataFrame, table: str, buckets: int) -> None:
        # dealt by the bucket itself, so that a batch adds one file to each bucket, whatever the shuffle's settings
        rows.repartitionById(buckets, F.pmod(F.hash("digest"), F.lit(buckets))).write.insertInto(table)
        self.spark.catalog.refreshTable(table)

    def compact(self, bucket_rows: int = BUCKET_ROWS) -> None:
        """Write the index anew, one sorted file a bucket and as many buckets as its size asks for. With one file a bucket,
        Spark relies on the order in which it was written."""
        buckets = max(1, -(-self.rows().count() // bucket_rows))
        version = 1 + max([v[0] for v in self._versions()], default=0)
        self._append(self.rows().select("digest", "keep_id", "batch"), self._create(version, buckets), buckets)
        self._open(version, buckets)


def exact_groups(docs: DataFrame, index: DigestIndex, work: str, batch: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size (rows of this batch with the text), kept, digest.

    keep_id is the smallest id of the batch that first brought the text; kept is true for one row of each text that
    this batch brought first. work: a folder for the digests of the batch, which are written once and read thrice.
    batch: its name; a batch that is run again under its name gives the same rows as it would have the first time.
    """
    spark, batch = docs.sparkSession, batch or work
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text)).cast("binary"), 256)).alias("digest"))
    keyed = materialise(keyed.withColumn("row", F.monotonically_increasing_id()), f"{work}/digests")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    groups = keyed.groupBy("digest").agg(first, F.count(F.lit(1)).alias("group_size"))
    groups = materialise(groups.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"), f"{work}/groups")
    index.add(groups, batch)
    known = groups.select("digest", "group_size", "keep_row").join(index.rows().hint("merge"), "digest")
    known = materialise(known, f"{work}/known")
    return keyed.join(known.hint("merge"), "digest").select(
        "doc_id", "keep_id", "group_size", ((F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))).alias("kept"), "digest"
    )


def keep_first(docs: DataFrame, index: DigestIndex, work: str, batch: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Rows are found again by id and digest; of rows alike in both, one."""
    stays = exact_groups(docs, index, work, batch, doc_id, text).filter("kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    keyed = docs.withColumn("__digest2", F.unhex(F.sha2(normalised(F.col(text)).cast("binary"), 256)))
    same = keyed[doc_id].eqNullSafe(stays["__id"]) & (keyed["__digest2"] == stays["__digest"])
    found = keyed.join(stays, same, "left_semi")
    return found.dropDuplicates([doc_id, "__digest2"]).drop("__digest2")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = run_dir(spark, "exact")
    out = exact_groups(load(spark, sf_dir, "documents"), DigestIndex(spark, f"{work}/index"), work)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g ON d.h = g.h
"""
