"""The prefix trie of conversations, with a count-min sketch that tells which prefixes need no grouping.

A prefix of a conversation is named by its depth and 128 bits: the exclusive or, over its turns, of hashes of the turn's
place and content. Names of all prefixes are then running folds, and a prefix's name and its last turn give the name of
its parent. Texts are not moved: a turn is a digest and a length from the first step on.

A count-min sketch counts the names. It never counts too low, so where it says one, no other conversation has the prefix,
nor any longer one of the same conversation: such tails are emitted where they lie, row by row. Only prefixes of which the
sketch doesn't say so are shuffled and grouped exactly, and a tail's row whose parent is among them goes to it. The sketch has
DEPTH rows of as many cells as there are prefixes, times four, and WIDTH at most, so DEPTH * WIDTH bytes are broadcast at
most; beyond that it fills up, says one less often, and more prefixes are grouped, with the same result.

Sums over subtrees need no climbing: every node is told by its smallest conversation, so what lies below a node is what
its conversations tell from there on: one running sum along each conversation, and one sum over the conversations of each
node. Running folds are worked out per range of rows, and what a conversation has in the ranges before is added to it, so
a conversation of any length is spread over tasks.

Defined cases: rows without conv_id are left out; a null role or text is empty; null turns come first, and rows of the
same turn follow their digests; repeated rows are turns of their own; an empty table gives an empty result (without a
root); other columns are not looked at. The ends of one node are hashed in order by one task, which holds one at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.llm.common import load, materialise, mix, run_dir, small_batches

#: Turns that a conversation may take from the first of its hundred, less one; and conversations that share a first.
PREFIX_MOD, FAMILY = 6, 100
DEPTH, WIDTH = 3, 1 << 24
#: Cells of a block, in which partial sketches are sent and merged.
BLOCK = 1 << 20
NAME = ["depth", "p1", "p2"]


def running(rows: DataFrame, group: str, order: list[str], values: list[str], fold: Callable[[str], Column], both: Callable[[Column, Column], Column], work: str) -> DataFrame:
    """rows with each of the values folded over the rows of its group up to its own, in the given order.

    Rows are cut into ranges of group and order; what a group has folded before a range is one row a border between
    ranges, which is broadcast."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialise(rows.repartitionByRange(n, group, *order).withColumn("__part", F.spark_partition_id()), work)
    own = Window.partitionBy(group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = cut.groupBy(group, "__part").agg(*[fold(c).alias(c) for c in values])
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(group, "__part", *[fold(c).over(before).alias(f"__{c}") for c in values]).filter(F.col(f"__{values[0]}").isNotNull())
    out = cut.withColumns({c: fold(c).over(own) for c in values}).join(F.broadcast(carried), [group, "__part"], "left")
    return out.withColumns({c: both(F.col(c), F.coalesce(F.col(f"__{c}"), F.lit(0))) for c in values}).drop("__part", *[f"__{c}" for c in values])


def add(a: Column, b: Column) -> Column:
    return a + b


def numbered_turns(conversations: DataFrame, work: str) -> DataFrame:
    """conv_id, pos (from 1), digest, chars of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("bigint").alias("chars"), F.lit(1).cast("bigint").alias("pos"))
    return running(turns, "conv_id", ["turn", "digest"], ["pos"], F.sum, add, f"{work}/cut").select("conv_id", "pos", "digest", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, total (turns, may be 0) of every rebuilt conversation, and conv_id, depth, digest, chars, last of its turns.
    The turns that a family's conversations share are those of its first, PREFIX_MOD - 1 at most."""
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % PREFIX_MOD).cast("int"))
    first = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < PREFIX_MOD)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("first"))
    convs = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(first, "base", "left")
    head = F.slice(F.coalesce("first", F.array().cast("array<struct<pos:bigint,digest:binary,chars:bigint>>")), F.lit(1), F.col("h"))
    convs = convs.withColumn("head", head).withColumn("shared", F.size("head")).withColumn("total", F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    start = convs.select("conv_id", "total", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), F.col("t.digest").alias("digest"), F.col("t.chars").alias("chars"), "total")
    rest = turns.join(convs.select("conv_id", "h", "shared", "total"), "conv_id").filter("pos > h")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("shared")).alias("depth"), "digest", "chars", "total")
    return convs.select("conv_id", "total"), start.unionAll(rest).withColumn("last", F.col("depth") == F.col("total")).drop("total")


def named(turns: DataFrame, work: str) -> DataFrame:
    """conv_id, depth, p1, p2 (the prefix), q1, q2 (its parent, one less deep), chars, last of every turn."""
    own = [F.xxhash64(F.lit(k), "depth", "digest").alias(f"h{k}") for k in (1, 2)]
    rows = turns.select("conv_id", "depth", "chars", "last", *own).withColumns({"p1": F.col("h1"), "p2": F.col("h2")})
    rows = running(rows, "conv_id", ["depth"], ["p1", "p2"], F.bit_xor, lambda a, b: a.bitwiseXOR(b), f"{work}/cut")
    return rows.select("conv_id", *NAME, F.col("p1").bitwiseXOR(F.col("h1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("h2")).alias("q2"), "chars", "last")


def cells(depth: np.ndarray, p1: np.ndarray, p2: np.ndarray, width: int) -> np.ndarray:
    """The cells of names, one in each row of the sketch: DEPTH x names."""
    x = mix(p1.view(np.uint64) ^ mix(p2.view(np.uint64) + depth.astype(np.uint64)))
    return np.stack([(mix(x + np.uint64(r)) & np.uint64(width - 1)).astype(np.int64) + r * width for r in range(DEPTH)])


def added(counts: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Sums of counts that stop at 255."""
    return np.minimum(counts.astype(np.uint16) + more, 255).astype(np.uint8)


def columns(b: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [np.asarray(b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False)) for n in names]


def sketch(prefixes: DataFrame, width: int) -> np.ndarray:
    """Counts of the names in DEPTH rows of width cells. Tasks count on their own and send compressed blocks of cells, and
    each block is summed up as its parts come in."""
    small_batches(prefixes.sparkSession)
    block = min(BLOCK, DEPTH * width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(DEPTH * width, dtype=np.uint8)
        for b in batches:
            at, n = np.unique(cells(*columns(b, NAME), width), return_counts=True)
            own[at] = added(own[at], np.minimum(n, 255).astype(np.uint8))
        for i in range(0, len(own), block):
            if own[i : i + block].any():
                yield pa.RecordBatch.from_pydict({"block": [i // block], "counts": [zlib.compress(own[i : i + block].tobytes(), 1)]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        row = lambda: pa.RecordBatch.from_pydict({"block": [at], "counts": [zlib.compress(total.tobytes(), 1)]})
        for b in batches:
            for i, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i != at:
                    if at is not None:
                        yield row()
                    at, total = i, np.zeros(block, dtype=np.uint8)
                more = np.frombuffer(zlib.decompress(part.as_buffer()), dtype=np.uint8)
                total[: len(more)] = added(total[: len(more)], more)
        if at is not None:
            yield row()

    kind = "block bigint, counts binary"
    parts = prefixes.select(*NAME).mapInArrow(count, kind)
    out = np.zeros(-(-DEPTH * width // block) * block, dtype=np.uint8)
    for r in parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, kind).collect():
        out[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.uint8)
    return out[: DEPTH * width]


def screened(prefixes: DataFrame, widest: int = WIDTH) -> DataFrame:
    """The prefixes with single (the sketch proves that no other conversation has the prefix) and above (nor its parent).
    The root, which all conversations have, is never single."""
    spark, width = prefixes.sparkSession, 256
    rows = prefixes.count()
    while width < widest and width < 4 * rows:
        width *= 2
    counts = spark.sparkContext.broadcast(sketch(prefixes, width))
    names = prefixes.columns
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prefixes.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            depth, p1, p2, q1, q2 = columns(b, [*NAME, "q1", "q2"])
            single, above = (counts.value[cells(*x, width)].min(0) == 1 for x in ((depth, p1, p2), (depth - 1, q1, q2)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(single), pa.array(above & single & (depth > 1))], names=[*names, "single", "above"])

    return prefixes.mapInArrow(run, f"{kind}, single boolean, above boolean")


def ends_of(ended: DataFrame) -> DataFrame:
    """depth, p1, p2, ends: the SHA-256 of the ascending ids of the conversations that end at a node, joined by commas."""
    small_batches(ended.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        row = lambda: pa.RecordBatch.from_pydict({n: pa.array([v], k) for n, v, k in zip([*NAME, "ends"], [*at, state.hexdigest()], [pa.int64()] * 3 + [pa.string()], strict=True)})
        for b in batches:
            for *name, c in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if name != at:
                    if at is not None:
                        yield row()
                    at, state = name, hashlib.sha256(str(c).encode())
                else:
                    state.update(f",{c}".encode())
        if at is not None:
            yield row()

    rows = ended.select(*NAME, "conv_id").repartition(*NAME).sortWithinPartitions(*NAME, "conv_id")
    return rows.mapInArrow(run, "depth bigint, p1 bigint, p2 bigint, ends string")


def prefix_trie(conversations: DataFrame, work: str, widest: int = WIDTH) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    work: a folder for what is read more than once. widest: cells of a row of the sketch at most."""
    turns = materialise(numbered_turns(conversations, f"{work}/turns"), f"{work}/numbered")
    convs, rows = rebuilt(turns)
    convs = materialise(convs, f"{work}/convs")
    prefixes = materialise(named(rows, f"{work}/names"), f"{work}/prefixes")
    prefixes = materialise(screened(prefixes, widest), f"{work}/screened")
    no_end, one = F.sha2(F.lit("").cast("binary"), 256), F.lit(1).cast("bigint")
    tails = prefixes.filter("above").select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("bigint").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(no_end).alias("ends_sha256"),
    )
    heads = prefixes.filter("single AND NOT above")
    zero = F.lit(0).cast("bigint")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), zero.alias("q1"), zero.alias("q2"), zero.alias("chars"), (F.col("total") == 0).alias("last"))
    shared = prefixes.filter("NOT single").drop("single", "above").unionByName(root)
    nodes = shared.groupBy(*NAME).agg(*[F.min(c).alias(c) for c in ("conv_id", "q1", "q2", "chars")], F.count(F.lit(1)).alias("n_convs"))
    nodes = materialise(nodes, f"{work}/nodes")
    parents = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    children = nodes.filter("depth > 0").select(*parents).unionAll(heads.select(*parents)).groupBy(*NAME).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(nodes.join(children, NAME, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), f"{work}/grown")
    # what a conversation tells of the nodes whose smallest one it is, and of its end where that is its own
    told = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (F.col("n_children") == 0).cast("bigint").alias("leaves"))
    told = told.unionAll(prefixes.filter("single AND last").select("conv_id", "depth", zero, one)).selectExpr("conv_id", "-depth AS up", "0 AS asks", "0L AS p1", "0L AS p2", "saved", "leaves")
    asked = shared.selectExpr("conv_id", "-depth AS up", "1 AS asks", "p1", "p2", "0L AS saved", "0L AS leaves")
    below = running(told.unionAll(asked), "conv_id", ["up", "asks"], ["saved", "leaves"], F.sum, add, f"{work}/below")
    below = below.filter("asks = 1").groupBy((-F.col("up")).alias("depth"), "p1", "p2").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    own = nodes.join(below, NAME).join(ends_of(shared.filter("last")), NAME, "left")
    # a parent is told by its smallest conversation; one that wasn't grouped was proven to have no other than its child has
    ask = own.select("conv_id", "depth", "q1", "q2", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", no_end).alias("ends_sha256"))
    ask = ask.unionAll(
        heads.select("conv_id", "depth", "q1", "q2", one, F.when(F.col("last"), 0).otherwise(1).cast("bigint"), one, zero, F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(no_end))
    )
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    above = F.coalesce("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id"))).alias("parent_conv_id")
    found = ask.join(up, ["depth", "q1", "q2"], "left")
    return found.select(*[above if c == "parent_conv_id" else c for c in tails.columns]).unionAll(tails)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(load(spark, sf_dir, "conversations"), run_dir(spark, "trie"))


ORACLE = r"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
),
s AS (SELECT conv_id, list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)) AS bytes FROM (SELECT DISTINCT conv_id FROM t)),
c AS (
    SELECT conv_id, xor(4294967295, list_reduce(bytes, lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
    FROM s
),
b AS (SELECT c.conv_id, t.pos AS depth, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos <= h),
m AS (SELECT conv_id, count(*) AS m FROM b GROUP BY conv_id),
r AS (FROM b UNION ALL SELECT t.conv_id, pos - h + coalesce(m, 0), role, text FROM t JOIN c USING (conv_id) LEFT JOIN m USING (conv_id) WHERE pos > h),
p AS (
    SELECT conv_id, depth, text, sha256(to_json(list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY depth))::VARCHAR) AS node FROM r
    UNION ALL SELECT conv_id, 0, '', '' FROM c
),
n AS (SELECT node, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, length(min(text)) AS chars FROM p GROUP BY node),
l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
e AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM p JOIN l USING (conv_id, depth) GROUP BY node),
u AS (SELECT DISTINCT x.node, y.node AS up FROM p x JOIN p y ON x.conv_id = y.conv_id AND y.depth = x.depth - 1),
k AS (SELECT up AS node, count(*) AS n_children FROM u GROUP BY up),
w AS (SELECT DISTINCT x.node, y.node AS below FROM p x JOIN p y ON x.conv_id = y.conv_id AND y.depth >= x.depth),
v AS (
    SELECT w.node, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (k.node IS NULL) AS leaves FROM w JOIN n ON n.node = w.below LEFT JOIN k ON k.node = w.below GROUP BY w.node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM n JOIN v USING (node) LEFT JOIN k USING (node) LEFT JOIN e USING (node) LEFT JOIN u USING (node) LEFT JOIN n o ON o.node = u.up
"""
