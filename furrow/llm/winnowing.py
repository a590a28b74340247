"""Document fingerprints by winnowing (DataFrame and SQL functions only).

The units are words. Every run of GRAM words has a cyclic polynomial (rolling) hash: the exclusive or of its words' hashes,
each rotated by its distance from the end of the run. Instead of rolling it along word by word, which has no column
function, the same values are made of their halves: runs of two from neighbouring words, runs of four from neighbouring
twos, and so on, so that a word is hashed once, and a run takes a few shifts. Of every WINDOW neighbouring hashes the
smallest is kept, the rightmost on ties, with its position. Two texts that share a run of at least GRAM + WINDOW - 1
words share a kept hash.

Hash and position are one number: 35 bits of hash above 28 bits that fall as the position grows; an array of 2^28 hashes
is the longest that Spark holds, so every position fits. Its minimum is then the smallest hash at its rightmost place, and
sliding minima come from zipping an array with itself shifted, so no window is ever listed.

Defined cases: a null text counts as empty; a text without words has the hash of its white space as its one entry
(an empty one has no entry); with fewer than GRAM words the whole sequence is one run; likeness is shared over all
distinct hashes, 1 if both have none; null and repeated ids follow one another by their texts' hashes; an empty table
gives an empty result; columns other than id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.llm.common import load

GRAM = 5
WINDOW = 4
#: Bits of a position, of those of a number above its sign.
PLACE = 28
_LOW = (1 << PLACE) - 1


def rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def doublings(size: int) -> list[int]:
    """By how much a run grows at each step, from one to size: powers of two, none more than it has come."""
    out, done = [], 1
    while done < size:
        out.append(1 << min(done, size - done).bit_length() - 1)
        done += out[-1]
    return out


def zipped(a: str, b: str, at: int, n: Column, fn) -> Column:
    """fn of the first n entries of a and of n entries of b from place `at` on."""
    n = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(at + 1), n), fn)


def winnow(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the array of kept (hash, position) numbers of a text column. The steps are columns of their own, so that
    none is worked out twice."""
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__words", F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    df = df.withColumn("__words", F.when((F.size("__words") == 0) & (F.length(whole) > 0), F.array(F.lit(" "))).otherwise(F.col("__words")))
    df = df.withColumn("__r1", F.transform("__words", lambda w: F.xxhash64(w))).drop("__words")
    n, done = F.size("__r1"), 1
    for by in doublings(GRAM):
        # a run of done + by words: one of done words, rotated by `by`, and the run of `by` words that follows it
        df = df.withColumn(f"__r{done + by}", zipped(f"__r{done}", f"__r{by}", done, n - (done + by - 1), lambda x, y: rotated(x, by).bitwiseXOR(y)))  # noqa: B023 (built at once)
        done += by
    runs = F.when(n >= GRAM, F.col(f"__r{GRAM}")).when(n > 0, F.array(F.xxhash64("__r1"))).otherwise(F.array().cast("array<bigint>"))
    pack = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, PLACE + 1), PLACE).bitwiseOR(F.lit(_LOW).cast("long") - i)
    df = df.withColumn("__m", F.transform(runs, pack)).drop(*[c for c in df.columns if c.startswith("__r") and c != "__range"])
    for by in doublings(WINDOW):
        m = F.size("__m")
        df = df.withColumn("__m", F.when(m > by, zipped("__m", "__m", by, m - by, lambda x, y: F.least(x, y))).otherwise(F.array(F.array_min("__m"))))
    return df.withColumn(out, F.array_compact(F.array_distinct("__m"))).drop("__m")


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, PLACE)))


def positions(fingerprint: Column) -> Column:
    """The word positions (from 0) of a fingerprint's entries."""
    return F.transform(fingerprint, lambda x: (F.lit(_LOW).cast("long") - x.bitwiseAND(F.lit(_LOW).cast("long"))).cast("int"))


def likeness(a: str, b: str) -> Column:
    """Of two columns of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(both / every)


def digest(fingerprint: Column) -> Column:
    """A short name of a fingerprint, positions included."""
    return F.md5(F.concat_ws(",", fingerprint.cast("array<string>")))


def in_ranges(docs: DataFrame, doc_id: str, ranges: int) -> DataFrame:
    """docs with __range, which grows with the id: ids are cut at approximate quantiles (null ids: a range before all).
    The driver gets the cuts, one number a range."""
    cuts = docs.agg(F.percentile_approx(doc_id, [i / ranges for i in range(1, ranges)], 100 * ranges).alias("q")).collect()[0]["q"] if ranges > 1 else None
    cuts = sorted({int(c) for c in cuts or []})
    if not cuts:
        where = F.lit(0)
    else:
        # how many cuts lie below an id, by bisection: steps of falling powers of two
        every, n = F.array(*[F.lit(c) for c in cuts]), len(cuts)
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
        where = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(every, at + step - 1) < F.col(doc_id)), at + step).otherwise(at))
    return docs.withColumn("__range", F.when(F.col(doc_id).isNull(), -1).otherwise(where))


def fingerprints(docs: DataFrame, ranges: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, next_text, fingerprint, next_fingerprint; the next row is that of the next id (after the last: the
    first), and repeated ids follow each other by their text's hash. Each range of ids is ordered on its own, and the
    first row of each range is what the last row of the range before it needs: no task orders more than a range."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranged = in_ranges(docs, "doc_id", ranges)
    placed = winnow(ranged.repartition(ranges, "__range"), "text", "fingerprint")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    own = Window.partitionBy("__range").orderBy(*order)
    rows = placed.withColumn("next_text", F.lead("text").over(own)).withColumn("next_fingerprint", F.lead("fingerprint").over(own))
    # one row a range: its first row, and the range that comes before it
    firsts = ranged.groupBy("__range").agg(F.min_by(F.col("text"), F.struct(F.col("doc_id").isNotNull(), "doc_id", F.xxhash64("text"))).alias("first_text"))
    by_range = Window.orderBy("__range")
    turn = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    keys = firsts.select("__range").withColumn("before", F.coalesce(F.lag("__range").over(by_range), F.max("__range").over(turn)))
    firsts = winnow(firsts, "first_text", "first_fingerprint").join(keys, "__range").select(F.col("before").alias("__range"), "first_text", "first_fingerprint")
    rows = rows.join(firsts.hint("shuffle_hash"), "__range", "left")
    last = F.col("next_text").isNull()
    return rows.select(
        "doc_id", "text", F.coalesce("next_text", "first_text").alias("next_text"), "fingerprint", F.when(last, F.col("first_fingerprint")).otherwise(F.col("next_fingerprint")).alias("next_fingerprint")
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = fingerprints(load(spark, sf_dir, "documents"), ranges)
    n = F.length("text")
    cut = (n / 4).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    rows = rows.select("doc_id", "n_chars", "edited", "fingerprint", "next_fingerprint")
    rows = winnow(rows, "edited", "edited_print")
    rows = rows.withColumns({"__a": hashes(F.col("fingerprint")), "__b": hashes(F.col("edited_print")), "__c": hashes(F.col("next_fingerprint"))})
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digest(F.col("fingerprint")).alias("fingerprint"), digest(F.col("edited_print")).alias("edited_fingerprint"),
        likeness("__a", "__b").alias("near_edited"), likeness("__a", "__c").alias("near_next"), positions(F.col("fingerprint")).alias("positions"),
    )
