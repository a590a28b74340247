"""Exact order statistics of groups of any size.

Spark's percentile gathers the distinct values of a group in one task. Groups of more than `most` values go another way:
rank selection. Each rank starts with the range of its group's values; a pass counts the values in BUCKETS equal parts of
the range, merged per partition before anything is shuffled, and the part that holds the rank is the next range. Three
passes find a rank among a thousand million values; the passes end where a range is one value, whatever the values are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
#: Values of a group that a task may gather.
MOST = 1_000_000
#: Ranges that are broadcast to the rows at most; beyond that rows and ranges are joined by a shuffle.
RANGES = 10_000
c = F.col


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt over all tasks: rows of few files or partitions, each of which costs much."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _counted(rows: DataFrame, ranges: DataFrame, few: bool) -> DataFrame:
    """g, lo, hi, n, least, most, before: the values in each part of each range, and how many lie in the parts before."""
    span = c("hi") / 2 - c("lo") / 2  # halves, so that no difference overflows
    part = F.floor(F.try_divide(c("v") / 2 - c("lo") / 2, span) * (BUCKETS - 1))
    part = F.when(c("v") >= c("hi"), BUCKETS - 1).otherwise(F.least(F.coalesce(part, F.lit(0)), F.lit(BUCKETS - 2)))
    met = rows.join(F.broadcast(ranges) if few else ranges, "g").filter((c("v") >= c("lo")) & (c("v") <= c("hi")))
    parts = met.groupBy("g", "lo", "hi", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    w = Window.partitionBy("g", "lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("part")


def at_ranks(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """g, name, r, v: the value of rank r (from 0) of each group. rows: g, name, v; ranks: g, name, r, lo, hi (the least
    and the greatest value of the group)."""
    rows = rows.select(F.struct("g", "name").alias("g"), "v")
    left = ranks.select(F.struct("g", "name").alias("g"), "r", "lo", "hi", F.lit(0).cast("bigint").alias("below")).checkpoint()
    out = None
    while True:
        found = left.filter("lo = hi").select("g", "r", c("lo").alias("v"))
        out = found if out is None else out.unionByName(found)
        left = left.filter("lo < hi")
        ranges = left.select("g", "lo", "hi").distinct().checkpoint()
        n = ranges.limit(RANGES + 1).count()
        if not n:
            return out.select("g.g", "g.name", "r", "v")
        parts = _counted(rows, ranges, n <= RANGES)
        at = c("r") - c("below")
        held = left.join(parts, ["g", "lo", "hi"]).filter((at >= c("before")) & (at < c("before") + c("n")))
        left = held.select("g", "r", c("least").alias("lo"), c("most").alias("hi"), (c("below") + c("before")).alias("below")).checkpoint()


def summarise(df: DataFrame, by: list[str], aggs: list[Column], wants: dict[str, tuple[str, float]], most: int = MOST, write: bool = True) -> DataFrame:
    """df.groupBy(by).agg(aggs) with exact percentiles besides: wants has (column, share) by the name of each. Values
    between two ranks are interpolated; nulls and values that aren't finite take no part; a group without values has null.
    write: whether the values of large groups are written once and read by each pass, or made anew in each."""
    values = sorted({v for v, _ in wants.values()})
    finite = lambda v: c(v).isNotNull() & ~F.isnan(v) & (F.abs(c(v)) != float("inf"))
    large = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter(c("__n") > most).select(F.struct(F.lit(1).alias("__"), *by).alias("g")).checkpoint()
    small = {v: [n for n in wants if wants[n][0] == v] for v in values}
    gathered = [F.percentile(F.when(finite(v), c(v).cast("double")), [wants[n][1] for n in small[v]]).alias(f"__{v}") for v in values]
    named = [c(f"__{v}")[i].alias(n) for v in values for i, n in enumerate(small[v])]
    plain = lambda rows: rows.groupBy(*by).agg(*aggs, *gathered)
    if large.isEmpty():
        out = plain(df)
        return out.select(*[x for x in out.columns if not x.startswith("__")], *named)
    keyed = df.withColumn("g", F.struct(F.lit(1).alias("__"), *by))
    few = large.limit(RANGES + 1).count() <= RANGES
    keys = F.broadcast(large) if few else large
    rest = plain(keyed.join(keys, "g", "left_anti"))
    columns = [x for x in rest.columns if not x.startswith("__")]
    rest = rest.select(*columns, *named)
    if not by:  # without groups there is but the large one
        rest = rest.limit(0)
    big = keyed.join(keys, "g", "left_semi")
    long = F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.when(finite(v), c(v).cast("double")).alias("v")) for v in values]))
    rows = big.select("g", long.alias("x")).select("g", "x.*").filter("v IS NOT NULL")
    rows = rows.checkpoint() if write else rows
    sizes = rows.groupBy("g", "name").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    asked = F.explode(F.filter(F.array(*[F.struct(F.lit(v).alias("name"), F.lit(n).alias("out"), F.lit(float(p)).alias("p")) for n, (v, p) in wants.items()]), lambda x: x["name"] == c("name")))
    place = sizes.select("g", "name", "n", "lo", "hi", asked.alias("a")).select("g", "name", "lo", "hi", "a.out", ((c("n") - 1) * c("a.p")).alias("at"))
    place = place.withColumn("r", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))).checkpoint()
    found = at_ranks(rows, place.select("g", "name", "r", "lo", "hi").distinct())
    part = F.when(F.floor("at") == F.ceil("at"), 1.0).otherwise(1 - F.abs(c("at") - c("r")))
    value = place.join(found, ["g", "name", "r"]).groupBy("g", "out").agg(F.sum(part * c("v")).alias("v"))
    wide = value.groupBy("g").agg(*[F.max(F.when(c("out") == n, c("v"))).alias(n) for n in wants])
    whole = big.groupBy("g", *by).agg(*aggs).join(wide, "g", "left")
    return rest.unionByName(whole.select(*columns, *[n for v in values for n in small[v]]))
