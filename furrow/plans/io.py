"""SRC1-SRC6, SNK1-SNK3, ST1-ST4 over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators import grid as G
from furrow.plans import hydrology as PH
from furrow.plans.feeds import FEEDS, feed, oracle
from furrow.sources import files as I
from furrow.streaming import rain as ST

FEEDS["gauges"] = """SELECT user_id AS gauge_id, ts, value / 1e2 AS rain_mm, event_id FROM events"""

QUERIES, ORACLES = {}, {}
c = F.col


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = oracle(sql)
        return fn

    return add


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder in the folder that driver and executors share; one of the driver's own only where these are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        import tempfile

        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="furrow-")
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/furrow/{kind}-{uuid.uuid4().hex}"


def run_stream(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], kind: str, done: list | None = None) -> DataFrame:
    """Run a stream (build makes it of its source) over parts that arrive one after another, into a table of the shared
    folder, and read that back. Each part is written by all its tasks; the stream then takes it, goes to rest, and goes on
    from its checkpoint with the next. done: gets the progress of each run's last batches."""
    spark, at = parts[0].sparkSession, scratch(parts[0].sparkSession, kind)
    for part in parts:
        part.write.mode("append").parquet(f"{at}/source")
        stream = build(spark.readStream.schema(parts[0].schema).parquet(f"{at}/source"))
        q = stream.writeStream.format("parquet").option("path", f"{at}/table").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        if done is not None:
            done.append(q.recentProgress)
    return spark.read.schema(stream.schema).parquet(f"{at}/table")


def halves(df: DataFrame, by: str) -> list[DataFrame]:
    """The rows up to about the median of a column, and the others."""
    key = c(by).cast("double")
    half = df.agg(F.percentile_approx(key, 0.5).alias("h")).collect()[0]["h"]
    return [df.filter(key <= half), df.filter(key > half)]


def _gauges(spark, d):
    """The gauges' records in two parts, and two records far ahead, so that the watermark passes the last of them."""
    df = feed(spark, d, "gauges").select("gauge_id", c("ts").cast("timestamp").alias("ts"), "rain_mm")
    ahead = [spark.sql(f"SELECT CAST(-1 AS BIGINT) AS gauge_id, TIMESTAMP '{y}-01-01 00:00:00' AS ts, 0e0 AS rain_mm") for y in (2100, 2101)]
    return [*halves(df, "ts"), *ahead]


@query("src1_features", """SELECT l_orderkey AS feature_id, 0 AS part, 0 AS ring, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS seq, l_quantity AS x, l_linenumber * 1e0 AS y, NULL::DOUBLE AS z FROM lineitem""")
def src1(spark, d):
    v = feed(spark, d, "SELECT l_orderkey AS feature_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, l_quantity AS x, l_linenumber * 1e0 AS y FROM lineitem")
    p = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    js = v.groupBy("feature_id").agg(p.alias("p")).select("feature_id", F.to_json(F.struct(F.struct(F.lit("LineString").alias("type"), F.transform("p", lambda q: F.array(q["x"], q["y"])).alias("coordinates")).alias("geometry"))).alias("json"))
    return I.features_from_json(js)[1]


@query("src2_cells", "SELECT CAST(floor(p_partkey / 5e1) AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col, CASE WHEN p_size <> 1 THEN p_retailprice END AS v FROM part")
def src2(spark, d):
    df = feed(spark, d, "SELECT CAST(floor(p_partkey / 5e1) AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col, CASE WHEN p_size = 1 THEN -9999e0 ELSE p_retailprice END AS v FROM part")
    return G.load_cells(df, -9999.0)


@query("src3_ground_points", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 2")
def src3(spark, d):
    return I.ground_points(feed(spark, d, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber AS classification FROM lineitem")).drop("classification")


@query("src4_catalog_members", "SELECT s_nationkey AS id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS position, s_suppkey AS member FROM supplier")
def src4(spark, d):
    rows = feed(spark, d, "SELECT s_nationkey AS id, s_suppkey FROM supplier").groupBy("id").agg(F.array_sort(F.collect_list("s_suppkey")).alias("members"))
    return I.catalog_tables(rows)["members"]


@query("src5_scan_files")
def src5(spark, d):
    return I.scan_files(spark, f"{d}/*.parquet").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "size", "sha256", "signature_ok")


@query("src6_find_id_column", """SELECT 's_suppkey' AS "column", count(*) AS found, count(*) = 3 AS candidate FROM supplier WHERE s_suppkey IN (3, 27, 61) UNION ALL SELECT 's_nationkey', count(DISTINCT s_nationkey), count(DISTINCT s_nationkey) = 3 FROM supplier WHERE s_nationkey IN (3, 27, 61) UNION ALL SELECT 's_name', 0, false""")
def src6(spark, d):
    return I.find_id_column(feed(spark, d, "SELECT s_suppkey, s_name, s_nationkey FROM supplier"), ["3", "27", " 61 "])


@query("snk1_layers", "SELECT 'lines' AS layer, count(*) AS n FROM lineitem UNION ALL SELECT 'nodes', count(*) FROM orders")
def snk1(spark, d):
    at = I.write_layers({"lines": feed(spark, d, "SELECT l_orderkey, l_linenumber FROM lineitem"), "nodes": feed(spark, d, "SELECT o_orderkey FROM orders")}, scratch(spark, "layers"))
    n = lambda t: spark.read.parquet(f"{at}/{t}.parquet").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("layer"), "n")
    return n("lines").unionAll(n("nodes"))


@query("snk2_series", "SELECT user_id AS gauge_id, event_id, value AS depth, event_id * 5e0 AS minutes FROM events")
def snk2(spark, d):
    at = scratch(spark, "series")
    I.write_series(feed(spark, d, "SELECT user_id AS gauge_id, value AS depth, event_id, event_id * 3e2 AS minutes FROM events"), at, ["gauge_id", "event_id", "minutes", "depth"], ("minutes",))
    return spark.read.schema("gauge_id bigint, event_id bigint, minutes double, depth double").csv(at, header=True)


@query("snk3_geojson", """SELECT l_orderkey AS feature_id, count(*) AS vertices, round(sum(l_quantity), 6) AS sum_x, round(sum(l_discount), 6) AS sum_z FROM lineitem GROUP BY l_orderkey""")
def snk3(spark, d):
    v = feed(spark, d, "SELECT l_orderkey AS feature_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, l_quantity AS x, l_tax AS y, l_discount AS z FROM lineitem")
    js = I.to_geojson(v, feed(spark, d, "SELECT o_orderkey AS feature_id, o_orderstatus AS status FROM orders"))
    got = js.select("feature_id", F.from_json("feature_json", "geometry struct<coordinates:array<array<double>>>, properties struct<source_elevations:array<double>>").alias("f"))
    add = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 6)
    return got.select("feature_id", F.size("f.geometry.coordinates").cast("bigint").alias("vertices"), add(F.transform("f.geometry.coordinates", lambda p: p[0])).alias("sum_x"), add(c("f.properties.source_elevations")).alias("sum_z"))


@query("st1_stream_rain", "SELECT gauge_id, time_bucket(INTERVAL '30 minutes', ts) AS start, round(sum(rain_mm), 6) AS depth_mm, round(sum(rain_mm) * 2, 6) AS intensity_mm_h, count(*) AS n FROM gauges GROUP BY ALL")
def st1(spark, d):
    out = run_stream(_gauges(spark, d), lambda s: ST.stream_rain(s, "30 minutes", None, "10 minutes"), "rain").filter("gauge_id >= 0")
    return out.withColumns({"depth_mm": F.round("depth_mm", 6), "intensity_mm_h": F.round("intensity_mm_h", 6)})


def _excess(spark, d, done=None):
    """Intervals a minute apart in two parts; then a record far ahead, which ends all events; then late ones, of events that
    have ended and of one that is new."""
    df = feed(spark, d, "SELECT event_id, CAST(idx AS INT) AS idx, rain_mm FROM intervals").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + c("idx") * 60))
    far = spark.sql("SELECT CAST(-1 AS BIGINT) AS event_id, 0 AS idx, 0e0 AS rain_mm, TIMESTAMP '2100-01-01 00:00:00' AS ts")
    late = df.filter("event_id % 7 = 0 AND idx < 2").withColumn("event_id", F.when(c("idx") == 0, c("event_id")).otherwise(-2))
    end = far.withColumn("ts", F.expr("TIMESTAMP '2101-01-01 00:00:00'"))
    build = lambda s: ST.stream_excess(s, 80.0, 0.2, "1 hour", 3_600_000)
    return run_stream([*halves(df, "idx"), far, late.select(*df.columns), end], build, "excess", done).filter("event_id <> -1")


@query("st2_stream_excess", f"WITH {PH._EXCESS} SELECT event_id, idx, round(cum, 5) AS cumulative_mm, round(excess, 5) AS excess_mm FROM x")
def st2(spark, d):
    out = _excess(spark, d).filter("kind = 'INTERVAL'").drop("kind")
    return out.withColumn("cumulative_mm", F.round("cumulative_mm", 5)).withColumn("excess_mm", F.round("excess_mm", 5))


@query("st2_late_and_ended", f"WITH {PH._EXCESS} SELECT 'ENDED' AS kind, event_id, CAST(max(idx) AS INT) AS idx, round(max(cum), 5) AS cumulative_mm FROM x GROUP BY event_id UNION ALL SELECT 'LATE', CASE idx WHEN 0 THEN event_id ELSE -2 END, CAST(idx AS INT), NULL FROM x WHERE event_id % 7 = 0 AND idx < 2")
def st2l(spark, d):
    return _excess(spark, d).filter("kind <> 'INTERVAL'").select("kind", "event_id", "idx", F.round("cumulative_mm", 5).alias("cumulative_mm"))


@query("st3_stream_storms", """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL '6 hours' THEN 0 ELSE 1 END AS f FROM gauges WINDOW w AS (PARTITION BY gauge_id ORDER BY ts)), s AS (SELECT *, sum(f) OVER (PARTITION BY gauge_id ORDER BY ts) AS k FROM g)
SELECT gauge_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", round(sum(rain_mm), 6) AS depth_mm, count(*) AS n FROM s GROUP BY gauge_id, k""")
def st3(spark, d):
    out = run_stream(_gauges(spark, d), lambda s: ST.stream_storms(s, "6 hours", "10 minutes"), "storms")
    return out.filter("gauge_id >= 0").withColumn("depth_mm", F.round("depth_mm", 6))


@query("st4_stream_artifacts", "SELECT DISTINCT user_id AS run_id, event_type AS sha256, event_type <> 'error' AS declared FROM events")
def st4(spark, d):
    df = feed(spark, d, "SELECT user_id AS run_id, event_type AS sha256, ts FROM events").withColumn("ts", c("ts").cast("timestamp"))
    dec = feed(spark, d, "SELECT DISTINCT user_id AS run_id, event_type AS sha256 FROM events WHERE event_type <> 'error'")
    return run_stream(halves(df, "ts"), lambda s: ST.stream_artifacts(s, dec, "3650 days"), "artifacts")
