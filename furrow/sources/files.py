"""Sources and sinks: feature collections, cells, points, catalogs, file scans, layered and GeoJSON output."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.session import ship

c = F.col


def features_from_json(rows: DataFrame, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """Features (one GeoJSON feature a row, feature_id beside it) and vertices (feature_id, part, ring, seq, x, y, z) of
    points, lines and polygons, single or multi. Null or empty geometry is dropped, other types yield no part."""
    shape = {
        "Point": "array<double>", "LineString": "array<array<double>>", "MultiPoint": "array<array<double>>", "Polygon": "array<array<array<double>>>", "MultiLineString": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>",
    }
    f = rows.select("feature_id", F.get_json_object(json, "$.geometry.type").alias("kind"), F.get_json_object(json, "$.geometry.coordinates").alias("co"), F.get_json_object(json, "$.properties").alias("properties"))
    f = f.filter("kind IS NOT NULL AND co IS NOT NULL AND co != '[]'")
    read = lambda k: F.from_json("co", shape[k])
    # everything becomes parts of rings of positions
    parts = (
        F.when(c("kind") == "Point", F.array(F.array(F.array(read("Point"))))).when(c("kind") == "LineString", F.array(F.array(read("LineString")))).when(c("kind") == "MultiPoint", F.transform(read("MultiPoint"), lambda p: F.array(F.array(p))))
        .when(c("kind") == "MultiLineString", F.transform(read("MultiLineString"), lambda p: F.array(p))).when(c("kind") == "Polygon", F.array(read("Polygon"))).when(c("kind") == "MultiPolygon", read("MultiPolygon"))
    )
    v = f.select("feature_id", F.posexplode(parts).alias("part", "rings")).select("feature_id", "part", F.posexplode("rings").alias("ring", "line")).select("feature_id", "part", "ring", F.posexplode("line").alias("seq", "p"))
    return f.select("feature_id", "kind", "properties"), v.select("feature_id", "part", "ring", "seq", c("p")[0].alias("x"), c("p")[1].alias("y"), F.try_element_at("p", F.lit(3)).alias("z"))


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Features and vertices of feature-collection files."""
    raw = spark.read.text(path, wholetext=True)
    every = raw.select(F.posexplode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("feature_id", "json"))
    return features_from_json(every)


def ground_points(points: DataFrame, cls: int = 2) -> DataFrame:
    return points.filter(c("classification") == cls)


def catalog_tables(rows: DataFrame, item: str = "id", members: str = "members") -> dict[str, DataFrame]:
    """A nested catalog (id, members array, ...) as items, one row per list member, and ids that occur twice."""
    return {"items": rows.drop(members), "members": rows.select(item, F.posexplode(members).alias("position", "member")), "duplicates": rows.groupBy(item).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")}


#: Leading bytes by extension.
# fixed values: the leading bytes of file formats (TIFF of either byte order, classic and big; shapefile code 9994)
_TIFF = (b"II*\x00", b"MM\x00*", b"II+\x00", b"MM\x00+")
SIGNATURES = {"las": (b"LASF",), "laz": (b"LASF",), "pdf": (b"%PDF-",), "tif": _TIFF, "tiff": _TIFF, "shp": (b"\x00\x00\x27\x0a",), "parquet": (b"PAR1",)}


def signature_ok(content: Column, ext: Column) -> Column:
    out = F.lit(None).cast("boolean")
    for e, leads in SIGNATURES.items():
        out = F.when(ext == e, reduce(lambda a, b: a | b, [F.substring(content, 1, len(lead)) == F.lit(lead) for lead in leads])).otherwise(out)
    return out


#: Bytes of a file that a task holds at once.
PIECE = 1 << 20


def _digest() -> Callable[[Column], Column]:
    """sha256 and the leading bytes of batches of local files, read in pieces."""

    def read(paths: pd.Series) -> pd.DataFrame:
        out = []
        for path in paths:
            told, head = hashlib.sha256(), b""
            with open("/" + path.removeprefix("file:").lstrip("/"), "rb", buffering=0) as f:
                while piece := f.read(PIECE):
                    head = head if len(head) > 15 else (head + piece)[:16]
                    told.update(piece)
            out.append((told.hexdigest(), head))
        return pd.DataFrame(out, columns=["sha256", "head"])

    return F.pandas_udf(read, "sha256 string, head binary")


def scan_files(spark: SparkSession, glob: str) -> DataFrame:
    """path, size, sha256 and whether the leading bytes fit the extension. Local files are listed by Spark and read in pieces, so
    a file may be larger than a task's memory; those of other file systems are read whole."""
    jvm = spark.sparkContext._jvm
    scheme = jvm.org.apache.hadoop.fs.Path(glob).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme()
    b = spark.read.format("binaryFile").load(glob)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    told = lambda sha256, head: ("path", c("length").alias("size"), sha256.alias("sha256"), signature_ok(head, ext).alias("signature_ok"))
    if scheme != "file":
        return b.select(*told(F.sha2("content", 256), c("content")))
    ship(spark)
    return b.select("path", "length", _digest()("path").alias("read")).select(*told(c("read.sha256"), c("read.head")))


def find_id_column(df: DataFrame, ids: list[str]) -> DataFrame:
    """column, found, candidate: which columns hold every requested id (normalised). One candidate is the key; none is an
    error for the caller, more than one is ambiguous."""
    from furrow.functions.expr import canonical_id

    wanted = sorted({i.strip() for i in ids if i.strip()})
    if len(wanted) != len(ids):
        raise ValueError("requested ids must be unique and not empty")
    text = df.select(*[canonical_id(c(n)).alias(n) for n in df.columns])
    long = text.unpivot([], text.columns, "column", "value").filter(c("value").isin(*wanted))
    names = df.sparkSession.createDataFrame([(n,) for n in df.columns], "column string")
    g = names.join(long.groupBy("column").agg(F.countDistinct("value").alias("found")), "column", "left").fillna(0, ["found"])
    return g.withColumn("candidate", c("found") == len(wanted))


def write_layers(layers: dict[str, DataFrame], path: str) -> str:
    """Write all layers into a staging folder and publish it by one rename; a failure leaves nothing under path."""
    spark = next(iter(layers.values())).sparkSession
    stage = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    for name, df in layers.items():
        df.write.parquet(f"{stage}/{name}.parquet")
    jvm = spark.sparkContext._jvm
    to, frm = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(stage)
    files = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # a rename onto a folder that is there would move the staging folder into it
    if files.exists(to) or not files.rename(frm, to):
        files.delete(frm, True)
        raise OSError(f"{path} is there already")
    return path


def write_series(df: DataFrame, path: str, columns: list[str], seconds_to_minutes: tuple[str, ...] = ()) -> None:
    """A flat series in the declared column order; the named columns go from seconds to minutes."""
    df.select(*[(c(n) / 60).alias(n) if n in seconds_to_minutes else c(n) for n in columns]).write.csv(path, header=True)


def to_geojson(vertices: DataFrame, attrs: DataFrame, key: str = "feature_id") -> DataFrame:
    """feature_id, feature_json: a LineString feature in 2D, elevations kept apart from the geometry. A vertex that isn't
    finite makes the feature an error (json null, error set)."""
    from furrow.functions.expr import finite

    p = F.array_sort(F.collect_list(F.struct("seq", "x", "y", "z")))
    g = vertices.groupBy(key).agg(p.alias("p"), F.bool_and(finite(c("x")) & finite(c("y"))).alias("ok")).join(attrs, key)
    co = F.transform("p", lambda v: F.array(v["x"], v["y"]))
    props = F.struct(*[n for n in attrs.columns if n != key], F.transform("p", lambda v: v["z"]).alias("source_elevations"))
    body = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), co.alias("coordinates")).alias("geometry"), props.alias("properties")))
    return g.select(key, F.when(c("ok"), body).alias("feature_json"), F.when(~c("ok"), "NON_FINITE_COORDINATE").alias("error"))
