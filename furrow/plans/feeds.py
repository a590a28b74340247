"""Inputs of the operators as SQL over the given tables, in words that Spark and DuckDB share.

The same text gives Spark its input DataFrame and opens the oracle's WITH clause; what is checked comes after it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FEEDS: dict[str, str] = {}
# what several modules start from; each module adds its own
FEEDS["sections"] = """SELECT p_partkey AS section_id, p_partkey % 25 AS reach_id, p_size * 1e-1 AS width, 1.5e0 AS side, 5e-3 AS slope, 4e-2 AS rough,
5e-1 + (p_partkey % 10) * 1e-1 AS max_depth, CASE p_partkey % 3 WHEN 0 THEN 'NEW' WHEN 1 THEN 'CURRENT' ELSE 'DEGRADED' END AS condition FROM part"""
FEEDS["steps"] = """SELECT l_orderkey AS line_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq,
l_extendedprice / 1e2 AS x, l_quantity AS y, l_discount * 1e2 AS z FROM lineitem"""
FEEDS["spans2"] = """SELECT a.line_id, a.seq, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy FROM steps a JOIN steps b ON a.line_id = b.line_id AND b.seq = a.seq + 1
JOIN steps c ON a.line_id = c.line_id AND c.seq = a.seq + 2"""

# feeds whose rows Spark reads by a text of its own: partitioned by the column's new name, as that by the old one isn't known to be
# the same to what follows, and all rows would be dealt again
SAME_ROWS: dict[str, str] = {}
SAME_ROWS["steps"] = """SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, x, y, z
FROM (SELECT l_orderkey AS line_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 1e2 AS x, l_quantity AS y, l_discount * 1e2 AS z FROM lineitem) q"""


def needs(sql: str) -> list[str]:
    """The feeds that a text names, those first that others need."""
    out: list[str] = []
    for n in FEEDS:
        if re.search(rf"\b{n}\b", sql):
            for m in [*needs(FEEDS[n]), n]:
                if m not in out:
                    out.append(m)
    return out


def oracle(body: str, own: dict[str, str] | None = None) -> str:
    """A DuckDB query over feeds and tables. own: texts that stand for those of some feeds."""
    head = ",\n".join(f"{n} AS ({(own or {}).get(n, FEEDS[n])})" for n in needs(body))
    if not head:
        return body
    rest = body.lstrip()
    if rest.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{rest[14:]}"
    return f"WITH {head},\n{rest[4:]}" if rest.upper().startswith("WITH") else f"WITH {head}\n{rest}"


def feed(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A feed by name, or any text over feeds and tables, as a DataFrame."""
    sql = oracle(SAME_ROWS.get(sql, FEEDS.get(sql, sql)), SAME_ROWS)
    names = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", sql)}
    for t in names:
        sql = re.sub(rf"\b{t}\b", "{" + t + "}", sql)
    return spark.sql(sql, **names)
