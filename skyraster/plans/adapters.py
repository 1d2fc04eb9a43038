"""Survey tables derived from the driver's tables, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {}

VIEWS["points"] = """
SELECT o_orderkey AS pt_id, ((o_orderkey * 7919) % 20011) / CAST(100 AS DOUBLE) AS x, ((o_orderkey * 104729) % 20021) / CAST(100 AS DOUBLE) AS y,
  CAST(10 AS DOUBLE) + o_totalprice / CAST(10000 AS DOUBLE) AS z,
  CAST((o_orderkey * 31) % 256 AS INT) AS r, CAST((o_orderkey * 57) % 256 AS INT) AS g, CAST((o_orderkey * 91) % 256 AS INT) AS b,
  CASE WHEN o_orderkey % 10 < 4 THEN 2 WHEN o_orderkey % 10 = 4 THEN 3 WHEN o_orderkey % 10 = 5 THEN 4 WHEN o_orderkey % 10 = 6 THEN 5
    WHEN o_orderkey % 10 = 7 THEN 6 WHEN o_orderkey % 10 = 8 THEN 1 ELSE 7 END AS cls
FROM orders"""

VIEWS["cameras"] = """
SELECT s_suppkey AS cam_id, concat('/photos/IMG_', lpad(CAST(s_suppkey % 950 AS VARCHAR(10)), 4, '0'), '.JPG') AS path, 5280 AS width, 3956 AS height,
  CASE s_suppkey % 4 WHEN 0 THEN 'DJI' WHEN 1 THEN 'Autel' WHEN 2 THEN 'Parrot' ELSE 'Unknown' END AS make,
  CASE s_suppkey % 4 WHEN 0 THEN 'M3E' WHEN 1 THEN 'XT701' WHEN 2 THEN 'ANAFI' ELSE '' END AS model,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE concat('2024:05:', lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR(10)), 2, '0'), ' 10:00:00') END AS datetime,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(12.29 AS DOUBLE) END AS focal_mm, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(24 AS DOUBLE) END AS focal35_mm,
  CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST(22.5 AS DOUBLE) + ((s_suppkey * 37) % 1000) / CAST(100000 AS DOUBLE) END AS lat,
  CAST(88.4 AS DOUBLE) + ((s_suppkey * 53) % 1000) / CAST(100000 AS DOUBLE) AS lon, CAST(100 + s_suppkey % 50 AS DOUBLE) AS alt,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST(80 + s_suppkey % 40 AS DOUBLE) END AS rel_alt,
  CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE CAST((s_suppkey * 13) % 360 AS DOUBLE) END AS yaw, CAST(s_suppkey % 5 - 90 AS DOUBLE) AS pitch,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE ((s_suppkey * 7919) % 20011) / CAST(100 AS DOUBLE) END AS est_x,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE ((s_suppkey * 104729) % 20021) / CAST(100 AS DOUBLE) END AS est_y,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(120 + s_suppkey % 13 AS DOUBLE) END AS est_z, s_suppkey % 13 <> 0 AS enabled
FROM supplier"""

VIEWS["gcps"] = """
SELECT CAST(n_nationkey AS BIGINT) AS gcp_id, n_name AS label, CAST((n_nationkey * 7919) % 200 AS DOUBLE) AS x, CAST((n_nationkey * 104729) % 190 AS DOUBLE) AS y,
  CAST(n_nationkey % 7 AS DOUBLE) AS z, n_nationkey % 2 = 1 AS is_check, n_nationkey % 9 <> 0 AS enabled,
  CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE ((n_nationkey * 17) % 40) / CAST(100 AS DOUBLE) END AS error
FROM nation"""

VIEWS["observations"] = """
SELECT g.gcp_id, c.cam_id, CAST((g.gcp_id * 211 + c.cam_id * 17) % 6000 - 300 AS DOUBLE) AS px, CAST((g.gcp_id * 97 + c.cam_id * 29) % 4400 - 200 AS DOUBLE) AS py
FROM gcps g JOIN cameras c ON (g.gcp_id * 7 + c.cam_id) % 11 = 0"""

VIEWS["pairs"] = """
SELECT vec_id AS pid, label, CAST(x AS DOUBLE) AS sx, CAST(y AS DOUBLE) AS sy, CAST(z AS DOUBLE) AS sz,
  CAST(500000 AS DOUBLE) - 2 * CAST(y AS DOUBLE) + label / CAST(1000 AS DOUBLE) AS dx, CAST(4000000 AS DOUBLE) + 2 * CAST(x AS DOUBLE) - label / CAST(2000 AS DOUBLE) AS dy,
  CAST(50 AS DOUBLE) + 2 * CAST(z AS DOUBLE) + (label % 3) / CAST(500 AS DOUBLE) AS dz
FROM (SELECT vec_id, label, CAST(embedding[__1] AS DOUBLE) * 100 AS x, CAST(embedding[__2] AS DOUBLE) * 100 AS y, CAST(embedding[__3] AS DOUBLE) * 100 AS z FROM embeddings) e"""

VIEWS["tie_points"] = "SELECT vec_id AS pt_id, CAST(embedding[__1] AS DOUBLE) * 100 AS x, CAST(embedding[__2] AS DOUBLE) * 100 AS y, CAST(embedding[__3] AS DOUBLE) * 100 AS z FROM embeddings"

VIEWS["stage_log"] = "SELECT event_id, event_type AS stage, value * 10 AS seconds FROM events"

# One document a line of a sparse-model export, as the engine would write it.
VIEWS["image_lines"] = """
SELECT CAST('m' AS VARCHAR(10)) AS path, cam_id * 2 + k AS pos, CASE WHEN k = 0 THEN concat(CAST(cam_id AS VARCHAR(20)), ' 0.5 0.5 -0.5 0.5 ', CAST(cam_id % 17 AS VARCHAR(20)), ' ', CAST(cam_id % 5 AS VARCHAR(20)), ' 2.5 ',
    CAST(cam_id % 3 AS VARCHAR(20)), ' sub dir/IMG ', CAST(cam_id % 950 AS VARCHAR(20)), '.JPG')
  ELSE concat(CAST(cam_id % 50 AS VARCHAR(20)), '.5 10.25 ', CAST(cam_id AS VARCHAR(20)), ' 3.0 4.0 -1 7.5 8.5 ', CAST(cam_id % 40 AS VARCHAR(20))) END AS value
FROM cameras CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) t"""

VIEWS["gcp_lines"] = """
SELECT 'g' AS path, CAST(0 AS BIGINT) AS pos, 'label;x;y;z;type' AS value
UNION ALL
SELECT 'g' AS path, gcp_id + 1 AS pos, concat(label, ';', CAST(CAST(x AS INT) AS VARCHAR(20)), '.25; ', CAST(CAST(y AS INT) AS VARCHAR(20)), ';;',
  CASE WHEN gcp_id % 8 = 3 THEN 'n/a' ELSE CAST(CAST(z AS INT) AS VARCHAR(20)) END, CASE gcp_id % 4 WHEN 0 THEN ';control' WHEN 1 THEN ';Check' WHEN 2 THEN ';c' ELSE '' END) AS value
FROM gcps"""

ORDER = ["points", "cameras", "gcps", "observations", "pairs", "tie_points", "stage_log", "image_lines", "gcp_lines"]


def _uses(sql: str) -> list[str]:
    """The derived tables a query needs, in order."""
    need: set[str] = set()

    def add(text: str) -> None:
        for v in ORDER:
            if v not in need and re.search(rf"\b(FROM|JOIN)\s+{v}\b", text, re.I):
                need.add(v)
                add(VIEWS[v])

    add(sql)
    return [v for v in ORDER if v in need]


def _index(sql: str, first: int) -> str:
    return re.sub(r"\[__(\d)\]", lambda m: f"[{int(m[1]) - 1 + first}]", sql)


def duck(sql: str) -> str:
    """A DuckDB query with the derived tables it uses in front (its own WITH goes on)."""
    own = ", ".join(f"{v} AS ({_index(VIEWS[v], 1)})" for v in _uses(sql))
    body = sql.strip()
    if not own:
        return body
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I):
        return f"WITH {m[1] or ''}{own}, {body[m.end():]}"
    return f"WITH {own} {body}"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived one."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    for used in sorted(set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql)), key=len, reverse=True):
        if used in TABLES or used in VIEWS:
            load(spark, sf_dir, used).createOrReplaceTempView(f"_a_{used}")
            sql = re.sub(rf"\b(FROM|JOIN)\s+{used}\b", rf"\1 _a_{used}", sql)
    return spark.sql(_index(sql, 0).replace("VARCHAR(10)", "STRING").replace("VARCHAR(20)", "STRING"))
