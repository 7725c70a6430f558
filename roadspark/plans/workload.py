"""Deterministic road and routing inputs derived from the star-schema tables.

Each fixture is one SELECT in the dialect that Spark and DuckDB share, over {table} names and earlier
fixtures, so that a query and its check start from the same rows. All rows of a table are used: places fall into
blocks of 100 by number, each with a matrix of its own, so that cells grow with the places; the graph's nodes are
the parts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
FIXTURES = {
    "nodes": "SELECT c_custkey AS node, 59.9e0 + (c_custkey % 97) * 1e-3 AS lat, 10.7e0 + (c_custkey % 89) * 2e-3 AS lon FROM {customer}",
    "places": "SELECT s_suppkey AS place, 59.9e0 + (s_suppkey % 97) * 1e-3 + 4e-4 AS lat, 10.7e0 + (s_suppkey % 89) * 2e-3 + 7e-4 AS lon FROM {supplier}",
    "edges": """SELECT src, dst, MIN(dur) AS dur, MIN(dur) * 10 AS dist FROM (
        SELECT p_partkey AS src, p_partkey + 1 AS dst, CAST(p_size AS BIGINT) AS dur FROM {part}
        UNION ALL SELECT p_partkey + 1 AS src, p_partkey AS dst, CAST(p_size + 5 AS BIGINT) AS dur FROM {part}
        UNION ALL SELECT p_partkey AS src, p_partkey + 7 AS dst, CAST(p_size + 20 AS BIGINT) AS dur FROM {part}) e GROUP BY src, dst""",
    "street_nodes": "SELECT DISTINCT p_name AS street, p_partkey % 200 AS node FROM {part}",
    "addresses": "SELECT s_suppkey AS addr_id, 59.9e0 + (s_suppkey % 97) * 1e-3 AS lat, 10.7e0 + (s_suppkey % 89) * 2e-3 AS lon, CONCAT(CAST(s_suppkey % 40 + 1 AS STRING), CASE WHEN s_suppkey % 3 = 0 THEN 'B' ELSE '' END) AS housenumber, CONCAT('Street ', CAST(s_nationkey AS STRING)) AS street FROM {supplier}",
    "demand": "SELECT l_orderkey AS o_orderkey, CAST(ROUND(SUM(l_quantity)) AS BIGINT) AS demand FROM {lineitem} GROUP BY l_orderkey",
    "stops": """SELECT o.o_custkey AS route_id, o.o_orderkey AS job, ROW_NUMBER() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) AS seq,
        59.9e0 + (o.o_orderkey % 97) * 1e-3 AS lat, 10.7e0 + (o.o_orderkey % 89) * 2e-3 AS lon, COALESCE(d.demand, 0) AS demand,
        60 + (o.o_orderkey % 5) * 30 AS service, (o.o_orderkey % 3) * 45 AS setup, (o.o_orderkey % 50) * 400 AS ready, (o.o_orderkey % 50) * 400 + 9000 AS due,
        CAST(o.o_orderkey % 6 AS INT) AS grp FROM {orders} o LEFT JOIN {demand} d ON o.o_orderkey = d.o_orderkey""",
    "depots": "SELECT DISTINCT o_custkey AS route_id, 59.9e0 + (o_custkey % 97) * 1e-3 AS lat, 10.7e0 + (o_custkey % 89) * 2e-3 AS lon, 300 + (o_custkey % 5) * 150 AS capacity, 8e-1 + (o_custkey % 5) * 1e-1 AS speed FROM {orders}",
    "cells": """SELECT i, j, CASE WHEN i = j THEN 0 ELSE CAST(ROUND(m * 1.3e0 / 13.9e0) AS BIGINT) END AS dur, CASE WHEN i = j THEN 0 ELSE CAST(ROUND(m * 1.3e0) AS BIGINT) END AS dist FROM (
        SELECT a.place AS i, b.place AS j, 12742000e0 * ASIN(SQRT(LEAST(1e0, POW(SIN(RADIANS(b.lat - a.lat) / 2), 2) + COS(RADIANS(a.lat)) * COS(RADIANS(b.lat)) * POW(SIN(RADIANS(b.lon - a.lon) / 2), 2)))) AS m
        FROM {sites} a JOIN {sites} b ON a.block = b.block) c""",
    "sites": "SELECT place, lat, lon, CAST(FLOOR((place - 1) / 100) AS BIGINT) AS block FROM {places}",
    "reports": "SELECT event_id, user_id % 20 AS src, user_id % 7 AS dst, CAST(EXTRACT(HOUR FROM ts) AS INT) AS hr, CASE WHEN DAYOFWEEK_MON >= 5 THEN 1 ELSE 0 END AS weekend, value FROM {days}",
    "days": "SELECT event_id, ts, user_id, value, (CAST(FLOOR(EPOCH_S / 86400) AS BIGINT) + 3) % 7 AS DAYOFWEEK_MON FROM {stamped}",
}
ORDER = ["nodes", "places", "sites", "edges", "street_nodes", "addresses", "demand", "stops", "depots", "cells"]
#: The dialects differ in how they read a timestamp's seconds.
STAMPED = {"spark": "SELECT event_id, ts, user_id, value, unix_seconds(CAST(ts AS TIMESTAMP)) AS EPOCH_S FROM {events}", "duckdb": "SELECT event_id, ts, user_id, value, CAST(floor(epoch(ts)) AS BIGINT) AS EPOCH_S FROM events"}


def needed(name: str, known: dict[str, str]) -> list[str]:
    """A fixture and those it stands on, in order of definition."""
    out: list[str] = []
    for n in re.findall(r"\{(\w+)\}", known[name]):
        if n in known:
            out += [x for x in needed(n, known) if x not in out]
    return [*out, name]


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture, or a table, as a DataFrame."""
    known = FIXTURES | {"stamped": STAMPED["spark"]}
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    found = {n: fixture(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", known[name]))}
    return spark.sql(known[name], **found)


def ctes(*names: str) -> str:
    """The fixtures as DuckDB's WITH list."""
    known = FIXTURES | {"stamped": STAMPED["duckdb"]}
    order: list[str] = []
    for name in names:
        order += [n for n in needed(name, known) if n not in order]
    return ", ".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', known[n])})" for n in order)
