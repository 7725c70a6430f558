"""Streets and addresses: forward, reverse, crossings, suggestions, geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine, planar2
from ..functions.text import house_key, house_number
from .nearest import nearest


GRAM = 3


def grams(text: Column, size: int) -> Column:
    """The different stretches of `size` characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda k: F.substr(text, k, F.lit(size))))


def find_street(streets: DataFrame, queries: DataFrame) -> DataFrame:
    """For queries(query) the street (name_id, street): equal but for case first, else the first id that contains it.

    Streets and queries meet by equal stretches of GRAM characters (fewer, where the query is shorter), which
    are then compared whole; empty queries find nothing.
    """
    low = F.lower("street")
    every = F.concat(*[grams(low, n) for n in range(1, GRAM + 1)])
    keyed = streets.select("name_id", "street", F.explode(F.array_distinct(every)).alias("gram"))
    asked = queries.withColumn("q", F.lower(F.trim("query"))).where("q <> ''").withColumn("gram", F.substr("q", F.lit(1), F.lit(GRAM)))
    found = asked.join(keyed, "gram").where(F.contains(low, F.col("q"))).withColumn("inexact", low != F.col("q"))
    return found.groupBy("query").agg(F.min(F.struct("inexact", "name_id", "street")).alias("best")).select("query", "best.name_id", "best.street")


def locate_street(streets: DataFrame, street_nodes: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """For queries(query) the street found and a node of it that stands for it (that of the smallest number), with its place."""
    first = street_nodes.groupBy("street").agg(F.min("node").alias("node"))
    return find_street(streets, queries).join(first, "street").join(nodes.select("node", "lat", "lon"), "node").select("query", "street", "node", "lat", "lon")


def street_reverse(points: DataFrame, street_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The street of the nearest node that has one (the first by name), for points(point, lat, lon): point, street, node, metres."""
    named = street_nodes.groupBy("node").agg(F.min("street").alias("street"))
    sites = nodes.join(named.select("node"), "node").select(F.col("node").alias("site"), "lat", "lon")
    return nearest(points, sites, 1).join(named.withColumnRenamed("node", "site"), "site").select("point", "street", F.col("site").alias("node"), "metres")


def suggest(streets: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Streets for typed text: prefixes first, then the others that contain it, by id."""
    low = F.lower(F.lit(text))
    rows = streets.where(F.contains(F.lower("street"), low)).withColumn("inner", ~F.startswith(F.lower("street"), low))
    return rows.orderBy("inner", "name_id").limit(limit).select("name_id", "street")


def street_near(street_nodes: DataFrame, nodes: DataFrame, street: str, lat: float, lon: float) -> DataFrame:
    """The street's node nearest to a reference point."""
    rows = street_nodes.where(F.lower("street") == street.lower()).join(nodes, "node")
    metres = haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return rows.groupBy("street").agg(F.min(F.struct(metres.alias("metres"), "node")).alias("best")).select("street", "best.node", "best.metres")


def crossings(street_nodes: DataFrame) -> DataFrame:
    """Pairs of streets (a < b) and the nodes they share."""
    a = street_nodes.select(F.col("street").alias("a"), "node")
    b = street_nodes.select(F.col("street").alias("b"), "node")
    return a.join(b, "node").where("a < b").select("a", "b", "node").distinct()


def crossing(street_nodes: DataFrame, nodes: DataFrame, a: str, b: str, lat: float | None = None, lon: float | None = None, radius_km: float | None = None) -> DataFrame:
    """The nodes that two different streets share, nearest to a reference point first."""
    if a == b:
        raise ValueError("two different streets are needed")
    pick = lambda s: street_nodes.where(F.col("street") == s).select("node")
    rows = pick(a).intersect(pick(b)).join(nodes, "node")
    metres = F.lit(0.0) if lat is None else haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    rows = rows.withColumn("metres", metres)
    if radius_km is not None:
        rows = rows.where(F.col("metres") <= radius_km * 1000)
    return rows.orderBy("metres", "node").select("node", "metres")


def street_geometry(edges: DataFrame, street_nodes: DataFrame) -> DataFrame:
    """Edges with both ends on a street, each once."""
    on = street_nodes.select("street", "node").distinct()
    return edges.where("src < dst").join(on.withColumnRenamed("node", "src"), "src").join(on.withColumnRenamed("node", "dst"), ["street", "dst"]).select("street", "src", "dst").distinct()


def address_forward(addresses: DataFrame, queries: DataFrame) -> DataFrame:
    """For queries(query[, lat, lon]) the best address: the exact number, else the nearest one (approximate); a reference point breaks ties, then the id."""
    asked = queries.withColumn("parts", house_number(F.col("query"))).withColumn("key", house_key(F.col("parts.number")))
    rows = asked.join(addresses.select("addr_id", "housenumber", "street", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon")), F.lower("street") == F.lower("parts.street"))
    own = house_key(F.col("housenumber"))
    rows = rows.withColumns({"exact": (own == F.col("key")), "gap": F.when(F.col("parts.number").isNull(), 0).otherwise(F.abs(own["value"] - F.col("key.value")))})
    near = planar2(F.col("lat"), F.col("lon"), F.col("a_lat"), F.col("a_lon")) if "lat" in queries.columns else F.lit(0.0)
    order = Window.partitionBy("query").orderBy(F.desc("exact"), "gap", F.coalesce(near, F.lit(0.0)), "addr_id")
    best = rows.withColumn("n", F.row_number().over(order)).where("n = 1")
    return best.select("query", "addr_id", (~F.col("exact") & F.col("parts.number").isNotNull()).alias("approximate"))


def address_reverse(points: DataFrame, addresses: DataFrame) -> DataFrame:
    """The nearest address of each point."""
    return nearest(points, addresses.select(F.col("addr_id").alias("site"), "lat", "lon"), 1).select("point", F.col("site").alias("addr_id"), "metres")


def bounding_box(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"))


def interpolated(lines: DataFrame, most: int = 2000) -> DataFrame:
    """House numbers between the numbered ends of lines(line, n1, lat1, lon1, n2, lat2, lon2, rule): rule is even, odd, all or a step."""
    step = F.when(F.col("rule").isin("even", "odd"), 2).when(F.col("rule") == "all", 1).otherwise(F.greatest(F.coalesce(F.col("rule").try_cast("bigint"), F.lit(1)), F.lit(1)))
    rows = lines.where((F.col("n2") > F.col("n1")) & (F.col("n2") - F.col("n1") <= most)).withColumn("step", step)
    rows = rows.withColumn("number", F.explode(F.sequence(F.col("n1"), F.col("n2"), F.col("step"))))
    rows = rows.where("number > n1 AND number < n2").where(~((F.col("rule") == "even") & (F.col("number") % 2 != 0)) & ~((F.col("rule") == "odd") & (F.col("number") % 2 != 1)))
    share = (F.col("number") - F.col("n1")) / (F.col("n2") - F.col("n1"))
    at = lambda a, b: F.col(a) + share * (F.col(b) - F.col(a))
    return rows.select("line", "number", at("lat1", "lat2").alias("lat"), at("lon1", "lon2").alias("lon"))


def centroids(refs: DataFrame) -> DataFrame:
    """The mean of each building's nodes (way, seq, node, lat, lon); a node that repeats its predecessor is skipped."""
    before = F.lag("node").over(Window.partitionBy("way").orderBy("seq"))
    rows = refs.withColumn("before", before).where("before IS NULL OR before <> node")
    return rows.groupBy("way").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def contains_text(column: Column, text: str) -> Column:
    return F.contains(F.lower(column), F.lit(text.lower()))
