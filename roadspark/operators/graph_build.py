"""Ways to weighted edges, by joins and windows.

ways(way, refs: array of nodes, tags: map), nodes(node, lat, lon). Only what the profile accepts and has two
references or more becomes edges; references to unknown nodes are passed over, so their neighbours join up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import grade_factor, haversine
from ..functions.profiles import ALIASES, CustomProfile, accepts, metres_per_second, speed_kmh
from ..functions.text import maxspeed

#: Classes that run one way unless they say otherwise.
IMPLIED_ONE_WAY = ["motorway", "motorway_link"]


def accepted(ways: DataFrame, profile: str | CustomProfile) -> DataFrame:
    """The ways that a profile takes, with highway, kmh and oneway."""
    highway = F.col("tags")["highway"]
    limit = maxspeed(F.col("tags")["maxspeed"])
    if isinstance(profile, CustomProfile):
        good, kmh = profile.accepts(highway), profile.speed_kmh(highway, limit)
    else:
        good, kmh = accepts(profile, highway), speed_kmh(profile, highway, limit)
    said = F.lower(F.col("tags")["oneway"])
    foot = not isinstance(profile, CustomProfile) and ALIASES[profile] == "foot"
    implied = highway.isin(IMPLIED_ONE_WAY) | (F.col("tags")["junction"] == "roundabout")
    one = F.lit(0) if foot else F.when(said.isin("yes", "true", "1"), 1).when(said.isin("-1", "reverse"), -1).when(said.isin("no", "false", "0"), 0).when(implied, 1).otherwise(0)
    return ways.where(F.coalesce(good, F.lit(False)) & (F.size("refs") >= 2)).withColumns({"highway": highway, "kmh": kmh, "oneway": one})


def edges(ways: DataFrame, nodes: DataFrame, profile: str | CustomProfile = "car", elevation: DataFrame | None = None) -> DataFrame:
    """src, dst, dur_s and dist_m of both directions (one for one-way roads), without loops."""
    rows = accepted(ways, profile).select("way", "kmh", "oneway", F.posexplode("refs").alias("seq", "node"))
    at = nodes if elevation is None else nodes.join(elevation.select("node", "height"), "node", "left")
    rows = rows.join(at, "node")
    w = Window.partitionBy("way").orderBy("seq")
    height = F.col("height") if elevation is not None else F.lit(None).cast("double")
    rows = rows.withColumn("height", height)
    ahead = {f"n_{c}": F.lead(c).over(w) for c in ("node", "lat", "lon", "height")}
    rows = rows.withColumns(ahead).where("n_node IS NOT NULL AND n_node <> node")
    rows = rows.withColumn("dist_m", F.greatest(haversine(F.col("lat"), F.col("lon"), F.col("n_lat"), F.col("n_lon")), F.lit(1e-3)))
    rows = rows.withColumn("flat_s", F.greatest(F.col("dist_m") / metres_per_second(F.col("kmh")), F.lit(1e-4)))
    rise = F.col("n_height") - F.col("height")
    there = rows.where("oneway >= 0").select(F.col("node").alias("src"), F.col("n_node").alias("dst"), (F.col("flat_s") * grade_factor(rise, F.col("dist_m"))).alias("dur_s"), "dist_m")
    back = rows.where("oneway <= 0").select(F.col("n_node").alias("src"), F.col("node").alias("dst"), (F.col("flat_s") * grade_factor(-rise, F.col("dist_m"))).alias("dur_s"), "dist_m")
    return there.unionByName(back)


def node_names(ways: DataFrame) -> DataFrame:
    """The street of each node: that of the first way (by number) that has a name."""
    named = ways.where("tags['name'] IS NOT NULL").select("way", F.col("tags")["name"].alias("street"), F.explode("refs").alias("node"))
    return named.groupBy("node").agg(F.min(F.struct("way", "street")).alias("w")).select("node", "w.street")


def addresses(nodes: DataFrame) -> DataFrame:
    """Address points of nodes(node, lat, lon, tags) that have a number and a street."""
    from ..functions.text import clean_house

    tag = lambda k: F.col("tags")[f"addr:{k}"]
    rows = nodes.where(tag("housenumber").isNotNull() & tag("street").isNotNull())
    return rows.select(F.col("node").alias("addr_id"), "lat", "lon", clean_house(tag("housenumber")).alias("housenumber"), tag("street").alias("street"), tag("city").alias("city"), tag("postcode").alias("postcode"))
