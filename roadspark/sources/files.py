"""Readers of the text formats that problems and graphs come in, and writers of the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = "array<struct<start:bigint,end:bigint>>"
#: Jobs and vehicles as JSON names them; missing fields take the defaults below.
JOB = "id bigint, location array<double>, location_index int, service bigint, setup bigint, release bigint, delivery array<bigint>, pickup array<bigint>, skills array<int>, allowed_vehicles array<bigint>, priority int, time_windows array<array<bigint>>, prize double, disjunction_penalty double, `group` int, description string"
VEHICLE = "id bigint, profile string, start array<double>, start_index int, end array<double>, end_index int, capacity array<bigint>, skills array<int>, time_window array<bigint>, speed_factor double, max_tasks int, max_travel_time bigint, max_distance bigint, costs struct<fixed:double,per_hour:double,span:double,distance:double>, breaks array<struct<id:bigint,service:bigint,time_windows:array<array<bigint>>>>, max_trips int"
PROBLEM = f"jobs array<struct<{JOB.replace(' ', ':').replace(',:', ',')}>>, vehicles array<struct<{VEHICLE.replace(' ', ':').replace(',:', ',')}>>"
FOREVER = 2**63 // 4


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """src, dst and weight 1 of a list of pairs a line, `#` comments, gzipped or not; names become dense ids by order."""
    lines = spark.read.text(path).where("NOT startswith(trim(value), '#') AND trim(value) <> ''")
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p")).select(F.try_element_at("p", F.lit(1)).try_cast("bigint").alias("a"), F.try_element_at("p", F.lit(2)).try_cast("bigint").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    names = parts.select("a").union(parts.select("b")).distinct()
    # ranks by range: counts of the ranges before, then ranks within, so that no task holds all names
    ranged = names.repartitionByRange("a").withColumn("part", F.spark_partition_id())
    before = ranged.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ids = ranged.join(F.broadcast(before), "part").select("a", (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("a")) - 1).alias("id"))
    out = parts.join(ids.select("a", F.col("id").alias("src")), "a").join(ids.select(F.col("a").alias("b"), F.col("id").alias("dst")), "b")
    return out.select("src", "dst", F.lit(1).cast("bigint").alias("dur"), F.lit(1).cast("bigint").alias("dist"))


def solomon(spark: SparkSession, path: str) -> DataFrame:
    """i, x, y, demand, ready, due and service of a benchmark's text; row 0 is the depot."""
    numbers = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") == 7)
    cols = [F.col("p")[k].try_cast("double") for k in range(7)]
    names = ["i", "x", "y", "demand", "ready", "due", "service"]
    return numbers.select(*[c.alias(n) for c, n in zip(cols, names)]).where("i IS NOT NULL AND x IS NOT NULL").withColumn("i", F.col("i").cast("bigint"))


def problem(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, vehicles) of problem JSON, one document a file, with defaults filled in; windows become structs."""
    body = spark.read.option("wholetext", True).text(path).select(F.from_json("value", PROBLEM).alias("p"))
    return jobs(body.select(F.explode("p.jobs").alias("j")).select("j.*")), vehicles(body.select(F.explode("p.vehicles").alias("v")).select("v.*"))


def _windows(column: Column) -> Column:
    pairs = F.coalesce(column, F.expr("cast(array() as array<array<bigint>>)"))
    return F.transform(pairs, lambda w: F.struct(w[0].alias("start"), w[1].alias("end")))


def jobs(rows: DataFrame) -> DataFrame:
    empty = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    fill = lambda c, v: F.coalesce(c, v if isinstance(v, Column) else F.lit(v)).alias(c)
    return rows.select(
        F.col("id").alias("job"), F.try_element_at("location", F.lit(1)).alias("lon"), F.try_element_at("location", F.lit(2)).alias("lat"), "location_index", fill("service", 0), fill("setup", 0), fill("release", 0),
        fill("delivery", empty("bigint")), fill("pickup", empty("bigint")), fill("skills", empty("int")), "allowed_vehicles", fill("priority", 0), _windows(F.col("time_windows")).alias("windows"), fill("prize", 1e9),
        "disjunction_penalty", F.col("group").alias("grp"), "description",
    )


def vehicles(rows: DataFrame) -> DataFrame:
    empty = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    fill = lambda c, v: F.coalesce(c, v if isinstance(v, Column) else F.lit(v)).alias(c.split(".")[-1])
    at = lambda c, k: F.try_element_at(c, F.lit(k))
    return rows.select(
        F.col("id").alias("vehicle"), fill("profile", "car"), at("start", 1).alias("start_lon"), at("start", 2).alias("start_lat"), "start_index", F.coalesce(at("end", 1), at("start", 1)).alias("end_lon"), F.coalesce(at("end", 2), at("start", 2)).alias("end_lat"),
        F.coalesce("end_index", "start_index").alias("end_index"), fill("capacity", empty("bigint")), fill("skills", empty("int")), F.coalesce(at("time_window", 1), F.lit(0)).alias("shift_start"), F.coalesce(at("time_window", 2), F.lit(FOREVER)).alias("shift_end"),
        fill("speed_factor", 1.0), "max_tasks", "max_travel_time", "max_distance", fill("costs.fixed", 0.0), fill("costs.per_hour", 3600.0), fill("costs.span", 0.0), fill("costs.distance", 0.0), "breaks", fill("max_trips", 1),
    )


def locations(points: DataFrame) -> DataFrame:
    """A number for each different place (lon, lat to 1e-7) in order of first appearance (seq); numbered by ranges of seq."""
    key = F.struct(F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))
    first = points.groupBy(key.alias("place")).agg(F.min("seq").alias("seq"))
    return first.withColumn("index", F.row_number().over(Window.orderBy("seq")) - 1).select("place.lon", "place.lat", "index")


def solution(routes: DataFrame, steps: DataFrame, unassigned: DataFrame) -> DataFrame:
    """One JSON document a plan: code 0 (1 with unassigned jobs), summary, routes with their steps, unassigned.

    routes(plan, route_id, cost, travel_s, distance), steps(plan, route_id, seq, kind, job, arrival), unassigned(plan, job, reason).
    """
    own = steps.groupBy("plan", "route_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.col("kind").alias("type"), "job", "arrival"))).alias("steps"))
    rows = routes.join(own, ["plan", "route_id"], "left")
    out = rows.groupBy("plan").agg(
        F.struct(F.sum("cost").alias("cost"), F.sum("travel_s").alias("duration"), F.sum("distance").alias("distance"), F.count("*").alias("routes")).alias("summary"),
        F.sort_array(F.collect_list(F.struct(F.col("route_id").alias("vehicle"), "cost", F.col("travel_s").alias("duration"), "distance", "steps"))).alias("routes"),
    )
    left = unassigned.groupBy("plan").agg(F.sort_array(F.collect_list(F.struct(F.col("job").alias("id"), "reason"))).alias("unassigned"))
    out = out.join(left, "plan", "left")
    code = F.when(F.size("unassigned") > 0, 1).otherwise(0).alias("code")
    return out.select("plan", F.to_json(F.struct(code, "summary", "routes", "unassigned")).alias("document"))


def table_answer(cells: DataFrame) -> DataFrame:
    """src and its durations as a JSON array in order of dst, nulls for pairs that are not reached."""
    rows = cells.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "dur"))).alias("r"))
    return rows.select("src", F.to_json(F.transform("r", lambda x: x["dur"])).alias("durations"))


def grid_graph(spark: SparkSession, side: int, seed: int = 0) -> DataFrame:
    """A grid of side * side nodes with both directions and hashed durations of 1 to 100."""
    n = F.col("id")
    right = spark.range(side * side).where(n % side < side - 1).select(n.alias("a"), (n + 1).alias("b"))
    down = spark.range(side * (side - 1)).select(n.alias("a"), (n + side).alias("b"))
    both = right.union(down)
    both = both.union(both.select("b", "a"))
    weight = F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(100)) + 1
    return both.select(F.col("a").alias("src"), F.col("b").alias("dst"), weight.alias("dur"), (weight * 10).alias("dist"))


def random_graph(spark: SparkSession, nodes: int, degree: int, seed: int = 0) -> DataFrame:
    """degree hashed edges out of each node."""
    rows = spark.range(nodes).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(degree))))
    to = F.pmod(F.xxhash64("id", "k", F.lit(seed)), F.lit(nodes))
    weight = F.pmod(F.xxhash64("k", "id", F.lit(seed + 1)), F.lit(100)) + 1
    return rows.select(F.col("id").alias("src"), to.alias("dst"), weight.alias("dur"), (weight * 10).alias("dist")).where("src <> dst")


def generated_jobs(spark: SparkSession, lat: float, lon: float, radius_km: float, count: int, seed: int = 0) -> DataFrame:
    """Jobs spread evenly over a disc, by hashes of their number."""
    u = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 30)) / (1 << 30)
    far, turn = F.sqrt(u(1)) * radius_km / 111.195, u(2) * 6.283185307179586
    return spark.range(count).select(F.col("id").alias("job"), (lat + far * F.sin(turn)).alias("lat"), (lon + far * F.cos(turn) / F.cos(F.radians(F.lit(lat)))).alias("lon"), (F.pmod(F.xxhash64("id", F.lit(seed + 3)), F.lit(9)) + 1).alias("demand"))


HEIGHTS = T.StructType([T.StructField("node", T.LongType()), T.StructField("height", T.DoubleType())])


def heights(nodes: DataFrame, tiles: DataFrame) -> DataFrame:
    """Bilinear heights of nodes from square tiles(lat0, lon0, content): big-endian 16-bit samples from north to south; null at voids and outside."""
    import numpy as np
    import pandas as pd

    rows = nodes.withColumns({"lat0": F.floor("lat").cast("int"), "lon0": F.floor("lon").cast("int")}).join(tiles, ["lat0", "lon0"])

    def run(frames):
        last, grid = None, None
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                if (r.lat0, r.lon0) != last:
                    flat = np.frombuffer(r.content, ">i2")
                    side = int(len(flat) ** 0.5)
                    last, grid = (r.lat0, r.lon0), flat.reshape(side, side)
                y, x = (1 - (r.lat - r.lat0)) * (len(grid) - 1), (r.lon - r.lon0) * (len(grid) - 1)
                a, b = min(int(y), len(grid) - 2), min(int(x), len(grid) - 2)
                corner = grid[a : a + 2, b : b + 2].astype(float)
                fy, fx = y - a, x - b
                good = (corner != -32768).all()
                out.append((r.node, float((corner[0] * (1 - fy) + corner[1] * fy) @ [1 - fx, fx]) if good else None))
            yield pd.DataFrame(out, columns=["node", "height"])

    return rows.select("node", "lat", "lon", "lat0", "lon0", "content").sortWithinPartitions("lat0", "lon0").mapInPandas(run, HEIGHTS)
