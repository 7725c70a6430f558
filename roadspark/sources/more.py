"""Smaller sources and sinks: warm starts, pattern files, toy graphs, choice of a matrix, sizes in words, matrix archives."""

from __future__ import annotations

from itertools import permutations, product

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import matrix as matrices
from ..plans.lineage import BROADCAST_ROWS

UNITS = ("B", "KB", "MB", "GB", "TB")
SOLUTION = "code int, routes array<struct<vehicle:bigint,steps:array<struct<type:string,job:bigint,id:bigint,location_index:int>>>>"
PATTERN = "id bigint, features array<double>, config map<string,double>, cost double"


def bytes_in_words(size: Column) -> Column:
    """A number of bytes with its unit: whole bytes, else one decimal of the largest unit of 1024s that is not more."""
    size = size.cast("double")
    power = F.least(F.floor(F.log(F.greatest(size, F.lit(1.0))) / F.log(F.lit(1024.0)) + 1e-12), F.lit(len(UNITS) - 1)).cast("int")
    unit = F.element_at(F.array(*[F.lit(u) for u in UNITS]), power + 1)
    return F.when(power == 0, F.concat(size.cast("bigint").cast("string"), F.lit(" B"))).otherwise(F.concat(F.format_number(size / F.pow(F.lit(1024.0), power), 1), F.lit(" "), unit))


def warm_start(spark: SparkSession, path: str, jobs: DataFrame) -> DataFrame:
    """route_id, seq and job of a solution document's routes, for jobs(job, location_index): by the step's job, else the first unused job (by id) at its location; steps that match nothing are left out, and a job counts once."""
    body = spark.read.option("wholetext", True).text(path).select(F.from_json("value", SOLUTION).alias("s"))
    steps = body.select(F.posexplode("s.routes").alias("r", "route")).select(F.coalesce("route.vehicle", "r").alias("route_id"), F.posexplode("route.steps").alias("seq", "step"))
    steps = steps.where(F.coalesce("step.type", F.lit("job")) == "job").select("route_id", "seq", F.coalesce("step.job", "step.id").alias("named"), "step.location_index")
    known = jobs.select("job", "location_index")
    named = steps.join(known.select(F.col("job").alias("named"), F.col("job")), "named").select("route_id", "seq", "job")
    first = Window.partitionBy("job").orderBy("route_id", "seq")
    named = named.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    rest = steps.join(known.select(F.col("job").alias("named")), "named", "left_anti").where("location_index IS NOT NULL")
    free = known.join(named.select("job"), "job", "left_anti")
    turn = lambda *order: F.row_number().over(Window.partitionBy("location_index").orderBy(*order))
    matched = rest.withColumn("k", turn("route_id", "seq")).join(free.withColumn("k", turn("job")), ["location_index", "k"]).select("route_id", "seq", "job")
    return named.unionByName(matched)


def patterns(spark: SparkSession, path: str) -> DataFrame:
    """id, features, config and cost of a file of one JSON object a line; lines without features are left out."""
    return spark.read.schema(PATTERN).json(path).where("features IS NOT NULL")


def chosen_matrix(vehicles: DataFrame, provided: dict[str, DataFrame], sites: DataFrame) -> DataFrame:
    """The provided matrix of the first vehicle's profile, else straight lines between all sites (their number is checked)."""
    first = vehicles.orderBy("vehicle").select("profile").head()
    if first is not None and first["profile"] in provided:
        return provided[first["profile"]]
    if (n := sites.count()) ** 2 > BROADCAST_ROWS:
        raise ValueError(f"{n} sites have too many pairs for one table of all; give blocks of sites")
    pairs = sites.select(F.col("place").alias("i"), F.lit(0).alias("one")).join(sites.select(F.col("place").alias("j"), F.lit(0).alias("one")), "one").select("i", "j")
    return matrices.straight_line(sites, pairs)


def word_ladder(words: DataFrame) -> DataFrame:
    """Edges between words(id, word) of one length that differ in one letter, both ways, of weight 1; words meet by a pattern with a gap."""
    at = F.sequence(F.lit(1), F.length("word"))
    gap = F.transform(at, lambda k: F.concat(F.substr("word", F.lit(1), k - 1), F.lit("\u0000"), F.substr("word", k + 1)))
    rows = words.where("word <> ''").select("id", "word", F.explode(gap).alias("gap"))
    a, b = rows.select(F.col("id").alias("src"), F.col("word").alias("w"), "gap"), rows.select(F.col("id").alias("dst"), F.col("word").alias("v"), "gap")
    return a.join(b, "gap").where("w <> v").select("src", "dst", F.lit(1).cast("bigint").alias("dur"), F.lit(1).cast("bigint").alias("dist")).distinct()


CORNERS = 7


def _turns() -> dict[str, tuple[tuple, tuple]]:
    """Where a quarter turn of the right, lower or back face takes the seven corners that do not stay, and how it twists them: places from and to, twists.

    A corner's twist is the axis of its upper or lower sticker, counted round the corner from the upright one.
    """
    places = [p for p in product((1, -1), repeat=3) if p != (-1, 1, 1)]
    spins = {"R": lambda x, y, z: (x, -z, y), "D": lambda x, y, z: (z, y, -x), "B": lambda x, y, z: (-y, x, z)}
    sides = {"R": (0, 1), "D": (1, -1), "B": (2, -1)}
    out = {}
    for face, (axis, side) in sides.items():
        to, twist = list(range(CORNERS)), [0] * CORNERS
        for k, p in enumerate(places):
            if p[axis] == side:
                new = spins[face](*p)
                up = spins[face](0, 1, 0)  # where the upright axis goes
                on = next(i for i, v in enumerate(up) if v)
                round_corner = [1, 0, 2] if new[0] * new[1] * new[2] > 0 else [1, 2, 0]
                to[k], twist[k] = places.index(new), round_corner.index(on)
        out[face] = (tuple(to), tuple(twist))
    return out


TURNS = _turns()


def cube_number(order: tuple, twist: tuple) -> int:
    """A cube's place among all: the permutation's rank times 3**6, plus the twists of six corners in base 3."""
    rank, left = 0, list(range(CORNERS))
    for x in order:
        rank = rank * len(left) + left.index(x)
        left.remove(x)
    code = 0
    for t in twist[:-1]:
        code = code * 3 + t
    return rank * 3 ** (CORNERS - 1) + code


def turned(order: list, twist: list, face: str) -> tuple[tuple, tuple]:
    """Corners (by place) and their twists after a quarter turn."""
    to, by = TURNS[face]
    new, spun = [0] * CORNERS, [0] * CORNERS
    for k, at in enumerate(to):
        new[at], spun[at] = order[k], (twist[k] + by[k]) % 3
    return tuple(new), tuple(spun)


def pocket_cube(spark: SparkSession, most: int | None = None) -> DataFrame:
    """The edges of a pocket cube's graph: nodes are its 7! * 3**6 states, edges its quarter turns of three faces either way, of weight 1. Permutations are dealt to tasks; `most` keeps the first so many of them."""

    def run(frames):
        for pdf in frames:
            for text in pdf["order"]:
                order, out = tuple(map(int, text)), []
                for code in range(3 ** (CORNERS - 1)):
                    twist, rest = [], code
                    for _ in range(CORNERS - 1):
                        twist.append(rest % 3)
                        rest //= 3
                    twist = twist[::-1]
                    twist.append(-sum(twist) % 3)
                    own = cube_number(order, tuple(twist))
                    for face in TURNS:
                        to = cube_number(*turned(order, twist, face))
                        out += [(own, to), (to, own)]
                yield pd.DataFrame(out, columns=["src", "dst"])

    orders = ["".join(map(str, p)) for p in permutations(range(CORNERS))][:most]
    rows = spark.createDataFrame([(x,) for x in orders], "order string").repartition(64)
    one = F.lit(1).cast("bigint")
    return rows.mapInPandas(run, "src long, dst long").distinct().select("src", "dst", one.alias("dur"), one.alias("dist"))


def archive(cells: DataFrame, path: str) -> DataFrame:
    """Writes the smallest lossless form of cells(block, i, j, dur) below path and returns what each form would take."""
    parts, forms = matrices.compressed(cells)
    parts.write.mode("overwrite").option("compression", "zstd").partitionBy("form").parquet(path)
    return forms


def unarchived(spark: SparkSession, path: str) -> DataFrame:
    """The cells of an archive."""
    return spark.read.parquet(path).select("block", "i", "j", (F.col("base") + F.col("residual")).alias("dur"))
