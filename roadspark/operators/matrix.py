"""Travel-time matrices as tall tables cells(i, j, dur, dist): checks, derivation through landmarks, bounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine, road_metres, road_seconds
from ..plans.lineage import discarded, stored


def straight_line(sites: DataFrame, pairs: DataFrame) -> DataFrame:
    """cells of pairs(i, j) between sites(place, lat, lon), from straight lines; the diagonal is zero."""
    a = sites.select(F.col("place").alias("i"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = sites.select(F.col("place").alias("j"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    metres = haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    rows = pairs.join(a, "i").join(b, "j")
    own = F.col("i") == F.col("j")
    return rows.select("i", "j", F.when(own, 0).otherwise(road_seconds(metres)).alias("dur"), F.when(own, 0).otherwise(road_metres(metres)).alias("dist"))


def from_rows(rows: DataFrame) -> DataFrame:
    """cells of a matrix given as rows(i, durations); rows that are not square are an error."""
    n = rows.count()
    cells = rows.select("i", F.posexplode("durations").alias("j", "dur"), F.size("durations").alias("n"))
    checked = F.when(F.col("n") == n, F.col("dur")).otherwise(F.raise_error(F.lit("the matrix is not square")))
    return cells.select("i", F.col("j").cast("bigint").alias("j"), F.greatest(F.least(checked.cast("bigint"), F.lit(2**31 - 1)), F.lit(-(2**31))).alias("dur"))


def validation(cells: DataFrame, sentinel: int = 1_000_000_000) -> DataFrame:
    """One row of counts: negative, nonzero diagonal, unreachable, asymmetric pairs, and triangles broken by more than 2."""
    back = cells.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("dur").alias("back"))
    sums = cells.agg(
        F.count("*").alias("cells"),
        F.count_if(F.col("dur") < 0).alias("negative"),
        F.count_if((F.col("i") == F.col("j")) & (F.col("dur") != 0)).alias("diagonal"),
        F.count_if(F.col("dur") >= sentinel).alias("unreachable"),
    )
    asym = cells.where("i < j").join(back, ["i", "j"]).agg(F.count_if(F.col("dur") != F.col("back")).alias("asymmetric"), F.sum(F.abs(F.col("dur") - F.col("back"))).alias("gap"), F.sum(F.col("dur") + F.col("back")).alias("total"))
    asym = asym.select("asymmetric", F.round(F.coalesce(F.try_divide("gap", "total"), F.lit(0.0)), 9).alias("asymmetry"))
    return sums.join(asym, how="cross").join(triangles(cells, sentinel).agg(F.count("*").alias("triangles")), how="cross")


def triangles(cells: DataFrame, sentinel: int = 1_000_000_000, slack: int = 2) -> DataFrame:
    """Pairs whose duration exceeds the best way through a third point by more than slack."""
    good = cells.where(F.col("dur") < sentinel)
    via = min_plus(good, good)
    return good.join(via, ["i", "j"]).where(F.col("dur") > F.col("via") + slack).select("i", "j", "dur", "via")


def examples(cells: DataFrame, most: int = 24) -> DataFrame:
    """The first offending cells, in order."""
    kind = F.when(F.col("dur") < 0, "negative").when((F.col("i") == F.col("j")) & (F.col("dur") != 0), "diagonal")
    return cells.withColumn("kind", kind).where("kind IS NOT NULL").orderBy("i", "j").limit(most)


def min_plus(left: DataFrame, right: DataFrame) -> DataFrame:
    """i, j and via: the least dur of left(i, l) plus right(l, j)."""
    a = left.select("i", F.col("j").alias("l"), F.col("dur").alias("d1"))
    b = right.select(F.col("i").alias("l"), "j", F.col("dur").alias("d2"))
    return a.join(b, "l").groupBy("i", "j").agg(F.min(F.col("d1") + F.col("d2")).alias("via"))


def through_landmarks(cells: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Every cell's base through landmarks(l), and what is left: base + residual restores the cell."""
    marks = landmarks.select("l")
    base = min_plus(cells.join(marks.withColumnRenamed("l", "j"), "j", "left_semi"), cells.join(marks.withColumnRenamed("l", "i"), "i", "left_semi"))
    return cells.join(base, ["i", "j"], "left").select("i", "j", "dur", F.col("via").alias("base"), (F.col("dur") - F.coalesce("via", F.lit(0))).alias("residual"))


def restored(parts: DataFrame) -> DataFrame:
    """The cells of through_landmarks()'s rows."""
    return parts.select("i", "j", (F.coalesce("base", F.lit(0)) + F.col("residual")).alias("dur"))


def bounds(cells: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Lower and upper bounds of every cell from the landmarks' rows and columns alone."""
    marks = landmarks.select("l")
    to = cells.join(marks.withColumnRenamed("l", "j"), "j", "left_semi").select("i", F.col("j").alias("l"), F.col("dur").alias("il"))
    off = cells.join(marks.withColumnRenamed("l", "i"), "i", "left_semi").select(F.col("i").alias("l"), "j", F.col("dur").alias("lj"))
    both = to.join(off, "l")
    il = to.select(F.col("i").alias("j"), "l", F.col("il").alias("jl"))
    li = off.select(F.col("j").alias("i"), "l", F.col("lj").alias("li"))
    rows = both.join(il, ["j", "l"]).join(li, ["i", "l"])
    return rows.groupBy("i", "j").agg(F.max(F.greatest(F.col("il") - F.col("jl"), F.col("lj") - F.col("li"), F.lit(0))).alias("lower"), F.min(F.col("il") + F.col("lj")).alias("upper"))


def voronoi(cells: DataFrame, landmarks: DataFrame) -> DataFrame:
    """The nearest landmark of every column; ties go to the smaller landmark."""
    near = cells.join(landmarks.select(F.col("l").alias("i")), "i", "left_semi")
    return near.groupBy("j").agg(F.min(F.struct("dur", F.col("i").alias("l"))).alias("w")).select("j", "w.l", "w.dur")


def block_residuals(parts: DataFrame, regions: DataFrame) -> DataFrame:
    """The largest absolute residual of each row and region, saturated at 255, and whether a tolerance of 5 holds."""
    rows = parts.join(regions.select("j", "l"), "j").groupBy("i", "l").agg(F.max(F.least(F.abs("residual"), F.lit(255))).alias("most"))
    return rows.withColumn("within", F.col("most") <= 5)


def shuffled(cells: DataFrame) -> DataFrame:
    """A table that grows with the cells, for joins: never broadcast, however few bytes its files take (columns of numbers that repeat take a hundredth of what a driver needs for them)."""
    return cells.hint("merge")


def farthest_landmarks(cells: DataFrame, count: int) -> DataFrame:
    """Landmarks by farthest point on symmetrised durations, from one end of the widest pair; ties to the smaller id: block, l, rank. `count` rounds.

    cells(block, i, j, dur): blocks are matrices of their own, and all of them take a landmark a round.
    """
    back = cells.select("block", F.col("i").alias("j"), F.col("j").alias("i"), F.col("dur").alias("back"))
    both = stored(cells.join(shuffled(back), ["block", "i", "j"]).select("block", "i", "j", F.greatest("dur", "back").alias("far")), "far")
    widest = lambda rows, far: rows.groupBy("block").agg(F.max(F.struct(far, (-F.col("i")).alias("n"))).alias("w")).select("block", (-F.col("w.n")).alias("l"))
    chosen = stored(widest(both, "far").withColumn("rank", F.lit(1)), "landmarks")
    for rank in range(2, count + 1):
        near = both.join(chosen.select("block", F.col("l").alias("j")), ["block", "j"], "left_semi").groupBy("block", "i").agg(F.min("far").alias("near"))
        near = near.join(chosen.select("block", F.col("l").alias("i")), ["block", "i"], "left_anti")
        chosen, last = stored(chosen.unionByName(widest(near, "near").withColumn("rank", F.lit(rank))), "landmarks"), chosen
        discarded(last)
    return chosen


def max_min_landmarks(prior: DataFrame, count: int) -> DataFrame:
    """Landmarks of a broker by block: the place with the largest mean of both ways first, then greedily the farthest from those chosen; ties to the smaller id: block, l, rank."""
    back = prior.select("block", F.col("i").alias("j"), F.col("j").alias("i"), F.col("dur").alias("back"))
    mean = prior.join(shuffled(back), ["block", "i", "j"]).select("block", "i", "j", F.floor((F.col("dur") + F.col("back")) / 2).alias("dur"))
    return farthest_landmarks(mean, count)


def pivot_landmarks(cells: DataFrame, count: int, pairs: int | None = None) -> DataFrame:
    """Landmarks that bridge best, by block: greedily the place that lowers the summed min-plus bases of sampled pairs most; the first of equals wins: block, l, rank.

    The sample is by hash, of about clamp(4n, 512, 4096) pairs of each block (all of a smaller one), so that a
    round is one aggregate of pairs times places.
    """
    cells = cells.select("block", "i", "j", "dur")
    n = cells.groupBy("block").agg(F.approx_count_distinct("i").alias("n"), F.count("*").alias("total"))
    most = F.lit(pairs) if pairs else F.greatest(F.least(4 * F.col("n"), F.lit(4096)), F.lit(512))
    sample = cells.where("i <> j").join(F.broadcast(n), "block").where(F.pmod(F.xxhash64("i", "j"), F.lit(1 << 20)) * F.col("total") < most.cast("bigint") * (1 << 20)).select("block", "i", "j")
    legs = stored(sample.join(cells.select("block", "i", F.col("j").alias("l"), F.col("dur").alias("il")), ["block", "i"]).join(cells.select("block", F.col("i").alias("l"), "j", F.col("dur").alias("lj")), ["block", "l", "j"]).select("block", "i", "j", "l", (F.col("il") + F.col("lj")).alias("via")), "vias")
    chosen = legs.where("false").select("block", "l", F.lit(0).alias("rank"))
    for rank in range(1, count + 1):
        best = legs.join(chosen.select("block", "l"), ["block", "l"], "left_semi").groupBy("block", "i", "j").agg(F.min("via").alias("best"))
        costs = legs.join(best, ["block", "i", "j"], "left").groupBy("block", "l").agg(F.sum(F.least("via", F.coalesce("best", "via"))).alias("cost")).join(chosen.select("block", "l"), ["block", "l"], "left_anti")
        more = costs.groupBy("block").agg(F.min(F.struct("cost", "l")).alias("w")).select("block", "w.l", F.lit(rank).alias("rank"))
        chosen = stored(chosen.unionByName(more), "pivots")
    return chosen


def nearest_columns(cells: DataFrame, k: int) -> DataFrame:
    """The k nearest columns of every row, itself excluded, ties to the smaller id."""
    order = Window.partitionBy("i").orderBy("dur", "j")
    return cells.where("i <> j").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("i", "j", "dur", "rank")


def medoids(cells: DataFrame, members: DataFrame) -> DataFrame:
    """The member of each cluster with the least sum of durations to the others; ties to the smaller id."""
    a, b = members.select(F.col("place").alias("i"), "cluster"), members.select(F.col("place").alias("j"), F.col("cluster").alias("other"))
    sums = cells.join(a, "i").join(b, "j").where("cluster = other").groupBy("cluster", "i").agg(F.sum("dur").alias("total"))
    return sums.groupBy("cluster").agg(F.min(F.struct("total", "i")).alias("w")).select("cluster", F.col("w.i").alias("medoid"), "w.total")


def rank_one(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks between two regions as first column plus first row minus corner, and what is left of each cell."""
    rows = cells.join(regions.select(F.col("place").alias("i"), F.col("cluster").alias("ci")), "i").join(regions.select(F.col("place").alias("j"), F.col("cluster").alias("cj")), "j")
    block = Window.partitionBy("ci", "cj")
    rows = rows.withColumns({"i0": F.min("i").over(block), "j0": F.min("j").over(block)})
    corner = rows.where("i = i0 AND j = j0").select("ci", "cj", F.col("dur").alias("c00"))
    col0 = rows.where("j = j0").select("ci", "cj", "i", F.col("dur").alias("col0"))
    row0 = rows.where("i = i0").select("ci", "cj", "j", F.col("dur").alias("row0"))
    out = rows.join(corner, ["ci", "cj"]).join(shuffled(col0), ["ci", "cj", "i"]).join(shuffled(row0), ["ci", "cj", "j"])
    return out.select("i", "j", "dur", (F.col("dur") - (F.col("col0") + F.col("row0") - F.col("c00"))).alias("residual"))


def default_landmarks(n: int) -> int:
    return max(2, min(64, n // 40))


def window_proximity(cells: DataFrame, places: DataFrame, wait_weight: float = 0.2, warp_weight: float = 1.0) -> DataFrame:
    """How well two places follow each other: travel plus weighted forced waiting and lateness, the better of both ways: i, j, near.

    places(place, ready, due, service).
    """
    a = places.select(F.col("place").alias("i"), F.col("ready").alias("ri"), F.col("due").alias("di"), F.col("service").alias("si"))
    b = places.select(F.col("place").alias("j"), F.col("ready").alias("rj"), F.col("due").alias("dj"))
    rows = cells.where("i <> j").join(a, "i").join(b, "j")
    wait = F.greatest(F.col("rj") - F.col("si") - F.col("dur") - F.col("di"), F.lit(0))
    warp = F.greatest(F.col("ri") + F.col("si") + F.col("dur") - F.col("dj"), F.lit(0))
    one = rows.select("i", "j", (F.col("dur") + wait_weight * wait + warp_weight * warp).alias("way"))
    back = one.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("way").alias("back"))
    return one.join(back, ["i", "j"]).select("i", "j", F.least("way", "back").alias("near"))


#: Forms that `compressed` tries: rank-one blocks of regions, and so many landmarks.
REGIONS, BRIDGES = 8, (8, 16, 32, 64)


def encoded_bytes(residual: Column) -> Column:
    """Bytes of a whole number in zigzag and 7-bit groups."""
    z = F.when(residual >= 0, residual * 2).otherwise(-residual * 2 - 1)
    return F.when(z <= 0, 1).otherwise(F.floor(F.log2(z.cast("double")) / 7) + 1).cast("bigint")


def compressed(cells: DataFrame, bridges: tuple = BRIDGES, regions: int = REGIONS) -> tuple[DataFrame, DataFrame]:
    """The smallest form of each block of cells(block, i, j, dur), lossless: (parts, forms).

    parts(block, form, i, j, base, residual) restore a cell as base + residual; forms(block, form, bytes) has
    the size of every form tried, the form chosen first. Forms are `bridge-L` (min-plus through L landmarks by
    farthest point) and `cluster` (first column plus first row less corner, of blocks between regions).
    """
    cells = stored(cells.select("block", "i", "j", "dur"), "cells")
    tried = []
    marks = stored(farthest_landmarks(cells, max(bridges)), "landmarks")
    for count in bridges:
        some = marks.where(F.col("rank") <= count)
        to = cells.join(some.select("block", F.col("l").alias("j")), ["block", "j"], "left_semi").select("block", "i", F.col("j").alias("l"), F.col("dur").alias("il"))
        off = cells.join(some.select("block", F.col("l").alias("i")), ["block", "i"], "left_semi").select("block", F.col("i").alias("l"), "j", F.col("dur").alias("lj"))
        base = to.join(shuffled(off), ["block", "l"]).groupBy("block", "i", "j").agg(F.min(F.col("il") + F.col("lj")).alias("base"))
        tried.append(cells.join(shuffled(base), ["block", "i", "j"]).select("block", F.lit(f"bridge-{count}").alias("form"), "i", "j", "base", (F.col("dur") - F.col("base")).alias("residual")))
    near = cells.join(marks.where(F.col("rank") <= regions).select("block", F.col("l").alias("i")), ["block", "i"], "left_semi")
    own = near.groupBy("block", F.col("j").alias("place")).agg(F.min(F.struct("dur", "i")).alias("w")).select("place", F.col("w.i").alias("cluster"))
    tried.append(rank_one(cells.select("i", "j", "dur"), own).join(shuffled(cells.select("block", "i", "j")), ["i", "j"]).select("block", F.lit("cluster").alias("form"), "i", "j", (F.col("dur") - F.col("residual")).alias("base"), "residual"))
    every = stored(reduce(DataFrame.unionByName, tried), "forms")
    forms = every.groupBy("block", "form").agg(F.sum(encoded_bytes(F.col("residual"))).alias("bytes"))
    best = forms.groupBy("block").agg(F.min(F.struct("bytes", "form")).alias("w")).select("block", F.col("w.form").alias("chosen"))
    parts = every.join(best, "block").where("form = chosen").drop("chosen")
    return parts, forms.join(best, "block").select("block", "form", "bytes", (F.col("form") == F.col("chosen")).alias("is_best"))
