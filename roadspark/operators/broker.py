"""Buying travel-time cells under a budget: what to ask, what is known, what to derive."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import stored

#: Neighbours bought for each place, margin, landmark rows, and hotspot limits.
GRANULAR, MARGIN, LANDMARKS = 20, 10, 32
HOT_MIN, HOT_SHARE = 2, 0.15


def skeleton(prior: DataFrame, landmarks: DataFrame, depots: DataFrame, k: int = GRANULAR + MARGIN) -> DataFrame:
    """The cells to buy, once each, with the first reason and order: 1 near by the prior (both ways), 2 the rows and columns of depots(l), 3 those of landmarks(l)."""
    order = Window.partitionBy("i").orderBy("dur", "j")
    near = prior.where("i <> j").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ways = near.select("i", "j", F.lit(1).alias("why")).unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(1).alias("why")))
    lines = [ways]
    for why, places in ((2, depots), (3, landmarks)):
        for side in ("i", "j"):
            own = places.select(F.col("l").alias(side)).distinct()
            lines.append(prior.where("i <> j").join(own, side, "left_semi").select("i", "j", F.lit(why).alias("why")))
    return reduce(DataFrame.unionByName, lines).groupBy("i", "j").agg(F.min("why").alias("why"))


def observed(reports: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """n, mean and m2 (sum of squared deviations) of each key, mergeable."""
    return reports.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def merged(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables of observed() as one, by the parallel update of mean and m2."""
    both = left.select(*keys, "n", "mean", "m2").unionByName(right.select(*keys, "n", "mean", "m2"))
    sums = both.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")).alias("q"))
    return sums.select(*keys, "n", (F.col("s") / F.col("n")).alias("mean"), F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0)).alias("m2"))


def deviation() -> Column:
    """Population deviation of an observed() row."""
    return F.sqrt(F.col("m2") / F.col("n"))


def hotspots(cells: DataFrame) -> DataFrame:
    """Cells that vary enough to be asked again."""
    return cells.where((F.col("n") >= HOT_MIN) & (deviation() >= HOT_SHARE * F.greatest("mean", F.lit(1.0))))


def priced(cells: DataFrame, known: DataFrame, keys: list[str], weight: float = 1.0) -> DataFrame:
    """Cells with what is known: round(mean + weight * deviation); null where nothing is."""
    return cells.join(known, keys, "left").withColumn("dur", F.round(F.col("mean") + weight * deviation()).cast("bigint"))


def affordable(cells: DataFrame, price: Column, budget: float, order: list[str]) -> DataFrame:
    """The longest prefix (by order) whose prices sum to no more than budget."""
    running = F.sum(price).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return cells.withColumn("spent", running).where(F.col("spent") <= budget)


def affordable_blocks(cells: DataFrame, price: Column, budget: float, order: list[str], block: Column) -> DataFrame:
    """affordable() without one task for all rows: blocks (which follow the order) are summed first, then walked."""
    rows = cells.withColumn("block", block).withColumn("price", price)
    sums = rows.groupBy("block").agg(F.sum("price").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sums.select("block", before.alias("before")), "block")
    inside = F.sum("price").over(Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("spent", F.col("before") + inside).where(F.col("spent") <= budget).drop("before", "block", "price")


def rare_pruned(cells: DataFrame, seen: DataFrame, least: int, long_range: int) -> DataFrame:
    """Cells without the long ones to places seen fewer than `least` times."""
    rows = cells.join(seen.select(F.col("place").alias("j"), "seen"), "j", "left")
    return rows.where((F.col("dur") < long_range) | (F.coalesce("seen", F.lit(0)) >= least)).drop("seen")


def assembled(prior: DataFrame, bought: DataFrame) -> DataFrame:
    """prior with what was bought in its place, and whether it was; zero on the diagonal."""
    rows = prior.select("i", "j", "dur").join(bought.select("i", "j", F.col("dur").alias("paid")), ["i", "j"], "left")
    return rows.select("i", "j", F.when(F.col("i") == F.col("j"), 0).otherwise(F.coalesce("paid", "dur")).cast("bigint").alias("dur"), F.col("paid").isNotNull().alias("bought"))


def legs_by(now: DataFrame, landmarks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells of now that lead to landmarks (i, l, il) and off them (l, j, lj)."""
    marks = landmarks.select("l").distinct()
    return now.join(marks.select(F.col("l").alias("j")), "j", "left_semi").select("i", F.col("j").alias("l"), F.col("dur").alias("il")), now.join(marks.select(F.col("l").alias("i")), "i", "left_semi").select(F.col("i").alias("l"), "j", F.col("dur").alias("lj"))


def metric_gate(prior: DataFrame, bought: DataFrame, landmarks: DataFrame) -> DataFrame:
    """How many (bought pair, landmark) exceed the way through the landmark by more than 2 seconds and 1 % of the pair, and whether fewer than 2 % do; not without landmarks. All pairs are checked."""
    now = assembled(prior, bought)
    to, off = legs_by(now, landmarks)
    rows = now.where("bought AND i <> j").join(to, "i").join(off, ["l", "j"]).where("l <> i AND l <> j")
    out = rows.agg(F.count("*").alias("checked"), F.count_if(F.col("dur") > F.col("il") + F.col("lj") + 2 + F.floor(F.col("dur") / 100)).alias("broken"))
    some = landmarks.agg((F.count("*") > 0).alias("some"))
    return out.join(some, how="cross").select("checked", "broken", (F.col("some") & ((F.col("checked") == 0) | (F.col("broken") * 50 < F.col("checked")))).alias("ok"))  # one row each


def derived(prior: DataFrame, bought: DataFrame, landmarks: DataFrame) -> DataFrame:
    """All cells: bought where bought, else the best way through a landmark, else the prior; zero on the diagonal."""
    now = assembled(prior, bought)
    to, off = legs_by(now, landmarks)
    via = to.join(off, "l").groupBy("i", "j").agg(F.min(F.col("il") + F.col("lj")).alias("via"))
    own = F.col("i") == F.col("j")
    rows = now.join(via, ["i", "j"], "left")
    how = F.when(own, "zero").when(F.col("bought"), "bought").when(F.col("via").isNotNull(), "derived").otherwise("prior")
    return rows.select("i", "j", F.when(own | F.col("bought"), F.col("dur")).otherwise(F.coalesce("via", "dur")).cast("bigint").alias("dur"), how.alias("how"))


@dataclass(frozen=True)
class Policy:
    """What to buy: neighbours and margin, the weight of a cell's deviation, a budget in cells, and whether to derive at all."""

    granular: int = GRANULAR
    margin: int = MARGIN
    weight: float = 1.0
    budget: int | None = None
    derive: bool = True


def matrix(prior: DataFrame, source: DataFrame, landmarks: DataFrame, depots: DataFrame, known: DataFrame | None = None, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """The whole loop for cells(i, j, dur): what is known is served, misses are bought from source (the budget's prefix), their observations join the known, and the rest is derived where the metric gate lets it.

    known has (i, j, n, mean, m2). Returns cells (i, j, dur, how) and the known cells after it. All is bought
    where policy derives nothing, or for rows of no more cells than are bought of each anyway.
    """
    keys = ["i", "j"]
    known = prior.select(*keys).where("false").select(*keys, F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")) if known is None else known
    buys = policy.granular + policy.margin
    few = prior.groupBy("i").agg(F.count("*").alias("width")).where(F.col("width") <= buys + 2).select("i") if policy.derive else prior.select("i").distinct()
    whole = prior.join(few, "i", "left_semi").where("i <> j").select(*keys, F.lit(0).alias("why"))
    wanted = stored(whole.unionByName(skeleton(prior.join(few, "i", "left_anti"), landmarks, depots, buys)), "wanted")
    hits = wanted.join(known.select(*keys), keys, "left_semi")
    misses = wanted.join(known.select(*keys), keys, "left_anti")
    if policy.budget is not None:
        misses = affordable_blocks(misses, F.lit(1), policy.budget, ["why", "i", "j"], F.col("why") * 10**12 + F.col("i"))
    bought = stored(source.join(misses.select(*keys), keys, "left_semi").select(*keys, F.col("dur").cast("double").alias("value")), "bought")
    now = stored(merged(known, observed(bought, keys), keys), "known")
    baked = stored(now.join(hits.select(*keys).unionByName(bought.select(*keys)), keys, "left_semi").select(*keys, F.round(F.col("mean") + policy.weight * deviation()).cast("bigint").alias("dur")), "baked")
    ok = policy.derive and metric_gate(prior, baked, landmarks).head()["ok"]
    return derived(prior, baked, landmarks if ok else landmarks.where("false")), now


def summary(cells: DataFrame) -> DataFrame:
    """Cells by origin, and the share saved over buying all."""
    n = F.count_if(F.col("how") != "zero")
    return cells.agg(n.alias("cells"), F.count_if(F.col("how") == "bought").alias("bought"), F.count_if(F.col("how") == "derived").alias("derived"), F.round(1 - F.count_if(F.col("how") == "bought") / n, 9).alias("saved"))
