"""What can be told before a search: eligible vehicles, tightened windows, precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import allows, fits, has_skills
from ..plans.lineage import stored


#: Needs, or matches of needs and kinds, that are broadcast.
BROADCAST_NEEDS = 50_000


def _needed(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("need", F.xxhash64(F.sort_array("skills"), "amount")).select("job", "allowed", "need")


def _kinds(vehicles: DataFrame) -> DataFrame:
    return vehicles.withColumn("kind", F.xxhash64(F.sort_array("skills"), "capacity")).select("vehicle", "kind")


def _matches(jobs: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Which kinds of vehicles (skills, capacity) fit which needs (skills, amount): need, kind."""
    kinds = vehicles.groupBy(F.sort_array("skills").alias("own"), "capacity").agg(F.count("*").alias("n")).withColumn("kind", F.xxhash64("own", "capacity"))
    needs = jobs.groupBy(F.sort_array("skills").alias("req"), "amount").agg(F.count("*").alias("m")).withColumn("need", F.xxhash64("req", "amount"))
    return needs.join(F.broadcast(kinds), has_skills(F.col("req"), F.col("own")) & fits(F.col("amount"), F.col("capacity"))).select("need", "kind")


def eligible(jobs: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Which vehicles may serve which jobs: skills, allow-lists and capacity.

    jobs(job, skills, allowed, amount), vehicles(vehicle, skills, capacity). Vehicles of one kind are checked
    once: a job meets each distinct (skills, capacity), and the vehicles of fitting kinds by equi-join.
    """
    rows = _needed(jobs).join(_matches(jobs, vehicles), "need").join(_kinds(vehicles), "kind")
    return rows.where(allows(F.col("allowed"), F.col("vehicle"))).select("job", "vehicle")


def eligible_sums(jobs: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Of eligible()'s pairs, by job: their number (vehicles), the smallest vehicle (first) and the sum of vehicles (total); jobs without any have no row.

    Pairs are made for allow-lists alone: jobs without one take what the vehicles of all fitting kinds come to, summed by need.
    """
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_NEEDS else df
    sums = [F.count("*").alias("vehicles"), F.min("vehicle").alias("first"), F.sum("vehicle").alias("total")]
    more = [F.sum("vehicles").alias("vehicles"), F.min("first").alias("first"), F.sum("total").alias("total")]
    needed, match = _needed(jobs), stored(_matches(jobs, vehicles), "matches")
    own = stored(_kinds(vehicles), "kinds")
    by_need = stored(match.join(own.groupBy("kind").agg(*sums), "kind").groupBy("need").agg(*more), "needs")
    free = needed.where("allowed IS NULL").join(few(by_need), "need").select("job", "vehicles", "first", "total")
    listed = needed.where("allowed IS NOT NULL").select("job", "need", F.explode(F.array_distinct("allowed")).alias("vehicle")).join(own, "vehicle")
    listed = listed.join(few(match), ["need", "kind"], "left_semi").groupBy("job").agg(*sums)
    return free.unionByName(listed).groupBy("job").agg(*more)


def tightened(jobs: DataFrame, reach: DataFrame, soft: bool = False) -> DataFrame:
    """Windows narrowed to what some vehicle can keep.

    jobs(job, windows), reach(job, earliest, latest): for each eligible vehicle, when it can be there first and
    must start at the latest. Windows that become empty go; a job whose windows all go is infeasible. Soft mode
    only raises starts.
    """
    by = reach.groupBy("job").agg(F.min("earliest").alias("earliest"), F.max("latest").alias("latest"))
    rows = jobs.join(by, "job", "left")
    end = lambda w: w["end"] if soft else F.least(w["end"], F.col("latest"))
    cut = F.transform("windows", lambda w: F.struct(F.greatest(w["start"], F.col("earliest")).alias("start"), end(w).alias("end")))
    kept = F.filter(cut, lambda w: w["start"] <= w["end"]) if not soft else cut
    why = F.when(F.col("earliest").isNull(), "no vehicle").when(~F.lit(soft) & (F.size("windows") > 0) & (F.size(kept) == 0), "no window").when(~F.lit(soft) & (F.size("windows") == 0) & (F.col("earliest") > F.col("latest")), "too far")
    return rows.select("job", "earliest", "latest", kept.alias("windows"), why.alias("reason"))


def closure(pairs: DataFrame) -> DataFrame:
    """All (a, b) with a before b, by joining the closure with itself until it stops growing; a = b shows a circle."""
    now = stored(pairs.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), "closure")
    count = now.count()
    while True:
        longer = now.select("a", F.col("b").alias("m")).join(now.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        now = stored(now.union(longer).distinct(), "closure")
        if (new := now.count()) == count:
            return now
        count = new


def problems(vehicles: DataFrame, jobs: DataFrame) -> DataFrame:
    """What is wrong with a problem: no vehicle, or amounts of more dimensions than any capacity."""
    v = vehicles.agg(F.count("*").alias("vehicles"), F.coalesce(F.max(F.size("capacity")), F.lit(0)).alias("dims"))
    j = jobs.agg(F.coalesce(F.max(F.size("amount")), F.lit(0)).alias("need"))
    return v.join(j, how="cross").select(F.when(F.col("vehicles") == 0, "no vehicle").when(F.col("need") > F.col("dims"), "capacity dimensions").otherwise("ok").alias("verdict"))


def unassigned_reason(jobs: DataFrame, pairs: DataFrame, skilled: DataFrame) -> DataFrame:
    """Why a job stays out: `skills` (no vehicle has them), `vehicle` (none eligible) or `search`."""
    rows = jobs.select("job").join(pairs.select("job", F.lit(1).alias("ok")).distinct(), "job", "left").join(skilled.select("job", F.lit(1).alias("skilled")).distinct(), "job", "left")
    return rows.select("job", F.when(F.col("skilled").isNull(), "skills").when(F.col("ok").isNull(), "vehicle").otherwise("search").alias("reason"))
