"""Constraints and objectives of whole plans, as additive penalties over route metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import HARD
from .walk import FOREVER


def plan_totals(routes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Vehicles used, cost, travel, distance, makespan and spread of each plan (by), or of all routes."""
    return routes.groupBy(*(by or [])).agg(
        F.count("*").alias("vehicles_used"),
        F.sum("cost").alias("cost"),
        F.sum("travel_s").alias("travel_s"),
        F.sum("distance").alias("distance"),
        F.max("span_s").alias("makespan"),
        F.when(F.count("*") < 2, 0).otherwise(F.max("span_s") - F.min("span_s")).cast("bigint").alias("spread_s"),
        F.when(F.count("*") < 2, 0).otherwise(F.max("load_max") - F.min("load_max")).cast("bigint").alias("spread_load"),
    )


def over(value: Column, cap: float) -> Column:
    """A hard cap's penalty."""
    return F.greatest(value - cap, F.lit(0)) * HARD


def penalties(totals: DataFrame, max_vehicles: int | None = None, vehicle: float = 0.0, cost_cap: float | None = None, makespan_cap: float | None = None, makespan: float = 0.0, distance_cap: float | None = None, distance: float = 0.0, fairness: float = 0.0, fair_cap: float | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """totals with the penalty of each constraint given, and the objective."""
    parts = {"p_vehicles": over(F.col("vehicles_used"), max_vehicles) if max_vehicles is not None else F.lit(0.0)}
    parts["p_count"] = F.col("vehicles_used") * vehicle
    parts["p_cost"] = over(F.col("cost"), cost_cap) if cost_cap is not None else F.lit(0.0)
    parts["p_makespan"] = (over(F.col("makespan"), makespan_cap) if makespan_cap is not None else F.lit(0.0)) + F.col("makespan") * makespan
    parts["p_distance"] = (over(F.col("distance"), distance_cap) if distance_cap is not None else F.lit(0.0)) + F.col("distance") * distance
    parts["p_fair"] = F.col("spread_s") * fairness + (over(F.col("spread_s"), fair_cap) if fair_cap is not None else F.lit(0.0))
    parts["p_weights"] = sum((F.col(k) * (w - 1) for k, w in (weights or {}).items()), F.lit(0.0))
    out = totals.withColumns({k: v.cast("double") for k, v in parts.items()})
    return out.withColumn("objective", F.col("cost") + sum((F.col(k) for k in parts), F.lit(0.0)))


def served_of_groups(jobs: DataFrame, served: DataFrame, least: int, most: int) -> DataFrame:
    """For each group of jobs: how many are served, and the hard penalty for fewer than least or more than most."""
    hits = jobs.where("grp IS NOT NULL").select("job", "grp").join(served.select("job", F.lit(1).alias("hit")).distinct(), "job", "left")
    out = hits.groupBy("grp").agg(F.count("*").alias("jobs"), F.count("hit").alias("served"))
    return out.withColumn("penalty", (F.greatest(least - F.col("served"), F.lit(0)) + F.greatest(F.col("served") - most, F.lit(0))) * HARD)


def dock_peak(visits: DataFrame, seconds: int) -> DataFrame:
    """The largest load that stands at each dock at one time: visits(dock, start, amount) hold it for [start, start + seconds).

    A sweep over starts and ends: at equal times ends come first. One sort a dock, no pairs of visits.
    """
    ends = visits.select("dock", (F.col("start") + seconds).alias("at"), (-F.col("amount")).alias("delta"), F.lit(0).alias("kind"))
    marks = visits.select("dock", F.col("start").alias("at"), F.col("amount").alias("delta"), F.lit(1).alias("kind")).unionByName(ends)
    steps = marks.groupBy("dock", "at", "kind").agg(F.sum("delta").alias("delta"))
    running = F.sum("delta").over(Window.partitionBy("dock").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("load", running).groupBy("dock").agg(F.max("load").alias("peak"))


def precedence_breaks(steps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) that stand on one route with b before a, by their first positions."""
    first = steps.groupBy("route_id", "job").agg(F.min("seq").alias("seq"))
    a = first.select("route_id", F.col("job").alias("a"), F.col("seq").alias("seq_a"))
    b = first.select("route_id", F.col("job").alias("b"), F.col("seq").alias("seq_b"))
    return pairs.join(a, "a").join(b, ["route_id", "b"]).where("seq_a >= seq_b").select("route_id", "a", "b", "seq_a", "seq_b")


def lexicographic(plans: DataFrame, levels: list[str]) -> DataFrame:
    """The best plan, level by level, ties to the smaller plan id."""
    return plans.orderBy(*levels, "plan_id").limit(1)


#: Names that objectives may be given by.
MEASURES = {"vehicles": "vehicles_used", "vehicle_count": "vehicles_used", "cost": "cost", "distance": "distance", "duration": "travel_s", "travel": "travel_s", "makespan": "makespan", "unassigned": "unassigned", "spread": "spread_s"}


def parse_objective(given: dict | str | None) -> tuple[str, list[str]]:
    """(`scalar` or `lexicographic`, levels) of an objective as problems name it."""
    if given is None or given == "scalar":
        return "scalar", ["cost"]
    levels = [x["measure"] if isinstance(x, dict) else x for x in (given.get("levels", []) if isinstance(given, dict) else [])]
    unknown = [x for x in levels if x not in MEASURES]
    if unknown or not levels:
        raise ValueError(f"unknown objective: {unknown or given}")
    return "lexicographic", [MEASURES[x] for x in levels]


def unassigned_cost(unassigned: DataFrame, penalty: float = 0.0, cap: int | None = None) -> DataFrame:
    """What single jobs left out cost: penalty each, and a hard penalty above the cap; shipments are not counted. unassigned(plan_id, job, kind)."""
    n = F.count_if(F.coalesce("kind", F.lit("job")) == "job")
    hard = F.greatest(n - cap, F.lit(0)) * HARD if cap is not None else F.lit(0.0)
    return unassigned.groupBy("plan_id").agg(n.alias("jobs"), (n * penalty + hard).cast("double").alias("penalty"))


def soft_by_default(jobs: DataFrame) -> DataFrame:
    """Whether soft windows are on where nobody says: if any job has a window that ends."""
    ends = F.exists("windows", lambda w: (w["start"] > 0) | (w["end"] < FOREVER))
    return jobs.agg(F.coalesce(F.max(ends), F.lit(False)).alias("soft"))


#: What a dimension may be given, with defaults.
DIMENSION = {"name": None, "start": 0, "min": None, "max": None, "soft_min": None, "soft_max": None, "penalty": 0.0, "transit": None}


def parse_dimensions(given: list[dict] | None) -> list[dict]:
    """Dimensions as problems name them, with defaults; unknown options, missing names and bounds that cross are errors."""
    out = []
    for one in given or []:
        unknown = set(one) - set(DIMENSION)
        if unknown or not one.get("name"):
            raise ValueError(f"a dimension has a name and no {sorted(unknown)}")
        full = DIMENSION | one
        for lo, hi in (("min", "max"), ("soft_min", "soft_max")):
            if full[lo] is not None and full[hi] is not None and full[lo] > full[hi]:
                raise ValueError(f"{full['name']}: {lo} is above {hi}")
        out.append(full)
    if len({x["name"] for x in out}) < len(out):
        raise ValueError("two dimensions have one name")
    return out
