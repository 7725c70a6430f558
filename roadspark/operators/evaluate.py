"""Route evaluation.

Timing is a max-plus scan. With at most one window a stop, service starts at
t_k = max(t_(k-1) + service + travel_k + setup_k, ready_k), so t_k = C_k + max(start, max over j <= k of
(ready_j - C_j)) with C the running sum of travel and setup through k and of service before k: one running
sum and one running maximum per route. Loads, precedence, backhaul and reload trips are running sums and flags
over the same window, so a route is sorted once. Lateness carries forward: a late stop is served when reached.

Routes with several windows a stop, breaks or clamped (warp) time do not scan; `fold` walks those, route by
route, in Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine, road_metres, road_seconds

#: Legs of this many seconds or more cannot be driven.
UNREACHABLE = 100_000_000
#: A hard constraint's weight.
HARD = 1e12


def route_window() -> Window:
    return Window.partitionBy("route_id").orderBy("seq")


def legs(stops: DataFrame, depots: DataFrame) -> DataFrame:
    """stops with the leg that leads to each (leg_s, leg_m, setup_s) and, at the last, the leg home (home_s, home_m).

    Travel comes from coordinates, scaled by the vehicle's speed; setup counts where the location changes.
    """
    w = route_window()
    home = depots.select("route_id", F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon"), "capacity", "speed")
    rows = stops.join(home, "route_id")
    p_lat, p_lon = F.lag("lat").over(w), F.lag("lon").over(w)
    rows = rows.withColumns({"p_lat": F.coalesce(p_lat, "d_lat"), "p_lon": F.coalesce(p_lon, "d_lon"), "is_last": F.lead("seq").over(w).isNull(), "moved": p_lat.isNull() | (p_lat != F.col("lat")) | (p_lon != F.col("lon"))})
    scaled = lambda m: F.round(road_seconds(m) * F.greatest("speed", F.lit(0.01))).cast("bigint")
    there, back = haversine(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")), haversine(F.col("lat"), F.col("lon"), F.col("d_lat"), F.col("d_lon"))
    return rows.withColumns(
        {"leg_s": scaled(there), "leg_m": road_metres(there), "setup_s": F.when(F.col("moved"), F.col("setup")).otherwise(0), "home_s": F.when(F.col("is_last"), scaled(back)).otherwise(0), "home_m": F.when(F.col("is_last"), road_metres(back)).otherwise(0)}
    )


def timed(rows: DataFrame, start: Column | int = 0) -> DataFrame:
    """legs() with each stop's service start (arrival), wait, lateness, load before and after, and distance so far."""
    w = route_window().rowsBetween(Window.unboundedPreceding, 0)
    start = F.lit(start) if isinstance(start, int) else start
    rows = rows.withColumn("prior_service", F.coalesce(F.lag("service").over(route_window()), F.lit(0)))
    rows = rows.withColumn("clock", F.sum(F.col("leg_s") + F.col("setup_s") + F.col("prior_service")).over(w))
    rows = rows.withColumn("arrival", (F.col("clock") + F.greatest(start, F.max(F.col("ready") - F.col("clock")).over(w))).cast("bigint"))
    reached = F.coalesce(F.lag("arrival").over(route_window()) + F.col("prior_service"), start) + F.col("leg_s") + F.col("setup_s")
    total = F.sum("demand").over(Window.partitionBy("route_id"))
    return rows.withColumns(
        {
            "reached": reached.cast("bigint"),
            "wait_s": (F.col("arrival") - reached).cast("bigint"),
            "lateness": F.greatest(F.col("arrival") - F.col("due"), F.lit(0)).cast("bigint"),
            "load_before": (total - F.sum("demand").over(w) + F.col("demand")).cast("bigint"),
            "load_after": (total - F.sum("demand").over(w)).cast("bigint"),
            "distance": F.sum("leg_m").over(w).cast("bigint"),
        }
    )


def verdicts(rows: DataFrame, max_tasks: int | None = None, max_travel: int | None = None, max_distance: int | None = None) -> DataFrame:
    """The first violation of each route in walking order, or `ok`."""
    step = (
        F.when(F.col("leg_s") >= UNREACHABLE, "unreachable")
        .when((F.col("seq") == 1) & (F.col("load_before") > F.col("capacity")), "capacity exceeded at start")
        .when(F.col("lateness") > 0, "time window missed")
        .when(F.col("load_after") < 0, "negative load")
    )
    found = rows.withColumn("step", step).groupBy("route_id").agg(
        F.min_by("step", F.when(F.col("step").isNotNull(), F.col("seq"))).alias("first"),
        F.min(F.when(F.col("step").isNotNull(), F.col("seq"))).alias("at"),
        F.count("*").alias("tasks"),
        F.sum(F.col("leg_s") + F.col("home_s")).alias("travel_s"),
        F.sum(F.col("leg_m") + F.col("home_m")).alias("metres"),
    )
    rest = F.when(F.col("tasks") > max_tasks if max_tasks is not None else F.lit(False), "too many tasks")
    rest = rest.when(F.col("travel_s") > max_travel if max_travel is not None else F.lit(False), "travel time exceeded").when(F.col("metres") > max_distance if max_distance is not None else F.lit(False), "distance exceeded")
    return found.select("route_id", F.coalesce("first", rest, F.lit("ok")).alias("verdict"), "at")


def metrics(rows: DataFrame, fixed: float = 0.0, per_hour: float = 3600.0, time_weight: float = 1.0, distance_weight: float = 0.0, span_cost: float = 0.0, start: int = 0) -> DataFrame:
    """Sums, cost and spans of each route."""
    out = rows.groupBy("route_id").agg(
        F.count("*").alias("stops"),
        F.sum(F.col("leg_s") + F.col("home_s")).alias("travel_s"),
        F.sum("service").alias("service_s"),
        F.sum("wait_s").alias("wait_s"),
        F.sum("setup_s").alias("setup_s"),
        F.sum(F.col("leg_m") + F.col("home_m")).alias("distance"),
        F.max(F.col("arrival") + F.col("service") + F.col("home_s")).alias("end_time"),
        F.max("load_before").alias("load_max"),
        F.sum("lateness").alias("time_warp"),
        F.max("lateness").alias("max_lateness"),
        F.sum((F.col("lateness") > 0).cast("int")).alias("late_jobs"),
        F.max(F.greatest(F.col("load_before") - F.col("capacity"), F.lit(0))).alias("overload"),
    )
    travel = F.col("travel_s") * F.greatest(F.lit(per_hour) / 3600, F.lit(0.0)) * time_weight
    out = out.withColumns({"span_s": F.col("end_time") - start, "cost_travel": fixed + travel + F.col("distance") * distance_weight + F.col("service_s") * 1e-6})
    out = out.withColumn("cost_span", F.col("span_s") * F.lit(max(span_cost, 0.0)))
    return out.withColumn("cost", F.col("cost_travel") + F.col("cost_span"))


def softened(routes: DataFrame, late: float, load: float, over: float, shift_end: int) -> DataFrame:
    """routes with the soft penalty of lateness, peak overload and overrun added to the cost."""
    custom = F.col("time_warp") * late + F.col("overload") * load + F.greatest(F.col("end_time") - shift_end, F.lit(0)) * over
    return routes.withColumn("cost_custom", custom).withColumn("cost", F.col("cost") + F.col("cost_custom"))


def soft_weight(cost: Column, travel_s: Column, service_s: Column) -> Column:
    """The automatic weight of soft windows, from a reference plan's totals."""
    return F.greatest(F.least(1000 * cost / (travel_s + service_s), F.lit(1e5)), F.lit(10.0))


def rendered(rows: DataFrame) -> DataFrame:
    """A route's steps as printed: start, jobs with arrival, load, waiting (without release waits) and lateness, and end."""
    jobs = rows.select("route_id", F.col("seq"), F.lit("job").alias("kind"), "job", "arrival", F.col("load_after").alias("load"), "wait_s", "lateness", "distance")
    start = rows.where("seq = 1").select("route_id", F.lit(0).cast("bigint").alias("seq"), F.lit("start").alias("kind"), F.lit(None).cast("bigint").alias("job"), F.lit(0).cast("bigint").alias("arrival"), F.col("load_before").alias("load"), *[F.lit(0).cast("bigint").alias(c) for c in ("wait_s", "lateness", "distance")])
    end = rows.where("is_last").select("route_id", (F.col("seq") + 1).alias("seq"), F.lit("end").alias("kind"), F.lit(None).cast("bigint").alias("job"), (F.col("arrival") + F.col("service") + F.col("home_s")).alias("arrival"), F.col("load_after").alias("load"), F.lit(0).cast("bigint").alias("wait_s"), F.lit(0).cast("bigint").alias("lateness"), (F.col("distance") + F.col("home_m")).alias("distance"))
    return start.unionByName(jobs).unionByName(end)


def trips(steps: DataFrame) -> DataFrame:
    """steps (route_id, seq, kind, amount) with the trip each belongs to and the load that runs down within it.

    A reload returns to the depot and takes on the deliveries up to the next reload.
    """
    w = route_window()
    rows = steps.withColumn("trip", F.sum((F.col("kind") == "reload").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    inside = Window.partitionBy("route_id", "trip").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("route_id", "trip")
    own = F.when(F.col("kind") == "job", F.col("amount")).otherwise(0)
    return rows.withColumn("load", (F.sum(own).over(whole) - F.sum(own).over(inside)).cast("bigint"))


def backhaul_breaks(steps: DataFrame) -> DataFrame:
    """Steps of (route_id, seq, trip, is_backhaul, is_delivery) that deliver after a backhaul of their trip."""
    before = Window.partitionBy("route_id", "trip").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("after", F.max(F.col("is_backhaul").cast("int")).over(before)).where("is_delivery AND after = 1")


def cumulated(rows: DataFrame, transit: Column, first: Column | int, floor: int | None = None, ceiling: int | None = None, soft_floor: int | None = None, soft_ceiling: int | None = None, weight: float = 0.0) -> DataFrame:
    """A dimension along routes: its value after each step, whether a hard bound breaks, and the soft penalty."""
    first = F.lit(first) if isinstance(first, int) else first
    value = (first + F.sum(transit).over(route_window().rowsBetween(Window.unboundedPreceding, 0))).cast("bigint")
    rows = rows.withColumn("cumul", value)
    broken = F.lit(False)
    if floor is not None:
        broken = broken | (F.col("cumul") < floor) | (first < floor)
    if ceiling is not None:
        broken = broken | (F.col("cumul") > ceiling) | (first > ceiling)
    soft = F.lit(0.0)
    if soft_floor is not None:
        soft = soft + F.greatest(soft_floor - F.col("cumul"), F.lit(0)) * weight
    if soft_ceiling is not None:
        soft = soft + F.greatest(F.col("cumul") - soft_ceiling, F.lit(0)) * weight
    return rows.withColumns({"broken": broken, "penalty": soft})


FOLDED = "route_id long, seq long, arrival long, wait_s long, lateness long, break_s long"


def fold(rows: DataFrame, mode: str = "carry") -> DataFrame:
    """The general walk, route by route: several windows a stop, breaks, and clamped time.

    rows(route_id, seq, leg_s, setup_s, service, windows: array of (start, end), breaks: array of (service,
    start, end) by route). mode is `carry` (late stops are served when reached) or `warp` (the clock is set
    back to the window's end). Breaks are taken in order, each as soon as its window is open after a stop, at
    the latest at the end of the day.
    """
    if mode not in ("carry", "warp"):
        raise ValueError("mode is carry or warp")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, clock, out = pdf.sort_values("seq"), 0, []
        pauses = [] if pdf.empty or pdf["breaks"].iloc[0] is None else list(pdf["breaks"].iloc[0])
        for row in pdf.itertuples():
            clock += int(row.leg_s) + int(row.setup_s)
            windows = [] if row.windows is None else list(row.windows)
            late = wait = rest = 0
            if windows:
                still = [w for w in windows if w["end"] >= clock]
                if still:
                    wait = max(0, int(still[0]["start"]) - clock)
                else:
                    end = max(int(w["end"]) for w in windows)
                    late = clock - end
                    clock = end if mode == "warp" else clock
            clock += wait
            at = clock
            clock += int(row.service)
            while pauses and pauses[0]["start"] <= clock:
                rest += int(pauses[0]["service"])
                clock += int(pauses.pop(0)["service"])
            out.append((row.route_id, row.seq, at, wait, late, rest))
        if out and pauses:
            extra = sum(int(p["service"]) + max(0, int(p["start"]) - clock) for p in pauses[:1]) + sum(int(p["service"]) for p in pauses[1:])
            last = out[-1]
            out[-1] = (*last[:5], last[5] + extra)
        return pd.DataFrame(out, columns=[c.split()[0] for c in FOLDED.split(", ")])

    return rows.groupBy("route_id").applyInPandas(walk, FOLDED)


def verify(stored: DataFrame, recomputed: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Routes whose stored cost is not the recomputed one, or that stand on one side only."""
    both = stored.select("route_id", F.col("cost").alias("stored")).join(recomputed.select("route_id", F.col("cost").alias("found")), "route_id", "full")
    return both.where("stored IS NULL OR found IS NULL").unionByName(both.where(F.abs(F.col("stored") - F.col("found")) > tolerance))
