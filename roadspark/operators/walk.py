"""The full route walk: every rule of a route, step by step, over sorted partitions in Arrow batches.

`evaluate` tells routes of one load dimension and one window a stop by running sums; this walk tells all others:
loads of several dimensions, deliveries, pickups and shipments, release times, several windows, breaks, reloads,
precedence, shift and travel limits, hard or soft. Legs are joined in before (raw seconds and metres from the
place before, whether that place is another), so a walk needs no matrix; a task holds one route's steps at a time.
Routes are as long as a vehicle's day; the number of routes is not bounded.

A route's verdict is `ok` or its first violation; a violated route has null sums. Null arrays count as empty,
null numbers as zero or as no limit.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..plans.lineage import spread
from .evaluate import UNREACHABLE

FOREVER = 2**62
#: The texts of verdicts, by rule.
VERDICTS = {
    "start": "capacity exceeded at route start",
    "skill": "vehicle missing required skill",
    "allowed": "job not allowed on this vehicle",
    "shipment": "delivery before pickup",
    "precedence": "precedence violated (a after b on the same route)",
    "on_board": "reload while a shipment is still on board",
    "to_reload": "unreachable leg (no road to depot for reload)",
    "reload": "capacity exceeded after reload",
    "backhaul": "linehaul after backhaul",
    "between": "unreachable leg (no road between stops)",
    "window": "time window missed",
    "negative": "negative load (over-delivery)",
    "load": "capacity exceeded mid-route",
    "break": "break time window missed",
    "tasks": "max_tasks exceeded",
    "home": "unreachable leg (no road back to depot)",
    "shift": "route ends after vehicle time window",
    "travel": "max_travel_time exceeded",
    "distance": "max_distance exceeded",
}
SUMS = "start_time long, end_time long, travel_s long, service_s long, wait_s long, setup_s long, distance long, tasks long, break_count long, break_s long, late_s double, overload double, overrun double, cost_travel double, cost_span double, cost_custom double, cost double"
STEPS = "route_id long, seq long, kind string, job long, arrival long, wait_s long, lateness long, load array<long>, distance long"


class Violated(Exception):
    """A broken rule, by its name in VERDICTS."""


@dataclass(frozen=True)
class Soft:
    """Weights of lateness, peak overload and overrun; warp sets a late clock back to the window's end."""

    late: float = 0.0
    load: float = 0.0
    over: float = 0.0
    warp: bool = False


def listed(x) -> list:
    """An array column's value as a list."""
    return [] if x is None or isinstance(x, float) else list(x)


def number(x, default=0):
    return default if x is None or x != x else x


def opened(windows: list, clock: int):
    """The first window that ends at clock or later; an empty list is open for ever."""
    if not windows:
        return 0, FOREVER
    return next(((w["start"], w["end"]) for w in windows if w["end"] >= clock), None)


def latest(windows: list):
    """The window with the latest end, the last of equals."""
    best = windows[0]
    for w in windows:
        best = w if w["end"] >= best["end"] else best
    return best["start"], best["end"]


class Load:
    """What is on board, by dimension, against the capacity."""

    def __init__(self, capacity: list, dims: int, soft: Soft | None):
        self.capacity, self.soft, self.peak = capacity, soft, 0
        self.now = [0] * max(dims, len(capacity), 1)

    def change(self, amounts, sign: int) -> None:
        for k, v in enumerate(listed(amounts)):
            self.now[k] += sign * int(v)

    def fill(self, steps: list[dict]) -> None:
        """Empties the vehicle and takes on the deliveries of jobs up to the next reload."""
        self.now = [0] * len(self.now)
        for s in steps:
            if s["kind"] == "reload":
                return
            if s["kind"] == "job":
                self.change(s["delivery"], 1)

    def check(self, rule: str) -> None:
        over = sum(max(0, have - int(cap)) for have, cap in zip(self.now, self.capacity))
        if over and self.soft is None:
            raise Violated(rule)
        self.peak = max(self.peak, over)


def first_rules(steps: list[dict], vehicle: dict) -> None:
    """What is checked for all steps before the walk: skills, allowed vehicles, pickups before deliveries, precedence."""
    skills, picked, place = set(listed(vehicle["v_skills"])), set(), {}
    for k, s in enumerate(steps):
        if s["kind"] == "reload":
            continue
        if not set(listed(s["skills"])) <= skills:
            raise Violated("skill")
        if s["allowed"] is not None and not isinstance(s["allowed"], float) and vehicle["vehicle"] not in listed(s["allowed"]):
            raise Violated("allowed")
        if s["kind"] == "pickup":
            picked.add(s["shipment"])
        elif s["kind"] == "delivery" and s["shipment"] not in picked:
            raise Violated("shipment")
        elif s["kind"] == "job":
            place.setdefault(s["job"], k)
    for pair in listed(vehicle.get("pairs")):
        if pair["a"] in place and pair["b"] in place and place[pair["a"]] > place[pair["b"]]:
            raise Violated("precedence")


def walk(steps: list[dict], vehicle: dict, soft: Soft | None = None) -> tuple[dict, list[tuple]]:
    """The sums of a route and its steps as (seq, kind, job, arrival, wait, lateness, load, distance); raises Violated."""
    dims = max((len(listed(s[c])) for s in steps for c in ("delivery", "pickup", "amount")), default=0)
    load = Load(listed(vehicle["capacity"]), dims, soft)
    load.fill(steps)
    load.check("start")
    first_rules(steps, vehicle)
    speed, clock = max(number(vehicle["speed"], 1.0), 0.01), int(number(vehicle["shift_start"]))
    end = int(number(vehicle["shift_end"], FOREVER))
    total = dict.fromkeys(("travel", "service", "wait", "setup", "distance", "tasks", "breaks", "rest", "late"), 0)
    breaks, on_board, collecting, out, begin = listed(vehicle["breaks"]), 0, False, [], clock

    def drive(raw, metres, rule: str) -> None:
        nonlocal clock
        if raw is None or raw != raw:  # no place to come from
            return
        if raw >= UNREACHABLE:
            raise Violated(rule)
        took = int(raw * speed + 0.5)
        clock += took
        total["travel"] += took
        total["distance"] += int(number(metres))

    for k, s in enumerate(steps):
        if s["kind"] == "reload":
            if on_board:
                raise Violated("on_board")
            drive(s["raw_s"], s["raw_m"], "to_reload")
            load.fill(steps[k + 1 :])
            load.check("reload")
            collecting = False
            out.append((s["seq"], "reload", None, clock, 0, 0, list(load.now), total["distance"]))
            continue
        on_board += (s["kind"] == "pickup") - (s["kind"] == "delivery")
        if s["kind"] == "job":
            brings, takes = listed(s["delivery"]), listed(s["pickup"])
            if takes and not brings:
                collecting = True
            elif brings and collecting:
                raise Violated("backhaul")
        drive(s["raw_s"], s["raw_m"], "between")
        setup = int(number(s["setup"])) if s["moved"] else 0
        clock += setup
        total["setup"] += setup
        released = max(0, int(number(s["release"])) - clock)
        clock += released
        windows = listed(s["windows"])
        chosen = opened(windows, clock)
        if chosen is None:
            if soft is None:
                raise Violated("window")
            chosen = latest(windows)
        waits = max(0, int(chosen[0]) - clock)
        clock += waits
        late = max(0, clock - int(chosen[1]))
        total["late"] += late
        if late and soft.warp:
            clock -= late
        total["wait"] += released + waits
        at = clock
        if s["kind"] == "job":
            load.change(s["delivery"], -1)
            load.change(s["pickup"], 1)
        else:
            load.change(s["amount"], 1 if s["kind"] == "pickup" else -1)
        if min(load.now) < 0:
            raise Violated("negative")
        load.check("load")
        service = int(number(s["service"]))
        clock += service
        total["service"] += service
        while breaks:
            pause = opened(listed(breaks[0]["windows"]), clock)
            if pause is None:
                raise Violated("break")
            if clock < pause[0]:
                break
            clock, total["breaks"], total["rest"] = clock + int(breaks[0]["service"]), total["breaks"] + 1, total["rest"] + int(breaks[0]["service"])
            breaks = breaks[1:]
        total["tasks"] += 1
        if total["tasks"] > number(vehicle["max_tasks"], FOREVER):
            raise Violated("tasks")
        out.append((s["seq"], s["kind"], s["job"], at, waits, late, list(load.now), total["distance"]))
    if steps:
        drive(steps[-1]["home_s"], steps[-1]["home_m"], "home")
    for rest in breaks:
        pause = opened(listed(rest["windows"]), clock)
        if pause is None:
            raise Violated("break")
        total["wait"] += max(0, pause[0] - clock)
        clock = max(clock, pause[0])
        clock, total["breaks"], total["rest"] = clock + int(rest["service"]), total["breaks"] + 1, total["rest"] + int(rest["service"])
    over = max(0, clock - end)
    if over and soft is None:
        raise Violated("shift")
    beyond = max(0, total["travel"] - number(vehicle["max_travel"], FOREVER))
    if beyond and soft is None:
        raise Violated("travel")
    if total["distance"] > number(vehicle["max_distance"], FOREVER):
        raise Violated("distance")
    weight = lambda c, default: number(vehicle.get(c), default)
    travel = weight("fixed", 0.0) + total["travel"] * max(weight("per_hour", 3600.0) / 3600, 0.0) * weight("time_weight", 1.0) + total["distance"] * weight("distance_weight", 0.0) + total["service"] * 1e-6
    span = (clock - begin) * max(weight("span_cost", 0.0), 0.0)
    custom = soft.late * total["late"] + soft.load * load.peak + soft.over * (over + beyond) if soft else 0.0
    sums = (begin, clock, total["travel"], total["service"], total["wait"], total["setup"], total["distance"], total["tasks"], total["breaks"], total["rest"], float(total["late"]), float(load.peak), float(over + beyond), travel, span, custom, travel + span + custom)
    return dict(zip((c.split()[0] for c in SUMS.split(", ")), sums)), out


STEP_COLUMNS = {"kind": "string", "job": "bigint", "shipment": "bigint", "delivery": "array<bigint>", "pickup": "array<bigint>", "amount": "array<bigint>", "skills": "array<int>", "allowed": "array<bigint>", "setup": "bigint", "release": "bigint", "service": "bigint", "windows": "array<struct<start:bigint,end:bigint>>", "raw_s": "bigint", "raw_m": "bigint", "moved": "boolean", "home_s": "bigint", "home_m": "bigint"}
VEHICLE_COLUMNS = {"vehicle": "bigint", "capacity": "array<bigint>", "v_skills": "array<int>", "shift_start": "bigint", "shift_end": "bigint", "speed": "double", "max_tasks": "bigint", "max_travel": "bigint", "max_distance": "bigint", "breaks": "array<struct<service:bigint,windows:array<struct<start:bigint,end:bigint>>>>", "pairs": "array<struct<a:bigint,b:bigint>>", "fixed": "double", "per_hour": "double", "time_weight": "double", "distance_weight": "double", "span_cost": "double"}


def completed(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with route_id, seq if it is there, and all of columns; those that are missing are null."""
    have = set(rows.columns)
    return rows.select("route_id", *(["seq"] if "seq" in have else []), *[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])


def placed(steps: DataFrame, depots: DataFrame, leg: Column, metres: Column, first_moves: bool = False) -> DataFrame:
    """steps(route_id, seq, kind, lat, lon, ...) with raw_s, raw_m, moved and, at each route's last step, home_s and home_m.

    leg and metres are expressions over from_lat, from_lon, to_lat and to_lon. Reloads are at the depot; a route
    begins at its depot's start or else its end, and ends at its end or else its start; without either its first
    step has no leg. With first_moves a route's first step counts as moved even where it is at the depot, as in
    `evaluate.legs`.
    """
    w = Window.partitionBy("route_id").orderBy("seq")
    have = set(depots.columns)
    at = lambda c: F.col(c) if c in have else F.lit(None).cast("double")
    ends = depots.select("route_id", *[F.coalesce(at(f"{a}_{c}"), at(f"{b}_{c}"), at(c)).alias(f"{a}_{c}") for a, b in (("start", "end"), ("end", "start")) for c in ("lat", "lon")])
    rows = steps.join(ends, "route_id", "left")
    here = lambda c: F.when(F.col("kind") == "reload", F.col(f"start_{c}")).otherwise(F.col(c))
    rows = rows.withColumns({"to_lat": here("lat"), "to_lon": here("lon")})
    before = lambda c: F.when(F.lag("seq").over(w).isNull(), F.col(f"start_{c}")).otherwise(F.lag(f"to_{c}").over(w))
    rows = rows.withColumns({"from_lat": before("lat"), "from_lon": before("lon"), "is_last": F.lead("seq").over(w).isNull()})
    other = (F.col("from_lat") != F.col("to_lat")) | (F.col("from_lon") != F.col("to_lon"))
    moved = F.coalesce(other | F.lag("seq").over(w).isNull(), F.lit(True)) if first_moves else F.coalesce(other, F.lit(True))
    rows = rows.withColumns({"raw_s": leg, "raw_m": metres, "moved": moved})
    back = rows.where("is_last").drop("from_lat", "from_lon").withColumnsRenamed({"to_lat": "from_lat", "to_lon": "from_lon"}).withColumns({"to_lat": F.col("end_lat"), "to_lon": F.col("end_lon")}).select("route_id", leg.alias("home_s"), metres.alias("home_m"))
    return rows.join(back, "route_id").withColumns({c: F.when(F.col("is_last"), F.col(c)) for c in ("home_s", "home_m")})


def _walked(steps: DataFrame, vehicles: DataFrame, soft: Soft | None, answer, schema: str) -> DataFrame:
    """answer(route_id, steps, sums, verdict, out) rows of every route; routes stand together in sorted partitions and are read one by one, a batch may end within one."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema).fields])
    both = completed(steps, STEP_COLUMNS).join(completed(vehicles, VEHICLE_COLUMNS), "route_id")

    def run(batches):
        held: list[dict] = []
        out: list[tuple] = []

        def finish():
            try:
                sums, rows = walk(held, held[0], soft)
                verdict = "ok"
            except Violated as e:
                sums, rows, verdict = None, [], VERDICTS[str(e)]
            out.extend(answer(held[0]["route_id"], sums, verdict, rows))

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)
            out.clear()
            return made

        for rows in batches:
            for row in rows.to_pylist():
                if held and row["route_id"] != held[0]["route_id"]:
                    finish()
                    held = []
                held.append(row)
                if len(out) >= 5000:
                    yield batch()
        if held:
            finish()
        if out:
            yield batch()

    assert len(names) == len(kinds)
    return spread(both, "route_id").sortWithinPartitions("route_id", "seq").mapInArrow(run, schema)


def routes(steps: DataFrame, vehicles: DataFrame, soft: Soft | None = None) -> DataFrame:
    """route_id, verdict and SUMS of each route of steps(route_id, seq, ...) with its vehicle(route_id, ...)."""
    none = (None,) * len(SUMS.split(", "))
    return _walked(steps, vehicles, soft, lambda route, sums, verdict, rows: [(route, verdict, *(tuple(sums.values()) if sums else none))], f"route_id long, verdict string, {SUMS}")


def steps_of(steps: DataFrame, vehicles: DataFrame, soft: Soft | None = None) -> DataFrame:
    """STEPS of each route that keeps its rules: arrival is the service's start, waits are those for windows, without release waits."""
    return _walked(steps, vehicles, soft, lambda route, sums, verdict, rows: [(route, *x) for x in rows], STEPS)


def ruled(found: DataFrame, rules: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """found with user rules applied: each gives (penalty, rejects or None); penalties add to cost_custom and cost, the first that rejects is the verdict. A rule that fails to give a value rejects."""
    bad = reduce(lambda w, x: w.when(x[1][1] | x[1][0].isNull() if x[1][1] is not None else x[1][0].isNull(), F.lit(x[0])), rules.items(), F.when(F.col("verdict") != "ok", F.col("verdict")))
    total = reduce(lambda a, b: a + b, (F.greatest(p.cast("double"), F.lit(0.0)) for p, _ in rules.values()), F.lit(0.0))
    out = found.withColumns({"verdict": bad.otherwise("ok"), "penalty": total})
    keep = F.col("verdict") == "ok"
    return out.withColumns({"cost_custom": F.when(keep, F.col("cost_custom") + F.col("penalty")), "cost": F.when(keep, F.col("cost") + F.col("penalty"))}).drop("penalty")


def merged_windows(a: dict, leg: int, b: dict) -> dict:
    """Two stretches of stops as one: duration, time warp, earliest and latest start, waiting included; the operation is associative, so stretches may be merged in any order.

    A stretch is a dict of duration, warp, early and late (the start times between which its warp is least).
    """
    delta = a["duration"] - a["warp"] + leg
    wait = max(b["early"] - delta - a["late"], 0)
    warp = max(a["early"] + delta - b["late"], 0)
    return {"duration": a["duration"] + b["duration"] + leg + wait, "warp": a["warp"] + b["warp"] + warp, "early": max(b["early"] - delta, a["early"]) - wait, "late": min(b["late"] - delta, a["late"]) + warp}


def merged_column(stops: Column) -> Column:
    """merged_windows along an array of (leg, service, early, late), as one Catalyst fold: a struct of duration, warp, early, late."""
    big = lambda x: F.lit(x).cast("bigint")
    start = F.struct(big(0).alias("duration"), big(0).alias("warp"), big(0).alias("early"), big(FOREVER).alias("late"))

    def step(a, s):
        delta = a["duration"] - a["warp"] + s["leg"]
        wait = F.greatest(s["early"] - delta - a["late"], big(0))
        warp = F.greatest(a["early"] + delta - s["late"], big(0))
        return F.struct((a["duration"] + s["service"] + s["leg"] + wait).alias("duration"), (a["warp"] + warp).alias("warp"), (F.greatest(s["early"] - delta, a["early"]) - wait).alias("early"), (F.least(s["late"] - delta, a["late"]) + warp).alias("late"))

    return F.aggregate(stops, start, step)
