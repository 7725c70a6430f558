"""The full route walk, rule by rule, and stretches of windows against plain simulation."""

import random

import pytest
from pyspark.sql import functions as F

from roadspark.operators import walk
from roadspark.plans import queries


def step(seq, kind="job", **more):
    base = dict(seq=seq, kind=kind, job=seq, shipment=None, delivery=None, pickup=None, amount=None, skills=None, allowed=None, setup=0, release=0, service=10, windows=None, raw_s=100, raw_m=1000, moved=True, home_s=None, home_m=None)
    return base | more


def car(**more):
    base = dict(vehicle=1, capacity=[10], v_skills=[1], shift_start=0, shift_end=None, speed=1.0, max_tasks=None, max_travel=None, max_distance=None, breaks=None, pairs=None)
    return base | more


def w(a, b):
    return {"start": a, "end": b}


@pytest.mark.parametrize(
    "steps,vehicle,rule",
    [
        ([step(1, delivery=[11])], car(), "start"),
        ([step(1, skills=[2])], car(), "skill"),
        ([step(1, allowed=[2, 3])], car(), "allowed"),
        ([step(1, "delivery", shipment=5, amount=[1]), step(2, "pickup", shipment=5, amount=[1])], car(), "shipment"),
        ([step(1), step(2)], car(pairs=[{"a": 2, "b": 1}]), "precedence"),
        ([step(1, "pickup", shipment=5, amount=[1]), step(2, "reload")], car(), "on_board"),
        ([step(1), step(2, "reload", raw_s=10**8)], car(), "to_reload"),
        ([step(1, delivery=[5]), step(2, "reload"), step(3, delivery=[11])], car(), "reload"),
        ([step(1, pickup=[1]), step(2, delivery=[1])], car(), "backhaul"),
        ([step(1, raw_s=10**8)], car(), "between"),
        ([step(1, windows=[w(0, 50)])], car(), "window"),
        ([step(1, "pickup", shipment=1, amount=[2]), step(2, "delivery", shipment=1, amount=[3])], car(), None),
        ([step(1, pickup=[11])], car(), "load"),
        ([step(1), step(2)], car(breaks=[{"service": 5, "windows": [w(0, 50)]}]), "break"),
        ([step(1), step(2)], car(max_tasks=1), "tasks"),
        ([step(1, home_s=10**8)], car(), "home"),
        ([step(1, home_s=100)], car(shift_end=209), "shift"),
        ([step(1, home_s=100)], car(max_travel=199), "travel"),
        ([step(1, home_s=100, home_m=1)], car(max_distance=1000), "distance"),
    ],
)
def test_each_rule(steps, vehicle, rule):
    if rule is None:
        steps[1]["amount"] = [3]
        rule = "negative"
    with pytest.raises(walk.Violated) as why:
        walk.walk(steps, vehicle)
    assert str(why.value) == rule and rule in walk.VERDICTS


def test_times_and_sums():
    steps = [step(1, setup=30, release=150, delivery=[4]), step(2, setup=30, moved=False, raw_s=0, raw_m=0, windows=[w(0, 20), w(300, 400)]), step(3, "reload", raw_s=50, raw_m=70), step(4, delivery=[9], home_s=40, home_m=60)]
    sums, out = walk.walk(steps, car(speed=0.5, breaks=[{"service": 20, "windows": [w(165, 9999)]}, {"service": 7, "windows": [w(1000, 2000)]}], fixed=5.0, per_hour=7200.0, distance_weight=0.5, span_cost=0.1))
    # 50 travel, 30 setup, 70 release wait, service at 150 to 160; second: waits to 300, served to 310, break of 20 to 330; reload 25 to 355; 50 to 405, served to 415, home 20 to 435; second break at 1000 to 1007
    assert [(s, at, wait, load) for s, _, _, at, wait, _, load, _ in out] == [(1, 150, 0, [0]), (2, 300, 140, [0]), (3, 355, 0, [9]), (4, 405, 0, [0])]
    assert (sums["travel_s"], sums["wait_s"], sums["setup_s"], sums["service_s"], sums["distance"], sums["end_time"], sums["break_count"], sums["break_s"], sums["tasks"]) == (145, 70 + 140 + 565, 30, 30, 2130, 1007, 2, 27, 3)
    assert abs(sums["cost"] - (5 + 145 * 2 + 2130 * 0.5 + 30e-6 + 100.7)) < 1e-9


@pytest.mark.parametrize("warp,late,end", [(False, 100 + 210, 320), (True, 100 + 110, 120)])
def test_soft(warp, late, end):
    steps = [step(1, windows=[w(0, 0)], raw_s=100), step(2, windows=[w(0, 0)], raw_s=100, pickup=[12], home_s=0, home_m=0)]
    sums, _ = walk.walk(steps, car(shift_end=50), walk.Soft(1.0, 3.0, 2.0, warp))
    clock = 220 if not warp else 10
    assert (sums["late_s"], sums["overload"], sums["overrun"]) == (late, 2, max(0, clock - 50))
    assert sums["cost_custom"] == late + 3 * 2 + 2 * max(0, clock - 50) and end


def test_routes_and_user_rules(spark, small):
    found = queries.route_walk_rules(spark, small)
    rows = found.collect()
    assert len({r.verdict for r in rows}) >= 3 and all((r.cost is None) == (r.verdict != "ok") for r in rows)
    steps = {(r.route_id, r.seq): r for r in queries.route_walk_steps(spark, small).collect()}
    good = {r.route_id for r in rows if r.verdict == "ok"}
    assert good and {k for k, _ in steps} == good
    ruled = walk.ruled(found, {"long": (F.lit(0.0), F.col("distance") > 50_000), "price": (F.col("tasks") * 2.0, None)}).collect()
    for before, after in zip(sorted(rows, key=lambda r: r.route_id), sorted(ruled, key=lambda r: r.route_id)):
        if before.verdict == "ok" and before.distance <= 50_000:
            assert abs(after.cost - before.cost - 2 * before.tasks) < 1e-6
        else:
            assert after.cost is None and (after.verdict == before.verdict or after.verdict == "long")


def simulated(stops, start):
    """Duration and warp of a route that leaves at `start`, clocks set back where they are late."""
    clock, warp = start, 0
    for leg, service, early, late in stops:
        clock += leg
        if clock > late:
            warp, clock = warp + clock - late, late
        clock = max(clock, early) + service
    return clock, warp


def test_merged_windows(spark):
    rnd = random.Random(1)
    for turn in range(200):
        stops = [(rnd.randint(0, 40), rnd.randint(0, 10), a := rnd.randint(0, 120), a + rnd.randint(0, 60)) for _ in range(rnd.randint(1, 6))]
        parts = [{"duration": s, "warp": 0, "early": a, "late": b} for _, s, a, b in stops]
        depot = {"duration": 0, "warp": 0, "early": 0, "late": walk.FOREVER}
        one = depot
        for one_stop, part in zip(stops, parts):
            one = walk.merged_windows(one, one_stop[0], part)
        cut = rnd.randint(0, len(stops) - 1)
        left, right = depot, parts[cut]
        for k in range(cut):
            left = walk.merged_windows(left, stops[k][0], parts[k])
        for k in range(cut + 1, len(stops)):
            right = walk.merged_windows(right, stops[k][0], parts[k])
        assert walk.merged_windows(left, stops[cut][0], right) == one  # in any order
        warps = [simulated(stops, t)[1] for t in range(0, 200)]
        assert one["warp"] == min(warps) and warps[max(0, min(199, one["early"]))] == min(warps)
        if turn < 5:
            array = F.array(*[F.struct(*[F.lit(x).cast("bigint").alias(n) for x, n in zip(s, ("leg", "service", "early", "late"))]) for s in stops])
            row = spark.range(1).select(walk.merged_column(array).alias("w")).head().w.asDict()
            assert row == one
