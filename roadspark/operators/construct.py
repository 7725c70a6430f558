"""Plans built, mended and bred: constructions, larger moves, repairs, crossovers, islands and clusters.

All work on the arrays of one problem (`search.Problem`) inside a task; Spark deals problems, seeds, islands and
clusters to tasks and keeps tables between rounds. Random numbers are seeded, so results repeat; budgets are
numbers of steps. Ties go to what comes first.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import discarded, spread, stored
from .search import COLUMNS, EPS, GAIN, PLAN, Problem, added, each_group, insertion, insertion_order, likely_moves, local_search, moves, problem_of, split

INF = float("inf")


# --- probes ---


def shift_probe(p: Problem, route: list[int], at: int, k: int) -> tuple[float, float]:
    """What stop k at place `at` of a route adds: travel, and seconds by which the next service starts later."""
    before, after = route[at - 1] if at else 0, route[at] if at < len(route) else 0
    travel = p.d[before, k] + p.d[k, after] - p.d[before, after]
    clock = starts(p, route[:at])
    there = max(clock + p.d[before, k], p.ready[k])
    with_it = there + p.service[k] + p.d[k, after]
    without = clock + p.d[before, after]
    floor = p.ready[after] if after else -INF
    return float(travel), float(max(with_it, floor) - max(without, floor))


def starts(p: Problem, route: list[int]) -> float:
    """When a vehicle leaves the last stop of a route's beginning."""
    clock, at = p.ready[0], 0
    for k in route:
        clock = max(clock + p.d[at, k], p.ready[k]) + p.service[k]
        at = k
    return clock


def pair_probe(p: Problem, route: list[int], pickup: int, delivery: int, base: float | None = None) -> tuple[float, int, int]:
    """The cheapest places of a shipment's two stops, the pickup first: cost added, place of the pickup, place of the delivery in the route with the pickup; infinite where none fits."""
    base = p.route_cost(route) if base is None else base
    best = (INF, -1, -1)
    for i in range(len(route) + 1):
        half = route[:i] + [pickup] + route[i:]
        for j in range(i + 1, len(half) + 1):
            cost = p.route_cost(half[:j] + [delivery] + half[j:]) - base
            if cost < best[0] - EPS:
                best = (float(cost), i, j)
    return best


def proximity(p: Problem) -> np.ndarray:
    """How well two stops follow each other: travel, a fifth of the waiting and all of the lateness that their windows force; the better of both ways."""
    wait = p.ready[None, :] - p.service[:, None] - p.d - p.due[:, None]
    warp = p.ready[:, None] + p.service[:, None] + p.d - p.due[None, :]
    one = p.d + 0.2 * np.maximum(wait, 0) + np.maximum(warp, 0)
    return np.minimum(one, one.T)


# --- constructions ---


def solomon(p: Problem, weight: float = 0.5, reach: float = 1.0) -> list[list[int]]:
    """Solomon's I1: routes one after another from the farthest stop left, filled by the stop that gains most over a route of its own at its best place (`weight` of travel, the rest of time shift)."""
    left, routes = set(range(1, p.n)), []
    while left and len(routes) < p.vehicles:
        seeds = [k for k in sorted(left, key=lambda k: (-p.d[0, k], k)) if np.isfinite(p.route_cost([k]))]
        if not seeds:
            break
        route = [seeds[0]]
        left.discard(seeds[0])
        while True:
            best = (-INF, None, 0)
            for k in sorted(left):
                place = min(((weight * t + (1 - weight) * s, at) for at in range(len(route) + 1) for t, s in [shift_probe(p, route, at, k)] if np.isfinite(p.route_cost(route[:at] + [k] + route[at:]))), default=None)
                if place is not None and reach * p.d[0, k] - place[0] > best[0] + EPS:
                    best = (reach * p.d[0, k] - place[0], k, place[1])
            if best[1] is None:
                break
            route.insert(best[2], best[1])
            left.discard(best[1])
        routes.append(route)
    return routes


def regret(p: Problem, routes: list[list[int]], missing: list[int], depth: int = 3) -> list[list[int]]:
    """Puts missing stops back, first the one that loses most if its best route is not taken (over its `depth` best)."""
    routes, missing = [list(r) for r in routes], list(missing)
    _, demand, full, _ = p.lists()
    while missing:
        best = (-INF, INF, None, 0, 0)
        open_routes = [(r, p.route_cost(r) if r else 0.0, p.load(r)) for r in [*routes, *([[]] if len(routes) < p.vehicles else [])]]
        for k in missing:
            options = []
            for a, (r, base, load) in enumerate(open_routes):
                if load + demand[k] > full:
                    continue
                cost, at = min((p.route_cost(r[:b] + [k] + r[b:]) - base, b) for b in range(len(r) + 1))
                if math.isfinite(cost):
                    options.append((float(cost), a, at))
            options.sort()
            if options:
                loss = sum((options[min(i, len(options) - 1)][0] if i < len(options) else 1e6) - options[0][0] for i in range(1, depth))
                if (loss, -options[0][0]) > (best[0], -best[1]):
                    best = (loss, options[0][0], k, options[0][1], options[0][2])
        if best[2] is None:
            break
        if best[3] == len(routes):
            routes.append([])
        routes[best[3]].insert(best[4], best[2])
        missing.remove(best[2])
    return routes


# --- larger moves, in the form of search.moves ---


def swap_star(p: Problem, routes: list[list[int]]):
    """Two stops change routes, each to one of the three best places of the other route, wherever that is."""
    for a in range(len(routes)):
        for b in range(a + 1, len(routes)):
            for u in routes[a]:
                for v in routes[b]:
                    r, s = [k for k in routes[a] if k != u], [k for k in routes[b] if k != v]
                    for x in _places(p, r, v):
                        for y in _places(p, s, u):
                            yield (a, b), [r[:x] + [v] + r[x:], s[:y] + [u] + s[y:]]


def _places(p: Problem, route: list[int], k: int, most: int = 3) -> list[int]:
    line = [0, *route, 0]
    return sorted(range(len(route) + 1), key=lambda i: (p.d[line[i], k] + p.d[k, line[i + 1]] - p.d[line[i], line[i + 1]], i))[:most]


def cross_exchange(routes: list[list[int]], length: int = 2):
    """Segments of `length` stops change routes, either way round."""
    for a in range(len(routes)):
        for b in range(a + 1, len(routes)):
            r, s = routes[a], routes[b]
            for i in range(len(r) - length + 1):
                for j in range(len(s) - length + 1):
                    one, two = r[i : i + length], s[j : j + length]
                    for x in (two, two[::-1]):
                        for y in (one, one[::-1]):
                            yield (a, b), [r[:i] + x + r[i + length :], s[:j] + y + s[j + length :]]


def route_splits(routes: list[list[int]], vehicles: int):
    """A route becomes two where a vehicle is left."""
    if len(routes) < vehicles:
        for a, r in enumerate(routes):
            for i in range(1, len(r)):
                yield (a,), [r[:i], r[i:]]


def every_move(p: Problem, routes: list[list[int]]):
    yield from moves(routes)
    yield from cross_exchange(routes)
    yield from swap_star(p, routes)
    yield from route_splits(routes, p.vehicles)


def likely_crosses(p: Problem, routes: list[list[int]]):
    """Of `cross_exchange` with segments of two, in its order, those that may gain (see `search.likely_moves`)."""
    rows, loads, most, limit = p.lists()
    lines, total = [[0, *r, 0] for r in routes], [p.load(r) for r in routes]

    def pairs(line):
        """Before, first, last, after, travel forth from before to after and load of each segment."""
        for w, x, y, z in zip(line, line[1:], line[2:], line[3:]):
            yield w, x, y, z, rows[w][x] + rows[x][y] + rows[y][z], loads[x] + loads[y]

    for a in range(len(routes)):
        for b in range(a + 1, len(routes)):
            r, s, free_r, free_s = routes[a], routes[b], most - total[a], most - total[b]
            others = list(pairs(lines[b]))
            for i, (w, x, y, z, legs, load) in enumerate(pairs(lines[a])):
                from_w = rows[w]
                for j, (before, one, two, after, theirs, other) in enumerate(others):
                    if other - load > free_r or load - other > free_s:
                        continue
                    room, into = legs + theirs + limit, rows[before]
                    for u, v in ((one, two), (two, one)):
                        mine = from_w[u] + rows[u][v] + rows[v][z]
                        for g, h in ((x, y), (y, x)):
                            if not mine + into[g] + rows[g][h] + rows[h][after] > room:
                                yield (a, b), [r[:i] + [u, v] + r[i + 2 :], s[:j] + [g, h] + s[j + 2 :]]


def likely_swaps(p: Problem, routes: list[list[int]]):
    """Of `swap_star`, in its order, those between stops that may gain at their best places."""
    rows, loads, most, limit = p.lists()
    total = [p.load(r) for r in routes]

    def without(line):
        """Of each stop of a line: travel saved without it, and the legs that are left."""
        legs = [(x, y, rows[x][y]) for x, y in zip(line, line[1:])]
        for i, (w, x, y) in enumerate(zip(line, line[1:], line[2:])):
            yield x, legs[i][2] + legs[i + 1][2] - rows[w][y], [*legs[:i], (w, y, rows[w][y]), *legs[i + 2 :]]

    held = [list(without([0, *r, 0])) for r in routes]
    for a in range(len(routes)):
        for b in range(a + 1, len(routes)):
            free_a, free_b = most - total[a], most - total[b]
            for u, saved, left in held[a]:
                for v, theirs, rest in held[b]:
                    if loads[v] - loads[u] > free_a or loads[u] - loads[v] > free_b:
                        continue
                    room, from_u, from_v = saved + theirs + limit, rows[u], rows[v]
                    least = min([rows[x][v] + from_v[y] - leg for x, y, leg in left])
                    if least + min([rows[x][u] + from_u[y] - leg for x, y, leg in rest]) > room:
                        continue
                    r, s = [k for k in routes[a] if k != u], [k for k in routes[b] if k != v]
                    for x in _places(p, r, v):
                        for y in _places(p, s, u):
                            yield (a, b), [r[:x] + [v] + r[x:], s[:y] + [u] + s[y:]]


def likely_every(p: Problem, routes: list[list[int]]):
    """`every_move` without moves that feasible routes cannot gain by."""
    yield from likely_moves(p, routes)
    yield from likely_crosses(p, routes)
    yield from likely_swaps(p, routes)
    yield from route_splits(routes, p.vehicles)


def polished(p: Problem, routes: list[list[int]], most: int = 50) -> list[list[int]]:
    """First improvements among all moves until none is left, `most` at most."""
    routes = [list(r) for r in routes if r]
    costs = [p.route_cost(r) for r in routes]
    for _ in range(most):
        for which, new in likely_every(p, routes) if INF not in costs else every_move(p, routes):
            after = [p.route_cost(r) if r else 0.0 for r in new]
            if added(after) < added(costs[k] for k in which) - GAIN:
                keep = [k for k in range(len(routes)) if k not in which]
                fresh = [(r, c) for r, c in zip(new, after) if r]
                routes = [routes[k] for k in keep] + [r for r, _ in fresh]
                costs = [costs[k] for k in keep] + [c for _, c in fresh]
                break
        else:
            break
    return routes


def late_acceptance(p: Problem, routes: list[list[int]], rng: np.random.Generator, steps: int = 200, length: int = 20) -> list[list[int]]:
    """Late acceptance hill climbing: a random relocation is taken if the plan is no worse than now or `length` steps ago; the best plan seen comes back."""
    now = [list(r) for r in routes]
    cost = p.cost(now)
    past, best = [cost] * length, (cost, [list(r) for r in now])
    for step in range(steps):
        if not any(now):
            break
        a = int(rng.integers(len(now)))
        i = int(rng.integers(len(now[a])))
        new = [list(r) for r in now]
        k = new[a].pop(i)
        new = [r for r in new if r] + ([[]] if len([r for r in new if r]) < p.vehicles else [])
        b = int(rng.integers(len(new)))
        new[b].insert(int(rng.integers(len(new[b]) + 1)), k)
        new = [r for r in new if r]
        after = p.cost(new)
        if after <= cost + EPS or after <= past[step % length] + EPS:
            now, cost = new, after
            if cost < best[0] - EPS:
                best = (cost, [list(r) for r in now])
        past[step % length] = cost
    return best[1]


def perturbed(p: Problem, routes: list[list[int]], rng: np.random.Generator, most: int = 3) -> list[list[int]]:
    """A small kick: a few stops leave; with a vehicle left one of them opens a route; the others go back by regret."""
    stops = [k for r in routes for k in r]
    if not stops:
        return routes
    out = rng.choice(stops, min(most, len(stops)), replace=False).tolist()
    left = [r for r in ([k for k in r if k not in out] for r in routes) if r]
    if len(left) < p.vehicles and np.isfinite(p.route_cost([out[0]])):
        left.append([out.pop(0)])
    return regret(p, left, out)


# --- repairs of whole plans ---


def unserved(p: Problem, routes: list[list[int]]) -> list[int]:
    have = {k for r in routes for k in r}
    return [k for k in range(1, p.n) if k not in have]


def repaired(p: Problem, routes: list[list[int]]) -> list[list[int]]:
    """Unserved stops go in by regret; one that does not fit takes the place of a served stop that fits elsewhere."""
    routes = regret(p, routes, unserved(p, routes))
    for k in unserved(p, routes):
        for a, r in enumerate(routes):
            done = False
            for i, out in enumerate(r):
                swapped = r[:i] + [k] + r[i + 1 :]
                if not math.isfinite(p.route_cost(swapped)):
                    continue
                new = regret(p, [*routes[:a], swapped, *routes[a + 1 :]], [out])
                if not set(unserved(p, new)) & {out}:
                    routes, done = new, True
                    break
            if done:
                break
    return routes


def prize_swapped(p: Problem, routes: list[list[int]], prize: np.ndarray) -> list[list[int]]:
    """An unserved stop takes the place of a served one of a smaller prize, the largest gain first, as long as there is one."""
    routes = [list(r) for r in routes]
    while True:
        best = (EPS, None)
        for k in unserved(p, routes):
            for a, r in enumerate(routes):
                for i, out in enumerate(r):
                    gain = prize[k] - prize[out]
                    if gain > best[0] and np.isfinite(p.route_cost(r[:i] + [k] + r[i + 1 :])):
                        best = (gain, (a, i, k))
        if best[1] is None:
            return routes
        a, i, k = best[1]
        routes[a][i] = k


def levelled(p: Problem, routes: list[list[int]], most: int = 20) -> list[list[int]]:
    """Stops move from the longest route to the others as long as the gap between longest and shortest shrinks."""
    routes = [list(r) for r in routes if r]
    for _ in range(most):
        costs = [p.route_cost(r) for r in routes]
        if len(routes) < 2:
            break
        gap, a, best = max(costs) - min(costs), int(np.argmax(costs)), None
        for i, k in enumerate(routes[a]):
            for b in range(len(routes)):
                for at in _places(p, routes[b], k) if b != a else ():
                    new = [list(r) for r in routes]
                    new[a].pop(i)
                    new[b].insert(at, k)
                    after = [p.route_cost(r) if r else 0.0 for r in new]
                    if np.isfinite(after).all() and new[a] and (w := max(after) - min(after)) < gap - 1e-7:
                        gap, best = w, new
        if best is None:
            break
        routes = best
    return routes


def within_fleet(p: Problem, routes: list[list[int]], vehicles: int) -> list[list[int]]:
    """At most `vehicles` routes: the shortest are dissolved and their stops put elsewhere where they fit."""
    routes = sorted(([*r] for r in routes if r), key=lambda r: (-len(r), r))
    freed = [k for r in routes[vehicles:] for k in r]
    kept, fleet = routes[:vehicles], p.vehicles
    p.vehicles = min(fleet, vehicles)
    try:
        return regret(p, kept, freed)
    finally:
        p.vehicles = fleet


def grouped_once(p: Problem, routes: list[list[int]], group: dict[int, int]) -> list[list[int]]:
    """Of each group's served stops one stays, that whose removal saves least; a group without one gets its cheapest."""
    routes = [list(r) for r in routes]
    by: dict[int, list[tuple[float, int, int]]] = {}
    for a, r in enumerate(routes):
        base = p.route_cost(r)
        for k in r:
            if k in group:
                rest = [x for x in r if x != k]
                by.setdefault(group[k], []).append((base - (p.route_cost(rest) if rest else 0.0), k, a))
    gone = {k for served in by.values() for _, k, _ in sorted(served)[1:]}
    routes = [r for r in ([k for k in r if k not in gone] for r in routes) if r]
    for g in sorted(set(group.values()) - set(by)):
        options = [(p.cost(new), k, new) for k in sorted(group) if group[k] == g for new in [insertion(p, [k], routes)] if any(k in r for r in new)]
        if options:
            routes = min(options)[2]
    return routes


# --- breeding ---


def ordered_crossover(a: list[int], b: list[int], i: int, j: int) -> list[int]:
    """a's stretch from i to j (round the end where j < i), then b's other stops in b's order from there on."""
    n = len(a)
    inside = [a[(i + k) % n] for k in range((j - i) % n + 1)]
    rest = [b[(j + 1 + k) % n] for k in range(n)]
    have, out = set(inside), [0] * n
    line = inside + [k for k in rest if k not in have]
    for k, x in enumerate(line):
        out[(i + k) % n] = x
    return out


def route_crossover(p: Problem, a: list[list[int]], b: list[list[int]], rng: np.random.Generator) -> list[list[int]]:
    """Selective route exchange: some of a's routes give way to those of b that share most stops with them; doubles go, what is missing returns by regret."""
    if not a or not b:
        return [list(r) for r in a or b]
    count = int(rng.integers(1, max(2, min(len(a), len(b)) // 2 + 1)))
    out = set(rng.choice(len(a), min(count, len(a)), replace=False).tolist())
    lost = {k for i in out for k in a[i]}
    taken = sorted(range(len(b)), key=lambda i: (-len(lost & set(b[i])), i))[: len(out)]
    have = {k for i in taken for k in b[i]}
    left = [r for r in ([k for k in r if k not in have] for i, r in enumerate(a) if i not in out) if r]
    plan = left + [list(b[i]) for i in taken]
    return regret(p, plan, unserved(p, plan))


def edge_distance(a: list[list[int]], b: list[list[int]]) -> float:
    """The share of a's legs, depot's included, that b has not."""
    legs = lambda plan: {frozenset(x) if x[0] != x[1] else x for r in plan for x in zip([0, *r], [*r, 0])}
    one, two = legs(a), legs(b)
    return 1 - len(one & two) / max(1, len(one))


class Population:
    """Plans with their costs, ranked by cost and by how much they differ from others."""

    def __init__(self, p: Problem, size: int):
        self.p, self.size, self.plans = p, size, []

    def add(self, plan: list[list[int]]) -> None:
        plan = sorted([list(r) for r in plan if r])
        if all(plan != x for _, x in self.plans):
            self.plans.append((self.p.cost(plan), plan))
        if len(self.plans) > 2 * self.size:
            self.cull()

    def fitness(self) -> list[float]:
        n = len(self.plans)
        by_cost = np.argsort(np.argsort([c for c, _ in self.plans], kind="stable"), kind="stable")
        near = [min((edge_distance(x, y) for j, (_, y) in enumerate(self.plans) if j != i), default=1.0) for i, (_, x) in enumerate(self.plans)]
        by_far = np.argsort(np.argsort([-x for x in near], kind="stable"), kind="stable")
        return [float(c + (1 - min(n, 4) / n) * f) for c, f in zip(by_cost, by_far)]

    def cull(self) -> None:
        """Down to size; the worst by both ranks go, never the cheapest."""
        while len(self.plans) > self.size:
            fit, best = self.fitness(), min(range(len(self.plans)), key=lambda i: self.plans[i][0])
            self.plans.pop(max((i for i in range(len(self.plans)) if i != best), key=lambda i: (fit[i], i)))

    def pick(self, rng: np.random.Generator) -> list[list[int]]:
        """A binary tournament."""
        fit = self.fitness()
        i, j = rng.integers(len(self.plans), size=2)
        return self.plans[i if fit[i] <= fit[j] else j][1]

    def best(self) -> tuple[float, list[list[int]]]:
        return min(self.plans, key=lambda x: (x[0], x[1]))


def applies(p: Problem, jobs_only: bool = True, alike: bool = True) -> bool:
    """Whether breeding by giant tours is told to work: single jobs alone, vehicles alike, every stop reachable by itself."""
    return jobs_only and alike and p.n > 2 and all(np.isfinite(p.route_cost([k])) for k in range(1, p.n))


def bred(p: Problem, seed: int, rounds: int = 20, size: int = 8, first: list[list[list[int]]] = (), most: int = 30) -> list[list[list[int]]]:
    """A population after `rounds` of crossover (order over giant tours, or whole routes), split and local search, the best first."""
    rng, pop = np.random.default_rng(seed), Population(p, size)
    for plan in first:
        pop.add(plan)
    pop.add(insertion(p, insertion_order(p, None)))
    pop.add(solomon(p))
    while len(pop.plans) < size and len(pop.plans) < 2 * p.n:
        before = len(pop.plans)
        pop.add(local_search(p, insertion(p, insertion_order(p, rng)), most))
        if len(pop.plans) == before:
            break
    for _ in range(rounds):
        a, b = pop.pick(rng), pop.pick(rng)
        one, two = [k for r in a for k in r], [k for r in b for k in r]
        if len(one) == len(two) == p.n - 1 and p.n > 3 and rng.random() < 0.5:
            i, j = sorted(rng.integers(len(one), size=2).tolist())
            child = split(p, ordered_crossover(one, two, i, j)) or route_crossover(p, a, b, rng)
        else:
            child = route_crossover(p, a, b, rng)
        pop.add(local_search(p, child, most))
    cost, best = pop.best()
    pop.add(polished(p, best, most))
    return [plan for _, plan in sorted(pop.plans, key=lambda x: (x[0], x[1]))[:size]]


POPULATION = "problem long, island long, rank long, cost double, routes array<array<long>>"


def islands(problems: DataFrame, count: int, rounds: int, capacity: float, vehicles: int, generations: int = 10, size: int = 6) -> DataFrame:
    """The best plan of each problem after `rounds` of breeding on `count` islands, each round's best moving on to the next island: problem, island, cost, unserved, routes."""
    problems = stored(problems, "problems")
    rows = stored(problems.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))), "islands")
    plans = None
    for at in range(rounds):
        if plans is None:
            given = rows.withColumns({"rank": F.lit(None).cast("bigint"), "routes": F.lit(None).cast("array<array<bigint>>")})
        else:
            moved = plans.where("rank = 0").withColumn("island", F.pmod(F.col("island") + 1, F.lit(count)))
            sent = plans.unionByName(moved).select("problem", "island", "rank", "routes")
            blank = {c: F.lit(None).cast(t) for c, t in rows.dtypes if c not in ("problem", "island")}
            given = rows.withColumns({"rank": F.lit(None).cast("bigint"), "routes": F.lit(None).cast("array<array<bigint>>")}).unionByName(sent.withColumns(blank), allowMissingColumns=True)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            own = pdf[pdf["i"].notna()].astype({"i": "int64"}).sort_values("i")
            p, names, island = Problem.of(own, capacity, vehicles), own["i"].tolist(), int(pdf["island"].iloc[0])
            place = {n: k for k, n in enumerate(names)}
            first = [[[place[int(k)] for k in r] for r in plan] for plan in pdf.loc[pdf["i"].isna(), "routes"]]
            plans = bred(p, 1000 * at + island, generations, size, first)  # noqa: B023 - the round's plan is run within the round
            out = [(int(own["problem"].iloc[0]), island, rank, p.cost(plan), [[names[k] for k in r] for r in plan]) for rank, plan in enumerate(plans)]
            return pd.DataFrame(out, columns=[c.split()[0] for c in POPULATION.split(", ")])

        last, plans = plans, stored(spread(given, "problem", "island").groupBy("problem", "island").applyInPandas(run, POPULATION), "plans")
        if last is not None:
            discarded(last)
    best = plans.groupBy("problem").agg(F.min(F.struct("cost", "island", "routes")).alias("w"))
    sizes = problems.groupBy("problem").agg((F.count("*") - 1).alias("stops"))
    served = F.aggregate("w.routes", F.lit(0), lambda n, route: n + F.size(route))
    return best.join(sizes, "problem").select("problem", "w.island", "w.cost", (F.col("stops") - served).cast("bigint").alias("unserved"), "w.routes")


# --- clusters first ---


def medoid_clusters(d: np.ndarray, count: int, rounds: int = 20) -> np.ndarray:
    """The cluster of each place by k-medoids: farthest places first, then assignment and medoids by turns until nothing changes."""
    n = len(d)
    if min(count, n) == 1:
        return np.zeros(n, int)
    both = (d + d.T) / 2
    chosen = [int(np.argmax(both.sum(axis=1)))]
    while len(chosen) < min(count, n):
        chosen.append(int(np.argmax(both[:, chosen].min(axis=1))))
    own = both[:, chosen].argmin(axis=1)
    for _ in range(rounds):
        new = [min(np.flatnonzero(own == c).tolist(), key=lambda k, c=c: (both[k, own == c].sum(), k), default=chosen[c]) for c in range(len(chosen))]
        after = both[:, new].argmin(axis=1)
        if new == chosen and (after == own).all():
            break
        chosen, own = new, after
    return own


def vehicle_shares(demands: list[float], vehicles: int) -> list[int]:
    """Vehicles by demand, one each at least, the largest remainders first."""
    total = sum(demands) or 1
    exact = [max(1.0, vehicles * x / total) for x in demands]
    out = [int(x) for x in exact]
    for k in sorted(range(len(out)), key=lambda k: (out[k] - exact[k], k)):
        if sum(out) < vehicles:
            out[k] += 1
    return out


def decomposed(problems: DataFrame, size: int, capacity: float, vehicles: int, kicks: int = 3, most: int = 30) -> DataFrame:
    """Plans of large problems by clusters of about `size` stops, solved apart and polished together: problem, seed, cost, unserved, routes.

    A problem's places are clustered in one task; its clusters are searched in tasks of their own.
    """
    from .search import solve

    problems = problems.select(*COLUMNS)

    def cluster(key, whole):
        p = problem_of(whole, capacity, vehicles)
        count = max(1, -(-(p.n - 1) // size))
        own = medoid_clusters(p.d[1:, 1:], count) if p.n > 1 else np.zeros(0, int)
        used = sorted(set(own.tolist()))
        share = vehicle_shares([float(p.demand[1:][own == c].sum()) for c in used], vehicles) if used else []
        rows = list(zip(*(whole[n].tolist() for n in COLUMNS[1:])))
        for c, s in zip(used or [0], share or [vehicles]):
            yield from ((*key, *rows[k], c, s) for k in [0, *(np.flatnonzero(own == c) + 1).tolist()])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in problems.schema.fields)
    clusters = stored(each_group(problems, ["problem"], cluster, f"{kinds}, cluster long, share long"), "clusters")

    def search(key, part):
        p, own = problem_of(part, capacity, int(part["share"][0])), part["i"].tolist()
        yield key[0], [[own[k] for k in r] for r in solve(p, 0, kicks, most)]

    parts = stored(each_group(clusters, ["problem", "cluster"], search, "problem long, routes array<array<long>>"), "parts")
    plans = parts.groupBy("problem").agg(F.flatten(F.sort_array(F.collect_list("routes"))).alias("routes"))

    def polish(key, whole):
        plan, whole = whole["routes"][-1], {n: c[:-1] for n, c in whole.items()}
        p, own = problem_of(whole, capacity, vehicles), whole["i"].tolist()
        place = {n: k for k, n in enumerate(own)}
        routes = within_fleet(p, [[place[int(k)] for k in r] for r in plan], vehicles)
        routes = polished(p, repaired(p, routes), most)
        yield key[0], 0, float(p.cost(routes)), len(unserved(p, routes)), [[own[k] for k in r] for r in routes]

    # a plan is the last row of its problem's group
    fields = [f for f in problems.schema.fields if f.name != "problem"]
    last = plans.select("problem", *[F.lit(0).cast(f.dataType).alias(f.name) for f in fields], F.lit(1).alias("last"), "routes")
    both = problems.select("*", F.lit(0).alias("last"), F.lit(None).cast("array<array<bigint>>").alias("routes")).unionByName(last)
    return each_group(both, ["problem"], polish, PLAN, ("last", "i"))


def farthest_first(points: DataFrame, group: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The points of each group in farthest-first order from the first by id: group, id, rank. Distances are planar, longitudes scaled by the cosine of the mean latitude; ties go to the smaller id."""
    rows = points.select(F.col(group).alias("grp"), "id", F.col(lat).alias("y"), F.col(lon).alias("x")).where("x IS NOT NULL AND y IS NOT NULL")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        scale = max(float(np.cos(np.radians(pdf["y"].mean()))), 1e-6)
        xy = np.column_stack([pdf["x"] * scale, pdf["y"]])
        near, at, order = np.full(len(xy), np.inf), 0, []
        for _ in range(len(xy)):
            order.append(at)
            near = np.minimum(near, ((xy - xy[at]) ** 2).sum(axis=1))
            near[order] = -1
            at = int(near.argmax())
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "id": pdf["id"].to_numpy()[order], "rank": range(1, len(order) + 1)})

    kind = rows.schema["grp"].dataType.simpleString()
    return spread(rows, "grp").groupBy("grp").applyInPandas(run, f"grp {kind}, id long, rank long").withColumnRenamed("grp", group)
