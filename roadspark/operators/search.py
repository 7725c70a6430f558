"""Plans by search: insertion, local moves, restarts and clusters.

A search runs in one task over one problem's arrays; Spark spreads seeds and clusters over tasks and keeps the
best of each. Budgets are iterations, and the random numbers are seeded, so results repeat. Problems come as
rows (problem, i, x, y, demand, ready, due, service), row 0 the depot.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..plans.lineage import spread

EPS = 1e-9
GAIN = 1e-7
UNSERVED = 1e9
COLUMNS = ["problem", "i", "x", "y", "demand", "ready", "due", "service"]
PLAN = "problem long, seed long, cost double, unserved long, routes array<array<long>>"


class Problem:
    """Arrays of one problem, with exact feasibility of routes."""

    def __init__(self, d: np.ndarray, demand, ready, due, service, capacity: float, vehicles: int):
        self.d, self.demand, self.ready, self.due, self.service = d, demand, ready, due, service
        self.capacity, self.vehicles, self.n = capacity, vehicles, len(demand)
        #: Views of the same numbers, which single steps read faster.
        self.rows, self.loads = [memoryview(row) for row in np.asarray(d)], memoryview(np.asarray(demand))
        self.times = [memoryview(np.asarray(x)) for x in (ready, due, service)]
        self.known: tuple = (None, ())

    def lists(self) -> tuple[list[list[float]], list[float], float, float]:
        """Travel and demands as lists, the most that a route may load, and what legs must save at least; of the arrays as they are now.

        Both limits leave room for sums that are made in another order.
        """
        now = (np.asarray(self.d).tobytes(), np.asarray(self.demand).tobytes(), self.capacity)
        if now != self.known[0]:
            far, home = (float(np.abs(self.d).max()), abs(float(self.d[0][0]))) if self.n else (0.0, 0.0)
            most = self.capacity + EPS + 1e-15 * (self.n + 2) * float(np.abs(self.demand).sum())
            self.known = now, (np.asarray(self.d).tolist(), np.asarray(self.demand).tolist(), most, 1e-15 * (self.n + 2) ** 2 * far + 4 * home - GAIN)
        return self.known[1]

    @classmethod
    def of(cls, pdf: pd.DataFrame, capacity: float, vehicles: int) -> Problem:
        pdf = pdf.sort_values("i")
        return cls.at(pdf[["x", "y"]].to_numpy(float), *(pdf[c].to_numpy(float) for c in ("demand", "ready", "due", "service")), capacity, vehicles)

    @classmethod
    def at(cls, xy: np.ndarray, *rest) -> Problem:
        """The problem of places in the plane; the rest as above."""
        return cls(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2)), *rest)

    def load(self, route: list[int]) -> float:
        total, loads = 0, self.loads
        for k in route:
            total += loads[k]
        return total

    def route_cost(self, route: list[int]) -> float:
        """Travel, or infinity where capacity or a window is broken."""
        if self.load(route) > self.capacity + EPS:
            return math.inf
        ready, due, service = self.times
        rows, clock, total = self.rows, ready[0], 0.0
        row = rows[0]
        for k in route:
            total += row[k]
            clock += row[k]
            if clock < ready[k]:
                clock = ready[k]
            if clock > due[k] + EPS:
                return math.inf
            clock += service[k]
            row = rows[k]
        if clock + row[0] > due[0] + EPS:
            return math.inf
        return total + row[0]

    def cost(self, routes: list[list[int]]) -> float:
        return added(self.route_cost(r) for r in routes) + UNSERVED * (self.n - 1 - sum(map(len, routes)))


def insertion(p: Problem, order: list[int], routes: list[list[int]] | None = None) -> list[list[int]]:
    """Each stop at its cheapest place; a new route where that is cheapest or nothing else fits."""
    routes = [list(r) for r in routes or []]
    rows, demand, most, _ = p.lists()
    costs, loads = [p.route_cost(r) for r in routes], [p.load(r) for r in routes]
    for k in order:
        best, own, room = (math.inf, None, None), rows[k], most - demand[k]
        for a, r in enumerate(routes):
            if loads[a] > room:
                continue
            line = [0, *r, 0]
            for b in range(len(r) + 1):
                before, right = rows[line[b]], line[b + 1]
                if before[k] + own[right] - before[right] >= best[0] - EPS:
                    continue
                gain = p.route_cost(r[:b] + [k] + r[b:]) - costs[a]
                if gain < best[0] - EPS:
                    best = (gain, a, b)
        if len(routes) < p.vehicles and (alone := p.route_cost([k])) < best[0] - EPS:
            best = (alone, len(routes), 0)
            routes.append([])
            costs.append(0.0)
            loads.append(0)
        if best[1] is not None:
            a = best[1]
            routes[a].insert(best[2], k)
            costs[a], loads[a] = p.route_cost(routes[a]), p.load(routes[a])
    return routes


def moves(routes: list[list[int]]):
    """Relocations of one to three stops, exchanges, reversals and tail swaps: (route numbers, their new contents)."""
    for a, r in enumerate(routes):
        for i, j in itertools.combinations(range(len(r) + 1), 2):
            if j - i > 1:
                yield (a,), [r[:i] + r[i:j][::-1] + r[j:]]
            if j - i <= 3:
                part, rest = r[i:j], r[:i] + r[j:]
                for b, other in enumerate(routes):
                    if b == a:
                        for k in range(len(rest) + 1):
                            yield (a,), [rest[:k] + part + rest[k:]]
                    else:
                        for k in range(len(other) + 1):
                            yield (a, b), [rest, other[:k] + part + other[k:]]
    for a, b in itertools.combinations(range(len(routes)), 2):
        r, s = routes[a], routes[b]
        for i in range(len(r)):
            for j in range(len(s)):
                yield (a, b), [r[:i] + [s[j]] + r[i + 1 :], s[:j] + [r[i]] + s[j + 1 :]]
        for i in range(len(r) + 1):
            for j in range(len(s) + 1):
                yield (a, b), [r[:i] + s[j:], s[:j] + r[i:]]


def likely_moves(p: Problem, routes: list[list[int]]):
    """The moves of `moves`, in their order, without those that feasible routes cannot gain by.

    A route costs its travel or infinity, so a move whose legs save nothing, or whose loads do not fit, is none; both
    are seen without making the routes. What rounding might turn is kept, so that the first improvement is the same.
    """
    rows, loads, most, limit = p.lists()
    lines = [[0, *r, 0] for r in routes]
    edges = [[(x, y, rows[x][y]) for x, y in itertools.pairwise(line)] for line in lines]
    total = [p.load(r) for r in routes]
    for a, r in enumerate(routes):
        line, legs, size = lines[a], edges[a], len(r)
        for i in range(size):
            first, before = r[i], line[i]
            into, from_before = rows[before][first], rows[before]
            part, inner, back = 0, 0.0, 0.0
            for j in range(i + 1, size + 1):
                last, after = r[j - 1], line[j + 1]
                out = rows[last]
                part += loads[last]
                if j - i > 1:
                    x = r[j - 2]
                    inner += rows[x][last]
                    back += out[x]
                    if not from_before[last] + back + rows[first][after] - into - inner - out[after] > limit:
                        yield (a,), [r[:i] + r[i:j][::-1] + r[j:]]
                if j - i > 3:
                    continue
                closed = from_before[after]
                # what a place may add at most
                room = into + out[after] - closed + limit
                for b, other in enumerate(routes):
                    if b == a:
                        rest = r[:i] + r[j:]
                        k = 0
                        for x, y, leg in [*legs[:i], (before, after, closed), *legs[j + 1 :]]:
                            if not rows[x][first] + out[y] - leg > room:
                                yield (a,), [rest[:k] + r[i:j] + rest[k:]]
                            k += 1
                    elif not total[b] + part > most:
                        k = 0
                        for x, y, leg in edges[b]:
                            if not rows[x][first] + out[y] - leg > room:
                                yield (a, b), [r[:i] + r[j:], other[:k] + r[i:j] + other[k:]]
                            k += 1
    for a, b in itertools.combinations(range(len(routes)), 2):
        r, s, one, two = routes[a], routes[b], lines[a], lines[b]
        free_r, free_s = most - total[a], most - total[b]
        taken = [(y, x, z, rows[x][y] + rows[y][z], loads[y]) for x, y, z in zip(two, s, two[2:])]
        for i, u in enumerate(r):
            x, z, load = one[i], one[i + 2], loads[u]
            from_x, from_u = rows[x], rows[u]
            lost = from_x[u] + from_u[z] + limit
            j = 0
            for v, before, after, legs, other in taken:
                if not (other - load > free_r or load - other > free_s or from_x[v] + rows[v][z] + rows[before][u] + from_u[after] - legs > lost):
                    yield (a, b), [r[:i] + [v] + r[i + 1 :], s[:j] + [u] + s[j + 1 :]]
                j += 1
        heads = list(itertools.accumulate((loads[k] for k in s), initial=0))
        head = 0
        for i, (x, z, leg) in enumerate(edges[a]):
            from_x, tail = rows[x], total[a] - head
            j = 0
            for y, w, other in edges[b]:
                if not (from_x[w] + rows[y][z] - leg - other > limit or head + total[b] - heads[j] > most or heads[j] + tail > most):
                    yield (a, b), [r[:i] + s[j:], s[:j] + r[i:]]
                j += 1
            head += loads[z]


def local_search(p: Problem, routes: list[list[int]], most: int = 50) -> list[list[int]]:
    """First improvements until none is left, `most` at most."""
    costs = [p.route_cost(r) for r in routes]
    for _ in range(most):
        for which, new in likely_moves(p, routes) if math.inf not in costs else moves(routes):
            after = [p.route_cost(r) for r in new]
            if added(after) < added(costs[k] for k in which) - GAIN:
                for k, r, c in zip(which, new, after):
                    routes[k], costs[k] = r, c
                keep = [k for k, r in enumerate(routes) if r]
                routes, costs = [routes[k] for k in keep], [costs[k] for k in keep]
                break
        else:
            break
    return routes


def added(costs) -> float:
    """The sum from left to right (Python's own corrects for rounding)."""
    out = 0.0
    for c in costs:
        out += c
    return out


def insertion_order(p: Problem, rng: np.random.Generator | None) -> list[int]:
    """Earliest windows first, then ids; a random generator shuffles."""
    order = sorted(range(1, p.n), key=lambda k: (p.due[k], k))
    if rng is not None:
        rng.shuffle(order)
    return order


def solve(p: Problem, seed: int, kicks: int = 10, most: int = 50) -> list[list[int]]:
    """Insertion, local search, and kicks that take out two fifths of the stops and put them back; never worse than insertion."""
    rng = np.random.default_rng(seed)
    best = local_search(p, insertion(p, insertion_order(p, None if seed == 0 else rng)), most)
    for _ in range(kicks):
        out = set(rng.choice(np.arange(1, p.n), max(1, int(0.4 * (p.n - 1))), replace=False).tolist()) if p.n > 1 else set()
        left = [r for r in ([k for k in route if k not in out] for route in best) if r]
        served = {k for r in left for k in r}
        missing = [k for k in insertion_order(p, rng) if k not in served]
        new = local_search(p, insertion(p, missing, left), most)
        if p.cost(new) < p.cost(best) - EPS:
            best = new
    return best


def split(p: Problem, tour: list[int]) -> list[list[int]]:
    """The best cut of a giant tour into routes; ties to fewer routes."""
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)] + [(float("inf"), 0, 0)] * len(tour)
    for j in range(1, len(tour) + 1):
        for i in range(j):
            c = best[i][0] + p.route_cost(tour[i:j])
            if not np.isfinite(c):
                continue
            if (c, best[i][1] + 1) < (best[j][0] - EPS, best[j][1]) or abs(c - best[j][0]) <= EPS and best[i][1] + 1 < best[j][1]:
                best[j] = (c, best[i][1] + 1, i)
    if not np.isfinite(best[-1][0]):
        return []
    out, at = [], len(tour)
    while at:
        out.append(tour[best[at][2] : at])
        at = best[at][2]
    return out[::-1]


def exact_route(p: Problem, stops: list[int]) -> tuple[float, list[int]]:
    """The cheapest feasible order of up to 14 stops, by branch and bound."""
    if len(stops) > 14:
        raise ValueError("at most 14 stops")
    best = [float("inf"), []]

    def grow(route, left, clock, total):
        at = route[-1] if route else 0
        if not left:
            total += p.d[at, 0]
            if clock + p.d[at, 0] <= p.due[0] + EPS and total < best[0] - EPS:
                best[:] = [total, list(route)]
            return
        bound = total + sum(min(p.d[j, k] for j in [at, *left] if j != k) for k in left)
        if bound >= best[0] - EPS:
            return
        for k in sorted(left, key=lambda k: (p.d[at, k], k)):
            when = max(clock + p.d[at, k], p.ready[k])
            if when <= p.due[k] + EPS:
                grow([*route, k], left - {k}, when + p.service[k], total + p.d[at, k])

    if sum(p.demand[k] for k in stops) <= p.capacity + EPS:
        grow([], frozenset(stops), p.ready[0], 0.0)
    return best[0], best[1]


def multi_start(problems: DataFrame, seeds: int, capacity: float, vehicles: int, kicks: int = 10, most: int = 50) -> DataFrame:
    """The best plan of each problem over seeds: problem, seed, cost, unserved, routes."""
    rows = problems.select(*COLUMNS).withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(seeds - 1).cast("long"))))

    def run(key, own):
        p = problem_of(own, capacity, vehicles)
        routes = solve(p, key[1], kicks, most)
        names = own["i"].tolist()
        yield (*key, float(p.cost(routes)), p.n - 1 - sum(map(len, routes)), [[names[k] for k in r] for r in routes])

    found = each_group(rows, ["problem", "seed"], run, PLAN)
    best = found.groupBy("problem").agg(F.min(F.struct("cost", "seed", "unserved", "routes")).alias("w"))
    return best.select("problem", "w.seed", "w.cost", "w.unserved", "w.routes")


def problem_of(own: dict[str, np.ndarray], capacity: float, vehicles: int) -> Problem:
    """The problem of a group's columns, which are sorted by i."""
    return Problem.at(np.column_stack([own["x"], own["y"]]).astype(float), *(own[c].astype(float) for c in ("demand", "ready", "due", "service")), capacity, vehicles)


def each_group(df: DataFrame, keys: list[str], run, schema: str, order: tuple[str, ...] = ("i",)) -> DataFrame:
    """The rows that run(key, columns) gives for each group, of keys that are whole numbers or null; columns are arrays, sorted by `order`, nulls last.

    Rows are dealt by keys and sorted, and groups are cut out of whole Arrow batches, one after the other: of many
    small groups each costs its own work alone.
    """
    rows = spread(df, *keys).sortWithinPartitions(*keys, *[F.col(c).asc_nulls_last() for c in order])
    names, kinds = df.columns, to_arrow_schema(_parse_datatype_string(schema))

    def cut(table: pa.Table):
        """Groups of rows that are sorted by keys: where they begin, and where the last ends."""
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            column = table.column(k)
            value, none = column.fill_null(0).to_numpy(), column.is_null().to_numpy()
            new[1:] |= (value[1:] != value[:-1]) | (none[1:] != none[:-1])
        return [*np.flatnonzero(new).tolist(), table.num_rows]

    def array(column: pa.ChunkedArray) -> np.ndarray:
        if column.null_count and pa.types.is_integer(column.type):  # numpy would make them floats
            return np.array(column.to_pylist(), object)
        return column.to_numpy()

    def groups(batches):
        held: list[pa.RecordBatch] = []  # of one group, but for the newest
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            first = pa.Table.from_batches([held[0].slice(0, 1), batch.slice(batch.num_rows - 1)])
            if len(cut(first)) == 2:  # the group goes on
                continue
            table = pa.Table.from_batches(held)
            at = cut(table)
            yield table.slice(0, at[-2]), at[:-1]
            held = pa.Table.from_batches([batch]).slice(at[-2] - (table.num_rows - batch.num_rows)).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield table, cut(table)

    def task(batches):
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)
        for table, at in groups(batches):
            columns = {n: array(table.column(n)) for n in names}
            firsts = [table.column(k).take(at[:-1]).to_pylist() for k in keys]
            out: list[tuple] = []
            for key, a, b in zip(zip(*firsts), at, at[1:]):
                out += run(key, {n: c[a:b] for n, c in columns.items()})
                if len(out) >= 1000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    return rows.mapInArrow(task, schema)


def insertion_slots(steps: DataFrame, tasks: DataFrame, near: DataFrame, cells: DataFrame, most: int = 1) -> DataFrame:
    """The `most` cheapest slots of each task among those next to its near places: task, rank, route_id, after (seq) and delta.

    steps(route_id, seq, place), tasks(task, place), near(i, j, rank), cells(i, j, dur). One round of insertion as a query.
    """
    w = Window.partitionBy("route_id").orderBy("seq")
    slots = steps.select("route_id", "seq", F.col("place").alias("a"), F.lead("place").over(w).alias("b")).where("b IS NOT NULL")
    some = tasks.join(near.select(F.col("i").alias("place"), F.col("j").alias("a")), "place").join(slots, "a")
    leg = lambda x, y, n: cells.select(F.col("i").alias(x), F.col("j").alias(y), F.col("dur").alias(n))
    rows = some.join(leg("a", "place", "d1"), ["a", "place"]).join(leg("place", "b", "d2"), ["place", "b"]).join(leg("a", "b", "d0"), ["a", "b"])
    order = Window.partitionBy("task").orderBy("delta", "route_id", "seq")
    rows = rows.withColumn("delta", F.col("d1") + F.col("d2") - F.col("d0")).withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= most).select("task", "rank", "route_id", F.col("seq").alias("after"), "delta")
