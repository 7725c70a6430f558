"""Constructions, moves, repairs and breeding against enumeration on small problems."""

import itertools
import random

import numpy as np
import pytest

from roadspark.operators import construct, search
from roadspark.plans import queries


def problem(n, seed, vehicles=4, capacity=12.0, windows=False):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, 50, (n + 1, 2))
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    ready = np.concatenate([[0], rng.integers(0, 60, n)]) if windows else np.zeros(n + 1)
    due = np.concatenate([[10_000], ready[1:] + rng.integers(60, 200, n)]) if windows else np.full(n + 1, 10_000.0)
    return search.Problem(d, np.concatenate([[0], rng.integers(1, 5, n)]).astype(float), ready.astype(float), due.astype(float), np.zeros(n + 1) + 2.0, capacity, vehicles)


def valid(p, routes):
    stops = [k for r in routes for k in r]
    return len(stops) == len(set(stops)) and len(routes) <= p.vehicles and all(np.isfinite(p.route_cost(r)) for r in routes)


def best_plan(p):
    """The cheapest plan of all stops, by all set partitions into routes and the best order of each."""
    stops, memo = list(range(1, p.n)), {}

    def route(own):
        if own not in memo:
            memo[own] = search.exact_route(p, list(own))[0]
        return memo[own]

    def parts(left):
        if not left:
            yield []
            return
        first, rest = left[0], left[1:]
        for size in range(len(rest) + 1):
            for more in itertools.combinations(rest, size):
                own = (first, *more)
                for others in parts([k for k in rest if k not in more]):
                    yield [own, *others]

    return min(sum(route(r) for r in plan) for plan in parts(stops) if len(plan) <= p.vehicles)


@pytest.mark.parametrize("windows", [False, True])
def test_plans_reach_the_optimum_of_small_problems(windows):
    for seed in range(3):
        p = problem(6, seed, windows=windows)
        best = best_plan(p)
        for plan in (construct.solomon(p), search.insertion(p, search.insertion_order(p, None)), construct.regret(p, [], list(range(1, p.n)))):
            assert valid(p, plan) and p.cost(plan) >= best - 1e-6
            assert best - 1e-6 <= p.cost(construct.polished(p, plan)) <= p.cost(plan) + 1e-6
        bred = construct.bred(p, seed, rounds=12, size=6)
        assert all(valid(p, x) for x in bred) and p.cost(bred[0]) <= best * 1.02 + 1e-6


def test_probes():
    rnd = random.Random(2)
    for seed in range(20):
        p = problem(8, seed, windows=True)
        route = rnd.sample(range(1, 7), 3)
        for at in range(4):
            travel, shift = construct.shift_probe(p, route, at, 8)
            whole = route[:at] + [8] + route[at:]
            legs = lambda r: sum(p.d[a, b] for a, b in zip([0, *r], [*r, 0]))
            assert abs(travel - (legs(whole) - legs(route))) < 1e-9 and shift >= -1e-9
            if at < 3:
                service = lambda r, k: max(construct.starts(p, r[: r.index(k)]) + p.d[([0] + r)[r.index(k)], k], p.ready[k])
                assert abs(shift - (service(whole, route[at]) - service(route, route[at]))) < 1e-9
        options = [(p.route_cost(two[:j] + [8] + two[j:]) - p.route_cost(route), i, j) for i in range(4) for two in [route[:i] + [7] + route[i:]] for j in range(i + 1, 5)]
        cost, i, j = construct.pair_probe(p, route, 7, 8)
        want = min(c for c, _, _ in options)
        assert (np.isinf(cost) and (np.isinf(want) or np.isnan(want))) or abs(cost - want) < 1e-9


def test_moves_keep_stops_and_reach_their_ends():
    p = problem(7, 4)
    routes = [[1, 2, 3], [4, 5], [6, 7]]
    for make in (construct.swap_star(p, routes), construct.cross_exchange(routes), construct.route_splits(routes, 4)):
        seen = 0
        for which, new in make:
            seen += 1
            assert sorted(k for r in new for k in r) == sorted(k for w in which for k in routes[w])
        assert seen
    assert ((0, 1), [[4, 5, 3], [1, 2]]) in [(w, n) for w, n in construct.cross_exchange(routes)]
    assert list(construct.route_splits(routes, 3)) == []


def test_repairs():
    p = problem(7, 5, vehicles=3, capacity=100.0)
    assert construct.unserved(p, construct.repaired(p, [[1], [2]])) == []
    few = construct.within_fleet(p, [[1], [2, 3], [4, 5], [6, 7]], 2)
    assert len(few) <= 2 and construct.unserved(p, few) == []
    once = construct.grouped_once(p, [[1, 2], [3]], {1: 0, 2: 0, 5: 1, 6: 1})
    served = {k for r in once for k in r}
    assert len(served & {1, 2}) == 1 and len(served & {5, 6}) == 1 and 3 in served
    tight = problem(4, 1, vehicles=1, capacity=1.0)
    tight.demand[:] = [0, 1, 1, 1, 1]
    assert construct.prize_swapped(tight, [[1]], np.array([0, 1.0, 5.0, 9.0, 2.0])) == [[3]]
    routes = [[1, 2, 3, 4, 5], [6]]
    gap = lambda r: max(p.route_cost(x) for x in r) - min(p.route_cost(x) for x in r)
    assert gap(construct.levelled(p, routes)) < gap(routes)
    rng = np.random.default_rng(0)
    kicked = construct.perturbed(p, [[1, 2, 3], [4, 5, 6, 7]], rng)
    assert valid(p, kicked) and construct.unserved(p, kicked) == []
    assert p.cost(construct.late_acceptance(p, [[1, 2, 3], [4, 5, 6, 7]], rng, 300)) <= p.cost([[1, 2, 3], [4, 5, 6, 7]])


def test_crossovers_and_population():
    a, b = [1, 2, 3, 4, 5, 6], [6, 5, 4, 3, 2, 1]
    assert construct.ordered_crossover(a, b, 1, 3) == [6, 2, 3, 4, 1, 5] or sorted(construct.ordered_crossover(a, b, 1, 3)) == a
    assert construct.ordered_crossover(a, b, 1, 3)[1:4] == [2, 3, 4] and sorted(construct.ordered_crossover(a, b, 4, 1)) == a
    assert construct.edge_distance([[1, 2], [3]], [[1, 2], [3]]) == 0 and construct.edge_distance([[1, 2, 3]], [[1, 3, 2]]) > 0
    p = problem(6, 2)
    pop = construct.Population(p, 3)
    rng = np.random.default_rng(1)
    for _ in range(12):
        pop.add(search.insertion(p, search.insertion_order(p, rng)))
    best = min(c for c, _ in pop.plans)
    pop.cull()
    assert len(pop.plans) <= 3 and pop.best()[0] == best
    child = construct.route_crossover(p, pop.pick(rng), pop.pick(rng), rng)
    assert valid(p, child) and construct.applies(p) and not construct.applies(p, jobs_only=False)


def test_clusters_and_islands(spark):
    rows = [(q, i, float(x), float(y), 0.0 if i == 0 else 1.0, 0.0, 1e9, 0.0) for q in (1, 2) for i, (x, y) in enumerate([(0, 0)] + [(10 * (k % 2) + k * 0.1, 5 * q + k) for k in range(8)])]
    problems = spark.createDataFrame(rows, "problem long, i long, x double, y double, demand double, ready double, due double, service double")
    for found in (construct.decomposed(problems, 3, 4.0, 4, 0, 20).collect(), construct.islands(problems, 2, 2, 4.0, 4, 4, 4).collect()):
        assert {r.problem for r in found} == {1, 2}
        for r in found:
            assert r.unserved == 0 and sorted(k for x in r.routes for k in x) == list(range(1, 9)) and all(len(x) <= 4 for x in r.routes)
    d = np.abs(np.array([0, 1, 2, 50, 51, 52])[:, None] - np.array([0, 1, 2, 50, 51, 52])[None]).astype(float)
    own = construct.medoid_clusters(d, 2)
    assert len(set(own[:3])) == len(set(own[3:])) == 1 and own[0] != own[3]
    assert sum(construct.vehicle_shares([1, 1, 8], 10)) == 10 and construct.vehicle_shares([1, 1, 8], 10)[2] == 8


def test_farthest_first(spark, small):
    rows = queries.farthest_first(spark, small).collect()
    stops = queries.fixture(spark, small, "stops").select("route_id", "job", "lat", "lon").collect()
    by, order = {}, {}
    for r in stops:
        by.setdefault(r.route_id, []).append((r.job, r.lat, r.lon))
    for r in rows:
        order.setdefault(r.route_id, {})[r.rank] = r.id
    for route, points in by.items():
        scale = max(np.cos(np.radians(np.mean([p[1] for p in points]))), 1e-6)
        at = {j: (lon * scale, lat) for j, lat, lon in points}
        far = lambda a, b: (at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2  # noqa: B023, E731
        line = [order[route][k] for k in sorted(order[route])]
        assert sorted(line) == sorted(at) and line[0] == min(at)
        for k in range(1, len(line)):
            gaps = {j: min(far(j, x) for x in line[:k]) for j in at if j not in line[:k]}
            assert gaps[line[k]] >= max(gaps.values()) - 1e-12


def windowed(rng, n, whole):
    d = rng.integers(0, 6, (n, n)) * 20.0 if whole else rng.random((n, n)) * 100
    ready = rng.random(n) * 200
    due = ready + rng.random(n) * 300
    ready[0], due[0] = 0, 2000
    return search.Problem(d, rng.random(n) * 100, ready, due, rng.random(n) * 10, 300.0, 4)


def first_gain(p, routes, options):
    for which, new in options:
        if sum(p.route_cost(r) if r else 0.0 for r in new) < sum(p.route_cost(routes[k]) for k in which) - 1e-6:
            return which, new
    return None


def test_likely_moves_keep_every_first_improvement():
    rng, found = np.random.default_rng(11), 0
    for t in range(60):
        p = windowed(rng, int(rng.integers(2, 14)), t % 2)
        np.fill_diagonal(p.d, 0)
        p = search.Problem(p.d, p.demand, p.ready, p.due, p.service, p.capacity, p.vehicles)
        routes = search.insertion(p, search.insertion_order(p, rng))
        for _ in range(8):
            some, whole = list(search.likely_moves(p, routes)), list(search.moves(routes))
            assert first_gain(p, routes, some) == (got := first_gain(p, routes, whole)) and len(some) <= len(whole)
            if got is None:
                break
            found += 1
            routes = [r for r in [*(r for k, r in enumerate(routes) if k not in got[0]), *got[1]] if r]
    assert found > 50


def test_searches_make_few_routes():
    """Of a route problem's moves few are worth making: these 24 stops took 35268 costs of routes before, 182 now."""
    rng = np.random.default_rng(3)
    xy = rng.random((25, 2)) * 1000
    p = search.Problem.at(xy, np.full(25, 60.0), np.zeros(25), np.full(25, 1e6), np.zeros(25), 400.0, 6)
    asked, cost = [0], p.route_cost
    p.route_cost = lambda r: asked.__setitem__(0, asked[0] + 1) or cost(r)
    search.solve(p, 1, 1, 10)
    assert 0 < asked[0] < 3000


def test_each_group_over_batches(spark):
    rows = [(k, i) for k in [None, 1, 2, 5] for i in range(1 if k == 2 else 40)] + [(1, None)]
    df = spark.createDataFrame(rows, "problem long, i long").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = search.each_group(df, ["problem"], lambda key, own: [(key[0], own["i"].tolist())], "problem long, own array<long>").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = [(None, list(range(40))), (1, [*range(40), None]), (2, [0]), (5, list(range(40)))]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_likely_larger_moves_keep_every_first_improvement():
    rng, found = np.random.default_rng(12), 0
    for t in range(60):
        p = windowed(rng, int(rng.integers(4, 13)), t % 2)
        np.fill_diagonal(p.d, 0)
        p = search.Problem(p.d, p.demand, p.ready, p.due, p.service, p.capacity, p.vehicles)
        routes = search.insertion(p, search.insertion_order(p, rng))
        for some, whole in ((construct.likely_crosses(p, routes), construct.cross_exchange(routes)), (construct.likely_swaps(p, routes), construct.swap_star(p, routes)), (construct.likely_every(p, routes), construct.every_move(p, routes))):
            got = first_gain(p, routes, whole)
            assert first_gain(p, routes, some) == got
            found += got is not None
    assert found > 30


def test_clusters_keep_problems_without_a_number(spark):
    rows = [(k, i, float(i * 7 % 5), float(i * 3 % 11), 1.0, 0.0, 1e6, 0.0) for k in (None, 3) for i in range(9)]
    df = spark.createDataFrame(rows, "problem long, i long, x double, y double, demand double, ready double, due double, service double")
    one, other = sorted(construct.decomposed(df, 4, 5.0, 3, 0, 5).collect(), key=lambda r: r.problem or 0)
    assert (one.problem, other.problem) == (None, 3) and one[1:] == other[1:] and sorted(k for r in one.routes for k in r) == list(range(1, 9))
