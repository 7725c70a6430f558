import collections
import heapq
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadspark.functions import arrays, expr, geo, polyline, text
from roadspark.functions.profiles import CustomProfile
from roadspark.operators import evaluate, graph_build, isochrone, learn, matching, nearest, paths, propagate, search, trip
from roadspark.plans.queries import QUERIES
from roadspark.plans.workload import fixture
from roadspark.streaming import live


def graph(n=40, seed=3, extra=80):
    rnd = random.Random(seed)
    edges = {(k, k + 1): rnd.randint(1, 9) for k in range(n - 1)}
    while len(edges) < n - 1 + extra:
        a, b = rnd.randrange(n), rnd.randrange(n)
        if a != b:
            edges[a, b] = rnd.randint(1, 30)
    return [(a, b, w, 10 * w + (a + b) % 3) for (a, b), w in edges.items()]


def dijkstra(edges, source):
    out, heap = {}, [(0, 0, source)]
    while heap:
        d, m, v = heapq.heappop(heap)
        if v in out:
            continue
        out[v] = (d, m)
        for a, b, w, x in edges:
            if a == v and b not in out:
                heapq.heappush(heap, (d + w, m + x, b))
    return out


SCHEMA = "src bigint, dst bigint, dur bigint, dist bigint"


def test_shortest_paths_both_forms(spark, monkeypatch):
    rows = graph()
    edges = spark.createDataFrame(rows, SCHEMA)
    sources = spark.createDataFrame([(0,), (7,), (99,)], "source bigint")
    want = {(s, n, d) for s in (0, 7) for n, (d, _) in dijkstra(rows, s).items()} | {(99, 99, 0)}
    assert {(r.src, r.dst, r.dur) for r in paths.matrix(edges, sources).collect()} == want
    assert {(r.source, r.node, r.dur) for r in paths.reach(paths.clean(edges), sources).collect()} == want
    pairs = spark.createDataFrame([(0, 39), (7, 20), (39, 0)], "src bigint, dst bigint")
    a = {(r.src, r.dst): r.dur for r in paths.path(edges, pairs).collect()}
    monkeypatch.setattr(paths, "BROADCAST_EDGES", 1)
    b = {(r.src, r.dst): r.dur for r in paths.path(edges, pairs).collect()}
    assert a == b and a[0, 39] == dijkstra(rows, 0)[39][0]


def test_paths_are_walks(spark):
    rows = graph()
    weight = {(a, b): w for a, b, w, _ in rows}
    out = paths.path(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(0, 39)], "src bigint, dst bigint")).head()
    assert sum(weight[e] for e in zip(out.nodes, out.nodes[1:])) == out.dur
    alts = paths.alternatives(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(0, 39)], "src bigint, dst bigint"), 0.5).orderBy("rank").collect()
    assert alts[0].dur == out.dur and all(x.dur <= out.dur * 1.5 for x in alts)


def test_knn_on_a_line(spark):
    line = [(k, k + 1, 1, 10) for k in range(4)] + [(k + 1, k, 1, 10) for k in range(4)]
    edges = spark.createDataFrame(line, SCHEMA)
    nodes = spark.createDataFrame([(k,) for k in range(5)], "node bigint")
    out = {(r.src, r.rank): (r.dst, r.dur, r.dist) for r in paths.nearest_customers(edges, nodes, 2).collect()}
    assert out[0, 1] == (1, 1, 10) and out[0, 2] == (2, 2, 20) and out[2, 1] == (1, 1, 10) and len(out) == 10
    empty = spark.createDataFrame([], SCHEMA)
    assert paths.matrix(empty, nodes.select(F.col("node").alias("source"))).count() == 5


def test_components_and_largest(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11)], "src bigint, dst bigint")
    out = paths.components(edges, spark.createDataFrame([(50,)], "node bigint"))
    assert {(r.node, r.component) for r in out.collect()} == {(1, 1), (2, 1), (3, 1), (10, 10), (11, 10), (50, 50)}
    assert {r.node for r in paths.largest_component(out).collect()} == {1, 2, 3}


def test_nearest_is_exact(spark):
    rnd = random.Random(5)
    sites = [(k, 59 + rnd.random() * (0.05 if k < 150 else 3), 10 + rnd.random()) for k in range(200)]
    points = [(k, 59 + rnd.random() * 3, 10 + rnd.random() * 2) for k in range(40)] + [(99, None, 10.0)]
    out = nearest.nearest(spark.createDataFrame(points, "point bigint, lat double, lon double"), spark.createDataFrame(sites, "site bigint, lat double, lon double"), 3).collect()
    got = {(r.point, r.rank): r.site for r in out}
    for p, la, lo in points[:-1]:
        order = sorted((geo.haversine_py(la, lo, a, b), s) for s, a, b in sites)
        assert [got[p, k + 1] for k in range(3)] == [s for _, s in order[:3]]
    assert all(p != 99 for p, _ in got)


def fold_by_hand(stops, start=0):
    clock, out, before = start, [], 0
    for leg, setup, service, ready, due in stops:
        clock = max(clock + before + leg + setup, ready)
        out.append((clock, max(0, clock - due)))
        before = service
    return out


def test_scan_equals_fold(spark):
    rnd = random.Random(1)
    rows, want = [], {}
    for route in range(30):
        stops = [(rnd.randint(0, 900), rnd.randint(0, 60), rnd.randint(0, 300), rnd.randint(0, 9000), rnd.randint(0, 12000)) for _ in range(rnd.randint(1, 12))]
        want |= {(route, k + 1): x for k, x in enumerate(fold_by_hand(stops))}
        rows += [(route, k + 1, s[0], s[0] * 10, s[1], s[2], s[3], s[4], 5, 0, 0) for k, s in enumerate(stops)]
    df = spark.createDataFrame(rows, "route_id bigint, seq bigint, leg_s bigint, leg_m bigint, setup_s bigint, service bigint, ready bigint, due bigint, demand bigint, home_s bigint, home_m bigint")
    timed = evaluate.timed(df.withColumn("capacity", F.lit(40)))
    assert {(r.route_id, r.seq): (r.arrival, r.lateness) for r in timed.collect()} == want
    window = F.array(F.struct(F.col("ready").alias("start"), F.col("due").alias("end")))
    late_ok = df.withColumns({"windows": window, "breaks": F.expr("cast(null as array<struct<service:bigint,start:bigint,end:bigint>>)")})
    folded = {(r.route_id, r.seq): r for r in evaluate.fold(late_ok.where("due >= ready")).collect()}
    assert folded and all(r.arrival >= 0 for r in folded.values())


def test_breaks_push_the_day(spark):
    schema = "route_id bigint, seq bigint, leg_s bigint, setup_s bigint, service bigint, windows array<struct<start:bigint,end:bigint>>, breaks array<struct<service:bigint,start:bigint,end:bigint>>"
    rows = [(1, 1, 100, 0, 50, [(0, 1000)], [(30, 120, 900)]), (1, 2, 100, 0, 50, [(0, 200), (400, 500)], [(30, 120, 900)])]
    out = {r.seq: r for r in evaluate.fold(spark.createDataFrame(rows, schema)).collect()}
    assert out[1].arrival == 100 and out[1].break_s == 30 and out[2].arrival == 400 and out[2].wait_s == 120
    late = [(1, 1, 900, 0, 50, [(0, 600)], None)]
    assert evaluate.fold(spark.createDataFrame(late, schema), "warp").head().arrival == 600
    assert evaluate.fold(spark.createDataFrame(late, schema), "carry").head().arrival == 900


@pytest.mark.parametrize("rule,want", [("a // 2 + b % 3", 3), ("-7 / 2", -3), ("1 if a < b < 9 else 2", 1), ("max(a, b) - min(xs)", 5), ("len(xs) + xs[-1]", 10), ("int(contains(xs, 4)) + index(xs, 7)", 2)])
def test_rules(spark, rule, want):
    df = spark.sql("SELECT 4L AS a, 7L AS b, array(2L, 7L, 7L) AS xs") if "index" in rule else spark.sql("SELECT 4L AS a, 7L AS b, array(2L, 4L, 7L) AS xs")
    if "contains" in rule:
        df, want = spark.sql("SELECT 4L AS a, 7L AS b, array(4L, 7L) AS xs"), 2
    col = expr.compile_rule(rule, {c: F.col(c) for c in df.columns}, {"a", "b"})
    assert df.select(col.cast("bigint").alias("v")).head().v == want


def test_rules_refuse(spark):
    for bad in ("__import__('os')", "a.b", "lambda: 1", "x", "open(1)", "1 +", "'text'"):
        with pytest.raises(expr.RuleError):
            expr.compile_rule(bad, {"a": F.col("a")})
    for bad in ("True < False", "1 + True", "[1] + 1", "x = 1", "a.b = 1\na", "later"):
        with pytest.raises(expr.RuleError):
            expr.compile_rule(bad, {"a": F.col("a"), "later": F.col("a")}, {"a"}, "route")
    with pytest.raises(expr.RuleError):
        expr.verdict("[1, 2]", {})


@pytest.mark.parametrize("rule,route,plan", [("1 / (stops - stops)", (False, 0.0), (True, 1e12)), ("stops > 3 and 1 / 0 > 2", (True, None), None), ("stops < 3 and 1 / 0 > 2", (False, 0.0), None), ("stops > 3 or 1 / 0 > 2", (True, 0.0), None), ("-5", (True, 0.0), None), ("stops * 2", (True, 10.0), None), ("x = stops + 1\ny = x * x\ny - 30", (True, 6.0), None), ("stops == 5", (True, 0.0), None), ("sum([0.5, 1.5])", (True, 2.0), None)])
def test_rule_verdicts(spark, rule, route, plan):
    df = spark.sql("SELECT 5L AS stops")
    told = lambda context: tuple(df.select(expr.verdict(rule, {"stops": F.col("stops")} if context == "route" else {"stops": F.col("stops")}, {"stops": "int"}, context).alias("v")).head().v)
    if route[1] is None:
        assert told("route") == (False, 0.0)  # an error in what is looked at rejects
    else:
        assert told("route") == route
    if plan:
        expr.FIELDS["solution"].append("stops")
        try:
            assert told("solution") == plan
        finally:
            expr.FIELDS["solution"].remove("stops")


def test_callbacks(spark):
    rows = spark.createDataFrame([(1, 5), (2, 0), (3, 7), (4, 9)], "route_id long, stops long")
    rule = lambda r: {1: True, 2: 1 / r["stops"] if r["stops"] else 1 / 0, 3: False}.get(r["route_id"], 2.5) if r["route_id"] != 2 else 1 / r["stops"]
    assert {r.route_id: r.penalty for r in expr.called_back(rows, rule).collect()} == {1: 0.0, 2: 0.0, 3: None, 4: 2.5}
    ways = spark.createDataFrame([(1, {"highway": "primary"}), (2, {}), (3, None)], "way long, tags map<string,string>")
    assert {r.way: r.kmh for r in expr.costed(ways, lambda t: 50 if t.get("highway") else 0).collect()} == {1: 50.0, 2: None, 3: None}


def test_text(spark):
    cases = {"50": 50.0, "30 mph": 30 * 1.609344, "10 knots": 18.52, "none": None, "walk": None, "0": None, "60 km/h": 60.0, "x": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.maxspeed(F.col("t")).alias("v"))
    assert {r.t: r.v and round(r.v, 6) for r in df.collect()} == {k: v and round(v, 6) for k, v in cases.items()}
    df = spark.createDataFrame([("Karl Johans gate 42",), ("Storgata 1A",), ("Plaza",)], "t string").select(text.house_number(F.col("t")).alias("p"))
    assert [tuple(r.p) for r in df.collect()] == [("Karl Johans gate", "42"), ("Storgata", "1A"), ("Plaza", None)]
    df = spark.createDataFrame([("4081;4083",), ("5",), ("7; 7",)], "t string").select(text.clean_house(F.col("t")).alias("p"))
    assert [r.p for r in df.collect()] == ["4081–4083", "5", "7"]


def test_profile_errors():
    assert CustomProfile.parse("# nothing\n").speed_factor == 1.0
    for bad in ("fly = 1", "base = boat", "penalty service = 0", "block a = 1", "speed x", "speed_factor = 0"):
        with pytest.raises(ValueError):
            CustomProfile.parse(bad)


def test_polyline():
    assert polyline.encode([(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]) == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    points = [(59.91234, 10.75), (-33.1, 151.2)]
    assert all(math.isclose(a, b, abs_tol=1e-5) for p, q in zip(points, polyline.decode(polyline.encode(points))) for a, b in zip(p, q))


def test_vectors(spark):
    df = spark.sql("SELECT array(1L, 2L) AS a, array(3L) AS b, cast(-5 as bigint) AS x")
    row = df.select(arrays.add(F.col("a"), F.col("b")).alias("s"), arrays.subtract(F.col("a"), F.col("b")).alias("d"), arrays.fits(F.col("b"), F.col("a")).alias("f"), arrays.unzigzag(arrays.zigzag(F.col("x"))).alias("z")).head()
    assert (row.s, row.d, row.f, row.z) == ([4, 2], [-2, 2], False, -5)


def test_trip_is_optimal():
    rnd = np.random.default_rng(2)
    for closed in (True, False):
        xy = rnd.random((7, 2))
        d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
        inner = range(1, 7 if closed else 6)
        want = min(trip.tour_cost(d, [0, *p, *([] if closed else [6])], closed) for p in itertools.permutations(inner))
        assert math.isclose(trip.tour_cost(d, trip.best_order(d, closed), closed), want)
    line = np.abs(np.arange(4)[:, None] - np.arange(4)[None]).astype(float)
    assert trip.tour_cost(line, trip.best_order(line, False), False) == 3 and trip.tour_cost(line, trip.best_order(line), True) == 6
    xy = rnd.random((20, 2))
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    assert sorted(trip.best_order(d)) == list(range(20))


def test_trip_order_takes_all_stops(spark, small):
    stops, rows = collections.defaultdict(dict), collections.defaultdict(list)
    for r in fixture(spark, small, "stops").collect():
        stops[r.route_id][r.seq - 1] = (r.lat, r.lon)
    for r in QUERIES["trip_order"](spark, small).orderBy("trip", "position").collect():
        rows[r.trip].append(r)
    assert max(map(len, stops.values())) > trip.EXACT and set(rows) == set(stops)
    for k, own in stops.items():
        order = [r.stop for r in rows[k]]
        assert order[0] == 0 and sorted(order) == sorted(own)
        lat, lon = np.radians([own[i] for i in range(len(own))]).T
        a = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat)[:, None] * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
        d = np.round(12742000 * np.arcsin(np.sqrt(np.minimum(1, a))) * 1.3 / 13.9)
        assert rows[k][0].total == trip.tour_cost(d, order, True)
        if len(own) <= 7:
            assert rows[k][0].total == min(trip.tour_cost(d, [0, *p], True) for p in itertools.permutations(range(1, len(own))))


def test_multi_start_plans_take_all_routes(spark, small):
    stops = collections.defaultdict(dict)
    for r in fixture(spark, small, "stops").collect():
        stops[r.route_id][r.seq] = ((r.lat - 59.9) * 1e4, (r.lon - 10.7) * 1e4, float(r.demand), float(r.service))
    plans = QUERIES["multi_start_plans"](spark, small).collect()
    assert sorted(r.problem for r in plans) == sorted(stops) and max(map(len, stops.values())) > 12
    for r in plans:
        own, served = stops[r.problem], [k for route in r.routes for k in route]
        assert len(set(served)) == len(served) == len(own) - r.unserved and set(served) <= set(own) and len(r.routes) <= 6
        x, y, demand, service = np.array([(0, 0, 0, 0), *(own[k] for k in sorted(own))], float).T
        d = np.hypot(x[:, None] - x, y[:, None] - y)
        p = search.Problem(d, demand, np.zeros(len(d)), np.array([1e9] + [1e6] * len(own)), service, 400.0, 6)
        place = {k: i + 1 for i, k in enumerate(sorted(own))}
        assert math.isclose(r.cost, p.cost([[place[k] for k in route] for route in r.routes]))
        if len(own) <= 4 and sum(demand) <= 400:
            best = min(sum(search.exact_route(p, list(part))[0] for part in parts) for parts in partitions(list(range(1, len(d)))))
            assert math.isclose(r.cost, best)


def partitions(left):
    if not left:
        yield []
        return
    for n in range(len(left)):
        for more in itertools.combinations(left[1:], n):
            for rest in partitions([k for k in left[1:] if k not in more]):
                yield [[left[0], *more], *rest]


def test_rings():
    assert [len(r) for r in isochrone.trace({(0, 0)})] == [5]
    assert len(isochrone.trace({(0, 0), (1, 1)})) == 2
    assert [len(r) for r in isochrone.trace({(r, c) for r in range(2) for c in range(3)})] == [11]
    assert len(isochrone.trace({(r, c) for r in range(3) for c in range(3)} - {(1, 1)})) == 2
    assert isochrone.contours([0, 600, 300, 300, 20000]) == [300, 600]


def test_viterbi_stays_on_the_road():
    emissions = {k: [(k, 5.0), (100 + k, 35.0 if k != 4 else 3.0)] for k in range(8)}
    moves = {(k, a): [(k + 1, 100.0 if a == k else 400.0, 100.0), (101 + k, 400.0 if a == k else 100.0, 100.0)] for k in range(7) for a in (k, 100 + k)}
    assert [n for _, n, _, _ in matching.viterbi(emissions, moves, 15.0)] == list(range(8))
    gap = matching.viterbi({0: [(1, 1.0)], 1: [(2, 1.0)]}, {}, 15.0)
    assert [(n, c) for _, n, _, c in gap] == [(1, True), (2, False)]
    assert matching.viterbi({}, {}, 15.0) == []


def test_map_match_takes_all_pings_and_nodes(spark, small):
    nodes = {r.node: (r.lat, r.lon) for r in fixture(spark, small, "nodes").collect()}
    names = np.array(sorted(nodes))
    lat, lon = np.radians([nodes[n] for n in names]).T
    traces = collections.defaultdict(list)
    for r in fixture(spark, small, "events").orderBy("ts", "event_id").collect():
        traces[r.user_id % 40].append(r.event_id)
    got = {(r.trace_id, r.seq): r for r in QUERIES["map_match"](spark, small).collect()}
    assert max(map(len, traces.values())) > 30 and set(got) == {(t, k + 1) for t, own in traces.items() for k in range(len(own))}
    for (t, seq), r in got.items():
        e = traces[t][seq - 1] % 60
        a, o = math.radians(59.9 + e * 0.001), math.radians(10.7 + e * 0.002)
        far = 12742000 * np.arcsin(np.sqrt(np.sin((lat - a) / 2) ** 2 + np.cos(a) * np.cos(lat) * np.sin((lon - o) / 2) ** 2))
        assert r.metres <= np.sort(far)[2] + 1e-3 and abs(far[names == r.node][0] - r.metres) < 1e-3


def test_ways(spark):
    nodes = spark.createDataFrame([(1, 59.0, 10.0), (2, 59.001, 10.0), (3, 59.002, 10.0)], "node bigint, lat double, lon double")
    ways = spark.createDataFrame([(1, [1, 2, 3], {"highway": "primary", "oneway": "yes", "name": "A"}), (2, [3, 1], {"highway": "footway"}), (3, [2], {"highway": "primary"}), (4, [1, 9, 2], {"highway": "residential"})], "way bigint, refs array<bigint>, tags map<string,string>")
    out = {(r.src, r.dst): r for r in graph_build.edges(ways, nodes, "car").where("src <> 1 OR dst <> 2 OR dur_s < 7").collect()}
    assert set(out) == {(1, 2), (2, 3), (2, 1)}
    assert math.isclose(out[2, 3].dur_s, out[2, 3].dist_m / (75 / 3.6))
    assert {(r.node, r.street) for r in graph_build.node_names(ways).collect()} == {(1, "A"), (2, "A"), (3, "A")}


def problem(seed, n=7):
    rnd = np.random.default_rng(seed)
    xy = rnd.random((n, 2)) * 100
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    return search.Problem(d, np.r_[0, rnd.integers(1, 5, n - 1)], np.zeros(n), np.full(n, 1e6), np.zeros(n), 12, 3)


def test_search_is_feasible_and_improves():
    for seed in range(4):
        p = problem(seed)
        greedy = p.cost(search.insertion(p, search.insertion_order(p, None)))
        routes = search.solve(p, 0, 3)
        assert p.cost(routes) <= greedy + 1e-9 and all(math.isfinite(p.route_cost(r)) for r in routes)
        assert sorted(k for r in routes for k in r) == list(range(1, p.n))
        cost, order = search.exact_route(p, [1, 2, 3])
        assert math.isclose(cost, min(p.route_cost(list(o)) for o in itertools.permutations([1, 2, 3])))
        tour = [k for r in routes for k in r]
        assert sum(map(p.route_cost, search.split(p, tour))) <= p.cost(routes) + 1e-9


def test_propagation(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 4)], "a bigint, b bigint")
    assert {(r.a, r.b) for r in propagate.closure(pairs).collect()} == {(1, 2), (2, 3), (1, 3), (4, 4)}
    jobs = spark.createDataFrame([(1, [(0, 100), (200, 300)]), (2, [(0, 10)]), (3, [])], "job bigint, windows array<struct<start:bigint,end:bigint>>")
    reach = spark.createDataFrame([(1, 50, 250), (2, 20, 90), (3, 5, 9)], "job bigint, earliest bigint, latest bigint")
    out = {r.job: r for r in propagate.tightened(jobs, reach).collect()}
    assert [tuple(w) for w in out[1].windows] == [(50, 100), (200, 250)] and out[2].reason == "no window" and out[3].reason is None
    assert {r.reason for r in propagate.tightened(jobs, reach, soft=True).collect()} == {None}


def test_live_stream_equals_replay(spark, tmp_path):
    rows = [(k % 3, 9, 1.0 + k % 4, 1_000_000 + 60_000 * k) for k in range(24)]
    schema = "src bigint, dst bigint, factor double, ms bigint"
    for part in range(3):
        spark.createDataFrame(rows[8 * part : 8 * part + 8], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = live.averaged(stream, expire=False).writeStream.outputMode("update").format("memory").queryName("delays").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    got = {r.src: r for r in spark.sql("SELECT src, max_by(struct(factor, updated_ms), updated_ms) AS s FROM delays GROUP BY src").collect()}
    for r in live.replayed(spark.createDataFrame(rows, schema)).collect():
        assert math.isclose(got[r.src].s.factor, r.factor) and got[r.src].s.updated_ms == r.updated_ms


def test_reports(spark):
    lines = spark.createDataFrame([(1, "10.0,59.0,1;10.1,59.1,2;bad;1,2"), (2, "10,59,1"), (3, "")], "report_id bigint, body string")
    assert {(r.report_id, r.seq) for r in live.parsed(lines).collect()} == {(1, 0), (1, 1)}


def test_regression(spark):
    rows = [(float(k), float(k % 5), 3 + 2.0 * k - (k % 5), 1.0 + k % 3) for k in range(40)]
    df = spark.createDataFrame(rows, "x double, y double, z double, w double")
    assert np.allclose(learn.weighted_regression(df, ["x", "y"], "z", "w"), [3, 2, -1], atol=1e-3)
    assert learn.weighted_regression(df.limit(5), ["x"], "z", "w") is None


def test_distances_and_factors_of_nothing(spark):
    df = spark.sql("SELECT cast(null as double) AS a, 59.91D AS la, 10.75D AS lo, 60.39D AS lb, 5.32D AS lp")
    row = df.select(geo.haversine(F.col("a"), F.col("lo"), F.col("lb"), F.col("lp")).alias("none"), geo.haversine(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp")).alias("far"), geo.haversine(F.col("la"), F.col("lo"), F.col("la"), F.col("lo")).alias("zero")).head()
    assert row.none is None and abs(row.far - 305_000) < 20_000 and row.zero == 0
    edges = spark.createDataFrame([(1, 2, 10, 100)], SCHEMA)
    delays = spark.createDataFrame([(3, 4, 2.0, 0)], "src bigint, dst bigint, factor double, updated_ms bigint")
    assert live.applied(edges, delays, 0).head().dur == 10.0


def test_soft_weight_bounds(spark):
    w = lambda c: spark.range(1).select(evaluate.soft_weight(F.lit(c), F.lit(100.0), F.lit(100.0)).alias("w")).head().w
    assert (w(0.0), w(200.0), w(1e9)) == (10.0, 1000.0, 1e5)
