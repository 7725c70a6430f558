"""Sources, graphs, matrices and searches against enumeration, plain simulation or round trips."""

import itertools
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadspark import __main__ as cli
from roadspark import api
from roadspark.operators import broker, constraints, evaluate, geocode, learn, matching, matrix, paths, search, trip
from roadspark.plans import queries
from roadspark.plans.workload import fixture
from roadspark.sources import more, osm
from roadspark.streaming import live

# --- extracts ---


def number(x):
    out = bytearray()
    while True:
        out.append(x & 127 | (128 if x > 127 else 0))
        x >>= 7
        if not x:
            return bytes(out)


def zigzag(x):
    return x * 2 if x >= 0 else -x * 2 - 1


def field(k, value):
    return number(k << 3 | 2) + number(len(value)) + value if isinstance(value, bytes) else number(k << 3) + number(value)


def steps(xs):
    return b"".join(number(zigzag(b - a)) for a, b in zip([0, *xs], xs))


def extract(path, nodes, ways, raw=False):
    """Writes a file of one header and one block a call of nodes (dense, the first plainly) and ways."""
    words = [""] + sorted({w for *_, tags in nodes + ways for kv in tags.items() for w in kv})
    at = {w: k for k, w in enumerate(words)}
    table = b"".join(field(1, w.encode()) for w in words)
    scale = lambda x: round(x * 1e7)
    first, dense = nodes[0], nodes[1:]
    plain = field(1, zigzag(first[0])) + field(2, b"".join(number(at[k]) for k in first[3])) + field(3, b"".join(number(at[v]) for v in first[3].values())) + field(8, zigzag(scale(first[1]))) + field(9, zigzag(scale(first[2])))
    keys = b"".join(b"".join(number(at[k]) + number(at[v]) for k, v in tags.items()) + number(0) for *_, tags in dense)
    packed = field(1, steps([n for n, *_ in dense])) + field(8, steps([scale(y) for _, y, _, _ in dense])) + field(9, steps([scale(x) for _, _, x, _ in dense])) + field(10, keys)
    lines = b"".join(field(3, field(1, w) + field(2, b"".join(number(at[k]) for k in tags)) + field(3, b"".join(number(at[v]) for v in tags.values())) + field(8, steps(refs))) for w, refs, tags in ways)
    block = field(1, table) + field(2, field(1, plain) + field(2, packed)) + field(2, lines)
    out = b""
    for kind, body in (("OSMHeader", b""), ("OSMData", block)):
        blob = field(1, body) if raw else field(2, len(body)) + field(3, zlib.compress(body))
        head = field(1, kind.encode()) + field(3, len(blob))
        out += struct.pack(">I", len(head)) + head + blob
    path.write_bytes(out)


NODES = [(1, 59.0, 10.0, {}), (2, 59.001, 10.0, {}), (3, 59.002, 10.001, {"addr:housenumber": "4081;4083", "addr:street": "Storgata"}), (-9, -33.5, -70.25, {}), (7, 59.003, 10.002, {})]
WAYS = [(10, [1, 2, 3], {"highway": "residential", "name": "Storgata"}), (11, [3, 7], {"highway": "motorway"}), (12, [1, 7], {"building": "yes"})]


@pytest.mark.parametrize("raw", [False, True])
def test_extract_round_trip(spark, tmp_path, raw):
    extract(tmp_path / "a.osm.pbf", NODES, WAYS, raw)
    nodes, ways = osm.parsed(spark, [str(tmp_path / "a.osm.pbf")])
    assert {(r.node, round(r.lat, 7), round(r.lon, 7), tuple(r.tags.items())) for r in nodes.collect()} == {(n, y, x, tuple(t.items())) for n, y, x, t in NODES}
    assert sorted((r.way, r.refs, r.tags) for r in ways.collect()) == WAYS


def test_build_and_command_line(spark, tmp_path, capsys):
    extract(tmp_path / "a.osm.pbf", NODES, WAYS)
    folder = str(tmp_path / "tables")
    cli.main(["build", str(tmp_path / "a.osm.pbf"), folder], spark)
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1]) == {"edges": 5}  # two legs both ways, one of a motorway
    made = osm.newest(spark, f"{folder}/edges/_SUCCESS")
    cli.main(["build", str(tmp_path / "a.osm.pbf"), folder], spark)
    assert osm.newest(spark, f"{folder}/edges/_SUCCESS") == made  # kept tables are used again
    capsys.readouterr()
    cli.main(["route", folder, "59.0", "10.0", "59.003", "10.002"], spark)
    found = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    assert (found["src"], found["dst"]) == (1, 7) and len(found["geometry"]) == 4 and found["metres"] > 300
    cli.main(["geocode", folder, "storg"], spark)
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["node"] == 1
    cli.main(["reverse", folder, "59.002", "10.001"], spark)
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["addr_id"] == 3


# --- small sources ---


def test_small_sources(spark, tmp_path):
    sizes = [0, 1, 1023, 1024, 1536, 1048576, 5 * 1024**3]
    words = [r.w for r in spark.createDataFrame([(x,) for x in sizes], "x long").select(more.bytes_in_words(F.col("x")).alias("w")).collect()]
    assert words == ["0 B", "1 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "5.0 GB"]
    (tmp_path / "s.json").write_text(json.dumps({"code": 0, "routes": [{"vehicle": 4, "steps": [{"type": "start"}, {"type": "job", "job": 2}, {"type": "job", "location_index": 7}, {"type": "job", "location_index": 7}, {"type": "job", "job": 99}]}, {"vehicle": 5, "steps": [{"type": "job", "job": 2}]}]}))
    jobs = spark.createDataFrame([(1, 7), (2, 3), (3, 7), (4, 7)], "job long, location_index int")
    assert {(r.route_id, r.seq, r.job) for r in more.warm_start(spark, str(tmp_path / "s.json"), jobs).collect()} == {(4, 1, 2), (4, 2, 1), (4, 3, 3)}
    (tmp_path / "p.jsonl").write_text('{"id": 1, "features": [0.5, 1], "config": {"k": 2}, "cost": 3}\n{"id": 2}\n')
    assert [(r.id, r.features, r.config) for r in more.patterns(spark, str(tmp_path / "p.jsonl")).collect()] == [(1, [0.5, 1.0], {"k": 2.0})]
    sites = spark.createDataFrame([(1, 59.0, 10.0), (2, 59.1, 10.0)], "place long, lat double, lon double")
    own = spark.createDataFrame([(1, 2, 5)], "i long, j long, dur long")
    cars = spark.createDataFrame([(2, "bike"), (1, "car")], "vehicle long, profile string")
    assert more.chosen_matrix(cars, {"car": own}, sites).count() == 1 and more.chosen_matrix(cars, {"bike": own}, sites).count() == 4


def test_word_ladder_and_cube(spark):
    words = ["cold", "cord", "card", "ward", "warm", "word", "cat"]
    got = {(r.src, r.dst) for r in more.word_ladder(spark.createDataFrame(list(enumerate(words)), "id long, word string")).collect()}
    near = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
    assert got == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)}
    solved = (tuple(range(7)), (0,) * 7)
    for face in more.TURNS:  # four quarter turns are none
        state = solved
        for _ in range(4):
            state = more.turned(*state, face)
        assert state == solved
    seen, edge = {solved}, [solved]
    counts = [1]
    for _ in range(5):  # half turns count as two: known numbers of positions by quarter turns
        edge = [t for s in edge for f in more.TURNS for n in (1, 3) for t in [_turn(s, f, n)] if t not in seen and not seen.add(t)]
        counts.append(len(edge))
    assert counts == [1, 6, 27, 120, 534, 2256]
    some = more.pocket_cube(spark, 1)
    own = more.cube_number(*solved)
    assert {r.dst for r in some.where(f"src = {own}").collect()} == {r.src for r in some.where(f"dst = {own}").collect()} == {more.cube_number(*more.turned(*solved, f)) for f in more.TURNS}
    assert some.select("src").union(some.select("dst")).distinct().count() > 3**6


def _turn(state, face, times):
    for _ in range(times):
        state = more.turned(*state, face)
    return state


# --- graphs ---


def grid(spark):
    return spark.createDataFrame([(a, b, 1 + (a * 7 + b * 3) % 9, 10) for a in range(30) for b in (a + 1, a + 6, a - 1) if 0 <= b < 30], "src long, dst long, dur long, dist long")


def floyd(rows, n):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for r in rows:
        d[r.src, r.dst] = min(d[r.src, r.dst], r.dur)
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    return d


def test_alternatives_both_forms(spark, monkeypatch):
    e = grid(spark)
    d = floyd(e.collect(), 30)
    legs = {(r.src, r.dst): r.dur for r in e.collect()}
    pairs = spark.createDataFrame([(0, 29), (5, 20), (29, 0), (3, 3)], "src long, dst long")
    one = paths.alternatives(e, pairs).collect()
    monkeypatch.setattr(paths, "BROADCAST_EDGES", 1)
    assert sorted(map(str, paths.alternatives(e, pairs).collect())) == sorted(map(str, one))
    assert {(r.src, r.dst, r.dur) for r in paths.distance(e, pairs).collect()} == {(a, b, int(d[a, b])) for a, b in ((0, 29), (5, 20), (29, 0), (3, 3))}
    for r in one:
        assert r.dur == sum(legs[x] for x in zip(r.nodes, r.nodes[1:])) <= 1.25 * d[r.src, r.dst] and len(set(r.nodes)) == len(r.nodes)
        assert r["rank"] > 0 or r.dur == d[r.src, r.dst]
        for other in one:
            if (other.src, other.dst) == (r.src, r.dst) and other["rank"] < r["rank"]:
                assert sum(legs[x] for x in zip(r.nodes, r.nodes[1:]) if x in set(zip(other.nodes, other.nodes[1:]))) <= 0.6 * r.dur
    assert len(one) > 4


def test_blocks_of_a_matrix(spark):
    e = grid(spark)
    parts = list(paths.matrix_blocks(e, spark.range(30).withColumnRenamed("id", "source"), 30 * 32 * 8))
    assert len(parts) >= 4
    d = floyd(e.collect(), 30)
    rows = [r for _, part in parts for r in part.collect()]
    assert {(r.src, r.dst): r.dur for r in rows} == {(a, b): int(d[a, b]) for a in range(30) for b in range(30)}


def test_isochrones_snaps_and_matching(spark, small):
    e, n = fixture(spark, small, "edges"), fixture(spark, small, "nodes")
    names = sorted({r.src for r in e.collect()} | {r.dst for r in e.collect()})
    place = {x: k for k, x in enumerate(names)}
    d = floyd([type("E", (), {"src": place[r.src], "dst": place[r.dst], "dur": r.dur}) for r in e.collect()], len(names))
    at = {r.node: (r.lat, r.lon) for r in n.collect()}
    want = set()
    for s in (r.source for r in queries.starts(spark, small).collect()):
        for x in names:
            if x in at and s in place:
                for c in (60, 120, 180):
                    if d[place[s], place[x]] <= c:
                        r0, c0 = (int(np.floor(v / 0.002)) for v in at[x])
                        want |= {(s, c, r0 + a, c0 + b) for a in (-1, 0, 1) for b in (-1, 0, 1)}
    assert {tuple(r) for r in queries.isochrone_cells(spark, small).select("source", "contour", "r", "c").collect()} == want
    for r in queries.snapped_routes(spark, small).collect():
        if r.dur is not None:
            assert r.dur == d[place[r.src], place[r.dst]] and [tuple(p) for p in (r.geometry[0], r.geometry[-1])] == [at[r.src], at[r.dst]]
    pings = spark.createDataFrame([(1, k, at[x][0] + 1e-4, at[x][1] - 1e-4) for k, x in enumerate((1, 2, 3, 10, 11))], "trace_id long, seq long, lat double, lon double")
    got = {r.seq: r.node for r in matching.matched(pings, n, e, 2, 40.0).collect()}
    assert [got[k] for k in range(5)] == [1, 2, 3, 10, 11]


# --- trips, trees, landmarks ---


def test_trip_orders_against_all(spark, small):
    s = {}
    for r in fixture(spark, small, "stops").collect():
        s.setdefault(r.route_id, {})[r.seq - 1] = (r.lat, r.lon)
    got = {}
    for r in queries.trip_order(spark, small).collect():
        got.setdefault(r.trip, []).append((r.position, r.stop, r.total))
    assert set(got) == set(s)

    def seconds(a, b):
        p, q = np.radians(a), np.radians(b)
        h = np.sin((q[0] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(q[0]) * np.sin((q[1] - p[1]) / 2) ** 2
        return float(np.floor(12742000 * np.arcsin(np.sqrt(min(1, h))) * 1.3 / 13.9 + 0.5))

    for route, points in s.items():
        order = [x for _, x, _ in sorted(got[route])]
        n, total = len(points), got[route][0][2]
        legs = {(a, b): 0.0 if a == b else seconds(points[a], points[b]) for a in points for b in points}
        cost = lambda o: sum(legs[x] for x in zip(o, (*o[1:], o[0])))  # noqa: B023, E731
        assert sorted(order) == list(range(n)) and abs(total - cost(order)) <= n
        if n <= 7:
            assert total <= min(cost((0, *o)) for o in itertools.permutations(range(1, n))) + n
        rnd = np.random.default_rng(route)
        assert total <= min(cost(tuple(rnd.permutation(n))) for _ in range(20)) + n
    d = np.random.default_rng(5).integers(1, 90, (8, 8)).astype(float)
    for closed in (True, False):
        order = trip.best_order(d, closed)
        options = [(0, *o) for o in itertools.permutations(range(1, 8))] if closed else [(0, *o, 7) for o in itertools.permutations(range(1, 7))]
        assert trip.tour_cost(d, order, closed) == min(trip.tour_cost(d, list(o), closed) for o in options)


def test_landmarks_against_arrays(spark, small):
    rows = queries.blocks(spark, small).where("block = 0").collect()
    sides = sorted({r.i for r in rows})
    d = np.zeros((len(sides), len(sides)))
    for r in rows:
        d[sides.index(r.i), sides.index(r.j)] = r.dur
    for query, both in ((queries.farthest_landmarks, np.maximum(d, d.T)), (queries.broker_landmarks, np.floor((d + d.T) / 2))):
        chosen = [int(both.max(axis=1).argmax())]
        while len(chosen) < 8:
            near = both[:, chosen].min(axis=1)
            near[chosen] = -1
            chosen.append(int(near.argmax()))
        assert [r.l for r in sorted(query(spark, small).where("block = 0").collect(), key=lambda r: r["rank"])] == [sides[k] for k in chosen]
    picked, n = [], len(sides)
    for _ in range(4):
        cost = lambda l: sum(min(d[i, x] + d[x, j] for x in [*picked, l]) for i in range(n) for j in range(n) if i != j)  # noqa: B023, E731, E741
        picked.append(min((l for l in range(n) if l not in picked), key=lambda l: (cost(l), l)))  # noqa: E741
    got = sorted(matrix.pivot_landmarks(queries.blocks(spark, small).where("block = 0"), 4, 1 << 20).collect(), key=lambda r: r["rank"])
    assert [r.l for r in got] == [sides[k] for k in picked]


def test_trees_medians_and_proximity(spark, small):
    s = fixture(spark, small, "stops").select("grp", "job", "lat", "lon").collect()
    for r in queries.spanning_tree_kurtosis(spark, small).collect():
        points = [(x.lat, x.lon) for x in sorted((x for x in s if x.grp == r.grp), key=lambda x: x.job)]
        points = np.array(points[:: -(-len(points) // learn.MST_SAMPLE)])
        far = sorted((float(np.hypot(*(points[a] - points[b]))), a, b) for a in range(len(points)) for b in range(a))
        root, edges = list(range(len(points))), []
        for w, a, b in far:  # Kruskal, where the operator grows a tree
            x, y = root[a], root[b]
            if x != y:
                edges.append(w)
                root = [x if k == y else k for k in root]
        e = np.array(edges)
        assert r.edges == len(points) - 1 and abs(r.kurtosis - (((e - e.mean()) ** 4).mean() / ((e - e.mean()) ** 2).mean() ** 2 - 3)) < 1e-6


def test_folded_routes_against_a_plain_walk(spark, small):
    legs = {}
    for r in evaluate.legs(fixture(spark, small, "stops"), fixture(spark, small, "depots")).collect():
        legs.setdefault(r.route_id, []).append(r)
    got = {(r.route_id, r.seq): r for r in queries.route_fold_breaks(spark, small).collect()}
    for route, rows in legs.items():
        clock, pending = 0, [(900, 7200)]
        for r in sorted(rows, key=lambda r: r.seq):
            clock += r.leg_s + r.setup_s
            windows = [(r.ready, r.ready + 600), (r.ready + 3000, r.due)]
            fit = [w for w in windows if w[1] >= clock]
            late = 0 if fit else clock - max(w[1] for w in windows)
            wait = max(0, fit[0][0] - clock) if fit else 0
            clock += wait
            g = got[route, r.seq]
            assert (g.arrival, g.wait_s, g.lateness) == (clock, wait, late)
            clock += r.service
            while pending and pending[0][1] <= clock:
                clock += pending.pop(0)[0]


def test_searched_plans_on_few_stops(spark, small):
    stops = {}
    for r in queries.plans_of(spark, small).collect():
        stops.setdefault(r.problem, {})[r.i] = r
    for query in (queries.multi_start_plans, queries.cluster_plans):
        for r in query(spark, small).collect():
            own = stops[r.problem]
            served = [k for x in r.routes for k in x]
            assert len(served) == len(set(served)) == len(own) - 1 - r.unserved
            assert all(sum(own[k].demand for k in x) <= 400 for x in r.routes)
            if r.unserved == 0 and len(own) <= 6 and query is queries.multi_start_plans:
                import pandas as pd

                p = search.Problem.of(pd.DataFrame([x.asDict() for x in own.values()]), 400.0, 6)
                whole = list(range(1, p.n))
                if p.demand.sum() <= 400:
                    assert r.cost <= search.exact_route(p, whole)[0] + 1e-6


# --- brokers, constraints, live, streets ---


def test_broker_loop(spark):
    n = 12
    prior = spark.createDataFrame([(i, j, abs(i - j) * 10) for i in range(n) for j in range(n)], "i long, j long, dur long")
    source = prior.withColumn("dur", F.col("dur") + F.when(F.col("i") == F.col("j"), 0).otherwise(4))
    marks, depot = spark.createDataFrame([(0,), (11,)], "l long"), spark.createDataFrame([(0,)], "l long")
    whole, known = broker.matrix(prior, source, marks, depot, policy=broker.Policy(derive=False))
    assert {r.how for r in whole.collect()} == {"zero", "bought"} and known.count() == n * (n - 1)
    few, known = broker.matrix(prior, source, marks, depot, policy=broker.Policy(granular=2, margin=1))
    kinds = {r.how: r["n"] for r in few.groupBy("how").agg(F.count("*").alias("n")).collect()}
    assert kinds["bought"] == known.count() < n * (n - 1) and kinds["derived"] == n * n - n - kinds["bought"]
    again, more_known = broker.matrix(prior, source.withColumn("dur", F.col("dur") + 100), marks, depot, known, broker.Policy(granular=2, margin=1))
    assert again.where("how = 'bought'").exceptAll(few.where("how = 'bought'")).isEmpty() and more_known.count() == known.count()  # nothing is bought twice
    capped, _ = broker.matrix(prior, source, marks, depot, policy=broker.Policy(granular=2, margin=1, budget=10))
    assert capped.where("how = 'bought'").count() == 10
    tiny, _ = broker.matrix(prior.where("i < 3 AND j < 3"), source, marks, depot, policy=broker.Policy(granular=2, margin=1))
    assert {r.how for r in tiny.collect()} == {"zero", "bought"}


def test_plan_options(spark):
    left = spark.createDataFrame([(1, 1, "job"), (1, 2, "pickup"), (1, 3, None), (2, 4, "delivery")], "plan_id long, job long, kind string")
    assert {(r.plan_id, r.jobs, r.penalty) for r in constraints.unassigned_cost(left, 3.0, 1).collect()} == {(1, 2, 6 + 1e12), (2, 0, 0.0)}
    jobs = spark.createDataFrame([(1, []), (2, [(0, 2**62)])], "job long, windows array<struct<start:bigint,end:bigint>>")
    assert not constraints.soft_by_default(jobs).head().soft
    assert constraints.soft_by_default(jobs.union(spark.createDataFrame([(3, [(0, 500)])], jobs.schema))).head().soft and not constraints.soft_by_default(jobs.where("false")).head().soft
    assert constraints.parse_dimensions([{"name": "fuel", "max": 9}])[0]["start"] == 0 and constraints.parse_dimensions(None) == []
    for bad in ([{"name": "a", "size": 1}], [{"max": 1}], [{"name": "a", "min": 2, "max": 1}], [{"name": "a"}, {"name": "a"}]):
        with pytest.raises(ValueError):
            constraints.parse_dimensions(bad)


def test_live_replay_and_base(spark):
    rng = np.random.default_rng(4)
    rows = [(1, 2, float(f), int(t)) for f, t in zip(rng.uniform(0.4, 3, 1500), rng.integers(0, 10**7, 1500))] + [(3, 4, 2.0, 5)]
    got = {(r.src, r.dst): (r.factor, r.updated_ms) for r in live.replayed(spark.createDataFrame(rows, "src long, dst long, factor double, ms long")).collect()}
    for key in ((1, 2), (3, 4)):
        factor, at = live.fold(None, [(t, f) for a, b, f, t in rows if (a, b) == key])
        assert abs(got[key][0] - factor) < 1e-9 and got[key][1] == at
    seen = spark.createDataFrame([(1, 2, 2.0), (5, 6, 4.0), (7, 8, 1.0)], "src long, dst long, factor double")
    snapshot = spark.createDataFrame([(1, 2, 1.5), (5, 6, 3.0)], "src long, dst long, applied double")
    assert {r.src: r.factor for r in live.against_base(seen, snapshot).collect()} == {1: 3.0, 5: 5.0, 7: 1.0}


def test_streets_by_parts_of_names(spark):
    streets = spark.createDataFrame([(1, "Østre gate"), (2, "Gate"), (3, "Vestre gate"), (4, "A")], "name_id long, street string")
    asked = spark.createDataFrame([("GATE",), ("tre g",), ("a",), ("ø",), ("xx",), ("",), (" vestre gate ",)], "query string")
    assert {r["query"]: r.name_id for r in geocode.find_street(streets, asked).collect()} == {"GATE": 2, "tre g": 1, "a": 4, "ø": 1, " vestre gate ": 3}


def test_archive(spark, tmp_path):
    rng = np.random.default_rng(6)
    xy = rng.uniform(0, 900, (30, 2))
    cells = spark.createDataFrame([(k // 15, k, m, int(np.hypot(*(xy[k] - xy[m])))) for k in range(30) for m in range(30) if k // 15 == m // 15], "block long, i long, j long, dur long")
    forms = more.archive(cells, str(tmp_path / "a")).collect()
    back = more.unarchived(spark, str(tmp_path / "a"))
    assert cells.exceptAll(back.select("block", "i", "j", F.col("dur").cast("long"))).isEmpty() and back.count() == cells.count()
    for block in (0, 1):
        own = [r for r in forms if r.block == block]
        assert sum(r.is_best for r in own) == 1 and min(own, key=lambda r: (r.bytes, r.form)).is_best


def test_solve(spark):
    rows = [(1, i, float(i), float(i % 3), 0.0 if i == 0 else 1.0, 0.0, 1e9, 0.0) for i in range(8)]
    problems = spark.createDataFrame(rows, "problem long, i long, x double, y double, demand double, ready double, due double, service double")
    for settings in (api.Settings(4.0, 3, 1, 1, 10), api.Settings(4.0, 3, kicks=1, cluster=4), api.Settings(4.0, 3, islands=2, rounds=1)):
        r = api.solve(problems, settings).head()
        assert r.unserved == 0 and sorted(k for x in r.routes for k in x) == list(range(1, 8))
