import gzip
import json
import math
import struct

from roadspark.sources import files


def test_edge_list(spark, tmp_path):
    with gzip.open(f"{tmp_path}/g.txt.gz", "wt") as f:
        f.write("# comment\n10\t20\n20 5\n\nbad\n10 5\n")
    out = files.edge_list(spark, f"{tmp_path}/g.txt.gz").collect()
    assert {(r.src, r.dst) for r in out} == {(1, 2), (2, 0), (1, 0)}


def test_solomon(spark, tmp_path):
    (tmp_path / "c.txt").write_text("C101\n\nVEHICLE\nNUMBER CAPACITY\n 25 200\n\nCUST NO. XCOORD\n\n 0 40 50 0 0 1236 0\n 1 45 68 10 912 967 90\n")
    out = files.solomon(spark, f"{tmp_path}/c.txt").orderBy("i").collect()
    assert [(r.i, r.demand, r.due) for r in out] == [(0, 0.0, 1236.0), (1, 10.0, 967.0)]


def test_problem(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"jobs": [{"id": 1, "location": [10.5, 59.9], "time_windows": [[0, 9]], "delivery": [3]}, {"id": 2}], "vehicles": [{"id": 7, "start": [10, 59], "capacity": [5], "time_window": [0, 99]}, {"id": 8}]}))
    jobs, vehicles = files.problem(spark, f"{tmp_path}/p.json")
    j = {r.job: r for r in jobs.collect()}
    assert (j[1].lon, j[1].lat, j[1].service, j[1].prize) == (10.5, 59.9, 0, 1e9) and tuple(j[1].windows[0]) == (0, 9) and j[2].windows == [] and j[2].delivery == []
    v = {r.vehicle: r for r in vehicles.collect()}
    assert v[7].end_lat == 59.0 and v[7].shift_end == 99 and v[8].profile == "car" and v[8].per_hour == 3600.0 and v[8].shift_end == files.FOREVER


def test_solution(spark):
    routes = spark.createDataFrame([(1, 5, 10.0, 7, 70)], "plan int, route_id bigint, cost double, travel_s bigint, distance bigint")
    steps = spark.createDataFrame([(1, 5, 2, "job", 9, 4), (1, 5, 1, "start", None, 0)], "plan int, route_id bigint, seq bigint, kind string, job bigint, arrival bigint")
    left = spark.createDataFrame([(1, 3, "skills")], "plan int, job bigint, reason string")
    doc = json.loads(files.solution(routes, steps, left).head().document)
    assert doc["code"] == 1 and doc["summary"]["cost"] == 10.0 and [s["type"] for s in doc["routes"][0]["steps"]] == ["start", "job"] and doc["unassigned"][0]["id"] == 3


def test_generated(spark):
    assert files.grid_graph(spark, 4).count() == 48
    assert files.random_graph(spark, 50, 3).where("dur < 1 OR dur > 100 OR src = dst").count() == 0
    jobs = files.generated_jobs(spark, 59.9, 10.7, 5, 40).collect()
    assert len(jobs) == 40 and all(abs(r.lat - 59.9) < 0.05 for r in jobs) and jobs == files.generated_jobs(spark, 59.9, 10.7, 5, 40).collect()


def test_heights(spark):
    tile = struct.pack(">9h", 0, 10, 20, 30, 40, 50, 60, 70, -32768)
    nodes = spark.createDataFrame([(1, 59.75, 10.25), (2, 59.1, 10.9), (3, 58.5, 10.5)], "node bigint, lat double, lon double")
    tiles = spark.createDataFrame([(59, 10, tile)], "lat0 int, lon0 int, content binary")
    out = {r.node: r.height for r in files.heights(nodes, tiles).collect()}
    assert math.isclose(out[1], 20.0) and out[2] is None and 3 not in out
