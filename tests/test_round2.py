"""Tests of the second round's findings."""

import os
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadspark.functions import geo
from roadspark.operators import isochrone, matrix, nearest, paths, propagate
from roadspark.plans import queries
from roadspark.plans.queries import QUERIES, SQL
from tests.oracle import same


@pytest.fixture()
def changed(small, tmp_path):
    """A folder of the small tables, some of them replaced: changed(orders=frame)."""

    def make(**tables):
        for name in os.listdir(small):
            if name.split(".")[0] not in tables:
                os.symlink(f"{small}/{name}", tmp_path / name)
        for name, df in tables.items():
            df.toPandas().to_parquet(tmp_path / f"{name}.parquet", coerce_timestamps="us")
        return str(tmp_path)

    return make


@pytest.mark.parametrize("name", ["route_walk", "route_walk_verdict"])
def test_walk_from_a_stop_at_the_depot(name, spark, small, changed):
    """Stops stand at their own depots, where the SQL counts setup all the same."""
    orders = spark.read.parquet(f"{small}/orders.parquet").withColumn("o_custkey", F.col("o_orderkey"))
    same(QUERIES[name], SQL[name], spark, changed(orders=orders))


def plain(rows, source, limit):
    """(dur, dist) by relaxation of all edges until nothing changes."""
    best, moved = {source: (0, 0)}, True
    while moved:
        moved = False
        for a, b, w, x in rows:
            if a in best and best[a][0] + w <= limit and (best[a][0] + w, best[a][1] + x) < best.get(b, (limit + 1, 0)):
                best[b], moved = (best[a][0] + w, best[a][1] + x), True
    return best


@pytest.mark.parametrize("cells", [1, 60, 4_000_000])
def test_bounded_matrix_in_blocks(cells, spark, monkeypatch):
    """Blocks of any size give what relaxation gives: zero durations, ties, loops, gaps in numbers, strange sources."""
    rng = np.random.default_rng(5)
    rows = [(int(a) * 3, int(b) * 3, int(w), int(x)) for a, b, w, x in zip(rng.integers(0, 60, 200), rng.integers(0, 60, 200), rng.integers(0, 9, 200), rng.integers(0, 4, 200))]
    best = {}
    for a, b, w, x in rows:
        if a != b:
            best[a, b] = min(best.get((a, b), (w, x)), (w, x))
    edges = pd.DataFrame([(a, b, *w) for (a, b), w in best.items()], columns=["src", "dst", "dur", "dist"])
    monkeypatch.setattr(paths, "CELLS", cells)
    sources = np.array([0, 3, 6, 9, 9, 1000, 177, 4])
    for limit in (0, 7, 100):
        found = [tuple(map(int, r)) for arrays in paths.Graph(edges).reached(sources, limit) for r in zip(*arrays)]
        want = {(int(s), n, d, m) for s in set(sources) for n, (d, m) in plain([(a, b, *w) for (a, b), w in best.items()], int(s), limit).items()}
        assert len(found) == len(want) and set(found) == want
    df = spark.createDataFrame(rows, "src bigint, dst bigint, dur bigint, dist bigint")
    got = paths.matrix(df, spark.createDataFrame([(0,), (6,), (6,), (None,), (1000,)], "source bigint"), limit=7).collect()
    want = {(s, n, d, m) for s in (0, 6, 1000) for n, (d, m) in plain([(a, b, *w) for (a, b), w in best.items()], s, 7).items()}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_shared_graph_is_small():
    """A graph that is sent to all tasks takes a few bytes an edge."""
    n = 100_000
    at = np.arange(n)
    edges = pd.DataFrame({"src": np.concatenate([at, at]), "dst": np.concatenate([at + 1, at + 7]), "dur": np.concatenate([at % 5000, at % 4000]), "dist": np.concatenate([at, at])})
    tracemalloc.start()
    graph = paths.Graph(edges)
    list(graph.search(5, limit=9000))
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 40 * 2 * n


def test_rings_of_areas_cut_by_batches(spark):
    """Areas that several batches hold, and several in one, have the rings that they have alone."""
    cells = [(s, c, r, k) for s in range(5) for c in (60, 120) for r in range(s + 2) for k in range(c // 20) if not (s == 3 and r == k == 1)]
    want = {(s, c, k): [(r * 0.5, x * 0.5) for r, x in ring] for s, c in {x[:2] for x in cells} for k, ring in enumerate(isochrone.trace({x[2:] for x in cells if x[:2] == (s, c)}))}
    df = spark.createDataFrame(cells, "source bigint, contour int, r bigint, c bigint").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for most in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        got = {(x.source, x.contour, x.ring): [(p.lat, p.lon) for p in x.corners] for x in isochrone.rings(df, 0.5).collect()}
        assert got == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_isochrones_shuffle_few_times(spark, small):
    """Cells of a source come from the task that holds its rows, and its rings from one that does."""
    plan = QUERIES["isochrone_rings"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(source") <= 2


def test_nearest_of_crowded_places(spark, monkeypatch):
    """Many sites and points of one place, of dense and of lone places, are found as by comparing all; of a place no more than k sites are kept."""
    rng = np.random.default_rng(2)
    spots = [(float(59.9 + a * 1e-4), float(10.7 + b * 1e-4)) for a, b in rng.integers(0, 30, (60, 2))] + [(-33.0, 151.0)]
    sites = [(k, *spots[int(j)]) for k, j in enumerate(rng.integers(0, len(spots), 900))]
    points = [(k, *spots[int(j)]) for k, j in enumerate(rng.integers(0, len(spots), 200))] + [(900, 0.0, 0.0), (901, None, 10.0)]
    kept, real = [], nearest.stored
    monkeypatch.setattr(nearest, "stored", lambda df, name: kept.append((name, df.count())) or real(df, name))
    for k in (1, 4):
        kept.clear()
        got = {}
        for r in nearest.nearest(spark.createDataFrame(points, "point bigint, lat double, lon double"), spark.createDataFrame(sites, "site bigint, lat double, lon double"), k).collect():
            got.setdefault(r.point, {})[r.rank] = r.site
        want = {p: {n + 1: s for n, (_, s) in enumerate(sorted((round(geo.haversine_py(lat, lon, a, b), 3), s) for s, a, b in sites)[:k])} for p, lat, lon in points if lat is not None}
        assert got == want
        assert dict(kept)["sites"] <= k * len(set(spots))


def test_ways_between_pairs(spark):
    """Only the ways asked for are found, each source's search ends with its last: no row of another node leaves a task."""
    rows = [(a, (a * 7 + k) % 40, 1 + (a * k) % 5, a + k) for a in range(40) for k in range(1, 3)]
    df = spark.createDataFrame(rows, "src bigint, dst bigint, dur bigint, dist bigint")
    pairs = [(a, b) for a in range(0, 40, 3) for b in (0, 5, a, 39, 1000)] + [(1000, 1000), (1000, 3), (None, 3)]
    best = {}
    for a, b, w, x in rows:
        if a != b:
            best[a, b] = min(best.get((a, b), (w, x)), (w, x))
    flat = [(a, b, *w) for (a, b), w in best.items()]
    want = {(a, b, *plain(flat, a, 10**6)[b]) for a, b in pairs if a is not None and b in plain(flat, a, 10**6)}
    got = paths.between(df, spark.createDataFrame(pairs + pairs, "src bigint, dst bigint")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_eligible_sums_without_pairs(spark):
    """Numbers by job are those of the pairs, with lists, doubles, empty lists and nulls; plans join no job with all its vehicles."""
    jobs = [(k, [k % 3] if k % 4 else [], None if k % 5 else [k % 7, k % 7, 3, None], [k % 9]) for k in range(60)] + [(61, [0], [], [1]), (62, [9], None, [1]), (5, [1], None, [2])]
    fleet = [(k, [k % 3, 5], [k % 6]) for k in range(9)] + [(3, [0, 1], [8])]
    j = spark.createDataFrame(jobs, "job bigint, skills array<int>, allowed array<bigint>, amount array<bigint>")
    v = spark.createDataFrame(fleet, "vehicle bigint, skills array<int>, capacity array<bigint>")
    want = {}
    for r in propagate.eligible(j, v).collect():
        want.setdefault(r.job, []).append(r.vehicle)
    got = {r.job: (r.vehicles, r.first, r.total) for r in propagate.eligible_sums(j, v).collect()}
    assert got == {k: (len(x), min(x), sum(x)) for k, x in want.items()} and len(got) > 20


@pytest.mark.parametrize("name", ["job_eligibility", "unassigned_reason"])
def test_eligibility_makes_no_pairs(name, spark, small, monkeypatch):
    """The registered queries never join all jobs with all vehicles that fit."""
    monkeypatch.setattr(propagate, "eligible", None)
    assert QUERIES[name](spark, small).count() > 0


def test_cells_are_never_broadcast(spark, small, monkeypatch):
    """Tables that grow with the cells are joined by sorting, although their files are few bytes."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    cells, plans, real = queries.blocks(spark, small), {}, matrix.stored
    monkeypatch.setattr(matrix, "stored", lambda df, name: plans.setdefault(name, plan(df)) and real(df, name))
    matrix.farthest_landmarks(cells, 2)
    assert plans["far"].count("SortMergeJoin") >= 1
    kept = real(cells, "cells")
    assert plan(matrix.rank_one(kept.select("i", "j", "dur"), kept.select(F.col("i").alias("place"), F.lit(1).alias("cluster")).distinct())).count("SortMergeJoin") >= 2


def test_hub_labels_are_short_and_whole(spark):
    """Labels of random graphs tell every distance up to the limit, and backward labels reach no farther than half of it."""
    rng = np.random.default_rng(9)
    rows = [(int(a), int(b), int(w), int(x)) for a, b, w, x in zip(rng.integers(0, 30, 80), rng.integers(0, 30, 80), rng.integers(0, 12, 80), rng.integers(0, 4, 80)) if a != b]
    df = spark.createDataFrame(rows, "src bigint, dst bigint, dur bigint, dist bigint")
    for limit in (1, 15):
        forward, backward = paths.hub_labels(df, limit)
        assert max(r.dur for r in backward.collect()) <= limit - limit // 2 and max(r.dur for r in forward.collect()) <= limit
        nodes = {r[0] for r in rows} | {r[1] for r in rows}
        want = {(s, n, d, m) for s in nodes for n, (d, m) in plain(rows, s, limit).items()}
        assert {tuple(r) for r in paths.via_hubs(forward, backward, limit).collect()} == want
