"""Shortest paths and what follows from them, over edges(src, dst, dur, dist).

Two physical forms give the same answers. Frontier relaxation is a loop of joins: only nodes whose distance
fell in the last round are joined with the edges, and every few rounds a table in the shared folder ends the lineage; it holds
for any graph. Where the edges are few enough to be broadcast (a checked bound), sources are spread over tasks, and
each runs a heap search over arrays: no shuffle at all, and one pass for any number of sources.

Distance is carried along the path of least duration, never minimised itself; ties go to the smaller distance,
then to the smaller predecessor. Null ends or durations are no edge; negative durations are an error.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from functools import cached_property
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..plans.lineage import discarded, spread, spread_join, stored

BROADCAST_EDGES = 4_000_000
BATCH_ROWS = 50_000
#: Pairs of a source and a node that a task holds at a time, and more than any weight.
CELLS, FAR = 4_000_000, 2**62
#: Rounds of relaxation between two tables.
HOPS = 3
MATRIX = "src long, dst long, dur long, dist long"


def clean(edges: DataFrame) -> DataFrame:
    """One edge a pair of nodes, the fastest, without loops."""
    rows = edges.where("src IS NOT NULL AND dst IS NOT NULL AND dur IS NOT NULL AND src <> dst")
    return rows.groupBy("src", "dst").agg(F.min(F.struct("dur", "dist")).alias("w")).select("src", "dst", "w.dur", "w.dist")


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dur", "dist")


def reach(edges: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """source, node, dur, dist and parent of all that sources(source) reach, within limit seconds, by frontier relaxation."""
    edges = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.col("dur").alias("step_s"), F.col("dist").alias("step_m"))
    start = sources.select("source", F.col("source").alias("node"), F.lit(0).cast("bigint").alias("dur"), F.lit(0).cast("bigint").alias("dist"), F.lit(None).cast("bigint").alias("parent"))
    best = start.distinct().withColumn("fresh", F.lit(True))

    def relaxed(best: DataFrame) -> DataFrame:
        step = best.where("fresh").join(edges, "node").select("source", F.col("next").alias("node"), (F.col("dur") + F.col("step_s")).alias("dur"), (F.col("dist") + F.col("step_m")).alias("dist"), F.col("node").alias("parent"))
        if limit is not None:
            step = step.where(F.col("dur") <= limit)
        both = best.withColumn("old", F.lit(True)).unionByName(step.withColumns({"fresh": F.lit(True), "old": F.lit(False)}))
        key = F.struct("dur", "dist", F.coalesce("parent", F.lit(-1)).alias("p"), (~F.col("old")).alias("new"))
        found = both.groupBy("source", "node").agg(F.min(key).alias("k"))
        return found.select("source", "node", "k.dur", "k.dist", F.when(F.col("k.p") >= 0, F.col("k.p")).alias("parent"), F.col("k.new").alias("fresh"))

    while True:
        for _ in range(HOPS):
            best = relaxed(best)
        best = stored(best, "reach")
        if best.where("fresh").isEmpty():
            return best.drop("fresh")


class Graph:
    """Forward arrays of a graph whose edges were checked to be few; they take 20 bytes an edge where numbers are small."""

    def __init__(self, edges: pd.DataFrame | dict):
        src, dst, dur = (np.asarray(edges[c]) for c in ("src", "dst", "dur"))
        dist = np.asarray(edges["dist"].fillna(0) if isinstance(edges, pd.DataFrame) else edges["dist"])
        if len(dur) and dur.min() < 0:
            raise ValueError("a negative duration")
        self.names = np.unique(np.concatenate([np.unique(src), np.unique(dst)])).astype(np.int64)
        self._from(np.searchsorted(self.names, src).astype(np.int32), np.searchsorted(self.names, dst).astype(np.int32), dur, dist)

    def _from(self, src: np.ndarray, dst: np.ndarray, dur: np.ndarray, dist: np.ndarray) -> None:
        order = np.lexsort((dst, src))
        self.head = np.searchsorted(src[order], np.arange(len(self.names) + 1)).astype(np.int32)
        self.to, self.dur, self.dist = dst[order], narrow(dur[order]), narrow(dist[order])

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("names", "head", "to", "dur", "dist")}

    @cached_property
    def _fast(self) -> tuple:
        """Views that give plain numbers."""
        return tuple(memoryview(np.ascontiguousarray(x)) for x in (self.names, self.head, self.to, self.dur, self.dist))

    @cached_property
    def back(self) -> Graph:
        """The graph with every edge turned round."""
        out = Graph.__new__(Graph)
        out.names = self.names
        out._from(self.to, np.repeat(np.arange(len(self.names), dtype=np.int32), np.diff(self.head)), self.dur, self.dist)
        return out

    def at(self, node: int) -> int | None:
        """A node's place, or None."""
        names = self._fast[0]
        k = bisect_left(names, node)
        return k if k < len(names) and names[k] == node else None

    def ahead(self, node: int):
        """The nodes one edge ahead and the edges' durations."""
        names, head, to, dur, _ = self._fast
        at = self.at(node)
        if at is not None:
            for k in range(head[at], head[at + 1]):
                yield names[to[k]], dur[k]

    def search(self, source: int, limit: float = float("inf"), stop: int | None = None):
        """Settled (node, dur, dist, parent), nearest first."""
        start = self.at(source)
        if start is None:
            yield source, 0, 0, None
            return
        names, head, to, durs, dists = self._fast
        heap, done = [(0, 0, -1, start)], set()
        while heap:
            dur, dist, parent, node = heapq.heappop(heap)
            if node in done:
                continue
            done.add(node)
            yield names[node], dur, dist, None if parent < 0 else names[parent]
            if node == stop:
                return
            for k in range(head[node], head[node + 1]):
                far = dur + durs[k]
                if to[k] not in done and far <= limit:
                    heapq.heappush(heap, (far, dist + dists[k], node, to[k]))

    def region(self, starts: np.ndarray, limit: int) -> tuple[np.ndarray, int]:
        """The places that any of starts (places) reaches within limit, in order, and the rounds that took."""
        best = self._scratch[0]
        best[starts] = 0
        seen, front, rounds = [starts], starts, 0
        while len(front):
            e, count = _edges_of(self.head, front)
            far, to = np.repeat(best[front], count) + self.dur[e], self.to[e]
            keep = (far <= limit) & (far < best[to])
            to, far = to[keep], far[keep]
            np.minimum.at(best, to, far)
            front, rounds = np.unique(to), rounds + 1
            seen.append(front)
        found = np.unique(np.concatenate(seen))
        best[found] = FAR
        return found, rounds

    @cached_property
    def _scratch(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place the least duration, and its number in a region; as they were after each use."""
        return np.full(len(self.names), FAR, np.int64), np.full(len(self.names), -1, np.int32)

    def within(self, starts: np.ndarray, region: np.ndarray, limit: int):
        """Of each of starts (places) to each of region: weights in one array, row by row, FAR where limit is passed, the number that divides a weight into dur and dist, and the region's own edges (head, to, weights). None where such weights might not fit into 64 bits."""
        local = self._scratch[1]
        local[region] = np.arange(len(region), dtype=np.int32)
        e, count = _edges_of(self.head, region)
        to, at = local[self.to[e]], np.repeat(np.arange(len(region)), count)
        firsts = local[starts].astype(np.int64)
        local[region] = -1
        keep = to >= 0
        e, to, at = e[keep], to[keep].astype(np.int64), at[keep]
        unit = int(self.dist[e].max(initial=0)) * len(region) + 1  # more than any path's distance
        if (limit + int(self.dur[e].max(initial=0)) + 2) * unit >= FAR or self.dist[e].min(initial=0) < 0:
            return None
        weight = self.dur[e].astype(np.int64) * unit + self.dist[e]
        head, width = np.searchsorted(at, np.arange(len(region) + 1)), len(region)
        best, flag = np.full(len(starts) * width, FAR, np.int64), np.zeros(len(starts) * width, bool)
        front = np.arange(len(starts)) * width + firsts
        best[front] = 0
        while len(front):
            node = front % width
            e, count = _edges_of(head, node)
            far, cell = np.repeat(best[front], count) + weight[e], np.repeat(front - node, count) + to[e]
            keep = (far < best[cell]) & (far < (limit + 1) * unit)
            far, cell = far[keep], cell[keep]
            np.minimum.at(best, cell, far)
            flag[cell] = True
            front = np.flatnonzero(flag)
            flag[front] = False
        return best, unit, (head, to, weight)

    def blocks(self, starts: np.ndarray, limit: int):
        """starts (places, in order) in blocks that with their regions have CELLS cells at most, as (block, region, rounds); a single start may have more."""
        k, size = 0, 256
        while k < len(starts):
            block = starts[k : k + size]
            region, rounds = self.region(block, limit)
            if len(block) * len(region) > CELLS and len(block) > 1:
                size = max(1, min(len(block) // 2, CELLS // len(region)))
                continue
            yield block, region, rounds
            k += len(block)
            if 4 * len(block) * len(region) <= CELLS:
                size = min(2 * size, 4096)

    def reached(self, sources: np.ndarray, limit: int):
        """All that sources (nodes) reach within limit, in arrays src, dst, dur, dist."""
        sources = np.unique(sources)
        place = np.searchsorted(self.names, sources)
        known = np.isin(sources, self.names, assume_unique=True)
        strange = sources[~known]
        if len(strange):
            none = np.zeros(len(strange), np.int64)
            yield strange, strange, none, none
        for block, region, rounds in self.blocks(place[known], limit):
            found = self.within(block, region, limit) if rounds * 40 <= len(block) * len(region) else None
            if found is None:  # few cells or huge weights
                for at in block:
                    name = int(self.names[at])
                    rows = np.array([(n, d, m) for n, d, m, _ in self.search(name, limit)], np.int64)
                    yield np.full(len(rows), name), rows[:, 0], rows[:, 1], rows[:, 2]
                continue
            best, unit, _ = found
            cell = np.flatnonzero(best < FAR)
            yield self.names[block[cell // len(region)]], self.names[region[cell % len(region)]], best[cell] // unit, best[cell] % unit


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in 32 bits where they fit."""
    x = x.astype(np.int64, copy=False) if x.dtype.kind != "i" else x
    return x.astype(np.int32) if len(x) == 0 or -(2**31) <= x.min() and x.max() < 2**31 else x


def _edges_of(head: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all edges of nodes, node by node, and how many each has."""
    first = head[nodes].astype(np.int64)
    count = head[nodes + 1] - first
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count), count


def _arrays(df: DataFrame) -> list[np.ndarray]:
    """The whole-number columns of a table as arrays; they come to the driver as bytes, a few a batch of rows, not as rows."""

    def run(batches):
        for b in batches:
            cols = [narrow(c.fill_null(0).to_numpy(zero_copy_only=False)) for c in b.columns]
            if b.num_rows:
                yield pa.RecordBatch.from_pydict({f"c{k}": pa.array([bytes([c.itemsize]) + c.tobytes()], pa.binary()) for k, c in enumerate(cols)})

    names = [f"c{k}" for k in range(len(df.columns))]
    rows = df.select([F.col(c).cast("bigint") for c in df.columns]).mapInArrow(run, ", ".join(f"{c} binary" for c in names)).toArrow()
    read = lambda x: np.frombuffer(x.as_buffer(), f"i{x.as_buffer()[0]}", offset=1)
    out = []
    for c in names:
        out.append(np.concatenate([np.zeros(0, np.int32), *[read(x) for x in rows[c] if x.is_valid]]))
        rows = rows.drop_columns(c)
    return out


def _shared(edges: DataFrame):
    """The graph as a broadcast, or None where it is too large."""
    edges = stored(clean(edges).select("src", "dst", "dur", "dist"), "graph")
    if edges.count() > BROADCAST_EDGES:
        return None
    graph = Graph(dict(zip(edges.columns, _arrays(edges))))
    discarded(edges)
    return edges.sparkSession.sparkContext.broadcast(graph)


def matrix(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """src, dst, dur and dist between sources(source) and targets(target), or all nodes; unreachable pairs have no row."""
    graph = _shared(edges)
    if graph is None:
        found = reach(clean(edges), sources, limit).select(F.col("source").alias("src"), F.col("node").alias("dst"), "dur", "dist")
    else:

        def run(batches):
            for batch in batches:
                sources = batch.column(0).to_numpy(zero_copy_only=False)
                if limit is not None:
                    for arrays in graph.value.reached(sources, limit):
                        for k in range(0, len(arrays[0]), BATCH_ROWS):
                            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + BATCH_ROWS].astype(np.int64)) for x in arrays], names=["src", "dst", "dur", "dist"])
                    continue
                for source in sources.tolist():
                    found = graph.value.search(source)
                    while rows := list(islice(found, BATCH_ROWS)):
                        n, d, m, _ = zip(*rows)
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([source] * len(n), n, d, m)], names=["src", "dst", "dur", "dist"])

        own = sources.select(F.col("source").cast("bigint")).where("source IS NOT NULL").distinct()
        tasks = 2 * int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # neighbours by number are often neighbours on the road, and share their region
        found = own.repartitionByRange(tasks, "source").sortWithinPartitions("source").mapInArrow(run, MATRIX)
    if targets is not None:
        found = found.join(targets.select(F.col("target").alias("dst")).distinct(), "dst", "left_semi")
    return found.select("src", "dst", "dur", "dist")


def between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, dst, dur and dist of pairs(src, dst), each once; pairs without a way have no row. A source's search ends with its last target."""
    pairs = pairs.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    graph = _shared(edges)
    if graph is None:
        return matrix(edges, pairs.select(F.col("src").alias("source"))).join(pairs, ["src", "dst"], "left_semi")

    def run(batches):
        src, left, rows = None, set(), []

        def found():
            for n, d, m, _ in graph.value.search(src) if left else ():
                if n in left:
                    rows.append((src, n, d, m))
                    left.discard(n)
                    if not left:
                        return

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["src", "dst", "dur", "dist"])
            rows.clear()
            return made

        for b in batches:
            for a, to in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if a != src:
                    found()
                    src, left = a, set()
                    if len(rows) >= BATCH_ROWS:
                        yield batch()
                if to == a or graph.value.at(to) is not None:
                    left.add(to)
        found()
        if rows:
            yield batch()

    return spread(pairs, "src").sortWithinPartitions("src").mapInArrow(run, MATRIX)


def nearest_customers(edges: DataFrame, customers: DataFrame, k: int) -> DataFrame:
    """For each of customers(node) the k nearest others on the network: src, dst, rank, dur, dist.

    A source's search ends at its k-th neighbour. Ties go to the smaller node.
    """
    customers = customers.select(F.col("node").cast("bigint").alias("node")).distinct()
    graph = _shared(edges)
    order = Window.partitionBy("src").orderBy("dur", "dst")
    if graph is None or customers.limit(BROADCAST_EDGES + 1).count() > BROADCAST_EDGES:
        found = matrix(edges, customers.select(F.col("node").alias("source")), customers.select(F.col("node").alias("target"))).where("src <> dst")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("src", "dst", "rank", "dur", "dist")
    wanted = customers.sparkSession.sparkContext.broadcast(np.sort(_arrays(customers.where("node IS NOT NULL"))[0]))

    def run(frames):
        among = set(wanted.value.tolist())
        for pdf in frames:
            rows = []
            for source in pdf["node"].dropna().astype("int64").tolist():
                hits, last = [], None
                for n, d, m, _ in graph.value.search(source):
                    if last is not None and d > last:
                        break
                    if n != source and n in among:
                        hits.append((source, n, d, m))
                        if len(hits) == k:
                            last = d  # ties of the k-th may still come
                hits.sort(key=lambda x: (x[2], x[1]))
                rows += [(s, n, r + 1, d, m) for r, (s, n, d, m) in enumerate(hits[:k])]
            yield pd.DataFrame(rows, columns=["src", "dst", "rank", "dur", "dist"])

    return spread(customers, "node").mapInPandas(run, "src long, dst long, rank int, dur long, dist long")


def via_hubs(forward: DataFrame, backward: DataFrame, limit: int | None = None) -> DataFrame:
    """Many-to-many by hub labels: forward(src, hub, dur, dist) and backward(dst, hub, dur, dist), the best hub of each pair; ways longer than limit are left out before they are compared."""
    b = backward.select("hub", "dst", F.col("dur").alias("b_dur"), F.col("dist").alias("b_dist"))
    ways = forward.join(b, "hub")
    if limit is not None:
        ways = ways.where(F.col("dur") + F.col("b_dur") <= limit)
    pairs = ways.groupBy("src", "dst").agg(F.min(F.struct((F.col("dur") + F.col("b_dur")).alias("dur"), (F.col("dist") + F.col("b_dist")).alias("dist"))).alias("w"))
    return pairs.select("src", "dst", "w.dur", "w.dist")


def path(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The nodes of the fastest path of each of pairs(src, dst), as an array; null where there is none."""
    graph = _shared(edges)
    if graph is None:
        return _path_by_joins(clean(edges), pairs)

    def run(frames):
        for pdf in frames:
            out = []
            for src, dst in zip(pdf["src"], pdf["dst"]):
                parents, total, stop = {}, None, graph.value.at(int(dst))
                for n, d, m, p in graph.value.search(int(src), stop=stop) if stop is not None or src == dst else ():
                    parents[n] = p
                    if n == dst:
                        total = (d, m)
                nodes = None
                if total:
                    nodes, at = [], int(dst)
                    while at is not None:
                        nodes.append(at)
                        at = parents[at]
                    nodes.reverse()
                out.append((int(src), int(dst), nodes, *(total or (None, None))))
            frame = pd.DataFrame(out, columns=["src", "dst", "nodes", "dur", "dist"])
            yield frame.astype({"dur": "Int64", "dist": "Int64"})

    own = pairs.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).where("src IS NOT NULL AND dst IS NOT NULL")
    return spread(own, "src", "dst").mapInPandas(run, "src long, dst long, nodes array<long>, dur long, dist long")


def _path_by_joins(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Paths by following parents back, a node a round for all pairs."""
    tree = stored(reach(edges, pairs.select(F.col("src").alias("source")).distinct()), "tree")
    ends = tree.select(F.col("source").alias("src"), F.col("node").alias("dst"), "dur", "dist")
    walk = stored(pairs.select("src", "dst").distinct().join(ends, ["src", "dst"], "left").withColumns({"nodes": F.when(F.col("dur").isNotNull(), F.array("dst")), "at": F.when(F.col("dur").isNotNull(), F.col("dst"))}), "walk")
    back = tree.select(F.col("source").alias("src"), F.col("node").alias("at"), "parent")
    while not walk.where("at IS NOT NULL AND at <> src").isEmpty():
        step = walk.join(back, ["src", "at"], "left")
        walk = stored(step.select("src", "dst", "dur", "dist", F.when(F.col("parent").isNotNull(), F.array_prepend("nodes", F.col("parent"))).otherwise(F.col("nodes")).alias("nodes"), F.coalesce("parent", "at").alias("at")), "walk")
    return walk.select("src", "dst", "nodes", "dur", "dist")


def hub_labels(edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Labels forward(src, hub, dur, dist) and backward(dst, hub, dur, dist) that tell every distance up to limit by `via_hubs`.

    Of the nodes of a fastest path of at most the limit, the first that lies half the limit or more from its start
    (or else the path's end) is in both ends' labels: backward labels hold all within half the limit, forward labels
    all within that and one edge more, but for what lies beyond the limit.
    """
    edges = stored(clean(edges), "edges")
    nodes = edges.select(F.col("src").alias("source")).union(edges.select("dst")).distinct()
    half = limit // 2
    radius = min(limit, half + int(edges.agg(F.coalesce(F.max("dur"), F.lit(0))).head()[0]))
    forward = matrix(edges, nodes, limit=radius).select("src", F.col("dst").alias("hub"), "dur", "dist")
    backward = matrix(transpose(edges), nodes, limit=limit - half).select(F.col("src").alias("dst"), F.col("dst").alias("hub"), "dur", "dist")
    return forward, backward


def distance(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, dst and dur of pairs(src, dst) by searches from both ends that meet; null where there is no way."""
    graph = _shared(edges)
    if graph is None:
        return path(edges, pairs).select("src", "dst", "dur")

    def run(frames):
        for pdf in frames:
            out = [(int(a), int(b), meet(graph.value, graph.value.back, int(a), int(b))) for a, b in zip(pdf["src"], pdf["dst"])]
            yield pd.DataFrame(out, columns=["src", "dst", "dur"]).astype({"dur": "Int64"})

    own = pairs.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).where("src IS NOT NULL AND dst IS NOT NULL")
    return spread(own, "src", "dst").mapInPandas(run, "src long, dst long, dur long")


def meet(graph: Graph, back: Graph, a: int, b: int) -> int | None:
    """The least duration from a to b: both searches settle by turns, edges between what both have settled are ways, until their radii together reach the best way."""
    if a == b:
        return 0
    graphs, sides, seen, best, radius = (graph, back), (graph.search(a), back.search(b)), ({}, {}), None, [0, 0]
    live = [True, True]
    while live[0] and live[1] and (best is None or radius[0] + radius[1] < best):
        k = 0 if radius[0] <= radius[1] else 1
        step = next(sides[k], None)
        if step is None:
            live[k] = False  # this side has settled all it can reach
            continue
        node, dur = step[0], step[1]
        radius[k], seen[k][node] = dur, dur
        for far, w in graphs[k].ahead(node):
            if far in seen[1 - k]:
                total = dur + w + seen[1 - k][far]
                best = total if best is None else min(best, total)
    return best


def _ways(rows: list[tuple], src: int, dst: int, stretch: float, share: float, most: int) -> list[tuple]:
    """Of rows (node, dur from src, parent, dur to dst, next): the best path and up to `most` others, as (rank, nodes, dur)."""
    up = {n: (d, p) for n, d, p, _, _ in rows}
    down = {n: (d, p) for n, _, _, d, p in rows}
    if dst not in up:
        return []

    def chase(tree: dict, node):
        out = []
        while node is not None:
            out.append(node)
            node = tree[node][1]
        return out

    limit, taken = up[dst][0] * (1 + stretch), []
    for total, via in sorted((up[n][0] + down[n][0], n) for n in up):
        if total > limit or len(taken) > most:
            break
        nodes = chase(up, via)[::-1] + chase(down, via)[1:]
        if len(set(nodes)) < len(nodes):
            continue
        legs = {(a, b): up[b][0] - up[a][0] if up[b][1] == a else down[a][0] - down[b][0] for a, b in zip(nodes, nodes[1:])}
        if any(sum(w for e, w in legs.items() if e in other) > share * total for other, _, _ in taken):
            continue
        taken.append((legs, nodes, int(total)))
    return [(rank, nodes, total) for rank, (_, nodes, total) in enumerate(taken)]


WAYS = "src long, dst long, rank int, nodes array<long>, dur long"


def alternatives(edges: DataFrame, pairs: DataFrame, stretch: float = 0.25, share: float = 0.6, most: int = 3) -> DataFrame:
    """The best path of each pair and up to `most` others through a via node, not longer than 1 + stretch times the best, that share no more than `share` of their time with any taken before.

    Only nodes whose way from src and to dst together keeps within the stretch are looked at.
    """
    pairs = pairs.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).distinct()
    graph = _shared(edges)
    names = [c.split()[0] for c in WAYS.split(", ")]
    if graph is None:
        return _alternatives_by_joins(clean(edges), pairs, stretch, share, most)

    def run(frames):
        for pdf in frames:
            out = []
            for src, dst in zip(pdf["src"].tolist(), pdf["dst"].tolist()):
                best = meet(graph.value, graph.value.back, src, dst)
                if best is None:
                    continue
                down = {n: (d, p) for n, d, _, p in graph.value.back.search(dst, best * (1 + stretch))}
                rows = [(n, d, p, *down[n]) for n, d, _, p in graph.value.search(src, best * (1 + stretch)) if n in down and d + down[n][0] <= best * (1 + stretch)]
                out += [(src, dst, *way) for way in _ways(rows, src, dst, stretch, share, most)]
            yield pd.DataFrame(out, columns=names)

    return spread(pairs, "src", "dst").mapInPandas(run, WAYS)


def _alternatives_by_joins(edges: DataFrame, pairs: DataFrame, stretch: float, share: float, most: int) -> DataFrame:
    """alternatives() for graphs of any size: trees from both ends by joins, cut to what keeps within the stretch; a pair's rows meet in one group."""
    up = stored(reach(edges, pairs.select(F.col("src").alias("source")).distinct()), "up").select(F.col("source").alias("src"), "node", F.col("dur").alias("d1"), F.col("parent").alias("p1"))
    best = up.join(pairs.select("src", "dst", F.col("dst").alias("node")), ["src", "node"]).select("src", "dst", (F.col("d1") * (1 + stretch)).alias("most"))
    limit = best.agg(F.max("most")).head()[0]
    down = stored(reach(transpose(edges), best.select(F.col("dst").alias("source")).distinct(), limit), "down").select(F.col("source").alias("dst"), "node", F.col("dur").alias("d2"), F.col("parent").alias("p2"))
    rows = best.join(up, "src").where("d1 <= most").join(down, ["dst", "node"]).where("d1 + d2 <= most")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst = int(pdf["src"].iloc[0]), int(pdf["dst"].iloc[0])
        whole = lambda x: None if pd.isna(x) else int(x)
        rows = [(int(n), int(a), whole(p), int(b), whole(q)) for n, a, p, b, q in zip(pdf["node"], pdf["d1"], pdf["p1"], pdf["d2"], pdf["p2"])]
        return pd.DataFrame([(src, dst, *way) for way in _ways(rows, src, dst, stretch, share, most)], columns=[c.split()[0] for c in WAYS.split(", ")])

    return rows.select("src", "dst", "node", "d1", "p1", "d2", "p2").groupBy("src", "dst").applyInPandas(run, WAYS)


def snapped_route(trips: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For trips(trip, lat1, lon1, lat2, lon2): the nodes they snap to, the way's duration by its edges, its geometry and its length over the geometry; null where there is no way."""
    from .nearest import nearest

    ends = trips.select((F.col("trip") * 2).alias("point"), F.col("lat1").alias("lat"), F.col("lon1").alias("lon")).union(trips.select(F.col("trip") * 2 + 1, "lat2", "lon2"))
    snapped = nearest(ends, nodes.select(F.col("node").alias("site"), "lat", "lon")).select("point", "site")
    pairs = stored(trips.select("trip").join(snapped.select(F.floor(F.col("point") / 2).alias("trip"), F.col("site").alias("src")).where("point % 2 = 0"), "trip").join(snapped.select(F.floor(F.col("point") / 2).alias("trip"), F.col("site").alias("dst")).where("point % 2 = 1"), "trip"), "pairs")
    found = stored(path(edges, pairs.select("src", "dst").distinct()), "paths")
    steps = found.select("src", "dst", F.posexplode("nodes").alias("k", "node")).join(nodes.select("node", "lat", "lon"), "node")
    order = Window.partitionBy("src", "dst").orderBy("k")
    metres = haversine(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon"))
    lines = steps.withColumn("m", F.coalesce(metres, F.lit(0.0))).groupBy("src", "dst").agg(F.sum("m").alias("metres"), F.transform(F.sort_array(F.collect_list(F.struct("k", "lat", "lon"))), lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("geometry"))
    return pairs.join(found.select("src", "dst", "dur"), ["src", "dst"]).join(lines, ["src", "dst"], "left").select("trip", "src", "dst", "dur", F.when(F.col("dur").isNotNull(), F.col("metres")).alias("metres"), "geometry")


def matrix_blocks(edges: DataFrame, sources: DataFrame, budget_bytes: int, limit: int | None = None):
    """The matrix in blocks of sources whose rows fit into budget_bytes, as (number, table); a block is found when it is asked for."""
    sources = stored(sources.select(F.col("source").cast("bigint")).distinct(), "sources")
    width = clean(edges).select(F.col("src").alias("n")).union(edges.select("dst")).distinct().count()
    blocks = bounded_parallelism(sources.count(), width * 32, budget_bytes, 1)
    for k in range(blocks):
        yield k, matrix(edges, sources.where(F.pmod(F.xxhash64("source"), F.lit(blocks)) == k), limit=limit)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node and component (its smallest node) of the weakly connected graph, by label propagation with pointer jumping; nodes of very many edges and labels of very many nodes are spread."""
    both = stored(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).where("a IS NOT NULL AND b IS NOT NULL").distinct(), "links")
    every = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"))
    if nodes is not None:
        every = every.unionByName(nodes.select("node", F.lit(0).cast("bigint").alias("n"))).groupBy("node").agg(F.max("n").alias("n"))
    labels = stored(every.select("node", F.col("node").alias("component"), "n"), "labels")
    links = both.count()
    while True:
        about = labels.select(F.col("node").alias("b"), F.col("component").alias("c"), "n").where("n > 0")
        seen = spread_join(both, about, "b", links, ["c"]).groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = stored(labels.join(seen, "node", "left").select("node", "n", F.least("component", "c").alias("component"), (F.col("c") < F.col("component")).alias("changed")), "labels")
        discarded(labels)
        if step.where("changed").isEmpty():
            return step.select("node", "component")
        tops = step.groupBy(F.col("component").alias("at")).agg(F.count("*").alias("n")).join(step.select(F.col("node").alias("at"), F.col("component").alias("top")), "at")
        rows = step.select("node", F.col("n").alias("degree"), F.col("component").alias("at"))
        labels = stored(spread_join(rows, tops, "at", step.count(), ["top"]).select("node", F.col("top").alias("component"), F.col("degree").alias("n")), "labels")
        discarded(step)


def largest_component(labels: DataFrame) -> DataFrame:
    """The nodes of the largest component; of equal ones, that with the largest label."""
    top = labels.groupBy("component").count().orderBy(F.desc("count"), F.desc("component")).limit(1)
    return labels.join(F.broadcast(top.select("component")), "component", "left_semi")


def annotated(paths: DataFrame, edges: DataFrame, metres_per_second: float = 13.9) -> DataFrame:
    """Each step of paths(src, dst, nodes): its duration and distance, by the fastest edge, and its speed."""
    steps = paths.select("src", "dst", "nodes", F.posexplode("nodes").alias("k", "a")).withColumn("b", F.try_element_at("nodes", (F.col("k") + 2).cast("int"))).where("b IS NOT NULL")
    best = edges.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.min(F.struct("dur", "dist")).alias("w"))
    out = steps.join(best, ["a", "b"], "left")
    dist = F.col("w.dist")
    dur = F.coalesce(F.col("w.dur").cast("double"), dist / metres_per_second)
    return out.select("src", "dst", "k", "a", "b", dur.alias("dur"), dist.alias("dist"), F.when(dur > 0, dist / dur).alias("speed"))


def bounded_parallelism(rows: int, row_bytes: int, budget_bytes: int, tasks: int) -> int:
    """How many source blocks a matrix takes so that each task's rows stay within its share of the budget."""
    share = max(1, budget_bytes // max(1, tasks))
    return max(tasks, -(-rows * row_bytes // share))
