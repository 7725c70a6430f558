"""Map matching of traces: candidate nodes by rings, transitions by network distances, Viterbi trace by trace."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..plans.lineage import spread, stored
from .nearest import nearest
from .paths import between

METRES_PER_SECOND = 13.9
#: Ways between candidates that are broadcast, and rows of a batch.
BROADCAST_WAYS, BATCH_ROWS = 50_000, 20_000
MATCHED = "trace_id long, seq long, node long, metres double, connected boolean, confidence double"


def candidates(pings: DataFrame, nodes: DataFrame, k: int = 8) -> DataFrame:
    """trace_id, seq, node and metres of the k nodes nearest to each ping."""
    points = pings.select(F.struct("trace_id", "seq").alias("point"), "lat", "lon")
    near = nearest(points, nodes.select(F.col("node").alias("site"), "lat", "lon"), k)
    return near.select("point.trace_id", "point.seq", F.col("site").alias("node"), "metres")


def transitions(found: DataFrame, pings: DataFrame, edges: DataFrame) -> DataFrame:
    """Between candidates of consecutive pings: network metres and the pings' straight distance."""
    w = Window.partitionBy("trace_id").orderBy("seq")
    pairs = pings.withColumns({"next": F.lead("seq").over(w), "n_lat": F.lead("lat").over(w), "n_lon": F.lead("lon").over(w)}).where("next IS NOT NULL")
    pairs = pairs.select("trace_id", "seq", "next", haversine(F.col("lat"), F.col("lon"), F.col("n_lat"), F.col("n_lon")).alias("straight"))
    b = found.select("trace_id", F.col("seq").alias("next"), F.col("node").alias("to"))
    steps = found.select("trace_id", "seq", "node").join(pairs, ["trace_id", "seq"]).join(b, ["trace_id", "next"])
    wanted = stored(steps.select(F.col("node").alias("src"), F.col("to").alias("dst")).where("src <> dst").distinct(), "wanted")
    far = stored(between(edges, wanted).select(F.col("src").alias("node"), F.col("dst").alias("to"), "dur", "dist"), "far")
    if far.count() <= BROADCAST_WAYS:
        far = F.broadcast(far)
    same = F.col("node") == F.col("to")
    metres = F.when(same, 0.0).otherwise(F.coalesce(F.col("dist").cast("double"), F.col("dur") * METRES_PER_SECOND))
    return steps.join(far, ["node", "to"], "left").select("trace_id", "seq", "node", "to", metres.alias("route"), "straight").where("route IS NOT NULL")


def viterbi(emissions: dict[int, list[tuple[int, float]]], moves: dict[tuple[int, int], list[tuple[int, float, float]]], sigma: float) -> list[tuple[int, int, float, bool]]:
    """(seq, node, metres, connected) of the likeliest walk; where nothing connects a new stretch begins."""
    pings = ((seq, emissions[seq], {n: moves.get((seq, n), ()) for n, _ in emissions[seq]}) for seq in sorted(emissions))
    return walked(pings, sigma)


def walked(pings, sigma: float) -> list[tuple[int, int, float, bool]]:
    """viterbi() over pings in order: (seq, candidates (node, metres), moves from each node: (to, route, straight)); of pings that are passed only the ways back are kept."""
    beta, out, score, back = max(3 * sigma, 20.0), [], {}, []

    def close():
        if not back:
            return
        node, path = max(score, key=lambda n: (score[n], -n)), []
        for seq, parents, metres in reversed(back):
            path.append((seq, node, metres[node]))
            node = parents[node]
        path.reverse()
        out.extend((s, n, m, k > 0 or not out_before) for k, (s, n, m) in enumerate(path))

    out_before, moves = False, {}
    for seq, found, ahead in pings:
        metres = dict(found)
        own = {n: -0.5 * (m / sigma) ** 2 for n, m in metres.items()}
        best: dict[int, tuple[float, int | None]] = {}
        for node, value in score.items():
            for to, route, straight in moves.get(node, ()):
                v = value - abs(route - straight) / beta
                if to in own and (to not in best or (v, -node) > (best[to][0], -(best[to][1] or 0))):
                    best[to] = (v, node)
        if not best:
            close()
            out_before = bool(out)
            back, best = [], {n: (0.0, None) for n in own}
        score = {n: v + own[n] for n, (v, _) in best.items()}
        back.append((seq, {n: p for n, (_, p) in best.items()}, metres))
        moves = ahead
    close()
    return out


def matched(pings: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 8, sigma: float = 15.0) -> DataFrame:
    """The matched node of every ping, whether it connects to the one before, and the trace's confidence."""
    found = candidates(pings, nodes, k)
    moves = transitions(found, pings, edges)
    rows = found.select(F.col("trace_id").cast("bigint"), F.col("seq").cast("bigint"), "node", F.lit(None).cast("bigint").alias("to"), "metres", F.lit(None).cast("double").alias("straight"))
    rows = rows.unionByName(moves.select("trace_id", "seq", "node", "to", F.col("route").alias("metres"), "straight"))

    def pings_of(rows):
        """Pings, one at a time, from rows in order of seq."""
        for seq, group in groupby(rows, key=lambda r: r[1]):
            emissions, moves = [], {}
            for _, _, node, to, metres, straight in group:
                if to is None:
                    emissions.append((node, metres))
                else:
                    moves.setdefault(node, []).append((to, metres, straight))
            if emissions:
                yield seq, emissions, moves

    def run(batches):
        rows = (r for b in batches for k in range(0, b.num_rows, BATCH_ROWS) for r in zip(*(c.to_pylist() for c in b.slice(k, BATCH_ROWS).columns)))
        for trace, own in groupby(rows, key=lambda r: r[0]):
            out = walked(pings_of(own), sigma)
            trust = float(np.mean([np.exp(-0.5 * (m / sigma) ** 2) for _, _, m, _ in out])) if out else 0.0
            for k in range(0, len(out), BATCH_ROWS):
                part = out[k : k + BATCH_ROWS]
                s, n, m, c = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in (([trace] * len(s), pa.int64()), (s, pa.int64()), (n, pa.int64()), (m, pa.float64()), (c, pa.bool_()), ([trust] * len(s), pa.float64()))], names=[c.split()[0] for c in MATCHED.split(", ")])

    # within a ping in order of nodes, so that equal walks end alike whatever the deal
    return spread(rows, "trace_id").sortWithinPartitions("trace_id", "seq", "metres", "node", "to").mapInArrow(run, MATCHED)
