"""Areas reached within a time: raster cells by DataFrame operations, rings around them by tracing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import cell
from ..plans.lineage import spread
from .paths import matrix

MOST_SECONDS, MOST_CONTOURS = 14_400, 8


def contours(seconds: list[int]) -> list[int]:
    """Positive limits up to MOST_SECONDS, in order, each once, MOST_CONTOURS at most."""
    return sorted({c for c in seconds if 0 < c <= MOST_SECONDS})[:MOST_CONTOURS]


def reached_cells(edges: DataFrame, nodes: DataFrame, sources: DataFrame, seconds: list[int], size: float = 0.005, pad: int = 1) -> DataFrame:
    """source, contour, r and c of the raster cells within `pad` of a node that is reached in time."""
    limits = contours(seconds)
    found = matrix(edges, sources, limit=max(limits)).select(F.col("src").alias("source"), F.col("dst").alias("node"), "dur")
    rows = found.join(nodes.select("node", cell(F.col("lat"), size).alias("r0"), cell(F.col("lon"), size).alias("c0")), "node")
    # a source's rows meet once: its cells' least durations, then those of the cells around them, come from the same tasks
    rows = spread(rows.select("source", "r0", "c0", "dur"), "source").groupBy("source", "r0", "c0").agg(F.min("dur").alias("dur"))
    span = F.sequence(F.lit(-pad), F.lit(pad))
    rows = rows.withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span))
    rows = rows.groupBy("source", (F.col("r0") + F.col("dr")).alias("r"), (F.col("c0") + F.col("dc")).alias("c")).agg(F.min("dur").alias("dur"))
    return rows.select("source", F.explode(F.filter(F.array(*map(F.lit, limits)), lambda x: F.col("dur") <= x)).alias("contour"), "r", "c")


def trace(cells: set[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Closed rings, corner by corner, around sets of (row, column); where two cells touch at a corner the walk turns left, so that they stay apart."""
    step: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in sorted(cells):
        for a, b, other in (((r, c), (r, c + 1), (r - 1, c)), ((r, c + 1), (r + 1, c + 1), (r, c + 1)), ((r + 1, c + 1), (r + 1, c), (r + 1, c)), ((r + 1, c), (r, c), (r, c - 1))):
            if other not in cells:
                step.setdefault(a, []).append(b)
    rings = []
    while step:
        start = min(step)
        ring, at, way = [start], start, None
        while True:
            options = step[at]
            if len(options) > 1 and way is not None:
                turn = lambda b, at=at, way=way: way[0] * (b[1] - at[1]) - way[1] * (b[0] - at[0])
                options.sort(key=turn)
            b = options.pop(0)
            if not options:
                del step[at]
            new = (b[0] - at[0], b[1] - at[1])
            ring.append(b)
            at, way = b, new
            if at == start:
                break
        rings.append(ring)
    return rings


RINGS = "source long, contour int, ring int, corners array<struct<lat:double,lon:double>>"


def rings(cells: DataFrame, size: float = 0.005) -> DataFrame:
    """source, contour, ring and its corners (lat, lon), closed; an area is held at a time, a batch may end within one."""

    def traced(areas: list[np.ndarray]) -> pa.RecordBatch:
        rows = [(int(x[0, 0]), int(x[1, 0]), k, ring) for x in areas for k, ring in enumerate(trace(set(zip(x[2].tolist(), x[3].tolist()))))]
        points = np.array([p for row in rows for p in row[3]], np.int64).reshape(-1, 2)
        ends = np.cumsum([0, *[len(row[3]) for row in rows]])
        corners = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(points[:, 0] * size), pa.array(points[:, 1] * size)], ["lat", "lon"]))
        own = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*own, corners], names=["source", "contour", "ring", "corners"])

    def run(batches):
        held = np.zeros((4, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
            cut = np.flatnonzero((held[0, 1:] != held[0, :-1]) | (held[1, 1:] != held[1, :-1])) + 1
            if len(cut):
                *areas, held = np.split(held, cut, axis=1)
                yield traced(areas)
        if held.size:
            yield traced([held])

    rows = cells.select(*[F.col(c).cast("bigint") for c in ("source", "contour", "r", "c")])
    return spread(rows, "source").sortWithinPartitions("source", "contour").mapInArrow(run, RINGS)


def geojson(found: DataFrame) -> DataFrame:
    """One GeoJSON feature a source and contour."""
    line = F.transform("corners", lambda p: F.array(p["lon"], p["lat"]))
    rows = found.groupBy("source", "contour").agg(F.sort_array(F.collect_list(F.struct("ring", line.alias("line")))).alias("rings"))
    shape = F.struct(F.lit("MultiPolygon").alias("type"), F.transform("rings", lambda r: F.array(r["line"])).alias("coordinates"))
    return rows.select("source", "contour", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("contour").alias("properties"), shape.alias("geometry"))).alias("feature"))
