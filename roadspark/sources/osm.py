"""OpenStreetMap extracts in the public PBF format, and the tables that a road graph is built from.

A file is a row of blobs, each a length-prefixed header and a zlib-compressed block. Their offsets are found by
one task a file, which reads headers only; blocks are then decoded apart, one a row, spread over tasks. The
decoder knows protocol-buffer fields by number, and of OSM's messages what roads and addresses need. Relations
and metadata are passed over.

`nodes(node, lat, lon, tags)` and `ways(way, refs, tags)` come out; an empty or damaged header ends a file with
an error. Built tables are kept as Parquet and read again as long as no source file is newer.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.profiles import CustomProfile
from ..operators import graph_build
from ..plans.lineage import spread, stored

NODES = "node long, lat double, lon double, tags map<string,string>"
WAYS = "way long, refs array<long>, tags map<string,string>"


# --- protocol buffers ---


def varint(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length integer and where it ends."""
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def unzigzag(x: int) -> int:
    return (x >> 1) ^ -(x & 1)


def fields(data: bytes):
    """(number, value) of a message's fields; values are integers, or bytes of what has a length."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack_from("<I", data, at)[0], at + 4
        elif kind == 1:
            value, at = struct.unpack_from("<Q", data, at)[0], at + 8
        else:
            raise ValueError("unknown wire type")
        yield key >> 3, value


def packed(data: bytes) -> np.ndarray:
    """Packed variable-length integers, decoded together."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    begin = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(begin, ends - begin + 1)
    parts = (raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(parts, begin).astype(np.int64)


def deltas(data: bytes) -> np.ndarray:
    """Packed zigzag differences as running sums."""
    x = packed(data).astype(np.uint64)
    signed = (x >> np.uint64(1)).astype(np.int64) ^ -((x & np.uint64(1)).astype(np.int64))
    return np.cumsum(signed)


# --- blocks ---


def inflated(blob: bytes) -> bytes:
    """A blob's block: stored plainly or by zlib."""
    for number, value in fields(blob):
        if number == 1:
            return value
        if number == 3:
            return zlib.decompress(value)
    raise ValueError("a blob of an unknown compression")


class Block:
    """A primitive block's nodes and ways."""

    def __init__(self, data: bytes):
        self.strings, self.step, self.lat0, self.lon0 = [], 100, 0, 0
        groups = []
        for number, value in fields(data):
            if number == 1:
                self.strings = [s.decode("utf-8", "replace") for _, s in fields(value)]
            elif number == 2:
                groups.append(value)
            elif number == 17:
                self.step = value
            elif number == 19:
                self.lat0 = value - (1 << 64) if value >> 63 else value
            elif number == 20:
                self.lon0 = value - (1 << 64) if value >> 63 else value
        self.parts = [x for g in groups for x in fields(g)]

    def degrees(self, x: np.ndarray, base: int) -> np.ndarray:
        return 1e-9 * (base + self.step * x)

    def tags(self, keys: bytes, values: bytes) -> dict:
        return {self.strings[k]: self.strings[v] for k, v in zip(packed(keys).tolist(), packed(values).tolist())}

    def nodes(self):
        """(node, lat, lon, tags)."""
        for number, value in self.parts:
            if number == 1:
                f = dict(fields(value))
                at = [float(self.degrees(np.array([unzigzag(f.get(k, 0))]), base)[0]) for k, base in ((8, self.lat0), (9, self.lon0))]
                yield unzigzag(f[1]), *at, self.tags(f.get(2, b""), f.get(3, b""))
            elif number == 2:
                f = dict(fields(value))
                ids, lats, lons = deltas(f.get(1, b"")), self.degrees(deltas(f.get(8, b"")), self.lat0), self.degrees(deltas(f.get(9, b"")), self.lon0)
                line = packed(f.get(10, b"")).tolist()
                at = 0
                for node, lat, lon in zip(ids.tolist(), lats.tolist(), lons.tolist()):
                    own = {}
                    while at < len(line) and line[at]:
                        own[self.strings[line[at]]] = self.strings[line[at + 1]]
                        at += 2
                    at += 1
                    yield node, lat, lon, own

    def ways(self):
        """(way, refs, tags)."""
        for number, value in self.parts:
            if number == 3:
                f = dict(fields(value))
                yield f[1], deltas(f.get(8, b"")).tolist(), self.tags(f.get(2, b""), f.get(3, b""))


def blobs(stream, size: int):
    """(kind, offset, length) of a file's blobs, by their headers alone."""
    at = 0
    while at < size:
        stream.seek(at)
        head = stream.read(4)
        if len(head) < 4:
            raise ValueError("a truncated file")
        n = struct.unpack(">I", head)[0]
        f = dict(fields(stream.read(n)))
        yield f[1].decode(), at + 4 + n, f[3]
        at += 4 + n + f[3]


def parsed(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of files, each a path or URI that every executor sees."""

    def index(frames):
        for pdf in frames:
            for uri in pdf["uri"]:
                fs, base = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(base) as stream:
                    rows = [(uri, at, n) for kind, at, n in blobs(stream, stream.size()) if kind == "OSMData"]
                yield pd.DataFrame(rows, columns=["uri", "at", "size"])

    uris = [p if "://" in p else f"file://{p}" for p in paths]
    files = spark.createDataFrame([(u,) for u in uris], "uri string").repartition(max(1, len(uris)))
    found = spread(stored(files.mapInPandas(index, "uri string, at long, size long"), "blobs"), "uri", "at")

    def read(names, rows_of):
        def run(frames):
            for pdf in frames:
                for uri, at, size in zip(pdf["uri"], pdf["at"], pdf["size"]):
                    fs, base = pafs.FileSystem.from_uri(uri)
                    with fs.open_input_file(base) as stream:
                        stream.seek(at)
                        block = Block(inflated(stream.read(size)))
                    yield pd.DataFrame(list(rows_of(block)), columns=names)

        return run

    return found.mapInPandas(read(["node", "lat", "lon", "tags"], Block.nodes), NODES), found.mapInPandas(read(["way", "refs", "tags"], Block.ways), WAYS)


def newest(spark: SparkSession, path: str) -> int | None:
    """The latest change of a file, or of the files in a folder, in milliseconds; None where there is nothing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(where):
        return None
    status = fs.getFileStatus(where)
    return max([f.getModificationTime() for f in fs.listStatus(where)], default=0) if status.isDirectory() else status.getModificationTime()


def cached(spark: SparkSession, sources: list[str], path: str, build, force: bool = False) -> DataFrame:
    """The table at path if it is complete and no source is newer, else build() written there."""
    made = newest(spark, f"{path}/_SUCCESS")
    times = [newest(spark, s) for s in sources]
    if force or made is None or any(t is None or t > made for t in times):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def built(spark: SparkSession, paths: list[str], folder: str, profile: str | CustomProfile = "car", tiles: DataFrame | None = None, force: bool = False) -> dict[str, DataFrame]:
    """All tables of a road graph below folder: nodes, ways, edges, names, addresses and, with height tiles, heights; kept ones are used again unless a source is newer or force is set."""
    from . import files

    nodes, ways = parsed(spark, paths)
    keep = lambda name, sources, make: cached(spark, sources, f"{folder}/{name}", make, force)
    out = {"nodes": keep("nodes", paths, lambda: nodes), "ways": keep("ways", paths, lambda: ways)}
    used = graph_build.accepted(out["ways"], profile).select(F.explode("refs").alias("node")).distinct()
    places = out["nodes"].join(used, "node", "left_semi").select("node", "lat", "lon")
    heights = None
    if tiles is not None:
        heights = out["heights"] = keep("heights", paths, lambda: files.heights(places, tiles))
    out["edges"] = keep("edges", paths, lambda: graph_build.edges(out["ways"], places, profile, heights))
    out["names"] = keep("names", paths, lambda: graph_build.node_names(out["ways"]))
    out["addresses"] = keep("addresses", paths, lambda: graph_build.addresses(out["nodes"]))
    return out
