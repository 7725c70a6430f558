"""Near-duplicate documents by SetSketch registers.

A document's set holds the 64-bit hashes of its distinct shingles of k words. Documents of equal sets (equal
size and equal 128-bit sums of mixed hashes) form a class. A class's sketch has REGISTERS registers: the
minimum over its set of exponentially distributed values, truncated to integers on a logarithmic scale; equal
registers are as likely as the sets are similar, and sketches merge by maxima. Bands of registers are bucket
keys. Candidates are compared in two steps, both in tiles of bounded size: every class of a bucket with the
bucket's hub (its smallest class), and, in clusters of classes that buckets hold together but whose links
so far leave apart, the classes outside the cluster's largest component with the others: with all of the
cluster where it is small, else with all of the cluster or with all of each of their buckets, whichever is fewer
pairs. In a tile a pair's registers are compared jointly by likelihood: pairs whose likelihood at the threshold
or above lies EVIDENCE below the best are not tried further (nor are those that agree in fewer registers than
LEAST_SAME of what the threshold expects, which for a linked pair is ten deviations off); all others are
confirmed on full sets. So no pair becomes a row unless it is a link, no group meets in one task, and there is
no cap on a bucket. Pairs at the threshold or above share a band but for a chance below 3e-8 at a similarity of
0.85, and 4e-6 at 0.8.

Components come from rounds in which every node points to its smallest neighbour and edges are contracted to
the pointers' ends, each a table in the shared folder that replaces the last. Hot keys are joined after a broadcast of those keys that hold a HOT-th of all
rows (HOT at most).

Null and empty texts have the empty set and stay alone. Documents without an id take part, and a component of
such documents alone has no id. Repeated rows come out each for itself; rows of one id need not have one text.
An empty table gives no rows. `deduplicated` judges row by row and keeps all columns, whatever their names: of
each component one row stays, of the smallest id (rows without an id come last), and of rows that repeat it one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import spread_join
from .common import ASCII_SPACE, BROADCAST_ROWS, LOWER, cut, discarded, hash_runs, mix, numbered, released, row_blocks, stored, text_buffers

BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65534
EVIDENCE = 25.0
LEAST_SAME = 0.4
TILE = 512
COLUMNS = 8192
BLOCK_BYTES = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240229))
_MUL = _RNG.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, REGISTERS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all rows in a row, and where each row's begin and end.

    A row of fewer than k words has its whole sequence as one shingle.
    """
    low, n = LOWER[data], len(offsets) - 1
    starts, ends, rows = cut(low, offsets, ~ASCII_SPACE)
    hashes = hash_runs(low, starts, ends)
    words = np.diff(rows)
    of = np.repeat(np.arange(n), words)
    m = max(0, len(hashes) - k + 1)
    same = of[k - 1 :] == of[:m]
    h = np.zeros(m, np.uint64)
    for j in range(k):
        h = mix(h + hashes[j : j + m])
    h, own = h[same[:m]], of[:m][same[:m]]
    few = np.flatnonzero((words > 0) & (words < k))
    if len(few):
        extra = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            has = words[few] > j
            extra[has] = mix(extra[has] + hashes[rows[:-1][few[has]] + j])
        h, own = np.concatenate([h, mix(extra + np.uint64(1))]), np.concatenate([own, few])
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    h, own = h[new], own[new]
    return h, np.searchsorted(own, np.arange(n + 1))


def set_keys(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums for each set."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((total[at[1:]] - total[at[:-1]]).astype(np.int64))
    return out[0], out[1]


def sketches(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Registers of sets, 16 bits each; an empty set's are 0."""
    n = len(at) - 1
    out = np.zeros((n, REGISTERS), np.uint16)
    full = np.flatnonzero(at[1:] > at[:-1])
    if not len(full):
        return out
    for lo in range(0, len(full), 256):  # as much as the caches hold
        rows = full[lo : lo + 256]
        part, begin = h[at[rows[0]] : at[rows[-1] + 1]], at[rows] - at[rows[0]]
        low = np.empty((len(rows), REGISTERS))
        for j in range(REGISTERS):
            low[:, j] = np.minimum.reduceat(part * _MUL[j] + _ADD[j], begin)
        value = -np.log1p(-np.minimum((low + 1) / 2.0**64, 1 - 2.0**-53)) / RATE
        out[rows] = np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP).astype(np.uint16)
    return out


def likely(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, asked: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of sketches in a and b that are asked for (a matrix), those that may reach the threshold by their joint likelihood."""
    most = np.minimum(na[:, None] / nb[None, :], nb[None, :] / na[:, None])
    asked = asked & (most * 100 >= percent - 1e-9)
    same = np.empty(asked.shape, np.int16)
    for lo in range(0, len(a), 32):
        same[lo : lo + 32] = (a[lo : lo + 32, None, :] == b[None, :, :]).sum(axis=2)
    i, j = np.nonzero(asked & (same >= LEAST_SAME * REGISTERS * percent / 100))
    good = np.zeros(len(i), bool)
    for lo in range(0, len(i), 16384):
        p, q = i[lo : lo + 16384], j[lo : lo + 16384]
        more = (a[p] > b[q]).sum(axis=1)
        equal = same[p, q].astype(np.int64)
        less = REGISTERS - more - equal
        total = (na[p] + nb[q]).astype(float)
        u, v, top = na[p] / total, nb[q] / total, most[p, q]

        def chance(x):
            return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

        def value(x):
            up, down, tiny = chance(u - v * x), chance(v - u * x), 1e-12
            return more * np.log(up + tiny) + less * np.log(down + tiny) + equal * np.log(np.maximum(1 - up - down, tiny))

        best, near, least = np.full(len(p), -np.inf), np.full(len(p), -np.inf), percent / 100
        for step in np.linspace(0, 1, 21):
            best = np.maximum(best, value(step * np.minimum(top, 1)))
        for step in np.linspace(0, 1, 6):
            near = np.maximum(near, value(np.minimum(least + step * np.maximum(top - least, 0), top)))
        good[lo : lo + 16384] = near >= best - EVIDENCE
    return i[good], j[good]


def shared_counts(sets_a: list[np.ndarray], sets_b: list[np.ndarray], pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of intersections, for the pairs given."""
    i, j = pairs
    if len(i) <= 4 * (len(sets_a) + len(sets_b)):
        return np.fromiter((len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())), np.int64, len(i))
    common = np.intersect1d(np.unique(np.concatenate(sets_a)), np.unique(np.concatenate(sets_b)), assume_unique=True)
    counts = np.zeros((len(sets_a), len(sets_b)), np.float32)
    for lo in range(0, len(common), COLUMNS):
        part = common[lo : lo + COLUMNS]
        sides = []
        for sets in (sets_a, sets_b):
            has = np.zeros((len(sets), len(part)), np.float32)
            for r, s in enumerate(sets):
                own = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
                at = np.searchsorted(part, own)
                has[r, at[part[np.minimum(at, len(part) - 1)] == own]] = 1
            sides.append(has)
        counts += sides[0] @ sides[1].T  # below 2**24, so exact
    return counts[i, j].astype(np.int64)


def _tops(up: DataFrame, total: int, name: str) -> DataFrame:
    """node and top: the end of each of total nodes' ways by up(node, at), which leads to smaller nodes or stays; pointers double their reach each round."""
    while True:
        sizes = up.groupBy("at").agg(F.count("*").alias("n"))
        ahead = sizes.join(up.select(F.col("node").alias("at"), F.col("at").alias("top")), "at")
        now = stored(spread_join(up.select("node", "at"), ahead, "at", total, ["top"], total), name, total)
        moved = not now.where("top <> at").isEmpty()
        discarded(up)
        if not moved:
            return now
        up = now.select("node", F.col("top").alias("at"))
        up._stored_path = now._stored_path


def components(edges: DataFrame, name: str) -> DataFrame:
    """node and label (the smallest node reachable) of all nodes of edges(a, b), for long nodes.

    Each round every node points to its smallest neighbour, ways of pointers end in one node, and edges are drawn
    anew between these ends; what is left of the edges falls fast, so that only the first round touches them all.
    """
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-edges")
    rounds = []
    while (total := now.count()) > 0:
        ends = now.select(F.col("b").alias("node"), F.col("a").alias("other")).union(now.select("a", "b"))
        nodes = stored(ends.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("at"), F.count("*").alias("n")), f"{name}-nodes", 2 * total)
        count = nodes.count()
        first = nodes.select("node", "at")
        tops = stored(_tops(first, count, name).select("node", "top").join(nodes.select("node", "n"), "node"), f"{name}-tops", count)
        rounds.append((tops, count))
        by = lambda side: tops.select(F.col("node").alias(side), F.col("top").alias(f"{side}_top"), "n")  # noqa: B023, E731
        drawn = spread_join(spread_join(now, by("a"), "a", total, ["a_top"], count), by("b"), "b", total, ["b_top"], count)
        new = stored(drawn.where("a_top <> b_top").select(F.least("a_top", "b_top").alias("a"), F.greatest("a_top", "b_top").alias("b")).distinct(), f"{name}-edges", total)
        discarded(now, nodes)
        now = new
    if not rounds:
        return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = rounds[-1][0].select("node", F.col("top").alias("label"))
    for tops, count in reversed(rounds[:-1]):
        sizes = tops.groupBy(F.col("top").alias("at")).agg(F.count("*").alias("n")).join(labels.select(F.col("node").alias("at"), "label"), "at", "left")
        own = sizes.select("at", F.coalesce("label", "at").alias("label"), "n")
        labels = stored(spread_join(tops.select("node", F.col("top").alias("at")), own, "at", count, ["label"], count).select("node", "label"), name, count)
    return labels


def tile_links(tiles: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the sides of tiles(tile, i, j, side, node, label, n, regs, shingles) whose labels differ: of each tile's links a spanning forest over labels, so that their number follows the nodes."""

    def run(group: pa.Table) -> pa.Table:
        side = group["side"].to_numpy()
        node, label, n = (group[c].to_numpy() for c in ("node", "label", "n"))
        regs = np.frombuffer(b"".join(group["regs"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        raw = group["shingles"].to_pylist()
        out: tuple[list, list] = ([], [])
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = a[np.argsort(node[a])], b[np.argsort(node[b])]
        roots: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := roots.get(x, x)) != x:
                roots[x] = x = roots.get(up, up)
            return x

        for lo in range(0, len(a), TILE):
            for to in range(0, len(b), TILE):
                x, y = a[lo : lo + TILE], b[to : to + TILE]
                i, j = likely(regs[x], n[x], regs[y], n[y], label[x][:, None] != label[y][None, :], percent)
                if not len(i):
                    continue
                ui, i2 = np.unique(i, return_inverse=True)
                uj, j2 = np.unique(j, return_inverse=True)
                shared = shared_counts([np.frombuffer(raw[x[k]], np.uint64) for k in ui], [np.frombuffer(raw[y[k]], np.uint64) for k in uj], (i2, j2))
                good = 100 * shared >= percent * (n[x[i]] + n[y[j]] - shared)
                for p, q in zip(x[i[good]].tolist(), y[j[good]].tolist()):
                    u, v = root(int(label[p])), root(int(label[q]))
                    if u != v:
                        roots[u] = v
                        out[0].append(int(node[p]))
                        out[1].append(int(node[q]))
        released()
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return tiles.groupBy("tile", "i", "j").applyInArrow(run, "a long, b long")


def _sketched(rows: DataFrame, k: int) -> DataFrame:
    """uid, doc_id, n, key1, key2 and registers of rows(doc_id, text)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in row_blocks(offsets, BLOCK_BYTES):
                h, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                key1, key2 = set_keys(h, at)
                cols = [pa.array(np.arange(uid, uid + b - a)), batch.column(0).slice(a, b - a), pa.array(np.diff(at)), pa.array(key1), pa.array(key2), pa.array([x.tobytes() for x in sketches(h, at)], pa.binary())]
                uid += b - a
                yield pa.RecordBatch.from_arrays(cols, names=["uid", "doc_id", "n", "key1", "key2", "regs"])

    return rows.mapInArrow(run, f"uid long, doc_id {kind}, n long, key1 long, key2 long, regs binary")


def _full_sets(texts: DataFrame, k: int) -> DataFrame:
    """n, key1, key2, registers and shingles of texts(text), without those of empty sets."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, b in row_blocks(offsets, BLOCK_BYTES):
                h, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                key1, key2 = set_keys(h, at)
                full = np.flatnonzero(np.diff(at))
                sets = pa.array([h[at[r] : at[r + 1]].tobytes() for r in full.tolist()], pa.binary())
                cols = [pa.array(np.diff(at)[full]), pa.array(key1[full]), pa.array(key2[full]), pa.array([x.tobytes() for x in sketches(h, at)[full]], pa.binary()), sets]
                yield pa.RecordBatch.from_arrays(cols, names=["n", "key1", "key2", "regs", "shingles"])

    return texts.mapInArrow(run, "n long, key1 long, key2 long, regs binary, shingles binary")


def _bands(classes: DataFrame) -> DataFrame:
    """bucket and node, for each band of each class."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(regs), 1))
            for r in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, r])
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).astype(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["bucket", "node"])

    return classes.select("node", "regs").mapInArrow(run, "bucket long, node long")


def _side(rows: DataFrame, tile: str, side: int, i, j) -> DataFrame:
    return rows.select(F.col(tile).alias("tile"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"), "node", "label", "n", "regs", "shingles")


def _block(blocks):
    return F.pmod(F.xxhash64("node"), blocks)


def _small(table: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _tiles(rows: DataFrame, tile: str, label) -> DataFrame:
    """Tiles of rows (tile column, node, label, n, regs, shingles, all and out: numbers of blocks): those whose label is another than `label` against all."""
    index = lambda c: F.explode(F.sequence(F.lit(0), (F.col(c) - 1).cast("int")))
    left = _side(rows.where(F.col("label") != label).withColumn("j", index("all")), tile, 0, _block(F.col("out")), F.col("j"))
    right = _side(rows.withColumn("i", index("out")), tile, 1, F.col("i"), _block(F.col("all")))
    return left.unionByName(right)


def _mixed_tiles(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """The tiles of the second step: of placed(node, cluster, label) the clusters of several labels."""
    blocks = lambda c: F.ceil(F.col(c) / TILE)
    parts = placed.groupBy("cluster", "label").agg(F.count("*").alias("m"))
    mixed = parts.groupBy("cluster").agg(F.max(F.struct("m", F.col("label").alias("main"))).alias("top"), F.count("*").alias("parts"), F.sum("m").alias("n")).where("parts > 1 AND n > 2")
    mixed = mixed.select("cluster", "n", F.struct(F.col("top.main").alias("main"), blocks("n").alias("all"), F.ceil((F.col("n") - F.col("top.m")) / TILE).alias("out"), "n", (F.col("n") - F.col("top.m")).alias("lone")).alias("about"))
    rest = stored(spread_join(placed, mixed, "cluster", max(1, placed.count()), ["about"]).select("node", "cluster", "label", "about.*"), "mixed")
    # clusters of several tiles: would their buckets have fewer pairs?
    large = rest.where(F.col("n") > TILE)
    if large.isEmpty():
        return _tiles(rest.drop("n").join(sets, "node"), "cluster", F.col("main"))
    inside = stored(_bands(sets.join(large.select("node"), "node", "left_semi")).join(large.select("node", "cluster", "label", "main", "n", "lone"), "node"), "inside")
    sizes = inside.groupBy("bucket").agg(F.count("*").alias("size"), F.count_if(F.col("label") != F.col("main")).alias("outs"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.first("cluster").alias("cluster"), F.first("n").alias("n"), F.first("lone").alias("lone")).where("lo < hi")
    sizes = stored(sizes.select("bucket", "cluster", "size", "outs", (F.col("size") * F.col("outs")).alias("pairs"), (F.col("n") * F.col("lone")).alias("whole")), "sizes")
    by_bucket = stored(sizes.groupBy("cluster").agg(F.sum("pairs").alias("pairs"), F.first("whole").alias("whole")).where("pairs < whole").select("cluster"), "by-bucket")
    whole = rest.drop("n").join(_small(by_bucket), "cluster", "left_anti")
    about = sizes.join(_small(by_bucket), "cluster", "left_semi").select("bucket", F.col("size").alias("n"), F.struct(blocks("size").alias("all"), blocks("outs").alias("out")).alias("blocks"))
    some = spread_join(inside.select("bucket", "node", "label", "main"), about, "bucket", max(1, inside.count()), ["blocks"]).select("bucket", "node", "label", "main", "blocks.*")
    return _tiles(whole.join(sets, "node"), "cluster", F.col("main")).unionByName(_tiles(some.join(sets, "node"), "bucket", F.col("main")))


def _resolved(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of docs(doc_id, text): key (key1, key2), doc_id, n_shingles and found (component_id, keeper: the class that stays), null for empty sets."""
    sketched = stored(_sketched(docs, k), "sketches")
    some = F.struct(F.col("doc_id").isNull().alias("unnamed"), "uid")
    classes = stored(
        sketched.where("n > 0").groupBy("key1", "key2", "n").agg(F.min("uid").alias("node"), F.min("doc_id").alias("doc"), F.min_by("doc_id", some).alias("at"), F.first("regs").alias("regs")), "classes"
    )
    bands = _bands(classes)
    buckets = bands.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    total = classes.count() * BANDS
    stars = stored(spread_join(bands, buckets, "bucket", total, ["hub"]).where("node <> hub").select("node", "hub").distinct(), "stars")
    clusters = components(stars.select(F.col("node").alias("a"), F.col("hub").alias("b")), "clusters")

    needed = stored(clusters.join(classes.select("node", "at", "key1", "key2"), "node").select("at", "key1", "key2", "node"), "needed")
    wanted = _small(stored(needed.select(F.col("at").alias("want")).distinct(), "wanted"))
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("want")), "left_semi").select("text")
    sets = stored(_full_sets(texts, k).dropDuplicates(["key1", "key2"]).join(_small(needed.drop("at")), ["key1", "key2"]).select("node", "n", "regs", "shingles"), "sets")

    degree = stars.groupBy("hub").agg(F.count("*").alias("n"))
    hubs = degree.select("hub", F.ceil(F.col("n") / TILE).alias("blocks"))
    own = sets.withColumn("label", F.col("node"))
    left = _side(own.join(hubs, F.col("node") == F.col("hub")).withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))), "hub", 0, F.lit(0), F.col("j"))
    spokes = spread_join(stars, degree.withColumn("blocks", F.ceil(F.col("n") / TILE)), "hub", max(1, stars.count()), ["blocks"])
    right = _side(own.join(spokes, "node"), "hub", 1, F.lit(0), _block(F.col("blocks")))
    links = stored(tile_links(left.unionByName(right), percent), "links-1")

    first = components(links, "first")
    placed = stored(clusters.withColumnRenamed("label", "cluster").join(first, "node", "left").select("node", "cluster", F.coalesce("label", "node").alias("label")), "placed")
    more = stored(tile_links(_mixed_tiles(placed, sets), percent), "links-2")
    discarded(sets)

    labels = components(links.union(more), "final")
    named = classes.join(labels, "node", "left").select("key1", "key2", F.col("n").alias("size"), "doc", F.coalesce("label", "node").alias("label"))
    keeper = F.min(F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "key1", "key2")).alias("keeper")
    least = named.groupBy("label").agg(F.min("doc").alias("component_id"), keeper, F.count("*").alias("n")).select("label", F.struct("component_id", "keeper").alias("found"), "n")
    ids = spread_join(named, least, "label", max(1, classes.count()), ["found"])
    # the class of a document: hot classes are broadcast, as HOT at most hold a HOT-th of all rows
    copies = sketched.where("n > 0").groupBy("key1", "key2").agg(F.count("*").alias("n"))
    about = ids.join(copies, ["key1", "key2"]).select(F.struct("key1", "key2").alias("key"), "found", "n")
    rows = sketched.select(F.struct("key1", "key2").alias("key"), "uid", "doc_id", F.col("n").alias("n_shingles"))
    full = spread_join(rows.where("n_shingles > 0"), about, "key", max(1, sketched.count()), ["found"])
    empty = rows.where("n_shingles = 0").withColumn("found", F.lit(None).cast(about.schema["found"].dataType))
    return full.unionByName(empty)


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable over links) of every document."""
    found = _resolved(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), k, percent)
    return found.select("doc_id", "n_shingles", F.when(F.col("found").isNull(), F.col("doc_id")).otherwise(F.col("found.component_id")).alias("component_id"))


def _keyed(rows: DataFrame, at: int, k: int) -> DataFrame:
    """rows with the key of their sets and their sizes."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(at))
            parts = [np.zeros((3, 0), np.int64)]
            for a, b in row_blocks(offsets, BLOCK_BYTES):
                h, ends = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                parts.append(np.array([*set_keys(h, ends), np.diff(ends)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, np.concatenate(parts, axis=1))], names=[*batch.schema.names, "key1", "key2", "size"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, key1 long, key2 long, size long")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, of the smallest id; rows of empty sets stay."""
    rows, own, at = numbered(docs, [], text_col)
    ident = F.col(f"c{own.index(id_col)}")
    found = _resolved(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), k, percent)
    stays = (F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("found.keeper.doc")) & (F.col("key.key1") == F.col("found.keeper.key1")) & (F.col("key.key2") == F.col("found.keeper.key2"))
    found = stored(found.select("doc_id", "key.key1", "key.key2", "n_shingles", stays.alias("stays")), "decisions")
    # by id, but for ids of rows that go and rows that stay, and of rows that stay and are repeated
    fates = found.groupBy("doc_id", "key1", "key2", "stays").agg(F.count("*").alias("n"), F.max("n_shingles").alias("size"))
    fates = stored(fates.groupBy("doc_id").agg(F.max(~F.col("stays")).alias("goes"), (F.max("stays") & F.max(~F.col("stays")) | F.max(F.col("stays") & (F.col("n") > 1) & (F.col("size") > 0))).alias("several")).where("goes OR several"), "fates")
    out = rows.join(_small(stored(fates.select("doc_id"), "gone")), ident.eqNullSafe(F.col("doc_id")), "left_anti")
    several = stored(fates.where("several").select("doc_id"), "several")
    if not several.isEmpty():
        keyed = _keyed(rows.join(_small(several), ident.eqNullSafe(F.col("doc_id")), "left_semi"), at, k)
        keep = found.where("stays AND n_shingles > 0").join(several.withColumnRenamed("doc_id", "same"), F.col("doc_id").eqNullSafe(F.col("same")), "left_semi").select("doc_id", F.col("key1").alias("k1"), F.col("key2").alias("k2")).distinct()
        kept = keyed.where("size > 0").join(_small(stored(keep, "keep")), ident.eqNullSafe(F.col("doc_id")) & (F.col("key1") == F.col("k1")) & (F.col("key2") == F.col("k2")), "left_semi")
        kept = kept.dropDuplicates([f"c{own.index(id_col)}", "key1", "key2"]).unionByName(keyed.where("size = 0"))
        out = out.unionByName(kept.select(*rows.columns))
    return out.toDF(*own)
