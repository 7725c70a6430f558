"""Exact top-k by inner product: columnar branch and bound.

Components become integers, floor(scale * x). Candidates stand in vertical layout, a row a dimension, in blocks
of dimensions, those with most of the queries' mass first. For a block of queries and a chunk of candidates,
inner products are accumulated block by block; what the remaining dimensions can add is at most the product of
the remaining norms, and candidates that cannot reach a query's threshold any more are compacted away, first
whole columns, then single pairs. A query's threshold starts as its k-th best score among a bounded seed of rows
(a valid lower bound; it affects only speed); no candidate is skipped otherwise.

What a task sends on grows with the rows above the threshold, so thresholds are raised in waves: over a share of
the rows, chosen by hash and STEP times as large each wave, until the last wave takes all. A wave thus sends
about STEP * k rows a query, however many rows and tasks there are. Each wave writes the queries with their
thresholds to the shared folder, where every task reads them block by block, so nothing that grows is broadcast.
A task's best k for each query go to the merge by query, which keeps k a task before the shuffle (a window with
a group limit).

Inner products are sums of doubles where these are exact; rows with larger components, and only those, are
multiplied as Python integers. Vectors that are null or hold a null or non-finite component take no part, nor do
rows without an id; shorter vectors count as padded by zeros. A query's own row is every row with its id. Exact
repeats of a query are answered once; repeated candidates count each. Ties go to the smaller id. Scores are
exact; one outside 64 bits is set to the nearest 64-bit value. With no queries or no candidates the result is
empty. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

SCALE = 1024
SEED_ROWS = 4096
STEP = 64
QUERY_BLOCK = 128
CHUNK = 16384
DIMS = 16


def matrix(column: pa.Array, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """The rows that take part, and their integer vectors as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    width = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), width))
    if len(sizes) and (sizes == width).all():
        out = values.reshape(len(sizes), width).copy()
    else:
        ends = np.cumsum(sizes)
        for i, (n, e) in enumerate(zip(sizes.tolist(), ends.tolist())):
            out[i, :n] = values[e - n : e]
    good = np.isfinite(out).all(axis=1) & column.is_valid().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        ints = np.floor(out * scale)
    good &= np.isfinite(ints).all(axis=1)
    rows = np.flatnonzero(good)
    return rows, ints[rows]


def widen(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def large(x: np.ndarray) -> np.ndarray:
    """The rows of x whose products with each other need not sum exactly in doubles."""
    return np.square(np.abs(x).max(axis=1, initial=0)) * max(1, x.shape[1]) >= 2.0**52


def by_integers(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as Python integers, set to 64 bits."""
    columns = [[int(c) for c in v] for v in x]
    return np.array([[max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(u, v)))) for v in columns] for u in ([int(c) for c in u] for u in q)], np.int64).reshape(len(q), len(x))


def survivors(q: np.ndarray, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (query, candidate) that score least[query] or more, with their scores."""
    width = max(q.shape[1], x.shape[1])
    q, x = widen(q, width), widen(x, width)
    wide_q, wide_x = large(q), large(x)
    parts = []
    for own_q, own_x, plain in ((~wide_q, ~wide_x, True), (wide_q, np.ones(len(x), bool), False), (~wide_q, wide_x, False)):
        at_q, at_x = np.flatnonzero(own_q), np.flatnonzero(own_x)
        if not len(at_q) or not len(at_x):
            continue
        if plain:
            a, b, s = bounded(q[at_q], x[at_x], least[at_q])
        else:
            score = by_integers(q[at_q], x[at_x])
            a, b = np.nonzero(score >= least[at_q][:, None])
            s = score[a, b]
        parts.append((at_q[a], at_x[b], s))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *(p[k] for p in parts)]) for k in range(3))


def bounded(q: np.ndarray, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """survivors() of vectors whose products are exact in doubles, by branch and bound."""
    width = q.shape[1]
    order = np.argsort(-np.square(q).sum(axis=0), kind="stable")
    q, x = q[:, order], np.ascontiguousarray(x[:, order].T)  # a row a dimension
    starts = list(range(0, width, DIMS)) or [0]
    norm = lambda v, axis: np.sqrt(np.square(v).sum(axis=axis))
    rest_q = np.array([norm(q[:, at + DIMS :], 1) for at in starts])
    rest_x = np.array([norm(x[at + DIMS :], 0) for at in starts])
    part, cols, pairs = np.zeros((len(q), x.shape[1])), np.arange(x.shape[1]), None
    for k, at in enumerate(starts):
        block = slice(at, at + DIMS)
        if pairs is None:
            part += q[:, block] @ x[block]
            alive = part + rest_q[k][:, None] * rest_x[k][None, :] * (1 + 1e-9) + 1e-3 >= least[:, None]
            keep = alive.any(axis=0)
            if not keep.all():
                part, alive, x, rest_x, cols = part[:, keep], alive[:, keep], np.ascontiguousarray(x[:, keep]), rest_x[:, keep], cols[keep]
            if alive.size and alive.mean() < 0.05 or k == len(starts) - 1:
                a, b = np.nonzero(alive)
                pairs, score = (a, b), part[a, b]
        else:
            a, b = pairs
            score = score + np.einsum("ij,ji->i", q[a, block], x[block][:, b])
            alive = score + rest_q[k][a] * rest_x[k][b] * (1 + 1e-9) + 1e-3 >= least[a]
            pairs, score = (a[alive], b[alive]), score[alive]
    (a, b), score = pairs, np.rint(score).astype(np.int64)
    good = score >= least[a]
    return a[good], cols[b[good]], score[good]


def best(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each group, ties to smaller ids."""
    order = np.lexsort((ids, -scores, groups))
    g = groups[order]
    first = np.flatnonzero(np.diff(g, prepend=-1))
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[rank < k]


def _vectors(df: DataFrame, scale: float) -> DataFrame:
    """id and vector (binary doubles) of the rows that take part."""

    def run(batches):
        for batch in batches:
            rows, ints = matrix(batch.column(1), scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([v.tobytes() for v in ints], pa.binary())], names=["id", "vector"])

    return df.mapInArrow(run, "id long, vector binary")


def _stack(blobs: list[bytes]) -> np.ndarray:
    width = max((len(b) for b in blobs), default=0) // 8
    out = np.zeros((len(blobs), width))
    for i, b in enumerate(blobs):
        out[i, : len(b) // 8] = np.frombuffer(b)
    return out


QUERY = "id long, vector binary, key long, least double"


def seeded(asked: DataFrame, seed: list[tuple[int, bytes]], k: int) -> DataFrame:
    """QUERY rows of asked(id, vector): key tells apart different vectors of one id; least is the k-th best score among the seed."""
    shared = asked.sparkSession.sparkContext.broadcast(seed)

    def run(batches):
        ids, x = np.array([i for i, _ in shared.value], np.int64), _stack([v for _, v in shared.value])
        for batch in batches:
            q, own, low = _stack(batch.column(1).to_pylist()), batch.column(0).to_numpy(zero_copy_only=False), []
            for at in range(0, len(q), QUERY_BLOCK):
                part = q[at : at + QUERY_BLOCK]
                a, b, s = survivors(part, x, np.full(len(part), -np.inf))
                other = ids[b] != own[at : at + QUERY_BLOCK][a]
                a, b, s = a[other], b[other], s[other]
                top = best(a, s, ids[b], k)
                n, worst = np.bincount(a[top], minlength=len(part)), np.full(len(part), np.inf)
                np.minimum.at(worst, a[top], s[top].astype(float))
                low += np.where(n >= k, worst, -np.inf).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.float64())], names=["id", "vector", "key", "least"])

    return asked.withColumn("key", F.xxhash64("vector")).mapInArrow(run, QUERY)


def wave(rows: DataFrame, path: str, k: int, scale: float) -> DataFrame:
    """id, key, vec_id, score and rank of the k best of rows(id, vector) for each query in path, of those that reach the query's threshold."""

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(path)
        table = pads.dataset(base, filesystem=fs, format="parquet")

        def chunk(ids, x):
            for block in table.to_batches(columns=["id", "vector", "key", "least"], batch_size=QUERY_BLOCK, batch_readahead=1, fragment_readahead=1):
                if not block.num_rows:
                    continue
                own, keys, least = (block.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 3))
                a, b, s = survivors(_stack(block.column(1).to_pylist()), x, least)
                other = ids[b] != own[a]
                a, b, s = a[other], b[other], s[other]
                top = best(a, s, ids[b], k)
                a, b, s = a[top], b[top], s[top]
                yield pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(keys[a]), pa.array(ids[b]), pa.array(s)], names=["id", "key", "vec_id", "score"])

        held, count = [], 0
        for batch in batches:
            good, ints = matrix(batch.column(1), scale)
            for at in range(0, len(good), CHUNK):
                held.append((batch.column(0).to_numpy(zero_copy_only=False)[good[at : at + CHUNK]].astype(np.int64), ints[at : at + CHUNK]))
                count += len(held[-1][0])
                if count >= CHUNK:
                    width = max(v.shape[1] for _, v in held)
                    yield from chunk(np.concatenate([i for i, _ in held]), np.concatenate([widen(v, width) for _, v in held]))
                    held, count = [], 0
        if count:
            width = max(v.shape[1] for _, v in held)
            yield from chunk(np.concatenate([i for i, _ in held]), np.concatenate([widen(v, width) for _, v in held]))

    order = Window.partitionBy("id", "key").orderBy(F.col("score").desc(), F.col("vec_id"))
    return rows.mapInArrow(run, "id long, key long, vec_id long, score long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of vectors for each row of queries."""
    spark = vectors.sparkSession
    pick = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")]
    rows, asked = vectors.select(*pick).where("id is not null"), queries.select(*pick).where("id is not null")
    seed = [(r[0], bytes(r[1])) for r in _vectors(rows.limit(SEED_ROWS), scale).collect()]  # SEED_ROWS vectors at most
    path = scratch(spark, "queries")
    seeded(_vectors(asked, scale).dropDuplicates(), seed, k).write.mode("overwrite").parquet(path)
    shares, left = [], rows.count() // STEP
    while left > SEED_ROWS:
        shares, left = [STEP ** (len(shares) + 1), *shares], left // STEP
    for share in shares:  # the smallest first
        some = wave(rows.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0), path, k, scale)
        raised = some.where(F.col("rank") == k).select(F.col("id").alias("own"), F.col("key").alias("own_key"), F.col("score").cast("double").alias("now"))
        asked, path = spark.read.schema(QUERY).parquet(path), scratch(spark, "queries")
        asked = asked.join(raised, (F.col("id") == F.col("own")) & (F.col("key") == F.col("own_key")), "left").select("id", "vector", "key", F.greatest("least", "now").alias("least"))
        asked.write.mode("overwrite").parquet(path)
    return wave(rows, path, k, scale).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
