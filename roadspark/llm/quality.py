"""Quality scores by regularised quadratic discriminant analysis over document statistics.

Every document's text gives a vector of statistics (lengths, character classes, repetition of words, pairs,
triples and lines), made even by logarithms and square roots. Each class has a Gaussian: its mean, and its
covariance shrunk towards the covariance of both classes together and towards that one's diagonal. The
Cholesky factors are computed once; a score is the class log-density difference, from Mahalanobis distances
by triangular solves, plus the log prior odds, through the logistic function.

Class counts, sums and products of statistics are summed by Spark over all labelled rows; the driver gets one
matrix a class. `classify` computes statistics once and keeps them as a table in the shared folder, which both
fitting and scoring read; `learnt` describes labelled documents only. Labels are broadcast up to BROADCAST_ROWS
rows, else documents are shuffled.

Null and empty texts have the statistics of an empty text and a score as any other. Rows without an id are
scored and never fitted; repeated labels count each. With labels of fewer than two classes the score is the
share of label 1 (0.5 without labels). An empty table gives no rows. `score_texts` keeps all columns of the
documents; one that is called score gives way to the operator's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, BROADCAST_ROWS, LOWER, cut, forgotten, hash_runs, mix, numbered, row_blocks, stored, table, text_buffers

BLOCK_BYTES = 1 << 20
#: Bytes of a line that are hashed as one run.
LINE_BLOCK = 128
#: Character classes whose counts are statistics.
CLASSES = (
    table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    table(b"0123456789"),
    table(b".,"),
    table(b"!?"),
    table(b"#$%&*+/<=>@\\^_`{|}~[]"),
    table(b"\"'()-:;"),
    table(b"\n"),
    table(bytes(range(128, 256))),
)
FEATURES = 24
RIDGE = 1e-3
POOL, DIAGONAL = 0.1, 0.05


def distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n rows, how many different hashes it has, and the count of its most frequent one."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, r[at], np.diff(np.append(at, len(r))))
    return np.bincount(r[at], minlength=n), most


def hash_lines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of whole lines: the hashes of a line's blocks, mixed with their place and summed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    blocks = -(-(ends - starts) // LINE_BLOCK)
    first = np.cumsum(blocks) - blocks
    line = np.repeat(np.arange(len(starts)), blocks)
    place = np.arange(len(line)) - first[line]
    at = starts[line] + place * LINE_BLOCK
    hashes = hash_runs(data, at, np.minimum(at + LINE_BLOCK, ends[line]))
    return np.add.reduceat(mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A matrix of FEATURES statistics for rows of text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    counts = []
    for chars in CLASSES:
        total = np.concatenate([[0], np.cumsum(chars[data])])
        counts.append((total[offsets[1:]] - total[offsets[:-1]]).astype(float))
    low = LOWER[data]
    starts, ends, rows = cut(low, offsets, ~ASCII_SPACE)
    words = np.diff(rows).astype(float)
    of = np.repeat(np.arange(n), np.diff(rows))
    sizes = (ends - starts).astype(float)
    hashes = hash_runs(low, starts, ends)
    mean = np.bincount(of, sizes, n) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(np.bincount(of, sizes**2, n) / np.maximum(words, 1) - mean**2, 0))
    short = np.bincount(of, sizes <= 3, n) / np.maximum(words, 1)
    long = np.bincount(of, sizes >= 15, n) / np.maximum(words, 1)
    tail = CLASSES[3] | CLASSES[4]
    marked = np.bincount(of, tail[low[ends - 1]] if len(ends) else sizes, n) / np.maximum(words, 1)
    kinds, most = distinct(of, hashes, n)
    grams = []
    for k in (2, 3):
        same = of[k - 1 :] == of[: len(of) - k + 1] if len(of) >= k else np.zeros(0, bool)
        h = np.zeros(len(same), np.uint64)
        for j in range(k):
            h = mix(h + hashes[j : j + len(same)])
        own = of[k - 1 :][same] if len(of) >= k else of[:0]
        different, _ = distinct(own, h[same], n)
        grams.append(different / np.maximum(words - k + 1, 1))
    ls, le, lrows = cut(low, offsets, ~CLASSES[6])
    lof = np.repeat(np.arange(n), np.diff(lrows))
    lines = np.diff(lrows).astype(float)
    line_kinds, _ = distinct(lof, hash_lines(low, ls, le), n)
    longest = np.zeros(n)
    np.maximum.at(longest, lof, (le - ls).astype(float))
    share = [np.sqrt(c / np.maximum(size, 1)) for c in counts]
    stops = np.sqrt(counts[2] / np.maximum(words, 1))
    return np.column_stack(
        [
            np.log1p(size), np.log1p(words), np.log1p(mean), np.log1p(spread), short, np.sqrt(long), marked, *share, stops,
            np.log1p(kinds) / np.log(np.maximum(words, 1) + 2), np.sqrt(most / np.maximum(words, 1)), *[np.sqrt(np.maximum(1 - g, 0)) for g in grams],
            np.log1p(lines), line_kinds / np.maximum(lines, 1), np.log1p(longest), np.sqrt(words / np.maximum(size, 1)),
        ]
    )


def described(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with a column of statistics instead of its text (or with keep's columns only)."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    names = [f"c{k}" for k in range(len(keep))]
    narrow = docs.select(F.col(text_col).cast("string").alias("body"), *[F.col(c).alias(n) for c, n in zip(keep, names)])

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            parts = [statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_blocks(offsets, BLOCK_BYTES)]
            flat = np.concatenate(parts).reshape(-1) if parts else np.zeros(0)
            stats = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, FEATURES, dtype=np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], stats], names=[*names, "stats"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[1:])
    return narrow.mapInArrow(run, f"{kinds}, stats array<double>").toDF(*keep, "stats")


class Model:
    """Means, Cholesky factors and prior of two classes."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        counts = {c: sums[c][0] for c in (0, 1)}
        total = sum(counts.values())
        self.prior = counts[1] / total if total else 0.5
        self.fitted = min(counts.values()) >= 2
        if not self.fitted:
            return
        first, second = sum(sums[c][1] for c in (0, 1)), sum(sums[c][2] for c in (0, 1))
        centre = first / total
        scale = np.sqrt(np.maximum(np.diag(second) / total - centre**2, 1e-12))
        self.centre, self.scale = centre, scale
        means, spreads = [], []
        for c in (0, 1):
            n, s1, s2 = sums[c]
            mean = s1 / n
            spreads.append((s2 / n - np.outer(mean, mean)) / np.outer(scale, scale))
            means.append((mean - centre) / scale)
        pooled = sum(counts[c] * spreads[c] for c in (0, 1)) / total
        self.means, self.factors, self.logs = means, [], []
        for c in (0, 1):
            own = FEATURES / (counts[c] + FEATURES)  # few rows lean on the pool
            lean = max(POOL, own)
            shrunk = (1 - lean) * spreads[c] + lean * pooled
            shrunk = (1 - DIAGONAL) * shrunk + DIAGONAL * np.diag(np.diag(pooled)) + RIDGE * np.eye(FEATURES)
            factor = np.linalg.cholesky(shrunk)
            self.factors.append(np.linalg.inv(factor))
            self.logs.append(2 * np.log(np.diag(factor)).sum())

    def score(self, stats: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        if not self.fitted:
            return np.full(len(stats), self.prior)
        x = (stats - self.centre) / self.scale
        far = [np.square((x - m) @ f.T).sum(axis=1) + log for m, f, log in zip(self.means, self.factors, self.logs)]
        odds = (far[0] - far[1]) / 2 + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(labelled: DataFrame) -> Model:
    """From rows (label 0 or 1, stats): Spark sums over all rows, one matrix a class comes to the driver."""
    size = 1 + FEATURES + FEATURES * FEATURES

    def partial(batches):
        sums = np.zeros((2, size))
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            for c in (0, 1):
                own = x[label == c]
                sums[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)])
        at = np.arange(2 * size)
        yield pa.RecordBatch.from_arrays([pa.array(at // size), pa.array(at % size), pa.array(sums.reshape(-1))], names=["label", "at", "value"])

    found = labelled.where(F.col("label").isin(0, 1)).select(F.col("label").cast("int"), "stats").mapInArrow(partial, "label long, at long, value double")
    sums = np.zeros((2, size))
    for label, at, value in found.groupBy("label", "at").agg(F.sum("value")).collect():  # 2 * size rows at most
        sums[label, at] = value
    return Model({c: (sums[c, 0], sums[c, 1 : 1 + FEATURES], sums[c, 1 + FEATURES :].reshape(FEATURES, FEATURES)) for c in (0, 1)})


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """stats with a column score."""
    names = [f"c{k}" for k in range(len(stats.columns))]
    at = stats.columns.index("stats")
    plain = stats.toDF(*names)

    def run(batches):
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(model.score(x), 9))], names=[*names, "score"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(run, f"{kinds}, score double").toDF(*stats.columns, "score")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def score_texts(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of docs with a column score, in one pass over the texts."""
    plain, own, at = numbered(docs, ["score"], text_col)
    names = plain.columns

    def run(batches):
        forgotten()
        for batch in batches:
            data, offsets = text_buffers(batch.column(at))
            parts = [model.score(statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in row_blocks(offsets, BLOCK_BYTES)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(np.concatenate([*parts, np.zeros(0)]), 9))], names=[*names, "score"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(run, f"{kinds}, score double").toDF(*own, "score")


def marks(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """label_id and label of the labels that teach something: 0 or 1, of an id that is not held out."""
    own = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label"))
    return own.where(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out("label_id"))


def bounded(marked: DataFrame) -> DataFrame:
    """marked, to be broadcast if it is small."""
    return F.broadcast(marked) if marked.count() <= BROADCAST_ROWS else marked


def learnt(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model of the labelled documents that are not held out; other texts are not looked at."""
    marked = bounded(marks(labels, id_col, label_col))
    narrow = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("body"))
    return fit(described(narrow.join(marked, F.col("own_id") == F.col("label_id")), "body", ["label"]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, held_out and score of every document, learnt from the labelled documents that are not held out."""
    stats = stored(described(docs, text_col, [id_col]), "statistics")
    marked = bounded(marks(labels, id_col, label_col))
    model = fit(stats.join(marked, F.col(id_col) == F.col("label_id")).select("label", "stats"))
    return scored(stats, model).select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score")
