"""Language identification by multilingual mixture inference.

Learning: byte trigrams of words (with their ends) are counted for each language over all learning documents
and summed by Spark; a language's table has BUCKETS smoothed log-probabilities, of hashed trigrams, so its
size does not grow with the corpus. Inference: each word of a document has a likelihood under each language;
expectation-maximisation estimates the document's proportions, all documents of a block at once. Language sets
are nested by proportion: one language more is taken as long as the refitted likelihood grows by more than a
penalty of PENALTY times the logarithm of the number of words. The prediction is the language with the largest
proportion of the set chosen, its score that proportion. Equal words of a document have equal likelihoods, so
they are one row with a count.

Null, empty and letterless texts are `und` with score 0, as are all texts where nothing could be learnt. Rows
whose lang is null teach nothing; documents without an id are neither learnt from nor held out. Ties go to the
language that sorts first. Repeated rows count and come out each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, hash_runs, row_blocks, table, text_buffers

BUCKETS = 1 << 16
SMOOTH = 0.5
STEPS = 8
PENALTY = 3.0
BLOCK_BYTES = 2 << 20
LETTERS = table(b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
ASCII_LETTERS = table(b"abcdefghijklmnopqrstuvwxyz")


def block_words(data: np.ndarray, offsets: np.ndarray):
    """Of rows of text: each word's row and number, and the different words' trigram buckets with where each word's begin and end."""
    low = LOWER[data]
    starts, ends, rows = cut(low, offsets, LETTERS)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    _, first, number = np.unique(hash_runs(low, starts, ends), return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    sizes = e - s  # a word of n bytes has n trigrams, with a space at either end
    at = np.concatenate([[0], np.cumsum(sizes)])
    where = np.repeat(s - at[:-1], sizes) + np.arange(at[-1])
    lead, tail = np.zeros(at[-1], bool), np.zeros(at[-1], bool)
    lead[at[:-1]], tail[at[1:] - 1] = True, True
    padded = np.concatenate([[32], low, [32]]).astype(np.uint32)
    before, here, after = padded[where], padded[where + 1], padded[where + 2]
    before[lead], after[tail] = 32, 32
    code = (before * np.uint32(0x9E3779B1)) ^ (here * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return of, number, (code >> np.uint32(16)).astype(np.int64) % BUCKETS, at


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """The languages in order and their tables of log-probabilities."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, offsets = text_buffers(batch.column(1))
            for a, b in row_blocks(offsets, BLOCK_BYTES):
                of, number, codes, at = block_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                kinds = {x: i for i, x in enumerate(sorted(set(langs[a:b])))}
                if not len(number):
                    continue
                own = np.array([kinds[x] for x in langs[a:b]])[of]
                words = len(at) - 1
                for lang, i in kinds.items():
                    weight = np.repeat(np.bincount(number[own == i], minlength=words), np.diff(at))
                    sums[lang] = sums.get(lang, 0) + np.bincount(codes, weight, BUCKETS)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["lang", "bucket", "n"])

    found = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col)).mapInArrow(run, "lang string, bucket int, n long")
    rows = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows a language at most
    names = sorted(set(rows["lang"].to_pylist()))
    counts = np.zeros((len(names), BUCKETS))
    place = {x: i for i, x in enumerate(names)}
    counts[[place[x] for x in rows["lang"].to_pylist()], rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    counts += SMOOTH
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def proportions(like: np.ndarray, of: np.ndarray, times: np.ndarray, allowed: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: each row's proportions of its allowed languages, and its log-likelihood (of scaled likelihoods). Word k of row of[k] occurs times[k] times."""
    n = len(allowed)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    words = np.maximum(np.bincount(of, times, n), 1)[:, None]
    for step in range(steps + 1):
        mixed = like * share[of]
        total = np.maximum(mixed.sum(axis=1), 1e-300)
        if step == steps:
            break
        mixed *= (times / total)[:, None]
        share = np.column_stack([np.bincount(of, mixed[:, k], n) for k in range(like.shape[1])]) / words
    return share, np.bincount(of, times * np.log(total), n)


def infer(data: np.ndarray, offsets: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of text with words: the language's number and its proportion; -1 for rows without words."""
    n = len(offsets) - 1
    of, number, codes, at = block_words(data, offsets)
    best, score = np.full(n, -1), np.zeros(n)
    if not len(of):
        return best, score
    word = np.column_stack([np.add.reduceat(t[codes], at[:-1]) for t in tables.astype(np.float64)])
    kinds, times = np.unique(of * np.int64(len(at)) + number, return_counts=True)
    of, number, times = kinds // len(at), kinds % len(at), times.astype(float)
    like = np.exp(np.maximum(word - word.max(axis=1, keepdims=True), -40.0))[number]
    rows, own = np.unique(of, return_inverse=True)
    count = np.bincount(own, times)
    share, _ = proportions(like, own, times, np.ones((len(rows), len(tables))))
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(tables))[None, :].repeat(len(rows), 0), axis=1)
    chosen, value = proportions(like, own, times, (rank < 1).astype(float), 0)
    value = value - PENALTY * np.log(count + 1)
    live = np.arange(len(rows))
    for size in range(2, len(tables) + 1):  # a language more, for the rows that gained by the last
        keep = np.zeros(len(rows), bool)
        keep[live] = True
        some = keep[own]
        local = np.cumsum(keep) - 1
        part, got = proportions(like[some], local[own[some]], times[some], (rank[live] < size).astype(float))
        got = got - PENALTY * size * np.log(count[live] + 1)
        better = got > value[live]
        chosen[live[better]], value[live[better]] = part[better], got[better]
        live = live[better]
        if not len(live):
            break
    best[rows] = chosen.argmax(axis=1)
    score[rows] = chosen.max(axis=1)
    return best, score


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred and score of every document, learnt from those that are not held out."""
    names, tables = learn(docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)), lang_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    narrow = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            langs, scores = [], []
            for a, b in row_blocks(offsets, BLOCK_BYTES):
                part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                best, score = infer(part, local, shared.value) if names else (np.full(b - a, -1), np.zeros(b - a))
                total = np.concatenate([[0], np.cumsum(ASCII_LETTERS[LOWER[part]])])
                for i in np.flatnonzero((total[local[1:]] == total[local[:-1]]) & (best >= 0)):
                    if not any(map(str.isalpha, part[local[i] : local[i + 1]].tobytes().decode())):
                        best[i], score[i] = -1, 0.0
                langs += [names[k] if k >= 0 else "und" for k in best.tolist()]
                scores += np.clip(np.round(score, 6), 0, 1).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
