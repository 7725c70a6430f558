"""Benchmark decontamination by an FM-index per shard of documents.

Words are lower-cased runs of ASCII letters and digits and of all other non-ASCII characters. A pattern is a
window of 13 consecutive words of an item, or the whole of a shorter item. Words outside the patterns'
vocabulary cannot be part of an occurrence: they end a segment. A shard's segments, each with a terminator of
its own, are indexed whole: suffix array by prefix doubling, the Burrows-Wheeler transform in a wavelet tree,
and suffix positions sampled at every 16th place and at each segment's start. Patterns are searched backward,
all at once, by the tree's ranks; occurrences are located by steps back to the next sample; overlapping spans
of a document are merged. Segments shorter than the shortest pattern are left out, as nothing can lie in them.

Items are dealt by hash to blocks of about PATTERN_CHARS characters; a block's patterns are built by one task
and written to the shared folder. Every task reads its documents in shards and searches a shard's index for one
block of patterns after another, so that neither the driver nor a task ever holds the benchmark, and nothing is
broadcast. No row of documents is shuffled. A shard is bounded by its words; a longer segment is cut with an
overlap of 12 words.

Null or empty documents have no words and no hits; null or empty items have no window. Item ids are compared
as strings; a repeated item counts once, and one without an id hits words but is not listed. An empty
benchmark leaves every document clean. Repeated rows and ties are judged each for itself. All columns of the
documents are kept, but one called n_words, spans, n_hit or items gives way to the operator's.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, hash_runs, numbered, row_blocks, scratch, table, text_buffers

WINDOW = 13
SHARD_WORDS = 1 << 19
BLOCK_BYTES = 2 << 20
PATTERN_CHARS = 4 << 20
#: Bytes of documents that are searched for one block of patterns after another, where there are several.
HELD_BYTES = 16 << 20
SAMPLE = 16
WORD = table(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of rows of text, each row's first word, and the words' places in the bytes."""
    low = LOWER[data]
    starts, ends, rows = cut(low, offsets, WORD)
    return hash_runs(low, starts, ends), rows, starts, ends


class Wavelet:
    """Ranks over a sequence of small integers: a wavelet tree, one bit vector a level."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.n, self.ones, self.bits, self.zeros = len(seq), [], [], []
        for level in range(self.levels - 1, -1, -1):  # the wavelet matrix: zeros of a level go before its ones
            bit = (seq >> level & 1).astype(bool)
            self.bits.append(bit)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(at), at
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            a, b = self.ones[k][low], self.ones[k][high]
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at places."""
        out = np.zeros_like(at)
        for k in range(self.levels):
            bit = self.bits[k][at]
            ones = self.ones[k][at]
            out = out * 2 + bit
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return out


class FMIndex:
    """An index of segments of symbols from 1 on; symbol 0 ends each segment."""

    def __init__(self, seq: np.ndarray, symbols: int):
        n = len(seq)
        self.n = n
        ends = np.flatnonzero(seq == 0)
        rank = seq.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))  # terminators differ, by place
        order = np.argsort(rank, kind="stable")
        step = 1
        sorted_rank = rank[order]
        new = np.empty(n, bool)
        new[:1] = True
        new[1:] = sorted_rank[1:] != sorted_rank[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = first
        while True:  # prefix doubling over those that are not yet alone
            alone = new.copy()
            alone[:-1] &= new[1:]
            todo = np.flatnonzero(~alone)
            if not len(todo):
                break
            places = order[todo]
            second = rank[np.minimum(places + step, n - 1)]  # a tied suffix has not reached its terminator
            group = first[todo]
            by = np.argsort(group * np.int64(n + 1) + second, kind="stable")
            order[todo] = places[by]
            key1, key2 = group[by], second[by]
            fresh = np.ones(len(todo), bool)
            fresh[1:] = (key1[1:] != key1[:-1]) | (key2[1:] != key2[:-1])
            new[todo] = fresh
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            rank[order[todo]] = first[todo]
            step *= 2
        bwt = seq[order - 1]  # before the first place stands the last terminator
        self.tree = Wavelet(bwt, symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])
        starts = np.zeros(n, bool)
        starts[0] = True
        starts[ends[:-1] + 1] = True
        marked = starts[order] | (order % SAMPLE == 0)
        self.marked, self.mark_rank, self.samples = marked, np.cumsum(marked) - 1, order[marked]

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns, which stand at the right of a matrix padded by zeros at the left."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        width = patterns.shape[1]
        for k in range(width):
            live = live[sizes[live] > k]
            if not len(live):
                break
            symbol = patterns[live, width - 1 - k]
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
            gone = high[live] <= low[live]
            high[live[gone]] = low[live[gone]]
            live = live[~gone]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of suffixes, by steps back to a sampled one."""
        out, live, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(live):
            hit = self.marked[rows]
            out[live[hit]] = self.samples[self.mark_rank[rows[hit]]] + steps
            live, rows = live[~hit], rows[~hit]
            if len(live):
                symbol = self.tree.access(rows)
                rows = self.before[symbol] + self.tree.rank(symbol, rows)
            steps += 1
        return out


class Patterns:
    """Windows of items as rows of vocabulary numbers, with the items of each."""

    def __init__(self, items: list[tuple[str | None, str]]):
        names = sorted({i for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(names)}
        data, offsets = text_buffers(pa.array([t for _, t in items], pa.large_string()))
        hashes, rows, _, _ = words(data, offsets)
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        found: dict[bytes, set] = {}
        for k, (name, _) in enumerate(items):
            own = (ids[rows[k] : rows[k + 1]] + 1).astype(np.int64)
            size = min(WINDOW, len(own))
            for at in range(len(own) - size + 1 if size else 0):
                found.setdefault(own[at : at + size].tobytes(), set()).add(number.get(name, -1))
        self.names, self.items = names, [np.array(sorted(v - {-1}), np.int64) for v in found.values()]
        self.sizes = np.array([len(k) // 8 for k in found], np.int64)
        self.matrix = np.zeros((len(found), WINDOW), np.int64)
        for k, raw in enumerate(found):
            self.matrix[k, WINDOW - len(raw) // 8 :] = np.frombuffer(raw, np.int64)
        self.least = int(self.sizes.min()) if len(found) else 0


def shard_hits(p: Patterns, segments: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences in segments: their places (at: of each segment's first word) and their patterns."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    begin = np.cumsum(sizes + 1) - sizes - 1
    seq = np.zeros(int(sizes.sum()) + len(segments), np.int64)
    for b, s in zip(begin.tolist(), segments):
        seq[b : b + len(s)] = s
    index = FMIndex(seq, len(p.vocabulary) + 1)
    low, high = index.search(p.matrix, p.sizes)
    n = high - low
    pattern = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    place = index.locate(rows)
    segment = np.searchsorted(begin, place, "right") - 1
    return at[segment] + place - begin[segment], pattern


def block_hits(p: Patterns, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The occurrences' first words and patterns in rows of words, given by their hashes and each row's first word."""
    none = np.zeros(0, np.int64)
    if not len(p.sizes) or not len(hashes):
        return none, none
    found = np.minimum(np.searchsorted(p.vocabulary, hashes), len(p.vocabulary) - 1)
    ids = np.where(p.vocabulary[found] == hashes, found + 1, 0)
    known = ids > 0
    first, last = known.copy(), known.copy()
    first[1:] &= ~known[:-1]
    last[:-1] &= ~known[1:]
    edge = rows[1:-1]
    edge = edge[(edge > 0) & (edge < len(ids))]
    first[edge], last[edge - 1] = known[edge], known[edge - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = end - begin >= p.least
    begin, end = begin[long], end[long]
    places, patterns, segments, at, held = [none], [none], [], [], 0

    def flush():
        if segments:
            a, b = shard_hits(p, segments, np.array(at, np.int64))
            places.append(a)
            patterns.append(b)

    for b, e in zip(begin.tolist(), end.tolist()):
        while b < e:
            part = min(e, b + SHARD_WORDS)
            segments.append(ids[b:part])
            at.append(b)
            held += part - b
            b = e if part == e else part - WINDOW + 1
            if held >= SHARD_WORDS:
                flush()
                segments, at, held = [], [], 0
    flush()
    return np.concatenate(places), np.concatenate(patterns)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pattern_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> str:
    """Writes the items' patterns in blocks (pickled Patterns, a row each) and returns their path."""
    items = benchmark.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).head()[0]
    count = int(size // PATTERN_CHARS) + 1

    def build(group: pa.Table) -> pa.Table:
        block = Patterns(list(zip(group["name"].to_pylist(), group["text"].to_pylist())))
        return pa.table({"block": pa.array([pickle.dumps(block)], pa.binary())})

    path = scratch(benchmark.sparkSession, "patterns")
    dealt = items.distinct().withColumn("at", F.pmod(F.xxhash64("name", "text"), F.lit(count)))
    dealt.groupBy("at").applyInArrow(build, "block binary").write.mode("overwrite").parquet(path)
    return path


class Blocks:
    """The blocks of a path, read one at a time; a single one is kept."""

    def __init__(self, path: str):
        fs, base = pafs.FileSystem.from_uri(path)
        self.files, self.single = pads.dataset(base, filesystem=fs, format="parquet"), None
        self.count = self.files.count_rows() if self.files.files else 0

    def __iter__(self):
        if self.single is not None:
            yield self.single
            return
        if not self.count:
            return
        for batch in self.files.to_batches(columns=["block"], batch_size=1, batch_readahead=1, fragment_readahead=1):
            for raw in batch.column(0):
                block = pickle.loads(raw.as_buffer())
                if self.count == 1:
                    self.single = block
                yield block


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """All columns of docs, with n_words, spans (disjoint half-open word spans to remove), n_hit and items (sorted ids)."""
    rows, own, at = numbered(docs, ["n_words", "spans", "n_hit", "items"], text_col)
    names, path = rows.columns, pattern_blocks(benchmark, item_col, item_text)
    span_type, item_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.list_(pa.string())

    def searched(batches: list, blocks: Blocks):
        """The batches with their columns; all of them are searched for a block before the next is read."""
        counts = [np.zeros(batch.num_rows, np.int64) for batch in batches]
        spans: list[dict] = [{} for _ in batches]
        items: list[dict] = [{} for _ in batches]
        parts = []
        for n, batch in enumerate(batches):
            data, offsets = text_buffers(batch.column(at))
            for a, b in row_blocks(offsets, BLOCK_BYTES):
                hashes, first, _, _ = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                counts[n][a:b] = np.diff(first)
                parts.append((n, a, hashes, first))
        for p in blocks:
            for n, a, hashes, first in parts:
                place, pattern = block_hits(p, hashes, first)
                doc = np.searchsorted(first, place, "right") - 1
                order = np.argsort(doc, kind="stable")
                doc, place, pattern = doc[order], place[order], pattern[order]
                edges = np.flatnonzero(np.diff(doc, prepend=-1))
                for s, e in zip(edges, [*edges[1:], len(doc)]):
                    d, base = a + int(doc[s]), int(first[doc[s]])
                    new = [(int(x) - base, int(x) - base + int(m)) for x, m in zip(place[s:e], p.sizes[pattern[s:e]])]
                    spans[n][d] = merge(spans[n].get(d, []) + new)
                    items[n].setdefault(d, set()).update(p.names[k] for w in set(pattern[s:e].tolist()) for k in p.items[w].tolist())
        for n, batch in enumerate(batches):
            found = [[{"a": x, "b": y} for x, y in spans[n].get(d, ())] for d in range(batch.num_rows)]
            listed = [sorted(items[n].get(d, ())) for d in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts[n]), pa.array(found, span_type), pa.array(listed, item_type)], names=[*names, "n_words", "spans", "items"])

    def run(batches):
        blocks, held, size = Blocks(path), [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= HELD_BYTES or blocks.count <= 1:
                yield from searched(held, blocks)
                held, size = [], 0
        if held:
            yield from searched(held, blocks)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.mapInArrow(run, f"{kinds}, n_words long, spans array<struct<a:long,b:long>>, items array<string>")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"])
    return out.select(*[F.col(n) for n in names], "n_words", "spans", hit.alias("n_hit"), "items").toDF(*own, "n_words", "spans", "n_hit", "items")


def contaminated():
    """A twentieth of the words or more are hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
