"""Packing by minimum bin slack.

Each task tokenises its documents and packs them window by window. A document's full sequences of `capacity`
ids stand alone; what is left of it is an item. For every bin the longest item is the anchor, and a bitset
subset-sum over the remaining lengths, with their counts, finds the multiset that fills the rest closest to
capacity; the counts are backtracked through the stored bitsets. Slack that no multiset can fill is filled by
cutting another item. What is left at a task's end goes into sequences whose lengths are powers of two, which
take no padding. No row leaves its task, so nothing is shuffled; what a task holds is bounded by the window.

Null text counts as empty (a document of the end id alone); a null identifier is carried; repeated rows are
packed each for itself; an empty table gives no pieces. Sequence ids are unique in a result: the partition's
number, shifted, plus a counter.
"""

from __future__ import annotations

from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, LOWER, cut, hash_runs, kept, row_blocks, table, text_buffers

CAPACITY = 4096
WINDOW = 1 << 20
BLOCK = 1 << 20
CACHED = 500_000
LETTER, STOP = table(b"abcdefghijklmnopqrstuvwxyz"), table(b".,")


def _byte_chars() -> dict[int, int]:
    """The byte-level alphabet: bytes that print stand for themselves, the others for characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in shown)}


BYTE_CHARS = _byte_chars()


class ChunkTokenizer:
    """A word-level BPE tokenizer over whole texts, with the ids of chunks kept by hash.

    The tokenizer works on pieces between white space, and a run of letters ends where ASCII punctuation
    begins, so that a text's ids are those of its chunks in a row. Chunks are cut at ASCII white space and
    between a-z and a full stop or comma. Lower-casing A-Z beforehand changes nothing, but for special
    tokens: blocks with `<|` are tokenised as they are.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, chunks: list[bytes]) -> list[list[int]]:
        model, whole, out = self.tokenizer.model.tokenize, self.tokenizer.encode, []
        for chunk in chunks:
            word = chunk.decode()
            if word.isascii() and word.isalpha() and word.islower():
                out.append([t.id for t in model(word)])
            elif word.isalpha() and word == word.lower() and is_normalized("NFC", word):  # a run of letters, as the model sees it
                out.append([t.id for t in model(chunk.decode("latin-1").translate(BYTE_CHARS))])
            else:
                out.append(whole(word, add_special_tokens=False).ids)
        return out

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in a row, and where each row's ids begin and end."""
        raw = data.tobytes()
        if b"<|" not in raw:
            data = LOWER[data]
            raw = data.tobytes()
        letter, stop = LETTER[data], STOP[data]
        starts, ends, rows = cut(data, offsets, ~ASCII_SPACE, letter[:-1] & stop[1:] | stop[:-1] & letter[1:])
        hashes = hash_runs(data, starts, ends)
        found, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHED:
            self.clear()
        at = np.searchsorted(self.keys, found)
        known = np.zeros(len(found), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == found[inside]
        if not known.all():
            new = first[~known]
            lists = self._encode([raw[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist())])
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            more = np.fromiter((i for x in lists for i in x), np.uint32, int(counts.sum()))
            begin = len(self.ids) + np.cumsum(counts) - counts
            slots = len(self.start) + np.arange(len(new))
            self.ids = np.concatenate([self.ids, more])
            self.start, self.count = np.concatenate([self.start, begin]), np.concatenate([self.count, counts])
            keys, slot = np.concatenate([self.keys, found[~known]]), np.concatenate([self.slot, slots])
            order = np.argsort(keys, kind="stable")
            self.keys, self.slot = keys[order], slot[order]
            at = np.searchsorted(self.keys, found)
        chunk = self.slot[at][back]
        counts = self.count[chunk]
        total = np.concatenate([[0], np.cumsum(counts)])
        where = np.repeat(self.start[chunk] - total[:-1], counts) + np.arange(total[-1])
        return self.ids[where], total[rows]


def tokenizer(path: str) -> ChunkTokenizer:
    """One a Python worker, until another operator's task clears it."""
    return kept(f"tokenizer {path}", lambda: ChunkTokenizer(path))


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Of the lengths with their counts, the multiset whose sum is closest to capacity, not above it."""
    if capacity <= 0 or not counts:
        return {}
    full, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        if length > capacity:
            continue
        left, size = counts[length], 1
        while left > 0:  # counts as sums of powers of two
            n = min(size, left)
            if n * length > capacity:
                n = capacity // length
                left = n
            if n <= 0:
                break
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & full
            left -= n
            size *= 2
        if reach >> capacity & 1:
            break
    target, out = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> target & 1:
            out[length] = out.get(length, 0) + n
            target -= length * n
    return out


class Packer:
    """Items by length; bins come out as lists of pieces (document, start, length)."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.total = capacity, {}, 0

    def add(self, doc: int, start: int, length: int) -> None:
        if length:
            self.items.setdefault(length, []).append((doc, start))
            self.total += length

    def take(self, length: int) -> tuple[int, int, int]:
        doc, start = self.items[length].pop()
        if not self.items[length]:
            del self.items[length]
        self.total -= length
        return doc, start, length

    def bins(self):
        """Bins as long as one can be filled."""
        while self.total >= self.capacity:
            anchor = max(self.items)
            out = [self.take(anchor)]
            chosen = fill({n: len(v) for n, v in self.items.items()}, self.capacity - anchor)
            for length, n in chosen.items():
                out += [self.take(length) for _ in range(n)]
            slack = self.capacity - sum(x[2] for x in out)
            while slack:  # the longest item that remains gives its beginning
                doc, start, length = self.take(max(self.items))
                part = min(slack, length)
                out.append((doc, start, part))
                self.add(doc, start + part, length - part)
                slack -= part
            yield out

    def rest(self):
        """What is left, in sequences whose lengths are powers of two."""
        while self.total:
            room, out = 1 << (self.total.bit_length() - 1), []
            chosen = fill({n: len(v) for n, v in self.items.items()}, room)
            for length, n in chosen.items():
                out += [self.take(length) for _ in range(n)]
            room -= sum(x[2] for x in out)
            while room:
                doc, start, length = self.take(max(self.items))
                part = min(room, length)
                out.append((doc, start, part))
                self.add(doc, start + part, length - part)
                room -= part
            yield out


SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tok, packer, sequence = tokenizer(tokenizer_path), Packer(capacity), TaskContext.get().partitionId() << 36
        held: list[bytes] = []
        names: list = []
        waiting = 0

        def out(bins):
            nonlocal sequence
            rows = []
            for pieces in bins:
                offset = 0
                for doc, start, length in pieces:
                    rows.append((names[doc], start, length, held[doc][4 * start : 4 * (start + length)], len(held[doc]) // 4, sequence, offset))
                    offset += length
                sequence += 1
            cols = list(zip(*rows)) or [()] * 7
            types = [names_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for at in range(0, max(1, len(rows)), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 2000], t) for c, t in zip(cols, types)], names=["doc_id", *[x.split()[0] for x in SCHEMA.split(", ")]])

        names_type = None
        for batch in batches:
            names_type = batch.schema.field(0).type
            ids_in = batch.column(0).to_pylist()
            data, offsets = text_buffers(batch.column(1))
            for a, b in row_blocks(offsets, BLOCK):
                ids, ends = tok.block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for k in range(b - a):
                    own = np.append(ids[ends[k] : ends[k + 1]], np.uint32(end_id)).astype("<u4")
                    doc = len(names)
                    names.append(ids_in[a + k])
                    held.append(own.tobytes())
                    full = len(own) // capacity
                    if full:
                        yield from out([[(doc, i * capacity, capacity)] for i in range(full)])
                    packer.add(doc, full * capacity, len(own) - full * capacity)
                    waiting += len(own)
                    if waiting >= window:
                        yield from out(packer.bins())
                        keep = {d for v in packer.items.values() for d, _ in v}  # of the next window
                        moved = {d: i for i, d in enumerate(sorted(keep))}
                        names[:], held[:] = [names[d] for d in sorted(keep)], [held[d] for d in sorted(keep)]
                        for v in packer.items.values():
                            v[:] = [(moved[d], s) for d, s in v]
                        waiting = 0
        if names_type is not None:
            yield from out(packer.bins())
            yield from out(packer.rest())

    return docs.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
