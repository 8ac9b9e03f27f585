"""Order-preserving packing by dynamic programming.

Documents, in the order in which a partition holds them, form one run of token ids. Windows of at most `capacity` ids cut that run. A cut may fall at the end
of a document (free), at the end of a sentence, or, where neither is near, at one of a grid of places inside a sentence (dearer). With
f(j) the least cost of cutting the run up to place j,

    f(j) = penalty(j) + window + min( min over i >= j - capacity of f(i) + i  + capacity - j,  f(j - 2^k) for each power of two )

since a window is padded to the capacity unless its length is a power of two. The inner minimum slides, so a monotone queue finds it in constant time.
A task holds only a chunk of the run: the last window of a chunk is open and goes on with the next.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame

from gridscape.llm.common import ids as key_and_text
from gridscape.llm.common import bounded_batches, named

CAPACITY = 1024
SENTENCE_PENALTY = 2
INSIDE_PENALTY = 8
#: What any window costs beside its padding, so that short ones don't multiply.
WINDOW_PENALTY = 32
GRID = 16
#: A window that isn't padded has at least this part of the capacity: one token, so that every power of two counts.
SHORTEST = CAPACITY
CHUNK_TOKENS = 1 << 19
#: Characters on which both libraries split alike; a text with any other, or with an added token's string, goes to `tokenizers`.
PLAIN = "[^\t\n\r\x20-\x7e¡-ſ]"


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level vocabulary: the file for `tokenizers`, whose ids count, and the same as ranks for `tiktoken`, which is faster on plain texts."""

    json_path: str
    ranks_path: str | None = None
    pattern: str | None = None


@lru_cache(maxsize=2)
def _loaded(v: Vocabulary):
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(v.json_path)
    fast = None
    if v.ranks_path:
        with open(v.ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        fast = tiktoken.Encoding("plain", pat_str=v.pattern, mergeable_ranks=ranks, special_tokens={})
    ends = np.zeros(slow.get_vocab_size(), bool)
    for token, at in slow.get_vocab().items():
        ends[at] = token[-1:] in (".", "!", "?", "Ċ")  # the last is the line feed's letter in byte-level vocabularies
    added = sorted((x.content for x in slow.get_added_tokens_decoder().values() if x.content), key=len, reverse=True)
    return slow, fast, ends, re.compile("|".join([PLAIN, *map(re.escape, added)]))


def encode(v: Vocabulary, text: str) -> np.ndarray:
    slow, fast, _, other = _loaded(v)
    if not text:
        return np.empty(0, np.uint32)
    if fast is None or other.search(text):
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


def cut_places(tokens: np.ndarray, document_ends: np.ndarray, ends_sentence: np.ndarray, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """(places, penalties): where the run may be cut; the first is 0 and the last its end."""
    n = len(tokens)
    penalty = np.full(n + 1, -1, np.int64)
    penalty[1:][ends_sentence[tokens]] = SENTENCE_PENALTY
    penalty[document_ends] = 0
    penalty[[0, n]] = 0
    known = np.flatnonzero(penalty >= 0)
    gaps = np.diff(known)
    wide = np.flatnonzero(gaps > grid)
    if len(wide):
        steps = (gaps[wide] - 1) // grid
        first = np.repeat(known[wide], steps)
        k = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps) + 1
        penalty[first + k * grid] = INSIDE_PENALTY
    places = np.flatnonzero(penalty >= 0)
    return places, penalty[places]


def best_cuts(places: np.ndarray, penalties: np.ndarray, capacity: int = CAPACITY) -> tuple[list[int], int]:
    """(the cuts, first and last place included; their cost): exact over the given places, each of which is within `capacity` of the one before."""
    n, at, pen = len(places), places.tolist(), (penalties + WINDOW_PENALTY).tolist()
    ends, starts = [], []  # of windows that need no padding, the larger first
    size = capacity // 2
    while size >= max(1, capacity // SHORTEST):
        i = np.minimum(np.searchsorted(places, places - size), n - 1)
        j = np.flatnonzero(places[i] == places - size)
        ends.append(j)
        starts.append(i[j])
        size //= 2
    of = np.concatenate(ends) if ends else np.empty(0, np.int64)
    order = np.argsort(of, kind="stable")
    shorter = np.concatenate(starts)[order].tolist() if ends else []
    first = np.searchsorted(of[order], np.arange(n + 1)).tolist()
    f, back = [0] * n, [0] * n
    # the queue: f(i) + place of i, rising, of the places in reach; its head moves on
    value, place, index, head = [at[0]], [at[0]], [0], 0
    for j in range(1, n):
        here = at[j]
        low = here - capacity
        while place[head] < low:
            head += 1
        best, i = value[head] + capacity - here, index[head]
        for k in shorter[first[j] : first[j + 1]]:
            if f[k] < best:
                best, i = f[k], k
        f[j] = best = best + pen[j]
        back[j] = i
        best += here
        while len(value) > head and value[-1] > best:
            value.pop()
            place.pop()
            index.pop()
        value.append(best)
        place.append(here)
        index.append(j)
    cuts, j = [at[-1]], len(at) - 1
    while j:
        j = back[j]
        cuts.append(at[j])
    return cuts[::-1], f[-1]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Packer:
    """The open part of one partition's run."""

    def __init__(self, v: Vocabulary, capacity: int, with_ids: bool, base: int) -> None:
        self.v, self.capacity, self.with_ids, self.next = v, capacity, with_ids, base
        self.parts: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, its ids in all, start, ids
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.parts.append((doc_id, len(ids), 0, ids))
        self.size += len(ids)

    def pack(self, final: bool) -> pa.RecordBatch:
        out: list[tuple] = []
        if self.parts:
            run = np.concatenate([p[3] for p in self.parts])
            ends = np.cumsum([len(p[3]) for p in self.parts])
            cuts, _ = best_cuts(*cut_places(run, ends, _loaded(self.v)[2]), self.capacity)
            last = cuts[-1] if final else cuts[-2]
            starts = ends - [len(p[3]) for p in self.parts]
            borders = np.unique(np.concatenate([[0], ends, cuts]))
            borders = borders[borders <= last]
            window = np.searchsorted(cuts, borders[:-1], side="right") - 1
            owner = np.searchsorted(ends, borders[:-1], side="right")
            for a, b, w, k in zip(borders[:-1].tolist(), borders[1:].tolist(), window.tolist(), owner.tolist(), strict=True):
                doc_id, total, first, _ = self.parts[k]
                ids = run[a:b]
                out.append((doc_id, first + a - int(starts[k]), b - a, zlib.crc32(ids.astype("<u4").tobytes()), total, self.next + w, a - cuts[w], *([ids] if self.with_ids else [])))
            self.next += int(np.searchsorted(cuts, last))
            self.parts = [(d, t, s + max(0, last - int(x)), ids[max(0, last - int(x)) :]) for (d, t, s, ids), x, e in zip(self.parts, starts, ends, strict=True) if e > last]
            self.size = len(run) - last
        columns = list(zip(*out, strict=True)) or [[] for _ in range(7 + self.with_ids)]
        arrays = [pa.array(c, pa.list_(pa.int32()) if k == 7 else pa.int64()) for k, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays(arrays, [*(c.split()[0] for c in SCHEMA.split(", ")), "ids"][: len(arrays)])


def pack(df: DataFrame, vocabulary: Vocabulary, *, order: list[Column] | None = None, capacity: int = CAPACITY, end_id: int = 0, text: str = "text", key: str = "doc_id", with_ids: bool = False, chunk: int = CHUNK_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for.

    A document's ids are those of its text and `end_id`. A null text is empty: its one id is `end_id`. A null key stays; repeated rows are documents of their
    own; other columns aren't read. An empty table gives an empty result. A document longer than a window is cut as the costs say.
    sequence_id is unique over all partitions: the partition's number and a count. With `order`, columns of df that sort its rows, texts move once, by
    range, and sequences and the pieces in them follow that order; without, they follow each partition's, and nothing moves.
    """
    rows = key_and_text(df, text, key)
    if order:
        by = [f"_by{i}" for i in range(len(order))]
        keyed = df.select(named(key).cast("long").alias("doc_id"), named(text).alias("text"), *[c.alias(b) for c, b in zip(order, by, strict=True)])
        rows = keyed.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(vocabulary, capacity, with_ids, TaskContext.get().partitionId() << 40)
        for batch in bounded_batches(batches, 1):
            for doc_id, one in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, np.append(encode(vocabulary, one.as_py() or ""), np.uint32(end_id)))
                if packer.size >= chunk:
                    yield packer.pack(False)
        yield packer.pack(True)

    return rows.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
