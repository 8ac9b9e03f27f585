"""SimHash near-duplicates through vantage-point trees.

A fingerprint has a bit set where over half of the text's shingle hashes do. Distinct fingerprints are dealt over shards by a vantage-point
tree built from a bounded sample: a node splits by Hamming distance to its vantage point at the median m, and by the triangle inequality a
fingerprint at distance d has all neighbours within `radius` inside if d <= m - radius, outside if d > m + radius, else it may have some on the other side.
Shards that turn out too large are split again by trees of their own. Each shard holds the fingerprints at home there and the visitors from beyond a border, runs a finer tree of the same kind over them in whole-array steps, and
emits only a spanning star of each local component, never its pairs. Stars join to components by label propagation with
pointer jumping over tables in the shared folder.

`similar_groups` is for looser likeness than a few bits: texts of similarity 0.8 differ in about 10 of 64 bits, unrelated ones in 32 give or take 4, so that
the triangle inequality prunes nothing at such a radius. There the tree finds what lies within a few bits, MinHash bands of the sets of word shingles
the candidates beyond, and the sets themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscape.llm.common import Scratch, bounded, bounded_batches, cut, gram_hashes, ids, mix, one_array, slices, utf8, word_hashes, words

SHARD_ROWS = 16_384
LEAST_SHARDS = 8
#: The most shards of one tree.
SHARDS = 4_096
SAMPLE_PER_SHARD = 64
#: Rows of one shard that a task splits at a time.
PART_ROWS = 1 << 18
ROUTED = "shard long, fp long, home boolean"
LEAF = 64
#: Rows that are compared with a leaf at a time.
STRIP = 1 << 14

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


def text_fingerprints(raw: np.ndarray, at: np.ndarray, n: int = 3, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text: XXH64 of its n-word shingles in lower-case ASCII, one space between words; no word: 0."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(at) - 1, np.uint64)
    for i, j in slices(at):
        part = _LOWER[raw[at[i] : at[j]]]
        gap = part == 32
        keep = ~gap
        keep[1:] |= ~gap[:-1]  # the first of adjacent spaces
        offsets = np.concatenate([[0], np.cumsum(keep)])[at[i : j + 1] - at[i]]
        part = part[keep]
        starts, ends, first = words(part, offsets)
        data = part.tobytes()
        for k in range(j - i):
            a, b = first[k], first[k + 1]
            if a == b:
                continue
            lo, hi = (starts[a : b - n + 1], ends[a + n - 1 : b]) if b - a >= n else (starts[a : a + 1], ends[b - 1 : b])
            counts = np.zeros(64, np.int64)
            for c in range(0, len(lo), 4096):
                h = np.array([xxh64_intdigest(data[x:y], seed) for x, y in zip(lo[c : c + 4096].tolist(), hi[c : c + 4096].tolist(), strict=True)], np.uint64)
                counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i + k] = np.packbits(counts * 2 > len(lo), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(df: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp long of every row; a null text is empty and has fingerprint 0. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, 1):
            found = text_fingerprints(*utf8(batch.column(1)), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return ids(df, text, key).mapInArrow(run, "doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def vantage(points: np.ndarray) -> tuple[np.uint64, int]:
    """The one of a few evenly spaced candidates whose distances spread most, and their median."""
    few = points[:: max(1, len(points) // 256)]
    tried = few[:: max(1, len(few) // 8)][:8]
    spread = [distance(few, v).astype(np.float64).var() for v in tried]
    best = tried[int(np.argmax(spread))]
    return best, int(np.median(distance(few, best)))


@dataclass(frozen=True)
class Tree:
    """Inner nodes of a vantage-point tree: vantage point, median, and the child on either side, where -1 - k is shard k."""

    point: np.ndarray
    middle: np.ndarray
    inside: np.ndarray
    outside: np.ndarray

    @property
    def shards(self) -> int:
        return len(self.point) + 1


def build(sample: np.ndarray, leaf: int) -> Tree:
    """The tree whose shards hold at most `leaf` points of the sample, where its points can be told apart by distance."""
    nodes: list[list[int]] = []
    shards = 0

    def grow(points: np.ndarray) -> int:
        nonlocal shards
        if len(points) > leaf:
            point, middle = vantage(points)
            near = distance(points, point) <= middle
            if 0 < int(near.sum()) < len(points):
                own = len(nodes)
                nodes.append([int(point), middle, 0, 0])
                nodes[own][2:] = grow(points[near]), grow(points[~near])
                return own
        shards += 1
        return -shards

    grow(np.sort(sample))
    columns = list(zip(*nodes, strict=True)) or [()] * 4
    return Tree(np.array(columns[0], np.uint64), *(np.array(c, np.int64) for c in columns[1:]))


def route(tree: Tree, fps: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, position in fps, whether it is at home there) for each shard that a fingerprint has to visit.

    Of two linked fingerprints at home on either side of a node the outer one visits the inner one, never the other way round; a visitor goes on to both
    sides where the triangle inequality can't rule one out.
    """
    at, node = np.arange(len(fps)), np.full(len(fps), 0 if len(tree.point) else -1, np.int64)
    done: list[tuple[np.ndarray, ...]] = []
    while True:
        rest = node >= 0
        done.append((-1 - node[~rest], at[~rest], home[~rest]))
        at, node, home = at[rest], node[rest], home[rest]
        if not len(at):
            return tuple(np.concatenate(x) for x in zip(*done, strict=True))
        d, m = distance(fps[at], tree.point[node]).astype(np.int64), tree.middle[node]
        inside, outside = d <= m + radius, np.where(home, d > m, d > m - radius)
        at, node, home = (
            np.concatenate([at[inside], at[outside]]),
            np.concatenate([tree.inside[node[inside]], tree.outside[node[outside]]]),
            np.concatenate([(home & (d <= m))[inside], home[outside]]),
        )


class Sets:
    """Union-find over 0..n-1 by arrays: the smaller index becomes the root."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if np.array_equal(x, y):
                return x
            x = y

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.find(i), self.find(j)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def link_within(fps: np.ndarray, here: np.ndarray, asking: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint, the index of its local component's root: links between the rows `here` and the rows `asking` of at most `radius` bits.

    A tree over `here`; `asking` rows descend to both sides of a node where the triangle inequality can't rule one out.
    """
    sets = Sets(len(fps))
    todo = [(here, asking)]
    while todo:
        here, asking = todo.pop()
        if len(here) == 0 or len(asking) == 0:
            continue
        split = len(here) > LEAF
        if split:
            point, middle = vantage(fps[here])
            d, e = distance(fps[here], point).astype(np.int64), distance(fps[asking], point).astype(np.int64)
            split = 0 < int((d <= middle).sum()) < len(here)
        if split:
            todo.append((here[d <= middle], asking[e <= middle + radius]))
            todo.append((here[d > middle], asking[e > middle - radius]))
            continue
        for x in range(0, len(here), LEAF):
            own = here[x : x + LEAF]
            for k in range(0, len(asking), STRIP):
                block = asking[k : k + STRIP]
                i, j = np.nonzero(distance(fps[block][:, None], fps[own][None, :]) <= radius)
                sets.union(block[i], own[j])
    return sets.find(np.arange(len(fps)))


def _routed(tree: Tree, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = one_array(batch.column(0)).to_numpy()
            shard, at, home = route(tree, fps.view(np.uint64), np.ones(len(fps), bool), radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fps[at]), pa.array(home)], ["shard", "fp", "home"])

    return run


SPLIT = "shard long, point array<long>, middle array<long>, inside array<long>, outside array<long>"


def _grown(rows: pa.Table) -> pa.Table:
    """The tree of one shard's sample, as a row."""
    tree = build(rows["fp"].to_numpy().view(np.uint64), max(1, rows.num_rows // rows["leaves"][0].as_py()))
    columns = (tree.point.view(np.int64), tree.middle, tree.inside, tree.outside)
    return pa.table({"shard": rows["shard"].slice(0, 1), **{k: pa.array([x], pa.list_(pa.int64())) for k, x in zip(("point", "middle", "inside", "outside"), columns, strict=True)}})


def _resplit(radius: int):
    """A part of one shard's rows, and its tree: the same rows in the shards below."""

    def run(rows: pa.Table, trees: pa.Table) -> pa.Table:
        point, middle, inside, outside = (np.array(trees[k][0].as_py(), np.int64) for k in ("point", "middle", "inside", "outside"))
        tree = Tree(point.view(np.uint64), middle, inside, outside)
        fps = rows["fp"].to_numpy()
        shard, at, home = route(tree, fps.view(np.uint64), rows["home"].to_numpy(zero_copy_only=False), radius)
        own = trees["own"][0].as_py() * SHARDS + shard
        return pa.table({"shard": pa.array(own), "fp": pa.array(fps[at]), "home": pa.array(home)})

    return run


def _stars(radius: int):
    def run(rows: pa.Table) -> pa.Table:
        fps = rows["fp"].to_numpy()
        order = np.argsort(fps)
        fps, home = fps[order], rows["home"].to_numpy(zero_copy_only=False)[order]
        root = link_within(fps.view(np.uint64), np.flatnonzero(home), np.arange(len(fps)), radius)
        linked = np.flatnonzero(root != np.arange(len(fps)))
        return pa.table({"u": pa.array(fps[linked]), "v": pa.array(fps[root[linked]])})

    return run


def links(distinct: DataFrame, radius: int = 2, scratch: Scratch | None = None, *, shard_rows: int = SHARD_ROWS, first_shards: int = SHARDS) -> DataFrame:
    """u, v: a spanning star of each shard's components, over a table (fp) of distinct fingerprints.

    The first tree has at most `first_shards` shards, from a sample that the driver holds; every shard that turns out to have over 2 * shard_rows
    fingerprints at home is split by a tree of its own, built and applied by the executors, until none is.
    """
    scratch = scratch or Scratch()
    n = distinct.count()
    shards = min(first_shards, max(LEAST_SHARDS, -(-n // shard_rows)))
    # bounded: at most SHARDS * SAMPLE_PER_SHARD fingerprints of eight bytes, chosen by hash
    sample = distinct.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE_PER_SHARD * shards).collect()
    tree = build(np.array([r.fp for r in sample], np.int64).view(np.uint64), max(1, len(sample) // shards))
    done, level, rows = None, 0, distinct.select("fp").mapInArrow(_routed(tree, radius), ROUTED)
    if n > min(first_shards, LEAST_SHARDS) * shard_rows:
        rows = scratch.cut(rows)
        while True:
            home = F.count(F.when(F.col("home"), 1)).alias("homes")
            sizes = rows.groupBy("shard").agg(home, F.count(F.lit(1)).alias("rows")).where(F.col("homes") > 2 * shard_rows)
            sizes = sizes.withColumn("leaves", F.least(F.lit(SHARDS), F.ceil(F.col("homes") / shard_rows))).withColumn("parts", F.ceil(F.col("rows") / PART_ROWS).cast("int"))
            sizes = scratch.cut(sizes.withColumnRenamed("shard", "large"))
            chosen = F.pmod(F.xxhash64(F.lit(7), "fp"), F.lit(1 << 32)).cast("double") * F.col("homes") < F.lit(float(SAMPLE_PER_SHARD << 32)) * F.col("leaves")
            sampled = rows.where("home").join(sizes, F.col("shard") == F.col("large")).where(chosen)
            trees = scratch.cut(sampled.select("shard", "fp", "leaves").groupBy("shard").applyInArrow(_grown, SPLIT).where(F.size("point") > 0))
            if trees.isEmpty():  # no shard is large, or none can be told apart by distances
                break
            parts = trees.select(F.col("shard").alias("split")).join(sizes, F.col("split") == F.col("large")).select("split", "parts")
            kept = rows.join(parts, F.col("shard") == F.col("split"), "left_anti").withColumn("level", F.lit(level))
            left = rows.join(parts, F.col("shard") == F.col("split")).select("shard", "fp", "home", F.pmod(F.xxhash64(F.lit(11), "fp"), F.col("parts")).cast("int").alias("part"))
            every = parts.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
            right = trees.withColumnRenamed("shard", "own").join(every, F.col("own") == F.col("split")).drop("split")
            done = kept if done is None else done.unionByName(kept)
            level += 1
            rows = scratch.cut(left.groupBy("shard", "part").cogroup(right.groupBy("own", "piece")).applyInArrow(_resplit(radius), ROUTED))
    every = rows.withColumn("level", F.lit(level))
    every = every if done is None else every.unionByName(done)
    return every.groupBy("level", "shard").applyInArrow(_stars(radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable over edges (u, v), of every node that has one."""
    edge_table, own = Scratch(), Scratch()
    both = edge_table.cut(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    state = own.cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")))
    while True:
        heard = both.join(state, F.col("v") == F.col("node")).select(F.col("u").alias("node"), "label")
        told = state.select("node", "label", F.col("label").alias("old")).unionByName(heard, allowMissingColumns=True)
        least = told.groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        jump = state.select(F.col("node").alias("j"), F.col("label").alias("further"))
        new = own.cut(least.join(jump, F.col("label") == F.col("j"), "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old"))
        state = new.select("node", "label")
        own.clear(1)
        if new.where(F.col("label") != F.col("old")).isEmpty():
            edge_table.clear()
            return state


def groups(docs: DataFrame, *, radius: int = 2, shingle: int = 3, seed: int = 42, text: str = "text", key: str = "doc_id", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fp, component_id of every row: fingerprints within `radius` bits are linked, component_id is the smallest doc_id reachable.

    A null text is empty: texts without words have fingerprint 0 and are linked like any other. A null doc_id stays, and names no component unless
    all its members are null. Repeated rows come out repeated. Other columns aren't read. An empty table gives an empty result.
    """
    found = cut(fingerprints(docs, text=text, key=key, shingle=shingle, seed=seed))
    distinct = cut(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    scratch = Scratch()
    state = components(links(distinct, radius, scratch, shard_rows=shard_rows))
    scratch.clear()
    named = distinct.join(state, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = named.join(least, "label").select("fp", "component_id")
    return found.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, but for those whose similar group has a smaller doc_id; of repeated rows of one doc_id the first by text stays.

    Of rows without a doc_id one stays for each text.
    """
    found = similar_groups(docs, **options)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.join(stays, docs["doc_id"].cast("long").eqNullSafe(stays["kept_id"]), "left_semi")
    rank = "_rank" + "_" * max((len(c) for c in docs.columns), default=0)
    own = [F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("text"))]
    first = F.row_number().over(Window.partitionBy(*own).orderBy(F.col("text").asc_nulls_first()))
    return rows.withColumn(rank, first).where(F.col(rank) == 1).drop(rank)


LIKE, LIKE_SHINGLE = 0.8, 5
#: A text of similarity s to another shares a band with it with probability 1 - (1 - s^VALUES)^BANDS: all but 3 in a million at 0.8.
BANDS, VALUES = 32, 5
BINS = BANDS * VALUES
#: Sets of fewer than SMALL shingles are signed by BINS hash functions, sets of at least SMALL * least by one that is dealt over BINS bins, those between by both.
SMALL = 1_280
TASK_ROWS = 2_048
#: Standard errors of a signature's estimate, on either side of the threshold, within which the exact similarity decides.
ERRORS = 5
#: Rows of either side that are compared, and pairs that are judged by their sets, at a time.
TILE, SETTLED = 512, 512

_RNG = np.random.default_rng(9)
_XOR, _ODD = _RNG.integers(0, 1 << 32, BINS, np.uint32), _RNG.integers(0, 1 << 32, BINS, np.uint32) | np.uint32(1)


def shingle_sets(raw: np.ndarray, at: np.ndarray, shingle: int = LIKE_SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct shingle hashes of each text, rising, one text after the other; where each begins) of one slice of texts after the other.

    A text shorter than a shingle is one, a text without words has none.
    """
    for i, j in slices(at):
        part = _LOWER[raw[at[i] : at[j]]]
        starts, ends, first = words(part, at[i : j + 1] - at[i])
        h = word_hashes(part, starts, ends)
        counts = np.diff(first)
        text = np.repeat(np.arange(j - i), counts)
        grams = gram_hashes(h, shingle)
        whole = text[: len(grams)] == text[shingle - 1 :]
        short = [(k, gram_hashes(h[first[k] : first[k + 1]], int(counts[k]))) for k in np.flatnonzero((counts > 0) & (counts < shingle))]
        of = np.concatenate([text[: len(grams)][whole], np.array([k for k, _ in short], np.int64)])
        all_ = np.concatenate([grams[whole], *(g for _, g in short)])
        order = np.lexsort((all_, of))
        of, all_ = of[order], all_[order]
        new = np.ones(len(all_), bool)
        new[1:] = (all_[1:] != all_[:-1]) | (of[1:] != of[:-1])
        yield all_[new], np.searchsorted(of[new], np.arange(j - i + 1))


def by_functions(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The least value of each of BINS hash functions over each set; no set is empty."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    return np.stack([np.minimum.reduceat((x ^ a) * b, first) for a, b in zip(_XOR, _ODD, strict=True)], axis=1)


def by_bins(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash function dealt over BINS bins, the least of each; an empty bin takes what the next filled one has."""
    out = np.zeros((len(first), BINS), np.uint32)
    for k, own in enumerate(np.split(grams, first[1:])):
        bins = ((own >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
        filled = np.flatnonzero(np.diff(bins, prepend=-1))  # sorted, so the first of each bin is its least
        nearest = filled[np.searchsorted(bins[filled], np.arange(BINS)) % len(filled)]
        out[k] = mix(own[nearest]) >> np.uint64(32)
    return out


def band_keys(values: np.ndarray, scheme: int) -> np.ndarray:
    """BANDS keys a row: a hash of VALUES values, of the band's number and of the scheme."""
    parts = values.reshape(len(values), BANDS, VALUES).astype(np.uint64)
    x = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1 + scheme * BANDS)), parts.shape[:2]).copy()
    for k in range(VALUES):
        x = mix(x ^ parts[:, :, k])
    return x


def signed(grams: np.ndarray, first: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """(number of shingles, two hashes of the set, keys, signature of BINS bytes) of each set, keys as a list of arrays."""
    n = np.diff(first)
    same, also = (np.array([x.sum(dtype=np.uint64) for x in np.split(mix(grams ^ np.uint64(salt)), first[1:-1])], np.uint64) for salt in (0x51, 0xA7))
    keys: list[list[np.ndarray]] = [[] for _ in n]
    marks = np.zeros((len(n), BINS), np.uint8)
    for scheme, chosen, values in ((1, n >= SMALL * least, by_bins), (0, (n > 0) & (n < SMALL), by_functions)):
        at = np.flatnonzero(chosen)
        if len(at):
            rows = np.concatenate([grams[first[k] : first[k + 1]] for k in at])
            found = values(rows, np.concatenate([[0], np.cumsum(n[at])[:-1]]))
            marks[at] = (mix(found.astype(np.uint64) + np.uint64(scheme)) >> np.uint64(56)).astype(np.uint8)
            for k, own in zip(at, band_keys(found, scheme), strict=True):
                keys[k].append(own)
    for k in np.flatnonzero(n == 0):
        keys[k].append(np.zeros(1, np.uint64))
    return n, same, also, [np.concatenate(x) for x in keys], marks


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(shared, all) of two rising arrays of distinct values."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return both, len(a) + len(b) - both


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    both, every = jaccard(a, b)
    return both >= least * every - 1e-9


def text_sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    return [x for grams, first in shingle_sets(*utf8(column), shingle) for x in np.split(grams, first[1:-1])]


def _verified(least: float, shingle: int):
    """The pairs (u, v) whose texts are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole, 2, 3):
                pairs = zip(text_sets(batch.column(2), shingle), text_sets(batch.column(3), shingle), strict=True)
                fine = pa.array([alike(a, b, least) for a, b in pairs], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(fine), batch.column(1).filter(fine)], ["u", "v"])

    return run


def apart(rows: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), tile by tile, of a task's left and right rows in different components whose sizes and signatures allow the similarity `least`.

    The share of equal bytes of two signatures estimates it, if anything from above; pairs ERRORS standard errors below are passed over.
    """
    side, n, label = (rows[c].to_numpy() for c in ("side", "n", "label"))
    marks = np.frombuffer(b"".join(rows["marks"].to_pylist()), np.uint8).reshape(-1, BINS)
    left, right = np.flatnonzero(side != 0), np.flatnonzero(side != 1)
    low = (least - ERRORS * float(np.sqrt(least * (1 - least) / BINS))) * BINS
    columns = np.ascontiguousarray(marks.T)
    small = n < SMALL  # of such a text the signature is by functions, of the others by bins, which tells nothing of the two together
    for x in range(0, len(right), TILE):
        own = right[x : x + TILE]
        for y in range(0, len(left), TILE):
            block = left[y : y + TILE]
            near = (label[block][:, None] != label[own][None, :]) & (np.minimum(n[block][:, None], n[own][None, :]) >= least * np.maximum(n[block][:, None], n[own][None, :]))
            if not near.any():
                continue
            same = np.zeros(near.shape, np.uint8)  # at most BINS, byte by byte, so that no array is larger than the tile
            for byte in columns:
                same += byte[block][:, None] == byte[own][None, :]
            i, j = np.nonzero(near & ((small[block][:, None] != small[own][None, :]) | (same >= low)))
            if len(i):
                yield block[i], own[j]


def _suspects(least: float):
    """The rows of a task that stand in a pair of `apart`."""

    def run(rows: pa.Table) -> pa.Table:
        asked = np.zeros(rows.num_rows, bool)
        for i, j in apart(rows, least):
            asked[i] = asked[j] = True
        return rows.filter(pa.array(asked))

    return run


def _settled(least: float, shingle: int):
    """Links between rows of a task in different components whose texts are alike, a spanning star of them."""

    def run(rows: pa.Table) -> pa.Table:
        first, label = rows["first"].to_numpy(), rows["label"].to_numpy()
        own = text_sets(one_array(rows["text"]), shingle)
        sets = Sets(rows.num_rows)
        _, head, group = np.unique(label, return_index=True, return_inverse=True)
        sets.union(np.arange(len(first)), head[group])
        for i, j in apart(rows, least):
            while len(i):
                new = sets.find(i) != sets.find(j)
                i, j = i[new], j[new]
                a, b = i[:SETTLED], j[:SETTLED]
                links = np.array([alike(own[x], own[y], least) for x, y in zip(a, b, strict=True)], bool)
                sets.union(a[links], b[links])
                i, j = i[SETTLED:], j[SETTLED:]
        found = sets.find(np.arange(len(first)))
        new = np.flatnonzero(label != label[found])
        return pa.table({"u": pa.array(first[new]), "v": pa.array(first[found[new]])})

    return run


def fingerprint_pairs(nodes: DataFrame, scratch: Scratch, least: float, radius: int) -> DataFrame:
    """u, v: texts of (first, n, fp) whose fingerprints are equal or, by the vantage-point tree's stars, within `radius` bits, and whose sizes allow the similarity `least`."""
    heads = scratch.cut(nodes.groupBy("fp").agg(F.min(F.struct("first", "n")).alias("head")))
    stars = links(heads, radius, scratch)
    fits = lambda a, b: F.least(f"{a}.n", f"{b}.n") >= least * F.greatest(f"{a}.n", f"{b}.n")
    equal = nodes.select("fp", F.struct("first", "n").alias("a")).join(heads.select("fp", F.col("head").alias("b")), "fp").where(F.col("a.first") != F.col("b.first"))
    near = stars.join(heads.select(F.col("fp").alias("u"), F.col("head").alias("a")), "u").join(heads.select(F.col("fp").alias("v"), F.col("head").alias("b")), "v")
    return equal.select("a", "b").unionByName(near.select("a", "b")).where(fits("a", "b")).select(F.greatest("a.first", "b.first").alias("u"), F.least("a.first", "b.first").alias("v"))


def similar_groups(docs: DataFrame, *, radius: int = 2, least: float = LIKE, like_shingle: int = LIKE_SHINGLE, task_rows: int = TASK_ROWS) -> DataFrame:
    """doc_id, component_id of every row: texts whose sets of `like_shingle` words, in lower-case ASCII, have a Jaccard similarity of `least` or more are linked.

    Texts of equal sets collapse first. Candidates are the fingerprints that the vantage-point tree finds within `radius` bits, and, as most pairs of a
    similarity near `least` differ in more, MinHash bands for the rest; a candidate pair is linked by the exact similarity of its sets, never
    by an estimate near the threshold. Every text of a band is held against the band's first text; of what is then still in different components of
    one band, all pairs are looked at, in tasks of two blocks of at most `task_rows` rows, so a band that a third of all texts share is dealt over many.
    A pair in one component needs no look, so a group of copies costs what its size is. Null texts are empty, and texts without words equal;
    rows of a null doc_id link to nothing, and have no component. Texts of one doc_id are one document, alike where any of them are.
    Other columns aren't read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole, 1):
                texts = utf8(batch.column(1))
                parts = [signed(*x, least) for x in shingle_sets(*texts, like_shingle)]
                n, same, also = (np.concatenate([p[k] for p in parts]) for k in range(3))
                keys = [x for p in parts for x in p[3]]
                lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in keys])]), np.concatenate(keys).view(np.int64)).cast(pa.list_(pa.int64()))
                columns = [batch.column(0), pa.array(same.view(np.int64)), pa.array(also.view(np.int64)), pa.array(n.astype(np.int64)), lists, pa.array([x.tobytes() for p in parts for x in p[4]], pa.binary()), pa.array(text_fingerprints(*texts).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "same", "also", "n", "keys", "marks", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    found = cut(rows.mapInArrow(run, "doc_id long, same long, also long, n long, keys array<long>, marks binary, fp long"))
    sets = ["same", "also", "n"]
    nodes = found.where(F.col("doc_id").isNotNull()).groupBy(*sets).agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"), F.first("marks").alias("marks"), F.min("fp").alias("fp"))
    nodes = cut(nodes)
    banded = nodes.select("first", "n", F.explode("keys").alias("key"))
    # one row per key that several texts have; the table of keys is written, so that adaptive execution can split a key's texts
    scratch = Scratch()
    heads = scratch.cut(banded.groupBy("key").agg(F.min(F.struct("first", "n")).alias("head"), F.count(F.lit(1)).alias("texts")).where("texts > 1"))
    shared = scratch.cut(banded.join(heads, "key").select("key", "first", "n", "head", "texts"))
    fits = F.least("n", "head.n") >= least * F.greatest("n", "head.n")
    stars = scratch.cut(shared.where((F.col("first") != F.col("head.first")) & fits).select(F.col("first").alias("u"), F.col("head.first").alias("v")).unionByName(fingerprint_pairs(nodes.select("first", "n", "fp"), scratch, least, radius)).distinct())
    text_of = lambda name, as_: rows.select(F.col("doc_id").alias(name), F.col("text").alias(as_))
    pairs = stars.join(text_of("u", "text_u"), "u").join(text_of("v", "text_v"), "v").select("u", "v", "text_u", "text_v")
    links = scratch.cut(pairs.mapInArrow(_verified(least, like_shingle), "u long, v long").distinct())
    state = components(links)
    labelled = shared.where("texts > 2").join(state, F.col("first") == F.col("node"), "left").select("key", "first", "n", "head", F.coalesce("label", "first").alias("label"))
    labelled = scratch.cut(labelled)
    # the first text of a band has met all others; bands of the same texts are one
    others = F.col("first") != F.col("head.first")
    split = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.min(F.when(others, F.col("label"))).alias("a"), F.max(F.when(others, F.col("label"))).alias("b"), F.sum(F.xxhash64("first").cast("decimal(38,0)")).alias("who"))
    split = scratch.cut(split.where("a <> b").groupBy("texts", "who").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("texts") / task_rows).cast("int").alias("parts")))
    open_ = labelled.join(split, "key").join(nodes.select("first", "n", "marks"), ["first", "n"])
    part = F.pmod(F.xxhash64("first"), F.col("parts")).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, part).alias("l"), F.greatest(k, part).alias("r"), F.when(k == part, 2).when(k < part, 0).otherwise(1).alias("side")))
    task = ["key", "l", "r"]
    dealt = open_.withColumn("task", F.explode(meet)).select("key", F.col("task.l").alias("l"), F.col("task.r").alias("r"), F.col("task.side").alias("side"), "first", "n", "label", "marks")
    suspects = scratch.cut(dealt.groupBy(*task).applyInArrow(_suspects(least), dealt.schema))
    settled = suspects.join(text_of("first", "text"), "first").groupBy(*task).applyInArrow(_settled(least, like_shingle), "u long, v long")
    state = components(links.unionByName(settled))
    scratch.clear()
    named = nodes.join(state, F.col("first") == F.col("node"), "left").select(*sets, F.coalesce("label", "first").alias("component_id"))
    return found.select("doc_id", *sets).join(named, sets, "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def brute_force(texts: dict[int, str], radius: int = 2, shingle: int = 3, seed: int = 42) -> dict[int, tuple[int, int]]:
    """doc_id: (fingerprint, component_id) by the definition, for small inputs and tests."""
    from xxhash import xxh64_intdigest

    lower = {i: t.encode().lower().split() for i, t in texts.items()}
    prints = {}
    for i, w in lower.items():
        grams = [b" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] or ([b" ".join(w)] if w else [])
        h = [xxh64_intdigest(g, seed) for g in grams]
        prints[i] = reduce(lambda a, b: a | (1 << b if 2 * sum(x >> b & 1 for x in h) > len(h) else 0), range(64), 0)
    label = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for i in texts:
            for j in texts:
                if (prints[i] ^ prints[j]).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return {i: (prints[i], label[i]) for i in texts}
