"""Substring dedup by compaction of a de Bruijn graph of words.

Edges are `anchor` words long. A window of `window` words belongs to the edge in it of least hash, the leftmost of equals, so equal windows belong to equal
edges at the same place in them, and consecutive windows of one edge form a piece of text. An edge that occurs once belongs to no repeated window.
The edges that occur again, each followed by the next one in its text, are the graph. An edge all of whose pieces are the same text, and that always
follows the same edge and is always followed by the same one, branches nowhere; runs of such edges are compacted to paths by pointer jumping,
each round one join. An occurrence of a path is then one span of text, known by where its first edge stands and by its number of windows.

A window reaches at least half of what it has besides its edge to one side, so a piece of an edge whose pieces differ can repeat only where the edge
with so many words on its left, or on its right, occurs again. Only such pieces, where repeats begin and end, are opened to single windows.

Coordinates (document, first window, number of windows) lead back to the text, and only what stands there decides: a span is a repeat if the digest of its
words, as read from the text, is that of an earlier span, an opened window if 128 bits of hash of its words are. Then the covered words are cut out.

All joins are on hashes of edges, spans or windows or on documents, with a table of one row per key on one side. That table is written first, so that both
sides of the join are plain exchanges and adaptive execution can split the rows of a hot key over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscape.llm.common import Scratch, bounded_batches, cut, gram_hashes, mix, one_array, slices, utf8, word_hashes, words

WINDOW = 20
ANCHOR = 5
SEEDS = (5, 6)
SPAN, OPENED = 0, 1
FILTER_BITS = 26
#: The order of a null doc_id: last.
NO_ID = (1 << 63) - 1


def least_edges(g: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` consecutive edges, the index of the least, the leftmost of equals."""
    at, done = np.arange(len(g)), 1
    value = g
    while done < span:
        step = min(done, span - done)
        right = value[step:] < value[: len(value) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        value = np.where(right, value[step:], value[: len(value) - step])
        done += step
    return at


def window_hashes(g: np.ndarray, starts: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The hash of the windows that start there, by the edges that cover them."""
    x = g[starts]
    for j in [*range(anchor, window - anchor, anchor), window - anchor]:
        x = mix(x) ^ g[starts + j]
    return mix(x)


def flank(g: np.ndarray, m: np.ndarray, low: np.ndarray, high: np.ndarray, shift: int, reach: int, anchor: int) -> np.ndarray:
    """32 bits of hash of the words from m + shift on, as many as `reach` and the anchor; 0 where the text hasn't as many."""
    begin = m + shift
    fine = (begin >= low) & (begin + reach + anchor <= high)
    out = np.zeros(len(m), np.int32)
    out[fine] = (window_hashes(g, begin[fine], reach + anchor, anchor) >> np.uint64(33)).astype(np.int32) | 1
    return out


def pieces(raw: np.ndarray, at: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """Of each piece: text, first window within it, windows, hashes of the edge, of the edges before and after it in the text (0: none), of the content and of both flanks."""
    starts, ends, first = words(raw, at)
    total = len(starts) - window + 1
    whole = np.empty(0, np.int64)
    if total > 0:
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        whole = np.flatnonzero(text[:total] == text[window - 1 :])
    if not len(whole):
        return {k: np.empty(0, t) for k, t in (("text", np.int64), ("start", np.int64), ("n", np.int64), ("edge", np.uint64), ("before", np.uint64), ("after", np.uint64), ("content", np.uint64), ("left", np.int32), ("right", np.int32))}
    g = gram_hashes(word_hashes(raw, starts, ends, SEEDS[0]), anchor)
    own = least_edges(g, window - anchor + 1)[whole]
    begins = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (whole[1:] != whole[:-1] + 1)]))
    stops = np.append(begins[1:], len(whole)) - 1
    a, b, m = whole[begins], whole[stops], own[begins]
    n, of, edge = b - a + 1, text[a], g[m]
    shape = (n * 64 + (m - a)).astype(np.uint64)
    content = mix(mix(window_hashes(g, a, window, anchor) ^ shape) ^ window_hashes(g, b, window, anchor))
    before, after = np.zeros(len(edge), np.uint64), np.zeros(len(edge), np.uint64)
    inside = of[1:] == of[:-1]
    before[1:][inside], after[:-1][inside] = edge[:-1][inside], edge[1:][inside]
    reach = -(-(window - anchor) // 2)
    left, right = (flank(g, m, first[of], first[of + 1], shift, reach, anchor) for shift in (-reach, 0))
    return {"text": of, "start": a - first[of], "n": n, "edge": edge, "before": before, "after": after, "content": content, "left": left, "right": right}


PIECE = "edge long, before long, after long, content long, left int, right int, doc long, version long, start int, n int"


def filter_bits(edges: DataFrame) -> np.ndarray | None:
    """A table of 2^FILTER_BITS bits, set where an edge of `edges` ends in that number: what most other edges fail. None where it would pass most.

    Of fixed size, whatever the corpus; it only saves the exchange of rows that the join with `edges` drops anyway.
    """
    if edges.count() > 1 << (FILTER_BITS - 1):
        return None

    def packed(rows: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 16, np.uint8)
        bits[rows["bit"].to_numpy() & 0xFFFF] = 1
        return pa.table({"part": rows["part"].slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    bit = edges.select(F.col("edge").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).cast("int").alias("bit")).distinct()
    parts = bit.withColumn("part", F.shiftright("bit", 16)).groupBy("part").applyInArrow(packed, "part int, bits binary").collect()
    out = np.zeros((1 << (FILTER_BITS - 16), 1 << 13), np.uint8)
    for r in parts:
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _pieces(window: int, anchor: int, coordinates: bool, passing: np.ndarray | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, 2):
            raw, at = utf8(batch.column(2))
            for i, j in slices(at):
                found = pieces(raw[at[i] : at[j]], at[i : j + 1] - at[i], window, anchor)
                if passing is not None:
                    bit = (found["edge"] & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                    chosen = (passing[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
                    found = {k: v[chosen] for k, v in found.items()}
                hashes = {k: pa.array(found[k].view(np.int64)) for k in ("edge", "before", "after", "content")}
                if not coordinates:
                    yield pa.RecordBatch.from_pydict({"edge": hashes["edge"]})
                    continue
                which = pa.array(found["text"] + i)
                short = {k: pa.array(found[k].astype(np.int32)) for k in ("left", "right", "start", "n")}
                columns = hashes | short | {"doc": batch.column(0).take(which), "version": batch.column(1).take(which)}
                yield pa.RecordBatch.from_pydict({k: columns[k] for k in (c.split()[0] for c in PIECE.split(", "))})

    return run


def _requested(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The windows of some pieces."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = one_array(column)
    if column.null_count:
        column = column.fill_null([])
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False) if at[-1] else np.empty(0, np.int64), at


UNIT = "h1 long, h2 long, doc long, version long, start int, n int, here boolean"


def _units(window: int, anchor: int):
    """Spans and opened windows, by the words that stand at their coordinates; `here` if an equal one stands earlier in the same text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, 2):
            raw, at = utf8(batch.column(2))
            (start, where), (n, _), (kind, _) = (_lists(batch.column(k)) for k in (3, 4, 5))
            for i, j in slices(at):
                part, offsets = raw[at[i] : at[j]], at[i : j + 1] - at[i]
                own = slice(where[i], where[j])
                s, m, c = start[own].astype(np.int64), n[own].astype(np.int64), kind[own]
                text = np.repeat(np.arange(j - i), np.diff(where[i : j + 1]))
                spans, opened = np.flatnonzero(c == SPAN), np.flatnonzero(c == OPENED)
                digest, held, found = [], -1, []
                for k in spans.tolist():
                    if text[k] != held:
                        held = text[k]
                        found = part[offsets[held] : offsets[held + 1]].tobytes().split()
                    digest.append(hashlib.blake2b(b" ".join(found[s[k] : s[k] + m[k] + window - 1]), digest_size=16).digest())
                sums = np.frombuffer(b"".join(digest), np.uint64).reshape(-1, 2)
                begin, of, size = _requested(s[opened], m[opened]), np.repeat(text[opened], m[opened]), np.ones(int(m[opened].sum()), np.int64)
                h1 = h2 = np.empty(0, np.uint64)
                if len(begin):
                    starts, ends, first = words(part, offsets)
                    h1, h2 = (window_hashes(gram_hashes(word_hashes(part, starts, ends, seed), anchor), first[of] + begin, window, anchor) for seed in SEEDS)
                h1, h2 = np.concatenate([sums[:, 0], h1]), np.concatenate([sums[:, 1], h2])
                begin, of, size = np.concatenate([s[spans], begin]), np.concatenate([text[spans], of]), np.concatenate([m[spans], size])
                order = np.lexsort((begin, h2, h1, of))
                here = np.zeros(len(order), bool)
                x, y = order[:-1], order[1:]
                here[y] = (h1[x] == h1[y]) & (h2[x] == h2[y]) & (of[x] == of[y])
                ids = [batch.column(k).take(pa.array(of + i)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *ids, pa.array(begin.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(here)], [c.split()[0] for c in UNIT.split(", ")])

    return run


KEPT = "doc long, version long, n_words long, n_removed long, kept_sha256 string"


def _digest(doc, version, n: list[int], removed: list[int], kept: list[str], texts: list[bytes] | None) -> pa.RecordBatch:
    columns = {"doc": doc, "version": version, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(kept, pa.string())}
    return pa.RecordBatch.from_pydict(columns | ({"kept_text": pa.array(texts, pa.binary()).cast(pa.string())} if texts is not None else {}))


def _untouched(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, 2):
            raw, at = utf8(batch.column(2))
            found = [raw[at[k] : at[k + 1]].tobytes().split() for k in range(batch.num_rows)]
            joined = [b" ".join(x) for x in found]
            yield _digest(batch.column(0), batch.column(1), [len(x) for x in found], [0] * len(found), [hashlib.sha256(x).hexdigest() for x in joined], joined if with_text else None)

    return run


def _cut_out(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, 2):
            raw, at = utf8(batch.column(2))
            (start, where), (n, _) = (_lists(batch.column(k)) for k in (3, 4))
            counts, removed, shas, texts = [], [], [], []
            for k in range(batch.num_rows):
                own = slice(where[k], where[k + 1])
                s, m = start[own].astype(np.int64), n[own].astype(np.int64)
                found = raw[at[k] : at[k + 1]].tobytes().split()
                edge = np.zeros(len(found) + 1, np.int64)
                np.add.at(edge, s, 1)
                np.add.at(edge, s + m + window - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(w for w, x in zip(found, gone.tolist(), strict=True) if not x) if len(s) else b" ".join(found)
                counts.append(len(found))
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)
            yield _digest(batch.column(0), batch.column(1), counts, removed, shas, texts if with_text else None)

    return run


def paths(degrees: DataFrame, scratch: Scratch) -> DataFrame:
    """edge, windows: each nonbranching path's first edge and its number of windows, of a table of edges.

    `degrees`: edge; branches, whether its pieces differ; n, the windows of one; a, b and c, d, the least and largest of the edges before and after it. An
    edge and the next belong to one path if the one is always followed by the other and the other always follows it.
    """
    simple = degrees.where("NOT branches")
    ahead = simple.where((F.col("c") == F.col("d")) & (F.col("c") != 0)).select(F.col("edge").alias("up"), F.col("c").alias("edge"), F.col("n").alias("off"))
    behind = simple.where((F.col("a") == F.col("b")) & (F.col("a") != 0)).select("edge", F.col("a").alias("only"), "n")
    # of an edge on a path that isn't its first: one further up, and the windows between. No cycles: a text ends
    own = Scratch()
    state = own.cut(ahead.join(behind, "edge").where(F.col("up") == F.col("only")).select("edge", "up", "off", "n"))
    while True:
        far = state.select(F.col("edge").alias("via"), F.col("up").alias("top"), F.col("off").alias("more"))
        state = own.cut(state.join(far, F.col("up") == F.col("via"), "left").select("edge", F.coalesce("top", "up").alias("up"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"), "n", F.col("top").isNotNull().alias("open")))
        own.clear(1)
        if state.where("open").isEmpty():
            break
    scratch.tables += own.tables
    sums = state.groupBy(F.col("up").alias("first")).agg(F.max(F.col("off") + F.col("n")).alias("total"))
    heads = simple.join(state.select("edge"), "edge", "left_anti")
    return heads.join(sums, F.col("edge") == F.col("first"), "left").select("edge", F.coalesce("total", "n").cast("int").alias("windows"))


def repeats_removed(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every row: each word covered by a window that also starts earlier goes.

    Earlier is a smaller doc_id, or an earlier start in the same document; a null doc_id is the largest. A null text has no words. Rows of one doc_id don't
    remove from each other. Repeated rows come out repeated. Texts shorter than a window keep all words. Other columns aren't read; an empty table
    gives an empty result.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("version"), F.col("text").alias("text"))
    text = ", kept_text string" if with_text else ""
    edges = rows.mapInArrow(_pieces(window, anchor, False), "edge long")
    scratch = Scratch()  # what is read no more when the touched texts are known
    again = scratch.cut(edges.groupBy("edge").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("edge"))
    # duplicates of a row are one occurrence each, which at worst keeps an edge that occurs in one text only
    found = scratch.cut(rows.mapInArrow(_pieces(window, anchor, True, filter_bits(again)), PIECE).join(again, "edge", "left_semi"))
    ends = [f(c).alias(x) for c, f, x in (("before", F.min, "a"), ("before", F.max, "b"), ("after", F.min, "c"), ("after", F.max, "d"))]
    degrees = scratch.cut(found.groupBy("edge").agg((F.min("content") != F.max("content")).alias("branches"), F.min("n").alias("n"), *ends))
    spans = found.select("edge", "doc", "version", "start").join(scratch.cut(paths(degrees, scratch)), "edge").select("doc", "version", F.struct("start", F.col("windows").alias("n"), F.lit(SPAN).alias("kind")).alias("piece"))
    open_ = scratch.cut(found.join(scratch.cut(degrees.where("branches").select("edge")), "edge", "left_semi").select("edge", "left", "right", "doc", "version", "start", "n"))
    sides = open_
    for side in ("left", "right"):
        met = scratch.cut(open_.where(F.col(side) != 0).groupBy("edge", side).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("edge", side, F.lit(True).alias(f"{side}_met")))
        sides = sides.join(met, ["edge", side], "left")
    opened = sides.where("left_met OR right_met").select("doc", "version", F.struct("start", "n", F.lit(OPENED).alias("kind")).alias("piece"))
    by_text = cut(spans.unionByName(opened).groupBy("doc", "version").agg(F.collect_set("piece").alias("p")))
    scratch.clear()
    touched = cut(rows.join(by_text, ["doc", "version"]).select("doc", "version", "text", F.col("p.start").alias("starts"), F.col("p.n").alias("ns"), F.col("p.kind").alias("kinds")))
    units = scratch.cut(touched.mapInArrow(_units(window, anchor), UNIT))
    firsts = scratch.cut(units.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("h1", "h2", "first"))
    where = ["doc", "version", F.struct("start", "n").alias("unit")]
    later = units.where("here").select(*where).unionByName(units.join(firsts, ["h1", "h2"]).where("doc > first").select(*where))
    later = cut(later.groupBy("doc", "version").agg(F.collect_set("unit").alias("u")))
    scratch.clear()
    cleaned = touched.join(later, ["doc", "version"], "left").select("doc", "version", "text", F.col("u.start").alias("starts"), F.col("u.n").alias("ns")).mapInArrow(_cut_out(window, with_text), KEPT + text)
    whole = rows.mapInArrow(_untouched(with_text), KEPT + text).join(by_text.select("doc", "version"), ["doc", "version"], "left_anti")
    out = cleaned.unionByName(whole)
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), *[c for c in out.columns if c not in ("doc", "version")])


def brute_force(texts: list[tuple[int, str]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """doc_id: (n_words, n_removed, kept_sha256) by the definition."""
    seen: set[tuple] = set()
    out = {}
    for doc_id, text in sorted(texts):
        found = text.encode().split()
        gone = [False] * len(found)
        for s in range(len(found) - window + 1):
            key = tuple(found[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, x in zip(found, gone, strict=True) if not x)
        out[doc_id] = (len(found), sum(gone), hashlib.sha256(kept).hexdigest())
    return out
