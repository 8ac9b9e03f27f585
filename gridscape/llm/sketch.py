"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below a fixed fraction 1/scale of the hash range. Sketches of any texts merge by union, and the share of one
sketch that is in another estimates how much of one text is in the other, however unequal their lengths. A text none of whose hashes
is below the fraction keeps its least one, so that only a text without words has an empty sketch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridscape.llm.common import bounded_batches, cut, gram_hashes, slices, utf8, word_hashes, words

SHINGLE = 5
SCALE = 4
BUCKET_ROWS = 2_000
#: Beyond that many buckets, they grow: their tasks stream, so that costs time but no memory.
MOST_BUCKETS = 100_000
SAMPLE_PER_BUCKET = 32
#: Bytes of one text that are hashed at a time.
PART_BYTES = 1 << 20


def _grams(text: np.ndarray, shingle: int, most: int = PART_BYTES) -> list[np.ndarray]:
    """The shingle hashes of one text, part by part: a part begins with the last shingle - 1 words of the one before."""
    out, low = [], 0
    while True:
        high = min(len(text), low + most)
        starts, ends, _ = words(text[low:high], np.array([0, high - low]))
        last = high == len(text)
        if not last and len(starts) <= 2 * shingle:  # hardly a word has so many bytes: a longer part
            most *= 2
            continue
        if not last:  # the last word may go on
            starts, ends = starts[:-1], ends[:-1]
        h = word_hashes(text[low:high], starts, ends)
        out.append(gram_hashes(h, shingle) if out or len(h) >= shingle or not last else gram_hashes(h, len(h)) if len(h) else h)
        if last:
            return out
        low += int(starts[len(starts) - shingle + 1]) if shingle > 1 else int(ends[-1])


def sketches(raw: np.ndarray, at: np.ndarray, scale: int = SCALE, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of each text: sorted distinct hashes of 48 bits. A text of fewer words than a shingle is one shingle."""
    out: list[np.ndarray] = []
    most = np.uint64((1 << 64) // scale - 1)
    for i, j in slices(at):
        part = raw[at[i] : at[j]]
        if len(part) > PART_BYTES:  # one long text
            found = [(g[g <= most], g.min(keepdims=True)) for g in _grams(part, shingle) if len(g)]
            kept = np.unique(np.concatenate([k for k, _ in found] or [np.empty(0, np.uint64)]))
            least = np.concatenate([x for _, x in found] or [np.empty(0, np.uint64)])
            out.append(np.unique((kept if len(kept) or not len(least) else least.min(keepdims=True)) >> np.uint64(16)))
            continue
        starts, ends, first = words(part, at[i : j + 1] - at[i])
        h = word_hashes(part, starts, ends)
        grams = gram_hashes(h, shingle)
        for a, b in zip(first[:-1], first[1:], strict=True):
            own = grams[a : b - shingle + 1] if b - a >= shingle else gram_hashes(h[a:b], b - a) if b > a else h[:0]
            kept = own[own <= most]
            if not len(kept) and len(own):
                kept = own.min(keepdims=True)
            out.append(np.unique(kept >> np.uint64(16)))
    return out


def encode(sketch: np.ndarray) -> str:
    """Twelve hexadecimal digits a hash, in ascending order."""
    return sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).view(">u8").ravel().astype(np.uint64)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(a) + len(b) - len(np.union1d(a, b)) if len(a) and len(b) else 0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of shingles of either text that are in both; two empty sketches are alike, one is like no other."""
    if not len(a) and not len(b):
        return 1.0
    both = shared(a, b)
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of a's shingles that are in b."""
    return shared(a, b) / len(a) if len(a) else 1.0


def merge(sketches_: list[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """The sketch of all texts together: a least hash kept for want of others goes when another text has any below the fraction."""
    union = np.unique(np.concatenate(sketches_)) if sketches_ else np.empty(0, np.uint64)
    low = union[union <= np.uint64(((1 << 64) // scale - 1) >> 16)]
    return low if len(low) else union[:1]


def document_sketches(df: DataFrame, *, scale: int = SCALE, shingle: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint of every row; a null text is empty. Narrow; see `with_successors` for the other cases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, 1):
            found = [encode(s) for s in sketches(*utf8(batch.column(1)), scale, shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_in_edited double, contained_in_next double"


def _compared(scale: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row, waiting for the next one
        for batch in bounded_batches(batches, 1):
            doc_id, text, guest = (batch.column(k).to_pylist() for k in range(3))
            own = sketches(*utf8(batch.column(1)), scale, shingle)
            rows = ([held] if held else []) + list(zip(doc_id, [t or "" for t in text], guest, own, strict=True))
            held = rows[-1] if rows else None
            pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[2]]
            edited = [x[1][: len(x[1]) - len(x[1]) // 2] + y[1][: len(x[1]) // 2] for x, y in pairs]
            theirs = sketches(*utf8(pa.array(edited, pa.large_string())), scale, shingle)
            out = [
                (x[0], len(x[1]), hashlib.sha256(e.encode()).hexdigest(), encode(x[3]), encode(s), likeness(x[3], s), likeness(x[3], y[3]), containment(x[3], s), containment(x[3], y[3]))
                for (x, y), e, s in zip(pairs, edited, theirs, strict=True)
            ]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
            columns = list(zip(*out, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_in_edited", "contained_in_next"])

    return run


def _bucket(ids: np.ndarray, hashes: np.ndarray):
    """An Arrow function of (~doc_id, h): the number of borders, which are rising pairs, that are not beyond it. A null id is after all borders but null's."""
    head, count = np.unique(ids, return_counts=True)
    begin = np.searchsorted(ids, head)

    @F.arrow_udf("int")
    def bucket(turned: pa.Array, h: pa.Array) -> pa.Array:
        x = turned.fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False)
        h = h.to_numpy(zero_copy_only=False)
        at = np.searchsorted(ids, x, side="left")
        for k in np.unique(np.searchsorted(head, x[np.isin(x, head)])):
            own = x == head[k]
            at[own] = begin[k] + np.searchsorted(hashes[begin[k] : begin[k] + count[k]], h[own], side="right")
        return pa.array(at.astype(np.int32))

    return bucket


def with_successors(df: DataFrame, *, scale: int = SCALE, shingle: int = SHINGLE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each document against its edited text and the next document, in descending doc_id and after the last the first.

    Texts move once: a document goes to the bucket of its range, between borders from a bounded sample of keys, and the first of each bucket also, as a
    guest, to the one before, so no order over all rows is needed. Null texts are empty. Rows of one doc_id follow each other by a hash of the text, and
    may lie in several buckets; null ids come last. A single document is followed by itself; an empty table gives an empty result. Other columns
    aren't read.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    # ~doc_id falls as doc_id rises, so that (turned, h) sorts as the documents follow each other
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.bitwise_not(F.col("doc_id").cast("long")).alias("turned"), F.xxhash64(text).alias("h"))
    n = df.count()
    count = max(1, min(MOST_BUCKETS, -(-n // bucket_rows)))
    ids, hashes = np.empty(0, np.int64), np.empty(0, np.int64)
    if count > 1:
        # bounded: about MOST_BUCKETS * SAMPLE_PER_BUCKET keys of 16 bytes at most
        chosen = F.pmod(F.xxhash64(F.lit(2), "turned", "h"), F.lit(1 << 32)).cast("double") * n <= float(SAMPLE_PER_BUCKET << 32) * count
        sample = docs.where(chosen).select(F.coalesce("turned", F.lit((1 << 63) - 1)).alias("turned"), "h").toArrow()
        x, y = sample["turned"].to_numpy(), sample["h"].to_numpy()
        order = np.lexsort((y, x))
        cuts = order[np.unique((np.arange(1, count) * len(order)) // count)] if len(order) else order
        ids, hashes = x[cuts], y[cuts]
    placed = docs.withColumn("bucket", _bucket(ids, hashes)("turned", "h"))
    key = F.struct(F.col("turned").isNull().alias("none"), "turned", "h")
    heads = placed.groupBy("bucket").agg(F.min(key).alias("head"))
    # bounded: one row a bucket, so one task sorts them
    before = F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy()))
    heads = cut(heads.select("head", before.alias("to")))
    mine = (F.col("turned").isNull() == F.col("head.none")) & F.col("turned").eqNullSafe(F.col("head.turned")) & (F.col("h") == F.col("head.h"))
    guests = docs.join(F.broadcast(heads), F.coalesce("turned", F.lit(0)).eqNullSafe(F.coalesce("head.turned", F.lit(0))) & mine).groupBy("to", "turned", "h").agg(F.first("text").alias("text"), F.first("doc_id").alias("doc_id"))
    columns = ["doc_id", "text", "turned", "h", "bucket", "guest"]
    rows = placed.withColumn("guest", F.lit(False)).select(columns).unionByName(guests.withColumnRenamed("to", "bucket").withColumn("guest", F.lit(True)).select(columns))
    dealt = rows.repartitionById(len(ids) + 1, F.col("bucket")).sortWithinPartitions("guest", F.asc_nulls_last("turned"), "h", "text")
    return dealt.select("doc_id", "text", "guest").mapInArrow(_compared(scale, shingle), COMPARED)
