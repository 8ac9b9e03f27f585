"""Shared pieces of the text operators: tables, Arrow text slices, word positions and hashes.

A word is a maximal run of bytes other than space and 0x09-0x0D, in the UTF-8 form of a text.
All hash arithmetic is on whole numpy arrays; no Python code runs per word here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscape.plans.storage import Stored, stored

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 18
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))
_S29, _S32 = np.uint64(29), np.uint64(32)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into a table in the shared folder and read it from there: lineage ends, and lost executors cost no recomputation.

    The tables stay until the folder's owner clears it, as lazy results still read them.
    """
    return stored(df).df


def in_written_order(df: DataFrame) -> list[Column] | None:
    """What sorts the rows of a table of part files as they were written, whatever the order in which Spark reads the files; None for other frames."""
    try:
        about = df.metadataColumn("_metadata")
        order = [F.length(about.getField("file_path")), about.getField("file_path"), about.getField("row_index")]  # part-99999 before part-100000
        df.select(*order).schema  # noqa: B018
    except AnalysisException:
        return None
    return order


def bounded(batch: pa.RecordBatch, *texts: int, rows: int = BATCH_ROWS, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most `rows` rows and about `most` bytes of the columns of those numbers; a longer text has a slice of its own."""
    n = batch.num_rows
    sizes = np.zeros(n, np.int64)
    for k in texts:
        sizes += pc.fill_null(pc.binary_length(one_array(batch.column(k))), 0).to_numpy().astype(np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    i = 0
    while i < n:
        j = max(i + 1, min(i + rows, int(np.searchsorted(at, at[i] + most, side="right")) - 1))
        yield batch.slice(i, j - i)
        i = j


def bounded_batches(batches: Iterator[pa.RecordBatch], *texts: int) -> Iterator[pa.RecordBatch]:
    return (part for batch in batches for part in bounded(batch, *texts))


class Scratch:
    """Tables as `cut` makes them that only other tables read: once those are written, `clear` removes them."""

    def __init__(self) -> None:
        self.tables: list[Stored] = []

    def cut(self, df: DataFrame) -> DataFrame:
        self.tables.append(stored(df))
        return self.tables[-1].df

    def clear(self, keep: int = 0) -> None:
        """All but the last `keep` of them."""
        gone = self.tables[: len(self.tables) - keep]
        self.tables = self.tables[len(gone) :]
        for t in gone:
            t.remove()


def one_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    column = one_array(column)
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes each; a longer text has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the number of all): a word never crosses from one text to the next."""
    if raw.size == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[raw]
    begins = np.zeros(raw.size + 1, dtype=bool)
    begins[offsets] = True
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | begins[1:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | begins[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> _S29
    x *= _M2
    x ^= x >> _S32
    return x


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes a step, over all words at once."""
    size = ends - starts
    h = mix(size.astype(np.uint64) * _M3 + np.uint64(seed))
    if not len(starts):
        return h
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(padded) - 7, np.dtype("<u8"), padded, strides=(1,))
    live, step = np.arange(len(starts)), 0
    while live.size:
        lane = lanes[starts[live] + step] & _MASKS[np.minimum(size[live] - step, 8)]
        h[live] = mix(h[live] ^ lane)
        step += 8
        live = live[size[live] > step]
    return h


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, by their hashes; len(h) - n + 1 of them, or none."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    x = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        x = mix(x + _M3) ^ h[j : len(h) - n + 1 + j]
    return mix(x)


def rows_of(batch: pa.RecordBatch, first: int, end: int, *names: str) -> list[pa.Array]:
    return [one_array(batch.column(batch.schema.names.index(n))).slice(first, end - first) for n in names]


def ids(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Only the key and the text, whatever other columns there are."""
    return df.select(named(key).cast("long").alias("doc_id"), named(text).alias("text"))
