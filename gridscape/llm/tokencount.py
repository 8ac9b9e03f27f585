"""Token counts: Arrow batches in, lengths out.

A batch is dealt into slices of about equal bytes. Texts are split at ASCII white space, a safe boundary for vocabularies that drop
white space and whose pieces never reach across it (a special token has none in it either), and a long run without white space where an ASCII digit, or
punctuation behind a letter, must begin another piece, so a text of any length is encoded in short pieces and never as one call: only a run of
letters is one piece whatever its length, as its merges reach all over it. Each distinct piece is encoded once a slice and its length kept in a
bounded per-task memory.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from gridscape.llm.common import bounded_batches, ids, slices, utf8

KEPT_PIECES = 500_000
#: Bytes of a run without white space beyond which it is split further.
LONG = 1 << 12
#: Between ASCII characters of which one is a digit, and between an ASCII letter and punctuation, but for what special tokens have inside them.
INSIDE = re.compile(rb"(?<=[0-9])(?=[!-~])|(?<=[!-~])(?=[0-9])|(?<=[A-Za-z])(?=[!-/:-@\[-`{}~])")


class UnsafeVocabulary(ValueError):
    """Its pieces may reach across white space, so texts can't be split there."""


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def splits_at_space(path: str) -> bool:
    """True if the vocabulary file drops white space: nothing then depends on what stands across it."""
    spec = json.loads(_tokenizer(path).to_str())
    text = json.dumps(spec.get("pre_tokenizer"))
    drops = '"behavior": "Removed"' in text and '"invert": true' in text and "\\\\s\\\\p{L}" in text
    return drops and not any(x["lstrip"] or x["rstrip"] or any(c.isspace() for c in x["content"]) for x in spec["added_tokens"])


def pieces(text: bytes, long: int = LONG) -> list[bytes]:
    """Parts of a text that can be encoded one by one, its white space left out."""
    found = text.split()
    if len(text) <= long or max(map(len, found), default=0) <= long:
        return found
    return [x for run in found for x in (INSIDE.split(run) if len(run) > long else [run])]


def _lengths(path: str, pieces: list[str]) -> list[int]:
    t = _tokenizer(path)
    return [len(e) for e in t.encode_batch_fast(pieces, add_special_tokens=False)]


def counter(path: str, limit: int, slice_bytes: int):
    """The Arrow function: (doc_id, text) batches to (doc_id, n_bytes, n_tokens, over_limit) batches."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept: dict[bytes, int] = {}
        for batch in bounded_batches(batches, 1):
            raw, at = utf8(batch.column(1))
            whole = raw.tobytes()
            tokens: list[int] = []
            for i, j in slices(at, slice_bytes):
                texts = [pieces(whole[at[k] : at[k + 1]]) for k in range(i, j)]
                new = list(set().union(*texts).difference(kept))
                if len(kept) + len(new) > KEPT_PIECES:
                    kept.clear()
                    new = list(set().union(*texts))
                kept.update(zip(new, _lengths(path, [x.decode() for x in new]), strict=True))
                tokens += [sum(map(kept.__getitem__, x)) for x in texts]
            n = pa.array(tokens, pa.int64())
            size = pa.array(at[1:] - at[:-1], pa.int64())
            over = pa.array([x > limit for x in tokens], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return count


def token_counts(df: DataFrame, vocabulary: str, *, text: str = "text", key: str = "doc_id", limit: int = 2048, slice_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row: narrow, no shuffle, only the two columns are read.

    A null text counts as empty: 0 bytes, 0 tokens. A null key stays null; repeated rows give repeated rows; other columns of df,
    whatever their names, are not read. An empty table gives an empty result. A run of letters of any length is one piece.
    """
    if not splits_at_space(vocabulary):
        raise UnsafeVocabulary(vocabulary)
    return ids(df, text, key).mapInArrow(counter(vocabulary, limit, slice_bytes), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
