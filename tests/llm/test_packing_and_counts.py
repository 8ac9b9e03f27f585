import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridscape.llm import packing, tokencount
from gridscape.llm.queries import byte_vocabulary
from tests.llm.helpers import EDGES, corpus, documents

WORDS = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids, 0]


def plain_cost(places, penalties, capacity):
    f = {0: 0}
    for j, pen in list(zip(places, penalties, strict=True))[1:]:
        best = min(f[i] + (0 if (j - i) & (j - i - 1) == 0 and j - i >= capacity // packing.SHORTEST else capacity - (j - i)) for i in places if i < j and j - i <= capacity)
        f[j] = best + pen + packing.WINDOW_PENALTY
    return f[places[-1]]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60))
def test_cuts_are_optimal(seed, n):
    rng = random.Random(seed)
    places, at = [0], 0
    for _ in range(n):
        at += rng.randint(1, 32)
        places.append(at)
    pen = [0] + [rng.choice([0, 2, 8]) for _ in range(n)]
    cuts, cost = packing.best_cuts(np.array(places), np.array(pen), 32)
    want = plain_cost(places, pen, 32)
    sizes = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
    own = sum(0 if s & (s - 1) == 0 and s >= 32 // packing.SHORTEST else 32 - s for s in sizes) + sum(dict(zip(places, pen, strict=True))[c] + packing.WINDOW_PENALTY for c in cuts[1:])
    assert cost == want == own and max(sizes) <= 32 and cuts[0] == 0 and cuts[-1] == places[-1]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60))
def test_every_power_of_two_is_unpadded(seed, n):
    rng = random.Random(seed)
    places = np.cumsum([0, *(rng.choice([1, 2, 3, 31, 32, 64, 100]) for _ in range(n))]).tolist()
    pen = [0] + [rng.choice([0, 2, 8]) for _ in range(n)]
    f = {0: 0}
    for j, p in list(zip(places, pen, strict=True))[1:]:
        f[j] = p + packing.WINDOW_PENALTY + min(f[i] + (0 if (j - i).bit_count() == 1 else 1024 - (j - i)) for i in places if i < j <= i + 1024)
    assert packing.best_cuts(np.array(places), np.array(pen))[1] == f[places[-1]]


@pytest.mark.parametrize("chunk", [64, packing.CHUNK_TOKENS])
def test_every_id_lies_in_one_piece(spark, chunk):
    rows = corpus(50, 2) + [(100 + i, t) for i, t in enumerate([None, "", "日本語 text", "<|endoftext|>", "z" * 4000, "Long. " * 900])]
    got = packing.pack(documents(spark, rows, True).repartition(3), byte_vocabulary(), with_ids=True, chunk=chunk).collect()
    for doc_id, text in rows:
        want, own = ids_of(text), sorted((r for r in got if r.doc_id == doc_id), key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == want and all(r.doc_tokens == len(want) for r in own)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in own)
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1])
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_little_padding(spark):
    got = packing.pack(documents(spark, corpus(400, 7, 300)).coalesce(1), byte_vocabulary()).collect()
    sizes: dict = {}
    for r in got:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    padding = sum(0 if s & (s - 1) == 0 else 1024 - s for s in sizes.values())
    assert padding < 0.03 * (padding + sum(sizes.values()))


def test_packing_cases(spark):
    v = byte_vocabulary()
    assert packing.pack(documents(spark, EDGES).limit(0), v).count() == 0
    got = packing.pack(documents(spark, EDGES), v).collect()
    assert sum(r.length for r in got) == sum(len(ids_of(t)) for _, t in EDGES)
    (only,) = packing.pack(documents(spark, [(1, None)]), v, with_ids=True).collect()
    assert only.ids == [0] and only.doc_tokens == 1


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_fast_ids_are_the_librarys(text):
    assert [*packing.encode(byte_vocabulary(), text), 0] == ids_of(text)


def test_token_counts(spark):
    t = Tokenizer.from_file(WORDS)
    rows = corpus(40, 4) + [(200 + i, x) for i, (_, x) in enumerate(EDGES)] + [(300, "I'll don't 3.14 naïve"), (301, "İSTANBUL Σίσυφος ΣΑΣ"), (302, "a\u200b\u00a0\u2028\x1cb \u0301c")]
    got = {r.doc_id: r for r in tokencount.token_counts(documents(spark, rows, True), WORDS, slice_bytes=500, limit=100).collect()}
    for i, text in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 100)
    assert tokencount.token_counts(documents(spark, EDGES).limit(0), WORDS).count() == 0
    assert tokencount.token_counts(documents(spark, EDGES), WORDS).count() == len(EDGES)
    with pytest.raises(tokencount.UnsafeVocabulary):
        tokencount.token_counts(documents(spark, EDGES), public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=12), max_size=6))
def test_white_space_is_a_safe_boundary(parts):
    t = Tokenizer.from_file(WORDS)
    whole = " ".join(parts)
    pieces = whole.encode().split()
    assert sum(tokencount._lengths(WORDS, [p.decode() for p in pieces])) == len(t.encode(whole, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|", "|>", "'s", "'", "é", "e\u0301", "1", "a1", "A'LL", "!", "|", "x.", "\u0301"]), st.text(st.characters(codec="utf-8"), max_size=4)), max_size=12))
def test_a_long_run_splits_where_pieces_must(parts):
    t = Tokenizer.from_file(WORDS)
    whole = "".join(parts)
    found = tokencount.pieces(whole.encode(), 0)
    assert sum(tokencount._lengths(WORDS, [p.decode() for p in found])) == len(t.encode(whole, add_special_tokens=False).ids)


def test_long_texts_in_bounded_memory(spark):
    """One text of 50 MB goes through each narrow operator without arrays of many times its size."""
    import resource

    from gridscape.llm import mil, simhash, sketch
    from gridscape.llm.common import utf8
    import pyarrow as pa

    text = pa.array([" ".join(f"word{k % 9973}," for k in range(4_500_000))])
    raw, at = utf8(text)
    assert len(raw) > 44e6
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    x = mil.long_passages(raw)
    (fingerprint,) = sketch.sketches(raw, at)
    counted = next(tokencount.counter(WORDS, 2048, 1 << 20)(iter([pa.RecordBatch.from_arrays([pa.array([1]), text], ["doc_id", "text"])])))
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1e3
    assert len(x) == -(-4_500_000 // 128) and len(fingerprint) > 100 and counted.column("over_limit")[0].as_py()
    print("MB", grown)
    assert grown < 900
    assert simhash.text_fingerprints(raw[: 1 << 20], np.array([0, 1 << 20]))[0]
