import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridscape.llm import sketch, vafile
from tests.llm.helpers import EDGES, corpus, documents


def plain_top(vectors, k, step=20, scale=64):
    v = {i: [math.floor(scale * float(c)) for c in x] for i, x in vectors if x is not None and all(c is not None and math.isfinite(c) for c in x)}
    out = set()
    for q, a in v.items():
        if q % step == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in v.items() if i != q and len(a) == len(b))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def search(spark, vectors, k, **options):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    scaled = vafile.scaled(df, 64)
    return {tuple(r) for r in vafile.top_k(scaled, scaled.where(F.col("vec_id") % 20 == 0), k, **options).collect()}


@pytest.mark.parametrize("options", [{}, {"data_block": 50, "query_block": 4}, {"bits": 4}, {"bits": 2, "data_block": 70}, {"bits": 0}])
def test_top_k_is_exact(spark, options):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    x[100:200] = x[100]  # a third of all rows are one vector
    vectors = [(i, row.tolist()) for i, row in enumerate(x)]
    assert search(spark, vectors, 7, **options) == plain_top(vectors, 7)


def test_top_k_cases(spark):
    vectors = [(0, [1.0, 2.0]), (1, None), (2, [math.nan, 1.0]), (3, [math.inf, 1.0]), (4, [None, 1.0]), (5, [1.0]), (6, [-1.0, 3.0]), (20, [0.5, 0.5])]
    assert search(spark, vectors, 20) == plain_top(vectors, 20)
    huge = {(q, i): s for q, _, i, s in search(spark, [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0])], 20)}
    assert huge == {(0, 1): (1 << 63) - 1, (0, 2): -(1 << 63)}
    ranks = {(q, r): i for q, r, i, _ in search(spark, [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [3e30, 0.0]), (3, [1e37, 0.0]), (4, [3e38, 0.0])], 20)}
    assert [ranks[0, r] for r in (1, 2, 3, 4)] == [4, 3, 2, 1]  # beyond 64 bits, and still in order
    assert search(spark, [], 20) == set()
    assert search(spark, [(0, [1.0])], 20) == set()
    twice = [r for r in search(spark, [(0, [1.0]), (3, [2.0]), (3, [2.0])], 5)]
    assert sorted(r[1] for r in twice) == [1, 2]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 9), st.integers(0, 4), st.sampled_from([3, 40, 10**9, 10**18]))
def test_scan_loses_nothing(seed, n, k, bits, size):
    """What the scan rules out is not among a query's k best, whatever the cells; and bounds hold for vectors that the cells weren't fitted on."""
    rng = np.random.default_rng(seed)
    v, q = (rng.integers(-size, size + 1, shape).astype(float) for shape in ((n, 3), (4, 3)))
    v[rng.integers(0, n, n // 2)] = v[0]
    ids = rng.permutation(n) + 2
    same = np.array([hash(tuple(x)) for x in v.tolist()], np.int64)
    file = vafile.fitted(list(v[: n // 3]), v.min(axis=0), v.max(axis=0), bits)
    cells = file.encode(v.ravel(), np.tile(np.arange(3), n)).reshape(n, 3)
    assert all((file.low[j, cells[:, j]] <= v[:, j]).all() and (v[:, j] <= file.high[j, cells[:, j]]).all() for j in range(3))
    query, row, low, high = vafile.scan(np.arange(4), q, ids, same, cells, file, k)
    for i in range(4):
        scores = [sum(int(a) * int(b) for a, b in zip(q[i], x, strict=True)) for x in v]
        want = sorted((-scores[j], int(ids[j])) for j in range(n) if ids[j] != i)[:k]
        assert {x for _, x in want} <= set(ids[row[query == i]].tolist())
        assert all(a <= scores[j] <= b for j, a, b in zip(row[query == i], low[query == i], high[query == i], strict=True))
        if bits == 4 and size == 3:
            assert len(row[query == i]) <= 2 * k + 1


def test_coarse_cells_still_rule_most_out(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(2000, 16)))], "vec_id long, embedding array<double>")
    scaled = vafile.scaled(df, 64)
    asked = scaled.where(F.col("vec_id") % 20 == 0)
    share = {bits: vafile.candidates(scaled, asked, 20, bits=bits).count() / (100 * 2000) for bits in (3, 5, 8)}
    print(share)
    assert share[8] < 0.02 and share[5] < 0.1 and share[3] < 0.6


def test_large_components_stay_exact():
    q, v = np.array([[2.0**40, 1]]), np.array([[2.0**40, 2]])
    assert vafile.exact_scores(q, v).tolist() == [(1 << 80) + 2]


def grams(text, n=5):
    w = text.encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def of(*texts, scale=1):
    import pyarrow as pa

    from gridscape.llm.common import utf8

    return sketch.sketches(*utf8(pa.array(texts, pa.string())), scale)


def test_sketch_estimates_overlap():
    texts = [t for _, t in corpus(30, 3, 300)]
    full = of(*texts)  # a fraction of 1 keeps all hashes: the estimates are exact
    for a, x in zip(texts[:10], full[:10], strict=True):
        for b, y in zip(texts, full, strict=True):
            A, B = grams(a), grams(b)
            if A or B:
                assert sketch.likeness(x, y) == pytest.approx(len(A & B) / len(A | B))
                assert sketch.containment(x, y) == pytest.approx(len(A & B) / len(A) if A else 1.0)


def test_sketch_keeps_every_hash_below_its_fraction():
    texts = [t for _, t in corpus(30, 4, 300)]
    for scale in (2, 8):
        for full, kept in zip(of(*texts), of(*texts, scale=scale), strict=True):
            low = full[full <= np.uint64(((1 << 64) // scale - 1) >> 16)]
            assert np.array_equal(kept, low if len(low) else full[:1])


def test_sketch_of_a_long_text_is_that_of_its_parts():
    long = " ".join(str(k % 7001) for k in range(300_000))
    raw = np.frombuffer(long.encode(), np.uint8)
    grams = {x for x in sketch._grams(raw, 5, most=1 << 30)[0].tolist()}
    assert {x for g in sketch._grams(raw, 5, most=1 << 12) for x in g.tolist()} == grams


def test_sketch_cases():
    empty, blank, one, same, other = of(None, " \n", "one", "one", "two", scale=8)
    assert len(empty) == len(blank) == 0 and len(one) == 1 and np.array_equal(one, same)
    assert sketch.likeness(empty, blank) == 1 and sketch.likeness(one, empty) == 0 and sketch.likeness(one, other) == 0
    a, b = of("q " * 50 + " ".join(map(str, range(4000))), " ".join(map(str, range(3000, 9000))), scale=8)
    (joined,) = of("q " * 50 + " ".join(map(str, range(4000))) + " " + " ".join(map(str, range(3000, 9000))), scale=8)
    merged = sketch.merge([a, b])
    assert len(np.setdiff1d(merged, joined)) == 0 and len(np.setdiff1d(joined, merged)) <= 4
    assert np.array_equal(sketch.decode(sketch.encode(a)), a)
    assert abs(sketch.containment(a, b) - 1000 / 4050) < 0.1


@pytest.mark.parametrize("bucket_rows", [1, 7, 2000])
def test_successors(spark, bucket_rows):
    rows = corpus(40, 1)
    got = {r.doc_id: r for r in sketch.with_successors(documents(spark, rows, True), bucket_rows=bucket_rows).collect()}
    down = sorted(rows, reverse=True)
    for (i, text), (_, after) in zip(down, down[1:] + down[:1], strict=True):
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        a, e, b = of(text, edited, after, scale=sketch.SCALE)
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == sketch.encode(a) and r.edited_fingerprint == sketch.encode(e)
        assert r.near_edited == pytest.approx(sketch.likeness(a, e)) and r.near_next == pytest.approx(sketch.likeness(a, b))


def test_successor_cases(spark):
    got = sketch.with_successors(documents(spark, EDGES), bucket_rows=2).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in EDGES)
    assert sketch.with_successors(documents(spark, EDGES).limit(0)).count() == 0
    same = [(1, f"text {k} " * 9) for k in range(90)] + [(None, f"none {k} " * 9) for k in range(90)] + [(2, "b")]
    rows = sketch.with_successors(documents(spark, same), bucket_rows=5).collect()
    assert sorted(r.fingerprint for r in rows) == sorted(sketch.encode(x) for x in of(*[t for _, t in same], scale=sketch.SCALE))
    assert len({r.edited_sha256 for r in rows}) == len(same)  # each has a next of its own, over all buckets that its id has
    (alone,) = sketch.with_successors(documents(spark, [(4, "a b c d e f")])).collect()
    assert alone.near_next == 1
    assert sketch.document_sketches(documents(spark, EDGES)).count() == len(EDGES)
