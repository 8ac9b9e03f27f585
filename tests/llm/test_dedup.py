import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st


from gridscape.llm import debruijn, linededup, simhash
from gridscape.llm.common import Scratch, utf8
from tests.llm.helpers import CLASHES, EDGES, corpus, documents


def repeats(spark, texts, **options):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.repeats_removed(documents(spark, texts, True), **options).collect()}


@pytest.mark.parametrize("window,anchor", [(20, 5), (8, 3), (7, 4), (5, 5)])
def test_repeats_equal_definition(spark, window, anchor):
    texts = corpus(70, 11)
    assert repeats(spark, texts, window=window, anchor=anchor) == debruijn.brute_force(texts, window)


def test_repeats_inside_one_text_and_of_one_word(spark):
    rng = np.random.default_rng(0)
    few = [(i, " ".join(rng.choice(["a", "b"], 60))) for i in range(12)]
    texts = [*few, (20, "same " * 100), (21, "x y " * 40), (22, "same " * 30), (23, " ".join(map(str, range(25))) + " gap " + " ".join(map(str, range(25))))]
    assert repeats(spark, texts) == debruijn.brute_force(texts)


def test_repeat_cases(spark):
    got = debruijn.repeats_removed(documents(spark, EDGES), with_text=True).collect()
    assert len(got) == len(EDGES) and all(r.n_removed == 0 for r in got if r.doc_id != 8)
    long = next(r for r in got if r.doc_id == 8)
    assert long.n_words == 3000 and long.n_removed == 2999 and long.kept_text == "word"  # all but what the first window alone covers
    assert debruijn.repeats_removed(documents(spark, EDGES).limit(0)).count() == 0
    passage = " ".join(map(str, range(30)))
    twice = debruijn.repeats_removed(documents(spark, [(1, passage), (1, passage), (None, passage)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in twice) == [("1", 0), ("1", 0), ("None", 30)]


def test_long_repeats_are_few_paths(spark):
    """A passage of 3000 words in many texts compacts to a path or two; where two long passages meet in another order, the graph branches."""
    rng = np.random.default_rng(5)
    new = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 10**9, k))
    p, q = new(3000), new(1000)
    texts = [(i, f"{new(30)} {p} {new(30)}") for i in range(4)] + [(10, f"{p} {q}"), (11, f"{q} {p}"), (12, f"{new(5)} {q} {q}")]
    assert repeats(spark, texts) == debruijn.brute_force(texts)
    rows = spark.createDataFrame([(1, False, 4, 0, 0, 2, 2), (2, False, 3, 1, 1, 3, 3), (3, False, 5, 2, 2, 0, 4), (4, True, 1, 3, 3, 5, 5), (5, False, 2, 4, 4, 6, 6), (6, False, 7, 5, 5, 0, 0)], "edge long, branches boolean, n int, a long, b long, c long, d long")
    assert sorted(map(tuple, debruijn.paths(rows, Scratch()).collect())) == [(1, 12), (5, 9)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 12))
def test_least_edges(values, span):
    g = np.array(values, np.uint64)
    if len(g) >= span:
        assert debruijn.least_edges(g, span).tolist() == [i + min(range(span), key=lambda k: (values[i + k], k)) for i in range(len(g) - span + 1)]


def test_fingerprints_and_components(spark):
    texts = [*corpus(60, 5), (100, None), (101, ""), (102, "One"), (103, "one"), (104, "Two  words"), (105, "two words")]
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.groups(documents(spark, texts, True), shard_rows=4).collect()}
    assert simhash.groups(documents(spark, EDGES).limit(0)).count() == 0 and simhash.groups(documents(spark, EDGES)).count() == len(EDGES)
    assert got == simhash.brute_force({i: t or "" for i, t in texts})


@pytest.mark.parametrize("spread", [2, 6, 64])
def test_links_lose_nothing(spark, spread):
    """Random points around few centres: many links, chains, and every shard border crossed."""
    rng = np.random.default_rng(spread)
    points = set()
    for c in rng.integers(0, 2**63, 12):
        for _ in range(40):
            bits = rng.choice(64, rng.integers(0, spread + 1), replace=False)
            points.add(int(c) ^ int(sum(1 << int(b) for b in bits)))
    fps = np.array(sorted(points), np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = np.arange(len(fps))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(fps))])
        if np.array_equal(new, label):
            break
        label = new
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for first in (simhash.SHARDS, 3):  # with three, shards are split again
        state = {r.node: r.label for r in simhash.components(simhash.links(df, 2, shard_rows=8, first_shards=first)).collect()}
        groups: dict = {}
        for x, k in zip(fps.view(np.int64).tolist(), label, strict=True):
            groups.setdefault(state.get(x, x), set()).add(int(k))
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(label.tolist()))


def test_routing_is_even_and_one_way():
    """A million random fingerprints: shards at home are about equal, and copies are what the README says."""
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 64, 1_000_000, np.uint64)
    tree = simhash.build(rng.choice(fps, 64 * 64), 64)
    shard, at, home = simhash.route(tree, fps, np.ones(len(fps), bool), 2)
    assert sorted(at[home].tolist()) == list(range(len(fps)))
    homes, every = (np.bincount(x, minlength=tree.shards) for x in (shard[home], shard))
    print("shards", tree.shards, "copies", len(at) / len(fps), "largest home", homes.max(), "largest", every.max())
    assert homes.max() < 2 * len(fps) / tree.shards + simhash.SHARD_ROWS and len(at) < 8 * len(fps)


def test_components_follow_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "u long, v long")
    got = {r.node: r.label for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


def jaccard(a, b):
    A, B = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (a.lower().split(), b.lower().split()))
    return len(A & B) / len(A | B)


def test_similar_groups(spark):
    rng = np.random.default_rng(2)
    texts, base = [], [" ".join(f"w{x}" for x in rng.integers(0, 5000, 400)) for _ in range(8)]
    for k, text in enumerate(base):
        w = text.split()
        texts += [(k * 10, text), (k * 10 + 1, text.upper())]
        for j, changes in enumerate((2, 4, 60)):
            x = w.copy()
            for at in rng.choice(400, changes, replace=False):
                x[at] = f"n{at}"
            texts.append((k * 10 + 2 + j, " ".join(x)))
        texts.append((k * 10 + 5, text + " " + " ".join(f"e{x}" for x in range(20))))
    for rows in (2, simhash.TASK_ROWS):
        got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, texts, True), task_rows=rows).collect()}
        for i, a in texts:
            for j, b in texts:
                if i // 10 == j // 10 and jaccard(a, b) >= 0.85:
                    assert got[i] == got[j]
                if i // 10 != j // 10 or (i != j and i % 10 == 4):
                    assert got[i] != got[j]


def test_similar_groups_are_those_of_the_definition(spark):
    """Pairs a little above and below the threshold: blocks replaced, passages repeated another number of times, scattered words changed."""
    rng = np.random.default_rng(7)
    new = lambda k: [f"w{x}" for x in rng.integers(0, 10**9, k)]
    texts: list[tuple[int, str]] = []

    def pair(a: list[str], b: list[str]) -> None:
        texts.extend([(len(texts), " ".join(a)), (len(texts) + 1, " ".join(b))])

    for size in (20, 45, 150, 400, 1500):
        for _ in range(40):
            base, at = new(size), int(rng.integers(0, size // 2))
            block = max(1, round(size * rng.uniform(0.06, 0.14)))
            pair(base, base[:at] + new(block) + base[at + block :])
            pair(base := new(size), base + new(round(size * rng.uniform(0.15, 0.32))))
    for size in (30, 100):
        p, q = new(size), new(size)
        pair(p + q * 6, p * 6 + q)
    want = {i: i for i, _ in texts}
    for (i, a), (j, b) in zip(texts[::2], texts[1::2], strict=True):
        if jaccard(a, b) >= 0.8:
            want[j] = i
    assert 150 < sum(i != j for i, j in want.items()) < 350
    for rows in (2, simhash.TASK_ROWS):
        assert {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, texts), task_rows=rows).collect()} == want


def test_similar_groups_of_a_large_band(spark):
    """One boilerplate that all texts share makes bands of unlike texts; in them small groups are alike, and chains link by their neighbours only."""
    rng = np.random.default_rng(3)
    new = lambda k: [f"w{x}" for x in rng.integers(0, 10**9, k)]
    shared, texts = new(150), []
    for _ in range(40):
        own = new(60)
        for step in range(4):  # each differs a little from the one before, the last much from the first
            texts.append((len(texts), " ".join(shared + own)))
            own = own[:]
            at = 13 * step
            own[at : at + 13] = new(13)
    for k in range(10):
        texts.append((len(texts), " ".join(new(1400 if k % 2 else 1200))))
        texts.append((len(texts), texts[-1][1].rsplit(" ", 150)[0]))
    want = {i: i for i, _ in texts}
    for _ in range(4):
        for i, a in texts:
            for j, b in texts[max(0, i - 4) : i]:
                if jaccard(a, b) >= 0.8 and want[i] != want[j]:
                    want[i] = want[j] = min(want[i], want[j])
    assert all(jaccard(a, b) < 0.8 for i, a in texts[:160] for j, b in texts[i + 4 : 160] if i // 4 != j // 4)
    for rows in (7, simhash.TASK_ROWS):
        assert {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, texts), task_rows=rows).collect()} == want


def test_keep_first(spark):
    docs = documents(spark, [*EDGES, (30, "Two  words"), (31, "two words"), (32, "TWO  words")], True)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(str(i) for i, _ in rows) == ["1", "30", "4", "7", "8", "9", "None"]  # 2 and 3 have no words as 1, 31 and 32 have the words of 30, 5 those of 4
    assert simhash.keep_first(docs.limit(0)).count() == 0


def lines_by_definition(rows, least):
    sites: dict = {}
    first: dict = {}
    for i, text, source in rows:
        for k, line in enumerate((text or "").split("\n") if text else []):
            if line.strip(" "):
                sites.setdefault(line.strip(" "), set()).add(source)
                first[line.strip(" ")] = min(first.get(line.strip(" "), (i, k)), (i, k))
    out = {}
    for i, text, _ in rows:
        lines = text.split("\n") if text else []
        kept = [x for k, x in enumerate(lines) if len(sites.get(x.strip(" "), ())) < least or first[x.strip(" ")] == (i, k)]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_lines(spark):
    rng = np.random.default_rng(3)
    shared = [f"line {k}" for k in range(12)]
    rows = []
    for i in range(80):
        own = [f"text {i} {k}" for k in range(rng.integers(0, 4))] + [shared[k] for k in range(12) if rng.random() < (k + 1) / 14] + ["", "  "]
        rng.shuffle(own)
        rows.append((i, "\n".join(own), f"s{i % 7}" if i % 9 else None))
    rows += [(200, None, "s1"), (201, "", "s2")]
    got = linededup.deduplicated(documents(spark, rows, True), 5)
    assert all(c in got.columns for c in CLASHES)
    found = {r.doc_id: (r.n_lines, r.n_removed, hashlib.sha256((r.kept_text or "").encode()).hexdigest()) for r in got.collect()}
    assert found == lines_by_definition(rows, 5)
    assert linededup.deduplicated(documents(spark, EDGES).limit(0)).count() == 0
    assert linededup.deduplicated(documents(spark, EDGES), 1).count() == len(EDGES)


def test_words_never_cross_texts():
    from gridscape.llm.common import words

    raw, at = utf8(pa.array(["ab", None, "c d", "", "\x1ce\u00a0f"]))
    starts, ends, first = words(raw, at)
    assert [raw[s:e].tobytes() for s, e in zip(starts, ends, strict=True)] == [b"ab", b"c", b"d", "\x1ce\u00a0f".encode()]
    assert first.tolist() == [0, 1, 1, 3, 3, 4]




def test_edge_filter_passes_all_edges(spark):
    edges = np.random.default_rng(0).integers(-(2**63), 2**63, 3000)
    bits = debruijn.filter_bits(spark.createDataFrame([(int(e),) for e in edges], "edge long"))
    at = edges & ((1 << debruijn.FILTER_BITS) - 1)
    assert ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all() and np.unpackbits(bits).sum() == len(set(at.tolist()))


def test_near_dedup_links_through_the_vantage_point_tree(spark, monkeypatch):
    found = []
    tree = simhash.links

    def seen(*args, **options):
        out = tree(*args, **options)
        found.extend((r.u, r.v) for r in out.collect())
        return out

    monkeypatch.setattr(simhash, "links", seen)
    long = " ".join(f"word{i}" for i in range(600))
    texts = [(i, f"{long} {' '.join(f'end{k}' for k in range(1 * (i % 3)))}") for i in range(9)] + [(20 + i, f"other{i} " * 40) for i in range(5)]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, texts)).collect()}
    assert got == {**{i: 0 for i in range(9)}, **{20 + i: 20 + i for i in range(5)}}
    prints = {i: simhash.text_fingerprints(*utf8(pa.array([t])))[0] for i, t in texts}
    distinct = {int(np.int64(np.uint64(prints[i]).view(np.int64))) for i in range(3)}
    assert len(distinct) > 1 and any({u, v} <= distinct for u, v in found)
