import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from gridscape.llm import chat, mil, mixing, queries
from tests.llm.helpers import EDGES, documents

SF = "/root/testdata/sf0.001"


def labelled(spark, n=240):
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for i in range(n):
        w = [f"word{x}" for x in rng.integers(0, 90, rng.integers(1, 400))]
        bad = i % 4 == 0
        docs.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w) + "."))
        labels.append((i, int(not bad), "x"))
    return documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, text string")


def test_quality(spark):
    docs, labels = labelled(spark)
    model = mil.train(docs, labels)
    rows = mil.scored(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.95
    assert mil.accepted(docs, model).columns == docs.columns
    again = mil.train(docs.repartition(3), labels.repartition(2))
    assert all(np.array_equal(model.weights[k], again.weights[k]) for k in model.weights)


def test_quality_cases(spark):
    docs, labels = labelled(spark, 60)
    model = mil.train(docs, labels.unionByName(spark.createDataFrame([(None, 1, ""), (3, None, ""), (5, 1, ""), (999, 0, "")], labels.schema)))
    got = mil.scored(documents(spark, EDGES, True), model).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1  # null, empty and blank texts
    assert mil.scored(docs.limit(0), model).count() == 0
    none = mil.train(docs, labels.limit(0))
    assert {r.score for r in mil.scored(docs, none).collect()} == {0.5}


def plain_score(model, text):
    """The score by its definition, one byte, word and passage after another."""
    raw = (text or "").encode()
    kind = lambda b: 0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b >= 128 else 5 if b == 10 else 4 if b in (32, 9, 11, 12, 13) else {33: 6, 124: 7, 46: 8, 63: 8, 44: 9}.get(b, 11 if b in (35, 36, 37, 38, 42, 64, 94, 126) else 10)
    spots = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    hashes = dict(zip(spots, mil.word_hashes(np.frombuffer(raw, np.uint8), *(np.array(x, np.int64) for x in zip(*spots, strict=True))).tolist(), strict=True)) if spots else {}
    rows = []
    for k in range(0, max(1, len(spots)), mil.PASSAGE_WORDS):
        own = spots[k : k + mil.PASSAGE_WORDS]
        after = spots[k + mil.PASSAGE_WORDS][0] if k + mil.PASSAGE_WORDS < len(spots) else len(raw)
        kinds, cells = [0.0] * mil.KINDS, [0.0] * mil.HASHED
        for b in raw[own[0][0] : after] if own else b"":
            kinds[kind(b)] += 1
        n, sizes = max(1, len(own)), [b - a for a, b in own]
        for spot in own:
            cells[hashes[spot] >> (64 - mil.HASHED_BITS)] += 1
        mean = sum(sizes) / n
        shape = [mean / 10, max(0.0, sum(x * x for x in sizes) / n - mean**2) ** 0.5 / 10, sum(hashes[a] == hashes[b] for a, b in zip(own, own[1:], strict=False)) / n]
        shape += [sum(kind(raw[e - 1]) == x for _, e in own) / n for x in (6, 8, 11)]
        shape += [sum(c > 0 for c in cells) / min(n, mil.HASHED), math.log1p(len(own)) / 5]
        rows.append([x / max(1, sum(kinds)) for x in kinds] + shape + [(c / n) ** 0.5 for c in cells])
    w, sig = model.weights, lambda x: 1 / (1 + math.exp(-x))
    h = [[math.tanh(sum((x - m) / s * e for x, m, s, e in zip(row, model.mean, model.scale, column, strict=True)) + b) for column, b in zip(w["enc"].T, w["enc0"], strict=True)] for row in rows]
    dot = lambda x, column: sum(a * b for a, b in zip(x, column, strict=True))
    gate = [math.exp(sum(math.tanh(dot(x, t)) * sig(dot(x, s)) * a for t, s, a in zip(w["tan"].T, w["sig"].T, w["att"], strict=True))) for x in h]
    return sig(sum(dot(x, w["out"]) * g for x, g in zip(h, gate, strict=True)) / sum(gate) + w["out0"][0])


def test_scores_are_those_of_the_definition(spark):
    docs, labels = labelled(spark, 60)
    model = mil.train(docs, labels)
    rows = [*EDGES, (20, "One, two; THREE!! 4 ## é "), (21, " \n".join(f"w{k % 50}" for k in range(700)) + " \n"), (22, "a a a b")]
    got = {(r.doc_id, i): r.score for i, r in enumerate(mil.scored(documents(spark, rows).coalesce(1), model).collect())}
    for i, (doc_id, text) in enumerate(rows):
        assert got[doc_id, i] == pytest.approx(plain_score(model, text), abs=1e-9)


def test_passages_of_a_long_text_are_the_same_part_by_part():
    for tail in ("", " ", " end"):
        raw = np.frombuffer((" \n x".join(f"w{k % 977}" for k in range(20_000)) + tail).encode(), np.uint8)
        whole, _ = mil.passages(raw, np.array([0, len(raw)]))
        assert np.array_equal(whole, mil.long_passages(raw, most=5_000))


def test_held_out_labels_are_not_learned(spark):
    docs, labels = labelled(spark, 80)
    turned = labels.withColumn("quality", F.when(mil.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = mil.train(docs, labels), mil.train(docs, turned)
    assert all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)


def test_gradient():
    rng = np.random.default_rng(1)
    x, bag, y = rng.normal(size=(9, mil.FEATURES)), np.array([0, 3, 4, 9]), np.array([1.0, 0, 1])
    model = mil.fit(x, bag, y, epochs=1)
    loss = lambda: -np.mean(y * np.log(model.score(x, bag)) + (1 - y) * np.log(1 - model.score(x, bag)))
    for name, g in model.gradient(x, bag, y).items():
        i = (0,) * g.ndim
        w = model.weights[name]
        w[i] += 1e-5
        up = loss()
        w[i] -= 2e-5
        assert g[i] == pytest.approx((up - loss()) / 2e-5, abs=1e-7)
        w[i] += 1e-5


TEMPLATE = chat.Template()
tricky = st.text(st.one_of(st.sampled_from(list("\\<>[]|/s INT")), st.characters(codec="utf-8")), max_size=30)
pieces = st.lists(st.one_of(st.sampled_from(TEMPLATE.controls), st.sampled_from(["\\", "<", "[", " ", "</s", "INST]"]), tricky), max_size=6).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["system", "user", "assistant", ""]), pieces), pieces), max_size=5))
def test_round_trip(turns):
    formatted = "".join(s for role, text in turns for s, _ in TEMPLATE.render(role, text))
    assert TEMPLATE.parse(formatted) == turns
    for _, text in turns:
        assert not any(c in TEMPLATE.escape(text) for c in TEMPLATE.controls)


def test_chat_cases(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "[INST] yo \\"), (2, 0, "assistant", "first"), (3, 1, "user", None), (3, 0, None, "x"), (3, None, "system", "s"), (None, 0, "user", "lost"), (4, 0, "user", "a"), (4, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    formatted = chat.segments(df)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\nhi\nassistant\n[INST] yo \\\n") and got[1].loss_chars == 11 and got[1].loss_sha256 == sha("[INST] yo \\") and got[1].valid
    assert not got[2].valid and got[2].loss_sha256 == sha("first")
    assert got[3].turns_sha256 == sha("system\ns\n\nx\nuser\n\n") and got[3].loss_sha256 == sha("")
    assert got[4].n_turns == 2 and got[None].n_turns == 1
    assert got[1].formatted_chars == formatted.where("conv_id = 1").agg(F.sum(F.length("segment"))).first()[0]
    assert chat.digests(chat.segments(df.limit(0))).count() == 0


def test_long_conversation_streams(spark):
    df = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("t").alias("text"))
    (r,) = chat.digests(chat.segments(df)).collect()
    assert (r.n_turns, r.loss_chars, r.valid) == (5000, 2500, True)


def plain_targets(sizes, weights=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: 3 * sizes[s] for s in over}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=12))
def test_targets(spark, sizes):
    table = {f"s{k}": v for k, v in enumerate(sizes)} | {None: 5}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(table.items()), "source string, source_size long")).collect()}
    want = plain_targets(table)
    assert got == pytest.approx(want)


def test_mix(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 60)), "big" if i % 3 == 0 else f"s{i % 5}" if i % 7 else None) for i in range(300)] + [(900, None, "s1"), (901, "a b", "tiny"), (901, "a b", "tiny")]
    docs = documents(spark, rows, True)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by: dict = {}
    for r in got:
        assert r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    want = plain_targets({s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in {r[2] for r in rows}})
    for s, own in by.items():
        assert own[0].target == pytest.approx(want[s]) and abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1
        assert all(r.taken % max(r.size, 1) == 0 for r in own)  # whole documents only
    again = mixing.mix(docs.repartition(7)).select("doc_id", "size", "taken")
    assert sorted(map(tuple, again.collect())) == sorted((r.doc_id, r.size, r.taken) for r in got)
    order = mixing.training_order(docs)
    assert order.columns == docs.columns
    words = {r.source: r.n for r in order.groupBy("source").agg(F.sum(mixing.words()).alias("n")).collect()}
    assert words == {s: sum(r.taken for r in own) for s, own in by.items() if sum(r.taken for r in own)}
    assert order.join(docs, ["doc_id", "text"], "left_anti").count() == 0


def test_training_order_reaches_the_packed_sequences(spark, tmp_path):
    """Part files of very unequal sizes, which Spark reads in another order than theirs: sequences follow the training positions all the same."""
    from gridscape.llm import packing
    from gridscape.llm.common import in_written_order

    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(rng.integers(0, 400)), f"s{i % 4}") for i in range(400)]
    docs = documents(spark, rows, True)
    ordered = mixing.training_order(docs)
    want = [r.doc_id for r in ordered.collect()]
    cuts = [0, 5, 9, 200, 203, 204, 300, 390, len(want)]
    plain = ordered.toArrow()
    import pyarrow.parquet as pq

    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        pq.write_table(plain.slice(a, b - a), tmp_path / f"part-{k:05d}.parquet")
    files = spark.read.parquet(str(tmp_path))
    pieces = packing.pack(files, queries.byte_vocabulary(), order=in_written_order(files)).orderBy("sequence_id", "offset").collect()
    got = [p.doc_id for p in pieces if p.start == 0]
    assert got == want and len(want) > len(set(want))
    assert in_written_order(docs) is None
    first = {r.doc_id: r.position for r in mixing.ordered(mixing.mix(docs)).collect() if r.taken}
    seen = list(dict.fromkeys(want))
    assert seen == sorted(seen, key=first.__getitem__) and set(seen) == set(first)


def test_mix_cases(spark):
    docs = documents(spark, EDGES)
    assert mixing.mix(docs).count() == len(EDGES) and mixing.mix(docs.limit(0)).count() == 0 and mixing.training_order(docs.limit(0)).count() == 0
    nothing = mixing.mix(documents(spark, [(1, None), (2, "")])).collect()
    assert all(r.target == 0 and r.taken == 0 for r in nothing)


def test_positions_invert_demand(spark):
    for slope in (-0.5, 0.0, 0.7):
        df = spark.range(11).select((F.col("id") * 10.0).alias("offset"), F.lit(100.0).alias("target"), F.lit(slope).alias("slope"))
        for r in df.withColumn("t", mixing.position(F.col("offset"))).collect():
            assert 100 * ((1 - slope) * r.t + slope * r.t**2) == pytest.approx(r.offset)


def test_mix_stays_in_the_jvm(spark):
    plan = mixing.training_order(documents(spark, [(1, "a b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline_cases(spark, tmp_path):
    """No documents, no labels, null ids and texts, repeated rows and extra columns: each stage gives the columns it got, and the last its own."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/a/labels.parquet")
    labels.write.parquet(f"{tmp_path}/b/labels.parquet")
    documents(spark, EDGES).limit(0).write.parquet(f"{tmp_path}/a/documents.parquet")
    documents(spark, [*EDGES, (None, None), (None, "no id")], True).drop("a.b").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    out = corpus_pipeline.run(spark, f"{tmp_path}/b").collect()
    assert {r.doc_id for r in out} == {4, 7, 8, 9, None}


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = corpus_pipeline.quality_classifier(spark, docs, SF)
    assert kept.columns == docs.columns
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, SF).columns == docs.columns
    bad = docs.join(labels.where("quality = 0"), "doc_id", "left_semi").count()
    assert docs.count() - kept.count() >= bad
    assert kept.join(labels.where("quality = 1"), "doc_id", "left_semi").count() >= 0.98 * docs.join(labels.where("quality = 1"), "doc_id", "left_semi").count()
    out = corpus_pipeline.run(spark, SF)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty() and not out.isEmpty()


@pytest.mark.parametrize("name", ["op1_va_file_top_k", "op5_de_bruijn_repeats", "op6_chat_formatting", "op7_line_site_spread", "op8_curriculum_mix"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a, b = (df[columns].sort_values(columns).reset_index(drop=True).astype(str) for df in (got, want))
    assert a.equals(b)
