"""Physical plans of the text operators."""

import public_tokenizers
import pytest

from gridscape.llm import linededup, mil, mixing, packing, simhash, sketch, tokencount
from gridscape.llm.queries import byte_vocabulary

SF = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_narrow_operators_read_two_columns_and_move_nothing(spark, docs):
    model = mil.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for df in (
        tokencount.token_counts(docs, public_tokenizers.path("word_bpe_49k.json")),
        packing.pack(docs, byte_vocabulary()),
        mil.scored(docs, model),
        simhash.fingerprints(docs),
        sketch.document_sketches(docs),
    ):
        p = physical(df)
        assert "Exchange" not in p and "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_no_plan_multiplies_rows(docs):
    for df in (simhash.keep_first(docs), linededup.deduplicated(docs), mixing.training_order(docs), sketch.with_successors(docs)):
        p = physical(df)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_mixing_is_native_and_reads_no_text_twice(docs):
    p = physical(mixing.mix(docs))
    assert not any(x in p for x in ("Python", "Arrow", "Pandas")) and "text" not in p.split("ReadSchema", 1)[1].split("\n", 1)[0]
