"""What the physical plans must and must not hold."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscape.operators import metrics as M
from gridscape.operators.assign import nearest
from gridscape.operators.som import SOMModel
from gridscape.plans.planner import LOCAL_BYTES, added_up, plan
from gridscape.schema import assemble
from tests.helpers import frame, waves

SF = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_reads_two_columns_and_moves_nothing(spark):
    rows = assemble(spark.read.parquet(f"{SF}/embeddings.parquet"), "embedding", "vec_id")
    model = SOMModel(np.eye(4, 64), 2, 2)
    for df in (model.transform(rows), model.mapped(rows, np.arange(4)), nearest(rows, np.eye(4, 64))):
        p = physical(df)
        assert "Exchange" not in p and "Join" not in p
        assert re.search(r"ReadSchema: struct<vec_id:bigint,embedding:array<float>>", p)


def test_filters_reach_the_scan(spark):
    rows = assemble(spark.read.parquet(f"{SF}/lineitem.parquet").where("l_shipdate < '1995-01-01'"), ["l_quantity", "l_discount"], "l_orderkey")
    p = physical(rows)
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate" in p and "l_comment" not in p


def test_a_codebook_join_is_broadcast(spark):
    rows = frame(spark, waves(20, 2))
    p = physical(nearest(rows, np.eye(2), plan="array"))
    assert "BroadcastNestedLoopJoin" in p and "CartesianProduct" not in p


def test_pair_scores_emit_aggregates(spark):
    """Rows by label and block, not by pair."""
    n, labels = 200, 4
    rows = frame(spark, waves(n, 2), np.arange(n) % labels)
    assert M._distances_by_label(rows).count() == n * labels
    p = physical(M.silhouette(rows))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_training_sums_are_state_sized(spark):
    x = waves(100, 3)
    total = added_up(frame(spark, x).repartition(7), lambda b: b.T @ b)
    assert total.shape == (3, 3) and np.allclose(total, x.T @ x)


@pytest.mark.parametrize("n,d,want", [(1000, 4, "local"), (LOCAL_BYTES, 1, "distributed"), (10**12, 64, "distributed")])
def test_planner(n, d, want):
    assert plan(n, d) == want and plan(n, d, "local") == "local"


def test_label_lookup_is_an_expression(spark):
    model = SOMModel(np.array([[0.0], [10.0]]), 1, 2)
    got = model.mapped(frame(spark, [[1.0], [9.0]]), np.array([7, 3])).select(F.collect_list("label")).first()[0]
    assert sorted(got) == [3, 7]
