"""Registered operator queries against their SQL twins on the smallest tables; the others run and give every row."""

from __future__ import annotations

import pytest

from filmloom.llm.queries import ORACLES, QUERIES
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_twins(spark, con, name):
    outcome = compare(spark, con, name, SF, QUERIES, ORACLES)
    assert outcome.startswith("ok"), outcome


@pytest.mark.parametrize("name", ["op1_secret_scan", "op2_bpe_round_trip", "op3_toxicity", "op4_quality", "op9_lm_scoring"])
def test_one_row_for_each_document(spark, name):
    ids = [r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in QUERIES[name](spark, SF).select("doc_id").collect()) == sorted(ids)
