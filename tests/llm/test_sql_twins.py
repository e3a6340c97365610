"""The queries that have an SQL twin, on the whole tables; every query once for its columns."""

from __future__ import annotations

import oracle
import pytest

from newsloom.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_curriculum": ["doc_id", "size", "source_size", "target", "taken"],
    "op2_minhash": ["doc_id", "n_shingles", "component_id", "kept"],
    "op3_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op5_suffix_array": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op6_license_scan": ["doc_id", "n_notices", "license", "dice"],
    "op7_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op8_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op9_ball_tree": ["query_id", "rank", "vec_id", "score"],
    "op10_merkle": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op11_crosswalk": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op12_resampling": ["doc_id", "n_features", "weight", "score", "rank"],
    "op13_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
}


@pytest.mark.parametrize("name", ORACLES)
def test_twin(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns == COLUMNS[name]
    assert oracle.compare(df, oracle.connect(sf_dir), ORACLES[name]) == ""


def test_all_are_registered():
    import __spark_entry__ as contract

    assert set(COLUMNS) == set(QUERIES) and set(COLUMNS) | {"pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", ["op1_curriculum", "op6_license_scan", "op10_merkle"])
def test_native_plans(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))
