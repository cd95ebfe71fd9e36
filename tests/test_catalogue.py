"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest
from tessera import queries as catalogue

SF = os.environ.get("TESSERA_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = (
    "token_stats term_df_idf bm25_topk bm25_filtered_topk vector_topk_filtered sparse_tfidf_topk lexical_gated_dense hybrid_rrf adaptive_weight_rrf source_merge vector_floor fallback_merge "
    "token_budget_prefix payload_filter_range array_any_match as_of_validity date_focused_sort temporal_arm classify_query classify_question query_shape stage_exact_rescue stage_hub stage_qlearning pipeline_full "
    "q_table_fold ior_keep_last char_chunks message_pairs sliding_windows stable_ids upsert_latest payload_diff prune_stale quota_check triples_as_of graph_token_hits graph_resurrection link_resolution "
    "folder_sync item_sources token_bucket resolved_ids canonical_values vector_index_topk superseded_facts tenant_listing sparse_vectors prompt_context "
    "subtopics citation_verdicts strip_metadata heartbeat_filter retrieval_metrics latency_quantiles stream_dedupe stream_session stream_state_fold"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    relation = duck.sql(catalogue.ORACLE[name])
    assert sorted(relation.columns) == names
    want = duck.sql(f"SELECT {', '.join(names)} FROM ({catalogue.ORACLE[name]})").fetchall()
    got = [tuple(r) for r in df.select(*names).collect()]
    assert sorted(map(repr, map(plain, got))) == sorted(map(repr, map(plain, want)))


def test_every_sql_has_its_query():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)
