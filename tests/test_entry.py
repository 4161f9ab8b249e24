import duckdb
import pytest

import __spark_entry__ as entry
from graphloom import fixtures as X

D = "/root/testdata/sf0.001"
FEW = ["b1_normalize_name", "c1_skip_reason", "e1_upsert_entities_fill", "f7_hubs", "h2_match_tool", "j5_dedupe_entities", "k2_slice_since", "l5_retry_ledger", "n3_streaks"]
FEW += ["a1_scan_sessions", "a5_last_blocks", "f2_search", "g11_session_dedup", "g12_assemble_payload", "h3_match_file", "h4_match_error", "h7_activate_lessons", "h8_activate_stream", "i4_extract_errors", "i5_extract_research", "i6_session_to_graph", "j2_prepare_chunks", "j3_extract_candidates", "n2_topics", "n4_goal_gaps"]

FEW += ["b13_truncate_bytes", "e1_upsert_entities_committed", "f1_entity_profile", "f4_shortest_path", "g3_search_after_changes", "j7_kept_candidates", "k1_compact_events", "l3_live_queue", "m4_refused_proposals"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in X.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def _text(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", FEW)
def test_oracle(spark, tables, name):
    df = entry.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(tuple(map(_text, r)) for r in df.select(*cols).collect())
    rel = tables.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(_text(r[i]) for i in at) for r in rel.fetchall())


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_the_absence_of_the_subpackage_is_passed_over():
    assert entry._absent(ModuleNotFoundError("x", name="graphloom.llm")) and entry._absent(ModuleNotFoundError("x", name="corpus_pipeline"))
    assert not entry._absent(ModuleNotFoundError("x", name="xxhash")) and not entry._absent(ModuleNotFoundError("x", name="graphloom.store"))
