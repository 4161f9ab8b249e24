"""Tables with a million parts and more: then part ids run into customer ids, and every query still equals its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom import fixtures as X
from graphloom import versions
from graphloom.model import Graph

D = "/root/testdata/sf0.001"
SHIFTED = {"part": "p_partkey", "lineitem": "l_partkey"}


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """sf0.001 with part keys from 1,000,000 on, each third of which is a customer's id in the graph."""
    root, con = tmp_path_factory.mktemp("shifted"), duckdb.connect()
    for t in X.TABLES:
        key = SHIFTED.get(t)
        con.sql(f"COPY (SELECT * {f'REPLACE ({key} + 1000000 - 50 AS {key})' if key else ''} FROM '{D}/{t}.parquet') TO '{root}/{t}.parquet'")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return str(root), con


def _text(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", ["f1_entity_profile", "e10_backfill_source_agent", "e11_touch_last_referenced", "e1_upsert_entities_committed", "e7_mark_obsolete", "i6_session_to_graph"])
def test_equals_sql_where_ids_are_shared(spark, shifted, name):
    root, con = shifted
    df = entry.queries()[name](spark, root)
    cols = sorted(df.columns)
    got = sorted(tuple(map(_text, r)) for r in df.select(*cols).collect())
    rel = con.sql(entry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(_text(r[i]) for i in at) for r in rel.fetchall())


def test_a_stored_graph_keeps_entities_that_share_an_id(spark, tmp_path):
    e = lambda *rows: spark.createDataFrame([(*r, None, None, None) for r in rows], versions.ENTITIES)
    r, p = (spark.createDataFrame([], s) for s in (versions.RELATIONSHIPS, versions.PROPERTIES))
    old = Graph(e((1, "a", "t", "x"), (1, "b", "t", "y"), (2, None, "t", "z")), r, p)
    v = versions.create(old, f"file://{tmp_path}/g", buckets=2)
    new = Graph(e((1, "a", "t", "x2"), (1, "c", "t", "y"), (2, None, "t", "z2")), r, p)
    v = versions.commit(spark, v, versions.changes(versions.read(spark, v), new))
    assert sorted(map(str, versions.read(spark, v).entities.collect())) == sorted(map(str, new.entities.collect()))
