"""Queries that do no more than they need: one resolving of imported edges, no labels per step, no index where pairs suffice."""

import __spark_entry__ as entry
from graphloom import fixtures, model
from graphloom.operators import kept_index, query
from graphloom.sources import interchange


def test_import_keeps_the_weight_of_a_name_in_another_spelling(spark):
    tables = {
        "entities": spark.createDataFrame([("Part_1", "t", "d"), ("b", "t", "d")], interchange.SCHEMAS["entities"]),
        "relationships": spark.createDataFrame([("Part_1", "uses", "b", 0.4), ("part-1", "uses", "b", 0.3), ("b", "uses", "Part_1", None), ("b", "uses", "nobody", 0.2)], interchange.SCHEMAS["relationships"]),
        "properties": spark.createDataFrame([("b", "k", "v")], interchange.SCHEMAS["properties"]),
    }
    g = interchange.graph_import(model.empty(spark), tables, "2024-01-31")
    assert sorted((r["source"], r["target"], r["weight"]) for r in g.named_edges().collect()) == [("b", "part-1", 1.0), ("part-1", "b", 0.4)]
    assert g.properties.count() == 1


def test_pairs_need_no_text_index(spark, tmp_path, monkeypatch):
    def none(*a, **k):
        raise AssertionError("built")

    monkeypatch.setattr(kept_index, "build", none)
    monkeypatch.setattr(fixtures, "_indexes", {})
    for name in ("g1_concept_index", "g2_idf_table"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_steps_are_not_aggregated(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(query, "Steps", lambda steps: seen.append(steps) or (_ for _ in ()).throw(StopIteration))
    try:
        query.shortest_path(model.empty(spark), spark.createDataFrame([], "a long, b long"))
    except (StopIteration, RuntimeError):
        pass
    assert "Aggregate" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_search_shuffles_no_texts(spark):
    e = spark.createDataFrame([(1, "a-b", "tool", "some long text", None, None, None), (2, "xsomex", "tool", None, None, None, None)], model.ENTITIES)
    p = spark.createDataFrame([(2, "k", "longer", None)], model.PROPERTIES)
    g = model.Graph(e, spark.createDataFrame([(1, 2, "some-rel", 1.0, None)], model.RELATIONSHIPS), p)
    hits = query.search(g, spark.createDataFrame([("some",), ("ome",), ("long",), ("",)], "term string"))
    assert sorted(map(tuple, hits.collect())) == sorted([("some", "fulltext", "a-b"), ("long", "fulltext", "a-b"), ("ome", "substring", "a-b"), ("ome", "substring", "xsomex"), ("long", "property", "xsomex"), ("some", "relation", "some-rel"), ("ome", "relation", "some-rel")])
    assert "_low" not in "".join(x for x in hits._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)
