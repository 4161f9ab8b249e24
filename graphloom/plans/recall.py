"""Queries over text indexes and recall (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from .. import versions
from ..operators import index as I
from ..operators import kept_index
from ..operators import mutate as M
from ..operators import query as Q
from ..operators import recall as R
from ..functions.columns import STOP_CONCEPTS
from .columns import CONTENT, NAME_PARTS, QUESTION_SQL, TOKENS, _in, skip_sql, stems_sql
from ..tables import folder, written
from .graph import CHANGES, PLAIN, POSTINGS, _changes

QUERIES, ORACLES = {}, {}
KEY = R.KEY


def _gm(s, d):
    return X.graph(s, d), X.spark_table(s, d, "messages")


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({e}), '[a-z][a-z0-9]{{2,}}'), lambda w: w NOT IN (" + _in(STOP_CONCEPTS) + ")))"


def _w(e: str) -> str:
    return _WORDS.format(e=e)


CONCEPTS = f"""SELECT DISTINCT term, name FROM (
 SELECT lower(name) AS name, unnest({_w("translate(name, '-_', '  ')")}) AS term FROM entities
 UNION ALL SELECT lower(name), lower(type) FROM entities WHERE type <> ''
 UNION ALL SELECT name, term FROM (SELECT lower(name) AS name, unnest({_w('description')}) AS term FROM entities WHERE description IS NOT NULL) WHERE len(term) >= 4
 UNION ALL SELECT name, term FROM (SELECT lower(name) AS name, unnest({_w("translate(relation, '-', ' ')")}) AS term FROM (SELECT source_id AS id, relation FROM relationships UNION SELECT target_id, relation FROM relationships) JOIN entities USING (id)) WHERE len(term) >= 4
 UNION ALL SELECT name, term FROM (SELECT lower(name) AS name, unnest({_w("translate(key, '-', ' ')")}) AS term FROM properties JOIN entities ON id = entity_id) WHERE len(term) >= 4
 UNION ALL SELECT name, term FROM (SELECT lower(name) AS name, unnest({_w('value')}) AS term FROM properties JOIN entities ON id = entity_id WHERE length(value) < 200) WHERE len(term) >= 5)"""
COMMON = {
    "concepts": CONCEPTS,
    "idf": "SELECT term, count(*) AS df, ln((SELECT count(*) FROM entities) / count(*)) AS idf FROM concepts GROUP BY term",
    "fine": "SELECT term, name FROM concepts WHERE term IN (SELECT term FROM idf WHERE df <= 15)",
    "low": "SELECT term FROM idf WHERE idf < 3.0",
    "said": f"SELECT session_id, turn, text, {CONTENT} AS words FROM messages",
    "types": "SELECT DISTINCT lower(type) AS t FROM entities WHERE type IS NOT NULL",
    "names": f"SELECT lower(name) AS name, lower(type) AS type, {NAME_PARTS} AS parts FROM entities",
}
G = ("entities", "relationships", "properties", "messages")

QUERIES["g1_concept_index"] = lambda s, d: I.concept_index(X.graph(s, d), pairs=X.concepts(s, d))
ORACLES["g1_concept_index"] = X.oracle("SELECT term, name FROM fine", *G, extra={k: COMMON[k] for k in ("concepts", "idf", "fine")})
QUERIES["g2_idf_table"] = lambda s, d: I.idf_table(X.graph(s, d), X.concepts(s, d)).select("term", "df", F.round("idf", 6).alias("idf"))
ORACLES["g2_idf_table"] = X.oracle("SELECT term, df, round(idf, 6) AS idf FROM idf", *G, extra={k: COMMON[k] for k in ("concepts", "idf")})

BM25 = {
    "postings": POSTINGS.replace("{p}", PLAIN),
    "asked": "SELECT DISTINCT word FROM terms_",
    "tf": "SELECT word, entity_id, sum(tf * CASE col WHEN 'name' THEN 10.0 WHEN 'type' THEN 0.1 ELSE 1.0 END)::DOUBLE AS tf FROM postings JOIN asked ON starts_with(token, word) GROUP BY ALL",
    "lens": "SELECT entity_id, sum(tf)::DOUBLE AS len FROM postings GROUP BY entity_id",
    "stat": "SELECT (SELECT count(*) FROM entities)::DOUBLE AS total, (SELECT sum(len) FROM lens) / (SELECT count(*) FROM entities) AS mean",
    "part": "SELECT word, entity_id, greatest(1e-6, ln((total - n + 0.5) / (n + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS part FROM tf JOIN (SELECT word, count(*) AS n FROM tf GROUP BY word) USING (word) JOIN lens USING (entity_id), stat",
    "scored": "SELECT session_id, turn, name, -sum(part) AS score FROM terms_ JOIN part USING (word) JOIN entities ON id = entity_id GROUP BY ALL",
}


def g3(s, d):
    g, m = _gm(s, d)
    words = R.worded(m).select(*KEY, F.explode("words").alias("word")).where((F.length("word") >= 5) & ~F.col("word").contains("-"))
    return I.bm25_search(g, words, KEY, kept=X.indexes(s, d)[1]).select(*KEY, "name", F.round("score", 6).alias("score"), "pos")


QUERIES["g3_bm25_search"] = g3
ORACLES["g3_bm25_search"] = X.oracle(
    "SELECT session_id, turn, name, round(score, 6) AS score, pos::INTEGER AS pos FROM (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY score, name) AS pos FROM scored) WHERE pos <= 10",
    *G, extra={"said": COMMON["said"], "terms_": "SELECT DISTINCT session_id, turn, word FROM (SELECT session_id, turn, unnest(words) AS word FROM said) WHERE len(word) >= 5 AND NOT contains(word, '-')", **BM25},
)
def g3_changed(s, d):
    """The search after a change set (E1 over parts and suppliers) has gone into a kept index; types are asked for as well."""
    g, m = _gm(s, d)
    kept = kept_index.build(g, folder(s, "index"))
    new = g.with_(entities=written(M.upsert_entities(g, _changes(s, d), X.AS_OF).entities, "changed"))
    kept = kept_index.update(kept, new, versions.changes(g, new)["entities"].select("id"))
    words = R.worded(m).select(*KEY, F.explode(F.concat("words", F.array(F.lit("vendor"), F.lit("produ")))).alias("word")).where((F.length("word") >= 5) & ~F.col("word").contains("-"))
    return kept_index.search(kept, words, KEY)[0].select(*KEY, "name", F.round("score", 6).alias("score"), "pos")


QUERIES["g3_search_after_changes"] = g3_changed
_NEW = {
    "changes": CHANGES,
    "changed": "SELECT e.id, e.name, CASE WHEN c.name IS NULL THEN e.type ELSE c.type END AS type, CASE WHEN c.name IS NULL THEN e.description ELSE c.description END AS description FROM entities e LEFT JOIN changes c ON lower(e.name) = c.name UNION ALL SELECT 1000000000 + row_number() OVER (), name, type, description FROM changes WHERE name NOT IN (SELECT lower(name) FROM entities)",
    **{k: v.replace("FROM entities", "FROM changed").replace("JOIN entities", "JOIN changed") for k, v in BM25.items()},
}
ORACLES["g3_search_after_changes"] = X.oracle(
    "SELECT session_id, turn, name, round(score, 6) AS score, pos::INTEGER AS pos FROM (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY score, name) AS pos FROM scored) WHERE pos <= 10",
    *G, extra={"said": COMMON["said"], "terms_": "SELECT DISTINCT session_id, turn, word FROM (SELECT session_id, turn, unnest(list_concat(words, ['vendor', 'produ'])) AS word FROM said) WHERE len(word) >= 5 AND NOT contains(word, '-')", **_NEW},
)
QUERIES["g4_hyphen_index"] = lambda s, d: I.postings(X.graph(s, d), I.HYPHENS)
ORACLES["g4_hyphen_index"] = X.oracle(POSTINGS.replace("{p}", "[\\p{L}\\p{N}_-]+"), "entities")

EXACT = f"""SELECT session_id, turn, name, len(list_intersect(parts, words))::INTEGER AS relevance FROM (SELECT DISTINCT session_id, turn, words, unnest(flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(1, least(3, len(w) - i + 1) + 1), lambda k: array_to_string(w[i : i + k - 1], '-'))))) AS gram
 FROM (SELECT session_id, turn, words, {TOKENS} AS w FROM said)) JOIN names ON gram = name"""
QUERIES["g5_match_exact"] = lambda s, d: R.match_exact(*_gm(s, d))
ORACLES["g5_match_exact"] = X.oracle(EXACT, *G, extra={k: COMMON[k] for k in ("said", "names")})

CONCEPT_HITS = {
    "word": "SELECT session_id, turn, words, unnest(words) AS word FROM said",
    "stem": f"SELECT * FROM (SELECT session_id, turn, words, word, unnest({stems_sql()}) AS stem FROM word WHERE {{word}}) WHERE {{stem}}",
    "hit": "SELECT session_id, turn, n.name, any_value(words) AS words, any_value(type) AS type, any_value(parts) AS parts, list(DISTINCT word) AS terms FROM stem JOIN fine f ON f.term = stem JOIN names n ON n.name = f.name GROUP BY session_id, turn, n.name",
    "graded": "SELECT session_id, turn, name, len(terms) >= 2 AS multi, (len(terms) + CASE WHEN len(terms) >= 2 THEN 2 * len(list_filter(terms, lambda t: t = type OR rtrim(t, 's') = type OR rtrim(t, 'es') = type)) ELSE 0 END)::INTEGER AS hits, len(list_intersect(parts, words))::INTEGER AS relevance, terms, list_intersect(parts, terms) AS found FROM hit",
    "ranked": """SELECT session_id, turn, name, multi, hits, relevance, row_number() OVER (PARTITION BY session_id, turn ORDER BY multi DESC, hits DESC, relevance DESC, name)::INTEGER AS pos, count_if(multi) OVER (PARTITION BY session_id, turn) AS n_multi FROM graded
 WHERE multi OR (len(list_filter(terms, lambda t: len(t) >= 6)) > 0 AND len(found) > 0 AND NOT (len(found) = 1 AND found[1] IN (FROM types)))""",
    "concept_hits": "SELECT session_id, turn, name, multi, hits, relevance, pos FROM ranked WHERE CASE WHEN n_multi >= 2 THEN multi AND pos <= 5 ELSE pos <= 4 END",
}


def _concept(word: str, stem: str) -> dict[str, str]:
    return {**COMMON, **{k: v.replace("{word}", word).replace("{stem}", stem) for k, v in CONCEPT_HITS.items()}}


WITH_IDF = _concept("word NOT IN (FROM low)", "stem = word OR stem NOT IN (FROM low)")
QUERIES["g6_match_concept"] = lambda s, d: R.match_concept(*_gm(s, d), pairs=X.concepts(s, d))
ORACLES["g6_match_concept"] = X.oracle("FROM concept_hits", *G, extra=WITH_IDF)
QUERIES["g6_match_concept_plain"] = lambda s, d: R.match_concept(*_gm(s, d), with_idf=False, pairs=X.concepts(s, d))
ORACLES["g6_match_concept_plain"] = X.oracle("FROM concept_hits", *G, extra=_concept(f"word NOT IN ({_in(R.PLAIN_STOPS)})", "true"))

TEXT = {
    "terms_": "SELECT DISTINCT session_id, turn, word FROM (SELECT session_id, turn, unnest(flatten(list_transform(words, lambda w: string_split(w, '-')))) AS word FROM said_) WHERE len(word) >= 5 AND word NOT IN (FROM low)",
    **BM25,
    "top5": "SELECT *, min(score) OVER (PARTITION BY session_id, turn) AS best FROM (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY score, name) AS pos FROM scored) WHERE pos <= 5",
    "text_hits": "SELECT session_id, turn, n.name, score, pos FROM (SELECT t.session_id, t.turn, lower(t.name) AS name, score, pos, words FROM top5 t JOIN said USING (session_id, turn) WHERE score / best >= 0.6) x JOIN names n USING (name) WHERE len(list_intersect(parts, words)) > 0 AND NOT (len(list_intersect(parts, words)) = 1 AND list_intersect(parts, words)[1] IN (FROM types))",
}
QUERIES["g7_match_fulltext"] = lambda s, d: R.match_fulltext(*_gm(s, d), *X.indexes(s, d)).select(*KEY, "name", F.round("score", 6).alias("score"), "pos")
ORACLES["g7_match_fulltext"] = X.oracle("SELECT session_id, turn, name, round(score, 6) AS score, pos::INTEGER AS pos FROM text_hits", *G, extra={**COMMON, "said_": "FROM said", **TEXT})
QUERIES["g8_match_fuzzy"] = lambda s, d: R.match_fuzzy(*_gm(s, d)).withColumn("score", F.round("score", 6))

STAGED = {
    **WITH_IDF,
    "exact": EXACT,
    "two": "SELECT session_id, turn, name, 1 AS stage, row_number() OVER (PARTITION BY session_id, turn ORDER BY relevance DESC, name) AS place FROM exact UNION ALL SELECT session_id, turn, name, 2, pos FROM concept_hits",
    "first_two": "SELECT session_id, turn, name, min((stage, place)) AS sp FROM two GROUP BY ALL",
    "full_": "SELECT session_id, turn FROM first_two GROUP BY ALL HAVING count(*) >= 3",
    "said_": "SELECT * FROM said WHERE (session_id, turn) NOT IN (SELECT (session_id, turn) FROM full_)",
    **TEXT,
    "three": "SELECT session_id, turn, name, sp FROM first_two UNION ALL SELECT session_id, turn, name, (3, pos) FROM text_hits",
    "matched": "SELECT session_id, turn, name, min(sp)[1]::INTEGER AS stage, row_number() OVER (PARTITION BY session_id, turn ORDER BY min(sp), name)::INTEGER AS rank FROM three GROUP BY session_id, turn, name",
}
QUERIES["g9_recall_match"] = lambda s, d: R.recall_match(*_gm(s, d), False, *X.indexes(s, d))
ORACLES["g9_recall_match"] = X.oracle("FROM matched", *G, extra=STAGED)
QUERIES["g9_recall_match_fuzzy"] = lambda s, d: R.recall_match(*_gm(s, d), True, *X.indexes(s, d))


def g10(s, d):
    g, m = _gm(s, d)
    return R.recall_context(g, R.recall_match(g, m, False, *X.indexes(s, d)).select(*KEY, "name", "rank"), Q.hubs(g, 3)).drop("name", "description")


QUERIES["g10_recall_context"] = g10
_ORDER = "CASE type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(R.NEIGHBOUR_TYPES)) + f" ELSE {len(R.NEIGHBOUR_TYPES)} END"
CONTEXT = {
    **STAGED,
    "gone": "SELECT DISTINCT entity_id FROM properties WHERE key = 'status' AND value = 'obsolete'",
    "deg": "SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM relationships UNION ALL SELECT target_id FROM relationships) GROUP BY id",
    "hubs": "SELECT name FROM entities JOIN deg USING (id) ORDER BY n DESC, name LIMIT 3",
    "seen": "SELECT session_id, turn, id, e.name, e.type, row_number() OVER (PARTITION BY session_id, turn ORDER BY rank)::INTEGER AS spot FROM matched m JOIN entities e ON lower(e.name) = m.name WHERE id NOT IN (FROM gone)",
    "edge": "SELECT source_id, s.name AS source, relation, t.name AS target, target_id, weight FROM relationships JOIN entities s ON s.id = source_id JOIN entities t ON t.id = target_id WHERE source_id NOT IN (FROM gone) AND target_id NOT IN (FROM gone) AND s.name NOT IN (FROM hubs)",
    "near": "SELECT *, row_number() OVER (PARTITION BY session_id, turn, spot ORDER BY relation, source, target) AS r FROM (SELECT session_id, turn, spot, id AS me, edge.* FROM seen JOIN edge ON id = source_id WHERE spot <= 5 UNION ALL SELECT session_id, turn, spot, id, edge.* FROM seen JOIN edge ON id = target_id WHERE spot <= 5 AND source_id <> target_id) QUALIFY r <= 6",
    "other": "SELECT DISTINCT session_id, turn, CASE WHEN me = source_id THEN target_id ELSE source_id END AS id FROM near",
}
CONTEXT_ROWS = f"""SELECT session_id, turn, 'entity' AS part, spot AS pos, concat(name, ' [', type, ']') AS line FROM seen WHERE spot <= 4
 UNION ALL SELECT * FROM (SELECT session_id, turn, 'edge', row_number() OVER (PARTITION BY session_id, turn ORDER BY spot, r)::INTEGER AS pos, concat(source, ' --[', relation, ']--> ', target, CASE WHEN weight <> 1.0 THEN concat(' [', weight, ']') ELSE '' END) FROM near) WHERE pos <= 6
 UNION ALL SELECT * FROM (SELECT session_id, turn, 'connected', row_number() OVER (PARTITION BY session_id, turn ORDER BY {_ORDER}, name)::INTEGER AS pos, concat(name, ' [', type, ']') FROM other JOIN entities USING (id) WHERE (session_id, turn, id) NOT IN (SELECT (session_id, turn, id) FROM seen) AND name NOT IN (FROM hubs) AND type NOT IN ({_in(R.HIDDEN_TYPES)}) AND coalesce(description, '') <> '') WHERE pos <= 4
 UNION ALL SELECT * FROM (SELECT session_id, turn, 'property', row_number() OVER (PARTITION BY session_id, turn ORDER BY spot, r)::INTEGER AS pos, concat(name, '.', key, ' = ', substr(value, 1, 150)) FROM (SELECT *, row_number() OVER (PARTITION BY session_id, turn, spot ORDER BY key) AS r FROM seen JOIN properties ON entity_id = id WHERE spot <= 4) WHERE r <= 3) WHERE pos <= 6"""
ORACLES["g10_recall_context"] = X.oracle(CONTEXT_ROWS, *G, extra=CONTEXT)


def g11(s, d):
    g, m = _gm(s, d)
    return R.session_dedup(g, R.recall_match(g, m, False, *X.indexes(s, d)), m)


EMITTED = {
    "lists": "SELECT session_id, turn, question, list(name ORDER BY rank, name) AS names, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS r FROM (SELECT m.session_id, m.turn, e.name, m.rank, " + QUESTION_SQL + """ AS question FROM matched m JOIN entities e ON lower(e.name) = m.name JOIN {talk} t ON t.session_id = m.session_id AND t.turn = m.turn
 WHERE id NOT IN (SELECT entity_id FROM properties WHERE key = 'status' AND value = 'obsolete')) GROUP BY session_id, turn, question""",
    "run": """SELECT DISTINCT session_id, 0::BIGINT AS r, turn * 0 AS turn, []::VARCHAR[] AS seen, false AS fired, []::VARCHAR[] AS emit, false AS before FROM lists WHERE r = 1
 UNION ALL SELECT session_id, r, turn, list_concat(seen, emit[1:4]), fired OR len(emit) > 0, emit, fired FROM (SELECT l.session_id, l.r, l.turn, seen, fired, CASE WHEN len(list_filter(names, lambda x: NOT list_contains(seen, x))) > 0 THEN list_filter(names, lambda x: NOT list_contains(seen, x)) WHEN question THEN names ELSE []::VARCHAR[] END AS emit
 FROM run JOIN lists l ON l.session_id = run.session_id AND l.r = run.r + 1)""",
    "emitted": "SELECT session_id, turn, unnest(emit) AS name, unnest(range(1, len(emit) + 1))::INTEGER AS rank, NOT before AS first_fire FROM run WHERE len(emit) > 0",
}
QUERIES["g11_session_dedup"] = g11
ORACLES["g11_session_dedup"] = X.oracle("FROM emitted", *G, extra={**STAGED, **{k: v.replace("{talk}", "messages") for k, v in EMITTED.items()}}).replace("WITH ", "WITH RECURSIVE ", 1)
QUERIES["g12_assemble_payload"] = lambda s, d: R.recall(*_gm(s, d), False, *X.indexes(s, d))
_RECALLED = {
    "open_": f"SELECT * FROM messages WHERE {skip_sql('text')} IS NULL",
    **STAGED,
    "said": f"SELECT session_id, turn, text, {CONTENT} AS words FROM open_",
    **{k: v.replace("{talk}", "open_") for k, v in EMITTED.items()},
    "shown": "SELECT session_id, turn, lower(name) AS name, rank FROM emitted",
    **{k: v for k, v in CONTEXT.items() if k not in STAGED},
    "hubs": "SELECT NULL::VARCHAR AS name WHERE false",
    "context": CONTEXT_ROWS,
    "fire": "SELECT session_id, turn, bool_or(first_fire) AS first FROM emitted GROUP BY ALL",
}
_RECALLED["seen"] = _RECALLED["seen"].replace("FROM matched m", "FROM shown m")
_RECALLED["edge"] = _RECALLED["edge"].replace(" AND s.name NOT IN (FROM hubs)", "")
_RECALLED["context"] = _RECALLED["context"].replace(" AND name NOT IN (FROM hubs)", "")
_RECALLED["context"] = _RECALLED["context"].replace("concat(name, ' [', type, ']') AS line FROM", "concat(name, ' [', type, ']: ', coalesce(nullif(substr(description, 1, 80), ''), '(no description)')) AS line FROM").replace("concat(name, ' [', type, ']') FROM other", "concat(name, ' [', type, ']: ', substr(description, 1, 60)) FROM other")
_RECALLED["seen"] = _RECALLED["seen"].replace("e.type,", "e.type, e.description,")
_PARTS = {"entity": "", "connected": "Connected (1-hop):\n", "edge": "Relationships:\n", "property": "Properties:\n"}
ORACLES["g12_assemble_payload"] = X.oracle(
    f"""SELECT session_id, turn, concat_ws(chr(10), CASE WHEN NOT first THEN '{R.LATER}' WHEN {QUESTION_SQL} THEN '{R.ASKED}' ELSE '{R.TOLD}' END, concat('Matched: ', names), {', '.join(f"CASE WHEN {p} IS NOT NULL THEN concat('{t}', {p}) END" for p, t in _PARTS.items())}, CASE WHEN first THEN '{R.HINT}' END) AS payload
 FROM (SELECT session_id, turn, first, {', '.join(f"string_agg(line_, chr(10) ORDER BY pos) FILTER (part = '{p}') AS {p}" for p in _PARTS)}, any_value(names) AS names FROM
 (SELECT *, concat('  ', line, CASE WHEN part = 'property' AND contains(line, '.doc = ') THEN concat(chr(10), '  [Deep context available: ', substr(line, position(' = ' IN line) + 3), ']') ELSE '' END) AS line_ FROM context JOIN fire USING (session_id, turn)
 JOIN (SELECT session_id, turn, string_agg(name, ', ' ORDER BY spot) AS names FROM seen WHERE spot <= 4 GROUP BY ALL) USING (session_id, turn)
 WHERE pos <= CASE WHEN part = 'entity' THEN 4 WHEN first THEN CASE WHEN part = 'connected' THEN 4 ELSE 6 END WHEN part = 'connected' THEN 2 ELSE 3 END) GROUP BY session_id, turn, first) JOIN open_ USING (session_id, turn)""",
    *G, extra=_RECALLED,
).replace("WITH ", "WITH RECURSIVE ", 1)
QUERIES["g13_phrase_blacklist"] = lambda s, d: R.phrase_blacklist(s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), F.concat_ws(" ", "event_type", F.col("user_id") % 7).alias("phrase")))
ORACLES["g13_phrase_blacklist"] = "SELECT phrase, min(event_id) AS pos FROM (SELECT event_id, concat(event_type, ' ', user_id % 7) AS phrase FROM events ORDER BY event_id DESC LIMIT 50) GROUP BY phrase ORDER BY pos DESC LIMIT 20"
