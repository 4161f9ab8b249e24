"""Queries over the column functions (B) and predicates (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import columns as C
from ..operators import ledger, query, recall
from ..sources.transcripts import canonical_events
from .texts import GATE_LINES_SQL, gate_lines

QUERIES, ORACLES = {}, {}


def _in(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


def kebab_sql(e: str) -> str:
    return f"lower(replace(regexp_replace(regexp_replace({e}, '([a-z])([A-Z])', '\\1-\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1-\\2', 'g'), '_', '-'))"


def dashes_sql(e: str) -> str:
    return f"trim(regexp_replace({e}, '-+', '-', 'g'), '-')"


TOKENS = "regexp_extract_all(regexp_replace(lower(text), '[^a-z0-9\\s-]', ' ', 'g'), '[a-z][a-z0-9_.-]{2,}')"
CONTENT = f"list_filter(list_distinct({TOKENS}), lambda w: w NOT IN ({_in(C.STOPWORDS)}))"
NAME_PARTS = "list_distinct(regexp_extract_all(lower(name), '[a-z]{3,}'))"


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _talk(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet")


_NAME = lambda: F.concat(F.lit("Doc_"), F.initcap("lang"), F.lit("From"), F.initcap("source"), F.lit("__HTTPPage-"), F.col("doc_id"))
_NAME_SQL = "concat('Doc_', upper(substr(lang, 1, 1)), substr(lang, 2), 'From', upper(substr(source, 1, 1)), substr(source, 2), '__HTTPPage-', doc_id)"

QUERIES["b1_normalize_name"] = lambda s, d: _docs(s, d).select("doc_id", C.normalize_name(_NAME()).alias("name"), (C.normalize_name(C.normalize_name(_NAME())) == C.normalize_name(_NAME())).alias("idempotent"))
ORACLES["b1_normalize_name"] = f"SELECT doc_id, {dashes_sql(kebab_sql(_NAME_SQL))} AS name, true AS idempotent FROM documents"

QUERIES["b2_slug_title"] = lambda s, d: _docs(s, d).select("doc_id", C.slug_title(F.col("text")).alias("slug"))
ORACLES["b2_slug_title"] = f"SELECT doc_id, substr({dashes_sql('regexp_replace(' + kebab_sql('text') + ', ' + repr('[^a-z0-9-]') + ', ' + repr('-') + ', ' + repr('g') + ')')}, 1, 60) AS slug FROM documents"

QUERIES["b3_research_slug"] = lambda s, d: _docs(s, d).select("doc_id", C.research_slug(F.col("text"), F.lit("2024-01-31")).alias("slug"))
ORACLES["b3_research_slug"] = "SELECT doc_id, concat('research-2024-01-31-', regexp_replace(trim(substr(regexp_replace(lower(trim(text, ' ')), '[^a-z0-9-]', '-', 'g'), 1, 50), '-'), '-+', '-', 'g')) AS slug FROM documents"

QUERIES["b4_content_words"] = lambda s, d: _talk(s, d).select("conv_id", "turn", F.array_join(F.sort_array(C.content_words(F.col("text"))), ",").alias("words"))
ORACLES["b4_content_words"] = f"SELECT conv_id, turn, array_to_string(list_sort({CONTENT}), ',') AS words FROM conversations"

QUERIES["b5_hyphen_ngrams"] = lambda s, d: _talk(s, d).select("conv_id", "turn", F.array_join(C.hyphen_ngrams(C.query_tokens(F.col("text"))), ",").alias("grams"))
ORACLES["b5_hyphen_ngrams"] = f"SELECT conv_id, turn, array_to_string(flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(1, least(3, len(w) - i + 1) + 1), lambda k: array_to_string(w[i : i + k - 1], '-')))), ',') AS grams FROM (SELECT conv_id, turn, {TOKENS} AS w FROM conversations)"

QUERIES["b6_stem_variants"] = lambda s, d: _talk(s, d).select(F.explode(C.content_words(F.col("text"))).alias("word")).distinct().select("word", F.array_join(C.stem_variants(F.col("word")), ",").alias("stems"))
_STEMS = """list_filter([word, CASE WHEN word LIKE '%ies' THEN concat(substr(word, 1, len(word) - 3), 'y') WHEN word LIKE '%es' THEN substr(word, 1, len(word) - 2) WHEN word LIKE '%s' AND word NOT LIKE '%ss' THEN substr(word, 1, len(word) - 1) END,
 CASE WHEN word LIKE '%ing' AND len(word) > 5 THEN substr(word, 1, len(word) - 3) END, CASE WHEN word LIKE '%ed' AND len(word) > 4 THEN substr(word, 1, len(word) - 2) END], lambda x: x IS NOT NULL)"""


def stems_sql() -> str:
    return _STEMS


ORACLES["b6_stem_variants"] = f"SELECT word, array_to_string({stems_sql()}, ',') AS stems FROM (SELECT DISTINCT unnest({CONTENT}) AS word FROM conversations)"

QUERIES["b7_name_parts"] = lambda s, d: X.spark_table(s, d, "entities").select("id", F.array_join(F.sort_array(C.name_parts(F.col("name"))), ",").alias("parts"))
ORACLES["b7_name_parts"] = X.oracle(f"SELECT id, array_to_string(list_sort({NAME_PARTS}), ',') AS parts FROM entities", "entities")

QUERIES["b8_concept_words"] = lambda s, d: _docs(s, d).select("doc_id", F.array_join(F.sort_array(C.concept_words(F.col("text"))), ",").alias("words"))
ORACLES["b8_concept_words"] = f"SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9]{{2,}}')), lambda w: w NOT IN ({_in(C.STOP_CONCEPTS)}))), ',') AS words FROM documents"

QUERIES["b9_token_cost"] = lambda s, d: _docs(s, d).select("doc_id", C.token_estimate(F.col("text")).alias("tokens"), F.round(C.cost_estimate(C.token_estimate(F.col("text"))), 9).alias("usd"))
ORACLES["b9_token_cost"] = "SELECT doc_id, t AS tokens, round(t / 1e6 * 0.8 + t * 0.1 / 1e6 * 3.0, 9)::DOUBLE AS usd FROM (SELECT doc_id, length(text) // 4 AS t FROM documents)"

QUERIES["b10_chunk_text"] = lambda s, d: _docs(s, d).select("doc_id", F.posexplode(C.chunk_text(F.col("text"), 200)).alias("chunk_no", "chunk"))
ORACLES["b10_chunk_text"] = "SELECT doc_id, i::INTEGER AS chunk_no, substr(text, i * 800 + 1, 800) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil(length(text) / 800.0)::BIGINT))) AS i FROM documents)"

QUERIES["b11_cap_with_marker"] = lambda s, d: _docs(s, d).select("doc_id", C.cap_with_marker(F.col("text"), 600).alias("capped"))
ORACLES["b11_cap_with_marker"] = "SELECT doc_id, CASE WHEN length(text) > 600 THEN concat(substr(text, 1, 600), '...[+', length(text) - 600, ']') ELSE text END AS capped FROM documents"

_PATH = lambda: F.concat(F.when(F.col("lang") == "en", "/workspaces/coding/").when(F.col("lang") == "fr", "/home/node/.claude/").otherwise("/srv/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
QUERIES["b12_paths"] = lambda s, d: _docs(s, d).select("doc_id", C.translate_path(_PATH(), {"/home/node/.claude/": "/Users/test/.claude/", "/workspaces/coding/": "/Users/test/coding/"}).alias("path"), C.detect_context(_PATH()).alias("context"))
ORACLES["b12_paths"] = "SELECT doc_id, concat(CASE lang WHEN 'en' THEN '/Users/test/coding/' WHEN 'fr' THEN '/Users/test/.claude/' ELSE '/srv/' END, source, '/', doc_id) AS path, CASE WHEN lang = 'en' THEN 'devcontainer' ELSE 'host' END AS context FROM documents"

QUERIES["b13_truncate_bytes"] = lambda s, d: _docs(s, d).select("doc_id", C.truncate_bytes(F.col("text"), 450, "[cut]").alias("short"))
ORACLES["b13_truncate_bytes"] = "SELECT doc_id, CASE WHEN strlen(text) > 450 THEN concat(substr(text, 1, list_max(list_filter(range(112, 451), lambda k: strlen(substr(text, 1, k)) <= 450))), '[cut]') ELSE text END AS short FROM documents"

_START = "array('Run ', 'look at ', 'What is ', '')"


def c1(s, d):
    """Every turn as a whole, and each of its sentences as a message of its own."""
    start = F.element_at(F.expr(_START), (F.col("turn") % 4 + 1).cast("int"))
    said = _talk(s, d).select("conv_id", "turn", F.lit(-1).alias("pos"), "text")
    parts = _talk(s, d).select("conv_id", "turn", F.posexplode(F.split("text", "[.] ")).alias("pos", "text"))
    return said.unionByName(parts).select("conv_id", "turn", "pos", C.skip_reason(F.concat(start, "text")).alias("reason"), C.skip_reason(F.col("text")).alias("plain"))


QUERIES["c1_skip_reason"] = c1


def skip_sql(e: str) -> str:
    rows = "".join(f" WHEN regexp_matches(trim({e}, ' '), '(?i){p}') THEN '{r}'" for r, p in C.SKIP_PATTERNS.items())
    return f"CASE WHEN length(trim({e}, ' ')) < 15 THEN 'short'{rows} WHEN length(trim({e}, ' ')) < 50 AND regexp_matches(trim({e}, ' '), '(?i){C.DIRECTIVE}') AND NOT regexp_matches(trim({e}, ' '), '{C.ENTITY_SHAPE}') THEN 'directive' END"


ORACLES["c1_skip_reason"] = f"""SELECT conv_id, turn, pos, {skip_sql("concat(['Run ', 'look at ', 'What is ', ''][turn % 4 + 1], text)")} AS reason, {skip_sql('text')} AS plain
 FROM (SELECT conv_id, turn, -1 AS pos, text FROM conversations UNION ALL SELECT conv_id, turn, unnest(range(0, len(ts)))::INTEGER, unnest(ts) FROM (SELECT conv_id, turn, string_split(text, '. ') AS ts FROM conversations))"""

_ASK = lambda: F.concat(F.element_at(F.array(F.lit("Run "), F.lit("look at "), F.lit("What is "), F.lit("")), (F.col("turn") % 4 + 1).cast("int")), "text", F.when(F.col("turn") % 4 == 2, "?").otherwise(""))
QUESTION_SQL = f"(contains(text, '?') OR regexp_matches(text, '(?i){C.QUESTION}'))"
QUERIES["c2_is_question"] = lambda s, d: _talk(s, d).select("conv_id", "turn", C.is_question(_ASK()).alias("question"))
ORACLES["c2_is_question"] = f"SELECT conv_id, turn, contains(m, '?') OR regexp_matches(m, '(?i){C.QUESTION}') AS question FROM (SELECT conv_id, turn, concat(['Run ', 'look at ', 'What is ', ''][turn % 4 + 1], text, CASE WHEN turn % 4 = 2 THEN '?' ELSE '' END) AS m FROM conversations)"

_SIGNAL_SQL = C.SIGNAL
QUERIES["c3_session_work_gate"] = lambda s, d: ledger.session_work_gate(canonical_events(gate_lines(s, d, 0)).select("session_id", "seq", "role", "tools", "raw"))
QUERIES["c4_cursor_work_gate"] = lambda s, d: ledger.cursor_work_gate(canonical_events(gate_lines(s, d, 1)).select("session_id", "seq", "role", "raw"))
_GATE = """SELECT session_id, count_if(role = 'user') AS user_turns, {edits} AS edits, regexp_matches(right(string_agg(line, chr(10) ORDER BY seq), 20000), '{signal}') AS signal,
 count_if(role = 'user') >= 6 AND {edits} AND regexp_matches(right(string_agg(line, chr(10) ORDER BY seq), 20000), '{signal}') AS passes FROM ({lines}) GROUP BY session_id"""
ORACLES["c3_session_work_gate"] = _GATE.format(edits="coalesce(bool_or(tool IN ('Edit', 'Write')), false)", signal=C.SIGNAL, lines=GATE_LINES_SQL)
ORACLES["c4_cursor_work_gate"] = _GATE.format(edits="bool_or(regexp_matches(line, '" + ledger.CURSOR_EDIT + "'))", signal=C.SIGNAL, lines=GATE_LINES_SQL)


def c5(s, d):
    g = X.graph(s, d)
    return g.entities.join(g.obsolete_ids(), F.col("id") == F.col("entity_id"), "left_anti").select("id", "name")


QUERIES["c5_obsolete_filter"] = c5
ORACLES["c5_obsolete_filter"] = X.oracle("SELECT id, name FROM entities WHERE id NOT IN (SELECT entity_id FROM properties WHERE key = 'status' AND value = 'obsolete')", "entities", "properties")

DEGREES_SQL = "SELECT id, sum(o) AS out_degree, sum(i) AS in_degree FROM (SELECT source_id AS id, 1 AS o, 0 AS i FROM relationships UNION ALL SELECT target_id, 0, 1 FROM relationships) GROUP BY id"
HUBS_SQL = "SELECT name, type, coalesce(out_degree, 0)::BIGINT AS out_degree, coalesce(in_degree, 0)::BIGINT AS in_degree, (coalesce(out_degree, 0) + coalesce(in_degree, 0))::BIGINT AS degree FROM entities LEFT JOIN degrees USING (id) ORDER BY degree DESC, name LIMIT 10"


def c6(s, d):
    g = X.graph(s, d)
    return recall.recall_edges(g, query.hubs(g, 10)).select("source", "relation", "target")


QUERIES["c6_hub_suppression"] = c6
ORACLES["c6_hub_suppression"] = X.oracle(
    "SELECT s.name AS source, relation, t.name AS target FROM relationships r JOIN entities s ON s.id = source_id JOIN entities t ON t.id = target_id WHERE s.name NOT IN (SELECT name FROM hubs) AND s.id NOT IN (SELECT entity_id FROM gone) AND t.id NOT IN (SELECT entity_id FROM gone)",
    "entities", "relationships", "properties", extra={"degrees": DEGREES_SQL, "hubs": HUBS_SQL, "gone": "SELECT entity_id FROM properties WHERE key = 'status' AND value = 'obsolete'"},
)


def c7(s, d):
    refs = s.read.parquet(f"{d}/pages.parquet").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('"([^"<>]+)"'), 1)).alias("ref"))
    return refs.groupBy("page_id", "ref").agg(F.count(F.lit(1)).alias("n")).select("page_id", "ref", "n", C.path_like(F.col("ref")).alias("path_like"))


QUERIES["c7_path_like_token"] = c7
PATH_LIKE_SQL = "(t <> '' AND NOT contains(t, ' ') AND NOT starts_with(t, '-') AND NOT starts_with(t, 'http') AND NOT contains(t, '(') AND NOT ends_with(t, ')') AND (regexp_matches(b, '\\.(" + "|".join(C.PATH_EXTENSIONS) + ")$') OR (contains(b, '/') AND contains(split_part(b, '/', -1), '.') AND NOT starts_with(split_part(b, '/', -1), '.'))))"
ORACLES["c7_path_like_token"] = f"SELECT page_id, ref, n, {PATH_LIKE_SQL} AS path_like FROM (SELECT page_id, ref, n, trim(ref, ' ') AS t, regexp_replace(trim(ref, ' '), ':[0-9]+$', '') AS b FROM (SELECT page_id, ref, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '\"([^\"<>]+)\"', 1)) AS ref FROM pages) GROUP BY ALL))"


def c8(s, d):
    g, said = X.graph(s, d), recall.worded(X.spark_table(s, d, "messages"))
    parts = g.entities.select("name", F.explode(C.name_parts(F.col("name"))).alias("word"))
    pairs = said.select("session_id", "turn", "words", F.explode("words").alias("word")).join(parts, "word").select("session_id", "turn", "words", "name").distinct()
    return recall._gated(pairs, g, F.array_intersect(C.name_parts(F.col("name")), "words")).select("session_id", "turn", "name")


QUERIES["c8_name_gate"] = c8
ORACLES["c8_name_gate"] = X.oracle(
    f"""SELECT session_id, turn, name FROM (SELECT session_id, turn, name, list(DISTINCT word) AS hit FROM (SELECT session_id, turn, unnest({CONTENT}) AS word FROM messages) m
 JOIN (SELECT name, unnest({NAME_PARTS}) AS part FROM entities) e ON word = part GROUP BY session_id, turn, name) WHERE NOT (len(hit) = 1 AND hit[1] IN (SELECT DISTINCT lower(type) FROM entities))""",
    "entities", "messages",
)
