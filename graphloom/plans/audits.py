"""Queries over proposals (M) and audits (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import audit as A
from ..operators import proposals as P
from .columns import PATH_LIKE_SQL, _in
from .graph import PLAIN, POSTINGS

QUERIES, ORACLES = {}, {}
AS_OF = X.AS_OF


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _entries(s, d):
    return _t(s, d, "events").select(F.col("event_id").alias("entry_no"), F.to_date("ts").alias("date"), F.col("event_type").alias("project"), F.concat("event_type", F.lit(" error "), "props").alias("content"))


ENTRIES = "SELECT event_id AS entry_no, CAST(ts AS DATE) AS date, event_type AS project, concat(event_type, ' error ', props) AS content FROM events"


def _docs(s, d):
    return _t(s, d, "documents").select(F.col("doc_id").alias("entry_no"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 17 * 2).cast("int")).alias("date"), F.col("source").alias("project"), F.col("text").alias("content"))


DOCS = "SELECT doc_id AS entry_no, CAST(DATE '2024-01-01' + CAST(doc_id % 17 * 2 AS INTEGER) AS DATE) AS date, source AS project, text AS content FROM documents"
_day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)

SECTIONS = "SELECT DISTINCT concat(n_name, ' and more') AS section FROM nation"


def _notes(s, d):
    sections = _t(s, d, "nation").select(F.concat("n_name", F.lit(" and more")).alias("section"))
    notes = _t(s, d, "nation").select(F.lower("n_name").alias("name"), F.concat(F.lit("note "), "n_nationkey").alias("note")).unionByName(_t(s, d, "documents").select(F.concat(F.lit("doc "), "doc_id").alias("name"), F.lit("x").alias("note")))
    bullets = _t(s, d, "nation").where("n_regionkey = 1").select(F.concat("n_name", F.lit(" and more")).alias("section"), F.concat(F.lit(f"- {AS_OF}: note "), "n_nationkey").alias("bullet"))
    return sections, bullets, notes


QUERIES["m1_apply_notes"] = lambda s, d: P.apply_notes(*_notes(s, d), AS_OF)[0]
ORACLES["m1_apply_notes"] = f"SELECT min(x.section) AS section, concat('- {AS_OF}: note ', n_nationkey) AS bullet FROM nation JOIN ({SECTIONS}) x ON contains(lower(x.section), lower(n_name)) WHERE n_regionkey <> 1 GROUP BY n_name, n_nationkey"
QUERIES["m1_note_errors"] = lambda s, d: P.apply_notes(*_notes(s, d), AS_OF)[1]
ORACLES["m1_note_errors"] = "SELECT concat('doc ', doc_id) AS name, 'section not found' AS error FROM documents"


def _learned(s, d):
    items = _t(s, d, "documents").select(F.when(F.col("lang") == "en", "lesson").otherwise("insight").alias("kind"), F.concat(F.lit("Learned Thing_"), "doc_id").alias("title"), F.col("text").alias("body"), F.when(F.col("lang") == "fr", "unknown").when(F.col("lang") == "de", "high").alias("severity"))
    return P.apply_learnings(X.graph(s, d), items, AS_OF, "claude")


QUERIES["m2_apply_learnings"] = lambda s, d: _learned(s, d).entities.where("name LIKE 'learned-%'").select("name", "type", "description")
ORACLES["m2_apply_learnings"] = "SELECT concat('learned-thing-', doc_id) AS name, CASE WHEN lang = 'en' THEN 'lesson' ELSE 'insight' END AS type, substr(trim(text, ' '), 1, 500) AS description FROM documents"


def m2_facts(s, d):
    g = _learned(s, d)
    return g.properties.join(g.entities.where("name LIKE 'learned-%'").select("id", "name"), F.col("entity_id") == F.col("id")).select("name", "key", "value")


QUERIES["m2_learned_properties"] = m2_facts
ORACLES["m2_learned_properties"] = "SELECT concat('learned-thing-', doc_id) AS name, 'source-agent' AS key, 'claude' AS value FROM documents UNION ALL SELECT concat('learned-thing-', doc_id), 'severity', CASE WHEN lang = 'de' THEN 'high' ELSE 'medium' END FROM documents WHERE lang <> 'fr'"


def _memory(s, d):
    files = _t(s, d, "region").select(F.concat("r_name", F.lit(".md")).alias("filename"), F.lit("old").alias("type"), F.lit("old").alias("description"), F.lit("old").alias("content"))
    changes = _t(s, d, "documents").select(F.concat("source", F.lit(".md")).alias("filename"), F.col("lang").alias("type"), F.col("source").alias("description"), F.col("text").alias("content"), F.col("doc_id").alias("seq"))
    return files, changes


QUERIES["m3_apply_memory"] = lambda s, d: P.apply_memory(*_memory(s, d))
ORACLES["m3_apply_memory"] = "SELECT concat(r_name, '.md') AS filename, 'old' AS type, 'old' AS description, 'old' AS content FROM region UNION ALL SELECT concat(source, '.md'), arg_max(lang, doc_id), source, arg_max(text, doc_id) FROM documents GROUP BY source"


def _proposals(s, d):
    kind = F.element_at(F.array(*map(F.lit, ("project", "goal", "memory", "lesson", "insight", "correction", "obsolete"))), (F.col("doc_id") % 7 + 1).cast("int"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    return _t(s, d, "documents").select(F.col("doc_id").alias("seq"), kind.alias("kind"), F.when(F.col("doc_id") % 14 < 7, "algeria").otherwise(F.concat(F.lit("part-"), F.col("doc_id"))).alias("name"), F.concat(F.lit("n"), F.col("doc_id")).alias("note"), F.concat(F.lit("T "), F.col("doc_id")).alias("title"), F.col("text").alias("body"), none("severity"), F.concat("source", F.lit(".md")).alias("filename"), F.lit("t").alias("type"), none("description"), F.lit("c").alias("content"), F.lit("old").alias("reason"))


def m4(s, d):
    sections = _t(s, d, "documents").select(F.lit("ALGERIA plan").alias("section")).distinct()
    bullets = sections.select("section", F.lit("- x").alias("bullet"))
    return P.apply_proposals(X.graph(s, d), _proposals(s, d), sections, bullets, _memory(s, d)[0], AS_OF, "claude")[4]


QUERIES["m4_apply_proposals"] = m4
ORACLES["m4_apply_proposals"] = "SELECT kind, count(*) AS n FROM (SELECT ['project', 'goal', 'memory', 'lesson', 'insight', 'correction', 'obsolete'][doc_id % 7 + 1] AS kind, doc_id % 14 < 7 AS known FROM documents) WHERE kind NOT IN ('project', 'goal') OR known GROUP BY kind"

def m4_refused(s, d):
    """The same with a document whose headings, the documents' first lines, have no section for learnings: every learning is an error."""
    sections = _t(s, d, "documents").select(F.lit("ALGERIA plan").alias("section")).distinct()
    headings = _t(s, d, "documents").select(F.concat(F.lit("## "), F.split("text", "\n")[0]).alias("section"))
    out = P.apply_proposals(X.graph(s, d), _proposals(s, d), sections, sections.select("section", F.lit("- x").alias("bullet")), _memory(s, d)[0], AS_OF, "claude", headings)
    return out[5].select("name", "error").unionByName(out[4].select(F.col("kind").alias("name"), F.col("n").cast("string").alias("error")))


QUERIES["m4_refused_proposals"] = m4_refused
ORACLES["m4_refused_proposals"] = "SELECT concat('T ', doc_id) AS name, 'no section for learnings' AS error FROM documents WHERE doc_id % 7 IN (3, 4, 5)"

QUERIES["n1_project_activity"] = lambda s, d: A.project_activity(_docs(s, d)).select("project", "sessions", "words", _day("first"), _day("last"))
ORACLES["n1_project_activity"] = f"SELECT project, count(DISTINCT date) AS sessions, sum(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')))::BIGINT AS words, strftime(min(date), '%Y-%m-%d') AS first, strftime(max(date), '%Y-%m-%d') AS last FROM ({DOCS}) GROUP BY project"
QUERIES["n2_topics"] = lambda s, d: A.topics(_docs(s, d))
ORACLES["n2_topics"] = f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(lower(content), '[ªµºÀ-ÖØ-öø-ʯ]', '0', 'g'), '\\b[a-z][a-z-]+\\b')) AS word FROM ({DOCS})) WHERE len(word) > 3 AND word NOT IN ({_in(A.TOPIC_STOPS)}) GROUP BY word HAVING count(*) >= 2 ORDER BY n DESC, word LIMIT 30"
QUERIES["n3_streaks"] = lambda s, d: A.streaks(_docs(s, d).unionByName(_entries(s, d).where("project = 'purchase'"))).select("active", _day("first"), _day("last"), "span", "percent", "longest_run", "longest_gap", _day("gap_after"))
ORACLES["n3_streaks"] = f"""WITH days AS (SELECT DISTINCT date FROM ({DOCS} UNION ALL SELECT * FROM ({ENTRIES}) WHERE project = 'purchase')), runs AS (SELECT count(*) AS n FROM (SELECT date - row_number() OVER (ORDER BY date)::INTEGER AS g FROM days) GROUP BY g),
gaps AS (SELECT lag(date) OVER (ORDER BY date) AS b, date - lag(date) OVER (ORDER BY date) AS gap FROM days), top AS (SELECT gap, b FROM gaps WHERE b IS NOT NULL ORDER BY gap DESC, b LIMIT 1)
SELECT count(*) AS active, strftime(min(date), '%Y-%m-%d') AS first, strftime(max(date), '%Y-%m-%d') AS last, (max(date) - min(date) + 1)::INTEGER AS span, round(count(*) / (max(date) - min(date) + 1) * 100, 6)::DOUBLE AS percent, (SELECT max(n) FROM runs) AS longest_run, (SELECT gap::INTEGER FROM top) AS longest_gap, (SELECT strftime(b, '%Y-%m-%d') FROM top) AS gap_after FROM days"""
_GOALS = lambda s, d: _t(s, d, "part").select(F.col("p_type").alias("goal")).union(_t(s, d, "events").select("event_type")).union(_t(s, d, "documents").select("source")).distinct()
QUERIES["n4_goal_gaps"] = lambda s, d: A.goal_gaps(_GOALS(s, d), _docs(s, d), AS_OF)
ORACLES["n4_goal_gaps"] = f"""WITH goals AS (SELECT DISTINCT p_type AS goal FROM part UNION SELECT event_type FROM events UNION SELECT source FROM documents), keys AS (SELECT goal, unnest(regexp_extract_all(lower(goal), '\\w+')) AS k FROM goals), said AS (SELECT w, bool_or(date >= DATE '2024-01-17') AS r FROM (SELECT date, unnest(regexp_extract_all(lower(concat(content, ' ', project)), '\\w+')) AS w FROM ({DOCS})) GROUP BY w),
hit AS (SELECT goal, bool_or(r) AS r FROM keys JOIN said ON contains(w, k) WHERE len(k) > 3 GROUP BY goal) SELECT goal, CASE WHEN r IS NULL THEN 'NO SIGNAL' WHEN r THEN 'ACTIVE' ELSE 'STALLED' END AS state FROM goals LEFT JOIN hit USING (goal)"""
QUERIES["n5_activity_calendar"] = lambda s, d: A.activity_calendar(_entries(s, d), AS_OF).select(_day("date"), "n", "week", "weekday", "last30", "streak", "busiest")
ORACLES["n5_activity_calendar"] = f"""WITH c AS (SELECT date, count(*) AS n FROM ({ENTRIES}) GROUP BY date), sp AS (SELECT CAST(unnest(generate_series(DATE '2023-11-03', DATE '{AS_OF}', INTERVAL 1 DAY)) AS DATE) AS date), r AS (SELECT sp.date, coalesce(n, 0) AS n FROM sp LEFT JOIN c USING (date)),
isl AS (SELECT max(date) AS e, count(*) AS k FROM (SELECT date, date - row_number() OVER (ORDER BY date)::INTEGER AS g FROM c WHERE date <= DATE '{AS_OF}') GROUP BY g)
SELECT strftime(date, '%Y-%m-%d') AS date, n, ((date - DATE '2023-11-03') // 7)::BIGINT AS week, (isodow(date) - 1)::INTEGER AS weekday, (SELECT sum(n)::BIGINT FROM r WHERE date > DATE '2024-01-01') AS last30, (SELECT coalesce(max(k), 0) FROM isl WHERE e >= DATE '2024-01-30') AS streak, (SELECT max(n) FROM r) AS busiest FROM r"""
QUERIES["n6_worklog_patterns"] = lambda s, d: A.worklog_patterns(_entries(s, d), _GOALS(s, d))
ORACLES["n6_worklog_patterns"] = f"""WITH last AS (SELECT *, row_number() OVER (ORDER BY entry_no DESC) AS r FROM ({ENTRIES}) ORDER BY entry_no DESC LIMIT 15), goals AS (SELECT DISTINCT p_type AS goal FROM part UNION SELECT event_type FROM events UNION SELECT source FROM documents), words AS (SELECT goal, w FROM (SELECT goal, unnest(regexp_split_to_array(lower(goal), '\\s+')) AS w FROM goals) WHERE len(w) > 3)
SELECT 'time sink' AS finding, lower(project) AS key, count(DISTINCT entry_no) AS n FROM last WHERE r <= 10 GROUP BY lower(project) HAVING count(DISTINCT entry_no) >= 5
UNION ALL SELECT DISTINCT 'stalled goal', goal, 0::BIGINT FROM words WHERE goal NOT IN (SELECT goal FROM words JOIN last ON contains(lower(concat(content, ' ', project)), w))
UNION ALL SELECT 'problem density', '', n FROM (SELECT ({" + ".join(f"sum(len(regexp_extract_all(lower(content), '{w}')))" for w in A.PROBLEMS)})::BIGINT AS n FROM last WHERE r <= 10) WHERE n > 8"""


def _replaced(s, d):
    """Parts of large size say that they are superseded."""
    g = X.graph(s, d)
    big = _t(s, d, "part").where("p_size > 40").select((F.col("p_partkey") + 4000000).alias("id"), F.lit("was Superseded by another").alias("said"))
    e = g.entities.join(big, "id", "left").withColumn("description", F.coalesce("said", "description")).select(*g.entities.columns)
    return g.with_(entities=e)


QUERIES["n7_contradictions"] = lambda s, d: A.contradictions(_replaced(s, d))
ORACLES["n7_contradictions"] = X.oracle(
    "SELECT a.name AS name1, b.name AS name2 FROM e a JOIN e b ON a.type = b.type AND a.id < b.id WHERE " + "(" + " OR ".join(f"contains(lower(coalesce(a.description, '')), '{w}')" for w in A.REPLACED) + ") AND a.type <> 'reasoning' ORDER BY a.id, b.id LIMIT 20",
    "entities", extra={"e": "SELECT id, name, type, CASE WHEN id IN (SELECT 4000000 + p_partkey FROM part WHERE p_size > 40) THEN 'was Superseded by another' ELSE description END AS description FROM entities"},
)
QUERIES["n8_orphans"] = lambda s, d: A.orphans(X.graph(s, d))
ORACLES["n8_orphans"] = X.oracle("SELECT type, count(*) AS n, string_agg(name, ', ' ORDER BY name) FILTER (r <= 5) AS samples FROM (SELECT type, name, row_number() OVER (PARTITION BY type ORDER BY name) AS r FROM entities WHERE id NOT IN (SELECT source_id FROM relationships UNION SELECT target_id FROM relationships)) GROUP BY type", "entities", "relationships")
QUERIES["n9_stale_entities"] = lambda s, d: A.stale_entities(X.graph(s, d), AS_OF)
ORACLES["n9_stale_entities"] = X.oracle(f"SELECT name, value AS last_worked, (DATE '{AS_OF}' - value::DATE)::INTEGER AS days FROM entities JOIN properties ON entity_id = id WHERE key = 'last-worked' AND id NOT IN (SELECT entity_id FROM properties WHERE key = 'status' AND value IN ('paused', 'archived')) AND DATE '{AS_OF}' - value::DATE > 30 ORDER BY days DESC, name LIMIT 15", "entities", "properties")
QUERIES["n9_stale_direction"] = lambda s, d: A.stale_direction(_t(s, d, "orders").select(F.col("o_custkey").alias("doc"), F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" done")).alias("text")), AS_OF)
ORACLES["n9_stale_direction"] = f"SELECT o_custkey AS doc, strftime(min(o_orderdate), '%Y-%m-%d') AS oldest, (DATE '{AS_OF}' - min(o_orderdate)::DATE)::INTEGER AS days FROM orders GROUP BY o_custkey HAVING DATE '{AS_OF}' - min(o_orderdate)::DATE > 14"
QUERIES["n10_belief_evidence"] = lambda s, d: A.belief_evidence(X.graph(s, d), _t(s, d, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("we believe in "), "p_name", F.lit(" supplier")).alias("line")))
ORACLES["n10_belief_evidence"] = X.oracle(
    f"SELECT pos, line, sum(df)::BIGINT AS hits FROM (SELECT pos, line, unnest(list_filter(regexp_extract_all(lower(line), '\\w+'), lambda w: len(w) > 4 AND w NOT IN ({_in(A.BELIEF_STOPS)}))[1:3]) AS token FROM (SELECT p_partkey AS pos, concat('we believe in ', p_name, ' supplier') AS line FROM part ORDER BY p_partkey LIMIT 8)) JOIN (SELECT token, count(DISTINCT entity_id) AS df FROM postings GROUP BY token) USING (token) GROUP BY pos, line",
    "entities", extra={"postings": POSTINGS.replace("{p}", PLAIN)},
)
QUERIES["n11_graph_health"] = lambda s, d: A.graph_health(X.graph(s, d))
ORACLES["n11_graph_health"] = X.oracle("SELECT e AS entities, r AS edges, round(r / e, 6)::DOUBLE AS mean_edges, r / e < 1.0 AS low, e > 500 AND r / e < 1.2 AS outgrown FROM (SELECT (SELECT count(*) FROM entities) AS e, (SELECT count(*) FROM relationships) AS r)", "entities", "relationships")
QUERIES["n11_graph_tops"] = lambda s, d: A.graph_tops(X.graph(s, d))
ORACLES["n11_graph_tops"] = X.oracle("(SELECT 'type' AS part, type AS key, count(*) AS n FROM entities GROUP BY type ORDER BY n DESC, key LIMIT 8) UNION ALL (SELECT 'relation', relation, count(*) AS n FROM relationships GROUP BY relation ORDER BY n DESC, relation LIMIT 5)", "entities", "relationships")
QUERIES["n12_confidence"] = lambda s, d: A.confidence_distribution(X.graph(s, d))
ORACLES["n12_confidence"] = X.oracle("SELECT count_if(weight = 1.0)::BIGINT AS verified, count_if(weight > 0.3 AND weight < 1.0)::BIGINT AS inferred, count_if(weight <= 0.3)::BIGINT AS speculative, count(*) AS total, count_if(weight > 0.3 AND weight < 1.0) > count_if(weight = 1.0) AS more_inferred FROM relationships", "relationships")


def n13(s, d):
    refs = _t(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("t"))
    texts = refs.select(F.col("page_id").alias("file"), F.concat(F.lit("see `"), "t", F.lit(".md` and `x y`")).alias("text"))
    half = _t(s, d, "pages").agg(F.percentile("page_id", 0.5).alias("m"))
    inventory = refs.join(F.broadcast(half), F.col("page_id") <= F.col("m")).select(F.concat("t", F.lit(".md")).alias("path")).distinct()
    return A.dead_references(texts, inventory)


QUERIES["n13_dead_references"] = n13
ORACLES["n13_dead_references"] = f"""WITH refs AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS x FROM pages), inv AS (SELECT DISTINCT concat(x, '.md') AS path FROM refs WHERE page_id <= (SELECT quantile_cont(page_id, 0.5) FROM pages)),
r AS (SELECT page_id, concat(x, '.md') AS ref, trim(concat(x, '.md'), ' ') AS t, regexp_replace(trim(concat(x, '.md'), ' '), ':[0-9]+$', '') AS b FROM refs)
SELECT page_id AS file, count(*) AS refs, count_if(b NOT IN (FROM inv))::BIGINT AS dead, round(count_if(b NOT IN (FROM inv)) * 100.0 / count(*), 1)::DOUBLE AS percent FROM r WHERE NOT contains(ref, '`') AND {PATH_LIKE_SQL} GROUP BY page_id"""
QUERIES["n14_top_findings"] = lambda s, d: A.top_findings(_t(s, d, "orders").select(F.when(F.col("o_orderpriority").startswith("1"), "high").when(F.col("o_orderpriority").startswith("3"), "medium").otherwise("low").alias("priority"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("f"), F.col("o_orderkey")).alias("text")))
ORACLES["n14_top_findings"] = "SELECT row_number() OVER (ORDER BY p, seq)::INTEGER AS place, concat('f', seq) AS text FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY seq) AS r FROM (SELECT CASE WHEN starts_with(o_orderpriority, '1') THEN 0 WHEN starts_with(o_orderpriority, '3') THEN 1 ELSE 2 END AS p, o_orderkey AS seq FROM orders)) WHERE (p = 0 AND r <= 2) OR (p = 1 AND r = 1)"
