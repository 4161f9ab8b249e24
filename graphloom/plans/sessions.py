"""Queries over sources (A), enrichment (I), candidates (J), transcripts (K) and ledgers (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import enrich as E
from ..operators import ledger as L
from ..sources import interchange, logs, transcripts
from ..streaming import queue
from ..tables import folder, written
from .graph import NAMED
from .texts import gate_lines, mixed_lines, nested_lines

QUERIES, ORACLES = {}, {}
NOW = 1706659200.0  # 2024-01-31
EPOCH = "epoch(ts)::DOUBLE"


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _lines(s, d):
    """Lines of both dialects, some of them broken or blank."""
    rows = mixed_lines(s, d)
    return rows.withColumn("line", F.when(F.col("seq") % 7 == 0, F.concat("line", F.lit("}{"))).when(F.col("seq") % 11 == 0, "  ").otherwise(F.col("line")))


QUERIES["a2_read_jsonl_lenient"] = lambda s, d: transcripts.read_jsonl_lenient(_lines(s, d))[0].groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("total"))
_KEPT = "SELECT (conv_id // 20)::BIGINT AS session_id, conv_id * 1000 + turn AS seq, * FROM conversations"
ORACLES["a2_read_jsonl_lenient"] = f"SELECT session_id, count(*) AS n, sum(seq)::BIGINT AS total FROM ({_KEPT}) WHERE seq % 7 <> 0 AND seq % 11 <> 0 GROUP BY session_id"
QUERIES["a2_rejected_lines"] = lambda s, d: transcripts.read_jsonl_lenient(_lines(s, d))[1].groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
ORACLES["a2_rejected_lines"] = f"SELECT session_id, count(*) AS n FROM ({_KEPT}) WHERE seq % 7 = 0 GROUP BY session_id"
QUERIES["a3_canonical_events"] = lambda s, d: transcripts.canonical_events(mixed_lines(s, d)).select("session_id", "seq", "role", "agent", "text", F.array_join("tools", ",").alias("tools"))
ORACLES["a3_canonical_events"] = f"""SELECT session_id, seq, CASE WHEN used THEN 'assistant' ELSE role END AS role, CASE WHEN conv_id % 2 = 0 THEN 'claude' ELSE 'cursor' END AS agent,
 CASE WHEN used THEN '' ELSE concat(['shipped', 'fixed', 'looked at', 'decided'][conv_id % 4 + 1], ' ', text) END AS text, CASE WHEN used THEN CASE WHEN conv_id % 3 = 0 THEN 'Edit' ELSE 'Read' END ELSE '' END AS tools FROM (SELECT *, turn % 3 = 2 AND role <> 'user' AS used FROM ({_KEPT}))"""


def a1(s, d):
    """Session files written from the talk, one folder a dialect; an empty file and another kind of file lie beside them."""
    folder = written(s.range(1), "talk").inputFiles()[0].rsplit("/", 1)[0] + "-files"
    rows = gate_lines(s, d, 0).select(F.lit("first").alias("kind"), "line").unionByName(gate_lines(s, d, 1).select(F.lit("second").alias("kind"), "line"))
    rows.write.partitionBy("kind").option("lineSep", "\n").format("text").save(f"{folder}/parts")
    fs = s._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(s._jsc.hadoopConfiguration())
    for status in fs.globStatus(s._jvm.org.apache.hadoop.fs.Path(f"{folder}/parts/kind=*/part-*.txt")):
        at = status.getPath().toString()
        fs.rename(status.getPath(), s._jvm.org.apache.hadoop.fs.Path(at.removesuffix(".txt") + ".jsonl"))
    fs.create(s._jvm.org.apache.hadoop.fs.Path(f"{folder}/empty.jsonl")).close()
    out = fs.create(s._jvm.org.apache.hadoop.fs.Path(f"{folder}/notes.md"))
    out.write(120)
    out.close()
    found = transcripts.scan_sessions(s, folder)
    lines = transcripts.read_lines(s, folder).join(found.select(F.col("path").alias("file")), "file", "left_semi")
    sized = found.agg(F.every(F.col("size") > 0).alias("sized"))
    late = transcripts.scan_sessions(s, folder, "2100-01-01T00:00:00").count() + transcripts.scan_sessions(s, folder + "-none").count()
    return lines.agg(F.count(F.lit(1)).alias("lines")).crossJoin(sized).withColumn("late_or_missing", F.lit(late).cast("long"))


QUERIES["a1_scan_sessions"] = a1
ORACLES["a1_scan_sessions"] = "SELECT 2 * count(*) AS lines, true AS sized, 0::BIGINT AS late_or_missing FROM conversations"


def _log_lines(s, d):
    """A work log for each user: a day header where the day changes, a time header and a line for each event."""
    e = _t(s, d, "events").select("event_id", F.col("user_id").cast("string").alias("file"), "ts", "event_type", "props")
    from pyspark.sql.window import Window

    first = F.row_number().over(Window.partitionBy("file", F.to_date("ts")).orderBy("ts", "event_id")) == 1
    n = F.row_number().over(Window.partitionBy("file").orderBy("ts", "event_id"))
    e = e.withColumns({"first": first, "n": n})
    parts = F.array(F.when(F.col("first"), F.concat(F.lit("## "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" | day"))), F.concat(F.lit("### "), F.date_format("ts", "HH:mm"), F.lit(" | "), "event_type"), F.concat("event_type", F.lit(" "), "props"), F.lit(""))
    return e.select("file", (F.col("n") * 4).alias("base"), F.posexplode(parts).alias("k", "line")).where("line IS NOT NULL").select("file", (F.col("base") + F.col("k")).alias("pos"), "line")


QUERIES["a4_parse_worklog"] = lambda s, d: logs.parse_worklog(_log_lines(s, d)).select("file", F.date_format("date", "yyyy-MM-dd").alias("date"), "project", "content")
ORACLES["a4_parse_worklog"] = "SELECT user_id::VARCHAR AS file, strftime(ts, '%Y-%m-%d') AS date, event_type AS project, concat(event_type, ' ', props, chr(10)) AS content FROM events"


def _blocks(s, d):
    """A work log for each document, each line of its text a block."""
    return logs.worklog_blocks(_t(s, d, "documents").select(F.col("doc_id").alias("file"), F.concat(F.lit("# Work Log\n\nHead\n---\n"), F.regexp_replace("text", "\n", "\n---\n")).alias("text")))


_BLOCKS = """SELECT file, block_no, block FROM (SELECT doc_id AS file, unnest(range(1, len(ls) + 1))::INTEGER AS block_no, trim(regexp_replace(unnest(ls), '^\\s+|\\s+$', '', 'g'), ' ') AS block
 FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE block <> '' AND NOT starts_with(block, '# Work Log')"""
QUERIES["a5_last_blocks"] = lambda s, d: logs.last_blocks(_blocks(s, d), 3)
ORACLES["a5_last_blocks"] = f"SELECT file, block_no, block FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY block_no DESC) AS r FROM ({_BLOCKS})) WHERE r <= 3"
QUERIES["a5_blocks_with"] = lambda s, d: logs.blocks_with(_blocks(s, d), _t(s, d, "benchmark").select(F.explode(F.split("text", " ")).alias("term")).where("term <> ''").distinct(), 5)
ORACLES["a5_blocks_with"] = f"SELECT term, file, block_no FROM (SELECT term, file, block_no, row_number() OVER (PARTITION BY term, file ORDER BY block_no DESC) AS r FROM ({_BLOCKS}) JOIN (SELECT DISTINCT unnest(string_split(text, ' ')) AS term FROM benchmark) ON term <> '' AND contains(lower(block), lower(term))) WHERE r <= 5"
QUERIES["a6_parse_audit_log"] = lambda s, d: logs.parse_audit_log(_t(s, d, "events").select(F.col("event_id").alias("pos"), F.concat_ws(" | ", F.date_format("ts", "yyyy-MM-dd"), "event_type", "props").alias("line")))
ORACLES["a6_parse_audit_log"] = "SELECT date, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS files FROM (SELECT strftime(ts, '%Y-%m-%d') AS date, event_type FROM events ORDER BY event_id DESC LIMIT 40) GROUP BY date ORDER BY date DESC LIMIT 7"
QUERIES["a7_parse_drain_log"] = lambda s, d: logs.parse_drain_log(_t(s, d, "events").select(F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("] "), "event_type", F.lit(" user="), "user_id", F.lit(" value="), F.col("event_id"), F.lit(" done")).alias("line"))).groupBy(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "verb", F.col("attrs")["user"].alias("user"), F.col("attrs")["value"].alias("value")).count()
ORACLES["a7_parse_drain_log"] = "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type AS verb, user_id::VARCHAR AS \"user\", event_id::VARCHAR AS value, 1::BIGINT AS count FROM events"


def a8(s, d):
    out = interchange.graph_export(X.graph(s, d))
    return out["entities"].select(F.lit("entity").alias("part"), F.col("name").alias("a"), F.col("type").alias("b"), F.col("description").alias("c")).unionByName(out["relationships"].select(F.lit("edge").alias("part"), F.col("source").alias("a"), F.col("relation").alias("b"), F.col("target").alias("c"))).unionByName(out["properties"].select(F.lit("fact").alias("part"), F.col("entity").alias("a"), F.col("key").alias("b"), F.col("value").alias("c")))


QUERIES["a8_graph_export"] = a8
_EXPORT = "SELECT 'entity' AS part, name AS a, type AS b, description AS c FROM entities UNION ALL SELECT 'edge', source, relation, target FROM named UNION ALL SELECT 'fact', name, key, value FROM properties JOIN entities ON id = entity_id"
ORACLES["a8_graph_export"] = X.oracle(_EXPORT, "entities", "relationships", "properties", extra={"named": NAMED})


def a9(s, d):
    g = X.graph(s, d)
    tables = {k: written(v, "export") for k, v in interchange.graph_export(g).items()}
    none = g.with_(entities=g.entities.limit(0), relationships=g.relationships.limit(0), properties=g.properties.limit(0))
    back = interchange.graph_import(none, tables, X.AS_OF)
    e = back.entities.select(F.lit("entity").alias("part"), F.col("name").alias("a"), F.col("type").alias("b"), F.col("description").alias("c"))
    r = back.named_edges().select(F.lit("edge").alias("part"), F.col("source").alias("a"), F.col("relation").alias("b"), F.col("target").alias("c"))
    return e.unionByName(r)


QUERIES["a9_graph_import"] = a9
ORACLES["a9_graph_import"] = X.oracle("SELECT 'entity' AS part, name AS a, type AS b, description AS c FROM entities UNION ALL SELECT 'edge', source, relation, target FROM named", "entities", "relationships", extra={"named": NAMED})


def _payloads(s, d):
    e = F.to_json(F.struct(F.array(F.struct(F.concat("source", F.lit("-"), "lang").alias("name"), F.lit("topic").alias("type"), F.lit("d").alias("description"))).alias("entities"), F.array(F.struct(F.col("source"), F.lit("in").alias("relation"), F.col("lang").alias("target"))).alias("relationships")))
    docs = _t(s, d, "documents").select("doc_id", "lang", e.alias("e"))
    result = F.when(F.col("lang") == "en", F.to_json(F.struct(F.lit("result").alias("type"), F.col("e").alias("result")))).when(F.col("lang") == "fr", F.to_json(F.struct(F.lit("result").alias("type"), F.concat(F.lit("Here it is: "), "e", F.lit(" Done.")).alias("result")))).when(F.col("lang") == "de", F.col("e")).otherwise("nothing {")
    return docs.select("doc_id", F.posexplode(F.array(F.lit('{"type": "start"}'), F.lit("noise"), result)).alias("line_no", "line"))


QUERIES["a10_parse_payloads"] = lambda s, d: transcripts.parse_candidate_payloads(_payloads(s, d))[0].select("doc_id", "name", "type", "description").unionByName(transcripts.parse_candidate_payloads(_payloads(s, d))[1].select("doc_id", F.col("source").alias("name"), F.col("relation").alias("type"), F.col("target").alias("description")))
ORACLES["a10_parse_payloads"] = "SELECT doc_id, concat(source, '-', lang) AS name, 'topic' AS type, 'd' AS description FROM documents WHERE lang IN ('en', 'fr', 'de') UNION ALL SELECT doc_id, source, 'in', lang FROM documents WHERE lang IN ('en', 'fr', 'de')"


def _sessions(s, d):
    """One session a document: its whole text, then paths, installs, errors and research headers.

    The headers come last, so the end of the longest session has them too.
    """
    return _t(s, d, "documents").select(F.col("doc_id").alias("session_id"), (F.col("doc_id") % 5).alias("user_turns"), F.concat(F.coalesce("text", F.lit("")), F.lit("\ncd /workspaces/coding/"), "source", F.lit("/x and /workspaces/coding/dist/y; git checkout -b "), "lang", F.lit("/b1\nnpm install --save-dev pkg-"), "lang", F.lit("\nError: the thing number "), F.col("doc_id"), F.lit(" has gone wrong\nerror: file not found at all anywhere\n## Investigation: Topic "), "lang", F.lit("\n**Framework:** Deep\n## Research: Depth "), "source", F.lit("\n**Depth:** Quick Look | x\n")).alias("text"))


QUERIES["i1_extract_projects"] = lambda s, d: E.extract_projects(_sessions(s, d))
_SESSION = """SELECT doc_id AS session_id, doc_id % 5 AS user_turns, concat(coalesce(text, ''), chr(10), 'cd /workspaces/coding/', source, '/x and /workspaces/coding/dist/y; git checkout -b ', lang, '/b1', chr(10), 'npm install --save-dev pkg-', lang, chr(10), 'Error: the thing number ', doc_id, ' has gone wrong', chr(10),
 'error: file not found at all anywhere', chr(10), '## Investigation: Topic ', lang, chr(10), '**Framework:** Deep', chr(10), '## Research: Depth ', source, chr(10), '**Depth:** Quick Look | x', chr(10)) AS text FROM documents"""
_FOUND = lambda p, c: f"SELECT DISTINCT session_id, unnest(regexp_extract_all(text, '{p}', 1)) AS {c} FROM ({_SESSION})"
_PROJECTS = f"SELECT session_id, project FROM ({_FOUND('(?:' + '|'.join(E.ROOTS) + ')/([a-zA-Z0-9_-]+)', 'project')}) WHERE project NOT IN ('node_modules', '.git', 'dist', 'build', '__pycache__', '.next')"
ORACLES["i1_extract_projects"] = _PROJECTS
QUERIES["i2_extract_git_branches"] = lambda s, d: E.extract_git_branches(_sessions(s, d))
ORACLES["i2_extract_git_branches"] = _FOUND(r"git (?:checkout|switch|branch)\s+(?:-[bB]\s+)?([a-zA-Z0-9/_.-]+)", "branch") + " UNION " + _FOUND(r"On branch ([a-zA-Z0-9/_.-]+)", "branch")
QUERIES["i3_extract_packages"] = lambda s, d: E.extract_packages(_sessions(s, d))
_PACKAGES = f"SELECT session_id, package FROM ({_FOUND(E.INSTALL, 'package')}) WHERE NOT starts_with(package, '-')"
ORACLES["i3_extract_packages"] = _PACKAGES
QUERIES["i4_extract_errors"] = lambda s, d: E.extract_errors(_sessions(s, d))
ORACLES["i4_extract_errors"] = f"""SELECT session_id, unnest(range(0, len(es)))::INTEGER AS pos, unnest(es) AS error FROM (SELECT session_id, list_filter(list_transform(regexp_extract_all(text, '(?:Error|ERROR|error):\\s*(.{{20,100}})', 1), lambda x: trim(x, ' ')), lambda e: e <> '' AND NOT regexp_matches(lower(e), 'enoent|no such file|not found'))[1:3] AS es FROM ({_SESSION}))"""
QUERIES["i5_extract_research"] = lambda s, d: E.extract_research(_sessions(s, d), X.AS_OF)
_TOPICS = lambda p, c: f"SELECT session_id, trim(topic, ' ') AS topic, min(lower(trim(what, ' '))) AS {c} FROM (SELECT session_id, unnest(regexp_extract_all(text, '{p}', 1)) AS topic, unnest(regexp_extract_all(text, '{p}', 2)) AS what FROM s) GROUP BY session_id, trim(topic, ' ')"
_RESEARCH = {
    "inv": _TOPICS(r"## Investigation: (.+?)\n\*\*Framework:\*\* (\w+)", "framework"),
    "res": _TOPICS(r"## Research: (.+?)\n\*\*Depth:\*\* ([^|*\n]+?)(?:\s*\||\s*\n)", "depth"),
    "research": """SELECT *, concat('research-2024-01-31-', regexp_replace(trim(substr(regexp_replace(lower(trim(topic, ' ')), '[^a-z0-9-]', '-', 'g'), 1, 50), '-'), '-+', '-', 'g')) AS slug
 FROM (SELECT session_id, topic, framework, NULL::VARCHAR AS depth FROM inv UNION ALL SELECT session_id, topic, 'unknown', depth FROM res ANTI JOIN inv USING (session_id, topic))""",
}
ORACLES["i5_extract_research"] = X.oracle("SELECT session_id, topic, framework, depth, slug FROM research", extra={"s": _SESSION, **_RESEARCH})


def i6(s, d):
    g = X.graph(s, d)
    user = g.entities.limit(1).select(F.lit(1).cast("long").alias("id"), F.lit("user").alias("name"), F.lit("user").alias("type"), F.lit(None).cast("string").alias("description"), "created", "updated", "last_referenced")
    g = E.session_to_graph(g.with_(entities=g.entities.unionByName(user)), _sessions(s, d), X.AS_OF, _t(s, d, "labels").select(F.col("doc_id").alias("session_id")))
    names = g.entities.select("id", "name", "type")
    edges = g.named_edges().where("relation IN ('uses-package', 'works-on', 'researched')").select(F.col("source").alias("a"), F.col("relation").alias("b"), F.col("target").alias("c"))
    facts = g.properties.where(f"key IN ('framework', 'depth', 'source-agent', 'date', 'last-worked') AND updated = DATE '{X.AS_OF}'").join(names, F.col("entity_id") == F.col("id")).select(F.col("name").alias("a"), F.col("key").alias("b"), F.col("value").alias("c"))
    return edges.unionByName(facts)


QUERIES["i6_session_to_graph"] = i6
ORACLES["i6_session_to_graph"] = X.oracle(
    """SELECT DISTINCT 'user' AS a, 'works-on' AS b, project AS c FROM p UNION ALL SELECT DISTINCT 'user', 'researched', slug FROM research UNION ALL SELECT DISTINCT last, 'uses-package', package FROM k JOIN (SELECT session_id, max(project) AS last FROM p GROUP BY session_id) USING (session_id)
 UNION ALL SELECT DISTINCT project, 'last-worked', '2024-01-31' FROM p UNION ALL SELECT DISTINCT slug, 'framework', framework FROM research UNION ALL SELECT DISTINCT slug, 'depth', depth FROM research WHERE depth IS NOT NULL UNION ALL SELECT DISTINCT slug, 'date', '2024-01-31' FROM research
 UNION ALL SELECT n, 'source-agent', 'claude' FROM (SELECT slug AS n FROM research UNION SELECT project FROM p UNION SELECT package FROM k)""",
    extra={"s": f"SELECT session_id, right(text, 50000) AS text FROM ({_SESSION}) WHERE user_turns >= 3 AND session_id NOT IN (SELECT doc_id FROM labels)", "p": _PROJECTS.replace(f"({_SESSION})", "s"), "k": _PACKAGES.replace(f"({_SESSION})", "s"), **_RESEARCH},
)
QUERIES["i7_mirror_drift"] = lambda s, d: E.mirror_drift(X.graph(s, d), _t(s, d, "documents"))
ORACLES["i7_mirror_drift"] = X.oracle("SELECT e AS entities, n AS notes, abs(e - n) AS difference, abs(e - n) > 5 OR abs(e - n) > e * 0.03 AS stale FROM (SELECT (SELECT count(*) FROM entities) AS e, (SELECT count(*) FROM documents) AS n)", "entities")

QUERIES["j1_corpus_budget"] = lambda s, d: E.corpus_budget(_t(s, d, "documents").select(F.col("source").alias("file"), "text"))
ORACLES["j1_corpus_budget"] = "SELECT count(*) AS files, sum(t)::BIGINT AS tokens, round(sum(t) / 1e6 * 0.8 + sum(t) * 0.1 / 1e6 * 3.0, 6)::DOUBLE AS usd FROM (SELECT source, sum(length(text) // 4) AS t FROM documents GROUP BY source)"


def _files(s, d):
    return _t(s, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


QUERIES["j2_prepare_chunks"] = lambda s, d: E.prepare_chunks(_files(s, d), 100)
ORACLES["j2_prepare_chunks"] = "SELECT doc_id::VARCHAR AS file, i::INTEGER AS chunk_no, substr(text, i * 400 + 1, 400) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil(length(text) / 400.0)::BIGINT))) AS i FROM documents)"
QUERIES["j3_extract_candidates"] = lambda s, d: E.extract_candidates(_sessions(s, d).select(F.col("session_id").cast("string").alias("file"), F.lit(0).alias("chunk_no"), F.col("text").alias("chunk"))).select("kind", "source_file", "name", "type")
ORACLES["j3_extract_candidates"] = f"SELECT 'entity' AS kind, session_id::VARCHAR AS source_file, project AS name, 'project' AS type FROM ({_PROJECTS}) UNION ALL SELECT 'entity', session_id::VARCHAR, package, 'package' FROM ({_PACKAGES})"


def _mixed(s, d):
    name = F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source"))
    return _t(s, d, "documents").select(F.col("doc_id").alias("seq"), F.element_at(F.array(F.lit("entity"), F.lit("relationship"), F.lit("note")), (F.col("doc_id") % 3 + 1).cast("int")).alias("kind"), name.alias("name"), F.when(F.col("doc_id") % 4 == 1, F.col("lang")).otherwise("").alias("type"), F.when(F.length("text") > 900, F.col("text")).alias("description"), F.create_map(F.concat(F.lit("k"), F.col("doc_id") % 3), F.col("doc_id").cast("string")).alias("props"), F.col("source"), F.lit("in").alias("relation"), F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("target"))


QUERIES["j4_regroup_candidates"] = lambda s, d: E.regroup_candidates(_mixed(s, d))[0].select("seq", "name").unionByName(E.regroup_candidates(_mixed(s, d))[1].select("seq", F.col("source").alias("name")))
ORACLES["j4_regroup_candidates"] = "SELECT doc_id AS seq, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN upper(source) ELSE source END AS name FROM documents WHERE doc_id % 3 < 2"
QUERIES["j5_dedupe_entities"] = lambda s, d: E.dedupe_entities(_mixed(s, d).select("seq", "name", "type", "description", "props")).select("name", "type", "description", F.array_join(F.transform(F.map_entries("props"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("props"))
ORACLES["j5_dedupe_entities"] = """WITH m AS (SELECT doc_id AS seq, lower(source) AS k, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS name, CASE WHEN doc_id % 4 = 1 THEN lang END AS type, CASE WHEN length(text) > 900 THEN text END AS description, concat('k', doc_id % 3) AS pk FROM documents)
SELECT arg_min(name, seq) AS name, arg_min(type, seq) FILTER (type IS NOT NULL) AS type, arg_min(description, seq) FILTER (description <> '') AS description, any_value(p) AS props FROM m JOIN (SELECT k, string_agg(concat(pk, '=', v), ',' ORDER BY pk) AS p FROM (SELECT k, pk, max(seq) AS v FROM m GROUP BY k, pk) GROUP BY k) USING (k) GROUP BY k"""
QUERIES["j6_dedupe_relationships"] = lambda s, d: E.dedupe_relationships(_mixed(s, d).select("seq", "source", "relation", "target"))
ORACLES["j6_dedupe_relationships"] = "SELECT source, 'in' AS relation, lang AS target, min(doc_id) AS seq FROM documents WHERE doc_id % 5 > 0 GROUP BY source, lang"
QUERIES["j7_resume_pending"] = lambda s, d: E.resume_pending(_t(s, d, "documents").select(F.col("doc_id").alias("file")), _t(s, d, "labels").select(F.col("doc_id").alias("file")))[1]
ORACLES["j7_resume_pending"] = "SELECT count(l.doc_id) AS done, count(*) AS total, round(count(l.doc_id) / count(*), 6)::DOUBLE AS fraction FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id"


def j7_kept(s, d):
    """Candidates of a run that stopped half-way: those of labelled documents are kept, others come with their own run."""
    some = _t(s, d, "documents").select(F.col("doc_id").alias("file"), "source", "lang")
    return E.resume_pending(some.select("file"), _t(s, d, "labels").select(F.col("doc_id").alias("file")), some)[2]


QUERIES["j7_kept_candidates"] = j7_kept
ORACLES["j7_kept_candidates"] = "SELECT doc_id AS file, source, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"


def k1(s, d):
    """Every block of every event."""
    rows = E.compact_events(nested_lines(s, d)).select("session_id", "seq", "type", "cwd", "gitBranch", "role", F.posexplode("blocks").alias("pos", "b"))
    get = lambda c, path: F.get_json_object(F.col(c), path)
    return rows.select(
        "session_id", "seq", F.col("type").alias("event"), "cwd", F.col("gitBranch").alias("branch"), "role", "pos", F.col("b.type").alias("kind"), F.col("b.text").alias("text"), F.col("b.name").alias("name"),
        get("b.input", "$.command").alias("command"), get("b.input", "$.n").cast("long").alias("n"), get("b.input", "$.more.deep").alias("deep"), F.col("b.is_error").alias("is_error"),
        F.when(F.col("b.result").startswith("["), get("b.result", "$[0].text")).otherwise(F.from_json(F.concat(F.lit("["), "b.result", F.lit("]")), "array<string>")[0]).alias("result"), F.length(get("b.result", "$[1]")).alias("more_results"),
    )


def _capped(limit: int) -> str:
    return f"CASE WHEN length(text) > {limit} THEN concat(text[1:{limit}], '...[+', length(text) - {limit}, ']') ELSE text END"


QUERIES["k1_compact_events"] = k1
ORACLES["k1_compact_events"] = f"""SELECT session_id, seq, 'user' AS event, concat('/work/', conv_id % 7) AS cwd, 'main' AS branch, role, 0 AS pos, ['text', 'tool_use', 'tool_result', 'tool_result'][k + 1] AS kind, CASE WHEN k = 0 THEN text END AS text, CASE WHEN k = 1 THEN 'Bash' END AS name,
 CASE WHEN k = 1 THEN {_capped(800)} END AS command, CASE WHEN k = 1 THEN turn END AS n, CASE WHEN k = 1 THEN text END AS deep, CASE WHEN k = 2 AND turn % 8 = 2 THEN true END AS is_error, CASE WHEN k >= 2 THEN {_capped(600)} END AS result, NULL::INTEGER AS more_results
 FROM (SELECT *, turn % 4 AS k FROM ({_KEPT})) WHERE seq % 5 <> 0"""


def _cut(s, d):
    e = _t(s, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "signup", F.col("ts")).alias("ts"))
    c = _t(s, d, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("session_id")).agg(F.min("ts").alias("cutoff"))
    return e, c


QUERIES["k2_slice_since"] = lambda s, d: E.slice_since(*_cut(s, d)).select("session_id", "seq", "part")
ORACLES["k2_slice_since"] = """WITH c AS (SELECT user_id, date_trunc('second', min(ts)) AS cut FROM events WHERE event_type = 'purchase' GROUP BY user_id), e AS (SELECT user_id AS session_id, event_id AS seq, cut IS NULL OR event_type = 'signup' OR ts >= cut AS new FROM events LEFT JOIN c USING (user_id))
SELECT session_id, seq, 'new' AS part FROM e WHERE new UNION ALL SELECT session_id, seq, 'context' FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM e WHERE NOT new) WHERE r <= 10"""


def _led(s, d, kind):
    return _t(s, d, "events").where(F.col("event_type") == kind).select(F.col("user_id").alias("session_id"), F.unix_timestamp("ts").alias("processed_mtime"))


QUERIES["k3_session_cutoff"] = lambda s, d: E.session_cutoff(_t(s, d, "events").select(F.col("user_id").alias("session_id")), _led(s, d, "purchase"), _led(s, d, "signup"))
ORACLES["k3_session_cutoff"] = "SELECT user_id AS session_id, max(epoch(date_trunc('second', ts))::BIGINT) FILTER (event_type IN ('purchase', 'signup')) AS cutoff, CASE WHEN count(*) FILTER (event_type IN ('purchase', 'signup')) = 0 THEN 'fresh' ELSE 'continuation' END AS mode FROM events GROUP BY user_id"


def _queue(s, d):
    return _t(s, d, "events").where("event_type IN ('signup', 'click')").select(F.col("user_id").alias("session_id"), F.concat(F.lit("/t/"), F.col("user_id"), F.lit(".jsonl")).alias("transcript_path"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))


QUERIES["l1_enqueue"] = lambda s, d: L.enqueue(_queue(s, d).where("session_id % 2 = 0"), _queue(s, d)).select("session_id", "transcript_path", F.round("ts", 3).alias("ts"))
_Q = "SELECT user_id AS session_id, concat('/t/', user_id, '.jsonl') AS transcript_path, epoch(ts)::DOUBLE AS ts FROM events WHERE event_type IN ('signup', 'click')"
ORACLES["l1_enqueue"] = f"SELECT session_id, any_value(transcript_path) AS transcript_path, round(max(ts), 3) AS ts FROM ({_Q}) GROUP BY session_id"
QUERIES["l1_find_transcripts"] = lambda s, d: L.find_transcripts(_queue(s, d).select(F.col("session_id").cast("string").alias("session_id")).distinct(), _queue(s, d).select(F.concat(F.lit("/home/a"), "transcript_path").alias("path")))
ORACLES["l1_find_transcripts"] = f"SELECT DISTINCT session_id::VARCHAR AS session_id, concat('/home/a', transcript_path) AS path FROM ({_Q})"
QUERIES["l2_prune_queue"] = lambda s, d: L.prune_queue(_queue(s, d), NOW, 7 * 86400).groupBy("session_id").count()
ORACLES["l2_prune_queue"] = f"SELECT session_id, count(*) AS count FROM ({_Q}) WHERE ts >= {NOW} - 604800 GROUP BY session_id"


def l3(s, d):
    q = L.enqueue(_queue(s, d).limit(0), _queue(s, d))
    files = _t(s, d, "events").where("event_type = 'view'").groupBy(F.concat(F.lit("/t/"), F.col("user_id"), F.lit(".jsonl")).alias("transcript_path")).agg(F.max(F.unix_timestamp("ts").cast("double")).alias("mtime"))
    return L.queue_state(q, files, _led(s, d, "purchase"), NOW - 86400 * 2).select("session_id", "state", F.round("idle", 3).alias("idle"))


QUERIES["l3_queue_state"] = l3
ORACLES["l3_queue_state"] = f"""WITH q AS (SELECT session_id, max(ts) AS ts FROM ({_Q}) GROUP BY 1), f AS (SELECT user_id AS session_id, max(epoch(date_trunc('second', ts)))::DOUBLE AS m FROM events WHERE event_type = 'view' GROUP BY 1), p AS (SELECT user_id AS session_id, max(epoch(date_trunc('second', ts)))::DOUBLE AS p FROM events WHERE event_type = 'purchase' GROUP BY 1),
s AS (SELECT q.session_id, coalesce(m, 0) AS m, p, CASE WHEN {NOW - 172800} - ts > 172800 THEN 'stale' WHEN coalesce(m, 0) = 0 THEN 'missing' WHEN {NOW - 172800} - m >= 600 THEN 'ready' ELSE 'waiting' END AS st FROM q LEFT JOIN f USING (session_id) LEFT JOIN p USING (session_id))
SELECT session_id, CASE WHEN p IS NULL THEN st WHEN m > p THEN concat(st, '*') ELSE 'done' END AS state, round(CASE WHEN m > 0 THEN {NOW - 172800} - m ELSE -1 END, 3)::DOUBLE AS idle FROM s"""
QUERIES["l4_drain_plan"] = lambda s, d: L.drain_plan(L.enqueue(_queue(s, d).limit(0), _queue(s, d)))[0].select("session_id", "place")
ORACLES["l4_drain_plan"] = f"SELECT session_id, row_number() OVER (ORDER BY ts, session_id)::INTEGER AS place FROM (SELECT session_id, max(ts) AS ts FROM ({_Q}) GROUP BY 1) ORDER BY ts, session_id LIMIT 25"
QUERIES["l5_retry_ledger"] = lambda s, d: L.retry_ledger(_t(s, d, "events").where("event_type IN ('purchase', 'error')").select(F.col("user_id").alias("session_id"), "ts", (F.col("event_type") == "purchase").alias("ok")))
ORACLES["l5_retry_ledger"] = "SELECT session_id, failures, CASE WHEN failures = 0 THEN 'processed' WHEN failures >= 3 THEN 'dead' ELSE 'retry' END AS state FROM (SELECT user_id AS session_id, count(*) FILTER (event_type = 'error' AND (ok IS NULL OR ts > ok)) AS failures FROM (SELECT *, max(ts) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS ok FROM events WHERE event_type IN ('purchase', 'error')) GROUP BY user_id)"
_DRAIN = lambda s, d: _t(s, d, "events").select(F.unix_timestamp("ts").cast("double").alias("ts"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("event"))
QUERIES["l6_pipeline_health"] = lambda s, d: L.pipeline_health(_DRAIN(s, d), _queue(s, d), _led(s, d, "purchase"), NOW)
ORACLES["l6_pipeline_health"] = f"""SELECT round(({NOW} - max(t)) / 3600, 6)::DOUBLE AS hours, count(*) FILTER (event_type IN ('signup', 'click')) AS queued, count(*) FILTER (event_type = 'purchase') AS processed, count(*) FILTER (event_type = 'error' AND t >= {NOW} - 604800) AS bad, ({NOW} - max(t)) / 3600 > 24 AS stale, count(*) FILTER (event_type = 'error' AND t >= {NOW} - 604800) >= 10 AS failing FROM (SELECT event_type, epoch(date_trunc('second', ts)) AS t FROM events)"""
QUERIES["l7_last_drain"] = lambda s, d: L.last_drain(_DRAIN(s, d), _DRAIN(s, d).where("ts < 1705000000"))
ORACLES["l7_last_drain"] = "SELECT max(epoch(date_trunc('second', ts)))::DOUBLE AS last_drain FROM events WHERE event_type <> 'error'"


def l8(s, d):
    bodies = _t(s, d, "events").select(F.col("event_id").alias("session_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "HH:mm").alias("time"), F.col("event_type").alias("project"), F.when(F.col("event_type") == "view", " skip ").when(F.col("event_type") == "click", "").otherwise(F.col("props")).alias("body"), F.when(F.col("user_id") % 2 == 0, "continuation").otherwise("fresh").alias("mode"))
    days = _t(s, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return L.append_worklog(bodies, days)[0].select("session_id", "header", "body")


QUERIES["l8_append_worklog"] = l8
ORACLES["l8_append_worklog"] = """WITH b AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M') AS t, event_type, props, user_id % 2 = 0 AS cont FROM events WHERE event_type NOT IN ('view', 'click')),
r AS (SELECT *, day IN (SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders) OR row_number() OVER (PARTITION BY day ORDER BY t, event_id) > 1 AS below, concat('### ', t, ' | ', event_type, CASE WHEN cont THEN ' (continued)' ELSE '' END) AS h FROM b)
SELECT event_id AS session_id, CASE WHEN below THEN h WHEN cont THEN concat('## ', day, chr(10), chr(10), h) ELSE concat('## ', day, ' | ', event_type, ' | ', t) END AS header, props AS body FROM r"""


def l3_live(s, d):
    """The events as a log of the queue, replayed as a stream; what it comes to at the last event."""
    root = folder(s, "queue")
    kind = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "failed").otherwise("file")
    log = _t(s, d, "events").select(F.col("user_id").cast("long").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))
    end = log.agg(F.max("ts").alias("t"))
    clock = end.select(F.lit(-1).cast("long").alias("session_id"), F.expr("t + INTERVAL 2 HOURS").alias("ts"), F.lit("clock").alias("kind"))
    for part in (log, clock):
        part.write.mode("append").parquet(f"{root}/log")
        queue.queue_stream(s.readStream.schema(log.schema).parquet(f"{root}/log"), f"{root}/out", f"{root}/state").awaitTermination()
    changes = s.read.schema(queue.CHANGE).parquet(f"{root}/out")
    return queue.states(changes, str(end.select(F.col("t").cast("string")).first()[0])).select("session_id", "state", "ledger", "failures")


QUERIES["l3_live_queue"] = l3_live
ORACLES["l3_live_queue"] = """WITH e AS (SELECT user_id AS session_id, epoch_ms(ts) AS t, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'failed' ELSE 'file' END AS kind FROM events),
 s AS (SELECT session_id, max(t) FILTER (kind = 'enqueue') AS q, max(t) FILTER (kind = 'file') AS m, max(t) FILTER (kind = 'ok') AS p, count(*) FILTER (kind IN ('ok', 'failed')) AS tries FROM e GROUP BY session_id),
 f AS (SELECT session_id, count(*) FILTER (kind = 'failed' AND (p IS NULL OR t > p))::INTEGER AS failures FROM e JOIN s USING (session_id) GROUP BY session_id),
 own AS (SELECT *, CASE WHEN now - q > 172800000 THEN 'stale' WHEN m IS NULL THEN 'missing' WHEN now - m >= 600000 THEN 'ready' ELSE 'waiting' END AS o FROM s, (SELECT max(t) AS now FROM e))
SELECT session_id, CASE WHEN q IS NOT NULL THEN CASE WHEN p IS NULL THEN o WHEN coalesce(m, 0) > p THEN concat(o, '*') ELSE 'done' END END AS state, CASE WHEN tries > 0 THEN CASE WHEN failures = 0 THEN 'processed' WHEN failures >= 3 THEN 'dead' ELSE 'retry' END END AS ledger, failures
FROM own JOIN f USING (session_id) WHERE q IS NOT NULL OR tries > 0"""
