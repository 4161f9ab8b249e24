"""I, J, K: from sessions and transcripts to candidates and graph changes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import cap_with_marker, cost_estimate, normalize_name, research_slug, token_estimate
from ..model import Graph
from .mutate import upsert_entities, upsert_properties, upsert_relationships

# Folders that aren't projects, noise among errors, and event types without content.
NOT_PROJECTS = ("node_modules", ".git", "dist", "build", "__pycache__", ".next")
ERROR_NOISE = ("enoent", "no such file", "not found")
DROPPED_EVENTS = ("attachment", "file-history-snapshot", "queue-operation", "last-prompt", "custom-title", "permission-mode", "agent-name", "ai-title", "system")
ROOTS = ("/workspaces/coding",)
INSTALL = r"npm (?:install|add|i)\s+(?:--save-dev\s+)?([a-zA-Z0-9@/_.-]+)"


def _all(text: str, pattern: str, group: int = 1):
    return F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), group))


def extract_projects(sessions: DataFrame, roots: tuple[str, ...] = ROOTS) -> DataFrame:
    """sessions(session_id, text) -> (session_id, project): first folder below a coding root."""
    pattern = "(?:" + "|".join(r.replace(".", r"\.") for r in roots) + ")/([a-zA-Z0-9_-]+)"
    return sessions.select("session_id", F.explode(_all("text", pattern)).alias("project")).where(~F.col("project").isin(*NOT_PROJECTS))


def extract_git_branches(sessions: DataFrame) -> DataFrame:
    """(session_id, branch)."""
    found = F.array_union(_all("text", r"git (?:checkout|switch|branch)\s+(?:-[bB]\s+)?([a-zA-Z0-9/_.-]+)"), _all("text", r"On branch ([a-zA-Z0-9/_.-]+)"))
    return sessions.select("session_id", F.explode(found).alias("branch"))


def extract_packages(sessions: DataFrame) -> DataFrame:
    """(session_id, package)."""
    found = sessions.select("session_id", F.explode(_all("text", INSTALL)).alias("package"))
    return found.where(~F.col("package").startswith("-"))


def extract_errors(sessions: DataFrame, n: int = 3) -> DataFrame:
    """I4: (session_id, pos, error): the first n messages."""
    found = F.transform(F.regexp_extract_all("text", F.lit(r"(?:Error|ERROR|error):\s*(.{20,100})"), 1), F.trim)
    fine = F.filter(found, lambda e: (e != "") & ~F.lower(e).rlike("|".join(ERROR_NOISE)))
    return sessions.select("session_id", F.posexplode(F.slice(fine, 1, n)).alias("pos", "error"))


def extract_research(sessions: DataFrame, as_of: str) -> DataFrame:
    """(session_id, topic, slug, framework, depth); a topic of the first form isn't taken again from the second."""
    first, second = r"## Investigation: (.+?)\n\*\*Framework:\*\* (\w+)", r"## Research: (.+?)\n\*\*Depth:\*\* ([^|*\n]+?)(?:\s*\||\s*\n)"

    def pairs(pattern: str, alias: str) -> DataFrame:
        both = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), 1).alias("topic"), F.regexp_extract_all("text", F.lit(pattern), 2).alias("what"))
        return sessions.select("session_id", F.explode(both).alias("p")).select("session_id", F.trim("p.topic").alias("topic"), F.lower(F.trim("p.what")).alias(alias)).groupBy("session_id", "topic").agg(F.min(alias).alias(alias))

    a = pairs(first, "framework").withColumn("depth", F.lit(None).cast("string"))
    b = pairs(second, "depth").join(a.select("session_id", "topic"), ["session_id", "topic"], "left_anti").withColumn("framework", F.lit("unknown"))
    return a.unionByName(b).withColumn("slug", research_slug(F.col("topic"), F.lit(as_of)))


def session_deltas(sessions: DataFrame, as_of: str, processed: DataFrame | None = None, agent: str = "claude", roots: tuple[str, ...] = ROOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sessions(session_id, user_turns, text) -> entity, relationship and property changes.

    The last 50,000 characters count; sessions with fewer than three user turns or processed before give nothing.
    """
    s = sessions.where("user_turns >= 3")
    s = s if processed is None else s.join(processed.select("session_id").distinct(), "session_id", "left_anti")
    s = s.select("session_id", F.substring("text", -50_000, 50_000).alias("text"))
    projects, packages, research = extract_projects(s, roots), extract_packages(s), extract_research(s, as_of)
    last = projects.groupBy("session_id").agg(F.max("project").alias("project"))
    entity = lambda df, c, t: df.select(F.col(c).alias("name"), F.lit(t).alias("type"), F.lit("").alias("description"))
    entities = entity(projects, "project", "project").unionByName(entity(packages, "package", "package")).unionByName(research.select(F.col("slug").alias("name"), F.lit("research-project").alias("type"), F.col("topic").alias("description"))).distinct()
    edge = lambda df, a, r, b: df.select(a.alias("source"), F.lit(r).alias("relation"), b.alias("target"))
    user = F.lit("user")
    edges = edge(projects, user, "works-on", F.col("project")).unionByName(edge(packages.join(last, "session_id"), F.col("project"), "uses-package", F.col("package"))).unionByName(edge(research, user, "researched", F.col("slug"))).distinct()
    fact = lambda df, c, k, v: df.select(F.col(c).alias("entity"), F.lit(k).alias("key"), v.alias("value"), F.lit(as_of).cast("date").alias("updated"))
    facts = fact(projects, "project", "last-worked", F.lit(as_of))
    for key, value in (("date", F.lit(as_of)), ("framework", F.col("framework")), ("depth", F.col("depth"))):
        facts = facts.unionByName(fact(research, "slug", key, value))
    named = entities.select(F.col("name").alias("entity"))
    facts = facts.unionByName(fact(named, "entity", "source-agent", F.lit(agent)))
    return entities, edges, facts.where("value IS NOT NULL").distinct()


def session_to_graph(graph: Graph, sessions: DataFrame, as_of: str, processed: DataFrame | None = None, roots: tuple[str, ...] = ROOTS) -> Graph:
    """The deltas applied; mined edges weigh 0.7."""
    entities, edges, facts = session_deltas(sessions, as_of, processed, roots=roots)
    graph = upsert_entities(graph, entities, as_of, "fill")
    return upsert_properties(upsert_relationships(graph, edges, as_of, 0.7), facts)


def mirror_drift(graph: Graph, notes: DataFrame) -> DataFrame:
    """Entities against exported notes; stale when they differ by more than 5 or 3 %."""
    n = graph.entities.agg(F.count(F.lit(1)).alias("entities")).crossJoin(notes.agg(F.count(F.lit(1)).alias("notes")))
    off = F.abs(F.col("entities") - F.col("notes"))
    return n.select("entities", "notes", off.alias("difference"), ((off > 5) | (off > F.col("entities") * 0.03)).alias("stale"))


def corpus_budget(files: DataFrame) -> DataFrame:
    """files(file, text) -> number of files, estimated tokens and cost."""
    per = files.groupBy("file").agg(F.sum(token_estimate(F.col("text"))).alias("tokens"))
    return per.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens")).withColumn("usd", F.round(cost_estimate(F.col("tokens")), 6))


def prepare_chunks(lines: DataFrame, tokens: int = 20_000) -> DataFrame:
    """lines(file, line_no, line) -> (file, chunk_no, chunk): a file's text, cut every four characters a token.

    Lines are cut where a chunk ends and gathered by chunk, so no file is ever one row.
    """
    size, w = 4 * tokens, Window.partitionBy("file").orderBy("line_no")
    text = F.concat(F.coalesce("line", F.lit("")), F.when(F.lead("line_no").over(w).isNotNull(), "\n").otherwise(""))
    rows = lines.select("file", "line_no", text.alias("t"))
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("t")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("t <> '' OR at = 0")
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.floor(F.col("at") / size).cast("int"), F.floor((F.col("at") + F.greatest(F.length("t"), F.lit(1)) - 1) / size).cast("int"))))
    skip = F.greatest(F.col("chunk_no") * size - F.col("at"), F.lit(0))
    left = size - F.greatest(F.col("at") - F.col("chunk_no") * size, F.lit(0))
    parts = rows.select("file", "chunk_no", F.struct("at", "line_no", F.substring("t", (skip + 1).cast("int"), left.cast("int")).alias("part")).alias("p"))
    return parts.groupBy("file", "chunk_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["part"]), "").alias("chunk"))


CANDIDATE = "kind string, source_file string, chunk_no int, name string, type string, description string, props map<string,string>, source string, relation string, target string, error string"


def rule_candidates(chunks: DataFrame, roots: tuple[str, ...] = ROOTS) -> DataFrame:
    """The candidates that I1 and I3 find in chunks(file, chunk_no, chunk)."""
    rows = chunks.select(F.struct("file", "chunk_no").alias("session_id"), F.col("chunk").alias("text"))
    found = extract_projects(rows, roots).select("session_id", F.col("project").alias("name"), F.lit("project").alias("type")).unionByName(extract_packages(rows).select("session_id", F.col("package").alias("name"), F.lit("package").alias("type")))
    own = {"kind": F.lit("entity"), "source_file": F.col("session_id.file"), "chunk_no": F.col("session_id.chunk_no"), "name": F.col("name"), "type": F.col("type")}
    kinds = dict(re.findall(r"(\w+) (map<string,string>|\w+)", CANDIDATE))
    return found.select(*[own.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def extract_candidates(chunks: DataFrame, extractor: Callable[[str], Iterator[dict]] | None = None) -> DataFrame:
    """Any extractor over chunks(file, chunk_no, chunk); a chunk that fails gives a row of kind `error`.

    Without one, candidates come from the rules of I1 and I3.
    """
    if extractor is None:
        return rule_candidates(chunks)
    names = [c.split()[0] for c in CANDIDATE.split(", ")]

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    found = list(extractor(r.chunk))
                except Exception as e:  # noqa: BLE001  one chunk's failure is data, not the job's
                    found = [{"kind": "error", "error": repr(e)}]
                out += [{"source_file": r.file, "chunk_no": r.chunk_no, **f} for f in found]
            yield pd.DataFrame(out, columns=names).astype(object).where(lambda d: d.notna(), None)

    return chunks.select("file", "chunk_no", "chunk").mapInPandas(run, CANDIDATE)


def regroup_candidates(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships; other kinds are dropped."""
    return candidates.where("kind = 'entity'").select("seq", "name", "type", "description", "props"), candidates.where("kind = 'relationship'").select("seq", "source", "relation", "target")


def dedupe_entities(rows: DataFrame) -> DataFrame:
    """rows(seq, name, type, description, props) by lower name: first spelling, first scalars that aren't empty, last props."""
    rows = rows.where("name IS NOT NULL AND name <> ''").withColumn("_k", F.lower("name"))
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("seq"))).alias(c)
    scalars = rows.groupBy("_k").agg(F.min_by("name", "seq").alias("name"), first("type"), first("description"))
    props = rows.select("_k", "seq", F.explode("props").alias("key", "value")).groupBy("_k", "key").agg(F.max_by("value", "seq").alias("value")).groupBy("_k").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("props"))
    return scalars.join(props, "_k", "left").drop("_k")


def dedupe_relationships(rows: DataFrame) -> DataFrame:
    """The first of each triple; rows with a null are dropped."""
    key = ["source", "relation", "target"]
    return rows.dropna(subset=key).groupBy(*key).agg(F.min("seq").alias("seq"))


def resume_pending(files: DataFrame, processed: DataFrame, candidates: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """files(file) that aren't processed yet, how far the work is, and the candidates(file, ...) that finished files gave.

    A file that was cut short isn't in `processed`: it is pending, and what it gave before is left to its next run.
    """
    done = processed.select("file").distinct()
    progress = files.join(done.withColumn("d", F.lit(1)), "file", "left").agg(F.count("d").alias("done"), F.count(F.lit(1)).alias("total"))
    kept = None if candidates is None else candidates.join(done, "file", "left_semi")
    return files.join(done, "file", "left_anti"), progress.withColumn("fraction", F.round(F.col("done") / F.greatest(F.col("total"), F.lit(1)), 6)), kept


def compact_events(lines: DataFrame, result_cap: int = 600, input_cap: int = 800) -> DataFrame:
    """K1: lines(session_id, seq, line) -> (session_id, seq, type, timestamp, cwd, gitBranch, role, content, blocks).

    Events of noise types go, and lines that are no JSON object. A content that is one text comes as `content`. Images go;
    of a tool use each string in its input is capped by itself, and what isn't a string stays; of a tool result the
    text is capped, or each text of a list, whose images and other parts go. `input`, `result` and `other` (blocks of
    other kinds, as they were) are JSON.
    """
    kind = "try_variant_get(b, '$.type', 'string')"
    of = lambda v: f"schema_of_variant({v})"
    cap = lambda t, n: f"CASE WHEN length({t}) > {n} THEN concat(left({t}, {n}), '...[+', length({t}) - {n}, ']') ELSE {t} END"
    text = lambda v: f"CAST({v} AS STRING)"
    capped = lambda v, n: f"CASE WHEN {of(v)} = 'STRING' THEN CAST({cap(text(v), n)} AS VARIANT) ELSE {v} END"
    given, result = "try_variant_get(b, '$.input', 'variant')", "try_variant_get(b, '$.content', 'variant')"
    inside = f"CASE WHEN {of(given)} LIKE 'OBJECT%' THEN to_json(transform_values(try_variant_get(b, '$.input', 'map<string,variant>'), (k, v) -> {capped('v', input_cap)})) ELSE to_json({capped(given, input_cap)}) END"
    some = f"transform(filter(try_variant_get(b, '$.content', 'array<variant>'), c -> try_variant_get(c, '$.type', 'string') = 'text'), c -> named_struct('type', 'text', 'text', coalesce({cap("try_variant_get(c, '$.text', 'string')", result_cap)}, '')))"
    back = f"CASE WHEN {of(result)} LIKE 'ARRAY%' THEN to_json({some}) ELSE to_json({capped(result, result_cap)}) END"
    known = f"coalesce({kind} IN ('text', 'thinking', 'tool_use', 'tool_result'), false)"
    block = f"""named_struct('type', {kind},
        'text', CASE {kind} WHEN 'text' THEN coalesce(try_variant_get(b, '$.text', 'string'), '') WHEN 'thinking' THEN coalesce(try_variant_get(b, '$.thinking', 'string'), '') END,
        'name', CASE WHEN {kind} = 'tool_use' THEN try_variant_get(b, '$.name', 'string') END, 'input', CASE WHEN {kind} = 'tool_use' THEN {inside} END,
        'is_error', CASE WHEN {kind} = 'tool_result' AND try_variant_get(b, '$.is_error', 'boolean') THEN true END, 'result', CASE WHEN {kind} = 'tool_result' THEN {back} END,
        'other', CASE WHEN NOT {known} THEN to_json(b) END)"""
    top = lambda k: F.expr(f"try_variant_get(v, '$.{k}', 'string')").alias(k)
    content = "try_variant_get(v, '$.message.content', 'variant')"
    rows = lines.select("session_id", "seq", F.expr("try_parse_json(line) AS v")).where("schema_of_variant(v) LIKE 'OBJECT%'").where(~F.coalesce(top("type"), F.lit("")).isin(*DROPPED_EVENTS))
    return rows.select(
        "session_id", "seq", *map(top, ("type", "timestamp", "cwd", "gitBranch")), F.expr("try_variant_get(v, '$.message.role', 'string') AS role"),
        F.expr(f"CASE WHEN {of(content)} = 'STRING' THEN {text(content)} END AS content"),
        F.expr(f"transform(filter(try_variant_get(v, '$.message.content', 'array<variant>'), b -> NOT coalesce({kind} = 'image', false)), b -> {block}) AS blocks"),
    )


def slice_since(events: DataFrame, cutoffs: DataFrame, context: int = 10) -> DataFrame:
    """K2: events(session_id, seq, ts) at or after their session's cutoff and the last few before it, marked `part`.

    Events without time count as new; without a cutoff all do. The cutoff is floored to whole seconds.
    """
    e = events.join(cutoffs.select("session_id", F.date_trunc("second", "cutoff").alias("cutoff")), "session_id", "left")
    new = F.col("cutoff").isNull() | F.col("ts").isNull() | (F.col("ts") >= F.col("cutoff"))
    old = e.where(~new).withColumn("_r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))).where(F.col("_r") <= context).drop("_r")
    return e.where(new).withColumn("part", F.lit("new")).unionByName(old.withColumn("part", F.lit("context"))).drop("cutoff")


def session_cutoff(sessions: DataFrame, processed: DataFrame, written: DataFrame) -> DataFrame:
    """K3: (session_id, cutoff, mode): the latest processed time of two ledgers; none or 0 means fresh."""
    both = processed.select("session_id", "processed_mtime").unionByName(written.select("session_id", "processed_mtime"))
    last = both.groupBy("session_id").agg(F.max("processed_mtime").alias("cutoff"))
    rows = sessions.select("session_id").distinct().join(last, "session_id", "left").withColumn("cutoff", F.when(F.col("cutoff") > 0, F.col("cutoff")))
    return rows.withColumn("mode", F.when(F.col("cutoff").isNull(), "fresh").otherwise("continuation"))


def candidate_names(rows: DataFrame) -> DataFrame:
    """The distinct entity names of candidates as the graph stores them."""
    return rows.select(normalize_name(F.col("name")).alias("name")).distinct()
