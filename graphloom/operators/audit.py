"""N: activity analytics and audits. Work logs are (entry_no, date, project, content); V8: `as_of` stands for now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import path_like
from ..model import Graph
from .contain import containing
from .index import postings

# Words that are no topic, that tell of problems, that mark a replaced fact, and that carry no belief.
TOPIC_STOPS = (
    "the and for that this with from was were has have had been not but are can will just more also into some than then when "
    "what which about would there their them other could after before should where those these being each made like between "
    "does most only over such make its way may said did get got very still need how"
).split()
PROBLEMS = "bug fix broke failed error wrong issue stuck".split()
REPLACED = ("replaced by", "deprecated", "no longer", "obsolete", "superseded")
BELIEF_STOPS = "about being their there these those would should could which where while first every before".split()


def project_activity(entries: DataFrame) -> DataFrame:
    """(project, sessions, words, first, last); sessions are distinct dates."""
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    return entries.groupBy("project").agg(F.countDistinct("date").alias("sessions"), F.sum(words).cast("long").alias("words"), F.min("date").alias("first"), F.max("date").alias("last"))


def topics(entries: DataFrame, n: int = 30) -> DataFrame:
    """The commonest words of more than three characters, ties by word."""
    words = entries.select(F.explode(F.regexp_extract_all(F.lower("content"), F.lit(r"(?U)\b[a-z][a-z-]+\b"), 0)).alias("word"))
    return words.where((F.length("word") > 3) & ~F.col("word").isin(TOPIC_STOPS)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").orderBy(F.desc("n"), "word").limit(n)


def islands(days: DataFrame) -> DataFrame:
    """(start, end, days) of runs of consecutive days; the rows are days, however large the log."""
    group = F.date_sub("date", F.row_number().over(Window.orderBy("date")))
    return days.select("date").distinct().withColumn("g", group).groupBy("g").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("days")).drop("g")


def streaks(entries: DataFrame) -> DataFrame:
    """One row: active days, span, share active, longest run, longest gap and the day before it."""
    days = entries.select("date").distinct()
    base = days.agg(F.count(F.lit(1)).alias("active"), F.min("date").alias("first"), F.max("date").alias("last"))
    run = islands(days).agg(F.max("days").alias("longest_run"))
    gaps = days.withColumn("before", F.lag("date").over(Window.orderBy("date"))).where("before IS NOT NULL").withColumn("gap", F.datediff("date", "before"))
    gap = gaps.agg(F.max(F.struct("gap", (-F.datediff("before", F.lit("1970-01-01").cast("date"))).alias("o"), "before")).alias("g")).select("g.gap", "g.before")
    span = F.datediff("last", "first") + 1
    return base.crossJoin(run).crossJoin(gap).select("active", "first", "last", span.alias("span"), F.round(F.col("active") / span * 100, 6).alias("percent"), "longest_run", F.col("gap").alias("longest_gap"), F.col("before").alias("gap_after"))


def goal_gaps(goals: DataFrame, entries: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """goals(goal) -> (goal, state): STALLED, NO SIGNAL or ACTIVE, by words of more than three characters.

    A keyword counts where it is part of a word of an entry; keywords meet the log's distinct words, not its text.
    """
    keys = goals.select("goal", F.explode(F.regexp_extract_all(F.lower("goal"), F.lit(r"\w+"), 0)).alias("key")).where(F.length("key") > 3)
    recent = F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days)
    said = entries.select(recent.alias("recent"), F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "content", "project")), F.lit(r"\w+"), 0)).alias("word")).groupBy("word").agg(F.max("recent").alias("recent"))
    pairs = containing(said.select(F.col("word").alias("text")), keys.select(F.col("key").alias("pattern"))).toDF("word", "key")
    hits = said.join(pairs, "word").join(keys, "key").groupBy("goal").agg(F.max("recent").alias("recent"))
    state = F.when(F.col("recent").isNull(), "NO SIGNAL").when(F.col("recent"), "ACTIVE").otherwise("STALLED")
    return goals.select("goal").distinct().join(hits, "goal", "left").select("goal", state.alias("state"))


def activity_calendar(entries: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """(date, n, week, weekday, last30, streak, busiest) for each of the last days; the last three are totals."""
    end = F.lit(as_of).cast("date")
    spine = entries.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("date"))
    counts = entries.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    rows = spine.join(counts, "date", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = rows.agg(F.sum(F.when(F.col("date") > F.date_sub(end, 30), F.col("n")).otherwise(0)).alias("last30"), F.max("n").alias("busiest"))
    streak = islands(counts.where(F.col("date") <= end)).where(F.col("end") >= F.date_sub(end, 1)).agg(F.coalesce(F.max("days"), F.lit(0)).alias("streak"))
    week = F.floor(F.datediff("date", F.date_sub(end, days - 1)) / 7)
    return rows.crossJoin(total).crossJoin(streak).select("date", "n", week.alias("week"), F.weekday("date").alias("weekday"), "last30", "streak", "busiest")


def worklog_patterns(entries: DataFrame, goals: DataFrame) -> DataFrame:
    """(finding, key, n): time sinks of the last 10 entries, goals that the last 15 don't name, problem words."""
    last = entries.orderBy(F.desc("entry_no")).limit(15).withColumn("r", F.row_number().over(Window.orderBy(F.desc("entry_no"))))  # 15 rows
    ten = last.where("r <= 10")
    sinks = ten.groupBy(F.lower("project").alias("key")).agg(F.countDistinct("entry_no").alias("n")).where("n >= 5").select(F.lit("time sink").alias("finding"), "key", "n")
    words = goals.select("goal", F.explode(F.split(F.lower("goal"), r"\s+")).alias("w")).where(F.length("w") > 3)
    named = words.join(F.broadcast(last.select(F.lower(F.concat_ws(" ", "content", "project")).alias("t"))), F.contains("t", "w")).select("goal").distinct()
    stalled = words.select("goal").distinct().join(named, "goal", "left_anti").select(F.lit("stalled goal").alias("finding"), F.col("goal").alias("key"), F.lit(0).cast("long").alias("n"))
    count = ten.agg(F.coalesce(F.sum(sum((F.size(F.regexp_extract_all(F.lower("content"), F.lit(w), 0)) for w in PROBLEMS), F.lit(0))), F.lit(0)).cast("long").alias("n")).where("n > 8")
    return sinks.unionByName(stalled).unionByName(count.select(F.lit("problem density").alias("finding"), F.lit("").alias("key"), "n"))


def contradictions(graph: Graph, n: int = 20) -> DataFrame:
    """Replaced entities with later ones of their type. Each side is cut to what can be among the first n pairs.

    Pairs come by (id, later id), so the first n need at most n replaced entities and, of each, n later ones.
    """
    e = graph.entities
    said = F.lower(F.coalesce("description", F.lit("")))
    marked = F.lit(False)
    for w in REPLACED:
        marked = marked | said.contains(w)
    tops = e.groupBy("type").agg(F.max("id").alias("_top"))
    first = e.where(marked & (F.col("type") != "reasoning")).join(tops, "type").where(F.col("id") < F.col("_top")).orderBy("id").limit(n).select(F.col("id").alias("id1"), F.col("name").alias("name1"), "type")
    pairs = e.select(F.col("id").alias("id2"), F.col("name").alias("name2"), "type").join(F.broadcast(first), "type").where("id1 < id2")
    return pairs.orderBy("id1", "id2").limit(n).select("name1", "name2")


def orphans(graph: Graph, samples: int = 5) -> DataFrame:
    """(type, n, samples) of entities without edges; samples are the smallest names."""
    ends = graph.relationships.select(F.col("source_id").alias("id")).union(graph.relationships.select("target_id")).distinct()
    alone = graph.entities.join(ends, "id", "left_anti")
    few = alone.withColumn("_r", F.row_number().over(Window.partitionBy("type").orderBy("name"))).where(F.col("_r") <= samples).groupBy("type").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("samples"))
    return alone.groupBy("type").agg(F.count(F.lit(1)).alias("n")).join(few, "type")


def stale_entities(graph: Graph, as_of: str, days: int = 30, n: int = 15) -> DataFrame:
    """(name, last_worked, days) of those longest unworked that aren't paused or archived."""
    rest = graph.properties.where("key = 'status' AND value IN ('paused', 'archived')").select(F.col("entity_id").alias("id"))
    worked = graph.property("last-worked", "last_worked").withColumnRenamed("entity_id", "id")
    rows = graph.entities.join(worked, "id").join(rest, "id", "left_anti").withColumn("days", F.datediff(F.lit(as_of).cast("date"), F.col("last_worked").cast("date")))
    return rows.where(F.col("days") > days).orderBy(F.desc("days"), "name").limit(n).select("name", "last_worked", "days")


def stale_direction(texts: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """(doc, oldest, days) of texts(doc, text) whose oldest date is older."""
    found = texts.select("doc", F.explode(F.regexp_extract_all("text", F.lit(r"\d{4}-\d{2}-\d{2}"), 0)).alias("d")).groupBy("doc").agg(F.min("d").alias("oldest"))
    return found.withColumn("days", F.datediff(F.lit(as_of).cast("date"), F.col("oldest").cast("date"))).where(F.col("days") > days)


def belief_evidence(graph: Graph, beliefs: DataFrame, n: int = 8) -> DataFrame:
    """beliefs(pos, line) -> (pos, line, hits): entities found for the first three keywords of the first n beliefs."""
    few = beliefs.where(F.length(F.trim("line")) > 10).orderBy("pos").limit(n)
    words = F.filter(F.regexp_extract_all(F.lower("line"), F.lit(r"\w+"), 0), lambda w: (F.length(w) > 4) & ~w.isin(BELIEF_STOPS))
    keys = few.select("pos", "line", F.explode(F.slice(words, 1, 3)).alias("token"))
    df = postings(graph).select("token", "entity_id").distinct().join(F.broadcast(keys.select("token").distinct()), "token").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return keys.join(df, "token").groupBy("pos", "line").agg(F.sum("df").alias("hits"))


def graph_health(graph: Graph) -> DataFrame:
    """Entities, edges, edges an entity and the two findings."""
    rows = graph.entities.agg(F.count(F.lit(1)).alias("entities")).crossJoin(graph.relationships.agg(F.count(F.lit(1)).alias("edges")))
    mean = F.col("edges") / F.greatest(F.col("entities"), F.lit(1))
    return rows.select("entities", "edges", F.round(mean, 6).alias("mean_edges"), (mean < 1.0).alias("low"), ((F.col("entities") > 500) & (mean < 1.2)).alias("outgrown"))


def graph_tops(graph: Graph) -> DataFrame:
    """(part, key, n): the eight commonest types and five commonest relations, ties by name."""
    top = lambda df, c, part, n: df.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(n).select(F.lit(part).alias("part"), "key", "n")
    return top(graph.entities, "type", "type", 8).unionByName(top(graph.relationships, "relation", "relation", 5))


def confidence_distribution(graph: Graph) -> DataFrame:
    """Weights above 1 fall in no bucket."""
    w = F.col("weight")
    rows = graph.relationships.agg(F.count_if(w == 1.0).alias("verified"), F.count_if((w > 0.3) & (w < 1.0)).alias("inferred"), F.count_if(w <= 0.3).alias("speculative"), F.count(F.lit(1)).alias("total"))
    return rows.withColumn("more_inferred", F.col("inferred") > F.col("verified"))


def dead_references(texts: DataFrame, inventory: DataFrame, roots: tuple[str, ...] = ("",)) -> DataFrame:
    """texts(file, text) and inventory(path) -> (file, refs, dead, percent): references that resolve nowhere."""
    refs = texts.select("file", F.explode(F.regexp_extract_all("text", F.lit("`([^`\n]+)`"), 1)).alias("ref")).where(path_like(F.col("ref"))).withColumn("ref_no", F.monotonically_increasing_id())
    base = F.regexp_replace(F.trim("ref"), r":\d+$", "")
    places = refs.select("ref_no", F.explode(F.array(*[F.concat(F.lit(r), base) for r in roots])).alias("path"))
    live = places.join(inventory.select("path").distinct(), "path", "left_semi").select("ref_no").distinct()
    marked = refs.join(live.withColumn("ok", F.lit(1)), "ref_no", "left")
    return marked.groupBy("file").agg(F.count(F.lit(1)).alias("refs"), F.count_if(F.col("ok").isNull()).alias("dead")).withColumn("percent", F.round(F.col("dead") * 100.0 / F.col("refs"), 1))


def top_findings(findings: DataFrame) -> DataFrame:
    """findings(priority, seq, text) -> (place, text): the first two high and first medium, or the first three."""
    order = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    rows = findings.withColumn("o", order).withColumn("r", F.row_number().over(Window.partitionBy("priority").orderBy("seq"))).where("r <= 3")
    rows = rows.withColumns({"all_pos": F.row_number().over(Window.orderBy("o", "r")), "pick": ((F.col("o") == 0) & (F.col("r") <= 2)) | ((F.col("o") == 1) & (F.col("r") == 1))})  # nine rows
    rows = rows.withColumn("any_pick", F.max("pick").over(Window.partitionBy()))
    kept = rows.where(F.when(F.col("any_pick"), F.col("pick")).otherwise(F.col("all_pos") <= 3))
    return kept.select(F.row_number().over(Window.orderBy("o", "r")).alias("place"), "text")
