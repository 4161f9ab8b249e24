"""F: graph queries, each for a whole table of names or starts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..tables import written
from .contain import with_patterns
from .index import COLUMNS, tokens


def entity_profile(graph: Graph, names: DataFrame) -> DataFrame:
    """names(name) -> (entity, part, label, other, other_type, weight, pos): header, properties (rationale first) and edges both ways."""
    picked = graph.entities.join(names.select(F.lower("name").alias("_k")).distinct(), F.lower("name") == F.col("_k"), "left_semi")
    who = picked.select(F.col("id").alias("entity_id"), F.col("name").alias("entity"))
    no_type, no_weight = F.lit(None).cast("string").alias("other_type"), F.lit(None).cast("double").alias("weight")
    head = F.array(*[F.struct(F.lit(k).alias("label"), v.cast("string").alias("other")) for k, v in (("type", F.col("type")), ("description", F.col("description")), ("since", F.date_format("created", "yyyy-MM-dd")))])
    header = picked.select(F.col("name").alias("entity"), F.explode(head).alias("h")).select("entity", F.lit("header").alias("part"), "h.label", "h.other", no_type, no_weight, F.lit(-1).alias("pos"))
    facts = graph.properties.join(who, "entity_id").select("entity", F.lit("property").alias("part"), F.col("key").alias("label"), F.col("value").alias("other"), no_type, no_weight, F.when(F.col("key") == "rationale", 0).otherwise(1).alias("pos"))
    named = graph.entities.select(F.col("id").alias("_id"), F.col("name").alias("other"), F.col("type").alias("other_type"))
    shown = F.when(F.col("weight") != 1.0, F.col("weight"))
    side = lambda me, it, part, pos: graph.relationships.join(who, F.col(f"{me}_id") == F.col("entity_id")).join(named, F.col(f"{it}_id") == F.col("_id")).select("entity", F.lit(part).alias("part"), F.col("relation").alias("label"), "other", "other_type", shown.alias("weight"), F.lit(pos).alias("pos"))
    return header.unionByName(facts).unionByName(side("source", "target", "out", 2)).unionByName(side("target", "source", "in", 3))


def search(graph: Graph, terms: DataFrame) -> DataFrame:
    """terms(term) -> (term, hit_kind, name): full-text hits, else substrings; property values and relations as well."""
    terms = terms.select(F.lower("term").alias("term")).distinct()
    said = F.array_distinct(F.flatten(F.array(*[tokens(F.col(c)) for c in COLUMNS])))
    ids = graph.entities.select(F.col("id").alias("entity_id"), F.explode(said).alias("term")).join(terms, "term").distinct()
    found = written(ids.join(graph.entities, F.col("entity_id") == F.col("id")).select("term", F.lit("fulltext").alias("hit_kind"), "name"), "found")
    missed = terms.join(found.select("term").distinct(), "term", "left_anti")
    has = lambda df, c, ts: with_patterns(df.withColumn("_low", F.lower(c)), "_low", ts.select(F.col("term").alias("pattern"))).drop("_low").withColumn("term", F.explode("held"))
    e = graph.entities.select("id", "name", "description")
    loose = has(e, "name", missed).select("term", "id", "name").unionByName(has(e, "description", missed).select("term", "id", "name")).distinct().select("term", F.lit("substring").alias("hit_kind"), "name")
    value = has(graph.properties, "value", terms).join(graph.entities.select("id", "name"), F.col("entity_id") == F.col("id")).select("term", F.lit("property").alias("hit_kind"), "name").distinct()
    relation = has(graph.relationships.select("relation").distinct(), "relation", terms).select("term", F.lit("relation").alias("hit_kind"), F.col("relation").alias("name"))
    return found.unionByName(loose).unionByName(value).unionByName(relation)


def adjacency(graph: Graph) -> DataFrame:
    """(node, next, label): edges usable both ways; the way back is `~relation`."""
    r = graph.relationships
    return r.select(F.col("source_id").alias("node"), F.col("target_id").alias("next"), F.col("relation").alias("label")).unionByName(r.select(F.col("target_id").alias("node"), F.col("source_id").alias("next"), F.concat(F.lit("~"), "relation").alias("label")))


HUB = 50_000


class Steps:
    """Rows (node, next, ...) of which the rows of a hub are dealt out by salt, `hub` of them or so to each."""

    def __init__(self, steps: DataFrame, hub: int = HUB):
        salts = steps.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hub).select("node", F.ceil(F.col("_n") / hub).cast("int").alias("salts"))
        self.hubs = written(salts, "hubs")
        salted = steps.join(self.hubs, "node", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("next"), F.col("salts")), F.lit(0)).cast("int"))
        self.steps = written(salted.drop("salts"), "steps")

    def ahead(self, frontier: DataFrame) -> DataFrame:
        """The frontier's rows with each step from their node; a hub's rows go to each of its salts."""
        dealt = frontier.join(self.hubs, "node", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        return dealt.join(self.steps, ["node", "salt"]).drop("salt")


def traverse(graph: Graph, starts: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """starts(start id) -> visited (start, node, depth) and their edges (start, source_id, target_id, relation).

    Each hop joins the frontier to the edges and drops visited nodes; hops are written, so lineage stays short, and the
    edges of hubs are spread over several tasks.
    """
    steps = Steps(adjacency(graph).select("node", "next").distinct())
    seen = frontier = written(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct(), "hop")
    for d in range(1, depth + 1):
        frontier = written(steps.ahead(frontier.drop("depth")).select("start", F.col("next").alias("node")).distinct().join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(d)), "hop")
        seen = seen.unionByName(frontier)
    r = graph.relationships.select("source_id", "target_id", "relation")
    at = lambda c: seen.select("start", F.col("node").alias(c)).join(r, c).select("start", "source_id", "target_id", "relation")
    return seen, at("source_id").unionByName(at("target_id")).distinct()


PAIR = ["a", "b"]


def shortest_path(graph: Graph, pairs: DataFrame, hops: int | None = None) -> DataFrame:
    """pairs(a, b ids) -> (a, b, length, path): the smallest by node names among the shortest; label: the smallest.

    A forward label comes before a backward one. Pairs that aren't connected, or only by more than `hops` steps where it
    is given, have none. The search goes from both ends, a level at a time, on the side whose last level is smaller; rows
    are (pair, node, level) only. Where the sides first meet, the levels are walked back for the nodes that lie on a
    shortest path, and then forth, each pair taking the smallest name at every step.
    """
    steps = Steps(adjacency(graph).where("node <> next").select("node", "next", "label"))  # the walk takes the smallest of several labels
    ids = graph.entities.select("id", "name")
    asked = pairs.select(*PAIR).distinct().join(ids.select(F.col("id").alias("a"), F.col("name").alias("a_name")), "a").join(ids.select(F.col("id").alias("b")), "b", "left_semi")
    asked = written(asked, "pairs")
    still = asked.where("a <> b").select(*PAIR)
    seen = [written(still.select(*PAIR, F.col(end).alias("node"), F.lit(0).alias("level")), "path") for end in PAIR]
    last, level, sizes, meets = list(seen), [0, 0], [still.count()] * 2, []
    while sizes[0] and sizes[1] and (hops is None or sum(level) < hops):
        side = 0 if sizes[0] <= sizes[1] else 1
        level[side] += 1
        new = steps.ahead(last[side].join(still, PAIR, "left_semi").select(*PAIR, "node")).select(*PAIR, F.col("next").alias("node")).distinct()
        last[side] = written(new.join(seen[side], [*PAIR, "node"], "left_anti").withColumn("level", F.lit(level[side])), "path")
        seen[side] = seen[side].unionByName(last[side])
        met = written(last[side].join(seen[1 - side].select(*PAIR, "node"), [*PAIR, "node"], "left_semi").select(*PAIR, "node", F.lit(level[0]).alias("ahead"), F.lit(level[1]).alias("behind")), "path")
        meets.append(met)
        still = written(last[side].select(*PAIR).distinct().join(met, PAIR, "left_anti"), "path")  # others have met, or can't any more
        sizes = [last[x].join(still, PAIR, "left_semi").count() for x in (0, 1)]
    rows = asked.where("a = b").select(*PAIR, F.lit(0).alias("at"), F.lit(None).cast("string").alias("label"), F.col("a_name").alias("name"))
    if meets:
        rows = rows.unionByName(_walk(ids, asked, steps, seen, meets, level))
    path = F.sort_array(F.collect_list(F.struct("at", "label", "name")))
    whole = rows.groupBy(*PAIR).agg(path.alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.when(x["at"] == 0, x["name"]).otherwise(F.concat(F.lit("-["), x["label"], F.lit("]-> "), x["name"]))), " ")
    return whole.select(*PAIR, (F.size("p") - 1).alias("length"), text.alias("path"))


def _walk(ids: DataFrame, asked: DataFrame, steps: Steps, seen: list[DataFrame], meets: list[DataFrame], level: list[int]) -> DataFrame:
    """(a, b, at, label, name): the nodes of the smallest shortest path of every pair that has met."""
    met = meets[0]
    for m in meets[1:]:
        met = met.unionByName(m)
    met = written(met, "path")
    lengths = met.select(*PAIR, "ahead", "behind").distinct()
    good = met.select(*PAIR, "node", F.col("ahead").alias("at"))
    marked = [good]
    for k in range(level[0] - 1, 0, -1):
        back = steps.ahead(good.where(F.col("at") == k + 1).select(*PAIR, "node")).select(*PAIR, F.col("next").alias("node")).distinct()
        before = written(back.join(seen[0].where(F.col("level") == k).select(*PAIR, "node"), [*PAIR, "node"], "left_semi").withColumn("at", F.lit(k)), "path")
        marked.append(before)
        good = before.unionByName(met.select(*PAIR, "node", F.col("ahead").alias("at")))
    behind = seen[1].join(lengths, PAIR).where(F.col("level") < F.col("behind")).select(*PAIR, "node", (F.col("ahead") + F.col("behind") - F.col("level")).alias("at"))
    for m in marked:
        behind = behind.unionByName(m)
    on = written(behind.join(ids.select(F.col("id").alias("node"), "name"), "node").select(*PAIR, F.col("node").alias("next"), "at", "name"), "path")
    here = lengths.select(*PAIR, F.col("a").alias("node"))
    out = asked.join(lengths, PAIR, "left_semi").select(*PAIR, F.lit(0).alias("at"), F.lit(None).cast("string").alias("label"), F.col("a_name").alias("name"))
    for k in range(1, sum(level) + 1):
        reach = steps.ahead(here).join(on.where(F.col("at") == k).drop("at"), [*PAIR, "next"])
        first = F.min(F.struct("name", "next", F.col("label").startswith("~").alias("back"), "label")).alias("x")
        here = written(reach.groupBy(*PAIR).agg(first).select(*PAIR, "x.*"), "path")
        out = out.unionByName(here.select(*PAIR, F.lit(k).alias("at"), "label", "name"))
        here = here.select(*PAIR, F.col("next").alias("node"))
    return out


def neighbors(graph: Graph, names: DataFrame, relation: str | None = None) -> DataFrame:
    """names(name) -> (name, direction, relation, other)."""
    edges = graph.named_edges()
    edges = edges.where(F.col("relation") == relation) if relation else edges
    wanted = names.select(F.lower("name").alias("_k")).distinct()
    side = lambda me, other, way: edges.join(wanted, F.lower(me) == F.col("_k"), "left_semi").select(F.col(me).alias("name"), F.lit(way).alias("direction"), "relation", F.col(other).alias("other"))
    return side("source", "target", "out").unionByName(side("target", "source", "in"))


def ego_edges(graph: Graph, name: str | None = None) -> DataFrame:
    """all edges, or those at an entity, with the types of both ends."""
    edges = graph.named_edges().select("source", "source_type", "relation", "target", "target_type")
    return edges.where((F.lower("source") == name.lower()) | (F.lower("target") == name.lower())) if name else edges


def degrees(graph: Graph) -> DataFrame:
    """(id, out_degree, in_degree) of entities that have an edge."""
    ends = graph.relationships.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def hubs(graph: Graph, n: int = 10) -> DataFrame:
    """the n entities with most edges, ties by name."""
    d = graph.entities.join(degrees(graph), "id", "left").select("name", "type", F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"), F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"))
    return d.withColumn("degree", F.col("out_degree") + F.col("in_degree")).orderBy(F.desc("degree"), "name").limit(n)


def uncertain(graph: Graph, below: float = 0.5) -> DataFrame:
    """F8: edges of a lower weight."""
    return graph.named_edges().where(F.col("weight") < below).select("source", "relation", "target", "weight")


def decisions(graph: Graph, missing_only: bool = False) -> DataFrame:
    """decisions with their rationale."""
    d = graph.entities.where("type = 'decision'").join(graph.property("rationale").withColumnRenamed("entity_id", "id"), "id", "left").select("name", "rationale")
    return d.where("rationale IS NULL") if missing_only else d


def decision_totals(graph: Graph) -> DataFrame:
    """how many decisions have a rationale."""
    return decisions(graph).agg(F.count(F.lit(1)).alias("total"), F.count("rationale").alias("with_rationale"))


def type_counts(graph: Graph) -> DataFrame:
    """F10."""
    return graph.entities.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def relation_counts(graph: Graph) -> DataFrame:
    """F10."""
    return graph.relationships.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def recent(graph: Graph, n: int = 10) -> DataFrame:
    """latest by update, ties by name."""
    return graph.entities.orderBy(F.desc("updated"), "name").limit(n).select("name", "type", "updated")


def graph_stats(graph: Graph) -> DataFrame:
    """five counts."""
    e = graph.entities.agg(F.count(F.lit(1)).alias("entities"), F.countDistinct("type").alias("types"))
    r = graph.relationships.agg(F.count(F.lit(1)).alias("relationships"), F.countDistinct("relation").alias("relations"))
    return e.crossJoin(r).crossJoin(graph.properties.agg(F.count(F.lit(1)).alias("properties")))


def lessons_list(graph: Graph) -> DataFrame:
    """lessons, armed if they have any trigger (V5), with severity and triggers."""
    p = graph.properties.groupBy("entity_id").agg(
        F.max(F.when(F.col("key") == "severity", F.col("value"))).alias("severity"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("key").startswith("trigger-"), F.concat("key", F.lit("="), "value")))), ";").alias("triggers"),
    )
    joined = graph.entities.where("type = 'lesson'").join(p, F.col("id") == F.col("entity_id"), "left")
    return joined.select("name", F.when(F.coalesce("triggers", F.lit("")) != "", "armed").otherwise("passive").alias("state"), "severity", F.coalesce("triggers", F.lit("")).alias("triggers"))


def provenance_counts(graph: Graph) -> DataFrame:
    """entities by source agent."""
    return graph.entities.join(graph.property("source-agent", "agent"), F.col("id") == F.col("entity_id"), "left").groupBy(F.coalesce("agent", F.lit("(untagged)")).alias("agent")).agg(F.count(F.lit(1)).alias("n"))


def digest(graph: Graph, processed: DataFrame, worklog: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """one row: new and obsoleted entities, totals, sessions processed and marked entries of the last days."""
    since = F.date_sub(F.lit(as_of).cast("date"), days)
    e = graph.entities.agg(F.count_if(F.col("created") >= since).alias("new_entities"), F.count(F.lit(1)).alias("entities"))
    o = graph.properties.where("key = 'obsoleted-at'").agg(F.count_if(F.col("value").cast("date") >= since).alias("obsoleted"))
    s = processed.where(F.col("ts").cast("date") >= since).agg(F.countDistinct("session_id").alias("sessions"))
    m = worklog.agg(F.coalesce(F.sum(F.size(F.regexp_extract_all("content", F.lit(r"\[(?:lesson|insight|correction)\]"), 0))), F.lit(0)).cast("long").alias("marks"))
    return e.crossJoin(o).crossJoin(s).crossJoin(m)


def newest(graph: Graph, as_of: str, days: int = 7, n: int = 20) -> DataFrame:
    """the newest entities of the window."""
    return graph.entities.where(F.col("created") >= F.date_sub(F.lit(as_of).cast("date"), days)).orderBy(F.desc("created"), "name").limit(n).select("name", "type", "created")


def hot_context(graph: Graph, entities: int = 12, lessons: int = 5) -> DataFrame:
    """F16: the latest entities with their provenance, and severe lessons."""
    agents = graph.property("source-agent", "tag").withColumnRenamed("entity_id", "id")
    top = graph.entities.orderBy(F.desc("updated"), "name").limit(entities).join(agents, "id", "left").select(F.lit("entity").alias("part"), "name", F.coalesce("tag", F.lit("")).alias("tag"))
    severe = graph.properties.where("key = 'severity' AND value = 'high'").select(F.col("entity_id").alias("id"))
    return top.unionByName(graph.entities.where("type = 'lesson'").join(severe, "id", "left_semi").orderBy("name").limit(lessons).select(F.lit("lesson").alias("part"), "name", F.lit("high").alias("tag")))


def goal_facts(graph: Graph, goal_type: str = "goal", keys: tuple[str, ...] = ("stall_signal", "status", "blocker")) -> DataFrame:
    """the named properties of goals."""
    g = graph.entities.where(F.col("type") == goal_type).select("id", "name")
    return graph.properties.where(F.col("key").isin(*keys)).join(g, F.col("entity_id") == F.col("id")).select("name", "key", "value")


def stalled_since(texts: DataFrame, as_of: str) -> DataFrame:
    """texts(doc, text) -> (doc, date, days) of every `stalled since YYYY-MM-DD`."""
    found = texts.select("doc", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"stalled since (\d{4}-\d{2}-\d{2})"), 1)).alias("date"))
    return found.select("doc", "date", F.datediff(F.lit(as_of).cast("date"), F.col("date").cast("date")).alias("days"))


def entity_browse(graph: Graph, text: str, n: int = 200) -> DataFrame:
    """a substring of name or description, newest first."""
    hit = F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit(text.lower()))
    return graph.entities.where(hit).orderBy(F.desc("updated"), "name").limit(n).select("name", "type", "updated")


