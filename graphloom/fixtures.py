"""The driver's tables as graph, messages, events and logs: once for Spark, once as CTEs for the oracle.

The SQL of a table is shared where both engines read it alike; `{x}` stands for what differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .model import Graph
from .operators import kept_index
from .operators.index import concept_pairs
from .tables import folder, written

AS_OF = "2024-01-31"

_WORDS = {"spark": "regexp_extract_all(lower(text), '[a-z][a-z0-9]{4,}', 0)", "duck": "regexp_extract_all(lower(text), '[a-z][a-z0-9]{4,}')"}
_EXPLODE = {"spark": "explode", "duck": "unnest"}
_DAY = {"spark": "date_add(DATE '2024-01-01', CAST(id % 30 AS INT))", "duck": "CAST(DATE '2024-01-01' + CAST(id % 30 AS INTEGER) AS DATE)"}
_SHIP = {"spark": "date_format(max(l_shipdate), 'yyyy-MM-dd')", "duck": "strftime(max(l_shipdate), '%Y-%m-%d')"}
_KEBAB = {
    "spark": r"btrim(regexp_replace(lower(replace(regexp_replace(regexp_replace(n_name, r'([a-z])([A-Z])', r'$1-$2'), r'([A-Z]+)([A-Z][a-z])', r'$1-$2'), '_', '-')), '-+', '-'), '-')",
    "duck": r"trim(regexp_replace(lower(replace(regexp_replace(regexp_replace(n_name, '([a-z])([A-Z])', '\1-\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1-\2', 'g'), '_', '-')), '-+', '-', 'g'), '-')",
}

PARTS = {
    "lab": "SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id",
    "word_docs": "SELECT DISTINCT doc_id, {explode}({words}) AS word FROM documents",
    "terms": "SELECT word, count(*) AS df FROM word_docs GROUP BY word HAVING count(*) >= 2",
    "term_groups": "SELECT substr(word, 1, 2) AS head, count(*) AS n FROM terms GROUP BY 1",
    "term_starts": "SELECT head, coalesce(sum(n) OVER (ORDER BY head ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM term_groups",
    "term_ids": "SELECT word, df, CAST(10000000 + before + row_number() OVER (PARTITION BY substr(word, 1, 2) ORDER BY word) AS BIGINT) AS id FROM terms JOIN term_starts ON head = substr(word, 1, 2)",
    "base": """
        SELECT CAST(1000000 + r_regionkey AS BIGINT) AS id, lower(replace(r_name, ' ', '-')) AS name, 'region' AS type, CAST(NULL AS STRING) AS description FROM region
        UNION ALL SELECT CAST(2000000 + n_nationkey AS BIGINT), {kebab}, 'nation', CAST(NULL AS STRING) FROM nation
        UNION ALL SELECT 3000000 + s_suppkey, concat('supplier-', s_suppkey), 'supplier', CAST(NULL AS STRING) FROM supplier
        UNION ALL SELECT 4000000 + p_partkey, concat('part-', p_partkey), 'part', concat(p_name, ' ', p_brand, ' ', p_type) FROM part
        UNION ALL SELECT 5000000 + c_custkey, concat('customer-', c_custkey), 'customer', CAST(NULL AS STRING) FROM customer
        UNION ALL SELECT 6000000 + d.doc_id, concat(CASE WHEN quality = 1 THEN 'lesson-' WHEN quality = 0 THEN 'decision-' ELSE 'document-' END, d.doc_id), CASE WHEN quality = 1 THEN 'lesson' WHEN quality = 0 THEN 'decision' ELSE 'document' END, text FROM documents d LEFT JOIN lab ON d.doc_id = lab.doc_id
        UNION ALL SELECT id, word, 'term', CAST(NULL AS STRING) FROM term_ids""",
    "entities": "SELECT id, name, type, description, {day} AS created, {day} AS updated, CAST(NULL AS TIMESTAMP) AS last_referenced FROM base",
    "mentions": "SELECT word, doc_id FROM word_docs",
    "supplies": "SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_partkey",
    "edges": """
        SELECT CAST(2000000 + n_nationkey AS BIGINT) AS source_id, CAST(1000000 + n_regionkey AS BIGINT) AS target_id, 'part-of' AS relation, CAST(1.0 AS DOUBLE) AS weight FROM nation
        UNION ALL SELECT 3000000 + s_suppkey, CAST(2000000 + s_nationkey AS BIGINT), 'based-in', CAST(1.0 AS DOUBLE) FROM supplier
        UNION ALL SELECT 5000000 + c_custkey, CAST(2000000 + c_nationkey AS BIGINT), 'lives-in', CAST(1.0 AS DOUBLE) FROM customer
        UNION ALL SELECT 3000000 + l_suppkey, 4000000 + l_partkey, 'supplies', CAST(CASE WHEN n >= 3 THEN 1.0 WHEN n = 2 THEN 0.7 ELSE 0.3 END AS DOUBLE) FROM supplies
        UNION ALL SELECT t.id, 6000000 + m.doc_id, 'mentioned-in', CAST(0.7 AS DOUBLE) FROM mentions m JOIN term_ids t ON t.word = m.word""",
    "relationships": "SELECT source_id, target_id, relation, weight, CAST(DATE '2024-01-01' AS DATE) AS created FROM edges",
    "shipped": "SELECT l_partkey, {ship} AS day FROM lineitem GROUP BY l_partkey",
    "facts": """
        SELECT 4000000 + p_partkey AS entity_id, 'brand' AS key, p_brand AS value FROM part
        UNION ALL SELECT 4000000 + p_partkey, 'size', CAST(p_size AS STRING) FROM part
        UNION ALL SELECT 4000000 + l_partkey, 'last-worked', day FROM shipped
        UNION ALL SELECT 5000000 + c_custkey, 'segment', c_mktsegment FROM customer
        UNION ALL SELECT 5000000 + c_custkey, 'status', 'obsolete' FROM customer WHERE c_acctbal < 0
        UNION ALL SELECT 3000000 + s_suppkey, 'status', 'obsolete' FROM supplier WHERE s_acctbal < 0
        UNION ALL SELECT 6000000 + doc_id, 'severity', CASE WHEN toxic = 1 THEN 'high' ELSE 'medium' END FROM lab WHERE quality = 1
        UNION ALL SELECT 6000000 + doc_id, 'trigger-tool', concat('["\\\\"k\\\\": ', doc_id % 100, '}"]') FROM lab WHERE quality = 1
        UNION ALL SELECT 6000000 + doc_id, 'trigger-error', concat('["error.*\\\\"k\\\\": ', doc_id % 100, '\\\\\\\\}"]') FROM lab WHERE quality = 1
        UNION ALL SELECT 6000000 + doc_id, 'rationale', concat('because of document ', doc_id) FROM lab WHERE quality <> 1 AND doc_id % 2 = 0""",
    "properties": "SELECT entity_id, key, value, CAST(DATE '2024-01-01' AS DATE) AS updated FROM facts",
    "messages": "SELECT conv_id AS session_id, turn, text FROM conversations WHERE role = 'user'",
    "tool_events": "SELECT event_id, user_id AS session_id, ts, event_type, concat(event_type, ' ', props) AS command, CASE WHEN event_type = 'error' THEN concat(event_type, ' ', props) END AS output FROM events",
}


def _fill(text: str, engine: str) -> str:
    out = text
    for name, table in (("words", _WORDS), ("explode", _EXPLODE), ("day", _DAY), ("ship", _SHIP), ("kebab", _KEBAB)):
        out = out.replace("{" + name + "}", table[engine])
    return out if engine == "spark" else out.replace("\\\\", "\\")


TABLES = "region nation customer supplier part orders lineitem events documents labels conversations pages benchmark".split()


def needed(names: list[str], parts: dict[str, str] = PARTS) -> list[str]:
    """The parts that `names` build on, in order."""
    found: set[str] = set()

    def visit(name: str) -> None:
        if name in parts and name not in found:
            found.add(name)
            for other in parts:
                if other != name and f" {other}" in f" {parts[name]} ".replace("(", " ").replace("\n", " "):
                    visit(other)

    for n in names:
        visit(n)
    return [n for n in parts if n in found]


def spark_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One part as a DataFrame."""
    use = needed([name])
    ctes = ", ".join(f"{n} AS ({_fill(PARTS[n], 'spark')})" for n in use)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if any(f" {t}" in PARTS[n].replace("\n", " ") for n in use)}
    for t in tables:
        ctes = ctes.replace(f" FROM {t}", f" FROM {{{t}}}").replace(f" JOIN {t} ", f" JOIN {{{t}}} ")
    protected = ctes.replace("[a-z0-9]{4,}", "[a-z0-9]{{4,}}").replace("}\"]", "}}\"]").replace("}}}", "}}")
    return spark.sql(f"WITH {protected} SELECT * FROM {name}", **tables)


_stored: dict[tuple[str, str], Graph] = {}


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of a folder, written once an application, as most queries read its tables several times."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored or not _there(spark, _stored[key]):
        _stored[key] = Graph(*(written(spark_table(spark, sf_dir, n), f"graph-{n}") for n in ("entities", "relationships", "properties")))
    return _stored[key]


_concepts: dict[tuple[str, str], tuple[Graph, DataFrame]] = {}
_indexes: dict[tuple[str, str], tuple[Graph, kept_index.Kept]] = {}


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concept pairs of a folder's graph, kept once an application like the graph."""
    g, key = graph(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir)
    if key not in _concepts or _concepts[key][0] is not g:
        _concepts[key] = g, written(concept_pairs(g), "concepts")
    return _concepts[key][1]


def indexes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, kept_index.Kept]:
    """The concept pairs and the text index of a folder's graph, kept likewise."""
    g, key = graph(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes or _indexes[key][0] is not g:
        _indexes[key] = g, kept_index.build(g, folder(spark, "index"))
    return concepts(spark, sf_dir), _indexes[key][1]


def _there(spark: SparkSession, g: Graph) -> bool:
    """Whether the written tables still are where they were, and the session is the one that wrote them."""
    if g.entities.sparkSession is not spark:
        return False
    for df in (g.entities, g.relationships, g.properties):
        path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0])
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return False
    return True


def oracle(query: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """The query after the CTEs it builds on."""
    use = needed(list(names))
    parts = [f"{n} AS ({_fill(PARTS[n], 'duck')})" for n in use] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + query.strip()
