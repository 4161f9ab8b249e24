"""A1-A3, A10: session files, lenient JSON lines, canonical events and model payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "struct<type:string,text:string,name:string,input:string,is_error:boolean>"
EVENTS = f"session_id string, seq long, ts timestamp, agent string, role string, event_type string, blocks array<{BLOCK}>, raw string"


def scan_sessions(spark: SparkSession, folder: str, modified_after: str | None = None) -> DataFrame:
    """A1: (path, size, modified) of the `*.jsonl` files below a folder that aren't empty, by path.

    `modified_after` is a UTC time like 2024-01-01T00:00:00. A folder that isn't there gives no rows.
    """
    schema = "path string, size long, modified timestamp"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], schema)
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    reader = reader.option("modifiedAfter", modified_after) if modified_after else reader
    files = reader.format("binaryFile").load(folder).where("length > 0")
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy("path")


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, line) of all session files; one row a line, however large a file is."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def read_jsonl_lenient(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A2: lines(file, line, ...) -> rows whose line is a JSON object, and the rejected others; blank lines are dropped."""
    rows = lines.where(F.trim("line") != "")
    one = F.expr("try_parse_json(concat('[', line, ']')) IS NOT NULL AND try_variant_get(try_parse_json(concat('[', line, ']')), '$[1]', 'variant') IS NULL")
    good = F.trim("line").startswith("{") & F.trim("line").endswith("}") & one  # the parser alone would let text behind an object pass
    return rows.where(good), rows.where(~good)


def canonical_events(lines: DataFrame) -> DataFrame:
    """A3: lines(session_id, seq, line) of both dialects -> one shape, with `text` joined from the text blocks.

    A user turn has `type` user or `role` user; content may be a string or an array of blocks, at the top or in `message`.
    """
    get = lambda path: F.get_json_object("line", path)
    content = F.coalesce(get("$.message.content"), get("$.content"))
    raw = F.from_json(F.when(content.startswith("["), content), "array<struct<type:string,text:string,content:string,name:string,input:string,is_error:boolean>>")
    parsed = F.transform(raw, lambda b: F.struct(b["type"].alias("type"), F.coalesce(b["text"], b["content"]).alias("text"), b["name"].alias("name"), b["input"].alias("input"), b["is_error"].alias("is_error")))
    plain = F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("input"), F.lit(None).cast("boolean").alias("is_error")))
    tool = F.array(F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), get("$.name").alias("name"), get("$.input").alias("input"), F.lit(None).cast("boolean").alias("is_error")))
    blocks = F.coalesce(parsed, F.when(get("$.type") == "tool_use", tool), F.when(content.isNotNull(), plain))
    kind = F.coalesce(get("$.type"), get("$.role"))
    agent = F.when(get("$.type").isNull(), "cursor").otherwise("claude")
    rows = lines.select("session_id", "seq", F.try_to_timestamp(get("$.timestamp")).alias("ts"), agent.alias("agent"), F.coalesce(get("$.role"), get("$.message.role"), F.when(get("$.type").isin("user", "assistant"), get("$.type"))).alias("role"), kind.alias("event_type"), blocks.alias("blocks"), F.col("line").alias("raw"))
    text = F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    return rows.withColumns({"text": F.coalesce(text, F.lit("")), "tools": F.transform(F.filter(F.coalesce("blocks", F.array().cast(f"array<{BLOCK}>")), lambda b: b["type"] == "tool_use"), lambda b: b["name"])})


def parse_candidate_payloads(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A10: lines(doc_id, line_no, line) of model output -> entities and relationships.

    The last `type=result` record counts, as text or object; else the first record with entities; JSON inside prose is
    cut out. Nothing parseable gives no rows.
    """
    ok = lines.where(F.expr("try_parse_json(trim(line)) IS NOT NULL") & F.trim("line").startswith("{"))
    get = lambda c, path: F.get_json_object(c, path)
    rows = ok.select("doc_id", "line_no", (get("line", "$.type") == "result").alias("is_result"), F.coalesce(get("line", "$.result"), get("line", "$.content")).alias("result"), get("line", "$.entities").isNotNull().alias("has"), "line")
    best = rows.groupBy("doc_id").agg(
        F.max_by("result", F.when(F.col("is_result") & F.col("result").isNotNull(), F.col("line_no"))).alias("result"),
        F.min_by("line", F.when(F.col("has") & ~F.coalesce("is_result", F.lit(False)), F.col("line_no"))).alias("fallback"),
        F.max(F.coalesce("is_result", F.lit(False)) & F.col("result").isNotNull()).alias("answered"),
    )
    fine = lambda c: F.when(F.expr(f"try_parse_json({c}) IS NOT NULL") & F.trim(c).startswith("{"), F.col(c))
    best = best.withColumn("cut", F.regexp_extract(F.coalesce("result", F.lit("")), r"(?s)\{.*\}", 0))
    body = best.select("doc_id", F.when(F.col("answered"), F.coalesce(fine("result"), fine("cut"))).otherwise(F.col("fallback")).alias("body")).where("body IS NOT NULL")
    e = body.select("doc_id", F.posexplode(F.from_json(get("body", "$.entities"), "array<struct<name:string,type:string,description:string,props:map<string,string>>>")).alias("pos", "e")).select("doc_id", "pos", "e.*")
    r = body.select("doc_id", F.posexplode(F.from_json(get("body", "$.relationships"), "array<struct<source:string,relation:string,target:string>>")).alias("pos", "r")).select("doc_id", "pos", "r.*")
    return e, r
