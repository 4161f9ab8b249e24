"""Session lines, logs and candidates made from the driver's tables, for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One line a conversation turn: dialect 0 keys its events by type, dialect 1 by role. Every third turn is a tool use.
_VERBS = "array('shipped', 'fixed', 'looked at', 'decided')"


def gate_lines(spark: SparkSession, d: str, dialect: int) -> DataFrame:
    """(session_id, seq, line) of all conversations in a dialect; twenty conversations are one session here."""
    talk = spark.read.parquet(f"{d}/conversations.parquet")
    seq = (F.col("conv_id") * 1000 + F.col("turn")).alias("seq")
    text = F.concat(F.element_at(F.expr(_VERBS), (F.col("conv_id") % 4 + 1).cast("int")), F.lit(" "), "text")
    block = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
    tool = F.array(F.struct(F.lit("tool_use").alias("type"), F.when(F.col("conv_id") % 3 == 0, "Edit").otherwise("Read").alias("name"), F.lit("{}").alias("input")))
    if dialect == 0:
        said = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", block.alias("content")).alias("message")))
        used = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.lit("assistant").alias("role"), tool.alias("content")).alias("message")))
    else:
        said = F.to_json(F.struct("role", F.struct(block.alias("content")).alias("message")))
        used = F.to_json(F.struct(F.lit("assistant").alias("role"), F.struct(tool.alias("content")).alias("message")))
    line = F.when((F.col("turn") % 3 == 2) & (F.col("role") != "user"), used).otherwise(said)
    return talk.select((F.col("conv_id") / 20).cast("long").alias("session_id"), seq, line.alias("line"))


def mixed_lines(spark: SparkSession, d: str) -> DataFrame:
    """The same, even conversations in the first dialect and odd ones in the second."""
    own = lambda k: gate_lines(spark, d, k).where(F.floor(F.col("seq") / 1000) % 2 == k)
    return own(0).unionByName(own(1))


#: The same rows: role, tool and line.
GATE_LINES_SQL = """SELECT (conv_id // 20)::BIGINT AS session_id, conv_id * 1000 + turn AS seq,
 CASE WHEN turn % 3 = 2 AND role <> 'user' THEN 'assistant' ELSE role END AS role,
 CASE WHEN turn % 3 = 2 AND role <> 'user' THEN CASE WHEN conv_id % 3 = 0 THEN 'Edit' ELSE 'Read' END END AS tool,
 CASE WHEN turn % 3 = 2 AND role <> 'user' THEN concat('"', CASE WHEN conv_id % 3 = 0 THEN 'Edit' ELSE 'Read' END, '" ', repeat('x', 60))
 ELSE concat(['shipped', 'fixed', 'looked at', 'decided'][conv_id % 4 + 1], ' ', text) END AS line
 FROM conversations"""


def nested_lines(spark: SparkSession, d: str) -> DataFrame:
    """(session_id, seq, line): turns as text, tool use with a nested input, and results as text or as a list with images."""
    talk = spark.read.parquet(f"{d}/conversations.parquet").withColumn("seq", F.col("conv_id") * 1000 + F.col("turn"))
    text, image = F.struct(F.lit("text").alias("type"), F.col("text")), F.struct(F.lit("image").alias("type"), F.lit("png").alias("source"))
    given = F.struct(F.col("text").alias("command"), F.col("turn").alias("n"), F.struct(F.col("text").alias("deep")).alias("more"))
    kinds = [
        F.to_json(F.array(text)),
        F.to_json(F.array(F.struct(F.lit("tool_use").alias("type"), F.lit("t1").alias("id"), F.lit("Bash").alias("name"), given.alias("input")))),
        F.to_json(F.array(F.struct(F.lit("tool_result").alias("type"), F.col("text").alias("content"), (F.col("turn") % 8 == 2).alias("is_error")))),
        F.concat(F.lit("["), F.to_json(image), F.lit(','), F.lit('{"type":"tool_result","tool_use_id":"t1","content":['), F.to_json(image), F.lit(","), F.to_json(text), F.lit("]}]")),
    ]
    blocks = F.element_at(F.array(*kinds), (F.col("turn") % 4 + 1).cast("int"))
    head = F.to_json(F.struct(F.when(F.col("seq") % 5 == 0, "system").otherwise("user").alias("type"), F.lit("u").alias("uuid"), F.concat(F.lit("/work/"), F.col("conv_id") % 7).alias("cwd"), F.lit("main").alias("gitBranch")))
    line = F.concat(F.expr("left(h, length(h) - 1)"), F.lit(',"message":{"role":"'), F.col("role"), F.lit('","model":"m","content":'), F.col("b"), F.lit("}}"))
    return talk.withColumns({"h": head, "b": blocks}).select((F.col("conv_id") / 20).cast("long").alias("session_id"), "seq", line.alias("line"))
