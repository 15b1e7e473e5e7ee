"""The given tables as archive tables, and the same in SQL."""

from __future__ import annotations

import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.operators.normalize import conversation_id
from chatlake.sources.arrays import opened

#: Put before the texts of every fifth conversation, so that the language vote has something to decide.
KOREAN = "한국어 대화입니다 " * 40


def _created(conv_id: Column) -> Column:
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), conv_id.cast("int"))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def message_time(conv_id: Column, place: Column) -> Column:
    """When a message was written: a minute after the one before."""
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), conv_id.cast("int"), place.cast("int"))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


#: message_time() in SQL.
MESSAGE_TIME = "strftime(TIMESTAMP '2024-01-01' + {0} * INTERVAL 1 HOUR + {1} * INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+00:00'"


def archive(spark: SparkSession, sf_dir: str, korean: bool = False, long: bool = False) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) of the conversations table: source by parity, title of the first turn, a date for each id. long: texts are repeated, so that some are over all limits."""
    raw = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    source = F.when(F.col("conv_id") % 2 == 0, "chatgpt").otherwise("claude")
    first = raw.where("turn = 0").select("conv_id", source.alias("source"), F.replace(F.substring("text", 1, 40), F.lit("\n"), F.lit(" ")).alias("title"), _created(F.col("conv_id")).alias("created_at"))
    counts = raw.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("raw_message_count"))
    keyed = first.withColumn("id", conversation_id(F.col("source"), F.col("title"), F.col("created_at")))
    conversations = keyed.join(counts.hint("merge"), "conv_id").select("id", "source", "title", "created_at", F.lit(None).cast("string").alias("updated_at"), "raw_message_count", F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("source_path"), "conv_id")
    text = F.concat(F.when(F.col("conv_id") % 5 == 0, F.lit(KOREAN)).otherwise(""), F.col("text")) if korean else F.col("text")
    if long:
        text = F.repeat(F.concat(text, F.lit("\n\n")), (1 + F.col("conv_id") % 7 * 10).cast("int"))
    messages = raw.join(keyed.select("conv_id", F.col("id").alias("conversation_id")).hint("merge"), "conv_id").select(
        F.concat("conversation_id", F.lit(":"), F.col("turn").cast("string")).alias("id"), "conversation_id", F.col("turn").cast("int").alias("message_index"), "role", text.alias("content"), F.lit(None).cast("string").alias("timestamp"), "conv_id"
    )
    return conversations, messages


def archive_sql(korean: bool = False, long: bool = False) -> str:
    """The same as common table expressions c and m."""
    text = f"CASE WHEN conv_id % 5 = 0 THEN '{KOREAN}' ELSE '' END || text" if korean else "text"
    text = f"repeat({text} || chr(10) || chr(10), CAST(1 + conv_id % 7 * 10 AS INTEGER))" if long else text
    return f"""
    first AS (
      SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'chatgpt' ELSE 'claude' END AS source, replace(substring(text, 1, 40), chr(10), ' ') AS title,
        strftime(TIMESTAMP '2024-01-01' + conv_id * INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_at FROM conversations WHERE turn = 0
    ), c AS (
      SELECT substr(sha256(source || ':' || title || ':' || created_at), 1, 16) AS id, source, title, created_at, CAST(n AS INTEGER) AS raw_message_count, conv_id
      FROM first JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) USING (conv_id)
    ), m AS (
      SELECT c.id || ':' || turn AS id, c.id AS conversation_id, CAST(turn AS INTEGER) AS message_index, role, {text} AS content, conv_id FROM conversations JOIN c USING (conv_id)
    )"""


def documents_archive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) of the documents table: one message each, without a title."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.col("doc_id").cast("string")
    conversations = raw.select(key.alias("id"), "source", F.lit("").alias("title"), F.lit("").alias("created_at"))
    messages = raw.select(F.concat(key, F.lit(":0")).alias("id"), key.alias("conversation_id"), F.lit(0).alias("message_index"), F.lit("user").alias("role"), F.col("text").alias("content"), F.lit(None).cast("string").alias("timestamp"))
    return conversations, messages


def exports_of(conversations: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The archive as conversations (id, value) of export files of both layouts, the first with a root node and decoy branches."""
    turns = messages.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("message_index", "role", "content"))).alias("t"))
    c = conversations.join(turns.hint("merge"), conversations["id"] == turns["conversation_id"])
    n = F.size("t")
    # The archive's first second, and what a message's place adds.
    began = F.unix_timestamp(F.expr("timestamp_ntz'2024-01-01 00:00:00'")) + F.col("conv_id") * 3600
    node = F.transform(
        "t",
        lambda x, i: F.struct(
            F.concat(F.lit("n"), i.cast("string")).alias("key"),
            F.struct(
                F.when(i == 0, F.lit("root-node")).otherwise(F.concat(F.lit("n"), (i - 1).cast("string"))).alias("parent"),
                F.when(i < n - 1, F.array(F.lit("decoy"), F.concat(F.lit("n"), (i + 1).cast("string")))).otherwise(F.array().cast("array<string>")).alias("children"),
                F.struct(F.struct(x["role"].alias("role")).alias("author"), F.struct(F.array(x["content"]).alias("parts")).alias("content"), (began + x["message_index"] * 60).alias("create_time")).alias("message"),
            ).alias("value"),
        ),
    )
    entries = F.concat(
        F.lit('{"root-node":{"parent":null,"message":null,"children":["n0"]},"decoy":{"parent":"root-node","children":[],"message":{"author":{"role":"user"},"content":{"parts":["decoy"]}}}'),
        F.array_join(F.transform(node, lambda e: F.concat(F.lit(',"'), e["key"], F.lit('":'), F.to_json(e["value"]))), ""), F.lit("}"),
    )
    seconds = began.cast("string")
    title = F.regexp_extract(F.to_json(F.struct(F.col("title").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    tree = F.concat(F.lit('{"title":'), title, F.lit(',"create_time":'), seconds, F.lit(',"mapping":'), entries, F.lit("}"))
    flat = F.to_json(
        F.struct(
            F.col("title").alias("name"), F.col("created_at"),
            F.transform("t", lambda x: F.struct(F.when(x["role"] == "user", "human").otherwise(x["role"]).alias("sender"), x["content"].alias("text"), message_time(F.col("conv_id"), x["message_index"]).alias("created_at"))).alias("chat_messages"),
        )
    )
    return c.where("source = 'chatgpt'").select("id", tree.alias("value")), c.where("source = 'claude'").select("id", flat.alias("value"))


def zipped(files: DataFrame, folder: str, per_zip: int = 10) -> None:
    """Write files (source_path, value) as zip archives of about per_zip members in folder, each by one task."""
    n = files.count() // per_zip + 1

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{key[0]}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, value in zip(rows["source_path"], rows["value"], strict=True):
                z.writestr(path, value)
        return pd.DataFrame({"n": [len(rows)]})

    files.groupBy(F.pmod(F.xxhash64("source_path"), F.lit(n)).alias("k")).applyInPandas(write, "n long").agg(F.sum("n")).collect()
