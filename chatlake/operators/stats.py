"""Statistics, facets, details and lookups around messages. [AGG-1..3, JOI-2, JOI-7..9, SRT-2..5, FLT-6, FLT-9, PRJ-3]"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.functions import text as T


def totals(conversations: DataFrame) -> DataFrame:
    """One row: total_conversations, total_messages, first_date, last_date; empty dates do not count. [AGG-1]"""
    date = F.nullif(F.col("created_at"), F.lit(""))
    return conversations.agg(F.count(F.lit(1)).alias("total_conversations"), F.coalesce(F.sum("raw_message_count"), F.lit(0)).alias("total_messages"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def by_source(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations and messages of each source, sources ascending; a conversation without messages counts. [AGG-2, JOI-2, SRT-5]

    Messages are counted for each conversation before the join, so what is joined is one row for each conversation.
    """
    counts = messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("_m"))
    joined = conversations.join(counts.hint("merge"), conversations["id"] == counts["conversation_id"], "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("conversations"), F.coalesce(F.sum("_m"), F.lit(0)).alias("messages")).orderBy("source")


def facets(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """by_source() and a row of sums with source null. [AGG-3, PRJ-3]"""
    each = by_source(conversations, messages)
    return each.unionByName(each.agg(F.lit(None).cast("string").alias("source"), F.sum("conversations").alias("conversations"), F.sum("messages").alias("messages")))


def longest(conversations: DataFrame, n: int = 5) -> DataFrame:
    """The n conversations with the most messages; ties by title and id. [SRT-2]"""
    return conversations.orderBy(F.desc("raw_message_count"), "title", "id").limit(n)


def detail(conversations: DataFrame, messages: DataFrame, conversation_id: str) -> DataFrame:
    """The messages of one conversation in order, with its title and source. [FLT-6, SRT-3, SNK-7]"""
    one = conversations.where(F.col("id") == conversation_id).select(F.col("id").alias("conversation_id"), "title", "source")
    own = messages.where(F.col("conversation_id") == conversation_id)
    return own.join(one.hint("merge"), "conversation_id").select("conversation_id", "title", "source", "message_index", "role", "content", "timestamp").orderBy("message_index")


def context_window(messages: DataFrame, targets: DataFrame, reach: int = 2) -> DataFrame:
    """The messages up to `reach` before and after each target (conversation_id, message_index), with target_index. [JOI-7, FLT-9]

    Each target names the indexes it wants, which makes the range join an equi-join.
    """
    t = F.col("message_index")
    wanted = targets.select("conversation_id", t.alias("target_index"), F.explode(F.sequence(t - reach, t + reach)).alias("message_index"))
    return messages.join(wanted.hint("merge"), ["conversation_id", "message_index"])


def cited_messages(reports: DataFrame, messages: DataFrame) -> DataFrame:
    """Each report's citations that name a message, numbered in order of appearance, with that message. [JOI-8, INS-10]"""
    cited = reports.select(F.col("id").alias("report_id"), F.posexplode(T.citations(F.col("markdown"))).alias("place", "c")).select("report_id", "place", "c.conversation_id", "c.message_index")
    return cited.join(messages.select("conversation_id", "message_index", F.col("id").alias("message_id"), "role", "content").hint("merge"), ["conversation_id", "message_index"])


def report_sources(reports: DataFrame, conversations: DataFrame) -> DataFrame:
    """Each report's conversations in the order of selection; missing ones drop out. [JOI-9]"""
    chosen = reports.select(F.col("id").alias("report_id"), F.posexplode("selected_conversation_ids").alias("ord", "conversation_id"))
    return chosen.join(conversations.withColumnRenamed("id", "conversation_id").select("conversation_id", "title", "source").hint("merge"), "conversation_id")
