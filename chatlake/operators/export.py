"""Markdown documents of conversations, searches and reports, as rows (file_name, markdown). [SNK-3, SNK-4, SNK-6, WIN-5]"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions import text as T


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def _stamp() -> Column:
    return F.when(F.coalesce("timestamp", F.lit("")) != "", F.concat(F.lit(" | "), F.col("timestamp"))).otherwise("")


def _closed(text: Column) -> Column:
    return F.concat(F.regexp_replace(text, r"(?U)\s+\z", ""), F.lit("\n"))


def conversation_markdown(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, file_name, markdown) of each conversation, front matter first, messages in order. [SNK-3]"""
    index, tick = F.col("message_index").cast("string"), F.lit("`")
    block = _lines(
        F.concat(F.lit("### ["), index, F.lit("] "), F.col("role"), _stamp()), "", F.concat(F.lit("> Source: `"), F.col("conversation_id"), F.lit("` message `"), index, tick), "", F.col("content"), "", ""
    )
    blocks = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_index", block.alias("b")))), lambda x: x["b"]), "").alias("body"))
    c = conversations.join(blocks.hint("merge"), "id", "left")
    shown = F.when(F.coalesce("created_at", F.lit("")) == "", "-").otherwise(F.col("created_at"))
    head = _lines(
        "---", "type: source-conversation", _field("conversation_id", F.col("id")), _field("source", F.col("source")), _field("title", T.quoted(F.col("title"))), _field("created_at", T.quoted(F.col("created_at"))),
        _field("updated_at", T.quoted(F.col("updated_at"))), _field("raw_message_count", F.col("raw_message_count").cast("string")), _field("source_path", T.quoted(F.col("source_path"))), "---", "",
        F.concat(F.lit("# "), F.col("title")), "", F.concat(F.lit("- Conversation ID: `"), F.col("id"), tick), F.concat(F.lit("- Source: `"), F.col("source"), tick),
        F.concat(F.lit("- Created: `"), shown, tick), "", "## Messages", "", "",
    )
    return c.select("id", F.concat("id", F.lit("-"), T.slug(F.col("title")), F.lit(".md")).alias("file_name"), _closed(F.concat(head, F.coalesce("body", F.lit("")))).alias("markdown"))


def search_dossier(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, file_name, markdown) of each query's hits from search_batch(), numbered in order. [SNK-4, WIN-5]"""
    tick = F.lit("`")
    numbered = hits.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    block = _lines(
        F.concat(F.lit("## "), F.col("_k").cast("string"), F.lit(". "), F.col("title")), "", F.concat(F.lit("- Conversation ID: `"), F.col("conversation_id"), tick), F.concat(F.lit("- Message ID: `"), F.col("message_id"), tick),
        F.concat(F.lit("- Message index: `"), F.col("message_index").cast("string"), tick), F.concat(F.lit("- Source: `"), F.col("source"), tick), F.concat(F.lit("- Role: `"), F.col("role"), tick, _stamp()), "", F.col("excerpt"), "", "",
    )
    body = numbered.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", block.alias("b")))), lambda x: x["b"]), "").alias("body"))
    q = queries.select("query_id", "query").join(body.hint("merge"), "query_id", "left")
    head = _lines("---", "type: search-dossier", _field("query", T.quoted(F.col("query"))), _field("result_count", F.coalesce("n", F.lit(0)).cast("string")), "---", "", F.concat(F.lit("# Search Dossier: "), F.col("query")), "", "")
    return q.select("query_id", F.concat(F.lit("search-"), T.slug(F.col("query")), F.lit(".md")).alias("file_name"), _closed(F.concat(head, F.coalesce("body", F.lit("")))).alias("markdown"))


def report_files(reports: DataFrame) -> DataFrame:
    """(id, file_name, markdown) of saved reports. [SNK-6]"""
    return reports.select("id", F.concat(T.safe_file_name(F.col("title")), F.lit(".md")).alias("file_name"), "markdown")


#: Documents of one name that one task numbers.
NAMED = 100_000


def numbered(documents: DataFrame) -> DataFrame:
    """Rows (file_name, markdown) whose names are all different: of documents of one name the first, by a digest, keeps it, the others get -2, -3.. before the suffix.

    A name that a document has of its own stays with it: a number that would make such a name is followed by the text's digest. Documents without a name are left out. Only
    documents that share a name are moved, and those of a very common one are numbered in several parts, from the parts' sizes.
    """
    rows = documents.select("file_name", "markdown").where("file_name is not null")
    shared = rows.groupBy("file_name").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if shared.isEmpty():
        return rows
    alone = rows.join(shared.select("file_name").hint("merge"), "file_name", "left_anti")
    key = F.sha2(F.coalesce("markdown", F.lit("")), 256)
    keyed = rows.join(shared.hint("merge"), "file_name").withColumn("_key", key).withColumn("_part", F.pmod(F.xxhash64("_key"), F.ceil(F.col("_n") / NAMED)))
    sizes = keyed.groupBy("file_name", "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy("file_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    placed = keyed.withColumn("_k", F.row_number().over(Window.partitionBy("file_name", "_part").orderBy("_key"))).join(before.hint("merge"), ["file_name", "_part"])
    number = (F.col("_before") + F.col("_k")).cast("string")
    stem, suffix = F.regexp_extract("file_name", r"(?s)^(.+?)(\.[^.]*)?$", 1), F.regexp_extract("file_name", r"(?s)^(.+?)(\.[^.]*)?$", 2)
    made = placed.select("markdown", "_key", F.when(number == "1", F.col("file_name")).alias("_own"), F.concat(stem, F.lit("-"), number).alias("_stem"), suffix.alias("_suffix")).withColumn("_new", F.concat("_stem", "_suffix"))
    taken = rows.select(F.col("file_name").alias("_new"), F.lit(True).alias("_taken")).distinct()
    named = made.join(taken.hint("merge"), "_new", "left").withColumn("file_name", F.coalesce("_own", F.when(F.col("_taken"), F.concat("_stem", F.lit("-"), F.substring("_key", 1, 12), "_suffix")).otherwise(F.col("_new"))))
    return alone.unionByName(named.select("file_name", "markdown"))


def write_files(documents: DataFrame, folder: str) -> None:
    """Write each row (file_name, markdown) as one file in folder, a path or URI of a store that all executors reach. [SNK-3, SNK-4, SNK-6]

    Tasks write in parallel, each file under a name of its own first and then renamed, so that a task that runs twice leaves whole files. Rows of the same name
    are numbered, see numbered(); a null text is an empty file. Names that would lead out of the folder raise ValueError.
    """

    def write(rows: Iterator) -> None:
        store, base = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(base, recursive=True)
        for row in rows:
            if "/" in row["file_name"] or row["file_name"] in ("", ".", ".."):
                raise ValueError(f"no file name: {row['file_name']!r}")
            part = f"{base}/.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                out.write((row["markdown"] or "").encode("utf-8"))
            store.move(part, f"{base}/{row['file_name']}")

    numbered(documents).foreachPartition(write)
