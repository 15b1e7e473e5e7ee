"""The archive: Parquet tables and a search index that imports append to, each key once and all or nothing. [SNK-1, SNK-2, SRC-8, JOI-5, WIN-2, AGG-4]"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.operators import search
from chatlake.operators.normalize import explode_messages, normalize
from chatlake.sources import runs

SCHEMAS = {
    "conversations": "id string, source string, title string, created_at string, updated_at string, raw_message_count int, source_path string",
    "messages": "id string, conversation_id string, message_index int, role string, content string, timestamp string",
    "bad_files": "source_path string, reason string",
    "insight_reports": "id string, title string, selected_conversation_ids array<string>, provider string, model string, markdown string, created_at string",
}
#: Each run is sorted by the keys that imports look up, so that a scan for some keys skips the other row groups and pages. Files of messages hold the title that was indexed, too.
TABLES = {
    "conversations": runs.Table(SCHEMAS["conversations"], ("id",)),
    "messages": runs.Table(SCHEMAS["messages"] + ", title string", ("conversation_id", "message_index")),
    "bad_files": runs.Table(SCHEMAS["bad_files"], ("source_path",)),
    "insight_reports": runs.Table(SCHEMAS["insight_reports"], ("id",)),
    "postings": search.TABLES["postings"],
    "blocks": search.TABLES["blocks"],
}
#: Keys that a scan's filter names at most, and keys that are broadcast to the archive at most; beyond, both sides shuffle their keys.
LOOKUP_KEYS, BROADCAST_KEYS = 2_000, 200_000
#: Times that an import is merged anew because another one was faster.
TRIES = 5


def read(spark: SparkSession, root: str, table: str, version: runs.Version | None = None) -> DataFrame:
    """A table of the archive at root; empty if nothing was appended yet. [SRC-8]"""
    return runs.read(spark, root, table, TABLES[table], version).select(*_names(table))


def first_of_each(rows: DataFrame, key: str = "id") -> DataFrame:
    """The first row of each key in the order of path parts and position. [WIN-2]

    An aggregate of the least (path, position, row): partial sums come before the shuffle, so a key that comes often costs no more.
    """
    order = [F.split("source_path", "/").alias("_parts"), F.col("position").alias("_at")]
    rest = [c for c in rows.columns if c != key]
    least = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return least.select(key, *[F.col("_r")[c].alias(c) for c in rest])


def known(keys: DataFrame, rows: DataFrame, column: str, n: int) -> DataFrame:
    """rows of the archive whose `column` is among keys (id), of which there are n.

    A few keys are named in the scan's filter; runs are sorted by them, so most row groups and pages are skipped. More are broadcast, and the archive's rows stay
    where they are; only for very many do both sides shuffle.
    """
    if n <= LOOKUP_KEYS:
        return rows.where(F.col(column).isin([r[0] for r in keys.distinct().collect()]))
    found = keys.select(F.col("id").alias(column))
    return rows.join(F.broadcast(found) if n <= BROADCAST_KEYS else found.hint("merge"), column, "left_semi")


def merge(conversations: DataFrame, known_conversations: DataFrame, known_messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new conversations, new messages with their title): those whose keys are not known yet, each key once. [SNK-1]

    A known conversation keeps its row, but messages beyond those it had are new. Known messages are never changed.
    """
    one = first_of_each(conversations.drop("messages"))
    new_conversations = one.join(known_conversations.select("id").hint("merge"), "id", "left_anti")
    messages = first_of_each(explode_messages(conversations, "title"))
    new_messages = messages.join(known_messages.select("id").hint("merge"), "id", "left_anti")
    return new_conversations.select(*_names("conversations")), new_messages.select(*_names("messages"), "title")


def _names(table: str) -> list[str]:
    return [x.strip().split(" ")[0] for x in SCHEMAS[table].split(",")]


def ingest(spark: SparkSession, root: str, files: DataFrame, rejected: DataFrame | None = None, stream: str | None = None, batch: int | None = None) -> DataFrame:
    """Append the files' new conversations and messages to the archive at root and to its index, and the files set aside, with reasons, to its bad_files.

    Gives one row (parsed, inserted_conversations, inserted_messages, skipped). All of it is seen at once, when the run is committed; a job that died leaves
    nothing, and an import that another one has overtaken is merged again. With stream and batch, a batch that the stream has committed before adds nothing.
    """
    if batch is not None and runs.current(spark, root).batches.get(stream, -1) >= batch:
        return _counts(spark, 0, 0, 0, 0)
    staging = runs.scratch(spark)
    parsed, bad = normalize(files, lambda rows, name: runs.written(rows, f"{staging}/{name}"))
    bad = runs.written(bad.unionByName(rejected) if rejected is not None else bad, f"{staging}/bad")
    n, sent, chars = parsed.agg(*[F.coalesce(x, F.lit(0)) for x in (F.count(F.lit(1)), F.sum("raw_message_count"), F.sum(F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"]))))]).first()
    skipped = bad.agg(F.countDistinct("source_path")).first()[0]
    for left in reversed(range(TRIES)):
        base = runs.current(spark, root)
        run = runs.Run(spark, root, TABLES)
        keys = parsed.select("id")
        with runs.setting(spark, "spark.sql.parquet.pushdown.inFilterThreshold", LOOKUP_KEYS):
            held = known(keys, read(spark, root, "conversations", base).select("id"), "id", n) if base.runs else keys.limit(0)
            had = known(keys, read(spark, root, "messages", base).select("id", "conversation_id"), "conversation_id", n) if base.runs else keys.limit(0)
            new_conversations, new_messages = merge(parsed, held, had)
            added = (run.write("conversations", new_conversations, n), run.write("messages", new_messages, sent, chars))
        if bad_files := bad.count():
            run.write("bad_files", bad, bad_files)
        if added[1]:
            search.add_to(run, run.read("messages"), added[1], chars)
        try:
            if any(run.rows.values()) or batch is not None:
                runs.commit(spark, root, base, [run.entry()] if any(run.rows.values()) else [], batches=None if batch is None else {stream: batch})
            break
        except runs.Conflict:
            run.drop()
            if not left:
                raise
    runs.delete(spark, staging)
    runs.compact(spark, root, TABLES)
    return _counts(spark, n, *added, skipped)


def _counts(spark: SparkSession, *counts: int) -> DataFrame:
    """One row of counts; which files were set aside, and why, is the archive's table bad_files. [AGG-4]"""
    return spark.createDataFrame([counts], ", ".join(f"{c} long" for c in SUMMARY))


SUMMARY = ("parsed", "inserted_conversations", "inserted_messages", "skipped")


def merge_summaries(summaries: DataFrame) -> DataFrame:
    """Summaries of several imports as one. [SRC-6, AGG-4]"""
    return summaries.agg(*[F.sum(c).alias(c) for c in SUMMARY])


def save_reports(reports: DataFrame, root: str) -> DataFrame:
    """Append reports to the archive's insight_reports, those whose id it has already left out, and give what was appended. [SNK-5]

    A report's id is made of what went into it and of what came out, so saving again after a failure adds nothing twice, and two runs of one selection are two reports.
    """
    spark = reports.sparkSession
    for left in reversed(range(TRIES)):
        base, run = runs.current(spark, root), runs.Run(spark, root, TABLES)
        new = reports.select(*_names("insight_reports")).dropDuplicates(["id"]).join(read(spark, root, "insight_reports", base).select("id").hint("merge"), "id", "left_anti")
        if not run.write("insight_reports", new, runs.SMALL):
            run.drop()
            return reports.select(*_names("insight_reports")).limit(0)
        try:
            runs.commit(spark, root, base, [run.entry()])
            break
        except runs.Conflict:
            run.drop()
            if not left:
                raise
    written = run.read("insight_reports")
    runs.compact(spark, root, TABLES)
    return written


def report(spark: SparkSession, root: str, report_id: str) -> DataFrame:
    """The saved report of an id, or no row. [FLT-6, INS-9]"""
    return read(spark, root, "insight_reports").where(F.col("id") == report_id)


def selection_toggle(selected: DataFrame, toggled: DataFrame) -> DataFrame:
    """Ids after toggling: those in one of the two, not in both. [SET-4]"""
    a, b = selected.select("id").distinct(), toggled.select("id").distinct()
    return a.join(b, "id", "left_anti").unionByName(b.join(a, "id", "left_anti"))


def latest(rows: DataFrame, by: str = "created_at", n: int | None = None) -> DataFrame:
    """Newest first, the n newest if n is given. [SRT-4, SRT-6, INS-9]"""
    out = rows.orderBy(F.desc(by), "id")
    return out if n is None else out.limit(n)


__all__ = ["SCHEMAS", "TABLES", "first_of_each", "ingest", "known", "latest", "merge", "merge_summaries", "read", "report", "save_reports", "selection_toggle"]
