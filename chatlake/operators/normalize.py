"""Exports in two vendor layouts to conversations with messages. Column expressions, but for the walk along a branch, each step of which depends on the one before. [NRM-1..13, UDF-1]

Layout A is a list of conversations whose messages form a tree (`mapping`); layout B is a list, or one conversation, of flat
`chat_messages`. A file is taken as a whole: if one conversation in it is not valid, the file is set aside with a reason.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.sources.runs import few

#: Paths of bad files that are broadcast at most.
FEW_PATHS = 100_000
MESSAGES = "array<struct<role:string,content:string,timestamp:string>>"
NODES = "map<string,struct<parent:string,children:array<string>,message:string>>"
#: Fields of a conversation before its messages are exploded.
COLUMNS = ["id", "source", "title", "created_at", "updated_at", "raw_message_count", "source_path", "messages"]


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _text(v: Column, path: str) -> Column:
    """The string at path; null where it is absent or no string."""
    return F.when(_kind(_at(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def _has_text(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).rlike(r"(?U)\S")


def iso_time(seconds: Column) -> Column:
    """Unix seconds as an ISO-8601 string in UTC; the fraction appears where it is not zero. Null for null and 0. [NRM-9]"""
    micros = F.bround(seconds * F.lit(1_000_000)).cast("long")
    whole, part = F.floor(micros / 1_000_000).cast("long"), F.pmod(micros, F.lit(1_000_000))
    # Arithmetic on a time without zone keeps the result free of the session's time zone.
    at = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), whole.cast("decimal(18,6)"))
    fraction = F.when(part == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0")))
    return F.when(seconds != 0, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00")))


def _walk(keys: pd.Series, parents: pd.Series, children: pd.Series) -> pd.DataFrame:
    """Places of the nodes from the first root by each last child, in one pass over each tree; the last of equal keys counts. A node that comes again ends the walk. [NRM-4, NRM-5]"""
    out = []
    for names, above, below in zip(keys, parents, children, strict=True):
        if names is None:
            out.append(([], False))
            continue
        place = {k: i for i, k in enumerate(names)}
        at = next((place[k] for k, p in zip(names, above, strict=True) if not p), None)
        path, seen = [], set()
        while at is not None and at not in seen:
            seen.add(at)
            path.append(at)
            at = place.get(below[at]) if below[at] is not None else None
        out.append((path, at is not None))
    return pd.DataFrame(out, columns=["path", "cycle"])


def _tree_parts(rows: DataFrame) -> DataFrame:
    """rows with _raw, the parsed messages of the branch, and _cycle: each in a step of its own, so that mapping and messages are parsed once."""
    nodes = rows.withColumn("_nodes", F.map_entries(F.from_json(F.get_json_object("c", "$.mapping"), NODES)))
    last = F.transform("_nodes", lambda e: F.try_element_at(e["value"]["children"], F.lit(-1)))
    walked = nodes.withColumn("_w", F.pandas_udf(_walk, "path array<int>, cycle boolean")(F.transform("_nodes", lambda e: e["key"]), F.transform("_nodes", lambda e: e["value"]["parent"]), last))
    raw = F.filter(F.transform("_w.path", lambda i: F.col("_nodes")[i]["value"]["message"]), lambda m: m.isNotNull())
    return walked.withColumn("_raw", F.transform(raw, F.try_parse_json)).withColumn("_cycle", F.col("_w.cycle")).drop("_nodes", "_w")


def _tree_messages(c: Column, v: Column) -> tuple[Column, Column]:
    """(messages, problem) of a layout A conversation with its _tree_parts(). [NRM-6, NRM-7]"""
    raw = F.col("_raw")

    def message(mv: Column) -> Column:
        parts = F.try_variant_get(mv, "$.content.parts", "array<variant>")
        texts = F.transform(parts, lambda p: F.when(_kind(p) == "STRING", F.try_variant_get(p, "$", "string")).when(_kind(p).startswith("OBJECT"), F.nullif(_text(p, "$.text"), F.lit(""))))
        content = F.array_join(F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda t: t.isNotNull()), "\n")
        return F.struct(F.coalesce(_text(mv, "$.author.role"), F.lit("")).alias("role"), content.alias("content"), iso_time(F.try_variant_get(mv, "$.create_time", "double")).alias("timestamp"))

    kept = F.filter(F.transform(raw, message), lambda x: x["role"].isin("user", "assistant", "system", "tool") & _has_text(x["content"]))
    bad = F.exists(
        raw, lambda m: (_kind(_at(m, "$.author")) == "VOID") | F.coalesce(_kind(_at(m, "$.content")) == "VOID", F.lit(False)) | F.coalesce(_kind(_at(m, "$.content.parts")) == "VOID", F.lit(False))
    )
    problem = F.when(F.col("_cycle"), "cycle in mapping").when(F.coalesce(bad, F.lit(False)), "null author, content or parts")
    return kept, problem


def _flat_messages(c: Column, v: Column) -> tuple[Column, Column]:
    """(messages, problem) of a layout B conversation. [NRM-8]"""
    items = F.try_variant_get(v, "$.chat_messages", "array<variant>")

    def message(m: Column) -> Column:
        sender = _text(m, "$.sender")
        listed = F.transform(
            F.try_variant_get(m, "$.content", "array<variant>"),
            lambda p: F.when(_kind(p) == "STRING", F.try_variant_get(p, "$", "string")).when(_kind(p).startswith("OBJECT") & (_text(p, "$.type") == "text"), F.coalesce(_text(p, "$.text"), F.lit(""))),
        )
        joined = F.array_join(F.filter(listed, lambda t: t.isNotNull()), "\n")
        content = F.coalesce(F.nullif(_text(m, "$.text"), F.lit("")), F.when(_kind(_at(m, "$.content")) == "STRING", _text(m, "$.content")).otherwise(joined), F.lit(""))
        stamp = F.coalesce(F.nullif(_text(m, "$.created_at"), F.lit("")), F.nullif(_text(m, "$.timestamp"), F.lit("")))
        return F.struct(F.when(sender == "human", "user").when(sender == "assistant", "assistant").alias("role"), content.alias("content"), stamp.alias("timestamp"))

    kept = F.filter(F.transform(items, message), lambda x: x["role"].isNotNull() & _has_text(x["content"]))
    bad = F.exists(items, lambda m: ~_kind(m).startswith("OBJECT") | F.coalesce(~_kind(_at(m, "$.created_at")).isin("STRING", "VOID"), F.lit(False)))
    return kept, F.when(F.coalesce(bad, F.lit(False)), "message is no object or its time no string")


@dataclass(frozen=True)
class Layout:
    """A layout of exports: detect() tells its files by their parsed content, and fields() reads a conversation.

    fields(json, parsed) gives title, created_at, updated_at, the field that must not be empty, and (messages, problem).
    """

    source: str
    detect: Callable[[Column], Column]
    title: Callable[[Column], Column]
    title_kind: Callable[[Column], Column]
    created_at: Callable[[Column], Column]
    updated_at: Callable[[Column], Column]
    body: str
    messages: Callable[[Column, Column], tuple[Column, Column]]
    problem: Callable[[Column], Column]
    #: Adds columns that messages() reads, to rows with c and v.
    parts: Callable[[DataFrame], DataFrame] = lambda rows: rows


def _is_list(v: Column) -> Column:
    return _kind(v).startswith("ARRAY")


TREE = Layout(
    "chatgpt",
    lambda v: _is_list(v) & (_at(v, "$[0]").isNull() | _at(v, "$[0].mapping").isNotNull()),
    lambda v: F.when(_at(v, "$.title").isNull(), F.lit("Untitled")).otherwise(_text(v, "$.title")),
    lambda v: _kind(_at(v, "$.title")),
    lambda v: F.coalesce(iso_time(F.try_variant_get(v, "$.create_time", "double")), F.lit("")),
    lambda v: iso_time(F.try_variant_get(v, "$.update_time", "double")),
    "mapping",
    _tree_messages,
    lambda v: F.lit(None).cast("string"),
    _tree_parts,
)
FLAT = Layout(
    "claude",
    lambda v: _at(v, "$[0].chat_messages").isNotNull() | _at(v, "$.chat_messages").isNotNull(),
    lambda v: F.when(_at(v, "$.name").isNotNull(), _text(v, "$.name")).when(_at(v, "$.title").isNotNull(), _text(v, "$.title")).otherwise("Untitled"),
    lambda v: _kind(F.coalesce(_at(v, "$.name"), _at(v, "$.title"))),
    lambda v: F.coalesce(_text(v, "$.created_at"), F.lit("")),
    lambda v: _text(v, "$.updated_at"),
    "chat_messages",
    _flat_messages,
    lambda v: F.when(_kind(_at(v, "$.created_at")) != "STRING", "created_at is no string").when(~_kind(_at(v, "$.updated_at")).isin("STRING", "VOID"), "updated_at is no string"),
)
#: In the order in which they are tried; the first that accepts a file reads it.
LAYOUTS = (TREE, FLAT)


def conversation_id(source: Column, title: Column, created_at: Column) -> Column:
    """16 hex digits of the SHA-256 of source, title and date. [NRM-11]"""
    return F.substring(F.sha2(F.concat(source, F.lit(":"), title, F.lit(":"), created_at), 256), 1, 16)


def _which(v: Column, layouts: tuple[Layout, ...]) -> Column:
    """The number of the first layout that accepts a file, or null."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(layouts))):
        out = F.when(F.coalesce(layouts[k].detect(v), F.lit(False)), k).otherwise(out)
    return out


def normalize(files: DataFrame, keep: Callable[[DataFrame, str], DataFrame] | None = None, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[DataFrame, DataFrame]:
    """(conversations with messages, rejected files) of rows (source_path, value), each a whole file unless it has a position: then it is an element of one.

    keep writes a table under a name and reads it back: files are then read and split once, whatever the number of layouts, and their conversations parsed
    once, and the paths of bad ones, if they are few, are broadcast, so that no message moves on their account.

    Conversations have COLUMNS and position, their place in the file; those without a message are left out, as are empty ones. rejected has
    (source_path, reason). An empty list is a valid file without conversations.
    """
    whole = files.where("position is null") if "position" in files.columns else files
    sniffed = whole.withColumn("v", F.try_parse_json("value")).withColumn("layout", _which(F.col("v"), layouts))
    one = F.when(F.col("layout").isNull(), F.array(F.lit(None).cast("string"))).when(_is_list(F.col("v")), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    unread = F.when(F.col("layout").isNull(), F.when(F.col("v").isNull(), "not valid JSON").otherwise("unknown layout"))
    # One huge file is one row up to here; its conversations are dealt to all tasks. A file without a layout is a row without text.
    dealt = sniffed.select("source_path", "layout", unread.alias("unread"), F.posexplode(one).alias("position", "c")).repartition(F.col("source_path"), F.col("position")).withColumn("position", F.col("position").cast("long"))
    dealt = keep(dealt, "dealt") if keep else dealt
    unknown = dealt.where("layout is null").select("source_path", F.col("unread").alias("reason"))
    good, bad, elements = [], [unknown], None
    if "position" in files.columns:
        # Large files come by element; the first of a file, which is what the layouts look at, tells its layout.
        elements = files.where("position is not null")
        first = elements.groupBy("source_path").agg(F.min_by("value", "position").alias("c"), (F.min("position") == 0).alias("alone"))  # an element of an array comes after its bracket
        listed = F.try_parse_json(F.when(F.col("alone"), F.col("c")).otherwise(F.concat(F.lit("["), F.col("c"), F.lit("]"))))
        told = first.select("source_path", _which(listed, layouts).alias("layout"), listed.isNull().alias("broken"))
        told = keep(told, "layouts") if keep else told
        bad.append(told.where("layout is null").select("source_path", F.when(F.col("broken"), "not valid JSON").otherwise("unknown layout").alias("reason")))
    for k, layout in enumerate(layouts):
        rows = dealt.where(F.col("layout") == k).select("source_path", "position", "c")
        if elements is not None:
            of_layout = told.where(F.col("layout") == k).select("source_path")
            of_layout = F.broadcast(of_layout) if keep and few(of_layout, FEW_PATHS) else of_layout.hint("merge")
            rows = rows.unionByName(elements.join(of_layout, "source_path", "left_semi").select("source_path", "position", F.col("value").alias("c")))
        rows = layout.parts(rows.withColumn("v", F.try_parse_json("c")))
        v = F.col("v")
        messages, problem = layout.messages(F.col("c"), v)
        held = rows.select(
            "source_path", "position", v.isNull().alias("broken"), _kind(v).startswith("OBJECT").alias("is_object"), layout.title(v).alias("title"), layout.title_kind(v).alias("title_kind"), layout.created_at(v).alias("created_at"),
            layout.updated_at(v).alias("updated_at"), layout.problem(v).alias("p0"), (F.coalesce(_kind(_at(v, f"$.{layout.body}")), F.lit("VOID")).isin("VOID", "OBJECT<>", "ARRAY<VOID>")).alias("no_body"),
            messages.alias("messages"), problem.alias("p1"),
        )
        empty = F.col("no_body") | (F.size(F.coalesce("messages", F.array().cast(MESSAGES))) == 0)
        judged = held.withColumn(
            "reason",
            F.when(F.col("broken"), "not valid JSON").when(~F.coalesce("is_object", F.lit(False)), "list element is no object").when(F.col("no_body"), None).when(F.coalesce(F.col("title_kind") != "STRING", F.lit(False)), "title is no string")
            .otherwise(F.coalesce("p0", "p1")),
        ).withColumn("empty", empty).withColumn("_row", F.monotonically_increasing_id())
        if keep:
            judged = keep(judged, f"judged-{layout.source}")
        # A condition that names _row stays above the expressions: below, they would be worked out again for the test.
        wrong = judged.where("reason is not null and _row >= 0").groupBy("source_path").agg(F.min("reason").alias("reason"))
        bad.append(wrong)
        source = F.lit(layout.source)
        paths = wrong.select("source_path")
        paths = F.broadcast(paths) if keep and few(paths, FEW_PATHS) else paths.hint("merge")
        good.append(
            judged.where("reason is null and not empty and _row >= 0").join(paths, "source_path", "left_anti")
            .select(conversation_id(source, F.col("title"), F.col("created_at")).alias("id"), source.alias("source"), "title", "created_at", "updated_at", F.size("messages").alias("raw_message_count"), "source_path", "messages", "position")
        )
    conversations, rejected = good[0], bad[0]
    for x in good[1:]:
        conversations = conversations.unionByName(x)  # [SET-2]
    for x in bad[1:]:
        rejected = rejected.unionByName(x)
    return conversations, rejected


def explode_messages(conversations: DataFrame, *more: str) -> DataFrame:
    """Rows (id, conversation_id, message_index, role, content, timestamp, source_path, position) and more columns of the conversation; the index counts kept messages. [NRM-12, WIN-1]"""
    rows = conversations.select(F.col("id").alias("conversation_id"), "source_path", "position", *more, F.posexplode("messages").alias("message_index", "m"))
    return rows.select(F.concat("conversation_id", F.lit(":"), F.col("message_index").cast("string")).alias("id"), "conversation_id", "message_index", "m.role", "m.content", "m.timestamp", "source_path", "position", *more)
