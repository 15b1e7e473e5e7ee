"""Full-text search: an inverted index with positions, phrase matching, BM25, filters, grouping and excerpts. [SEA, FLT, SNK-2]

Many queries run as one job: a query is a row. Statistics are of the whole corpus, so filters come after ranking.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.functions import text as T
from chatlake.sources import runs

K1, B = 1.2, 0.75
#: idf of a phrase that is in half of all rows or more.
LEAST_IDF = 1e-6
#: Tokens of an excerpt.
WINDOW = 24
#: Buckets of postings by their term, levels of their weight, and postings of merged runs for each task of a bucket.
BUCKETS, LEVELS, SALT_POSTINGS = 16, 16, 16_000_000
#: Bytes of files and of shuffled texts that a task indexes at most.
READ_BYTES = 8 << 20
#: Bytes of texts whose terms are grouped at a time, and postings that leave Python at a time.
SHARE_BYTES, POSTINGS_SENT = 4 << 20, 100_000
#: Terms that are named in the scan's filter at most, and of which the bounds are looked up.
PUSHED_TERMS = 200
#: Phrase terms, limited hits and allowed conversations that are broadcast at most; beyond, the join shuffles.
BROADCAST_TERMS, BROADCAST_HITS, BROADCAST_IDS = 50_000, 20_000, 200_000


@dataclass(frozen=True)
class Index:
    """postings, blocks (their bounds by term and level), and the number of messages and of their tokens, titles included."""

    postings: DataFrame
    blocks: DataFrame
    n_docs: int
    n_tokens: int


def bucket_of(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _level(f: Column, dl: Column) -> Column:
    """Of a posting's weight, for any idf and mean length, in steps: higher levels hold the better postings."""
    return F.floor(LEVELS * f / (f + K1 * (1 - B + B * dl / F.lit(256.0)))).cast("int")


def postings_of(titled: DataFrame) -> DataFrame:
    """Rows (term, message_id, conversation_id, level, positions, dl, bucket) of messages (id, conversation_id, title, content): one for each term of a message.

    A title counts in every row; its tokens come first, and a place is left out after them, so that no phrase goes from one to the other. A message's
    terms are gathered in the task that has its row: nothing is shuffled. Spark splits the texts, and Arrow and numpy group the terms of SHARE_BYTES of texts at a time.
    """
    rows = titled.select(F.col("id").alias("message_id"), "conversation_id", T.spaced_tokens(F.col("title")).alias("t0"), T.spaced_tokens(F.col("content")).alias("t1"))
    each = rows.mapInArrow(_grouped, "term string, message_id string, conversation_id string, positions array<int>, dl int")
    return each.withColumn("level", _level(F.size("positions"), F.col("dl"))).withColumn("bucket", bucket_of("term")).select(*_columns(POSTINGS))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of batches (message_id, conversation_id, t0, t1), tokens being one space apart; those of a share of the texts come in the order that _deal() makes, so that its sort finds long runs."""
    held, size = [], 0
    for batch in batches:
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t0", "t1"))
        shares = (size + np.cumsum(sizes)) // SHARE_BYTES
        begins = np.flatnonzero(np.diff(shares, prepend=0))  # rows that pass a share's end begin the next one
        for a, b in zip([0, *begins], [*begins, batch.num_rows], strict=True):
            if a and held or size >= SHARE_BYTES:
                yield from _postings(pa.Table.from_batches(held))
                held, size = [], 0
            if b > a:
                held.append(batch.slice(a, b - a))
                size += int(sizes[a:b].sum())
    if held:
        yield from _postings(pa.Table.from_batches(held))


def _postings(share: pa.Table) -> Iterator[pa.RecordBatch]:
    message, conversation, t0, t1 = (share.column(c).cast(pa.string()).combine_chunks() for c in ("message_id", "conversation_id", "t0", "t1"))

    def counted(texts: pa.Array) -> np.ndarray:
        return np.where(pc.equal(texts, "").to_numpy(zero_copy_only=False), 0, pc.count_substring(texts, " ").to_numpy(zero_copy_only=False) + 1)

    n0 = counted(t0)
    dl = n0 + counted(t1)
    total = int(dl.sum())
    if not total:
        return
    both = pc.ascii_trim(pc.binary_join_element_wise(t0, t1, " "), " ")
    coded = pc.split_pattern(both.filter(pa.array(dl > 0)), " ").flatten().dictionary_encode()
    accented = pc.invert(pc.string_is_ascii(coded.dictionary))
    plain = pa.array([w.translate(_fold) for w in coded.dictionary.filter(accented).to_pylist()], pa.string())
    folded = pc.replace_with_mask(coded.dictionary, accented, plain).dictionary_encode()
    bucket = np.array([xxhash.xxh64_intdigest(w, 42) % BUCKETS for w in folded.dictionary.cast(pa.binary()).to_pylist()], np.int64)  # bucket_of()
    in_order = pc.sort_indices(folded.dictionary).to_numpy()  # as UTF-8 is sorted
    in_order = in_order[np.argsort(bucket[in_order], kind="stable")]
    number = np.empty(len(in_order), np.uint16 if len(in_order) < 1 << 16 else np.int32)
    number[in_order] = np.arange(len(in_order))
    term = number[folded.indices.to_numpy()][coded.indices.to_numpy()]
    doc = np.repeat(np.arange(len(dl), dtype=np.int32), dl)
    at = np.arange(total) - np.repeat(np.cumsum(dl) - dl, dl)
    at += at >= n0[doc]
    order = np.argsort(term, kind="stable")
    term, doc, at = term[order], doc[order], at[order].astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]))
    f, length = np.diff(first, append=total), dl[doc[first]]
    level = LEVELS * f / (f + K1 * (1 - B + B * length / 256.0))
    positions = pa.ListArray.from_arrays(pa.array(np.append(first, total).astype(np.int32)), pa.array(at))
    spellings = folded.dictionary.take(pa.array(in_order))
    rows = np.argsort(term[first].astype(np.int64) * (LEVELS + 1) + LEVELS - level.astype(np.int64), kind="stable")
    for some in np.split(rows, range(POSTINGS_SENT, len(rows), POSTINGS_SENT)):
        docs = pa.array(doc[first[some]])
        columns = [spellings.take(pa.array(term[first[some]])), message.take(docs), conversation.take(docs), positions.take(pa.array(some)), pa.array(length[some].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["term", "message_id", "conversation_id", "positions", "dl"])


def blocks_of(postings: DataFrame) -> DataFrame:
    """Rows (term, level, n, least_f, most_f, least_dl, most_dl, tokens) of postings."""
    f = F.size("positions")
    return postings.groupBy("term", "level").agg(F.count(F.lit(1)).alias("n"), F.min(f).alias("least_f"), F.max(f).alias("most_f"), F.min("dl").alias("least_dl"), F.max("dl").alias("most_dl"), F.sum(f).alias("tokens"))


def _merged_blocks(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term", "level").agg(F.sum("n").alias("n"), F.min("least_f").alias("least_f"), F.max("most_f").alias("most_f"), F.min("least_dl").alias("least_dl"), F.max("most_dl").alias("most_dl"), F.sum("tokens").alias("tokens"))


def _deal(postings: DataFrame, merged: int = 0) -> DataFrame:
    """New postings stay in the tasks that made them, each of which had a bounded share of the texts; so many of merged runs go by bucket and by the message's salt, so that a term that all messages hold is dealt to as many tasks as it needs."""
    if merged > SALT_POSTINGS:
        salts = merged // SALT_POSTINGS + 1
        postings = postings.repartition(BUCKETS * salts, "bucket", F.pmod(F.xxhash64("message_id"), F.lit(salts)))
    return postings.sortWithinPartitions("bucket", "term", F.desc("level"))


POSTINGS = "term string, message_id string, conversation_id string, level int, positions array<int>, dl int, bucket int"
BLOCKS = "term string, level int, n long, least_f int, most_f int, least_dl int, most_dl int, tokens long"


def _columns(schema: str) -> list[str]:
    return [x.strip().split(" ")[0] for x in schema.split(",")]


#: The tables of an index. An archive has the first two beside its own.
TABLES = {
    "postings": runs.Table(POSTINGS, ("bucket", "term"), _deal, partition=("bucket",)),
    # Their sum has dealt them by term and level: sorting each share is enough to skip row groups, and ranges would have the sum worked out twice.
    "blocks": runs.Table(BLOCKS, ("term", "level"), lambda rows, n: rows.sortWithinPartitions("term", "level"), merge=_merged_blocks),
    "ids": runs.Table("message_id string", ("message_id",)),
}


def build(conversations: DataFrame, messages: DataFrame) -> Index:
    """An index that is not saved: postings are made again for each query."""
    titled = _titled(conversations, messages)
    postings = postings_of(titled)
    blocks = blocks_of(postings)
    return Index(postings, blocks, titled.count(), blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])


def _titled(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    return messages.select("id", "conversation_id", "content").join(conversations.select(F.col("id").alias("conversation_id"), "title").hint("merge"), "conversation_id")


def _once(messages: DataFrame) -> DataFrame:
    """One row of each id: the least. Texts move only where an id comes twice."""
    rows = messages.select("id", "conversation_id", "content")
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    if twice.isEmpty():
        return rows
    least = rows.join(twice.hint("merge"), "id").groupBy("id").agg(F.min(F.struct("conversation_id", "content")).alias("r")).select("id", "r.*")
    return rows.join(twice.hint("merge"), "id", "left_anti").unionByName(least)


def add_to(run: runs.Run, titled: DataFrame, messages: int, chars: int) -> None:
    """Write the postings of `messages` many messages (id, conversation_id, title, content) of `chars` characters, and their bounds, as part of a run. [SNK-2]

    Texts are scanned, or joined with their titles, in shares of bounded size, so that sorting a task's postings takes as much memory whatever the import.
    """
    with ExitStack() as held:
        parts = max(int(run.spark.conf.get("spark.sql.shuffle.partitions")), 2 * runs.text_parts(chars))
        for key, value in (("spark.sql.files.maxPartitionBytes", READ_BYTES), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", READ_BYTES), ("spark.sql.shuffle.partitions", parts)):
            held.enter_context(runs.setting(run.spark, key, value))
        run.write("postings", postings_of(titled), 0)
    with runs.setting(run.spark, "spark.sql.shuffle.partitions", parts):
        run.write("blocks", blocks_of(run.read("postings")), 0)
    run.numbers |= {"docs": messages, "tokens": run.read("blocks").agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]}


def save(conversations: DataFrame, messages: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Index messages in the index at root: postings by bucket of the term, sorted by term and level, so that a query reads its terms' buckets and row groups. [SNK-2]

    mode append adds the messages that the index does not have, by their ids, so that a repeated import changes nothing, and merges small runs. A run
    counts from its commit on: one that was broken off is not there. Messages without their conversation are left out.
    """
    spark = messages.sparkSession
    base = runs.current(spark, root)
    if mode == "append" and base.runs:
        messages = messages.join(runs.read(spark, root, "ids", TABLES["ids"], base).select(F.col("message_id").alias("id")).hint("merge"), "id", "left_anti")
    run = runs.Run(spark, root, TABLES)
    titled = _titled(conversations, _once(messages))
    about, chars = messages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("content")), F.lit(0))).first()
    n = run.write("ids", titled.select(F.col("id").alias("message_id")), about)
    if n or mode != "append":
        add_to(run, titled, n, chars)
        runs.commit(spark, root, base, [run.entry()], () if mode == "append" else tuple(r["run"] for r in base.runs))
        runs.compact(spark, root, TABLES)
    else:
        run.drop()


def load(spark: SparkSession, root: str) -> Index:
    """The saved index at root, or that of the archive at root. Queries read the buckets of their terms."""
    now = runs.current(spark, root)
    return Index(runs.read(spark, root, "postings", TABLES["postings"], now), runs.read(spark, root, "blocks", TABLES["blocks"], now), now.total("docs"), now.total("tokens"))


def query_terms(queries: DataFrame) -> DataFrame:
    """Rows (query_id, phrase, k, m, offset, term) of queries (query_id, query): phrases numbered, k of them, of m terms each. Phrases without a term drop out."""
    parsed = queries.select("query_id", F.filter(F.transform(T.phrases(F.col("query")), T.tokens), lambda t: F.size(t) > 0).alias("ph"))
    each = parsed.select("query_id", F.size("ph").alias("k"), F.posexplode("ph").alias("phrase", "terms"))
    return each.select("query_id", "phrase", "k", F.size("terms").alias("m"), F.posexplode("terms").alias("offset", "term"))


def _weight(f: float, dl: float, mean: float) -> float:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / mean))


def _idf(n: int, docs: int) -> float:
    raw = math.log((docs - n + 0.5) / (n + 0.5))
    return raw if raw > 0 else LEAST_IDF


def least_level(blocks: list, best: int, docs: int, mean: float) -> int:
    """The lowest level that can hold one of the `best` postings of a term with these blocks. [SRT-1]

    The blocks of the highest lower bounds that together have `best` postings set a score that those reach; blocks whose upper bound is below it have none.
    """
    idf, seen, reached = _idf(sum(b["n"] for b in blocks), docs), 0, -1.0
    for low, n in sorted(((idf * _weight(b["least_f"], b["most_dl"], mean), b["n"]) for b in blocks), reverse=True):
        seen += n
        if seen >= best:
            reached = low
            break
    return min(b["level"] for b in blocks if idf * _weight(b["most_f"], b["least_dl"], mean) >= reached - 1e-8)


def rank(queries: DataFrame, index: Index, best: int | None = None) -> DataFrame:
    """Rows (query_id, message_id, conversation_id, score) of the messages that hold all phrases of a query; lower scores are better. [SEA-2, SEA-3, FLT-5, AGG-9]

    The postings are scanned once, in the buckets of the queries' terms and, if those are few, in the row groups that hold them. best: as many rows of each query
    are wanted, so that of the postings of a query of one word those levels are left out whose bounds show that they hold none of them.
    """
    spark = queries.sparkSession
    terms = query_terms(queries).withColumn("bucket", bucket_of("term"))
    held = terms.limit(BROADCAST_TERMS + 1).collect()
    mean = index.n_tokens / index.n_docs if index.n_tokens else 1.0
    if len(held) > BROADCAST_TERMS:
        hits = index.postings.join(terms.withColumn("least", F.lit(0)).hint("merge"), ["bucket", "term"])
        return _scored(_found(hits), index.n_docs, mean, None, False)
    names = sorted({r["term"] for r in held})
    least, counts, pushed = {}, None, index.postings.where(F.col("bucket").isin(sorted({r["bucket"] for r in held})))
    if len(names) <= PUSHED_TERMS:
        pushed = pushed.where(F.col("term").isin(names))
        if all(r["m"] == 1 for r in held):
            bounds: dict[str, list] = {}
            for b in _merged_blocks(index.blocks.where(F.col("term").isin(names))).collect():  # a row for each term and level
                bounds.setdefault(b["term"], []).append(b)
            counts = spark.createDataFrame([(r["query_id"], r["phrase"], sum(b["n"] for b in bounds.get(r["term"], []))) for r in held], "query_id string, phrase int, n long")
            least = {r["query_id"]: least_level(bounds[r["term"]], best, index.n_docs, mean) for r in held if best and r["k"] == 1 and r["term"] in bounds}
            pushed = pushed.where(F.col("level") >= min((least.get(r["query_id"], 0) for r in held), default=0))
    asked = spark.createDataFrame([(*r, least.get(r["query_id"], 0)) for r in held], "query_id string, phrase int, k int, m int, offset int, term string, bucket int, least int")
    hits = pushed.join(F.broadcast(asked), ["bucket", "term"]).where("level >= least")
    return _scored(_found(hits, phrases=any(r["m"] > 1 for r in held)), index.n_docs, mean, counts, True)


def _found(hits: DataFrame, phrases: bool = True) -> DataFrame:
    """Rows (query_id, message_id, conversation_id, dl, k, phrase, f): how often a message holds a phrase. All postings of a phrase's terms in a message are brought together once."""
    key = ["query_id", "message_id", "conversation_id", "dl", "k", "phrase"]
    if not phrases:
        return hits.select(*key, F.size("positions").alias("f"))
    begins = F.transform("positions", lambda p: p - F.col("offset"))  # where the phrase would begin
    met = hits.groupBy(*key, "m").agg(F.collect_list(begins).alias("b")).where(F.size("b") == F.col("m"))
    both = F.aggregate(F.slice("b", 2, F.col("m")), F.get("b", F.lit(0)), lambda x, y: F.array_intersect(x, y))
    return met.select(*key, F.size(both).alias("f")).where("f > 0")


def _scored(found: DataFrame, docs: int, mean: float, counts: DataFrame | None, few: bool) -> DataFrame:
    if counts is None:
        # What was found is counted, then scored: written, so that the postings are read once.
        found = runs.written(found, runs.scratch(found.sparkSession))
        counts = found.groupBy("query_id", "phrase").agg(F.count(F.lit(1)).alias("n"))
    # One row for each phrase: as few as the terms, and merging by phrase would bring all hits of a phrase to one task.
    joined = found.join(F.broadcast(counts) if few else counts.hint("merge"), ["query_id", "phrase"])
    raw = F.log((docs - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(raw > 0, raw).otherwise(LEAST_IDF)
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
    scored = joined.groupBy("query_id", "message_id", "conversation_id", "k").agg(F.count(F.lit(1)).alias("_p"), (-F.sum(part)).alias("score"))
    return scored.where("_p = k").select("query_id", "message_id", "conversation_id", "score")


def filtered(conversations: DataFrame, provider: str | None = None, date_from: str | None = None, date_to: str | None = None, title: str | None = None, inclusive_day: bool = False) -> DataFrame:
    """Conversations that pass; None or '' sets no filter. Dates compare as strings, so a bare date_to leaves out its own day unless inclusive_day. [FLT-1..4]"""
    out = conversations
    if provider:
        out = out.where(F.col("source") == provider)
    if date_from:
        out = out.where(F.col("created_at") >= date_from)
    if date_to:
        seen = F.substring("created_at", 1, len(date_to)) if inclusive_day else F.col("created_at")
        out = out.where(seen <= date_to)
    if title:
        out = out.where(F.col("title").ilike("%" + title.replace("\\", "\\\\") + "%"))  # a backslash is a character like others
    return out


def search_batch(queries: DataFrame, index: Index, conversations: DataFrame, messages: DataFrame, limit: int = 20, with_excerpts: bool = True, **filters) -> DataFrame:
    """The best `limit` messages of each query: (query_id, rank, score, conversation_id, message_id, message_index, source, title, role, timestamp, excerpt). [SEA-3, SEA-4, SEA-6, JOI-1, PRJ-1, SRT-1]

    Ties go by conversation id and message index. Excerpts are made of the rows that are left.
    """
    limit = max(1, limit)
    ranked = rank(queries, index, None if any(filters.values()) else limit).withColumn("message_index", F.element_at(F.split("message_id", ":"), -1).cast("int"))
    if any(filters.values()):
        allowed = filtered(conversations, **filters).select(F.col("id").alias("conversation_id"))
        few = allowed.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        ranked = ranked.join(F.broadcast(allowed) if few else allowed.hint("merge"), "conversation_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9), "conversation_id", "message_index")
    top = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    # What the limit leaves is small, so it goes to the tables, and their titles and contents stay where they are.
    few = queries.count() * limit <= BROADCAST_HITS

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df.hint("merge")

    named = conversations.select(F.col("id").alias("conversation_id"), "source", "title").join(small(top), "conversation_id")
    full = messages.select(F.col("id").alias("message_id"), "role", "timestamp", "content").join(small(named), "message_id")
    columns = ["query_id", "rank", "score", "conversation_id", "message_id", "message_index", "source", "title", "role", "timestamp"]
    if not with_excerpts:
        return full.select(*columns)
    terms = queries.select("query_id", F.filter(F.transform(T.phrases(F.col("query")), T.tokens), lambda t: F.size(t) > 0).alias("_ph"))
    return full.join(small(terms), "query_id").select(*columns, excerpt(F.col("content"), F.to_json("_ph")).alias("excerpt"))


def search(spark: SparkSession, query: str, index: Index, conversations: DataFrame, messages: DataFrame, limit: int = 20, **filters) -> DataFrame:
    """search_batch() for one query."""
    one = spark.createDataFrame([("q", query)], "query_id string, query string")
    return search_batch(one, index, conversations, messages, limit, **filters).drop("query_id").orderBy("rank")


def group_hits(hits: DataFrame, conversations: DataFrame, limit: int = 20, per_conversation: int = 3) -> DataFrame:
    """Hits by conversation, best first: (query_id, place, conversation fields, match_count, excerpts). [SEA-5, AGG-6, WIN-3, WIN-4, JOI-3]

    A conversation's excerpts are at most per_conversation; match_count counts its hits among those given.
    """
    best = Window.partitionBy("query_id", "conversation_id").orderBy("rank")
    numbered = hits.withColumn("_k", F.row_number().over(best))
    shown = F.struct("rank", "message_id", "message_index", "role", "timestamp", "excerpt")
    groups = numbered.groupBy("query_id", "conversation_id").agg(
        F.min("rank").alias("_best"), F.count(F.lit(1)).alias("match_count"), F.array_sort(F.collect_list(F.when(F.col("_k") <= per_conversation, shown))).alias("excerpts")
    )
    placed = groups.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_best"))).where(F.col("place") <= max(1, limit))
    return conversations.withColumnRenamed("id", "conversation_id").join(placed.hint("merge"), "conversation_id").drop("_best")


def shown_excerpts(groups: DataFrame, n: int = 2) -> DataFrame:
    """Groups with the first n of their excerpts, as a list of results shows them. [SEA-10]"""
    return groups.withColumn("excerpts", F.slice("excerpts", 1, n))


def search_conversations(queries: DataFrame, index: Index, conversations: DataFrame, messages: DataFrame, limit: int = 20, per_conversation: int = 3, **filters) -> DataFrame:
    """Grouped search: as many hits are fetched as limit * per_conversation * 2, and grouped. [SEA-5]"""
    fetched = search_batch(queries, index, conversations, messages, max(limit * per_conversation * 2, limit), **filters)
    return group_hits(fetched, conversations, limit, per_conversation)


_token = regex.compile(T.TOKEN)
_fold = str.maketrans(T.ACCENTED, T.PLAIN)
_sentence = regex.compile(r"[.:]\s+$")


def best_window(content: str, phrases: list[list[str]], n: int = WINDOW) -> str:
    """The excerpt of a text: its best window of n tokens, with hits in brackets and dots where it was cut."""
    spans = [m.span() for m in _token.finditer(content)]
    folded = [content[a:b].lower().translate(_fold) for a, b in spans]
    total = len(spans)
    by_first: dict[str, list[int]] = {}
    for k, terms in enumerate(phrases):
        by_first.setdefault(terms[0], []).append(k)
    hits = [(p, k) for p, word in enumerate(folded) for k in by_first.get(word, ()) if folded[p : p + len(phrases[k])] == phrases[k]]
    at = [p for p, _ in hits]

    def worth(start: int) -> tuple[int, int, int]:
        """Of the hits that begin in the window: 1000 for each phrase, 1 for each repeat; where the first begins and where the last ends."""
        low, high = bisect_left(at, start), bisect_left(at, start + n)
        if low == high:
            return 0, -1, -1
        inside = hits[low:high]  # at most one for each token and phrase
        distinct = len({k for _, k in inside})
        return 999 * distinct + len(inside), at[low], max(p + len(phrases[k]) for p, k in inside)

    opens = [i for i in range(total) if i == 0 or _sentence.search(content, spans[i - 1][1], spans[i][0]) or _sentence.search(content[spans[i - 1][1] : spans[i][0]])]
    best, start = 0, 0
    for p, _ in hits:
        score, first, last = worth(p)
        centred = max(0, min(first - int((n - (last - first)) / 2), total - n))
        if score > best:
            best, start = score, centred
        if total > n:
            before = opens[bisect_right(opens, p) - 1]
            if before < p:
                score = worth(before)[0] + (120 if before == 0 else 100)
                if score > best:
                    best, start = score, before
    end = min(start + n, total)
    marked: list[list[int]] = []
    for p, k in hits:
        q = p + len(phrases[k])
        if marked and p < marked[-1][1]:
            marked[-1][1] = max(marked[-1][1], q)
        else:
            marked.append([p, q])
    opening, closing = {}, set()
    for p, q in marked:
        if start <= p < end:
            opening[p] = min(q, end)
            closing.add(min(q, end) - 1)
    out = ["..."] if start > 0 else [content[: spans[0][0]] if spans else content]
    for i in range(start, end):
        out.append(("[" if i in opening else "") + content[spans[i][0] : spans[i][1]] + ("]" if i in closing else ""))
        if i + 1 < end:
            out.append(content[spans[i][1] : spans[i + 1][0]])
    if spans:
        out.append(content[spans[end - 1][1] :] if start + n - 1 >= total - 1 else "...")
    return " ".join("".join(out).split())


def excerpt(content: Column, phrases_json: Column) -> Column:
    """best_window() of a column; phrases as a JSON array of arrays of terms. For the few rows that a limit has left."""

    @F.pandas_udf("string")
    def run(contents: pd.Series, phrases: pd.Series) -> pd.Series:
        import json

        return pd.Series([best_window(c or "", json.loads(p)) for c, p in zip(contents, phrases, strict=True)])

    return run(content, phrases_json)
