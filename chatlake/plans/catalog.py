"""The registered queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.functions import text as T
from chatlake.operators import export, normalize, reports, search, stats, store
from chatlake.plans.adapters import MESSAGE_TIME, archive, archive_sql, documents_archive, exports_of, zipped
from chatlake.sources.exports import read_exports
from chatlake.sources.runs import scratch
from chatlake.streaming.ingest import ingest_stream

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _found[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


_indexes: dict[tuple[str, str, str], str] = {}


def _indexed(spark: SparkSession, sf_dir: str, table: str = "conversations") -> tuple[search.Index, DataFrame, DataFrame]:
    """(saved index, conversations, messages) of a given table; an application saves a table's index once."""
    c, m = archive(spark, sf_dir) if table == "conversations" else documents_archive(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, table)
    if key not in _indexes:
        root = scratch(spark)
        search.save(c, m, root)
        _indexes[key] = root
    return search.load(spark, _indexes[key]), c, m


#: All roles that a layout keeps: layout A has system and tool, layout B's rule drops them.
_KEPT = f"SELECT m.id, m.conversation_id, CAST(row_number() OVER (PARTITION BY m.conversation_id ORDER BY message_index) - 1 AS INTEGER) AS message_index, role, content, {MESSAGE_TIME.format('m.conv_id', 'm.message_index')} AS timestamp FROM m JOIN c ON c.id = m.conversation_id WHERE CASE WHEN source = 'chatgpt' THEN role IN ('user', 'assistant', 'system', 'tool') ELSE role IN ('user', 'assistant') END AND regexp_matches(content, '[^\\s]')"
# Search


def _bm25_sql(asked: dict[str, str], docs: str = "conversations", where: str = "true", limit: int = 20) -> str:
    """hits(query_id, rank, score, message_id, conversation_id, ...) of queries, as common table expressions."""
    toks = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"
    kept = f"SELECT conversation_id || ':' || message_index AS message_id, conversation_id, message_index, role, source, title, created_at, {toks.format('title')} AS t0, {toks.format('content')} AS t1 FROM k JOIN c ON c.id = k.conversation_id"
    base = (
        f"{archive_sql()}, k AS ({_KEPT}), d AS ({kept})"
        if docs == "kept"
        else archive_sql() + f", d AS (SELECT m.id AS message_id, conversation_id, message_index, role, source, title, created_at, {toks.format('title')} AS t0, {toks.format('content')} AS t1 FROM m JOIN c ON c.id = m.conversation_id)"
        if docs == "conversations"
        else f"d AS (SELECT doc_id || ':0' AS message_id, CAST(doc_id AS VARCHAR) AS conversation_id, 0 AS message_index, 'user' AS role, source, '' AS title, '' AS created_at, CAST([] AS VARCHAR[]) AS t0, coalesce({toks.format('text')}, []) AS t1 FROM documents)"
    )
    parts = []
    for name, query in asked.items():
        import re

        terms = [t for p in re.findall(r"[^\s\"']+", query) if (t := re.findall(r"[^\W_]+", p.lower()))]
        for k, ph in enumerate(terms):
            test = " AND ".join(f"{{0}}[i + {o}] = '{t}'" for o, t in enumerate(ph))
            f = " + ".join(f"len(list_filter(range(1, len({c}) - {len(ph)} + 2), lambda i: {test.format(c)}))" for c in ("t0", "t1"))
            parts.append(f"SELECT '{name}' AS query_id, {k} AS phrase, {len(terms)} AS k, message_id, {f} AS f, len(t0) + len(t1) AS dl FROM d")
    return f"""
    {base}, tf AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE f > 0),
    st AS (SELECT count(*) AS nn, avg(len(t0) + len(t1)) AS av FROM d), df AS (SELECT query_id, phrase, count(*) AS n FROM tf GROUP BY ALL),
    sc AS (
      SELECT query_id, message_id, -sum(CASE WHEN ln((nn - n + 0.5) / (n + 0.5)) > 0 THEN ln((nn - n + 0.5) / (n + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / av))) AS score
      FROM tf JOIN df USING (query_id, phrase), st GROUP BY query_id, k, message_id HAVING count(*) = k
    ), hits AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), conversation_id, message_index) AS INTEGER) AS rank
      FROM sc JOIN d USING (message_id) WHERE {where} QUALIFY rank <= {limit}
    )"""


_HIT = "query_id, rank, round(score, 6) AS score, conversation_id, message_id, message_index, source, title, role"
WORDS = {"one": "the", "two": "that was"}
PHRASE = {"of-the": "of-the", "quoted": "\"of the\" and"}
MANY = {f"q{k}": w for k, w in enumerate(["the", "of", "and the", "in-the", "this that", "from", "with or", "is of", "for and", "not"])}


def _ask(spark: SparkSession, asked: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(asked.items()), "query_id string, query string")


def _hits(spark: SparkSession, sf_dir: str, asked: dict[str, str], limit: int = 20, **filters) -> DataFrame:
    index, c, m = _indexed(spark, sf_dir)
    return search.search_batch(_ask(spark, asked), index, c, m, limit, with_excerpts=False, **filters).drop("timestamp").withColumn("score", F.round("score", 6))


@_query(f"WITH {_bm25_sql(WORDS)} SELECT {_HIT} FROM hits")
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, WORDS)


@_query(f"WITH {_bm25_sql(PHRASE)} SELECT {_HIT} FROM hits")
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, PHRASE)


@_query(f"WITH {_bm25_sql(MANY, limit=10)} SELECT {_HIT} FROM hits")
def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, MANY, 10)


_FILTERS = {"provider": "claude", "date_from": "2024-01-01T12:00:00", "date_to": "2024-01-31", "title": "th"}


@_query(f"WITH {_bm25_sql(WORDS, where="source = 'claude' AND created_at >= '2024-01-01T12:00:00' AND created_at <= '2024-01-31' AND title ILIKE '%th%'")} SELECT {_HIT} FROM hits")
def search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, WORDS, **_FILTERS)


@_query(
    f"""WITH {_bm25_sql(WORDS, limit=120)}, g AS (SELECT query_id, conversation_id, min(rank) AS best, count(*) AS match_count, array_to_string(list(message_id || '/' || rank || '/' || message_index || '/' || role ORDER BY rank)[1:3], ',') AS shown FROM hits GROUP BY ALL)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best) AS INTEGER) AS place, conversation_id, match_count, shown, source, title, raw_message_count FROM g JOIN c ON c.id = conversation_id QUALIFY place <= 20"""
)
def search_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, c, m = _indexed(spark, sf_dir)
    groups = search.search_conversations(_ask(spark, WORDS), index, c, m)
    return groups.select("query_id", "place", "conversation_id", "match_count", F.array_join(F.transform("excerpts", lambda e: F.concat_ws("/", e["message_id"], e["rank"].cast("string"), e["message_index"].cast("string"), e["role"])), ",").alias("shown"), "source", "title", "raw_message_count")


@_query(f"WITH {_bm25_sql({'d': 'the', 'e': 'los', 'f': 'été'}, docs='documents')} SELECT {_HIT} FROM hits".replace("'été'", "'ete'"))
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, c, m = _indexed(spark, sf_dir, "documents")
    asked = _ask(spark, {"d": "the", "e": "los", "f": "été"})
    return search.search_batch(asked, index, c, m, with_excerpts=False).drop("timestamp").withColumn("score", F.round("score", 6))


@_query(f"WITH {_bm25_sql(MANY, limit=10)} SELECT {_HIT} FROM hits")
def search_saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m = archive(spark, sf_dir)
    root = scratch(spark)
    search.save(c, m.where("message_index % 2 = 0"), root)
    for _ in range(2):  # the second time appends nothing
        search.save(c, m, root, "append")
    return search.search_batch(_ask(spark, MANY), search.load(spark, root), c, m, 10, with_excerpts=False).drop("timestamp").withColumn("score", F.round("score", 6))


@_query()
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, c, m = _indexed(spark, sf_dir)
    return search.search_batch(_ask(spark, WORDS | PHRASE), index, c, m).select("query_id", "rank", "message_id", "excerpt")


#: What is asked for a title x: its first two words in quotes, itself, and itself with a word more in other quotes.
_ASKED = """'"' || split_part(x, ' ', 1) || ' ' || split_part(x, ' ', 2) || '" ' || x || ' ''' || x || ' once'''"""
_QUOTED = """regexp_extract_all(q, '"[^"]+"|''[^'']+''|[^\\s]+')"""


@_query(
    f"""WITH {archive_sql()}, q AS (SELECT id, {_ASKED} AS q FROM (SELECT id, replace(replace(title, '"', ''), '''', '') AS x FROM c)),
    raw AS (SELECT id, unnest({_QUOTED}) AS t, generate_subscripts({_QUOTED}, 1) AS i FROM q),
    bare AS (SELECT id, i, regexp_replace(regexp_replace(trim(regexp_replace(t, '^["'']|["'']$', '', 'g')), '^[^\\p{{L}}\\p{{N}}]+', ''), '[^\\p{{L}}\\p{{N}}]+$', '') AS t FROM raw),
    once AS (SELECT id, t, min(i) AS i FROM bare WHERE t <> '' GROUP BY id, t)
    SELECT id, string_agg(t, '|' ORDER BY length(t) DESC, i) AS terms FROM once GROUP BY id"""
)
def highlight_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of queries made of titles, with quoted parts, in their order."""
    x = F.replace(F.replace("title", F.lit('"'), F.lit("")), F.lit("'"), F.lit(""))
    words = F.concat(F.split_part(x, F.lit(" "), F.lit(1)), F.lit(" "), F.split_part(x, F.lit(" "), F.lit(2)))
    asked = F.concat(F.lit('"'), words, F.lit('" '), x, F.lit(" '"), x, F.lit(" once'"))
    return archive(spark, sf_dir)[0].select("id", F.array_join(T.highlight_terms(asked), "|").alias("terms"))


@_query(f"WITH {archive_sql()} SELECT m.id, regexp_replace(content, '(?i)(the|of)', '<mark>\\1</mark>', 'g') AS marked FROM m")
def mark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(spark, sf_dir)[1].select("id", T.mark_terms(F.col("content"), F.array(F.lit("the"), F.lit("of"))).alias("marked"))


@_query(f"WITH {_bm25_sql(WORDS, where="substr(created_at, 1, 10) <= '2024-01-03' AND created_at >= '2024-01-02'")} SELECT {_HIT} FROM hits")
def search_whole_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, WORDS, date_from="2024-01-02", date_to="2024-01-03", inclusive_day=True)


# Text helpers


def _replaced(text: str, *pairs: tuple[str, str]) -> str:
    """SQL that replaces patterns in turn, everywhere."""
    for pattern, by in pairs:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


def _balanced_sql(marker: str) -> str:
    return f"CASE WHEN (length(x) - length(replace(x, '{marker}', ''))) // {len(marker)} % 2 = 1 THEN replace(x, '{marker}', '') ELSE x END"


_CLEANED = _replaced("text", ("\uE200[^\uE201]*\uE201", ""), (r"\*\*\[([^\]]+)\]\*\*", r"**\\[\1\\]**"), (r"\s+---\s+", " · "), (r"(^|\r?\n)\s{0,3}#{1,6}\s+", r"\1"), (r"(\s)#{1,6}\s+", r"\1"))


@_query(
    f"""WITH a AS (SELECT doc_id, {_CLEANED} AS x FROM documents), b AS (SELECT doc_id, {_balanced_sql('**')} AS x FROM a), d AS (SELECT doc_id, {_balanced_sql('```')} AS x FROM b)
    SELECT doc_id, sha256({_balanced_sql('`')}) AS digest FROM d"""
)
def compact_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(T.compact_markdown(F.col("text")), 256).alias("digest"))


@_query(
    """WITH e AS (SELECT doc_id, text, replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') AS x FROM documents)
    SELECT doc_id, sha256(CASE WHEN text IS NULL THEN 'None' WHEN contains(text, chr(39)) AND NOT contains(text, '"') THEN '"' || x || '"' ELSE chr(39) || replace(x, chr(39), chr(92) || chr(39)) || chr(39) END) AS digest FROM e"""
)
def quoted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(T.quoted(F.col("text")), 256).alias("digest"))


_JOINED = _replaced("trim(lower(url))", (r"[^\p{L}\p{N}_\s-]", ""), (r"[\s_]+", "-"), ("-+", "-"))
_LAST = _replaced("regexp_extract(coalesce(url, 'upload'), '([^/]*)/*$', 1)", (r"[^\p{L}\p{N}._-]", "_"))


@_query(
    f"""SELECT page_id, coalesce(nullif(trim(substr({_JOINED}, 1, 60), '-'), ''), 'untitled') AS slug,
    coalesce(nullif({_replaced("trim(url)", (r'[<>:"/\\|?*\x00-\x1f]+', "-"))}, ''), 'report') AS file_name, coalesce(nullif({_LAST}, ''), 'upload') AS upload_name FROM pages"""
)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.slug(url).alias("slug"), T.safe_file_name(url).alias("file_name"), T.safe_upload_name(url).alias("upload_name"))


_HREF = 'href="([^"]*)"'


@_query(
    f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS link FROM pages)
    SELECT page_id, link, CASE WHEN regexp_matches(link, '^(#|/$|/[^/]|https?://|mailto:)') THEN link ELSE '' END AS safe FROM l"""
)
def safe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_HREF), 1)).alias("link"))
    return links.select("page_id", "link", T.safe_link(F.col("link")).alias("safe"))


@_query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS digest FROM documents")
def collapsed_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(T.collapse_spaces(F.col("text")), 256).alias("digest"))


@_query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars END AS n_chars FROM documents")
def json_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a generator gave as JSON, in a code fence, bare or broken off, read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = F.to_json(F.struct("lang", "n_chars", "text"))
    output = F.when(F.col("doc_id") % 5 == 0, F.expr("substring(body, 1, length(body) - 1)")).when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), F.col("body"), F.lit("\n```"))).otherwise(F.col("body"))
    read = docs.withColumn("body", body).select("doc_id", reports.parsed_json(output).alias("v"))
    return read.select("doc_id", F.try_variant_get("v", "$.lang", "string").alias("lang"), F.try_variant_get("v", "$.n_chars", "bigint").alias("n_chars"))


# Statistics and lookups


@_query(f"WITH {archive_sql()} SELECT count(*) AS total_conversations, coalesce(sum(raw_message_count), 0)::BIGINT AS total_messages, min(nullif(created_at, '')) AS first_date, max(nullif(created_at, '')) AS last_date FROM c")
def stats_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.totals(archive(spark, sf_dir)[0])


_BY_SOURCE = "SELECT source, count(DISTINCT c.id) AS conversations, count(m.id) AS messages FROM c LEFT JOIN m ON m.conversation_id = c.id GROUP BY source"


@_query(f"WITH {archive_sql()} {_BY_SOURCE}")
def stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_source(*archive(spark, sf_dir))


@_query(f"WITH {archive_sql()}, s AS ({_BY_SOURCE}) SELECT * FROM s UNION ALL SELECT NULL, sum(conversations)::BIGINT, sum(messages)::BIGINT FROM s")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.facets(*archive(spark, sf_dir))


@_query(f"WITH {archive_sql()} SELECT id, title, raw_message_count FROM c ORDER BY raw_message_count DESC, title, id LIMIT 5")
def stats_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.longest(archive(spark, sf_dir)[0]).select("id", "title", "raw_message_count")


@_query(f"WITH {archive_sql()} SELECT conversation_id, title, source, message_index, role, content FROM m JOIN c ON c.id = m.conversation_id WHERE c.conv_id = (SELECT max(conv_id) FROM c)")
def conversation_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m = archive(spark, sf_dir)
    last = c.orderBy(F.desc("conv_id")).select("id").first()[0]
    return stats.detail(c, m, last).drop("timestamp")


@_query(f"WITH {archive_sql()} SELECT m.id, t.message_index AS target_index FROM m AS t JOIN m ON m.conversation_id = t.conversation_id AND abs(m.message_index - t.message_index) <= 2")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = archive(spark, sf_dir)[1]
    return stats.context_window(m, m.select("conversation_id", "message_index")).select("id", "target_index")


# Ingest


#: Conversations of an export file, on average.
PER_FILE = 100


def _write_exports(spark: SparkSession, sf_dir: str) -> str:
    """Export files of the conversations table in a fresh shared folder's exports/a and exports/b, about PER_FILE conversations each, and a broken file for every conversation whose id ends in 0 in exports/broken; the folder."""
    c, m = archive(spark, sf_dir)
    tree, flat = exports_of(c, m)
    root = scratch(spark)
    tree.select(F.lit("a").alias("kind"), "id", "value").unionByName(flat.select(F.lit("b").alias("kind"), "id", "value")).write.parquet(f"{root}/made")
    made = spark.read.parquet(f"{root}/made")
    n = made.count() // (2 * PER_FILE) + 1
    lists = made.groupBy("kind", F.pmod(F.xxhash64("id"), F.lit(n)).alias("k")).agg(F.array_sort(F.collect_list("value")).alias("v"))
    # Layout B also has files of one conversation that is in no list.
    alone = (F.col("kind") == "b") & (F.size("v") == 1)
    files = lists.select("kind", F.concat(F.lit("part-"), F.col("k").cast("string"), F.lit(".json")).alias("file_name"), F.when(alone, F.col("v")[0]).otherwise(F.concat(F.lit("["), F.array_join("v", ","), F.lit("]"))).alias("markdown"))
    broken = made.where("id like '%0'").select("kind", F.concat("id", F.lit(".json")).alias("file_name"), F.expr("substring(value, 1, length(value) - 3)").alias("markdown"))
    for kind in ("a", "b"):
        export.write_files(files.where(F.col("kind") == kind), f"{root}/exports/{kind}")
        export.write_files(broken.where(F.col("kind") == kind), f"{root}/exports/broken/{kind}")
    return root


def _relative(files: DataFrame) -> DataFrame:
    return files.withColumn("source_path", F.regexp_replace("source_path", "^.*/exports/", ""))


def _export_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The export files as read_exports() reads them, with paths below exports/, and the folder."""
    root = _write_exports(spark, sf_dir)
    return _relative(read_exports(spark, f"{root}/exports")[0]), root


_COUNTS = f"WITH {archive_sql()}, k AS ({_KEPT}), n AS (SELECT count(DISTINCT conversation_id) AS cs, count(*) AS ms FROM k), b AS (SELECT count(*) AS bad FROM c WHERE id LIKE '%0')"


_INGESTED = f"WITH {archive_sql()}, k AS ({_KEPT}) SELECT conversation_id || ':' || message_index AS id, conversation_id, message_index, role, content, timestamp FROM k"


def _messages(conversations: DataFrame) -> DataFrame:
    return normalize.explode_messages(conversations).select("id", "conversation_id", "message_index", "role", "content", "timestamp")


@_query(_INGESTED)
def ingest_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _ = _export_files(spark, sf_dir)
    return _messages(normalize.normalize(files)[0])


@_query(_INGESTED)
def ingest_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ingest_messages with every file read by element, in ranges, as huge ones are."""
    root = _write_exports(spark, sf_dir)
    return _messages(normalize.normalize(read_exports(spark, f"{root}/exports", large=1)[0])[0])


@_query(_INGESTED)
def ingest_zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ingest_messages with the files in zip archives."""
    files, root = _export_files(spark, sf_dir)
    zipped(files, f"{root}/zips")
    return _messages(normalize.normalize(read_exports(spark, f"{root}/zips/*.zip")[0])[0])


@_query(f"WITH {archive_sql()}, k AS ({_KEPT}) SELECT c.id, source, title, created_at, CAST(count(*) AS INTEGER) AS raw_message_count FROM k JOIN c ON c.id = k.conversation_id GROUP BY ALL")
def ingest_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _ = _export_files(spark, sf_dir)
    return normalize.normalize(files)[0].select("id", "source", "title", "created_at", "raw_message_count")


@_query(f"WITH {archive_sql()} SELECT 'broken/' || CASE WHEN source = 'chatgpt' THEN 'a/' ELSE 'b/' END || id || '.json' AS source_path, 'not valid JSON' AS reason FROM c WHERE id LIKE '%0'")
def ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, _ = _export_files(spark, sf_dir)
    return normalize.normalize(files)[1]


@_query(f"WITH {_bm25_sql(WORDS | PHRASE, docs='kept')} SELECT {_HIT} FROM hits")
def search_after_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive is searched after each layout's files were imported, and those of the first again: imports keep its index."""
    files, root = _export_files(spark, sf_dir)
    of_a = F.regexp_replace("source_path", "^broken/", "").startswith("a/")
    for part in (of_a, ~of_a, of_a):
        store.ingest(spark, f"{root}/archive", files.where(part))
    c, m = store.read(spark, f"{root}/archive", "conversations"), store.read(spark, f"{root}/archive", "messages")
    return search.search_batch(_ask(spark, WORDS | PHRASE), search.load(spark, f"{root}/archive"), c, m, with_excerpts=False).drop("timestamp").withColumn("score", F.round("score", 6))


@_query(f"{_COUNTS} SELECT 1 AS run, cs AS parsed, cs AS inserted_conversations, ms AS inserted_messages, bad AS skipped FROM n, b UNION ALL SELECT 2, cs, 0, 0, bad FROM n, b")
def upsert_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, root = _export_files(spark, sf_dir)
    runs = [store.ingest(spark, f"{root}/archive", files).withColumn("run", F.lit(k)) for k in (1, 2)]
    return runs[0].unionByName(runs[1]).select("run", "parsed", "inserted_conversations", "inserted_messages", "skipped")


@_query(f"WITH {archive_sql()}, k AS ({_KEPT}) SELECT conversation_id || ':' || message_index AS id, role, content FROM k")
def ingest_stream_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _write_exports(spark, sf_dir)
    ingest_stream(spark, f"{root}/exports", f"{root}/streamed", f"{root}/cp").awaitTermination()
    return store.read(spark, f"{root}/streamed", "messages").select("id", "role", "content")


@_query(f"{_COUNTS} SELECT cs AS parsed, cs AS inserted_conversations, ms AS inserted_messages, bad AS skipped FROM n, b")
def import_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, root = _export_files(spark, sf_dir)
    of_a = F.regexp_replace("source_path", "^broken/", "").startswith("a/")
    both = [store.ingest(spark, f"{root}/archive", files.where(part)) for part in (of_a, ~of_a)]
    return store.merge_summaries(both[0].unionByName(both[1])).select("parsed", "inserted_conversations", "inserted_messages", "skipped")


@_query(f"WITH {archive_sql()}, a AS (SELECT id FROM c WHERE conv_id % 4 < 2), b AS (SELECT id FROM c WHERE conv_id % 4 IN (1, 2)) (SELECT id FROM a EXCEPT SELECT id FROM b) UNION (SELECT id FROM b EXCEPT SELECT id FROM a)")
def selection_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = archive(spark, sf_dir)[0]
    return store.selection_toggle(c.where("conv_id % 4 < 2"), c.where("conv_id % 4 in (1, 2)"))


# Reports

_SELECT = "SELECT conv_id // 4 AS report_id, CAST(row_number() OVER (PARTITION BY conv_id // 4 ORDER BY conv_id) - 1 AS INTEGER) AS ord, id AS conversation_id, conv_id FROM c"


def _selected(conversations: DataFrame) -> DataFrame:
    key = F.floor(F.col("conv_id") / 4)
    return conversations.select(key.alias("report_id"), (F.row_number().over(Window.partitionBy(key).orderBy("conv_id")) - 1).alias("ord"), F.col("id").alias("conversation_id"))


def _inputs(spark: SparkSession, sf_dir: str, long: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    c, m = archive(spark, sf_dir, korean=True, long=long)
    chosen = _selected(c)
    return c, m, chosen, reports.inputs(chosen, c, m)


_VOTE = """v AS (
      SELECT report_id, sum(h) AS hangul, sum(l) AS latin FROM (
        SELECT report_id, len(regexp_extract_all(content, '[가-힣]')) AS h, len(regexp_extract_all(content, '[A-Za-z]')) AS l FROM s JOIN m USING (conversation_id)
        UNION ALL SELECT report_id, len(regexp_extract_all(title, '[가-힣]')), len(regexp_extract_all(title, '[A-Za-z]')) FROM s JOIN c ON c.id = s.conversation_id) GROUP BY report_id
    )"""


@_query(f"WITH {archive_sql(True)}, s AS ({_SELECT}), {_VOTE} SELECT report_id, hangul::BIGINT AS hangul, latin::BIGINT AS latin, CASE WHEN hangul > 0 AND hangul >= latin * 0.35 THEN 'ko' ELSE 'en' END AS language FROM v")
def language_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.languages(_inputs(spark, sf_dir)[3])


_COMPACT = "regexp_replace(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"
_SHORT = f"CASE WHEN length({_COMPACT}) > 12000 THEN substr({_COMPACT}, 1, 8000) || chr(10) || chr(10) || '[...middle of long message omitted for a faster focused synthesis...]' || chr(10) || chr(10) || right({_COMPACT}, 4000) ELSE {_COMPACT} END"


@_query(f"WITH {archive_sql()} SELECT id, sha256(x) AS digest, length(x) AS n FROM (SELECT id, {_SHORT} AS x FROM (SELECT id, repeat(content || chr(10) || chr(10) || chr(10) || chr(10), 1 + (conv_id % 7) * 10) AS content FROM m))")
def compact_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = archive(spark, sf_dir)[1].withColumn("content", F.expr("repeat(concat(content, '\\n\\n\\n\\n'), cast(1 + (conv_id % 7) * 10 as int))"))
    x = reports.compact_message(F.col("content"))
    return m.select("id", F.sha2(x, 256).alias("digest"), F.length(x).cast("long").alias("n"))


_DOCS = f"""docs AS (
      SELECT report_id, ord, c.id AS conversation_id, '<conversation id="' || c.id || '" source="' || source || '">' || chr(10) || 'Title: ' || title || chr(10) || 'Created: ' || created_at || chr(10) || chr(10)
        || string_agg('<message index="' || message_index || '" role="' || role || '">' || chr(10) || 'Source reference: [' || c.id || '#m' || message_index || ']' || chr(10) || {_SHORT} || chr(10) || '</message>' || chr(10) || chr(10), '' ORDER BY message_index)
        || '</conversation>' AS document
      FROM s JOIN c ON c.id = s.conversation_id JOIN m USING (conversation_id) GROUP BY report_id, ord, c.id, source, title, created_at
    )"""


@_query(f"WITH {archive_sql(True)}, s AS ({_SELECT}), {_DOCS} SELECT report_id, ord, sha256(document) AS digest, length(document) AS n FROM docs")
def format_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.documents(_inputs(spark, sf_dir)[3]).select("report_id", "ord", F.sha2("document", 256).alias("digest"), F.length("document").cast("long").alias("n"))


def _next_fit_sql(name: str, extra: int, most: int = 10_000) -> str:
    """The table `name` (g, k, n) of sizes in order, k from 1, walked one item of each group after another: `name`_at has the slot of each."""
    over, full = f"n > {most}", f"open AND filled + n + {extra} > {most}"
    return f"""{name}_at AS (
      SELECT g, 0::BIGINT AS k, 0::BIGINT AS at_slot, 0::BIGINT AS slot, 0::BIGINT AS filled, false AS open FROM (SELECT DISTINCT g FROM {name})
      UNION ALL SELECT w.g, w.k + 1, slot + CASE WHEN {over} THEN open::BIGINT WHEN {full} THEN 1 ELSE 0 END,
        slot + CASE WHEN {over} THEN open::BIGINT + (n + {most - 1}) // {most} WHEN {full} THEN 1 ELSE 0 END,
        CASE WHEN {over} THEN 0 WHEN {full} THEN n + {extra} ELSE filled + n + {extra} END, n <= {most}
      FROM {name}_at AS w JOIN {name} AS x ON x.g = w.g AND x.k = w.k + 1
    )"""


def _chunks_sql(long: bool = False) -> str:
    return f"""WITH RECURSIVE {archive_sql(True, long)}, s AS ({_SELECT}), {_DOCS},
    f AS MATERIALIZED (SELECT report_id AS g, row_number() OVER (PARTITION BY report_id ORDER BY ord) AS k, length(document) AS n, ord, document FROM docs), {_next_fit_sql("f", 0)},
    lines AS MATERIALIZED (SELECT g || '/' || ord AS g, g AS report_id, ord, unnest(range(1, len(bs) + 1)) AS k, unnest(bs) AS b FROM (SELECT *, string_split(document, chr(10) || chr(10)) AS bs FROM f WHERE n > 10000)),
    e AS MATERIALIZED (SELECT *, length(b) AS n FROM lines), {_next_fit_sql("e", 2)},
    parts AS (
      SELECT g AS report_id, at_slot AS slot, 0 AS piece, ord, 0 AS pos, document AS part FROM f JOIN f_at USING (g, k) WHERE n <= 10000
      UNION ALL SELECT e.report_id, f_at.at_slot, e_at.at_slot + i, e.ord, e.k, substr(b, i * 10000 + 1, 10000)
      FROM (SELECT *, unnest(range(0, greatest(1, (n + 9999) // 10000))) AS i FROM e) AS e JOIN e_at USING (g, k) JOIN f ON f.g = e.report_id AND f.ord = e.ord JOIN f_at ON f_at.g = f.g AND f_at.k = f.k
    ), texts AS (SELECT report_id, slot, piece, string_agg(part, chr(10) || chr(10) ORDER BY ord, pos) AS text FROM parts GROUP BY ALL),
    chunks AS (SELECT report_id, CAST(row_number() OVER (PARTITION BY report_id ORDER BY slot, piece) AS INTEGER) AS chunk, count(*) OVER (PARTITION BY report_id) AS n_chunks, text FROM texts)"""


_CHUNKS = _chunks_sql()
_PACKED = "SELECT report_id, chunk, n_chunks, CAST(length(text) AS INTEGER) AS n, sha256(text) AS digest FROM chunks"


@_query(f"{_CHUNKS} {_PACKED}")
def pack_chunks(spark: SparkSession, sf_dir: str, long: bool = False) -> DataFrame:
    packed = reports.pack_chunks(reports.documents(_inputs(spark, sf_dir, long)[3]), 10_000)
    return packed.select("report_id", "chunk", "n_chunks", F.length("text").alias("n"), F.sha2("text", 256).alias("digest"))


@_query(f"{_chunks_sql(True)} {_PACKED}")
def pack_long_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_chunks of texts of which many are over the limits of a message and of a chunk."""
    return pack_chunks(spark, sf_dir, long=True)


_LANGUAGE = "l AS (SELECT report_id, CASE WHEN hangul > 0 AND hangul >= latin * 0.35 THEN 'ko' ELSE 'en' END AS language FROM v)"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _said_sql() -> str:
    """Rows (language, system, whole, part) of what prompts say."""
    rows = [(k, reports.ROLE + reports.LANGUAGES[k] + ". Its H2 sections are exactly:\n" + "\n".join(f"## {x}" for x in names) + reports.RULES, reports.ASK_WHOLE[k], reports.ASK_PART[k]) for k, names in reports.SECTIONS.items()]
    return ", ".join(f"({', '.join(map(_quote, r))})" for r in rows)


@_query(
    f"""{_CHUNKS}, {_VOTE}, {_LANGUAGE}, t(language, system, whole, part) AS (VALUES {_said_sql()})
    SELECT report_id, chunk, n_chunks, language, sha256(system || CASE WHEN n_chunks = 1 THEN whole ELSE 'Source group ' || chunk || ' of ' || n_chunks || '. ' || part END || text || chr(10)) AS digest,
      CASE WHEN n_chunks = 1 THEN 3200 ELSE 1800 END AS max_tokens FROM chunks JOIN l USING (report_id) JOIN t USING (language)"""
)
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _inputs(spark, sf_dir)[3]
    made = reports.chunk_prompts(reports.pack_chunks(reports.documents(rows), 10_000), reports.languages(rows))
    return made.select("report_id", "chunk", "n_chunks", "language", F.sha2(F.concat("system", "prompt"), 256).alias("digest"), "max_tokens")


@_query(
    f"""{_CHUNKS}, n AS (SELECT report_id, count(DISTINCT ord) AS source_count, sum(length(content))::BIGINT AS source_chars FROM s JOIN m USING (conversation_id) GROUP BY report_id)
    SELECT report_id, source_count, count(*) AS chunk_count, source_chars, sum(length(text))::BIGINT AS context_chars, CASE WHEN count(*) = 1 THEN 1 ELSE count(*) + 1 END AS calls FROM chunks JOIN n USING (report_id) GROUP BY report_id, source_count, source_chars"""
)
def report_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _inputs(spark, sf_dir)[3]
    return reports.measures(rows, reports.pack_chunks(reports.documents(rows), 10_000))


def _stub(rows: pd.DataFrame) -> pd.Series:
    """A deterministic generator: the citations of a prompt, in order, under one heading."""
    found = rows["prompt"].str.findall(r"\[[0-9a-f]{16}#m\d+\]")
    return "## Overview\n\n" + found.map(lambda x: " ".join(dict.fromkeys(x)))


@_query(
    f"""{_CHUNKS}, {_VOTE}, {_LANGUAGE}, t(language, system, whole, part) AS (VALUES {_said_sql()}), lead(language, lead) AS (VALUES {", ".join(f"('{k}', {_quote(v)})" for k, v in reports.ASK_MERGE.items())}),
    cites AS (SELECT report_id, chunk, n_chunks, unnest(x) AS cite, generate_subscripts(x, 1) AS i FROM (SELECT *, regexp_extract_all(text, '\\[[0-9a-f]{{16}}#m\\d+\\]') AS x FROM chunks WHERE n_chunks > 1)),
    once AS (SELECT report_id, chunk, n_chunks, cite, min(i) AS i FROM cites GROUP BY ALL),
    outs AS (SELECT report_id, n_chunks, chunk, '## Overview' || chr(10) || chr(10) || coalesce(string_agg(cite, ' ' ORDER BY i), '') AS o FROM (SELECT report_id, chunk, n_chunks FROM chunks WHERE n_chunks > 1) LEFT JOIN once USING (report_id, chunk, n_chunks) GROUP BY ALL),
    notes AS (SELECT report_id, CAST(n_chunks AS INTEGER) AS n_chunks, string_agg(o, {_quote(reports.BETWEEN)} ORDER BY chunk) AS notes FROM outs GROUP BY ALL)
    SELECT report_id, n_chunks, language, sha256(system || lead || notes || chr(10)) AS digest, {reports.REPORT_TOKENS} AS max_tokens FROM notes JOIN l USING (report_id) JOIN t USING (language) JOIN lead USING (language)"""
)
def merge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _inputs(spark, sf_dir)[3]
    asked = reports.chunk_prompts(reports.pack_chunks(reports.documents(rows), 10_000), reports.languages(rows))
    made = reports.merge_prompts(reports.generate(asked.where("n_chunks > 1"), _stub, store=f"{scratch(spark)}/outputs"))
    return made.select("report_id", "n_chunks", "language", F.sha2(F.concat("system", "prompt"), 256).alias("digest"), "max_tokens")


def _reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, m, chosen, _ = _inputs(spark, sf_dir)
    return c, m, reports.build_reports(chosen, c, m, _stub, scratch(spark), 10_000, provider="stub", model="echo", created_at="2024-06-01T00:00:00+00:00")


_CITED = f"WITH {archive_sql(True)}, s AS ({_SELECT})"


_ADDED = ", ".join(f"('{k}', {_quote(chr(10).join(f'{chr(10)}## {x}{chr(10)}{chr(10)}{reports.FALLBACK[k]}' for x in names if x != 'Overview'))})" for k, names in reports.SECTIONS.items())


_MADE = f"""{_CITED}, {_VOTE}, {_LANGUAGE}, a(language, added) AS (VALUES {_ADDED}), r AS (SELECT report_id, '[' || string_agg('"' || conversation_id || '"', ',' ORDER BY ord) || ']' AS selected FROM s GROUP BY report_id),
    q AS (SELECT report_id, '## Overview' || chr(10) || chr(10) || string_agg('[' || conversation_id || '#m' || message_index || ']', ' ' ORDER BY ord, message_index) AS found FROM s JOIN m USING (conversation_id) GROUP BY report_id),
    texts AS (SELECT report_id, 'Report ' || report_id AS title, selected, found || chr(10) || added || chr(10) AS markdown FROM q JOIN r USING (report_id) JOIN l USING (report_id) JOIN a USING (language)),
    made AS (SELECT *, substr(sha256(selected || chr(0) || 'stub' || chr(0) || 'echo' || chr(0) || '2024-06-01T00:00:00+00:00' || chr(0) || title || chr(0) || sha256(markdown)), 1, 32) AS id FROM texts)"""


@_query(f"{_MADE} SELECT title, selected, sha256(markdown) AS digest, CAST(length(markdown) AS INTEGER) AS n FROM made")
def map_merge_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir)[2].select("title", F.to_json("selected_conversation_ids").alias("selected"), F.sha2("markdown", 256).alias("digest"), F.length("markdown").alias("n"))


@_query(f"{_MADE} SELECT id, title, selected FROM made ORDER BY id LIMIT 5")
def reports_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(_reports(spark, sf_dir)[2], n=5).select("id", "title", F.to_json("selected_conversation_ids").alias("selected"))


@_query(f"{_MADE} SELECT id, title, selected, 'stub' AS provider, 'echo' AS model, strftime(TIMESTAMP '2024-01-01' + report_id % 50 * INTERVAL 1 DAY, '%Y-%m-%d') AS created_at FROM made")
def reports_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports saved twice, read back and listed without their text; each has a date of its own."""
    made = _reports(spark, sf_dir)[2]
    number = F.element_at(F.split("title", " "), -1).cast("int")
    dated = made.withColumn("created_at", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), number % 50), "yyyy-MM-dd"))
    root = scratch(spark)
    for _ in range(2):
        store.save_reports(dated, root)
    return reports.summaries(store.latest(store.read(spark, root, "insight_reports"))).withColumn("selected", F.to_json("selected_conversation_ids")).drop("selected_conversation_ids")


@_query(f"WITH {archive_sql()}, r AS (SELECT report_id, max(conv_id) AS top FROM (SELECT conv_id // 4 AS report_id, conv_id FROM c) GROUP BY report_id) SELECT report_id, strftime(TIMESTAMP '2024-01-01' + report_id * 7 % 50 * INTERVAL 1 DAY, '%Y-%m-%d') AS created_at FROM r ORDER BY created_at DESC, CAST(report_id AS VARCHAR) LIMIT 5")
def reports_newest_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest of reports with different dates; ids of reports are their numbers here."""
    c, _ = archive(spark, sf_dir)
    number = F.floor(F.col("conv_id") / 4)
    made = c.select(number.alias("report_id")).distinct().select("report_id", F.col("report_id").cast("string").alias("id"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("report_id") * 7 % 50).cast("int")), "yyyy-MM-dd").alias("created_at"))
    return store.latest(made, n=5).select("report_id", "created_at")


@_query(f"{_CITED} SELECT report_id, m.id AS message_id FROM s JOIN m USING (conversation_id)")
def citations_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, m, made = _reports(spark, sf_dir)
    named = made.withColumn("id", F.element_at(F.split("title", " "), -1).cast("long"))
    return stats.cited_messages(named, m).select("report_id", "message_id")


@_query(f"{_CITED} SELECT report_id, ord, c.id AS conversation_id, title, source FROM s JOIN c ON c.id = s.conversation_id")
def report_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _, made = _reports(spark, sf_dir)
    named = made.withColumn("id", F.element_at(F.split("title", " "), -1).cast("long"))
    return stats.report_sources(named, c).select("report_id", "ord", "conversation_id", "title", "source")


_HEADINGS = ", ".join(f"('{code}', {k + (code == 'ko')}, '{name}')" for code, names in reports.SECTIONS.items() for k, name in enumerate(names)) + ", ('ko', 0, 'Overview')"


@_query(
    f"""{_CITED}, {_VOTE}, {_LANGUAGE}, h(language, place, text) AS (VALUES {_HEADINGS})
    SELECT report_id, CAST(4 * place AS INTEGER) AS line, 2 AS level, text, regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-|-$', '', 'g') AS heading_id FROM l JOIN h USING (language)"""
)
def report_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _reports(spark, sf_dir)[2].withColumn("id", F.element_at(F.split("title", " "), -1).cast("long"))
    return reports.outline(made)


@_query(f"WITH {archive_sql()}, s AS (SELECT conv_id AS report_id, 0 AS ord, id || 'x' AS conversation_id FROM c WHERE conv_id % 3 = 0) SELECT report_id, conversation_id AS missing FROM s")
def missing_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _ = archive(spark, sf_dir)
    x = F.when(F.col("conv_id") % 3 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id"))
    chosen = reports.selections(c.select(F.col("conv_id").alias("report_id"), F.array(x, x).alias("selected_conversation_ids")))
    return reports.missing(chosen, c).select("report_id", F.array_join("missing", ",").alias("missing"))


# Exports

_MD = """'---' || chr(10) || 'type: source-conversation' || chr(10) || 'conversation_id: ' || c.id || chr(10) || 'source: ' || source || chr(10) || 'title: ''' || title || '''' || chr(10) || 'created_at: ''' || created_at || '''' || chr(10)
  || 'updated_at: None' || chr(10) || 'raw_message_count: ' || raw_message_count || chr(10) || 'source_path: ''conv/' || c.conv_id || '''' || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10)
  || '- Conversation ID: `' || c.id || '`' || chr(10) || '- Source: `' || source || '`' || chr(10) || '- Created: `' || created_at || '`' || chr(10) || chr(10) || '## Messages' || chr(10) || chr(10)
  || string_agg('### [' || message_index || '] ' || role || chr(10) || chr(10) || '> Source: `' || c.id || '` message `' || message_index || '`' || chr(10) || chr(10) || content || chr(10), chr(10) ORDER BY message_index)"""


@_query(
    f"""WITH {archive_sql()} SELECT id, id || '-' || coalesce(nullif(trim(substr(regexp_replace(regexp_replace(regexp_replace(trim(lower(title)), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '-+', '-', 'g'), 1, 60), '-'), ''), 'untitled') || '.md' AS file_name,
    sha256(regexp_replace(md, '\\s+$', '') || chr(10)) AS digest FROM (SELECT c.id, title, {_MD} AS md FROM c JOIN m ON m.conversation_id = c.id GROUP BY c.id, source, title, created_at, raw_message_count, c.conv_id)"""
)
def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.conversation_markdown(*archive(spark, sf_dir)).select("id", "file_name", F.sha2("markdown", 256).alias("digest"))


_SLUG = "coalesce(nullif(trim(substr(regexp_replace(regexp_replace(regexp_replace(trim(lower({0})), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '-+', '-', 'g'), 1, 60), '-'), ''), 'untitled')"


@_query(
    f"""WITH {_bm25_sql(WORDS | PHRASE, limit=50)}, asked(query_id, query) AS (VALUES {", ".join(f"({_quote(k)}, {_quote(q)})" for k, q in (WORDS | PHRASE).items())}),
    blocks AS (
      SELECT query_id, count(*) AS n, string_agg('## ' || rank || '. ' || title || chr(10) || chr(10) || '- Conversation ID: `' || conversation_id || '`' || chr(10) || '- Message ID: `' || message_id || '`' || chr(10)
        || '- Message index: `' || message_index || '`' || chr(10) || '- Source: `' || source || '`' || chr(10) || '- Role: `' || role || '`' || chr(10) || chr(10) || '(excerpt)' || chr(10) || chr(10), '' ORDER BY rank) AS body FROM hits GROUP BY query_id
    )
    SELECT query_id, 'search-' || {_SLUG.format('query')} || '.md' AS file_name,
      regexp_replace('---' || chr(10) || 'type: search-dossier' || chr(10) || 'query: ''' || query || '''' || chr(10) || 'result_count: ' || coalesce(n, 0) || chr(10) || '---' || chr(10) || chr(10) || '# Search Dossier: ' || query || chr(10) || chr(10) || coalesce(body, ''), '\\s+$', '') || chr(10) AS markdown
    FROM asked LEFT JOIN blocks USING (query_id)"""
)
def export_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dossiers of searches; a word stands for each excerpt, which it takes FTS5 to test."""
    index, c, m = _indexed(spark, sf_dir)
    asked = _ask(spark, WORDS | PHRASE)
    hits = search.search_batch(asked, index, c, m, 50)
    made = export.search_dossier(asked, hits.withColumn("excerpt", F.concat(F.lit("\x01"), "excerpt", F.lit("\x02"))))
    return made.withColumn("markdown", F.regexp_replace("markdown", "(?s)\x01.*?\x02", "(excerpt)"))


__all__ = ["ingest_stream", "oracle_sql", "queries"]
