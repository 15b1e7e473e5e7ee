"""The queries op1 to op13 over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm import bpe, collocations, embedding_dedup, html_extraction, importance, jaccard_join, language_id, packing, quality_rules, records, token_counts, url_filters, warc

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The rules of the url query: host/path and what it does.
URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "n_template", "by_induction")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def url_filters_with_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 where each page redirects to the one of the same seven with the least id, as the pages themselves hold no links."""
    pages = _table(spark, sf_dir, "pages")
    to = pages.select((F.col("page_id")).alias("_first"), F.col("url").alias("to_url"))
    redirects = pages.select(F.col("url").alias("from_url"), (F.col("page_id") - F.col("page_id") % 7).alias("_first")).join(to.hint("merge"), "_first")
    return url_filters.filter_urls(pages, URL_RULES, redirects=redirects)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses_of_pages(_table(spark, sf_dir, "pages")))
    return made.select(
        F.col("source_id").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri", "content_type", "payload_digest", "block_digest", "content_length", F.sha2("text", 256).alias("text_sha256"),
        F.octet_length("record").alias("record_length"), F.sha2("record", 256).alias("record_sha256"),
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_html_extraction, op2_token_counts, op3_packing, op4_url_filters, op5_language_id, op6_quality_rules, op7_jaccard_join, op8_bpe, op9_embedding_dedup, op10_warc, op11_importance_resampling, op12_collocations, op13_token_records, url_filters_with_redirects, pipeline)
    return {f.__name__: f for f in own}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _url_sql(more: str = "") -> str:
    ordered = sorted(URL_RULES, key=lambda r: -len(r[0]))

    def rule(host: str, path: str) -> str:
        return "CASE " + " ".join(f"WHEN ({host} = '{t}' OR ends_with({host}, '.{t}')) AND starts_with({path}, '/{p}') THEN '{r}'" for r, _ in ordered for t, _, p in [r.partition("/")]) + " END"

    action = "CASE " + " ".join(f"WHEN {{0}} = '{r}' THEN '{a}'" for r, a in URL_RULES) + " END"
    host = "translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path, node = "regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)", "regexp_extract({0}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    href, to = """regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)""", """regexp_extract(tag, '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1)"""
    return f"""
    WITH RECURSIVE p AS (
      SELECT page_id, url, html, coalesce({host.format('url')}, '') AS host, coalesce({path.format('url')}, '') AS path, {node.format('url')} AS rest FROM pages
    ), tags AS (
      SELECT url, host, path, rest, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?(?:-->|\\z)', ' ', 'g'), '(?is)(<(?:link|meta)\\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>)', 1)) AS tag FROM p
      WHERE host <> '' AND regexp_matches(html, '(?i)canonical|http-equiv')
    ), named AS (
      SELECT host || rest AS a, host, path, replace(CASE WHEN regexp_matches(tag, {_quoted(url_filters.CANONICAL)}) THEN {href}
        WHEN regexp_matches(tag, '(?is)^<meta\\b.*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b') THEN {to} END, '&amp;', '&') AS t FROM tags
    ), urls AS (
      SELECT a, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'x:' || t WHEN starts_with(t, '/') THEN 'x://' || host || t
        ELSE 'x://' || host || coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || t END AS u FROM named WHERE t <> ''
    ), edges AS (
      SELECT a, h || CASE WHEN h = '' OR p = '' THEN p ELSE list_reduce(string_split(p, '/'), lambda done, x: CASE x WHEN '.' THEN done WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || x END)
          || CASE WHEN regexp_matches(p, '/\\.\\.?$') THEN '/' ELSE '' END END || q AS b
      FROM (SELECT a, {host.format('u')} AS h, {path.format('u')} AS p, regexp_extract(u, '(?s)^.*?://[^/?#]*[^?#]*([^#]*)', 1) AS q FROM urls) WHERE h <> '' {more}
    ), sides AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
    reach(a, b) AS (SELECT a, a FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
    acts AS (
      SELECT a, {action.format('r')} AS act FROM (SELECT a, {rule("hh", "pp")} AS r FROM (SELECT a, {host.format("'x://' || b")} AS hh, {path.format("'x://' || b")} AS pp FROM reach))
    ), blocked AS (SELECT a FROM acts GROUP BY a HAVING count(*) FILTER (act = 'block') > 0 AND count(*) FILTER (act = 'allow') = 0),
    ruled AS (SELECT *, {rule('host', 'path')} AS rule FROM p)
    SELECT page_id, host, path, rule, coalesce({action.format('rule')}, CASE WHEN host <> '' AND host || rest IN (SELECT a FROM blocked) THEN 'block' END, 'allow') AS verdict FROM ruled
    """


def _quality_sql() -> str:
    q = quality_rules
    word, symbol = "'[^\\x20\\x09-\\x0D]+'", "'[#*$%&|<>]'"
    separators = ", ".join(_quoted(x) for x in sorted(q.SEPARATORS))
    phrases = " OR ".join(f"contains(lower(line), {_quoted(x)})" for x in q.BOILERPLATE)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {word}) AS w FROM documents),
    spots AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM d),
    windows AS (
      SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {q.WINDOW - 1} FOLLOWING) AS win FROM spots QUALIFY i <= n - {q.WINDOW}
    ), twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) > 1 AS again FROM windows),
    marks AS (
      SELECT s.doc_id, s.i, coalesce(bool_or(t.again) OVER (PARTITION BY s.doc_id ORDER BY s.i ROWS BETWEEN {q.WINDOW - 1} PRECEDING AND CURRENT ROW), false) AS hit
      FROM spots s LEFT JOIN twice t ON s.doc_id = t.doc_id AND s.i = t.i
    ), repeats AS (SELECT doc_id, count(*) FILTER (hit) AS n_repeat_words FROM marks GROUP BY doc_id),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM d),
    worded AS (SELECT doc_id, line, k, regexp_extract_all(line, {word}) AS w, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS dup FROM lines WHERE regexp_matches(line, {word})),
    shaped AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS pos, len(w) <= {q.MENU_WORDS} AND NOT contains({_quoted(q.ENDS)}, right(w[-1], 1)) AS short FROM worded),
    islands AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, short ORDER BY k) AS island FROM shaped),
    menus AS (SELECT *, short AND count(*) OVER (PARTITION BY doc_id, short, island) >= {q.MENU_LINES} AS menu FROM islands),
    judged AS (
      SELECT doc_id, len(w) AS n, dup, dup OR menu
        OR len(regexp_extract_all(line, {symbol})) >= {q.SYMBOL_RATE} * len(w)
        OR (len(regexp_extract_all(line, '[A-ZÀ-ÖØ-Þ]')) >= {q.CAPITAL_LETTERS} AND len(regexp_extract_all(line, '[A-ZÀ-ÖØ-Þ]')) >= {q.CAPITAL_SHARE} * len(regexp_extract_all(line, '[A-ZÀ-ÖØ-Þa-zß-öø-ÿ]')))
        OR (len(w) < {q.SHORT_LINE} AND ({phrases}))
        OR (len(w) >= {q.STUTTER_WORDS} AND len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) >= {q.STUTTER_SHARE} * len(w))
        OR (len(list_filter(w, lambda x: list_contains([{separators}], x))) > 0 AND len(list_filter(w, lambda x: list_contains([{separators}], x))) >= {q.SEPARATOR_RATE} * len(w)) AS fails
      FROM menus
    ), by_doc AS (SELECT doc_id, count(*) FILTER (dup) AS n_dup_lines, coalesce(sum(n) FILTER (NOT fails), 0) AS kept_words FROM judged GROUP BY doc_id),
    base AS (
      SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, {symbol})) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(kept_words, 0) AS BIGINT) AS kept_words
      FROM d LEFT JOIN repeats USING (doc_id) LEFT JOIN by_doc USING (doc_id)
    ), verdict AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND kept_words >= {q.KEPT_SHARE} * n_words AS kept, kept_words FROM verdict
    """


JACCARD_SQL = r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    grams AS (
      SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
    ), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM pairs JOIN sizes s ON a = s.doc_id JOIN sizes t ON b = t.doc_id WHERE 5 * c >= 4 * (s.n + t.n - c)),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    least AS (SELECT a, min(b) AS m FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT doc_id, coalesce(least(m, doc_id), doc_id) AS class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(least(m, doc_id), doc_id) = doc_id AS kept
    FROM d LEFT JOIN least ON doc_id = least.a LEFT JOIN degree ON doc_id = degree.a
    """

EMBEDDING_SQL = """
    WITH RECURSIVE v AS (
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS r FROM v),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.r * y.r) >= 0.9),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    least AS (SELECT a, min(b) AS m FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(least(m, vec_id), vec_id) AS component_id, coalesce(least(m, vec_id), vec_id) = vec_id AS kept
    FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN degree ON vec_id = degree.a
    """


def _importance_sql() -> str:
    m = importance
    b, grams = m.BUCKETS, " UNION ALL ".join(f"SELECT src, id, array_to_string(w[i : i + {k}], ' ') AS g FROM (SELECT src, id, w, unnest(range(1, len(w) - {k - 1})) AS i FROM d)" for k in range(m.MAX_WORDS))
    return f"""
    WITH tab AS (
      SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))
    ), texts AS (SELECT 0 AS src, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
    d AS (SELECT src, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
    grams AS ({grams}), each AS (SELECT src, id, g, count(*) AS n FROM grams GROUP BY ALL),
    codes AS (
      SELECT g, xor(list_reduce([4294967295] || list_transform(range(octet_length(encode(g))), lambda k: CAST('0x' || substr(hex(g), 2 * k + 1, 2) AS BIGINT)), lambda c, x: xor(t[CAST(xor(c, x) & 255 AS INTEGER) + 1], c >> 8)), 4294967295) % {b} AS bucket
      FROM (SELECT DISTINCT g FROM each), tab
    ), coded AS (SELECT src, id, bucket, n FROM each JOIN codes USING (g)),
    counts AS (SELECT bucket, sum(n) FILTER (src = 0) AS s, sum(n) FILTER (src = 1) AS t FROM coded GROUP BY bucket),
    totals AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s_all, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t_all FROM counts),
    gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + {b}) / ((coalesce(s, 0) + 1.0::DOUBLE) * (t_all + {b})))) AS BIGINT) AS gain FROM counts, totals),
    sums AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM coded JOIN gains USING (bucket) WHERE src = 0 GROUP BY id),
    scored AS (
      SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{m.SEED}:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
      FROM d LEFT JOIN sums USING (id) WHERE src = 0
    ), drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= {m.MIN_WORDS})
    SELECT doc_id, n_words, n_features, weight, score, rank FROM scored LEFT JOIN (SELECT doc_id, rank FROM drawn WHERE rank <= {m.PERCENT} * n // 100) USING (doc_id)
    """


def _collocation_sql() -> str:
    c = collocations
    return f"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents
    ), sizes AS (SELECT lang, w, unnest(range(1, {c.MAX_WORDS} + 1)) AS k FROM pieces WHERE len(w) > 0),
    grams AS (SELECT lang, k, w[i : i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sizes)),
    f AS (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {c.MIN_COUNT}),
    totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
    cuts AS (SELECT lang, k, g, a, unnest(range(1, k)) AS cut FROM f),
    scored AS (
      SELECT c.lang, c.k, c.g, c.a, n, x.a AS l, y.a AS r, CAST(1000::HUGEINT * c.a * n // (x.a::HUGEINT * y.a) AS BIGINT) AS score, cut
      FROM cuts c JOIN totals USING (lang) JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : cut] JOIN f y ON y.lang = c.lang AND y.g = c.g[cut + 1 :]
    ), least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
    inside AS (
      SELECT lang, sub, max(a) AS most FROM (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: g[i : i + m - 1])))) AS sub FROM f WHERE k > 2) GROUP BY ALL
    ), ordered AS (
      SELECT least.lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score, row_number() OVER (PARTITION BY least.lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
      FROM least LEFT JOIN inside ON inside.lang = least.lang AND inside.sub = g WHERE most IS NULL OR 100 * most < {c.SUBSUMED} * a
    )
    SELECT lang, rank, phrase, a, l, r, n, score FROM ordered WHERE rank <= {c.TOP}
    """


def oracle_sql() -> dict[str, str]:
    redirects = "UNION SELECT x.host || x.rest, y.host || y.rest FROM p x JOIN p y ON y.page_id = x.page_id - x.page_id % 7 WHERE x.host <> '' AND y.host <> ''"
    return {"op4_url_filters": _url_sql(), "url_filters_with_redirects": _url_sql(redirects), "op6_quality_rules": _quality_sql(), "op7_jaccard_join": JACCARD_SQL, "op9_embedding_dedup": EMBEDDING_SQL, "op11_importance_resampling": _importance_sql(), "op12_collocations": _collocation_sql()}
