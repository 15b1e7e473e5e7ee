"""Verdicts on urls by host and path rules, carried over redirects and canonical links. DataFrame operations only.

Urls that redirect to each other, or name each other as canonical, are aliases: the connected components of those edges. A url
that no rule fits takes the verdict of its aliases: blocked if a rule blocks one of them and no rule explicitly allows any.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import LARGE, cut, join_hot
from chatlake.llm.components import connected_components

#: Rules that are tried one by one on each url; a longer list, or a table of rules, is joined.
MAX_RULES = 100
#: A link tag one of whose rel words is canonical.
CANONICAL = r"""(?is)^<link\b.*\srel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s/>])"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case; '' for null or where there is no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; '' for null or where there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A url's identity among aliases: host, path and query without scheme and fragment; null where there is no host."""
    return F.concat(F.nullif(host_of(url), F.lit("")), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1))


def without_dots(path: Column) -> Column:
    """A path whose segments . and .. are resolved, as a browser does it; .. at the top stays at the top."""
    parts = F.split(path, "/", -1)
    up = F.regexp_replace
    folded = F.aggregate(F.slice(parts, 2, F.size(parts)), F.lit(""), lambda done, x: F.when(x == ".", done).when(x == "..", up(done, r"/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), x)))
    return F.when(path.rlike(r"/\.\.?$"), F.concat(folded, F.lit("/"))).otherwise(folded)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule 'host/path' that fits, null if none: its host or a subdomain, and a path that begins with its path."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        top, _, rest = rule.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def ruled(urls: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """urls, which have host and path, with rule and action of the longest rule that fits, null if none does. rules are pairs, or a table (rule, action) of any length.

    The join form takes the distinct (host, path): each host gives itself and the domains above it, each of those the lengths that
    its rules' paths have, and (domain, beginning of the path) meets its rule by equality, however many rules there are.
    """
    if not isinstance(rules, DataFrame) and len(rules) <= MAX_RULES:
        found = urls.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
        return found.withColumn("action", action_of(F.col("rule"), rules))
    table = rules if isinstance(rules, DataFrame) else urls.sparkSession.createDataFrame(list(rules), "rule string, action string")
    named = cut(table.where("rule is not null").groupBy("rule").agg(F.min("action").alias("action")).select(
        "rule", "action", F.substring_index("rule", "/", 1).alias("_top"), F.concat(F.lit("/"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 2)")).alias("_start")
    ))
    few = named.count() <= LARGE
    lengths = named.groupBy("_top").agg(F.collect_set(F.length("_start")).alias("_lengths"))
    parts, whole = F.split("host", r"\."), urls.select("host", "path").where("host <> ''").distinct()
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    tops = whole.select("host", "path", F.explode(domains).alias("_top")).join(F.broadcast(lengths) if few else lengths.hint("merge"), "_top")
    starts = tops.select("host", "path", "_top", F.explode("_lengths").alias("_l")).where(F.col("_l") <= F.length("path")).withColumn("_start", F.expr("substring(path, 1, _l)"))
    met = starts.join(F.broadcast(named) if few else named.hint("merge"), ["_top", "_start"])
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "action")).alias("_r"), F.count(F.lit(1)).alias("_n"))
    return urls.join(cut(best.select("host", "path", "_r.rule", "_r.action")).hint("merge"), ["host", "path"], "left")


def action_of(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """allow or block of a rule's name; null for null."""
    out = F.lit(None).cast("string")
    for name, action in rules:
        out = F.when(rule == name, F.lit(action)).otherwise(out)
    return out


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (a, b) between the identities of a page and of what its canonical link or refresh redirect names.

    Relative targets are resolved against the page, dots in their paths too. Of a link's rel any word may be canonical. What stands in a comment counts for nothing. Pages
    without such a link, or without a host, give none.
    """
    shown = F.regexp_replace("_html", r"(?s)<!--.*?(?:-->|\z)", " ")
    tags = F.regexp_extract_all(shown, F.lit(r"""(?is)(<(?:link|meta)\b(?:[^>"']|"[^"]*"|'[^']*')*>)"""), 1)
    links = pages.select(F.col(url_col).alias("_url"), F.col(html_col).alias("_html")).where(F.col("_html").rlike(r"(?i)canonical|http-equiv"))
    each = links.select("_url", F.explode(tags).alias("_tag"))
    canonical = F.when(F.col("_tag").rlike(CANONICAL), F.regexp_extract("_tag", r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    refresh = F.when(F.col("_tag").rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""), F.regexp_extract("_tag", r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    target = F.replace(F.coalesce(canonical, refresh), F.lit("&amp;"), F.lit("&"))
    # Written out: the optimizer would otherwise repeat these patterns in each expression below.
    named = cut(each.select("_url", target.alias("_to"))).where("_to <> ''")
    to, host, folder = F.col("_to"), host_of(F.col("_url")), F.regexp_extract(path_of(F.col("_url")), r"(?s)^(.*/)", 1)
    full = (
        F.when(to.contains("://"), to).when(to.startswith("//"), F.concat(F.lit("x:"), to)).when(to.startswith("/"), F.concat(F.lit("x://"), host, to))
        .otherwise(F.concat(F.lit("x://"), host, F.when(folder == "", F.lit("/")).otherwise(folder), to))
    )
    resolved = cut(named.select(node_of(F.col("_url")).alias("a"), full.alias("_to")))
    there = F.concat(F.nullif(host_of(F.col("_to")), F.lit("")), without_dots(path_of(F.col("_to"))), F.regexp_extract("_to", r"(?s)^.*?://[^/?#]*[^?#]*([^#]*)", 1))
    return resolved.select("a", there.alias("b")).where("a is not null and b is not null and a <> b").distinct()


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None
) -> DataFrame:
    """Rows (id, host, path, rule, verdict), one for each row of pages.

    rules are pairs of 'host/path' and allow or block, or a table (rule, action). Where a rule fits, the longest decides. Other urls take
    their aliases' decision and are allowed by default; an explicit allow of an alias outweighs any block. Aliases come from html_col, unless
    that is None, and from redirects, rows (from_url, to_url). Null urls, and urls without ://, have empty host and path, fit no rule and
    have no aliases, so they are allowed. Repeated rows stay; other columns are not read; an empty table gives no rows.
    """
    url = F.col(url_col)
    judged = ruled(pages.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("_node")), rules)
    edges = alias_edges(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        given = redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")).where("a is not null and b is not null")
        edges = given if edges is None else edges.unionByName(given)
    if edges is None:
        return judged.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"))
    members = connected_components(edges)
    as_url = F.concat(F.lit("x://"), F.col("node"))
    acts = ruled(members.select("component", host_of(as_url).alias("host"), path_of(as_url).alias("path")), rules)
    groups = acts.groupBy("component").agg(F.max(F.col("action") == "block").alias("_block"), F.max(F.col("action") == "allow").alias("_allow"), F.count(F.lit(1)).alias("_n"))
    blocked = join_hot(members, groups.where("_block and not coalesce(_allow, false)"), "component").select(F.col("node").alias("_node"), F.lit("block").alias("_alias"))
    # Rows without a host would meet in one task.
    named = judged.where("_node is not null").join(blocked.hint("merge"), "_node", "left")
    out = named.unionByName(judged.where("_node is null").withColumn("_alias", F.lit(None).cast("string")))
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("action", "_alias", F.lit("allow")).alias("verdict"))
