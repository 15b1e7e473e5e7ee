"""Main text of web pages by wrapper induction over pages of one host.

Pages are dealt by host, a host with many pages over several salts. Within a salt they stream in a fixed order, in blocks of BLOCK
pages, the last two of even size. In a block the whole DOM trees are aligned with those of a few reference pages by simple tree
matching (Yang, 1991), top-down: a node of a reference is a slot, and the subtrees that other pages have there are its fillings. A slot
where most pages have a subtree that other pages have there as well, be it one or one of some variants, is constant, and what fills it is
template; a slot whose fillings vary is content. Copies of a page count as one page.

A block of ENOUGH different pages is decided by that alone: what is no template is the text, but for what varies from page to page without
being article, namely reader comments, forms and what is hidden. Fewer pages do not show which slots recur. There, what HTML itself
marks as no part of the article (navigation, adverts, ...) is left out by tag, role and class as well, and the page's marked main region is taken.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import sized

#: Pages, and characters of pages, that are aligned with each other at most.
BLOCK, BLOCK_CHARS = 256, 1 << 24
#: A slot is constant if at least CONSTANT_PAGES different pages fill it, and PRESENT of all, and RECURS of them with a subtree that another one has there.
CONSTANT_PAGES, PRESENT, RECURS = 4, 0.5, 0.75
#: Different pages of a block from which on induction alone decides.
ENOUGH = 90
#: Pages of a block whose trees serve as references.
REFERENCES = 3
#: Lists of children of up to so many pairs are matched by dynamic programming, longer ones in order between their equal subtrees.
PAIRS = 2500

RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "xmp", "noembed", "noframes", "object", "canvas"}
CHROME_TAGS = {"nav", "footer", "aside", "form", "head", "header", "select", "button", "dialog", "menu", "fieldset", "option", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var"
    " audio video picture map br img wbr input source track area embed param".split()
)
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dt dd".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
MAIN = {"article", "main"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*\Z",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: Words that a class, id or role begins or ends with if it names no part of the article; of the second kind none of its parts, whatever it holds.
_CHROME_WORD = re.compile(
    r"ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent\w*|gdpr|notices?|alert|sidebar\w*|widget\w*|recommend\w*|share\w*|sharing|social\w*|newsletter\w*|subscribe\w*|signup|popup\w*"
    r"|modal\w*|overlay\w*|nav|navbar\w*|navigation\w*|menus?|menubar|breadcrumbs?|footer\w*|header|masthead|toolbar\w*|pagination|pager|login|complementary|contentinfo|search|dialog|tooltip|skiplink",
    re.I,
)
_COMMENT_WORD = re.compile(r"comments?|commentlist|disqus\w*|replies|respond", re.I)
#: Words that make a name the state of what holds the article, and what may follow "related" in the name of a list of links.
_STATE = {"has", "with", "without", "no", "is", "hide", "show"}
_RELATED = {"related", "posts", "post", "articles", "article", "links", "link", "stories", "story", "content", "contents", "items", "pages", "news", "reading", "topics", "list", "box"}
_WORD_ENDS = re.compile(r"[-_]+")
#: Elements of a head; any other begins the body.
HEAD = {"base", "link", "meta", "title", "script", "style", "noscript", "template"}


def named(names: str) -> tuple[bool, bool]:
    """(names no part of the article, names comments) of the classes, id and role of an element."""
    chrome = comments = False
    for name in names.split():
        words = [w for w in _WORD_ENDS.split(name) if w]
        if not words or words[0].lower() in _STATE:
            continue
        ends = (words[0], words[-1])
        comments = comments or any(_COMMENT_WORD.fullmatch(w) for w in ends)
        chrome = chrome or any(_CHROME_WORD.fullmatch(w) for w in ends) or name.lower() in ("skip-link", "skip_link") or (words[0].lower() == "related" and words[-1].lower() in _RELATED) or (len(words) > 1 and words[-1].lower() == "related")
    return chrome or comments, comments


_SPACE, _DIGITS = re.compile(r"\s+"), re.compile(r"\d+")


class Node:
    """An element, or a text block where text is not None. label is what nodes are matched by, digest stands for the whole subtree."""

    __slots__ = ("tag", "text", "children", "chrome", "by_name", "comments", "strict", "holds_main", "link_chars", "label", "digest")

    def __init__(self, tag: str, text: str | None = None, names: str = ""):
        self.tag, self.text, self.children = tag, text, []
        self.chrome = self.by_name = self.comments = self.strict = self.holds_main = False  # strict: comments, forms and what is hidden
        self.link_chars = self.digest = 0
        self.label = f"#{tag}" if text is not None else f"{tag} {_DIGITS.sub('', names)}" if names else tag


def parse(html: str | None) -> Node:
    """The tree of elements and text blocks of a page: inline markup dissolved, references decoded, white space collapsed.

    Broken markup is read as browsers do in the common cases: unclosed paragraphs, list items and cells, stray end tags,
    and a page cut off within a tag. Null gives an empty tree.
    """
    root = Node("body")
    if not html:
        return root
    stack, parts, linked, in_link, pos, n = [root], [], 0, 0, 0, len(html)
    unclosed: Counter = Counter()  # elements on the stack by tag, so that stray end tags cost nothing

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html_lib.unescape("".join(parts)) if any("&" in x for x in parts) else "".join(parts)).strip()
            parts.clear()
            if text:
                leaf = Node(stack[-1].tag, text)
                leaf.link_chars = linked
                stack[-1].children.append(leaf)
        linked = 0

    def pop_to(k: int) -> None:
        while len(stack) > k:
            top = stack.pop()
            unclosed[top.tag] -= 1
            if (top.holds_main or top.tag in MAIN) and not top.comments:
                stack[-1].holds_main = True

    search = _TAG.search
    while pos < n:
        m = search(html, pos)
        end = m.start() if m else n
        if end > pos:
            parts.append(html[pos:end])
            if in_link:
                linked += end - pos
        if not m:
            break
        pos = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, attrs = tag.lower(), m["attrs"] or m["attrs2"] or ""
        if m["close"] or m["close2"]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in INLINE:
                continue
            flush()
            for k in range(len(stack) - 1, 0, -1) if unclosed[tag] else ():
                if stack[k].tag == tag:
                    pop_to(k)
                    break
                if tag == "p":
                    break
            continue
        if stack[-1].tag == "head" and tag not in HEAD:
            flush()
            pop_to(len(stack) - 1)
        if tag in ("svg", "math") and attrs.rstrip().endswith("/"):
            continue  # closed by itself
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, pos)
            pos = close.end() if close else pos if tag in ("svg", "math") else n
            parts.append(" ") if parts else None
            continue
        if tag in INLINE:
            if tag == "a":
                in_link += 1
            elif tag == "br":
                parts.append("\n")
            continue
        flush()
        in_link = 0
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    pop_to(k)
                    break
                if stack[k].tag not in SIBLINGS and stack[k].tag != "p":
                    break
        if tag in SIBLINGS:
            same, scope = SIBLINGS[tag]
            for k in range(len(stack) - 1, 0, -1) if any(unclosed[x] for x in same) else ():
                if stack[k].tag in scope:
                    break
                if stack[k].tag in same:
                    pop_to(k)
                    break
        if tag in VOID:
            continue
        names = " ".join(x[0] or x[1] or x[2] for x in _NAMES.findall(attrs)) if attrs else ""
        node = Node(tag, names=names)
        node.chrome, node.strict = tag in CHROME_TAGS, tag == "form"
        if attrs:
            by_name, comments = named(names)
            hidden = tag not in MAIN and bool(_HIDDEN.search(attrs))
            node.comments = comments
            node.strict |= comments or hidden
            node.by_name = by_name and not comments and not node.chrome and tag not in MAIN
            node.chrome |= node.strict or node.by_name
        stack[-1].children.append(node)
        stack.append(node)
        unclosed[tag] += 1
    flush()
    pop_to(1)
    _keep_large(root)
    return root


def _keep_large(root: Node) -> None:
    """An element that a class names as no part of the article, or a form, but that holds most of the page's text, and not as links, is what holds the article."""
    chars: dict[int, tuple[int, int]] = {}
    nodes = _preorder(root)
    for x in reversed(nodes):
        own = (len(x.text), x.link_chars) if x.text is not None else (0, 0)
        chars[id(x)] = (own[0] + sum(chars[id(y)][0] for y in x.children), own[1] + sum(chars[id(y)][1] for y in x.children))
    total = chars[id(root)][0]
    for x in nodes:
        n, linked = chars[id(x)]
        if (x.by_name or x.tag == "form") and not x.comments and 2 * n > total and 2 * linked < n:
            x.chrome = x.strict = False


def _preorder(tree: Node) -> list[Node]:
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(reversed(x.children))
    return out


def _digested(tree: Node) -> list[str]:
    """Give each node its digest; the texts of the tree's blocks."""
    nodes = _preorder(tree)
    for x in reversed(nodes):
        x.digest = hash((x.tag, x.text)) if x.text is not None else hash((x.label, *(y.digest for y in x.children)))
    return [x.text for x in nodes if x.text is not None]


def _kept(tree: Node, fixed: set[int], lists: bool, strict: bool = True) -> list[tuple[Node, bool, bool]]:
    """(text block, within an article, within main) of a tree without template and, if lists, without chrome; of it, comments, forms and what is hidden go if strict.

    A header within the article stays, and so does whatever holds the article.
    """
    out, todo = [], [(tree, False, False)]
    while todo:
        x, article, main = todo.pop()
        if id(x) in fixed:
            continue
        if x.text is not None:
            out.append((x, article, main))
            continue
        article, main = article or x.tag == "article", main or x.tag == "main"
        if strict and (x.comments or x.strict and not x.holds_main):
            continue
        if lists and x.chrome and not x.holds_main and not ((article or main) and x.tag in ("header", "menu")):
            continue
        todo.extend((y, article, main) for y in reversed(x.children))
    return out


def _region(blocks: list[tuple[Node, bool, bool]]) -> tuple[list[Node], bool]:
    """The blocks of the main region, and whether the page marks it: its articles, else its main element, else all."""
    total = sum(len(x.text) for x, _, _ in blocks)
    for k, share in ((1, 0.4), (2, 0.0)):
        found = [x[0] for x in blocks if x[k]]
        if found and sum(len(x.text) for x in found) >= share * total:
            return found, True
    return [x for x, _, _ in blocks], False


def _in_order(xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
    """Pairs of equal labels of two lists in order, of the most weight: an equal subtree counts twice, so that constant nodes find each other among varying ones."""
    if len(xs) * len(ys) > PAIRS:
        # Each of one list with the next of its label in the other: linear, and no node is lost, as unmatched ones count as varying.
        places: dict[str, list[int]] = defaultdict(list)
        for j, y in enumerate(ys):
            places[y.label].append(j)
        out, last = [], -1
        for x in xs:
            at = places.get(x.label, ())
            k = bisect_right(at, last)
            if k < len(at):
                last = at[k]
                out.append((x, ys[last]))
        return out
    rows = [[0] * (len(ys) + 1)]
    for x in xs:
        above, row = rows[-1], [0]
        for j, y in enumerate(ys):
            best = above[j + 1] if above[j + 1] > row[j] else row[j]
            if x.label == y.label and (s := above[j] + (2 if x.digest == y.digest else 1)) > best:
                best = s
            row.append(best)
        rows.append(row)
    out, i, j = [], len(xs), len(ys)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((xs[i], ys[j]))
    return out


def match_children(xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
    """Pairs of two lists of children that keep labels and order.

    In long lists, subtrees that both have, once each, are matched first, in the longest run that keeps order; what lies between is matched by _in_order().
    """
    if len(xs) * len(ys) <= PAIRS:
        return _in_order(xs, ys)
    once = Counter(x.digest for x in xs)
    place = {y.digest: j for j, y in enumerate(ys)}
    twice = {d for d, c in Counter(y.digest for y in ys).items() if c > 1}
    common = [(i, place[x.digest]) for i, x in enumerate(xs) if once[x.digest] == 1 and x.digest in place and x.digest not in twice]
    tops: list[int] = []
    of_top: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(common):
        at = bisect_left(tops, j)
        before.append(of_top[at - 1] if at else -1)
        tops[at : at + 1] = [j]
        of_top[at : at + 1] = [k]
    chain, k = [], of_top[-1] if of_top else -1
    while k >= 0:
        chain.append(common[k])
        k = before[k]
    out, i, j = [], 0, 0
    for a, b in [*reversed(chain), (len(xs), len(ys))]:
        out += _in_order(xs[i:a], ys[j:b])
        if a < len(xs):
            out.append((xs[a], ys[b]))
        i, j = a + 1, b + 1
    return out


def aligned(a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
    """The pairs of nodes of an alignment of two trees, roots first: labels, order and ancestry are kept."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        yield a, b
        if a.children and b.children:
            todo.extend(zip(a.children, b.children, strict=True) if a.digest == b.digest else match_children(a.children, b.children))


def copies(texts: list[list[str]]) -> list[int]:
    """For each page a number that copies share: pages of equal texts, or of which one shares over half of its characters with the other.

    Texts that half of the pages have are left out of account, lest a template make copies of all pages.
    """
    n, sets = len(texts), [set(x) for x in texts]
    pages = Counter(t for ts in sets for t in ts)
    of_text: dict[str, list[int]] = defaultdict(list)
    equal: dict[tuple, int] = {}
    group: list[int] = []
    for ts, whole in zip(sets, texts, strict=True):
        if (same := equal.get(tuple(whole))) is not None:
            group.append(same)
            continue
        shared: dict[int, int] = defaultdict(int)
        mine = 0
        for t in ts:
            if 2 * pages[t] < n or n < CONSTANT_PAGES:
                mine += len(t)
                for g in of_text[t]:
                    shared[g] += len(t)
        g = max(shared, key=lambda k: (shared[k], -k), default=-1)
        if g < 0 or shared[g] * 2 <= mine:
            g = len(equal)
            for t in ts:
                of_text[t].append(g)
        equal[tuple(whole)] = g
        group.append(g)
    return group


def induce(trees: list[Node]) -> list[set[int]]:
    """For each tree of one host, the ids of the nodes that fill constant slots: the host's template."""
    texts = [_digested(t) for t in trees]
    group = copies(texts)
    first = list({g: i for i, g in reversed(list(enumerate(group)))}.values())
    constant: list[set[int]] = [set() for _ in trees]
    need = max(CONSTANT_PAGES, PRESENT * len(first))
    if len(first) < CONSTANT_PAGES:
        return constant
    by_size = sorted(first, key=lambda i: (len(texts[i]), i))
    middle = len(by_size) // 2
    for r in by_size[max(0, middle - REFERENCES // 2) :][:REFERENCES]:
        slots: dict[int, dict[int, int]] = defaultdict(dict)  # of each slot, the digest with which each group fills it
        fillings: dict[int, list[tuple[int, Node]]] = defaultdict(list)
        for i, t in enumerate(trees):
            for x, y in aligned(t, trees[r]):
                slots[id(y)].setdefault(group[i], x.digest)
                fillings[id(y)].append((i, x))
        for slot, of_group in slots.items():
            if len(of_group) >= need and sum(c for c in Counter(of_group.values()).values() if c > 1) >= RECURS * len(of_group):
                for i, x in fillings[slot]:
                    constant[i].add(id(x))
    for t, fixed in zip(trees, constant, strict=True):
        fixed.discard(id(t))
    return constant


def extract(pages: list[str | None], lists: bool = True, induction: bool = True, strict: bool = True) -> list[tuple[list[str], int, bool]]:
    """(blocks of main text, number of text blocks that induction found to be template, whether induction decided) of each of these pages, which are of one host.

    lists: where the pages are too few for induction to decide, leave out what tags, roles and classes mark, and take the element that the page marks as its main
    region. strict: leave out comments, forms and what is hidden. induction: without it, nothing is template.
    """
    trees = [parse(x) for x in pages]
    different = len(set(copies([[x.text for x in _preorder(t) if x.text is not None] for t in trees]))) if len(trees) >= ENOUGH else 0
    decided = different >= ENOUGH
    constant = induce(trees) if induction and len(trees) >= CONSTANT_PAGES else [set()] * len(trees)
    lists = lists and not decided
    out = []
    for tree, fixed in zip(trees, constant, strict=True):
        left = _kept(tree, fixed, lists, strict)
        template = len(_kept(tree, set(), False, False)) - len(_kept(tree, fixed, False, False)) if fixed else 0
        blocks, marked = _region(left) if lists else ([x for x, _, _ in left], True)
        out.append(([x.text for x in blocks if marked or not (x.tag in ("li", "td", "dd") and x.link_chars * 5 >= 4 * len(x.text))], template, decided))
    return out


def host_of(url) -> "F.Column":
    """The lower-cased host of a url column, empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^/?#]*?://([^/?#]*)", 1)), F.lit(""))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id, url, text, blocks array, n_chars, n_template, by_induction), one for each row of pages, with the page's main text.

    n_template counts the text blocks that induction took for template; by_induction says whether the page's block had ENOUGH different pages for induction to decide, and tags
    and classes did not. text joins the blocks with a blank line; each block is trimmed and has single spaces. A page with null or empty html, or
    without any text, has text '' and no blocks. Null urls form one host. Repeated rows and ids are kept as they are; pages with the
    same text on one host are taken for copies, not for a template. Hosts, and blocks that BLOCK_CHARS has closed early, of fewer than CONSTANT_PAGES different pages have no template.
    Columns other than the three named are ignored.

    Hosts of over BLOCK pages are dealt over salts of about BLOCK pages each; that depends on the host's pages alone.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host_of(F.col(url_col)).alias("_host"))
    order = F.xxhash64(F.col("_id").cast("string"), F.col("_url"), F.lit(11))
    dealt = sized(rows, "_host", BLOCK).withColumn("_salt", F.pmod(order, F.ceil(F.col("_n") / BLOCK))).withColumn("_order", order).drop("_n")
    n = 3 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small tasks, as a salt is dealt whole
    kind = dict(pages.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, chars = None, [], 0

        def done(n: int) -> pd.DataFrame:
            nonlocal chars
            pages = held[:n]
            del held[:n]
            chars = sum(len(x[2] or "") for x in held)
            found = extract([x[2] for x in pages])
            blocks = [x for x, _, _ in found]
            texts = ["\n\n".join(x) for x in blocks]
            return pd.DataFrame({id_col: pd.Series([x[0] for x in pages], dtype=object), url_col: [x[1] for x in pages], "text": texts, "blocks": blocks, "n_chars": [len(x) for x in texts], "n_template": [n for _, n, _ in found], "by_induction": [d for _, _, d in found]})

        def rest() -> Iterator[pd.DataFrame]:
            # A short remainder would have too few pages to induce from, so what is left over one block is halved.
            if len(held) > BLOCK:
                yield done((len(held) + 1) // 2)
            if held:
                yield done(len(held))

        for batch in batches:
            out = []
            for row in zip(batch["_host"], batch["_salt"], batch["_id"], batch["_url"], batch["_html"], strict=True):
                if held and row[:2] != key:
                    out.extend(rest())
                elif len(held) >= 2 * BLOCK:
                    out.append(done(BLOCK))
                elif chars >= BLOCK_CHARS:
                    out.append(done(len(held)))
                key = row[:2]
                held.append([None if x is None or x != x else x for x in row[2:]])
                chars += len(held[-1][2] or "")
            if out:
                yield pd.concat(out, ignore_index=True)
        yield from rest()

    return dealt.repartition(n, "_host", "_salt").sortWithinPartitions("_host", "_salt", "_order", "_id", "_html").mapInPandas(run, f"`{id_col}` {kind[id_col]}, `{url_col}` string, text string, blocks array<string>, n_chars long, n_template long, by_induction boolean")
