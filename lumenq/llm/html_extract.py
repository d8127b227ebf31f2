"""Main text of web pages by a site style tree.

The pages of a host are merged into one style tree. A style node is the chain of block elements (with
class and id) that leads to it. Each node has two importances, both between 0 and 1:

* presentation: the share of its text that is not link text, over all pages of the host;
* content: the entropy of its contents over the pages, divided by the largest possible entropy, so that
  a branch that says the same on every page has 0 and one that differs on every page has 1.

A branch whose importance (the product of the two) is below ``threshold``, on a host with at least
``min_pages`` pages that have it, is removed from each page. Branches whose element, ARIA role or class states
another role than the article (menus, forms, comments and so on) have presentation importance 0 on any
host. Where only an ambiguous word or a part of a name says so (``legal-text``, ``has-sidebar``), that is the
assumption until the host knows better: from ``overrule`` on, the importance of the branch without the
word decides, on at least ``min_pages`` pages. If all marked articles of a page stand in branches of another
role, what encloses them (a form around the page, ``has-sidebar``) is no reason to drop them, unless it is
hidden; an article among comments or teasers is dropped with them where the page has another.
Where a page marks its article (``article`` or ``main``) only that is kept, and its branches are judged
like all others, with two rules of their own: a whole article that stands on several pages counts once (an
article that was published twice is no template), and a block's own content importance, 1 - log(articles
with that text) / log(articles), must reach the threshold too, so that a notice which is repeated between
the paragraphs goes although its branch, shared with them, differs from page to page.

Hosts with fewer than ``min_pages`` pages tell too little for a tree: there the states of elements decide alone.
Broken markup is read as browsers do (an open quote ends at the next one), in one pass over the page; a quote that is
never closed doesn't take the rest of the page with it.

Rows: null html counts as empty and gives an empty text; repeated rows stay; very long pages are read whole; an empty
table gives no rows; a null url makes a host of
its own; further columns are dropped by :func:`extract` (join on page_id to get them back).
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage, table

THRESHOLD, MIN_PAGES, OVERRULE = 0.2, 8, 0.8
HIDDEN, ROLE, WORD = 4, 2, 1

# Both always end at once or at the page's end, and never go back. In the second quotes don't count.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
_LENIENT = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select", "object", "canvas"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr nobr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_NOISE_TAGS = set("nav header footer aside form menu dialog button head fieldset legend".split())
_HEADING = {"article", "main", "section"}
_NOISE_WORDS = set(
    "nav navbar navigation menu menubar header masthead topbar footer foot sidebar sidebars aside ad ads advert adverts advertisement advertising banner promo promotion promoted sponsor sponsored sponsors "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login form search searchbox breadcrumb breadcrumbs pager pagination share sharing social "
    "related recommended recommendations comment comments commentlist disqus reply replies respond widget widgets toolbar copyright legal skip".split()
)
#: Ambiguous words; those of advertising, comments and the like are not, as their texts differ from page to page like an article's.
_AMBIGUOUS = set("alert copyright legal notice notices related".split())
#: Ambiguous as parts of a name (``has-sidebar``) only.
_LAYOUT = set("foot footer form header overlay search sidebar sidebars skip social widget widgets".split())
_NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_MAIN_WORDS = {"article", "post-content", "entry-content", "article-body", "article-content", "story-body"}
#: An opening tag of the first kind ends an open element of the second.
_P_ENDS = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SELF_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}


def _noisy(tag: str, attrs: dict[str, str], main: bool = False) -> int:
    """How an element states another role than the article: 0, WORD (ambiguously), ROLE or HIDDEN. (In the article, what calls itself a header is its heading.)"""
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return HIDDEN
    if tag in _NOISE_TAGS or attrs.get("role", "").lower() in _NOISE_ROLES:
        return ROLE
    found = 0
    for value in (attrs.get("class", ""), attrs.get("id", "")):
        for name in value.lower().split():
            for part in (name, *re.split(r"[-_]+", name)):
                if part in _NOISE_WORDS and not (main and part == "header"):
                    if not (part in _AMBIGUOUS or part in _LAYOUT and part != name):
                        return ROLE
                    found = WORD
    return found


def blocks(page: str) -> Iterator[tuple[str, str, int, int, bool, int]]:
    """(style node, text, noise by role outside and inside the marked article, in the marked article, link characters), in page order."""
    stack: list[tuple[str, str, int, int, bool]] = [("", "", 0, 0, False)]  # tag, path, noise outside and inside main, in main
    text: list[str] = []
    linked, in_link, at = 0, 0, 0
    token = _TOKEN
    ends: dict[str, dict[int, int]] = {}

    def flush():
        nonlocal linked
        if text:
            whole = _SPACE.sub(" ", "".join(text)).strip()
            text.clear()
            n, linked = linked, 0
            if whole:
                _, path, outer, inner, main = stack[-1]
                return (path, whole, outer, inner, main, min(n, len(whole)))
        return None

    page = page.replace("\x00", "")
    while at < len(page):
        m = token.search(page, at)
        if m and m[2] is not None and not m[4]:
            # A tag that the page's end cuts off. Where a quote that is never closed has swallowed a >, quotes count no more.
            if token is _TOKEN and page.find(">", m.start()) >= 0:
                token = _LENIENT
                continue
            m = None
        end = m.start() if m else len(page)
        if end > at:
            piece = _html.unescape(page[at:end])
            text.append(piece)
            if in_link:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in _RAW and not m[1]:
            if m[3].rstrip().endswith("/") and tag in ("svg", "object", "canvas"):
                continue
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag == "br" or tag in _VOID and tag != "hr":
            if tag == "br":
                text.append(" ")
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if m[1] else 1
            if not m[1] and m[3]:
                attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(m[3])}
                if attrs and _noisy(tag, attrs) > WORD and (found := _ends(page, tag, ends).get(at)):
                    at = found
            continue
        got = flush()
        if got:
            yield got
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0].split(".")[0] == tag:
                    del stack[k:]
                    break
                if tag == "p" and stack[k][0].split(".")[0] not in ("p",):
                    break
            in_link = 0
            continue
        if tag == "hr":
            continue
        if tag in _P_ENDS and stack[-1][0].split(".")[0] == "p":
            stack.pop()
        if tag in _SELF_END:
            for k in range(len(stack) - 1, 0, -1):
                name = stack[k][0].split(".")[0]
                if name in _SCOPE[tag]:
                    break
                if name in _SELF_END[tag]:
                    del stack[k:]
                    break
        attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(m[3])} if m[3] else {}
        names = ".".join(sorted(set(attrs.get("class", "").split())) + ([f"#{attrs['id']}"] if attrs.get("id") else []))
        label = f"{tag}.{names}" if names else tag
        _, path, outer, inner, main = stack[-1]
        marked = tag in ("article", "main") or any(c in _MAIN_WORDS for c in attrs.get("class", "").lower().split()) or attrs.get("role", "").lower() in ("main", "article")
        if tag in ("html", "body"):
            own = 0
        elif tag == "header" and main:  # the heading of the article itself
            own = 0
        else:
            own = 0 if marked else _noisy(tag, attrs, main)
        if not m[3].endswith("/"):
            stack.append((label, f"{path}/{label}", outer if main else max(outer, own), max(inner, own) if main else 0, main or marked))
    got = flush()
    if got:
        yield got


def judged(page: str | None) -> list[tuple[str, str, int, bool, int]]:
    """(style node, text, noise, in the marked article, link characters): blocks once the page's marked articles are known."""
    found = list(blocks(page or ""))
    articles = [(outer, inner) for _, _, outer, inner, main, _ in found if main and outer < HIDDEN and inner <= WORD]
    cleared = min((outer for outer, _ in articles), default=0)
    # An article that is all in branches with an ambiguous word isn't dropped for it.
    word = 0 if any(not inner for outer, inner in articles if outer == cleared) else WORD
    out = []
    for path, text, outer, inner, main, n in found:
        if main and articles and outer <= cleared:
            out.append((path, text, 0 if inner <= word else inner, True, n))
        else:
            out.append((path, text, max(outer, inner, ROLE if articles else 0), False, n))
    return out


def _ends(page: str, tag: str, known: dict[str, dict[int, int]]) -> dict[int, int]:
    """For each opening tag of a name (by its end) the end of its element; found once for each name, in one pass."""
    if tag not in known:
        open_, known[tag] = [], {}
        for m in re.compile(rf"<(/?){re.escape(tag)}(?![^\s/>])[^>]*+>", re.I).finditer(page):
            if not m[1]:
                open_.append(m.end())
            elif open_:
                known[tag][open_.pop()] = m.end()
    return known[tag]


def _host(url):
    return F.coalesce(F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:www\.)?([^/?#:]+)", 1), F.lit(""))


def _counted(pages: DataFrame) -> DataFrame:
    """host, path, content, c, chars, linked: each content of a node; a null path is that of a single
    block in an article, an empty one that of a whole article.

    Contents are counted before they meet, and counts are summed, so that a host with a third of all
    pages is no larger a task than another. Contents of a marked article come with the article's hash:
    the same article on further pages adds nothing.
    """

    def nodes(batches):
        for batch in batches:
            seen: dict[tuple, list] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: dict[tuple, list] = {}
                whole = None
                for path, text, noise, main, n in judged(page):
                    x = own.setdefault((path, main), [0, 0, 0])
                    x[0] = hash_text(text, x[0])
                    x[1] += len(text)
                    x[2] += n
                    if main and noise <= WORD:
                        h = hash_text(text, 0)
                        own[None, h] = [h, len(text), n]
                        whole = hash_text(text, whole or 0)
                if whole is not None:
                    own["", True] = [whole, 0, 0]
                for (path, main), (h, n, linked) in own.items():
                    once = whole is not None and (path is None or main)
                    x = seen.setdefault((host, path, h, whole if once else None), [0, 0, 0])
                    if not (once and x[0]):
                        x[0] += 1
                        x[1] += n
                        x[2] += linked
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[i] for k in seen], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))] + [pa.array([v[i] for v in seen.values()], pa.int64()) for i in range(3)],
                    names=["host", "path", "content", "article", "c", "chars", "linked"],
                )

    found = pages.select(_host(F.col("url")).alias("host"), F.col("html")).mapInArrow(nodes, "host string, path string, content long, article long, c long, chars long, linked long")
    once = lambda c: F.when(F.col("article").isNull(), F.sum(c)).otherwise(F.max(c)).alias(c)
    return found.groupBy("host", "path", "content", "article").agg(once("c"), once("chars"), once("linked")).groupBy("host", "path", "content").agg(*(F.sum(c).alias(c) for c in ("c", "chars", "linked")))


def _nodes(counted: DataFrame) -> DataFrame:
    n = F.sum("c")
    entropy = F.log(n) - F.sum(F.col("c") * F.log("c")) / n
    return counted.where("path <> ''").groupBy("host", "path").agg(
        n.alias("n_pages"), (1 - F.sum("linked") / F.greatest(F.sum("chars"), F.lit(1))).alias("presentation"), F.when(n > 1, F.greatest(entropy / F.log(n), F.lit(0.0))).otherwise(F.lit(1.0)).alias("content")
    )


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, n_pages, presentation, content: the merged tree of each host."""
    return _nodes(_counted(pages))


def _repeated(counted: DataFrame, threshold: float, min_pages: int) -> DataFrame:
    """host, repeated: the hashes of blocks that are alike in so many different articles of a host that they tell nothing."""
    articles = counted.where("path = ''").groupBy("host").agg(F.sum("c").alias("n"))
    often = counted.where(F.col("path").isNull() & (F.col("c") > 1)).join(articles, "host")
    low = (1 - F.col("linked") / F.greatest(F.col("chars"), F.lit(1))) * (1 - F.log("c") / F.log("n")) < threshold
    return often.where((F.col("n") >= min_pages) & (F.col("c") >= min_pages) & low).groupBy("host").agg(F.array_sort(F.collect_set("content")).alias("repeated"))


def hash_text(text: str, seed: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), seed & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def main_text(page: str | None, unimportant: frozenset[str] = frozenset(), repeated: frozenset[int] = frozenset(), important: frozenset[str] = frozenset()) -> str:
    """The page's blocks without low branches (and, in a marked article, repeated blocks), joined by one newline."""
    low = lambda path: any(path == p or path.startswith(f"{p}/") for p in unimportant)
    return "\n".join(
        text for path, text, noise, main, _ in judged(page) if (not noise or noise == WORD and path in important) and not (unimportant and low(path)) and not (repeated and main and hash_text(text, 0) in repeated)
    )


def extract(pages: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES, overrule: float = OVERRULE) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    counted = stage(_counted(pages), "style-counts")
    importance = F.col("presentation") * F.col("content")
    paths = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("path"))))
    # Classes and ids follow a point in a path; only such nodes can need to overrule a word.
    high = (importance >= overrule) & F.col("path").contains(".")
    low = _nodes(counted).where((F.col("n_pages") >= min_pages) & ((importance < threshold) | high)).groupBy("host").agg(paths(importance < threshold).alias("low"), paths(high).alias("high"))
    low = stage(low.join(_repeated(counted, threshold, min_pages), "host", "full"), "style-tree")

    def run(batches):
        for batch in batches:
            ids, urls, pages_, *known = batch.columns
            texts = [main_text(p, *(frozenset(x or ()) for x in xs)) for p, *xs in zip(pages_.to_pylist(), *(k.to_pylist() for k in known), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html", _host(F.col("url")).alias("host")).join(low, "host", "left").select("page_id", "url", "html", "low", "repeated", "high").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op9_site_style_tree(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
