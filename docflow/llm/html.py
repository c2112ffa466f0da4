"""Operator 7: main text of web pages by template deduction from equivalence classes.

A page is a sequence of tokens: tags and text nodes, each with its path of open elements. Tokens
that occur equally often on every page of a host share an occurrence vector; the vectors are
compared by fingerprints that Spark sums up over the pages, so no host is gathered anywhere. A
class of tokens with one vector is large and frequent enough for the host's template; on a page it
is valid if all its tokens stand there equally often and in order, round after round, and if each
round lies in one gap of every valid class around it. The nest of valid classes is the page's
template. The same is done for each layout of a host (pages with the same kinds of sections), so a
rare layout has classes of its own.

What lies between template tokens are slots: the text under the innermost template element. The
page's text is taken from slots: text that is itself a template token is static and goes, slots
under elements that are made for something else go: by their tag, or by their name unless they hold most of
what varies on the page or in its articles. Of the rest, slots that say one of a few things on many pages of the host, or hold little but links, go unless they are
inside an article element.
"""

from __future__ import annotations

import html as references
import json
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.shared import table, written

#: A class is part of the template from so many tokens, pages, and share of the pages of its host or layout on.
MIN_TOKENS, MIN_PAGES, MIN_SHARE = 3, 3, 0.1
#: A block's texts are stock phrases if on so many pages or more they are so few of different ones.
STOCK_PAGES, STOCK_SHARE = 12, 0.2
#: A slot with a larger share of its characters inside links is a list of links.
LINKS = 0.8
#: Templates (characters in all) are broadcast up to this size; beyond, a shuffled join.
BROADCAST_CHARS = 16_000_000

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S
)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])([^\s\"'=/>]++)\s*+=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
NAMING = frozenset(("class", "id", "role"))
RAW = frozenset("script style textarea title noscript iframe noframes xmp template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
SPACED = frozenset("br td th img".split())
ENDS_P = BLOCKS - {"body", "html"}
#: Elements that never hold an article's text.
ASIDE = frozenset("head nav footer aside form script style noscript template iframe button select textarea svg dialog title".split())
#: Words that name an element made for something else than the page's text.
ASIDE_WORD = re.compile(
    r"ads?|advert\w*|banners?|sponsor\w*|promo\w*|nav\w*|menus?|sidebars?|footer|comments?|reply|replies|cookies?|notices?|consent|"
    r"newsletter|subscribe|share|social|related|breadcrumbs?|popup|modal|widgets?|login|search|complementary|contentinfo|alert"
)
#: Words that say where or what kind of element it is, so that the name still is an aside's ...
PLAIN_WORDS = frozenset(
    "area article bar block body bottom box btn button buttons col container content desktop element entry field form global group head header icon icons "
    "inner item items label large left link links list main mobile module page panel post posts primary region right row secondary section side site slot "
    "small text title toggle top unit wrap wrapper zone".split()
)
#: ... unless one of these comes first: content-sidebar-wrap is what holds content and sidebar.
HOLDING_WORDS = frozenset("body container content inner wrap wrapper".split())
#: Names of reader comments, which go however many there are, and of what holds teasers of other pages.
COMMENT_WORD, TEASER_WORD = re.compile(r"comments?|reply|replies"), re.compile(r"ads?|advert\w*|banners?|sponsor\w*|promo\w*|related|newsletter|subscribe|comments?|reply|replies")
ARTICLE = frozenset(("article", "main"))
#: Elements that hold the page's text whatever their names say they have (no-sidebar, main-search).
HOLDERS = frozenset(("html", "body", "main", "article"))
#: An article with one of these words among its names is aside: it is a comment, not one with comments.
ASIDE_ARTICLE = re.compile(r"(?<!\S)(?:comment|reply|teaser|ad|advert|advertisement|sponsored|promo|related)(?!\S)", re.I)
#: Grades of ``Node.aside``: in the page's text, aside by an article's names only, aside.
INSIDE, NAMED, OUTSIDE = 0, 1, 2


def aside_words(names: str) -> list[str]:
    """The aside words of the names that say nothing else: sidebar-left has one, no-sidebar none."""
    out = []
    for name in names.lower().split():
        parts = [x for x in re.split(r"[-_\d]+", name) if x]
        aside = [x for x in parts if ASIDE_WORD.fullmatch(x)]
        if aside and parts[0] not in HOLDING_WORDS and all(x in PLAIN_WORDS for x in parts if x not in aside):
            out += aside
    return out


class Mark:
    """An element whose names say that it is aside. Whether it is, is seen when the page is known."""

    __slots__ = ("article_size", "comment", "size", "teaser", "up")

    def __init__(self, words: list[str], up: Mark | None):
        self.up = up
        self.comment = any(COMMENT_WORD.fullmatch(w) for w in words)
        self.teaser = any(TEASER_WORD.fullmatch(w) for w in words)
        self.size = self.article_size = 0

    def chain(self) -> Iterator[Mark]:
        mark: Mark | None = self
        while mark:
            yield mark
            mark = mark.up


class Node:
    """An open element: its path, how far text in it is aside, and whether it is in the article."""

    __slots__ = ("article", "aside", "key", "link", "mark", "path", "tag")

    def __init__(self, tag: str, names: str, parent: Node | None):
        self.tag = tag
        label = f"{tag}.{names}" if names else tag
        self.path = f"{parent.path}/{label}" if parent else label
        self.key = xxhash.xxh64_intdigest(self.path) >> 1
        self.article = bool(parent and parent.article) or tag in ARTICLE
        self.link = bool(parent and parent.link) or tag == "a"
        # a header in an article is its title; a page's header isn't
        aside = tag in ASIDE or (tag == "header" and not self.article)
        named = tag == "article" and bool(names and ASIDE_ARTICLE.search(names))
        self.aside = max(parent.aside if parent else INSIDE, OUTSIDE if aside else NAMED if named else INSIDE)
        self.mark = parent.mark if parent else None
        if names and tag not in HOLDERS and (words := aside_words(names)):
            self.mark = Mark(words, self.mark)


def marked_aside(stream: list[tuple[Node, str | None, bool]], static: set[int]) -> set[Mark]:
    """The marks that hold: those whose elements don't hold the page.

    An element holds the page if over half of the page's varying text is in it (text that is neither
    the template's nor a link's), or over half of what its articles have of that; a name of teasers
    is only overruled by the first, one of comments only if there is no other text at all.
    """
    total = in_articles = 0
    for node, text, _ in stream:
        if not text or node.aside != INSIDE or not (n := len(text.strip())) or node.link or _text_key(node, text) in static:
            continue
        total += n
        in_articles += n if node.article else 0
        for mark in node.mark.chain() if node.mark else ():
            mark.size += n
            mark.article_size += n if node.article else 0
    out = set()
    for mark in {m for node, _, _ in stream if node.mark for m in node.mark.chain()}:
        holds = mark.size == total if mark.comment else 2 * mark.size > total or (not mark.teaser and 2 * mark.article_size > in_articles)
        if not (holds and mark.size):
            out.add(mark)
    return out


def _names(attributes: str) -> str:
    """Values of the attributes class, id and role, in order."""
    found = (a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(attributes) if a[1].lower() in NAMING)
    return " ".join(v for x in found if (v := x.strip()))


def tokens(page: str) -> Iterator[tuple[Node, str | None, bool]]:
    """(element, None, starts a block) for each opened element, (element, text, _) for each text
    node, and (element, "", starts a block) where an element ends or white space stands for one."""
    stack: list[Node] = []
    root = Node("", "", None)
    at, n = 0, len(page)
    while at < n:
        top = stack[-1] if stack else root
        m = MARKUP.search(page, at)
        start = m.start() if m else n
        if start > at:
            yield top, references.unescape(page[at:start]), False
        if not m:
            return
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            yield (stack[-1] if stack else root), "", tag in BLOCKS
            continue
        if tag in ENDS_P or tag == "li":
            closes = ("p", "li") if tag == "li" else ("p",)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in closes:
                    del stack[k:]
                    break
                if stack[k].tag in ("ul", "ol", "article", "div", "section", "table", "blockquote", "body"):
                    break
        names = _names(m[3]) if "=" in m[3] else ""
        node = Node(tag, names, stack[-1] if stack else None)
        yield node, None, tag in BLOCKS
        if tag in SPACED:
            yield node, " ", False
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else n
            continue
        stack.append(node)


def _text_key(node: Node, text: str) -> int:
    return xxhash.xxh64_intdigest(text.strip().encode("utf-8", "surrogatepass"), node.key) >> 1


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user and port; of a null or odd one perhaps empty."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), "^(?:[^/?#]*//)?(?:[^/?#@]*@)?([^/?#:]*)", 1)


def layout_of(page: Column) -> Column:
    """Hash of the kinds (tag and class, without digits) of sections that a page has.

    It only says which pages are compared with each other besides those of the whole host.
    """
    opened = F.regexp_extract_all(page, F.lit(r"(?i)<(?:body|main|article|section|nav|header|footer|aside|form|div)\b[^<>]*"), F.lit(0))
    tag, names = r"(?i)^<([a-z]+)", r"(?i)\sclass\s*=\s*([\"'][^\"']*|[^\s\"'>]+)"
    kinds = F.transform(opened, lambda x: F.concat(F.lower(F.regexp_extract(x, tag, 1)), F.regexp_replace(F.regexp_extract(x, names, 1), r"[\d\"']+", "")))
    return F.xxhash64(F.array_sort(F.array_distinct(kinds)))


def occurrences(stream: Iterable[tuple[Node, str | None, bool]]) -> tuple[dict[int, list[int]], dict[int, int]]:
    """token -> its places on one page of :func:`tokens`, and text token -> its element's token."""
    places: dict[int, list[int]] = {}
    element: dict[int, int] = {}
    for place, (node, text, _) in enumerate(stream):
        if text is None:
            key = node.key
        elif text.strip():
            key = _text_key(node, text)
            element[key] = node.key
        else:
            continue
        places.setdefault(key, []).append(place)
    return places, element


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial sums for each host, layout and token: pages, two fingerprints of the vector, places."""
    for b in batches:
        sums: dict[tuple[str, int, int, int | None], list[int]] = {}
        for who, host, layout, page in zip(b["who"], b["host"], b["layout"], b["html"], strict=True):
            places, element = occurrences(tokens(page))
            for key, at in places.items():
                mark = xxhash.xxh64_intdigest(who, len(at))
                s = sums.setdefault((host, layout, key, element.get(key, 0)), [0, 0, 0, 0])
                s[0] += 1
                s[1] += mark >> 32
                s[2] += mark & 0xFFFFFFFF
                s[3] += at[0]
        rows = [(*k, *s) for k, s in sums.items()]
        yield pd.DataFrame(rows, columns=["host", "layout", "token", "element", "n", "f1", "f2", "place"])


def deduce_templates(pages: DataFrame) -> DataFrame:
    """host, layout, template: JSON of ``classes``, each a list of tokens in order of place, and of
    ``stock``, the elements whose texts are stock phrases.

    The row with a null layout is of the whole host; layouts that all pages of the host share have
    no row of their own. A token needs MIN_SHARE of the pages of its host or layout, so a template
    has at most 1 / MIN_SHARE times as many tokens as the mean page, however many pages there are;
    an element with stock phrases needs STOCK_PAGES pages.
    """
    rows = pages.select("who", "host", "layout", "html")
    sums = [F.sum(c).alias(c) for c in ("n", "f1", "f2", "place")]
    partial = rows.mapInPandas(_vectors, "host string, layout long, token long, element long, n long, f1 long, f2 long, place long")
    by_layout = written(partial.groupBy("host", "layout", "token", "element").agg(*sums), "page-tokens")
    whole = F.lit(None).cast("long").alias("layout")
    vectors = by_layout.drop("element").unionByName(by_layout.groupBy("host", "token").agg(*sums).select("host", whole, "token", "n", "f1", "f2", "place"))
    layouts = rows.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("pages"))
    hosts = layouts.groupBy("host").agg(F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("layouts"))
    several = hosts.where(F.col("layouts") > 1).select("host")
    sizes = hosts.select("host", whole, "pages").unionByName(layouts.where(F.col("pages") >= MIN_PAGES).join(several.hint("merge"), "host").select("host", "layout", "pages"))
    sizes = sizes.select(F.col("host").alias("s_host"), F.col("layout").alias("s_layout"), "pages")
    same = (F.col("host") == F.col("s_host")) & F.col("layout").eqNullSafe(F.col("s_layout"))
    frequent = vectors.where(F.col("n") >= MIN_PAGES).join(sizes.hint("shuffle_hash"), same).where(F.col("n") >= MIN_SHARE * F.col("pages"))
    classes = (
        frequent.groupBy("host", "layout", "n", "f1", "f2")
        .agg(F.sort_array(F.collect_list(F.struct((F.col("place") / F.col("n")).alias("at"), "token"))).alias("c"))
        .where(F.size("c") >= MIN_TOKENS)
        .select("host", "layout", F.col("n"), F.transform("c", lambda t: t["token"]).alias("c"))
    )
    texts = by_layout.where(F.col("element") != 0).groupBy("host", "token", "element").agg(F.sum("n").alias("n"))
    stock = (
        texts.groupBy("host", "element").agg(F.count(F.lit(1)).alias("different"), F.sum("n").alias("n"))
        .where((F.col("n") >= STOCK_PAGES) & (F.col("different") <= STOCK_SHARE * F.col("n")))
        .select("host", whole, F.lit(0).cast("long").alias("n"), F.array("element").alias("c"))
    )
    # a class has MIN_TOKENS tokens, a stock element one
    both = classes.unionByName(stock).groupBy("host", "layout").agg(F.sort_array(F.collect_list(F.struct(-F.col("n"), "c"))).alias("all"))
    listed = lambda cond: F.transform(F.filter("all", cond), lambda x: x["c"])
    template = F.struct(listed(lambda x: F.size(x["c"]) > 1).alias("classes"), F.flatten(listed(lambda x: F.size(x["c"]) == 1)).alias("stock"))
    return both.select("host", "layout", F.to_json(template).alias("template"))


Round = tuple[int, ...]


def _nested(inner: list[Round], outer: list[Round]) -> bool:
    """Whether no round of one class crosses a round of the other: each pair lies apart, or one of
    them in a single gap of the other. The rounds of a class follow each other."""
    starts, ends = [r[0] for r in outer], [r[-1] for r in outer]
    for a in inner:
        some = outer[bisect_left(ends, a[0]) : bisect_right(starts, a[-1])]
        if len(some) == 1 and bisect_left(some[0], a[0]) == bisect_left(some[0], a[-1]):
            continue
        if any(bisect_left(a, b[0]) != bisect_left(a, b[-1]) for b in some):
            return False
    return True


def valid_classes(template: list[list[int]], places: dict[int, list[int]]) -> list[list[int]]:
    """The classes that are valid on this page: complete, equally often, in order, and nested.

    Those of most pages come first; a class that crosses one before it isn't valid.
    """
    out: list[tuple[list[int], list[Round]]] = []
    for cls in template:
        seen = [places.get(t) for t in cls]
        if any(s is None for s in seen) or len({len(s) for s in seen}) > 1:
            continue
        rounds = list(zip(*seen, strict=True))
        flat = [p for r in rounds for p in r]
        if all(a < b for a, b in zip(flat, flat[1:], strict=False)) and all(_nested(rounds, other) for _, other in out):
            out.append((cls, rounds))
    return [cls for cls, _ in out]


def static_in_article(classes: list[list[int]], elements: set[int], texts: list[int]) -> set[int]:
    """Static tokens among the tokens of an article's ``texts``.

    Classes without an element are passages that articles have in common, not a layout. Pages
    that are copies of each other have all in common; so a class, in order of pages, is static
    only while more than half of the article's texts are left.
    """
    times = Counter(texts)
    left = len(texts)
    out: set[int] = set()
    for cls in classes:
        own = [t for t in cls if t in times and t not in out]
        rest = left - sum(times[t] for t in own)
        if own and 2 * rest > len(texts) and not elements.isdisjoint(cls):
            left = rest
            out.update(own)
    return out


def extract(page: str, templates: list[list[list[int]]], stock: frozenset[int] = frozenset()) -> tuple[str, list[tuple[str, bool, int]]]:
    """The main text, and the page's slots: (path of its template element, kept, characters).

    ``templates`` are the classes of the host and of the layout, each with a nest of its own.
    """
    stream = list(tokens(page))
    places = occurrences(stream)[0] if any(templates) else {}
    classes = [cls for template in templates for cls in valid_classes(template, places)]
    known = {t for cls in classes for t in cls}
    marks = marked_aside(stream, known)
    grades: dict[Mark | None, bool] = {None: False}

    def aside_of(node: Node) -> int:
        if node.mark not in grades:
            grades[node.mark] = any(m in marks for m in node.mark.chain())
        return OUTSIDE if grades[node.mark] else node.aside

    filled = {(aside_of(node), node.article) for node, text, _ in stream if text and text.strip()}
    # a page with no other text is one of comments
    most = INSIDE if any(aside == INSIDE for aside, _ in filled) else NAMED
    in_article = any(article and aside <= most for aside, article in filled)
    static = known
    if in_article and known:
        texts = [_text_key(node, text) for node, text, _ in stream if text and node.article and aside_of(node) <= most and text.strip()]
        static = static_in_article(classes, {node.key for node, text, _ in stream if text is None}, texts)
    slot_of: dict[str, str] = {}
    opened = {node.path for node, text, _ in stream if text is None and node.key in known}

    def slot(path: str) -> str:
        if path not in slot_of:
            up = path
            while up and up not in opened:
                up = up.rpartition("/")[0]
            slot_of[path] = up
        return slot_of[path]

    def block_slot(path: str) -> str:
        """The slot of the innermost block: a link in a paragraph is part of the paragraph."""
        while path and path.rpartition("/")[2].partition(".")[0] not in BLOCKS:
            path = path.rpartition("/")[0]
        return slot(path)

    # a block is static if all its texts are: a full stop behind a link is part of its sentence
    lines, n = [], 0
    live: set[int] = set()
    for node, text, block in stream:
        n += block
        lines.append(n)
        if text and text.strip() and aside_of(node) <= most and (node.article or not in_article) and _text_key(node, text) not in static:
            live.add(n)
    # of each slot outside articles: characters that may be the page's text, and those of links
    size: Counter[str] = Counter()
    linked: Counter[str] = Counter()
    allowed = []
    for line, (node, text, _) in zip(lines, stream, strict=True):
        own = bool(text) and aside_of(node) <= most and (node.article or not in_article) and (line in live or not text.strip())
        allowed.append(own)
        if own and not in_article:
            at, n = block_slot(node.path), len(text.strip())
            size[at] += n
            linked[at] += n if node.link else 0
    lists = {at for at, n in linked.items() if n > LINKS * size[at]}
    doubtful = [own and not in_article and ((node.key in stock and node.tag in BLOCKS) or block_slot(node.path) in lists) for own, (node, _, _) in zip(allowed, stream, strict=True)]
    keeps = [own and not bad for own, bad in zip(allowed, doubtful, strict=True)]
    if not any(keep and text.strip() for keep, (_, text, _) in zip(keeps, stream, strict=True)):  # there is nothing else
        keeps = allowed if live else [bool(text) and aside_of(node) <= most and (node.article or not in_article) for node, text, _ in stream]

    blocks: list[list[str]] = [[]]
    slots: dict[tuple[str, bool], int] = {}
    for (node, text, block), keep in zip(stream, keeps, strict=True):
        if block:
            blocks.append([])
        if not text:
            continue
        if text.strip():
            at = (slot(node.path), keep)
            slots[at] = slots.get(at, 0) + len(text.strip())
        if keep:
            blocks[-1].append(text)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x), [(p, k, n) for (p, k), n in slots.items()]


_SLOTS = pa.list_(pa.struct([("slot", pa.string()), ("kept", pa.bool_()), ("n_chars", pa.int64())]))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parsed: dict[str, dict] = {}

    def read(template: str) -> dict:
        if template not in parsed:
            if len(parsed) > 1000:
                parsed.clear()
            parsed[template] = json.loads(template)
        return parsed[template]

    for b in batches:  # Arrow, so that ids next to a null keep all their bits
        texts, slots = [], []
        for page, *templates in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
            forms = [read(t) for t in templates if t is not None]
            text, found = extract(page, [f["classes"] for f in forms], frozenset(k for f in forms for k in f["stock"]))
            texts.append(text)
            slots.append([{"slot": p, "kept": k, "n_chars": n} for p, k, n in found])
        columns = [*b.columns[:2], pa.array(texts, pa.string()), pa.array(slots, _SLOTS), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "slots", "n_chars"])


def _joined(pages: DataFrame, side: DataFrame, on: list[str], name: str) -> DataFrame:
    """``pages`` with the template of ``side`` as ``name``: broadcast if small, else a shuffled join."""
    size = side.agg(F.sum(F.length("template"))).first()[0] or 0
    side = side.select(*[F.col(c).alias(f"t_{c}") for c in on], F.col("template").alias(name))
    side = F.broadcast(side) if size <= BROADCAST_CHARS else side.hint("merge")
    same = [F.col(c) == F.col(f"t_{c}") for c in on]
    return pages.join(side, same, "left").drop(*[f"t_{c}" for c in on])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and ``slots`` (path, kept, characters) of every row of ``pages``.

    Static text goes everywhere. Of the rest, where a page has text in an article or main element,
    that is its article; else all slots that are not aside, stock phrases or lists of links. A page
    of which nothing is left so (copies of one page) keeps its static text. Defined cases: null and empty html
    give an empty text; a null or odd url belongs to the host it can be read as (perhaps the empty
    one); a host with few pages has no template, then element names alone decide; repeated rows
    come back each; other columns are ignored; an empty table gives no rows; pages are read whole.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumns({"host": host_of(F.col("url")), "layout": layout_of(F.col("html")), "who": F.hex(F.xxhash64("page_id", "url"))})
    templates = written(deduce_templates(base), "page-templates")
    joined = _joined(base, templates.where(F.col("layout").isNull()), ["host"], "template")
    joined = _joined(joined, templates.where(F.col("layout").isNotNull()), ["host", "layout"], "layout_template")
    rows = joined.select("page_id", "url", "html", "template", "layout_template")
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, slots array<struct<slot:string,kept:boolean,n_chars:long>>, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


#: The same text by the markup of the tables at hand, where each page has one article element. HTML
#: decodes these five references without a semicolon too, so the SQL first puts one behind them.
ORACLE = r"""
WITH body AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>([\s\S]*)</article>', 1) AS h FROM pages),
blocks AS (SELECT page_id, i, regexp_replace(string_split_regex(h, '</?(?:p|h1)>')[i], '<[^>]*>', ' ', 'g') AS b
  FROM (SELECT *, unnest(range(1, len(string_split_regex(h, '</?(?:p|h1)>')) + 1)) AS i FROM body)),
closed AS (SELECT page_id, i, regexp_replace(b, '&(lt|gt|quot|copy|middot|amp);?', '&\1;', 'g') AS b FROM blocks),
decoded AS (SELECT page_id, i, trim(regexp_replace(replace(replace(replace(replace(replace(replace(b, '&lt;', '<'), '&gt;', '>'),
  '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM closed),
texts AS (SELECT page_id, string_agg(t, chr(10) ORDER BY i) AS text FROM decoded WHERE t <> '' GROUP BY page_id)
SELECT b.page_id, b.url, coalesce(t.text, '') AS text, length(coalesce(t.text, '')) AS n_chars
FROM body b LEFT JOIN texts t ON b.page_id = t.page_id
"""
