"""Main text of web pages, with site templates found by counting element subtrees."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyscan.llm.tables import materialized, unused_name

# What the HTML standard says of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section"
    " summary table tbody tfoot thead tr ul".split()
)
#: Elements that a start tag of the key ends, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
SCOPES = frozenset("table td th caption button object template article section div".split())

# What is never main text.
ASIDE = frozenset(
    "nav footer aside form dialog menu head noscript template object embed svg canvas audio video button select"
    " datalist search".split()
) | RAW
ASIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie"
    " cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login"
    " sidebar rail nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer comment comments"
    " commentlist reply replies respond disqus share sharing social related recommended recommendations widget"
    " widgets toolbar pagination pager".split()
)
#: Words that say where or how an element is laid out, beside a name of the above.
LAYOUT = frozenset(
    "area bar block body bottom box button buttons card cards center col column container content div entry fixed form grid"
    " group header icons inner item items js left link links list main mobile module outer page panel post posts primary"
    " right row secondary section single site slot sticky thread top unit wrap wrapper zone".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist reply replies respond disqus".split())
#: Names of what may hold other articles than the page's own.
OTHER_NAMES = COMMENT_NAMES | frozenset("related recommended recommendations".split())
#: Elements that names can make an aside within an article or main element.
CONTAINERS = frozenset("address aside center details dialog div dl fieldset figure footer form header hgroup li menu nav ol section table ul".split())
#: Elements whose text outside links is prose.
PROSE = frozenset("p pre blockquote".split())
#: Elements that names cannot make an aside.
ROOTS = frozenset(("html", "body", "main", "article"))
#: Elements whose subtrees may belong to a template; prose inside an article never does.
TEMPLATE = frozenset(
    "address aside details dialog div dl fieldset figure footer form header hgroup menu nav ol section table ul".split()
)
TEMPLATE_OUTSIDE = TEMPLATE | frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote center".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|</?[a-zA-Z][^\s/>]*+(?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*?(?:>|\Z)",
    re.DOTALL,
)
_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_WORD_EDGE = re.compile(r"[^a-z0-9]+")
_PLAIN_PART = re.compile(r"[a-z]?|[0-9]+(?:x[0-9]+)?")


class _Element:
    __slots__ = ("tag", "parts", "first", "aside", "article", "main", "holds", "named", "prose")

    def __init__(self, tag: str, parts: list[str], first: int, aside: bool, article: bool, main: bool, named: int, prose: bool):
        self.tag, self.parts, self.first, self.aside = tag, parts, first, aside
        self.article, self.main, self.holds = article, main, False
        self.named, self.prose = named, prose


class _Named:
    """An element with the name of an aside, and the text in it."""

    __slots__ = (
        "parent", "names", "container", "in_article", "in_main", "holds_main", "size", "in_articles", "in_mains", "prose", "dropped", "plain",
    )

    def __init__(self, parent: int, names: frozenset[str], container: bool, in_article: bool, in_main: bool):
        self.parent, self.names, self.container = parent, names, container
        self.in_article, self.in_main, self.holds_main = in_article, in_main, False
        # Of its text: all, that of articles, that of main elements outside of them, and prose.
        self.size = self.in_articles = self.in_mains = self.prose = 0
        self.dropped = self.plain = False

    @property
    def chosen(self) -> int:
        """The size of articles in it, and of a main element in it."""
        return 0 if self.in_article else self.in_articles + (0 if self.in_main else self.in_mains)


def _aside_names(value: str) -> frozenset[str]:
    """Names of asides in a class or an id: of those of its words that consist of such names
    and words of layout. ``has-sidebar`` and ``related-work`` name none."""
    found: set[str] = set()
    for word in value.split():
        parts = {part for part in _WORD_EDGE.split(word) if not _PLAIN_PART.fullmatch(part)} - LAYOUT
        if parts and parts <= ASIDE_NAMES:
            found |= parts
    return frozenset(found)


def _is_aside(tag: str, token: str, inside: bool) -> tuple[bool, frozenset[str]]:
    """Whether an element is an aside whatever it holds, and else the aside's names it has."""
    if tag in ASIDE or tag == "header" and not inside:
        return True, frozenset()
    names: frozenset[str] = frozenset()
    if " " not in token and "\n" not in token and "\t" not in token:
        return False, names
    for name, *values in _ATTRIBUTE.findall(token[len(tag) + 1 :].rstrip("/>")):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "role" and value.strip() in ASIDE_ROLES:
            return True, names
        if name in ("class", "id"):
            found = _aside_names(value)
            # An article may itself be a reader's comment.
            if tag == "article" and not COMMENT_NAMES.isdisjoint(found):
                return True, names
            if tag not in ROOTS and (tag in CONTAINERS or not inside):
                names |= found
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True, names
    return False, names


def _has_role(tag: str, token: str, role: str) -> bool:
    if "role" not in token.lower():
        return False
    found = _ATTRIBUTE.findall(token[len(tag) + 1 :].rstrip("/>"))
    # Of attributes with one name the first counts.
    given = next(("".join(values) for name, *values in found if name.lower() == "role"), "")
    return role in given.lower().split()


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Page:
    """One pass over a page: its blocks of text and the hashes of its element subtrees.

    ``templates`` are hashes of subtrees whose blocks are deleted. What elements with the name
    of an aside hold is known at the end only; so each piece of text keeps the innermost one.
    """

    def __init__(self, html: str, templates: frozenset[int] = frozenset()):
        self.subtrees: set[int] = set()
        self._templates = templates
        self._blocks: list[tuple[list[tuple[str, int, bool]], bool, bool]] = []
        self._deleted: list[tuple[list[tuple[str, int, bool]], bool, bool]] = []
        self._text: list[tuple[str, int, bool]] = []
        self._named = [_Named(0, frozenset(), False, False, False)]
        self._open = [_Element("", [], 0, False, False, False, 0, False)]
        #: Where the open elements of each tag stand, the innermost last.
        self._places: dict[str, list[int]] = {}
        self._parse(html)
        while len(self._open) > 1:
            self._close()
        self._end_block()

    def text(self) -> str:
        """Blocks of the article, or else of the main element, or else of the page."""
        if len(self._named) > 1:
            self._judge_named()
        kept = []
        for pieces, article, main in self._blocks:
            left = [p for p in pieces if not self._named[p[1]].dropped]
            text = " ".join("".join(p[0] for p in left).split())
            if text:
                plain = all(self._named[p[1]].plain for p in left)
                kept.append((text, article and not plain, main and not plain))
        for kind in (1, 2):
            chosen = [b[0] for b in kept if b[kind]]
            if chosen:
                return "\n\n".join(chosen)
        return "\n\n".join(b[0] for b in kept)

    def _judge_named(self) -> None:
        """Find the named elements that are asides: all but those around the main element, the
        page's article or most of its prose, deleted blocks included."""
        count = [(named, article, main, prose, len("".join(text.split()))) for pieces, article, main in self._blocks + self._deleted for text, named, prose in pieces]
        outside = outside_chosen = whole = whole_prose = 0
        for named, article, main, prose, size in count:
            whole += size
            whole_prose += size if prose else 0
            if not named:
                outside += size
                outside_chosen += size if article or main else 0
            own = self._named[named]
            own.size += size
            own.prose += size if prose else 0
            own.in_articles += size if article else 0
            own.in_mains += size if main and not article else 0
        # An element comes after the one around it, so each sum is complete when it is passed on.
        for own in reversed(self._named[1:]):
            above = self._named[own.parent]
            above.size += own.size
            above.prose += own.prose
            above.in_articles += own.in_articles
            above.in_mains += own.in_mains
        for own in self._named[1:]:
            around = own.holds_main or own.chosen > outside_chosen and OTHER_NAMES.isdisjoint(own.names)
            # A page without any paragraph has its prose in other elements.
            most = 2 * own.size > whole and (2 * own.prose > whole_prose or not whole_prose)
            most = most and own.container and COMMENT_NAMES.isdisjoint(own.names)
            above = self._named[own.parent]
            own.dropped = above.dropped or not (around or most)
            # A small article beside the text of a page without another is not put before it.
            small = not outside_chosen and 4 * own.chosen < outside
            own.plain = above.plain or small and not (own.in_article or own.holds_main or most)

    def _parse(self, html: str) -> None:
        at = 0
        while True:
            match = _TOKEN.search(html, at)
            self._add_text(html[at : match.start() if match else len(html)])
            if not match:
                return
            token, at = match.group(), match.end()
            if token[1] in "!?":
                continue
            tag = _NAME.search(token, 2 if token[1] == "/" else 1).group().lower()
            if token[1] == "/":
                self._end(tag)
            elif tag in RAW:
                # A raw element's content is no text of the page, but part of the subtree.
                self._start(tag, token)
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
                stop = end.start() if end else len(html)
                self._open[-1].parts.append(html[at:stop])
                at = end.end() if end else len(html)
                self._close()
            elif tag in VOID:
                self._open[-1].parts.append(token)
                if tag == "br":
                    self._add_blank()
                elif tag == "hr":
                    self._end_block()
            else:
                self._start(tag, token)

    def _add_text(self, raw: str) -> None:
        if raw:
            top = self._open[-1]
            top.parts.append(" ".join(raw.split()))
            if not top.aside:
                self._text.append((unescape(raw) if "&" in raw else raw, top.named, top.prose))

    def _add_blank(self) -> None:
        self._text.append((" ", self._open[-1].named, False))

    def _end_block(self) -> None:
        if self._text:
            pieces, self._text = self._text, []
            if any(text and not text.isspace() for text, *_ in pieces):
                top = self._open[-1]
                self._blocks.append((pieces, top.article, top.main))

    def _start(self, tag: str, token: str) -> None:
        if tag in BLOCK:
            self._leave({"p"}, SCOPES)
        if tag in ENDS:
            self._leave(*ENDS[tag])
        if tag in BLOCK:
            self._end_block()
        elif tag in ("td", "th"):
            self._add_blank()
        top = self._open[-1]
        aside, names = (True, None) if top.aside else _is_aside(tag, token, top.article or top.main)
        named = top.named
        if names and not aside:
            named = len(self._named)
            self._named.append(_Named(top.named, names, tag in CONTAINERS or tag in ("td", "th"), top.article, top.main))
        article = not aside and (top.article or tag == "article")
        main = not aside and (top.main or tag == "main" or _has_role(tag, token, "main"))
        if (article and not top.article) or (main and not top.main):
            for element in reversed(self._open):
                if element.holds:
                    break  # and so do those around it
                element.holds = True
        at = named if main and not top.main else 0
        while at and not self._named[at].holds_main:
            self._named[at].holds_main = True
            at = self._named[at].parent
        prose = tag != "a" and (top.prose or tag in PROSE)
        self._places.setdefault(tag, []).append(len(self._open))
        self._open.append(_Element(tag, [token], len(self._blocks), aside, article, main, named, prose))

    def _innermost(self, tags) -> int:
        """Where the innermost open element of ``tags`` stands; 0 if there is none."""
        return max((places[-1] for t in tags if (places := self._places.get(t))), default=0)

    def _leave(self, tags: set[str], scope) -> None:
        """Close an open element of ``tags``, if one is open within the scope."""
        at = self._innermost(tags)
        if at and at >= self._innermost(scope):
            while len(self._open) > at:
                self._close()

    def _end(self, tag: str) -> None:
        at = self._innermost((tag,))
        while at and len(self._open) > at:
            self._close()
        if not at and tag == "p":
            self._end_block()

    def _close(self) -> None:
        top = self._open[-1]
        if top.tag in BLOCK:
            self._end_block()
        digest = _digest("\0".join(top.parts))
        self._open.pop()
        self._places[top.tag].pop()
        self._open[-1].parts.append(f"{digest:x}")
        inside = top.article or top.main
        if not top.holds and top.tag in (TEMPLATE if inside else TEMPLATE_OUTSIDE) and top.tag not in ROOTS:
            self.subtrees.add(digest)
            if digest in self._templates:
                self._deleted += self._blocks[top.first :]
                del self._blocks[top.first :]


@dataclass(frozen=True)
class SiteTemplates:
    """A subtree is a template if it is beside ``pages`` different main texts of its host or
    more, and beside ``share`` of them. Up to ``broadcast`` template subtrees go to all executors."""

    pages: int = 5
    share: float = 0.3
    broadcast: int = 100_000


def _host(url: str = "url"):
    return F.lower(F.regexp_extract(F.trim(F.col(url)), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def templates(pages: DataFrame, how: SiteTemplates = SiteTemplates()) -> DataFrame:
    """Hosts and the hashes of their template subtrees, from the columns url and html.

    Pages of a host with equal main texts, templates included, count once, so that copies do
    not make a template of their text, whatever else on them differs.
    """

    def subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            main, found = [], []
            for html in batch["html"]:
                page = Page(html)
                main.append(_digest(page.text()))
                found.append([0, *page.subtrees])
            yield pd.DataFrame({"host": batch["host"].array, "main": main, "subtree": found}).explode("subtree")

    read = pages.select(_host().alias("host"), "html").where("host <> '' and html is not null")
    found = read.mapInPandas(subtrees, "host string, main long, subtree long")
    # Subtree 0 stands for the main text.
    counted = materialized(found.distinct().groupBy("host", "subtree").agg(F.count("*").alias("n")).where((F.col("n") >= how.pages)), "subtrees")
    sizes = counted.where("subtree = 0").select("host", F.col("n").alias("pages"))
    return counted.where("subtree <> 0").join(sizes, "host").where(F.col("n") >= how.share * F.col("pages")).select("host", "subtree")


def with_main_text(pages: DataFrame, how: SiteTemplates = SiteTemplates(), text: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html`` as the column ``text``, which is replaced.

    Blocks of the article are joined by two line feeds; white space within a block is one
    blank, character references are decoded. Left out are menus, headers, footers, sidebars,
    notices, adverts, forms, scripts, styles and reader comments, by their elements, roles and
    names, and all template subtrees of the host that are not part of an article's prose. A
    page that would so lose all its text keeps what the names leave. A null, empty or
    textless page gives the empty text; a page without a host has no templates.

    A host has at most a few template subtrees (their shares of its pages add up to the
    subtrees of a page), so the list is joined by host, broadcast where its count allows.
    """
    found = materialized(templates(pages, how), "templates")
    host, listed = unused_name(pages, "_host"), unused_name(pages, "_templates")
    by_host = found.groupBy(F.col("host").alias(host)).agg(F.sort_array(F.collect_list("subtree")).alias(listed))
    if found.count() <= how.broadcast:
        by_host = F.broadcast(by_host)

    @F.pandas_udf("string")
    def main_text(html: pd.Series, subtrees: pd.Series) -> pd.Series:
        out = []
        for page, hashes in zip(html, subtrees, strict=True):
            own = frozenset() if hashes is None else frozenset(int(h) for h in hashes)
            got = Page(page or "", own).text()
            out.append(got or (Page(page or "").text() if own else ""))
        return pd.Series(out, dtype="object")

    return pages.withColumn(host, _host()).join(by_host, host, "left").withColumn(text, main_text(F.col("html"), F.col(listed))).drop(host, listed)
