"""HTML extraction by tree scoring.

Blocks of text pass points for length and commas to their ancestors, discounted
by link density. The ancestor with the most points is the main container; the
article around it is kept, or else it and those siblings that read like text.
Menus, headers, footers, sidebars, notices, adverts, forms and reader comments are
told by element, role and the words of class and id. Such a mark is a doubt, not a
verdict: it is dropped where the container holds the page's article after all.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handbill.llm.common import ship

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What follows a tag's name, up to its end; a ">" in quotes doesn't end it.
QUOTED = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
HIDDEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table
    tbody tfoot thead tr ul caption colgroup""".split()
)
#: Elements whose content is no markup, and no text of the page either.
RAW = frozenset("script style textarea title iframe noembed noframes noscript template svg xmp plaintext".split())
#: Elements without text of the article, whatever they hold.
HARD = frozenset("button canvas audio video object head input label legend select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
WEAK, MIXED, STRONG = 1, 2, 3
#: Elements that are doubted, and how much: a strong doubt is never dropped for what it holds.
TAGS = {"form": WEAK, "fieldset": WEAK, "header": WEAK, "aside": WEAK, "nav": STRONG, "menu": STRONG, "footer": STRONG, "dialog": STRONG, "search": STRONG}
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
#: Words of class and id that mark what isn't the article: those that say it plainly, and those of layouts too.
PLAIN = frozenset(
    """ad ads adsense advert adverts advertisement advertising sponsor sponsored nav navbar navigation menu menus breadcrumb
    breadcrumbs comment comments commentlist disqus respond replies cookie cookies consent gdpr newsletter outbrain taboola
    pagination pager""".split()
)
LAYOUT = frozenset(
    """promo promotion banner sidebar aside rail footer masthead topbar discussion notice notices notification alert popup
    modal overlay subscribe subscription signup login share sharing social related recommended recommendations widget
    widgets toolbar copyright disclaimer skip""".split()
)
#: Words that may stand beside such a word without changing what the name says.
FILL = frozenset(
    """area bar body block box button buttons col column container content entry footer group head header holder inner
    item items left link links list main message page panel post right section site slot text thread title top unit
    wrap wrapper zone bottom article""".split()
)
#: What an open element of the key ends when one of the values begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}, "tbody": {"tbody", "tfoot"}, "thead": {"tbody", "tfoot"}}
ENDED = {t: {k for k, v in ENDS.items() if t in v} | {"p"} for t in BLOCKS}
SCOPES = frozenset("table ul ol dl div article section main body html aside nav".split())
LISTS = frozenset("ul ol dl menu".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAX_LINK_SHARE = 0.6
#: A list of that many links is a menu, unless the article introduces it or its links read like titles: of that many characters on average.
MENU_LINKS = 3
TITLE_CHARS = 25
SIBLING_SHARE = 0.2
MIN_SIBLING = 5.0
#: A doubt is dropped if the text beyond all doubts has at most this share of the container's points.
LEFT_SHARE = 0.1


def doubt_of(names: str) -> int:
    """How far class and id mark an element, each name by itself.

    A name all of whose words say so is a strong doubt if one says it plainly, else
    a weak one. A plain word among words of other kinds ("reader-comments") lies between: articles in it count for nothing.
    """
    worst = 0
    for name in names.split():
        words = [w.lower() for w in PART.findall(name)]
        plain = [w in PLAIN or (w.startswith("ad") and w[2:].rstrip("s") in FILL) for w in words]
        told = [p or w in LAYOUT for p, w in zip(plain, words)]
        if any(told):
            every = all(t or w in FILL or w.rstrip("s") in FILL or w.isdigit() for t, w in zip(told, words))
            worst = max(worst, STRONG if every and any(plain) else MIXED if any(plain) else WEAK if every else 0)
    return worst


class Page:
    """Elements as parallel lists (tag, parent, doubt) and blocks as (element, text, characters in links).

    Elements within a line are followed only where they are marked, and then cut
    for good, unless not ``inline``.
    """

    def __init__(self, source: str, inline: bool = True) -> None:
        self.inline, self.cut_inline = inline, False
        self.tags, self.parents, self.doubts, self.named, self.gone = ["html"], [-1], [0], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self.stack = [0]
        # Places in the stack: of the open elements of each tag, and of those beyond which none is ended by a new one.
        self.places: dict[str, list[int]] = {"html": [0]}
        self.scopes = [0]
        self.pieces: list[str] = []
        self.linked = 0
        self.in_link = False
        self.read(source)

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                at = len(self.stack) - 1
                while at and self.tags[self.stack[at]] not in BLOCKS:
                    at -= 1
                self.blocks.append((self.stack[at], text, min(self.linked, len(text))))
            self.pieces, self.linked = [], 0

    def text(self, raw: str) -> None:
        if raw and not self.gone[self.stack[-1]]:
            text = html.unescape(raw)
            self.pieces.append(text)
            if self.in_link:
                self.linked += len(" ".join(text.split()))

    def open(self, tag: str, doubt: int, hard: bool, named: bool) -> None:
        parent = self.stack[-1]
        self.tags.append(tag)
        self.parents.append(parent)
        self.doubts.append(doubt)
        self.named.append(named)
        self.gone.append(self.gone[parent] or hard)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append(len(self.tags) - 1)

    def close(self, at: int) -> None:
        """Ends the open elements from place ``at`` of the stack on; their blocks end, a line goes on."""
        if any(self.tags[i] in BLOCKS for i in self.stack[at:]):
            self.flush()
            self.in_link = False
        while len(self.stack) > at:
            tag = self.tags[self.stack.pop()]
            self.places[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()

    def end_open(self, tags: set[str]) -> None:
        """Ends the innermost open element of ``tags``, unless a scope stands between."""
        at = max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)
        if at > self.scopes[-1]:
            self.close(at)

    def judged(self, tag: str, attributes: str) -> tuple[int, bool, bool]:
        """(doubt, whether it goes whatever it holds, whether names made the doubt) of an element."""
        if tag in HARD:
            return 0, True, False
        by_tag = TAGS.get(tag, 0)
        if tag == "header" and any(self.places.get(t) for t in MAIN):
            by_tag = 0
        doubt = by_tag
        if attributes and not attributes.isspace() and tag not in ("html", "body"):
            found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
            if "hidden" in found or found.get("aria-hidden") == "true" or HIDDEN.search(found.get("style") or ""):
                return doubt, True, False
            if (found.get("role") or "").lower() in ROLES:
                doubt = STRONG
            doubt = max(doubt, doubt_of(f"{found.get('class') or ''} {found.get('id') or ''}"))
        return doubt, False, doubt > by_tag

    def read(self, source: str) -> None:
        at, quotes = 0, True
        while (begin := source.find("<", at)) >= 0:
            if source.startswith("<!--", begin):
                self.text(source[at:begin])
                short = source.startswith((">", "->"), begin + 4)
                stop = COMMENT_END.search(source, begin + 4)
                at = source.index(">", begin) + 1 if short else len(source) if stop is None else stop.end()
                continue
            closing = source.startswith("/", begin + 1)
            name = NAME.match(source, begin + 1 + closing)
            if name is None and not source.startswith(("!", "?", "/"), begin + 1):
                self.text(source[at : begin + 1])
                at = begin + 1
                continue
            # Once the quotes of a tag run to the page's end, quotes don't count any more; so no tag is looked for twice.
            m = QUOTED.match(source, name.end()) if name and quotes else None
            quotes = quotes and (m is not None or name is None)
            end = m.end() - 1 if m else source.find(">", name.end() if name else begin)
            if end < 0:
                break
            self.text(source[at:begin])
            at = end + 1
            if name is None:
                continue
            tag, attributes = name[0].lower(), source[name.end() : end]
            if closing:
                self.end(tag)
            elif tag in RAW and not attributes.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(source, at)
                after = -1 if stop is None else source.find(">", stop.end())
                at = len(source) if after < 0 else after + 1
            else:
                self.start(tag, attributes)
        self.text(source[at:])
        self.flush()

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
            self.end_open(ENDED[tag])
        elif tag == "a":
            self.in_link = True
        elif tag in ("br", "td", "th"):
            self.pieces.append(" ")
        if tag in VOID or (tag in ("html", "body") and self.places.get(tag)):
            return
        if tag in BLOCKS:
            self.open(tag, *self.judged(tag, attributes))
        else:
            doubt, hard, _ = self.judged(tag, attributes) if tag in HARD or attributes else (0, False, False)
            marked = hard or (doubt > 0 and self.inline)
            self.cut_inline |= marked and tag not in HARD
            if (marked and (self.inline or tag in HARD)) or self.tags[self.stack[-1]] not in BLOCKS:
                self.open(tag, 0, marked, False)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        elif tag in ("td", "th"):
            self.pieces.append(" ")
        if tag in ("body", "html"):
            self.flush()
        elif self.places.get(tag):
            self.close(self.places[tag][-1])
        elif tag in BLOCKS:
            self.flush()


def sums(values: list[float], parents: list[int], share: float = 1.0) -> list[float]:
    """Each element's value with ``share`` of its children's sums; parents stand before their children."""
    out = list(values)
    for i in range(len(out) - 1, 0, -1):
        out[parents[i]] += share * out[i]
    return out


def points_of(text: str, linked: int) -> float:
    """What a block is worth: length and commas, discounted by link density, little if it is short."""
    gained = (1 + text.count(",") + text.count("、") + min(len(text) / 100, 3.0)) * (1 - linked / len(text))
    return gained if len(text) >= 25 else gained * 0.25


def cut_elements(page: Page, gained: list[float]) -> list[bool]:
    """Which elements are cut: those in doubt, unless they hold the article.

    A weak doubt is dropped for a container with at least half of its points in an
    undoubted article or main element, and any but a strong one for a container with
    most points of the page where hardly any lie beyond all doubts. If
    all text would go, the named container with the most points stays.
    """
    n, parents, doubts = len(page.tags), page.parents, page.doubts
    clean = [True] * n
    for i in range(n):
        clean[i] = doubts[i] == 0 and (i == 0 or clean[parents[i]])
    everything = sums(gained, parents)
    beyond = sum(g for g, c in zip(gained, clean) if c)
    held = [0.0] * n
    for i in range(n - 1, 0, -1):
        held[parents[i]] += everything[i] if page.tags[i] in MAIN and not doubts[i] else held[i]
    holds = lambda i: doubts[i] == WEAK and 2 * held[i] >= everything[i]
    most = lambda i: 2 * everything[i] >= everything[0] and beyond <= LEFT_SHARE * everything[i]
    dropped = [doubts[i] in (WEAK, MIXED) and everything[i] > 0 and (holds(i) or most(i)) for i in range(n)]

    def spread() -> list[bool]:
        out = [False] * n
        for i in range(1, n):
            out[i] = out[parents[i]] or (doubts[i] > 0 and not dropped[i])
        return out

    cut = spread()
    if all(cut[node] for node, *_ in page.blocks):
        named = [i for i in range(n) if page.named[i] and everything[i] >= 1]
        if named:
            best = max(named, key=lambda i: (everything[i], -i))
            while best > 0:
                dropped[best] = True
                best = parents[best]
            cut = spread()
    return cut


def kept_elements(page: Page, cut: list[bool], gained: list[float]) -> list[bool]:
    """Which elements lie in the main container, or in a sibling of it that reads like text."""
    n, tags, parents = len(page.tags), page.tags, page.parents
    own, chars, links, menus = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    for (node, text, linked), g in zip(page.blocks, gained):
        if cut[node]:
            continue
        # A paragraph's points go to what holds it; a container has its own loose text.
        own[node if tags[node] in ("div", "article", "section", "main", "body", "html", "blockquote", "tr") or node == 0 else parents[node]] += g
        chars[node] += len(text)
        links[node] += linked
        menus[node] += linked > 0
    score, chars, links, menus = sums(own, parents, 0.5), sums(chars, parents), sums(links, parents), sums(menus, parents)
    density = [b / a if a else 0.0 for a, b in zip(chars, links)]
    value = [score[i] * (1 - density[i]) * (1.5 if tags[i] in MAIN else 1.0) for i in range(n)]
    best = max(range(n), key=lambda i: (value[i], -i))
    around = best
    while around > 0 and tags[around] not in MAIN:
        around = parents[around]
    whole = tags[around] in MAIN
    kept = [False] * n
    kept[around if whole else best] = True
    inside = around
    while whole and inside > 0 and tags[inside] != "main":
        inside = parents[inside]
    if whole and tags[around] == "article" and inside > 0:
        # A page's main element may hold several articles: each that isn't doubted and reads like text is kept.
        under = [False] * n
        for i in range(inside + 1, n):
            under[i] = parents[i] == inside or under[parents[i]]
            kept[i] = kept[i] or (under[i] and tags[i] == "article" and not cut[i] and density[i] < 0.25)
    if not whole and best:
        # Which elements hold a paragraph or heading of their own.
        prose = [False] * n
        for node, text, linked in page.blocks:
            prose[node] = prose[node] or ((tags[node] == "p" or tags[node] in HEADINGS) and not cut[node] and linked < len(text) / 4)
        for i in range(n - 1, 0, -1):
            prose[parents[i]] = prose[parents[i]] or prose[i]
        for i in range(1, n):
            if i != best and parents[i] == parents[best] and chars[i] and not cut[i]:
                text_like = density[i] <= MAX_LINK_SHARE if tags[i] in PROSE else density[i] < 0.25 and (chars[i] > 80 or prose[i])
                kept[i] = text_like or value[i] >= max(MIN_SIBLING, SIBLING_SHARE * value[best])
    before = [0] * n  # the element before each among those of one parent
    last: dict[int, int] = {}
    for i in range(1, n):
        before[i], last[parents[i]] = last.get(parents[i], 0), i
    for i in range(1, n):
        titled = whole and (tags[before[i]] in HEADINGS or chars[i] >= TITLE_CHARS * menus[i])
        menu = tags[i] in LISTS and density[i] > MAX_LINK_SHARE and menus[i] >= MENU_LINKS and not titled
        kept[i] = (kept[i] or kept[parents[i]]) and not menu and not cut[i]
    return kept


def main_text(source: str | None, inline: bool = True) -> str:
    """The blocks of the main text, one a line; empty for a page without text. ``inline`` cuts marked elements within a line."""
    page = Page(source or "", inline)
    if page.blocks:
        worth = [points_of(text, linked) for _, text, linked in page.blocks]
        by_node = [0.0] * len(page.tags)
        for (node, *_), g in zip(page.blocks, worth):
            by_node[node] += g
        kept = kept_elements(page, cut_elements(page, by_node), worth)
        found = "\n".join(text for node, text, _ in page.blocks if kept[node])
    else:
        found = ""
    # A mark within a line that swallowed all of the page was none.
    return main_text(source, False) if not found and inline and page.cut_inline else found


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every row of ``pages``, from the whole source.

    A null, empty or textless page has empty text. Rows that share an id, or
    have none, keep a row each. Broken markup is read as browsers do in the common
    cases: unclosed paragraphs and list items, stray end tags, unclosed comments.
    A very long page is read whole, in time and memory linear in its length, however
    deep it nests or broken it is. Of containers with equal points the first is taken.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string")
