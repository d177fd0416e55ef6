"""Main text of web pages from flat text blocks.

A page is cut into blocks of text at block-level tags. A block is described by its
words and link density and those of the blocks before and after it, by whether it
stands in the article or in an element for menus, footers, forms and the like, by a
weak hint from class names, and by whether it is a heading. A decision tree tells
which blocks are main text. A list of links counts as a menu, also in the article. It is grown from the small labelled pages below, whose
blocks are cut and described just as any other page's.

Edge cases: null and empty pages have an empty text; unclosed and stray tags,
unended comments and unquoted attributes are read as far as they go; a page that
would have no text but for class names like "search-results" keeps its long blocks
of such names; long pages are read whole; repeated rows are extracted one by one; an empty table gives an
empty result; columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import map_rows

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
NAME_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
LABEL = re.compile(r"(?:(?<=>)|^)[+-]")
FILLER = re.compile(r"\{(\d+)\}")
#: Elements whose content isn't text of the page.
RAW = {"script", "style", "template", "noscript", "iframe", "svg", "math", "object", "canvas", "textarea", "select", "head", "title"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p",
    "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
FURNITURE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "address", "label", "header"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
#: Words that class names and ids of furniture begin or end with.
HINT_NAMES = {
    "ad", "ads", "adsense", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "byline", "captcha", "comment", "commentlist",
    "comments", "consent", "cookie", "cookies", "copyright", "disclaimer", "discussion", "disqus", "feedback", "foot", "footer", "form", "gdpr", "guestbook", "header",
    "login", "marketing", "masthead", "menu", "mkt", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "opinions", "pager", "pagination",
    "paywall", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "reply", "respond", "responses", "reviews", "search", "share", "sharing",
    "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "teaser", "toc", "toolbar", "topbar", "trending", "widget",
}
#: Those that tell in any compound, also where a page would have no text without it.
SURE_NAMES = {
    "ad", "ads", "adsense", "advert", "advertisement", "adverts", "banner", "captcha", "comment", "commentlist", "comments", "consent", "cookie", "cookies", "disqus",
    "gdpr", "login", "newsletter", "paywall", "promo", "promoted", "promotion", "signup", "sponsor", "sponsored", "subscribe",
}
#: Words of a block that class names alone don't take from a page without other text.
LONG_BLOCK = 20
#: Beginnings of names that tell about a whole page's layout.
LAYOUT = {"has", "with", "without", "no", "is", "not", "wrap", "wrapper", "page", "layout", "site", "body"}
ARTICLE_TAGS = {"article", "main"}
ARTICLE_NAMES = {"article", "content", "entry", "main", "post", "story"}
#: What a heading over readers' comments starts with, after a number.
COMMENT_HEADING = re.compile(r"(?i)^\d*\s*(?:reader |user )?(?:comments?|repl(?:y|ies)|responses?|opinions|leave a (?:comment|reply)|kommentare?|commentaires?|comentarios?)\b")


@dataclass
class Block:
    text: str
    words: int
    density: float
    furniture: bool
    hint: bool
    article: bool
    heading: bool
    sure: bool = False


@dataclass
class Open:
    """An open element, and what the blocks in it inherit."""

    tag: str
    furniture: bool = False
    hint: bool = False
    article: bool = False
    comments: bool = False
    sure: bool = False


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def _kind(tag: str, attributes: str, outer: Open) -> Open:
    """What an element is in the one around it."""
    furniture, hint, sure, article = tag in FURNITURE_TAGS, False, False, tag in ARTICLE_TAGS
    if attributes and tag not in ("a", "html", "body"):
        values = _attributes(attributes)
        names = [[part.lower() for part in NAME_PARTS.split(name) if part] for name in f"{values.get('class', '')} {values.get('id', '')}".split()]
        # "post-header" is the head of an article, neither the site's nor the article.
        names = [parts for parts in names if parts and parts[0] not in LAYOUT and not (parts[0] in ARTICLE_NAMES and parts[-1] == "header")]
        holds = any(parts[0] in ARTICLE_NAMES or parts[-1] in ARTICLE_NAMES for parts in names)
        found = {part for parts in names for part in (parts[0], parts[-1]) if part in HINT_NAMES}
        if outer.article:
            found -= {"header"}  # the head of an article is part of it
        named = bool(found) or "comment" in values.get("itemprop", "").lower()
        # "post-comments" is about comments; "main sidebar-right" is about the main column.
        hint = named and not article and not (holds and any(len(parts) == 1 and parts[0] in ARTICLE_NAMES for parts in names))
        one_sided = [parts for parts in names if len(parts) > 1 and (parts[0] in HINT_NAMES) != (parts[-1] in HINT_NAMES) and not SURE_NAMES.intersection(parts)]
        sure = hint and not all(parts in one_sided for parts in names if found.intersection((parts[0], parts[-1])))
        role = values.get("role", "").lower()
        article = article or role in ("main", "article") or (holds and not hint)
        hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "")
        furniture = furniture or hidden or role in FURNITURE_ROLES
    if tag == "header" and outer.article:
        furniture = False
    # A name around an article tells of the page's layout, not of the article.
    inherits = not (tag in ARTICLE_TAGS and not outer.article)
    return Open(tag, outer.furniture or furniture, (inherits and outer.hint) or hint, outer.article or article, outer.comments, (inherits and outer.sure) or sure)


class Stack:
    """Open elements, with the places of each tag, so that no step looks through all of them."""

    def __init__(self) -> None:
        self.all: list[Open] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.headings: list[int] = []
        self.links = 0

    def push(self, element: Open) -> None:
        k, tag = len(self.all), element.tag
        self.all.append(element)
        self.places.setdefault(tag, []).append(k)
        if tag in BLOCKS:
            self.blocks.append(k)
        if tag in HEADINGS:
            self.headings.append(k)
        self.links += tag == "a"

    def close(self, k: int) -> None:
        """Closes the element at ``k`` and all in it."""
        while len(self.all) > k:
            tag = self.all.pop().tag
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            if tag in HEADINGS:
                self.headings.pop()
            self.links -= tag == "a"

    def last(self, tag: str) -> int:
        """The place of the innermost element of a tag, or -1."""
        places = self.places.get(tag)
        return places[-1] if places else -1


def text_blocks(page: str) -> list[Block]:
    """The page's blocks of text, in order."""
    blocks: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack, page_open = Stack(), Open("")

    def flush() -> None:
        if parts:
            words = "".join(parts).split()
            if words:
                of_links = len("".join(linked).split())
                own = stack.all[-1] if stack.all else page_open
                heading = bool(stack.headings)
                text = " ".join(words)
                if heading and COMMENT_HEADING.match(text) and len(words) <= 6:
                    # What follows it in the element that holds it is comments; elements inherit that.
                    k = stack.headings[-1]
                    holder = stack.all[k - 1] if k else page_open
                    if not holder.comments:
                        for each in (holder, *stack.all[k:]):
                            each.comments = True
                blocks.append(Block(text, len(words), min(1.0, of_links / len(words)), own.furniture, own.hint or own.comments, own.article, heading, own.sure or own.comments))
            parts.clear()
            linked.clear()

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if stack.links:
                linked.append(text)

    at, size, head_ends = 0, len(page), True
    while at < size:
        match = TOKEN.search(page, at)
        if not match:
            add(page[at:])
            break
        add(page[at : match.start()])
        at = match.end()
        if not match[2]:
            continue
        tag, closing = match[2].lower(), bool(match[1])
        if tag in RAW and not closing:
            if not match[3].rstrip().endswith("/") and (tag != "head" or head_ends):
                end = re.compile(rf"</{tag}\b[^>]*>" if tag != "head" else r"</head\b[^>]*>|(?=<body\b)", re.I).search(page, at)
                at = end.end() if end else at if tag == "head" else size
                head_ends = head_ends and (tag != "head" or end is not None)  # none from here on
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS:
            flush()
        if closing:
            if (k := stack.last(tag)) >= 0:
                stack.close(k)
            continue
        if tag in VOID or match[3].rstrip().endswith("/"):
            continue
        if tag in BLOCKS and (k := stack.last("p")) >= 0 and stack.blocks[-1] == k:  # a block ends an open paragraph
            stack.close(k)
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack.all and stack.all[-1].tag == tag:
            stack.close(len(stack.all) - 1)
        stack.push(_kind(tag, match[3], stack.all[-1] if stack.all else page_open))
    flush()
    return blocks


FEATURES = ("words_before", "density_before", "words", "density", "words_after", "density_after", "furniture", "hint", "article", "heading")


def features(blocks: Sequence[Block]) -> list[tuple[float, ...]]:
    """The features of each block; ``article`` is 1 in the article, 0 beside it and 0.5 on a page that marks none."""
    marked = any(block.article for block in blocks)
    out = []
    for k, own in enumerate(blocks):
        before, after = blocks[k - 1] if k else None, blocks[k + 1] if k + 1 < len(blocks) else None
        out.append((
            before.words if before else 0, before.density if before else 0.0, own.words, own.density, after.words if after else 0, after.density if after else 0.0,
            float(own.furniture), float(own.hint), float(own.article) if marked else 0.5, float(own.heading),
        ))
    return out


#: Labelled pages: a block that starts with + is main text, one with - isn't; {n} stands for n words.
PAGES = (
    "<nav><ul><li><a>-{1}</a><li><a>-{1}</a><li><a>-{2}</a></ul></nav><div class=ad>-{9}</div><article><h1>+{8}</h1><p>+{60}<p>+{1}<p>+{40}<p>+{4}<p>+{12}</article><footer>-{14}</footer>",
    "<header><div>-{2}</div><nav><a>-{1}</a></nav></header><main><h1>+{6}</h1><p>+{35}</p><p>+{90}</p><aside>-{30}</aside><p>+{3}</p><h2>+{4}</h2><p>+{50}</p></main><footer><p>-{12}</p><p>-{40}</p></footer>",
    "<div class='wrap has-sidebar'><article><header><h1>+{9}</h1><p>+{14}</p></header><p>+{80}</p><ul><li>+{5}</li><li>+{7}</li><li>+{2}</li></ul><p>+{60}</p></article></div><div class=sidebar><h3>-{2}</h3><p>-{25}</p></div>",
    "<article><h1>+{7}</h1><p>+{70}</p><p><a>+{8}</a></p><p>+{55}</p><p><a>+{3}</a></p><p>+{48}</p><p>+{6} <a>{3}</a></p><p>+{30}</p></article>",
    "<article><h1>+{5}</h1><p>+{50}</p><p>+{9}</p><ul><li><a>-{6}</a></li><li><a>-{8}</a></li><li><a>-{5}</a></li><li><a>-{9}</a></li></ul></article><div>-{3}</div>",
    "<article><p>+{66}</p><p class=mkt>-{12}</p><p>+{45}</p><div class=newsletter-signup><p>-{10}</p></div><p>+{2}</p><section class=comments><p>-{25}</p><p>-{60}</p><p>-{4}</p></section></article>",
    "<article><h1>+{8}</h1><p>+{40}</p><p>+{33}</p><div><h3>-Comments</h3><p>-{3}</p><p>-{28}</p><p>-{70}</p></div></article>",
    "<div><a>-{1}</a><a>-{1}</a></div><div>-{4}</div><div><h1>+{7}</h1><div>+{70}</div><div>+{85}</div><div>+{10}</div><div>+{60}</div></div><div>-{5}</div><div><a>-{2}</a></div><div><a>-{3}</a></div>",
    "<div><a>-{2}</a></div><div><a>-{1}</a></div><h1>+{6}</h1><p>+{50}</p><p>+{8}</p><p>+{64}</p><h2>+{3}</h2><p>+{44}</p><p>+{12}</p><p>+{39}</p><div><a>-{4}</a></div><div>-{7}</div>",
    "<table><tr><td><a>-{1}</a><td><a>-{2}</a></table><table><tr><td>+{120}<tr><td>+{75}</table><table><tr><td>-{6}<td><a>-{1}</a></table>",
    "<p>+{30}</p><p>+{30}</p>", "<p>+{200}</p>", "<div>+{80}</div><div>+{15}</div><div>+{90}</div>", "+{45}",
    "<div><a>-{3}</a></div><h3>-{3}</h3><div><a>-{6}</a></div><div><a>-{7}</a></div><h1>+{9}</h1><p>+{75}</p><p>+{20}</p><p>+{65}</p><h3>-{2}</h3><div><a>-{8}</a></div><div><a>-{6}</a></div>",
    "<div>-{3} <a>{4}</a></div><div>-{2}</div><div><a>-{5}</a></div><p>+{55}</p><p>+{14} <a>{6}</a></p><p>+{48}</p><div><a>-{2}</a> {1} <a>{3}</a></div>",
    "<main><h1>+{6}</h1><p>+{1}</p><p>+{2}</p><p>+{1}</p></main>", "<article><p>+{3}</p></article>", "<article><h1>+{4}</h1></article><p>-{20}</p>",
    "<article><h1>+{3}</h1><p>+{8}</p><h2>+{1}</h2><p>+{26}</p><h2>+{2}</h2><p>+{3}</p><h3>+{1}</h3><p>+{60}</p><h2>+{3}</h2><p>+{2}</p></article>",
    "<article><h1>+{2}</h1><p>+{1}</p><p>+{22}</p><p><a>+{5}</a></p><p>+{18}</p><p><a>+{12}</a></p><p>+{31}</p></article><h3>-{2}</h3><p>-{15}</p>",
    "<article><p>+{40}</p><p><a>+{4}</a></p><p>+{28}</p></article><footer>-{6}</footer>", "<main><p>+{35}</p><p><a>+{9}</a></p><p>+{3}</p></main>",
    "<article><p>+{28}</p><p><a>+{2}</a></p><p>+{14}</p><p>+{5}</p></article>", "<article><p>+{47}</p><p><a>+{6}</a></p><p>+{41}</p><p>+{1}</p></article><div>-{9}</div>",
    "<article><p>+{30}</p><p>+{72}</p><ul><li><a>-{6}</a></li><li><a>-{4}</a></li><li><a>-{7}</a></li></ul><p>+{20}</p><ul><li><a>-{9}</a></li><li><a>-{8}</a></li></ul></article>",
    "<main><p>+{64}</p><p><a>+{2}</a></p><p>+{9}</p><ol><li>+{12}</li><li>+{3}</li></ol><p>+{80}</p><p><a>-{3}</a></p><p><a>-{2}</a></p><p><a>-{4}</a></p></main>",
    "<div class=cookie-notice><p>-{35}</p><button>-{1}</button></div><div id=content><h1>+{5}</h1><p>+{42}</p><blockquote>+{18}</blockquote><p>+{7}</p><form><label>-{1}</label></form><p>+{61}</p></div><div class=related><p>-{22}</p></div>",
    "<article><h1>+{10}</h1><div class=byline>-{4}</div><figure><figcaption>+{11}</figcaption></figure><p>+{52}</p><div class=share><a>-{1}</a><a>-{1}</a></div><p>+{47}</p><div class=tags><a>-{1}</a><a>-{2}</a></div></article><aside><p>-{40}</p></aside>",
    "<p>-{6}</p><p>-{90}</p><article><p>+{44}</p><p>+{5}</p></article><p>-{35}</p><p>-{3}</p>",
    "<div>-{45}</div><main><p>+{30}</p></main><div>-{110}</div>",
    "<div><a>-{10}</a></div><div><a>-{12}</a></div><div><a>-{9}</a></div><div>-{6}</div><div><a>-{14}</a></div>",
    "<h2>-{3}</h2><ul><li><a>-{7}</a><li><a>-{6}</a></ul><h2>-{2}</h2><ul><li><a>-{5}</a></ul>",
    "<div class=modal><p>-{50}</p></div><div class=popup>-{8}</div><p>+{58}</p><p>+{4}</p><p>+{39}</p><div class=sponsored><p>-{38}</p></div><p>+{33}</p>",
)


def labelled_rows(pages: Sequence[str] = PAGES) -> list[tuple]:
    """The features of each block of labelled pages, then 1 for main text."""
    rows = []
    for page in pages:
        filled = FILLER.sub(lambda m: " ".join(["word"] * int(m[1])), page)
        labels = [int(block.text[0] == "+") for block in text_blocks(filled)]
        rows += [(*found, label) for found, label in zip(features(text_blocks(LABEL.sub("", filled))), labels)]
    return rows


@dataclass(frozen=True)
class Leaf:
    share: float


@dataclass(frozen=True)
class Split:
    feature: int
    at: float
    low: Leaf | Split
    high: Leaf | Split


def grow(rows: Sequence[tuple], depth: int = 8, least: int = 2) -> Leaf | Split:
    """A decision tree of the least Gini impurity; the last value of a row is its label."""
    share = sum(row[-1] for row in rows) / len(rows)
    if depth == 0 or share in (0, 1) or len(rows) < 2 * least:
        return Leaf(share)
    impurity = lambda part: (p := sum(row[-1] for row in part) / len(part)) * (1 - p) * len(part)
    best = None
    for feature in range(len(rows[0]) - 1):
        values = sorted({row[feature] for row in rows})
        for low, high in zip(values, values[1:]):
            at = (low + high) / 2
            left, right = [r for r in rows if r[feature] <= at], [r for r in rows if r[feature] > at]
            if min(len(left), len(right)) >= least and (best is None or impurity(left) + impurity(right) < best[0] - 1e-12):
                best = impurity(left) + impurity(right), feature, at, left, right
    if best is None or best[0] >= share * (1 - share) * len(rows) - 1e-12:
        return Leaf(share)
    return Split(best[1], best[2], grow(best[3], depth - 1, least), grow(best[4], depth - 1, least))


def is_main(tree: Leaf | Split, row: Sequence[float]) -> bool:
    while isinstance(tree, Split):
        tree = tree.low if row[tree.feature] <= tree.at else tree.high
    return tree.share > 0.5


def main_text(page: str | None, tree: Leaf | Split) -> tuple[str, int, int]:
    """Main text, its number of blocks and the page's."""
    blocks = text_blocks(page or "")
    kept = [block.text for block, found in zip(blocks, features(blocks)) if is_main(tree, found)]
    if not kept and any(block.hint and not block.sure and block.words >= LONG_BLOCK for block in blocks):
        told = [replace(block, hint=block.sure) for block in blocks]
        kept = [block.text for block, found in zip(told, features(told)) if is_main(tree, found)]
    return "\n".join(kept), len(kept), len(blocks)


def extract_pages(df: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: Sequence[str] = ("url",), labelled: Sequence[str] = PAGES) -> DataFrame:
    """Per row: its id, the columns to ``carry`` along, text, n_chars, n_blocks (kept) and page_blocks."""
    tree = grow(labelled_rows(labelled))
    kinds = [df.schema[name].dataType.simpleString() for name in (id_col, *carry)]
    names = ["id", *(f"_carried_{k}" for k in range(len(carry)))]

    def start():
        def one(key, page, *others):
            text, kept, blocks = main_text(page, tree)
            return [(key, *others, text, len(text), kept, blocks)]

        return one

    schema = ", ".join(f"{name} {kind}" for name, kind in zip(names, kinds)) + ", text string, n_chars long, n_blocks int, page_blocks int"
    return map_rows(df.select(F.col(id_col), F.col(html_col), *carry), schema, start).withColumnsRenamed(dict(zip(names, (id_col, *carry))))
