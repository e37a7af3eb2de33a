"""Main text of web pages from flat text blocks.

A page is flattened to a list of text blocks, cut where a block-level tag starts or ends. A block
has its word count, the share of its words inside links, the same two of its neighbours, and where
it stands: inside an article, inside a container whose tag, role, class or id names boilerplate, and
whether the page has an article at all. A decision tree, grown here on the labelled table ``BLOCKS``
below, keeps or drops each block; what is kept is joined in page order.

A container isn't boilerplate, whatever it is called, if it holds the page's article or, where there is
none, most of its words outside links. Short articles beside a longer text are no articles.

Comments, scripts, styles, titles and other raw elements are skipped whole. Unclosed and
stray tags are tolerated; a page that breaks off is read to its end. White space is what
``str.split`` takes for it, after character references are decoded.

Null and empty html give an empty text. Repeated rows get equal rows; null ids and urls stay null.
Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from palaver.llm.common import map_batches

#: Comments, raw elements with all they hold, tags and declarations.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|noscript|template|textarea|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)|[^>]*)>"
    r"|<[!?][^>]*>"
    r"|<(?:/?[a-zA-Z]|!)[^<>]*\Z", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Names of tags, roles and classes.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split())
#: Elements that are skipped with all they hold, but for those that are never closed; options always are.
SKIPPED_TAGS = frozenset("object select svg".split())
OPTION_TAGS = frozenset(("optgroup", "option"))
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("aside button dialog fieldset footer form head header legend menu nav".split())
BOILER_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
BOILER_NAMES = frozenset(
    "ad ads adverts advert advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments consent "
    "cookie cookies copyright disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification pager pagination popup promo promotion recommended related replies reply respond search "
    "share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split())
ARTICLE_TAGS = frozenset(("article", "main"))


#: Roles and names of what readers add and what the law asks for, and tags that don't wrap a page's text.
SIDE_TAGS = frozenset("aside button dialog footer head legend menu nav".split())
SIDE_NAMES = frozenset("comment comments consent cookie cookies copyright disqus footer gdpr replies reply respond".split())
#: An article with fewer words than this is a teaser where more words stand outside.
TEASER = 50


@dataclass
class Block:
    words: int = 0
    linked: int = 0
    article: bool = False
    boiler: bool = False
    text: str = ""
    element: int = 0


@dataclass
class Element:
    tag: str
    parent: int
    boiler: bool = False  # by tag, role or name; a header is one outside articles only
    side: bool = False
    closed: bool = False
    words: int = 0  # outside links


def _names_boilerplate(attributes: str) -> tuple[bool, bool]:
    """Whether role, class or id name boilerplate, and such as SIDE_NAMES."""
    boiler = side = False
    for name, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        if name.lower() == "role":
            boiler |= value.strip() in BOILER_ROLES
            continue
        for each in value.split():
            parts = re.split(r"[-_]+", each)
            if parts[0] not in ("no", "has", "with") and not BOILER_NAMES.isdisjoint(parts):
                boiler = True
                side |= not SIDE_NAMES.isdisjoint(parts)
    return boiler, side


def elements_of(page: str) -> tuple[list[Element], list[tuple[str | None, int]]]:
    """All elements, parents first, and (text, element) in page order, without text where a block ends."""
    elements, stack, pieces = [Element("", 0)], [0], []
    position = 0
    for found in MARKUP.finditer(page):
        if found.start() > position:
            pieces.append((page[position:found.start()], stack[-1]))
        position = found.end()
        tag = (found["tag"] or "").lower()
        if not tag:
            continue
        if tag in BLOCK_TAGS:
            pieces.append((None, stack[-1]))
        if found["close"]:
            for at in range(len(stack) - 1, 0, -1):
                each = elements[stack[at]]
                if each.tag == tag:
                    each.closed = True
                    del stack[at:]
                    break
                if each.tag in ARTICLE_TAGS and tag not in ("body", "html"):
                    break  # a stray end tag doesn't end the article around it
        elif tag not in VOID_TAGS and not (found["attributes"] or "").rstrip().endswith("/"):
            if tag in BLOCK_TAGS or tag in OPTION_TAGS:
                while elements[stack[-1]].tag in OPTION_TAGS and not (tag == "option" and elements[stack[-1]].tag == "optgroup"):
                    stack.pop()
            if tag in ("p", "li") and elements[stack[-1]].tag == tag:
                stack.pop()
            boiler = side = False
            if tag not in ARTICLE_TAGS and tag not in ("html", "body"):
                boiler, side = _names_boilerplate(found["attributes"] or "")
                boiler, side = boiler or tag in BOILER_TAGS and tag != "header", side or tag in SIDE_TAGS
            elements.append(Element(tag, stack[-1], boiler, side))
            stack.append(len(elements) - 1)
    if position < len(page):
        pieces.append((page[position:], stack[-1]))
    pieces.append((None, stack[-1]))
    return elements, pieces


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in order; blocks without text are left out."""
    elements, pieces = elements_of(page)
    skipped, links = [False], [False]
    for e in elements[1:]:
        skipped.append(skipped[e.parent] or e.tag in SKIPPED_TAGS and e.closed or e.tag in OPTION_TAGS)
        links.append(links[e.parent] or e.tag == "a")
    blocks: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    for text, at in pieces:
        if skipped[at]:
            continue
        if text is not None:
            parts.append(text)
            if links[at]:
                linked += text, " "
        elif parts:
            words = entities.unescape("".join(parts)).split()
            if words:
                n = len(entities.unescape("".join(linked)).split()) if linked else 0
                blocks.append(Block(len(words), min(n, len(words)), text=" ".join(words), element=at))
            parts.clear()
            linked.clear()
    _place(blocks, elements)
    return blocks


def _place(blocks: list[Block], elements: list[Element]) -> None:
    """Say of every block whether it is inside an article and inside boilerplate. A container that holds
    the page's article, or without one most of its words, is none whatever it is called; articles
    count if one of them is more than a teaser of the text outside."""
    for b in blocks:
        elements[b.element].words += b.words - b.linked
    for e in reversed(elements[1:]):
        elements[e.parent].words += e.words
    total = elements[0].words
    outermost, within, remarks = [], [False], [False]
    for i, e in enumerate(elements[1:], 1):
        if e.tag in ARTICLE_TAGS and not within[e.parent] and e.words:
            outermost.append(i)
        within.append(within[e.parent] or e.tag in ARTICLE_TAGS)
        remarks.append(remarks[e.parent] or e.boiler and e.side)

    def resolved(spared: set[int], articles: bool) -> tuple[list[bool], list[bool]]:
        article, boiler = [False], [False]
        for i, e in enumerate(elements[1:], 1):
            names = e.boiler or e.tag == "header" and not article[e.parent]
            boiler.append(boiler[e.parent] or names and i not in spared)
            article.append(article[e.parent] or articles and e.tag in ARTICLE_TAGS and not boiler[e.parent])
        return article, boiler

    spared, real = set(), outermost
    for _ in range(2):
        article, boiler = resolved(spared, bool(real))
        outside = sum(b.words - b.linked for b in blocks if not boiler[b.element] and not within[b.element])
        least = max(outside / 2, min(TEASER, outside))
        real = [i for i in outermost if elements[i].tag == "main" or elements[i].words >= least]
        if real:
            top = max(real, key=lambda i: (not remarks[i], elements[i].words))
            spared, at = set(), top
            # Of an article among readers' remarks, or beside one, the page's text isn't certain.
            while at and not (remarks[top] and (2 * elements[top].words <= total or outside)):
                spared.add(at)
                at = elements[at].parent
        else:
            spared = {i for i, e in enumerate(elements) if i and not e.side and 2 * e.words > total}
    article, boiler = resolved(spared, bool(real))
    for b in blocks:
        b.article, b.boiler = article[b.element], boiler[b.element]


FEATURES = ("boiler", "article", "page_has_article", "words", "density", "words_before", "density_before", "words_after", "density_after")

# Labelled table, made by hand: the features in the order above, then 1 for main text.
BLOCKS = (
    # menus, headers, footers, adverts, notices, forms and comments of pages with an article
    (1, 0, 1, 1, 1.0, 0, 0.0, 1, 1.0, 0), (1, 0, 1, 1, 1.0, 1, 1.0, 1, 1.0, 0), (1, 0, 1, 2, 1.0, 1, 1.0, 9, 0.0, 0),
    (1, 0, 1, 9, 0.0, 1, 1.0, 12, 0.0, 0), (1, 0, 1, 14, 0.0, 60, 0.0, 0, 0.0, 0), (1, 0, 1, 45, 0.1, 80, 0.0, 5, 0.2, 0),
    (1, 1, 1, 20, 0.0, 70, 0.0, 90, 0.0, 0), (1, 1, 1, 3, 0.7, 120, 0.0, 40, 0.0, 0), (1, 1, 1, 60, 0.0, 50, 0.0, 4, 0.5, 0),
    (1, 0, 1, 150, 0.0, 30, 0.0, 25, 0.0, 0), (1, 0, 1, 80, 0.0, 6, 0.0, 6, 0.0, 0), (1, 1, 1, 110, 0.0, 90, 0.0, 70, 0.0, 0),
    # the same of pages without
    (1, 0, 0, 3, 1.0, 2, 1.0, 4, 1.0, 0), (1, 0, 0, 12, 0.1, 70, 0.0, 0, 0.0, 0), (1, 0, 0, 90, 0.0, 70, 0.0, 60, 0.0, 0),
    (1, 0, 0, 25, 0.0, 0, 0.0, 85, 0.0, 0),
    # text of articles: long and short paragraphs, headings, list items, quotations, linked sources
    (0, 1, 1, 9, 0.0, 8, 0.0, 60, 0.0, 1), (0, 1, 1, 1, 0.0, 40, 0.0, 55, 0.0, 1), (0, 1, 1, 120, 0.0, 9, 0.0, 80, 0.0, 1),
    (0, 1, 1, 80, 0.05, 120, 0.0, 60, 0.0, 1), (0, 1, 1, 2, 0.0, 1, 0.0, 3, 0.0, 1), (0, 1, 1, 400, 0.0, 2, 0.0, 10, 0.0, 1),
    (0, 1, 1, 4, 1.0, 90, 0.0, 70, 0.0, 1), (0, 1, 1, 60, 0.3, 5, 1.0, 12, 0.0, 1), (0, 1, 1, 30, 0.0, 0, 0.0, 0, 0.0, 1),
    (0, 1, 1, 15, 0.0, 12, 0.0, 14, 0.1, 1), (0, 1, 1, 1, 1.0, 1, 0.0, 1, 1.0, 1), (0, 1, 1, 5, 0.0, 1, 1.0, 10, 0.0, 1),
    (0, 1, 1, 70, 0.0, 450, 0.0, 1, 1.0, 1), (0, 1, 1, 2, 1.0, 300, 0.0, 350, 0.0, 1), (0, 1, 1, 6, 0.7, 160, 0.9, 3, 1.0, 1),
    (0, 1, 1, 2, 1.0, 40, 1.0, 2, 1.0, 1), (0, 1, 1, 7, 0.5, 2, 1.0, 90, 0.0, 1), (0, 1, 1, 12, 0.9, 30, 0.3, 12, 1.0, 1),
    (0, 1, 1, 1, 0.0, 0, 0.0, 2, 0.0, 1), (0, 1, 1, 3, 0.0, 2, 1.0, 5, 0.0, 1), (0, 1, 1, 35, 0.8, 6, 0.0, 3, 0.0, 1),
    (0, 1, 1, 2, 0.0, 2, 0.0, 2, 0.0, 1), (0, 1, 1, 20, 0.6, 1, 0.0, 200, 0.0, 1),
    # what stands outside the article of a page that has one
    (0, 0, 1, 2, 1.0, 0, 0.0, 3, 1.0, 0), (0, 0, 1, 12, 0.0, 4, 0.5, 30, 0.0, 0), (0, 0, 1, 60, 0.0, 40, 0.0, 10, 0.0, 0),
    (0, 0, 1, 25, 0.2, 130, 0.0, 5, 1.0, 0), (0, 0, 1, 110, 0.0, 7, 0.0, 90, 0.0, 0), (0, 0, 1, 1, 0.0, 300, 0.0, 0, 0.0, 0),
    (0, 0, 1, 8, 0.0, 5, 1.0, 90, 0.0, 0), (0, 0, 1, 3, 0.3, 1, 1.0, 60, 0.0, 0), (0, 0, 1, 14, 0.0, 0, 0.0, 45, 0.0, 0),
    (0, 0, 1, 90, 1.0, 3, 0.0, 2, 0.0, 0), (0, 0, 1, 75, 0.5, 60, 0.0, 9, 0.4, 0),
    # pages without an article, or with teasers only: by words and links of the block and its neighbours
    (0, 0, 0, 300, 0.0, 18, 0.2, 25, 0.0, 1), (0, 0, 0, 70, 0.0, 12, 0.5, 20, 0.3, 1),
    (0, 0, 0, 90, 0.0, 1, 1.0, 2, 1.0, 1), (0, 0, 0, 250, 0.0, 30, 0.0, 5, 0.8, 1), (0, 0, 0, 55, 0.1, 40, 0.0, 3, 1.0, 1),
    (0, 0, 0, 3, 0.67, 90, 0.0, 4, 0.75, 0), (0, 0, 0, 2, 1.0, 120, 0.0, 3, 0.0, 0), (0, 0, 0, 4, 0.75, 80, 0.0, 0, 0.0, 0),
    (0, 0, 0, 110, 0.0, 450, 0.0, 420, 0.0, 1), (0, 0, 0, 50, 0.0, 380, 0.0, 4, 1.0, 1),
    (0, 0, 0, 10, 0.0, 12, 0.0, 9, 0.0, 1), (0, 0, 0, 12, 0.0, 40, 0.0, 14, 0.0, 1), (0, 0, 0, 9, 0.1, 60, 0.0, 2, 1.0, 1),
    (0, 0, 0, 2, 0.0, 20, 0.0, 16, 0.0, 1), (0, 0, 0, 11, 0.8, 7, 1.0, 90, 0.0, 0),
    (0, 0, 0, 70, 0.5, 40, 0.0, 60, 0.1, 1), (0, 0, 0, 5, 0.0, 1, 1.0, 80, 0.0, 1), (0, 0, 0, 3, 0.0, 0, 0.0, 60, 0.0, 1),
    (0, 0, 0, 60, 0.0, 8, 0.0, 70, 0.0, 1), (0, 0, 0, 120, 0.05, 60, 0.0, 90, 0.0, 1), (0, 0, 0, 25, 0.0, 70, 0.0, 60, 0.0, 1),
    (0, 0, 0, 8, 0.0, 3, 1.0, 80, 0.0, 1), (0, 0, 0, 5, 0.0, 90, 0.0, 45, 0.0, 1), (0, 0, 0, 35, 0.1, 50, 0.0, 4, 1.0, 1),
    (0, 0, 0, 90, 0.2, 4, 0.0, 3, 0.5, 1), (0, 0, 0, 18, 0.0, 22, 0.0, 30, 0.0, 1), (0, 0, 0, 45, 0.0, 0, 0.0, 0, 0.0, 1),
    (0, 0, 0, 3, 1.0, 0, 0.0, 2, 1.0, 0), (0, 0, 0, 1, 1.0, 2, 1.0, 1, 1.0, 0), (0, 0, 0, 12, 0.9, 6, 0.8, 10, 0.9, 0),
    (0, 0, 0, 40, 0.8, 5, 1.0, 6, 1.0, 0), (0, 0, 0, 4, 0.0, 2, 1.0, 3, 1.0, 0), (0, 0, 0, 6, 0.4, 3, 1.0, 2, 1.0, 0),
    (0, 0, 0, 7, 0.0, 5, 0.2, 6, 0.0, 0), (0, 0, 0, 2, 0.5, 80, 0.0, 3, 1.0, 0),
)


def grow(rows: list[tuple], depth: int = 8):
    """A tree by Gini impurity: ``(feature, threshold, at most, above)`` or the label of a leaf."""
    ones = sum(r[-1] for r in rows)
    if not depth or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))

    def impurity(part: list[tuple]) -> float:
        share = sum(r[-1] for r in part) / len(part)
        return len(part) * share * (1 - share)

    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            low, high = [r for r in rows if r[f] <= a], [r for r in rows if r[f] > a]
            score = impurity(low) + impurity(high)
            if best is None or score < best[0] - 1e-12:
                best = score, f, (a + b) / 2, low, high
    if best is None:
        return int(2 * ones >= len(rows))
    return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)


def classify(tree, features: tuple) -> bool:
    while isinstance(tree, tuple):
        feature, threshold, low, high = tree
        tree = low if features[feature] <= threshold else high
    return bool(tree)


def main_text(page: str, tree) -> str:
    blocks = blocks_of(page)
    has_article = any(b.article and not b.boiler for b in blocks)
    density = [b.linked / b.words for b in blocks]
    kept = []
    for i, b in enumerate(blocks):
        before, after = (i - 1 if i else None), (i + 1 if i + 1 < len(blocks) else None)
        features = (
            int(b.boiler), int(b.article), int(has_article), b.words, density[i],
            blocks[before].words if before is not None else 0, density[before] if before is not None else 0.0,
            blocks[after].words if after is not None else 0, density[after] if after is not None else 0.0)
        if classify(tree, features):
            kept.append(b.text)
    return " ".join(kept)


def extract(pages: DataFrame, labelled: tuple[tuple, ...] = BLOCKS) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    tree = grow(list(labelled))

    def run(batch: pa.RecordBatch):
        texts = [main_text(page.as_py() or "", tree) for page in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])

    return map_batches(pages.selectExpr("cast(page_id AS bigint) AS page_id", "url", "html"), run,
                       "page_id long, url string, text string, n_chars long")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
