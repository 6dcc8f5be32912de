"""The main text of web pages: flat text blocks, told apart by a decision tree.

A page is cut into blocks of text at its block tags. A block is described by its words, by the share
of them that are links, by the same of its neighbours, by how much plain text its container holds
beside the page's fullest one, and by whether an enclosing element says what it is (its tag, or the
words of its class, id and role). A decision tree, trained on the small table ``LABELLED`` of blocks,
keeps or drops each one.

Null and empty pages give an empty text. Every row of ``pages`` gives one row, repeated ones and
those without an id too; other columns are left out, whatever their names. Pages of any length are
read whole, one at a time; nothing of a kept block is cut. An unfinished tag at the end of a page is
markup.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from orbitframe.llm.common import batch

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style noscript template svg canvas iframe object audio video map "
                   "datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark "
                   "nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img "
                   "math".split())
CONTAINERS = frozenset("html body div article section main nav aside header footer form td dialog "
                       "center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: a start tag ends an open element of its kind, up to the named ones
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}),
        "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "a": ({"a"}, set())}

# words by which pages name what is not the article
BESIDE_TAGS = frozenset("nav aside footer form dialog menu select button textarea fieldset".split())
BESIDE_WORDS = frozenset(
    "ad ads adv alert alerts banner bottombar breadcrumb breadcrumbs byline consent copyright gdpr "
    "legal login masthead modal nav navigation notice notices notification outbrain overlay "
    "pager pagination popup related recommended register reply replies respond rail search share "
    "sharing shop sign signup skip social sponsor subscribe subscription taboola teaser toc "
    "toolbar tools topbar widget widgets".split())
BESIDE_PARTS = ("advert", "breadcrumb", "comment", "cookie", "disclaimer", "disqus", "footer", "menu",
                "navbar", "newsletter", "promo", "sidebar", "sponsor", "subscrib")
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert "
                         "menu menubar toolbar form".split())
MAIN_TAGS = frozenset("article main".split())
MAIN_WORDS = frozenset("article articlebody content entry main post story".split())
NEGATED = frozenset("has no with without".split())
COMMENT_HEADINGS = frozenset("comment comments kommentar kommentare commentaire commentaires comentario "
                             "comentarios responses".split())

FEATURES = ("words", "link_density", "previous_words", "previous_link_density", "next_words",
            "next_link_density", "beside", "main", "heading", "container_words",
            "container_share", "container_link_density")
DEPTH = 8
#: to the tree, more words than this are as many
MANY = 40
#: the pages of the table are also used with longer articles, and without what precedes or follows them
LONGER = (1, 4, 20)
#: (page, place, words, words in links, 1 if it belongs to the article)
LABELLED = (
    (1, "body nav li", 1, 1, 0), (1, "body nav li", 1, 1, 0), (1, "body nav li", 2, 2, 0),
    (1, "body div.ad", 9, 0, 0), (1, "body article h1", 9, 0, 1), (1, "body article p", 70, 0, 1),
    (1, "body article p", 2, 0, 1), (1, "body article p", 45, 3, 1), (1, "body article p", 1, 0, 1),
    (1, "body article p", 12, 0, 1), (1, "body footer", 14, 0, 0),
    (2, "body header", 4, 2, 0), (2, "body nav li", 2, 2, 0), (2, "body nav li", 3, 3, 0),
    (2, "body main article h1", 6, 0, 1), (2, "body main article header p", 5, 0, 1),
    (2, "body main article p", 30, 0, 1), (2, "body main article li", 3, 0, 1),
    (2, "body main article li", 8, 0, 1), (2, "body main article li", 2, 2, 1),
    (2, "body main article p", 5, 5, 1), (2, "body main article p", 55, 20, 1),
    (2, "body main article aside p", 35, 0, 0), (2, "body main article p", 22, 0, 1),
    (2, "body main article div.share", 3, 3, 0), (2, "body main section.comments h3", 1, 0, 0),
    (2, "body main section.comments p", 60, 0, 0), (2, "body main section.comments p", 3, 0, 0),
    (2, "body main form", 5, 0, 0), (2, "body footer p", 40, 6, 0),
    (3, "body div.cookie p", 30, 2, 0), (3, "body div.top", 3, 3, 0), (3, "body div.menu li", 1, 1, 0),
    (3, "body div.menu li", 2, 2, 0), (3, "body div.content h1", 7, 0, 1),
    (3, "body div.content p", 80, 4, 1), (3, "body div.content h2", 3, 0, 1),
    (3, "body div.content p", 3, 0, 1), (3, "body div.content p", 26, 0, 1),
    (3, "body div.content div.promo", 25, 5, 0), (3, "body div.content p", 1, 0, 1),
    (3, "body div.content p", 61, 0, 1), (3, "body div.sidebar h3", 2, 0, 0),
    (3, "body div.sidebar p", 48, 8, 0), (3, "body div.comments p", 90, 0, 0),
    (3, "body div.footer", 20, 4, 0),
    (4, "body div#1", 2, 2, 0), (4, "body div#1", 1, 1, 0), (4, "body div#1", 3, 3, 0),
    (4, "body div#2 h1", 8, 0, 1), (4, "body div#2 p", 50, 0, 1), (4, "body div#2 p", 4, 0, 1),
    (4, "body div#2 p", 64, 6, 1), (4, "body div#2 p", 2, 0, 1), (4, "body div#2 li", 6, 0, 1),
    (4, "body div#2 li", 3, 0, 1), (4, "body div#2 p", 33, 0, 1), (4, "body div#3", 5, 5, 0),
    (4, "body div#3", 4, 4, 0), (4, "body div#4", 7, 1, 0),
    (5, "body h1", 6, 0, 1), (5, "body p", 40, 0, 1), (5, "body p", 75, 8, 1), (5, "body p", 18, 0, 1),
    (6, "body div#1 li", 1, 1, 0), (6, "body div#1 li", 1, 1, 0), (6, "body div#2", 52, 0, 1),
    (6, "body div#3", 38, 2, 1), (6, "body div#4", 47, 0, 1), (6, "body div#5", 3, 3, 0),
    (6, "body div#6", 8, 6, 0),
    (7, "body nav li", 2, 2, 0), (7, "body div.related li", 7, 7, 0), (7, "body div.related li", 9, 9, 0),
    (7, "body form p", 12, 0, 0), (7, "body footer p", 30, 0, 0),
    (8, "body div.notice p", 22, 0, 0), (8, "body header h1", 3, 0, 0), (8, "body header p", 8, 0, 0),
    (8, "body main h1", 5, 0, 1), (8, "body main p", 24, 0, 1), (8, "body main p", 6, 0, 1),
    (8, "body main p", 1, 0, 1), (8, "body main div.ad", 30, 1, 0), (8, "body main p", 44, 2, 1),
    (8, "body main td", 2, 0, 1), (8, "body main td", 1, 0, 1), (8, "body main p", 3, 3, 1),
    (8, "body aside p", 70, 0, 0), (8, "body footer p", 12, 3, 0),
    (9, "body article h1", 4, 0, 1), (9, "body article p", 3, 0, 1), (9, "body footer", 9, 0, 0),
    (10, "body div#1 li", 2, 2, 0), (10, "body div#1 li", 2, 2, 0), (10, "body div#2", 3, 0, 0),
    (10, "body div#3", 5, 4, 0),
    (11, "body nav li", 1, 1, 0), (11, "body article h1", 1, 0, 1), (11, "body article p", 6, 6, 1),
    (11, "body article p", 1, 0, 1), (11, "body article p", 40, 0, 1), (11, "body article li", 3, 3, 1),
    (11, "body article li", 2, 2, 1), (11, "body article p", 2, 0, 1), (11, "body footer", 10, 2, 0),
    (12, "body div#1 li", 1, 1, 0), (12, "body div#1 li", 2, 2, 0), (12, "body div#2 h1", 1, 0, 1),
    (12, "body div#2 p", 3, 0, 1), (12, "body div#2 p", 90, 2, 1), (12, "body div#2 p", 4, 4, 1),
    (12, "body div#2 p", 2, 0, 1), (12, "body div#2 p", 35, 0, 1), (12, "body div#3 li", 8, 8, 0),
    (12, "body div#3 li", 9, 9, 0), (12, "body div#4", 6, 0, 0),
    (14, "body nav li", 1, 1, 0), (14, "body div.ad", 8, 0, 0), (14, "body article h1", 1, 0, 1),
    (14, "body article p", 1, 0, 1), (14, "body footer", 13, 0, 0),
    (15, "body div#1", 11, 6, 0), (15, "body div#2 h1", 2, 0, 1), (15, "body div#2 p", 40, 0, 1),
    (15, "body div#2 p", 3, 2, 1), (15, "body div#2 p", 1, 0, 1), (15, "body div#2 p", 60, 0, 1),
    (15, "body div#3", 13, 7, 0), (15, "body div#4", 7, 0, 0),
    (20, "body nav li", 2, 2, 0), (20, "body article h1", 2, 0, 1), (20, "body article p", 3, 0, 1),
    (20, "body footer", 8, 0, 0), (21, "body article h1", 1, 0, 1), (21, "body footer", 8, 0, 0),
    (22, "body div#1", 3, 0, 0), (22, "body div#2 li", 2, 2, 0), (22, "body div#2 li", 1, 1, 0),
    (22, "body div#3 h1", 5, 0, 1), (22, "body div#3 p", 35, 0, 1), (22, "body div#3 p", 2, 0, 1),
    (22, "body div#3 p", 80, 0, 1), (22, "body div#4 h4", 1, 0, 0), (22, "body div#4 li", 4, 4, 0),
    (22, "body div#4 p", 11, 0, 0), (22, "body div#5", 2, 0, 0),
    (23, "body div#1", 4, 4, 0), (23, "body div#2 div#1", 90, 0, 1), (23, "body div#2 div#2", 12, 0, 1),
    (23, "body div#2 div#3", 40, 0, 1), (23, "body div#2 div#4", 2, 0, 1), (23, "body div#3", 9, 7, 0),
    (24, "body div#1 li", 2, 2, 0), (24, "body div#1 li", 3, 3, 0), (24, "body div#2 p", 20, 0, 1),
    (24, "body div#2 p", 2, 2, 1), (24, "body div#2 p", 3, 0, 1), (24, "body div#2 p", 3, 3, 1),
    (24, "body div#2 p", 12, 0, 1), (24, "body div#2 p", 7, 7, 1), (24, "body div#2 p", 60, 1, 1),
    (24, "body div#2 p", 1, 1, 1), (24, "body div#2 p", 25, 0, 1), (24, "body div#3", 9, 9, 0),
    (25, "body nav li", 2, 2, 0), (25, "body article h1", 5, 0, 1), (25, "body article p", 40, 16, 1),
    (25, "body article p", 12, 12, 1), (25, "body article p", 6, 0, 1), (25, "body article li", 9, 9, 1),
    (25, "body article li", 5, 5, 1), (25, "body article p", 30, 9, 1), (25, "body footer", 9, 3, 0),
    (16, "body article p", 120, 0, 1), (17, "body div#1", 80, 2, 1), (18, "body p", 1, 0, 0),
    (19, "body article h1", 2, 0, 1), (19, "body article p", 30, 0, 1), (19, "body article p", 1, 0, 1),
    (13, "body div#1", 6, 6, 0), (13, "body div#2 p", 2, 0, 0), (13, "body div#3 a", 3, 3, 0),
)
_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()),
                    ("n_chars", pa.int64())])


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    beside: bool
    main: bool
    heading: bool
    container: object
    outer: object


class _Open:
    """An open element with what it inherits."""
    __slots__ = ("tag", "beside", "main", "heading", "link", "unseen", "container", "outer")

    def __init__(self, tag: str, names: str, role: str, hidden: bool, up: _Open | None, own: object):
        words = _words(names)
        self.tag = tag
        self.main = tag in MAIN_TAGS or bool(words & MAIN_WORDS) or (up is not None and up.main)
        inside = up is not None and up.main
        named = tag not in ("html", "body", "main", "article") and (
            bool(words & BESIDE_WORDS) or ("header" in words and not inside) or any(p in w for w in words for p in BESIDE_PARTS)
            or role in BESIDE_ROLES)
        self.beside = bool(tag in BESIDE_TAGS or named or (tag == "header" and not inside) or (
            up is not None and up.beside))
        self.heading = tag in HEADINGS or (up is not None and up.heading)
        self.link = tag == "a" or (up is not None and up.link)
        self.unseen = tag in UNSEEN or hidden or (up is not None and up.unseen)
        self.container, self.outer = (own, up and up.container) if tag in CONTAINERS or up is None else (
            up.container, up.outer)


def _words(names: str) -> set[str]:
    """Words of class and id; those after a negation ('has-sidebar') do not name the element."""
    out, skip = set(), False
    for word in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\s", names):
        word = word.lower()
        if not skip and word.strip():
            out.add(word)
        skip = word in NEGATED
    return out - NEGATED


class _Blocks(HTMLParser):
    """Collects the text blocks of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.words = self.linked = 0
        self.open: list[_Open] = [_Open("html", "", "", False, None, 0)]
        self.counts: dict[str, int] = {}
        self.number = 0
        self.state = None

    def flush(self):
        text = " ".join("".join(self.parts).split())
        state, self.parts = self.state, []
        if text:
            self.blocks.append(Block(text, len(text.split(" ")), self.linked, state.beside, state.main,
                                     state.heading, state.container, state.outer))
            if state.heading and len(text) < 60 and COMMENT_HEADINGS & set(
                    re.findall(r"\w+", text.lower())) and len(text.split(" ")) <= 4:
                self.comments_follow(state.container)
        self.linked, self.state = 0, None

    def comments_follow(self, container: object):
        """A heading that announces comments: the rest of its container holds them."""
        self.blocks[-1] = self.blocks[-1]._replace(beside=True)
        for element in self.open:
            if element.container == container:
                element.beside = True

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        if tag in ENDS:
            self.end(*ENDS[tag])
        if tag not in INLINE and self.counts.get("p"):
            self.end({"p"}, CONTAINERS)
        values = {k: v or "" for k, v in attrs}
        hidden = "hidden" in values or "display:none" in values.get("style", "").replace(" ", "").lower()
        self.number += 1
        self.open.append(_Open(tag, f"{values.get('class', '')} {values.get('id', '')}",
                               values.get("role", "").lower(), hidden, self.open[-1], self.number))
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        if self.counts.get(tag):
            self.end({tag}, set() if tag in CONTAINERS else CONTAINERS)

    def end(self, tags, within):
        """Close the innermost open element of ``tags``, if none of ``within`` lies between."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                for element in self.open[i:]:
                    self.counts[element.tag] -= 1
                del self.open[i:]
                return
            if self.open[i].tag in within:
                return

    def handle_data(self, data):
        top = self.open[-1]
        if top.unseen:
            return
        if self.state is None and data.strip():
            self.state = top
        self.parts.append(data)
        if top.link:
            self.linked += len(data.split())


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page in page order."""
    parser = _Blocks()
    parser.feed(html)
    # what is left unread is a tag without its end, or text
    rest = parser.rawdata
    if rest.startswith("<") and re.match(r"<[a-zA-Z/!?]", rest):
        parser.rawdata = ""
    parser.close()
    parser.flush()
    return parser.blocks


def features_of(blocks: list[Block]) -> list[tuple]:
    """``FEATURES`` of every block."""
    inside = Counter(b.container for b in blocks)
    # a container of one block is part of what is around it
    homes = [b.outer if inside[b.container] == 1 and b.outer is not None else b.container for b in blocks]
    plain, linked = {}, {}
    for b, home in zip(blocks, homes):
        if not b.beside:
            plain[home] = plain.get(home, 0) + b.words - min(b.linked, b.words)
            linked[home] = linked.get(home, 0) + min(b.linked, b.words)
    fullest = max(plain.values(), default=0)
    density = [min(b.linked / b.words, 1.0) for b in blocks]
    rows = []
    for i, b in enumerate(blocks):
        before, after = i > 0, i + 1 < len(blocks)
        own, links = plain.get(homes[i], 0), linked.get(homes[i], 0)
        rows.append((min(b.words, MANY), density[i],
                     min(blocks[i - 1].words, MANY) if before else 0,
                     density[i - 1] if before else 0.0,
                     min(blocks[i + 1].words, MANY) if after else 0,
                     density[i + 1] if after else 0.0, int(b.beside), int(b.main), int(b.heading), min(own, MANY),
                     own / fullest if fullest else 0.0, links / (own + links) if own + links else 0.0))
    return rows


def _variants(rows: list[tuple]) -> list[list[tuple]]:
    """A labelled page as it is, with a longer article, and cut at the article's ends."""
    kept = [i for i, row in enumerate(rows) if row[4]]
    if not kept:
        return [rows]
    cuts = [rows, rows[kept[0]:], rows[:kept[-1] + 1]]
    return [[(*r[:2], r[2] * k, r[3] * k, r[4]) if r[4] and r[2] > 10 else r for r in cut]
            for cut in cuts for k in LONGER]


def labelled_blocks(labelled=LABELLED) -> list[tuple[tuple, int]]:
    """(features, label) of the rows of ``labelled``."""
    out = []
    for page in dict.fromkeys(row[0] for row in labelled):
        for rows in _variants([r for r in labelled if r[0] == page]):
            blocks = []
            for _, place, words, linked, _ in rows:
                element, path = None, ""
                for step in place.split():
                    path = f"{path} {step}"
                    tag, _, names = step.partition("#")[0].partition(".")
                    element = _Open(tag, names, "", False, element, path)
                blocks.append(Block("", words, linked, element.beside, element.main, element.heading,
                                    element.container, element.outer))
            out += zip(features_of(blocks), (r[4] for r in rows))
    return out


def fit_tree(spark: SparkSession, labelled=LABELLED, depth: int = DEPTH) -> tuple:
    """A decision tree over ``FEATURES`` as nested (feature, threshold, left, right), leaves 0 or 1."""
    rows = spark.createDataFrame([(Vectors.dense([float(x) for x in f]), float(label))
                                  for f, label in labelled_blocks(labelled)], ["features", "label"])
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=256, seed=0).fit(rows.coalesce(1))

    def nested(node):
        if node.subtreeDepth() == 0:
            return int(node.prediction())
        split = node.split()
        return (split.featureIndex(), split.threshold(), nested(node.leftChild()),
                nested(node.rightChild()))

    return nested(model._java_obj.rootNode())


def keeps(tree, row: tuple) -> int:
    while isinstance(tree, tuple):
        feature, threshold, low, high = tree
        tree = low if row[feature] <= threshold else high
    return tree


def main_text(html: str, tree) -> str:
    blocks = blocks_of(html)
    return " ".join(b.text for b, row in zip(blocks, features_of(blocks)) if keeps(tree, row))


def extract_text(pages: DataFrame, tree: tuple | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    tree = tree or fit_tree(pages.sparkSession)

    def run(batches):
        for rows in batches:
            for page, url, html in zip(*(rows.column(i) for i in range(3))):
                text = main_text(html.as_py() or "", tree)
                yield batch(_TEXTS, page_id=[page.as_py()], url=[url.as_py()], text=[text],
                            n_chars=[len(text)])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                        F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
