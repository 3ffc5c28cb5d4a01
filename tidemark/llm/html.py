"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into flat blocks of text. Each block has its word count and link density and those of the blocks before
and after it, and what encloses it. A decision tree (Spark ML) trained on a small labelled table tells main text from the
rest. Word counts and link densities alone cannot tell a short paragraph from a short advert, so the enclosing elements
are features of the tree as well.

The labelled table is written as small pages (`LABELLED`), with a mark on the blocks to keep.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# a quote opens a string if another one follows, and no choice is taken back: broken tags cost no more than others
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-label)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
RAW = frozenset("script style noscript template iframe object textarea title select head canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("math mfrac mi mn mo mrow ms msqrt msub msubsup msup mtext a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label".split())
ASIDE = frozenset("nav header footer aside form menu dialog button fieldset".split())
MAIN = frozenset("article main".split())
ASIDE_NAME = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|header|masthead|footer|sidebar|side|aside|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|social|share|sharing|related|recommended|breadcrumbs?|pagination|pager|comments?|disqus|respond|replies|reviews|widget|copyright|legal|disclaimer|toolbar|skip)(?=$|[\s_-])", re.IGNORECASE)
MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article|post|entry|content|main|story|body)(?=$|[\s_-])", re.IGNORECASE)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
WHITE = re.compile(r"\s+")
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "aside", "place")


def flat_blocks(page: str) -> tuple[list[str], np.ndarray]:
    """Text blocks of a page in order, and their features (columns of FEATURES).

    place: 2 inside an article, main or content element, 1 where the page has none, 0 outside of it.
    """
    texts: list[str] = []
    rows: list[tuple[int, int, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, aside, main
    parts: list[str] = []
    linked = words = 0
    in_link, at, end, has_main = 0, 0, len(page), False

    def close() -> None:
        nonlocal parts, linked, words
        text = WHITE.sub(" ", "".join(parts)).strip()
        if text:
            texts.append(text)
            rows.append((words, linked, bool(stack and stack[-1][1]), bool(stack and stack[-1][2])))
        parts, linked, words = [], 0, 0

    def take(raw: str) -> None:
        nonlocal linked, words
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            n = len(text.split())
            words += n
            linked += n if in_link else 0

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "a":
                in_link = 0
            if name in INLINE:
                continue
            if any(s[0] == name for s in stack):
                close()
                while stack.pop()[0] != name:
                    pass
                in_link = 0
            elif name == "p":
                close()
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                over = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at) if name != "head" else None
                if name == "head":
                    over = re.compile(r"</head\s*>|<body[\s>]", re.IGNORECASE).search(page, at)
                    at = (over.start() if over and over[0][1] != "/" else over.end()) if over else at
                    if over is None:
                        continue
                else:
                    at = over.end() if over else end
            if name not in INLINE:
                close()
            continue
        if name == "a":
            in_link = 1
        if name == "br":
            parts.append(" ")
        if name in INLINE:
            continue
        close()
        if name in VOID:
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # these end an open one of their kind
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] not in ("p",) and not (name == "tr" and stack[k][0] in ("td", "th")):
                    break
        elif stack and stack[-1][0] == "p":
            stack.pop()
        named = {k.lower(): (a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3] else {}
        label = f"{named.get('class', '')} {named.get('id', '')}"
        above = stack[-1] if stack else ("", False, False)
        main = name in MAIN or name not in ("body", "html") and bool(MAIN_NAME.search(label)) or named.get("role") == "main"
        aside = name in ASIDE and not (name == "header" and above[2]) or named.get("role", "").lower() in ASIDE_ROLES or "hidden" in named or name not in ("body", "html") and name != "article" and bool(ASIDE_NAME.search(label))
        has_main |= main and not above[1]
        stack.append((name, above[1] or aside, above[2] or main))
        if m[3].endswith("/"):
            stack.pop()
    close()
    n = len(rows)
    f = np.zeros((n, len(FEATURES)))
    if n:
        count = np.array([r[0] for r in rows], float)
        links = np.array([r[1] for r in rows], float) / np.maximum(count, 1)
        f[:, 0], f[:, 1] = count, links
        f[1:, 2], f[1:, 3] = count[:-1], links[:-1]
        f[:-1, 4], f[:-1, 5] = count[1:], links[1:]
        f[:, 6] = [r[2] for r in rows]
        f[:, 7] = [2 * r[3] if has_main else 1 for r in rows]
    return texts, f


# Labelled table: small pages; text that begins with "+" is main text. Written for this purpose.
LABELLED = (
    '<body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News from the world</a></li></ul></nav><div class="ad">Buy two chairs and get one free today</div>'
    '<article><h1>+A title of seven words stands here</h1><p>+The first paragraph is rather long and tells what happened in the town on that day before the rain came.</p><p>+Short.</p><p>+It ends with <a href="/x">a link to more</a> and some words.</p></article><footer>&copy; A company &middot; <a href="/i">Imprint</a></footer></body>',
    '<body><header>The daily paper</header><main><p>+One.</p><p>+<a href="/a">Only a link in the text</a></p><p>+Some twenty words of text are enough to show that a paragraph in the middle of the page is main text here.</p></main><aside>Most read: five things to know about gardens in spring and other long teasers that fill the column</aside><form>Your mail address please</form></body>',
    '<body><div id="cookie-notice">We use cookies to make this site better for you and for the people who measure it, please agree to all of them.</div><div><p>+A page without an article has a paragraph of many words that simply stands in the body between the other things.</p><p>+Two words.</p><p>+Another long paragraph follows the short one and goes on for some time, so that it clearly belongs to the text.</p></div>'
    '<div class="comments">I liked this text very much and want to say so in a comment that is as long as a paragraph, thank you.</div><div><a href="/1">One</a> <a href="/2">Two</a> <a href="/3">Three</a></div></body>',
    '<body><div><a href="/a">Sports</a> | <a href="/b">Weather</a></div><p>+Here the text is in plain paragraphs, each with a good number of words, and nothing else marks it as the main part.</p><p>+See <a href="/c">here</a> for the other part of this story.</p><ul><li><a href="/d">A link list item that is long enough</a></li><li><a href="/e">Another item of the list of links</a></li></ul></body>',
    '<body><p>Text outside of the article that belongs to a teaser of another story with a number of words</p><article><h2>+Heading</h2><p>+Body of the text with a dozen words or a few more of them.</p><div class="share">Share this with friends</div><ul><li>+a point</li><li>+another point of the list</li></ul><section class="comments"><p>First comment by a reader who has much to say about the body of the text.</p></section></article><div>Related things that you may like as well as this one</div></body>',
    '<body><article><p>+word</p></article><div>outside</div><p>Another paragraph outside the article with words enough to look like text to a careless reader</p></body>',
    "<body><p>+Just a single paragraph of words, nothing before it, nothing after it.</p></body>",
    '<body><div class="post"><p>+Tiny.</p></div><div class="sidebar"><p>A paragraph in the column at the side, long enough to pass for text if one counts nothing but words.</p></div></body>',
)


def labelled_blocks(spark: SparkSession, pages: tuple[str, ...] = LABELLED) -> DataFrame:
    """The labelled table: features of each block and label (1 for main text)."""
    rows = []
    for page in pages:
        texts, features = flat_blocks(page)
        rows += [(*map(float, f), float(t.startswith("+"))) for t, f in zip(texts, features, strict=True)]
    return spark.createDataFrame(rows, [*FEATURES, "label"])


def train_tree(labelled: DataFrame, depth: int = 6):
    """Nodes of a decision tree fitted by Spark ML: (feature, threshold, left, right) or (-1, class, 0, 0)."""
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled)
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, maxBins=64, seed=7).fit(data)
    nodes: list[tuple[int, float, int, int]] = []

    def visit(node) -> int:
        place = len(nodes)
        nodes.append((-1, float(node.prediction()), 0, 0))
        if node.numDescendants() if hasattr(node, "numDescendants") else node.subtreeDepth():
            split = node.split()
            nodes[place] = (split.featureIndex(), split.threshold(), visit(node.leftChild()), visit(node.rightChild()))
        return place

    visit(model._java_obj.rootNode())
    return nodes


def predict(nodes, features: np.ndarray) -> np.ndarray:
    """Class of each row of features, all rows at once."""
    feature, value, left, right = (np.array(x) for x in zip(*nodes, strict=True))
    at = np.zeros(len(features), int)
    while len(at) and (feature[at] >= 0).any():
        inner = np.flatnonzero(feature[at] >= 0)
        here = at[inner]
        at[inner] = np.where(features[inner, feature[here]] <= value[here], left[here], right[here])
    return value[at]


def main_text(pages: DataFrame, nodes=None) -> DataFrame:
    """page_id, url, text (main blocks in order, one line each) and n_chars (code points) of each page.

    A null html is empty, an empty or broken page gives what text it has, possibly none. Every input row gives one row:
    repeated rows and null ids stay. Other columns are ignored. An empty table gives an empty result.
    """
    nodes = nodes or train_tree(labelled_blocks(pages.sparkSession))

    def rows(batches):
        for batch in batches:
            out = []
            for page in batch.column("html"):
                texts, features = flat_blocks(page.as_py() or "")
                keep = predict(nodes, features)
                out.append("\n".join(t for t, k in zip(texts, keep, strict=True) if k))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(rows, "page_id long, url string, text string, n_chars long")
