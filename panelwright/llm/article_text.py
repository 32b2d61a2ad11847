"""Main text of report pages: flat text blocks, classified by a decision tree over their own and their neighbours' figures."""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by the part they play in a page.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td
tfoot th thead tr ul""".split())
HIDDEN = frozenset("script style noscript template svg math iframe object head textarea select title canvas audio video".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
APART = frozenset("nav footer aside form menu dialog button".split())
BODY = frozenset("article main".split())
# Words in class, id and role that name furniture of a page.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|adslot|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|"
    r"newsletter|subscri\w*|signup|sign-up|login|register|nav\w*|menu\w*|breadcrumbs?|pagination|pager|toc|sidebar\w*|side|aside|"
    r"widget\w*|related|recommend\w*|more-from|trending|popular|share|sharing|social\w*|follow|footer\w*|foot|header|masthead|"
    r"topbar|toolbar|comments?|comment-\w+|replies|reply|respond|disqus|discussion|reviews?|feedback|form|search\w*|skip\w*|"
    r"copyright|legal|disclaimer|complementary|contentinfo|navigation|hidden)(?=$|[\s_-])", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article\w*|content|entry-content|post-content|post-body|story\w*|main|trs_editor\w*)(?=$|[\s_-])", re.I)
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WHITE = re.compile(r"\s+")

FEATURES = ("apart", "inside", "heading", "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after")

#: The labelled table. One row per block: the features in the order above, then 1 for main text.
LABELLED = (
    # in an article or main element: titles, sentences of any length, lists of links within it
    (0, 1, 1, 8, 0.0, 3, 1.0, 60, 0.0, 1), (0, 1, 1, 5, 0.0, 0, 0.0, 40, 0.0, 1), (0, 1, 1, 1, 0.0, 12, 0.0, 2, 0.0, 1),
    (0, 1, 0, 60, 0.0, 8, 0.0, 45, 0.0, 1), (0, 1, 0, 1, 0.0, 30, 0.0, 0, 0.0, 1), (0, 1, 0, 2, 0.0, 1, 0.0, 1, 0.0, 1),
    (0, 1, 0, 120, 0.1, 2, 0.0, 9, 0.0, 1), (0, 1, 0, 7, 0.0, 7, 0.0, 7, 0.0, 1), (0, 1, 0, 14, 0.5, 40, 0.0, 33, 0.0, 1),
    (0, 1, 0, 3, 1.0, 50, 0.0, 60, 0.0, 1), (0, 1, 0, 400, 0.0, 0, 0.0, 0, 0.0, 1), (0, 1, 0, 25, 0.02, 300, 0.0, 11, 1.0, 1),
    # menus, footers, adverts, notices, forms, comments: within an element that says so
    (1, 0, 0, 1, 1.0, 0, 0.0, 1, 1.0, 0), (1, 0, 0, 2, 1.0, 1, 1.0, 3, 1.0, 0), (1, 0, 0, 9, 0.0, 1, 1.0, 8, 0.0, 0),
    (1, 0, 0, 14, 0.0, 60, 0.0, 0, 0.0, 0), (1, 0, 0, 40, 0.0, 30, 0.0, 20, 0.0, 0), (1, 1, 0, 35, 0.0, 50, 0.0, 40, 0.0, 0),
    (1, 1, 0, 4, 1.0, 70, 0.0, 80, 0.0, 0), (1, 1, 1, 3, 0.0, 40, 0.0, 15, 0.0, 0), (1, 0, 1, 4, 0.0, 0, 0.0, 9, 1.0, 0),
    (1, 0, 0, 150, 0.0, 140, 0.0, 0, 0.0, 0), (1, 0, 0, 6, 0.0, 6, 0.0, 6, 0.0, 0), (1, 1, 0, 120, 0.0, 3, 0.0, 200, 0.0, 0),
    # no such mark around: long blocks and what stands beside them, but not runs of links
    (0, 0, 0, 80, 0.0, 6, 0.0, 70, 0.0, 1), (0, 0, 0, 45, 0.05, 80, 0.0, 3, 1.0, 1), (0, 0, 0, 30, 0.1, 2, 1.0, 35, 0.0, 1),
    (0, 0, 0, 22, 0.0, 4, 1.0, 2, 1.0, 1), (0, 0, 1, 7, 0.0, 2, 1.0, 50, 0.0, 1), (0, 0, 1, 4, 0.0, 60, 0.0, 44, 0.0, 1),
    (0, 0, 0, 6, 0.0, 50, 0.0, 60, 0.0, 1), (0, 0, 0, 3, 0.0, 40, 0.0, 25, 0.0, 1), (0, 0, 0, 9, 0.0, 33, 0.0, 5, 0.0, 1),
    (0, 0, 0, 2, 1.0, 1, 1.0, 2, 1.0, 0), (0, 0, 0, 5, 0.9, 4, 1.0, 6, 0.8, 0), (0, 0, 0, 18, 0.8, 3, 1.0, 40, 0.0, 0),
    (0, 0, 0, 3, 0.0, 2, 1.0, 2, 1.0, 0), (0, 0, 0, 4, 0.0, 1, 1.0, 0, 0.0, 0), (0, 0, 0, 1, 0.0, 0, 0.0, 2, 1.0, 0),
    (0, 0, 1, 2, 0.0, 3, 1.0, 3, 1.0, 0), (0, 0, 0, 40, 0.7, 30, 0.9, 20, 1.0, 0), (0, 0, 0, 6, 0.5, 55, 0.0, 2, 1.0, 0),
)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8):
    """A decision tree by Gini impurity: a label, or (feature, threshold, lower branch, upper branch)."""
    share = labels.mean()
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)
    best = None
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for threshold in (values[1:] + values[:-1]) / 2:
            low = rows[:, feature] <= threshold
            impurity = sum(side.sum() * labels[side].mean() * (1 - labels[side].mean()) for side in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, feature, threshold)
    if best is None:
        return int(share >= 0.5)
    _, feature, threshold = best
    low = rows[:, feature] <= threshold
    return feature, threshold, grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)


@lru_cache(maxsize=1)
def trained_tree():
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1])


def classify(tree, row) -> bool:
    while isinstance(tree, tuple):
        feature, threshold, low, high = tree
        tree = low if row[feature] <= threshold else high
    return bool(tree)


def _marks(name: str, attributes: str, in_body: bool) -> tuple[bool, bool, bool]:
    """(hidden, apart, body) of an opening tag."""
    hidden = name in HIDDEN
    apart = name in APART or (name == "header" and not in_body)
    body = name in BODY
    if attributes:
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id", "role"):
                if name not in ("html", "body") and FURNITURE.search(value):
                    apart = apart or name not in BODY
                if CONTENT.search(value) and not FURNITURE.search(value):
                    body = True
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                hidden = True
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = True
    return hidden and name not in VOID, apart, body


def text_blocks(page: str) -> list[tuple[str, tuple]]:
    """(text, (apart, inside, heading, words, link density)) of every block in page order; hidden elements give none.

    A block is the text between two tags of block elements; line breaks and inline tags stay inside. White space is one space.
    """
    out: list[tuple[str, tuple]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, hidden, apart, body
    hidden = apart = body = links = heading = 0
    pieces: list[str] = []
    linked: list[str] = []

    def close() -> None:
        if pieces:
            text = WHITE.sub(" ", html_module.unescape("".join(pieces))).strip()
            if text:
                inner = len(html_module.unescape("".join(linked)).split())
                count = len(text.split())
                out.append((text, (int(apart > 0), int(body > 0), int(heading > 0), count, min(1.0, inner / count))))
            pieces.clear()
            linked.clear()

    def say(text: str) -> None:
        if text and not hidden:
            pieces.append(text)
            if links:
                linked.append(text)

    at, raw = 0, None
    while True:
        if raw is not None:
            end = re.compile(rf"</{raw}\s*>|\Z", re.I).search(page, at)
            if raw == "textarea" or raw == "title":
                say("")
            at, raw = end.start(), None
        tag = TAG.search(page, at)
        say(page[at : tag.start() if tag else len(page)])
        if tag is None:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS or name in HIDDEN or name in APART:
            close()
        elif name == "br":
            say(" ")
        if tag[1]:
            if any(entry[0] == name for entry in stack):
                while stack:
                    entry = stack.pop()
                    hidden, apart, body = hidden - entry[1], apart - entry[2], body - entry[3]
                    links -= entry[0] == "a"
                    heading -= entry[0] in ("h1", "h2", "h3", "h4", "h5", "h6")
                    if entry[0] == name:
                        break
            continue
        if name in VOID or tag[3].endswith("/") and name not in BLOCKS | HIDDEN:
            continue
        while stack and ((name == "li" and stack[-1][0] == "li") or (stack[-1][0] == "p" and name in BLOCKS) or (name == "option" and stack[-1][0] == "option")):
            entry = stack.pop()
            hidden, apart, body = hidden - entry[1], apart - entry[2], body - entry[3]
        marks = _marks(name, tag[3], body > 0)
        stack.append((name, *marks))
        hidden, apart, body = hidden + marks[0], apart + marks[1], body + marks[2]
        links += name == "a"
        heading += name in ("h1", "h2", "h3", "h4", "h5", "h6")
        if name in RAW:
            raw = name
    close()
    return out


def main_text(page: str) -> str:
    """The blocks that the tree calls main text, one a line."""
    blocks, tree = text_blocks(page), trained_tree()
    nothing = (0, 0, 0, 0, 0.0)
    kept = []
    for k, (text, own) in enumerate(blocks):
        before = blocks[k - 1][1] if k else nothing
        after = blocks[k + 1][1] if k + 1 < len(blocks) else nothing
        if classify(tree, (*own, before[3], before[4], after[3], after[4])):
            kept.append(text)
    return "\n".join(kept)


def _extract(batches: Iterator):
    import pyarrow as pa

    for batch in batches:
        texts = [main_text(page or "") for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "source_url", "text", "n_chars"])


def article_text(pages: DataFrame, page_id: str = "page_id", source_url: str = "source_url", html: str = "html") -> DataFrame:
    """(page_id, source_url, text, n_chars) of every report page: its main text and that text's number of characters.

    The page is cut into flat blocks. A block's features are its words, the share of them in links, the same of the block
    before and after it, whether an element around it is a menu, footer, side, form, advert, notice or comment part by
    its name, class, id or role, whether an article or main element surrounds it, and whether it is a heading. A decision
    tree grown from ``LABELLED`` keeps or drops it. Kept blocks are joined in page order by a line break; nothing is cut
    off. Character references are decoded, white space becomes one space, scripts, styles, comments and hidden elements
    give nothing. A null page is empty and has the text ''. Every row is returned, repeated or without id too; other
    columns are ignored; an empty table gives an empty result. One pass over the pages, no shuffle.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(source_url).alias("source_url"), F.col(html).alias("html"))
    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(_extract, f"page_id {kind}, source_url string, text string, n_chars long")
