"""Main text of web pages by composite text density.

Every node of the page's tree gets its characters per tag, lowered for text inside links. The node
whose children have the largest sum of densities holds the article; the smallest density on the path
from it up to the body is the threshold that other parts of the page have to reach. Parts that are
furniture by their tag or role (menus, forms ...) are cut off first. Class and id words (adverts,
comments ...) only hint at it: such a part stays if it holds the page's article.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimecast.llm.common import col, with_fields

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)\]\]>|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>",
    re.S,
)
#: The same without quotes, for pages whose quotes do not close.
_PLAIN_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)\]\]>|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)>(?P<end2>)(?P<tag2>)",
    re.S,
)
_OPEN_QUOTES = 32  # tags whose quotes run to the end of the page, after which quotes no longer count
_OPEN_END = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_STYLE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_NAME = re.compile(r"[a-z]+|\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg".split())
_FURNITURE = frozenset("nav footer aside form button select label fieldset dialog menu head video audio canvas map annotation annotation-xml".split()) | _RAW
_BLOCK = frozenset(
    "html body main article section header div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption hr br address details summary hgroup center search".split()
) | (_FURNITURE - {"button", "select", "label", "annotation", "annotation-xml"})
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar side aside footer foot masthead topbar cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments respond reply replies disqus discussion pagination pager toolbar widget skip hidden copyright legal "
    "disclaimer tags".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: What a start tag closes first if it is open: (closed, up to one of these).
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_SCOPE = frozenset("html body main article section aside nav header footer div table td th form".split())


class _Tree:
    """Nodes in page order; ``parts`` of a node are texts and numbers of child nodes."""

    def __init__(self) -> None:
        self.tags, self.parents, self.parts, self.cut, self.hints = ["body"], [-1], [[]], [False], [0]
        self.inside = [False]  # of an article or main, or one itself
        self.open: Counter = Counter()  # open elements by tag

    def add(self, parent: int, tag: str, cut: bool, hint: int = 0) -> int:
        node = len(self.tags)
        self.tags.append(tag)
        self.parents.append(parent)
        self.parts.append([])
        self.cut.append(cut or self.cut[parent])
        self.hints.append(hint)
        self.inside.append(self.inside[parent] or tag in ("article", "main"))
        self.parts[parent].append(node)
        return node


def _attributes(rest: str) -> dict[str, str]:
    """Names and values of a tag; of a repeated name the first one counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _furniture(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    if tag == "label" or tag == "header":
        if not inside_article:
            return True
    elif tag in _FURNITURE:
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    return attributes.get("role", "").lower() in _ROLES or bool(_STYLE.search(attributes.get("style", "")))


def _hint(attributes: dict[str, str]) -> int:
    """2 if a class or id consists of hint words, 1 if it has one among others (with-sidebar), else 0."""
    found = 0
    for name in ("class", "id"):
        for token in attributes.get(name, "").lower().split():
            words = [w for w in _NAME.findall(token) if not w.isdigit()]
            if any(w in _HINTS for w in words):
                found = max(found, 2 if all(w in _HINTS for w in words) else 1)
    return found


def _cut_hints(tree: _Tree) -> None:
    """Cut the nodes that a class or id hints at, but not what holds the page's article.

    A hinted node stays if it holds a main, or an article while no other stands outside of hinted nodes;
    if the hint is one word among others, also if it has more text outside links than all that is not
    hinted; and whatever its hint, if nothing else has any text.
    """
    if not any(tree.hints):
        return
    n = len(tree.tags)
    chars, mains, articles = [0] * n, [0] * n, [0] * n
    own, linked = [0] * n, [False] * n
    for i in range(n):
        linked[i] = tree.tags[i] == "a" or (i > 0 and linked[tree.parents[i]])
        if not tree.cut[i] and not linked[i]:
            own[i] = sum(len(" ".join(p.split())) for p in tree.parts[i] if isinstance(p, str))
    for i in range(n - 1, -1, -1):
        if tree.cut[i]:
            continue
        chars[i] += own[i]
        mains[i] += tree.tags[i] == "main"
        articles[i] += tree.tags[i] == "article" and not tree.hints[i]
        if i:
            for sums in (chars, mains, articles):
                sums[tree.parents[i]] += sums[i]
    asked = [bool(h) and t not in ("main", "article") for h, t in zip(tree.hints, tree.tags)]

    def outside() -> tuple[int, int]:
        """Text and articles that no node in question holds."""
        under, text, found = [False] * n, 0, 0
        for i in range(n):
            under[i] = asked[i] or (i > 0 and under[tree.parents[i]])
            if not under[i] and not tree.cut[i]:
                text += own[i]
                found += tree.tags[i] in ("main", "article") and not tree.hints[i]
        return text, found

    alone = outside()[1] == 0
    asked = [a and not (mains[i] or (alone and articles[i])) for i, a in enumerate(asked)]
    text = outside()[0]
    asked = [a and not (tree.hints[i] == 1 and chars[i] > text) for i, a in enumerate(asked)]
    if outside()[0] == 0:
        asked = [a and not chars[i] for i, a in enumerate(asked)]
    for i in range(1, n):
        tree.cut[i] = tree.cut[i] or asked[i] or tree.cut[tree.parents[i]]


def parse(page: str) -> _Tree:
    tree, stack, at, token, unclosed = _Tree(), [0], 0, _TOKEN, 0
    end_of_tags = page.rfind(">") + 1  # nothing behind can be a whole tag
    match = _TOKEN.search(page, 0, end_of_tags)
    while match:
        if match.start() > at:
            tree.parts[stack[-1]].append(html.unescape(page[at : match.start()]))
        at = match.end()
        if page.startswith("<!--", match.start()) and not page.endswith("-->", match.start() + 4, at):
            at = len(page)
        tag = (match["tag"] or match["tag2"] or "").lower()
        if match["data"]:
            tree.parts[stack[-1]].append(match["data"])
        elif tag and (match["end"] or match["end2"]):
            _close(tree, stack, tag)
        elif tag in ("html", "body"):
            pass  # the root stands for both
        elif tag:
            _before(tree, stack, tag)
            inside = tree.inside[stack[-1]]
            rest = match["rest"] or ""
            attributes = _attributes(rest) if rest else {}
            node = tree.add(stack[-1], tag, _furniture(tag, attributes, inside), _hint(attributes))
            if tag in _RAW and not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif tag not in _VOID and not (rest.endswith("/") and tag in ("svg", "path")):
                stack.append(node)
                tree.open[tag] += 1
        if match["tag2"] and '"' in match[0] or match["tag2"] and "'" in match[0]:
            unclosed += 1
            token = _PLAIN_TOKEN if unclosed > _OPEN_QUOTES else _TOKEN
        match = token.search(page, at, end_of_tags) if at < end_of_tags else None
    rest = _OPEN_END.split(page[at:], maxsplit=1)[0]  # a tag or comment that never ends shows nothing
    if rest:
        tree.parts[stack[-1]].append(html.unescape(rest))
    _cut_hints(tree)
    return tree


def _before(tree: _Tree, stack: list[int], tag: str) -> None:
    """Close what this start tag ends without an end tag of its own."""
    if tag in _CLOSES:
        closed, stop = _CLOSES[tag]
    elif tag in _BLOCK and tag != "br":
        closed, stop = {"p"}, _SCOPE
    else:
        return
    if not any(tree.open[name] for name in closed):
        return
    for depth in range(len(stack) - 1, 0, -1):
        name = tree.tags[stack[depth]]
        if name in closed:
            _leave(tree, stack, depth)
            return
        if name in stop:
            return


def _leave(tree: _Tree, stack: list[int], depth: int) -> None:
    """Close all elements from this depth on."""
    for node in stack[depth:]:
        tree.open[tree.tags[node]] -= 1
    del stack[depth:]


def _close(tree: _Tree, stack: list[int], tag: str) -> None:
    inline = tag not in _BLOCK
    if not tree.open[tag]:
        return  # a stray end tag
    for depth in range(len(stack) - 1, 0, -1):
        name = tree.tags[stack[depth]]
        if name == tag:
            _leave(tree, stack, depth)
            return
        if inline and name in _BLOCK:
            return  # a stray end tag


def densities(tree: _Tree) -> tuple[list[float], list[float]]:
    """Composite text density of every node, and the sum of its child blocks' and of the text it holds itself.

    Inline tags count as tags, but only blocks are summed: a bold first sentence is no child of its own,
    but part of the block's own text, so a block without child blocks has its own density as the sum.
    """
    n = len(tree.tags)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if tree.cut[i]:
            continue
        chars[i] += sum(len(" ".join(p.split())) for p in tree.parts[i] if isinstance(p, str))
        if tree.tags[i] == "a":
            link_chars[i], link_tags[i] = chars[i], tags[i] + 1
        if i:
            up = tree.parents[i]
            chars[up] += chars[i]
            tags[up] += tags[i] + 1
            link_chars[up] += link_chars[i]
            link_tags[up] += link_tags[i]
    share = link_chars[0] / chars[0] if chars[0] else 0.0

    def composite(c: int, t: int, lc: int, lt: int) -> float:
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * (lc or 1) + share * c + math.e)
        return c / (t or 1) * math.log(max(c / (lc or 1) * (t or 1) / (lt or 1), 1.0)) / math.log(base)

    # What of a block's counts lies in no child block with text.
    left = [list(x) for x in zip(chars, tags, link_chars, link_tags)]
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        density[i] = composite(chars[i], tags[i], link_chars[i], link_tags[i])
        if i and chars[i] and tree.tags[i] in _BLOCK:
            up = tree.parents[i]
            while up and tree.tags[up] not in _BLOCK:
                up = tree.parents[up]
            for k, x in enumerate((chars[i], tags[i] + 1, link_chars[i], link_tags[i])):
                left[up][k] -= x
    for i in range(n):
        if not tree.cut[i] and (not i or tree.tags[i] in _BLOCK):
            total[i] += composite(*(max(x, 0) for x in left[i]))
        if not density[i]:
            continue
        if i and tree.tags[i] in _BLOCK:
            up = tree.parents[i]
            while up and tree.tags[up] not in _BLOCK:
                up = tree.parents[up]
            total[up] += density[i]
    return density, total


def content(tree: _Tree) -> list[int]:
    """Roots of the chosen subtrees, in page order, none inside another."""
    density, total = densities(tree)
    n = len(tree.tags)
    best = max(range(n), key=lambda i: (total[i], -i))
    if total[best] <= 0:
        return [0]
    threshold, i = density[best], best
    while i >= 0:
        threshold = min(threshold, density[i])
        i = tree.parents[i]
    # The node of the largest sum in every subtree, bottom up; the first one on a tie.
    top = list(range(n))
    for i in range(n - 1, 0, -1):
        up = tree.parents[i]
        if (total[top[i]], -top[i]) > (total[top[up]], -top[up]):
            top[up] = top[i]
    chosen, marked = [], [False] * n
    for i in range(n):
        if density[i] >= threshold and density[i] > 0 and total[top[i]] > 0:
            marked[top[i]] = True
    inside = [False] * n
    for i in range(n):
        up = tree.parents[i]
        inside[i] = up >= 0 and (inside[up] or marked[up])
        if marked[i] and not inside[i]:
            chosen.append(i)
    return chosen


def block_texts(tree: _Tree, root: int) -> list[str]:
    """Texts of the blocks below a node, without furniture, white space as one space."""
    out, buffer = [], []

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        if text:
            out.append(text)
        buffer.clear()

    todo: list = [root]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            buffer.append(item)
        elif not tree.cut[item]:
            block = tree.tags[item] in _BLOCK
            if block:
                flush()
                todo.append(None)
            todo.extend(reversed(tree.parts[item]))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page, one line per block; empty if there is none."""
    if not page:
        return ""
    tree = parse(page)
    return "\n".join(t for root in content(tree) for t in block_texts(tree, root))


def _texts(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)


def extract(pages: DataFrame, html_column: str = "html", text: str = "text") -> DataFrame:
    """Add the main text; a column of this name is replaced. Null and empty pages give an empty text.

    Each page is judged alone, so repeated rows get equal texts, and an empty table stays empty.
    """
    return with_fields(pages, F.struct(F.pandas_udf(_texts, "string")(col(html_column)).alias(text)), [text])


def op3_html_extract(pages: DataFrame) -> DataFrame:
    out = extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
