"""Main text of web pages by union-free wrapper inference.

A page is a stream of tags and texts. Its wrapper is a union-free regular expression, kept as
a tree: a node is an element (tag and class), may be optional or repeated, and holds further
nodes and text slots. Equal neighbours collapse into one repeated group; pages of one host are
aligned one after another, and what only one side has becomes optional. A slot keeps how much
text and link text it had, and whether all pages had the same text there. Merging is the same
operation for a page and for a wrapper, so tasks align their own pages of a host first and the
partial wrappers meet in two further rounds: a host with a third of all pages costs each task
one small tree.

The finished wrapper of a host tells where the article is: the element that holds most running
text, where text in links counts against, and text that is the same on all pages little; element
and class names (article, main) only lower the share that is asked for. Inside it an element is
left out if its name marks it (the kinds of the contract), or if the wrapper shows a menu: links
that are the same on all pages. Other text that all pages share stays, on a host of any size. A
page that has no text at the wrapper's place gets a wrapper of its own.

Wrappers are bounded: elements below DEEPEST count as part of their ancestor, an element of more
than MOST_CHILDREN different children forgets their class names, and then has one repeated group
for each tag. That widens the expression and drops no text.

Null or empty html gives an empty text. Null urls form a host of their own. Repeated rows get
equal results, as do equal pages of a host; long pages count whole; of elements with equal text
the first, then the outer one is the article. An empty table gives an empty result. Other columns
travel in ``row`` whatever their names.
"""

from __future__ import annotations

import html as html_lib
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import staged

SALTS = 16
MOST_CHILDREN = 128
MENU_LINKS = 0.8  # of the characters of a menu are link text, at least
CONSTANT_WEIGHT = 0.2  # of text that is the same on all pages, where the article is looked for
DEEPEST = 48  # deeper elements count as part of their ancestor in wrappers, never in extraction
BROADCAST_BYTES = 32 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
BLOCKS = frozenset(
    "html head body article section main nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption "
    "blockquote pre figure figcaption form fieldset address details summary hr title menu dialog center noscript template select option textarea button iframe object svg video audio canvas".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
CLOSES_P = BLOCKS - frozenset("html head body button option select textarea".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr"), "tfoot": ("tbody", "tr")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
NEVER = frozenset("head script style nav footer header aside form noscript template button select option textarea title iframe object svg video audio canvas menu dialog".split())
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|comments?|commentlist|respond|replies|disqus|footer|header|masthead|cookies?|consent|notice|gdpr|popup|modal|overlay|"
    r"share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|signup|login|search|pagination|pager|toolbar|widget|copyright|skip-link|contentinfo|complementary|alert)(?:$|[\s_-])",
    re.IGNORECASE,
)
MAIN = re.compile(r"(?:^|[\s_-])(?:main|article|articlebody|post|entry|story|content|body-text|text)(?:$|[\s_-])", re.IGNORECASE)


class Node:
    __slots__ = ("label", "names", "parts", "tag")

    def __init__(self, tag: str, names: str = ""):
        self.tag, self.names = tag, names
        self.label = f"{tag}.{re.sub('[0-9]+', '0', names)}" if names else tag
        self.parts: list[Node | tuple[str, bool]] = []


def parse(html: str) -> Node:
    """A tree of block elements; inline elements are part of the text, of which is known whether it stands in a link."""
    root = Node("#root")
    # every open element: its tag, the block it belongs to or is, and how many links are open with it
    stack: list[tuple[str, Node, int]] = [("#root", root, 0)]
    opened: Counter[str] = Counter()
    top, links, at, n = root, 0, 0, len(html)

    def close(tag: str, stop: tuple[str, ...] = ()) -> None:
        nonlocal top, links
        if not opened[tag]:
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                opened.subtract(t for t, _, _ in stack[i:])
                del stack[i:]
                _, top, links = stack[-1]
                return
            if stack[i][0] in stop:
                return

    def push(tag: str) -> None:
        stack.append((tag, top, links))
        opened[tag] += 1

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            top.parts.append((html[at:lt], links > 0))
        if lt == n:
            break
        m = _TOKEN.match(html, lt)
        if not m:
            top.parts.append(("<", links > 0))
            at = lt + 1
            continue
        at = m.end()
        end, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if tag in ("br", "p") and not opened[tag]:
                top.parts.append((" ", False))
            close(tag, () if tag in BLOCKS else ("p", "li", "td", "th", "div", "article", "section", "body"))
            continue
        if tag in ("br", "wbr", "td", "th"):
            top.parts.append(("" if tag == "wbr" else " ", False))
        if tag in CLOSES_P:
            close("p", ("article", "section", "div", "main", "aside", "td", "th", "li", "table", "button"))
        for other in IMPLIED.get(tag, ()):
            close(other, SCOPE[tag])
        if tag in VOID or rest.endswith("/"):
            if tag in BLOCKS:
                top.parts.append(Node(tag))
            continue
        if tag in RAW:
            done = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
            raw = html[at : done.start() if done else n]
            at = done.end() if done else n
            if tag == "title":
                node = Node(tag)
                node.parts.append((raw, False))
                top.parts.append(node)
            continue
        if tag in BLOCKS:
            names = " ".join(x for a in _NAMES.findall(rest) for x in a if x).lower() if rest else ""
            if rest and _HIDDEN.search(rest):
                names = f"{names} popup".strip()
            node = Node(tag, " ".join(names.split()))
            top.parts.append(node)
            top = node
            push(tag)
        else:
            links += tag == "a"
            push(tag)
    return root


def barred(tag: str, names: str, path: tuple[str, ...] = ()) -> bool:
    """Menus, headers, footers, sidebars, notices, adverts, forms and comments by element or class name."""
    if tag in ("html", "body", "#root", "main"):
        return False
    if tag in NEVER:
        return True
    return bool(names) and bool(NAMED.search(names)) and not (tag == "article" and not re.search("comment", names))


# ---- wrappers: [label, optional, repeated, pages, chars, link chars, constant, children] ----

LABEL, OPTIONAL, REPEATED, PAGES, CHARS, LINKS, CONSTANT, CHILDREN = range(8)


def _slot(texts: list[tuple[str, bool]]) -> list | None:
    whole = " ".join("".join(t for t, _ in texts).split())
    if not whole:
        return None
    return ["#", False, False, 1, len(whole), sum(len(t.strip()) for t, a in texts if a), zlib.crc32(whole.encode("utf-8", "surrogatepass")), []]


def _add(children: list[list], child: list) -> None:
    if children and children[-1][LABEL] == child[LABEL]:
        merge(children[-1], child, same_page=True)
        children[-1][REPEATED] = True
    else:
        children.append(child)


def wrap(page: Node) -> list:
    """The wrapper of one page, of any depth."""
    # node, next part, texts since the last element, children so far, hash of all text so far
    stack: list[list] = [[page, 0, [], [], 0]]
    while True:
        node, i, texts, children, crc = top = stack[-1]
        part = node.parts[i] if i < len(node.parts) else None
        top[1] = i + 1
        if isinstance(part, tuple):
            texts.append(part)
            continue
        slot = _slot(texts)
        texts.clear()
        if slot:
            top[4] = crc = zlib.crc32(slot[CONSTANT].to_bytes(4, "little"), crc)
            _add(children, slot)
        if part is not None:
            stack.append([part, 0, [], [], 0])
            continue
        stack.pop()
        whole = [node.label, False, False, 1, sum(c[CHARS] for c in children), sum(c[LINKS] for c in children), crc, _few(children)]
        if not stack:
            return whole
        above = stack[-1]
        above[4] = zlib.crc32(crc.to_bytes(4, "little"), above[4])
        for c in [whole] if len(stack) <= DEEPEST else whole[CHILDREN]:
            _add(above[3], c)


def _tag(label: str) -> str:
    return label.partition(".")[0]


def fits(label: str, want: str) -> bool:
    """The label of an element is that of a wrapper's node, or is of a group without class names."""
    return label == want or (want.endswith(".*") and _tag(label) == want[:-2])


def _few(children: list[list]) -> list[list]:
    """The children, or, if they are too many, one repeated group for each tag."""
    if len(children) <= MOST_CHILDREN:
        return children
    kinds: dict[str, list] = {}
    for c in children:
        tag = _tag(c[LABEL])
        label = "#" if tag == "#" else f"{tag}.*"
        c[LABEL] = label
        if label in kinds:
            merge(kinds[label], c, same_page=True)
            kinds[label][REPEATED] = True
        else:
            kinds[label] = c
        kinds[label][OPTIONAL] = True
    return list(kinds.values())


def _aligned(a: list, b: list) -> list[tuple[list | None, list | None]]:
    """Children of both sides in an order that keeps both: matched by label along a longest common subsequence."""
    wide = {c[LABEL][:-2] for c in (*a, *b) if c[LABEL].endswith(".*")}
    x, y = ([f"{t}.*" if (t := _tag(c[LABEL])) in wide else c[LABEL] for c in side] for side in (a, b))
    for c, label in zip((*a, *b), (*x, *y), strict=True):
        c[LABEL] = label
    if x == y:
        return list(zip(a, b, strict=True))
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
            out.append((a[i], None))
            i += 1
        else:
            out.append((None, b[j]))
            j += 1
    return out


def merge(a: list, b: list, same_page: bool = False) -> list:
    """a generalised so that it also accepts b; in place."""
    children = []
    for p, q in _aligned(a[CHILDREN], b[CHILDREN]):
        if p is None or q is None:
            one = p or q
            one[OPTIONAL] = True
            children.append(one)
        else:
            children.append(merge(p, q, same_page))
    # neighbours of one label that alignment brought together are one repeated group
    joined: list[list] = []
    for c in children:
        _add(joined, c)
    a[CHILDREN] = _few(joined)
    a[OPTIONAL] |= b[OPTIONAL]
    a[REPEATED] |= b[REPEATED]
    a[PAGES] = max(a[PAGES], b[PAGES]) if same_page else a[PAGES] + b[PAGES]
    a[CHARS] += b[CHARS]
    a[LINKS] += b[LINKS]
    if a[CONSTANT] != b[CONSTANT]:
        a[CONSTANT] = None
    return a


def expression(w: list) -> str:
    """The wrapper as a union-free regular expression over tags, with #PCDATA for text slots."""
    if w[LABEL] == "#":
        inner = "#PCDATA" if w[CONSTANT] is None or w[PAGES] < 2 else "text"
    else:
        inner = f"<{w[LABEL]}>" + "".join(expression(c) for c in w[CHILDREN]) + f"</{w[LABEL].split('.')[0]}>"
    return f"({inner})+" if w[REPEATED] and not w[OPTIONAL] else f"({inner})*" if w[REPEATED] else f"({inner})?" if w[OPTIONAL] else inner


def _split(label: str) -> tuple[str, str]:
    tag, _, names = label.partition(".")
    return tag, names


def plan(w: list) -> dict:
    """Where a wrapper's article is, as a path of labels, and its menus: labels and hashes of text."""
    memo: dict[int, float] = {}

    def clean(node: list) -> float:
        """Running text of a node: not of barred elements, less link text, and little of what never varies."""
        got = memo.get(id(node))
        if got is None:
            if node[LABEL] == "#":
                got = float(max(0, node[CHARS] - 2 * node[LINKS]))
                got *= CONSTANT_WEIGHT if node[CONSTANT] is not None and node[PAGES] > 1 else 1
            else:
                got = 0.0 if barred(*_split(node[LABEL])) else sum(map(clean, node[CHILDREN]))
            memo[id(node)] = got
        return got

    found: list[tuple[int, float, tuple[str, ...], list]] = []
    menus: list[tuple[str, int]] = []

    def walk(node: list, path: tuple[str, ...]) -> None:
        for c in node[CHILDREN]:
            tag, names = _split(c[LABEL])
            if c[LABEL] == "#" or barred(tag, names):
                continue
            if c[PAGES] > 1 and c[CONSTANT] is not None and c[LINKS] and c[LINKS] >= MENU_LINKS * c[CHARS]:
                menus.append((c[LABEL], c[CONSTANT]))
                continue
            here = (*path, c[LABEL])
            rank = 3 if tag == "article" else 2 if tag == "main" or "articlebody" in names else 1 if tag in ("div", "section") and MAIN.search(names) else 0
            if rank:
                found.append((rank, clean(c), here, c))
            walk(c, here)

    walk(w, ())
    total = clean(w)
    path: tuple[str, ...] = ()
    node = w
    likely = [f for f in found if f[1] > 0 and f[1] >= 0.3 * total]
    if likely:
        _, _, path, node = max(likely, key=lambda f: (f[0], f[1], -len(f[2])))
    else:
        while True:  # down while one child has most of the running text
            inner = [(clean(c), c) for c in node[CHILDREN] if c[LABEL] != "#" and not barred(*_split(c[LABEL]))]
            size, child = max(inner, key=lambda x: x[0], default=(0, None))
            if child is None or child[REPEATED] or size <= 0.6 * clean(node) or _split(child[LABEL])[0] in ("p", "h1", "h2", "li", "tr"):
                break
            node, path = child, (*path, child[LABEL])
    return {"main": list(path), "menus": menus}


def extract(page: Node, where: dict) -> str:
    """The article's blocks in page order, one a line."""
    main = tuple(where["main"])
    menus = {(label, crc) for label, crc in where["menus"]}
    labels = {label for label, _ in menus}
    lines: list[str] = []
    texts: list[str] = []

    def flush() -> None:
        if texts:
            line = " ".join(html_lib.unescape("".join(texts)).split())
            texts.clear()
            if line:
                lines.append(line)

    # (node, path, next part); an explicit stack, for pages of any depth
    stack: list[list] = [[page, (), 0]]
    while stack:
        node, path, i = stack[-1]
        if i == len(node.parts):
            flush()
            stack.pop()
            continue
        stack[-1][2] = i + 1
        part = node.parts[i]
        inside = len(path) >= len(main) and all(map(fits, path, main))
        if isinstance(part, tuple):
            if inside:
                texts.append(part[0])
            continue
        here = (*path, part.label) if len(path) <= DEEPEST + 1 else path
        flush()
        if inside and len(path) >= len(main):
            heading = part.tag == "header" and "article" in (p.split(".")[0] for p in path)
            if barred(part.tag, part.names) and not heading:
                continue
            if part.label in labels and (part.label, wrap(part)[CONSTANT]) in menus:
                continue
        elif len(here) <= len(main) and not all(map(fits, here, main)):
            continue
        stack.append([part, here, 0])
    flush()
    return "\n".join(lines)


def _safe_parse(html: str | None) -> Node:
    return parse(html) if html else Node("#root")


def text_of(html: str | None, where: dict | None) -> str:
    page = _safe_parse(html)
    text = extract(page, where) if where else ""
    return text or (extract(page, plan(wrap(page))) if page.parts else "")


HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) over all pages."""
    read = pages.select(F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), HOST, 1)).alias("host"), F.col("html").cast("string").alias("html"))

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        for f in frames:
            for host, html in zip(f["host"], f["html"], strict=True):
                if html:
                    w = wrap(parse(html))
                    held[host] = merge(held[host], w) if host in held else w
            if len(held) > 2000:  # hosts held by one task are bounded; the rounds below merge the pieces
                yield pd.DataFrame([(h, json.dumps(w)) for h, w in held.items()], columns=["host", "wrapper"])
                held = {}
        yield pd.DataFrame([(h, json.dumps(w)) for h, w in held.items()], columns=["host", "wrapper"])

    def met(f: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for text in sorted(f["wrapper"]):
            w = json.loads(text)
            whole = w if whole is None else merge(whole, w)
        return pd.DataFrame([(f["host"].iloc[0], json.dumps(whole))], columns=["host", "wrapper"])

    parts = read.mapInPandas(local, "host string, wrapper string")
    salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    first = salted.groupBy("host", "salt").applyInPandas(lambda f: met(f), "host string, wrapper string")
    return first.groupBy("host").applyInPandas(lambda f: met(f), "host string, wrapper string")


def main_texts(pages: DataFrame) -> DataFrame:
    """pages as one struct ``row`` with text and n_chars."""

    @F.pandas_udf("string")
    def planned(ws: pd.Series) -> pd.Series:
        return ws.map(lambda w: json.dumps(plan(json.loads(w))))

    models = staged(wrappers(pages).select("host", planned("wrapper").alias("plan")), "wrapper-plans")
    size = models.agg(F.sum(F.length("host") + F.length("plan") + 64)).first()[0] or 0

    @F.pandas_udf("string")
    def extracted(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        memo: dict[str, dict] = {}
        for html, plans in parts:
            out = []
            for h, p in zip(html, plans, strict=True):
                where = None
                if p is not None:
                    where = memo.get(p) or memo.setdefault(p, json.loads(p))
                out.append(text_of(h, where))
            yield pd.Series(out, dtype=object)

    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"),
        F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), HOST, 1)).alias("host"),
    )
    joined = rows.join(F.broadcast(models) if size <= BROADCAST_BYTES else models, "host", "left")
    got = joined.select("row", extracted(F.col("row.html").cast("string"), F.col("plan")).alias("text"))
    return got.select("row", "text", F.length("text").cast("long").alias("n_chars"))
