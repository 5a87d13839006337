"""Main text of web pages by tag-path ratios."""

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .worker import slices, tidy

#: Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video select textarea button option".split())
HIDDEN = frozenset("head title nav header footer aside form menu dialog fieldset label".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CONTENT = frozenset("article main".split())
#: Class, id and role words of what stands around an article, with what may stand before and behind them.
#: A name has to be such a word as a whole: related-work, share-price or has-sidebar are none.
_BEFORE = r"(?:(?:site|page|global|main|top|bottom|left|right|primary|secondary|sticky|inline|user|reader|blog|article|post)[-_]?)?"
_BEHIND = r"(?:[-_]?(?:area|articles|bar|block|body|bottom|box|buttons?|container|content|form|inner|items?|left|links?|list|menu|module|notice|overlay|panel|posts|primary|right|secondary|section|slot|stories|thread|top|unit|widget|wrap|wrapper))?(?:[-_]?\d+)?"
_WORDS = (
    "ads?", "advert", "adverts", "advertisement", "advertising", "aside", "banner", "breadcrumbs?", "consent", "contentinfo", "cookies?", "footer", "gdpr",
    "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notices?", "pagination", "popup", "search", "share", "sharing",
    "sidebar", "signup", "skip", "social", "subscribe", "toolbar", "widget",
)
_SURE = ("comments?", "commentlist", "disqus", "repl(?:y|ies)", "responses", "related", "sponsor(?:s|ed)?", "promos?", "promotion", "promoted")
_AROUND = re.compile(rf"(?<!\S){_BEFORE}(?:{'|'.join(_WORDS)}){_BEHIND}(?!\S)", re.I)
_NEVER = re.compile(rf"(?<!\S){_BEFORE}(?:{'|'.join(_SURE)}){_BEHIND}(?!\S)", re.I)
_ARTICLE = re.compile(r"(?<!\S)(?:article|content|entry|main|post|story|text|body)(?!\S)", re.I)
#: Attributes of a tag: quotes count only right after an equals sign, stray ones are skipped, as browsers do.
_ATTRIBUTES = r"""(?>\s+|/|[^\s"'>/=<][^\s>/=]*+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*+))?|["'=<])*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_PUNCTUATION = re.compile(r"[.,;:!?¡¿…。，、；：！？]")


class Block:
    """Text between two block boundaries: its path (a number), its innermost element and how much of it is in links."""

    __slots__ = ("path", "node", "parts", "linked", "text")

    def __init__(self, path: int, node: int):
        self.path, self.node, self.parts, self.linked, self.text = path, node, [], 0, ""


class Tree:
    """A page's elements, numbered in page order from 1 (0 is the page), and its paths. Depth costs nothing: elements
    and paths know their parents only."""

    def __init__(self) -> None:
        self.parent, self.tags, self.beside = [0], [""], [None]
        self.paths: dict[tuple[int, str], int] = {}
        self.leaf = [""]  # last tag of a path

    def element(self, parent: int, tag: str, beside: bool | None) -> int:
        self.parent.append(parent)
        self.tags.append(tag)
        self.beside.append(beside)
        return len(self.tags) - 1

    def path(self, path: int, tag: str) -> int:
        got = self.paths.setdefault((path, tag), len(self.leaf))
        if got == len(self.leaf):
            self.leaf.append(tag)
        return got

    def sums(self, at: list[tuple[int, float]]) -> list[float]:
        """What the places of `at` add up to in each element with all that it holds."""
        out = [0.0] * len(self.tags)
        for node, n in at:
            out[node] += n
        for node in range(len(out) - 1, 0, -1):
            out[self.parent[node]] += out[node]
        return out

    def outermost(self, chosen) -> list[int]:
        """For each element the outermost chosen one that is it or holds it, or 0."""
        out = [0] * len(self.tags)
        for node in range(1, len(out)):
            out[node] = out[self.parent[node]] or (node if chosen(node) else 0)
        return out


def _beside(tag: str, names: str, header: bool, nested: bool) -> bool | None:
    """Whether an element's class, id or role says that it stands beside the article: None for no, True where the name
    alone tells (comments, related and sponsored parts), False where its share of the text has to tell."""
    if not names or tag in ("html", "body"):
        return None
    if _NEVER.search(names):
        return True if tag not in CONTENT or nested else None
    return False if tag not in CONTENT and not header and _AROUND.search(names) and not _ARTICLE.search(names) else None


def blocks(page: str) -> tuple[list[Block], Tree]:
    """The page's text blocks in order, without what is hidden or stands in elements of navigation, forms and the like.

    Tolerant: unclosed and stray tags are taken as browsers mostly do. Linear in the page, however deep it is nested.
    """
    out: list[Block] = []
    tree = Tree()
    # tag, around, content (2 inside article), inside a link, element, path
    stack: list[tuple[str, bool, int, bool, int, int]] = [("", False, 0, False, 0, 0)]
    opened: Counter[str] = Counter()  # open elements by tag
    blocks_in = [Counter()]  # those since the last article or main, block by block
    inline_in = [Counter()]  # inline ones since the last block
    here: Block | None = None
    at, n = 0, len(page)

    def push(entry) -> None:
        stack.append(entry)
        tag = entry[0]
        opened[tag] += 1
        if tag in INLINE:
            inline_in[-1][tag] += 1
            return
        blocks_in[-1][tag] += 1
        inline_in.append(Counter())
        if tag in CONTENT:
            blocks_in.append(Counter())

    def pop() -> None:
        tag = stack.pop()[0]
        opened[tag] -= 1
        if tag in INLINE:
            inline_in[-1][tag] -= 1
            return
        if tag in CONTENT:
            blocks_in.pop()
        inline_in.pop()
        blocks_in[-1][tag] -= 1

    def text(s: str) -> None:
        nonlocal here
        _, around, _, link, node, path = stack[-1]
        if not s or around:
            return
        if here is None:
            if not s.strip():
                return
            here = Block(path, node)
            out.append(here)
        here.parts.append(s)
        if link:
            here.linked += len(s)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        m = _TOKEN.match(page, lt)
        if not m:  # a bare less-than sign
            text("<")
            at = lt + 1
            continue
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if tag not in INLINE:
            here = None
        if m[1]:
            if tag in CONTENT:  # closes the innermost article or main only if it is one
                close = len(blocks_in) > 1 and next(s[0] for s in reversed(stack) if s[0] in CONTENT) == tag
            else:  # a stray end tag closes nothing outside its block, or its article
                close = (inline_in if tag in INLINE else blocks_in)[-1][tag] > 0
            while close:
                close = stack[-1][0] != tag
                pop()
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = _END[tag].search(page, at)
                at = end.end() if end else n
            here = None
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            while stack[-1][0] == "p":
                pop()
            closes = _CLOSED_BY.get(tag, ())
            while stack[-1][0] in closes or stack[-1][0] in INLINE and (opened["p"] or any(opened[t] for t in closes)):
                pop()
        if m[3].rstrip().endswith("/") and tag not in INLINE:
            continue
        names = " ".join(a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(m[3]) if k.lower() in ("class", "id", "role"))
        hidden = bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", m[3], re.I))
        _, around, content, link, node, path = stack[-1]
        nested, content = content == 2, 2 if tag == "article" else max(content, tag in CONTENT)
        header = tag == "header" and content > 0  # an article's own header holds its heading
        around = around or hidden or tag in HIDDEN and not header
        push((tag, around, content, link or tag == "a", tree.element(node, tag, _beside(tag, names, header, nested)), path if tag in INLINE else tree.path(path, tag)))
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
        b.parts = []
    return [b for b in out if b.text], tree


def _without_beside(found: list[Block], tree: Tree) -> list[Block]:
    """The blocks outside of the named elements that do stand beside the article, by their share of the text outside links.

    Comments and their like are ruled out unless hardly any text is left without them. Other names rule out an element
    unless it holds most of the rest: of what is inside article and main or, where those hold little, of all of it.
    """
    inside = tree.outermost(lambda e: tree.tags[e] in CONTENT)
    out: set[int] = set()
    for sure in (True, False):
        gone = tree.outermost(out.__contains__)
        size = [(b.node, max(0, len(b.text) - b.linked)) for b in found if not gone[b.node]]
        held, core = tree.sums(size), tree.sums([(e, n) for e, n in size if inside[e]])
        total, content = held[0], core[0]
        for e, kind in enumerate(tree.beside):
            if kind == sure and kind is not None:
                n, part = held[e], core[e]
                most = 10 * (total - n) < n if sure else 2 * part > content or 2 * n > total and 10 * (content - part) < n
                if not most:
                    out.add(e)
    gone = tree.outermost(out.__contains__)
    return [b for b in found if not gone[b.node]] or found


def path_scores(found: list[Block], spread: float) -> dict[int, tuple[float, float]]:
    """(fused score, letters outside links a block) of each path, paths in page order."""
    order: dict[int, list[float]] = {}
    for b in found:
        t = b.text
        row = order.setdefault(b.path, [0, 0, 0])
        row[0] += max(0, len(t) - b.linked)
        row[1] += len(_PUNCTUATION.findall(t)) * (b.linked * 2 < len(t))
        row[2] += 1
    reach = max(1, math.ceil(2 * spread))
    weight = [math.exp(-(d * d) / (2 * spread * spread)) for d in range(reach + 1)]

    def smooth(xs: list[float]) -> list[float]:
        out = []
        for i in range(len(xs)):
            near = [(weight[abs(j - i)], xs[j]) for j in range(max(0, i - reach), min(len(xs), i + reach + 1))]
            out.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
        return out

    length = [r[0] / r[2] for r in order.values()]
    marks = smooth([r[1] / r[2] for r in order.values()])
    return {p: (math.sqrt(a * b), x) for p, a, b, x in zip(order, smooth(length), marks, length, strict=True)}


def main_text(page: str, spread: float = 1.0, share: float = 0.25) -> str:
    """The page's main text by tag-path ratios, its blocks joined by a space.

    Paths are root-to-leaf element names without inline ones. A path's ratios are its text length and its punctuation,
    each over its number of blocks; both are smoothed over the paths in page order by a Gaussian of `spread` paths and
    fused by a geometric mean. Paths that reach `share` of the text-weighted mean are content nodes. The article is then
    the element around them: the article or main elements that hold most of their text or, without such, the smallest
    element that does; its other blocks (headings, short lines) belong to it unless they are mostly links. Blocks of
    navigation, notices, adverts, forms, comments and the like never count; where only a class, id or role says so, the
    element's share of the text has to agree, and nothing is ruled out by name when nothing else is left.
    """
    found, tree = blocks(page)
    if any(x is not None for x in tree.beside):
        found = _without_beside(found, tree)
    if not found:
        return ""
    scores = path_scores(found, spread)
    size = [max(0, len(b.text) - b.linked) for b in found]
    total = sum(size)
    mean = sum(scores[b.path][0] * n for b, n in zip(found, size, strict=True)) / total if total else 0
    good = [i for i, b in enumerate(found) if scores[b.path][0] >= share * mean and scores[b.path][1] > 0]
    if not good:
        return " ".join(b.text for b in found)
    chosen = set(good)
    most = sum(size[i] for i in good) / 2
    for kind in ("article", "main"):
        top = tree.outermost(lambda e: tree.tags[e] == kind)  # noqa: B023
        roots = {top[found[i].node] for i in good} - {0}
        if sum(size[i] for i in good if top[found[i].node] in roots) > most:
            return " ".join(b.text for i, b in enumerate(found) if top[b.node] in roots and (i in chosen or b.linked * 2 <= len(b.text)))
    held = tree.sums([(found[i].node, size[i]) for i in good])
    root = max((e for e, n in enumerate(held) if n > 1.6 * most and tree.tags[e] not in INLINE), default=0)
    if tree.tags[root] not in ("", "html", "body"):
        within = tree.outermost(root.__eq__)
        chosen |= {i for i, b in enumerate(found) if within[b.node] and b.linked * 2 <= len(b.text)}
    else:  # no element of its own: headings right before a content node go with it
        chosen |= {i for i, b in enumerate(found) if re.fullmatch("h[1-6]", tree.leaf[b.path]) and i + 1 in chosen}
    return " ".join(found[i].text for i in sorted(chosen))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row. A null or empty page gives an empty text; repeated rows give equal ones;
    extra columns are ignored; an empty table gives no row. One pass over the pages, no shuffle."""

    def run(batches):
        for batch in slices(batches, rows=128):
            texts = [main_text(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["k", "u", "t", "n"]
            )

    named = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), F.col(page).alias("h"))
    return named.mapInArrow(tidy(run), "k long, u string, t string, n long").toDF(key, url, "text", "n_chars")
