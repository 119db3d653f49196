"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read once into blocks of text, each with the chain of elements that hold it. A classifier sums graded evidence
(containers, words of class names, links, length, sentences that only notices have) into log odds, which are the capacities
between a block and the two terminals, content and boilerplate. No word decides alone: a listed word in a name with other
words weighs less than what a paragraph of an article earns, and a notice's phrase weighs as much as its sentence's share of
the block, and nothing inside an article, as texts have lines of licences of their own. Blocks that follow each other or share
a container are joined by smoothness edges, the weaker the farther apart they stand in the document tree. Capacities and edges are of one order, so a block of
weak evidence takes the label of those around it. The minimum cut is the labelling of least total cost. A block whose own
capacity exceeds all its edges together keeps its label in every minimum cut; max-flow runs on all others.

Tags are read as browsers do: quotes count only behind an equals sign, an end tag without a start is ignored, and a tag that
never ends takes the rest of the page. Reading is linear in the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm.common import in_batches, table

# Element classes of HTML and MathML.
RAW = frozenset("script style noscript template textarea title iframe object svg select option button xmp noembed noframes annotation".split())
OPEN_ENDED = frozenset("svg select option button annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
INLINE |= frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
BOILER = frozenset("nav footer aside form menu dialog head header".split())
MAIN = frozenset("article main".split())
#: Words of class names, ids and roles that tell boilerplate, alone or beside each other and words of layout.
STRONG = frozenset("ad ads advert advertisement sponsor sponsored promo promotion cookie cookies consent popup modal overlay newsletter navbar navigation breadcrumb breadcrumbs footer masthead sidebar related recommended comments disqus pagination pager gdpr".split())
#: Those that name parts of articles too.
WEAK = frozenset("banner notice subscribe signup login share sharing social nav menu header side aside widget comment reply replies respond discussion form search toolbar legal copyright alert".split())
LAYOUT = frozenset("area bar block bottom box btn button buttons container content group inner item items left links list main outer page panel right row section site slot small top wrap wrapper".split())
MAIN_WORDS = frozenset("article content main post story entry body text".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
GAP = re.compile(r"[\s/]*")
COMMENT_END = re.compile(r"--!?>")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
SPACE = re.compile(r"\s+")
NUMBERED = re.compile(r"\d+(?:x\d+)?")
#: Sentences that only notices, forms and links to other parts of a site have, in the four languages of the corpus.
NOTICE = re.compile(
    r"all rights reserved|\(c\) ?\d{4}|© ?\d{4}|copyright ©|sign up for (?:our|the|free)|subscribe to (?:our|the) (?:news|letter|list)|join our (?:mailing|news)|(?:we|this (?:site|page|website)) uses? cookies|accept (?:all )?cookies"
    r"|(?:read|see) our (?:privacy|cookie|terms)|terms (?:of (?:use|service)|and conditions) apply|log in to (?:comment|reply)|leave a (?:comment|reply)|share (?:this|on) (?:article|page|post|facebook)|follow us on|click here to (?:subscribe|sign)"
    r"|alle rechte vorbehalten|wir verwenden cookies|newsletter abonnieren|melden sie sich (?:an|für unseren)|tous droits réservés|nous utilisons des cookies|abonnez-vous à|inscrivez-vous à|todos los derechos reservados|usamos cookies|utilizamos cookies|suscr[ií]bete a"
)
SENTENCE = re.compile(r"[^.!?…]+[.!?…]*")

# Log odds of the classifier, and the smoothness edges.
IN_MAIN, BESIDE_MAIN, BY_TAG, BY_NAME, BY_HALF, BY_MAIN_WORD, BY_NOTICE, FLOOR, HIDDEN = 2.0, -2.5, -4.0, -4.0, -1.5, 0.8, -6.5, -8.0, -20.0
ADJACENT, SIBLING, NEAR = 1.2, 0.4, 8


class Element:
    """An open element: evidence adds up along the chain of elements that hold it."""

    __slots__ = ("boiler", "main", "number", "parent", "prior", "tag")

    def __init__(self, tag: str, parent: Element | None, number: int, attributes: dict[str, str]):
        self.tag, self.parent, self.number = tag, parent, number
        self.main = parent.main if parent else False
        self.prior = parent.prior if parent else 0.0
        self.boiler = parent.boiler if parent else 0.0
        boiler, prior = evidence(tag, attributes) if attributes else (0.0, 0.0)
        if tag in BOILER and not (tag == "header" and self.main):
            boiler = min(boiler, BY_TAG)
        if boiler <= HIDDEN:
            self.boiler = HIDDEN
        elif tag in MAIN:
            self.main = True
        self.boiler = max(self.boiler + boiler, FLOOR) if self.boiler > HIDDEN else HIDDEN
        self.prior = min(1.6, self.prior + prior)


def evidence(tag: str, attributes: dict[str, str]) -> tuple[float, float]:
    """(log odds against, log odds for) that an element's names tell. Of article elements only names that consist of such words
    count, and those of whole pages and main parts not at all."""
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "style" in attributes and UNSEEN.search(attributes["style"]):
        return HIDDEN, 0.0
    against = support = 0.0
    for name in ("class", "id", "role", "aria-label"):
        for token in attributes[name].lower().split() if name in attributes else ():
            words = {w for w in SPLIT.split(token) if w}
            weak, strong = words & WEAK, words & STRONG
            alone = all(w in WEAK or w in STRONG or tag != "article" and (w in LAYOUT or NUMBERED.fullmatch(w)) for w in words)
            if tag in ("body", "html", "main") or tag == "article" and not alone:
                continue
            if strong or weak:
                against = min(against, BY_NAME if alone else BY_HALF)
            if words & MAIN_WORDS and not strong and not (weak and alone):
                support = BY_MAIN_WORD
    return against, support


@dataclass
class Block:
    text: str
    parent: Element
    links: int = 0


def read_tag(page: str, at: int) -> tuple[int, dict[str, str]]:
    """(behind the tag's end, its attributes) from behind its name; the page's length if it never ends."""
    found: dict[str, str] = {}
    size = len(page)
    while True:
        at = GAP.match(page, at).end()
        if at >= size:
            return size + 1, found
        if page[at] == ">":
            return at + 1, found
        m = ATTRIBUTE.match(page, at)
        if not m:
            at += 1
            continue
        at = m.end()
        if m[2] is None and m[3] is None and m[4] is None:
            sign = GAP.match(page, at).end()
            if page[sign : sign + 1] == "=" and page[(quote := GAP.match(page, sign + 1).end()) : quote + 1] in ("'", '"'):
                return size + 1, found  # a quote that never ends
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")


class Reader:
    """Reads a page into blocks: text between the starts and ends of block elements, inline markup removed, character
    references decoded, white space turned into single spaces. An inline element with evidence against it is a block of its
    own, and the text around it stays one block."""

    def __init__(self, page: str):
        self.page, self.out, self.number = page, [], 0
        self.parent = Element("#root", None, 0, {})
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.links, self.in_link = 0, False
        self.aside: list[tuple[str, int, Element, list[str], int]] = []  # (tag, inner elements of that tag, ...) of inline blocks
        self.unclosed: set[str] = set()

    def blocks(self) -> list[Block]:
        page, at = self.page, 0
        while at < len(page):
            found = page.find("<", at)
            if found < 0:
                self.text(page[at:])
                break
            m = TAG.match(page, found)
            sign = page[found + 1 : found + 2]
            if not m and sign not in ("!", "?", "/"):
                self.text(page[at : found + 1])
                at = found + 1
                continue
            self.text(page[at:found])
            if m:
                at, attributes = read_tag(page, m.end())
                if at <= len(page):
                    at = self.end(m[2].lower(), at) if m[1] else self.start(m[2].lower(), attributes, at)
            elif page.startswith("<!--", found):
                closed = COMMENT_END.search(page, found + 2)
                at = closed.end() if closed else len(page)
            else:
                closed = page.find(">", found)
                at = closed + 1 if closed >= 0 else len(page)
        self.close()
        return self.out

    def text(self, piece: str) -> None:
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            self.parts.append(piece)
            if self.in_link:
                self.links += len(piece.strip())

    def emit(self) -> None:
        whole = SPACE.sub(" ", "".join(self.parts)).strip() if self.parts else ""
        if whole:
            self.out.append(Block(whole, self.parent, self.links))
        self.parts, self.links = [], 0

    def close(self) -> None:
        while self.aside:
            self.leave()
        self.emit()

    def leave(self) -> None:
        """The end of an inline block."""
        self.emit()
        _, _, self.parent, self.parts, self.links = self.aside.pop()

    def start(self, tag: str, attributes: dict[str, str], at: int) -> int:
        if tag in RAW:
            return self.skip(tag, at)
        if tag in ("br", "mspace"):
            self.parts.append(" ")
        elif tag in INLINE or tag in VOID:
            if tag == "hr":
                self.close()
            if self.aside and self.aside[-1][0] == tag:
                name, inner, *rest = self.aside[-1]
                self.aside[-1] = (name, inner + 1, *rest)
            elif attributes and tag not in VOID and evidence(tag, attributes)[0] <= BY_NAME:
                self.aside.append((tag, 0, self.parent, self.parts, self.links))
                self.number += 1
                self.parent, self.parts, self.links = Element(tag, self.parent, self.number, attributes), [], 0
            if tag == "a":
                self.in_link = True
        else:
            self.close()
            self.in_link = False
            held = self.parent.tag
            if held == "p" or held == tag == "li" or held in ("dt", "dd") and tag in ("dt", "dd"):
                self.open[held] -= 1
                self.parent = self.parent.parent
            self.number += 1
            self.open[tag] += 1
            self.parent = Element(tag, self.parent, self.number, attributes)
        return at

    def end(self, tag: str, at: int) -> int:
        if tag == "a":
            self.in_link = False
        if tag in INLINE:
            if self.aside and self.aside[-1][0] == tag:
                name, inner, *rest = self.aside[-1]
                if inner:
                    self.aside[-1] = (name, inner - 1, *rest)
                else:
                    self.leave()
        elif tag not in VOID:
            self.close()
            if self.open[tag] and not (tag == "p" and self.parent.tag != "p"):
                while self.parent.tag != tag:
                    self.open[self.parent.tag] -= 1
                    self.parent = self.parent.parent
                self.open[tag] -= 1
                self.parent = self.parent.parent
        return at

    def skip(self, tag: str, at: int) -> int:
        """Behind the end tag of an element whose text isn't read; without one, the page's end, or for some elements nothing is
        skipped."""
        if self.page[at - 2 : at] == "/>" and tag in OPEN_ENDED:
            return at
        found = None if tag in self.unclosed else re.compile(f"</{tag}(?=[\\s/>])", re.I).search(self.page, at)
        if not found:
            self.unclosed.add(tag)
            return at if tag in OPEN_ENDED else len(self.page)
        end = self.page.find(">", found.start())
        return end + 1 if end >= 0 else len(self.page)


def blocks_of(page: str) -> list[Block]:
    return Reader(page).blocks()


def notice_share(text: str) -> float:
    """The share of a lower-case text's characters that stand in sentences of notices."""
    if not NOTICE.search(text):
        return 0.0
    return sum(m.end() - m.start() for m in SENTENCE.finditer(text) if NOTICE.search(m[0])) / len(text)


def costs(block: Block, has_main: bool) -> float:
    """Log odds that a block is content."""
    held, n = block.parent, len(block.text)
    if held.boiler <= HIDDEN:
        return HIDDEN
    density = block.links / n
    odds = held.prior + held.boiler + min(1.2, math.log1p(n) / 3 - 1.0)
    if held.tag in ("p", "h1", "h2", "h3", "blockquote", "pre"):
        odds += 0.5 if held.main or held.boiler else 2.0
    if held.main:
        return odds + IN_MAIN - density
    if held.boiler > BY_NAME:
        odds += BY_NOTICE * notice_share(block.text.lower())
    return odds + (BESIDE_MAIN if has_main else 0.0) - 4.0 * density - (0.7 if held.tag == "li" else 0.0)


def distance(a: Element, b: Element) -> int:
    """Steps between two elements in the document tree, NEAR at most. Numbers grow along the page, so the later of two is never
    above the other."""
    steps = 0
    while a is not b and steps < NEAR:
        if a.number > b.number:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def label(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels of least total cost: a block labelled against its odds costs their size, an edge whose ends differ its weight.
    Settled blocks give their edges' weight to what they are joined with."""
    odds = list(odds)
    joined: dict[int, dict[int, float]] = defaultdict(dict)
    for (a, b), w in edges.items():
        joined[a][b] = joined[a].get(b, 0.0) + w
        joined[b][a] = joined[b].get(a, 0.0) + w
    fixed = {i: o > 0 for i, o in enumerate(odds) if abs(o) > sum(joined[i].values())}
    rest = [i for i in range(len(odds)) if i not in fixed]
    for i in rest:
        for k in [k for k in joined[i] if k in fixed]:
            odds[i] += joined[i].pop(k) if fixed[k] else -joined[i].pop(k)
    if rest:
        kept = min_cut(rest, odds, joined)
        fixed |= {i: i in kept for i in rest}
    return [fixed[i] for i in range(len(odds))]


def min_cut(nodes: list[int], odds: list[float], joined: dict[int, dict[int, float]]) -> set[int]:
    """The source's side of a minimum cut, by blocking flows over levels of shortest paths. Of minimum cuts the smallest source
    side is taken, so blocks without evidence are left out. Blocks that no edge joins are decided apart."""
    at = {i: k for k, i in enumerate(nodes)}
    n = len(nodes)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i in nodes:
        if odds[i] > 0:
            link(source, at[i], odds[i], 0.0)
        elif odds[i] < 0:
            link(at[i], sink, -odds[i], 0.0)
        for k, w in joined[i].items():
            if i < k:
                link(at[i], at[k], w, w)
    while True:
        level = [-1] * (n + 2)
        level[source], row = 0, [source]
        while row and level[sink] < 0:
            ahead = []
            for a in row:
                for e in out[a]:
                    b = to[e]
                    if level[b] < 0 and room[e] > 1e-12:
                        level[b] = level[a] + 1
                        ahead.append(b)
            row = ahead
        if level[sink] < 0:
            return {i for i in nodes if level[at[i]] >= 0}
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                keep = None
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                    if keep is None and room[e] <= 1e-12:
                        keep = k
                a = to[path[keep] ^ 1]
                del path[keep:]
            while tried[a] < len(out[a]):
                e = out[a][tried[a]]
                if room[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                tried[a] += 1
            else:
                if a == source:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]


def graph(blocks: list[Block]) -> tuple[list[float], dict[tuple[int, int], float]]:
    """The terminals' capacities (log odds) and the smoothness edges of a page."""
    has_main = any(b.parent.main and b.parent.boiler > BY_HALF - 0.1 for b in blocks)
    edges: dict[tuple[int, int], float] = defaultdict(float)
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges[i - 1, i] += ADJACENT * 2 / (2 + distance(blocks[i - 1].parent, b.parent))
        above = b.parent.parent.number if b.parent.parent else -1
        if above in last:
            edges[last[above], i] += SIBLING
        last[above] = i
    return [costs(b, has_main) for b in blocks], edges


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, k in zip(blocks, label(*graph(blocks)), strict=True) if k)


def extract_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """Adds text (empty if there is none) and n_chars (code points), replacing columns so named. Null html is empty; equal rows
    stay separate rows; no page is cut, whatever its length."""
    made = ("text", "n_chars")
    kept = [c for c in pages.columns if c == html_column or c.lower() not in made]
    rows, at = pages.select(*kept), kept.index(html_column)
    others = [c for c in kept if c != html_column]

    def extract(batches):
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*others, *made])

    return in_batches(rows, extract, T.StructType([f for f in rows.schema.fields if f.name != html_column] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("string").alias("html")))
