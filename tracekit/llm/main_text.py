"""HTML main text by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by the element that holds them and by the class names and id of the
nearest element that has any, tags negative by their name; the weights are log odds of lying inside or outside the
main container, counted on labelled pages: those that mark it (``article``, ``main`` or ``role=main``), a bounded sample of
``sample_pages`` drawn by id and content. Names count that ``support`` sampled pages hold. One linear scan finds the
contiguous run with the largest sum, which is then widened to whole blocks and, where most of its words stand in marked
containers, to those, so that a long table or list within an article does not cut it in two.

What lies inside the run and still is no part of an article (adverts, notices, forms, comments and the like) leaves no text:
elements of such kinds, and those whose class or id is, as a whole, one of the fixed ``NAMES`` or a compound of names and parts
of a layout. A name that only contains such a word says nothing, headings and text blocks are no boilerplate by their id;
parts of an article called search, social, legal, widget or share go unless they hold prose (twenty words, few of them links, no
form); and where everything marked as the main container lies inside elements of such names, it counts nevertheless.

Defined cases: null or empty html, or a page without words, gives an empty text; unclosed or misnested tags are
tolerated; a ``br`` ends a block; formulas keep their text without annotations; without labelled pages fixed weights hold; the
result has one row per input row; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Element names and naming habits.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
          "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mstyle", "semantics", "svg", "g", "text", "tspan", "path", "annotation", "annotation-xml", "desc", "metadata", "defs"}
DROPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "object", "audio", "video", "canvas", "annotation", "annotation-xml", "desc", "metadata", "defs"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup login search comment comments respond replies reply disqus share sharing social related recommended widget toolbar pagination pager copyright legal".split()
)
SOFT = set("legal related search reply header footer widget respond menu".split())  # of a paragraph or heading they may be the subject
PARTS = set("box list area section block slot unit wrap wrapper container bar links form widget posts articles icons buttons inner item items site post page entry top bottom left right inline".split())
#: Names that are no subject of an article, and words that only come with them; names that may head a part of an article.
STRONG = set("ad ads adv advert adverts advertisement advertising adsense promo promotion sponsor sponsored cookie cookies consent gdpr newsletter subscribe disqus comment comments".split())
EXTRA = set("x v in article content body text user users reader thread google native mobile desktop responsive dfp gpt cta message form count author meta".split())
OPEN_NAMES = set("search social legal widget share sharing".split())
CONTROLS = {"form", "input", "select", "button", "textarea"}
TEXTS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "hgroup"}  # inside an article their ids say nothing
CONTAINERS = {"article", "main"}
FLOW = {"p", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
CONTEXTS = {"a", "li", "td", "th", "p", "h1", "h2", "h3", "h4", "h5", "h6", "div", "section", "article", "main", "blockquote", "pre", "dd", "dt", "figcaption", "label", "body"}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}


def _boilerplate(name: str, inside: bool = False) -> bool:
    """A whole name, or a compound of nothing but names and parts such as box or list; other words are a subject.
    Inside an article a header is its own."""
    names = NAMES - {"header"} if inside else NAMES
    split = [x.lower() for x in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", name) if x]
    if len(split) == 1 and split[0] not in NAMES:  # commentlist: a name and a part run together
        split = next(([split[0][: -len(p)], p] for p in PARTS if split[0].endswith(p)), split)
    if any(x in STRONG for x in split) and all(x in NAMES or x in PARTS or x in EXTRA for x in split):
        return True
    return any(x in names for x in split) and all(x in NAMES or x in PARTS for x in split)


def _only_open(name: str) -> bool:
    """Of the words that make the name boilerplate none but those that may head a part of an article."""
    split = [x.lower() for x in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", name) if x]
    return any(x in OPEN_NAMES for x in split) and all(x in OPEN_NAMES or x in PARTS for x in split)


def _unwanted(name: str, attributes: dict[str, str], inside: bool) -> str:
    """"hard" for elements that never hold an article, "soft" for those that are called so, "open" for those inside an article whose
    content decides, or nothing."""
    if name in DROPPED or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return "hard"
    if attributes.get("role", "").lower() in ROLES or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return "hard"
    if name in CONTAINERS or name in ("body", "html") or attributes.get("role") == "main":
        return ""
    if name == "header" and not inside:
        return "soft"
    classes = attributes.get("class", "").split()
    if name in TEXTS:  # ids of headings and text blocks are their subject
        return "soft" if any(_boilerplate(x) and x.lower() not in SOFT for x in classes) else ""
    called = [x for x in [*classes, *attributes.get("id", "").split()] if _boilerplate(x, inside)]
    return "" if not called else "open" if inside and all(map(_only_open, called)) else "soft"


class Item(NamedTuple):
    """A tag or a text run of a page, in page order."""

    kind: str  # t(ag), b(lock tag) or w(ords)
    name: str  # of the tag, or of the element that gives words their context
    words: int
    text: str
    dropped: bool
    inside: bool  # in a main container
    called: tuple[str, ...]  # class names and id of the nearest element that has any


class _Open(NamedTuple):
    name: str
    hard: bool
    soft: bool
    inside: bool
    context: str
    called: tuple[str, ...]
    link: bool
    since: tuple[int, int, int, int] | None  # items, words, words of links and controls before an element whose content decides
    closing: bool  # that element itself


def _items(page: str, forgiving: bool) -> tuple[list[Item], list[tuple[int, int]]]:
    """Tags and text runs of a page, and where its outermost main containers begin and end among them.

    Places of open elements are kept by name, so an end tag without a start costs nothing, however many elements are open.
    """
    out, at, raw = [], 0, None
    stack = [_Open("", False, False, False, "body", (), False, None, False)]
    places: dict[str, list[int]] = {}
    blocks: list[int] = []
    seen, containers = [0, 0, 0], []  # words, words of links, controls

    def close(depth: int) -> None:
        """Ends all elements from a depth on."""
        while len(stack) > depth:
            gone = stack.pop()
            places[gone.name].pop()
            if gone.name not in INLINE:
                blocks.pop()
            if gone.closing:
                first, words, linked, controls = gone.since
                words, linked = seen[0] - words, seen[1] - linked
                if words < 20 or linked * 10 >= words * 3 or seen[2] > controls:  # no prose
                    out[first:] = [x._replace(dropped=True) for x in out[first:]]
            if gone.inside and not stack[-1].inside:
                containers[-1] = (containers[-1][0], len(out))

    def text(piece: str) -> None:
        if piece:
            decoded, now = entities.unescape(piece), stack[-1]
            words = len(decoded.split())
            out.append(Item("w", now.context, words, decoded, now.hard or now.soft, now.inside, now.called))
            seen[0] += words
            seen[1] += words * now.link

    while True:
        if raw:  # nothing but its own end tag counts inside
            end = re.compile(rf"</{re.escape(raw)}[^>]*>", re.I).search(page, at)
            at, raw = (end.end() if end else len(page)), None
        m = TOKEN.search(page, at)
        text(page[at : m.start() if m else len(page)])
        if not m:
            close(1)
            return out, containers
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        now = stack[-1]
        kind = "t" if name in INLINE else "b"
        out.append(Item(kind, name, 0, "", now.hard or now.soft or name in RAW, now.inside, now.called))
        if m[1]:
            # an end tag closes what is open inside it, but an inline one does not reach past a block
            if places.get(name) and not (name in INLINE and blocks and blocks[-1] > places[name][-1]):
                close(places[name][-1])
        elif name in RAW:
            raw = name
            seen[2] += name in CONTROLS
        elif name in VOID or m[3].rstrip().endswith("/"):
            seen[2] += name in CONTROLS
        else:
            if name not in INLINE:  # blocks end an open paragraph and what it left open
                above = stack[blocks[-1]].name if blocks else None
                if above == "p" or above == name and name in ("li", "td", "th", "tr", "dd", "dt", "option"):
                    opened = out.pop()  # this element's own tag comes after what it ends
                    close(blocks[-1])
                    out.append(opened)
                    now = stack[-1]
            attributes = _attributes(m[3])
            main = name in CONTAINERS or attributes.get("role") == "main"
            why = _unwanted(name, attributes, now.inside)
            hard, soft = now.hard or why == "hard", (now.soft and not (main and forgiving)) or why == "soft"
            called = tuple(x.lower() for x in [*attributes.get("class", "").split(), *attributes.get("id", "").split()]) or now.called
            out[-1] = Item(kind, name, 0, "", hard or soft, now.inside, called)
            decides = why == "open" and now.since is None
            since = (len(out) - 1, *seen) if decides else now.since
            seen[2] += name in CONTROLS
            if main and not now.inside:
                containers.append((len(out) - 1, len(out)))
            places.setdefault(name, []).append(len(stack))
            if name not in INLINE:
                blocks.append(len(stack))
            stack.append(_Open(name, hard, soft, now.inside or main, name if name in CONTEXTS else now.context, called, now.link or name == "a", since, decides))


def parsed(page: str) -> tuple[list[Item], list[tuple[int, int]]]:
    """The page as tags and text runs, and its main containers. If all words of those lie in elements of unwanted names, such names do not count."""
    found, containers = _items(page, False)
    if any(x.inside and x.words for x in found) and not any(x.inside and x.words and not x.dropped for x in found):
        return _items(page, True)
    return found, containers


def items(page: str) -> list[Item]:
    return parsed(page)[0]


def fit(pages: DataFrame, html_col: str = "html", sample_pages: int = 2000, id_col: str = "page_id", support: int = 5) -> dict[str, float]:
    """Weights of word contexts ("w:p"), tags ("t:li") and names ("n:sidebar") from labelled pages."""
    labelled = pages.select(F.col(html_col).alias("html"), F.xxhash64(F.lit(3), F.col(id_col), F.col(html_col)).alias("draw")).where(F.col("html").rlike(r"(?i)<(article|main)[\s>]|role=.?main"))
    total = labelled.count()
    sample = labelled.where(F.pmod("draw", F.lit(1 << 30)) / float(1 << 30) < F.lit(sample_pages / max(total, 1))).select("html")

    def count(batches):
        for batch in batches:
            sums: dict[tuple[str, bool], list[int]] = {}
            for page in batch.column(0).to_pylist():
                own: dict[tuple[str, bool], int] = {}
                for x in items(page):
                    for token in ([f"w:{x.name}", *(f"n:{c}" for c in set(x.called))] if x.kind == "w" else [f"t:{x.name}"]):
                        own[token, x.inside] = own.get((token, x.inside), 0) + (x.words if x.kind == "w" else 1)
                for key, n in own.items():
                    held = sums.setdefault(key, [0, 0])
                    held[0] += n
                    held[1] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums]), pa.array([i for _, i in sums]), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([d for _, d in sums.values()], pa.int64())], ["token", "inside", "n", "pages"])

    counted = sample.mapInArrow(count, "token string, inside boolean, n long, pages long")
    counted = counted.groupBy("token").agg(F.coalesce(F.sum(F.when(F.col("inside"), F.col("n"))), F.lit(0)).alias("inside"), F.coalesce(F.sum(F.when(~F.col("inside"), F.col("n"))), F.lit(0)).alias("outside"), F.sum("pages").alias("pages"))
    weights = {}
    for r in counted.where(F.col("pages") >= support).collect():  # tokens of a bounded sample
        odds = math.log((r.inside + 1) / (r.outside + 1))
        low, high = {"w": (0.1, 1.0), "n": (-2.0, 0.5), "t": (-3.0, -0.1)}[r.token[0]]
        weights[r.token] = min(max(odds, low), high)
    return weights


def score(x: Item, weights: dict[str, float]) -> float:
    if x.kind != "w":
        return weights.get(f"t:{x.name}", -0.2 if x.kind == "t" or x.name in FLOW else -1.0)
    names = [weights[f"n:{c}"] for c in x.called if f"n:{c}" in weights]
    each = weights.get(f"w:{x.name}", 1.0) + (sum(names) / len(names) if names else 0.0)
    return x.words * min(max(each, -1.0), 1.0)


def best_run(scores: list[float]) -> tuple[float, int, int]:
    """The contiguous run with the largest sum above zero, as (sum, first, end); the empty run if there is none."""
    best, run, start = (0.0, 0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best[0]:
            best = (run, start, i + 1)
    return best


def extract(page: str | None, weights: dict[str, float]) -> str:
    found, containers = parsed(page or "")
    _, low, high = best_run([0.0 if x.dropped else score(x, weights) for x in found])
    if high == 0:
        return ""
    words = [0]
    for x in found:
        words.append(words[-1] + (0 if x.dropped else x.words))
    within = lambda a, b: words[max(b, a)] - words[a]
    held = [(a, b, within(max(a, low), min(b, high))) for a, b in containers]
    if 2 * sum(n for _, _, n in held) > within(low, high):  # the run is an article's: a table or list in it does not cut it in two
        own = [(a, b) for a, b, n in held if n]
        low, high = min(low, *(a for a, _ in own)), max(high, *(b for _, b in own))
    while low > 0 and found[low - 1].kind != "b":
        low -= 1
    while high < len(found) and found[high].kind != "b":
        high += 1
    blocks, now = [], []
    for x in found[low:high]:
        if x.kind == "b":
            blocks.append(now)
            now = []
        elif x.kind == "w" and not x.dropped:
            now.append(x.text)
    joined = (" ".join("".join(b).split()) for b in [*blocks, now])
    return "\n".join(b for b in joined if b)


def main_text(pages: DataFrame, weights: dict[str, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            texts = pa.array([extract(p, weights) for p in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    made = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    made = made.mapInArrow(run, "page_id long, url string, text string")
    return made.withColumn("n_chars", F.length("text").cast("long"))
