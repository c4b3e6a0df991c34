"""HTML extraction by consensus host paths.

Every page's containers are scored by the text of their blocks, less what stands in links; part of a
block's weight goes to the containers around it.  The best one is lifted to the smallest container
around it that holds nine tenths of the page's text outside links, and from there to the article
around it, its heading and text beside it.  A container's generalised path is the chain of its tags
and classes with digits left out.  Spark adds up the scores by host and path; a host's pages are
then extracted again from all containers with the path that won, or from their own lifted container
where the winning path doesn't occur.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
left out wherever they stand: by tag or role, and where all classes and ids say nothing but adverts or comments
(``comment-list``).  Other classes are hints, which the share of the page's text outside links decides.  An element
whose classes all say nothing else (``sidebar-left``) stays if it holds three quarters of it, one whose classes name
more than that (``main-content sidebar-right``, ``has-sidebar``) if it holds half.  The latter stays inside an article or
main element in any case (``related-work``), unless it names adverts or comments (``user-comments``).  Character references are decoded, white space inside a block
becomes one space, blocks are trimmed and joined by one line feed in page order.

Null and empty html give an empty text; pages without a host vote for themselves alone under the empty
host; broken markup is read as browsers do in the main points (unclosed tags end with their parent);
markup may be nested and pages may be long without limit, time is linear in them; repeated rows and rows
with a null page_id count each time; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .urls import host_and_path

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(?P<raw>script|style|template|textarea|iframe|title|noembed|xmp)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+(?<!/)>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>"
    r"|</?[a-zA-Z].*\Z",  # a tag that never ends
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[\s ]+")
_DIGITS = re.compile(r"\d+")

# Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article aside body center dd details div fieldset form main section table tbody td".split())
BLOCKS = CONTAINERS | frozenset("address blockquote caption dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 head header hr html li menu nav ol p pre summary tfoot th thead tr ul".split())
#: Elements that are left out with what is in them, and whose inside ends nothing outside.
ISLANDS = frozenset("button math noscript select svg".split())
LEFT_OUT = ISLANDS | frozenset("aside button dialog footer form head header input label menu nav option".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of classes and ids that mark what isn't main text.
MARKS = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "header masthead menu menus modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted "
    "promotion related replies reply respond share sharing sidebar sidebars signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Of these and some services' names, those that mark adverts, reader comments and consent.
STRONG = frozenset("ad ads adv advert advertisement adverts comment comments consent cookie cookies disqus newsletter outbrain recommended reply replies respond sponsor sponsored taboola".split())
MARKS |= STRONG
#: Words of layout classes that may well be around the article.
CONTENT = frozenset("article body content entry layout main page post story text".split())
#: Words that say nothing about an element beside such a mark.
NEUTRAL = frozenset(
    "area article articles bar block body bottom box btn button buttons card cell center col column container content desktop div element fixed float floating footer "
    "form global group holder icon icons inner item items large left link links list main middle mobile module outer page panel post posts primary right row secondary section "
    "site slot small sticky stories story text thread title top unit wrap wrapper zone".split()
)
#: Classes that say that an element is the article.
ARTICLE = frozenset("article body content entry main post story text".split())
_IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = frozenset("ul ol dl table select".split()) | CONTAINERS - {"td", "dd", "tbody"}
_ISLAND_END = re.compile(r"</(button|math|noscript|select|svg)\b", re.I)
_CLASS_WORD = re.compile(r"[A-Za-z]+")
_OUTWARD, _MAIN_TAGS = 0.6, frozenset(("article", "main"))
#: The share of a page's text outside links that the lifted container holds at least.
NEARLY = 0.9
#: The share of a page's text outside links that spares an element whose class hints at what isn't main text: where it names other things too, and where it doesn't.
HALF, MOST = 0.5, 0.75
IN, HINTED, OUT = 0, 1, 2


class Container:
    """An element that may hold the main text: the blocks ``first`` to ``last`` of its page."""

    __slots__ = ("beside", "digest", "first", "headed", "last", "mass", "parent", "raw", "step")

    def __init__(self, step: str, parent: Container | None, first: int) -> None:
        self.step, self.parent, self.first, self.last, self.raw = step, parent, first, None, 0.0
        self.digest = _digest(parent.digest, step) if parent else b""
        self.mass, self.beside, self.headed = 0.0, False, False  # its text outside links, whether some is in no inner container, whether it holds a main heading

    @property
    def tag(self) -> str:
        return self.step.partition(".")[0]

    @property
    def score(self) -> float:
        return self.raw * (1.5 if self.tag in _MAIN_TAGS else 1.0)

    @property
    def path(self) -> str:
        steps, at = [], self
        while at.parent is not None:
            steps.append(at.step)
            at = at.parent
        return "".join(f">{s}" for s in reversed(steps))


def _digest(parent: bytes, step: str) -> bytes:
    return hashlib.md5(parent + step.encode(errors="replace"), usedforsecurity=False).digest()


def path_digest(path: str) -> bytes:
    """The digest of containers with this path."""
    digest = b""
    for step in path.split(">")[1:]:
        digest = _digest(digest, step)
    return digest


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip() else {}


def _marked(tag: str, attrs: dict[str, str]) -> tuple[int, float, bool]:
    """OUT for an element that is left out with all that is in it, HINTED if a class or id names such a one; the share of text that spares it, and whether an article around it does."""
    if tag in LEFT_OUT or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return OUT, 0, False
    if "style" in attrs and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs["style"], re.I):
        return OUT, 0, False
    if tag in ("html", "body", "main", "article"):
        words = attrs.get("class", "").lower().split()
        return (OUT if tag == "article" and ("comment" in words or "reply" in words) else IN), 0, False
    names = [n for k in ("class", "id") if k in attrs for n in attrs[k].split()]
    told = [set(_CLASS_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", n).lower())) for n in names]
    marks = [words for words in told if words & MARKS]
    if not marks:
        return IN, 0, False
    strong = any(words & STRONG for words in marks)
    alone = len(marks) == len(told) and all(words <= MARKS | NEUTRAL for words in marks)
    if alone and strong:
        return OUT, 0, False
    if alone and not any(words & CONTENT for words in marks):
        return HINTED, MOST, False
    return HINTED, HALF, not strong and not alone


class Page:
    """The containers and blocks of a page, in page order."""

    def __init__(self, found: list[Container], blocks: list[tuple[str, float, bool]]) -> None:
        self.found, self.texts = found, [text for text, _, _ in blocks]
        masses = [0.0, *accumulate(mass for _, mass, _ in blocks)]
        heads = [0, *accumulate(int(headed) for _, _, headed in blocks)]
        for c in reversed(found):  # what is inside comes before what is around
            c.last = len(blocks) if c.last is None else c.last
            c.mass, c.headed = masses[c.last] - masses[c.first], heads[c.last] > heads[c.first]
            if c.parent is not None:
                c.parent.raw += _OUTWARD * c.raw

    def inside(self, c: Container) -> list[str]:
        return self.texts[c.first : c.last]


def containers(html: str | None) -> Page:
    """A page's containers with their scores, and its blocks."""
    page, hints, around, shares = _read(html or "", frozenset())
    total = page.found[0].mass + sum(hints.values())
    for k in sorted(around, reverse=True):  # what a hinted element holds, that around it holds too
        if around[k] >= 0:
            hints[around[k]] += hints[k]
    spared = frozenset(k for k, mass in hints.items() if mass > 0 and mass >= shares[k] * total)
    return _read(html or "", spared)[0] if spared else page


def _read(page: str, spared: frozenset[int]) -> tuple[Page, dict[int, float], dict[int, int], dict[int, float]]:
    """The page without hinted elements but those ``spared`` (by number); how much text each one left out holds itself, which one is around it (-1: none), and the share that spares it."""
    root = Container("", None, 0)
    found, blocks = [root], []
    stack: list[tuple[str, Container, int, bool, int]] = [("", root, IN, False, -1)]  # tag, container, whether left out, in a link, number of the hinted element around
    places: dict[str, list[int]] = defaultdict(list)  # where the open elements of a tag are in the stack
    kinds: dict[str, list[int]] = {"block": [0], "container": [0], "list": [0]}
    hints: dict[int, float] = defaultdict(float)
    around: dict[int, int] = {}
    shares: dict[int, float] = {}
    text: list[str] = []
    linked = number = 0

    def flush() -> None:
        nonlocal linked
        if not text:
            return
        block = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
        text.clear()
        own, linked = linked, 0
        _, holder, out, _, hint = stack[-1]
        if not block or out == OUT:
            return
        mass = max(0.0, len(block) - 2.0 * own)
        if out == HINTED:
            hints[hint] += mass
            return
        holder.beside = holder.beside or mass > 0
        holder.raw += mass
        blocks.append((block, mass, bool(places["h1"])))

    def kinds_of(tag: str) -> Iterator[list[int]]:
        for kind, tags in (("block", BLOCKS), ("container", CONTAINERS), ("list", _LISTS)):
            if tag in tags or tag in ISLANDS:
                yield kinds[kind]

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            tag, holder, *_ = stack.pop()
            if holder is not stack[-1][1]:
                holder.last = len(blocks)
            places[tag].pop()
            for at in kinds_of(tag):
                at.pop()

    at = 0
    last_end = {m[1].lower(): m.start() for m in _ISLAND_END.finditer(page)}
    for m in _TOKEN.finditer(page):
        if m.start() > at and stack[-1][2] != OUT:
            piece = page[at : m.start()]
            text.append(piece)
            if stack[-1][3]:
                linked += len(piece)
        at = m.end()
        if m["raw"] or not m["name"]:
            continue
        tag = m["name"].lower()
        shown = stack[-1][2] != OUT
        if m["close"]:
            if shown and (tag in BLOCKS or tag == "br"):
                flush()
            if tag != "br" and places[tag] and (tag in BLOCKS or tag in ISLANDS or places[tag][-1] > kinds["block"][-1]):  # an inline element doesn't end blocks
                pop_to(places[tag][-1])
            continue
        if tag == "br":
            if shown:
                text.append(" ")
            continue
        if tag in BLOCKS and tag != "hr" and (choices := places["select"] or places["option"]):  # nothing but options goes into a select, nothing but text into these
            pop_to(choices[0])
            shown = stack[-1][2] != OUT
        if tag in BLOCKS:
            if shown:
                flush()
            if places["p"] and places["p"][-1] > kinds["container"][-1]:  # an open paragraph ends, with what is open in it
                pop_to(places["p"][-1])
            open_ = [places[t][-1] for t in _IMPLIED.get(tag, ()) if places[t]]
            if open_ and max(open_) > kinds["list"][-1]:
                pop_to(max(open_))
        if tag in VOID or tag in ISLANDS and last_end.get(tag, 0) < at:  # one that never ends must not take the rest of the page with it
            continue
        _, holder, out, in_link, hint = stack[-1]
        attrs = _attributes(m["attrs"])
        number += 1
        if out != OUT:
            own, share, soft = _marked(tag, attrs)
            if own == HINTED and (number in spared or soft and any(places[t] for t in _MAIN_TAGS)):
                own = IN
            if own == HINTED:
                around[number], shares[number], hint = hint, share, number
            out = max(out, own)
        if tag in CONTAINERS and out == IN:
            classes = ".".join(sorted(_DIGITS.sub("#", c).replace(">", "") for c in attrs.get("class", "").split()))
            holder = Container(tag + (f".{classes}" if classes else ""), holder, len(blocks))
            found.append(holder)
        if not m["attrs"].rstrip().endswith("/") or tag in BLOCKS:
            places[tag].append(len(stack))
            for kind in kinds_of(tag):
                kind.append(len(stack))
            stack.append((tag, holder, out, in_link or tag == "a", hint))
    if at < len(page) and stack[-1][2] != OUT:
        text.append(page[at:])
    flush()
    return Page(found, blocks), hints, around, shares


def best(page: Page) -> Container:
    """The container with the highest score; the first of ties."""
    return max(page.found, key=lambda c: c.score)


def lifted(page: Page, top: Container) -> Container:
    """The smallest container around ``top`` (or itself) with nearly all text; around that, what belongs to the same article.

    The second step adds at most a tenth of the page's text: up to the article (or main element) around,
    up to the first container with a main heading, and while text stands beside in a container below the body.
    """
    root, at = page.found[0], top
    while at.mass < NEARLY * root.mass:
        at = at.parent
    around = [at]
    while around[-1].parent is not None:
        around.append(around[-1].parent)
    for kind in ("article", "main"):
        if held := [c for c in around if c.tag == kind]:
            return held[0]
    if root.headed:
        at = next(c for c in around if c.headed)
    while at.parent is not None and at.parent.beside and at.parent.tag not in ("", "body"):
        at = at.parent
    return at


def main_text(page: Page, path: str | None) -> str:
    """The blocks of all containers with the given path, in page order; of the page's own lifted one if there are none."""
    # containers of one path are never inside each other
    digest = None if path is None else path_digest(path)
    blocks = [block for c in page.found if c.digest == digest for block in page.inside(c)]
    return "\n".join(blocks or page.inside(lifted(page, best(page))))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tally: dict[tuple[str, str], float] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # one page at a time becomes a string
            found = containers(page.as_py())
            top = best(found)
            if top.score > 0:
                path = lifted(found, top).path
                tally[host, path] = tally.get((host, path), 0.0) + float(round(top.score))
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in tally], pa.string()), pa.array([p for _, p in tally], pa.string()), pa.array(list(tally.values()), pa.float64())], ["host", "path", "score"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(containers(page.as_py()), path) for page, path in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the winning path of each host; of ties, the greatest path."""
    host, _ = host_and_path(F.col("url").cast("string"))
    votes = pages.select(host.alias("host"), F.col("html").cast("string")).mapInArrow(_votes, "host string, path string, score double")
    sums = votes.filter("host <> ''").groupBy("host", "path").agg(F.sum("score").alias("score"))
    return sums.groupBy("host").agg(F.max(F.struct("score", "path"))["path"].alias("path"))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html)."""
    host, _ = host_and_path(F.col("url").cast("string"))
    # written, so that Spark knows its size: a small table is broadcast and pages aren't shuffled, a large one is joined
    winners = stored(host_paths(pages), "host-paths").withColumnRenamed("host", "_host")
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host.alias("host"))
    rows = rows.join(winners, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "path")
    kind, url = (rows.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return rows.mapInArrow(_extracted, f"page_id {kind}, url {url}, text string, n_chars bigint")


def op2_pages(spark, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
