"""Main text of web pages by consensus of their host.

Every page's containers are scored; the pages of a host vote with these scores on generalised tag-class
paths; the text is then taken from the containers on the winning path. A page without them falls back
on its own best container. Elements such as nav and footer are never text; telling words in classes and
ids only weigh: a container that bears them, or lies within one that does, scores less, and what bears
them inside of the chosen container is left out.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelog.llm.common import Scratch, map_batches, own_columns, texts_of

#: Winners of more bytes than this are joined by a shuffle instead of a broadcast.
BROADCAST_BYTES = 32 << 20

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*+(?:>|\Z)|<([a-zA-Z][^\s/>]*+)", re.DOTALL)
_UNQUOTED = re.compile(r"""[^>"']*+""")
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content isn't markup; nothing of it is text of the page.
RAW = frozenset("script style textarea title noembed noframes iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends an open element of the second set unless one of the third lies between.
_CLOSES_P = BLOCK - {"html", "body", "head", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
_P_SCOPE = tuple("html body table td th caption button article section div main aside".split())

#: Elements and roles that aren't the article, and those that don't show.
SKIP_TAGS = frozenset("nav footer aside form button select menu object label input".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
UNSEEN_TAGS = frozenset("head noscript template dialog svg canvas audio video math".split())
#: Words of classes or ids that tell of other things than the article, those of readers' comments, and those that tell of it.
SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promotions banner "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toolbar topbar masthead sidebar sidebars aside rail widget widgets "
    "footer foot copyright cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "share sharing social related recommended recommendations trending teaser skip".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus discussion reply replies respond".split())
GOOD_WORDS = frozenset("article articlebody main content contents post entry story body text page blog".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.IGNORECASE)

#: What an element is, as bits.
WEAK, STRONG, BLOCKY, ARTICLE, COMMENTS, GOOD, UNSEEN, TRUSTED, MUTED, HEADER, BEST, WRAPPER = (1 << k for k in range(12))
#: What a container's score is multiplied by if it or one around it bears telling words, good ones as well, or those of comments.
DOUBT, MIXED, COMMENT = 0.25, 0.5, 0.05
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li pre dd dt".split())
_ROWS = frozenset("li td th dt dd".split())


@dataclass
class Page:
    """Elements by number, parents before their children; 0 is the page itself."""

    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    #: a hash of the generalised tag-class path, in time and room linear in the number of elements
    paths: list[int] = field(default_factory=lambda: [0])
    marks: list[int] = field(default_factory=lambda: [0])
    #: (the nearest block element, text, length of the text inside links), in page order
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


@lru_cache(maxsize=1 << 16)
def path_hash(above: int, step: str) -> int:
    return xxhash.xxh64_intdigest(step, above)


def _tag_end(source: str, at: int, failed: set[int]) -> int:
    """Where the > is that ends a tag whose attributes begin at a place, not one in a quoted value; -1 without one.

    failed: the opening quotes of the page that lead to no end; each is followed once, so a page takes linear time."""
    opened = []
    while (at := _UNQUOTED.match(source, at).end()) < len(source) and at not in failed:
        if source[at] == ">":
            return at
        opened.append(at)
        at = source.find(source[at], at + 1) + 1
        if not at:
            break
    failed.update(opened)
    return -1


@lru_cache(maxsize=1 << 14)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE)


def parse(source: str) -> Page:
    """The page's elements and blocks of text, in the way browsers mend broken markup for the common cases.

    Any nesting will do: what is open is looked up by tag, so time and room are linear in the source."""
    page = Page()
    tags, parents, paths, marks = page.tags, page.parents, page.paths, page.marks
    stack = [0]
    where: dict[str, list[int]] = {}  # by tag, the places in the stack of its open elements
    blocky = [0]  # places in the stack of open block elements
    parts: list[str] = []
    linked = 0

    def last(tag: str) -> int:
        found = where.get(tag)
        return found[-1] if found else 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                page.blocks.append((stack[blocky[-1]], text, min(linked, len(text))))
            parts.clear()
            linked = 0

    def pop_to(k: int) -> None:
        while len(stack) > k:
            tag = tags[stack.pop()]
            where[tag].pop()
            if tag in BLOCK:
                blocky.pop()

    def say(text: str) -> None:
        nonlocal linked
        if text and not marks[stack[-1]] & (UNSEEN | MUTED):
            parts.append(text)
            if where.get("a"):
                linked += len(text)

    at, failed = 0, set()
    for m in iter(lambda: _TOKEN.search(source, at), None):
        say(source[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in BLOCK or tag == "br":
                say(" ") if tag == "br" else flush()
            k = last(tag)
            if k and (tag in BLOCK or tag == "a" or blocky[-1] < k):
                pop_to(k)
            continue
        if not m[2]:
            continue
        end = _tag_end(source, at, failed)
        if end < 0 and (end := source.find(">", at)) < 0:
            end = len(source)
        tag, given = m[2].lower(), source[at:end]
        at = min(end + 1, len(source))
        if tag in VOID:
            if tag in BLOCK:
                flush()
            elif tag == "br":
                say(" ")
            continue
        if tag in BLOCK:
            flush()
        if tag in _CLOSES_P and (k := last("p")) and k > max(map(last, _P_SCOPE)):
            pop_to(k)
        if tag in _SIBLINGS:
            ends, scope = _SIBLINGS[tag]
            if (k := max(map(last, ends))) and k > max(map(last, scope), default=0):
                pop_to(k)
        if tag in RAW:
            end = _raw_end(tag).search(source, at)
            at = end.end() if end else len(source)
            continue
        above = stack[-1]
        step, own = _describe(tag, given)
        inherited = marks[above] & (UNSEEN | TRUSTED)
        if own & HEADER and not inherited & TRUSTED:
            own |= STRONG if tag == "header" else WEAK
        if not own & BLOCKY and (own & (WEAK | STRONG) or marks[above] & MUTED):
            own |= MUTED  # text in it isn't said; blocks within are judged by themselves
        if own & (ARTICLE | GOOD) and tag not in ("html", "body"):
            inherited |= TRUSTED
        tags.append(tag)
        parents.append(above)
        paths.append(path_hash(paths[above], step) if own & BLOCKY else paths[above])
        marks.append(own | inherited)
        if not given.rstrip().endswith("/") or tag not in ("svg", "path", "g", "use"):
            where.setdefault(tag, []).append(len(stack))
            if own & BLOCKY:
                blocky.append(len(stack))
            stack.append(len(tags) - 1)
    say(source[at:])
    flush()
    return page


def _describe(tag: str, given: str) -> tuple[str, int]:
    return _described(tag, given) if len(given) < 200 else _described.__wrapped__(tag, given)


@lru_cache(maxsize=1 << 14)
def _described(tag: str, given: str) -> tuple[str, int]:
    """(the tag with its classes, numbers in them generalised; what it is, as far as it tells itself)."""
    attributes = {}
    if given.strip():
        for a in _ATTRIBUTE.finditer(given):
            attributes.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
    classes = entities.unescape(attributes.get("class", ""))
    words = frozenset(w.lower() for w in _WORDS.findall(f"{classes} {attributes.get('id', '')}"))
    role = attributes.get("role", "").strip().lower()
    own = BLOCKY if tag in BLOCK else 0
    if tag in UNSEEN_TAGS or "hidden" in attributes or attributes.get("aria-hidden") == "true" or _NO_DISPLAY.search(attributes.get("style", "")):
        own |= UNSEEN
    if tag in SKIP_TAGS or role in SKIP_ROLES:
        own |= STRONG
        if tag in ("form", "object") or role == "form" and tag not in SKIP_TAGS:
            own |= WRAPPER  # some sites put the whole page into one
    if tag in ("main", "article") or role in ("main", "article"):
        own |= ARTICLE
    if tag not in ("html", "body"):
        if words & GOOD_WORDS:
            own |= GOOD
        if words & COMMENT_WORDS:
            own |= COMMENTS | WEAK
        if words & SKIP_WORDS and not (own & ARTICLE and own & GOOD):
            own |= WEAK
        if "articlebody" in words:
            own |= BEST
        if tag == "header" or "header" in words:
            own |= HEADER
    return ".".join([tag, *sorted({re.sub(r"[0-9]+", "#", c) for c in classes.split()})]), own


def judge(page: Page) -> tuple[list[bool], list[bool], list[float]]:
    """By element: whether nothing in it is text, whether it is left out of a container around it, and what the
    container's score is multiplied by.

    Words of an element around an outermost article (or main) tell of the layout, so it isn't marked by them, nor
    is a form. Articles that are comments themselves or lie in a nav, footer or aside don't count; nor do those
    among comments if there are others."""
    n, parents, marks = len(page.tags), page.parents, page.marks
    within, among, barred = [False] * n, [False] * n, [False] * n
    outermost: list[int] = []
    for i in range(1, n):
        up = parents[i]
        among[i] = among[up] or bool(marks[i] & COMMENTS)
        within[i] = within[up] or bool(marks[i] & ARTICLE)
        barred[i] = barred[up] or bool(marks[i] & UNSEEN) or marks[i] & (STRONG | WRAPPER) == STRONG
        if marks[i] & ARTICLE and not within[up] and not barred[i] and not marks[i] & COMMENTS:
            outermost.append(i)
    saved = [False] * n
    for i in [i for i in outermost if not among[i]] or outermost:
        i = parents[i]
        while i > 0 and not saved[i]:
            saved[i] = True
            i = parents[i]
    out, apart, factor = [False] * n, [False] * n, [1.0] * n
    for i in range(1, n):
        up, own = parents[i], marks[i]
        out[i] = out[up] or bool(own & UNSEEN) or bool(own & STRONG) and not (own & WRAPPER and saved[i])
        apart[i] = bool(own & WEAK) and not saved[i]
        factor[i] = min(factor[up], 1.0 if not apart[i] else COMMENT if own & COMMENTS else MIXED if own & GOOD else DOUBT)
    return out, apart, factor


def container_scores(page: Page, judged: tuple[list[bool], list[bool], list[float]] | None = None) -> dict[int, float]:
    """A score for each container of text: what a block weighs goes to its container in full and, fading, to
    those above; links and telling words count against it, and article elements or good words for it."""
    out, apart, factor = judged or judge(page)
    tags, parents, marks = page.tags, page.parents, page.marks
    n = len(tags)
    gained, sizes, linked = [0.0] * n, [0] * n, [0] * n
    for node, text, in_links in page.blocks:
        if out[node]:
            continue
        at = parents[node] if tags[node] in _LEAVES and not apart[node] else node
        gained[at] += (len(text) - in_links) * (0.3 if tags[node] in _ROWS else 1.0)
        sizes[at] += len(text)
        linked[at] += in_links
    scores = {}
    for i in range(n - 1, -1, -1):
        if not sizes[i] or out[i]:
            continue
        own = marks[i]
        if (not i or own & BLOCKY or apart[i]) and tags[i] != "html":
            favour = 2.0 if own & (ARTICLE | BEST) else 1.4 if own & GOOD else 1.0
            scores[i] = gained[i] * favour * factor[i] * (1 - linked[i] / sizes[i])
        if i and not apart[i]:
            up = parents[i]
            gained[up] += gained[i] * (0.75 if own & BLOCKY else 1.0)
            sizes[up] += sizes[i]
            linked[up] += linked[i]
    return scores


def page_votes(page: Page, scores: dict[int, float]) -> list[tuple[int, float]]:
    """Per generalised path of the page, its containers' score as a share of the page's best path's."""
    best: dict[int, float] = {}
    for at in sorted(scores):
        if page.marks[at] & BLOCKY:
            best[page.paths[at]] = best.get(page.paths[at], 0.0) + scores[at]
    top = max(best.values(), default=0.0)
    return [(path, score / top) for path, score in sorted(best.items()) if top > 0]


@dataclass
class Outline:
    """What the choice of a container needs of a page: its blocks, and the elements around them."""

    texts: list[str]
    nodes: list[int]  # of the texts
    parents: list[int]
    paths: list[int]  # 0 where the element can't be chosen
    apart: list[bool]  # left out of a container around it
    best: int  # the page's own best container; -1 without any


def outline(page: Page) -> tuple[Outline, list[tuple[int, float]]]:
    """The page's outline and its votes."""
    judged = judge(page)
    scores = container_scores(page, judged)
    out, apart, _ = judged
    blocks = [(node, text) for node, text, _ in page.blocks if not out[node]]
    number: dict[int, int] = {}
    for node, _ in blocks:
        way = []
        while node >= 0 and node not in number:
            way.append(node)
            number[node] = -1
            node = page.parents[node]
    for k, node in enumerate(sorted(number)):
        number[node] = k
    kept = sorted(number)
    best = max(scores, key=lambda k: (scores[k], -k)) if scores else -1
    chosen = [page.paths[i] if page.marks[i] & BLOCKY else 0 for i in kept]
    made = Outline([t for _, t in blocks], [number[i] for i, _ in blocks], [number[page.parents[i]] if i else -1 for i in kept], chosen, [apart[i] for i in kept], number.get(best, -1))
    return made, page_votes(page, scores)


def extract(o: Outline, path: int | None) -> str:
    """The text of the containers on the path; of the page's own best container if it has none, or they are empty."""
    found = _text_under(o, [p == path and p != 0 for p in o.paths]) if path is not None else ""
    if not found and o.best >= 0:
        found = _text_under(o, [k == o.best for k in range(len(o.paths))])
    return found


def _text_under(o: Outline, chosen: list[bool]) -> str:
    if not any(chosen):
        return ""
    inside = []
    for k, up in enumerate(o.parents):
        inside.append(chosen[k] or up >= 0 and inside[up] and not o.apart[k])
    return "\n".join(text for text, node in zip(o.texts, o.nodes, strict=True) if inside[node])


def host_of(url: str = "url"):
    """Lower-cased host without port, user and a leading www. or m.; empty if there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.regexp_replace(host, r"^(www|m)\.", "")


_OUTLINES = "page_id long, url string, host string, texts array<string>, nodes array<int>, parents array<int>, paths array<long>, apart array<boolean>, best int, votes array<struct<path: long, share: long>>"


def outlines(pages: DataFrame) -> DataFrame:
    """Every page's outline and votes; a page is parsed once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made, votes = [], []
        for source in texts_of(batch, "html"):
            o, given = outline(parse(source))
            made.append(o)
            votes.append([{"path": _signed(path), "share": round(share * 1_000_000)} for path, share in given])
        columns = [
            pa.array([o.texts for o in made], pa.list_(pa.string())),
            pa.array([o.nodes for o in made], pa.list_(pa.int32())),
            pa.array([o.parents for o in made], pa.list_(pa.int32())),
            pa.array([[_signed(p) for p in o.paths] for o in made], pa.list_(pa.int64())),
            pa.array([o.apart for o in made], pa.list_(pa.bool_())),
            pa.array([o.best for o in made], pa.int32()),
            pa.array(votes, pa.list_(pa.struct([("path", pa.int64()), ("share", pa.int64())]))),
        ]
        given = [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), batch.column("host")]
        return pa.RecordBatch.from_arrays(given + columns, names=["page_id", "url", "host", "texts", "nodes", "parents", "paths", "apart", "best", "votes"])

    given = own_columns(pages, "page_id", "url", "html").withColumn("host", host_of())
    return map_batches(given.select("page_id", "url", "host", "html"), run, _OUTLINES)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def vote_paths(made: DataFrame) -> DataFrame:
    """(host, path) of outlines: for each host the path with the highest sum of its pages' shares; ties go to the
    smallest hash. Sums of shares combine before the shuffle, so a host with a third of all pages sends no
    more rows than any other."""
    votes = made.where("host <> ''").select("host", F.explode("votes").alias("v")).select("host", "v.path", "v.share")
    sums = votes.groupBy("host", "path").agg(F.sum("share").alias("share"))
    return sums.groupBy("host").agg(F.min_by("path", F.struct(-F.col("share"), F.col("path"))).alias("path"))


def extract_pages(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of pages(page_id, url, html).

    A null or empty html gives an empty text; a page without a host (null or odd url) goes by its own
    best container; equal rows give equal rows; further columns are ignored. Pages of any length and depth
    are read whole, in time linear in their length. Of containers with equal scores the first counts. Outlines
    (the blocks of text and the elements around them) are written to the shared folder, so no page is
    parsed twice; so are the winning paths, which are broadcast only if their bytes are few, else joined by
    host, where adaptive execution splits a host with many pages.
    """
    scratch = Scratch(pages.sparkSession, "hosts")
    made = scratch.save(outlines(pages), "outlines")
    winners = scratch.save(vote_paths(made), "winners")
    size = winners.agg(F.sum(F.length("host") + 64)).first()[0] or 0
    joined = made.drop("votes").join((F.broadcast(winners) if size <= broadcast_bytes else winners).withColumnRenamed("path", "winner"), "host", "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(c).to_pylist() for c in ("texts", "nodes", "parents", "paths", "apart", "best", "winner")]
        texts = [extract(Outline(*row[:6]), row[6]) for row in zip(*columns, strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )

    return map_batches(joined, run, "page_id long, url string, text string, n_chars long")
