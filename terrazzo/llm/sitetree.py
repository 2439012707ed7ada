"""Main text of web pages by site style trees.

The pages of a host are merged into trees of element paths, one for those whose markup names
an article and one for the others.  For every node
the tree knows on how many pages it stands (m), how often each presentation
(sequence of child tags) and each content (own text) occurs there, what markup says
of it, and from that:

* presentation importance: the entropy of the presentations, to base m;
* content importance: 1 less the mean entropy of the contents, where a content
  on d pages has entropy log_m d, so boilerplate nears 0 and unique text 1;
* both are 1 where m is 1, and a branch is worth its most important node;
* weight: 0 for what markup says is no text of the page: menus, headers, footers, sidebars,
  notices, adverts, forms, comments, scripts and styles.  Tags and roles say so outright.  A class
  or id says so where the element holds at most half of the text on at least half of the
  pages that it stands on, and never of html and body; so a thread of comments leaves a page that it fills, too;
* a node's own text weighs 0 where it stands beside an article that yields text on at least
  half of its pages; what is below it has weights of its own.

Branches that weigh 0 leave every page of the tree, and what is in them makes nothing above
them important.  So do branches worth less than THRESHOLD: beside articles by the measure above;
inside of them a content counts by its rarest text instead of the mean, so a branch leaves only
if it says nothing that is rare.  All that a page loses, it loses by the trees; without them it would
keep its menus.  An article of which that leaves nothing stays but for what weighs 0, and a page without
one keeps what stands beside.
Pages of a host with the same text by their own markup count as one, so copies are
no boilerplate.

The tree travels as counts: pages are cut into nodes (path, kind, value), which
Spark counts; a path begins with its host, so all trees are one table, and a host's
pages or nodes never meet in one task.  That a node is important reaches all above
it by pointer jumping, in as many rounds as the depth has binary digits.  The branches that
leave are broadcast while they are at most MOST_BROADCAST; beyond that each page's
paths are joined with them.

Defined results: null html gives the empty text; a url without a host belongs to
the host ""; unclosed or stray tags are repaired as browsers do in the common
cases; an unclosed comment, script or style runs to the page's end; white space
is what Unicode says; ``br`` is white space; where as many pages speak for a class or id as against
it, it counts; repeated rows, and rows with a null
page_id, are read one by one; pages of any length and depth are read whole; only page_id,
url and html are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.llm.storage import drop, written
from terrazzo.llm.workers import tidy

THRESHOLD = 0.2
#: Branches that are broadcast, 8 bytes each in up to four lists.
MOST_BROADCAST = 1 << 21

# Elements and class names of the HTML vocabulary.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
NOISE_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg canvas button select textarea title menu dialog object".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr login masthead menu modal "
    "nav navbar navigation newsletter notice notices pager pagination popup promo related replies reply share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article table ul ol dl td th div section body html".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_ARTICLE = re.compile(r"""<(?:article|main)\b|\brole\s*=\s*["']?(?:article|main)\b""", re.I)


@lru_cache(maxsize=4096)
def _marks(tag: str, attributes: str) -> tuple[str, bool, bool, bool, bool, bool]:
    """(path step, noise, named, article, heading, named heading) of a start tag; a heading is noise outside of articles only."""
    names, role, hidden = [], "", False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role":
            role = value
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            hidden = True
        elif key in ("class", "id"):
            names += _NAME.findall(value)
    noise = hidden or tag in NOISE_TAGS or role in NOISE_ROLES
    named, titled = (False, False) if tag in ("html", "body") else (not NOISE_NAMES.isdisjoint(names), "header" in names)
    said = "." + role + "!" * hidden if role or hidden else ""
    return f"{tag}.{'.'.join(sorted(set(names)))}{said}", noise, named, tag in ("article", "main") or role in ("article", "main"), tag == "header", titled


@lru_cache(maxsize=65536)
def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def root_of(host: str, html: str = "") -> int:
    """The path of what stands above all elements of a tree's pages: those of a host whose markup names an article, or none."""
    return _hash(f"host {host} {'with' if _ARTICLE.search(html) else 'without'} articles")


class _Zone:
    """What stands in an element that its name calls noise: ``size`` is its text."""

    __slots__ = ("above", "depth", "path", "size")

    def __init__(self, above: _Zone | None, path: int):
        self.above, self.depth, self.path, self.size = above, above.depth + 1 if above else 0, path, 0


class Branches:
    """Paths of branches that leave: ``low`` beside articles, ``inner`` inside of them, ``cut`` everywhere; of ``mute`` elements only the own text leaves."""

    __slots__ = ("cut", "inner", "low", "mute")

    def __init__(self, low=frozenset(), inner=frozenset(), cut=frozenset(), mute=frozenset()):
        self.low, self.inner, self.cut, self.mute = low, inner, cut, mute


class _Open:
    """An element that is open: ``path`` hashes its way from the root, ``parent`` that of the element above.

    ``noise`` is what tags and roles say of it or of an element above, ``root`` that they say it of this one first; ``low``, ``inner`` and ``cut`` tell branches that leave.
    """

    __slots__ = ("tag", "path", "parent", "noise", "root", "zone", "article", "low", "inner", "cut", "children", "own")

    def __init__(self, tag: str, path: int, parent: int, noise: bool, root: bool, zone: _Zone | None, article: bool, low: bool, inner: bool, cut: bool):
        self.tag, self.path, self.parent, self.noise, self.root, self.zone, self.article, self.low, self.inner, self.cut = tag, path, parent, noise, root, zone, article, low, inner, cut
        self.children: list[str] = []
        self.own: list[str] = []


_NOTHING = Branches()


def walk(html: str, closed=None, gone: Branches = _NOTHING, top: int = 0) -> Iterator[tuple[_Open, str]]:
    """(element, text) in page order, and (element, "") wherever a block begins or ends; ``closed`` sees each finished element."""
    root = _Open("", top, top, False, False, None, False, False, False, False)
    stack = [root]

    def shut(k: int) -> Iterator[tuple[_Open, str]]:
        while len(stack) > k:
            e = stack.pop()
            if closed:
                closed(e)
            if e.tag in BLOCK:
                yield stack[-1], ""

    def opened(tag: str, attributes: str) -> _Open:
        above = stack[-1]
        step, noise, named, article, heading, titled = _marks(tag, attributes)
        if not above.article and not article:
            noise, named = noise or heading, named or titled
        above.children.append(tag)
        path = _hash(f"{above.path}/{step}")
        zone = _Zone(above.zone, path) if named else above.zone
        leaves = above.low or path in gone.low, above.inner or above.article and path in gone.inner, above.cut or path in gone.cut
        return _Open(tag, path, above.path, above.noise or noise, noise and not above.noise, zone, above.article or article, *leaves)

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            yield stack[-1], html[at:]
            break
        if m.start() > at:
            yield stack[-1], html[at : m.start()]
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    yield from shut(k)
                    break
            if tag in BLOCK:
                yield stack[-1], ""
            continue
        if tag in CLOSES_P or tag in SIBLINGS:
            ends = SIBLINGS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    yield from shut(k)
                    break
                if stack[k].tag in SCOPES:
                    break
        if tag in BLOCK:
            yield stack[-1], ""
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            stack[-1].children.append(tag)
            if tag == "br":
                yield stack[-1], " "
            continue
        stack.append(opened(tag, attributes))
        if tag in RAW:
            end = re.compile(rf"</{tag}[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            yield from shut(len(stack) - 1)
    yield from shut(1)


def host_of(url: str | None) -> str:
    m = re.match(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _zones(pieces: list[tuple[_Open, str]]) -> Iterator[tuple[int, bool]]:
    """(path, whether it holds more than half of the page's text) of every element that its name calls noise."""
    zones, total = {}, 0
    for e, text in pieces:
        size, zone = len("".join(text.split())), e.zone
        total += size
        if zone:
            zone.size += size
            while zone and zone not in zones:
                zones[zone] = True
                zone = zone.above
    for zone in sorted(zones, key=lambda z: -z.depth):
        if zone.above:
            zone.above.size += zone.size
        yield zone.path, 2 * zone.size > total


def tree_counts(html: str, top: int = 0) -> Iterator[tuple[int, str, int]]:
    """(path, kind, value) of a page, each once.

    m: present, the value is the parent's path; s: presentation; c: content; w: noise by its tag or role; z: called noise by its
    name, the value is 1 where some such element holds more than half of the page's text; b: has text outside of articles, the value
    is 1 where an article yields text.  What is inside of noise is left out.
    """
    seen, pieces = set(), []

    def closed(e: _Open) -> None:
        path = e.path
        if e.noise:
            if e.root and e.tag not in RAW:  # those have no text anyway
                seen.update(((path, "m", e.parent), (path, "w", 0)))
            return
        seen.add((path, "m", e.parent))
        if e.children:
            seen.add((path, "s", _hash(" ".join(e.children))))
        own = " ".join("".join(e.own).split())
        if own:
            seen.add((path, "c", int.from_bytes(hashlib.blake2b(own.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)))

    for e, text in walk(html, closed, top=top):
        if text and not e.noise:
            e.own.append(text)
            pieces.append((e, text))
    large: dict[int, bool] = {}
    for path, half in _zones(pieces):
        large[path] = large.get(path, False) or half
    said = [(e, e.zone is not None and not large[e.zone.path]) for e, text in pieces if not text.isspace()]
    yields = any(e.article and not small for e, small in said)
    seen.update((e.path, "b", int(yields)) for e, small in said if not e.article and not small)
    yield from seen
    yield from ((path, "z", int(half)) for path, half in large.items())


def own_branches(html: str, top: int = 0) -> Branches:
    """What a page would lose by its own markup, were it the only one of its host."""
    return _own(list(tree_counts(html, top)))


def _own(seen) -> Branches:
    return Branches(cut=frozenset(p for p, kind, value in seen if kind == "w" or kind == "z" and not value), mute=frozenset(p for p, kind, value in seen if kind == "b" and value))


def main_text(html: str, gone: Branches | None = None, top: int = 0) -> str:
    """The blocks that the branches in ``gone`` leave of a page, joined by line breaks.

    An article of which they leave nothing stays but for what is ``cut``, and a page without one keeps what is ``mute``.  Without ``gone``, by the page's own markup.
    """
    gone = own_branches(html, top) if gone is None else gone
    article, shown, whole, beside = [], [], [], []
    parts: tuple[list[str], ...] = ([], [], [], [])

    def flush() -> None:
        for held, out in zip(parts, (article, shown, whole, beside), strict=True):
            if held:
                block = " ".join(entities.unescape("".join(held)).split())
                if block:
                    out.append(block)
                held.clear()

    for e, text in walk(html, gone=gone, top=top):
        if not text:
            flush()
        elif e.cut:
            continue
        elif e.article:
            parts[2].append(text)
            if not e.inner:
                parts[0].append(text)
                parts[1].append(text)
        elif not e.low:
            parts[3].append(text)
            if e.path not in gone.mute:
                parts[1].append(text)
    flush()
    return "\n".join(shown if article else whole or beside)


def importance(pages: DataFrame) -> DataFrame:
    """path, parent, ``cut`` (it weighs 0), ``mute`` (its own text does) and importance of every node of the site style trees: ``importance`` by the mean content, ``inside`` by the rarest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = pa.struct([("path", pa.int64()), ("kind", pa.string()), ("value", pa.int64())])
        for batch in batches:
            rows: dict = {}
            for url, html in zip(batch.column("url"), batch.column("html"), strict=True):
                html = html.as_py() or ""
                host = host_of(url.as_py())
                top = root_of(host, html)
                if seen := sorted(tree_counts(html, top)):
                    key = (host, hashlib.blake2b(main_text(html, _own(seen), top).encode("utf-8", "replace"), digest_size=16).digest())
                    rows[key] = min(seen, rows.get(key, seen))
            if rows:
                host, text = zip(*rows, strict=True)
                nodes = [[{"path": p, "kind": k, "value": v} for p, k, v in seen] for seen in rows.values()]
                yield pa.RecordBatch.from_arrays([pa.array(host), pa.array(text, pa.binary()), pa.array(nodes, pa.list_(node))], names=["host", "text", "nodes"])

    rows = pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(tidy(run), "host string, text binary, nodes array<struct<path:long,kind:string,value:long>>")
    once = rows.groupBy("host", "text").agg(F.min("nodes").alias("nodes"))  # a page and its copies count as one
    values = once.select(F.inline("nodes")).groupBy("path", "kind", "value").agg(F.count("*").alias("n"))
    s, c, m, z, b = (F.col("kind") == k for k in "scmzb")
    votes = lambda kind, yes: F.sum(F.when(kind, F.when(F.col("value") == yes, F.col("n")).otherwise(-F.col("n"))))
    ln = F.log(F.col("n").cast("double"))
    nodes = values.groupBy("path").agg(
        F.max(F.when(m, F.col("n"))).alias("m"),
        F.max(F.when(m, F.col("value"))).alias("parent"),
        F.sum(F.when(s, F.col("n"))).alias("styles"),
        F.sum(F.when(s, F.col("n") * ln)).alias("style_ln"),
        F.avg(F.when(c, ln)).alias("content_ln"),
        F.min(F.when(c, ln)).alias("rarest_ln"),
        F.coalesce(F.max(F.col("kind") == "w"), F.lit(False)).alias("marked"),
        votes(z, 0).alias("against"),
        votes(b, 1).alias("beside"),
    )
    base = F.log(F.col("m").cast("double"))
    style = (F.log(F.col("styles").cast("double")) - F.col("style_ln") / F.col("styles")) / base
    mute = F.coalesce(F.col("beside") >= 0, F.lit(False))
    content = lambda ln: F.when(mute, F.lit(0.0)).otherwise(F.coalesce(F.lit(1.0) - ln / base, F.lit(0.0)))
    worth = lambda ln: F.when(F.col("m") <= 1, F.lit(1.0)).otherwise(F.greatest(F.coalesce(style, F.lit(0.0)), content(ln)))
    cut = F.col("marked") | F.coalesce(F.col("against") >= 0, F.lit(False))
    weighed = lambda ln: F.when(cut, F.lit(0.0)).otherwise(worth(ln))
    return nodes.select("path", "parent", cut.alias("cut"), mute.alias("mute"), weighed(F.col("content_ln")).alias("importance"), weighed(F.col("rarest_ln")).alias("inside"))


def low_branches(nodes: DataFrame, threshold: float) -> DataFrame:
    """The paths of branches that leave, written: ``cut`` where they weigh nothing, ``mute`` where their own text does; else where all their nodes are worth less than ``threshold``, ``low`` beside articles and ``inner`` inside.

    Nothing is told across what weighs nothing.  Round k takes what is known of a node to the node 2^k levels above it; once a round tells nothing new, all that stand above an
    important node are known.
    """
    state = written(nodes.select("path", "parent", "cut", "mute", (F.col("importance") >= threshold).alias("kept"), (F.col("inside") >= threshold).alias("inner_kept")), "site-nodes")
    above = written(state.where("not cut").select("path", F.col("parent").alias("up")), "site-paths")
    while True:
        told = state.where("kept or inner_kept").join(above, "path").groupBy(F.col("up").alias("path")).agg(F.max("kept").alias("k"), F.max("inner_kept").alias("i"))
        both = state.drop("told").join(told, "path", "left")
        new = F.coalesce(F.col("k") & ~F.col("kept") | F.col("i") & ~F.col("inner_kept"), F.lit(False))
        kept, inner = (F.col(c) | F.coalesce(f, F.lit(False)) for c, f in (("kept", "k"), ("inner_kept", "i")))
        grown = written(both.select("path", "cut", "mute", kept.alias("kept"), inner.alias("inner_kept"), new.alias("told")), "site-nodes")
        drop(state)
        state = grown
        if not state.where("told").limit(1).count():
            break
        further = written(above.join(above.select(F.col("path").alias("up"), F.col("up").alias("top")), "up").select("path", F.col("top").alias("up")), "site-paths")
        drop(above)
        above = further
    found = written(state.where("cut or mute or not kept or not inner_kept").select("path", (~F.col("kept")).alias("low"), (~F.col("inner_kept")).alias("inner"), "cut", "mute"), "site-trees")
    drop(state, above)
    return found


class Paths:
    """Sorted paths that answer ``in``, 8 bytes each."""

    def __init__(self, paths: np.ndarray):
        self.paths = np.sort(paths)

    def __contains__(self, path: int) -> bool:
        at = int(np.searchsorted(self.paths, path))
        return at < len(self.paths) and self.paths[at] == path

    def small(self):
        """A set where that is small enough for a worker."""
        return frozenset(self.paths.tolist()) if len(self.paths) <= MOST_BROADCAST >> 4 else self


def paths_of(html: str, top: int) -> list[int]:
    """The paths of a page's elements."""
    seen: set[int] = set()
    for _ in walk(html, lambda e: seen.add(e.path), top=top):
        pass
    return list(seen)


def extract(pages: DataFrame, threshold: float = THRESHOLD, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """page_id, url and text of every page."""
    found = low_branches(importance(pages), threshold)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    if found.count() <= most_broadcast:
        held = found.toArrow()
        column = lambda c: Paths(held.column("path").to_numpy()[held.column(c).to_numpy()])
        trees = rows.sparkSession.sparkContext.broadcast(tuple(map(column, _KINDS)))
        return rows.mapInArrow(tidy(lambda batches: _by_trees(batches, trees)), _RESULT)

    # a page is known by what it says; equal rows have equal texts
    key = F.sha2(F.to_json(F.struct("page_id", "url", "html")), 256)
    keyed = rows.withColumn("key", key)
    at = keyed.select("key", "url", "html").mapInArrow(tidy(_page_paths), "key string, path long")
    mine = at.join(found, "path").groupBy("key").agg(*[F.collect_set(F.when(F.col(c), F.col("path"))).alias(c) for c in _KINDS])
    return keyed.join(mine, "key", "left").drop("key").mapInArrow(tidy(_by_columns), _RESULT)


_KINDS = ("low", "inner", "cut", "mute")
_RESULT = "page_id long, url string, text string"


def _texts(batch: pa.RecordBatch, text_of) -> pa.RecordBatch:
    texts = [text_of(k, (said := html.as_py() or ""), root_of(host_of(url.as_py()), said)) for k, (url, html) in enumerate(zip(batch.column("url"), batch.column("html"), strict=True))]
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _by_trees(batches: Iterator[pa.RecordBatch], trees) -> Iterator[pa.RecordBatch]:
    gone = Branches(*(paths.small() for paths in trees.value))
    for batch in batches:
        yield _texts(batch, lambda _, html, top: main_text(html, gone, top))


def _page_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, url, html in zip(batch.column("key").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), strict=True):
            said = html.as_py() or ""
            paths = paths_of(said, root_of(host_of(url), said))
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(paths), pa.string()), pa.array(paths, pa.int64())], names=["key", "path"])


def _by_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c) for c in _KINDS]
        yield _texts(batch, lambda k, html, top: main_text(html, Branches(*(frozenset(c[k].as_py() or ()) for c in columns)), top))  # noqa: B023
