"""Main text of web pages by nearest-URL page differencing.

Pages of a host with the same lines count as one. They are ordered by URL path, and each is paired with the nearest
page that isn't a copy of it. The two pages' text lines are aligned by their longest common subsequence, and lines
that they share (menus, notices, footers of the site's template) are deleted. Elements that the markup itself names as
no content (navigation, scripts, adverts, comments ...) go first, whether their lines are shared or not.

Where a page marks its article, the article bounds the text. Pages at near URLs may carry one passage twice, so a
shared line of an article only goes where the whole host says so: it must stand at one place (the same elements around
it, as many lines from the article's start or end) and be shared there by half of the host's distinct pages with their
partners. Then it goes from all pages that have it there; headings never go. Where no article is marked, lines that
stand on half of the host's distinct pages go too, also from pages that have none but copies around them.

Only hashed lines move for the pairing: rows are range-partitioned by (host, path), so that a host with a third of
all pages spreads over tasks, and a few rows at each border are handed to the neighbouring partition.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, slices, stash, table

#: Pages on each side in path order among which a partner is looked for.
NEIGHBOURS = 8
#: A page that shares at least so many of its lines is a copy and no partner. Where no article is marked, lines of the
#: host's template don't count for that.
COPY_SHARE = 0.8
#: A line is the host's template if it stands on this share of the host's distinct pages and on so many of them (two
#: pages may share a sentence), if the host has so many pages.
TEMPLATE_SHARE = 0.5
TEMPLATE_LEAST = 3
TEMPLATE_PAGES = 4
#: Rows of a range partition.
PARTITION_ROWS = 20_000
#: Pages whose line masks are broadcast at most.
BROADCAST_PAGES = 50_000

_RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|object|xmp|noembed|noframes"
#: What a tag holds: quoted values, which may have ">" in them; a quote that isn't closed before a space or the tag's end is a plain character.
_VALUES = r"(?:=\s*\"[^\"]*\"(?=[\s/>]|\Z)|=\s*'[^']*'(?=[\s/>]|\Z)|[^>])*"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + _RAW + r")\b" + _VALUES + r"(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>" + _VALUES + r")(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture "
    "button select input audio video canvas map".split()
)
_MAIN = frozenset(("article", "main"))
_DROPPED = frozenset("nav footer aside button select dialog menu head input fieldset audio video canvas map".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open one of the same name before them.
_SIBLINGS = frozenset("p li dt dd tr td th option".split())
#: Names of classes, and of identifiers of plain boxes, that say no content.
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sidebar side-bar nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr popup modal comment comments "
    "commentlist reply replies discussion thread disqus respond related recommended teaser teasers newsletter subscribe footer site-header masthead topbar pagination skip-link promo notice share "
    "sharing social".split()
)
#: Names that say so outside an article; inside one most of the element's words must be links as well.
_UNSURE = frozenset("menu banner overlay toolbar pager widget".split())
#: What such names are joined with by hyphens without changing what they say ("comment-list"; not "comment-policy").
_HELPERS = frozenset(
    "box list container wrapper wrap area section block bar left right top bottom site page post entry item items inner outer link links form title unit slot row col column panel group holder "
    "placeholder primary secondary posts articles stories news videos products buttons icons feed count thread user reader".split()
)
#: Elements whose identifier may name them so; headings and sections have identifiers made from their text.
_BOXES = frozenset("div ul ol table form span".split())
#: Classes of articles that aren't the page's.
_OTHER_ARTICLES = frozenset("comment reply teaser related recommended sponsored advert ad promo".split())
#: Articles hold the page's text if they have this share of what the markup doesn't drop; fewer are teasers.
_ARTICLE_TEXT = 0.25
#: A form that holds an article or this share of the page's words is a plain box; any other box must hold all articles and this share.
_MOST_TEXT = 0.5
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|[\"']?([^\s>]+))", re.I)
_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert"))
_JOINTS = re.compile(r"[-_]+|\d+")
_SPACES = re.compile(r"\s+")


class Line(NamedTuple):
    text: str
    main: bool
    heading: bool
    around: str  # names of the elements around it, those in the article's if it is in one


class Content(NamedTuple):
    """Lines that may be a page's text, and whether the page marks its article."""

    lines: list[Line]
    marked: bool

    @property
    def texts(self) -> list[str]:
        return [x.text for x in self.lines]


def named(word: str) -> str | None:
    """``noise`` or ``unsure`` if a whole name says no content."""
    if word in _NOISE:
        return "noise"
    if word in _UNSURE:
        return "unsure"
    parts = [x for x in _JOINTS.split(word) if x]
    if all(x in _NOISE or x in _UNSURE or x in _HELPERS for x in parts):
        if any(x in _NOISE for x in parts):
            return "noise"
        if any(x in _UNSURE for x in parts):
            return "unsure"
    return None


def _verdict(name: str, attributes: str, in_main: bool) -> str | None:
    """``drop``; ``unless most``, ``unless all`` or ``if links`` where what the element holds decides; None for content."""
    if name in _DROPPED or (name == "header" and not in_main):
        return "drop"
    if name in ("main", "body", "html"):
        return None
    said = None
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "article":
            if kind != "id" and _OTHER_ARTICLES.intersection(value.split()):
                return "drop"
        elif kind == "role":
            said = "noise" if value.strip() in _ROLES else said
        elif kind == "class" or name in _BOXES:
            for word in value.split():
                one = named(word)
                said = one if one and said != "noise" else said
    if said == "unsure" and in_main:
        return "if links"
    if said:
        return "unless all"
    return "unless most" if name == "form" else None


class _Sizes:
    """Words, words in links and marks of articles before each token."""

    def __init__(self, tokens: list[re.Match]) -> None:
        self.words, self.linked, self.mains, self.ends = [0], [0], [0], {}
        open_: dict[str, list[int]] = {}
        links = 0
        for at, m in enumerate(tokens):
            n, main = len(m["text"].split()) if m["text"] is not None else 0, 0
            if m["name"]:
                name = m["name"].lower()
                if not m["close"]:
                    open_.setdefault(name, []).append(at)
                    links += name == "a"
                    main = name in _MAIN and _verdict(name, m["attributes"], False) is None
                elif open_.get(name):
                    self.ends[open_[name].pop()] = at
                    links -= name == "a"
            self.words.append(self.words[-1] + n)
            self.linked.append(self.linked[-1] + n * (links > 0))
            self.mains.append(self.mains[-1] + main)

    def drops(self, at: int, verdict: str | None) -> bool:
        """Whether the element that token ``at`` opens goes. One that isn't closed has no known size."""
        if verdict in (None, "drop") or at not in self.ends:
            return verdict not in (None, "if links")
        end = self.ends[at]
        words, linked = self.words[end] - self.words[at], self.linked[end] - self.linked[at]
        if verdict == "if links":
            return 2 * linked >= words
        held, most = self.mains[end] - self.mains[at], words >= _MOST_TEXT * max(1, self.words[-1])
        if verdict == "unless all":
            return held < self.mains[-1] or not most
        return not held and not most


def lines_of(page: str) -> list[Line]:
    """Text lines of a page's content elements, one for each block.

    An element that is dropped takes everything to its end along, articles too; one that is never closed ends where
    an article begins.
    """
    out: list[Line] = []
    parts: list[str] = []
    main: list[str] = []
    skipped: list[str] = []
    ends = True  # whether what is skipped is closed
    around: list[str] = []

    def flush() -> None:
        if parts:
            text = _SPACES.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                inside = around[len(around) - 1 - around[::-1].index(main[0]) :] if main and main[0] in around else around
                out.append(Line(text, bool(main), not _HEADINGS.isdisjoint(inside), "/".join(inside)))
            parts.clear()

    tokens = list(_TOKEN.finditer(page))
    sizes = _Sizes(tokens)
    for at, m in enumerate(tokens):
        if (text := m["text"]) is not None:
            if not skipped:
                parts.append(text)
            continue
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["close"]:
            if skipped:
                if name in skipped:
                    skipped.pop()
                    if not skipped and name not in _INLINE:
                        flush()
                    continue
                if name not in main or ends:
                    continue
                skipped.clear()
            if name in main or name not in _INLINE:
                flush()
            if name in main:
                while main.pop() != name:
                    pass
            if name in around:
                del around[len(around) - 1 - around[::-1].index(name) :]
            continue
        if skipped:
            if name in _MAIN and not ends:
                flush()
                skipped.clear()
            else:
                if name == skipped[-1] and name not in _VOID:
                    skipped.append(name)
                continue
        if name == "br":
            parts.append(" ")
            continue
        drop = sizes.drops(at, _verdict(name, m["attributes"], bool(main)))
        empty = name in _VOID or m["attributes"].endswith("/")
        if name not in _INLINE:
            flush()
        if drop:
            if not empty:
                skipped.append(name)
                ends = at in sizes.ends
            continue
        if name not in _INLINE and not empty:
            if name in _SIBLINGS and around and around[-1] == name:
                around.pop()
            around.append(name)
        if name in _MAIN:
            main.append(name)
    flush()
    return out


def parsed(page: str) -> Content:
    lines = lines_of(page)
    held = sum(len(x.text) for x in lines if x.main)
    marked = held > 0 and held >= _ARTICLE_TEXT * sum(len(x.text) for x in lines)
    return Content([x for x in lines if x.main or not marked], marked)


def content(page: str) -> tuple[list[str], bool]:
    """The lines that may be main text, and whether the page marks its article."""
    found = parsed(page)
    return found.texts, found.marked


def common_lines(a: list, b: list) -> list[bool]:
    """Which entries of ``a`` lie on a longest common subsequence with ``b`` (bit-parallel; later pairs first on ties)."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    flags = [True] * low + [False] * (len(a) - low - high) + [True] * high
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    if not x or not y:
        return flags
    full = (1 << len(y)) - 1
    places: dict = {}
    for j, v in enumerate(y):
        places[v] = places.get(v, 0) | 1 << j
    rows, now = [full], full
    for v in x:
        hit = now & places.get(v, 0)
        now = ((now + hit) | (now - hit)) & full
        rows.append(now)
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()  # noqa: E731  of the common part of x[:i] and y[:j]
    i, j = len(x), len(y)
    while i and j and (n := length(i, j)):
        if length(i - 1, j) == n:
            i -= 1
        elif length(i, j - 1) == n:
            j -= 1
        else:
            i, j = i - 1, j - 1
            flags[low + i] = True
    return flags


def _uid(*parts: str | None) -> int:
    h = xxhash.xxh3_64()
    for p in parts:
        h.update(b"\0" if p is None else b"\1" + p.encode())
        h.update(b"\2")
    return h.intdigest() - (1 << 63)


def _hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode()) - (1 << 63)


_URL = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)", re.I)


def host_and_path(url: str | None) -> tuple[str, str]:
    m = _URL.match(url or "")
    return (m[1].lower().removeprefix("www."), m[2].rstrip("/") or "/") if m else ("", url or "")


def _identity(url: str | None, found: Content) -> tuple[int, bytes, bytes]:
    """What pages of a host with the same lines share, the hashed lines, and two hashed places of each line of an article (0 for a heading)."""
    host = host_and_path(url)[0]
    hashes = np.array([_hash(x.text) for x in found.lines], np.int64).tobytes()
    if not found.marked:
        return _uid(host, "", hashes.hex()), hashes, b""
    places = np.zeros((len(found.lines), 2), np.int64)
    for k, x in enumerate(found.lines):
        if not x.heading:
            places[k] = [_uid(host, x.around, edge, str(n), x.text) for edge, n in (("start", k), ("end", len(found.lines) - k))]
    return _uid(host, "marked", hashes.hex(), places.tobytes().hex()), hashes, places.tobytes()


def _lines(pages: DataFrame) -> DataFrame:
    """uid, host, path, hashed lines and places (null if no article is marked) of every distinct page that has lines."""

    def run(batches):
        for batch in slices(batches):
            rows = []
            for url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = parsed(page or "")
                if found.lines:
                    uid, hashes, places = _identity(url, found)
                    rows.append((uid, *host_and_path(url), hashes, places if found.marked else None))
            if rows:
                types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["uid", "host", "path", "hashes", "places"])

    lines = pages.mapInArrow(run, "uid long, host string, path string, hashes binary, places binary")
    return lines.groupBy("uid").agg(F.first("host").alias("host"), F.min("path").alias("path"), F.first("hashes").alias("hashes"), F.first("places").alias("places"))


def _frequent(lines: DataFrame) -> DataFrame:
    """host, pages (its distinct ones) and template: the lines, and places of lines, that TEMPLATE_SHARE of them have (null: none).

    Hosts with fewer than TEMPLATE_PAGES pages are left out.
    A host with an average of n lines a page has at most 3 n / TEMPLATE_SHARE of them, however many pages.
    """

    def run(batches):
        for batch in batches:
            hosts, hashes = [], []
            for k, (x, places) in enumerate(zip(batch["hashes"].to_pylist(), batch["places"].to_pylist(), strict=True)):
                own = np.unique(np.frombuffer(x if places is None else places, np.int64))
                own = own[own != 0].tolist()
                hosts += [k] * (len(own) + 1)
                hashes += [*own, None]
            yield pa.RecordBatch.from_arrays([batch["host"].take(pa.array(hosts, pa.int64())), pa.array(hashes, pa.int64())], ["host", "line"])

    counts = lines.select("host", "hashes", "places").mapInArrow(run, "host string, line long").groupBy("host", "line").count()
    counts = stash(counts.where(f"count >= {TEMPLATE_LEAST}"))
    pages = counts.where("line is null").select("host", F.col("count").alias("pages")).where(f"pages >= {TEMPLATE_PAGES}")
    usual = counts.where("line is not null").join(pages, "host").where(F.col("count") >= TEMPLATE_SHARE * F.col("pages"))
    return stash(pages.join(usual.groupBy("host").agg(F.collect_list("line").alias("template")), "host", "left"))


def _usual(lines: DataFrame) -> DataFrame:
    """``lines`` with pages and usual: of each line, whether the host's template has it (of an article's: which of its places)."""

    def run(batches):
        for batch in batches:
            template, of, usual = np.zeros(0, np.int64), None, []
            for host, hashes, places, held in zip(*(batch[c].to_pylist() for c in ("host", "hashes", "places", "template")), strict=True):
                if held is not None and host != of:
                    of, template = host, np.array(held, np.int64)
                own = np.frombuffer(hashes if places is None else places, np.int64)
                usual.append((np.isin(own, template) & (own != 0) if held is not None else np.zeros(len(own), bool)).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("uid", "host", "path", "hashes", "places", "pages")), pa.array(usual, pa.binary())], ["uid", "host", "path", "hashes", "places", "pages", "usual"])

    joined = join_skewed(lines, _frequent(lines), "host", "pages", "left")
    return joined.select("uid", "host", "path", "hashes", "places", "pages", "template").mapInArrow(run, "uid long, host string, path string, hashes binary, places binary, pages long, usual binary")


def _with_borders(batches):
    """Rows with their partition; the first and last NEIGHBOURS rows also go to the partitions before and after."""
    part, seen, tail, schema = TaskContext.get().partitionId(), 0, None, None

    def tagged(rows: pa.RecordBatch, where: int, context: bool):
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array([where] * n, pa.int32()), pa.array([context] * n)], [*rows.schema.names, "part", "context"])

    for batch in batches:
        if not batch.num_rows:
            continue
        yield tagged(batch, part, False)
        if seen < NEIGHBOURS:
            yield tagged(batch.slice(0, NEIGHBOURS - seen), part - 1, True)
        seen += batch.num_rows
        both = pa.Table.from_batches([batch] if tail is None else [tail, batch])
        tail = both.slice(max(0, both.num_rows - NEIGHBOURS)).combine_chunks().to_batches()[0]
    if tail is not None:
        yield tagged(tail, part + 1, True)


_FOUND = "uid long, gone array<int>, line int, place long, pages long, shared boolean"


def _shared(rows: pa.Table) -> pa.Table:
    """gone: the lines that go from a page without a mark. Of the lines of an article that stand at a usual place: line, place, pages of the host, and whether the partner shares it."""
    rows = rows.sort_by([("host", "ascending"), ("path", "ascending"), ("uid", "ascending")])
    uid, host, path, places, pages = (rows[c].to_pylist() for c in ("uid", "host", "path", "places", "pages"))
    hashes = [np.frombuffer(x, np.int64).tolist() for x in rows["hashes"].to_pylist()]
    usuals = [np.frombuffer(x, bool) for x in rows["usual"].to_pylist()]
    out = []

    def closeness(i: int, j: int) -> tuple[int, int]:
        a, b, n = path[i], path[j], 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return -n, abs(i - j)

    def with_partner(i: int, usual: list[bool]) -> list[bool]:
        """Which lines the partner shares; ``usual`` ones don't make a copy."""
        near = [j for j in range(max(0, i - NEIGHBOURS), min(len(uid), i + NEIGHBOURS + 1)) if j != i and host[j] == host[i]]
        for j in sorted(near, key=lambda j: (*closeness(i, j), j)):
            flags = common_lines(hashes[i], hashes[j])
            if sum(f and not u for f, u in zip(flags, usual, strict=True)) < COPY_SHARE * (len(usual) - sum(usual)) or all(usual):
                return flags
        return [False] * len(usual)

    for i, context in enumerate(rows["context"].to_pylist()):
        if context:
            continue
        if places[i] is None:
            usual = usuals[i].tolist()
            gone = [k for k, (u, f) in enumerate(zip(usual, with_partner(i, usual), strict=True)) if u or f]
            if gone:
                out.append((uid[i], gone, None, None, None, None))
        elif usuals[i].any():
            at, found = np.frombuffer(places[i], np.int64), np.flatnonzero(usuals[i]).tolist()
            flags = with_partner(i, [False] * len(hashes[i]))
            out += [(uid[i], None, k // 2, int(at[k]), pages[i], flags[k // 2]) for k in found]
    types = [pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], ["uid", "gone", "line", "place", "pages", "shared"])


def _agreed(found: DataFrame) -> DataFrame:
    """uid and gone of the pages whose articles have lines that half of the host's pages share with their partners at that place."""
    places = found.groupBy("place").agg(F.count("*").alias("size"), F.sum(F.col("shared").cast("long")).alias("votes"), F.first("pages").alias("pages"))
    places = places.where((F.col("votes") >= TEMPLATE_LEAST) & (F.col("votes") >= TEMPLATE_SHARE * F.col("pages"))).select("place", "size")
    return join_skewed(found.select("uid", "line", "place"), stash(places), "place", "size").groupBy("uid").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def shared_lines(pages: DataFrame) -> DataFrame:
    """uid and gone: places of the content lines that a page shares with the nearest page, or that are its host's template."""
    lines = stash(_lines(pages.select("url", "html")))
    parts = max(1, -(-lines.count() // PARTITION_ROWS))
    ranged = _usual(lines).repartitionByRange(parts, "host", "path", "uid").sortWithinPartitions("host", "path", "uid")
    bordered = ranged.mapInArrow(_with_borders, "uid long, host string, path string, hashes binary, places binary, pages long, usual binary, part int, context boolean")
    found = stash(bordered.groupBy("part").applyInArrow(_shared, _FOUND))
    unmarked, marked = found.where("gone is not null").select("uid", "gone"), found.where("place is not null")
    return unmarked.unionByName(_agreed(marked)) if marked.take(1) else unmarked


def extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, url, text and n_chars of every row of ``pages`` (key, url, html).

    Null and empty HTML, and pages without text, give an empty text. Pages without a usable URL are a host of their
    own. Of partners whose paths agree for equally many characters, the one closer in path order counts, of two as
    close the earlier one; pages at one path are ordered by their lines' hash. An empty table gives an empty result. Character references are decoded, white space inside a block (a line break too) becomes one space, blocks are
    joined by line ends; nothing is cut. Equal pages give equal texts, in any number; other columns are left aside.
    """
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("key"), "url", "html")
    shared = stash(shared_lines(rows))
    few = shared.limit(BROADCAST_PAGES + 1).collect()

    def text(url, page, gone_of):
        found = parsed(page or "")
        gone = frozenset(gone_of(url, found) or ()) if found.lines else ()
        return "\n".join(x for k, x in enumerate(found.texts) if k not in gone)

    def out(batch, texts):
        return pa.RecordBatch.from_arrays([batch["key"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["key", "url", "text", "n_chars"])

    schema = f"key {kind}, url string, text string, n_chars long"
    if len(few) <= BROADCAST_PAGES:
        masks = rows.sparkSession.sparkContext.broadcast({r["uid"]: r["gone"] for r in few})

        def run(batches):
            find = lambda url, found: masks.value.get(_identity(url, found)[0]) if masks.value else None
            for batch in slices(batches):
                yield out(batch, [text(u, p, find) for u, p in zip(batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True)])

        return rows.mapInArrow(run, schema).withColumnRenamed("key", key)

    def identify(batches):
        for batch in slices(batches):
            uids = [_identity(u, parsed(p or ""))[0] for u, p in zip(batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(uids, pa.int64())], [*batch.schema.names, "uid"])

    def run_joined(batches):
        for batch in batches:
            yield out(batch, [text(u, p, lambda *_: g) for u, p, g in zip(batch["url"].to_pylist(), batch["html"].to_pylist(), batch["gone"].to_pylist(), strict=True)])  # noqa: B023

    named = rows.mapInArrow(identify, f"key {kind}, url string, html string, uid long")
    return named.join(shared, "uid", "left").select("key", "url", "html", "gone").mapInArrow(run_joined, schema).withColumnRenamed("key", key)


def op7_page_differencing(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
