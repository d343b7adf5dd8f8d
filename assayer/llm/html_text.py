"""Main text of HTML pages: page structure, and a suffix array of each host's token streams.

1. A page is cut into blocks in page order. A block knows whether it lies in an article or main element, and whether it lies in menus, headers,
   footers, sidebars, notices, adverts, forms or reader comments, by element, role, or a word of its class or id. Inside an article only whole
   classes of elements other than headings, paragraphs and the like count. A marked inline element loses its own text, not its block.
2. The pages of a host are dealt by their token streams into groups of about ``GROUP_CHARS``, so a host of any size is many tasks. In a group
   the streams of distinct pages are laid end to end and a suffix array is built over them (ranks by doubling). Where neighbouring suffixes
   of different pages agree in ``RUN`` tokens or more, both are covered by a repeated run. Pages with equal streams are one page.
   Groups of one host also tell each other their runs of ``RUN`` tokens, by ranges of the hash; what two groups have is repeated in both,
   as no stream is in two groups. So the size of a group decides nothing but the size of a task. They do so twice: first by the leading bits
   of the hashes, a few more than tell the host's runs apart, then by the other bits, only for runs whose leading bits two groups have. What is told
   first are rising numbers as low bits and unary high bits, what comes back is a bit a run.
3. Marked blocks go. Of the others, a block outside articles is boilerplate if repeated runs cover all its tokens; blocks with unique runs stay.
   If a page has an article or main element, the text is what is in it: passages that articles share are theirs and stay. Without such an
   element and with nothing unique, all unmarked blocks stay.

Null and empty pages have an empty text. Unclosed elements end with the page. Repeated rows are extracted each. A null URL
is a host of its own. Markup that can't be parsed counts as text. Pages of any length are read whole, one at a time; an empty table gives an empty one, and
columns other than key, URL and HTML are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm.frames import map_batches
from assayer.llm.words import grams, words

#: Tokens of a repeated run.
RUN = 4
GROUP_CHARS = 4 << 20
#: Groups whose runs one task compares, and leading bits of a run's hash beyond those that number the runs of a host. Both decide only what is moved.
RANGE_GROUPS, SPARE_BITS = 4, 4
#: Pages, and bytes of each, that compression of the blocks refers to; they too decide only what is moved.
DICTIONARY = 32, 512
_SLAB = 1 << 16

# Elements by what they do to the text.
_DROPPED = {"script", "style", "noscript", "template", "head", "title", "iframe", "object", "svg", "canvas", "select", "button", "textarea"}
_MARKED = {"nav", "header", "footer", "aside", "form", "dialog", "menu"}
_MAIN = {"article", "main"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
           "mark", "meter", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}
_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|header|masthead|"
    r"cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|"
    r"comments?|commentlist|replies|disqus|respond|pagination|pager|widget|copyright|legal|disclaimer)(?=$|[\s_-])", re.IGNORECASE)
#: Inside an article a class or id counts as a whole: "article-header" and "social science" head and carry text there.
_OWN_WORDS = re.compile(
    r"(?:ad|ads|advert\w*|adbox|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|cookies?|consent|gdpr|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|share|sharing|related|recommended|comments?|commentlist|replies|disqus|respond|pagination|pager|widget)"
    r"(?:[_-].*)?|side|footer|header|masthead|notice|alert|social|copyright|legal|disclaimer", re.IGNORECASE)
#: Elements that hold an article's own text, whatever their class.
_TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "blockquote", "pre", "figcaption", "caption"}
_GAP = re.compile(r"\s+")
#: Elements whose start closes an open paragraph.
_CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
             "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


class _Blocks(HTMLParser):
    """(text, in main, marked) of each block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, bool, bool]] = []
        self.open: list[tuple[str, bool, bool, bool]] = []  # element, dropped, main, marked, each also from outside
        self.text: list[str] = []

    @property
    def state(self):
        return self.open[-1][1:] if self.open else (False, False, False)

    def cut(self):
        text = _GAP.sub(" ", "".join(self.text)).strip()
        self.text = []
        if text:
            self.blocks.append((text, *self.state[1:]))

    def handle_starttag(self, tag, attrs):
        if tag not in _INLINE:
            self.cut()
            while self.open and self.open[-1][0] in _INLINE and self.open[-1][1]:
                self.open.pop()  # a marked inline element that was never closed ends with its block
        if tag in _CLOSES_P:
            self._close({"p"}, {"article", "main", "div", "section", "body", "td", "li", "nav", "header", "footer", "aside", "form"})
        elif tag == "li":
            self._close({"li"}, {"ul", "ol", "menu"})
        if tag in _VOID:
            return
        dropped, main, marked = self.state
        at = dict(attrs)
        name = f"{at.get('class') or ''} {at.get('id') or ''}"
        if main:  # the head of an article is a part of it
            worded = tag not in _TEXT and tag not in _MAIN and any(_OWN_WORDS.fullmatch(w) for w in name.split())
            own = (tag in _MARKED and tag != "header") or worded
        else:
            own = tag in _MARKED or (tag not in ("body", "html", *_MAIN) and _WORDS.search(name) is not None)
        own = own or (at.get("role") or "").lower() in _ROLES or "hidden" in at or at.get("aria-hidden") == "true"
        if tag in _INLINE:  # only its own text goes, not the block that it stands in
            dropped, own = dropped or own, False
        self.open.append((tag, dropped or tag in _DROPPED, main or tag in _MAIN or at.get("role") == "main", marked or own))

    def _close(self, names, barriers):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                del self.open[i:]
                return
            if self.open[i][0] in barriers:
                return

    def handle_startendtag(self, tag, attrs):
        if tag not in _INLINE:
            self.cut()

    def handle_endtag(self, tag):
        if tag not in _INLINE:
            self.cut()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if not self.state[0]:
            self.text.append(data)

    def done(self):
        self.cut()
        return self.blocks


_COPY = pa.struct([("page_id", pa.int64()), ("url", pa.string())])


def blocks(html: str | None) -> list[tuple[str, bool, bool]]:
    if not html:
        return []
    parser = _Blocks()
    try:
        parser.feed(html)
        parser.close()
    except (AssertionError, ValueError):  # what the standard parser raises on broken declarations
        parser.handle_data(re.sub(r"<[^>]*>", " ", html) if not parser.blocks else "")
    return parser.done()


def repeated(tokens: np.ndarray, page: np.ndarray, run: int) -> np.ndarray:
    """Which tokens lie in a run of ``run`` tokens that also stands in another page.

    ``tokens`` are the streams laid end to end, ``page`` the stream of each. Suffixes are ranked by doubling the compared length until it reaches
    ``run``; in the array sorted by that, suffixes with one rank agree in ``run`` tokens.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, bool)
    left = np.searchsorted(page, page, "right") - np.arange(n)  # tokens up to the page's end

    def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        ranks = np.empty(n, np.int64)
        ranks[order] = np.concatenate([[0], np.cumsum(keys[order][1:] != keys[order][:-1])])
        return order, ranks

    array, rank = ranked(tokens)
    length = 1
    while length < run:
        step = min(length, run - length)
        later = np.full(n, -1, np.int64)
        inside = left > step
        later[inside] = rank[np.flatnonzero(inside) + step]
        array, rank = ranked(rank * (n + 1) + later + 1)
        length += step
    array = array[left[array] >= run]
    if not len(array):
        return np.zeros(n, bool)
    start = np.flatnonzero(np.r_[True, rank[array][1:] != rank[array][:-1]])
    pages = page[array]
    several = np.minimum.reduceat(pages, start) != np.maximum.reduceat(pages, start)
    hits = array[np.repeat(several, np.diff(np.r_[start, len(array)]))]
    change = np.zeros(n + 1, np.int64)
    change[hits] += 1
    np.subtract.at(change, hits + run, 1)
    return np.cumsum(change[:-1]) > 0


def _dictionary(pages: DataFrame, html: str) -> bytes:
    """Text that the blocks of any page are compressed against, from the head of a few pages."""
    heads = pages.select(F.substring(F.col(html).cast("string"), 1, 8 * DICTIONARY[1]).alias("html")).limit(DICTIONARY[0]).collect()
    return b"".join(json.dumps([x[0] for x in blocks(r.html)], ensure_ascii=False).encode("utf-8", "replace")[:DICTIONARY[1]] for r in heads)


def _pack(found: list[tuple[str, bool, bool]], dictionary: bytes = b"") -> bytes:
    """A page's blocks as they travel: compressed, as they are most of what the operator moves."""
    known = "".join(str(main + 2 * marked) for _, main, marked in found)
    packer = zlib.compressobj(wbits=-15, memLevel=9, zdict=dictionary)
    return packer.compress(json.dumps([known, *(x[0] for x in found)], ensure_ascii=False, separators=(",", ":")).encode("utf-8")) + packer.flush()


def _unpack(packed: bytes, dictionary: bytes = b"") -> list[tuple[str, bool, bool]]:
    known, *texts = json.loads(zlib.decompressobj(wbits=-15, zdict=dictionary).decompress(packed))
    return [(text, k in "13", k in "23") for text, k in zip(texts, known)]


def _bits(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bits of each number, laid end to end."""
    slabs = (values[a:a + _SLAB].astype(">u8").view(np.uint8).reshape(-1, 8) for a in range(0, len(values), _SLAB))
    return b"".join(np.packbits(np.unpackbits(x, axis=1)[:, 64 - width:]).tobytes() for x in slabs)


def _numbers(packed: bytes | np.ndarray, n: int, width: int) -> np.ndarray:
    values, packed = np.zeros(n, np.uint64), np.frombuffer(packed, np.uint8)
    for a in range(0, n if width else 0, _SLAB):
        rows = min(_SLAB, n - a)
        bits = np.zeros((rows, 64), np.uint8)
        bits[:, 64 - width:] = np.unpackbits(packed[a * width // 8:], count=rows * width).reshape(rows, width)
        values[a:a + rows] = np.packbits(bits, axis=1).view(">u8").ravel()
    return values


def _coded(values: np.ndarray, width: int) -> bytes:
    """Rising distinct numbers of ``width`` bits in about 2 bits each beyond the logarithm of their mean gap: low bits as they are, high bits in unary."""
    n = len(values)
    low = max(0, width - n.bit_length())
    at = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(at[-1]) + 1, np.uint8)
    high[at] = 1
    return np.array([n, low], np.int64).tobytes() + _bits(values, low) + np.packbits(high).tobytes()


def _decoded(coded: bytes) -> np.ndarray:
    n, low = (int(x) for x in np.frombuffer(coded, np.int64, 2))
    body = np.frombuffer(coded, np.uint8, offset=16)
    size = -(-n * low // 8)
    high = (np.flatnonzero(np.unpackbits(body[size:])) - np.arange(n)).astype(np.uint64)
    return (high << np.uint64(low)) | _numbers(body[:size], n, low)


def _marks(marked: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(marked).tobytes(), 1)


def _marked(marks: bytes) -> np.ndarray:
    """Up to seven places more than were marked, all unset."""
    return np.unpackbits(np.frombuffer(zlib.decompress(marks), np.uint8)).astype(bool)


def _doubles(held: list[np.ndarray]) -> np.ndarray:
    """Rising: what stands in several of the lists, each of which has a number once."""
    every = np.sort(np.concatenate(held))
    return every[1:][every[1:] == every[:-1]]


def _among(values: np.ndarray, rising: np.ndarray) -> np.ndarray:
    if not len(rising):
        return np.zeros(len(values), bool)
    return rising[np.minimum(np.searchsorted(rising, values), len(rising) - 1)] == values


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def _host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _parsed(pages: DataFrame, key: str, url: str, html: str, dictionary: bytes = b"") -> DataFrame:
    """Pages cut into blocks: a row for each distinct page of an Arrow batch, with all the rows it stands for.

    stream is a hash of all tokens, digest one of the tokens, of where the blocks end and of what is known of them.
    fresh: the first row of its host with its digest in a task. Only it carries the blocks, so of a page with many copies a task gets one for
    each split of the input.
    """
    seen: set = set()  # each task has its own

    def cut(b: pa.RecordBatch):
        rows: dict = {}
        for host, page_id, link, h in zip(*[b.column(c).to_pylist() for c in ("host", "page_id", "url")], b.column("html")):
            found = blocks(h.as_py())
            body = " ".join(x[0] for x in found).encode("utf-8", "replace").lower()  # as words() folds and splits it
            hashed = hashlib.blake2b(body, digest_size=16).digest()
            ends = np.array([(len(x[0].encode("utf-8", "replace")), *x[1:]) for x in found], np.int64).tobytes()
            # the texts too: the tokens are folded, and each page keeps its own letters
            digest = hashlib.blake2b(hashed + ends + json.dumps([x[0] for x in found]).encode("utf-8"), digest_size=16).digest()
            if (host, digest) not in rows:
                fresh = (host, digest) not in seen
                seen.add((host, digest))
                rows[host, digest] = (int.from_bytes(hashed[:8], "little", signed=True), _pack(found, dictionary) if fresh else None, fresh, [])
            rows[host, digest][3].append({"page_id": page_id, "url": link})
        return pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in rows], pa.string()), pa.array([d for _, d in rows], pa.binary()),
             *[pa.array([r[i] for r in rows.values()], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.bool_(), pa.list_(_COPY)))]],
            ["host", "digest", "stream", "blocks", "fresh", "copies"])

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), _host(url).alias("host"),
                        F.col(html).cast("string").alias("html"))
    return map_batches(rows, cut, "host string, digest binary, stream long, blocks binary, fresh boolean, copies array<struct<page_id: long, url: string>>")


def _streams(table: pa.Table, dictionary: bytes):
    """Of a group: the row that stands for each digest, blocks of those rows, tokens of their blocks laid end to end, bounds of blocks in them and of rows in those,
    the row that each shares its stream with, rows of distinct streams, and the places of their tokens with their pages."""
    first_row: dict = {}
    for i, (d, sent) in enumerate(zip(table.column("digest").to_pylist(), table.column("blocks").is_valid().to_pylist())):
        if sent:
            first_row.setdefault(d, i)
    rows = list(first_row.values())
    found = [_unpack(x, dictionary) for x in table.column("blocks").take(pa.array(rows, pa.int64())).to_pylist()]
    texts = [[x[0] for x in f] for f in found]
    edge = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    count, tokens = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for w in words(pa.array([x for t in texts for x in t], pa.string()), lower=True):
        count.append(w.counts), tokens.append(w.hash)
    tokens = np.concatenate(tokens)
    first = np.concatenate([[0], np.cumsum(np.concatenate(count))]).astype(np.int64)
    seen: dict = {}
    page = [seen.setdefault(tokens[first[edge[i]]:first[edge[i + 1]]].tobytes(), i) for i in range(len(texts))]
    single = [i for i in range(len(texts)) if page[i] == i]
    spans = [np.arange(first[edge[i]], first[edge[i + 1]]) for i in single]
    at = np.concatenate(spans) if spans else np.empty(0, np.int64)
    return first_row, found, tokens, first, edge, page, at, np.array([len(s) for s in spans], np.int64)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", run: int = RUN,
              group_chars: int = GROUP_CHARS) -> DataFrame:
    """(page_id, url, text, n_repeated): n_repeated counts the tokens in runs that other pages of the host have too."""
    dictionary = _dictionary(pages, html)
    parsed = _parsed(pages, key, url, html, dictionary)

    def leading(groups: int) -> tuple[int, int]:
        """Leading bits of a hash that name its range, and those told at first."""
        return int((groups - 1) // RANGE_GROUPS).bit_length(), min(64, int(groups * group_chars // 4).bit_length() + SPARE_BITS)

    def runs_of(streams) -> np.ndarray:
        hashes, inside = grams(streams[2][streams[6]], np.concatenate([[0], np.cumsum(streams[7])]), run)
        return _distinct(hashes[inside])

    def ranges(runs: np.ndarray, bits: int):
        part = (runs >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(runs), np.int64)
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
        return {int(part[a]): runs[a:z] for a, z in zip(edge, edge[1:])}

    def short(part: np.ndarray, bits: int, told: int) -> np.ndarray:
        """What is told at first: the bits after the range's."""
        return (part << np.uint64(bits)) >> np.uint64(64 - told + bits)

    def likely(part: np.ndarray, bits: int, told: int, places: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Of a range's runs: those whose leading bits are marked, and which of all have other leading bits than the one before."""
        leads = short(part, bits, told)
        new = np.r_[True, leads[1:] != leads[:-1]]
        return _marked(places)[np.cumsum(new) - 1], new

    def message(table: pa.Table, rows: list[tuple], *names: str) -> pa.Table:
        """Rows of a group: range and what is told."""
        host, group = (table.column(c)[0].as_py() if rows else None for c in ("host", "group"))
        return pa.table({"host": pa.array([host] * len(rows), pa.string()), "range": pa.array([r[0] for r in rows], pa.int64()),
                         "group": pa.array([group] * len(rows), pa.int64()),
                         **{c: pa.array([r[i] for r in rows], pa.binary()) for i, c in enumerate(names, 1)}})

    def replies(rows: list[tuple]) -> pa.Table:
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(
            (("host", pa.string()), ("group", pa.int64()), ("range", pa.int64()), ("places", pa.binary()), ("own", pa.binary())))})

    def tell(table: pa.Table) -> pa.Table:
        """Leading bits of a group's distinct runs, by ranges of their hashes; none where the host is one group."""
        groups = table.column("groups")[0].as_py()
        if groups == 1:
            return message(table, [], "held")
        bits, told = leading(groups)
        parts = {at: _distinct(short(part, bits, told)) for at, part in ranges(runs_of(_streams(table, dictionary)), bits).items()}
        return message(table, [(at, _coded(x, told - bits)) for at, x in parts.items()], "held")

    def compare(table: pa.Table) -> pa.Table:
        """For each group the places of those leading bits of this range that another group of the host has too."""
        held = [_decoded(x) for x in table.column("held").to_pylist()]
        shared = _doubles(held)
        rows = []
        for host, group, at, x in zip(*(table.column(c).to_pylist() for c in ("host", "group", "range")), held):
            if (own := _among(x, shared)).any():
                rows.append((host, group, at, _marks(own), None))
        return replies(rows)

    def confirm(table: pa.Table, asked: pa.Table) -> pa.Table:
        """The other bits of the runs whose leading bits another group has, in their order; new marks those with other leading bits than the one before."""
        if not table.num_rows or not asked.num_rows:
            return message(table, [], "new", "rest")
        bits, told = leading(table.column("groups")[0].as_py())
        parts = ranges(runs_of(_streams(table, dictionary)), bits)
        rows = []
        for at, places in zip(asked.column("range").to_pylist(), asked.column("places").to_pylist()):
            chosen, new = likely(parts[at], bits, told, places)
            rows.append((at, np.int64(chosen.sum()).tobytes() + _marks(new[chosen]), np.int64(64 - told).tobytes() + _bits(parts[at][chosen], 64 - told)))
        return message(table, rows, "new", "rest")

    def settle(first: pa.Table, second: pa.Table) -> pa.Table:
        """Of each group's runs with shared leading bits those that another group has too, beside the places of the leading bits."""
        if not second.num_rows:
            return replies([])
        held = dict(zip(first.column("group").to_pylist(), map(_decoded, first.column("held").to_pylist())))
        shared = _doubles(list(held.values()))
        whole, places = {}, {}
        for group, new, rest in zip(*(second.column(c).to_pylist() for c in ("group", "new", "rest"))):
            n, width = (int(np.frombuffer(x, np.int64, 1)[0]) for x in (new, rest))
            places[group] = _among(held[group], shared)
            leads = held[group][places[group]][np.cumsum(_marked(new[8:])[:n]) - 1]
            whole[group] = (leads << np.uint64(width)) | _numbers(rest[8:], n, width)
        shared = _doubles(list(whole.values()))
        host, at = (first.column(c)[0].as_py() for c in ("host", "range"))
        owned = {group: _among(x, shared) for group, x in whole.items()}
        return replies([(host, group, at, _marks(places[group]), _marks(own)) for group, own in owned.items() if own.any()])

    def told_back(table: pa.Table, others: pa.Table, runs: np.ndarray) -> np.ndarray:
        """The runs of a group that other groups have."""
        bits, told = leading(table.column("groups")[0].as_py())
        parts, found = ranges(runs, bits), []
        for at, places, own in zip(*(others.column(c).to_pylist() for c in ("range", "places", "own"))):
            chosen = parts[at][likely(parts[at], bits, told, places)[0]]
            found.append(chosen[_marked(own)[:len(chosen)]])
        return np.sort(np.concatenate(found))

    def judge(table: pa.Table, others: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"copies": pa.array([], pa.list_(_COPY)), "text": pa.array([], pa.string()), "n_repeated": pa.array([], pa.int64())})
        streams = _streams(table, dictionary)
        first_row, pages_found, tokens, first, edge, page, at, sizes = streams
        here = repeated(tokens[at], np.repeat(np.arange(len(sizes)), sizes), run)
        if others.num_rows:
            elsewhere = told_back(table, others, runs_of(streams))
            hashes, inside = grams(tokens[at], np.concatenate([[0], np.cumsum(sizes)]), run)
            hits = np.flatnonzero(inside & _among(hashes, elsewhere))
            change = np.zeros(len(at) + 1, np.int64)
            change[hits] += 1
            np.subtract.at(change, hits + run, 1)
            here |= np.cumsum(change[:-1]) > 0
        covered = np.zeros(len(tokens), bool)
        covered[at] = here
        texts, n = [], []
        for i, found in enumerate(pages_found):
            own = covered[first[edge[page[i]]]:first[edge[page[i] + 1]]]  # a copy is covered where its first is
            inner = first[edge[i]:edge[i + 1] + 1] - first[edge[i]]
            unmarked = [(text, main, not own[a:z].all()) for (text, main, marked), a, z in zip(found, inner, inner[1:]) if not marked]
            inside, fresh = [x for x in unmarked if x[1]], [x for x in unmarked if x[2]]
            texts.append(" ".join(x[0] for x in inside or fresh or unmarked))
            n.append(int(own.sum()))
        place = {d: i for i, d in enumerate(first_row)}
        stands = pa.array([place[d] for d in table.column("digest").to_pylist()], pa.int64())
        return pa.table({"copies": table.column("copies"), "text": pa.array(texts, pa.string()).take(stands),
                         "n_repeated": pa.array(n, pa.int64()).take(stands)})

    # a host of several groups has more than ``group_chars``, so this is a row for each of those characters at most
    size = F.length(F.regexp_replace(F.col(html).cast("string"), "<[^>]*>", ""))  # about the text's; a group's size decides nothing else
    groups = pages.groupBy(_host(url).alias("host")).agg(F.ceil(F.sum(size) / group_chars).alias("groups")).where("groups > 1")
    dealt = (parsed.join(F.broadcast(groups), "host", "left")
             .withColumn("groups", F.coalesce("groups", F.lit(1).cast("long")))
             .withColumn("group", F.pmod(F.xxhash64("stream"), F.col("groups")))
             .select("host", "group", "groups", "digest", "blocks", "copies"))
    reply = "host string, group long, range long, places binary, own binary"
    first = dealt.groupBy("host", "group").applyInArrow(tell, "host string, range long, group long, held binary").groupBy("host", "range")
    second = (dealt.groupBy("host", "group").cogroup(first.applyInArrow(compare, reply).groupBy("host", "group"))
              .applyInArrow(confirm, "host string, range long, group long, new binary, rest binary"))
    shared = first.cogroup(second.groupBy("host", "range")).applyInArrow(settle, reply)
    verdict = (dealt.groupBy("host", "group").cogroup(shared.groupBy("host", "group"))
               .applyInArrow(judge, "copies array<struct<page_id: long, url: string>>, text string, n_repeated long"))
    return verdict.select(F.explode("copies").alias("c"), "text", "n_repeated").select("c.page_id", "c.url", "text", "n_repeated")
