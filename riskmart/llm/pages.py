"""Main text of web pages, with a suffix array over each host.

A page is read into blocks. Blocks inside its article container (article, main, role main) are the main text, apart from
elements that by name, role or class are menus, headers, footers, sidebars, notices, adverts, forms or reader comments.
What stands outside a container is decided by repetition: the token streams of a host's pages, without their
containers, form one suffix array, which finds the runs of RUN or more tokens that occur on two distinct pages. Of a page
without a container a block is boilerplate if one such run covers it wholly and the block recurs on PAGES distinct pages;
all other blocks stay as they are. Pages of one host with equal tokens are copies and count as one page.

Text inside a container is never dropped for being repeated: copies of an article are articles. A container below a form
or a layout element counts as well, below an aside or a related list only as the one container of a page without other text; no class word drops a
paragraph, heading, item or cell of a container. A page that would end without any text keeps its blocks open to decision.

The array is sharded by the first RUN tokens of a suffix, so a large host spreads over all tasks, and equal suffixes are
one row with its smallest and largest page before they are shuffled and sorted.
"""

from __future__ import annotations

import hashlib
import html as references
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm.common import staged

#: Tokens of the shortest run that counts as repeated, and tokens that a suffix shows.
RUN, SHOWN = 6, 24
#: Distinct pages of a host that have a block of boilerplate; fewer are copies with small changes, or chance.
PAGES = 4
#: Up to this many repeated suffixes and blocks are looked up while pages are read (16 bytes each); beyond it, places are joined.
LOOKUP = 2_000_000

RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "canvas"}
DROPPED = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head", "fieldset", "label", "input"}
CONTAINERS = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
          "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
HINTS = {"nav", "navbar", "navigation", "menu", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts", "advertisement", "advertising",
         "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert",
         "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related",
         "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "comment", "comments", "commentlist", "disqus", "replies", "respond",
         "widget", "toolbar", "masthead", "copyright", "skip", "hidden"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
#: How an element drops what it holds. A container below WRAPPER counts, one below PART only where a page would have no text
#: otherwise, one below BESIDE (asides, related lists) only where it is also the page's one container, one below FOREIGN
#: (comments, adverts, hidden elements) never.
WRAPPER, PART, BESIDE, FOREIGN = 1, 2, 3, 4
#: Blocks of a text: inside a container no class word drops them.
TEXTS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "figure", "pre", "td"}
FORMS = {"form", "fieldset"}
#: Words that tell the layout element of a whole page from the part its other words name.
LAYOUT = {"layout", "page", "main", "site", "wrapper", "wrap", "container", "content", "body", "columns", "grid", "has", "with", "no", "without"}
OTHERS = {"comment", "comments", "commentlist", "disqus", "replies", "respond", "ad", "ads", "advert", "adverts", "advertisement", "advertising",
          "adsense", "sponsor", "sponsored", "promo", "promotion"}
RELATED = {"related", "recommended"}

_TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|([!?])[^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_HINT = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_HOST = re.compile(r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host(url: str | None) -> str:
    """Host of an address in lower case; the empty text if there is none."""
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _dropped(name: str, attributes: str, inside: bool = False) -> int:
    """0 if the element keeps what it holds, else WRAPPER, PART, BESIDE or FOREIGN."""
    found = WRAPPER if name in FORMS else BESIDE if name == "aside" else PART if name in DROPPED else 0
    if not attributes.strip(" /"):
        return found
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id") and name not in ("body", "html") and not (inside and name in TEXTS):
            words = {w.lower() for w in _HINT.findall(value)}
            if name in CONTAINERS:
                found = max(found, FOREIGN if words & {"comment", "comments", "ad", "ads", "advert", "promo"} else BESIDE if words & RELATED else 0)
            elif words & HINTS:
                found = max(found, FOREIGN if words & OTHERS else BESIDE if words & RELATED else WRAPPER if words & LAYOUT else PART)
        if key == "role" and value.lower() in ROLES:
            found = max(found, BESIDE if value.lower() == "complementary" else WRAPPER if value.lower() == "form" else PART)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            found = FOREIGN
    return found


def blocks(page: str | None, reach: int = WRAPPER) -> list[tuple[bool, int, str]]:
    """(in container, how it is dropped by an element, text) of every non-empty block of a whole page, in order.

    A container counts below elements that drop up to `reach`. References are decoded, white space inside a block is one space. Comments, scripts, styles and titles give none;
    unclosed elements end with the page.
    """
    page = page or ""
    out: list[tuple[bool, int, str]] = []
    stack: list[tuple[str, bool, int]] = []
    parts: list[str] = []
    inside, dropped = False, 0

    def end() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append((inside, dropped, text))

    at = 0
    while True:
        m = _TAG.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text:
            parts.append(references.unescape(text))
        if m is None:
            break
        at = m.end()
        name = (m[4] or "").lower()
        if not name:
            continue
        if m[3]:
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if found is not None:
                if any(x[0] not in INLINE for x in stack[found:]):
                    end()
                inside, dropped = stack[found][1:]
                del stack[found:]
            elif name not in INLINE:
                end()
            continue
        if name in RAW:
            if not m[5].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else len(page)
            continue
        if name not in INLINE:
            end()
        if name == "br":
            parts.append(" ")
        if name in VOID:
            continue
        if name not in INLINE and (name in CLOSES or any(x[0] == "p" for x in stack[-3:])):
            closed = CLOSES.get(name, set()) | {"p"}
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closed:
                    inside, dropped = stack[i][1:]
                    del stack[i:]
                elif stack[i][0] not in INLINE:
                    break
        stack.append((name, inside, dropped))
        attributes = m[5]
        main = name in CONTAINERS or "role" in attributes and re.search(r"role\s*=\s*[\"']?main\b", attributes, re.I) is not None
        dropped = max(dropped, _dropped(name, attributes, inside))
        if main and dropped <= reach:
            inside, dropped = True, 0
    end()
    return out


def _containers(page: str | None) -> int:
    """How many elements of a page, outside of comments, are containers by name or role."""
    return sum((m[4] or "").lower() in CONTAINERS or re.search(r"role\s*=\s*[\"']?main\b", m[5] or "", re.I) is not None
               for m in _TAG.finditer(page or "") if m[4] and not m[3])


def _token_hashes(text: str) -> list[int]:
    """A number below 2**31 for each token; runs of several tokens tell texts apart."""
    return [zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) >> 1 for w in text.split()]


def _number(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True)


def _page(url: str | None, page: str | None) -> tuple[str, str | None, list[str], list[int], list[int], int]:
    """Host, the main text of a page with a container (else null), the texts of the blocks open to decision, the ends of all
    blocks outside of the container in their stream of tokens, open blocks first, that stream, and a number for the page,
    the same for pages with equal tokens."""
    found = blocks(page)
    kept = 0
    if found and all(d for _, d, _ in found):
        # a page without text: a container below a part of it, else what stands in forms and layout elements
        again = blocks(page, BESIDE if _containers(page) == 1 else PART)
        found, kept = (again, 0) if any(i and not d for i, d, _ in again) else (found, WRAPPER)
    has = any(i and not d for i, d, _ in found)
    stream, ends, undecided = [], [], []
    for i, d, t in found:
        if not has and d <= kept:
            stream += _token_hashes(t)
            ends.append(len(stream))
            undecided.append(t)
    for i, d, t in found:
        if not i and (has or d > kept):
            stream += _token_hashes(t)
            ends.append(len(stream))
    number = _number(" ".join(t for _, _, t in found).lower().encode("utf-8", "surrogatepass"))
    return host(url), "\n".join(t for i, d, t in found if i and not d) if has else None, undecided, ends, stream, number


def _block_numbers(name: str, tokens: list[int], ends: list[int]) -> list[int]:
    """A number for each block of a stream, the same for equal tokens on one host."""
    start, raw = name.encode() + b"\0", np.asarray(tokens, ">i4").tobytes()
    return [_number(start + raw[4 * a:4 * b]) for a, b in zip([0, *ends], ends)]


def _suffixes(name: str, tokens: list[int], run: int, shown: int) -> Iterator[tuple[int, int, bytes]]:
    """(shard, hash, shown tokens) of every suffix with at least `run` tokens, in order."""
    start, raw = name.encode() + b"\0", np.asarray(tokens, ">i4").tobytes()
    for i in range(len(tokens) - run + 1):
        part = raw[4 * i:4 * (i + shown)]
        yield (*(int.from_bytes(hashlib.blake2b(start + x, digest_size=8).digest(), "big", signed=True) for x in (part[:4 * run], part)), part)


def run_lengths(rows: DataFrame, run: int = RUN, shown: int = SHOWN) -> DataFrame:
    """(s, length): suffixes whose first `length` >= `run` tokens occur on two pages of a host, from rows with host, r (one
    number for each page) and tokens. Equal suffixes are one row before the shuffle; shards are sorted and neighbours
    compared, so the longest common start with any other page is found."""
    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for h, r, tokens in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for row in _suffixes(h, tokens or [], run, shown):
                    for column, value in zip(out, (*row, r)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.int64()))],
                                             names=["shard", "s", "suffix", "r"])

    array = staged(rows.select("host", "r", "tokens").mapInArrow(suffixes, "shard long, s long, suffix binary, r long").groupBy(
        "shard", "s", "suffix").agg(F.min("r").alias("low"), F.max("r").alias("high")), "pages-suffixes")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Longest common start of each suffix with one passed before that is of another page. Of the rows passed it
        keeps the reach of the latest page (near) and of the nearest row of any other page (other)."""
        shard = before = page = None
        near = other = 0
        for batch in batches:
            s, length = [], []
            for own, key, suffix, low, high in zip(*(batch.column(c).to_pylist() for c in ("shard", "s", "suffix", "low", "high"))):
                now, whole = np.frombuffer(suffix, ">i4"), len(suffix) // 4
                if own != shard:
                    shard, page, near, other = own, None, 0, 0
                else:
                    k = min(len(now), len(before))
                    same = now[:k] == before[:k]
                    reach = k if same.all() else int(same.argmin())
                    near, other = min(near, reach), min(other, reach)
                best = whole if low != high else other if low == page else near
                if low != high:
                    page, near, other = low, whole, whole
                elif low != page:
                    page, near, other = low, whole, near
                else:
                    near = whole
                before = now
                if best >= run:
                    s.append(key)
                    length.append(best)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(length, pa.int32())], names=["s", "length"])

    # once in each direction, with a fixed amount of memory for any number of suffixes
    both = [array.repartition("shard").sortWithinPartitions("shard", order).select("shard", "s", "suffix", "low", "high").mapInArrow(
        walk, "s long, length int") for order in (F.col("suffix").asc(), F.col("suffix").desc())]
    return staged(both[0].union(both[1]).groupBy("s").agg(F.max("length").alias("length")), "pages-runs")


class Runs:
    """Repeated runs looked up by suffix."""

    def __init__(self, lengths: DataFrame, run: int, shown: int):
        found = lengths.toPandas().sort_values("s", kind="stable")
        self.keys, self.lengths = found["s"].to_numpy(np.int64), found["length"].to_numpy(np.int64)
        self.run, self.shown = run, shown

    def places(self, name: str, tokens: list[int]) -> tuple[list[int], list[int]]:
        """Places of the suffixes that start a repeated run, in order, and the lengths of the runs."""
        hashes = np.array([s for _, s, _ in _suffixes(name, tokens, self.run, self.shown)], np.int64)
        if not len(hashes) or not len(self.keys):
            return [], []
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        some = np.flatnonzero(self.keys[at] == hashes)
        return some.tolist(), self.lengths[at[some]].tolist()

    def __call__(self, name: str, tokens: list[int]) -> list[bool]:
        """Whether each token lies in a repeated run."""
        covered = [False] * len(tokens)
        for i, n in zip(*self.places(name, tokens)):
            covered[i:i + n] = [True] * n
        return covered


def _covered(start: int, end: int, reach: dict[int, int], shown: int) -> bool:
    """Whether one repeated run holds the tokens from start to end; reach has the lengths of the runs by their places. A
    run that is longer than a suffix shows is one whose every suffix is repeated as far as shown."""
    if end - start <= shown:
        return any(p + reach.get(p, 0) >= end for p in range(max(0, end - shown), start + 1))
    return all(reach.get(p, 0) >= shown for p in range(start, end - shown + 1))


def common_blocks(rows: DataFrame, least: int = PAGES) -> DataFrame:
    """(b): numbers of the blocks that `least` distinct pages of a host have, from rows with host, r, tokens and ends."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(b, r) for h, r, t, e in zip(*(batch.column(i).to_pylist() for i in range(4))) for b in set(_block_numbers(h, t or [], e or []))]
            columns = list(zip(*out)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["b", "r"])

    found = rows.select("host", "r", "tokens", "ends").mapInArrow(each, "b long, r long").distinct()
    return staged(found.groupBy("b").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("b"), "pages-blocks")


def _texts(pages: DataFrame, run: int, shown: int, lookup: int, least: int) -> DataFrame:
    """Rows of _page for every page with the places (`at`) and lengths (`long`) of its repeated runs and with the open blocks
    that are `common`, by lookup or, for too many of them, by joins."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    ints = pa.list_(pa.int32())

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_page(u.as_py(), h.as_py()) for u, h in zip(batch.column(0), batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in ((0, pa.string()), (4, ints), (3, ints), (5, pa.int64()))],
                                             names=["host", "tokens", "ends", "r"])

    every = staged(rows.select("url", "html").mapInArrow(streams, "host string, tokens array<int>, ends array<int>, r long"), "pages-streams")
    lengths, common = run_lengths(every, run, shown), common_blocks(every, least)
    few = lengths.count() + common.count() <= lookup
    send = pages.sparkSession.sparkContext.broadcast
    known = send(Runs(lengths if few else lengths.limit(0), run, shown))
    often = send(frozenset(common.toPandas()["b"].tolist()) if few else frozenset())
    schema = (f"page_id {kind}, url string, host string, text string, open array<string>, ends array<int>, tokens array<int>, "
              "at array<int>, long array<int>, common array<int>")
    types = [pa.string(), pa.string(), pa.list_(pa.string()), ints, ints, ints, ints, ints]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_page(u.as_py(), h.as_py())[:5] for u, h in zip(batch.column(1), batch.column(2))]
            found = [(*x, *known.value.places(x[0], x[4]), [i for i, b in enumerate(_block_numbers(x[0], x[4], x[3][:len(x[2])])) if b in often.value])
                     for x in found]
            columns = list(zip(*found)) or [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types))],
                                             names=["page_id", "url", "host", "text", "open", "ends", "tokens", "at", "long", "common"])

    parsed = rows.mapInArrow(read, schema)
    if few:
        return parsed
    parsed = staged(parsed.withColumn("r", F.monotonically_increasing_id()), "pages-read")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(r, i, s) for h, r, t in zip(*(batch.column(i).to_pylist() for i in range(3))) for i, (_, s, _) in enumerate(_suffixes(h, t or [], run, shown))]
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64()))], names=["r", "pos", "s"])

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(r, i, b) for h, r, t, e, o in zip(*(batch.column(i).to_pylist() for i in range(5)))
                   for i, b in enumerate(_block_numbers(h, t or [], (e or [])[:len(o or [])]))]
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64()))], names=["r", "i", "b"])

    runs = parsed.select("host", "r", "tokens").mapInArrow(places, "r long, pos int, s long").join(lengths, "s").groupBy("r").agg(
        F.array_sort(F.collect_list(F.struct("pos", "length"))).alias("runs")).select("r", F.col("runs.pos").alias("at"), F.col("runs.length").alias("long"))
    marked = parsed.select("host", "r", "tokens", "ends", "open").mapInArrow(numbers, "r long, i int, b long").join(common, "b", "leftsemi").groupBy("r").agg(
        F.collect_list("i").alias("common"))
    return parsed.drop("at", "long", "common").join(runs, "r", "left").join(marked, "r", "left")


def op5_main_text(pages: DataFrame, run: int = RUN, shown: int = SHOWN, lookup: int = LOOKUP, least: int = PAGES) -> DataFrame:
    """One row per page: its main text, its length in code points, and how many tokens outside the container repeat.

    A null or empty page has an empty text. Addresses without a host share one host. Every row gives a row; rows of one host
    with equal tokens are one page where pages are counted. Other columns are not read.
    """
    rows = _texts(pages, run, shown, lookup, least).select("page_id", "url", "text", "open", "ends", "at", "long", "common")
    kind = rows.schema["page_id"].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, repeated = [], []
            for text, undecided, ends, at, long, common in zip(*(batch.column(i) for i in range(2, 8))):
                text, reach, common = text.as_py(), dict(zip(at.as_py() or (), long.as_py() or ())), set(common.as_py() or ())
                n = last = 0
                for p, length in reach.items():
                    n += max(0, p + length - max(p, last))
                    last = max(last, p + length)
                repeated.append(n)
                if text is None:
                    undecided, ends = undecided.as_py() or [], ends.as_py() or []
                    kept = [t for i, (t, a, b) in enumerate(zip(undecided, [0, *ends], ends)) if i not in common or not _covered(a, b, reach, shown)]
                    text = "\n".join(kept or undecided)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()),
                                              pa.array(repeated, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_repeated"])

    return rows.mapInArrow(finish, f"page_id {kind}, url string, text string, n_chars long, n_repeated long")
