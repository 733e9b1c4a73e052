"""Operator 7: main text of web pages by differencing pages with near URLs.

1. A page is cut into lines, one for each block: character references decoded, white space turned into one space, trimmed. Scripts, styles, forms, comments in the
   markup and hidden parts give no lines. A line knows whether it stands in a container of the article (``article``, ``main`` or an element
   that is named so) and whether it stands in a part that is furniture by its element, role, class or id (menus, headers, footers, sidebars, notices,
   adverts, reader comments), and which share of it is link text. Names count less than content: a name that tells a state, a facet or a layout (``has-comments``, ``no-sidebar``, ``category-notices``)
   tells nothing, and an element that holds the page's article, or most of its paragraphs where none stands elsewhere, is no furniture whatever it is named.
2. Pages of a host are ordered by folder and path of the URL (without www., scheme, query, fragment, closing slash and extension); every page is paired with the
   pages before and after it. All lines of a pair are aligned by longest common subsequence, and lines that both share are deleted: they are the site's,
   not the page's. Pages whose lines outside furniture are all equal are copies of each other and tell nothing, and so is a page alone on its host.
3. An ``article`` guards single lines: those in its paragraphs, headings, lists, tables and quotes (``PROSE``) that aren't mostly links stay even if a neighbour has them too,
   since such elements show that they are the article's. What is left of the page, without lines of furniture that only this page has, is the text; if the page has an article
   (or else a looser container), without what stands outside it; if it has none, without lines made of links alone.

A page is parsed once. Its lines' hashes and the lines that may be its text are shuffled once, to ranges of the URL order, and a task walks through a sorted
range, so it holds three pages at a time. Ranges are cut at keys that are picked by their hash; rows next to a cut are copied (hashes alone) to the range on
its other side, so no pair is lost. Rows that are equal in all columns are counted before the shuffle.
Results: one row per page. Null and empty pages have an empty text; pages with a null or unreadable URL pair with each other; ties of the URL are ordered by page_id and
a hash of the row; repeated rows repeat their results; a very long page is one row, whose alignment takes linear space; an empty table gives an empty table. Further columns are not kept,
whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pages of a range, about; keys that are picked for a range; keys at most (they are broadcast).
PART, FINE, PICKED = 250, 8, 1 << 18
#: Equal rows that are written at a time.
REPEAT = 20
#: Cells of an alignment's table at most; beyond it, the lines of one page are halved until each half's table has no more.
CELLS = 4_000_000

# Elements by their role in a page, and the names of furniture and of containers.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header head hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
SPACES = frozenset("br td th wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template textarea title svg math iframe object canvas audio video select datalist".split())
FURNITURE = frozenset("head nav aside form footer button dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "sidebar side aside widget widgets related recommended share sharing social breadcrumb breadcrumbs menu nav navbar navigation pager pagination toolbar masthead "
    "comment comments commentlist respond reply replies responses discussion disqus newsletter subscribe subscription signup login search footer copyright legal skip hidden".split()
)
CONTAINERS = frozenset("article post entry content main story maincontent postbody articlebody".split())
# Elements that show, in an article, that a line is the article's.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt tr table caption figcaption".split())
# Names of the article's own head or foot: furniture only outside it.
EDGES = frozenset("header footer".split())
# Names of what readers wrote: never the text only because it is most of a page.
READERS = frozenset("comment comments commentlist respond reply replies responses discussion disqus".split())
# Words that make a name tell how an element is or looks, not what it is: anywhere in the name, as its first word, as its last.
STATES = frozenset("has have no not with without is can show hide hides".split())
FACETS = frozenset("category categories cat tag tags topic type format status".split())
ENDINGS = frozenset("enabled disabled supported open opened closed off none layout template".split())
# What an element that its name alone calls furniture may hold, to be none: 2 an article or a main element, 1 an element named as a container.
STRONG, LOOSE = 2, 1

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


def _tells(words: list[str], names: frozenset[str]) -> bool:
    """Whether a name of these words says that its element is one of ``names``: it has such a word, and none that makes it a state, a facet or a layout."""
    if not any(w in names for w in words) or (len(words) > 1 and (words[0] in FACETS or words[-1] in ENDINGS)):
        return False
    return not any(w in STATES for w in words)


def _flags(tag: str, attributes: str, inside: int) -> tuple[bool, int, int, int]:
    """Whether an element is furniture for certain; by its name (1, 2 readers' comments, 3 a form, else 0); what it is a container of, 2 an article, 1 perhaps more
    than that, 0 nothing; and how sure its content is the text (``STRONG``, ``LOOSE``, 0). ``inside``: what it stands in."""
    drop = (tag in FURNITURE and tag != "form") or (tag == "header" and not inside)
    soft = 3 if tag == "form" else 0
    hold = 2 if tag == "article" else int(tag == "main")
    core = STRONG if hold else 0
    if "=" not in attributes and "hidden" not in attributes:
        return drop, soft, hold, core
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in got or got.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", "")):
        return True, 0, 0, 0
    if tag in ("html", "body"):
        return drop, soft, hold, core
    if got.get("role", "").lower() in ROLES:
        drop = True
    for value in (got.get("class", ""), got.get("id", "")):
        for name in value.split():
            words = _NAME.findall(_CAMEL.sub(r"\1-\2", name).lower())
            if not words:
                continue
            if _tells(words, NAMES) or (not inside and not hold and _tells(words, EDGES)):
                if not (hold and words[-1] in CONTAINERS):
                    soft = max(soft, 2 if any(w in READERS for w in words) else 1)
            elif words[-1] in CONTAINERS or "".join(words) in CONTAINERS:
                hold = max(hold, int(tag in ("div", "section", "td")))
    if got.get("itemprop") == "articleBody" or got.get("role") == "article":
        hold, core = 2, STRONG
    elif got.get("role") == "main":
        hold, core = max(hold, 1), STRONG
    return drop, soft, hold, 0 if drop or soft else max(core, min(hold, LOOSE))


class Elements:
    """The elements of a page that make lines or take them away, in page order: each after the one that it stands in."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, bool, int, int, int]] = [(0, False, 0, 0, 0)]  # element around it, certain, by name, container, core
        self.prose: list[int] = [0]  # characters of its own paragraphs that aren't mostly links

    def add(self, around: int, flags: tuple[bool, int, int, int]) -> int:
        self.rows.append((around, *flags))
        self.prose.append(0)
        return len(self.rows) - 1

    def spared(self) -> set[int]:
        """Elements that their names alone call furniture, but that hold the text. If an element sure to be the text stands outside all furniture, there are none. Else, of
        those in no certain furniture, the surest with the longest prose (readers' comments last) is the text, if it is an article or main element or has most of the page's prose, and so is what has most of
        the page's prose itself, if it is no form and not what readers wrote; elements around the text are spared."""
        if not any(soft for _, _, soft, _, _ in self.rows):
            return set()
        n = len(self.rows)
        sure, named, readers, prose = [False] * n, [False] * n, [False] * n, list(self.prose)
        for k, (around, drop, soft, _, _) in enumerate(self.rows):
            sure[k], named[k], readers[k] = drop or (k > 0 and sure[around]), bool(soft) or (k > 0 and named[around]), soft == 2 or (k > 0 and readers[around])
            if sure[k]:
                prose[k] = 0
        for k in range(n - 1, 0, -1):
            prose[self.rows[k][0]] += prose[k]
        cores = [(core, not readers[k], prose[k], -k) for k, (*_, core) in enumerate(self.rows) if core and not sure[k] and prose[k]]
        clean = [c for c in cores if not named[-c[-1]]]
        if any(self.rows[-c[-1]][3] == 2 or 2 * c[2] > prose[0] for c in clean):
            return set()
        least = max((c[0] for c in clean), default=0)
        inner = [-max((c for c in cores if c[0] > least and (c[0] == STRONG or 2 * c[2] > prose[0])), default=(0,))[-1]]
        inner += [k for k, (_, _, soft, _, _) in enumerate(self.rows) if soft == 1 and not sure[k] and 2 * prose[k] > prose[0]]
        out = set()
        for k in inner:
            while k and k not in out:
                if self.rows[k][2]:
                    out.add(k)
                k = self.rows[k][0]
        return out

    def resolved(self) -> tuple[list[bool], list[int]]:
        """Of each element whether it stands in furniture, and the container that it stands in."""
        spared, drops, holds = self.spared(), [False], [0]
        for k in range(1, len(self.rows)):
            around, drop, soft, hold, _ = self.rows[k]
            drop = drop or (soft > 0 and k not in spared)
            drops.append(drop or drops[around])
            holds.append(max(holds[around], 0 if drop else hold))
        return drops, holds


Line = tuple[str, int, bool, float, bool]


def lines_of(page: str) -> list[Line]:
    """(text, container, furniture, share of link text, whether it stands in an element of ``PROSE``) of each block with text, in page order."""
    found: list[tuple[str, int, float, bool]] = []
    elements = Elements()
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # element, its place among ``elements``, container so far
    parts: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            tag, at_element, _ = stack[-1]
            link = min(1.0, linked / (len(text) - text.count(" ")))
            found.append((text, at_element, link, tag in PROSE))
            if tag in PROSE and link < 0.5:
                elements.prose[at_element] += len(text)
        linked = 0

    at = 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                parts.append(text)
                if links:
                    linked += sum(map(len, text.split()))
            elif text.startswith("<![CDATA["):
                parts.append(text[9:].removesuffix("]]>"))
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag == "body" and not closing and (head := next((k for k in range(1, len(stack)) if stack[k][0] == "head"), 0)):
            del stack[head:]  # a head that isn't closed
        if tag in BLOCKS:
            flush()
        elif tag in SPACES:
            parts.append(" ")
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            top = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if top and not (tag not in BLOCKS and any(stack[k][0] in BLOCKS for k in range(top + 1, len(stack)))):
                del stack[top:]
            continue
        if tag in SILENT:
            if not attributes.rstrip().endswith("/"):  # what it holds is no markup: on to its end
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in VOID:
            continue
        if tag in ("p", "li", "dd", "dt", "tr", "option"):  # such an element ends where the next begins
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS and stack[k][0] not in ("p", "li", "dd", "dt", "tr", "option"):
                    break
        elif tag in BLOCKS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
        if tag == "a":
            links += 1
            continue
        _, around, hold = stack[-1]
        flags = _flags(tag, attributes, hold)
        if tag in BLOCKS or flags[0] or flags[1]:
            stack.append((tag, elements.add(around, flags), max(hold, 0 if flags[0] else flags[2])))
    flush()
    drops, holds = elements.resolved()
    return [(text, holds[k], drops[k], link, prose) for text, k, link, prose in found]


def common(a: list[str], b: list[str]) -> np.ndarray:
    """Which of the lines ``a`` are in a longest common subsequence with ``b``."""
    keep = np.zeros(len(a), bool)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        keep[lo] = True
        lo += 1
    ra, rb = len(a), len(b)
    while ra > lo and rb > lo and a[ra - 1] == b[rb - 1]:
        ra, rb = ra - 1, rb - 1
        keep[ra] = True
    code: dict[str, int] = {}
    x = np.array([code.setdefault(t, len(code)) for t in a[lo:ra]], np.int64)
    y = np.array([code.setdefault(t, len(code)) for t in b[lo:rb]], np.int64)
    at = np.flatnonzero(np.isin(x, y))
    y = y[np.isin(y, x)]
    x = x[at]
    if not len(x):
        return keep
    keep[lo + at[_longest(x, y)]] = True
    return keep


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``x`` and each beginning of ``y``: a row of the table as bits of one number."""
    n = len(y)
    ones = (1 << n) - 1
    masks = {}
    for v in np.unique(x).tolist():
        masks[v] = int.from_bytes(np.packbits(y == v, bitorder="little").tobytes(), "little")
    row = ones
    for v in x.tolist():
        both = row & masks[v]
        row = ((row + both) | (row - both)) & ones
    steps = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n] == 0
    return np.concatenate([[0], np.cumsum(steps)])


def _longest(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places in ``x`` of a longest common subsequence with ``y``, in linear space (Hirschberg)."""
    if len(x) > 1 and len(x) * len(y) > CELLS:
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        return _longest(x[:half], y[:cut]) + [half + i for i in _longest(x[half:], y[cut:])]
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x)):
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + (y == x[i])))
    out = []
    i, j = len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def shared_lines(own: list, neighbours: Iterable[list]) -> np.ndarray:
    """Which of a page's lines (or their hashes) are the site's: in a longest common subsequence with a neighbour (of those that are no copies)."""
    shared = np.zeros(len(own), bool)
    for other in neighbours:
        shared |= common(own, other)
    return shared


def candidates(lines: list[Line]) -> tuple[list[int], list[bool]]:
    """The lines that may be a page's text, and which of them an article guards against deletion."""
    hold = max((x[1] for x in lines if not x[2]), default=0)
    some = [i for i, (_, h, drop, link, _) in enumerate(lines) if not drop and h >= hold and (hold or link < 0.9)]
    return some, [hold == 2 and lines[i][4] and lines[i][3] < 0.5 for i in some]


def joined(texts: Iterable[str]) -> str:
    return "\n\n".join(texts)


def kept(some: list[int], guarded: list[bool], gone: np.ndarray) -> list[bool]:
    """Which candidates are left of a page whose lines ``gone`` are shared."""
    return [g or not gone[i] for i, g in zip(some, guarded, strict=True)]


def main_text(own: list[Line], neighbours: Iterable[list[Line]]) -> str:
    """The text of one page, given its neighbours."""
    body = lambda lines: [x[0] for x in lines if not x[2]]
    gone = shared_lines([x[0] for x in own], [[x[0] for x in other] for other in neighbours if body(other) != body(own)])
    some, guarded = candidates(own)
    return joined(own[i][0] for i, k in zip(some, kept(some, guarded, gone), strict=True) if k)


def _line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def row_key(*columns: str) -> Column:
    """A 16-byte hash of a row; null and empty differ."""
    return F.unhex(F.md5(F.concat_ws("\x00", *(F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns))))


def with_key(pages: DataFrame) -> DataFrame:
    """Adds ``key``: host, folder, path, page_id and url, so that its order is the order of near URLs and its beginning up to the first \\0 is the host."""
    rest = F.regexp_replace(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://|[?#].*$|\x00", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/]*)", 1), r"^(?:www|m)\.|:\d+$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/]*(.*)$", 1), r"(?:\.[a-z]{2,5})?/*$", "")
    kind = pages.schema["page_id"].dataType.simpleString()
    number = F.lpad((F.col("page_id").cast("decimal(20,0)") + F.expr("9223372036854775808BD")).cast("decimal(20,0)").cast("string"), 20, "0")
    page = number if kind in ("tinyint", "smallint", "int", "bigint") else F.col("page_id").cast("string")
    return pages.withColumn("key", F.concat_ws("\0", host, F.regexp_replace(path, r"[^/]*$", ""), path, F.coalesce(page, F.lit("")), F.coalesce("url", F.lit(""))))


def picked_keys(pages: DataFrame) -> list[str]:
    """Keys of about every ``PART / FINE``-th page, in order, ``PICKED`` or so at most; each is a key of the table."""
    keys = with_key(pages.select("page_id", "url")).select("key")
    step = max(1, PART // FINE, -(-keys.count() // PICKED))
    return sorted(r[0] for r in keys.filter(F.pmod(F.xxhash64("key"), F.lit(step)) == 0).distinct().toLocalIterator())


def ranges_of(key: str, picked: list[str]) -> list[tuple[int, bool]]:
    """(range, whether the row is its own) of a key. A range begins at every ``FINE``-th picked key; it also gets the rows from the picked key before its beginning on, and those at its end."""
    at = bisect.bisect_right(picked, key)  # picked keys up to this one
    own = at // FINE
    out = [(own, True)]
    if at % FINE == FINE - 1 and own < len(picked) // FINE:
        out.append((own + 1, False))
    if own and picked[own * FINE - 1] == key:
        out.append((own - 1, False))
    return out


_TEXTS, _FLAGS, _PLACES, _HASHES = pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int64())


def parsed(pages: DataFrame, picked: list[str]) -> DataFrame:
    """range, key, row (a hash of the row), page_id, url, times, hashes (of all lines), body (a hash of the lines outside furniture), texts, places and guarded (of the candidates).

    Copies for a neighbouring range have ``times`` 0 and no texts. Rows of a batch that are equal in all columns are one, ``times`` their number."""
    shared = pages.sparkSession.sparkContext.broadcast(picked)
    names = ["range", "key", "row", "page_id", "url", "times", "hashes", "body", "texts", "places", "guarded"]
    kinds = [pa.int32(), None, None, None, None, pa.int64(), _HASHES, pa.int64(), _TEXTS, _PLACES, _FLAGS]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                keys, rows = part.column(0).to_pylist(), part.column(1).to_pylist()
                times: dict[bytes, int] = {}
                for r in rows:
                    times[r] = times.get(r, 0) + 1
                take, made = [], []
                for i, (key, row) in enumerate(zip(keys, rows, strict=True)):
                    n = times.pop(row, 0)
                    if not n:
                        continue
                    lines = lines_of(part.column(4)[i].as_py() or "")
                    hashes, body = [_line_hash(x[0]) for x in lines], _line_hash("\n".join(x[0] for x in lines if not x[2]))
                    some, guarded = candidates(lines)
                    for to, own in ranges_of(key, shared.value):
                        take.append(i)
                        made.append((to, n, hashes, body, [lines[k][0] for k in some], some, guarded) if own else (to, 0, hashes, body, None, None, None))
                where = pa.array(take, pa.int64())
                given = [part.column(k).take(where) for k in range(4)]
                new = [pa.array([x[k] for x in made], t) for k, t in enumerate(t for t in kinds if t is not None)]
                yield pa.RecordBatch.from_arrays([new[0], *given, *new[1:]], names)

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = with_key(pages.select("page_id", "url", "html")).select("key", row_key("page_id", "url", "html").alias("row"), "page_id", "url", "html")
    schema = f"range int, key string, row binary, page_id {kind}, url string, times long, hashes array<long>, body long, texts array<string>, places array<int>, guarded array<boolean>"
    return rows.mapInArrow(run, schema)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared (lines that were deleted since a page of a near URL has them too)."""
    rows = parsed(pages, picked_keys(pages)).repartition("range").sortWithinPartitions("range", "key", "row")

    def near(row: tuple, other: tuple | None) -> bool:
        return other is not None and other[:2] == row[:2] and other[7] != row[7]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the row before the held one
        held: tuple | None = None
        done: list[tuple] = []
        size = 0

        def finish(after: tuple | None) -> None:
            nonlocal size
            _, _, _, page, url, times, hashes, _, texts, places, guarded = held
            gone = shared_lines(hashes, [x[6] for x in (last, after) if near(held, x)])
            text = joined(t for t, k in zip(texts, kept(places, guarded, gone), strict=True) if k)
            n = int(gone.sum()) - sum(bool(g and gone[p]) for p, g in zip(places, guarded, strict=True))
            done.append((page, url, text, n, times))
            size += len(text) * min(times, REPEAT)

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal size
            rows = [x for *x, times in done for _ in range(min(times, REPEAT))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], names)
            for *x, times in done:  # the rest of rows that are repeated often
                for at in range(REPEAT, times, REPEAT):
                    yield pa.RecordBatch.from_arrays([pa.array([v] * min(REPEAT, times - at), t) for v, t in zip(x, types, strict=True)], names)
            done.clear()
            size = 0

        names, types = ["page_id", "url", "text", "n_shared"], []
        for b in batches:
            types = [b.schema.field("page_id").type, pa.string(), pa.string(), pa.int64()]
            for at in range(0, b.num_rows, 100):
                columns = [b.column(k).slice(at, 100).to_pylist() for k in range(11)]
                for to, key, digest, *rest in zip(*columns, strict=True):
                    row = (to, key.split("\0", 1)[0], digest, *rest)
                    if held is not None and held[:3] == row[:3]:  # equal in all columns
                        held = (*held[:5], held[5] + row[5], *held[6:])
                        continue
                    if held is not None and held[5]:
                        finish(row)
                    last, held = held, row
                if size > 4_000_000 or len(done) > 2000:
                    yield from out()
        if held is not None and held[5]:
            finish(None)
        if done:
            yield from out()

    kind = pages.schema["page_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_shared long")
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_shared")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
