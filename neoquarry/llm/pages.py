"""Main text of web pages by differencing pages with their nearest neighbours.

Pages are sorted by host and URL path; a page's partner is, of the pages before and after it on its host that hold
something else, the one whose path has more in common with its own. Neighbouring pages with equal lines are one run with
one partner, whatever tasks it lies in: the page before its first or the page after its last. The lines of the two pages (texts of blocks) are
aligned by a longest common subsequence, and what both share is template: it is deleted. A line inside an element that
declares the article is kept even if both pages have it: two articles may well hold the same sentence. Elements that
declare themselves as something else (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments)
are left out, since they often differ from page to page and no alignment finds them.

The sort is a range shuffle of narrow rows (line hashes, no text), so a host with a third of all pages is spread over
many tasks; what a run meets across borders between tasks comes from the first and last run of each.
"""

from __future__ import annotations

import html
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Run, settled

# Names of HTML elements and of their roles.
RAW = frozenset("script style noscript template title textarea iframe object select".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot"
    " th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BESIDE = frozenset("nav footer aside form dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert".split())
ARTICLE = frozenset(("article", "main"))
# words of class and id names that mark what is not the article, inside it and outside it
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr"
    " comment comments disqus sidebar newsletter subscribe subscription share sharing social related recommended nav"
    " navbar navigation menu breadcrumb breadcrumbs footer popup modal overlay notice banner widget reply replies respond"
    " responses".split()
)
OUTSIDE_MARKS = MARKS | {"header", "masthead", "topbar", "toolbar", "login", "search"}
# words that may stand beside a mark in a name: they say where the element is or that it holds something
HOLDERS = frozenset("slot box bar block container wrapper wrap area section list links unit panel site main page top bottom thread".split())
# elements whose class and id names say nothing about what they hold; the same goes for the outermost article
PAGE = frozenset(("html", "body", "main"))

_OPENER = re.compile(r"<(?:!--|[!?]|(/?)[A-Za-z])")
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN = r"""[^>"']*+"""
_NAME = r"[^\s/>]*+"
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")


class Tags:
    """The tags and comments of a page, in order. A tag ends at the first ``>`` outside quotes; one that never does is text.

    What has been read in vain is not read again: quotes that lead to no end, and the way to the next quote.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">") + 1
        self.final = {c: page.rfind(c) for c in "\"'"}
        self.vain: set[int] = set()
        self.broken = False  # from the first tag that never ends, what was read is remembered
        self.plain, self.name = Run(_PLAIN), Run(_NAME)

    def _end(self, at: int) -> int:
        """Where the attributes that begin here end, or -1."""
        tried = []
        while True:
            at = self.plain.end(self.page, at)
            if at >= self.last or at in self.vain:
                break
            quote = self.page[at]
            if quote == ">":
                return at
            tried.append(at)
            if at >= self.final[quote]:
                break
            at = self.page.find(quote, at + 1) + 1
        self.vain.update(tried)
        return -1

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """The next one from here: its start, its end, ``/`` of a closing tag, its name (none of a comment), its attributes."""
        page = self.page
        while match := _OPENER.search(page, at):
            start, at = match.start(), match.end()
            if match[0] == "<!--":
                end = page.find("-->", at)
                return start, len(page) if end < 0 else end + 3, "", "", ""
            if at > self.last:
                # no tag ends behind here, but a comment may begin
                at = page.find("<!--", at)
                if at < 0:
                    return None
            elif match[1] is None:
                return start, page.find(">", at) + 1, "", "", ""
            elif not self.broken and (tag := _TAG.match(page, start)):
                return start, tag.end(), tag[1], tag[2].lower(), tag[3]
            else:
                self.broken = True
                name = self.name.end(page, at)
                end = self._end(name)
                if end >= 0:
                    return start, end + 1, match[1], page[at - 1 : name].lower(), page[name:end]
                at = start + 1
        return None


class Block:
    """A line of a page: its text and where it stands."""

    __slots__ = ("text", "article", "beside")

    def __init__(self, text: str, article: bool, beside: bool):
        self.text, self.article, self.beside = text, article, beside


def blocks_of(page: str) -> list[Block]:
    """The texts of a page's blocks, in order; broken markup is read as far as it goes."""
    out: list[Block] = []
    # open elements that matter: name, depth of declared articles (1 main, 2 article), not the article, innermost mark
    stack: list[tuple[str, int, bool, list | None]] = []
    # class and id marks in the order of their elements: whether it holds, the mark around it, whether any of these holds
    marks: list[list] = []
    # marks around articles inside a main; those around the outermost declared elements are taken back at once
    within: list[list] = []
    marked: list[list | None] = []
    piece: list[str] = []
    opened: Counter[str] = Counter()
    tags, at = Tags(page), 0

    def close() -> None:
        text = " ".join(html.unescape("".join(piece)).split())
        if text:
            _, article, beside, mark = stack[-1] if stack else ("", 0, False, None)
            out.append(Block(text, article > 0, beside))
            marked.append(mark)
        piece.clear()

    def add(text: str) -> None:
        if text:
            piece.append(text)

    while tag := tags.after(at):
        start, stop, closing, name, attributes = tag
        add(page[at:start])
        at = stop
        if not name:
            continue
        if not closing and name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at) if not attributes.endswith("/") else None
            if end:
                at = end.end()
            elif not attributes.endswith("/"):
                at = len(page)
            piece.append(" ")
            continue
        if name == "br":
            piece.append(" ")
        if name in BLOCKS:
            close()
        if name in VOID:
            continue
        if closing:
            if opened[name]:
                if piece and name not in BLOCKS:
                    close()
                while stack[-1][0] != name:
                    opened[stack.pop()[0]] -= 1
                opened[stack.pop()[0]] -= 1
            continue
        if name in BLOCKS and stack and stack[-1][0] == "p":
            opened[stack.pop()[0]] -= 1
        _, article, beside, mark = stack[-1] if stack else ("", 0, False, None)
        inside = 2 if name == "article" else max(article, int(name == "main"))
        role, named = _apart(attributes, inside > 0)
        apart = beside or name in BESIDE or (name == "header" and not inside) or role
        if name in ARTICLE and article < 2 and not apart:
            if article and mark is not None:
                within.append(mark)
            elif mark is not None:
                _take_back(mark)
        own = mark
        if named and name not in PAGE and (name != "article" or article == 2):
            own = [True, mark, True]
            marks.append(own)
        if name in BLOCKS or apart != beside or own is not mark:
            if name not in BLOCKS:
                close()
            stack.append((name, inside, apart, own))
            opened[name] += 1
    rest = page[at:]
    add(rest[: rest.index("<")] if "<" in rest and re.match(r"</?[A-Za-z!]", rest[rest.index("<") :]) else rest)
    close()
    held = _marked(marks, marked)
    if within and not any(b.article and not b.beside and not m for b, m in zip(out, held)):
        # the marks inside the main would leave nothing of it
        for mark in within:
            _take_back(mark)
        held = _marked(marks, marked)
    for block, mark in zip(out, held):
        block.beside = block.beside or mark
    return out


def _take_back(mark: list | None) -> None:
    while mark is not None and mark[0]:
        mark[0], mark = False, mark[1]


def _marked(marks: list[list], innermost: list[list | None]) -> list[bool]:
    """Whether a mark around it holds, for each block by its innermost one."""
    for mark in marks:
        mark[2] = mark[0] or (mark[1] is not None and mark[1][2])
    return [mark is not None and mark[2] for mark in innermost]


def _apart(attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element's role, and whether a class or id name of it, says that it is not the article."""
    if not attributes.strip():
        return False, False
    named = False
    for match in _NAMES.finditer(attributes):
        key, value = match[1].lower(), (match[2] or match[3] or match[4] or "").lower()
        if key == "role" and value.strip() in ROLES:
            return True, False
        named = named or (key in ("class", "id") and any(_is_mark(name, inside) for name in value.split()))
    return False, named


def _is_mark(name: str, inside: bool) -> bool:
    """Whether a whole name marks: every word of it is a mark or a holder's, one at least a mark."""
    words = _WORDS.findall(name)
    known = MARKS if inside else OUTSIDE_MARKS
    return not known.isdisjoint(words) and all(w in known or w in HOLDERS for w in words)


def hashes_of(blocks: list[Block]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(b.text.encode("utf-8", "surrogatepass")) - (1 << 63) for b in blocks]


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of one longest common subsequence with ``b``."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = {*range(head), *range(len(a) - tail, len(a))}
    # lines that only one of the two has cannot be common
    left, right = set(a[head : len(a) - tail]), set(b[head : len(b) - tail])
    places = [i for i in range(head, len(a) - tail) if a[i] in right]
    rest = [x for x in b[head : len(b) - tail] if x in left]
    _align([a[i] for i in places], rest, places, out)
    return out


def _align(a: list[int], b: list[int], places: list[int], out: set[int]) -> None:
    if not a or not b:
        return
    if len(a) * len(b) > 1 << 28 and len(a) > 1:
        # too many rows of bits to keep: the halves are aligned one after the other
        mid = len(a) // 2
        front = _zeros(_rows(a[:mid], b)[-1] if mid < 64 else _last(a[:mid], b), len(b))
        back = _zeros(_last(a[mid:][::-1], b[::-1]), len(b))
        cut = max(range(len(b) + 1), key=lambda j: front[j] + back[len(b) - j])
        _align(a[:mid], b[:cut], places[:mid], out)
        _align(a[mid:], b[cut:], places[mid:], out)
        return
    rows = _rows(a, b)
    i, j = len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i] >> (j - 1) & 1:
            out.add(places[i])
            j -= 1


def _rows(a: list[int], b: list[int]) -> list[int]:
    """After each line of ``a``, a bit per line of ``b``: zero where the common subsequence grows."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for x in a:
        v = rows[-1]
        u = v & masks.get(x, 0)
        rows.append((v + u | v - u) & full)
    return rows


def _last(a: list[int], b: list[int]) -> int:
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for x in a:
        u = v & masks.get(x, 0)
        v = (v + u | v - u) & full
    return v


def _zeros(v: int, n: int) -> list[int]:
    """How many zeros there are among the first j bits, for every j."""
    out = [0]
    for bit in reversed(format(v, f"0{n}b")) if n else "":
        out.append(out[-1] + (bit == "0"))
    return out


def main_text(blocks: list[Block], partner: list[int] | None) -> str:
    """The blocks of the article: those that are declared, or else those that remain."""
    shared = common_lines(hashes_of(blocks), partner) if partner else set()
    declared = any(b.article and not b.beside for b in blocks)
    kept = [
        b.text for i, b in enumerate(blocks)
        if not b.beside and (b.article if declared else i not in shared)
    ]
    return "\n\n".join(kept)


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def extracted(pages: DataFrame) -> DataFrame:
    """Per page ``page_id``, ``url``, ``text`` and ``n_chars``.

    A null or empty page has an empty text. A null URL counts as an empty one, on a host without a name. Repeated rows
    each give a result row; a page without a neighbour that differs loses no shared lines. Extra columns are ignored,
    an empty table gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("page_key", F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))))
    partners = _partners(rows)
    joined = rows.join(partners, "page_key", "left").select("page_id", "url", "html", "partner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(blocks_of(page), partner) if page else "" for page, partner in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def _partners(rows: DataFrame) -> DataFrame:
    """``page_key`` and the line hashes of the page's partner."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [hashes_of(blocks_of(page)) if page else [] for page in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lines, pa.list_(pa.int64()))], names=["page_key", "host", "path", "lines"])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]*)", 1))
    path = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|#.*$", "")
    narrow = rows.select("page_key", host.alias("host"), path.alias("path"), "html").mapInArrow(read, "page_key long, host string, path string, lines array<bigint>")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = narrow.repartitionByRange(parts, "host", "path", "page_key").sortWithinPartitions("host", "path", "page_key")
    ordered = settled(ordered.withColumn("part", F.spark_partition_id()))
    ends = sorted(ordered.mapInArrow(_ends, f"part int, first {_RUN}, last {_RUN}, second {_ROW}, back {_ROW}").collect(), key=lambda r: r.part)
    before = _carried([(r.first, r.last, r.back) for r in ends])
    turned = lambda run: (run[0], run[1], run[3], run[2])
    after = _carried([(turned(r.last), turned(r.first), r.second) for r in reversed(ends)])[::-1]
    shared = rows.sparkSession.sparkContext.broadcast({r.part: both for r, *both in zip(ends, before, after)})

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, list[int]]] = []

        def settle(start: str, front, end: str, behind) -> Iterator[pa.RecordBatch]:
            # the run in hand, between the path and lines of the pages around it
            around = [(_common_prefix(n[0], path), n[1]) for n, path in ((front, start), (behind, end)) if n is not None]
            if around:
                partner = max(around, key=lambda n: n[0])[1]
                for key in keys:
                    out.append((key, partner))
                    if len(out) >= 4096:
                        yield _paired(out)
                        out.clear()

        run = front = start = None
        keys = array("q")
        for batch in batches:
            for key, host, path, lines, part in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if run is None:
                    start, front = shared.value[part][0]
                elif run[:2] == (host, lines):
                    run = (host, lines, path, part)
                    keys.append(key)
                    continue
                else:
                    same = run[0] == host
                    yield from settle(start, front, run[2], (path, lines) if same else None)
                    start, front = path, (run[2], run[1]) if same else None
                    keys = array("q")
                run = (host, lines, path, part)
                keys.append(key)
        if run is not None:
            yield from settle(start, front, *shared.value[run[3]][1])
        yield _paired(out)

    found = ordered.mapInArrow(pair, "page_key long, partner array<bigint>")
    return found.dropDuplicates(["page_key"])


def _paired(out: list[tuple[int, list[int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([p for _, p in out], pa.list_(pa.int64()))], names=["page_key", "partner"])


_ROW = "struct<host: string, path: string, lines: array<bigint>>"
_RUN = "struct<host: string, lines: array<bigint>, start: string, end: string>"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part its first and last run, the page after the first one and the page before the last one."""
    first = last = second = back = part = None
    for batch in batches:
        for host, path, lines, part in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            if last is not None and (last["host"], last["lines"]) == (host, lines):
                last["end"] = path
                continue
            if last is not None:
                back = {"host": last["host"], "path": last["end"], "lines": last["lines"]}
                second = second or {"host": host, "path": path, "lines": lines}
            last = {"host": host, "lines": lines, "start": path, "end": path}
            first = first or last
    lines = ("lines", pa.list_(pa.int64()))
    run = pa.struct([("host", pa.string()), lines, ("start", pa.string()), ("end", pa.string())])
    row = pa.struct([("host", pa.string()), ("path", pa.string()), lines])
    if last is not None:
        columns = [pa.array([v], k) for v, k in ((part, pa.int32()), (first, run), (last, run), (second, row), (back, row))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "first", "last", "second", "back"])


def _carried(parts: list) -> list[tuple]:
    """For the first run of each part where it starts, maybe parts before, and path and lines of the page before it.

    A part is its first run, its last run and the page before the last one (null where both are one run).
    """
    out, held = [], None
    for (host, lines, start, end), last, back in parts:
        before = None
        if held is not None and held[0] == host:
            start, before = (held[3], held[4]) if held[1] == lines else (start, (held[2], held[1]))
        out.append((start, before))
        if back is None:
            held = (host, lines, end, start, before)
        else:
            held = (last[0], last[1], last[3], last[2], (back[1], back[2]) if back[0] == last[0] else None)
    return out
