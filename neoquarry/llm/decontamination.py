"""Benchmark decontamination: token windows looked up in a broadcast hash set of benchmark n-grams.

Every run of ten words of a benchmark item is a window (an item of fewer words is one window). The windows go to
the executors as a sorted hash array with the words behind each hash. A document's words become numbers (words the
benchmark does not hold become nothing), each of its windows is hashed in one vector pass, hashes found in the array
are verified word by word, and the words of verified windows are hit.

The broadcast has a bound: ``max_windows`` distinct windows. A larger benchmark is dealt by hash into as many parts as
the bound asks for; each part is broadcast to a scan of its own, and the hits are put together per document, so that
the result is the same for every number of parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, letter_words, settled, window_hashes, with_nulls_as_empty

WINDOW = 10
MAX_WINDOWS = 500_000


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``window`` (words joined by a space) and ``items`` (sorted distinct ids, null ids left out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, windows = [], []
            texts = with_nulls_as_empty(batch.column(1).cast(pa.binary()).to_pylist())
            for item, value in zip(batch.column(0).to_pylist(), texts):
                words = letter_words(value)
                for i in range(max(1, len(words) - size + 1) if words else 0):
                    ids.append(item)
                    windows.append(b" ".join(words[i : i + size]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(windows, pa.binary())], names=["item", "window"])

    rows = benchmark.select(F.col(item_id).cast("long"), F.col(text).cast("string")).mapInArrow(lean(run), "item long, window binary")
    return rows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


class WindowSet:
    """The windows of one part, ready for lookups."""

    def __init__(self, windows: list[tuple[bytes, list[int]]]):
        self.ids: dict[bytes, int] = {}
        by_size: dict[int, list] = {}
        for window, items in windows:
            words = window.split(b" ")
            numbers = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            by_size.setdefault(len(words), []).append((numbers, items))
        self.by_size = {}
        for size, found in by_size.items():
            table = np.array([n for n, _ in found], dtype=np.uint64)
            hashes = np.array([int(window_hashes(row, size)[0]) for row in table], dtype=np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.by_size[size] = (hashes[order], table[order], [found[i][1] for i in order])

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.ids.get
        return np.fromiter([get(w, 0) for w in words], dtype=np.uint64, count=len(words))

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the items with a window here."""
        hit = np.zeros(len(numbers), dtype=bool)
        items: set[int] = set()
        # only runs of known words long enough can hold a window
        known = np.concatenate(([0], np.cumsum(numbers != 0)))
        for size, (hashes, table, owners) in self.by_size.items():
            if len(numbers) < size:
                continue
            starts = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(starts):
                continue
            own = window_hashes_at(numbers, starts, size)
            left, right = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            for at in np.flatnonzero(left < right):
                words = numbers[starts[at] : starts[at] + size]
                for row in range(left[at], right[at]):
                    if np.array_equal(table[row], words):
                        hit[starts[at] : starts[at] + size] = True
                        items.update(owners[row])
        return hit, items


def window_hashes_at(numbers: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """``window_hashes`` at the given starts only."""
    if len(starts) * 4 > len(numbers):
        return window_hashes(numbers, size)[starts]
    return window_hashes(numbers[starts[:, None] + np.arange(size)].T.copy(), size)[0] if len(starts) else starts.astype(np.uint64)


def _parts(benchmark: DataFrame, size: int, max_windows: int, item_id: str, text: str) -> tuple[DataFrame, int]:
    windows = settled(benchmark_windows(benchmark, size, item_id, text))
    return windows, max(1, -(-windows.count() // max_windows))


def _part(windows: DataFrame, part: int, parts: int) -> WindowSet:
    """One part of the windows, at most about ``max_windows`` of them, on its way into a broadcast."""
    mine = windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part)
    return WindowSet([(bytes(r["window"]), list(r["items"])) for r in mine.toLocalIterator()])


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_hit``, ``items`` (sorted), ``spans`` (hit runs of words, end exclusive).

    A null text has no words; an empty benchmark hits nothing; a benchmark item without words has no window, and one
    with a null id hits words but is not listed. Repeated rows each give a result row. Extra columns are ignored.
    """
    windows, parts = _parts(benchmark, size, max_windows, item_id, text)
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    if parts > 1:
        # parts come together by row, not by id, which may repeat: the rows are numbered once
        rows = settled(rows.withColumn("row", F.monotonically_increasing_id())).select(*rows.columns, "row")
    found = None
    for part in range(parts):
        shared = sc.broadcast(_part(windows, part, parts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                sizes, spans, items = [], [], []
                for value in with_nulls_as_empty(batch.column(1).cast(pa.binary()).to_pylist()):
                    numbers = index.numbers(letter_words(value))
                    hit, owners = index.hits(numbers)
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                    sizes.append(len(numbers))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                    items.append(sorted(owners))
                columns = [batch.column(0), pa.array(sizes, pa.int64())]
                columns += [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.int64()))]
                names = ["doc_id", "n_words", "spans", "items"]
                if batch.num_columns > 2:
                    columns.append(batch.column(2))
                    names.append("row")
                yield pa.RecordBatch.from_arrays(columns, names=names)

        schema = "doc_id long, n_words long, spans array<struct<start: bigint, end: bigint>>, items array<bigint>"
        one = rows.mapInArrow(lean(run), schema + (", row long" if parts > 1 else ""))
        found = one if found is None else found.union(one)
    if parts > 1:
        found = found.groupBy("row", "doc_id", "n_words").agg(
            F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        )
        found = found.withColumn("spans", merged_spans(F.array_sort("spans")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans")


def merged_spans(spans):
    """Sorted spans, overlapping or touching ones put together."""
    empty = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")

    def add(acc, s):
        last = F.element_at(acc, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        joins = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"])
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, empty, add)


def decontaminated(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", size: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents without contaminated ones (``documents``), or with hit words cut from the text (``spans``).

    Cutting removes a hit run from its first word's first to its last word's last character; what lies between words
    that stay is kept. All columns stay; with ``spans`` a column ``n_chars`` follows the new text. Null texts stay null.
    """
    windows, parts = _parts(benchmark, size, max_windows, "item_id", "text")
    sc, out = docs.sparkSession.sparkContext, docs
    for part in range(parts):
        shared = sc.broadcast(_part(windows, part, parts))
        place, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                values = batch.column(place).cast(pa.binary()).to_pylist()
                hits = [index.hits(index.numbers(letter_words(v)))[0] if v else np.zeros(0, bool) for v in values]
                if mode == "documents":
                    yield batch.filter(pa.array([not h.any() for h in hits], pa.bool_()))
                    continue
                new = [cut(v, h).decode() if h.any() else v if v is None else v.decode() for v, h in zip(values, hits)]
                batch = batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))
                if chars is not None:
                    old = batch.column(chars).to_pylist()
                    sizes = [len(n) if h.any() else o for n, h, o in zip(new, hits, old)]
                    batch = batch.set_column(chars, batch.schema.field(chars), pa.array(sizes, batch.schema.field(chars).type))
                yield batch

        out = out.mapInArrow(lean(run), docs.schema)
    return out


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut(text: bytes, hit: np.ndarray) -> bytes:
    """The text without the runs of hit words, from the first to the last character of each run."""
    places = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).reshape(-1, 2)
    out, last = [], 0
    for first, end in edges:
        out.append(text[last : places[first][0]])
        last = places[end - 1][1]
    return b"".join(out) + text[last:]


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query, from the operator's result."""
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )

