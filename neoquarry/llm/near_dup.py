"""Near-duplicate groups by a multi-index Hamming join over b-bit MinHash signatures.

A document's set is its distinct word shingles; two documents are linked when the Jaccard similarity of their sets
reaches a threshold. Equal sets fall into one class first. A class carries K MinHash symbols of 16 bits. The symbols
are cut into m chunks of four. By the pigeonhole principle two signatures that differ in at most 2m - 1 symbols have
a chunk with at most one difference, so the index holds, for every chunk, the chunk with each of its symbols left
out in turn: every such pair meets under some key. K follows from the threshold: a pair exactly on it exceeds
2m - 1 differences with a probability below 1e-5. Links are confirmed on the full sets.

Groups of any size stay cheap: within a key every class is first compared with one class of the key only, the one
that meets the most others over all its keys (of a group of copies, that is what they were copied from). What is linked
then is one component; a second round does the same among what stays outside the largest component of a key. After
that all pairs of classes that meet under a key and are still in different components are compared, so that no link is
lost, but for those that a bound on the size of their common part rules out: shingles are counted in 1024 hashed bins,
and no more can be common to two sets than the smaller of the two counts in every bin.
Components are found by alternating large and small stars, as joins and grouped minima.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, lean, mixed, settled, space_words, window_hashes, with_nulls_as_empty

CHUNK = 4
BINS = 1024


@dataclass(frozen=True)
class Similarity:
    """Words in a shingle, least similarity in percent, and the chance a pair on the threshold may be missed."""

    words: int = 3
    percent: int = 85
    miss: float = 1e-5

    @property
    def symbols(self) -> int:
        """Length of the signature."""
        q = 1 - self.percent / 100
        k = CHUNK
        while sum(math.comb(k, i) * q**i * (1 - q) ** (k - i) for i in range(self.radius(k) + 1, k + 1)) > self.miss:
            k += CHUNK
        return k

    @staticmethod
    def radius(symbols: int) -> int:
        """Largest number of differing symbols at which a common key is certain."""
        return 2 * (symbols // CHUNK) - 1


def shingle_set(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, one without words none."""
    words = space_words(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(window_hashes(hashes.of(words), min(size, len(words))) + np.uint64(min(size, len(words))))


def signature(shingles: np.ndarray, multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), 4096):
        part = shingles[start : start + 4096]
        np.minimum(least, (multipliers[:, None] * part + offsets[:, None]).min(axis=1), out=least)
    return (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)


def permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return (
        rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
        rng.integers(0, 2**63, k, dtype=np.uint64),
    )


def _node(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def signed(docs: DataFrame, like: Similarity, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``node`` (its class) and ``sig``; node and sig are null without words."""
    size, k = like.words, like.symbols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (mult, off) = WordHashes(), permutations(k)
        for batch in batches:
            counts, nodes, sigs = [], [], []
            for value in with_nulls_as_empty(batch.column(1).cast(pa.binary()).to_pylist()):
                shingles = shingle_set(value, size, hashes)
                counts.append(len(shingles))
                nodes.append(_node(shingles) if len(shingles) else None)
                sigs.append(signature(shingles, mult, off).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "node", "sig"],
            )

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(lean(run), "doc_id long, n_shingles long, node long, sig binary")


def index_keys(classes: DataFrame) -> DataFrame:
    """One row per class and chunk with one symbol left out: ``key``, ``node``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16)
            sig = sig.reshape(batch.num_rows, -1).astype(np.uint64)
            nodes = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
            for place in range(sig.shape[1]):
                chunk = place // CHUNK
                key = np.full(len(sig), place + 1, dtype=np.uint64)
                rest = [sig[:, j] for j in range(chunk * CHUNK, chunk * CHUNK + CHUNK) if j != place]
                packed = sum(x << np.uint64(16 * i) for i, x in enumerate(rest))
                # the place is the key's first byte, so that a pair can tell under which key it meets first
                key = (mixed(packed + key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8)) | np.uint64(place << 56)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.astype(np.int64)), pa.array(nodes, pa.int64())], names=["key", "node"]
                )

    return classes.select("node", "sig").mapInArrow(lean(run), "key long, node long")


def chunks(sig: Column, symbols: int) -> Column:
    """A signature (hex string) as one whole number per chunk, four symbols of 16 bits each."""
    digits = CHUNK * 4
    return F.array(*(F.conv(F.substring(sig, 1 + digits * i, digits), 16, -10).cast("long") for i in range(symbols // CHUNK)))


def first_place(a: str, b: str, symbols: int) -> Column:
    """The first place that two rows of chunks have a common key at; null where they have none."""
    lanes = [0xFFFF << 16 * (CHUNK - 1 - i) for i in range(CHUNK)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    tests = []
    for place in range(symbols):
        differs = F.get(a, F.lit(place // CHUNK)).bitwiseXOR(F.get(b, F.lit(place // CHUNK)))
        rest = signed(~lanes[place % CHUNK] & ((1 << 64) - 1))
        tests.append(F.when(differs.bitwiseAND(F.lit(rest)) == 0, F.lit(place).cast("long")))
    return F.coalesce(*tests)


def differing(a: Column, b: Column) -> Column:
    """Number of 16-bit symbols in which two signatures (hex strings) differ."""
    places = F.sequence(F.lit(0), (F.length(a) / 4).cast("int") - 1)
    return F.aggregate(
        places,
        F.lit(0),
        lambda acc, i: acc + (a.substr(i * 4 + 1, F.lit(4)) != b.substr(i * 4 + 1, F.lit(4))).cast("int"),
    )


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (least node reachable) for every node of the links (``a``, ``b``)."""
    edges = settled(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        edges = settled(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a").cast("long"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def planes(shingles: np.ndarray) -> np.ndarray:
    """Bits of the bins that hold one shingle or more, then of those that hold two or more."""
    counts = np.bincount((shingles % np.uint64(BINS)).astype(np.int64), minlength=BINS)
    return np.concatenate((np.packbits(counts >= 1), np.packbits(counts >= 2))).view(np.int64)


def _sets(docs: DataFrame, members: DataFrame, like: Similarity, doc_id: str, text: str) -> DataFrame:
    """``node``, ``shingles`` and ``planes`` of the classes in ``members`` (``node``, ``first_id``), read from one document of each."""
    size = like.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = with_nulls_as_empty(batch.column(0).cast(pa.binary()).to_pylist())
            for start in range(0, len(texts), 256):
                sets = [shingle_set(t, size, hashes) for t in texts[start : start + 256]]
                sets = [s for s in sets if len(s)]
                many = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.astype(np.int64) for s in sets], many), pa.array([planes(s) for s in sets], many)],
                    names=["node", "shingles", "planes"],
                )

    ids = members.select("first_id").distinct()
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    found = rows.join(ids, F.col("_id").eqNullSafe(F.col("first_id")), "left_semi").select("_text")
    sets = found.mapInArrow(lean(run), "node long, shingles array<bigint>, planes array<bigint>")
    return sets.join(members.select("node"), "node", "left_semi").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, like: Similarity = Similarity(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``component_id`` (least doc_id reachable over links), ``kept``.

    Words are runs without ASCII white space, A-Z lowered. A text with fewer words than a shingle has is one shingle;
    a null or empty text, or one without words, has an empty set and is linked with nothing. Repeated rows fall into
    one class and each gets a result row. A null doc_id counts last: it is a component's id only where the component
    has no other. Extra columns are ignored. An empty table gives an empty result.
    """
    rows = settled(signed(docs, like, doc_id, text))
    # node determines the other two columns; as keys they keep the aggregate in hash form
    classes = (
        rows.where("node is not null").groupBy("node", "n_shingles", "sig").agg(F.min("doc_id").alias("first_id"))
    )
    classes = settled(classes)
    keys = index_keys(classes)
    shared = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    groups = settled(keys.join(shared, "key"))
    roots = _linked(docs, classes, groups, like, doc_id, text)
    least = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")) if roots is not None else classes.withColumn("root", F.col("node"))
    named = least.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_node = least.select("node", "root").join(named, "root").select("node", "component_id")
    narrow = rows.select("doc_id", "n_shingles", "node")
    # rows without words have no class; they would all meet under one null key
    alone = narrow.where("node is null").withColumn("component_id", F.col("doc_id"))
    out = narrow.where("node is not null").join(by_node, "node", "left").unionByName(alone)
    component = F.col("component_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _linked(docs, classes, groups, like, doc_id, text) -> DataFrame | None:
    """``node``, ``root`` of the classes that have links, or None where no two classes share a key."""
    members = groups.groupBy("node").agg(F.sum("members").alias("met"))
    members = settled(members.join(classes, "node"))
    if members.isEmpty():
        return None
    groups = groups.select("key", "node").join(members.select("node", "met"), "node")
    card = members.select("node", "n_shingles", F.hex("sig").alias("sig"))
    radius, percent = like.radius(like.symbols), like.percent
    sets = roots = links = None
    for pairs_of in (_star, _second_star, _across):
        placed = groups if roots is None else groups.join(roots, "node", "left")
        placed = placed.withColumn("root", F.col("node") if roots is None else F.coalesce("root", "node"))
        pairs = pairs_of(placed, sets, members, like)
        for side in "ab":
            pairs = pairs.join(card.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("sig").alias(f"s{side}")), side)
        # a link needs sizes this close, whatever the sets hold
        pairs = pairs.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        pairs = settled(pairs.where(differing(F.col("sa"), F.col("sb")) <= radius).select("a", "b", "na", "nb"))
        if sets is None:
            sets = settled(_sets(docs, members, like, doc_id, text))
        if pairs.isEmpty():
            continue
        full = pairs
        for side in "ab":
            full = full.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"x{side}")), side)
        common = F.size(F.array_intersect("xa", "xb"))
        found = full.select("a", "b", "na", "nb", common.cast("long").alias("c")).where(f"100 * c >= {percent} * (na + nb - c)").select("a", "b")
        links = settled(found if links is None else links.union(found))
        roots = components(links)
    return roots


def _with_hub(rows: DataFrame) -> DataFrame:
    """Pairs of each class of a key with the class of that key that meets the most others."""
    most = F.struct("met", "node")
    hub = rows.groupBy("key").agg(F.max_by("node", most).alias("hub"), F.max_by("root", most).alias("hub_root"))
    pairs = rows.join(hub, "key").where("root <> hub_root")
    return pairs.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()


def _star(placed: DataFrame, *_) -> DataFrame:
    return _with_hub(placed)


def _largest_roots(placed: DataFrame) -> DataFrame:
    """``key`` and ``main``, the component with the most classes there, of keys with several components."""
    counts = placed.groupBy("key", "root").agg(F.count("*").alias("c"))
    main = counts.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots"))
    return main.where("roots > 1").select("key", "main")


def _second_star(placed: DataFrame, *_) -> DataFrame:
    return _with_hub(placed.join(_largest_roots(placed), "key").where("root <> main"))


def _across(placed: DataFrame, sets: DataFrame, members: DataFrame, like: Similarity) -> DataFrame:
    """All pairs of classes of a key that are in different components and could be linked.

    A pair that meets under several keys is made under the first of them only: classes in different components meet
    across components under each of their common keys.
    """
    rows = settled(placed.join(_largest_roots(placed), "key"))
    held = F.aggregate("planes", F.lit(0), lambda acc, p: acc + F.bit_count(p))
    sizes = members.select("node", F.col("n_shingles").alias("n"), chunks(F.hex("sig"), like.symbols).alias("chunks"))
    cards = sets.join(sizes, "node").select("node", "n", (F.col("n") - held).alias("over"), "planes", "chunks")
    rows = rows.join(cards, "node")
    # a pair has a side outside the key's largest component, so that component is never paired with itself
    names = ("node", "root", "n", "over", "planes", "chunks")
    x = rows.where("root <> main").select("key", *(F.col(c).alias(f"x_{c}") for c in names))
    y = rows.select("key", "main", *(F.col(c).alias(f"y_{c}") for c in names))
    most = "(least(x_over, y_over) + aggregate(zip_with(x_planes, y_planes, (p, q) -> bit_count(p & q)), 0, (n, b) -> n + b))"
    close = f"100 * least(x_n, y_n) >= {like.percent} * greatest(x_n, y_n)"
    fits = f"{most} * {100 + like.percent} >= {like.percent} * (x_n + y_n)"
    here = F.shiftrightunsigned("key", 56) == first_place("x_chunks", "y_chunks", like.symbols)
    # pairs with both sides outside the largest component are met from one side only
    pairs = x.join(y, "key").where(f"x_root <> y_root and (y_root = main or x_node < y_node) and {close}").where(here).where(fits)
    return pairs.select(F.greatest("x_node", "y_node").alias("a"), F.least("x_node", "y_node").alias("b"))


def representatives(docs: DataFrame, like: Similarity = Similarity(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stand for their groups, all columns, one row each.

    Of repeated rows with the id that stands for a group one stays. Rows with a null id, and of these all without
    words, stay where no document with an id is linked with them.
    """
    found = near_duplicates(docs, like, doc_id, text).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    key = F.col(doc_id).cast("long")
    kept = docs.join(found, key.eqNullSafe(F.col("_kept_id")), "left_semi")
    named = kept.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id])
    return named.unionByName(kept.where(F.col(doc_id).isNull()))
