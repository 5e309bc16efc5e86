"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word, the vocabulary's matches that end there (all of them come out of one suffix automaton
while it reads the word) are candidates for the last token of the prefix's encoding. A candidate is that token exactly
when the pair of the last token of what lies before it and the candidate is compatible: no merge across their border
would have been made before the merges that built the two. Exactly one candidate passes, so one token per prefix is
stored, and following the stored tokens back from the whole word gives the ids that making the merges in order gives,
in one pass over the word.

The tokenizer file describes normalisation (canonical composition, white space to one space, lower case letter by
letter), the split into words, byte symbols with a mark on a word's last one, and added tokens, whose strings in a
text are one id each. The file is read on the driver and broadcast; its size does not depend on the data.

The automaton over the vocabulary is the Aho-Corasick form: it names every match that ends at a place, longest first,
which is what the suffix automaton of the vocabulary would be asked for.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, lean

# Words a task remembers the ids of, and pairs of tokens their test; longer words are not remembered.
MEMORY_WORDS = 200_000
MEMORY_LENGTH = 64
MEMORY_PAIRS = 100_000
# stands behind a word's last symbol; no byte symbol is a control character
CLOSE = "\n"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def in_latin_1(pattern: str) -> str:
    """The pattern for texts whose characters all lie below 256, with its classes written out; it is matched faster."""
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        members = [chr(c) for c in range(256) if regex.fullmatch(name, chr(c))]
        pattern = pattern.replace(name, "".join(map(re.escape, members)))
    return pattern


class Codec:
    """Encoder and decoder of one tokenizer file (BPE with an end-of-word mark)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*vocab.items(), *self.added.items()]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.latin_words = re.compile(in_latin_1(split["pattern"]["Regex"]))
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.symbols = byte_symbols()
        # the order of the merge of two tokens, and of a token the two parts it was merged from
        self.order: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for order, merge in enumerate(model["merges"]):
            left, right = (vocab[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            self.order[left, right] = order
            whole = vocab[self.strings[left] + self.strings[right]]
            self.parts.setdefault(whole, (left, right, order))
        self.seen: dict[tuple[int, int], bool] = {}
        self.matches = ahocorasick.Automaton()
        for string, token in vocab.items():
            closing = len(string) > len(end) and string.endswith(end)
            plain = string[: -len(end)] + CLOSE if closing else string
            if self._made(token, len(plain) - closing):
                self.matches.add_word(plain, (token, len(plain)))
        self.matches.make_automaton()
        self.memory = Memory(self)

    def forget(self) -> None:
        """Empties the memory of words and pairs; the tables of the tokenizer stay."""
        self.seen, self.memory = {}, Memory(self)

    def _made(self, token: int, length: int) -> bool:
        """Whether merging a token's own string gives the token; others are never part of an encoding."""
        if token not in self.parts:
            return length == 1
        left, right, order = self.parts[token]
        return self._apart(left, right, order)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the strings of two tokens side by side encode to these two."""
        known = self.seen.get((left, right))
        if known is None:
            if len(self.seen) >= MEMORY_PAIRS:
                self.seen.clear()
            known = self.seen[left, right] = self._apart(left, right, len(self.order))
        return known

    def _apart(self, left: int, right: int, before: int) -> bool:
        """Whether no merge across the border of two tokens comes before the merge of that order."""
        while True:
            if self.order.get((left, right), before) < before:
                return False
            first, second = self.parts.get(left), self.parts.get(right)
            if first is None and second is None:
                return True
            # take the later of the two merges back; of equal ones the right one came later
            if second is None or (first is not None and first[2] > second[2]):
                before, left = first[2], first[1]
            else:
                before, right = second[2] + 1, second[0]

    def word(self, symbols: str) -> tuple[int, ...]:
        """Ids of one word, given in byte symbols."""
        n, known = len(symbols), self.seen.get
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        for at, (token, length) in self.matches.iter(symbols + CLOSE):
            # the mark counts as no symbol of its own: a closing match covers one symbol less than its length
            closing = at == n
            end, start = (n, n + 1 - length) if closing else (at + 1, at + 1 - length)
            if (end == n) != closing or last[end] is not None:
                continue
            if start:
                pair = last[start][0], token
                fits = known(pair)
                if fits is None:
                    fits = self.compatible(*pair)
            if start == 0 or fits:
                last[end] = (token, start)
        out, at = [], n
        while at:
            token, at = last[at]
            out.append(token)
        return tuple(reversed(out))

    def pieces(self, text: str) -> list[tuple[int, str, str]]:
        """Of each word or added token: how many ids it has, their digits and their strings."""
        out = []
        for place, piece in enumerate(self.marks.split(text) if "<|" in text else [text]):
            if place % 2:
                token = self.added[piece]
                out.append((1, str(token), piece))
                continue
            # letter by letter: a sigma at a word's end is an ordinary one
            lowered = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
            try:
                lowered.encode("latin-1")
                words = self.latin_words.findall(lowered)
            except UnicodeEncodeError:
                words = self.words.findall(lowered)
            out += map(self.memory.__getitem__, words)
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for _, digits, _ in self.pieces(text) for x in digits.split()]

    def decode(self, ids) -> str:
        """The tokens' strings with one space between, as the file names no decoder."""
        return " ".join([self.strings[i] for i in ids])


class Memory(Remembered):
    """Words met before: how many ids, their digits, their strings."""

    def __init__(self, codec: Codec):
        self.codec, self.symbols = codec, dict(enumerate(codec.symbols))
        super().__init__(self.found, MEMORY_WORDS)

    def found(self, word: str) -> tuple[int, str, str]:
        ids = self.codec.word("".join([self.symbols[b] for b in word.encode()]))
        return len(ids), " ".join(map(str, ids)), self.codec.decode(ids)

    def __missing__(self, word: str) -> tuple[int, str, str]:
        return super().__missing__(word) if len(word) <= MEMORY_LENGTH else self.found(word)


class Shared:
    """The tokenizer file on its way to the workers; a worker builds its codec once."""

    def __init__(self, text: str):
        self.text, self.codec = text, None

    def ready(self) -> Codec:
        if self.codec is None:
            self.codec = Codec(self.text)
        return self.codec


def tokenizer_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``ids`` (array of int), ``decoded`` (the text its ids give).

    A null or empty text gives no ids. Texts are encoded whole. Repeated rows each give a result row, extra columns are
    ignored, an empty table gives an empty result.
    """

    def columns(codec: Codec, texts: list[str]):
        ids = [codec.encode(t) for t in texts]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(i) for i in ids], pa.string())]

    return _mapped(docs, path, doc_id, text, columns, "ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_tokens``, and the digests of the ids and of the decoded text."""

    def columns(codec: Codec, texts: list[str]):
        sizes, left, right = [], [], []
        for t in texts:
            pieces = codec.pieces(t)
            sizes.append(sum(map(itemgetter(0), pieces)))
            left.append(hashlib.sha256(" ".join(map(itemgetter(1), pieces)).encode()).hexdigest())
            right.append(hashlib.sha256(" ".join(map(itemgetter(2), pieces)).encode()).hexdigest())
        return [pa.array(sizes, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())]

    return _mapped(docs, path, doc_id, text, columns, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(docs: DataFrame, path: str, doc_id: str, text: str, columns, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Shared(tokenizer_text(path)))
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.ready()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns(codec, texts)], names=names)
        codec.forget()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id long, {schema}")
