"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton over a text finds anchors: at-signs, schemes, plus signs before a digit, digits,
and the cue words of identifiers. From each anchor a parser of its own, without backtracking and without a second try,
finds the borders of what the anchor stands for and validates it.

Kinds: ``email``, ``ip``, ``card``, ``phone`` (the base kinds), and ``url`` (with user data or a query),
``account`` (an international bank account number with a right check sum), ``secret`` (access keys, and values assigned
to password, token, secret or key names), ``address`` (street number and name with a street word, in English, German,
French and Spanish order).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Run, lean

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret", "address")
Span = tuple[int, int, str]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
ALNUM = LABEL - {"-"}
DIGIT = frozenset("0123456789")
CARD_GAP = frozenset(" -")
PHONE = frozenset(" ().0123456789-")

# Names whose assigned value is a secret, and words that close a street's name.
SECRET_NAMES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "access_key")
STREET_WORDS = ("Street", "Avenue", "Road", "Boulevard", "Lane", "Drive", "Straße", "Strasse", "Platz", "Gasse")
# endings of one-word street names, words that open a street's name, small words inside such a name, and capitalised
# words that are no street's name by themselves
STREET_ENDINGS = ("straße", "strasse", "str.", "platz", "gasse", "allee", "weg")
STREET_FIRST = ("rue", "avenue", "boulevard", "place", "calle", "avenida", "plaza", "paseo", "quai", "chemin")
SMALL_WORDS = frozenset("de du des del la le les las los el y et au aux l d".split())
NO_NAMES = frozenset("auf der die das den dem des im in am an von vom zu zum zur um bei the a".split())
KEY_STARTS = ("AKIA", "ASIA", "ghp_", "sk-", "-----BEGIN")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("://", ("url", 3))
    for d in DIGIT:
        found.add_word(d, ("digit", 1))
        found.add_word("+" + d, ("phone", 2))
    for word in SECRET_NAMES:
        for form in (word, word.upper(), word.capitalize()):
            found.add_word(form, ("name", len(form)))
    for word in KEY_STARTS:
        found.add_word(word, ("key", len(word)))
    # one entry per form: a form may serve several orders
    forms = {form for word in (*STREET_WORDS, *STREET_ENDINGS, *STREET_FIRST) for form in (word, word.lower(), word.capitalize(), word.upper(), word.upper().replace("SS", "ß") if "ß" in word else word)}
    for form in forms:
        found.add_word(form, ("street", len(form)))
    found.make_automaton()
    return found


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around an at-sign: local part back to ``floor`` at most, two or more labels after it."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    end = labels = 0
    place = at + 1
    while True:
        label = place
        while place < len(text) and text[place] in LABEL:
            place += 1
        if place == label:
            break
        labels, end = labels + 1, place
        if place >= len(text) or text[place] != ".":
            break
        place += 1
    return (start, end) if labels >= 2 else None


def run_of(text: str, start: int, letters: frozenset) -> int:
    while start < len(text) and text[start] in letters:
        start += 1
    return start


def ips_at(text: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """The groups of four in a chain of numbers and dots that starts here, and where the chain ends."""
    parts, place = [], start
    while True:
        end = run_of(text, place, DIGIT)
        parts.append((place, end))
        place = end + 1
        if end + 1 >= len(text) or text[end] != "." or text[end + 1] not in DIGIT:
            break
    fours = [parts[i : i + 4] for i in range(0, len(parts) - 3, 4)]
    # a number of more than three digits without zeros in front is past 255 anyway
    fit = lambda a, b: len(x := text[a:b].lstrip("0")) <= 3 and int(x or 0) <= 255
    return [(four[0][0], four[3][1]) for four in fours if all(fit(*p) for p in four)], parts[-1][1]


def card_at(text: str, start: int) -> tuple[bool, int]:
    """Digits with single blanks or hyphens between, from here: whether they are a card number, and where they end."""
    digits, place = [text[start]], start + 1
    while place < len(text):
        if text[place] in DIGIT:
            digits.append(text[place])
            place += 1
        elif text[place] in CARD_GAP and place + 1 < len(text) and text[place + 1] in DIGIT:
            digits.append(text[place + 1])
            place += 2
        else:
            break
    return 14 <= len(digits) <= 19 and luhn(digits), place


def luhn(digits: list[str]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def phone_at(text: str, plus: int) -> tuple[bool, int] | None:
    """From a plus sign: whether its longest stretch that ends in a digit is a number, and where it ends."""
    end = run_of(text, plus + 2, PHONE)
    while end > plus + 2 and text[end - 1] not in DIGIT:
        end -= 1
    if end - plus < 4:
        return None
    digits = sum(c in DIGIT for c in text[plus:end])
    return 10 <= digits <= 15, end


URL_END = frozenset(" \t\r\n\v\f\"'<>()[]{}|\\^`")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])")


class Reader:
    """What has been read of a text by parsers whose anchors may lie in one long run."""

    def __init__(self, text: str):
        self.text = text
        self.address, self.name, self.value = Run(f"[^{re.escape(''.join(URL_END))}]*+"), Run("[A-Za-z0-9_]*+"), Run(r"[^\s\"',;]*+")
        self.query = self.address_end = -1
        # the start of the last hyphenated word, and how far it was known
        self.word, self.word_read = 0, -1

    def url_at(self, at: int) -> tuple[int, int] | None:
        """The address around ``://`` if it names a user or carries a query."""
        text, start = self.text, at
        while start > 0 and text[start - 1] in ALNUM:
            start -= 1
        before, end = self.address.last, self.address.end(self.text, at + 3)
        if end != before:
            self.query = text.rfind("?", at + 3, end)
            while end > at + 3 and text[end - 1] in ".,;:!?":
                end -= 1
            self.address_end = end
        end = self.address_end
        if start == at or end <= at + 3:
            return None
        slash = text.find("/", at + 3, end)
        user = text.find("@", at + 3, end if slash < 0 else slash) >= 0
        # the last question mark may have been trimmed, an earlier one has then to be looked for
        asked = self.query >= at + 3 and (self.query < end or text.find("?", at + 3, end) >= 0)
        return (start, end) if user or asked else None

    def value_after(self, end: int) -> tuple[int, int] | None:
        """The value assigned to a name that goes on here."""
        match = _ASSIGNED.match(self.text, self.name.end(self.text, end))
        if not match:
            return None
        start, last = match.end(), self.value.end(self.text, match.end())
        if last - start >= 6:
            return start, last
        # the quote may be the value's own first character, which no value begins with
        return None

    def word_start(self, start: int) -> int:
        """The first letter of the hyphenated word that goes on here."""
        text, first = self.text, start
        while first > 0 and (text[first - 1].isalpha() or (text[first - 1] == "-" and first > 1 and text[first - 2].isalpha())):
            first -= 1
            if first == self.word_read:
                first = self.word
                break
        self.word, self.word_read = first, start
        return first


_ASSIGNED = re.compile(r"[\"']?[ \t]*[:=][ \t]*[\"']?")


def account_at(text: str, digit: int) -> tuple[int, int] | None:
    """An international account number whose check digits begin here."""
    start = digit - 2
    if start < 0 or not text[start:digit].isalpha() or (start and text[start - 1] in ALNUM):
        return None
    match = _IBAN.match(text, start)
    if not match:
        return None
    code = match.group().replace(" ", "")
    number = "".join(str(int(c, 36)) for c in code[4:] + code[:4])
    return match.span() if 15 <= len(code) <= 34 and int(number) % 97 == 1 else None


def key_at(text: str, start: int, size: int) -> tuple[int, int] | None:
    """An access key: its start, then a long run of letters and digits; of a key block, the line that opens it."""
    if text.startswith("-----BEGIN", start):
        end = text.find("-----", start + 10)
        return (start, end + 5) if 0 <= end - start <= 60 else None
    if start and text[start - 1] in ALNUM:
        return None
    end = run_of(text, start + size, ALNUM)
    return (start, end) if end - start - size >= 12 else None


_NUMBER = re.compile(r"[0-9]{1,5}(?: ?[A-Za-z](?!\w))?(?:[-/][0-9]{1,5}[a-z]?)?(?![\w-]|[.,:/][0-9])")
_NUMBER_SIGN = re.compile(r",? (?:[Nn](?:º|°|o\.|r\.|\.) ?)?")
_FRONT = re.compile(r"[0-9]{1,5}(?:[a-z]| ?(?:bis|ter|quater)| [A-Z])?,? ")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_FIRST = frozenset(STREET_FIRST)
_LAST = frozenset(w.lower() for w in STREET_WORDS)
_ENDING = frozenset(STREET_ENDINGS)


NAME_WORDS = 8


def words_before(text: str, end: int, most: int) -> list[int]:
    """Starts of the words of letters before a place, nearest first, each followed by one blank or hyphen."""
    out: list[int] = []
    while len(out) < most and end > 1 and text[end - 1] in " -" and text[end - 2].isalpha():
        end -= 1
        while end > 0 and text[end - 1].isalpha():
            end -= 1
        out.append(end)
    return out


def front_number(text: str, end: int) -> int | None:
    """The start of a house number, with the blank behind it, that ends here."""
    start = max(0, end - 14)
    for at in range(start, end):
        if text[at] in DIGIT and (at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "_.")):
            match = _FRONT.match(text, at, end)
            if match and match.end() == end:
                return at
    return None


def number_behind(text: str, end: int) -> int | None:
    """The end of a house number behind a street's name that ends here."""
    sign = _NUMBER_SIGN.match(text, end)
    match = _NUMBER.match(text, sign.end()) if sign else None
    return match.end() if match else None


def name_behind(text: str, end: int) -> list[int]:
    """Where a street's name that follows here may end: after each capitalised word, small words between."""
    out: list[int] = []
    for _ in range(8):
        match = _WORD.match(text, end + 1) if end < len(text) and text[end] == " " else None
        if not match:
            break
        word, end = match.group(), match.end()
        capital = word[0].isupper() or (len(word) > 2 and word[1] in "'’" and word[2].isupper())
        if capital and word.lower() not in SMALL_WORDS:
            out.append(end)
        elif word.lower() not in SMALL_WORDS:
            break
    return out


def street_at(text: str, start: int, end: int, reader: Reader) -> tuple[int, int] | None:
    """An address around a street word.

    ``12 Some Name Street``, ``Hauptstraße 12`` and ``Berliner Straße 12``, ``12 rue de la Paix``, ``Calle Mayor 5``.
    """
    word = text[start:end]
    kind, alone = word.lower(), not start or not (text[start - 1].isalnum() or text[start - 1] == "_")
    last = kind in _LAST or kind in _ENDING
    if last and alone:
        before = words_before(text, start, NAME_WORDS)
        for i, place in enumerate(before):
            # a street word in small letters is one only behind a name in capital ones, and so is one behind many words
            if (word[0].islower() or i >= 3) and not text[place].isupper():
                break
            if (number := front_number(text, place)) is not None:
                return number, end
        named = []
        for place in before:
            if not text[place].isupper():
                break
            named.append(place)
        whole = [text[place:stop - 1].lower() for place, stop in zip(named, [start, *named])]
        if word[0].isupper() and any(w not in NO_NAMES for w in whole) and (stop := number_behind(text, end)):
            return named[-1], stop
    elif kind in _ENDING:
        first = reader.word_start(start)
        if start - first > 1 and text[first].isupper() and (stop := number_behind(text, end)):
            return first, stop
    if kind in _FIRST and alone and (ends := name_behind(text, end)):
        if (number := front_number(text, start)) is not None:
            return number, ends[-1]
        for place in reversed(ends):
            if stop := number_behind(text, place):
                return start, stop
    return None


def spans(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """All spans of a text, by start, then kind in the order listed."""
    out: list[Span] = []
    mail_floor = phone_floor = ip_floor = card_floor = 0
    length, reader = len(text), Reader(text)
    for last, (kind, size) in anchors.iter(text):
        first = last + 1 - size
        if kind == "digit":
            if first >= card_floor:
                fits, card_floor = card_at(text, first)
                if fits:
                    out.append((first, card_floor, "card"))
            if first >= ip_floor:
                found, ip_floor = ips_at(text, first)
                out += [(a, b, "ip") for a, b in found]
            if first >= 2 and text[first - 1] not in DIGIT and (span := account_at(text, first)):
                out.append((*span, "account"))
        elif kind == "email":
            if span := email_at(text, first, mail_floor):
                out.append((*span, "email"))
                mail_floor = span[1]
        elif kind == "phone":
            if first >= phone_floor and (found := phone_at(text, first)):
                fits, phone_floor = found
                if fits:
                    out.append((first, phone_floor, "phone"))
        elif kind == "url":
            if span := reader.url_at(first):
                out.append((*span, "url"))
        elif kind == "key":
            if span := key_at(text, first, size):
                out.append((*span, "secret"))
        elif kind == "name":
            if span := reader.value_after(last + 1):
                out.append((*span, "secret"))
        elif kind == "street" and (last + 1 == length or not text[last + 1].isalnum()) and (span := street_at(text, first, last + 1, reader)):
            out.append((*span, "address"))
    out = list(dict.fromkeys(out))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return out


def masked(text: str, found: list[Span]) -> str:
    """The text with every span, overlapping ones as one, replaced by its kind in brackets."""
    out, at, i = [], 0, 0
    while i < len(found):
        start, end, kind = found[i]
        while i + 1 < len(found) and found[i + 1][0] < end:
            i += 1
            end = max(end, found[i][1])
        out += [text[at:start], f"[{kind}]"]
        at, i = end, i + 1
    return "".join(out) + text[at:] if out else text


def detected(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, counts of the base kinds, ``base_sha256`` and ``spans`` (kind:start:end, code points).

    Every text is searched whole. A null or empty text has no spans; repeated rows each give a result row; extra
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            columns: list[list] = [[] for _ in range(len(BASE) + 2)]
            for value in batch.column(1).to_pylist():
                found = spans(value, anchors) if value else []
                for column, kind in zip(columns, BASE):
                    column.append(sum(s[2] == kind for s in found))
                columns[-2].append(hashlib.sha256(listed([s for s in found if s[2] in BASE]).encode()).hexdigest())
                columns[-1].append(listed(found))
            kinds = [pa.int64()] * len(BASE) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, columns, kinds)],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in BASE)
    return rows.mapInArrow(lean(run), f"doc_id long, {counts}, base_sha256 string, spans string")


def listed(found: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with spans in ``text`` masked; ``n_chars``, where there is one, follows a new text.

    Null texts stay null, texts without spans stay as they are, no row is dropped.
    """
    place = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            old = batch.column(place).to_pylist()
            new = [masked(t, spans(t, anchors)) if t else t for t in old]
            field = batch.schema.field(place)
            out = batch.set_column(place, field, pa.array(new, field.type))
            if chars is not None:
                field = batch.schema.field(chars)
                sizes = [len(n) if n != o else c for n, o, c in zip(new, old, batch.column(chars).to_pylist())]
                out = out.set_column(chars, field, pa.array(sizes, field.type))
            yield out

    return docs.mapInArrow(lean(run), docs.schema)
