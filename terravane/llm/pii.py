"""Personal data and secrets (operator 5): keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from ipaddress import IPv6Address

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.llm.tokens import rows_of

# --- keyed permutations -----------------------------------------------------------------------------------------------


class Shift:
    """A keyed permutation of 0 .. n-1 that is one cycle: each value is mapped to the next in a keyed random order.

    So no value (if n > 1) is its own surrogate, distinct values have distinct surrogates, and walking on from a value to
    the next one that is allowed is again such a cycle on the allowed values. n is below 2^1024: longer values are cut.
    """

    ROUNDS = 6

    def __init__(self, key: bytes, n: int) -> None:
        self.n, self.half = n, max(1, -(-max(n - 1, 1).bit_length() // 2))
        self.mask, self.size = (1 << self.half) - 1, (self.half + 7) // 8
        self.key = hashlib.blake2b(key + b"|" + n.to_bytes(n.bit_length() // 8 + 1, "big"), digest_size=32).digest()

    def _round(self, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(bytes([i]) + x.to_bytes(self.size, "big"), key=self.key, digest_size=self.size).digest(), "big") & self.mask

    def _forth(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in range(self.ROUNDS):
                a, b = b, a ^ self._round(i, b)
            x = a << self.half | b
            if x < self.n:
                return x

    def _back(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in reversed(range(self.ROUNDS)):
                a, b = b ^ self._round(i, a), a
            x = a << self.half | b
            if x < self.n:
                return x

    def next(self, x: int) -> int:
        return self._back((self._forth(x) + 1) % self.n)


def walk(shift: Shift, x: int, allowed: Callable[[int], bool]) -> int:
    """The next allowed value after x."""
    y = shift.next(x)
    while not allowed(y) and y != x:
        y = shift.next(y)
    return y


#: Alphabets by kind of character; a character is replaced by one of its own alphabet.
ALPHABETS = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüý",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
]
HEX = "0123456789abcdef"
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OF = {c: a for a in ALPHABETS for c in a}


#: Characters of a value that are permuted as one number; longer values go piece by piece.
PIECE = 64


def _alphabet(c: str) -> str:
    if c in _OF:
        return _OF[c]
    for low, high in ((0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x3041, 0x3096), (0x30A1, 0x30FA)):
        if low <= ord(c) <= high:
            return "".join(map(chr, range(low, high + 1)))
    return c


def _respelled(text: str, key: bytes, sets: list[str], allowed: Callable[[str], bool]) -> str:
    n, x = 1, 0
    for a, c in zip(sets, text, strict=True):
        n, x = n * len(a), x * len(a) + a.index(c)
    if n < 2:
        return text
    pattern = "|".join(a[0] for a in sets).encode()

    def spell(v: int) -> str:
        out = []
        for a in reversed(sets):
            v, i = divmod(v, len(a))
            out.append(a[i])
        return "".join(reversed(out))

    return spell(walk(Shift(key + pattern, n), x, lambda v: allowed(spell(v))))


def spelled(text: str, key: bytes, allowed: Callable[[str], bool] = lambda s: True, alphabets: list[str] | None = None) -> str:
    """A surrogate spelled with the same pattern: each character from its own alphabet, others stay. Distinct texts of a pattern
    have distinct surrogates, and none is its own.

    Texts beyond PIECE characters are permuted piece by piece, each under a key that holds a digest of the pieces after it
    and of the surrogates before it. From the last piece back this can be undone, so it is a permutation as well; the work
    is linear in the length. Only a text of one piece can be held to ``allowed``.
    """
    sets = alphabets or [_alphabet(c) for c in text]
    if len(text) <= PIECE:
        return _respelled(text, key, sets, allowed)
    starts = range(0, len(text), PIECE)
    later, digest = [], b""
    for i in reversed(starts):
        later.append(digest)
        digest = hashlib.blake2b(digest + text[i : i + PIECE].encode(), digest_size=16).digest()
    out, before = [], b""
    for i, after in zip(starts, reversed(later), strict=True):
        out.append(_respelled(text[i : i + PIECE], key + b"|" + before + after + str(len(text)).encode(), sets[i : i + PIECE], lambda s: True))
        before = hashlib.blake2b(before + out[-1].encode(), digest_size=16).digest()
    return "".join(out)


# --- types ------------------------------------------------------------------------------------------------------------

#: Given names by gender.
FEMALE = "Anna Maria Laura Julia Sofia Emma Clara Elena Paula Lucia Marta Nina Eva Sarah Lisa Claire Alice Louise Camille Hannah Carmen Rosa Irene Monika Petra Sabine Ingrid Emily Grace Helen".split()
MALE = "Peter Thomas Paul Martin Daniel David Lukas Felix Simon Oscar Hugo Louis Jules Pierre Henri Carlos Miguel Javier Diego Pablo Stefan Jonas Klaus Werner Dieter James John Robert William George".split()
_GIVEN = {n: own for own in (FEMALE, MALE) for n in own}


def digits_of(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def fill(pattern: str, digits: str) -> str:
    """The pattern with its digits replaced, one after the other."""
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), pattern)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


#: Country codes of one and two digits, and the first two digits of those of three. No code begins another one.
_CODES = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|3[578]|42|5[09]|6[789]|8[0578]|9[679])[0-9]")


def _country(value: str) -> str:
    """The country code after a plus sign: up to the first separator, else by the table; nothing if there is none."""
    m = re.match(r"\+([0-9]{1,3})(?=[ .(-])", value)
    if m:
        return m[1]
    known = _CODES.match(digits_of(value)) if value[0] == "+" else None
    return known[0] if known else ""


def _phone(value: str, key: bytes) -> str:
    """The country code stays; the rest is the same number for all ways to write it, and as valid as before."""
    own = digits_of(value)
    code = _country(value) or own[: len(own) == 11 and own[0] == "1"]
    own = own[len(code) :]
    north = len(own) == 10 and code in ("", "1")
    valid = lambda s: (s[0] > "1" and s[3] > "1") if north else s[0] != "0"
    kind = valid(own)
    new = spelled(own, key + b"|phone", lambda s: valid(s) == kind)
    return fill(value, code + new)


def _card(value: str, key: bytes) -> str:
    own = digits_of(value)
    right = luhn(own)
    return fill(value, own[0] + spelled(own[1:], key + b"|card" + own[:1].encode(), lambda s: luhn(own[0] + s) == right))


def _address_kind(octets: tuple[int, ...]) -> str:
    a, b = octets[:2]
    if a in (0, 127) or a >= 224:
        return "special"
    return "private" if a == 10 or (a == 172 and 16 <= b < 32) or (a == 192 and b == 168) else "public"


def _ip(value: str, key: bytes) -> str:
    octets = tuple(map(int, value.split(".")))
    split = lambda v: tuple(v >> s & 255 for s in (24, 16, 8, 0))
    kind = _address_kind(octets)
    x = sum(o << s for o, s in zip(octets, (24, 16, 8, 0), strict=True))
    return ".".join(map(str, split(walk(Shift(key + b"|ip", 1 << 32), x, lambda v: _address_kind(split(v)) == kind))))


#: First groups of IPv6 addresses by kind: special, global, unique local, link-local, multicast and the rest between them.
_FIRST_GROUPS = [(0, 0x2000), (0x2000, 0x4000), (0x4000, 0xFC00), (0xFC00, 0xFE00), (0xFE00, 0xFE80), (0xFE80, 0xFEC0), (0xFEC0, 0xFF00), (0xFF00, 0x10000)]


def ipv6_valid(value: str) -> bool:
    try:
        return IPv6Address(value).packed[0] != 0  # unspecified, loopback and mapped addresses name no one
    except ValueError:
        return False


def _ipv6(value: str, key: bytes) -> str:
    """Groups of zeros stay, the first group keeps its kind, the others become other groups that aren't zero: the same address for
    all ways to write it. Written in the value's way: with or without leading zeros, shortened or in full."""
    groups = [int(g, 16) for g in IPv6Address(value).exploded.split(":")]
    low, high = next(r for r in _FIRST_GROUPS if groups[0] < r[1])
    low = max(low, 1)
    at = [i for i in range(1, 8) if groups[i]]
    n, x = high - low, groups[0] - low
    for i in at:
        n, x = n * 65535, x * 65535 + groups[i] - 1
    y = Shift(key + b"|ipv6|" + bytes([low >> 8, *at]), n).next(x)
    for i in reversed(at):
        y, g = divmod(y, 65535)
        groups[i] = g + 1
    groups[0] = low + y
    full = ":".join(f"{g:04x}" for g in groups)
    own = value.split(":")
    out = str(IPv6Address(full)) if "::" in value else full if all(len(g) == 4 for g in own) else ":".join(f"{g:x}" for g in groups)
    return out.upper() if value == value.upper() != value.lower() else out


def _email(value: str, key: bytes) -> str:
    """Local part and all labels but the last are spelled anew. Case does not count: it is put back letter by letter."""
    local, _, host = value.lower().rpartition("@")
    labels = host.split(".")
    new = [spelled(local, key + b"|local|" + host.encode()), *(spelled(x, key + b"|host") for x in labels[:-1]), labels[-1]]
    out = new[0] + "@" + ".".join(new[1:])
    return "".join(c.upper() if o.isupper() else c for c, o in zip(out, value, strict=True))


def _iban(value: str, key: bytes) -> str:
    own = re.sub(r"[^A-Z0-9]", "", value)
    body = spelled(own[4:], key + b"|iban" + own[:2].encode())
    check = 98 - int("".join(str(BASE36.index(c)) for c in body + own[:2] + "00")) % 97
    it = iter(f"{own[:2]}{check:02d}{body}")
    return re.sub(r"[A-Z0-9]", lambda _: next(it), value)


def iban_valid(value: str) -> bool:
    own = re.sub(r"[^A-Z0-9]", "", value)
    return 15 <= len(own) <= 34 and int("".join(str(BASE36.index(c)) for c in own[4:] + own[:4])) % 97 == 1


def _secret(value: str, key: bytes) -> str:
    """Hexadecimal stays so; else each character keeps its kind."""
    sets = [HEX] * len(value) if re.fullmatch(r"[0-9a-f]+", value) else None
    return spelled(value, key + b"|secret", alphabets=sets)


def _access_key(value: str, key: bytes) -> str:
    return value[:4] + spelled(value[4:], key + b"|access", alphabets=[BASE36] * len(value[4:]))


_VOWELS = "aeiou"
#: A letter's own kind inside a name that is not listed: vowels and consonants stay what they are, so that names can be said.
_SOUND = {c: a for a in (_VOWELS, "bcdfghjklmnpqrstvwxyz", _VOWELS.upper(), "BCDFGHJKLMNPQRSTVWXYZ") for c in a}


def _name(value: str, key: bytes) -> str:
    """Given names of a known gender become others of it. Other names are spelled anew in their script, vowels for vowels; their last
    letter stays, as it marks the gender in many languages. They never become a given name that is known, and a word has
    one surrogate in whichever name it stands."""
    out = []
    for word in re.split(r"([ -])", value):
        if word in _GIVEN:
            own = _GIVEN[word]
            out.append(own[Shift(key + b"|given" + own[0].encode(), len(own)).next(own.index(word))])
        else:
            sets = [_SOUND.get(c) or _alphabet(c) for c in word]
            out.append(spelled(word, key + b"|name", lambda s: s not in _GIVEN, [*sets[:-1], word[-1]] if len(word) > 2 else sets))
    return "".join(out)


@dataclass(frozen=True)
class Kind:
    """A type of entity: what to search (group ``v``, else the whole match), a cheap test of the text, and how to replace it."""

    name: str
    pattern: re.Pattern[str]
    hint: Callable[[str], bool]
    surrogate: Callable[[str, bytes], str]
    valid: Callable[[str], bool] = lambda v: True


_DIGIT = re.compile("[0-9]")
_PLUS = re.compile(r"\+[0-9]").search
_LETTER = r"[^\W\d_]"
_WORD_NAME = rf"[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]{_LETTER}+(?:-[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]{_LETTER}+)?"
TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señor|Señora|Sr|Sra)"

#: In order: an entity that overlaps an earlier kind's is not looked for again.
KINDS = [
    Kind("key_block", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?P<v>[A-Za-z0-9+/=\s]+)-----END"), lambda t: "PRIVATE KEY-----" in t, _secret),
    Kind("access_key", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"), lambda t: "AKIA" in t or "ASIA" in t, _access_key),
    Kind("token", re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_|sk-|xox[abp]-)(?P<v>[A-Za-z0-9-]{20,})"), lambda t: "_" in t or "-" in t, _secret),
    Kind(
        "secret",
        re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?(?:\s{0,4}[:=]\s{0,4}|\s{1,4}is\s{1,4})[\"']?(?P<v>[^\s\"',;]{5,}[^\s\"',;.])"),
        lambda t: "=" in t or ":" in t or " is " in t,
        _secret,
        lambda v: bool(_DIGIT.search(v)),
    ),
    Kind("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"), lambda t: "@" in t, _email),
    Kind("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _DIGIT.search, _iban, iban_valid),
    Kind("card", re.compile(r"(?<![\w.-])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![\w-])"), _DIGIT.search, _card),
    Kind("card", re.compile(r"(?<![\w.-])3[47][0-9]{2}([ -]?)[0-9]{6}\1[0-9]{5}(?![\w-])"), _DIGIT.search, _card),
    Kind("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w])(?!\.[0-9])"), _DIGIT.search, _ip),
    Kind("ip", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:{1,2}){1,7}[0-9A-Fa-f]{0,4}(?![\w:.])"), lambda t: t.count(":") > 1, _ipv6, ipv6_valid),
    Kind("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), _DIGIT.search, lambda v, k: fill(v, spelled(digits_of(v), k + b"|ssn"))),
    Kind("phone", re.compile(r"(?<![\w+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w)"), _DIGIT.search, _phone),
    # without separators: a whole number of the country code 1, or digits that do not go on; then with separators, then the digits before others
    Kind("phone", re.compile(r"(?<![\w+])\+(?:1[2-9][0-9]{9}|[0-9]{8,15}(?![ .-]?\(?[0-9]))(?!\w)"), _PLUS, _phone, lambda v: _country(v) != ""),
    Kind("phone", re.compile(r"(?<![\w+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?!\w)"), _PLUS, _phone, lambda v: 8 <= len(digits_of(v)) <= 15 and _country(v) != ""),
    Kind("phone", re.compile(r"(?<![\w+])\+[0-9]{8,15}(?!\w)"), _PLUS, _phone, lambda v: _country(v) != ""),
    # ten digits alone may be any number: only after a word that announces a call
    Kind(
        "phone",
        re.compile(r"(?i)(?<![a-z])(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms)(?: (?:me|us|at|number|no))?[ .:#]{1,3}(?P<v>[2-9][0-9]{2}[2-9][0-9]{6})(?!\w)"),
        re.compile(r"(?<!\w)[2-9][0-9]{9}(?!\w)").search,
        _phone,
    ),
    Kind("name", re.compile(rf"(?<!\w){TITLES}\.? (?P<v>{_WORD_NAME}(?: {_WORD_NAME})*)(?!\w)"), re.compile(rf"(?<!\w){TITLES}\.? ").search, _name),
    # without a title: a listed given name before another name
    Kind("name", re.compile(rf"(?<!\w)(?:{'|'.join(FEMALE + MALE)})(?: {_WORD_NAME})+(?!\w)"), re.compile(rf"(?<!\w)(?:{'|'.join(FEMALE + MALE)}) ").search, _name),
]

Entity = tuple[int, int, str, str]


class _Spans:
    """Spans that don't overlap, in order."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, Kind]] = []

    def take(self, start: int, end: int, kind: Kind) -> None:
        i = bisect_left(self.rows, start, key=lambda r: r[0])
        if start < end and (i == 0 or self.rows[i - 1][1] <= start) and (i == len(self.rows) or end <= self.rows[i][0]):
            self.rows.insert(i, (start, end, kind))


def find_entities(text: str) -> list[tuple[int, int, Kind]]:
    """Spans of entities, none of which overlap, ascending. A name that was found counts wherever it stands, and so does each of its
    words alone."""
    found, names, kind_of_names = _Spans(), set(), None
    for kind in KINDS:
        if not kind.hint(text):
            continue
        for m in kind.pattern.finditer(text):
            start, end = m.span("v" if "v" in kind.pattern.groupindex else 0)
            if kind.valid(text[start:end]):
                found.take(start, end, kind)
                if kind.name == "name":
                    own = text[start:end].split(" ")
                    names.update(" ".join(own[:n]) for n in range(2, len(own) + 1))  # other capitalised words may follow a name
                    names.update(own)
                    kind_of_names = kind
    if names:
        first: dict[str, list[str]] = {}
        for n in names:
            first.setdefault(n.split(" ")[0], []).append(n)
        for own in first.values():
            own.sort(key=len, reverse=True)
        for m in re.finditer(_WORD_NAME + r"(?!\w)", text):  # one pass, however many names there are
            if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
                continue
            for n in first.get(m[0], ()):
                end = m.start() + len(n)
                if text.startswith(n, m.start()) and not (end < len(text) and (text[end].isalnum() or text[end] == "_")):
                    found.take(m.start(), end, kind_of_names)
                    break
    return found.rows


def replace_entities(text: str, key: bytes) -> tuple[str, list[Entity]]:
    """The text with surrogates, and (start, end, type, surrogate) of each by its place in the text as it was.

    In a document, surrogates are checked: two values of a type must not share one. The permutations rule that out; should a
    kind of one's own break it, its later value walks on to the next free surrogate.
    """
    out, entities, at = [], [], 0
    owner: dict[tuple[str, str], str] = {}
    given: dict[tuple[str, str], str] = {}
    for start, end, kind in find_entities(text):
        value = text[start:end]
        new = given.get((kind.name, value))
        if new is None:
            new, tried = kind.surrogate(value, key), set()
            while owner.setdefault((kind.name, new), value) != value and new not in tried:
                tried.add(new)
                new = kind.surrogate(new, key)
            given[kind.name, value] = new
        out += [text[at:start], new]
        entities.append((start, end, kind.name, new))
        at = end
    return "".join([*out, text[at:]]), entities


ENTITY = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("surrogate", T.StringType())]))
_ARROW_ENTITY = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("surrogate", pa.string())]))


def replace_pii(docs: DataFrame, key: str, *, text_column: str = "text", entities: str | None = "entities") -> DataFrame:
    """``docs`` with personal data and secrets in whole texts replaced, and the replaced spans in the column ``entities`` (None:
    no such column).

    A surrogate depends on the key, the type and the value alone, so a value has the same one in all documents (also if
    written otherwise, where a type knows ways to write it), and tasks need not agree on anything: no shuffle, no table of
    values. Null texts stay null without entities; rows, order and other columns stay as they are; if the entities' name
    is taken, underscores are added to it; an empty table gives no row. Values of any length are replaced whole, in time
    linear in their length.
    """
    while entities in docs.columns:
        entities += "_"
    columns = docs.columns
    at, secret = columns.index(text_column), key.encode()
    schema = T.StructType([*docs.schema.fields, *([T.StructField(entities, ENTITY)] if entities else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, max(batch.num_rows, 1), 256):
                b = batch.slice(i, 256)
                texts, spans = [], []
                for (text,) in rows_of(iter([b.select([at])])):
                    new, own = (None, []) if text is None else replace_entities(text, secret)
                    texts.append(new)
                    spans.append([dict(zip(("start", "end", "type", "surrogate"), e, strict=True)) for e in own])
                cols = [*b.columns[:at], pa.array(texts, pa.string()), *b.columns[at + 1 :]]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(spans, _ARROW_ENTITY)] if entities else []), schema.names)

    return docs.mapInArrow(run, schema)


def collisions(replaced: DataFrame, original: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Surrogates, by type, that stand for more than one value in the corpus: the check across documents, empty for the kinds
    here. Values are compared as written, without separators and case."""
    spans = replaced.select(F.col(id_column).alias("id"), F.explode("entities").alias("e")).join(original.select(F.col(id_column).alias("id"), text_column), "id")
    plain = lambda c: F.lower(F.regexp_replace(c, r"[\s().+-]", ""))
    value = F.expr(f"substring({text_column}, e.start + 1, e.end - e.start)")
    rows = spans.select("e.type", plain(F.col("e.surrogate")).alias("surrogate"), plain(value).alias("value"))
    return rows.groupBy("type", "surrogate").agg(F.count_distinct("value").alias("values")).filter("values > 1")
