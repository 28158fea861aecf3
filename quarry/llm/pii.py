"""Surrogates for personal data: keyed, type-consistent replacements.

Detected are e-mail addresses, telephone numbers, IPv4 addresses, payment cards,
IBANs, US social-security numbers, long hexadecimal secrets and names behind a
form of address, with all other mentions of these names, whole or one word of them,
in the same document. Each value is replaced by another of its kind under a secret key:

* digits stay digits, letters stay letters of their script, alphabet and case, separators,
  lengths, country codes and top-level domains stay; an IPv4 address becomes
  another, a card keeps whether its check digit is right;
* a given name that is known becomes a known one of the same gender and script, in
  whatever place of a name it stands; other words of names keep which letters are
  vowels. A word of a name has one surrogate wherever it occurs, so that later
  mentions of one part still refer to the same person.

Every mapping is a keyed permutation of the values of one shape (a Feistel network
with cycle walking), turned by one place so that no value stays what it is.
Distinct values therefore get distinct surrogates, and equal values equal ones in
all documents, without any table of what was seen. ``collided`` checks this in
every document as it is replaced, ``collisions`` over the entities of a whole corpus.

The key is a parameter, or the session's ``spark.quarry.surrogates.key``. Who has it
can turn surrogates back. Without either the key of this file is taken, with a
warning: it is published and only fit for tests.

Defined cases: a null text stays null, an empty one empty; null ids and repeated
rows pass through; of overlapping finds (ties) the kind listed first is taken; a very
long text is read whole, in time that grows with its length; texts without personal
data stay byte for byte; an empty table gives an empty result; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import warnings
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, small_batches

KEY = "quarry-surrogates"
KEY_SETTING = "spark.quarry.surrogates.key"

PATTERNS = {
    "email": re.compile(r"(?<![\w.+%-])[\w.+%-]+@(?:[\w-]+\.)+[^\W\d_]{2,24}(?![\w@-])"),
    "secret": re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    "phone": re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\w|-\d)"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "card": re.compile(r"(?<![\w-])(?:\d{4}[ -]?){3}\d{1,4}(?![\w-])"),
    "name": re.compile(r"\b(?:Mr|Mrs|Ms|Miss|Sir|Madam|Herr|Frau|Mme|Mlle|Monsieur|Madame|Sr|Sra|Don|Doña|Señor|Señora)\.? ([^\W\d_](?:(?!['’]s\b)['’-]?[^\W\d_])+(?: [^\W\d_a-zß-öø-ÿ](?:(?!['’]s\b)['’-]?[^\W\d_])+)?)"),
}
#: Known given names by gender; a surrogate is of the same list.
GIVEN = {
    "f": "Anna Maria Emma Laura Julia Sophie Claire Camille Lucia Carmen Elena Sarah Emily Olivia Hannah Lena Marie Alice Irene Clara".split(),
    "m": "John James Peter Paul Lukas Jonas Felix Louis Hugo Jules Carlos Javier Miguel David Daniel Thomas Martin Simon Oscar Leon".split(),
}
#: Letters that are exchanged only among themselves.
_ALPHABETS = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "áàâäãåæéèêëíìîïóòôöõøœúùûüý", "çñß",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρσςτφχψ",
]
_PLACE = {ch: (a, k) for a, alphabet in enumerate(_ALPHABETS) for k, ch in enumerate(alphabet)}
_LABELS = [chr(65 + a) for a in range(len(_ALPHABETS))]
_SCRIPTS: set[tuple[str, str, int]] = set()


def _shape(ch: str) -> tuple[str, str, int]:
    """Category, script and range of a sign."""
    return unicodedata.category(ch), unicodedata.name(ch, "").split(" ")[0], ord(ch).bit_length()


def _place(ch: str) -> tuple[int, int] | None:
    """(alphabet, place) of a sign in lower case: those above, or what has its shape; None if it stays."""
    if ch in _PLACE or len(ch) != 1 or not (ch.isalpha() or ch.isdecimal()):
        return _PLACE.get(ch)
    shape = _shape(ch)
    if shape not in _SCRIPTS:
        own = [x for x in map(chr, range(1 << shape[2] - 1, 1 << shape[2])) if x not in _PLACE and _shape(x) == shape]
        # only letters that come back from their upper case
        own = [x for x in own if shape[0] != "Ll" or (len(x.upper()) == 1 and x.upper() != x and x.upper().lower() == x)]
        _SCRIPTS.add(shape)
        _ALPHABETS.append("".join(own))
        _LABELS.append(repr(shape))
        _PLACE.update((x, (len(_ALPHABETS) - 1, k)) for k, x in enumerate(own))
    return _PLACE.get(ch)


class Permutation:
    """A keyed permutation of 0..n-1 without fixed point, if n > 1."""

    rounds = 8

    def __init__(self, key: bytes, n: int, tweak: str):
        self.n, self.half = n, max(1, ((n - 1).bit_length() + 1) // 2)
        self.key = hashlib.blake2b(key, digest_size=32, person=b"quarry").digest()
        self.tweak = f"{tweak}/{n:x}".encode()

    def _round(self, k: int, x: int) -> int:
        size = (self.half + 7) // 8
        data = self.tweak + bytes([k]) + x.to_bytes(size, "big")
        digest = hashlib.blake2b(data, key=self.key, digest_size=min(64, size)).digest()
        while len(digest) < size:
            digest += hashlib.blake2b(digest, key=self.key, digest_size=64).digest()
        return int.from_bytes(digest[:size], "big") & ((1 << self.half) - 1)

    def _network(self, x: int, back: bool) -> int:
        a, b = x >> self.half, x & ((1 << self.half) - 1)
        for k in reversed(range(self.rounds)) if back else range(self.rounds):
            if back:
                a, b = b ^ self._round(k, a), a
            else:
                a, b = b, a ^ self._round(k, b)
        return a << self.half | b

    def _walk(self, x: int, back: bool) -> int:
        x = self._network(x, back)
        while x >= self.n:
            x = self._network(x, back)
        return x

    def __call__(self, x: int) -> int:
        """The value one place further in the secret order."""
        return self._walk((self._walk(x, False) + 1) % self.n, True) if self.n > 1 else x


class Surrogates:
    """value -> surrogate for every kind, under one key."""

    def __init__(self, key: str = KEY):
        self.key, self.known = key.encode(), {}

    def of(self, kind: str, value: str) -> str:
        made = self.known.get((kind, value))
        if made is None:
            if len(self.known) > 200_000:
                self.known.clear()
            own = getattr(self, f"_{kind}", None)
            made = self.known[kind, value] = own(value) if own else self._signs(value, kind)
        return made

    def _signs(self, value: str, kind: str, keep: Callable[[int], bool] = lambda k: False) -> str:
        """Exchanges digits and letters inside their alphabets; case and all else stay."""
        spots = [(k, *p) for k, ch in enumerate(value) if not keep(k) and (p := _place(ch.lower()))]
        n, x = 1, 0
        for _, a, place in spots:
            n, x = n * len(_ALPHABETS[a]), x * len(_ALPHABETS[a]) + place
        x = Permutation(self.key, n, kind + "/" + "".join(_LABELS[a] for _, a, _ in spots))(x)
        out = list(value)
        for k, a, _ in reversed(spots):
            x, place = divmod(x, len(_ALPHABETS[a]))
            ch = _ALPHABETS[a][place]
            out[k] = ch.upper() if value[k] != value[k].lower() and len(ch.upper()) == 1 else ch
        return "".join(out)

    def _secret(self, value: str) -> str:
        x = Permutation(self.key, 16 ** len(value), "secret")(int(value, 16))
        made = f"{x:0{len(value)}x}"
        return made.upper() if value != value.lower() else made

    def _email(self, value: str) -> str:
        end = value.rindex(".")
        return self._signs(value, "email", keep=lambda k: k >= end)

    def _phone(self, value: str) -> str:
        code = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", value)
        end = code.end() if code else 0
        return self._signs(value, "phone" + (code[0] if code else ""), keep=lambda k: k < end)

    def _iban(self, value: str) -> str:
        plain = value.replace(" ", "")
        inner = self._signs(plain[:2] + plain[4:], "iban", keep=lambda k: k < 2)
        remainder = lambda check: int("".join(str(int(c, 36)) for c in inner[2:] + inner[:2] + check)) % 97
        right = int("".join(str(int(c, 36)) for c in plain[4:] + plain[:2] + "00")) % 97
        # as far from the right check digits as the original's are
        off = (int(plain[2:4]) - (98 - right)) % 100
        made = inner[:2] + f"{((98 - remainder('00')) + off) % 100:02d}" + inner[2:]
        places = iter(made)
        return "".join(ch if ch == " " else next(places) for ch in value)

    def _ip(self, value: str) -> str:
        a, b, c, d = map(int, value.split("."))
        x = Permutation(self.key, 1 << 32, "ip")(a << 24 | b << 16 | c << 8 | d)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))

    def _card(self, value: str) -> str:
        digits = re.sub(r"\D", "", value)
        x = Permutation(self.key, 10 ** (len(digits) - 1), "card")(int(digits[:-1]))
        made = f"{x:0{len(digits) - 1}d}"
        # the last digit is as far from the right one as the original's
        last = (_check_digit(made) + int(digits[-1]) - _check_digit(digits[:-1])) % 10
        places = iter(f"{made}{last}")
        return "".join(chr(ord(ch) - int(ch) + int(next(places))) if ch.isdecimal() else ch for ch in value)

    def _name(self, value: str) -> str:
        return " ".join(self._word(p) for p in value.split(" "))

    def _word(self, word: str) -> str:
        """A known given name of the same gender for a known one, else another word of the same shape that is none.

        Both sets are mapped onto themselves, so distinct words stay distinct.
        """
        for gender, known in GIVEN.items():
            if word in known:
                return known[Permutation(self.key, len(known), "given" + gender)(known.index(word))]
        made = self._signs(word, "word")
        while any(made in known for known in GIVEN.values()):
            made = self._signs(made, "word")
        return made


def _check_digit(digits: str) -> int:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal data in a text; of overlapping finds the earlier kind."""
    starts: list[int] = []
    taken: list[tuple[int, int, str]] = []
    for kind, pattern in PATTERNS.items():
        if kind == "email" and "@" not in text:
            continue
        fresh = []
        for m in pattern.finditer(text):
            a, b = m.span(1) if kind == "name" else m.span()
            if kind == "card" and not 13 <= sum(ch.isdigit() for ch in m[0]) <= 19:
                continue
            if _free(a, b, starts, taken):
                fresh.append((a, b, kind))
        # finds of one pattern do not overlap each other
        taken = sorted([*taken, *fresh])
        starts = [x[0] for x in taken]
    return sorted([*taken, *_mentions(text, starts, taken)])


def _free(a: int, b: int, starts: list[int], taken: list[tuple[int, int, str]]) -> bool:
    """Whether a span overlaps none of the sorted, disjoint ones."""
    k = bisect_right(starts, a)
    return not (k and taken[k - 1][1] > a) and not (k < len(starts) and starts[k] < b)


def _mentions(text: str, starts: list[int], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The names found in a text, whole or one word of them, wherever else they stand in it."""
    # a word in lower case is hardly a name
    words = {part for a, b, kind in taken if kind == "name" for part in (text[a:b], *text[a:b].split(" ")) if not part[0].islower()}
    if not words:
        return []
    # whole words are looked up, so that the time does not grow with the number of names
    longest = max(w.count(" ") for w in words) + 1
    places = [m.span() for m in _WORDS.finditer(text)]
    found, k = [], 0
    while k < len(places):
        for n in range(min(longest, len(places) - k), 0, -1):
            a, b = places[k][0], places[k + n - 1][1]
            if text[a:b] in words:
                break
            # a form like "Miller's" is its name and an ending
            bare = re.match(r"(.+)['’]\w*$", text[a:b], re.S)
            if bare and bare[1] in words:
                b = a + len(bare[1])
                break
        else:
            k += 1
            continue
        if _free(a, b, starts, taken):
            found.append((a, b, "name"))
        k += n
    return found


_WORDS = re.compile(r"\w+(?:['’-]\w+)*")


def replaced(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, value, surrogate) of each entity."""
    out, at, made = [], 0, []
    for a, b, kind in entities(text):
        new = surrogates.of(kind, text[a:b])
        out += [text[at:a], new]
        at = b
        made.append((kind, text[a:b], new))
    return "".join([*out, text[at:]]), made


def collided(made: list[tuple[str, str, str]]) -> int:
    """Values that share a kind's surrogate with another value, or have several: 0, if all is well."""
    pairs = {*made}
    values = len({(kind, value) for kind, value, _ in pairs})
    return len(pairs) - values + len(pairs) - len({(kind, new) for kind, _, new in pairs})


_ENTITIES = "array<struct<kind:string,value:string,surrogate:string>>"


def key_of(spark: SparkSession) -> str:
    """The session's key; that of this file, with a warning, where it has none."""
    key = spark.conf.get(KEY_SETTING, None)
    if key is None:
        warnings.warn(f"{KEY_SETTING} is not set: surrogates are made with a published key", stacklevel=3)
    return key or KEY


def surrogate_texts(df: DataFrame, key: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, n_entities, n_collisions, entities) for each row; ``text`` has the surrogates."""
    small_batches(df.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string()), ("surrogate", pa.string())]))
    key = key or key_of(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in rows_of(batches):
            own, found, broken = [], [], []
            for text in batch.column("text").cast(pa.large_string()).to_pylist():
                new, made = replaced(text, surrogates) if text else (text, [])
                own.append(new)
                broken.append(collided(made))
                found.append([dict(zip(("kind", "value", "surrogate"), x)) for x in made])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(own, pa.string()), pa.array([len(x) for x in found], pa.int64()), pa.array(broken, pa.int64()), pa.array(found, kind)],
                names=["doc_id", "text", "n_entities", "n_collisions", "entities"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, text string, n_entities long, n_collisions long, entities {_ENTITIES}")


def collisions(replaced_texts: DataFrame) -> DataFrame:
    """Surrogates that stand for several values, or values with several surrogates: none, if all is well."""
    each = replaced_texts.select(F.explode("entities").alias("e")).select("e.*").distinct()
    several = each.groupBy("kind", F.col("surrogate").alias("x")).count().where("count > 1")
    split = each.groupBy("kind", F.col("value").alias("x")).count().where("count > 1")
    return several.unionByName(split)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return surrogate_texts(docs).select("doc_id", "n_entities", "n_collisions", "text", F.transform("entities", lambda e: e["kind"]).alias("kinds"))
