"""PII surrogates: detected entities get keyed, type-consistent replacements.

Each character class of an entity is enciphered in place by a keyed format-preserving permutation: digits stay digits,
letters stay letters of their alphabet and case, punctuation stays. A permutation never maps two entities of one format
to one surrogate, and the same entity always maps to the same one, so distinctness and coreference hold corpus-wide
without a shared table. Separators of phone, card and IBAN numbers take no part: two notations of one number get one
number in two notations. Country codes stay; check digits stay right where they were right and wrong where they were wrong.
A name is mapped word by word. Listed first names map within their gender's list; in all other words vowels map to vowels
and consonants to consonants, and a final vowel, which often tells a given name's gender, stays. Words of a name that
a title announces are replaced in the whole text, with or without the title.

Collision check: a surrogate that equals its original, or that has a form of its own rule (a listed first name for another
word, a valid address for an invalid one), is never given: the permutations are single keyed cycles without fixed points,
and such values are walked over along the cycle, which keeps the map one-to-one.

Null texts stay null; empty texts have no entities; very long texts are read whole; of overlapping entities the leftmost
counts, then the earlier pattern; repeated rows get equal replacements. An empty table gives an empty result. An own column
named ``pii`` is replaced.
"""

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, quoted, small_batches, unboxed

# Capitals, and the titles that announce a name.
CAPITAL = "[A-ZÀ-ÖØ-ÞŒŠŽΑ-ΩА-ЯЁ]"
TITLES = [r"Mr\.", r"Mrs\.", r"Ms\.", "Herr", "Herrn", "Frau", r"M\.", "Mme", "Mlle", "Monsieur", "Madame", r"Sr\.", r"Sra\.", r"Srta\.", "Señor", "Señora"]
# Lower-case words inside names; they stay.
PARTICLES = ["da", "de", "del", "den", "der", "di", "du", "la", "le", "van", "von", "zu"]
_WORD = rf"{CAPITAL}(?:\w+(?:['’-]\w+)*|['’]\w+(?:-\w+)*)"
_NAME = rf"(?:{CAPITAL}\. )?{_WORD}(?: (?:(?:{'|'.join(PARTICLES)}) ){{0,2}}(?:{CAPITAL}\. )?{_WORD})?"
# Entity patterns, in order of precedence.
PATTERNS = [
    ("email", r"[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("secret", r"(?:(?<=token = \")|(?<=key = \")|(?<=secret = \")|(?<=password = \"))[A-Za-z0-9+/_-]{8,}|\bAKIA[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\b[0-9a-f]{40}\b"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("ip", r"\b\d{1,3}(?:\.\d{1,3}){3}\b"),
    ("card", r"\b(?:\d[ -]?){13,19}\b"),
    ("phone", r"(?<!\w)\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}\b|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}\b|\b\d{3}[-. ]\d{3}[-. ]\d{4}\b"),
    ("name", rf"(?={CAPITAL})(?:" + "|".join(rf"(?<=\b{t} )" for t in TITLES) + rf"){_NAME}"),
]
# First names by gender; a name maps within its list.
NAMES = {
    "f": [
        "Alice", "Amelia", "Anna", "Anne", "Barbara", "Birgit", "Camille", "Carla", "Carmen", "Caroline", "Catherine", "Charlotte", "Chloé", "Claire",
        "Clara", "Diana", "Elena", "Elizabeth", "Emily", "Emma", "Eva", "Florence", "Grace", "Hannah", "Heike", "Helen", "Ingrid", "Isabel", "Jane",
        "Jennifer", "Julia", "Julie", "Karin", "Katharina", "Laura", "Léa", "Linda", "Lucía", "Lucy", "Manon", "Margaret", "María", "Maria", "Marie",
        "Marta", "Mary", "Monika", "Nancy", "Olivia", "Patricia", "Petra", "Pilar", "Rachel", "Renate", "Rosa", "Ruth", "Sabine", "Sarah", "Sofia",
        "Sophie", "Susan", "Teresa", "Ursula",
    ],
    "m": [
        "Alejandro", "Andrew", "Anthony", "Antoine", "Antonio", "Bernd", "Brian", "Carlos", "Charles", "Christopher", "Claude", "Daniel", "David",
        "Diego", "Dieter", "Edward", "Emil", "Fernando", "François", "Frank", "Friedrich", "George", "Hans", "Heinrich", "Henry", "Hugo", "Jack",
        "Jacques", "James", "Javier", "Jean", "Johann", "John", "Jorge", "José", "Joseph", "Juan", "Julien", "Jürgen", "Karl", "Klaus", "Louis",
        "Luis", "Manuel", "Marc", "Mark", "Martin", "Michael", "Miguel", "Olivier", "Pablo", "Paul", "Pedro", "Peter", "Philippe", "Pierre",
        "Richard", "Robert", "Stefan", "Thomas", "Uwe", "William", "Wolfgang",
    ],
}
# Alphabets by script.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя"]
ALPHABETS = ALPHABETS + [a.upper() for a in ALPHABETS[1:]]
# Vowels of these alphabets, and calling codes of one and of two digits (all others have three).
VOWELS = "aeiouAEIOUαεηιουωΑΕΗΙΟΥΩаеёиоуыэюяАЕЁИОУЫЭЮЯ"
CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Kinds whose separators say nothing.
LOOSE = {"phone", "card", "iban"}
#: What a text must hold for a kind to occur in it at all: most texts hold little of it, and a pattern that cannot match is not tried.
NEEDED = {
    "email": re.compile("@"), "secret": re.compile(r"(?:token|key|secret|password) = \"|AKIA|gh[pousr]_|[0-9a-f]{40}"), "iban": re.compile(r"[A-Z]{2}[0-9]{2}"), "ssn": re.compile(r"\d-\d"),
    "ip": re.compile(r"\d\.\d"), "card": re.compile(r"\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d"), "phone": re.compile(r"\d[- .]?\(?\d"), "name": re.compile("|".join(rf"{t} " for t in TITLES)),
}
HEX = "0123456789abcdef"


@lru_cache(1 << len(PATTERNS))
def _finder(kinds: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS if k in kinds))


def entities(text: str):
    """Matches of all patterns, leftmost first, then by precedence."""
    kinds = tuple(k for k, p in NEEDED.items() if p.search(text))
    return _finder(kinds).finditer(text) if kinds else ()


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): an eight-round Feistel network with cycle walking."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = value >> half, value & mask
        for r in range(8):
            d = hmac.new(key, f"{tweak}|{r}|{half}|{b}".encode(), hashlib.blake2b).digest()
            a, b = b, a ^ (int.from_bytes(d, "big") & mask)
        value = a << half | b
        if value < size:
            return value


def _unpermute(value: int, size: int, key: bytes, tweak: str) -> int:
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = value >> half, value & mask
        for r in reversed(range(8)):
            d = hmac.new(key, f"{tweak}|{r}|{half}|{a}".encode(), hashlib.blake2b).digest()
            a, b = b ^ (int.from_bytes(d, "big") & mask), a
        value = a << half | b
        if value < size:
            return value


def derange(value: int, size: int, key: bytes, tweak: str) -> int:
    """The next value in a keyed order of range(size): one-to-one, and never ``value`` itself."""
    return value if size < 2 else _unpermute((permute(value, size, key, tweak) + 1) % size, size, key, tweak)


@lru_cache(1 << 16)
def _letters(c: str) -> str | None:
    """The alphabet of a letter or digit; beyond the fixed ones, its like in its block of 256 characters."""
    fixed = next((a for a in ALPHABETS if c in a), None)
    kind = unicodedata.category(c)
    if fixed or kind[0] != "L" and kind != "Nd":
        return fixed
    start, known = ord(c) & ~255, "".join(ALPHABETS)
    return "".join(x for x in map(chr, range(start, start + 256)) if unicodedata.category(x) == kind and x not in known)


def _alphabet(c: str, kind: str, original: str) -> str | None:
    if kind == "secret" and set(original) <= set(HEX):
        return HEX
    letters = _letters(c)
    if kind == "name" and letters in ALPHABETS[1:]:
        return "".join(x for x in letters if (x in VOWELS) == (c in VOWELS))
    return letters


def _once(entity: str, kind: str, key: bytes) -> str:
    alphabets, check = [_alphabet(c, kind, entity) for c in entity], ()
    if kind == "email":  # the ending stays, so that the surrogate is a well-formed address of the same kind
        last = entity.rindex(".")
        alphabets[last:] = [None] * (len(entity) - last)
    if kind == "phone" and entity[:1] == "+":  # country calling code stays
        at = [i for i, c in enumerate(entity) if c.isdigit()]
        stop = next((n for n in (1, 2) if "".join(entity[i] for i in at[:n]) in CODES), 3)
        for i in at[:stop]:
            alphabets[i] = None
    if kind == "iban":  # country stays
        alphabets[:2], check = [None] * 2, (2, 3)
    if kind == "card":
        check = (max(i for i, c in enumerate(entity) if c.isdigit()),)
    for i in check:  # check digits follow from the rest
        alphabets[i] = None
    if kind == "name" and len(entity) > 2 and entity[-1] in VOWELS:
        alphabets[-1] = None
    value, size = 0, 1
    for c, a in zip(entity, alphabets):
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    said = [(c, a) for i, (c, a) in enumerate(zip(entity, alphabets)) if i not in check and (a or c == "+" or c.isalnum() or kind not in LOOSE)]
    shape = "".join(f"<{a[0]}{len(a)}>" if a else c for c, a in said)
    value, out = derange(value, size, key, f"{kind}|{shape}"), []
    for c, a in zip(reversed(entity), reversed(alphabets)):
        if a:
            value, i = divmod(value, len(a))
            c = a[i]
        out.append(c)
    return "".join(reversed(out))


def _luhn(digits: str) -> str:
    """The check digit that follows ``digits``."""
    odd = [int(c) for c in digits[::-1]]
    return str(-sum(x if i % 2 else sum(divmod(2 * x, 10)) for i, x in enumerate(odd)) % 10)


def iban_check(iban: str) -> int:
    """The two check digits that an IBAN without blanks ought to have."""
    return 98 - int("".join(str(int(c, 36)) for c in iban[4:] + iban[:2] + "00")) % 97


def _valid_ip(s: str) -> bool:
    return all(x.isascii() and str(int(x)) == x and int(x) < 256 for x in s.split("."))


def _reserved(s: str, kind: str) -> bool:
    return kind == "name" and any(s in names for names in NAMES.values()) or kind == "ip" and _valid_ip(s)


def _word(word: str, key: bytes) -> str:
    if word in PARTICLES:
        return word
    for g, names in NAMES.items():
        if word in names:
            return names[derange(names.index(word), len(names), key, f"first|{g}")]
    return _walk(word, "name", key)


@lru_cache(1 << 16)
def surrogate(entity: str, kind: str, key: bytes) -> str:
    """The replacement of an entity: same kind, format and script; one-to-one per kind and format."""
    if kind == "name":  # every word alone, so that a surname keeps its surrogate with and without a first name
        return re.sub(r"\w+", lambda m: _word(m.group(), key), entity)
    if kind == "ip" and _valid_ip(entity):
        n = derange(sum(int(x) << 8 * (3 - i) for i, x in enumerate(entity.split("."))), 1 << 32, key, "ip")
        return ".".join(str(n >> 8 * (3 - i) & 255) for i in range(4))
    s = _walk(entity, kind, key)
    if kind == "card":  # the last digit keeps its distance from the check digit
        old, new = ("".join(c for c in x if c.isdigit()) for x in (entity, s))
        last = max(i for i, c in enumerate(entity) if c.isdigit())
        return f"{s[:last]}{(int(_luhn(new[:-1])) + int(old[-1]) - int(_luhn(old[:-1]))) % 10}{s[last + 1:]}"
    if kind == "iban":
        old, new = entity.replace(" ", ""), s.replace(" ", "")
        return f"{s[:2]}{(iban_check(new) + int(old[2:4]) - iban_check(old)) % 100:02d}{s[4:]}"
    return s


def _walk(entity: str, kind: str, key: bytes) -> str:
    s = _once(entity, kind, key)
    while _reserved(s, kind) and s != entity:
        s = _once(s, kind, key)
    return s


def mentions(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans, and between them every further mention of a word of three or more letters of a name that they hold."""
    words = {w for kind, a, b in spans if kind == "name" for w in re.findall(r"\w{3,}", text[a:b]) if w not in PARTICLES}
    if not words:
        return spans
    ends = [0, *(b for _, _, b in spans)]
    more = [("name", m.start(), m.end()) for m in re.finditer(rf"\b{CAPITAL}\w+", text) if m.group() in words]
    out = list(spans)
    for span in more:
        i = bisect_right(spans, span[1], key=lambda s: s[1])
        if span[1] >= ends[i] and (i == len(spans) or span[2] <= spans[i][1]):
            out.append(span)
    return sorted(out, key=lambda s: s[1])


def replace(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with surrogates, and (kind, start, end, surrogate) of each entity in the original text."""
    spans, out, at = [], [], 0
    for kind, a, b in mentions(text, [(m.lastgroup, *m.span()) for m in entities(text)]):
        s = surrogate(text[a:b], kind, key)
        spans.append((kind, a, b, s))
        out += [text[at:a], s]
        at = b
    return "".join([*out, text[at:]]), spans


def anonymize(docs: DataFrame, key: bytes = b"a key of the user's own", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced and ``pii``: array of (kind, begin, end, surrogate)."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("text string, pii array<struct<kind:string,begin:int,end:int,surrogate:string>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            rows = []
            for t in s:
                new, spans = (None, []) if t is None else replace(t, key)
                rows.append((new, [dict(zip(("kind", "begin", "end", "surrogate"), x)) for x in spans]))
            yield pd.DataFrame(rows, columns=["text", "pii"])

    done = docs.select(boxed(docs), run(F.col(quoted(text))).alias("_p"))
    done = done.select(F.col("_row").withField(quoted(text), F.col("_p.text")).alias("_row"), "_p")
    return done.select(*unboxed(docs.columns, ("pii", F.col("_p.pii"))))
