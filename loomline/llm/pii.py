"""Personal information in free text, replaced by typed placeholders (problem 5).

Method: regular expressions propose spans; validators confirm them (digit counts, check letters and digits of identity
numbers; mod 97 for bank accounts and Luhn for payment cards, which then are kept from being read as phone or identity
numbers); words nearby raise or lower the score, and spans from ``THRESHOLD`` on are taken, the better score first
where they overlap. Numbers and addresses read aloud are spelt out digit by digit before they are judged.

Two neighbouring words are a name if the corpus knows both as parts of names; after a title one word is enough. Parts of
names are those of the table of known persons, and parts of e-mail addresses with a second witness: texts mostly write
them with a capital letter away from sentence starts, or, where none uses them alone in lower case, they stand beside a
part that has such a witness, in an address or a text. ``support@`` teaches nothing where texts write "our support".

Scale: three maps over the texts, the first over those with addresses only; between them, parts and their counts are
aggregated. Known parts are shipped as a filter sized by their number, at ``BITS_PER_PART`` bits each, which takes a word for a part
by mistake once in a million; more than ``MAX_PARTS`` parts are refused. Texts of one record are judged independently,
so a record with a third of all lines needs no grouping.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import checkpointed

THRESHOLD = 0.5
#: Size of the filter of name parts for each part, its number of hashes, and the most parts it takes.
BITS_PER_PART, HASHES, MAX_PARTS = 29, 20, 20_000_000
#: Of a part's uses in texts that have capitals, at least this share must be capitalised.
CAPITAL_SHARE = 1 / 3
#: Parts a task counts before it hands them on.
MAX_COUNTED = 100_000
#: Texts are searched in windows of so many characters with so many more on both sides, which no span exceeds; some patterns cost the square of what they look at.
WINDOW, MARGIN = 8_192, 1_024
#: Characters before and after a span in which words count as its context.
REACH = 48

TYPES = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

# Words read aloud for digits and numbers, titles, street words, and ends of spoken addresses.
DIGITS = {"zero": "0", "oh": "0", "o": "0", "null": "0", "cero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
REPEATS = {"double": 2, "triple": 3}
TENS = "ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|(?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)(?:[ -](?:one|two|three|four|five|six|seven|eight|nine))?"
TITLES = "mr|mrs|ms|miss|mx|dr|prof|professor|doctor|sir|frau|herr|dr|sr|sra|señor|señora|don|doña"
PLAIN_TITLES = {"mr", "mrs", "ms", "miss", "mx", "dr", "prof", "professor", "doctor", "señor", "señora"}
STRONG_STREETS = "street|road|lane|avenue|boulevard|terrace|crescent"
WEAK_STREETS = "st|rd|ln|ave|blvd|close|court|ct|drive|dr|way|place|pl|square|sq|row|hill|gardens"
GERMAN_STREETS = "straße|strasse|str\\.|weg|gasse|allee|platz|ufer|damm"
SPANISH_STREETS = "calle|c/|avenida|avda\\.?|plaza|paseo|camino"
DOMAIN_ENDS = "example|test|invalid|localhost|com|org|net|edu|gov|info|biz|eu|io|co|ai|app|dev|de|es|uk|us|at|ch|fr|it|nl|pl|mx|ar|ca|au"
#: Small words that are never part of a street's name.
SMALL = "a|an|the|of|on|in|at|to|for|from|with|and|or|by|is|was|were|we|it|i|you|he|she|they|der|die|das|el|la|los|las|un|una|und|y|de|minutes|hours|days|pages|remarks|questions|open"

_HUM = r"(?:u+[hm]+m*|e+r+m*|[äe]+h+m*|e+u+h+|h*m{2,})(?:\.{3}|,|\s-)?"
#: Space between spoken parts; hesitations and a comma may stand in it.
_GAP = rf"(?:,?\s+(?:{_HUM}\s+)*)"
_L = r"[^\W\d_]"
_NAME_WORD = rf"{_L}+(?:['’-]{_L}+)*"

_EMAIL = re.compile(rf"(?<![\w.+-])[\w.+%'-]*\w@\w[\w-]*(?:\.[\w-]+)*\.[^\W\d_]{{2,}}")
_EMAIL_MASKED = re.compile(rf"(?<![\w.+-])[\w.+-]*\w\s?[\[({{]\s?at\s?[\])}}]\s?\w[\w-]*(?:\s?[\[({{]\s?dot\s?[\])}}]\s?[\w-]+)+", re.I)
_EMAIL_SPOKEN = re.compile(rf"(?<![\w.-])\w+(?:{_GAP}(?:dot|underscore|dash|hyphen|minus|plus|punkt|punto){_GAP}\w+)*{_GAP}at{_GAP}\w+(?:{_GAP}(?:dash{_GAP}\w+{_GAP})?dot{_GAP}\w+)*?{_GAP}dot{_GAP}(?:{DOMAIN_ENDS})\b(?!{_GAP}dot\b)", re.I)

_DIGIT_WORD = "(?:" + "|".join(sorted({*DIGITS, *REPEATS}, key=len, reverse=True)) + ")"
_SPOKEN = re.compile(rf"\b(?:plus{_GAP})?{_DIGIT_WORD}(?:{_GAP}{_DIGIT_WORD})+\b", re.I)
_PHONE = re.compile(
    r"(?<![\w@.#/-])(?:"
    r"(?P<intl>(?:\+|00)\d{1,3}[ .\-/]?(?:\(0?\d{1,4}\)[ .\-/]?)?\d{2,14}(?:[ .\-/]\d{2,8}){0,4})"
    r"|(?P<area>\(\d{2,5}\)[ .\-/]?\d{3,8}(?:[ .\-]\d{2,6}){0,3})"
    r"|(?P<trunk>0\d{2,5}(?:[ ]\d{2,8}){1,3}|0\d{9,11})"
    r"|(?P<us>\d{3}([.\- ])\d{3}\5\d{4})"
    r"|(?P<local>\d{3}-\d{4})"
    r")(?![\w@]|[.\-/]\d)"
)
_ID_NINO = re.compile(r"(?<![\w-])[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D](?![\w-])", re.I)
_ID_SSN = re.compile(r"(?<![\w./-])\d{3}([- ])\d{2}\1\d{4}(?![\w/-]|\.\d)")
_ID_WORDS = r"(?:passport|reisepass|pasaporte|driv(?:ing|er'?s?)(?:[ -]licen[cs]e)?|licen[cs]e|führerschein|carn[eé]t?(?: de conducir)?|permiso de conducir|tax(?: (?:id|number|no\.?))?|steuer(?:-?id|nummer)|nif|dni|social security|(?:social |health )?insurance(?= (?:number|no|nr|id))|social insurance|sozialversicherung\w*|seguridad social|national insurance|ssn|nino|itin)"
_ID_LABEL = rf"{_ID_WORDS}(?:\s+(?:number|no\.?|nr\.?|num\.?|nummer|número|id|code))?(?:\s+is|\s+ist|\s+es)?\s*[:#]?"
_ID_NAMED = re.compile(rf"\b(?P<label>{_ID_LABEL})[\s_*`]*(?P<id>(?:[A-Z]{{1,3}}[ -]?)?\d(?:[ -]?\d){{4,13}}(?:[ -]?[A-Z]\b)?)(?![\w])", re.I)
_ID_SPOKEN = re.compile(rf"\b(?P<label>{_ID_LABEL})\s+(?P<id>(?:(?:{_L}|double\s+{_L}){_GAP}){{0,4}}{_DIGIT_WORD}(?:{_GAP}{_DIGIT_WORD}){{4,13}}(?:{_GAP}{_L}\b)?)\b", re.I)
_ID_SHAPE = re.compile(r"(?<![\w-])(?:[A-Z]{1,2}\d{7,8}|[A-Z]{2}-\d{4}-\d{4}|\d{2}-\d{7}|\d{8}[A-Z]|[XYZ]\d{7}[A-Z]|\d{11})(?![\w-]|\.\d)")

_ACCOUNT = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![\w-])", re.I)
_CARD = re.compile(r"(?<![\w+.-])\d(?:[ -]?\d){12,18}(?![\w-])")

_HOUSE = rf"(?:\d{{1,4}}[a-z]?|{TENS}|(?:one|two|three|four|five|six|seven|eight|nine)(?: hundred(?: and)?(?: (?:{TENS}))?)?)"
_STREET_NAME = rf"(?:(?!(?:{SMALL})\b){_NAME_WORD}\s+){{1,3}}?"
_CAP = rf"(?-i:[A-ZÄÖÜ]){_NAME_WORD}"
_TOWN = rf"(?:,?\s+\d{{4,5}}\s+{_CAP}(?:[ ]{_CAP})?|,\s+{_CAP}(?:[ ]{_CAP})?)?"
_FLAT = r"(?:(?:flat|apartment|apt\.?|unit|suite)\s+\w{1,4},?\s+)?"
_ADDRESS = re.compile(rf"(?<![\w.-]){_FLAT}(?P<house>{_HOUSE}),?\s+(?P<street>{_STREET_NAME})(?P<kind>{STRONG_STREETS}|{WEAK_STREETS})\b\.?(?P<town>{_TOWN})", re.I)
_ADDRESS_DE = re.compile(rf"\b{_FLAT}(?:{_L}[\w-]*(?:{GERMAN_STREETS})|{_L}[\w-]+\s(?:Straße|Strasse|Weg|Platz|Allee))\s+(?P<house>\d{{1,4}}\s?[a-z]?)\b(?P<town>{_TOWN})", re.I)
_ADDRESS_ES = re.compile(rf"\b(?:{SPANISH_STREETS})\s+(?:(?:de|del|la|las|los|el)\s+)*(?:{_NAME_WORD}\s+){{1,3}}?,?\s*(?:n[.º°]*\s*)?(?P<house>\d{{1,4}}[a-z]?)\b(?P<town>{_TOWN})", re.I)

_TITLED = re.compile(rf"(?<![\w@.-])(?P<title>{TITLES})\b\.?\s+(?:(?:{TITLES})\b\.?\s+)?(?:{_L}\.\s+){{0,2}}(?P<words>{_NAME_WORD}(?:\s+{_NAME_WORD})?)", re.I)
_TOKEN = re.compile(rf"(?!{_HUM}(?!\w)){_L}+(?:['’-](?!s\b){_L}+)*", re.I)
_JOIN = re.compile(rf"{_GAP[:3]}{_GAP[5:]}(?:{_L}\.?\s+(?:{_HUM}\s+)*)?\Z", re.I)
_INVERTED = re.compile(r",\s+\Z")

CONTEXT = {
    "phone": (re.compile(r"\b(?:call|ring|rang|phone|tel|telephone|mobile|number|text|try|reach|get through|dial|fax|nummer|anruf\w*|telefon|número|móvil|llam\w+)\b", re.I), re.compile(r"\b(?:invoice|order|ticket|version|serial|reference|slide|room|chapter|split|press|file|page|id|passport|licen[cs]e|tax|insurance|security)\b", re.I)),
    "id_number": (re.compile(rf"\b{_ID_WORDS}\b|\b(?:id|card|carries|clerk|form|entry|file|copied)\b", re.I), re.compile(r"\b(?:invoice|order|ticket|version|serial|reference|slide|room|chapter)\b", re.I)),
    "address": (re.compile(r"\b(?:lives?|living|address|moved|deliver\w*|parcel|bill|keys|meet|door|short walk|from|adresse|wohn\w*|dirección|vive|vivo)\b", re.I), re.compile(r"\b(?:chapter|page|slide|version|planted)\b", re.I)),
}


#: Underscores of Markdown emphasis, read as spaces.
_EMPHASIS = re.compile(r"(?<![^\W_])_|_(?![^\W_])")


# What a text must hold for a pattern to match at all; looking for it is cheaper than the pattern.
_NUMBER = re.compile(r"\d")
_ID_HINTS = ("passport", "reisepass", "pasaporte", "licen", "driv", "führerschein", "carn", "permiso", "tax", "steuer", "nif", "dni", "social", "sozial", "insurance", "seguridad", "ssn", "nino", "itin")
_SIMPLE_WORD = re.compile(rf"{_L}+")
_STREET_WORDS = {w.casefold() for w in (STRONG_STREETS + "|" + WEAK_STREETS).split("|")}
_TITLE_WORDS = {w.casefold() for w in TITLES.split("|")}
_GERMAN_HINTS = ("straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "ufer", "damm")
_SPANISH_HINTS = ("calle", "c/", "avenida", "avda", "plaza", "paseo", "camino")
_DIGIT_WORDS = {w.casefold() for w in DIGITS if len(w) > 1}
#: Words of the shortest spoken number, seven digits with doubles.
_LEAST_SPOKEN = 4


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word).casefold() if c.isalpha())


def luhn(digits: str) -> bool:
    """The check digit of payment cards."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check digits of international bank account numbers."""
    a = re.sub(r"\s", "", account).upper()
    return len(a) > 14 and int("".join(str(int(c, 36)) for c in a[4:] + a[:4])) % 97 == 1


def check_letter(number: str) -> bool:
    """The check letter of Spanish identity numbers."""
    n = number.upper()
    n = n[:1].translate(str.maketrans("XYZ", "012")) + n[1:]
    return n[:-1].isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(n[:-1]) % 23] == n[-1]


def check_eleven(number: str) -> bool:
    """The check digit of German tax numbers."""
    p = 10
    for c in number[:10]:
        s = (int(c) + p) % 10 or 10
        p = s * 2 % 11
    return (11 - p) % 10 == int(number[10]) and number[0] != "0" and 7 <= len(set(number[:10])) <= 9


_SPOKEN_WORD = re.compile(rf"{_L}+|\d")


def spoken_digits(text: str) -> str:
    """The digits and single letters a spoken run stands for."""
    out, times = [], 1
    for w in _SPOKEN_WORD.findall(text.casefold()):
        if w in REPEATS:
            times = REPEATS[w]
            continue
        c = DIGITS.get(w) if len(w) > 1 or w == "o" else w
        out.append((c or "") * times)
        times = 1
    return "".join(out)


def near(text: str, start: int, end: int, kind: str) -> float:
    """What the words around a span add to its score."""
    around = text[max(0, start - REACH) : start] + " \n " + text[end : end + REACH]
    good, bad = CONTEXT[kind]
    before = text[max(0, start - 24) : start]
    return 0.2 * bool(good.search(around)) - 0.35 * bool(bad.search(before))


class Parts:
    """A Bloom filter of folded words, sized by their number."""

    def __init__(self, folded: Iterable[str], n: int) -> None:
        if n > MAX_PARTS:
            raise ValueError(f"more than {MAX_PARTS} parts of names")
        self.size = max(64, n * BITS_PER_PART)
        bits = np.zeros(self.size // 8 + 1, np.uint8)
        for word in folded:
            for h in self.places(word):
                bits[h >> 3] |= 1 << (h & 7)
        self.bits = bits.tobytes()

    def places(self, folded: str) -> Iterator[int]:
        d = hashlib.blake2b(folded.encode(), digest_size=16).digest()
        a, b = int.from_bytes(d[:8]), int.from_bytes(d[8:]) | 1
        return ((a + i * b) % self.size for i in range(HASHES))

    def __contains__(self, folded: str) -> bool:
        return all(self.bits[h >> 3] >> (h & 7) & 1 for h in self.places(folded))


class Names:
    """Name parts the corpus knows."""

    def __init__(self, parts: Parts | set[str]) -> None:
        self.parts, self.seen = parts, {}

    def knows(self, word: str) -> bool:
        k = self.seen.get(word)
        if k is None:
            f = fold(word)
            k = len(f) > 2 and f in self.parts
            if len(self.seen) < 200_000:
                self.seen[word] = k
        return k


_LOCAL = re.compile(r"[._-]|\s(?:dot|underscore|dash|hyphen)\s")


def name_parts(text: str) -> Iterator[tuple[str, str | None]]:
    """Parts of the e-mail addresses of a text, each with every other part of its address, or None; in long texts some come twice."""
    if len(text) > WINDOW:
        for a in range(0, len(text), WINDOW):
            yield from name_parts(text[a : a + WINDOW])
            yield from name_parts(text[max(0, a - MARGIN) : a + MARGIN] if a else "")
        return
    low = text.casefold()
    if "@" in text:
        for m in _EMAIL.finditer(text):
            yield from _parts(m.group().split("@")[0])
    if "at" in low and "dot" in low:
        for rx in (_EMAIL_MASKED, _EMAIL_SPOKEN):
            for m in rx.finditer(text):
                yield from _parts(re.split(r"\s?[\[({]\s?at|\sat\s", m.group(), flags=re.I)[0])


def _parts(local: str) -> Iterator[tuple[str, str | None]]:
    local = re.split(r"\+|\splus\s", local, flags=re.I)[0]
    pieces = _LOCAL.split(local)
    own = [f for p in pieces if len(f := fold(re.sub(r"\d+$", "", p))) > 2]
    for f in own:
        yield f, None
        yield from ((f, g) for g in own if g != f)
    if len(pieces) > 1:
        yield fold(local), None  # parts written with a hyphen in texts


_USED = re.compile(rf"{_L}+(?:['’-](?!s\b){_L}+)*")


_JOINT = re.compile("['’-]")
#: Stretches of a long text that end at white space where there is some.
_PIECE = re.compile(rf"[\s\S]{{1,{WINDOW - 1}}}(?:\s|\Z)|[\s\S]{{{WINDOW}}}")


def uses(text: str, parts: Names) -> Iterator[tuple[str, str | None, bool]]:
    """What a text with capitals tells of words that ``parts`` knows: (word, None, True) for one with a capital away from a
    sentence's start, (word, None, False) for one in lower case without a known neighbour, (word, neighbour, True) for two side by side.

    Addresses are no witnesses for their own parts.
    """
    if len(text) > WINDOW:
        for piece in _PIECE.findall(text):
            yield from uses(piece, parts)
        return
    if not any(map(parts.knows, _USED.findall(text))):
        return
    low = text.lower()
    if text == low or text == text.upper():
        return
    if " dot " in low or "dot]" in low:
        for rx in (_EMAIL_MASKED, _EMAIL_SPOKEN):
            text = rx.sub(" ", text)
    known: list[tuple[str, bool, bool, int, int]] = []
    for m in _USED.finditer(text):
        if not parts.knows(m.group()):
            continue
        a, z = m.span()
        after = text[z : z + 2]
        if (a and not text[a - 1].isspace()) or not (not after or after[0].isspace() or after[0] in ",;:!?'’" or (after[0] == "." and not after[1:].strip())):
            continue
        inside = a > 1 and text[a - 1] == " " and (text[a - 2].isalnum() or text[a - 2] in "_,;)")
        known.append((fold(m.group()), m.group()[0].isupper(), inside, a, z))
    beside = [k > 0 and text[known[k - 1][4] : known[k][3]] in (" ", ", ") for k in range(len(known))] + [False]
    for k, (word, high, inside, _, _) in enumerate(known):
        if high and inside:
            yield word, None, True
        elif not high and not beside[k] and not beside[k + 1]:
            yield word, None, False
        if beside[k]:
            yield word, known[k - 1][0], True
            yield known[k - 1][0], word, True


def find(text: str, names: Names) -> list[Span]:
    """The spans of personal information in ``text``, in order, none overlapping."""
    if len(text) <= WINDOW:
        return find_within(text, names)
    out: list[Span] = []
    for a in range(0, len(text), WINDOW):
        left = max(0, a - MARGIN)
        for x in find_within(text[left : a + WINDOW + MARGIN], names):
            x = Span(x.start + left, x.end + left, x.kind, x.score)
            if a <= x.start < a + WINDOW and (not out or x.start >= out[-1].end):
                out.append(x)
    return out


def find_within(text: str, names: Names) -> list[Span]:
    if "_" in text:
        text = _EMPHASIS.sub(" ", text)
    found: list[Span] = []
    add = lambda m, kind, score, group=0: found.append(Span(m.start(group), m.end(group), kind, score))
    low = text.casefold()
    digits = _NUMBER.search(text) is not None
    plain = _SIMPLE_WORD.findall(low)
    words = set(plain)
    spoken = 0 if words.isdisjoint(_DIGIT_WORDS) else sum(w in _DIGIT_WORDS for w in plain)
    if "@" in text:
        for m in _EMAIL.finditer(text):
            add(m, "email", 1.0)
    if digits:  # numbers that are confirmed to be something else
        for m in _ACCOUNT.finditer(text):
            if mod97(m.group()):
                add(m, "account", 1.0)
        for m in _CARD.finditer(text):
            if luhn(re.sub(r"\D", "", m.group())) and not near(text, *m.span(), "id_number") > 0:
                add(m, "card", 0.95)
    if "at" in words and "dot" in words:
        for m in _EMAIL_MASKED.finditer(text):
            add(m, "email", 0.95)
        for m in _EMAIL_SPOKEN.finditer(text):
            add(m, "email", 0.9)
    ids = (digits or spoken >= 2) and any(h in low for h in _ID_HINTS)
    if digits:
        if ids:
            for m in _ID_NAMED.finditer(text):
                add(m, "id_number", 0.9, "id")
        for m in _ID_NINO.finditer(text):
            add(m, "id_number", 0.8)
        for m in _ID_SSN.finditer(text):
            add(m, "id_number", 0.6 + near(text, *m.span(), "id_number"))
        for m in _ID_SHAPE.finditer(text):
            n = m.group()
            checked = check_letter(n) if n[-1].isalpha() else check_eleven(n) if len(n) == 11 and n.isdigit() else False
            add(m, "id_number", 0.7 * checked or 0.4 + near(text, *m.span(), "id_number"))
        for m in _PHONE.finditer(text):
            n = re.sub(r"\D", "", m.group())
            if not 7 <= len(n) <= 15:
                continue
            base = 0.8 if m["intl"] else 0.7 if m["area"] or m["trunk"] else 0.65 if m["us"] else 0.5
            add(m, "phone", base + near(text, *m.span(), "phone"))
        for rx, hints in ((_ADDRESS_DE, _GERMAN_HINTS), (_ADDRESS_ES, _SPANISH_HINTS)):
            for m in rx.finditer(text) if any(h in low for h in hints) else ():
                add(m, "address", 0.75)
    for m in _SPOKEN.finditer(text) if spoken >= _LEAST_SPOKEN else ():
        n = spoken_digits(m.group())
        if 7 <= len(n) <= 15:
            add(m, "phone", 0.6 + near(text, *m.span(), "phone"))
    for m in _ID_SPOKEN.finditer(text) if ids and spoken >= 2 else ():
        if len(spoken_digits(m["id"])) >= 5:
            add(m, "id_number", 0.9, "id")
    for m in _ADDRESS.finditer(text) if not words.isdisjoint(_STREET_WORDS) else ():
        strong = re.fullmatch(STRONG_STREETS, m["kind"], re.I) is not None
        cased = m["street"][0].isupper() and m["kind"][0].isupper()
        add(m, "address", (0.7 if cased else 0.55 if strong else 0.35) + near(text, *m.span(), "address"))
    taken = [x for x in found if x.score >= THRESHOLD]
    titled = not words.isdisjoint(_TITLE_WORDS)
    whole = _USED.findall(text) if _JOINT.search(text) else plain
    paired = sum(map(names.knows, whole)) > 1
    if titled or paired:
        taken += people(text, names, taken, titled, paired)
    if not taken:
        return taken
    out: list[Span] = []
    for x in sorted(taken, key=lambda x: (-x.score, x.start - x.end, x.start)):
        if all(x.end <= y.start or x.start >= y.end for y in out):
            out.append(x)
    return sorted(x for x in out if x.kind in TYPES)


_NOT_NAMES = re.compile(rf"(?:{SMALL}|{STRONG_STREETS}|{WEAK_STREETS}|{TITLES}|bridge|choir|valley|project|stories|blend|prize|award|foundation|trust|university|school|hospital|church|park|station|hotel|museum|river|lake)\Z", re.I)


def people(text: str, names: Names, taken: list[Span], titled: bool, paired: bool) -> Iterator[Span]:
    """Names of persons outside the spans already taken. ``titled``, ``paired``: whether the text has a title, and two known words."""
    free = lambda s, e: all(e <= x.start or s >= x.end for x in taken)
    spelt_low = text == text.lower()
    for m in _TITLED.finditer(text) if titled else ():
        if not free(*m.span()):
            continue
        words = list(_TOKEN.finditer(text, m.start("words"), m.end("words")))
        first = words[0].group()
        named = names.knows(first) or (m["title"][0].isupper() and first[0].isupper()) or (spelt_low and m["title"].lower() in PLAIN_TITLES and len(first) > 2)
        if not named or _NOT_NAMES.match(first):
            continue
        end = words[0].end()
        if len(words) > 1 and names.knows(words[1].group()):
            end = words[1].end()
        yield Span(m.start(), end, "name", 0.9)
    if not paired:
        return
    words = list(_TOKEN.finditer(text))
    i = 0
    while i < len(words) - 1:
        a, b = words[i], words[i + 1]
        if not names.knows(a.group()) or not free(a.start(), a.end()):
            i += 1
            continue
        between = text[a.end() : b.start()]
        if len(b.group()) == 1 and i + 2 < len(words):  # a middle initial
            b = words[i + 2]
            between = text[a.end() : b.start()]
        known = names.knows(b.group())
        joined = _JOIN.match(between) or (known and _INVERTED.match(between) and a.group()[0].isupper() == b.group()[0].isupper())
        after = words[i + 2].group() if i + 2 < len(words) and text[words[i + 1].end() : words[i + 2].start()] == " " else ""
        work = after[:1].isupper() and _NOT_NAMES.match(after) is not None and not re.match(rf"(?:{SMALL})\Z", after, re.I)
        if joined and known and free(b.start(), b.end()) and not work:
            yield Span(a.start(), b.end(), "name", 0.8)
            while i < len(words) and words[i].start() < b.end():
                i += 1
        else:
            i += 1


def redact(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for x in spans:
        out += [text[at : x.start], TYPES[x.kind]]
        at = x.end
    return "".join([*out, text[at:]])


def learn_names(texts: DataFrame, text: str, known: DataFrame | None = None, column: str = "name") -> Parts:
    """The parts of names in the table of known persons, and those in the texts' e-mail addresses that a second witness confirms."""
    rows = texts.select(F.col(f"`{text}`").alias("x")).filter("x IS NOT NULL")

    def addresses(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {p for x in batch.column(0).to_pylist() for p in name_parts(x)}
            part, mate = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(mate, pa.string())], names=["part", "mate"])

    addressed = checkpointed(rows.filter(F.contains("x", F.lit("@")) | F.contains(F.lower("x"), F.lit("dot"))).mapInArrow(addresses, "part string, mate string").distinct(), "parts")
    parts = addressed.select("part").distinct()
    shipped = texts.sparkSession.sparkContext.broadcast(filter_of(parts))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen = Names(shipped.value), Counter()

        def counted() -> pa.RecordBatch:
            part, mate, high = zip(*seen) if seen else ((), (), ())
            out = pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(mate, pa.string()), pa.array(high, pa.bool_()), pa.array(seen.values(), pa.int64())], names=["part", "mate", "high", "n"])
            seen.clear()
            return out

        for batch in batches:
            for x in batch.column(0).to_pylist():
                seen.update(uses(x, names))
            if len(seen) > MAX_COUNTED:
                yield counted()
        yield counted()

    used = checkpointed(rows.mapInArrow(count, "part string, mate string, high boolean, n long").groupBy("part", "mate", "high").agg(F.sum("n").alias("n")), "uses")
    n = lambda high: F.coalesce(F.sum(F.when(F.col("high") == high, F.col("n"))), F.lit(0))
    alone = used.filter("mate IS NULL").groupBy("part").agg(n(True).alias("high"), n(False).alias("low"))
    judged = parts.join(alone, "part", "left").select("part", (F.col("high") > 0).alias("seen"), (F.col("high") >= CAPITAL_SHARE * (F.col("high") + F.col("low"))).alias("mostly"))
    sure = judged.filter("seen AND mostly").select("part")
    if known is not None:
        table = known.select(F.explode(F.split(F.col(column), r"[^\p{L}'’-]+")).alias("w"))

        def folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([f for w in batch.column(0).to_pylist() if len(f := fold(w or "")) > 2], pa.string())], names=["part"])

        sure = sure.unionByName(table.mapInArrow(folded, "part string")).distinct()
    # Parts that no text uses alone, beside a sure one; parts used in lower case stay out.
    pairs = addressed.filter("mate IS NOT NULL").unionByName(used.filter("mate IS NOT NULL").select("part", "mate"))
    shared = pairs.join(sure.withColumnRenamed("part", "mate"), "mate", "left_semi").join(judged.filter("seen IS NULL"), "part", "left_semi").select("part")
    return filter_of(checkpointed(sure.unionByName(shared).distinct(), "names"))


def filter_of(parts: DataFrame) -> Parts:
    """The filter of a table of parts, which is read in batches and whose size is checked first."""
    return Parts((r.part for r in parts.toLocalIterator()), parts.count())


def scan(texts: DataFrame, text: str, parts: Parts, only_found: bool = False) -> DataFrame:
    """``texts`` with ``spans``, an array of (kind, start, end, score), and ``redacted``, the text with placeholders.

    ``only_found``: just the rows with spans, without the text and its redaction. Defined cases: null text has null spans
    and redaction; empty text has none; long texts are searched whole; other columns are kept, whatever their names;
    repeats stay.
    """
    shipped = texts.sparkSession.sparkContext.broadcast(parts)
    at = texts.columns.index(text)
    kept = [i for i in range(len(texts.columns)) if not (only_found and i == at)]
    spans = "array<struct<kind:string,start:int,end:int,score:double>>"
    schema = ", ".join(f"c{i} {texts.schema[i].dataType.simpleString()}" for i in kept) + f", spans {spans}" + (", redacted string" if not only_found else "")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    row = lambda s: {"kind": s.kind, "start": s.start, "end": s.end, "score": s.score}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(shipped.value)
        for batch in batches:
            own = [find(x, names) if x else [] for x in batch.column(at).to_pylist()]
            if only_found:
                some = [i for i, s in enumerate(own) if s]
                part = batch.take(pa.array(some, pa.int32()))
                columns = [pa.array([list(map(row, own[i])) for i in some], kind)]
            else:
                part, given = batch, batch.column(at).to_pylist()
                columns = [pa.array([None if x is None else list(map(row, s)) for x, s in zip(given, own)], kind), pa.array([None if x is None else redact(x, s) for x, s in zip(given, own)], pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *columns], names=[*(f"c{i}" for i in kept), "spans", "redacted"][: len(kept) + len(columns)])

    renamed = texts.toDF(*[f"c{i}" for i in range(len(texts.columns))])
    return renamed.mapInArrow(run, schema).toDF(*(texts.columns[i] for i in kept), *["spans", "redacted"][: 1 + (not only_found)])
