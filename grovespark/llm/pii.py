"""PII surrogates: what identifies a person or opens a door is replaced by something of the same kind.

Every replacement is a keyed permutation of all values that an entity's form can
hold, so two different entities never get one surrogate, and one entity gets the
same surrogate wherever and in whatever spelling it stands: a number with and
without gaps, country code or trunk zero, an address in other case, a name whole
or by one of its parts. Nothing is gathered from the corpus, so there is nothing
that could overflow; each task checks for collisions among what it has replaced,
and ``collisions`` does so for a whole corpus.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovespark.llm.common import table, without

#: The production key. Whoever holds it can tell which surrogate belongs to which entity; pass your own.
KEY = b"surrogates of the production query"

#: Letters of all scripts, and accents that stand after their letters.
EMAIL = re.compile(
    r"(?<![\w\u0300-\u036f%.+-])[\w\u0300-\u036f%+-]+(?:\.[\w\u0300-\u036f%+-]+)*@(?:[^\W_]|[\u0300-\u036f-])+(?:\.(?:[^\W_]|[\u0300-\u036f-])+)*\.[^\W\d_]{2,}"
)
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
#: Runs of digits with what may stand between them; which kind it is, ``digits_kind`` tells.
DIGITS = re.compile(r"(?<![\w.])(?:\+|\(\+?)?\d(?:[ ().\-/]{0,2}\d){6,}(?![\w]|\.\d)")
IPV4 = re.compile(r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d)")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{0,4}){2,8}(?![\w:]|\.\d)")
ACCESS_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
SECRET = re.compile(
    r"((?:password|passwd|pwd|secret|token|api_?key|access_?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)([^\s\"',;]{6,})", re.IGNORECASE
)
#: Titles that tell that a name follows.
TITLES = frozenset(
    "Mr Mrs Ms Miss Sir Dr Herr Herrn Frau Monsieur Madame Mme Señor Señora Sr Sra Don Doña господин госпожа Господин Госпожа κύριος κυρία Κύριος Κυρία".split()
)
#: Titles that may follow the first.
FURTHER = tuple("Dr Prof Professor Professorin Doctor Doktor Docteur Mag Ing Dipl Rev Hon Lic доктор профессор".split())
PARTICLES = frozenset("von van de der den del della di da das do dos du des la las le los el y zu zur zum af av ter ten bin ibn".split())
#: Given names by script and gender. They are changed for one another, and tell a name that has no title.
GIVEN = {
    ("latin", "m"): "James John Robert Michael David Thomas Charles Daniel Matthew Andrew Peter Martin Oscar Simon Hugo Felix Lukas Stefan Jürgen "
    "Klaus Wolfgang Pierre Jacques Philippe François Antoine Carlos Juan José Luis Javier Miguel Fernando Giovanni",
    ("latin", "f"): "Mary Patricia Jennifer Elizabeth Susan Jessica Sarah Karen Nancy Anna Laura Helen Julia Clara Emma Sophie Katharina Ursula Sabine "
    "Monika Petra Isabelle Nathalie Sylvie Camille Amélie Carmen Lucía Elena Teresa Jane Beatriz Giulia Francesca",
    ("cyrillic", "m"): "Иван Пётр Алексей Сергей Николай Дмитрий Павел Михаил Андрей Юрий",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Вера Светлана Юлия",
}
_GIVEN = {kind: tuple(n.lower() for n in names.split()) for kind, names in GIVEN.items()}
_GIVEN_KIND = {name: kind for kind, names in _GIVEN.items() for name in names}
_CAPITAL, _ANY = r"[^\W\d_a-zа-яёß-öø-ÿ]", r"[^\W\d_]"
_PART = rf"(?:{_CAPITAL}{_ANY}*['’]{_ANY}+|(?:[dDlL]|{_CAPITAL})['’]{_CAPITAL}{_ANY}+|{_CAPITAL}{_ANY}+|(?:{_CAPITAL}\.)+|{_CAPITAL}(?=[ \u00a0-]{_CAPITAL}))"
_PARTICLES = rf"(?:(?:{'|'.join(sorted(PARTICLES, key=len, reverse=True))})[ \u00a0])*"
_TITLES = "|".join(sorted(TITLES, key=len, reverse=True))
_REST = rf"(?:[ \u00a0-]{_PARTICLES}{_PART}|(?<=\.){_PART})"
NAME = re.compile(
    rf"(?<!\w)(?:{_TITLES})(?:\.?[ \u00a0](?:(?:{_TITLES}|{'|'.join(sorted(FURTHER, key=len, reverse=True))})(?:\.[ \u00a0]?|[ \u00a0]))*)({_PARTICLES}{_PART}{_REST}*)"
)
_FIRST = "|".join(sorted((n for names in GIVEN.values() for n in names.split()), key=len, reverse=True))
#: A listed given name and what follows it as a name does.
UNTITLED = re.compile(rf"(?<!\w)((?:{_FIRST}){_REST}+)")
#: "My name is …" and its like.
INTRODUCED = re.compile(
    rf"(?<!\w)(?:[Mm]y name is|[Ii]ch hei(?:ß|ss)e|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]e llamo|[Mm]i nombre es|[Мм]еня зовут)[ \u00a0]({_PARTICLES}{_PART}{_REST}*)"
)
WORD = re.compile(r"[^\W\d_]+")
#: What of a name is changed: all words but a letter before an apostrophe.
NAME_PART = re.compile(r"[^\W\d_]{2,}|[^\W\d_](?!['’])")
LOWER, DIGIT, HEX_DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
#: Letters that names change for one another, so that they can still be spoken: vowels and others, by script.
NAME_LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ", "ς")
#: Endings that tell gender, or that a name is a patronymic or a surname. They stay.
ENDINGS = ("ская", "ский", "овна", "евна", "ович", "евич", "ова", "ева", "ина", "ов", "ев", "ин", "ая", "а", "я", "a", "o")
#: Lengths of country codes: those that are not three digits long.
ONE_DIGIT = ("1", "7")
TWO_DIGITS = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)


def number(key: bytes, *parts: object) -> int:
    text = "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return int.from_bytes(hmac.new(key, text, hashlib.sha256).digest(), "big")


def feistel(key: bytes, label: str, value: int, size: int, rounds: Iterable[int]) -> int:
    """A keyed permutation of 0 to size-1, or, with the rounds in reverse, its inverse. Values beyond ``size`` go round again."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    order = list(rounds)
    forth = order == sorted(order)
    while True:
        left, right = value >> half, value & mask
        for i in order:
            if forth:
                left, right = right, left ^ (wide(key, label, half, i, right) & mask)
            else:
                left, right = right ^ (wide(key, label, half, i, left) & mask), left
        value = left << half | right
        if value < size:
            return value


def wide(key: bytes, label: str, half: int, i: int, value: int) -> int:
    """As many keyed bits as a half has."""
    out = number(key, label, half, i, value)
    for block in range(1, -(-half // 256)):
        out = out << 256 | number(key, label, half, i, value, block)
    return out


def other(key: bytes, label: str, value: int, size: int) -> int:
    """A keyed permutation of 0 to size-1 without fixed points: places under one permutation, shifted by a keyed number that is not zero."""
    if size <= 1:
        return value
    place = feistel(key, label, value, size, range(8))
    place = (place + 1 + number(key, label, "shift") % (size - 1)) % size
    return feistel(key, label, place, size, reversed(range(8)))


def script(c: str) -> str:
    return unicodedata.name(c, "").partition(" ")[0]


@lru_cache(maxsize=4096)
def alphabet(c: str) -> tuple[str, str | None]:
    """(lower case, what it may be changed for): ASCII letters, digits, or the letters of its script and 64 code points that have both cases or none."""
    low = c.lower() if len(c.lower()) == 1 else c
    if c in DIGIT:
        return c, DIGIT
    if c.isascii():
        return low, LOWER if low in LOWER else None
    start, kind = ord(low) & ~0x3F, script(low)
    block = "".join(
        x for x in map(chr, range(start, start + 64)) if x.isalpha() and script(x) == kind and x.lower() == x and x.upper().lower() == x and len(x.upper()) == 1
    )
    return (low, block) if low in block else (c, None)


@lru_cache(maxsize=4096)
def name_alphabet(c: str) -> tuple[str, str | None]:
    """As ``alphabet``, but vowels are changed for vowels."""
    low, letters = alphabet(c)
    if letters is None or letters is DIGIT:
        return low, letters
    return low, next((x for x in NAME_LETTERS if low in x), None) or "".join(x for x in letters if not any(x in y for y in NAME_LETTERS))


def hex_digit(c: str) -> tuple[str, str | None]:
    return c.lower(), HEX_DIGITS


#: Characters that one permutation takes.
AT_ONCE = 64


def reshaped(key: bytes, label: str, text: str, allowed: Callable[[str], bool] = lambda _: True, letters: Callable = alphabet) -> str:
    """The text with digits changed for digits and letters for letters, by one permutation of all texts of this shape.

    The case of letters stays, and is no part of the value: spellings in other cases get the same letters.
    Of a long text ``AT_ONCE`` characters are permuted at a time, by a permutation that depends on those before.
    Values that are not ``allowed`` go round again; as the text itself is allowed, what is left is a
    permutation of the allowed texts.
    """
    while True:
        out, before = [], hashlib.sha256()
        for at in range(0, len(text), AT_ONCE):
            new, plain = permuted(key, f"{label}+{before.hexdigest()}" if at else label, text[at : at + AT_ONCE], letters)
            before.update(plain.encode("utf-8", "surrogatepass"))
            out.append(new)
        text = "".join(out)
        if allowed(text):
            return text


def permuted(key: bytes, label: str, text: str, letters: Callable) -> tuple[str, str]:
    """(the text changed, what it was in lower case)."""
    plain, alphabets = zip(*map(letters, text), strict=True)
    shape = "".join("9" if a is DIGIT else "a" if a is LOWER else a[0] if a else c for c, a in zip(plain, alphabets, strict=True))
    value, size = 0, 1
    for c, a in zip(plain, alphabets, strict=True):
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    value = other(key, f"{label}:{shape}", value, size)
    out = []
    for c, a in zip(reversed(text), reversed(alphabets), strict=True):
        if a:
            value, at = divmod(value, len(a))
            c = a[at].upper() if c.isupper() else a[at]
        out.append(c)
    return "".join(reversed(out)), "".join(plain)


def luhn(digits: str) -> int:
    """The check digit that follows these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in DIGIT)


def put_digits(form: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c in DIGIT else c for c in form)


def card(key: bytes, text: str) -> str:
    """First digit and form stay. A right check digit stays right, and a wrong one is as much off as before."""
    digits = only_digits(text)
    off = int(digits[-1]) - luhn(digits[:-1])
    body = digits[0] + reshaped(key, f"card{digits[0]}", digits[1:-1])
    return put_digits(text, body + str((luhn(body) + off) % 10))


def country_code(digits: str) -> int:
    """How many of these digits, which follow a plus, are the country's."""
    return 1 if digits[:1] in ONE_DIGIT else 2 if digits[:2] in TWO_DIGITS else 3


def phone(key: bytes, text: str) -> str:
    """Country code, trunk zero and form stay. The rest is changed by one permutation, whatever the form, so all forms of a number agree."""
    digits = only_digits(text)
    head = 0
    if text.lstrip("(").startswith("+"):
        head = country_code(digits)
    elif digits.startswith("00") and len(digits) > 9:
        head = 2 + country_code(digits[2:])
    # The trunk's zero: "(0)" after a country code, or before a number without one.
    if (head and re.search(r"\(0\)", text) and digits[head : head + 1] == "0") or (not head and digits.startswith("0")):
        head += 1
    own = digits[head:]
    zero = own[:1] == "0"
    return put_digits(text, digits[:head] + reshaped(key, "phone", own, lambda x: (x[:1] == "0") == zero))


def ssn(key: bytes, text: str) -> str:
    """Areas that are not given out stay such, and others too."""

    def given_out(x: str) -> bool:
        return x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[7:] != "0000"

    own = given_out(text)
    return reshaped(key, "ssn", text, lambda x: given_out(x) == own)


def ipv4(key: bytes, text: str) -> str:
    """Private, loopback and link-local networks keep their prefix; other addresses are changed for others outside of these."""
    value = int.from_bytes(bytes(map(int, text.split("."))), "big")
    nets = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16")]
    ranges = [(int(n.network_address), n.num_addresses) for n in nets]
    for first, size in ranges:
        if first <= value < first + size:
            value = first + other(key, f"ipv4-{first}", value - first, size)
            break
    else:
        value = other(key, "ipv4", value, 1 << 32)
        while any(first <= value < first + size for first, size in ranges):
            value = other(key, "ipv4", value, 1 << 32)
    return ".".join(map(str, value.to_bytes(4, "big")))


def ipv6_valid(text: str) -> bool:
    if sum(len(x) > 0 for x in text.split(":")) < 3:
        return False
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return True


def ipv6(key: bytes, text: str) -> str:
    """The first 16 bits stay; all spellings of an address agree, and each keeps to short or full form and to its case."""
    value = int(ipaddress.IPv6Address(text))
    low = 1 << 112
    new = ipaddress.IPv6Address(value // low * low + other(key, f"ipv6-{value // low}", value % low, low))
    out = new.exploded if len(text) == 39 else str(new)
    return out.upper() if any(c in "ABCDEF" for c in text) else out


def email(key: bytes, text: str) -> str:
    """The name's and the host's letters and digits change, dots and the top-level domain stay. Case is no difference."""
    name, _, host = text.rpartition("@")
    first, _, top = host.rpartition(".")
    return reshaped(key, f"email{top.lower()}", f"{name}@{first}") + "." + top


def iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def iban(key: bytes, text: str) -> str:
    """Country and grouping stay; the check digits are made anew."""
    plain = text.replace(" ", "")
    body = reshaped(key, f"iban{plain[:2]}", plain[4:])
    rest = iter(plain[:2] + f"{iban_check(plain[:2], body):02d}" + body)
    return "".join(" " if c == " " else next(rest) for c in text)


def iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and iban_check(plain[:2], plain[4:]) == int(plain[2:4])


def access_key(key: bytes, text: str) -> str:
    return text[:4] + reshaped(key, "access", text[4:])


HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")


def secret(key: bytes, text: str) -> str:
    """Each letter and digit by one of its kind; hexadecimal stays hexadecimal, and nothing else becomes so."""
    if HEX.fullmatch(text):
        out = reshaped(key, "hex", text.lower(), letters=hex_digit)
        return out.upper() if text.isupper() else out
    # Here case is a part of the value.
    shape = hashlib.sha256(bytes(map(str.isupper, text))).hexdigest()
    return reshaped(key, f"secret{shape}", text, lambda x: not HEX.fullmatch(x))


def ending(low: str) -> int:
    """Where a name's ending starts; one of three letters or fewer has none."""
    return next((len(low) - len(e) for e in ENDINGS if low.endswith(e) and len(low) > len(e) + 2), len(low))


@lru_cache(maxsize=100_000)
def name_part(key: bytes, low: str) -> str:
    """What a part of a name, in lower case, is changed for: a listed given name for one of its script and gender, others letter by letter.

    One permutation for each shape, whether the part is a given name or a surname, so that a name's parts agree
    wherever they stand; what tells gender at the end stays.
    """
    if kind := _GIVEN_KIND.get(low):
        names = _GIVEN[kind]
        return names[other(key, f"given-{kind[0]}-{kind[1]}", names.index(low), len(names))]
    at = ending(low)
    tail = low[at:]

    def fits(stem: str) -> bool:
        new = stem + tail
        return new not in _GIVEN_KIND and ending(new) == at

    return reshaped(key, f"name{tail}", low[:at], fits, name_alphabet) + tail


def cased(new: str, form: str) -> str:
    """``new`` with the case of ``form``: letter by letter, or as a whole if they differ in length."""
    if len(new) == len(form):
        return "".join(a.upper() if b.isupper() and len(a.upper()) == 1 else a for a, b in zip(new, form, strict=True))
    return new.upper() if form.isupper() and len(form) > 1 else new.capitalize() if form[:1].isupper() else new


def person(key: bytes, form: str) -> str:
    """A name of the same form: particles, initials' dots and gaps stay, and each part is changed for its own."""
    return NAME_PART.sub(lambda m: m[0] if m[0] in PARTICLES else cased(name_part(key, m[0].lower()), m[0]), form)


def digits_kind(text: str) -> str | None:
    """card: 13 to 19 digits with a right check digit, or in groups of four. ssn: its groups. phone: a plus or gaps and 7 to 15 digits."""
    digits = only_digits(text)
    if 13 <= len(digits) <= 19 and luhn(digits[:-1]) == int(digits[-1]) and len(set(digits)) > 1 and "+" not in text:
        return "card"
    if 13 <= len(digits) <= 19 and re.fullmatch(r"\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}", text):
        return "card"
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", text):
        return "ssn"
    if 7 <= len(digits) <= 15 and text[0] in "+(":
        return "phone"
    if 9 <= len(digits) <= 15 and re.fullmatch(r"0?\d{2,5}([ .\-/])\d{2,4}(?:[ .\-/]\d{2,5}){1,4}", text):
        return "phone"
    return None


#: Digits that one entity holds at least and at most, and pieces between blanks.
LEAST_DIGITS, MOST_DIGITS, MOST_PIECES = 7, 19, 8


def digit_entities(run: str) -> list[tuple[int, int, str]]:
    """A run of digits and gaps as entities; several may stand in a row with single blanks between them.

    From each piece on, the longest row of pieces that is an entity counts. A row
    has at most ``MOST_DIGITS`` digits in ``MOST_PIECES`` pieces, so the work
    grows with the run's length, and a table of numbers is not one long number.
    """
    pieces = [(*m.span(), len(only_digits(m[0]))) for m in re.finditer(r"[^ ]+", run)]
    out, i = [], 0
    while i < len(pieces):
        j, n = i, 0
        while j < min(len(pieces), i + MOST_PIECES) and n + pieces[j][2] <= MOST_DIGITS:
            n += pieces[j][2]
            j += 1
        while j > i and n >= LEAST_DIGITS:
            if kind := digits_kind(run[pieces[i][0] : pieces[j - 1][1]]):
                break
            j -= 1
            n -= pieces[j][2]
        else:
            i += 1
            continue
        out.append((pieces[i][0], pieces[j - 1][1], kind))
        i = j
    return out


#: (kind, pattern, what one of must stand in the text).
KINDS: list[tuple[str, re.Pattern, tuple[str, ...]]] = [
    ("email", EMAIL, ("@",)),
    ("secret", SECRET, ("=", ":")),
    ("access_key", ACCESS_KEY, ("AKIA", "ASIA")),
    ("iban", IBAN, ("",)),
    ("ipv6", IPV6, (":",)),
    ("ip", IPV4, (".",)),
    ("digits", DIGITS, ("",)),
    ("name", NAME, ("",)),
    ("name", INTRODUCED, ("",)),
    ("name", UNTITLED, ("",)),
]
SURROGATES = {
    "email": email, "secret": secret, "access_key": access_key, "iban": iban, "ipv6": ipv6, "ip": ipv4, "card": card, "phone": phone, "ssn": ssn,
    "name": person,
}


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every entity, in order; of two that overlap, that of the kind named first in ``SURROGATES``, then the earlier.

    Once a name is found, its parts are entities wherever else they stand in the text with a capital.
    """
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    for kind, pattern, needs in KINDS:
        if not any(x in text for x in needs):
            continue
        for m in pattern.finditer(text):
            start, end = m.span()
            if kind == "secret":
                start, end = m.span(2)
            elif kind == "name":
                start, end = m.span(1)
            elif (kind == "iban" and not iban_valid(m[0])) or (kind == "ipv6" and not ipv6_valid(m[0])):
                continue
            elif kind == "digits":
                found += [(start + a, start + b, what) for a, b, what in digit_entities(m[0])]
                continue
            found.append((start, end, kind))
    parts = {w for a, b, kind in found if kind == "name" for w in WORD.findall(text[a:b]) if len(w) > 1 and w not in PARTICLES}
    if parts:
        found += [(*m.span(), "name") for m in WORD.finditer(text) if m[0] in parts]
    order = {k: i for i, k in enumerate(SURROGATES)}
    covered = bytearray(len(text))
    taken = []
    for start, end, kind in sorted(found, key=lambda e: (order[e[2]], e[0], -e[1])):
        if covered.find(1, start, end) < 0:
            covered[start:end] = b"\1" * (end - start)
            taken.append((start, end, kind))
    return sorted(taken)


def known_as(kind: str, form: str) -> str:
    """Equal for spellings of one entity that may share a surrogate's spelling."""
    if kind == "ip":
        return ".".join(str(int(x)) for x in form.split("."))
    if kind == "ipv6":
        return ipaddress.IPv6Address(form).exploded
    return form.lower() if kind in ("name", "email") else form


#: Surrogates that a task keeps at hand, and checks for collisions.
MEMO = 100_000


class Surrogates:
    """One task's surrogates."""

    def __init__(self, key: bytes):
        self.key = key
        self.new: dict[tuple[str, str], str] = {}
        self.owner: dict[tuple[str, str], str] = {}

    def get(self, kind: str, form: str) -> str:
        new = self.new.get((kind, form))
        if new is None:
            if len(self.new) >= MEMO:
                self.new.clear()
                self.owner.clear()
            new = self.new[kind, form] = SURROGATES[kind](self.key, form)
            if self.owner.setdefault((kind, new), known_as(kind, form)) != known_as(kind, form):
                raise RuntimeError(f"two entities of kind {kind} have one surrogate")
        return new

    def replaced(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """(text with surrogates, where they stand in it)."""
        out, spans, at, length = [], [], 0, 0
        for start, end, kind in entities(text):
            new = self.get(kind, text[start:end])
            out += [text[at:start], new]
            length += start - at
            spans.append((length, length + len(new), kind))
            length += len(new)
            at = end
        return "".join([*out, text[at:]]), spans


def collisions(docs: DataFrame, text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """(kind, surrogate, n): surrogates that several entities of the corpus share, none if all is well.

    Each task sends its distinct entities on, which are counted by surrogate before and after the shuffle. For
    audits: the permutations have no collisions, so ``replace_pii`` does not need this pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Surrogates(key)
        for batch in batches:
            rows = {
                (kind, known_as(kind, text[a:b]), task.get(kind, text[a:b])) for text in (v.as_py() for v in batch.column(0)) for a, b, kind in entities(text)
            }
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["kind", "form", "surrogate"])

    found = docs.select(text_col).mapInArrow(run, "kind string, form string, surrogate string").distinct()
    return found.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


SPANS = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])
)


def replace_pii(docs: DataFrame, text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text_col``, and ``pii_spans``: where they stand in the new text, and of what kind.

    E-mail addresses, phone and card numbers, IP addresses, IBANs, US social
    security numbers, access keys, values after words like ``password=``, and
    names: after a title, after words like "my name is", from a listed given name
    on, and then by each of their parts in the whole document.

    Whole texts are read once, where they are, in time that grows with their
    length. Null stays null, with no spans; empty stays empty. Repeated rows get
    the same text; an empty table gives no rows; other columns pass through, but
    an input column called ``pii_spans`` is replaced.
    """
    docs = without(docs, "pii_spans")
    schema = T.StructType([*docs.schema.fields, T.StructField("pii_spans", SPANS)])
    at, names = docs.columns.index(text_col), [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Surrogates(key)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            texts, spans = [], []
            for value in batch.column(at):
                text = value.as_py()
                new, found = task.replaced(text) if text else (text, [])
                texts.append(new)
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
            cols = list(batch.columns)
            cols[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, kind)], names=names)

    return docs.mapInArrow(run, schema)


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs).select(
        "doc_id", "text", F.size("pii_spans").cast("long").alias("n_entities"), F.col("pii_spans").alias("spans")
    )
