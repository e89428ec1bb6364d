"""Operator 1: personal data replaced by keyed surrogates.

Detected entities (e-mail and IP addresses, phone, card, social-security and
account numbers, secrets, personal names) get replacements that are a keyed
function of the entity's type and canonical form, so the same entity has the
same replacement in every text and spelling, and none without the key can be
traced back.  A replacement keeps the surface: separators, letter case, script,
length of numbers, the country code of a phone (a number of the +1 plan is the
same with and without it), the scheme and checksum of a card, an account
number's country and check digits, the class of a private address.

A given name's gender is settled once for the whole corpus: that which all its
titles show, else that of the list, else none; so "Dr Alex Weber" and "Mr Alex
Weber" are one person.  The domain of an e-mail address is an entity of its own.

Distinctness is checked over all texts and all kinds: the distinct entities are
gathered, and an entity whose replacement another entity has, or that equals an
entity that occurs, draws again until no such case is left.  Only entities that
drew again, or whose gender is not the listed one, have to reach the texts.  If
there are at most ``MOST_SENT`` of them they are broadcast; beyond that they are
joined to the distinct texts that mention them.

Names are found after titles, by listed given names, after words that introduce
a name ("my name is", "From:"), by the endings of some surnames, and as Chinese
family names with one or two characters.  A name that shows none of these is not
found.  A name's parts are replaced each for itself (so "Ms Weber" later in a text has
the surname that "Anna Weber" got), and parts of a name found in a text are
also replaced where they stand alone in it.

Defined cases: a null text stays null, an empty one empty; a text without
entities is returned as it is; repeated rows get equal texts; null keys stay
null; an empty table gives no rows; all other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.llm.common import CHUNK_ROWS, Workspace, free_name, lean

#: Entities that drew again and are broadcast, at most.
MOST_SENT = 200_000
#: Setting that holds the key, and the key without it (tests, demonstrations).
KEY_SETTING = "spark.skyfold.pii.key"
DEMO_KEY = b"skyfold demonstration key"

# Titles that show a person and, where they do, a gender.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "господин": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Doña": "f", "госпожа": "f",
    "Dr": "n", "Prof": "n",
}
# Given names by which a person is told without a title (fixed values, by gender).
GIVEN = {
    "m": (
        "James John Robert Michael William David Richard Thomas Peter Paul Hans Klaus Jürgen Stefan Wolfgang Pierre Jean François Luc Antoine José Carlos Juan Miguel Pedro Иван Сергей Дмитрий Алексей Андрей Γιώργος Νίκος "
        "Ahmed Ali Omar Yusuf Mohammed Mehmet Kenji Hiroshi Takashi Akira Raj Amit Rahul Giovanni Luca Marco Lars Erik Piotr Ivan Sergei Dmitri Kwame Chidi"
    ).split(),
    "f": (
        "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Anna Emma Laura Maria Ursula Monika Sabine Petra Marie Sophie Camille Claire Élodie Carmen Lucía Isabel Pilar Ana Ольга Елена Наталья Анна Мария Ελένη Μαρία "
        "Fatima Aisha Layla Yuki Sakura Keiko Priya Sunita Ananya Giulia Francesca Ingrid Astrid Katarzyna Agnieszka Olga Natalia Svetlana Amina Ngozi"
    ).split(),
}
_GENDER = {n: g for g, names in GIVEN.items() for n in names}
_CAPITAL = r"[^\W\d_a-zà-öø-ÿа-яёα-ωά-ώ][^\W\d_]+(?:[-'’][^\W\d_]+)?"
# A title or given name that the patterns take is a whole run of word characters.
_WORD = re.compile(r"\w+")
_NAME_HINTS = frozenset([*_GENDER, *(n.upper() for n in _GENDER), *TITLES])
_TITLED = re.compile(rf"\b({'|'.join(sorted(TITLES, key=len, reverse=True))})\b\.?[  ]+((?:{_CAPITAL})(?:[  ]+{_CAPITAL}){{0,2}})")
_NAMED = re.compile(rf"\b({'|'.join(sorted([*_GENDER, *(n.upper() for n in _GENDER)], key=len, reverse=True))})[  ]+((?:{_CAPITAL})(?:[  ]+{_CAPITAL})?)")
# Names of no list: after words that introduce one, or by the ending of the surname.
_FULL = rf"((?:{_CAPITAL})(?:[  ]+{_CAPITAL}){{1,2}})"
_CUED = re.compile(rf"(?:\b(?:[Mm]y name is|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]on nom est|[Mm]e llamo|[Mm]i nombre es|[Ss]igned by|[Ww]ritten by)[  ]+|\b(?:From|To|Cc|Attn|Author|Contact|Name|Signed|Von|Absender|Autor|Autorin|Auteur|Nom|Nombre|De)[  ]?:[  ]*){_FULL}")
_CUES = ("name", "Name", "heiße", "appelle", "nom", "Nom", "llamo", "igned", "ritten", "From", "To:", "To :", "Cc", "Attn", "Author", "Contact", "Von", "Absender", "Autor", "Auteur", "De:", "De :")
_ENDS = ("ova", "eva", "enko", "owski", "owska", "ewski", "ewska", "opoulos", "opoulou", "shvili", "ović", "oğlu", "sdóttir")
_ENDED = re.compile(rf"\b({_CAPITAL})[  ]+([^\W\d_a-zà-öø-ÿ][^\W\d_]+?(?:{'|'.join(_ENDS)}))\b")
# Chinese names: a common family name (fixed values) and one or two characters, standing alone or before a title.
_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
_HAN = re.compile(rf"(?<![\u4e00-\u9fff])([{_FAMILY}])([\u4e00-\u9fff]{{1,2}}?)(?:(?=先生|女士|小姐|博士|教授)|(?![\u4e00-\u9fff]))")
_HAS_HAN = re.compile(f"[{_FAMILY}]")

_HINT = re.compile(r"[0-9@]")
_KEYED = re.compile(r"""(?i)\b(?:api[_-]?key|secret|token|passwd|password|access[_-]?key)\b\s*[=:]\s*["']?((?=[_+/.~-]*[A-Za-z0-9])[A-Za-z0-9_+/.~-]{8,})""")
_NUMERIC = re.compile(
    r"""(?P<EMAIL>[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})
    |(?P<SECRET>\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|(?=[0-9]*[a-f])[0-9a-f]{32,128})\b)
    |(?P<IBAN>\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)
    |(?P<IPV6>(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)(?:[0-9A-Fa-f]{1,4}:){1,7}(?::|(?::?[0-9A-Fa-f]{1,4}){1,7})(?![\w:]))
    |(?P<IP>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9]))
    |(?P<SSN>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    |(?P<PHONE>(?<!\w)\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?!\w)|(?<!\w)\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}(?!\w)|(?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-]))
    |(?P<CARD>(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))""",
    re.X | re.A,
)


@dataclass(frozen=True, slots=True)
class Entity:
    start: int
    end: int
    kind: str
    canon: str
    gender: str = "n"


# -------------------------------------------------------------------- detection
def luhn(digits: str) -> int:
    """Remainder by 10 of the Luhn sum; 0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def iban_ok(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _canonical(kind: str, surface: str) -> str | None:
    if kind == "EMAIL":
        return surface.lower()
    if kind == "IBAN":
        code = surface.replace(" ", "").upper()
        return code if 15 <= len(code) <= 34 and iban_ok(code) else None
    if kind == "IP":
        parts = [int(p) for p in surface.split(".")]
        return ".".join(map(str, parts)) if max(parts) < 256 else None
    if kind == "IPV6":
        try:
            return ipaddress.IPv6Address(surface).exploded
        except ValueError:
            return None  # a time, or a ratio
    if kind == "PHONE":
        # Ten digits without a country code are a number of the plan of +1.
        digits = _digits(surface)
        return "+" + digits if surface.startswith("+") else "+1" + digits
    if kind in ("CARD", "SSN"):
        return _digits(surface)
    return surface


def _names(text: str, hinted: bool, cued: bool) -> list[Entity]:
    """Parts of names; ``gender`` is what this mention shows, "n" if nothing."""
    found: dict[tuple[int, int], Entity] = {}
    parts: dict[str, str] = {}

    def add(start: int, word: str, kind: str, gender: str = "n") -> None:
        found.setdefault((start, start + len(word)), Entity(start, start + len(word), kind, word.casefold(), gender))
        if len(word) > 2:
            parts.setdefault(word.casefold(), kind)

    def words_of(m: re.Match, group: int) -> list[tuple[int, str]]:
        return [(m.start(group) + w.start(), w.group()) for w in re.finditer(r"[^  ]+", m.group(group))]

    if hinted:
        for m in _TITLED.finditer(text):
            words = words_of(m, 2)
            for at, w in words[:-1]:
                add(at, w, "GIVEN", TITLES[m.group(1)])
            add(*words[-1], "SURNAME")
        for m in _NAMED.finditer(text):
            words = words_of(m, 2)
            add(m.start(1), m.group(1), "GIVEN")
            for at, w in words[:-1]:
                add(at, w, "GIVEN")
            add(*words[-1], "SURNAME")
    if cued:
        for m in _CUED.finditer(text):
            words = words_of(m, 1)
            for at, w in words[:-1]:
                add(at, w, "GIVEN")
            add(*words[-1], "SURNAME")
    if any(e in text for e in _ENDS):
        for m in _ENDED.finditer(text):
            add(m.start(1), m.group(1), "GIVEN")
            add(m.start(2), m.group(2), "SURNAME")
    if _HAS_HAN.search(text):
        for m in _HAN.finditer(text):
            add(m.start(1), m.group(1), "SURNAME")
            add(m.start(2), m.group(2), "GIVEN")
    if parts:  # parts of these names that stand alone
        alone = re.compile(r"(?<![\w-])(" + "|".join(re.escape(p) for p in sorted(parts, key=len, reverse=True)) + r")(?![\w-])", re.I)
        for m in alone.finditer(text):
            if m.group().casefold() in parts and m.group()[0].isupper():
                found.setdefault(m.span(), Entity(*m.span(), parts[m.group().casefold()], m.group().casefold()))
    return list(found.values())


def detect(text: str) -> list[Entity]:
    """Entities of a text in order; none overlaps another."""
    found: list[Entity] = []
    found += _names(text, not _NAME_HINTS.isdisjoint(_WORD.findall(text)), any(c in text for c in _CUES))
    folded = text.casefold()  # as the pattern does, long s and the Kelvin sign included
    if any(w in folded for w in ("key", "secret", "token", "passw")):
        found += [Entity(m.start(1), m.end(1), "SECRET", m.group(1)) for m in _KEYED.finditer(text)]
    if _HINT.search(text) or "::" in text:
        for m in _NUMERIC.finditer(text):
            canon = _canonical(m.lastgroup, m.group())
            if canon is not None:
                found.append(Entity(m.start(), m.end(), m.lastgroup, canon))
    # The earliest starts first, of those the longest; what it covers goes.
    found.sort(key=lambda e: (e.start, -e.end))
    out: list[Entity] = []
    for e in found:
        if not out or e.start >= out[-1].end:
            out.append(e)
    return out


# ------------------------------------------------------------------- surrogates
class Draw:
    """Numbers from a keyed hash of an entity and the number of the attempt."""

    def __init__(self, key: bytes, kind: str, canon: str, attempt: int) -> None:
        self.seed = hashlib.blake2b(f"{kind}\x00{canon}\x00{attempt}".encode("utf-8", "surrogatepass"), key=hashlib.sha256(key).digest(), digest_size=32).digest()
        self.state, self.n = int.from_bytes(self.seed, "big"), 0

    def below(self, n: int) -> int:
        if self.state < 1 << 64:
            self.n += 1
            self.state = int.from_bytes(hashlib.blake2b(self.seed + self.n.to_bytes(4, "big"), digest_size=64).digest(), "big")
        self.state, out = divmod(self.state, n)
        return out


_LATIN = "bdfgklmnprstv", "aeiou"
_BY_SCRIPT = {"LATIN": _LATIN, "CYRILLIC": ("бвгдзклмнпрст", "аеиоу"), "GREEK": ("βγδκλμνπρστ", "αειου")}
_ENDINGS = {
    ("LATIN", "m"): ("o", "an", "ert"), ("LATIN", "f"): ("a", "ina", "elle"), ("LATIN", "n"): ("e", "is"),
    ("CYRILLIC", "m"): ("ан", "ей"), ("CYRILLIC", "f"): ("а", "ия"), ("CYRILLIC", "n"): ("е", "и"),
    ("GREEK", "m"): ("ος", "ης"), ("GREEK", "f"): ("α", "ία"), ("GREEK", "n"): ("ι", "ω"),
}
_SURNAME_ENDS = ("ова", "ева", "ина", "ская", "ов", "ев", "ин", "ский")


def script_of(word: str) -> str:
    for c in word:
        if c.isalpha():
            return unicodedata.name(c, "LATIN").split()[0]
    return "LATIN"


def _letters(draw: Draw, like: str) -> str:
    """Characters of the same kind: digits, Latin letters, or letters of the block."""
    out = []
    for c in like:
        if c.isdigit() and c.isascii():
            out.append(str(draw.below(10)))
        elif c.isascii() and c.isalpha():
            out.append(chr(draw.below(26) + (65 if c.isupper() else 97)))
        elif c.isalpha():
            low = 0x4E00 if 0x4E00 <= ord(c) < 0x9FA5 else ord(c) & ~0x1F
            span = 0x51A5 if low == 0x4E00 else 32
            same = [x for i in range(64) if (x := chr(low + (draw.below(span) + i) % span)).isalpha() and unicodedata.category(x) == unicodedata.category(c)]
            out.append(same[0] if same else c)
        else:
            out.append(c)
    return "".join(out)


#: Attempts after which a replacement is drawn from a wider space, and after
#: which it takes 64 more random bits, so that no class of values can run out.
WIDER, WIDEST = 6, 12


def gender_of(canon: str, shown: Iterable[str] = ()) -> str:
    """Gender of a given name: what all its mentions show, else what the list says."""
    seen = {g for g in shown if g != "n"}
    if len(seen) == 1:
        return seen.pop()
    return "n" if seen else _GENDER.get(canon.title(), "n")


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0, gender: str = "n") -> str:
    """Canonical form of an entity's replacement in the given attempt.

    An e-mail address keeps its domain here; the domain is an entity of its own.
    """
    draw = Draw(key, kind, canon, attempt)
    new = _drawn_value(draw, kind, canon, attempt, gender)
    if attempt >= WIDEST:
        extra = "".join(str(draw.below(10)) for _ in range(20)) if kind in ("PHONE", "CARD", "SSN") else "".join("0123456789abcdef"[draw.below(16)] for _ in range(16))
        if kind == "EMAIL":
            local, _, domain = new.rpartition("@")
            return f"{local}{extra}@{domain}"
        if kind == "DOMAIN":
            return f"x{extra}.{new}"
        return f"{new}-{extra}" if kind in ("IP", "IPV6") else new + extra
    return new


def _drawn_value(draw: Draw, kind: str, canon: str, attempt: int, gender: str) -> str:
    if kind in ("GIVEN", "SURNAME"):
        script = script_of(canon)
        if script not in _BY_SCRIPT:
            return _letters(draw, canon) + _letters(draw, canon[:1] * (attempt // 4))
        hard, soft = _BY_SCRIPT[script]
        size = max(2, min(4, len(canon) // 3 + 1)) + attempt // 4
        stem = "".join(hard[draw.below(len(hard))] + soft[draw.below(len(soft))] for _ in range(size))
        if kind == "SURNAME":
            return stem + (next((e for e in _SURNAME_ENDS if canon.endswith(e)), "") or hard[draw.below(len(hard))])
        ends = _ENDINGS[script, gender]
        return stem[:-1] + ends[draw.below(len(ends))]
    if kind == "EMAIL":
        local, _, domain = canon.rpartition("@")
        more = "" if attempt < 4 and len(local) > 3 else _letters(draw, "xxxx")
        return _letters(draw, local) + more + "@" + domain
    if kind == "DOMAIN":
        *labels, top = canon.split(".")
        more = "x" * (max(0, 4 - sum(map(len, labels))) + attempt)  # short labels soon run out
        return ".".join([*(_letters(draw, x) for x in labels[:-1]), _letters(draw, labels[-1] + more), top])
    if kind == "IP":
        a, b, *_ = parts = [int(p) for p in canon.split(".")]
        fixed = 1 if a in (10, 127) else 2 if (a, b) in ((192, 168), (169, 254)) or (a == 172 and 16 <= b < 32) else 0
        if attempt >= WIDER and fixed:  # a private range that is nearly full: the largest one
            return ".".join(map(str, [10, *(draw.below(256) for _ in range(3))]))
        new = parts[:fixed] + [draw.below(256) for _ in range(4 - fixed)]
        if not fixed:
            new[0] = (11 + draw.below(88)) if draw.below(2) else (128 + draw.below(41))
        return ".".join(map(str, new))
    if kind == "IPV6":
        groups = canon.split(":")
        kept = 1 if groups[0][:2] in ("fe", "fc", "fd", "ff") else 0
        return ":".join([groups[0] if kept else "2001", *(f"{draw.below(65536):04x}" for _ in range(7))])
    if kind == "PHONE":
        digits = canon.lstrip("+")
        code = 1 if digits[0] in "17" else 2
        more = 2 * max(0, attempt - WIDER + 1)  # short numbers soon run out
        return "+" + digits[:code] + "".join(str(draw.below(10)) for _ in range(len(digits) - code + more))
    if kind == "CARD":
        scheme = next((p for p in ("6011", "2131", "1800", "34", "37", "35", "36", "38", "51", "52", "53", "54", "55", "62", "64", "65") if canon.startswith(p)), canon[0])
        body = scheme + "".join(str(draw.below(10)) for _ in canon[len(scheme) : -1])
        last = (10 - luhn(body + "0")) % 10
        if luhn(canon):  # an invalid number stays invalid
            last = (last + 1 + draw.below(9)) % 10
        return body + str(last)
    if kind == "SSN":
        return f"{1 + draw.below(665):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}"
    if kind == "IBAN":
        body = _letters(draw, canon[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + canon[:2] + "00")) % 97
        return f"{canon[:2]}{check:02d}{body}"
    if kind == "SECRET" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canon):
        new = "".join("0123456789abcdef"[draw.below(16)] for _ in canon)
        return new.upper() if canon != canon.lower() else new
    # Few characters may vary: later attempts are longer.
    return _letters(draw, canon) + (_letters(draw, "x" * (attempt // 4)) if kind == "SECRET" else "")


def render(kind: str, surface: str, new: str) -> str:
    """The replacement in the surface's separators and letter case."""
    if kind in ("PHONE", "CARD", "SSN"):
        have = sum(c.isdigit() for c in surface)
        digits = _digits(new)
        # A number written without its country code lacks it in its replacement, too.
        use = digits[1:] if kind == "PHONE" and not surface.startswith("+") else digits
        out, rest = [], iter(use)
        for c in surface:
            out.append(next(rest) if c.isdigit() else c)
        return "".join(out) + "".join(rest) if len(use) >= have else use
    if kind == "IPV6":
        host, _, extra = new.partition("-")
        short = ipaddress.IPv6Address(host).compressed + ("-" + extra if extra else "")
        return short.upper() if surface.isupper() else short
    if kind == "IBAN":
        chars = iter(new)
        return "".join(" " if c == " " else next(chars) for c in surface)
    if kind in ("GIVEN", "SURNAME"):
        word = new
        if surface.isupper() and len(surface) > 1:
            return word.upper()
        return word[:1].upper() + word[1:] if surface[:1].isupper() else word
    if kind == "EMAIL":
        return new.upper() if surface.isupper() else new
    return new


Settled = dict[tuple[str, str], tuple[int, str]]


class Replacer:
    """Rewrites texts; ``settled`` holds (attempt, gender) of the entities whose
    replacement is not that of the first attempt with the listed gender.
    """

    def __init__(self, key: bytes, settled: Settled) -> None:
        self.key, self.settled = key, settled
        self.kept: dict[tuple[str, str, int, str], str] = {}

    def new(self, kind: str, canon: str, settled: Settled) -> str:
        attempt, gender = settled.get((kind, canon)) or (0, gender_of(canon) if kind == "GIVEN" else "n")
        found = self.kept.get((kind, canon, attempt, gender))
        if found is None:
            found = self.kept[kind, canon, attempt, gender] = surrogate(self.key, kind, canon, attempt, gender)
        if kind == "EMAIL":
            local, _, domain = found.rpartition("@")
            return local + "@" + self.new("DOMAIN", domain, settled)
        return found

    def rewrite(self, text: str | None, own: Settled | None = None) -> tuple[str | None, int]:
        """(text with replacements, number of entities)."""
        if not text:
            return text, 0
        entities = detect(text)
        if not entities:
            return text, 0
        if len(self.kept) > 100_000:
            self.kept.clear()
        out, at = [], 0
        for e in entities:
            out += [text[at : e.start], render(e.kind, text[e.start : e.end], self.new(e.kind, e.canon, self.settled if own is None else own))]
            at = e.end
        return "".join([*out, text[at:]]), len(entities)


def with_domains(found: Iterable[Entity]) -> set[tuple[str, str, str]]:
    """(kind, canon, gender) of entities, with the domains of addresses."""
    out = {(e.kind, e.canon, e.gender) for e in found}
    return out | {("DOMAIN", c.rpartition("@")[2], "n") for k, c, _ in out if k == "EMAIL"}


# ------------------------------------------------------------------ whole corpus
def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, canon, gender): the distinct entities of all texts, each with the one
    gender that its mentions, over all texts, agree on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            found = sorted(with_domains(e for t in batch.column(0).to_pylist() if t for e in detect(t)))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in range(3)], names=["kind", "canon", "gender"])

    shown = docs.select(F.col(text).alias("t")).mapInArrow(run, "kind string, canon string, gender string")
    known = F.create_map(*(F.lit(x) for n, g in _GENDER.items() for x in (n.casefold(), g)))
    m, f = F.bool_or(F.col("gender") == "m"), F.bool_or(F.col("gender") == "f")
    said = F.when(m & f, "n").when(m, "m").when(f, "f").otherwise(F.when(F.col("kind") == "GIVEN", F.coalesce(F.try_element_at(known, F.col("canon")), F.lit("n"))).otherwise("n"))
    return shown.groupBy("kind", "canon").agg(said.alias("gender"))


def _drawn(found: DataFrame, key: bytes) -> DataFrame:
    """``found`` (kind, canon, gender, attempt) with the canonical replacement ``new``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(key, k, c, a, g) for k, c, g, a in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "canon", "gender", "attempt", "new"])

    return found.select("kind", "canon", "gender", "attempt").mapInArrow(run, "kind string, canon string, gender string, attempt int, new string")


def assign(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """(kind, canon, gender, attempt, new) of every distinct entity: no two have
    the same ``new``, whatever their kinds, and none equals an entity that occurs.

    Every round draws again for those that clash.  From ``WIDEST`` attempts on a
    replacement takes 64 random bits more, so that the rounds end for any texts.
    """
    from pyspark.sql.window import Window

    work = Workspace(docs.sparkSession, "surrogates")
    found = work.save(entities(docs, text), "entities")
    taken = found.select(F.col("canon").alias("c")).distinct()
    now = work.save(_drawn(found.withColumn("attempt", F.lit(0)), key), "drawn-0")
    w = Window.partitionBy("new").orderBy("attempt", "kind", "canon")
    step = 0
    while True:
        ranked = now.withColumn("n", F.row_number().over(w))
        clash = ranked.join(taken, ranked.new == taken.c, "left").select("kind", "canon", "gender", "attempt", "new", ((F.col("n") > 1) | F.col("c").isNotNull()).alias("bad"))
        clash = work.save(clash, f"checked-{step}")
        if clash.filter("bad").isEmpty():
            return now
        again = _drawn(clash.filter("bad").withColumn("attempt", (F.col("attempt") + 1).cast("int")), key)
        step += 1
        now = work.save(clash.filter("not bad").select("kind", "canon", "gender", "attempt", "new").unionByName(again), f"drawn-{step}")
        work.drop(f"checked-{step - 1}")
        work.drop(f"drawn-{step - 1}")


def _unsettled(given: DataFrame) -> DataFrame:
    """Entities whose replacement does not follow from the key and the lists alone."""
    known = F.create_map(*(F.lit(x) for n, g in _GENDER.items() for x in (n.casefold(), g)))
    listed = F.when(F.col("kind") == "GIVEN", F.coalesce(F.try_element_at(known, F.col("canon")), F.lit("n"))).otherwise("n")
    return given.filter((F.col("attempt") > 0) | (F.col("gender") != listed)).select("kind", "canon", "attempt", "gender")


def key_of(spark: SparkSession) -> bytes:
    """The key that the session's setting ``spark.skyfold.pii.key`` holds.

    Without one the demonstration key is taken, with a warning: who knows a key
    can trace its surrogates back.
    """
    found = spark.conf.get(KEY_SETTING, None)
    if found:
        return found.encode()
    warnings.warn(f"{KEY_SETTING} is not set: surrogates are drawn with the demonstration key", stacklevel=2)
    return DEMO_KEY


def replace(docs: DataFrame, key: bytes, text: str = "text", count: str | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """``docs`` with ``text`` rewritten; ``count`` names a column for the number of entities."""
    spark = docs.sparkSession
    again = _unsettled(assign(docs, key, text))
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())])
    few = again.limit(most_sent + 1).count() <= most_sent
    shared = spark.sparkContext.broadcast(Replacer(key, {(r.kind, r.canon): (r.attempt, r.gender) for r in again.collect()} if few else {}))
    both = free_name(docs, "rewritten")

    def struct(pairs: list[tuple[str | None, int]]) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array([t for t, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int32())], names=["text", "n"])

    if few:

        @F.arrow_udf(kind)
        def rewrite(texts: pa.Array) -> pa.Array:
            return struct([shared.value.rewrite(t) for lo in range(0, len(texts), CHUNK_ROWS) for t in texts.slice(lo, CHUNK_ROWS).to_pylist()])

        out = docs.withColumn(both, rewrite(F.col(text)))
    else:
        out = _joined(docs, again, text, both, shared, struct, kind)
    columns = [F.col(f"{both}.text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, *([F.col(f"{both}.n").alias(count)] if count else []))


def _joined(docs: DataFrame, again: DataFrame, text: str, both: str, shared, struct, kind: T.StructType) -> DataFrame:
    """The rewritten texts where the entities that drew again are too many to
    broadcast: each distinct text is joined with those that it mentions.
    """
    mark, drew = free_name(docs, "text_mark"), free_name(docs, "drew_again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(m, k, c) for m, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, c in sorted({(k, c) for k, c, _ in with_domains(detect(t))})]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["mark", "kind", "canon"])

    mentions = docs.filter(F.length(F.col(text)) > 0).select(F.sha2(F.col(text), 256).alias("mark"), F.col(text).alias("t")).mapInArrow(run, "mark string, kind string, canon string").distinct()
    own = mentions.join(again, ["kind", "canon"]).groupBy("mark").agg(F.collect_list(F.struct("kind", "canon", "attempt", "gender")).alias(drew))
    own = own.withColumnRenamed("mark", mark)

    @F.arrow_udf(kind)
    def rewrite(texts: pa.Array, attempts: pa.Array) -> pa.Array:
        return struct([shared.value.rewrite(t, {(x["kind"], x["canon"]): (x["attempt"], x["gender"]) for x in a or []}) for t, a in zip(texts.to_pylist(), attempts.to_pylist(), strict=True)])

    return docs.withColumn(mark, F.sha2(F.col(text), 256)).join(own, mark, "left").withColumn(both, rewrite(F.col(text), F.col(drew)))
