"""Personal information in free text, by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs and their disguises, number shapes (every digit
reads as 0), schemes, labels of identity numbers, street words, names and titles. At each anchor a deterministic local
parser expands the mention to both sides and validates it: lengths of addresses (RFC 5321), numbers of digits, the
check digits of an IBAN. Check digits of national numbers are not asked for, as texts hold invented ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "phone", "id_number", "address", "person")


@dataclass(frozen=True)
class Names:
    """Given names and surnames that are known; surnames also as all stems with all endings.

    A known given name (or an initial) with a known surname is a person in any order and case. With one known given name,
    a title, or the opening or closing of a letter, any capitalized surname will do.
    """

    given: tuple[str, ...]
    surnames: tuple[str, ...] = ()
    stems: tuple[str, ...] = ()
    endings: tuple[str, ...] = ()

    def known(self) -> list[str]:
        return [*self.surnames, *(s + e for s in self.stems for e in self.endings)]


#: A lexicon to start from: the names that occur in this project's texts, and common ones. Texts with other names need their own.
NAMES = Names(
    given=tuple(
        "Aisha Amara Anna Arjun Bjorn Camila Chidi Clara Daniel David Diego Edrun Elena Emil Fatima Greta Hana Henrik Hugo "
        "Ilvara Ingrid Irina Jaleth Jonas Julia Kenji Kofi Lars Laura Leila Lucia Maria Marta Mateo Mei Mirel Nadia Noor "
        "Oleg Oswen Pablo Peter Priya Quillo Ruben Ruth Samuel Selin Sennet Sofia Talise Tariq Tomasz Torsil Varic Viktor "
        "Yusuf Zofia "
        "Adam Alexander Alice Andrew Angela Barbara Carlos Carol Charles Christine Christopher Deborah Donald Dorothy Edward "
        "Elizabeth Emily Emma Eric Francesco George Giulia Hans Helen Hiroshi Ivan James Jane Jean Jennifer Jessica John "
        "Joseph Karen Katherine Kevin Linda Lisa Luis Margaret Michael Michelle Mohammed Nancy Olivia Patricia Paul Pierre "
        "Rachel Rebecca Richard Robert Sandra Sarah Stephen Steven Susan Thomas Timothy Wei William Wolfgang Yuki".split()
    ),
    stems=tuple("Brin Darr Eskel Fenn Grav Hast Hul Jast Kard Lorv Mald Mor Osk Pell Quen Sand Ter Tolv Vald Wen".split()),
    endings=tuple("ander ane avik eshi ette idsen isk mere orin ostra oway quist ulle umbra vale wick".split()),
)
#: Cues after which two capitalized words are a person.
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "professor", "herr", "frau", "madame", "señor", "señora", "dear", "regards", "sincerely")
# Accounts of machines.
MACHINE = frozenset("git root noreply no-reply donotreply daemon postmaster mailer-daemon bot hostmaster www-data".split())
#: Longest local part, and longest address, by RFC 5321; and so the longest token of any mention.
LOCAL_MOST, ADDRESS_MOST = 64, 254

_INITIAL = r"[A-Z]\."
_EDGE_L, _EDGE_R = r"(?<![\w@.+%'-])", r"(?![\w@'])(?!\.\w|-\w|\+\w)"
_CAPITAL = r"(?:[A-Z][a-zß-öø-ÿ'’]+(?:[A-Z][a-z]+)?(?:-[A-Z][a-zß-öø-ÿ'’]+)?|[A-Z]{3,})"
#: Capitalized words that follow a name or a title without being one.
_NO_NAME = r"(?!(?:The|This|That|Then|And|But|For|From|Has|Have|Was|Were|Is|Are|Will|All|Team|Sir|Madam|Everyone|Colleagues|API|SQL|HTTP|JSON)\b)"


@cache
def _person_pattern(names: Names) -> re.Pattern:
    given = "|".join(map(re.escape, names.given)) or "(?!)"
    stems, endings = "|".join(map(re.escape, names.stems)), "|".join(map(re.escape, names.endings))
    own = [re.escape(x) for x in names.surnames] + ([f"(?:{stems})(?:{endings})"] if stems else [])
    one = f"(?:{'|'.join(own) or '(?!)'})"
    full = rf"{one}(?:-{one})?"
    titles = "|".join(t[0].upper() + t[1:] for t in TITLES)
    return re.compile(
        rf"{_EDGE_L}(?:(?i:{given})|{_INITIAL})(?: {_INITIAL}){{0,2}} (?i:{full}){_EDGE_R}"
        rf"|{_EDGE_L}(?i:{full}), (?:(?i:{given})\b(?![@+._-]?\w*@)|{_INITIAL})(?: {_INITIAL}){{0,2}}"
        rf"|{_EDGE_L}(?:{given})(?: {_INITIAL}){{0,2}} {_NO_NAME}{_CAPITAL}{_EDGE_R}"
        rf"|(?:{_EDGE_L}(?:{titles})\b\.?,?\s+)(?P<titled>{_NO_NAME}(?:{_CAPITAL}|{_INITIAL})(?: {_INITIAL}){{0,2}} {_NO_NAME}{_CAPITAL}){_EDGE_R}"
    )


_LOCAL = r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOT = r"(?:\.|\s?[\[(]dot[\])]\s?)"
_EMAIL = re.compile(
    rf"({_LOCAL})(?:@|\s?[\[(]at[\])]\s?)({_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}})(?![\w])"
    rf"|({_LOCAL}) at ({_LABEL}(?: dot {_LABEL})* dot [A-Za-z]{{2,}})(?![\w])",
    re.I,
)
_PHONE = re.compile(
    r"(?<![\w.+/(-])(?:"
    r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){6,11}"
    r"|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}([-.])\d{3}\1\d{4}"
    r"|00[1-9]\d{0,2} \d(?:[ ]?\d){6,11}|00[1-9]\d{8,12}"
    r"|0\d{2,4}/\d{3,8}(?:-\d{1,5})?|0\d{2} \d{4} \d{4}"
    r")(?![\w/]|[.-]\d)"
)
_ADDRESS = re.compile(
    r"(?<![\w-])(?:"
    r"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite)\s+\d{1,4}[A-Z]?,?\s+)?\d{1,5}[A-Z]?\s+(?:rue|Rue|RUE)\s+[A-Z][\w'-]+"
    r"|(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|FLAT)\s+\d{1,4}[A-Z]?,?\s+)?\d{1,5}[A-Z]?\s+"
    r"(?:(?!(?i:to|and|of|the|in|at|for|on|or)\b)[A-Z][\w'-]*\s+){1,3}"
    r"(?i:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Boulevard|Blvd|Drive|Close|Court|Way|Place|Square|Terrace|Crescent)\b\.?"
    r"|[A-Z][\w-]*(?i:weg|stra(?:ss|ß)e|gasse|platz)\s+\d{1,4}[A-Za-z]?\b"
    r"|(?i:P\.?\s?O\.?\s?Box)\s+\d{1,6}\b"
    r")(?:,\s+(?:\d{4,5}\s+)?[A-Z][A-Za-z]+(?:\s+\d{5})?(?![\w@]))?"
)
_LABELLED = re.compile(
    r"(?<![\w-])(?:"
    r"(?i:passport)(?P<p>{s}(?:[A-Z]{{1,2}}\d{{6,8}}|\d{{8,9}}))"
    r"|(?i:SSN|social security)(?P<s>{s}\d{{3}}[ -]?\d{{2}}[ -]?\d{{4}})"
    r"|(?i:NINO|NI|national insurance)(?P<n>{s}[A-Z]{{2}} ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-D])"
    r"|(?i:tax|TIN|VAT|steuer)(?P<t>{s}\d{{2,3}}(?:[ -]?\d{{2,3}}){{2,3}}\d?)"
    r"|(?i:DNI|NIE)(?P<d>{s}[XYZ]?\d{{7,8}}-?[A-Z])"
    r"|(?i:driving licence|driving license|driver'?s? licen[cs]e)(?P<l>{s}[A-Z9]{{5}} ?\d{{6}} ?[A-Z0-9]{{3}}|{s}[A-Z]{{1,5}}\d{{6,8}}[A-Z0-9]{{0,5}})"
    r"|(?i:identity card|national id|identity|ID card)(?P<i>{s}[A-Z]{{0,3}}\d{{6,12}}[A-Z]?)"
    r"|(?i:IBAN)(?P<b>{s}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?)"
    r")(?!\w|-\d)".format(s=r"(?:\s+(?i:no\.?|number|num\.?|nr\.?|id|card))*\s*[:#]?\s*")
)
_LEAD = re.compile(r"(?:\s+(?:no\.?|number|num\.?|nr\.?|id|card))*\s*[:#]?\s*", re.I)
_SSN = re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)")
_IN_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: [A-Z0-9]{4})* $")
_NOT_ID = re.compile(r"(?:trace id|part no\.?|checksum|build|version|order|serial)\W*$", re.I)

_GAP = re.compile(r"\s{8,}")
_REST = re.compile(rf"\S{{0,{ADDRESS_MOST}}}")

Span = tuple[int, int]


def _around(pattern: re.Pattern, text: str, at: int, back: int, ahead: int) -> Iterator[re.Match]:
    """Matches that touch position ``at``. They are looked for in a window of so many characters to both sides, in which
    long white space does not count and which ends where tokens do; a token longer than any address is no mention."""
    lo, hi = max(0, at - back), at + ahead
    while more := sum(len(m.group()) - 1 for m in _GAP.finditer(text, at, hi)) - (hi - at - ahead):
        if more <= 0 or hi >= len(text):
            break
        hi += more
    hi = _REST.match(text, min(hi, len(text))).end()
    most = lo - ADDRESS_MOST
    while lo > max(0, most) and not text[lo - 1].isspace():
        lo -= 1
    for m in pattern.finditer(text, lo, hi):
        if m.start() > at:
            return
        if m.end() >= at:
            yield m


def _iban(text: str) -> bool:
    """ISO 7064: with the first four characters at the end and letters as numbers, 1 modulo 97."""
    t = re.sub(r"\W", "", text).upper()
    return len(t) >= 15 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _email(text: str, at: int) -> Span | None:
    for m in _around(_EMAIL, text, at, LOCAL_MOST + 16, ADDRESS_MOST):
        local, end = m.group(1) or m.group(3), m.end()
        if len(local) > LOCAL_MOST or len(m.group()) > ADDRESS_MOST or local.lower() in MACHINE or text[end : end + 1] == ":" and not text[end + 1 : end + 2].isspace() and end + 1 < len(text):
            return None
        return m.start(), end
    return None


def _phone(text: str, at: int) -> Span | None:
    for m in _around(_PHONE, text, at, 8, 40):
        n = sum(c.isdigit() for c in m.group())
        if 8 <= n <= 15 and not _NOT_ID.search(text, max(0, m.start() - 24), m.start()) and not _IN_IBAN.search(text, max(0, m.start() - 40), m.start()):
            return m.span()
    return None


def _id(text: str, at: int) -> Span | None:
    for m in _around(_LABELLED, text, at, 28, 90):
        k = m.lastgroup
        if k == "b" and not _iban(m.group(k)[_LEAD.match(m.group(k)).end() :]):
            continue
        start = m.start(k) + _LEAD.match(m.group(k)).end()
        return start, m.end(k)
    for m in _around(_SSN, text, at, 12, 24):
        if not _NOT_ID.search(text, max(0, m.start() - 24), m.start()):
            return m.span()
    return None


def _address(text: str, at: int) -> Span | None:
    for m in _around(_ADDRESS, text, at, 90, 70):
        return m.span()
    return None


def _person(text: str, at: int, names: Names) -> Span | None:
    for m in _around(_person_pattern(names), text, at, 64, 64):
        return m.span("titled") if m.group("titled") else m.span()
    return None


_PARSERS: dict[str, Callable[[str, int], Span | None]] = {"email": _email, "phone": _phone, "id_number": _id, "address": _address}
_DIGITS = {ord(c): "0" for c in "123456789"}


@cache
def _automaton(names: Names) -> ahocorasick.Automaton:
    """Anchors over the lower-cased text whose digits all read 0."""
    a = ahocorasick.Automaton()
    cues = {
        "email": ["mailto:", "@", "(at)", "[at]", " dot "],
        "phone": ["tel:", "+0", "(000)", "000-000-0000", "000.000.0000", "0000 0", "00000000000", "000/000", "000 0000 0000"],
        "id_number": [
            "passport", "ssn", "social security", "nino", "ni n", "national i", "tax", "tin ", "vat ", "steuer", "dni", "nie ",
            "driving licen", "driver", "identity", "id card", "iban", "000-00-0000",
        ],
        "address": [
            " street", " st", " road", " rd", " avenue", " ave", " lane", " ln", " boulevard", " blvd", " drive", " close", " court",
            " way", " place", " square", " terrace", " crescent", "0 rue ", "a rue ", "b rue ", "c rue ", "weg 0", "straße 0",
            "strasse 0", "gasse 0", "platz 0", "box 0",
        ],
        "person": [
            *(x.lower() for x in names.known()), *(f"{g.lower()} " for g in names.given),
            *(t + end for t in TITLES for end in (" ", ". ", ", ", "\n", ",\n")),
        ],
    }
    for kind, words in cues.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def find_pii(text: str | None, names: Names = NAMES) -> list[tuple[int, int, str]]:
    """(start, end, type) of each mention, in order and without overlaps; of overlapping ones the first
    type of TYPES stands. Null and empty texts have none."""
    if not text:
        return []
    low = text.translate(_DIGITS).lower()
    if len(low) != len(text):  # a few characters grow in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text.translate(_DIGITS))
    found: dict[str, set[Span]] = {}
    done: dict[str, int] = {}
    for end, (kind, n) in _automaton(names).iter(low):
        at = end - n + 1
        if at < done.get(kind, 0):
            continue
        if span := _person(text, at, names) if kind == "person" else _PARSERS[kind](text, end if text[at : end + 1].endswith(":") else at):
            found.setdefault(kind, set()).add(span)
            done[kind] = span[1]
    out: list[tuple[int, int, str]] = []
    for kind in TYPES:
        for a, b in sorted(found.get(kind, ())):
            if all(b <= x or a >= y for x, y, _ in out):
                out.append((a, b, kind))
    return sorted(out)


def masked(text: str | None, names: Names = NAMES) -> str | None:
    """The text with a typed placeholder, such as [EMAIL], for each mention and otherwise unchanged."""
    if not isinstance(text, str) or not text:
        return text
    parts, to = [], 0
    for a, b, kind in find_pii(text, names):
        parts += [text[to:a], f"[{kind.upper()}]"]
        to = b
    return "".join([*parts, text[to:]])


def pii_mentions(df: DataFrame, key: str, fields: list[str], names: Names = NAMES) -> DataFrame:
    """key, field_name, pii_type, start_pos and end_pos (characters from 1, end included), mention; per row.

    Null fields have no mentions; repeated rows give repeated mentions; other columns are left out.
    Nothing is shuffled, texts are taken whole, and the time is linear in their length.
    """
    kind = dict(df.dtypes)[key]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (k, f, p, a + 1, b, t[a:b])
                for f, column in zip(fields, pdf.columns[1:], strict=True)
                for k, t in zip(pdf.iloc[:, 0], pdf[column], strict=True)
                for a, b, p in find_pii(t, names)
            ]
            yield pd.DataFrame(rows, columns=[key, "field_name", "pii_type", "start_pos", "end_pos", "mention"])

    return df.select(key, *fields).mapInPandas(
        make, f"`{key}` {kind}, field_name string, pii_type string, start_pos bigint, end_pos bigint, mention string"
    )


def mask_columns(df: DataFrame, fields: list[str], names: Names = NAMES) -> DataFrame:
    """df with the fields' mentions replaced by placeholders; every other column stays in the JVM as it is."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: masked(t, names))

    return df.withColumns({f: mask(F.col(f)) for f in fields})
