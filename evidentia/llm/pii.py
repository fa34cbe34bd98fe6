"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds in the order that ties at one start are listed in; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: Characters on either side that are searched for context words.
NEAR = 40
#: A method's own span (not base) is reported from this score on.
LEAST = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_REST = re.compile(r"(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
# The prior of a confirmed span and the words that raise or lower it.
_PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
_FOR = {
    "email": ("mail", "contact", "courriel", "correo", "kontakt"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "credit", "carte", "karte", "tarjeta"),
    "phone": ("call", "phone", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "compte", "konto", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
# Characters of an account number by country (ISO 13616 and countries that use its form).
_IBAN_CHARS = {
    country: chars
    for chars, countries in {
        15: "NO",
        16: "BE",
        18: "DK FI FK FO GL NL SD",
        19: "MK SI",
        20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST",
        26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA",
        30: "JO KW MU YE",
        31: "MT SC",
        33: "RU",
    }.items()
    for country in countries.split()
}
_AGAINST = {"ip": ("version", "release", "section"), "card": ("order", "invoice", "isbn", "serial"), "ssn": ("part", "order", "serial"), "phone": ("order", "serial")}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """The mod-10 check of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The ISO 7064 check of account numbers."""
    bare = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of their country's length; of a country without a known one, the longest that passes the check."""
    done = 0
    for m in _IBAN.finditer(text):
        start, at, chars, ends = m.start(), m.end(), 4, []
        rest = _IBAN_REST.match(text, at) if start >= done else None
        if not rest:
            continue
        length = _IBAN_CHARS.get(text[start : start + 2])
        while at < rest.end():
            at += 1 + (text[at] == " ")
            chars += 1
            if chars >= 15 and (chars == length or not length) and not (text[at : at + 1].isascii() and text[at : at + 1].isalnum()):
                ends.append(at)
        for end in reversed(ends):
            if mod97(text[start:end]):
                yield start, end
                done = end
                break


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in _emails(text):
        yield "email", start, end
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255 for part in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() < 40 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield "phone", *m.span()
    for start, end in _ibans(text):
        yield "iban", start, end
    for m in _SSN.finditer(text):
        yield "ssn", *m.span()


def find(text: str) -> list[Span]:
    """Every span of a text by start, then kind; base spans whatever their score, the method's own from ``LEAST`` on."""
    out = []
    for kind, start, end in _proposed(text):
        near = (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()
        said = set(re.findall(r"[^\W\d_]+", near))
        score = _PRIOR[kind] + 0.2 * bool(said & set(_FOR[kind])) - 0.3 * bool(said & set(_AGAINST.get(kind, ())))
        score = min(1.0, max(0.0, round(score, 6)))
        if kind in KINDS[:4] or score >= LEAST:
            out.append(Span(kind, start, end, score))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` with ``spans array<struct<kind,start,end,score>>`` for each row; offsets are code points.

    Whole texts are read. Null texts are empty, repeated rows are judged alike, spans of different kinds may
    overlap, those of one kind don't. An empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[vars(s) for s in find(text.as_py() or "")] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")
