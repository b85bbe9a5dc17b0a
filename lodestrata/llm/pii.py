"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Defined results: null and empty texts have no span; repeated rows are treated one by one; spans of
one kind never overlap; a span that a method kind proposes over a base span is dropped.  Patterns and
the comparison of spans take time linear in the text, so very long texts need no cut.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import map_text

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "token")
RANK = {k: i for i, k in enumerate(KINDS)}

#: A method span is kept from this score on.
THRESHOLD = 0.5
#: Characters on either side in which context words count.
WINDOW = 48

# IBAN lengths by country, of the whole registry.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|correo|courriel)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|address|host|server|login)\b"),
    "card": re.compile(r"(?i)\b(?:card|credit|visa|karte|tarjeta|carte)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|telefon|teléfono|téléphone)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social security|tax id)\b"),
    "token": re.compile(r"(?i)(?:\b|_)(?:token|secret|password|passwd|pwd|credentials?|bearer|api[ _-]?key|access[ _-]?key|private[ _-]?key)(?:\b|_)"),
}
#: Bits per character that a secret token has at least.
TOKEN_BITS = 3.0
#: Score of a proposal before and after its validator has confirmed it.
PRIOR = {"email": 0.6, "ip": 0.4, "card": 0.3, "phone": 0.4, "iban": 0.2, "ssn": 0.2, "token": 0.1}
CONFIRMED = {"email": 0.2, "ip": 0.2, "card": 0.5, "phone": 0.2, "iban": 0.6, "ssn": 0.0, "token": 0.1}
NEAR = 0.35
#: What a token's own prefix or checksum adds.
SIGNED = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Every ip, card, phone and ssn match lies within one run of these characters.
_NUMERIC = re.compile(r"[+0-9][0-9 ().+-]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/-]{16,}+={0,2}")
_ACCESS_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z2-7]{16}")
_CHECKED_TOKEN = re.compile(r"gh[pousr]_[0-9A-Za-z]{36}")
_BASE62 = {c: i for i, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")}
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
        else:
            last = max(last, at)
        at = text.find("@", at + 1)


def _numeric(text: str):
    """kind, start, end, confirmed of all numeric proposals."""
    for seg in _NUMERIC.finditer(text):
        a, b = seg.span()
        if b - a < 7:
            continue
        for m in _IP.finditer(text, a, b):
            yield "ip", *m.span(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))
        for m in _CARD.finditer(text, a, b):
            digits = _digits(m.group())
            yield "card", *m.span(), 12 <= len(digits) <= 19 and luhn(digits)
        for m in _PHONE.finditer(text, a, b):
            yield "phone", *m.span(), 9 <= len(_digits(m.group())) <= 15
        for m in _SSN.finditer(text, a, b):
            area, group, serial = m.groups()
            yield "ssn", *m.span(), area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _ibans(text: str):
    for m in _IBAN.finditer(text):
        found = m.group().replace(" ", "")
        n = IBAN_LENGTH.get(found[:2])
        if n and len(found) > n:  # what follows a grouped number may look like one more group
            end, seen = m.start(), 0
            while seen < n:
                seen += text[end] != " "
                end += 1
            found = found[:n] if text[end : end + 1] == " " else found
        else:
            end = m.end()
        if n == len(found):
            yield m.start(), end, mod97(found)


def bits(word: str) -> float:
    """Entropy of a word's characters."""
    n = len(word)
    return sum(k * math.log2(n / k) for k in Counter(word).values()) / n


def crc62(token: str) -> bool:
    """Whether the last six characters are the CRC-32, in base 62, of those behind the prefix."""
    body, check = token[token.index("_") + 1 : -6], 0
    for c in token[-6:]:
        check = 62 * check + _BASE62[c]
    return zlib.crc32(body.encode()) == check


def _tokens(text: str):
    """start, end, signed of runs that mix letters and digits and look random."""
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        word = text[a:b].lstrip("+/-")
        a = b - len(word)
        if _CHECKED_TOKEN.fullmatch(word):
            if crc62(word):
                yield a, b, True
        elif _ACCESS_KEY.fullmatch(word):
            yield a, b, True
        elif b - a >= 16 and any("0" <= c <= "9" for c in word) and any(c.isalpha() for c in word) and bits(word) >= TOKEN_BITS:
            yield a, b, False


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = CONTEXT[kind].search(text, max(0, start - WINDOW), min(len(text), end + WINDOW)) is not None
    return min(1.0, PRIOR[kind] + CONFIRMED[kind] + NEAR * near)


def _apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans that overlap none of the taken ones."""
    merged: list[list[int]] = []
    for _, a, b, _ in sorted(taken, key=lambda s: s.start):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    ends = [b for _, b in merged]
    free = lambda s: (i := bisect_left(ends, s.start + 1)) == len(ends) or merged[i][0] >= s.end
    return [s for s in spans if free(s)]


def find_spans(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """All confirmed spans in order of start, then kind.  Base kinds are kept whatever their score."""
    if not text:
        return []
    spans = [Span("email", a, b, _score(text, "email", a, b)) for a, b in _emails(text)]
    own = []
    for kind, a, b, sure in _numeric(text):
        if sure:
            (spans if kind in BASE_KINDS else own).append(Span(kind, a, b, _score(text, kind, a, b)))
    own += [Span("iban", a, b, _score(text, "iban", a, b)) for a, b, sure in _ibans(text) if sure]
    own += [Span("token", a, b, min(1.0, _score(text, "token", a, b) + SIGNED * signed)) for a, b, signed in _tokens(text)]
    spans += _apart([s for s in own if s.score >= threshold], spans)
    return sorted(spans, key=lambda s: (s.start, RANK[s.kind], s.end))


def redact(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans, the union
    is replaced under the name of the first."""
    if not text:
        return text
    out, at = [], 0
    for s in find_spans(text, threshold):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]]) if out else text


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, spans: array of struct(kind, start, end, score); offsets are code points."""

    def factory():
        return lambda text: ([s._asdict() for s in find_spans(text, threshold)],)

    return map_text(docs, [id_col], text_col, factory, "spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def redact_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """The same rows and columns with spans replaced in the text; `length_col`, if there, follows."""
    others = [c for c in docs.columns if c != text_col]

    def factory():
        return lambda text: (redact(text, threshold),)

    out = map_text(docs, others, text_col, factory, f"`{text_col}` string")
    if length_col and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(kind))
    return out.select(*docs.columns)


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, all spans and their scores as text, and their number."""
    s = pii_spans(docs, id_col, text_col)
    said = lambda keep: F.array_join(F.transform(keep, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return s.select(id_col, *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda x: F.format_number(x["score"], 2)), ",").alias("scores"), F.size("spans").cast("long").alias("n_spans"))
