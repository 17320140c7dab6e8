"""Personal data in texts: patterns propose spans, validators confirm them, words nearby adjust the score.

The base kinds (email, ip, card, phone) are fixed by pattern and validator; context never removes one. Further
kinds (iban, ssn) are added when their score reaches a threshold.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.words import slices

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
ADD_AT = 0.75          # score at which a span of a further kind is added
CONTEXT_CHARS = 40     # characters on either side searched for context words

# possessive forms of the patterns: the classes on both sides of each repeat are disjoint, so nothing is lost,
# and a long run of digits is read once
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
# fixed values: characters of an IBAN by country
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "ST": 25, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+")

CONTEXT = {
    "email": {"email", "mail", "contact", "write", "courriel", "correo"},
    "ip": {"ip", "address", "host", "server", "login"},
    "card": {"card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"},
    "phone": {"phone", "call", "tel", "telephone", "mobile", "telefon"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security"},
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.8, "ssn": 0.5}
CONTEXT_GAIN = 0.3


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces passes the mod-97 check."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # a local part holds no "@", so the leftmost match around an "@" starts where the run before it starts
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        # everything up to this "@" is settled: the next local part begins after it, or after the match
        done = m.end() if m else at + 1
        at = text.find("@", done)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _iban_end(text: str, start: int, end: int) -> int:
    """Where the IBAN that begins at ``start`` ends by its country's length (an unknown country's: with the match); 0 if inside a word."""
    wanted, seen = IBAN_LENGTH.get(text[start:start + 2]), 0
    if wanted:
        for at in range(start, end):
            seen += text[at] != " "
            if seen == wanted:
                end = at + 1
                break
        else:
            return 0
    return end if not (end < len(text) and text[end].isascii() and text[end].isalnum()) else 0


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of matches that pass their validator, by kind, then by start; matches of a kind do not overlap."""
    for a, b in _emails(text):
        yield "email", a, b
    if not re.search("[0-9]", text):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        d = _digits(m.group()) if m.end() - m.start() >= 16 else ""
        if 16 <= len(d) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        end = _iban_end(text, m.start(), m.end())
        if end and mod97(text[m.start():end].replace(" ", "")):
            yield "iban", m.start(), end
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", m.start(), m.end()


def find_spans(text: str | None, add_at: float = ADD_AT) -> list[Span]:
    """All spans of a whole text, by kind as listed in ``KINDS``, then by start, in code points, end exclusive."""
    out, text = [], text or ""
    for kind, a, b in proposals(text):
        near = text[max(0, a - CONTEXT_CHARS):a] + " " + text[b:b + CONTEXT_CHARS]
        known = any(w.lower() in CONTEXT[kind] for w in _WORD.findall(near))
        score = min(1.0, PRIOR[kind] + CONTEXT_GAIN * known)
        if kind in BASE or score >= add_at:
            out.append(Span(kind, a, b, score))
    return out


_SPANS = ("doc_id long, text string, spans array<struct<kind:string,start:int,end:int,score:double>>")


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", add_at: float = ADD_AT) -> DataFrame:
    """(doc_id, spans) for every row: kind, start, end (code points) and score of each span of the whole text.

    A null text is empty; null ids and repeated rows are kept; other columns are ignored; an empty table gives no
    rows. One narrow pass without a shuffle; a task holds one slice of texts at a time.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for part in slices(batches):
            spans = [[s._asdict() for s in find_spans(t.as_py(), add_at)] for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, _SPANS.replace("text string, ", ""))


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    if text is None:
        return None
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= done:
            out += [text[done:s.start], f"[{s.kind}]"]
        done = max(done, s.end)
    return "".join(out) + text[done:]


def digest(spans: list[tuple]) -> str:
    """Lower-case SHA-256 of kind:start:end, comma-joined."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans).encode()).hexdigest()


def pii_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) per row of ``docs``, from ``detect_pii``; scores in the order of the spans."""
    found = detect_pii(docs)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                        F.transform("spans", lambda s: s["score"]).alias("scores"))
