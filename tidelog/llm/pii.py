"""PII: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Base kinds, each leftmost and non-overlapping: e-mail addresses, IPv4 addresses, card numbers (16 to 19
digits, Luhn), phone numbers. The method adds IBANs (mod 97), shorter card numbers (13 to 15 digits, Luhn)
and US social security numbers; those that look like many other numbers need a context word nearby.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import extend

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"

# Runs are consumed whole (possessive), so that a text without any match is still read in linear time: a run
# that fails from its start fails from each later place in it as well.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
DIGIT = re.compile("[0-9]")

# Score before context, and the words that raise it when they stand nearby.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "short card": 0.3}
CONTEXT = {
    "email": re.compile(r"(?i)\b(mail|e-mail|email|contact|write)\b"),
    "ip": re.compile(r"(?i)\b(ip|address|host|server|client)\b"),
    "card": re.compile(r"(?i)\b(card|credit|visa|mastercard|amex|payment|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b"),
    "iban": re.compile(r"(?i)\b(iban|account|bank|konto|compte|cuenta)\b"),
    "ssn": re.compile(r"(?i)\b(ssn|social|security)\b"),
}
REACH = 50
RAISE = 0.3
LEAST = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """The base matches that pass their check, by kind and start."""
    has_digit = DIGIT.search(text)
    if "@" in text:
        yield from (("email", *m.span()) for m in EMAIL.finditer(text) if m[1])
    if has_digit and "." in text:
        for m in IP.finditer(text, has_digit.start()):
            if m[1] and all(int(part) <= 255 for part in (p.lstrip("0")[:4] or "0" for p in m[0].split("."))):
                yield ("ip", *m.span())
    if has_digit:
        for m in CARD.finditer(text, has_digit.start()):
            if 16 <= len(digits := digits_of(m[0])) <= 19 and luhn(digits):
                yield ("card", *m.span())
    if has_digit and "+" in text:
        yield from (("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15)


def more_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """What the method proposes beyond the base kinds and a checksum confirms."""
    start = DIGIT.search(text)
    if not start:
        return
    for m in IBAN.finditer(text, max(0, start.start() - 2)):
        if 15 <= len(compact := m[0].replace(" ", "")) <= 34 and mod97(compact):
            yield ("iban", *m.span())
    yield from (("ssn", *m.span()) for m in SSN.finditer(text))
    for m in CARD.finditer(text, start.start()):
        if 13 <= len(digits := digits_of(m[0])) <= 15 and luhn(digits):
            yield ("short card", *m.span())


def spans_of(text: str | None) -> list[dict]:
    """All spans of a text, by kind and start. Offsets are code points, the end is exclusive."""
    if not text:
        return []
    found = []
    for base, spans in ((True, base_spans(text)), (False, more_spans(text))):
        for name, start, end in spans:
            kind = "card" if name == "short card" else name
            near = text[max(0, start - REACH) : start] + " " + text[end : end + REACH]
            score = min(1.0, SCORES[name] + RAISE * bool(CONTEXT[kind].search(near)))
            if base or score >= LEAST:
                found.append({"kind": kind, "start": start, "end": end, "score": score, "base": base})
    return sorted(found, key=lambda s: (KINDS.index(s["kind"]), s["start"], s["end"]))


def masked(text: str | None, spans: list[dict]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if span["start"] >= at:
            out += [text[at : span["start"]], f"[{span['kind'].upper()}]"]
            at = span["end"]
        elif span["end"] > at:
            at = span["end"]
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Documents with a column `pii` of their personal data.

    Each span has its kind, start and end in code points, score (0 to 1) and whether it is a base span. A null
    or empty text has no spans; every row, repeated ones too, is judged by itself; a column `pii` of the input
    is replaced. No shuffle: one pass over the rows in bounded batches.
    """
    return extend(docs, [text], lambda: lambda texts: [[spans_of(t) for t in texts]], f"pii {SPANS}", drop)


def redact_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with every span of personal data replaced by its kind in brackets."""
    work = lambda texts: [[masked(t, spans_of(t)) for t in texts]]
    return extend(docs, [text], lambda: work, f"{text} string").select(*docs.columns)


def listed(spans) -> F.Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
