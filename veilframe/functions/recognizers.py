"""Recognizers of structured identifiers: a pattern, a checksum and context words for each type.

A match counts at the recognizer's confidence if its checksum holds. One whose confidence lies below
the threshold counts only near a context word, which raises it (by BOOST, to CONTEXT_LEAST at least).
Patterns end at letters, digits and hyphens, so no part of a longer number is taken for one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import checksums as C
from . import spans as S

# What a context word adds, the least confidence with one, and how far before a match it counts.
BOOST = 0.35
CONTEXT_LEAST = 0.4
CONTEXT_CHARS = 50


@dataclass(frozen=True)
class Recognizer:
    """`needs` is a substring without which there is no match; `body` is bounded on both sides."""

    kind: str
    body: str
    confidence: float
    check: C.Check | None = None
    words: tuple[str, ...] = ()
    needs: str = ""
    bounded: bool = True

    @property
    def pattern(self) -> str:
        return f"(?<![A-Za-z0-9-])(?:{self.body})(?![A-Za-z0-9-])" if self.bounded else self.body

    def spans(self, text: Column, threshold: float) -> Column:
        found = S.matches(text, self.pattern, self.kind, self.confidence)
        if self.check:
            found = F.filter(found, lambda s: self.check(s["text"]))
        if self.words:
            near = "(?i)\\b(?:" + "|".join(self.words) + ")\\b"
            before = lambda s: F.substring(text, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT_CHARS)))
            raised = max(CONTEXT_LEAST, min(1.0, self.confidence + BOOST))
            found = F.transform(found, lambda s: s.withField("confidence", F.when(F.regexp_like(before(s), F.lit(near)), raised).otherwise(self.confidence)))
            found = F.filter(found, lambda s: s["confidence"] >= threshold)
        return F.when(F.contains(text, F.lit(self.needs)), found).otherwise(F.array().cast(S.SPAN)) if self.needs else found


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_PASSPORT = ("passport", "passport number", "travel document")

STRUCTURED = (
    Recognizer("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 1.0, needs="@", bounded=False),
    Recognizer("URL", r"https?://[^\s\"'<>]+", 0.5, needs="://", bounded=False),
    Recognizer("IP_ADDRESS", rf"(?<!\.){_OCTET}(?:\.{_OCTET}){{3}}(?!\.[0-9])", 0.6, needs="."),
    Recognizer("PHONE_NUMBER", r"\+[0-9][0-9 ().-]{8,18}[0-9]", 0.75, needs="+"),
    Recognizer("PHONE_NUMBER", r"(?<!\+[0-9] )\(?[2-9][0-9]{2}\)?[-. ][2-9][0-9]{2}[-. ][0-9]{4}", 0.4),
    Recognizer("CREDIT_CARD", r"[3-6][0-9]{3}(?:[ -]?[0-9]){9,15}", 0.95, C.luhn),
    Recognizer("US_SSN", r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", 0.85, needs="-"),
    Recognizer("US_ITIN", r"9[0-9]{2}-(?:5[0-9]|6[0-5]|7[0-9]|8[0-8]|9[0-2]|9[4-9])-[0-9]{4}", 0.85, needs="-"),
    Recognizer("US_PASSPORT", r"[A-Z][0-9]{8}|[0-9]{9}", 0.05, words=_PASSPORT),
    Recognizer("US_DRIVER_LICENSE", r"[A-Z][0-9]{7,12}|[A-Z]{2}[0-9]{6}", 0.2, words=("driver", "driving", "license", "licence", "permit")),
    Recognizer("US_BANK_NUMBER", r"[0-9]{8,17}", 0.05, words=("account", "acct", "bank", "checking", "savings")),
    Recognizer("IBAN_CODE", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", 0.95, C.iban),
    Recognizer("CRYPTO", r"[13][1-9A-HJ-NP-Za-km-z]{25,33}", 0.95, C.base58check),
    Recognizer("CRYPTO", r"bc1[02-9ac-hj-np-z]{11,71}", 0.95, C.bech32, needs="bc1"),
    Recognizer("DATE_TIME", r"[12][0-9]{3}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])", 0.6, C.iso_date, needs="-"),
    Recognizer("DATE_TIME", r"(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12][0-9]|3[01])/(?:[12][0-9]{3}|[0-9]{2})", 0.6, C.us_date, needs="/"),
    Recognizer("MEDICAL_LICENSE", r"[ABCDEFGHJKLMPRSTUX][A-Z9][0-9]{7}", 0.85, C.us_dea),
    Recognizer("UK_NHS", r"[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{4}", 0.85, C.uk_nhs),
    Recognizer("SG_NRIC_FIN", r"[STFGM][0-9]{7}[A-Z]", 0.85, C.sg_nric),
    Recognizer("AU_ABN", r"[0-9]{2}(?: ?[0-9]{3}){3}", 0.85, C.au_abn),
    Recognizer("AU_ACN", r"[0-9]{3}(?: ?[0-9]{3}){2}", 0.85, C.au_acn),
    Recognizer("AU_TFN", r"[0-9]{3}(?: ?[0-9]{3}){2}", 0.85, C.au_tfn),
    Recognizer("AU_MEDICARE", r"[2-6][0-9]{3} ?[0-9]{5} ?[0-9]", 0.85, C.au_medicare),
    Recognizer("IN_PAN", r"[A-Z]{3}[ABCFGHJLPT][A-Z][0-9]{4}[A-Z]", 0.85),
    Recognizer("IN_AADHAAR", r"[2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}", 0.85, C.in_aadhaar),
    Recognizer("IN_VEHICLE_REGISTRATION", r"[A-Z]{2}[ -]?[0-9]{1,2}[ -]?[A-Z]{1,3}[ -]?[0-9]{4}", 0.5),
    Recognizer("IN_VOTER", r"[A-Z]{3}[0-9]{7}", 0.4),
    Recognizer("IN_PASSPORT", r"[A-PR-WY][1-9][0-9]{6}", 0.1, words=_PASSPORT),
)


def recognize(text: Column, recognizers: tuple[Recognizer, ...] = STRUCTURED, threshold: float = 0.3) -> Column:
    """Spans of all recognizers that reach the threshold, sorted by start; of one type, a span inside
    another one (or the same) is left out."""
    some = [r for r in recognizers if r.confidence >= threshold or r.words]
    if not some:
        return F.array().cast(S.SPAN)
    found = S.by_start(F.concat(*(r.spans(text, threshold) for r in some)))
    kinds = {r.kind for r in some}
    if len(kinds) < len(some):  # several recognizers of a type
        start = F.array().cast(S.SPAN)
        held = lambda a, s: F.exists(a, lambda x: (x["entity_type"] == s["entity_type"]) & (x["start"] <= s["start"]) & (x["end"] >= s["end"]))
        found = F.aggregate(found, start, lambda a, s: F.when(held(a, s), a).otherwise(F.concat(a, F.array(s))))
    return F.coalesce(found, F.array().cast(S.SPAN))
