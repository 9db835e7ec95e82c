"""Queries on recognizers with checksums: identifiers planted in texts, and near misses of them.

Each customer's text holds one value: of the type that its key picks, valid or a near miss. Values are
made from the key by SQL that Spark and DuckDB both take; the oracle knows what was planted, not how
it is recognized.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checksums import verhoeff_tables
from ..functions.recognizers import STRUCTURED
from ..operators import explicit
from ..sources.shared import stored
from .rendered import customers

_N = "(CAST(c_custkey AS BIGINT) * 7919 + 123457)"


def _digits(n: int, salt: int = 1) -> str:
    return f"lpad(CAST(({_N} * {salt} + {salt}) % {10**n} AS STRING), {n}, '0')"


def _sum(s: str, weights) -> str:
    return "(" + " + ".join(f"{w} * CAST(substr({s}, {k + 1}, 1) AS INT)" for k, w in enumerate(weights)) + ")"


def _text(n: str) -> str:
    return f"CAST({n} AS STRING)"


def _checked(base: str, check: str, most: int = 10) -> tuple[str, str]:
    """The base with its check digit, and with the next one; NULL where a check of 10 has no digit."""
    valid = f"CASE WHEN {check} < 10 THEN concat({base}, {_text(check)}) END"
    return valid, f"CASE WHEN ({check} + 1) % {most} < 10 THEN concat({base}, {_text(f'({check} + 1) % {most}')}) END"


def _luhn_check(s: str, n: int) -> str:
    terms = [f"CAST(substr({s}, {k}, 1) AS INT)" if (n - k) % 2 else f"(2 * CAST(substr({s}, {k}, 1) AS INT) - CASE WHEN CAST(substr({s}, {k}, 1) AS INT) > 4 THEN 9 ELSE 0 END)" for k in range(1, n + 1)]
    return f"((10 - ({' + '.join(terms)}) % 10) % 10)"


def _verhoeff_check(s: str, n: int) -> str:
    product, places = ("".join(map(str, t)) for t in verhoeff_tables())
    c = "0"
    for k in range(1, n + 1):  # from the right, the check digit's place is 0
        own = f"CAST(substr('{places}', {k % 8 * 10 + 1} + CAST(substr({s}, {n + 1 - k}, 1) AS INT), 1) AS INT)"
        c = f"CAST(substr('{product}', {c} * 10 + {own} + 1, 1) AS INT)"
    return f"CAST(substr('0432156789', {c} + 1, 1) AS INT)"  # the inverse


def _spaced(s: str, *sizes: int) -> str:
    """Groups of digits with blanks between."""
    at, parts = 1, []
    for n in sizes:
        parts.append(f"substr({s}, {at}, {n})")
        at += n
    return "(" + " || ' ' || ".join(parts) + ")"


_D6, _D7, _D8, _D9 = (_digits(n) for n in (6, 7, 8, 9))
_CARD = f"concat('4', {_digits(14, 31)})"
_BBAN = f"concat('3704', {_digits(14, 77)})"
_IBAN_CHECK = f"(98 - CAST(concat({_BBAN}, '131400') AS DECIMAL(38,0)) % 97)"
_ABN = f"(10 + (89 - {_sum(_D9, (3, 5, 7, 9, 11, 13, 15, 17, 19))} % 89) % 89)"
_NRIC = f"({_sum(_D7, (2, 7, 6, 5, 4, 3, 2))} % 11)"
_AADHAAR = f"concat('7', {_digits(10, 13)})"
_MEDICARE = f"concat({_text('2 + c_custkey % 5')}, {_D7})"
_MEDICARE_CHECK = f"{_sum(_MEDICARE, (1, 3, 7, 9, 1, 3, 7, 9))} % 10"
_DAY = "lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0')"
_NHS = _checked(_D9, f"((11 - {_sum(_D9, range(10, 1, -1))} % 11) % 11)", 11)
_TFN = _checked(_D8, f"({_sum(_D8, (1, 4, 3, 7, 5, 8, 6, 9))} % 11)", 11)

#: (type, valid value, near miss, words before, confidence) as SQL on a customer's key.
PLANTED = [
    ("UK_NHS", *_NHS, "NHS ", 0.85),
    ("CREDIT_CARD", *_checked(_CARD, _luhn_check(_CARD, 15)), "paid by ", 0.95),
    ("IBAN_CODE", f"concat('DE', lpad({_text(f'CAST({_IBAN_CHECK} AS INT)')}, 2, '0'), {_BBAN})", f"concat('DE', lpad({_text(f'CAST({_IBAN_CHECK} - 1 AS INT)')}, 2, '0'), {_BBAN})", "to ", 0.95),
    ("AU_ABN", f"concat({_text(_ABN)}, {_D9})", f"concat({_text(f'(10 + ({_ABN} - 10 + 1) % 89)')}, {_D9})", "ABN ", 0.85),
    ("AU_ACN", *_checked(_D8, f"((10 - {_sum(_D8, range(8, 0, -1))} % 10) % 10)"), "ACN ", 0.85),
    ("AU_TFN", *_TFN, "TFN ", 0.85),
    ("AU_MEDICARE", f"concat({_MEDICARE}, {_text(_MEDICARE_CHECK)}, '1')", f"concat({_MEDICARE}, {_text(f'({_MEDICARE_CHECK} + 1) % 10')}, '1')", "Medicare ", 0.85),
    ("IN_AADHAAR", *_checked(_AADHAAR, _verhoeff_check(_AADHAAR, 11)), "Aadhaar ", 0.85),
    ("SG_NRIC_FIN", f"concat('S', {_D7}, substr('JZIHGFEDCBA', 1 + {_NRIC}, 1))", f"concat('S', {_D7}, substr('JZIHGFEDCBA', 1 + ({_NRIC} + 1) % 11, 1))", "NRIC ", 0.85),
    ("MEDICAL_LICENSE", *_checked(f"concat('BX', {_D6})", f"({_sum(_D6, (1, 2, 1, 2, 1, 2))} % 10)"), "DEA ", 0.85),
    ("CRYPTO", "'1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa'", "'1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb'", "wallet ", 0.95),
    ("CRYPTO", "'bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4'", "'bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5'", "wallet ", 0.95),
    ("US_SSN", f"concat('512-', substr({_D6}, 1, 1), '1-', lpad({_text('1 + c_custkey % 9999')}, 4, '0'))", f"concat('666-', substr({_D6}, 1, 1), '1-', lpad({_text('1 + c_custkey % 9999')}, 4, '0'))", "SSN ", 0.85),
    ("US_SSN", f"concat('078-05-', lpad({_text('1 + c_custkey % 9999')}, 4, '0'))", f"concat('1078-05-', lpad({_text('1 + c_custkey % 9999')}, 4, '0'), '1')", "id ", 0.85),
    ("US_ITIN", f"concat('9', substr({_D6}, 1, 2), '-70-', substr({_D8}, 1, 4))", f"concat('9', substr({_D6}, 1, 2), '-93-', substr({_D8}, 1, 4))", "ITIN ", 0.85),
    ("US_PASSPORT", f"concat('C', {_D8})", f"concat('C', {_D8}, '9')", "passport number ", 0.4),
    ("US_DRIVER_LICENSE", f"concat('D', {_D7})", f"concat('4', {_D7})", "license ", 0.55),
    ("US_BANK_NUMBER", f"concat('7', {_D9})", f"concat('7', {_D9}, 'X')", "bank account ", 0.4),
    ("IN_PASSPORT", f"concat('K7', {_D6})", f"concat('K0', {_D6})", "passport ", 0.45),
    ("DATE_TIME", f"concat('2024-02-', {_DAY})", f"concat('2023-02-', {_text('29 + c_custkey % 2')})", "on ", 0.6),
    ("DATE_TIME", f"concat('2/', {_text('1 + c_custkey % 28')}, '/2023')", f"concat('2/', {_text('29 + c_custkey % 2')}, '/2023')", "on ", 0.6),
    ("PHONE_NUMBER", f"concat('555-223-', substr({_D8}, 1, 4))", f"concat('155-223-', substr({_D8}, 1, 4))", "call ", 0.4),
    ("IP_ADDRESS", f"concat('10.0.', {_text('c_custkey % 256')}, '.7')", f"concat('10.0.', {_text('256 + c_custkey % 256')}, '.7')", "from ", 0.6),
    ("IN_PAN", f"concat('ABCPK', substr({_D8}, 1, 4), 'Z')", f"concat('ABCQK', substr({_D8}, 1, 4), 'Z')", "PAN ", 0.85),
    ("IN_VOTER", f"concat('XYZ', {_D7})", f"concat('XYZ', {_D7}, '1')", "voter ", 0.4),
    ("IN_VEHICLE_REGISTRATION", f"concat('MH12AB', substr({_D8}, 1, 4))", f"concat('MH12AB', substr({_D8}, 1, 3))", "car ", 0.5),
    ("UK_NHS", _spaced(f"({_NHS[0]})", 3, 3, 4), f"concat({_D9}, '00')", "NHS ", 0.85),
    ("CREDIT_CARD", _spaced(f"({_checked(_CARD, _luhn_check(_CARD, 15))[0]})", 4, 4, 4, 4), f"concat('9', {_CARD})", "card ", 0.95),
]
_T = len(PLANTED)


def _by_kind(column) -> str:
    return f"CASE c_custkey % {_T} " + " ".join(f"WHEN {k} THEN {column(p)}" for k, p in enumerate(PLANTED)) + " END"


_VALID = f"((c_custkey - c_custkey % {_T}) / {_T}) % 2 < 1"
_VALUE = _by_kind(lambda p: f"CASE WHEN {_VALID} THEN {p[1]} ELSE {p[2]} END")
_BEFORE = _by_kind(lambda p: f"'As told, {p[3]}'")
_KIND = _by_kind(lambda p: f"'{p[0]}'")
_CONFIDENCE = _by_kind(lambda p: f"CAST({p[4]} AS DOUBLE)")


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written out, so the long expressions that make the values stand in one plan of their own."""
    made = customers(spark, sf_dir).selectExpr("c_custkey AS id", f"{_KIND} AS kind", f"{_BEFORE} AS before", f"{_VALUE} AS value")
    return stored(made, "planted").selectExpr("id", "kind", "concat(before, coalesce(value, 'nothing'), ', as it stands.') AS text")


def recognized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planted type's spans in each text: all valid values, and no near miss."""
    rows = _planted(spark, sf_dir)
    found = explicit.entities(rows, recognizers=STRUCTURED)
    return found.select("id", "kind", F.explode("entities").alias("e")).where("e.entity_type = kind").select("id", "e.entity_type", "e.start", "e.end", "e.text", "e.confidence")


RECOGNIZED_SQL = f"""SELECT id, kind AS entity_type, length(before)::INT AS start, (length(before) + length(value))::INT AS "end", value AS text, confidence
 FROM (SELECT c_custkey AS id, {_KIND} AS kind, {_BEFORE} AS before, {_VALUE} AS value, {_CONFIDENCE} AS confidence, {_VALID} AS valid FROM customer) WHERE valid AND value IS NOT NULL"""


REGISTRY = {"recognize_planted": (recognized, RECOGNIZED_SQL)}
