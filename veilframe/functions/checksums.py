"""Check digits of identifiers as column expressions: true where the value's checksum holds.

Values come as they stand in a text; blanks and hyphens between their parts don't count. A value of
another length or alphabet than the scheme's isn't valid.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Check = Callable[[Column], Column]

BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
_VERHOEFF = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]  # where a digit goes from one place to the next


def bare(value: Column) -> Column:
    """Without blanks and hyphens."""
    return F.translate(value, " -", "")


def digit(value: Column, k: int) -> Column:
    """The k-th digit, from 1."""
    return F.substring(value, k, 1).try_cast("int")


def weighted(value: Column, weights: Sequence[int]) -> Column:
    """The sum of the first digits, each times its weight."""
    total = F.lit(0)
    for k, w in enumerate(weights):
        total = total + digit(value, k + 1) * w
    return total


def _sure(length: int | None, check: Check) -> Check:
    def of(value: Column) -> Column:
        x = bare(value)
        ok = check(x) if length is None else (F.length(x) == length) & check(x)
        return F.coalesce(ok, F.lit(False))

    return of


luhn: Check = _sure(None, lambda x: F.call_function("luhn_check", x))
uk_nhs: Check = _sure(10, lambda x: weighted(x, range(10, 0, -1)) % 11 == 0)
au_abn: Check = _sure(11, lambda x: (weighted(x, (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)) - 10) % 89 == 0)  # the first digit less one
au_acn: Check = _sure(9, lambda x: (weighted(x, range(8, 0, -1)) + digit(x, 9)) % 10 == 0)
au_tfn: Check = _sure(9, lambda x: weighted(x, (1, 4, 3, 7, 5, 8, 6, 9, 10)) % 11 == 0)
au_medicare: Check = _sure(10, lambda x: weighted(x, (1, 3, 7, 9, 1, 3, 7, 9)) % 10 == digit(x, 9))
us_dea: Check = _sure(9, lambda x: weighted(F.substring(x, 3, 7), (1, 2, 1, 2, 1, 2)) % 10 == digit(x, 9))


def _nric(x: Column) -> Column:
    """The last letter, by the series of the first one."""
    total = weighted(F.substring(x, 2, 7), (2, 7, 6, 5, 4, 3, 2))
    series = F.substring(x, 1, 1)
    letter = lambda table, add: F.substring(F.lit(table), (total + add) % 11 + 1, F.lit(1))
    want = (
        F.when(series == "S", letter("JZIHGFEDCBA", 0)).when(series == "T", letter("JZIHGFEDCBA", 4)).when(series == "F", letter("XWUTRQPNMLK", 0))
        .when(series == "G", letter("XWUTRQPNMLK", 4)).when(series == "M", letter("XWUTRQPNJLK", 3))
    )
    return want == F.substring(x, 9, 1)


sg_nric: Check = _sure(9, _nric)


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _iban(x: Column) -> Column:
    """The country and its check digits go to the end, letters count as 10 to 35, modulo 97."""
    turned = _chars(F.upper(F.concat(F.substring(x, 5, 40), F.substring(x, 1, 4))))
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


iban: Check = _sure(None, lambda x: F.length(x).between(15, 34) & _iban(x))


def verhoeff_tables() -> tuple[list[int], list[int]]:
    """The products in the symmetries of a pentagon (10 x 10), and the digits after 0 to 7 places (8 x 10)."""
    product = [((j + k) % 5 if k < 5 else 5 + (j + k) % 5) if j < 5 else (5 + (j - k) % 5 if k < 5 else (j - k) % 5) for j in range(10) for k in range(10)]
    places = [list(range(10))]
    for _ in range(7):
        places.append([_VERHOEFF[d] for d in places[-1]])
    return product, [d for row in places for d in row]


def _verhoeff(x: Column) -> Column:
    product, places = (F.lit(t) for t in verhoeff_tables())
    of = F.transform(F.reverse(_chars(x)), lambda c, i: F.element_at(places, i % 8 * 10 + c.try_cast("int") + 1))
    return F.aggregate(of, F.lit(0), lambda a, d: F.element_at(product, a * 10 + d + 1)) == 0


in_aadhaar: Check = _sure(12, _verhoeff)

_LIMBS = 13  # of 16 bits: 25 bytes and a bit


def _base58(x: Column) -> Column:
    """25 bytes whose last four begin the double SHA-256 of the others. The number is kept in limbs of
    16 bits, the least first; each character multiplies it by 58 and adds its value."""
    zero = F.array_repeat(F.lit(0).cast("long"), _LIMBS)

    def times(limbs: Column, c: Column) -> Column:
        start = F.struct((F.instr(F.lit(BASE58), c) - 1).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("out"))
        step = lambda a, v: F.struct(F.shiftright(v * 58 + a["carry"], 16).alias("carry"), F.concat(a["out"], F.array((v * 58 + a["carry"]) % 65536)).alias("out"))
        return F.aggregate(limbs, start, step, lambda a: a["out"])

    limbs = F.aggregate(_chars(x), zero, times)
    hex_ = F.array_join(F.transform(F.reverse(limbs), lambda v: F.lpad(F.hex(v), 4, "0")), "")
    payload, check = F.substring(hex_, 3, 42), F.substring(hex_, 45, 8)
    twice = F.sha2(F.unhex(F.sha2(F.unhex(payload), 256)), 256)
    return (F.substring(hex_, 1, 2) == "00") & (F.lower(check) == F.substring(twice, 1, 8))


def _bech32(x: Column) -> Column:
    """The polynomial remainder of the prefix and the data is 1 (or, in later versions, another constant)."""
    generator = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
    low = F.lower(x)
    values = F.transform(_chars(F.substring(low, 4, 90)), lambda c: (F.instr(F.lit(BECH32), c) - 1).cast("long"))
    prefix = F.array(*(F.lit(v).cast("long") for v in (3, 3, 0, 2, 3)))  # of "bc": high bits, 0, low bits

    def step(a: Column, v: Column) -> Column:
        top, next_ = F.shiftright(a, 25), F.shiftleft(a.bitwiseAND(F.lit(0x1FFFFFF)), 5).bitwiseXOR(v)
        for k, g in enumerate(generator):
            next_ = F.when(F.shiftright(top, k).bitwiseAND(F.lit(1)) == 1, next_.bitwiseXOR(F.lit(g))).otherwise(next_)
        return next_

    return ~F.exists(values, lambda v: v < 0) & F.aggregate(F.concat(prefix, values), F.lit(1).cast("long"), step).isin(1, 0x2BC830A3)


base58check: Check = _sure(None, _base58)
bech32: Check = _sure(None, _bech32)


def iso_date(value: Column) -> Column:
    """A day of the calendar."""
    return F.coalesce(F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def us_date(value: Column) -> Column:
    year = F.when(F.length(F.substring_index(value, "/", -1)) == 2, F.concat(F.lit("20"), F.substring_index(value, "/", -1))).otherwise(F.substring_index(value, "/", -1))
    return F.coalesce(F.try_to_timestamp(F.concat(F.substring_index(value, "/", 2), F.lit("/"), year), F.lit("M/d/yyyy")).isNotNull(), F.lit(False))
