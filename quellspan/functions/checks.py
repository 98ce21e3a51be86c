"""Checks of values: check digits, reserved ranges, entropy. Each is a column expression with a DuckDB twin of the same name.

``Check`` pairs both: ``column(v)`` and ``sql(v)`` take the value and give a boolean.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    column: Callable[[Column], Column]
    sql: Callable[[str], str]

    def __and__(self, other: Check) -> Check:
        return Check(lambda v: self.column(v) & other.column(v), lambda v: f"({self.sql(v)} AND {other.sql(v)})")

    def __or__(self, other: Check) -> Check:
        return Check(lambda v: self.column(v) | other.column(v), lambda v: f"({self.sql(v)} OR {other.sql(v)})")


def shaped(pattern: str) -> Check:
    """The value, or a part of it, matches."""
    return Check(lambda v: v.rlike(pattern), lambda v: f"regexp_matches({v}, '{pattern}')")


def unlike(pattern: str) -> Check:
    return Check(lambda v: ~v.rlike(pattern), lambda v: f"NOT regexp_matches({v}, '{pattern}')")


# ---- digits -------------------------------------------------------------------------------------------------------------


def digits_of(v: Column) -> Column:
    """The decimal digits of a value as an array of integers."""
    return F.transform(F.split(F.regexp_replace(v, "[^0-9]", ""), ""), lambda x: x.cast("int"))


def sql_digits(v: str) -> str:
    return f"list_transform(string_split(regexp_replace({v}, '[^0-9]', '', 'g'), ''), lambda x: TRY_CAST(x AS INTEGER))"


def _chars(v: Column) -> Column:
    """Letters as 10 to 35, digits as themselves, of an upper-case value without separators."""
    clean = F.regexp_replace(F.upper(v), "[^0-9A-Z]", "")
    return F.transform(F.split(clean, ""), lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))


def _sql_chars(v: str) -> str:
    return f"list_transform(string_split(regexp_replace(upper({v}), '[^0-9A-Z]', '', 'g'), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"


def weighted(weights, modulus: int, good: Callable[[Column], Column], sql_good: str, chars: bool = False, fold: bool = False) -> Check:
    """The weighted sum of the characters modulo ``modulus`` passes ``good``; ``fold``: products take their digit sum.

    ``sql_good`` is the same condition, ``{r}`` the remainder. The value must have as many characters as there are weights.
    """
    of, sql_of = (_chars, _sql_chars) if chars else (digits_of, sql_digits)

    def column(v):
        d = of(v)
        product = F.zip_with(d, F.array(*map(F.lit, weights)), lambda x, w: x * w)
        if fold:
            product = F.transform(product, lambda p: F.floor(p / 10) + p % 10)
        total = F.aggregate(product, F.lit(0).cast("bigint"), lambda a, x: a + x)
        return F.coalesce((F.size(d) == len(weights)) & good(F.pmod(total, F.lit(modulus))), F.lit(False))

    def sql(v):
        d = sql_of(v)
        term = f"d[i] * {list(weights)}[i]"
        if fold:
            term = f"({term}) // 10 + ({term}) % 10"
        total = f"list_sum(list_transform(range(1, {len(weights) + 1}), lambda i: {term}))"
        return f"(SELECT coalesce(len(d) = {len(weights)} AND ({sql_good.replace('{r}', f'(({total}) % {modulus})')}), FALSE) FROM (SELECT {d} AS d))"

    return Check(column, sql)


ZERO = (lambda r: r == 0, "{r} = 0")

#: Not the same digit in every place.
VARIED = unlike("^(" + "|".join(f"[{d} -]+" for d in range(10)) + ")$")


def closed(weights, modulus: int, sign: int = 1, offset: int = 0, fold: bool = False, read=(lambda v: v, lambda v: v)) -> Check:
    """The digit behind the weighted ones is ``offset + sign * sum`` modulo ``modulus``; ``read`` turns the value into digits first."""
    n = len(weights)

    def column(v):
        d = digits_of(read[0](v))
        product = F.zip_with(F.slice(d, 1, n), F.array(*map(F.lit, weights)), lambda x, w: x * w)
        if fold:
            product = F.transform(product, lambda p: F.floor(p / 10) + p % 10)
        total = F.aggregate(product, F.lit(0).cast("bigint"), lambda a, x: a + x)
        return F.coalesce((F.size(d) == n + 1) & (F.pmod(total * sign + offset, F.lit(modulus)) == F.get(d, F.lit(n))), F.lit(False))

    def sql(v):
        term = f"d[i] * {list(weights)}[i]"
        if fold:
            term = f"({term}) // 10 + ({term}) % 10"
        total = f"list_sum(list_transform(range(1, {n + 1}), lambda i: {term}))"
        return f"(SELECT coalesce(len(d) = {n + 1} AND ((({total}) * {sign} + {offset}) % {modulus} + {modulus}) % {modulus} = d[{n + 1}], FALSE) FROM (SELECT {sql_digits(read[1](v))} AS d))"

    return Check(column, sql)


def _lettered(at: int):
    """Reads a value whose character ``at`` (from 1) is a letter as digits: A is 01, Z is 26."""

    def column(v):
        c = F.regexp_replace(F.upper(v), "[^0-9A-Z]", "")
        return F.concat(F.substring(c, 1, at - 1), F.lpad((F.ascii(F.substring(c, at, 1)) - 64).cast("string"), 2, "0"), F.substring(c, at + 1, 64))

    def sql(v):
        c = f"regexp_replace(upper({v}), '[^0-9A-Z]', '', 'g')"
        return f"(substr({c}, 1, {at - 1}) || lpad(CAST(ascii(substr({c}, {at}, 1)) - 64 AS VARCHAR), 2, '0') || substr({c}, {at + 1}))"

    return column, sql


#: Pension insurance: area, birth date, first letter of the name, serial, check digit.
DE_SOCIAL_SECURITY = closed((2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1), 10, fold=True, read=_lettered(9))
#: Health insurance: a letter, eight digits, a check digit.
DE_HEALTH_INSURANCE = closed((1, 2) * 5, 10, fold=True, read=_lettered(1))
#: Physicians: the seventh digit closes the first six, the last two name the field.
DE_LANR = closed((4, 9) * 3, 10, sign=-1, read=(lambda v: F.substring(v, 1, 7), lambda v: f"substr({v}, 1, 7)")) & VARIED
#: Practices: an area from 01 to 99 and a serial; no check digit.
DE_BSNR = unlike("^00") & VARIED
#: Value-added tax in Austria: the Luhn sum of seven digits from 96.
AT_UID = closed((1, 2) * 3 + (1,), 10, sign=-1, offset=96, fold=True)
#: Number plates of the form in use: an age from 02 to 29 or 51 to 79.
UK_VEHICLE = shaped("^[A-Z]{2}(0[2-9]|[12][0-9]|5[1-9]|[67][0-9])")

#: What a digit or letter counts at an odd place of the Italian tax code.
IT_ODD = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)


def _it_code(v: Column) -> Column:
    """Sixteen characters; the last is the letter at the sum of the others modulo 26."""
    c = _chars(v)
    odd = F.array(*map(F.lit, IT_ODD))
    each = F.transform(F.slice(c, 1, 15), lambda x, i: F.when(i % 2 == 0, F.get(odd, x)).when(x > 9, x - 10).otherwise(x))
    total = F.aggregate(each, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.coalesce((F.size(c) == 16) & (total % 26 == F.get(c, F.lit(15)) - 10), F.lit(False))


IT_FISCAL_CODE = Check(
    _it_code,
    lambda v: f"(SELECT coalesce(len(c) = 16 AND list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN {list(IT_ODD)}[c[i] + 1] WHEN c[i] > 9 THEN c[i] - 10 ELSE c[i] END)) % 26 = c[16] - 10, FALSE) FROM (SELECT {_sql_chars(v)} AS c))",
)

#: Routing number of a bank: weights 3, 7, 1, and a first pair that is in use.
US_ABA = weighted((3, 7, 1) * 3, 10, *ZERO) & shaped("^(0[0-9]|1[0-2]|2[1-9]|3[0-2]|6[1-9]|7[0-2]|80)") & VARIED
#: Health number: weights 10 to 1, so that the check digit closes the sum.
UK_NHS = weighted(range(10, 0, -1), 11, *ZERO) & VARIED
PL_PESEL = weighted((1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1), 10, *ZERO)
#: Social security number with country prefix 756: the check digit of an EAN-13.
CH_AHV = weighted((1, 3) * 6 + (1,), 10, *ZERO)
#: Business number: weights 5 4 3 2 7 6 5 4, the check digit closes modulo 11.
CH_UID = weighted((5, 4, 3, 2, 7, 6, 5, 4, 1), 11, *ZERO)
AT_SOCIAL_SECURITY = weighted((3, 7, 9, -1, 5, 8, 4, 2, 1, 6), 11, *ZERO)
SE_ORGANISATION = weighted((2, 1) * 4 + (2, 1), 10, *ZERO, fold=True) & shaped("^[0-9]{2}[2-9]")
#: Machine-readable document number (ICAO 9303): weights 7 3 1 where a check digit follows the nine characters.
DE_DOCUMENT = weighted((7, 3, 1) * 3 + (-1,), 10, *ZERO, chars=True) | shaped("^.{9}$")
#: Provider number: Luhn over the prefix 80840, which adds 24.
US_NPI = weighted((2, 1) * 5, 10, lambda r: (r + 24) % 10 == 0, "({r} + 24) % 10 = 0", fold=True)
AU_ABN = weighted((10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19), 89, lambda r: r == 10, "{r} = 10")


def _luhn(v: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", F.regexp_replace(v, "[^0-9]", "")), F.lit(False))


def _sql_luhn(v: str) -> str:
    twice = "CASE WHEN i % 2 = 0 THEN 2 * r[i] - CASE WHEN r[i] > 4 THEN 9 ELSE 0 END ELSE r[i] END"
    return f"(SELECT coalesce(len(r) > 0 AND list_sum(list_transform(range(1, len(r) + 1), lambda i: {twice})) % 10 = 0, FALSE) FROM (SELECT list_reverse({sql_digits(v)}) AS r))"


LUHN = Check(_luhn, _sql_luhn)


def _mod_97(v: Column) -> Column:
    """Remainder of the rearranged account number, letter by letter."""
    chars = _chars(F.concat(F.substring(F.regexp_replace(v, "[^0-9A-Za-z]", ""), 5, 64), F.substring(v, 1, 4)))
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)


def _sql_mod_97(v: str) -> str:
    moved = f"substr(regexp_replace({v}, '[^0-9A-Za-z]', '', 'g'), 5) || substr({v}, 1, 4)"
    return f"list_reduce({_sql_chars(moved)}, lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97)"


IBAN = Check(lambda v: F.coalesce((F.length(F.regexp_replace(v, "[^0-9A-Za-z]", "")).between(15, 34)) & (_mod_97(v) == 1), F.lit(False)), lambda v: f"coalesce(length(regexp_replace({v}, '[^0-9A-Za-z]', '', 'g')) BETWEEN 15 AND 34 AND {_sql_mod_97(v)} = 1, FALSE)")


def _closes_11_10(d: Column, n: int) -> Column:
    """Whether digit ``n`` of the array is the modulo 11, 10 check of those before it."""
    step = lambda p, x: F.when((p + x) % 10 == 0, 20).otherwise(2 * ((p + x) % 10)) % 11
    return (11 - F.aggregate(F.slice(d, 1, n - 1), F.lit(10), step)) % 10 == F.get(d, F.lit(n - 1))


def _de_vat(v: Column) -> Column:
    d = digits_of(v)
    return F.coalesce((F.size(d) == 9) & _closes_11_10(d, 9), F.lit(False))


DE_VAT_ID = Check(_de_vat, lambda v: f"(SELECT coalesce(len(d) = 9 AND (11 - list_reduce(list_prepend(10, d[1:8]), lambda p, x: CASE WHEN (p + x) % 10 = 0 THEN 20 ELSE 2 * ((p + x) % 10) END % 11)) % 10 = d[9], FALSE) FROM (SELECT {sql_digits(v)} AS d))")


def _de_tax(v: Column) -> Column:
    """Eleven digits, the last a modulo 11, 10 check; one digit of the first ten occurs twice or three times."""
    d = digits_of(v)
    distinct = F.size(F.array_distinct(F.slice(d, 1, 10)))
    return F.coalesce((F.size(d) == 11) & (F.get(d, F.lit(0)) != 0) & distinct.isin(8, 9) & _closes_11_10(d, 11), F.lit(False))


DE_TAX_ID = Check(_de_tax, lambda v: f"(SELECT coalesce(len(d) = 11 AND d[1] <> 0 AND len(list_distinct(d[1:10])) IN (8, 9) AND (11 - list_reduce(list_prepend(10, d[1:10]), lambda p, x: CASE WHEN (p + x) % 10 = 0 THEN 20 ELSE 2 * ((p + x) % 10) END % 11)) % 10 = d[11], FALSE) FROM (SELECT {sql_digits(v)} AS d))")

_NIF = "TRWAGMYFPDXBNJZSQVHLCKE"


def _nif(v: Column) -> Column:
    number = F.translate(F.substring(F.upper(v), 1, 1), "XYZ", "012")
    digits = F.regexp_replace(F.concat(number, F.substring(v, 2, 20)), "[^0-9]", "")
    return F.coalesce(F.lit(_NIF).substr((F.try_to_number(digits, F.lit("999999999")) % 23 + 1).cast("int"), F.lit(1)) == F.right(F.upper(v), F.lit(1)), F.lit(False))


#: Identity numbers of people and foreigners: the letter at the number modulo 23.
ES_NIF = Check(_nif, lambda v: f"coalesce(substr('{_NIF}', CAST(TRY_CAST(regexp_replace(translate(substr(upper({v}), 1, 1), 'XYZ', '012') || substr({v}, 2), '[^0-9]', '', 'g') AS BIGINT) % 23 + 1 AS INTEGER), 1) = right(upper({v}), 1), FALSE)")

BITLOCKER = Check(
    lambda v: F.coalesce((F.size(F.split(v, "-")) == 8) & F.forall(F.split(v, "-"), lambda g: (g.try_cast("int") % 11 == 0) & (g.try_cast("int") < 720896)), F.lit(False)),
    lambda v: f"coalesce(len(string_split({v}, '-')) = 8 AND len(list_filter(string_split({v}, '-'), lambda g: TRY_CAST(g AS INTEGER) % 11 = 0 AND TRY_CAST(g AS INTEGER) < 720896)) = 8, FALSE)",
)


def _part(v: Column, sep: str, i: int) -> Column:
    return F.get(F.split(v, sep), F.lit(i)).try_cast("int")


#: Numbers that were printed as samples, and those of one digit.
NO_SSN = "^(078-05-1120|219-09-9999|457-55-5462|" + "|".join(f"{d * 3}-{d * 2}-{d * 4}" for d in "123456789") + ")$"


def _ssn(v: Column) -> Column:
    area, group, serial = (_part(v, "-", i) for i in range(3))
    return F.coalesce(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0) & ~v.rlike(NO_SSN), F.lit(False))


US_SSN = Check(_ssn, lambda v: "(SELECT coalesce(a BETWEEN 1 AND 899 AND a <> 666 AND g > 0 AND s > 0 AND NOT " + f"regexp_matches({v}, '{NO_SSN}')" + ", FALSE) FROM (SELECT " + ", ".join(f"TRY_CAST(string_split({v}, '-')[{i}] AS INTEGER) AS {n}" for i, n in ((1, "a"), (2, "g"), (3, "s"))) + "))")


def _routable(v: Column) -> Column:
    """Four octets outside the private, shared, loopback, link-local, documentation, benchmark, multicast and reserved blocks."""
    a, b, c, d = (_part(v, r"\.", i) for i in range(4))
    special = (
        a.isin(0, 10, 127)
        | (a >= 224)
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254))
        | ((a == 100) & b.between(64, 127))
        | ((a == 192) & (b == 0) & c.isin(0, 2))
        | ((a == 198) & (b.isin(18, 19) | ((b == 51) & (c == 100))))
        | ((a == 203) & (b == 0) & (c == 113))
    )
    return F.coalesce((a <= 255) & (b <= 255) & (c <= 255) & (d <= 255) & ~special, F.lit(False))


PUBLIC_IPV4 = Check(
    _routable,
    lambda v: "(SELECT coalesce(a <= 255 AND b <= 255 AND c <= 255 AND d <= 255 AND NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND (b IN (18, 19) OR (b = 51 AND c = 100))) OR (a = 203 AND b = 0 AND c = 113)), FALSE) FROM (SELECT "
    + ", ".join(f"TRY_CAST(string_split({v}, '.')[{i + 1}] AS INTEGER) AS {n}" for i, n in enumerate("abcd"))
    + "))",
)

#: Domains that no person's address uses.
RESERVED_DOMAIN = r"(?i)[@.](example\.(com|org|net)|[a-z0-9-]+\.(test|example|invalid|localhost|local))$"
PERSON_EMAIL = Check(lambda v: ~v.rlike(RESERVED_DOMAIN), lambda v: f"NOT regexp_matches({v}, '{RESERVED_DOMAIN}')")

#: The same of an address whose at sign is written as %40.
PERSON_EMAIL_ENCODED = Check(lambda v: PERSON_EMAIL.column(F.replace(v, F.lit("%40"), F.lit("@"))), lambda v: PERSON_EMAIL.sql(f"replace({v}, '%40', '@')"))

PHONE_DIGITS = Check(
    lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")).between(8, 15) & ~F.regexp_replace(v, "[^0-9]", "").rlike("^1?8(00|33|44|55|66|77|88)"),
    lambda v: f"(length(regexp_replace({v}, '[^0-9]', '', 'g')) BETWEEN 8 AND 15 AND NOT regexp_matches(regexp_replace({v}, '[^0-9]', '', 'g'), '^1?8(00|33|44|55|66|77|88)'))",
)


def entropy(v: Column) -> Column:
    """Shannon entropy of the characters in bits."""
    chars = F.split(v, "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.length(v))
    return F.aggregate(F.array_sort(counts), F.lit(0.0), lambda a, p: a - p * F.log2(p))


def sql_entropy(v: str) -> str:
    share = f"CAST(len(list_filter(string_split({v}, ''), lambda x: x = c)) AS DOUBLE) / length({v})"
    return f"(SELECT list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: -({share}) * log2({share}))))"


def least_entropy(bits: float) -> Check:
    return Check(lambda v: F.round(entropy(v), 6) >= bits, lambda v: f"round({sql_entropy(v)}, 6) >= {bits}")


MIXED = Check(lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"), lambda v: f"(regexp_matches({v}, '[0-9]') AND regexp_matches({v}, '[A-Za-z]'))")
#: What stands where a secret would.
PLACEHOLDERS = "(?i)^(placeholder|changeme|redacted|example|your[-_ ]?.*|xxx+|\\*+|<.*>|test|dummy|secret|password|none|null|true|false)$"
NOT_PLACEHOLDER = Check(lambda v: ~v.rlike(PLACEHOLDERS), lambda v: f"NOT regexp_matches({v}, '{PLACEHOLDERS}')")

#: Rows of keys and alphabets in which four neighbours, read either way, are a sequence.
ROWS = ("abcdefghijklmnopqrstuvwxyz", "01234567890", "qwertyuiop", "qwertzuiop", "azertyuiop", "asdfghjkl", "zxcvbnm", "yxcvbnm")
_FOURS = sorted({row[::way][i : i + 4] for row in ROWS for way in (1, -1) for i in range(len(row) - 3)})
SEQUENCES = f"(?i)(?:{'|'.join(_FOURS)})"
#: A value that is nothing but sequences and up to three other characters is made up, not chosen or drawn.
NOT_SEQUENCE = Check(
    lambda v: (F.length(F.regexp_replace(v, SEQUENCES, "")) > 3) | ~v.rlike(SEQUENCES),
    lambda v: f"(length(regexp_replace({v}, '{SEQUENCES}', '', 'g')) > 3 OR NOT regexp_matches({v}, '{SEQUENCES}'))",
)


# ---- Base58 with a checksum -----------------------------------------------------------------------------------------------

#: Fixed value: the digits of Base58, without 0, O, I and l.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_LIMB, _AT_ONCE = 24, 5


def _limbs(n_bytes: int) -> int:
    return n_bytes * 8 // _LIMB + 2


def base58_hex(v: Column, n_bytes: int) -> Column:
    """The hexadecimal digits of the number that a Base58 text of about ``n_bytes`` bytes writes, with leading zeros.

    The number is kept in limbs of 24 bits; five digits are taken at once, so that a limb's product fits 64 bits.
    """
    padded = F.lpad(v, F.ceil(F.length(v) / _AT_ONCE).cast("int") * _AT_ONCE, F.lit(BASE58[0]))
    digits = F.transform(F.regexp_extract_all(padded, F.lit("."), F.lit(0)), lambda c: F.position(c, F.lit(BASE58)) - 1)
    fives = F.transform(F.sequence(F.lit(0), (F.size(digits) / _AT_ONCE).cast("int") - 1), lambda k: F.aggregate(F.slice(digits, k * _AT_ONCE + 1, _AT_ONCE), F.lit(0).cast("bigint"), lambda a, d: a * 58 + d))
    state = "struct<carry:bigint,out:array<bigint>>"

    def step(s, x):
        total = x * 58**_AT_ONCE + s["carry"]
        return F.struct(F.shiftright(total, _LIMB).alias("carry"), F.concat(s["out"], F.array(total.bitwiseAND(2**_LIMB - 1))).alias("out"))

    add = lambda limbs, five: F.aggregate(limbs, F.struct(five.alias("carry"), F.array().cast("array<bigint>").alias("out")).cast(state), step, lambda s: s["out"])
    number = F.aggregate(fives, F.array(*[F.lit(0).cast("bigint")] * _limbs(n_bytes)), add)
    return F.lower(F.array_join(F.transform(F.reverse(number), lambda x: F.lpad(F.hex(x), _LIMB // 4, "0")), ""))


def sql_base58_hex(v: str, n_bytes: int) -> str:
    padded = f"lpad({v}, CAST(ceil(length({v}) / {_AT_ONCE}) * {_AT_ONCE} AS INTEGER), '{BASE58[0]}')"
    fives = f"list_transform(range(0, length({padded}) // {_AT_ONCE}), lambda k: [CAST(" + " + ".join(f"(instr('{BASE58}', substr({padded}, k * {_AT_ONCE} + {i + 1}, 1)) - 1) * {58 ** (_AT_ONCE - 1 - i)}" for i in range(_AT_ONCE)) + " AS BIGINT)])"
    inner = f"list_reduce(list_transform(limbs, lambda x: [x]), lambda s, x: list_concat([(x[1] * {58**_AT_ONCE} + s[1]) >> {_LIMB}], s[2:], [(x[1] * {58**_AT_ONCE} + s[1]) & {2**_LIMB - 1}]), five)[2:]"
    number = f"list_reduce({fives}, lambda limbs, five: {inner}, CAST({[0] * _limbs(n_bytes)} AS BIGINT[]))"
    return f"array_to_string(list_transform(list_reverse({number}), lambda x: printf('%06x', x)), '')"


#: Fixed value: the order of the curve secp256k1, below which a private key lies.
SECP256K1 = "fffffffffffffffffffffffffffffffebaaedce6af48a03bbfd25e8cd0364141"


def _base58_key(n_bytes: int, shape: str, key_at: int) -> Check:
    """Base58 of ``n_bytes`` whose last four are the head of SHA-256 taken twice of the rest; the digits before them match
    ``shape``, and the 32 bytes from ``key_at`` are a private key."""
    size, at = 2 * n_bytes, 2 * key_at + 1

    def column(v):
        def told(h):
            body = F.left(h, F.lit(size - 8))
            key = F.substring(h, at, 64)
            twice = F.sha2(F.unhex(F.sha2(F.unhex(body), 256)), 256)
            return body.rlike(shape) & (key > "0" * 64) & (key < SECP256K1) & (F.left(twice, F.lit(8)) == F.right(h, F.lit(8)))

        digits = base58_hex(v, n_bytes)
        whole = F.transform(F.array(digits), lambda d: ~F.rlike(F.left(d, F.length(d) - size), F.lit("[^0]")) & told(F.right(d, F.lit(size))))
        return F.coalesce(v.rlike(f"^[{BASE58}]+$") & F.get(whole, F.lit(0)), F.lit(False))

    def sql(v):
        body, key = f"left(h, {size - 8})", f"substr(h, {at}, 64)"
        good = f"regexp_matches({body}, '{shape}') AND {key} > '{'0' * 64}' AND {key} < '{SECP256K1}' AND left(sha256(unhex(sha256(unhex({body})))), 8) = right(h, 8)"
        return f"(SELECT coalesce(NOT regexp_matches(left(d, length(d) - {size}), '[^0]') AND {good}, FALSE) FROM (SELECT d, right(d, {size}) AS h FROM (SELECT {sql_base58_hex(v, n_bytes)} AS d)))"

    return Check(column, sql)


#: A private key in wallet import format: a version (80, on test networks ef), the key and, if its public key is compressed, 01.
WIF = _base58_key(37, "^(80|ef)", 1) | _base58_key(38, "^(80|ef).*01$", 1)
#: Versions of extended private keys (BIP-32, SLIP-0132), mainnet then test networks.
XPRV_VERSIONS = ("0488ade4", "049d7878", "04b2430c", "0295b005", "02aa7a99", "04358394", "044a4e28", "045f18bc", "024285b5", "02575048")
XPRV = _base58_key(82, f"^({'|'.join(XPRV_VERSIONS)})[0-9a-f]{{82}}00", 46)
