"""Validators, dataset formats and value predicates as Column builders over cell text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import WS, collapse_ws, is_blank, trim_ws
from .normalize import identifier, phone_br

EMAIL = f"^[^{WS}@]+@[^{WS}@]+\\.[^{WS}@]{{2,}}$"
#: Brazilian area codes in use.
AREA_CODES = [
    "11", "12", "13", "14", "15", "16", "17", "18", "19", "21", "22", "24", "27", "28", "31", "32", "33",
    "34", "35", "37", "38", "41", "42", "43", "44", "45", "46", "47", "48", "49", "51", "53", "54", "55",
    "61", "62", "63", "64", "65", "66", "67", "68", "69", "71", "73", "74", "75", "77", "79", "81", "82",
    "83", "84", "85", "86", "87", "88", "89", "91", "92", "93", "94", "95", "96", "97", "98", "99",
]
#: The 50 states and the District of Columbia.
US_STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware", "dc": "district of columbia",
    "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine",
    "md": "maryland", "ma": "massachusetts", "mi": "michigan", "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada",
    "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon",
    "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia",
    "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming",
}
#: Text that JavaScript's Number() takes: decimal with exponent, or hexadecimal, binary, octal.
NUMBER = r"^([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+)$"
#: Date texts that count as dates; an engine's lenient guesses don't.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "M/d/yyyy", "MMM d, yyyy", "d MMM yyyy")

REASONS = {
    "required": "A value is required.",
    "email": "The email address is not valid.",
    "cpf": "The CPF check digits are not valid.",
    "cnpj": "The CNPJ check digits are not valid.",
    "phone_br": "The Brazilian phone number is not valid.",
    "number": "The value is not a number.",
    "date": "The value is not a date.",
}


def _number(text: Column, length: int) -> Column:
    """An identifier of the right number of digits that aren't all the same, as a whole number; else null."""
    d = identifier(text)
    return F.when(d.rlike(f"^[0-9]{{{length}}}$") & ~d.rlike(r"^(\d)\1*$"), d).try_cast("long")


def _of_number(number: Column, length: int, test) -> Column:
    """``test`` of a function from places to digits. The number is a lambda's argument: computed once, not once a digit."""
    digit = lambda n, k: F.pmod(F.call_function("div", n, F.lit(10 ** (length - 1 - k))), F.lit(10)).cast("int")
    return F.coalesce(F.transform(F.array(number), lambda n: test(lambda k: digit(n, k)))[0], F.lit(False))


def _weighted(digit, weights: Sequence[int]) -> Column:
    return reduce(lambda a, b: a + b, [digit(k) * w for k, w in enumerate(weights)])


def valid_cpf(text: Column) -> Column:
    def test(digit) -> Column:
        first, second = ((_weighted(digit, range(n + 1, 1, -1)) * 10 % 11) % 10 == digit(n) for n in (9, 10))
        return first & second

    return _of_number(_number(text, 11), 11, test)


def valid_cnpj(text: Column) -> Column:
    first = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]

    def test(digit) -> Column:
        def check(weights: list[int]) -> Column:
            return F.transform(F.array(_weighted(digit, weights) % 11), lambda rest: F.when(rest < 2, 0).otherwise(11 - rest))[0] == digit(len(weights))

        return check(first) & check([6, *first])

    return _of_number(_number(text, 14), 14, test)


def valid_phone_br(text: Column) -> Column:
    d = phone_br(text)
    known = F.substring(d, 1, 2).isin(*AREA_CODES)
    return known & d.rlike("^[0-9]{2}(9[0-9]{8}|[2-5][0-9]{7})$")


def valid_email(text: Column) -> Column:
    return F.lower(trim_ws(text)).rlike(EMAIL)


def valid_number(text: Column) -> Column:
    value = F.replace(trim_ws(text), F.lit(","), F.lit("."))
    value = F.when(F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))) <= 1, value).otherwise("x")
    finite = F.coalesce(F.abs(F.expr("1.0D") * value.try_cast("double")) < float("inf"), F.lit(True))
    return value.rlike(NUMBER) & finite


def valid_date(text: Column) -> Column:
    value = trim_ws(text)
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in DATE_FORMATS]).isNotNull()


VALIDATORS = {"email": valid_email, "cpf": valid_cpf, "cnpj": valid_cnpj, "phone_br": valid_phone_br, "number": valid_number, "date": valid_date}


def is_valid(validator: str, text: Column) -> Column:
    """Whether a cell passes; a missing one passes all but ``required``."""
    if validator == "required":
        return ~is_blank(text)
    return is_blank(text) | VALIDATORS[validator](text)


#: What is said of a cell that passes.
PASSED = {
    "required": "A value is present.",
    "email": "The email format is valid.",
    "cpf": "The CPF checksum is valid.",
    "cnpj": "The CNPJ checksum is valid.",
    "phone_br": "The phone contains a valid Brazilian DDD and subscriber number.",
    "number": "The value is numeric.",
    "date": "The value is a valid date.",
}
SKIPPED = "The optional value is empty, so format validation was skipped."


def validation(validator: str, text: Column) -> Column:
    """``struct(valid, normalized, reason)`` of a cell: the text that was looked at, and what is said of it.

    A date that passes is shown as an instant in UTC.
    """
    plain, good = trim_ws(text), is_valid(validator, text)
    shown = {
        "email": lambda: F.lower(plain), "cpf": lambda: identifier(text), "cnpj": lambda: identifier(text), "phone_br": lambda: phone_br(text),
        "number": lambda: F.regexp_replace(plain, "^([^,]*),", "$1."),
        "date": lambda: F.coalesce(F.date_format(F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in DATE_FORMATS]), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), plain),
    }.get(validator, lambda: plain)()
    said = F.when(good, PASSED[validator]).otherwise(REASONS[validator])
    blank = is_blank(text) & F.lit(validator != "required")
    return F.struct(good.alias("valid"), F.when(blank, "").otherwise(shown).alias("normalized"), F.when(blank, SKIPPED).otherwise(said).alias("reason"))


def matches_format(name: str, text: Column) -> Column:
    """Dataset formats: a blank email passes, a blank state or ZIP doesn't."""
    if name == "email":
        return is_blank(text) | valid_email(text)
    value = trim_ws(text)
    if name == "us_state":
        return F.lower(collapse_ws(text)).isin(*US_STATES, *US_STATES.values())
    return value.rlike({"zip": r"^\d{5}$", "zip4": r"^\d{5}-\d{4}$", "zip_or_zip4": r"^\d{5}(-\d{4})?$"}[name])


FORMATS = ("email", "us_state", "zip", "zip4", "zip_or_zip4")


def matches_predicate(operator: str, text: Column, values: Sequence = (), low: float | None = None, high: float | None = None, forbidden: bool = False, fold: bool = False, number: Column | None = None) -> Column:
    """A literal predicate. ``number``: the cell itself if its column is numeric; other types but text fail a range."""
    if operator == "number_range":
        if number is None:
            plain = trim_ws(text)
            number = F.when(plain.rlike(r"^[+-]?(\d+(\.\d+)?|\.\d+)$"), plain.cast("double"))
        inside = F.lit(True)
        if low is not None:
            inside = inside & (number >= low)
        if high is not None:
            inside = inside & (number <= high)
        found = number.isNotNull() & F.coalesce(inside, F.lit(False))
    else:
        side = F.lower(text) if fold else text
        wanted = [v.lower() if fold else v for v in values]
        if operator == "one_of":
            found = side.isin(*wanted)
        else:
            test = {"contains": side.contains, "starts_with": side.startswith, "ends_with": side.endswith}[operator]
            found = reduce(lambda a, b: a | b, [test(v) for v in wanted])
    return ~found if forbidden else found
