"""Comparison normalizations as Column builders, in one fixed order.

Only Unicode forms leave the JVM, in Arrow batches; Spark has no function for them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cells import WS, collapse_ws, trim_ws

#: The operations in the order in which they apply.
ORDER = ("unicode", "trim", "lowercase", "uppercase", "remove_accents", "normalize_whitespace", "remove_whitespace", "remove_punctuation", "digits_only", "phone_br", "email", "identifier")
#: What each semantic type brings along.
DEFAULTS = {
    "name": ("unicode", "trim", "lowercase", "remove_accents", "normalize_whitespace"),
    "phone": ("phone_br",),
    "email": ("email",),
    "cpf": ("identifier",),
    "cnpj": ("identifier",),
    "identifier": ("trim", "identifier"),
    "date": ("trim",),
    "number": ("trim",),
    "text": ("unicode", "trim", "normalize_whitespace"),
    "unknown": ("unicode", "trim", "normalize_whitespace"),
}
#: Operations that only some semantic types take.
ONLY_FOR = {
    "phone_br": {"phone"},
    "email": {"email"},
    "identifier": {"cpf", "cnpj", "identifier"},
    "digits_only": {"phone", "cpf", "cnpj", "identifier", "number"},
}


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def _bare(s: str, form: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize(form, s) if unicodedata.category(c)[0] != "M"))


@F.pandas_udf(T.StringType())
def without_marks(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None or s.isascii() else _bare(s, "NFD"))


@F.pandas_udf(T.StringType())
def compatible_without_marks(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None or s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c)[0] != "M"))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def phone_br(text: Column) -> Column:
    """Digits without the country code 55 and then without a trunk 0."""
    d = digits(text)
    d = F.when(F.length(d).isin(12, 13) & d.startswith("55"), F.substring(d, 3, 20)).otherwise(d)
    return F.when(F.length(d).isin(11, 12) & d.startswith("0"), F.substring(d, 2, 20)).otherwise(d)


def identifier(text: Column) -> Column:
    d = digits(text)
    return F.when(F.length(d) > 0, d).otherwise(trim_ws(text))


STEPS = {
    "unicode": nfkc,
    "trim": trim_ws,
    "lowercase": F.lower,
    "uppercase": F.upper,
    "remove_accents": without_marks,
    "normalize_whitespace": collapse_ws,
    "remove_whitespace": lambda t: F.regexp_replace(t, f"[{WS}]+", ""),
    "remove_punctuation": lambda t: collapse_ws(F.regexp_replace(t, r"[\p{P}\p{S}]+", " ")),
    "digits_only": digits,
    "phone_br": phone_br,
    "email": lambda t: F.lower(trim_ws(t)),
    "identifier": identifier,
}
#: What each operation does, for explanations.
LABELS = {
    "unicode": "Unicode compatibility form",
    "trim": "surrounding white space removed",
    "lowercase": "lower case",
    "uppercase": "upper case",
    "remove_accents": "accents removed",
    "normalize_whitespace": "white space collapsed",
    "remove_whitespace": "white space removed",
    "remove_punctuation": "punctuation removed",
    "digits_only": "digits only",
    "phone_br": "Brazilian phone digits",
    "email": "email form",
    "identifier": "identifier form",
}


def merge_operations(semantic: str, *groups: Iterable[str]) -> tuple[str, ...]:
    """The semantic type's own operations and those asked for, without what the type can't take, in order."""
    asked = {*DEFAULTS[semantic], *(op for g in groups for op in g)}
    return tuple(op for op in ORDER if op in asked and semantic in ONLY_FOR.get(op, {semantic}))


def normalize(text: Column, operations: Iterable[str]) -> Column:
    asked = set(operations)
    for op in ORDER:
        if op in asked:
            text = STEPS[op](text)
    return text


def describe(operations: Iterable[str]) -> str:
    return ", ".join(LABELS[op] for op in operations)


#: What stands for the United States in country fields.
US_NAMES = ("us", "usa", "united states", "united states of america")


def is_exact_token(token: str) -> bool:
    """Tokens that name an id are compared as they are."""
    return re.search(r"\b(id|bpid)$", token, re.IGNORECASE) is not None


def business_value(text: Column, token: str) -> Column:
    """The form in which business checks compare: ids trimmed only; else no marks, lower case, single spaces."""
    trimmed = trim_ws(text)
    if is_exact_token(token):
        return trimmed
    value = collapse_ws(F.lower(compatible_without_marks(trimmed)))
    if token.strip().lower() in ("country", "country code"):
        value = F.when(value.isin(*US_NAMES), "us").otherwise(value)
    return value


def business_literal(value: str, token: str) -> str:
    """``business_value`` of a literal, on the driver."""
    value = value.strip()
    if is_exact_token(token):
        return value
    value = " ".join("".join(c for c in unicodedata.normalize("NFKD", value) if unicodedata.category(c)[0] != "M").lower().split())
    return "us" if token.strip().lower() in ("country", "country code") and value in US_NAMES else value


def field_label(text: str) -> str:
    """A header or a phrase as fields are matched: no marks, lower case, separators as spaces."""
    text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c)[0] != "M").lower()
    return " ".join(re.sub(r"[^a-z0-9\s]+", "", re.sub(r"[_\-./\\]+", " ", text)).split())


def phone_shape(text: Column) -> Column:
    """Digits as 9, letters as A."""
    return F.regexp_replace(F.regexp_replace(text, r"\p{L}", "A"), "[0-9]", "9")


def structure_mask(text: Column) -> Column:
    """Upper case as U, lower case as L, digits as D, white space as one blank each; Latin-1 letters only."""
    # lower-case and digit stand-ins lie outside the classes that later steps replace
    text = F.regexp_replace(text, "[A-ZÀ-ÖØ-Þ]", "\u0001")
    text = F.regexp_replace(text, "[a-zß-öø-ÿ]", "\u0002")
    text = F.regexp_replace(text, "[0-9]", "D")
    return F.regexp_replace(F.translate(text, "\u0001\u0002", "UL"), f"[{WS}]", " ")
