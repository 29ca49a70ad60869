"""Cells as text: how a typed value is written, trimmed and judged missing.

White space is ECMAScript's, wider than Spark's ``trim`` and Java's ``\\s``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the white space class, for use within brackets.
WS = r"\t\n\x0B\f\r    -     　﻿"
WS_CHARS = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{WS}]", c))


def cell_text(col: Column, kind: T.DataType) -> Column:
    """The text of a cell: integral numbers without a point, instants in ISO form, null as empty."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        number = col.cast("double")
        whole = (number == F.floor(number)) & (F.abs(number) < 1e21)
        text = F.when(whole, number.cast("decimal(38,0)").cast("string")).otherwise(number.cast("string"))
    elif isinstance(kind, (T.TimestampType, T.DateType)):
        text = F.date_format(col.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(""))


def trim_ws(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def collapse_ws(text: Column) -> Column:
    """Runs of white space as one space."""
    return F.trim(F.regexp_replace(F.translate(text, WS_CHARS, " " * len(WS_CHARS)), " {2,}", " "))


def is_blank(text: Column) -> Column:
    """Whether a text holds nothing but white space. ``0`` and ``false`` are values."""
    return ~text.rlike(f"[^{WS}]")
