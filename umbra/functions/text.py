"""Text helpers whose white space and case rules are those of the browser's string functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as the browser trims and matches it; fixed value, the same text in both engines.
SPACE = "[\t\n\x0b\x0c\r    -     　﻿]"
#: Any character but a line end.
INLINE = "[^\n\r  ]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once; the optimiser cannot copy it to each place of use."""
    return F.transform(F.array(value), body)[0]


def where_once(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)`` that stays above the projection of ``df``.

    Pushed below, the condition would be worked out from the raw columns all over
    again. A projection with a running number is not passed by filters.
    """
    return df.withColumn("__row", F.monotonically_increasing_id()).where(condition & (F.col("__row") >= 0)).drop("__row")


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, f"{SPACE}+", "")


def comparable(text: Column) -> Column:
    """Lower case without white space, punctuation and symbols."""
    return F.lower(F.regexp_replace(text, f"(?:{SPACE}|[\\p{{P}}\\p{{S}}])+", ""))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(text) + F.regexp_count(text, F.lit("[\U00010000-\U0010ffff]"))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normal form; ASCII texts pass through untouched."""
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))
