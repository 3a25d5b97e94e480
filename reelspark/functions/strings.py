"""Strings: slugs, identifiers, token costs, printed lines."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode(), na_action="ignore")


def ascii_fold(text: Column) -> Column:
    """Compatibility decomposition without what isn't ASCII; no built-in function does this, so other texts than ASCII go to Python."""
    plain = text.rlike(r"\A[\x00-\x7f]*\z")
    return F.when(plain, text).otherwise(_folded(F.when(~plain, text)))


def slugify(value: Column) -> Column:
    text = F.regexp_replace(F.lower(ascii_fold(F.coalesce(value, F.lit("")))), "[^a-z0-9]+", "-")
    text = F.regexp_replace(text, "^-+|-+$", "")
    return F.when(text == "", F.lit("unknown")).otherwise(text)


def slug_path(country: Column, city: Column, place: Column) -> Column:
    return F.concat_ws("/", slugify(country), slugify(city), slugify(place))


def cell_id(value: Column) -> Column:
    """A spreadsheet id: whole numbers lose their decimals, the rest is trimmed."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    whole = text.rlike(r"^-?\d+\.0+$|^-?\d+(\.\d+)?[eE]\+?\d+$") & (number == F.floor(number))
    return F.when(F.coalesce(whole, F.lit(False)), number.cast("decimal(38,0)").cast("string")).otherwise(text)


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values])


def is_enabled(flag: Column) -> Column:
    """A missing or blank flag means enabled."""
    return ~F.lower(F.trim(F.coalesce(flag, F.lit("")))).isin("0", "false", "no", "off", "disabled")


def text_tokens(text: Column) -> Column:
    """Estimated cost of a text: its bytes and eight more."""
    return F.greatest(F.lit(8), F.octet_length(text) + 8).cast("long")


#: Cost of an image, a fixed value.
IMAGE_TOKENS = 1000


def score_text(score: Column) -> Column:
    """A raw score, six decimals; never a percentage."""
    return F.format_string("%.6f", score)
