"""Text expressions shared by ingest, labelling and mapping."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Dash variants unified to '-', marks removed, punctuation blanked.
_DASHES = "–—−"
_MARKS = "®™"
_PUNCT = r"[()\[\]{},.;:]"


def strip(c: Column) -> Column:
    """Trim any Unicode white space (trim() alone keeps tabs and newlines)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


fold_unicode = F.pandas_udf(_fold, T.StringType())


def fold_name(c: Column) -> Column:
    """NFKC and case folding.  For ASCII that is ``lower``; only other text
    gives the Arrow UDF anything to do (ASCII rows reach it as NULL)."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(
        fold_unicode(F.when(~text.rlike(r"^\p{ASCII}*$"), text)))


def normalize_alias(c: Column) -> Column:
    """Compare form of a name: folded, dashes/marks/punctuation removed."""
    return tidy_alias(fold_name(c))


def tidy_alias(c: Column) -> Column:
    t = F.translate(c, _DASHES + _MARKS, "---")
    t = F.regexp_replace(t, _PUNCT, " ")
    t = F.regexp_replace(t, r"[-_/]+", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
