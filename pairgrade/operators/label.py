"""Free-text interaction descriptions to ordinal tiers 1..4."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairgrade.functions.text import strip

# The three patterns of the labelling protocol.  (?d) keeps '.'
# from stopping at line ends other than \n.
GENERIC = r"(?i)the risk or severity of adverse (effects|events)"
RISK = r"(?i)the risk or severity of"
PHRASE = r"(?id)the risk or severity of (.+?) can be"

TIER_NO_NAMED_EFFECT = 1
TIER_UNLISTED_EFFECT = 3


def named_effect(description: Column) -> Column:
    """The effect named by the text in compare form, NULL if none is named."""
    return F.when(F.regexp_extract(description, PHRASE, 1) != "", _effect(description))


def _effect(description: Column) -> Column:
    """The same, empty if none is named."""
    return F.lower(strip(F.regexp_extract(description, PHRASE, 1)))


def tier_cascade(events: DataFrame, phrase_tier: DataFrame, text: str = "description") -> DataFrame:
    """Add ``tier``: blank, generic or unnamed risk -> 1; listed phrase -> its
    tier; anything else -> 3.

    The phrase table is a user dimension (hundreds of rows); Spark broadcasts
    it when its measured size allows and joins by shuffle otherwise.
    """
    d = F.coalesce(F.col(text), F.lit(""))
    needs_lookup = d.rlike(RISK) & ~d.rlike(GENERIC)  # a blank text names no risk
    lookup = phrase_tier.select(F.col("phrase").alias("__phrase"), F.col("tier").alias("__tier"))
    keyed = events.withColumn("__key", F.when(needs_lookup, _effect(d)))
    tier = (F.when(F.col("__key").isNull(), F.lit(TIER_NO_NAMED_EFFECT))
            .otherwise(F.coalesce(F.col("__tier"), F.lit(TIER_UNLISTED_EFFECT))))
    return (keyed.join(lookup, F.col("__key") == F.col("__phrase"), "left")
            .withColumn("tier", tier.cast("bigint")).drop("__key", "__phrase", "__tier"))
