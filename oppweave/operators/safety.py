"""Sensitive field names and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_words

# Names of fields that are never filled in.
SENSITIVE_NAMES = [
    r"ssn", r"social\s*security", r"itin", r"taxpayer", r"passport", r"driver'?s?\s*license",
    r"state\s*id", r"credit\s*card", r"debit\s*card", r"routing\s*number", r"bank\s*account",
    r"insurance\s*member\s*id",
]

# Forms of values that are never filled in.
SENSITIVE_VALUES = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "nine_digits": r"\b\d{9}\b",
    "card": r"\b[0-9]{13,19}\b",
    "token": r"(?<!\w)(?=[A-Z0-9]{6,9}(?!\w))(?=[A-Z0-9]*[A-Z])(?=[A-Z0-9]*\d)[A-Z0-9]+(?!\w)",
}


def _value_pattern(name: str) -> str:
    p = SENSITIVE_VALUES[name]
    if name == "card":
        return r"(?<!\w)[0-9]{13,19}(?!\w)"
    return ascii_words(p)


def sensitive_name(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("(?i)" + "|".join(SENSITIVE_NAMES))


def sensitive_value(c: Column, *kinds: str) -> Column:
    return F.coalesce(c, F.lit("")).rlike(
        "|".join(_value_pattern(k) for k in (kinds or SENSITIVE_VALUES))
    )


def is_sensitive(name: Column, value: Column) -> Column:
    return sensitive_name(name) | sensitive_value(value)


def mask(value: Column) -> Column:
    """Three stars and the last four characters."""
    return F.concat(F.lit("***"), F.right(value, F.lit(4)))


def scan_sensitive(df: DataFrame, name_col: str, value_col: str) -> DataFrame:
    """Flag every row and add the masked preview of sensitive values."""
    value = F.col(value_col)
    return df.withColumns(
        {
            "name_hit": sensitive_name(F.col(name_col)),
            **{f"{k}_hit": sensitive_value(value, k) for k in SENSITIVE_VALUES},
        }
    ).withColumn(
        "masked_preview",
        F.when(
            F.col("name_hit") | F.col("ssn_hit") | F.col("nine_digits_hit") | F.col("card_hit")
            | F.col("token_hit"),
            mask(value),
        ),
    )


def sensitive_counts(scanned: DataFrame, source_col: str) -> DataFrame:
    """Rows and hits per source."""
    kinds = ["name", *SENSITIVE_VALUES]
    return scanned.groupBy(source_col).agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col(f"{k}_hit")).alias(f"n_{k}") for k in kinds],
        F.count("masked_preview").alias("n_sensitive"),
    )
