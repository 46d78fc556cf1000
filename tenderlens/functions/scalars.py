"""Small column expressions: guarded division, rounding, number parsing, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderlens.config import SENTINELS

# Fixed value: what counts as a number once the decimal comma is a dot.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"

# Timestamp layouts, plain and ISO with a T.
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")


def ratio_or(numerator: Column, denominator: Column, default: float | None) -> Column:
    """numerator / denominator where the denominator is positive, else ``default``."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(default).cast("double"))


def half_up(value: Column, digits: int) -> Column:
    """Round half up by the plain scaled-floor steps, so other engines can repeat them."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def half_even(value: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def parse_number(text: Column) -> Column:
    """Text with a decimal comma or dot as double; null when it is not a plain number."""
    dotted = F.replace(text, F.lit(","), F.lit("."))
    return F.when(dotted.rlike(NUMBER_PATTERN), F.trim(dotted).try_cast("double"))


def is_sentinel(text: Column) -> Column:
    return text.isNull() | text.isin(list(SENTINELS))


def parse_timestamp(text: Column, formats: Sequence[str] = TIMESTAMP_FORMATS) -> Column:
    """First layout that fits, as a wall-clock time without zone; null when none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats])


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days between two wall-clock times, to the second."""

    def seconds_of_day(t: Column) -> Column:
        return F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)

    seconds = F.date_diff(later, earlier).cast("long") * 86_400 + seconds_of_day(later) - seconds_of_day(earlier)
    return seconds / F.lit(86_400)


def truncate_label(text: Column, size: int) -> Column:
    kept = F.coalesce(text, F.lit(""))
    return F.when(F.length(kept) > size, F.concat(F.substring(kept, 1, size), F.lit("…"))).otherwise(kept)


def short_institution(text: Column, prefix: str = "Municipalidad de ", short: str = "Mun. ") -> Column:
    """Replace the first occurrence of the institution prefix by its short form."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "^(.*?)" + prefix, "$1" + short)


def in_millions(amount: Column) -> Column:
    return half_up(amount / 1e6, 1)


def in_billions(amount: Column) -> Column:
    return half_up(amount / 1e9, 2)


def money_label(amount: Column) -> Column:
    """``$12.3M``, or a dash for a missing amount."""
    return F.when(
        amount.isNull() | F.isnan(amount), F.lit("—")
    ).otherwise(F.concat(F.lit("$"), F.replace(F.format_number(in_millions(amount), 1), F.lit(","), F.lit("")), F.lit("M")))
