"""Scalar expressions: probabilities, text booleans, timestamps and relative times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells with these texts count as missing; the last two lines are what CSV readers
# commonly add by themselves.
NA_TOKENS = [
    "nan", "NaN", "null", "NULL", "", "inf", "-inf",
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "None", "n/a",
]
# Texts read as true.
TRUE_WORDS = ["true", "1", "yes"]


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def softmax(logits: Column, clip: float | None = None, epsilon: float = 0.0) -> Column:
    """Softmax of an array, shifted by its maximum; optionally clipped and with an epsilon."""
    top = F.array_max(logits)

    def power(x: Column) -> Column:
        shifted = x - top
        if clip is not None:
            shifted = F.greatest(F.least(shifted, F.lit(float(clip))), F.lit(-float(clip)))
        return F.exp(shifted)

    powers = F.transform(logits, power)
    total = array_sum(powers) + F.lit(epsilon)
    uniform = F.transform(logits, lambda _: F.lit(1.0) / F.size(logits))
    result = F.transform(powers, lambda e: e / total)
    broken = F.exists(result, lambda p: p.isNull() | F.isnan(p))
    return F.when(broken, uniform).otherwise(result)


def argmax(values: Column) -> Column:
    """Position of the first largest element, counted from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def text_to_bool(text: Column) -> Column:
    return F.coalesce(F.lower(text).isin(TRUE_WORDS), F.lit(False))


def clean_token(text: Column) -> Column:
    """NULL for missing-value tokens, the trimmed text otherwise."""
    trimmed = F.trim(text)
    return F.when(trimmed.isin(NA_TOKENS), None).otherwise(trimmed)


# The largest finite numbers of the floating types.
MAX_FINITE = {"float": 3.4028234663852886e38, "double": 1.7976931348623157e308}


def safe_cast(text: Column, kind: str) -> Column:
    """Cast that yields NULL for missing tokens and for unparsable, NaN and infinite cells.

    The missing-value tokens need no test of their own: each is unparsable, NaN or infinite,
    and NaN compares above every number.
    """
    value = text.try_cast(kind)
    if kind not in MAX_FINITE:
        return value
    return F.when(F.abs(value) <= F.lit(MAX_FINITE[kind]).cast(kind), value)


def parse_time(text: Column) -> Column:
    """Timestamps written as ISO text, with a Z, or with ``:microseconds`` after the seconds."""
    short = F.substring_index(text, ":", 3)
    return F.coalesce(
        F.try_to_timestamp(short, F.lit("yyyy-MM-dd HH:mm:ss")),
        text.try_cast("timestamp"),
    )


def _count_word(n: Column, word: str) -> Column:
    return F.concat(
        n.cast("string"), F.lit(f" {word}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" ago")
    )


def relative_time(past: Column, now: Column) -> Column:
    """Days, hours or minutes since ``past``; the dashboard wording."""
    span = F.unix_micros(now) - F.unix_micros(past)
    days = F.floor(span / F.lit(86_400_000_000)).cast("long")
    seconds = F.floor((span - days * 86_400_000_000) / F.lit(1_000_000)).cast("long")
    return (
        F.when(past.isNull(), F.lit("Unknown time ago"))
        .when(days > 0, _count_word(days, "day"))
        .when(seconds > 3600, _count_word(F.floor(seconds / 3600).cast("long"), "hour"))
        .when(seconds > 60, _count_word(F.floor(seconds / 60).cast("long"), "minute"))
        .otherwise(F.lit("Just now"))
    )


def relative_time_fine(past: Column, now: Column) -> Column:
    """Years down to seconds since ``past``; the run-summary wording."""
    span = F.unix_micros(now) - F.unix_micros(past)
    days = F.floor(span / F.lit(86_400_000_000)).cast("long")
    total = F.when(span >= 0, F.floor(span / F.lit(1_000_000))).otherwise(
        F.ceil(span / F.lit(1_000_000))
    ).cast("long")

    def per(n: Column, size: int) -> Column:
        return F.floor(n / size).cast("long")

    near = (F.bround(total / F.lit(5.0)) * 5).cast("long").cast("string")
    return (
        F.when(past.isNull(), F.lit("Unknown time ago"))
        .when(days > 365, _count_word(per(days, 365), "year"))
        .when(days > 30, _count_word(per(days, 30), "month"))
        .when(days > 0, _count_word(days, "day"))
        .when(total >= 3600, _count_word(per(total, 3600), "hour"))
        .when(total >= 60, _count_word(per(total, 60), "minute"))
        .when((total >= 5) & (total % 5 == 0), F.concat(total.cast("string"), F.lit(" seconds ago")))
        .when(total >= 5, F.concat(F.lit("~"), near, F.lit(" seconds ago")))
        .when(total > 1, F.concat(total.cast("string"), F.lit(" seconds ago")))
        .otherwise(F.lit("just now"))
    )
