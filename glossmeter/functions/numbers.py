"""Rounding, ratios and number formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_even(x: Column, digits: int) -> Column:
    """Scaled half-even rounding, the rule the result tables use."""
    scale = float(10 ** digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null when b is 0 or either side is missing."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def fixed(x: Column, digits: int) -> Column:
    """Plain fixed-point text, null for null."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", round_even(x, digits)))


# Number and date conventions of the two display locales.
LOCALE_MARKS = {
    "en": {"decimal": ".", "group": ",", "money_prefix": "$", "money_suffix": "", "date": "iso"},
    "vi": {"decimal": ",", "group": ".", "money_prefix": "", "money_suffix": " USD", "date": "dmy"},
}


def locale_number(x: Column, digits: int, locale: str) -> Column:
    """Grouped number with the marks of a locale."""
    marks = LOCALE_MARKS[locale]
    text = F.format_number(round_even(x, digits), digits)
    return F.translate(text, ",.", marks["group"] + marks["decimal"])


def locale_money(x: Column, locale: str, digits: int | None = None) -> Column:
    """USD amount in the form of a locale; whole amounts lose their decimals by default."""
    marks = LOCALE_MARKS[locale]
    if digits is None:
        body = F.when(x == F.floor(x), locale_number(x, 0, locale)).otherwise(locale_number(x, 2, locale))
    else:
        body = locale_number(x, digits, locale)
    return F.concat(F.lit(marks["money_prefix"]), body, F.lit(marks["money_suffix"]))


def locale_compact(x: Column, locale: str) -> Column:
    """Label text: no decimals from 100, one from 10, else two."""
    return (F.when(x >= 100, locale_number(x, 0, locale))
            .when(x >= 10, locale_number(x, 1, locale))
            .otherwise(locale_number(x, 2, locale)))


def locale_date(iso: Column, locale: str) -> Column:
    """ISO date text in the form of a locale."""
    if LOCALE_MARKS[locale]["date"] == "iso":
        return iso
    return F.date_format(F.to_date(iso), "d/M/yyyy")
