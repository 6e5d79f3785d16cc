"""Free-text measurements to numbers, as column expressions.

``strict=True`` keeps the narrow grammar of the original cleaning rules;
``strict=False`` also reads the forms those rules were meant to read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.schemas import NULL_TOKENS

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

# Hours per unit, by the leading letters of the unit.
HOURS_PER_UNIT = (
    (r"^(hours?|hrs?|h)$", 1.0),
    (r"^(days?|d)$", 24.0),
    (r"^(weeks?|w)$", 168.0),
    (r"^months?$", 720.0),
    (r"^(minutes?|mins?)$", 1.0 / 60),
    (r"^(seconds?|secs?|s)$", 1.0 / 3600),
)
# Humidity words in test order, and their percentages.
HUMIDITY_WORDS = (("ambient", 52.0), ("dry", 0.1), ("high", 72.0), ("low", 22.0), ("n2", 0.2))
ROOM_TEMPERATURE = 25.0


def number(text: Column) -> Column:
    """The text as a double when all of it is a number, else null."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def _clean(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string")))


def _part(text: Column, mark: str, at: int) -> Column:
    return F.try_element_at(F.split(text, mark), F.lit(at))


def _without(text: Column, word: str) -> Column:
    return F.replace(text, F.lit(word), F.lit(""))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def temperature(value: Column, strict: bool = True) -> Column:
    """Degrees Celsius."""
    t = _clean(value)
    room = t.contains("room temperature") | t.contains("ambient")
    if strict:
        return (
            F.when(t.contains("-"), (number(_part(t, "-", 1)) + number(_part(t, "-", 2))) / 2)
            .when(t.contains("±"), number(_part(t, "±", 1)))
            .when(room, F.lit(ROOM_TEMPERATURE))
            .otherwise(_found(t, r"^([0-9]+)").try_cast("double"))
        )
    pair = r"^([+-]?[0-9]+\.?[0-9]*)\s*(?:°\s*c?)?\s*[-–]\s*([0-9]+\.?[0-9]*)"
    low = _found(t, pair, 1).try_cast("double")
    high = _found(t, pair, 2).try_cast("double")
    single = _found(t, r"^([+-]?[0-9]+\.?[0-9]*)").try_cast("double")
    return F.coalesce(
        (low + high) / 2,
        F.when(room | (t == "rt"), F.lit(ROOM_TEMPERATURE)),
        single,
    )


def hours(value: Column, strict: bool = True) -> Column:
    """Duration in hours."""
    t = _clean(value)
    if strict:
        return (
            F.when(t.contains("h"), number(F.trim(_without(t, "h"))))
            .when(t.contains("days"), number(_without(t, "days")) * 24)
            .when(t.contains("weeks"), number(_without(t, "weeks")) * 7 * 24)
            .when(t.contains("months"), number(_without(t, "months")) * 30 * 24)
            .when(t.contains("min"), number(_without(t, "min")) / 60)
            .when(t.contains("s"), number(_without(t, "s")) / 3600)
        )
    amount = _found(t, r"^([0-9]+\.?[0-9]*)\s*[a-z]*").try_cast("double")
    unit = F.regexp_extract(t, r"^[0-9]+\.?[0-9]*\s*([a-z]*)", 1)
    factor = F.when(unit == "", F.lit(1.0))
    for pattern, per_unit in HOURS_PER_UNIT:
        factor = factor.when(unit.rlike(pattern), F.lit(per_unit))
    return amount * factor


def humidity(value: Column, strict: bool = True) -> Column:
    """Relative humidity in percent."""
    t = _clean(value)
    if strict:
        bare = _without(t, "%")
        out = (
            F.when(
                t.contains("-") & t.contains("%"),
                (number(_part(bare, "-", 1)) + number(_part(bare, "-", 2))) / 2,
            )
            .when(t.contains("±"), number(_part(bare, "±", 1)))
            .when(t.contains("%"), number(bare))
        )
        for word, percent in HUMIDITY_WORDS:
            out = out.when(t.contains(word), F.lit(percent))
        return out.when(
            t.contains("rh"), _found(t, r"([0-9]+(\.[0-9]+)?)").try_cast("double")
        )
    pair = r"([0-9]+\.?[0-9]*)\s*%?\s*[-–]\s*([0-9]+\.?[0-9]*)"
    low = _found(t, pair, 1).try_cast("double")
    high = _found(t, pair, 2).try_cast("double")
    words = F.lit(None).cast("double")
    for word, percent in reversed(HUMIDITY_WORDS):
        words = F.when(t.contains(word), F.lit(percent)).otherwise(words)
    single = _found(F.replace(t, F.lit("n2"), F.lit("")), r"([0-9]+\.?[0-9]*)")
    return F.coalesce((low + high) / 2, single.try_cast("double"), words)


def percentage(value: Column, fractions: bool = False) -> Column:
    """A percentage; with ``fractions`` a single value below 1 is a share."""
    t = _clean(value)
    low = _found(t, r"^([0-9]+)\s*[-–]\s*[0-9]+").try_cast("double")
    high = _found(t, r"^[0-9]+\s*[-–]\s*([0-9]+)").try_cast("double")
    left = _found(t, r"^([0-9]+)\s*±\s*[0-9]+").try_cast("double")
    single = _found(t, r"([0-9]+\.?[0-9]*)").try_cast("double")
    if fractions:
        single = F.when(single < 1, single * 100).otherwise(single)
    return F.when(~t.isin(*NULL_TOKENS), F.coalesce((low + high) / 2, left, single))


def product(value: Column) -> Column:
    """Value of ``a * b * …``; a plain number is its own product."""
    factors = F.transform(F.split(value, r"\*"), number)
    return F.aggregate(factors, F.lit(1.0), lambda acc, x: acc * x)


def first_of_list(value: Column) -> Column:
    """First element of a JSON list; any other text is kept as it is."""
    listed = F.from_json(value, "array<string>")
    return F.when(F.ltrim(value).startswith("["), F.get(listed, 0)).otherwise(value)


CONVERTERS = {"temperature": temperature, "time": hours, "humidity": humidity}


def conform_unit(value: Column, kind: str) -> Column:
    """A number without unit: products are solved first, then units read."""
    return F.coalesce(product(value), CONVERTERS[kind](value, strict=False))


def leading_digits(value: Column, keep_ranges: bool = False) -> Column:
    """Digits and dots among the first four characters, as text.

    With ``keep_ranges`` a text holding ``-`` stays as it is.
    """
    digits = F.nullif(
        F.regexp_replace(F.substring(value, 1, 4), r"[^0-9.]", ""), F.lit("")
    )
    if keep_ranges:
        return F.when(value.contains("-"), value).otherwise(digits)
    return digits


def to_fraction(value: Column) -> Column:
    """Efficiencies above 1 are percentages: divide them by 100."""
    return F.when(value > 1, value / 100).otherwise(value)
