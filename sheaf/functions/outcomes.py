"""Outcome of comparing a labelled value with an extracted one.

FN: label without value. TN: value without label (unless the caller counts
such values as FP). The rest is TP within tolerance, else FP.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.measures import number

NUMERIC_TOLERANCE = 0.027
TOP_TEXT_THRESHOLD = 0.8
TEST_TEXT_THRESHOLD = 0.75
FULLERENE = "buckminsterfullerene"


def etl_name(name: Column) -> Column:
    """The one long name that counts as its short form."""
    return F.when(name == FULLERENE, F.lit("C60")).otherwise(name)


def _one_sided(label: Column, value: Column, hallucinated: str) -> Column:
    return F.when(label.isNotNull() & value.isNull(), F.lit("FN")).when(
        label.isNull() & value.isNotNull(), F.lit(hallucinated)
    )


def text_outcome(
    label: Column,
    value: Column,
    similarity: Column,
    threshold: float = TOP_TEXT_THRESHOLD,
    hallucinated: str = "TN",
) -> Column:
    """Both missing is FP here: nothing matched."""
    return (
        _one_sided(label, value, hallucinated)
        .when(label.isNotNull() & (similarity > threshold), F.lit("TP"))
        .otherwise(F.lit("FP"))
    )


def _near(label: Column, value: Column, tolerance: float) -> Column:
    return F.coalesce(F.try_divide(F.abs(label - value), F.abs(label)) <= tolerance, label == value)


def numeric_outcome(
    label: Column,
    value: Column,
    tolerance: float = NUMERIC_TOLERANCE,
    hallucinated: str = "TN",
) -> Column:
    """Both missing is TP here: agreeing on nothing."""
    return (
        _one_sided(label, value, hallucinated)
        .when(label.isNull() & value.isNull(), F.lit("TP"))
        .when(_near(label, value, tolerance), F.lit("TP"))
        .otherwise(F.lit("FP"))
    )


def test_numeric_outcome(
    label: Column,
    value: Column,
    tolerance: float = NUMERIC_TOLERANCE,
    hallucinated: str = "TN",
) -> Column:
    """Inside tests a missing number is 0, and 0 against 0 is TN."""
    a = F.coalesce(label, F.lit(0.0))
    b = F.coalesce(value, F.lit(0.0))
    return (
        F.when((a != 0) & (b == 0), F.lit("FN"))
        .when((a == 0) & (b != 0), F.lit(hallucinated))
        .when((a == 0) & (b == 0), F.lit("TN"))
        .when(_near(a, b, tolerance), F.lit("TP"))
        .otherwise(F.lit("FP"))
    )


def range_outcome(
    label: Column, value: Column, similarity: Column | None = None, hallucinated: str = "TN"
) -> Column:
    """Temperature or humidity whose label may be ``v+-m`` or ``a-b``.

    Plain numbers go by tolerance, ranges by containment. Where the value is
    a text itself and ``similarity`` is given, the texts are compared.
    """
    centre = number(F.split(label, r"\+-", -1)[0])
    margin = number(F.try_element_at(F.split(label, r"\+-", -1), F.lit(2)))
    low = number(F.split(label, "-", -1)[0])
    high = number(F.try_element_at(F.split(label, "-", -1), F.lit(2)))
    x = number(value)
    as_number = number(label)
    inside = (
        F.when(label.contains("+"), x.between(centre - margin, centre + margin))
        .when(label.contains("-"), x.between(low, high))
    )
    missing = value.isNull() | F.coalesce(x == 0, F.lit(False))
    ranged = F.when(missing, F.lit("FN"))
    if similarity is not None:
        ranged = ranged.when(
            x.isNull(),
            F.when(similarity > TEST_TEXT_THRESHOLD, F.lit("TP")).otherwise(F.lit("FP")),
        )
    ranged = ranged.when(inside, F.lit("TP")).otherwise(F.lit("FP"))
    plain = test_numeric_outcome(as_number, x, hallucinated=hallucinated)
    # A text value against a plain or missing number can only be wrong.
    plain = (
        F.when(value.isNotNull() & x.isNull() & as_number.isNotNull() & (as_number != 0), F.lit("FP"))
        .when(value.isNotNull() & x.isNull(), F.lit(hallucinated))
        .otherwise(plain)
    )
    return F.when(label.isNotNull() & as_number.isNull(), ranged).otherwise(plain)


def absent_key_outcome(label: Column) -> Column:
    """The extraction lacks the key: right only if there was nothing to find."""
    return F.when(label.isNull(), F.lit("TP")).otherwise(F.lit("FN"))
