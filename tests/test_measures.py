import pytest
from pyspark.sql import functions as F

from sheaf.functions import measures as m

V = F.col("v")


def check(column, cases, expression):
    got = column(list(cases), expression)
    assert got == pytest.approx(list(cases.values()))


def test_temperature(column):
    cases = {
        "25-85": 55, "-20": None, "20-25°C": None, "65 ± 5": 65, "room temperature": 25,
        "Ambient": 25, "85.5": 85, "RT": None, "85d": 85,
    }
    check(column, cases, m.temperature(V))


def test_temperature_lenient(column):
    cases = {"-20": -20, "20-25°C": 22.5, "85.5": 85.5, "RT": 25, "65 ± 5": 65, "junk": None}
    check(column, cases, m.temperature(V, strict=False))


def test_hours(column):
    cases = {
        "24 h": 24, "24 hours": None, "10 days": 240, "1 day": None, "2 weeks": 336,
        "3 months": None, "30 min": 0.5, "30 minutes": None, "36 s": 0.01, "1000": None,
    }
    check(column, cases, m.hours(V))


def test_hours_lenient(column):
    cases = {
        "24 hours": 24, "1 day": 24, "3 months": 2160, "30 minutes": 0.5, "1000": 1000,
        "36 seconds": 0.01, "5 parsecs": None,
    }
    check(column, cases, m.hours(V, strict=False))


def test_humidity(column):
    cases = {
        "30-40%": 35, "20-30% RH": None, "50 ± 5%": 50, "45%": 45, "ambient": 52,
        "dry air": 0.1, "rh 45": 45, "50": None, "N2 glovebox": 0.2, "high": 72, "low": 22,
    }
    check(column, cases, m.humidity(V))


def test_humidity_lenient(column):
    cases = {"20-30% RH": 25, "50": 50, "dry N2": 0.1, "ambient air": 52, "N2": 0.2}
    check(column, cases, m.humidity(V, strict=False))


def test_percentage(column):
    cases = {
        "80-90%": 85, "80–90": 85, "70 ± 5%": 70, "~95 %": 95, "n/a": None, "null": None,
        "-": None, "0.9": 0.9, "none": None,
    }
    check(column, cases, m.percentage(V))


def test_percentage_or_fraction(column):
    cases = {"0.9": 90, "95": 95, "80-90": 85, "0 ± 1": 0}
    check(column, cases, m.percentage(V, fractions=True))


def test_nulls_stay_null(column):
    for expression in (m.temperature(V), m.hours(V), m.humidity(V), m.percentage(V), m.product(V)):
        assert column([None], expression) == [None]


def test_product_and_lists(column):
    check(column, {"18 * 24": 432, "7": 7, "2*3*4": 24, "2 * x": None, "85d": None}, m.product(V))
    assert column(['["a", "b"]', "plain", "[]"], m.first_of_list(V)) == ["a", "plain", None]


def test_leading_digits(column):
    cases = {"1000 h": "1000", "85 °C": "85", "12.345": "12.3", "abc": None}
    assert column(list(cases), m.leading_digits(V)) == list(cases.values())
    assert column(["50-60", "85 %"], m.leading_digits(V, keep_ranges=True)) == ["50-60", "85"]


def test_fraction(column):
    check(column, {"95": 0.95, "0.95": 0.95, "1": 1.0}, m.to_fraction(m.number(V)))
