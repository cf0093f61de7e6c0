from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftwell import functions as fn
from siftwell.functions.special import f_upper, regularized_beta, t_two_sided
from siftwell.functions.text import KEY_LENGTH, WHITESPACE


def evaluate(spark, texts, function):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("t"))).collect()]


NUMBERS = {
    " 5 ": 5.0, "1e5": 100000.0, "+3": 3.0, "-.5": -0.5, "7.": 7.0, "1,234.56": 1234.56,
    "0x10": None, "5d": None, "5f": None, "1_0": None, "True": None, "nan": None, "inf": None, "": None, "-": None,
}


def test_numbers_with_separators(spark):
    assert evaluate(spark, NUMBERS, fn.parse_number_lenient) == list(NUMBERS.values())


def test_strict_numbers_have_no_separators(spark):
    assert evaluate(spark, ["1,234.56", "12"], fn.parse_number) == [None, 12.0]


DATES = {
    "2024-01-05": datetime(2024, 1, 5), "2024-1-5": datetime(2024, 1, 5), "01/05/2024": datetime(2024, 1, 5),
    "13/05/2024": datetime(2024, 5, 13), "1/5/24": datetime(2024, 1, 5), "1/5/99": datetime(1999, 1, 5),
    "2024/01/05": datetime(2024, 1, 5), "5 Jan 2024": datetime(2024, 1, 5), "05 JANUARY 2024": datetime(2024, 1, 5),
    "Jan 5, 2024": datetime(2024, 1, 5), "20240105": datetime(2024, 1, 5), " 2024-01-05 ": datetime(2024, 1, 5),
    "2024-01-05T10:00:00": datetime(2024, 1, 5, 10), "01/05/2024 10:30": datetime(2024, 1, 5, 10, 30),
    "5-Jan-24": datetime(2024, 1, 5), "05.01.2024": datetime(2024, 5, 1), "31.01.2024": datetime(2024, 1, 31), "2024.01.05": datetime(2024, 1, 5),
    "2024-01": datetime(2024, 1, 1), "Jan 5 2024 10:30 AM": datetime(2024, 1, 5, 10, 30), "Jan 5 2024 10:30 PM": datetime(2024, 1, 5, 22, 30),
    "1/5/2024 12:05:09 am": datetime(2024, 1, 5, 0, 5, 9), "20240105T101500": datetime(2024, 1, 5, 10, 15), "Friday, January 5, 2024": datetime(2024, 1, 5),
    "2024-01-05T10:00:00+02:00": datetime(2024, 1, 5, 8), "2024-01-05T10:00:00Z": datetime(2024, 1, 5, 10), "2024-01-05 23:30-0530": datetime(2024, 1, 6, 5),
    "2024-01-05 10:00:00.25 UTC": datetime(2024, 1, 5, 10, 0, 0, 250000), "Friday": None, "5-Foo-24": None, "2024-13": None,
    "junk": None, "2024": None, "2024-13-45": None, "Mayhem 5, 2024": None, "": None,
}


def test_dates_in_mixed_notations(spark):
    assert evaluate(spark, DATES, fn.parse_date) == list(DATES.values())


def test_whitespace_is_what_python_strips():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_normalized_text(spark):
    texts = [" New York", "NEW YORK\t", " new york　", "new  york"]
    assert evaluate(spark, texts, fn.normalize_text) == ["new york"] * 3 + ["new  york"]


def test_state_codes(spark):
    texts = ["NY", "ny", " New York ", "california", "West Virginia", "in", "Guam", "DC", None]
    assert evaluate(spark, texts, fn.state_code) == ["NY", "NY", "NY", "CA", "WV", "IN", None, None, None]
    assert len(fn.STATE_CODES) == len(set(fn.STATE_CODES.values())) == 50


def test_keys_tell_long_texts_apart(spark):
    long = "x" * KEY_LENGTH
    texts = [long, long + "a", long + "b", "#" * (KEY_LENGTH + 1), "1" * 300]
    keys = evaluate(spark, texts, fn.value_key)
    assert len(set(keys)) == len(texts)
    assert keys[0] == long and keys[4] == "1" * 300
    assert {len(k) for k in keys[1:4]} == {KEY_LENGTH + 1}


def test_plain_number_text(spark):
    rows = spark.createDataFrame([(0, 42.0), (1, 0.25), (2, 12345678.9), (3, -1e-7), (4, 1e20)], "i int, v double")
    shown = [r[0] for r in rows.orderBy("i").select(fn.number_text(F.col("v"))).collect()]
    assert shown == ["42.0", "0.25", "12345678.9", "-0.0000001", "1.0E20"]


def test_days_are_completed_days(spark):
    row = spark.sql("SELECT timestamp_ntz'2024-01-01 18:00:00' AS a, timestamp_ntz'2024-01-03 06:00:00' AS b")
    assert row.select(fn.whole_days(F.col("a"), F.col("b"))).first()[0] == 1


@pytest.mark.parametrize(
    "t, df, p",
    [(2.0, 10, 0.0733880348), (12.7062047364, 1, 0.05), (-2.2281388520, 10, 0.05), (0.0, 5, 1.0), (1.9599639845, 1e12, 0.05)],
)
def test_t_tail(t, df, p):
    assert t_two_sided(t, df) == pytest.approx(p, abs=1e-9)


@pytest.mark.parametrize("f, d1, d2, p", [(4.9646027437, 1, 10, 0.05), (3.0983912122, 3, 20, 0.05), (2.3478775690, 10, 20, 0.05)])
def test_f_tail(f, d1, d2, p):
    assert f_upper(f, d1, d2) == pytest.approx(p, abs=1e-8)


@pytest.mark.parametrize("d1", [1, 2, 3, 4, 7, 11])
@pytest.mark.parametrize("d2", [3, 41, 9_000])
def test_f_tail_is_the_incomplete_beta(d1, d2):
    for f in (0.2, 1.0, 2.5, 7.0):
        assert f_upper(f, d1, d2) == pytest.approx(regularized_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)), abs=1e-11)


def test_tails_agree_across_the_change_of_method():
    for t in (0.1, 1.0, 2.5, 6.0):
        assert t_two_sided(t, 99_999) == pytest.approx(t_two_sided(t, 100_001), rel=1e-4, abs=1e-12)
