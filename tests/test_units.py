import pytest

from skillspark.operators.units import annual_pay, read_number, read_pay, segment
from tests.conftest import rows


@pytest.mark.parametrize("text, want", [
    ("15000000-20000000", [(15e6, None, None), (20e6, None, None)]),
    ("$1,000 - $2,000", [(1000, "USD", None), (2000, "USD", None)]),
    ("9,5–20 TRIỆU / tháng", [(9.5e6, "VND", "month"), (20e6, "VND", "month")]),
    ("37tr5-38.5tr", [(37.5e6, "VND", None), (38.5e6, "VND", None)]),
    ("từ 10 triệu VND tới 1400 đô/tháng", [(10e6, "VND", "month"), (1400, "USD", "month")]),
    ("15 triệu - 1.000 USD", [(15e6, "VND", None), (1000, "USD", None)]),
    ("3k đến 4.6k $", [(3000, "USD", None), (4600, "USD", None)]),
    ("30k - 39k/h VND", [(30e3, "VND", "hour"), (39e3, "VND", "hour")]),
    ("<b>89k € gross per year</b>", [(89e3, "EUR", "year")]),
    ("59万円 monthly", [(590e3, "JPY", "month")]),
    ("S$6.7k monthly", [(6700, "SGD", "month")]),
    ("hai mươi lăm triệu một tháng", [(25e6, "VND", "month")]),
    ("twenty-five million VND monthly", [(25e6, "VND", "month")]),
    ("33 – 42 triệu (thử việc 2 tháng 85%)", [(33e6, "VND", None), (42e6, "VND", None)]),
    ("Lương cứng 23,5 - 35 triệu + thưởng tháng 13", [(23.5e6, "VND", None), (35e6, "VND", None)]),
    ("Ca 8 tiếng: 9-12 triệu/tháng", [(9e6, "VND", "month"), (12e6, "VND", "month")]),
    ("From 1200 USD, 12 days off", [(1200, "USD", None)]),
    ("$3,200 gross + 13th month", [(3200, "USD", None)]),
    ("Thưởng 2 lần/năm", []), ("Attractive + 9 days leave", []), ("Lương tháng 13", []), ("Thỏa thuận", []), ("", []), ("-", []),
    ("x" * 5_000, []),
])
def test_amounts(text, want):
    assert [(round(v, 3), c, p) for v, c, p in read_pay(text)] == want


@pytest.mark.parametrize("digits, want", [("1,000", 1000), ("1.000.000", 1e6), ("9,5", 9.5), ("145000.0", 145000), ("1,234.5", 1234.5), ("1.234,5", 1234.5), ("0.875", 0.875), ("7", 7)])
def test_numbers(digits, want):
    assert read_number(digits) == want


def test_segmentation():
    assert [k for k, _ in segment("triệu vnd/tháng")] == ["magnitude", "currency", "per", "time"]
    assert segment("") == []


def test_units_come_from_text_then_feed(spark):
    money = spark.createDataFrame([("VND", 1), ("USD", 25000)], "currency string, vnd_per_unit long")
    periods = spark.createDataFrame([("month", 12), ("year", 1)], "pay_period string, times_per_year int")
    feeds = spark.createDataFrame([("a", "VND", "month"), ("b", "USD", "year")], "source string, currency string, pay_period string")
    data = [(1, "a", "2 - 3 triệu", 0), (2, "b", "$10-20", 0), (3, "b", "40000", 0), (4, None, "5 USD/month", 0), (5, "zz", "17", 0), (6, "a", None, 0), (7, "a", "", 0), (8, "a", "20 EUR", 0), (9, "b", "30-10", 0)]
    records = spark.createDataFrame(data, "rec_no long, source string, salary_raw string, amounts int").drop("amounts")
    got = rows(annual_pay(records, money, periods, feeds))
    assert got == [(1, 24_000_000, 36_000_000), (2, 250_000, 500_000), (3, 1_000_000_000, 1_000_000_000), (4, 1_500_000, 1_500_000), (9, 250_000, 750_000)]
    assert rows(annual_pay(records.limit(0), money, periods, feeds)) == []
    assert rows(annual_pay(records, money.limit(0), periods, feeds)) == []
