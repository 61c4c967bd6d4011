import pytest
from pyspark.sql import functions as F

from skillspark.functions.pay import salary
from skillspark.operators.warehouse import dense_ids
from tests.conftest import rows


@pytest.mark.parametrize("text, source, want", [
    ("15000000-20000000", "vieclam24h", (1.5e7, 2.0e7, "VND", "month")), ("95000", "data_jobs", (95000.0, 95000.0, "USD", "year")),
    ("$1,000 - $2,000", "itviec", (1000.0, 2000.0, "USD", "month")), ("$15,000,000", "itviec", (1.5e7, 1.5e7, "VND", "month")),
    (None, "itviec", (None, None, None, None)), ("", "itviec", (None, None, None, None)), ("thỏa thuận", "itviec", (None, None, "USD", "month")),
    ("10 triệu", "itviec", (10.0, 10.0, "VND", "month")), ("7", "other", (7.0, 7.0, None, None)),
])
def test_salary(spark, text, source, want):
    df = spark.createDataFrame([(text, source)], "t string, s string")
    assert tuple(df.select(salary(F.col("t"), F.col("s")).alias("x")).first()["x"]) == want


def test_dense_ids(spark):
    df = spark.createDataFrame([(x, f"v{x}") for x in (30, 10, 20, 50, 40)], "o int, v string").repartition(4)
    assert rows(dense_ids(df, ["o"], "i").select("i", "v")) == [(1, "v10"), (2, "v20"), (3, "v30"), (4, "v40"), (5, "v50")]
    assert dense_ids(df.limit(0), ["o"], "i").count() == 0
