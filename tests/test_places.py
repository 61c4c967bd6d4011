import pytest
from pyspark.sql import functions as F

from skillspark.functions import places

SCHEMA = "loc string, src string, hint string, pid int, addr string"


@pytest.mark.parametrize("row, want", [
    (("Thành phố Thủ Đức, Hồ Chí Minh", "vieclam24h", None, None, None), ("TP Hồ Chí Minh", "Việt Nam")),
    (("Ha Noi", "itviec", None, None, None), ("Hà Nội", "Việt Nam")),
    (("874 Bùi Hữu Nghĩa, Hoa A", "vieclam24h", None, 120, None), ("Đồng Nai", "Việt Nam")),
    (("Lô T2-1.1a, Khu Công Nghệ Cao, TP. Thủ Đức", "vieclam24h", None, 73, "Hà Nội"), ("TP Hồ Chí Minh", "Việt Nam")),
    (("Phường 14", "vieclam24h", None, None, None), (None, "Việt Nam")),
    (("Watertown, CT", "data_jobs", "United States", None, None), ("Watertown", "United States")),
    (("Bengaluru, Karnataka, India", "data_jobs", None, None, None), ("Bengaluru", "India")),
    (("Austin, TX", "data_jobs", "Sudan", None, None), ("Austin", "United States")),
    (("India", "data_jobs", None, None, None), (None, "India")),
    (("Singapore", "data_jobs", None, None, None), ("Singapore", "Singapore")),
    (("Anywhere", "data_jobs", "India", None, None), ("Làm từ xa", None)),
    (("Dubai - United Arab Emirates", "data_jobs", None, None, None), ("Dubai", "United Arab Emirates")),
    ((None, "data_jobs", "India", None, None), (None, "India")),
    (("", "vieclam24h", None, None, None), (None, "Việt Nam")),
])
def test_city_country(spark, row, want):
    c = F.col
    got = spark.createDataFrame([row], SCHEMA).select(places.city_country(c("loc"), c("src"), c("hint"), c("pid"), c("addr")).alias("p")).first()["p"]
    assert tuple(got) == want


@pytest.mark.parametrize("title, months, want", [
    ("Senior Backend Engineer", 12, "Cao cấp"), ("Thực Tập Sinh Kế Toán", None, "Thực tập sinh"), ("Backend Engineer", 36, "Có kinh nghiệm"),
    ("Backend Engineer", None, None), ("International Sales", None, "Thực tập sinh"), (None, 70, "Cao cấp"), (None, 3, "Mới vào nghề"),
])
def test_seniority(spark, title, months, want):
    df = spark.createDataFrame([(title, months)], "t string, m int")
    assert df.select(places.seniority(F.col("t"), F.col("m"))).first()[0] == want


def test_months(spark):
    df = spark.createDataFrame([("37 months",), ("1 month",), ("senior",), (None,), ("over 3 months",)], "l string")
    assert [r[0] for r in df.select(places.months_experience(F.col("l"))).collect()] == [37, 1, None, None, None]
