import pytest
from pyspark.sql import functions as F

from skillspark.functions import text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


@pytest.mark.parametrize("name, slug", [("C#", "c-sharp"), ("C++", "c-plus-plus"), ("c", "c"), ("F#", "f-sharp"), (".NET", "dotnet"), ("Tính lương, C&B", "tinh-luong-c-and-b"), ("Điện toán đám mây", "dien-toan-dam-may"), ("Đọc bản vẽ kỹ thuật", "doc-ban-ve-ky-thuat"), ("", "skill"), ("公司", "skill")])
def test_slugs(spark, name, slug):
    assert one(spark, text.slugify("x"), x=name) == slug


def test_accents(spark):
    assert one(spark, text.strip_accents("x"), x="  Đường  Tiếng ệ C++ C# .NET ") == "duong tieng e c++ c# .net"
    assert one(spark, text.strip_accents("x"), x="Tiếng") == "tieng"
    assert one(spark, text.strip_accents("x"), x=None) == ""
    assert one(spark, text.norm_text("x"), x=" A  B\n") == "a b"


def test_html(spark):
    assert one(spark, text.html_to_text("x"), x="<ul><li>A&amp;B</li><li>C</li></ul><script>var x;</script>") == "A&B C"
    assert one(spark, text.html_to_text("x"), x="<p></p>") is None
    assert one(spark, text.html_to_text("x"), x=None) is None


@pytest.mark.parametrize("html, plain", [("a&#84;b&#x1EBF;c", "aTbếc"), ("caf&eacute; &euro;5", "café €5"), ("&amp;lt; R&D &nope; &#xD800; &#0; &", "&lt; R&D &nope; &#xD800; &#0; &"), ("x&nbsp;&#160;y", "x y"), ("&#128512;", "😀")])
def test_entities(spark, html, plain):
    assert one(spark, text.html_to_text("x"), x=html) == plain


def test_tokens(spark):
    assert one(spark, text.tokens("x"), x="C/C++, C# và .NET; Node.js 3.5!") == ["C", "C++", "C#", "và", ".NET", "Node.js", "3.5"]


@pytest.mark.parametrize("name, key", [("Công ty TNHH ABC Việt Nam", "abc viet nam"), ("CÔNG TY CỔ PHẦN ABC Việt Nam", "abc viet nam"), ("Công ty TNHH MTV Thương mại XYZ", "xyz"), ("Công ty TNHH", "cong ty tnhh"), ("ABC Co., Ltd", "abc co ltd"), (None, "")])
def test_company_key(spark, name, key):
    assert one(spark, text.company_key("x"), x=name) == key


def test_similarity(spark):
    sim = lambda a, b: one(spark, text.similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert sim("autocard", "autocad") == 87.5
    assert sim("", "") == 100.0
    assert one(spark, text.token_sort(F.col("x")), x="abc ha noi") == one(spark, text.token_sort(F.col("x")), x="ha noi abc")


def test_search_terms(spark):
    assert one(spark, text.search_terms("x"), x="Tiếng Anh") == sorted({"tiếng anh", "tiếnganh", "tieng anh", "tienganh"})


def test_url(spark):
    assert one(spark, text.url_query("x"), x="a b~*&ư") == "a+b~%2A%26%C6%B0"
