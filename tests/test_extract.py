import re

from skillspark.operators import extract
from tests.conftest import rows

SKILLS = [("python", "Python", "hard", ["python3"], False), ("cpp", "C++", "hard", [], False), ("c", "C", "hard", [], False), ("team", "Làm việc nhóm", "soft", [], False), ("cad", "AutoCAD", "hard", ["autocad"], False), ("sql", "SQL", "hard", [], False), ("sqlserver", "SQL Server", "hard", [], False), ("it", "Testing", "hard", [], True)]


def aliases(spark):
    return extract.aliases_of(spark.createDataFrame(SKILLS, "skill_id string, canonical_name string, skill_type string, aliases array<string>, is_category boolean"))


def found(spark, text, labels=None, fuzzy=True):
    records = spark.createDataFrame([(1, text, labels)], "record_id long, text string, labels array<string>")
    return extract.extract_skills(records, aliases(spark), fuzzy)


def ids(df):
    return sorted(r["skill_id"] for r in df.collect())


def test_exact(spark):
    assert ids(found(spark, "Lập trình C/C++ và python3")) == ["c", "cpp", "python"]
    assert ids(found(spark, "Có khả năng làm việc  nhóm hiệu quả", fuzzy=False)) == ["team"]
    assert ids(found(spark, "SQL Server, testing")) == ["sql", "sqlserver"]
    assert ids(found(spark, "nothing here")) == ids(found(spark, None)) == ids(found(spark, "")) == []


def test_evidence_and_fuzzy(spark):
    row = found(spark, "Thành thạo autocard, excel").first()
    assert (row["skill_id"], row["method"], row["score"]) == ("cad", "fuzzy_match", 87.5)
    assert "autocard" in row["evidence"]
    text = "x" * 50 + " with Python inside " + "y" * 50
    assert found(spark, text).first()["evidence"] == text[26:92].strip()


def test_labels_only(spark):
    out = found(spark, "C++ and SQL", ["python", "unknown-skill", "Python"])
    assert ids(out) == ["python", "python"] and {r["method"] for r in out.collect()} == {"source_provided"}
    assert ids(found(spark, "C++ and SQL", ["unknown-skill"])) == []


def test_common_tokens_are_no_misspellings(spark):
    data = [(i, "testing pipeline") for i in range(50)] + [(50, "posgresql tuning"), (51, ""), (52, None)]
    common = {r["token"] for r in extract.common_tokens(spark.createDataFrame(data, "record_id long, text string")).collect()}
    assert common == {"testing", "pipeline"}
    words = spark.createDataFrame([("testng", "TestNG", "hard"), ("postgresql", "PostgreSQL", "hard")], "skill_id string, canonical_name string, skill_type string")
    r = spark.createDataFrame([(i, t, None) for i, t in data], "record_id long, text string, labels array<string>")
    assert ids(extract.extract_skills(r, extract.aliases_of(words))) == ["postgresql"]


def test_phrases_are_slices_of_the_text(spark):
    text = "a, b+c: d.\n e"
    got = {r["phrase"] for r in extract.phrases(spark.createDataFrame([(1, text)], "record_id long, text string")).collect()}
    spans = [m.span() for m in re.finditer(r"\.?\w+(?:[+#.]\w+)*[+#]*", text)]
    want = {text[spans[i][0] : spans[i + k - 1][1]] for k in range(1, 5) for i in range(len(spans) - k + 1)}
    assert got == want


def test_empty(spark):
    r = spark.createDataFrame([], "record_id long, text string, labels array<string>")
    assert rows(extract.extract_skills(r, aliases(spark))) == []
