import datetime as dt

from skillspark.operators import references
from skillspark.operators.references import Reference, existence_spans, find_orphans, report_orphans
from tests.conftest import rows

REF = Reference("links", "key", "no", "at", "things", "id")
LINKS = "no long, key string, at timestamp, period string"
THINGS = "id string, loaded_at timestamp, deleted_at timestamp, k string"


def d(month, day=1):
    return dt.datetime(2025, month, day)


def find(spark, links, things):
    out = find_orphans(spark.createDataFrame(links, LINKS), spark.createDataFrame(things, THINGS), REF)
    return [(no, period) for _, _, no, period in rows(out)]


def test_absent_late_and_deleted(spark):
    things = [("a", d(2), d(4), ""), ("a", d(2), d(4), ""), ("a", d(6), None, ""), ("b", d(3), d(2), ""), (None, d(1), None, ""), ("c", None, None, "")]
    links = [(1, "a", d(1), ""), (2, "a", d(2), ""), (3, "a", d(3), ""), (4, "a", d(4), ""), (5, "a", d(5), ""), (6, "a", d(7), ""), (7, "b", d(5), ""), (8, None, d(5), ""), (9, "zz", d(5), ""), (10, "c", d(5), ""), (11, "a", None, ""), (12, "", d(5), "")]
    assert find(spark, links, things) == [(1, "2025-01"), (10, "2025-05"), (11, None), (12, "2025-05"), (4, "2025-04"), (5, "2025-05"), (7, "2025-05"), (9, "2025-05")]


def test_spans_merge(spark):
    things = [("a", d(1), d(3), ""), ("a", d(2), d(4), ""), ("a", d(4), d(5), ""), ("a", d(7), None, ""), ("a", d(8), d(9), "")]
    assert rows(existence_spans(spark.createDataFrame(things, THINGS), "id")) == [("a", d(1), d(5)), ("a", d(7), None)]


def test_heavy_key_gives_the_same_rows(spark, monkeypatch):
    links = spark.range(20_000).selectExpr("id AS no", "IF(id % 3 = 0, 'hot', concat('k', id % 5000)) AS key", "timestamp'2025-03-01' + make_interval(0, 0, 0, id % 60) AS at", "'' AS period")
    things = spark.createDataFrame([("hot", d(3, 10), d(4, 20), ""), ("k1", d(1), None, "")], THINGS)
    found = lambda: sorted(r["row_no"] for r in find_orphans(links, things, REF).collect())
    got = set(found())
    want = {
        r["no"]
        for r in links.collect()
        if not (r["key"] == "k1" or r["key"] == "hot" and d(3, 10) <= r["at"] < d(4, 20))
    }
    assert got == want and len(found()) == len(want)
    report = rows(report_orphans(links, things, REF))
    assert [r[2] for r in report] == ["2025-03", "2025-04"] and sum(r[3] for r in report) == len(want)
    monkeypatch.setattr(references, "MAX_BROADCAST_SPANS", 0)  # heavy keys are salted: the same rows
    assert found() == sorted(want) and rows(report_orphans(links, things, REF)) == report


def test_report_counts_per_month(spark):
    links = spark.createDataFrame([(1, "a", d(1), ""), (2, "a", d(1), ""), (3, "b", d(2), ""), (4, "b", None, ""), (5, None, d(2), "")], LINKS)
    things = spark.createDataFrame([("a", d(1, 2), None, "")], THINGS)
    assert rows(report_orphans(links, things, REF)) == [("links", "key", None, 1), ("links", "key", "2025-01", 2), ("links", "key", "2025-02", 1)]


def test_empty_tables(spark):
    assert find(spark, [], []) == []
    assert find(spark, [(1, "a", d(1), "")], []) == [(1, "2025-01")]
    links, things = spark.createDataFrame([], LINKS), spark.createDataFrame([], THINGS)
    assert rows(find_orphans(links, things, REF)) == [] and rows(report_orphans(links, things, REF)) == []
