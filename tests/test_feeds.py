import json

from pyspark.sql import functions as F

from skillspark.operators import mapping
from skillspark.sources import feeds
from skillspark.streaming import upsert
from tests.conftest import rows


def put(path, lines):
    path.write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in lines) + "\n", encoding="utf-8")


def test_keywords(spark, tmp_path):
    (tmp_path / "q.txt").write_text("kế toán\n\n  data \n", encoding="utf-8")
    assert rows(feeds.keywords(spark, str(tmp_path / "q.txt"))) == [("data",), ("kế toán",)]


def test_newest_crawl_wins(spark, tmp_path):
    put(tmp_path / "a_20260101.jsonl", [{"_source": "a", "id": 1, "title": "cũ"}, {"_source": "b", "id": 1, "title": "khác"}, {"_source": "b", "_row_id": 0, "title": "zero"}])
    put(tmp_path / "a_20260102.jsonl", [{"_source": "a", "id": 1, "title": "mới 1"}, {"_source": "a", "id": 1, "title": "mới"}, {"_source": "b", "id": 0, "slug": "s", "title": "slug"}])
    newest = feeds.newest(feeds.line_key(feeds.raw_lines(spark, str(tmp_path))))
    got = rows(newest.select("raw_key", F.get_json_object("line", "$.title")))
    assert got == [("a:1", "mới"), ("b:0", "zero"), ("b:1", "khác"), ("b:s", "slug")]


def test_first_seen(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("l", 3, "c")], "key string, seq int, v string")
    assert rows(feeds.first_seen(df, "key", "seq").select("key", "v")) == [("k", "a"), ("l", "c")]


def test_stream_keeps_the_newest(spark, tmp_path):
    src, table, check = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    src.mkdir()
    put(src / "f1.jsonl", [{"_source": "a", "id": 1, "t": "old"}, {"_source": "a", "id": 2, "t": "two"}])
    upsert.stream_upsert(spark, str(src), table, check).awaitTermination()
    put(src / "f2.jsonl", [{"_source": "a", "id": 1, "t": "new"}])
    upsert.stream_upsert(spark, str(src), table, check).awaitTermination()
    now = upsert.current(spark, table)
    assert rows(now.select("raw_key", F.get_json_object("line", "$.t"))) == [("a:1", "new"), ("a:2", "two")]


def test_pages(spark, tmp_path):
    for k in ("x", "y"):
        for p in (1, 2):
            if (k, p) != ("y", 2):
                (tmp_path / f"{k}-{p}.json").write_text(json.dumps({"items": [{"id": f"{k}{p}"}, {"id": "z"}]}))
    pages = feeds.read_pages(spark, str(tmp_path) + "/{keyword}-{page}.json", ["x", "y"], 2)
    got = feeds.page_rows(pages, "src", "id:string", lambda body: F.get_json_object(body, "$.items"))
    assert rows(got.select("_query", "page", "pos", "id")) == [("x", 1, 0, "x1"), ("x", 1, 1, "z"), ("x", 2, 0, "x2"), ("x", 2, 1, "z"), ("y", 1, 0, "y1"), ("y", 1, 1, "z")]


def test_embedded_and_linked_data(spark):
    data = {"props": {"initialState": {"api": {"getJobList": {"data": {"total_pages": 3}}}}}}
    posting = {"@type": "JobPosting", "description": "d", "jobLocation": [{"address": {"addressLocality": "Quận 1", "addressRegion": "HCM"}}], "baseSalary": {"currency": "USD", "value": {"value": 1000, "unitText": "MONTH"}}, "experienceRequirements": {"monthsOfExperience": 37}, "skills": ["AWS"]}
    html = f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(data)}</script><script type="application/ld+json">{{bad</script><script type="application/ld+json">{json.dumps({"@type": "Org"})}</script><script type="application/ld+json">{json.dumps(posting)}</script>'
    df = spark.createDataFrame([(html,), (None,), ("<p>x</p>",)], "h string")
    ld = feeds.json_ld_posting(F.col("h"))
    got = df.select(feeds.embedded_json(F.col("h")), feeds.ld_location(ld), feeds.ld_salary(ld), feeds.ld_months(ld)).collect()
    assert tuple(got[0]) == ('{"total_pages":3}', "Quận 1, HCM", "1000 USD/MONTH", 37)
    assert tuple(got[1]) == tuple(got[2]) == ("{}", None, None, None)


def test_sections(spark):
    df = spark.createDataFrame([("intro Needs: a b Benefits c",), ("none",), (None,)], "t string")
    got = df.select(feeds.section(F.col("t"), "Needs:", ["Benefits", "Other"])).collect()
    assert [r[0] for r in got] == ["a b", None, None]


def test_cards_and_details(spark):
    html = '<div class="card x"><h3 class="title">Dev <b>A</b></h3><a href="/j/1?ref=2">go</a><img alt="ACME logo"></div><div class="card"><h3 class="title">Two</h3><span class="company">Own</span></div>'
    pages = spark.createDataFrame([(1, html), (2, None)], "page long, html string")
    cards = feeds.listing_cards(pages, "card", {"title": "title", "company": "company"})
    assert rows(cards) == [(1, 0, "/j/1", "Dev A", "ACME logo"), (1, 1, None, "Two", "Own")]
    listing = spark.createDataFrame([("s1", "A"), ("s2", "B")], "slug string, title string")
    details = spark.createDataFrame([("s1", '<script type="application/ld+json">{"@type":"JobPosting","datePosted":"2026-07-16","skills":["AWS"]}</script>')], "slug string, html string")
    assert rows(feeds.with_details(listing, details).select("slug", "title", "date_posted", "skills_ld")) == [("s1", "A", "2026-07-16", ["AWS"]), ("s2", "B", None, None)]


def test_upsert(spark):
    old = spark.createDataFrame([("k", "a", 1), ("l", "b", 1)], "key string, v string, at int")
    new = spark.createDataFrame([("k", "c", 1), ("l", "d", 0)], "key string, v string, at int")
    assert rows(feeds.upsert(old, new, "key", "at")) == [("k", "c", 1), ("l", "b", 1)]


def test_pages_tell_how_many_there_are(spark, tmp_path):
    for k in range(1, 6):
        (tmp_path / f"q-{(k - 1) * 2}-2.json").write_text(json.dumps({"meta": {"total_pages": 3}, "rows": [{"v": 10 * k}, {"v": 10 * k + 1}] if k != 2 else []}))
    pages = feeds.read_pages(spark, f"{tmp_path}/{{keyword}}-{{offset}}-{{limit}}.json", ["q", "none"], 5, limit=2, total="meta.total_pages")
    assert sorted((r["keyword"], r["page"]) for r in pages.collect()) == [("q", 1), ("q", 2), ("q", 3)]
    items = lambda body: F.get_json_object(body, "$.rows")
    found = feeds.page_rows(pages, "s", "v int", items, limit=2)
    assert sorted((r["_row_id"], r["v"]) for r in found.collect()) == [(0, 10), (1, 11), (4, 30), (5, 31)]
    before = feeds.until_empty(pages, items(F.col("body")) == "[]")
    assert [r["page"] for r in before.collect()] == [1]


def test_details_and_their_errors(spark):
    listing = spark.createDataFrame([("a",), ("b",), ("c",)], "slug string")
    ld = '<script type="application/ld+json">{"@type": "JobPosting", "description": "d"}</script>'
    pages = spark.createDataFrame([("a", ld + "<h2>Your skills</h2><p>Know SQL.</p><h2>Why us</h2>"), ("b", "<p>gone</p>")], "slug string, html string")
    got = {r["slug"]: r["requirements"] for r in feeds.with_details(listing, pages, requirements=("Your skills", ["Why us", "Benefits"])).collect()}
    assert got == {"a": "Know SQL.", "b": None, "c": None}
    assert rows(feeds.detail_errors(listing, pages)) == [("b", "no linked data"), ("c", "no page")]


def test_amounts(spark):
    texts = {"1.2.3": None, "12.5": "12.5 USD/MONTH", ".5": ".5 USD/MONTH", ".": None, "12": "12 USD/MONTH"}
    post = [(json.dumps({"baseSalary": {"currency": "USD", "value": {"value": t, "unitText": "MONTH"}}}),) for t in texts]
    assert [r[0] for r in spark.createDataFrame(post, "p string").select(feeds.ld_salary(F.col("p"))).collect()] == list(texts.values())


def test_versions_of_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(4):
        upsert.write_version(spark.range(n + 1), path)
    assert upsert.current(spark, path).count() == 4 and upsert.versions(spark, path) == ["v=0000000002", "v=0000000003"]
    assert upsert.current(spark, path, before=3).count() == 3 and upsert.current(spark, str(tmp_path / "no")) is None


FEED_A = "id long, title string, employer_info struct<name:string>, places string, contact_address string, salary_min long, salary_max long, level_requirement int, working_method int, job_requirement string, other_requirement string, created_at long, _query string"
FEED_B = "_row_id long, job_title string, job_title_short string, company_name string, job_location string, job_country string, job_skills string, job_posted_date string, salary_year_avg double, job_schedule_type string"
FEED_C = "job_key string, slug string, title string, company string, location string, url string, salary_raw string, requirements string, description string, date_posted string, valid_through string, employment_type string, skills array<string>, skills_ld array<string>, months_experience int, industry string"


def test_mapping(spark):
    a = spark.createDataFrame([
        (123, "Dev", ("Cong ty ABC",), '[{"address":"Ha Noi","province_id":122}]', "617A", 15000000, 20000000, 3, None, "<p>Do</p>", "<ul><li>Thanh thao Python</li></ul>", 1767225600, "q"),
        (124, None, None, "[]", None, 0, 20000000, 0, 1, None, None, 0, None),
        (None, "no id", None, '["Plain"]', None, None, None, None, None, None, None, None, None),
    ], FEED_A)
    b = spark.createDataFrame([(7, "Data Analyst", "DA", "HPE", "Mexico", "Mexico", "['python', 'sql', 'power bi']", "2023-01-14 13:18:07", 95000.0, "Full-time"), (0, "", "Short", None, None, None, "broken", "14/01/2023", 0.0, None)], FEED_B)
    c = spark.createDataFrame([("abc-123", "s", "T", "C", "L", "/u", None, "r", "d", "2026-07-16", None, None, ["AWS"], ["AWS", "Python", "SQL"], 37, "IT"), (None, "slug", None, None, None, None, None, None, None, "bad", None, None, ["X"], None, None, None)], FEED_C)
    records, rejects = mapping.mediate({"vieclam24h": a, "data_jobs": b, "itviec": c, "other": b})
    got = {r["source_id"]: r for r in records.collect()}
    assert set(got) == {"123", "124", "7", "0", "abc-123", "slug"}
    r = got["123"]
    assert (r["company"], r["location"], r["salary_raw"], r["requirements_raw"], str(r["posted_date"])) == ("Cong ty ABC", "Ha Noi", "15000000-20000000", "Do Thanh thao Python", "2026-01-01")
    assert (r["extra"]["province_id"], r["extra"]["contact_address"]) == (122, "617A")
    assert (got["124"]["salary_raw"], got["124"]["level"], got["124"]["posted_date"], got["124"]["title"], got["124"]["location"]) == ("20000000", None, None, "", None)
    assert (got["7"]["requirements_raw"], got["7"]["extra"]["skills_given"], str(got["7"]["posted_date"])) == ("python, sql, power bi", ["python", "sql", "power bi"], "2023-01-14")
    assert (got["0"]["title"], got["0"]["extra"]["skills_given"], got["0"]["posted_date"], got["0"]["salary_raw"]) == ("Short", [], None, None)
    assert (got["abc-123"]["level"], got["abc-123"]["extra"]["skills_given"], str(got["abc-123"]["posted_date"])) == ("37 months", ["AWS", "Python", "SQL"], "2026-07-16")
    assert got["slug"]["extra"]["skills_given"] == ["X"]
    assert rejects.count() == 1


def test_field_suggestions(spark):
    fields = spark.createDataFrame([("job_title",), ("companyName",), ("zzz",)], "field string")
    targets = spark.createDataFrame([("jobtitle",), ("company_name",), ("url",)], "target string")
    assert [r[:2] for r in rows(mapping.suggest_fields(fields, targets))] == [("companyName", "company_name"), ("job_title", "jobtitle")]
