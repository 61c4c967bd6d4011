import datetime as dt

import pytest

from skillspark.functions.text import fold_text, strip_accents
from skillspark.operators import warehouse
from skillspark.operators.quality import integrity_checks, load_gate
from skillspark.operators.warehouse import Warehouse
from skillspark.plans import serving as q
from tests.conftest import rows


@pytest.fixture(scope="module")
def w(spark):
    skills = spark.createDataFrame([
        ("lang", "Ngôn ngữ lập trình", "hard", None, None, ["lang"]), ("python", "Python", "hard", "Ngôn ngữ lập trình", "lang", ["python3", "py"]),
        ("java", "Java", "hard", "Ngôn ngữ lập trình", "lang", None), ("javascript", "JavaScript", "hard", "Ngôn ngữ lập trình", "lang", None), ("teamwork", "Làm việc nhóm", "soft", None, None, None),
    ], "skill_id string, canonical_name string, skill_type string, category string, parent_skill_id string, aliases array<string>")
    jobs = spark.createDataFrame([
        ("j1", "Backend Dev", 1, 1, dt.date(2026, 1, 1), "itviec", None, None), ("j2", "Data Scientist", None, 1, dt.date(2026, 2, 1), "data_jobs", None, "Cao cấp"),
    ], "job_id string, title_raw string, company_id long, location_id int, posted_date date, source string, url string, seniority string")
    facts = spark.createDataFrame([
        ("j1", "python", "hard", "itviec", "source_provided", 100.0, "Python"), ("j2", "java", "hard", "data_jobs", "source_provided", 100.0, "Java"), ("j1", "teamwork", "soft", "itviec", "exact_match", 100.0, "teamwork"),
    ], "job_id string, skill_id string, skill_type string, source string, extraction_method string, confidence double, evidence_snippet string")
    places = spark.createDataFrame([(1, "Ha Noi", "Hà Nội", "Việt Nam")], "location_id int, location_raw string, city string, country string")
    closure = spark.createDataFrame([(s, s, 0) for s in ("lang", "python", "java", "javascript", "teamwork")] + [("lang", s, 1) for s in ("python", "java", "javascript")], "ancestor_id string, descendant_id string, depth int")
    companies = spark.createDataFrame([(1, "Công ty ABC", "công ty abc", None)], "company_id long, name string, name_norm string, industry string")
    variants = spark.createDataFrame([(1, "python", "py"), (2, "python", "Python")], "variant_id long, skill_id string, surface_form string")
    return Warehouse(skills, jobs, facts, places, closure, companies, variants)


@pytest.mark.parametrize("typed, first", [("py", "python"), ("lam viec nhom", "teamwork"), ("ngonngu lap trinh", "lang"), ("Làm  Việc", "teamwork")])
def test_search(w, typed, first):
    assert q.search_skills(w, typed).first()["skill_id"] == first


def test_search_order_and_literal_signs(w):
    assert [r["skill_id"] for r in q.search_skills(w, "java").collect()] == ["java", "javascript"]
    assert [q.search_skills(w, t).count() for t in ("%", "_", " ", "")] == [0, 0, 0, 0]


def test_search_quality(spark, w):
    typed = spark.createDataFrame([("java", "exact", "javascript"), ("py", "short", "python"), ("zzz", "exact", "java")], "q string, kind string, expect_skill string")
    assert rows(q.search_quality(w, typed).select("q", "rank")) == [("java", 2), ("py", 1), ("zzz", 0)]


def test_detail(w):
    r = q.skill_detail(w, "python").first()
    assert (r["parent_name"], r["children"], r["job_count"], len(r["evidence_samples"])) == ("Ngôn ngữ lập trình", [], 1, 1)
    assert r["variants"] == ["Python", "py"] and q.told(q.skill_detail(w, "python")).first()["variants"] == "Python|py"
    assert q.skill_detail(w, "lang").first()["children"] == ["Java", "JavaScript", "Python"]
    assert q.skill_detail(w, "nosuch").count() == 0


def test_expand(w):
    assert [r[0] for r in rows(q.expand_skill_ids(w, "lang"))] == ["java", "javascript", "lang", "python"]
    assert rows(q.expand_skill_ids(w, "python")) == [("python",)]
    assert rows(q.expand_skill_ids(w, "nosuch")) == [("nosuch",)]


def test_search_jobs(w):
    found = q.search_jobs(w, "lang").collect()
    assert [r["job_id"] for r in found] == ["j2", "j1"]
    assert found[1]["source_search_url"] == "https://itviec.com/it-jobs?query=Backend+Dev" and found[0]["source_search_url"] is None
    assert (found[0]["company"], found[1]["company"]) == (None, "Công ty ABC")
    assert q.search_jobs(w, "lang", expand=False).count() == 0
    assert q.search_jobs(w, "lang", limit=1, offset=1).first()["job_id"] == "j1"
    assert q.search_jobs(w, "lang", city="Huế").count() == q.search_jobs(w, "lang", skill_type="soft").count() == 0


def test_statistics(w):
    s = q.corpus_stats(w).first()
    assert s["n_companies"] == 1
    assert (s["n_jobs"], s["n_sources"], s["n_pairs"], s["n_skills"], s["skills_per_job"]) == (2, 2, 3, 3, 1.5)
    s = q.corpus_stats(w, city="Nowhere").first()
    assert (s["n_jobs"], s["n_pairs"], s["skills_per_job"]) == (0, 0, 0.0)
    assert q.corpus_stats(w, skill_type="soft").first()["n_jobs"] == 2
    assert rows(q.jobs_by_category(w)) == [("Ngôn ngữ lập trình", 2)]
    pairs = {(r[0], r[1]): r[2] for r in q.skill_cooccurrence(w).collect()}
    assert pairs["Python", "Làm việc nhóm"] == pairs["Làm việc nhóm", "Python"] == pairs["Python", "Python"] == 1 and ("Python", "Java") not in pairs
    assert rows(q.jobs_by_month(w)) == [("2026-01", "itviec", 1), ("2026-02", "data_jobs", 1)]
    assert rows(q.jobs_by_month(w, months=1)) == [("2026-02", "data_jobs", 1)]
    assert rows(q.hard_soft(w)) == [("hard", 2), ("soft", 1)]
    assert rows(q.list_places(w, "city")) == [] and rows(q.list_places(w, "city", min_jobs=1)) == [("Hà Nội", 2)]
    assert [tuple(r) for r in q.skill_by_city(w).collect()][0][2:] == (1, 2, 50.0)
    assert q.top_skills(w, limit=1).count() == 1


def test_saved_tables_read_the_same(spark, w, tmp_path):
    warehouse.save(w, str(tmp_path / "w"))
    again = warehouse.register(spark, str(tmp_path / "w"))
    assert rows(q.top_skills(again)) == rows(q.top_skills(w))
    assert spark.sql("SELECT count(*) FROM job_skills").first()[0] == 3


def test_texts_are_folded_alike_on_driver_and_cluster(spark):
    texts = ["Tiếng  Đức", " C++ \u00a0x", "ＡＢＣ", "", "İstanbul", "Điện\ttoán"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(strip_accents("t")).collect()] == [fold_text(t) for t in texts]


def test_containing_finds_every_part(spark):
    terms = ["javascript", "java", "sql", "mysql", "a", "ab", "c++"]
    asked = ["java", "sql", "a", "ab", "s", "+", "script", "zzz", "xy"]
    one, two = spark.createDataFrame([(t,) for t in terms * 2], "term string"), spark.createDataFrame([(t,) for t in asked], "t string")
    assert {tuple(r) for r in q.containing(one, two).collect()} == {(t, x) for t in asked for x in terms if t in x}


def test_companies_spellings_and_canonical_records(spark):
    data = [(1, "a", "x", "Acme", dt.datetime(2025, 1, 1), True), (2, "a", "x", " ACME  Co", dt.datetime(2025, 2, 1), None), (3, "a", "y", "", None, True), (4, "b", "z", "Other", None, False)]
    r = spark.createDataFrame(data, "rec_no long, source string, source_id string, company string, crawled_at timestamp, is_canonical boolean").selectExpr("*", "named_struct('industry', 'it') AS extra")
    kept = warehouse.canonical_only(r)
    assert [x[0] for x in rows(kept.select("rec_no"))] == [1, 2, 3] and warehouse.canonical_only(r.drop("is_canonical")).count() == 4
    firms = warehouse.companies_of(kept)
    assert rows(firms.select("company_id", "name")) == [(1, "Acme"), (2, " ACME  Co")]
    assert rows(warehouse.job_companies(kept, firms)) == [("a:x", 2), ("a:y", None)]
    spellings = spark.createDataFrame([("s", "Sql"), ("s", "SQL"), ("s", "SQL"), ("s", " "), ("t", None), ("u", "U")], "skill_id string, canonical_name string")
    assert rows(warehouse.surface_forms(spellings, spark.createDataFrame([("s",), ("t",)], "skill_id string"))) == [(1, "s", "SQL"), (2, "s", "Sql")]


def test_a_warehouse_is_built_once_and_again_where_it_is_gone(spark, w, monkeypatch):
    built = []
    monkeypatch.setattr(warehouse, "load", lambda *a: built.append(a) or w)
    one = warehouse.opened(spark, "somewhere")
    assert rows(q.top_skills(one)) == rows(q.top_skills(w)) and len(built) == 1
    warehouse.opened(spark, "somewhere")
    assert len(built) == 1
    monkeypatch.setitem(warehouse._BUILT, (spark.sparkContext.applicationId, "somewhere"), "/tmp/no-such-warehouse")
    assert warehouse.opened(spark, "somewhere").jobs.count() == 2 and len(built) == 2


def test_best_match(spark):
    jobs, skills = spark.createDataFrame([("j",)], "job_id string"), spark.createDataFrame([("s",)], "skill_id string")
    data = [(1, "j", "s", "hard", "a", "fuzzy_match", 100.0, "f"), (2, "j", "s", "hard", "a", "exact_match", None, "e"), (3, "j", "s", "hard", "a", "exact_match", 90.0, "g"), (4, "x", "s", "hard", "a", "exact_match", 1.0, ""), (5, "j", None, "hard", "a", "exact_match", 1.0, "")]
    m = spark.createDataFrame(data, "match_id long, job_id string, skill_id string, skill_type string, source string, extraction_method string, confidence double, evidence_snippet string")
    assert [r["evidence_snippet"] for r in warehouse.best_matches(m, jobs, skills).collect()] == ["g"]


def test_integrity(spark, w):
    flagged = w.skills.selectExpr("*", "skill_id = 'lang' AS is_category")
    ok = Warehouse(flagged, w.jobs, w.job_skills, w.locations, w.closure, w.companies, w.variants)
    assert integrity_checks(ok).count() == 18
    load_gate(ok)
    bad = Warehouse(flagged.selectExpr("* EXCEPT (is_category)", "skill_id = 'java' AS is_category"), w.jobs.limit(1), w.job_skills, w.locations, w.closure.where("descendant_id <> 'python'"), w.companies, w.variants)
    failed = {r["label"] for r in integrity_checks(bad).where("NOT ok").collect()}
    assert {"key job_skills.job_id", "categories extracted as skills", "skills without a closure row of their own"} <= failed
    with pytest.raises(ValueError, match="categories"):
        load_gate(bad)
