import pytest
from pyspark.sql import functions as F

from skillspark.operators import extract, quality
from tests.conftest import rows

SET = "record_id long, source string, skill_id string"


def test_scores(spark):
    gold = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "a", "z"), (2, "a", "z")], SET)
    found = spark.createDataFrame([(1, "a", "x"), (2, "a", "z"), (2, "a", "q")], SET)
    r = quality.extraction_scores(gold, found).first()
    assert (r["tp"], r["fp"], r["fn"]) == (2, 1, 1)
    assert r["precision"] == r["recall"] == pytest.approx(2 / 3) and r["macro_f1"] == pytest.approx(2 / 3)
    r = quality.extraction_scores(gold, found.limit(0)).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)


def test_retrieval(spark):
    ranks = spark.createDataFrame([("a", 1), ("a", 2), ("b", 0)], "kind string, rank int")
    got = {r["kind"]: (r["n"], r["mrr"], r["p_at_1"], r["misses"]) for r in quality.retrieval_scores(ranks).collect()}
    assert got == {"a": (2, 0.75, 0.5, 0), "b": (1, 0.0, 0.0, 1), None: (3, 0.5, pytest.approx(1 / 3), 1)}


def test_masked_evaluation(spark):
    aliases = extract.aliases_of(spark.createDataFrame([("py", "Python", "hard"), ("dk", "Docker", "hard"), ("java", "Java", "hard")], "skill_id string, canonical_name string, skill_type string"))
    data = [(1, "c", "Dev", "Python and Docker", None, ["Python", "Docker"]), (2, "d", "Dev", None, "Python", ["Python", "Java"]), (3, "data_jobs", "Dev", "Python, Docker", None, ["Python", "Docker"]), (4, "c", "x", None, None, [])]
    r = spark.createDataFrame(data, "record_id long, source string, title string, requirements_raw string, description string, labels array<string>")
    got = {x["source"]: (x["tp"], x["fp"], x["fn"]) for x in quality.masked_evaluation(r, aliases).collect()}
    assert got == {"c": (2, 0, 0), "d": (1, 0, 1), "data_jobs": (0, 0, 2)}


def test_masked_evaluation_predicts_fuzzily(spark):
    aliases = extract.aliases_of(spark.createDataFrame([("py", "Python", "hard"), ("ng", "Testng", "hard"), ("pg", "Postgresql", "hard")], "skill_id string, canonical_name string, skill_type string"))
    none = [(k, "v", "Testing", None, None, []) for k in range(10, 20)]  # common over all records only
    data = [(1, "c", "Dev", "Python, posgresql", None, ["Python", "Postgresql"]), (2, "c", "testing", "postgresq1", None, ["Python"]), *none]
    r = spark.createDataFrame(data, "record_id long, source string, title string, requirements_raw string, description string, labels array<string>")
    assert [(x["source"], x["tp"], x["fp"], x["fn"]) for x in quality.masked_evaluation(r, aliases).collect()] == [("c", 2, 1, 1)]
    assert rows(quality.masked_methods(r, aliases)) == [("exact_match", 1, 1, 1.0), ("fuzzy_match", 1, 2, 0.5)]


def test_sample_is_stratified_and_reproducible(spark):
    data = [(s, str(i), "t" * i, None, None) for s in ("a", "b") for i in range(1, 61)] + [("a", "empty", "", None, None)]
    r = spark.createDataFrame(data, "source string, source_id string, title string, requirements_raw string, description string")
    one = rows(quality.sample_tasks(r, per_source=10))
    assert one == rows(quality.sample_tasks(r.repartition(7), per_source=10))
    assert len(one) == 20 and sorted(x[6] for x in one) == list(range(1, 21))
    for s in ("a", "b"):
        bands = [x[3] for x in one if x[1] == s]
        assert sorted(map(bands.count, ("short", "medium", "long"))) == [3, 3, 4]
        assert sum(x[4] == "development" for x in one if x[1] == s) == 3
    assert one != rows(quality.sample_tasks(r, per_source=10, seed=1))


def test_annotations(spark):
    tasks = spark.createDataFrame([("t1", "a", "test"), ("t2", "a", "test")], "task_id string, source string, split string")
    schema = "task_id string, annotator string, status string, skill_ids array<string>, unresolved_terms array<string>"
    skills = spark.createDataFrame([("x",)], "skill_id string")
    bad = spark.createDataFrame([("t1", "me", "complete", ["x"], None), ("t1", " ", "done", ["nope"], None), ("t9", "me", "draft", [], None)], schema)
    assert rows(quality.validate_annotations(tasks, bad, skills)) == [("t1", "bad status"), ("t1", "no annotator"), ("t1", "repeated"), ("t1", "unknown skill"), ("t9", "no such task")]
    good = spark.createDataFrame([("t1", "me", "complete", ["x"], ["New  Tool"])], schema)
    with pytest.raises(ValueError, match="t2"):
        quality.gold_labels(tasks, good)
    gold = quality.gold_labels(tasks, good, complete=False)
    oov = spark.range(1).select(quality.oov_skill_id(F.lit("new tool"))).first()[0]
    assert rows(gold) == [("t1", "a", "test", oov), ("t1", "a", "test", "x")]
    assert tuple(quality.coverage(gold).first()) == (2, 1, 0.5)


def test_fingerprint(spark):
    df = spark.range(100).selectExpr("id", "CAST(id AS string) AS s")
    assert quality.fingerprint(df).first() == quality.fingerprint(df.repartition(5)).first() != quality.fingerprint(df.limit(99)).first()


def test_empty_columns(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    assert rows(quality.empty_columns(df, "t")) == [("t.b",)]


def test_closure_mismatch(spark):
    s = "ancestor_id string, descendant_id string"
    a, b = spark.createDataFrame([("x", "y"), ("x", "z")], s), spark.createDataFrame([("x", "y"), ("y", "z")], s)
    assert rows(quality.closure_mismatch(a, b)) == [("x", "z", "stored"), ("y", "z", "built")]


def test_gold_scores(spark):
    gold = spark.createDataFrame([(1, "a", "x"), (1, "a", "oov:1"), (2, "b", "y")], SET)
    found = spark.createDataFrame([(1, "a", "x"), (2, "b", "z")], SET)
    got = {(r["vocabulary"], r["source"]): (r["tp"], r["fp"], r["fn"], r["macro_f1"]) for r in quality.score_gold(gold, found).collect()}
    assert got["end_to_end", "all"] == (1, 1, 2, pytest.approx(1 / 3)) and got["in_vocabulary", "all"] == (1, 1, 1, 0.5)
    assert got["end_to_end", "a"][:3] == (1, 0, 1) and got["in_vocabulary", "a"][:3] == (1, 0, 0) and len(got) == 6


def test_gold_standard(spark):
    standard = lambda names: quality.gold_standard(spark.createDataFrame([(n,) for n in names], "annotator string"), ("model",)).first()[0]
    assert [standard(x) for x in (["model", "model"], ["model", "me"], [None], [])] == ["llm_assisted_gold", "manual_gold", "manual_gold", "manual_gold"]


def test_frozen_tables(spark):
    tables = {"a": spark.range(10), "b": spark.range(5)}
    frozen = quality.freeze(tables)
    quality.check_frozen(frozen, {"a": tables["a"].repartition(3), "b": tables["b"]})
    with pytest.raises(ValueError, match="b, c"):
        quality.check_frozen(frozen, {"a": tables["a"], "b": spark.range(1, 6), "c": spark.range(1)})


def test_report(spark):
    s = spark.createDataFrame([("a", 1, 0, 1, 1.0, 0.5, 0.6, 0.6)], "source string, tp long, fp long, fn long, precision double, recall double, f1 double, macro_f1 double")
    r = spark.createDataFrame([(None, 2, 0.5, 0.5, 0)], "kind string, n long, mrr double, p_at_1 double, misses long")
    i = spark.createDataFrame([("key x", True, 0)], "label string, ok boolean, n long")
    got = {(x["section"], x["name"], x["metric"]): x["value"] for x in quality.evaluation_report(s, r, i).collect()}
    assert got["extraction", "a", "recall"] == got["retrieval", "all", "mrr"] == 0.5 and got["integrity", "key x", "ok"] == 1.0 and len(got) == 13


def test_length_bands_are_thirds(spark):
    for n in (1, 2, 3, 7, 11):
        df = spark.createDataFrame([("s", str(i).zfill(3), i) for i in range(n)] + [(None, "x", 5)], "source string, source_id string, l int")
        got = [r["length_band"] for r in quality.length_bands(df, F.col("l")).where("source = 's'").orderBy("l").collect()]
        assert got == [("short", "medium", "long")[min(k, 2)] for k, w in enumerate([n // 3 + (j < n % 3) for j in range(3)]) for _ in range(w)]


def test_input_fingerprint(spark):
    import hashlib
    import json

    fields = {"title": 'a "b" \n/ế', "description": None}
    df = spark.createDataFrame([(fields["title"], None)], "title string, description string")
    want = hashlib.sha256(json.dumps(fields, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    assert df.select(quality.input_sha256(["title", "description"])).first()[0] == want
