from skillspark.operators import dictionary as d
from skillspark.operators import hierarchy
from tests.conftest import rows

SKILL = "skill_id string, canonical_name string, skill_type string, aliases array<string>, parent_skill_id string, is_category boolean"


def skills(spark, *names):
    from skillspark.functions.text import slugify

    df = spark.createDataFrame([(n, t, [n.lower(), *a], p, False) for n, t, a, p in names], "canonical_name string, skill_type string, aliases array<string>, parent_skill_id string, is_category boolean")
    return df.select(slugify("canonical_name").alias("skill_id"), *df.columns)


def grouped(spark, names, merges=(), apart=(("c", "c++"), ("c", "c#"), ("java", "javascript"), ("react", "react native"))):
    s = skills(spark, *[(n, "hard", [], None) for n in names])
    pair = "a string, b string"
    g = d.variant_groups(s, spark.createDataFrame(list(merges), pair), spark.createDataFrame(list(apart), pair))
    return s, g, len({r["group"] for r in g.collect()})


def test_mined_names(spark):
    labels = spark.createDataFrame([("python", 1), ("Python", 2), ("python", 3), ("data engineer", 4), ("Teamwork", 5), ("  ", 6), ("sql", 7), ("PYTHON", 8)], "label string, pos long")
    stop = spark.createDataFrame([("Data Engineer",)], "name string")
    soft = spark.createDataFrame([("teamwork",)], "name string")
    assert rows(d.mine_skills(labels, stop, soft)) == [("python", "Python", "hard", ["python"]), ("sql", "sql", "hard", ["sql"]), ("teamwork", "Teamwork", "soft", ["teamwork"])]


def test_entries_join_known_skills(spark):
    base = spark.createDataFrame([("english", "ENGLISH", "hard", ["english", "tiếng anh"])], "skill_id string, canonical_name string, skill_type string, aliases array<string>")
    more = spark.createDataFrame([("Tiếng Anh", "soft", ["ielts"]), ("Kubernetes", "hard", ["k8s"])], "canonical_name string, skill_type string, aliases array<string>")
    assert rows(d.add_entries(base, more)) == [("english", "ENGLISH", "hard", ["english", "ielts", "tiếng anh"]), ("kubernetes", "Kubernetes", "hard", ["k8s", "kubernetes"])]


def test_variants(spark):
    assert grouped(spark, ["react", "ReactJS", "node", "node.js", "NodeJS"])[2] == 2
    assert grouped(spark, ["C", "C++", "C#"])[2] == 3
    assert grouped(spark, ["java", "javascript", "react", "react native"])[2] == 4
    assert grouped(spark, ["js", "j"])[2] == 2
    assert grouped(spark, ["mongo", "MongoDB"], merges=[("mongo", "mongodb")])[2] == 1


def test_merge_keeps_parents_straight(spark):
    s = skills(spark, ("react", "hard", ["reactjs.org"], None), ("React JS", "hard", [], "react"), ("Redux", "hard", [], "react-js"))
    pair = spark.createDataFrame([], "a string, b string")
    merged, ids = d.merge_variants(s, d.variant_groups(s, pair, pair))
    assert rows(merged.select("skill_id", "aliases", "parent_skill_id")) == [("react", ["react", "react js", "reactjs.org"], None), ("redux", ["redux"], "react")]
    matches = spark.createDataFrame([(1, "react-js", "fuzzy_match", 1), (1, "react", "exact_match", 2), (1, "redux", "exact_match", 3)], "record_id long, skill_id string, method string, pos int")
    assert rows(d.remap_matches(matches, ids)) == [(1, "react", "exact_match", 2), (1, "redux", "exact_match", 3)]


def test_hierarchy(spark):
    s = skills(spark, ("Python", "hard", [], None), ("Teamwork", "soft", [], None))
    tree = spark.createDataFrame([("python", "Languages"), ("Languages", "IT"), ("nosuch", "IT")], "child string, parent string")
    placed, unknown = d.assign_parents(s, tree, "Soft skills")
    assert rows(placed.select("skill_id", "parent_skill_id", "is_category")) == [("it", None, True), ("languages", "it", True), ("python", "languages", False), ("soft-skills", None, True), ("teamwork", "soft-skills", False)]
    assert rows(unknown) == [("nosuch",)]
    edges = placed.selectExpr("skill_id AS id", "parent_skill_id AS parent")
    assert ("it", "python", 2) in rows(hierarchy.closure(hierarchy.unfold_paths(edges)))


def test_variant_rows(spark):
    s = spark.createDataFrame([("b", ["y", "x"]), ("a", ["z"]), ("c", [])], "skill_id string, aliases array<string>")
    assert rows(d.skill_variants(s)) == [(1, "a", "z"), (2, "b", "x"), (3, "b", "y")]
