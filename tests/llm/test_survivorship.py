import datetime as dt

from skillspark.llm.survivorship import fit_sources, fit_values, is_placeholder, merged_values, statements, survivors, value_votes
from tests.conftest import rows

SCHEMA = "rec_no long, source string, description string, requirements_raw string, extra struct<query: string, province_id: int, skills_given: array<string>>, crawled_at timestamp, group_id string"
GROUPS = "rec_no long, group_id long"
T = dt.datetime


def test_statements():
    assert statements("<ul><li>Đọc sách.</li><li>ĐỌC  SÁCH.</li></ul>") == ["doc sach."]
    assert statements("One thing. Another thi") == ["one thing."]
    assert statements("N/A") == statements("...") == statements(None) == statements("") == []
    assert statements("- A is so.\n- B is so.") == ["a is so.", "b is so."]
    assert len(statements("x y. " * 50_000)) == 1


def test_placeholders():
    assert all(map(is_placeholder, [None, "", " ", "-", "N/A", "null", "unknown", "Đang cập nhật", "<p></p>", "&nbsp;"]))
    assert not is_placeholder("0")


def test_best_row_by_field(spark):
    late, early = T(2025, 2, 1), T(2025, 1, 1)
    data = [
        (1, "a", "Own one. Own two.", "N/A", ("q", None, []), early, "clash"),
        (2, "b", "OWN TWO. Own one.", None, ("-", 5, ["x"]), late, "clash"),
        (3, "a", "Own one. Own one. Own thr", "Needs it.", None, None, "clash"),
        (4, "a", "Alone.", "Alone.", None, None, "clash"),
    ]
    groups = [(1, 1), (2, 1), (3, 1), (9, 1), (4, 4), (8, 4)]
    found = survivors(spark.createDataFrame(data, SCHEMA).drop("group_id"), spark.createDataFrame(groups, GROUPS))
    assert rows(found) == [(1, "description", 2), (1, "extra", 2), (1, "requirements_raw", 3)]


def test_ties_go_to_the_latest_then_the_smallest(spark):
    at = T(2025, 1, 1)
    data = [(5, None, "Same.", None, None, None, ""), (4, "a", "Same.", None, None, at, ""), (3, "a", "Same.", None, None, at, "")]
    found = survivors(spark.createDataFrame(data, SCHEMA).drop("group_id"), spark.createDataFrame([(3, 3), (4, 3), (5, 3)], GROUPS))
    assert rows(found) == [(3, "description", 3)]


def test_empty(spark):
    assert rows(survivors(spark.createDataFrame([], SCHEMA).drop("group_id"), spark.createDataFrame([], GROUPS))) == []


def test_general_remarks_are_told_from_own_statements():
    # statement 1 is repeated by few rows of its groups, statement 2 by most
    counts = [(1, "a", 20.0, 200.0, 0.1), (2, "a", 60.0, 100.0, 0.02), (None, "a", 6000.0, 10000.0, 0.0)]
    general, quality = fit_sources(counts)
    assert general == {1}
    assert 0.5 < quality["a"][0] < 0.7 and quality["a"][1] > 0.85


def test_a_remark_that_all_postings_carry_adds_nothing(spark):
    data, groups = [], []
    for g in range(40):
        base = 10 * g
        data.append((base, "a", f"Task {g} is ours. Duty {g} is ours.", None, None, T(2025, 1, 1), ""))
        data.append((base + 1, "b", f"Task {g} is ours. Share this page. Accept our terms." if g % 4 == 0 else f"Task {g} is ours. Duty {g} is ours. Share this page." if g % 4 == 1 else f"Task {g} is ours. Accept our terms.", None, None, T(2025, 2, 1), ""))
        data.append((base + 2, "b", f"Task {g} is ours. Duty {g} is ours.", None, None, None, ""))
        groups += [(base, base), (base + 1, base), (base + 2, base)]
    found = dict((g, r) for g, f, r in rows(survivors(spark.createDataFrame(data, SCHEMA).drop("group_id"), spark.createDataFrame(groups, GROUPS))))
    assert found == {10 * g: 10 * g + (g % 4 == 1) for g in range(40)}


def test_values_that_the_sources_make_true_are_kept(spark):
    data, groups = [], []
    for g in range(60):
        base = 10 * g
        true = [f"a{g}", f"b{g}", f"c{g}"]
        rows_of = [("good", true), ("good", [x.upper() for x in true[:2]]), ("good", [*true, " "]), ("bad", [true[0], f"wrong{g}"]), ("bad", None), ("bad", [])]
        for k, (source, skills) in enumerate(rows_of):
            data.append((base + k, source, None, None, (None, None, skills), None, "clash"))
            groups.append((base + k, base))
    records, of = spark.createDataFrame(data, SCHEMA), spark.createDataFrame(groups, GROUPS)
    found = {}
    for g, _, v, p in merged_values(records, of).collect():
        assert p >= 0.5
        found.setdefault(g, set()).add(v)
    assert found == {10 * g: {f"a{g}", f"b{g}", f"c{g}"} for g in range(60)}
    quality, share = fit_values(value_votes(records, of))
    # by source: how many true values it gives, how few false ones
    assert quality["good"][0] > 0.85 and quality["bad"][0] < 0.5 and quality["good"][1] > quality["bad"][1] and 0.6 < share < 0.95


def test_merged_values_of_empty_tables(spark):
    assert rows(merged_values(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], GROUPS))) == []
    alone = spark.createDataFrame([(1, None, None, None, (None, None, ["x", None, "X "]), None, "")], SCHEMA)
    assert [r[2] for r in merged_values(alone, spark.createDataFrame([(1, 1)], GROUPS)).collect()] == ["x"]
