import pytest

from skillspark.operators import packed
from skillspark.operators.packed import split_items, strict_items, unpack
from tests.conftest import rows


@pytest.mark.parametrize("text, want", [
    ("['a', 'b c']", ["a", "b c"]),
    ('["say \\"x\\"", "y"]', ['say "x"', "y"]),
    ("[\"it's\", 'b']", ["it's", "b"]),
    ("['it\\'s']", ["it's"]),
    ("a, b;c | d", ["a", "b", "c", "d"]),
    ("a\nb\r\nc\td", ["a", "b", "c", "d"]),
    ("a||b", ["a", "b"]),
    (",a, , b,", ["a", "b"]),
    ("- a\n- b", ["a", "b"]),
    ("1. a\n2. b", ["a", "b"]),
    ("a / b", ["a", "b"]),
    ("x/y", ["x/y"]),
    ("x/y/z, w", ["x/y/z", "w"]),
    ("a/b/c/d", ["a", "b", "c", "d"]),
    ("/".join(f"v{i}" for i in range(30)), [f"v{i}" for i in range(30)]),
    ('"p, q"; r', ["p, q", "r"]),
    ('24" led, r', ['24" led', "r"]),
    ("[a; b]", ["a", "b"]),
    ("a, a", ["a", "a"]),
    ("a、b，c", ["a", "b", "c"]),
    ("[]", []), ("[ ]", []), ("nan", []), ("", []), (" ", []), (None, []), (",;|", []),
])
def test_notations(text, want):
    assert split_items(text, []) == want


def test_known_values_protect_their_delimiters():
    assert split_items("tcp/ip / x, care, detail", [(0, 6), (12, 24)]) == ["tcp/ip", "x", "care, detail"]
    assert split_items("a,tcp/ip/b", [(2, 8)]) == ["a", "tcp/ip", "b"]
    assert split_items("a/b/tcp/ip/c", [(4, 10)]) == ["a", "b", "tcp/ip", "c"]


def test_strict_items():
    assert strict_items("['a', 'b']") == ["a", "b"]
    assert strict_items("['a', b]") == strict_items("a, b") == strict_items(None) == []


def test_long_text():
    assert len(split_items("x/" * 20_000, [])) == 20_000
    assert len(split_items(", ".join(["x"] * 20_000), [])) == 20_000


def test_dictionary_comes_from_the_lists(spark):
    lists = [(1, "['Care, detail', 'sql']"), (2, "sql, care, detail"), (3, None), (4, "nan"), (5, "x"), (6, "Pay, C&B;sql")]
    names = spark.createDataFrame([("Pay, C&B",), (None,), ("",)], "term string")
    got = unpack(spark.createDataFrame(lists, "row_id long, text string"), names)
    assert rows(got) == [(1, 1, "Care, detail"), (1, 2, "sql"), (2, 1, "sql"), (2, 2, "care, detail"), (5, 1, "x"), (6, 1, "Pay, C&B"), (6, 2, "sql")]


def test_dictionary_in_several_parts_gives_the_same_rows(spark, monkeypatch):
    lists = spark.createDataFrame([(i, f"['A{i}, b', 'p/q{i}', 'sql']") for i in range(20)] + [(100 + i, f"a{i}, b; p/q{i}/sql/x") for i in range(20)], "row_id long, text string")
    want = rows(unpack(lists))
    monkeypatch.setattr(packed, "TERMS_PER_PASS", 7)
    assert rows(unpack(lists)) == want and (100, 2, "p/q0") in want and (100, 1, "a0, b") in want


def test_empty(spark):
    assert rows(unpack(spark.createDataFrame([], "row_id long, text string"))) == []
