from skillspark.llm.truncation import _key, in_trie, plain_lines, read_texts, truncated, truncation_report, words
from tests.conftest import rows

SENTENCES = ["Prepare the monthly sales report for the board.", "Answer requests from clients within two days.", "Willing to work shifts in Lisbon.", "Keep the warehouse records in good order."]
SCHEMA = "doc_id long, source string, text string, last string"


def corpus(extra):
    whole = [(i, "feed", " ".join(SENTENCES[(i + k) % 4] for k in range(3)), "") for i in range(40)]
    return whole + [(1000 + i, "cut", t, "") for i, t in enumerate(extra)]


def find(spark, extra):
    d = spark.createDataFrame(corpus(extra), SCHEMA)
    return [i - 1000 for i, _ in rows(truncated(d))]


def test_plain_lines():
    assert plain_lines("<p>One.</p><p>Tw…</p>") == (["One.", "Tw"], True)
    assert plain_lines("a b &nb") == (["a b"], True)
    assert plain_lines("a b [xem thêm]") == (["a b"], True)
    assert plain_lines("") == ([], False)
    assert words("- Có 12 người") == ["<s>", "có", "0", "người"]


def test_breaks_inside_words_and_sentences(spark):
    cut = ["Prepare the monthly sales rep", "Answer requests from clients wi…", "Keep the warehouse records in", "Answer requests from cli<br", "Prepare the monthly sales report for the boar [xem thêm]", "Keep the warehouse\n- Ans"]
    assert find(spark, cut) == list(range(len(cut)))


def test_whole_texts_without_a_full_stop(spark):
    assert find(spark, ["Willing to work shifts in Lisbon", "Answer requests from clients within two days", "Good luck :)", "", None, " ", "<p></p>", "Keep the warehouse records in good order. " * 20_000]) == []


def test_copies_of_a_cut_text_make_no_closing_line(spark):
    copies = [(2000 + i, f"s{i}", "Notes come first\nKeep the warehouse records in", "") for i in range(20)]
    d = spark.createDataFrame(corpus([]) + copies, SCHEMA)
    assert [i for i, _ in rows(truncated(d))] == [i for i, *_ in copies]


def test_closing_lines_of_different_texts(spark):
    first = ["".join("abcdefghij"[int(c)] for c in str(100 + i)) for i in range(20)]
    docs = lambda at, line: [(at + i, f"s{i}", f"Notes {x}\n{line}", "") for i, x in enumerate(first)]
    d = spark.createDataFrame(corpus([]) + docs(2000, "Keep the warehouse records in") + docs(3000, "Answer requests from cli") + docs(4000, "Keep the warehouse records in…") + docs(5000, "Perks: meals, shuttle, etc..."), SCHEMA)
    # excused, unless the line ends inside a word or in a mark of omission
    assert [i for i, _ in rows(truncated(d))] == [*range(3000, 3020), *range(4000, 4020)]


def test_report_counts_every_source(spark):
    d = spark.createDataFrame(corpus(["Prepare the monthly sales rep", "Willing to work shifts in Lisbon."]), SCHEMA)
    assert rows(truncation_report(d, truncated(d))) == [("cut", 2, 1, 0.5), ("feed", 40, 0, 0.0)]


def test_empty(spark):
    assert rows(truncated(spark.createDataFrame([], SCHEMA))) == []


def test_long_words_are_compared_instead_of_tabulated(spark):
    long = "ab" * 50
    vocabulary = spark.createDataFrame([("cat",), ("cats",), (long,), (long + "x",), ("z" * 50_000,)], "word string")
    lasts = spark.createDataFrame([("ca",), ("cat",), ("dog",), (long[:90],), (long,), (long + "xy",), ("z" * 70,), ("cats",), ("cat",)], "last string")
    want = {"ca": (False, True), "cat": (True, True), "cats": (True, False), long[:90]: (False, True), long: (True, True), "z" * 70: (False, True)}
    assert {r["last"]: (r["is_word"], r["leads_on"]) for r in in_trie(lasts, vocabulary).collect()} == want


def test_counts_of_contexts(spark):
    text = "We sell cats. We sell 12 dogs. We sell cats."
    docs = spark.createDataFrame([(1, "s", text), (2, "s", None), (3, "s", ""), (4, None, "We sell")], "doc_id long, source string, text string")
    read = read_texts(docs)
    assert [(r["doc_id"], r["source"], r["last"], r["n_chars"], r["open"]) for r in read.where("is_end").collect()] == [(4, None, "sell", 7, False)]
    got = {}
    for r in read.where("NOT is_end").collect():
        e, m = got.get((r["word"], r["key"]), (0, 0))
        got[r["word"], r["key"]] = (e + r["ends"], m + r["mids"])
    assert got["cats", None] == (2, 0) and got["0", None] == (1, 0) and got["sell", None] == (3, 0)
    assert got[None, _key(1, "cats")] == (2, 0) and got[None, _key(1, "sell")] == (0, 3)
    assert got[None, _key(2, "sell", "cats")] == (2, 0) and got[None, _key(3, "we", "sell", "0")] == (0, 1) and got[None, _key(3, "<s>", "we")] == (0, 3)
    assert got[None, _key(4, "sell", "ca")] == (0, 2) and got[None, _key(4, "<s>", "w")] == (0, 3)
