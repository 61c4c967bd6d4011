import random

import numpy as np

from skillspark.llm import leakage
from skillspark.llm.leakage import align, fold_words, in_order, leaks
from tests.conftest import rows

A = "The night school in Harrow rents 262 sewing machines for one term and returns 9 before midterm. Supervisor Button insists that every amber card must sit left of its twin unless the bell has rung 6 times."
B = A.replace("262", "718").replace("9 before", "4 before").replace("Harrow", "Windlow").replace("Button", "Magpie").replace("amber", "olive").replace("6 times", "11 times")
ITEMS = [(1, A), (2, B), (3, None), (4, "")]


def find(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    return rows(leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string")))


def test_folding():
    assert fold_words("<b>Tiếng</b> Đức&nbsp;12,5") == ["tieng", "duc", "12", "5"]


def test_alignment_follows_gaps():
    item, doc = np.array([1, 2, 3, 4, 5]), np.array([9, 1, 2, 4, 5, 9])
    assert align(item, np.zeros(5, dtype=bool), doc) == [(0, 1), (1, 2), (3, 3), (4, 4)]
    assert align(item, np.zeros(5, dtype=bool), np.array([], dtype=int)) == []


def test_words_in_order():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b, 1):
                row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
        assert in_order(np.array(b, dtype=np.int64), np.array(a, dtype=np.int64)) == row[-1]


def test_whole_part_and_altered_copies(spark):
    words = A.split()
    whole = "Intro text. " + A.upper() + " More text."
    half = " ".join(words[14:])
    two = " ".join(words[:12]) + " something else stands here now for a while " + " ".join(words[18:])
    altered = A.replace("sewing", "knitting").replace("insists", "claims").replace("school", "shcool")
    markup = "<p>" + "</b> <b>".join(words) + "</p>"
    assert find(spark, [whole, half, two, altered, markup]) == [(i, 1) for i in range(5)]


def test_quotations_and_other_facts_are_no_case(spark):
    other = A.replace("262", "999").replace("9 before", "8 before").replace("Harrow", "Oldquay").replace("Button", "Thistle").replace("amber", "teal").replace("6 times", "31 times")
    assert find(spark, [" ".join(A.split()[:12]), other, "", None, "x " * 100_000]) == []


def test_repeats_and_several_items(spark):
    assert find(spark, [A + " " + B, A, A]) == [(0, 1), (0, 2), (1, 1), (2, 1)]
    twice = spark.createDataFrame([(7, A), (7, A), (None, A)], "doc_id long, text string")
    assert rows(leaks(twice, spark.createDataFrame(ITEMS, "item_id long, text string"))) == [(7, 1)]


def test_shared_wording_and_short_items(spark, monkeypatch):
    twin = [(1, A), (2, B), (5, A.upper()), (6, "Zebra quartz lantern"), (7, "Quokka")]
    end = "Every lodger files the same plain form before supper and keeps one copy behind the kitchen door"
    shared = [(8, "Nine gulls over Fenwick counted the ferries slowly yesterday noon. " + end), (9, "Old brass kettles from Dunmore never whistle twice when snow falls. " + end)]
    docs = spark.createDataFrame(list(enumerate([A, "The zebra quartz lantern stood there.", "A quokka!", "Zebra, then a lantern of quartz.", end])), "doc_id long, text string")
    want = [(0, 1), (0, 5), (1, 6), (2, 7), (4, 8), (4, 9)]
    items = spark.createDataFrame(twin + shared, "item_id long, text string")
    assert rows(leaks(docs, items)) == want
    monkeypatch.setattr(leakage, "MAP_BITS", 64)  # a map that lets everything through changes nothing
    assert rows(leaks(docs, items)) == want


def test_many_items(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}x" for i in range(3_000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(20))) for i in range(20_000)]
    docs = [(k, "before it " + " ".join(items[i][1].split()[:13]) + " and after") for k, i in enumerate(range(0, 20_000, 500))]
    docs.append((99, " ".join(rng.choice(vocabulary) for _ in range(2_000))))
    found = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(found.collect()) == [(k, i) for k, i in enumerate(range(0, 20_000, 500))]


def test_a_seed_in_most_documents_still_counts(spark):
    docs = [(i, "Common start here now. " + (A if i % 2 else f"Nothing {i}.")) for i in range(60)]
    found = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "Common start here now. " + A)], "item_id long, text string"))
    assert sorted(found.collect()) == [(i, 1) for i in range(1, 60, 2)]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(leaks(docs, items)) == []
    assert rows(leaks(spark.createDataFrame([(1, A)], "doc_id long, text string"), items.limit(0))) == []
