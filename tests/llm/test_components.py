import random

from skillspark.llm.components import connected_components, match_edges, match_groups
from tests.conftest import rows

PAIRS = "pair_no long, left_no long, right_no long, score double, is_match boolean, u string"


def brute(edges):
    group = {}
    for a, b in edges:
        ga, gb = group.get(a, {a}), group.get(b, {b})
        if ga is not gb:
            ga |= gb
            for x in ga:
                group[x] = ga
    return sorted((x, min(g)) for x, g in group.items())


def check(spark, edges):
    df = spark.createDataFrame([(i, a, b, 1.0, True, "x") for i, (a, b) in enumerate(edges)], PAIRS)
    assert [(a, b) for a, b in sorted(map(tuple, match_groups(df).collect()))] == brute(edges)


def test_chain_star_and_random(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(200, 260)]
    noise = [(rng.randrange(300, 380), rng.randrange(300, 380)) for _ in range(60)]
    check(spark, chain + star + [e for e in noise if e[0] != e[1]])


def test_nulls_self_pairs_repeats_and_directions(spark):
    data = [(1, 1, 2, None, True, ""), (2, 2, 1, 0.5, True, ""), (3, 3, 3, 0.5, True, ""), (4, 4, 5, 0.5, None, ""), (5, 6, 7, 0.5, False, ""), (6, None, 9, 0.5, True, ""), (7, 2, 8, 0.1, True, None)]
    assert rows(match_groups(spark.createDataFrame(data, PAIRS))) == [(1, 1), (2, 1), (8, 1)]


def test_contradicting_rows_link(spark):
    data = [(1, 1, 2, 0.9, True, ""), (2, 1, 2, 0.2, False, "")]
    assert rows(match_groups(spark.createDataFrame(data, PAIRS))) == [(1, 1), (2, 1)]


def test_empty(spark):
    empty = spark.createDataFrame([], PAIRS)
    assert match_groups(empty).columns == ["rec_no", "group_id"]
    assert rows(match_groups(empty)) == []


def test_hot_centre_is_split_from_the_shuffle(spark):
    # one node on all of 30 000 links is beyond the limit for a shuffled key
    edges = spark.range(1, 30_001).selectExpr("id AS left_no", "0L AS right_no", "true AS is_match")
    found = connected_components(match_edges(edges))
    assert found.count() == 30_001
    assert found.where("group_id <> 0").count() == 0
