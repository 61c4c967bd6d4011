import datetime as dt
import random

import pytest

from skillspark.operators.hierarchy import closure, latest_parents, unfold, unfold_paths
from tests.conftest import rows

EDGES = "id string, parent string"


def brute(parent):
    out = []
    below = {x: 0 for x in parent}
    for x in parent:
        trail, at = [x], x
        while parent[at] is not None and parent[at] not in trail:
            at = parent[at]
            trail.append(at)
        for a in trail[1:]:
            below[a] += 1
        again = parent[at]
        if again is None:
            path = trail[::-1]
            out.append((x, path[0], len(path) - 1, " > ".join(path), 0))
        else:
            k = trail.index(again)
            path = trail[: k + 1][::-1]
            out.append((x, min(trail[k:]), k, " > ".join(path), 1))
    return sorted((a, b, c, d, below[a], e) for a, b, c, d, e in out)


def test_random_forests_with_circles(spark):
    rng = random.Random(7)
    ids = [f"n{i:03d}" for i in range(150)]
    parent = {x: (None if rng.random() < 0.15 else rng.choice(ids)) for x in ids}
    parent |= {"self": "self", "below": "self", "p": "q", "q": "r", "r": "p", "lone": None}
    got = unfold(spark.createDataFrame(list(parent.items()), EDGES))
    assert sorted(map(tuple, got.collect())) == brute(parent)


def test_deep_chain(spark):
    parent = {f"c{i:02d}": f"c{i - 1:02d}" if i else None for i in range(12)}
    got = sorted(map(tuple, unfold(spark.createDataFrame(list(parent.items()), EDGES)).collect()))
    assert got == brute(parent)
    with pytest.raises(RuntimeError):
        unfold(spark.createDataFrame(list(parent.items()), EDGES), max_depth=3)


def test_latest_row_counts(spark):
    at = [dt.datetime(2025, m, 1) for m in (1, 2, 3)]
    data = [("a", "b", at[0], 1), ("a", "c", at[2], 1), ("a", "d", None, 1), ("b", "", at[1], 1), ("c", "gone", at[1], 1), (None, "a", at[1], 1), ("e", "a", at[1], 1), ("e", "b", at[1], 1)]
    got = latest_parents(spark.createDataFrame(data, "skill_id string, parent_skill_id string, loaded_at timestamp, kid int"))
    assert rows(got) == [("a", "c"), ("b", None), ("c", None), ("e", "b")]


def test_closure(spark):
    got = closure(unfold_paths(spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], EDGES)))
    assert rows(got) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("b", "b", 0), ("b", "c", 1), ("c", "c", 0)]


def test_empty(spark):
    assert rows(unfold(spark.createDataFrame([], EDGES))) == []


def test_closure_of_ids_that_hold_the_separator(spark):
    got = closure(unfold_paths(spark.createDataFrame([("a > b", None), ("c", "a > b")], EDGES)))
    assert rows(got) == [("a > b", "a > b", 0), ("a > b", "c", 1), ("c", "c", 0)]
