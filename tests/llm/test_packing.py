import os
import random

import pytest

from skillspark.llm import packing
from tests.conftest import rows

needs_file = pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer file")


@pytest.mark.parametrize("capacity", [1, 7, 100, 1024])
def test_plan_uses_every_item_once(capacity):
    rng = random.Random(capacity)
    hist = {}
    for _ in range(3000):
        x = min(capacity, max(1, int(rng.lognormvariate(4, 1))))
        hist[x] = hist.get(x, 0) + 1
    used = {}
    containers = 0
    for c, n in packing.plan(hist, capacity):
        assert n > 0 and sum(x * k for x, k in c.items()) <= capacity
        containers += n
        for x, k in c.items():
            used[x] = used.get(x, 0) + k * n
    assert used == hist
    total = sum(x * n for x, n in hist.items())
    assert containers <= 1.02 * total / capacity + 2


def test_plan_of_unfillable_lengths():
    assert sum(n for _, n in packing.plan({6: 5}, 10)) == 5
    assert packing.plan({}, 10) == []


@needs_file
def test_pack(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["lương", "work", "x1"]) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    docs += [(1000, "từ " * 30_000), (1001, None), (1002, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'a' AS budget_id")
    b = spark.createDataFrame([(1, 64), (2, 500)], "budget_id int, capacity_tokens int")
    out = rows(packing.pack(d, b))
    counts = dict(rows(packing.token_counts(d)))
    for budget, capacity in ((1, 64), (2, 500)):
        mine = [r for r in out if r[0] == budget]
        fill, parts = {}, {}
        for _, c, doc, no, first, n in mine:
            fill[c] = fill.get(c, 0) + n
            parts.setdefault(doc, []).append((no, first, n))
        assert max(fill.values()) <= capacity and set(fill) == set(range(len(fill)))
        assert set(parts) == set(counts)
        for doc, p in parts.items():
            assert sum(n for _, _, n in p) == counts[doc]
            assert len(p) == 1 or counts[doc] > capacity
            at = 0
            for no, first, n in sorted(p):
                assert first == at
                at += n


@needs_file
def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([(1, 64)], "budget_id int, capacity_tokens int")
    assert rows(packing.pack(d, b)) == []
    assert rows(packing.pack(d, b.limit(0))) == []
