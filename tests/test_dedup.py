import random
import re

import pandas as pd
from pyspark.sql import functions as F

from skillspark.operators import dedup, graph, simjoin
from skillspark.operators.graph import link_groups
from skillspark.operators.simjoin import similar_texts
from skillspark.plans import pipeline
from tests.conftest import rows

SCHEMA = "rec_no long, source string, title string, company string, requirements_raw string, description string, extra struct<skills_given: array<string>>"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_similarity_join_loses_no_pair(spark):
    rng = random.Random(5)
    base = ["senior backend engineer", "kế toán tổng hợp", "data analyst", "ab", "a", ""]
    texts = set()
    for _ in range(250):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randrange(2)] = [rng.choice("abế ")] * rng.randrange(2)
        texts.add("".join(t))
    df = spark.createDataFrame([("x", t) for t in texts], "block string, text string")
    for cutoff in (87.5, 70.0):
        want = {(a, b) for a in texts for b in texts if distance(a, b) <= (1 - cutoff / 100) * max(len(a), len(b)) + 1e-9}
        assert {(a, b) for _, a, b in similar_texts(df, df, cutoff).collect()} == want


def test_groups_and_canonical(spark):
    data = [
        (1, "a", "Senior Backend Engineer", "Công ty TNHH ABC", "long text here", None, None),
        (2, "c", "Senior Backend Engineer", "ABC", None, None, (["Python"],)),
        (3, "c", "Senior Frontend Engineer", "ABC", None, None, None),
        (4, "a", "Kế toán tổng hợp", None, None, None, None),
        (5, "b", "Kế toán tổng hợp ", None, None, "x", None),
        (6, "b", None, None, None, None, None),
    ]
    grouped = dedup.assign_groups(spark.createDataFrame(data, SCHEMA)).cache()
    assert rows(grouped.select("rec_no", "dup_group_id")) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 6)]
    assert rows(dedup.mark_canonical(grouped).where("is_canonical").select("rec_no")) == [(2,), (3,), (5,), (6,)]
    assert rows(dedup.cross_source_groups(grouped)) == [(1, 2, 2), (4, 2, 2)]


def test_large_blocks_give_the_same_pairs(spark, monkeypatch):
    rng = random.Random(2)
    titles = [f"{rng.choice(['Senior', 'Junior', 'Lead'])} {rng.choice(['Backend', 'Frontend', 'Data'])} {rng.choice(['Engineer', 'Enginer', 'Analyst'])} {rng.randrange(30)}" for _ in range(150)]
    df = spark.createDataFrame([(i, "a", t, "ABC", None, None, None) for i, t in enumerate(titles)], SCHEMA)
    signed = dedup.signatures(df)
    by_segment = rows(dedup.duplicate_signatures(signed))
    monkeypatch.setattr(dedup, "MAX_BLOCK", 10_000)
    assert by_segment == rows(dedup.duplicate_signatures(signed)) and by_segment


def test_blocking_key(spark):
    df = spark.createDataFrame([("Kế toán tổng hợp", None), ("x", "Công ty Cổ phần Hoa Sen Việt Nam")], "title string, company string")
    assert [r[0] for r in df.select(dedup.blocking_key(F.col("company"), F.col("title"))).collect()] == ["ke toan tong", "hoa sen viet"]


def test_one_title_with_many_companies(spark, monkeypatch):
    rng = random.Random(4)
    companies = ["Công ty Minh Khang Phát " + "".join(rng.choice("abcdefg") for _ in range(9)) for _ in range(60)]
    companies += [c[:-1] + "x" for c in companies[:30]]
    df = spark.createDataFrame([(i, "a", "Kế toán", c, None, None, None) for i, c in enumerate(companies)], SCHEMA)
    signed = dedup.signatures(df)
    by_segment = rows(dedup.duplicate_signatures(signed))
    monkeypatch.setattr(dedup, "MAX_BLOCK", 10_000)
    assert by_segment == rows(dedup.duplicate_signatures(signed)) and len(by_segment) >= 30


def test_links(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (4, 4), (None, 1)] + [(i, i + 1) for i in range(100, 140)], "a long, b long")
    assert rows(link_groups(edges)) == sorted([(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)] + [(i, 100) for i in range(100, 141)], key=lambda t: tuple((True, str(x)) for x in t))
    assert rows(link_groups(edges.limit(0))) == []


def test_random_links_by_brute_force(spark):
    rng = random.Random(9)
    nodes = [f"n{i:03}" for i in range(300)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(230)]
    group = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    got = dict(link_groups(spark.createDataFrame(edges, "a string, b string")).collect())
    assert got == group


def test_a_long_chain_and_a_large_star_settle(spark):
    ids = list(range(3_000))
    random.Random(1).shuffle(ids)
    chain = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    star = spark.range(10_001, 60_000).select(F.lit(10_000).cast("long").alias("a"), F.col("id").alias("b"))
    labels = link_groups(chain.unionByName(star), max_rounds=40)
    assert rows(labels.groupBy("group").count()) == [(0, 3_000), (10_000, 50_000)]
    # the estimate of the size does not grow from round to round
    assert int(str(labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length() < 300


def test_empty(spark):
    assert rows(dedup.assign_groups(spark.createDataFrame([], SCHEMA)).select("rec_no")) == []


def test_frames_of_keys_stay_small():
    class Texts:
        def mapInPandas(self, run, schema):
            long = "".join(random.Random(3).choices("abcdefgh ", k=400))
            return run(iter([pd.DataFrame({"block": ["x"] * 2_001, "text": [long] + ["senior backend engineer for a bank in ho chi minh city"] * 2_000})]))

    for pieces in (simjoin._index, simjoin._probe):
        assert max(map(len, pieces(Texts(), 87.5))) <= 20_000


def test_pairs_of_a_table_with_itself(spark):
    rng = random.Random(8)
    texts = {"".join(rng.choices("abế ", k=rng.randrange(14))) for _ in range(120)}
    df = spark.createDataFrame([("x", t) for t in texts] + [("y", "abc"), (None, "abc"), ("y", None)], "block string, text string")
    for cutoff in (87.5, 70.0, 45.0):
        both = {tuple(r) for r in similar_texts(df, df, cutoff).collect()}
        assert sorted(map(tuple, simjoin.similar_pairs(df, cutoff).collect())) == sorted(p for p in both if p[1] <= p[2])


def _frames_of(query, spark, tmp_path, monkeypatch):
    """The longest frame that Python makes of a batch of long texts, anywhere in a query."""
    made = []
    kind = type(spark.range(1))
    plain = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda self, run, *a, **k: made.append(run) or plain(self, run, *a, **k))
    spark.createDataFrame([(1, "a", "Kế toán", "ABC", None, None, None), (2, "b", "Kế toán", "ABC", "x", None, None)], SCHEMA).write.parquet(f"{tmp_path}/job_records.parquet")
    pipeline.queries()[query](spark, str(tmp_path))
    batch = pd.DataFrame({"block": ["x"] * 300, "text": ["chuyên viên kế toán tổng hợp cấp cao ngành gỗ và chuỗi nhà hàng tại hà nội"] * 300})
    return max(len(frame) for run in made for frame in run(iter([batch])))


def test_frames_of_pairs_with_accents(spark, tmp_path, monkeypatch):
    assert _frames_of("j11_duplicate_pairs_accents", spark, tmp_path, monkeypatch) <= 10_000


def test_frames_of_groups(spark, tmp_path, monkeypatch):
    assert _frames_of("m5_duplicate_groups", spark, tmp_path, monkeypatch) <= 10_000


def test_frames_of_canonical_records(spark, tmp_path, monkeypatch):
    assert _frames_of("a14_canonical_records", spark, tmp_path, monkeypatch) <= 10_000


def test_frames_of_cross_source_groups(spark, tmp_path, monkeypatch):
    assert _frames_of("a23_cross_source_groups", spark, tmp_path, monkeypatch) <= 10_000


def _broadcasts_of_keys(df):
    """Broadcast joins in the final plan of a table that has been read, of which a side comes from Python without an exchange between."""
    plan = df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    found, lines = [], plan.splitlines()
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = line.index("Broadcast")
            for below in lines[i + 1 :]:
                name = re.search("[A-Za-z]", below)
                if not name or name.start() <= depth or "ShuffleQueryStage" in below:
                    break
                if "MapInPandas" in below:
                    found.append(below)
    return found


def test_keys_are_never_broadcast(spark):
    texts = spark.createDataFrame([("x", f"senior backend engineer {i % 40}") for i in range(80)], "block string, text string")
    for pairs in (simjoin.similar_pairs(texts, 87.5), similar_texts(texts, texts, 87.5)):
        assert pairs.collect()
        assert _broadcasts_of_keys(pairs) == []


def _keys_broadcast_by(query, spark, tmp_path, monkeypatch):
    """Broadcasts of keys in any plan that a query writes or returns, its table having one large block."""
    done = []
    cut = dedup.cut_lineage
    for module in (dedup, graph):
        monkeypatch.setattr(module, "cut_lineage", lambda df: done.append(df) or cut(df))
    monkeypatch.setattr(dedup, "MAX_BLOCK", 4)
    titles = [f"Kỹ sư phần mềm cấp cao {i}" for i in range(12)]
    spark.createDataFrame([(i, "ab"[i % 2], t, "ABC", None, None, None) for i, t in enumerate(titles)], SCHEMA).write.parquet(f"{tmp_path}/job_records.parquet")
    out = pipeline.queries()[query](spark, str(tmp_path))
    assert out.collect()
    for df in done:
        df.collect()  # a plan is final once it has run
    return [x for df in [*done, out] for x in _broadcasts_of_keys(df)]


def test_pairs_with_accents_broadcast_no_keys(spark, tmp_path, monkeypatch):
    assert _keys_broadcast_by("j11_duplicate_pairs_accents", spark, tmp_path, monkeypatch) == []


def test_groups_broadcast_no_keys(spark, tmp_path, monkeypatch):
    assert _keys_broadcast_by("m5_duplicate_groups", spark, tmp_path, monkeypatch) == []


def test_canonical_records_broadcast_no_keys(spark, tmp_path, monkeypatch):
    assert _keys_broadcast_by("a14_canonical_records", spark, tmp_path, monkeypatch) == []


def test_cross_source_groups_broadcast_no_keys(spark, tmp_path, monkeypatch):
    assert _keys_broadcast_by("a23_cross_source_groups", spark, tmp_path, monkeypatch) == []
