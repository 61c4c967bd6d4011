"""Problem 9: held-out questions inside the corpus.

Seeds are the word n-grams of the test items, held as a table. One pass over the
corpus keeps, of every document, the n-grams that can be seeds (by a bitmap of
bounded size) with the words around them; an equi join with the seed table
tells whose they are. The seeds that most documents hold cannot start a
candidate alone: a document needs a rarer one of the item. Candidates are
aligned (Smith-Waterman over words, first and second best stretch); altered
words cost little, altered facts much. Facts are numbers and words in whose
place other items have other words. A document gives an item away if the
stretches hold at least half of its words in order and most of the facts within
them agree.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skillspark.session import cut_lineage

#: Words of a seed; different seeds of an item that a document holds; words of a seed of an item without so many.
SEED_WORDS, MIN_SEEDS, SHORT_SEED = 4, 2, 2
#: Part of an item's words that makes a leak; part of the facts in the stretches that must agree.
MIN_COVER, MIN_FACTS = 0.5, 0.6
#: A second stretch has at least so many words.
MIN_STRETCH = 6
MATCH, MISMATCH, FACT_MISMATCH, GAP = 2, -2, -4, -2
#: Bits of the map of seeds (8 MB). With more seeds it lets more other n-grams through, which the join then leaves out.
MAP_BITS = 1 << 26
#: Words whose hashes a task remembers.
MEMORY = 1_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

_TAG = re.compile(r"<[^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_ACCENTS = re.compile("[\u0300-\u036f]+")


def fold_words(text: str) -> list[str]:
    """Words in lower case without accents and markup."""
    t = text
    if "<" in t:
        t = _TAG.sub(" ", t)
    if "&" in t:
        t = html.unescape(t)
    if not t.isascii():
        t = _ACCENTS.sub("", unicodedata.normalize("NFKD", t.lower())).replace("đ", "d")
    return _WORD.findall(t.lower())


class _WordHashes(dict):
    """Hash of a word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, given the hashes of the words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        h = h * _MULTIPLIER + words[j : j + n]
    return h ^ (h >> np.uint64(29))


def _hashed(words: list[str], memory: _WordHashes) -> np.ndarray:
    return np.fromiter((memory[w] for w in words), dtype=np.uint64, count=len(words))


def item_texts(items: DataFrame) -> DataFrame:
    """(text_no, ids, words, facts) of the different texts of items(item_id, text); words are 64-bit hashes.

    A word is a fact if it holds a digit or if other words stand in its place,
    between the same neighbours, in any text.
    """

    @F.pandas_udf("hashes array<long>, digits array<boolean>")
    def folded(texts: pd.Series) -> pd.DataFrame:
        words, memory = [fold_words(t) for t in texts], _WordHashes()
        return pd.DataFrame({"hashes": [_hashed(w, memory).view(np.int64) for w in words], "digits": [[any(c.isdigit() for c in x) for x in w] for w in words]})

    read = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", folded("text").alias("f")).select("item_id", "f.digits", F.col("f.hashes").alias("words"))
    read = read.where(F.size("words") > 0)
    texts = cut_lineage(read.groupBy("words", "digits").agg(F.array_sort(F.collect_set("item_id")).alias("ids")).withColumn("text_no", F.monotonically_increasing_id()))
    at = lambda k: F.coalesce(F.try_element_at("words", k), F.lit(0).cast("long"))
    before = F.when(F.col("k") > 0, at(F.greatest(F.col("k"), F.lit(1)))).otherwise(F.lit(0).cast("long"))
    placed = texts.select("text_no", "words", "digits", F.posexplode("words").alias("k", "x")).select("text_no", "k", "x", F.element_at("digits", F.col("k") + 1).alias("digit"), before.alias("b"), at(F.col("k") + 2).alias("a"))
    places = placed.groupBy("b", "a").agg((F.count_distinct("x") > 1).alias("varies"))
    fact = F.struct("k", (F.col("varies") | F.col("digit")).alias("f"))
    facts = placed.join(places, ["b", "a"]).groupBy("text_no").agg(F.array_sort(F.collect_list(fact)).alias("f")).select("text_no", F.col("f.f").alias("facts"))
    return texts.drop("digits").join(facts, "text_no")


def seed_table(texts: DataFrame) -> DataFrame:
    """(text_no, seed, size, needed): the seeds of every text, and how many different ones a document needs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for no, words in zip(b["text_no"], b["words"]):
                h = np.asarray(words, dtype=np.int64).view(np.uint64)
                size = SEED_WORDS
                seeds = np.unique(gram_hashes(h, size))
                if len(seeds) < MIN_SEEDS:
                    size = min(SHORT_SEED, len(words))
                    seeds = np.unique(gram_hashes(h, size))
                rows += [(no, s, size, min(MIN_SEEDS, len(seeds))) for s in seeds.view(np.int64).tolist()]
            yield pd.DataFrame(rows, columns=["text_no", "seed", "size", "needed"])

    return texts.select("text_no", "words").mapInPandas(run, "text_no long, seed long, size int, needed int")


def _seed_map(seeds: DataFrame) -> np.ndarray:
    """The bitmap of seeds: at most MAP_BITS / 64 rows reach the driver."""
    bit = F.pmod("seed", F.lit(MAP_BITS))
    part = seeds.select((bit.cast("long").bitwiseAND(F.lit(63))).cast("int").alias("low"), F.shiftright(bit, 6).alias("place"))
    rows = part.groupBy("place").agg(F.bit_or(F.expr("shiftleft(1L, low)")).alias("bits")).collect()
    out = np.zeros(MAP_BITS // 64, dtype=np.int64)
    for r in rows:
        out[r["place"]] = r["bits"]
    return out.view(np.uint64)


def seed_hits(documents: DataFrame, bits: np.ndarray, sizes: list[int], needed: int, reach: int) -> DataFrame:
    """(doc_id, seeds, places, at, words) of documents that hold `needed` different n-grams of the map: the n-grams with their places, and the hashes of the words up to `reach` around them with their places."""
    shared = documents.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory, known = _WordHashes(), shared.value
        for b in batches:
            texts = [fold_words(t) for t in b["text"]]
            starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            every = np.concatenate([_hashed(t, memory) for t in texts]) if texts else np.zeros(0, dtype=np.uint64)
            owner = np.repeat(np.arange(len(texts)), np.diff(starts))
            found: dict[int, list[tuple[int, int]]] = {}
            for size in sizes:
                h = gram_hashes(every, size)
                at = h & np.uint64(MAP_BITS - 1)
                hit = np.flatnonzero((known[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))
                hit = hit[owner[hit] == owner[hit + size - 1]]
                for k, s in zip(hit.tolist(), h[hit].view(np.int64).tolist()):
                    found.setdefault(int(owner[k]), []).append((s, k))
            rows = []
            for d, hits in found.items():
                if len({s for s, _ in hits}) < needed:
                    continue
                first = int(starts[d])
                words = every[first : starts[d + 1]].view(np.int64)
                near = np.zeros(len(words), dtype=bool)
                for _, k in hits:
                    near[max(0, k - first - reach) : k - first + reach] = True
                at = np.flatnonzero(near)
                rows.append((b["doc_id"].iloc[d], [s for s, _ in hits], [k - first for _, k in hits], at, words[at]))
            yield pd.DataFrame(rows, columns=["doc_id", "seeds", "places", "at", "words"])

    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select("doc_id", "text")
    return texts.mapInPandas(run, "doc_id long, seeds array<long>, places array<int>, at array<int>, words array<long>")


def align(item: np.ndarray, facts: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """The best local alignment: pairs (place in item, place in doc) in order, matches and mismatches alike."""
    n, m = len(item), len(doc)
    if not n or not m:
        return []
    h = np.zeros((n + 1, m + 1), dtype=np.int32)
    steps = np.arange(1, m + 1, dtype=np.int32) * -GAP
    for i in range(n):
        same = doc == item[i]
        diagonal = h[i, :-1] + np.where(same, MATCH, FACT_MISMATCH if facts[i] else MISMATCH)
        best = np.maximum(np.maximum(diagonal, h[i, 1:] + GAP), 0)
        # gaps in the item: running maximum of best + |GAP| * place
        h[i + 1, 1:] = np.maximum.accumulate(best + steps) - steps
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    out = []
    while i > 0 and j > 0 and h[i, j] > 0:
        same = item[i - 1] == doc[j - 1]
        if h[i, j] == h[i - 1, j - 1] + (MATCH if same else FACT_MISMATCH if facts[i - 1] else MISMATCH):
            i, j = i - 1, j - 1
            out.append((int(i), int(j)))
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def in_order(b: np.ndarray, a: np.ndarray) -> int:
    """Length of the longest common subsequence of b and a, the rows of its table as bits of one number."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    open_ = every
    for x in b.tolist():
        if at := places.get(x):
            met = open_ & at
            open_ = ((open_ + met) | (open_ - met)) & every
    return len(a) - open_.bit_count()


def cover(b: np.ndarray, a: np.ndarray, facts: np.ndarray) -> tuple[float, float]:
    """(part of the item's words a, part of its facts in the stretches) that the words b give."""
    first = align(a, facts, b)
    if not first:
        return 0.0, 0.0
    # the second stretch lies before the first in both texts, or behind it in both
    i0, j0, i1, j1 = first[0][0], first[0][1], first[-1][0] + 1, first[-1][1] + 1
    before = align(a[:i0], facts[:i0], b[:j0])
    behind = [(i + i1, j + j1) for i, j in align(a[i1:], facts[i1:], b[j1:])]
    second = max(before, behind, key=lambda s: sum(a[i] == b[j] for i, j in s))
    stretches = [first, second] if sum(a[i] == b[j] for i, j in second) >= MIN_STRETCH else [first]
    given = np.zeros(len(a), dtype=bool)
    inside = np.zeros(len(a), dtype=bool)
    for s in stretches:
        inside[s[0][0] : s[-1][0] + 1] = True
        for i, j in s:
            given[i] |= a[i] == b[j]
    asked = int((facts & inside).sum())
    return float(given.mean()), float((facts & given).sum() / asked) if asked else 1.0


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the documents(doc_id, text) that give away items(item_id, text).

    Null and empty texts give nothing away, items without words are given away
    by nothing, rows without an id are left out, and of repeated rows one
    counts. Extra columns are ignored.
    """
    texts = cut_lineage(item_texts(items))
    seeds = cut_lineage(seed_table(texts))
    per_size = seeds.groupBy("size").agg(F.min("needed").alias("needed")).collect()  # a row per number of words of a seed
    longest = texts.agg(F.max(F.size("words")).alias("n")).first()["n"] or 0
    sizes = [r["size"] for r in per_size]
    needed = min((r["needed"] for r in per_size), default=1)
    hits = cut_lineage(seed_hits(documents, _seed_map(seeds), sizes, needed, longest + longest // 2))
    each = hits.select("doc_id", F.inline(F.arrays_zip(F.col("seeds").alias("seed"), F.col("places").alias("place"))))
    held = each.groupBy("doc_id", "seed").agg(F.collect_set("place").alias("places"))
    # whoever holds `needed` seeds of a text holds one that is not among its needed - 1 most frequent
    frequency = held.groupBy("seed").agg(F.count("*").alias("df"))
    order = W.partitionBy("text_no").orderBy(F.desc(F.coalesce("df", F.lit(0))), "seed")
    ranked = seeds.join(frequency, "seed", "left").select("text_no", "seed", "needed", (F.row_number().over(order) >= F.col("needed")).alias("rare"))
    pairs = (
        held.join(ranked, "seed")
        .groupBy("doc_id", "text_no", "needed")
        .agg(F.count("*").alias("n"), F.max("rare").alias("rare"), F.flatten(F.collect_list("places")).alias("places"))
        .where("rare AND n >= needed")
        .select("doc_id", "text_no", "places")
    )
    ready = pairs.join(hits.select("doc_id", "at", F.col("words").alias("near")), "doc_id").join(texts, "text_no")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, places, at, near, ids, item, facts in zip(*(b[c] for c in ("doc_id", "places", "at", "near", "ids", "words", "facts"))):
                reach, places = len(item) + len(item) // 2, np.asarray(places, dtype=np.int64)
                edges = np.zeros(len(at) + 1, dtype=np.int32)
                np.add.at(edges, np.searchsorted(at, places - reach), 1)
                np.add.at(edges, np.searchsorted(at, places + reach), -1)
                words = near[np.cumsum(edges[:-1]) > 0]
                # no alignment gives more of an item than the longest run of its words, with gaps, that stands there in order
                if in_order(words, item) < MIN_COVER * len(item):
                    continue
                part, agree = cover(words, item, np.asarray(facts, dtype=bool))
                if part >= MIN_COVER and agree >= MIN_FACTS:
                    out += [(d, i) for i in ids]
            yield pd.DataFrame(out, columns=["doc_id", "item_id"])

    columns = ready.select("doc_id", "places", "at", "near", "ids", "words", "facts")
    return columns.mapInPandas(judge, "doc_id long, item_id long").distinct()


def leak_report(found: DataFrame) -> DataFrame:
    """(item_id, n_docs) of the items that leaked."""
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"))
