"""Exact join of similar texts: similarity = 100 * (1 - edit distance / longer length).

A text with at most k edits keeps at least one of k + 1 segments of its partner
unchanged, moved by at most k places. So the shorter text is indexed under its
segments, the longer asks for its substrings near them, and an equi join finds
every candidate. No pair over the cutoff is lost and no block is compared in
full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice
from math import ceil, floor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillspark.functions.text import similar

_TINY = 1e-9
#: Rows of a frame that Python hands back; a text may have thousands of keys, so frames don't follow the batches read.
FRAME_ROWS = 10_000


def edits(length: int, cutoff: float) -> int:
    """Edits that a pair may have whose longer text has this length."""
    return floor(length * (1 - cutoff / 100) + _TINY)


@lru_cache(10_000)
def segments(length: int, cutoff: float) -> tuple[tuple[int, int], ...]:
    """(start, end) of the segments of a text of this length, one more than edits with its longest partner."""
    longest = floor(length / (cutoff / 100) + _TINY) if cutoff else length
    n = min(max(length, 1), edits(longest, cutoff) + 1)
    return tuple((length * i // n, length * (i + 1) // n) for i in range(n))


def index_keys(text: str, cutoff: float) -> Iterator[str]:
    for i, (x, y) in enumerate(segments(len(text), cutoff)):
        yield f"{len(text)}|{i}|{text[x:y]}"


def probe_keys(text: str, cutoff: float) -> Iterator[str]:
    """Substrings that a shorter text of the right length may have as a segment.

    With k edits in more than k segments, count segments less edits from the left:
    where that first becomes one, segment i is whole and exactly i edits lie before
    it. So it moved by at most i places, and by at most k - i seen from the right.
    """
    n = len(text)
    k = edits(n, cutoff)
    for m in range(ceil(n * cutoff / 100 - _TINY), n + 1):
        parts = segments(m, cutoff)
        for i, (x, y) in enumerate(parts if len(parts) <= k else parts[: k + 1]):
            low, high = (-k, k) if len(parts) <= k else (max(-i, n - m - k + i), min(i, n - m + k - i))
            yield from {f"{m}|{i}|{text[s : s + y - x]}" for s in range(max(0, x + low), min(n - (y - x), x + high) + 1)}


def _pieces(texts: DataFrame, keys: Callable[[str, float], Iterator[str]], cutoff: float) -> DataFrame:
    """texts with each of their keys; Python holds FRAME_ROWS of them, however many a batch or a long text has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = ((block, text, key) for block, text in zip(b["block"], b["text"]) for key in keys(text, cutoff))
            while part := list(islice(rows, FRAME_ROWS)):
                yield pd.DataFrame(part, columns=["block", "text", "piece"])

    return texts.mapInPandas(run, "block string, text string, piece string")


def _index(texts: DataFrame, cutoff: float) -> DataFrame:
    return _pieces(texts, index_keys, cutoff)


def _probe(texts: DataFrame, cutoff: float) -> DataFrame:
    return _pieces(texts, probe_keys, cutoff)


def _plain(texts: DataFrame) -> DataFrame:
    return texts.where("block IS NOT NULL AND text IS NOT NULL").select("block", "text").distinct()


def _meet(short: DataFrame, long: DataFrame, cutoff: float, a: str, b: str) -> DataFrame:
    # the size of the texts is all that the planner knows of their keys, hundreds of times as large: they must never be broadcast, which goes through the driver
    s = _index(short, cutoff).withColumnRenamed("text", a).hint("merge")
    return s.join(_probe(long, cutoff).withColumnRenamed("text", b), ["block", "piece"]).select("block", "a", "b")


def similar_texts(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """(block, a, b): texts a of left and b of right, of the same block, with at least this similarity.

    left and right: columns block and text, made distinct here; nulls pair with nothing.
    """
    one, two = _plain(left), _plain(right)
    found = _meet(one, two, cutoff, "a", "b").unionByName(_meet(two, one, cutoff, "b", "a")).distinct()
    return found.where(similar(F.col("a"), F.col("b"), cutoff))


def similar_pairs(texts: DataFrame, cutoff: float) -> DataFrame:
    """(block, a, b) with a <= b: similar_texts of a table with itself, each pair once and every text with itself."""
    one = _plain(texts)
    met = _meet(one, one, cutoff, "a", "b").where((F.length("a") < F.length("b")) | (F.col("a") <= F.col("b")))
    found = met.select("block", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return found.where(similar(F.col("a"), F.col("b"), cutoff))
