"""Problem 8: containers of fixed capacity filled with documents of varying length.

Only the histogram of lengths matters for the plan, and it has at most as many
entries as the capacity. Shallow combinations of lengths that fill a container
up to a small slack are the columns of a non-negative least squares problem:
how often must each be repeated to use up the histogram? The rounded repeats
are packed, and the rest is packed greedily, largest first, again as
combinations with repeats. Documents then take the places planned for their
length by their rank within it, which is counted in buckets, so that no length
has to be sorted in one task.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skillspark.session import cut_lineage

#: Place of the public tokenizer's ranks; a parameter, never copied.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Part of a container that a planned combination may leave empty.
SLACK = 0.002
#: Combinations tried per length, lengths tried as partners, sweeps of the solver.
COLUMNS_PER_LENGTH, PARTNERS, SWEEPS = 6, 12, 25
#: Container sizes of one call: a small fixed table.
MAX_BUDGETS = 100
#: Ranks within a length are counted in buckets of about so many pieces at most, however many have that length.
BUCKET_ROWS = 200_000


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens); null and empty texts have none."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(tokenizer)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(e.encode_ordinary(t)) if t else 0 for t in b["text"]]})

    return documents.select("doc_id", "text").mapInPandas(count, "doc_id long, n_tokens long")


def pieces(counts: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, capacity, doc_id, piece_no, first_token, n_tokens): a document is cut only where it exceeds the capacity."""
    fixed = budgets.where("capacity_tokens > 0").select("budget_id", "capacity_tokens").limit(MAX_BUDGETS + 1).collect()
    if len(fixed) > MAX_BUDGETS:
        raise ValueError(f"more than {MAX_BUDGETS} budgets")
    sizes = [F.struct(F.lit(r[0]).alias("budget_id"), F.lit(r[1]).cast("long").alias("capacity")) for r in fixed]
    each = counts.select("doc_id", "n_tokens", F.inline(F.array(*sizes))) if sizes else counts.limit(0).selectExpr("doc_id", "n_tokens", "0 AS budget_id", "0L AS capacity")
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")) - 1, F.lit(0)).cast("long"))
    return each.select("budget_id", "capacity", "doc_id", "n_tokens", F.explode(cuts).alias("piece_no")).select(
        "budget_id", "capacity", "doc_id",
        F.col("piece_no").cast("int").alias("piece_no"),
        (F.col("piece_no") * F.col("capacity")).alias("first_token"),
        F.least("capacity", F.col("n_tokens") - F.col("piece_no") * F.col("capacity")).alias("n_tokens"),
    )


def columns(hist: dict[int, int], capacity: int) -> list[dict[int, int]]:
    """Combinations of at most three different lengths that fill a container up to the slack."""
    lengths = sorted(hist)
    least = capacity - max(0, int(capacity * SLACK))
    common = sorted(lengths, key=lambda x: -hist[x] * x)[:PARTNERS]
    found: list[dict[int, int]] = []
    seen: set[tuple] = set()

    def add(*parts: tuple[int, int]) -> bool:
        c: dict[int, int] = {}
        for length, times in parts:
            if times:
                c[length] = c.get(length, 0) + times
        key = tuple(sorted(c.items()))
        if least <= sum(x * n for x, n in c.items()) <= capacity and key not in seen:
            seen.add(key)
            found.append(c)
            return True
        return False

    for a in lengths:
        got = 0
        most = capacity // a
        for times in range(most, max(0, most - 4), -1):
            rest = capacity - a * times
            got += add((a, times))
            k = bisect_right(lengths, rest) - 1  # the longest that still fits
            if k >= 0:
                got += add((a, times), (lengths[k], rest // lengths[k]))
                got += add((a, times), (lengths[k], 1))
            for b in common:
                if got >= COLUMNS_PER_LENGTH:
                    break
                if b <= rest:
                    n = rest // b
                    left = rest - b * n
                    j = bisect_right(lengths, left) - 1
                    got += add((a, times), (b, n), (lengths[j], 1)) if j >= 0 else add((a, times), (b, n))
            if got >= COLUMNS_PER_LENGTH:
                break
    return found


def least_squares(cols: list[dict[int, int]], hist: dict[int, int]) -> np.ndarray:
    """Non-negative repeats of the columns that come closest to the histogram, by coordinate descent."""
    place = {x: i for i, x in enumerate(hist)}
    rest = np.array([hist[x] for x in place], dtype=float)
    at = [np.array([place[x] for x in c]) for c in cols]
    by = [np.array(list(c.values()), dtype=float) for c in cols]
    norm = [float(b @ b) for b in by]
    x = np.zeros(len(cols))
    for _ in range(SWEEPS):
        moved = 0.0
        for k in range(len(cols)):
            step = max(-x[k], float(by[k] @ rest[at[k]]) / norm[k])
            if abs(step) > 1e-3:
                x[k] += step
                rest[at[k]] -= step * by[k]
                moved = max(moved, abs(step))
        if moved < 0.05:
            break
    return x


def plan(hist: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations with their repeats that use up the histogram exactly; lengths lie between 1 and the capacity."""
    left = {x: n for x, n in hist.items() if n > 0}
    out: list[tuple[dict[int, int], int]] = []

    def use(c: dict[int, int], repeats: int) -> None:
        out.append((c, repeats))
        for x, n in c.items():
            left[x] -= n * repeats
            if not left[x]:
                del left[x]

    if capacity in left:
        use({capacity: 1}, left[capacity])
    cols = columns(left, capacity)
    wanted = least_squares(cols, left) if cols else []
    for k in np.argsort(wanted)[::-1] if len(cols) else ():
        repeats = min(int(wanted[k]), *(left.get(x, 0) // n for x, n in cols[k].items()))
        if repeats > 0:
            use(cols[k], repeats)
    lengths = sorted(left)
    while lengths:
        c: dict[int, int] = {}
        room = capacity
        while (k := bisect_right(lengths, room) - 1) >= 0:
            # the longest that fits; what is used up by this container is passed over
            while k >= 0 and left[lengths[k]] - c.get(lengths[k], 0) <= 0:
                k -= 1
            if k < 0:
                break
            x = lengths[k]
            n = min(left[x] - c.get(x, 0), room // x)
            c[x] = c.get(x, 0) + n
            room -= x * n
        use(c, min(left[x] // n for x, n in c.items()))
        lengths = [x for x in lengths if x in left]
    return out


def slots(planned: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Length -> (first rank, number in a container, first container) of its places, by rank."""
    places: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    container = 0
    for c, repeats in planned:
        for x, n in c.items():
            places.setdefault(x, []).append((ranks.get(x, 0), n, container))
            ranks[x] = ranks.get(x, 0) + n * repeats
        container += repeats
    return {x: tuple(np.array(v, dtype=np.int64) for v in zip(*p)) for x, p in places.items()}


def pack(documents: DataFrame, budgets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(budget_id, container_id, doc_id, piece_no, first_token, n_tokens): a container for every piece of every document.

    documents(doc_id, text) with unique ids; budgets(budget_id, capacity_tokens).
    Documents without tokens lie in container 0. An empty table gives no rows.
    Containers of a budget are numbered from 0; their tokens never exceed its
    capacity.
    """
    cut = cut_lineage(pieces(cut_lineage(token_counts(documents, tokenizer)), budgets))
    counted = cut.groupBy("budget_id", "capacity", "n_tokens").agg(F.count("*").alias("n"))
    hists: dict[tuple[int, int], dict[int, int]] = {}
    for r in counted.where("n_tokens > 0").collect():  # at most one row per token of capacity
        hists.setdefault((r["budget_id"], r["capacity"]), {})[r["n_tokens"]] = r["n"]
    places = {b: slots(plan(h, c)) for (b, c), h in hists.items()}

    # even if all pieces have one length, a bucket of it stays small
    n_buckets = max(1, -(-sum(sum(h.values()) for h in hists.values()) // BUCKET_ROWS))
    bucket = cut.where("n_tokens > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(n_buckets)).cast("int"))
    sizes = bucket.groupBy("budget_id", "n_tokens", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("budget_id", "n_tokens").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("budget_id", "n_tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("budget_id", "n_tokens", "bucket").orderBy("doc_id", "piece_no")
    ranked = bucket.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["budget_id", "n_tokens", "bucket"])

    @F.pandas_udf("long")
    def container(budget: pd.Series, length: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(rank), dtype=np.int64)
        keys = pd.DataFrame({"b": budget.to_numpy(), "x": length.to_numpy()})
        for (b, x), rows in keys.groupby(["b", "x"]).indices.items():
            first, n, base = places[b][x]
            r = rank.to_numpy()[rows]
            k = np.searchsorted(first, r, side="right") - 1
            out[rows] = base[k] + (r - first[k]) // n[k]
        return pd.Series(out)

    rest = ("doc_id", "piece_no", "first_token", "n_tokens")
    placed = ranked.select("budget_id", container("budget_id", "n_tokens", F.col("rank") + F.col("start")).alias("container_id"), *rest)
    empty = cut.where("n_tokens = 0").select("budget_id", F.lit(0).cast("long").alias("container_id"), *rest)
    return placed.unionByName(empty)


def fill_report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, capacity_tokens, n_containers, least_containers, n_tokens, fill) by budget."""
    used = packed.groupBy("budget_id").agg((F.max("container_id") + 1).alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return used.join(F.broadcast(budgets.select("budget_id", "capacity_tokens")), "budget_id").select(
        "budget_id", "capacity_tokens", "n_containers",
        F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"),
        "n_tokens",
        (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill"),
    )


def packing_faults(packed: DataFrame, counts: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, n_documents, overfull, cut_needlessly, incomplete, well_filled): what must hold for any packing of counts(doc_id, n_tokens).

    overfull: containers above the capacity; cut_needlessly: documents in
    several pieces that would fit one container; incomplete: documents whose
    pieces are not exactly their tokens; well_filled: at most one container and
    half a percent more than the least number.
    """
    sizes = F.broadcast(budgets.select("budget_id", "capacity_tokens"))  # MAX_BUDGETS at most
    full = packed.groupBy("budget_id", "container_id").agg(F.sum("n_tokens").alias("n")).join(sizes, "budget_id")
    overfull = full.groupBy("budget_id").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("overfull"))
    docs = packed.groupBy("budget_id", "doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("till"), F.count("*").alias("pieces"))
    docs = docs.join(sizes, "budget_id").join(counts.select("doc_id", F.col("n_tokens").alias("whole")), "doc_id", "left")
    complete = (F.col("n") == F.col("whole")) & (F.col("till") == F.col("whole"))
    by_doc = docs.groupBy("budget_id").agg(
        F.count("*").alias("n_documents"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity_tokens"))).alias("cut_needlessly"), F.count_if(~F.coalesce(complete, F.lit(False))).alias("incomplete")
    )
    filled = fill_report(packed, budgets).select("budget_id", (F.col("n_containers") <= F.col("least_containers") * 1.005 + 1).alias("well_filled"))
    return by_doc.join(overfull, "budget_id").join(filled, "budget_id").select("budget_id", "n_documents", "overfull", "cut_needlessly", "incomplete", "well_filled")
