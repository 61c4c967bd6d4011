"""Problem 2: references to records that are absent, deleted or arrive later.

A reference made at time t is sound if the target table holds a row with that
key, loaded not after t and not deleted by t. Targets are first reduced to the
disjoint spans in which a key exists. References are counted per key and
period; the few keys that hold a large share of all rows are answered by a
broadcast of their spans (or, if these are many, by a salted join), the other
keys by a shuffled anti join. The report reduces references to counts per key
and time before either join and adds up the orphan counts of both.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skillspark.session import max_heavy_keys

#: Spans that may be broadcast (about 40 bytes each); beyond it the heavy keys are salted instead.
MAX_BROADCAST_SPANS = 200_000
#: Parts of a heavy key whose spans are too many for a broadcast.
SALTS = 64


@dataclass(frozen=True)
class Reference:
    """One referring column and the table it points to."""

    table: str
    column: str
    row_no: str
    at: str
    target: str
    target_key: str


def existence_spans(targets: DataFrame, key: str, loaded: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """(k, since, till): disjoint half-open spans in which a row with the key exists; till null means for ever.

    Rows without key or loading time, and rows deleted before they were loaded,
    never exist.
    """
    rows = (
        targets.select(F.col(key).alias("k"), F.col(loaded).alias("since"), F.col(deleted).alias("till"))
        .where("k IS NOT NULL AND since IS NOT NULL AND (till IS NULL OR till > since)")
        # repeated rows shrink before the window sees them
        .groupBy("k", "since")
        .agg(F.max("till").alias("till"), F.max(F.col("till").isNull()).alias("open"))
    )
    before = W.partitionBy("k").orderBy("since").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("k").orderBy("since").rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.withColumn("reach", F.max("till").over(before))
        .withColumn("covered", F.coalesce(F.max("open").over(before), F.lit(False)))
        .withColumn("starts", ~F.col("covered") & (F.col("reach").isNull() | (F.col("since") > F.col("reach"))))
        .withColumn("island", F.sum(F.col("starts").cast("int")).over(upto))
        .groupBy("k", "island")
        .agg(F.min("since").alias("since"), F.max("till").alias("t"), F.max("open").alias("open"))
        .select("k", "since", F.when(~F.col("open"), F.col("t")).alias("till"))
    )


def _missing(refs: DataFrame, spans: DataFrame, *by: str) -> DataFrame:
    inside = (F.col("r.at") >= F.col("s.since")) & (F.col("s.till").isNull() | (F.col("r.at") < F.col("s.till")))
    same = reduce(lambda a, b: a & b, [F.col(f"r.{c}") == F.col(f"s.{c}") for c in ("k", *by)])
    return refs.alias("r").join(spans.alias("s"), same & inside, "left_anti")


def heavy_keys(counted: DataFrame, total: int, most: int) -> DataFrame:
    """Keys with more than a most-th of all references (so less than most of them), from counts per key and period."""
    per_key = counted.groupBy("k").agg(F.sum("n").alias("n"))
    return per_key.where(F.col("n") * most > total).select("k")


def _split_missing(refs: DataFrame, spans: DataFrame, heavy: list) -> DataFrame:
    """The rows of refs outside the spans of their key; heavy keys are kept out of the shuffle of the others."""
    if not heavy:
        return _missing(refs, spans)
    is_heavy = F.col("k").isin(heavy)
    hot_refs, hot_spans = refs.where(is_heavy), spans.where(is_heavy)
    if hot_spans.limit(MAX_BROADCAST_SPANS + 1).count() > MAX_BROADCAST_SPANS:
        salted = hot_refs.withColumn("salt", F.pmod(F.xxhash64(*refs.columns), F.lit(SALTS)))
        each = hot_spans.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        hot = _missing(salted, each, "salt").drop("salt")
    else:
        hot = _missing(hot_refs, F.broadcast(hot_spans))
    return hot.unionByName(_missing(refs.where(~is_heavy), spans.where(~is_heavy)))


def orphan_references(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of refs(k, at, ...) whose key does not exist at that time.

    A null key refers to nothing and is left out; a null time finds no row and
    is an orphan. Extra columns of refs are kept. An empty target table makes
    every reference an orphan.
    """
    refs = refs.where("k IS NOT NULL")
    counted = refs.groupBy("k", F.date_trunc("month", "at").alias("period")).agg(F.count("*").alias("n"))
    heavy = heavy_keys(counted, refs.count(), max_heavy_keys(refs.sparkSession)).collect()  # bounded by heavy_keys
    return _split_missing(refs, spans, [r["k"] for r in heavy])


def orphan_counts(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """(period, n_orphans) of refs(k, at) by month, null times under a null period.

    References of one key and time are one row with their number before
    anything is joined, so repeated references cost nothing more.
    """
    reduced = refs.where("k IS NOT NULL").groupBy("k", "at").agg(F.count("*").alias("n"))
    times = reduced.select("k", F.lit(1).alias("n"))
    heavy = heavy_keys(times, times.count(), max_heavy_keys(refs.sparkSession)).collect()  # bounded by heavy_keys
    lost = _split_missing(reduced, spans, [r["k"] for r in heavy])
    return lost.groupBy(F.date_format("at", "yyyy-MM").alias("period")).agg(F.sum("n").alias("n_orphans"))


def find_orphans(source: DataFrame, target: DataFrame, ref: Reference) -> DataFrame:
    """(table_name, column_name, row_no, period) of every orphan reference of one column."""
    refs = source.select(
        F.col(ref.column).alias("k"), F.col(ref.at).alias("at"), F.col(ref.row_no).alias("row_no")
    )
    return orphan_references(refs, existence_spans(target, ref.target_key)).select(
        F.lit(ref.table).alias("table_name"),
        F.lit(ref.column).alias("column_name"),
        "row_no",
        F.date_format("at", "yyyy-MM").alias("period"),
    )


def report_orphans(source: DataFrame, target: DataFrame, ref: Reference) -> DataFrame:
    """(table_name, column_name, period, n_orphans) of one referring column."""
    refs = source.select(F.col(ref.column).alias("k"), F.col(ref.at).alias("at"))
    return orphan_counts(refs, existence_spans(target, ref.target_key)).select(
        F.lit(ref.table).alias("table_name"), F.lit(ref.column).alias("column_name"), "period", "n_orphans"
    )
