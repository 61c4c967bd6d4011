"""Duplicate postings: blocking, fuzzy comparison, groups and one canonical record each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skillspark.functions.text import company_key, norm_text, similar, strip_accents, token_sort
from skillspark.operators.graph import both_ways, link_groups
from skillspark.operators.simjoin import similar_pairs
from skillspark.session import cut_lineage

KEY_LENGTH = 12
TITLE_SIMILARITY, COMPANY_SIMILARITY = 87.5, 88.0
#: Blocks with more different signatures than this are joined by segments, not pair by pair.
MAX_BLOCK = 64


def blocking_key(company: F.Column, title: F.Column) -> F.Column:
    """The first letters of the company's own name, else of the title without accents."""
    return F.substring(F.coalesce(F.nullif(company_key(company), F.lit("")), strip_accents(title)), 1, KEY_LENGTH)


def signatures(records: DataFrame, accents: bool = True) -> DataFrame:
    """records with block, t (sorted title) and c (sorted company key), by which they are compared."""
    title = norm_text("title") if accents else strip_accents("title")
    return (
        records.withColumn("block", blocking_key(F.col("company"), F.col("title")))
        .withColumn("t", token_sort(title))
        .withColumn("c", token_sort(company_key("company")))
    )


def _sized(signed: DataFrame, key: str | None = None) -> DataFrame:
    """Each signature once: block, t, c, large (its block is joined by segments) and, with key, first: the smallest key of its records."""
    sig = signed.groupBy("block", "t", "c").agg(F.min(key).alias("first")) if key else signed.select("block", "t", "c").distinct()
    # counting a column that both sides of the join need lets them share one exchange
    sizes = sig.groupBy("block").agg((F.count("first" if key else "t") > MAX_BLOCK).alias("large"))
    return cut_lineage(sig.join(sizes, "block"))


def _similar(sig: DataFrame) -> DataFrame:
    """Pairs of rows of _sized that mean the same posting, each once: block and all other columns but large, those of the second one with a 2 behind."""
    own = [c for c in sig.columns if c not in ("block", "large")]
    columns = ["block", *own, *(f"{c}2" for c in own)]
    other = lambda x: x.select("block", *(F.col(c).alias(f"{c}2") for c in own))
    ordered = F.struct("t", "c") < F.struct("t2", "c2")
    small, big = sig.where("NOT large").drop("large"), sig.where("large").drop("large")
    same_company = similar(F.col("c"), F.col("c2"), COMPANY_SIMILARITY)
    near = small.join(other(small), "block").where(ordered & similar(F.col("t"), F.col("t2"), TITLE_SIMILARITY) & same_company)
    text = lambda c: big.select("block", F.col(c).alias("text"))
    titles = similar_pairs(text("t"), TITLE_SIMILARITY).select("block", F.col("a").alias("t"), F.col("b").alias("t2"))  # the order of pairs begins with titles
    one_way = similar_pairs(text("c"), COMPANY_SIMILARITY).select("block", F.col("a").alias("c"), F.col("b").alias("c2"))
    companies = one_way.select("block", F.inline(both_ways("c", "c2")))
    # both sides are narrowed before signatures meet: neither one title with many companies nor one company with many titles is paired all with all
    near_both = big.join(titles, ["block", "t"]).join(companies, ["block", "c"])
    far = near_both.where(ordered).join(other(big), ["block", "t2", "c2"])
    return near.select(columns).unionByName(far.select(columns))


def duplicate_signatures(signed: DataFrame) -> DataFrame:
    """(block, t, c, t2, c2): pairs of different signatures that mean the same posting; records of one signature need no pair."""
    return _similar(_sized(signed))


def group_labels(records: DataFrame, key: str = "rec_no", accents: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., dup_group_id) of records: dup_group_id is the smallest key of the duplicate group.

    Every record gets a group; one alone is its own. Keys must be unique. Null
    companies are equal to each other, null titles are empty. Columns in keep
    travel with the signatures and should be narrow.
    """
    signed = cut_lineage(signatures(records.select(key, "title", "company", *keep), accents).select(key, "block", "t", "c", *keep))
    sig = _sized(signed, key)
    groups = link_groups(_similar(sig).select(F.col("first").alias("a"), F.col("first2").alias("b")))
    of_record = signed.join(sig.select("block", "t", "c", "first"), ["block", "t", "c"]).select(key, *keep, "first")
    return of_record.join(groups.withColumnRenamed("node", "first"), "first", "left").select(key, *keep, F.coalesce("group", "first").alias("dup_group_id"))


def assign_groups(records: DataFrame, key: str = "rec_no", accents: bool = True) -> DataFrame:
    """records, all their columns, with the dup_group_id of group_labels."""
    return records.join(group_labels(records, key, accents), key)


def canonical_signs() -> list[Column]:
    """What mark_canonical goes by, as narrow columns: has_labels and text_length."""
    labels = F.coalesce(F.size("extra.skills_given"), F.lit(-1)) > 0
    text = F.length(F.coalesce("requirements_raw", F.lit(""))) + F.length(F.coalesce("description", F.lit("")))
    return [labels.alias("has_labels"), text.alias("text_length")]


def mark_canonical(grouped: DataFrame, key: str = "rec_no") -> DataFrame:
    """grouped with is_canonical: the record with labels, else the most text, else the smallest key. grouped may hold canonical_signs instead of the texts."""
    labels, text = (F.col("has_labels"), F.col("text_length")) if "has_labels" in grouped.columns else canonical_signs()
    order = W.partitionBy("dup_group_id").orderBy(labels.desc(), text.desc(), key)
    return grouped.withColumn("is_canonical", F.row_number().over(order) == 1)


def cross_source_groups(grouped: DataFrame) -> DataFrame:
    """(dup_group_id, n_sources, n_records) of groups that span several sources."""
    by = grouped.groupBy("dup_group_id").agg(F.count_distinct("source").alias("n_sources"), F.count("*").alias("n_records"))
    return by.where("n_sources > 1")
