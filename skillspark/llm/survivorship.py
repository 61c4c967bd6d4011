"""Problem 4: the record whose value survives, field by field, in a group of duplicates.

A text field is a list of statements. A latent two-sided quality model tells
the posting's own statements from the portal's general remarks: each source has
a sensitivity (how often it gives an own statement of the posting) and a
specificity (how seldom it gives a remark that another row of the group gives),
found by expectation-maximisation over the statements. All statements judged
own are kept, and the row with most of them survives.

Only statements in at least GENERAL_SHARE of all filled values can be general
remarks, so at most statements-per-value / GENERAL_SHARE of them are candidates:
their counts, one row per candidate and source, are what the driver sees.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillspark.functions.text import strip_accents
from skillspark.session import cut_lineage

TEXT_FIELDS = ("description", "requirements_raw")
#: A statement in fewer than this share of filled values is never a general remark.
GENERAL_SHARE = 0.005
#: Nor one in fewer values than this, however small the table.
GENERAL_VALUES = 5
#: At this share a statement is as likely own as general before the rows of its groups are looked at.
EVEN_SHARE = 0.02
#: Placeholders (fixed values, compared folded, without end marks).
PLACEHOLDERS = frozenset((
    "", "n/a", "na", "none", "null", "nan", "nil", "tbd", "tba", "updating", "update", "unknown", "see above", "see below", "xem mo ta", "xem mo ta cong viec", "khong co", "khong", "khong ro", "chua ro", "dang cap nhat", "chua cap nhat", "chi tiet trao doi khi phong van", "trao doi khi phong van", "lien he", "?", "x", "undefined", "not available", "not specified",
))

_TAG = re.compile(r"<[^<>]*>")
_BREAK = re.compile(r"(?<=[.!?…])\s+|[\n\r]+")
_MARK = re.compile(r"^[\s\-–—*•·+▪◦●■➢>]+|^\(?\d{1,2}[.)]\s+")
_BLANK = re.compile(r"\s+")


def fold(text: str) -> str:
    """Lower case without accents, blanks collapsed."""
    t = unicodedata.normalize("NFKD", text).lower().replace("đ", "d")
    return _BLANK.sub(" ", "".join(c for c in t if not unicodedata.combining(c))).strip()


def is_placeholder(text: str | None) -> bool:
    """Whether a value says nothing: null, blank, signs only or a placeholder word."""
    if text is None:
        return True
    t = fold(html.unescape(_TAG.sub(" ", text))).rstrip(" .!…:")
    return t in PLACEHOLDERS or not any(c.isalnum() for c in t)


def _statement(part: str) -> str:
    """One part of a text folded and without list marks; empty if it says nothing."""
    t = _MARK.sub("", fold(part))
    return "" if is_placeholder(t) else t


def parts(text: str | None) -> list[str]:
    """The parts of a text as they stand; a last one without end mark is a torn-off piece and left out."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub("\n", text)
    if "&" in text:
        text = html.unescape(text)
    out = _BREAK.split(text.strip())
    if out and out[-1].rstrip()[-1:] not in (".", "!", "?", "…"):
        out.pop()
    return out


def statements(text: str | None) -> list[str]:
    """The folded distinct statements of a text in order."""
    return [p for p in dict.fromkeys(map(_statement, parts(text))) if p]


@lru_cache(maxsize=200_000)
def _claim(part: str) -> int:
    """Hash of a part's statement, 0 if it says nothing."""
    t = _statement(part)
    return xxhash.xxh3_64_intdigest(t) - (1 << 63) if t else 0


@F.pandas_udf(T.StructType([T.StructField(f, T.ArrayType(T.LongType())) for f in TEXT_FIELDS]))
def _claims(first: pd.Series, second: pd.Series) -> pd.DataFrame:
    """The statements of both text fields as hashes."""
    read = lambda texts: [[h for h in dict.fromkeys(map(_claim, parts(t))) if h] for t in texts]
    return pd.DataFrame(dict(zip(TEXT_FIELDS, (read(first), read(second)))))


def _real(value: F.Column) -> F.Column:
    """Whether a short plain value says something, as is_placeholder tells it, but without leaving the JVM."""
    folded = F.regexp_replace(strip_accents(value), r"[ .!:]+$", "")
    return F.coalesce(~folded.isin(*PLACEHOLDERS) & value.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def fit_sources(counts: list[tuple[int | None, str, float, float, float]], rounds: int = 50) -> tuple[set[int], dict[str, tuple[float, float]]]:
    """General remarks and (sensitivity, specificity) by source, by expectation-maximisation.

    counts: (statement, source, k, n, share); k of the n further rows of the
    statement's groups give it too. Statement None stands for all that cannot
    be general.
    """
    by: dict[int | None, list[tuple[str, float, float]]] = {}
    share: dict[int | None, float] = {}
    for s, source, k, n, part in counts:
        by.setdefault(s, []).append((source, k, n))
        share[s] = part
    sources = {x for v in by.values() for x, _, _ in v}
    quality = {x: (0.7, 0.85) for x in sources}
    own = {s: 1.0 for s in by}
    for _ in range(rounds):
        moved = 0.0
        for s, seen in by.items():
            if s is None:
                continue
            odds = 3 * math.log(EVEN_SHARE / share[s])
            for x, k, n in seen:
                sens, spec = quality[x]
                odds += k * math.log(sens / (1 - spec)) + (n - k) * math.log((1 - sens) / spec)
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            moved, own[s] = max(moved, abs(p - own[s])), p
        for x in sources:
            rows = [(own[s], k, n) for s, seen in by.items() for y, k, n in seen if y == x]
            # one pseudo-count a side keeps rates off 0 and 1
            sens = (sum(p * k for p, k, _ in rows) + 1.4) / (sum(p * n for p, _, n in rows) + 2)
            fall = (sum((1 - p) * k for p, k, _ in rows) + 0.3) / (sum((1 - p) * n for p, _, n in rows) + 2)
            quality[x] = (min(0.999, max(0.001, sens)), min(0.999, max(0.001, 1 - fall)))
        if moved < 1e-6:
            break
    return {s for s, p in own.items() if s is not None and p < 0.5}, quality


def general_remarks(claims: DataFrame) -> tuple[set[int], dict[str, tuple[float, float]]]:
    """The statements that the model judges general, and the quality of the sources."""
    total = claims.count()
    if not total:
        return set(), {}
    said = claims.select("group_id", "field_name", "source", F.explode("claims").alias("s"))
    counted = said.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= max(GENERAL_VALUES, GENERAL_SHARE * total))
    shares = counted.select("s", (F.col("n") / F.lit(total)).alias("share"))
    candidates = {r["s"]: r["share"] for r in shares.collect()}  # at most mean claims per value / GENERAL_SHARE
    if not candidates:
        return set(), {}
    key = F.when(F.col("s").isin(list(candidates)), F.col("s"))
    # per group and source: rows with a value, and rows that give the statement
    filled = claims.groupBy("group_id", "field_name", "source").agg(F.count("*").alias("n"))
    group = filled.groupBy("group_id", "field_name").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("n"), F.sum("n").alias("rows"))
    told = (
        said.groupBy("group_id", "field_name", "s", "source")
        .agg(F.count("*").alias("k"))
        .groupBy("group_id", "field_name", "s")
        .agg(F.map_from_entries(F.collect_list(F.struct("source", "k"))).alias("k"), F.sum("k").alias("all"))
    )
    # the row through which a statement came into its group is no evidence: leave one out, shared by its sources
    more = told.join(group.where("rows > 1"), ["group_id", "field_name"])
    each = more.select(key.alias("s"), "all", "k", F.explode("n").alias("source", "n")).withColumn(
        "k", F.coalesce(F.element_at("k", F.col("source")), F.lit(0))
    )
    out = F.col("k") / F.col("all")
    sums = each.groupBy("s", "source").agg(F.sum(F.col("k") - out).alias("k"), F.sum(F.col("n") - out).alias("n"))
    return fit_sources([(r["s"], r["source"], r["k"], r["n"], candidates.get(r["s"], 0.0)) for r in sums.collect()])


def _scored(records: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, rec_no, source, crawled_at, claims, score, score2): all that the fields of a grouped row say, the texts read once."""
    own = records.select("rec_no", F.coalesce("source", F.lit("")).alias("source"), "crawled_at", *TEXT_FIELDS, "extra")
    real, skills = _extra_scores(own.schema)
    return own.join(groups.select("rec_no", "group_id"), "rec_no").select(
        "group_id", "rec_no", "source", "crawled_at", _claims(*TEXT_FIELDS).alias("claims"), real.alias("score"), skills.alias("score2")
    )


def survivors(records: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, field_name, rec_no): the surviving row of each text field and of `extra`.

    records: job_records; groups: (rec_no, group_id). Groups with one row in
    records, and fields of which no row says anything, give no row. Null and
    placeholder values, torn-off ends, repeats and general remarks count as
    nothing; a null crawled_at is older than any time. Extra columns are ignored.
    """
    rows = cut_lineage(_scored(records, groups))
    filled = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"claims.{f}").alias("claims")) for f in TEXT_FIELDS])
    claims = rows.select("group_id", "source", F.inline(filled)).where(F.size("claims") > 0)
    remarks, _ = general_remarks(claims)
    general = F.array(*[F.lit(x) for x in remarks]) if remarks else None

    def best(score: F.Column, score2: F.Column) -> F.Column:
        return F.max(F.struct(score.alias("score"), score2.alias("score2"), "crawled_at", (-F.col("rec_no")).alias("minus")))

    said = {f: F.size(F.array_except(f"claims.{f}", general) if remarks else F.col(f"claims.{f}")).cast("long") for f in TEXT_FIELDS}
    tops = [best(n, F.lit(0).cast("long")).alias(f) for f, n in said.items()] + [best(F.col("score"), F.col("score2")).alias("extra")]
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("top")) for f in (*TEXT_FIELDS, "extra")])
    return (
        rows.groupBy("group_id").agg(F.count("*").alias("rows"), *tops).where("rows > 1")
        .select("group_id", F.inline(each))
        .where(F.col("top.score") > 0)
        .select("group_id", "field_name", (-F.col("top.minus")).alias("rec_no"))
    )


def _skills() -> F.Column:
    """The different skills given, folded; null where there is no list."""
    return F.array_distinct(F.transform(F.filter("extra.skills_given", lambda x: x.isNotNull() & (F.trim(x) != "")), lambda x: F.lower(F.trim(x))))


def _extra_scores(schema: T.StructType) -> tuple[F.Column, F.Column]:
    """Keys of `extra` with a real value, and different skills given."""
    kinds = {f.name: f.dataType.typeName() for f in schema["extra"].dataType.fields}
    value = lambda k: F.col(f"extra.{k}")
    real = [
        F.coalesce(F.size(F.filter(value(k), lambda x: x.isNotNull() & (F.trim(x.cast("string")) != ""))) > 0, F.lit(False)) if kind == "array"
        else _real(value(k)) if kind == "string"
        else value(k).isNotNull()
        for k, kind in kinds.items()
    ]
    score = sum((r.cast("long") for r in real), F.lit(0).cast("long"))
    return score, F.greatest(F.size(_skills()), F.lit(0)).cast("long") if "skills_given" in kinds else F.lit(0).cast("long")


def value_votes(records: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, value, votes): for each skill that a group gives, per source how many rows of the group with a list (n) give it (k)."""
    own = records.select("rec_no", F.coalesce("source", F.lit("")).alias("source"), _skills().alias("values"))
    lists = own.where(F.size("values") > 0).join(groups.select("rec_no", "group_id"), "rec_no")
    n = lists.groupBy("group_id", "source").agg(F.count("*").alias("n"))
    n = n.groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("n"))
    k = lists.select("group_id", "source", F.explode("values").alias("value")).groupBy("group_id", "value", "source").agg(F.count("*").alias("k"))
    k = k.groupBy("group_id", "value").agg(F.map_from_entries(F.collect_list(F.struct("source", "k"))).alias("k"))
    vote = lambda s, m: F.struct(s.alias("source"), F.coalesce(F.element_at("k", s), F.lit(0).cast("long")).alias("k"), m.alias("n"))
    votes = F.array_sort(F.transform(F.map_entries("n"), lambda e: vote(e["key"], e["value"])))
    return k.join(n, "group_id").select("group_id", "value", votes.alias("votes"))


def _truth(quality: dict[str, tuple[float, float]], share: float) -> F.Column:
    """Probability that a value is true, given its votes."""
    log = lambda i: F.create_map(*[F.lit(x) for s, q in quality.items() for x in (s, math.log(q[0] / (1 - q[1])) if i else math.log((1 - q[0]) / q[1]))])
    yes, no = log(1), log(0)
    odds = F.aggregate("votes", F.lit(math.log(share / (1 - share))), lambda acc, v: acc + v["k"] * yes[v["source"]] + (v["n"] - v["k"]) * no[v["source"]])
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds))))


def fit_values(votes: DataFrame, rounds: int = 12) -> tuple[dict[str, tuple[float, float]], float]:
    """(sensitivity, specificity) by source and the share of true values, by expectation-maximisation over value_votes.

    Equal votes are one row with their number, so a round reads a small table;
    the driver sees one row per source.
    """
    patterns = cut_lineage(votes.groupBy("votes").agg(F.count("*").cast("double").alias("w")))
    quality = {r["source"]: (0.7, 0.85) for r in patterns.select(F.explode("votes.source").alias("source")).distinct().collect()}
    share = 0.8
    for _ in range(rounds if quality else 0):
        p = patterns.select("w", _truth(quality, share).alias("p"), "votes")
        true = p.agg(F.sum(F.col("w") * F.col("p")) / F.sum("w")).first()[0]
        v = p.select("w", "p", F.explode("votes").alias("v"))
        part = lambda t, c: F.sum(F.col("w") * t * F.col(f"v.{c}"))
        t, f = F.col("p"), 1 - F.col("p")
        sums = v.groupBy("v.source").agg(part(t, "k").alias("tk"), part(t, "n").alias("tn"), part(f, "k").alias("fk"), part(f, "n").alias("fn")).collect()
        clip = lambda x: min(0.999, max(0.001, x))
        # one pseudo-count a side keeps rates off 0 and 1
        new = {r["source"]: (clip((r["tk"] + 1.4) / (r["tn"] + 2)), clip(1 - (r["fk"] + 0.3) / (r["fn"] + 2))) for r in sums}
        moved = max(abs(x - y) for s in new for x, y in zip(new[s], quality[s]))
        quality, share = new, clip(true)
        if moved < 1e-4:
            break
    return quality, share


def merged_values(records: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, field_name, value, probability): every value of the multi-valued field `skills_given` that the sources of a group make true.

    Each source's sensitivity and specificity are inferred from all groups.
    Rows without a list say nothing; values are compared in lower case without
    outer blanks; empty tables give no rows.
    """
    votes = cut_lineage(value_votes(records, groups))
    quality, share = fit_values(votes)
    judged = votes.select("group_id", F.lit("skills_given").alias("field_name"), "value", (_truth(quality, share) if quality else F.lit(0.0)).alias("probability"))
    return judged.where("probability >= 0.5")
