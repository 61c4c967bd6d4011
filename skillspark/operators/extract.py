"""Skills in texts: exact phrases of up to four tokens, rare misspelt tokens, and labels given by a source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillspark.functions.text import TOKEN, evidence, norm_text, similarity, tokens
from skillspark.operators.simjoin import similar_texts

MAX_WORDS = 4
FUZZY_CUTOFF, FUZZY_LENGTH = 85.0, 5
COMMON_SHARE, COMMON_FLOOR = 0.002, 3
#: Aliases that may be broadcast (about 100 bytes each); beyond it they are joined by a shuffle.
MAX_BROADCAST_ALIASES = 200_000
_OPEN, _CLOSE = "\x01", "\x02"


def record_text(*parts: str) -> F.Column:
    """Non-empty parts joined by a blank."""
    return F.concat_ws(" ", *[F.nullif(F.col(p), F.lit("")) for p in parts])


def aliases_of(skills: DataFrame) -> DataFrame:
    """(alias, skill_id, canonical_name, skill_type) of skills that may be extracted (categories may not); an alias belongs to the smallest id."""
    usable = skills.where(~F.coalesce("is_category", F.lit(False))) if "is_category" in skills.columns else skills
    names = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))) if "aliases" in skills.columns else F.array("canonical_name")
    each = usable.select("skill_id", "canonical_name", "skill_type", F.explode(names).alias("n")).select(norm_text("n").alias("alias"), "skill_id", "canonical_name", "skill_type")
    owner = F.min(F.struct("skill_id", "canonical_name", "skill_type")).alias("s")
    return each.where("alias <> ''").groupBy("alias").agg(owner).select("alias", "s.*")


def _parts(text: F.Column) -> F.Column:
    """Tokens with what follows each up to the next, in order; the first entry is what stands before the first token."""
    return F.split(F.regexp_replace(text, f"({TOKEN})", f"{_OPEN}$1{_CLOSE}"), _OPEN)


def phrases(records: DataFrame) -> DataFrame:
    """(record_id, pos, size, phrase): every run of up to MAX_WORDS tokens as it is written."""
    parts = F.slice(_parts(F.coalesce("text", F.lit(""))), 2, 2**30)

    def run(p: F.Column, size: int) -> F.Column:
        starts = F.sequence(F.lit(1), F.size(p) - size + 1)
        joined = lambda i: F.array_join(F.slice(p, i, size), "")
        # the last token's separator does not belong to the phrase
        written = lambda i: F.replace(F.regexp_extract(joined(i), f"(?s)^(.*){_CLOSE}", 1), F.lit(_CLOSE), F.lit(""))
        return F.when(F.size(p) >= size, F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(size).alias("size"), written(i).alias("phrase"))))

    empty = F.array().cast("array<struct<pos:int,size:int,phrase:string>>")
    # bound to a variable, so that the text is taken apart once and not for every phrase
    each = F.transform(F.array(parts), lambda p: F.concat(*[F.coalesce(run(p, k), empty) for k in range(1, MAX_WORDS + 1)]))
    return records.select("record_id", F.inline(F.flatten(each)))


def _small(aliases: DataFrame) -> DataFrame:
    """aliases for a broadcast if they are few, so that the phrases of all texts need no shuffle."""
    return F.broadcast(aliases) if aliases.limit(MAX_BROADCAST_ALIASES + 1).count() <= MAX_BROADCAST_ALIASES else aliases


def exact_matches(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """(record_id, skill_id, canonical_name, skill_type, method, score, pos, size): per skill the longest, then leftmost phrase."""
    hits = phrases(records).withColumn("alias", norm_text("phrase")).join(_small(aliases), "alias")
    best = F.min(F.struct((-F.col("size")).alias("s"), "pos", "canonical_name", "skill_type")).alias("b")
    return hits.groupBy("record_id", "skill_id").agg(best).select(
        "record_id", "skill_id", "b.canonical_name", "b.skill_type", F.lit("exact_match").alias("method"), F.lit(100.0).alias("score"), "b.pos", (-F.col("b.s")).alias("size")
    )


def document_frequency(records: DataFrame) -> DataFrame:
    """(token, df): in how many records a folded token stands."""
    folded = F.array_distinct(F.transform(tokens("text"), norm_text))
    return records.select(F.explode(folded).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("df"))


def common_tokens(records: DataFrame, share: float = COMMON_SHARE, floor: int = COMMON_FLOOR) -> DataFrame:
    """(token, df) of tokens in more than max(floor, share * non-empty records) records: no misspellings."""
    n = records.agg(F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("n"))
    df = document_frequency(records)
    return df.join(F.broadcast(n), F.col("df") > F.greatest(F.lit(float(floor)), F.lit(share) * F.col("n"))).select("token", "df")


def fuzzy_matches(records: DataFrame, aliases: DataFrame, exact: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """As exact_matches, for rare tokens that are no part of an exact match and resemble a one-word alias. common(token): the tokens that are not rare, by default those of records."""
    words = records.select("record_id", F.posexplode(tokens("text")).alias("p", "word")).select("record_id", (F.col("p") + 1).alias("pos"), norm_text("word").alias("token"))
    usable = words.where((F.length("token") >= FUZZY_LENGTH) & ~F.col("token").rlike("^[0-9]+$"))
    rare = usable.join(common_tokens(records) if common is None else common.select("token"), "token", "left_anti")
    covered = exact.select("record_id", F.explode(F.sequence("pos", F.col("pos") + F.col("size") - 1)).alias("pos"))
    free = rare.join(covered.distinct(), ["record_id", "pos"], "left_anti")
    single = aliases.where((F.length("alias") >= FUZZY_LENGTH) & ~F.col("alias").contains(" "))
    # similar pairs are found once for every different token
    text = lambda df, c: df.select(F.lit("").alias("block"), F.col(c).alias("text"))
    pairs = similar_texts(text(free, "token"), text(single, "alias"), FUZZY_CUTOFF).select(F.col("a").alias("token"), F.col("b").alias("alias"))
    scored = pairs.withColumn("score", similarity(F.col("token"), F.col("alias"))).join(single, "alias")
    best = scored.groupBy("token").agg(F.max_by(F.struct("skill_id", "canonical_name", "skill_type", "score"), F.struct("score", F.lit(0) - F.length("alias"), "alias")).alias("b")).select("token", "b.*")
    hits = free.join(best, "token").join(exact.select("record_id", "skill_id"), ["record_id", "skill_id"], "left_anti")
    first = F.min(F.struct("pos", "score", "canonical_name", "skill_type")).alias("f")
    return hits.groupBy("record_id", "skill_id").agg(first).select(
        "record_id", "skill_id", "f.canonical_name", "f.skill_type", F.lit("fuzzy_match").alias("method"), F.round("f.score", 1).alias("score"), "f.pos", F.lit(1).alias("size")
    )


def label_matches(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """Matches of the labels that records(record_id, labels) carry; unknown labels are dropped, repeats stay."""
    each = records.select("record_id", F.posexplode("labels").alias("p", "label")).withColumn("alias", norm_text("label"))
    return each.join(_small(aliases), "alias").select(
        "record_id", "skill_id", "canonical_name", "skill_type", F.lit("source_provided").alias("method"), F.lit(100.0).alias("score"), (F.col("p") + 1).alias("pos"), F.lit(1).alias("size")
    )


def with_evidence(records: DataFrame, matches: DataFrame) -> DataFrame:
    """matches with the text around each; labels stand for themselves."""
    parts = _parts(F.coalesce("text", F.lit("")))
    length = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(F.replace(x, F.lit(_CLOSE), F.lit(""))))
    joined = matches.join(records.select("record_id", "text"), "record_id").withColumn("parts", parts)
    start = length(F.slice("parts", 1, F.col("pos")))
    last = F.element_at("parts", F.col("pos") + F.col("size"))
    end = length(F.slice("parts", 1, F.col("pos") + F.col("size") - 1)) + F.instr(last, _CLOSE) - 1
    shown = F.when(F.col("method") == "source_provided", F.col("canonical_name")).otherwise(evidence(F.coalesce("text", F.lit("")), start, end))
    return joined.withColumn("evidence", shown).drop("parts", "text")


def extract_skills(records: DataFrame, aliases: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(record_id, skill_id, canonical_name, skill_type, method, score, evidence) of records(record_id, text, labels).

    A record with labels is never searched for phrases. Null texts and labels
    have no match; record_id must be unique.
    """
    labelled = F.coalesce(F.size("labels"), F.lit(-1)) > 0
    free = records.where(~labelled)
    exact = exact_matches(free, aliases)
    found = exact.unionByName(fuzzy_matches(free, aliases, exact)) if fuzzy else exact
    return with_evidence(records, found.unionByName(label_matches(records.where(labelled), aliases))).drop("pos", "size")
