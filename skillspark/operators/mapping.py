"""Raw rows of three feeds mapped to the mediated record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillspark.functions.text import html_to_text, norm_text, similarity

EXTRA = "query string, title_slug string, occupation_ids string, experience_range string, province_id int, contact_address string, skills_given array<string>, job_title_short string, country string, slug string, valid_through string, industry string"
FIELDS = ("source", "source_id", "url", "title", "company", "location", "salary_raw", "level", "job_type", "description", "requirements_raw", "posted_date", "extra")


def _filled(x: Column) -> Column:
    return F.nullif(x.cast("string"), F.lit(""))


def _nonzero(x: Column) -> Column:
    return F.when(x.isNotNull() & (x != 0), x.cast("string"))


def iso_date(x: Column) -> Column:
    """The date a text begins with in ISO form; anything else is null."""
    day = F.substring(x.cast("string"), 1, 10)
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.try_cast("date"))


def skill_list(x: Column) -> Column:
    """A list in Python or JSON notation as array; anything else is empty."""
    return F.coalesce(F.when(F.ltrim(x).startswith("["), F.from_json(x, "array<string>")), F.array().cast("array<string>"))


def first_place(places: Column) -> Column:
    """struct(address, province_id) of the first entry of a JSON list; a plain entry is its address."""
    typed = F.try_element_at(F.from_json(places, "array<struct<address:string,province_id:int>>"), F.lit(1))
    plain = F.try_element_at(F.from_json(places, "array<string>"), F.lit(1))
    address = F.coalesce(_filled(typed["address"]), F.when(~F.ltrim(plain).startswith("{"), _filled(plain)))
    return F.struct(address.alias("address"), typed["province_id"].alias("province_id"))


def record_id() -> Column:
    return F.concat_ws(":", "source", "source_id")


def dedup_key() -> Column:
    return F.sha1(F.concat(norm_text("title"), F.lit("|"), norm_text("company")))


def _record(df: DataFrame, values: dict[str, Column], extra: dict[str, Column]) -> DataFrame:
    types = [part.strip().split(" ", 1) for part in EXTRA.split(", ")]
    bag = F.struct(*[extra.get(k, F.lit(None)).cast(t).alias(k) for k, t in types])
    values = {k: v for k, v in values.items()} | {"extra": bag}
    text = [f for f in FIELDS if f not in ("posted_date", "extra")]
    columns = [values.get(f, F.lit(None)).cast("string").alias(f) for f in text]
    return df.select(*columns, values["posted_date"].cast("date").alias("posted_date"), values["extra"].alias("extra"))


def map_feed_a(raw: DataFrame) -> DataFrame:
    """Feed with nested employer, list of places, numeric bounds of pay and epoch dates."""
    c = F.col
    place = first_place(c("places"))
    bounds = F.nullif(F.concat_ws("-", _nonzero(c("salary_min")), _nonzero(c("salary_max"))), F.lit(""))
    needs = F.nullif(F.concat_ws(" ", html_to_text("job_requirement"), html_to_text("other_requirement")), F.lit(""))
    values = {
        "source": F.lit("vieclam24h"), "source_id": c("id"), "title": F.coalesce("title", F.lit("")), "company": c("employer_info.name"), "location": place["address"],
        "salary_raw": bounds, "level": _nonzero(c("level_requirement")), "job_type": _nonzero(c("working_method")),
        "description": html_to_text("job_requirement"), "requirements_raw": needs,
        "posted_date": F.when(c("created_at") != 0, F.to_date(F.timestamp_seconds(c("created_at")))),
    }
    extra = {"query": c("_query"), "province_id": place["province_id"], "contact_address": c("contact_address")}
    given = {"title_slug": "title_slug", "occupation_ids": "occupation_ids_main", "experience_range": "experience_range"}
    return _record(raw, values, extra | {k: c(v) for k, v in given.items() if v in raw.columns})


def map_feed_b(raw: DataFrame) -> DataFrame:
    """Feed of flat lines with a list of skills in text form."""
    c = F.col
    skills = skill_list(c("job_skills"))
    values = {
        "source": F.lit("data_jobs"), "source_id": c("_row_id"), "title": F.coalesce(_filled(c("job_title")), _filled(c("job_title_short")), F.lit("")),
        "company": c("company_name"), "location": c("job_location"), "salary_raw": _nonzero(c("salary_year_avg")), "job_type": c("job_schedule_type"),
        "requirements_raw": F.nullif(F.array_join(skills, ", "), F.lit("")), "posted_date": iso_date(c("job_posted_date")),
    }
    return _record(raw, values, {"skills_given": skills, "job_title_short": c("job_title_short"), "country": c("job_country")})


def map_feed_c(raw: DataFrame) -> DataFrame:
    """Feed of listing cards joined with their detail pages."""
    c = F.col
    empty = F.array().cast("array<string>")
    skills = F.when(F.size("skills_ld") > 0, c("skills_ld")).otherwise(F.coalesce("skills", empty))
    values = {
        "source": F.lit("itviec"), "source_id": F.coalesce(_filled(c("job_key")), c("slug")), "url": c("url"), "title": F.coalesce("title", F.lit("")),
        "company": c("company"), "location": c("location"), "salary_raw": c("salary_raw"), "level": F.concat(_nonzero(c("months_experience")), F.lit(" months")),
        "job_type": c("employment_type"), "description": c("description"), "requirements_raw": c("requirements"), "posted_date": iso_date(c("date_posted")),
    }
    return _record(raw, values, {"skills_given": skills, "slug": c("slug"), "valid_through": c("valid_through"), "industry": c("industry")})


MAPPERS = {"vieclam24h": map_feed_a, "data_jobs": map_feed_b, "itviec": map_feed_c}


def mediate(feeds: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of raw feeds by source; feeds without a mapper are dropped, rows without id rejected."""
    mapped = [MAPPERS[s](df) for s, df in feeds.items() if s in MAPPERS]
    if not mapped:
        raise ValueError("no known feed")
    every = reduce(DataFrame.unionByName, mapped)
    bad = F.coalesce("source_id", F.lit("")) == ""
    return every.where(~bad), every.where(bad).select("source", "title", "company", F.lit("no id").alias("reason"))


def suggest_fields(fields: DataFrame, targets: DataFrame, threshold: float = 60.0) -> DataFrame:
    """(field, target, score): the most alike target of every source field by edit distance, from a threshold on.

    Both are lists of column names of a schema, compared as a table of a few hundred rows at most.
    """
    pairs = fields.join(F.broadcast(targets.select("target")))
    scored = pairs.withColumn("score", similarity(F.regexp_replace(F.lower("field"), "[^a-z0-9]", ""), F.regexp_replace(F.lower("target"), "[^a-z0-9]", "")))
    best = F.max(F.struct("score", (F.lit(0) - F.length("target")).alias("n"), "target")).alias("b")
    return scored.groupBy("field").agg(best).where(F.col("b.score") >= threshold).select("field", "b.target", F.round("b.score", 1).alias("score"))
