"""Queries that serve search and statistics; each returns one lazy DataFrame.

Every limit is part of a query's feature (a ranked report) and has a total
order. Filters are only added where a value is given, so Catalyst pushes them
to the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skillspark.functions.text import compact, fold_text, strip_accents, url_query
from skillspark.operators.warehouse import Warehouse, opened
from skillspark.session import cut_lineage

#: Search pages of the feeds that have one.
SEARCH_PAGES = {"vieclam24h": "https://vieclam24h.vn/tim-kiem-viec-lam-nhanh?q=", "itviec": "https://itviec.com/it-jobs?query="}


def scope(df: DataFrame, **values: str | None) -> DataFrame:
    """Rows that equal every given value; absent values filter nothing."""
    for column, value in values.items():
        if value:
            df = df.where(F.col(column) == value)
    return df


def facts(w: Warehouse, skill_type: str | None = None, city: str | None = None, country: str | None = None) -> DataFrame:
    """job_skills with the skill's name, category and type and the job's place, in a scope; over a stored star all filters reach its scan."""
    return scope(w.facts, type=skill_type, city=city, country=country)


def search_skills(w: Warehouse, query: str, limit: int = 20) -> DataFrame:
    """Skills found under a typed text: equal before prefix before part, then short names first; signs are literal."""
    typed = fold_text(query)
    joined = typed.replace(" ", "")
    term = F.col("term")
    rank = F.when(term.isin(typed, joined), 3).when(term.startswith(typed) | term.startswith(joined), 2).otherwise(1)
    hits = w.terms.where(F.lit(bool(typed)) & (term.contains(typed) | term.contains(joined)))
    best = hits.groupBy("skill_id").agg(F.max(rank).alias("match_rank"))
    return (
        w.skills.join(best, "skill_id")
        .orderBy(F.desc("match_rank"), F.length("canonical_name"), "canonical_name", "skill_id")
        .limit(limit)
        .select("skill_id", "canonical_name", "skill_type", "category")
    )


def _grams(text: Column, size: int) -> Column:
    """The different runs of `size` letters of a text."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))))


def containing(terms: DataFrame, asked: DataFrame, size: int = 3) -> DataFrame:
    """(t, term): which of the different terms(term) contain which of the texts asked(t), by an equi join on runs of letters.

    A text is looked up under its rarest run of `size` letters (a shorter text
    under itself), so no text meets terms that lack that run.
    """
    every = terms.select("term").distinct()
    runs = lambda k: every.select("term", F.explode(_grams(F.col("term"), k)).alias("g"))
    index = cut_lineage(runs(size))
    df = index.groupBy("g").agg(F.count("*").alias("n"))
    texts = asked.select("t").where("t <> ''").distinct()
    long = texts.where(F.length("t") >= size).select("t", F.explode(_grams(F.col("t"), size)).alias("g")).join(df, "g", "left")
    rarest = long.groupBy("t").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).getField("g").alias("g"))
    found = rarest.join(index, "g").where(F.col("term").contains(F.col("t"))).select("t", "term")
    for k in range(1, size):
        short = texts.where(F.length("t") == k).select("t", F.col("t").alias("g"))
        found = found.unionByName(short.join(runs(k), "g").select("t", "term"))
    return found


def search_quality(w: Warehouse, typed: DataFrame, top_k: int = 20) -> DataFrame:
    """(q, kind, expect_skill, rank): rank of the expected skill for every typed text of typed(q, kind, expect_skill), 0 if it isn't among the first top_k. All texts are searched by one join."""
    asked = cut_lineage(typed.select("q", strip_accents("q").alias("t")).where("t <> ''").distinct().withColumn("tc", compact(F.col("t"))))
    forms = asked.select("t", F.explode(F.array_distinct(F.array("t", "tc"))).alias("form")).distinct()
    hits = containing(w.terms, forms.select(F.col("form").alias("t"))).withColumnRenamed("t", "form")
    term = F.col("term")
    match = F.when(term == F.col("form"), 3).when(term.startswith(F.col("form")), 2).otherwise(1)
    ranks = forms.join(hits, "form").withColumn("r", match).join(w.terms, "term").groupBy("t", "skill_id").agg(F.max("r").alias("r"))
    best = asked.select("q", "t").join(ranks, "t")
    order = W.partitionBy("q").orderBy(F.desc("r"), F.length("canonical_name"), "canonical_name", "skill_id")
    ranked = best.join(w.skills.select("skill_id", "canonical_name"), "skill_id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k)
    found = ranked.select("q", F.col("skill_id").alias("expect_skill"), "place")
    return typed.join(found, ["q", "expect_skill"], "left").select("q", "kind", "expect_skill", F.coalesce("place", F.lit(0)).alias("rank"))


def skill_detail(w: Warehouse, skill_id: str, samples: int = 5) -> DataFrame:
    """One row on a skill: parent, children, spellings, number of jobs and the surest evidence; none for an unknown id."""
    me = w.skills.where(F.col("skill_id") == skill_id).select("skill_id", "canonical_name", "skill_type", "parent_skill_id")
    parent = w.skills.select(F.col("skill_id").alias("parent_skill_id"), F.col("canonical_name").alias("parent_name"))
    children = w.skills.where(F.col("parent_skill_id") == skill_id).agg(F.array_sort(F.collect_list("canonical_name")).alias("children"))
    variants = w.variants.where(F.col("skill_id") == skill_id).agg(F.array_sort(F.collect_list("surface_form")).alias("variants"))
    mine = w.job_skills.where(F.col("skill_id") == skill_id)
    count = mine.agg(F.count_distinct("job_id").alias("job_count"))
    best = mine.orderBy(F.desc_nulls_last("confidence"), "job_id").limit(samples)
    sample = F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("o"), "job_id", "source", "extraction_method", "confidence", "evidence_snippet")
    evidence = best.agg(F.transform(F.array_sort(F.collect_list(sample)), lambda x: x.dropFields("o")).alias("evidence_samples"))
    return me.join(parent, "parent_skill_id", "left").join(children).join(variants).join(count).join(evidence)


def expand_skill_ids(w: Warehouse, skill_id: str) -> DataFrame:
    """The skill and all below it; a skill without closure rows stands for itself."""
    below = w.closure.where(F.col("ancestor_id") == skill_id).select(F.col("descendant_id").alias("skill_id"))
    self = w.skills.sparkSession.range(1).select(F.lit(skill_id).alias("skill_id"))
    return below.unionByName(self.join(below.limit(1).select(F.lit(1).alias("any")), F.lit(True), "left_anti")).distinct()


def search_url(source: Column, title: Column) -> Column:
    """Where a posting can be looked up at its source; null where there is no such page."""
    page = F.lit(None).cast("string")
    for name, prefix in SEARCH_PAGES.items():
        page = F.when(source == name, F.lit(prefix)).otherwise(page)
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(page, url_query(title)))


def search_jobs(w: Warehouse, skill_id: str, expand: bool = True, skill_type: str | None = None, city: str | None = None, country: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Postings that ask for a skill or one below it, newest first."""
    f = scope(w.job_skills, skill_type=skill_type).select("job_id", "skill_id")
    f = f.join(expand_skill_ids(w, skill_id), "skill_id", "left_semi") if expand else f.where(F.col("skill_id") == skill_id)
    names = f.join(w.skills.select("skill_id", "canonical_name"), "skill_id").groupBy("job_id").agg(
        F.array_join(F.array_sort(F.collect_set("canonical_name")), ", ").alias("matched_skills")
    )
    places = w.locations.select("location_id", F.col("location_raw").alias("location"), "city", "country")
    firms = w.companies.select("company_id", F.col("name").alias("company"))
    jobs = w.jobs.select("job_id", "title_raw", "company_id", "location_id", "source", "url", "posted_date", "seniority").join(firms, "company_id", "left")
    placed = jobs.join(scope(places, city=city, country=country), "location_id", "inner" if city or country else "left")
    return (
        names.join(placed, "job_id")
        .orderBy(F.desc_nulls_last("posted_date"), "job_id")
        .offset(offset)
        .limit(limit)
        .select("job_id", "title_raw", "company", "location", "city", "country", "source", "url", "posted_date", "seniority", "matched_skills", search_url(F.col("source"), F.col("title_raw")).alias("source_search_url"))
    )


def top_skills(w: Warehouse, skill_type: str | None = None, city: str | None = None, country: str | None = None, limit: int = 20) -> DataFrame:
    """Skills by the number of postings that ask for them."""
    n = F.count_distinct("job_id").alias("n")
    by = facts(w, skill_type, city, country).groupBy("canonical_name", "category", F.col("type").alias("skill_type")).agg(n)
    return by.orderBy(F.desc("n"), "canonical_name", "category", "skill_type").limit(limit)


def corpus_stats(w: Warehouse, skill_type: str | None = None, city: str | None = None, country: str | None = None) -> DataFrame:
    """One row of totals; the numbers of jobs and sources do not depend on the type of skill."""
    places = scope(w.locations.select("location_id", "city", "country"), city=city, country=country)
    jobs = w.jobs.join(places, "location_id", "inner" if city or country else "left")
    of_jobs = jobs.agg(F.count("*").alias("n_jobs"), F.count_distinct("source").alias("n_sources"), F.count_distinct("location_id").alias("n_locations"), F.count_distinct("company_id").alias("n_companies"))
    of_pairs = facts(w, skill_type, city, country).agg(
        F.count("*").alias("n_pairs"), F.count_distinct("skill_id").alias("n_skills"), F.count_distinct("job_id").alias("n_jobs_with_skill")
    )
    ratio = F.when(F.col("n_jobs_with_skill") > 0, F.col("n_pairs") / F.col("n_jobs_with_skill")).otherwise(F.lit(0.0))
    return of_jobs.join(of_pairs).withColumn("skills_per_job", ratio)  # one row each


def jobs_by_category(w: Warehouse, skill_type: str | None = None, city: str | None = None, country: str | None = None, limit: int = 14) -> DataFrame:
    """Categories by the number of postings with a skill of theirs."""
    by = facts(w, skill_type, city, country).where("category IS NOT NULL").groupBy("category").agg(F.count_distinct("job_id").alias("n"))
    return by.orderBy(F.desc("n"), "category").limit(limit)


def skill_by_city(w: Warehouse, skill_type: str | None = None, country: str | None = "Việt Nam", top_skills_n: int = 12, top_cities_n: int = 6) -> DataFrame:
    """The most asked skills in the cities with most postings, with their share of the city's postings."""
    pairs = facts(w, skill_type, None, country).where("city IS NOT NULL").select("job_id", "city", "canonical_name").distinct()
    cities = pairs.groupBy("city").agg(F.count_distinct("job_id").alias("city_total")).orderBy(F.desc("city_total"), "city").limit(top_cities_n)
    names = pairs.groupBy("canonical_name").agg(F.count_distinct("job_id").alias("t")).orderBy(F.desc("t"), "canonical_name").limit(top_skills_n)
    cells = pairs.join(F.broadcast(names), "canonical_name", "left_semi").groupBy("city", "canonical_name").agg(F.count("*").alias("n"))
    share = F.round(F.lit(100.0) * F.col("n") / F.col("city_total"), 1)
    return cells.join(F.broadcast(cities), "city").select("city", "canonical_name", "n", "city_total", share.alias("pct")).orderBy(F.desc("city_total"), F.desc("n"), "city", "canonical_name")


def skill_cooccurrence(w: Warehouse, skill_type: str | None = None, city: str | None = None, country: str | None = None, limit: int = 12) -> DataFrame:
    """How many postings ask for both of two skills, among the most asked; both orders, and each skill with itself.

    The pairs are reduced to the few top skills before the self join, so a
    posting contributes at most limit * limit rows.
    """
    pairs = facts(w, skill_type, city, country).select("job_id", "canonical_name").distinct()
    top = pairs.groupBy("canonical_name").agg(F.count("*").alias("t")).orderBy(F.desc("t"), "canonical_name").limit(limit)
    kept = pairs.join(F.broadcast(top), "canonical_name", "left_semi")
    per_job = kept.groupBy("job_id").agg(F.collect_list("canonical_name").alias("s"))
    a = per_job.select(F.explode("s").alias("skill_a"), "s")
    return a.select("skill_a", F.explode("s").alias("skill_b")).groupBy("skill_a", "skill_b").agg(F.count("*").alias("n"))


def extraction_method_by_source(w: Warehouse) -> DataFrame:
    return w.job_skills.groupBy("source", "extraction_method").agg(F.count("*").alias("n")).orderBy("source", F.desc("n"), "extraction_method")


def jobs_by_month(w: Warehouse, city: str | None = None, country: str | None = None, months: int = 12) -> DataFrame:
    """Postings per month and source in the latest months that have any."""
    places = scope(w.locations.select("location_id", "city", "country"), city=city, country=country)
    jobs = w.jobs.join(places, "location_id") if city or country else w.jobs
    by = jobs.where("posted_date IS NOT NULL").groupBy(F.date_format("posted_date", "yyyy-MM").alias("month"), "source").agg(F.count("*").alias("n"))
    last = by.select("month").distinct().orderBy(F.desc("month")).limit(months)
    return by.join(F.broadcast(last), "month", "left_semi").select("month", "source", "n").orderBy("month", "source")


def hard_soft(w: Warehouse) -> DataFrame:
    """Postings by type of skill; one that asks for both counts in both."""
    return w.facts.groupBy(F.col("type").alias("skill_type")).agg(F.count_distinct("job_id").alias("n"))


def list_places(w: Warehouse, level: str, country: str | None = None, min_jobs: int = 5) -> DataFrame:
    """Cities or countries with enough postings, most first."""
    places = scope(w.locations.select("location_id", "city", "country"), country=country).where(F.col(level).isNotNull())
    by = w.jobs.join(places, "location_id").groupBy(level).agg(F.count("*").alias("n")).where(F.col("n") >= min_jobs)
    return by.orderBy(F.desc("n"), level)


def place_label(city: Column, country: Column, raw: Column) -> Column:
    """City and country, else the place as written, else a dash."""
    known = F.concat_ws(" · ", F.nullif(city, F.lit("")), F.nullif(country, F.lit("")))
    return F.coalesce(F.nullif(known, F.lit("")), F.nullif(raw, F.lit("")), F.lit("—"))


def told(detail: DataFrame) -> DataFrame:
    """skill_detail with its lists as texts."""
    sample = lambda x: F.concat_ws("~", *[F.coalesce(x[c].cast("string"), F.lit("")) for c in ("job_id", "source", "extraction_method", "confidence", "evidence_snippet")])
    return detail.select(
        "skill_id", "canonical_name", "skill_type", "parent_name", F.array_join("children", "|").alias("children"), F.array_join("variants", "|").alias("variants"),
        "job_count", F.array_join(F.transform("evidence_samples", sample), "|").alias("evidence_samples"),
    )


def _w(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return QUERIES[name][0](opened(spark, sf_dir))

    return run


_BLANK_CLASS = "[\\s\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]"
_WAREHOUSE_SQL = """
WITH sk0 AS (
  SELECT * FROM skills WHERE skill_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY skill_id ORDER BY loaded_at DESC NULLS LAST,
    canonical_name DESC NULLS LAST, skill_type DESC NULLS LAST, category DESC NULLS LAST, parent_skill_id DESC NULLS LAST, is_category DESC NULLS LAST, deleted_at DESC NULLS LAST) = 1),
sk1 AS (SELECT * FROM sk0 WHERE deleted_at IS NULL),
w_skills AS (SELECT s.skill_id, s.canonical_name, s.skill_type, p.canonical_name AS category, s.parent_skill_id, s.is_category FROM sk1 s LEFT JOIN sk1 p ON p.skill_id = s.parent_skill_id),
jb0 AS (
  SELECT * FROM jobs WHERE job_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY loaded_at DESC NULLS LAST,
    title_raw DESC NULLS LAST, location_id DESC NULLS LAST, posted_date DESC NULLS LAST, source DESC NULLS LAST, url DESC NULLS LAST, seniority DESC NULLS LAST, job_type DESC NULLS LAST, deleted_at DESC NULLS LAST) = 1),
w_companies AS (
  SELECT row_number() OVER (ORDER BY o) AS company_id, name_norm, name FROM (
    SELECT name_norm, arg_min(company, rec_no) AS name, min(rec_no) AS o FROM (SELECT {norm} AS name_norm, company, rec_no FROM job_records) WHERE name_norm <> '' GROUP BY 1)),
jc AS (
  SELECT source || ':' || source_id AS job_id, {norm} AS name_norm FROM job_records WHERE source IS NOT NULL AND source_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY source, source_id ORDER BY crawled_at DESC NULLS LAST, rec_no) = 1),
w_jobs AS (SELECT j.*, c.company_id, c.name AS company FROM jb0 j LEFT JOIN jc USING (job_id) LEFT JOIN w_companies c USING (name_norm) WHERE j.deleted_at IS NULL),
w_facts AS (
  SELECT * FROM job_skills f WHERE job_id IN (SELECT job_id FROM w_jobs) AND skill_id IN (SELECT skill_id FROM w_skills)
  QUALIFY row_number() OVER (PARTITION BY job_id, skill_id ORDER BY CASE extraction_method WHEN 'source_provided' THEN 0 WHEN 'exact_match' THEN 1 WHEN 'fuzzy_match' THEN 2 ELSE 3 END,
    coalesce(confidence, -1) DESC, match_id) = 1),
w_closure AS (SELECT ancestor_id, descendant_id, min(depth) AS depth FROM skill_closure WHERE ancestor_id IS NOT NULL GROUP BY 1, 2),
scoped AS (
  SELECT f.job_id, f.skill_id, s.canonical_name, s.category, s.skill_type, l.city, l.country
  FROM w_facts f JOIN w_skills s USING (skill_id) JOIN w_jobs j USING (job_id) LEFT JOIN locations l ON l.location_id = j.location_id)
"""

_WAREHOUSE_SQL = _WAREHOUSE_SQL.replace("{norm}", f"trim(regexp_replace(lower(coalesce(company, '')), '{_BLANK_CLASS}+', ' ', 'g'))")
_FOLDED = "trim(regexp_replace(regexp_replace(strip_accents(replace(lower({0}), 'đ', 'd')), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g'))"
_NORMED = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
_TERMS_SQL = ", terms AS (SELECT DISTINCT skill_id, term FROM (" + " UNION ALL ".join(
    f"SELECT skill_id, {form} AS term FROM w_skills"
    for base in (_NORMED, _FOLDED)
    for form in (base.format("canonical_name"), f"replace({base.format('canonical_name')}, ' ', '')")
) + ") WHERE term <> '')"

_IDS_SQL = """
, ids AS (SELECT DISTINCT descendant_id AS skill_id FROM w_closure WHERE ancestor_id = 'javascript'
  UNION ALL SELECT 'javascript' WHERE NOT EXISTS (SELECT 1 FROM w_closure WHERE ancestor_id = 'javascript'))
"""

QUERIES = {
    "q1_search_skills": (lambda w: search_skills(w, "Tiếng  a"), _TERMS_SQL + """
        SELECT skill_id, canonical_name, skill_type, category FROM w_skills JOIN (
          SELECT skill_id, max(CASE WHEN term IN ('tieng a', 'tienga') THEN 3 WHEN starts_with(term, 'tieng a') OR starts_with(term, 'tienga') THEN 2 ELSE 1 END) AS r
          FROM terms WHERE contains(term, 'tieng a') OR contains(term, 'tienga') GROUP BY 1) USING (skill_id)
        ORDER BY r DESC, length(canonical_name), canonical_name, skill_id LIMIT 20"""),
    "q1_search_sql": (lambda w: search_skills(w, "SQL"), _TERMS_SQL + """
        SELECT skill_id, canonical_name, skill_type, category FROM w_skills JOIN (
          SELECT skill_id, max(CASE WHEN term = 'sql' THEN 3 WHEN starts_with(term, 'sql') THEN 2 ELSE 1 END) AS r FROM terms WHERE contains(term, 'sql') GROUP BY 1) USING (skill_id)
        ORDER BY r DESC, length(canonical_name), canonical_name, skill_id LIMIT 20"""),
    "q2_skill_detail": (lambda w: told(skill_detail(w, "sql")), """
        , e AS (SELECT job_id || '~' || coalesce(source, '') || '~' || coalesce(extraction_method, '') || '~' || coalesce(CAST(confidence AS VARCHAR), '') || '~' || coalesce(evidence_snippet, '') AS x, confidence, job_id
          FROM w_facts WHERE skill_id = 'sql' ORDER BY confidence DESC NULLS LAST, job_id LIMIT 5)
        SELECT s.skill_id, s.canonical_name, s.skill_type, s.category AS parent_name,
          (SELECT coalesce(string_agg(canonical_name, '|' ORDER BY canonical_name), '') FROM w_skills c WHERE c.parent_skill_id = 'sql') AS children,
          (SELECT coalesce(string_agg(f, '|' ORDER BY f), '') FROM (SELECT DISTINCT canonical_name AS f FROM skills WHERE skill_id = 'sql' AND trim(canonical_name) <> '')) AS variants,
          (SELECT count(DISTINCT job_id) FROM w_facts WHERE skill_id = 'sql') AS job_count,
          (SELECT coalesce(string_agg(x, '|' ORDER BY confidence DESC NULLS LAST, job_id), '') FROM e) AS evidence_samples
        FROM w_skills s WHERE s.skill_id = 'sql'"""),
    "q3_expand_skill": (lambda w: expand_skill_ids(w, "javascript"), _IDS_SQL + " SELECT skill_id FROM ids"),
    "q3_expand_unknown": (lambda w: expand_skill_ids(w, "no-such-skill"), "SELECT 'no-such-skill' AS skill_id"),
    "q4_search_jobs": (lambda w: search_jobs(w, "javascript", limit=50), _IDS_SQL + """
        SELECT j.job_id, j.title_raw, j.company, l.location_raw AS location, l.city, l.country, j.source, j.url, j.posted_date, j.seniority,
          string_agg(DISTINCT s.canonical_name, ', ' ORDER BY s.canonical_name) AS matched_skills,
          CASE WHEN coalesce(j.title_raw, '') <> '' THEN CASE j.source WHEN 'vieclam24h' THEN 'https://vieclam24h.vn/tim-kiem-viec-lam-nhanh?q=' WHEN 'itviec' THEN 'https://itviec.com/it-jobs?query=' END
            || replace(url_encode(j.title_raw), '%20', '+') END AS source_search_url
        FROM w_facts f JOIN ids USING (skill_id) JOIN w_skills s USING (skill_id) JOIN w_jobs j USING (job_id) LEFT JOIN locations l ON l.location_id = j.location_id
        GROUP BY ALL ORDER BY j.posted_date DESC NULLS LAST, j.job_id LIMIT 50"""),
    "q4_search_jobs_scoped": (lambda w: search_jobs(w, "sql", expand=False, skill_type="hard", country="Việt Nam", limit=20, offset=5).select("job_id", "city", "matched_skills"), """
        SELECT j.job_id, l.city, 'SQL' AS matched_skills
        FROM w_facts f JOIN w_jobs j USING (job_id) JOIN locations l ON l.location_id = j.location_id
        WHERE f.skill_id = 'sql' AND f.skill_type = 'hard' AND l.country = 'Việt Nam'
        ORDER BY j.posted_date DESC NULLS LAST, j.job_id LIMIT 20 OFFSET 5"""),
    "q5_top_skills": (top_skills, """
        SELECT canonical_name, category, skill_type, count(DISTINCT job_id) AS n FROM scoped GROUP BY 1, 2, 3
        ORDER BY n DESC, canonical_name, category NULLS FIRST, skill_type LIMIT 20"""),
    "q5_top_skills_scoped": (lambda w: top_skills(w, "soft", None, "Việt Nam", 10), """
        SELECT canonical_name, category, skill_type, count(DISTINCT job_id) AS n FROM scoped WHERE skill_type = 'soft' AND country = 'Việt Nam' GROUP BY 1, 2, 3
        ORDER BY n DESC, canonical_name, category NULLS FIRST, skill_type LIMIT 10"""),
    "q6_corpus_stats": (lambda w: corpus_stats(w, "soft"), """
        SELECT (SELECT count(*) FROM w_jobs) AS n_jobs, (SELECT count(DISTINCT source) FROM w_jobs) AS n_sources, (SELECT count(DISTINCT location_id) FROM w_jobs) AS n_locations,
          (SELECT count(DISTINCT company_id) FROM w_jobs) AS n_companies,
          count(*) AS n_pairs, count(DISTINCT skill_id) AS n_skills, count(DISTINCT job_id) AS n_jobs_with_skill,
          CASE WHEN count(DISTINCT job_id) > 0 THEN count(*) / CAST(count(DISTINCT job_id) AS DOUBLE) ELSE 0.0 END AS skills_per_job
        FROM scoped WHERE skill_type = 'soft'"""),
    "q7_jobs_by_category": (jobs_by_category, "SELECT category, count(DISTINCT job_id) AS n FROM scoped WHERE category IS NOT NULL GROUP BY 1 ORDER BY n DESC, category LIMIT 14"),
    "q8_skill_by_city": (skill_by_city, """
        , s AS (SELECT DISTINCT job_id, city, canonical_name FROM scoped WHERE country = 'Việt Nam' AND city IS NOT NULL),
        c AS (SELECT city, count(DISTINCT job_id) AS city_total FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6),
        k AS (SELECT canonical_name FROM s GROUP BY 1 ORDER BY count(DISTINCT job_id) DESC, 1 LIMIT 12)
        SELECT city, canonical_name, count(*) AS n, city_total, round(CAST(100.0 * count(*) AS DOUBLE) / city_total, 1) AS pct
        FROM s JOIN c USING (city) JOIN k USING (canonical_name) GROUP BY city, canonical_name, city_total"""),
    "q9_skill_cooccurrence": (skill_cooccurrence, """
        , s AS (SELECT DISTINCT job_id, canonical_name FROM scoped),
        k AS (SELECT canonical_name FROM s GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 12),
        t AS (SELECT * FROM s JOIN k USING (canonical_name))
        SELECT a.canonical_name AS skill_a, b.canonical_name AS skill_b, count(*) AS n FROM t a JOIN t b USING (job_id) GROUP BY 1, 2"""),
    "q10_extraction_method_by_source": (extraction_method_by_source, "SELECT source, extraction_method, count(*) AS n FROM w_facts GROUP BY 1, 2"),
    "q11_jobs_by_month": (jobs_by_month, """
        , m AS (SELECT strftime(posted_date, '%Y-%m') AS month, source, count(*) AS n FROM w_jobs WHERE posted_date IS NOT NULL GROUP BY 1, 2)
        SELECT month, source, n FROM m WHERE month IN (SELECT DISTINCT month FROM m ORDER BY month DESC LIMIT 12)"""),
    "q12_hard_soft": (hard_soft, "SELECT skill_type, count(DISTINCT job_id) AS n FROM scoped GROUP BY 1"),
    "q13_list_countries": (lambda w: list_places(w, "country"), "SELECT l.country, count(*) AS n FROM w_jobs j JOIN locations l USING (location_id) WHERE l.country IS NOT NULL GROUP BY 1 HAVING count(*) >= 5"),
    "q14_list_cities": (lambda w: list_places(w, "city", "Việt Nam"), "SELECT l.city, count(*) AS n FROM w_jobs j JOIN locations l USING (location_id) WHERE l.city IS NOT NULL AND l.country = 'Việt Nam' GROUP BY 1 HAVING count(*) >= 5"),
    "skill_terms": (lambda w: w.terms, _TERMS_SQL + " SELECT skill_id, term FROM terms"),
    "skill_category": (lambda w: w.skills.select("skill_id", "category"), "SELECT skill_id, category FROM w_skills"),
    "best_matches": (lambda w: w.job_skills.select("job_id", "skill_id", "extraction_method", "confidence"), "SELECT job_id, skill_id, extraction_method, confidence FROM w_facts"),
}


def queries() -> dict:
    return {name: _w(name) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: _WAREHOUSE_SQL + sql for name, (_, sql) in QUERIES.items() if sql}
