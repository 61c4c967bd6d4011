"""Queries of the integration pipeline over job_records, documents and skills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillspark.functions import places, text
from skillspark.operators import dedup, extract
from skillspark.operators.graph import link_groups
from skillspark.operators.warehouse import latest
from skillspark.plans import oracles
from skillspark.plans.serving import _WAREHOUSE_SQL
from skillspark.session import cut_lineage, spread, table


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "job_records")


def norm_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("rec_no", text.norm_text("title").alias("norm"), text.strip_accents("company").alias("ascii"), text.company_key("company").alias("company_key"))


def skill_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "skills").select("canonical_name").distinct().select("canonical_name", text.slugify("canonical_name").alias("slug"))


def blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = dedup.blocking_key(F.col("company"), F.col("title"))
    return records(spark, sf_dir).groupBy(key.alias("block")).agg(F.count("*").alias("n"))


def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_signatures(dedup.signatures(records(spark, sf_dir), accents=False)).select("t", "c", "t2", "c2")


def duplicate_pairs_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By titles with their accents."""
    return dedup.duplicate_signatures(dedup.signatures(records(spark, sf_dir))).select("t", "c", "t2", "c2")


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.group_labels(records(spark, sf_dir))


def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    signs = records(spark, sf_dir).select("rec_no", "title", "company", *dedup.canonical_signs())
    grouped = dedup.group_labels(signs, keep=("has_labels", "text_length"))
    return dedup.mark_canonical(grouped).where("is_canonical").select("dup_group_id", "rec_no")


def cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.cross_source_groups(dedup.group_labels(records(spark, sf_dir), keep=("source",)))


def match_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "record_pairs").where("is_match").select(F.col("left_no").alias("a"), F.col("right_no").alias("b"))
    return link_groups(pairs)


def seniority(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = places.months_experience(F.col("level"))
    return records(spark, sf_dir).select("rec_no", months.alias("months"), places.seniority(F.col("title"), months).alias("seniority"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = places.city_country(F.col("location"), F.col("source"), F.col("extra.country"), F.col("extra.province_id"), F.col("extra.contact_address"))
    return records(spark, sf_dir).select("rec_no", place.alias("p")).select("rec_no", "p.city", "p.country")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("record_id"), "text", F.lit(None).cast("array<string>").alias("labels"))


def texts_of(records: DataFrame) -> DataFrame:
    """(record_id, text, labels) of job records."""
    return records.select(F.col("rec_no").alias("record_id"), extract.record_text("title", "requirements_raw", "description").alias("text"), F.col("extra.skills_given").alias("labels"))


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.aliases_of(latest(table(spark, sf_dir, "skills"), "skill_id"))


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.document_frequency(_texts(spark, sf_dir).withColumn("text", text.strip_accents("text")))


def common_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.common_tokens(_texts(spark, sf_dir).withColumn("text", text.strip_accents("text")))


def exact_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.exact_matches(_texts(spark, sf_dir), cut_lineage(_aliases(spark, sf_dir))).select("record_id", "skill_id", "pos", "size")


def extracted_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of all records with their evidence."""
    return extract.extract_skills(cut_lineage(spread(texts_of(records(spark, sf_dir)))), cut_lineage(_aliases(spark, sf_dir)))


def label_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = records(spark, sf_dir).select(F.col("rec_no").alias("record_id"), F.col("extra.skills_given").alias("labels")).where("labels IS NOT NULL")
    return extract.label_matches(labels, cut_lineage(_aliases(spark, sf_dir))).select("record_id", "skill_id", "pos")


_ascii, _norm = oracles.ascii_only, oracles.norm


def _company_key(x: str) -> str:
    words = f"trim(regexp_replace(regexp_replace({_ascii(x)}, '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
    own = f"trim(regexp_replace({words} || ' ', '^(?:(?:{'|'.join(text.LEGAL_WORDS)}) )+', ''))"
    return f"CASE WHEN {own} = '' THEN {words} ELSE {own} END"


def _sorted_words(x: str) -> str:
    return f"array_to_string(list_sort(string_split({x}, ' ')), ' ')"


def _signed(title: str, measure) -> str:
    """signed, sig and pairs: titles by an expression, their edits counted over another."""
    return f"""
WITH signed AS (
  SELECT rec_no, source, extra, requirements_raw, description, left(coalesce(nullif({_company_key('company')}, ''), {_ascii('title')}), 12) AS block,
    {_sorted_words(title)} AS t, {_sorted_words('(' + _company_key('company') + ')')} AS c FROM job_records),
sig AS (SELECT DISTINCT block, t, c FROM signed),
pairs AS (
  SELECT a.block, a.t, a.c, b.t AS t2, b.c AS c2 FROM sig a JOIN sig b ON a.block = b.block AND (a.t < b.t OR (a.t = b.t AND a.c < b.c))
  WHERE levenshtein({measure('a.t')}, {measure('b.t')}) <= floor(greatest(length(a.t), length(b.t)) * 0.125) AND levenshtein(a.c, b.c) <= floor(greatest(length(a.c), length(b.c)) * (1 - 88.0 / 100)))
"""


_SIGNED_ASCII = _signed(_ascii("title"), str)
_SIGNED = _signed(_norm("title"), oracles.single_bytes)
_GROUPS = """
, firsts AS (SELECT block, t, c, min(rec_no) AS f FROM signed GROUP BY 1, 2, 3),
e AS (
  SELECT x.f AS a, y.f AS b FROM pairs p JOIN firsts x ON (x.block, x.t, x.c) = (p.block, p.t, p.c) JOIN firsts y ON (y.block, y.t, y.c) = (p.block, p.t2, p.c2)),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM e2 UNION SELECT r.a, e2.b FROM reach r JOIN e2 ON r.b = e2.a),
lab AS (SELECT a, least(a, min(b)) AS g FROM reach GROUP BY a),
grouped AS (SELECT s.*, coalesce(l.g, f.f) AS dup_group_id FROM signed s JOIN firsts f ON (f.block, f.t, f.c) = (s.block, s.t, s.c) LEFT JOIN lab l ON l.a = f.f)
"""
_GROUPS = _GROUPS.strip()


def _recursive(sql: str) -> str:
    return sql.replace("WITH signed", "WITH RECURSIVE signed", 1)


_CASE = lambda x, table: "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains({x}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in table.items()
)
_MONTHS = "TRY_CAST(nullif(regexp_extract(coalesce(level, ''), '^(\\d+)\\s*months?', 1), '') AS INTEGER)"
_CITY = lambda x: _CASE(_ascii(x), places.CITIES) + " END"
_REMOTE = lambda x: "(" + " OR ".join(f"contains({_ascii(x)}, '{w}')" for w in places.REMOTE) + ")"
_STATES = ", ".join(f"'{s}'" for s in places.US_STATES)
_LOCATIONS = f"""
WITH r AS (SELECT rec_no, source, location AS l, nullif(extra.country, '') AS h, extra.province_id AS p, extra.contact_address AS a,
  trim(string_split(location, ',')[-1]) AS tail, nullif(trim(string_split(location, ',')[1]), '') AS head FROM job_records)
SELECT rec_no,
  CASE WHEN source IS DISTINCT FROM 'data_jobs' THEN CASE WHEN {_REMOTE('l')} OR {_REMOTE('a')} THEN '{places.REMOTE_CITY}'
      ELSE coalesce({_CITY('l')}, CASE p {' '.join(f"WHEN {k} THEN '{v}'" for k, v in places.PROVINCES.items())} END, {_CITY('a')}) END
    WHEN coalesce(l, '') = '' THEN NULL WHEN {_REMOTE('l')} THEN '{places.REMOTE_CITY}' WHEN contains(l, ',') THEN head
    WHEN contains(l, ' - ') THEN nullif(trim(string_split(l, ' - ')[1]), '')
    WHEN l IN ('Singapore', 'Hong Kong', 'Macau', 'Luxembourg', 'Monaco') THEN l END AS city,
  CASE WHEN source IS DISTINCT FROM 'data_jobs' THEN 'Việt Nam' WHEN coalesce(l, '') = '' THEN h WHEN {_REMOTE('l')} THEN NULL
    WHEN contains(l, ',') AND tail IN ({_STATES}) THEN 'United States' WHEN contains(l, ',') THEN coalesce(h, nullif(tail, ''))
    WHEN contains(l, ' - ') THEN coalesce(h, nullif(trim(substr(l, instr(l, ' - ') + 3)), ''))
    WHEN l IN ('Singapore', 'Hong Kong', 'Macau', 'Luxembourg', 'Monaco') THEN coalesce(h, l) ELSE l END AS country
FROM r
"""
_SLUG = "lower(canonical_name)"
for _sign, _word in text.SLUG_SIGNS:
    _SLUG = f"replace({_SLUG}, '{_sign}', '{_word}')"
_TOKENS = f"regexp_extract_all({_ascii('text')}, '{text.TOKEN}')"
_DF = f"SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS token FROM documents) WHERE token <> '' GROUP BY token"

QUERIES = {
    "proj_norm_names": (norm_names, f"SELECT rec_no, {_norm('title')} AS norm, {_ascii('company')} AS ascii, {_company_key('company')} AS company_key FROM job_records"),
    "proj_skill_slugs": (skill_slugs, f"SELECT DISTINCT canonical_name, coalesce(nullif(regexp_replace(regexp_replace({_ascii(_SLUG)}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'skill') AS slug FROM skills"),
    "proj_seniority": (seniority, f"SELECT rec_no, {_MONTHS} AS months, {_CASE(_ascii('title'), places.LEVELS)} WHEN {_MONTHS} >= 60 THEN 'Cao cấp' WHEN {_MONTHS} >= 24 THEN 'Có kinh nghiệm' WHEN {_MONTHS} IS NOT NULL THEN 'Mới vào nghề' END AS seniority FROM job_records"),
    "proj_city_country": (locations, _LOCATIONS),
    "m3_blocking": (blocking, _SIGNED + " SELECT block, count(*) AS n FROM signed GROUP BY 1"),
    "j11_duplicate_pairs": (duplicate_pairs, _SIGNED_ASCII + " SELECT t, c, t2, c2 FROM pairs"),
    "j11_duplicate_pairs_accents": (duplicate_pairs_accents, _SIGNED + " SELECT t, c, t2, c2 FROM pairs"),
    "m5_duplicate_groups": (duplicate_groups, _recursive(_SIGNED) + _GROUPS + " SELECT rec_no, dup_group_id FROM grouped"),
    "m5_match_links": (match_links, """WITH RECURSIVE e AS (SELECT left_no a, right_no b FROM record_pairs WHERE is_match AND left_no <> right_no UNION SELECT right_no, left_no FROM record_pairs WHERE is_match AND left_no <> right_no),
        reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a) SELECT a AS node, least(a, min(b)) AS "group" FROM reach GROUP BY a"""),
    "a14_canonical_records": (canonical_records, _recursive(_SIGNED) + _GROUPS + """ SELECT dup_group_id, rec_no FROM grouped QUALIFY row_number() OVER (PARTITION BY dup_group_id
        ORDER BY coalesce(len(extra.skills_given), 0) > 0 DESC, length(coalesce(requirements_raw, '')) + length(coalesce(description, '')) DESC, rec_no) = 1"""),
    "a23_cross_source_groups": (cross_source, _recursive(_SIGNED) + _GROUPS + " SELECT dup_group_id, count(DISTINCT source) AS n_sources, count(*) AS n_records FROM grouped GROUP BY 1 HAVING count(DISTINCT source) > 1"),
    "a11_document_frequency": (document_frequency, _DF),
    "a11_common_tokens": (common_tokens, f"SELECT token, df FROM ({_DF}) WHERE df > greatest(3.0, 0.002 * (SELECT count(*) FROM documents WHERE {_ascii('text')} <> ''))"),
    "m7_exact_skills": (exact_skills, _WAREHOUSE_SQL + oracles.ALIASES + oracles.exact("SELECT doc_id AS record_id, text FROM documents") + " SELECT record_id, skill_id, pos, size FROM ex"),
    "m10_label_matches": (label_matches, _WAREHOUSE_SQL + oracles.ALIASES + oracles.LABELS + " SELECT record_id, skill_id, pos FROM lm"),
    "m11_extracted_skills": (extracted_skills, _WAREHOUSE_SQL + oracles.ALIASES + oracles.LABELS
        + oracles.exact(f"SELECT rec_no AS record_id, {oracles.RECORD_TEXT} AS text FROM job_records WHERE coalesce(len(extra.skills_given), 0) = 0") + oracles.fuzzy() + f"""
        , mt AS (SELECT m.*, tk.text, {oracles.PLACE} FROM (SELECT * FROM ex UNION ALL SELECT * FROM fz) m JOIN tk USING (record_id))
        SELECT record_id, skill_id, canonical_name, skill_type, method, score, {oracles.EVIDENCE} AS evidence FROM mt
        UNION ALL SELECT record_id, skill_id, canonical_name, skill_type, 'source_provided', 100::DOUBLE, canonical_name FROM lm"""),
}


def queries() -> dict:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
