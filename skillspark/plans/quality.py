"""Queries on mapping, dictionary, integrity and evaluation over the project's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skillspark.functions import pay
from skillspark.functions.text import norm_text
from skillspark.operators import dictionary, extract, hierarchy, mapping, quality, warehouse
from skillspark.plans import oracles, pipeline, serving
from skillspark.plans.serving import _TERMS_SQL, _WAREHOUSE_SQL
from skillspark.session import cut_lineage, spread, table


#: Lists that a user of the dictionary brings along: labels that are roles, spellings to merge and to keep apart, a tree of categories.
ROLES = ("data engineer", "tester", "business analyst")
MERGES = [("excel vba", "excel"), ("postgres", "postgresql"), ("k8s", "kubernetes")]
PROTECTED = [("java", "javascript"), ("sql", "mysql"), ("c", "c++"), ("c", "c#"), ("react", "react native")]
TREE = [("Python", "Programming"), ("Java", "Programming"), ("JavaScript", "Programming"), ("SQL", "Data"), ("Excel", "Data"), ("Programming", "Technology"), ("Data", "Technology"), ("No Such Skill", "Data")]
SOFT_ROOT = "Soft skills"


def feed_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "data_jobs")
    latest = raw.groupBy("_row_id").agg(F.max_by(F.struct(*[c for c in raw.columns if c != "_row_id"]), F.struct("fetched_at", F.coalesce("job_title", F.lit("")))).alias("r")).select("_row_id", "r.*")
    return mapping.map_feed_b(latest)


def mapped_feed_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_b(spark, sf_dir).select("source_id", "company", "location", "posted_date", F.col("extra.country").alias("country"))


def feed_b_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_b(spark, sf_dir).select("source_id", "requirements_raw", F.size("extra.skills_given").alias("n_skills"))


def dedup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.records(spark, sf_dir).select("rec_no", mapping.record_id().alias("record_id"), mapping.dedup_key().alias("dedup_key"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.companies_of(pipeline.records(spark, sf_dir))


def record_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pipeline.records(spark, sf_dir)
    return warehouse.locations_of(r, F.struct(F.col("location").alias("city"), F.col("source").alias("country"))).select("location_id", "location_key", "location_raw")


def jobs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pipeline.records(spark, sf_dir)
    c, p = companies(spark, sf_dir), record_locations(spark, sf_dir)
    return warehouse.jobs_of(r, c, p).select("job_id", "company_id", "location_id", "posted_date")


def pay_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pipeline.records(spark, sf_dir)
    return r.select("rec_no", pay.salary(F.col("salary_raw"), F.col("source")).alias("s")).select("rec_no", "s.*")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.records(spark, sf_dir).select("rec_no", F.posexplode("extra.skills_given").alias("p", "label")).select("label", F.struct("rec_no", "p").alias("pos"))


def label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.display_names(dictionary.name_counts(_labels(spark, sf_dir)))


def _mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "skills")
    soft = known.where("skill_type = 'soft'").select(F.col("canonical_name").alias("name")).distinct()
    roles = spark.createDataFrame([(r,) for r in ROLES], "name string")
    return dictionary.mine_skills(_labels(spark, sf_dir), roles, soft)


def mined_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mined(spark, sf_dir).withColumn("aliases", F.array_join("aliases", "|"))


def _groups(spark: SparkSession, mined: DataFrame) -> DataFrame:
    return dictionary.variant_groups(mined, spark.createDataFrame(MERGES, "a string, b string"), spark.createDataFrame(PROTECTED, "a string, b string"))


def variant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, cut_lineage(_mined(spark, sf_dir)))


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(merged skills, old_id -> new_id) of the mined dictionary joined by the skills of the table."""
    listed = warehouse.latest(table(spark, sf_dir, "skills"), "skill_id").where("NOT coalesce(is_category, false) AND trim(canonical_name) <> ''")
    entries = listed.select("canonical_name", "skill_type", F.array().cast("array<string>").alias("aliases"))
    full = cut_lineage(dictionary.add_entries(cut_lineage(_mined(spark, sf_dir)), entries))
    flat = full.select("*", F.lit(None).cast("string").alias("parent_skill_id"), F.lit(False).alias("is_category"))
    return dictionary.merge_variants(flat, cut_lineage(_groups(spark, full)))


def merged_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary from labels to categories: mined, joined by the skills of the table, spellings merged, placed in a tree."""
    tree = spark.createDataFrame(TREE, "child string, parent string")
    placed, _ = dictionary.assign_parents(cut_lineage(_merged(spark, sf_dir)[0]), tree, SOFT_ROOT)
    return placed.select("skill_id", "canonical_name", "skill_type", F.array_join("aliases", "|").alias("aliases"), "is_category", "parent_skill_id")


def remapped_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches of all jobs under the ids of the merged dictionary."""
    matches = table(spark, sf_dir, "job_skills").where("job_id IS NOT NULL AND skill_id IS NOT NULL")
    matches = matches.select(F.col("job_id").alias("record_id"), "skill_id", F.col("extraction_method").alias("method"), F.col("match_id").alias("pos"))
    return dictionary.remap_matches(matches, _merged(spark, sf_dir)[1])


def skill_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.skill_variants(_mined(spark, sf_dir))


def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.closure(hierarchy.unfold_paths(hierarchy.latest_parents(table(spark, sf_dir, "skills"))))


def closure_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "skill_closure").where("ancestor_id IS NOT NULL")
    return quality.closure_mismatch(stored, closure(spark, sf_dir)).groupBy("only_in").agg(F.count("*").alias("n"))


def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.integrity_checks(warehouse.opened(spark, sf_dir))


def orphan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of all keys."""
    return integrity(spark, sf_dir).where("label LIKE 'key %'").select("label", "n")


def gate_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.gate_problems(warehouse.opened(spark, sf_dir))


def empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [quality.empty_columns(table(spark, sf_dir, t).select(*columns), t) for t, columns in AUDITED.items()])


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that sources give as annotations of their records; labels outside the dictionary are unresolved terms."""
    r = pipeline.records(spark, sf_dir).select(F.col("rec_no").cast("string").alias("task_id"), F.coalesce("source", F.lit("")).alias("source"), F.lit("test").alias("split"), F.col("extra.skills_given").alias("labels"))
    tasks = r.where(F.size("labels") > 0)
    aliases = extract.aliases_of(warehouse.latest(table(spark, sf_dir, "skills"), "skill_id")).select("alias", "skill_id")
    each = tasks.select("task_id", F.explode("labels").alias("label")).where(F.trim("label") != "").join(aliases, norm_text("label") == F.col("alias"), "left")
    found = each.groupBy("task_id").agg(F.collect_set("skill_id").alias("skill_ids"), F.collect_set(F.when(F.col("skill_id").isNull(), norm_text("label"))).alias("unresolved_terms"))
    return quality.gold_labels(tasks, found.select("task_id", F.lit("complete").alias("status"), "skill_ids", "unresolved_terms"), complete=False)


def gold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir)


def gold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.coverage(_gold(spark, sf_dir))


def gold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, predicted = quality.masked_matches(*_masked(spark, sf_dir))
    return quality.score_gold(cut_lineage(_gold(spark, sf_dir)), predicted.withColumn("record_id", F.col("record_id").cast("string")))


def annotation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches of a job read as an annotation of it by their source."""
    tasks = warehouse.latest(table(spark, sf_dir, "jobs"), "job_id").select(F.col("job_id").alias("task_id"))
    skills = warehouse.latest(table(spark, sf_dir, "skills"), "skill_id")
    matches = table(spark, sf_dir, "job_skills").where("job_id IS NOT NULL AND skill_id IS NOT NULL")
    labels = matches.groupBy(F.col("job_id").alias("task_id"), F.col("source").alias("annotator")).agg(F.collect_set("skill_id").alias("skill_ids"), F.min("confidence").alias("c"))
    return quality.validate_annotations(tasks, labels.withColumn("status", F.when(F.col("c") >= 90, "complete").when(F.col("c").isNotNull(), "draft")), skills)


def frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tables an evaluation rests on, and whether their content is still what it was, whatever its order."""
    tables = {t: table(spark, sf_dir, t) for t in ("skills", "job_records", "eval_items")}
    tables["job_records"] = tables["job_records"].withColumn("extra", F.to_json("extra"))
    now = quality.freeze({t: df.repartition(3) for t, df in tables.items()}).select("table_name", F.col("hash").alias("h"))
    return quality.freeze(tables).join(now, "table_name").select("table_name", "n", (F.col("hash") == F.col("h")).alias("same"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.evaluation_report(masked_evaluation(spark, sf_dir), retrieval(spark, sf_dir), integrity(spark, sf_dir))


def _masked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = pipeline.records(spark, sf_dir).select(F.col("rec_no").alias("record_id"), "source", "title", "requirements_raw", "description", F.col("extra.skills_given").alias("labels"))
    return cut_lineage(spread(r)), cut_lineage(extract.aliases_of(warehouse.latest(table(spark, sf_dir, "skills"), "skill_id")))


def masked_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.masked_evaluation(*_masked(spark, sf_dir))


def masked_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.masked_methods(*_masked(spark, sf_dir))


def match_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy matches against all exact ones: scores of the set operators on a large table."""
    f = table(spark, sf_dir, "job_skills").where("job_id IS NOT NULL AND skill_id IS NOT NULL").select(F.col("job_id").alias("record_id"), "source", "skill_id", "extraction_method")
    return quality.extraction_scores(f.where("extraction_method <> 'fuzzy_match'"), f.where("extraction_method <> 'source_provided'"))


def method_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "job_skills").select(F.col("job_id").alias("record_id"), "skill_id", F.col("extraction_method").alias("method"))
    gold = table(spark, sf_dir, "job_skills").where("confidence >= 95").select(F.col("job_id").alias("record_id"), "skill_id")
    return quality.method_precision(gold, f)


def retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of all skills that are searched by their own name, by kind of skill."""
    w = warehouse.opened(spark, sf_dir)
    typed = w.skills.select(F.col("canonical_name").alias("q"), F.col("skill_type").alias("kind"), F.col("skill_id").alias("expect_skill"))
    return quality.retrieval_scores(serving.search_quality(w, typed))


def length_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").alias("source_id"), "n_chars")
    return quality.length_bands(d, F.col("n_chars")).groupBy("source", "length_band").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))


def sample_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pipeline.records(spark, sf_dir)
    first = W.partitionBy("source", "source_id").orderBy("rec_no")
    return quality.sample_tasks(r.withColumn("k", F.row_number().over(first)).where("k = 1"), per_source=30)


def oov_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "skills").select("canonical_name").distinct().select("canonical_name", quality.oov_skill_id(F.col("canonical_name")).alias("oov_id"))


def place_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "locations").select("location_id", serving.place_label(F.col("city"), F.col("country"), F.col("location_raw")).alias("label"))


_LABELS = "SELECT trim(l) AS name, {norm} AS folded, (rec_no, p) AS pos FROM (SELECT rec_no, unnest(extra.skills_given) AS l, generate_subscripts(extra.skills_given, 1) AS p FROM job_records) WHERE trim(l) <> ''".replace("{norm}", pipeline._norm("l"))
_CLOSURE = """
WITH RECURSIVE latest AS (
  SELECT skill_id AS id, nullif(parent_skill_id, '') AS p FROM skills WHERE skill_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY skill_id ORDER BY loaded_at DESC NULLS LAST, nullif(parent_skill_id, '') DESC NULLS LAST) = 1),
e AS (SELECT l.id, k.id AS parent FROM latest l LEFT JOIN latest k ON l.p = k.id),
up(id, node, steps, trail, looped) AS (
  SELECT id, id, 0, [id], false FROM e
  UNION ALL SELECT u.id, e.parent, u.steps + 1, list_append(u.trail, e.parent), false FROM up u JOIN e ON e.id = u.node WHERE e.parent IS NOT NULL AND NOT list_contains(u.trail, e.parent)),
ended AS (SELECT u.id, u.trail, list_position(u.trail, e.parent) AS ring FROM up u JOIN e ON e.id = u.node WHERE e.parent IS NULL OR list_contains(u.trail, e.parent)),
closed AS (SELECT u.node AS ancestor_id, u.id AS descendant_id, CAST(u.steps AS INTEGER) AS depth FROM up u JOIN ended d ON d.id = u.id WHERE d.ring IS NULL OR u.steps < d.ring)
"""

_COMPANIES = f"c0 AS (SELECT {pipeline._norm('company')} AS name_norm, company AS name, extra.industry AS industry, rec_no FROM job_records), c1 AS (SELECT * FROM c0 WHERE name_norm <> '' QUALIFY row_number() OVER (PARTITION BY name_norm ORDER BY rec_no) = 1), c AS (SELECT row_number() OVER (ORDER BY rec_no) AS company_id, name, name_norm, industry FROM c1)"
_LOCATION_KEY = f"CASE WHEN coalesce(location, '') <> '' THEN {pipeline._norm('location')} || '|' || coalesce(CAST(extra.province_id AS VARCHAR), '') END"
_PLACES = f"l0 AS (SELECT {_LOCATION_KEY} AS location_key, location AS location_raw, rec_no FROM job_records), l1 AS (SELECT * FROM l0 WHERE location_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY location_key ORDER BY rec_no) = 1), l AS (SELECT row_number() OVER (ORDER BY rec_no) AS location_id, location_key, location_raw FROM l1)"
_PAY_NUMBERS = "list_transform(regexp_extract_all(salary_raw, '[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda x: CAST(replace(x, ',', '') AS DOUBLE))"

_PLAIN = oracles.ascii_only("salary_raw")
_LOW = f"coalesce(list_min({_PAY_NUMBERS}), 0)"
_FEED = lambda i: "CASE source " + " ".join(f"WHEN '{s}' THEN '{u[i]}'" for s, u in pay.FEED_UNITS.items()) + " END"
_SALARY = f"""SELECT rec_no, list_min({_PAY_NUMBERS}) AS low, list_max({_PAY_NUMBERS}) AS high,
  CASE WHEN coalesce(salary_raw, '') <> '' THEN CASE WHEN contains({_PLAIN}, 'usd') OR contains(salary_raw, '$') THEN CASE WHEN {_LOW} >= 1000000 THEN 'VND' ELSE 'USD' END
    WHEN regexp_matches(lower(salary_raw), 'vnd|vnđ|đ|trieu|triệu') THEN 'VND' WHEN {_FEED(0)} = 'USD' AND {_LOW} >= 1000000 THEN 'VND' ELSE {_FEED(0)} END END AS currency,
  CASE WHEN coalesce(salary_raw, '') <> '' THEN {_FEED(1)} END AS period FROM job_records"""
_QUOTED = """(?:'(?:[^'\\\\]|\\\\.)*'|"(?:[^"\\\\]|\\\\.)*")"""
_FEED_B_SKILLS = """WITH d AS (SELECT _row_id, job_skills FROM data_jobs QUALIFY row_number() OVER (PARTITION BY _row_id ORDER BY fetched_at DESC NULLS LAST, coalesce(job_title, '') DESC) = 1),
  v AS (SELECT _row_id, CASE WHEN regexp_matches(job_skills, '^\\s*\\[\\s*(?:{q}\\s*(?:,\\s*{q}\\s*)*)?\\]') THEN list_transform(regexp_extract_all(job_skills, '{q}'),
    lambda x: replace(replace(replace(x[2:-2], '\\"', '"'), '\\' || chr(39), chr(39)), '\\\\', '\\')) ELSE [] END AS l FROM d)
  SELECT CAST(_row_id AS VARCHAR) AS source_id, nullif(array_to_string(l, ', '), '') AS requirements_raw, CAST(len(l) AS INTEGER) AS n_skills FROM v""".replace("{q}", _QUOTED.replace("'", "''"))
_MINED = f"""WITH RECURSIVE lc AS (SELECT folded, name, count(*) AS n, min(pos) AS f FROM ({_LABELS}) GROUP BY 1, 2),
  dn AS (SELECT folded, name FROM lc WHERE folded NOT IN ({', '.join(repr(r) for r in ROLES)}) QUALIFY row_number() OVER (PARTITION BY folded ORDER BY name <> lower(name) DESC, n DESC, f) = 1),
  so AS (SELECT DISTINCT {oracles.norm('canonical_name')} AS folded FROM skills WHERE skill_type = 'soft'),
  ms AS (SELECT {oracles.slug('name')} AS skill_id, arg_min(name, folded) AS canonical_name, CASE WHEN arg_min(folded IN (SELECT folded FROM so), folded) THEN 'soft' ELSE 'hard' END AS skill_type, list_sort(list(DISTINCT folded)) AS aliases FROM dn GROUP BY 1)
"""
_PAIRS = lambda pairs: ", ".join(f"('{a}', '{b}')" for a, b in pairs)
_GROUPED = f""", vk AS (SELECT *, {oracles.norm('canonical_name')} AS name, regexp_replace({oracles.norm('canonical_name')}, '[\\s_.-]', '', 'g') AS core FROM ms),
  vs AS (SELECT *, CASE WHEN suffix(core, 'js') AND length(core) >= 5 THEN left(core, length(core) - 2) ELSE core END AS key FROM vk),
  ow AS (SELECT alias, min(skill_id) AS skill_id, arg_min(name, skill_id) AS name FROM (SELECT unnest(list_append(aliases, name)) AS alias, skill_id, name FROM vs) GROUP BY 1),
  he AS (SELECT key, skill_type, min(skill_id) AS a, arg_min(name, skill_id) AS na FROM vs GROUP BY 1, 2),
  l0 AS (SELECT he.a, vs.skill_id AS b, he.na, vs.name AS nb FROM vs JOIN he ON he.key = vs.key AND he.skill_type = vs.skill_type
    UNION ALL SELECT x.skill_id, y.skill_id, x.name, y.name FROM (VALUES {_PAIRS(MERGES)}) AS m(p, q) JOIN ow x ON x.alias = m.p JOIN ow y ON y.alias = m.q),
  l1 AS (SELECT a, b FROM l0 WHERE a <> b AND NOT EXISTS (SELECT 1 FROM (VALUES {_PAIRS(PROTECTED)}) AS k(p, q) WHERE least(p, q) = least(na, nb) AND greatest(p, q) = greatest(na, nb))),
  l2 AS (SELECT a, b FROM l1 UNION SELECT b, a FROM l1),
  rc(a, b) AS (SELECT a, b FROM l2 UNION SELECT r.a, l2.b FROM rc r JOIN l2 ON r.b = l2.a),
  gp AS (SELECT ms.skill_id, coalesce(g, ms.skill_id) AS "group" FROM ms LEFT JOIN (SELECT a, least(a, min(b)) AS g FROM rc GROUP BY a) x ON x.a = ms.skill_id)
"""
_VARIANTS = _MINED + _GROUPED + ' SELECT skill_id, "group" FROM gp'
# the mined skills (m0), joined by the skills of the table, are the skills (ms) that are grouped and merged
_MERGED = _WAREHOUSE_SQL.replace("WITH sk0", "WITH RECURSIVE sk0", 1) + _MINED.replace("WITH RECURSIVE lc AS", ", lc AS", 1).replace("ms AS (", "m0 AS (", 1) + f""", en AS (SELECT canonical_name, skill_type, {oracles.norm('canonical_name')} AS form FROM sk1 WHERE NOT coalesce(is_category, false) AND trim(canonical_name) <> ''),
  eo AS (SELECT canonical_name, min(skill_id) AS owner FROM en JOIN (SELECT skill_id, unnest(aliases) AS form FROM m0) USING (form) GROUP BY 1),
  er AS (SELECT skill_id, canonical_name, skill_type, aliases, 0 AS o FROM m0 UNION ALL SELECT coalesce(owner, {oracles.slug('canonical_name')}), canonical_name, skill_type, [form], 1 FROM en LEFT JOIN eo USING (canonical_name)),
  ef AS (SELECT skill_id, canonical_name, skill_type FROM er QUALIFY row_number() OVER (PARTITION BY skill_id ORDER BY o, canonical_name, skill_type) = 1),
  ms AS (SELECT ef.*, l.aliases FROM ef JOIN (SELECT skill_id, list_sort(list_distinct(flatten(list(aliases)))) AS aliases FROM er GROUP BY 1) l USING (skill_id))
""" + _GROUPED + f""", mh AS (SELECT gp."group", ms.canonical_name, ms.skill_type FROM ms JOIN gp USING (skill_id) QUALIFY row_number() OVER (PARTITION BY gp."group" ORDER BY len(ms.aliases) DESC, ms.skill_id) = 1),
  mg AS (SELECT "group", {oracles.slug('canonical_name')} AS skill_id, canonical_name, skill_type, aliases FROM mh JOIN (SELECT gp."group", list_sort(list_distinct(flatten(list(ms.aliases)))) AS aliases FROM ms JOIN gp USING (skill_id) GROUP BY 1) USING ("group")),
  io AS (SELECT gp.skill_id AS old_id, mg.skill_id AS new_id FROM gp JOIN mg USING ("group"))
"""
_REMAPPED = _MERGED + """ SELECT record_id, skill_id, method, pos FROM (SELECT job_id AS record_id, coalesce(new_id, skill_id) AS skill_id, extraction_method AS method, match_id AS pos
    FROM job_skills LEFT JOIN io ON io.old_id = skill_id WHERE job_id IS NOT NULL AND skill_id IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY record_id, skill_id ORDER BY CASE method WHEN 'source_provided' THEN 0 WHEN 'exact_match' THEN 1 WHEN 'fuzzy_match' THEN 2 ELSE 3 END, pos) = 1"""
_DICTIONARY = _MERGED + f""", tr AS (SELECT * FROM (VALUES {_PAIRS(TREE)}) AS t(child, parent)),
  ma AS (SELECT alias, min(skill_id) AS skill_id FROM (SELECT skill_id, unnest(list_append(aliases, {oracles.norm('canonical_name')})) AS alias FROM mg) GROUP BY 1),
  nm AS (SELECT parent AS name FROM tr UNION SELECT '{SOFT_ROOT}'),
  fr AS (SELECT {oracles.slug('name')} AS skill_id, name AS canonical_name, CASE WHEN name = '{SOFT_ROOT}' THEN 'soft' ELSE 'hard' END AS skill_type, [{oracles.norm('name')}] AS aliases FROM nm WHERE {oracles.norm('name')} NOT IN (SELECT alias FROM ma)),
  fo AS (SELECT * FROM ma UNION ALL SELECT aliases[1], skill_id FROM fr),
  lk AS (SELECT c.skill_id AS cid, min(p.skill_id) AS pid FROM tr JOIN fo c ON c.alias = {oracles.norm('child')} JOIN fo p ON p.alias = {oracles.norm('parent')} WHERE c.skill_id <> p.skill_id GROUP BY 1)
  SELECT e.skill_id, canonical_name, skill_type, array_to_string(aliases, '|') AS aliases, is_category,
    coalesce(pid, CASE WHEN skill_type = 'soft' AND e.skill_id <> {oracles.slug(repr(SOFT_ROOT))} THEN {oracles.slug(repr(SOFT_ROOT))} END) AS parent_skill_id
  FROM (SELECT skill_id, canonical_name, skill_type, aliases, false AS is_category FROM mg UNION ALL SELECT *, true FROM fr) e LEFT JOIN lk ON lk.cid = e.skill_id"""
AUDITED = {
    "jobs": "job_id title_raw location_id posted_date source url seniority job_type loaded_at deleted_at".split(),
    "skills": "skill_id canonical_name skill_type category parent_skill_id is_category loaded_at deleted_at".split(),
    "skill_closure": "closure_no ancestor_id descendant_id depth built_at".split(),
    "job_skills": "match_id job_id skill_id skill_type source extraction_method confidence evidence_snippet loaded_at".split(),
    "data_jobs": "_row_id job_title job_title_short company_name job_location job_country job_skills job_posted_date salary_year_avg job_schedule_type fetched_at".split(),
    "job_records": "rec_no source source_id url title company location salary_raw level job_type description requirements_raw posted_date crawled_at".split(),
    "documents": "doc_id text lang source n_chars employer_key published_at collected_at".split(),
}
_AUDIT = " UNION ALL ".join(f"SELECT '{t}.{c}' AS column_name FROM {t} HAVING count({c}) = 0" for t, columns in AUDITED.items() for c in columns)
_KEYS = (
    ("job_skills.skill_id", "w_facts", "skill_id", "w_skills", "skill_id"), ("job_skills.job_id", "w_facts", "job_id", "w_jobs", "job_id"), ("jobs.location_id", "w_jobs", "location_id", "locations", "location_id"),
    ("jobs.company_id", "w_jobs", "company_id", "w_companies", "company_id"), ("variants.skill_id", "w_variants", "skill_id", "w_skills", "skill_id"), ("skills.parent_skill_id", "w_skills", "parent_skill_id", "w_skills", "skill_id"),
    ("closure.ancestor_id", "w_closure", "ancestor_id", "w_skills", "skill_id"), ("closure.descendant_id", "w_closure", "descendant_id", "w_skills", "skill_id"), ("terms.skill_id", "terms", "skill_id", "w_skills", "skill_id"),
)
_KEY_CHECKS = " UNION ALL ".join(f"SELECT 'key {label}' AS label, count(*) AS n FROM {t} x WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {u} y WHERE y.{d} = x.{c})" for label, t, c, u, d in _KEYS)
_W_VARIANTS = ", w_variants AS (SELECT DISTINCT skill_id, canonical_name FROM skills WHERE trim(canonical_name) <> '' AND skill_id IN (SELECT skill_id FROM w_skills))"
_KEY_SQL = _WAREHOUSE_SQL + _TERMS_SQL + _W_VARIANTS + f", kc AS ({_KEY_CHECKS})"
_W_EMPTY = " UNION ALL ".join(
    f"SELECT 'x' AS c FROM {t} HAVING count({c}) = 0"
    for t, columns in (("sk1", ("skill_id", "loaded_at", "canonical_name", "skill_type", "parent_skill_id", "is_category", "deleted_at")), ("w_skills", ("category",)), ("w_jobs", (*AUDITED["jobs"], "company_id")))
    for c in columns
)
_INTEGRITY = _KEY_SQL + f""", ic AS (SELECT label, n = 0 AS ok, n FROM kc
  UNION ALL SELECT 'closure rows of depth 0 beyond one a skill', n = 0, n FROM (SELECT (SELECT count(*) FROM w_closure WHERE depth = 0) - (SELECT count(*) FROM w_skills) AS n)
  UNION ALL SELECT 'skills without a closure row of their own', n = 0, n FROM (SELECT count(*) AS n FROM w_skills WHERE skill_id NOT IN (SELECT descendant_id FROM w_closure WHERE depth = 0 AND descendant_id IS NOT NULL))
  UNION ALL SELECT 'levels of the closure', n >= 2, n FROM (SELECT coalesce(max(depth), 0) AS n FROM w_closure)
  UNION ALL SELECT 'skills with a parent', n > 0, n FROM (SELECT count(*) AS n FROM w_skills WHERE parent_skill_id IS NOT NULL)
  UNION ALL SELECT 'categories extracted as skills', n = 0, n FROM (SELECT count(*) AS n FROM w_facts WHERE skill_id IN (SELECT skill_id FROM w_skills WHERE is_category))
  UNION ALL SELECT 'skills without search terms', n = 0, n FROM (SELECT count(*) AS n FROM w_skills WHERE skill_id NOT IN (SELECT skill_id FROM terms))
  UNION ALL SELECT 'skills not found without accents', n = 0, n FROM (SELECT count(*) AS n FROM w_skills s WHERE {oracles.ascii_only('canonical_name')} <> '' AND NOT EXISTS (SELECT 1 FROM terms t WHERE t.skill_id = s.skill_id AND t.term = {oracles.ascii_only('s.canonical_name')}))
  UNION ALL SELECT 'ids that are no slug of the name', n = 0, n FROM (SELECT count(*) AS n FROM w_skills WHERE skill_id <> {oracles.slug('canonical_name')})
  UNION ALL SELECT 'columns without any value', n = 0, n FROM (SELECT count(*) AS n FROM ({_W_EMPTY})))
"""
_MUST = " OR ".join(f"starts_with(label, '{m}')" for m in quality.MUST)
_RETRIEVAL = _WAREHOUSE_SQL + _TERMS_SQL + f""", ty AS (SELECT canonical_name AS q, skill_type AS kind, skill_id AS expect_skill, {oracles.ascii_only('canonical_name')} AS t FROM w_skills),
  ak AS (SELECT DISTINCT t, replace(t, ' ', '') AS tc FROM ty WHERE t <> ''),
  tm AS (SELECT DISTINCT term FROM terms),
  hm AS (SELECT t, term, CASE WHEN term IN (t, tc) THEN 3 WHEN starts_with(term, t) OR starts_with(term, tc) THEN 2 ELSE 1 END AS r FROM ak JOIN tm ON contains(term, t) OR contains(term, tc)),
  hs AS (SELECT t, skill_id, max(r) AS r FROM hm JOIN terms USING (term) GROUP BY 1, 2),
  pl AS (SELECT q, skill_id, row_number() OVER (PARTITION BY q ORDER BY r DESC, length(canonical_name), canonical_name, skill_id) AS place FROM (SELECT DISTINCT q, t FROM ty WHERE t <> '') JOIN hs USING (t) JOIN (SELECT skill_id, canonical_name FROM w_skills) USING (skill_id)),
  rk AS (SELECT ty.kind, coalesce(place, 0) AS rank FROM ty LEFT JOIN pl ON pl.q = ty.q AND pl.skill_id = ty.expect_skill AND place <= 20)
  SELECT kind, count(*) AS n, avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0 END) AS mrr, avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END) AS p_at_1, count(*) FILTER (rank = 0) AS misses FROM rk GROUP BY ROLLUP (kind)"""
_JSON = lambda c: f"CASE WHEN {c} IS NULL THEN 'null' ELSE CAST(to_json({c}) AS VARCHAR) END"
_ORDER = lambda seed: f"sha256(concat_ws('|', '{seed}', source, source_id))"
_TASKS = f"""WITH f AS (SELECT *, length(coalesce(title, '')) + length(coalesce(requirements_raw, '')) + length(coalesce(description, '')) AS len FROM job_records QUALIFY row_number() OVER (PARTITION BY source, source_id ORDER BY rec_no) = 1),
  b AS (SELECT *, ntile(3) OVER (PARTITION BY source ORDER BY len, source_id) AS third FROM f WHERE len > 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY source, third ORDER BY {_ORDER(5420)}, source_id) AS r FROM b)
  SELECT concat_ws(':', source, source_id) AS task_id, source, source_id, ['short', 'medium', 'long'][third] AS length_band, CASE WHEN r <= 3 THEN 'development' ELSE 'test' END AS split,
    sha256('{{"description": ' || {_JSON('description')} || ', "requirements_raw": ' || {_JSON('requirements_raw')} || ', "title": ' || {_JSON('title')} || '}}') AS input_sha256,
    CAST(row_number() OVER (ORDER BY {_ORDER(5421)}, source_id) AS INTEGER) AS "order" FROM r WHERE r <= 10"""
_LABELLED = "coalesce(len(extra.skills_given), 0) > 0"
_EXTRACTED = (
    _WAREHOUSE_SQL + oracles.ALIASES + oracles.LABELS
    + oracles.exact(f"SELECT rec_no AS record_id, CASE WHEN source = 'data_jobs' THEN coalesce(title, '') ELSE {oracles.RECORD_TEXT} END AS text FROM job_records WHERE {_LABELLED}")
    + oracles.fuzzy(f"SELECT rec_no AS record_id, {oracles.RECORD_TEXT} AS text FROM job_records")
    + ", pr AS (SELECT e.record_id, r.source, e.skill_id, e.method FROM (SELECT * FROM ex UNION ALL SELECT * FROM fz) e JOIN job_records r ON r.rec_no = e.record_id)"
    + f", gl AS (SELECT DISTINCT CAST(lb.record_id AS VARCHAR) AS record_id, coalesce(lb.source, '') AS source, 'test' AS split, coalesce(al.skill_id, 'oov:' || left(sha256({oracles.norm('lb.label')}), 16)) AS skill_id FROM lb LEFT JOIN al ON al.alias = {oracles.norm('lb.label')} WHERE trim(lb.label) <> '')"
)
_MASKED = _EXTRACTED + ", sc AS (" + oracles.scores("SELECT record_id, source, skill_id FROM lm", "SELECT record_id, source, skill_id FROM pr") + ")"
_ALL = lambda q: f"SELECT record_id, source, skill_id FROM ({q}) UNION ALL SELECT record_id, 'all', skill_id FROM ({q})"
_PREDICTED = _ALL("SELECT CAST(record_id AS VARCHAR) AS record_id, source, skill_id FROM pr")
_GOLD_SCORES = _EXTRACTED + " SELECT 'end_to_end' AS vocabulary, * FROM (" + oracles.scores(_ALL("SELECT * FROM gl"), _PREDICTED) + ") UNION ALL SELECT 'in_vocabulary', * FROM (" + oracles.scores(_ALL("SELECT * FROM gl WHERE NOT starts_with(skill_id, 'oov:')"), _PREDICTED) + ")"
_LONG = lambda section, name, metrics, source: " UNION ALL ".join(f"SELECT '{section}' AS section, {name} AS name, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {source}" for m in metrics)
_REPORT = (
    "WITH se AS (" + _MASKED + " SELECT * FROM sc), sr AS (" + _RETRIEVAL + "), si AS (" + _INTEGRITY + " SELECT * FROM ic) "
    + _LONG("extraction", "source", ("tp", "fp", "fn", "precision", "recall", "f1", "macro_f1"), "se") + " UNION ALL "
    + _LONG("retrieval", "coalesce(kind, 'all')", ("n", "mrr", "p_at_1", "misses"), "sr") + " UNION ALL " + _LONG("integrity", "label", ("ok", "n"), "si")
)
_PROBLEMS = _WAREHOUSE_SQL + """, an AS (SELECT job_id AS task_id, source AS annotator, min(confidence) AS c, list(DISTINCT skill_id) AS ids FROM job_skills WHERE job_id IS NOT NULL AND skill_id IS NOT NULL GROUP BY 1, 2)
  SELECT task_id, 'repeated' AS problem FROM an GROUP BY 1 HAVING count(*) > 1
  UNION SELECT task_id, 'no such task' FROM an WHERE task_id NOT IN (SELECT job_id FROM w_jobs)
  UNION SELECT task_id, 'bad status' FROM an WHERE c IS NULL
  UNION SELECT task_id, 'unknown skill' FROM (SELECT task_id, unnest(ids) AS i FROM an) WHERE i NOT IN (SELECT skill_id FROM w_skills)
  UNION SELECT task_id, 'no annotator' FROM an WHERE trim(coalesce(annotator, '')) = ''"""

QUERIES = {
    "a16_companies": (companies, f"WITH {_COMPANIES} SELECT company_id, name, name_norm, industry FROM c"),
    "a16_locations": (record_locations, f"WITH {_PLACES} SELECT location_id, location_key, location_raw FROM l"),
    "j14_jobs": (jobs_table, f"WITH {_COMPANIES}, {_PLACES} SELECT concat_ws(':', source, source_id) AS job_id, company_id, location_id, posted_date FROM job_records r LEFT JOIN c ON c.name_norm = {pipeline._norm('company')} LEFT JOIN l ON l.location_key = {_LOCATION_KEY}"),
    "proj_salary_range": (lambda spark, d: pay_fields(spark, d).select("rec_no", "low", "high"), f"SELECT rec_no, list_min({_PAY_NUMBERS}) AS low, list_max({_PAY_NUMBERS}) AS high FROM job_records"),
    "proj_salary": (pay_fields, _SALARY),
    "map_feed_b": (mapped_feed_b, """SELECT CAST(_row_id AS VARCHAR) AS source_id, company_name AS company, job_location AS location,
        CASE WHEN regexp_matches(left(job_posted_date, 10), '^\\d{4}-\\d{2}-\\d{2}$') THEN TRY_CAST(left(job_posted_date, 10) AS DATE) END AS posted_date, job_country AS country
        FROM data_jobs QUALIFY row_number() OVER (PARTITION BY _row_id ORDER BY fetched_at DESC NULLS LAST, coalesce(job_title, '') DESC) = 1"""),
    "map_feed_b_skills": (feed_b_skills, _FEED_B_SKILLS),
    "proj_dedup_key": (dedup_keys, f"SELECT rec_no, concat_ws(':', source, source_id) AS record_id, sha1({pipeline._norm('title')} || '|' || {pipeline._norm('company')}) AS dedup_key FROM job_records"),
    "a13_label_names": (label_names, f"""WITH c AS (SELECT folded, name, count(*) AS n, min(pos) AS f FROM ({_LABELS}) GROUP BY 1, 2)
        SELECT folded, name FROM c QUALIFY row_number() OVER (PARTITION BY folded ORDER BY name <> lower(name) DESC, n DESC, f) = 1"""),
    "m13_mined_skills": (mined_skills, _MINED + "SELECT skill_id, canonical_name, skill_type, array_to_string(aliases, '|') AS aliases FROM ms"),
    "m15_variant_groups": (variant_groups, _VARIANTS),
    "m17_dictionary": (merged_dictionary, _DICTIONARY),
    "j16_remapped_matches": (remapped_matches, _REMAPPED),
    "m33_skill_variants": (skill_variants, _MINED + "SELECT row_number() OVER (ORDER BY skill_id, p) AS variant_id, skill_id, aliases[p] AS surface_form FROM (SELECT skill_id, aliases, unnest(range(1, len(aliases) + 1)) AS p FROM ms)"),
    "m18_closure": (closure, _CLOSURE + "SELECT ancestor_id, descendant_id, depth FROM closed"),
    "m20_closure_mismatch": (closure_mismatch, _CLOSURE + """, s AS (SELECT DISTINCT ancestor_id, descendant_id FROM skill_closure WHERE ancestor_id IS NOT NULL AND descendant_id IS NOT NULL),
        m AS (SELECT 'built' AS only_in FROM (SELECT ancestor_id, descendant_id FROM closed EXCEPT SELECT * FROM s) UNION ALL SELECT 'stored' FROM (SELECT * FROM s EXCEPT SELECT ancestor_id, descendant_id FROM closed))
        SELECT only_in, count(*) AS n FROM m GROUP BY 1"""),
    "m28_integrity": (integrity, _INTEGRITY + "SELECT label, ok, n FROM ic"),
    "m27_gate_problems": (gate_problems, _INTEGRITY + f"SELECT label, n FROM ic WHERE NOT ok AND ({_MUST})"),
    "j8_orphans": (orphan_keys, _KEY_SQL + " SELECT label, n FROM kc"),
    "a22_empty_columns": (empty_columns, _AUDIT),
    "m21_masked_evaluation": (masked_evaluation, _MASKED + " SELECT * FROM sc"),
    "m21_masked_methods": (masked_methods, _EXTRACTED + " SELECT method, count(g.skill_id) AS hits, count(*) AS total, count(g.skill_id) / count(*)::DOUBLE AS precision FROM pr LEFT JOIN (SELECT DISTINCT record_id, skill_id FROM lm) g ON g.record_id = pr.record_id AND g.skill_id = pr.skill_id GROUP BY 1"),
    "a17_match_sets": (match_sets, """WITH f AS (SELECT DISTINCT job_id, source, skill_id, extraction_method AS m FROM job_skills WHERE job_id IS NOT NULL AND skill_id IS NOT NULL),
        g AS (SELECT DISTINCT job_id, source, skill_id FROM f WHERE m <> 'fuzzy_match'), p AS (SELECT DISTINCT job_id, source, skill_id FROM f WHERE m <> 'source_provided'),
        b AS (SELECT coalesce(g.job_id, p.job_id) AS job_id, coalesce(g.source, p.source) AS source, g.job_id IS NOT NULL AS ig, p.job_id IS NOT NULL AS ip FROM g FULL JOIN p ON (g.job_id, g.source, g.skill_id) = (p.job_id, p.source, p.skill_id)),
        r AS (SELECT source, job_id, count(*) FILTER (ig AND ip) AS tp, count(*) FILTER (ip AND NOT ig) AS fp, count(*) FILTER (ig AND NOT ip) AS fn FROM b GROUP BY 1, 2),
        q AS (SELECT source, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END) AS macro_f1, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM r GROUP BY 1)
        SELECT source, tp, fp, fn, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1, macro_f1 FROM q"""),
    "a19_method_precision": (method_precision, """WITH g AS (SELECT DISTINCT job_id, skill_id FROM job_skills WHERE confidence >= 95)
        SELECT extraction_method AS method, count(g.job_id) AS hits, count(*) AS total, count(g.job_id) / count(*)::DOUBLE AS precision
        FROM job_skills f LEFT JOIN g ON g.job_id = f.job_id AND g.skill_id = f.skill_id GROUP BY 1"""),
    "a20_retrieval": (retrieval, _RETRIEVAL),
    "m23_annotation_problems": (annotation_problems, _PROBLEMS),
    "m24_gold_labels": (gold_labels, _EXTRACTED + " SELECT * FROM gl"),
    "a21_gold_coverage": (gold_coverage, _EXTRACTED + " SELECT count(*) AS n_gold, count(*) FILTER (starts_with(skill_id, 'oov:')) AS n_oov, (count(*) - count(*) FILTER (starts_with(skill_id, 'oov:'))) / count(*)::DOUBLE AS coverage FROM gl"),
    "m25_gold_scores": (gold_scores, _GOLD_SCORES),
    "m26_frozen": (frozen, " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n, true AS same FROM {t}" for t in ("skills", "job_records", "eval_items"))),
    "q18_report": (report, _REPORT),
    "proj_length_bands": (length_bands, """WITH b AS (SELECT coalesce(source, '') AS source, n_chars, ['short', 'medium', 'long'][ntile(3) OVER (PARTITION BY coalesce(source, '') ORDER BY n_chars, doc_id)] AS length_band FROM documents)
        SELECT source, length_band, count(*) AS n, max(n_chars) AS longest FROM b GROUP BY 1, 2"""),
    "m22_sample_tasks": (sample_tasks, _TASKS),
    "proj_oov_ids": (oov_ids, f"SELECT DISTINCT canonical_name, 'oov:' || left(sha256({pipeline._norm('canonical_name')}), 16) AS oov_id FROM skills"),
    "proj_place_labels": (place_labels, "SELECT location_id, coalesce(nullif(concat_ws(' · ', nullif(city, ''), nullif(country, '')), ''), nullif(location_raw, ''), '—') AS label FROM locations"),
}


def queries() -> dict:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
