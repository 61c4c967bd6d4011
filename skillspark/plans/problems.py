"""Queries of the general data problems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillspark.operators import hierarchy, packed, references, units
from skillspark.operators.references import Reference
from skillspark.session import table

REFERENCES = (
    Reference("job_skills", "skill_id", "match_id", "loaded_at", "skills", "skill_id"),
    Reference("job_skills", "job_id", "match_id", "loaded_at", "jobs", "job_id"),
    Reference("skill_closure", "ancestor_id", "closure_no", "built_at", "skills", "skill_id"),
)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [references.find_orphans(table(spark, sf_dir, r.table), table(spark, sf_dir, r.target), r) for r in REFERENCES]
    return reduce(DataFrame.unionByName, parts)


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [references.report_orphans(table(spark, sf_dir, r.table), table(spark, sf_dir, r.target), r) for r in REFERENCES]
    return reduce(DataFrame.unionByName, parts)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a line is sent again with the same list: the latest one counts
    latest = F.max(F.struct("fetched_at", "job_skills")).getField("job_skills").alias("text")
    lists = table(spark, sf_dir, "data_jobs").where("_row_id IS NOT NULL").groupBy(F.col("_row_id").alias("row_id")).agg(latest)
    names = table(spark, sf_dir, "skills").select(F.col("canonical_name").alias("term"))
    return packed.unpack(lists, names.where(F.col("term").rlike(f"[{packed.DELIMITERS.strip()}]")).distinct())


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.annual_pay(
        table(spark, sf_dir, "job_records"),
        table(spark, sf_dir, "money_units"),
        table(spark, sf_dir, "period_units"),
        table(spark, sf_dir, "feed_units"),
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.unfold(hierarchy.latest_parents(table(spark, sf_dir, "skills")))


_P2_PART = """
SELECT '{0}' AS table_name, '{1}' AS column_name, r.{2} AS row_no, strftime(r.{3}, '%Y-%m') AS period
FROM {0} r WHERE r.{1} IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM {4} t WHERE t.{5} = r.{1} AND t.loaded_at <= r.{3} AND (t.deleted_at IS NULL OR t.deleted_at > r.{3}))
"""
P2_SQL = " UNION ALL ".join(_P2_PART.format(r.table, r.column, r.row_no, r.at, r.target, r.target_key) for r in REFERENCES)
P2_REPORT_SQL = f"SELECT table_name, column_name, period, count(*) AS n_orphans FROM ({P2_SQL}) GROUP BY ALL"

P7_SQL = """
WITH RECURSIVE latest AS (
  SELECT skill_id AS id, nullif(parent_skill_id, '') AS p FROM skills WHERE skill_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY skill_id ORDER BY loaded_at DESC NULLS LAST, nullif(parent_skill_id, '') DESC NULLS LAST) = 1),
e AS (SELECT l.id, k.id AS parent FROM latest l LEFT JOIN latest k ON l.p = k.id),
up(id, node, steps, trail) AS (
  SELECT id, id, 0, [id] FROM e
  UNION ALL
  SELECT u.id, e.parent, u.steps + 1, list_prepend(e.parent, u.trail)
  FROM up u JOIN e ON e.id = u.node WHERE e.parent IS NOT NULL AND NOT list_contains(u.trail, e.parent)),
ended AS (SELECT u.*, e.parent AS again FROM up u JOIN e ON e.id = u.node WHERE e.parent IS NULL OR list_contains(u.trail, e.parent)),
placed AS (
  SELECT id, trail, again, CASE WHEN again IS NULL THEN steps ELSE len(trail) - list_position(trail, again) END AS depth FROM ended),
named AS (
  SELECT id, depth, again,
    CASE WHEN again IS NULL THEN trail[1] ELSE list_min(trail[1:list_position(trail, again)]) END AS root_id,
    CASE WHEN again IS NULL THEN trail ELSE trail[list_position(trail, again):] END AS path FROM placed),
below AS (SELECT node AS id, count(*) - 1 AS n FROM up GROUP BY node)
SELECT n.id AS skill_id, n.root_id, CAST(n.depth AS INTEGER) AS depth, array_to_string(n.path, ' > ') AS path,
  CAST(b.n AS INTEGER) AS n_descendants, CAST(n.again IS NOT NULL AS INTEGER) AS in_cycle
FROM named n JOIN below b ON b.id = n.id
"""


# A quoted value; values of quoted lists and names of skills hide their commas and slashes while the rest is split.
_QUOTED = r'''(?:''(?:[^''\\]|\\.)*''|"(?:[^"\\]|\\.)*")'''
_NO_LIST = ", ".join("'" + x + "'" for x in sorted(packed.NO_LIST))
P5_SQL = r"""
WITH t AS (SELECT _row_id AS row_id, arg_max(job_skills, fetched_at) AS x FROM data_jobs WHERE _row_id IS NOT NULL GROUP BY 1),
b AS (SELECT row_id, trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS x FROM t WHERE x IS NOT NULL),
q AS (SELECT DISTINCT lower(replace(trim(v[2:-2]), '\', '')) AS v FROM (SELECT unnest(regexp_extract_all(x, '{Q}')) AS v FROM b WHERE regexp_full_match(x, '\[\s*{Q}\s*(?:,\s*{Q}\s*)*\]'))),
d AS (SELECT v FROM q UNION SELECT DISTINCT lower(canonical_name) FROM skills),
p AS (SELECT c, list('(?i)(' || regexp_escape(left(v, CAST(i AS BIGINT) - 1)) || ')' || regexp_escape(c) || '(' || regexp_escape(substr(v, CAST(i AS BIGINT) + 1)) || ')' ORDER BY length(v) DESC, v) AS l FROM (SELECT v, c, instr(v, c) AS i FROM d, (VALUES (','), ('/'), (';'), ('|')) AS cs(c)) WHERE i > 1 GROUP BY 1),
g1 AS (SELECT row_id, CASE WHEN starts_with(x, '[') AND suffix(x, ']') OR starts_with(x, '(') AND suffix(x, ')') OR starts_with(x, '{') AND suffix(x, '}') THEN x[2:-2] WHEN starts_with(x, '[') THEN x[2:] ELSE x END AS x FROM b WHERE lower(x) NOT IN ({NO})),
g2 AS (SELECT row_id, list_reduce(list_prepend(x, coalesce((SELECT l FROM p WHERE c = ','), [])), lambda a, r: regexp_replace(a, r, '\1' || chr(57344) || '\2', 'g')) AS x FROM g1),
g3 AS (SELECT row_id, list_reduce(list_prepend(x, coalesce((SELECT l FROM p WHERE c = '/'), [])), lambda a, r: regexp_replace(a, r, '\1' || chr(57345) || '\2', 'g')) AS x FROM g2),
s AS (SELECT row_id, string_split_regex(x, '[,;|\t\n\r\x0b\x0c•·、，；｜‖¦/]') AS l FROM g3),
i0 AS (SELECT row_id, i, trim(regexp_replace(trim(l[i]), '^(?:[-–—*▪◦‣●○■□➢>+]+\s+|\(?\d{1,3}[.)]\s+)', '')) AS v FROM (SELECT row_id, l, unnest(range(1, len(l) + 1)) AS i FROM s)),
i1 AS (SELECT row_id, i, trim(replace(CASE WHEN regexp_matches(v, '^"[\s\S]*"$|^''[\s\S]*''$|^“[\s\S]*”$|^‘[\s\S]*’$|^«[\s\S]*»$|^`[\s\S]*`$') AND length(v) > 1 THEN replace(v[2:-2], '""', '"') ELSE v END, '\', '')) AS v FROM i0),
i2 AS (SELECT row_id, i, replace(replace(v, chr(57344), ','), chr(57345), '/') AS item FROM i1 WHERE v <> '' AND lower(v) NOT IN ({NO}))
SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY i) AS INTEGER) AS pos, item FROM i2
""".replace("{Q}", _QUOTED).replace("{NO}", _NO_LIST)


def queries() -> dict:
    return {"p2_found": p2_found, "p2_report": p2_report, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p2_report": P2_REPORT_SQL, "p5_found": P5_SQL, "p7_found": P7_SQL}
