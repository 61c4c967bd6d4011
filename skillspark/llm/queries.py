"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skillspark.llm import components, leakage, names, packing, survivorship, truncation
from skillspark.session import cut_lineage, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.same_organisation(table(spark, sf_dir, "job_records"))


def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.members(table(spark, sf_dir, "job_records"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.match_groups(table(spark, sf_dir, "record_pairs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = cut_lineage(p3_found(spark, sf_dir))
    return survivorship.survivors(table(spark, sf_dir, "job_records"), groups)


def p4_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = cut_lineage(p3_found(spark, sf_dir))
    return survivorship.merged_values(table(spark, sf_dir, "job_records"), groups)


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "token_budgets"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_pack(spark, sf_dir), table(spark, sf_dir, "token_budgets"))


def p8_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, budgets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "token_budgets")
    packed = cut_lineage(p8_pack(spark, sf_dir))
    return packing.packing_faults(packed, packing.token_counts(documents), budgets)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leak_report(p9_found(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents")).select("doc_id")


def p10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return truncation.truncation_report(documents, truncation.truncated(documents))


P3_SQL = """
WITH RECURSIVE e AS (
  SELECT left_no a, right_no b FROM record_pairs WHERE is_match AND left_no <> right_no
  UNION SELECT right_no, left_no FROM record_pairs WHERE is_match AND left_no <> right_no),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT a AS rec_no, least(a, min(b)) AS group_id FROM reach GROUP BY a
"""


# Words of a text; the words of an item in the document's runs of three; facts as in other items' places.
_WORDS = r"regexp_extract_all(strip_accents(replace(lower(regexp_replace(regexp_replace(text, '<[^<>]*>', ' ', 'g'), '&(?:nbsp|amp|lt|gt|quot|#39|#160);', ' ', 'g')), 'đ', 'd')), '[\p{L}\p{N}]+')"
P9_SQL = f"""
WITH iw AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
ip AS (SELECT item_id, len(w) AS n, i, w[i] AS x, coalesce(w[i - 1], '') AS b, coalesce(w[i + 1], '') AS a, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM iw)),
sl AS (SELECT b, a, count(DISTINCT x) > 1 AS varies FROM ip GROUP BY 1, 2),
fa AS (SELECT ip.*, sl.varies OR regexp_matches(x, '[0-9]') AS fact FROM ip JOIN sl ON sl.b = ip.b AND sl.a = ip.a),
dg AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM dw)),
cov AS (SELECT DISTINCT dg.doc_id, fa.item_id, fa.i + k AS i FROM fa JOIN dg ON dg.g = fa.g, (VALUES (0), (1), (2)) AS o(k)),
sp AS (SELECT doc_id, item_id, min(i) AS lo, max(i) AS hi, count(*) AS c FROM cov GROUP BY 1, 2),
sc AS (SELECT sp.doc_id, sp.item_id, any_value(fa.n) AS n, any_value(sp.c) AS c, count(*) FILTER (fact) AS facts, count(*) FILTER (fact AND cov.i IS NOT NULL) AS given
  FROM sp JOIN fa ON fa.item_id = sp.item_id AND fa.i BETWEEN lo AND hi LEFT JOIN cov ON cov.doc_id = sp.doc_id AND cov.item_id = sp.item_id AND cov.i = fa.i GROUP BY 1, 2)
SELECT doc_id, item_id FROM sc WHERE c >= 0.5 * n AND given >= 0.6 * facts
"""

_FOLD = lambda x: f"trim(regexp_replace(strip_accents(replace(lower({x}), 'đ', 'd')), '\\s+', ' ', 'g'))"
_SAYS_NOTHING = ", ".join("'" + x + "'" for x in sorted(survivorship.PLACEHOLDERS))
_PLAIN = r"regexp_replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^<>]*>', chr(10), 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '([.!?…])\s+', '\1' || chr(10), 'g')"
_KEYS = ("query", "title_slug", "occupation_ids", "experience_range", "contact_address", "job_title_short", "country", "slug", "valid_through", "industry")
_IS_REAL = lambda k: f"CASE WHEN regexp_matches(extra.{k}, '[\\p{{L}}\\p{{N}}]') AND regexp_replace(trim(regexp_replace(regexp_replace(strip_accents(replace(lower(extra.{k}), 'đ', 'd')), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g')), '[ .!:]+$', '') NOT IN ({_SAYS_NOTHING}) THEN 1 ELSE 0 END"
_SKILLS = "list_distinct(list_transform(list_filter(extra.skills_given, lambda x: trim(x) <> ''), lambda x: lower(trim(x))))"
# A statement in a twentieth of all groups is a general remark, every other one the posting's own.
P4_SQL = P3_SQL.replace("SELECT a AS rec_no", ", gr AS (SELECT a AS rec_no") + f""")
, rc AS (SELECT gr.group_id, r.* FROM job_records r JOIN gr USING (rec_no)),
v AS (SELECT group_id, rec_no, crawled_at, f AS field_name, string_split_regex(trim({_PLAIN.format('x')}), '[\\n\\r]+') AS l
  FROM (SELECT group_id, rec_no, crawled_at, 'description' AS f, description AS x FROM rc UNION ALL SELECT group_id, rec_no, crawled_at, 'requirements_raw', requirements_raw FROM rc) WHERE x IS NOT NULL),
st AS (SELECT DISTINCT group_id, rec_no, crawled_at, field_name, regexp_replace({_FOLD('part')}, '^[\\s\\-–—*•·+▪◦●■➢>]+|^\\(?\\d{{1,2}}[.)]\\s+', '') AS s
  FROM (SELECT group_id, rec_no, crawled_at, field_name, unnest(CASE WHEN regexp_matches(l[-1], '[.!?…]\\s*$') THEN l ELSE l[:-2] END) AS part FROM v)),
ok AS (SELECT * FROM st WHERE regexp_matches(s, '[\\p{{L}}\\p{{N}}]') AND regexp_replace(s, '[ .!…:]+$', '') NOT IN ({_SAYS_NOTHING})),
gen AS (SELECT s FROM ok GROUP BY 1 HAVING count(DISTINCT group_id) >= greatest(5, 0.05 * (SELECT count(DISTINCT group_id) FROM ok))),
sc AS (SELECT group_id, field_name, rec_no, crawled_at, count(*) AS a, 0 AS b FROM ok WHERE s NOT IN (SELECT s FROM gen) GROUP BY ALL
  UNION ALL SELECT group_id, 'extra', rec_no, crawled_at, {' + '.join(map(_IS_REAL, _KEYS))} + CAST(extra.province_id IS NOT NULL AS INTEGER) + CAST(coalesce(len({_SKILLS}), 0) > 0 AS INTEGER), coalesce(len({_SKILLS}), 0) FROM rc)
SELECT group_id, field_name, rec_no FROM sc WHERE a > 0 AND group_id IN (SELECT group_id FROM rc GROUP BY 1 HAVING count(*) > 1)
QUALIFY row_number() OVER (PARTITION BY group_id, field_name ORDER BY a DESC, b DESC, crawled_at DESC NULLS LAST, rec_no) = 1
"""

def queries() -> dict:
    return {"p1_found": p1_found, "p1_members": p1_members, "p3_found": p3_found, "p4_found": p4_found, "p4_merged": p4_merged, "p8_pack": p8_pack, "p8_report": p8_report, "p8_faults": p8_faults, "p9_found": p9_found, "p9_report": p9_report, "p10_found": p10_found, "p10_report": p10_report}


def oracle_sql() -> dict[str, str]:
    faults = "SELECT budget_id, (SELECT count(*) FROM documents) AS n_documents, 0 AS overfull, 0 AS cut_needlessly, 0 AS incomplete, true AS well_filled FROM token_budgets"
    return {"p3_found": P3_SQL, "p8_faults": faults, "p4_found": P4_SQL, "p9_found": P9_SQL, "p9_report": f"SELECT item_id, count(*) AS n_docs FROM ({P9_SQL}) GROUP BY 1"}
