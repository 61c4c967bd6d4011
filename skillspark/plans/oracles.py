"""Building blocks of the oracle SQL: text rules, aliases and extraction, as DuckDB states them."""

from __future__ import annotations

from skillspark.functions import text

#: White space as the text functions know it.
BLANK = "[\\s\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]"
#: DuckDB counts edits in bytes, so each Vietnamese letter becomes one sign that tokens and titles do not use, and all other letters become one more.
_LETTERS = [c for c in text.ACCENTED if c in "đăâêôơưàáảãạằắẳẵặầấẩẫậèéẻẽẹềếểễệìíỉĩịòóỏõọồốổỗộờớởỡợùúủũụừứửữựỳýỷỹỵ"]
_SIGNS = [chr(c) for c in (*range(65, 91), *range(14, 32), *range(1, 9), 127)] + list("^~{}`$;=<>\"!?@%*[]|")


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '{BLANK}+', ' ', 'g'))"


def ascii_only(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(strip_accents(replace(lower(coalesce({x}, '')), 'đ', 'd')), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g'))"


def single_bytes(x: str) -> str:
    return f"regexp_replace(translate({x}, '{''.join(_LETTERS)}', '{''.join(_SIGNS[: len(_LETTERS)])}'), '[^\\x00-\\x7F]', '{_SIGNS[-1]}', 'g')"


def slug(x: str) -> str:
    named = norm(x)
    for sign, word in text.SLUG_SIGNS:
        named = f"replace({named}, '{sign}', '{word}')"
    return f"coalesce(nullif(regexp_replace(regexp_replace({ascii_only(named)}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'skill')"


#: al: aliases of skills that may be extracted; needs sk1 of the warehouse.
ALIASES = f""", al AS (SELECT * FROM (SELECT {norm('canonical_name')} AS alias, skill_id, canonical_name, skill_type FROM sk1 WHERE NOT coalesce(is_category, false)) WHERE alias <> ''
  QUALIFY row_number() OVER (PARTITION BY alias ORDER BY skill_id, canonical_name, skill_type) = 1)"""
#: lb: labels of records that are known.
LABELS = f""", lb AS (SELECT rec_no AS record_id, source, l AS label, CAST(p AS INTEGER) AS pos FROM (SELECT rec_no, source, unnest(extra.skills_given) AS l, generate_subscripts(extra.skills_given, 1) AS p FROM job_records)),
lm AS (SELECT lb.record_id, lb.source, al.skill_id, al.canonical_name, al.skill_type, lb.pos FROM lb JOIN al ON al.alias = {norm('label')})"""
RECORD_TEXT = "concat_ws(' ', nullif(title, ''), nullif(requirements_raw, ''), nullif(description, ''))"


def exact(source: str) -> str:
    """tk and ex: the tokens of (record_id, text) of a query, and its exact matches."""
    phrase = "CASE k WHEN 1 THEN t[i] WHEN 2 THEN t[i] || s[i + 1] || t[i + 1] WHEN 3 THEN t[i] || s[i + 1] || t[i + 1] || s[i + 2] || t[i + 2] ELSE t[i] || s[i + 1] || t[i + 1] || s[i + 2] || t[i + 2] || s[i + 3] || t[i + 3] END"
    return f""", src AS ({source}),
tk AS (SELECT record_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{text.TOKEN}') AS t, string_split_regex(coalesce(text, ''), '{text.TOKEN}') AS s FROM src),
st AS (SELECT record_id, t, s, unnest(range(1, len(t) + 1)) AS i FROM tk),
ph AS (SELECT record_id, i AS pos, k AS size, {norm(phrase)} AS alias FROM st, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE i + k - 1 <= len(t)),
ex AS (SELECT ph.record_id, al.skill_id, al.canonical_name, al.skill_type, 'exact_match' AS method, CAST(100 AS DOUBLE) AS score, CAST(ph.pos AS INTEGER) AS pos, ph.size FROM ph JOIN al USING (alias)
  QUALIFY row_number() OVER (PARTITION BY record_id, skill_id ORDER BY size DESC, pos) = 1)"""


def fuzzy(corpus: str = "SELECT record_id, text FROM src") -> str:
    """fz: fuzzy matches beside ex; corpus gives the (record_id, text) over which tokens are common."""
    edits = f"levenshtein({single_bytes('token')}, {single_bytes('alias')})"
    return f""", corpus AS ({corpus}),
df AS (SELECT token, count(*) AS n FROM (SELECT DISTINCT record_id, {norm('w')} AS token FROM (SELECT record_id, unnest(regexp_extract_all(coalesce(text, ''), '{text.TOKEN}')) AS w FROM corpus)) WHERE token <> '' GROUP BY 1),
cm AS (SELECT token FROM df WHERE n > greatest(3.0, 0.002 * (SELECT count(*) FROM corpus WHERE trim(coalesce(text, '')) <> ''))),
wd AS (SELECT record_id, i AS pos, {norm('t[i]')} AS token FROM st),
cv AS (SELECT DISTINCT record_id, unnest(range(pos, pos + size)) AS pos FROM ex),
fr AS (SELECT * FROM wd WHERE length(token) >= 5 AND NOT regexp_full_match(token, '[0-9]+') AND token NOT IN (SELECT token FROM cm)
  AND NOT EXISTS (SELECT 1 FROM cv WHERE cv.record_id = wd.record_id AND cv.pos = wd.pos)),
sg AS (SELECT * FROM al WHERE length(alias) >= 5 AND NOT contains(alias, ' ')),
sm AS (SELECT token, skill_id, canonical_name, skill_type, 100.0::DOUBLE * (1 - {edits}::DOUBLE / greatest(length(token), length(alias))) AS score, alias FROM (SELECT DISTINCT token FROM fr) JOIN sg
  ON abs(length(token) - length(alias)) <= floor(greatest(length(token), length(alias)) * (1 - 85.0::DOUBLE / 100)) AND {edits} <= floor(greatest(length(token), length(alias)) * (1 - 85.0::DOUBLE / 100))),
bs AS (SELECT * FROM sm QUALIFY row_number() OVER (PARTITION BY token ORDER BY score DESC, length(alias), alias DESC) = 1),
fz AS (SELECT fr.record_id, bs.skill_id, bs.canonical_name, bs.skill_type, 'fuzzy_match' AS method, round(score, 1) AS score, CAST(fr.pos AS INTEGER) AS pos, 1 AS size FROM fr JOIN bs USING (token)
  WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.record_id = fr.record_id AND ex.skill_id = bs.skill_id) QUALIFY row_number() OVER (PARTITION BY record_id, bs.skill_id ORDER BY fr.pos, score) = 1)"""


#: Where a match stands in its text, with up to 30 letters on both sides.
EVIDENCE = """trim(substring(text, CAST(greatest(begins - 30, 0) AS BIGINT) + 1, CAST(begins + width + 30 - greatest(begins - 30, 0) AS BIGINT)))"""
PLACE = """list_sum(list_transform(s[1:pos], lambda x: length(x))) + coalesce(list_sum(list_transform(t[1:pos - 1], lambda x: length(x))), 0) AS begins,
  list_sum(list_transform(t[pos:pos + size - 1], lambda x: length(x))) + coalesce(list_sum(list_transform(s[pos + 1:pos + size - 1], lambda x: length(x))), 0) AS width"""


def scores(gold: str, predicted: str) -> str:
    """(source, tp, fp, fn, precision, recall, f1, macro_f1) of two queries (record_id, source, skill_id)."""
    return f"""WITH g AS (SELECT DISTINCT record_id, source, skill_id FROM ({gold})), p AS (SELECT DISTINCT record_id, source, skill_id FROM ({predicted})),
b AS (SELECT coalesce(g.record_id, p.record_id) AS record_id, coalesce(g.source, p.source) AS source, g.record_id IS NOT NULL AS ig, p.record_id IS NOT NULL AS ip
  FROM g FULL JOIN p ON g.record_id = p.record_id AND g.source = p.source AND g.skill_id = p.skill_id),
r AS (SELECT source, record_id, count(*) FILTER (ig AND ip) AS tp, count(*) FILTER (ip AND NOT ig) AS fp, count(*) FILTER (ig AND NOT ip) AS fn FROM b GROUP BY 1, 2),
q AS (SELECT source, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END) AS macro_f1, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM r GROUP BY 1)
SELECT source, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
  CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, macro_f1 FROM q"""
