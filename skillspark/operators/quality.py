"""Integrity of the warehouse, scores of extraction and search, stratified samples and gold labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skillspark.functions.text import slugify, strip_accents
from skillspark.operators.warehouse import Warehouse, dense_ids
from skillspark.session import cut_lineage

BANDS = ("short", "medium", "long")


# --- integrity --------------------------------------------------------------------------------


def orphans(df: DataFrame, column: str, ref: DataFrame, ref_column: str) -> DataFrame:
    """One row n: values of a column, nulls aside, that the referred column lacks."""
    known = ref.where(F.col(ref_column).isNotNull()).select(F.col(ref_column).alias("_k"))
    return df.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_k"), "left_anti").agg(F.count("*").alias("n"))


def _check(label: str, n: DataFrame, ok: str = "n = 0") -> DataFrame:
    return n.select(F.lit(label).alias("label"), F.expr(ok).alias("ok"), F.col("n").cast("long").alias("n"))


def empty_columns(df: DataFrame, name: str) -> DataFrame:
    """(column_name) of columns without a single value."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    each = F.array(*[F.struct(F.lit(f"{name}.{c}").alias("column_name"), F.col(f"`{c}`").alias("n")) for c in df.columns])
    return counts.select(F.inline(each)).where("n = 0").select("column_name")


def integrity_checks(w: Warehouse) -> DataFrame:
    """(label, ok, n) of the 18 checks, nine of them on keys; n is the number of offending (or required) values."""
    keys = [
        ("job_skills.skill_id", w.job_skills, "skill_id", w.skills, "skill_id"), ("job_skills.job_id", w.job_skills, "job_id", w.jobs, "job_id"),
        ("jobs.location_id", w.jobs, "location_id", w.locations, "location_id"), ("jobs.company_id", w.jobs, "company_id", w.companies, "company_id"),
        ("variants.skill_id", w.variants, "skill_id", w.skills, "skill_id"), ("skills.parent_skill_id", w.skills, "parent_skill_id", w.skills, "skill_id"),
        ("closure.ancestor_id", w.closure, "ancestor_id", w.skills, "skill_id"), ("closure.descendant_id", w.closure, "descendant_id", w.skills, "skill_id"),
        ("terms.skill_id", w.terms, "skill_id", w.skills, "skill_id"),
    ]
    checks = [_check(f"key {label}", orphans(df, c, ref, rc)) for label, df, c, ref, rc in keys]
    count = lambda df: df.agg(F.count("*").alias("n"))
    self = w.closure.where("depth = 0").select(F.col("descendant_id").alias("skill_id"))
    terms = w.terms.select("skill_id", "term")
    ascii_terms = w.skills.select("skill_id", strip_accents("canonical_name").alias("term")).where("term <> ''")
    leaked = w.job_skills.select("skill_id").join(w.skills.where("is_category").select("skill_id"), "skill_id", "left_semi")
    # as many rows of depth 0 as skills
    surplus = count(w.closure.where("depth = 0")).join(count(w.skills).withColumnRenamed("n", "m")).select((F.col("n") - F.col("m")).alias("n"))
    checks += [
        _check("closure rows of depth 0 beyond one a skill", surplus),
        _check("skills without a closure row of their own", count(w.skills.join(self, "skill_id", "left_anti"))),
        _check("levels of the closure", w.closure.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("n")), "n >= 2"),
        _check("skills with a parent", count(w.skills.where("parent_skill_id IS NOT NULL")), "n > 0"),
        _check("categories extracted as skills", count(leaked)),
        _check("skills without search terms", count(w.skills.join(terms, "skill_id", "left_anti"))),
        _check("skills not found without accents", count(ascii_terms.join(terms, ["skill_id", "term"], "left_anti"))),
        _check("ids that are no slug of the name", count(w.skills.where(F.col("skill_id") != slugify("canonical_name")))),
        _check("columns without any value", count(empty_columns(w.skills, "skills").unionByName(empty_columns(w.jobs, "jobs")))),
    ]
    return reduce(DataFrame.unionByName, checks)


#: Checks that a table must pass before it is loaded, by the start of their label.
MUST = ("key job_skills", "key closure", "key skills.parent", "key terms", "key jobs", "key variants", "skills with a parent", "categories extracted")


def gate_problems(w: Warehouse) -> DataFrame:
    """(label, n) of the failed checks that forbid loading."""
    must = reduce(lambda a, b: a | b, [F.col("label").startswith(m) for m in MUST])
    return integrity_checks(w).where(~F.col("ok") & must).select("label", "n")


def load_gate(w: Warehouse) -> None:
    """Raises ValueError with all problems of tables that must not be loaded."""
    bad = [f"{r['label']}: {r['n']}" for r in gate_problems(w).collect()]  # at most a row per check
    if bad:
        raise ValueError("inconsistent tables: " + "; ".join(bad))


# --- scores -----------------------------------------------------------------------------------


def ratios(df: DataFrame) -> DataFrame:
    """df with precision, recall and f1 of its tp, fp, fn; 0 where a denominator is."""
    div = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = div(F.col("tp"), F.col("tp") + F.col("fp")), div(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", div(2 * p * r, p + r))


def compare_sets(gold: DataFrame, predicted: DataFrame, by: list[str]) -> DataFrame:
    """(by..., tp, fp, fn) of the sets of (record_id, skill_id), counted once each; by must be columns of both."""
    keys = ["record_id", "skill_id", *by]
    g = gold.select(keys).distinct().withColumn("g", F.lit(1))
    p = predicted.select(keys).distinct().withColumn("p", F.lit(1))
    both = g.join(p, keys, "full_outer")
    hit, miss = F.col("g").isNotNull(), F.col("g").isNull()
    told = F.col("p").isNotNull()
    return both.groupBy(*by).agg(F.count_if(hit & told).alias("tp"), F.count_if(miss & told).alias("fp"), F.count_if(hit & ~told).alias("fn"))


def extraction_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(source, tp, fp, fn, precision, recall, f1, macro_f1) per source; both hold record_id, source, skill_id.

    macro_f1 is the mean of the records' f1; records with neither gold nor
    prediction do not count.
    """
    per_source = ratios(compare_sets(gold, predicted, ["source"]))
    each = ratios(_per_record(gold, predicted)).groupBy("source").agg(F.avg("f1").alias("macro_f1"))
    return per_source.join(each, "source")


def _per_record(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    keys = ["record_id", "source"]
    sets = lambda df, n: df.groupBy(keys).agg(F.collect_set("skill_id").alias(n))
    none = F.array().cast("array<string>")
    both = sets(gold, "g").join(sets(predicted, "p"), keys, "full_outer").select(*keys, F.coalesce("g", none).alias("g"), F.coalesce("p", none).alias("p"))
    hit = F.size(F.array_intersect("g", "p"))
    return both.select(*keys, hit.alias("tp"), (F.size("p") - hit).alias("fp"), (F.size("g") - hit).alias("fn"))


def method_precision(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(method, hits, total, precision) of predictions(record_id, skill_id, method)."""
    known = gold.select("record_id", "skill_id").distinct().withColumn("hit", F.lit(1))
    scored = predicted.join(known, ["record_id", "skill_id"], "left")
    return scored.groupBy("method").agg(F.count("hit").alias("hits"), F.count("*").alias("total")).withColumn("precision", F.col("hits") / F.col("total"))


def coverage(gold: DataFrame) -> DataFrame:
    """One row: gold labels, those outside the dictionary (oov: ids), and the covered share."""
    out = F.count_if(F.col("skill_id").startswith("oov:"))
    return gold.agg(F.count("*").alias("n_gold"), out.alias("n_oov")).withColumn("coverage", F.when(F.col("n_gold") > 0, (F.col("n_gold") - F.col("n_oov")) / F.col("n_gold")).otherwise(F.lit(0.0)))


def retrieval_scores(ranks: DataFrame) -> DataFrame:
    """(kind, n, mrr, p_at_1, misses) per kind and for all (kind null) of ranks(kind, rank); rank 0 is a miss."""
    rr = F.when(F.col("rank") > 0, 1.0 / F.col("rank")).otherwise(F.lit(0.0))
    return ranks.withColumn("rr", rr).rollup("kind").agg(
        F.count("*").alias("n"), F.avg("rr").alias("mrr"), F.avg((F.col("rank") == 1).cast("double")).alias("p_at_1"), F.count_if(F.col("rank") == 0).alias("misses")
    )


def masked_matches(records: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold (record_id, skill_id, source) and predictions (..., method) of records(record_id, source, title, requirements_raw, description, labels), whose labels are hidden from extraction.

    Predictions are exact and fuzzy; tokens are common over all records, with
    labels or without. Feed B is read by title only.
    """
    from skillspark.operators.extract import common_tokens, exact_matches, fuzzy_matches, label_matches, record_text

    labelled = records.where(F.size("labels") > 0)
    whole = record_text("title", "requirements_raw", "description")
    title_only = F.when(F.col("source") == "data_jobs", F.coalesce("title", F.lit(""))).otherwise(whole)
    sources = labelled.select("record_id", "source")
    gold = label_matches(labelled, aliases).select("record_id", "skill_id").join(sources, "record_id")
    masked = labelled.select("record_id", title_only.alias("text"))
    exact = cut_lineage(exact_matches(masked, aliases))
    common = common_tokens(records.select("record_id", whole.alias("text")))
    found = exact.unionByName(fuzzy_matches(masked, aliases, exact, common))
    return gold, cut_lineage(found.select("record_id", "skill_id", "method").join(sources, "record_id"))


def masked_evaluation(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """Scores per source of extraction against the labels of a source, which are hidden from it; records as in masked_matches."""
    return extraction_scores(*masked_matches(records, aliases))


def masked_methods(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """(method, hits, total, precision) of exact and fuzzy matches against the hidden labels; records as in masked_matches."""
    return method_precision(*masked_matches(records, aliases))


def closure_mismatch(stored: DataFrame, built: DataFrame) -> DataFrame:
    """Pairs (ancestor_id, descendant_id) that only one of two closures holds, with which."""
    keys = ["ancestor_id", "descendant_id"]
    a = stored.select(keys).distinct().withColumn("a", F.lit(1))
    b = built.select(keys).distinct().withColumn("b", F.lit(1))
    return a.join(b, keys, "full_outer").where("a IS NULL OR b IS NULL").select(*keys, F.when(F.col("a").isNull(), "built").otherwise("stored").alias("only_in"))


# --- samples and labels -----------------------------------------------------------------------


def length_bands(records: DataFrame, length: Column, tie: str = "source_id") -> DataFrame:
    """records with length_band: thirds by length within the source, by a range sort and counts instead of one sorted window a source.

    Where the records of a source do not divide by three the first bands have one more. tie must be unique within a source.
    """
    sized = records.withColumn("_len", length)
    placed = dense_ids(sized, ["source", "_len", tie], "_place")
    first = placed.groupBy("source").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).withColumnRenamed("source", "_s")
    joined = placed.join(first, F.col("source").eqNullSafe(F.col("_s")))
    size, more, rank = F.floor(F.col("_n") / 3), F.col("_n") % 3, F.col("_place") - F.col("_first")
    wide = more * (size + 1)
    third = F.when(rank < wide, F.floor(rank / (size + 1))).otherwise(more + F.floor((rank - wide) / F.greatest(size, F.lit(1))))
    return joined.withColumn("length_band", F.element_at(F.array(*map(F.lit, BANDS)), (third + 1).cast("int"))).drop("_len", "_place", "_s", "_first", "_n")


def task_order(seed: int) -> Column:
    """An order by source and source_id that only the seed decides."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), "source", "source_id"), 256)


def input_sha256(fields: list[str]) -> Column:
    """Fingerprint of texts: of a JSON object with sorted keys, a blank behind every comma and colon."""
    plain = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.expr(f"substring(to_json(array(`{c}`)), 2, length(to_json(array(`{c}`))) - 2)"))
    parts = [F.concat(F.lit(f'"{c}": '), plain(c)) for c in sorted(fields)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256)


def sample_tasks(records: DataFrame, per_source: int = 100, seed: int = 5420, development: float = 0.3) -> DataFrame:
    """A reproducible stratified sample (a sampling operator): per source equal quotas of short, medium and long records, part of each for development.

    records(source, source_id, title, requirements_raw, description). Order and
    choice follow a hash of the seed and the id, so any partitioning gives the
    same sample.
    """
    text = F.length(F.concat(*[F.coalesce(c, F.lit("")) for c in ("title", "requirements_raw", "description")]))
    banded = length_bands(records.where(text > 0), text)
    rank = F.row_number().over(W.partitionBy("source", "length_band").orderBy(task_order(seed), "source_id"))
    quota = F.create_map(*[F.lit(x) for i, b in enumerate(BANDS) for x in (b, per_source // 3 + (i < per_source % 3))])
    drawn = banded.withColumn("r", rank).withColumn("quota", quota[F.col("length_band")]).where("r <= quota")
    return drawn.select(
        F.concat_ws(":", "source", "source_id").alias("task_id"), "source", "source_id", "length_band",
        F.when(F.col("r") <= F.round(F.col("quota") * development), "development").otherwise("test").alias("split"),
        input_sha256(["title", "requirements_raw", "description"]).alias("input_sha256"),
        F.row_number().over(W.orderBy(task_order(seed + 1), "source_id")).alias("order"),  # over the sample only
    )


def oov_skill_id(term: Column) -> Column:
    """Id of a term outside the dictionary."""
    return F.concat(F.lit("oov:"), F.substring(F.sha2(F.trim(F.regexp_replace(F.lower(term), r"(?U)\s+", " ")), 256), 1, 16))


def validate_annotations(tasks: DataFrame, annotations: DataFrame, skills: DataFrame) -> DataFrame:
    """(task_id, problem) of annotations(task_id, annotator, status, skill_ids): repeated, without task, with a bad status, an unknown skill or no annotator."""
    key = annotations.select("task_id")
    ids = annotations.select("task_id", F.explode("skill_ids").alias("skill_id"))
    problem = lambda df, text: df.select("task_id", F.lit(text).alias("problem"))
    found = [
        problem(key.groupBy("task_id").count().where("count > 1"), "repeated"),
        problem(key.join(tasks.select("task_id"), "task_id", "left_anti"), "no such task"),
        problem(annotations.where(~F.coalesce("status", F.lit("")).isin("draft", "complete")), "bad status"),
        problem(ids.join(skills.select("skill_id"), "skill_id", "left_anti"), "unknown skill"),
        problem(annotations.where(F.trim(F.coalesce("annotator", F.lit(""))) == ""), "no annotator"),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def gold_labels(tasks: DataFrame, annotations: DataFrame, complete: bool = True) -> DataFrame:
    """(record_id, source, split, skill_id) of annotated tasks, unresolved terms under oov: ids; raises ValueError if a task lacks a complete annotation."""
    done = annotations.where("status = 'complete'").select("task_id", "skill_ids", "unresolved_terms")
    missing = tasks.join(done, "task_id", "left_anti")
    if complete and not missing.isEmpty():
        raise ValueError("tasks without a complete annotation: " + ", ".join(r["task_id"] for r in missing.select("task_id").orderBy("task_id").limit(5).collect()))
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(F.coalesce("skill_ids", none), F.transform(F.coalesce("unresolved_terms", none), oov_skill_id)))
    return tasks.join(done, "task_id").select(F.col("task_id").alias("record_id"), "source", "split", F.explode(every).alias("skill_id"))


def gold_standard(annotations: DataFrame, assisted: tuple[str, ...]) -> DataFrame:
    """One row (standard): whose labels these are, `llm_assisted_gold` if all annotators are among the assisted ones and there are any, else `manual_gold`."""
    own = F.count_if(~F.coalesce("annotator", F.lit("")).isin(*assisted))
    return annotations.agg(F.when((F.count("*") > 0) & (own == 0), "llm_assisted_gold").otherwise("manual_gold").alias("standard"))


def score_gold(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(vocabulary, source, tp, fp, fn, precision, recall, f1, macro_f1): predictions against gold labels, per source and for all (source `all`).

    `end_to_end` counts gold terms that the dictionary lacks (oov: ids) as
    missed, `in_vocabulary` leaves them out. Both hold record_id, source,
    skill_id; records without gold and prediction do not count.
    """
    known = gold.where(~F.col("skill_id").startswith("oov:"))
    every = lambda df: df.unionByName(df.withColumn("source", F.lit("all")))
    columns = ["record_id", "source", "skill_id"]
    p = every(predicted.select(columns))
    parts = [extraction_scores(every(g.select(columns)), p).select(F.lit(name).alias("vocabulary"), "*") for name, g in (("end_to_end", gold), ("in_vocabulary", known))]
    return parts[0].unionByName(parts[1])


def evaluation_report(extraction: DataFrame, retrieval: DataFrame, integrity: DataFrame) -> DataFrame:
    """(section, name, metric, value) of extraction scores per source, retrieval scores per kind and integrity checks, in one table."""

    def long(df: DataFrame, section: str, name: Column, metrics: list[str]) -> DataFrame:
        each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        return df.select(F.lit(section).alias("section"), name.alias("name"), F.inline(each))

    parts = [
        long(extraction, "extraction", F.col("source"), ["tp", "fp", "fn", "precision", "recall", "f1", "macro_f1"]),
        long(retrieval, "retrieval", F.coalesce("kind", F.lit("all")), ["n", "mrr", "p_at_1", "misses"]),
        long(integrity, "integrity", F.col("label"), ["ok", "n"]),
    ]
    return reduce(DataFrame.unionByName, parts)


def freeze(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n, hash): the fingerprints of the tables an evaluation rests on, to be stored beside its tasks."""
    return reduce(DataFrame.unionByName, [fingerprint(df).select(F.lit(name).alias("table_name"), "n", "hash") for name, df in tables.items()])


def check_frozen(frozen: DataFrame, tables: dict[str, DataFrame]) -> None:
    """Raises ValueError where a table is no longer the one that was frozen, or was never frozen: scores would not compare."""
    now = freeze(tables).withColumnRenamed("n", "n2").withColumnRenamed("hash", "hash2")
    same = F.col("n").eqNullSafe(F.col("n2")) & F.col("hash").eqNullSafe(F.col("hash2"))
    changed = now.join(frozen, "table_name", "left").where(~same).select("table_name").orderBy("table_name")
    if names := [r["table_name"] for r in changed.collect()]:  # a row per table
        raise ValueError("changed since they were frozen: " + ", ".join(names))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (n, hash) that tells whether a table's content changed, whatever its order."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).alias("hash"))
