"""The serving tables: latest row of every key, best match of every pair, search terms, and their views."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillspark.functions.text import norm_text, search_terms
from skillspark.session import cut_lineage, ensure_checkpoint_dir, table

#: Extraction methods from the most to the least trusted (fixed values).
METHODS = ("source_provided", "exact_match", "fuzzy_match")


def latest(rows: DataFrame, key: str, at: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """One row per key: the latest; of several the greatest by the other columns. Keys whose latest row is deleted are left out."""
    others = [c for c in rows.columns if c not in (key, at)]
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(at, *others)).alias("r")).select(key, "r.*")
    return best.where(F.col(deleted).isNull()) if deleted in rows.columns else best


def method_rank(method: str) -> F.Column:
    rank = F.lit(len(METHODS))
    for i, m in enumerate(METHODS):
        rank = F.when(F.col(method) == m, i).otherwise(rank)
    return rank


def best_matches(matches: DataFrame, jobs: DataFrame, skills: DataFrame) -> DataFrame:
    """One row per job and skill that both exist: by method, then confidence, then the earliest match."""
    order = F.struct((-method_rank("extraction_method")).alias("m"), F.coalesce("confidence", F.lit(-1.0)).alias("c"), (-F.col("match_id")).alias("i"))
    row = F.struct("skill_type", "source", "extraction_method", "confidence", "evidence_snippet")
    return (
        matches.where("job_id IS NOT NULL AND skill_id IS NOT NULL")
        .groupBy("job_id", "skill_id")
        .agg(F.max_by(row, order).alias("r"))
        .select("job_id", "skill_id", "r.*")
        .join(jobs.select("job_id"), "job_id", "left_semi")
        .join(skills.select("skill_id"), "skill_id", "left_semi")
    )


def skill_terms(skills: DataFrame) -> DataFrame:
    """(skill_id, term)."""
    aliases = F.col("aliases") if "aliases" in skills.columns else None
    return skills.select("skill_id", F.explode(search_terms("canonical_name", aliases)).alias("term"))


def with_category(skills: DataFrame) -> DataFrame:
    """skills with category = the parent's name."""
    parent = skills.select(F.col("skill_id").alias("pid"), F.col("canonical_name").alias("category"))
    return skills.drop("category").join(parent, F.col("parent_skill_id") == F.col("pid"), "left").drop("pid")


def dense_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with dense numbers from 1 in this order, by a range sort and the sizes of its partitions instead of one task that sorts all."""
    placed = cut_lineage(df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    before, offsets = 0, []
    for r in placed.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():  # a row per partition
        offsets += [F.lit(r["_p"]), F.lit(before)]
        before += r["n"]
    if not offsets:
        return placed.drop("_p", "_i").withColumn(name, F.lit(None).cast("long"))
    place = F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn(name, F.element_at(F.create_map(*offsets), F.col("_p")) + place).drop("_p", "_i")


def location_key(address: F.Column, province: F.Column) -> F.Column:
    """Places of one address in different provinces are different; no address, no place."""
    return F.when(F.coalesce(address, F.lit("")) != "", F.concat(norm_text(address), F.lit("|"), F.coalesce(province.cast("string"), F.lit(""))))


def companies_of(records: DataFrame, order: str = "rec_no") -> DataFrame:
    """(company_id, name, name_norm, industry) in the order of first sight; the first record gives name and industry."""
    named = records.select(norm_text("company").alias("name_norm"), F.col("company").alias("name"), F.col("extra.industry").alias("industry"), F.col(order).alias("o"))
    first = named.where("name_norm <> ''").groupBy("name_norm").agg(F.min_by(F.struct("name", "industry"), "o").alias("f"), F.min("o").alias("o"))
    return dense_ids(first.select("name_norm", "f.*", "o"), ["o"], "company_id").select("company_id", "name", "name_norm", "industry")


def locations_of(records: DataFrame, place: F.Column, order: str = "rec_no") -> DataFrame:
    """(location_id, location_key, location_raw, city, country) in the order of first sight; place is a struct(city, country) of a record."""
    key = location_key(F.col("location"), F.col("extra.province_id"))
    keyed = records.select(key.alias("location_key"), F.col("location").alias("location_raw"), place.alias("p"), F.col(order).alias("o")).where("location_key IS NOT NULL")
    first = keyed.groupBy("location_key").agg(F.min_by(F.struct("location_raw", "p.city", "p.country"), "o").alias("f"), F.min("o").alias("o"))
    return dense_ids(first.select("location_key", "f.*", "o"), ["o"], "location_id").drop("o")


def jobs_of(records: DataFrame, companies: DataFrame, locations: DataFrame) -> DataFrame:
    """(job_id, title_raw, company_id, location_id, posted_date, source, url) of records, joined with their dimensions by key."""
    keyed = records.withColumn("name_norm", norm_text("company")).withColumn("location_key", location_key(F.col("location"), F.col("extra.province_id")))
    joined = keyed.join(companies.select("name_norm", "company_id"), "name_norm", "left").join(locations.select("location_key", "location_id"), "location_key", "left")
    return joined.select(F.concat_ws(":", "source", "source_id").alias("job_id"), F.col("title").alias("title_raw"), "company_id", "location_id", "posted_date", "source", "url")


def job_companies(records: DataFrame, companies: DataFrame) -> DataFrame:
    """(job_id, company_id) by the latest record of every posting (of several the smallest rec_no); null where it names nobody."""
    job = F.concat_ws(":", "source", "source_id").alias("job_id")
    newest = F.max_by(norm_text("company"), F.struct("crawled_at", -F.col("rec_no"))).alias("name_norm")
    latest_name = records.where("source IS NOT NULL AND source_id IS NOT NULL").groupBy(job).agg(newest)
    return latest_name.join(companies.select("name_norm", "company_id"), "name_norm", "left").select("job_id", "company_id")


def surface_forms(rows: DataFrame, skills: DataFrame) -> DataFrame:
    """(variant_id, skill_id, surface_form): every spelling that the rows of a skill ever had, for skills that exist."""
    forms = rows.where(F.trim("canonical_name") != "").select("skill_id", F.col("canonical_name").alias("surface_form")).distinct()
    return dense_ids(forms.join(skills.select("skill_id"), "skill_id", "left_semi"), ["skill_id", "surface_form"], "variant_id").select("variant_id", "skill_id", "surface_form")


def canonical_only(records: DataFrame) -> DataFrame:
    """Records that stand for their duplicate group; all of them where nothing is marked, and unmarked ones too."""
    return records.where(F.coalesce("is_canonical", F.lit(True))) if "is_canonical" in records.columns else records


#: Tables of a saved warehouse.
TABLES = ("skills", "jobs", "job_skills", "locations", "closure", "companies", "variants", "terms", "facts")


class Warehouse:
    """The tables that the queries read; each is a lazy DataFrame. terms and facts may be given where they are stored."""

    def __init__(self, skills: DataFrame, jobs: DataFrame, job_skills: DataFrame, locations: DataFrame, closure: DataFrame, companies: DataFrame, variants: DataFrame, terms: DataFrame | None = None, facts: DataFrame | None = None):
        self.skills, self.jobs, self.job_skills = skills, jobs, job_skills
        self.locations, self.closure, self.companies, self.variants = locations, closure, companies, variants
        self.terms = skill_terms(skills) if terms is None else terms
        self.facts = self._star() if facts is None else facts

    def _star(self) -> DataFrame:
        """job_skills with the skill's name, category and type and the job's place; equi joins on keys."""
        places = self.locations.select("location_id", "city", "country")
        jobs = self.jobs.select("job_id", "location_id").join(places, "location_id", "left")
        skills = self.skills.select("skill_id", "canonical_name", "category", F.col("skill_type").alias("type"))
        matches = self.job_skills.select("job_id", "skill_id", F.col("skill_type").alias("match_type"))
        return matches.join(skills, "skill_id").join(jobs, "job_id").select("job_id", "skill_id", "match_type", "canonical_name", "category", "type", "city", "country")


def load(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The warehouse over the raw tables of a data directory."""
    raw = table(spark, sf_dir, "skills")
    skills = with_category(latest(raw, "skill_id"))
    records = canonical_only(table(spark, sf_dir, "job_records"))
    companies = companies_of(records)
    jobs = latest(table(spark, sf_dir, "jobs"), "job_id").join(job_companies(records, companies), "job_id", "left")
    facts = best_matches(table(spark, sf_dir, "job_skills"), jobs, skills)
    closure = table(spark, sf_dir, "skill_closure").where("ancestor_id IS NOT NULL").groupBy("ancestor_id", "descendant_id").agg(F.min("depth").alias("depth"))
    return Warehouse(skills, jobs, facts, table(spark, sf_dir, "locations"), closure, companies, surface_forms(raw, skills))


def save(w: Warehouse, path: str) -> Warehouse:
    """Writes every table as Parquet under a new path and gives back the stored warehouse.

    job_skills and the star over it are stored in ranges of skills, so that the
    statistics of their row groups answer questions on one skill; the star is
    built from the stored tables.
    """
    spark = w.skills.sparkSession
    ranges = {"job_skills": ["skill_id", "job_id"], "facts": ["skill_id", "job_id"], "terms": ["term"], "closure": ["ancestor_id"]}
    stored = {}
    for name in TABLES:
        df = getattr(Warehouse(*(stored[n] for n in TABLES[:-2]), stored["terms"]), "facts") if name == "facts" else getattr(w, name)
        by = ranges.get(name)
        (df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df).write.mode("overwrite").parquet(f"{path}/{name}")
        stored[name] = spark.read.parquet(f"{path}/{name}")
    return Warehouse(**stored)


def stored(spark: SparkSession, path: str) -> Warehouse:
    """Opens a saved warehouse read-only."""
    return Warehouse(**{n: spark.read.parquet(f"{path}/{n}") for n in TABLES})


def register(spark: SparkSession, path: str) -> Warehouse:
    """Opens a saved warehouse read-only and registers its tables as views."""
    w = stored(spark, path)
    for name in TABLES:
        getattr(w, name).createOrReplaceTempView(name)
    return w


_BUILT: dict[tuple[str, str], str] = {}


def _whole(spark: SparkSession, path: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{TABLES[-1]}/_SUCCESS")  # the table that is written last
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def opened(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The warehouse of a data directory: built and saved in the shared checkpoint folder at first, read from there by all later queries of the application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT or not _whole(spark, _BUILT[key]):
        ensure_checkpoint_dir(spark)
        path = f"{spark.sparkContext.getCheckpointDir()}/warehouse-{uuid4().hex}"
        save(load(spark, sf_dir), path)
        _BUILT[key] = path
    return stored(spark, _BUILT[key])
