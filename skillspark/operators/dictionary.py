"""The skill dictionary: mined names, merged spellings, categories and their closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillspark.functions.text import norm_text, slugify
from skillspark.operators.graph import link_groups
from skillspark.operators.warehouse import dense_ids, method_rank

MIN_JS_CORE = 3


def name_counts(labels: DataFrame) -> DataFrame:
    """(folded, name, n, first): spellings of labels(label, pos) with their frequency."""
    named = labels.where(F.trim("label") != "").select(F.trim("label").alias("name"), norm_text("label").alias("folded"), "pos")
    return named.groupBy("folded", "name").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def display_names(counts: DataFrame) -> DataFrame:
    """(folded, name): the shown spelling: one with a capital before others, then the most frequent, then the first seen."""
    capital = F.col("name") != F.lower("name")
    return counts.groupBy("folded").agg(F.min_by("name", F.struct((~capital).alias("c"), (-F.col("n")).alias("n"), "first")).alias("name"))


def mine_skills(labels: DataFrame, stop: DataFrame, soft: DataFrame) -> DataFrame:
    """(skill_id, canonical_name, skill_type, aliases) of labels that are no stop(name) such as roles; soft(name) are soft skills.

    Folded spellings that give one slug are one skill; its aliases are all of them.
    """
    names = display_names(name_counts(labels))
    known = names.join(F.broadcast(stop.select(norm_text("name").alias("folded"))), "folded", "left_anti")
    is_soft = F.broadcast(soft.select(norm_text("name").alias("folded")).distinct().withColumn("soft", F.lit(True)))
    typed = known.join(is_soft, "folded", "left").withColumn("skill_id", slugify("name"))
    by_order = F.min_by(F.struct("name", "soft"), "folded").alias("b")
    return typed.groupBy("skill_id").agg(by_order, F.array_sort(F.collect_set("folded")).alias("aliases")).select(
        "skill_id", F.col("b.name").alias("canonical_name"), F.when(F.col("b.soft"), "soft").otherwise("hard").alias("skill_type"), "aliases"
    )


def add_entries(dictionary: DataFrame, entries: DataFrame) -> DataFrame:
    """dictionary with entries(canonical_name, skill_type, aliases): an entry of which a name is known joins that skill (of several the smallest id), others are new."""
    forms = F.array_distinct(F.transform(F.concat(F.array("canonical_name"), "aliases"), norm_text))
    new = entries.select("canonical_name", "skill_type", forms.alias("aliases"))
    known = dictionary.select("skill_id", F.explode("aliases").alias("alias"))
    owner = new.select("canonical_name", F.explode("aliases").alias("alias")).join(known, "alias").groupBy("canonical_name").agg(F.min("skill_id").alias("owner"))
    placed = new.join(owner, "canonical_name", "left").withColumn("skill_id", F.coalesce("owner", slugify("canonical_name")))
    rows = dictionary.select("skill_id", "canonical_name", "skill_type", "aliases", F.lit(0).alias("o")).unionByName(
        placed.select("skill_id", "canonical_name", "skill_type", "aliases", F.lit(1).alias("o"))
    )
    first = F.min(F.struct("o", "canonical_name", "skill_type")).alias("f")
    return rows.groupBy("skill_id").agg(first, F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases")).select(
        "skill_id", "f.canonical_name", "f.skill_type", "aliases"
    )


def variant_key(name: F.Column) -> F.Column:
    """A folded name without separators, and without a closing `js` if enough is left; + and # stay."""
    core = F.regexp_replace(name, r"[\s\-_.]", "")
    return F.when(core.endswith("js") & (F.length(core) - 2 >= MIN_JS_CORE), F.regexp_replace(core, "js$", "")).otherwise(core)


def variant_groups(skills: DataFrame, merges: DataFrame, protected: DataFrame) -> DataFrame:
    """(skill_id, group): skills with the smallest id of their spellings.

    Skills of one type with the same key are linked to the first of them, and
    merges(a, b) of aliases are linked too, unless protected(a, b) keeps their
    names apart.
    """
    s = skills.select("skill_id", norm_text("canonical_name").alias("name"), "skill_type", "aliases").withColumn("key", variant_key(F.col("name")))
    head = s.groupBy("key", "skill_type").agg(F.min_by(F.struct("skill_id", "name"), "skill_id").alias("h"))
    by_key = s.join(head, ["key", "skill_type"]).select(F.col("h.skill_id").alias("a"), F.col("skill_id").alias("b"), F.col("h.name").alias("na"), F.col("name").alias("nb"))
    owner = s.select(F.explode(F.array_union("aliases", F.array("name"))).alias("alias"), "skill_id", "name").groupBy("alias").agg(F.min(F.struct("skill_id", "name")).alias("o"))
    one = owner.select(F.col("alias").alias("a"), F.col("o").alias("oa"))
    two = owner.select(F.col("alias").alias("b"), F.col("o").alias("ob"))
    curated = merges.select("a", "b").join(one, "a").join(two, "b").select(F.col("oa.skill_id").alias("a"), F.col("ob.skill_id").alias("b"), F.col("oa.name").alias("na"), F.col("ob.name").alias("nb"))
    apart = protected.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    edges = by_key.unionByName(curated).where("a <> b")
    free = edges.join(F.broadcast(apart), (F.least("na", "nb") == F.col("x")) & (F.greatest("na", "nb") == F.col("y")), "left_anti").select("a", "b")
    groups = link_groups(free)
    return skills.select("skill_id").join(groups.withColumnRenamed("node", "skill_id"), "skill_id", "left").select("skill_id", F.coalesce("group", "skill_id").alias("group"))


def merge_variants(skills: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged skills, old_id -> new_id). The head of a group has most aliases (of equals the smallest id); a skill never becomes its own parent."""
    g = skills.join(groups, "skill_id")
    head = F.min_by(F.struct("canonical_name", "skill_type"), F.struct((-F.size("aliases")).alias("n"), "skill_id")).alias("h")
    merged = g.groupBy("group").agg(
        head,
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
        F.min_by("parent_skill_id", F.when(F.col("parent_skill_id").isNotNull(), F.col("skill_id"))).alias("parent"),
        F.max(F.coalesce("is_category", F.lit(False))).alias("is_category"),
    ).select("group", slugify("h.canonical_name").alias("skill_id"), "h.canonical_name", "h.skill_type", "aliases", "parent", "is_category")
    ids = groups.join(merged.select("group", F.col("skill_id").alias("new_id")), "group").select(F.col("skill_id").alias("old_id"), "new_id")
    parents = ids.select(F.col("old_id").alias("parent"), F.col("new_id").alias("parent_skill_id"))
    out = merged.join(parents, "parent", "left").withColumn("parent_skill_id", F.when(F.col("parent_skill_id") != F.col("skill_id"), F.col("parent_skill_id")))
    return out.select("skill_id", "canonical_name", "skill_type", "aliases", "parent_skill_id", "is_category"), ids


def remap_matches(matches: DataFrame, ids: DataFrame) -> DataFrame:
    """matches(record_id, skill_id, method, pos, ...) under merged ids, the best per record and skill: by method, then the first."""
    rest = [c for c in matches.columns if c not in ("record_id", "skill_id")]
    moved = matches.join(ids, matches["skill_id"] == ids["old_id"], "left").withColumn("skill_id", F.coalesce("new_id", "skill_id"))
    return moved.groupBy("record_id", "skill_id").agg(F.min_by(F.struct(*rest), F.struct(method_rank("method"), "pos")).alias("r")).select("record_id", "skill_id", "r.*")


def assign_parents(skills: DataFrame, tree: DataFrame, soft_root: str) -> tuple[DataFrame, DataFrame]:
    """(skills with parents, unknown names). tree(child, parent, new): names of children and their categories; categories that are no skill yet are added as such.

    Soft skills without parent come below soft_root.
    """
    known = skills.select("skill_id", "canonical_name", "skill_type", "aliases")
    alias = known.select("skill_id", F.explode(F.array_union("aliases", F.array(norm_text("canonical_name")))).alias("alias")).groupBy("alias").agg(F.min("skill_id").alias("skill_id"))
    names = tree.select(F.col("parent").alias("name")).unionByName(tree.sparkSession.createDataFrame([(soft_root,)], "name string")).distinct()
    fresh = names.join(alias, norm_text("name") == alias["alias"], "left_anti").select(
        slugify("name").alias("skill_id"), F.col("name").alias("canonical_name"), F.when(F.col("name") == soft_root, "soft").otherwise("hard").alias("skill_type"), F.array(norm_text("name")).alias("aliases"), F.lit(True).alias("is_category")
    )
    every = known.withColumn("is_category", F.lit(False)).unionByName(fresh)
    of = alias.unionByName(fresh.select(F.explode("aliases").alias("alias"), "skill_id"))
    child = of.select(F.col("alias").alias("ca"), F.col("skill_id").alias("cid"))
    parent = of.select(F.col("alias").alias("pa"), F.col("skill_id").alias("pid"))
    links = tree.join(child, norm_text("child") == F.col("ca")).join(parent, norm_text("parent") == F.col("pa")).where("cid <> pid").groupBy("cid").agg(F.min("pid").alias("pid"))
    root = slugify(F.lit(soft_root))
    placed = every.join(links, every["skill_id"] == links["cid"], "left").select(
        "skill_id", "canonical_name", "skill_type", "aliases", "is_category",
        F.when(F.col("pid").isNotNull(), F.col("pid")).when((F.col("skill_type") == "soft") & (F.col("skill_id") != root), root).alias("parent_skill_id"),
    )
    unknown = tree.join(child, norm_text("child") == F.col("ca"), "left_anti").select(F.col("child").alias("name")).distinct()
    return placed, unknown


def skill_variants(skills: DataFrame) -> DataFrame:
    """(variant_id, skill_id, surface_form): aliases with a running number by skill and alias."""
    each = skills.select("skill_id", F.posexplode(F.array_sort("aliases")).alias("p", "surface_form"))
    return dense_ids(each, ["skill_id", "p"], "variant_id").select("variant_id", "skill_id", "surface_form")
