"""The equipment registry: keys and groups of extracted entities, merge proposals and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, small
from .baskets import pair_counts, supported, weighted_baskets
from .components import connected_components

#: The grammar of tags, words that mean nothing, and legal suffixes of makers' names.
TAG = "(?i)^(=[A-Za-z]\\d=[A-Za-z]{2}\\d{2}|[A-Za-z]{2,4}[-_]?\\d{1,3})$"
NOTHING = ["null", "none", "unknown", "n/a"]
LEGAL = "(?i)\\b(b\\.?\\s*v\\.?|ltd\\.?|gmbh|inc\\.?|s\\.?a\\.?|n\\.?v\\.?|corp\\.?|co\\.?|limited|holding|group)\\b"
ALIAS_CHARS, LIST_CAP, MERGED_CAP = 60, 40, 60
LEAST_SHARED, LEAST_RATIO, LEAST_CONFIDENCE = 3, 0.5, 0.9
PAYLOAD = "equipment array<string>, systems array<string>, make string, model string, tags array<string>, synonyms array<string>"


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def clean(text: Column) -> Column:
    """Single spaces; blank, JSON-like and empty-meaning values are null."""
    s = squeeze(text)
    return F.when((s != "") & ~s.rlike("^[{\\[]") & ~F.lower(s).isin(NOTHING), s)


def maker(text: Column) -> Column:
    """A maker's name without legal suffixes, the name itself if nothing else is left."""
    s = F.regexp_replace(squeeze(F.regexp_replace(text, LEGAL, "")), "^[ .,\\-]+|[ .,\\-]+$", "")
    return F.when(s == "", text).otherwise(s)


def payload(text: Column) -> Column:
    """A model's reply as a struct: the text as JSON, else what is in a fence, else the first to the last brace; null if none is an object."""
    fenced = F.regexp_extract(text, "(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```", 1)
    braced = F.regexp_extract(text, "(?s)(\\{.*\\})", 1)
    plain = F.when(text.rlike("^\\s*\\{"), F.try_parse_json(text))
    json = F.coalesce(plain, F.try_parse_json(F.nullif(fenced, F.lit(""))), F.try_parse_json(F.nullif(braced, F.lit(""))))
    return F.from_json(F.to_json(json), PAYLOAD)


def extracted(inputs: DataFrame, model) -> DataFrame:
    """(document_id, p): what a model says of each document's input; replies that hold no object are left out.

    inputs: (doc_id, input), as audit.entity_input gives them; model: an expression from models.text_model.
    """
    said = inputs.select(F.col("doc_id").alias("document_id"), model(F.col("input")).alias("reply"))
    return said.select("document_id", payload(F.col("reply")).alias("p")).where("p is not null")


def adjudicated(pairs: DataFrame, model) -> DataFrame:
    """(a, b, shared, same, confidence, status): a model's judgement of each proposal; one that fails counts as not the same.

    pairs: (a, b, shared, question); the model replies with an object of same and confidence.
    """
    reply = F.from_json(F.regexp_extract(F.coalesce(model(F.col("question")), F.lit("")), "(?s)(\\{.*\\})", 1), "same boolean, confidence double")
    j = pairs.withColumn("r", reply)
    return j.select("a", "b", "shared", F.coalesce(F.col("r.same").cast("int"), F.lit(0)).alias("same"), F.coalesce("r.confidence", F.lit(0.0)).alias("confidence"), F.lit("proposed").alias("status"))


def registry_keys(entities: DataFrame) -> DataFrame:
    """(document_id, key, name, make, model, aliases, tags): make and model, else make and first equipment; one more for each valid tag.

    entities: (document_id, p) with p of the payload's shape; null lists are empty.
    """
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(F.col(f"p.{c}"), none) for c in ("equipment", "synonyms", "tags")}
    e = entities.select("document_id", *(v.alias(c) for c, v in lists.items()), maker(clean(F.col("p.make"))).alias("make"), clean(F.col("p.model")).alias("model"))
    first = F.get("equipment", F.lit(0))
    norm = lambda c: F.lower(squeeze(c))
    kind = "struct<key:string,name:string,make:string,model:string>"
    one = lambda key, name, make, model: F.struct(key.alias("key"), name.alias("name"), make.alias("make"), model.alias("model")).cast(kind)
    null = F.lit(None).cast("string")
    both = F.concat_ws(" ", "make", "model")
    named = F.concat_ws(" ", F.col("make"), first)
    main = F.when(F.col("make").isNotNull() & F.col("model").isNotNull(), F.array(one(F.concat(F.lit("make-model:"), norm(both)), both, F.col("make"), F.col("model")))).when(
        F.col("make").isNotNull() & first.isNotNull(), F.array(one(F.concat(F.lit("make-equipment:"), norm(named)), named, F.col("make"), null))
    )
    tags = F.transform(F.filter("tags", lambda t: F.trim(t).rlike(TAG)), lambda t: one(F.concat(F.lit("tag:"), norm(t)), F.trim(t), null, null))
    keys = F.concat(F.coalesce(main, F.array().cast(f"array<{kind}>")), tags)
    aliases = F.filter(F.concat("equipment", "synonyms"), lambda a: (a != "") & (F.length(a) < ALIAS_CHARS))
    return e.select("document_id", F.explode(keys).alias("k"), aliases.alias("aliases"), F.filter("tags", lambda t: t != "").alias("tags")).select("document_id", "k.*", "aliases", "tags")


def registry(keys: DataFrame) -> DataFrame:
    """(equipment_key, canonical_name, make, model, aliases, tags, docs): one row per key, first-seen names by document; lists sorted and cut to 40.

    The key is stable over rebuilds. Aliases and tags are first made distinct per key, so no group holds repeated ones.
    """
    first = F.min(F.struct("document_id", "name", "make", "model")).alias("f")
    heads = keys.groupBy("key").agg(first, F.countDistinct("document_id").alias("docs"))

    def lists(col: str) -> DataFrame:
        once = keys.select("key", F.explode(col).alias("x")).distinct()
        w = Window.partitionBy("key").orderBy("x")
        top = once.withColumn("n", F.row_number().over(w)).where(F.col("n") <= LIST_CAP)
        return top.groupBy("key").agg(F.array_sort(F.collect_list("x")).alias(col))

    none = F.array().cast("array<string>")
    out = heads.join(lists("aliases"), "key", "left").join(lists("tags"), "key", "left")
    return out.select(
        F.col("key").alias("equipment_key"), F.col("f.name").alias("canonical_name"), "f.make", "f.model", F.coalesce("aliases", none).alias("aliases"), F.coalesce("tags", none).alias("tags"), "docs"
    )


def registry_summary(keys: DataFrame) -> DataFrame:
    """(equipment, links, multi_doc)."""
    per = keys.select("key", "document_id").distinct().groupBy("key").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("equipment"), F.coalesce(F.sum("n"), F.lit(0)).alias("links"), F.count(F.when(F.col("n") > 1, 1)).alias("multi_doc"))


def shared(links: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, shared, n_a, n_b), a < b: documents that two items share, at least ``least``. Items in fewer are left out first."""
    once = cut(links.dropna(subset=["equipment_id", "document_id"]).select("equipment_id", "document_id").distinct())
    counts = cut(once.groupBy("equipment_id").agg(F.count("*").alias("c")).where(F.col("c") >= least))
    pairs = pair_counts(weighted_baskets(supported(once, counts, "equipment_id"), "equipment_id", "document_id"), least)
    n = small(counts)
    side = lambda x: n.select(F.col("equipment_id").alias(x), F.col("c").alias(f"n_{x}"))
    return pairs.withColumnRenamed("n", "shared").join(side("a"), "a").join(side("b"), "b").select("a", "b", "shared", "n_a", "n_b")


def other_unit(a: Column, b: Column) -> Column:
    """The same name but for the number at its end."""
    p = "^(.*?)(\\d+)\\s*$"
    x, y = F.trim(a), F.trim(b)
    return x.rlike(p) & y.rlike(p) & (F.lower(F.regexp_extract(x, p, 1)) == F.lower(F.regexp_extract(y, p, 1))) & (F.regexp_extract(x, p, 2) != F.regexp_extract(y, p, 2))


def proposals(links: DataFrame, equipment: DataFrame, least: int = LEAST_SHARED, ratio: float = LEAST_RATIO) -> DataFrame:
    """(a, b, shared, ratio): pairs of enough shared documents that may be one item.

    Left out are other units of one family and pairs of which neither has a make or model.
    """
    p = shared(links, least).where(F.col("shared") >= least).withColumn("ratio", F.col("shared") / F.greatest(F.lit(1), F.least("n_a", "n_b"))).where(F.col("ratio") >= ratio)
    bare = F.coalesce(F.nullif("make", F.lit("")), F.nullif("model", F.lit(""))).isNull()
    e = small(equipment.select("equipment_id", "canonical_name", bare.alias("bare")).dropDuplicates(["equipment_id"]))
    side = lambda x: e.select(F.col("equipment_id").alias(x), F.col("canonical_name").alias(f"name_{x}"), F.col("bare").alias(f"bare_{x}"))
    j = p.join(side("a"), "a").join(side("b"), "b").where(~other_unit(F.col("name_a"), F.col("name_b")) & ~(F.col("bare_a") & F.col("bare_b")))
    return j.select("a", "b", "shared", F.round("ratio", 2).alias("ratio"))


def merged(equipment: DataFrame, links: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(equipment, links, map) after confirmed merges; judged: (a, b, same, confidence, status).

    A pair is confirmed if judged the same with a confidence of 0.9, or approved. Chains are one component; in each the item
    with make or model is kept, then the one of most documents, then the least id (of disjoint pairs: the rule for pairs).
    Aliases get the dropped names, both lists are sorted and cut to 60. map: (dropped, kept).
    """
    yes = ((F.col("same") == 1) & (F.col("confidence") >= LEAST_CONFIDENCE)) | (F.col("status") == "approved")
    known = equipment.select(F.col("equipment_id").alias("id"))
    open_ = judged.where(F.col("status").isin("proposed", "approved") & yes).select("a", "b")
    open_ = open_.join(known.select(F.col("id").alias("a")), "a", "left_semi").join(known.select(F.col("id").alias("b")), "b", "left_semi")
    groups = connected_components(open_)
    once = links.dropna().distinct()
    n = once.groupBy("equipment_id").agg(F.count("*").alias("n"))
    bare = F.coalesce(F.nullif("make", F.lit("")), F.nullif("model", F.lit(""))).isNull()
    facts = groups.join(equipment.withColumnRenamed("equipment_id", "id").withColumn("bare", bare), "id").join(n.withColumnRenamed("equipment_id", "id"), "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("component").orderBy("bare", F.desc("n"), "id")
    ranked = facts.withColumn("place", F.row_number().over(order)).withColumn("kept", F.first("id").over(order))
    moves = cut(ranked.where("place > 1").select(F.col("id").alias("dropped"), "kept"))
    arr = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    told = ranked.select("kept", F.concat(arr("aliases_json"), F.when(F.col("place") > 1, F.array("canonical_name")).otherwise(F.array().cast("array<string>"))).alias("al"), arr("tags_json").alias("tg"))

    def union(col: str) -> DataFrame:
        w = Window.partitionBy("kept").orderBy("x")
        top = told.select("kept", F.explode(col).alias("x")).where("x is not null and x <> ''").distinct().withColumn("i", F.row_number().over(w)).where(F.col("i") <= MERGED_CAP)
        return top.groupBy("kept").agg(F.to_json(F.array_sort(F.collect_list("x"))).alias(f"new_{col}"))

    lists = moves.select("kept").distinct().join(union("al"), "kept", "left").join(union("tg"), "kept", "left").withColumnRenamed("kept", "equipment_id")
    left = equipment.join(moves.select(F.col("dropped").alias("equipment_id")), "equipment_id", "left_anti").join(lists.withColumn("changed", F.lit(True)), "equipment_id", "left")
    new = left.select("equipment_id", "canonical_name", "make", "model", F.when(F.col("changed"), F.coalesce("new_al", F.lit("[]"))).otherwise(F.col("aliases_json")).alias("aliases_json"), F.when(F.col("changed"), F.coalesce("new_tg", F.lit("[]"))).otherwise(F.col("tags_json")).alias("tags_json"))
    relinked = once.join(moves.withColumnRenamed("dropped", "equipment_id"), "equipment_id", "left").select(F.coalesce("kept", "equipment_id").alias("equipment_id"), "document_id").distinct()
    return new, relinked, moves


def upserted(snapshot: DataFrame, changes: DataFrame, key: str, newest: str) -> DataFrame:
    """A snapshot with changed rows in place of older ones of the same key; on equal age the change wins."""
    both = snapshot.withColumn("_c", F.lit(0)).unionByName(changes.withColumn("_c", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(newest), F.desc("_c"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_c")
