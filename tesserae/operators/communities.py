"""Hierarchical roll-ups, graph summaries and group descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import level_prefix, under_prefix
from ..functions.words import frequent, holds_frequent
from .checkpoints import stored

#: Segments of the prefix that names a group, by level.
LEVELS = {0: 4, 1: 3, 2: 2}
TERMS, KEYWORDS, TYPES, REPRESENTATIVES = 32, 10, 10, 5


def hierarchy_stats(ids: DataFrame, prefix: str, page: int | None = 1000) -> DataFrame:
    """child, entity_count, rank: entities (id) below each child prefix, one segment longer; the most first, then by name.

    With a page, of the sorted listing only so many ids are counted, as a paged answer does; None counts all.
    """
    n = len(prefix.split(".")) + 1 if prefix else 1
    rows = ids.where(under_prefix(F.col("id"), prefix)) if prefix else ids
    rows = rows.orderBy("id").limit(page) if page else rows
    children = rows.where(F.col("id") != prefix).groupBy(level_prefix(F.col("id"), n).alias("child")).agg(F.count("*").alias("entity_count"))
    order = Window.orderBy(F.col("entity_count").desc(), "child")
    return children.select("child", "entity_count", F.row_number().over(order).cast("long").alias("rank"))


def type_summary(ids: DataFrame, examples: int = 2) -> DataFrame:
    """entity_type (system.domain.type), entity_count, examples (the first ids, joined by commas)."""
    kind = F.concat_ws(".", *(F.element_at(F.split("id", r"\."), i) for i in (3, 4, 5)))
    rows = ids.select("id", kind.alias("entity_type"))
    counts = rows.groupBy("entity_type").agg(F.count("*").alias("entity_count"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("entity_type").orderBy("id"))).where(F.col("place") <= examples)
    named = first.groupBy("entity_type").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("examples"))
    return counts.join(named, "entity_type")


def members(ids: DataFrame) -> DataFrame:
    """level, group_id, id: the group of each entity at each level."""
    groups = F.array(*(F.struct(F.lit(k).alias("level"), level_prefix(F.col("id"), n).alias("group_id")) for k, n in LEVELS.items()))
    return ids.select("*", F.explode(groups).alias("g")).select("g.level", "g.group_id", *ids.columns)


def kinds_held(ids: DataFrame) -> DataFrame:
    """id (down to the type), n: entities are counted by type before their groups are spelled out at each level."""
    return ids.groupBy(level_prefix(F.col("id"), 5).alias("id")).agg(F.count("*").alias("n"))


def group_sizes(ids: DataFrame) -> DataFrame:
    """level, group_id, member_count."""
    return members(kinds_held(ids)).groupBy("level", "group_id").agg(F.sum("n").alias("member_count"))


def group_types(ids: DataFrame, limit: int = TYPES) -> DataFrame:
    """level, group_id, entity_type, entity_count, rank: the most frequent types of each group."""
    kind = F.element_at(F.split("id", r"\."), 5)
    counts = members(kinds_held(ids)).groupBy("level", "group_id", kind.alias("entity_type")).agg(F.sum("n").alias("entity_count"))
    order = Window.partitionBy("level", "group_id").orderBy(F.col("entity_count").desc(), "entity_type")
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def entity_terms(docs: DataFrame, limit: int = TERMS) -> DataFrame:
    """id, word: the most frequent words of each entity's text (ASCII words of 3 to 32 characters, stopwords left out); ties by word."""
    whole = docs.groupBy("id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    return whole.select("id", F.explode(frequent(F.col("text"), limit)).alias("word"))


def group_keywords(docs: DataFrame, ids: DataFrame | None = None, limit: int = KEYWORDS) -> DataFrame:
    """level, group_id, rank, word, score: words that the group's members hold more than all entities do.

    score = held / members * ln(all that hold a word / all holders of this word); members are all entities of the group (ids: id), with a text or
    not. At least two holders (one in a group of one), score above zero.
    """
    terms = stored(entity_terms(docs), "terms")
    n = terms.agg(F.countDistinct("id").alias("all_members"))
    holders = terms.groupBy("word").agg(F.count("*").alias("holders"))
    sizes = group_sizes(docs if ids is None else ids)
    held = members(terms).groupBy("level", "group_id", "word").agg(F.count("*").alias("held"))
    score = F.round(F.col("held") / F.col("member_count") * F.log(F.col("all_members") / F.col("holders")), 6)
    rows = held.join(sizes, ["level", "group_id"]).where(F.col("held") >= F.least(F.lit(2), "member_count")).join(holders, "word").crossJoin(F.broadcast(n)).withColumn("score", score).where("score > 0")
    order = Window.partitionBy("level", "group_id").orderBy(F.col("score").desc(), "word")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit).select("level", "group_id", "rank", "word", "score")


def representatives(docs: DataFrame, limit: int = REPRESENTATIVES) -> DataFrame:
    """level, group_id, rank, id: the smallest ids among the members that hold a word."""
    rows = members(docs.where(holds_frequent(F.col("text"))).select("id").distinct())
    order = Window.partitionBy("level", "group_id").orderBy("id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def group_summary(docs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """level, group_id, summary: one sentence of each group's size, up to three types and up to five keywords."""
    ids = stored(docs.select("id") if ids is None else ids, "members")
    first = lambda rows, n, text: rows.where(F.col("rank") <= n).groupBy("level", "group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("text")))), lambda t: t["text"]), ", ").alias("text"))
    kind = F.concat(F.col("entity_count").cast("string"), F.lit(" "), F.col("entity_type"), F.when(F.col("entity_count") > 1, "s").otherwise(""))
    kinds = first(group_types(ids), 3, kind).withColumnRenamed("text", "kinds")
    words = first(group_keywords(docs, ids), 5, F.col("word")).withColumnRenamed("text", "words")
    rows = group_sizes(ids).join(kinds, ["level", "group_id"]).join(words, ["level", "group_id"], "left")
    themes = F.coalesce(F.concat(F.lit(". Key themes: "), "words"), F.lit(""))
    return rows.select("level", "group_id", F.concat(F.lit("Community of "), F.col("member_count").cast("string"), F.lit(" entities including "), "kinds", themes, F.lit(".")).alias("summary"))


def group_records(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """level, group_id, member_count, revision (the greatest of its members'), summary of entities (id, kv_revision) and their texts (id, text)."""
    counts = members(ids.select("id", "kv_revision")).groupBy("level", "group_id").agg(F.count("*").alias("member_count"), F.max("kv_revision").alias("revision"))
    return counts.join(group_summary(docs, ids.select("id")), ["level", "group_id"])


def changed_groups(old: DataFrame, new: DataFrame) -> DataFrame:
    """op (upsert or delete), level, group_id, summary: records to write, and those whose group is empty now, after a tick."""
    keys = ["level", "group_id"]
    fresh = new.join(old.select(*keys, F.struct(*(c for c in old.columns if c not in keys)).alias("was")), keys, "left")
    same = F.col("was").eqNullSafe(F.struct(*(F.col(c) for c in old.columns if c not in keys)))
    gone = old.join(new.select(*keys), keys, "left_anti").select(F.lit("delete").alias("op"), *keys, F.lit(None).cast("string").alias("summary"))
    return fresh.where(F.col("was").isNull() | ~same).select(F.lit("upsert").alias("op"), *keys, "summary").unionByName(gone)


def summary(triples: DataFrame, prefix: str = "", after: str = "", page: int = 1000, examples: int = 2) -> DataFrame:
    """section (totals, type or predicate), name, amount, examples: what the graph holds.

    Totals count all entities and those scanned: one page of the sorted listing, of which the types are counted. Predicates cover the whole graph, so
    they are left out below a prefix.
    """
    ids = triples.select(F.col("subject").alias("id")).distinct()
    ids = ids.where(under_prefix(F.col("id"), prefix)) if prefix else ids
    scanned = stored(ids.where(F.col("id") > after).orderBy("id").limit(page), "scanned")
    none = F.lit(None).cast("string")
    line = lambda rows, section, name, amount, more=none: rows.select(F.lit(section).alias("section"), name.alias("name"), amount.cast("long").alias("amount"), more.alias("examples"))
    totals = line(ids.agg(F.count("*").alias("n")), "totals", F.lit("entities"), F.col("n")).union(line(scanned.agg(F.count("*").alias("n")), "totals", F.lit("scanned"), F.col("n")))
    out = totals.union(line(type_summary(scanned, examples), "type", F.col("entity_type"), F.col("entity_count"), F.col("examples")))
    if not prefix:
        held = triples.groupBy("predicate").agg(F.countDistinct("subject").alias("n"))
        out = out.union(line(held, "predicate", F.col("predicate"), F.col("n")))
    return out
