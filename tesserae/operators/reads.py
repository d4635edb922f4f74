"""Reads of entities and their statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import entity_id_reason, in_scope, matches_pattern, predicate_reason, valid_entity_id
from .checkpoints import stored

MAX_PAGE = 1000
#: Label predicates by salience, the most salient first.
LABELS = ("dc.terms.title", "page.body.title")


def statement_damage(triples: DataFrame):
    """Why a statement breaks the contract; null if it doesn't. An entity with one such statement is damaged as a whole."""
    return (
        F.when(predicate_reason(F.col("predicate")).isNotNull(), "noncanonical predicate")
        .when(entity_id_reason(F.col("subject")).isNotNull(), "noncanonical entity id")
        .when((F.col("datatype") == "@id") & ~valid_entity_id(F.col("object_str")), "noncanonical entity id")
        .when((F.coalesce("source", F.lit("")) == "") | F.col("ts").isNull(), "missing statement metadata")
    )


def damaged_entities(triples: DataFrame) -> DataFrame:
    """subject, reason: entities that every view leaves out, each once."""
    broken = triples.withColumn("reason", statement_damage(triples)).where("reason is not null")
    return broken.groupBy("subject").agg(F.min_by("reason", F.struct("ord", "predicate")).alias("reason"))


def intact(triples: DataFrame) -> DataFrame:
    return triples.join(damaged_entities(triples).select("subject"), "subject", "left_anti")


def entities(triples: DataFrame) -> DataFrame:
    """id, kv_revision stand-in (statements), updated_at."""
    return triples.groupBy(F.col("subject").alias("id")).agg(F.count("*").alias("statements"), F.max("ts").alias("updated_at"))


def entity(triples: DataFrame, entity_id: str) -> DataFrame:
    """All statements of one entity in stored order."""
    rank = F.row_number().over(Window.orderBy("ord", "predicate", "object_str"))
    return triples.where(F.col("subject") == entity_id).select(rank.cast("long").alias("position"), "predicate", "object_str", "source")


def batch(triples: DataFrame, requested: DataFrame) -> DataFrame:
    """id, statements, reason for every requested id, each once: found, or missing as not_found, error (an empty id) or damaged."""
    asked = requested.select(F.col("id")).distinct()
    own = entities(triples.join(asked, F.col("subject") == F.col("id"), "left_semi"))
    broken = damaged_entities(triples.join(asked, F.col("subject") == F.col("id"), "left_semi")).select(F.col("subject").alias("id"), F.lit(True).alias("broken"))
    reason = F.when(F.coalesce("id", F.lit("")) == "", "error").when(F.col("broken"), "damaged").when(F.col("statements").isNull(), "not_found")
    return asked.join(own, "id", "left").join(broken, "id", "left").select("id", F.coalesce("statements", F.lit(0)).alias("statements"), reason.alias("reason"))


def page(triples: DataFrame, prefix: str | None = None, pattern: str | None = None, after: str = "", limit: int = MAX_PAGE) -> DataFrame:
    """rank, id, total: one page of the sorted listing below a prefix or of a six-part pattern, after a cursor's key."""
    limit = limit if 0 < limit <= MAX_PAGE else MAX_PAGE
    ids = triples.select(F.col("subject").alias("id"))
    ids = stored(ids.where(matches_pattern(F.col("id"), pattern) if pattern else in_scope(F.col("id"), [prefix] if prefix else None)).distinct(), "listing")
    total = ids.agg(F.count("*").alias("total"))
    rows = ids.where(F.col("id") > after).orderBy("id").limit(limit)
    return rows.crossJoin(F.broadcast(total)).select(F.row_number().over(Window.orderBy("id")).cast("long").alias("rank"), "id", "total")


def scan(triples: DataFrame, subject: str = "", predicate: str = "", object_: str = "", limit: int = 100) -> DataFrame:
    """Statements that equal all given parts, by entity then stored order; 100 by default, 1000 at most."""
    given = {"subject": subject, "predicate": predicate, "object_str": object_}
    limit = limit if 0 < limit <= MAX_PAGE else MAX_PAGE if limit > MAX_PAGE else 100
    rows = triples.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in given.items() if v], F.lit(True)))
    order = ("subject", "ord", "predicate", "object_str")
    rows = rows.orderBy(*order).limit(limit)
    return rows.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "subject", "predicate", "object_str")


def latest_statement(triples: DataFrame) -> DataFrame:
    """One statement for each subject and predicate: the latest, then the smallest source, then the first stored."""
    order = F.struct(-F.unix_micros(F.col("ts").cast("timestamp")), "source", "ord", "object_str")
    first = triples.groupBy("subject", "predicate").agg(F.min_by(F.struct("object_str", "ts"), order).alias("first"))
    return first.select("subject", "predicate", "first.object_str", "first.ts")


def label_salience(labels: tuple[str, ...] = LABELS):
    return F.coalesce(*(F.when(F.col("predicate") == p, i) for i, p in enumerate(labels)))


def entity_labels(triples: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """subject, label: the first non-empty string of the most salient label predicate that an entity holds."""
    named = triples.where(F.col("predicate").isin(*labels) & (F.col("object_kind") == "string") & (F.col("object_str") != ""))
    return named.groupBy("subject").agg(F.min_by("object_str", F.struct(label_salience(labels), "predicate", "ord", "object_str")).alias("label"))


class NotYetIndexed(ValueError):
    """What is asked for is newer than what is indexed."""


def at_revision(view: DataFrame, indexed_revision: int, min_revision: int = 0) -> DataFrame:
    """The view, unless a caller asks for a later revision than it holds."""
    if min_revision > indexed_revision:
        raise NotYetIndexed(f"revision {min_revision} is asked for, {indexed_revision} is indexed")
    return view


def page_within(rows: DataFrame, order: list, budget: int) -> DataFrame:
    """The leading rows of a page whose JSON encodings, commas included, fit into so many bytes, the first always. A page has 1000 rows at most."""
    size = F.octet_length(F.to_json(F.struct(*rows.columns))) + 1
    page = rows.orderBy(*order).limit(MAX_PAGE).withColumn("size_", size).withColumn("page_", F.lit(1))
    return within_budget(page, ["page_"], order, "size_", MAX_PAGE, budget).drop("size_", "page_", "place")


def hydrated(hits: DataFrame, triples: DataFrame) -> DataFrame:
    """rank, entity_id, statements, state of hits (rank, entity_id) in their order: found, missing or damaged; only the found are answers, the others are counted."""
    own = triples.join(hits.select(F.col("entity_id").alias("subject")).distinct(), "subject", "left_semi")
    held = own.groupBy(F.col("subject").alias("entity_id")).agg(F.count("*").alias("statements"))
    broken = damaged_entities(own).select(F.col("subject").alias("entity_id"), F.lit(True).alias("broken"))
    state = F.when(F.col("statements").isNull(), "missing").when(F.col("broken"), "damaged").otherwise("found")
    rows = hits.select("rank", "entity_id").join(held, "entity_id", "left").join(broken, "entity_id", "left")
    return rows.select("rank", "entity_id", F.when(state == "found", F.col("statements")).alias("statements"), state.alias("state"))


def within_budget(rows: DataFrame, group: list[str], order: list, size: str, max_rows: int = 20, max_size: int = 60_000) -> DataFrame:
    """The leading rows of each group that fit: the first always, then until the count or the sum of sizes is reached; nothing after a refusal."""
    by = Window.partitionBy(*group).orderBy(*order)
    sums = F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(by)
    fits = (place == 1) | (place <= max_rows) & (sums <= max_size)
    return rows.select("*", place.cast("long").alias("place"), fits.alias("fits_")).withColumn("refused_", F.max(F.when(F.col("fits_"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("refused_ = 0").drop("fits_", "refused_")
