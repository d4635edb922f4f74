"""Edges, predicates, names and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import is_relationship, valid_entity_id
from .checkpoints import numbered
from .reads import LABELS, label_salience


class ResourceExhausted(ValueError):
    """More members than a verb answers."""


def edges(triples: DataFrame) -> DataFrame:
    """from_id, predicate, to_id, ord: statements whose object is an entity."""
    rel = is_relationship(F.col("object_kind"), F.col("object_str"), F.col("datatype"))
    return triples.where(rel).select(F.col("subject").alias("from_id"), "predicate", F.col("object_str").alias("to_id"), "ord")


def counts(graph: DataFrame) -> DataFrame:
    """predicate, edges, sources, targets: repeats count as edges, sources and targets once. Either end has its own table of what was seen, so no row is held twice."""
    seen = lambda end: graph.groupBy("predicate", end).agg(F.count("*").alias("n")).groupBy("predicate")
    sources = seen("from_id").agg(F.sum("n").alias("edges"), F.count("from_id").alias("sources"))
    targets = seen("to_id").agg(F.count("to_id").alias("targets"))
    return sources.join(targets, "predicate")


def outgoing(graph: DataFrame, entity: str) -> DataFrame:
    """The entity's own edges in stored order, repeats kept."""
    return numbered(graph.where(F.col("from_id") == entity), ["ord", "to_id"], "place").select("place", "predicate", "to_id")


def incoming(graph: DataFrame, entity: str) -> DataFrame:
    """Distinct edges that point to the entity, by source and predicate."""
    rows = graph.where(F.col("to_id") == entity).select("from_id", "predicate").distinct()
    return numbered(rows, ["from_id", "predicate"], "place").select("place", "from_id", "predicate")


def relationships(graph: DataFrame, entity: str, direction: str) -> DataFrame:
    if direction not in ("outgoing", "incoming"):
        raise ValueError("direction must be outgoing or incoming")
    here, there = ("from_id", "to_id") if direction == "outgoing" else ("to_id", "from_id")
    rows = graph.where(F.col(here) == entity).select("predicate", "from_id", "to_id")
    return rows if direction == "outgoing" else rows.distinct()


def predicate_list(triples: DataFrame, namespace: str = "") -> DataFrame:
    """predicate, entity_count; a namespace is a domain or a domain and category, segment by segment."""
    rows = triples.where(F.col("predicate").startswith(f"{namespace}.")) if namespace else triples
    return rows.groupBy("predicate").agg(F.countDistinct("subject").alias("entity_count"))


def predicate_stats(triples: DataFrame, predicate: str, sample_limit: int = 10) -> DataFrame:
    """entity_count, and the first entities in order as rank and entity_id."""
    ids = triples.where(F.col("predicate") == predicate).select(F.col("subject").alias("entity_id")).distinct()
    first = ids.orderBy("entity_id").limit(sample_limit)
    return first.crossJoin(F.broadcast(ids.agg(F.count("*").alias("entity_count")))).select(
        F.row_number().over(Window.orderBy("entity_id")).cast("long").alias("sample_rank"), "entity_id", "entity_count"
    )


def predicate_entities(triples: DataFrame, predicate: str, value: str | None = None, limit: int = 0) -> DataFrame:
    """rank, entity_id: sorted distinct holders of the predicate, of the value if one is given; the filter comes before the limit."""
    rows = triples.where(F.col("predicate") == predicate)
    ids = (rows.where(F.col("object_str") == value) if value is not None else rows).select(F.col("subject").alias("entity_id")).distinct()
    if not limit:
        return numbered(ids, ["entity_id"], "rank").select("rank", "entity_id")
    ids = ids.orderBy("entity_id").limit(limit)
    return ids.select(F.row_number().over(Window.orderBy("entity_id")).cast("long").alias("rank"), "entity_id")


def predicate_compound(triples: DataFrame, predicates: list[str], operator: str, limit: int = 100) -> DataFrame:
    """rank, entity_id, matched: entities that hold all (AND) or any (OR) of the predicates; matched counts before the limit."""
    wanted = sorted(set(predicates))
    held = triples.where(F.col("predicate").isin(wanted)).groupBy(F.col("subject").alias("entity_id")).agg(F.countDistinct("predicate").alias("held"))
    ids = held.where(F.col("held") == len(wanted)) if operator == "AND" else held
    total = ids.agg(F.count("*").alias("matched"))
    rows = ids.select("entity_id").orderBy("entity_id").limit(limit).crossJoin(F.broadcast(total))
    return rows.select(F.row_number().over(Window.orderBy("entity_id")).cast("long").alias("rank"), "entity_id", "matched")


def folded(text):
    return F.lower(F.trim(text))


def names(triples: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """name_key, entity_id, predicate, name, priority (the lower the better)."""
    named = triples.where(F.col("predicate").isin(*labels) & (F.col("object_kind") == "string") & (F.col("object_str") != ""))
    return named.select(folded(F.col("object_str")).alias("name_key"), F.col("subject").alias("entity_id"), "predicate", F.col("object_str").alias("name"), label_salience(labels).alias("priority"))


def by_name(index: DataFrame, name: str, limit: int = 10, most: int | None = 2000) -> DataFrame:
    """rank, entity_id, exact: the best name of each entity; exact case first, then priority, then id. Over `most` memberships is refused; None answers any number."""
    held = index.where(F.col("name_key") == folded(F.lit(name))).withColumn("exact", F.col("name") == name)
    if most is not None and held.limit(most + 1).count() > most:
        raise ResourceExhausted(f"over {most} entities are named so")
    best = held.groupBy("entity_id").agg(F.min(F.struct((~F.col("exact")).alias("other"), "priority", "predicate")).alias("b"))
    order = ("b.other", "b.priority", "entity_id")
    return best.orderBy(*order).limit(limit).select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "entity_id", (~F.col("b.other")).alias("exact"))


def aliases(triples: DataFrame, predicates: list[str]) -> DataFrame:
    rows = triples.where(F.col("predicate").isin(predicates) & (F.col("object_kind") == "string"))
    return rows.select(folded(F.col("object_str")).alias("alias_key"), F.col("subject").alias("entity_id"), "predicate").where("alias_key <> ''").distinct()


def resolve_aliases(index: DataFrame, asked: DataFrame) -> DataFrame:
    """alias, entity_id, outcome: resolved to the only holder, not_found, or alias_ambiguous; a blank alias is refused."""
    want = asked.select("alias", folded(F.col("alias")).alias("alias_key"))
    held = index.join(want.select("alias_key").distinct(), "alias_key", "left_semi").groupBy("alias_key").agg(F.countDistinct("entity_id").alias("holders"), F.min("entity_id").alias("only"))
    outcome = F.when(F.col("alias_key") == "", "refused").when(F.col("holders").isNull(), "not_found").when(F.col("holders") > 1, "alias_ambiguous").otherwise("resolved")
    return want.join(held, "alias_key", "left").select("alias", F.when(F.col("holders") == 1, F.col("only")).alias("entity_id"), outcome.alias("outcome"))


def resolve_references(index: DataFrame, asked: DataFrame) -> DataFrame:
    """alias, entity_id: an alias's holder, else the reference itself if it is a valid id, else null."""
    return resolve_aliases(index, asked).select("alias", F.coalesce("entity_id", F.when(valid_entity_id(F.col("alias")), F.col("alias"))).alias("entity_id"))
