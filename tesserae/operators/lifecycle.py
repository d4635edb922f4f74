"""Workflows over phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEPT = 64


def terminal_phases(transitions: DataFrame) -> DataFrame:
    """phase: phases of a declared table (from_phase, to_phase) that nothing leaves."""
    every = transitions.select(F.col("from_phase").alias("phase")).union(transitions.select("to_phase")).distinct()
    return every.join(transitions.select(F.col("from_phase").alias("phase")), "phase", "left_anti")


def judged(requests: DataFrame, states: DataFrame, transitions: DataFrame) -> DataFrame:
    """entity_id, to_phase, outcome of requests (entity_id, to_phase) against states (entity_id, phase)."""
    known = transitions.select(F.col("from_phase").alias("to_phase")).union(transitions.select("to_phase")).distinct().withColumn("known", F.lit(True))
    ends = terminal_phases(transitions).withColumn("ended", F.lit(True))
    edges = transitions.select(F.col("from_phase").alias("phase"), "to_phase").distinct().withColumn("declared", F.lit(True))
    rows = requests.join(states, "entity_id", "left").join(F.broadcast(known), "to_phase", "left").join(F.broadcast(ends), "phase", "left").join(F.broadcast(edges), ["phase", "to_phase"], "left")
    outcome = F.when(F.col("phase").isNull(), "not_found").when(F.col("known").isNull(), "undeclared_phase").when(F.col("ended"), "terminal").when(F.col("declared").isNull(), "undeclared_transition").otherwise("applied")
    return rows.select("entity_id", "to_phase", outcome.alias("outcome"))


def history(records: DataFrame, kept: int = KEPT) -> DataFrame:
    """entity_id, place (1: latest), at, from_phase, to_phase, chained: the last transitions of each entity; chained if each begins where the one before ended."""
    by = Window.partitionBy("entity_id")
    order = by.orderBy("at", "record_id")
    before = F.lag("to_phase").over(order)
    rows = records.withColumn("chained", before.isNull() | (before == F.col("from_phase")))
    rows = rows.withColumn("place", F.row_number().over(by.orderBy(F.col("at").desc(), F.col("record_id").desc())).cast("long"))
    return rows.where(F.col("place") <= kept).select("entity_id", "place", "at", "from_phase", "to_phase", "chained")


def listed(states: DataFrame, transitions: DataFrame, phase: str | None = None, active: bool | None = None, offset: int = 0, limit: int = 0, **equal) -> DataFrame:
    """States (entity_id, phase, ...) by entity: of a phase, active or ended, with equal fields; then offset, then limit (0: all)."""
    if unknown := set(equal) - set(states.columns):
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    rows = states if phase is None else states.where(F.col("phase") == phase)
    if active is not None:
        rows = rows.join(F.broadcast(terminal_phases(transitions)), "phase", "left_anti" if active else "left_semi")
    for k, v in equal.items():
        rows = rows.where(F.col(k) == v)
    rows = rows.orderBy("entity_id").offset(offset)
    return rows.limit(limit) if limit else rows


def children(graph: DataFrame, states: DataFrame, parent: str, link: str, workflow: str | None = None, offset: int = 0, limit: int = 0) -> DataFrame:
    """workflow, entity_id, phase of what the parent links to and what is managed, by workflow and id."""
    ids = graph.where((F.col("from_id") == parent) & (F.col("predicate") == link)).select(F.col("to_id").alias("entity_id")).distinct()
    rows = states.join(ids, "entity_id", "left_semi")
    rows = (rows.where(F.col("workflow") == workflow) if workflow else rows).orderBy("workflow", "entity_id").offset(offset)
    return (rows.limit(limit) if limit else rows).select("workflow", "entity_id", "phase")


def references(triples: DataFrame, subject: str, predicates: list[str]) -> DataFrame:
    """place, predicate, object_str: string objects of the declared reference predicates, in the order of the declaration, then as stored."""
    spec = F.array_position(F.array(*map(F.lit, predicates)), F.col("predicate"))
    rows = triples.where((F.col("subject") == subject) & F.col("predicate").isin(predicates) & (F.col("object_kind") == "string"))
    return rows.select(F.row_number().over(Window.orderBy(spec, "ord", "object_str")).cast("long").alias("place"), "predicate", "object_str")
