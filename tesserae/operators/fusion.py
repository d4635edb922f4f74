"""Answers composed of resolved, ranked and expanded entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED_WEIGHT, DEPTH_WEIGHT, SALIENCE_WEIGHT = 4.0, 1.5, 3.0
EXACT, PREFIX, CONTAINS = 40.0, 20.0, 8.0
RELATIONS, EVIDENCE, FACTS, EDGES, RESOLVED = 12, 8, 64, 256, 40


def salience(triples: DataFrame, weights: DataFrame) -> DataFrame:
    """subject, salience: the largest positive plus the smallest negative weight (predicate, weight) of the predicates that an entity holds."""
    held = triples.select("subject", "predicate").distinct().join(F.broadcast(weights), "predicate")
    return held.groupBy("subject").agg((F.greatest(F.max("weight"), F.lit(0.0)) + F.least(F.min("weight"), F.lit(0.0))).alias("salience"))


def rank(seeds: DataFrame, query: str) -> DataFrame:
    """place, entity_id, score of seeds (position from 0, entity_id, label, depth, salience): by score, then by position."""
    low, q = F.lower("label"), query.lower()
    lexical = F.when(low == q, EXACT).when(low.startswith(q), PREFIX).when(low.contains(q), CONTAINS).otherwise(0.0)
    n = seeds.agg(F.count("*").alias("n"))
    score = SEED_WEIGHT * (F.col("n") - F.col("position")) + F.coalesce(lexical, F.lit(0.0)) + DEPTH_WEIGHT * F.coalesce("depth", F.lit(0)) + SALIENCE_WEIGHT * F.coalesce("salience", F.lit(0.0))
    rows = seeds.crossJoin(F.broadcast(n)).select("position", "entity_id", F.round(score, 6).alias("score"))
    order = Window.orderBy(F.col("score").desc(), "position")
    return rows.select(F.row_number().over(order).cast("long").alias("place"), "entity_id", "score")


def relations(graph: DataFrame, seeds: DataFrame, predicates: list[str], labels: DataFrame, cap: int = RELATIONS) -> DataFrame:
    """entity_id, role (out or in), place, predicate, other, label, truncated: the first distinct relations of each seed and role."""
    kept = graph.where(F.col("predicate").isin(predicates))
    ids = seeds.select("entity_id").distinct()
    out = kept.join(ids, kept["from_id"] == ids["entity_id"]).select("entity_id", F.lit("out").alias("role"), "predicate", F.col("to_id").alias("other"))
    into = kept.join(ids, kept["to_id"] == ids["entity_id"]).select("entity_id", F.lit("in").alias("role"), "predicate", F.col("from_id").alias("other"))
    rows = out.union(into).distinct()
    by = Window.partitionBy("entity_id", "role")
    rows = rows.withColumn("place", F.row_number().over(by.orderBy("predicate", "other")).cast("long"))
    rows = rows.withColumn("truncated", F.count("*").over(by) > cap).where(F.col("place") <= cap)
    return rows.join(labels.withColumnRenamed("subject", "other"), "other", "left").select("entity_id", "role", "place", "predicate", "other", "label", "truncated")


def facts(triples: DataFrame, seeds: DataFrame, cap: int = FACTS, evidence_cap: int = EVIDENCE) -> DataFrame:
    """entity_id, place, predicate, object_str, evidence (sources, joined by commas), truncated: literals of each seed, merged by value."""
    ids = seeds.select(F.col("entity_id").alias("subject")).distinct()
    rows = triples.join(ids, "subject").where("datatype <> '@id'")
    merged = rows.groupBy("subject", "predicate", "datatype", "object_str").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    by = Window.partitionBy("subject")
    merged = merged.withColumn("place", F.row_number().over(by.orderBy("predicate", "datatype", "object_str")).cast("long")).withColumn("truncated", F.count("*").over(by) > cap)
    return merged.where(F.col("place") <= cap).select(F.col("subject").alias("entity_id"), "place", "predicate", "object_str", F.array_join(F.slice("sources", 1, evidence_cap), ",").alias("evidence"), "truncated")


def answer(seeds: DataFrame, query: str, triples: DataFrame, labels: DataFrame, weights: DataFrame, nodes: int = 20) -> DataFrame:
    """place, entity_id, label, score, provenance, truncated: the nodes of a fused answer.

    Seeds (rank, entity_id, provenance: deterministic, lexical or embedding) are at most 40; those that no statement is about are left out, the
    others are ranked by their place, what their label shares with the query, and their salience; the first `nodes` are kept.
    """
    first = seeds.orderBy("rank", "entity_id").limit(RESOLVED)
    held = triples.join(first.select(F.col("entity_id").alias("subject")).distinct(), "subject", "left_semi")
    known = held.select(F.col("subject").alias("entity_id")).distinct()
    rows = first.join(known, "entity_id", "left_semi").join(labels.withColumnRenamed("subject", "entity_id"), "entity_id", "left").join(salience(held, weights).withColumnRenamed("subject", "entity_id"), "entity_id", "left")
    rows = rows.withColumn("position", F.row_number().over(Window.orderBy("rank", "entity_id")) - 1).withColumn("depth", F.lit(0))
    placed = rank(rows, query).join(rows.select("entity_id", "label", "provenance"), "entity_id")
    cut = placed.agg((F.count("*") > nodes).alias("truncated"))
    return placed.where(F.col("place") <= nodes).crossJoin(F.broadcast(cut)).select("place", "entity_id", "label", "score", "provenance", "truncated")


def did_you_mean(query: str, index: DataFrame, most: int = 5) -> DataFrame:
    """name: up to five names (name_key, name) that begin as the query's text does, for a query that resolves to nothing."""
    low = query.strip().lower()
    near = index.where(F.col("name_key").startswith(low[: max(len(low) // 2, 1)])) if low else index.limit(0)
    return near.select("name").distinct().orderBy(F.levenshtein(F.lower("name"), F.lit(low)), "name").limit(most)


def graph_edges(triples: DataFrame, seeds: DataFrame, declared: list[str], cap: int = EDGES) -> DataFrame:
    """from_id, predicate, to_id, evidence, truncated: directed edges between seeds and others, by declared predicates or `@id`; the shape of a value alone makes none."""
    link = (F.col("datatype") == "@id") | (F.col("predicate").isin(declared) if declared else F.lit(False))
    ids = seeds.select("entity_id").distinct()
    rows = triples.where(link & (F.col("object_kind") == "string"))
    out = rows.join(ids.withColumnRenamed("entity_id", "subject"), "subject", "left_semi").unionByName(rows.join(ids.withColumnRenamed("entity_id", "object_str"), "object_str", "left_semi").select(rows.columns))
    found = out.groupBy(F.col("subject").alias("from_id"), "predicate", F.col("object_str").alias("to_id")).agg(F.array_join(F.slice(F.array_sort(F.collect_set("source")), 1, EVIDENCE), ",").alias("evidence"))
    kept = found.orderBy("from_id", "predicate", "to_id").limit(cap + 1)
    n = kept.agg(F.count("*").alias("n_"))
    return kept.orderBy("from_id", "predicate", "to_id").limit(cap).crossJoin(F.broadcast(n)).select("from_id", "predicate", "to_id", "evidence", (F.col("n_") > cap).alias("truncated"))


def edge_evidence(graph: DataFrame, triples: DataFrame, cap: int = EVIDENCE) -> DataFrame:
    """from_id, predicate, to_id, evidence: the sources of the statements behind each edge."""
    found = graph.select("from_id", "predicate", "to_id").distinct().join(triples.select(F.col("subject").alias("from_id"), "predicate", F.col("object_str").alias("to_id"), "source"), ["from_id", "predicate", "to_id"])
    return found.groupBy("from_id", "predicate", "to_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("source")), 1, cap), ",").alias("evidence"))
