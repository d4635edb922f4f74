"""The vocabulary as a table (S17, S18, J10, K4): what is known of each predicate and of entity types.

predicates: predicate, iri, datatype, weight, label_order (null if it gives no label; the lower the better), alias_priority (null if it gives no alias).
types: entity_type, class_iri. Both are small by nature, and joins with them are left to Catalyst's own size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import predicate_reason

PREDICATES = "predicate:string, iri:string, datatype:string, weight:double, label_order:int, alias_priority:int"
TYPES = "entity_type:string, class_iri:string"
# The datatypes that a predicate may declare.
DATATYPES = ("string", "entity_id", "int", "float", "bool", "datetime", "json")


class BrokenPack(ValueError):
    """A vocabulary pack with an entry that can't be taken; no part of it is."""


def packs(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Predicates and types of packs: JSON files {"predicates": [...], "types": [...]}. An invalid or contradicting entry refuses them all."""
    rows = spark.read.schema(f"predicates array<struct<{PREDICATES}>>, types array<struct<{TYPES}>>").json(list(paths), multiLine=True)
    predicates, types = rows.select(F.explode("predicates").alias("p")).select("p.*").distinct(), rows.select(F.explode("types").alias("t")).select("t.*").distinct()
    wrong = predicates.where(predicate_reason(F.col("predicate")).isNotNull() | ~F.coalesce("datatype", F.lit("string")).isin(*DATATYPES)).select("predicate")
    twice = predicates.groupBy("predicate").count().where("count > 1").select("predicate")
    if bad := wrong.union(twice).first():
        raise BrokenPack(f"predicate {bad.predicate}")
    return predicates, types


def by_iri(predicates: DataFrame, iri: str) -> DataFrame:
    return predicates.where(F.col("iri") == iri)


def label_predicates(predicates: DataFrame) -> DataFrame:
    """predicate, label_order: the predicates that name an entity, the most salient first."""
    return predicates.where(F.col("label_order").isNotNull()).select("predicate", "label_order").orderBy("label_order", "predicate")


def alias_predicates(predicates: DataFrame) -> DataFrame:
    return predicates.where(F.col("alias_priority").isNotNull()).select("predicate", "alias_priority").orderBy("alias_priority", "predicate")


def types_of_class(types: DataFrame, class_iri: str) -> DataFrame:
    return types.where(F.col("class_iri") == class_iri).select("entity_type").orderBy("entity_type")


def described(triples: DataFrame, predicates: DataFrame) -> DataFrame:
    """Statements with what the vocabulary says of their predicates; unknown predicates have nulls."""
    return triples.join(predicates.select("predicate", "iri", F.col("datatype").alias("declared"), "weight", "label_order", "alias_priority"), "predicate", "left")


def labels(triples: DataFrame, predicates: DataFrame) -> DataFrame:
    """subject, label: the first non-empty string of the most salient label predicate that an entity holds."""
    named = triples.where((F.col("object_kind") == "string") & (F.col("object_str") != "")).join(label_predicates(predicates), "predicate")
    return named.groupBy("subject").agg(F.min_by("object_str", F.struct("label_order", "predicate", "ord", "object_str")).alias("label"))
