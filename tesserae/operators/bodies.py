"""Texts kept outside the statements (S15, S16, P13): a table of bodies, joined to the documents that refer to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.texts import truncated

CAP = 4000


def listed(bodies: DataFrame, instance: str, prefix: str = "") -> DataFrame:
    """key, size of the bodies (storage_instance, key, content) of a store whose key begins so, by key."""
    return bodies.where((F.col("storage_instance") == instance) & F.col("key").startswith(prefix)).select("key", F.octet_length("content").cast("long").alias("size")).orderBy("key")


def with_bodies(docs: DataFrame, bodies: DataFrame, stores: DataFrame, cap: int = CAP) -> DataFrame:
    """Documents (entity_id, name, body, storage_instance, key) with the text that they refer to, and body_state.

    The body is the document's own text and the referred one, side by side, cut to cap characters. body_state: none (no reference), read,
    missing (its store, one of stores, lacks it), or no_store.
    """
    ref = ["storage_instance", "key"]
    rows = docs.join(bodies.select(*ref, F.substring("content", 1, cap + 1).alias("content")), ref, "left").join(F.broadcast(stores.select("storage_instance").distinct().withColumn("known_", F.lit(True))), "storage_instance", "left")
    state = F.when(F.col("key").isNull(), "none").when(F.col("known_").isNull(), "no_store").when(F.col("content").isNull(), "missing").otherwise("read")
    text = F.concat_ws(" ", F.nullif(F.col("body"), F.lit("")), F.when(state == "read", F.col("content")))
    return rows.select("entity_id", "name", truncated(text, cap).alias("body"), state.alias("body_state"))


def not_indexed(with_state: DataFrame) -> DataFrame:
    """bodies_not_indexed: how many documents refer to a text that wasn't read."""
    return with_state.agg(F.coalesce(F.sum(F.col("body_state").isin("missing", "no_store").cast("long")), F.lit(0)).alias("bodies_not_indexed"))
