"""Messages as statements (S1, S2, S4): JSON envelopes are decoded, stamped and validated; what can't be taken goes to quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import entity_id_reason, predicate_reason

STATEMENT = "struct<predicate:string,object:string,object_num:double,datatype:string,source:string,ts:timestamp,confidence:double>"
ENVELOPE = f"struct<id:string,type:string,source:string,created_at:timestamp,entity_id:string,statements:array<{STATEMENT}>>"
# The sources of statements that only the engine itself writes; the last bears the name of the engine.
RESERVED = ("graph-ingest-indexing-profile", "graph-ingest-hierarchy", "tesserae-lifecycle")


def decoded(messages: DataFrame) -> DataFrame:
    """The messages (value: JSON text, seq: order of arrival) with their envelope as `m` and `reason`, null if it can be taken."""
    rows = messages.select("value", "seq", F.from_json("value", ENVELOPE).alias("m"))
    reason = (
        F.when(F.col("m").isNull() | F.col("m.id").isNull() & F.col("m.entity_id").isNull(), "unreadable")
        .when(entity_id_reason(F.col("m.entity_id")).isNotNull(), F.concat(F.lit("entity id: "), entity_id_reason(F.col("m.entity_id"))))
        .when(F.coalesce(F.size("m.statements"), F.lit(0)) < 1, "no statements")
        .when(F.exists("m.statements", lambda s: predicate_reason(s["predicate"]).isNotNull()), "noncanonical predicate")
        .when(F.exists("m.statements", lambda s: F.coalesce(s["source"], F.lit("")).isin(*RESERVED)), "reserved source")
    )
    return rows.withColumn("reason", reason)


def quarantined(messages: DataFrame) -> DataFrame:
    return decoded(messages).where("reason is not null").select("value", "seq", "reason")


def statements(messages: DataFrame) -> DataFrame:
    """Arrivals: one row a statement, with missing sources and timestamps taken from the envelope, and seq."""
    rows = decoded(messages).where("reason is null").select("seq", "m.entity_id", "m.source", "m.created_at", F.posexplode("m.statements").alias("ord", "s"))
    kind = F.when(F.col("s.object_num").isNotNull(), "number").when(F.col("s.object").isNull(), "null").otherwise("string")
    return rows.select(
        F.col("entity_id").alias("subject"),
        F.col("s.predicate").alias("predicate"),
        kind.alias("object_kind"),
        F.coalesce(F.col("s.object"), F.col("s.object_num").cast("string"), F.lit("")).alias("object_str"),
        F.col("s.object_num").alias("object_num"),
        F.coalesce(F.nullif(F.col("s.source"), F.lit("")), "source").alias("source"),
        F.coalesce(F.col("s.ts"), "created_at").alias("ts"),
        F.coalesce(F.col("s.confidence"), F.lit(1.0)).alias("confidence"),
        F.coalesce(F.col("s.datatype"), F.lit("")).alias("datatype"),
        "ord",
        "seq",
    )
