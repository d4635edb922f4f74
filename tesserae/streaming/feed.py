"""The change feed (R1 to R8, R12, B1): arrivals are merged into versioned snapshots, and each batch's last change of a key is published.

State lives in Parquet snapshots under one folder, not in executors: every micro-batch merges what arrived with the current snapshot of
the subjects' buckets that it touches and writes those buckets anew, under the batch's number. A batch that runs again after a failure
writes the same version again, so nothing is applied twice. Lateness is unbounded: an older set of statements is dropped by the merge rule
itself, not by a watermark. A delete (a row with op `delete`) stays in the snapshot as a tombstone, so that what came before it and is
delivered later doesn't return; views leave tombstones out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mutations import replace_by_source

BUCKETS = 64


class FeedLost(ValueError):
    """A batch came after a later one was committed: the feed must be read anew."""


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def versions(spark: SparkSession, base: str) -> DataFrame | None:
    """bucket, version: the newest committed version of each bucket; None before the first batch."""
    path = f"{base}/commits"
    if not exists(spark, path):
        return None
    return spark.read.parquet(path).groupBy("bucket").agg(F.max("version").alias("version"))


def snapshot(spark: SparkSession, base: str, before: int | None = None) -> DataFrame | None:
    """The statements that hold now, or held before a version; None before the first batch."""
    rows = state(spark, base, before)
    return None if rows is None else rows.where("op <> 'delete'").drop("op")


def state(spark: SparkSession, base: str, before: int | None = None) -> DataFrame | None:
    """The snapshot with its tombstones."""
    if not exists(spark, f"{base}/commits"):
        return None
    newest = spark.read.parquet(f"{base}/commits")
    newest = (newest if before is None else newest.where(F.col("version") < before)).groupBy("bucket").agg(F.max("version").alias("version"))
    return spark.read.parquet(f"{base}/state").join(F.broadcast(newest), ["bucket", "version"], "left_semi")


def merge(batch: DataFrame, batch_id: int, base: str, buckets: int = BUCKETS) -> None:
    """Applies one micro-batch of arrivals (columns of sources.envelopes.statements, and op: delete or anything else) to the snapshot.

    Repeats of a delivery change nothing. A batch older than what is committed is refused.
    """
    spark = batch.sparkSession
    if exists(spark, f"{base}/commits") and (spark.read.parquet(f"{base}/commits").agg(F.max("version")).first()[0] or 0) > batch_id:
        raise FeedLost(f"batch {batch_id} came after a later one")
    op = F.when(F.col("op") == "delete", "delete").otherwise("upsert") if "op" in batch.columns else F.lit("upsert")
    arriving = batch.withColumn("op", op).withColumn("bucket", F.pmod(F.xxhash64("subject"), F.lit(buckets)).cast("int"))
    touched = arriving.select("bucket").distinct()
    old = state(spark, base, batch_id)
    every = arriving if old is None else arriving.unionByName(old.drop("version").join(F.broadcast(touched), "bucket", "left_semi"))
    gone = every.where("op = 'delete'").groupBy("subject").agg(F.max("seq").alias("gone_"))
    kept = every.join(gone, "subject", "left").where(F.col("gone_").isNull() | (F.col("seq") > F.col("gone_")) | (F.col("op") == "delete") & (F.col("seq") == F.col("gone_"))).drop("gone_")
    now = replace_by_source(kept.where("op <> 'delete'")).unionByName(kept.where("op = 'delete'").dropDuplicates(["subject"])).withColumn("version", F.lit(batch_id).cast("long"))
    now.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "bucket").parquet(f"{base}/state")
    touched.withColumn("version", F.lit(batch_id).cast("long")).withColumn("revision", F.lit(batch_id)).write.mode("append").parquet(f"{base}/commits")
    changes = arriving.groupBy("subject").agg(F.max("seq").alias("revision"), F.max_by("op", "seq").alias("op"))
    changes.withColumn("version", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(f"{base}/changes")


def vacuum(spark: SparkSession, base: str, before: int) -> int:
    """Deletes the versions of buckets that no snapshot as of `before` or later reads; returns how many. Buckets and versions are listed from the commits alone."""
    commits = spark.read.parquet(f"{base}/commits").select("bucket", "version").distinct()
    newest = commits.where(F.col("version") < before).groupBy("bucket").agg(F.max("version").alias("newest"))
    stale = commits.where(F.col("version") < before).join(newest, "bucket").where("version < newest")
    deleted = 0
    for row in stale.toLocalIterator():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/state/version={row.version}/bucket={row.bucket}")
        deleted += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return deleted


def maintain(arrivals: DataFrame, base: str, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Starts the query that keeps the snapshot current; restarts go on from its checkpoint."""
    writer = arrivals.writeStream.option("checkpointLocation", f"{base}/checkpoint").foreachBatch(lambda df, k: merge(df, k, base, buckets))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def coalesced(changes: DataFrame) -> DataFrame:
    """Of each key (key, revision, op, value) in a window the last change; a value that can't be decoded poisons its key."""
    last = changes.groupBy("key").agg(F.max(F.struct("revision", "op", "value", "readable")).alias("c"))
    op = F.when(F.col("c.op") == "delete", "delete").when(~F.col("c.readable"), "poison").otherwise("upsert")
    return last.select("key", F.col("c.revision").alias("revision"), op.alias("op"), F.when(op == "upsert", F.col("c.value")).alias("value"))


def low_water(delivered: DataFrame, completed: DataFrame) -> DataFrame:
    """revision: the greatest up to which every delivered revision is completed."""
    open_ = delivered.join(completed, "revision", "left_anti").agg(F.min("revision").alias("first_open"))
    return delivered.crossJoin(F.broadcast(open_)).where(F.col("first_open").isNull() | (F.col("revision") < F.col("first_open"))).agg(F.coalesce(F.max("revision"), F.lit(0)).alias("revision"))
