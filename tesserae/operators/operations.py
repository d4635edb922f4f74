"""Operational reads: message logs, key/value buckets, storage growth, error rates, readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import subject_regex


def messages(log: DataFrame, pattern: str, limit: int = 100) -> DataFrame:
    """Newest entries (subject, ts, message_id) whose subject the pattern covers; the filter comes before the limit."""
    return log.where(F.col("subject").rlike(subject_regex(pattern))).orderBy(F.col("ts").desc(), F.col("message_id").desc()).limit(limit)


def trace(log: DataFrame, trace_id: str) -> DataFrame:
    """All entries of one trace, oldest first."""
    return log.where(F.col("trace_id") == trace_id).orderBy("ts", "message_id")


def log_stats(log: DataFrame) -> DataFrame:
    """entries, subjects, oldest, newest of the whole log."""
    return log.agg(F.count("*").alias("entries"), F.countDistinct("subject").alias("subjects"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def subjects(log: DataFrame) -> DataFrame:
    return log.groupBy("subject").agg(F.count("*").alias("entries"), F.max("ts").alias("newest"))


def bucket(entries: DataFrame, pattern: str = ">", status: str | None = None, limit: int = 100) -> DataFrame:
    """Entries (key, value) by key whose key the pattern covers and whose JSON has that top-level status."""
    rows = entries.where(F.col("key").rlike(subject_regex(pattern)))
    rows = rows.where(F.get_json_object("value", "$.status") == status) if status is not None else rows
    return rows.orderBy("key").limit(min(limit or 100, 1000))


def growth(samples: DataFrame, least_seconds: int = 5) -> DataFrame:
    """key, ts, rate: change of `bytes` a second against the newest sample at least so many seconds older; null if there is none.

    A range window by time holds all older samples of a key, and its last value is the baseline, so nothing is joined.
    """
    by = Window.partitionBy("key").orderBy("micros").rangeBetween(Window.unboundedPreceding, -least_seconds * 1_000_000)
    rows = samples.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = rows.withColumn("base", F.last(F.struct("micros", "bytes")).over(by))
    return rows.select("key", "ts", (F.round((F.col("bytes") - F.col("base.bytes")) / ((F.col("micros") - F.col("base.micros")) / 1e6), 6) + 0.0).alias("rate"))


# Bands from the mildest, with the free share and the seconds left at or below which a store is in them.
BANDS = (("warning", 0.25, 72 * 3600.0), ("high", 0.15, 24 * 3600.0), ("critical", 0.05, 4 * 3600.0))


def pressure(stores: DataFrame) -> DataFrame:
    """key, headroom, seconds_left, band, raised_by of stores (key, bytes, capacity, rate): the more severe of the bands of headroom and horizon.

    The seconds left run to the critical free share at the rate known; without a positive rate there are none, even for a full store. A
    store without a capacity has no band. raised_by says which of the two gave the band.
    """
    free = (F.col("capacity") - F.col("bytes")) / F.col("capacity")
    limit = F.floor(F.col("capacity") * (1 - BANDS[-1][1]))
    seconds = F.when((F.col("rate") > 0) & ~F.isnan("rate"), F.greatest((limit - F.col("bytes")) / F.col("rate"), F.lit(0.0)))
    severity = lambda value, at: F.when(value.isNull(), 0).otherwise(sum((value <= band[at]).cast("int") for band in BANDS))
    space, time = severity(free, 1), severity(seconds, 2)
    worst = F.greatest(space, time)
    bounded = F.col("capacity") > 0
    raised = F.when(worst == 0, "none").when(space == time, "both").when(space > time, "headroom").otherwise("time-to-threshold")
    names = F.array(F.lit("normal"), *(F.lit(band[0]) for band in BANDS))
    columns = {"headroom": F.round(free, 6), "seconds_left": F.round(seconds, 6), "band": F.element_at(names, worst + 1), "raised_by": raised}
    return stores.select("key", *(F.when(bounded, c).alias(k) for k, c in columns.items()))


def error_rates(results: DataFrame, last: int = 20, least: int = 5, limit: float = 0.5) -> DataFrame:
    """endpoint, at, rate, tripped: share of failures in each endpoint's last results; tripped above the limit with enough of them."""
    by = Window.partitionBy("endpoint").orderBy("at", "result_id").rowsBetween(-(last - 1), 0)
    n, bad = F.count("*").over(by), F.sum(F.when(F.col("failed"), 1).otherwise(0)).over(by)
    return results.select("endpoint", "at", "result_id", F.round(bad / n, 6).alias("rate"), ((n >= least) & (bad / n > limit)).alias("tripped"))


def readiness(indexed: DataFrame) -> DataFrame:
    """name, lag, state of indexes (name, target, indexed, damaged)."""
    lag = F.greatest(F.col("target") - F.col("indexed"), F.lit(0))
    return indexed.select("name", lag.alias("lag"), F.when(F.col("damaged") > 0, "degraded").when((F.col("target") > 0) & (lag == 0), "ready").otherwise("building").alias("state"))
