"""Operator 5: sharding by balanced label propagation.

Every document carries the label of a shard. Each round joins the links with the labels, and a document proposes to move to the
shard with most votes. A linked document with a smaller id has one vote, one with a larger id half a vote, and the document itself
three quarters of a vote for each of its links, so that neighbours don't swap their shards for ever. Quotas decide: a shard takes its
quota of proposals, those that stay before those that come; documents that it can't take fill the places left in other shards,
kept side by side in the order of their groups. So after every round the shards' counts differ by one at most (law `rows`),
while links between shards become fewer.

Documents with equal texts are linked, but not by all pairs: a large group falls into as many fans as its size asks for, so that
a fan holds about as many rows as a bucket does; each document is linked with the first of its fan, and the firsts of the fans with the first of all.
Numbering never sorts a shard in one task: rows are numbered inside buckets, whose sizes are summed up in a small table. cut_links says
how many linked pairs ended in different shards.

Null texts have the size 8 and form a group, as empty texts do; very long ones are groups like others. Rows with a null doc_id and rows that
share a doc_id are rows of their own, as are repeated rows. Ties are settled by the order of groups and rows. Other columns are ignored.
Without rows there are no shards. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stored

SHARDS, ROUNDS, BUCKET_ROWS, LEAST_BUCKETS, MOST_LARGE = 24, 3, 100_000, 128, 100_000


def numbered(df: DataFrame, within: list[str], buckets: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the position, from 0, of each row among those with equal `within`, ordered by `buckets`, then `order`.

    Only rows of one bucket meet in one task; the buckets' sizes, a table that is small by construction, are summed up apart.
    """
    sizes = df.groupBy(*within, *buckets).agg(F.count("*").alias("size_"))
    before = Window.partitionBy(*within).orderBy(*buckets) if within else Window.orderBy(*buckets)
    sizes = sizes.select(*within, *buckets, (F.sum("size_").over(before) - F.col("size_")).alias("before_"))
    inside = F.row_number().over(Window.partitionBy(*within, *buckets).orderBy(*order))
    return df.join(sizes, [*within, *buckets]).withColumn(name, F.col("before_") + inside - 1).drop("before_")


def text_groups(df: DataFrame, text: str = "text") -> DataFrame:
    """row_id, doc_id, size, text_crc32, group (hash of the text), b and fan (place of the row in the order of groups)."""
    rows = df.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(F.col(text).isNull(), F.lit("null")).otherwise(F.sha2(F.col(text).cast("binary"), 256)).alias("group"),
    )
    rows = stored(rows, "sharded-rows")
    n = rows.count()
    buckets = max(LEAST_BUCKETS, n // BUCKET_ROWS)
    # Groups larger than a bucket are spread over fans of that size; there are 2 * LEAST_BUCKETS or MOST_LARGE such groups at most, which are broadcast.
    most = max(min(BUCKET_ROWS, n // (2 * LEAST_BUCKETS)), n // MOST_LARGE, 1)
    large = rows.groupBy("group").agg(F.count("*").alias("members")).where(F.col("members") > most).select("group", F.ceil(F.col("members") / most).cast("int").alias("fans"))
    rows = rows.join(F.broadcast(large), "group", "left")
    rows = rows.withColumn("b", F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("int"))
    return rows.withColumn("fan", F.when(F.col("fans").isNull(), 0).otherwise(F.pmod(F.xxhash64("row_id"), F.col("fans"))).cast("int")).drop("fans")


def equal_text_links(rows: DataFrame) -> DataFrame:
    """a, b: links among the rows of each group, as many as there are rows, less one for each group."""
    fans = rows.groupBy("group", "fan").agg(F.min("row_id").alias("first"), F.count("*").alias("members"))
    heads = fans.groupBy("group").agg(F.min("first").alias("head"))
    within = rows.join(fans.where("members > 1"), ["group", "fan"]).where(F.col("row_id") != F.col("first")).select(F.col("first").alias("a"), F.col("row_id").alias("b"))
    across = fans.join(heads, "group").where(F.col("first") != F.col("head")).select(F.col("head").alias("a"), F.col("first").alias("b"))
    return within.union(across)


def propagate(rows: DataFrame, links: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """rows with `shard`: labels after so many rounds over the links (a, b between row_ids), counts at most one apart."""
    n = rows.count()
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))), "shard-links")
    degree = both.groupBy(F.col("a").alias("row_id")).agg(F.count("*").alias("links"))
    quota = F.lit(n // shards) + F.when(F.col("shard") < n % shards, 1).otherwise(0)
    place = numbered(rows, [], ["b", "fan"], ["group", "row_id"], "place")
    # At the start the rows lie in the order of their groups, dealt round: groups are apart, sizes even.
    labels = stored(place.select("row_id", "group", "b", "fan", F.pmod("place", F.lit(shards)).cast("int").alias("shard")), "shard-labels")
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("row_id").alias("b"), "shard"), "b").select("a", "shard", F.when(F.col("b") < F.col("a"), 1.0).otherwise(0.5).alias("votes"))
        own = degree.join(labels, "row_id").select(F.col("row_id").alias("a"), "shard", F.col("links") * 0.75)
        votes = votes.union(own).groupBy("a", "shard").agg(F.sum("votes").alias("votes"))
        best = votes.groupBy("a").agg(F.max(F.struct("votes", (-F.col("shard")).alias("less"))).alias("best"))
        best = best.select(F.col("a").alias("row_id"), F.col("best.votes").alias("votes"), (-F.col("best.less")).alias("goal"))
        wish = labels.join(best, "row_id", "left").withColumn("goal", F.coalesce("goal", "shard"))
        # Linked rows that already share the shard stay first, then those that come, then rows without a link.
        rank = F.when(F.col("votes").isNull(), 2).when(F.col("goal") == F.col("shard"), 0).otherwise(1)
        wish = stored(wish.select("row_id", "group", "b", "fan", F.col("goal").alias("shard"), rank.alias("rank")), "shard-wishes")
        wish = numbered(wish, ["shard"], ["rank", "b", "fan"], ["group", "row_id"], "place")
        kept = wish.where(F.col("place") < quota).select("row_id", "group", "b", "fan", "shard")
        over = wish.where(F.col("place") >= quota).select("row_id", "group", "b", "fan")
        taken = wish.groupBy("shard").agg(F.count("*").alias("wished"))
        every = rows.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
        room = every.join(F.broadcast(taken), "shard", "left").select("shard", F.greatest(quota - F.coalesce("wished", F.lit(0)), F.lit(0)).alias("room"))
        room = room.select("shard", (F.sum("room").over(Window.orderBy("shard")) - F.col("room")).alias("low"), F.sum("room").over(Window.orderBy("shard")).alias("high"))
        over = numbered(over, [], ["b", "fan"], ["group", "row_id"], "place")
        moved = over.join(F.broadcast(room), (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))).select("row_id", "group", "b", "fan", "shard")
        labels = stored(kept.union(moved), "shard-labels")
    return rows.join(labels.select("row_id", "shard"), "row_id")


def cut_links(placed: DataFrame, links: DataFrame) -> DataFrame:
    """links, cut: how many linked pairs there are, and how many of them lie in different shards."""
    ends = placed.select(F.col("row_id").alias("a"), F.col("shard").alias("at_a")), placed.select(F.col("row_id").alias("b"), F.col("shard").alias("at_b"))
    return links.join(ends[0], "a").join(ends[1], "b").agg(F.count("*").alias("links"), F.coalesce(F.sum((F.col("at_a") != F.col("at_b")).cast("long")), F.lit(0)).alias("cut"))


def shard_by_text(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (from 0 without gaps in each shard) for every row of df (doc_id, text)."""
    rows = stored(text_groups(df), "shard-groups")
    placed = propagate(rows, equal_text_links(rows), shards)
    return numbered(stored(placed, "shard-placed"), ["shard"], ["b", "fan"], ["group", "row_id"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_by_text(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "size", F.col("text_crc32").cast("long").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
