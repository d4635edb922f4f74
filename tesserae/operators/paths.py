"""Bounded walks over edges (G4, K8, F4, F5, J5): one join a level, visited entities left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import stored


def crossings(graph: DataFrame, direction: str) -> DataFrame:
    """here, there, predicate, incoming: every edge as it can be crossed."""
    out = graph.select(F.col("from_id").alias("here"), F.col("to_id").alias("there"), "predicate", F.lit(0).alias("incoming"))
    into = graph.select(F.col("to_id").alias("here"), F.col("from_id").alias("there"), "predicate", F.lit(1).alias("incoming"))
    return {"outgoing": out, "incoming": into, "both": out.union(into)}[direction]


def path_search(graph: DataFrame, start: str, direction: str = "outgoing", max_depth: int = 3, max_nodes: int = 0, predicates: list[str] | None = None) -> DataFrame:
    """visit, entity_id, depth, from_id, predicate, to_id, truncated: the entities that a breadth-first walk finds, in its order.

    Of an entity, neighbours come by id, then predicate, outgoing first; the first edge to reach an entity counts. The walk ends at
    max_depth or with max_nodes entities (0: 100), and is truncated only if an unseen entity found no room.
    """
    if direction not in ("outgoing", "incoming", "both") or not 1 <= max_depth <= 10 or not 0 <= max_nodes <= 500:
        raise ValueError("direction, max_depth (1 to 10) or max_nodes (0 to 500) is out of range")
    room = (max_nodes or 100) - 1
    graph = graph.where(F.col("predicate").isin(predicates)) if predicates else graph
    steps = crossings(graph, direction)  # repeats go when the first edge to each entity is taken, after the frontier has met the edges
    schema = "visit long, entity_id string, depth int, from_id string, predicate string, to_id string"
    found = graph.sparkSession.createDataFrame([(0, start, 0, None, None, None)], schema)
    frontier, truncated, seen = found, False, 1
    for depth in range(1, max_depth + 1):
        if frontier.isEmpty():
            break
        near = F.broadcast(frontier.select(F.col("visit").alias("parent"), F.col("entity_id").alias("here"))).join(steps, "here")
        near = near.join(F.broadcast(found.select(F.col("entity_id").alias("there"))), "there", "left_anti")
        first = near.groupBy("there").agg(F.min(F.struct("parent", "predicate", "incoming", "here")).alias("e"))
        # At most 500 entities are held, so the next level's order is taken over one short list.
        level = first.select("there", "e.*").orderBy("parent", "there").limit(room + 1)
        visit = F.row_number().over(Window.orderBy("parent", "there")) + seen - 1
        ends = [F.when((F.col("incoming") == 1) == flip, F.col("there")).otherwise(F.col("here")) for flip in (True, False)]
        level = stored(level.select(visit.cast("long").alias("visit"), F.col("there").alias("entity_id"), F.lit(depth).alias("depth"), ends[0].alias("from_id"), "predicate", ends[1].alias("to_id")), "walk")
        n = level.count()
        truncated |= n > room
        frontier = level.where(F.col("visit") < seen + min(n, room))
        found = found.union(frontier)
        seen, room = seen + min(n, room), room - min(n, room)
        if truncated:
            break
    return found.withColumn("truncated", F.lit(truncated))


def reachable(graph: DataFrame, starts: DataFrame, direction: str, max_depth: int = 10) -> DataFrame:
    """entity_id, depth: everything within max_depth of the starts (entity_id), without a bound on their number."""
    steps = stored(crossings(graph, direction).select("here", "there"), "steps")
    found = stored(starts.select("entity_id").distinct().withColumn("depth", F.lit(0)), "reached")
    for depth in range(1, max_depth + 1):
        last = found.where(F.col("depth") == depth - 1).select(F.col("entity_id").alias("here"))
        near = steps.join(last, "here").select(F.col("there").alias("entity_id")).distinct()
        near = stored(near.join(found.select("entity_id"), "entity_id", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if near.isEmpty():
            break
        found = found.union(near)
    return found


def impact(graph: DataFrame, seeds: DataFrame, max_nodes: int = 200) -> DataFrame:
    """entity_id, depth: what depends on the seeds (a closure over incoming edges), seeds left out, nearest first."""
    hit = reachable(graph, seeds, "incoming").where("depth > 0")
    return hit.orderBy("depth", "entity_id").limit(max_nodes)


def impact_counts(hit: DataFrame, triples: DataFrame, file_predicate: str) -> DataFrame:
    """nodes, files: how many entities (entity_id) depend on the seeds, and in how many distinct files they lie."""
    files = triples.where(F.col("predicate") == file_predicate).select(F.col("subject").alias("entity_id"), F.col("object_str").alias("file"))
    return hit.select("entity_id").distinct().join(files, "entity_id", "left").agg(F.countDistinct("entity_id").alias("nodes"), F.countDistinct("file").alias("files"))


def path_arrays(walk: DataFrame) -> DataFrame:
    """entity_id, path: the edges (as from>predicate>to) by which a walk of path_search came to each of its entities, in order. A walk has 500 entities at most."""
    edge = F.concat_ws(">", "from_id", "predicate", "to_id")
    steps = walk.select("entity_id", "depth", F.when(F.col("from_id") == F.col("entity_id"), F.col("to_id")).otherwise(F.col("from_id")).alias("parent"), edge.alias("edge"))
    out = steps.where("depth = 0").select("entity_id", F.array().cast("array<string>").alias("path"))
    level = out
    for depth in range(1, (walk.agg(F.max("depth")).first()[0] or 0) + 1):
        level = stored(steps.where(F.col("depth") == depth).join(level.withColumnRenamed("entity_id", "parent"), "parent").select("entity_id", F.concat("path", F.array("edge")).alias("path")), "path-arrays")
        out = out.union(level)
    return out


def paths(graph: DataFrame, start: str, max_hops: int = 4, max_paths: int = 10) -> DataFrame:
    """rank, path (ids joined by >), ending (leaf, depth or cycle): paths over outgoing edges in depth-first order of (predicate, target)."""
    steps = graph.select(F.col("from_id").alias("last"), "predicate", F.col("to_id").alias("next"))
    # The few open ends meet the edges where these lie; only what leaves the ends is made distinct.
    leaving = lambda ends: steps.join(F.broadcast(ends.select("last").distinct()), "last", "left_semi").distinct()
    spark = graph.sparkSession
    open_ = spark.createDataFrame([([start], [], start)], "ids array<string>, key array<string>, last string")
    done = []
    for hop in range(1, max_hops + 1):
        step = stored(open_.join(leaving(open_), "last", "left"), "steps")
        done.append(step.where("next is null and size(ids) > 1").select("ids", "key", F.lit("leaf").alias("ending")))
        step = step.where("next is not null")
        cycle = F.array_contains("ids", F.col("next"))
        step = step.select(F.concat("ids", F.array("next")).alias("ids"), F.concat("key", F.array(F.concat_ws("\u0001", "predicate", "next"))).alias("key"), F.col("next").alias("last"), cycle.alias("cycle"))
        # Depth-first order is the order of the keys, so later rows than max_paths can't come in.
        step = stored(step.orderBy("key").limit(max_paths), "paths")
        done.append(step.where("cycle").select("ids", "key", F.lit("cycle").alias("ending")))
        open_ = step.where("not cycle").select("ids", "key", "last")
    tail = open_.join(leaving(open_).select("last").distinct().withColumn("more", F.lit(True)), "last", "left")
    done.append(tail.select("ids", "key", F.when(F.col("more"), "depth").otherwise("leaf").alias("ending")))
    rows = done[0]
    for more in done[1:]:
        rows = rows.union(more)
    rows = rows.orderBy("key").limit(max_paths)
    return rows.select(F.row_number().over(Window.orderBy("key")).cast("long").alias("rank"), F.array_join("ids", ">").alias("path"), "ending")
