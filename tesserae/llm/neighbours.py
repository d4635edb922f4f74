"""Operator 4: approximate nearest neighbours by cross-polytope hashing.

The nearest are those of the largest inner product. Equal vectors are one node, with the k + 1 smallest of their ids, as no other id of
theirs can be an answer; so a vector that is repeated however often costs nothing.

Index. Each of TABLES tables turns a node's direction by pseudo-random rotations (three rounds of random signs and a fast Hadamard
transform) and takes the nearest signed axis of two or more of them side by side as its bucket. The number of axes grows with the table, so that a
bucket holds about LOAD nodes at every size. Only ids are stored in the index.

Norms are told apart by bands, BANDS to each doubling. Bands of up to BLOCK nodes, such as outliers and the largest norms, are not
hashed: every query visits all their nodes. So one large norm changes nothing for the rest.

Search. A query probes, in each table, the buckets whose axes lie nearest to it, in the order of what their coordinates lack to the nearest
ones. A node found in VOTES tables is a candidate; pairs of query and candidate are made distinct before a vector is read,
and all candidates are ranked exactly, by the inner product of the original vectors in double precision, ties by the smaller id.

Recall is measured on each input: TRIED queries (a bounded sample, by a hash of the id) are answered exactly, and the least number of probes
is taken that finds AIM of their true neighbours. If MOST_PROBES don't, fewer votes are asked for, and if that doesn't do, all queries are
answered by an exact pass in blocks. So is any query that finds fewer than k.

Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows with a null id or a vector of another length
than most. Rows that share an id are all candidates (a query never finds its own id, and an id is returned once, with its best score);
as queries they count once, with the smallest vector. Very long vectors are like others. Other columns are ignored. Without rows the result is empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import removed, stored

TABLES, LOAD, VOTES, BLOCK, BANDS, SEED = 48, 3, 3, 4096, 2, 11
TRIED, AIM, MOST_PROBES = 64, 0.93, 4096


def hadamard(x: np.ndarray) -> None:
    """Fast Walsh-Hadamard transform of each row, in place; the width is a power of two."""
    h = 1
    while h < x.shape[1]:
        y = x.reshape(len(x), -1, 2, h)
        a, b = y[:, :, 0], y[:, :, 1]
        total = a + b
        np.subtract(a, b, out=b)
        a[...] = total
        h *= 2
    x /= np.sqrt(x.shape[1], dtype=x.dtype)


def rotated(x: np.ndarray, table: int, turn: int, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng([seed, table, turn])
    x = x.copy()
    for _ in range(3):
        x *= rng.choice(np.array([-1, 1], x.dtype), x.shape[1])
        hadamard(x)
    return x


def directions(x: np.ndarray) -> np.ndarray:
    """Unit vectors, with zeros up to a width of a power of two; scaled first, so that no square overflows."""
    out = np.zeros((len(x), 1 << int(np.ceil(np.log2(max(x.shape[1], 2))))), np.float32)
    x = x / np.abs(x).max(1, keepdims=True)
    out[:, : x.shape[1]] = x / np.sqrt((x * x).sum(1, keepdims=True))
    return out


def widths(nodes: int, width: int) -> list[int]:
    """How many axes each polytope of a table has: all, but the last fewer, so that buckets hold about LOAD nodes; two or more."""
    bits, whole = max(int(np.round(np.log2(max(nodes, 1) / LOAD))), 2), int(np.log2(2 * width))
    out = [width] * (bits // whole) + ([1 << bits % whole - 1] if bits % whole else [])
    return out if len(out) > 1 else [1 << bits - 2, 1]


def sided(x: np.ndarray, table: int, axes: list[int]) -> list[np.ndarray]:
    """Coordinates along the signed axes of each polytope of a table."""
    turned = [rotated(x, table, k)[:, :n] for k, n in enumerate(axes)]
    return [np.concatenate([y, -y], 1) for y in turned]


def buckets(x: np.ndarray, table: int, axes: list[int]) -> np.ndarray:
    code = np.zeros(len(x), np.int64)
    for y in sided(x, table, axes):
        code = code * y.shape[1] + y.argmax(1)
    return code * TABLES + table


def probed_buckets(x: np.ndarray, table: int, axes: list[int], probes: int) -> np.ndarray:
    """The buckets nearest to each row, by the sum over polytopes of what their coordinates lack to the largest; nearest first."""
    code, lack = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.float32)
    for y in sided(x, table, axes):
        order = np.argsort(-y, axis=1, kind="stable")[:, : min(probes, y.shape[1])]
        own = np.take_along_axis(y, order, 1)
        # Both lists are in order, so the pair of places i and j can be among the nearest only if no more than that many pairs are before it.
        i, j = np.nonzero(np.outer(np.arange(1, lack.shape[1] + 1), np.arange(1, own.shape[1] + 1)) <= probes)
        both, codes = lack[:, i] + (own[:, :1] - own)[:, j], code[:, i] * y.shape[1] + order[:, j]
        n = min(probes, both.shape[1])
        best = np.argpartition(both, n - 1, axis=1)[:, :n]
        code, lack = np.take_along_axis(codes, best, 1), np.take_along_axis(both, best, 1)
        order = np.argsort(lack, axis=1, kind="stable")
        code, lack = np.take_along_axis(code, order, 1), np.take_along_axis(lack, order, 1)
    return code * TABLES + table


def usable(df: DataFrame) -> DataFrame:
    """vec_id, vector (doubles): the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where(fine)
    sizes = rows.groupBy(F.size("vector").alias("width")).count()
    usual = sizes.agg(F.max_by("width", F.struct("count", "width")).alias("usual"))
    return rows.join(F.broadcast(usual), F.size("vector") == F.col("usual")).drop("usual")


def nodes_of(rows: DataFrame, k: int) -> DataFrame:
    """node, vector, ids (the k + 1 smallest, sorted), band: the distinct vectors of rows (vec_id, vector)."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    kept = rows.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    nodes = kept.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    most = F.array_max(F.transform("vector", F.abs))
    norm = F.log2(most) + F.log2(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x / most * (x / most))) / 2
    # The quarter keeps equal norms that are powers of two, and differ by rounding, off the edge of a band.
    return nodes.select(F.monotonically_increasing_id().alias("node"), "vector", "ids", F.floor(norm * BANDS + 0.25).alias("band"))


def ranked(k: int):
    """For cogroups: the k best ids of each query among nodes (node, vector, ids); a query names its candidates or, with none, means all."""

    def run(nodes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [np.zeros(0, np.int64)], "vec_id": [np.zeros(0, np.int64)], "score": [np.zeros(0)]}
        if len(nodes) and len(queries):
            nodes = nodes.sort_values("node")
            x, names, ids = np.stack(nodes.vector.to_list()), nodes.node.to_numpy(), nodes.ids.to_list()
            for query, q, some in zip(queries.query_id, queries.vector, queries.some, strict=True):
                at = np.arange(len(x)) if some is None else np.searchsorted(names, np.sort(some))
                score = (x[at] * q).sum(1)  # row by row in one order, so that equal vectors have equal scores wherever they stand
                if len(at) > k + 1:
                    best = score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                    at, score = at[best], score[best]
                own = [ids[a] for a in at.tolist()]
                vec, score = np.concatenate(own), np.repeat(score, [len(i) for i in own])
                score, vec = score[vec != query], vec[vec != query]
                order = np.lexsort((vec, -score))[: 2 * k]
                for name, value in (("query_id", np.full(len(order), query)), ("vec_id", vec[order]), ("score", score[order])):
                    out[name].append(value)
        return pd.DataFrame({name: np.concatenate(values) for name, values in out.items()})

    return run


def answered(nodes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: nodes and asked (query_id, vector, some) are dealt by part, of BLOCK nodes at most or about so."""
    found = nodes.groupBy("part").cogroup(asked.groupBy("part")).applyInPandas(ranked(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def in_parts(nodes: DataFrame, parts: int) -> DataFrame:
    return nodes.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int"))


def everywhere(queries: DataFrame, parts: int) -> DataFrame:
    """Queries that visit all parts and all nodes in them."""
    return queries.select("query_id", "vector", F.lit(None).cast("array<bigint>").alias("some"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))


def exact(nodes: DataFrame, n: int, queries: DataFrame, k: int) -> DataFrame:
    """The answers to queries (query_id, vector) by an exact pass over all n nodes, in blocks."""
    parts = n // BLOCK + 1
    return answered(in_parts(nodes, parts), everywhere(queries, parts), k)


def places_in_probes(q: np.ndarray, x: np.ndarray, axes: list[int]) -> np.ndarray:
    """By table, query and node: how many buckets a query probes before the node's own; MOST_PROBES if it doesn't come to it."""
    out = np.full((TABLES, len(q), len(x)), MOST_PROBES, np.int16)
    for t in range(TABLES):
        codes, own = probed_buckets(q, t, axes, MOST_PROBES), buckets(x, t, axes)
        for r, code in enumerate(codes):
            order = np.argsort(code)
            at = order[np.minimum(np.searchsorted(code, own, sorter=order), len(order) - 1)]
            out[t, r] = np.where(code[at] == own, at, MOST_PROBES)
    return out


def probes_needed(nodes: DataFrame, n: int, hashed: DataFrame, queries: DataFrame, axes: list[int], k: int) -> tuple[int, int] | None:
    """Probes and votes that find AIM of the true neighbours of TRIED queries, as far as these are hashed; None if none do."""
    tried = stored(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(TRIED), "tried")
    true = exact(nodes, n, tried, k).join(F.broadcast(tried), "query_id").select("query_id", "vec_id", F.col("vector").alias("q"))
    near = hashed.select("vector", F.explode("ids").alias("vec_id")).join(F.broadcast(true), "vec_id")
    score = F.aggregate(F.zip_with("vector", "q", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    near = near.groupBy("query_id", "vec_id").agg(F.max_by("vector", score).alias("near"))  # an id that many rows share counts once, where it is nearest
    pairs, asked = near.toPandas(), tried.toPandas()  # TRIED queries and k for each, however large the table is
    removed(tried)
    if not len(pairs):
        return 1, VOTES
    of = {x: r for r, x in enumerate(asked.query_id)}
    q, x = (directions(np.stack(v.to_list())) for v in (asked.vector, pairs.near))
    place = places_in_probes(q, x, axes)[:, pairs.query_id.map(of).to_numpy(np.int64), np.arange(len(pairs))]
    place.sort(axis=0)
    for votes in range(VOTES, 0, -1):
        for e in range(4 * MOST_PROBES.bit_length() - 3):
            if (place[votes - 1] < int(2 ** (e / 4))).mean() >= AIM:
                return int(2 ** (e / 4)), votes
    return None


def nearest(df: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row of df (vec_id, embedding) that is_query holds for."""
    rows = stored(usable(df), "vectors")
    queries = stored(rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector")), "queries")
    nodes = stored(nodes_of(rows, k), "nodes")
    removed(rows)
    sizes = {r["band"]: r["count"] for r in nodes.groupBy("band").count().collect()}  # two a doubling, so some 4,000 at most
    n, bands = sum(sizes.values()), [band for band, size in sizes.items() if size > BLOCK]
    if not bands:
        return exact(nodes, n, queries, k)
    hashed, few = nodes.where(F.col("band").isin(bands)), nodes.where(~F.col("band").isin(bands))
    n_hashed = sum(sizes[band] for band in bands)
    width = 1 << int(np.ceil(np.log2(max(len(hashed.first().vector), 2))))
    axes = widths(n_hashed, width)
    setting = probes_needed(nodes, n, hashed, queries, axes, k)
    if setting is None:
        return exact(nodes, n, queries, k)
    probes, votes = setting

    def placed(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 4096):
                some = pdf[a : a + 4096]
                x, node = directions(np.stack(some.vector.to_list())), some.node.to_numpy()
                for t in range(TABLES):
                    yield pd.DataFrame({"place": buckets(x, t, axes), "node": node})

    def probed(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                some = pdf[a : a + 256]
                x = directions(np.stack(some.vector.to_list()))
                for t in range(TABLES):
                    places = probed_buckets(x, t, axes, probes)
                    yield pd.DataFrame({"place": places.reshape(-1), "query_id": np.repeat(some.query_id.to_numpy(), places.shape[1])})

    index = hashed.select("node", "vector").mapInPandas(placed, "place long, node long")
    spread = queries.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id")
    asked = spread.mapInPandas(probed, "place long, query_id long")
    # Both sides hold many rows for each row they are made of, which Spark's sizes don't know; and files of equal vectors are small. So neither join may broadcast.
    pairs = index.join(asked.hint("merge"), "place").groupBy("query_id", "node").agg(F.count("*").alias("votes")).where(F.col("votes") >= votes)
    # Parts of hashed nodes come first, then those of the small bands, where every query goes.
    parts, more = n_hashed // BLOCK + 1, (n - n_hashed) // BLOCK + 1
    named = in_parts(pairs, parts).groupBy("query_id", "part").agg(F.collect_list("node").alias("some"))
    named = named.join(queries.hint("merge"), "query_id").select("query_id", "vector", "some", "part")
    visits = named.unionByName(everywhere(queries, more).withColumn("part", F.col("part") + parts))
    dealt = in_parts(hashed, parts).unionByName(in_parts(few, more).withColumn("part", F.col("part") + parts))
    found = stored(answered(dealt, visits, k), "found")
    enough = found.where(F.col("rank") == min(k, n - 1)).select("query_id")
    short = stored(queries.join(enough, "query_id", "left_anti"), "short")
    if short.isEmpty():
        return found
    return found.join(enough, "query_id", "left_semi").unionByName(exact(nodes, n, short, k))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
