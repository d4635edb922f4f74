"""Operator 8: exact n-gram Jaccard join as a T-occurrence search, and the components of its links.

A text's set holds its distinct shingles of five words; with fewer words the whole sequence is the one shingle. Two texts
link when 100 * intersection >= 75 * union, so a text of n shingles links only with one that holds T = ceil(3 n / 4) of them or more.

1. Blocks of documents send each distinct shingle once to its bucket; a bucket learns which shingles only one text holds.
   A text with more than n - T such shingles can link with nothing else and is done. (Buckets compare 40 bits of a hash, which can only
   spare a text wrongly; everything after compares 64 bits.)
2. Texts that remain, one for each distinct set, get inverted lists (shingle -> texts). DivideSkip: a text's shingles are
   ordered by the length of their lists; only the shortest n - T + 1, of which a partner must share one, are merged (by Spark's
   shuffle); the long rest is never merged but probed by binary search in the candidate's sorted set.
3. In LEADERS rounds one text of each merged list is held against the others, and links join components. Lists whose texts are not all
   joined by then are merged whole, for pairs of blocks of texts that share a list, into counts of shared shingles; only texts that reach the
   required overlap leave a block. So no pair within a group is ever a row, and no group has to fit into one task.

A key with a large share of the rows, such as the shingle of a very common passage, the head of its list or the label of a large
component, is not dealt to one task: there are few such keys by their definition, and what they are joined with is broadcast.

Shingles are told apart by 64-bit hashes, which can move a count by one for one pair in some billions; equal sets by 128 bits. Null and empty texts
have an empty set and link with nothing. Very long texts are like others. A row with a null doc_id takes part in no link and has a null
component_id. Rows that share a doc_id are texts of their own with the same name; repeated rows are returned as often as they come. Other
columns are ignored. Without rows the result is empty.
"""

from __future__ import annotations

import pickle
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, documents, grams, hashed_words, mixed, pieces, removed, shuffles_freed, small_batches, stored, texts_of

WORDS, PERCENT, LEADERS, GROUP_BLOCK, HOT = 5, 75, 3, 512, 512
BLOCK_DOCS, BLOCK_SHINGLES, BUCKET_SHINGLES = 60_000, 1_000_000, 500_000


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text."""
    out = []
    for a, b in pieces(texts):
        h, offs = hashed_words(texts[a:b], NOT_SPACE)
        g = grams(h, words)
        for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            n = e - s
            out.append(np.unique(g[s : e - words + 1]) if n >= words else grams(h[s:e], n) if n else np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set; (0, 0) if it is empty."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        sums = [mixed(s ^ np.uint64(salt)).sum(dtype=np.uint64) + np.uint64(len(s)) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return tuple(mixed(np.array(sums, np.uint64)).view(np.int64).tolist())


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """The keys with over 1 / HOT of the rows, so HOT at most, as a stored table; None if there are none, or hardly a row."""
    n = rows.count()
    if n <= HOT:
        return None
    hot = stored(rows.groupBy(key).agg(F.count("*").alias("times_")).where(F.col("times_") * HOT > n).select(key), "hot")
    return None if hot.isEmpty() else hot


def spread(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", hot: DataFrame | None | bool = False) -> DataFrame:
    """rows joined with a table that holds a key once at most; the hot keys, looked for unless given, meet a broadcast. Without any this is a plain join."""
    hot = hot_keys(rows, key) if hot is False else hot
    if hot is None:
        return rows.join(table, key, how)
    few = F.broadcast(table.join(F.broadcast(hot), key, "left_semi"))
    return rows.join(F.broadcast(hot), key, "left_semi").join(few, key, how).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key, how))


def least_overlap(n: Column, percent: int) -> Column:
    """Shingles of a text of n that a partner shares at least."""
    return F.ceil(n * percent / 100).cast("int")


def sized(df: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, sig and sig2 (null if empty), n, alone: how many shingles of the text no other text holds, at most."""
    small_batches(df.sparkSession, 1024)
    spark = df.sparkSession
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 6 // (4 * BUCKET_SHINGLES))
    buckets = 4 * parts

    def blocks(batches):
        context, sets, ids = TaskContext.get(), [], []
        made = 0

        def flushed():
            nonlocal sets, ids, made
            block = context.partitionId() << 32 | made
            made += 1
            sig = [signature(s) for s in sets]
            n = np.array([len(s) for s in sets], np.int32)
            twin: dict[tuple[int, int], int] = {}  # one of equal sets speaks for all
            at = np.array([twin.setdefault(x, k) for k, x in enumerate(sig)], np.int32)
            own = np.unique(at)
            flat = np.concatenate([sets[k] for k in own])
            of = np.repeat(own, n[own])
            order = np.argsort(flat)
            flat, of = flat[order], of[order]
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(flat)))
            twice = np.repeat(times > 1, times)
            shared = np.bincount(of[twice], minlength=len(sets)).astype(np.int32)
            info = pickle.dumps((ids, sig, n, shared, at))
            keys, whose = flat[first], np.where(times > 1, 65535, of[first]).astype("<u2")
            bucket = (keys >> np.uint64(40)) % np.uint64(buckets)
            low = keys & np.uint64((1 << 40) - 1)
            order = np.argsort(bucket, kind="stable")
            bucket, low, whose = bucket[order], low[order], whose[order]
            edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            rows = [(int(k), low[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes() + whose[a:b].tobytes()) for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if b > a]
            rows.append((-1 - block % buckets, info))
            sets, ids = [], []
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "block", "payload"])

        size = 0
        for batch in batches:
            for i, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(texts_of(batch), words), strict=True):
                ids.append(i)
                sets.append(s)
                size += len(s)
                if size >= BLOCK_SHINGLES or len(sets) >= BLOCK_DOCS:
                    yield flushed()
                    size = 0
        if sets:
            yield flushed()

    def counted(batches):
        """Of each bucket: sends every block the places of its texts whose shingles other blocks hold too."""
        held = defaultdict(list)
        for batch in batches:
            for bucket, block, payload in zip(*(batch.column(k).to_pylist() for k in ("bucket", "block", "payload")), strict=True):
                if bucket < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([True]), pa.array([payload], pa.binary())], names=["block", "info", "payload"])
                else:
                    held[bucket].append((block, payload))
        for rows in held.values():
            low, whose, source = [], [], []
            for k, (_, payload) in enumerate(rows):
                m = len(payload) // 7
                wide = np.zeros((m, 8), np.uint8)
                wide[:, :5] = np.frombuffer(payload, np.uint8, 5 * m).reshape(-1, 5)
                low.append(wide.reshape(-1).view("<u8"))
                whose.append(np.frombuffer(payload, "<u2", m, 5 * m))
                source.append(np.full(m, k, np.int32))
            low, whose, source = np.concatenate(low), np.concatenate(whose), np.concatenate(source)
            order = np.argsort(low)
            same = low[order[1:]] == low[order[:-1]]
            known = np.zeros(len(low), bool)
            known[order[1:]] |= same
            known[order[:-1]] |= same
            known &= whose != 65535
            for k in np.unique(source[known]).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([rows[k][0]], pa.int64()), pa.array([False]), pa.array([whose[known & (source == k)].tobytes()], pa.binary())], names=["block", "info", "payload"])

    def joined(pdf):
        ids, sig, n, shared, at = pickle.loads(pdf.payload[pdf["info"]].iloc[0])
        more = np.frombuffer(b"".join(pdf.payload[~pdf["info"]]), "<u2")
        shared = shared + np.bincount(more, minlength=len(ids))
        sig = np.array(sig, np.int64).reshape(-1, 2)
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "sig": sig[:, 0], "sig2": sig[:, 1], "n": n, "alone": n - shared[at]})

    sent = df.select("doc_id", "text").mapInArrow(blocks, "bucket int, block long, payload binary")
    back = sent.repartition(parts, "bucket").mapInArrow(counted, "block long, info boolean, payload binary")
    return back.groupBy("block").applyInPandas(joined, "doc_id long, sig long, sig2 long, n int, alone int").withColumns({c: F.when(F.col("n") > 0, F.col(c)) for c in ("sig", "sig2")})


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that links (a, b) reach; nodes without a link are left out.

    Each round gives a node the smallest label among its own, its neighbours' and its label's label.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    hot = hot_keys(both, "b")
    while True:
        near = spread(both, labels.select(F.col("node").alias("b"), "label"), "b", hot=hot).groupBy("a").agg(F.min("label").alias("near"))
        step = stored(labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = stored(spread(step, jump, "label", "left").select("node", "old", F.least("label", "far").alias("label")), "labels")
        removed(labels)
        removed(step)
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            removed(both)
            return labels


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: every shingle of the shorter set is probed by binary search in the other's sorted set."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in ("a", "b")], names=["a", "b"])

    pairs = stored(pairs, "pairs")
    # Each text of a pair has its set, so the first join changes no count of the second one's keys.
    return spread(spread(pairs, left, "a"), right, "b", hot=hot_keys(pairs, "b")).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def linked_components(df: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) for every row of df (doc_id, text)."""
    df = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(sized(df, words, percent), "sized")
    classes = rows.where("sig is not null and doc_id is not null").groupBy("sig", "sig2").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.min("alone").alias("alone"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    open_ = classes.where(F.col("alone") <= F.col("n") - least_overlap(F.col("n"), percent))

    def members(batches):
        for batch in batches:
            found = [s for s in shingle_sets(texts_of(batch), words) if len(s)]
            sig = np.array([signature(s) for s in found], np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in found])]), pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(sig[:, 0]), pa.array(sig[:, 1]), pa.array([s.tobytes() for s in found], pa.binary()), lists], names=["sig", "sig2", "members", "shingles"])

    # A doc_id may name several texts, so the sets are joined by their signatures too.
    found = df.join(open_.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(members, "sig long, sig2 long, members binary, shingles array<long>")
    found = found.join(open_.select("sig", "sig2", "node", "n"), ["sig", "sig2"])
    found = stored(found.groupBy("node").agg(F.first("n").alias("n"), F.first("members").alias("members"), F.first("shingles").alias("shingles")), "members")
    sets = found.select("node", "members")

    lists = found.select("node", "n", F.explode("shingles").alias("shingle"))
    length = lists.groupBy("shingle").agg(F.count("*").alias("length")).where("length > 1")
    lists = spread(stored(lists, "lists"), length, "shingle")
    order = Window.partitionBy("node").orderBy("length", "shingle")
    lists = lists.select("shingle", "node", "n", F.row_number().over(order).alias("at"), F.count("*").over(Window.partitionBy("node")).alias("shared"))
    # Shingles that no other text holds are the rarest, so they come first among the n - T + 1.
    lists = lists.withColumn("at", F.col("at") + F.col("n") - F.col("shared"))
    short = stored(lists.where(F.col("at") <= F.col("n") - least_overlap(F.col("n"), percent) + 1), "short-lists")

    labels = stored(short.select("node").distinct().select("node", F.col("node").alias("label")), "labels")
    for k in range(LEADERS + 1):
        shuffles_freed(df.sparkSession)
        open_lists = several_labels(short, labels)
        if k < LEADERS:
            first = F.struct("n", "node") if k == 0 else F.struct(F.xxhash64("node", F.lit(k)), "node")
            heads = open_lists.groupBy("shingle").agg(F.min_by(F.struct("node", "n", "shared", "at", "label"), first).alias("x"))
            heads = heads.select("shingle", "x.*").toDF("shingle", *(f"{c}_x" for c in ("node", "n", "shared", "at", "label")))
            pairs = spread(open_lists, heads, "shingle").where(may_link(percent))
            links = verified(pairs.select(F.col("node_x").alias("a"), F.col("node").alias("b")).distinct(), sets, percent)
            ends = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
            links = links.join(ends[0], "a").join(ends[1], "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        else:
            links = merged_in_blocks(open_lists, sets, percent)
        links = stored(links.distinct(), "links")
        if links.isEmpty():
            continue
        joined = components(links).select(F.col("node").alias("label"), F.col("label").alias("to"))
        labels = stored(labels.join(joined, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")

    grouped = classes.join(labels, "node")
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    grouped = grouped.join(least, "label").select("node", "component_id")
    named = classes.select("sig", "sig2", "node", "least").join(grouped, "node", "left").select("sig", "sig2", F.coalesce("component_id", "least").alias("component_id"))
    alone = F.when(F.col("sig").isNull(), F.col("doc_id"))
    return rows.join(named, ["sig", "sig2"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", alone)).alias("component_id")
    )


def several_labels(short: DataFrame, labels: DataFrame) -> DataFrame:
    """shingle, node, n, at, shared, label: the short lists whose texts are not all joined yet."""
    named = short.join(labels, "node").select("shingle", "node", "n", "at", "shared", "label")
    open_ = named.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("shingle")
    return stored(spread(stored(named, "named-lists"), open_, "shingle"), "open-lists")


def merged_in_blocks(open_lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: labels of texts that link, of all pairs that share an open list.

    Texts that open lists connect form groups. A group is cut into blocks of GROUP_BLOCK texts; a task takes two blocks, merges the lists
    of all shingles that both hold into a table of counts, and returns the labels of the pairs that reach the required overlap.
    """
    heads = open_lists.groupBy("shingle").agg(F.min("node").alias("a"))
    edges = open_lists.join(heads, "shingle").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    nodes = components(edges).select("node", F.col("label").alias("group"))
    parts = nodes.groupBy("group").agg(F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias("parts"))
    named = open_lists.select("node", "label").distinct()
    rows = nodes.join(parts, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(named, "node").join(sets, "node")
    rows = stored(rows.select("group", "block", "node", "label", "members"), "groups")
    keys = ["group", "i", "j"]
    # Which blocks a list has texts in; blocks that share no list have no pair to look at.
    places = rows.select("group", "block", "node").join(open_lists.select("shingle", "node"), "node").select("shingle", "group", "block").distinct()
    both = places.withColumnRenamed("block", "i").join(places.withColumnRenamed("block", "j"), ["shingle", "group"]).where("i <= j").select(*keys).distinct()
    both = stored(both, "block-pairs")
    left = rows.join(both.withColumnRenamed("i", "block"), ["group", "block"]).select("group", F.col("block").alias("i"), "j", "label", "members")
    right = rows.join(both.where("i < j").withColumnRenamed("j", "block"), ["group", "block"]).select(*(F.col(x).alias(y) for x, y in (("group", "group"), ("i", "i"), ("block", "j"), ("label", "label"), ("members", "members"))))

    def counted(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y if len(y) else x
        if not len(x) or x.i.iloc[0] != x.j.iloc[0] and y is x:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        xs, ys = ([np.frombuffer(m, np.uint64) for m in side.members] for side in (x, y))
        nx, ny = (np.array([len(m) for m in side]) for side in (xs, ys))
        common = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
        both = np.zeros((len(xs), len(ys)), np.float32)
        where = [[np.searchsorted(common, m[np.isin(m, common, assume_unique=True)]) for m in side] for side in (xs, ys)]
        for start in range(0, len(common), 4096):
            tables = []
            for side in where:
                table = np.zeros((len(side), 4096), np.float32)
                for r, at in enumerate(side):
                    table[r, at[np.searchsorted(at, start) : np.searchsorted(at, start + 4096)] - start] = 1
                tables.append(table)
            both += tables[0] @ tables[1].T
        la, lb = x.label.to_numpy(), y.label.to_numpy()
        r, c = np.nonzero((100 * both >= percent * (nx[:, None] + ny[None, :] - both)) & (la[:, None] != lb[None, :]))
        pairs = np.unique(np.sort(np.column_stack([la[r], lb[c]]), axis=1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(counted, "a long, b long")


def may_link(percent: int) -> Column:
    """Whether two texts of a list, one with columns named _x, can still share enough shingles and are not joined yet.

    They share no more than either shares with anyone, and, up from the places of a common shingle in the two orders, no more than the
    smaller number before and the smaller number after.
    """
    n, m, i, j = F.col("n"), F.col("n_x"), F.col("at"), F.col("at_x")
    most = F.least("shared", "shared_x", F.least(i, j) + F.least(n - i, m - j))
    return (F.col("label") != F.col("label_x")) & (most * (100 + percent) >= (n + m) * percent)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(documents(spark, sf_dir))
