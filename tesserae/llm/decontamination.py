"""Operator 1: benchmark decontamination by a prefix-filtered set join.

Words are maximal runs of letters, digits and non-ASCII characters after lower-casing A-Z. A window is any 13 consecutive words of a
benchmark item; an item of fewer words is one window. A document word inside any occurrence of a window is hit.

A window's set holds its shingles of up to five words. Exact containment needs all of them, so the prefix that must be joined is one
shingle: the rarest, by the number of documents that hold it. Documents are joined on these shingles; the shingle's offset fixes where
the window would begin, which must leave room for it inside the document (positional and length bound), and the words there are
compared one by one. Windows with a shingle that no document holds are left out at once.

The benchmark is the query set: it is taken in blocks of bounded size, each broadcast, however large it is.

Null and empty texts have no words and no hits; items with a null id or without words take no part; items that share an id
count once. Repeated documents are each judged. Other columns pass through, unless they bear the name of a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import UPPER, WORD, documents, grams, hashed_words, pieces, small_batches, texts_of

WINDOW, SHINGLE = 13, 5
BLOCK_BYTES = 4 << 20
ADDED = [StructField("n_words", LongType()), StructField("spans", ArrayType(IntegerType())), StructField("items", ArrayType(StringType()))]


class Windows:
    """The windows of one block of items, without repeats."""

    def __init__(self, items: list[tuple[str, str | None]]) -> None:
        h, offs = hashed_words([(t or "").encode() for _, t in items], WORD)
        at, size, item = [], [], []
        for k, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            if b > a:
                starts = range(a, b - WINDOW + 1) if b - a >= WINDOW else [a]
                at.extend(starts)
                size.extend([min(WINDOW, b - a)] * len(starts))
                item.extend([k] * len(starts))
        at, size, item = np.array(at, np.int64), np.array(size, np.int64), np.array(item, np.int64)
        place = np.arange(WINDOW)
        words = np.where(place < size[:, None], h[np.minimum(at[:, None] + place, max(len(h) - 1, 0))], np.uint64(0)) if len(at) else np.zeros((0, WINDOW), np.uint64)
        self.words, of = np.unique(np.column_stack([words, size.astype(np.uint64)]), axis=0, return_inverse=True)
        of = of.reshape(-1)
        self.size = self.words[:, WINDOW].astype(np.int64)
        pairs = np.unique(np.column_stack([of, item]), axis=0)
        self.first_item = np.searchsorted(pairs[:, 0], np.arange(len(self.size) + 1))
        self.item = pairs[:, 1]
        self.names = [i for i, _ in items]
        # All shingles: of which window, at which offset.
        shingle, window, offset = [], [], []
        for n in np.unique(self.size).tolist():
            own, k = np.flatnonzero(self.size == n), min(SHINGLE, n)
            for o in range(n - k + 1):
                block = self.words[own, o : o + k]
                g = grams(np.ascontiguousarray(block).reshape(-1), k)[::k] if len(own) else np.zeros(0, np.uint64)
                shingle.append(g)
                window.append(own)
                offset.append(np.full(len(own), o))
        empty = [np.zeros(0, np.int64)]
        self.shingle, self.window, self.offset = np.concatenate(shingle or [np.zeros(0, np.uint64)]), np.concatenate(window or empty), np.concatenate(offset or empty)
        self.lengths = sorted({min(SHINGLE, n) for n in self.size.tolist()})

    def shingles(self) -> "Lookup":
        return Lookup(np.unique(self.shingle), self.lengths)

    def with_prefixes(self, held: dict[int, int]) -> None:
        """Keeps of each window its rarest shingle; held: the number of documents by shingle."""
        rarity = np.array([held.get(x, 0) for x in self.shingle.view(np.int64).tolist()], np.int64)
        order = np.lexsort((self.offset, self.shingle, rarity, self.window))
        order = order[np.concatenate([[True], self.window[order][1:] != self.window[order][:-1]])] if len(order) else order
        order = order[rarity[order] > 0]
        order = order[np.argsort(self.shingle[order], kind="stable")]
        prefix = self.shingle[order]
        self.window, self.offset = self.window[order], self.offset[order]
        self.prefix = Lookup(np.unique(prefix), self.lengths)
        self.first = np.append(np.searchsorted(prefix, self.prefix.keys), len(prefix))
        self.shingle = None


class Lookup:
    """Finds which runs of words are among the given shingles."""

    def __init__(self, keys: np.ndarray, lengths: list[int]) -> None:
        self.keys, self.lengths = keys, lengths
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def found(self, h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words and the place in keys of the shingle that begins there."""
        at, key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not len(self.keys):
            return at[0], key[0]
        for k in self.lengths:
            g = grams(h, k)
            p = np.flatnonzero(self.maybe[(g & np.uint64((1 << 22) - 1)).astype(np.int64)])
            end = offs[np.searchsorted(offs, p, side="right")]
            p = p[p + k <= end]
            place = np.minimum(np.searchsorted(self.keys, g[p]), len(self.keys) - 1)
            same = self.keys[place] == g[p]
            at.append(p[same])
            key.append(place[same])
        return np.concatenate(at), np.concatenate(key)


def counted(df: DataFrame, lookup: Lookup) -> dict[int, int]:
    """The number of documents that hold each of the block's shingles."""
    known = df.sparkSession.sparkContext.broadcast(lookup)

    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            total = np.zeros(len(known.value.keys), np.int64)
            for a, b in pieces(texts):
                h, offs = hashed_words(texts[a:b], WORD)
                at, key = known.value.found(h, offs)
                doc = np.searchsorted(offs, at, side="right")
                pairs = np.unique(doc * np.int64(len(total)) + key) if len(at) else at
                total += np.bincount(pairs % max(len(total), 1), minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(known.value.keys[some].view(np.int64)), pa.array(total[some])], names=["shingle", "n"])

    sums = df.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {r.shingle: r.n for r in sums.toLocalIterator()}


def marked(df: DataFrame, windows: Windows) -> DataFrame:
    """Adds the block's hits to the columns of ADDED."""
    known = df.sparkSession.sparkContext.broadcast(windows)
    names = [c for c in df.columns if c not in {f.name for f in ADDED}]

    def hits(texts):
        w = known.value
        h, offs = hashed_words(texts, WORD)
        at, key = w.prefix.found(h, offs)
        n = w.first[key + 1] - w.first[key]
        entry = np.repeat(w.first[key] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else at
        at = np.repeat(at, n)
        window, start = w.window[entry], at - w.offset[entry]
        doc = np.searchsorted(offs, at, side="right") - 1
        fits = (start >= offs[doc]) & (start + w.size[window] <= offs[doc + 1])
        window, start, doc = window[fits], start[fits], doc[fits]
        for k in range(WINDOW):
            same = (k >= w.size[window]) | (h[np.minimum(start + k, len(h) - 1)] == w.words[window, k])
            window, start, doc = window[same], start[same], doc[same]
        return h, offs, window, start, doc

    def run(batches):
        w = known.value
        for batch in batches:
            texts = texts_of(batch)
            before, named = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            n_words, spans, items = [], [], []
            for a, b in pieces(texts):
                _, offs, window, start, doc = hits(texts[a:b])
                n_words += np.diff(offs).tolist()
                own = {}
                order = np.lexsort((start, doc))
                edges = np.searchsorted(doc[order], np.arange(b - a + 1))
                for d in np.unique(doc).tolist():
                    o = order[edges[d] : edges[d + 1]]
                    own[d] = (np.column_stack([start[o] - offs[d], start[o] - offs[d] + w.size[window[o]]]), {w.names[i] for x in np.unique(window[o]).tolist() for i in w.item[w.first_item[x] : w.first_item[x + 1]].tolist()})
                for d in range(b - a):
                    pair = own.get(d)
                    old = before[a + d] or []
                    spans.append(merged(old, pair[0]) if pair else old)
                    items.append(sorted({*(named[a + d] or []), *(pair[1] if pair else ())}))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=[*names, "n_words", "spans", "items"])

    return df.mapInArrow(run, StructType([*(df.schema[c] for c in names), *ADDED]))


def merged(flat: list[int], more: np.ndarray) -> list[int]:
    """Union of spans: flat has begins and ends in turn."""
    both = np.concatenate([np.array(flat, np.int64).reshape(-1, 2), more])
    both = both[np.argsort(both[:, 0], kind="stable")]
    reach = np.maximum.accumulate(both[:, 1])
    new = np.concatenate([[True], both[1:, 0] > reach[:-1]])
    return np.column_stack([both[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(both) - 1)]]).reshape(-1).tolist()


def decontaminate(df: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """Adds n_words, spans (word positions hit: begins and ends in turn), items (sorted ids), n_hit, n_items, contaminated."""
    small_batches(df.sparkSession)
    names = [c for c in df.columns if c not in ("n_words", "spans", "items", "n_hit", "n_items", "contaminated")]
    source = df.select(*names)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    out = source.withColumns({f.name: F.lit(None).cast(f.dataType) for f in ADDED})
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        windows = Windows([(r.item_id, r.text) for r in own.toLocalIterator()])
        windows.with_prefixes(counted(source, windows.shingles()))
        out = marked(out, windows)
    signed = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    out = out.withColumn("n_hit", F.aggregate(signed, F.lit(0), lambda a, b: a + b).cast("long"))
    return out.withColumns({"n_items": F.size("items").cast("long"), "contaminated": (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))})


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[s + 1 : s + n], ' ') AS t
        FROM (SELECT item_id, ws, least(len(ws), {WINDOW}) AS n, unnest(range(0, greatest(len(ws) - {WINDOW}, 0) + 1)) AS s FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (SELECT doc_id, n, s, array_to_string(ws[s + 1 : s + n], ' ') AS t
         FROM (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS s FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT doc_id, s, runs.n, item_id FROM runs JOIN win ON runs.t = win.t AND runs.n = win.n),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
