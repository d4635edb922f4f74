"""Operator 7: toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are the hashed windows of 4 to 6 bytes inside words that a text holds (once each). A first Spark job counts over all labelled
rows in how many toxic and other texts each bucket occurs. The log of the ratio of the two smoothed rates scales the feature, shrunk
towards 0 the less sure the difference of the rates is (half at SURE standard errors); no bucket is left out. A logistic regression on the scaled
features with an L2 penalty is fitted by gradient steps on a bounded sample of whole texts (SAMPLE rows of each label at most, weighted back to
the labels' true share), drawn by a hash of doc_id and text, so that copies are drawn one by one. Scoring reads whole texts.

Null and empty texts hold no feature and get the score of the bias alone; a very long text holds each bucket once, as any other. Rows without
a label, and with a null doc_id, teach nothing but are scored; a doc_id labelled more than once counts as toxic if any label says so. Without labels
of both kinds all scores are 0. Repeated rows are each scored; ties don't arise. Other columns pass through, unless they bear the name of a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import crc_of, documents, pieces, removed, shuffles_freed, small_batches, stored, texts_of
from .subwords import letter_buffer, windows

SIZES, BITS, SAMPLE = (4, 5, 6), 20, 4_000
SMOOTHING, SURE, EPOCHS, BATCH, RATE, PENALTY, LIMIT = 1.0, 10.0, 12, 64, 0.2, 1e-4, 0.3


_mark = np.zeros(1 << BITS, np.int32)


def held(texts: list[bytes]) -> list[np.ndarray]:
    """The buckets that each text holds, once each. Of equal ones that is kept whose place the table of marks holds last, so nothing is sorted."""
    buf, begins = letter_buffer(texts)
    found = [(bucket, np.searchsorted(at, begins).tolist()) for at, bucket in windows(buf, SIZES, BITS)]
    for _, edges in found:
        edges[0] = 0
    out = []
    for k in range(len(texts)):
        own = np.concatenate([bucket[edges[k] : edges[k + 1]] for bucket, edges in found]) if found else np.zeros(0, np.int64)
        place = np.arange(len(own), dtype=np.int32)
        _mark[own] = place
        out.append(own[_mark[own] == place])
    return out


class Model:
    def __init__(self, scale: np.ndarray) -> None:
        self.scale, self.weight, self.bias = scale.astype(np.float32), np.zeros(len(scale), np.float32), 0.0

    def fit(self, bucket: np.ndarray, at: np.ndarray, y: np.ndarray, importance: np.ndarray, seed: int = 3) -> None:
        """bucket: of all texts, one after the other; those of text k from at[k] to at[k + 1]. Adagrad over small batches; the last half's weights are averaged."""
        rng, w, seen = np.random.default_rng(seed), np.zeros(len(self.scale), np.float32), np.full(len(self.scale), 1e-6, np.float32)
        b, b_seen = float(np.log((importance * y).sum() / (importance * (1 - y)).sum())), 1e-6
        mean, b_mean, taken, unit = np.zeros(len(w)), 0.0, 0, importance / importance.mean()
        for epoch in range(EPOCHS):
            order = rng.permutation(len(y))
            for k in range(0, len(order), BATCH):
                rows = order[k : k + BATCH]
                size = at[rows + 1] - at[rows]
                first = np.cumsum(size) - size
                own = bucket[np.repeat(at[rows] - first, size) + np.arange(size.sum())]
                of = np.repeat(np.arange(len(rows)), size)
                z = np.bincount(of, w[own] * self.scale[own], len(rows)) + b
                error = unit[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
                used, place = np.unique(own, return_inverse=True)
                g = np.bincount(place, error[of], len(used)).astype(np.float32) * self.scale[used] + PENALTY * w[used]
                seen[used] += g * g
                w[used] -= RATE * g / np.sqrt(seen[used])
                b_seen += error.sum() ** 2
                b -= RATE * error.sum() / np.sqrt(b_seen)
            if 2 * epoch >= EPOCHS:
                mean, b_mean, taken = mean + w, b_mean + b, taken + 1
        self.weight = (mean / taken).astype(np.float32) * self.scale
        self.bias = b_mean / taken

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = np.array([self.weight[own].sum(dtype=np.float64) for own in held(texts)]) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def learned(df: DataFrame, labels: DataFrame, teaches: Column, sample: int = SAMPLE) -> Model | None:
    """A model from the rows of df (doc_id, text) that may teach and have a label (doc_id, toxic)."""
    small_batches(df.sparkSession)
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = stored(df.where(teaches).select("doc_id", "text").join(marks.hint("merge"), "doc_id").select(F.xxhash64("doc_id", "text").alias("draw"), "text", "toxic"), "labelled")

    def count(batches):
        total = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            texts, toxic = texts_of(batch), np.array(batch.column("toxic").to_pylist())
            for a, b in pieces(texts):
                for own, t in zip(held(texts[a:b]), toxic[a:b].tolist(), strict=True):
                    total[0 if t == 1 else 1][own] += 1
        some = np.flatnonzero(total.any(0))
        for k in range(0, len(some), 1 << 16):
            cut = some[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(cut), *(pa.array(total[side, cut].astype(np.int64)) for side in (0, 1))], names=["bucket", "toxic", "other"])

    size = {r["toxic"]: r["count"] for r in rows.groupBy((F.col("toxic") == 1).alias("toxic")).count().collect()}
    n1, n0 = size.get(True, 0), size.get(False, 0)
    if not n1 or not n0:
        return None
    counts = rows.mapInArrow(count, "bucket long, toxic long, other long").groupBy("bucket").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    counts = counts.select(F.col("bucket").cast("int").alias("bucket"), rate_ratio(F.col("a"), F.col("b"), n1, n0).cast("float").alias("ratio")).toPandas()
    scale = np.zeros(1 << BITS, np.float32)
    scale[counts["bucket"].to_numpy()] = counts["ratio"].to_numpy()
    del counts
    model = Model(scale)

    def listed(batches):
        for batch in batches:
            texts = texts_of(batch)
            for a, b in pieces(texts):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("draw", "toxic")), pa.array([own.astype("<u4").tobytes() for own in held(texts[a:b])], pa.binary())], names=["draw", "toxic", "buckets"])

    drawn = []
    for toxic, n in ((1, n1), (0, n0)):
        some = rows.where((F.col("toxic") == 1) == F.lit(toxic == 1)).select("draw", F.lit(toxic).alias("toxic"), "text").where(F.pmod("draw", F.lit(1 << 30)) < min(1.0, sample / n) * (1 << 30))
        drawn.append(some.mapInArrow(listed, "draw long, toxic int, buckets binary").orderBy("draw").limit(sample).toPandas())
    removed(rows)
    shuffles_freed(df.sparkSession)
    if not all(map(len, drawn)):
        return None
    y = np.repeat([1.0, 0.0], [len(x) for x in drawn])
    buckets = [x for part in drawn for x in part["buckets"]]
    importance = np.repeat([n1 / len(drawn[0]), n0 / len(drawn[1])], [len(x) for x in drawn])
    at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in buckets])])
    flat = np.frombuffer(b"".join(buckets), "<u4").view(np.int32)
    del drawn, buckets
    model.fit(flat, at, y, importance)
    return model


def rate_ratio(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Log of how much larger a bucket's share of n1 toxic texts (a of them) is than of n0 others (b of them), shrunk.

    Both rates start from SMOOTHING texts of the usual share; z is their difference in standard errors.
    """
    usual = (a + b) / (n1 + n0) * SMOOTHING
    p = (a + b + 1) / (n1 + n0 + 2)
    sure = F.pow((a / n1 - b / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)), F.lit(4)) / SURE**4
    return F.log((a + usual) / (n1 + SMOOTHING) / ((b + usual) / (n0 + SMOOTHING))) * sure / (1 + sure)


def score(df: DataFrame, model: Model | None, limit: float = LIMIT) -> DataFrame:
    """Adds score and predicted; columns of these names are replaced."""
    small_batches(df.sparkSession)
    names = [c for c in df.columns if c not in ("score", "predicted")]
    known = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = known.value
        for batch in batches:
            texts = texts_of(batch)
            p = np.concatenate([model.scores(texts[a:b]) for a, b in pieces(texts)]) if model and texts else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p), pa.array((p >= limit).astype(np.int32))], names=[*names, "score", "predicted"])

    return df.select(*names).mapInArrow(run, StructType([*(df.schema[c] for c in names), StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    taught = F.coalesce(F.pmod(crc_of(F.col("doc_id")), F.lit(4)), F.lit(0)) != 2
    model = learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), taught)
    return score(docs, model).select("doc_id", (~taught).alias("held_out"), "score", "predicted")
