"""Operator 6: language identification by averaged hashed subword embeddings.

A text's subwords are its windows of 2 to 4 bytes inside words, hashed into buckets. Their embeddings are averaged and a linear softmax
gives the languages' probabilities; both are trained by stochastic gradient descent in numpy. One part of the sample, left
out of training, sets the temperature of the probabilities and the confidence below which a prediction is rejected.

The model is fitted on a bounded sample of whole texts: SAMPLE rows at most (about the same number for each language), chosen by a hash
of doc_id and text, so that copies are drawn one by one. Tasks turn them into counts of buckets; only these go to
the driver. As the average is linear, embeddings and softmax weights are multiplied once, before prediction.

A null text or one without a letter is `und` with score 0 and is rejected; so is every text where nothing could be learned.
Rows without a language teach nothing but are predicted; a null doc_id is like any other. Repeated rows are each predicted. A very
long text counts in training and in prediction as any other, by its shares of buckets. Other columns pass through, unless they bear
the name of a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import crc_of, documents, pieces, shuffles_freed, small_batches, texts_of
from .subwords import letter_buffer, windows

SAMPLE = 8_000
SIZES, BITS, DIMENSIONS = (2, 3, 4), 16, 16
EPOCHS, BATCH, LEAST_STEPS, RATE = 4, 64, 500, 0.5
KEPT = 0.9999


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every subword, by text."""
    buf, begins = letter_buffer(texts)
    at, bucket = zip(*windows(buf, SIZES, BITS), strict=True) if len(buf) > 3 else ([np.zeros(0, np.int64)],) * 2
    at, bucket = np.concatenate(at), np.concatenate(bucket)
    doc = np.maximum(np.searchsorted(begins, at, side="right") - 1, 0)
    order = np.argsort(doc, kind="stable")
    return doc[order], bucket[order]


class Bags:
    """Texts as buckets and how often each holds them: the bags of row k are b[at[k] : at[k + 1]] and n of the same places."""

    def __init__(self, packed: list[bytes | pa.Buffer]) -> None:
        """packed: for each text little-endian sixteen-bit buckets, then as many bytes of counts; a count over 255 takes several places."""
        size = np.array([len(x) // 3 for x in packed], np.int64)
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.b, self.n = np.zeros(self.at[-1], np.uint16), np.zeros(self.at[-1], np.uint8)
        for k, x in enumerate(packed):
            self.b[self.at[k] : self.at[k + 1]] = np.frombuffer(x, "<u2", size[k])
            self.n[self.at[k] : self.at[k + 1]] = np.frombuffer(x, np.uint8, offset=2 * size[k])

    def some(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, their shares of their text, and where each text's begin."""
        size = self.at[rows + 1] - self.at[rows]
        first = np.cumsum(size) - size
        where = np.repeat(self.at[rows] - first, size) + np.arange(size.sum())
        n = self.n[where].astype(np.float32)
        return self.b[where].astype(np.int64), n / np.repeat(np.add.reduceat(n, first), size), first


def packed(texts: list[bytes]) -> list[bytes]:
    of, bucket = features(texts)
    keys, n = np.unique(of << BITS | bucket, return_counts=True)
    times = (n + 254) // 255
    of, bucket = np.repeat(keys >> BITS, times), np.repeat(keys & ((1 << BITS) - 1), times).astype("<u2")
    last = np.cumsum(times) - 1
    count = np.full(len(of), 255, np.uint8)
    count[last] = n - 255 * (times - 1)
    edges = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
    return [bucket[a:b].tobytes() + count[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Model:
    """Languages, and for each bucket what one subword adds to their scores."""

    def __init__(self, bags: Bags, names: list[str], seed: int = 7) -> None:
        self.names = sorted(set(names))
        place = {x: k for k, x in enumerate(self.names)}
        y = np.array([place[n] for n in names])
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(names))
        apart = order[: max(len(names) // 6, 1)]
        train = order[len(apart) :] if len(names) > 1 else order
        e = rng.normal(0, 0.1, (1 << BITS, DIMENSIONS)).astype(np.float32)
        w = np.zeros((DIMENSIONS, len(self.names)), np.float32)
        bias = np.zeros(len(self.names), np.float32)
        epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(train)))
        steps, done = epochs * -(-len(train) // BATCH), 0
        for _ in range(epochs):
            rng.shuffle(train)
            for k in range(0, len(train), BATCH):
                rows = train[k : k + BATCH]
                b, share, first = bags.some(rows)
                mean = np.add.reduceat(e[b] * share[:, None], first, axis=0)
                p = softmax(mean @ w + bias)
                p[np.arange(len(rows)), y[rows]] -= 1
                rate = RATE * (1 - done / steps)
                back = p @ w.T
                w -= rate * mean.T @ p / len(rows) * 8
                bias -= rate * p.mean(0)
                of = np.repeat(np.arange(len(rows)), np.diff(np.append(first, len(b))))
                for d in range(DIMENSIONS):
                    e[:, d] -= rate * 4 * np.bincount(b, back[of, d] * share, 1 << BITS).astype(np.float32)
                done += 1
        self.table = (e @ w).astype(np.float32)
        self.bias = bias
        self.heat, self.least = 1.0, 0.0
        z = np.concatenate([np.add.reduceat(self.table[b] * share[:, None], first, axis=0) + self.bias for b, share, first in (bags.some(apart[a : a + 256]) for a in range(0, len(apart), 256))])
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(apart)), y[apart]] + 1e-12).mean()
        self.heat = min(np.geomspace(0.25, 8, 60).tolist(), key=loss)
        p = softmax(z / self.heat)
        right = p.max(1)[p.argmax(1) == y[apart]]
        self.least = float(min(0.5, np.quantile(right, 1 - KEPT))) if len(right) else 0.0

    def scores(self, texts: list[bytes]) -> np.ndarray:
        buf, begins = letter_buffer(texts)
        total, count = np.zeros((len(texts), len(self.names))), np.zeros(len(texts))
        for at, bucket in windows(buf, SIZES, BITS):
            rows = self.table[bucket]
            edges = np.searchsorted(at, begins)
            edges[0] = 0
            full = np.flatnonzero(edges[1:] > edges[:-1])
            if len(full):
                total[full] += np.add.reduceat(rows, edges[full], axis=0, dtype=np.float64)
            count += np.diff(edges)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predicted(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.scores(texts) / self.heat)
        return p.argmax(1), p.max(1)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def learned(df: DataFrame, teaches: Column, sample: int = SAMPLE) -> Model | None:
    """A model from the rows of df (doc_id, text, lang) that may teach; None if there are none."""
    rows = df.where(teaches & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().toLocalIterator()}
    if not counts:
        return None
    each = max(sample // len(counts), 1)
    chance = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))))
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            for a, b in pieces(texts):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("draw", "lang")), pa.array(packed(texts[a:b]), pa.binary())], names=["draw", "lang", "bag"])

    # A text with a letter holds windows, so no bag is empty. Copies with one doc_id share a draw; the limit holds for them too.
    drawn = rows.select(F.xxhash64("doc_id", "text").alias("draw"), "lang", "text").where(F.pmod("draw", F.lit(1 << 30)) < chance[F.col("lang")] * (1 << 30))
    drawn = drawn.mapInArrow(run, "draw long, lang string, bag binary").where("length(bag) > 0").orderBy("draw", "lang", "bag").limit(sample).toArrow()
    shuffles_freed(df.sparkSession)
    names = drawn.column("lang").to_pylist()
    bags = Bags([x.as_buffer() for chunk in drawn.column("bag").chunks for x in chunk])
    del drawn
    pa.default_memory_pool().release_unused()
    return Model(bags, names) if names else None


def identify(df: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred, score and accepted; columns of these names are replaced."""
    small_batches(df.sparkSession)
    names = [c for c in df.columns if c not in ("lang_pred", "score", "accepted")]
    known = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = known.value
        for batch in batches:
            texts = texts_of(batch)
            letters = batch.column("has_letter_").to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if model:
                for a, b in pieces(texts):
                    best, sure = model.predicted(texts[a:b])
                    for i in range(b - a):
                        if letters[a + i]:
                            lang[a + i], score[a + i] = model.names[best[i]], min(sure[i], 1.0)
            accepted = [x != "und" and s >= model.least for x, s in zip(lang, score.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lang), pa.array(score), pa.array(accepted, pa.bool_())], names=[*names, "lang_pred", "score", "accepted"])

    schema = StructType([*(df.schema[c] for c in names), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("accepted", BooleanType())])
    return df.select(*names, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter_")).mapInArrow(run, schema)


def taught_by(df: DataFrame) -> Column:
    return F.coalesce(F.pmod(crc_of(F.col("doc_id")), F.lit(4)), F.lit(0)) != 2


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), learned(docs, taught_by(docs)))
    return found.select("doc_id", (~taught_by(found)).alias("held_out"), "lang_pred", "score", "accepted")
