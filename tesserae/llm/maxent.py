"""Operator 2: language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Tokens are words (runs of other bytes than white space, A-Z lower-cased) and one end for each text. One job counts all training
tokens. Words with a share of at least 1/VOCABULARY of them, so at most VOCABULARY words, are the model's own; a second job counts what
stands before those, and words with like neighbours share a class. A class is cut by frequency into groups of up to SMALL_CLASS words
and has up to SMALL_CLASS groups (a class with more words becomes several), so the context says which class, group and word, for every
own word. All other words form the class `rest`, inside which a word's probability is its add-one share of the rest's counts, one unseen
word included; so the model is a distribution over all words.

    log P(word | context) = log P(class | context) + log P(group | class, context) + log P(word | group, context)

All factors are softmaxes over hashed features of the context: the words one to three places before (skip features) and the pair
before; inside a class and a group, the word and the pair before. Training passes once over all training texts, in ROUNDS slices. In each, every task
takes gradient steps from the weights of the round before over its part of the slice; Spark averages the tasks' updates in levels of up to FAN, weighted
by tokens, and the driver holds the weights only, whose size doesn't depend on the corpus. Scoring is numpy over batches of
sparse features. Counts of words that are too rare to be broadcast are joined by a shuffle.

Words are told apart by 64-bit hashes. A null text is empty: one token, the end. Rows with a null doc_id train (they are not in the
held-out class). Repeated rows count and are scored as often as they come. A very long text is scored in one piece, and its context never
reaches into its neighbours. Words of equal frequency are in the order of their hashes. Without training texts all counts are 0; without rows the
result is empty. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, crc_of, documents, hashed_words, mixed, pieces, shuffles_freed, small_batches, stored, texts_of

END = np.uint64(0x6A09E667F3BCC909)
VOCABULARY, CLASSES, SMALL_CLASS, NEIGHBOURS = 1 << 17, 40, 64, 32
CONTEXTS, OWN, WORD_CONTEXTS = 4096, 3072, 64
SKIPS, ROUNDS, BATCH = 3, 3, 8192
BLOCK, TASK_BYTES, MOST_TASKS, FAN = 4096, 64 << 20, 4096, 256


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends included, and the offset of each text's first (with a last entry)."""
    h, offs = hashed_words(texts, NOT_SPACE)
    return np.insert(h, offs[1:], END), offs + np.arange(len(offs))


def counted(df: DataFrame) -> DataFrame:
    """word (64-bit hash), c."""

    def run(batches):
        held, size = [], 0

        def summed():
            words, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(words)
            words, c = words[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            return words[first], np.add.reduceat(c, first)

        for batch in batches:
            texts = texts_of(batch)
            for a, b in pieces(texts, 1 << 21):
                held.append(np.unique(tokens(texts[a:b])[0], return_counts=True))
                size += len(held[-1][0])
            if size > 2_000_000:
                held[:] = [summed()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["word", "c"])
                    held, size = [], 0
        if held:
            words, c = summed()
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(c)], names=["word", "c"])

    return df.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The model's own words by hash, most frequent first, with their counts."""

    def __init__(self, frequent: pd.DataFrame, n: int, v: int) -> None:
        frequent = frequent.sort_values(["c", "word"], ascending=[False, True])
        words, self.c = frequent["word"].to_numpy(np.int64).view(np.uint64), frequent["c"].to_numpy(np.int64)
        self.n, self.v, self.own = n, v, len(words)
        self.place = np.argsort(words)
        self.sorted = words[self.place]
        # A word outside the model's own has (c + 1) / rest of its class; all such words and one unseen make up the whole.
        self.rest = float(n + v - (self.c + 1).sum() + 1)

    def looked_up(self, h: np.ndarray) -> np.ndarray:
        """Rank of each token, or the number of own words for others."""
        if not len(self.sorted):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.place[at], len(self.sorted))


class Text:
    """Tokens of some texts as ranks, and their contexts' hashed features."""

    def __init__(self, texts: list[bytes], vocabulary: Vocabulary) -> None:
        self.h, self.offs = tokens(texts)
        self.rank = vocabulary.looked_up(self.h)
        name = np.where(self.rank < OWN, self.rank, OWN + (mixed(self.h) % np.uint64(CONTEXTS - OWN - 1)).astype(np.int64))
        at = np.arange(len(self.h)) - np.repeat(self.offs[:-1], np.diff(self.offs))
        before = []
        for k in range(1, SKIPS + 1):
            x = np.full(len(name), CONTEXTS - 1)
            x[k:] = name[:-k]
            x[at < k] = CONTEXTS - 1  # before the text
            before.append(x)
        pair = (mixed((before[0] * CONTEXTS + before[1]).astype(np.uint64)) >> np.uint64(20)).astype(np.int64)
        self.features = np.column_stack([*before, pair % CONTEXTS]).astype(np.uint16)  # sixteen bits sort by radix
        self.inner = np.column_stack([np.where(before[0] < WORD_CONTEXTS - 16, before[0], WORD_CONTEXTS - 16 + before[0] % 16), pair % WORD_CONTEXTS]).astype(np.uint16)


def neighbours(df: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often each of the model's own words follows each of the NEIGHBOURS most frequent ones."""
    known = df.sparkSession.sparkContext.broadcast(vocabulary)
    columns = [f"x{k}" for k in range(NEIGHBOURS)]

    def run(batches):
        v = known.value
        total = np.zeros(v.own * NEIGHBOURS, np.int64)
        for batch in batches:
            texts = texts_of(batch)
            for a, b in pieces(texts):
                h, offs = tokens(texts[a:b])
                rank, doc = v.looked_up(h), np.repeat(np.arange(b - a), np.diff(offs))
                for k in (1, 2):
                    near = rank[:-k]
                    ok = (near < min(NEIGHBOURS, v.own)) & (rank[k:] < v.own)
                    ok &= doc[k:] == doc[:-k]
                    total += np.bincount(rank[k:][ok] * NEIGHBOURS + near[ok], minlength=len(total))
        table = total.reshape(-1, NEIGHBOURS)
        some = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(table[some, k]) for k in range(NEIGHBOURS))], names=["word", *columns])

    sums = df.select("text").mapInArrow(run, "word long, " + ", ".join(f"{c} long" for c in columns)).groupBy("word").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
    out = np.zeros((vocabulary.own, NEIGHBOURS))
    out[sums["word"].to_numpy(np.int64)] = sums[columns].to_numpy()
    return out


def classes(near: np.ndarray, c: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Class of each word: k-means over the square roots of the neighbours' shares, seeded by evenly spaced words."""
    n = len(near)
    if n <= CLASSES:
        return np.arange(n)
    x = np.sqrt((near + 0.5 * near.sum(0) / max(near.sum(), 1)) / (near.sum(1, keepdims=True) + 0.5))
    centre = x[np.random.default_rng(5).choice(n, CLASSES, replace=False, p=np.sqrt(c) / np.sqrt(c).sum())]
    of = np.zeros(n, np.int64)
    for _ in range(rounds):
        of = (2 * x @ centre.T - (centre**2).sum(1)).argmax(1)
        weight = np.sqrt(c)
        mass = np.bincount(of, weight, CLASSES)
        for k in range(x.shape[1]):
            centre[:, k] = np.where(mass > 0, np.bincount(of, weight * x[:, k], CLASSES) / np.maximum(mass, 1e-9), centre[:, k])
    return of


class Model:
    """Weights: outer[feature, context, class], middle[feature, context and class, group] and inner[feature, context and group, word]."""

    def __init__(self, vocabulary: Vocabulary, of: np.ndarray) -> None:
        c = vocabulary.c.astype(float)
        # Words are in order of frequency, so their order inside a class is too.
        order = np.argsort(of, kind="stable")
        within = np.empty(len(of), np.int64)
        within[order] = np.arange(len(of)) - np.searchsorted(of[order], of[order])
        parts = within.max(initial=0) // SMALL_CLASS**2 + 1
        self.of = np.unique(of * parts + within // SMALL_CLASS**2, return_inverse=True)[1].reshape(-1)
        within %= SMALL_CLASS**2
        width = int(np.ceil(np.sqrt(within.max(initial=0) + 1)))  # of groups and of classes, SMALL_CLASS at most
        self.branch, self.leaf = within // width, within % width
        self.group = np.unique(self.of * width + self.branch, return_inverse=True)[1].reshape(-1)
        own = int(self.of.max(initial=-1)) + 1
        self.k = own + 1  # the last class is the rest
        self.small = int(self.group.max(initial=-1)) + 1
        mass = np.append(np.bincount(self.of, c, own), max(vocabulary.n - c.sum(), 1.0))
        self.outer_bias = np.log(np.maximum(mass, 0.5) / mass.sum()).astype(np.float32)
        self.middle_bias = np.zeros((own, width))
        np.add.at(self.middle_bias, (self.of, self.branch), np.maximum(c, 0.5))
        self.inner_bias = np.zeros((self.small, width))
        self.inner_bias[self.group, self.leaf] = np.maximum(c, 0.5)
        with np.errstate(divide="ignore"):  # places without a word have no probability
            self.middle_bias, self.inner_bias = (np.log(x / x.max(1, keepdims=True)).astype(np.float32) for x in (self.middle_bias, self.inner_bias))
        self.outer = np.zeros((SKIPS + 1, CONTEXTS, self.k), np.float32)
        self.middle = np.zeros((2, WORD_CONTEXTS * own, width), np.float32)
        self.inner = np.zeros((2, WORD_CONTEXTS * self.small, width), np.float32)

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.outer, self.middle, self.inner]

    @weights.setter
    def weights(self, tables: list[np.ndarray]) -> None:
        self.outer, self.middle, self.inner = tables

    def classes_of(self, rank: np.ndarray) -> np.ndarray:
        return np.append(self.of, self.k - 1)[np.minimum(rank, len(self.of))]

    def outer_probabilities(self, features: np.ndarray) -> np.ndarray:
        return softmax(self.outer, features, self.outer_bias)

    def middle_probabilities(self, c: np.ndarray | int, inner: np.ndarray) -> np.ndarray:
        return softmax(self.middle, placed(inner, c, len(self.middle_bias)), self.middle_bias[c])

    def inner_probabilities(self, g: np.ndarray | int, inner: np.ndarray) -> np.ndarray:
        return softmax(self.inner, placed(inner, g, len(self.inner_bias)), self.inner_bias[g])

    def step(self, rank: np.ndarray, features: np.ndarray, inner: np.ndarray, rate: float) -> None:
        changed(self.outer, features, self.outer_probabilities(features), self.classes_of(rank), rate / 2)
        known = rank < len(self.of)
        rank, inner = rank[known], inner[known]
        if len(rank):
            c, g = self.of[rank], self.group[rank]
            changed(self.middle, placed(inner, c, len(self.middle_bias)), self.middle_probabilities(c, inner), self.branch[rank], rate)
            changed(self.inner, placed(inner, g, len(self.inner_bias)), self.inner_probabilities(g, inner), self.leaf[rank], rate)

    def scores(self, text: Text) -> np.ndarray:
        """log10 P of each token; for the rest's words, of their class alone."""
        out = np.empty(len(text.rank))
        for a in range(0, len(out), BATCH // 2):
            cut = slice(a, a + BATCH // 2)
            rank, inner = text.rank[cut], text.inner[cut]
            p = self.outer_probabilities(text.features[cut])
            s = np.log10(p[np.arange(len(p)), self.classes_of(rank)].astype(float))
            known = np.flatnonzero(rank < len(self.of))
            if len(known):
                rank, inner, at = rank[known], inner[known], np.arange(len(known))
                s[known] += np.log10(self.middle_probabilities(self.of[rank], inner)[at, self.branch[rank]].astype(float))
                s[known] += np.log10(self.inner_probabilities(self.group[rank], inner)[at, self.leaf[rank]].astype(float))
            out[cut] = s
        return out


def placed(inner: np.ndarray, at: np.ndarray | int, n: int) -> np.ndarray:
    """Rows of a table over contexts and n classes or groups."""
    return inner.astype(np.int32) * np.int32(n) + np.broadcast_to(at, len(inner)).astype(np.int32)[:, None]


def logits(tables: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = tables[0].take(rows[:, 0], 0)
    for f in range(1, len(tables)):
        z += tables[f].take(rows[:, f], 0)
    z += bias
    return z


def softmax(tables: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Biases are at most 0 and weights small, so the largest is taken out of the logits only where their sum over- or underflows."""
    z = logits(tables, rows, bias)
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(z, out=z)
        total = z.sum(1, keepdims=True)
    if len(z) and not 1e-30 < total.min() <= total.max() < 1e30:
        z = logits(tables, rows, bias)
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        total = z.sum(1, keepdims=True)
    z /= total
    return z


def changed(tables: np.ndarray, rows: np.ndarray, p: np.ndarray, right: np.ndarray, rate: float) -> None:
    """A step of all tables from the probabilities p, which it overwrites."""
    np.negative(p, out=p)
    p[np.arange(len(p)), right] += 1
    for f in range(len(tables)):
        moved(tables[f], rows[:, f], p, rate)


def moved(table: np.ndarray, at: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """A step for each row of the table: the mean gradient of the tokens that point to it, damped where they are few."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    n = np.diff(np.append(first, len(at)))[:, None].astype(np.float32)
    table[at[first]] += rate * np.add.reduceat(gradient.take(order, 0), first, axis=0) / (n + np.float32(20))


def trained(df: DataFrame, vocabulary: Vocabulary) -> Model:
    spark = df.sparkSession
    model = Model(vocabulary, classes(neighbours(df, vocabulary), vocabulary.c))
    # Each task returns as many numbers as the model has weights, so a task takes TASK_BYTES of text or more, and beyond MOST_TASKS (or two for each
    # core) tasks grow instead of becoming more.
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(2 * spark.sparkContext.defaultParallelism, min(size // TASK_BYTES, MOST_TASKS))
    slices = F.pmod(F.xxhash64("text"), F.lit(ROUNDS))
    for k in range(ROUNDS):
        now = spark.sparkContext.broadcast((model, vocabulary))
        rate = 8.0 / (1 + k)

        def run(batches, now=now, rate=rate):
            model, vocabulary = now.value
            old, seen = model.weights, 0
            model.weights = [x.copy() for x in old]
            try:
                for batch in batches:
                    texts = texts_of(batch)
                    for a, b in pieces(texts):
                        t = Text(texts[a:b], vocabulary)
                        order = np.random.default_rng(len(t.rank)).permutation(len(t.rank))
                        for s in range(0, len(order), BATCH):
                            rows = order[s : s + BATCH]
                            model.step(t.rank[rows], t.features[rows], t.inner[rows], rate)
                        seen += len(order)
                change = np.concatenate([(x - y).reshape(-1) for x, y in zip(model.weights, old, strict=True)]) * np.float32(seen)
            finally:
                model.weights = old
            if seen:
                # Blocks without a change go without numbers; their weight still counts.
                cuts = [x.tobytes() if x.any() else b"" for x in (change[s : s + BLOCK] for s in range(0, len(change), BLOCK))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts))), pa.array([TaskContext.get().partitionId()] * len(cuts), pa.int64()), pa.array([seen] * len(cuts), pa.int64()), pa.array(cuts, pa.binary())], names=["block", "task", "seen", "change"])

        def summed(pdf):
            total = np.zeros(pdf.change.str.len().max() // 4)
            for change in pdf.change:
                if change:
                    total += np.frombuffer(change, np.float32)
            return pd.DataFrame({"block": pdf.block[:1], "task": pdf.task[:1] // FAN, "seen": [pdf.seen.sum()], "change": [total.astype(np.float32).tobytes()]})

        # Sums of up to FAN tasks' changes, then of up to FAN sums, so that no group grows with the corpus.
        kinds, left = "block long, task long, seen long, change binary", tasks
        updates = df.where(slices == k).select("text").coalesce(tasks).mapInArrow(run, kinds)
        while True:
            updates = updates.groupBy("block", F.floor(F.col("task") / FAN)).applyInPandas(summed, kinds)
            if left <= FAN:
                break
            left = -(-left // FAN)
        update = updates.toPandas().sort_values("block")
        if len(update):
            flat = np.zeros(sum(x.size for x in model.weights), np.float32)
            for block, seen, change in zip(update["block"], update["seen"], update["change"], strict=True):
                flat[block * BLOCK : block * BLOCK + len(change) // 4] = np.frombuffer(change, np.float32) / np.float32(seen)
            cuts = np.split(flat, np.cumsum([x.size for x in model.weights])[:-1])
            model.weights = [x + y.reshape(x.shape) for x, y in zip(model.weights, cuts, strict=True)]
        del updates, update
        shuffles_freed(spark)
    return model


def scored(df: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of df (doc_id, text)."""
    spark = df.sparkSession
    small_batches(spark)
    df = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    train = df.where(~held_out).select("text")
    counts = stored(counted(train), "counts")
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    vocabulary = Vocabulary(counts.where(F.col("c") * VOCABULARY >= n).toPandas(), n, v)
    model = trained(train, vocabulary)
    known = spark.sparkContext.broadcast((model, vocabulary))

    def run(batches):
        model, vocabulary = known.value
        logs = np.log10(np.append(vocabulary.c, 0) + 1.0)
        for batch in batches:
            texts = texts_of(batch)
            for a, b in pieces(texts):
                t = Text(texts[a:b], vocabulary)
                offs, rare = t.offs, t.rank == vocabulary.own
                sums = [np.add.reduceat(x, offs[:-1]) for x in (~rare, logs[t.rank], model.scores(t), rare)]
                edges = np.concatenate([[0], np.cumsum(rare)])[offs]
                words = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(t.h[rare].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in ("row_id", "doc_id", "held_out")), pa.array(np.diff(offs)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.array(sums[3].astype(np.int64)), words], names=["row_id", "doc_id", "held_out", "n_tokens", "known", "base", "model", "rest", "rare"])

    kinds = f"row_id long, doc_id {df.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, known long, base double, model double, rest long, rare array<long>"
    part = stored(df.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", held_out.alias("held_out"), "text").mapInArrow(run, kinds), "scored")
    rare = part.select("row_id", F.explode("rare").alias("word")).groupBy("row_id", "word").agg(F.count("*").alias("times"))
    found = rare.join(counts, "word").groupBy("row_id").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("logs"))
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return part.join(found, "row_id", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + more).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * float(np.log10(n + v + 1.0))).alias("base_score"),
        (F.col("model") + logs - F.col("rest") * float(np.log10(vocabulary.rest))).alias("score"),
    )


def op2_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(crc_of(F.col("doc_id")), F.lit(7)) == 2, F.lit(False))
    return scored(documents(spark, sf_dir), held_out)
