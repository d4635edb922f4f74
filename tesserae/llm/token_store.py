"""Operator 9: a content-addressed store of token ids.

Every text is encoded, an end id is appended, and a rolling hash over the last ids cuts the stream into chunks, so that equal
passages give equal chunks wherever they stand. Three Parquet folders make up the store:

    chunks    digest binary, n int, width int, ids binary     each distinct chunk once; ids: a zstd frame of little-endian unsigned integers of width bytes
    recipes   doc_id, row_id, start, n_tokens, root, chunks array<struct<digest, n>>, part    in ascending doc_id order
    manifest  part, level, place, n_docs, n_tokens, root     Merkle nodes: of each part of recipes, and over the parts (part -1)

A document's root is the hash of its chunks' digests. A node's root is the hash of the roots of up to FAN nodes below it, in
order, so no list grows with the corpus. Reading computes all nodes anew from the recipes and fails unless they are those of the manifest:
a lost or added document, a recipe altered together with its root, a lost part and a lost manifest are all noticed. Then
the digest of every chunk and the root of every document are computed from the ids themselves and compared.

Nulls and empty texts are documents of the end id alone. A very long text without a place to cut is encoded as a whole and not remembered.
Rows that share a doc_id stay documents of their own, in a fixed order; a null doc_id comes first. Repeated rows share their chunks.
Other columns are ignored. Without rows the store is empty.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FOLD, NOT_SPACE, buffer_of, distinct_spans, documents, pieces, removed, scratch, shuffles_freed, small_batches, stored, texts_of

VOCABULARY = "byte_bpe_50k.json"
CUT_BITS, WINDOW, LONGEST, FAN = 10, 8, 1 << 14, 1024
REMEMBERED, REMEMBERED_BYTES = 250_000, 64


class Vocabulary:
    """A tokenizer file, the texts of its special tokens, and whether its words can be told apart beforehand."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        words = spec["pre_tokenizer"] or {}
        self.marks = [t["content"].encode() for t in spec["added_tokens"]]
        # Cutting is right for the words that the plain byte-level rule makes of the bytes as they are.
        self.cuts = words.get("type") == "ByteLevel" and words.get("use_regex") is True and not words.get("add_prefix_space") and not spec["normalizer"] and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        self.lengths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # bytes that each id stands for: the characters of its byte-level token
        for token, k in self.tokenizer.get_vocab().items():
            self.lengths[k] = len(token)


@lru_cache(4)
def loaded(path: str | None) -> Vocabulary:
    """Once per worker process; the vocabulary file lies beside the library on every machine."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers

    return Vocabulary(path or public_tokenizers.path(VOCABULARY))


def encoded(texts: list[bytes], path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts and the offset of each text's first id (with a last entry).

    The tokenizer's words never reach across a space after another character, a line feed after one or a single one before a letter, or a punctuation mark
    after a letter, so texts are cut there and equal segments are encoded once. Texts that hold a special token of the vocabulary are
    encoded whole, and so are all texts with a vocabulary whose words follow another rule.
    """
    vocabulary = loaded(path)
    tokenizer = vocabulary.tokenizer
    whole = {i: tokenizer.encode(t.decode(), add_special_tokens=False).ids for i, t in enumerate(texts) if t and (not vocabulary.cuts or any(m in t for m in vocabulary.marks))}
    texts = [b"" if i in whole else t for i, t in enumerate(texts)]
    buf, begins = buffer_of(texts)
    # Next to characters from U+0800 on, and from U+0080 to U+00BF, no cut is made: some of them are spaces too.
    low = FOLD[buf]
    letter, plain, lead = (low >= 97) & (low <= 122), NOT_SPACE[buf] & (buf < 0x80), (buf >= 0xC3) & (buf < 0xE0)
    before, word_end, feed = plain.copy(), letter.copy(), buf == 0x0A
    before[1:] |= lead[:-1]
    word_end[1:] |= (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
    mark_ = plain & ~letter & ~((buf >= 48) & (buf <= 57))
    cut = np.zeros(len(buf), bool)
    cut[1:-1] = (buf[1:-1] == 0x20) & before[:-2] & (plain | lead)[2:]
    cut[1:] |= mark_[1:] & word_end[:-1] | feed[1:] & before[:-1]
    cut[2:] |= letter[2:] & feed[1:-1] & before[:-2]
    cut[begins[:-1]] = True
    cut[begins[1:] - 1] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(buf))
    real = np.ones(len(starts), bool)
    real[np.searchsorted(starts, begins[1:] - 1)] = False  # the line feeds between texts
    starts, ends = starts[real], ends[real]
    if len(starts):
        first, inverse = distinct_spans(buf, starts, ends)
        raw = buf.tobytes()
        segments = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        parts = segment_ids(segments, path)
        ids = np.frombuffer(b"".join(parts), np.uint32)
        offs = np.concatenate([[0], np.cumsum([len(x) // 4 for x in parts])])
        n = np.diff(offs)[inverse]
        total = np.concatenate([[0], np.cumsum(n)])
        spread = np.repeat(offs[:-1][inverse] - total[:-1], n) + np.arange(total[-1])
        ids, offs = ids[spread], total[np.searchsorted(starts, begins)]
    else:
        ids, offs = np.zeros(0, np.uint32), np.zeros(len(begins), np.int64)
    if whole:
        lists = [np.array(whole[i], np.uint32) if i in whole else ids[offs[i] : offs[i + 1]] for i in range(len(texts))]
        ids, offs = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return ids, offs


LETTERS_ONLY = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: The sign that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others in order from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_SIGNS = {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def signs(word: bytes) -> str:
    """The bytes of a word of letters as the vocabulary's signs; ASCII letters stand for themselves."""
    text = word.decode("latin-1")
    if not word.isascii():
        return text.translate(BYTE_SIGNS)
    return BYTE_SIGNS[32] + text[1:] if text[0] == " " else text


#: Segments seen lately and their ids, by vocabulary: of the time now and of the time before.
_recent: dict[str | None, tuple[dict[bytes, bytes], dict[bytes, bytes]]] = {}


def segment_ids(segments: list[bytes], path: str | None = None) -> list[bytes]:
    """Ids (unsigned, 32 bits) of each segment. Those seen lately stay in two tables of the worker: REMEMBERED segments and those of one batch, of REMEMBERED_BYTES each.

    A segment of letters (with a space before them or not) is one word, whose bytes the vocabulary's merges take as they are. Other
    segments that begin with a space stay words of their own side by side, so all new ones go through the tokenizer in one call; the
    lengths of the ids' byte strings tell where each ends.
    """
    vocabulary = loaded(path)
    tokenizer = vocabulary.tokenizer
    recent, before = _recent.get(path, ({}, {}))
    if len(recent) > REMEMBERED:
        recent, before = {}, recent
    _recent[path] = recent, before
    out = list(map(recent.get, segments))
    new = [s for s, ids in zip(segments, out, strict=True) if ids is None]
    found = {s: ids for s in new if (ids := before.get(s)) is not None}
    new = [s for s in new if s not in found]
    plain = list(filter(LETTERS_ONLY.fullmatch, new))
    merges = tokenizer.model.tokenize
    found.update((s, array("I", [t.id for t in merges(signs(s))]).tobytes()) for s in plain)
    new = [s for s in new if s not in found]
    spaced, other = [s for s in new if s[:1] == b" "], [s for s in new if s[:1] != b" "]
    if spaced:
        ids = np.array(tokenizer.encode_batch_fast([b"".join(spaced).decode()], add_special_tokens=False)[0].ids, np.uint32)
        reach, ends = np.cumsum(vocabulary.lengths[ids]), np.cumsum([len(s) for s in spaced])
        cuts = np.searchsorted(reach, ends) + 1
        if not np.array_equal(reach[cuts - 1], ends):
            raise ValueError("a token of the vocabulary spans two words")
        raw = ids.tobytes()
        found.update(zip(spaced, (raw[4 * a : 4 * b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)), strict=True))
    if other:
        found.update(zip(other, (np.array(e.ids, np.uint32).tobytes() for e in tokenizer.encode_batch_fast([s.decode() for s in other], add_special_tokens=False)), strict=True))
    recent.update((s, ids) for s, ids in found.items() if len(s) <= REMEMBERED_BYTES)
    return [found[s] if ids is None else ids for s, ids in zip(segments, out, strict=True)]


def with_end(ids: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, offs[1:], np.uint32(end)), offs + np.arange(len(offs))


def chunk_ends(ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where chunks end: at each text's end, where the rolling hash of the last ids has CUT_BITS zero bits, and after LONGEST ids."""
    with np.errstate(over="ignore"):
        mix = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        rolling = mix.copy()
        for k in range(1, WINDOW):
            rolling[k:] += mix[:-k] << np.uint64(5 * k % 64) | mix[:-k] >> np.uint64(64 - 5 * k % 64)
        cut = (rolling * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - CUT_BITS) == 0
    cut &= np.arange(len(ids)) - np.repeat(offs[:-1], np.diff(offs)) >= WINDOW - 1  # a text's first ids have no full window
    ends = np.union1d(np.flatnonzero(cut) + 1, offs[1:])
    starts = np.concatenate([[0], ends[:-1]])
    if len(long := np.flatnonzero(ends - starts > LONGEST)):
        ends = np.union1d(ends, np.concatenate([np.arange(starts[k] + LONGEST, ends[k], LONGEST) for k in long]))
    return ends[ends > 0]


def id_width(end: int, path: str | None) -> int:
    return 2 if max(len(loaded(path).lengths), end + 1) <= 1 << 16 else 4


def chunked(df: DataFrame, text: str = "text", end: int = 2, path: str | None = None) -> DataFrame:
    """One row per chunk occurrence: doc_id, row_id, seq, n, digest, ids. Ids take 2 bytes if the vocabulary and the end id allow it, else 4."""
    width = id_width(end, path)
    kind = f"<u{width}"
    small_batches(df.sparkSession, 1024)
    rows = df.select("doc_id", F.monotonically_increasing_id().alias("row_id"), F.col(text).alias("text"))
    kinds = pa.schema([("doc_id", pa.int64()), ("row_id", pa.int64()), ("seq", pa.int32()), ("n", pa.int32()), ("digest", pa.binary()), ("ids", pa.binary())])

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = texts_of(batch)
            for a, b in pieces(texts, 1 << 21):
                ids, offs = with_end(*encoded(texts[a:b], path), end)
                ends = chunk_ends(ids, offs)
                starts = np.concatenate([[0], ends[:-1]])
                of = np.searchsorted(offs, starts, side="right") - 1
                seq = np.arange(len(starts)) - np.searchsorted(starts, offs[:-1])[of]
                raw = ids.astype(kind).tobytes()
                payload = [raw[width * x : width * y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                digest = [hashlib.blake2b(p, digest_size=16).digest() for p in payload]
                keys = [batch.column(k).slice(a, b - a).take(pa.array(of)) for k in ("doc_id", "row_id")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(seq, pa.int32()), pa.array(ends - starts, pa.int32()), pa.array(digest, pa.binary()), pa.array(list(map(squeeze, payload)), pa.binary())], schema=kinds)

    return rows.mapInArrow(run, "doc_id long, row_id long, seq int, n int, digest binary, ids binary")


def write_store(df: DataFrame, base: str, text: str = "text", end: int = 2, path: str | None = None) -> None:
    """Writes the three folders under base."""
    spark = df.sparkSession
    cut = stored(chunked(df.select(F.col("doc_id").cast("long").alias("doc_id"), text), text, end, path), "chunked")
    distinct = cut.groupBy("digest").agg(F.first("n").alias("n"), F.first("ids").alias("ids"))
    distinct.withColumn("width", F.lit(id_width(end, path))).write.option("compression", "zstd").parquet(f"{base}/chunks")
    del distinct
    listed = cut.groupBy("doc_id", "row_id").agg(F.sum(F.col("n").cast("long")).alias("n_tokens"), F.array_sort(F.collect_list(F.struct("seq", "digest", "n"))).alias("chunks"))
    listed = listed.select("doc_id", "row_id", "n_tokens", F.transform("chunks", lambda c: F.struct(c["digest"].alias("digest"), c["n"].alias("n"))).alias("chunks"))
    # Ascending order: ranges of doc_id, each a part of its own; a part's first position is the sum over the parts before it.
    ranged = stored(listed.repartitionByRange(F.col("doc_id").asc_nulls_first(), "row_id").withColumn("part", F.spark_partition_id()), "ranged")
    removed(cut)
    before = ranged.groupBy("part").agg(F.sum("n_tokens").alias("sum")).select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("before"))
    order = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "row_id")
    digests = F.array_join(F.transform("chunks", lambda c: F.hex(c["digest"])), "")
    recipes = ranged.join(before, "part").select(
        "doc_id",
        "row_id",
        (F.col("before") + F.sum("n_tokens").over(order) - F.col("n_tokens")).alias("start"),
        "n_tokens",
        F.sha2(digests.cast("binary"), 256).alias("root"),
        "chunks",
        "part",
        (F.row_number().over(order) - 1).cast("long").alias("place"),
    )
    recipes.write.option("compression", "zstd").parquet(f"{base}/recipes")
    removed(ranged)
    del cut, listed, ranged, recipes
    shuffles_freed(spark)
    merkle(spark.read.parquet(f"{base}/recipes")).write.parquet(f"{base}/manifest")


def merkle(recipes: DataFrame) -> DataFrame:
    """part, level, place, n_docs, n_tokens, root: the nodes over the recipes of each part, and (part -1) over the parts' last ones."""
    nodes = recipes.select("part", "place", F.lit(1).cast("long").alias("n_docs"), "n_tokens", "root")
    out, leaves = [], nodes.agg(F.max("place")).first()[0]

    def above(nodes: DataFrame, highest: int, level: int) -> DataFrame:
        while True:
            in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "root"))), lambda x: x["root"]), "")
            nodes = nodes.groupBy("part", F.floor(F.col("place") / FAN).cast("long").alias("above")).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sha2(in_order.cast("binary"), 256).alias("root"))
            nodes = nodes.withColumnRenamed("above", "place")
            if level == 1:  # the only level that reads recipes; its rows are a FAN-th of them
                nodes = stored(nodes, "merkle")
            out.append(nodes.withColumn("level", F.lit(level)))
            highest, level = highest // FAN, level + 1
            if not highest:
                return nodes

    heads = above(nodes, leaves or 0, 1)
    last = heads.agg(F.max("part")).first()[0] or 0
    above(heads.select(F.lit(-1).alias("part"), F.col("part").cast("long").alias("place"), "n_docs", "n_tokens", "root"), last, 2)
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows.select("part", "level", "place", "n_docs", "n_tokens", "root")


def checked(spark: SparkSession, base: str) -> None:
    """Raises an error unless the nodes over the recipes are those of the manifest."""
    try:
        want = spark.read.parquet(f"{base}/manifest")
        recipes = spark.read.parquet(f"{base}/recipes")
    except AnalysisException as missing:
        raise ValueError("the store lacks its manifest or its recipes") from missing
    got, keys = merkle(recipes), ["part", "level", "place"]
    values = lambda df, name: df.select(*keys, F.struct("n_docs", "n_tokens", "root").alias(name))
    differ = values(got, "got").join(values(want, "want"), keys, "full_outer").where(~F.col("got").eqNullSafe(F.col("want")))
    if bad := differ.orderBy(F.col("level").desc(), *keys).first():
        raise ValueError(f"recipes don't match the manifest: part {bad.part}, level {bad.level}, node {bad.place}")


def read_store(spark: SparkSession, base: str) -> DataFrame:
    """doc_id, row_id, start, n_tokens and ids (binary) of every document, rebuilt from recipes and chunks and verified."""
    checked(spark, base)
    recipes = spark.read.parquet(f"{base}/recipes")
    chunks = spark.read.parquet(f"{base}/chunks").select("digest", "width", F.col("ids").alias("part_ids"))
    needed = recipes.select("doc_id", "row_id", "start", "n_tokens", "root", F.posexplode("chunks").alias("seq", "c")).select("doc_id", "row_id", "start", "n_tokens", "root", "seq", F.col("c.digest").alias("digest"))
    found = needed.join(chunks, "digest", "left").groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.first("width").alias("width"), F.array_sort(F.collect_list(F.struct("seq", "part_ids"))).alias("parts"))
    kinds = pa.schema([("doc_id", pa.int64()), ("row_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        unsqueeze = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            lists = batch.column("parts")
            flat = [p and unsqueeze(p) for p in lists.flatten().field("part_ids").to_pylist()]
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).tolist()
            out = []
            for a, b, root in zip(at[:-1], at[1:], batch.column("root").to_pylist(), strict=True):
                own = flat[a:b]
                if any(p is None for p in own) or hashlib.sha256("".join(hashlib.blake2b(p, digest_size=16).hexdigest().upper() for p in own).encode()).hexdigest() != root:
                    raise ValueError("a document doesn't match its root in the recipes")
                out.append(b"".join(own))
            out = [np.frombuffer(p, f"<u{width}").astype("<u4").tobytes() for p, width in zip(out, batch.column("width").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "row_id", "start", "n_tokens")), pa.array(out, pa.binary())], schema=kinds)

    return found.mapInArrow(run, "doc_id long, row_id long, start long, n_tokens long, ids binary")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch(spark, "token-store")
    write_store(documents(spark, sf_dir).select("doc_id", "text"), base)
    return read_store(spark, base).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
