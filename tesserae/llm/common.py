"""Small pieces that the training-data operators share: shared-folder tables, hashing of words in numpy, ordered numbering."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


# ---------------------------------------------------------------- tables in the shared folder


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, local mode gets one of its own; a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes the rows as a table in the shared folder and reads them again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes a table that stored() made, once nothing reads it any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffles_freed(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of frames that nothing refers to any more; else they stay until the driver's heap fills."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Whole texts go to Python in batches of a few hundred, so that long ones don't fill a worker. The session keeps a smaller setting of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


# ---------------------------------------------------------------- words as hashes


def byte_table(pattern: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(pattern, np.uint8)] = True
    return table


#: Bytes of `[^\x20\x09-\x0D]`, and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing; both hold every byte of a non-ASCII letter.
NOT_SPACE = ~byte_table(bytes([0x20, *range(0x09, 0x0E)]))
WORD = byte_table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads differences over all bits; different numbers stay different."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


#: Of a number read from eight bytes, those that belong to a span with so many left.
_OWN = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of the buffer on, as one number; zeros stand after the end."""
    return np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))


def later_eights(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of spans longer than eight bytes: which have them, where each begins in the list of all their numbers but the first, and each number's place in its span."""
    long = np.flatnonzero(length > 8)
    n = (length[long] - 1) >> 3
    first = np.cumsum(n) - n
    return long, first, np.arange(n.sum()) - np.repeat(first, n) + 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, all at once.

    Eight bytes are one number. Each number is mixed with its place, which no arrangement of bytes undoes, and the sum is
    mixed again. Spans of up to eight bytes and the same length never collide.
    """
    wide, length = eights(buf), ends - starts
    with np.errstate(over="ignore"):
        h = mixed((wide[starts] & _OWN[np.minimum(length, 8)]) ^ mixed(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
        long, first, place = later_eights(length)
        if len(long):
            of = np.repeat(long, (length[long] - 1) >> 3)
            part = wide[starts[of] + 8 * place] & _OWN[np.minimum(length[of] - 8 * place, 8)]
            h[long] = mixed(h[long] + np.add.reduceat(mixed(part ^ mixed(place.astype(np.uint64))), first))
    return h


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One span of each kind, and of every span which kind it is. Hashes find the kinds; their bytes are compared."""
    _, first, kind = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    wide, length, like = eights(buf), ends - starts, first[kind]
    own = _OWN[np.minimum(length, 8)]
    same = (length == length[like]).all() and ((wide[starts] & own) == (wide[starts[like]] & own)).all()
    if same:
        long, _, place = later_eights(length)
        of = np.repeat(long, (length[long] - 1) >> 3)
        own = _OWN[np.minimum(length[of] - 8 * place, 8)]
        same = ((wide[starts[of] + 8 * place] & own) == (wide[starts[like[of]] + 8 * place] & own)).all()
    if not same:
        raw, kinds = buf.tobytes(), {}
        kind = np.array([kinds.setdefault(raw[a:b], len(kinds)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        first = np.unique(kind, return_index=True)[1]
    return first, kind


def pieces(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes; one longer document is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def buffer_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one line feed after each, and where each begins (with a last entry for the end)."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    return buf, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)


def word_spans(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate([[False], is_word[buf], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def hashed_words(texts: list[bytes], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased (A-Z) word of the texts, in order, and the offset of each text's first word (with a last entry)."""
    buf, begins = buffer_of(texts)
    buf = FOLD[buf]
    s, e = word_spans(buf, is_word)
    return span_hashes(buf, s, e), np.searchsorted(s, begins)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbouring entries; len(h) - n + 1 of them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:m].copy()
        for k in range(1, n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + m]
    return mixed(out + np.uint64(n))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A null text counts as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def record(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def flat_list(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
