"""Operator 10: SentencePiece encoding and decoding by vectorised merge rounds.

Units. No merge can cross two neighbouring characters that no piece of the vocabulary holds side by side, so a text falls
into units at such places. Equal units of a batch are encoded once.

Rounds. The characters of all units lie in one flat array. Each round looks up the rank of every neighbouring pair, takes the
smallest rank of each unit, merges that pair from the left, and compacts the arrays; units without a pair left are finished. All
occurrences of a unit's best pair merge at once, unless the new piece can take part in a merge of the same or a better rank: then only
the leftmost does, as the sequential algorithm would choose the next pair afresh.

Nulls and empty texts have no ids and decode to the empty text. Repeated rows are encoded each. Other columns pass through.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import buffer_of, distinct_spans, documents, pieces, small_batches, texts_of

MODEL = "piece_bpe_32k.model"
NONE = np.int32(2**31 - 1)
SPACE = "▁"


class Pieces:
    """A BPE model file as numpy tables."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces and model.trainer_spec.byte_fallback):
            raise ValueError("only models with identity normalisation, a dummy prefix and byte fallback are supported")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == p.NORMAL}
        self.n = len(model.pieces)
        self.byte_ids = np.zeros(256, np.int32)
        self.text = [b""] * self.n
        for i, p in enumerate(model.pieces):
            if p.type == p.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.text[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == p.NORMAL:
                self.text[i] = p.piece.replace(SPACE, " ").encode()
        scores = sorted({model.pieces[i].score for i in normal.values()}, reverse=True)
        level = {s: k for k, s in enumerate(scores)}
        rank = {i: level[model.pieces[i].score] for i in normal.values()}
        symbol = lambda s: normal.get(s, self.n + ord(s) if len(s) == 1 else None)
        pairs, unsafe = {}, set()
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (rank[i], i)
                    unsafe.update(x for x in (left, right) if x < self.n and rank[i] <= rank[x])
        keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([*(pairs[k][0] for k in keys.tolist()), NONE], np.int32)
        self.made = np.array([*(pairs[k][1] for k in keys.tolist()), 0], np.int32)
        self.tables = []  # (multiplier, slots' keys, slots' places): the first holds most keys, the next those that found their slot taken
        left = np.arange(len(keys))
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
            slot = self.slots(keys[left], factor)
            _, first = np.unique(slot, return_index=True)
            held, place = np.full(1 << 19, -1, np.int64), np.full(1 << 19, len(keys), np.int32)
            held[slot[first]], place[slot[first]] = keys[left[first]], left[first]
            self.tables.append((factor, held, place))
            left = np.delete(left, first)
            if not len(left):
                break
        if len(left):
            raise ValueError("the vocabulary has too many pairs for these tables")
        self.unsafe = np.zeros(self.n, bool)
        self.unsafe[list(unsafe)] = True
        chars = {ord(s.replace(SPACE, " ")): i for s, i in normal.items() if len(s) == 1}
        self.char_ids = np.arange(0x110000, dtype=np.int64) + self.n
        self.char_ids[list(chars)] = list(chars.values())
        self.joined = np.zeros((256, 256), bool)  # bytes that some piece holds side by side
        for t in self.text:
            b = np.frombuffer(t, np.uint8)
            self.joined[b[:-1], b[1:]] = True
        self.joined[:, 0x80:0xC0] = True  # inside a character

    def units(self, buf: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where units begin, in texts that each end in a separator that begins a unit too."""
        cut = np.ones(len(buf), bool)
        cut[1:] = ~self.joined[buf[:-1], buf[1:]]
        cut[begins[:-1]] = True
        cut[begins[1:] - 1] = True
        return np.flatnonzero(cut)

    def merged(self, flat: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units whose bytes stand in flat, one after the other, and the offset of each unit's first id."""
        b = np.frombuffer(flat, np.uint8)
        heads = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
        ends = np.cumsum(lengths)
        count = heads[ends] - heads[ends - lengths]
        cps = np.frombuffer(flat.decode().encode("utf-32-le"), np.uint32)
        sym = self.char_ids[cps]
        unit = np.repeat(np.arange(len(lengths), dtype=np.int32), count)
        rank, made = self.looked_up(sym, unit, np.arange(len(sym)))
        done_sym, done_unit = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            sizes = np.diff(np.append(starts, len(unit)))
            best = np.minimum.reduceat(rank, starts)
            over = np.repeat(best == NONE, sizes)
            if over.any():
                done_sym.append(sym[over])
                done_unit.append(unit[over])
                keep = ~over
                sym, unit, rank, made = sym[keep], unit[keep], rank[keep], made[keep]
                if not len(sym):
                    break
                sizes, best = sizes[best != NONE], best[best != NONE]
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            fresh = np.concatenate([[True], hits[1:] != hits[:-1] + 1])
            place = np.arange(len(hits))
            place -= place[fresh][np.cumsum(fresh) - 1]
            first = np.concatenate([[True], unit[hits[1:]] != unit[hits[:-1]]])
            hits = hits[(place % 2 == 0) & (first | ~self.unsafe[made[hits]])]
            sym[hits] = made[hits]
            keep = np.ones(len(sym), bool)
            keep[hits + 1] = False
            hits = (np.cumsum(keep) - 1)[hits]
            sym, unit, rank, made = sym[keep], unit[keep], rank[keep], made[keep]
            near = np.zeros(len(sym), bool)
            near[hits] = True
            near[hits[hits > 0] - 1] = True
            again = np.flatnonzero(near)
            rank[again], made[again] = self.looked_up(sym, unit, again)
        sym, unit = np.concatenate(done_sym or [np.zeros(0, np.int64)]), np.concatenate(done_unit or [np.zeros(0, np.int32)])
        order = np.argsort(unit, kind="stable")
        sym, unit = sym[order], unit[order]
        if len(rare := np.flatnonzero(sym >= self.n)):  # characters without a piece: their bytes
            spelled = [chr(c).encode() for c in (sym[rare] - self.n).tolist()]
            size = np.ones(len(sym), np.int64)
            size[rare] = [len(x) for x in spelled]
            at = np.concatenate([[0], np.cumsum(size)])
            sym, unit = np.repeat(sym, size), np.repeat(unit, size)
            at = at[rare]
            more = np.repeat(at - np.concatenate([[0], np.cumsum(size[rare])[:-1]]), size[rare]) + np.arange(size[rare].sum())
            sym[more] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return sym.astype(np.int32), np.searchsorted(unit, np.arange(len(lengths) + 1))

    @staticmethod
    def slots(key: np.ndarray, factor: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(factor)) >> np.uint64(45)).astype(np.int64)

    def looked_up(self, sym: np.ndarray, unit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the pair that begins at each place; NONE at a unit's end."""
        place = np.full(len(at), len(self.ranks) - 1, np.int32)
        todo = np.flatnonzero(at < len(sym) - 1)
        todo = todo[unit[at[todo]] == unit[at[todo] + 1]]
        key = sym[at[todo]] << 32 | sym[at[todo] + 1]
        for factor, held, where in self.tables:
            slot = self.slots(key, factor)
            found = held[slot] == key
            place[todo[found]] = where[slot[found]]
            todo, key = todo[~found], key[~found]
        return self.ranks[place], self.made[place]

    def encoded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offset of each text's first id (with a last entry)."""
        texts = [b" " + t.replace(SPACE.encode(), b" ") if t else b"" for t in texts]
        buf, begins = buffer_of(texts)
        starts = self.units(buf, begins)
        ends = np.append(starts[1:], len(buf))
        real = np.ones(len(starts), bool)
        real[np.searchsorted(starts, begins[1:] - 1)] = False  # the separators
        starts, ends = starts[real], ends[real]
        first, inverse = distinct_spans(buf, starts, ends)
        s, length = starts[first], (ends - starts)[first]
        where = np.repeat(s - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum()) if len(s) else np.zeros(0, np.int64)
        ids, offs = self.merged(buf[where].tobytes(), length)
        n = np.diff(offs)[inverse]
        total = np.concatenate([[0], np.cumsum(n)])
        spread = np.repeat(offs[:-1][inverse] - total[:-1], n) + np.arange(total[-1])
        return ids[spread], total[np.searchsorted(starts, begins)]

    def decoded(self, ids: np.ndarray, offs: np.ndarray) -> list[str]:
        """Text of each list of ids: pieces side by side, without the space that encoding put first."""
        out = []
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            raw = b"".join(map(self.text.__getitem__, ids[a:b].tolist()))
            out.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace"))
        return out


@lru_cache(4)
def loaded(path: str | None) -> Pieces:
    """Once per worker process; the vocabulary file lies beside the library on every machine."""
    import public_tokenizers

    return Pieces(path or public_tokenizers.path(MODEL))


def encode(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Adds `ids` (array of int) and `decoded` (the text that those ids decode to); a column of either name is replaced."""
    small_batches(df.sparkSession)
    df = df.drop("ids", "decoded")
    names = df.columns

    def run(batches):
        model = loaded(path)
        for batch in batches:
            texts = texts_of(batch, text)
            ids, sizes, plain = [], [], []
            for a, b in pieces(texts, 1 << 21):
                i, o = model.encoded(texts[a:b])
                ids.append(i)
                sizes.append(np.diff(o))
                plain += model.decoded(i, o)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            offs = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
            array = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, array, pa.array(plain, pa.string())], names=[*names, "ids", "decoded"])

    schema = StructType([*df.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    return df.mapInArrow(run, schema)


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(documents(spark, sf_dir).select("doc_id", "text"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
