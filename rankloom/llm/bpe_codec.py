"""Operator 5: BPE encoding and decoding with a contiguous rank array.

A short word keeps its part boundaries and the rank of each adjacent pair in two
plain lists; the least rank is found by scanning, its boundary deleted and the
two neighbouring ranks refreshed.  Words over `SHORT` symbols use the heap of
word_bpe instead, so that one endless word does not take quadratic time.

Decoding joins the vocabulary's own strings by one space, which is what the
library does with a file that names no decoder.

Defined cases: a null text encodes to no ids and decodes to ""; rows are
independent; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.word_bpe import Memo, WordBpe, heap_merge, load

SHORT = 400
FAR = 1 << 60


def rank_array(parts: list[int], bpe: WordBpe) -> tuple[list[int], list[int]]:
    """The parts of one word after all merges, and where each begins; `parts` is consumed."""
    get, joined = bpe.ranks.get, bpe.joined
    bounds = list(range(len(parts)))
    near = [get(a << 20 | b, FAR) for a, b in zip(parts, parts[1:])]
    while near:
        least = min(near)
        if least == FAR:
            break
        i = near.index(least)
        del bounds[i + 1], parts[i + 1], near[i]
        parts[i] = s = joined[least]
        if i < len(near):
            near[i] = get(s << 20 | parts[i + 1], FAR)
        if i:
            near[i - 1] = get(parts[i - 1] << 20 | s, FAR)
    return parts, bounds


class Codec:
    def __init__(self, path: str):
        bpe = self.bpe = load(path)

        def piece_ids(piece: str) -> tuple[int, ...]:
            symbols = bpe.symbols(piece)
            return tuple(rank_array(symbols, bpe)[0] if len(symbols) <= SHORT else [s for s in heap_merge(symbols, bpe)[1] if s >= 0])

        by_piece = Memo(piece_ids)

        def chunk(chunk: bytes) -> tuple[bytes, str]:
            ids = [i for piece, special in bpe.parts(chunk) for i in ((special,) if piece is None else by_piece[piece])]
            return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)

        self.by_chunk = Memo(chunk)

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join([self.by_chunk[c][0] for c in text.split()])

    def decode(self, ids) -> str:
        name = self.bpe.name
        return " ".join([name[i] for i in ids])

    def both(self, text: bytes) -> tuple[bytes, str]:
        got = [self.by_chunk[c] for c in text.split()]
        return b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[0]])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids (binary, little-endian uint32) and decoded text."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        codec = Codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                got = [codec.both(t.as_buffer().to_pybytes()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """What is compared of an encoding: counts and SHA-256 digests."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def with_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with n_tokens and token_ids (array<int>) beside them.

    The text column is kept as it is; clashing columns of those names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_tokens", "token_ids")]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    at = docs.columns.index(text_col)

    def run(batches):
        codec = Codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = [codec.encode(t.encode() if t else b"") for t in part.column(at).to_pylist()]
                flat = pa.Array.from_buffers(pa.int32(), sum(map(len, ids)) // 4, [None, pa.py_buffer(b"".join(ids))])
                ends = [0]
                for x in ids:
                    ends.append(ends[-1] + len(x) // 4)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, counts, lists], [*part.schema.names, "n_tokens", "token_ids"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(run, schema)
