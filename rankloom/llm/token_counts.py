"""Operator 4: token counts by heap-and-linked-list byte-pair merging.

The count of a piece is its initial symbols minus the merges made; no token ids
are produced.  Special strings inside a text count one each, as the tokenizer
library treats them by default.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); rows are
independent, so repeated rows and ties do not matter; an empty table gives an
empty result; only the columns named are read, so others may clash freely.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.word_bpe import Memo, heap_merge, load


def counter(path: str):
    """A function from a text's bytes to its number of tokens."""
    bpe = load(path)

    def piece_count(piece: str) -> int:
        symbols = bpe.symbols(piece)
        return len(symbols) - heap_merge(symbols, bpe)[0]

    by_piece = Memo(piece_count)

    def chunk_count(chunk: bytes) -> int:
        return sum(1 if piece is None else by_piece[piece] for piece, _ in bpe.parts(chunk))

    by_chunk = Memo(chunk_count)
    return lambda text: sum(map(by_chunk.__getitem__, text.split()))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        count = counter(path)
        for batch in batches:
            texts = batch.column(1)
            tokens = pa.array([count(t.as_buffer().to_pybytes()) for t in texts], pa.int64())
            sizes = pa.array([len(t.as_buffer()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, tokens], ["doc_id", "n_bytes", "n_tokens"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    out = narrow.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
