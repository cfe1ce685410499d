"""What the substring operators share: blocks, anchors, and finding anchors that recur.

Both operators look for windows of a fixed length L (13 words, 100 bytes) that occur
more than once.  Shipping every window would move many times the input, so windows are
grouped by an *anchor*: the least-hashed k-gram inside the window, leftmost of equals.
Equal windows have equal anchors at equal offsets, so all that can match meets in the
group of one anchor, and there is an anchor only every few windows.

1. Documents are dealt to blocks; a block sends the sorted hashes of its anchors to
   buckets, packed as differences, and is told for each whether it recurs.
2. For a recurring anchor the block gives its *run*: the text under all windows with
   that anchor, and the offset of the anchor in it.

Hashes only bring candidates together (44 bits are compared in step 1); which windows
are equal is decided on the text itself.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLAB = 1 << 18  # bytes of text that are hashed at a time
BLOCK_DOCS = 4_000  # documents of a block, about
BLOCK_BYTES = 16_000_000  # bytes of text of a block, about
ODD = np.uint64(0x9E3779B97F4A7C15)
PLACE = 20  # bits of a position inside one minimum search
KEY_BITS = 44


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD ** i and its inverse modulo 2 ** 64, for i < n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 2 * SLAB)
        inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
        for name, base in (("up", ODD), ("down", inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def stretch_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def minimum_places(h: np.ndarray, w: int) -> np.ndarray:
    """For each i <= len(h) - w the place of the least of h[i:i+w], leftmost of equals (by the top 44 bits)."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    most = (1 << PLACE) - w
    low = np.uint64((1 << PLACE) - 1)
    for lo in range(0, n, most):
        m = min(most, n - lo)
        key = (h[lo : lo + m + w - 1] & ~low) | np.arange(m + w - 1, dtype=np.uint64)
        span = 1
        while 2 * span <= w:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < w:
            key = np.minimum(key[: m], key[w - span : w - span + m])
        out[lo : lo + m] = (key[:m] & low).astype(np.int64) + lo
    return out


class Anchors:
    """Anchors of one slab: parallel arrays.

    doc: index of the document in the slab; key: hash of the k-gram; at: its place;
    first, last: the windows that have it (all in slab units).
    """

    def __init__(self, grams: np.ndarray, doc_starts: np.ndarray, k: int, length: int):
        """grams[i]: hash of the k units from i; doc_starts: first unit of each document, and the number of units."""
        n = int(doc_starts[-1])
        empty = np.zeros(0, np.int64)
        self.doc = self.at = self.first = self.last = empty
        self.key = np.zeros(0, np.uint64)
        if n < length:
            return
        places = minimum_places(grams, length - k + 1)
        window = np.arange(n - length + 1)
        doc = np.searchsorted(doc_starts, window, "right") - 1
        good = window + length <= doc_starts[doc + 1]
        window, doc, places = window[good], doc[good], places[good]
        if not len(window):
            return
        new = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]) | (doc[1:] != doc[:-1])])
        end = np.r_[new[1:], len(window)] - 1
        self.doc, self.at, self.first, self.last = doc[new], places[new], window[new], window[end]
        self.key = grams[self.at]


def slabs(ids: list, texts: list[bytes]):
    """(ids, texts) in runs of about SLAB bytes, whole documents each."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLAB:
            yield ids[lo : i + 1], texts[lo : i + 1]
            lo, size = i + 1, 0
    if lo < len(texts):
        yield ids[lo:], texts[lo:]


def block_count(docs: DataFrame, most_docs: int = BLOCK_DOCS, most_bytes: int = BLOCK_BYTES) -> int:
    """Blocks so that a block holds about most_docs documents and most_bytes of text, whichever is less."""
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return max(6, -(-rows // most_docs), -(-(size or 0) // most_bytes))


def blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs as (block, doc_id, text binary) and the number of blocks, which grows with the table."""
    n = block_count(docs)
    block = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n)).cast("int")
    return docs.select(block.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")), n


def packed(keys: np.ndarray) -> bytes:
    """Sorted 44-bit keys as byte planes of their differences, deflated."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = gaps.view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()
    return zlib.compress(planes, 1)


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(6, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :6] = planes.T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def short_key(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - KEY_BITS)


def recurring(keyed: DataFrame, keys_of, n_blocks: int, counts: bool = False) -> DataFrame:
    """(block, bucket, flags): for the block's sorted distinct keys of that bucket, how often each recurs.

    keys_of(ids, texts) yields the 64-bit keys of a block's slabs.  With counts False a
    flag is 1 if the key occurs twice or more anywhere; with counts True it is 0 for one
    occurrence and else 1 + the binary logarithm of the number, 250 at most.
    """
    n_buckets = n_blocks

    def send(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        found = [k for k in keys_of(table.column("doc_id").to_pylist(), table.column("text").to_pylist()) if len(k)]
        keys, times = np.unique(short_key(np.concatenate(found)), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        cuts = np.searchsorted(keys, bucket_edges(n_buckets))
        rows = [(b, keys[lo:hi], times[lo:hi]) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
        return pa.table(
            {
                "bucket": pa.array([r[0] for r in rows], pa.int32()),
                "block": pa.array([block] * len(rows), pa.int32()),
                "keys": pa.array([packed(r[1]) for r in rows], pa.binary()),
                "times": pa.array([zlib.compress(np.minimum(r[2], 255).astype(np.uint8).tobytes(), 1) for r in rows], pa.binary()),
            }
        )

    def meet(table: pa.Table) -> pa.Table:
        own = [unpacked(x) for x in table.column("keys").to_pylist()]
        times = [np.frombuffer(zlib.decompress(x), np.uint8) for x in table.column("times").to_pylist()]
        every, inverse = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(times), len(every))
        level = np.where(total < 2, 0, np.minimum(250, 1 + np.floor(np.log2(np.maximum(total, 1)))) if counts else 1).astype(np.uint8)
        flags, lo = [], 0
        for k in own:
            flags.append(zlib.compress(level[inverse[lo : lo + len(k)]].tobytes(), 1))
            lo += len(k)
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "flags": pa.array(flags, pa.binary())})

    sent = keyed.groupBy("block").applyInArrow(send, "bucket int, block int, keys binary, times binary")
    return sent.groupBy("bucket").applyInArrow(meet, "block int, bucket int, flags binary")


def bucket_edges(n: int) -> np.ndarray:
    return np.array([((1 << KEY_BITS) * b) // n for b in range(n + 1)], np.uint64)


def told(flags: pa.Table) -> np.ndarray:
    """The flags of a block's sorted distinct keys, in key order."""
    rows = sorted(zip(flags.column("bucket").to_pylist(), flags.column("flags").to_pylist()))
    return np.concatenate([np.frombuffer(zlib.decompress(f), np.uint8) for _, f in rows]) if rows else np.zeros(0, np.uint8)
