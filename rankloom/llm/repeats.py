"""Repeated windows of a fixed length: the distributed part of operators 2 and 7.

The steps are told in anchors.py.  What differs between the operators is given by
`Units` (how a text becomes units, and a run becomes bytes) and by the function that
finds, inside one group of runs with the same anchor, where each window occurs first.

An anchor is the shortest prefix by which suffixes are dealt out.  A group of more than
`CHUNK_BYTES` is dealt out further, to chunks of about that many bytes; each chunk is
solved like a whole group, and the firsts of its windows are then met with those that
other chunks of the group have for the same window (by 128-bit digests).

Inside a block a row is known by its number among the block's different (doc_id, text),
so rows that share a doc_id, or have none, keep their own spans.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.anchors import Anchors, blocks, recurring, short_key, slabs, told
from rankloom.llm.store import written

CHUNK_BYTES = 1 << 19  # bytes of runs and of their occurrences that are solved at once
GATHERED = 1_000  # documents whose spans a task gathers before it gives them out
LAST = (1 << 63) - 1  # stands for a null doc_id: after all others

RUNS = "h long, cid long, run binary, block int, docs binary, rows binary, places binary"
SPANS = "block int, row int, spans binary"


class Units:
    """How a slab of texts is cut. Subclasses: words and bytes."""

    k: int
    length: int

    def cut(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, object]:
        """(hash of the k-gram at each unit, first unit of each document and the total, what `run` needs)."""
        raise NotImplementedError

    def run(self, own, first: int, last: int) -> bytes:
        """The units of windows first..last as bytes."""
        raise NotImplementedError

    def windows(self, run: bytes) -> list[bytes]:
        """The windows of a run, in order."""
        raise NotImplementedError


def table_of(schema: str, columns: list) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    names = [c.split() for c in schema.split(", ")]
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(names, columns)})


def _numbered(docs: pa.Table) -> tuple[list[tuple], list[tuple]]:
    """(every row as (id, text), the different ones in order): a row's number is its place in the second."""
    rows = [(LAST if i is None else i, t) for i, t in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist())]
    return rows, sorted(set(rows))


def _runs_of(units: Units):
    def keys_of(ids, texts):
        for _, part in slabs(ids, texts):
            grams, starts, _ = units.cut(part)
            yield Anchors(grams, starts, units.k, units.length).key

    def runs(docs: pa.Table, flags: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return table_of(RUNS, [[]] * 7)
        block = docs.column("block")[0].as_py()
        _, rows = _numbered(docs)
        numbers, texts = list(range(len(rows))), [t for _, t in rows]
        recurs = told(flags)
        found = list(keys_of(numbers, texts))
        every = np.unique(short_key(np.concatenate(found))) if found else np.zeros(0, np.uint64)
        out: dict[tuple, tuple] = {}
        for own_rows, part in slabs(numbers, texts):
            grams, starts, own = units.cut(part)
            a = Anchors(grams, starts, units.k, units.length)
            hit = np.flatnonzero(recurs[np.searchsorted(every, short_key(a.key))])
            keys, doc, first = a.key[hit].view(np.int64).tolist(), a.doc[hit], a.first[hit]
            places = (first - starts[doc]).tolist()
            for key, d, at, lo, hi, place in zip(keys, doc.tolist(), a.at[hit].tolist(), first.tolist(), a.last[hit].tolist(), places):
                run = units.run(own, lo, hi)
                name = (key, run, at - lo)
                seen = out.get(name)
                if seen is None:
                    out[name] = ([own_rows[d]], [place])
                else:
                    seen[0].append(own_rows[d])
                    seen[1].append(place)
        given = [
            (key, struct.unpack("<q", hashlib.blake2b(run + off.to_bytes(4, "little"), digest_size=8).digest())[0], run, block, array("q", [rows[r][0] for r in own]).tobytes(), array("i", own).tobytes(), array("i", places).tobytes())
            for (key, run, off), (own, places) in out.items()
        ]
        return table_of(RUNS, list(zip(*given)) if given else [[]] * 7)

    return keys_of, runs


def _groups(batches, n_keys: int):
    """(key, rows) of one key after another out of batches sorted by their first n_keys columns."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:n_keys] != now and rows:
                yield now, rows
                rows = []
            now = row[:n_keys]
            rows.append(row[n_keys:])
    if rows:
        yield now, rows


class _Spans:
    """Spans gathered by block and row, given out as batches."""

    def __init__(self, within: bool):
        self.within, self.found = within, {}

    def add(self, firsts: list[tuple], block: int, docs: bytes, rows: bytes, places: bytes) -> None:
        """firsts: first (doc, place) of each window of a run; docs, rows and places: where the run stands."""
        some = [f[0] for f in firsts]
        least, most, n = min(some), max(some), len(firsts)
        d0, p0 = firsts[0]
        plain = least == most and all(p == p0 + o for o, (_, p) in enumerate(firsts))  # the run as a whole has one first place
        for doc, row, at in zip(array("q", docs), array("i", rows), array("i", places)):
            if least > doc or least == doc and not self.within or plain and doc == d0 and at <= p0:
                continue
            out = self.found.setdefault((block, row), array("i"))
            if most < doc or plain:
                out.extend((at, at + n - 1))
                continue
            lo = -1
            for o, (d, p) in enumerate(firsts):
                if d < doc or self.within and d == doc and p < at + o:
                    lo = o if lo < 0 else lo
                elif lo >= 0:
                    out.extend((at + lo, at + o - 1))
                    lo = -1
            if lo >= 0:
                out.extend((at + lo, at + n - 1))

    def batches(self, least: int = 0):
        if len(self.found) > least:
            rows = [(block, row, spans.tobytes()) for (block, row), spans in self.found.items() if spans]
            self.found = {}
            yield from table_of(SPANS, list(zip(*rows)) if rows else [[]] * 3).to_batches()


def _firsts(rows: list[tuple], solve: Callable) -> dict[int, tuple]:
    """{cid: (run, first (doc, place) of each of its windows)} of the rows of a group or chunk."""
    runs: dict[int, list] = {}
    for cid, run, _, docs, _, places in rows:
        own = struct.unpack_from("<q", docs)[0], struct.unpack_from("<i", places)[0]
        k = 1  # rows come by id; those that share the least one each have a place of their own
        while docs[8 * k : 8 * k + 8] == docs[:8]:
            own = min(own, (own[0], struct.unpack_from("<i", places, 4 * k)[0]))
            k += 1
        got = runs.setdefault(cid, [run, own])
        got[1] = min(got[1], own)
    return {cid: (runs[cid][0], found) for cid, found in zip(runs, solve([(run, own) for run, own in runs.values()]))}


def _digest(window: bytes) -> bytes:
    return hashlib.blake2b(window, digest_size=16).digest()


def _later_windows(runs: DataFrame, units: Units, solve: Callable, within: bool, chunk_bytes: int) -> DataFrame:
    """SPANS: the windows of each row that also start earlier."""
    size = F.octet_length("run") + F.octet_length("docs") + F.octet_length("rows") + F.octet_length("places")
    large = runs.groupBy("h").agg(F.sum(size).alias("n")).where(F.col("n") > chunk_bytes).select("h", F.ceil(F.col("n") / chunk_bytes).alias("k"))
    large = written(large, "large")
    n_large = large.count()
    sent = F.broadcast(large) if n_large <= 100_000 else large

    def solved(batches):
        spans = _Spans(within)
        for _, rows in _groups(batches, 1):
            firsts = _firsts(rows, solve)
            for cid, _, *where in rows:
                spans.add(firsts[cid][1], *where)
            yield from spans.batches(GATHERED)
        yield from spans.batches()

    whole = runs.join(sent, "h", "left_anti") if n_large else runs
    out = whole.repartition("h").sortWithinPartitions("h").mapInArrow(solved, SPANS)
    if not n_large:
        return out

    def windows(batches):
        for (h, chunk), rows in _groups(batches, 2):
            least = {_digest(w): f for run, found in _firsts(rows, solve).values() for w, f in zip(units.windows(run), found)}
            yield from table_of("h long, chunk int, w binary, d long, p long", list(zip(*[(h, chunk, w, d, p) for w, (d, p) in least.items()]))).to_batches()

    def met(rows: pa.Table, others: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return table_of(SPANS, [[]] * 3)
        least = dict(zip(others.column("w").to_pylist(), zip(others.column("d").to_pylist(), others.column("p").to_pylist())))
        rows = list(zip(*[rows.column(c).to_pylist() for c in ("cid", "run", "block", "docs", "rows", "places")]))
        firsts = {cid: [min(f, least.get(_digest(w), f)) for w, f in zip(units.windows(run), found)] for cid, (run, found) in _firsts(rows, solve).items()}
        spans = _Spans(within)
        for cid, _, *where in rows:
            spans.add(firsts[cid], *where)
        return pa.Table.from_batches(list(spans.batches())) if spans.found else table_of(SPANS, [[]] * 3)

    chunked = runs.join(sent, "h").select("h", F.pmod("cid", "k").cast("int").alias("chunk"), "cid", "run", "block", "docs", "rows", "places")
    split = written(chunked.repartition("h", "chunk").sortWithinPartitions("h", "chunk").mapInArrow(windows, "h long, chunk int, w binary, d long, p long"), "windows")
    shared = split.groupBy("h", "w").agg(F.min(F.struct("d", "p")).alias("f"), F.count("*").alias("n")).where("n > 1").select("h", "w", "f.d", "f.p")
    others = split.select("h", "chunk", "w").join(shared, ["h", "w"])
    return out.unionByName(chunked.groupBy("h", "chunk").cogroup(others.groupBy("h", "chunk")).applyInArrow(met, SPANS))


def repeated_windows(docs: DataFrame, units: Units, solve: Callable, within: bool, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(keyed documents, SPANS): windows of each row that also start earlier.

    Earlier means in a document with a smaller id, or with `within` also at a smaller
    place of the same document.  spans: little-endian int32 pairs, first and last window.
    """
    keyed, n = blocks(docs)
    keys_of, runs_of = _runs_of(units)
    flags = recurring(keyed, keys_of, n)
    runs = written(keyed.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(runs_of, RUNS), "runs")
    return keyed, _later_windows(runs, units, solve, within, chunk_bytes)


def covered(spans: list[bytes], n: int, length: int) -> np.ndarray:
    """Which of n units lie in a window of the spans."""
    turn = np.zeros(n + 1, np.int32)
    for s in spans:
        pair = np.frombuffer(s, "<i4").reshape(-1, 2)
        np.add.at(turn, pair[:, 0], 1)
        np.add.at(turn, np.minimum(pair[:, 1] + length, n), -1)
    return np.cumsum(turn[:n]) > 0


def applied(keyed: DataFrame, found: DataFrame, give: Callable, schema: str | T.StructType) -> DataFrame:
    """give(id, text, spans) for every document, beside its spans."""

    def both(docs: pa.Table, spans: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        for row, s in zip(spans.column("row").to_pylist(), spans.column("spans").to_pylist()):
            by.setdefault(row, []).append(s)
        rows, different = _numbered(docs)
        number = {row: i for i, row in enumerate(different)}
        out = [give(i, t, by.get(number[row], [])) for i, t, row in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), rows)]
        return table_of(schema, list(zip(*out)) if out else [[]] * len(schema.split(", ")))

    return keyed.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(both, schema)
