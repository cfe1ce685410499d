"""Skylines and k-skybands by partitioned sort-filter passes.

A row dominates another of its group if it is at least as good in every measure and
better in one.  Its k-skyband are the rows that fewer than k others dominate (k = 1: the
skyline): under any score that does not fall when a measure rises, the k best rows are
among them.

Groups are dealt into chunks of bounded size.  A row that k others of its chunk dominate
goes; the survivors of `FAN` chunks form the next chunk, until one chunk a group is left.
Nothing is lost by that: of the rows that dominate a row, the k best-placed survive their
own chunks.  Inside a chunk rows are sorted so that whoever dominates comes first, and
each row is compared with the survivors before it only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.store import written

CHUNK_ROWS = 20_000
FAN = 16
BLOCK = 128  # rows that are compared with the survivors at a time


def band(x: np.ndarray, k: int, margin: float = 0.0) -> np.ndarray:
    """Indexes, in order, of the rows of x that fewer than k rows dominate; larger is better.

    Better in one measure means by more than `margin`.
    """
    if not len(x):
        return np.zeros(0, np.int64)
    total = x.sum(1)
    order = np.lexsort([*(-x.T[::-1]), -total])
    kept = np.empty((0, x.shape[1]))
    alive = []
    for lo in range(0, len(order), BLOCK):
        rows = order[lo : lo + BLOCK]
        new = x[rows]
        over = _dominating(kept, new, margin).sum(0)
        own = _dominating(new, new, margin)
        live = np.ones(len(rows), bool)
        for i in range(len(rows)):  # dominators stand before what they dominate
            live[i] = over[i] + np.count_nonzero(own[:i, i] & live[:i]) < k
        alive.append(rows[live])
        kept = np.concatenate([kept, new[live]])
    return np.sort(np.concatenate(alive))


def loose_front(x: np.ndarray, margin: float) -> np.ndarray:
    """Indexes of the rows that no row dominates when as good means by no more than `margin` worse."""
    stay = []
    for lo in range(0, len(x), BLOCK):
        some = x[lo : lo + BLOCK]
        as_good, better = np.ones((len(x), len(some)), bool), np.zeros((len(x), len(some)), bool)
        for u, v in zip(x.T, some.T):
            as_good &= u[:, None] >= v[None, :] - margin
            better |= u[:, None] > v[None, :] + margin
        stay.append(lo + np.flatnonzero(~(as_good & better).any(0)))
    return np.concatenate(stay) if stay else np.zeros(0, np.int64)


def _dominating(a: np.ndarray, b: np.ndarray, margin: float) -> np.ndarray:
    """Whether row i of a dominates row j of b."""
    as_good = np.ones((len(a), len(b)), bool)
    better = np.zeros((len(a), len(b)), bool)
    for u, v in zip(a.T, b.T):  # measure by measure: no array of rows x rows x measures
        as_good &= u[:, None] >= v[None, :]
        better |= u[:, None] > v[None, :] + margin
    return as_good & better


def _measures(table: pa.Table, better: list[str], ties: list[tuple[str, str]]) -> np.ndarray:
    """The measures as a matrix; with ties, the place in their order is one more."""
    columns = [np.nan_to_num(table.column(c).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf) for c in better]
    if ties:
        place = np.empty(table.num_rows)
        # Nulls come last; what is equal in all ties stands in one place.
        order = pa.compute.sort_indices(table, sort_keys=ties, null_placement="at_end").to_numpy()
        keys = table.select([c for c, _ in ties]).take(order)
        differs = np.zeros(table.num_rows, bool)
        for c in keys.column_names:
            codes = keys.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            differs[1:] |= codes[1:] != codes[:-1]
        place[order] = np.cumsum(differs)
        columns.append(-place)
    return np.stack(columns, 1) if table.num_rows else np.zeros((0, len(columns)))


def chunks(batches, keys: list[str]):
    """Tables of equal keys, one after another, out of batches sorted by them."""
    now, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns))
        cuts = [0, *[i for i in range(1, len(rows)) if rows[i] != rows[i - 1]], len(rows)]
        for lo, hi in zip(cuts, cuts[1:]):
            if rows[lo] != now and parts:
                yield pa.Table.from_batches(parts)
                parts = []
            now = rows[lo]
            parts.append(batch.slice(lo, hi - lo))
    if parts:
        yield pa.Table.from_batches(parts)


def skyband(rows: DataFrame, by: list[str], better: list[str], k: int = 1, ties: list[tuple[str, str]] | None = None, margin: float = 0.0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The rows of each group that fewer than k rows of it dominate.

    `ties`, as (column, "ascending" or "descending"), is the order among equal scores: who
    comes later in it does not dominate.  A missing measure is the worst.  With a `margin`,
    for skylines, as good means by no more than it worse and better by more than it; that is
    no order, so first whoever is dominated without the former goes, which loses no one who
    dominates a row that stays, and the rest is compared once more.
    """
    if margin and k != 1:
        raise ValueError("a margin is for skylines, k = 1")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    n_chunks = max(1, -(-sizes // chunk_rows))
    keys = [*by, "_chunk"]
    now = rows.withColumn("_chunk", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if c not in by]), F.lit(n_chunks)).cast("int"))

    def run(batches, last):
        for table in chunks(batches, keys):
            x = _measures(table, better, ties or [])
            stay = band(x, k, margin)
            if margin and last:
                stay = stay[loose_front(x[stay], margin)]
            yield from table.take(pa.array(stay)).combine_chunks().to_batches()

    while True:
        last = n_chunks == 1
        now = now.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches, last=last: run(batches, last), now.schema)
        if n_chunks == 1:
            return now.drop("_chunk")
        n_chunks = -(-n_chunks // FAN)
        now = written(now.withColumn("_chunk", F.floor(F.col("_chunk") / FAN).cast("int")), "skyband")
