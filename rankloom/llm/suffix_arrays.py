"""Operator 7: byte-level dedup with longest-previous-factor arrays.

Suffixes are grouped by anchor (see anchors.py and repeats.py).  In a group all suffixes
of the runs, to the ends of the runs, are sorted into a suffix array, and the common
prefixes of neighbours are measured.  For each suffix the previous and next smaller
position in suffix order are the best earlier matches, and the longer common prefix of
the two is its longest previous factor.  A suffix whose factor reaches 100 bytes is a
later copy; following the earlier matches leads to the first.  Every byte of a later
copy is removed and the first stays.

Defined cases: null and empty texts are empty; texts under 100 bytes keep all; rows that
share a doc_id are one document for what is earlier (by place only), each with spans of
its own, so an exact repeat of a row removes nothing from it; null doc_ids are one such
id, after all others; empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.anchors import stretch_hashes
from rankloom.llm.repeats import CHUNK_BYTES, Units, applied, covered, repeated_windows

WINDOW = 100


class Bytes(Units):
    def __init__(self, length: int = WINDOW, k: int = 32):
        self.length, self.k = length, min(k, length)

    def cut(self, texts):
        whole = b"".join(texts)
        values = np.frombuffer(whole, np.uint8)
        at = np.arange(max(0, len(values) - self.k + 1))
        return stretch_hashes(values, at, at + self.k), np.cumsum([0] + [len(t) for t in texts]), whole

    def run(self, own, first, last):
        return own[first : last + self.length]

    def windows(self, run):
        return [run[o : o + self.length] for o in range(len(run) - self.length + 1)]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


def previous_factors(places: list, common: list[int]) -> list[tuple[int, int]]:
    """For suffixes in suffix order (index of the earlier match with the longest common prefix, or -1; that length).

    places: position of each suffix; common[i]: common prefix of suffixes i - 1 and i.
    """
    n = len(places)
    match, reach = [-1] * n, [0] * n
    open_, falls = [], []  # suffixes whose next smaller position is not met yet; their common prefix with the one below
    for i in range(n):
        place, lcp = places[i], common[i]
        while open_ and places[open_[-1]] >= place:
            j, below = open_.pop(), falls.pop()
            if lcp > reach[j] and places[j] > place:
                match[j], reach[j] = i, lcp
            if below < lcp:
                lcp = below
        if open_ and lcp:
            match[i], reach[i] = open_[-1], lcp
        open_.append(i)
        falls.append(lcp)
    return list(zip(match, reach))


def solver(length: int):
    def solve(runs: list[tuple[bytes, tuple]]) -> list[list[tuple]]:
        """For each run the first occurrence of each of its windows."""
        firsts = [[(d, p + o) for o in range(len(run) - length + 1)] for run, (d, p) in runs]
        if len(runs) == 1:
            return firsts
        suffixes = [run[o:] for run, _ in runs for o in range(len(run) - length + 1)]
        array = sorted(range(len(suffixes)), key=suffixes.__getitem__)
        ordered = [suffixes[i] for i in array]
        # (doc, place) as one number; whoever is earlier has the smaller one
        own = [(d << 32) + p + o for run, (d, p) in runs for o in range(len(run) - length + 1)]
        places = [own[i] for i in array]
        factors = previous_factors(places, [0, *map(common_prefix, ordered, ordered[1:])])
        later = sorted((place, x) for x, place in enumerate(places) if factors[x][1] >= length)
        if later:
            for _, x in later:  # what a factor refers to is earlier, so it is known
                places[x] = places[factors[x][0]]
            where = [(r, o) for r, (run, _) in enumerate(runs) for o in range(len(run) - length + 1)]
            for _, x in later:
                r, o = where[array[x]]
                firsts[r][o] = places[x] >> 32, places[x] & 0xFFFFFFFF
        return firsts

    return solve


def dedup(docs: DataFrame, length: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) of every row."""
    units = Bytes(length)
    keyed, found = repeated_windows(docs, units, solver(length), within=True, chunk_bytes=chunk_bytes)

    def give(doc_id, text, spans):
        if not spans:
            return doc_id, len(text), 0, 0, text
        gone = covered(spans, len(text), length)
        n_spans = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1))
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        return doc_id, len(text), len(text) - len(kept), n_spans, kept

    return applied(keyed, found, give, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT r, doc_id, i, md5(substr(x, 2 * i - 1, 200)) AS k FROM (SELECT *, unnest(range(1, len(x) // 2 - 98)) AS i FROM d WHERE len(x) >= 200)),
c AS (SELECT r, i, coalesce(doc_id > f.d, f.d IS NOT NULL) OR (doc_id IS NOT DISTINCT FROM f.d AND i > f.i) AS later FROM (SELECT r, doc_id, i, first({'d': doc_id, 'i': i}) OVER (PARTITION BY k ORDER BY doc_id NULLS LAST, i) AS f FROM g)),
l AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 100 AS joined FROM c WHERE later),
s AS (SELECT r, i, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM l),
u AS (SELECT r, min(i) AS lo, max(i) + 100 AS hi FROM s GROUP BY r, run),
p AS (SELECT r, lo, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 1) AS before, hi FROM u),
k AS (SELECT d.r, sum(hi - lo) AS n, count(*) AS spans, string_agg(substr(x, 2 * before - 1, 2 * (lo - before)), '' ORDER BY lo) AS head, max(hi) AS rest FROM p JOIN d USING (r) GROUP BY d.r)
SELECT doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(rest, 1) - 1))) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
