"""Operator 2: substring dedup with prefix-partitioned suffix trees over words.

Suffixes are dealt to groups by a prefix of variable length: the words of their anchor
(see anchors.py), and where such a group would not fit in memory, chunks of it
(repeats.py).  In a group the suffixes of the runs are sorted, the common prefixes of
neighbours give the internal nodes of the group's suffix tree, and the nodes of 13 words
or more are its repeats.  Below the topmost of those nodes the window is the same; its
least doc_id is kept and the window is removed from every document after it.

Leaves that stand for equal runs of words are merged before they are sent.

Defined cases: null and empty texts have no words; texts under 13 words keep all; of
rows that share a doc_id none is before the other, so they do not remove each other's
words, and each has spans of its own; null doc_ids are one such id, after all others; empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.anchors import stretch_hashes
from rankloom.llm.repeats import CHUNK_BYTES, Units, applied, covered, repeated_windows
from rankloom.llm.suffix_arrays import common_prefix

WINDOW = 13
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(values, starts, ends of words, first word of each text and the total, bytes) of the texts laid end to end."""
    whole = b"\n".join(texts) + b"\n"
    values = np.frombuffer(whole, np.uint8)
    turn = np.diff(np.r_[True, SPACE[values]].astype(np.int8))
    starts, ends = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return values, starts, ends, np.r_[np.searchsorted(starts, begins[:-1]), len(starts)], whole


class Words(Units):
    def __init__(self, length: int = WINDOW, k: int = 5):
        self.length, self.k = length, min(k, length)

    def cut(self, texts):
        values, starts, ends, docs, whole = word_bounds(texts)
        words = stretch_hashes(values, starts, ends)
        at = np.arange(max(0, len(words) - self.k + 1))
        return stretch_hashes(words, at, at + self.k), docs, (whole, starts, ends)

    def run(self, own, first, last):
        whole, starts, ends = own
        return b" ".join(whole[starts[first] : ends[last + self.length - 1]].split())

    def windows(self, run):
        words = run.split(b" ")
        return [b" ".join(words[o : o + self.length]) for o in range(len(words) - self.length + 1)]


def internal_nodes(common: list[int]) -> list[tuple[int, int, int]]:
    """(depth, first leaf, end of leaves) of the internal nodes of the tree of sorted suffixes, children before parents.

    common[i]: common prefix of suffixes i - 1 and i.
    """
    out, stack = [], [(0, 0)]  # (depth, first leaf) of the open nodes
    for i in range(1, len(common) + 1):
        depth, first = common[i] if i < len(common) else 0, i - 1
        while stack[-1][0] > depth:
            deep, first = stack.pop()
            out.append((deep, first, i))
        if stack[-1][0] < depth:
            stack.append((depth, first))
    return [*out, (0, 0, len(common))]


def solver(length: int):
    def solve(runs: list[tuple[bytes, tuple]]) -> list[list[tuple]]:
        """For each run the first occurrence of each of its windows."""
        firsts, suffixes = [], []
        for r, (run, (d, p)) in enumerate(runs):
            count = run.count(b" ") + 2 - length
            firsts.append([(d, p + o) for o in range(count)])
            if len(runs) > 1:
                text, at = run + b" ", 0  # a space ends every word, so that words are told from longer ones
                for o in range(count):
                    suffixes.append((text[at:], r, o))
                    at = text.index(b" ", at) + 1
        if len(runs) == 1:
            return firsts
        suffixes.sort()
        bytes_common = [0, *[common_prefix(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])]]
        depths = [s[0].count(b" ", 0, n) for s, n in zip(suffixes, bytes_common)]  # whole words in common
        for depth, lo, hi in internal_nodes(depths):
            if depth >= length:  # a parent of that depth comes after its children and holds their leaves
                least = min(firsts[r][o] for _, r, o in suffixes[lo:hi])
                for _, r, o in suffixes[lo:hi]:
                    firsts[r][o] = least
        return firsts

    return solve


def dedup(docs: DataFrame, length: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row."""
    units = Words(length)
    keyed, found = repeated_windows(docs, units, solver(length), within=False, chunk_bytes=chunk_bytes)

    def give(doc_id, text, spans):
        words = text.split()
        if not spans:
            return doc_id, len(words), 0, b" ".join(words).decode("utf-8", "replace")
        gone = covered(spans, len(words), length)
        kept = [w for w, g in zip(words, gone.tolist()) if not g]
        return doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace")

    return applied(keyed, found, give, "doc_id long, n_words long, n_removed long, kept string")


def digests(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' '))) AS k FROM d WHERE len(w) >= 13),
c AS (SELECT r, i, doc_id > min(doc_id) OVER (PARTITION BY k) AS later FROM g),
l AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 13 AS joined FROM c WHERE later),
s AS (SELECT r, i, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM l),
u AS (SELECT r, min(i) AS lo, max(i) + 13 AS hi FROM s GROUP BY r, run),
p AS (SELECT r, lo, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 1) AS before, hi FROM u),
k AS (SELECT d.r, sum(hi - lo) AS n, flatten(list(w[before:lo - 1] ORDER BY lo)) AS head, max(hi) AS rest FROM p JOIN d USING (r) GROUP BY d.r)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(array_to_string(list_concat(coalesce(head, []), w[coalesce(rest, 1):]), ' ')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
