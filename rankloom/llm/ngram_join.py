"""Operator 6: n-gram Jaccard join with a prefix tree.

Documents are sets of distinct 5-word shingles; two link when 100 * intersection >=
80 * union.  Equal sets are one node from the start, so copies cost one row each.

* A global order puts rare shingles first (by the binary logarithm of the number of
  sets that hold them, then by hash).  It is found by the packed exchange of
  anchors.recurring, which tells every block how often each of its shingles occurs.
* Two linked sets share a shingle among the first n - ceil(0.8 n) + 1 of each, so sets
  that share such a prefix shingle are brought into one candidate group: each prefix
  shingle ties its sets to the least of them (a star, not all pairs).
* In a group the sets are stored in a trie, frequent shingles first; each set walks the
  trie once, the overlap with a shared path is counted once, and subtrees are pruned
  when the shingles that remain cannot reach the bound, or when all below is already in
  the component of the set.  Groups over a limit are cut into chunks and every pair of
  chunks is a task.

Shingles are compared by 56-bit hashes inside candidate groups.

Defined cases: null and empty texts have an empty set and are linked with nothing;
fewer than five words are one shingle; of repeated rows each gets the same component;
a null doc_id is no component's name unless nothing else is in it; `one_of_each` keeps
one row of a component also where rows share a doc_id or have none; empty tables give
empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.anchors import block_count, mixed, recurring, short_key, slabs, stretch_hashes, told
from rankloom.llm.components import components
from rankloom.llm.spans import fresh
from rankloom.llm.store import written
from rankloom.llm.suffix_trees import word_bounds

SHINGLE = 5
PERCENT = 80
CHUNK_SETS = 1_500
BLOCK_DOCS = 2_000  # sets of a block, about: their shingles take more room than their text
BLOCK_BYTES = 6_000_000  # bytes of text of a block, about
SLICE_ROWS = 500  # rows of a batch that are held as Python objects at a time
HOT_SETS = 1_000  # sets that share one prefix shingle and meet in one task
CHUNK_SHINGLES = 3_000_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BITS = np.uint64((1 << 56) - 1)


def word_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word.

    Each byte is mixed with its place in the word before the sum, since sums of powers, as
    in stretch_hashes, are equal for some pairs of long words under any base.
    """
    at = np.arange(len(values), dtype=np.int64)
    word = np.maximum(np.searchsorted(starts, at, "right") - 1, 0)
    place = (at - starts[word]) if len(starts) else at
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mixed((place.astype(np.uint64) << np.uint64(8)) + values + np.uint64(1)), out=sums[1:])
    return mixed(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slab."""
    values, starts, ends, docs, _ = word_bounds([t.translate(LOWER) for t in texts])
    words = word_hashes(values, starts, ends)
    at = np.arange(max(0, len(words) - SHINGLE + 1))
    grams = stretch_hashes(words, at, at + SHINGLE)
    out = []
    for lo, hi in zip(docs[:-1].tolist(), docs[1:].tolist()):
        if hi - lo >= SHINGLE:
            out.append(np.unique(grams[lo : hi - SHINGLE + 1]))
        elif hi > lo:
            out.append(stretch_hashes(words, np.array([lo]), np.array([hi])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _each(batches, text_at: int):
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE_ROWS):
            rows = batch.slice(lo, SLICE_ROWS)
            texts = [t or b"" for t in rows.column(text_at).to_pylist()]
            for part_ids, part in slabs(rows.column(0).to_pylist(), texts):
                yield part_ids, part, shingle_sets(part)


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, sid): sid names the set, null where it is empty."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                texts = [t or b"" for t in part.column(2).to_pylist()]
                named = [(len(s), set_id(s)) for _, slab in slabs(texts, texts) for s in shingle_sets(slab)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([n for n, _ in named], pa.int64()), pa.array([i for _, i in named], pa.binary())], ["doc_id", "text_hash", "n_shingles", "sid"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, sid binary")


def _keyed(docs: DataFrame) -> tuple[DataFrame, int]:
    """(block, doc_id: the set's name, text): one text for each set that a task meets."""

    def run(batches):
        seen: set[bytes] = set()
        for _, texts, sets in _each(batches, 1):
            rows = []
            for t, s in zip(texts, sets):
                name = set_id(s)
                if name and name not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(name)
                    rows.append((name, t))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "text"])

    n = block_count(docs, BLOCK_DOCS, BLOCK_BYTES)
    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id binary, text binary")
    return named.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("block"), "doc_id", "text"), n


def _distinct(ids: list, texts: list[bytes]) -> tuple[list, list[bytes]]:
    one = dict(zip(ids, texts))
    return list(one), list(one.values())


def _keys_of(ids, texts):
    for _, part in slabs(*_distinct(ids, texts)):
        yield from shingle_sets(part)


SETS = "sid binary, n int, prefix array<bigint>, shingles binary"


def _ordered_sets(docs: pa.Table, flags: pa.Table) -> pa.Table:
    """Sets with a prefix shingle that recurs: their recurring shingles, level in the top byte, in global order."""
    ids, texts = _distinct(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist())
    level = told(flags)
    found = list(_keys_of(ids, texts))
    every = np.unique(short_key(np.concatenate(found))) if found else np.zeros(0, np.uint64)
    rows = []
    for name, s in zip(ids, found):
        own = (level[np.searchsorted(every, short_key(s))].astype(np.uint64) << np.uint64(56)) | (s & BITS)
        own = np.unique(own)
        n = len(s)
        prefix = own[: n - -(-PERCENT * n // 100) + 1]
        prefix = prefix[prefix > BITS]  # level 0 occurs in no other set
        if len(prefix):
            rows.append((name, n, prefix.view(np.int64), own[own > BITS].tobytes()))
    return pa.table(
        {
            "sid": pa.array([r[0] for r in rows], pa.binary()),
            "n": pa.array([r[1] for r in rows], pa.int32()),
            "prefix": pa.array([r[2] for r in rows], pa.list_(pa.int64())),
            "shingles": pa.array([r[3] for r in rows], pa.binary()),
        }
    )


class Trie:
    """Sets as paths; a node is a stretch of a path that all sets below share."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        """sets: ranks, ascending; sizes: true sizes of the sets, never below their lengths. Both sorted by path."""
        self.start, self.depth, self.low, self.high, self.child = [], [], [], [], []
        self.flat: list[np.ndarray] = []
        total = 0
        common = [0]
        for a, b in zip(sets, sets[1:]):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            common.append(int(differ[0]) if len(differ) else m)
        work = [(0, len(sets), 0, -1)]  # sets lo..hi share a path of this depth; parent
        begin, parent, ends = [], [], []
        while work:
            lo, hi, depth, up = work.pop()
            deep = min(common[lo + 1 : hi], default=len(sets[lo]))
            deep = min(deep, len(sets[lo]))
            node = len(begin)
            begin.append(total)
            self.flat.append(sets[lo][depth:deep])
            total += deep - depth
            parent.append(up)
            self.depth.append(deep)
            self.low.append(lo)
            done = lo
            while done < hi and len(sets[done]) == deep:  # sets that end here come first
                done += 1
            ends.append(done)
            self.high.append(hi)
            cuts = [x for x in range(done + 1, hi) if common[x] == deep]
            for a, b in zip([done, *cuts], [*cuts, hi]):
                if a < b:
                    work.append((a, b, deep, node))
        self.flat = np.concatenate(self.flat) if self.flat else np.zeros(0, np.int64)
        self.begin = np.array([*begin, total])
        self.parent = np.array(parent)
        self.depth, self.low, self.high, self.ends = map(np.array, (self.depth, self.low, self.high, ends))
        order = np.argsort(self.parent, kind="stable")
        self.kids, self.kid_from = order, np.searchsorted(self.parent[order], np.arange(len(parent) + 1))
        lengths = np.array([len(s) for s in sets])
        self.least = np.array([sizes[a:b].min() for a, b in zip(self.low, self.high)])
        self.most = np.array([sizes[a:b].max() for a, b in zip(self.low, self.high)])
        self.left = np.array([lengths[a:b].max() for a, b in zip(self.low, self.high)]) - self.depth

    def walk(self, marks: np.ndarray, length: int, size: int, before: int, labels: np.ndarray, own: int):
        """(set, overlap) of the sets before `before` that reach the bound, outside the component `own`."""
        hits = np.concatenate([[0], np.cumsum(marks[self.flat])])
        hits = hits[self.begin[1:]] - hits[self.begin[:-1]]
        turns = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
        nodes, overlap = np.array([0]), np.zeros(1, np.int64)
        while len(nodes):
            overlap = overlap + hits[nodes]
            reach = overlap + np.minimum(length - overlap, self.left[nodes])
            lo, hi = self.low[nodes], np.minimum(self.high[nodes], before)
            good = (lo < before) & ((100 + PERCENT) * reach >= PERCENT * (size + self.least[nodes])) & (100 * self.most[nodes] >= PERCENT * size) & (100 * size >= PERCENT * self.least[nodes])
            good &= ~((labels[lo] == own) & (turns[np.maximum(hi, lo + 1) - 1] == turns[lo]))
            nodes, overlap = nodes[good], overlap[good]
            for node, o in zip(nodes.tolist(), overlap.tolist()):
                for s in range(self.low[node], min(self.ends[node], before)):
                    yield s, o
            begin, end = self.kid_from[nodes], self.kid_from[nodes + 1]
            count = end - begin
            if not count.sum():
                return
            overlap = np.repeat(overlap, count)
            nodes = self.kids[np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]


def trie_join(sets: list[np.ndarray], sizes: list[int], side: list[int] | None = None) -> list[int]:
    """For each set the index of its component's first set.

    sets: shingles in global order.  With `side`, only sets of different sides are compared.
    """
    every, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    ranks, lo = [], 0
    for s in sets:
        ranks.append(np.sort(len(every) - 1 - inverse[lo : lo + len(s)]))
        lo += len(s)
    order = sorted(range(len(sets)), key=lambda i: ranks[i].astype(">u4").tobytes())
    paths, size = [ranks[i] for i in order], np.array([sizes[i] for i in order])
    trie = Trie(paths, size)
    labels = np.arange(len(sets))
    marks = np.zeros(len(every), bool)
    for x, path in enumerate(paths):
        marks[path] = True
        # The walk reads labels as they stand; what it yields is checked against them again.
        for y, overlap in list(trie.walk(marks, len(path), int(size[x]), x, labels, int(labels[x]))):
            if labels[y] != labels[x] and (side is None or side[order[x]] != side[order[y]]) and 100 * overlap >= PERCENT * (size[x] + size[y] - overlap):
                a, b = sorted((int(labels[x]), int(labels[y])))
                labels[labels == b] = a
        marks[path] = False
    out = [0] * len(sets)
    least: dict[int, int] = {}
    for x, i in enumerate(order):
        least[int(labels[x])] = min(least.get(int(labels[x]), i), i)
    for x, i in enumerate(order):
        out[i] = least[int(labels[x])]
    return out


def _joined(batches):
    """(sid, root) within each task key; rows come sorted by key."""
    now, rows = None, []

    def solve():
        if len(rows) < 2:
            return
        sides = [r[3] for r in rows]
        roots = trie_join([np.frombuffer(r[2], np.uint64) for r in rows], [r[1] for r in rows], sides if len(set(sides)) > 1 else None)
        for r, root in zip(rows, roots):
            if rows[root][0] != r[0]:
                yield r[0], rows[root][0]

    out: list = []
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE_ROWS):
            for key, *row in zip(*[c.to_pylist() for c in batch.slice(lo, SLICE_ROWS).columns]):
                if key != now:
                    out += solve()
                    rows = []
                now = key
                rows.append(row)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.binary()) for k in (0, 1)], ["u", "v"])
            out = []
    out += solve()
    yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.binary()) for k in (0, 1)], ["u", "v"])


def _near(prefixes: DataFrame) -> DataFrame:
    """(u, v): ties of all sets that share a prefix shingle to the least of them, by way of the least of a part where many share it."""
    counts = prefixes.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > HOT_SETS)
    hot = written(counts.select("h", F.ceil(F.col("k") / HOT_SETS).alias("parts")), "hot")
    n_hot = hot.count()
    part = F.pmod(F.xxhash64("sid"), F.coalesce("parts", F.lit(1)))
    rows = prefixes.join(F.broadcast(hot) if n_hot <= 100_000 else hot, "h", "left").select("sid", "h", part.alias("part")) if n_hot else prefixes.withColumn("part", F.lit(0).cast("long"))
    centre = written(rows.groupBy("h", "part").agg(F.min("sid").alias("c")), "centres")
    near = rows.join(centre, ["h", "part"]).where("sid <> c").select(F.col("sid").alias("u"), F.col("c").alias("v"))
    first = centre.groupBy("h").agg(F.min("c").alias("v"), F.count("*").alias("n")).where("n > 1").select("h", "v")
    return near.unionByName(centre.join(first, "h").where("c <> v").select(F.col("c").alias("u"), "v")).distinct()


def links(docs: DataFrame, chunk_sets: int = CHUNK_SETS) -> DataFrame:
    """(u, v): links between set names that join every component, and no others."""
    keyed, n = _keyed(docs)
    flags = recurring(keyed, _keys_of, n, counts=True)
    sets = written(keyed.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(_ordered_sets, SETS), "sets")
    groups = components(_near(sets.select("sid", F.explode("prefix").alias("h"))))
    placed = sets.select("sid", "n", "shingles").join(groups.select(F.col("node").alias("sid"), F.col("root").alias("key")), "sid")
    placed = written(placed, "groups")
    load = placed.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / chunk_sets), F.ceil(F.sum(F.octet_length("shingles")) / (8 * CHUNK_SHINGLES))).cast("int").alias("k"))
    large = written(load.where("k > 1"), "large")
    n_large = large.count()
    task = placed.join(F.broadcast(large) if n_large <= 100_000 else large, "key", "left") if n_large else placed.withColumn("k", F.lit(None).cast("int"))
    chunk = F.pmod(F.xxhash64("sid"), F.coalesce("k", F.lit(1))).cast("int")
    task = task.withColumn("side", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)))
    task = task.select(F.concat("key", F.to_binary(F.format_string("%08x%08x", F.least("side", "other"), F.greatest("side", "other")), F.lit("hex"))).alias("key"), "sid", "n", "shingles", "side")
    return task.repartition("key").sortWithinPartitions("key").mapInArrow(_joined, "u binary, v binary")


def _classes(docs: DataFrame, chunk_sets: int) -> tuple[DataFrame, DataFrame]:
    """(members of docs, (sid, root) of every set)."""
    own = written(members(docs), "members")
    roots = components(written(links(docs.select("doc_id", "text"), chunk_sets), "links"))
    sids = own.where("sid is not null").select("sid").distinct()
    return own, sids.join(roots, F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("root", "sid").alias("root"))


def join(docs: DataFrame, chunk_sets: int = CHUNK_SETS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    own, classes = _classes(docs, chunk_sets)
    first = own.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("m"))
    named = first.join(classes, "sid")
    least = named.groupBy("root").agg(F.min("m").alias("component_id"))
    named = named.join(least, "root").select(F.col("sid").alias("_sid"), "component_id")
    return own.join(named, F.col("sid") == F.col("_sid"), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, chunk_sets: int = CHUNK_SETS) -> DataFrame:
    """docs with one row of every component: the least doc_id (null last), of rows that share it the least hash of the text, and of equal rows one.

    Rows without words are in no component and all stay.
    """
    own, classes = _classes(docs, chunk_sets)
    rows = own.where("sid is not null").groupBy("sid", "doc_id", "text_hash").agg(F.count("*").alias("n")).join(classes, "sid")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n")).alias("b"))
    d, t, n = fresh(docs.columns, "_d", "_t", "_n")
    keep = written(best.select(F.col("b.doc_id").alias(d), F.col("b.text_hash").alias(t), F.col("b.n").alias(n)), "kept")
    again = keep.where(F.col(n) > 1)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t))
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    bare = docs.where(wordless)
    if not again.count():
        return docs.where(~wordless).join(keep, same, "left_semi").unionByName(bare)
    once = docs.where(~wordless).join(keep.where(F.col(n) == 1), same, "left_semi")
    # Only rows that have an equal one (by doc_id and text) are told apart by a shuffle of their texts.
    more = docs.where(~wordless).join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(more).unionByName(bare)


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS k FROM d),
t AS (SELECT k, min(doc_id) AS t, len(k) AS n FROM s WHERE len(k) > 0 GROUP BY k),
e AS (SELECT t, n, unnest(k) AS g FROM t),
o AS (SELECT a.t AS a, b.t AS b FROM e AS a JOIN e AS b ON a.g = b.g AND a.t <> b.t AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.t, b.t, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM o UNION SELECT reach.a, o.b FROM reach JOIN o ON reach.b = o.a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.k) AS BIGINT) AS n_shingles, least(coalesce(t.t, s.doc_id), coalesce(c.least, s.doc_id)) AS component_id
FROM s LEFT JOIN t ON s.k = t.k LEFT JOIN c ON t.t = c.a
"""
