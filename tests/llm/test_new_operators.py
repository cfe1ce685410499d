"""Operators 11 to 13 against brute force, the library and their own definitions."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from rankloom.llm import byte_bpe, centroids, spelling

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VECTORS = "vec_id long, embedding array<float>, label int, cluster int, v string"


# --- operator 11 ---


def brute_clusters(rows, k, rounds, length):
    kept = []
    for vec_id, x in rows:
        if x is None or len(x) != length or any(c is None or not np.isfinite(c) for c in x):
            continue
        f = [float(np.float32(c)) for c in x]
        kept.append((vec_id, [max(-(1 << 27), min(1 << 27, int(np.floor(256 * c)))) for c in f]))
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    heads = [v for _, v in named[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(heads))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        heads = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if n in groups else c for n, c in enumerate(heads)]
    return heads, Counter((i, near(v)[1], near(v)[0]) for i, v in kept) if heads else Counter()


def vectors(seed, n, length):
    rnd = random.Random(seed)
    rows = [(i, [float(rnd.choice([-1, 0, 0.5, 1]) * rnd.choice([1, 3])) for _ in range(length)]) for i in range(n)]  # many ties and equal norms
    rows += [(n, None), (n + 1, [1.0]), (n + 2, [None] * length), (n + 3, [float("nan")] * length), (n + 4, [float("inf")] + [0.0] * (length - 1))]
    return rows + [(None, [0.25] * length), rows[0], rows[0], (n + 5, [1e30] + [-1e30] * (length - 1)), (n + 6, [0.0] * length)]


@pytest.mark.parametrize("length,k,n", [(3, 5, 150), (64, 7, 80), (2, 40, 12)])
def test_annulus_clusters_equal_brute_force(spark, length, k, n):
    rows = vectors(length, n, length)
    table = spark.createDataFrame([(i, x, 0, 7, "z") for i, x in rows], VECTORS).repartition(4)
    got, heads = centroids.clustered(table, k=k, length=length)
    want_heads, want = brute_clusters(rows, k, 5, length)
    assert heads.tolist() == want_heads
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got.collect()) == want


def test_cluster_sums_and_empty_table(spark):
    rows = vectors(5, 40, 64)
    out = centroids.summed(*centroids.clustered(spark.createDataFrame([(i, x, 0, 7, "z") for i, x in rows], VECTORS), k=6)).collect()
    assert len({r.inertia for r in out}) == 1 and out[0].inertia == sum(r.distance for r in out)
    for c in {r.cluster for r in out}:
        own = [r for r in out if r.cluster == c]
        assert {r.cluster_inertia for r in own} == {sum(r.distance for r in own)} and len({r.centroid_sha256 for r in own}) == 1
    empty = centroids.summed(*centroids.clustered(spark.createDataFrame([], VECTORS)))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_the_annulus_leaves_centroids_out_and_loses_none():
    rnd = np.random.default_rng(1)
    heads = np.round(rnd.normal(size=(40, 8)) * rnd.choice([10, 100, 1000], size=(40, 1))).astype(np.int64)
    x = (heads[rnd.integers(0, 40, 500)] + rnd.integers(-3, 4, (500, 8))).astype(np.int64)
    search = centroids.Annulus(heads)
    number, distance, compared = search.nearest(x)
    every = ((x[:, None] - heads[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert compared < 0.3 * every.size


def test_large_components_are_compared_exactly():
    heads = np.array([[1 << 26, 1], [1 << 26, 2], [-(1 << 27), 0]], np.int64)
    x = np.array([[1 << 26, 2], [1 << 26, 1], [1 << 27, 1 << 27]], np.int64)
    number, distance, _ = centroids.Annulus(heads).nearest(x)
    assert number.tolist() == [1, 0, 1] and distance[2] == (1 << 52) + ((1 << 27) - 2) ** 2


# --- operator 12 ---


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [
    None, "", " ", "  \n\n ", "a", "it's we'll I'D", "x  y\t z\n", "\x1c!\x1d a\x1f b", "naïve Straße ŻÓŁĆ", "東京 に 行く", "😀👍🏽 é", "12 345 6789", "<|endoftext|> x",
    " lead　trail ", "z" * 5000, "ab" * 300 + "!" * 400, "\u0000\u0001", " " * 900 + "end", "aaaa" * 30, "don't ’s", "word " * 4000,
]


def test_byte_bpe_equals_the_library(spark):
    rnd = random.Random(3)
    bits = ["the ", "qwrtz", "é", "Übung", " ", "\n", "7", "'s", "-", "ing", "​", "ß "]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 60)))) for i in range(60)]
    rows += [(None, "no id"), (5, "same id"), (5, "same id")]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, word string, ids string").repartition(4)
    enc = library()
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, struct.pack(f"<{len(ids)}I", *ids), enc.decode_bytes(ids)))
    out = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in out) == Counter(want)
    assert all(bytes(r.decoded) == (t or "").encode() for r in out for i, t in rows if i == r.doc_id and i not in (None, 5))
    empty = byte_bpe.digests(byte_bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_fold_and_heap_give_the_same_ids(spark):
    rnd = random.Random(4)
    words = sorted({"".join(rnd.choice("abcdeno est") for _ in range(rnd.randint(1, 90))).encode() for _ in range(60)})
    ranks = byte_bpe.load(RANKS)
    table = spark.createDataFrame([([[ranks.first[b] for b in w] for w in words],)], "words array<array<bigint>>")
    out = table.select(byte_bpe.coded(F.col("words"), ranks).alias("codes")).first().codes
    assert [list(c) for c in out] == [byte_bpe.long_word(w, ranks) for w in words]


def test_what_is_remembered_is_bounded_and_agrees(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 2)
    one, two = byte_bpe.Known(public_tokenizers.PATTERN), byte_bpe.Known(public_tokenizers.PATTERN)
    for text in ("a b c d", "a b,", "e", "", "a b"):
        new = [k.fresh(text)[1] for k in (one, two)]
        assert new[0] == new[1]
        for k in (one, two):
            k.codes |= dict.fromkeys(new[0], True)
    assert set(one.codes) == {"a", " b"}
    for chunk in (" naïve", "x1", "  a", "it's", "東京", " ", "'s"):
        assert one.split(chunk) == one.pattern(chunk)


def test_numbers_that_start_again_and_small_files(spark):
    rnd = random.Random(5)
    texts = ["", "x" * 200 + " end", *(" ".join(rnd.choice(["the", "qwrtz", "a,b", "Übung!", "7", "y" * 120]) for _ in range(rnd.randint(0, 12))) for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(64)
    enc = library()
    for memo in (1, 4, 1000):
        found = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, memo=memo)
        assert found.rdd.getNumPartitions() <= max(1, spark.sparkContext.defaultParallelism)  # common words are folded once a task
        got = {r.doc_id: (bytes(r.ids), bytes(r.decoded)) for r in found.collect()}
        assert got == {i: (struct.pack(f"<{len(ids)}I", *ids), t.encode()) for i, t in enumerate(texts) for ids in [enc.encode_ordinary(t)]}


def test_words_met_again_are_not_folded_again():
    """Forgetting all words where there were too many made the common ones new each time."""
    rnd = random.Random(6)
    common = ["".join(rnd.choice("abcdeno") for _ in range(6)) for _ in range(60)]
    texts = [" ".join(rnd.choice(common) if rnd.random() < 0.9 else f"{rnd.choice(common)}{rnd.choice(common)}," for _ in range(200)) for _ in range(60)]
    known, spelt, new, lo = byte_bpe.Known(public_tokenizers.PATTERN, 200), {}, Counter(), 0
    while lo < len(texts):
        anew, numbers, ends, counts = known.numbers(texts, lo)
        spelt = {} if anew else spelt
        for w in known.new:
            spelt[len(spelt)] = w.decode()
        new.update(known.new)
        assert sum(counts) == len(known.new) and len(ends) == len(counts) + 1
        for k, text in enumerate(texts[lo : lo + len(counts)]):
            assert [spelt[n] for n in numbers[ends[k] : ends[k + 1]].tolist()] == known.pattern(text)
        assert len(known.codes) <= 2 * 200 + 2 * len(common)
        lo += len(counts)
    assert sum(new[f" {w}".encode()] for w in common) < 4 * len(common)


def test_a_task_folds_what_it_forgot_and_what_is_new(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdenoé") for _ in range(rnd.randint(1, 8)))
    own = [word() for _ in range(15)]
    texts = [" ".join(rnd.choice(own) if rnd.random() < 0.7 else word() + rnd.choice(["", ",", "7!"]) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    enc = library()
    for memo in (3, 40, 150):
        got = {r.doc_id: (bytes(r.ids), bytes(r.decoded)) for r in byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, memo=memo).collect()}
        assert got == {i: (struct.pack(f"<{len(ids)}I", *ids), t.encode()) for i, t in enumerate(texts) for ids in [enc.encode_ordinary(t)]}


def test_every_pair_has_one_place():
    pairs = byte_bpe.Ranks(RANKS).pairs()
    big, small = byte_bpe.placed(pairs)
    for (a, b), i in pairs.items():
        pair = (a << 16 | b) << 16
        assert pair | i in (big[pair % len(big)], small[pair % len(small)])


# --- operator 13 ---


def brute_spellings(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) < len(b):
            a, b = b, a
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {w: (min(vs, key=lambda v: (-words[v], v)) if (vs := near[w]) else None) for w in words}
    form = {w: f if f and words[f] >= 5 * words[w] else None for w, f in form.items()}
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def spelt(seed):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abcdéÿ") for _ in range(rnd.randint(6, 8))) for _ in range(12)] + ["aabaab", "étélage", "straßen"]
    bag = []
    for s in stems:
        bag += [s] * rnd.choice([5, 30, 200])
        for _ in range(6):
            i = rnd.randrange(len(s))
            bag += [rnd.choice([s[:i] + s[i + 1 :], s[:i] + rnd.choice("abcdé") + s[i:], s[:i] + rnd.choice("abcdé") + s[i + 1 :], s[:i] + s[i : i + 2][::-1] + s[i + 2 :], s.upper()])] * rnd.choice([4, 5, 7, 40])
    rnd.shuffle(bag)
    rows = [(i, rnd.choice([" ", ", ", "\n", "1"]).join(bag[i::40])) for i in range(40)]
    return rows + [(None, "alphabet " * 6), (50, None), (51, ""), (7, rows[7][1]), (52, "chainaaa " * 5 + "chainaab " * 25 + "chainabb " * 125 + "chaibbbb " * 3), (53, "y" * 3000 + (" " + "y" * 3000) * 4)]


@pytest.mark.parametrize("hot", [64, 2, 0])
def test_spellings_equal_brute_force(spark, hot, monkeypatch):
    rows = spelt(hot)
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    kept = spelling.runs(docs)
    out = spelling.grouped(spelling.word_counts(kept, spelling.misspelt(F.col("doc_id"), F.col("run"))), hot_words=hot).collect()
    want = brute_spellings(rows)
    assert {tuple(r) for r in out} == want and len(out) == len(want)
    assert any(r.root != r.form and r.form for r in out) and any(r.n_near > 1 for r in out)


def test_anagrams_of_one_class_are_not_paired(spark):
    from itertools import permutations

    words = sorted({"".join(p) for p in permutations("abcdefg")})[:900]
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    assert spelling.near_words(table, hot_words=50).count() == 0
    assert spelling.spellings(spark.createDataFrame([], "doc_id long, text string")).collect() == []
