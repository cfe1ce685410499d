"""Operator 12: byte-level BPE by Spark higher-order functions over distinct words.

A text is cut into words by the pattern of the vocabulary, and every word is merged by
itself, so a word needs merging once wherever it occurs: the bytes of a word become an
array of adjacent pairs, and a fold over that array joins, step by step, the pair of least
rank, leftmost first, until no pair has a rank.  Ranks come from a literal map from pairs
of ids; as Spark searches its own maps from end to end, the literal is two arrays in which
a pair has one place each (a cuckoo table), so a lookup is two array accesses.  Ids are
ranks, so the least rank is also the id of the joined pair.  Decoding concatenates the
bytes of the ids.

Words are made distinct within a task and numbered: for each text its word numbers go on,
and beside them the words that the task does not remember.  Spark folds these, and what
reads the numbers next keeps the codes.  It meets texts in the same order, so no text is
read twice, nothing is shuffled, and a lost task repeats only its own rows.  Most words
occur once: where a task remembers more than `MEMO`, it forgets those that it met once since
it last did so, and their numbers are not used again.  Numbers start again, and both sides
forget all, after `NUMBERS` times as many.  A task takes about `TASK_BYTES` of text, however
small the files were cut, since every task folds common words again.  Texts and numbers
travel in short rows, one after the other, as both sides hold a batch of rows at a time.

A word of more than `LONG` bytes is not folded (every step reads the whole array, which
is quadratic); it is merged with the heap of word_bpe.py, which gives the same ids.

Defined cases: a null text encodes to no ids and decodes to no bytes; repeated rows and
ids give one row each; texts may be of any length; a text that is not UTF-8 is read with
replacement characters; special strings are ordinary text; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import base64
import re
from array import array
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.spans import let
from rankloom.llm.word_bpe import heap_merge

LONG = 96  # bytes of a word that the fold takes
NOWHERE = 1 << 62  # an empty place of the table: no pair, and above every rank
ID_BITS = 16
END = (1 << ID_BITS) - 1  # stands before and after the symbols of a word; no id
BOTH = (1 << 2 * ID_BITS) - 1  # the bits of both ids of a pair
PLACES = 127 << 2 * ID_BITS  # the bits of its place
RANK_AT = 2 * ID_BITS + 7  # where its rank starts
NONE = 1 << ID_BITS  # the rank of a pair without one
MEMO = 340_000  # words that a task remembers; a dict of 349,526 or more takes twice the room
NUMBERS = 6  # so many times as many words get numbers before these start again
MIXED = 100_000  # chunks of several words that it remembers
MANY = 1 << 30  # the number of the first chunk of several words
GROUP = 4_000_000  # chunks that are numbered at once
SLICE_ROWS = 200  # texts that are held as Python objects at a time
PIECE = 512  # bytes of a text, and
ROW_WORDS = 128  # numbers of words in a row: a batch is so many rows, however long they are
GATHERED = 200_000  # words that are looked up at once
TASK_BYTES = 100_000_000  # bytes of text of a task, about, where there are more tasks than cores

# White space as the pattern understands it.  A chunk is a run of it and what follows up to
# the next; no word of the pattern reaches over the end of a chunk or depends on others.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNKS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall


@dataclass
class _Heap:
    """What heap_merge asks of a vocabulary."""

    ranks: dict[int, int]
    joined: range


class Ranks:
    """A rank file (base64 of the bytes, and the rank, on each line) as tables."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        if max(self.ids.values()) >= END:
            raise ValueError(f"ids must stay below {END}")
        self.first = [self.ids[bytes([b])] for b in range(256)]
        self.pieces = [b""] * (1 + max(self.ids.values()))
        for token, i in self.ids.items():
            self.pieces[i] = token
        self._heap = self._starts = None

    def heap(self) -> _Heap:
        if self._heap is None:
            self._heap = _Heap({a << 20 | b: i for (a, b), i in self.pairs().items()}, range(len(self.pieces)))
        return self._heap

    def starts(self) -> np.ndarray:
        """The rank of each pair of byte values; 256 stands for END."""
        if self._starts is None:
            self._starts = np.full((257, 257), NONE, np.int64)
            for token, i in self.ids.items():
                if len(token) == 2:
                    self._starts[token[0], token[1]] = i
        return self._starts

    def pairs(self) -> dict[tuple[int, int], int]:
        """The id of every two ids whose bytes, one after the other, are a token."""
        out = {}
        for token, i in self.ids.items():
            for k in range(1, len(token)):
                a, b = self.ids.get(token[:k]), self.ids.get(token[k:])
                if a is not None and b is not None:
                    out[a, b] = i
        return out


def primes(least: int):
    n = least
    while True:
        if all(n % d for d in range(2, int(n**0.5) + 1)):
            yield n
        n += 1


def placed(pairs: dict[tuple[int, int], int]) -> tuple[list[int], list[int]]:
    """Two tables of prime lengths.

    The entry of a pair holds both ids and the id of the two joined, ID_BITS each; it stands
    in one table, at the place that the entry less the joined id has modulo the length.
    """
    entries = [((a << ID_BITS | b) << ID_BITS) | i for (a, b), i in pairs.items()]
    for big in primes(5 + int(1.4 * len(entries))):
        small = next(primes(5 + int(1.2 * len(entries))))
        tables = [NOWHERE] * big, [NOWHERE] * small
        for e in entries:
            for turn in range(200):
                t = tables[turn % 2]
                at = (e >> ID_BITS << ID_BITS) % len(t)
                t[at], e = e, t[at]
                if e == NOWHERE:
                    break
            else:
                break
        else:
            return tables
    raise AssertionError


def literal(values: list, kind: str) -> Column:
    """An array that the optimiser folds into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def folded(words: Column, ranks: Ranks, ranked: bool = True) -> Column:
    """Each of an array of words after all its merges.

    A word is an array of its adjacent pairs, with END before the first symbol and after the
    last.  A pair is one number: its rank, its place and both ids.  So the least number is the
    pair to join, leftmost of equals, and a join asks only for the ranks of the two new pairs
    beside it.  Unless `ranked`, the pairs come without ranks.
    """
    big, small = placed(ranks.pairs())

    def with_tables(one: Column, two: Column) -> Column:
        def rank(pair: Column) -> Column:
            key = pair.bitwiseAND(BOTH) * (1 << ID_BITS)
            # The entry of this very pair leaves its id; every other one leaves some higher bit.
            found = F.least(F.get(one, (key % len(big)).cast("int")).bitwiseXOR(key), F.get(two, (key % len(small)).cast("int")).bitwiseXOR(key), F.lit(NONE).cast("bigint"))
            return F.shiftleft(found, RANK_AT).bitwiseOR(pair)

        def joined(now: Column, least: Column, p: Column) -> Column:
            before, after, i = F.get(now, p - 2), F.get(now, p), F.shiftright(least, RANK_AT)
            left = before.bitwiseAND(PLACES | BOTH ^ END).bitwiseOR(i)
            right = F.shiftleft(i, ID_BITS).bitwiseOR(least.bitwiseAND(PLACES)).bitwiseOR(after.bitwiseAND(END))
            rest = F.array_remove(F.array_remove(F.array_remove(now, least), before), after)
            return let(F.transform(F.array(left, right), rank), lambda new: F.array_insert(F.array_insert(rest, p - 1, F.get(new, F.lit(1))), p - 1, F.get(new, F.lit(0))))

        def fold(word: Column) -> Column:
            step = lambda now, least: F.when(least >= NONE << RANK_AT, now).otherwise(let(F.array_position(now, least).cast("int"), lambda p: joined(now, least, p)))
            return F.aggregate(F.sequence(F.lit(3), F.greatest(F.size(word), F.lit(3))), word, lambda now, _: let(F.array_min(now), lambda least: step(now, least)))

        known = words if ranked else F.transform(words, lambda w: F.transform(w, rank))
        return F.transform(known, lambda w: F.when(F.array_min(w) >= NONE << RANK_AT, w).otherwise(fold(w)))

    return let(literal(big, "bigint"), lambda one: let(literal(small, "bigint"), lambda two: with_tables(one, two)))


def coded(words: Column, ranks: Ranks) -> Column:
    """The ids of each of an array of words, given as arrays of the ids of their bytes, LONG at most."""
    end = F.array(F.lit(END).cast("bigint"))
    pairs = lambda w: F.transform(F.arrays_zip(F.concat(end, w).alias("a"), F.concat(w, end).alias("b")), lambda x, n: x["a"] * (1 << ID_BITS) + x["b"] + F.shiftleft(n.cast("bigint"), 2 * ID_BITS))
    ids = lambda w: F.transform(F.slice(w, F.lit(2), F.size(w)), lambda pair: F.shiftright(pair, ID_BITS).bitwiseAND(END))
    return F.transform(folded(F.transform(words, pairs), ranks, ranked=False), ids)


_READ: dict[str, Ranks] = {}


def load(path: str) -> Ranks:
    if path not in _READ:
        _READ[path] = Ranks(path)
    return _READ[path]


def long_word(word: bytes, ranks: Ranks) -> list[int]:
    """The ids of a word of any length."""
    return [i for i in heap_merge([ranks.first[b] for b in word], ranks.heap())[1] if i >= 0]


class _Codes(dict):
    """What is known of words, by word; `make(chunk)` answers for every chunk that is no known word."""

    def __init__(self, make, known=()):
        super().__init__(known)
        self.make = make

    def __missing__(self, chunk):
        return self.make(chunk)


class Known:
    """The words that a task remembers, numbered."""

    def __init__(self, pattern: str, most: int | None = None):
        self.pattern, self.most = regex.compile(pattern).findall, MEMO if most is None else most
        self.restart()

    def restart(self):
        self.codes, self.new, self.count, self.seen = _Codes(self.numbered), [], 0, np.zeros(0, np.int32)
        self.unmix()

    def unmix(self):
        """Forgets the chunks of several words; `parts` has their words' numbers, one chunk after the other."""
        self.mixed, self.parts, self.ends = {}, array("i"), array("i", [0])

    def sweep(self):
        """Forgets the words met once since the last time, or all where few were."""
        again = self.seen[np.fromiter(self.codes.values(), np.int32, len(self.codes))] > 1
        kept = compress(self.codes.items(), again.tolist()) if 3 * again.sum() < 2 * len(again) else ()
        self.codes = _Codes(self.numbered, kept)
        self.seen[:] = 1
        self.unmix()

    def split(self, chunk: str) -> list[str]:
        """The words of a chunk; letters alone, or behind one space, are one word."""
        return [chunk] if chunk.isalpha() or chunk[0] == " " and chunk[1:].isalpha() else self.pattern(chunk)

    def fresh(self, text: str) -> tuple[list[str], list[str]]:
        """(all chunks of the text, those that are new); forgets all first where there is too much."""
        if len(self.codes) > self.most:
            self.codes = _Codes(self.numbered)
        every, codes = CHUNKS(text), self.codes
        return every, [c for c in dict.fromkeys(every) if c not in codes]

    def word(self, word: str) -> int:
        """The number of a new word."""
        n = self.codes[word] = self.count
        self.count += 1
        self.new.append(word.encode())
        return n

    def numbered(self, chunk: str) -> int:
        """The number of a chunk that is no known word: that of a new word, or from MANY on that of several words."""
        if chunk in self.mixed:
            return self.mixed[chunk]
        split, codes = self.split(chunk), self.codes
        if len(split) == 1:
            return self.word(chunk)
        self.parts.extend([codes[w] if w in codes else self.word(w) for w in split])
        self.ends.append(len(self.parts))
        n = self.mixed[chunk] = MANY + len(self.mixed)
        return n

    def parted(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of words for numbers of chunks, where those of each chunk begin and the last end)."""
        many = flat >= MANY
        if not many.any():
            return flat, np.arange(len(flat) + 1)
        ends, at = np.array(self.ends, np.int64), flat[many] - MANY
        sizes, own = np.ones(len(flat), np.int64), ends[at + 1] - ends[at]
        sizes[many] = own
        out = np.repeat(flat, sizes)
        out[out >= MANY] = np.array(self.parts, np.int32)[np.arange(own.sum()) + np.repeat(ends[at + 1] - np.cumsum(own), own)]
        return out, np.r_[0, np.cumsum(sizes)]

    def numbers(self, texts: list[str], lo: int) -> tuple[bool, np.ndarray, np.ndarray, list[int]]:
        """For texts from the lo-th on, as many as there is room for, and one at least.

        (whether numbers start again, those of the words, where each text's begin and the last
        end, how many new words each has); `new` has these words.
        """
        if self.count > NUMBERS * self.most:
            self.restart()
        elif len(self.codes) > self.most:
            self.sweep()
        elif len(self.mixed) > MIXED:
            self.unmix()
        anew, self.new = self.count == 0, []
        flat, ends, counts, find = array("i"), [0], [], self.codes.__getitem__
        for text in texts[lo:]:
            before = len(self.new)
            flat.extend(map(find, CHUNKS(text)))
            ends.append(len(flat))
            counts.append(len(self.new) - before)
            if len(self.codes) > self.most or len(self.mixed) > MIXED or len(flat) > GROUP:
                break
        words, begins = self.parted(np.frombuffer(flat, np.int32))
        self.seen = np.r_[self.seen, np.zeros(self.count - len(self.seen), np.int32)]
        self.seen += np.bincount(words, minlength=self.count).astype(np.int32)
        return anew, words, begins[ends], counts


def _slices(batches):
    """(doc_ids, texts) of some rows at a time, from their pieces; the last piece of each text is marked."""
    rest = []
    for batch in batches:
        bounds, raw = _offsets(batch.column(1)).tolist(), memoryview(batch.column(1).buffers()[2] or b"")
        lasts, lo = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False)).tolist(), 0
        for k in range(0, len(lasts), SLICE_ROWS):
            texts, some = [], lasts[k : k + SLICE_ROWS]
            for last in some:
                rest.append(raw[bounds[lo] : bounds[last + 1]])
                texts.append(str(b"".join(rest) if len(rest) > 1 else rest[0], "utf-8", "replace"))
                lo = last + 1
                rest.clear()
            yield batch.column(0).take(pa.array(some)), texts
        if lo < batch.num_rows:
            rest.append(bytes(raw[bounds[lo] : bounds[-1]]))


def _rows(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the rows of texts that begin and end at `ends` begin and the last ends; the text of each; whether it is the text's last."""
    rows = np.maximum(1, -(-np.diff(ends) // ROW_WORDS))
    text, stops = np.repeat(np.arange(len(rows)), rows), np.cumsum(rows)
    last = np.zeros(len(text), bool)
    last[stops - 1] = True
    return np.r_[ends[:-1][text] + ROW_WORDS * (np.arange(len(text)) - (stops - rows)[text]), ends[-1]], text, last


def paired(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, list[int]]:
    """(the pairs of all words as `folded` takes them, one word after the other; the number of pairs of each).

    Long words come with all their merges done.
    """
    short = [w if len(w) <= LONG else b"" for w in words]
    sizes = np.array([len(w) for w in short], np.int64)
    symbols = np.full(int(sizes.sum()) + len(words) + 1, 256, np.int64)
    symbols[np.arange(int(sizes.sum())) + np.repeat(np.arange(1, len(words) + 1), sizes)] = np.frombuffer(b"".join(short), np.uint8)
    place = np.arange(len(symbols) - 1) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    ids = np.array([*ranks.first, END], np.int64)[symbols]
    pairs = ranks.starts()[symbols[:-1], symbols[1:]] << RANK_AT | place << 2 * ID_BITS | ids[:-1] << ID_BITS | ids[1:]
    sizes = (sizes + 1).tolist()
    if any(len(w) > LONG for w in words):
        parts = np.split(pairs, np.cumsum(sizes)[:-1])
        for n, w in enumerate(words):
            if len(w) > LONG:
                ids = np.array([END, *long_word(w, ranks), END], np.int64)
                parts[n] = NONE << RANK_AT | ids[:-1] << ID_BITS | ids[1:]
                sizes[n] = len(parts[n])
        pairs = np.concatenate(parts)
    return pairs, sizes


def _binary(ends: np.ndarray, raw) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int32)), pa.py_buffer(raw)])


def _offsets(x: pa.Array) -> np.ndarray:
    """Where the values of a binary array begin and the last ends."""
    kind = np.int64 if pa.types.is_large_binary(x.type) else np.int32
    return np.frombuffer(x.buffers()[1], kind)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, kind)


def _gathered(batch):
    """The rows of a batch in parts of about GATHERED words, in which numbers do not start again."""
    lo, total = 0, 0
    for i, (anew, n) in enumerate(zip(batch.column(1).to_pylist(), pc.binary_length(batch.column(3)).to_pylist())):
        if i > lo and (anew or total + n // 4 > GATHERED):
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += n // 4
    if lo < batch.num_rows:
        yield batch.slice(lo)


def _dealt(docs: DataFrame) -> DataFrame:
    """The rows in tasks of about TASK_BYTES, but no fewer tasks than there are cores; nothing is moved."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO) -> DataFrame:
    """doc_id, ids (little-endian uint32) and decoded (bytes) of every row."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def new_words(batches):
        known, ranks = Known(pattern, memo), load(path)
        offsets = lambda n: pa.array(np.cumsum([0, *n]), pa.int32())
        try:
            for doc_ids, texts in _slices(batches):
                lo = 0
                while lo < len(texts):
                    anew, numbers, ends, counts = known.numbers(texts, lo)
                    pairs, sizes = paired(known.new, ranks)
                    begins, text, last = _rows(ends)
                    new = np.zeros(len(text), np.int64)
                    new[np.r_[True, last[:-1]]] = counts
                    words = pa.ListArray.from_arrays(offsets(new), pa.ListArray.from_arrays(offsets(sizes), pa.array(pairs)))
                    firsts = np.arange(len(text)) == (0 if anew else -1)
                    yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(lo + text)), pa.array(firsts), pa.array(last), _binary(4 * begins, numbers), words], ["doc_id", "anew", "last", "places", "words"])
                    lo += len(counts)
        finally:
            known.restart()  # it refers to itself, so the worker would hold its words beside those of the next task
            pa.default_memory_pool().release_unused()

    def codes(batches):
        ranks, none = load(path), pa.array([], pa.binary())
        pieces, known = pa.array(ranks.pieces, pa.binary()), none  # the ids of each word, two bytes each
        ids, said = np.zeros(0, "<u4"), np.zeros(0, np.uint8)  # of a text that goes on in the next rows
        try:
            for batch in batches:
                for part in _gathered(batch):
                    if part.column(1)[0].as_py():
                        known = none
                    words = part.column(4).flatten()
                    if len(words):
                        pairs, ends = words.flatten().to_numpy(zero_copy_only=False), np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
                        new = np.delete((pairs >> ID_BITS & END).astype(np.uint16), np.r_[0, ends[:-1]])
                        known = pa.concat_arrays([known, _binary(2 * np.r_[0, ends - np.arange(1, len(ends) + 1)], new)])
                    places = part.column(3).to_pylist()
                    taken = known.take(pa.array(np.frombuffer(b"".join(places), np.int32)))
                    stops = _offsets(taken)[np.cumsum([0, *(len(x) // 4 for x in places)])] // 2
                    found = np.frombuffer(taken.buffers()[2] or b"", np.uint16)[: stops[-1]].astype("<u4")
                    bytes_of = pieces.take(pa.array(found))
                    cuts = _offsets(bytes_of)[stops]
                    whole = np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False))
                    to, upto = (np.r_[0, len(before) + x[whole + 1].astype(np.int64)] for before, x in ((ids, stops), (said, cuts)))
                    ids, said = np.r_[ids, found], np.r_[said, np.frombuffer(bytes_of.buffers()[2] or b"", np.uint8)[: cuts[-1]]]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(whole)), _binary(4 * to, ids), _binary(upto, said)], ["doc_id", "ids", "decoded"])
                    ids, said = ids[to[-1] :].copy(), said[upto[-1] :].copy()
        finally:
            known = none
            pa.default_memory_pool().release_unused()

    top = F.floor((F.greatest(F.octet_length("text"), F.lit(1)) - 1) / PIECE).cast("int")
    piece = lambda i: F.struct(F.col("text").substr(i * PIECE + 1, F.lit(PIECE)).alias("piece"), (i == top).alias("last"))
    pieces = _dealt(narrow).select("doc_id", F.explode_outer(F.transform(F.sequence(F.lit(0), top), piece)).alias("x")).select("doc_id", "x.piece", "x.last")
    spelt = pieces.mapInArrow(new_words, f"doc_id {kind}, anew boolean, last boolean, places binary, words array<array<bigint>>")
    return spelt.withColumn("words", folded(F.col("words"), load(path))).mapInArrow(codes, f"doc_id {kind}, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
