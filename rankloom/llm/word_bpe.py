"""The word-level part that token counting and encoding share: files, pieces, symbols.

A text is cut at ASCII white space; each chunk goes through the tokenizer file's
own steps (special strings, NFC, lower case, its split pattern, byte symbols with
an end-of-word mark).  Nothing in those steps looks across white space, so a chunk
always gives the same pieces and its result can be kept.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import regex

END = ""  # stands for the file's end-of-word suffix, as one character
MEMO = 400_000  # entries a worker keeps before it starts afresh


def byte_symbols() -> list[str]:
    """The printable character of each byte value in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class WordBpe:
    """One tokenizer file, read once in each worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.symbol = byte_symbols()
        self.vocab = {self._own(token): i for token, i in model["vocab"].items()}
        self.name = {i: token for token, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.first = [self.vocab.get(c) for c in self.symbol]
        self.last = [self.vocab.get(c + END) for c in self.symbol]
        self.ranks, self.joined = {}, []  # pair of ids, as one number -> rank; rank -> id of the joined symbol
        for r, pair in enumerate(model["merges"]):
            x, y = map(self._own, pair if isinstance(pair, list) else pair.split(" "))
            self.ranks[self.vocab[x] << 20 | self.vocab[y]] = r
            self.joined.append(self.vocab[x + y])

    def _own(self, token: str) -> str:
        return token[: -len(self.suffix)] + END if token.endswith(self.suffix) else token

    def parts(self, chunk: bytes):
        """(piece text, None) or (None, special id) in order; chunk holds no ASCII white space."""
        text = chunk.decode("utf-8", "replace")
        for k, part in enumerate(self.cut(text) if self.cut and "<|" in text else [text]):
            if k % 2:
                yield None, self.special[part]
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                part = part.lower()
                if part.isalpha():  # one run of letters is one piece
                    yield part, None
                else:
                    for piece in self.pieces(part):
                        yield piece, None

    def symbols(self, piece: str) -> list[int]:
        """Ids of the initial symbols; the last one carries the end-of-word mark."""
        raw, first = piece.encode("utf-8", "surrogatepass"), self.first
        out = [first[b] for b in raw]
        out[-1] = self.last[raw[-1]]
        return out


def heap_merge(sym: list[int], bpe: WordBpe) -> tuple[int, list[int]]:
    """Byte-pair merging with a heap over a linked list; `sym` is consumed.

    The lowest-ranked adjacent pair, leftmost first, is popped and joined.  `pair`
    holds the rank now standing at each place, so entries made stale by a merge
    beside them are told by it and skipped.  Returns the number of merges and the
    symbols (-1 where merged away).
    """
    get, joined, n = bpe.ranks.get, bpe.joined, len(sym)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    pair = [get(sym[i] << 20 | sym[i + 1], -1) for i in range(n - 1)]
    pair.append(-1)
    heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
    heapq.heapify(heap)
    merges = 0
    while heap:
        r, i = divmod(heapq.heappop(heap), 1 << 32)
        if pair[i] != r:
            continue
        j = after[i]
        sym[i] = s = joined[r]
        sym[j] = pair[j] = -1
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            pair[i] = r = get(s << 20 | sym[k], -1)
            if r >= 0:
                heapq.heappush(heap, r << 32 | i)
        else:
            pair[i] = -1
        h = before[i]
        if h >= 0:
            pair[h] = r = get(sym[h] << 20 | s, -1)
            if r >= 0:
                heapq.heappush(heap, r << 32 | h)
    return merges, sym


_READ: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _READ:
        _READ[path] = WordBpe(path)
    return _READ[path]


class Memo(dict):
    """A bounded memo: `make(key)` fills it, and it starts afresh when full."""

    def __init__(self, make, most: int = MEMO):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self.make(key)
        if len(key) <= 256:
            self[key] = value
        return value
