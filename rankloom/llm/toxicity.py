"""Operator 1: a counterfactual-regularised toxicity classifier.

A logistic model over word and word-prefix presence is fitted to labelled texts.
For each labelled text that names an identity group, the terms are swapped for
others of the same kind and for the neutral `NEUTRAL`, and the squared difference of the two logits is added to
the loss (counterfactual logit pairing), so that a neutral mention of a group does
not move the score.

Bound: the fit reads at most `FIT_ROWS` labelled rows, those with the least hash of
doc_id, and one text of each (of several, that of the least hash); scoring reads every whole text.  Labels, lang, source and doc_id are never
inputs of a score.

Defined cases: null and empty texts have no features and score the model's base
rate; a label row with a null doc_id or null label is ignored; of several labels
of one document the greatest holds; without both classes among the labels every
score is the (smoothed) share of toxic labels; repeated documents are scored each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 9_000
FEATURES = 300
LEAST_DOCS = (2, 6)  # labelled texts that must hold a feature: one in a thousand, within these
LEAST_MERIT = (8.0, 25.0)  # chi-square a feature must reach: 0.12 of the labelled texts, within these
PAIR_WEIGHT = 4.0
RIDGE = 2e-5
THRESHOLD = 0.7
STEPS = 350
PREFIXES = (4, 5)
SLICE_ROWS = 500  # rows of a batch whose texts are held as Python objects at a time
MEMO_WORDS = 150_000  # words whose features a task remembers
EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_"

# Identity terms by kind; swaps stay within a kind.  The default of a parameter.
IDENTITY = (
    ("man", "woman", "men", "women", "male", "female", "boy", "girl", "nonbinary"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("black", "white", "asian", "latino", "latina", "african", "european", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "turkish", "polish"),
    ("disabled", "deaf", "blind", "autistic", "paralyzed"),
    ("old", "young", "elderly", "teenage", "middle-aged"),
    ("immigrant", "refugee", "native", "foreigner"),
)
NEUTRAL = "person"
ENDINGS = ("", "s", "'s", "\u2019s")  # a term is swapped with the same ending


def forms_of(identity: tuple) -> dict[str, tuple[int, int, str]]:
    """{form: (kind, place in the kind, ending)} of all terms with all endings."""
    return {term + end: (k, i, end) for end in reversed(ENDINGS) for k, kind in enumerate(identity) for i, term in enumerate(kind)}


FORMS = forms_of(IDENTITY)


def words(text: str | None) -> set[str]:
    return {w.strip(EDGES) for w in set((text or "").lower().split())} - {""}


def features_of(word: str, whole=FORMS) -> tuple[int, ...]:
    """Hashes of a word and, unless it is an identity term (`whole`), of its prefixes."""
    raw = word.encode("utf-8", "replace")
    out = [zlib.crc32(b"=" + raw)]
    if word not in whole:
        out += [zlib.crc32(b"^%d" % n + word[:n].encode("utf-8", "replace")) for n in PREFIXES if len(word) >= n]
    return tuple(out)


def swapped(found: set[str], step: int, identity: tuple = IDENTITY, forms: dict = FORMS) -> set[str] | None:
    """The words with each identity term replaced by the one `step` places on in its kind, endings kept; step 0 is the neutral word."""
    hit = found & forms.keys()
    if not hit:
        return None
    if not step:
        return (found - hit) | {NEUTRAL}
    return (found - hit) | {identity[k][(i + step) % len(identity[k])] + end for k, i, end in map(forms.get, hit)}


def _vector(found: set[str], whole=FORMS) -> bytes:
    return np.unique(np.array([f for w in found for f in features_of(w, whole)], np.uint32)).tobytes()


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(y, text) of at most `rows` documents outside the held-out third."""
    key = F.col("doc_id").cast("string")
    picked = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("y"))
        .where("doc_id is not null and y is not null")
        .where(F.crc32(key.cast("binary")) % 3 != 1)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    met = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # `rows` bounds what is sent
    # One text an id, so that copies of a row do not pass the bound.
    one = met.groupBy("doc_id").agg(F.max("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return one.select("y", "t.text")


def train(samples: DataFrame, pair_weight: float = PAIR_WEIGHT, identity: tuple = IDENTITY) -> dict:
    """{"bias": float, "weights": {feature: weight}, "whole": identity forms, "pairs": counterfactual pairs met} from (y, text) rows."""
    forms = forms_of(identity)

    def vectors(batches):
        for batch in batches:
            y, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [words(t) for t in texts]
            other = [[swapped(f, s, identity, forms) for s in (0, 1, 2)] for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(y, pa.int32()),
                    pa.array([_vector(f, forms) for f in found], pa.binary()),
                    pa.array([[_vector(s, forms) for s in o if s] for o in other], pa.list_(pa.binary())),
                ],
                ["y", "x", "swaps"],
            )

    # A stable order makes the fit the same for any partitioning.
    rows = sorted((bytes(r.x), r.y, [bytes(s) for s in r.swaps]) for r in samples.mapInArrow(vectors, "y int, x binary, swaps array<binary>").collect())
    return fit([(np.frombuffer(x, np.uint32), y, [np.frombuffer(s, np.uint32) for s in swaps]) for x, y, swaps in rows], pair_weight, forms)


def fit(rows: list, pair_weight: float, forms: dict = FORMS) -> dict:
    n, pos = len(rows), sum(y for _, y, _ in rows)
    rate = (pos + 0.5) / (n + 1)
    if not 0 < pos < n:
        return {"bias": math.log(rate / (1 - rate)) if n else -4.0, "weights": {}, "whole": set(forms), "pairs": 0}
    every, share = np.unique(np.concatenate([x for x, _, _ in rows]), return_counts=True)
    toxic = np.zeros(len(every))
    found, count = np.unique(np.concatenate([x for x, y, _ in rows if y]), return_counts=True)
    toxic[np.searchsorted(every, found)] = count
    a, b, all_ = toxic, share - toxic, share.astype(float)
    merit = n * (a * (n - pos - b) - b * (pos - a)) ** 2 / np.maximum(1.0, all_ * (n - all_) * pos * (n - pos))  # chi-square
    merit = np.where((share >= np.clip(n // 1000, *LEAST_DOCS)) & (merit >= np.clip(0.12 * n, *LEAST_MERIT)), merit, 0)
    ours = {f for term in forms for f in features_of(term, forms)}
    best = np.lexsort((every, -merit))[:FEATURES]
    names = np.array(sorted(set(every[best[merit[best] > 0]].tolist()) | ours), np.uint32)

    def matrix(vectors) -> np.ndarray:
        out = np.zeros((len(vectors), len(names)), np.float32)
        for i, v in enumerate(vectors):
            at = np.searchsorted(names, v)
            at[at == len(names)] = 0
            out[i, at[names[at] == v]] = 1
        return out

    x, y = matrix([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32)
    apart = matrix([s for r in rows for s in r[2]]) - matrix([r[0] for r in rows for _ in r[2]]) if any(r[2] for r in rows) else None
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32) / n
    w, bias = np.zeros(len(names), np.float32), 0.0
    m, v, step = np.zeros(len(names) + 1), np.zeros(len(names) + 1), 0.3
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30)))
        e = (p - y) * weight
        grad = np.append(x.T @ e + RIDGE * w, e.sum())
        if apart is not None:
            grad[:-1] += 2 * pair_weight * (apart.T @ (apart @ w)) / len(apart)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (1 - t / (STEPS + 1))
        w -= move[:-1].astype(np.float32)
        bias -= float(move[-1])
    return {"bias": bias, "weights": {int(f): float(c) for f, c in zip(names, w) if c}, "whole": set(forms), "pairs": 0 if apart is None else len(apart)}


def score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """docs' columns and beside them the score (0 to 1), under a name that docs do not have."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs have a column {name} already")
    at = docs.columns.index("text")
    bias, weights, whole = model["bias"], model["weights"], model["whole"]

    def run(batches):
        memo: dict[str, tuple[int, ...]] = {}
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, SLICE_ROWS):
                batch = whole_batch.slice(lo, SLICE_ROWS)
                out = []
                for text in batch.column(at).to_pylist():
                    hit: set[int] = set()
                    for w in set((text or "").lower().split()):
                        got = memo.get(w)
                        if got is None:
                            if len(memo) > MEMO_WORDS:
                                memo.clear()
                            bare = w.strip(EDGES)
                            got = memo[w] = tuple(f for f in features_of(bare, whole) if f in weights) if bare else ()
                        if got:
                            hit.update(got)
                    z = bias + math.fsum(weights[f] for f in hit)
                    out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, name])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, identity: tuple = IDENTITY) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = train(labelled(docs, labels), identity=identity)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
