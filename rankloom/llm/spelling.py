"""Operator 13: spelling variants grouped by anagram hashing.

The key of a word is the sum of the fifth powers of its letters, so anagrams share it,
and two words that differ by one letter have keys that differ by that letter's power
(one added or removed) or by a difference of two powers (one exchanged).  In place of
trying every such difference, each word also gives its key less the power of each of
its letters: an exchange meets at the key that is left on both sides, an addition or
removal where one side's rest is the other side's own key.  Whatever meets is then
verified by letter order (distance of exactly one edit).

Words that meet at a key and gave up the same letter are anagrams, never near, and are
not paired.  At a key where more than `HOT_WORDS` meet, the letter order is part of the
join: each word stands there once for each way to give up that letter (once for a run of
equal letters), under a hash of the letters that are left, so that only words with the
same rest are paired and a group is bounded by the alphabet and the length of a word.

A word's form is its near word of largest count (ties: least in code-point order), if
that count is `RATIO` times its own or more.  Counts grow by that factor along a chain
of forms, so a chain is short, and roots are found by pointer doubling.

Defined cases: null and empty texts have no runs; a null doc_id counts as an empty
name; repeated rows count as often as they stand; runs may be of any length (keys are
taken modulo a prime); empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.store import written

LEAST_CHARS = 6
LEAST_COUNT = 5
RATIO = 5
NOISE = 199
POWER = 5
PRIME = (1 << 61) - 1
HOT_WORDS = 64
ROUNDS = 5  # doublings: 32 steps, and 5 ** 32 is more than a count can hold
LETTERS = r"A-Za-zÀ-ÿ"  # fixed value
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, run) of every maximal run of letters of at least that many, A-Z in lower case.

    Shorter runs cannot become words of `least` letters, so the pattern passes them by; a
    match still begins where its run begins.
    """
    found = F.regexp_extract_all(F.col("text"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    rows = docs.select("doc_id", F.explode_outer(found).alias("run")).where("run is not null")
    return rows.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def misspelt(doc_id: Column, run: Column, noise: int = NOISE) -> Column:
    """The run, with one letter left out where a checksum of document and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % noise == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(rows: DataFrame, word: Column, least: int = LEAST_CHARS, occurrences: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    words = rows.select(word.alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def letters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def power(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    out = code
    for _ in range(POWER - 1):
        out = out * code
    return out


def anagram_key(word: Column) -> Column:
    return F.aggregate(letters(word), F.lit(0).cast("long"), lambda acc, c: (acc + power(c)) % PRIME)


def meetings(words: DataFrame, hot_words: int = HOT_WORDS) -> DataFrame:
    """(key, rest, letter, word): where each word meets others; letter is null for the whole word."""
    keyed = words.select("word", anagram_key(F.col("word")).alias("own"))
    whole = keyed.select(F.col("own").alias("key"), F.lit(None).cast("string").alias("letter"), "word")
    less = keyed.select("word", "own", F.explode(F.array_distinct(letters(F.col("word")))).alias("letter"))
    less = less.select(F.pmod(F.col("own") - power(F.col("letter")), F.lit(PRIME)).alias("key"), "letter", "word")
    every = written(whole.unionByName(less), "keys")
    counts = every.groupBy("key").agg(F.count("*").alias("k"))
    hot = written(counts.where(F.col("k") > hot_words).select("key"), "hot-keys")
    alone = F.lit(0).cast("long").alias("rest")
    n_hot = hot.count()
    if not n_hot:
        return every.select("key", alone, "letter", "word")
    sent = F.broadcast(hot) if n_hot <= 100_000 else hot
    cold = every.join(sent, "key", "left_anti").select("key", alone, "letter", "word")
    own = every.join(sent, "key")
    named = own.where("letter is null").select("key", F.xxhash64("word").alias("rest"), "letter", "word")
    chars = letters(F.col("word"))
    before = F.concat(F.array(F.lit("")), chars)
    runs_ = F.zip_with(chars, F.slice(before, F.lit(1), F.size(chars)), lambda c, b: (c == F.col("letter")) & (b != F.col("letter")))
    places = F.transform(runs_, lambda starts, i: F.when(starts, i))
    places = F.filter(places, lambda i: i.isNotNull())
    placed = own.where("letter is not null").select("key", "letter", "word", F.explode(places).alias("place"))
    rest = F.concat(F.substring("word", F.lit(1), F.col("place")), F.substring("word", F.col("place") + 2, F.length("word")))
    return cold.unionByName(named).unionByName(placed.select("key", F.xxhash64(rest).alias("rest"), "letter", "word"))


def near_words(words: DataFrame, hot_words: int = HOT_WORDS) -> DataFrame:
    """(word, near): every ordered pair of words of one edit."""
    met = written(meetings(words, hot_words), "meetings")
    a, b = met.where("letter is not null").alias("a"), met.alias("b")
    fits = F.col("b.letter").isNull() | (F.col("a.letter") < F.col("b.letter"))
    both = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.rest") == F.col("b.rest")) & fits)
    pairs = both.where(F.levenshtein("a.word", "b.word", 1) == 1).select(F.col("a.word").alias("word"), F.col("b.word").alias("near")).distinct()
    pairs = written(pairs, "near")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where following forms ends."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(ROUNDS):
        on = now.select(F.col("word").alias("_at"), F.col("root").alias("_on"))
        moved = now.join(on, F.col("root") == F.col("_at"), "left")
        now = written(moved.select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("_moved")), "roots")
        if not now.where("_moved").limit(1).count():
            break
        now = now.drop("_moved")
    return now.select("word", "root")


def grouped(counts: DataFrame, ratio: int = RATIO, hot_words: int = HOT_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every (word, n)."""
    words = written(counts, "words")
    near = near_words(words, hot_words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("b"))
    best = best.select(F.col("word").alias("_w"), "n_near", F.col("b.form").alias("form"), (-F.col("b.minus")).alias("form_n"))
    every = words.join(best, F.col("word") == F.col("_w"), "left").drop("_w")
    follows = F.col("form_n") >= ratio * F.col("n")
    every = written(every.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(follows, F.col("form")).alias("form"), F.when(follows, F.col("form_n")).alias("form_n")), "forms")
    ends = roots(every.where("form is not null").select("word", "form")).select(F.col("word").alias("_w"), "root")
    out = every.join(ends, F.col("word") == F.col("_w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spellings(docs: DataFrame, noise: int = NOISE) -> DataFrame:
    """The variants among the words of all texts, one letter in some runs left out."""
    rows = runs(docs.select("doc_id", "text"))
    return grouped(word_counts(rows, misspelt(F.col("doc_id"), F.col("run"), noise)))


_BIT = "list_transform({t}, lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)"
_TABLE = "range(256)"
for _ in range(8):
    _TABLE = _BIT.format(t=_TABLE)
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{6,}}')) AS r FROM documents),
l AS (SELECT doc_id, translate(r, '{UPPER}', '{LOWER}') AS r FROM d),
t AS MATERIALIZED (SELECT {_TABLE} AS t),
b AS (SELECT r, list_concat([4294967295::BIGINT], flatten(list_transform(string_split(concat(doc_id, ':', r), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192::BIGINT + (unicode(x) >> 6), 128::BIGINT + (unicode(x) & 63)] END))) AS v FROM l),
h AS (SELECT r, xor(list_reduce(v, lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8)), 4294967295::BIGINT) AS h FROM b CROSS JOIN t),
o AS (SELECT CASE WHEN h % 199 = 0 THEN concat(substr(r, 1, CAST(h % length(r) AS INT)), substr(r, CAST(h % length(r) AS INT) + 2)) ELSE r END AS word FROM h),
w AS MATERIALIZED (SELECT word, count(*) AS n FROM o WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
p AS MATERIALIZED (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS MATERIALIZED (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM p a JOIN p b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM p a JOIN w b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM p a JOIN w b ON a.rest = b.word),
g AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS rn FROM e),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM w LEFT JOIN (SELECT * FROM g WHERE rn = 1) g USING (word)),
z AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT z.word, f.word, f.form FROM z JOIN f ON z.next = f.word)
SELECT f.word, f.form, z.at AS root, f.n, f.n_near, f.form_n FROM f JOIN z ON z.word = f.word WHERE z.next IS NULL
"""
