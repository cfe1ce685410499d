"""Operator 8 [native]: quality rules as a short-circuit cascade.

Each rule rejects a text by one measure.  On a bounded sample, the cost of each rule
(characters it scans, and one for a comparison) and its selectivity are estimated; the
next rule is always the one that rejects most of what the rules before it left, per
character scanned, and a text is put to it only while none has rejected it.  Both are
counts, so the same table gives the same order.  The verdict does not depend on it.

Defined cases: a null or empty text has no words and fails the base check; rows are
independent, so repeated rows get equal verdicts; empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 500
LEAST_WORDS = 50
SPACE = r"[\x20\x09-\x0D]+"


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), n_words and the four base measures."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "*",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("_w"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    rows = rows.select("*", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    at = lambda i: F.get("_h", i)
    windows = F.transform(F.sequence(F.lit(0), F.size("_h") - 3), lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("k"), i.alias("p")))
    rows = rows.select("*", F.when(F.size("_h") >= 3, windows).otherwise(F.array().cast("array<struct<k:bigint,p:int>>")).alias("_k"))
    # Equal windows stand together once sorted; both of each equal neighbouring pair are repeats.
    rows = rows.select("*", F.when(F.size(F.array_distinct(F.transform("_k", lambda x: x["k"]))) < F.size("_k"), F.array_sort("_k")).otherwise(F.array().cast("array<struct<k:bigint,p:int>>")).alias("_s"))
    pair = lambda a, b: F.when(a["k"] == b["k"], F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>"))
    count = F.greatest(F.size("_s") - 1, F.lit(0))
    starts = F.array_sort(F.array_distinct(F.flatten(F.zip_with(F.slice("_s", F.lit(1), count), F.slice("_s", F.lit(2), count), pair))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(starts, zero, lambda acc, s: F.struct((s + 3).alias("end"), (acc["n"] + s + 3 - F.greatest(s, acc["end"])).alias("n")), lambda acc: acc["n"])
    return rows.select(
        "doc_id",
        "text",
        F.size("_w").cast("long").alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, tuple[Column, Column]]:
    """Name to (rejecting condition, characters it scans), over the text and the base measures; each computes what it needs itself."""
    letters = F.regexp_count("text", F.lit(r"\p{L}"))
    scan, compare = F.length("text") + 1, F.lit(1)
    return {
        "symbols": (F.col("n_symbols") * 10 > F.col("n_words"), compare),
        "capitals": (F.regexp_count("text", F.lit(r"\p{Lu}")) * 2 > letters, 2 * scan),
        "shouting": (F.regexp_count("text", F.lit("!!")) * 5 > F.col("n_words"), scan),
        "word_length": ((F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")), compare),
        "duplicate_lines": (F.col("n_dup_lines") * 2 > F.size(F.split("text", "\n")), scan),
        "few_letters": (letters * 10 < F.col("word_chars") * 6, scan),
    }


def sample(docs: DataFrame) -> DataFrame:
    """SAMPLE_ROWS rows at most, those of least hash; equal hashes are equal rows, as far as the rules go."""
    return docs.orderBy(F.xxhash64("doc_id", "text")).limit(SAMPLE_ROWS)


def ordered(docs: DataFrame, found: dict[str, tuple[Column, Column]] | None = None) -> list[str]:
    """Rule names by rejection per cost, each rule judged on the sampled rows that pass the base check and the rules before it."""
    found = found or rules()
    names = list(found)
    hits = F.array_compact(F.array(F.when(base_failed(), ""), *[F.when(found[n][0], F.lit(n)) for n in names]))
    judged_rows = measures(sample(docs.select("doc_id", "text"))).select(hits.alias("hits"), *[found[n][1].cast("long").alias(n) for n in names])
    groups = judged_rows.groupBy("hits").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in names])
    rows = [(set(r["hits"]), r) for r in groups.collect() if "" not in r["hits"]]  # at most one row for each set of rules, and SAMPLE_ROWS
    order: list[str] = []
    while len(order) < len(names):
        left = [(hit, r) for hit, r in rows if not hit & set(order)]
        merit = {n: sum(r["n"] for hit, r in left if n in hit) / max(1, sum(r[n] for _, r in left)) for n in names if n not in order}
        order.append(min(merit, key=lambda n: (-merit[n], n)))
    return order


def judged(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, the four base measures, base_failed, rejected_by ("" where none) and kept."""
    found = rules()
    cascade = F.when(base_failed(), "base")
    for name in order or ordered(docs, found):
        cascade = cascade.when(found[name][0], name)  # reached only while no earlier rule has rejected
    out = measures(docs).withColumn("_by", cascade.otherwise(""))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), F.col("_by").alias("rejected_by"), (F.col("_by") == "").alias("kept"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i+2])) AS k FROM d WHERE len(w) >= 3),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g),
p AS (SELECT r, count(DISTINCT i + o) AS n FROM c CROSS JOIN (SELECT unnest([0, 1, 2]) AS o) WHERE c.n > 1 GROUP BY r),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT d.r, doc_id, text, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines,
  len(regexp_extract_all(text, '\p{L}')) AS letters, len(regexp_extract_all(text, '\p{Lu}')) AS capitals, len(regexp_extract_all(text, '!!')) AS shouts
  FROM d JOIN l USING (r) LEFT JOIN p USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols * 10 > n_words OR capitals * 2 > letters OR shouts * 5 > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR n_dup_lines * 2 > n_lines OR letters * 10 < word_chars * 6) AS kept FROM m
"""
