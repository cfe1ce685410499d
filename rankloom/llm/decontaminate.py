"""Operator 3 [native]: benchmark decontamination by size-partitioned MinHash containment.

Test items are short and documents long, so similarity of whole sets says little;
what counts is the share of an item's shingles that a document holds.  Items are
partitioned by size (powers of two).  Each item keeps a bottom-k MinHash sketch, its
shingles with the k least hashes, with k set by its partition: one more than the number
of shingles an item of that size may miss.  The share of an item's sketch that a
document holds estimates its containment; a document that holds enough of the item must
hold k less the shingles it may miss, so the search misses nothing.  Candidates are
verified by exact shingle containment.

Shingles are of five words (white space as in ASCII, lower case); an item or document
with fewer words is one shingle.  Hashes are 64-bit.

Defined cases: null or empty texts hold nothing and are clean; items without words
match nothing; a row is judged by its own text, whatever doc_id it has or shares; repeated
items each count, an item with a null item_id is not searched; empty tables give
all-clean or empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.spans import fresh
from rankloom.llm.store import written

SHINGLE = 5
CONTAINED = 80  # percent
SENT_ROWS = 1_000_000  # rows of two or three numbers that may be broadcast


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_shingles(rows: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """`keep` and hs: the distinct 64-bit hashes of the row's word shingles."""
    tokens = rows.select(*keep, words(F.col(text_col)).alias("_w"))
    at = lambda k: F.get(F.col("_w"), k)
    several = F.transform(F.sequence(F.lit(0), F.size("_w") - SHINGLE), lambda i: F.xxhash64(*[at(i + j) for j in range(SHINGLE)]))
    one = F.array(F.xxhash64(F.concat_ws(" ", "_w")))
    none = F.array().cast("array<bigint>")
    hs = F.when(F.size("_w") >= SHINGLE, F.array_distinct(several)).when(F.size("_w") > 0, one).otherwise(none)
    return tokens.withColumn("hs", hs).drop("_w")


def exploded(rows: DataFrame, *keep: str) -> DataFrame:
    """`keep` and h, a row per shingle.

    explode_outer, because Spark infers filters from explode and pushes them, with the
    whole of hs, below the projection that cuts the words.
    """
    return rows.select(*keep, F.explode_outer("hs").alias("h")).where("h is not null")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT_ROWS else df


def key_of(text: Column) -> Column:
    """What documents are told apart by: 128 bits of their text, so copies are searched as one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def contained(docs: DataFrame, bench: DataFrame, percent: int = CONTAINED) -> tuple[DataFrame, int]:
    """(_key, item_id, n_shingles, n_found) of each item that a text holds to `percent` or more, and a bound on the rows."""
    items = with_shingles(bench.where("item_id is not null"), "text", [F.col("item_id")])
    shingles = exploded(items, "item_id").distinct()
    sizes = shingles.groupBy("item_id").agg(F.count("*").alias("n"))
    ranked = shingles.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("h").alias("x"), "h"))).alias("hashed"))
    miss = lambda n: F.floor((100 - percent) * n / 100)  # noqa: E731  shingles that an item of n may miss
    size_class = F.floor(F.log2(F.size("hashed").cast("double")))
    sketch = ranked.select(
        "item_id",
        F.size("hashed").cast("long").alias("n"),
        F.least(F.size("hashed").cast("long"), miss(F.pow(F.lit(2.0), size_class + 1)) + 1).cast("int").alias("k"),
        "hashed",
    )
    sketch = sketch.select("item_id", F.greatest(F.lit(1), F.col("k") - miss(F.col("n"))).alias("least"), F.explode(F.slice("hashed", F.lit(1), F.col("k"))).alias("o"))
    sketch = written(sketch.select("item_id", "least", F.col("o.h").alias("h")), "sketch")
    keyed = docs.select(key_of(F.col("text")).alias("_key"), "text")
    hits = exploded(with_shingles(keyed, "text", [F.col("_key")]), "_key").join(_sent(sketch, sketch.count()), "h")
    # A text's hits of one item are counted once per shingle, before and after the shuffle.
    candidates = hits.groupBy("_key", "item_id", "h").agg(F.first("least").alias("least")).groupBy("_key", "item_id").agg(F.count("*").alias("hit"), F.first("least").alias("least"))
    candidates = written(candidates.where("hit >= least").select("_key", "item_id"), "candidates")
    rows = candidates.count()
    wanted = candidates.groupBy("_key").agg(F.collect_set(F.struct("item_id")).alias("items"))
    suspects = keyed.join(_sent(wanted, rows), "_key")
    own = exploded(with_shingles(suspects, "text", [F.col("_key"), F.col("items")]), "_key", "items")
    listed = shingles.join(sizes, "item_id")
    found = own.join(_sent(listed, listed.count()), "h").where(F.array_contains("items", F.struct("item_id")))
    exact = found.groupBy("_key", "item_id", "h").agg(F.first("n").alias("n")).groupBy("_key", "item_id").agg(F.first("n").alias("n_shingles"), F.count("*").alias("n_found"))
    return exact.where(F.col("n_found") * 100 >= F.col("n_shingles") * percent), rows


def judged(docs: DataFrame, bench: DataFrame, percent: int = CONTAINED) -> DataFrame:
    """doc_id, contaminated, n_items, item_id and containment (of the best item; -1 and 0 without one) for every row of docs."""
    pairs, bound = contained(docs, bench, percent)
    best = F.max(F.struct((F.col("n_found") / F.col("n_shingles")).alias("c"), (-F.col("item_id")).alias("i")))
    found = pairs.groupBy("_key").agg(F.count("*").alias("n"), best.alias("best"))
    return docs.select("doc_id", key_of(F.col("text")).alias("_key")).join(_sent(found, bound), "_key", "left").select(
        "doc_id",
        F.col("n").isNotNull().alias("contaminated"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(-F.col("best.i"), F.lit(-1)).cast("long").alias("item_id"),
        F.coalesce("best.c", F.lit(0.0)).alias("containment"),
    )


def clean(docs: DataFrame, bench: DataFrame, percent: int = CONTAINED) -> DataFrame:
    """docs without the rows that hold a test item; all columns stay."""
    pairs, bound = contained(docs, bench, percent)
    (key,) = fresh(docs.columns, "_key")
    bad = pairs.select(F.col("_key").alias(key)).distinct()
    return docs.withColumn(key, key_of(F.col("text"))).join(_sent(bad, bound), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
ds AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS s FROM dw),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS s FROM bw),
bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
f AS (SELECT d.doc_id, b.item_id, count(DISTINCT d.s) AS n_found FROM ds d JOIN bs b ON d.s = b.s GROUP BY d.doc_id, b.item_id),
g AS (SELECT f.doc_id, f.item_id, CAST(f.n_found AS DOUBLE) / bn.n AS c FROM f JOIN bn USING (item_id) WHERE f.n_found * 100 >= bn.n * 80),
h AS (SELECT doc_id, count(*) AS n, max(c) AS c FROM g GROUP BY doc_id),
k AS (SELECT h.doc_id, h.n, h.c, min(g.item_id) AS item_id FROM h JOIN g ON g.doc_id = h.doc_id AND g.c = h.c GROUP BY h.doc_id, h.n, h.c)
SELECT d.doc_id, k.n IS NOT NULL AS contaminated, CAST(coalesce(k.n, 0) AS BIGINT) AS n_items, CAST(coalesce(k.item_id, -1) AS BIGINT) AS item_id, coalesce(k.c, 0.0) AS containment
FROM documents d LEFT JOIN k USING (doc_id)
"""
