"""Text similarity: TF-IDF cosine and embedding cosine, and the embedding store."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.store import written

TEXTS_A_TASK = 20_000

# English stop words that terms are filtered by: the default of a parameter.
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can cannot could did do "
    "does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself me more most "
    "my no nor not of off on once only or other our ours out over own same she should so some such than that the their theirs them then there these "
    "they this those through to too under until up very was we were what when where which while who whom why will with would you your yours"
).split()


def terms(text: Column, stop_words=tuple(STOP_WORDS)) -> Column:
    """Words of two or more word characters (Unicode) without stop words, and their bigrams."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w{2,}"), F.lit(0)), lambda w: ~w.isin(*stop_words))
    two = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, two)


def term_counts(rows: DataFrame, key: str, stop_words=tuple(STOP_WORDS)) -> DataFrame:
    """(key, term, tf) of (key, text)."""
    return rows.select(key, F.explode_outer(terms(F.col("text"), stop_words)).alias("term")).where("term is not null").groupBy(key, "term").agg(F.count("*").alias("tf"))


def tfidf(pairs: DataFrame, items: DataFrame, profiles: DataFrame, stop_words=tuple(STOP_WORDS)) -> DataFrame:
    """(profile_id, item_id, text_sim) of pairs (profile_id, item_id); items: item_id, text; profiles: profile_id, text."""
    mine = pairs.select("profile_id", F.col("item_id").alias("kind"))
    held = items.select(F.col("item_id").alias("kind"), F.col("item_id").alias("text_id"), F.lit(1).alias("n"))
    sims = tfidf_texts(mine, held, items.withColumnRenamed("item_id", "text_id"), profiles, stop_words).withColumnRenamed("text_id", "item_id")
    return pairs.select("profile_id", "item_id").join(sims, ["profile_id", "item_id"], "left").withColumn("text_sim", F.coalesce("text_sim", F.lit(0.0)))


def tfidf_texts(kinds: DataFrame, held: DataFrame, texts: DataFrame, profiles: DataFrame, stop_words=tuple(STOP_WORDS)) -> DataFrame:
    """(profile_id, text_id, text_sim) of the texts with terms that a profile's items have.

    kinds: profile_id, kind of its items; held: kind, text_id, n items of that kind with that
    text; texts: text_id, text; profiles: profile_id, text.  The corpus of a profile is its own
    text and its items; idf = ln((1+n)/(1+df)) + 1, raw counts, L2 norm, dot product.  Texts are
    cut once, document frequencies are sums over kinds, and each text is weighed once a
    profile, in tasks that hold a profile's terms and up to about TEXTS_A_TASK texts.
    """
    counted, mine = term_counts(texts, "text_id", stop_words), term_counts(profiles, "profile_id", stop_words)
    numbers = written(counted.select("term").union(mine.select("term")).distinct().withColumn("term_no", F.monotonically_increasing_id()), "terms")
    cut, own = written(counted.join(numbers, "term").drop("term"), "cut"), mine.join(numbers, "term").drop("term")
    by_kind = held.join(cut, "text_id").groupBy("kind", "term_no").agg(F.sum("n").alias("df"))
    n = kinds.join(held.groupBy("kind").agg(F.sum("n").alias("n")), "kind").groupBy("profile_id").agg((F.sum("n") + 1).alias("n"))
    seen = kinds.join(by_kind, "kind").select("profile_id", "term_no", "df", F.lit(0).cast("long").alias("own"))
    said = own.select("profile_id", "term_no", F.lit(1).cast("long").alias("df"), F.col("tf").alias("own"))
    df = seen.unionByName(said).groupBy("profile_id", "term_no").agg(F.sum("df").alias("df"), F.sum("own").alias("own"))
    known = df.join(n, "profile_id").select("profile_id", "term_no", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"), "own")
    parts = max(1, -(-texts.count() // TEXTS_A_TASK))
    bags = cut.groupBy("text_id").agg(F.collect_list(F.struct("term_no", "tf")).alias("t"))  # the terms of one text
    bags = bags.select("text_id", F.col("t.term_no").alias("terms"), F.col("t.tf").alias("tfs"), F.pmod(F.xxhash64("text_id"), F.lit(parts)).cast("int").alias("part"))
    met = kinds.join(held.select("kind", "text_id"), "kind").select("profile_id", "text_id").distinct().join(bags, "text_id")
    dealt = known.select(F.col("profile_id").alias("to"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("to_part"), "term_no", "idf", "own")
    schema = T.StructType([met.schema["profile_id"], met.schema["text_id"], T.StructField("s", T.DoubleType())])
    sums = met.groupBy("profile_id", "part").cogroup(dealt.groupBy("to", "to_part")).applyInArrow(_cosines, schema)
    return sums.select("profile_id", "text_id", F.least(F.greatest(F.coalesce(F.round("s", 9), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("text_sim"))


def _cosines(texts: pa.Table, known: pa.Table) -> pa.Table:
    """Texts (terms, tfs) of one profile beside their cosine with it; known: term_no, idf and the profile's own count of each term."""
    ids = known.column("term_no").to_numpy()
    order = np.argsort(ids)
    ids, idf, own = ids[order], known.column("idf").to_numpy()[order], known.column("own").to_numpy()[order]
    length = np.sqrt(np.sum((own * idf) ** 2))
    terms, tfs = texts.column("terms").combine_chunks(), texts.column("tfs").combine_chunks()
    row = np.repeat(np.arange(len(terms)), terms.value_lengths().to_numpy(zero_copy_only=False))
    at = np.searchsorted(ids, terms.flatten().to_numpy())
    w = tfs.flatten().to_numpy() * idf[at]
    s2, s = np.bincount(row, w * w, len(terms)), np.bincount(row, w * (own * idf)[at], len(terms))
    below = np.sqrt(s2) * length
    return pa.table([texts.column("profile_id"), texts.column("text_id"), pa.array(np.divide(s, below, out=np.zeros(len(s)), where=below > 0))], names=["profile_id", "text_id", "s"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    """A vector scaled to length one; a zero vector stays."""
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v)


def missing_keys(items: DataFrame, store: DataFrame) -> DataFrame:
    """Items whose embedding_key is not in the store."""
    return items.join(store.select("embedding_key"), "embedding_key", "left_anti")


def upserted(store: DataFrame, new: DataFrame) -> DataFrame:
    """One row per key, new rows before old, in key order."""
    both = new.withColumn("_new", F.lit(1)).unionByName(store.withColumn("_new", F.lit(0)))
    w = Window.partitionBy("embedding_key").orderBy(F.desc("_new"), "item_id")
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_new", "_rn").orderBy("embedding_key")


def encoded(items: DataFrame, text_col: str, encode: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """items with `vector` (unit length) by any encoder; Arrow batches, the encoder is built in the worker."""
    from collections.abc import Iterator

    import pandas as pd

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(encode(texts.fillna("").tolist()))

    return items.withColumn("vector", unit(vectors(F.col(text_col))))
