"""Embedding models by name, the path of their store, and looking vectors up."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rankloom.functions import identity, text
from rankloom.operators.similarity import unit
from rankloom.store import written

# The default model and what its short name stands for.
DEFAULT_MODEL = "all-MiniLM-L6-v2"
ALIASES = {DEFAULT_MODEL: "sentence-transformers/all-MiniLM-L6-v2"}
BUCKETS = 256  # of a store, by the hash of the key
BATCH = 32  # texts that an encoder gets at once
STORED = "embedding_key string, item_id string, vector array<float>, bucket int"
_ENCODERS: dict[str, Callable] = {}
_MAKERS: dict[str, Callable[[], Callable]] = {}


def model_name(name: str | None) -> str:
    """The full name: an alias resolved, nothing as the default."""
    bare = (name or "").strip() or DEFAULT_MODEL
    return ALIASES.get(bare, bare)


def store_path(root: str, name: str | None) -> str:
    """The folder of a model's vectors, with other characters than letters, digits, dot, hyphen as underscores."""
    return f"{root.rstrip('/')}/embeddings/{re.sub(r'[^A-Za-z0-9._-]+', '_', model_name(name)).strip('_')}"


def register(name: str, make: Callable[[], Callable[[list[str]], list[list[float]]]]) -> None:
    _MAKERS[model_name(name)] = make


def encoder(name: str | None) -> Callable[[list[str]], list[list[float]]]:
    """The encoder of a model, made once a process."""
    full = model_name(name)
    if full not in _ENCODERS:
        if full not in _MAKERS:
            raise ModuleNotFoundError(f"no encoder is registered for {full}")
        _ENCODERS[full] = _MAKERS[full]()
    return _ENCODERS[full]


def looked_up(items: DataFrame, store: DataFrame) -> DataFrame:
    """items with their `vector` by embedding_key; raises where an item's key is not in the store."""
    both = items.join(store.select("embedding_key", "vector"), "embedding_key", "left")
    missing = F.raise_error(F.concat(F.lit("no vector for "), F.coalesce("embedding_key", F.lit("null"))))
    return both.withColumn("vector", F.when(F.col("vector").isNull(), missing).otherwise(F.col("vector")))


def encoded(rows: DataFrame, name: str | None, batch: int = BATCH) -> DataFrame:
    """(embedding_key, item_id, vector) of rows (embedding_key, item_id, text), of unit length; a zero vector stays.

    The encoder is made once a worker and gets `batch` texts at a time, whatever Arrow brings.
    """
    full = model_name(name)
    if full not in _MAKERS:
        raise ModuleNotFoundError(f"no encoder is registered for {full}")
    make = _MAKERS[full]

    def run(batches):
        register(full, make)
        encode = encoder(full)
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                vectors = encode([t or "" for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(vectors, pa.list_(pa.float32()))], ["embedding_key", "item_id", "vector"])

    out = rows.select("embedding_key", "item_id", "text").mapInArrow(run, "embedding_key string, item_id string, vector array<float>")
    return out.withColumn("vector", unit(F.transform("vector", lambda x: x.cast("double"))).cast("array<float>"))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a store; none where there is no store yet."""
    try:
        return spark.read.schema(STORED).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], STORED)


def upsert(spark: SparkSession, path: str, new: DataFrame) -> int:
    """Puts new rows (embedding_key, item_id, vector) into a store, one a key, new before old; the number of buckets that were written.

    Only buckets that get a row are read and written again, each whole or not at all.
    """
    rows = written(new.select("embedding_key", "item_id", "vector", F.pmod(F.xxhash64("embedding_key"), F.lit(BUCKETS)).cast("int").alias("bucket")), "new")
    touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # BUCKETS at most
    if not touched:
        return 0
    old = stored(spark, path).where(F.col("bucket").isin(touched))
    both = rows.withColumn("_old", F.lit(0)).unionByName(old.withColumn("_old", F.lit(1)))
    first = Window.partitionBy("embedding_key").orderBy("_old", "item_id")
    merged = both.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_old", "_rn")
    whole = written(merged, "merged")  # what is read is not what is written over
    dealt = whole.repartition("bucket").sortWithinPartitions("bucket", "embedding_key")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return len(touched)


def ensure_store(items: DataFrame, root: str, name: str | None = None, batch: int = BATCH) -> tuple[DataFrame, int]:
    """(items with their embedding_key, how many vectors had to be made): only keys that the model's store lacks are encoded."""
    spark, path = items.sparkSession, store_path(root, name)
    keyed = items if "embedding_key" in items.columns else items.withColumn("embedding_key", identity.embedding_key())
    rows = keyed.select("embedding_key", "item_id", text.item_text().alias("text")).dropDuplicates(["embedding_key"])
    missing = written(rows.join(stored(spark, path).select("embedding_key"), "embedding_key", "left_anti"), "missing")
    n = missing.count()
    if n:
        upsert(spark, path, encoded(missing, name, batch))
    return keyed, n
