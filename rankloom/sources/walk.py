"""Every string inside JSON of any shape, by levels of VARIANT values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.store import written


def json_strings(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """(value): the strings that are values anywhere in JSON texts, escapes decoded; keys are no values.

    A round takes apart one level of arrays and objects, so the plan of a round does not
    depend on how deep the JSON goes.  Texts that are no JSON, or null, give nothing.
    """
    spark = payloads.sparkSession
    text = F.regexp_replace(F.col(raw).cast("string"), "^\\s*\ufeff?\\s*", "")
    level = written(payloads.select(F.try_parse_json(text).alias("v")).where("v is not null"), "json")
    out = None
    while True:
        # Containers have no string of their own; numbers and flags are told from strings by their type.
        kind = F.schema_of_variant("v")
        found = level.where(kind == "STRING").select(F.variant_get("v", "$", "string").alias("value"))
        out = found if out is None else out.unionByName(found)
        inner = level.where(kind.startswith("ARRAY") | kind.startswith("OBJECT"))
        level = written(spark.sql("SELECT e.value AS v FROM {rows} r, LATERAL variant_explode(r.v) e", rows=inner), "json")
        if not level.limit(1).count():
            return out
