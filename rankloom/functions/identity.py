"""Content hashes that name items and their embedding texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.text import norm_text


def collapsed(x: Column) -> Column:
    return F.regexp_replace(norm_text(x), r"(?U)\s+", " ")


def amount_part(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.2f", x)).otherwise("")


def deadline_part(x: Column) -> Column:
    """ISO date of a date, timestamp or parseable string; otherwise the lower-cased text."""
    text = x.cast("string")
    return F.coalesce(F.try_to_timestamp(text).cast("date").cast("string"), norm_text(text))


def domain_part(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))), r"^www\.", ""), F.lit(""))


def canonical_id() -> Column:
    """SHA-1 over title, sponsor, amounts, deadline and source domain."""
    c = F.col
    return F.sha1(F.concat_ws("|", collapsed(c("title")), collapsed(c("sponsor")), amount_part(c("amount_min")), amount_part(c("amount_max")), deadline_part(c("deadline")), domain_part(c("source_url"))))


def embedding_key(id_col: str = "item_id") -> Column:
    """SHA-1 over the id and the five text fields, empty ones kept."""
    fields = F.concat_ws(" | ", *[norm_text(F.col(f)) for f in ("title", "sponsor", "description", "eligibility_text", "essay_prompt")])
    return F.sha1(F.concat(norm_text(F.col(id_col)), F.lit("|"), fields))
