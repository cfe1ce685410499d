"""Operator 9 [native]: secret scans with character Markov models.

Base spans come from three fixed patterns.  Beside them, tokens are scored by two
first-order Markov models over characters, one of random strings and one of ordinary
identifiers and words; a token whose log-likelihood ratio says "random" is a span of
kind `markov`.  The models are trained from random strings made from digests, and from
the words of all documents, digits kept and base spans taken out, together with a fixed
list of identifiers and with decimal numbers.  The documents are not labelled and hold secrets of their own, which
would pass for ordinary; so a first model of plain words (letters in one case) and the
labelled negatives leaves out of the second those words that it takes for random.  The
least ratio a character is what all but `MISSED` of held-out random strings reach.

Defined cases: null texts count as empty and have no spans; rows are independent, so
repeated rows each get theirs; empty tables give empty results; other columns are not
read by `scan` and all stay in `redact`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.spans import counted, fresh, masked, none, replaced, spans, written_out
from rankloom.llm.store import written

RANDOM_ROWS = 4_000
LEAST_CHARS = 8  # as in the assign pattern
BACK_OFF = 2.0
LEAST_RATIO = 8.0  # nats over the whole token
LEAST_MEAN = 0.35  # nats a character, whatever the held-out strings say
MISSED = 0.01  # share of held-out random strings

# The patterns of the base kinds, in their order.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
PLAIN = "^(?:[A-Z]?[a-z]+|[A-Z]+)$"
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_CHARS},}}"

# Ordinary identifiers, the labelled negatives beside the corpus's own words.
IDENTIFIERS = (
    "getElementById", "addEventListener", "configuration_directory", "DEFAULT_CONNECTION_TIMEOUT", "user_authentication_service",
    "maximum_retry_attempts", "createOrReplaceTempView", "http-response-status-code", "background-color-transition", "application/x-www-form-urlencoded",
    "internationalization", "NullPointerException", "AbstractBeanFactoryAwareProcessor", "test_parse_returns_empty_list", "src/main/resources/application",
    "content-security-policy", "last_modified_timestamp", "ProductCategoryRepository", "customer_shipping_address", "requirements-development",
    "quarterly-results-overview-2021", "2018-11-30T23-59-59-GMT", "/2017/08/25/another-blog-entry", "invoice_id_00098765432", "release-notes-v10-4-12",
    "python3-numpy-1-26-4", "chapter_07_section_03", "2022-06-01", "20230914", "utf8mb4_general_ci", "windows-server-2016", "555-0100",
)
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"


def base_spans(text: Column) -> Column:
    low = F.lower(text)
    named = F.lit(False)
    for word in ("passw", "secret", "token", "api"):
        named = named | low.contains(word)
    assign = F.when(named, spans(text, ASSIGN, "assign", 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 8)).otherwise(none())
    access = F.when(text.contains("AKIA"), spans(text, ACCESS, "access", 1, lambda m: F.lit(True))).otherwise(none())
    hexes = F.when(text.rlike(HEX), spans(text, HEX, "hex", 2, lambda m: F.lit(True))).otherwise(none())
    return F.array_sort(F.concat(assign, access, hexes))


def random_strings(spark: SparkSession, first: int = 0) -> DataFrame:
    """(token, random, n): generated random strings, by RANDOM_ROWS ids from first on."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    return spark.range(first, first + RANDOM_ROWS).select(F.when(F.col("id") % 3 == 0, digest).when(F.col("id") % 3 == 1, mixed).otherwise(F.upper(F.substring(mixed, 1, 24))).alias("token"), F.lit(True).alias("random"), F.lit(1).cast("long").alias("n"))


def identifiers(spark: SparkSession) -> DataFrame:
    """(token, random, n): the labelled negatives: fixed identifiers, and generated decimal numbers."""
    number = F.pmod(F.xxhash64("id"), F.lit(10**16)).cast("string")
    numbers = spark.range(RANDOM_ROWS).select(number.alias("token"), F.lit(False).alias("random"), F.lit(1).cast("long").alias("n"))
    fixed = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in IDENTIFIERS])).alias("token"), F.lit(False).alias("random"), F.lit(1).cast("long").alias("n"))
    return fixed.unionByName(numbers)


def ordinary_words(docs: DataFrame) -> DataFrame:
    """(token, random, n): the words of all documents outside base spans, with their numbers."""
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("_text")).withColumn("_base", base_spans(F.col("_text")))
    tokens = rows.select(F.explode_outer(F.split(masked(F.col("_text"), F.col("_base")), r"[^A-Za-z0-9+/_=-]+")).alias("token")).where("length(token) >= 4")
    return tokens.groupBy("token").agg(F.count("*").alias("n")).select("token", F.lit(False).alias("random"), "n")


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each ordered pair of symbols, random over ordinary, as a flat table."""
    n = len(SYMBOLS)
    chars = F.split("token", "")
    beside = F.zip_with(chars, F.slice(chars, F.lit(2), F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    at = samples.select("random", "n", F.explode_outer(beside).alias("p")).select("random", "n", F.instr(F.lit(SYMBOLS), F.col("p.a")).alias("a"), F.instr(F.lit(SYMBOLS), F.col("p.b")).alias("b"))
    seen = {True: [[0.0] * n for _ in range(n)], False: [[0.0] * n for _ in range(n)]}
    for r in at.where("a > 0 and b > 0").groupBy("random", "a", "b").agg(F.sum("n").alias("n")).collect():  # at most 2 * len(SYMBOLS) ** 2 rows
        seen[r["random"]][r["a"] - 1][r["b"] - 1] += r["n"]

    def model(rows: list[list[float]]) -> list[list[float]]:
        """Probabilities of the next symbol, backed off to the symbol's own share."""
        total = sum(map(sum, rows))
        share = [(sum(row[b] for row in rows) + 0.5) / (total + 0.5 * n) for b in range(n)]
        return [[(row[b] + BACK_OFF * share[b]) / (sum(row) + BACK_OFF) for b in range(n)] for row in rows]

    random, ordinary = model(seen[True]), model(seen[False])
    table = [round(math.log(random[a][b] / ordinary[a][b]), 6) for a in range(n) for b in range(n)]
    return table


def as_array(table: list[float]) -> Column:
    """The table as one constant, however long."""
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")


def ratio(token: Column, table: Column) -> Column:
    """The log-likelihood ratio of a token's characters."""
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    start = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum"))
    n = len(SYMBOLS)

    def step(acc, c):
        gain = F.when((acc["before"] >= 0) & (c >= 0), F.get(table, acc["before"] * n + c)).otherwise(F.lit(0.0))
        return F.struct(c.alias("before"), (acc["sum"] + gain).alias("sum"))

    return F.aggregate(codes, start, step, lambda acc: acc["sum"])


def found(docs: DataFrame, model: tuple[list[float], float], keep: list[str]) -> tuple[DataFrame, list[str]]:
    """`keep`, and three columns beside: text, base spans, and all spans; the names of the three.

    Tokens are looked for in what the base spans leave.
    """
    table, least = model
    text, base, every = names = fresh(keep, "_text", "_base", "_spans")
    weights = as_array(table)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("text"), F.lit("")).alias(text)).withColumn(base, base_spans(F.col(text)))
    random = spans(masked(F.col(text), F.col(base)), TOKEN, "markov", 3, lambda m: is_random(m, weights, least))
    more = F.when(F.col(text).rlike(TOKEN), random).otherwise(none())
    return rows.withColumn(every, F.array_sort(F.concat(base, more))), names


def is_random(token: Column, table: Column, least: float) -> Column:
    return ratio(token, table) >= F.greatest(F.lit(LEAST_RATIO), F.length(token) * least)


def least_mean(spark: SparkSession, table: list[float]) -> float:
    """The ratio a character that all but MISSED of random strings outside the training reach, LEAST_MEAN at least."""
    held = random_strings(spark, RANDOM_ROWS).select(F.xxhash64("token").alias("x"), "token").select(F.substring(F.col("token"), F.lit(1), (F.pmod("x", F.lit(33)) + LEAST_CHARS).cast("int")).alias("token"))
    mean = ratio(F.col("token"), as_array(table)) / F.length("token")
    return max(LEAST_MEAN, held.agg(F.percentile(mean, F.lit(MISSED)).alias("q")).collect()[0]["q"])


def models(docs: DataFrame) -> tuple[list[float], float]:
    """The table of ratios, and the least ratio a character."""
    spark = docs.sparkSession
    labelled = random_strings(spark).unionByName(identifiers(spark))
    words = written(ordinary_words(docs.select("text")), "words")
    first = train(labelled.unionByName(words.where(F.col("token").rlike(PLAIN))))
    table = as_array(first)
    second = train(labelled.unionByName(words.where(F.col("token").rlike(PLAIN) | ~is_random(F.col("token"), table, least_mean(spark, first)))))
    return second, least_mean(spark, second)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, digest of the base and all spans of every row of docs."""
    rows, (_, base, every) = found(docs.select("doc_id", "text"), models(docs), ["doc_id"])
    return rows.select(
        "doc_id",
        *[counted(F.col(base), k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(written_out(F.col(base)).cast("binary"), 256).alias("base_sha256"),
        written_out(F.col(every)).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every secret replaced by [SECRET] and n_chars, where there is one, counted anew; null texts stay null."""
    rows, (text, _, every) = found(docs, models(docs), docs.columns)
    (clean,) = fresh(rows.columns, "_clean")
    changed = F.col("text").isNotNull() & (F.size(every) > 0)
    rows = rows.withColumn(clean, F.when(changed, replaced(F.col(text), F.col(every), lambda kind, n: F.lit("[SECRET]"))))
    out = {"text": F.coalesce(clean, "text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.coalesce(F.length(clean).cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return rows.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
