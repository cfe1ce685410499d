"""Operator 10 [native]: personal data and information-theoretic sanitisation.

Base spans come from four fixed patterns; each value found is a protected entity.  Then
corpus co-occurrence says how strongly a term reveals an entity.  With N different texts
(copies count once, in all four counts), c(e) and c(t) of them holding the entity and the
term, and c(t, e) both, the share of the term's texts that hold the entity is drawn towards the entity's own share by `PRIOR` texts:
p(e | t) = (c(t, e) + PRIOR c(e) / N) / (c(t) + PRIOR), so that little evidence counts for
little, yet entities that are seen once are judged as well.  The information that the
term gives, PMI(t; e) = log2(p(e | t) N / c(e)), is compared with the entity's own,
log2(N / c(e)); a term whose share of it exceeds `DISCLOSURE` is a candidate.

In a table where most texts have words of their own, every such word would be one, though
any other text would have given as many.  So candidates with the same counts c(e), c(t, e)
and c(t) are held against what entities dealt to texts at random would give: with T terms
and E entities of those counts, E T m^k / k! pairs are expected at random, k = c(t, e) and
m = c(e) c(t) / N.  Only where these are at most `CHANCE` of the pairs that are there do the
candidates stand, as spans of kind `term` wherever the term is in a text that holds the entity.
Terms have `LEAST_TERM` characters or more: shorter runs are initials, numbers and particles.

Defined cases: null texts count as empty; terms go by the text, so rows that share a
doc_id each get the spans of their own text and copies get the same spans; empty tables
give empty results; other columns are not read by `scan` and all stay in `sanitise`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.spans import counted, fresh, let, masked, none, replaced, spans, written_out
from rankloom.llm.store import written

DISCLOSURE = 0.8  # share of the entity's information
PRIOR = 1.0  # texts
CHANCE = 0.1  # share of the pairs that chance alone may explain
LEAST_TERM = 4  # characters
SLOTS = 64  # of the table in which a text's words look up the revealing ones

# The patterns of the base kinds, in their order.  Look-behinds and
# possessive groups change no match; they keep long runs linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "term")
WORD = r"[^\x20\x09-\x0D.,;:!?()]+"
BETWEEN = r"[\x20\x09-\x0D.,;:!?()]+"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.reverse(F.filter(F.split(number, ""), lambda c: c != ""))
    each = F.transform(values, lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def small_parts(m: Column) -> Column:
    """Whether all dotted numbers are at most 255, whatever zeros lead."""
    bare = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(F.length(p) <= 3, p).cast("int"), F.lit(999)) <= 255))


def base_spans(text: Column) -> Column:
    email = F.when(text.contains("@"), spans(text, EMAIL, "email", 0, lambda m: F.lit(True))).otherwise(none())
    ip = F.when(text.rlike(r"[0-9]\.[0-9]"), spans(text, IP, "ip", 1, small_parts)).otherwise(none())
    number = lambda m: (F.length(digits(m)) <= 19) & luhn(F.when(F.length(digits(m)) <= 19, digits(m)).otherwise("1"))
    card = F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), spans(text, CARD, "card", 2, number)).otherwise(none())
    phone = F.when(text.contains("+"), spans(text, PHONE, "phone", 3, lambda m: F.length(digits(m)).between(9, 15))).otherwise(none())
    return F.array_sort(F.concat(email, ip, card, phone))


def terms_of(text: Column) -> Column:
    """The different words of a text that can be terms, in lower case."""
    return F.filter(F.array_distinct(F.split(F.lower(text), BETWEEN)), lambda w: F.length(w) >= LEAST_TERM)


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, ct): different texts that hold each term; the term "" stands for all texts."""
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("_text")).distinct()
    words = texts.select(F.explode_outer(F.concat(F.array(F.lit("")), terms_of(F.col("_text")))).alias("term"))
    return written(words.groupBy("term").agg(F.count("*").alias("ct")), "terms")


def private_texts(docs: DataFrame) -> DataFrame:
    """(_h, entities, terms) of each different text with a base span."""
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("_text")).withColumn("_base", base_spans(F.col("_text"))).where(F.size("_base") > 0).groupBy(F.md5(F.col("_text").cast("binary")).alias("_h")).agg(F.first("_text").alias("_text"), F.first("_base").alias("_base"))
    entity = lambda b: F.xxhash64(b["kind"], F.lower(F.substring("_text", b["start"].cast("int") + 1, (b["end"] - b["start"]).cast("int"))))
    return written(rows.select("_h", F.array_distinct(F.transform("_base", entity)).alias("entities"), terms_of(F.col("_text")).alias("terms")), "private")


def revealing(docs: DataFrame) -> DataFrame:
    """(_h, _reveal): the terms of a text that disclose one of its entities.

    Terms too frequent to disclose even the most frequent entity go before they meet any,
    so the rows made are those of texts with their rare terms, not of entities with terms.
    """
    common, private = term_counts(docs), private_texts(docs)
    n = float(max([r["ct"] for r in common.where("term = ''").collect()], default=1))
    total = F.lit(n)
    held = private.select("_h", F.explode_outer("entities").alias("entity")).where("entity is not null")
    seen = held.groupBy("entity").agg(F.count("*").alias("ce"), F.min("_h").alias("home"))
    # Entities of one text alone share all counts with each other, so one stands for all.
    once = seen.where("ce = 1").groupBy("home").agg(F.min("entity").alias("entity")).select(F.col("home").alias("_h"), "entity", F.lit(1).cast("long").alias("ce"))
    more = held.join(seen.where("ce > 1").select("entity", "ce"), "entity").select("_h", "entity", "ce")
    judged = written(once.unionByName(more), "judged")
    most = judged.agg(F.max("ce")).first()[0] or 1
    # c(t, e) is c(e) at most, so a term with more texts than this has no entity to disclose.
    bound = lambda ce: ce * (1 + PRIOR / total) * F.pow(total / ce, F.lit(1 - DISCLOSURE)) - PRIOR
    rare = common.where((F.col("term") != "") & (F.col("ct") <= bound(F.lit(float(most)))))
    terms = private.select("_h", F.explode_outer("terms").alias("term")).where("term is not null").join(rare, "term")
    words = written(terms.join(judged, "_h").where(F.col("ct") <= bound(F.col("ce"))).select("_h", "entity", "ce", "term", "ct"), "met")
    pairs = written(words.groupBy("entity", "term").agg(F.count("*").alias("both"), F.first("ce").alias("ce"), F.first("ct").alias("ct")), "pairs")
    share = (F.col("both") + PRIOR * F.col("ce") / total) / (F.col("ct") + PRIOR)
    same = pairs.groupBy("ce", "both", "ct").agg(F.count("*").alias("there")).where(F.log2(share * total / F.col("ce")) > DISCLOSURE * F.log2(total / F.col("ce")))
    of_entities = judged.select("entity", "ce").distinct().groupBy("ce").agg(F.count("*").alias("n_entities"))
    of_terms = rare.groupBy("ct").agg(F.count("*").alias("n_terms"))
    k = F.col("both").cast("double")
    chance = F.col("n_entities") * F.col("n_terms") * F.pow(F.col("ce") * F.col("ct") / total, k) / F.factorial(F.least("both", F.lit(20)).cast("int"))
    stand = same.join(of_entities, "ce").join(of_terms, "ct").where(chance <= CHANCE * F.col("there")).select("ce", "both", "ct")
    told = pairs.join(stand, ["ce", "both", "ct"]).select("entity", "term")
    return words.select("_h", "entity", "term").join(told, ["entity", "term"]).groupBy("_h").agg(F.collect_set("term").alias("_reveal"))


def term_spans(text: Column, reveal: Column) -> Column:
    """Spans of the words of a text that are in reveal, in any case of letters."""
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int")  # noqa: E731  a word is looked up among those of its slot
    table = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.filter(reveal, lambda w: slot(w) == i))
    return let(table, lambda t: spans(text, WORD, "term", 4, lambda m: F.array_contains(F.get(t, slot(F.lower(m))), F.lower(m))))


def found(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """`keep`, and three columns beside: text, base spans, and all spans; the names of the three.

    Terms are looked for in what the base spans leave.  Only rows with base spans meet
    the terms, so the other texts are not moved.
    """
    text, base, every, digest, own = fresh(keep, "_text", "_base", "_spans", "_digest", "_own")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("text"), F.lit("")).alias(text)).withColumn(base, base_spans(F.col(text)))
    told = revealing(docs).withColumnsRenamed({"_h": digest, "_reveal": own})
    held = rows.where(F.size(base) > 0).withColumn(digest, F.md5(F.col(text).cast("binary"))).join(told, digest, "left")
    terms = F.when(F.col(own).isNull(), none()).otherwise(term_spans(masked(F.col(text), F.col(base)), F.col(own)))
    kept = [*[F.col(f"`{c}`") for c in keep], F.col(text), F.col(base)]
    both = held.select(*kept, F.array_sort(F.concat(base, terms)).alias(every))
    return both.unionByName(rows.where(F.size(base) == 0).select(*kept, F.col(base).alias(every))), [text, base, every]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, digest of the base and all spans of every row of docs."""
    rows, (_, base, every) = found(docs.select("doc_id", "text"), ["doc_id"])
    return rows.select(
        "doc_id",
        *[counted(F.col(base), k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(written_out(F.col(base)).cast("binary"), 256).alias("base_sha256"),
        written_out(F.col(every)).alias("spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data generalised to its kind, as [EMAIL], and revealing terms removed, as [TERM]; null texts stay null."""
    rows, (text, _, every) = found(docs, docs.columns)
    (clean,) = fresh(rows.columns, "_clean")
    changed = F.col("text").isNotNull() & (F.size(every) > 0)
    rows = rows.withColumn(clean, F.when(changed, replaced(F.col(text), F.col(every), lambda kind, n: F.concat(F.lit("["), F.upper(kind), F.lit("]")))))
    return rows.select(*[(F.coalesce(clean, "text").alias("text") if c == "text" else F.col(f"`{c}`")) for c in docs.columns])
