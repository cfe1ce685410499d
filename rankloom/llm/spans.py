"""Spans of pattern matches as DataFrame expressions.

A span is struct<start, kind_at, end, kind>: code points, end exclusive; kind_at is the
place of the kind in its list, so that spans order by start and then kind.

An array that grows inside `aggregate` is copied at each step, and `substring` walks a
text from its start.  So that texts with very many matches stay cheap, sums run along
parts of `PART` elements, and pieces are cut from chunks of `CHUNK` characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,kind_at:int,end:bigint,kind:string>"
NONE = f"array<{SPAN}>"
PART = 128
CHUNK = 1024


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column of `taken` has it."""
    low, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in low:
            name = "_" + name
        low.add(name.lower())
        out.append(name)
    return out


def none() -> Column:
    return F.array().cast(NONE)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(x: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of bigint >= 0, op over all up to it; part by part, each from where the parts before it end."""
    nil = F.lit(0).cast("bigint")

    def along(part: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(op(acc["at"], v))).alias("out"))
        return F.aggregate(part, zero, step, lambda acc: acc["out"])

    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(PART)), lambda i: F.slice(x, i + 1, PART))
    starts = F.concat(F.array(nil), along(F.transform(parts, lambda part: F.aggregate(part, nil, op)), nil))
    return F.flatten(F.zip_with(parts, F.slice(starts, F.lit(1), F.size(parts)), along))


def spans(text: Column, pattern: str, kind: str, kind_at: int, keep) -> Column:
    """The leftmost non-overlapping matches of a pattern that never matches "", less those that fail keep(match).

    The gaps between matches (split) and the matches themselves alternate, so their
    lengths add up to positions.
    """
    long = lambda x: F.length(x).cast("bigint")
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(long(gap).alias("gap"), long(m).alias("n"), (m.isNotNull() & F.coalesce(keep(m), F.lit(False))).alias("keep")))

    def placed(ps: Column) -> Column:
        ends = running(F.transform(ps, lambda p: p["gap"] + F.coalesce(p["n"], F.lit(0))), lambda a, b: a + b)
        span = lambda p, e: F.struct((e - p["n"]).alias("start"), F.lit(kind_at).alias("kind_at"), e.alias("end"), F.when(p["keep"], kind).alias("kind"))
        return F.filter(F.zip_with(ps, ends, span), lambda s: s["kind"].isNotNull())

    return let(pieces, placed).cast(NONE)


def counted(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def written_out(found: Column) -> Column:
    """kind:start:end of each span, by start and then kind, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: Column, found: Column, label, longer=lambda n: F.lit("")) -> Column:
    """The text with each span replaced by label(kind, length); where a span begins inside an earlier one, its n characters past that become longer(n)."""
    int_ = lambda x: x.cast("int")

    def cut(chunks, lo, hi):
        """Characters lo up to hi, out of the chunks that hold them."""
        first = F.floor(lo / CHUNK)
        return F.substring(F.array_join(F.slice(chunks, int_(first + 1), int_(F.floor(hi / CHUNK) - first + 1)), ""), int_(lo - first * CHUNK + 1), int_(hi - lo))

    def body(chunks):
        ends = F.transform(found, lambda s: s["end"])
        before = F.concat(F.array(F.lit(0).cast("bigint")), running(ends, lambda a, b: F.greatest(a, b)))
        whole = lambda s, at: F.concat(cut(chunks, at, s["start"]), label(s["kind"], s["end"] - s["start"]))
        piece = lambda s, at: F.when(s["start"] >= at, whole(s, at)).otherwise(longer(F.greatest(s["end"] - at, F.lit(0))))
        return F.array_join(F.zip_with(found, F.slice(before, F.lit(1), F.size(found)), piece), "")

    chunks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))
    rest = F.substring(text, int_(F.array_max(F.transform(found, lambda s: s["end"])) + 1), F.length(text))
    return F.when(F.size(found) == 0, text).otherwise(F.concat(let(chunks, body), rest))


def masked(text: Column, found: Column) -> Column:
    """The text with its spans blank, so that nothing in them is matched again and all positions stay."""
    blank = lambda n: F.repeat(F.lit(" "), n.cast("int"))
    return replaced(text, found, lambda kind, n: blank(n), blank)
