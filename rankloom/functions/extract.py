"""Fields out of HTML and free text as Column expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
NAMES = json.dumps({name[:-1]: char for name, char in html5.items() if name.endswith(";")})
MONEY = r"\$\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)"


def unescaped(x: Column) -> Column:
    """Named and numeric character references as their characters; unknown ones stay."""
    names = F.from_json(F.lit(NAMES), "map<string,string>")
    code = lambda n: F.when(n.rlike("^#[xX]"), F.conv(F.substring(n, 3, 6), 16, 10)).when(n.startswith("#"), F.substring(n, 2, 7)).cast("int")
    valid = lambda c: c.between(1, 0x10FFFF) & ~c.between(0xD800, 0xDFFF)
    char = lambda c: F.when(valid(c), F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"))
    known = lambda n: F.coalesce(F.try_element_at(names, n), char(code(n)), F.concat(F.lit("&"), n, F.lit(";")))
    pieces = F.zip_with(F.split(x, ENTITY, -1), F.regexp_extract_all(x, F.lit(ENTITY), F.lit(1)), lambda gap, n: F.concat(gap, F.when(n.isNull(), "").otherwise(known(n))))
    return F.when(x.contains("&"), F.array_join(pieces, "")).otherwise(x)


def spaced(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def html_text(html: Column) -> Column:
    """Script and style dropped, tags as spaces, entities unescaped, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script\b.*?</script>", " "), r"(?is)<style\b.*?</style>", " ")
    return spaced(unescaped(F.regexp_replace(bare, r"(?s)<[^>]+>", " ")))


def clean_text(x: Column) -> Column:
    """Entities first, then tags."""
    return spaced(F.regexp_replace(unescaped(x), r"(?s)<[^>]+>", " "))


HREF = r"(?is)^<a\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\shref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
ANCHOR = r"(?is)<a\b(?=(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\shref\s*=)(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?</a\s*>"


def anchors(html: Column) -> Column:
    """array<struct<href, text>> of the links: href in any quoting or none, its entities and those of the text as their characters.

    The text of nested elements is joined by spaces; comments hold no links.
    """
    found = F.regexp_extract_all(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), F.lit(ANCHOR), F.lit(0))
    href = lambda a: F.trim(unescaped(F.regexp_replace(F.regexp_extract(a, HREF, 1), r"^[\"']|[\"']$", "")))
    body = lambda a: F.regexp_replace(a, r"(?is)^<a\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", "")
    return F.transform(found, lambda a: F.struct(href(a).alias("href"), spaced(unescaped(F.regexp_replace(body(a), r"(?s)<[^>]+>", " "))).alias("text")))


def meta_content(html: Column, name: str) -> Column:
    """The content of the meta element of that name or property, attributes in any order; "" without one."""
    tag = F.regexp_extract(html, rf"(?is)<meta\b(?=[^>]*(?:name|property)\s*=\s*[\"']{name}[\"'])[^>]*>", 0)
    return F.regexp_replace(F.regexp_extract(tag, r"(?is)content\s*=\s*(\"[^\"]*\"|'[^']*')", 1), r"^.|.$", "")


def title(html: Column, suffix: str = "") -> Column:
    """og:title, else the first h1, else the title element without its suffix."""
    og = meta_content(html, "og:title")
    h1 = html_text(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    head = html_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    if suffix:
        head = F.trim(F.replace(head, F.lit(suffix), F.lit("")))
    return F.coalesce(F.nullif(spaced(unescaped(og)), F.lit("")), F.nullif(h1, F.lit("")), head)


def description(html: Column) -> Column:
    """Meta description, else the first paragraph of 30 characters or more, else empty."""
    meta = meta_content(html, "description")
    paragraphs = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), html_text)
    return F.coalesce(F.nullif(spaced(unescaped(meta)), F.lit("")), F.get(F.filter(paragraphs, lambda p: F.length(p) >= 30), 0), F.lit(""))


def amounts(text: Column) -> Column:
    """struct<low, high> of the dollar amounts, nulls without any."""
    found = F.transform(F.regexp_extract_all(text, F.lit(MONEY), F.lit(1)), lambda a: F.replace(a, F.lit(","), F.lit("")).try_cast("double"))
    return F.struct(F.array_min(found).alias("low"), F.array_max(found).alias("high"))


def deadline(text: Column) -> Column:
    """First ISO date as it stands, else first valid m/d/Y, else first Month d, Y; null without any."""
    iso = F.nullif(F.regexp_extract(text, r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b", 1), F.lit(""))
    us = F.regexp_extract(text, r"\b([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})\b", 1)
    named = F.regexp_replace(F.regexp_extract(text, r"(?i)\b((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? [0-9]{1,2},? [0-9]{4})\b", 1), "[.,]", "")
    named = F.initcap(named)
    day = lambda x, p: F.to_date(F.try_to_timestamp(x, F.lit(p))).cast("string")
    return F.coalesce(iso, day(us, "M/d/yyyy"), day(named, "MMMM d yyyy"), day(named, "MMM d yyyy"))


def eligibility(text: Column) -> Column:
    """The first three sentences of 30 characters or more that speak of eligibility or requirements."""
    kept = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: (F.length(s) >= 30) & F.lower(s).rlike("eligib|require"))
    return F.array_join(F.slice(kept, 1, 3), " ")


def listed_names(text: Column, names: list[str]) -> Column:
    """The names that the text holds anywhere, in any case, sorted; null without any."""
    low = F.lower(text)
    found = F.array_sort(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: low.contains(F.lower(n))))
    return F.when(F.size(found) > 0, found)


def essay_required(text: Column) -> Column:
    """Explicit yes or no, else "not required" as no, else any mention as yes, else null."""
    low = F.lower(text)
    return (
        F.when(low.rlike(r"essay required:?\s*yes"), True)
        .when(low.rlike(r"essay required:?\s*no\b"), False)
        .when(low.contains("essay") & low.contains("not required"), False)
        .when(low.contains("essay"), True)
    )


def essay_prompt(text: Column) -> Column:
    """What follows `essay prompt:` on its line, without marks at its ends; null without any."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"(?i)essay prompt\s*:\s*([^\n]+)", 1), r"^[ .;:]+|[ .;:]+$", ""), F.lit(""))


def labelled_field(text: Column, names: list[str], labels: list[str]) -> Column:
    """The value after the first `name:` that is found, up to the next label (no word boundary)."""
    stop = "(?i)" + "|".join(labels)
    out = []
    for name in names:
        rest = F.regexp_extract(text, rf"(?is){name}\s*:\s*(.*)$", 1)
        out.append(F.nullif(F.regexp_replace(F.get(F.split(rest, stop, 2), 0), r"^[ .;:\n\t]+|[ .;:\n\t]+$", ""), F.lit("")))
    return F.coalesce(*out, F.lit("")) if out else F.lit("")


def total_pages(html: Column) -> Column:
    """Pager size out of embedded JSON, at least 1."""
    pages = F.regexp_extract(html, r"\"total_pages\"\s*:\s*\"?([0-9]+)", 1).try_cast("int")
    return F.greatest(F.coalesce(pages, F.lit(1)), F.lit(1))
