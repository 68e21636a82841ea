"""A scanner of markup as column expressions.

One alternation, read from left to right, is the state machine: comments, elements with raw text, tags with quoted and
unquoted attributes, declarations. What it takes as one token can't be mistaken for another one: no tag inside a comment or
a script, no comment inside a quoted attribute, no end of a tag inside quotes. A `<` that opens nothing is text. All loops are
possessive, so a page is read once and deep pages need no stack.

Text after an unclosed comment, script or style belongs to it; a quote that is never closed is an ordinary character.
Entities are numbers and the names of HTML 4, each decoded once, with the semicolon that ends them; unknown ones stay.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import compact, let

ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+"""
COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\z))"
RAW = rf"<(?:script(?=[\s/>]){ATTRIBUTES}>.*?(?:</script(?=[\s/>])[^>]*+>|\z)|style(?=[\s/>]){ATTRIBUTES}>.*?(?:</style(?=[\s/>])[^>]*+>|\z))"
TITLE = rf"<title(?=[\s/>]){ATTRIBUTES}>.*?(?:</title(?=[\s/>])[^>]*+>|\z)"
TAG = rf"</?[a-z]{ATTRIBUTES}>"
OTHER = r"<(?:[!?]|/(?![a-z]))[^>]*+>"
TOKENS = f"(?is)(?:{COMMENT}|{RAW}|{OTHER})|({TITLE}|{TAG})"
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
#: Names and characters as the standard library has them; `apos` is no name of HTML 4.
NAMED = {name: chr(code) for name, code in html.entities.name2codepoint.items()} | {"apos": "'", "nbsp": " "}


def scanned(c: Column) -> Column:
    """The page without comments, scripts, styles and declarations; tags and the title element stay as they are."""
    return F.regexp_replace(c, TOKENS, " $1")


def body(clean: Column) -> Column:
    """What follows the body's tag in a scanned page; all of it where there is none."""
    return F.regexp_replace(clean, rf"(?is)\A.*?<body(?=[\s/>]){ATTRIBUTES}>", "")


def without_tags(clean: Column) -> Column:
    return F.regexp_replace(clean, f"(?is){TAG}", " ")


def character(code: Column) -> Column:
    """The character of a code point; what is none is U+FFFD."""
    valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("�")


def entity(e: Column) -> Column:
    """One entity with its & and ;"""
    name = F.substring(e, 2, 40)
    name = F.substring_index(name, ";", 1)
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    number = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 8)).cast("long")
    return F.when(F.startswith(name, F.lit("#")), character(number)).otherwise(F.coalesce(F.try_element_at(names, name), e))


def decode_entities(c: Column) -> Column:
    """Each entity of a text decoded once: `&amp;lt;` is `&lt;`. The text and its entities are bound, as a lambda's outer
    expressions are worked out again for each of its elements."""
    parts = lambda t: F.struct(F.split(t, ENTITY).alias("between"), F.transform(F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0)), entity).alias("found"))
    joined = lambda t: let(parts(t), lambda p: F.array_join(F.zip_with(p["between"], p["found"], lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))
    return let(c, lambda t: F.when(F.contains(t, F.lit("&")), joined(t)).otherwise(t))


def visible_text(c: Column) -> Column:
    """Of a scanned piece of markup: its text, single-spaced."""
    return compact(decode_entities(without_tags(c)))


def attribute(tag: Column, name: str) -> Column:
    """The first value of an attribute in a tag (`<a href=...>` without its `>`); null where it has none, '' where it is empty."""
    value = r"""(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+|))"""
    before = rf"""(?is)\A<[a-z][^\s/>]*+(?:[\s/]++|(?!{name}\s*=)[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+{name}\s*+=\s*+{value}"""
    return F.when(tag.rlike(before), F.concat(*[F.regexp_extract(tag, before, k) for k in (1, 2, 3)]))


LINK = rf"(?is)(<a(?=[\s/]){ATTRIBUTES})>(.*?)(?=</a(?=[\s/>])|<a(?=[\s/>])|\z)"


def links(clean: Column) -> Column:
    """Array of (href, text) of a scanned page's anchors with an href; an anchor ends where it is closed or another one opens."""
    parts = lambda c: F.arrays_zip(*[F.regexp_extract_all(c, F.lit(LINK), F.lit(k)).alias(n) for k, n in ((1, "tag"), (2, "t"))])
    made = F.transform(let(clean, parts), lambda x: F.struct(attribute(x["tag"], "href").alias("h"), x["t"].alias("t")))
    made = F.filter(made, lambda x: x["h"].isNotNull())
    return F.transform(made, lambda x: F.struct(decode_entities(x["h"]).alias("href"), visible_text(x["t"]).alias("text")))
