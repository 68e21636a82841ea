"""Cleaning of dirty cells: keys, identifiers, numbers, flags, names and texts. Column in, Column out.

White space is what Java's \\s matches plus the no-break space; lower() stands for case folding (they differ for few
letters, such as the German sharp s).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dictionaries import CYRILLIC, MARKERS, TRUE_WORDS

WS = r"[\s\x{A0}]"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, where plain nesting would write it out for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns, each evaluated once a row: the optimiser moves no filter on them below, where it would repeat them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def compact(c: Column) -> Column:
    """Runs of white space become one blank."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def norm_key(c: Column) -> Column:
    """Lower-case key; null is ''."""
    return F.coalesce(F.lower(trim_ws(c)), F.lit(""))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def norm_inn(c: Column) -> Column:
    """Digits of a tax number; a trailing .0 is the trace of a float. No check of its length."""
    return F.nullif(digits(F.regexp_replace(trim_ws(c.cast("string")), r"\.0$", "")), F.lit(""))


def norm_identifier(c: Column, lengths: tuple[int, ...]) -> Column:
    """Digits, where their number is one of `lengths`."""
    d = digits(c)
    return F.when(F.length(d).isin(*lengths), d)


def norm_article(c: Column) -> Column:
    """Whole numbers as bigint; anything else is null."""
    t = trim_ws(c.cast("string"))
    return F.when(t.rlike(r"^[+-]?\d+(\.0+)?$"), F.regexp_replace(t, r"\.0+$", "").try_cast("bigint"))


def to_int(c: Column, default: int) -> Column:
    """N5"""
    return F.coalesce(trim_ws(c.cast("string")).try_cast("int"), F.lit(default))


def to_bool(c: Column) -> Column:
    """N6"""
    return norm_key(c.cast("string")).isin(*TRUE_WORDS)


def is_marker(c: Column) -> Column:
    """Marks that ask for a manual check."""
    return norm_key(c).isin(*MARKERS)


def to_text(c: Column) -> Column:
    """Trimmed, '' is null, whole floats without their .0"""
    t = trim_ws(c.cast("string"))
    return F.nullif(F.when(t.rlike(r"^-?\d+\.0$"), F.regexp_replace(t, r"\.0$", "")).otherwise(t), F.lit(""))


def norm_headers(headers: Column) -> Column:
    """Trimmed headers; a blank one is named after its 1-based position."""
    return F.transform(headers, lambda h, i: F.coalesce(to_text(h), F.concat(F.lit("column_"), (i + 1).cast("string"))))


def header_key(c: Column) -> Column:
    """N10"""
    return F.lower(compact(c))


def is_empty_row(cells: Column) -> Column:
    """N11"""
    return F.forall(cells, lambda x: x.isNull() | (trim_ws(x) == ""))


def norm_lines(c: Column) -> Column:
    """Each line compacted, blank lines dropped."""
    return F.array_join(F.filter(F.transform(F.split(c, r"\r\n|\r|\n"), compact), lambda x: x != ""), "\n")


def unique_ci(values: Column) -> Column:
    """Without regard to case, the first spelling of each, blanks dropped, order kept."""
    trimmed = F.filter(F.transform(values, trim_ws), lambda x: x.isNotNull() & (x != ""))
    keyed = F.array_sort(F.transform(trimmed, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("v"))))
    first = lambda s: F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["k"] != e["k"]))
    return let(keyed, lambda s: F.transform(F.array_sort(F.transform(first(s), lambda e: F.struct(e["i"], e["v"]))), lambda e: e["v"]))


def join_values(values: Column) -> Column:
    """N15"""
    return F.array_join(values, "; ")


def norm_phone(c: Column) -> Column:
    """+7 ddd ddd-dd-dd for eleven digits from 7 or 8; else the trimmed input."""
    d = digits(c)
    shaped = F.concat(F.lit("+7 "), F.substring(d, 2, 3), F.lit(" "), F.substring(d, 5, 3), F.lit("-"), F.substring(d, 8, 2), F.lit("-"), F.substring(d, 10, 2))
    return F.when(d.rlike("^[78][0-9]{10}$"), shaped).otherwise(trim_ws(c))


def clean_entity(c: Column) -> Column:
    """N17"""
    return F.regexp_replace(F.regexp_replace(c, f"{WS}+", " "), r"^[ .,;:-]+|[ .,;:-]+$", "")


def sanitize(c: Column, most: int = 32767) -> Column:
    """Without control characters but tab and line ends, at most `most` characters."""
    return F.substring(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), 1, most)


def listing_url(article: Column, template: str) -> Column:
    """The template with {} replaced by the article; null stays null."""
    head, tail = template.split("{}")
    return F.concat(F.lit(head), article.cast("string"), F.lit(tail))


def search_url(query: Column, base: str = "https://search.example/?q=") -> Column:
    """Quoted like a form value: '~' stays, '*' is escaped."""
    return F.concat(F.lit(base), F.replace(F.replace(F.url_encode(query), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")))


def first_non_empty(*columns: Column) -> Column:
    """Skips null and ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def category_of(path: Column, roots: tuple[str, ...] = ("результаты", "results")) -> Column:
    """The folders between the results folder and the file; without one, the file's folder."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    lowered = F.transform(parts, F.lower)
    at = reduce(lambda a, r: F.when(a > 0, a).otherwise(F.array_position(lowered, r)), roots[1:], F.array_position(lowered, roots[0]))
    n = F.size(parts)
    inner = F.array_join(F.slice(parts, (at + 1).cast("int"), F.greatest(n - at.cast("int") - 1, F.lit(0))), " / ")
    parent = F.coalesce(F.get(parts, n - 2), F.lit(""))
    return F.when((at > 0) & (inner != ""), inner).otherwise(parent)


def brand_tokens(c: Column, least: int = 3) -> Column:
    """N23"""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-zа-яё0-9]+"), F.lit(0)), lambda t: F.length(t) >= least)


def translit(c: Column) -> Column:
    """Lower-case Cyrillic to Latin letters, one to several."""
    single = {k: v for k, v in CYRILLIC.items() if len(v) <= 1}
    kept = sorted(single, key=lambda k: not single[k])  # translate() drops the letters beyond its second list
    out = F.translate(c, "".join(kept), "".join(single[k] for k in kept))
    for k, v in CYRILLIC.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def norm_brand(c: Column) -> Column:
    """Lower case without quotes and apostrophes."""
    return F.translate(F.lower(c), "'’`", "")


def yes_no(c: Column, yes: str = "да", no: str = "нет") -> Column:
    """N26"""
    return F.when(c, yes).otherwise(no)


def company_name(values: Column, headers: tuple[str, ...]) -> Column:
    """The first header's value that is not blank, from a map of header to value."""
    return F.coalesce(*[to_text(values[h]) for h in headers])


def require_columns(df: DataFrame, columns: list[str]) -> None:
    """A stated error names the missing columns in order."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
