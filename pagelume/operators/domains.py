"""Addresses that a brand's own site may have, best guess first, as ordered rows.

A brand's wordings (spellings and cuts of its words) meet a table of forms: what a domain makes of words, with the glue
between the parts. Places in both tables are the order of the guesses; of equal guesses the first stays. The first
guesses get the usual endings and zones, and the order is cut, so a brand has at most `most` addresses and nothing grows
with its name but the work on its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions.cells import let, norm_brand, translit
from .brands import CODES, SHOPS, SHORT_FORMS, SOFT, SUFFIXES, by_prefix

NAMES = 16
ADDRESSES = 32
#: Endings that the first two guesses have too.
PRODUCTS = ("products", "-products")


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[a-z0-9]+"), F.lit(0))


def wordings_in_order(low: Column) -> Column:
    """The word lists of a brand's lower-case name, best first: its transliterations as they are, then of each spelling what
    is left without descriptors, the first two words of that, and all words."""
    spelled = [F.regexp_replace(low, "[&+]", to) for to in (" ", " and ")]
    latin = [translit(s) for s in spelled]
    changed = [F.when(x != s, x) for x, s in zip(latin, spelled)]
    kept = lambda ws: F.filter(ws, lambda w: ~w.isin(*D.BRAND_STOPWORDS, "and", "the"))
    sources = F.array_distinct(F.filter(F.array(*spelled, *changed), lambda s: s.isNotNull()))
    cuts = F.flatten(F.transform(sources, lambda s: let(_words(s), lambda ws: let(kept(ws), lambda k: F.array(k, F.slice(k, 1, 2), ws)))))
    whole = F.transform(F.filter(F.array(*changed), lambda s: s.isNotNull()), _words)
    return F.array_distinct(F.filter(F.concat(whole, cuts), lambda ws: F.size(ws) > 0))


def merged(words: Column) -> Column:
    """`don`, `t` as one word, for initials."""
    joined = F.regexp_replace(F.array_join(words, " "), r"(^| )don t(?= |$)", "$1dont")
    return F.split(joined, " ")


def forms(words: Column) -> Column:
    """Names that a domain makes of words, in order; null where a form doesn't apply."""
    join = lambda parts, *glues: [F.array_join(parts, g) for g in glues]
    first_letters = lambda ws: F.transform(ws, lambda w: F.substring(w, 1, 1))

    def of(p: Column) -> Column:
        ws, short, code, own = p["words"], p["short"], p["code"], p["own"]
        n, m = F.size(ws), F.size(own)
        last, rest = F.get(own, m - 1), F.array_join(first_letters(F.slice(ws, 2, F.greatest(n - 1, F.lit(0)))), "")
        shops = F.flatten(F.transform(ws, lambda w: F.coalesce(*[F.when(F.startswith(w, F.lit(x)), F.array(*map(F.lit, found))) for x, found in SHOPS], F.array().cast("array<string>"))))
        known = (short != ws) | (code != F.substring(F.get(ws, F.lit(0)), 1, 1)) | (F.size(shops) > 0)
        some = lambda test, values: F.when(test, F.array(*values))
        start = F.array(F.get(short, F.lit(0)), rest)
        initials = F.array_join(first_letters(own), "")
        before_last = F.concat(first_letters(F.slice(own, 1, F.greatest(m - 1, F.lit(0)))), F.array(last))
        both = join(ws, "", "-")
        labs = F.flatten(F.transform(F.filter(ws, lambda w: F.endswith(w, F.lit("lab")) & (F.length(w) > 4)), lambda w: F.array(F.regexp_replace(w, "lab$", "-lab"), w)))
        return F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in (
            F.when(known, shops),
            some(known & (n >= 2) & (F.get(short, F.lit(0)) != F.get(ws, F.lit(0))), join(start, "-", "")),
            some(known & (n >= 2), [*join(F.array(code, F.get(short, n - 1)), "", "-"), *join(start, "", "-")]),
            some(short != ws, join(short, "", "-")),
            F.when(known, F.transform(F.filter(F.array(*both), lambda x: F.contains(x, F.lit(SOFT[0]))), lambda x: F.replace(x, F.lit(SOFT[0]), F.lit(SOFT[1])))),
            F.array(*both),
            some(m >= 2, [initials]),
            some((m >= 2) & (F.length(last) >= 4), [F.concat(initials, last)]),
            some((m >= 3) & (F.length(last) >= 4), join(before_last, "", "-")),
            labs,
        )])

    parts = F.struct(words.alias("words"), F.transform(words, lambda w: by_prefix(w, SHORT_FORMS, w)).alias("short"), by_prefix(F.get(words, F.lit(0)), CODES, F.substring(F.get(words, F.lit(0)), 1, 1)).alias("code"), merged(words).alias("own"))
    return let(parts, of)


def brand_names(brands: DataFrame) -> DataFrame:
    """(brand_id, names): the guesses without zone, best first: those of known brands, of the forms, and then all of these
    with each of the usual endings."""
    known = lambda low: F.concat(*[F.when(F.forall(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t)), F.array(*map(F.lit, domains))).otherwise(F.array().cast("array<string>")) for terms, domains in D.BRAND_ALIASES])
    low = brands.select("brand_id", norm_brand(F.col("brand")).alias("low"))
    base = F.array_distinct(F.concat(known(F.col("low")), F.flatten(F.transform(wordings_in_order(F.col("low")), forms))))
    ended = lambda names: F.flatten(F.transform(names, lambda x: F.array(*[F.concat(x, F.lit(e)) for e in SUFFIXES])))
    rows = low.select("brand_id", F.filter(base, lambda x: x != "").alias("base"))
    return rows.select("brand_id", F.array_distinct(F.concat("base", ended(F.col("base")))).alias("names"))


def brand_addresses(brands: DataFrame, names: int = NAMES, most: int = ADDRESSES) -> DataFrame:
    """(brand_id, ord, url) of brands (brand_id, brand): at most `most` addresses, best guess first."""
    first, more = F.slice("base", 1, 2), F.slice("base", 3, 6)
    with_endings = F.flatten(F.transform(first, lambda x: F.array(*[F.concat(x, F.lit(e)) for e in PRODUCTS])))
    plain = F.filter("names", lambda x: ~F.endswith(x, F.lit(PRODUCTS[0])))
    chosen = F.slice(F.array_distinct(F.concat(first, with_endings, more)), 1, names)
    https = lambda *xs: F.concat(F.lit("https://"), *xs, F.lit("/"))
    zones = lambda x: F.when(x.rlike("-[a-z]{1,2}$"), F.array(F.lit(".com"), F.lit(".ru"))).otherwise(F.array(F.lit(".ru"), F.lit(".com")))
    urls = lambda x: F.when(F.contains(x, F.lit(".")), F.array(https(x))).otherwise(F.transform(zones(x), lambda z: https(x, z)))
    rows = brand_names(brands).select("brand_id", plain.alias("base")).select("brand_id", F.filter(chosen, lambda x: F.length(x) >= 3).alias("chosen"))
    return rows.select("brand_id", F.posexplode(F.slice(F.flatten(F.transform("chosen", urls)), 1, most)).alias("ord", "url"))
