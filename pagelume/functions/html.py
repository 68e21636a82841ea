"""Text, links, identifiers and contacts from stored pages, as column expressions.

Patterns use explicit boundaries instead of \\b, which differs between engines next to Cyrillic letters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import markup
from .cells import clean_entity, compact, let, norm_lines, norm_phone, unique_ci
from .dictionaries import (
    BLOCK_MARKS,
    BLOCK_PAGES,
    EMPTY_RESULTS,
    IGNORED_NAMES,
    MARKETPLACE_A,
    MARKETPLACE_B,
    REQUISITE_MARKS,
    SELLER_INFO_CLASSES,
    SOCIAL_DOMAINS,
)
from .markup import decode_entities
from .urls import join_url, registered_domain, seller_url

LEFT, RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def contains_any(c: Column, terms: tuple[str, ...]) -> Column:
    """E24"""
    return any_of([F.contains(c, F.lit(t)) for t in terms])


def present_terms(c: Column, terms: tuple[str, ...]) -> Column:
    """The terms that stand as whole words, in dictionary order."""
    import re

    hits = [F.when(c.rlike(f"(?iu){LEFT}{re.escape(t)}{RIGHT}"), F.lit(t)) for t in terms]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def strip_tags(c: Column) -> Column:
    return markup.without_tags(c)


def html_text(html: Column) -> Column:
    """The visible text of the body (of all, without a body): no comments, scripts, styles and tags; single-spaced."""
    return markup.visible_text(markup.body(markup.scanned(html)))


def html_title(html: Column) -> Column:
    """The text of the first title element; tags inside it are text."""
    title = F.regexp_extract(markup.scanned(html), rf"(?is)<title(?=[\s/>]){markup.ATTRIBUTES}>(.*?)(?:</title(?=[\s/>])|\z)", 1)
    return F.nullif(compact(decode_entities(title)), F.lit(""))


def anchor_array(html: Column) -> Column:
    """Array of (href, text) in page order."""
    return markup.links(markup.scanned(html))


def extract_inn(c: Column) -> Column:
    """The first labelled tax number of 14, 12 or 10 digits."""
    return F.nullif(F.regexp_extract(c, rf"(?iu){LEFT}ИНН\s*[:№]?\s*(\d{{14}}|\d{{12}}|\d{{10}}){RIGHT}", 1), F.lit(""))


def extract_ogrn(c: Column) -> Column:
    """E5: the first labelled registration number of 13 digits."""
    return F.nullif(F.regexp_extract(c, rf"(?iu){LEFT}ОГРН\s*[:№]?\s*(\d{{13}}){RIGHT}", 1), F.lit(""))


def extract_ogrnip(c: Column) -> Column:
    """E5: the first labelled entrepreneur's number of 15 digits."""
    return F.nullif(F.regexp_extract(c, rf"(?iu){LEFT}ОГРНИП\s*[:№]?\s*(\d{{15}}){RIGHT}", 1), F.lit(""))


def extract_inns(c: Column) -> Column:
    """All numbers of 12 or 10 digits within 20 other characters of the label; longer runs of digits don't count."""
    return F.regexp_extract_all(c, F.lit(r"(?:инн|ИНН)\D{0,20}(\d{12}|\d{10})(?!\d)"), F.lit(1))


def entity_type(c: Column) -> Column:
    """By the long form, else the first short one."""
    long = F.lower(F.regexp_extract(c, r"(?iu)(Индивидуальный предприниматель|Общество с ограниченной ответственностью)", 1))
    return F.when(F.startswith(long, F.lit("индивидуальный")), "ИП").when(F.startswith(long, F.lit("общество")), "ООО").otherwise(F.nullif(F.regexp_extract(c, f"{LEFT}(ИП|ООО){RIGHT}", 1), F.lit("")))


def legal_entities(c: Column) -> Column:
    """E8"""
    found = F.regexp_extract_all(c, F.lit(r"((?:ООО|ОАО|ПАО|ЗАО|АО|ИП)\s+[\"«]?[A-Za-zА-Яа-яЁё0-9 .,&'()/-]{2,80}[\"»]?)"), F.lit(1))
    return F.filter(F.transform(found, clean_entity), lambda x: x != "")


def seller_country(*texts: Column) -> Column:
    """Belarus before Kazakhstan."""
    t = F.concat_ws("\n", *texts)
    return F.when(t.rlike(rf"(?iu){LEFT}(?:Республика\s+Беларусь|Беларусь|УНП){RIGHT}"), "БЕЛОРУСЬ").when(t.rlike(rf"(?iu){LEFT}(?:Республика\s+Казахстан|Казахстан|БИН|ИИН){RIGHT}"), "КАЗАХСТАН")


def has_requisites(c: Column) -> Column:
    """E10"""
    return F.coalesce(contains_any(c, REQUISITE_MARKS), F.lit(False))


def has_seller_signal(c: Column) -> Column:
    return has_requisites(c) | seller_country(c).isNotNull() | entity_type(c).isNotNull()


def tooltip_blocks(html: Column) -> Column:
    block = lambda name: F.regexp_extract_all(html, F.lit(rf'(?is)<div[^>]*class="[^"]*{name}[^"]*"[^>]*>(.*?)</div>'), F.lit(1))
    return F.concat(block("tooltip-supplier"), block("tooltip__content"))


def requisites_block(html: Column, before: int = 800, after: int = 1200) -> Column:
    """The first tooltip with a seller signal, else the text around the outermost marks; null without a signal."""
    clean = lambda c: let(norm_lines(F.replace(strip_tags(c), F.lit("&nbsp;"), F.lit(" "))), lambda t: F.nullif(t, F.lit("")))
    tooltip = F.get(F.filter(F.transform(F.filter(tooltip_blocks(html), has_seller_signal), clean), lambda x: x.isNotNull()), F.lit(0))
    places = F.filter(F.array(*[F.instr(html, m) for m in BLOCK_MARKS]), lambda p: p > 0)
    start = lambda p: F.greatest(F.lit(1), F.array_min(p) - before)
    window = lambda p: clean(F.substring(html, start(p), F.array_max(p) + after - start(p)))
    return F.coalesce(tooltip, F.when(has_seller_signal(html), let(places, lambda p: F.when(F.size(p) > 0, window(p)))))


def is_empty_results(*texts: Column) -> Column:
    """E15"""
    return let(F.lower(compact(F.concat_ws("\n", *texts))), lambda t: contains_any(t, EMPTY_RESULTS))


def is_block_page(c: Column, status: Column) -> Column:
    """Classifies a stored page only."""
    return F.coalesce(status == 498, F.lit(False)) | F.coalesce(contains_any(F.lower(c), tuple(t.lower() for t in BLOCK_PAGES)), F.lit(False))


def is_plausible_name(c: Column, ignored: tuple[str, ...] = IGNORED_NAMES) -> Column:
    """E14"""
    ok = lambda n: (F.length(n) >= 2) & ~F.lower(n).isin(*ignored) & ~is_empty_results(n) & ~n.rlike(r"^[\d\s.,%?]+$") & n.rlike("[A-Za-zА-Яа-яЁё]")
    return F.coalesce(let(F.regexp_replace(compact(c), "^[ ,]+|[ ,]+$", ""), ok), F.lit(False))


def seller_name_text(c: Column, skipped: tuple[str, ...] = ("ИНН", "ОГРН", "ОГРНИП", "КПП", "Номер регистрации", "Интернет-магазин Wildberries")) -> Column:
    """The first plausible line without marks, without a trailing legal form; else what a label names."""
    lines = F.filter(F.split(norm_lines(c), "\n"), lambda x: ~contains_any(x, skipped))
    cleaned = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, rf"{LEFT}(?:ИП|ООО)\s*$", ""), "^[ ,]+|[ ,]+$", ""))
    first = F.get(F.filter(cleaned, lambda x: is_plausible_name(x)), F.lit(0))
    labelled = compact(F.regexp_extract(c, r"(?iu)(?:Продавец|Seller|Поставщик)\s*[:]?\s*([A-Za-zА-Яа-яЁё0-9 .,&\-\"'()]{2,120})", 1))
    return F.substring(F.coalesce(first, F.when(is_plausible_name(labelled), labelled)), 1, 120)


def seller_name_html(html: Column, block: Column | None = None) -> Column:
    """From the requisites block (of the page, unless given), then the details title, then a heading that isn't the site's name."""
    block = requisites_block(html) if block is None else block
    heads = lambda p: F.filter(F.transform(F.regexp_extract_all(html, F.lit(p), F.lit(1)), lambda x: compact(strip_tags(x))), lambda x: is_plausible_name(x))
    details = F.get(heads(r'(?is)<h[12][^>]*class="[^"]*seller-details__title[^"]*"[^>]*>(.*?)</h[12]>'), F.lit(0))
    first = F.get(F.filter(heads(r"(?is)<h1[^>]*>(.*?)</h1>"), lambda x: ~F.contains(x, F.lit("Wildberries"))), F.lit(0))
    return F.substring(F.coalesce(seller_name_text(block), details, first), 1, 120)


def is_useful_email(c: Column) -> Column:
    """E19"""
    e = F.lower(c)
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    no = local.isin("test", "example", "noreply", "no-reply", "email", "your-email", "your_email") | F.startswith(domain, F.lit("example.")) | F.contains(domain, F.lit("sentry")) | F.contains(domain, F.lit("ingest.")) | e.rlike(r"\.(?:png|jpg|jpeg|gif|webp)$")
    return ~no


EMAIL = r"(?<![\p{L}\p{N}_.+-])[\p{L}\p{N}_.+-]{2,}@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(?![\p{L}\p{N}_.+-])"
PHONE = r"(?:\+7|8)[\s\-().]*\d{3}[\s\-().]*\d{3}[\s\-().]*\d{2}[\s\-().]*\d{2}"


def extract_emails(text: Column, html: Column, most: int = 8) -> Column:
    """From the text, then the HTML; useful ones, first spellings, at most `most`."""
    found = F.concat(*[F.regexp_extract_all(c, F.lit(EMAIL), F.lit(0)) for c in (text, html)])
    return F.slice(unique_ci(F.filter(found, is_useful_email)), 1, most)


def extract_phones(text: Column, pattern: str = PHONE, most: int = 8) -> Column:
    """E20; the pattern is a parameter, as numbering plans differ."""
    return F.slice(unique_ci(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), norm_phone)), 1, most)


def social_links(anchors: Column, base: Column, domains: tuple[str, ...] = SOCIAL_DOMAINS) -> Column:
    """E21"""
    hrefs = F.transform(anchors, lambda a: F.when(F.startswith(a["href"], F.lit("//")), F.concat(F.lit("https:"), a["href"])).when(F.startswith(a["href"], F.lit("/")), join_url(base, a["href"])).otherwise(a["href"]))
    return F.filter(hrefs, lambda h: F.coalesce(registered_domain(h).isin(*domains), F.lit(False)))


def marketplace_links(anchors: Column, marks: tuple[str, ...] = MARKETPLACE_A + MARKETPLACE_B) -> Column:
    """E22"""
    return unique_ci(F.filter(F.transform(anchors, lambda a: a["href"]), lambda h: contains_any(F.lower(h), marks)))


def has_price(text: Column, html: Column) -> Column:
    """E26; both in lower case."""
    return text.rlike(r"\d[\d\s]{0,12}(?:₽|руб\.?|рублей)") | F.contains(html, F.lit("₽")) | F.contains(text, F.lit("руб")) | F.contains(html, F.lit("data-price")) | F.contains(html, F.lit('itemprop="price"'))


def snippet(html: Column, at: Column, most: int = 800) -> Column:
    """The text around a place of the page, at most `most` characters."""
    return F.substring(compact(decode_entities(strip_tags(F.regexp_replace(F.substring(html, F.greatest(at - most, F.lit(1)), F.lit(2 * most)), "^[^<]*>|<[^>]*$", " ")))), 1, most)


def has_entrypoint(html: Column, classes: tuple[str, ...] = SELLER_INFO_CLASSES, text: Column | None = None) -> Column:
    """E29; the visible text where it is at hand."""
    return html.rlike('(?i)class="[^"]*(?:' + "|".join(classes) + ')[^"]*"') & ~is_empty_results(html_text(html) if text is None else text)


def first_of_sources(extract, *sources: Column) -> Column:
    """The first source in which something is found."""
    return F.coalesce(*[extract(s) for s in sources])


def seller_link(html: Column, base: Column, label: str = "Подробнее о продавце", allow_slug: bool = True, most: int = 12) -> Column:
    """The seller page that a product page links to: the labelled anchor, which may have a name, else the first numbered
    seller path among the first `most` anchors that hold '/seller/'."""
    labelled = F.regexp_extract_all(html, F.lit(rf'(?is)<a\s(?=[^>]*aria-label="{label}")[^>]*?href="([^"]*)"'), F.lit(1))
    plain = F.slice(F.filter(F.transform(anchor_array(html), lambda a: a["href"]), lambda h: F.contains(h, F.lit("/seller/"))), 1, most)
    first = lambda hrefs, slug: F.get(F.filter(F.transform(hrefs, lambda h: seller_url(base, h, slug)), lambda u: u.isNotNull()), F.lit(0))
    return F.coalesce(first(F.slice(labelled, 1, most), allow_slug), first(plain, False))
