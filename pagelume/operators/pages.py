"""Site audit: page signals, their roll-up by site, scores and the fit cascade; crawl and contact page plans; contacts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dictionaries as D
from ..functions import html as H
from ..functions import urls as U
from ..functions.cells import let, trim_ws

SIGNALS = (
    "has_catalog", "has_cart", "has_checkout", "has_buy_button", "has_price", "has_product_page", "has_structured_product_data",
    "has_ecommerce_platform", "has_delivery", "has_payment", "has_consumer_language", "has_manufacturer_language", "request_only",
    "callback_only", "quote_only", "has_b2b_language", "has_marketplace_a", "has_marketplace_b",
)
WEIGHTS = {
    "has_cart": 3, "has_checkout": 3, "has_catalog": 2, "has_product_page": 2, "has_structured_product_data": 2, "has_buy_button": 2,
    "has_price": 2, "has_delivery": 1, "has_payment": 1, "has_consumer_language": 1, "has_ecommerce_platform": 1, "has_manufacturer_language": 1,
}


@dataclass(frozen=True)
class Terms:
    """The dictionaries of the page signals; tests bind words that occur in their pages."""

    catalog: tuple = D.CATALOG_TERMS
    cart: tuple = D.CART_TERMS
    checkout: tuple = D.CHECKOUT_TERMS
    buy: tuple = D.BUY_TERMS
    delivery: tuple = D.DELIVERY_TERMS
    payment: tuple = D.PAYMENT_TERMS
    consumer: tuple = D.CONSUMER_TERMS
    manufacturer: tuple = D.MANUFACTURER_TERMS
    request: tuple = D.REQUEST_TERMS
    callback: tuple = D.CALLBACK_TERMS
    quote: tuple = D.QUOTE_TERMS
    b2b: tuple = D.B2B_TERMS
    hacked: tuple = D.HACKED_TERMS
    catalog_marks: tuple = D.CATALOG_MARKS
    cart_marks: tuple = D.CART_MARKS
    checkout_marks: tuple = D.CHECKOUT_MARKS
    product_marks: tuple = D.PRODUCT_MARKS
    structured_marks: tuple = D.STRUCTURED_MARKS
    platform_marks: tuple = D.PLATFORM_MARKS
    marketplace_a: tuple = D.MARKETPLACE_A
    marketplace_b: tuple = D.MARKETPLACE_B
    extra: dict = field(default_factory=dict)


def page_signals(pages: DataFrame, terms: Terms = Terms()) -> DataFrame:
    """page_id, url, domain and the signal vector, in one pass that drops the HTML. Works on a stream too (R2)."""
    base = pages.select("page_id", "url", U.registered_domain(F.col("url")).alias("domain"), H.html_text(F.col("html")).alias("text"), F.lower("html").alias("html"), F.lower(U.path(F.col("url"))).alias("path"), H.anchor_array(F.col("html")).alias("a"))
    base = base.select("page_id", "url", "domain", F.lower("text").alias("t"), F.col("html").alias("h"), "path", H.marketplace_links(F.col("a"), terms.marketplace_a + terms.marketplace_b).alias("links"))
    t, h, p = F.col("t"), F.col("h"), F.col("path")
    any_ = H.contains_any
    linked = lambda marks: F.exists("links", lambda x: any_(x, marks))
    vector = {
        "has_catalog": any_(t, terms.catalog) | any_(h, terms.catalog_marks) | any_(p, terms.catalog_marks),
        "has_cart": any_(t, terms.cart) | any_(h, terms.cart_marks),
        "has_checkout": any_(t, terms.checkout) | any_(h, terms.checkout_marks),
        "has_buy_button": any_(t, terms.buy) | any_(h, terms.buy),
        "has_price": H.has_price(t, h),
        "has_product_page": any_(h, terms.product_marks) | any_(p, terms.product_marks) | any_(h, terms.structured_marks),
        "has_structured_product_data": any_(h, terms.structured_marks),
        "has_ecommerce_platform": any_(h, terms.platform_marks),
        "has_delivery": any_(t, terms.delivery),
        "has_payment": any_(t, terms.payment),
        "has_consumer_language": any_(t, terms.consumer),
        "has_manufacturer_language": any_(t, terms.manufacturer),
        "request_only": any_(t, terms.request),
        "callback_only": any_(t, terms.callback),
        "quote_only": any_(t, terms.quote),
        "has_b2b_language": any_(t, terms.b2b),
        "has_marketplace_a": linked(terms.marketplace_a),
        "has_marketplace_b": linked(terms.marketplace_b),
    }
    return base.select("page_id", "url", "domain", *[vector[s].alias(s) for s in SIGNALS], F.col("links").alias("marketplace_links"), H.present_terms(t, terms.hacked).alias("hacked_terms"))


def ecom_score() -> Column:
    """C4, of the signal columns in scope."""
    return sum((F.when(F.col(s), w).otherwise(0) for s, w in WEIGHTS.items()), F.lit(0))


def site_signals(signals: DataFrame, most: int = 1000) -> DataFrame:
    """A5: by site, the disjunction of the booleans, the first `most` values of the lists in page order, pages with a score, the
    score of the whole. Values are brought together by first occurrence, so what a site gathers grows with its different
    values, not with its pages."""
    by_page = signals.withColumn("score", ecom_score())
    rolled = by_page.groupBy("domain").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("score") > 0).alias("evidence_pages"), *[F.bool_or(s).alias(s) for s in SIGNALS])
    kinds = ("marketplace_links", "hacked_terms")
    listed = signals.select("domain", "page_id", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("vs")) for k in kinds])))
    values = listed.select("domain", "page_id", "kind", F.posexplode("vs").alias("pos", "value")).withColumn("value", trim_ws(F.col("value"))).where("value <> ''")
    first = values.groupBy("domain", "kind", F.lower("value").alias("key")).agg(F.min(F.struct("page_id", "pos", "value")).alias("first"))
    kept = first.withColumn("nth", F.row_number().over(Window.partitionBy("domain", "kind").orderBy("first"))).where(F.col("nth") <= most)
    gathered = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("nth", "first.value")))), lambda x: x["value"]).alias(k)
    lists = kept.groupBy("domain").agg(*[gathered(k) for k in kinds]).withColumnRenamed("domain", "of")
    joined = rolled.join(lists, F.col("domain").eqNullSafe(F.col("of")), "left")
    some = lambda k: F.coalesce(k, F.array().cast("array<string>")).alias(k)
    return joined.select("domain", "pages", "evidence_pages", *SIGNALS, *[some(k) for k in kinds], ecom_score().alias("ecom_score"))


def site_fit() -> Column:
    """(status, reason) of the site columns in scope."""
    c = F.col
    order = c("has_cart") | c("has_checkout")
    structure = c("has_catalog") | c("has_product_page") | c("has_structured_product_data")
    commercial = c("has_price") | c("has_buy_button")
    result = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    return (
        F.when(U.is_marketplace(c("domain")), result("NOT_FIT", "marketplace, not a site of its own"))
        .when(F.size("hacked_terms") > 0, F.struct(F.lit("HACKED").alias("status"), F.concat(F.lit("suspicious words: "), F.array_join("hacked_terms", ", ")).alias("reason")))
        .when(order & structure & commercial, result("FIT_NOW", "cart or checkout, product structure and commercial signals"))
        .when(order & (c("ecom_score") >= 6), result("FIT_NOW", "cart or checkout and enough other signals"))
        .when(order, result("FIT_LATER", "cart or checkout, but weak product structure or prices"))
        .when(c("request_only") | c("callback_only") | c("quote_only"), result("NOT_FIT", "no cart: requests, calls or quotes"))
        .when(c("has_b2b_language") & ~c("has_consumer_language"), result("NOT_FIT", "no cart: business or industrial site"))
        .when(structure & commercial & (c("ecom_score") >= 5), result("FIT_LATER", "products and commercial signals, no cart"))
        .when(structure & (c("ecom_score") >= 6), result("FIT_LATER", "product structure, no cart or checkout"))
        .when(c("has_manufacturer_language") & structure & (F.size("marketplace_links") > 0), result("FIT_LATER", "brand with product structure, no cart"))
        .otherwise(result("NOT_FIT", "no cart and too few signals"))
    )


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, href, text."""
    return pages.select("page_id", "url", F.posexplode(H.anchor_array(F.col("html"))).alias("pos", "a")).select("page_id", "url", "pos", "a.href", "a.text")


def crawl_link_score(url: Column, text: Column) -> Column:
    """C10"""
    v = F.lower(F.concat_ws(" ", url, text))
    weighted = ((D.CATALOG_MARKS + D.CATALOG_TERMS, 8), (D.PRODUCT_MARKS, 6), (D.CART_MARKS + D.CART_TERMS, 5), (D.CHECKOUT_MARKS + D.CHECKOUT_TERMS, 5), (D.DELIVERY_TERMS, 3), (D.PAYMENT_TERMS, 3), (D.OFF_TOPIC_LINKS, -6))
    return sum((F.when(H.contains_any(v, terms), w).otherwise(0) for terms, w in weighted), F.lit(0))


def contact_link_score(url: Column, text: Column) -> Column:
    """C11"""
    v = F.lower(F.concat_ws(" ", url, text))
    return sum((F.when(H.contains_any(v, terms), w).otherwise(0) for terms, w in ((D.CONTACT_PATHS, 12), (D.CONTACT_WORDS, 12), (D.CONTACT_MINUS, -8))), F.lit(0))


def ranked_links(pages: DataFrame, score, common: tuple[str, ...], k: int, common_base: int, keep_query: bool, site) -> DataFrame:
    """Links of a site's pages to their own domain with a positive score, the best score of each address, and common paths
    of the site's first page where no link has them; the best k of each site by (score, path length, address): site,
    candidate, score, rank. A link is resolved and scored once, before it becomes a row; null sites have no candidates."""
    base = pages.select("page_id", "url", site(F.col("url")).alias("site"), U.registered_domain(F.col("url")).alias("own"), H.anchor_array(F.col("html")).alias("a")).where("site is not null")
    own = lambda u: F.col("own").isNull() | F.coalesce(U.registered_domain(u) == F.col("own"), F.lit(False))
    link = lambda a: let(U.resolve_href(F.col("url"), a["href"], keep_query), lambda u: F.struct(u.alias("candidate"), F.when(own(u), score(u, a["text"])).alias("score")))
    links = base.select("site", F.inline(F.transform("a", link))).where("candidate is not null and score > 0")
    links = links.groupBy("site", "candidate").agg(F.max("score").alias("score"))
    # each site's first page gives the scheme and host of its common paths
    origin = F.concat(U.scheme(F.col("url")), F.lit("://"), U.host(F.col("url")))
    first = base.groupBy("site").agg(F.min(F.struct("page_id", origin.alias("origin"))).alias("first"))
    paths = F.array(*[F.struct(F.concat("first.origin", F.lit(p)).alias("candidate"), F.lit(common_base - i).alias("score")) for i, p in enumerate(common)])
    usual = first.select("site", F.inline(paths)).withColumn("usual", F.lit(1))
    # a link that equals a common path keeps its own score
    best = links.withColumn("usual", F.lit(0)).unionByName(usual).groupBy("site", "candidate").agg(F.min_by("score", "usual").alias("score"))
    order = Window.partitionBy("site").orderBy(F.desc("score"), F.length(U.path(F.col("candidate"))), "candidate")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_crawl(pages: DataFrame, k: int = 16, common_base: int = 50, site=U.registered_domain) -> DataFrame:
    """By site, which is the registered domain unless another expression of the address is given."""
    return ranked_links(pages, crawl_link_score, D.SHOP_PATHS, k, common_base, False, site)


def rank_contact_pages(pages: DataFrame, k: int = 4, common_base: int = 50, site=U.registered_domain) -> DataFrame:
    """D13"""
    return ranked_links(pages, contact_link_score, D.COMMON_CONTACT_PATHS, k, common_base, True, site)


def resolve_crawl(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """The stored page of each candidate, by canonical address; of several the least page_id."""
    stored = pages.select(U.canonical_url(F.col("url")).alias("key"), F.col("page_id").alias("stored_page_id")).groupBy("key").agg(F.min("stored_page_id").alias("stored_page_id"))
    return candidates.withColumn("key", U.canonical_url(F.col("candidate"))).join(stored, "key").drop("key")


def analyzable_pages(pages: DataFrame, most: int = 6) -> DataFrame:
    """Of each site the first pages that can be analysed; status, content_type and rendered default where absent."""
    for name, value in (("status", F.lit(200)), ("content_type", F.lit("text/html")), ("rendered", F.lit(False))):
        if name not in pages.columns:
            pages = pages.withColumn(name, value)
    good = pages.where(U.is_analyzable(F.col("status"), F.col("content_type"), F.col("html"), F.col("rendered"))).withColumn("domain", U.registered_domain(F.col("url")))
    return good.withColumn("nth", F.row_number().over(Window.partitionBy("domain").orderBy("page_id"))).where(F.col("nth") <= most)


def first_available(responses: DataFrame) -> DataFrame:
    """Of each row's responses in variant order the first without an error, else the first."""
    return responses.groupBy("row_idx").agg(F.min_by(F.struct("variant", "status"), F.struct((F.col("status") >= 400).alias("bad"), "variant")).alias("r")).select("row_idx", "r.variant", "r.status")


def site_contacts(pages: DataFrame, phone: str = H.PHONE) -> DataFrame:
    """Of each site the first e-mails (8), phones (8), tax numbers (5), legal entities (5) and social links (8)."""
    base = pages.select("page_id", "url", "html", U.registered_domain(F.col("url")).alias("domain"), H.html_text(F.col("html")).alias("text"))
    found = {
        "emails": (F.filter(F.concat(*[F.regexp_extract_all(c, F.lit(H.EMAIL), F.lit(0)) for c in (F.col("text"), F.col("html"))]), H.is_useful_email), 8),
        "phones": (F.transform(F.regexp_extract_all("text", F.lit(phone), F.lit(0)), H.norm_phone), 8),
        "inns": (H.extract_inns(F.col("text")), 5),
        "legal_entities": (H.legal_entities(F.col("text")), 5),
        "social_links": (H.social_links(H.anchor_array(F.col("html")), F.col("url")), 8),
    }
    rows = base.select("domain", "page_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(most).alias("most"), v.alias("vs")) for k, (v, most) in found.items()])).alias("f"))
    rows = rows.select("domain", "page_id", "f.kind", "f.most", F.posexplode("f.vs").alias("pos", "value")).withColumn("value", F.trim("value")).where("value <> ''")
    first = rows.groupBy("domain", "kind", "most", F.lower("value").alias("key")).agg(F.min(F.struct("page_id", "pos", "value")).alias("first"))
    nth = F.row_number().over(Window.partitionBy("domain", "kind").orderBy("first"))
    kept = first.withColumn("nth", nth).where(F.col("nth") <= F.col("most"))
    values = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("nth", "first.value")))), lambda x: x["value"]).alias(k)
    return kept.groupBy("domain").agg(*[values(k) for k in found])


def term_hits(pages: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """(page_id, term) for each dictionary term that a page's text holds; the dictionary is small and known when planning."""
    text = pages.select("page_id", F.lower(H.html_text(F.col("html"))).alias("t"))
    return text.select("page_id", F.explode(F.filter(F.array(*map(F.lit, terms)), lambda w: F.contains("t", w))).alias("term"))
