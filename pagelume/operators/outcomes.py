"""Outcomes of inspected rows: extraction across sources, status cascades, information scores, best attempts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions import html as H
from ..functions import urls as U
from ..functions.cells import compact, computed, first_non_empty

COUNTRIES = ("БЕЛОРУСЬ", "КАЗАХСТАН")
#: Statuses after which a row need not be inspected again.
TERMINAL = ("SUCCESS", "PARTIAL_SUCCESS", *COUNTRIES, "SKIPPED_KNOWN", "SKIPPED_VIEWED", "Нет реквизитов на странице", "NOTHING_FOUND_PAGE")
RECOVERABLE = ("NEEDS_REVIEW", "SELLER_PAGE_OPENED", "PAGE_OPENED_NO_REQUISITES", "PRODUCT_PAGE_OPENED", "Нет реквизитов на странице")


def filled(*names: str) -> Column:
    return H.any_of([F.coalesce(F.col(n), F.lit("")) != "" for n in names])


def extract_requisites(pages: DataFrame) -> DataFrame:
    """Identifiers, entity type, country and name of stored pages (page_id, url, html, and listed_name where known).

    Tax number: tooltip, HTML, text, title; registration numbers and entity: tooltip, HTML, text; name: HTML, tooltip, and
    the text on a seller page only; none on an empty-results page, where the listed name stands in."""
    listed = F.col("listed_name") if "listed_name" in pages.columns else F.lit(None).cast("string")
    base = pages.select("page_id", "url", "html", listed.alias("listed_name"))
    base = computed(base, tooltip=H.requisites_block(F.col("html")), text=H.html_text(F.col("html")), title=H.html_title(F.col("html")))
    tooltip, html, text, title = F.col("tooltip"), F.col("html"), F.col("text"), F.col("title")
    three = (tooltip, html, text)
    base = computed(base, empty=H.is_empty_results(text, title), seller=U.is_seller_url(F.col("url"), allow_slug=True))
    empty, seller = F.col("empty"), F.col("seller")
    # the block's own name comes before the headings in seller_name_html, so it isn't tried again after them
    name = F.when(~empty, F.coalesce(H.seller_name_html(html, tooltip), F.when(seller, H.seller_name_text(text))))
    return base.select(
        "page_id",
        "url",
        H.first_of_sources(H.extract_inn, *three, title).alias("inn"),
        H.first_of_sources(H.extract_ogrn, *three).alias("ogrn"),
        H.first_of_sources(H.extract_ogrnip, *three).alias("ogrnip"),
        H.first_of_sources(H.entity_type, *three).alias("entity_type"),
        H.seller_country(tooltip, text, title).alias("seller_country"),
        F.coalesce(name, F.nullif("listed_name", F.lit(""))).alias("display_name"),
        empty.alias("empty_results"),
        H.has_entrypoint(html, text=text).alias("has_entrypoint"),
        seller.alias("on_seller_page"),
    )


def parse_status() -> Column:
    """(status, note) of http_status, blocked, inn, entity_type, seller_country, waited, on_seller_page, has_entrypoint, empty_results."""
    c = F.col
    found = filled("inn", "entity_type")
    bad = F.coalesce(c("http_status") >= 400, F.lit(False))
    say = lambda s, n: F.struct(F.lit(s).alias("status"), F.lit(n).alias("note"))
    http = lambda tail: F.concat(F.lit("HTTP status "), c("http_status").cast("string"), F.lit(tail))
    return (
        F.when(c("blocked") & found, say("PARTIAL_SUCCESS", "block page, yet some requisites"))
        .when(c("blocked") & (c("waited") > 0), say("MANUAL_CHECK_REQUIRED", "block page even after a pause"))
        .when(c("blocked"), say("ANTI_BOT_PAGE", "block page in place of the content"))
        .when(bad & found, F.struct(F.lit("PARTIAL_SUCCESS").alias("status"), http(", yet some requisites").alias("note")))
        .when(bad, F.struct(F.lit("PAGE_NOT_AVAILABLE").alias("status"), http("").alias("note")))
        .when(filled("inn"), F.struct(F.lit("SUCCESS").alias("status"), F.when(c("on_seller_page"), "tax number on the seller page").otherwise("tax number in the page text").alias("note")))
        .when(c("seller_country").isNotNull(), F.struct(c("seller_country").alias("status"), F.concat(F.lit("seller of "), c("seller_country")).alias("note")))
        .when(filled("entity_type"), say("NEEDS_REVIEW", "signs of requisites, no tax number"))
        .when(c("empty_results"), say("NOTHING_FOUND_PAGE", "empty page of results"))
        .when(c("on_seller_page") & c("has_entrypoint"), say("SELLER_PAGE_OPENED", "seller page without requisites"))
        .when(c("on_seller_page"), say("Нет реквизитов на странице", "no requisites on the page"))
        .when(c("waited") > 0, say("PRODUCT_PAGE_OPENED", "opened after a pause, no requisites yet"))
        .otherwise(say("PAGE_OPENED_NO_REQUISITES", "opened, no requisites"))
    )


def api_status() -> Column:
    """Of inn, seller_country, entity_type and has_payload."""
    return F.when(filled("inn"), "SUCCESS").when(F.col("seller_country").isNotNull(), F.col("seller_country")).when(filled("entity_type") | F.col("has_payload"), "NEEDS_REVIEW").otherwise("Нет реквизитов на странице")


def info_score() -> Column:
    """C3"""
    one = lambda test, w: F.when(test, w).otherwise(0)
    return one(filled("inn"), 100) + one(filled("ogrn", "ogrnip"), 40) + one(filled("entity_type"), 20) + one(F.col("parse_status").isin(*COUNTRIES), 25) + one(filled("display_name"), 5) + one(filled("note"), 2)


def best_attempt(attempts: DataFrame) -> DataFrame:
    """Of each row_id the attempt with the greatest score, the earlier of equals."""
    kept = [c for c in attempts.columns if c != "row_id"]
    best = F.max_by(F.struct(*kept), F.struct("score", (-F.col("attempt")).alias("early"))).alias("b")
    return attempts.groupBy("row_id").agg(best).select("row_id", "b.*")


def needs_recovery() -> Column:
    """P6"""
    return F.col("parse_status").isin(*RECOVERABLE)


def has_any_requisite() -> Column:
    """P7"""
    return filled("inn", "entity_type", "ogrn", "ogrnip")


def skip_recommended(inn: Column, status: Column) -> Column:
    """P5"""
    return (F.coalesce(inn, F.lit("")) != "") | F.coalesce(status.isin(*TERMINAL), F.lit(False))


def failure_class(message: Column) -> Column:
    """C17"""
    m = F.lower(message)
    return F.when(H.contains_any(m, D.RESTART_MARKS), "restart").when(H.contains_any(m, D.RETRY_MARKS), "retry").otherwise("fatal")


def error_outcome(rows: DataFrame) -> DataFrame:
    """Rows (row_id, error) as outcomes."""
    return rows.select("row_id", F.lit("ROW_ERROR").alias("parse_status"), F.substring(compact(F.col("error")), 1, 500).alias("note"), failure_class(F.col("error")).alias("failure"))


def unready_outcome(blocked: Column, fast: bool = True) -> Column:
    """C19"""
    return F.when(blocked, "ANTI_BOT_PAGE").otherwise("PAGE_LOAD_TIMEOUT") if fast else F.lit("ANTI_BOT_PAGE")


def is_product_page(url: Column, title: Column, text: Column, article: Column, marks: tuple[str, ...] = ("в корзину", "артикул", "купить")) -> Column:
    """P10"""
    n = article.cast("string")
    right = F.contains(U.path(url), F.concat(F.lit("/catalog/"), n, F.lit("/")))
    shown = F.contains(text, n) | H.contains_any(F.lower(text), marks) | F.contains(F.coalesce(title, F.lit("")), n)
    return F.coalesce(right & (F.length(text) >= 300) & shown, F.lit(False))


def is_seller_page(title: Column, text: Column, name: Column, most: int = 12_000) -> Column:
    """P11"""
    start = F.substring(F.concat_ws("\n", title, text), 1, most)
    named = (F.coalesce(name, F.lit("")) != "") & F.contains(F.lower(start), F.lower(name))
    return F.coalesce(named, F.lit(False)) | H.has_seller_signal(start)


def landing_mismatch(url: Column, article: Column) -> Column:
    """A product page was asked for, a seller page came."""
    return article.isNotNull() & F.startswith(F.lower(U.path(url)), F.lit("/seller/"))


def legal_lookup(listing: DataFrame, cards: DataFrame, legal: DataFrame) -> DataFrame:
    """Listing rows (article) with their card's supplier and its legal payload, which may be missing."""
    joined = listing.join(cards, listing.article == cards.product_id).join(legal, "supplier_id", "left")
    name = first_non_empty(F.col("legal_name"), F.col("supplier"))
    return joined.select(
        "row_id", "article", "supplier_id", "supplier", "inn", "ogrn", name.alias("display_name"), H.entity_type(F.coalesce("legal_name", F.lit(""))).alias("entity_type"), F.lit(None).cast("string").alias("seller_country"), F.col("legal_name").isNotNull().alias("has_payload")
    ).withColumn("parse_status", api_status())


def parse_cards(df: DataFrame, column: str = "card") -> DataFrame:
    """Products of JSON cards {products: [{id, supplierId, supplier}]}."""
    schema = "struct<products: array<struct<id: bigint, supplierId: bigint, supplier: string>>>"
    return df.select(F.explode(F.from_json(column, schema)["products"]).alias("p")).select(F.col("p.id").alias("product_id"), F.col("p.supplierId").alias("supplier_id"), F.col("p.supplier").alias("supplier"))


def parse_legal(df: DataFrame, column: str = "legal") -> DataFrame:
    """Legal payloads {supplierName, name, tradeName, inn, ogrn} by supplier_id."""
    p = F.from_json(column, "struct<supplierName: string, name: string, tradeName: string, inn: string, ogrn: string>")
    return df.select("supplier_id", p.alias("p")).select("supplier_id", first_non_empty(F.col("p.supplierName"), F.col("p.name"), F.col("p.tradeName")).alias("legal_name"), F.nullif("p.inn", F.lit("")).alias("inn"), F.nullif("p.ogrn", F.lit("")).alias("ogrn"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """K3: rows of all frames; columns in first-seen order, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
