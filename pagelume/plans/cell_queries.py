"""Queries of the cell and URL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import urls as U
from ..operators.brands import search_queries
from .bindings import load

WS = r"[\s\x{00A0}]+"


def cells_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1 - N8, N21 on keys dressed as dirty cells."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("  "), k, F.lit(".0 "))).when(F.col("o_orderkey") % 4 == 1, F.concat(k, F.lit("-A"))).when(F.col("o_orderkey") % 4 == 2, F.lit(" Да ")).otherwise(F.lit(""))
    d = o.select("o_orderkey", raw.alias("raw"))
    r = F.col("raw")
    return d.select("o_orderkey", C.norm_key(r).alias("key"), C.norm_inn(r).alias("inn"), C.norm_identifier(r, (4, 5)).alias("ident"), C.norm_article(r).alias("article"), C.to_int(r, -1).alias("as_int"), C.to_bool(r).alias("as_bool"), C.is_marker(r).alias("marker"), C.to_text(r).alias("as_text"), C.first_non_empty(r, F.lit("none")).alias("first_value"))


CELLS_NUMBERS = r"""
WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '  ' || o_orderkey || '.0 ' WHEN 1 THEN o_orderkey || '-A' WHEN 2 THEN ' Да ' ELSE '' END AS raw FROM orders),
t AS (SELECT *, trim(raw) AS s, regexp_replace(raw, '[^0-9]', '', 'g') AS dg FROM d)
SELECT o_orderkey, lower(s) AS key, nullif(regexp_replace(regexp_replace(s, '\.0$', ''), '[^0-9]', '', 'g'), '') AS inn,
  CASE WHEN length(dg) IN (4, 5) THEN dg END AS ident,
  CASE WHEN regexp_full_match(s, '[+-]?\d+(\.0+)?') THEN try_cast(regexp_replace(s, '\.0+$', '') AS BIGINT) END AS article,
  CASE WHEN regexp_full_match(s, '[+-]?\d+') THEN s::INTEGER ELSE -1 END AS as_int,
  lower(s) IN ('1', 'true', 'yes', 'да') AS as_bool, lower(s) IN ('да', 'yes', 'y', 'true', '1', '?', 'нужна проверка') AS marker,
  nullif(CASE WHEN regexp_full_match(s, '-?\d+\.0') THEN regexp_replace(s, '\.0$', '') ELSE s END, '') AS as_text, coalesce(nullif(raw, ''), 'none') AS first_value
FROM t
"""


def cells_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N10, N12, N13, N17, N18 on messages."""
    t = F.col("text")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", C.header_key(t).alias("header_key"), C.norm_lines(t).alias("lines"), C.compact(t).alias("compact"), C.clean_entity(t).alias("entity"), C.sanitize(t, 100).alias("clean"))


CELLS_TEXT = rf"""
SELECT conv_id, turn, lower(trim(regexp_replace(text, '{WS}', ' ', 'g'))) AS header_key,
  array_to_string(list_filter([trim(regexp_replace(x, '{WS}', ' ', 'g')) FOR x IN string_split(text, chr(10))], lambda x: x <> ''), chr(10)) AS lines,
  trim(regexp_replace(text, '{WS}', ' ', 'g')) AS compact,
  regexp_replace(regexp_replace(text, '{WS}', ' ', 'g'), '^[ .,;:-]+|[ .,;:-]+$', '', 'g') AS entity, substr(text, 1, 100) AS clean
FROM conversations
"""


def cells_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N9, N11, N14, N15 on arrays of names."""
    p = load(spark, sf_dir, "part")
    cells = F.array(F.col("p_name"), F.lit(" "), F.upper("p_name"), F.col("p_brand"), F.when(F.col("p_size") > 9, F.col("p_type")))
    return p.select("p_partkey", cells.alias("c")).select("p_partkey", F.array_join(C.norm_headers(F.col("c")), "|").alias("headers"), C.is_empty_row(F.slice("c", 2, 1)).alias("blank"), C.join_values(C.unique_ci(F.col("c"))).alias("names"))


CELLS_ARRAYS = """
SELECT p_partkey, p_name || '|column_2|' || upper(p_name) || '|' || p_brand || '|' || CASE WHEN p_size > 9 THEN p_type ELSE 'column_5' END AS headers, true AS blank,
  p_name || CASE WHEN lower(p_brand) <> lower(p_name) THEN '; ' || p_brand ELSE '' END || CASE WHEN p_size > 9 THEN '; ' || p_type ELSE '' END AS names
FROM part
"""


def phones_and_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N16, N19, N20, N22, N26, N27 on customers."""
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    phone = F.when(k % 3 == 0, F.concat(F.lit("8 (9"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(") 1234567 "))).otherwise(F.concat(F.lit(" tel "), k.cast("string")))
    path = F.when(k % 3 == 0, F.concat(F.lit("/data/Results/"), F.col("c_mktsegment"), F.lit("/sub/file.csv"))).when(k % 3 == 1, F.concat(F.lit("C:\\x\\"), F.col("c_mktsegment"), F.lit("\\file.csv"))).otherwise(F.lit("file.csv"))
    names = F.create_map(F.lit("a"), F.lit(" "), F.lit("b"), F.when(k % 2 == 0, F.col("c_name")), F.lit("c"), F.col("c_mktsegment"))
    return c.select("c_custkey", C.norm_phone(phone).alias("phone"), C.listing_url(F.when(k % 5 > 0, k), "https://x.example/{}/detail").alias("link"), C.search_url(F.concat(F.col("c_name"), F.lit(" a*b~c"))).alias("search"), C.category_of(path).alias("category"), C.yes_no(k % 2 == 0).alias("even"), C.company_name(names, ("a", "b", "c")).alias("company"))


PHONES_AND_LINKS = """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '+7 9' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || ' 123-45-67' ELSE 'tel ' || c_custkey END AS phone,
  CASE WHEN c_custkey % 5 > 0 THEN 'https://x.example/' || c_custkey || '/detail' END AS link,
  'https://search.example/?q=' || replace(c_name, '#', '%23') || '+a%2Ab~c' AS search,
  CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ' / sub' WHEN 1 THEN c_mktsegment ELSE '' END AS category,
  CASE WHEN c_custkey % 2 = 0 THEN 'да' ELSE 'нет' END AS even, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS company
FROM customer
"""


def brand_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N23 - N25, D20 on part names."""
    p = load(spark, sf_dir, "part")
    name = F.concat(F.col("p_name"), F.lit(" Жемчуг'Щука & "), F.col("p_brand"))
    return p.select("p_partkey", F.array_join(C.brand_tokens(name), " ").alias("tokens"), C.translit(F.lower(name)).alias("latin"), C.norm_brand(name).alias("brand"), F.array_join(search_queries(F.col("p_name")), "|").alias("queries"))


BRAND_TEXT = """
WITH d AS (SELECT p_partkey, p_name, p_name || ' Жемчуг''Щука & ' || p_brand AS name FROM part)
SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(lower(name), '[a-zа-яё0-9]+'), lambda x: length(x) >= 3), ' ') AS tokens,
  replace(lower(name), 'жемчуг''щука', 'zhemchug''schuka') AS latin, replace(lower(name), '''', '') AS brand,
  p_name || ' официальный сайт' || CASE WHEN array_to_string(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: length(x) >= 3), ' ') NOT IN ('', lower(p_name)) THEN '|' || array_to_string(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: length(x) >= 3), ' ') || ' официальный сайт' ELSE '' END AS queries
FROM d
"""


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 - U6, U8, U9, U14 - U16, S18 on page addresses."""
    p = load(spark, sf_dir, "pages")
    u = F.col("url")
    return p.select(
        "page_id", U.looks_like_website(u).alias("website"), U.normalize_url(F.regexp_replace(u, "^https?://", " ")).alias("normal"), U.canonical_url(u).alias("canonical"), U.canonical_url(u, True).alias("with_query"), U.registered_domain(u).alias("domain"),
        U.is_marketplace(u).alias("marketplace"), U.domain_in(u, ("example.org",)).alias("listed"), U.same_domain(u, F.lit("https://a.b.example.com/x")).alias("same"), F.array_join(U.entry_variants(u), " ").alias("variants"),
        U.is_analyzable(F.lit(200) + F.col("page_id").cast("int") % 300, F.lit("text/html"), F.col("html"), F.lit(False)).alias("analyzable"), U.needs_render(F.lit(400) + F.col("page_id").cast("int") % 30, F.lit("x")).alias("render"), U.zone_score(F.regexp_replace(U.host(u), "org$", "de")).alias("zone"),
    )


URL_PARTS = r"""
WITH d AS (SELECT page_id, url, html, regexp_extract(url, '^(https?)://', 1) AS sch, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
e AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE path END AS p1, regexp_replace(path, '/+$', '') AS p2, CASE WHEN q <> '' THEN '?' || q ELSE '' END AS qq, regexp_replace(host, '^www\.', '') AS bare FROM d),
f AS (SELECT *, CASE WHEN p2 = '' THEN '/' ELSE p2 END AS p3, CASE WHEN starts_with(host, 'www.') THEN host ELSE bare END AS h1, CASE WHEN starts_with(host, 'www.') THEN bare ELSE 'www.' || bare END AS h2, CASE WHEN sch = 'http' THEN 'https' ELSE 'http' END AS s2, regexp_replace(url, '#.*$', '') AS u0 FROM e)
SELECT page_id, true AS website, 'https://' || regexp_replace(url, '^https?://', '') AS normal, sch || '://' || lower(host) || p3 AS canonical, sch || '://' || lower(host) || p3 || qq AS with_query,
  regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS domain, false AS marketplace, regexp_extract(host, '([^.]+\.[^.]+)$', 1) = 'example.org' AS listed, regexp_extract(host, '([^.]+\.[^.]+)$', 1) = 'example.com' AS same,
  u0 || CASE WHEN u0 <> sch || '://' || h1 || p1 || qq THEN ' ' || sch || '://' || h1 || p1 || qq ELSE '' END || ' ' || sch || '://' || h2 || p1 || qq || ' ' || s2 || '://' || h1 || p1 || qq || ' ' || s2 || '://' || h2 || p1 || qq AS variants,
  html <> '' AND 200 + page_id % 300 < 400 AS analyzable, 400 + page_id % 30 IN (403, 429) AS render, CASE WHEN host LIKE '%.org' THEN -10 ELSE 0 END AS zone
FROM f
"""


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped addresses and seller paths made of page ids."""
    p = load(spark, sf_dir, "pages")
    i = F.col("page_id")
    target = F.concat(F.lit("https://site.example/"), i.cast("string"))
    quoted = F.url_encode(target)
    wrapped = (
        F.when(i % 6 == 0, F.concat(F.lit("/url?q="), quoted, F.lit("&sa=U")))
        .when(i % 6 == 1, F.concat(F.lit("//duckduckgo.com/l/?x=1&uddg="), quoted))
        .when(i % 6 == 2, F.concat(F.lit("https://yandex.ru/clck?to="), quoted))
        .when(i % 6 == 3, F.lit("https://www.google.com/search?q=a"))
        .when(i % 6 == 4, target)
        .otherwise(F.lit("mailto:x@y.z"))
    )
    href = F.when(i % 3 == 0, F.concat(F.lit("/seller/"), i.cast("string"))).when(i % 3 == 1, F.lit("/seller/name-x")).otherwise(F.lit("/catalog/1"))
    base = F.lit("https://www.wildberries.ru/catalog/5/detail.aspx")
    return p.select("page_id", U.unwrap_redirect(wrapped).alias("target"), U.is_seller_url(U.join_url(base, href)).alias("numbered"), U.seller_url(base, href).alias("seller"), U.seller_url(base, href, allow_slug=True).alias("any_seller"), U.is_unexpected_url(U.join_url(F.when(i % 2 == 0, base).otherwise(F.lit("https://other.example/")), href)).alias("unexpected"))


REDIRECTS = """
SELECT page_id, CASE WHEN page_id % 6 IN (0, 1, 2, 4) THEN 'https://site.example/' || page_id END AS target, page_id % 3 = 0 AS numbered,
  CASE WHEN page_id % 3 = 0 THEN 'https://www.wildberries.ru/seller/' || page_id END AS seller,
  CASE page_id % 3 WHEN 0 THEN 'https://www.wildberries.ru/seller/' || page_id WHEN 1 THEN 'https://www.wildberries.ru/seller/name-x' END AS any_seller, page_id % 2 = 1 AS unexpected
FROM pages
"""

QUERIES = {f.__name__: f for f in (cells_numbers, cells_text, cells_arrays, phones_and_links, brand_text, url_parts, redirects)}
ORACLES = {"cells_numbers": CELLS_NUMBERS, "cells_text": CELLS_TEXT, "cells_arrays": CELLS_ARRAYS, "phones_and_links": PHONES_AND_LINKS, "brand_text": BRAND_TEXT, "url_parts": URL_PARTS, "redirects": REDIRECTS}
