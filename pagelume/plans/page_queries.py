"""Queries of the page operators: text, links, signals, audit, crawl plans, contacts, requisites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dictionaries as D
from ..functions import html as H
from ..functions import urls as U
from ..functions.markup import NAMED
from ..operators import audit as A
from ..operators import outcomes as O
from ..operators import pages as P
from ..operators import suffixes as SU
from .bindings import PAGE_TERMS, load, seller_pages

ENT = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&laquo;", "«"), ("&raquo;", "»"), ("&mdash;", "—"), ("&ndash;", "–"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def ents(sql: str) -> str:
    for a, b in ENT:
        sql = f"replace({sql}, '{a}', '{b}')"
    return sql


def squeeze(sql: str) -> str:
    return rf"trim(regexp_replace({sql}, '[\s\x{{00A0}}]+', ' ', 'g'))"


def text_sql(html: str) -> str:
    out = f"regexp_replace({html}, '(?is)^.*?<body[^>]*>', '')"
    for p in ("(?s)<!--.*?-->", "(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "<[^>]+>"):
        out = f"regexp_replace({out}, '{p}', ' ', 'g')"
    return squeeze(ents(out))


TITLE_SQL = "nullif(" + squeeze(ents("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')")) + ", '')"
ANCHOR_SQL = r"""(?is)<a\s[^>]*?href\s*=\s*["'']?([^"''>\s]*)[^>]*>(.*?)</a>"""
LINKS_SQL = f"""
a0 AS (SELECT page_id, url, unnest(list_zip(regexp_extract_all(html, '{ANCHOR_SQL}', 1), regexp_extract_all(html, '{ANCHOR_SQL}', 2), range(0, len(regexp_extract_all(html, '{ANCHOR_SQL}', 1))))) AS z FROM pages),
a AS (SELECT page_id, url, z[3]::INTEGER AS pos, {ents("z[1]")} AS href, {squeeze(ents("regexp_replace(z[2], '<[^>]+>', ' ', 'g')"))} AS text FROM a0)
"""


def any_sql(col: str, terms: tuple) -> str:
    return "(" + " OR ".join(f"contains({col}, '{t}')" for t in terms) + ")"


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1, E2"""
    return load(spark, sf_dir, "pages").select("page_id", H.html_text(F.col("html")).alias("text"), H.html_title(F.col("html")).alias("title"))


HTML_TEXT = f"SELECT page_id, {text_sql('html')} AS text, {TITLE_SQL} AS title FROM pages"


def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3, U7"""
    a = P.anchors(load(spark, sf_dir, "pages"))
    return a.select("page_id", "pos", "href", "text", U.resolve_href(F.col("url"), F.col("href")).alias("link"))


RESOLVE_SQL = r"""CASE WHEN starts_with(href, '/') AND NOT starts_with(href, '//') AND NOT regexp_matches(lower(regexp_replace(href, '[?#].*$', '')), '\.(pdf|doc|docx|xls|xlsx|zip|rar|jpg|jpeg|png|webp|gif|svg)$')
  THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) || regexp_replace(href, '[?#].*$', '') END"""
PAGE_ANCHORS = f"WITH {LINKS_SQL} SELECT page_id, pos, href, text, {RESOLVE_SQL} AS link FROM a"


ODD = (
    """<!-- <p>hidden</p> <a href="/no">no</a> -- -->""", """<script>if (a<b && c>d) { x = "<p>" }</SCRIPT >""", """<p title="5 > 4" data-x='<b>'>quoted</p>""", """&#8381; &#x20BD; &euro; &amp;lt; &nosuch; &hellip;""",
    """<a title="href=/no" href='/single?a=1&amp;b=2'>one<a href=/bare>two</a>""", """1 < 2 and 3 > 2""", """<STYLE media="a>b">p > a {}</style><![CDATA[x]]>""", """<p><b>open<i>tags""",
)


def odd_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 - E3 on pages into which odd markup was put, by page_id, in front of the title and of the article."""
    part = F.get(F.array(*map(F.lit, ODD)), (F.col("page_id") % len(ODD)).cast("int"))
    html = F.regexp_replace(F.replace("html", F.lit("<article>"), F.concat(part, F.lit("<article>"))), "<title>", F.when(F.col("page_id") % 3 == 0, "<!-- <title>no</title> --><TITLE lang='a>b'>").otherwise("<title>"))
    p = load(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    links = F.array_join(F.transform(H.anchor_array(F.col("html")), lambda a: F.concat_ws(" ", a["href"], a["text"])), " | ")
    return p.select("page_id", H.html_text(F.col("html")).alias("text"), H.html_title(F.col("html")).alias("title"), links.alias("links"))


ATTRS_SQL = r"""(?:[^>=]|=\s*(?:"[^"]*"|''[^'']*''|[^\s>"''][^\s>]*)?)*"""
TAGS_SQL = rf"</?[a-z]{ATTRS_SQL}>"
TOKENS_SQL = rf"(?is)(?:<!--(?:-?>|.*?(?:--!?>|\z))|<script(?:[\s/]{ATTRS_SQL})?>.*?(?:</script(?:[\s/][^>]*)?>|\z)|<style(?:[\s/]{ATTRS_SQL})?>.*?(?:</style(?:[\s/][^>]*)?>|\z)|<[!?][^>]*>|</[^a-zA-Z][^>]*>)|(<title(?:[\s/]{ATTRS_SQL})?>.*?(?:</title(?:[\s/][^>]*)?>|\z)|{TAGS_SQL})"
ENTITY_SQL = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
NAMES_SQL = "MAP {" + ", ".join("'" + k + "': '" + v.replace("'", "''") + "'" for k, v in NAMED.items()) + "}"


def decoded_sql(text: str) -> str:
    one = f"CASE WHEN e LIKE '&#x%' OR e LIKE '&#X%' THEN chr(('0x' || e[4:-2])::INTEGER) WHEN e LIKE '&#%' THEN chr(e[3:-2]::INTEGER) ELSE coalesce(names[e[2:-2]], e) END"
    return f"list_aggregate(list_transform(list_zip(regexp_split_to_array({text}, '{ENTITY_SQL}'), list_concat(list_transform(regexp_extract_all({text}, '{ENTITY_SQL}'), lambda e: {one}), [''])), lambda z: z[1] || z[2]), 'string_agg', '')"


ODD_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in ODD) + "]"
HREF_SQL = r"""(?is)^<a(?:[\s/]+|[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>"''][^\s>]*)?)?)*?[\s/]href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']*))"""
ODD_PAGES = rf"""
WITH names AS (SELECT {NAMES_SQL} AS names),
o AS (SELECT page_id, replace(replace(html, '<article>', {ODD_SQL}[page_id % {len(ODD)} + 1] || '<article>'), '<title>', CASE WHEN page_id % 3 = 0 THEN '<!-- <title>no</title> --><TITLE lang=''a>b''>' ELSE '<title>' END) AS html FROM pages),
c AS (SELECT page_id, names, regexp_replace(html, '{TOKENS_SQL}', ' \1', 'g') AS h FROM o, names),
t AS (SELECT page_id, names, h, regexp_replace(regexp_replace(h, '(?is)^.*?<body(?:[\s/]{ATTRS_SQL})?>', ''), '(?is){TAGS_SQL}', ' ', 'g') AS b, regexp_extract(h, '(?is)<title(?:[\s/]{ATTRS_SQL})?>(.*?)</title', 1) AS ti FROM c),
l0 AS (SELECT page_id, names, unnest(list_zip(regexp_extract_all(h2, '(?is)(<a[\s/]{ATTRS_SQL})>(.*?)(?:</a>|\z)', 1), regexp_extract_all(h2, '(?is)(<a[\s/]{ATTRS_SQL})>(.*?)(?:</a>|\z)', 2))) AS z, generate_subscripts(regexp_extract_all(h2, '(?is)<a[\s/]{ATTRS_SQL}>(.*?)(?:</a>|\z)'), 1) AS i
  FROM (SELECT page_id, names, regexp_replace(h, '(?i)<a([\s/])', '</a><a\1', 'g') AS h2 FROM t)),
l1 AS (SELECT page_id, names, i, regexp_extract(z[1], '{HREF_SQL}', 1) || regexp_extract(z[1], '{HREF_SQL}', 2) || regexp_extract(z[1], '{HREF_SQL}', 3) AS href, regexp_replace(z[2], '(?is){TAGS_SQL}', ' ', 'g') AS text FROM l0),
l AS (SELECT page_id, string_agg({decoded_sql("href")} || ' ' || {squeeze(decoded_sql("text"))}, ' | ' ORDER BY i) AS links FROM l1 GROUP BY page_id)
SELECT t.page_id, {squeeze(decoded_sql("b"))} AS text, nullif({squeeze(decoded_sql("ti"))}, '') AS title, coalesce(links, '') AS links FROM t LEFT JOIN l USING (page_id)
"""


def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E22, E24 - E27"""
    s = P.page_signals(load(spark, sf_dir, "pages"), PAGE_TERMS)
    return s.select("page_id", "domain", *P.SIGNALS, F.array_join("marketplace_links", "; ").alias("marketplace_links"), F.array_join("hacked_terms", ",").alias("hacked_terms"))


T = PAGE_TERMS
DOMAIN_SQL = r"regexp_extract(regexp_extract(url, '^https?://([^/?#]*)', 1), '([^.]+\.[^.]+)$', 1)"
SIGNAL_SQL = {
    "has_catalog": f"{any_sql('t', T.catalog)} OR {any_sql('h', T.catalog_marks)} OR {any_sql('p', T.catalog_marks)}",
    "has_cart": f"{any_sql('t', T.cart)} OR {any_sql('h', T.cart_marks)}",
    "has_checkout": f"{any_sql('t', T.checkout)} OR {any_sql('h', T.checkout_marks)}",
    "has_buy_button": f"{any_sql('t', T.buy)} OR {any_sql('h', T.buy)}",
    "has_price": r"""regexp_matches(t, '\d[\d\s]{0,12}(₽|руб\.?|рублей)') OR contains(h, '₽') OR contains(t, 'руб') OR contains(h, 'data-price') OR contains(h, 'itemprop="price"')""",
    "has_product_page": f"{any_sql('h', T.product_marks)} OR {any_sql('p', T.product_marks)} OR {any_sql('h', T.structured_marks)}",
    "has_structured_product_data": any_sql("h", T.structured_marks),
    "has_ecommerce_platform": any_sql("h", T.platform_marks),
    "has_delivery": any_sql("t", T.delivery),
    "has_payment": any_sql("t", T.payment),
    "has_consumer_language": any_sql("t", T.consumer),
    "has_manufacturer_language": any_sql("t", T.manufacturer),
    "request_only": any_sql("t", T.request),
    "callback_only": any_sql("t", T.callback),
    "quote_only": any_sql("t", T.quote),
    "has_b2b_language": any_sql("t", T.b2b),
    "has_marketplace_a": f"len(list_filter(links, lambda x: {any_sql('x', T.marketplace_a)})) > 0",
    "has_marketplace_b": f"len(list_filter(links, lambda x: {any_sql('x', T.marketplace_b)})) > 0",
}
SIGNALS_SQL = f"""
{LINKS_SQL},
m0 AS (SELECT page_id, lower(href) AS k, min(pos) AS pos, arg_min(trim(href), pos) AS href FROM a WHERE {any_sql('lower(href)', T.marketplace_a + T.marketplace_b)} GROUP BY 1, 2),
m AS (SELECT page_id, list(href ORDER BY pos) AS links FROM m0 GROUP BY 1),
d AS (SELECT pages.page_id, {DOMAIN_SQL} AS domain, lower({text_sql('html')}) AS t, lower(html) AS h, lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)) AS p, coalesce(links, []) AS links FROM pages LEFT JOIN m USING (page_id)),
v AS (SELECT page_id, domain, {", ".join(f"({s}) AS {k}" for k, s in SIGNAL_SQL.items())}, links,
  list_filter([{", ".join(f"CASE WHEN regexp_matches(t, '(?:^|[^\\p{{L}}\\p{{N}}_]){w}(?:$|[^\\p{{L}}\\p{{N}}_])') THEN '{w}' END" for w in T.hacked)}], lambda x: x IS NOT NULL) AS hacked FROM d)
"""
PAGE_SIGNALS = f"WITH {SIGNALS_SQL} SELECT page_id, domain, {', '.join(P.SIGNALS)}, array_to_string(links, '; ') AS marketplace_links, array_to_string(hacked, ',') AS hacked_terms FROM v"


def page_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites by host with score and fit. The flagship query."""
    pages = load(spark, sf_dir, "pages")
    s = P.page_signals(pages, PAGE_TERMS).withColumn("domain", U.bare_host(F.col("url")))
    sites = P.site_signals(s).withColumn("fit", P.site_fit())
    return sites.select("domain", "pages", "evidence_pages", "ecom_score", F.array_join("hacked_terms", ",").alias("hacked_terms"), F.size("marketplace_links").alias("n_links"), "fit.status", "fit.reason")


SCORE_SQL = " + ".join(f"{w} * {s}::INT" for s, w in P.WEIGHTS.items())
SITES_SQL = f"""
{SIGNALS_SQL},
w AS (SELECT v.* REPLACE (regexp_extract(url, '^https?://([^/?#]*)', 1) AS domain), ({SCORE_SQL}) AS score FROM v JOIN pages USING (page_id)),
x AS (SELECT domain, count(*) AS pages, count(*) FILTER (score > 0) AS evidence_pages, {", ".join(f"bool_or({s}) AS {s}" for s in P.SIGNALS)}, bool_or(list_contains(hacked, 'casino')) AS h1, bool_or(list_contains(hacked, 'the')) AS h2,
  min(CASE WHEN list_contains(hacked, 'casino') THEN page_id * 2 END) AS o1, min(CASE WHEN list_contains(hacked, 'the') THEN page_id * 2 + 1 END) AS o2, len(list_distinct(list_transform(flatten(list(links)), lambda z: lower(z)))) AS n_links FROM w GROUP BY domain),
y AS (SELECT *, ({SCORE_SQL}) AS ecom_score, CASE WHEN h1 AND h2 THEN CASE WHEN o1 < o2 THEN 'casino,the' ELSE 'the,casino' END WHEN h1 THEN 'casino' WHEN h2 THEN 'the' ELSE '' END AS hacked_terms,
  has_cart OR has_checkout AS ord, has_catalog OR has_product_page OR has_structured_product_data AS struct_, has_price OR has_buy_button AS com FROM x),
z AS (SELECT *, CASE WHEN hacked_terms <> '' THEN 1 WHEN ord AND struct_ AND com THEN 2 WHEN ord AND ecom_score >= 6 THEN 3 WHEN ord THEN 4 WHEN request_only OR callback_only OR quote_only THEN 5
  WHEN has_b2b_language AND NOT has_consumer_language THEN 6 WHEN struct_ AND com AND ecom_score >= 5 THEN 7 WHEN struct_ AND ecom_score >= 6 THEN 8 WHEN has_manufacturer_language AND struct_ AND n_links > 0 THEN 9 ELSE 10 END AS c FROM y)
"""
PAGE_AUDIT = f"""
WITH {SITES_SQL} SELECT domain, pages, evidence_pages, ecom_score::INTEGER AS ecom_score, hacked_terms, n_links::INTEGER AS n_links,
  CASE c WHEN 1 THEN 'HACKED' WHEN 2 THEN 'FIT_NOW' WHEN 3 THEN 'FIT_NOW' WHEN 4 THEN 'FIT_LATER' WHEN 7 THEN 'FIT_LATER' WHEN 8 THEN 'FIT_LATER' WHEN 9 THEN 'FIT_LATER' ELSE 'NOT_FIT' END AS status,
  CASE c WHEN 1 THEN 'suspicious words: ' || replace(hacked_terms, ',', ', ') WHEN 2 THEN 'cart or checkout, product structure and commercial signals' WHEN 3 THEN 'cart or checkout and enough other signals'
   WHEN 4 THEN 'cart or checkout, but weak product structure or prices' WHEN 5 THEN 'no cart: requests, calls or quotes' WHEN 6 THEN 'no cart: business or industrial site' WHEN 7 THEN 'products and commercial signals, no cart'
   WHEN 8 THEN 'product structure, no cart or checkout' WHEN 9 THEN 'brand with product structure, no cart' ELSE 'no cart and too few signals' END AS reason FROM z
"""


#: Rules under which the pages' hosts fall in each kind: plain of one and two labels, wildcard, exception, none.
SUFFIX_RULES = ("com", "example.com", "*.net", "!example.net", "*.example.org")


def suffix_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U5 by a table of rules."""
    rules = SU.rules_of(spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string"))
    return SU.with_domain(load(spark, sf_dir, "pages").select("page_id", "url"), F.col("url"), rules).select("page_id", "domain")


SUFFIX_DOMAINS = r"""
SELECT page_id, nullif(CASE WHEN h LIKE '%.example.com' OR h = 'example.com' THEN regexp_extract(h, '([^.]+[.]example[.]com)$', 1) WHEN h LIKE '%.com' THEN regexp_extract(h, '([^.]+[.]com)$', 1)
  WHEN h LIKE '%example.net' THEN regexp_extract(h, '(example[.]net)$', 1) WHEN h LIKE '%.net' THEN regexp_extract(h, '([^.]+[.][^.]+[.]net)$', 1)
  WHEN h LIKE '%.example.org' THEN regexp_extract(h, '([^.]+[.][^.]+[.]example[.]org)$', 1) ELSE regexp_extract(h, '([^.]+[.][^.]+)$', 1) END, '') AS domain
FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS h FROM pages)
"""


def site_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 over the audit."""
    return page_audit(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def crawl_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12, C10 by host, with links above common paths, which shows both."""
    return P.rank_crawl(load(spark, sf_dir, "pages"), common_base=9, site=U.bare_host)


def _plan_sql(weights: list, common: tuple, base: int, k: int) -> str:
    score = " + ".join(f"CASE WHEN {any_sql('v', terms)} THEN {w} ELSE 0 END" for terms, w in weights)
    usual = " UNION ALL ".join(f"SELECT site, origin || '{p}' AS candidate, {base - i} AS score, 1 AS usual FROM o" for i, p in enumerate(common))
    site = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
    return f"""
WITH {LINKS_SQL}, l0 AS (SELECT {site} AS site, {RESOLVE_SQL} AS candidate, text FROM a),
l1 AS (SELECT site, candidate, lower(candidate || ' ' || text) AS v FROM l0 WHERE candidate IS NOT NULL), l2 AS (SELECT site, candidate, {score} AS score FROM l1),
l3 AS (SELECT site, candidate, max(score) AS score, 0 AS usual FROM l2 WHERE score > 0 GROUP BY 1, 2),
o AS (SELECT {site} AS site, regexp_extract(arg_min(url, page_id), '^(https?://[^/?#]*)', 1) AS origin FROM pages GROUP BY 1), u AS (SELECT * FROM l3 UNION ALL {usual}),
w AS (SELECT site, candidate, arg_min(score, usual) AS score FROM u GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, length(regexp_extract(candidate, '^https?://[^/?#]*([^?#]*)', 1)), candidate) AS rank FROM w)
SELECT site, candidate, score::INTEGER AS score, rank::INTEGER AS rank FROM r WHERE rank <= {k}
"""


CRAWL_PLAN = _plan_sql([(D.CATALOG_MARKS + D.CATALOG_TERMS, 8), (D.PRODUCT_MARKS, 6), (D.CART_MARKS + D.CART_TERMS, 5), (D.CHECKOUT_MARKS + D.CHECKOUT_TERMS, 5), (D.DELIVERY_TERMS, 3), (D.PAYMENT_TERMS, 3), (D.OFF_TOPIC_LINKS, -6)], D.SHOP_PATHS, 9, 16)


def contact_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D13, C11"""
    return P.rank_contact_pages(load(spark, sf_dir, "pages"), common_base=8, site=U.bare_host)


CONTACT_PLAN = _plan_sql([(D.CONTACT_PATHS, 12), (D.CONTACT_WORDS, 12), (D.CONTACT_MINUS, -8)], D.COMMON_CONTACT_PATHS, 8, 4)


def crawl_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl plan's candidates that are stored, where every page is stored under a shop path of its host, with
    its place among its site's pages that can be analysed."""
    pages = load(spark, sf_dir, "pages")
    origin = F.concat(U.scheme(F.col("url")), F.lit("://"), F.upper(U.host(F.col("url"))))
    stored = pages.withColumn("url", F.concat(origin, F.get(F.array(*map(F.lit, P.D.SHOP_PATHS)), (F.col("page_id") % len(P.D.SHOP_PATHS)).cast("int")), F.lit("#top")))
    good = P.analyzable_pages(stored, 6).select(F.col("page_id").alias("stored_page_id"), "domain", "nth")
    return P.resolve_crawl(P.rank_crawl(pages, site=U.bare_host), stored).join(good, "stored_page_id", "left")


CRAWL_RESOLVED = f"""
WITH p AS ({_plan_sql([(D.CATALOG_MARKS + D.CATALOG_TERMS, 8), (D.PRODUCT_MARKS, 6), (D.CART_MARKS + D.CART_TERMS, 5), (D.CHECKOUT_MARKS + D.CHECKOUT_TERMS, 5), (D.DELIVERY_TERMS, 3), (D.PAYMENT_TERMS, 3), (D.OFF_TOPIC_LINKS, -6)], D.SHOP_PATHS, 50, 16)}),
s AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || rtrim({list(D.SHOP_PATHS)}[page_id % {len(D.SHOP_PATHS)} + 1], '/') AS k, {DOMAIN_SQL} AS domain FROM pages),
m AS (SELECT k, min(page_id) AS stored_page_id FROM s GROUP BY k),
g AS (SELECT page_id AS stored_page_id, domain, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS nth FROM s QUALIFY nth <= 6)
SELECT site, candidate, score, rank, stored_page_id, domain, nth::INTEGER AS nth FROM p JOIN m ON rtrim(candidate, '/') = k LEFT JOIN g USING (stored_page_id)
"""


def email_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E18 - E20 on documents; the phone pattern is that of the documents."""
    phone = r"\+1 \(\d{3}\) \d{3}-\d{4}"
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(H.extract_emails(F.col("text"), F.lit("")), "; ").alias("emails"), F.array_join(H.extract_phones(F.col("text"), phone), "; ").alias("phones"))


EMAIL_TEXTS = r"""
WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_.+-]{2,}@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) AS v, generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}_.+-]{2,}@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'), 1) AS i FROM documents),
e1 AS (SELECT doc_id, arg_min(v, i) AS v, min(i) AS i FROM e WHERE NOT starts_with(split_part(lower(v), '@', 2), 'example.') GROUP BY doc_id, lower(v)),
e2 AS (SELECT doc_id, array_to_string(list(v ORDER BY i)[1:8], '; ') AS emails FROM e1 GROUP BY doc_id),
p AS (SELECT doc_id, unnest(regexp_extract_all(text, '\+1 \(\d{3}\) \d{3}-\d{4}')) AS v, generate_subscripts(regexp_extract_all(text, '\+1 \(\d{3}\) \d{3}-\d{4}'), 1) AS i FROM documents),
p0 AS (SELECT doc_id, i, CASE WHEN regexp_full_match(regexp_replace(v, '[^0-9]', '', 'g'), '[78][0-9]{10}') THEN NULL ELSE v END AS v FROM p), p1 AS (SELECT doc_id, v, min(i) AS i FROM p0 GROUP BY doc_id, v),
p2 AS (SELECT doc_id, array_to_string(list(v ORDER BY i)[1:8], '; ') AS phones FROM p1 GROUP BY doc_id)
SELECT doc_id, coalesce(emails, '') AS emails, coalesce(phones, '') AS phones FROM documents LEFT JOIN e2 USING (doc_id) LEFT JOIN p2 USING (doc_id)
"""


def site_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E21, E23 on the page corpus."""
    c = P.site_contacts(load(spark, sf_dir, "pages"), r"\+1 \(\d{3}\) \d{3}-\d{4}")
    return c.select("domain", *[F.array_join(k, "; ").alias(k) for k in ("emails", "phones", "inns", "legal_entities", "social_links")])


def requisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4 - E17, E29 on seller pages made of events."""
    return O.extract_requisites(seller_pages(spark, sf_dir)).select("page_id", "inn", "ogrn", "ogrnip", "entity_type", "seller_country", "display_name", "empty_results", "has_entrypoint", "on_seller_page")


REQUISITES = """
SELECT event_id AS page_id, CASE WHEN event_type IN ('click', 'purchase') THEN lpad(user_id::VARCHAR, 10, '7') END AS inn, CASE WHEN event_type = 'click' THEN lpad(user_id::VARCHAR, 13, '1') END AS ogrn, NULL::VARCHAR AS ogrnip,
  CASE event_type WHEN 'click' THEN 'ООО' WHEN 'purchase' THEN 'ИП' END AS entity_type, CASE WHEN event_type = 'view' THEN 'БЕЛОРУСЬ' END AS seller_country,
  CASE event_type WHEN 'click' THEN 'ООО "Магазин ' || user_id || '"' WHEN 'signup' THEN 'Магазин ' || user_id WHEN 'view' THEN 'Магазин ' || user_id || ' Республика Беларусь, УНП 1' END AS display_name,
  event_type = 'error' AS empty_results, event_type = 'signup' AS has_entrypoint, user_id % 2 = 0 AS on_seller_page
FROM events
"""


def parse_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1, C3, P5 - P7, P10 - P12, C19, E16 on the requisites."""
    pages = seller_pages(spark, sf_dir)
    r = O.extract_requisites(pages).withColumn("http_status", (F.lit(200) + (F.col("page_id") % 7 == 3).cast("int") * 300)).withColumn("blocked", F.col("page_id") % 11 == 5).withColumn("waited", (F.col("page_id") % 2).cast("int"))
    r = r.withColumn("s", O.parse_status()).withColumn("parse_status", F.col("s.status")).withColumn("note", F.col("s.note"))
    return r.select("page_id", "parse_status", "note", O.info_score().alias("score"), O.needs_recovery().alias("recover"), O.has_any_requisite().alias("any_requisite"), O.skip_recommended(F.col("inn"), F.col("parse_status")).alias("skip"), O.unready_outcome(F.col("blocked")).alias("unready"))


def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_outcomes(spark, sf_dir).groupBy("parse_status").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))


REQ_SQL = "r AS (" + REQUISITES.replace("FROM events", ", 200 + (event_id % 7 = 3)::INT * 300 AS http_status, event_id % 11 = 5 AS blocked, event_id % 2 AS waited FROM events") + ")"
PARSE_OUTCOMES = f"""
WITH {REQ_SQL}, s AS (SELECT *, inn IS NOT NULL OR entity_type IS NOT NULL AS found FROM r),
t AS (SELECT *, CASE WHEN blocked AND found THEN 'PARTIAL_SUCCESS' WHEN blocked AND waited > 0 THEN 'MANUAL_CHECK_REQUIRED' WHEN blocked THEN 'ANTI_BOT_PAGE' WHEN http_status >= 400 AND found THEN 'PARTIAL_SUCCESS' WHEN http_status >= 400 THEN 'PAGE_NOT_AVAILABLE'
  WHEN inn IS NOT NULL THEN 'SUCCESS' WHEN seller_country IS NOT NULL THEN seller_country WHEN entity_type IS NOT NULL THEN 'NEEDS_REVIEW' WHEN empty_results THEN 'NOTHING_FOUND_PAGE' WHEN on_seller_page AND has_entrypoint THEN 'SELLER_PAGE_OPENED'
  WHEN on_seller_page THEN 'Нет реквизитов на странице' WHEN waited > 0 THEN 'PRODUCT_PAGE_OPENED' ELSE 'PAGE_OPENED_NO_REQUISITES' END AS parse_status FROM s)
SELECT page_id, parse_status, CASE WHEN blocked AND found THEN 'block page, yet some requisites' WHEN blocked AND waited > 0 THEN 'block page even after a pause' WHEN blocked THEN 'block page in place of the content'
  WHEN http_status >= 400 AND found THEN 'HTTP status 500, yet some requisites' WHEN http_status >= 400 THEN 'HTTP status 500' WHEN inn IS NOT NULL AND on_seller_page THEN 'tax number on the seller page' WHEN inn IS NOT NULL THEN 'tax number in the page text'
  WHEN seller_country IS NOT NULL THEN 'seller of ' || seller_country WHEN entity_type IS NOT NULL THEN 'signs of requisites, no tax number' WHEN empty_results THEN 'empty page of results' WHEN on_seller_page AND has_entrypoint THEN 'seller page without requisites'
  WHEN on_seller_page THEN 'no requisites on the page' WHEN waited > 0 THEN 'opened after a pause, no requisites yet' ELSE 'opened, no requisites' END AS note,
  (inn IS NOT NULL)::INT * 100 + (ogrn IS NOT NULL)::INT * 40 + (entity_type IS NOT NULL)::INT * 20 + (parse_status IN ('БЕЛОРУСЬ', 'КАЗАХСТАН'))::INT * 25 + (display_name IS NOT NULL)::INT * 5 + 2 AS score,
  parse_status IN ('NEEDS_REVIEW', 'SELLER_PAGE_OPENED', 'PAGE_OPENED_NO_REQUISITES', 'PRODUCT_PAGE_OPENED', 'Нет реквизитов на странице') AS recover, found OR ogrn IS NOT NULL AS any_requisite,
  inn IS NOT NULL OR parse_status IN ('SUCCESS', 'PARTIAL_SUCCESS', 'БЕЛОРУСЬ', 'КАЗАХСТАН', 'Нет реквизитов на странице', 'NOTHING_FOUND_PAGE') AS skip, CASE WHEN blocked THEN 'ANTI_BOT_PAGE' ELSE 'PAGE_LOAD_TIMEOUT' END AS unready
FROM t
"""


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored responses made of the pages: each under its address, with errors, blocks, files and redirects by page_id; what a
    browser showed for the blocked ones; and each once more under a shop path of its host."""
    p, i = load(spark, sf_dir, "pages"), F.col("page_id")
    origin = F.concat(U.scheme(F.col("url")), F.lit("://"), U.host(F.col("url")))
    moved = F.when(i % 17 == 6, F.lit("https://ozon.ru/seller/9")).when(i % 5 == 1, F.concat(origin, F.lit("/moved/"), i.cast("string"))).otherwise(F.col("url"))
    status = F.when(i % 7 == 3, 404).when(i % 7 == 5, 403).otherwise(200)
    kind = F.when(i % 11 == 4, "application/pdf").when(i % 11 == 5, "").otherwise("text/html; charset=utf-8")
    plain = p.select("page_id", "url", "html", moved.alias("final_url"), status.alias("status"), kind.alias("content_type"), F.lit(False).alias("rendered"))
    shown = plain.where("status = 403 and page_id % 2 = 0").select((i + 10**9).alias("page_id"), F.col("final_url").alias("url"), "html", "final_url", "status", F.lit("text/html").alias("content_type"), F.lit(True).alias("rendered"))
    path = F.concat(U.scheme(F.col("url")), F.lit("://"), F.upper(U.host(F.col("url"))), F.get(F.array(*map(F.lit, D.SHOP_PATHS)), (i % len(D.SHOP_PATHS)).cast("int")))
    shop = p.select((i + 2 * 10**9).alias("page_id"), path.alias("url"), "html", path.alias("final_url"), F.when(i % 3 == 0, 500).otherwise(200).alias("status"), F.lit("text/html").alias("content_type"), F.lit(False).alias("rendered"))
    return plain.unionByName(shown).unionByName(shop)


RESPONSES_SQL = f"""
resp AS (SELECT page_id, url, html, CASE WHEN page_id % 17 = 6 THEN 'https://ozon.ru/seller/9' WHEN page_id % 5 = 1 THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/moved/' || page_id ELSE url END AS final_url,
    CASE WHEN page_id % 7 = 3 THEN 404 WHEN page_id % 7 = 5 THEN 403 ELSE 200 END AS status, page_id % 11 <> 4 AS readable, false AS rendered FROM pages
  UNION ALL SELECT page_id + 1000000000, CASE WHEN page_id % 17 = 6 THEN 'https://ozon.ru/seller/9' WHEN page_id % 5 = 1 THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/moved/' || page_id ELSE url END AS u, html, u, 403, true, true FROM pages WHERE page_id % 7 = 5 AND page_id % 2 = 0
  UNION ALL SELECT page_id + 2000000000, regexp_extract(url, '^(https?://)', 1) || upper(regexp_extract(url, '^https?://([^/?#]*)', 1)) || {list(D.SHOP_PATHS)}[page_id % {len(D.SHOP_PATHS)} + 1] AS u, html, u, CASE WHEN page_id % 3 = 0 THEN 500 ELSE 200 END, true, false FROM pages)
"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address for each page: as it is, without scheme, with the other scheme, with or without www; unknown sites, no sites."""
    i, u = F.col("page_id"), F.col("url")
    other = F.when(F.startswith(u, F.lit("https:")), F.regexp_replace(u, "^https:", "http:")).otherwise(F.regexp_replace(u, "^http:", "https:"))
    www = F.when(u.rlike("://www[.]"), F.regexp_replace(u, "://www[.]", "://")).otherwise(F.regexp_replace(u, "://", "://www."))
    bare = F.regexp_replace(u, "^https?://", "")
    asked = F.when(i % 19 == 7, F.concat(F.lit("missing-"), i.cast("string"), F.lit(".example"))).when(i % 23 == 8, F.lit("  ")).when(i % 4 == 1, bare).when(i % 4 == 2, other).when(i % 4 == 3, www).otherwise(u)
    return load(spark, sf_dir, "pages").select(i.alias("row_idx"), asked.alias("url"))


def site_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6 end to end, with U2, U9, U14, U15, D12, D18, J8, P9, A5, C4, C5: resolved addresses, crawled pages, statuses, reasons."""
    out = A.audit_sites(_requests(spark, sf_dir), _responses(spark, sf_dir), PAGE_TERMS)
    lists = ("evidence_pages", "checked_pages", "marketplace_links", "hacked_terms")
    return out.select("row_idx", "requested_url", *[F.array_join(c, " ").alias(c) if c in lists else F.col(c) for c in A.RESULT])


CANON = "regexp_replace(lower(regexp_extract({0}, '^(https?://[^/?#]*)', 1)) || regexp_extract({0}, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '')"
OWN_DOMAIN = r"regexp_extract(lower(regexp_extract({0}, '^https?://([^/?#]*)', 1)), '([^.]+\.[^.]+)$', 1)"
OF_PAGES = SIGNALS_SQL.replace("FROM pages LEFT JOIN m USING (page_id)", "FROM shown LEFT JOIN m USING (page_id)").replace("FROM pages)", "FROM shown)").replace("pages.page_id", "shown.page_id")
REASONS = """CASE c WHEN 0 THEN 'marketplace, not a site of its own' WHEN 1 THEN 'suspicious words: ' || replace(hacked_terms, ' ', ', ') WHEN 2 THEN 'cart or checkout, product structure and commercial signals' WHEN 3 THEN 'cart or checkout and enough other signals'
   WHEN 4 THEN 'cart or checkout, but weak product structure or prices' WHEN 5 THEN 'no cart: requests, calls or quotes' WHEN 6 THEN 'no cart: business or industrial site' WHEN 7 THEN 'products and commercial signals, no cart'
   WHEN 8 THEN 'product structure, no cart or checkout' WHEN 9 THEN 'brand with product structure, no cart' ELSE 'no cart and too few signals' END"""
STATUSES = "CASE c WHEN 1 THEN 'HACKED' WHEN 2 THEN 'FIT_NOW' WHEN 3 THEN 'FIT_NOW' WHEN 4 THEN 'FIT_LATER' WHEN 7 THEN 'FIT_LATER' WHEN 8 THEN 'FIT_LATER' WHEN 9 THEN 'FIT_LATER' ELSE 'NOT_FIT' END"
CRAWL_WEIGHTS = [(D.CATALOG_MARKS + D.CATALOG_TERMS, 8), (D.PRODUCT_MARKS, 6), (D.CART_MARKS + D.CART_TERMS, 5), (D.CHECKOUT_MARKS + D.CHECKOUT_TERMS, 5), (D.DELIVERY_TERMS, 3), (D.PAYMENT_TERMS, 3), (D.OFF_TOPIC_LINKS, -6)]
LINK_SCORE = " + ".join(f"CASE WHEN {any_sql('v', terms)} THEN {w} ELSE 0 END" for terms, w in CRAWL_WEIGHTS)
USUAL_SQL = " UNION ALL ".join(f"SELECT site, lower(regexp_extract(final_url, '^(https?)', 1)) || regexp_extract(final_url, '^https?(://[^/?#]*)', 1) || '{p}' AS candidate, {50 - i} AS score, 1 AS usual FROM opened" for i, p in enumerate(D.SHOP_PATHS))
SITE_AUDITS = f"""
WITH {RESPONSES_SQL}, shown AS (SELECT page_id, final_url AS url, html FROM resp),
{OF_PAGES},
asked AS (SELECT page_id AS row_idx, CASE WHEN page_id % 19 = 7 THEN 'missing-' || page_id || '.example' WHEN page_id % 23 = 8 THEN '  ' WHEN page_id % 4 = 1 THEN regexp_replace(url, '^https?://', '')
   WHEN page_id % 4 = 2 THEN CASE WHEN starts_with(url, 'https:') THEN 'http:' || url[7:] ELSE 'https:' || url[6:] END
   WHEN page_id % 4 = 3 THEN CASE WHEN contains(url, '://www.') THEN replace(url, '://www.', '://') ELSE replace(url, '://', '://www.') END ELSE url END AS requested_url FROM pages),
wanted AS (SELECT *, CASE WHEN trim(requested_url) = '' THEN NULL WHEN regexp_matches(requested_url, '^https?://') THEN requested_url ELSE 'https://' || requested_url END AS site FROM asked),
sites AS (SELECT DISTINCT site, regexp_extract(site, '^(https?)', 1) AS sch, regexp_replace(regexp_extract(site, '^https?://([^/?#]*)', 1), '^www[.]', '') AS h, regexp_matches(site, '^https?://www[.]') AS w, regexp_replace(regexp_extract(site, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS p FROM wanted WHERE site IS NOT NULL),
variants AS (SELECT site, n, CASE WHEN n % 4 < 2 THEN sch WHEN sch = 'https' THEN 'http' ELSE 'https' END || '://' || CASE WHEN w = (n % 2 = 0) THEN 'www.' ELSE '' END || lower(h) || p AS key FROM sites, range(4) t(n)),
tried AS (SELECT *, CASE WHEN sch <> '' THEN 1 END AS x FROM (SELECT v.site, v.n, r.*, '' AS sch FROM variants v JOIN (SELECT *, {CANON.format('url')} AS key FROM resp WHERE NOT rendered QUALIFY row_number() OVER (PARTITION BY {CANON.format('url')} ORDER BY page_id) = 1) r USING (key))),
entry0 AS (SELECT site, page_id, final_url, status, readable, html FROM tried QUALIFY row_number() OVER (PARTITION BY site ORDER BY status >= 400, n) = 1),
browser AS (SELECT *, {CANON.format('url')} AS key FROM resp WHERE rendered QUALIFY row_number() OVER (PARTITION BY {CANON.format('url')} ORDER BY page_id) = 1),
entries AS (SELECT e.site, coalesce(b.page_id, e.page_id) AS page_id, coalesce(b.final_url, e.final_url) AS final_url, coalesce(b.status, e.status) AS status, coalesce(b.readable, e.readable) AS readable, b.page_id IS NOT NULL AS rendered
  FROM entry0 e LEFT JOIN browser b ON e.status = 403 AND {CANON.format('e.final_url')} = b.key),
opened AS (SELECT * FROM entries WHERE readable AND (status < 400 OR rendered) AND NOT contains(final_url, '//ozon.ru/')),
l1 AS (SELECT site, {RESOLVE_SQL.replace("url", "final_url")} AS candidate, text FROM opened JOIN a USING (page_id)),
l2 AS (SELECT site, candidate, max(score) AS score, 0 AS usual FROM (SELECT site, candidate, {LINK_SCORE} AS score FROM (SELECT *, lower(candidate || ' ' || text) AS v FROM l1 WHERE candidate IS NOT NULL)) WHERE score > 0 GROUP BY ALL),
l3 AS (SELECT site, candidate, arg_min(score, usual) AS score FROM (SELECT * FROM l2 UNION ALL {USUAL_SQL}) GROUP BY ALL),
l4 AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, length(regexp_extract(candidate, '^https?://[^/?#]*([^?#]*)', 1)), candidate) AS rank FROM l3 QUALIFY rank <= 16),
l5 AS (SELECT l.site, {CANON.format('candidate')} AS key, min(rank) AS rank FROM l4 l JOIN opened o ON l.site = o.site WHERE {CANON.format('candidate')} <> {CANON.format('o.final_url')} GROUP BY ALL),
good AS (SELECT * FROM (SELECT *, {CANON.format('url')} AS key FROM resp WHERE NOT rendered QUALIFY row_number() OVER (PARTITION BY {CANON.format('url')} ORDER BY page_id) = 1) WHERE readable AND status < 400),
more AS (SELECT site, page_id, final_url, row_number() OVER (PARTITION BY site ORDER BY rank) AS nth FROM l5 JOIN good USING (key) QUALIFY nth < 6),
every AS (SELECT site, page_id, final_url, 0 AS nth, readable AND (status < 400 OR rendered) AS analyzable, rendered FROM entries UNION ALL SELECT site, page_id, final_url, nth, true, false FROM more),
seen AS (SELECT e.*, {", ".join(f"v.{k}" for k in P.SIGNALS)}, links, hacked, ({SCORE_SQL}) AS score, nullif(title, '') AS title FROM every e JOIN v USING (page_id)
   JOIN (SELECT page_id, {TITLE_SQL} AS title FROM shown) USING (page_id) WHERE analyzable),
lnk AS (SELECT site, string_agg(x, ' ' ORDER BY nth, k) AS marketplace_links, count(*) AS n_links FROM (SELECT site, x, nth, k FROM (SELECT site, nth, unnest(links) AS x, generate_subscripts(links, 1) AS k FROM seen) QUALIFY row_number() OVER (PARTITION BY site, lower(x) ORDER BY nth, k) = 1) GROUP BY site),
hck AS (SELECT site, string_agg(x, ' ' ORDER BY nth, k) AS hacked_terms FROM (SELECT site, x, nth, k FROM (SELECT site, nth, unnest(hacked) AS x, generate_subscripts(hacked, 1) AS k FROM seen) QUALIFY row_number() OVER (PARTITION BY site, lower(x) ORDER BY nth, k) = 1) GROUP BY site),
evi AS (SELECT site, string_agg(final_url, ' ' ORDER BY nth) AS evidence_pages FROM (SELECT * FROM seen WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY site, lower(final_url) ORDER BY nth) = 1) GROUP BY site),
x1 AS (SELECT site, {", ".join(f"bool_or({s}) AS {s}" for s in P.SIGNALS)}, arg_min(coalesce(title, ''), nth) AS title, string_agg(final_url, ' ' ORDER BY nth) AS checked_pages, bool_or(rendered) AS hidden FROM seen GROUP BY site),
x2 AS (SELECT *, ({SCORE_SQL}) AS ecom_score, has_cart OR has_checkout AS ord, has_catalog OR has_product_page OR has_structured_product_data AS struct_, has_price OR has_buy_button AS com FROM x1),
x3 AS (SELECT x2.*, hacked_terms, marketplace_links, evidence_pages, e.final_url, e.status AS http_status, CASE WHEN contains(e.final_url, '//ozon.ru/') THEN 0 WHEN hacked_terms <> '' THEN 1 WHEN ord AND struct_ AND com THEN 2 WHEN ord AND ecom_score >= 6 THEN 3 WHEN ord THEN 4
  WHEN request_only OR callback_only OR quote_only THEN 5 WHEN has_b2b_language AND NOT has_consumer_language THEN 6 WHEN struct_ AND com AND ecom_score >= 5 THEN 7 WHEN struct_ AND ecom_score >= 6 THEN 8 WHEN has_manufacturer_language AND struct_ AND n_links > 0 THEN 9 ELSE 10 END AS c
  FROM x2 JOIN entries e USING (site) LEFT JOIN lnk USING (site) LEFT JOIN hck USING (site) LEFT JOIN evi USING (site)),
pl AS (SELECT site, string_agg(final_url, ' ' ORDER BY nth) AS checked_pages FROM every GROUP BY site),
tt AS (SELECT page_id, {TITLE_SQL} AS title FROM shown)
SELECT w.row_idx, w.requested_url, w.site AS normalized_url, e.final_url, CASE WHEN w.site IS NOT NULL THEN {OWN_DOMAIN.format('coalesce(e.final_url, w.site)')} END AS domain,
  CASE WHEN x.site IS NOT NULL THEN nullif(x.title, '') ELSE tt.title END AS title, e.status AS http_status,
  CASE WHEN w.site IS NULL THEN 'NO_SITE' WHEN e.site IS NULL THEN 'BROKEN' WHEN x.site IS NULL AND contains(e.final_url, '//ozon.ru/') THEN 'NOT_FIT' WHEN x.site IS NULL THEN 'BROKEN' ELSE {STATUSES} END AS status,
  CASE WHEN w.site IS NULL THEN 'no address of a site' WHEN e.site IS NULL THEN 'the site gave no response' WHEN x.site IS NULL AND contains(e.final_url, '//ozon.ru/') THEN 'marketplace, not a site of its own' WHEN x.site IS NULL THEN 'HTTP ' || e.status
    ELSE {REASONS} || CASE WHEN hidden THEN '; read in a rendered page after HTTP ' || e.status ELSE '' END END AS reason,
  coalesce(x.ecom_score, 0)::INTEGER AS ecom_score, coalesce(evidence_pages, '') AS evidence_pages, CASE WHEN x.site IS NOT NULL THEN x.checked_pages ELSE coalesce(pl.checked_pages, '') END AS checked_pages,
  coalesce(marketplace_links, '') AS marketplace_links, coalesce(hacked_terms, '') AS hacked_terms, coalesce(x.has_marketplace_a, false) AS has_marketplace_a, coalesce(x.has_marketplace_b, false) AS has_marketplace_b,
  CASE WHEN w.site IS NOT NULL AND e.site IS NULL THEN 'no stored response of https://' || requested_url || ', https://' || requested_url || '/, https://www.' || requested_url || '/, http://' || requested_url || '/, http://www.' || requested_url || '/' END AS error
FROM wanted w LEFT JOIN entries e USING (site) LEFT JOIN x3 x USING (site) LEFT JOIN pl USING (site) LEFT JOIN tt ON tt.page_id = e.page_id
"""


def audited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report columns of the audit beside the rows that were asked for; every third row has no result."""
    asked = _requests(spark, sf_dir)
    audit = A.audit_sites(asked.where("row_idx % 3 > 0"), _responses(spark, sf_dir), PAGE_TERMS)
    return A.export_audit(asked, audit)


AUDITED_ROWS = f"""
SELECT CASE WHEN row_idx % 3 > 0 THEN status END AS site_status, CASE WHEN row_idx % 3 > 0 THEN reason END AS site_reason, CASE WHEN row_idx % 3 > 0 THEN http_status END AS http_status,
  CASE WHEN row_idx % 3 > 0 THEN CASE WHEN has_marketplace_a THEN 'yes' ELSE 'no' END END AS marketplace_a, CASE WHEN row_idx % 3 > 0 THEN CASE WHEN has_marketplace_b THEN 'yes' ELSE 'no' END END AS marketplace_b,
  CASE WHEN row_idx % 3 > 0 THEN replace(marketplace_links, ' ', '; ') END AS marketplace_links, row_idx, requested_url AS url FROM ({SITE_AUDITS})
"""


def term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, E24"""
    return P.term_hits(load(spark, sf_dir, "pages"), TERMS)


TERMS = ("tion", "menteux", "keit", "the and", "casino", "zzz")
TERM_HITS = f"WITH t AS (SELECT page_id, lower({text_sql('html')}) AS t FROM pages), w AS (SELECT unnest({list(TERMS)}) AS term) SELECT page_id, term FROM t JOIN w ON contains(t, term)"


def seller_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product pages made of events with a labelled, a numbered, a named or no seller link."""
    e = load(spark, sf_dir, "events")
    u = F.col("user_id").cast("string")
    label = F.concat(F.lit('<a class="x" aria-label="Подробнее о продавце" href="/seller/name-'), u, F.lit('">Shop</a>'))
    plain = F.concat(F.lit('<a href="/seller/'), F.when(F.col("event_type") == "view", F.concat(F.lit("name-"), u)).otherwise(u), F.lit('">Shop</a>'))
    html = F.concat(F.lit("<body><p>Item</p>"), F.when(F.col("event_type") == "click", F.concat(plain, label)).when(F.col("event_type").isin("view", "purchase"), plain).otherwise(""), F.lit("</body>"))
    base = F.lit("https://www.wildberries.ru/catalog/1/detail.aspx")
    return e.select(F.col("event_id").alias("page_id"), html.alias("html")).select("page_id", H.seller_link(F.col("html"), base).alias("seller"), H.snippet(F.col("html"), F.lit(7)).alias("snippet"))


SELLER_LINKS = """
SELECT event_id AS page_id, CASE event_type WHEN 'click' THEN 'https://www.wildberries.ru/seller/name-' || user_id WHEN 'purchase' THEN 'https://www.wildberries.ru/seller/' || user_id END AS seller,
  CASE event_type WHEN 'click' THEN 'Item Shop Shop' WHEN 'view' THEN 'Item Shop' WHEN 'purchase' THEN 'Item Shop' ELSE 'Item' END AS snippet FROM events
"""

QUERIES = {f.__name__: f for f in (page_audit, html_text, odd_pages, suffix_domains, page_anchors, page_signals, site_status_counts, crawl_plan, contact_plan, crawl_resolved, email_texts, site_contacts, requisites, parse_outcomes, outcome_counts, audited_rows, site_audits, term_hits, seller_links)}
ORACLES = {
    "page_audit": PAGE_AUDIT, "html_text": HTML_TEXT, "odd_pages": ODD_PAGES, "suffix_domains": SUFFIX_DOMAINS, "page_anchors": PAGE_ANCHORS, "page_signals": PAGE_SIGNALS, "site_status_counts": f"SELECT status, count(*) AS n FROM ({PAGE_AUDIT}) GROUP BY status", "crawl_plan": CRAWL_PLAN, "contact_plan": CONTACT_PLAN, "crawl_resolved": CRAWL_RESOLVED,
    "email_texts": EMAIL_TEXTS, "requisites": REQUISITES, "parse_outcomes": PARSE_OUTCOMES, "outcome_counts": f"SELECT parse_status, count(*) AS n, sum(score) AS score FROM ({PARSE_OUTCOMES}) GROUP BY 1", "audited_rows": AUDITED_ROWS, "site_audits": SITE_AUDITS, "term_hits": TERM_HITS, "seller_links": SELLER_LINKS,
}
