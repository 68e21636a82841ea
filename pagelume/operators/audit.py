"""Website audit end to end: each requested address is resolved among stored responses, its site's pages are chosen as a
crawler would fetch them, and their signals give status and reason.

Responses are (page_id, url, html) and, where they differ from the defaults, final_url (the url), status (200), content_type
(text/html) and rendered (false; a rendered response is what a browser showed for that address). A response answers the
canonical form of its url; of several the least page_id.

Scale: HTML is read in scans only. What is joined are narrow rows: facts of a response, its scored links, its signals. A site
is worked out once, however many rows ask for it, and has at most `most` pages, so no group grows with a site. Facts, entries
and pages of sites are checkpoints of narrow rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dictionaries as D
from ..functions import html as H
from ..functions import urls as U
from ..functions.cells import let, unique_ci
from ..sources.tables import cut, growing
from .pages import SIGNALS, Terms, crawl_link_score, ecom_score, page_signals, site_fit

#: Pages of a site that are looked at, and links of its entry page that are tried.
PAGES, CANDIDATES = 6, 16

#: Columns of an audited row, and their types.
RESULT = {
    "normalized_url": "string", "final_url": "string", "domain": "string", "title": "string", "http_status": "int", "status": "string",
    "reason": "string", "ecom_score": "int", "evidence_pages": "array<string>", "checked_pages": "array<string>",
    "marketplace_links": "array<string>", "hacked_terms": "array<string>", "has_marketplace_a": "boolean", "has_marketplace_b": "boolean", "error": "string",
}


def responses(stored: DataFrame) -> DataFrame:
    """Stored responses with all columns."""
    default = {"final_url": F.col("url"), "status": F.lit(200), "content_type": F.lit("text/html"), "rendered": F.lit(False)}
    given = {c: F.coalesce(F.col(c), v) for c, v in default.items() if c in stored.columns}
    return stored.select("page_id", "url", "html", *[v.alias(c) for c, v in (default | given).items()])


def response_facts(stored: DataFrame) -> DataFrame:
    """What is decided from one response alone, without its HTML; one row for each canonical address and kind."""
    title = H.html_title(F.col("html"))
    readable = U.is_html(F.col("content_type"), F.col("html"))
    facts = stored.select(
        U.canonical_url(F.col("url")).alias("key"), "rendered", "page_id", "final_url", "status", title.alias("title"), readable.alias("readable"),
        (readable & ((F.col("status") < 400) | F.col("rendered"))).alias("analyzable"), (~F.col("rendered") & U.needs_render(F.col("status"), title)).alias("again"),
    )
    rest = [c for c in facts.columns if c not in ("key", "rendered")]
    return facts.groupBy("key", "rendered").agg(F.min_by(F.struct(*rest), "page_id").alias("f")).select("key", "rendered", "f.*")


FACTS = ("page_id", "final_url", "status", "title", "readable", "analyzable", "again", "rendered")


def entry_pages(sites: DataFrame, facts: DataFrame) -> DataFrame:
    """Of each site (a normalised address) the first of its variants that answers without an error, else the first
    that answers; a blocked or loading page gives way to its rendered response where one is stored."""
    variants = sites.select("site", F.posexplode(U.entry_variants(F.col("site"))).alias("nth", "variant")).withColumn("key", U.canonical_url(F.col("variant")))
    answers = variants.join(growing(facts.where("not rendered")), "key")
    best = F.struct((F.col("status") >= 400).alias("bad"), "nth")
    first = answers.groupBy("site").agg(F.min_by(F.struct(*FACTS), best).alias("p"), F.min_by("variant", best).alias("variant"))
    keyed = first.withColumn("key", F.when(F.col("p.again"), U.canonical_url(F.col("p.final_url"))))
    shown = facts.where("rendered").select("key", F.struct(*FACTS).alias("shown"))
    settled = keyed.where("key is not null").join(growing(shown), "key", "left").select("site", F.coalesce("shown", "p").alias("p"), F.col("p.status").alias("http_status"))
    return settled.unionByName(keyed.where("key is null").select("site", "p", F.col("p.status").alias("http_status"))).select("site", "p.*")


def crawl_links(stored: DataFrame, score=crawl_link_score, keep_query: bool = False) -> DataFrame:
    """C10, C11, D12, D13 of single pages: page_id, candidate, score: links to the page's own domain, the best score of each, and the common paths without a link."""
    here = F.col("final_url")
    base = stored.select("page_id", "final_url", U.registered_domain(here).alias("own"), H.anchor_array(F.col("html")).alias("a"))
    own = lambda u: F.col("own").isNull() | F.coalesce(U.registered_domain(u) == F.col("own"), F.lit(False))
    link = lambda a: let(U.resolve_href(here, a["href"], keep_query), lambda u: F.struct(u.alias("candidate"), F.when(own(u), score(u, a["text"])).alias("score")))
    links = base.select("page_id", F.inline(F.transform("a", link))).where("candidate is not null and score > 0")
    return links.groupBy("page_id", "candidate").agg(F.max("score").alias("score"))


def ranked_candidates(entries: DataFrame, links: DataFrame, common: tuple[str, ...], k: int) -> DataFrame:
    """site, rank, key: the k best candidates of each entry page, one for each canonical address, without the entry's own."""
    origin = F.concat(U.scheme(F.col("final_url")), F.lit("://"), U.host(F.col("final_url")))
    usual = F.transform(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(50 - i).alias("score")) for i, p in enumerate(common)]), lambda x: F.struct(F.concat(origin, x["p"]).alias("candidate"), x["score"].alias("score"), F.lit(1).alias("usual")))
    found = entries.select("site", "page_id").join(growing(links), "page_id").select("site", "candidate", "score", F.lit(0).alias("usual"))
    both = found.unionByName(entries.select("site", F.inline(usual)))
    best = both.groupBy("site", "candidate").agg(F.min_by("score", "usual").alias("score"))
    order = Window.partitionBy("site").orderBy(F.desc("score"), F.length(U.path(F.col("candidate"))), "candidate")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = ranked.groupBy("site", U.canonical_url(F.col("candidate")).alias("key")).agg(F.min("rank").alias("rank"))
    return first.join(growing(entries.select("site", U.canonical_url(F.col("final_url")).alias("entry_key"))), "site").where("key <> entry_key").drop("entry_key")


def site_pages(entries: DataFrame, stored: DataFrame, facts: DataFrame, common: tuple[str, ...] = D.SHOP_PATHS, most: int = PAGES, k: int = CANDIDATES) -> DataFrame:
    """Site, nth, and the facts of its pages: the entry (0), then the first candidates that answer with readable pages.
    An entry that can't be read, or of a marketplace, is its site's only page."""
    opened = entries.where(F.col("readable") & ((F.col("status") < 400) | F.col("rendered")) & ~U.is_marketplace(F.col("final_url")))
    candidates = ranked_candidates(opened, crawl_links(stored), common, k)
    good = facts.where("not rendered and readable and status < 400")
    order = Window.partitionBy("site").orderBy("rank")
    more = candidates.join(growing(good), "key").withColumn("nth", F.row_number().over(order)).where(F.col("nth") < most)
    return entries.select("site", F.lit(0).alias("nth"), *FACTS).unionByName(more.select("site", "nth", *FACTS))


def site_verdicts(read: DataFrame) -> DataFrame:
    """A5 of a site's few pages in order (site, nth, facts, signals, score): signals of the whole, lists without repeats, title of the first page."""
    page = F.struct("nth", "final_url", "title", "score", F.col("marketplace_links").alias("links"), F.col("hacked_terms").alias("hacked"))
    blocked = F.col("rendered") & F.col("status").isin(*U.BLOCKED)
    by_site = read.groupBy("site").agg(*[F.bool_or(s).alias(s) for s in SIGNALS], F.array_sort(F.collect_list(page)).alias("seen"), F.bool_or(blocked).alias("hidden"))
    gathered = lambda name: unique_ci(F.flatten(F.transform("seen", lambda x: x[name])))
    urls = lambda pages: F.transform(pages, lambda x: x["final_url"])
    return by_site.select(
        "site", *SIGNALS, "hidden", ecom_score().alias("ecom_score"), F.col("seen")[0]["title"].alias("title"), urls(F.col("seen")).alias("checked"),
        unique_ci(urls(F.filter("seen", lambda x: x["score"] > 0))).alias("evidence"), gathered("links").alias("marketplace_links"), gathered("hacked").alias("hacked_terms"),
    )


def audit_sites(requested: DataFrame, stored: DataFrame, terms: Terms = Terms(), common: tuple[str, ...] = D.SHOP_PATHS) -> DataFrame:
    """Every requested (row_idx, url) with the columns RESULT. NO_SITE: no address; BROKEN: no response, or none of its
    pages can be analysed; NOT_FIT for a marketplace; else the fit of its pages' signals. Null urls are NO_SITE."""
    stored = responses(stored)
    wanted = requested.select("row_idx", F.col("url").alias("requested_url"), U.normalize_url(F.col("url")).alias("site"))
    sites = wanted.where("site is not null").select("site").distinct()
    facts = cut(response_facts(stored))
    entries = cut(entry_pages(sites, facts))
    pages = cut(site_pages(entries, stored, facts, common))
    signals = page_signals(stored.select("page_id", F.col("final_url").alias("url"), "html"), terms).drop("domain", "url").withColumn("score", ecom_score())
    read = pages.where("analyzable").join(growing(signals), "page_id")
    rolled = site_verdicts(read)

    entry = entries.select("site", F.col("final_url").alias("entry_url"), F.col("title").alias("entry_title"), F.col("status").alias("http_status"))
    every = pages.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("nth", "final_url"))).alias("all"))
    joined = wanted.join(growing(entry), "site", "left").join(growing(every), "site", "left").join(growing(rolled), "site", "left")
    domain = F.coalesce(U.registered_domain(F.col("entry_url")), U.registered_domain(F.col("site")))
    joined = joined.withColumn("domain", domain).withColumn("fit", site_fit())
    none, read_any = F.col("entry_url").isNull(), F.col("checked").isNotNull()
    shop = U.is_marketplace(F.col("entry_url"))
    says = lambda s, r: F.struct(F.lit(s).alias("status"), r.alias("reason"))
    suffix = F.when(F.col("hidden"), F.concat(F.lit("; read in a rendered page after HTTP "), F.col("http_status").cast("string"))).otherwise("")
    verdict = (
        F.when(F.col("site").isNull(), says("NO_SITE", F.lit("no address of a site")))
        .when(none, says("BROKEN", F.lit("the site gave no response")))
        .when(~read_any & shop, says("NOT_FIT", F.lit("marketplace, not a site of its own")))
        .when(~read_any, says("BROKEN", F.concat(F.lit("HTTP "), F.col("http_status").cast("string"))))
        .otherwise(F.struct(F.col("fit.status").alias("status"), F.concat(F.col("fit.reason"), suffix).alias("reason")))
    )
    urls = lambda c: F.transform(c, lambda x: x["final_url"])
    empty = F.array().cast("array<string>")
    value = {
        "normalized_url": F.col("site"), "final_url": F.col("entry_url"), "title": F.when(read_any, F.col("title")).otherwise(F.col("entry_title")), "status": verdict["status"], "reason": verdict["reason"],
        "ecom_score": F.coalesce("ecom_score", F.lit(0)), "evidence_pages": F.coalesce("evidence", empty), "checked_pages": F.coalesce(F.when(read_any, F.col("checked")).otherwise(urls("all")), empty),
        "marketplace_links": F.coalesce("marketplace_links", empty), "hacked_terms": F.coalesce("hacked_terms", empty),
        "has_marketplace_a": F.coalesce("has_marketplace_a", F.lit(False)), "has_marketplace_b": F.coalesce("has_marketplace_b", F.lit(False)),
        "error": F.when(F.col("site").isNotNull() & none, F.concat(F.lit("no stored response of "), F.array_join(U.entry_variants(F.col("site")), ", "))),
    }
    return joined.select("row_idx", "requested_url", *[value.get(c, F.col(c)).cast(t).alias(c) for c, t in RESULT.items()])


def export_audit(source: DataFrame, audited: DataFrame) -> DataFrame:
    """The six report columns before the source's (row_idx, ...); of repeated results the last by requested_url; rows without a result keep nulls."""
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    report = F.struct(F.col("status").alias("site_status"), F.col("reason").alias("site_reason"), "http_status", yes("has_marketplace_a").alias("marketplace_a"), yes("has_marketplace_b").alias("marketplace_b"), F.array_join("marketplace_links", "; ").alias("marketplace_links"))
    last = audited.groupBy("row_idx").agg(F.max_by(report, "requested_url").alias("r"))
    return source.join(growing(last), "row_idx", "left").select("r.*", *source.columns)
