"""Brand enrichment end to end: from brands, stored search results and stored pages to a site with contacts for each brand.

Sources are asked one after the other, and each only for the brands that none before it has decided: the first acceptable
result of the engines in their order, guessed addresses, all results of the first engine, all of the second. What is left out is
removed by anti-joins before anything of it is scored. The best candidate's contact pages are then looked up as a crawler
would fetch them, and their contacts gathered in page order.

Brands: row_idx, number, brand, segment, priority. Results: row_idx, engine_ord (0, 1, 2), query_ord, rank, url, title,
snippet. Pages as in `audit`.

Scale: a brand has at most 32 guesses and `most` candidates of a source that go on, a site at most SITE_PAGES pages; contacts
are extracted where pages are scanned, so HTML is never shuffled. The result of each source is a checkpoint of narrow rows, so
the next one starts from there. Null or empty brands have no guesses and NOT_FOUND unless a
result is acceptable; repeated results count once; brands with the same row_idx share their results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dictionaries as D
from ..functions import html as H
from ..functions import urls as U
from ..functions.cells import computed, trim_ws, unique_ci
from ..sources.tables import cut, growing
from . import brands as B
from .audit import crawl_links, ranked_candidates, response_facts, responses
from .domains import brand_addresses
from .pages import contact_link_score

MOST, SITE_PAGES, ENOUGH, BATCH = 8, 4, 45, 8
CONTACTS = {"emails": 8, "phones": 8, "inns": 5, "legal_entities": 5, "social_links": 8}
#: Columns of the enrichment table.
TABLE = ("number", "brand", "segment", "priority", "status", "confidence", "website", "domain", "title", *CONTACTS, "checked_pages", "candidates", "errors")
CANDIDATE = ("row_idx", "stage", "place", "url", "title", "score")


def canonical(c: str = "url") -> Column:
    return U.canonical_url(F.col(c), keep_query=True)


def scored_results(results: DataFrame, brands: DataFrame) -> DataFrame:
    """C12 of results with their brands: the acceptable ones, by (row_idx, engine_ord, query_ord, rank)."""
    url = U.normalize_url(U.unwrap_redirect(F.col("url")))
    rows = results.join(growing(brands.select("row_idx", "brand", "segment").dropDuplicates(["row_idx"])), "row_idx")
    rows = rows.select("row_idx", "brand", "segment", "engine_ord", "query_ord", "rank", url.alias("url"), "title", "snippet").where("url is not null")
    named = F.coalesce(F.nullif(trim_ws(F.col("title")), F.lit("")), U.registered_domain(F.col("url")), F.col("url"))
    rows = rows.withColumn("title", named)
    c = F.col
    return computed(rows, score=B.candidate_score(c("brand"), c("segment"), c("url"), c("title"), c("snippet"))).where("score > 0")


def first_results(results: DataFrame, brands: DataFrame) -> DataFrame:
    """The first acceptable result of a brand's first query, engines in their order."""
    good = scored_results(results.where("query_ord = 0"), brands)
    order = F.struct("engine_ord", "rank", "url")
    first = good.groupBy("row_idx").agg(F.min_by(F.struct("url", "title", F.greatest("score", 120 - F.col("rank")).cast("int").alias("score")), order).alias("r"))
    return first.select("row_idx", F.lit(0).alias("stage"), F.lit(0).alias("place"), "r.*")


def guessed(brands: DataFrame, facts: DataFrame) -> DataFrame:
    """The guesses with a page and a score, up to the first batch of guesses with one of at least ENOUGH."""
    urls = brand_addresses(brands.select(F.col("row_idx").alias("brand_id"), "brand").dropDuplicates(["brand_id"])).withColumnRenamed("brand_id", "row_idx")
    met = urls.select("row_idx", F.col("ord").alias("place"), U.canonical_url(F.col("url")).alias("key")).join(growing(facts.where("not rendered and readable and status < 400")), "key")
    host = U.host(F.col("final_url"))
    met = met.select("row_idx", "place", F.col("final_url").alias("url"), F.coalesce("title", host).alias("title"))
    one = met.groupBy("row_idx", canonical().alias("canonical")).agg(F.min(F.struct("place", "url", "title")).alias("m")).select("row_idx", "m.*")
    named = one.join(growing(brands.select("row_idx", "brand", "segment").dropDuplicates(["row_idx"])), "row_idx")
    c = F.col
    good = computed(named, score=B.direct_score(c("brand"), c("segment"), c("url"), c("title"))).where("score is not null")
    good = good.withColumn("source_ord", F.ceil(F.col("place") / BATCH)).withColumn("brand_id", F.col("row_idx"))
    return B.cascade(good.select("brand_id", "source_ord", "row_idx", F.lit(1).alias("stage"), "place", "url", "title", "score"), ENOUGH).select(*CANDIDATE)


def of_engine(results: DataFrame, brands: DataFrame, engine: int, seen: DataFrame) -> DataFrame:
    """All acceptable results of an engine whose address no earlier source has, the first place of each address."""
    good = scored_results(results.where(F.col("engine_ord") == engine), brands).withColumn("canonical", canonical())
    good = good.join(growing(seen.select("row_idx", canonical().alias("canonical")).distinct()), ["row_idx", "canonical"], "left_anti")
    order = F.struct("query_ord", "rank", "url")
    one = good.groupBy("row_idx", "canonical").agg(F.min(F.struct(order.alias("o"), "title", "score")).alias("g")).select("row_idx", F.col("g.o.url").alias("url"), "g.title", "g.score", F.col("g.o").alias("o"))
    place = F.row_number().over(Window.partitionBy("row_idx").orderBy("o"))
    return one.withColumn("place", place).select("row_idx", F.lit(2 + engine).alias("stage"), "place", "url", "title", "score")


def best_of(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row_idx").orderBy(F.desc("score"), F.length("url"), "stage", "place")
    return candidates.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def decided(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("score") >= ENOUGH).select("row_idx").distinct()


def brand_candidates(brands: DataFrame, results: DataFrame, facts: DataFrame, most: int = MOST) -> DataFrame:
    """row_idx, nth (1 is the best), url, title, score: the candidates of each brand from the sources it needed."""
    first = cut(first_results(results, brands))
    without = lambda rows, found: rows.join(growing(found.select("row_idx").distinct()), "row_idx", "left_anti")
    rest = without(brands, first)
    direct = cut(guessed(rest, facts))
    rest = without(rest, decided(direct))
    one = cut(of_engine(results.join(growing(rest.select("row_idx")), "row_idx", "left_semi"), rest, 0, direct))
    so_far = direct.unionByName(best_of(one, most).drop("nth"))
    last = without(rest, decided(so_far))
    two = of_engine(results.join(growing(last.select("row_idx")), "row_idx", "left_semi"), last, 1, direct.unionByName(one))
    every = first.unionByName(so_far).unionByName(best_of(two, most).drop("nth"))
    return best_of(every.select("row_idx", "stage", "place", "url", "title", F.col("score").cast("int").alias("score")), most)


def page_contacts(stored: DataFrame, phone: str = H.PHONE) -> DataFrame:
    """E18 - E21, E6, E8 of single pages: page_id and the first contacts of each kind."""
    base = stored.select("page_id", "final_url", "html", H.html_text(F.col("html")).alias("text"), H.anchor_array(F.col("html")).alias("a"))
    first = lambda c, kind: F.slice(unique_ci(c), 1, CONTACTS[kind]).alias(kind)
    return base.select(
        "page_id", H.extract_emails(F.col("text"), F.col("html"), CONTACTS["emails"]).alias("emails"), H.extract_phones(F.col("text"), phone, CONTACTS["phones"]).alias("phones"),
        first(H.extract_inns(F.col("text")), "inns"), first(H.legal_entities(F.col("text")), "legal_entities"), first(H.social_links(F.col("a"), F.col("final_url")), "social_links"),
    )


def contact_pages(best: DataFrame, stored: DataFrame, facts: DataFrame) -> DataFrame:
    """row_idx, nth, page_id, final_url: the best candidate's page and the first contact pages that answer; none
    where that page doesn't."""
    good = facts.where("not rendered and readable and status < 400").select("key", "page_id", "final_url")
    entries = best.select("row_idx", U.canonical_url(F.col("url")).alias("key")).join(growing(good), "key").select(F.col("row_idx").alias("site"), "page_id", "final_url")
    links = crawl_links(stored, contact_link_score, keep_query=True)
    candidates = ranked_candidates(entries, links, D.COMMON_CONTACT_PATHS, SITE_PAGES)
    order = Window.partitionBy("site").orderBy("rank")
    more = candidates.join(growing(good), "key").withColumn("nth", F.row_number().over(order)).where(F.col("nth") < SITE_PAGES)
    both = entries.select("site", F.lit(0).alias("nth"), "page_id", "final_url").unionByName(more.select("site", "nth", "page_id", "final_url"))
    return both.withColumnRenamed("site", "row_idx")


def enrich_brands(brands: DataFrame, results: DataFrame, stored: DataFrame, phone: str = H.PHONE) -> DataFrame:
    """A row for each brand: row_idx, number, brand, segment, priority, status, confidence, website, domain, title, the
    contacts, checked_pages, candidates (score, url), errors."""
    stored = responses(stored)
    facts = cut(response_facts(stored))
    candidates = cut(brand_candidates(brands, results, facts))
    best = candidates.where("nth = 1")
    pages = contact_pages(best, stored, facts).join(growing(page_contacts(stored, phone)), "page_id")
    gathered = pages.groupBy("row_idx").agg(F.array_sort(F.collect_list(F.struct("nth", "final_url", *CONTACTS))).alias("seen"))
    joined = lambda kind: F.slice(unique_ci(F.flatten(F.transform("seen", lambda x: x[kind]))), 1, CONTACTS[kind])
    found = gathered.select("row_idx", *[joined(k).alias(k) for k in CONTACTS], F.transform("seen", lambda x: x["final_url"]).alias("checked_pages"))
    ranked = candidates.groupBy("row_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "score", "url"))), lambda x: F.struct(x["score"], x["url"])).alias("candidates"))
    top = best.select("row_idx", F.col("url").alias("website"), U.registered_domain(F.col("url")).alias("domain"), "title", "score")
    out = brands.join(growing(top), "row_idx", "left").join(growing(found), "row_idx", "left").join(growing(ranked), "row_idx", "left")
    empty = F.array().cast("array<string>")
    lists = {k: F.coalesce(k, empty) for k in (*CONTACTS, "checked_pages")}
    return out.select(
        "row_idx", "number", "brand", F.nullif(F.col("segment"), F.lit("")).alias("segment"), "priority", B.enrich_status(F.col("score"), F.col("emails")).alias("status"),
        B.confidence(F.col("score"), F.col("emails"), F.col("phones"), F.col("inns")).alias("confidence"), "website", "domain", "title",
        *[v.alias(k) for k, v in lists.items()], F.coalesce("candidates", F.array().cast("array<struct<score:int,url:string>>")).alias("candidates"), empty.alias("errors"),
    )
