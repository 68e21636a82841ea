"""Guessed addresses of brands on known cases, and the stages of the enrichment."""

from pyspark.sql import functions as F

from pagelume.operators import domains as M
from pagelume.operators import enrichment as E

BRANDS = ["Art&Fact", "Aravia Professional", "Letique Cosmetics", "Don't Touch My Skin", "Estilab", "Краснополянская косметика", "Мастерская Олеси Мустаевой", "Trives", "Venoteks", "Черный Жемчуг", "Юникосметик", "Чистая Линия", "", None, "& + '", "x" * 300]
URLS = [
    ("Art&Fact", "https://artfact.ru/"), ("Art&Fact", "https://art-fact-products.com/"), ("Краснополянская косметика", "https://kpcosm.ru/"), ("Мастерская Олеси Мустаевой", "https://master-om.com/"),
    ("Trives", "https://trives-spb.ru/"), ("Venoteks", "https://venoshop.ru/"), ("Черный Жемчуг", "https://theblackpearl.ru/"), ("Юникосметик", "https://estel.beauty/"), ("Чистая Линия", "https://chistayalinia.ru/"),
]
NAMES = [("Aravia Professional", "aravia"), ("Letique Cosmetics", "letique"), ("Don't Touch My Skin", "dtmskin"), ("Don't Touch My Skin", "d-t-m-skin"), ("Estilab", "esti-lab"), ("Don t Touch My Skin", "dtmskin")]


def test_guesses(spark):
    brands = [*BRANDS, "Don t Touch My Skin"]
    df = spark.createDataFrame(list(enumerate(brands)), "brand_id int, brand string").repartition(3)
    urls, names = {}, {}
    for r in M.brand_addresses(df).orderBy("brand_id", "ord").collect():
        urls.setdefault(brands[r.brand_id], []).append(r.url)
    for r in M.brand_names(df).collect():
        names[brands[r.brand_id]] = r.names
    assert all(u in urls[b] for b, u in URLS) and all(n in names[b] for b, n in NAMES)
    assert all(len(v) <= M.ADDRESSES and len(set(v)) == len(v) for v in urls.values()) and "" not in urls and None not in urls
    assert urls["Краснополянская косметика"][0] == "https://kpcosm.ru/" and urls["Мастерская Олеси Мустаевой"][:2] == ["https://master-om.com/", "https://master-om.ru/"]
    assert urls["Trives"][:2] == ["https://trives-spb.ru/", "https://trives-shop.ru/"]


PAGE = "<html><head><title>{0}</title></head><body>{1}</body></html>"


def test_later_sources_only_where_needed(spark):
    brands = spark.createDataFrame([(1, "1", "Acme Paint", "x", "P1"), (2, "2", "Bolt Works", "", "P1"), (3, "3", "Cork House", "x", None), (4, "4", "Dune Lamp", "x", "P2"), (5, None, None, None, None)], "row_idx int, number string, brand string, segment string, priority string")
    results = [
        (1, 0, 0, 0, "https://unrelated.de/", "nothing", None), (1, 1, 0, 3, "https://acmepaint.ru/", "Acme Paint official", ""), (1, 0, 0, 5, "/url?q=https%3A%2F%2Facme-paint.ru%2Fru&sa=U", "Acme Paint", "shop"),
        (3, 0, 1, 0, "https://corkhouse.ru/", "Cork House", "contact"), (3, 1, 1, 0, "https://corkhouse.org/", "Cork House", None), (4, 0, 1, 0, "https://lamps.de/dune/a/b", "Dune", None), (4, 1, 1, 1, "https://dunelamp.ru/", "Dune Lamp", None),
    ]
    results = spark.createDataFrame(results, "row_idx int, engine_ord int, query_ord int, rank int, url string, title string, snippet string")
    pages = [
        (1, "https://acme-paint.ru/ru", PAGE.format("t", "write sale@acme-paint.ru"), 200), (2, "https://boltworks.ru/", PAGE.format("Bolt Works", '<a href="/contact?x=1">contact</a> ООО "Болт", ИНН 1234567890'), 200),
        (3, "https://boltworks.ru/contacts/", PAGE.format("c", "8 (800) 123-45-67 info@boltworks.ru info@boltworks.ru <a href='https://vk.com/bolt'>vk</a>"), 200), (4, "https://boltworks.com/", PAGE.format("Bolt Works", ""), 200), (5, "https://boltworks.ru/about", PAGE.format("", "a@b.ru"), 404),
    ]
    pages = spark.createDataFrame(pages, "page_id int, url string, html string, status int")
    out = {r.row_idx: r for r in E.enrich_brands(brands, results, pages).collect()}
    assert len(out) == 5
    a, b, c, d, e = (out[i] for i in range(1, 6))
    assert (a.website, a.status, a.emails, a.checked_pages, [x.url for x in a.candidates]) == ("https://acme-paint.ru/ru", "FOUND_CONTACTS", ["sale@acme-paint.ru"], ["https://acme-paint.ru/ru"], ["https://acme-paint.ru/ru"])
    assert a.candidates[0].score == 115 and a.confidence == 82
    assert (b.website, b.title, b.emails, b.phones, b.inns, b.social_links) == ("https://boltworks.ru/", "Bolt Works", ["info@boltworks.ru"], ["+7 800 123-45-67"], ["1234567890"], ["https://vk.com/bolt"])
    assert b.legal_entities == ['ООО "Болт"'] and b.checked_pages == ["https://boltworks.ru/", "https://boltworks.ru/contacts/"] and b.segment is None and b.confidence == 100
    assert [x.url for x in b.candidates] == ["https://boltworks.ru/"]  # the first guess was enough
    assert [x.url for x in c.candidates] == ["https://corkhouse.ru/"] and c.status == "FOUND_SITE_CHECK_CONTACTS" and c.checked_pages == []
    assert d.website == "https://dunelamp.ru/" and len(d.candidates) == 2
    assert (e.status, e.confidence, e.website, e.candidates) == ("NOT_FOUND", 0, None, [])
    assert E.enrich_brands(brands.limit(0), results, pages).count() == 0
    flat = E.B.flatten_enrichment(E.enrich_brands(brands, results, pages)).where(F.col("row_idx") == 2).first()
    assert flat.candidates.endswith(": https://boltworks.ru/") and len(flat) == 18


def test_growing_tables_are_not_broadcast(spark):
    """Brands, results and pages grow, and no side of a join of theirs goes whole through the driver, however small it looks."""
    from pagelume.operators import audit as A

    brands = spark.createDataFrame([(1, "Trives", "x")], "row_idx int, brand string, segment string")
    results = spark.createDataFrame([(1, 0, 0, 1, "https://trives.ru/", "Trives", "s")], "row_idx int, engine_ord int, query_ord int, rank int, url string, title string, snippet string")
    stored = A.responses(spark.createDataFrame([(1, "https://trives.ru/", "<title>Trives</title>")], "page_id int, url string, html string"))
    facts = A.response_facts(stored)
    entries = A.entry_pages(brands.select(F.lit("https://trives.ru/").alias("site")), facts)
    best = results.select("row_idx", "url")
    for df in (E.scored_results(results, brands), E.guessed(brands, facts), E.of_engine(results, brands, 0, best), E.contact_pages(best, stored, facts), entries, A.site_pages(entries, stored, facts)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan, plan[:2000]
