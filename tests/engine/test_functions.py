"""Scalar functions and brand rules on literals."""

import pytest
from pyspark.sql import functions as F

from pagelume.functions import cells as C
from pagelume.functions import html as H
from pagelume.functions import urls as U
from pagelume.operators import brands as B


def values(spark, make, rows, schema="v string"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i long, {schema}")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_cells(spark):
    assert values(spark, C.norm_inn, ["7725305764.0", " 00123 ", "ИНН 12-3", "", None, "abc"]) == ["7725305764", "00123", "123", None, None, None]
    assert values(spark, C.norm_article, ["12", "12.0", "12.5", "—", "", None, "+7", "99999999999999999999"]) == [12, 12, None, None, None, None, 7, None]
    assert values(spark, C.to_bool, ["Да", "TRUE", "0", "", None, "1"]) == [True, True, False, False, False, True]
    assert values(spark, C.norm_key, ["  ABC\u00a0", None, "Ёж"]) == ["abc", "", "ёж"]
    assert values(spark, C.norm_phone, ["8 (800) 123-45-67", "+7 (800) 123-45-67", " 123 "]) == ["+7 800 123-45-67", "+7 800 123-45-67", "123"]
    assert values(spark, C.norm_lines, ["a  b\r\n\r\n c ", "", None]) == ["a b\nc", "", None]
    assert values(spark, lambda c: C.unique_ci(F.split(c, ",")), ["A,a,b, B ,,c"]) == [["A", "b", "c"]]
    assert values(spark, lambda c: C.norm_headers(F.split(c, ",")), ["x, ,y"]) == [["x", "column_2", "y"]]
    assert values(spark, C.translit, ["щука ёжъ", "шея"]) == ["schuka ezh", "sheya"]
    assert values(spark, C.category_of, ["/a/Результаты/x/y/f.xlsx", "C:\\b\\f.xlsx", "f.xlsx"]) == ["x / y", "b", ""]
    assert values(spark, C.search_url, ["a b~*"]) == ["https://search.example/?q=a+b~%2A"]
    assert values(spark, C.clean_entity, [' ООО  "X" ;']) == ['ООО "X"']
    with pytest.raises(ValueError, match="missing columns: b, c"):
        C.require_columns(spark.range(1).withColumnRenamed("id", "a"), ["c", "a", "b"])


def test_urls(spark):
    assert values(spark, U.looks_like_website, ["buyer@example.ru", "info@yoot.pro", "http://example.ru", "www.example.ru", "example.ru/catalog", "a b.ru", "example..ru", "1.2", None]) == [False, False, True, True, True, False, False, False, False]
    assert values(spark, U.normalize_url, ["example.ru", " http://x.y ", "", "https://"]) == ["https://example.ru", "http://x.y", None, None]
    assert values(spark, U.canonical_url, ["HTTPS://Ex.RU/a/?q=1#f"]) == ["https://ex.ru/a"]
    assert values(spark, lambda c: U.canonical_url(c, True), ["HTTPS://Ex.RU/a/?q=1#f"]) == ["https://ex.ru/a?q=1"]
    assert values(spark, U.registered_domain, ["https://a.b.example.co.uk:8/x", "www.ex.ru", "localhost", ""]) == ["example.co.uk", "ex.ru", "localhost", None]
    assert values(spark, lambda c: U.resolve_href(F.lit("https://s.ru/a/b.html?x"), c), ["c", "../d?q=1", "/e#f", "//t.ru/g", "mailto:x", "#a", "f.pdf", "http://u.ru", ""]) == ["https://s.ru/a/c", "https://s.ru/d", "https://s.ru/e", "https://t.ru/g", None, None, None, "http://u.ru/", None]
    assert values(spark, U.unwrap_redirect, ["/url?q=https%3A%2F%2Fkpcosm.ru%2F&sa=U", "//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.ru", "https://www.google.com/search?q=x", "https://a.ru/"]) == ["https://kpcosm.ru/", "https://a.ru", None, "https://a.ru/"]
    assert values(spark, U.entry_variants, ["http://www.a.ru/x#f"]) == [["http://www.a.ru/x", "http://a.ru/x", "https://www.a.ru/x", "https://a.ru/x"]]
    assert values(spark, U.zone_score, ["a.ru", "b.fr", "c.com"]) == [8, -10, 0]
    assert values(spark, lambda c: U.is_seller_url(c), ["https://www.wildberries.ru/seller/12", "/seller/name", "https://other.ru/seller/1"]) == [True, False, False]


def test_extraction(spark):
    text = "ООО ВАНЭНЕРДЖИ ОГРН: 1167746134324 ИНН: 7725305764 КПП: 1"
    assert values(spark, H.extract_inn, [text, "БИНИНН 7725305764", "инн 123456789012", "ИНН 12345678901"]) == ["7725305764", None, "123456789012", None]
    assert values(spark, H.extract_ogrn, [text]) == ["1167746134324"]
    assert values(spark, H.extract_ogrnip, ["ОГРНИП: 1217700328988", "ОГРНИП: 121770032898812"]) == [None, "121770032898812"]
    assert values(spark, H.extract_inns, ["ИНН 123456789012, инн: 1234567890 и 99"]) == [["123456789012", "1234567890"]]
    assert values(spark, H.entity_type, ["Общество с ограниченной ответственностью", "индивидуальный предприниматель", "x ИП y", "ИПО", ""]) == ["ООО", "ИП", "ИП", None, None]
    assert values(spark, H.seller_country, ["УНП 1 БИН 2", "БИН", "кабинет"]) == ["БЕЛОРУСЬ", "КАЗАХСТАН", None]
    assert values(spark, H.is_plausible_name, ["Отели", "Корзина", "12,5", "a", "Ничего не найдено", None]) == [True, False, False, False, False, False]
    page = '<html><title>T &amp; x</title><body>hi<script>var t="</p>";</script> <!-- no --><p>there</p><a href="/A">One <b>two</b></a></body>'
    assert values(spark, H.html_text, [page]) == ["hi there One two"]
    assert values(spark, H.html_title, [page, "<p>"]) == ["T & x", None]
    assert [(a.href, a.text) for a in values(spark, H.anchor_array, [page])[0]] == [("/A", "One two")]
    assert values(spark, lambda c: H.present_terms(c, ("sex", "casino")), ["Casino!", "Essex", "sex casino"]) == [["casino"], [], ["sex", "casino"]]


def test_contact_page(spark):
    html = '<body><a href="mailto:test@realbrand.ru">test@realbrand.ru</a> email@realbrand.ru a@ingest.sentry.io hello@realbrand.ru +7 (800) 123-45-67 ИНН 1234567890 <a href="https://t.me/example">t</a></body>'
    df = spark.createDataFrame([(1, "https://realbrand.ru/", html)], "page_id long, url string, html string")
    from pagelume.operators.pages import site_contacts

    r = site_contacts(df).first()
    assert (r.emails, r.phones, r.inns, r.social_links) == (["hello@realbrand.ru"], ["+7 800 123-45-67"], ["1234567890"], ["https://t.me/example"])


SCORES = [
    ("Краснополянская косметика", "косметика", "https://kpcosm.ru/", "Краснополянская косметика официальный сайт", 68),
    ("Doctor Wax Russia", "косметика", "https://doctor.ru/", "x", -100),
    ("Магнит / магнитные доски Iqaktiv", "товары", "https://magnit.ru/", "магнит", -100),
    ("Magnit", "Бытовая техника", "https://magnit.com/ru/", "Magnit", -100),
    ("Art&Fact", "косметика", "https://artandfact.ru/", "Art and Fact game studio", 15),
]


def test_candidate_scores(spark):
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(SCORES)], "i long, brand string, segment string, url string, title string, want int")
    got = df.select("i", B.candidate_score(F.col("brand"), F.col("segment"), F.col("url"), F.col("title"), F.lit(None).cast("string")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [s[-1] for s in SCORES]


KEYS = {
    "Art&Fact": ["artfact", "art-fact-products"], "Aravia Professional": ["aravia"], "Letique Cosmetics": ["letique"], "Don't Touch My Skin": ["dtmskin"], "Estilab": ["esti-lab"], "Краснополянская косметика": ["kpcosm"],
    "Мастерская Олеси Мустаевой": ["master-om"], "Trives": ["trives-spb.ru"], "Venoteks": ["venoshop"], "Черный Жемчуг": ["theblackpearl.ru"], "Юникосметик": ["estel.beauty"], "Чистая Линия": ["chistayalinia.ru"],
}


def test_brand_keys(spark):
    names = [*KEYS, "", "!!!", None]
    rows = B.brand_keys(spark.createDataFrame(list(enumerate(names)), "brand_id int, brand string")).collect()
    got = {i: [r.key for r in rows if r.brand_id == i] for i in range(len(names))}
    for i, name in enumerate(KEYS):
        assert set(KEYS[name]) <= set(got[i]), (name, got[i][:20])
        assert len(got[i]) == len(set(got[i]))
    assert not any(got[i] for i in range(len(KEYS), len(names)))


def test_redirected_first_result(spark):
    rows = [(1, "https://doctor.ru/", -100, 0, 1), (1, "https://doctorwax.ru/", 60, 0, 2), (1, "https://late.ru/", 99, 1, 1)]
    r = B.first_result(spark.createDataFrame(rows, "brand_id long, url string, score int, engine_ord int, rank int")).first()
    assert r.url == "https://doctorwax.ru/" and r.score == 118
