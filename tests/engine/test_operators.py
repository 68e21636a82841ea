"""Registry identities, repartition invariance, tables on disk, grids from files, streams."""

import os

import pytest
from pyspark.sql import functions as F

from pagelume.functions.cells import norm_inn
from pagelume.operators import outcomes as O
from pagelume.operators import pages as P
from pagelume.operators import registry as R
from pagelume.sources import grids as G
from pagelume.sources import tables as S
from pagelume.streaming import registry_stream as ST

BATCH = "file string, file_ord int, row_idx int, inn string, seller string, status string"
ROWS = [("a", 1, 1, "1.0", "A", "x"), ("a", 1, 2, "1", "A2", "y"), ("a", 1, 3, " ", "B", "x"), ("b", 2, 1, "1", "A3", "z"), ("b", 2, 2, "2", "C", "x"), ("b", 2, 3, None, "", "x")]


def registry(spark, rows=()):
    return spark.createDataFrame(list(rows), S.REGISTRY)


def test_upsert_and_metrics(spark):
    batch = spark.createDataFrame(ROWS, BATCH)
    for n in (1, 7, 31):
        out = {r.inn: r for r in R.upsert_registry(registry(spark), batch.repartition(n), "2024-01-01 00:00:00").collect()}
        assert set(out) == {"1", "2"} and out["1"].seller == "A" and out["1"].seen_count == 2 and out["1"].last_source == "b"
    m = {r.file: r for r in R.import_metrics(batch, registry(spark), norm_inn(F.col("inn"))).collect()}
    assert (m["a"].new, m["a"].known, m["a"].duplicate, m["a"].skipped) == (1, 0, 1, 1)
    assert (m["b"].new, m["b"].known, m["b"].duplicate, m["b"].skipped) == (1, 1, 0, 1)  # known from the file before
    assert all(r.with_key == r.new + r.known + r.duplicate and r.total == r.with_key + r.skipped for r in m.values())


def test_history_keeps_what_is_known(spark):
    old = spark.createDataFrame([("a", "A", 3, "f0", "f0", None, None, True, "Name", "9", "SUCCESS", None)], S.HISTORY)
    batch = spark.createDataFrame([(*r, "", None) for r in ROWS], BATCH + ", brand string, display_name string")
    out = {r.seller_key: r for r in R.upsert_history(old, batch, "2024-02-02 00:00:00").collect()}
    assert out["a"].seen_count == 4 and out["a"].display_name == "Name" and out["a"].skip and out["a"].status == "x" and out["a"].first_source == "f0" and out["a"].last_source == "a"
    assert set(out) == {"a", "a2", "a3", "b", "c"}


def test_merge_size(spark):
    p = spark.createDataFrame([("1", 1, "p"), ("1", 2, "q"), ("", 3, "r"), ("2", 4, "s")], "inn string, row_idx int, seller string")
    s = spark.createDataFrame([("2", 1, "t"), ("3", 2, "u"), ("3", 3, "v"), (None, 4, "w")], "inn string, row_idx int, seller string")
    out = {r.inn: r.seller for r in R.merge_registries(p, s, "inn", "row_idx").collect()}
    assert out == {"1": "p", "2": "s", "3": "u"}
    m = R.merge_metrics(p, s, "inn").first()
    assert m.merged_keys == len(out) == m.primary_keys + m.secondary_keys - m.overlap


def test_enrich_never_multiplies(spark):
    batch = spark.createDataFrame([(1, "5.0"), (2, None), (3, "6")], "row int, inn string")
    ext = spark.createDataFrame([("5", 2, "second"), ("ИНН 5", 1, "first"), ("7", 3, "x")], "inn string, row_idx int, name string")
    out = {r.row: r for r in R.enrich(batch, ext, "e_").collect()}
    assert len(out) == 3 and out[1].e_name == "first" and out[1].match_count == 2 and not out[2].match_found and out[3].match_count == 0


def site(**true):
    return {**{s: False for s in P.SIGNALS}, "domain": "d.ru", "hacked_terms": [], "marketplace_links": [], **true}


FITS = [
    (site(domain="ozon.ru", has_cart=True), "NOT_FIT"), (site(hacked_terms=["casino"], has_cart=True), "HACKED"), (site(has_cart=True, has_catalog=True, has_price=True), "FIT_NOW"), (site(has_cart=True, has_checkout=True), "FIT_NOW"),
    (site(has_cart=True), "FIT_LATER"), (site(request_only=True, has_catalog=True), "NOT_FIT"), (site(has_b2b_language=True, has_catalog=True, has_price=True, has_buy_button=True), "NOT_FIT"), (site(has_catalog=True, has_price=True, has_payment=True), "FIT_LATER"),
    (site(has_catalog=True, has_product_page=True, has_structured_product_data=True), "FIT_LATER"), (site(has_manufacturer_language=True, has_catalog=True, marketplace_links=["x"]), "FIT_LATER"), (site(), "NOT_FIT"),
]


def test_site_fit_branches(spark):
    schema = "i int, domain string, hacked_terms array<string>, marketplace_links array<string>, " + ", ".join(f"{s} boolean" for s in P.SIGNALS)
    rows = [(i, s["domain"], s["hacked_terms"], s["marketplace_links"], *[s[k] for k in P.SIGNALS]) for i, (s, _) in enumerate(FITS)]
    out = spark.createDataFrame(rows, schema).withColumn("ecom_score", P.ecom_score()).select("i", P.site_fit().alias("f")).orderBy("i").collect()
    assert [r.f.status for r in out] == [w for _, w in FITS] and len({r.f.reason for r in out}) == len(FITS)


def test_payload_lookup(spark):
    cards = O.parse_cards(spark.createDataFrame([('{"products": [{"id": 267843270, "supplierId": 159267, "supplier": "ONEENERGY"}]}',), ("broken",)], "card string"))
    legal = O.parse_legal(spark.createDataFrame([(159267, '{"supplierName": "ООО \\"ВАНЭНЕРДЖИ\\"", "inn": "7725305764", "ogrn": "1167746134324"}')], "supplier_id long, legal string"))
    r = O.legal_lookup(spark.createDataFrame([(6, 267843270)], "row_id int, article long"), cards, legal).first()
    assert (r.inn, r.ogrn, r.entity_type, r.parse_status) == ("7725305764", "1167746134324", "ООО", "SUCCESS")


def test_grids_from_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text('x,y\n Товар ,Артикул,Бренд,Продавец\n"a, b",12.0,Br,S1\nc,,Br,\n,,,\nd,13,Br,s1 \n', encoding="utf-8")
    grid = G.read_grid(spark, str(tmp_path))
    assert [(r.row_idx, len(r.cells)) for r in grid.orderBy("row_idx").collect()] == [(1, 2), (2, 4), (3, 4), (4, 4), (5, 4), (6, 4)]
    known = spark.createDataFrame([("zzz",)], "seller_key string")
    out = G.build_sample(grid, known).orderBy("row_idx").collect()
    assert [(r.row_idx, r.product, r.article, r.parse_status) for r in out] == [(3, "a, b", 12, "READY_FOR_RESEARCH"), (4, "c", None, "NO_NM_ID")]
    assert G.build_sample(grid, spark.createDataFrame([("s1",)], "seller_key string")).count() == 1
    with pytest.raises(ValueError, match="unknown sheets: nope"):
        G.select_sheets(grid, ["one", "nope"])
    os.makedirs(tmp_path / "r" / "q")
    for name in ("r/Batch.CSV", "r/q/batch.csv", "r/other.csv"):
        (tmp_path / name).write_text("a")
    assert [os.path.basename(r.path) for r in G.discover_batches(spark, str(tmp_path / "r"), "batch.csv").orderBy("file_ord").collect()] == ["Batch.CSV", "batch.csv"]


def test_quoted_line_ends_and_wide_rows(spark, tmp_path):
    wide = ",".join(str(i) for i in range(300))
    (tmp_path / "w.csv").write_text('a,"two\nlines, and ""quotes""",b\r\n' + wide + '\n"",x,\n"last\n\n one"\n', encoding="utf-8")
    rows = G.read_grid(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == [1, 2, 3, 4] and len(rows[1].cells) == 300 and rows[1].cells[299] == "299"
    assert rows[0].cells == ["a", 'two\nlines, and "quotes"', "b"] and rows[2].cells == [None, "x", None] and rows[3].cells == ["last\n\n one"]


def test_website_tables(spark):
    row = lambda i, *c: ("f", "s", 1, i, list(c))
    schema = "source_file string, sheet string, sheet_idx int, row_idx int, cells array<string>"
    one = spark.createDataFrame([row(1, "Наименование", "Электронная почта", "Ссылка на сайт"), row(2, "Only email", "buyer@example.ru", None), row(3, "Only site", None, "http://example.ru"), row(4, "Both", "sales@example.ru", "example.com/catalog")], schema)
    assert [(r.row_idx, r.url) for r in G.extract_website_rows(one).orderBy("row_idx").collect()] == [(3, "http://example.ru"), (4, "example.com/catalog")]
    two = spark.createDataFrame([row(1, "Наименование", "Электронная почта", "Комментарий"), row(2, "Only email", "buyer@example.ru", None), row(3, "Site in note", None, "example.ru")], schema)
    assert [(r.row_idx, r.url) for r in G.extract_website_rows(two).collect()] == [(3, "example.ru")]


def test_work_queue(spark):
    names = list(G.ICP_HEADERS)
    values = {"brand": ["Brand One", "Brand Two"], "segment": ["Косметика", "Одежда"], "validation": [None, "?"], "priority": ["P1", "P2"], "status": ["Не начато"] * 2}
    df = spark.createDataFrame([(i + 1, *[values[c][i] if c in values else None for c in names]) for i in range(2)], "row_idx int, " + ", ".join(f"{c} string" for c in names))
    out = G.build_queue(df).orderBy("row_idx").collect()
    assert [r.next_action for r in out] == ["Искать ИНН/юрлицо", "Нужна валидация"] and out[0].missing == ", ".join(G.FILL_TARGETS)
    s = G.icp_summary(df).first()
    assert (s.total, s.validation, s.with_inn) == (2, 1, 0)


def test_tables_on_disk(spark, tmp_path):
    path = str(tmp_path / "t")
    assert S.load_registry(spark, path).count() == 0
    first = registry(spark, [("1", "A", "x", 1, None, None, "a")])
    S.save_registry(first, spark.createDataFrame([("a", 1)], "file string, new int"), path)
    again = R.upsert_registry(S.load_registry(spark, path), spark.createDataFrame(ROWS, BATCH), "2024-01-01 00:00:00")
    S.save_registry(again, spark.createDataFrame([("b", 1)], "file string, new int"), path)  # reads what it replaces
    assert {(r.inn, r.seen_count) for r in S.load_registry(spark, path).collect()} == {("1", 3), ("2", 1)}
    assert spark.read.parquet(path + "/imports").count() == 2 and sorted(os.listdir(path)) == ["imports", "registry"]
    S.write_json(first, str(tmp_path / "j"))
    S.write_sample(first, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "j")).first().inn == "1" and spark.read.parquet(str(tmp_path / "s")).columns == S.SAMPLE_COLUMNS
    assert S.resolve_history_source({"z": first, "inn_registry": registry(spark), "y": spark.range(1)}) == "z"


def test_stream_equals_batch(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    batch = spark.createDataFrame(ROWS, BATCH)
    at = "2024-01-01 00:00:00"
    for name in ("a", "b"):
        batch.where(F.col("file") == name).coalesce(1).write.mode("append").parquet(source)
        ST.stream_registry(spark, source, target, str(tmp_path / "cp"), BATCH, at).awaitTermination(120)
    want = {tuple(r) for r in R.upsert_registry(registry(spark), batch, at).collect()}
    named = batch.withColumn("display_name", F.lit(None).cast("string")).withColumn("brand", F.lit(None).cast("string"))
    views = {tuple(r) for r in R.upsert_history(spark.createDataFrame([], S.HISTORY), named, at).collect()}
    assert [{tuple(r) for r in x.collect()} for x in ST.load_state(spark, target)[:2]] == [want, views]
    ST.apply_files(spark, batch, target, at)  # a repeated delivery
    assert [{tuple(r) for r in x.collect()} for x in ST.load_state(spark, target)[:2]] == [want, views]
    assert ST.load_state(spark, target)[2].count() == 2
    pages = str(tmp_path / "pages")
    rows = spark.createDataFrame([(1, "https://a.ru/catalog/1", "<body>купить в корзину</body>"), (2, "https://b.ru/", "<body>x</body>")], "page_id long, url string, html string")
    rows.write.parquet(pages)
    q = ST.stream_signals(spark.readStream.schema(rows.schema).parquet(pages)).writeStream.format("parquet").option("path", str(tmp_path / "sig")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "sig")).collect())) == sorted(map(str, P.page_signals(rows).collect()))


def test_an_import_that_stops_anywhere_counts_once(spark, tmp_path, monkeypatch):
    target, at = str(tmp_path / "out"), "2024-01-01 00:00:00"
    batch = spark.createDataFrame(ROWS, BATCH)
    first, second = batch.where("file = 'a'"), batch.where("file = 'b'")
    ST.apply_files(spark, first, target, at)
    before = {tuple(r) for r in ST.load_state(spark, target)[0].collect()}

    def stops(*_):
        raise KeyboardInterrupt

    for name in ("upsert_registry", "upsert_history", "import_metrics", "commit_version"):
        with monkeypatch.context() as m:
            m.setattr(ST, name, stops)
            with pytest.raises(KeyboardInterrupt):
                ST.apply_files(spark, second, target, at)
        assert {tuple(r) for r in ST.load_state(spark, target)[0].collect()} == before
    for _ in range(2):  # delivered again, and once more after it was completed
        ST.apply_files(spark, second, target, at)
        got, views, log = ST.load_state(spark, target)
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in R.upsert_registry(registry(spark), batch, at).collect()}
        assert log.count() == 2 and views.count() > 0
    assert not [x for x in os.listdir(target) if x.startswith("staged") and os.path.exists(f"{target}/{x}/registry")]


def test_a_replacement_that_stops_is_undone(spark, tmp_path):
    path = str(tmp_path / "t")
    S.replace_table(spark.range(5), path)
    os.rename(path, f"{path}.old-1")  # between the two renames
    assert S.load_table(spark, path, "id long").count() == 5 and os.path.exists(path)
    os.rename(path, f"{path}.old-1")
    S.replace_table(spark.range(7), path)
    assert S.load_table(spark, path, "id long").count() == 7 and os.listdir(tmp_path) == ["t"]


def test_brand_matches_are_counted_without_pairs(spark, tmp_path):
    """100,000 pages of one host: 10 billion pairs of brand and page, which were made one by one."""
    import time

    from pagelume.operators import brands as B
    from pagelume.plans.brand_queries import brand_matches

    names = [(0, "don't rocs & lab", "x"), (1, "ROCS", "x"), (2, "", "x"), (3, None, "x"), (4, "Kosmetika one", "y"), (5, "rocs", "z"), (5, "rocs", "z")]
    urls = ["https://rocs.ru/a", "https://www.rocs.ru/", "https://rocsshop.com/", "http://cosmetikaone.com/x", "https://kosmetikaone.ru", "https://other.org/", "bad", None]
    brands, pages = spark.createDataFrame(names, "brand_id int, brand string, segment string"), spark.createDataFrame([(i, u, "<title>t</title>") for i, u in enumerate(urls)], "page_id int, url string, html string")
    pairs = {r.brand_id: r["count"] for r in B.match_brands(brands, pages).groupBy("brand_id").count().collect()}
    assert pairs and {r.brand_id: r.n for r in B.count_matches(brands, pages).collect()} == pairs

    spark.range(100_000).select(F.col("id").alias("page_id"), F.lit("https://www.shop.com/").alias("url"), F.lit("").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    began = time.time()
    assert [tuple(r) for r in brand_matches(spark, str(tmp_path)).groupBy("n").count().collect()] == [(100_000, 100_000)]
    assert time.time() - began < 90
