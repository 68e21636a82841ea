"""Queries of grids, listings, payloads, previews, slices and the work queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outcomes as O
from ..sources import grids as G
from ..sources import tables as S
from .bindings import BRANDS_SQL, GRID_SQL, KNOWN_SQL, LISTING_SQL, batch, brand_rows, grid, known_sellers, listing, load

REQUIRED = ("Name", "Article", "Website")


def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2"""
    return G.detect_header(grid(spark, sf_dir), REQUIRED).select("sheet", "header_row", F.array_join("headers", "|").alias("headers"))


HEADER_ROWS = f"WITH {GRID_SQL} SELECT DISTINCT sheet, header_row, 'Name|Article|Website|INN' AS headers FROM g WHERE valid"


def projected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named cells of full rows."""
    g = G.drop_empty(grid(spark, sf_dir))
    p = G.project_grid(g, G.detect_header(g, REQUIRED), {"name": "Name", "article": "Article", "site": "Website", "missing": "Nowhere"})
    return p.select("sheet", "row_idx", F.trim("name").alias("name"), F.col("article").cast("bigint").alias("article"), "site", "missing")


PROJECTED = f"""
WITH {GRID_SQL} SELECT sheet, row_idx, c_name AS name, c_custkey AS article, CASE c_custkey % 3 WHEN 0 THEN 'www.c' || c_custkey || '.example.com/a' WHEN 1 THEN 'c' || c_custkey || '@example.com' END AS site, NULL::VARCHAR AS missing FROM g WHERE valid AND NOT blank
"""


def sheet_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4"""
    p = G.profile_sheets(grid(spark, sf_dir), REQUIRED, ("web",))
    return p.select("sheet", "status", "reason", "header_row", "rows_scanned", "n_columns", "data_rows", "has_url_header", "key_field")


SHEET_PROFILES = f"""
WITH {GRID_SQL} SELECT sheet, CASE WHEN bool_and(valid) THEN 'VALID' ELSE 'SKIPPED' END AS status, CASE WHEN NOT bool_and(valid) THEN 'no header row' END AS reason, CASE WHEN bool_and(valid) THEN min(header_row) END AS header_row,
  count(*) + 1 AS rows_scanned, 4 AS n_columns, CASE WHEN bool_and(valid) THEN count(*) FILTER (NOT blank) ELSE 0 END AS data_rows, bool_and(valid) AS has_url_header, CASE WHEN bool_and(valid) THEN 'Website' END AS key_field FROM g GROUP BY sheet
"""


def workbook_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5"""
    return G.profile_workbook(G.profile_sheets(grid(spark, sf_dir), REQUIRED)).select("sheets", "valid_sheets", "skipped_sheets", "first_sheet", "header_row")


WORKBOOK = f"WITH {GRID_SQL}, s AS (SELECT sheet, min(sheet_idx) AS i, bool_and(valid) AS v, min(header_row) AS h FROM g GROUP BY sheet) SELECT count(*) AS sheets, count(*) FILTER (v) AS valid_sheets, count(*) FILTER (NOT v) AS skipped_sheets, arg_min(sheet, i) FILTER (v) AS first_sheet, arg_min(h, i) FILTER (v) AS header_row FROM s"


def selected_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five full rows of two sheets."""
    g = G.select_sheets(G.drop_empty(grid(spark, sf_dir)), ["MACHINERY", "HOUSEHOLD"])
    return G.preview(g, 5, ["sheet"]).select("sheet", "row_idx", F.element_at("cells", 2).alias("second"))


PREVIEW = f"""
WITH {GRID_SQL}, r AS (SELECT sheet, row_idx, c_custkey::VARCHAR AS second FROM g WHERE NOT blank UNION ALL SELECT DISTINCT sheet, header_row, 'Article' FROM g)
SELECT * FROM r WHERE sheet IN ('MACHINERY', 'HOUSEHOLD') QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY row_idx) <= 5
"""


def sliced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8"""
    return G.slice_rows(batch(spark, sf_dir), 100, 250).select("row_idx", "file", "status")


SLICED = "SELECT event_id AS row_idx, strftime(ts, '%Y-%m-%d') AS file, CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'ROW_ERROR' ELSE 'NEEDS_REVIEW' END AS status FROM events WHERE event_id BETWEEN 100 AND 349"


def website_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that look like a website, in sheets with and without a website column."""
    g = grid(spark, sf_dir)
    return G.extract_website_rows(g, "Website", "site").select("sheet", "row_idx", "url")


WEBSITE_ROWS = f"WITH {GRID_SQL} SELECT sheet, row_idx, 'www.c' || c_custkey || '.example.com/a' AS url FROM g WHERE NOT blank AND c_custkey % 3 = 0"


def website_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14"""
    g = grid(spark, sf_dir)
    return G.website_summary(g).select("sheet", "total_rows", "with_website")


WEBSITE_COUNTS = f"WITH {GRID_SQL} SELECT sheet, count(*) FILTER (NOT blank) + (sheet = 'MACHINERY')::INT AS total_rows, count(*) FILTER (NOT blank AND c_custkey % 3 = 0) AS with_website FROM g GROUP BY sheet"


def external_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S16, S17"""
    return G.read_external(grid(spark, sf_dir)).select("inn", "row_idx", "sheet", "header")


EXTERNAL = f"""
WITH {GRID_SQL}, f AS (SELECT arg_min(sheet, sheet_idx) AS s FROM g WHERE valid AND header_row = 1)
SELECT lpad((c_custkey % 500)::VARCHAR, 10, '0') AS inn, row_idx, sheet, 'INN' AS header FROM g, f WHERE sheet = f.s AND NOT blank
"""


def merged_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a customer segment."""
    g = grid(spark, sf_dir).withColumn("source_file", F.concat(F.lit("/in/"), F.when(F.col("sheet") == "BUILDING", "~$").otherwise(""), F.col("sheet"))).withColumn("sheet_idx", F.lit(1))
    return G.merge_files(g).groupBy("tab", "source_file").agg(F.count(F.lit(1)).alias("n"))


MERGED_TABS = f"WITH {GRID_SQL} SELECT row_number() OVER (ORDER BY lower(sheet)) AS tab, '/in/' || sheet AS source_file, count(*) + 1 AS n FROM g WHERE sheet <> 'BUILDING' GROUP BY sheet"


def listing_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of a listing without known sellers."""
    rows = G.sample_of(listing(spark, sf_dir).withColumn("row_idx", F.col("row_idx") * 100_000 + F.crc32(F.concat_ws("|", "product", "brand", "article", "l_quantity", "l_extendedprice")) % 100_000), known_sellers(spark, sf_dir)[0], 0)
    return rows.where("seller <> ''").groupBy("seller", "parse_status").agg(F.count(F.lit(1)).alias("n")).select("seller", F.col("n"))


LISTING_SAMPLE = f"WITH {LISTING_SQL}, {KNOWN_SQL} SELECT DISTINCT seller, 1 AS n FROM l WHERE seller <> '' AND lower(seller) NOT IN (SELECT seller_key FROM k WHERE source = 'registry')"


def rows_by_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1"""
    return G.count_by_sheet(listing(spark, sf_dir))


ROWS_BY_SHEET = f"WITH {LISTING_SQL} SELECT sheet, count(*) AS n FROM l GROUP BY sheet"


def batch_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K3: alias columns, and the union of rows with other columns."""
    b = S.to_batch_schema(batch(spark, sf_dir).select("row_idx", "seller", F.col("status").alias("parse_status")))
    extra = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("row_idx"), F.col("n_name").alias("note"))
    return O.union_all([b, extra])


BATCH_COLUMNS = """
WITH b AS (SELECT event_id AS row_idx, CASE WHEN event_type = 'view' THEN '' ELSE ' Seller ' || (user_id % 97) END AS seller, CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'ROW_ERROR' ELSE 'NEEDS_REVIEW' END AS parse_status FROM events)
SELECT row_idx, seller, parse_status, seller AS seller_name, row_idx AS row_number, parse_status AS status, NULL::VARCHAR AS note FROM b
UNION ALL SELECT n_nationkey, NULL, NULL, NULL, NULL, NULL, n_name FROM nation
"""


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: one document a row."""
    return load(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name", F.when(F.col("n_nationkey") > 5, F.col("n_regionkey")).alias("r")), {"ignoreNullFields": "false"}).alias("doc"))


JSON_ROWS = """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","r":' || CASE WHEN n_nationkey > 5 THEN n_regionkey::VARCHAR ELSE 'null' END || '}' AS doc FROM nation"""


def legal_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing rows, product cards and legal payloads in JSON."""
    p, s = load(spark, sf_dir, "part"), load(spark, sf_dir, "supplier")
    n = s.agg(F.count(F.lit(1)).alias("n"))
    cards = p.join(F.broadcast(n)).select(F.to_json(F.struct(F.array(F.struct(F.col("p_partkey").alias("id"), (F.col("p_partkey") % F.col("n")).alias("supplierId"), F.lit("ООО Имя").alias("supplier"))).alias("products"))).alias("card"))
    legal = s.where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("supplier_id"), F.to_json(F.struct(F.lit("").alias("supplierName"), F.concat(F.lit("ООО "), F.col("s_name")).alias("name"), F.when(F.col("s_suppkey") % 3 == 1, F.lpad(F.col("s_suppkey").cast("string"), 10, "5")).alias("inn"))).alias("legal"))
    rows = p.select(F.col("p_partkey").alias("row_id"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_partkey")).alias("article"))
    out = O.legal_lookup(rows, O.parse_cards(cards), O.parse_legal(legal))
    return out.select("row_id", "supplier_id", "inn", "ogrn", "display_name", "entity_type", "has_payload", "parse_status")


LEGAL_LOOKUP = """
WITH c AS (SELECT p_partkey AS row_id, p_partkey % (SELECT count(*) FROM supplier) AS supplier_id FROM part WHERE p_partkey % 5 > 0)
SELECT row_id, supplier_id, CASE WHEN supplier_id % 3 = 1 THEN lpad(supplier_id::VARCHAR, 10, '5') END AS inn, NULL::VARCHAR AS ogrn, CASE WHEN supplier_id % 3 > 0 THEN 'ООО ' || s_name ELSE 'ООО Имя' END AS display_name, CASE WHEN supplier_id % 3 > 0 THEN 'ООО' END AS entity_type,
  supplier_id % 3 > 0 AS has_payload, CASE supplier_id % 3 WHEN 1 THEN 'SUCCESS' WHEN 2 THEN 'NEEDS_REVIEW' ELSE 'Нет реквизитов на странице' END AS parse_status FROM c JOIN supplier ON s_suppkey = supplier_id
"""


def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 - C9, K6, N20"""
    return G.build_queue(brand_rows(spark, sf_dir)).select("row_idx", "next_action", "missing", "query", "search_1")


WORK_QUEUE = f"""
WITH {BRANDS_SQL} SELECT row_idx, CASE WHEN excluded IS NOT NULL THEN 'Исключить' WHEN validation IS NOT NULL THEN 'Нужна валидация' WHEN inn IS NULL OR legal IS NULL THEN 'Искать ИНН/юрлицо' WHEN site IS NULL THEN 'Искать сайт' WHEN email IS NULL THEN 'Искать контакты' ELSE 'Готово' END AS next_action,
  CASE WHEN legal IS NULL THEN 'legal, ' ELSE '' END || CASE WHEN inn IS NULL THEN 'inn, ' ELSE '' END || 'revenue, okved, ' || CASE WHEN site IS NULL THEN 'site, ' ELSE '' END || 'ceo, marketing, ' || CASE WHEN email IS NULL THEN 'email, ' ELSE '' END || 'phone, social, source' AS missing,
  brand || ' ' || segment AS query, 'https://search.example/?q=' || replace(brand, '#', '%23') || '+' || segment AS search_1 FROM i
"""


def brand_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3"""
    return G.icp_summary(brand_rows(spark, sf_dir))


BRAND_SUMMARY = f"WITH {BRANDS_SQL} SELECT count(*) AS total, count(validation) AS validation, count(excluded) AS excluded, count(inn) AS with_inn, count(site) AS with_site, count(email) AS with_email, 0::BIGINT AS with_phone FROM i"


def priority_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4"""
    return G.select_priority(brand_rows(spark, sf_dir), "P1", 50).select("row_idx", "brand")


PRIORITY_ROWS = f"WITH {BRANDS_SQL} SELECT row_idx, brand FROM i WHERE priority = 'P1' ORDER BY row_idx LIMIT 50"


def frequent_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, D22"""
    return G.top_k(brand_rows(spark, sf_dir).withColumn("pair", F.concat_ws("/", "segment", "priority")), "pair", 20)


FREQUENT = f"WITH {BRANDS_SQL} SELECT segment || '/' || priority AS pair, count(*) AS n, min(row_idx) AS first_seen FROM i GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 20"


def brand_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: priorities, and the most frequent segments."""
    return G.icp_breakdown(brand_rows(spark, sf_dir), 3)


BREAKDOWN = f"""
WITH {BRANDS_SQL}, s AS (SELECT segment AS value, count(*) AS n, min(row_idx) AS first_seen FROM i WHERE segment <> '' GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 3)
SELECT 'priority' AS kind, priority AS value, count(*) AS n, min(row_idx) AS first_seen FROM i GROUP BY priority UNION ALL SELECT 'segment', * FROM s
"""


def batch_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2"""
    return G.status_counts(batch(spark, sf_dir))


STATUSES = "SELECT CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'ROW_ERROR' ELSE 'NEEDS_REVIEW' END AS status, count(*) AS n FROM events GROUP BY 1"


def icp_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand rows read back from a raw grid."""
    rows = brand_rows(spark, sf_dir)
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in G.ICP_HEADERS])
    data = rows.select(F.lit("f").alias("source_file"), F.lit("s").alias("sheet"), F.lit(1).alias("sheet_idx"), (F.col("row_idx") + 2).alias("row_idx"), cells.alias("cells"))
    head = spark.range(1).select(F.lit("f").alias("source_file"), F.lit("s").alias("sheet"), F.lit(1).alias("sheet_idx"), F.lit(1).cast("bigint").alias("row_idx"), F.array(*map(F.lit, G.ICP_HEADERS.values())).alias("cells"))
    return G.read_icp(data.unionByName(head)).select("row_idx", "brand", "segment", "priority", "inn", "site", "phone")


ICP_TABLE = f"WITH {BRANDS_SQL} SELECT row_idx + 2 AS row_idx, brand, segment, priority, inn, site, NULL::VARCHAR AS phone FROM i"

_PAIRS = [
    (header_rows, HEADER_ROWS), (projected_rows, PROJECTED), (sheet_profiles, SHEET_PROFILES), (workbook_profile, WORKBOOK), (selected_preview, PREVIEW), (sliced_rows, SLICED), (website_rows, WEBSITE_ROWS), (website_counts, WEBSITE_COUNTS),
    (external_rows, EXTERNAL), (merged_tabs, MERGED_TABS), (listing_sample, LISTING_SAMPLE), (rows_by_sheet, ROWS_BY_SHEET), (batch_columns, BATCH_COLUMNS), (json_rows, JSON_ROWS), (legal_lookup, LEGAL_LOOKUP), (work_queue, WORK_QUEUE),
    (brand_summary, BRAND_SUMMARY), (priority_rows, PRIORITY_ROWS), (frequent_priorities, FREQUENT), (brand_breakdown, BREAKDOWN), (batch_statuses, STATUSES), (icp_table, ICP_TABLE),
]
QUERIES = {f.__name__: f for f, _ in _PAIRS}
ORACLES = {f.__name__: s for f, s in _PAIRS}
