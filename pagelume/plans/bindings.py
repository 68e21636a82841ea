"""The engine's input tables, bound to the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.pages import Terms

IMPORTED_AT = "2024-03-01 12:00:00"
CUT = "2024-01-15 00:00:00"
#: Words that occur in the driver's pages, so that signals aren't all false.
PAGE_TERMS = Terms(catalog=("tion", "menteux"), cart=("eau",), checkout=("cción",), buy=("the and",), delivery=("ung",), payment=("keit",), consumer=("para",), manufacturer=("oint", "est,"), request=("of the",), callback=("nicht",), quote=("les les",), b2b=("ingthe",), hacked=("casino", "the"), catalog_marks=("/the",), cart_marks=("track(1)",), checkout_marks=("/order",), product_marks=("/page", ".html"), structured_marks=("article",), platform_marks=("ref=",), marketplace_a=("/and",), marketplace_b=("/to",))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files by day: file, file_ord, row_idx, seller, inn, status, brand, display_name, ts."""
    e = load(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    return e.select(
        day.alias("file"),
        F.datediff("ts", F.lit("1970-01-01")).alias("file_ord"),
        F.col("event_id").alias("row_idx"),
        F.when(F.col("event_type") == "view", "").otherwise(F.concat(F.lit(" Seller "), (F.col("user_id") % 97).cast("string"))).alias("seller"),
        F.when(F.col("event_type") != "error", F.concat(F.lpad(F.col("user_id").cast("string"), 10, "0"), F.lit(".0"))).alias("inn"),
        F.when(F.col("event_type") == "purchase", "SUCCESS").when(F.col("event_type") == "error", "ROW_ERROR").otherwise("NEEDS_REVIEW").alias("status"),
        F.when(F.col("value") > 20, F.concat(F.lit("b"), F.floor("value").cast("string"))).otherwise("").alias("brand"),
        F.when(F.col("value") > 10, F.concat(F.lit("Name "), (F.col("user_id") % 97).cast("string"))).alias("display_name"),
        "ts",
    )


BATCH_SQL = """
b AS (SELECT strftime(ts, '%Y-%m-%d') AS file, date_diff('day', DATE '1970-01-01', ts::DATE) AS file_ord, event_id AS row_idx,
  CASE WHEN event_type = 'view' THEN '' ELSE ' Seller ' || (user_id % 97)::VARCHAR END AS seller,
  CASE WHEN event_type <> 'error' THEN lpad(user_id::VARCHAR, 10, '0') || '.0' END AS inn,
  CASE WHEN event_type = 'purchase' THEN 'SUCCESS' WHEN event_type = 'error' THEN 'ROW_ERROR' ELSE 'NEEDS_REVIEW' END AS status,
  CASE WHEN value > 20 THEN 'b' || floor(value)::BIGINT::VARCHAR ELSE '' END AS brand,
  CASE WHEN value > 10 THEN 'Name ' || (user_id % 97)::VARCHAR END AS display_name, ts,
  CASE WHEN event_type <> 'error' THEN lpad(user_id::VARCHAR, 10, '0') END AS k FROM events)
"""


def registry_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry before an import: users of the first days, one in three."""
    old = batch(spark, sf_dir).where((F.col("ts") < CUT) & F.col("inn").isNotNull()).withColumn("inn", F.regexp_replace("inn", r"\.0$", ""))
    at = lambda s: F.to_timestamp(F.lit(s))
    return old.where(F.col("inn").cast("bigint") % 3 == 0).groupBy("inn").agg(F.min_by("seller", "row_idx").alias("seller"), F.min_by("status", "row_idx").alias("status"), F.countDistinct("file").alias("seen_count"), at("2024-01-01 00:00:00").alias("first_seen_at"), at("2024-01-14 00:00:00").alias("last_seen_at"), F.max_by("file", "row_idx").alias("last_source"))


REGISTRY_SQL = f"""
r AS (SELECT k AS inn, arg_min(seller, row_idx) AS seller, arg_min(status, row_idx) AS status, count(DISTINCT file) AS seen_count,
  TIMESTAMP '2024-01-01 00:00:00' AS first_seen_at, TIMESTAMP '2024-01-14 00:00:00' AS last_seen_at, arg_max(file, row_idx) AS last_source
  FROM b WHERE ts < TIMESTAMP '{CUT}' AND k IS NOT NULL AND k::BIGINT % 3 = 0 GROUP BY k)
"""


def later(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch(spark, sf_dir).where(F.col("ts") >= CUT)


LATER_SQL = f"n AS (SELECT * FROM b WHERE ts >= TIMESTAMP '{CUT}')"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing rows: source_file, sheet, sheet_idx, row_idx, product, article, brand, seller."""
    li, p, s = (load(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    rows = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    return rows.select(F.lit("list").alias("source_file"), F.col("p_type").alias("sheet"), F.ascii("p_type").alias("sheet_idx"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_idx"), F.col("p_name").alias("product"), F.when(F.col("p_size") > 5, F.col("p_partkey")).alias("article"), F.col("p_brand").alias("brand"), F.when(F.col("s_suppkey") % 9 == 0, "").otherwise(F.col("s_name")).alias("seller"), "l_quantity", "l_extendedprice")


LISTING_SQL = """
l AS (SELECT p_type AS sheet, ascii(p_type) AS sheet_idx, l_orderkey * 10 + l_linenumber AS row_idx, p_name AS product,
  CASE WHEN p_size > 5 THEN p_partkey END AS article, p_brand AS brand, CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE s_name END AS seller, l_quantity, l_extendedprice
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
"""


def known_sellers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Keys of a registry and of a history: (seller_key)."""
    s = load(spark, sf_dir, "supplier").select(F.lower("s_name").alias("seller_key"), "s_suppkey")
    return s.where("s_suppkey % 4 = 1").select("seller_key"), s.where("s_suppkey % 4 in (1, 2)").select("seller_key")


KNOWN_SQL = """
k AS (SELECT lower(s_name) AS seller_key, CASE WHEN s_suppkey % 4 = 1 THEN 'registry' ELSE 'history' END AS source FROM supplier WHERE s_suppkey % 4 IN (1, 2))
"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sheets from customers: one sheet a market segment, some with their header in row 3, one without."""
    c = load(spark, sf_dir, "customer")
    at = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey"))
    shift = F.when(F.col("c_mktsegment") == "MACHINERY", 3).otherwise(1)
    site = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("www.c"), F.col("c_custkey").cast("string"), F.lit(".example.com/a"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.com")))
    data = c.select(F.lit("book").alias("source_file"), F.col("c_mktsegment").alias("sheet"), F.ascii("c_mktsegment").alias("sheet_idx"), (at + shift).alias("row_idx"), F.when(F.col("c_custkey") % 10 == 7, F.array(F.lit(" "), F.lit(""))).otherwise(F.array(F.concat(F.lit(" "), F.col("c_name")), F.col("c_custkey").cast("string"), site, F.lpad((F.col("c_custkey") % 500).cast("string"), 10, "0"))).alias("cells"))
    sheets = c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    names = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("Name"), F.lit("No"), F.lit("Web"), F.lit("Other"))).otherwise(F.array(F.lit(" Name "), F.lit("Article"), F.lit("Website"), F.lit("INN")))
    heads = sheets.select(F.lit("book").alias("source_file"), F.col("c_mktsegment").alias("sheet"), F.ascii("c_mktsegment").alias("sheet_idx"), shift.alias("row_idx"), names.alias("cells"))
    return data.unionByName(heads)


GRID_SQL = """
g AS (SELECT c_mktsegment AS sheet, ascii(c_mktsegment) AS sheet_idx,
  row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) + CASE WHEN c_mktsegment = 'MACHINERY' THEN 3 ELSE 1 END AS row_idx, c_custkey, c_custkey % 10 = 7 AS blank,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 3 ELSE 1 END AS header_row, c_mktsegment <> 'BUILDING' AS valid, c_name FROM customer)
"""


def brand_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work-queue rows from customers and their orders."""
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    first = o.groupBy("o_custkey").agg(F.min("o_orderpriority").alias("p"), F.count(F.lit(1)).alias("n"))
    j = c.join(first, c.c_custkey == first.o_custkey, "left")
    even = lambda k, v: F.when(F.col("c_custkey") % k == 0, v)
    none = F.lit(None).cast("string")
    return j.select(F.col("c_custkey").alias("row_idx"), F.col("c_name").alias("brand"), F.col("c_mktsegment").alias("segment"), even(7, F.lit("?")).alias("validation"), even(11, F.lit("да")).alias("excluded"), F.concat(F.lit("P"), F.coalesce(F.substring("p", 1, 1), F.lit("9"))).alias("priority"), F.lit("Не начато").alias("status"), even(2, F.lit("ООО")).alias("legal"), even(3, F.lit("1234567890")).alias("inn"), none.alias("revenue"), none.alias("okved"), even(4, F.lit("www.example.com")).alias("site"), none.alias("ceo"), none.alias("marketing"), even(6, F.lit("a@b.cc")).alias("email"), even(10, F.lit("")).alias("phone"), none.alias("social"), none.alias("source"))


BRANDS_SQL = """
i AS (SELECT c_custkey AS row_idx, c_name AS brand, c_mktsegment AS segment, CASE WHEN c_custkey % 7 = 0 THEN '?' END AS validation, CASE WHEN c_custkey % 11 = 0 THEN 'да' END AS excluded,
  'P' || coalesce(substr(p, 1, 1), '9') AS priority, CASE WHEN c_custkey % 2 = 0 THEN 'ООО' END AS legal, CASE WHEN c_custkey % 3 = 0 THEN '1234567890' END AS inn,
  CASE WHEN c_custkey % 4 = 0 THEN 'www.example.com' END AS site, CASE WHEN c_custkey % 6 = 0 THEN 'a@b.cc' END AS email, CASE WHEN c_custkey % 10 = 0 THEN '' END AS phone
  FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS p FROM orders GROUP BY 1) ON c_custkey = o_custkey)
"""


def seller_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored seller pages made from events, with labelled requisites in tooltips, text or nowhere."""
    e = load(spark, sf_dir, "events")
    u = F.col("user_id")
    inn = F.concat(F.lit("ИНН: "), F.lpad(u.cast("string"), 10, "7"))
    ogrn = F.concat(F.lit("ОГРН "), F.lpad(u.cast("string"), 13, "1"))
    name = F.concat(F.lit("Магазин "), u.cast("string"))
    html = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('<body><h1>'), name, F.lit('</h1><div class="x tooltip-supplier">ООО "'), name, F.lit('"<br>\n'), inn, F.lit("<br>\n"), ogrn, F.lit("</div></body>")))
        .when(F.col("event_type") == "view", F.concat(F.lit('<body><h2 class="seller-details__title">'), name, F.lit("</h2><p>Республика Беларусь, УНП 1</p></body>")))
        .when(F.col("event_type") == "error", F.concat(F.lit("<body><p>Nothing found</p><h1>"), name, F.lit("</h1></body>")))
        .when(F.col("event_type") == "signup", F.concat(F.lit('<body><i class="seller-info">i</i><h1>'), name, F.lit("</h1></body>")))
        .otherwise(F.concat(F.lit("<body><p>"), name, F.lit(" Индивидуальный предприниматель "), inn, F.lit("</p></body>")))
    )
    url = F.concat(F.lit("https://www.wildberries.ru/"), F.when(u % 2 == 0, F.concat(F.lit("seller/"), u.cast("string"))).otherwise(F.concat(F.lit("catalog/"), u.cast("string"), F.lit("/detail"))))
    return e.select(F.col("event_id").alias("page_id"), url.alias("url"), html.alias("html"), u.alias("user_id"), "event_type")


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results per brand: brand_id, brand, segment, url, title, snippet, engine_ord, rank."""
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    n = F.col("o_orderkey")
    word = F.when(n % 3 == 0, F.lit("customer")).when(n % 3 == 1, F.lit("shop")).otherwise(F.lit("other"))
    zone = F.when(n % 4 == 0, ".ru").when(n % 4 == 1, ".com").when(n % 4 == 2, ".de").otherwise(".org")
    url = F.concat(F.lit("https://"), F.when(n % 50 == 0, F.lit("ozon")).otherwise(F.concat(word, (n % 13).cast("string"))), zone, F.when(n % 5 == 0, "/").when(n % 5 == 1, "/a/b").otherwise("/contact"))
    return j.select(F.col("c_custkey").alias("brand_id"), F.regexp_replace("c_name", "#", " ").alias("brand"), F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Косметика").when(F.col("c_mktsegment") == "MACHINERY", "Одежда").otherwise(F.col("c_mktsegment")).alias("segment"), url.alias("url"), F.when(n % 6 == 0, "Official beauty site").when(n % 6 == 1, "game shoes review").otherwise("page").alias("title"), F.lit("text").alias("snippet"), (n % 3).cast("int").alias("engine_ord"), n.alias("rank"))


RESULTS_SQL = """
s AS (SELECT c_custkey AS brand_id, replace(c_name, '#', ' ') AS brand, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Косметика' WHEN 'MACHINERY' THEN 'Одежда' ELSE c_mktsegment END AS segment, o_orderkey AS n,
  CASE WHEN o_orderkey % 50 = 0 THEN 'ozon' ELSE (CASE o_orderkey % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'shop' ELSE 'other' END) || (o_orderkey % 13)::VARCHAR END || (CASE o_orderkey % 4 WHEN 0 THEN '.ru' WHEN 1 THEN '.com' WHEN 2 THEN '.de' ELSE '.org' END) AS host,
  CASE o_orderkey % 5 WHEN 0 THEN '/' WHEN 1 THEN '/a/b' ELSE '/contact' END AS path, CASE o_orderkey % 6 WHEN 0 THEN 'Official beauty site' WHEN 1 THEN 'game shoes review' ELSE 'page' END AS title, (o_orderkey % 3)::INTEGER AS engine_ord, o_orderkey AS rank
  FROM orders JOIN customer ON o_custkey = c_custkey),
t AS (SELECT *, 'https://' || host || path AS url, lower(host || ' ' || path || ' ' || title || ' text') AS hay, string_split(lower(brand), ' ') AS tok FROM s),
c AS (SELECT *, CASE WHEN host IN ('ozon.ru') THEN -100
  WHEN list_sum([contains(hay, x)::INT + contains(host, x)::INT FOR x IN tok]) = 0 THEN -10
  ELSE list_sum([contains(hay, x)::INT * 12 + contains(host, x)::INT * 10 FOR x IN tok])
   + CASE WHEN contains(hay, 'official') OR contains(hay, 'contact') THEN 8 ELSE 0 END
   + CASE WHEN segment = 'Косметика' AND contains(hay, 'beauty') THEN 20 WHEN segment = 'Косметика' AND contains(hay, 'game') THEN -45 WHEN segment = 'Одежда' AND contains(hay, 'shoes') THEN 15 ELSE 0 END
   + CASE WHEN host LIKE '%.ru' THEN 8 WHEN host LIKE '%.de' THEN -10 ELSE 0 END
   + CASE WHEN path = '/' THEN 5 ELSE 0 END + CASE WHEN path <> '/a/b' THEN 3 ELSE 0 END
   + CASE WHEN contains(hay, 'review') THEN -8 ELSE 0 END END::INTEGER AS score FROM t)
"""
