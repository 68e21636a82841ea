"""Queries of the registry and history operators on result files made of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import category_of, norm_inn, norm_key
from ..operators import outcomes as O
from ..operators import registry as R
from .bindings import BATCH_SQL, CUT, IMPORTED_AT, KNOWN_SQL, LATER_SQL, LISTING_SQL, REGISTRY_SQL, batch, known_sellers, later, listing, load, registry_before

AT = f"TIMESTAMP '{IMPORTED_AT}'"


def first_wins_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 with blank keys kept."""
    return R.first_wins(listing(spark, sf_dir), norm_key(F.col("seller")), ["sheet_idx", "row_idx", "product"], True).groupBy("seller").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("row_idx"))


FIRST_WINS = f"""
WITH {LISTING_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY lower(seller) ORDER BY sheet_idx, row_idx, product) AS rn FROM l)
SELECT seller, count(*) AS n, min(row_idx) AS row_idx FROM o WHERE rn = 1 OR seller = '' GROUP BY seller
"""


def duplicate_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4"""
    return R.mark_duplicates(batch(spark, sf_dir), norm_inn(F.col("inn"))).select("row_idx", "key", "in_file", "file_nth")


DUPLICATES = f"""
WITH {BATCH_SQL} SELECT row_idx, coalesce(k, '') AS key, CASE WHEN k IS NOT NULL THEN row_number() OVER (PARTITION BY k, file_ord ORDER BY row_idx) END AS in_file, CASE WHEN k IS NOT NULL THEN dense_rank() OVER (PARTITION BY k ORDER BY file_ord) END AS file_nth FROM b
"""


def import_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By file and, as 'all', in sum."""
    m = R.import_metrics(later(spark, sf_dir), registry_before(spark, sf_dir), norm_inn(F.col("inn")))
    return R.import_totals(m).withColumn("file", F.coalesce("file", F.lit("all")))


METRICS = f"""
WITH {BATCH_SQL}, {REGISTRY_SQL}, {LATER_SQL}, d AS (SELECT file, coalesce(k, '') AS key, CASE WHEN k IS NOT NULL THEN row_number() OVER (PARTITION BY k, file_ord ORDER BY row_idx) END AS rn, dense_rank() OVER (PARTITION BY k ORDER BY file_ord) AS fn, k IN (SELECT inn FROM r) AS had FROM n)
SELECT coalesce(file, 'all') AS file, count(*) AS total, count(*) FILTER (key <> '') AS with_key, count(*) FILTER (rn = 1) AS unique_keys, count(*) FILTER (rn = 1 AND NOT had AND fn = 1) AS new, count(*) FILTER (rn = 1 AND (had OR fn > 1)) AS known, count(*) FILTER (rn > 1) AS duplicate, count(*) FILTER (key = '') AS skipped
FROM d GROUP BY ROLLUP (file)
"""


def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5"""
    return R.upsert_registry(registry_before(spark, sf_dir), later(spark, sf_dir), IMPORTED_AT)


UPSERT = f"""
WITH {BATCH_SQL}, {REGISTRY_SQL}, {LATER_SQL}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, file_ord ORDER BY row_idx) AS rn FROM n WHERE k IS NOT NULL) WHERE rn = 1),
a AS (SELECT k AS inn, arg_min(seller, file_ord) AS s, arg_min(status, file_ord) AS st, count(*) AS files, arg_max(file, file_ord) AS src FROM f GROUP BY k)
SELECT inn, CASE WHEN r.seen_count IS NULL THEN s ELSE seller END AS seller, CASE WHEN r.seen_count IS NULL THEN st ELSE status END AS status, (coalesce(seen_count, 0) + coalesce(files, 0))::BIGINT AS seen_count,
  coalesce(first_seen_at, {AT}) AS first_seen_at, CASE WHEN files IS NOT NULL THEN {AT} ELSE last_seen_at END AS last_seen_at, coalesce(src, last_source) AS last_source FROM r FULL JOIN a USING (inn)
"""


def registry_new_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D11"""
    before = registry_before(spark, sf_dir)
    return R.new_keys(before, R.upsert_registry(before, later(spark, sf_dir), IMPORTED_AT))


NEW_KEYS = f"WITH {BATCH_SQL}, {REGISTRY_SQL}, {LATER_SQL} SELECT DISTINCT k AS inn FROM n WHERE k IS NOT NULL AND k NOT IN (SELECT inn FROM r)"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import HISTORY

    return R.upsert_history(spark.createDataFrame([], HISTORY), batch(spark, sf_dir).where(F.col("ts") < CUT), "2024-01-15 06:00:00")


def history_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6, twice: a first import and one upon it."""
    return R.upsert_history(_history(spark, sf_dir), later(spark, sf_dir), IMPORTED_AT)


def _history_sql(where: str) -> str:
    last = lambda c: f"arg_max({c}, file_ord) FILTER ({c} <> '') AS {c}"
    o = "file_ord"
    once = f"(SELECT * FROM b WHERE {where} AND trim(seller) <> '' QUALIFY row_number() OVER (PARTITION BY lower(trim(seller)), file_ord ORDER BY row_idx) = 1)"
    return f"""SELECT lower(trim(seller)) AS seller_key, arg_min(seller, {o}) AS seller, count(*) AS seen_count, arg_min(file, {o}) AS first_source, arg_max(file, {o}) AS last_source,
  bool_or(coalesce(inn, '') <> '' OR status IN ('SUCCESS')) AS skip, {last("display_name")}, {last("inn")}, {last("status")}, {last("brand")} FROM {once} GROUP BY 1"""


HISTORY_UPSERT = f"""
WITH {BATCH_SQL}, o AS ({_history_sql(f"ts < TIMESTAMP '{CUT}'")}), n AS ({_history_sql(f"ts >= TIMESTAMP '{CUT}'")})
SELECT seller_key, coalesce(o.seller, n.seller) AS seller, coalesce(o.seen_count, 0) + coalesce(n.seen_count, 0) AS seen_count, coalesce(o.first_source, n.first_source) AS first_source, coalesce(n.last_source, o.last_source) AS last_source,
  CASE WHEN o.seen_count IS NOT NULL THEN TIMESTAMP '2024-01-15 06:00:00' ELSE {AT} END AS first_seen_at, CASE WHEN n.seen_count IS NOT NULL THEN {AT} ELSE TIMESTAMP '2024-01-15 06:00:00' END AS last_seen_at,
  coalesce(o.skip, false) OR coalesce(n.skip, false) AS skip, {", ".join(f"coalesce(n.{c}, o.{c}) AS {c}" for c in ("display_name", "inn", "status", "brand"))} FROM o FULL JOIN n USING (seller_key)
"""


def history_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry goes into the history."""
    h = R.import_history(_history(spark, sf_dir), registry_before(spark, sf_dir))
    return h.select("seller_key", "seen_count", "first_seen_at", "last_seen_at", "skip")


HISTORY_IMPORT = f"""
WITH {BATCH_SQL}, {REGISTRY_SQL}, o AS ({_history_sql(f"ts < TIMESTAMP '{CUT}'")}), n AS (SELECT lower(trim(seller)) AS seller_key, sum(seen_count) AS seen_count, true AS skip FROM r WHERE trim(seller) <> '' GROUP BY 1)
SELECT seller_key, (coalesce(o.seen_count, 0) + coalesce(n.seen_count, 0))::BIGINT AS seen_count, CASE WHEN o.seen_count IS NULL THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-01-15 06:00:00' END AS first_seen_at,
  CASE WHEN n.seen_count IS NOT NULL THEN TIMESTAMP '2024-01-14 00:00:00' ELSE TIMESTAMP '2024-01-15 06:00:00' END AS last_seen_at, coalesce(o.skip, false) OR coalesce(n.skip, false) AS skip FROM o FULL JOIN n USING (seller_key)
"""


def _result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches under the names of result files, in folders of categories."""
    b = batch(spark, sf_dir)
    path = F.concat(F.lit("/data/results/Kind "), (F.col("file_ord") % 3).cast("string"), F.lit("/Part/"), F.col("file"), F.lit(".csv"))
    url = F.when(F.col("row_idx") % 3 == 0, F.concat(F.lit("https://w.example/seller/"), F.trim("seller")))
    return b.select(
        path.alias("file"), "file_ord", "row_idx", F.col("seller").alias("marketguru_seller_name"), F.col("display_name").alias("wb_seller_name"), url.alias("wb_seller_url"), "inn",
        F.when(F.col("row_idx") % 2 == 0, F.lit("LLC")).otherwise("").alias("entity_type"), F.col("status").alias("parse_status"), F.col("brand").alias("parse_note"), "ts",
    )


def _seller_history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from ..operators import history as HI

    files = _result_files(spark, sf_dir)
    early = HI.update_history(spark.createDataFrame([], HI.SELLER_HISTORY), files.where(F.col("ts") < CUT), category_of(F.col("file")), "2024-01-15 06:00:00")
    return early, files.where(F.col("ts") >= CUT)


def seller_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6, N22 at full width: two imports of result files, one upon the other."""
    from ..operators import history as HI

    early, files = _seller_history(spark, sf_dir)
    return HI.update_history(early, files, category_of(F.col("file")), IMPORTED_AT)


def seller_history_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7 at full width: the rows of a registry, with times, sources, counts and categories of their own, go into a history."""
    from ..operators import history as HI

    early, files = _seller_history(spark, sf_dir)
    registry = early.withColumnRenamed("last_seller_name_raw", "seller_name_raw").select("seller_name_raw", "seen_count", "first_seen_at", "first_source_batch", "last_category", F.col("last_parse_status").alias("parse_status"), "inn")
    rows = registry.where("seller_name_raw not like '%7'").select(F.lit("registry.xlsx").alias("file"), F.lit(1).alias("file_ord"), F.crc32("seller_name_raw").alias("row_idx"), "*")
    late = HI.update_history(spark.createDataFrame([], HI.SELLER_HISTORY), files, category_of(F.col("file")), IMPORTED_AT)
    return HI.update_history(late, rows, F.lit("inn_registry"), "2024-04-01 00:00:00")


def seller_history_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of the import log for each file of the second import, and the totals."""
    from ..operators import history as HI

    early, files = _seller_history(spark, sf_dir)
    metrics = HI.history_metrics(early, files)
    log = HI.history_log(metrics, category_of(F.col("file")), IMPORTED_AT)
    total = HI.history_totals(metrics).drop("files").select(F.lit(IMPORTED_AT).alias("imported_at"), F.lit("all").alias("source_batch_file"), F.lit("").alias("category"), "*")
    return log.unionByName(total)


ONCE_SQL = f"""{BATCH_SQL}, s AS (SELECT lower(trim(coalesce(nullif(seller, ''), display_name, ''))) AS key, '/data/results/Kind ' || (file_ord % 3)::VARCHAR || '/Part/' || file || '.csv' AS path, 'Kind ' || (file_ord % 3)::VARCHAR || ' / Part' AS category,
  file_ord, row_idx, ts, nullif(seller, '') AS name, nullif(display_name, '') AS display, CASE WHEN row_idx % 3 = 0 THEN 'https://w.example/seller/' || trim(seller) END AS url, CASE WHEN row_idx % 2 = 0 THEN 'LLC' END AS entity,
  k AS inn, nullif(status, '') AS status, nullif(brand, '') AS note, row_number() OVER (PARTITION BY lower(trim(coalesce(nullif(seller, ''), display_name, ''))), file_ord ORDER BY row_idx) AS nth FROM b)"""


def _fold_sql(where: str, at: str) -> str:
    first = lambda c: f"arg_min({c}, file_ord) FILTER ({c} IS NOT NULL)"
    last = lambda c: f"arg_max({c}, file_ord) FILTER ({c} IS NOT NULL)"
    return f"""SELECT key AS seller_key, {first("name")} AS first_seller_name_raw, {last("name")} AS last_seller_name_raw, {last("display")} AS seller_display_name, {last("url")} AS seller_url, {last("entity")} AS entity_type, {last("inn")} AS inn,
  NULL::VARCHAR AS ogrn, NULL::VARCHAR AS ogrnip, {first("status")} AS first_parse_status, {last("status")} AS last_parse_status, {first("note")} AS first_note, {last("note")} AS last_note, bool_or(inn IS NOT NULL OR status = 'SUCCESS') AS skip_recommended, count(*) AS seen_count,
  '{at}' AS first_seen_at, '{at}' AS last_seen_at, arg_min(path, file_ord) AS first_source_batch, arg_max(path, file_ord) AS last_source_batch, arg_min(category, file_ord) AS first_category, arg_max(category, file_ord) AS last_category FROM s WHERE {where} AND key <> '' AND nth = 1 GROUP BY key"""


def _merged_sql() -> str:
    from ..operators.history import COLUMNS

    def value(c: str) -> str:
        if c == "seller_key":
            return c
        if c == "seen_count":
            return "coalesce(o.seen_count, 0) + coalesce(n.seen_count, 0) AS seen_count"
        if c == "skip_recommended":
            return "coalesce(o.skip_recommended, false) OR coalesce(n.skip_recommended, false) AS skip_recommended"
        return f"coalesce(o.{c}, n.{c}) AS {c}" if c.startswith("first_") else f"coalesce(n.{c}, o.{c}) AS {c}"

    return "SELECT " + ", ".join(map(value, COLUMNS)) + " FROM o FULL JOIN n USING (seller_key)"


EARLY_SQL, LATE_SQL = _fold_sql(f"ts < TIMESTAMP '{CUT}'", "2024-01-15 06:00:00"), _fold_sql(f"ts >= TIMESTAMP '{CUT}'", IMPORTED_AT)
SELLER_HISTORY = f"WITH {ONCE_SQL}, o AS ({EARLY_SQL}), n AS ({LATE_SQL}) {_merged_sql()}"
SELLER_HISTORY_IMPORT = f"""
WITH {ONCE_SQL}, e AS ({EARLY_SQL}), o AS ({LATE_SQL}), n AS (SELECT seller_key, last_seller_name_raw AS first_seller_name_raw, last_seller_name_raw, NULL::VARCHAR AS seller_display_name, NULL::VARCHAR AS seller_url, NULL::VARCHAR AS entity_type, inn,
  NULL::VARCHAR AS ogrn, NULL::VARCHAR AS ogrnip, last_parse_status AS first_parse_status, last_parse_status, NULL::VARCHAR AS first_note, NULL::VARCHAR AS last_note, inn IS NOT NULL OR last_parse_status = 'SUCCESS' AS skip_recommended, seen_count, first_seen_at, first_seen_at AS last_seen_at,
  first_source_batch, 'registry.xlsx' AS last_source_batch, 'inn_registry' AS first_category, last_category FROM e WHERE last_seller_name_raw NOT LIKE '%7') {_merged_sql()}"""
SELLER_HISTORY_LOG = f"""
WITH {ONCE_SQL}, h AS (SELECT DISTINCT key FROM s WHERE ts < TIMESTAMP '{CUT}' AND key <> ''),
x AS (SELECT *, row_number() OVER (PARTITION BY key, file_ord ORDER BY row_idx) AS rn, dense_rank() OVER (PARTITION BY key ORDER BY file_ord) AS fn, key IN (SELECT key FROM h) AS had FROM s WHERE ts >= TIMESTAMP '{CUT}')
SELECT '{IMPORTED_AT}' AS imported_at, coalesce(path, 'all') AS source_batch_file, CASE WHEN grouping(path) = 1 THEN '' ELSE any_value(category) END AS category, count(*) AS rows_total, count(*) FILTER (key <> '') AS rows_with_seller, count(*) FILTER (key <> '' AND rn = 1) AS unique_seller_in_file,
  count(*) FILTER (key <> '' AND rn = 1 AND NOT had AND fn = 1) AS new_seller_added, count(*) FILTER (key <> '' AND rn = 1 AND (had OR fn > 1)) AS already_known, count(*) FILTER (key <> '' AND rn > 1) AS duplicate_in_file, count(*) FILTER (key = '') AS skipped_without_seller,
  count(*) FILTER (key <> '' AND rn = 1 AND (inn IS NOT NULL OR status = 'SUCCESS')) AS skip_recommended_in_file FROM x GROUP BY ROLLUP (path)
"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = load(spark, sf_dir, "customer")
    key = F.when(F.col("c_custkey") % 13 == 0, " ").otherwise(F.concat(F.lit("K"), F.floor(F.col("c_custkey") / 2).cast("string")))
    rows = c.select(key.alias("inn"), F.col("c_custkey").alias("row_idx"), F.col("c_name").alias("seller"))
    return rows.where("row_idx % 3 <> 0"), rows.where("row_idx % 3 = 0 or row_idx % 5 = 0").withColumn("seller", F.lower("seller"))


SIDES = """
x AS (SELECT CASE WHEN c_custkey % 13 = 0 THEN '' ELSE 'k' || (c_custkey // 2)::VARCHAR END AS k, CASE WHEN c_custkey % 13 = 0 THEN ' ' ELSE 'K' || (c_custkey // 2)::VARCHAR END AS inn, c_custkey AS row_idx, c_name AS seller FROM customer),
p AS (SELECT * FROM x WHERE row_idx % 3 <> 0), s AS (SELECT * REPLACE (lower(seller) AS seller) FROM x WHERE row_idx % 3 = 0 OR row_idx % 5 = 0)
"""


def registry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8"""
    return R.merge_registries(*_sides(spark, sf_dir), "inn", "row_idx")


MERGE = f"""
WITH {SIDES}, p1 AS (SELECT * FROM p WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY row_idx) = 1), s1 AS (SELECT * FROM s WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY row_idx) = 1)
SELECT inn, row_idx, seller FROM p1 UNION ALL SELECT inn, row_idx, seller FROM s1 WHERE k NOT IN (SELECT k FROM p1)
"""


def registry_merge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, D23"""
    return R.merge_metrics(*_sides(spark, sf_dir), "inn")


MERGE_METRICS = f"""
WITH {SIDES}, g AS (SELECT k, sum(a) AS p, sum(b) AS s FROM (SELECT k, 1 AS a, 0 AS b FROM p UNION ALL SELECT k, 0, 1 FROM s) GROUP BY k)
SELECT sum(p)::BIGINT AS primary_rows, sum(s)::BIGINT AS secondary_rows, sum(CASE WHEN k = '' THEN p ELSE 0 END)::BIGINT AS primary_blank, sum(CASE WHEN k = '' THEN s ELSE 0 END)::BIGINT AS secondary_blank,
  count(*) FILTER (k <> '' AND p > 0) AS primary_keys, count(*) FILTER (k <> '' AND s > 0) AS secondary_keys, sum(CASE WHEN k <> '' AND p > 1 THEN p - 1 ELSE 0 END)::BIGINT AS primary_duplicates, sum(CASE WHEN k <> '' AND s > 1 THEN s - 1 ELSE 0 END)::BIGINT AS secondary_duplicates,
  count(*) FILTER (k <> '' AND p > 0 AND s > 0) AS overlap, count(*) FILTER (k <> '' AND p = 0) AS added, count(*) FILTER (k <> '' AND s = 0) AS primary_only, count(*) FILTER (k <> '') AS merged_keys FROM g
"""


def import_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D21"""
    n = load(spark, sf_dir, "nation")
    a = n.select(F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name")).alias("file"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_regionkey")).alias("new"))
    return R.append_imports(a, n.select(F.col("n_name").alias("file"), F.lit("x").alias("note")))


IMPORT_LOGS = "SELECT n_name AS file, n_regionkey AS new, NULL::VARCHAR AS note FROM nation WHERE n_nationkey % 3 > 0 UNION ALL SELECT n_name, NULL, 'x' FROM nation"


def seller_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of raw and displayed names."""
    b = batch(spark, sf_dir)
    return R.seller_index(b).select("seller_key", "row_idx")


SELLER_KEYS = f"""
WITH {BATCH_SQL}, k AS (SELECT lower(trim(seller)) AS seller_key, row_idx, 0 AS f FROM b UNION ALL SELECT lower(trim(coalesce(display_name, ''))), row_idx, 1 FROM b)
SELECT seller_key, min(row_idx) AS row_idx FROM k WHERE seller_key <> '' GROUP BY seller_key
"""


def routed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of listing rows."""
    reg, hist = known_sellers(spark, sf_dir)
    history = hist.withColumn("skip", F.lit(True)).withColumn("last_source", F.lit("h"))
    return R.route_metrics(R.route_known(listing(spark, sf_dir), R.known_sources(reg, R.skip_index(history))))


ROUTED = f"WITH {LISTING_SQL}, {KNOWN_SQL} SELECT CASE source WHEN 'registry' THEN 'SKIPPED_KNOWN' WHEN 'history' THEN 'SKIPPED_VIEWED' ELSE 'PROCESS' END AS route, count(*) AS n FROM l LEFT JOIN k ON lower(seller) = seller_key GROUP BY 1"


def excluded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, A11"""
    rows = listing(spark, sf_dir)
    return R.filter_effect(rows, R.exclude_known(rows, known_sellers(spark, sf_dir)[1]))


EXCLUDED = f"""
WITH {LISTING_SQL}, {KNOWN_SQL}, c AS (SELECT count(*) AS before, count(*) FILTER (lower(seller) NOT IN (SELECT seller_key FROM k)) AS after FROM l)
SELECT before, after, before - after AS excluded, before > 0 AND before - after > 0.75 * before AS warning FROM c
"""


def _external(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    left = c.select(F.col("c_custkey").alias("row"), F.when(F.col("c_custkey") % 10 > 0, F.concat(F.col("c_custkey").cast("string"), F.lit(".0"))).alias("inn"), F.col("c_name").alias("seller"))
    return left, o.select(F.concat(F.lit("INN "), F.col("o_custkey").cast("string")).alias("inn"), F.col("o_orderkey").alias("row_idx"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1"""
    return R.enrich(*_external(spark, sf_dir), "ext_")


ENRICHED = """
WITH e AS (SELECT o_custkey AS k, arg_min(o_orderpriority, o_orderkey) AS ext_priority, arg_min(o_totalprice, o_orderkey) AS ext_price, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey AS row, CASE WHEN c_custkey % 10 > 0 THEN c_custkey || '.0' END AS inn, c_name AS seller, n IS NOT NULL AS match_found, coalesce(n, 0) AS match_count, ext_priority, ext_price
FROM customer LEFT JOIN e ON c_custkey = k AND c_custkey % 10 > 0
"""


def enrichment_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10"""
    return R.match_rate(enriched(spark, sf_dir))


RATE = f'SELECT count(*) AS "rows", count(*) FILTER (match_found) AS matched, avg(match_found::INT) AS rate FROM ({ENRICHED})'


def unmatched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3"""
    return R.unmatched(enriched(spark, sf_dir)).select("row", "seller")


UNMATCHED = f"SELECT row, seller FROM ({ENRICHED}) WHERE NOT match_found"


def unique_inns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12"""
    return R.unique_inn(batch(spark, sf_dir))


UNIQUE_INNS = f"WITH {BATCH_SQL} SELECT k AS inn, arg_min(file, row_idx) AS file, min(row_idx) AS row_idx, arg_min(seller, row_idx) AS seller, count(*) AS n FROM b WHERE k IS NOT NULL GROUP BY k"


def rows_without_inn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, P5"""
    return R.no_inn(batch(spark, sf_dir)).select("row_idx", "status", O.skip_recommended(F.col("inn"), F.col("status")).alias("skip"))


NO_INN = f"WITH {BATCH_SQL} SELECT row_idx, status, status = 'SUCCESS' AS skip FROM b WHERE k IS NULL"


def best_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts per user, with failures among them."""
    e = load(spark, sf_dir, "events")
    error = F.when(F.col("event_id") % 4 == 0, "Timeout 30s").when(F.col("event_id") % 4 == 1, "Browser has been closed").otherwise("other")
    good = e.where("event_type <> 'error'").select(F.col("user_id").alias("row_id"), F.col("event_id").alias("attempt"), F.floor("value").alias("score"), F.lit("OK").alias("parse_status"), F.lit(None).cast("string").alias("failure"))
    bad = e.where("event_type = 'error'").select(F.col("user_id").alias("row_id"), F.col("event_id").alias("attempt"), F.lit(0).cast("bigint").alias("score"), F.lit("ROW_ERROR").alias("parse_status"), O.failure_class(error).alias("failure"))
    return O.best_attempt(good.unionByName(bad))


BEST_ATTEMPTS = """
WITH a AS (SELECT user_id AS row_id, event_id AS attempt, CASE WHEN event_type = 'error' THEN 0 ELSE floor(value)::BIGINT END AS score, CASE WHEN event_type = 'error' THEN 'ROW_ERROR' ELSE 'OK' END AS parse_status,
  CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'retry' WHEN 1 THEN 'restart' ELSE 'fatal' END END AS failure FROM events)
SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, attempt) = 1
"""


def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C18"""
    e = load(spark, sf_dir, "events").where("event_type = 'error'")
    return O.error_outcome(e.select(F.col("event_id").alias("row_id"), F.concat(F.lit("navigation  failed "), F.col("props")).alias("error")))


ERROR_ROWS = "SELECT event_id AS row_id, 'ROW_ERROR' AS parse_status, 'navigation failed ' || props AS note, 'retry' AS failure FROM events WHERE event_type = 'error'"

_PAIRS = [
    (first_wins_listing, FIRST_WINS), (duplicate_marks, DUPLICATES), (import_metrics, METRICS), (registry_upsert, UPSERT), (registry_new_keys, NEW_KEYS), (history_upsert, HISTORY_UPSERT), (history_import, HISTORY_IMPORT),
    (registry_merge, MERGE), (registry_merge_metrics, MERGE_METRICS), (import_logs, IMPORT_LOGS), (seller_keys, SELLER_KEYS), (routed_rows, ROUTED), (excluded_rows, EXCLUDED), (enriched, ENRICHED), (enrichment_rate, RATE),
    (unmatched_rows, UNMATCHED), (unique_inns, UNIQUE_INNS), (rows_without_inn, NO_INN), (best_attempts, BEST_ATTEMPTS), (error_rows, ERROR_ROWS),
    (seller_history, SELLER_HISTORY), (seller_history_import, SELLER_HISTORY_IMPORT), (seller_history_log, SELLER_HISTORY_LOG),
]
QUERIES = {f.__name__: f for f, _ in _PAIRS}
ORACLES = {f.__name__: s for f, s in _PAIRS}
