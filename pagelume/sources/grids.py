"""Messy grids: raw scans, headers, projections, profiles, samples; listing, website and work-queue tables.

A raw grid has (source_file, sheet, sheet_idx, row_idx, cells): values as text, rows numbered from 1 within a sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cells import is_empty_row, is_marker, norm_article, norm_headers, norm_inn, norm_key, to_text, trim_ws
from ..functions.urls import looks_like_website
from ..operators.registry import exclude_known, first_wins

LISTING_HEADERS = {"product": "Товар", "article": "Артикул", "brand": "Бренд", "seller": "Продавец"}
INN_HEADERS = ("инн", "inn", "tax id", "инн компании", "инн организации")
SHEET = ["source_file", "sheet"]


def read_grid(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """CSV files, one sheet each, in exact row order, of any width; line ends inside quotes belong to their cell. A file is
    read as one text, files in parallel; its lines are put together to rows by the number of quotes before them."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive).select("value", F.col("_metadata.file_path").alias("source_file"))
    lines = files.select("source_file", F.posexplode(F.split(F.regexp_replace("value", r"(?:\r?\n)+\z", ""), r"\r?\n")).alias("i", "line"))
    order = Window.partitionBy("source_file").orderBy("i")
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    opens = F.coalesce(F.sum(quotes).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 0
    rows = lines.withColumn("opens", opens.cast("int")).withColumn("row_idx", F.sum("opens").over(order).cast("int"))
    rows = rows.groupBy("source_file", "row_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("line"))
    found = F.regexp_extract_all(F.concat(F.lit(","), "line"), F.lit(r',("[^"]*(?:""[^"]*)*"|[^,]*)'), F.lit(1))
    plain = lambda x: F.when(F.startswith(x, F.lit('"')), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    cells = F.transform(found, lambda x: F.nullif(plain(x), F.lit("")))
    return rows.select("source_file", F.regexp_extract("source_file", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("sheet"), F.lit(1).alias("sheet_idx"), "row_idx", cells.alias("cells"))


def discover_batches(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Files of that name, without regard to case, below root: (path, file_ord)."""
    pattern = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    return files.withColumn("file_ord", F.dense_rank().over(Window.orderBy(F.lower("path"), "path")))


def detect_header(grid: DataFrame, required: tuple[str, ...], scan_limit: int = 20) -> DataFrame:
    """The first of a sheet's rows up to scan_limit that holds all required headers: (sheet, header_row, headers)."""
    trimmed = F.transform("cells", trim_ws)
    rows = grid.where(F.col("row_idx") <= scan_limit).where(F.size(F.array_except(F.array(*map(F.lit, required)), trimmed)) == 0)
    return rows.groupBy(*SHEET).agg(F.min_by(F.struct("row_idx", trimmed.alias("headers")), "row_idx").alias("h")).select(*SHEET, F.col("h.row_idx").alias("header_row"), "h.headers")


def project_grid(grid: DataFrame, headers: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """S3: named columns of the rows below the header; a short row gives null, of equal headers the last counts."""
    joined = grid.join(headers, SHEET).where(F.col("row_idx") > F.col("header_row"))
    at = lambda h: F.size("headers") - F.array_position(F.reverse("headers"), h).cast("int")
    cell = lambda h: F.when(F.array_contains("headers", h), F.get("cells", at(h)))
    return joined.select(*SHEET, "sheet_idx", "row_idx", "cells", *[cell(h).alias(k) for k, h in mapping.items()])


def profile_sheets(grid: DataFrame, required: tuple[str, ...], url_words: tuple[str, ...] = ("ссылка", "url", "link")) -> DataFrame:
    """Status, header row, rows, columns, non-empty data rows and header flags of each sheet."""
    sheets = grid.groupBy(*SHEET, "sheet_idx").agg(F.count(F.lit(1)).alias("rows_scanned"), F.max(F.size("cells")).alias("n_columns"))
    found = detect_header(grid, required)
    full = grid.join(found.select(*SHEET, "header_row"), SHEET).where((F.col("row_idx") > F.col("header_row")) & ~is_empty_row(F.col("cells"))).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("data_rows"))
    urlish = F.exists("headers", lambda h: F.exists(F.array(*map(F.lit, url_words)), lambda w: F.contains(F.lower(h), w)))
    out = sheets.join(found, SHEET, "left").join(full, SHEET, "left")
    return out.select(*SHEET, "sheet_idx", F.when(F.col("header_row").isNull(), "SKIPPED").otherwise("VALID").alias("status"), F.when(F.col("header_row").isNull(), "no header row").alias("reason"), "header_row", "rows_scanned", "n_columns", F.coalesce("data_rows", F.lit(0)).alias("data_rows"), F.coalesce(urlish, F.lit(False)).alias("has_url_header"), F.when(F.col("header_row").isNotNull(), F.lit(required[-1])).alias("key_field"))


def profile_workbook(profile: DataFrame) -> DataFrame:
    """One row for each file: numbers of sheets, and the first valid sheet's header row and data rows."""
    valid = F.col("status") == "VALID"
    first = F.min_by(F.struct("sheet", "header_row", "data_rows"), F.when(valid, F.col("sheet_idx"))).alias("f")
    return profile.groupBy("source_file").agg(F.count(F.lit(1)).alias("sheets"), F.count_if(valid).alias("valid_sheets"), F.count_if(~valid).alias("skipped_sheets"), first).select("source_file", "sheets", "valid_sheets", "skipped_sheets", F.when(F.col("valid_sheets") > 0, F.col("f.sheet")).alias("first_sheet"), F.when(F.col("valid_sheets") > 0, F.col("f.header_row")).alias("header_row"))


def select_sheets(grid: DataFrame, names: list[str]) -> DataFrame:
    """The named sheets, all for none; unknown names are an error that lists them."""
    if not names:
        return grid
    there = {r.sheet for r in grid.select("sheet").where(F.col("sheet").isin(*names)).distinct().collect()}  # at most the names
    if missing := [n for n in names if n not in there]:
        raise ValueError("unknown sheets: " + ", ".join(missing))
    return grid.where(F.col("sheet").isin(*names))


def preview(df: DataFrame, n: int, by: list[str], order: str = "row_idx") -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def slice_rows(df: DataFrame, start: int, limit: int, order: str = "row_idx") -> DataFrame:
    """Rows by position."""
    return df.where(F.col(order).between(start, start + limit - 1))


def drop_empty(grid: DataFrame) -> DataFrame:
    """P1"""
    return grid.where(~is_empty_row(F.col("cells")))


def resolve_header(headers: Column, candidates: tuple[str, ...] = INN_HEADERS, part: str = "инн") -> Column:
    """The first candidate, in priority order, among the headers; else the first header that contains the part."""
    named = lambda c: F.get(F.filter(headers, lambda h: norm_key(h) == c), F.lit(0))
    exact = [named(c) for c in candidates]
    return F.coalesce(*exact, F.get(F.filter(headers, lambda h: F.contains(norm_key(h), F.lit(part))), F.lit(0)))


def read_external(grid: DataFrame) -> DataFrame:
    """Rows of the first sheet whose first row has a tax-number header: (inn, row_idx, sheet, header, cells)."""
    heads = grid.where("row_idx = 1").select(*SHEET, "sheet_idx", norm_headers(F.col("cells")).alias("headers")).withColumn("header", resolve_header(F.col("headers"))).where("header is not null")
    first = heads.groupBy("source_file").agg(F.min_by(F.struct("sheet", "headers", "header"), "sheet_idx").alias("h")).select("source_file", "h.*")
    rows = grid.join(first, SHEET).where("row_idx > 1")
    inn = norm_inn(F.get("cells", F.array_position("headers", F.col("header")).cast("int") - 1))
    return rows.select(inn.alias("inn"), "row_idx", "sheet", "header", "cells").where("inn is not null")


def extract_website_rows(grid: DataFrame, preferred: str = "Ссылка на сайт", word: str = "сайт") -> DataFrame:
    """(sheet, row_idx, url): from the preferred column, else columns with the word, else, where there is none, any cell."""
    heads = grid.where("row_idx = 1").select(*SHEET, norm_headers(F.col("cells")).alias("headers"))
    at = lambda test: F.filter(F.transform("headers", lambda h, i: F.when(test(h), i)), lambda i: i.isNotNull())
    heads = heads.select(*SHEET, at(lambda h: h == preferred).alias("exact"), at(lambda h: F.contains(F.lower(h), F.lit(word))).alias("like"))
    columns = F.when(F.size("exact") > 0, F.col("exact")).otherwise(F.col("like"))
    rows = grid.where("row_idx > 1").join(heads.select(*SHEET, columns.alias("at")), SHEET, "left")  # a sheet may lack row 1
    pool = F.when(F.coalesce(F.size("at"), F.lit(0)) > 0, F.transform("at", lambda i: F.get("cells", i))).otherwise(F.col("cells"))
    return rows.withColumn("url", trim_ws(F.get(F.filter(pool, looks_like_website), F.lit(0)))).where("url is not null").select(*SHEET, "row_idx", "url")


def website_summary(grid: DataFrame) -> DataFrame:
    """S14"""
    data = grid.where("row_idx > 1").where(~is_empty_row(F.col("cells"))).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("total_rows"))
    return data.join(extract_website_rows(grid).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("with_website")), SHEET, "left").fillna(0, ["with_website"])


def listing_rows(grid: DataFrame) -> DataFrame:
    """Listing rows of valid sheets: sheet, sheet_idx, row_idx, product, article, brand, seller."""
    headers = detect_header(grid, tuple(LISTING_HEADERS.values()))
    rows = project_grid(drop_empty(grid), headers, LISTING_HEADERS)
    return rows.select(*SHEET, "sheet_idx", "row_idx", to_text(F.col("product")).alias("product"), norm_article(F.col("article")).alias("article"), to_text(F.col("brand")).alias("brand"), to_text(F.col("seller")).alias("seller"))


def sample_of(listing: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """Listing rows without known sellers, one for each seller (blank ones all), READY or without article; the limit last."""
    rows = first_wins(exclude_known(listing, known), norm_key(F.col("seller")), ["sheet_idx", "row_idx"], keep_blank=True)
    rows = rows.withColumn("parse_status", F.when(F.col("article").isNull(), "NO_NM_ID").otherwise("READY_FOR_RESEARCH"))
    return rows.orderBy("sheet_idx", "row_idx").limit(limit) if limit > 0 else rows


def build_sample(grid: DataFrame, known: DataFrame, limit: int = 0) -> DataFrame:
    return sample_of(listing_rows(grid), known, limit)


def count_by_sheet(rows: DataFrame) -> DataFrame:
    """A1"""
    return rows.groupBy("sheet").agg(F.count(F.lit(1)).alias("n")).orderBy(F.lower("sheet"), "sheet")


def merge_files(grids: DataFrame, output: str | None = None) -> DataFrame:
    """The first sheet of every file as tabs 1 .. n, in (name, path) order; temporary files and the output are left out."""
    name = F.regexp_extract("source_file", r"([^/]+)$", 1)
    rows = grids.where("sheet_idx = 1").where(~F.startswith(name, F.lit("~$")))
    if output:
        rows = rows.where(F.col("source_file") != output)
    tabs = rows.select("source_file").distinct().withColumn("tab", F.dense_rank().over(Window.orderBy(F.lower(name), F.lower("source_file"), "source_file")))
    return rows.join(tabs, "source_file").select("tab", "source_file", "row_idx", "cells")


# Work queue of brands

ICP_HEADERS = {
    "brand": "Бренд / компания", "segment": "Сегмент", "validation": "Нужна валидация (?)", "excluded": "Помечено как исключение",
    "priority": "Приоритет", "status": "Статус обогащения", "legal": "Юрлицо", "inn": "ИНН", "revenue": "Выручка, ₽", "okved": "ОКВЭД / производство",
    "site": "Сайт", "ceo": "ЛПР / CEO", "marketing": "Контакт маркетинга", "email": "Email", "phone": "Телефон", "social": "Telegram / соцсети", "source": "Источник контактов",
}
FILL_TARGETS = ("legal", "inn", "revenue", "okved", "site", "ceo", "marketing", "email", "phone", "social", "source")


def read_icp(grid: DataFrame) -> DataFrame:
    """Brand rows under a header in row 1, trimmed, without empty rows."""
    heads = grid.where("row_idx = 1").select(*SHEET, F.lit(1).alias("header_row"), norm_headers(F.col("cells")).alias("headers"))
    rows = project_grid(drop_empty(grid), heads, ICP_HEADERS)
    return rows.select(*SHEET, "row_idx", *[to_text(F.col(k)).alias(k) for k in ICP_HEADERS])


def fill_targets() -> Column:
    """Names of the missing fields, in order."""
    return F.array_join(F.filter(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in FILL_TARGETS]), lambda x: x.isNotNull()), ", ")


def recommend() -> Column:
    """C7"""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return F.when(is_marker(F.col("excluded")), "Исключить").when(is_marker(F.col("validation")), "Нужна валидация").when(~has("inn") | ~has("legal"), "Искать ИНН/юрлицо").when(~has("site"), "Искать сайт").when(~has("email") & ~has("phone"), "Искать контакты").otherwise("Готово")


def build_query() -> Column:
    """C9"""
    return F.concat_ws(" ", F.nullif(trim_ws(F.col("brand")), F.lit("")), F.nullif(trim_ws(F.col("segment")), F.lit("")))


def build_queue(icp: DataFrame, bases: tuple[str, ...] = ("https://search.example/?q=",)) -> DataFrame:
    """K6"""
    from ..functions.cells import search_url

    q = build_query()
    return icp.select("row_idx", "brand", "segment", "priority", "status", recommend().alias("next_action"), fill_targets().alias("missing"), q.alias("query"), *[search_url(q, b).alias(f"search_{i + 1}") for i, b in enumerate(bases)])


def select_priority(icp: DataFrame, priority: str, limit: int) -> DataFrame:
    """Rows of the priority in order; a limit of 0 or less takes all."""
    rows = icp.where(F.col("priority") == priority)
    return rows.orderBy("row_idx").limit(limit) if limit > 0 else rows


def top_k(df: DataFrame, column: str, k: int, order: str = "row_idx") -> DataFrame:
    """The most frequent values, ties by first occurrence."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(k)


def icp_summary(icp: DataFrame) -> DataFrame:
    """A3: one row of counters; icp_breakdown() has its lists."""
    has = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    return icp.agg(F.count(F.lit(1)).alias("total"), F.count_if(is_marker(F.col("validation"))).alias("validation"), F.count_if(is_marker(F.col("excluded"))).alias("excluded"), *[has(c).alias(f"with_{c}") for c in ("inn", "site", "email", "phone")])


def icp_breakdown(icp: DataFrame, segments: int = 20) -> DataFrame:
    """A3: (kind, value, n, first_seen): the number of rows of each priority, and the most frequent segments."""
    named = lambda c: icp.where(F.coalesce(trim_ws(F.col(c)), F.lit("")) != "").select("row_idx", trim_ws(F.col(c)).alias("value"))
    priorities = named("priority").groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first_seen"))
    return priorities.select(F.lit("priority").alias("kind"), "*").unionByName(top_k(named("segment"), "value", segments).select(F.lit("segment").alias("kind"), "*"))


def status_counts(df: DataFrame, column: str = "status") -> DataFrame:
    """A2"""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
