"""Seller history at full width: which sellers were seen in which files, with first and last values, as an ordered fold.

A file counts a seller once, by its first row; files follow each other in their order. The fold is an aggregate: first and
last filled values by (file_ord), sums, and disjunctions. So a seller of very many files is one row for each task before the
shuffle, and no row waits for another one.

Rows are results of batches or of registries, with `file`, `file_ord`, `row_idx`, a category, and those of the columns
named below that they have; columns that they lack count as empty. Empty is null or ''.

Defined cases: rows without a seller only count in the metrics; a history that repeats a key keeps its first row by
first_seen_at, then by the rest; repeated rows of a file count once; an empty batch leaves the history as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import norm_inn, norm_key, to_int
from .outcomes import skip_recommended
from .registry import mark_duplicates

SELLER_HISTORY = (
    "seller_key string, first_seller_name_raw string, last_seller_name_raw string, seller_display_name string, seller_url string, entity_type string, inn string, "
    "ogrn string, ogrnip string, first_parse_status string, last_parse_status string, first_note string, last_note string, skip_recommended boolean, seen_count long, "
    "first_seen_at string, last_seen_at string, first_source_batch string, last_source_batch string, first_category string, last_category string"
)
COLUMNS = tuple(c.split()[0] for c in SELLER_HISTORY.split(", "))
#: Where a value is looked for, in this order. Names of columns of the result files.
SOURCES = {
    "key": ("marketguru_seller_name", "seller_name_raw", "wb_seller_name", "first_seller_name_raw", "last_seller_name_raw", "seller_display_name"),
    "name": ("marketguru_seller_name", "seller_name_raw", "last_seller_name_raw", "first_seller_name_raw"),
    "seller_display_name": ("wb_seller_name", "seller_display_name"),
    "seller_url": ("wb_seller_url", "seller_url"),
    "entity_type": ("entity_type",),
    "inn": ("inn",),
    "ogrn": ("ogrn",),
    "ogrnip": ("ogrnip",),
    "status": ("parse_status", "last_parse_status", "first_parse_status"),
    "note": ("parse_note", "note", "last_note", "first_note"),
    "own_status": ("parse_status",),
    "own_count": ("seen_count",),
    "first_seen": ("first_seen_at",),
    "last_seen": ("last_seen_at", "first_seen_at"),
    "first_source": ("first_source_batch",),
    "last_source": ("last_source_batch",),
    "first_category": ("first_category",),
    "last_category": ("last_category", "first_category"),
}
#: Attributes of which the last filled value stays.
LATEST = ("seller_display_name", "seller_url", "entity_type", "inn", "ogrn", "ogrnip")
#: Attributes with a first and a last column.
PAIRS = {"name": "seller_name_raw", "status": "parse_status", "note": "note"}


def filled(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def seller_rows(batch: DataFrame, category: Column) -> DataFrame:
    """The rows of a batch under the names of SOURCES, with seller_key ('' where there is none) and skip."""
    have = {c.lower() for c in batch.columns}
    pick = lambda names: F.coalesce(*[filled(F.col(n)) for n in names if n in have], F.lit(None).cast("string"))
    rows = batch.select("file", "file_ord", "row_idx", filled(category).alias("category"), *[pick(names).alias(k) for k, names in SOURCES.items()])
    count = F.greatest(to_int(F.col("own_count"), 1), F.lit(1)).cast("long")
    return rows.select(
        "file", "file_ord", "row_idx", F.coalesce(norm_key(F.col("key")), F.lit("")).alias("seller_key"), "name", "status", "note", *[c for c in LATEST if c != "inn"],
        norm_inn(F.col("inn")).alias("inn"), count.alias("n"), skip_recommended(norm_inn(F.col("inn")), F.col("own_status")).alias("skip"), "first_seen", "last_seen",
        F.coalesce("first_source", "file").alias("first_source"), F.coalesce("last_source", "file").alias("last_source"),
        F.coalesce("first_category", "category").alias("first_category"), F.coalesce("last_category", "category").alias("last_category"),
    )


def counted_once(rows: DataFrame) -> DataFrame:
    """The row of each seller and file that counts: the first one."""
    return mark_duplicates(rows, F.col("seller_key")).where("in_file = 1").drop("key")


def fold(rows: DataFrame, imported_at: str) -> DataFrame:
    """History columns of new rows, one for each seller; times are strings and imported_at stands where a row has none."""
    at = F.lit(imported_at)
    first = lambda c, name: F.min_by(F.when(c.isNotNull(), c), F.when(c.isNotNull(), F.col("file_ord"))).alias(name)
    last = lambda c, name: F.max_by(F.when(c.isNotNull(), c), F.when(c.isNotNull(), F.col("file_ord"))).alias(name)
    edge = lambda c, name, by: by(c, "file_ord").alias(name)
    pairs = [how(F.col(c), f"{side}_{name}") for c, name in PAIRS.items() for side, how in (("first", first), ("last", last))]
    made = rows.groupBy("seller_key").agg(
        *pairs, *[last(F.col(c), c) for c in LATEST], F.bool_or("skip").alias("skip_recommended"), F.sum("n").alias("seen_count"),
        edge(F.coalesce("first_seen", at), "first_seen_at", F.min_by), edge(F.coalesce("last_seen", at), "last_seen_at", F.max_by),
        edge(F.col("first_source"), "first_source_batch", F.min_by), edge(F.col("last_source"), "last_source_batch", F.max_by),
        first(F.col("first_category"), "first_category"), edge(F.col("last_category"), "last_category", F.max_by),
    )
    return made.select(*COLUMNS)


def normalized(history: DataFrame) -> DataFrame:
    """A stored history: keys and numbers normalised, the first row of each key."""
    rows = history.select(
        *[{"seller_key": F.coalesce(norm_key(F.col("seller_key")), F.lit("")), "inn": norm_inn(F.col("inn")), "seen_count": F.coalesce("seen_count", F.lit(1)).cast("long"), "skip_recommended": F.coalesce("skip_recommended", F.lit(False))}.get(c, filled(F.col(c))).alias(c) for c in COLUMNS]
    ).where("seller_key <> ''")
    rest = [c for c in COLUMNS if c != "seller_key"]
    order = F.struct("first_seen_at", *[c for c in rest if c != "first_seen_at"])
    return rows.groupBy("seller_key").agg(F.min_by(F.struct(*rest), order).alias("h")).select("seller_key", "h.*")


def update_history(history: DataFrame, batch: DataFrame, category: Column, imported_at: str) -> DataFrame:
    """The history after a batch or a registry: first values stay where they are filled, last ones follow the files,
    counts add up, skip flags are OR-ed; a row's own times, sources, counts and categories take precedence over the import's."""
    news = fold(counted_once(seller_rows(batch, category)), imported_at)
    joined = normalized(history).alias("o").join(news.alias("n"), "seller_key", "full_outer")
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    seen = n("seen_count").isNotNull()

    def value(c: str) -> Column:
        if c == "seller_key":
            return F.col(c)
        if c == "seen_count":
            return F.coalesce(o(c), F.lit(0)) + F.coalesce(n(c), F.lit(0))
        if c == "skip_recommended":
            return F.coalesce(o(c), F.lit(False)) | F.coalesce(n(c), F.lit(False))
        if c == "last_category":
            return F.when(seen, n(c)).otherwise(o(c))
        return F.coalesce(o(c), n(c)) if c.startswith("first_") else F.coalesce(n(c), o(c))

    return joined.select(*[value(c).alias(c) for c in COLUMNS])


def history_metrics(history: DataFrame, batch: DataFrame) -> DataFrame:
    """A7 of the history, by file: rows_total = with_seller + skipped_without_seller, with_seller = new + known + duplicate.
    A seller that is new in one file is known in the next."""
    rows = seller_rows(batch, F.lit(None).cast("string"))
    had = normalized(history).select(F.col("seller_key").alias("key"), F.lit(True).alias("had"))
    marked = mark_duplicates(rows.select("file", "file_ord", "row_idx", "seller_key", "skip"), F.col("seller_key")).join(had, "key", "left")
    some, once = F.col("key") != "", F.col("in_file") == 1
    fresh = F.col("had").isNull() & (F.col("file_nth") == 1)
    tests = {
        "rows_with_seller": some, "unique_seller_in_file": once, "new_seller_added": once & fresh, "already_known": once & ~fresh,
        "duplicate_in_file": F.col("in_file") > 1, "skipped_without_seller": ~some, "skip_recommended_in_file": once & F.col("skip"),
    }
    return marked.groupBy("file").agg(F.count(F.lit(1)).alias("rows_total"), *[F.count_if(t).alias(k) for k, t in tests.items()])


def history_log(metrics: DataFrame, categories: Column, imported_at: str) -> DataFrame:
    """A line of the import log for each file."""
    return metrics.select(F.lit(imported_at).alias("imported_at"), F.col("file").alias("source_batch_file"), categories.alias("category"), *[c for c in metrics.columns if c != "file"])


def seller_sheet(sheets: list[tuple[str, DataFrame]]) -> tuple[str, DataFrame]:
    """The sheet of a workbook that holds sellers: `inn_registry`, then `final_enriched`, then the others in order; the first
    with rows and a column of seller names. Raises ValueError where there is none."""
    preferred = ("inn_registry", "final_enriched")
    order = [*[s for name in preferred for s in sheets if s[0] == name], *[s for s in sheets if s[0] not in preferred]]
    names = {"seller_name_raw", "marketguru_seller_name", "first_seller_name_raw", "last_seller_name_raw"}
    found = next(((name, rows) for name, rows in order if names & set(rows.columns) and not rows.isEmpty()), None)
    if found is None:
        raise ValueError("no sheet with sellers")
    return found


def history_totals(metrics: DataFrame) -> DataFrame:
    """The sums over all files."""
    names = [c for c in metrics.columns if c != "file"]
    return metrics.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names], F.count(F.lit(1)).alias("files"))
