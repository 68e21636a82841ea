"""Entity registry and viewing history: deduplication, import metrics, upserts, merges, indexes, routing, enrichment.

Batches have (file, file_ord, row_idx, ...). Orders are explicit columns; times of import are arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cells import norm_inn, norm_key
from .outcomes import skip_recommended


def first_wins(df: DataFrame, key: Column, order: list, keep_blank: bool) -> DataFrame:
    """The first row of each key; blank keys are all kept or all dropped, and never gathered in one window."""
    keyed = df.withColumn("_k", F.coalesce(key, F.lit("")))
    some = keyed.where("_k <> ''").withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).where("_n = 1").drop("_n", "_k")
    return some.unionByName(keyed.where("_k = ''").drop("_k")) if keep_blank else some


def mark_duplicates(batch: DataFrame, key: Column) -> DataFrame:
    """Key; in_file: the row's number among its file's rows of the key; file_nth: the number of the file among the key's files."""
    keyed = batch.withColumn("key", F.coalesce(key, F.lit("")))
    some = keyed.where("key <> ''")
    own = Window.partitionBy("key", "file_ord").orderBy("row_idx")
    files = Window.partitionBy("key").orderBy("file_ord")
    some = some.withColumn("in_file", F.row_number().over(own)).withColumn("file_nth", F.dense_rank().over(files))
    none = F.lit(None).cast("int")
    return some.unionByName(keyed.where("key = ''").withColumn("in_file", none).withColumn("file_nth", none))


def import_metrics(batch: DataFrame, registry: DataFrame, key: Column) -> DataFrame:
    """By file, total = with_key + skipped and with_key = new + known + duplicate. A key that is new in one file is known in the next."""
    marked = mark_duplicates(batch.select("file", "file_ord", "row_idx", key.alias("raw")), F.col("raw")).join(registry.select(F.col("inn").alias("key"), F.lit(True).alias("had")).distinct(), "key", "left")
    survivor = F.col("in_file") == 1
    fresh = F.col("had").isNull() & (F.col("file_nth") == 1)
    return marked.groupBy("file").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("key") != "").alias("with_key"),
        F.count_if(survivor).alias("unique_keys"),
        F.count_if(survivor & fresh).alias("new"),
        F.count_if(survivor & ~fresh).alias("known"),
        F.count_if(F.col("in_file") > 1).alias("duplicate"),
        F.count_if(F.col("key") == "").alias("skipped"),
    )


def import_totals(metrics: DataFrame) -> DataFrame:
    """The metrics of each file and, with file null, their sums."""
    names = [c for c in metrics.columns if c != "file"]
    return metrics.rollup("file").agg(*[F.sum(c).alias(c) for c in names])


def upsert_registry(registry: DataFrame, batch: DataFrame, imported_at: str) -> DataFrame:
    """A new key takes its first row; a known one only counts the files that have it and keeps the last source and time.

    registry: inn, seller, status, seen_count, first_seen_at, last_seen_at, last_source."""
    marked = mark_duplicates(batch, norm_inn(F.col("inn"))).where("in_file = 1")
    at = F.to_timestamp(F.lit(imported_at))
    news = marked.groupBy("key").agg(F.min_by(F.struct("seller", "status"), "file_ord").alias("first"), F.count(F.lit(1)).alias("files"), F.max_by("file", "file_ord").alias("source"))
    old = registry.select(F.col("inn").alias("key"), F.struct("seller", "status", "seen_count", "first_seen_at", "last_seen_at", "last_source").alias("old"))
    joined = old.join(news, "key", "full_outer")
    known, seen = F.col("old").isNotNull(), F.col("files").isNotNull()
    return joined.select(
        F.col("key").alias("inn"),
        F.when(known, F.col("old.seller")).otherwise(F.col("first.seller")).alias("seller"),
        F.when(known, F.col("old.status")).otherwise(F.col("first.status")).alias("status"),
        (F.coalesce("old.seen_count", F.lit(0)) + F.coalesce("files", F.lit(0))).cast("long").alias("seen_count"),
        F.when(known, F.col("old.first_seen_at")).otherwise(at).alias("first_seen_at"),
        F.when(seen, at).otherwise(F.col("old.last_seen_at")).alias("last_seen_at"),
        F.when(seen, F.col("source")).otherwise(F.col("old.last_source")).alias("last_source"),
    )


def new_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """D11"""
    return after.select("inn").join(before.select("inn"), "inn", "left_anti")


HISTORY_ATTRIBUTES = ("display_name", "inn", "status", "brand")


def history_rows(batch: DataFrame) -> DataFrame:
    """One row for each seller of the batches, of which a file counts once, by its first row: first and last non-empty
    values in order of the files, counts, skip flag."""
    ord_ = F.struct("file_ord", "row_idx")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rows = mark_duplicates(batch, norm_key(F.col("seller"))).where("in_file = 1").withColumnRenamed("key", "seller_key")
    count = F.sum("view_count") if "view_count" in batch.columns else F.count(F.lit(1))
    last = lambda c: F.max_by(F.when(filled(c), F.col(c)), F.when(filled(c), ord_)).alias(c)
    return rows.groupBy("seller_key").agg(
        F.min_by("seller", ord_).alias("seller"),
        count.cast("long").alias("seen_count"),
        F.min_by("file", ord_).alias("first_source"),
        F.max_by("file", ord_).alias("last_source"),
        F.bool_or(skip_recommended(norm_inn(F.col("inn")), F.col("status"))).alias("skip"),
        *[last(c) for c in HISTORY_ATTRIBUTES],
    )


def merge_history(old: DataFrame, news: DataFrame, imported_at: str | None) -> DataFrame:
    at = F.to_timestamp(F.lit(imported_at)) if imported_at else F.col("n.last_seen_at")
    start = F.to_timestamp(F.lit(imported_at)) if imported_at else F.col("n.first_seen_at")
    joined = old.alias("o").join(news.alias("n"), "seller_key", "full_outer")
    seen = F.col("n.seen_count").isNotNull()
    newer = lambda c: F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}")).alias(c)
    older = lambda c: F.coalesce(F.nullif(F.col(f"o.{c}"), F.lit("")), F.col(f"n.{c}")).alias(c)
    return joined.select(
        "seller_key",
        older("seller"),
        (F.coalesce("o.seen_count", F.lit(0)) + F.coalesce("n.seen_count", F.lit(0))).cast("long").alias("seen_count"),
        older("first_source"),
        newer("last_source"),
        F.coalesce(F.col("o.first_seen_at"), F.when(seen, start)).alias("first_seen_at"),
        F.when(seen, F.coalesce(at, F.col("o.last_seen_at"))).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"),
        (F.coalesce("o.skip", F.lit(False)) | F.coalesce("n.skip", F.lit(False))).alias("skip"),
        *[newer(c) for c in HISTORY_ATTRIBUTES],
    )


def upsert_history(history: DataFrame, batch: DataFrame, imported_at: str) -> DataFrame:
    """Counts add up, last values win where they aren't empty, first ones stay, skip flags are OR-ed."""
    return merge_history(history, history_rows(batch), imported_at)


def import_history(history: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows as history; their own times, sources and counts take precedence over those of the import."""
    rows = registry.select(
        norm_key(F.col("seller")).alias("seller_key"), "seller", "seen_count", F.col("last_source").alias("source"), "first_seen_at", "last_seen_at", "inn", "status"
    ).where("seller_key <> ''")
    ord_ = F.struct("last_seen_at", "inn")
    news = rows.groupBy("seller_key").agg(
        F.min_by("seller", ord_).alias("seller"), F.sum("seen_count").alias("seen_count"), F.min_by("source", ord_).alias("first_source"), F.max_by("source", ord_).alias("last_source"),
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.bool_or(skip_recommended(F.col("inn"), F.col("status"))).alias("skip"),
        F.max_by("seller", ord_).alias("display_name"), F.max_by("inn", ord_).alias("inn"), F.max_by("status", ord_).alias("status"), F.lit(None).cast("string").alias("brand"),
    )
    return merge_history(history, news, None)


def merge_registries(primary: DataFrame, secondary: DataFrame, key: str, order: str) -> DataFrame:
    """The primary's rows win; the secondary adds keys that are new; blank keys are dropped; counts aren't summed."""
    one = lambda df: first_wins(df, norm_key(F.col(key)), [order], keep_blank=False).withColumn("_k", norm_key(F.col(key)))
    p, s = one(primary), one(secondary)
    return p.unionByName(s.join(p.select("_k"), "_k", "left_anti").select(p.columns)).drop("_k")


def merge_metrics(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Counters of both sides, their overlap and the merged size."""
    both = primary.select(norm_key(F.col(key)).alias("k"), F.lit(1).alias("p"), F.lit(0).alias("s")).unionByName(secondary.select(norm_key(F.col(key)).alias("k"), F.lit(0).alias("p"), F.lit(1).alias("s")))
    by_key = both.groupBy("k").agg(F.sum("p").alias("p"), F.sum("s").alias("s"))
    has = lambda c: F.coalesce(F.sum(c), F.lit(0))
    some = F.col("k") != ""
    when = lambda test, v: F.when(test, v).otherwise(0)
    return by_key.agg(
        has("p").alias("primary_rows"), has("s").alias("secondary_rows"),
        has(when(~some, F.col("p"))).alias("primary_blank"), has(when(~some, F.col("s"))).alias("secondary_blank"),
        F.count_if(some & (F.col("p") > 0)).alias("primary_keys"), F.count_if(some & (F.col("s") > 0)).alias("secondary_keys"),
        has(when(some & (F.col("p") > 1), F.col("p") - 1)).alias("primary_duplicates"), has(when(some & (F.col("s") > 1), F.col("s") - 1)).alias("secondary_duplicates"),
        F.count_if(some & (F.col("p") > 0) & (F.col("s") > 0)).alias("overlap"), F.count_if(some & (F.col("p") == 0)).alias("added"),
        F.count_if(some & (F.col("s") == 0)).alias("primary_only"), F.count_if(some).alias("merged_keys"),
    )


def append_imports(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both logs without rows that are null or '' throughout."""
    both = a.unionByName(b, allowMissingColumns=True)
    blank = F.forall(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in both.columns]), lambda x: x == "")
    return both.where(~blank)


def seller_index(registry: DataFrame) -> DataFrame:
    """Both names of each row as keys, the first row of a key."""
    keys = registry.select("*", F.posexplode(F.array(norm_key(F.col("seller")), norm_key(F.col("display_name")))).alias("field_ord", "seller_key")).where("seller_key <> ''")
    nth = F.row_number().over(Window.partitionBy("seller_key").orderBy("row_idx", "field_ord"))
    return keys.withColumn("_n", nth).where("_n = 1").select("seller_key", "row_idx", "inn")


def skip_index(history: DataFrame) -> DataFrame:
    """D10"""
    return history.where("skip").select("seller_key", F.col("last_source").alias("source")).dropDuplicates(["seller_key"])


def known_sources(registry_keys: DataFrame, history_keys: DataFrame) -> DataFrame:
    """(seller_key, source): the registry overrides the history."""
    both = registry_keys.select("seller_key", F.lit(0).alias("o")).unionByName(history_keys.select("seller_key", F.lit(1).alias("o")))
    return both.groupBy("seller_key").agg(F.when(F.min("o") == 0, "registry").otherwise("history").alias("source"))


def exclude_known(listing: DataFrame, keys: DataFrame) -> DataFrame:
    """Without sellers of `keys` (seller_key); blank sellers stay."""
    keyed = listing.withColumn("seller_key", norm_key(F.col("seller")))
    return keyed.join(keys.where("seller_key <> ''").select("seller_key").distinct(), "seller_key", "left_anti").drop("seller_key")


def route_known(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Each listing row with its route: SKIPPED_KNOWN, SKIPPED_VIEWED or PROCESS."""
    keyed = listing.withColumn("seller_key", norm_key(F.col("seller")))
    joined = keyed.join(known.where("seller_key <> ''"), "seller_key", "left")
    return joined.withColumn("route", F.when(F.col("source") == "registry", "SKIPPED_KNOWN").when(F.col("source") == "history", "SKIPPED_VIEWED").otherwise("PROCESS")).drop("source")


def route_metrics(routed: DataFrame) -> DataFrame:
    """A13"""
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def filter_effect(before: DataFrame, after: DataFrame, warn_above: float = 0.75) -> DataFrame:
    """One row: sizes, excluded rows, and a warning where more than the share is gone."""
    both = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(F.lit(0).alias("b"), F.lit(1).alias("a")))
    n = both.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("before"), F.coalesce(F.sum("a"), F.lit(0)).alias("after"))
    gone = F.col("before") - F.col("after")
    return n.select("before", "after", gone.alias("excluded"), ((F.col("before") > 0) & (gone > warn_above * F.col("before"))).alias("warning"))


def enrich(batch: DataFrame, external: DataFrame, prefix: str) -> DataFrame:
    """Batch rows with the first external row of their key, whether there is one, and how many there are.

    external: inn, row_idx and any columns, which get the prefix. Keys are aggregated before the join, so batch rows never multiply."""
    names = [c for c in external.columns if c not in ("inn", "row_idx")]
    ext = external.withColumn("_k", norm_inn(F.col("inn"))).where("_k is not null").groupBy("_k").agg(F.min_by(F.struct(*names), "row_idx").alias("_e"), F.count(F.lit(1)).alias("_n"))
    joined = batch.withColumn("_k", norm_inn(F.col("inn"))).join(ext, "_k", "left")
    return joined.select(*batch.columns, F.col("_n").isNotNull().alias("match_found"), F.coalesce("_n", F.lit(0)).cast("long").alias("match_count"), *[F.col(f"_e.{c}").alias(f"{prefix}{c}") for c in names])


def match_rate(enriched: DataFrame) -> DataFrame:
    """A10"""
    return enriched.agg(F.count(F.lit(1)).alias("rows"), F.count_if("match_found").alias("matched"), F.avg(F.col("match_found").cast("double")).alias("rate"))


def unique_inn(batch: DataFrame) -> DataFrame:
    """Each tax number with the place and names of its first occurrence."""
    keyed = batch.withColumn("inn", norm_inn(F.col("inn"))).where("inn is not null")
    return keyed.groupBy("inn").agg(F.min_by(F.struct("file", "row_idx", "seller"), F.struct("file_ord", "row_idx")).alias("f"), F.count(F.lit(1)).alias("n")).select("inn", "f.file", "f.row_idx", "f.seller", "n")


def no_inn(batch: DataFrame) -> DataFrame:
    """P2"""
    return batch.where(norm_inn(F.col("inn")).isNull())


def unmatched(enriched: DataFrame) -> DataFrame:
    """P3"""
    return enriched.where(~F.col("match_found"))


def attach_audit(source: DataFrame, results: DataFrame) -> DataFrame:
    """Result columns before the source's, by row_idx; of several results the last; unmatched rows keep nulls."""
    names = [c for c in results.columns if c not in ("row_idx", "position")]
    last = results.groupBy("row_idx").agg(F.max_by(F.struct(*names), "position").alias("r"))
    return source.join(last, "row_idx", "left").select(*[F.col(f"r.{c}").alias(f"audit_{c}") for c in names], *source.columns)
