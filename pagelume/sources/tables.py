"""Stored tables: page corpora, registries, and tables that are read and replaced at one path."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = "inn string, seller string, status string, seen_count bigint, first_seen_at timestamp, last_seen_at timestamp, last_source string"
HISTORY = "seller_key string, seller string, seen_count bigint, first_source string, last_source string, first_seen_at timestamp, last_seen_at timestamp, skip boolean, display_name string, inn string, status string, brand string"
SAMPLE_COLUMNS = ["sheet", "row_idx", "product", "article", "brand", "seller", "candidate_url", "parse_status", "parse_note"]
#: Columns of a batch that repeat another one where they are absent (not where they are null).
BATCH_ALIASES = {"seller_name": "seller", "nm_id": "article", "row_number": "row_idx", "sheet_name": "sheet", "product_name": "product", "brand_name": "brand", "url": "candidate_url", "status": "parse_status", "note": "parse_note"}


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the class of its paths."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    return path_of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path_of


def recover(spark: SparkSession, path: str) -> None:
    """Where a replacement stopped between its two renames, the table is put back."""
    fs, path_of = file_system(spark, path)
    if fs.exists(path_of(path)):
        return
    left = sorted(x.getPath().toString() for x in fs.globStatus(path_of(f"{path}.old-*")) or [])
    if len(left) > 1:
        raise OSError(f"{path} is missing and has several former versions: {left}")
    if left and not fs.rename(path_of(left[0]), path_of(path)):
        raise OSError(f"{path} could not be put back from {left[0]}")


def load_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table; empty where there is none yet, never where one was being replaced."""
    recover(spark, path)
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def latest_version(spark: SparkSession, target: str) -> str | None:
    """The newest version that commit_version() has completed below `target`."""
    fs, path_of = file_system(spark, target)
    found = sorted(x.getPath().getName() for x in fs.globStatus(path_of(f"{target}/version-*")) or [])
    return f"{target}/{found[-1]}" if found else None


def commit_version(spark: SparkSession, target: str, staged: str) -> str:
    """Makes the folder `staged`, with tables that belong together, the next version in one rename. There is one writer at a
    time. The version before stays for those who read it; older ones and folders of stopped writers go."""
    fs, path_of = file_system(spark, target)
    before = latest_version(spark, target)
    version = f"{target}/version-{int(before.rsplit('-', 1)[1]) + 1 if before else 1:09d}"
    if not fs.rename(path_of(staged), path_of(version)):
        raise OSError(f"{version} could not be made")
    keep = {path_of(v).getName() for v in (before, version) if v}
    for x in [*(fs.globStatus(path_of(f"{target}/version-*")) or []), *(fs.globStatus(path_of(f"{target}/staged-*")) or [])]:
        if x.getPath().getName() not in keep:
            fs.delete(x.getPath(), True)
    return version


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    return load_table(spark, f"{path}/registry", REGISTRY)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    return load_table(spark, f"{path}/history", HISTORY)


def resolve_history_source(tables: dict[str, DataFrame], preferred: tuple[str, ...] = ("inn_registry", "final_enriched"), names: tuple[str, ...] = ("seller", "display_name")) -> str | None:
    """The first table, preferred ones before others, that has a seller column and rows."""
    for name in [*[p for p in preferred if p in tables], *[t for t in tables if t not in preferred]]:
        if set(names) & set(tables[name].columns) and not tables[name].isEmpty():
            return name
    return None


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page corpus; status 200, text/html and not rendered where those columns are absent."""
    pages = spark.read.parquet(path)
    for name, value in (("final_url", F.col("url")), ("status", F.lit(200)), ("content_type", F.lit("text/html")), ("rendered", F.lit(False))):
        if name not in pages.columns:
            pages = pages.withColumn(name, value)
    return pages


def replace_table(df: DataFrame, path: str) -> None:
    """K9: writes beside the target, reads it back whole, then swaps; the target may be df's own source. A swap that stops
    half-way is undone by the next load_table() or replace_table()."""
    spark = df.sparkSession
    staged, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    spark.read.schema(df.schema).parquet(staged).count()  # every file can be read
    fs, path_of = file_system(spark, path)
    recover(spark, path)
    if fs.exists(path_of(path)):
        fs.rename(path_of(path), path_of(old))
    if not fs.rename(path_of(staged), path_of(path)):
        if fs.exists(path_of(old)):
            fs.rename(path_of(old), path_of(path))
        raise OSError(f"{path} could not be replaced")
    if fs.exists(path_of(old)):
        fs.delete(path_of(old), True)


def save_registry(registry: DataFrame, imports: DataFrame, path: str) -> None:
    """K4: the registry replaced, its import log appended to."""
    replace_table(registry, f"{path}/registry")
    imports.write.mode("append").parquet(f"{path}/imports")


def save_history(history: DataFrame, imports: DataFrame, path: str) -> None:
    replace_table(history, f"{path}/history")
    imports.write.mode("append").parquet(f"{path}/history_imports")


def sample_table(rows: DataFrame) -> DataFrame:
    """K1: the nine columns in their order, absent ones null."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in SAMPLE_COLUMNS])


def write_sample(rows: DataFrame, path: str) -> None:
    sample_table(rows).write.mode("overwrite").parquet(path)


def to_batch_schema(rows: DataFrame) -> DataFrame:
    """K2: with the alias columns."""
    return rows.select("*", *[F.col(orig).alias(alias) for alias, orig in BATCH_ALIASES.items() if alias not in rows.columns and orig in rows.columns])


def write_json(rows: DataFrame, path: str) -> None:
    """K8: one JSON document a row."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def growing(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never sent whole to the driver and to all executors. The planner goes by file sizes, which
    say little of well compressed columns and of what is made from them, so it takes tables of any length for small ones."""
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the cluster's shared folder: later jobs read it and don't plan or make it again. Where no folder is
    set: a temporary one in local mode (tests), else an error, since executors wouldn't see a folder of the driver."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not where and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="spark-shared-"))
    return df.checkpoint()
