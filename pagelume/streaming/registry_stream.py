"""Continuous maintenance of registry and history from arriving result files, and page signals on a stream of pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.cells import norm_inn
from ..operators.pages import Terms, page_signals
from ..operators.registry import HISTORY_ATTRIBUTES, import_metrics, upsert_history, upsert_registry
from ..sources.tables import HISTORY, REGISTRY, commit_version, exists, latest_version, load_table


def load_state(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Registry, history and import log of the last complete import; no log before the first one."""
    now = latest_version(spark, target)
    registry, history = (load_table(spark, f"{now}/{name}", schema) if now else spark.createDataFrame([], schema) for name, schema in (("registry", REGISTRY), ("history", HISTORY)))
    return registry, history, spark.read.parquet(f"{now}/imports") if now and exists(spark, f"{now}/imports") else None


def apply_files(spark: SparkSession, batch: DataFrame, target: str, imported_at: str) -> None:
    """One import. Registry, history and the log of imported files are one version that appears in one rename, and files that
    the log names are left out: however often a batch is delivered and wherever an import stops, each file counts once."""
    registry, history, log = load_state(spark, target)
    if log is not None:
        batch = batch.join(log.select("file").distinct(), "file", "left_anti")
    for name in HISTORY_ATTRIBUTES:
        if name not in batch.columns:
            batch = batch.withColumn(name, F.lit(None).cast("string"))
    staged = f"{target}/staged-{uuid.uuid4().hex}"
    batch.write.parquet(f"{staged}/batch")  # the batch is read once, then from here
    batch = spark.read.parquet(f"{staged}/batch")
    if batch.isEmpty():
        return
    metrics = import_metrics(batch, registry, norm_inn(F.col("inn"))).withColumn("imported_at", F.to_timestamp(F.lit(imported_at)))
    upsert_registry(registry, batch, imported_at).write.parquet(f"{staged}/registry")
    upsert_history(history, batch, imported_at).write.parquet(f"{staged}/history")
    (metrics if log is None else log.unionByName(metrics)).write.parquet(f"{staged}/imports")
    commit_version(spark, target, staged)


def stream_registry(spark: SparkSession, in_dir: str, target: str, checkpoint: str, schema: str, imported_at: str) -> StreamingQuery:
    """Every new Parquet file below in_dir (file, file_ord, row_idx, inn, seller, status) goes into registry and history once."""
    files = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(in_dir)
    return files.writeStream.foreachBatch(lambda df, _: apply_files(df.sparkSession, df, target, imported_at)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_signals(pages: DataFrame, terms: Terms = Terms()) -> DataFrame:
    """R2: the page signal vector of a streaming DataFrame of pages."""
    return page_signals(pages, terms)
