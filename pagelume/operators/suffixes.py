"""Registered domains by a table of public suffixes: ordinary rules, wildcards and exceptions, the longest rule first.

A table of rules is one rule a row, as the public list writes them: `co.uk`, `*.ck`, `!www.ck`; lines of comments and blank ones
are no rules. Without a rule for a host its last label is the suffix. A host that is itself a suffix, or an address, has no
registered domain.

Scale: hosts are made distinct before they meet the rules, each with one row for each of its label suffixes, and rules are
joined by equality, so the table may have any size. Pages meet their host's domain by a join on the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import trim_ws
from ..functions.urls import bare_host


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule) of a text file in the public list's form."""
    return rules_of(spark.read.text(path).select(F.col("value").alias("rule")))


def rules_of(lines: DataFrame) -> DataFrame:
    """(labels, kind) of rules: what stands after a mark, and whether it is plain, a wildcard or an exception."""
    rule = F.lower(F.regexp_extract(trim_ws(F.col("rule")), r"^(\S+)", 1))
    kind = F.when(F.startswith("rule", F.lit("!")), "exception").when(F.startswith("rule", F.lit("*.")), "wildcard").otherwise("plain")
    rows = lines.select(rule.alias("rule")).where("rule <> '' and not startswith(rule, '//')")
    return rows.select(F.regexp_replace("rule", r"^(?:!|\*\.)", "").alias("labels"), kind.alias("kind")).distinct()


def host_domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, suffix, domain) of distinct lower-case hosts (host)."""
    one = hosts.select("host").where("host <> ''").distinct().withColumn("labels", F.split("host", r"\."))
    n = F.size("labels")
    tails = one.select("host", "labels", F.explode(F.sequence(F.lit(1), n)).alias("k")).withColumn("tail", F.array_join(F.slice("labels", -F.col("k"), F.col("k")), "."))
    met = tails.join(rules.withColumnRenamed("labels", "tail"), "tail")
    # the number of labels of the suffix that a rule gives: an exception takes one label off, a wildcard adds one
    size = F.when(F.col("kind") == "exception", F.col("k") - 1).when(F.col("kind") == "wildcard", F.col("k") + 1).otherwise(F.col("k"))
    met = met.select("host", size.alias("size"), (F.col("kind") == "exception").cast("int").alias("exception")).join(one.select("host", n.alias("n")), "host").where("size <= n")
    best = met.groupBy("host").agg(F.max(F.struct("exception", "size")).alias("b"))
    sized = one.join(best, "host", "left").withColumn("size", F.coalesce("b.size", F.lit(1)))
    last = lambda k: F.array_join(F.slice("labels", -k, k), ".")
    address = F.col("host").rlike(r"^\d+(?:\.\d+){3}$") | F.contains("host", F.lit(":"))
    domain = F.when((F.size("labels") > F.col("size")) & ~address, last(F.col("size") + 1))
    return sized.select("host", F.when(~address, last(F.col("size"))).alias("suffix"), domain.alias("domain"))


def with_domain(rows: DataFrame, url: Column, rules: DataFrame) -> DataFrame:
    """Rows with the registered domain of an address; null without a host, for a bare suffix and for numeric hosts."""
    keyed = rows.withColumn("_host", F.regexp_replace(bare_host(url), r"\.+$", ""))
    found = host_domains(keyed.select(F.col("_host").alias("host")), rules).select(F.col("host").alias("_host"), "domain")
    return keyed.drop("domain").join(found, "_host", "left").drop("_host")
