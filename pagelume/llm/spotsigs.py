"""Operator 4: SpotSigs fingerprints, in DataFrame functions only.

A signature is a common word (the anchor) with the chain of the content words that follow it. In every text, content words
whose hash is 0 modulo 8 are anchors of their own, so passages without common words have signatures too. A fingerprint is
the sorted set of 32-bit signature hashes, written as hexadecimal.

Comparison: sets are partitioned by length, in steps of the least likeness that counts, so that sets which are more than
one partition apart are never compared; of the others, those are dropped whose lengths or whose prefixes (of which any
two similar sets share a signature) rule that likeness out, and the rest have their Jaccard likeness. spot_join() is this
self-join with classes and numbers of links; no query runs it. The query's pairs are given, and it reports the likeness of
each; further columns tell the length partition and whether the join would have pruned the pair.

Scale: keys of texts (ids and hashes) are ordered by Spark's range partitioning and numbered within its partitions. The
numbers send each text once to a cell of CELL_ROWS neighbours, and the first one of a cell to the cell before it too, so a
row finds its successor in a window over its cell. Cells are even however the ids lie. One row for each partition of the
order is looked at together, a number that the session sets. In spot_join() prefixes take the rarest signatures first.

Defined cases: null text is empty and has the empty fingerprint; a text without words has the hash of the whole text; two
empty fingerprints have likeness 1, an empty and another one 0; ids are of any orderable type; rows that repeat an id are
ordered by a hash of their text; null ids come last; repeated rows follow each other; the only row follows itself; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import connected_components
from .native import let
from .store import Scratch, table

#: Common words of the four languages that open a chain.
ANCHORS = tuple(
    (
        "the a an of to and in is it that was for on are as with be at this by from have or had not but "
        "le la les de des du un une et en que qui est dans pour par sur au aux avec "
        "der die das und in zu den von mit ist des dem ein eine nicht auf für sich "
        "el los las del y que una con por para su al lo como se no"
    ).split()
)
CELL_ROWS = 2_000
#: Likeness from which texts are near copies.
ALIKE = 0.8


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS) -> Column:
    """Sorted distinct 32-bit signature hashes (as bigint) of a text."""
    stop = "|".join(sorted(set(anchors), key=lambda w: (-len(w), w)))
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    joined = F.regexp_replace(spaced, f"(?<= )({stop}) (?=[^ ])(?!(?:{stop}) )", "$1:")
    plain = F.regexp_replace(joined, f"(?<= )(?:{stop}) ", "")
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))

    def chains(t: Column) -> Column:
        content = F.transform(t, lambda x: F.substring_index(x, ":", -1))

        def each(c: Column) -> Column:
            # an anchor and two content words; a content word that is its own anchor likewise
            sig = lambda x, i: F.when(F.contains(x, F.lit(":")), F.xxhash64(x, F.get(c, i + 1))).when(F.xxhash64(F.get(c, i)).bitwiseAND(F.lit(7).cast("long")) == 0, F.xxhash64(x, F.get(c, i + 1), F.get(c, i + 2)))
            return F.filter(F.transform(t, sig), lambda h: h.isNotNull())

        return let(content, each)

    found = let(F.btrim(plain), lambda p: F.when(p == "", F.array().cast("array<bigint>")).otherwise(let(F.split(p, " +"), chains)))
    whole = F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(text)))
    return let(found, lambda a: F.sort_array(F.array_distinct(F.transform(F.when(F.size(a) > 0, a).otherwise(whole), low))))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(let(both, lambda n: n / (F.size(a) + F.size(b) - n)))


def part_of(n: Column, threshold: float) -> Column:
    """Partition of a set of n signatures: sets that can be alike lie in the same one or in neighbouring ones."""
    return F.when(n > 0, F.floor(F.log(n.cast("double")) / -math.log(threshold)))


def prefix_length(n: Column, threshold: float) -> Column:
    """So many signatures of a set, the first ones in a common order, hold one of any set that is alike."""
    return n - F.ceil(n * threshold - 1e-9).cast("int") + 1


def pruned_likeness(a: Column, b: Column, threshold: float) -> Column:
    """Struct (likeness, pruned) of two sets; likeness under the threshold is 0, and is pruned where the comparison was spared."""
    m, n = F.size(a), F.size(b)
    apart = (F.abs(part_of(m, threshold) - part_of(n, threshold)) > 1) | (F.least(m, n) < F.greatest(m, n) * threshold - 1e-9)
    start = lambda x, k: F.slice(x, F.lit(1), F.greatest(F.lit(1), prefix_length(k, threshold)))
    made = lambda x, pruned: F.struct(x.cast("double").alias("likeness"), F.lit(pruned).alias("pruned"))
    return (
        F.when((m == 0) | (n == 0), made(F.when(m == n, 1.0).otherwise(0.0), False))
        .when(apart, made(F.lit(0.0), True))
        .when(~F.arrays_overlap(start(a, m), start(b, n)), made(F.lit(0.0), True))
        .otherwise(made(let(likeness(a, b), lambda x: F.when(x >= threshold, x).otherwise(0.0)), False))
    )


def spot_join(spark: SparkSession, docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id, n_links: the least id of the connected class of alike fingerprints, and other rows at the threshold."""
    scratch = Scratch(spark, "spots")
    sets = scratch.table(docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("s")), "sets")
    nodes = scratch.table(sets.groupBy("s").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("many")).withColumn("node", F.sha2(F.array_join("s", " "), 256)), "nodes")
    n = F.size("s")
    each = nodes.where(n > 0).select("node", n.alias("n"), F.explode("s").alias("h"))
    often = scratch.table(each.groupBy("h").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    # signatures of one set only lead to nothing: they take their places in the prefix unseen
    ranked = each.join(often, "h").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("often", "h"))).alias("r"))
    unseen = F.col("n") - F.size("r")
    index = ranked.select("node", "n", part_of(F.col("n"), threshold).alias("part"), F.explode(F.slice("r", F.lit(1), F.greatest(F.lit(0), prefix_length(F.col("n"), threshold) - unseen))).alias("x"))
    index = scratch.table(index.select("node", "n", "part", "x.h"), "index")
    probe = index.select(F.col("node").alias("a"), F.col("n").alias("an"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), "h")
    other = index.select(F.col("node").alias("b"), F.col("n").alias("bn"), "part", "h")
    longer = (F.col("bn") > F.col("an")) | ((F.col("bn") == F.col("an")) & (F.col("b") > F.col("a")))
    met = probe.join(other, ["part", "h"]).where(longer & (F.col("an") >= F.col("bn") * threshold - 1e-9)).select("a", "b").distinct()
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("s").alias(f"s{x}"), F.col("many").alias(f"many_{x}"))
    pairs = met.join(side("a"), "a").join(side("b"), "b").where(likeness(F.col("sa"), F.col("sb")) >= threshold - 1e-9)
    pairs = scratch.table(pairs.select("a", "b", "many_a", "many_b"), "pairs")
    links = pairs.select(F.col("a").alias("node"), F.col("many_b").alias("links")).unionByName(pairs.select(F.col("b").alias("node"), F.col("many_a").alias("links"))).groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(pairs.select("a", "b"), scratch)
    found = nodes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = found.groupBy("root").agg(F.min("first_id").alias("class_id"))
    found = found.join(classes, "root").select("s", "class_id", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    return sets.join(found, "s").select("doc_id", "class_id", "n_links")


def with_next(spark: SparkSession, docs: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, text, sigs, next_text, next_sigs: the text of the row that follows by descending doc_id, after the last the first."""
    scratch = Scratch(spark, "order")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.xxhash64("doc_id")).withColumn("t", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select("doc_id", "k", "t").distinct().repartitionByRange(n, F.desc("doc_id"), F.desc("t")).sortWithinPartitions(F.desc("doc_id"), F.desc("t"))
    number = F.monotonically_increasing_id()  # the partition and, from 0 on, the place in it
    keys = scratch.table(keys.select("k", "t", number.alias("place")), "places")
    part = F.shiftright("place", 33)
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    keys = keys.withColumn("cell", F.shiftleft(part, 33) + F.floor(inside / cell_rows))
    ends = keys.groupBy(part.alias("part")).agg(F.min("place").alias("first"), F.max("cell").alias("cell"))
    order = Window.orderBy("part")  # one row for each partition
    before = ends.select(F.col("first").alias("place"), F.coalesce(F.lag("cell").over(order), F.max("cell").over(Window.partitionBy())).alias("end"))
    starts = keys.groupBy("cell").agg(F.min("place").alias("place")).select("place").join(before, "place", "left")
    keys = keys.join(starts.withColumn("opens", F.lit(1)), "place", "left")
    keys = keys.select("k", "t", "place", "cell", F.when(F.col("opens") == 1, F.coalesce("end", F.col("cell") - 1)).alias("also"))
    rows = docs.join(keys, ["k", "t"])
    here = F.struct(F.col("cell"), F.lit(0).alias("ghost"))
    rows = rows.select("doc_id", "text", "place", F.explode(F.when(F.col("also").isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col("also").alias("cell"), F.lit(1).alias("ghost"))))).alias("c")).select("doc_id", "text", "place", "c.cell", "c.ghost")
    order = Window.partitionBy("cell").orderBy("ghost", "place")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("sigs", signatures(F.col("text")))
    return rows.withColumn("next_sigs", F.lead("sigs").over(order)).where("ghost = 0").select("doc_id", "text", "sigs", "next_text", "next_sigs")


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(spark, table(spark, sf_dir, "documents"))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", 1, F.length("text") - third), F.substring("next_text", 1, third))
    made = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"), F.col("sigs").alias("s"), signatures(edited).alias("e"), F.col("next_sigs").alias("x"))
    pruned = lambda c: pruned_likeness(F.col("s"), F.col(c), ALIKE)["pruned"]
    return made.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("s")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("e")).cast("double").alias("near_edited"), likeness(F.col("s"), F.col("x")).cast("double").alias("near_next"),
        part_of(F.size("s"), ALIKE).alias("length_part"), pruned("e").alias("pruned_edited"), pruned("x").alias("pruned_next"),
    )
