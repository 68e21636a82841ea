"""Operator 1: self-join of texts on the Jaccard similarity of their word n-grams, with Bayesian candidate pruning.

1. Each text becomes its set of hashed n-grams (five words by default) and MinHash values. Texts with equal sets form one
   node with a multiplicity; copies are never paired.
2. Candidates share a band of MinHash values: a bucket. With BANDS x ROWS values a pair at the threshold 0.8 is missed with
   probability (1 - 0.8 ** ROWS) ** BANDS, below one in 50,000. Edges from each node of a bucket to the bucket's least node
   have connected components, outside which no nodes can be similar.
3. The nodes of each bucket are compared, a pair only in the first bucket that it shares. A component that has no more
   pairs of nodes than its buckets have together is compared at once instead, which moves its sets once. Either way a group
   larger than a block is cut into blocks by hash, and pairs of blocks are compared.
4. MinHash values are read CHUNK at a time, and after each chunk the pairs are dropped whose posterior probability of
   reaching the threshold is below TOLERANCE (uniform prior over the similarity, binomial likelihood: a Beta posterior).
   The survivors are verified exactly on their sets.
5. The verified links give every node its number of links and, as spanning forests, the edges of the classes.

Result: one row for each document with class_id (the least doc_id of its connected class) and n_links (other documents at
or above the threshold).

Scale: bands, multiplicities and least nodes are aggregates with partial sums. A chain of weakly similar texts makes a
large component of small buckets, whose work and shuffle are those of the buckets; texts that are all alike make one group
of blocks, in which each pair is looked at once. Pairs are counted where they are compared, so only one row for each node
of a pair of blocks is returned.

Defined cases: words are runs without white space, lower-cased; a text of fewer words than n has its one shorter gram; a
text without words (or null) is a class of its own without links. Rows that repeat an id are rows of their own, linked
where their texts are alike. Ids are of any orderable type; null ids pass through, and class_id is null where a class has
null ids only. An empty table gives an empty result; extra columns are ignored, and kept by keep_one().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import connected_components
from .store import Scratch, table
from .tokens import gram_hashes, mix, word_hashes

NGRAM, THRESHOLD = 5, 0.8
BANDS, ROWS = 28, 5
#: MinHash values that a comparison reads at a time, and the posterior probability below which a pair is dropped.
CHUNK, TOLERANCE = 20, 1e-6
#: Bytes of sets and MinHash values in a block.
BLOCK_BYTES = 8 << 20

_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_ADDED = mix(np.arange(501, 501 + BANDS * ROWS, dtype=np.uint64))
_BAND_SEEDS = mix(np.arange(1001, 1001 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)


def gram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of words."""
    h = word_hashes((text or "").lower().split())
    return np.unique(gram_hashes(h, min(n, len(h)) or 1))


def min_hashes(grams: np.ndarray) -> np.ndarray:
    """For each seed the least of the grams' hashes: the high half of a multiplication and an addition modulo 2 ** 64."""
    out = [(grams[None, :] * _SEEDS[k : k + 20, None] + _ADDED[k : k + 20, None]).min(axis=1) for k in range(0, len(_SEEDS), 20)]
    return (np.concatenate(out) >> np.uint64(32)).astype(np.uint32)


def band_keys(values: np.ndarray) -> np.ndarray:
    keys = (values.astype(np.uint64) * _BAND_SEEDS).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
    return mix(keys + np.arange(BANDS, dtype=np.uint64))


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For CHUNK, 2 CHUNK, ... values read: the least number of equal ones with which a pair stays. The posterior of the
    similarity s after m of n equal values is Beta(m + 1, n - m + 1), and P(s >= t) is a binomial sum."""
    out = []
    for n in range(CHUNK, BANDS * ROWS + 1, CHUNK):
        for m in range(n + 1):
            reach = sum(math.comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))
            if reach >= tolerance:
                out.append(m)
                break
    return out


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                nodes, bands, sizes = [], [], []
                for text in batch.column("text").to_pylist():
                    grams = gram_set(text, n)
                    nodes.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else b"")
                    bands.append(band_keys(min_hashes(grams)).view(np.int64) if len(grams) else np.empty(0, np.int64))
                    sizes.append(len(grams))
                offsets = np.cumsum([0, *map(len, bands)]).astype(np.int32)
                made = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands)))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "k", "t")], *made], ["doc_id", "k", "t", "node", "grams", "bands"])

    return run


def _sets(n: int):
    """The chosen texts' rows with MinHash values and sets, one for each of their groups."""
    names = ["node", "many", "groups"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch = whole.slice(k, 200)
                sets = [gram_set(t, n) for t in batch.column("text").to_pylist()]
                made = [pa.array([min_hashes(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *made], [*names, "hashes", "grams"])

    return run


def similar_pairs(hashes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, least: list[int], band: int = -1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i of left, j of right, i < j in their order) whose sets reach the threshold, block by block of rows; with a
    band, only pairs that share it and none before it."""
    sizes = np.array([len(s) for s in sets])
    for i in left:
        others = right[right > i] if left is right else right
        small, large = np.minimum(sizes[i], sizes[others]), np.maximum(sizes[i], sizes[others])
        others = others[small >= threshold * large - 1e-9]
        if band >= 0 and len(others):
            shared = (hashes[others, : (band + 1) * ROWS] == hashes[i, : (band + 1) * ROWS]).reshape(len(others), band + 1, ROWS).all(axis=2)
            others = others[shared[:, band] & ~shared[:, :band].any(axis=1)]
        equal = np.zeros(len(others), np.int32)
        for step, need in enumerate(least):
            if not len(others):
                break
            at = slice(step * CHUNK, (step + 1) * CHUNK)
            equal += (hashes[others, at] == hashes[i, at]).sum(axis=1, dtype=np.int32)
            stay = equal >= need
            others, equal = others[stay], equal[stay]
        if len(others):
            mine = sets[i]
            joined = np.concatenate([sets[j] for j in others])
            n = sizes[others]
            at = np.searchsorted(mine, joined)
            hit = mine[np.minimum(at, len(mine) - 1)] == joined
            common = np.add.reduceat(hit, np.cumsum(n) - n)
            found = others[common >= threshold * (len(mine) + n - common) - 1e-9]
            if len(found):
                yield i, found


def _compare(threshold: float, tolerance: float):
    """(node, links, root): of each node of a pair of blocks, its links there (copies counted) and its tree's root."""
    least = least_matches(threshold, tolerance)

    def solve(group: pa.Table) -> pa.RecordBatch | None:
        node = group.column("node").to_pylist()
        many = group.column("many").to_numpy()
        side = group.column("block").to_numpy()
        band, bi, bj = (group.column(c)[0].as_py() for c in ("band", "bi", "bj"))
        if len(node) < 2:
            return None
        hashes = np.frombuffer(b"".join(group.column("hashes").to_pylist()), np.uint32).reshape(len(node), -1)
        sets = [np.frombuffer(g, np.uint64) for g in group.column("grams").to_pylist()]
        left = np.flatnonzero(side == bi)
        right = left if bi == bj else np.flatnonzero(side == bj)
        links, parent = np.zeros(len(node), np.int64), list(range(len(node)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, found in similar_pairs(hashes, sets, left, right, threshold, least, band):
            links[i] += many[found].sum()
            links[found] += many[i]
            a = root(int(i))
            for j in found.tolist():
                b = root(j)
                if a != b:
                    parent[b] = a
        rows = np.flatnonzero(links)
        if not len(rows):
            return None
        return pa.RecordBatch.from_arrays([pa.array([node[i] for i in rows], pa.binary()), pa.array(links[rows]), pa.array([node[root(int(i))] for i in rows], pa.binary())], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = list(zip(batch.column("g").to_pylist(), batch.column("bi").to_pylist(), batch.column("bj").to_pylist(), strict=True))
            at = 0
            for k in range(1, len(keys) + 1):
                if k < len(keys) and keys[k] == keys[at]:
                    continue
                if keys[at] != last and held:
                    if out := solve(pa.Table.from_batches(held)):
                        yield out
                    held = []
                last = keys[at]
                held.append(batch.slice(at, k - at))
                at = k
        if held and (out := solve(pa.Table.from_batches(held))):
            yield out

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """docs with hashes k of the id and t of the text."""
    return docs.withColumn("k", F.xxhash64("doc_id")).withColumn("t", F.xxhash64(F.coalesce("text", F.lit(""))))


def grouped(nodes: DataFrame, scratch: Scratch, block_bytes: int) -> DataFrame:
    """(node, many, k, t, groups) of the nodes that may be similar to another one; groups are structs (g, band, blocks), of a
    whole component (band -1) or of buckets."""
    postings = nodes.select("node", "grams", F.posexplode("bands").alias("i", "band"))
    size = 8 * F.col("grams") + 4 * BANDS * ROWS
    heads = postings.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("head"), F.sum(size).alias("bytes")).where("n > 1")
    heads = scratch.table(heads, "heads")  # a table, so that Spark can split the join where a band has very many nodes
    met = postings.join(heads, "band").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    comps = scratch.table(connected_components(met, scratch).select("node", F.col("root").alias("comp")), "comps")
    blocks = F.ceil(F.col("bytes") / block_bytes).cast("int")
    sums = comps.join(nodes.select("node", "grams"), "node").groupBy("comp").agg(F.count(F.lit(1)).alias("nodes"), F.sum(size).alias("bytes"))
    buckets = heads.join(comps, F.col("head") == F.col("node")).groupBy("comp").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
    plan = sums.join(buckets, "comp").select("comp", (F.col("pairs") < F.col("nodes").cast("double") * F.col("nodes")).alias("by_bucket"), blocks.alias("blocks"))
    plan = scratch.table(plan, "plan")
    members = scratch.table(comps.join(plan, "comp"), "members")
    at_once = members.where("not by_bucket").select("node", F.array(F.struct(F.col("comp").alias("g"), F.lit(-1).alias("band"), "blocks")).alias("groups"))
    split = postings.join(members.where("by_bucket").select("node"), "node", "left_semi").join(heads, "band")
    split = split.groupBy("node").agg(F.collect_list(F.struct(F.col("band").cast("string").cast("binary").alias("g"), F.col("i").alias("band"), blocks.alias("blocks"))).alias("groups"))
    return at_once.unionByName(split).join(nodes.select("node", "many", "place.k", "place.t"), "node")


def jaccard_join(spark: SparkSession, docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, k, t (as in keyed()), class_node (a key of the class), class_id, n_links for each row of docs."""
    scratch = Scratch(spark, "jaccard")
    docs = keyed(docs.select("doc_id", "text")).select("doc_id", "k", "t", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketch = scratch.table(docs.mapInArrow(_sketch(n), f"doc_id {kind}, k long, t long, node binary, grams long, bands array<long>"), "sketch")
    nodes = sketch.where(F.length("node") > 0).groupBy("node").agg(F.count(F.lit(1)).alias("many"), F.min("doc_id").alias("first_id"), F.min(F.struct("k", "t")).alias("place"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    nodes = scratch.table(nodes, "nodes")
    chosen = scratch.table(grouped(nodes, scratch, block_bytes), "chosen")
    # rows that repeat an id and its text count once here; their number is in `many`
    texts = docs.select("k", "t", "text").dropDuplicates(["k", "t"]).join(chosen, ["k", "t"]).select("node", "many", "groups", "text")
    rows = texts.mapInArrow(_sets(n), "node binary, many long, groups array<struct<g:binary,band:int,blocks:int>>, hashes binary, grams binary")
    rows = rows.select("node", "many", "hashes", "grams", F.inline("groups"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("g", "band", "node", "many", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "hashes", "grams")
    rows = rows.repartition("g", "bi", "bj").sortWithinPartitions("g", "bi", "bj")
    links = scratch.table(rows.mapInArrow(_compare(threshold, tolerance), "node binary, links long, root binary"), "links")
    trees = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    found = nodes.select("node", "many", "first_id").join(counts, "node", "left").join(trees, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = found.groupBy("root").agg(F.min("first_id").alias("class_id"))
    found = found.join(classes, "root").select("node", F.col("root").alias("class_node"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    linked = sketch.where(F.length("node") > 0).select("doc_id", "k", "t", "node").join(found, "node").select("doc_id", "k", "t", "class_node", "class_id", "n_links")
    alone = sketch.where(F.length("node") == 0).select("doc_id", "k", "t", F.concat(F.lit("alone "), F.col("k").cast("string")).cast("binary").alias("class_node"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs, one row of each class: the one with the least doc_id (null ids first, equal rows once)."""
    columns = docs.columns
    first = jaccard_join(spark, docs).groupBy("class_node").agg(F.min(F.struct("doc_id", "k", "t")).alias("p")).select("p.k", "p.t")
    plain = [f"c{i}" for i in range(len(columns))]
    rows = keyed(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(p) for c, p in zip(columns, plain, strict=True)])).select("k", "t", *plain)
    return rows.dropDuplicates(["k", "t"]).join(first, ["k", "t"], "left_semi").select(*[F.col(p).alias(c) for c, p in zip(columns, plain, strict=True)])


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark, table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
