"""The similarity join against all pairs, and components against a union-find."""

import random

import numpy as np
from pyspark.sql import functions as F

from pagelume.llm import jaccard_join
from pagelume.llm.graph import connected_components
from pagelume.llm.store import Scratch
from pagelume.llm.tokens import mix


def grams(text, n=5):
    w = (text or "").lower().split()
    k = min(n, len(w)) or 1
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(texts, threshold):
    sets = [grams(t) for t in texts]
    links = [[j for j in range(len(texts)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(len(texts))]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min([root[i], *[root[j] for j in links[i]]]) for i in range(len(texts))]
    return root, [len(x) for x in links]


def corpus(rng):
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 160))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(500)}"
            texts.append(" ".join(w))
    return [*texts, texts[0], texts[0].upper(), None, "", "  ", "one", "one", "two words"]


def test_join_is_all_pairs(spark):
    for seed, bytes_ in ((1, 8 << 20), (2, 9_000)):
        texts = corpus(random.Random(seed))
        docs = spark.createDataFrame([(i, t, b"") for i, t in enumerate(texts)], "doc_id long, text string, node binary").repartition(3)
        out = {r.doc_id: r for r in jaccard_join.jaccard_join(spark, docs, block_bytes=bytes_).collect()}
        roots, links = brute(texts, 0.8)
        assert [out[i].class_id for i in range(len(texts))] == roots
        assert [out[i].n_links for i in range(len(texts))] == links
        if seed == 1:
            kept = jaccard_join.keep_one(spark, docs)
            assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(roots))


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words stand here now"), (None, "a b c d e f"), (None, None), (2, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.class_id or 0, r.n_links) for r in jaccard_join.jaccard_join(spark, docs).collect())
    assert out == [(0, 0), (1, 0), (1, 2), (1, 2), (1, 2), (2, 0)]
    assert jaccard_join.jaccard_join(spark, docs.limit(0)).count() == 0
    assert jaccard_join.keep_one(spark, docs).count() == 4


def test_pruning_keeps_similar_pairs():
    least = jaccard_join.least_matches(0.8, 1e-6)
    assert all(a <= b for a, b in zip(least, least[1:])) and 0 < least[0] < jaccard_join.CHUNK
    rng = np.random.default_rng(4)
    for share in (0.85, 0.95):
        for _ in range(30):
            a = rng.integers(0, 2**63, 200).astype(np.uint64)
            b = np.concatenate([a[: int(200 * 2 * share / (1 + share))], rng.integers(0, 2**63, 200 - int(200 * 2 * share / (1 + share))).astype(np.uint64)])
            sets = [np.unique(a), np.unique(b)]
            hashes = np.stack([jaccard_join.min_hashes(s) for s in sets])
            both = np.arange(2)
            found = list(jaccard_join.similar_pairs(hashes, sets, both, both, 0.8, least))
            true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
            assert bool(found) == (true >= 0.8)
            assert abs((hashes[0] == hashes[1]).mean() - true) < 0.25


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 150)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)] + [(7, 7)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long")
    got = connected_components(df, Scratch(spark, "test")).select(F.col("node"), F.col("root")).collect()
    assert {(r.node, r.root) for r in got} == set(root.items()) and len(got) == len(root)


def test_min_hashes_agree_as_often_as_the_sets_do():
    rng = np.random.default_rng(8)
    for kind in (lambda n: rng.integers(0, 2**63, n).astype(np.uint64), lambda n: mix(rng.integers(0, 2**40, dtype=np.uint64) + np.arange(n, dtype=np.uint64))):
        gaps = []
        for _ in range(300):
            a = kind(225)
            x, y = a[:200], a[25:]  # similarity 175 / 225
            gaps.append((jaccard_join.min_hashes(x) == jaccard_join.min_hashes(y)).mean() - 175 / 225)
        assert abs(np.mean(gaps)) < 0.015 and np.std(gaps) < 0.05


def test_recall_close_to_the_threshold():
    """Pairs of similarity 0.80 to 0.85 share a band and pass the posterior test."""
    rng = np.random.default_rng(15)
    least = jaccard_join.least_matches(0.8, 1e-6)
    lost = 0
    for _ in range(1500):
        n, share = int(rng.integers(60, 400)), rng.uniform(0.8, 0.85)
        a = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        d = int(n * (1 - share) / (1 + share))
        sets = [np.sort(a[:n]), np.sort(a[d : n + d])]
        hashes = np.stack([jaccard_join.min_hashes(s) for s in sets])
        bands = [jaccard_join.band_keys(h) for h in hashes]
        both = np.arange(2)
        lost += not (bands[0] == bands[1]).any() or not list(jaccard_join.similar_pairs(hashes, sets, both, both, 0.8, least))
    assert lost <= 2


def test_chain_of_weakly_similar_texts(spark, monkeypatch):
    """A long chain is one component, but only neighbours meet: each text is moved about as often as it shares bands."""
    n, step, width = 3_000, 14, 60
    words = [f"w{i}" for i in range(n * step + width)]
    docs = spark.createDataFrame([(i, " ".join(words[i * step : i * step + width])) for i in range(n)], "doc_id long, text string").repartition(4)
    scratch = Scratch(spark, "test")
    keyed = jaccard_join.keyed(docs).select("doc_id", "k", "t", "text")
    sketch = keyed.mapInArrow(jaccard_join._sketch(5), "doc_id long, k long, t long, node binary, grams long, bands array<long>")
    nodes = scratch.table(sketch.select("node", F.lit(1).cast("long").alias("many"), F.struct("k", "t").alias("place"), "grams", "bands"), "nodes")
    moved = jaccard_join.grouped(nodes, scratch, 20_000).select("node", F.inline("groups")).agg(F.sum("blocks")).first()[0]
    assert moved <= 12 * n
    out = jaccard_join.jaccard_join(spark, docs, block_bytes=20_000).collect()
    assert len(out) == n and all(r.n_links == 0 and r.class_id == r.doc_id for r in out)
