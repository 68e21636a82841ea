"""Huffman files, collocations and centroid clustering against plain versions, on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelume.llm import centroids, collocations, huffman
from pagelume.llm.bpe import vocabulary_path
from pagelume.llm.store import Scratch


def plain_huffman(weights):
    import heapq

    heap = [(w, i, (i,)) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    lengths, n = [0] * len(weights), len(weights)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for i in x + y:
            lengths[i] += 1
        heapq.heappush(heap, (a + b, n, x + y))
        n += 1
    return lengths


def test_code_lengths_are_least():
    rng = random.Random(4)
    for n in (2, 3, 7, 40, 300):
        weights = np.array([rng.randrange(1, 10 ** rng.randrange(1, 7)) for _ in range(n)])
        free = huffman.code_lengths(weights, 40)
        assert (weights * free).sum() == sum(w * x for w, x in zip(weights.tolist(), plain_huffman(weights.tolist())))
        tight = huffman.code_lengths(weights, 9)
        assert tight.max() <= 9 and sum(2.0**-x for x in tight.tolist()) <= 1 and (weights * tight).sum() >= (weights * free).sum()
    assert list(huffman.code_lengths(np.array([1, 1, 2, 4, 8, 16]), 3)) == [3, 3, 3, 3, 2, 2]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, np.int64), 3)


@pytest.mark.parametrize("n,size", [(0, 3), (1, 1), (511, 40), (512, 1), (513, 70_000), (40_000, 9)])
def test_packed_ids_return(n, size):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n) - 1, size - 1).astype(np.uint32)
    seen, counts = np.unique(ids, return_counts=True)
    book = huffman.Codebook.from_bytes(huffman.Codebook(seen, huffman.code_lengths(counts)).to_bytes())
    old, huffman.PACKED = huffman.PACKED, 1024
    bits, offsets = book.pack(ids)
    huffman.PACKED = old
    assert (book.unpack(bits, offsets, n) == ids).all()
    codes, lengths = book.by_id
    stream = "".join(f"{int(codes[i]):0{lengths[i]}b}" for i in ids)
    assert stream == "".join(f"{b:08b}" for b in bits)[: len(stream)] and len(bits) == (len(stream) + 7) // 8


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))


ODD = ["", " ", "a<|endoftext|>b <|endoftext|>", " x 　y\x85z\x1c", "é \U0001f600‍", "\r\n\r\n  x", " " * 200_000 + "end", "it's I'LL 12²Ⅷ", "\x00\x07", "﻿᠎​ x"]


def test_ids_are_those_of_the_library():
    rng = random.Random(1)
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts = ODD + ["".join(chr(rng.choice(points)) if rng.random() < 0.5 else rng.choice(" \n\t'ab1") for _ in range(60)) for _ in range(400)]
    own, lib = huffman.encoder(vocabulary_path("byte_bpe_50k.json")), library()
    for text in texts:
        assert own.ids(text).tolist() == lib.encode(text, add_special_tokens=False).ids, ascii(text[:80])


def test_files_of_ids(spark):
    texts = [*ODD, None, "same", "same", "word " * 3000]
    rows = [(i * 7 % 11, t, i) for i, t in enumerate(texts)] + [(None, "no id", 0), (11, "same", 1), (11, "same", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    folder = Scratch(spark, "test").path("ids")
    manifest = huffman.write_ids(docs, folder, "byte_bpe_50k.json", end_id=2, run_ids=2000, roll_bytes=4000).cache()
    got = huffman.read_ids(manifest).collect()
    lib = library()
    want = Counter((i, tuple([*lib.encode(t or "", add_special_tokens=False).ids, 2])) for i, t, _ in rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted([r[0] for r in rows], key=lambda i: (i is not None, i))
    assert manifest.agg(F.sum("n_ids"), F.sum("n_documents")).first() == (at, len(rows)) and manifest.count() > 1
    # a column of ids, some wider than 16 bits
    wide = spark.createDataFrame([(1, bytearray(np.array([70_000, 5, 70_000], "<u4").tobytes())), (2, None), (3, bytearray(b""))], "doc_id long, ids binary")
    back = {r.doc_id: bytes(r.ids) for r in huffman.read_ids(huffman.write_ids(wide, folder + "-wide")).collect()}
    assert back == {1: np.array([70_000, 5, 70_000], "<u4").tobytes(), 2: b"", 3: b""}
    assert huffman.read_ids(huffman.write_ids(docs.limit(0), folder + "-none", "byte_bpe_50k.json")).count() == 0


def test_a_changed_file_is_refused(spark, tmp_path):
    ids = [(1, bytearray(np.arange(3000, dtype="<u4").tobytes()))]
    path = huffman.write_ids(spark.createDataFrame(ids, "doc_id long, ids binary"), f"file://{tmp_path}").first().path[len("file:") :]
    raw = bytearray(open("/" + path.lstrip("/"), "rb").read())
    raw[-5] ^= 16

    class Stream:
        def __init__(self, data):
            self.data = bytes(data)

        def read(self, n):
            out, self.data = self.data[:n], self.data[n:]
            return out

    with pytest.raises(ValueError):
        list(huffman.sections(Stream(raw)))
    with pytest.raises(ValueError):
        list(huffman.sections(Stream(raw[:-9])))


def plain_collocations(rows, max_words, min_count, top, share):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in range(1, max_words + 1) for i in range(len(words) - k + 1))
    out = {}
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= min_count}
    for (lang, *p), a in candidates.items():
        if any(q[0] == lang and len(q) - 1 > len(p) and 100 * f >= share * a and any(list(q[i : i + len(p)]) == p for i in range(1, len(q) - len(p) + 1)) for q, f in candidates.items()):
            continue
        score, _, cut = min((10**6 * a * a // (counts[(lang, *p[:k])] * counts[(lang, *p[k:])]), k, (counts[(lang, *p[:k])], counts[(lang, *p[k:])])) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), cut))
    rows = set()
    for lang, found in out.items():
        for rank, (s, a, p, (x, y)) in enumerate(sorted(found)[:top], 1):
            rows.add((lang, rank, p.decode(), -a, x, y, totals[lang], -s))
    return rows


@pytest.mark.parametrize("max_words", [2, 3, 4])
def test_collocations(spark, max_words):
    rng = random.Random(max_words)
    words = ["New", "york", "City", "of", "the", "Äpfel", "äpfel", "x y", "\x0e", "'s"]
    text = lambda: "".join(rng.choice(words[: rng.randrange(2, 11)]) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "\x0b", "? "]) for _ in range(60))
    rows = [(rng.choice(["en", "de", None]), text()) for _ in range(40)] + [("en", None), ("en", ""), ("fr", "lonely words"), (None, "und text"), ("und", "und text")] + [("en", "New york City of the " * 40)] * 2
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "lang string, text string, f int, words string").repartition(3)
    got = {tuple(r) for r in collocations.collocations(spark, docs, max_words, 5, 12, 50).collect()}
    assert got == plain_collocations(rows, max_words, 5, 12, 50) and len(got) > 20
    assert collocations.collocations(spark, docs.limit(0), max_words).count() == 0


def test_products_beyond_64_bits(spark):
    n = 4_000_000
    over = spark.createDataFrame([(n, n, n)], "a long, l long, r long")
    a = F.col("a").cast("decimal(18,0)")
    assert over.select((F.lit(1_000_000).cast("decimal(7,0)") * a * a).alias("o"), (F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(18,0)")).alias("u")).selectExpr("o div u").first()[0] == 1_000_000


def plain_clusters(rows, k, rounds):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(64 * float(np.float32(x)))) for x in v]))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centers = [x for _, x in first]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        of = [near(x)[1] for _, x in kept]
        centers = [[sum(col) // len(col) for col in zip(*own)] if (own := [x for (_, x), j in zip(kept, of) if j == c]) else old for c, old in enumerate(centers)]
    out = [(i, near(x)) for i, x in kept]
    per = Counter()
    for _, (d, j) in out:
        per[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return Counter((i, j, d, per[j], sum(per.values()), digest[j]) for i, (d, j) in out)


@pytest.mark.parametrize("n", [0, 1, 9, 150])
def test_centroids(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, (rng.normal(size=64) * rng.choice([0.1, 3, 4000])).astype(np.float32).tolist()) for i in range(n)]
    if n > 5:
        rows += [rows[0], rows[1], (5, rows[2][1]), (None, rows[3][1]), (200, None), (201, [1.0] * 63), (202, [1.0] * 65), (203, [None] + [1.0] * 63), (204, [float("nan")] * 64), (205, [float("inf")] + [0.0] * 63), (206, [0.0] * 64), (207, [0.0] * 64), (208, [-0.001] * 64), (209, [])]
    vectors = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, x string").repartition(3)
    got = Counter(tuple(r) for r in centroids.cluster(spark, vectors).collect())
    assert got == plain_clusters(rows, 16, 3)


def test_too_large_components_raise(spark):
    vectors = spark.createDataFrame([(1, [3e6] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="component"):
        centroids.cluster(spark, vectors).collect()
