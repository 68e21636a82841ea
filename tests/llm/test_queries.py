"""Each registered query over whole tables of the smallest size, against brute force."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from pagelume.llm import bpe, queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{DIR}/documents.parquet").to_pylist()}


def run(spark, name):
    return queries.QUERIES[name](spark, DIR).collect()


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def ids_of(name, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path(name))
    return library, [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_op1(spark, docs):
    sets = {}
    for i, t in docs.items():
        w = t.lower().split()
        k = min(5, len(w)) or 1
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    links = {i: [j for j in docs if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in docs}
    root = {i: i for i in docs}
    for _ in range(30):
        root = {i: min([root[i], *[root[j] for j in links[i]]]) for i in docs}
    got = {r.doc_id: (r.class_id, r.n_links) for r in run(spark, "op1_jaccard")}
    assert got == {i: (root[i], len(links[i])) for i in docs}


def test_op2(spark, docs):
    _, ids = ids_of("word_bpe_49k.json", list(docs.values()))
    want = {i: np.array([*x, 1], "<u4") for i, x in zip(docs, ids)}
    pieces, sequences = {i: [] for i in docs}, {}
    for r in run(spark, "op2_packing"):
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(want[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in want.items():
        at = 0
        for start, n in sorted(pieces[i]):
            assert start == at
            at += n
        assert at == len(x)
    sizes = []
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        sizes.append(at)
    assert max(sizes) <= 2048 and sum(2048 - n for n in sizes if n & (n - 1)) <= 0.02 * sum(sizes)


def test_op3(spark, docs):
    library, ids = ids_of("byte_bpe_50k.json", list(docs.values()))
    want = {i: (len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x, skip_special_tokens=False))) for i, x in zip(docs, ids)}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op3_bpe")} == want


def test_op4(spark, docs):
    order = sorted(docs, reverse=True)
    after = dict(zip(order, [*order[1:], order[0]]))
    rows = {r.doc_id: r for r in run(spark, "op4_spotsigs")}
    assert set(rows) == set(docs)
    for i, r in rows.items():
        t, n = docs[i], len(docs[i])
        edited = t[: n - n // 3] + docs[after[i]][: n // 3]
        assert r.n_chars == n and r.edited_sha256 == sha(edited)
        a, b = ({x[k : k + 8] for k in range(0, len(x), 8)} for x in (r.fingerprint, r.edited_fingerprint))
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-9 and 0 <= r.near_next <= 1
        c = {rows[after[i]].fingerprint[k : k + 8] for k in range(0, len(rows[after[i]].fingerprint), 8)}
        assert abs(r.near_next - (len(a & c) / len(a | c) if a | c else 1.0)) < 1e-9
    assert len({(docs[i], r.fingerprint) for i, r in rows.items()}) == len(set(docs.values()))
    near = sorted(r.near_edited for r in rows.values())
    assert near[len(near) // 10] > 0.3 and sorted(r.near_next for r in rows.values())[len(rows) // 2] < 0.1


def test_op5(spark, docs):
    rows = {r.doc_id: r for r in run(spark, "op5_secrets")}
    assert set(rows) == set(docs)
    for i, t in docs.items():
        hits = [m.span() for m in re.finditer(r"AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]{16,}|(?<=token = \")[0-9a-f]{32,}", t)]
        got = {(f.start, f.start + f.length) for f in rows[i].findings}
        assert set(hits) <= got
        assert all(re.search(r"\d", t[a:b]) for a, b in got)


def test_op7(spark, docs):
    words = {i: t.lower().split() for i, t in docs.items()}
    runs = Counter()
    for w in words.values():
        runs.update({tuple(w[k : k + 51]) for k in range(len(w) - 50)})
    want = {i for i, w in words.items() if any(runs[tuple(w[k : k + 51])] > 1 for k in range(len(w) - 50))}
    rows = run(spark, "op7_chains")
    linked = {r.doc_id for r in rows} | {r.other_doc_id for r in rows}
    assert want <= linked and len(linked - want) <= 0.1 * len(docs)


def test_op8(spark, docs):
    for r in run(spark, "op8_quality"):
        w = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id])
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {k + d for k in range(len(w) - 2) if grams[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
        lines = [x for x in docs[r.doc_id].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in docs[r.doc_id]), len(lines) - len(set(lines)), len(covered), failed)
        assert not (failed and r.kept)


def test_op9(spark, docs):
    seen = Counter()
    raw = {i: t.encode() for i, t in docs.items()}
    for b in raw.values():
        seen.update(hashlib.blake2b(b[k : k + 200], digest_size=12).digest() for k in range(len(b) - 199))
    for r in run(spark, "op9_suffix"):
        b = raw[r.doc_id]
        cut = np.zeros(len(b) + 1, np.int64)
        for k in range(len(b) - 199):
            if seen[hashlib.blake2b(b[k : k + 200], digest_size=12).digest()] > 1:
                cut[k] += 1
                cut[k + 200] -= 1
        gone = np.cumsum(cut)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), spans, sha(kept))


def test_op10(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in pq.read_table(f"{DIR}/pages.parquet").to_pylist()}
    last = {}
    for i, b in pages.items():
        last[b] = max(i, last.get(b, i))
    got = {r.page_id: tuple(r)[1:] for r in run(spark, "op10_warc")}
    assert got == {i: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if last[b] == i else "revisit", None if last[b] == i else last[b]) for i, b in pages.items()}
