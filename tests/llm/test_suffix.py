"""Exact substring deduplication against a brute-force count of all windows."""

import hashlib
import random
from collections import Counter

import pytest

from pagelume.llm import suffix_dedup


def brute(texts, match):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + match] for r in raw for i in range(len(r) - match + 1))
    out = []
    for r in raw:
        cut = [False] * len(r)
        for i in range(len(r) - match + 1):
            if seen[r[i : i + match]] > 1:
                cut[i : i + match] = [True] * match
        kept = bytes(b for b, c in zip(r, cut) if not c)
        spans = sum(c and not (i and cut[i - 1]) for i, c in enumerate(cut))
        out.append((len(r), sum(cut), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, alphabet, size):
    new = lambda n: "".join(rng.choices(alphabet, k=n))
    shared = [new(rng.randrange(30, size)) for _ in range(6)]
    texts = []
    for _ in range(50):
        bits = []
        for _ in range(rng.randrange(5)):
            bits.append(new(rng.randrange(size)))
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            bits.append(s[a : a + rng.randrange(len(s))])
        texts.append("".join(bits))
    return [*texts, None, "", "x" * 3 * size, texts[3], "ab" * size, new(size // 2) * 3, "x" * (size // 2)]


@pytest.mark.parametrize("match,gram,hot,step", [(200, 48, 20_000, 1 << 19), (40, 10, 20_000, 512), (40, 12, 0, 1 << 19), (40, 12, 5, 1 << 19)])
def test_equals_brute_force(spark, monkeypatch, match, gram, hot, step):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "STEP", step)
    rng = random.Random(match + gram)
    texts = corpus(rng, "abcdé ", match * 3) + corpus(rng, "ab", match * 2)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, cover int").repartition(3)
    got = {r.doc_id: (r._n_bytes, r._n_removed, r._n_spans, r._kept) for r in suffix_dedup.remove_repeats(spark, docs, match, gram, as_text=False).collect()}
    want = brute(texts, match)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, (i, texts[i])


def test_edges(spark):
    line = "".join(random.Random(1).choices("abcdefgh", k=260))
    rows = [(1, line), (1, line), (None, "no id, short"), (2, "y" + line[:199]), (3, "z" + line[:200])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffix_dedup.remove_repeats(spark, docs).collect()
    assert sorted((r.doc_id or 0, r._n_removed) for r in out) == [(0, 0), (1, 260), (1, 260), (2, 0), (3, 200)]
    assert [r._kept for r in out if r.doc_id == 3] == ["z"] and out[0].asDict().keys() >= {"doc_id", "text"}
    assert suffix_dedup.remove_repeats(spark, docs.limit(0)).count() == 0


def test_suffix_array():
    rng = random.Random(6)
    for _ in range(50):
        parts = [bytes(rng.choices(b"ab\0", k=rng.randrange(7))) for _ in range(rng.randrange(1, 30))]
        order, common = suffix_dedup.suffix_array(parts)
        ranked = [parts[i] for i in order]
        assert ranked == sorted(parts) and common[0] == 0
        for x, y, n in zip(ranked, ranked[1:], common[1:]):
            assert x[:n] == y[:n] and (len(x) == n or len(y) == n or x[n] != y[n])


def test_a_line_in_very_many_surroundings(spark, monkeypatch):
    """One line before and after thousands of different texts; no task may gather its phrases."""
    monkeypatch.setattr(suffix_dedup, "HOT", 500)
    rng = random.Random(3)
    new = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    line = new(250)
    rows = [(str(i), new(rng.randrange(200, 300)) + line + new(rng.randrange(200, 300)), "k") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _kept string").repartition(8)
    out = suffix_dedup.remove_repeats(spark, docs)
    assert out.columns == ["doc_id", "text", "_n_bytes", "_n_removed", "_n_spans", "_kept"]
    got = out.collect()
    assert len(got) == 4000 and all(r._n_spans == 1 and 250 <= r._n_removed <= 262 for r in got)
    kept = suffix_dedup.without_repeats(spark, docs.limit(50))
    assert kept.columns == docs.columns and {r._kept for r in kept.collect()} == {"k"}


def test_phrases_of_triggers_without_others_are_not_moved(spark, monkeypatch):
    """Copies share all their phrases: what they cover is known from counts, and the dictionary has the bytes of none."""
    rows_of = {}
    table = suffix_dedup.Scratch.table

    def counted(self, df, name):
        out = table(self, df, name)
        rows_of[name] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup.Scratch, "table", counted)
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghij ", k=3000)) for _ in range(5)]
    docs = spark.createDataFrame([(i, texts[i % 5]) for i in range(15)] + [(15, texts[0] + "end")], "doc_id long, text string")
    out = suffix_dedup.remove_repeats(spark, docs).collect()
    assert all(r._n_removed == 3000 and r._n_spans == 1 for r in out)
    assert rows_of["dictionary"] <= 4
