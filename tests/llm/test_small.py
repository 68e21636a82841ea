"""Row-by-row operators against brute force on small tables."""

import base64
import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelume.llm import bpe, chat, packing, quality, spotsigs, warc

ODD = [None, "", " ", "a", "  a  b", "x\n\n y \n", "I'm WE'LL 12 345", "é́ ß ΑΣ.\tb\x1cc", "😀 zwj👩‍👩‍👧 �", "b" * 4000, "One two. " * 400, "<|endoftext|> x <|startoftext|>", "same", "same", "\\|x| [INST] </s>"]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(ODD)] + [(3, "a", "en", None), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string")


def test_bpe_is_the_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    rows = bpe.bpe_decode(bpe.bpe_encode(docs)).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.bpe_encode(docs.limit(0)).count() == 0


def test_packing_is_whole_and_tight(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path("word_bpe_49k.json"))
    for length in (64, 2048):
        rows = packing.pack(docs.repartition(2), length=length, with_ids=True).collect()
        pieces, sequences = {}, {}
        for r in rows:
            assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
            pieces.setdefault(r.doc_id, []).append(r)
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for i, text in enumerate(ODD):
            want = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
            got = sorted(pieces[i], key=lambda r: r.start)[:: 2 if i == 3 else 1]
            assert b"".join(r.ids for r in got) == want.tobytes() and all(r.doc_tokens == len(want) for r in got)
        for parts in sequences.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= length
    assert packing.pack(docs.limit(0)).count() == 0
    for kind in ("short", "decimal(20,2)", "string", "date", "binary", "array<int>", "struct<a:int,b:string>"):
        typed = docs.select(F.expr("case when doc_id is null then null else 1 end").alias("i"), "text")
        value = {"date": "date'2024-01-01'", "binary": "cast('a' as binary)", "array<int>": "array(i)", "struct<a:int,b:string>": "named_struct('a', i, 'b', 'x')"}.get(kind, f"cast(i as {kind})")
        typed = typed.select(F.expr(f"case when i is not null then {value} end").alias("doc_id"), "text")
        pieces = packing.pack(typed)
        assert pieces.schema["doc_id"].dataType.simpleString() == typed.schema["doc_id"].dataType.simpleString() and pieces.count() >= len(ODD)


def test_cuts_are_optimal():
    random.seed(5)
    for _ in range(40):
        places = [0, *sorted(random.sample(range(1, 60), 14))]
        penalties = [0, *[random.choice([0, 2, 5]) for _ in places[1:]]]
        places = [p for i, p in enumerate(places) if i == 0 or p - places[i - 1] <= 16] if max(np.diff(places)) > 16 else places
        if max(np.diff(places)) > 16:
            continue
        penalties = penalties[: len(places)]
        best = {0: 0}
        for j in range(1, len(places)):
            best[j] = min(best[i] + 16 - (places[j] - places[i]) + penalties[j] for i in range(j) if places[j] - places[i] <= 16)
        cuts = packing.best_cuts(places, penalties, 16)
        cost = sum(16 - (places[j] - places[i]) + penalties[j] for i, j in zip([0, *cuts], cuts))
        assert cost == min(best[j] for j in range(len(places)) if places[-1] - places[j] <= 16)


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "<p>x"), (2, "http://b\r\nc", "<p>x"), (3, None, None), (4, "u", ""), (5, "u", "é" * 70_000), (6, "v", "one"), (6, "v", "one")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = sorted(warc.read_warc(warc.write_warc(pages, f"file://{tmp_path}/w", roll_bytes=200)).collect(), key=lambda r: r.page_id)
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (6, "response", None), (6, "response", None)]
    for r in got:
        body = next((h or "").encode() for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.record_type == "revisit" or r.payload == body
    assert all(r.record_type == "response" for r in warc.read_warc(warc.write_warc(pages, f"file://{tmp_path}/v", dedup_from=10**9)).collect())
    assert warc.read_warc(warc.write_warc(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_paths_are_qualified(spark, tmp_path):
    from pagelume.llm.store import Scratch, qualified

    assert qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    assert Scratch(spark, "x").base.startswith("file:")
    with pytest.raises(ValueError):
        warc.file_system("/no/scheme")
    pages = spark.createDataFrame([(1, "u", "<p>")], "page_id long, url string, html string")
    made = warc.write_warc(pages, f"{tmp_path}/plain").collect()
    assert made and all(r.path.startswith("file:") for r in made)


def test_warc_reader_refuses_damage():
    raw = warc.record(1, "u", b"body", base64.b32encode(hashlib.sha1(b"other").digest()).decode(), None)
    import io

    with pytest.raises(ValueError):
        [warc.parse(x) for x in warc.members(io.BytesIO(raw))]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(raw[:-9])))


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nx", "\\", "\\<|im_end|>", "", None, "plain\ntext", "<\\|im_end|>", "<<SYS>>\\n", "\\\\|", "<|im_<|im_end|>end|>"]
    rows = [(1, i, r, t) for i, t in enumerate(nasty) for r in ("user", "assistant")] + [(2, 0, "odd role\n<|im_end|>", "hi"), (2, None, None, "first"), (3, 0, "user", "same"), (3, 0, "user", "same"), (None, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    out = {r.conv_id: r for r in chat.format_chats(df).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_runs"))).collect()}
    assert set(out) == {1, 2, 3, None}
    for c, r in out.items():
        want = sorted([((t is not None, t or 0), ro or "", x or "") for i, t, ro, x in rows if i == c])
        assert [(t.role, t.text) for t in r.parsed] == [w[1:] for w in want]
        assert r.loss == "".join(x for _, ro, x in want if ro == "assistant")
        assert sum(a.skip + a.take + a.rest for a in r.loss_runs) == len(r.formatted)
    assert "[INST]" not in out[1].formatted and out[3].formatted.count("same") == 2
    assert chat.format_chats(df.limit(0)).count() == 0


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    flagged = {i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(flagged))


def test_quality_counts(spark, docs):
    extra = spark.createDataFrame([(100 + i, " ".join(random.Random(i).choices("abcd", k=40)) + "\na b\n\na b\n" * (i % 3), "de", None) for i in range(20)], docs.schema)
    for r in quality.quality_counts(docs.unionByName(extra)).withColumn("q2", F.col("q")).collect():
        want = counts(r.text)
        assert tuple(r.q)[:5] == want
        assert r.q.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_binomial_tail(spark):
    cases = [(n, k) for n in (1, 10, 300, 5000) for k in (0, 1, 3, 20) if k <= n]
    for p in (0.001, 0.05):
        rows = spark.createDataFrame(cases, "n long, k long").withColumn("p", F.exp(quality.binomial_below(F.col("n"), F.col("k"), p))).collect()
        for r in rows:
            want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(p) + (r.n - i) * math.log1p(-p)) for i in range(r.k + 1))
            assert abs(r.p - want) < 1e-9


def test_quality_rejects_what_labels_show(spark):
    rng = random.Random(1)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(80))
    rows = [(i, prose() + " ###%%% " * (40 if i % 4 == 0 else 0), "en", "s") for i in range(24_00)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, q string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(2400) if i % 2 == 0] + [(7, None)], "doc_id long, quality long")
    kept = quality.apply_quality(spark, docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    none = {r.doc_id for r in quality.apply_quality(spark, docs, labels.limit(0)).select("doc_id").collect()}
    assert none == set(range(2400))  # no labels, no cutoff
    assert ids == {i for i in range(2400) if i % 4}
    assert not quality.certified_cutoffs(quality.quality_counts(docs), labels, alpha=0.005).collect()  # too few labels for that
    for r in quality.quality_cutoffs(spark, docs, labels).collect():
        assert r.stratum == "en" and r.n_good == 600 and r.n_lost == 0 and abs(r.p_value - (1 - r.bound) ** 600) < 1e-9


def test_verdict_is_the_brute_force_one(spark):
    """kept against cutoffs from exact binomial sums in plain Python, where labels overlap and strata differ."""
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(3000):
        bad, lang = rng.random() < 0.25, rng.choice(["en", "en", "en", "fr", "xx"])
        w = ["".join(rng.choices("abcdefgh", k=rng.choice([3, 5, 8]) + 6 * (bad and i % 2))) for _ in range(60)]
        marks = rng.randrange(4) + (rng.randrange(40) if bad else rng.random() < 0.02 and 12)
        rows.append((i, " ".join(w) + " " + "#" * marks + ("\n" + w[0]) * (rng.randrange(6) if bad else 0), lang))
        labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    quality_of = {i: y for i, y in labels if i % 10}
    alpha, delta = quality.ALPHA, quality.DELTA
    measured = {}
    for r in quality.quality_counts(docs).select("doc_id", "lang", "q.*").collect():
        n, c = max(r.n_words, 1), max(r.word_chars, 1)
        values = {"symbols": r.n_symbols / c * 2, "repeats": r.n_repeat_words / n, "lines": r.n_dup_lines / n * 10, "long_words": c / n / 40}
        measured[r.doc_id] = (r.lang if r.lang in quality.STRATA else "other", r.base_failed, {k: math.floor(min(1.0, v) * quality.GRID) for k, v in values.items()})
    cutoffs = {}
    for stratum in {m[0] for m in measured.values()}:
        seen = [(quality_of[i], m[2]) for i, m in measured.items() if i in quality_of and m[0] == stratum and not m[1]]
        n = sum(y for y, _ in seen)
        for rule in quality.measures():
            for step in sorted({m[rule] for _, m in seen}, reverse=True):
                k = sum(y for y, m in seen if m[rule] >= step)
                lost = sum(1 - y for y, m in seen if m[rule] >= step)
                p = alpha / 4
                if k > n * p or sum(math.comb(n, x) * p**x * (1 - p) ** (n - x) for x in range(k + 1)) > delta / (4 * (len(quality.STRATA) + 1)):
                    break
                if step > 0 and lost > quality.ODDS * k:
                    cutoffs[stratum, rule] = step
    assert len(cutoffs) >= 3
    want = {i for i, (st, failed, m) in measured.items() if not failed and not any(m[rule] >= cutoffs.get((st, rule), 10**9) for rule in m)}
    table_ = spark.createDataFrame([(i, y) for i, y in quality_of.items()], "doc_id long, quality long")
    assert {r.doc_id for r in quality.apply_quality(spark, docs, table_).collect()} == want
    assert {(r.stratum, r.rule): r.step for r in quality.certified_cutoffs(quality.quality_counts(docs), table_).collect()} == cutoffs


def test_spotsigs(spark):
    texts = ["The quick brown fox saw the lazy dog in a green park of tall trees and old stones " * 3, "completely other words without common ones " * 4, "", None, "!!!", "The quick brown fox saw the lazy dog in a green park of tall trees and old stones " * 3, "die alte Stadt und der neue Markt mit vielen Menschen in den engen Gassen", "the " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.lit(0))
    rows = {r.doc_id: r for r in spotsigs.with_next(spark, docs, cell_rows=2).withColumn("f", spotsigs.fingerprint(F.col("sigs"))).collect()}
    assert len(rows) == len(texts)
    for i in range(len(texts)):
        assert rows[i].next_text == (texts[(i - 1) % len(texts)] or "")
        assert rows[i].next_sigs == rows[(i - 1) % len(texts)].sigs
    assert rows[0].f == rows[5].f != "" and rows[2].f == rows[3].f == "" and rows[4].f != ""
    assert spotsigs.with_next(spark, docs.limit(0)).count() == 0 and spotsigs.with_next(spark, docs.where("doc_id = 1")).first().next_text == texts[1]


def test_order_of_odd_ids(spark):
    """Outliers, strings, null and repeated ids: each row's successor is the next one in order."""
    numbers = [*range(40), 2**62, -(2**63), 2**63 - 1]
    for ids, kind in ((numbers, "long"), ([f"id{i:05d}" for i in numbers[:40]], "string")):
        rows = [(i, f"text {i}") for i in ids] + [(ids[3], "a repeated id"), (None, "no id"), (ids[5], f"text {ids[5]}")]
        docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(5)
        got = spotsigs.with_next(spark, docs, cell_rows=3).collect()
        assert len(got) == len(rows)
        after = {}
        for r in got:
            after.setdefault((r.doc_id, r.text), []).append(r.next_text)
        order = sorted(ids, reverse=True)
        for i, j in zip(order, order[1:]):
            own, texts = f"text {i}", {f"text {j}", *(["a repeated id"] if ids[3] in (i, j) else [])}
            if i == ids[5]:
                assert sorted(after[i, own]) == sorted([own, f"text {j}"])
            else:
                assert after[i, own][0] in texts
        assert after[None, "no id"] == [f"text {order[0]}"] and {*after[ids[3], "a repeated id"], *after[ids[3], f"text {ids[3]}"]} >= {f"text {ids[2]}"}


def python_signatures(text, anchors=spotsigs.ANCHORS):
    """The chains of a text as word tuples, step by step."""
    words = [w for w in re.split(r"[^\w]|_", text.lower()) if w]
    stop = set(anchors)
    content, marks = [], []
    for k, w in enumerate(words):
        if w not in stop:
            content.append(w)
            marks.append(words[k - 1] if k and words[k - 1] in stop else None)
    return [(m, w, content[i + 1] if i + 1 < len(content) else None, content[i + 2] if i + 2 < len(content) else None) for i, (m, w) in enumerate(zip(marks, content))]


def test_signatures_follow_anchors(spark):
    """Every anchored chain has its own hash, equal chains the same; chains without anchors are a fixed part of all."""
    rng = random.Random(2)
    words = ["the", "of", "and", "der", "que", *[f"c{i}" for i in range(60)]]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 120))) + "." for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    probes = sorted({c[:3] for t in texts for c in python_signatures(t) if c[0]}, key=str)
    # an anchored chain's hash is that of "anchor:word" and the next content word; the last word of a text has none after it
    table_ = spark.createDataFrame([(f"{a}:{b}", c) for a, b, c in probes], "x string, y string").select("x", "y", F.xxhash64("x", "y").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("h"))
    known = {(r.x, r.y): r.h for r in table_.collect()}
    free = spark.createDataFrame([(w,) for w in words], "w string").where(F.xxhash64("w").bitwiseAND(F.lit(7).cast("long")) == 0)
    free = {r.w for r in free.collect()}
    for r in docs.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect():
        chains = python_signatures(texts[r.doc_id])
        want = {known[f"{a}:{b}", c] for a, b, c, _ in chains if a}
        own = {(b, c, d) for a, b, c, d in chains if not a and b in free}
        assert want <= set(r.s) and len(set(r.s)) == len(want) + len(own) + (not chains or not want | own)


def test_pruning_spares_only_unlike_sets(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(300):
        a = sorted(rng.sample(range(500), rng.randrange(60)))
        b = sorted({*rng.sample(a, rng.randrange(len(a) + 1)), *rng.sample(range(500), rng.randrange(60))})
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    for threshold in (0.05, 0.3, 0.8):
        for r in df.select("a", "b", spotsigs.pruned_likeness(F.col("a"), F.col("b"), threshold).alias("p")).collect():
            a, b = set(r.a), set(r.b)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(r.p.likeness - (true if true >= threshold else 0.0)) < 1e-9 and not (r.p.pruned and true >= threshold)


def test_spot_join_is_all_pairs(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(900)}" for _ in range(60)] for _ in range(6)]
    texts = []
    for b in base:
        for k in range(5):
            w = list(b)
            for _ in range(k):
                w[rng.randrange(60)] = f"x{rng.randrange(900)}"
            texts.append(" the ".join(w))
    texts += [texts[0], "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {r.doc_id: frozenset(r.s) for r in docs.select("doc_id", spotsigs.signatures(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    alike = lambda a, b: a == b or bool(a and b and len(a & b) >= 0.7 * len(a | b))
    links = {i: [j for j in sets if j != i and alike(sets[i], sets[j])] for i in sets}
    root = {i: i for i in sets}
    for _ in sets:
        root = {i: min([root[i], *[root[j] for j in links[i]]]) for i in sets}
    got = {r.doc_id: (r.class_id, r.n_links) for r in spotsigs.spot_join(spark, docs, 0.7).collect()}
    assert got == {i: (root[i], len(links[i])) for i in sets}
