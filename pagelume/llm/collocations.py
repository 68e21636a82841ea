"""Operator 12: collocations by top-order marginalisation.

Every word of a piece opens one window of `max_words` words, padded where the piece ends: its lead columns are the text's
words shifted by 1, 2, ... places, so no window function has to bring a text's words together. Only these longest windows are
counted, first within the tasks that read the texts. Each phrase of fewer words is a prefix of windows, whose counts are
summed for every shorter prefix: windows meet by their first two words, so prefixes of two words and more are sums within a
part, and a Spark ROLLUP sums the parts' single words and the number of all words of a language. A phrase's last part is a
prefix of other windows, so one table has the counts of all parts.

Scale: a task numbers the words of CHUNK words at a time, counts their windows as numbers and sends each part (as many as
Spark's shuffle partitions) one compressed block of them; this is the only shuffle of windows. A window that a third of all
rows have is one entry of each chunk. A part keeps distinct windows only, so a very common pair of words takes memory for
the different words that follow it, not for its occurrences. Phrases that occur `min_count` times are written once; later
joins and groups see only those, their keys are phrases, and the join on a part is one that Spark may split where many phrases
share it. The report's ranks are limited in each task before the shuffle. Products are decimals of 38 digits, quotients are
floored exactly.

Defined cases: null text has no words; null lang is `und`; repeated rows count as often as they occur; a word of any length
is a word; an empty table gives no rows; extra columns are ignored. Equal scores are ordered by a, then by the phrase's bytes.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Scratch, table
from .tokens import mix

#: Words whose windows a task counts at a time.
CHUNK = 3_000_000
#: Bytes of a text as they count: A-Z in lower case, separators as line ends, tabs as blanks.
BYTES = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Numbers(dict):
    """Numbers of words, from 1 on, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self) + 1
        return out


def lead_columns(stream: array, max_words: int) -> list[np.ndarray]:
    """The windows of a stream of word numbers, in which each piece ends with max_words - 1 zeros: column k has the k-th words."""
    whole = np.frombuffer(stream, np.uint32).astype(np.int64)
    n = len(whole) - max_words + 1
    leads = [whole[k : k + n] for k in range(max_words)]
    opens = leads[0] > 0
    leads = [x[opens] for x in leads]
    for x, y in zip(leads, leads[1:]):
        y[x == 0] = 0  # what follows the piece's end is no part of the window
    return leads


def summed(columns: list[np.ndarray], counts: np.ndarray, base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of numbers below `base`, in their order, with the sums of their counts."""
    key, bound = columns[0], base
    for x in columns[1:]:
        if bound * base >= 1 << 63:
            values, key = np.unique(key, return_inverse=True)
            bound = len(values)
        key, bound = key * base + x, bound * base
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return [x[order[heads]] for x in columns], np.add.reduceat(counts[order], heads) if len(heads) else counts


def blocks(lang: str, numbers: Numbers, stream: array, max_words: int, parts: int) -> Iterator[tuple[int, str, int, bytes]]:
    """The counted windows of a stream as compressed blocks, one for each part; a part has all windows of its first two words."""
    if not stream:
        return
    columns = lead_columns(stream, max_words)
    columns, counts = summed(columns, np.ones(len(columns[0]), np.int64), len(numbers) + 1)
    words = [b"", *numbers]
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    part = (mix(h[columns[0]] * np.uint64(0x9E3779B97F4A7C15) + h[columns[1]] + np.uint64(zlib.crc32(lang.encode()) << 32)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ends = np.flatnonzero(np.r_[part[order][1:] != part[order][:-1], True]) + 1
    for low, high in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
        some = order[low:high]
        own = [x[some] for x in columns]
        used = np.unique(np.concatenate(own))
        raw = b"".join([np.array([len(some), len(used)], "<u4").tobytes(), *[np.searchsorted(used, x).astype("<u4").tobytes() for x in own], counts[some].astype("<u4").tobytes(), b" ".join(words[i] for i in used.tolist())])
        yield int(part[some[0]]), lang, len(raw), pa.compress(raw, codec="zstd", asbytes=True)


class Gathered:
    """Windows of one part and language: distinct rows with sums, compacted whenever ROWS more have come."""

    ROWS = 2_000_000

    def __init__(self, max_words: int):
        self.numbers, self.n, self.more = Numbers(), max_words, 0
        self.columns: list[list[np.ndarray]] = [[] for _ in range(max_words)]
        self.counts: list[np.ndarray] = []

    def add(self, size: int, blob: bytes) -> None:
        raw = memoryview(pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True))
        rows, used = np.frombuffer(raw, "<u4", 2).tolist()
        words = bytes(raw[8 + 4 * rows * (self.n + 1) :]).split(b" ")
        own = np.fromiter((self.numbers[w] if w else 0 for w in words), np.int64, used)
        for k in range(self.n):
            self.columns[k].append(own[np.frombuffer(raw, "<u4", rows, 8 + 4 * rows * k)])
        self.counts.append(np.frombuffer(raw, "<u4", rows, 8 + 4 * rows * self.n).astype(np.int64))
        self.more += rows
        if self.more > self.ROWS:
            self.compact()

    def compact(self) -> None:
        columns, counts = summed([np.concatenate(x) for x in self.columns], np.concatenate(self.counts), len(self.numbers) + 1)
        self.columns, self.counts, self.more = [[x] for x in columns], [counts], 0

    def levels(self, lang: str, min_count: int) -> Iterator[pa.RecordBatch]:
        """Phrases of two words and more that occur min_count times, and the sums of each first word."""
        self.compact()
        columns, counts = [x[0] for x in self.columns], self.counts[0]
        names = pa.array([None, *self.numbers], pa.binary()).view(pa.string())
        while columns:
            m = len(columns)
            kept = counts >= (min_count if m > 1 else 0)
            for x in columns[1:]:
                kept &= x > 0
            rows, f = np.stack([x[kept] for x in columns], axis=1), counts[kept]
            for k in range(0, len(rows), 100_000):
                some = rows[k : k + 100_000]
                ends = pa.array(np.arange(0, len(some) * m + 1, m), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.ListArray.from_arrays(ends, names.take(pa.array(some.reshape(-1)))), pa.array(f[k : k + 100_000])], ["lang", "words", "f"])
            columns = columns[:-1]
            if columns:
                columns, counts = summed(columns, counts, len(self.numbers) + 1)


def phrase_counts(scratch: Scratch, docs: DataFrame, max_words: int, min_count: int, chunk: int = CHUNK) -> DataFrame:
    """lang, words (array), f: the phrases of 1 to max_words words that occur min_count times, and one row without words for all words of a lang."""
    gap = [0] * (max_words - 1)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams: dict[str, tuple[Numbers, array]] = {}
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for of, (numbers, stream) in streams.items():
                for block in blocks(of, numbers, stream, max_words, parts):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(block, (pa.int32(), pa.string(), pa.int32(), pa.binary()), strict=True)], ["part", "lang", "size", "block"])

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                for lang, text in zip(*[c.slice(k, 64).to_pylist() for c in batch.columns], strict=True):
                    numbers, stream = streams.setdefault("und" if lang is None else lang, (Numbers(), array("I")))
                    before = len(stream)
                    for piece in (text or "").encode().translate(BYTES).split(b"\n"):
                        if words := piece.split():
                            stream.extend(map(numbers.__getitem__, words))
                            stream.extend(gap)
                    n += len(stream) - before
                if n >= chunk:
                    yield from flush()
                    streams, n = {}, 0
        yield from flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = None, {}
        for batch in batches:
            for of, lang, size, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if of != part:
                    for name, rows in found.items():
                        yield from rows.levels(name, min_count)
                    part, found = of, {}
                found.setdefault(lang, Gathered(max_words)).add(size, blob)
        for name, rows in found.items():
            yield from rows.levels(name, min_count)

    counted = docs.select("lang", "text").mapInArrow(count, "part int, lang string, size int, block binary")
    met = counted.repartition(parts, "part").sortWithinPartitions("part")
    levels = scratch.table(met.mapInArrow(gather, "lang string, words array<string>, f long"), "levels")
    first = levels.where("size(words) = 1").select("lang", F.col("words")[0].alias("w1"), "f")
    short = first.groupingSets([["lang", "w1"], ["lang"]], "lang", "w1").agg(F.sum("f").alias("f"))  # GROUP BY lang, ROLLUP (w1)
    short = short.select("lang", F.array_compact(F.array("w1")).alias("words"), "f").where((F.size("words") == 0) | (F.col("f") >= min_count))
    return short.unionByName(levels.where("size(words) > 1"))


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(spark: SparkSession, docs: DataFrame, max_words: int = 3, min_count: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """The first `top` phrases of 2 to max_words words of each lang: lang, rank, phrase, a, l, r, n, score.

    share: a phrase goes if a longer one that contains it has at least so many hundredths of its occurrences."""
    scratch = Scratch(spark, "collocations")
    kept = phrase_counts(scratch, docs, max_words, min_count)
    frequent = scratch.table(kept.select("lang", "words", _joined(F.col("words")).alias("phrase"), F.size("words").alias("m"), "f"), "frequent")
    parts = frequent.where("m > 0").select("lang", "phrase", "f")
    totals = frequent.where("m = 0").select("lang", F.col("f").alias("n"))
    candidates = frequent.where("m > 1")

    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("m") - k + 1), lambda i: _joined(F.slice("words", i, k))))))
    within = candidates.where("m > 2").select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    left = candidates.join(within, ["lang", "phrase"], "left").where(F.expr(f"longest is null or 100 * longest < {int(share)} * f"))

    k = F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")
    cuts = left.select("lang", "phrase", "words", F.col("f").alias("a"), "m", k)
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.slice("words", 1, F.col("k"))).alias("head"), _joined(F.slice("words", F.col("k") + 1, F.col("m") - F.col("k"))).alias("tail"))
    cuts = cuts.join(parts.toDF("lang", "head", "l"), ["lang", "head"]).join(parts.toDF("lang", "tail", "r"), ["lang", "tail"])
    wide = {c: F.col(c).cast("decimal(18,0)") for c in "alr"}
    over, under = (F.lit(1_000_000).cast("decimal(7,0)") * wide["a"] * wide["a"]), wide["l"] * wide["r"]
    cuts = cuts.withColumns({"over": over, "under": under}).withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE = r"""
with pieces as (
    select coalesce(lang, 'und') as lang,
        unnest(regexp_split_to_array(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from words),
counts as (
    select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase, count(*) as f
    from starts, (values (1), (2), (3)) sizes(m) where i + m - 1 <= len(w) group by all),
totals as (select lang, sum(f)::bigint as n from counts where m = 1 group by lang),
candidates as (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from counts where m > 1 and f >= 10),
inner_phrases as (
    select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase, a from candidates where m = 3),
kept as (
    select c.* from candidates c
    left join (select lang, phrase, max(a) as longest from inner_phrases group by all) i on c.lang = i.lang and c.phrase = i.phrase
    where longest is null or 100 * longest < 50 * a),
cuts as (
    select lang, phrase, a, k, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:m], ' ') as tail
    from kept, (values (1), (2)) places(k) where k < m),
scored as (
    select c.lang, c.phrase, a, k, x.f as l, y.f as r, ((1000000::hugeint * a * a) // (x.f::hugeint * y.f))::bigint as score
    from cuts c join counts x on c.lang = x.lang and c.head = x.phrase join counts y on c.lang = y.lang and c.tail = y.phrase),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""
