"""Operator 9: exact substring deduplication through prefix-free parsing.

Phrases: a rolling hash of GRAM bytes is computed at every place; the trigger of a window of MATCH bytes is the least hash
in it. Which trigger a window has depends on its bytes alone, so the windows of a document fall into runs with one trigger
each: the phrases. The parse is the list of (document, place, phrase); the dictionary holds each distinct phrase once, with
the number of its places in the parse. All windows of a phrase with two places are repeated.

Order: equal windows of different phrases have one trigger at one place in relation to it, so the corpus order is needed
only among the phrases of a trigger, and only to the depth of a window. A window is a suffix of what its phrase has before
the trigger, followed by a prefix of what the parse spells from the trigger on. Two suffix arrays are built for each trigger:
of the parts before it (the dictionary's suffixes that end there, in order of their reversed bytes) and of the parts from it on
(the parse's continuations, as far as a window reaches), each with the common lengths of neighbours. At depth s the windows
with s bytes before the trigger are equal where both arrays have them in one interval of common lengths of at least s and
MATCH - s. So equality is decided by bytes, and the two orders combine as an order of corpus windows.

Scale: triggers that occur once (most of a corpus) drop out after one shuffle of 32 bytes for some eighty bytes of text;
only documents with a repeated trigger are parsed further. Where all places of a trigger have one phrase (by a hash of 64 bits
beside the trigger's), it covers all of them at once, and its bytes aren't moved. Copies are counted before the shuffle, so the dictionary has
one row for any number of them. Phrases of a trigger are sorted in two shards, of phrases that share at least 120 bytes around
it. A trigger with more than HOT places and several phrases (a frequent line in ever other surroundings) is never gathered: its windows
become rows of 128-bit hashes that Spark counts with partial sums, so nothing but the number of rows grows.

Defined cases: null text is empty; a text under MATCH bytes is kept; rows that repeat an id and text are each other's
copies; matches never cross documents; a cut inside a UTF-8 character drops the rest of the character in the text form; an
empty table gives an empty result; ids of any type; extra columns pass through, those named like a result are replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Scratch, table
from .tokens import mix

MATCH = 200
GRAM = 48
#: Bytes of text that one vectorised step takes; places in it fit into PLACE_BITS.
STEP = 1 << 19
PLACE_BITS = 20
#: Shards of a trigger's windows, by their place in relation to it.
SHARDS = 2
#: A trigger of several phrases with more places than this has the windows of its distinct phrases counted as rows.
HOT = 20_000
RESULTS = ("_n_bytes", "_n_removed", "_n_spans", "_kept")

_BASE = 0x9E3779B97F4A7C15
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64."""
    if n not in _POWERS:
        out = []
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            a = np.full(n, b, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _POWERS.clear()
        _POWERS[n] = out[0], out[1]
    return _POWERS[n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    up, _ = powers(STEP + 4 * MATCH)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the spans of `length` bytes, independent of where they start."""
    _, down = powers(STEP + 4 * MATCH)
    return mix((prefix[starts + length] - prefix[starts]) * down[starts])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def steps(texts: list[bytes], match: int) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray]]:
    """Parts (text, its place in the text, its place in the buffer) of texts, together at most STEP bytes and a match."""
    parts, chunks, size = [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - match + 1), STEP):
            piece = t[at : at + STEP + match - 1]
            if len(piece) < match:
                continue
            if size and size + len(piece) > STEP:
                yield parts, np.frombuffer(b"".join(chunks), np.uint8)
                parts, chunks, size = [], [], 0
            parts.append((k, at, size))
            chunks.append(piece)
            size += len(piece)
    if parts:
        yield parts, np.frombuffer(b"".join(chunks), np.uint8)


def phrases(texts: list[bytes], match: int = MATCH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (text, place of the first window, number of windows, place of the trigger in the phrase, trigger's hash)."""
    width = match - gram + 1
    for parts, data in steps(texts, match):
        hashes = span_hashes(prefix_hashes(data), np.arange(len(data) - gram + 1), gram)
        ranked = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(hashes), dtype=np.uint64)
        least = sliding_least(ranked, width)
        trigger = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)  # by window
        starts = np.array([p[2] for p in parts])
        ends = np.append(starts[1:], len(data)) - match  # last window of each part
        new = np.ones(len(trigger), bool)
        new[1:] = trigger[1:] != trigger[:-1]
        new[starts] = True
        valid = np.zeros(len(trigger) + 1, np.int64)
        valid[starts] += 1
        np.add.at(valid, ends + 1, -1)
        inside = np.cumsum(valid)[:-1] > 0
        new[1:] |= inside[1:] != inside[:-1]
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(trigger)))
        ok = inside[first]
        first, n = first[ok], n[ok]
        part = np.searchsorted(starts, first, side="right") - 1
        text = np.array([p[0] for p in parts])[part]
        place = first - starts[part] + np.array([p[1] for p in parts])[part]
        yield text, place, n, trigger[first] - first, hashes[trigger[first]]


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [(t or "").encode() for t in batch.column(column).to_pylist()]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def phrase_hashes(data: list[bytes], text: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(data[k][a : a + w]) for k, a, w in zip(text.tolist(), place.tolist(), size.tolist(), strict=True)), np.uint64, len(text))


def _triggers(match: int, gram: int):
    """(trigger, d, t, n, phrase): the triggers of each text, once, with the number of phrases that have them and the hash of the
    phrase; none where there are different ones in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            d, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = _texts(batch, 2)
            for text, place, w, _, h in phrases(texts, match, gram):
                p = phrase_hashes(texts, text, place, w + match - 1)
                order = np.lexsort((p, h, text))
                text, h, p = text[order], h[order], p[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                at = np.flatnonzero(new)
                end = np.append(at[1:], len(h)) - 1
                columns = [h[at].view(np.int64), d[text[at]], t[text[at]], (end - at + 1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(p[at].view(np.int64), mask=p[at] != p[end])], ["trigger", "d", "t", "n", "phrase"])

    return run


#: Kinds of repeated triggers: of one phrase, of several, and of so many places that nothing may gather them.
ONE, SEVERAL, MANY = 0, 1, 2


def _wanted(batch: pa.RecordBatch, texts: list[bytes], match: int, gram: int, kinds: str) -> Iterator[tuple[np.ndarray, ...]]:
    """What phrases() has for the triggers in the rows' lists, and the kind; the lists' columns are `triggers`, in the order of kinds."""
    lists = [batch.column(f"triggers{k}") for k in kinds]
    of = mix(np.arange(len(texts), dtype=np.uint64))
    keys = [x.flatten().to_numpy().view(np.uint64) ^ np.repeat(of, np.diff(x.offsets.to_numpy())) for x in lists]
    for text, place, n, at, h in phrases(texts, match, gram):
        key = h ^ of[text]
        for k, wanted in zip(kinds, keys, strict=True):
            keep = np.flatnonzero(np.isin(key, wanted))
            if len(keep):
                yield (*(x[keep] for x in (text, place, n, at, h)), int(k))


def _parse(match: int, gram: int, with_bytes: bool):
    """The phrases of each text whose trigger has several phrases."""
    names = ["trigger", "phrase", "d", "t", "place", *(["kind", "n", "at", "bytes"] if with_bytes else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            d, t, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _texts(batch, 2)
            for text, place, n, at, h, kind in _wanted(batch, texts, match, gram, "12"):
                spans = [texts[k][a : a + w] for k, a, w in zip(text.tolist(), place.tolist(), (n + match - 1).tolist(), strict=True)]
                ids = pa.array([xxhash.xxh3_128_digest(s) for s in spans], pa.binary())
                columns = [pa.array(h.view(np.int64)), ids, pa.array(d[text]), pa.array(t[text]), pa.array(place)]
                if with_bytes:
                    columns += [pa.array(np.full(len(n), kind, np.int32)), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(spans, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _whole(match: int, gram: int):
    """(d, t, a, b): what the phrases of triggers that have one phrase only cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            d, t, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _texts(batch, 2)
            for text, place, n, _, _, _ in _wanted(batch, texts, match, gram, "0"):
                end = place + n + match - 1
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (place[1:] > end[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(text)) - 1
                yield pa.RecordBatch.from_arrays([*map(pa.array, (d[text[first]], t[text[first]], place[first], end[last]))], ["d", "t", "a", "b"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: int, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups of a stream sorted by the column `key`, of some `rows` rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            whole = pa.Table.from_batches(held)
            keys = whole.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut:
                yield whole.slice(0, cut)
            held = whole.slice(cut).to_batches()
            size = whole.num_rows - cut
    if size:
        yield pa.Table.from_batches(held)


def suffix_array(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings, and the length that each in this order has in common with the one before it (0 for the first)."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    sizes = np.array([len(parts[i]) for i in order])
    width = int(sizes.max(initial=0))
    table_ = np.zeros((len(parts), width + 1), np.uint8)
    first = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) - np.repeat(first, sizes)
    table_[np.repeat(np.arange(len(parts)), sizes), at] = np.frombuffer(b"".join([parts[i] for i in order]), np.uint8)
    table_[:, width] = np.arange(len(parts)) % 2  # so that equal rows differ here
    common = np.zeros(len(parts), np.int64)
    common[1:] = np.minimum((table_[1:] != table_[:-1]).argmax(axis=1), np.minimum(sizes[1:], sizes[:-1]))
    return np.array(order, np.int64), common


def equal_windows(group: np.ndarray, before: list[bytes], after: list[bytes], low: np.ndarray, high: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, s) of the windows of s bytes of `before` (its last ones) and match - s of `after` that two rows of a group have;
    s is from low to high."""
    keys = [int(g).to_bytes(8, "big") for g in group]
    k = len(keys)
    place, common, most = [], [], []
    for parts in ([g + x[::-1] for g, x in zip(keys, before, strict=True)], [g + x for g, x in zip(keys, after, strict=True)]):
        order, shared = suffix_array(parts)
        shared -= 8  # the group's key; less than nothing between groups
        where = np.empty(k, np.int64)
        where[order] = np.arange(k)
        best = np.empty(k, np.int64)
        best[order] = np.maximum(shared, np.append(shared[1:], -8))
        place.append(where), common.append(shared), most.append(best)
    low, high = np.maximum(low, match - most[1]), np.minimum(high, most[0])
    rows, depths = [], []
    able = np.flatnonzero(low <= high)
    for s in range(int(low[able].min(initial=match)), int(high[able].max(initial=-1)) + 1):
        at = able[(low[able] <= s) & (s <= high[able])]
        if len(at) < 2:
            continue
        left = np.cumsum(common[0] < s)[place[0][at]]
        right = np.cumsum(common[1] < match - s)[place[1][at]]
        both = left * (k + 1) + right
        order = np.argsort(both, kind="stable")
        same = both[order[1:]] == both[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        rows.append(at[twice]), depths.append(np.full(twice.sum(), s))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *depths])


def _equal_windows(match: int):
    """(phrase, lo, hi): runs of a phrase's windows that stand in another phrase of the same shard too."""

    def solve(whole: pa.Table) -> pa.RecordBatch:
        key = whole.column("shard").to_numpy()
        group = np.cumsum(np.append(0, key[1:] != key[:-1]))
        several = np.flatnonzero(np.bincount(group)[group] > 1)
        whole, group = whole.take(pa.array(several)), group[several]
        at, n, low, high = (whole.column(c).to_numpy().astype(np.int64) for c in ("at", "n", "low", "high"))
        spans = whole.column("bytes").to_pylist()
        before = [x[:i] for x, i in zip(spans, at.tolist(), strict=True)]
        after = [x[i:] for x, i in zip(spans, at.tolist(), strict=True)]
        row, depth = equal_windows(group, before, after, np.maximum(low, at - n + 1), np.minimum(high, at), match)
        offset = at[row] - depth
        order = np.lexsort((offset, row))
        row, offset = row[order], offset[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row))[: len(first)] - 1
        ids = whole.column("phrase").take(pa.array(row[first])).combine_chunks()
        return pa.RecordBatch.from_arrays([ids, pa.array(offset[first].astype(np.int32)), pa.array(offset[last].astype(np.int32))], ["phrase", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _groups(batches, 0):
            yield solve(whole)

    return run


def _window_rows(match: int):
    """(window, phrase, place): a row for each window of each phrase, with a hash of 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 64):
            phrases_, counts, spans = batch.column("phrase"), batch.column("n").to_pylist(), batch.column("bytes").to_pylist()
            hashes = [xxhash.xxh3_128_digest(x[i : i + match]) for x, n in zip(spans, counts, strict=True) for i in range(n)]
            rows = np.repeat(np.arange(len(counts)), counts)
            place = np.concatenate([np.arange(n, dtype=np.int32) for n in counts])
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), phrases_.take(pa.array(rows)), pa.array(place)], ["window", "phrase", "place"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _remove(columns: list[str], source: int, cover: int, as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            total, removed, runs, kept = [], [], [], []
            for raw, spans in zip(_texts(batch, source), batch.column(cover).to_pylist(), strict=True):
                cut = merged([(x["a"], x["b"]) for x in spans or []])
                edges = [0, *[y for x in cut for y in x], len(raw)]
                left = b"".join([raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)])
                total.append(len(raw)), removed.append(len(raw) - len(left)), runs.append(len(cut))
                kept.append(left.decode("utf-8", "ignore") if as_text else hashlib.sha256(left).hexdigest())
            arrays = [batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string())], [*columns, "_n_bytes", "_n_removed", "_n_spans", "_kept"])

    return run


def repeated_spans(spark: SparkSession, docs: DataFrame, scratch: Scratch, match: int = MATCH, gram: int = GRAM) -> DataFrame:
    """(d, t, cover): for each id and text hash with repeated windows, the byte spans that they cover."""
    found = scratch.table(docs.mapInArrow(_triggers(match, gram), "trigger long, d long, t long, n int, phrase long"), "triggers")
    several = F.max(F.col("phrase").isNull()) | (F.min("phrase") != F.max("phrase"))
    often = found.groupBy("trigger").agg(F.sum("n").alias("n"), several.alias("several")).where("n > 1")
    kind = F.when(~F.coalesce("several", F.lit(True)), ONE).when(F.col("n") <= HOT, SEVERAL).otherwise(MANY)
    often = scratch.table(often.select("trigger", kind.alias("kind")), "often")  # tables, so that Spark can split the joins where a trigger or phrase has very many places
    lists = [F.collect_set(F.when(F.col("kind") == k, F.col("trigger"))).alias(f"triggers{k}") for k in (ONE, SEVERAL, MANY)]
    wanted = found.select("trigger", "d", "t").join(often, "trigger").groupBy("d", "t").agg(*lists)
    held = scratch.table(docs.join(wanted, ["d", "t"]).select("d", "t", "text", *wanted.columns[2:]), "held")
    scratch.drop(found, often)
    dictionary = held.where("size(triggers1) + size(triggers2) > 0").mapInArrow(_parse(match, gram, True), "trigger long, phrase binary, d long, t long, place long, kind int, n int, at int, bytes binary")
    dictionary = dictionary.groupBy("trigger", "phrase").agg(F.count(F.lit(1)).alias("places"), *[F.first(c).alias(c) for c in ("kind", "n", "at", "bytes")])
    dictionary = scratch.table(dictionary, "dictionary")
    whole = dictionary.where("places > 1").select("phrase", F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi"))
    width = match - gram + 1
    rows = dictionary.where(F.col("kind") == SEVERAL).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))))
    rows = rows.withColumn("low", F.expr(f"cast({width} * j div {SHARDS} as int)")).withColumn("high", F.expr(f"cast({width} * (j + 1) div {SHARDS} as int) - 1"))
    rows = rows.where("least(high, at) >= greatest(low, at - n + 1)")
    rows = rows.withColumn("shard", F.xxhash64("trigger", "j", F.expr(f"substring(bytes, at - low + 1, {match} - high + low)")))
    rows = rows.select("shard", "phrase", "at", "n", "low", "high", "bytes").repartition("shard").sortWithinPartitions("shard")
    partly = rows.mapInArrow(_equal_windows(match), "phrase binary, lo int, hi int")
    hot = dictionary.where(F.col("kind") == MANY).select("phrase", "n", "bytes", "places")
    windows = hot.mapInArrow(_window_rows(match), "window binary, phrase binary, place int")
    again = scratch.table(windows.groupBy("window").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("window"), "windows")
    open_ = hot.where("places = 1").mapInArrow(_window_rows(match), "window binary, phrase binary, place int")
    partly = partly.unionByName(open_.join(again, "window").select("phrase", F.col("place").alias("lo"), F.col("place").alias("hi")))
    ranges = whole.unionByName(partly).groupBy("phrase").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    ranges = scratch.table(ranges, "ranges")
    places = held.where("size(triggers1) + size(triggers2) > 0").mapInArrow(_parse(match, gram, False), "trigger long, phrase binary, d long, t long, place long").select("phrase", "d", "t", "place")
    spans = places.join(ranges, "phrase").select("d", "t", F.explode(F.transform("ranges", lambda r: F.struct((F.col("place") + r["lo"]).alias("a"), (F.col("place") + r["hi"] + match).alias("b")))).alias("s"))
    covered = held.where("size(triggers0) > 0").mapInArrow(_whole(match, gram), "d long, t long, a long, b long")
    spans = spans.unionByName(covered.select("d", "t", F.struct("a", "b").alias("s")))
    cover = scratch.table(spans.groupBy("d", "t").agg(F.collect_set("s").alias("cover")), "cover")
    scratch.drop(held, dictionary, again, ranges)
    return cover


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("d", F.xxhash64("doc_id")).withColumn("t", F.xxhash64(F.coalesce("text", F.lit(""))))


def _removed(spark: SparkSession, docs: DataFrame, match: int, gram: int, as_text: bool) -> DataFrame:
    """The columns of docs as c0, c1, ... and RESULTS."""
    scratch = Scratch(spark, "suffix")
    cover = repeated_spans(spark, keyed(docs.select("doc_id", "text")).select("d", "t", "text"), scratch, match, gram)
    columns = docs.columns
    plain = [f"c{i}" for i in range(len(columns))]
    key = keyed(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(p) for c, p in zip(columns, plain, strict=True)])).select("d", "t", *plain)
    joined = key.join(cover, ["d", "t"], "left").select(*plain, "cover")
    schema = T.StructType([*joined.schema.fields[:-1], T.StructField("_n_bytes", T.LongType()), T.StructField("_n_removed", T.LongType()), T.StructField("_n_spans", T.LongType()), T.StructField("_kept", T.StringType())])
    return joined.mapInArrow(_remove(plain, columns.index("text"), len(columns), as_text), schema)


def remove_repeats(spark: SparkSession, docs: DataFrame, match: int = MATCH, gram: int = GRAM, as_text: bool = True) -> DataFrame:
    """docs with _n_bytes, _n_removed, _n_spans, _kept (the text without repeated bytes, or its SHA-256)."""
    out = _removed(spark, docs, match, gram, as_text)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in RESULTS], *RESULTS)


def without_repeats(spark: SparkSession, docs: DataFrame, match: int = MATCH, gram: int = GRAM) -> DataFrame:
    """docs, their texts without repeated bytes."""
    out = _removed(spark, docs, match, gram, True)
    return out.select(*[F.col("_kept" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), as_text=False)
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.col("_kept").alias("kept_sha256"))
