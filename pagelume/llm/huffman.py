"""Operator 11: token ids as binary files, by canonical length-limited Huffman codes.

Writing has three passes. Documents are dealt by ranges of doc_id and sorted, and their ids are cut at document ends into
runs of at least RUN_IDS ids, a row each, in a scratch table. The ids of that table are counted (one partial count for each
task and id), and package-merge gives each id of the vocabulary a code length of at most LIMIT bits; lengths alone fix
the codes (canonical order: length, then id). A run is then one section of a file: its documents, the bit offset of every
block of BLOCK ids, and the bits. Reading decodes all blocks of a section side by side with one table of 2^LIMIT entries.

File: MAGIC, then length and bytes of a zlib-compressed codebook (LIMIT, ids, lengths), then sections. A section has a
header (HEADER: documents, ids, blocks, bytes, number of ids before it, crc32 of its bytes), doc_ids (signed 64 bit) with a
byte each for null, their numbers of ids (unsigned 64 bit), block offsets in bits (unsigned 64 bit) and the bits, first bit
highest. All integers are little-endian. A section needs nothing of another one, only the codebook of its file.

Ids come from a column of binary values (little-endian unsigned 32-bit integers), or from texts. Texts are encoded as the
tokenizers library does with the same file. Its own encoder takes 0.8 - 1.1 CPU seconds a MB; this uses tiktoken's (0.2)
with the merges of that file and the library itself where tiktoken gives up (long runs of white space); tests hold both equal.

Scale: the sort is the only shuffle of texts. What reaches the driver is bounded by the vocabulary (counts; at most
MAX_VOCABULARY different ids, more raise) and by the number of partitions (their ids, for the starts). Tasks hold one run:
RUN_IDS ids and the rest of its last document. Files have names of their task's attempt and only those in the manifest of
finished tasks are read, so a lost executor leaves files that nobody reads.

Defined cases: null text is the empty text (its document has the end id alone); null ids are no ids; documents with a null
doc_id come first; rows that repeat a doc_id are documents of their own, in the order of their hashes, then texts; an empty
table gives no file; a text of any length is one document; extra columns are ignored.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, qualified, table
from .tokens import tokenizer_json, vocabulary_path
from .warc import file_system

#: Bits of the longest code.
LIMIT = 20
#: Ids between two bit offsets.
BLOCK = 512
#: Ids of a section, but for the rest of its last document.
RUN_IDS = 1 << 22
#: Bytes from which on a file is closed.
ROLL_BYTES = 64 << 20
#: Different ids that a codebook may have.
MAX_VOCABULARY = 1 << LIMIT
MAGIC = b"IDS-HUFFMAN-1\n"
HEADER = struct.Struct("<QQQQQI")
#: Ids that are packed at a time.
PACKED = 1 << 20

RUN_ROW = "part int, before long, doc_ids array<long>, lengths array<long>, width int, ids binary"


# ---- ids of texts -----------------------------------------------------------------------------------------------------


class Encoder:
    """Ids of a text as the tokenizers library gives them for one byte-level BPE file."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        from .bpe import byte_characters

        back = {c: b for b, c in byte_characters().items()}
        model = tokenizer_json(path)
        added = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(back[c] for c in s): i for s, i in model["model"]["vocab"].items() if s not in added}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # a run that the pattern's engine can't take back
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# ---- the code ---------------------------------------------------------------------------------------------------------


def code_lengths(weights: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code lengths of least total weight, none over `limit` (package-merge). weights: positive, at most 2^limit of them."""
    n = len(weights)
    if n > 1 << limit:
        raise ValueError(f"{n} different ids don't fit into codes of {limit} bits")
    if n < 2:
        return np.ones(n, np.uint8)
    order = np.argsort(weights, kind="stable")
    leaves = weights[order].astype(np.int64)
    row, kinds = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        row = both[by]
        kinds.append(by < n)
    lengths, take = np.zeros(n, np.uint8), 2 * n - 2
    for leaf in reversed(kinds):
        k = int(leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out = np.empty(n, np.uint8)
    out[order] = lengths
    return out


class Codebook:
    """The canonical code of sorted ids with given lengths."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, limit: int = LIMIT):
        self.limit, self.ids, self.lengths = limit, ids.astype(np.uint32), lengths.astype(np.uint8)

    @functools.cached_property
    def order(self) -> np.ndarray:
        """Places of the ids in the order of their codes."""
        return np.lexsort((self.ids, self.lengths))

    @functools.cached_property
    def spans(self) -> np.ndarray:
        """Entries of the table that a code covers, in the order of the codes."""
        return np.int64(1) << (self.limit - self.lengths[self.order]).astype(np.int64)

    @functools.cached_property
    def by_id(self) -> tuple[np.ndarray, np.ndarray]:
        """Code and length at each id up to the largest."""
        size = int(self.ids.max()) + 1 if len(self.ids) else 1
        codes, lengths = np.zeros(size, np.uint64), np.zeros(size, np.uint8)
        first = np.cumsum(self.spans) - self.spans
        length = self.lengths[self.order]
        codes[self.ids[self.order]] = first >> (self.limit - length).astype(np.int64)
        lengths[self.ids] = self.lengths
        return codes, lengths

    @functools.cached_property
    def decoding(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length for each value of the next `limit` bits."""
        ids, lengths = np.zeros(1 << self.limit, np.uint32), np.zeros(1 << self.limit, np.int64)
        n = int(self.spans.sum())
        if n > 1 << self.limit:
            raise ValueError("code lengths that no prefix code has")
        ids[:n], lengths[:n] = np.repeat(self.ids[self.order], self.spans), np.repeat(self.lengths[self.order].astype(np.int64), self.spans)
        return ids, lengths

    def to_bytes(self) -> bytes:
        return zlib.compress(struct.pack("<II", self.limit, len(self.ids)) + self.ids.astype("<u4").tobytes() + self.lengths.tobytes())

    @staticmethod
    def from_bytes(raw: bytes) -> Codebook:
        raw = zlib.decompress(raw)
        limit, n = struct.unpack_from("<II", raw)
        return Codebook(np.frombuffer(raw, "<u4", n, 8), np.frombuffer(raw, np.uint8, n, 8 + 4 * n), limit)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of ids, and the bit offset of every block of BLOCK ids."""
        codes, lengths = self.by_id
        out, offsets, carry, at = [], [], 0, 0  # carry: bits of the last word so far, as its value
        for k in range(0, len(ids), PACKED):
            some = ids[k : k + PACKED]
            length = lengths[some].astype(np.int64)
            end = np.cumsum(length) + (at & 31)
            start = end - length
            offsets.append(start[::BLOCK] + (at & ~31))
            value = codes[some] << (64 - (start & 31) - length).astype(np.uint64)
            word = start >> 5
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            pairs = np.zeros(int(end[-1] >> 5) + 2, np.uint64)
            pairs[word[heads]] = np.bitwise_or.reduceat(value, heads)
            pairs[0] |= np.uint64(carry << 32)
            words = (pairs >> np.uint64(32)).astype(np.uint32)
            words[1:] |= (pairs[:-1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            full = int(end[-1] >> 5)
            out.append(words[:full].astype(">u4").tobytes())
            carry, at = int(words[full]), (at & ~31) + int(end[-1])
        if at & 31:
            out.append(carry.to_bytes(4, "big")[: ((at & 31) + 7) // 8])
        return b"".join(out), np.concatenate(offsets or [np.zeros(0, np.int64)])

    def unpack(self, bits: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """The n ids of packed bits: step k decodes the k-th id of every block."""
        table_ids, table_lengths = self.decoding
        raw = np.frombuffer(bits + bytes(BLOCK * self.limit // 8 + 8), np.uint8)
        out = np.empty((len(offsets), BLOCK), np.uint32)
        shift = np.uint32(32 - self.limit)
        for low in range(0, len(offsets), 4096):
            position = offsets[low : low + 4096].astype(np.int64)
            first = int(position[0] >> 3)
            last = min(len(raw), int(position[-1] >> 3) + BLOCK * self.limit // 8 + 8)
            part = raw[first:last].astype(np.uint32)
            window = part[:-3] << np.uint32(24) | part[1:-2] << np.uint32(16) | part[2:-1] << np.uint32(8) | part[3:]
            position -= first * 8
            for k in range(BLOCK):
                next_bits = (window[position >> 3] << (position & 7).astype(np.uint32)) >> shift
                out[low : low + 4096, k] = table_ids[next_bits]
                position += table_lengths[next_bits]
            full = position[: max(0, min(len(offsets) - 1 - low, 4096))]
            if (full + first * 8 != offsets[low + 1 : low + 1 + len(full)]).any():
                raise ValueError("a block doesn't end where the next one begins")
        return out.reshape(-1)[:n]


# ---- sections ---------------------------------------------------------------------------------------------------------


def section(book: Codebook, before: int, doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    bits, offsets = book.pack(ids)
    parts = [
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is None for x in doc_ids], np.uint8).tobytes(),
        np.array(lengths, "<u8").tobytes(),
        offsets.astype("<u8").tobytes(),
        bits,
    ]
    body = b"".join(parts)
    return HEADER.pack(len(doc_ids), len(ids), len(offsets), len(body), before, zlib.crc32(body)) + body


def sections(stream) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """Ids before it, doc_ids, lengths and ids of each section of a file; one at a time."""

    def read(n: int) -> bytes:
        got = stream.read(n)
        if len(got) != n:
            raise ValueError("the file ends inside a section")
        return got

    if read(len(MAGIC)) != MAGIC:
        raise ValueError("no file of ids")
    book = Codebook.from_bytes(read(struct.unpack("<I", read(4))[0]))
    while head := stream.read(HEADER.size):
        if len(head) != HEADER.size:
            raise ValueError("the file ends inside a section")
        n_docs, n_ids, n_blocks, n_bytes, before, crc = HEADER.unpack(head)
        body = read(n_bytes)
        if zlib.crc32(body) != crc:
            raise ValueError("a section doesn't have its checksum")
        nulls = np.frombuffer(body, np.uint8, n_docs, 8 * n_docs)
        doc_ids = [None if null else x for x, null in zip(np.frombuffer(body, "<i8", n_docs).tolist(), nulls, strict=True)]
        lengths = np.frombuffer(body, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        offsets = np.frombuffer(body, "<u8", n_blocks, 17 * n_docs).astype(np.int64)
        yield before, doc_ids, lengths, book.unpack(body[17 * n_docs + 8 * n_blocks :], offsets, n_ids)


def _runs(path: str | None, end_id: int | None, run_ids: int):
    """For mapInArrow: rows RUN_ROW of sorted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, n = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        arrays: list[np.ndarray] = []
        end = np.array([] if end_id is None else [end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([np.zeros(0, np.uint32), *arrays])
            width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
            values = [part], [before], [doc_ids], [[len(x) for x in arrays]], [width], [ids.astype(f"<u{width}").tobytes()]
            kinds = pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["part", "before", "doc_ids", "lengths", "width", "ids"])

        encode = encoder(path).ids if path else None
        for batch in batches:
            for k in range(batch.num_rows):
                value = batch.column(1)[k].as_py()
                ids = encode(value or "") if encode else np.frombuffer(value or b"", "<u4")
                arrays.append(np.concatenate([ids, end]))
                doc_ids.append(batch.column(0)[k].as_py())
                n += len(arrays[-1])
                if n >= run_ids:
                    yield flush()
                    before, n, doc_ids, arrays = before + n, 0, [], []
        if doc_ids:
            yield flush()

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, int] = {}
    dense = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for k in range(batch.num_rows):
            width = batch.column(0)[k].as_py()
            ids = np.frombuffer(batch.column(1)[k].as_buffer(), f"<u{width}")
            if width == 2:
                dense += np.bincount(ids, minlength=1 << 16)
            else:
                for i, c in zip(*[x.tolist() for x in np.unique(ids, return_counts=True)]):
                    total[i] = total.get(i, 0) + c
    for i in np.flatnonzero(dense).tolist():
        total[i] = total.get(i, 0) + int(dense[i])
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["id", "n"])


def write_ids(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int | None = None, limit: int = LIMIT, run_ids: int = RUN_IDS, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Files of ids below `folder`, in ascending doc_id order; the manifest (path, start, n_documents, n_ids, n_bytes), lazy.

    docs: doc_id and ids (binary), or with `vocabulary` (a byte-level BPE file of the tokenizers library) doc_id and text.
    `end_id` is appended to each document."""
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    value = F.col("text" if vocabulary else "ids")
    key = F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(key, value.alias("value"), F.xxhash64(value).alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "value").select("doc_id", "value")
    scratch = Scratch(spark, "ids")
    runs = scratch.table(rows.mapInArrow(_runs(vocabulary and vocabulary_path(vocabulary), end_id, run_ids), RUN_ROW), "runs")

    counted = runs.select("width", "ids").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id")
    counts = counted.limit(MAX_VOCABULARY + 1).collect()  # bounded: one row for each id of the vocabulary
    if len(counts) > min(MAX_VOCABULARY, 1 << limit):
        raise ValueError(f"more than {min(MAX_VOCABULARY, 1 << limit)} different ids")
    ids, n = (np.array([r[i] for r in counts], np.int64) for i in (0, 1))
    book = Codebook(ids, code_lengths(n, limit), limit)
    coded = book.to_bytes()

    total = F.max(F.col("before") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))
    starts, at = {}, 0
    for part, size in sorted(map(tuple, runs.groupBy("part").agg(total).collect())):  # bounded: one row for each partition
        starts[part], at = at, at + size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebook.from_bytes(coded)
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        context = TaskContext.get()
        done: list[list] = []
        out, last = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                part, before, doc_ids, lengths, width = (batch.column(i)[k].as_py() for i in range(5))
                values = np.frombuffer(batch.column(5)[k].as_buffer(), f"<u{width}")
                if out is not None and (done[-1][4] >= roll_bytes or last != (part, before)):
                    out.close()
                    out = None
                start = starts[part] + before
                if out is None:
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(done):04d}-{uuid.uuid4().hex[:8]}.ids"
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                    head = MAGIC + struct.pack("<I", len(coded)) + coded
                    out.write(head)
                    done.append([f"{folder}/{name}", start, 0, 0, len(head)])
                raw = section(own, start, doc_ids, lengths, values)
                out.write(raw)
                last = part, before + len(values)
                for i, x in ((2, len(doc_ids)), (3, len(values)), (4, len(raw))):
                    done[-1][i] += x
        if out is not None:
            out.close()
        kinds = pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate(kinds)], ["path", "start", "n_documents", "n_ids", "n_bytes"])

    return runs.mapInArrow(run, "path string, start long, n_documents long, n_ids long, n_bytes long")


def read_ids(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """The documents of the manifest's files: doc_id, start, n_tokens, ids_crc32, and ids (binary, little-endian unsigned 32-bit)."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inside = file_system(path)
                with system.open_input_stream(inside, compression=None) as stream:
                    for before, doc_ids, lengths, ids in sections(stream):
                        raw = memoryview(ids.astype("<u4")).cast("B")
                        ends = np.cumsum(lengths)
                        bodies = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                        for k in range(0, len(doc_ids), 1000):
                            some = slice(k, k + 1000)
                            values = [doc_ids[some], (ends - lengths)[some] + before, lengths[some], [zlib.crc32(b) for b in bodies[some]], [bytes(b) for b in bodies[some]] if with_ids else None]
                            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names)

    return manifest.select("path").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op11_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "huffman")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = scratch.table(write_ids(docs, scratch.path("ids"), "byte_bpe_50k.json", end_id=2), "manifest")
    return read_ids(manifest, with_ids=False)
