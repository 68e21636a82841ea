"""Operator 3: byte-level BPE encoding and decoding.

Encoding keeps the symbols of a pre-token in a doubly linked list and a priority queue of (merge rank, position);
an entry whose pair has changed meanwhile is stale and skipped. Decoding concatenates vocabulary byte strings.
Every text is a row of its own: no shuffle, no state between rows but a bounded cache of pieces.

Defined cases: null text is the empty text (no ids, decoded ''); a text of any length is encoded whole; a string of the
added special token in a text becomes that token, as the tokenizers library does; repeated rows give repeated rows;
extra columns pass through, and columns named like the outputs are replaced.
"""

from __future__ import annotations

import functools
import heapq
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import table
from .tokens import tokenizer_json, vocabulary_path

PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Where two white-space characters meet, a piece may reach across the places at which `_encode` cuts a text.
RUNS = regex.compile(r"  |\n\n| \n|\n ")

#: Texts of one batch that goes back to Spark.
ROWS = 500


def byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on in their order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BytePairs(dict):
    """Vocabulary and merges of one file; as a dict, a bounded cache from parts of a text to their ids' bytes."""

    BOUND = 400_000

    def __init__(self, path: str):
        model = tokenizer_json(path)
        self.vocab: dict[str, int] = model["model"]["vocab"]
        self.letters = byte_characters()
        self.start = [self.vocab.get(self.letters[b]) for b in range(256)]
        self.merges: dict[int, int] = {}  # (left id, right id) as one integer -> rank
        self.made: list[int] = []  # rank -> id of the merged symbol
        for rank, m in enumerate(model["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[self.vocab[a] << 32 | self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        self.added = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pieces = regex.compile(PIECES)
        self.words: dict[str, bytes] = {}
        back = {c: b for b, c in self.letters.items()}
        size = max([*self.vocab.values(), *self.added.values()]) + 1
        self.strings = [b""] * size
        for s, i in self.vocab.items():
            self.strings[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        for s, i in self.added.items():
            self.strings[i] = s.encode()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. The queue holds rank << 32 | position; current[i] is the rank of the pair that starts at i."""
        start = self.start
        ids = [start[b] for b in piece]
        n = len(ids)
        rank_of, made = self.merges.get, self.made
        current = [rank_of(a << 32 | b, -1) for a, b in zip(ids, ids[1:])]
        queue = [r << 32 | i for i, r in enumerate(current) if r >= 0]
        if not queue:
            return ids
        current.append(-1)
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while queue:
            top = pop(queue)
            i = top & 0xFFFFFFFF
            rank = top >> 32
            if current[i] != rank:
                continue  # stale: one of the two symbols was merged meanwhile
            j = after[i]
            ids[i] = new = made[rank]
            ids[j] = current[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                current[i] = r = rank_of(new << 32 | ids[k], -1)
                if r >= 0:
                    push(queue, r << 32 | i)
            else:
                current[i] = -1
            h = before[i]
            if h >= 0:
                current[h] = r = rank_of(ids[h] << 32 | new, -1)
                if r >= 0:
                    push(queue, r << 32 | h)
        return [x for x in ids if x >= 0]

    def part(self, text: str) -> bytes:
        out: list[bytes] = []
        words = self.words
        for piece in self.pieces.findall(text):
            if (got := words.get(piece)) is None:
                got = array("I", self.merge(piece.encode())).tobytes()
                if len(piece) < 64:
                    if len(words) >= self.BOUND:
                        words.clear()
                    words[piece] = got
            out.append(got)
        return b"".join(out)

    def __missing__(self, part: str) -> bytes:
        out = self.part(part if part[:1] == "\n" else " " + part)
        if len(part) < 64:
            if len(self) >= self.BOUND:
                self.clear()
            self[part] = out
        return out

    def plain(self, text: str) -> bytes:
        """A text without added tokens. Parts between single spaces or line ends never share a piece."""
        if not text:
            return b""
        if RUNS.search(text):
            return self.part(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        if not first:  # the text starts with white space
            return b"".join(map(self.__getitem__, rest))
        return self.part(first) + b"".join(map(self.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.cut or not any(s in text for s in self.added):
            return self.plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self.plain(text[at : m.start()]), self.added[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)


def _appended(df: DataFrame, source: str, name: str, kind: T.DataType, arrow: pa.DataType, each) -> DataFrame:
    """df with a column `name` that `each()` makes of the values of `source`, task by task."""
    kept = [c for c in df.columns if c.lower() != name.lower()]
    df = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, source])])
    columns, drop = df.columns, source not in kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = each()
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                made = pa.array([convert(v.as_py()) for v in batch.column(columns.index(source))], arrow)
                arrays = [batch.column(i) for i, c in enumerate(columns) if not (drop and c == source)]
                yield pa.RecordBatch.from_arrays([*arrays, made], [*[c for c in columns if not (drop and c == source)], name])

    fields = [f for f in df.schema.fields if not (drop and f.name == source)]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(name, kind)]))


def bpe_encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """df with the ids of each text: binary, little-endian unsigned 32-bit integers."""
    path = vocabulary_path(vocabulary)

    def each():
        pairs = byte_pairs(path)
        return lambda v: pairs.encode(v or "")

    return _appended(df, text, ids, T.BinaryType(), pa.binary(), each)


def bpe_decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """df with the text of each row's ids; bytes that are no UTF-8 become U+FFFD."""
    path = vocabulary_path(vocabulary)

    def each():
        pairs = byte_pairs(path)
        return lambda v: pairs.decode(v or b"")

    return _appended(df, ids, decoded, T.StringType(), pa.string(), each)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    both = bpe_decode(encoded.select("doc_id", "ids"))
    return both.select(
        "doc_id",
        F.expr("cast(length(ids) / 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
