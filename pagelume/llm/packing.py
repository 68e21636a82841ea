"""Operator 2: packing token streams into sequences of bounded length.

The ids of a partition's documents, in order, form one stream. Order-preserving dynamic programming chooses the cuts:
f(j) = min over i, p_j - p_i <= L, of f(i) + padding(p_j - p_i) + penalty(j), where the candidates p are document ends
(no penalty), sentence ends (a small one) and, inside sentences longer than `hard_every` ids, fixed steps (a larger one).
Padding is L - (p_j - p_i), so the transition takes the least f(i) + p_i in a sliding window: a monotone queue.
Blocks of the stream are solved one after the other; the open end of a block is carried into the next. What is left at
the end of a partition is written as sequences whose lengths are powers of two, which need no padding.

Scale: one pass over the scan's own partitions, no shuffle; memory is one block and one document's ids. The result
depends on the partitioning but is always a whole and valid packing, and the same for a retried task.

Defined cases: null or empty text has the end id alone; repeated rows are packed each; null doc_id passes through;
an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_characters
from .store import table
from .tokens import tokenizer_json, vocabulary_path

LENGTH = 2048
END_ID = 1
#: Penalties of a cut, in padding ids.
SENTENCE, HARD = 4, 12
HARD_EVERY = 32
#: str.split() takes these for white space, the library doesn't.
ODD_BLANKS = re.compile("[\x1c-\x1f]")
#: Marks that stand alone after a word.
MARKS = tuple(".,;:!?")
#: Ids of one block of the dynamic programme.
BLOCK = 1 << 17


class Known(dict):
    """Part of a text -> bytes of its ids. A part not seen yet gets an empty bytearray and a place in `new`, to be filled."""

    def __init__(self):
        super().__init__()
        self.new: dict[str, bytearray] = {}

    def __missing__(self, part: str) -> bytearray:
        self.new[part] = self[part] = out = bytearray()
        return out


class WordIds:
    """Bounded cache from white-space separated parts to ids' bytes; misses go to the tokenizers library together."""

    BOUND = 900_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.known = Known()
        model = json.loads(json.dumps(tokenizer_json(path)))
        self.added = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.pieces = regex.compile(model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        vocab = model["model"]["vocab"]
        self.ends = np.zeros(max([*vocab.values(), *self.added.values()]) + 1, bool)
        self.stops = self.ends.copy()
        for s, i in vocab.items():
            self.ends[i] = s.endswith("</w>")
            self.stops[i] = bool(regex.search(r"[.!?]+[\"')]*</w>$", s))
        # The same model on text that is already normalised and cut: the library's merges without its normalisers.
        model |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "truncation": None, "padding": None}
        self.library = Tokenizer.from_str(json.dumps(model))
        letters = byte_characters()
        self.letters = {b: letters[b] for b in range(256)}

    def spelled(self, word: str) -> str:
        """A pre-token in the byte-level alphabet."""
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)

    def fill(self, parts: list[tuple[str, list[str]]], new: dict[str, bytearray]) -> None:
        """Ids of parts that are given with their pre-tokens."""
        joined = " ".join([self.spelled(w) for _, ws in parts for w in ws])
        ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        raw, k = ids.tobytes(), 0
        ends = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()] if len(ids) else [0]
        for p, ws in parts:
            self.known[p] = made = raw[ends[k] : ends[k + len(ws)]]
            k += len(ws)
            if p in new:
                new[p] += made

    def learn(self) -> None:
        """Fills what the last texts had that was new."""
        new, self.known.new = self.known.new, {}
        marked = [p for p in new if p[-1] in MARKS and p[:-1].isalpha()]
        alone = [p for p in new if p.isalpha()] + list({p[:-1] for p in marked if p[:-1] not in self.known})
        known = {*alone, *marked, *MARKS}
        rest = [p for p in new if p not in known]
        self.fill([*[(p, [p]) for p in alone], *[(m, [m]) for m in MARKS], *[(p, self.pieces.findall(p)) for p in rest if p[0] != " "]], new)
        made = {p: self.known[p[:-1]] + self.known[p[-1]] for p in marked} | {p: self.added[p[1:]].to_bytes(4, "little") for p in rest if p[0] == " "}
        for p, raw in made.items():
            new[p] += raw
        self.known.update(made)

    def split(self, text: str) -> list[str]:
        """Normalised parts whose ids don't depend on each other. Added tokens become parts of their own, marked by a leading blank."""
        if any(s in text for s in self.added):
            bits = self.cut.split(text)
            return [y for i, x in enumerate(bits) for y in ([" " + x] if i % 2 else self.split(x))]
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if ODD_BLANKS.search(text):
            return [p for p in regex.split(r"\p{White_Space}+", text) if p]
        return text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids' bytes of each text, for some texts at a time."""
        if len(self.known) > self.BOUND:
            self.known.clear()
        found = [list(map(self.known.__getitem__, self.split(t))) for t in texts]
        if self.known.new:
            self.learn()
        return [b"".join(x) for x in found]


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cut_points(ids: np.ndarray, stops: np.ndarray, hard_every: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a document's ids where a sequence may end, and their penalties; the last is the document's end."""
    n = len(ids)
    ends = np.flatnonzero(stops[ids[: n - 1]]) + 1
    places = np.append(ends, n)
    penalties = np.full(len(places), SENTENCE)
    penalties[-1] = 0
    gaps = np.diff(places, prepend=0)
    if gaps.max() > hard_every:
        more = (gaps - 1) // hard_every
        first = np.repeat(places - gaps, more)
        step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        places = np.concatenate([places, first + step * hard_every])
        penalties = np.concatenate([penalties, np.full(len(step), HARD)])
        order = np.argsort(places, kind="stable")
        places, penalties = places[order], penalties[order]
    return places, penalties


def best_cuts(places: list[int], penalties: list[int], length: int) -> list[int]:
    """Indexes into `places` (ascending, places[0] = 0) of the cuts of a best packing that leaves at most `length` ids of
    [0, places[-1]) open at its end."""
    cost = [0] * len(places)
    back = [0] * len(places)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (f(i) + p_i, p_i, i), growing in the first and the second
    for j in range(1, len(places)):
        p = places[j]
        low = p - length
        while queue[0][1] < low:
            queue.popleft()
        least, _, i = queue[0]
        cost[j] = f = least + length - p + penalties[j]
        back[j] = i
        value = f + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, p, j))
    j = len(places) - 1
    j = min((i for i in range(j, -1, -1) if places[j] - places[i] <= length), key=cost.__getitem__)
    out = []
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


class Packer:
    """Collects documents and gives out finished pieces."""

    def __init__(self, length: int, partition: int, with_ids: bool):
        self.length, self.sequence, self.with_ids = length, partition << 40, with_ids
        self.docs: deque = deque()  # [doc_id, ids, first place in the stream, n ids]
        self.places, self.penalties = [0], [0]
        self.at = 0  # stream place up to which sequences are given out
        self.end = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray, places: np.ndarray, penalties: np.ndarray) -> None:
        self.docs.append((doc_id, ids, self.end))
        self.places += (places + self.end).tolist()
        self.penalties += penalties.tolist()
        self.end += len(ids)
        if self.end - self.at >= BLOCK:
            self.solve(False)

    def emit(self, until: int) -> None:
        """One sequence from self.at to `until`."""
        first = self.at
        while self.at < until:
            doc_id, ids, start = self.docs[0]
            a, b = self.at - start, min(until - start, len(ids))
            raw = ids[a:b].tobytes()
            self.rows.append((doc_id, a, b - a, zlib.crc32(raw), len(ids), self.sequence, self.at - first, *([raw] if self.with_ids else [])))
            self.at = start + b
            if b == len(ids):
                self.docs.popleft()
        self.sequence += 1

    def solve(self, last: bool) -> None:
        base = self.places[0]
        cuts = best_cuts([p - base for p in self.places], self.penalties, self.length)
        for j in cuts:
            self.emit(self.places[j])
        if cuts:
            self.places, self.penalties = self.places[cuts[-1] :], self.penalties[cuts[-1] :]
        if last:
            rest = self.end - self.at
            for bit in range(rest.bit_length() - 1, -1, -1):
                if rest >> bit & 1:
                    self.emit(self.at + (1 << bit))


def pack(df: DataFrame, length: int = LENGTH, vocabulary: str = "word_bpe_49k.json", end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `with_ids` the ids themselves
    (binary, little-endian unsigned 32-bit). `length` is a power of two."""
    path = vocabulary_path(vocabulary)
    df = df.select("doc_id", "text")
    kind = df.schema["doc_id"].dataType
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        packer = Packer(length, TaskContext.get().partitionId(), with_ids)

        def flush(id_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [[] for _ in names]
            packer.rows = []
            types = [id_type, *[pa.int64()] * 6, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                ids = words.encode([t or "" for t in part.column(1).to_pylist()])
                for doc_id, raw in zip(part.column(0).to_pylist(), ids, strict=True):
                    tokens = np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id)).astype("<u4")
                    packer.add(doc_id, tokens, *cut_points(tokens, words.stops, min(HARD_EVERY, length)))
                if len(packer.rows) >= 5_000:
                    yield flush(id_type)
        packer.solve(True)
        if id_type is not None:
            yield flush(id_type)

    return df.mapInArrow(run, f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", F.col("text")))
