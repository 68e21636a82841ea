"""Small helpers on tokenizer files and on words inside one task."""

from __future__ import annotations

import functools
import json

import numpy as np


def vocabulary_path(name: str) -> str:
    """Place of a public tokenizer file; a path (anything with a slash) is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def tokenizer_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class WordHashes(dict):
    """word -> 64-bit hash, the same in every task; emptied when it grows past its bound."""

    BOUND = 500_000

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.BOUND:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


_HASHES = WordHashes()
#: Odd multipliers of the word positions in a shingle, from a fixed seed.
_MIX = np.random.default_rng(20_240_501).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def distinct_hashes(words: list[str]) -> np.ndarray:
    """word_hashes of many words at once, each distinct one hashed once; quicker than a table where most words are seldom."""
    import pyarrow as pa
    import xxhash

    coded = pa.array(words, pa.string()).dictionary_encode()
    _, offsets, data = coded.dictionary.buffers()
    ends, data = np.frombuffer(offsets, np.int32)[: len(coded.dictionary) + 1].tolist(), data.to_pybytes() if data else b""
    found = map(xxhash.xxh3_64_intdigest, map(data.__getitem__, map(slice, ends, ends[1:])))
    return np.fromiter(found, np.uint64, len(coded.dictionary))[coded.indices.to_numpy()]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word runs, one for each start."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n] * _MIX[0]
    for i in range(1, k):
        out += h[i : n + i] * _MIX[i]
    return mix(out)
