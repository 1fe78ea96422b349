"""Words of many texts at once, as 64-bit hashes, without a Python object for each.

Arrow splits the texts and finds the different words of a batch; numpy hashes their bytes, one position of all words at a time (FNV-1a, then
mixed). Words of over LONG bytes are hashed by xxhash. The hash of a word never has all of its upper half zero, so zeros may stand for padding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

LONG = 48
#: The constants of 64-bit FNV-1a.
FNV_START, FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (h ^ (h >> np.uint64(32))) | np.uint64(1 << 32)


def spans(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of an array of strings, and where each string begins and ends in them."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at[:-1], at[1:]


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes."""
    n = end - start
    order = np.argsort(-np.minimum(n, LONG), kind="stable")
    s, sizes = start[order], n[order]
    h = np.full(len(n), FNV_START)
    active = len(n) - np.searchsorted(np.minimum(sizes, LONG)[::-1], np.arange(LONG), side="right")
    for k in range(LONG):
        m = int(active[k])
        if not m:
            break
        h[:m] = (h[:m] ^ data[s[:m] + k]) * FNV_PRIME
    out = np.empty(len(n), np.uint64)
    out[order] = h
    for i in np.flatnonzero(n > LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return mixed(out)


def word_hashes(texts: pa.Array, lower: bool = False, indexed: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of the words (runs of anything but ASCII white space) of texts without nulls, one text after another, and how many each has.

    With indexed: the hashes of the different words, which of them each word is, and how many each text has.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    if not len(flat):
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64))
        return none if indexed else none[::2]
    found = flat.dictionary_encode()
    data, start, end = spans(found.dictionary)
    at = found.indices.to_numpy()
    is_word = (end > start)[at]  # white space at a text's ends leaves empty strings
    before = np.append(0, np.cumsum(is_word))
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    hashes, at, n = byte_hashes(data, start, end), at[is_word], np.diff(before[offsets])
    return (hashes, at, n) if indexed else (hashes[at], n)
