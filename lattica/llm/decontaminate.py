"""Benchmark decontamination by templates.

Texts become templates: numbers, units after numbers, and names (capitalised words inside a
sentence) turn into typed placeholders, other words are lower-cased and hashed, punctuation is left out. A capitalised word that
begins a sentence is read both as a word and as a name. Windows of WINDOW template tokens with LITERALS plain words or more are hash-joined:

1. The windows of all items are written, and a bit filter of them, of at most ``filter_bytes`` whatever the benchmark's size.
2. One pass over the documents leaves the windows that pass the filter (hits), each with its tokens' values. Texts are not shuffled.
3. An item must be covered in ``similarity`` of its tokens. So a document that has none of the windows over some
   tokens, more than the rest of them, cannot leak it. For each item those tokens are chosen whose windows have the fewest hits, and only
   documents with one of these windows are joined with the item: phrases that everybody uses join nothing.
4. All hits of the document and item pairs left are joined, and slots are checked.

The hits of a document and an item that lie within ``gap`` tokens of each other are a candidate passage. It counts as
a leak if its windows cover ``similarity`` of the item's tokens, and its slots are
consistent: a value of the item always stands for the same value of the document and the other
way round, in ``agreement`` of the slots. Where the slots of all its hits are not, the hits are chained along rising positions of
document and item, and each chain is a passage of its own: an item may repeat a window with other
values, and variants of it may follow one another. So a question asked with other numbers and names is caught, and a
mere likeness of form is not.

Items that windows can't cover so far (short ones, and those of numbers and names nearly alone) are joined by a hash of all
their values, of any length: they leak where some successive sentences or lines of a document are the same, word for word and number for number; items of fewer
than SENTENCE tokens only where the whole text is.

Items with equal templates and values are one item, with the smallest item_id.

Defined cases: null texts are empty, and an item without tokens is not used. Rows that
repeat an id give rows of their own. Null item ids are not used; a null document id stays null. Empty tables give no rows.
Ties between passages: the one that begins first. Columns that clash in name don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import Rows, open_fs, resident, scratch, stored, whole_text
from lattica.llm.words import byte_hashes, spans

WINDOW = 5
LITERALS = 2
SIMILARITY = 0.8
AGREEMENT = 0.9
GAP = 20
SHIFT = 0.1
SENTENCE = 3
BATCH = 1000
FILTER_BYTES = 64 << 20
PROBES = 3
SLICE = 1 << 17

#: Units that count as such after a number.
UNITS = set(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces "
    "ms s sec min h hr hrs d second seconds minute minutes hour hours day days week weeks month months year years "
    "ml l cl liter liters litre litres gallon gallons k c f degree degrees percent usd eur gbp dollar dollars euro euros cent cents "
    "hz khz mhz ghz w kw mw v a ohm j kj n pa bar b kb mb gb tb bit bits byte bytes kmh kph mph".split()
)
TOKEN = regex.compile(r"\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
CAPITAL, NUMBER, UNIT, ENDS, BREAK = 1, 2, 4, 8, 16
KINDS = 31
QUOTES, SENTENCE_ENDS = "\"')]»”’", (".", "!", "?", ":", "…")
CLOSING = set(QUOTES) | set(SENTENCE_ENDS)
#: Flags of a token: it is a slot; it is capitalised and begins a sentence; a sentence begins with it; one ends with it.
IS_SLOT, IS_INITIAL, FIRST, LAST = 1, 2, 4, 8
NUMBER_SLOT, UNIT_SLOT, NAME_SLOT = (np.uint64(xxhash.xxh64_intdigest(x)) for x in ("<number>", "<unit>", "<name>"))
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _kinds_of_bytes() -> np.ndarray:
    """For each ASCII byte: 0 no part of a plain piece, 1 a small letter, 2 a capital, 3 ends a sentence, 4 a quote or bracket that may follow, 5 other punctuation."""
    kind = np.zeros(256, np.uint8)
    kind[0x21:0x7F] = 5
    kind[ord("0") : ord("9") + 1] = 0
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1] = 1, 2
    kind[[ord(c) for c in ".!?:"]], kind[[ord(c) for c in QUOTES if c.isascii()]] = 3, 4
    return kind


BYTES = _kinds_of_bytes()
MOST_BYTES = 40


def token_hashes(tokens: list[str]) -> np.ndarray:
    """Value hashes of lower-case tokens; the low bits are free for the kind."""
    return byte_hashes(*spans(pa.array([*tokens, ""], pa.string())))[:-1] & ~np.uint64(KINDS)


UNIT_HASHES = np.sort(token_hashes(sorted(UNITS)))


def _plain(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the pieces that are one word of Latin letters and ASCII punctuation after it, which these are, and which have punctuation only."""
    data, start, end = spans(pieces)
    data = np.append(data, np.uint8(0))  # so that an empty piece has a byte too
    kind = BYTES[data]
    # two-byte letters from U+00C0 on, without the signs for times and divided by
    lead = np.append((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7), False)
    tail = np.append(False, lead[:-1])
    capital = (kind == 2) | (tail & (data < 0x9F))
    letter = (kind == 1) | (kind == 2) | lead | tail
    letters, marks = (np.append(0, np.cumsum(x, dtype=np.int32)) for x in (letter, kind >= 3))
    n = end - start
    n_letters, n_marks = letters[end] - letters[start], marks[end] - marks[start]
    known = (n > 0) & (n <= MOST_BYTES) & (n_letters + n_marks == n)
    last = kind[end - (n > 0)]
    fit = np.flatnonzero(known & (n_letters > 0) & (letters[start + np.where(known, n_letters, 0)] - letters[start] == n_letters) & (last != 4))
    s, e = start[fit], start[fit] + n_letters[fit]
    values = byte_hashes(data | (capital << 5).astype(np.uint8), s, e) & ~np.uint64(KINDS)
    at = np.minimum(np.searchsorted(UNIT_HASHES, values), len(UNIT_HASHES) - 1)
    kinds = CAPITAL * capital[s + lead[s]] + UNIT * (UNIT_HASHES[at] == values) + ENDS * (last[fit] == 3)
    return values | kinds.astype(np.uint64), fit, np.flatnonzero(known & (n_letters == 0) | (n == 0))


def _tokens(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all pieces one after another, value hashes with kinds in the low bits, and how many each has."""
    values, fit, empty = _plain(pieces)
    n = np.full(len(pieces), -1)
    n[fit], n[empty] = 1, 0
    others = np.flatnonzero(n < 0)
    tokens, kinds = [], []
    for i, piece in zip(others.tolist(), pieces.take(pa.array(others)).to_pylist(), strict=True):
        found = ["\n"] if piece == "\n" else TOKEN.findall(piece)
        n[i] = len(found)
        for token in found:
            low = token.lower()
            tokens.append(low)
            kinds.append(BREAK if token == "\n" else NUMBER if token[0].isnumeric() else CAPITAL * token[0].isupper() | UNIT * (low in UNITS))
        if found and piece[-1] in CLOSING and piece.rstrip(QUOTES)[-1:] in SENTENCE_ENDS:
            kinds[-1] |= ENDS
    out = np.zeros(int(n.sum()), np.uint64)
    start = np.append(0, np.cumsum(n)[:-1])
    out[start[fit]] = values
    slow = np.repeat(start[others], n[others]) + np.arange(len(tokens)) - np.repeat(np.append(0, np.cumsum(n[others])[:-1]), n[others]) if len(tokens) else []
    if len(tokens):
        out[slow] = token_hashes(tokens) | np.array(kinds, np.uint64)
    return out, n


class Templates:
    """The tokens of some texts one after another: text, template hash, value hash and flags of each, and where a text's begin."""

    def __init__(self, texts: list[str] | pa.Array):
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        # a break before each text and at each line's end
        lists = pc.split_pattern(pc.binary_join_element_wise("\n ", pc.replace_substring(column, "\n", " \n "), ""), " ")
        found = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy() - (lists.offsets[0].as_py() or 0)
        flat, n = _tokens(found.dictionary) if len(found) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        at = found.indices.to_numpy()
        each, first = n[at], np.append(0, np.cumsum(n)[:-1]).astype(np.int64)[at] if len(n) else np.zeros(0, np.int64)
        before = np.append(0, np.cumsum(each)).astype(np.int64)
        both = flat[np.repeat(first - before[:-1], each) + np.arange(before[-1])]
        sizes = np.diff(before[offsets]) if len(texts) else np.zeros(0, np.int64)
        values, kinds = both & ~np.uint64(KINDS), (both & np.uint64(KINDS)).astype(np.uint8)
        before, after = np.append(BREAK, kinds[:-1]).astype(np.uint8), np.append(kinds[1:], BREAK).astype(np.uint8)
        number = kinds & NUMBER > 0
        unit = (kinds & UNIT > 0) & (before & NUMBER > 0)
        capital = (kinds & CAPITAL > 0) & ~unit
        first = before & (ENDS | BREAK) > 0
        name = capital & ~first
        template = np.where(number, NUMBER_SLOT, np.where(unit, UNIT_SLOT, np.where(name, NAME_SLOT, values)))
        flags = IS_SLOT * (number | unit | name) + IS_INITIAL * (capital & ~name) + FIRST * first + LAST * ((kinds & ENDS > 0) | (after & BREAK > 0))
        own = kinds & BREAK == 0
        self.text = np.repeat(np.arange(len(texts)), sizes)[own]
        self.template, self.values, self.flags = template[own], values[own], flags[own].astype(np.uint8)
        self.begin = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all windows with enough plain words, in either reading of words that begin sentences."""
        n = len(self.text) - WINDOW + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        inside = self.text[WINDOW - 1 :] == self.text[:n]
        slot, initial = self.flags & IS_SLOT > 0, self.flags & IS_INITIAL > 0
        sums = [np.append(0, np.cumsum(x, dtype=np.int32)) for x in (slot, initial)]
        slots, initials = (x[WINDOW:] - x[:-WINDOW] for x in sums)
        one = np.flatnonzero(inside & (slots <= WINDOW - LITERALS))
        two = np.flatnonzero(inside & (initials > 0) & (slots + initials <= WINDOW - LITERALS))
        h = _hashed([self.template[i : i + n] for i in range(WINDOW)])[one]
        named = np.where(initial, NAME_SLOT, self.template)
        return np.concatenate([one, two]), np.concatenate([h, _hashed([named[two + i] for i in range(WINDOW)])])

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """From these the hash of the values of any run follows: see ``run_hashes``."""
        powers = np.cumprod(np.full(len(self.values) + 1, BASE))
        return np.append(np.uint64(0), np.cumsum(self.values * powers[:-1])), np.cumprod(np.full(len(self.values) + 1, BACK))

    def wholes(self, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and hashes of the values of successive sentences that have one of the lengths."""
        found = [], [], []
        if lengths and len(self.values):
            sums = self.sums()
            first, last = np.flatnonzero(self.flags & FIRST), self.flags & LAST > 0
            for n in lengths:
                at = first[first + n <= len(self.text)]
                at = at[last[at + n - 1] & (self.text[at] == self.text[at + n - 1])]
                if n < SENTENCE:
                    own = self.text[at]
                    at = at[(self.begin[own] == at) & (self.begin[own + 1] == at + n)]
                found[0].append(at)
                found[1].append(np.full(len(at), n))
                found[2].append(run_hashes(sums, at, n))
        return tuple(np.concatenate([np.zeros(0, k), *x]) for x, k in zip(found, (np.int64, np.int64, np.uint64), strict=True))


def _hashed(tokens: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(tokens[0]), np.uint64)
    for t in tokens:
        h *= BASE
        h += t
        h ^= h >> np.uint64(29)
    return h


def run_hashes(sums: tuple[np.ndarray, np.ndarray], at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n values from each position on, whatever stands before."""
    h = (sums[0][at + n] - sums[0][at]) * sums[1][at]
    return h ^ (h >> np.uint64(31)) ^ np.uint64(n)


def _probe(h: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The place of the i-th bit of each hash."""
    return ((h * BASE >> np.uint64(11 * i)) & np.uint64(bits - 1)).astype(np.int64)


ITEMS = "item long, size int, one long, two long, template binary, values binary, flags binary"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of items, from (item, text)."""
    names = [x.split()[0] for x in ITEMS.split(", ")]
    for b in batches:
        for lo in range(0, b.num_rows, BATCH):
            own = b.slice(lo, BATCH)
            t = Templates(own.column(1))
            rows = []
            for item, x, y in zip(own.column(0).to_pylist(), t.begin[:-1].tolist(), t.begin[1:].tolist(), strict=True):
                if y > x:
                    parts = [a[x:y].tobytes() for a in (t.template, t.values, t.flags)]
                    rows.append((item, y - x, xxhash.xxh64_intdigest(parts[0] + parts[1]) - (1 << 63), xxhash.xxh64_intdigest(parts[0] + parts[1], 1) - (1 << 63), *parts))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3), strict=True)], names)


ITEM_WINDOWS = "h long, n int, item long, start int, size int, item_values binary, item_flags binary"


def _windows_of(values: np.ndarray, flags: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    at = starts[:, None] + np.arange(WINDOW)
    return list(map(bytes, values[at])), list(map(bytes, flags[at]))


def _item_windows(similarity: float):
    """The windows of items that they cover, and a hash of all values of others (n: its length; 0 for windows)."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int32()), ("item", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("item_values", pa.binary()), ("item_flags", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                t = Templates([])
                t.template, t.values = np.frombuffer(r["template"], np.uint64), np.frombuffer(r["values"], np.uint64)
                t.flags, t.text = np.frombuffer(r["flags"], np.uint8), np.zeros(r["size"], np.int64)
                starts, h = t.windows()
                if len(covered(starts)) >= similarity * r["size"]:
                    values, flags = _windows_of(t.values, t.flags, starts)
                    n = 0
                else:
                    starts, n, h = np.zeros(1, np.int64), r["size"], run_hashes(t.sums(), np.zeros(1, np.int64), r["size"])
                    values = flags = [None]
                columns = [h.view(np.int64), np.full(len(h), n, np.int32), np.full(len(h), r["item"]), starts.astype(np.int32), np.full(len(h), r["size"], np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(values, pa.binary()), pa.array(flags, pa.binary())], schema=schema)

    return run


def covered(starts: np.ndarray) -> np.ndarray:
    return np.unique(starts[:, None] + np.arange(WINDOW))


def _slice_bits(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(SLICE, bool)
    bits[rows["at"].to_numpy() % SLICE] = True
    return pd.DataFrame({"slice": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def _write_filter(windows: DataFrame, bits: int, uri: str) -> None:
    """The bits of all window hashes, in slices, built by executors."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([_probe(h, i, bits) for i in range(PROBES)])))], ["at"])

    at = windows.select("h").mapInArrow(places, "at long").distinct()
    at.groupBy((F.col("at") / SLICE).cast("long").alias("slice")).applyInPandas(_slice_bits, "slice long, bits binary").write.parquet(uri)


@resident(maxsize=1)
def _read_filter(uri: str, bits: int) -> np.ndarray:
    """The bits again: at most as many bytes as the filter may have, in each Python worker."""
    out = np.zeros(bits // 8, np.uint8)
    fs, path = open_fs(uri)
    found = pq.read_table(path, filesystem=fs)
    for k, data in zip(found["slice"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[k * SLICE // 8 : (k + 1) * SLICE // 8] = np.frombuffer(data, np.uint8)
    return out


def _passing(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions of the hashes that the filter has."""
    left = np.arange(len(h))
    for i in range(PROBES):
        own = _probe(h[left] if i else h, i, 8 * len(bits))
        left = left[(bits[own >> 3] >> (own & 7).astype(np.uint8)) & 1 > 0]
    return left


HITS = "file long, row long, id long, h long, n int, start int, text_values binary, text_flags binary"


def _hits(uri: str, bits: int, lengths: list[int]):
    """Windows and whole sentences of documents that pass the filter, from (text, file, row, id)."""
    names = [x.split()[0] for x in HITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_filter = _read_filter(uri, bits)
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                own = b.slice(lo, BATCH)
                t = Templates(own.column(0))
                starts, h = t.windows()
                left = _passing(own_filter, h)
                whole = t.wholes(lengths)
                also = _passing(own_filter, whole[2])
                if not len(left) + len(also):
                    continue
                values, flags = _windows_of(t.values, t.flags, starts[left])
                at = np.concatenate([starts[left], whole[0][also]])
                text = t.text[at]
                rows = pa.array(text)
                columns = [*(own.column(i).take(rows) for i in (1, 2, 3)), pa.array(np.concatenate([h[left], whole[2][also]]).view(np.int64))]
                columns += [pa.array(np.concatenate([np.zeros(len(left), np.int32), whole[1][also].astype(np.int32)])), pa.array((at - t.begin[text]).astype(np.int32))]
                none = [None] * len(also)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(values + none, pa.binary()), pa.array(flags + none, pa.binary())], names)

    return run


def rarest(starts: np.ndarray, weights: np.ndarray, size: int, similarity: float) -> np.ndarray:
    """Which windows a document must have one of, to cover so much of an item: those over some successive tokens, with the least weight."""
    need = size - int(np.ceil(similarity * size - 1e-9)) + 1  # without these too few are left
    here = np.bincount(starts, weights, size)
    sums = np.append(0, np.cumsum(here))
    lo = np.arange(size - need + 1)
    begin = np.maximum(0, lo - WINDOW + 1)
    best = int(np.argmin(sums[lo + need] - sums[begin]))
    return np.flatnonzero((starts >= begin[best]) & (starts < best + need))


def _chosen(similarity: float):
    """h, item of the windows that decide which documents to join, from sorted (item, size, start, h, weight)."""

    def one(rows: list[tuple]) -> list[tuple]:
        item, size = rows[0][:2]
        pick = rarest(np.array([r[2] for r in rows]), np.array([r[4] for r in rows], float), size, similarity)
        return sorted({(rows[i][3], item) for i in pick.tolist()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            out: list[tuple] = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][0] != r[0]:
                    out += one(held)
                    held = []
                held.append(r)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["h", "item"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*one(held), strict=True)], ["h", "item"])

    return run


def agreeing(a: np.ndarray, b: np.ndarray) -> float:
    """The share of pairs (a value, b value) that a one-to-one pairing, chosen by count, explains."""
    if not len(a):
        return 1.0
    pairs, n = np.unique(np.stack([a, b], axis=1), axis=0, return_counts=True)
    left, right, right_n = set(), set(), 0
    for (x, y), k in sorted(zip(map(tuple, pairs.tolist()), n.tolist(), strict=True), key=lambda p: (-p[1], p[0])):
        if x not in left and y not in right:
            left.add(x)
            right.add(y)
            right_n += k
    return right_n / len(a)


def chains(d: np.ndarray, q: np.ndarray, reach: int) -> list[np.ndarray]:
    """Alignments of hits (d ascending, then q): positions that rise in document and item, by steps of at most reach tokens of the document.

    A hit scores 1 and a shift between document and item costs SHIFT a token. Chains are read back from their best
    ends; a chain stops where it meets one read before.
    """
    n = len(d)
    score, before = np.ones(n), np.full(n, -1)
    first, same = np.searchsorted(d, d - reach, "left"), np.searchsorted(d, d, "left")
    for k in range(n):
        lo, hi = first[k], same[k]
        if lo < hi:
            gain = np.where(q[lo:hi] < q[k], score[lo:hi] + 1 - SHIFT * np.abs((d[k] - d[lo:hi]) - (q[k] - q[lo:hi])), 0)
            if gain[m := len(gain) - 1 - int(gain[::-1].argmax())] > 1:
                score[k], before[k] = gain[m], lo + m
    used, out = np.zeros(n, bool), []
    for k in np.argsort(-score, kind="stable"):
        own = []
        while k >= 0 and not used[k]:
            used[k] = True
            own.append(k)
            k = before[k]
        if own:
            out.append(np.array(own[::-1]))
    return out


def one_to_one(pairs: np.ndarray) -> np.ndarray:
    """Which of the sorted (document, item) tokens don't fall back or repeat on either side."""
    out, d, q = [], -1, -1
    for k, (x, y) in enumerate(pairs.tolist()):
        if x > d and y > q:
            out.append(k)
            d, q = x, y
    return np.array(out, np.int64)


def best_passage(hits: dict[str, np.ndarray], size: int, similarity: float, agreement: float, gap: int) -> tuple | None:
    """Start, end, similarity, agreement and whether all values are the item's, of the best passage of a document and an item, if it is a leak.

    hits: d, q (window starts in document and item), and for each the tokens' values and flags on either side (dv, df, iv, if_; a row a hit).
    """
    order = np.lexsort((hits["q"], hits["d"]))
    new = np.append(True, (np.diff(hits["d"][order]) != 0) | (np.diff(hits["q"][order]) != 0)) if len(order) else order
    h = {k: v[order][new] for k, v in hits.items()}
    step = np.arange(WINDOW)

    def passage(at: np.ndarray, aligned: bool) -> tuple | None:
        d, q = h["d"][at], h["q"][at]
        share = len(covered(q)) / size
        if share < similarity:
            return None
        pairs, which = np.unique(np.stack([(x[:, None] + step).ravel() for x in (d, q)], axis=1), axis=0, return_index=True)
        if aligned:
            which = which[one_to_one(pairs)]
        a, b, fa, fb = (h[k][at].ravel()[which] for k in ("iv", "dv", "if_", "df"))
        # a word that begins a sentence is a name only where it differs
        own = (fa & fb & IS_SLOT > 0) | ((fa & (IS_SLOT | IS_INITIAL) > 0) & (fb & (IS_SLOT | IS_INITIAL) > 0) & (a != b))
        a, b = a[own], b[own]
        return int(d[0]), int(d[-1]) + WINDOW, share, agreeing(a, b), bool((a == b).all())

    # first with all words as they stand, then with those that begin sentences as names too
    plain = ((h["dv"] == h["iv"]) | (h["df"] & h["if_"] & IS_SLOT > 0)).all(axis=1)
    best = None
    for all_ in (np.flatnonzero(plain), np.arange(len(plain))):
        if not len(all_) or best:
            continue
        cuts = np.flatnonzero(np.diff(h["d"][all_]) > gap + WINDOW) + 1
        for at in np.split(all_, cuts):
            whole = passage(at, False)
            if whole is None:
                continue
            # hits that don't agree as they are may be several passages, or repeat a window of the item
            rows = [whole] if whole[3] >= agreement else [passage(at[c], True) for c in chains(h["d"][at], h["q"][at], gap + WINDOW)]
            for row in rows:
                if row and row[3] >= agreement and (best is None or (-row[2], row[0]) < (-best[2], best[0])):
                    best = row
    return best


LEAKS = "file long, row long, id long, item_id long, start_token long, end_token long, similarity double, agreement double, verbatim boolean"


def _decided(similarity: float, agreement: float, gap: int):
    """Leaks of sorted (file, row, item, id, size, start, item_start, text_values, text_flags, item_values, item_flags)."""
    names = [x.split()[0] for x in LEAKS.split(", ")]
    kinds = [*[pa.int64()] * 6, pa.float64(), pa.float64(), pa.bool_()]

    def one(t: pa.Table) -> tuple | None:
        raw = lambda c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind).reshape(len(t), WINDOW)
        hits = {"d": t["start"].to_numpy().astype(np.int64), "q": t["item_start"].to_numpy().astype(np.int64)}
        if len(covered(hits["q"])) < similarity * t["size"][0].as_py():
            return None
        hits |= {"dv": raw("text_values", np.uint64), "df": raw("text_flags", np.uint8), "iv": raw("item_values", np.uint64), "if_": raw("item_flags", np.uint8)}
        found = best_passage(hits, t["size"][0].as_py(), similarity, agreement, gap)
        return found and (t["file"][0].as_py(), t["row"][0].as_py(), t["id"][0].as_py(), t["item"][0].as_py(), *found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            key = [t[c].to_numpy() for c in ("file", "row", "item")]
            edges = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1).tolist()]
            found = [x for lo, hi in zip(edges, edges[1:], strict=False) if (x := one(t.slice(lo, hi - lo)))]
            rest = t.slice(edges[-1])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)
        if rest is not None and len(rest) and (x := one(rest)):
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(x, kinds, strict=True)], names)

    return run


def _leaks(table: Rows, benchmark: DataFrame, id_col: str, text_col: str, similarity: float, agreement: float, gap: int, filter_bytes: int) -> DataFrame:
    spark = benchmark.sparkSession
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item"), whole_text("text").alias("text")).mapInArrow(_items, ITEMS)
    rest = F.struct("item", "template", "values", "flags")
    items = items.groupBy("size", "one", "two").agg(F.min_by(rest, "item").alias("x")).select("size", "x.*")
    windows = stored(items.select("item", "size", "template", "values", "flags").mapInArrow(_item_windows(similarity), ITEM_WINDOWS), "item-windows")
    lengths = sorted(r.n for r in windows.where("n > 0").select("n").distinct().collect())  # no more than the longest item has tokens
    bits = min(8 * filter_bytes, 1 << max(20, (8 * PROBES * windows.count()).bit_length()))
    uri = scratch(spark, "window-filter")
    _write_filter(windows, bits, uri)

    file, row = (F.col(c) for c in table.key)
    docs = table.keyed().select(whole_text(text_col).alias("text"), file.alias("file"), row.alias("row"), F.col(id_col).cast("long").alias("id"))
    hits = stored(docs.mapInArrow(_hits(uri, bits, lengths), HITS), "hits")

    weights = hits.where("n = 0").groupBy("h").agg(F.count(F.lit(1)).alias("weight"))
    each = windows.where("n = 0").join(weights, "h", "left").select("item", "size", "start", "h", F.coalesce("weight", F.lit(0)).alias("weight"))
    # both sides of these joins are written, so that AQE can split a common window
    chosen = stored(each.repartition("item").sortWithinPartitions("item", "start").mapInArrow(_chosen(similarity), "h long, item long"), "rare-windows")
    pairs = stored(hits.where("n = 0").select("file", "row", "h").join(chosen, "h").select("file", "row", "item").distinct(), "candidates")
    own = windows.where("n = 0").select("h", "item", "size", F.col("start").alias("item_start"), "item_values", "item_flags")
    all_ = hits.where("n = 0").join(pairs, ["file", "row"]).join(own, ["h", "item"])
    all_ = all_.select("file", "row", "item", "id", "size", "start", "item_start", "text_values", "text_flags", "item_values", "item_flags")
    found = all_.repartition("file", "row", "item").sortWithinPartitions("file", "row", "item").mapInArrow(_decided(similarity, agreement, gap), LEAKS)

    same = hits.where("n > 0").join(windows.where("n > 0").select("h", "n", "item"), ["h", "n"])
    same = same.groupBy("file", "row", "id", F.col("item").alias("item_id"), "n").agg(F.min("start").cast("long").alias("start_token"))
    one = F.lit(1.0)
    return found.unionByName(same.select("file", "row", "id", "item_id", "start_token", (F.col("start_token") + F.col("n")).alias("end_token"), one.alias("similarity"), one.alias("agreement"), F.lit(True).alias("verbatim")))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, agreement: float = AGREEMENT, gap: int = GAP, filter_bytes: int = FILTER_BYTES
) -> DataFrame:
    """A row for each document and benchmark item that leaked into it: id, item_id, the best passage's start_token and end_token, similarity, agreement, verbatim."""
    return _leaks(Rows(docs), benchmark, id_col, text_col, similarity, agreement, gap, filter_bytes).drop("file", "row").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any leak, with all their columns; each row is judged on its own text."""
    rows = Rows(docs)
    return rows.without(_leaks(rows, benchmark, id_col, text_col, SIMILARITY, AGREEMENT, GAP, FILTER_BYTES).select("file", "row").distinct())
