"""Language-model scoring with a hierarchical Pitman-Yor process over words and the one or two words before.

Restaurants: one for each context of two words (``words_before`` = 2), its parent that of the nearer word alone, whose parent is the unigram restaurant, whose own base
gives every known word and one unknown word the same probability. Contexts are told apart by 64-bit hashes of the words themselves, so
what is learnt of contexts grows with the input.

Seating is the Chinese restaurant process, sampled by Gibbs. A sweep takes the customers of a
(context, word) pair out of their restaurant and seats them again one after another: a customer opens a
table with probability a / (i - d t + a), with i customers and t tables of that word there and a = (theta +
d T) P(word), P the parent's probability and T the restaurant's other tables; a table opened is a customer of
the parent. After eight customers, i // 8 are seated at a time with t held. Workers seat at once, with the tables of other workers as of the
sweep before. The discounts are n1 / (n1 + 2 n2), of the numbers of pairs seen once and twice at each level. A text's score is
the sum of log10 of its tokens' predictive probabilities, each averaged over the samples after burn-in.

How it is dealt out:

* A first pass counts tokens and finds hot words, contexts and trigrams: more than 1 / ``share`` of all tokens and a quarter of a bucket.
* One shuffle deals tokens, as types with counts by document, words that the first pass found frequent by number, into buckets of some ``task_tokens`` by the nearer context word; so both of its levels of
  restaurants lie in one bucket. If that word is hot, by both context words; if these are hot, by the whole trigram; if that is hot, in
  salted parts, which all seat it alike. What parts of a hot restaurant share (customers, tables) is summed up for all.
* Words belong to slices by hash. Before each sweep a bucket tells the slices how many customers it sends each word; a slice seats the unigram restaurant (and the pairs of
  hot context words) and answers. Both are packed arrays, one row for each bucket and slice.
* A bucket's seating is a file in the shared folder, written anew in each sweep under the sweep's number, so a lost task is simply run again.
* Scores go back as one row for each bucket and batch of documents, and are summed by batch.

On the driver are a few totals: of each level, and of hot words, contexts and trigrams (at most 3 * ``share``).

Defined cases: a null text is empty, of the end token alone; A-Z is lower-cased; words are split at ASCII white
space. A null id counts as the text "" for crc32. Each row is a document of its own, also if its id is null or repeated.
Empty tables give no rows; with no training token at all every token has the base's probability. Columns that clash in name don't matter.
"""

from __future__ import annotations

import functools
import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import forget, free_shuffles, open_fs, remove, scratch, stored, whole_text
from lattica.llm.words import mixed, word_hashes

WORDS_BEFORE = 2
BURN_IN = 1
SAMPLES = 2
THETA = 1.0
SHARE = 5_000
BATCH_TOKENS = 1_000_000
TASK_TOKENS = 1_500_000
SALT = 64
#: Occurrences in a batch from which on a word is counted as common, and how many common words are sent as numbers.
OFTEN, COMMON = 8, 1 << 17
#: The hash of the end token, which no word has but by chance.
END = np.uint64(0x9E3779B97F4A7C15)
SLICE = 1 << 13
ROWS = "bucket int, kind int, batch long, parts array<binary>"
STATIC, DOCS, ENTRIES = 0, 1, 2
PACK, UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def two(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """The hash of an ordered pair."""
    return mixed(a * np.uint64(0xD6E8FEB86659FD93) + mixed(b + np.uint64(salt)))


def _z(a: np.ndarray, kind: str = "<u4") -> bytes:
    """Packed numbers; of unsigned 32-bit ones only as many bytes as the largest needs."""
    a = np.ascontiguousarray(a)
    if kind == "<u4":
        most = int(a.max()) if a.size else 0
        kind = "u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4"
    return bytes([np.dtype(kind).itemsize]) + PACK.compress(a.astype(kind).tobytes())


def _un(data: bytes, kind: str = "<u4") -> np.ndarray:
    raw = UNPACK.decompress(data[1:])
    return np.frombuffer(raw, f"<u{data[0]}").astype("<u4") if kind == "<u4" else np.frombuffer(raw, kind)


def ordered(*keys: np.ndarray) -> np.ndarray:
    """The order of rows by keys of whole numbers, the first foremost; rows alike stay in their order.

    numpy sorts plain numbers many times as fast as it sorts places by several keys. So the keys' bits and the place are packed into one number; what is too wide
    for that is sorted in turns, the last bits first.
    """
    n = len(keys[0])
    if n < 2:
        return np.arange(n)
    bits = (n - 1).bit_length()
    turns, filled = [np.zeros(n, np.uint64)], 0
    for key in reversed(keys):
        key = key.astype(np.uint64) - key.min().astype(np.uint64)  # modulo 2^64, so of signed numbers too
        left = int(key.max()).bit_length()
        while left:
            if bits + filled == 64:
                turns, filled = [*turns, np.zeros(n, np.uint64)], 0
            turns[-1] |= key << np.uint64(bits + filled)  # the bits that don't fit fall off
            taken = min(left, 64 - bits - filled)
            key, left, filled = key >> np.uint64(taken), left - taken, filled + taken
    order = np.arange(n)
    for k, turn in enumerate(turns):
        found = (np.sort((turn[order] if k else turn) | np.arange(n, dtype=np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        order = order[found] if k else found
    return order


def marked(numbers: list[np.ndarray], n: int) -> np.ndarray:
    """Which of the numbers below n occur, in order."""
    found = np.zeros(n, bool)
    for x in numbers:
        found[x] = True
    return np.flatnonzero(found)


def _place(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The index of each value in a sorted list, -1 where it has none."""
    if not len(sorted_):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, at, -1)


class Tokens:
    """Tokens of a batch of texts: document, and the numbers (places in ``distinct``, hashes) of the word, the word before and the one before that."""

    def __init__(self, texts: pa.Array, words_before: int = WORDS_BEFORE):
        distinct, index, n = word_hashes(texts, lower=True, indexed=True)
        self.distinct, self.end = np.append(distinct, END), len(distinct)
        self.n = n + 1
        starts = np.cumsum(self.n) - self.n
        self.doc = np.repeat(np.arange(len(n), dtype=np.int32), self.n)
        self.word = np.full(int(self.n.sum()), self.end, np.int32)
        is_word = np.ones(len(self.word), bool)
        is_word[starts + n] = False
        self.word[is_word] = index
        end = np.int32(self.end)
        self.before, self.earlier = np.append(end, self.word[:-1]), np.concatenate([[end, end], self.word[:-2]])[: len(self.word)]
        self.before[starts] = self.earlier[starts] = end
        self.earlier[starts[self.n > 1] + 1] = end
        if words_before == 1:
            self.earlier[:] = end

    def context(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the contexts of some tokens."""
        return two(self.distinct[self.earlier[at]], self.distinct[self.before[at]])

    def type(self, at: np.ndarray) -> np.ndarray:
        """Hashes of contexts and words."""
        return two(self.context(at), self.distinct[self.word[at]])

    def with_before(self, words: np.ndarray) -> np.ndarray:
        """The tokens after one of some words (sorted hashes)."""
        return np.flatnonzero((_place(words, self.distinct) >= 0)[self.before])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose texts have some BATCH_TOKENS tokens at most, as far as one text has no more, by their bytes."""
    for b in batches:
        text = b.column(0)
        size = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        lo = 0
        while lo < len(text):
            hi = max(lo + 1, int(np.searchsorted(size, size[lo] + 5 * BATCH_TOKENS, side="right")) - 1)
            yield b.slice(lo, min(hi, len(text)) - lo)
            lo = min(hi, len(text))


def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and how often each comes."""
    h = np.sort(h)
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[at], np.diff(np.append(at, len(h)))


def _frequent(share: int, words_before: int):
    """(level, hash, count) of contexts and trigrams that make over 1 / share of a batch's tokens, and of words it has OFTEN; under level -1 all of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            t = Tokens(b.column(0), words_before)
            rows = [(np.array([-1]), np.zeros(1, np.uint64), np.array([len(t.word)]))]
            n = np.bincount(t.before, minlength=len(t.distinct))
            most = n * share > len(t.word)
            keep = most | (n >= OFTEN)
            rows.append((np.full(int(keep.sum()), 0), t.distinct[keep], n[keep]))
            at = np.flatnonzero(most[t.before])
            # a context is at most as frequent as its word, a trigram as its context
            for level in (1, 2):
                h = t.context(at) if level == 1 else t.type(at)
                found, n = counted(h)
                most = n * share > len(t.word)
                rows.append((np.full(int(most.sum()), level), found[most], n[most]))
                at = at[_place(found[most], h) >= 0] if len(h) else at
            level, h, n = (np.concatenate(x) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(level.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["level", "h", "n"])

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), ("parts", pa.list_(pa.binary()))])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _dealt(hot: list[np.ndarray], common: np.ndarray, buckets: int, words_before: int, turn: int):
    """Types and who says them, by bucket; the batch's documents go along.

    Words are codes: their place among the common words, or after those among the row's others, which go along as hashes. Types are sorted by (word before,
    word, earlier word), so that codes grow slowly and compress well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, b in enumerate(_batches(batches)):
            batch = (part << 32) + k
            t, ids = Tokens(b.column(0), words_before), b.column(1).to_pylist()
            held = np.array([held_out(i) for i in ids], bool)
            known = np.array([i is not None for i in ids], bool)
            mine = int(mixed(np.array([batch], np.uint64))[0] % np.uint64(buckets))
            if mine % words_before == turn:
                yield _rows([(mine, DOCS, batch, [_z(np.array([i or 0 for i in ids]), "<i8"), _z(known, "u1"), _z(held, "u1"), _z(t.n)])])
            bucket = (mixed(t.distinct) % np.uint64(buckets)).astype(np.int32)[t.before]
            at = t.with_before(hot[0])
            for level, own in enumerate((t.context, t.type, t.type)):
                if level:
                    at = at[_place(hot[level], t.context(at) if level == 1 else t.type(at)) >= 0]
                bucket[at] = mixed(own(at) + np.uint64((part + k) % SALT if level == 2 else 0)) % np.uint64(buckets)
            own = np.flatnonzero(bucket % words_before == turn)
            if not len(own):
                continue
            # numbers of the batch's words: common ones first, then as they come
            words = t.distinct
            by_hash, place = np.argsort(words), np.empty(len(words), np.int64)
            place[by_hash] = _place(common, words[by_hash])  # values in order are found faster
            rank = ordered(np.where(place >= 0, place, len(common) + np.arange(len(words))))
            words, place = words[rank], place[rank]
            number = np.empty(len(words), np.int32)
            number[rank] = np.arange(len(words))
            shared = int((place >= 0).sum())
            code_of = place.copy()
            bucket, word, before, earlier, doc = bucket[own], number[t.word[own]], number[t.before[own]], number[t.earlier[own]], t.doc[own]
            order = ordered(bucket, before, word, earlier)
            bucket, word, before, earlier, doc = (x[order] for x in (bucket, word, before, earlier, doc))
            changes = [np.append(True, x[1:] != x[:-1]) for x in (bucket, before, word, earlier, doc)]
            new_type = changes[0] | changes[1] | changes[2] | changes[3]
            entry = np.flatnonzero(new_type | changes[4])
            counts = np.diff(np.append(entry, len(doc)))
            types = np.flatnonzero(new_type[entry])
            sizes = np.diff(np.append(types, len(entry)))
            first = entry[types]
            of = bucket[first]
            edges = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
            ends = np.append(types, len(entry))
            who = doc[entry].astype(np.int64) * 2 + held[doc[entry]]
            for lo, hi in zip(edges, [*edges[1:], len(of)], strict=True):
                own = [x[first[lo:hi]] for x in (earlier, before, word)]
                others = counted(np.concatenate([x[x >= shared] for x in own]))[0]
                code_of[others] = len(common) + np.arange(len(others))
                code = [code_of[x] for x in own]
                same = np.append(False, own[1][1:] == own[1][:-1])
                e = slice(ends[lo], ends[hi])
                parts = [_z(np.diff(words[others], prepend=np.uint64(0)), "<u8"), _z(code[0]), _z(np.diff(code[1], prepend=0)), _z(code[2] - np.where(same, np.append(0, code[2][:-1]), 0)), _z(sizes[lo:hi]), _z(who[e]), _z(counts[e])]
                yield _rows([(int(of[lo]), ENTRIES, batch, parts)])

    return run


def _since(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at marked places."""
    sums = np.cumsum(x)
    first = np.flatnonzero(new)
    return sums - np.repeat(np.append(0, sums[first[1:] - 1]), np.diff(np.append(first, len(x))))


def _merged(hot: list[np.ndarray], common: np.ndarray):
    """A bucket's rows as one structure, and its entries by batch."""

    def one(bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        raw, names, n = [], [common], len(common)
        for r in rows:
            words, earlier, before, word, sizes, who, counts = (_un(p, "<u8" if i == 0 else "<u4") for i, p in enumerate(r["parts"]))
            before = np.cumsum(before.astype(np.int64))
            code = (earlier, before, _since(word.astype(np.int64), np.append(True, before[1:] != before[:-1])))
            # a row's other words have numbers of their own in the bucket, the common ones the same in all rows
            raw.append((tuple((x + (x >= len(common)) * (n - len(common))).astype(np.uint32) for x in code), sizes, who, counts))
            names.append(np.cumsum(words))
            n += len(words)
        names = np.concatenate(names)
        # the words of either kind that the codes of all rows stand for, and their places among these
        places, kinds = [], []
        for roles in ((0,), (1, 2)):
            codes = [np.concatenate([r[0][i] for r in raw]) for i in roles]
            used = marked(codes, len(names))
            kind, at = np.unique(names[used], return_inverse=True)
            kinds.append(kind)
            place = np.zeros(len(names), np.uint32)
            place[used] = at
            places += [place[x].astype(np.int64) for x in codes]
        del names, place, codes
        raw = [r[1:] for r in raw]
        (others, words), (earlier, before, word) = kinds, places
        pair = (before << 32) | word
        order = ordered(before, word, earlier)
        new = np.append(True, (np.diff(pair[order]) != 0) | (np.diff(earlier[order]) != 0))
        type_of = np.empty(len(order), np.int64)
        type_of[order] = np.cumsum(new) - 1
        first = order[new]
        earlier, before, word, pair = earlier[first], before[first], word[first], pair[first]
        new_pair = np.append(True, pair[1:] != pair[:-1])
        contexts, in_context = np.unique((before << 32) | earlier, return_inverse=True)
        context = two(others[contexts & 0xFFFFFFFF], words[contexts >> 32])
        trained, done = np.zeros(len(first), np.int64), 0
        for r, (sizes, who, counts) in zip(rows, raw, strict=True):
            entry_type = np.repeat(type_of[done : done + len(sizes)], sizes)
            done += len(sizes)
            trained += np.bincount(entry_type, counts * (1 - who % 2), len(first)).astype(np.int64)
            order = ordered(entry_type)
            yield _rows([(bucket, ENTRIES, r["batch"], [_z(np.diff(entry_type[order], prepend=0)), _z(who[order] // 2), _z(counts[order])])])
        salted = _place(hot[2], two(context[in_context], words[word])) if len(hot[2]) else np.full(len(first), -1)
        parts = [_z(np.diff(words, prepend=np.uint64(0)), "<u8"), _z(np.diff(in_context, prepend=0), "<i4"), _z(new_pair, "u1"), _z(trained), _z(np.diff(before[new_pair], prepend=0)), _z(word[new_pair])]
        parts += [_z(_place(hot[1], context), "<i4"), _z(_place(hot[0], words), "<i4"), _z(salted, "<i4")]
        yield _rows([(bucket, STATIC, 0, parts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == DOCS:
                    yield _rows([(r["bucket"], DOCS, r["batch"], r["parts"])])
                    continue
                if r["bucket"] != now and rows:
                    yield from one(now, rows)
                    rows = []
                now = r["bucket"]
                rows.append(r)
        if rows:
            yield from one(now, rows)

    return run


def seat(customers: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating so many customers of a word one after another; a: the mass of a new table."""
    t = (customers > 0).astype(np.int64)
    active = np.flatnonzero(customers > 1)
    i, all_, mass, tables = np.ones(len(active), np.int64), customers[active], a[active], np.ones(len(active), np.int64)
    while len(active):
        m = np.minimum(np.maximum(1, i // 8), all_ - i)
        tables = tables + rng.binomial(m, np.minimum(1, mass / (i + (m - 1) / 2 - d * tables + mass)))
        i = i + m
        left = i < all_
        t[active[~left]] = tables[~left]
        active, i, all_, mass, tables = active[left], i[left], all_[left], mass[left], tables[left]
    return t


class Bucket:
    """The restaurants of one bucket and their seating."""

    def __init__(self, uri: str, bucket: int, words_before: int):
        self.words_before = words_before
        fs, path = open_fs(f"{uri}/kind={STATIC}/bucket={bucket}")
        self.empty = fs.get_file_info(path).type == pafs.FileType.NotFound
        self.uri, self.number = uri, bucket
        if self.empty:
            return
        parts = pq.read_table(path, columns=["parts"], filesystem=fs, partitioning=None)["parts"][0].as_py()
        kinds = ["<u8", "<i4", "u1", *["<u4"] * 3, *["<i4"] * 3]
        words, context, new_pair, c, pair_before, self.pair_word, self.hot_context, hot_word, self.hot_type = (_un(p, k) for p, k in zip(parts, kinds, strict=True))
        self.words, self.context, self.pair, self.c = np.cumsum(words), np.cumsum(context.astype(np.int64)), np.cumsum(new_pair.astype(np.int64)) - 1, c.astype(np.int64)
        self.pair_before = np.cumsum(pair_before.astype(np.int64))
        self.hot_pair = hot_word[self.pair_before]
        self.common = self.hot_pair >= 0
        # of the parts of a hot trigram one is counted
        self.counted = np.ones(len(self.c), bool)
        self.salted = np.flatnonzero(self.hot_type >= 0)
        # words asked of slices, and pairs of hot context words
        self.asked = marked([self.pair_word], len(self.words))
        self.pairs = np.flatnonzero(self.common)

    def start(self) -> None:
        self.t3 = (self.c > 0).astype(np.int64) if self.words_before > 1 else self.c
        self.customers()
        self.t2 = (self.c2 > 0).astype(np.int64)

    def set_shared(self, hot_types: dict) -> None:
        """The whole counts of hot trigrams, of which this bucket has a part, and whether this part is the one that is counted."""
        if len(self.salted):
            which = self.hot_type[self.salted]
            self.c[self.salted] = hot_types["c"][which]
            self.counted[self.salted] = hot_types["bucket"][which] == self.number

    def customers(self) -> None:
        self.c2 = np.bincount(self.pair, self.t3 * self.counted, len(self.pair_word)).astype(np.int64)

    def _file(self, k: int) -> str:
        return f"{self.uri}-seats/{k}/{self.number}"

    def save(self, k: int) -> None:
        fs, path = open_fs(self._file(k))
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part, compression=None) as f:
            f.write(pickle.dumps((_z(self.t3), _z(self.t2), _z(self.tokens))))
        fs.move(part, path)

    def load(self, k: int) -> None:
        fs, path = open_fs(self._file(k))
        with fs.open_input_stream(path, compression=None) as f:
            t3, t2, tokens = pickle.loads(f.read())
        self.t3, self.t2, self.tokens = _un(t3).astype(np.int64), _un(t2).astype(np.int64), _un(tokens)
        self.customers()

    def slices(self, of: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order by slice of some words, the slices that have any, and where each begins."""
        s = (mixed(self.words[of]) >> np.uint64(20)) % np.uint64(slices)
        order = ordered(s)
        return order, s[order].astype(np.int64), np.flatnonzero(np.diff(s[order].astype(np.int64), prepend=-1))

    def requests(self, slices: int, first: bool) -> list[tuple]:
        """Rows (slice, bucket, parts): each word's customers from here, its training tokens the first time, and the customers of pairs of hot context words."""
        n = np.bincount(self.pair_word, np.where(self.common, 0, self.t2), len(self.words)).astype(np.int64)[self.asked]
        tokens = np.bincount(self.pair_word[self.pair], self.c_own if first else None, len(self.words)).astype(np.int64)[self.asked] if first else np.zeros(0)
        order, s, edges = self.slices(self.asked, slices)
        hot_order, hot_s, _ = self.slices(self.pair_word[self.pairs], slices)
        rows = []
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(s)], strict=True):
            own = order[lo:hi]
            a, b = np.searchsorted(hot_s, s[lo], "left"), np.searchsorted(hot_s, s[lo], "right")
            pairs = self.pairs[hot_order[a:b]]
            parts = [_z(self.words[self.asked[own]], "<u8"), _z(n[own]), _z(tokens[own] if first else tokens), _z(self.words[self.pair_word[pairs]], "<u8"), _z(self.hot_pair[pairs]), _z(self.c2[pairs])]
            rows.append((int(s[lo]), self.number, parts))
        return rows

    def answers(self, rows: list[dict], slices: int, first: bool) -> None:
        """Take in what slices say: customers and tables of words and of hot pairs."""
        rows = sorted(rows, key=lambda r: r["slice"])
        parts = [np.concatenate([_un(r["parts"][i]) for r in rows]) for i in range(5)]
        order, _, _ = self.slices(self.asked, slices)
        hot_order, _, _ = self.slices(self.pair_word[self.pairs], slices)
        self.c1, self.t1 = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64)
        self.c1[self.asked[order]], self.t1[self.asked[order]] = parts[0], parts[1]
        if first:
            self.tokens = np.zeros(len(self.words), np.uint32)
            self.tokens[self.asked[order]] = parts[2]
        self.c2[self.pairs[hot_order]], self.t2[self.pairs[hot_order]] = parts[3], parts[4]

    def totals(self, m: dict) -> tuple[np.ndarray, ...]:
        """Customers and tables of each context of two words, and of one."""
        n = len(self.hot_context)
        hot, word = self.hot_context, self.pair_before
        three = [np.bincount(self.context, x, n) for x in (self.c, self.t3)]
        own = [np.bincount(word, x, len(self.words)) for x in (self.c2, self.t2)]
        if len(m["hot_contexts"][0]):
            three = [np.where(hot >= 0, m["hot_contexts"][i][hot], x) for i, x in enumerate(three)]
        out = [x[self.context] for x in three] + [x[word] for x in own]
        if self.common.any():
            for i in (0, 1):
                out[2 + i] = np.where(self.common, m["hot_words"][i][self.hot_pair], out[2 + i])
        return tuple(out)

    def probabilities(self, m: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each type, of each pair given its word before, and of each word."""
        c3, t3, c2, t2 = self.totals(m)
        theta = m["theta"]
        one = (self.c1 - m["d1"] * self.t1 + (theta + m["d1"] * m["t1"]) * m["p0"]) / (theta + m["c1"])
        pair = (self.c2 - m["d2"] * self.t2 + (theta + m["d2"] * t2) * one[self.pair_word]) / (theta + c2)
        if self.words_before == 1:
            return pair[self.pair], pair, one
        return (self.c - m["d3"] * self.t3 + (theta + m["d3"] * t3) * pair[self.pair]) / (theta + c3), pair, one

    def sweep(self, k: int, m: dict, pair: np.ndarray, one: np.ndarray) -> None:
        rng, theta = np.random.default_rng([m["seed"], self.number, k]), m["theta"]
        _, t3, _, t2 = self.totals(m)
        if self.words_before > 1:
            a = (theta + m["d3"] * np.maximum(0, t3 - self.t3)) * pair[self.pair]
            self.t3 = seat(np.where(self.hot_type >= 0, 0, self.c), a, m["d3"], rng)
            for i in self.salted.tolist():  # all parts alike
                self.t3[i] = seat(self.c[i : i + 1], a[i : i + 1], m["d3"], np.random.default_rng([m["seed"], int(self.hot_type[i]), k, 1]))[0]
        else:  # all tokens are customers of the nearer word's restaurant
            self.t3 = self.c
        self.customers()
        b = (theta + m["d2"] * np.maximum(0, t2 - self.t2)) * one[self.pair_word]
        self.t2 = np.where(self.common, 0, seat(np.where(self.common, 0, self.c2), b, m["d2"], rng))

    def sums(self, hot: list[int]) -> np.ndarray:
        """What goes to the driver: tokens, numbers seen once and twice, and of hot contexts the customers and tables."""
        rare = ~self.common
        out = [np.array([self.c_own.sum(), (self.c == 1).sum(), (self.c == 2).sum(), (self.c2[rare] == 1).sum(), (self.c2[rare] == 2).sum()])]
        at = self.hot_context[self.context]
        own = at >= 0
        counted = own & self.counted
        out += [np.bincount(at[own], self.c_own[own], hot[1]), np.bincount(at[counted], self.t3[counted], hot[1])]
        return np.concatenate(out)


REQUESTS = "slice int, bucket int, parts array<binary>, sums binary"


def _request_rows(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("slice", pa.int32()), ("bucket", pa.int32()), ("parts", pa.list_(pa.binary())), ("sums", pa.binary())])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _started(uri: str, slices: int, words_before: int, hot: list[int]):
    """The first seating, one table a type, of buckets (from rows that name them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number in b.column(0).to_pylist():
                own = Bucket(uri, number, words_before)
                if own.empty:
                    continue
                own.c_own, own.tokens = own.c, np.zeros(0)
                own.start()
                own.save(0)
                sums = np.concatenate([own.sums(hot), np.bincount(own.hot_type[own.salted], own.c[own.salted], hot[2])])
                rows = [(*r, None) for r in own.requests(slices, True)]
                # the part of a hot trigram that has most of it by number is the one counted
                yield _request_rows([*rows, (-1, number, [_z(own.hot_type[own.salted])], _z(sums, "<i8"))])

    return run


def _answered(m: dict, k: int, hot: list[int]):
    """Slices: words' customers from all buckets, seated; answers to each bucket, and totals."""

    def one(slice_: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        raw = [[_un(p, "<u8" if i in (0, 3) else "<u4") for i, p in enumerate(r["parts"])] for r in rows]
        words, at = np.unique(np.concatenate([r[0] for r in raw]), return_inverse=True)
        n = np.bincount(at, np.concatenate([r[1] for r in raw]), len(words)).astype(np.int64)
        tokens = np.bincount(at, np.concatenate([r[2] for r in raw]), len(words)).astype(np.int64) if k == 0 else np.zeros(len(words), np.int64)
        hot_word, hot_of, hot_n = (np.concatenate([r[i] for r in raw]) for i in (3, 4, 5))
        _, first, pair = np.unique(two(hot_word, hot_of.astype(np.uint64), 2), return_index=True, return_inverse=True)
        pair_word, pair_of = np.searchsorted(words, hot_word[first]), hot_of[first].astype(np.int64)
        c2 = np.bincount(pair, hot_n, len(first)).astype(np.int64)
        t2, rng = (c2 > 0).astype(np.int64), np.random.default_rng([m.get("seed", 0), slice_, k, 2])
        c1 = n + np.bincount(pair_word, t2, len(words)).astype(np.int64)
        t1 = (c1 > 0).astype(np.int64)
        if k:
            about = (c1 - m["d1"] * t1 + (m["theta"] + m["d1"] * m["t1"]) * m["p0"]) / (m["theta"] + m["c1"])
            t2 = seat(c2, (m["theta"] + m["d2"] * np.maximum(0, m["hot_words"][1][pair_of] - 1)) * about[pair_word], m["d2"], rng) if len(c2) else t2
            c1 = n + np.bincount(pair_word, t2, len(words)).astype(np.int64)
            t1 = seat(c1, np.full(len(c1), (m["theta"] + m["d1"] * max(0, m["t1"] - 1)) * m["p0"]), m["d1"], rng)
        done = hot_done = 0
        out = []
        for r, own in zip(rows, raw, strict=True):
            w, p = at[done : done + len(own[0])], pair[hot_done : hot_done + len(own[3])]
            done, hot_done = done + len(own[0]), hot_done + len(own[3])
            out.append((slice_, r["bucket"], [_z(c1[w]), _z(t1[w]), _z(tokens[w] if k == 0 else tokens[:0]), _z(c2[p]), _z(t2[p])], None))
        sums = [np.array([c1.sum(), t1.sum(), (tokens > 0).sum(), (c1 == 1).sum(), (c1 == 2).sum(), (c2 == 1).sum(), (c2 == 2).sum()])]
        sums += [np.bincount(pair_of, x, hot[0]) for x in (c2, t2)]
        yield _request_rows([*out, (slice_, -1, None, _z(np.concatenate(sums), "<i8"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["slice"] != now and rows:
                    yield from one(now, rows)
                    rows = []
                now = r["slice"]
                rows.append(r)
        if rows:
            yield from one(now, rows)

    return run


def _swept(uri: str, slices: int, m: dict, k: int, hot: list[int]):
    """Buckets, from the answers to their seating k - 1: the next sweep."""

    def one(number: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        own = Bucket(uri, number, m["words_before"])
        own.c_own = own.c.copy()
        own.set_shared(m["hot_types"])
        own.load(k - 1)
        own.answers(rows, slices, k == 1)
        _, pair, word = own.probabilities(m)
        own.sweep(k, m, pair, word)
        own.save(k)
        yield _request_rows([*((*r, None) for r in own.requests(slices, False)), (-1, number, None, _z(own.sums(hot), "<i8"))])

    return _for_each_bucket(one)


def _for_each_bucket(one):
    """one(bucket, rows) for rows sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["bucket"] != now and rows:
                    yield from one(now, rows)
                    rows = []
                now = r["bucket"]
                rows.append(r)
        if rows:
            yield from one(now, rows)

    return run


def _scored(uri: str, slices: int, samples: dict[int, dict]):
    """Buckets, from the answers (with the seating's number) to the seatings that are samples: scores by batch and document."""

    def one(number: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        sums = 0
        for k, m in samples.items():
            own = Bucket(uri, number, m["words_before"])
            own.set_shared(m["hot_types"])
            own.load(k)
            own.answers([r for r in rows if r["sample"] == k], slices, k == 0)
            sums = sums + own.probabilities(m)[0]
        say = np.log10(sums / len(samples))
        count = own.tokens[own.pair_word[own.pair]]
        base = np.log10((count + 0.1) / (m["n"] + 0.1 * (m["v"] + 1)))
        fs, path = open_fs(f"{uri}/kind={ENTRIES}/bucket={number}")
        for info in fs.get_file_info(pafs.FileSelector(path)):
            if info.path.endswith(".parquet"):
                for b in pq.ParquetFile(fs.open_input_file(info.path)).iter_batches(16, columns=["batch", "parts"]):
                    for r in b.to_pylist():
                        type_, doc, n = (_un(p) for p in r["parts"])
                        type_ = np.cumsum(type_)
                        docs = marked([doc], int(doc.max()) + 1)
                        each = [np.bincount(doc, n * x[type_])[docs] for x in (base, say, count > 0)]
                        yield _rows([(number, ENTRIES, r["batch"], [_z(np.diff(docs, prepend=0)), _z(each[0], "<f8"), _z(each[1], "<f4"), _z(each[2])])])

    return _for_each_bucket(one)


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of all buckets for a batch's documents, from rows sorted by batch and kind."""
    out = None

    def done() -> pa.RecordBatch:
        ids, known, held, n, base, score, seen = out
        columns = [pa.array(ids, mask=known == 0), pa.array(held > 0), pa.array(n.astype(np.int64)), pa.array(np.rint(seen).astype(np.int64)), pa.array(base), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    for b in batches:
        for r in b.to_pylist():
            if r["kind"] == DOCS:
                if out:
                    yield done()
                ids, known, held, n = (_un(p, k) for p, k in zip(r["parts"], ("<i8", "u1", "u1", "<u4"), strict=True))
                out = [ids, known, held, n, *(np.zeros(len(ids)) for _ in range(3))]
            else:
                docs = np.cumsum(_un(r["parts"][0]))
                for i, kind in ((4, "<f8"), (5, "<f4"), (6, "<u4")):
                    out[i][docs] += _un(r["parts"][i - 3], kind)
    if out:
        yield done()


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(_un(x, "<i8") for x in rows["sums"])
    return pd.DataFrame({"salt": [0], "sums": [_z(total, "<i8")]})


def _total(df: DataFrame, length: int) -> np.ndarray:
    """The sum of all vectors: as long as there are levels and hot things, whatever the input."""
    schema = "salt int, sums binary"
    salted = df.where("sums IS NOT NULL").select(F.pmod(F.xxhash64("slice", "bucket"), F.lit(64)).cast("int").alias("salt"), "sums")
    rows = salted.groupBy("salt").applyInPandas(_summed, schema).groupBy("salt").applyInPandas(_summed, schema).collect()
    return _un(rows[0].sums, "<i8") if rows else np.zeros(length, np.int64)


def discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_before: int = WORDS_BEFORE, burn_in: int = BURN_IN, samples: int = SAMPLES, theta: float = THETA, seed: int = 1, share: int = SHARE, task_tokens: int = TASK_TOKENS
) -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(whole_text(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    counts = stored(rows.select("text").mapInArrow(_frequent(share, words_before), "level int, h long, n long").groupBy("level", "h").agg(F.sum("n").alias("n")), "frequent")
    tokens = counts.where("level = -1").agg(F.sum("n")).first()[0] or 0
    least = max(tokens // share, task_tokens // 4)
    found = counts.where("level >= 0").where(F.col("n") > least).select("level", "h").collect()  # at most 3 * share
    hot = [np.sort(np.array([r.h for r in found if r.level == i], np.int64).view(np.uint64)) for i in range(3)]
    many = [len(x) for x in hot]
    buckets = slices = max(4, -(-tokens // task_tokens))

    uri = scratch(spark, "pitman-yor")
    # a fixed number: these words are sent as numbers
    common = counts.where("level = 0").orderBy(F.col("n").desc(), "h").limit(COMMON).select("h").collect()
    common = np.sort(np.array([r.h for r in common], np.int64).view(np.uint64))
    # with two words the buckets are dealt in two turns, so that the shuffle of one is gone before the next
    for turn in range(words_before):
        dealt = rows.mapInArrow(_dealt(hot, common, buckets, words_before, turn), ROWS).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "batch")
        dealt.mapInArrow(_merged(hot, common), ROWS).write.mode("append").partitionBy("kind", "bucket").parquet(uri)
        del dealt
        free_shuffles(spark)
    numbers = spark.range(buckets).selectExpr("cast(id AS int) AS bucket").repartitionById(buckets, F.col("bucket"))
    asked = stored(numbers.mapInArrow(_started(uri, slices, words_before, many), REQUESTS), "requests")

    v = _total(asked.where("slice = -1"), 5 + 2 * many[1] + many[2])
    n, once, twice, pair_once, pair_twice = v[:5].tolist()
    three = [v[5 : 5 + many[1]], v[5 + many[1] : 5 + 2 * many[1]]]
    model: dict = {"words_before": words_before, "theta": theta, "seed": seed, "n": n, "d3": discount(once, twice), "hot_contexts": three}
    # each hot trigram is counted by the first of the buckets that have a part of it
    counted_by = np.full(many[2], buckets)
    if many[2]:
        for r in asked.where("slice = -1").select("bucket", "parts").collect():  # at most SALT buckets have a part of each
            for i in _un(r.parts[0]).tolist():
                counted_by[i] = min(counted_by[i], r.bucket)
    model["hot_types"] = {"c": v[5 + 2 * many[1] :], "bucket": counted_by}
    steps = burn_in + samples if n else 1
    taken: dict[int, tuple[dict, DataFrame]] = {}
    for k in range(steps):
        answers = asked.where("slice >= 0").repartition(slices, "slice").sortWithinPartitions("slice", "bucket").mapInArrow(_answered(model, k, many), REQUESTS)
        answers = stored(answers, "answers")
        forget(asked)
        v = _total(answers.where("bucket = -1"), 7 + 2 * many[0])
        model |= {"c1": int(v[0]), "t1": int(v[1]), "hot_words": [v[7 : 7 + many[0]], v[7 + many[0] :]]}
        if k == 0:
            model |= {"v": int(v[2]), "p0": 1 / (int(v[2]) + 1), "d1": discount(int(v[3]), int(v[4])), "d2": discount(pair_once + int(v[5]), pair_twice + int(v[6]))}
        if k >= steps - samples or steps == 1:
            taken[k] = (dict(model), answers)
        if k + 1 == steps:
            break
        rest = answers.where("bucket >= 0").repartition(buckets, "bucket").sortWithinPartitions("bucket", "slice")
        asked = stored(rest.mapInArrow(_swept(uri, slices, dict(model), k + 1, many), REQUESTS), "requests")
        w = _total(asked.where("slice = -1"), 5 + 2 * many[1])
        model["hot_contexts"] = [w[5 : 5 + many[1]], w[5 + many[1] :]]
        if k not in taken:  # no later step reads these
            forget(answers)
            remove(f"{uri}-seats/{k}")
    rest = functools.reduce(DataFrame.unionByName, [x.where("bucket >= 0").select("slice", "bucket", "parts", F.lit(k).alias("sample")) for k, (_, x) in taken.items()])
    rest = rest.repartition(buckets, "bucket").sortWithinPartitions("bucket", "sample", "slice")
    scored = rest.mapInArrow(_scored(uri, slices, {k: m for k, (m, _) in taken.items()}), ROWS)
    by_batch = scored
    if tokens:
        told = spark.read.schema("batch long, parts array<binary>, kind int, bucket int").parquet(uri).where(f"kind = {DOCS}")
        by_batch = scored.unionByName(told)
    out = by_batch.repartition("batch").sortWithinPartitions("batch", "kind").select("batch", "kind", "parts")
    out = out.mapInArrow(_by_document, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
