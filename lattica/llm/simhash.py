"""SimHash near-duplicates by a self-join of binary tries.

A text's fingerprint has bit b set where over half of its shingles' XXH64 have it set. Fingerprints
link at ``budget`` or fewer differing bits. With budget 3, two linked fingerprints agree in one of
four 16-bit blocks; for each block, a fingerprint rotated to begin with it goes to the worker of
(block, value). There, the sorted fingerprints of a value are a binary trie: node pairs are
traversed together from the pair (root, root), their differing bits add up, and a pair is dropped
once it exceeds the budget. Pairs of nodes that are all in one class already are dropped too, and a
worker sends only the links that join classes of its own (a forest), so a dense group of n
fingerprints makes under n links of each worker, not n squared. A value with more than
``hot_rows`` fingerprints is dealt anew by the four 12-bit blocks of its other bits, in one of which
two linked fingerprints agree as well; so nothing is lost and no group ends in one task.

Equal fingerprints are one node, named by their smallest document id. Classes are the connected
components of all links.

Defined cases: A-Z is lower-cased, words are runs of anything but ASCII white space, shingles are
counted with repeats; a text of fewer words than a shingle has one shingle, its words; a null, empty
or blank text has fingerprint 0 and links like any other. Rows with a null id get a null class.
Rows that repeat an id link as others do. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.components import connected_components
from lattica.llm.shared import stored, whole_text

SHINGLE = 3
BUDGET = 3
SEED = 42
STEP = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, one, seed = b" ".join(words), xxhash.xxh64_intdigest, SEED
    if len(words) <= shingle:
        return one(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    lo, hi = (ends - sizes)[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(lo), STEP):
        h = np.array([one(joined[a:b], seed) for a, b in zip(lo[at : at + STEP], hi[at : at + STEP], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(lo), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                own = b.slice(lo, 2000)
                found = np.array([fingerprint(t, shingle) for t in own.column(1).to_pylist()], "<u8").view("<i8")
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(found)], ["id", "fp"])

    return run


class _Classes:
    """Union-find over positions; labels are least positions after ``flat``."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[np.ndarray] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the classes of a[i] and b[i]; only links between different classes are kept, a forest."""
        while len(a):
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            a, b, hi, lo = a[apart], b[apart], np.maximum(la, lb)[apart], np.minimum(la, lb)[apart]
            if not len(a):
                return
            first = np.unique(hi, return_index=True)[1]
            self.links.append(np.stack([a[first], b[first]], axis=1))
            self.label[hi[first]] = lo[first]
            while (up := self.label[self.label]) is not None and (up != self.label).any():
                self.label = up


def trie_links(keys: np.ndarray, groups: np.ndarray, bits: int, budget: int = BUDGET) -> np.ndarray:
    """Links (positions) that join all keys of a group within ``budget`` differing bits into classes.

    keys: unsigned, sorted within groups and distinct there; their low ``bits`` bits may differ.
    """
    if not len(keys):
        return np.zeros((0, 2), np.int64)
    n, classes = len(keys), _Classes(len(keys))
    edges = np.flatnonzero(np.diff(groups, prepend=groups[:1] - 1))
    ends = np.append(edges[1:], n)
    roots = np.stack([edges, ends], axis=1)[ends - edges > 1]
    for allowed in range(1, budget + 1):
        work = [(bits, np.concatenate([roots, roots, np.zeros((len(roots), 1), np.int64)], axis=1))]
        changes = np.concatenate([[0], np.cumsum(np.diff(classes.label, prepend=-1) != 0)])
        while work:
            bit, pairs = work.pop()
            if len(pairs) > 1 << 18:  # depth first, in parts, so that the frontier stays small
                half = len(pairs) // 2
                work += [(bit, pairs[:half]), (bit, pairs[half:])]
                continue
            a0, a1, b0, b1, used = pairs.T
            one = (changes[a1] == changes[a0 + 1]) & (changes[b1] == changes[b0 + 1]) & (classes.label[a0] == classes.label[b0])
            pairs = pairs[~one & (used <= allowed)]
            small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= 16 if bit else np.ones(len(pairs), bool)
            _leaves(keys, pairs[small], allowed, classes)
            if len(pairs := pairs[~small]):
                work.append((bit - 1, _children(keys, pairs, bit - 1)))
    return np.concatenate(classes.links) if classes.links else np.zeros((0, 2), np.int64)


def trie_pairs(keys: np.ndarray, groups: np.ndarray, bits: int, budget: int, leaf: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (positions a < b) of keys of a group within ``budget`` differing bits, in parts.

    keys: unsigned, sorted within groups; equal ones may repeat. Node pairs of up to leaf x leaf keys are compared directly.
    """
    edges = np.flatnonzero(np.diff(groups, prepend=groups[:1] - 1))
    ends = np.append(edges[1:], len(keys))
    roots = np.stack([edges, ends], axis=1)[ends - edges > 1]
    work = [(bits, np.concatenate([roots, roots, np.zeros((len(roots), 1), np.int64)], axis=1))]
    while work:
        bit, pairs = work.pop()
        if len(pairs) > 1 << 16:  # depth first, in parts, so that the frontier stays small
            half = len(pairs) // 2
            work += [(bit, pairs[:half]), (bit, pairs[half:])]
            continue
        pairs = pairs[pairs[:, 4] <= budget]
        small = np.maximum(pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]) <= leaf if bit else np.ones(len(pairs), bool)
        leaves = pairs[small]
        size = (leaves[:, 1] - leaves[:, 0]) * (leaves[:, 3] - leaves[:, 2])
        tiny = size <= 4096
        own, total = leaves[tiny], np.cumsum(size[tiny])
        for at in range(0, int(total[-1]) if len(total) else 0, 1 << 18):  # some of the tiny ones at once
            lo, hi = np.searchsorted(total, [at, at + (1 << 18)], side="right")
            a0, a1, b0, b1, _ = own[lo:hi].T.astype(np.int32)
            wide, n = b1 - b0, (a1 - a0) * (b1 - b0)
            at_ = np.arange(int(n.sum()), dtype=np.int32) - np.repeat(np.cumsum(n, dtype=np.int32) - n, n)
            row = at_ // np.repeat(wide, n)
            a, b = np.repeat(a0, n) + row, np.repeat(b0, n) + (at_ - row * np.repeat(wide, n))
            near = np.flatnonzero((np.bitwise_count(keys[a] ^ keys[b]) <= budget) & (a < b))
            yield a[near].astype(np.int64), b[near].astype(np.int64)
        for a0, a1, b0, b1, _ in leaves[~tiny].tolist():
            for lo in range(a0, a1, 1 << 10):  # equal keys make large leaves
                a, b = np.nonzero(np.bitwise_count(keys[lo : min(a1, lo + (1 << 10)), None] ^ keys[b0:b1]) <= budget)
                a, b = a + lo, b + b0
                yield (a[a < b], b[a < b]) if a0 == b0 else (a, b)
        if len(pairs := pairs[~small]):
            work.append((bit - 1, _children(keys, pairs, bit - 1)))


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where the keys with this bit set begin, in sorted ranges that agree above it: a bisection of all ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        set_ = (keys[np.minimum(mid, len(keys) - 1)] >> np.uint64(bit)) & np.uint64(1) == 1
        hi = np.where(open_ & set_, mid, hi)
        lo = np.where(open_ & ~set_, mid + 1, lo)
    return lo


def _children(keys: np.ndarray, pairs: np.ndarray, bit: int) -> np.ndarray:
    a0, a1, b0, b1, used = pairs.T
    am, bm = _split(keys, a0, a1, bit), _split(keys, b0, b1, bit)
    same = a0 == b0
    out = [np.stack(x, axis=1) for x in ((a0, am, b0, bm, used), (am, a1, bm, b1, used), (a0, am, bm, b1, used + 1))]
    out.append(np.stack((am, a1, b0, bm, used + 1), axis=1)[~same])
    found = np.concatenate(out)
    return found[(found[:, 0] < found[:, 1]) & (found[:, 2] < found[:, 3])]


def _leaves(keys: np.ndarray, pairs: np.ndarray, allowed: int, classes: _Classes) -> None:
    if not len(pairs):
        return
    a0, a1, b0, b1, _ = pairs.T
    wide = b1 - b0
    size = (a1 - a0) * wide
    which = np.repeat(np.arange(len(pairs)), size)
    at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    a, b = a0[which] + at // wide[which], b0[which] + at % wide[which]
    near = (a < b) & (np.bitwise_count(keys[a] ^ keys[b]) <= allowed)
    classes.join(a[near], b[near])


def _joined(bits: int, budget: int):
    """For a worker's rows (part, key, node): links (u, v) between nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), pa.schema([("part", pa.int64()), ("key", pa.int64()), ("node", pa.int64())]))
        part, key, node = (t.column(i).to_numpy() for i in range(3))
        key = key.view(np.uint64)
        order = np.lexsort((key, part))
        links = trie_links(key[order], part[order], bits, budget)
        node = node[order]
        yield pa.RecordBatch.from_arrays([pa.array(node[links[:, i]]) for i in range(2)], ["u", "v"])

    return run


def _block(fp: Column, i: int) -> Column:
    """The i-th 16-bit block."""
    return F.shiftrightunsigned(fp, 48 - 16 * i).bitwiseAND(F.lit(0xFFFF))


def _rotated(fp: Column, left: int) -> Column:
    return fp if not left else F.shiftleft(fp, left).bitwiseOR(F.shiftrightunsigned(fp, 64 - left))


class NearDuplicates:
    """Classes of documents whose fingerprints link, directly or through others."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET, hot_rows: int = 20_000):
        rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
        self.id_col = id_col
        self.prints = stored(rows.mapInArrow(_fingerprints(shingle), "id long, fp long"), "fingerprints")
        self.nodes = stored(self.prints.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("node")), "fingerprint-nodes")
        self.links = stored(self._links(budget, hot_rows), "links")
        self.classes = stored(connected_components(self.links), "classes")

    def _links(self, budget: int, hot_rows: int) -> DataFrame:
        if budget > 3:
            raise ValueError("four blocks prove links of up to 3 differing bits")
        nodes = self.nodes
        views = nodes.select("node", F.explode(F.array(*[F.struct((_block(F.col("fp"), i) + (i << 16)).alias("part"), _rotated(F.col("fp"), 16 * i).alias("key")) for i in range(4)])).alias("view"))
        views = views.select("view.part", "view.key", "node")
        hot = stored(views.groupBy("part").count().where(F.col("count") > hot_rows).select("part", F.lit(True).alias("hot")), "hot-parts")
        if hot.isEmpty():
            return self._trie(views, 48, budget)
        marked = views.join(hot, "part", "left")
        low = F.col("key").bitwiseAND(F.lit((1 << 48) - 1))
        sub = [F.struct((F.col("part") * 4 + i).alias("_p"), F.shiftrightunsigned(low, 36 - 12 * i).bitwiseAND(F.lit(0xFFF)).alias("_s")) for i in range(4)]
        finer = marked.where("hot").select("key", "node", F.explode(F.array(*sub)).alias("s")).select(((F.col("s._p") + 1) * 4096 + F.col("s._s") + (1 << 20)).alias("part"), "key", "node")
        return self._trie(marked.where("hot IS NULL").select("part", "key", "node").unionByName(finer), 48, budget)

    def _trie(self, views: DataFrame, bits: int, budget: int) -> DataFrame:
        parts = int(views.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return views.repartition(parts, "part").mapInArrow(_joined(bits, budget), "u long, v long").distinct()

    def labelled(self) -> DataFrame:
        """One row a document: id, fingerprint (16 hex digits), component_id."""
        named = self.nodes.join(self.classes, self.nodes["node"] == self.classes["node"], "left").select("fp", F.coalesce("component", self.nodes["node"]).alias("component"))
        named = stored(named, "fingerprint-classes")
        hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
        joined = self.prints.join(named, "fp", "left")
        return joined.select(F.col("id").alias(self.id_col), hexed.alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))

    def dropped(self) -> DataFrame:
        """Ids of documents that another one of their class stands for: all but the smallest id."""
        return self.labelled().where(F.col(self.id_col) != F.col("component_id")).select(self.id_col).distinct()
