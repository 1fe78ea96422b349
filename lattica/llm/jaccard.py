"""Near copies by the Jaccard similarity of their shingle sets: SimHash fingerprints, a trie join with an error budget, an exact check.

A text's fingerprint has ``WORDS`` 64-bit words; a bit is set where over half of the hashes of its different shingles have it. At a similarity of 0.8
a bit differs with a probability of 0.15, so some 10 of 64 do, and no block of 16 bits is sure to agree. So the first words are cut into
``BLOCKS`` blocks of ``BLOCK_BITS``, each of which agrees with a probability of 0.14: a pair at 0.8 agrees in none 3 times in a million, and less often above.
In a block's value, the two last words are a key: sorted, they are a binary trie, whose node pairs are traversed together until the differing bits
exceed ``BUDGET`` (of the first 64) and ``BUDGETS`` (of both); at 0.8 a pair has more 2 times in 100,000. Texts that meet one so go on with whole
fingerprints, in those blocks only, with a budget of ``WIDE`` bits for all words, which a pair at 0.8 exceeds as rarely. Those are the only losses, by calculation.
What is left is confirmed on the texts themselves: the exact similarity of the shingle sets is ``similarity`` or more.

Of few shingles a majority says little. Texts of up to ``SHORT`` shingles, and those that may be similar to one, meet without loss by the rarest
shingles of each too (as many as a document may lack and still be similar, and one), of which similar ones share one.

A group of n near copies has n squared pairs. So in the first rounds each text is compared only with the nearest one of a smaller id,
and confirmed ones go; rounds go on while they remove a tenth of what has a partner. The last round compares all pairs of what stays, each in the first block that agrees.
Hence each document that goes has a confirmed one with a smaller id, and no two that stay are similar (but for the losses above).
A block's value with more than ``HOT_ROWS`` texts is cut into slices by hash in the first rounds, which loses nothing, as the last one takes it whole.

Defined cases: A-Z is lower-cased, words are runs of anything but ASCII white space; a text of fewer words than a shingle has one
shingle, its words; null, empty and blank texts have one shingle, the empty one. Null ids are not compared. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.shared import Rows, release, stored, whole_text
from lattica.llm.simhash import trie_pairs

SHINGLE = 5
SIMILARITY = 0.8
BLOCK_BITS = 12
BLOCKS = 85
#: 1020 bits in blocks, and two words more for the trie.
WORDS = 18
BUDGET, BUDGETS, WIDE = 23, 38, 227
SHORT = 64
#: Keys of a trie's node that are compared directly.
LEAF = 256
HOT_ROWS = 20_000
TASK_ROWS = 100_000
SEED = 42
STEP = 255


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined, one = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([one(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    lo, hi = (ends - sizes)[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist()
    return np.unique(np.array([one(joined[a:b], SEED) for a, b in zip(lo, hi, strict=True)], np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


FACTORS = np.array([xxhash.xxh64_intdigest(b"%d" % i, SEED) | 1 for i in range(WORDS)], np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The words of a fingerprint: a bit is set where over half of the hashes, mixed anew for each word, have it."""
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), STEP):  # counts of a step fit into bytes
        h = hashes[at : at + STEP, None] * FACTORS
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        counts += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def blocks(words: np.ndarray) -> np.ndarray:
    """The blocks of fingerprints, a row each, with the block's number before its bits."""
    bits = np.unpackbits(np.ascontiguousarray(words[:, : WORDS - 2]).view(np.uint8), axis=1, bitorder="little")[:, : BLOCKS * BLOCK_BITS]
    values = bits.reshape(len(words), BLOCKS, BLOCK_BITS) @ (1 << np.arange(BLOCK_BITS, dtype=np.int64))
    return values + (np.arange(BLOCKS) << BLOCK_BITS)


VIEW = "part long, words binary, id long, place long, slice long"


def _views(shingle: int):
    """A row for each block of each text, from (id, place, text): with the trie's words, or for texts with their parts, (id, place, text, parts), with all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                own = b.slice(lo, 500)
                words = np.stack([sketch(shingles(t, shingle)) for t in own.column(2).to_pylist()])
                if b.num_columns > 3:
                    parts = own.column(3)
                    part, n = parts.flatten().to_numpy(), parts.value_lengths().to_numpy()
                else:
                    part, n = blocks(words).ravel(), np.full(len(words), BLOCKS)
                    words = np.ascontiguousarray(words[:, -2:])
                at = pa.array(np.repeat(np.arange(len(words)), n))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * words.shape[1]), len(words), [None, pa.py_buffer(words.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part), packed.take(at), own.column(0).take(at), own.column(1).take(at), pa.array(np.zeros(len(at), np.int64))], ["part", "words", "id", "place", "slice"])

    return run


def _brief(part: np.ndarray) -> np.ndarray:
    """Which parts are shingles of short texts, and not blocks."""
    return (part < 0) | (part >= BLOCKS << BLOCK_BITS)


def _partners(t: pa.Table, leaf: int, every: bool) -> pa.RecordBatch:
    """Each pair within the budgets (every), or each row with a partner and the nearest of smaller id, if there is one."""
    part, id_, place, slice_ = (t[c].to_numpy() for c in ("part", "id", "place", "slice"))
    words = np.frombuffer(b"".join(t["words"].to_pylist()), "<u8").reshape(len(part), -1)
    brief, all_words = _brief(part), words.shape[1] == WORDS
    key = np.where(brief, 0, words[:, -2])
    order = np.lexsort((key, slice_, part))
    part, id_, place, words, brief, key, slice_ = (x[order] for x in (part, id_, place, words, brief, key, slice_))
    group = np.cumsum(np.append(False, (np.diff(part) != 0) | (np.diff(slice_) != 0)))
    rank = np.empty(len(part), np.int64)
    by_id = np.lexsort((place, id_))
    rank[by_id] = np.cumsum(np.append(False, (np.diff(id_[by_id]) != 0) | (np.diff(place[by_id]) != 0)))
    some = slice_ > 0  # which may have partners in other slices
    held, n = [np.zeros((3, 0), np.int64)], 0

    def nearest(x: np.ndarray) -> np.ndarray:
        x = x[:, np.lexsort((rank[x[1]], x[2], x[0]))]
        return x[:, np.flatnonzero(np.diff(x[0], prepend=-1))]

    for a, b in trie_pairs(key, group, 64, BUDGET, leaf):
        for lo in range(0, len(a), 1 << 16):
            x, y = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
            far = np.bitwise_count(words[x, -1] ^ words[y, -1]) + np.bitwise_count(words[x, -2] ^ words[y, -2]).astype(np.int64)
            near = ((far <= BUDGETS) | brief[x]) & (rank[x] != rank[y])
            x, y, far = x[near], y[near], far[near]
            if all_words:
                apart = words[x] ^ words[y]
                far = np.bitwise_count(apart).sum(axis=1, dtype=np.int64)
                near = (far <= WIDE) | brief[x]
                if every:  # in the first block that agrees
                    same = (blocks(apart) & ((1 << BLOCK_BITS) - 1)) == 0
                    near &= brief[x] | (same.argmax(axis=1) == part[x] >> BLOCK_BITS)
                x, y, far = x[near], y[near], far[near]
            later = rank[x] > rank[y]
            some[x] = some[y] = True
            held.append(np.stack([np.where(later, x, y), np.where(later, y, x), far]))
            n += len(x)
            if n > 1 << 20 and not every:
                held = [nearest(np.concatenate(held, axis=1))]
                n = held[0].shape[1]
    x, y, far = np.concatenate(held, axis=1) if every else nearest(np.concatenate(held, axis=1))
    if not every:  # rows that only larger ids meet come along without a pair
        alone = np.setdiff1d(np.flatnonzero(some), x)
        x, y, far = np.append(x, alone), np.append(y, np.full(len(alone), -1)), np.append(far, np.full(len(alone), 64 * WORDS))
    columns = [pa.array(c[x]) for c in (part, id_, place)] + [pa.array(far)] + [pa.array(c[y], mask=y < 0) for c in (id_, place)]
    return pa.RecordBatch.from_arrays(columns, ["part", "id", "place", "far", "other", "other_place"])


MET = "part long, id long, place long, far long, other long, other_place long"


def _met(leaf: int, every: bool):
    """Partners, from rows sorted by part and slice; some TASK_ROWS at a time, whole slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[pa.Table] = []
        n = 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            n += b.num_rows
            if n >= TASK_ROWS and b.num_rows:
                t = pa.concat_tables(held).combine_chunks()
                part, slice_ = t["part"].to_numpy(), t["slice"].to_numpy()
                cut = len(t) - int(np.argmin(np.append(((part == part[-1]) & (slice_ == slice_[-1]))[::-1], False)))
                if cut:
                    yield _partners(t.slice(0, cut).combine_chunks(), leaf, every)
                held, n = [t.slice(cut)], len(t) - cut
        if n:
            yield _partners(pa.concat_tables(held).combine_chunks(), leaf, every)

    return run


def _shingled(shingle: int, most: float):
    """Shingles of the texts that have at most so many, from (id, place, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                own = b.slice(lo, 500)
                # a text of more words has more shingles, but for repeats
                sets = [shingles(t, shingle) for t in own.column(2).to_pylist()]
                sizes = np.array([len(x) for x in sets], np.int64)
                few = np.flatnonzero(sizes <= most)
                at, n = np.repeat(few, sizes[few]), sizes[few]
                keys = np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in few.tolist())]).view(np.int64)
                yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(at)), own.column(1).take(pa.array(at)), pa.array(keys), pa.array(np.repeat(n, n).astype(np.int32))], ["id", "place", "key", "size"])

    return run


def rarest_shared(texts: DataFrame, shingle: int, similarity: float, most: float) -> DataFrame:
    """key, id, place: of each text's shingles (at most so many) the rarest, of which any two texts of that similarity share one."""
    each = stored(texts.select("id", "place", "text").mapInArrow(_shingled(shingle, most), "id long, place long, key long, size int"), "shingles")
    often = stored(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-shingles")
    ranked = each.join(often, "key", "left").withColumn("at", F.row_number().over(Window.partitionBy("id", "place").orderBy(F.coalesce("n", F.lit(1)), "key")))
    return ranked.where(F.col("n").isNotNull() & (F.col("at") <= F.col("size") - F.ceil(F.col("size") * F.lit(similarity - 1e-9)) + 1)).select("key", "id", "place")


def _confirmed(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known: dict[str, np.ndarray] = {}

        def held(text: str) -> np.ndarray:
            if text not in known:
                if len(known) >= 200:
                    known.clear()
                known[text] = shingles(text, shingle)
            return known[text]

        for b in batches:
            texts, others = (b.column(i).to_pylist() for i in (2, 3))
            similar = [jaccard(held(x), held(y)) >= similarity for x, y in zip(texts, others, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(similar, pa.bool_())) for i in (0, 1)], ["id", "place"])

    return run


def _sliced(views: DataFrame, hot_rows: int) -> DataFrame:
    """Parts of more than hot_rows rows in slices, from 1."""
    hot = stored(views.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows), "hot-parts")
    if hot.isEmpty():
        return views
    slice_ = F.pmod(F.xxhash64("id", "place"), F.ceil(F.col("n") / hot_rows)).cast("long") + 1
    return views.join(F.broadcast(hot), "part", "left").select("part", "words", "id", "place", F.coalesce(slice_, F.lit(0).cast("long")).alias("slice"))


def _near(rows: DataFrame, shingle: int, similarity: float, small: int, short: int, hot_rows: int) -> DataFrame:
    """id, place of the rows (id, place, text) that are near copies of one with a smaller (id, place)."""

    def met(views: DataFrame, every: bool) -> DataFrame:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = (views if every else _sliced(views, hot_rows)).repartition(parts, "part", "slice").sortWithinPartitions("part", "slice")
        return dealt.mapInArrow(_met(small, every), MET)

    def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        texts = texts.select("id", "place", "text")
        both = pairs.join(texts, ["id", "place"]).join(texts.toDF("other", "other_place", "other_text"), ["other", "other_place"]).select("id", "place", "text", "other_text")
        return stored(both.mapInArrow(_confirmed(shingle, similarity), "id long, place long").distinct(), "near-copies")

    nearest = F.min(F.when(F.col("other_place").isNotNull(), F.struct("far", "other", "other_place"))).alias("nearest")
    pair = [F.col("id"), F.col("place"), F.col("nearest.other").alias("other"), F.col("nearest.other_place").alias("other_place")]
    brief = rarest_shared(rows, shingle, similarity, short / similarity).select(F.xxhash64("key").alias("part"), F.lit(bytes(16)).alias("words"), "id", "place", F.lit(0).cast("long").alias("slice"))
    views = stored(rows.mapInArrow(_views(shingle), VIEW).unionByName(brief), "views")
    first = stored(met(views, False).groupBy("id", "place").agg(F.collect_list("part").alias("parts"), nearest), "partners")
    texts = stored(rows.join(first.select("id", "place", "parts"), ["id", "place"]).select("id", "place", "text", "parts"), "partner-texts")
    left, pairs, gone = first.count(), first.where("nearest IS NOT NULL").select(*pair), None
    while True:
        found = similar(pairs, texts)
        gone = found if gone is None else gone.unionByName(found)
        n = found.count()
        every, left = n * 10 <= left, left - n
        texts = stored(texts.join(found, ["id", "place"], "left_anti"), "texts-left")
        views = texts.mapInArrow(_views(shingle), VIEW)
        if every:
            return gone.unionByName(similar(stored(met(views, True).select("id", "place", "other", "other_place").distinct(), "pairs"), texts)).distinct()
        views = stored(views, "views-left")
        pairs = stored(met(views, False).groupBy("id", "place").agg(nearest).where("nearest IS NOT NULL").select(*pair), "nearest")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, small: int = LEAF, short: int = SHORT, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Ids of documents that are near copies of one with a smaller id."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("place"), whole_text(text_col).alias("text"))
    return _near(rows, shingle, similarity, small, short, hot_rows).select(F.col("id").alias(id_col)).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, small: int = LEAF, short: int = SHORT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """docs without near copies of documents that stay: those with smaller ids, and of rows with one id or none those with a smaller hash of their place.

    A row without an id comes after all others.
    """
    rows = Rows(docs)
    id_ = F.col(id_col).cast("long")
    # 62 bits of a hash, above them whether there is no id
    place = F.shiftrightunsigned(F.xxhash64(*rows.key), 2) + F.when(id_.isNull(), F.lit(1 << 62)).otherwise(F.lit(0))
    keyed = rows.keyed().select(F.coalesce(id_, F.lit((1 << 63) - 1)).alias("id"), place.alias("place"), whole_text(text_col).alias("text"), *(F.col(c).alias(f"key_{i}") for i, c in enumerate(rows.key)))
    gone = _near(keyed.select("id", "place", "text"), shingle, similarity, small, short, hot_rows)
    return rows.without(keyed.select("id", "place", "key_0", "key_1").join(gone, ["id", "place"], "left_semi").select("key_0", "key_1"))
