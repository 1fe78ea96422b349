"""Passages repeated across documents, by sparse suffix arrays.

Of each text's suffixes (by words), only those at content-selected positions are kept: in every
``WIDTH`` successive ``ANCHOR``-word runs, those with the smallest hash (minimisers; of equal ones all). So copies of a passage of
LEAST = WIDTH + ANCHOR - 1 words select the same positions in it, wherever it stands. An anchor's context is the BACK words before it
and the LEAST words from it on; every passage of LEAST words around the anchor lies in it. A word is repeated if it lies
in LEAST successive words that another document has too; the longest stretches of such words are reported.

1. A pass over the texts makes narrow rows: hashes of anchor and context, and the position. Anchors of a periodic stretch with equal
   contexts are one row (its first and last position), so a line repeated for ever has few rows.
2. A two-pass Bloom filter leaves out anchors that surely occur once. The rest is counted by (anchor, context): a context that
   two documents have is repeated whole, and however many have it, it is one row from here on.
3. Only for anchors with several contexts are the words themselves needed. A second pass over the texts with such rows reads one
   occurrence of each context. These suffixes are sorted by the words from the anchor on, and by those before it, read backwards; each is
   compared with its nearest neighbours of other documents, and the match is extended to the other side of the anchor: a match counts if both
   sides together have LEAST words.
4. Where the longest match to one side and a neighbour that counts are not the same, the windows of LEAST words around the anchor are
   looked up one by one by hash, among the contexts of that anchor.

The sorts are range partitionings; contexts differ, so an anchor with very many is dealt over many tasks. Rows at the
edges of partitions (one run of equal documents and the next other one) are compared in a second job, by anchor. Nothing is sent to the driver.

Words are compared by 32-bit hashes, anchors and contexts by 64-bit ones. Texts are taken as they are, split at ASCII white space.

Defined cases: null texts are empty; texts of fewer than LEAST words have no passage. A passage repeated
only within a document isn't reported. Each row is a document of its own, also if its id is null or repeated.
Empty tables give no rows. Columns that clash in name don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.exact_dedup import RepeatFilter
from lattica.llm.shared import Rows, bucket_of, read_bucket, scratch, stored, whole_text, write_buckets
from lattica.llm.words import word_hashes

ANCHOR = 20
WIDTH = 31
LEAST = ANCHOR + WIDTH - 1
BACK = LEAST - ANCHOR
TASK_ROWS = 50_000
BATCH = 1000
#: Rows of a file whose selected positions are read at once, and positions of a bucket.
BLOCK_BITS = 14
BUCKET_POSITIONS = 250_000
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


class Batch:
    """The words of some texts one after another, with padding between them."""

    def __init__(self, texts: pa.Array):
        words, self.n = word_hashes(texts)
        self.start = LEAST + np.append(0, np.cumsum(self.n[:-1] + LEAST)) if len(texts) else np.zeros(0, np.int64)
        self.words = np.zeros(int((self.n + LEAST).sum()) + LEAST, np.uint64)
        before = np.append(0, np.cumsum(self.n[:-1]))
        self.words[np.repeat(self.start - before, self.n) + np.arange(len(words))] = words


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of runs, from those of their two parts."""
    h = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
    return h ^ (h >> np.uint64(29))


def _doubled(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over all windows of n, by ever longer ones; op must not mind overlap."""
    size = 1
    while size * 2 <= n:
        x = op(x[: len(x) - size], x[size:])
        size *= 2
    return op(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def anchors(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, position, anchor hash and context hash of all minimisers, in order."""
    w, none = batch.words, np.zeros(0, np.int64)
    h2 = joined(w[:-1], w[1:])
    h4 = joined(h2[:-2], h2[2:])
    h8 = joined(h4[:-4], h4[4:])
    h16 = joined(h8[:-8], h8[8:]) if len(h8) > 8 else none
    if not len(h16) or not (batch.n >= LEAST).any():
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    h32 = joined(h16[:-16], h16[16:])
    h64 = joined(h32[:-32], h32[32:])
    run = joined(h16[:-4], h4[16 : 16 + len(h16) - 4])
    # runs that lie in a text, and windows of runs that do
    edge = np.zeros(len(w) + 1, np.int32)
    long_enough = batch.n >= LEAST
    s, n = batch.start[long_enough], batch.n[long_enough]
    np.add.at(edge, s, 1)
    np.add.at(edge, s + n - ANCHOR + 1, -1)
    valid = np.cumsum(edge)[: len(run)] > 0
    h = np.where(valid, run, MOST)
    low = _doubled(h, WIDTH, np.minimum)
    edge[:] = 0
    np.add.at(edge, s, 1)
    np.add.at(edge, s + n - LEAST + 1, -1)
    low = np.where(np.cumsum(edge)[: len(low)] > 0, low, 0)
    # a run is selected if it is the lowest of some window that has it
    best = _doubled(np.concatenate([np.zeros(WIDTH - 1, np.uint64), low, np.zeros(WIDTH - 1, np.uint64)]), WIDTH, np.maximum)[: len(h)]
    at = np.flatnonzero(valid & (best == h))
    text = np.searchsorted(batch.start, at, side="right") - 1
    first = at - BACK
    return text, at - batch.start[text], run[at], joined(h64[first], h16[first + 64])


NARROW = "file long, row long, id long, n int, h1 long, h2 long, lo int, hi int"


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors (h1) with contexts (h2) and first and last position, from (text, file, row, id)."""
    names = [x.split()[0] for x in NARROW.split(", ")]
    for b in batches:
        for lo in range(0, b.num_rows, BATCH):
            own = b.slice(lo, BATCH)
            batch = Batch(own.column(0))
            text, at, h, ctx = anchors(batch)
            if not len(at):
                continue
            new = (np.diff(text, prepend=-1) != 0) | (np.diff(at, prepend=0) > WIDTH) | (np.append(True, h[1:] != h[:-1])) | np.append(True, ctx[1:] != ctx[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            rows = pa.array(text[first])
            columns = [*(own.column(i).take(rows) for i in (1, 2, 3)), pa.array(batch.n[text[first]].astype(np.int32)), pa.array(h[first].view(np.int64)), pa.array(ctx[first].view(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at[first].astype(np.int32)), pa.array(at[last].astype(np.int32))], names)


SUFFIXES = "ahead boolean, h1 long, h2 long, who long, many boolean, before int, after int, key binary"


def _suffixes(uri: str):
    """Both suffixes of the chosen contexts, from (text, file, row, bucket)."""
    names = [x.split()[0] for x in SUFFIXES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            file, row, bucket = (b.column(i).to_numpy() for i in (1, 2, 3))
            which, picks = [np.zeros(0, np.int64)], []
            for u in np.unique(np.stack([bucket, file]), axis=1).T.tolist():
                at = np.flatnonzero((bucket == u[0]) & (file == u[1]))
                rows, found = read_bucket(uri, *u)
                lo, n = np.searchsorted(rows, row[at], "left"), np.searchsorted(rows, row[at], "right") - np.searchsorted(rows, row[at], "left")
                if n.any():
                    which.append(np.repeat(at, n))
                    picks.append(found.take(pa.array(np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()))))
            which = np.concatenate(which)
            if not len(which):
                continue
            picks = pa.concat_tables(picks).combine_chunks()
            for lo in range(0, len(which), 10 * BATCH):
                own, picked = which[lo : lo + 10 * BATCH], picks.slice(lo, 10 * BATCH)
                texts, of = np.unique(own, return_inverse=True)
                batch = Batch(b.column(0).take(pa.array(texts)))
                pos, h1, h2, who, many = (picked[c].to_numpy() for c in ("lo", "h1", "h2", "who", "many"))
                at, left = batch.start[of] + pos, batch.n[of] - pos
                short = np.concatenate([(batch.words >> np.uint64(32)).astype(">u4"), np.zeros(LEAST, ">u4")])
                ahead = short[at[:, None] + ANCHOR + np.arange(BACK)]
                back = short[at[:, None] - 1 - np.arange(BACK)]
                for forward, two in ((True, (ahead, back)), (False, (back, ahead))):
                    key = np.concatenate(two, axis=1)
                    columns = [np.full(len(at), forward), h1, h2, who, many, np.minimum(pos, BACK).astype(np.int32), np.minimum(left, LEAST).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(list(map(bytes, key)), pa.binary())], names)

    return run


FOUND = "h1 long, h2 long, most_before int, most_after int, before int, after int, edge boolean, " + ", ".join(x.replace("h1 ", "edge_h1 ").replace("h2 ", "edge_h2 ").replace("before ", "edge_before ").replace("after ", "edge_after ") for x in SUFFIXES.split(", "))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common beginnings of rows."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def compare(t: pa.Table, edges: bool) -> Iterator[pa.RecordBatch]:
    """What sorted suffixes share with their nearest neighbours of other documents; with edges, also the rows that next partitions need."""
    n = len(t)
    ahead, h1, h2, who, many, before, after = (t[c].to_numpy() for c in ("ahead", "h1", "h2", "who", "many", "before", "after"))
    keys = np.frombuffer(b"".join(t["key"].to_pylist()), ">u4").reshape(n, 2 * BACK)
    same = (h1[1:] == h1[:-1]) & (ahead[1:] == ahead[:-1])
    group = np.append(0, np.cumsum(~same))
    # a context of many documents is a neighbour of its own kind
    run = np.append(0, np.cumsum(~same | (who[1:] != who[:-1]) | many[1:] | many[:-1]))
    first = np.flatnonzero(np.diff(run, prepend=-1))
    ends = np.append(first[1:], n)
    most = np.zeros((2, n), np.int64)
    counts = np.zeros((2, n), np.int64)
    for other in (first[run] - 1, ends[run]):
        ok = np.flatnonzero((other >= 0) & (other < n))
        ok = ok[group[other[ok]] == group[ok]]
        a, b = keys[ok], keys[other[ok]]
        one, two = _common(a[:, :BACK], b[:, :BACK]), _common(a[:, BACK:], b[:, BACK:])
        right = np.minimum(ANCHOR + np.where(ahead[ok], one, two), after[ok])
        left = np.minimum(np.where(ahead[ok], two, one), before[ok])
        most[0, ok] = np.maximum(most[0, ok], np.where(ahead[ok], 0, left))
        most[1, ok] = np.maximum(most[1, ok], np.where(ahead[ok], right, 0))
        enough = left + right >= LEAST
        counts[0, ok] = np.maximum(counts[0, ok], np.where(enough, left, 0))
        counts[1, ok] = np.maximum(counts[1, ok], np.where(enough, right, 0))
    some = most.any(axis=0) & ~many
    columns = [h1[some], h2[some], *(x[some].astype(np.int32) for x in (*most, *counts)), np.zeros(int(some.sum()), bool)]
    schema = pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]]) for x in FOUND.split(", ")])
    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(pa.nulls(int(some.sum()), f.type) for f in list(schema)[7:])], schema=schema)
    if edges:
        # at either end: the run of one document and the row behind it, of one anchor
        top = np.flatnonzero((run <= 1) & (group == 0))
        top = top[: int((run[top] == 0).sum()) + 1]
        low = np.flatnonzero((run >= run[-1] - 1) & (group == group[-1]))
        low = low[-(int((run[low] == run[-1]).sum()) + 1) :]
        at = pa.array(np.union1d(top, low))
        rows = [t[c].take(at).combine_chunks() for c in (x.split()[0] for x in SUFFIXES.split(", "))]
        rows = [r.chunk(0) if isinstance(r, pa.ChunkedArray) else r for r in rows]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(at), f.type) for f in list(schema)[:6]), pa.array(np.ones(len(at), bool)), *rows], schema=schema)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = list(batches)
    if sum(b.num_rows for b in found):
        yield from compare(pa.Table.from_batches(found).combine_chunks(), True)


def _edges_compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted edge rows, by anchor: a task compares as many whole anchors at a time as make TASK_ROWS."""
    held: list[pa.Table] = []
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        if sum(map(len, held)) >= TASK_ROWS:
            t = pa.concat_tables(held).combine_chunks()
            h1, ahead = t["h1"].to_numpy(), t["ahead"].to_numpy()
            cut = np.flatnonzero((h1 != h1[-1]) | (ahead != ahead[-1]))
            if len(cut):
                yield from compare(t.slice(0, cut[-1] + 1).combine_chunks(), False)
                t = t.slice(cut[-1] + 1)
            held = [t]
    if held:
        yield from compare(pa.concat_tables(held).combine_chunks(), False)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans sorted by row and start, united where they overlap or touch."""
    names, now, out = ["id", "start_word", "end_word"], None, []
    for b in batches:
        for file, row, doc, lo, hi in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if now and now[0] == (file, row) and lo <= now[3]:
                now[3] = max(now[3], hi)
            else:
                if now:
                    out.append(now[1:])
                now = [(file, row), doc, lo, hi]
        if len(out) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
            out = []
    if now:
        out.append(now[1:])
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)


def _window_matches(suffixes: DataFrame, open_: DataFrame) -> DataFrame:
    """h1, h2, before, after: the best windows of the contexts in open_ (h1, h2), by looking all windows of their anchors up."""
    rows = suffixes.where("ahead").join(open_.select("h1").distinct(), "h1", "left_semi")
    window = F.concat(F.expr(f"substring(key, {4 * BACK + 1}, 4 * b)"), F.expr(f"substring(key, 1, 4 * ({BACK} - b))"))
    each = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(BACK - 1))).alias("b")).where(f"b <= before AND {LEAST} - b <= after")
    each = stored(each.select("h1", "h2", "who", "many", "b", F.xxhash64("b", "h1", window).alias("w1"), F.xxhash64(window, "h1", "b").alias("w2")), "windows")
    shared = each.groupBy("w1", "w2").agg(F.min("who").alias("a"), F.max("who").alias("z"), F.max("many").alias("any")).where("any OR a < z").select("w1", "w2")
    shared = stored(shared, "shared-windows")
    hit = each.join(shared, ["w1", "w2"]).join(open_.select("h1", "h2"), ["h1", "h2"], "left_semi")
    return hit.groupBy("h1", "h2").agg(F.max("b").alias("before"), (LEAST - F.min("b")).alias("after"))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", task_rows: int = TASK_ROWS, filter_bytes: int = 64 << 20, dealt_rows: int = 2_000_000) -> DataFrame:
    """id, start_word, end_word (exclusive) of each longest stretch of words that lie in LEAST successive ones that other documents have too."""
    spark = docs.sparkSession
    table = Rows(docs)
    file, row = (F.col(c) for c in table.key)
    rows = table.keyed().select(whole_text(text_col).alias("text"), file.alias("file"), row.alias("row"), F.col(id_col).cast("long").alias("id"))

    narrow = stored(rows.mapInArrow(_narrow, NARROW), "anchors")
    # the filter's two hashes are both of the anchor
    hashed = narrow.withColumnRenamed("h2", "context").withColumn("h2", F.xxhash64("h1"))
    maybe = RepeatFilter(hashed, narrow.count(), filter_bytes, dealt_rows).flagged("maybe").where("maybe")
    narrow = stored(maybe.select("file", "row", "id", "n", "h1", F.col("context").alias("h2"), "lo", "hi"), "possible")

    who = F.xxhash64("file", "row")
    contexts = narrow.groupBy("h1", "h2").agg(F.min(who).alias("who"), F.max(who).alias("last"), F.min(F.struct("file", "row", "lo")).alias("at"))
    contexts = stored(contexts.select("h1", "h2", "who", (F.col("who") < F.col("last")).alias("many"), F.greatest("who", "last").alias("last"), "at"), "contexts")
    mixed = contexts.groupBy("h1").agg(F.min("who").alias("a"), F.max("last").alias("z"), F.count(F.lit(1)).alias("n")).where("a < z AND n > 1").select("h1")
    # both sides of these joins are written, so that AQE can split a common anchor, window or context
    picked = stored(contexts.join(stored(mixed, "mixed"), "h1").select("at.file", "at.row", "at.lo", "h1", "h2", "who", "many"), "picked")

    uri, buckets = scratch(spark, "picks"), max(1, picked.count() // BUCKET_POSITIONS)
    write_buckets(picked, buckets, BLOCK_BITS, uri)
    texts = rows.select("text", "file", "row", bucket_of(F.col("file"), F.col("row"), buckets, BLOCK_BITS).alias("bucket"))
    suffixes = stored(texts.mapInArrow(_suffixes(uri), SUFFIXES), "suffixes")

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes.count() // task_rows))
    order = ["ahead", "h1", "key"]
    found = stored(suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_compared, FOUND), "matches")
    edges = found.where("edge").select(*(F.col(f"edge_{c}" if c in ("h1", "h2", "before", "after") else c).alias(c) for c in (x.split()[0] for x in SUFFIXES.split(", ")))).distinct()
    again = edges.repartition("ahead", "h1").sortWithinPartitions(*order).mapInArrow(_edges_compared, FOUND)
    both = found.where("NOT edge").unionByName(again).groupBy("h1", "h2").agg(*[F.max(c).alias(c) for c in ("most_before", "most_after", "before", "after")])
    matches = stored(both.where(f"most_before + most_after >= {LEAST}"), "best-matches")
    open_ = matches.where("before < most_before OR after < most_after")
    looked_up = _window_matches(suffixes, open_)
    some = matches.select("h1", "h2", "before", "after").unionByName(looked_up).groupBy("h1", "h2").agg(F.max("before").alias("before"), F.max("after").alias("after")).where("after > 0")

    # contexts of many documents are repeated whole
    whole = contexts.where("many").select("h1", "h2", F.lit(BACK).alias("before"), F.lit(LEAST).alias("after"))
    reach = stored(some.unionByName(whole), "reach")
    spans = narrow.join(reach, ["h1", "h2"]).select("file", "row", "id", F.greatest(F.lit(0), F.col("lo") - F.col("before")).alias("lo"), F.least("n", F.col("hi") + F.col("after")).alias("hi"))
    dealt = spans.where(f"hi - lo >= {LEAST}").repartition("file", "row").sortWithinPartitions("file", "row", "lo", "hi")
    return dealt.mapInArrow(_united, "id long, start_word long, end_word long").withColumnRenamed("id", id_col)
