"""Exact deduplication by two Bloom passes.

Pass 1 sets the cells of every row's hash in a Bloom filter that tells *once* from *twice or more*:
tasks send the cells they touched (sorted, delta-coded), and each slice of the filter is merged by
itself. Pass 2 tests every row: a row with a cell that was touched only once is unique and passes
straight through. Only possibly repeated rows shuffle, grouped by the SHA-256 of their text.

Size: a row has 16 to 32 cells of one bit, so about 0.2 % of unique rows are suspected in vain. A
filter has at most ``filter_bytes``; for more rows the hash space is cut into ranges, each with a
filter of that size. The narrow rows (id, digest, row key), never texts, are then dealt by range once, so that in either pass a file of them
needs one range only, and a filter is loaded once for each such file.

``kept`` reads the texts a second time and leaves rows out by their key, as told by the decisions; texts are neither shuffled nor hashed again.

Defined cases: a null text is an empty text. Runs of white space count as one space. A null id
stays only if its whole group has null ids. Rows that repeat both id and text: exactly one is kept.
Empty tables give empty results; other columns are not touched.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import Rows, open_fs, resident, scratch, stored, whole_text

PROBES = 4
CELLS_PER_ROW = 16
FLUSH_ROWS = 500_000
#: Rows of a range that a file holds where there is more than one range.
DEALT_ROWS = 2_000_000


def normalised(col: str = "text") -> Column:
    """The text with each run of ASCII white space as one space."""
    return F.regexp_replace(whole_text(col), r"[\x20\x09-\x0D]+", " ")


def _cells(h1: np.ndarray, h2: np.ndarray, mask: int) -> np.ndarray:
    """The cells of each hash pair, one column a probe; a probe has its own residue class, so no row hits a cell twice."""
    a, b = h1.astype(np.uint64), h2.astype(np.uint64) | np.uint64(1)
    rows = [(a + np.uint64(i) * b) * np.uint64(PROBES) + np.uint64(i) for i in range(PROBES)]
    return np.stack(rows, axis=1) & np.uint64(mask)


def _packed(cells: np.ndarray) -> bytes:
    """Sorted cells as deltas."""
    return zlib.compress(np.diff(cells, prepend=cells.dtype.type(0)).astype("<u4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4"), dtype=np.int64)


def _partial_filters(mask: int, slice_cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            group = np.concatenate([x[0] for x in held])
            cells = _cells(np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]), mask)
            held.clear()
            out: dict[str, list] = {"grp": [], "slice": [], "once": [], "twice": []}
            for g in np.unique(group):
                found, counts = np.unique(cells[group == g].ravel(), return_counts=True)
                part = (found // np.uint64(slice_cells)).astype(np.int64)
                edges = np.flatnonzero(np.diff(part, prepend=-1))
                for lo, hi in zip(edges, [*edges[1:], len(part)], strict=True):
                    own = found[lo:hi] - np.uint64(part[lo] * slice_cells)
                    out["grp"].append(int(g))
                    out["slice"].append(int(part[lo]))
                    out["once"].append(_packed(own))
                    out["twice"].append(_packed(own[counts[lo:hi] > 1]))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("grp", pa.int32()), ("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

        for b in batches:
            held.append(tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            if sum(len(x[0]) for x in held) >= FLUSH_ROWS:
                yield from flush()
        yield from flush()

    return run


def _merged(slice_cells: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(slice_cells, bool), np.zeros(slice_cells, bool)
        for a, b in zip(rows["once"], rows["twice"], strict=True):
            cells = _unpacked(a)
            twice[cells[once[cells]]] = True
            once[cells] = True
            twice[_unpacked(b)] = True
        return pd.DataFrame({"grp": [key[0]], "slice": [key[1]], "bits": [np.packbits(twice, bitorder="little").tobytes()]})

    return run


@resident(maxsize=2)
def _filter(uri: str, group: int, n_bytes: int, slice_bytes: int) -> np.ndarray:
    """The filter of a hash range, read by an executor from the shared folder."""
    bits = np.zeros(n_bytes, np.uint8)
    fs, path = open_fs(uri)
    rows = pq.read_table(path, filesystem=fs, filters=[("grp", "=", group)])
    for part, data in zip(rows["slice"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        bits[part * slice_bytes : (part + 1) * slice_bytes] = np.frombuffer(data, np.uint8)
    return bits


class RepeatFilter:
    """Tells rows that are surely unique from those possibly repeated."""

    def __init__(self, rows: DataFrame, n: int, filter_bytes: int = 64 << 20, dealt_rows: int = DEALT_ROWS):
        """rows: a written table with h1, h2 and narrow columns; n: how many there are."""
        cells = 1 << max(16, math.ceil(math.log2(max(1, n) * CELLS_PER_ROW)))
        most = 1 << int(math.log2(filter_bytes * 8))
        self.groups, cells = max(1, cells // most), min(cells, most)
        self.mask, self.slice_cells = cells - 1, max(1 << 14, cells >> 8)
        self.path, self.rows = scratch(rows.sparkSession, "bloom"), rows
        if self.groups > 1:
            each = max(1, n // self.groups // dealt_rows)
            part = self._group(F.col("h1")) * each + F.pmod("h2", F.lit(each)).cast("int")
            self.rows = stored(rows.repartitionById(self.groups * each, part), "dealt-by-range")
        cut = self.rows.select(self._group(F.col("h1")).alias("grp"), "h1", "h2")
        parts = cut.mapInArrow(_partial_filters(self.mask, self.slice_cells), "grp int, slice int, once binary, twice binary")
        parts.groupBy("grp", "slice").applyInPandas(_merged(self.slice_cells), "grp int, slice int, bits binary").write.parquet(self.path)

    def _group(self, h1: Column) -> Column:
        return F.pmod(F.shiftrightunsigned(h1, 40), F.lit(self.groups)).cast("int")

    def flagged(self, name: str) -> DataFrame:
        """The rows with a column of that name: whether they may be repeated."""
        path, mask, groups, slice_bytes = self.path, self.mask, self.groups, self.slice_cells // 8

        @F.pandas_udf("boolean")
        def flag(h1: pd.Series, h2: pd.Series) -> pd.Series:
            a, b = h1.to_numpy(), h2.to_numpy()
            out = np.zeros(len(a), bool)
            group = (a.view(np.uint64) >> np.uint64(40)) % np.uint64(groups)
            for g in np.unique(group):
                own = group == g
                cells = _cells(a[own], b[own], mask).astype(np.int64)
                bits = _filter(path, int(g), (mask + 1) // 8, slice_bytes)
                out[own] = ((bits[cells >> 3] >> (cells & 7)) & 1).all(axis=1)
            return pd.Series(out)

        return self.rows.withColumn(name, flag("h1", "h2"))


class ExactDedup:
    """The decisions on a table of documents; ``decisions`` and ``kept`` are lazy over written tables."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = 64 << 20, dealt_rows: int = DEALT_ROWS):
        self.id_col, self.table = id_col, Rows(docs)
        file, row = self.table.key
        digests = self.table.keyed().select(F.col(id_col).alias("_id"), F.sha2(normalised(text_col), 256).alias("_sha"), F.col(file).alias("_file"), F.col(row).alias("_row"))
        hashed = stored(digests.select("*", F.xxhash64("_sha").alias("h1"), F.xxhash64("_sha", F.lit(1)).alias("h2")), "digests")
        self.filter = RepeatFilter(hashed, hashed.count(), filter_bytes, dealt_rows)
        flagged = self.filter.flagged("_maybe").drop("h1", "h2")
        self.suspects = stored(flagged.where("_maybe").drop("_maybe"), "suspects")
        self.passed = flagged.where("NOT _maybe").drop("_maybe")
        first = F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_file", "_row")).alias("_first")
        self.groups = stored(self.suspects.groupBy("_sha").agg(first, F.count(F.lit(1)).alias("_size")).where("_size > 1"), "groups")

    def _judged(self) -> DataFrame:
        """Possibly repeated rows with their group; the join's hot keys are left to AQE's skew handling."""
        own = (F.col("_row") == F.col("_first._row")) & (F.col("_file") == F.col("_first._file"))
        return self.suspects.join(self.groups, "_sha", "left").select("_id", "_sha", "_file", "_row", "_first", "_size", (F.col("_first").isNull() | own).alias("_kept"))

    def decisions(self) -> DataFrame:
        """One row a document: id, keep_id, group_size, kept, text_sha256."""
        i = self.id_col
        own = self.passed.select(F.col("_id").alias(i), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"))
        keep = F.when(F.col("_first").isNull(), F.col("_id")).otherwise(F.col("_first._id"))
        judged = self._judged().select(F.col("_id").alias(i), keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"))
        return own.unionByName(judged)

    def kept(self) -> DataFrame:
        """The documents that stay, with all their columns; only the keys of possibly repeated ones are shuffled."""
        return self.table.without(self._judged().where("NOT _kept").select("_file", "_row"))
