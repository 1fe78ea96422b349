"""Token ids as binary files: frequency-ranked ids in a byte-aligned code with separate control bytes.

Ids are replaced by their rank in order of falling frequency over the whole corpus (ties: smaller id
first), so that frequent ids take one byte. A rank takes one to four bytes; four two-bit lengths make
a control byte, and control bytes lie apart from data bytes. Decoding looks lengths up in a table of
256 rows and scatters the data bytes with numpy, without a loop over tokens.

One job writes everything. Its map side encodes the texts once and leaves each partition's id counts
as a file in the shared folder; rows of (id, ids) are dealt by range of document id; its reduce side,
which starts only after every map task has ended, reads all counts, ranks the ids and writes a file
for each range. Files are written under another name and then renamed, so a repeated task replaces
its own file with the same bytes. ``ranks.bin`` holds the ids in order of rank.

Defined cases: a null text is an empty text, which still gets the end id. Null document ids come
first; rows that repeat an id follow one another. Empty tables give no file. Other columns are not
read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.shared import open_fs, scratch, whole_text
from lattica.llm.tokens import encoder

MAGIC, BLOCK, END = b"LTKFILE1", b"BLK1", b"END1"
HEAD = struct.Struct("<4sIIII")
BLOCK_TOKENS = 1 << 18
#: For each control byte, the lengths of its four numbers.
LENGTHS = (((np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3) + 1).astype(np.uint8)


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    n = np.ascontiguousarray(numbers, "<u4")
    extra = (n > 0xFF).astype(np.uint8) + (n > 0xFFFF) + (n > 0xFFFFFF)
    codes = np.zeros(-(-len(n) // 4) * 4, np.uint8)
    codes[: len(n)] = extra
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = n.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers again, by table lookup."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def _put(uri: str, name: str, data: bytes) -> None:
    """A small file, complete or absent."""
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, f"{path}/{name}")


def _encoded(vocabulary: str, end_id: int, bounds: np.ndarray, counts_uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        counts = np.zeros(max(enc.tokenizer.get_vocab_size(), end_id + 1), np.int64)
        end = np.array([end_id], enc.kind)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                own = b.slice(lo, 1000)
                ids = own.column(0)
                rows = [np.concatenate([enc.ids(t), end]) for t in own.column(1).to_pylist()]
                counts += np.bincount(np.concatenate(rows), minlength=len(counts))
                ranges = np.searchsorted(bounds, ids.fill_null(-(2**63)).to_numpy(), side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ranges), ids, pa.array([r.tobytes() for r in rows], pa.binary())], ["range", "id", "ids"])
        _put(counts_uri, f"{TaskContext.get().partitionId()}.counts", zlib.compress(counts.astype("<i8").tobytes(), 1))

    return run


@lru_cache(maxsize=2)
def _ranking(counts_uri: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids by rank and ranks by id, from the counts of all map tasks."""
    fs, path = open_fs(counts_uri)
    total: np.ndarray | int = 0
    for info in fs.get_file_info(pafs.FileSelector(path)):
        if info.path.endswith(".counts"):
            with fs.open_input_stream(info.path) as f:
                total = total + np.frombuffer(zlib.decompress(f.read()), "<i8")
    ids = np.argsort(-total, kind="stable").astype("<u4")
    ranks = np.empty(len(ids), "<u4")
    ranks[ids] = np.arange(len(ids))
    return ids, ranks


def _block(ids: list, rows: list[np.ndarray], ranks: np.ndarray) -> bytes:
    numbers = ranks[np.concatenate(rows)]
    control, data = pack(numbers)
    known = np.array([x is not None for x in ids], np.uint8)
    index = known.tobytes() + np.array([x or 0 for x in ids], "<i8").tobytes() + np.array([len(r) for r in rows], "<u4").tobytes()
    body = index + control + data
    return HEAD.pack(BLOCK, len(ids), len(numbers), len(control), len(data)) + struct.pack("<I", zlib.crc32(body)) + body


def _written(uri: str, counts_uri: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(uri)
        at, f, part, held, rows, done = None, None, "", [], [], [0, 0]
        out: dict[str, list] = {"range": [], "path": [], "docs": [], "tokens": []}
        ranks = None

        def flush() -> None:
            if held:
                f.write(_block(held, rows, ranks))
                done[0] += len(held)
                done[1] += sum(map(len, rows))
                held.clear()
                rows.clear()

        def close() -> None:
            flush()
            f.write(END + struct.pack("<QQ", *done))
            f.close()
            fs.move(part, f"{path}/{at:08d}.ltk")
            for k, v in zip(out, (at, f"{uri}/{at:08d}.ltk", *done), strict=True):
                out[k].append(v)

        for b in batches:
            if ranks is None:
                ids_by_rank, ranks = _ranking(counts_uri)
            for r, i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if r != at:
                    if f:
                        close()
                    at, part, done = r, f"{path}/.{r:08d}.{uuid.uuid4().hex}", [0, 0]
                    fs.create_dir(path, recursive=True)
                    f = fs.open_output_stream(part)
                    f.write(MAGIC)
                    if r == 0 or not out["range"]:
                        _put(uri, "ranks.bin", ids_by_rank.tobytes())
                held.append(i)
                rows.append(np.frombuffer(data.as_buffer(), kind))
                if sum(map(len, rows[-1:])) and len(rows) % 64 == 0 and sum(map(len, rows)) >= BLOCK_TOKENS or len(rows[-1]) >= BLOCK_TOKENS:
                    flush()
        if f:
            close()
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("range", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    return run


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, uri: str, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> list[dict]:
    """Write all texts' ids, each followed by end_id, in ascending id order; the files in order, each with the tokens before it."""
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    cuts = ids.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    bounds = np.unique(np.array(cuts or [], np.float64).astype(np.int64))
    counts_uri = scratch(spark, "token-counts")
    kind = encoder(vocabulary).kind
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    encoded = rows.mapInArrow(_encoded(vocabulary, end_id, bounds, counts_uri), "range int, id long, ids binary")
    sorted_ = encoded.repartition(ranges, "range").sortWithinPartitions("range", F.col("id").asc_nulls_first(), "ids")
    files = sorted_.mapInArrow(_written(uri, counts_uri, kind), "range int, path string, docs long, tokens long").collect()
    start, out = 0, []
    for f in sorted(files, key=lambda f: f["range"]):
        out.append({"path": f["path"], "docs": f["docs"], "tokens": f["tokens"], "start": start})
        start += f["tokens"]
    return out


def read_file(path: str, ids_by_rank: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """Document ids and token ids of a file; ValueError where it is damaged or cut short."""
    fs, p = open_fs(path)
    with fs.open_input_stream(p) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path}: no token file")
        docs = tokens = 0
        while (mark := f.read(4)) == BLOCK:
            _, n, total, n_control, n_data = HEAD.unpack(mark + f.read(HEAD.size - 4))
            (crc,) = struct.unpack("<I", f.read(4))
            body = f.read(13 * n + n_control + n_data)
            if zlib.crc32(body) != crc:
                raise ValueError(f"{path}: damaged block")
            known, ids = np.frombuffer(body, np.uint8, n), np.frombuffer(body, "<i8", n, n)
            lengths = np.frombuffer(body, "<u4", n, 9 * n)
            numbers = ids_by_rank[unpack(body[13 * n : 13 * n + n_control], body[13 * n + n_control :], total)]
            at = 0
            for k, i, size in zip(known.tolist(), ids.tolist(), lengths.tolist(), strict=True):
                yield (i if k else None), numbers[at : at + size]
                at += size
            docs, tokens = docs + n, tokens + total
        if mark != END or struct.unpack("<QQ", f.read(16)) != (docs, tokens):
            raise ValueError(f"{path}: cut short")


@lru_cache(maxsize=2)
def _ranks_of(folder: str) -> np.ndarray:
    fs, p = open_fs(f"{folder}/ranks.bin")
    with fs.open_input_stream(p) as f:
        return np.frombuffer(f.read(), "<u4")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids"]
    for b in batches:
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held: list[list] = [[], [], [], []]
            for i, ids in read_file(path, _ranks_of(path.rpartition("/")[0])):
                for column, v in zip(held, (i, start, len(ids), ids.astype("<u4").tobytes()), strict=True):
                    column.append(v)
                start += len(ids)
                if len(held[0]) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)
                    held = [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)


def read_token_files(spark: SparkSession, files: list[dict]) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    rows = spark.createDataFrame([(f["path"], f["start"]) for f in files], "path string, start long")
    return rows.repartition(max(1, len(files))).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")
