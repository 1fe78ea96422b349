"""Harmonic packing of token ids into sequences of a fixed capacity C.

Lengths fall into reciprocal classes: a class's length l fits C // l times into a sequence, and each
sequence of the class takes exactly that many pieces. A document is cut so that its pieces have such
lengths: whole sequences first; then, as long as C mod r is over ``slack`` of C for what remains, r, the
longest floor(C / k) that fits; the last piece opens the class of its own length. So a filled sequence
wastes ``slack`` of C at most. Each worker fills its own sequences and needs nothing from others;
no row is shuffled. At its end, a worker lays the pieces of its unfilled sequences one after another
and cuts them at C, and the last rest into powers of two, which need no padding.

Memory: a worker holds fewer pieces than one sequence for each class, C tokens in each.

Sequence ids: partition number times 2**40 plus the sequence's number in it. They are the same
when a lost task is run again, as a partition's rows come in the same order.

Defined cases: a null text is an empty text, of the end id alone. Rows that repeat an id are
documents of their own. Empty tables give no piece. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import whole_text
from lattica.llm.tokens import encoder

CAPACITY = 4096
SLACK = 1 / 128
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padding long"


def cuts(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """The lengths that a document of n tokens is cut into."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        if capacity % rest <= slack * capacity:
            piece = rest
        else:
            piece = capacity // -(-capacity // rest)
        out.append(piece)
        rest -= piece
    return out


def padding(tokens: int, capacity: int = CAPACITY) -> int:
    """Sequences are padded to the capacity, except at a power of two."""
    return 0 if tokens & (tokens - 1) == 0 else capacity - tokens


class Packer:
    """Sequences of one worker; ``add`` and ``finish`` return rows of finished sequences."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, slack: float = SLACK):
        self.next, self.capacity, self.slack = first_sequence, capacity, slack
        self.open: dict[int, list[tuple]] = {}

    def _sequence(self, pieces: list[tuple]) -> list[tuple]:
        total, at, rows = sum(len(p[2]) for p in pieces), 0, []
        for doc, start, ids, size in pieces:
            rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), size, self.next, at, total, padding(total, self.capacity)))
            at += len(ids)
        self.next += 1
        return rows

    def add(self, doc: int | None, ids: np.ndarray) -> list[tuple]:
        rows, at = [], 0
        for n in cuts(len(ids), self.capacity, self.slack):
            pieces = self.open.setdefault(n, [])
            pieces.append((doc, at, ids[at : at + n].copy(), len(ids)))
            at += n
            if len(pieces) == self.capacity // n:
                rows += self._sequence(self.open.pop(n))
        return rows

    def finish(self) -> list[tuple]:
        left = [p for n in sorted(self.open, reverse=True) for p in self.open[n]]
        self.open = {}
        total = sum(len(p[2]) for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in reversed(range(self.capacity.bit_length())) if total % self.capacity >> b & 1]
        rows, own, room = [], [], sizes.pop(0) if sizes else 0
        for doc, start, ids, size in left:
            while len(ids):
                take = min(room, len(ids))
                own.append((doc, start, ids[:take], size))
                start, ids, room = start + take, ids[take:], room - take
                if not room:
                    rows += self._sequence(own)
                    own, room = [], sizes.pop(0) if sizes else 0
        return rows


def _pack(vocabulary: str, end_id: int, capacity: int, slack: float):
    names = [x.split()[0] for x in PIECES.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(vocabulary), Packer(TaskContext.get().partitionId() << 40, capacity, slack)
        end, rows = np.array([end_id], enc.kind), []
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                own = b.slice(lo, 1000)
                for doc, text in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True):
                    rows += packer.add(doc, np.concatenate([enc.ids(text), end]))
                if rows:
                    yield batch(rows)
                    rows = []
        if rows := packer.finish():
            yield batch(rows)

    return run


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, slack: float = SLACK) -> DataFrame:
    """A row for each piece, in sequences of at most capacity tokens."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(_pack(vocabulary, end_id, capacity, slack), PIECES)
