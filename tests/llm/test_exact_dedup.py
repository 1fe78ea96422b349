import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lattica.llm.exact_dedup import ExactDedup

ROWS = [
    (9, "same  text", "a", 1), (4, "same text", "b", 1), (7, "same\ttext", "c", 1), (1, "", "d", 1), (2, None, "e", 1), (3, " ", "f", 1), (6, "\x0b\n", "g", 1),
    (5, "x" * 200_000, "h", 1), (8, "x" * 200_000, "i", 1), (10, "alone", "j", 1), (4, "same text", "k", 1), (None, "alone2", None, None), (None, "same text", None, None),
    (11, "nbsp x", "l", 1), (12, "nbsp x", "m", 1), (None, "ids", "n", 1), (None, "ids", "o", 1),
]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("filter_bytes", [64 << 20, 1 << 13])
def test_decisions(spark, filter_bytes):
    rows = ROWS + [(100 + i, f"unique {i}", "z", 0) for i in range(300)] + [(1000 + i, "copied", "z", 0) for i in range(200)]
    if filter_bytes < 1 << 20:
        rows += [(10_000 + i, f"more {i % 60_000}", "z", 0) for i in range(70_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_sha string, _id int").repartition(4)
    op = ExactDedup(docs, filter_bytes=filter_bytes)
    assert op.filter.groups > 1 or filter_bytes > 1 << 20
    if op.filter.groups > 1:  # dealt by range: a file needs one filter only
        pairs = op.filter.rows.select(F.input_file_name().alias("file"), op.filter._group(F.col("h1")).alias("g")).distinct().collect()
        assert op.filter.groups >= 16 and len({p.file for p in pairs}) == len(pairs) <= op.filter.groups
    got = op.decisions().collect()
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    want = sorted(((i, min((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    stay = [r.text_sha256 for r in got if r.kept]
    assert len(stay) == len(set(stay)) == len(groups)
    kept = op.kept()
    assert kept.columns == docs.columns
    assert sorted(((norm(r.text), r.doc_id) for r in kept.collect()), key=str) == sorted(((t, min((x for x in g if x is not None), default=None)) for t, g in groups.items()), key=str)


def test_empty(spark):
    op = ExactDedup(spark.createDataFrame([], "doc_id long, text string"))
    assert op.decisions().count() == 0 and op.kept().count() == 0
