import io
import random

import pytest

from lattica.llm.warc import PIECE, Gap, Record, digest, gaps, member, page_rows, read_archives, record, salvage, write_archives

PAGES = [(5, "u5", "<p>x</p>"), (2, "u2", "<p>x</p>"), (9, None, None), (7, "u 7", ""), (1, "u1", "é" * 5000), (8, "u8", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (None, "none", "<p>x</p>"), (2, "u2", "<p>x</p>")]


def raw(i, text="body"):
    return record(i, f"http://h/{i}", text.encode(), digest(text.encode()), None, False)


def members(n):
    return [member(raw(i, f"text {i} " * (i + 1))) for i in range(n)]


def ids(found):
    return [int(x.headers["warc-record-id"][10:-1]) for x in found if isinstance(x, Record)]


@pytest.mark.parametrize("wrap", [member, bytes])
def test_whole_files(wrap):
    parts = [wrap(raw(i, "t" * i * 9000)) for i in range(30)]
    found = list(salvage(io.BytesIO(b"".join(parts))))
    assert ids(found) == list(range(30)) and not [x for x in found if isinstance(x, Gap)]
    assert list(salvage(io.BytesIO(b""))) == []


@pytest.mark.parametrize("wrap", [member, bytes])
@pytest.mark.parametrize("damage", ["cut", "flip", "insert", "tail", "head"])
def test_salvage(wrap, damage):
    parts = [wrap(raw(i, f"text {i} " * (i + 1))) for i in range(12)]
    bad = 5
    if damage == "cut":
        parts[bad] = parts[bad][: len(parts[bad]) // 2]
    elif damage == "flip":
        at = len(parts[bad]) - 6
        parts[bad] = parts[bad][:at] + bytes([parts[bad][at] ^ 0x55]) + parts[bad][at + 1 :]
    elif damage == "insert":
        parts.insert(bad, b"\x1f\x8b\x08junk WARC/1.1\r\nnot: one\r\n")
    elif damage == "tail":
        parts[-1] = parts[-1][:-9]
    else:
        parts[0] = parts[0][20:]
    data = b"".join(parts)
    found = list(salvage(io.BytesIO(data)))
    lost = {"cut": [bad], "flip": [bad], "insert": [], "tail": [11], "head": [0]}[damage]
    assert ids(found) == [i for i in range(12) if i not in lost]
    gaps = [x for x in found if isinstance(x, Gap)]
    assert len(gaps) == 1 and gaps[0].reason
    at = 0
    for x in found:  # records and gaps cover the file
        assert x.offset == at
        at += x.length
    assert at == len(data)


def test_random_damage_loses_only_what_it_hits():
    rng = random.Random(1)
    for _ in range(20):
        parts = members(15)
        data = bytearray(b"".join(parts))
        ends = [sum(map(len, parts[: i + 1])) for i in range(15)]
        at = rng.randrange(len(data))
        data[at] ^= 1 << rng.randrange(8)
        hit = next(i for i, e in enumerate(ends) if at < e)
        assert set(range(15)) - {hit} <= set(ids(salvage(io.BytesIO(bytes(data)))))


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS page").repartition(3)
    files = write_archives(pages, f"file://{tmp_path}/w")
    assert sum(f["records"] for f in files) == len(PAGES)
    got = sorted((tuple(r) for r in page_rows(read_archives(spark, [f["path"] for f in files])).collect()), key=str)
    want = []
    for i, _, html in PAGES:
        payload = (html or "").encode()
        first = min((j for j, _, h in PAGES if j is not None and (h or "") == (html or "")), default=None)
        again = i is not None and i != first
        want.append((i, len(payload), digest(payload), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    least = write_archives(pages, f"file://{tmp_path}/v", least=1)
    rows = page_rows(read_archives(spark, [f["path"] for f in least])).where("payload_bytes = 0").collect()
    assert {r.record_type for r in rows} == {"response"}
    assert write_archives(pages.limit(0), f"file://{tmp_path}/e") == []
    assert read_archives(spark, []).count() == 0


@pytest.mark.parametrize("wrap", [member, bytes])
def test_records_longer_than_a_piece(wrap):
    rng = random.Random(5)
    texts = [rng.randbytes(n).hex() for n in (10, PIECE, 3 * PIECE // 2, 20, PIECE // 2 - 300)]
    parts = [wrap(raw(i, t)) for i, t in enumerate(texts)]
    found = list(salvage(io.BytesIO(b"".join(parts))))
    assert [x.body.decode() for x in found] == texts
    parts[2] = parts[2][: len(parts[2]) // 2]  # the reader searches on through the rest
    found = list(salvage(io.BytesIO(b"".join(parts))))
    assert ids(found) == [0, 1, 3, 4] and [x.length for x in found if isinstance(x, Gap)] == [len(parts[2])]


def test_damage_is_logged_and_raised(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    (file,) = write_archives(pages, f"file://{tmp_path}/d")
    path = file["path"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    at = len(data) // 2
    data[at : at + 40] = bytes(40)
    open(path, "wb").write(bytes(data))
    records = read_archives(spark, [file["path"]])
    (gap,) = gaps(records).collect()
    assert gap.offset <= at < gap.offset + gap.length and gap.reason
    assert page_rows(records, leave_gaps=True).count() in (18, 19)
    with pytest.raises(Exception, match="damage in"):
        page_rows(records).collect()
