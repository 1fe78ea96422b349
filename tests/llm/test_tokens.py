import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lattica.llm.packing import CAPACITY, Packer, cuts, pack_documents
from lattica.llm.token_files import pack, read_file, read_token_files, unpack, write_token_files, _ranks_of
from lattica.llm.tokens import Encoder, vocabulary_path

PATH = vocabulary_path()
TEXTS = ["", " ", "The  and attion.\nÉlan ÇA ŒUVRE don't I'LL 12 3.5", "á éb ́x", "İstanbul ΣΑΣ ΟΔΟΣ", "x<|endoftext|>y <|startoftext|>", "漢字 テスト 🙂🙂  nbsp em\x1csep\tTab\r\nz", "ſ ﬁ K Å", "w" * 300, "!!! %%% $a$ <b> <| it's's 's", None]
SCHEMA = "doc_id long, text string, extra string, id long, ids string"


def brute(texts, end):
    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    path = vocabulary_path(name)
    t, enc = Tokenizer.from_file(path), Encoder(path, most=5)
    for x in [*TEXTS, *TEXTS]:
        assert enc.ids(x or "").tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        x = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype("<u4")
        control, data = pack(x)
        assert len(control) == -(-n // 4) and (unpack(control, data, n) == x).all()


def test_token_files(spark, tmp_path):
    rows = [(i, x, "e", i, "c") for i, x in enumerate(TEXTS)] + [(None, "no id", None, None, None), (3, "again", "", 0, "")]
    files = write_token_files(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, 1, f"file://{tmp_path}/out", ranges=3)
    got = {(r.doc_id, r.start): r for r in read_token_files(spark, files).collect()}
    order = sorted(got, key=lambda k: k[1])
    assert [k[0] for k in order] == [None, 0, 1, 2, 3, 3, *range(4, len(TEXTS))]
    want = {tuple(x) for x in brute([r[1] for r in rows], 1)}
    at = 0
    for k in order:
        ids = np.frombuffer(got[k].ids, "<u4")
        assert k[1] == at and len(ids) == got[k].n_tokens and tuple(ids.tolist()) in want
        at += len(ids)
    with open(files[0]["path"].removeprefix("file://"), "r+b") as f:
        f.seek(60)
        f.write(b"\xff\xfe")
    with pytest.raises(ValueError):
        list(read_file(files[0]["path"], _ranks_of(f"file://{tmp_path}/out")))


def test_token_files_empty(spark, tmp_path):
    files = write_token_files(spark.createDataFrame([], SCHEMA), PATH, 1, f"file://{tmp_path}/out", ranges=3)
    assert read_token_files(spark, files).count() == 0


def test_cuts_waste_little():
    for n in range(1, 9000, 7):
        assert sum(cuts(n)) == n
        assert all(CAPACITY % p <= CAPACITY / 100 + 32 for p in cuts(n)) and len(cuts(n)) <= n // CAPACITY + 8


def check_pieces(rows, texts, end):
    want = dict(zip([r[0] for r in texts], brute([r[1] for r in texts], end), strict=True))
    seen, sequences = {}, {}
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for groups, whole in ((seen, {d: len(x) for d, x in want.items()}), (sequences, None)):
        for key, parts in groups.items():
            at = 0
            for start, n in sorted(parts):
                assert start == at and n > 0
                at += n
            assert at == whole[key] if whole else at <= CAPACITY
    assert set(seen) == set(want)


def test_packing(spark):
    rows = [(i, x, "e", i, "c") for i, x in enumerate(TEXTS)] + [(100 + i, "word " * (i * 37 % 5000), "e", i, "c") for i in range(60)]
    got = pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, 2).collect()
    check_pieces(got, rows, 2)
    tokens, pads = sum(r.length for r in got), {r.sequence_id: r.padding for r in got}
    assert sum(pads.values()) < 0.01 * tokens
    assert pack_documents(spark.createDataFrame([], SCHEMA), PATH, 2).count() == 0


def test_packer_ends_in_powers_of_two():
    p = Packer(0)
    rows = p.add(1, np.arange(4097, dtype="<u2")) + p.add(2, np.arange(5, dtype="<u2")) + p.finish()
    assert sum(r[2] for r in rows) == 4102 and sum(r[8] for r in rows if r[6] == 0) == 0
