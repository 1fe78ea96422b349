import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import pitman_yor, queries
from lattica.llm.pitman_yor import discount, score, seat
from lattica.llm.shared import scratch, stored
from lattica.llm.words import word_hashes

SCHEMA = "doc_id long, text string, counts long, id string"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + [None]


def corpus(n, seed):
    rng = random.Random(seed)
    follow = {}
    for d in range(n):
        word, out = "the", []
        for _ in range(rng.randrange(1, 300)):
            word = rng.choice(follow.setdefault(word, ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(4)])) if rng.random() < 0.8 else rng.choice(["the", "of", "Of"])
            out.append(word)
        yield d, " ".join(out)


@pytest.mark.parametrize("task_tokens, words_before", [(4_000_000, 2), (3_000, 2), (3_000, 1)])
def test_base_counts_and_gain(spark, task_tokens, words_before):
    rows = [(d, t, 1, "x") for d, t in corpus(400, 1)] + [(1000, None, 1, "x"), (1001, "", 1, "x"), (1002, "neverseen " * 50, 1, "x"), (1003, "w" * 100_000, 1, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.doc_id: r for r in score(docs, task_tokens=task_tokens, words_before=words_before).collect()}
    out = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter(w for d, t, *_ in rows if not out(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for d, t, *_ in rows:
        w = tokens(t)
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(d), len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)
    again = {r.doc_id: r.score for r in score(docs.repartition(2), task_tokens=task_tokens, words_before=words_before).collect()}
    assert all(math.isclose(again[d], got[d].score, rel_tol=0.02, abs_tol=0.5) for d in got)


def test_small_tables(spark):
    assert score(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 10 == 0)
    (r,) = score(spark.createDataFrame([(held, "a b", 1, "x")], SCHEMA)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isfinite(r.score)
    two = score(spark.createDataFrame([(1, "a b", 1, "x"), (1, "a", 1, "x"), (None, "a", 1, "x")], SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in two) == [("1", 2), ("1", 3), ("None", 2)]


@pytest.mark.parametrize("words_before", [1, 2])
def test_scores_equal_brute_force_for_the_seating(spark, monkeypatch, words_before):
    """Plain recursion over dictionaries, with the tables that the workers seated; each context's probabilities sum to one."""
    rows = [(d, t, 1, "x") for d, t in corpus(150, 2)] + [(6000, "neverseen the neverseen", 1, "x"), (6001, None, 1, None)]
    uris, tables = [], {}
    monkeypatch.setattr(pitman_yor, "scratch", lambda spark, name: uris.append(scratch(spark, name)) or uris[-1])
    monkeypatch.setattr(pitman_yor, "remove", lambda uri: None)
    monkeypatch.setattr(pitman_yor, "forget", lambda df: None)
    monkeypatch.setattr(pitman_yor, "stored", lambda df, name: tables.setdefault(name, []).append(stored(df, name)) or tables[name][-1])
    got = {r.doc_id: r for r in score(spark.createDataFrame(rows, SCHEMA).repartition(3), words_before=words_before, burn_in=1, samples=1).collect()}
    answers = [r.asDict() for r in tables["answers"][-1].where("bucket >= 0").collect()]
    # the model's counts by plain dictionaries of words
    train = Counter()
    of = lambda text: [None, None, *tokens(text)]
    for d, t, *_ in rows:
        if zlib.crc32(str(d).encode()) % 10:
            w = of(t)
            train.update(zip(w if words_before == 2 else [None] * len(w), w[1:], w[2:], strict=False))
    names = sorted({w for _, t, *_ in rows for w in tokens(t) if w})
    number_of = dict(zip(names, word_hashes(pa.array(names))[0].tolist(), strict=True)) | {None: int(pitman_yor.END)}
    name_of = {v: k for k, v in number_of.items()}
    type_of = {k: tuple(number_of[k[i]] for i in (1, 2, 0)) for k in train}
    t3, t2, one = Counter(), Counter(), {}
    for number in sorted({r["bucket"] for r in answers}):
        b = pitman_yor.Bucket(uris[0], number, words_before)
        b.load(1)
        b.answers([r for r in answers if r["bucket"] == number], 4, False)
        before, word = ([name_of[int(x)] for x in b.words[i]] for i in (b.pair_before, b.pair_word))
        for j in np.flatnonzero(b.c2).tolist():
            t2[before[j], word[j]] = int(b.t2[j])
        # a bucket has its types in the order of the word before, the word, the earlier one, by their hashes
        seen = sorted((x for x in type_of if x[1] in set(before)), key=type_of.get)
        at = np.flatnonzero(b.c).tolist()
        assert len(at) == len(seen)
        for i, k in zip(at, seen, strict=True):
            assert (before[b.pair[i]], word[b.pair[i]]) == k[1:] and b.c[i] == train[k]
            t3[k] = int(b.t3[i])
        one |= {name_of[int(b.words[w])]: (int(b.c1[w]), int(b.t1[w])) for w in b.asked.tolist()}
    assert t3.keys() == train.keys()
    c2, c1 = Counter(), Counter()
    for (x, y, w), t in t3.items():
        c2[y, w] += t
    for (y, w), t in t2.items():
        c1[w] += t
    t1 = {w: one[w][1] for w in c1}
    assert all(one[w][0] == c1[w] for w in c1)
    disc = lambda n: discount(sum(v == 1 for v in n.values()), sum(v == 2 for v in n.values()))
    start2 = Counter(k[1:] for k in train) if words_before == 2 else Counter({k[1:]: n for k, n in train.items()})
    start1 = Counter(w for _, w in start2)
    d3, d2, d1, theta = disc(train), disc(start2), disc(start1), 1.0
    p0 = 1 / (len(c1) + 1)

    def p(x, y, w):
        low = (c1[w] - d1 * t1.get(w, 0) + (theta + d1 * sum(t1.values())) * p0) / (theta + sum(c1.values()))
        at = [k for k in c2 if k[0] == y]
        mid = (c2[y, w] - d2 * t2[y, w] + (theta + d2 * sum(t2[k] for k in at)) * low) / (theta + sum(c2[k] for k in at))
        if words_before == 1:
            return mid
        up = [k for k in train if k[:2] == (x, y)]
        return (train[x, y, w] - d3 * t3[x, y, w] + (theta + d3 * sum(t3[k] for k in up)) * mid) / (theta + sum(train[k] for k in up))

    for x, y in ((None, None), (None, "the"), ("the", "of")):
        assert math.isclose(sum(p(x, y, w) for w in [*c1, "unknown to all"]), 1, rel_tol=1e-9)
    for d, t, *_ in rows[:12] + rows[-4:]:
        w = of(t)
        assert math.isclose(got[d].score, sum(math.log10(p(*k)) for k in zip(w, w[1:], w[2:], strict=False)), rel_tol=1e-5)


def test_parts_of_hot_things_add_up(spark):
    """Scores hardly depend on how tokens are dealt: split hot words, contexts and trigrams are the same restaurants."""
    rows = [(d, t, 1, "x") for d, t in corpus(150, 2)] + [(5000 + i, "hot hot hot " * 30, 1, "x") for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    a, b = ({r.doc_id: r for r in score(docs, task_tokens=n, share=50, samples=4).collect()} for n in (1_000_000, 2_000))
    assert all((a[d].n_tokens, a[d].n_known, a[d].train_tokens) == (b[d].n_tokens, b[d].n_known, b[d].train_tokens) and math.isclose(a[d].base_score, b[d].base_score, rel_tol=1e-9) for d in a)
    whole, parts = (sum(r.score for r in x.values()) for x in (a, b))
    assert math.isclose(whole, parts, rel_tol=0.01)
    assert all(math.isclose(a[d].score, b[d].score, rel_tol=0.06, abs_tol=1) for d in a)


def test_texts_seen_twice_score_better(spark):
    """Held-out copies of training texts; context of two words tells."""
    rng = random.Random(5)
    words = ["w%d" % i for i in range(2000)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(80)]
    held = [d for d in range(10_000, 20_000) if zlib.crc32(str(d).encode()) % 10 == 0]
    kept = [d for d in range(20_000, 30_000) if zlib.crc32(str(d).encode()) % 10]
    rows = [(kept[i], t, 1, "x") for i, t in enumerate(texts)] + [(held[i], texts[i] if i < 20 else " ".join(rng.choice(words) for _ in range(60)), 1, "x") for i in range(40)]
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert min(got[held[i]] for i in range(20)) > max(got[held[i]] for i in range(20, 40)) + 30


def test_seat():
    rng = np.random.default_rng(1)
    c = np.array([0, 1, 2, 50, 10**7])
    t = np.array([seat(c, np.full(5, 3.0), 0.5, rng) for _ in range(300)])
    assert (t[:, 0] == 0).all() and (t[:, 1] == 1).all() and ((t >= np.minimum(c, 1)) & (t <= c)).all()
    exact = []
    for _ in range(300):
        k = 1
        for i in range(1, 50):
            k += rng.random() < 3 / (i - 0.5 * k + 3)
        exact.append(k)
    assert abs(t[:, 3].mean() - np.mean(exact)) < 0.6


def test_many_batches_share_the_common_words():
    """What a bucket holds doesn't grow by the list of common words with each batch."""
    common = np.sort(np.random.default_rng(0).integers(1, 2**63, pitman_yor.COMMON).astype(np.uint64))
    z = pitman_yor._z
    rows = []
    for i in range(400):  # each batch says (common 5, own word) once, the common 7 after it
        own = np.array([i + 1, 2**63 + i], np.uint64)
        code = np.array([5, len(common) + 1])
        parts = [z(np.diff(own, prepend=np.uint64(0)), "<u8"), z(np.full(2, 7)), z(np.diff(code, prepend=0)), z(np.array([len(common), 7])), z(np.ones(2)), z(np.array([0, 2])), z(np.ones(2))]
        rows.append({"bucket": 0, "kind": pitman_yor.ENTRIES, "batch": i, "parts": parts})
    batch = pitman_yor._rows([tuple(r.values()) for r in rows])
    tracemalloc.start()
    out = [r for b in pitman_yor._merged([np.zeros(0, np.uint64)] * 3, common)([batch]) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    (static,) = [r["parts"] for r in out if r["kind"] == pitman_yor.STATIC]
    words = np.cumsum(pitman_yor._un(static[0], "<u8"))
    assert set(words.tolist()) == {int(common[5]), int(common[7]), *range(1, 401), *range(2**63, 2**63 + 400)}
    assert len(pitman_yor._un(static[3])) == 800 and len(out) == 401
    assert peak < 40 << 20


def test_query_has_both_levels(spark, monkeypatch):
    """The query learns from two words before, as the operator does."""
    given = []
    monkeypatch.setattr(queries, "score", lambda docs, **k: given.append(k.get("words_before", pitman_yor.WORDS_BEFORE)))
    queries.op9_language_model(spark, "/root/testdata/sf0.001")
    assert given == [2]


def test_ordered_is_a_stable_sort_by_all_keys():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 1000, 1025):
        for most in (1, 7, 1 << 16, 1 << 40, (1 << 63) - 1):
            keys = [rng.integers(low, most, n) for low in (0, -most, most // 2)]
            assert (pitman_yor.ordered(*keys) == np.lexsort(keys[::-1])).all()
            assert (pitman_yor.ordered(keys[0].astype(np.uint64)) == np.argsort(keys[0], kind="stable")).all()
    for kind in (np.int32, np.int64, np.uint64):
        key = np.array([np.iinfo(kind).max, np.iinfo(kind).min, 0, np.iinfo(kind).max], kind)
        assert pitman_yor.ordered(key).tolist() == np.argsort(key, kind="stable").tolist()


def test_types_are_sorted_cheaply(monkeypatch):
    """Dealing and merging, the larger part of the work, sort no tokens by lexsort or by hash tables; what they make is told by plain counting."""
    rng, none = np.random.default_rng(4), [np.zeros(0, np.uint64)] * 3
    texts = [" ".join("w%d" % i for i in rng.zipf(1.3, 300) % 5000) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], ["text", "id"])
    common = np.sort(word_hashes(pa.array(["w%d" % i for i in range(50)]))[0])
    monkeypatch.setattr(pitman_yor, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Part", (), {"partitionId": lambda self: 0})())}))
    unique = np.unique

    def no_plain_unique(x, **k):  # without an inverse numpy puts whole numbers in a hash table
        assert k or len(x) < 100
        return unique(x, **k)

    def no_lexsort(*_):
        raise AssertionError("tokens by lexsort")

    monkeypatch.setattr(np, "lexsort", no_lexsort)
    monkeypatch.setattr(np, "unique", no_plain_unique)
    dealt = [b for turn in (0, 1) for b in pitman_yor._dealt(none, common, 1, 2, turn)([batch])]
    out = [r for b in pitman_yor._merged(none, common)(dealt) for r in b.to_pylist()]
    (static,) = [r["parts"] for r in out if r["kind"] == pitman_yor.STATIC]
    want = Counter()
    for d, t in enumerate(texts):
        w = [None, None, *tokens(t)]
        if zlib.crc32(str(d).encode()) % 10:
            want.update(zip(w, w[1:], w[2:], strict=False))
    assert sorted(x for x in pitman_yor._un(static[3]).tolist() if x) == sorted(want.values())
    key = [rng.integers(0, 1 << 17, 1 << 20) for _ in range(3)]
    monkeypatch.undo()
    took = []
    for sort in (lambda: pitman_yor.ordered(*key), lambda: np.lexsort(key[::-1])):
        start = time.process_time()
        sort()
        took.append(time.process_time() - start)
    assert took[0] < took[1] / 1.5
