import random
from collections import Counter

import pyarrow as pa
import pytest

from lattica.llm.suffixes import Batch, anchors, find_repeats
from lattica.llm.words import word_hashes


def test_copies_select_the_same_anchors():
    rng = random.Random(1)
    passage = ["p%d" % rng.randrange(40) for _ in range(50)]
    for _ in range(50):
        texts = [[f"{k}{rng.random()}" for _ in range(rng.randrange(60))] + passage + [f"{k}{rng.random()}" for _ in range(rng.randrange(60))] for k in "ab"]
        text, _, h, _ = anchors(Batch(pa.array([" ".join(t) for t in texts])))
        assert set(h[text == 0].tolist()) & set(h[text == 1].tolist())
    assert len(anchors(Batch(pa.array(["x " * 49, "", "y"])))[0]) == 0 and len(anchors(Batch(pa.array([], pa.string())))[0]) == 0


def brute(rows, least=50):
    """Stretches of words in windows that another row has too, as (id, start, end) with counts."""
    seen, out = {}, Counter()
    texts = [(r[1] or "").split() for r in rows]
    for k, w in enumerate(texts):
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i : i + least]), set()).add(k)
    for k, w in enumerate(texts):
        now = None
        for i in range(len(w) - least + 1):
            if len(seen[tuple(w[i : i + least])]) > 1:
                if now and i <= now[1]:
                    now[1] = i + least
                else:
                    if now:
                        out[(rows[k][0], *now)] += 1
                    now = [i, i + least]
        if now:
            out[(rows[k][0], *now)] += 1
    return out


def found(docs, **k):
    return Counter((r.doc_id, r.start_word, r.end_word) for r in find_repeats(docs, **k).collect())


@pytest.mark.parametrize("task_rows, filter_bytes", [(100_000, 64 << 20), (40, 1 << 13), (3, 64 << 20)])
def test_equals_brute_force(spark, task_rows, filter_bytes):
    rng = random.Random(2)
    word = lambda: "w%d" % rng.randrange(3000)
    passages = [[word() for _ in range(n)] for n in (50, 51, 60, 120, 400, 49, 30)]
    rows = []
    for d in range(150):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts += [word() for _ in range(rng.randrange(0, 80))]
            p = rng.choice(passages[:6] if d % 5 else passages[3:4])
            at = rng.randrange(len(p)) if d % 3 == 0 else 0
            parts += p[at:] if d % 2 else p[: len(p) - at]
        rows.append((d, " ".join(parts), "x"))
    rows += [(900, None, "x"), (901, "", "x"), (902, "same " * 3000, "x"), (903, "a b c " * 500, "x"), (None, " ".join(passages[4]), "x"), (904, " ".join(passages[4]), None), (904, " ".join(passages[4]), None), (905, "other " * 400, "x")]
    rows += [(906, "same " * 70, "x"), (None, " ".join(passages[2] + passages[3]), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_file string").repartition(4)
    got = found(docs, task_rows=task_rows, filter_bytes=filter_bytes, dealt_rows=100)
    assert got == brute(rows) and len(got) > 100


def test_partners_of_either_side(spark):
    """Words shared with one document before an anchor and with another after it make no passage; windows in between do."""
    rng = random.Random(9)
    rows = []
    for k in range(40):
        base = ["b%d.%d" % (k, rng.randrange(10**6)) for _ in range(120)]
        fill = lambda n: ["f%d" % rng.randrange(10**9) for _ in range(n)]
        cut = lambda a, b: fill(5) + base[a:b] + fill(5)
        a, b, c = rng.randrange(10, 30), rng.randrange(20, 60), rng.randrange(50, 80)
        for part in (base, cut(a, a + rng.randrange(30, 60)), cut(b, b + rng.randrange(30, 60)), cut(c - rng.randrange(30), c + rng.randrange(10, 40)), cut(a, c)):
            rows.append((len(rows), " ".join(part)))
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), task_rows=7)
    assert got == brute(rows) and len(got) > 60


def test_periodic_passages(spark):
    """Stretches of any period, at any offset, in whole or in part, with and without words around them."""
    rng = random.Random(4)
    rows = []
    for period in (1, 2, 3, 4, 5, 6, 7, 8, 12, 31, 40):
        line = ["q%d.%d" % (period, i) for i in range(period)]
        tail = ["t%d.%d" % (period, i) for i in range(25)]
        for k in range(6):
            before, after = (["n%d" % rng.randrange(10**9) for _ in range(rng.randrange(40))] for _ in range(2))
            n = rng.randrange(20, 420)
            stretch = (line * (n // period + 2))[rng.randrange(period) :][:n]
            rows.append((len(rows), " ".join(before + stretch + (tail if k % 2 else []) + after)))
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), task_rows=50)
    assert got == brute(rows) and len(got) > 40


def test_one_document_across_partitions(spark):
    """A document with very many contexts of a passage doesn't hide the others."""
    rng = random.Random(6)
    passage = ["p%d" % i for i in range(50)]
    word = lambda: "w%d" % rng.randrange(10**9)
    rows = [(1, " ".join(passage + [word()])), (2, " ".join(w for _ in range(60) for w in [*passage, word(), word()])), (3, " ".join([word(), *passage[5:], word()]))]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), task_rows=4)
    assert got == brute(rows) and len(got) == 61


def test_nothing_repeated(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(d, " ".join("w%d" % rng.randrange(3000) for _ in range(200))) for d in range(20)], "doc_id long, text string")
    assert find_repeats(docs).count() == 0 and find_repeats(docs.limit(0)).count() == 0


def test_words():
    texts = ["one  two\tone\n\x0bé one", "", " ", "x" * 60 + " two", "ONE\xa0x one", "a" * 60]
    words, n = word_hashes(pa.array(["skip me", *texts]).slice(1))
    split = [w for t in texts for w in t.encode().split()]
    assert n.tolist() == [len(t.encode().split()) for t in texts]
    of = dict(zip(split, words.tolist(), strict=True))
    assert len(of) == len(set(of.values())) and [of[w] for w in split] == words.tolist() and min(of.values()) >> 32
    low, _ = word_hashes(pa.array(["ONE É one"]), lower=True)
    assert low[0] == low[2] == of[b"one"] and low[1] != low[0]
    assert len(word_hashes(pa.array([], pa.string()))[0]) == 0
