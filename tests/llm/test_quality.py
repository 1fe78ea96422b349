import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from lattica.llm import queries
from lattica.llm.quality import ALL, BUCKETS, PREFIXES, Features, best_cut, importances, keep_good, kth_largest, log_ratios, resample, shortages

WORDS = ["la", "so", "mi", "re", "do", "ti", "fa", "ut"]
DOCS = "doc_id long, text string, good boolean, _gone long"


def corpus(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        words = ["".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 400))]
        bad = i % 4 == 0
        if bad and i % 8 == 0:
            words = [w + rng.choice(["$$$", "%%%", "###"]) for w in words]
        elif bad:
            words[rng.randrange(len(words))] = rng.choice(["awful", "vile"])
            words += ["awful"]
        yield i, " ".join(words), bad


def test_held_out_accuracy_and_exact_k(spark):
    rows = list(corpus(1200, 1))
    docs = spark.createDataFrame([(i, t, True, i) for i, t, _ in rows] + [(5000, None, None, None), (5001, "", None, None), (None, "la so", None, None)], DOCS).repartition(5)
    labels = spark.createDataFrame([(i, int(not (b and i % 8 == 0)), int(b and i % 8 == 4)) for i, _, b in rows if i % 3] + [(9999, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in resample(docs, labels).collect()}
    held = [(got[i].kept, not b) for i, _, b in rows if i % 3 == 0]
    assert len(got) == 1203 and got[5000].log_importance == got[5001].log_importance == 0
    assert sum(k for k, g in held if g) >= 0.97 * sum(g for _, g in held) and sum(k for k, g in held if not g) <= 0.05 * sum(not g for _, g in held)
    assert {i for i, r in got.items() if r.kept} == {i for i, r in got.items() if r.fit}
    some = {r.doc_id: r for r in resample(docs, labels, k=300).collect()}
    keys = sorted((r.key for r in some.values() if r.fit), reverse=True)
    assert {i for i, r in some.items() if r.kept} == {i for i, r in some.items() if r.fit and r.key >= keys[299]} and sum(r.kept for r in some.values()) == 300
    stay = keep_good(docs, labels)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == {i for i, r in got.items() if r.kept}
    assert resample(docs, labels.limit(0)).where("NOT kept").count() == 0
    assert resample(docs.limit(0), labels).count() == 0


def words_of(text):
    """Words, beginnings of words and pairs of a plain text, by a rule of their own."""
    words = text.lower().split()
    h = [xxhash.xxh32_intdigest(w) for w in words]
    slots = [[x, *(xxhash.xxh32_intdigest(w[:n], n) if n <= len(w) else x for n in PREFIXES)] for x, w in zip(h, words, strict=True)]
    mix = []
    for a, b in zip(h, h[1:], strict=False):
        x = (a * 0x9E3779B1) % 2**32 ^ (b * 0x85EBCA6B) % 2**32
        mix.append(x ^ x >> 15)
    merged = list(mix)
    for j in range(len(words)):
        if words[j : j + 1] * 3 == words[j : j + 3]:
            merged[j] = merged[j + 1] = 2
    return [[x % BUCKETS for x in r] for r in slots], [x % BUCKETS for x in mix], [x % BUCKETS for x in merged]


def test_scores_keys_and_kept_equal_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(WORDS) + rng.choice(WORDS) * rng.randrange(4) for _ in range(rng.choice([0, 1, 2, 20, 33, 100, 400]))) for _ in range(120)]
    texts += ["la " * 50, texts[3], texts[3], "so so mi mi mi re", " ".join(["soso"] * 2 + ["mi"] * 40)]
    good = {i: i % 3 > 0 for i in range(0, len(texts), 2)}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in good.items()], "doc_id long, quality int, toxic int")
    occurs, texts_with, sums = [Counter(), Counter()], [Counter(), Counter()], [[0, 0], [0, 0]]
    parts = [words_of(t) for t in texts]
    for i, (slots, mix, merged) in enumerate(parts):
        for k in (0, 1):
            if k == 0 or good.get(i):
                occurs[k].update([("w", r[0]) for r in slots] + [("p", x) for x in mix])
                texts_with[k].update({("w", x) for r in slots for x in r} | {("p", x) for x in merged})
                sums[k][0] += len(slots) + len(mix)
                sums[k][1] += 1

    def ratio(g, n, j):
        return math.log((n[1][g] + 2) / (n[0][g] * sums[1][j] / sums[0][j] + 2))

    def lack(g):
        e = texts_with[0][g] * sums[1][1] / sums[0][1]
        return ratio(g, texts_with, 1) if e - texts_with[1][g] > 3 * math.sqrt(e + 1) else 0.0

    got = {r.doc_id: r for r in resample(docs, labels, k=40, fit_only=False).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, (slots, mix, merged) in enumerate(parts):
        assert got[i].log_importance == pytest.approx(sum(ratio(("w", r[0]), occurs, 0) for r in slots) + sum(ratio(("p", x), occurs, 0) for x in mix), abs=1e-4)
        each = [min(lack(("w", x)) for x in r) for r in slots]
        each = [x + (lack(("p", merged[j - 1])) if j else 0) for j, x in enumerate(each)]
        windows = [sum(each[j : j + 32]) for j in range(max(1, len(each) - 31))]
        assert got[i].passage_importance == pytest.approx(min(windows), abs=1e-4)
    rows = docs.selectExpr("doc_id", "xxhash64(doc_id, text, 7) AS h").collect()
    for r in rows:
        uniform = (((r.h % 2**64) >> 12) + 0.5) / 2**52
        assert got[r.doc_id].key == pytest.approx(got[r.doc_id].log_importance - math.log(-math.log(uniform)))
    cut = sorted((r.key for r in got.values()), reverse=True)[39]
    assert {i for i, r in got.items() if r.kept} == {i for i, r in got.items() if r.key >= cut}


def test_rows_are_judged_one_by_one(spark):
    """Rows that repeat an id, null ids, columns of clashing names: a bad row goes alone."""
    rows = [(i, t, True, i) for i, t, _ in corpus(400, 4)]
    bad, fine = "awful vile " * 30, "la so mi re do " * 30
    more = [(None, bad), (None, fine), (7000, bad), (7000, fine), (7000, bad)]
    docs = spark.createDataFrame(rows + [(i, t, True, 0) for i, t in more], DOCS).withColumnRenamed("good", "row_file").withColumnRenamed("_gone", "id").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 8 != 0), int(i % 8 == 4)) for i, *_ in rows], "doc_id long, quality int, toxic int")
    stay = keep_good(docs, labels)
    assert stay.columns == docs.columns
    left = [(r.doc_id, r.text) for r in stay.collect()]
    assert [(i, t) for i, t in more if (i, t) in left] == [(None, fine), (7000, fine)] and left.count((7000, fine)) == 1


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 1) for _ in range(3000)] + [0.5] * 300
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 700, 1100, 1299, 3299, 3300):
        assert kth_largest(df, "v", k, enough=20, bins=8) == sorted(values, reverse=True)[k - 1]


def test_worst_passage():
    f = Features()
    good = " ".join("la so mi re".split() * 300)
    lacks = np.zeros(2 * BUCKETS)
    lacks[f.tokens(["vile"])[0][0] % BUCKETS] = -3
    long = " ".join([good] * 20)
    found = importances(*f.tokens([good + " vile " + good, good, "", "vile", long + " vile"]), np.ones(2 * BUCKETS), lacks)
    assert found[1].tolist() == [-3, 0, 0, -3, -3] and found[0].tolist() == [2 * 2401 - 1, 2 * 1200 - 1, 0, 1, 2 * 24001 - 1]
    counts, texts = np.array([[100, 100, 10], [40, 0, 4]]), [1000, 400]
    assert shortages(counts, texts).tolist()[::2] == [0, 0] and shortages(counts, texts)[1] < -2
    assert log_ratios(counts, texts)[0] == 0 and ALL == 4 * BUCKETS
    assert best_cut(np.array([0.0, -1, -5, -6]), np.array([True, True, False, False])) == -3


def test_query_samples(spark):
    """The query draws half of all documents: those with the largest keys of all that are fit."""
    rows = queries.op6_quality(spark, "/root/testdata/sf0.01").collect()
    keys = sorted((r.key for r in rows if r.fit), reverse=True)
    k = len(rows) // 2
    assert k < len(keys) and sum(r.kept for r in rows) == k
    assert all(r.kept == (r.fit and r.key >= keys[k - 1]) for r in rows)
    # noise decides too
    assert min(r.log_importance for r in rows if r.kept) < max(r.log_importance for r in rows if r.fit and not r.kept)
