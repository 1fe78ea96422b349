import random

import pytest

import corpus_pipeline
from lattica.llm import jaccard
from lattica.llm.jaccard import near_copies


def sets(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def documents():
    rng = random.Random(6)
    word = lambda: "w%d" % rng.randrange(5000)
    texts = [[word() for _ in range(rng.randrange(1, 200))] for _ in range(60)]
    for k in range(120):  # copies with a few words changed, from far above the bound to far below
        own = list(texts[k % 60])
        for _ in range(rng.randrange(0, 1 + len(own) // 20)):
            own[rng.randrange(len(own))] = word()
        texts.append(own)
    for base in ([word() for _ in range(300)], [word() for _ in range(80)]):  # dense groups, larger than a small bucket
        for _ in range(70):
            own = list(base)
            own[rng.randrange(len(own))] = word()
            texts.append(own)
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, "  "), (902, "few words"), (903, "FEW  words"), (None, "few words")]


@pytest.mark.parametrize("small", [None, 3])
def test_against_brute_force(spark, small):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if small is None:
        gone = {r[0] for r in rows} - {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    else:
        gone = {r.doc_id for r in near_copies(docs, small=small).collect()}
    own = {i: sets(t) for i, t in rows if i is not None}
    below = {i: {j for j in own if j < i and similar(own[i], own[j])} for i in own}
    # the stage compares a row without an id too, as the last of its group
    assert (None in gone) == (small is None)
    gone.discard(None)
    assert gone <= {i for i in own if below[i]} and len(gone) > 150 and {901, 903} <= gone
    assert all(below[i] <= gone for i in own if i not in gone)  # no two that stay are similar


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "other words of any kind here")], "doc_id long, text string")
    assert near_copies(docs).count() == 0 and near_copies(docs.limit(0)).count() == 0


def test_dense_group_makes_few_pairs(spark, monkeypatch):
    """Copies of one text with changes of their own, most of which aren't similar to each other: pairs don't grow with the square."""
    rng = random.Random(3)
    base, rows = ["b%d" % i for i in range(150)], []
    for i in range(600):
        own = list(base)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(150)] = "n%d" % rng.randrange(10**6)
        rows.append((i, " ".join(own)))
    plain, compared = jaccard.stored, []

    def stored(df, name):
        out = plain(df, name)
        if name in ("pairs", "nearest", "partners"):
            compared.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stored", stored)
    gone = {r.doc_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    own = {i: sets(t) for i, t in rows}
    stay = [i for i in own if i not in gone]
    assert not [1 for i in stay for j in stay if j < i and similar(own[i], own[j])]
    assert all(any(similar(own[i], own[j]) for j in range(i)) for i in gone)
    assert sum(compared) < len(rows) ** 2 / 2 / 10  # a tenth of all pairs


@pytest.mark.parametrize("hot_rows", [20, 20_000])
def test_hot_blocks_in_slices(spark, hot_rows):
    rng = random.Random(4)
    base = ["b%d" % i for i in range(100)]
    rows = [(i, " ".join([*base, "n%d" % rng.randrange(10**6)])) for i in range(100)] + [(200 + i, " ".join("o%d" % rng.randrange(10**6) for _ in range(90))) for i in range(30)]
    assert sorted(r.doc_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string"), hot_rows=hot_rows).collect()) == list(range(1, 100))
