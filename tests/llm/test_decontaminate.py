import random

import numpy as np
import pytest

from lattica.llm.decontaminate import AGREEMENT, GAP, SENTENCE, SIMILARITY, TOKEN, UNITS, WINDOW, Templates, best_passage, covered, find_leaks, keep_clean, rarest

ITEMS = [
    (1, "On Monday Anna has 12 apples and gives 5 apples to Bob, who walks 3 km home. How many apples does Anna have now?"),
    (2, "The train to Paris leaves the station at noon and arrives after a trip of 90 minutes. When does it arrive?"),
    (3, "On Monday Anna has 12 apples and gives 5 apples to Bob, who walks 3 km home. How many apples does Anna have now?"),
    (4, "Too short"),
    (5, None),
]
FILL = "some words of the kind that any text may have in it and then a few more of them."


def flat(text):
    t = Templates([text])
    return t, *t.windows()


def one(item, text, similarity=SIMILARITY):
    """Brute force for one item and text: all pairs of equal windows, or equal sentences."""
    (a, qs, qh), (b, ds, dh) = flat(item or ""), flat(text or "")
    n = len(a.values)
    if not n:
        return []
    if len(covered(qs)) < similarity * n:
        own, whole = a.values.tolist(), b.values.tolist()
        for i in range(len(whole) - n + 1):
            begins, ends = b.flags[i] & 4, b.flags[i + n - 1] & 8
            if whole[i : i + n] == own and begins and ends and (n >= SENTENCE or len(whole) == n):
                return [(i, i + n, 1.0, 1.0, True)]
        return []
    d, q = (np.array(x, np.int64) for x in zip(*[(x, y) for x, hx in zip(ds.tolist(), dh.tolist(), strict=True) for y, hy in zip(qs.tolist(), qh.tolist(), strict=True) if hx == hy], strict=True)) if set(dh.tolist()) & set(qh.tolist()) else (None, None)
    if d is None:
        return []
    step = np.arange(WINDOW)
    hits = {"d": d, "q": q, "dv": b.values[d[:, None] + step], "df": b.flags[d[:, None] + step], "iv": a.values[q[:, None] + step], "if_": a.flags[q[:, None] + step]}
    found = best_passage(hits, n, similarity, AGREEMENT, GAP)
    return [found] if found else []


def found(text, **k):
    """Items in text; of equal ones the first."""
    return [i for i, t in ITEMS if i != 3 and one(t, text, **k)]


@pytest.mark.parametrize(
    "text, want",
    [
        (ITEMS[0][1], [1]),
        (f"{FILL}\n{ITEMS[0][1].upper().lower()} {FILL}", [1]),
        ("On Friday Carla has 30 apples and gives 7 apples to Dan, who walks 8 miles home. How many apples does Carla have now?", [1]),
        ("On Friday Carla has 30 apples and gives 7 apples to Dan, who walks 8 miles home. How many apples does Erik have now?", []),
        ("The train to Lyon leaves the station at noon and arrives after a trip of 2 hours. When does it arrive?", [2]),
        ("The train to Paris leaves the station at noon.", []),
        (f"{ITEMS[1][1]} {FILL * 5} {ITEMS[0][1]}", [1, 2]),
        (FILL * 20, []),
        ("Too short", [4]),
        ("It is Too short", []),
        ("", []),
        ("A B C D E F " * 50, []),
    ],
)
def test_leaks(text, want):
    if text.startswith(FILL):  # names in lower case are plain words
        assert 1 in found(text, similarity=0.3) or want == []
    else:
        assert found(text) == want


def test_find_leaks(spark):
    rng = random.Random(4)
    words = ["w%s" % "".join(rng.choice("abcdef") for _ in range(4)) for _ in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12, 60)))) for i in range(40)]
    rows, want = [], set()
    for d in range(200):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 300))]
        if d % 4 == 0:
            i = rng.randrange(40)
            at = rng.randrange(len(text) + 1)
            own = items[i][1].split()
            if d % 8 == 0:
                own[len(own) // 2] = "changed"
            text[at:at] = own
            want.add((d, i))
        rows.append((d, " ".join(text), 1, "x"))
    rows += [(1000, None, 1, "x"), (None, items[3][1], 1, "x"), (0, rows[0][1], 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int, gone_id string").repartition(3)
    bench = spark.createDataFrame([*items, (None, "no id at all in this one"), (77, None)], "item_id long, text string")
    for filter_bytes in (1 << 20, 1 << 17):
        got = find_leaks(docs, bench, filter_bytes=filter_bytes).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want | {(None, 3)}
        assert len(got) == len(want) + 2 and all(r.verbatim for r in got)
    kept = keep_clean(docs, bench)
    assert kept.columns == docs.columns
    # the second row of id 0 is the leaked text again; of the others a row goes for its own text
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r[0] for r in rows if r[0] is not None} - {d for d, _ in want})
    mixed = spark.createDataFrame([(5, items[3][1]), (5, "clean words"), (None, items[4][1]), (None, "others")], "doc_id long, text string")
    assert sorted(r.text for r in keep_clean(mixed, bench).collect()) == ["clean words", "others"]
    assert find_leaks(docs, bench.limit(0)).count() == 0 and find_leaks(docs.limit(0), bench).count() == 0


REPEATING = "we know that the basket has 3 red apples today. they say that the basket has 8 red apples today. how many red apples are there now?"
MARBLES = "we know that in the morning there are 12 marbles in the jar and later 5 marbles are taken out. how many marbles are left?"


def other(text, *pairs):
    for a, b in pairs:
        text = text.replace(f" {a} ", f" {b} ")
    return text


def test_item_that_repeats_a_window():
    assert [r[4] for r in one(REPEATING, f"{FILL} {REPEATING} {FILL}")] == [True]
    assert [r[4] for r in one(REPEATING, other(REPEATING, (3, 41), (8, 17)))] == [False]


def test_adjacent_variants():
    variants = [other(MARBLES, (12, 30), (5, 9)), other(MARBLES, (12, 44), (5, 21))]
    for text in (f"{MARBLES} {variants[0]}", " ".join(variants), f"{FILL} {' '.join([*variants, MARBLES])} {FILL}"):
        assert len(one(MARBLES, text)) == 1
    names = "he said that Anna met Bob and then Anna told Bob that Anna and Bob may go home with Anna today"
    mixed = "he said that Carl met Dora and then Erik told Fred that Gina and Hugo may go home with Ivan today"
    assert one(names, mixed) == [] and one(names, f"{mixed} {mixed}") == []


def test_names_that_begin_sentences():
    item = "Tom has 5 apples. Ann has 3 apples. Tom gives Ann 2 apples. How many apples does Tom have?"
    asked = "Ben has 9 apples. Eva has 4 apples. Ben gives Eva 1 apples. How many apples does Ben have?"
    assert [r[4] for r in one(item, item)] == [True]
    assert [r[4] for r in one(item, asked)] == [False]
    assert [r[4] for r in one(item, f"{FILL} {asked}\n{FILL}")] == [False]
    assert one(item, "Ben has 9 apples. Eva has 4 apples. Kim gives Leo 1 apples. How many apples does Mia have?") == []


#: Items of all kinds: word problems, short and slot-dense ones, an item that repeats itself, common phrases.
PROBLEMS = [
    "Tom has 5 apples. Ann has 3 apples. Tom gives Ann 2 apples. How many apples does Tom have?",
    "Anna has 3 red apples. Bob has 4 green apples. How many apples do Anna and Bob have?",
    "A train leaves Boston at 9 and travels 60 miles per hour. When does it reach Albany, 150 miles away?",
    "Maria reads 12 pages a day. Her book has 300 pages. How many days does Maria need to read it?",
    "A baker sells 40 loaves in the morning and 25 in the afternoon at 3 dollars each. How much money does the baker earn?",
    "If Peter is 8 years older than Lisa and Lisa is 12, how old will Peter be in 5 years?",
    "A tank holds 500 liters. A pump fills it with 20 liters per minute. How long does it take to fill the tank?",
    "Sam buys 4 pens for 2 dollars each and 3 books for 7 dollars each. How much does Sam pay in all?",
    "What is the capital of France and how many people live in it?",
    "How many people live in the capital of Spain and what is it?",
]
SHORT = ["What is 12 + 30?", "Compute 12 + 45 * 7 - 3", "Solve 345 + 982 * 17 for x", "Yes", "2, 3, 5, 7, 11, 13, 17. 19!"]
NAMES = {"Tom": "Ben", "Ann": "Eva", "Anna": "Carla", "Bob": "Dan", "Boston": "Dallas", "Albany": "Austin", "Maria": "Nora", "Peter": "Karl", "Lisa": "Rosa", "Sam": "Leo"}


def asked_again(text, rng):
    """The same with other names and numbers, each value with one of its own."""
    numbers = {}
    out = []
    for word in text.split():
        core = word.strip(".,?!")
        new = NAMES.get(core) or (numbers.setdefault(core, str(rng.randrange(13, 99) * 10 + len(numbers))) if core.isdigit() else core)
        out.append(word.replace(core, new))
    return " ".join(out)


def test_query_equals_brute_force(spark):
    rng = random.Random(3)
    items = [*enumerate(PROBLEMS + SHORT), (50, PROBLEMS[0]), (51, " ".join([PROBLEMS[3]] * 3)), (52, None), (53, "...")]
    filler = "how many people live in the town and what is it that they do in the morning at 9 when Tom has 5 apples".split()
    texts = [None, "", "Yes", "Yes Yes", "What is the what of the what"]
    for k in range(160):
        parts = [" ".join(rng.choice(filler) for _ in range(rng.randrange(0, 40)))]
        for _ in range(rng.randrange(3)):
            i = rng.choice([i for i, t in items if t])
            t = dict(items)[i]
            parts.append(rng.choice([t, asked_again(t, rng), f"{t} {asked_again(t, rng)}", f"{asked_again(t, rng)} {asked_again(t, rng)}", t[: len(t) // 2]]))
            parts.append(rng.choice(["\n", " and. ", " so it is "]) + " ".join(rng.choice(filler) for _ in range(rng.randrange(0, 30))))
        texts.append(rng.choice([" ", "\n", ". "]).join(parts))
    texts.append(" ".join([*["word"] * 3000, PROBLEMS[4], *(f"w{i}" for i in range(60_000)), asked_again(PROBLEMS[6], rng)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): (r.start_token, r.end_token, r.similarity, r.agreement, r.verbatim) for r in find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i): x for d, t in enumerate(texts) for i, item in items if i != 50 for x in one(item, t)}
    assert got == want and len({i for _, i in got}) >= 13 and not all(x[4] for x in got.values())
    assert {i for d, i in got if d == len(texts) - 1} == {4, 6}


def test_recall_on_questions_asked_again(spark):
    """All of the word problems are found verbatim and with other names and numbers, alone and side by side."""
    rng = random.Random(5)
    rows = [(k, f(t)) for k, t in enumerate(PROBLEMS) for f in (lambda t: t, lambda t: asked_again(t, rng), lambda t: f"{t} {asked_again(t, rng)}", lambda t: f"{FILL} {asked_again(t, rng)} {asked_again(t, rng)} {FILL}")]
    docs = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, spark.createDataFrame(list(enumerate(PROBLEMS)), "item_id long, text string")).collect()}
    hit = sum((n, k) in got for n, (k, _) in enumerate(rows))
    assert hit >= 0.9 * len(rows) and {i for _, i in got} == set(range(len(PROBLEMS)))


def test_rarest_windows_decide():
    """Whoever covers so much of an item has one of the windows picked."""
    rng = random.Random(7)
    for _ in range(200):
        size = rng.randrange(5, 60)
        starts = np.array(sorted(rng.sample(range(size - 4), max(1, int((size - 4) * rng.uniform(0.6, 1))))))
        pick = set(starts[rarest(starts, np.array([rng.random() for _ in starts]), size, 0.8)].tolist())
        left = np.array([s for s in starts.tolist() if s not in pick])
        assert not len(left) or len(covered(left)) < 0.8 * size


def test_plain_pieces_are_read_like_others():
    """Tokens by numpy equal those by the pattern."""
    rng = random.Random(11)
    letters = "abcxyzABCÄÖÜäöüßéÉñÑÿÀ×÷Ω"
    pieces = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 9))) + rng.choice(["", ".", ",", "!", "?)", '."', "###", "'s", "…", "-x", "5", ":"]) for _ in range(3000)] + ["km", "KM.", "%%%", "(", "don't", "3.5km", "x" * 60]
    t = Templates(["\n".join(pieces)])
    want, flags = [], []
    for p in pieces:
        found = TOKEN.findall(p)
        want += [f.lower() for f in found]
        for k, f in enumerate(found):
            ends = k == len(found) - 1
            begins = k == 0
            number = f[0].isnumeric()
            unit = k > 0 and found[k - 1][0].isnumeric() and f.lower() in UNITS
            name = f[0].isupper() and not number and not unit
            flags.append(bool(number or unit or (name and not begins)) + 2 * (name and begins) + 4 * begins + 8 * ends)
    of = dict(zip(want, t.values.tolist(), strict=True))
    assert [of[w] for w in want] == t.values.tolist() and len(set(of.values())) == len(of)
    assert t.flags.tolist() == flags
