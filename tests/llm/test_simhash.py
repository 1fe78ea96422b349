import random

import numpy as np
import pytest
import xxhash

from lattica.llm.components import connected_components
from lattica.llm.simhash import NearDuplicates, fingerprint, trie_links


def brute_print(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint():
    for t in ["", "  ", "One", "a b", "a b c", "The and Élan THE and élan the AND x" * 30, "a\x0bb\x1cc d e f g"]:
        assert fingerprint(t) == brute_print(t)


@pytest.mark.parametrize("seed", range(6))
def test_trie_links_equal_brute_force(seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(12 if seed % 2 else 48) for _ in range(6)]
    keys = sorted({(b ^ sum(1 << rng.randrange(12) for _ in range(rng.randrange(5)))) & (2**48 - 1) for b in base for _ in range(60)})
    groups = [rng.randrange(3) for _ in keys]
    order = sorted(range(len(keys)), key=lambda i: (groups[i], keys[i]))
    k, g = np.array([keys[i] for i in order], np.uint64), np.array([groups[i] for i in order])
    links = trie_links(k, g, 48)
    want = classes(len(k), [(i, j) for i in range(len(k)) for j in range(i) if g[i] == g[j] and bin(int(k[i]) ^ int(k[j])).count("1") <= 3])
    assert classes(len(k), links.tolist()) == want and len(links) == len(k) - len(set(want))


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(70)] + [(500, i) for i in range(600, 700)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = classes(700, pairs)
    assert got == {x: want[x] for p in pairs if p[0] != p[1] for x in p}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("hot_rows", [20_000, 3])
def test_near_duplicates(spark, hot_rows):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(500)]
    rows = [(1000 + i, t, "x", i) for i, t in enumerate(["", None, " \n", "one", "One", "a b"])]
    for g in range(12):
        text = [rng.choice(words) for _ in range(150)]
        for c in range(8):
            t = list(text)
            for _ in range(c):
                t[rng.randrange(150)] = rng.choice(words)
            rows.append((len(rows), " ".join(t), "x", 0))
    rows.append((5000, rows[-1][1], None, None))
    rows.append((None, "one", None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, node long")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in NearDuplicates(docs, hot_rows=hot_rows).labelled().collect()}
    known = [r for r in rows if r[0] is not None]
    prints = [brute_print(r[1] or "") for r in known]
    label = classes(len(known), [(i, j) for i in range(len(known)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3])
    least = {}
    for r, c in zip(known, label, strict=True):
        least[c] = min(least.get(c, r[0]), r[0])
    assert {r[0]: ("%016x" % p, least[c]) for r, p, c in zip(known, prints, label, strict=True)} == {k: v for k, v in got.items() if k is not None}
    assert got[None][1] is None
    if hot_rows > 3:
        assert NearDuplicates(docs.limit(0)).labelled().count() == 0
