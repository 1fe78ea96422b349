"""The pipeline against brute force, stage by stage, and the queries' registration."""

import re

from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from lattica.llm import queries
from lattica.llm.decontaminate import Templates
from lattica.llm.quality import resample
from lattica.llm.shared import stored, table
from lattica.llm.tokens import vocabulary_path
from tests.llm.test_decontaminate import one

SF = "/root/testdata/sf0.01"


def shingle_set(text):
    words = re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similar(docs):
    """Pairs whose shingle sets have a Jaccard similarity of 0.8 or more, by all that share a shingle."""
    sets, at, out = {i: shingle_set(t) for i, t in docs.items()}, {}, set()
    for i, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in at[x] if j < i}:
            both = len(s & sets[j])
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                out.add((j, i))
    return out


def leaked(items, text):
    """Whether any item leaked into text; windows decide only which pairs are worth a look."""
    have = set(Templates([text]).windows()[1].tolist())
    return any((not w or w & have) and one(t, text) for t, w in items)


def test_run_equals_brute_force(spark):
    """Each stage on what the stage before kept."""
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    now = table(spark, SF, "documents")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, SF), name)
        left[name] = sorted(r[0] for r in now.select("doc_id").collect())
        if name != "packing":
            assert now.columns == table(spark, SF, "documents").columns and len(left[name]) == len(set(left[name]))
    assert left["quality"] == sorted(r.doc_id for r in resample(table(spark, SF, "documents"), table(spark, SF, "labels")).where("kept").collect())
    first = {}
    for i in left["quality"]:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", docs[i] or ""), i)
    assert left["exact_dedup"] == sorted(first.values())
    pairs = similar({i: docs[i] for i in left["exact_dedup"]})
    stay = set(left["near_dedup"])
    assert pairs and not [p for p in pairs if stay.issuperset(p)]
    near = {x for p in pairs for x in p}
    assert set(left["exact_dedup"]) - stay <= near and set(left["exact_dedup"]) - near <= stay
    items = [(r.text, set(Templates([r.text or ""]).windows()[1].tolist())) for r in table(spark, SF, "benchmark").collect()]
    assert left["decontaminate"] == [i for i in left["near_dedup"] if not leaked(items, docs[i] or "")]
    assert len(docs) > len(left["quality"]) > len(left["exact_dedup"]) > len(left["near_dedup"]) > len(left["decontaminate"]) > 0

    got = now.collect()
    t = Tokenizer.from_file(vocabulary_path())
    want = {i: len(t.encode(docs[i] or "", add_special_tokens=False).ids) + 1 for i in left["decontaminate"]}
    assert {r.doc_id: r.doc_tokens for r in got} == want and sum(r.length for r in got) == sum(want.values())


def write_tables(spark, folder, docs, schema, items):
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)] if docs else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_nulls_repeated_ids_and_clashing_columns(spark, tmp_path):
    """Each row is judged for itself, and its columns stay as they are until packing."""
    plain = "these are the words of a text that nobody asked about and that is long enough for a few shingles to be told apart"
    asked = "what did the seven old sailors carry home over the frozen river in the winter of the great storm"
    docs = [(1, plain, "a"), (1, plain + " but the second row says more", "b"), (1, asked, "c"), (None, asked, "d"), (None, "another text without an id of its own", "e"), (None, None, "f"), (2, "", "g"), (3, plain, None), (3, plain.replace(" ", "  "), "h")]
    write_tables(spark, tmp_path, docs, "doc_id long, text string, row_file string", [(5, asked), (None, plain), (6, None)])
    sf = f"file://{tmp_path}"
    now = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = stored(stage(spark, now, sf), name)
    # one of each group of equal texts stays; of equal ones that with the smallest id
    assert sorted(((r.doc_id, r.row_file) for r in now.collect()), key=str) == sorted([(1, "a"), (1, "b"), (None, "e"), (2, "g")], key=str)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == {1, 2, None}


def test_empty_tables(spark, tmp_path):
    write_tables(spark, tmp_path, [], "doc_id long, text string", [])
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)) == list(range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and set(queries.QUERIES) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "packing"]
