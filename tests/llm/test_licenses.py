from lattica.llm.licenses import KNOWN, scan


def test_scan(spark):
    mit = KNOWN[0][1]
    rows = [
        (1, mit, "x"),
        (2, "Copyright (c) 2020 Some One\n© 2021 x\nAll rights reserved.\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(". ", ".\r\n   ").replace("HOLDERS", "owners"), None),
        (3, "Before.\nReleased under the MIT Licence!\nafter\nlicensed under CC BY-NC 4.0", "x"),
        (4, mit + " more", "x"),
        (5, "Released under the MIT License.", "x"),
        (6, None, "x"),
        (7, "  \n--\n", "x"),
        (8, "word " * 100_000 + "\nReleased under the MIT License.", "x"),
        (None, "Licensed under CC BY 4.0.", "x"),
        (5, "other", "x"),
    ]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string, scan_id string")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert (by[1].license_id, by[2].license_id, by[4].license_id) == ("MIT", "MIT", None) and by[1].digest == by[2].digest
    assert (by[3].license_id, by[3].notices) == (None, "CC-BY-NC-4.0,MIT")
    assert sorted(str((r.license_id, r.notices)) for r in got if r.doc_id == 5) == ["('MIT', 'MIT')", "(None, 'MIT')"]
    assert by[6].digest == by[7].digest and by[6].license_id is by[6].notices is None
    assert by[8].notices == "MIT" and by[None].license_id == "CC-BY-4.0"
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    names = [n.lower() for n in scan(spark.createDataFrame(rows, "doc_id long, text string, scan_id string"))._jdf.queryExecution().executedPlan().toString().split()]
    assert not [n for n in names if "python" in n or "arrow" in n]
