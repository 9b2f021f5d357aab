from pyspark.sql import functions as F

from askgrid.llm.licenses import Automaton, scan_licenses


def test_automaton():
    machine = Automaton("a [[b {{x:2}} c]] d [[e|f g]] h")
    good = ["a d h", "a b c d h", "a b 1 c d h", "a b 1 2 c d e h", "a d f g h"]
    bad = ["a h", "a b 1 2 3 c d h", "a d e f g h", "a d f h", "d h"]
    assert all(machine.spans(t.encode().split()) == [(0, len(t.split()))] for t in good)
    assert not any(machine.spans(t.encode().split()) for t in bad)
    assert machine.spans(b"x a d h y a d h".split()) == [(1, 4), (5, 8)]


def test_scan(spark, docs, no_docs, wide_docs):
    cases = {
        "cc by cc by": (4, 2, 0, 2, ["cc-by"], ["cc-by"], 0.5),
        "Licensed under the Apache License, Version 2.0.": (8, 1, 3, 3, ["apache"], ["apache", "apache-2.0"], 1.0),
        "THE MIT LICENSE": (3, 1, 1, 1, ["mit"], ["mit"], 0.5),
        "Released under the MIT License": (5, 1, 3, 3, ["mit"], ["mit", "mit-notice"], 1.0),
        "cc by-nc 4.0": (5, 1, 0, 0, ["cc-by"], ["cc-by"], 0.5),
        "ccby \u00e9cc by": (3, 0, None, None, [], [], 0.0),
        "": (0, 0, None, None, [], [], 0.0), None: (0, 0, None, None, [], [], 0.0),
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "id int, text string")
    got = df.select("id", scan_licenses().alias("s")).orderBy("id").collect()
    assert [(*r["s"][:6], r["s"]["score"]) for r in got] == list(cases.values())
    assert docs.select(scan_licenses().alias("s")).where("s.n_base > 0").count() == 1
    assert no_docs.select(scan_licenses()).count() == 0 and wide_docs.select(F.col("*"), scan_licenses().alias("s")).count() == 90
