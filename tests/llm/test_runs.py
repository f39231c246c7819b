import random

from rasm.llm.runs import collapse_runs

SCHEMA = "session_id string, chunk_index int, matched int, s double, e double, at int, event string"


def brute(rows, least):
    once = {}
    for r in sorted(rows, key=lambda r: r[5]):
        once.setdefault(r[:2], r)
    out = []
    for k in {r[0] for r in rows}:
        own = sorted((r for r in once.values() if r[0] == k and r[2] is not None), key=lambda r: (r[3] is not None, r[3] or 0, r[1]))
        i = 0
        while i < len(own):
            j = i
            while j + 1 < len(own) and own[j + 1][2] == own[i][2]:
                j += 1
            if j - i + 1 >= least:
                out.append((k, own[i][2], own[i][1], own[j][1], j - i + 1))
            i = j + 1
    return sorted(out, key=str)


def run(spark, rows, least):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = collapse_runs(df, "session_id", "chunk_index", "matched", "s", "e", "at", least)
    return sorted((tuple(r)[:5] for r in got.collect()), key=str)


def test_cases(spark):
    rows = [("a", 0, 5, 0.0, 1.0, 1), ("a", 1, 5, 1.0, 2.0, 1), ("a", 1, 5, 1.0, 2.0, 9), ("a", 2, None, 1.5, 2.0, 1), ("a", 3, 5, 2.0, 3.0, 1), ("a", 4, 6, 0.5, None, 1), (None, 1, 6, None, 1.0, 1), (None, 2, 6, None, 1.0, 1), ("b", 0, 6, 1.0, 2.0, 1)]
    for least in (1, 2):
        assert run(spark, rows, least) == brute(rows, least)
    assert run(spark, [], 1) == []


def test_one_session_over_all_partitions(spark):
    r = random.Random(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        rows = [("hot", i, r.choice([1, 1, 1, 2]), i / 2, i / 2 + 1, 1) for i in range(400)] + [("hot", 400 + i, 7, 500.0 + i, 501.0 + i, 1) for i in range(300)]
        rows += [(f"s{i % 40}", i, 3, float(i), i + 1.0, 1) for i in range(80)]
        for least in (1, 2):
            assert run(spark, rows, least) == brute(rows, least)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nearly_the_same_texts(spark):
    from pyspark.sql import functions as F

    rows = [("s", 1, "ab c", 1.0, 2.0, 1), ("s", 2, "a b, C".lower(), 2.0, 3.0, 1), ("s", 3, None, 3.0, 4.0, 1), ("s", 4, "abc!", 4.0, 5.0, 1), ("s", 5, "x", 5.0, 6.0, 1)]
    df = spark.createDataFrame(rows, "session_id string, i int, t string, a double, z double, at int")
    letters = F.regexp_replace("t", r"[^\p{L}]", "")
    got = collapse_runs(df, "session_id", "i", F.when(letters != "", F.xxhash64(letters)), "a", "z", "at", 2).collect()
    assert [(r["first_index"], r["last_index"], r["n"], r["seconds"]) for r in got] == [(1, 4, 3, 4.0)]
