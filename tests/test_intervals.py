import random

from rasm.operators.intervals import periods_and_gaps

SCHEMA = "session_id string, start_sample long, end_sample long, kind string, w string"


def run(spark, rows, block=10):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(map(tuple, periods_and_gaps(df, "session_id", "start_sample", "end_sample", block).collect()), key=str)


def brute(rows):
    out = []
    for k in {r[0] for r in rows}:
        own = sorted((s, e) for q, s, e in rows if q == k and s is not None and e is not None and s < e)
        periods = []
        for s, e in own:
            if periods and s <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], e)
            else:
                periods.append([s, e])
        out += [(k, "period", s, e) for s, e in periods]
        out += [(k, "gap", a[1], b[0]) for a, b in zip(periods, periods[1:])]
    return sorted(out, key=str)


def test_cases(spark):
    rows = [("a", 0, 5), ("a", 5, 8), ("a", 9, 12), ("a", 1, 2), ("a", 9, 12), ("a", 7, None), ("a", 8, 8), ("a", 30, 20), ("b", 100, 101), (None, 1, 4), (None, 4, 5), (None, 40, 41), ("n", -25, -3), ("n", -3, 2)]
    assert run(spark, rows) == brute(rows)


def test_random_blocks(spark):
    r = random.Random(5)
    rows = [(r.choice("abc"), s := r.randint(0, 300), s + r.choice([0, 1, 2, 3, 9, 70])) for _ in range(250)]
    for block in (7, 50, 10**6):
        assert run(spark, rows, block) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
