import datetime as dt
import math

import numpy as np

from rasm.llm import quantiles as q

SCHEMA = "eval_id long, reciter string, at timestamp, wer double, ingested int, codes string"


def test_codes_keep_order():
    x = np.array([-np.inf, -1e30, -2.5, -1e-9, -0.0, 0.0, 1e-300, 1e-9, 0.3, 0.3001, 1, 64, 1e30, np.inf])
    codes = q.encode(x)
    assert (np.diff(codes) >= 0).all() and codes[4] == codes[5]
    for v in (0.0, 0.25, 0.3, 1.0, 17.3, -2.5):
        assert math.isclose(q.decode(int(q.encode(np.array([v]))[0])), v, rel_tol=q.VALUE_ERROR)


def test_sketch_merges_and_deletes():
    r = np.random.default_rng(3)
    v = r.gamma(2.0, 0.2, 30_000)
    parts = []
    for part in (v[:10_000], v[10_000:]):
        s = q.Summary()
        codes, w = np.unique(q.encode(part), return_counts=True)
        s.add(codes, w, None)
        parts.append(s.parts())
    whole = q.Summary()
    for c, w, k in parts:
        whole.add(np.array(c), np.array(w), np.array(k))
    assert whole.count() == len(v)
    ordered = np.sort(v)
    bound = whole.rank_error()
    assert 0 < bound < 0.05
    for p, x in zip(q.PROBABILITIES, whole.quantiles()):
        lo, hi = np.searchsorted(ordered, [x * (1 - 2 * q.VALUE_ERROR), x * (1 + 2 * q.VALUE_ERROR)])
        assert lo / len(v) - bound <= p <= hi / len(v) + bound
    c, w = np.unique(q.encode(v[:29_000]), return_counts=True)
    whole.add(c, -w, None)
    assert whole.count() == 1000
    assert q.Summary().quantiles() == [None] * 4


def test_every_answer_is_of_the_counters():
    s = q.Summary()
    s.add(q.encode(np.array([0.5, 0.25])).astype(np.int64), np.array([1, 2]), None)
    again = q.Summary()
    again.add(None, None, s.counters().copy())
    assert not len(s.codes) and s.quantiles() == again.quantiles() and s.count() == 3


def test_daily_and_summary(spark):
    day = dt.datetime(2025, 1, 1)
    rows = [(i, "a" if i % 3 else None, day + dt.timedelta(days=i % 2), [0.5, 0.25, 2.0, None, float("nan")][i % 5], 1, "x") for i in range(300)]
    rows += [(r[0], r[1], r[2], 9.0, 2, "late") for r in rows[:100]]  # delivered again, later
    df = spark.createDataFrame(rows, SCHEMA)
    daily = q.daily(df, "eval_id", "reciter", "at", ["wer"], "ingested")
    got = {r["group"]: r for r in q.summarize(daily, ["group", "metric"]).collect()}
    for g in ("a", None):
        v = sorted(x[3] for x in rows[:300] if x[1] == g and x[3] is not None and x[3] == x[3])
        assert got[g]["n"] == len(v) and got[g]["rank_error"] == 0.0  # no more different values than a median passes over
        assert math.isclose(got[g]["p50"], v[math.ceil(0.5 * len(v)) - 1], rel_tol=q.VALUE_ERROR)
    one = daily.where("day = '2025-01-01'")
    left = q.summarize(q.subtract(daily, one, ["group", "metric"]), ["group", "metric"]).orderBy("group").collect()
    assert left == q.summarize(daily.where("day <> '2025-01-01'"), ["group", "metric"]).orderBy("group").collect()
    merged = q.merge(daily, ["metric"])
    assert q.summarize(merged, ["metric"]).first()["n"] == 180
    assert q.summarize(q.daily(df.limit(0), "eval_id", "reciter", "at", ["wer"], "ingested"), ["metric"]).count() == 0


def test_small_holds_and_written_days(spark, monkeypatch, tmp_path):
    day = dt.datetime(2025, 1, 1)
    r = np.random.default_rng(5)
    rows = [(i, f"g{i % 3}", None if i % 7 == 0 else day + dt.timedelta(days=i % 3), float(r.gamma(2.0, 0.2)), 1, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    daily = q.daily(df, "eval_id", "reciter", "at", ["wer"], "ingested")
    q.write(daily, str(tmp_path / "daily"))
    back = spark.read.parquet(str(tmp_path / "daily"))
    for got in q.summarize(back, ["group", "metric"]).collect():
        v = np.sort([x[3] for x in rows if x[1] == got["group"]])
        assert got["n"] == len(v)
        for p, x in zip(q.PROBABILITIES, (got["p50"], got["p90"], got["p95"], got["p99"])):
            lo, hi = np.searchsorted(v, [x * (1 - 2 * q.VALUE_ERROR), x * (1 + 2 * q.VALUE_ERROR)])
            assert lo / len(v) - got["rank_error"] <= p + 1 / len(v) and p <= hi / len(v) + got["rank_error"] + 1 / len(v)


def test_sums_do_not_depend_on_how_much_is_held(monkeypatch):
    import pyarrow as pa

    schema = pa.schema([("day", pa.date32()), ("group", pa.string()), ("metric", pa.string()), *q._LISTS])
    b = pa.RecordBatch.from_pydict({"day": pa.array([0, 1, 0, None, 0, 1] * 50, pa.int32()).cast(pa.date32()), "grp": ["a", None, "b", "a", "a", None] * 50, "m0": [float(i % 40) for i in range(300)]})

    def total(held, sparse):
        monkeypatch.setattr(q, "HELD", held)
        monkeypatch.setattr(q, "SPARSE", sparse)
        out: dict = {}
        for x in q._fill(iter([b.slice(i, 30) for i in range(0, 300, 30)]), ["m0"], schema):
            for key, parts in q._rows(x, 3):
                out.setdefault(key, q.Summary()).add(*parts)
        return {k: s.counters().tolist() for k, s in out.items()}

    assert total(1 << 19, 1024) == total(40, 1024) == total(40, 3) and len(total(40, 3)) == 4
