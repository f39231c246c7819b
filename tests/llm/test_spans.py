import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasm.llm import spans


def brute(rows, least):
    """rec_key -> covered code points, by comparing all windows."""
    holders = {}
    for key, role, text in rows:
        for i in range(len(text or "") - least + 1):
            holders.setdefault(text[i : i + least], set()).add((key, role))
    out = {}
    for key, role, text in rows:
        covered = set()
        for i in range(len(text or "") - least + 1):
            other = {r for k, r in holders[text[i : i + least]] if k != key}
            if other and (role == 0 or 1 in other):
                covered |= set(range(i, i + least))
        if covered:
            out[key] = len(covered)
    return out


def rows_of(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcde\u0645\u0646") for _ in range(r.randint(1, 9))) for _ in range(40)]
    base = [" ".join(r.choice(words) for _ in range(40)) for _ in range(4)]
    rows = []
    for i in range(40):
        t = r.choice(base)
        a = r.randint(0, 80)
        t = t[a : a + r.randint(50, 140)]
        if r.random() < 0.5:
            k = r.randint(0, len(t) - 1)
            t = t[:k] + r.choice("xyz ") + t[k + 1 :]
        rows.append((f"k{i}", int(r.random() < 0.2), t))
    rows += [("null", 0, None), ("empty", 0, ""), ("short", 0, base[0][:59]), ("emoji", 0, "\U0001f600" * 70), ("emoji2", 0, "\U0001f600" * 65), ("own", 0, "zq" * 60), ("none", 0, "w" * 61 + "v" * 61), ("same1", 0, "u" * 40 + "t" * 40), ("same2", 0, "u" * 40 + "t" * 40), ("v1", 1, "only verse " * 7), ("c1", 0, "only verse " * 7)]
    return rows


@pytest.mark.parametrize("limit", [200_000, 200, 60, 25, 8, 3, 1])  # groups over it at no, some, every length
def test_same_as_brute_force(spark, limit):
    rows = rows_of(limit)
    df = spark.createDataFrame(rows, "rec_key string, role int, text string").withColumn("k1", F.lit("clash"))
    got = {r["rec_key"]: r["covered"] for r in spans.report(df, limit=limit).collect()}
    assert got == brute(rows, 60)
    assert "v1" not in got and "c1" in got


def test_records_take_a_delivery_once(spark):
    t = "a b c d e f g h i j k l m n o p q r s t u v w x y z a b c d e f g h"
    chunks = spark.createDataFrame([("s", 1, t, 1), ("s", 1, t, 2), ("s", 2, None, 1)], "session_id string, chunk_index int, corrected_text string, received_at int")
    verses = spark.createDataFrame([(1, 1, t[:40])], "surah int, ayah int, text string")
    assert spans.report(spans.records(chunks, verses)).count() == 0
    assert spans.report(spans.records(chunks.limit(0), verses.limit(0))).count() == 0


def test_common_prefixes_of_sorted_suffixes():
    r = random.Random(1)
    text = "".join(r.choice("ab") for _ in range(300))
    code = np.array([ord(x) - 96 for x in text], np.uint8)
    starts = np.arange(250)
    sizes = np.minimum(40, 300 - starts)
    order, common = spans.lcp_sorted(code, starts, sizes)
    suffix = [text[i : i + 40] for i in order]
    assert suffix == sorted(suffix)
    for i in range(1, 250):
        assert common[i] == len(os.path.commonprefix(suffix[i - 1 : i + 1]))


def test_equal_windows_have_equal_places():
    r = random.Random(2)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 40))) for _ in range(30)]
    span = " ".join(r.choice(words) for _ in range(30))
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 9))) + " " + span + " " + r.choice(words) for _ in range(8)] + ["x" * 70, "", "short"]
    doc, pos, n, *h = spans.pieces(texts)
    seen = {}
    for d, p, k, *g in zip(doc, pos, n, *h):
        for i in range(k):
            assert seen.setdefault(texts[d][p + i : p + i + 60], tuple(g)) == tuple(g)
    assert sum(n) == sum(max(0, len(t) - 59) for t in texts)


def test_long_text(spark):
    t = " ".join(str(i) for i in range(40_000))
    df = spark.createDataFrame([("a", 0, t), ("b", 0, t[1000:3000])], "rec_key string, role int, text string")
    assert {r["rec_key"]: r["covered"] for r in spans.report(df).collect()} == {"a": 2000, "b": 2000}
