"""Ranking of a text's candidates: the same as one by one, with few of the windows compared."""

import random
from collections import Counter

import numpy as np

from rasm import kernels as k
from rasm.operators import corpus, retrieve


def test_ranker_is_brute_force_and_compares_few_windows():
    r = random.Random(3)
    words = ["".join(r.choice("ابتثجحدرس") for _ in range(r.randint(2, 7))) for _ in range(60)]
    verses = [" ".join(r.choice(words) for _ in range(r.choice([1, 3, 9, 14, 40]))) for _ in range(50)]
    place: dict[str, list[int]] = {}
    for i, v in enumerate(verses):
        for w in set(v.split()):
            place.setdefault(w, []).append(i)
    idf = {w: 1 + 1 / len(at) for w, at in place.items()}
    ranker = k.Ranker(verses, {w: (np.array(at), np.full(len(at), idf[w] / 2)) for w, at in place.items()}, idf)
    spoilt = lambda t: "".join(r.choice("ابتz ") if r.random() < 0.1 else x for x in t)
    texts = [spoilt(r.choice(verses)) for _ in range(40)] + [" ".join(r.choice(words) for _ in range(n)) for n in (1, 5, 13, 30)] + ["", "zz", verses[3]]
    compared, run = Counter(), k._Windows._run

    def counted(self, count, *rest):
        compared["windows"] += count
        return run(self, count, *rest)

    k._Windows._run = counted
    try:
        for group in (np.arange(50) // 7, np.zeros(50, int)):
            for t, got in zip(texts, ranker.best([(t, t.split()) for t in texts], group)):
                want = {}
                for i, s in zip(*ranker.candidates(t.split(), 30)):
                    f = k.partial_ratio(t, verses[i]) / 100
                    compared["all"] += len(t) and len(t) + len(verses[i]) - 1
                    want[group[i]] = max(want.get(group[i], (-1.0,)), (k.half_up(0.4 * s + 0.6 * f), -i, s, f))
                assert {group[i]: (k.half_up(0.4 * s + 0.6 * f), -i, s, f) for i, s, f in got} == want, t
    finally:
        k._Windows._run = run
    assert compared["windows"] < compared["all"] / 2, compared


def test_rerank_best_of_all(spark):
    ref = corpus.reference(spark.createDataFrame([(1, 1, "علم حرم"), (1, 2, "عدل علم نهو"), (2, 1, "علم حرم"), (3, 1, "جدح")], "surah int, ayah int, text string"))
    q = spark.createDataFrame([("a", "علم حرم", ["علم", "حرم"]), ("b", "علم حرم", ["علم", "حرم"]), ("c", "", []), ("d", None, None), ("e", "جدح علم", ["جدح", "علم"])], "q string, norm string, words array<string>")
    every = {}
    for x in retrieve.rerank(q, "q", ref).collect():
        every.setdefault(x["q"], []).append((x["score"], -x["surah"], x["bm25"], x["fuzzy"]))
    assert {k: len(v) for k, v in every.items()} == dict.fromkeys("abcde", 3) and every["a"] == every["b"]
    assert {x["q"]: (x["score"], -x["surah"], x["bm25"], x["fuzzy"]) for x in retrieve.rerank(q, "q", ref, best=True).collect()} == {k: max(v) for k, v in every.items()}


def test_upload_asks_for_the_best_chapter_only(spark, monkeypatch):
    from rasm.operators import pipeline

    ref = corpus.reference(spark.createDataFrame([(1, 1, "علم حرم"), (2, 1, "علم حرم"), (3, 1, "جدح")], "surah int, ayah int, text string"))
    df = spark.createDataFrame([("a", 2, 1, "علم حرم"), ("b", None, None, "جدح علم"), ("c", 1, 1, None)], "k string, surah int, expected int, raw string")
    most, rerank = [], retrieve.rerank

    def counted(*args, **kwargs):
        rows = rerank(*args, **kwargs)
        most.extend(r["count"] for r in rows.groupBy("k").count().collect())
        return rows

    monkeypatch.setattr(retrieve, "rerank", counted)
    got = {r["k"]: r["surah"] for r in pipeline.upload(df, "k", ref).collect()}
    assert got == {"a": 1, "b": 3, "c": None} and most == [1, 1]
