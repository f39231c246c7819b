"""Uploads: equal ones once, texts normalized once, the nearest candidates and the best chapter with few comparisons."""

import random

import numpy as np
from pyspark.sql import functions as F

from rasm import kernels as k
from rasm.functions import text as tx
from rasm.operators import corpus, guard, match, pipeline, retrieve

VERSES = [(1, 1, "علم حرم"), (1, 2, "عدل علم نهو"), (1, 4, "حرم حرم"), (2, 1, "علم حرم"), (2, 2, None), (3, 1, "جدح"), (4, 1, None)]
SCHEMA = "surah int, ayah int, text string"


def test_nearest_is_brute_force_and_compares_few():
    r = random.Random(1)
    some = ["".join(r.choice("ابتثجحخ ") for _ in range(r.choice([0, 1, 5, 40, 64, 65, 128, 200]))) for _ in range(80)]
    asked = [("".join(r.choice("ابz\U0001f600") if r.random() < r.choice([0, 0.1, 0.4]) else x for x in r.choice(some)), np.array(sorted(r.sample(range(80), r.randint(1, 12))))) for _ in range(150)]
    asked += [("".join(r.choice("ابتz") for _ in range(n)), np.arange(0, 80, 7)) for n in (0, 1, 63, 64, 65, 129, 300)]
    near, compared = k.Nearest(some), []
    run = near._run
    near._run = lambda t, n, of, at: compared.append(len(at)) or run(t, n, of, at)
    for (text, own), (least, won) in zip(asked, near.many(asked)):
        cer = [k.levenshtein(text, some[i]) / len(some[i]) if some[i] else 1.0 for i in own.tolist()]
        assert least == min(cer) and won.tolist() == [i for i, x in zip(own.tolist(), cer) if x == min(cer)], text
    assert sum(compared) < sum(len(own) for _, own in asked) / 2


def test_matching_over_arrays_is_the_native_one(spark):
    ref = corpus.reference(spark.createDataFrame(VERSES, SCHEMA)).withColumn("norm_text", F.when(F.col("norm_text") != "", F.col("norm_text")))
    rows = [(i, s, e, t) for i, (s, e, t) in enumerate((s, e, t) for s in (None, 1, 2, 4, 9) for e in (None, 0, 1, 2, 4, 9) for t in ("علم حرم", "عدل نهو حرم", "", None, "جدح"))]
    hyp = spark.createDataFrame(rows, "id int, surah int, expected int, norm string")
    spans = corpus.spans(ref, 3)
    for get in (lambda fixed: match.verses(hyp, ref, ["id"], 1, 2, fixed=fixed), lambda fixed: match.sequences(hyp, spans, ["id"], 1, 2, fixed=fixed)):
        want, got = ({r["id"]: r for r in get(fixed).collect()} for fixed in (False, True))
        assert got == want and len(want) > 30


def test_ranker_takes_ratios_only_of_what_may_win(monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choice("ابتثجحدرس") for _ in range(r.randint(2, 7))) for _ in range(60)]
    verses = [" ".join(r.choice(words) for _ in range(9)) for _ in range(50)]
    at = {w: np.array([i for i, v in enumerate(verses) if w in v.split()]) for w in {w for v in verses for w in v.split()}}
    ranker = k.Ranker(verses, {w: (x, np.full(len(x), 1 / len(x))) for w, x in at.items()}, {w: 1 / len(x) for w, x in at.items()})
    texts = [v[:-3] + "ابز" for v in verses]
    pairs, init = [], k._Windows.__init__
    monkeypatch.setattr(k._Windows, "__init__", lambda self, p, *rest: pairs.extend(p) or init(self, p, *rest))
    assert [[x[0] for x in f] for f in ranker.best([(t, t.split()) for t in texts], np.zeros(50, int))] == [[i] for i in range(50)]
    assert len(pairs) < 50 * 30 / 4


def test_rules_normalize_a_text_once(spark):
    df = spark.createDataFrame([("a",)], "t string")
    plans = [df.select(x.alias("x"))._jdf.queryExecution().analyzed().toString() for x in (tx.fix_rules(F.col("t")), tx.normalize(F.col("t")))]
    assert [p.count("regexp_replace") for p in plans] == [3, 3]


def test_equal_uploads_are_worked_on_once(spark, monkeypatch):
    ref = corpus.reference(spark.createDataFrame(VERSES, SCHEMA))
    rows = [("a", 1, 2, "عدل نهو"), ("b", 1, 2, "عدل نهو"), ("c", None, None, "جدح علم"), ("d", None, None, "جدح علم"), ("e", 1, 2, "جدح علم"), ("f", 1, 1, None), ("g", 1, 1, None)]
    df = spark.createDataFrame(rows, "k string, surah int, expected int, raw string")
    alone = [pipeline.upload(df.where(F.col("k") == x[0]), "k", ref).collect() for x in (rows[0], rows[4])]
    seen, own = [], guard.guard
    monkeypatch.setattr(guard, "guard", lambda texts, *a, **b: seen.append(texts.count()) or own(texts, *a, **b))
    got = {r["k"]: tuple(r)[1:] for r in pipeline.upload(df, "k", ref).collect()}
    assert seen == [4] and set(got) == set("abcdefg") and got["a"] == got["b"] == tuple(alone[0][0])[1:] and got["c"] == got["d"] and got["e"] == tuple(alone[1][0])[1:] and got["f"] == got["g"]


def test_beginnings_are_those_of_the_regrouped_paths(spark):
    ref = corpus.reference(spark.createDataFrame(VERSES, SCHEMA))
    texts = ["علم حرم عدل علم نهو حرم حرم", "جدح", "زز", "", "علم حرم علم حرم علم حرم علم حرم"]
    q = spark.createDataFrame([(i, t, t.split()) for i, t in enumerate(texts)], "q int, norm string, words array<string>")
    paths = retrieve.viterbi(q, "q", ref, online=True)
    first = retrieve.aligned(paths, q, "q").groupBy("q").agg(F.min(F.struct("at", "global_idx", "confidence")).alias("p"))
    assert {r["q"]: (r["global_idx"], r["confidence"]) for r in retrieve.beginnings(q, "q", ref).collect()} == {r["q"]: tuple(r["p"])[1:] for r in first.collect()}
