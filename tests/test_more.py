"""Operators without SQL on small fixtures: against brute force, or known by construction."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rasm import kernels as k
from rasm.functions import columns as col
from rasm.operators import align, corpus, guard, pipeline, report, retrieve, windows

VERSES = [(s, a, t) for s, ts in {1: ["ابت جدح درس", "علم نهو", "يحب ثمر سلم كتب"], 2: ["جدح علم", "درس كتب نهو ابت"], 3: ["حرم عدل"]}.items() for a, t in enumerate(ts, 1)]


@pytest.fixture
def ref(spark):
    return corpus.reference(spark.createDataFrame(VERSES, "surah int, ayah int, text string"))


def queries(spark, texts):
    return spark.createDataFrame([(f"q{i}", t, t.split()) for i, t in enumerate(texts)], "q string, norm string, words array<string>")


def test_better_of_two_annotations():
    ref = "aaaa bbbb cccc".split()
    first, second = k.annotate("aaax cccc zz".split(), ref, None), k.annotate("aaaa bbbb".split(), ref, None)
    got = k.best_of(first, second)
    assert [(x["status"], x["ref_index"]) for x in got if x["ref_index"] is not None][:2] == [("correct", 0), ("correct", 1)]
    same = k.best_of(first, first)
    assert sorted(map(str, same)) == sorted(map(str, first))


def test_phrases_that_are_wrong():
    assert k.wrong_phrases(["correct", "major", "extra", "minor", "missing"], ["a", "b", "c", "d", None]) == [("b c", 1, 2), ("", 4, 4)]
    assert k.wrong_phrases([], []) == []


def test_vowels_of_the_other_word():
    assert align.inject_vowels("بت", "بَتُ") == "بَتُ" and align.inject_vowels("بت", "بتث") == "بت" and align.inject_vowels("بت", "بَتث") == "بَتث"


def test_messages_never_have_null_arrays(spark):
    df = spark.createDataFrame([("s", 1, None, None), ("s", 2, "x", [("a", "b")])], "session_id string, chunk_index int, raw_asr string, word_errors array<struct<word: string, status: string>>").withColumn("path", F.lit("p"))
    got = [json.loads(r["message"]) for r in guard.messages(df).orderBy(F.get_json_object("message", "$.chunk_index")).collect()]
    assert got[0] == {"type": "chunk", "chunk_index": 1, "raw_asr": None, "word_errors": [], "path": "p"} and got[1]["word_errors"] == [{"word": "a", "status": "b"}]
    assert guard.rows_for_display(df.withColumn("start_time_s", F.lit(1.006))).first()["chunk"].asDict().keys() == {"chunk_index", "raw_asr", "word_errors", "start_time_s"}


def test_reports_are_written(spark, tmp_path):
    lines = spark.createDataFrame([("b", "2", "y"), ("a", "1", "x")], "section string, name string, line string")
    report.write_report(lines, str(tmp_path / "r"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "r/text")).collect()] == ["a\t1\tx", "b\t2\ty"]
    assert spark.read.json(str(tmp_path / "r/json")).count() == 2 and spark.read.csv(str(tmp_path / "r/csv"), header=True).columns == ["section", "name", "line"]
    cells = spark.createDataFrame([], "true_label string, pred_label string, n long")
    assert report.class_report(cells).count() == 0


def test_rerank_is_brute_force(spark, ref):
    r = random.Random(1)
    words = sorted({w for _, _, t in VERSES for w in t.split()})
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 5))) for _ in range(20)] + ["زز", ""]
    n = len(VERSES)
    df = Counter(w for _, _, t in VERSES for w in set(t.split()))
    idf = {w: math.log((n - d + 0.5) / (d + 0.5) + 1) for w, d in df.items()}
    mean = sum(len(t.split()) for _, _, t in VERSES) / n

    def bm25(q, t):
        tf = Counter(t.split())
        return round(sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t.split()) / mean)) for w in q.split() if w in tf), 6)

    got = {(x["q"], x["surah"]): x["score"] for x in retrieve.rerank(queries(spark, texts), "q", ref).collect()}
    for i, q in enumerate(texts):
        perfect = sum(idf.get(w, 0.0) for w in set(q.split()))
        best: dict[int, float] = {}
        for s, _, t in VERSES:
            b = min(1.0, bm25(q, t) / perfect) if perfect else 0.0
            best[s] = max(best.get(s, 0.0), 0.4 * b + 0.6 * k.partial_ratio(q, t) / 100)
        for s, x in best.items():
            assert got[f"q{i}", s] == pytest.approx(x, abs=2e-6), (q, s)


def test_sessions_regrouped_by_verse(spark, ref):
    text = VERSES[0][2] + " " + VERSES[1][2] + " " + VERSES[2][2]
    q = queries(spark, [text, "", "زز"])
    paths = retrieve.viterbi(q, "q", ref, online=True)
    got = retrieve.aligned(paths, q, "q").orderBy("q", "at").collect()
    own = [x for x in got if x["q"] == "q0"]
    assert " ".join(x["words"] for x in own) == text and [x["global_idx"] for x in own] == sorted(x["global_idx"] for x in own) and own[0]["global_idx"] == 0
    assert all(0 <= x["confidence"] <= 100 and (x["level"] == "high") == (x["confidence"] > 75) for x in got)
    two = queries(spark, ["جدح علم حرم عدل"])
    assert {x["global_idx"] for x in retrieve.viterbi(two, "q", ref, locked=2).collect()} <= {3, 4}
    assert {x["global_idx"] for x in retrieve.viterbi(two, "q", ref, locked=3).collect()} == {5}


def test_keys_that_clash(spark, ref):
    df = spark.createDataFrame([(1, 1, 1, "a")], "verse int, surah int, expected int, raw string")
    with pytest.raises(ValueError):
        guard.guard(df, ref, None, ["verse"])


def test_uploads(spark, ref):
    df = spark.createDataFrame([("a", 1, 2, "علم نهو"), ("b", None, None, "حرم عدل"), ("c", 2, 1, None)], "k string, surah int, expected int, raw string")
    got = {r["k"]: r for r in pipeline.upload(df, "k", ref).collect()}
    assert (got["a"]["guard_surah"], got["a"]["guard_ayah"], got["a"]["verdict"], got["a"]["path_verse"], got["a"]["surah"]) == (1, 2, "ok", 1, 1)
    assert (got["b"]["guard_surah"], got["b"]["guard_ayah"], got["b"]["surah"]) == (3, 1, 3) and got["c"]["verdict"] == "error" and got["c"]["path_verse"] is None


def test_small_columns(spark):
    df = spark.createDataFrame([("LISTENING", 0.5, 0.0, [[1.0, 2.0]]), ("VERIFYING", 0.49, 0.4, None)], "fsm string, p double, o double, x array<array<float>>")
    a, b = df.select(pipeline.bounds(F.col("fsm")).alias("b"), windows.rule_result(F.col("p")).alias("r"), windows.frames(F.col("x"), 2, 2).alias("f"), col.emission(F.col("o"), F.lit(1.0)).alias("e"), col.emission(F.col("o"), F.lit(1.0), F.lit(0.5)).alias("lm"), col.silent(F.col("o")).alias("s")).collect()
    assert tuple(a["b"]) == (5, 10, 8) and tuple(b["b"]) == (0, 0, 1) and tuple(a["r"]) == (True, 50.0) and tuple(b["r"]) == (False, 49.0)
    assert a["f"] == [[1.0, 2.0], [0.0, 0.0]] and b["f"] == [[0.0, 0.0]] * 2 and a["e"] == 0.0 and b["e"] == pytest.approx(0.64) and b["lm"] == pytest.approx(0.57) and (a["s"], b["s"]) == (True, False)
