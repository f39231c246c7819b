import re

from pyspark.sql import functions as F

from rasm import kernels as k
from rasm.functions import metrics as m
from rasm.functions import text as tx
from rasm.operators import align, evaluate, windows


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_normalize(spark):
    s = chr(0x645) + chr(0x64E) + chr(0x640) + chr(0x627) + "  x" + chr(0xA0) + "A!" + chr(0x628)
    assert one(spark, tx.normalize(F.lit(s)), tx.normalize(F.lit(s), strict=True), tx.normalize(F.lit(None).cast("string"))) == ["ما A ب", "ما ب", ""]
    assert sum(bool(re.match(f"[{tx.MARKS}]", chr(i))) for i in range(0x600, 0x700)) == 52
    assert one(spark, tx.normalize_for_eval(F.lit("إلى، رحمة!")))[0] == "الي رحمه"


def test_words(spark):
    t = tx.tokens(F.lit("a a b a a b"))
    got = one(spark, tx.collapse_repeats(t), tx.tile(t), tx.longest_run(t), tx.ngrams(t, 3), tx.ngrams(tx.tokens(F.lit("a b")), 3), tx.ngrams(tx.tokens(F.lit("")), 2), tx.tile(tx.tokens(F.lit(""))))
    assert got == [["a", "b", "a", "b"], ["a", "a", "b"], 2, ["a a b", "a b a", "b a a", "a a b"], ["a b"], [], []]


def test_rates(spark):
    pairs = [("a b c", "a x c"), ("", "a"), ("a", ""), ("a a b", "a b b b"), ("نعم لا", "نعم")]
    for h, r in pairs:
        a, b = h.split(), r.split()
        got = one(spark, m.cer(F.lit(h), F.lit(r)), m.word_rate(F.lit(h), F.lit(r)), m.coverage(tx.tokens(F.lit(h)), tx.tokens(F.lit(r))))
        want = [k.levenshtein(h, r) / len(r) if r else 1.0, k.levenshtein(a, b) / len(b) if b else 1.0, k.coverage(a, b)]
        assert all(abs(x - y) < 1e-12 for x, y in zip(got, want)), (h, r, got, want)


def test_thresholds(spark):
    assert one(spark, m.level(F.lit(0.41), F.lit(3)), m.level(F.lit(0.41), F.lit(6)), m.level(F.lit(0.41), F.lit(30))) == ["high", "medium", "low"]


def test_marks(spark):
    fatha, kasra = chr(0x64E), chr(0x650)
    a, b = "ب" + fatha + "ت", "ب" + kasra + "ت"
    assert one(spark, tx.differing_marks(F.lit(a), F.lit(b)), tx.differing_marks(F.lit(a), F.lit("ب"))) == [[0], []]
    assert one(spark, *evaluate.word_verdict(F.lit(a), F.lit(b), F.lit(False))) == ["correct", "incorrect"]
    assert one(spark, *evaluate.word_verdict(F.lit(a), F.lit("ج"), F.lit(False))) == ["incorrect", "not_applicable"]


def test_vowel_check():
    ref = "الرَّحْمَنِ الرَّحِيمِ"
    assert align.check_vowels(ref, ref)["harakaat"] == 0
    assert align.check_vowels("الرَّحْمَنُ الرَّحِيمِ", ref)["harakaat"] == 1
    assert align.check_vowels("الرَّحْمَنِ الرَّحِيمَ", ref)["harakaat"] == 0  # the end of the last word
    assert align.check_vowels("الرَّجْمَنِ الرَّحِيمِ", ref)["makhraj"] == 1
    assert align.check_vowels("x", "")["reason"] == "no_reference"
    assert align.check_vowels("x", "x")["reason"] == "reference_not_diacritized"


def test_merge():
    known = {"لله"}.__contains__
    words, voweled = align.merge_engines("الحمد للة", "الحَمد لله", None, known)
    assert (words, voweled.split()[0]) == ("الحمد لله", "الحَمد")
    assert align.merge_engines("", "", None, known) == ("", "")
    assert align.merge_engines("a x", "b c", "a c", known)[0] == "a c"


def test_windows(spark):
    hops = one(spark, windows.hopping(F.lit(100), 50, 35, 10), windows.hopping(F.lit(0), 50, 35, 10))
    assert [(w["start"], w["end"]) for w in hops[0]] == [(0, 50), (35, 85), (70, 100)] and hops[1] == []
    seg = F.array(F.array(F.lit(0), F.lit(1), F.lit(30), F.lit(740)), F.array(F.lit(1), F.lit(2), F.lit(750), F.lit(900)), F.array(F.lit(5), F.lit(6), F.lit(1000), F.lit(1200)))
    got = one(spark, windows.segment_range(seg, F.lit(0), F.lit(1)), windows.rms(F.array(F.lit(3.0), F.lit(4.0))), windows.gate(F.lit(2.0), F.lit(0.001)))
    assert (got[0]["start_ms"], got[0]["end_ms"]) == (30, 900) and abs(got[1] - 12.5**0.5) < 1e-12 and got[2] == "skipped"
