"""What an index or a band leaves out is searched for in the whole corpus."""

from rasm import kernels as k
from rasm.operators import corpus, guard, match, retrieve

VERSES = [(1, 1, "الحمد لله رب العالمين"), (1, 2, "الرحمن الرحيم"), (1, 3, "مالك يوم الدين"), (2, 1, "الم"), (2, 2, "ذلك الكتاب لا ريب فيه هدى للمتقين"), (2, 3, "الذين يؤمنون بالغيب"), (2, 4, "يوم لا ريب فيه"), (3, 1, "الرحمن"), (3, 2, "علم القرآن خلق الإنسان")]


def _ref(spark):
    return corpus.reference(spark.createDataFrame(VERSES, "surah int, ayah int, text string"))


def scan(words, verses, most):
    """Index or else every verse, as it is written in the reference."""
    grams = lambda w: {g for n in (1, 2, 3) for g in ([" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)])}
    mine, hits = grams(words), {}
    for v, text in enumerate(verses):
        t = text.split()
        for n in (2, 3):
            for i in range(len(t) - n + 1):
                if " ".join(t[i : i + n]) in mine:
                    hits[v] = hits.get(v, 0) + n
    some = sorted(hits, key=lambda v: (-hits[v], v))[:30] or range(len(verses))
    score = lambda v: 0.6 * (len(mine & grams(verses[v].split())) / len(mine)) + 0.4 * (k.indel_ratio(" ".join(words), verses[v]) / 100) if mine & grams(verses[v].split()) else 0.0
    return [(v, s) for v, s in sorted(((v, score(v)) for v in some), key=lambda x: -x[1])[:most] if s > 0]


def test_windows_without_an_index_hit_see_every_verse(spark):
    ref = _ref(spark)
    rows = ref.orderBy("global_idx").collect()
    verses = [r["norm_text"] for r in rows]
    texts = ["يوم ريب خلق", "الرحمن", "الم", "ريب", "كلام اخر هنا", "الحمد لله رب", "فيه يوم هدى لا علم الرحمن خلق مالك", "رب يوم الم ذلك الكتاب لا ريب فيه"]
    words = lambda t: corpus.tx.tokens(corpus.tx.normalize(t)).alias("words")
    q = spark.createDataFrame(list(enumerate(texts)), "q int, text string").select("q", words(retrieve.F.col("text")))
    want = []
    for r in q.collect():
        steps = [scan(r["words"][i : i + 5], verses, 20) for i in range(0, len(r["words"]), 3)]
        want += [(r["q"], t, v, s) for t, (v, s) in enumerate(k.viterbi(steps, [x["surah"] for x in rows]))]
    got = sorted(tuple(x) for x in retrieve.viterbi(q, "q", ref).collect())
    assert got == sorted(want)
    assert (1, 0, 7, 1.0) in got  # one word has no 2-gram


def test_bounds_lose_no_verse():
    import random

    rnd = random.Random(1)
    verses = [" ".join(rnd.choice("ab abc bca cd da e fgh abcd".split()) for _ in range(rnd.randint(1, 9))) for _ in range(200)]
    of = k.emitter(verses, 5)
    for _ in range(200):
        w = [rnd.choice("ab abc e zz da".split()) for _ in range(rnd.randint(1, 5))]
        every = [(v, s) for v, s in of(w, list(range(200)))]
        assert of(w, None) == every


def test_verse_without_a_chapter_is_found_in_the_corpus(spark):
    ref = _ref(spark)
    rows = ref.orderBy("global_idx").collect()
    texts = ["علم القران خلق", "يوم لا ريب", "ذلك الكتاب لا ريب فيه هدى", "الرحمن", "كلام", "", "يوم لا ريب"]
    hyp = spark.createDataFrame([(i, None, None, t) for i, t in enumerate(texts)] + [(90, 1, 2, "الرحمن"), (91, 9, 1, "الرحمن")], "id int, surah int, expected int, norm string")
    hyp = hyp.withColumn("norm", corpus.tx.normalize(retrieve.F.col("norm")))
    got = {r["id"]: r for r in match.verses(hyp, ref, ["id"]).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 6, 90]
    for r in hyp.where("surah is null").collect():
        def key(v):
            cer, cov = k.levenshtein(r["norm"], v["norm_text"]) / len(v["norm_text"]), k.coverage(r["norm"].split(), v["tokens"])
            return cer, -cov, -max(0.0, min(1.0, 0.65 * (1 - cer) + 0.35 * cov)), v["global_idx"]
        b = min(rows, key=key)
        assert (got[r["id"]]["surah"], got[r["id"]]["ayah"], got[r["id"]]["cer"]) == (b["surah"], b["ayah"], key(b)[0])
    assert (got[90]["surah"], got[90]["ayah"]) == (1, 2)  # a chapter that is known stays


def test_guard_without_a_chapter(spark):
    ref = _ref(spark)
    hyp = spark.createDataFrame([(0, None, None, VERSES[4][2]), (1, None, None, ""), (2, 2, 2, VERSES[4][2])], "id int, surah int, expected int, raw string")
    for spans in (None, corpus.spans(ref, 3)):
        got = {r["id"]: r for r in guard.guard(hyp, ref, spans, ["id"]).collect()}
        assert [got[0][x] for x in ("surah", "first_ayah", "cer", "verdict", "is_sequence")] == [2, 2, 0.0, "ok", False]
        assert got[2]["surah"] == 2 and got[2]["verdict"] == "ok"
        assert (got[1]["surah"], got[1]["first_ayah"]) == ((1, 1) if spans is None else (None, None)) and got[1]["verdict"] == "error"


def test_bounds_lose_no_nearest_verse(spark):
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(2)
    verses = ["".join(rnd.choice("abcde ") for _ in range(rnd.randint(0, 90))) for _ in range(60)]
    texts = ["".join(rnd.choice("abcdxz ") for _ in range(n)) for n in [0, 1, 5, 40, 63, 64, 65, 120]]
    near = [{"i": i, "norm_text": v} for i, v in enumerate(verses)]
    df = spark.createDataFrame([(t, near) for t in texts], "norm string, near array<struct<i: int, norm_text: string>>")
    for row in df.select("norm", match.closest(F.col("norm"), F.col("near")).alias("few")).collect():
        cer = [k.levenshtein(row["norm"], v) / len(v) if v else 1.0 for v in verses]
        assert [x["x"]["i"] for x in row["few"]] == [i for i, x in enumerate(cer) if x == min(cer)]
        assert {x["cer"] for x in row["few"]} == {min(cer)}
