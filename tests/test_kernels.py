from hypothesis import given, settings
from hypothesis import strategies as st

from rasm import kernels as k

words = st.lists(st.sampled_from(["a", "b", "cc", "dd"]), max_size=7)
text = st.text("abc ", max_size=14)


def plain_lcs(a, b):
    if not a or not b:
        return 0
    return 1 + plain_lcs(a[1:], b[1:]) if a[0] == b[0] else max(plain_lcs(a[1:], b), plain_lcs(a, b[1:]))


@settings(max_examples=80, deadline=None)
@given(words, words)
def test_lcs_and_edits(a, b):
    assert k.lcs_length(a, b) == plain_lcs(tuple(a), tuple(b))
    assert k.levenshtein(a, b) == k.levenshtein(b, a)
    ops = k.edits(a, b)
    assert sum(max(i2 - i1, j2 - j1) for t, i1, i2, j1, j2 in ops if t != "equal") == k.levenshtein(a, b)
    assert [x for _, i1, i2, _, _ in ops for x in a[i1:i2]] == a
    assert [x for _, _, _, j1, j2 in ops for x in b[j1:j2]] == b


@settings(max_examples=80, deadline=None)
@given(text, text)
def test_partial_ratio(a, b):
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    n = len(s)
    want = max((k.indel_ratio(s, t[max(0, i) : i + n]) for i in range(1 - n, len(t))), default=0.0) if n else 0.0
    assert abs(k.partial_ratio(a, b) - want) < 1e-9


def test_annotate():
    got = k.annotate("الحمد لله رب العلمين".split(), "الحمد لله رب العالمين".split(), None)
    assert [x["status"] for x in got] == ["correct", "correct", "correct", "minor"]
    got = k.annotate("املك يوم".split(), "مالك يوم الدين".split(), 0.9)
    assert [x["status"] for x in got] == ["minor", "correct", "missing"]
    assert {x["status"] for x in k.annotate(["x"], ["x"], 0.1)} == {"uncertain"}
    assert k.annotate([], [], None) == []


def test_lock():
    lock = k.Lock()
    assert lock.update(5, 0.5, 0.2) == ("INACTIVE", None)
    assert lock.update(5, 0.4, 0.2) == ("ACTIVE", 5)
    assert [lock.update(s, 0.4, 0.1)[0] for s in (6, 6, 6)] == ["ACTIVE", "ACTIVE", "INACTIVE"]
    assert k.Lock().update(None, None, None) == ("INACTIVE", None)


def test_correction():
    f = k.Correction()
    assert f.update("ok", 0.9, []) == "continue"
    assert f.update("minor", 0.9, []) == "warn"
    assert f.update("error", 0.2, ["x"]) == "warn"
    assert f.update("error", None, ["x"], place=7) == "pause" and f.attempts == 0
    assert f.update("error", 0.9, ["x"]) == "wait"
    assert f.update("error", 0.9, ["x"], 1) == "retry" and f.attempts == 1
    assert f.update("error", 0.9, ["x"], 1) == "wait"  # the end of an older playback
    assert f.update("error", 0.1, ["x"], 2) == "continue" and f.state == "VERIFYING"
    assert f.update("ok", 0.9, []) == "verified"
    assert f.state == "LISTENING" and f.history == [{"kind": "word", "at": 7, "words": ["x"], "attempts": 1, "resolved": True}]
    assert f.update("ok", 0.9, [], vowels=["a", "b"]) == "pause" and f.kind == "vowels"
    assert f.update("error", 0.9, ["z"], f.number, vowels=["b", "c"]) == "retry" and f.words == ["b"]
    assert f.update("error", 0.9, ["z"], f.number) == "verified" and f.kind == "word" and len(f.history) == 2


def test_pending_words_that_are_heard():
    f = k.Correction()
    f.update("error", 1.0, ["abcd efgh", "ij"])
    assert not f.hear("zz".split()) and f.words == ["abcd efgh", "ij"]
    assert not f.hear("abxd".split()) and f.words == ["efgh", "ij"]
    assert f.hear("q efgh ij".split()) and f.words == []
    assert not f.hear(["abcd"])
    assert k.close_said("abcdefg", "abxdxfg") and not k.close_said("abcdef", "abxdxf") and not k.close_said("ab", "ac")


def test_viterbi_follows_order():
    path = k.viterbi([[(3, 0.9), (0, 0.8)], [(1, 0.5), (4, 0.5)], [(5, 0.7)]], [1, 1, 1, 2, 2, 2])
    assert [v for v, _ in path] == [3, 4, 5]
    assert k.viterbi([], [1]) == []


def test_boundaries():
    v = {"الرحيم", "الحمد", "ال"}
    assert k.recover_boundaries(["الرحيمالحمد"], v) == ["الرحيم", "الحمد"]
    assert k.recover_boundaries(["الرح", "يم"], v) == ["الرحيم"]
    assert k.recover_boundaries([], v) == []


def test_overlap():
    assert k.overlap("a bb cc".split(), "bb cc dd".split()) == 2
    assert k.overlap([], ["a"]) == 0


def test_long_audio_is_cut_where_it_is_quiet():
    import numpy as np

    x = np.ones(40_000, np.float32)
    x[15_050:15_120] = 0.0
    got = k.split_long(x, rate=1000)
    assert got[0][1] in range(15_050, 15_072) and all(b == c for (_, b), (c, _) in zip(got, got[1:])) and got[-1][1] == 40_000
    assert k.split_long(x[:15_000], rate=1000) == [(0, 15_000)] and k.split_long(x[:0], rate=1000) == [(0, 0)]
    assert k.split_long(np.zeros(16_000, np.float32), rate=1000) == [(0, 14_700)]  # the rest is under 1.5 s


def test_lock_of_a_path():
    surah = [1] * 5 + [2] * 5
    lock = k.PathLock()
    assert [lock.update([(6, 0.9), (1, 0.5)], surah) for _ in range(3)] == [None, None, 2]
    assert lock.update([(6, 0.5)], surah) == 2 and lock.update([], surah) == 2  # let go by a window with nothing, and locked again by the history
    lock = k.PathLock()
    for _ in range(4):
        lock.update([(6, 0.9)], surah)
    assert lock.locked == 2 and [lock.update([(1, 0.9)], surah) for _ in range(3)] == [2, 2, 1]
    assert k.PathLock().update([(6, 0.9), (1, 0.8)], surah) is None


def test_locked_and_started_paths():
    surah, e = [1, 1, 1, 2, 2, 2], [[(0, 0.8), (3, 0.7)], [(1, 0.5), (4, 0.45)]]
    assert [v for v, _ in k.viterbi(e, surah)] == [0, 1]
    assert [v for v, _ in k.viterbi(e, surah, 2)] == [3, 4] and [v for v, _ in k.viterbi(e, surah, start=2)] == [3, 4]
    assert [s for _, s in k.viterbi(e, surah, 2)] == [0.7, 0.45]  # emissions as they are
    steps = [[(3, 0.95), (0, 0.1)]] * 4 + [[(1, 0.5), (4, 0.35)]]
    assert k.viterbi(steps, surah, online=True)[-1][0] == 4
    first = [True, False, False, True, False, False]
    assert k.transition(2, 3, surah, first, True) == -1.0 and k.transition(5, 0, surah, first, True) == -1.0 and k.transition(1, 3, surah, first, True) == -10.0 and k.transition(2, 4, surah, first, False) == -2.0


def test_emitter_keeps_what_a_lock_may_lift():
    import random

    r = random.Random(4)
    verses = [" ".join(r.choice("abcdefgh") * 2 for _ in range(r.randint(2, 6))) for _ in range(60)]
    few, more, every = k.emitter(verses, 5), k.emitter(verses, 5, 0.1), k.emitter(verses, 60)
    for _ in range(30):
        w = [r.choice("abcdefgh") * 2 for _ in range(5)]
        a, b, c = few(w, None), more(w, None), every(w, None)
        assert a == c[:5] and b == c[:5] + [x for x in c[5:] if x[1] > c[4][1] - 0.1]
        some = list(range(0, 60, 2))
        assert few(w, some) == every(w, some)[:5] and set(more(w, some)) >= set(few(w, some))


def test_words_that_heal():
    ref = "abcd efgh ijkl".split()
    a = k.heard_statuses("abcx zzzz".split(), ref, [None] * 3)
    assert a == ["correct", "wrong", None]
    b = k.heard_statuses("efgh".split(), ref, a, {"efgh"})
    assert b == ["correct", "harakaat", None] and k.heard_statuses(ref, ref, b) == ["correct"] * 3
    assert k.heard_statuses([], ref, a) == a and k.heard_statuses(["x"], [], []) == []
