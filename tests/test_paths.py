"""The path search over arrays: the same as by the definition, step by step."""

import random

import pytest

from rasm import kernels as k


def plain(emissions, surah, fixed, first, beam=30):
    back = []
    for t, cand in enumerate(emissions):
        own = dict(cand)
        if t == 0:
            now = {v: (s, None) for v, s in own.items()} or {0: (0.0, None)}
        else:
            for v in back[-1]:
                for w in (v, v + 1):
                    if w < len(surah):
                        own.setdefault(w, 0.0)
            now = {}
            for v, s in own.items():
                score, prev = max((p[0] + k.transition(u, v, surah, first, fixed), -u) for u, p in back[-1].items())
                now[v] = (score + s, -prev)
        back.append(dict(sorted(now.items(), key=lambda x: (-x[1][0], x[0]))[:beam]))
    v, path = min(back[-1], key=lambda x: (-back[-1][x][0], x)), []
    for step, raw in zip(reversed(back), reversed(emissions)):
        path.append((v, dict(raw).get(v, 0.0)))
        v = step[v][1]
    return path[::-1]


def test_path_is_the_plain_one_and_steps_are_not_taken_pair_by_pair(monkeypatch):
    r = random.Random(5)
    surah = sorted(r.choice(range(1, 9)) for _ in range(90))
    first = [i == 0 or surah[i] != surah[i - 1] for i in range(90)]
    cases = [[sorted(((v, r.randint(1, 8) / 8) for v in r.sample(range(90), r.choice([0, 1, 5, 25]))), key=lambda x: -x[1]) for _ in range(r.choice([1, 2, 12]))] for _ in range(60)]
    want = [[plain(e, surah, fixed, first, beam) for fixed, beam in ((False, 30), (True, 30), (False, 3))] for e in cases]

    def never(*_):
        raise AssertionError("a pair of its own")

    monkeypatch.setattr(k, "transition", never)
    for e, (a, b, c) in zip(cases, want):
        assert k.viterbi(e, surah, first=first) == a and k.viterbi(e, surah, True, first=first) == b and k.viterbi(e, surah, beam=3, first=first) == c


@pytest.mark.parametrize("within", [0.0, 0.1, 0.4])
def test_windows_together_are_as_each_alone(within):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(1, 6))) for _ in range(40)]
    verses = [" ".join(r.choice(words) for _ in range(r.choice([1, 2, 8, 30]))) for _ in range(70)]
    grams = lambda w: {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(max(1, len(w) - n + 1))}

    def plain(w, cand):
        mine = grams(w)
        score = lambda v: 0.6 * (len(mine & grams(verses[v].split())) / len(mine)) + 0.4 * (k.indel_ratio(" ".join(w), verses[v]) / 100)
        x = sorted(((v, score(v)) for v in cand or range(70) if cand or set(w) & set(verses[v].split())), key=lambda y: -y[1])
        x = [y for y in x if y[1] > 0]
        return x[:20] + [y for y in x[20:] if y[1] > x[19][1] - within]

    windows = [([r.choice([*words, "zz"]) for _ in range(r.choice([1, 5, 5, 30]))], r.choice([None, [], r.sample(range(70), 25)])) for _ in range(80)]  # 30 words: above 64 letters
    got = k.emitter(verses, within=within).many(windows)
    assert [[v for v, _ in x] for x in got] == [[v for v, _ in plain(*w)] for w in windows]
    assert all(s == pytest.approx(t) for x, w in zip(got, windows) for (_, s), (_, t) in zip(x, plain(*w)))
