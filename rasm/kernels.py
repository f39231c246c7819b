"""Sequence kernels without Spark: distances, alignments, path search. Batch folds and stream processors share them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Hashable, Sequence
from decimal import ROUND_HALF_UP, Decimal
from difflib import SequenceMatcher
from heapq import heappush, heapreplace

import numpy as np

Op = tuple[str, int, int, int, int]


def lcs_length(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    if not a or not b:
        return 0
    at: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def indel_ratio(a: Sequence[Hashable], b: Sequence[Hashable]) -> float:
    """200 x LCS / (len a + len b), 100 for two empty sequences."""
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best indel_ratio of the shorter text with a window of its length (or a cut one at either edge) of the longer.

    The common subsequences with all windows are found together, with bit vectors of 64 letters a word."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    if not n:
        return 0.0
    if short in long:
        return 100.0
    windows, words = len(long) + n - 1, (n + 63) // 64
    at: dict[str, int] = {}
    for i, x in enumerate(short):
        at[x] = at.get(x, 0) | 1 << i
    low = (1 << 64) - 1
    masks = np.zeros((words, len(long) + 2 * n - 2), np.uint64)  # a letter outside matches nothing
    for w in range(words):
        masks[w, n - 1 : n - 1 + len(long)] = [at.get(x, 0) >> 64 * w & low for x in long]
    v = np.full((words, windows), low, np.uint64)
    for k in range(n):
        carry: np.ndarray | None = None
        for w in range(words):
            own = v[w]
            u = own & masks[w, k : k + windows]
            s = own + u
            if words > 1:
                over = s < u
                if carry is not None:
                    s = s + carry
                    over = over | (s < carry)
                carry = over.astype(np.uint64)
            v[w] = s | (own - u)
    kept = np.array([((1 << n) - 1) >> 64 * w & low for w in range(words)], np.uint64)[:, None]
    common = n - np.bitwise_count(v & kept).astype(int).sum(axis=0)
    at_end = np.arange(1 - n, len(long))
    size = np.minimum(len(long), at_end + n) - np.maximum(0, at_end)
    return float((200.0 * common / (n + size)).max())


class Ranker:
    """BM25 and the partial ratio (see partial_ratio) of a text with the verses of a fixed corpus.

    weights: for each word the verses (ascending places) that have it, with what it adds to their score; idf: of each word."""

    STRIDE, TOGETHER = 8, 128

    def __init__(self, verses: list[str], weights: dict[str, tuple[np.ndarray, np.ndarray]], idf: dict[str, float]):
        self.verses, self.weights, self.idf = verses, weights, idf
        self.letter = {x: i for i, x in enumerate(sorted(set("".join(verses))), 1)}  # 0: matches nothing
        self.codes = [self._coded(v) for v in verses]
        self.bags = np.array([np.bincount(x, minlength=len(self.letter) + 1) for x in self.codes]).reshape(len(verses), len(self.letter) + 1)
        self.tables: dict[int, np.ndarray] = {}

    def _coded(self, text: str) -> np.ndarray:
        return np.array([self.letter.get(x, 0) for x in text], np.intp)

    def _table(self, codes: np.ndarray) -> np.ndarray:
        """Bit vectors of the places of each letter: [word of 64 places, letter]."""
        out = np.zeros((max(1, (len(codes) + 63) // 64), len(self.letter) + 1), np.uint64)
        at = np.arange(len(codes))
        np.bitwise_or.at(out, (at // 64, codes), np.uint64(1) << (at % 64).astype(np.uint64))
        out[:, 0] = 0
        return out

    def candidates(self, words: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, shares) of the k best verses by BM25 (rounded to 6 places, ties in order; those without a common word score 0), as
        shares of the score of a verse with each of the words."""
        score, hit = np.zeros(len(self.verses)), np.zeros(len(self.verses), bool)
        times = Counter(words)
        for w, n in times.items():
            if w in self.weights:
                at, add = self.weights[w]
                score[at] += n * add
                hit[at] = True
        score, some = np.round(score, 6), np.flatnonzero(hit)
        order = some[np.argsort(-score[some], kind="stable")[:k]]  # ties in order
        if len(order) < k:
            order = np.r_[order, np.flatnonzero(~hit)[: k - len(order)]]
        perfect = sum(self.idf.get(w, 0.0) for w in times)
        return order, np.minimum(1.0, score[order] / perfect) if perfect else np.zeros(len(order))

    def best(self, texts: list[tuple[str, list[str]]], group: np.ndarray, k: int = 30) -> list[list[tuple[int, float, float]]]:
        """For each text (with its words) (place, share, partial ratio / 100) of the best of its k candidates in each group, by
        0.4 x share + 0.6 x ratio (rounded to 6 places, ties in order). A ratio is taken only while the letters that both texts have may
        still let it win against the candidate for which they allow most, and in full only while its windows may: windows of a verse
        that lie d apart differ by d in their common letters at most."""
        out: list[list[tuple[int, float, float]]] = [[] for _ in texts]
        order = sorted(range(len(texts)), key=lambda i: len(texts[i][0]))
        for i in range(0, len(order), self.TOGETHER):  # alike in length
            some = order[i : i + self.TOGETHER]
            for j, x in zip(some, self._best([texts[j] for j in some], group, k)):
                out[j] = x
        return out

    def _best(self, texts: list[tuple[str, list[str]]], group: np.ndarray, k: int) -> list[list[tuple[int, float, float]]]:
        found = [self.candidates(w, k) for _, w in texts]
        text = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
        at, share = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        of = np.unique(text * (int(group.max(initial=0)) + 1) + group[at], return_inverse=True)[1]
        like = self._likes([t for t, _ in texts], text, at, share, of)
        final = 0.4 * share + 0.6 * like
        top = np.zeros(of.max(initial=-1) + 1)
        np.maximum.at(top, of, final)
        won: dict[int, int] = {}
        for i in np.flatnonzero(final >= top[of] - 2e-6).tolist():
            j = won.setdefault(int(of[i]), i)
            if i != j and (half_up(final[i]), -at[i]) > (half_up(final[j]), -at[j]):
                won[int(of[i])] = i
        out: list[list[tuple[int, float, float]]] = [[] for _ in texts]
        for i in won.values():
            out[text[i]].append((int(at[i]), float(share[i]), float(like[i])))
        return out

    def _likes(self, texts: list[str], text: np.ndarray, at: np.ndarray, share: np.ndarray, of: np.ndarray) -> np.ndarray:
        like = np.zeros(len(at))
        own = [self._coded(t) for t in texts]
        tables = [self._table(x) for x in own]
        bags = np.array([np.bincount(x, minlength=len(self.letter) + 1) for x in own]).reshape(len(own), len(self.letter) + 1)
        bags[:, 0] = 0
        common = np.minimum(bags[text], self.bags[at]).sum(1)
        n = np.minimum(np.array([len(x) for x in own], np.intp)[text], np.array([len(self.codes[v]) for v in at.tolist()], np.intp))
        most = 0.4 * share + 0.6 * np.where(n > 0, 2.0 * common / np.maximum(1, n + common), 0.0)  # of the window of just the common letters
        order = np.lexsort((-most, of))
        first = order[np.r_[True, of[order][1:] != of[order][:-1]][: len(order)]]
        low = np.zeros(of.max(initial=-1) + 1)  # what a candidate of the group has at least
        self._compare(first, texts, own, tables, text, at, share, of, low, like)
        may = most >= low[of] - 2e-6
        may[first] = False
        self._compare(np.flatnonzero(may), texts, own, tables, text, at, share, of, low, like)
        return like

    def _compare(self, which: np.ndarray, texts: list[str], own: list[np.ndarray], tables: list[np.ndarray], text: np.ndarray, at: np.ndarray, share: np.ndarray, of: np.ndarray, low: np.ndarray, like: np.ndarray) -> None:
        """Puts the ratios of the candidates `which` into `like`, and what their groups have by them into `low`."""
        runs: dict[int, list[tuple[int, int]]] = {}  # by the number of 64-bit words: (-shorter length, candidate)
        for i, q, v in zip(which.tolist(), text[which].tolist(), at[which].tolist()):
            a, b = texts[q], self.verses[v]
            n = min(len(a), len(b))
            if n and (b in a or a in b):
                like[i] = 1.0
            elif n:
                runs.setdefault((n + 63) // 64, []).append((-n, i))
        np.maximum.at(low, of[which], 0.4 * share[which] + 0.6 * like[which])
        laid = []
        for w in sorted(runs):
            pairs = []
            for n, i in sorted(runs[w]):
                q, v = int(text[i]), int(at[i])
                if len(own[q]) > len(self.codes[v]) and v not in self.tables:
                    self.tables[v] = self._table(self.codes[v])
                pairs.append((i, -n, self.codes[v], tables[q]) if len(own[q]) <= len(self.codes[v]) else (i, -n, own[q], self.tables[v]))
            laid.append(_Windows(pairs, w, self.STRIDE))
        for x in laid:
            np.maximum.at(low, of[x.who], 0.4 * share[x.who] + 0.6 * x.least / 100)
        for x in laid:
            x.refine((low[of[x.who]] - 2e-6 - 0.4 * share[x.who]) / 0.6 * 100)
            like[x.who] = x.least / 100
        np.maximum.at(low, of[which], 0.4 * share[which] + 0.6 * like[which])


class _Windows:
    """All windows of a text's pairs with some verses, laid one after the other, the pairs of the longest shorter text first. Every
    STRIDE-th is compared at once; `least` is the best ratio of each pair so far."""

    def __init__(self, pairs: list[tuple[int, int, np.ndarray, np.ndarray]], words: int, stride: int):
        """pairs: (number, letters of the shorter text, codes of the longer, bit vectors of the shorter)."""
        p = stride
        self.who, self.n = np.array([x[0] for x in pairs]), np.array([x[1] for x in pairs])
        longs, tables = [x[2] for x in pairs], [x[3] for x in pairs]
        self.size = np.array([len(x) for x in longs])
        # a pair's windows begin at a multiple of the stride; before and after the longer text n - 1 places match nothing
        room = -(-(self.size + 2 * self.n - np.r_[self.n[1:], 1]) // p) * p
        self.begin = np.r_[0, np.cumsum(room)]
        total = int(self.begin[-1])
        kind = np.uint32 if self.n[0] <= 32 else np.uint64
        tail = -(-int(self.n[0] + p) // p) * p
        self.masks = np.zeros((words, total + tail), kind)
        for b, n, long, t in zip(self.begin, self.n, longs, tables):
            self.masks[:, b + n - 1 : b + n - 1 + len(long)] = t[:, long]
        self.words, self.kind, self.p = words, kind, p
        phases = np.ascontiguousarray(self.masks.reshape(words, -1, p).transpose(2, 0, 1))
        ends = self.begin[1:] // p
        left = np.searchsorted(-self.n, -np.arange(int(self.n[0])), "left")  # pairs of a shorter text of more than k letters
        v = self._run(total // p, int(self.n[0]), lambda k: int(ends[left[k] - 1]), lambda k, m: phases[k % p][:, k // p : k // p + m])
        pair = np.repeat(np.arange(len(self.n)), room // p)
        self.coarse = self._common(v, pair)
        self.pair = pair
        local = np.arange(total // p) * p - self.begin[pair]
        self.least = np.maximum.reduceat(self._ratio(self.coarse, pair, local), self.begin[:-1] // p)

    def _run(self, count: int, steps: int, active: Callable[[int], int], masks: Callable[[int, int], np.ndarray]) -> np.ndarray:
        v = np.full((self.words, count), np.iinfo(self.kind).max, self.kind)
        u, s = np.empty(count, self.kind), np.empty(count, self.kind)
        for k in range(steps):
            m = active(k)
            mask = masks(k, m)
            carry: np.ndarray | None = None
            for w in range(self.words):
                own, a, b = v[w, :m], u[:m], s[:m]
                np.bitwise_and(own, mask[w], out=a)
                np.add(own, a, out=b)
                if self.words > 1:
                    over = b < a
                    if carry is not None:
                        b += carry
                        over |= b < carry
                    carry = over.astype(self.kind)
                np.subtract(own, a, out=own)
                np.bitwise_or(own, b, out=own)
        return v

    def _common(self, v: np.ndarray, pair: np.ndarray) -> np.ndarray:
        bits = np.clip(self.n - 64 * np.arange(self.words)[:, None], 0, 64).astype(np.uint64)
        kept = np.where(bits > 63, np.uint64((1 << 64) - 1), (np.uint64(1) << (bits & np.uint64(63))) - np.uint64(1)).astype(self.kind)
        return self.n[pair] - np.bitwise_count(v & kept[:, pair]).astype(int).sum(axis=0)

    def _ratio(self, common: np.ndarray, pair: np.ndarray, local: np.ndarray) -> np.ndarray:
        n, long = self.n[pair], self.size[pair]
        end = local + 1  # of the window in the longer text
        size = np.minimum(long, end) - np.maximum(0, end - n)
        return np.where(size > 0, 200.0 * common / (n + np.maximum(size, 0)), 0.0)

    def refine(self, least: np.ndarray) -> None:
        """Compares the windows between that may have more than `least`, and more than what their pair has."""
        p = self.p
        may = np.flatnonzero(self._bound(least))
        pair = self.pair[may // p]
        if not len(may):
            return
        left = np.searchsorted(pair, np.searchsorted(-self.n, -np.arange(int(self.n[0])), "left"), "left")
        v = self._run(len(may), int(self.n[pair[0]]), lambda k: int(left[k]), lambda k, m: self.masks[:, may[:m] + k])
        np.maximum.at(self.least, pair, self._ratio(self._common(v, pair), pair, may - self.begin[pair]))

    def _bound(self, least: np.ndarray) -> np.ndarray:
        p, pair = self.p, self.pair
        after = np.r_[self.coarse[1:], 0]
        last = np.r_[pair[1:] != pair[:-1], True]
        after[last] = 1 << 20
        d = np.arange(p)
        most = np.minimum(self.coarse[:, None] + d, after[:, None] + p - d)
        local = (np.arange(len(pair)) * p - self.begin[pair])[:, None] + d
        n, long = self.n[pair][:, None], self.size[pair][:, None]
        size = np.maximum(0, np.minimum(long, local + 1) - np.maximum(0, local + 1 - n))
        bound = 200.0 * np.minimum(most, size) / (n + size)
        return ((bound >= least[pair][:, None]) & (bound > self.least[pair][:, None]) & (d > 0) & (size > 0) & (local < n + long - 1)).ravel()


def half_up(x: float, places: int = 6) -> float:
    """x rounded as Spark's round does."""
    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def levenshtein(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(last, row[j], row[j - 1])
    return row[-1]


def edits(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[Op]:
    """Blocks (tag, i1, i2, j1, j2) of a shortest edit script; replace before delete before insert. Replaced blocks are 1:1."""
    n, m = len(a), len(b)
    d = [list(range(m + 1))]
    for i in range(1, n + 1):
        up, row = d[-1], [i]
        for j in range(1, m + 1):
            row.append(up[j - 1] if a[i - 1] == b[j - 1] else 1 + min(up[j - 1], up[j], row[j - 1]))
        d.append(row)
    steps: list[tuple[str, int, int]] = []
    i, j = n, m
    while i or j:
        if i and j and a[i - 1] == b[j - 1] and d[i][j] == d[i - 1][j - 1]:
            tag, i, j = "equal", i - 1, j - 1
        elif i and j and d[i][j] == d[i - 1][j - 1] + 1:
            tag, i, j = "replace", i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            tag, i = "delete", i - 1
        else:
            tag, j = "insert", j - 1
        steps.append((tag, i, j))
    out: list[Op] = []
    for tag, i, j in reversed(steps):
        di, dj = tag != "insert", tag != "delete"
        if out and out[-1][0] == tag and out[-1][2] == i and out[-1][4] == j:
            out[-1] = (tag, out[-1][1], i + di, out[-1][3], j + dj)
        else:
            out.append((tag, i, i + di, j, j + dj))
    return out


def blocks(a: Sequence[Hashable], b: Sequence[Hashable], autojunk: bool = True) -> list[Op]:
    """Blocks by longest matching runs (Ratcliff-Obershelp)."""
    return SequenceMatcher(None, a, b, autojunk=autojunk).get_opcodes()


def spoken_reference(hyp: list[str], ref: list[str]) -> list[str]:
    """ref up to the last word that an equal or replaced block touches."""
    last = max([i2 for tag, _, i2, _, _ in blocks(ref, hyp, autojunk=False) if tag in ("equal", "replace")], default=0)
    return ref[:last]


def annotate(hyp: list[str], ref: list[str], confidence: float | None, ratio: float = 70.0) -> list[dict]:
    """A status for each word: correct, minor (alike by ratio), major, missing, extra; uncertain throughout if confidence is low."""
    unsure = confidence is not None and confidence < 0.4

    def row(status: str, i: int | None, j: int | None, like: float) -> dict:
        return {"word": hyp[i] if i is not None else None, "reference": ref[j] if j is not None else None, "status": "uncertain" if unsure and i is not None else status, "similarity": round(like, 4), "hyp_index": i, "ref_index": j}

    out = []
    for tag, i1, i2, j1, j2 in edits(hyp, ref):
        if tag == "delete":
            out += [row("extra", i, None, 0.0) for i in range(i1, i2)]
        elif tag == "insert":
            out += [row("missing", None, j, 0.0) for j in range(j1, j2)]
        else:
            for i, j in zip(range(i1, i2), range(j1, j2)):
                like = indel_ratio(hyp[i], ref[j])
                out.append(row("correct" if tag == "equal" else "minor" if like >= ratio else "major", i, j, like / 100))
    return out


#: Better statuses first.
RANK = {"correct": 0, "minor": 1, "major": 2, "uncertain": 2, "missing": 3, "extra": 3}


def best_of(first: list[dict], second: list[dict]) -> list[dict]:
    """For each reference word the better of two annotations, the first of equals; extra words of the first follow."""
    other = {x["ref_index"]: x for x in second if x["ref_index"] is not None}
    out = []
    for x in first:
        y = other.get(x["ref_index"]) if x["ref_index"] is not None else None
        out.append(y if y is not None and RANK[y["status"]] < RANK[x["status"]] else x)
    far = 1 << 30
    return sorted(out, key=lambda x: (far if x["ref_index"] is None else x["ref_index"], far if x["hyp_index"] is None else x["hyp_index"]))


def overlap(previous: list[str], current: list[str], most: int = 10, least: float = 0.85) -> int:
    """Words at the start of current that repeat the end of previous: the length with the best ratio of matching runs, the
    shorter of equals."""
    best, size = 0.0, 0
    for k in range(1, min(most, len(previous), len(current)) + 1):
        r = SequenceMatcher(None, " ".join(previous[-k:]), " ".join(current[:k])).ratio()
        if r >= least and r > best:
            best, size = r, k
    return size


def recover_boundaries(tokens: list[str], vocabulary: set[str]) -> list[str]:
    """Joins neighbours that form a known word, and splits an unknown long word into two known ones; left to right."""
    out, i = [], 0
    while i < len(tokens):
        t = tokens[i]
        if i + 1 < len(tokens):
            u = tokens[i + 1]
            if t + u in vocabulary and (t not in vocabulary and u not in vocabulary or len(t) <= 3 or len(u) <= 3):
                out.append(t + u)
                i += 2
                continue
        cut = next((k for k in range(2, len(t) - 1) if t[:k] in vocabulary and t[k:] in vocabulary), 0) if len(t) >= 6 and t not in vocabulary else 0
        out += [t[:cut], t[cut:]] if cut else [t]
        i += 1
    return out


def wrong_phrases(statuses: list[str], words: list[str | None]) -> list[tuple[str, int, int]]:
    """Phrases of successive words that are not right (text, first, last); a correct word ends one."""
    out, run = [], []
    for k, s in enumerate([*statuses, "correct"]):
        if s in ("correct", "minor"):
            if run:
                out.append((" ".join(words[i] or "" for i in run).strip(), run[0], run[-1]))
            run = []
        else:
            run.append(k)
    return out


def teachable(words: list[dict]) -> list[tuple[str, int | None, int | None]]:
    """Phrases of reference words to be taught (text, first, last place): major or missing words in a row, from the first such word to
    the next correct one. A minor word ends a phrase; extra and uncertain words do not."""
    out: list[tuple[str, int | None, int | None]] = []
    run: list[dict] = []
    started = False

    def close() -> None:
        places = [x["ref_index"] for x in run if x["ref_index"] is not None]
        out.append((" ".join(x["reference"] for x in run), min(places, default=None), max(places, default=None)))
        run.clear()

    for x in words:
        if x["status"] in ("major", "missing") and x["reference"]:
            started = True
            run.append(x)
        elif started and x["status"] == "correct":
            break
        elif run and x["status"] not in ("extra", "uncertain"):
            close()
    if run:
        close()
    return out


class Lock:
    """Which chapter a session is in, from the best candidate of each chunk.

    A candidate of at least `admit` enters a history of `size`. Inactive: the first chapter in the history with `votes` entries,
    a mean score of `mean` and a mean margin of `margin` is locked. Active: `misses` chunks in a row that are weak or of another
    chapter unlock it."""

    def __init__(self, admit: float = 0.20, mean: float = 0.28, margin: float = 0.08, size: int = 4, votes: int = 2, misses: int = 3):
        self.rule = (admit, mean, margin, size, votes, misses)
        self.history: list[tuple[int, float, float]] = []
        self.locked: int | None = None
        self.missed = 0

    def update(self, surah: int | None, score: float | None, margin: float | None) -> tuple[str, int | None]:
        admit, mean, least, size, votes, misses = self.rule
        weak = surah is None or score is None or score < admit
        if not weak:
            self.history = [*self.history, (surah, score, margin or 0.0)][-size:]
        if self.locked is not None:
            self.missed = self.missed + 1 if weak or surah != self.locked else 0
            if self.missed >= misses:
                self.locked, self.missed, self.history = None, 0, []
        else:
            for s in dict.fromkeys(h[0] for h in self.history):
                own = [h for h in self.history if h[0] == s]
                if len(own) >= votes and sum(h[1] for h in own) / len(own) >= mean and sum(h[2] for h in own) / len(own) >= least:
                    self.locked, self.missed = s, 0
                    break
        return ("ACTIVE" if self.locked is not None else "INACTIVE"), self.locked


class VotingLock(Lock):
    """A lock into which sure matches vote as well: while no chapter is locked, a match that may vote counts as a candidate."""

    def update(self, surah: int | None, score: float | None, margin: float | None, matched: int | None = None, ayah: int | None = None, confidence: float | None = None, heard: int = 0) -> tuple[str, int | None]:
        now = super().update(surah, score, margin)
        if self.locked is None and matched and ayah is not None and ayah != 1 and (confidence or 0.0) >= 0.70 and heard >= 2:
            vote = min(0.95, confidence * 1.2)
            now = super().update(matched, vote, vote)
        return now


class Chunker:
    """Chunks of a session's audio from speech segments, in samples.

    A group shorter than `blip` takes in the next segment; a group is let go once `confirm` samples of silence follow it, from `pad`
    before its speech, but not before what is committed, to `pad` behind it, if there are `tail` samples. Nothing is looked at before
    `least` samples are there. A pause skips what was not let go; a stop lets everything go, and what is left if it has `tail` samples."""

    def __init__(self, rate: int = 16_000, blip: float = 0.6, pad: float = 0.15, confirm: float = 0.05, least: float = 0.5, tail: float = 0.3):
        self.blip, self.pad, self.confirm, self.least, self.tail = (int(x * rate) for x in (blip, pad, confirm, least, tail))
        self.committed, self.segments = 0, []

    def _groups(self) -> list[tuple[int, int, int]]:
        """(start, end, segments) of the groups."""
        out: list[tuple[int, int, int]] = []
        for a, z in self.segments:
            if out and out[-1][1] - out[-1][0] < self.blip:
                out[-1] = (out[-1][0], z, out[-1][2] + 1)
            else:
                out.append((a, z, 1))
        return out

    def update(self, kind: str, start: int | None, end: int | None, total: int) -> list[tuple[int, int]]:
        """kind: speech (a segment start..end; one that begins with the last takes its place), pause or stop. total: samples so far."""
        if kind == "pause":
            self.committed, self.segments = max(self.committed, total), []
            return []
        if kind == "speech" and start is not None and end is not None and end > self.committed:
            if self.segments and self.segments[-1][0] == start:
                self.segments.pop()
            self.segments.append((max(start, self.committed), end))
        if kind != "stop" and total - self.committed < self.least:
            return []
        out = []
        for a, z, n in self._groups():
            if kind != "stop" and z + self.confirm > total:
                break
            begin, stop = max(self.committed, a - self.pad), min(total, z + self.pad)
            if stop - begin >= self.tail:
                out.append((begin, stop))
            self.committed, self.segments = z, self.segments[n:]
        if kind == "stop" and total - self.committed >= self.tail:
            out.append((self.committed, total))
            self.committed = total
        return out


def split_long(x: np.ndarray, rate: int = 16_000, most: float = 15.0, least: float = 1.5) -> list[tuple[int, int]]:
    """(start, end) of pieces of at most about `most` seconds: cut where 50 ms are quietest, from 0.3 s before to 0.2 s after a limit.

    Pieces under `least` seconds are left out; what is not above the limit, or leaves no piece, is one piece."""
    limit, window = int(most * rate), int(0.05 * rate)
    if len(x) <= limit:
        return [(0, len(x))]
    energy = np.r_[0.0, np.cumsum(x.astype(np.float64) ** 2)]
    out, pos = [], 0
    while pos < len(x):
        end = min(pos + limit, len(x))
        if end < len(x):
            low, high = max(pos, end - int(0.3 * rate)), min(len(x), end + int(0.2 * rate)) - window
            if high > low:
                at = np.arange(low, high)
                end = int(at[np.argmin(energy[at + window] - energy[at])])
            end = max(end, pos + 1)
        if end - pos >= int(least * rate):
            out.append((pos, end))
        pos = end
    return out or [(0, len(x))]


class Pairing:
    """Results meet the chunks that wait for them, first come first served; chunks are numbered as they come."""

    def __init__(self) -> None:
        self.next, self.waiting = 0, []

    def update(self, kind: str, start: float | None, end: float | None) -> tuple[int, float, float] | None:
        """kind: pending, discard (the first that starts within 0.05 s of start) or result. What a result belongs to, else None."""
        if kind == "pending":
            self.waiting.append((self.next, start, end))
            self.next += 1
        elif kind == "discard":
            at = next((i for i, x in enumerate(self.waiting) if abs(x[1] - start) < 0.05), None)
            if at is not None:
                del self.waiting[at]
        elif self.waiting:
            return self.waiting.pop(0)
        return None


class Correction:
    """LISTENING until a mistake, CORRECTING until its playback ends, VERIFYING until it is put right.

    A chunk of verdict error with a confidence of 0.3 or more starts a correction of words; one of verdict ok or minor with wrong vowels
    starts one of vowels. Words are right once a sure chunk is ok or minor, vowels once none of them is among those of a sure chunk.
    `number` tells the corrections apart: the end of another's playback changes nothing. `history` has an entry for each."""

    def __init__(self) -> None:
        self.state, self.kind, self.attempts, self.words, self.number = "LISTENING", "word", 0, [], 0
        self.history: list[dict] = []

    def _start(self, kind: str, words: list[str], place: object) -> str:
        self.state, self.kind, self.attempts, self.words, self.number = "CORRECTING", kind, 0, list(words), self.number + 1
        self.history.append({"kind": kind, "at": place, "words": list(words), "attempts": 0, "resolved": False})
        return "pause"

    def _again(self) -> str:
        self.state, self.attempts, self.number = "CORRECTING", self.attempts + 1, self.number + 1
        self.history[-1]["attempts"] = self.attempts
        return "retry"

    def _right(self) -> str:
        self.history[-1].update(resolved=True, attempts=self.attempts)
        self.state, self.kind, self.attempts, self.words, self.number = "LISTENING", "word", 0, [], self.number + 1
        return "verified"

    def update(self, verdict: str | None, confidence: float | None, wrong: list[str], played: int | None = None, vowels: list[str] = (), place: object = None) -> str:
        """The action for a chunk: continue, warn, pause, wait, retry, verified. played: the correction whose playback has ended."""
        if self.state == "CORRECTING":
            if played != self.number:
                return "wait"
            self.state = "VERIFYING"
        sure = (1.0 if confidence is None else confidence) >= 0.3
        if self.state == "LISTENING":
            if verdict in ("ok", "minor") and vowels:
                return self._start("vowels", vowels, place)
            if verdict == "error" and sure:
                return self._start("word", wrong, place)
            return "warn" if verdict in ("minor", "error") else "continue"
        if not sure:
            return "continue"
        if self.kind == "vowels":
            self.words = [w for w in self.words if w in set(vowels)]
            return self._again() if self.words else self._right()
        return self._right() if verdict in ("ok", "minor") else self._again()

    def hear(self, said: list[str]) -> bool:
        """Takes the pending phrases, or words of them, that were said (close_said) out; whether all are now gone, one of them by this."""
        left, some = [], False
        for phrase in self.words:
            w = phrase.split()
            if w and any(len(x) == len(w) and all(map(close_said, w, x)) for x in (said[i : i + len(w)] for i in range(len(said)))):
                some = True
                continue
            rest = [x for x in w if not any(close_said(x, y) for y in said)]
            some = some or len(rest) < len(w)
            left += [" ".join(rest)] if rest else []
        if some:
            self.words = left
        return some and not left


def close_said(a: str, b: str) -> bool:
    """Equal, or as many letters with at most one or (above 6 letters) two of them different; words under 3 letters must be equal."""
    return a == b or len(a) >= 3 and len(a) == len(b) and levenshtein(a, b) <= (1 if len(a) <= 6 else 2)


def sticky(old: str | None, new: str | None) -> str | None:
    """Status of a word after another look: correct stays; a later look replaces anything else; None changes nothing."""
    return old if old == "correct" or new is None else new


def heard_statuses(said: list[str], ref: list[str], before: list[str | None], voweled: set[str] = frozenset(), least: float = 0.72) -> list[str | None]:
    """Statuses of the reference's words after something was said of them, by matching runs: equal ones are correct (harakaat if among
    `voweled`), replaced ones correct from a likeness of `least`, else wrong; correct stays, and so does what was not touched."""
    out = list(before)
    for tag, i1, i2, j1, j2 in blocks(said, ref):
        if tag not in ("equal", "replace"):
            continue
        for i, j in zip(range(i1, i2), range(j1, j2)):
            if out[j] != "correct":
                like = 1.0 if tag == "equal" else indel_ratio(said[i], ref[j]) / 100
                out[j] = "harakaat" if tag == "equal" and ref[j] in voweled else "correct" if like >= least else "wrong"
    return out


def transition(previous: int, current: int, surah: list[int], first: list[bool], locked: bool) -> float:
    """Score of going from verse to verse (numbers in corpus order): from the end of a chapter to the first verse of any is a boundary."""
    if surah[previous] != surah[current]:
        ends = previous + 1 >= len(surah) or surah[previous + 1] != surah[previous]
        return -1.0 if ends and first[current] else -10.0 if locked else -2.0
    return {0: 0.5, 1: 1.0, 2: -0.5, 3: -1.0}.get(current - previous, -5.0)


class PathLock:
    """Which chapter a path is in, from the scores of its windows as they come.

    A window whose best verse has 0.6 or more enters a history of 5 with its margin over the best of another chapter. A chapter with
    three entries, a mean score of 0.7 and a mean margin of 0.25 is locked. It is let go where a window has nothing at 0.4 or more, or
    where two or three of the last three entries are of other chapters, all at 0.7 or more."""

    def __init__(self) -> None:
        self.history: list[tuple[int, float, float]] = []
        self.locked: int | None = None

    def update(self, scores: list[tuple[int, float]], surah: list[int]) -> int | None:
        """scores: (verse, score) of a window, the best first."""
        if scores:
            v, top = scores[0]
            other = next((s for u, s in scores if surah[u] != surah[v]), 0.0)
            if top >= 0.6:
                self.history = [*self.history, (surah[v], top, top - other)][-5:]
        if self.locked is not None:
            away = [h for h in self.history[-3:] if h[0] != self.locked]
            if not scores or scores[0][1] < 0.6 - 0.2 or len(away) >= 2 and all(h[1] >= 0.7 for h in away):
                self.locked = None
        if self.locked is None and len(self.history) >= 3:
            for s in dict.fromkeys(h[0] for h in self.history):
                own = [h for h in self.history if h[0] == s]
                if len(own) >= 3 and sum(h[1] for h in own) / len(own) >= 0.7 and sum(h[2] for h in own) / len(own) >= 0.25:
                    self.locked = s
                    break
        return self.locked


class Nearest:
    """Which of a text's candidates, of a fixed list, have the least CER (edits of letters over the candidate's length, 1 of an empty one).

    A candidate is compared only while the letters that it has not in common with the text do not settle that it is farther off than the
    one they leave nearest. Many pairs are compared together, one letter of the candidates a step, over bit vectors of 64 letters of the
    text (Myers)."""

    TOGETHER, PAIRS = 8192, 1 << 19

    def __init__(self, candidates: list[str]):
        each = [self._points(x) for x in candidates]
        self.sizes = np.array([len(x) for x in each], np.int64)
        self.begin = np.r_[0, np.cumsum(self.sizes)][:-1].astype(np.int64)
        points = np.concatenate([*each, np.zeros(0, np.uint32)])
        known = np.unique(points)
        self.letters = len(known) + 1
        self.code = np.zeros(0x110000, np.int32)  # 0: in no candidate
        self.code[known] = np.arange(1, self.letters)
        self.codes = self.code[points]
        self.bags = self._bags(self.codes, self.sizes)

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def _bags(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        of = np.repeat(np.arange(len(sizes)), sizes)
        bags = np.bincount(of * self.letters + codes, minlength=len(sizes) * self.letters).reshape(len(sizes), self.letters)
        bags[:, 0] = 0
        return bags.astype(np.int16 if sizes.max(initial=0) < 1 << 15 else np.int64)

    def many(self, asked: list[tuple[str, np.ndarray]]) -> list[tuple[float, np.ndarray]]:
        """(least CER, candidates that have it) of each (text, its candidates, one at least)."""
        out: list[tuple[float, np.ndarray]] = [(0.0, np.zeros(0, np.int64))] * len(asked)
        some: list[int] = []
        pairs = 0

        def close() -> None:
            for j, x in zip(some, self._some([asked[j] for j in some])):
                out[j] = x
            some.clear()

        for i in sorted(range(len(asked)), key=lambda i: len(asked[i][0])):  # alike in length
            if some and (len(some) == self.TOGETHER or pairs + len(asked[i][1]) > self.PAIRS):
                close()
                pairs = 0
            some.append(i)
            pairs += len(asked[i][1])
        if some:
            close()
        return out

    def _some(self, asked: list[tuple[str, np.ndarray]]) -> list[tuple[float, np.ndarray]]:
        own = [self.code[self._points(t)] for t, _ in asked]
        n = np.array([len(x) for x in own], np.int64)
        codes, counts = np.concatenate(own), np.array([len(c) for _, c in asked])
        of, at = np.repeat(np.arange(len(asked)), counts), np.concatenate([c for _, c in asked])
        begin = np.r_[0, np.cumsum(counts)][:-1]
        size, mine = self.sizes[at], self._bags(codes, n)
        common = np.concatenate([np.minimum(self.bags[c], b).sum(1, dtype=np.int64) for (_, c), b in zip(asked, mine)])
        least = np.where(size > 0, (np.maximum(size, n[of]) - common) / np.maximum(size, 1), 1.0)
        table = np.zeros(((int(n.max()) + 63) // 64, len(asked) * self.letters), np.uint64)
        j = np.concatenate([np.arange(x) for x in n])
        np.bitwise_or.at(table, (j // 64, np.repeat(np.arange(len(asked)), n) * self.letters + codes), np.uint64(1) << (j % 64).astype(np.uint64))
        cer = np.full(len(at), np.inf)

        def compare(pairs: np.ndarray) -> None:
            d = self._edits(table, n, of[pairs], at[pairs])
            cer[pairs] = np.where(size[pairs] > 0, d / np.maximum(size[pairs], 1), 1.0)

        first = np.lexsort((least, of))[begin]  # `of` ascends: each text's candidates stay where they are
        compare(first)
        may = least <= cer[first][of]
        may[first] = False
        compare(np.flatnonzero(may))
        best = np.minimum.reduceat(cer, begin)
        won = np.flatnonzero(cer == best[of])
        ends = np.searchsorted(of[won], np.arange(len(asked) + 1))
        return [(float(b), at[won[a:z]]) for b, a, z in zip(best, ends, ends[1:])]

    def _edits(self, table: np.ndarray, n: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Levenshtein distances of texts `of` (of n letters) and candidates `at`."""
        out = np.where(n[of] == 0, self.sizes[at], n[of])  # of what is not compared: one of both is empty
        words = (n[of] + 63) // 64
        for w in np.unique(words[words > 0]).tolist():
            own = np.flatnonzero(words == w)
            out[own] = self._run(table[:w], n, of[own], at[own])
        return out

    def _run(self, table: np.ndarray, n: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        words, one, top = len(table), np.uint64(1), np.uint64(63)
        order = np.argsort(-self.sizes[at], kind="stable")
        of, at = of[order], at[order]
        size, base, begin = self.sizes[at], of * self.letters, self.begin[at]
        last = ((n[of] - 1) % 64).astype(np.uint64)
        score = n[of].copy()
        plus, minus = np.full((words, len(at)), np.iinfo(np.uint64).max, np.uint64), np.zeros((words, len(at)), np.uint64)
        left = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")  # candidates of more than p letters
        for p, m in enumerate(left.tolist()):
            letter = base[:m] + self.codes.take(begin[:m] + p)
            up: np.ndarray | None = None  # what the word below hands on: one more, one less
            down: np.ndarray | None = None
            for w in range(words):
                eq, pv, mv = table[w].take(letter), plus[w, :m], minus[w, :m]
                xv = eq | mv
                if down is not None:
                    eq |= down
                xh = eq & pv
                xh += pv
                xh ^= pv
                xh |= eq
                ph = xh | pv
                np.invert(ph, out=ph)
                ph |= mv
                xh &= pv
                if w == words - 1:
                    score[:m] += (ph >> last[:m] & one).view(np.int64)
                    score[:m] -= (xh >> last[:m] & one).view(np.int64)
                else:
                    high, low = ph >> top, xh >> top
                ph <<= one
                ph |= one if up is None else up
                xh <<= one
                if down is not None:
                    xh |= down
                np.bitwise_and(ph, xv, out=mv)
                xv |= ph
                np.invert(xv, out=xv)
                np.bitwise_or(xh, xv, out=pv)
                if w < words - 1:
                    up, down = high, low
        out = np.empty(len(at), np.int64)
        out[order] = score
        return out


class Emitter:
    """Gives the best `most` verses (place, score) of a window of words: 0.6 x share of its different 1-, 2- and 3-grams + 0.4 x ratio;
    and all others that are less than `within` behind them.

    Of the candidates given, ties in their order; without any, of all verses that share a word (the others score 0 and are none),
    ties in corpus order. There a verse is scored only if its bound, with the letters both have as common subsequence, may still be
    among the best. The common subsequences of many windows are found together, one verse letter a step."""

    TOGETHER = {True: 4096, False: 256}  # of windows with candidates, which are few, and of those without

    def __init__(self, verses: list[str], most: int = 20, within: float = 0.0):
        self.verses, self.most, self.within = verses, most, within
        self.have = [self._grams(v.split()) for v in verses]
        self.place: dict[str, list[int]] = {}
        for i, v in enumerate(verses):
            for w in set(v.split()):
                self.place.setdefault(w, []).append(i)
        self.letter = {x: i for i, x in enumerate(sorted(set("".join(verses))), 1)}  # 0: matches nothing
        self.sizes = np.array([len(v) for v in verses], np.intp)
        self.codes = np.zeros((int(self.sizes.max(initial=0)), len(verses)), np.intp)
        self.bags = np.zeros((len(verses), len(self.letter) + 1), np.int32)
        for i, v in enumerate(verses):
            own = [self.letter[x] for x in v]
            self.codes[: len(own), i] = own
            self.bags[i] = np.bincount(own, minlength=len(self.letter) + 1)

    @staticmethod
    def _grams(w: list[str]) -> set[str]:
        return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(max(1, len(w) - n + 1))} if w else set()

    def __call__(self, words: list[str], candidates: list[int] | None) -> list[tuple[int, float]]:
        return self.many([(words, candidates)])[0]

    def many(self, windows: list[tuple[list[str], list[int] | None]]) -> list[list[tuple[int, float]]]:
        """The same for each of many (words, candidates)."""
        out: list[list[tuple[int, float]]] = [[] for _ in windows]
        for given, size in self.TOGETHER.items():
            own = [i for i, (_, c) in enumerate(windows) if bool(c) == given]
            for a in range(0, len(own), size):
                some = own[a : a + size]
                for i, x in zip(some, self._some([windows[i] for i in some])):
                    out[i] = x
        return out

    def _some(self, windows: list[tuple[list[str], list[int] | None]]) -> list[list[tuple[int, float]]]:
        texts, mine = [" ".join(w) for w, _ in windows], [self._grams(w) for w, _ in windows]
        found: list[list[tuple[int, float]]] = [[] for _ in windows]
        given, later = [], []
        for i, (w, c) in enumerate(windows):
            if c:
                given.append((i, np.array(c, np.intp), self._shares(mine[i], c)))
                continue
            at = np.array(sorted({v for x in set(w) for v in self.place.get(x, ())}), np.intp)
            if not len(at):
                continue
            bag = np.zeros(len(self.letter) + 1, np.int32)
            for x in texts[i]:
                bag[self.letter.get(x, 0)] += 1
            bag[0] = 0
            share = self._shares(mine[i], at.tolist())
            bound = self._joint(share, np.minimum(self.bags[at], bag).sum(1), self.sizes[at] + len(texts[i]))
            order = np.lexsort((at, -bound))
            at, share, bound = at[order], share[order], bound[order]
            given.append((i, at[: self.most], share[: self.most]))
            if len(at) > self.most:
                later.append((i, at[self.most :], share[self.most :], bound[self.most :]))
        for i, at, score in self._scores(texts, given):
            found[i] = list(zip(at.tolist(), score.tolist()))
        second = []
        for i, at, share, bound in later:
            may = bound >= min(s for _, s in found[i]) - self.within
            if may.any():
                second.append((i, at[may], share[may]))
        for i, at, score in self._scores(texts, second):
            found[i] += zip(at.tolist(), score.tolist())
        out = []
        for (_, c), x in zip(windows, found):
            ranked = sorted((y for y in x if y[1] > 0), key=(lambda y: -y[1]) if c else (lambda y: (-y[1], y[0])))
            out.append(ranked[: self.most] + [y for y in ranked[self.most :] if (c or self.within) and y[1] > ranked[self.most - 1][1] - self.within])
        return out

    def _shares(self, mine: set[str], at: list[int]) -> np.ndarray:
        return np.array([len(mine & self.have[v]) for v in at]) / len(mine)

    @staticmethod
    def _joint(share: np.ndarray, common: np.ndarray, total: np.ndarray) -> np.ndarray:
        return 0.6 * share + 0.4 * (200.0 * common / total / 100)

    def _scores(self, texts: list[str], pairs: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(text, verses, scores) of (text, verses, shares)."""
        if not pairs:
            return []
        of = np.repeat([i for i, _, _ in pairs], [len(at) for _, at, _ in pairs])
        at, share = np.concatenate([x for _, x, _ in pairs]), np.concatenate([x for _, _, x in pairs])
        score = self._joint(share, self._common(texts, of, at), self.sizes[at] + np.array([len(t) for t in texts])[of])
        ends = np.cumsum([0, *(len(x) for _, x, _ in pairs)])
        return [(i, x, score[a:z]) for (i, x, _), a, z in zip(pairs, ends, ends[1:])]

    def _common(self, texts: list[str], of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Letters of the longest common subsequences of texts[of] and verses[at]."""
        letters = len(self.letter) + 1
        table = np.zeros((len(texts), letters), np.uint64)
        for i, t in enumerate(texts):
            if len(t) <= 64:
                for j, x in enumerate(t):
                    if x in self.letter:
                        table[i, self.letter[x]] |= np.uint64(1 << j)
        flat = table.ravel()
        order = np.argsort(-self.sizes[at], kind="stable")
        verse, base = at[order], of[order] * letters
        left = np.searchsorted(-self.sizes[verse], -np.arange(int(self.sizes[verse].max(initial=0))), "left")  # verses of more than p letters
        v = np.full(len(verse), np.iinfo(np.uint64).max, np.uint64)
        for p, m in enumerate(left.tolist()):
            own = v[:m]
            u = own & flat.take(self.codes[p].take(verse[:m]) + base[:m])
            s = own + u
            np.subtract(own, u, out=own)
            np.bitwise_or(own, s, out=own)
        out = np.empty(len(at), np.int64)
        out[order] = np.bitwise_count(~v)
        for j in np.flatnonzero(np.array([len(t) > 64 for t in texts])[of]):
            out[j] = lcs_length(texts[of[j]], self.verses[at[j]])
        return out


def emitter(verses: list[str], most: int = 20, within: float = 0.0) -> Emitter:
    return Emitter(verses, most, within)


def chapters(surah: list[int], first: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chapter of each verse, and whether it is its chapter's first, and last in order."""
    of = np.array(surah)
    return of, np.array(first), np.r_[of[1:] != of[:-1], True]


def viterbi(emissions: list[list[tuple[int, float]]], surah: list[int], locked: bool | int = False, beam: int = 30, start: int | None = None, first: list[bool] | None = None, online: bool = False, most: int = 20, corpus: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> list[tuple[int, float]]:
    """The best path through the candidates (verse, score; the best first) of each step, as (verse, its own score).

    `start`: the chapter whose verses have 0.5 more in the first step. `locked`: a chapter (not True) leaves its own candidates only, or
    where a step has none the others at 1.5 less. `online`: the chapter that a PathLock holds has 0.2 more, others 0.2 less. Then the
    best `most` stay. Each step is padded by the verses kept before and those after them, at score 0, so that a path can always go on;
    the best `beam` states stay. Ties go to the lower verse. `first`: which verses are their chapter's first;
    `corpus`: chapters() of both, made once for many texts.
    A step scores all pairs of states at once (the scores of transition)."""
    first = first or ([i == 0 or surah[i] != surah[i - 1] for i in range(len(surah))] if corpus is None else None)
    only = locked if locked is not True and locked is not False else None
    lock = PathLock()
    steps: list[dict[int, float]] = []
    for t, cand in enumerate(emissions):
        if t == 0 and start is not None:
            cand = sorted(((v, s + (0.5 if surah[v] == start else 0.0)) for v, s in cand), key=lambda x: -x[1])
        if only is not None:
            cand = [x for x in cand if surah[x[0]] == only] or [(v, s - 1.5) for v, s in cand]
        elif online and (held := lock.update(cand, surah)) is not None:
            cand = sorted(((v, s + (0.2 if surah[v] == held else -0.2)) for v, s in cand), key=lambda x: -x[1])
        steps.append(dict(cand[:most] if online else cand))
    if not steps:
        return []
    fixed = locked is True or only is not None or lock.locked is not None  # as it is in the end
    of, begins, ends = corpus or chapters(surah, first)
    near = np.array([-5.0, 0.5, 1.0, -0.5, -1.0, -5.0])  # behind, 0 to 3 ahead, farther
    own = np.zeros(len(of))  # scores of one step
    back: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # verses in order, scores, places of the ones before
    for t, step in enumerate(steps):
        here, score = np.fromiter(step, np.intp, len(step)), np.fromiter(step.values(), float, len(step))
        if t == 0:
            if not step:
                here, score = np.zeros(1, np.intp), np.zeros(1)
            order = np.argsort(here)
            now, total = here[order], score[order]
            prev = np.zeros(len(now), np.intp)
        else:
            u, before, _ = back[-1]
            after = u + 1
            now = np.unique(np.concatenate((u, after[after < len(of)], here)))
            own[here] = score
            go = np.where(of[u][:, None] == of[now], near[np.clip(now - u[:, None], -1, 4) + 1], np.where(ends[u][:, None] & begins[now], -1.0, -10.0 if fixed else -2.0))
            go += before[:, None]
            prev = go.argmax(0)  # the first, and so the lower, of equals
            total = go[prev, np.arange(len(now))] + own[now]
            own[here] = 0.0
        kept = np.sort(np.lexsort((now, -total))[:beam])
        back.append((now[kept], total[kept], prev[kept]))
    at = int(back[-1][1].argmax())
    path = []
    for (now, _, prev), raw in zip(reversed(back), reversed(emissions)):
        v = int(now[at])
        path.append((v, dict(raw).get(v, 0.0)))
        at = int(prev[at])
    return path[::-1]


def coverage(hyp: list[str], ref: list[str]) -> float:
    """Share of the reference's words, as a bag, that the hypothesis holds; 0 if either is empty."""
    return sum((Counter(hyp) & Counter(ref)).values()) / len(ref) if hyp and ref else 0.0


def strip_prefix(words: list[str], phrase: list[str], least: float = 75.0, most: int = 20, share: float = 0.7, extra: int = 2) -> list[str]:
    """words without a start that is alike to phrase: the length (share x its words up to `extra` more) of the best ratio."""
    head = words[:most]
    if len(head) < 2:
        return words
    best, size = 0.0, 0
    for n in range(max(2, int(len(phrase) * share)), min(len(head), len(phrase) + extra) + 1):
        r = indel_ratio(" ".join(head[:n]), " ".join(phrase))
        if r > best:
            best, size = r, n
    return words[size:] if best >= least else words


def close_tokens(a: str, b: str) -> bool:
    """Equal, one begins the other (both of 2 letters or more), or a ratio of 72."""
    return a == b or min(len(a), len(b)) >= 2 and (a.startswith(b) or b.startswith(a)) or indel_ratio(a, b) >= 72


def strip_close(words: list[str], phrase: list[str]) -> list[str]:
    """words without the phrase in front, word by word alike; also if they are no more than its first two or more words."""
    n = 0
    while n < min(len(words), len(phrase)) and close_tokens(words[n], phrase[n]):
        n += 1
    return words[n:] if n == len(phrase) or n >= 2 and n == len(words) else words


def fix_partly(hyp: list[str], ref: list[str]) -> list[str]:
    """hyp with words of replaced runs put right where their CER is at most 0.5, and what such a run lacks put in.

    What is put in goes to the place counted in the words as they were, as earlier insertions do not move it."""
    out = list(hyp)
    for tag, i1, i2, j1, j2 in blocks(hyp, ref, autojunk=False):
        if tag != "replace":
            continue
        shared = min(i2 - i1, j2 - j1)
        for n in range(shared):
            if levenshtein(hyp[i1 + n], ref[j1 + n]) / max(1, len(ref[j1 + n])) <= 0.5:
                out[i1 + n] = ref[j1 + n]
        out[i2:i2] = ref[j1 + shared : j2]
    return out
