import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasm.llm import bpe, pack

needs = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="needs the vocabulary")
SAMPLES = ["", " ", "  \n\n a", "it's they'll 'sx ''s !'s I'M", " 's", "'s", "naïve café 測試詞 жулип 🧪🙂", "x" * 5000, " " * 3000 + "a", "a\tb\u00a0 \u3000c", "<|endoftext|>", "1234567890.0987654321", "\\begin{x}\r\n% no\r\n", "e\u0301 \u200b\u00ad", "'rex 'v 'll'd't", "\n", "a\x00b", "\x1c\x1d a"]


@pytest.fixture(scope="module")
def expected():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={}).encode_ordinary


def ids(texts):
    n, flat = bpe.encoder(bpe.VOCABULARY).tokens(texts)
    out, at = [], 0
    for k in n.tolist():
        out.append(flat[at : at + k].tolist())
        at += k
    return out


@needs
def test_samples(expected):
    assert ids(SAMPLES) == [expected(t) for t in SAMPLES]
    assert all(ids([t]) == [expected(t)] for t in SAMPLES)


@needs
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 's'tre1.\n\té\u3000-")), max_size=6))
def test_any_text(expected, texts):
    assert ids(texts or [""]) == [expected(t) for t in texts or [""]]


@needs
def test_tables(spark, expected):
    df = spark.createDataFrame([(1, "a b", 7), (2, None, 7), (3, "", 7), (1, "a b", 7)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], list(r["ids"])) for r in bpe.encode(df, "text").collect())
    assert got == [(1, expected("a b")), (1, expected("a b")), (2, []), (3, [])]
    assert bpe.encode(df.limit(0), "text").count() == 0
    assert sorted(r["n_tokens"] for r in bpe.count_tokens(df, "text").collect()) == [0, 0, 2, 2]


def check(rows, items, capacity):
    full = {}
    for r in rows:
        assert 1 <= r["size"] <= capacity
        full.setdefault(r["container"], []).append(r)
    assert sorted(full) == list(range(len(full)))
    for own in full.values():
        assert sum(r["size"] for r in own) <= capacity and sorted(r["place"] for r in own) == list(range(len(own)))
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["size"]
        assert r["piece"] == 0 or items[r["doc_id"]] > capacity
    assert got == {k: n for k, n in items.items() if n and n > 0}
    return len(full)


def test_pack(spark):
    items = {i: [3, 5, 7, 10, 4, 23, 0, None, 6][i % 9] for i in range(900)}
    df = spark.createDataFrame([(k, n, 1) for k, n in items.items()], "doc_id long, n int, piece int")
    n = check(pack.pack(df, "doc_id", "n", 10).collect(), items, 10)
    assert n == -(-sum(x or 0 for x in items.values()) // 10)  # what is cut fills what the others leave
    short = {k: x for k, x in items.items() if x != 23}
    n = check(pack.pack(df.where("n <> 23"), "doc_id", "n", 10).collect(), short, 10)
    assert n <= 1.02 * sum(x or 0 for x in short.values()) / 10 + 1
    assert pack.pack(df.limit(0), "doc_id", "n", 10).count() == 0
    twice = spark.createDataFrame([(1, 4), (1, 4), (None, 2)], "doc_id long, n int")
    assert sorted(r["size"] for r in pack.pack(twice, "doc_id", "n", 10).collect()) == [2, 4, 4]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), max_size=8), st.integers(0, 30))
def test_fullest(counts, room):
    reach = {0}
    for n, k in counts.items():
        reach = {r + i * n for r in reach for i in range(k + 1) if r + i * n <= room}
    got = pack.fullest(room, sorted(counts, reverse=True), counts)
    assert sum(n * k for n, k in got) == max(reach) and all(k <= counts[n] for n, k in got)


def test_tokens_of_any_length_are_looked_up():
    ranks = {bytes([i]): i for i in range(256)}
    for i, k in enumerate([b"a" * 17, b"a" * 16 + b"b", b"ab" * 40, b"ab" * 39 + b"ba", b"abcdefgh" * 2, b"x" * 24, b"x" * 25]):
        ranks[k] = 256 + i
    look = bpe.Lookup(ranks)
    keys = [*ranks, b"a" * 18, b"ab" * 41, b"x" * 23, b"y" * 500, b"ab" * 39 + b"bb"]
    size = np.array([len(k) for k in keys])
    raw = b"".join(keys)
    got = look(raw, np.frombuffer(raw + bytes(16), np.uint8), np.cumsum(size) - size, size)
    assert got.tolist() == [ranks.get(k, -1) for k in keys]
