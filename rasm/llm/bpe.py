"""Byte-level BPE of whole tables with a public vocabulary: ids, counts, and the parts they are made of.

Two tiers. Pre-tokens are cut and looked up for a whole block of texts at once, as arrays: a minimal perfect hash over the
vocabulary resolves each pre-token that is itself a token, of any length, and the stored key confirms the match. The rest (not in
the vocabulary) is merged with a heap over linked bytes, once per distinct pre-token while it is kept.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of text handled as one block of arrays. A longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Distinct merged pre-tokens kept by a Python worker before it starts again.
KEEP = 300_000
OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)
# Characters with the property White_Space.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
U = np.uint64
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: neighbouring parts with the lowest rank join first, the left one of equals."""
    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue  # one of the two has joined another since
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def mix(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    h = a * U(0x9E3779B97F4A7C15) + (b ^ length) * U(0xC2B2AE3D27D4EB4F)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def again(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    x = (h + d * U(0x9E3779B97F4A7C15)) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def fold(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words for each byte string: its first 8 bytes and the next 8, into which all later ones are mixed. buf ends in 16 zeros."""
    word = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    a = word[at] & MASKS[np.minimum(size, 8)]
    b = word[at + np.minimum(size, 8)] & MASKS[np.clip(size - 8, 0, 8)]
    more = np.flatnonzero(size > 16)
    k = 16
    while len(more):
        rest = word[at[more] + k] & MASKS[np.minimum(size[more] - k, 8)]
        b[more] = (b[more] ^ rest) * U(0x9E3779B97F4A7C15) ^ (b[more] >> U(31))
        k += 8
        more = more[size[more] > k]
    return a, b


class Lookup:
    """A minimal perfect hash (hash and displace) from byte strings to ids. Slots hold the key's two words and, of keys above 16 bytes,
    the key, so misses are known."""

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        size = np.array([len(k) for k in keys], dtype=np.int64)
        length = size.astype(U)
        n = len(keys)
        raw = np.stack(fold(np.frombuffer(b"".join(keys) + bytes(16), np.uint8), np.cumsum(size) - size, size), axis=1)
        self.longest = int(size.max(initial=0))
        self.long = {ranks[k]: k for k in keys if len(k) > 16}
        h = mix(raw[:, 0], raw[:, 1], length)
        if len(np.unique(h)) < n:
            raise ValueError("two keys share a hash; the mixing constants need changing")
        self.n, self.buckets = n, max(1, n // 3)
        which = (h % U(self.buckets)).astype(np.int64)
        order = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[order], np.arange(self.buckets + 1))
        taken, free = bytearray(n), None
        self.shift = np.zeros(self.buckets, dtype=np.int64)  # d >= 0: rehash with d; below 0: the slot itself, as -1 - slot
        slot_of = np.empty(n, dtype=np.int64)
        hs = h.tolist()
        m64 = (1 << 64) - 1
        for b in np.argsort(-(bounds[1:] - bounds[:-1]), kind="stable").tolist():
            own = order[bounds[b] : bounds[b + 1]].tolist()
            if not own:
                break
            if len(own) == 1:
                free = free or iter([i for i in range(n) if not taken[i]])
                slot_of[own[0]] = s = next(free)
                self.shift[b] = -1 - s
                continue
            for d in range(1 << 30):
                slots = []
                for k in own:
                    x = (hs[k] + d * 0x9E3779B97F4A7C15) * 0x94D049BB133111EB & m64
                    s = (x ^ (x >> 31)) % n
                    if taken[s] or s in slots:
                        break
                    slots.append(s)
                else:
                    break
            for k, s in zip(own, slots):
                taken[s] = 1
                slot_of[k] = s
            self.shift[b] = d
        self.a, self.b, self.length, self.ids = np.zeros(n, U), np.zeros(n, U), np.zeros(n, U), np.zeros(n, np.int32)
        self.a[slot_of], self.b[slot_of], self.length[slot_of] = raw[:, 0], raw[:, 1], length
        self.ids[slot_of] = [ranks[k] for k in keys]

    def __call__(self, raw: bytes, buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The id of each string of raw (start, size; buf holds its bytes and 16 zeros), -1 if it is none."""
        size = np.minimum(size, self.longest + 1)  # longer ones are no key
        a, b = fold(buf, at, size)
        length = size.astype(U)
        h = mix(a, b, length)
        d = self.shift[(h % U(self.buckets)).astype(np.int64)]
        slot = np.where(d < 0, -1 - d, (again(h, d.astype(U)) % U(self.n)).astype(np.int64))
        same = (self.a[slot] == a) & (self.b[slot] == b) & (self.length[slot] == length)
        ids = np.where(same, self.ids[slot], np.int32(-1))
        for i in np.flatnonzero((size > 16) & same).tolist():
            if raw[at[i] : at[i] + size[i]] != self.long[int(ids[i])]:
                ids[i] = -1
        return ids


def classes() -> np.ndarray:
    """Class of every code point, by its Unicode category."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for cp in [*range(0x32400), *range(0xE0000, 0xE0200)]:
        c = unicodedata.category(chr(cp))[0]
        out[cp] = LETTER if c == "L" else NUMBER if c == "N" else OTHER
    out[WHITE] = SPACE
    return out


class Encoder:
    """Pre-tokenizer and both tiers. State is bounded: the vocabulary, a table of classes, and at most KEEP merged pre-tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.classes, self.kept = ranks, classes(), {}
        self.lookup = Lookup({k: r for k, r in ranks.items() if merge(k, ranks) == [r]})

    def starts(self, cp: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where the pre-tokens start; edges are the places between texts, which start a pre-token of their own.

        As the pattern 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^ s L N]+| s+(?!S)| s+ does, with L letters, N numbers, s white space."""
        c = self.classes[cp]
        c[edges] = EDGE
        st = np.empty(len(c), bool)
        st[0] = True
        np.not_equal(c[1:], c[:-1], out=st[1:])
        st[edges] = True
        after = np.flatnonzero(st[1:] & (c[:-1] == SPACE) & (c[1:] != EDGE))  # last white space before a run of others
        st[after] = True
        st[after[cp[after] == 0x20] + 1] = False
        for i in np.flatnonzero((cp[:-2] == 0x27) & (c[1:-1] == LETTER)).tolist() if len(c) > 2 else ():
            if i and (c[i - 1] == OTHER or cp[i - 1] == 0x20 and c[i - 1] == SPACE):
                continue
            x = chr(cp[i + 1])
            k = 2 if x in "stmd" else 3 if x + chr(cp[i + 2]) in ("re", "ve", "ll") else 0
            if k:
                st[i + 1] = False
                if k == 3:
                    st[i + 2] = False
                if c[i + k] == LETTER:
                    st[i + k] = True
        return np.flatnonzero(st)

    def tokens(self, texts: list[str], need_ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Number of tokens of each text, and (if needed) the ids of all of them in order."""
        text = "\n".join([*texts, ""])
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        edges = np.cumsum([len(t) + 1 for t in texts]) - 1
        first = self.starts(cp, edges)
        raw = text.encode("utf-8", "surrogatepass")
        buf = np.frombuffer(raw + bytes(16), np.uint8)
        if len(raw) == len(cp):
            at = first
        else:
            width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
            at = (np.cumsum(width) - width)[first]
        size = np.diff(at, append=len(raw))
        is_edge = np.zeros(len(cp), bool)
        is_edge[edges] = True
        real = ~is_edge[first]
        doc = np.cumsum(is_edge[first])[real]
        at, size = at[real], size[real]
        ids = self.lookup(raw, buf, at, size)
        missed = np.flatnonzero(ids < 0)
        count = np.ones(len(ids), np.int64)
        found = []
        kept = self.kept
        for i, n in zip(at[missed].tolist(), size[missed].tolist()):
            piece = raw[i : i + n]
            x = kept.get(piece)
            if x is None:
                if len(kept) >= KEEP:
                    kept.clear()
                x = merge(piece, self.ranks)
                if n <= 64:
                    kept[piece] = x
            found.append(x)
        count[missed] = [len(x) for x in found]
        per_doc = np.bincount(doc, weights=count, minlength=len(texts)).astype(np.int64)
        if not need_ids:
            return per_doc, None
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        out[(ends - count)] = ids
        if found:
            n = count[missed]
            flat = np.fromiter((y for x in found for y in x), np.int32, int(n.sum()))
            out[np.repeat(ends[missed] - n, n) + np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
        return per_doc, out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, made once per Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(read_ranks(path))
    return _encoders[path]


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, n = [], 0
    for t in texts:
        block.append(t)
        n += len(t)
        if n >= BLOCK_BYTES:
            yield block
            block, n = [], 0
    if block:
        yield block


def _encode(batches: Iterator[pa.RecordBatch], path: str, schema: pa.Schema, need_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for b in batches:
        if not b.num_rows:
            continue
        k = b.num_columns - 1
        at = 0
        # texts of a batch are taken a block at a time; each block leaves as a batch of its own
        for block in _blocks([t or "" for t in b.column(k).to_pylist()]):
            n, ids = enc.tokens(block, need_ids)
            rest = [b.column(i).slice(at, len(block)) for i in range(k)]
            last = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(ids, pa.int32())) if need_ids else pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([*rest, last], schema=schema)
            at += len(block)


def _with(df: DataFrame, text: str, name: str, kind: T.DataType, arrow: pa.DataType, path: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    own = [c for c in df.columns if c not in (text, name)]
    narrow = df.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text}`").cast("string").alias(name))
    schema = pa.schema([*[(f.name, to_arrow_type(f.dataType)) for f in narrow.schema.fields[:-1]], (name, arrow)])
    out = T.StructType([*narrow.schema.fields[:-1], T.StructField(name, kind)])
    need = isinstance(kind, T.ArrayType)
    return narrow.mapInArrow(lambda it: _encode(it, path, schema, need), out)


def encode(df: DataFrame, text: str, ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """df with `text` replaced by `ids`, the token ids of each text without special tokens.

    Null and empty texts have no ids: []. The strings of special tokens are ordinary text. A column already named `ids` is
    replaced. Select the columns to keep before: all of them pass through Python. One narrow stage, no shuffle."""
    return _with(df, text, ids, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), path)


def count_tokens(df: DataFrame, text: str, name: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """df with `text` replaced by its number of tokens; 0 for null and empty texts."""
    return _with(df, text, name, T.LongType(), pa.int64(), path)
