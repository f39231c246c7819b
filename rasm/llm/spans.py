"""Long exact spans shared between records, by prefix-partitioned suffix trees.

A span is a window of LEAST code points, the shortest suffix that counts. Suffixes are not stored one by one: each window belongs to
one of the word starts within its first REACH code points, the one whose next ten code points have the least hash (to its own start
if there is none). That place depends on the window's content alone, so equal windows belong to equal places, and the windows of one
place, successive ones, travel as one piece of text.

Pieces are split by the prefix that follows their place, as long as it has to be: 10 code points, 20 or 30 where a group is over
`limit` windows; where 30 do not suffice, windows part with one another and go by all of their code points. At each length only the
groups over the limit are looked at again, at most (windows / limit) of them. What is left over the limit then is one window that
stands very often: one node, whose leaves are counted by two-step aggregates and never gathered.

Each group is a subtree of bounded size: its suffixes (up to the end of their piece) are sorted, and the lengths of the common
prefixes of neighbours give the internal nodes. Those of depth LEAST and more are the repeats; the suffixes under the outermost of
them, if more than one record lies there, are shared, and successive ones of a piece make a maximal repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasm.session import checkpoint, written

LEAST, REACH = 60, 30
#: Lengths of the prefixes by which pieces are split.
PREFIXES = (10, 20, 30)
#: Windows of a group, and of a batch of groups sorted together.
LIMIT, BATCH = 200_000, 60_000
PIECE = "k1 long, k2 long, nc int, na int, pos int, n int, h10 long, h20 long, h30 long, piece string"
P1 = np.uint64(0x9E3779B97F4A7C15)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text starts (with the end of the last)."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), np.r_[0, np.cumsum([len(t) for t in texts])]


def _prefix_hash(cp: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h = (h ^ cp[at + k].astype(np.uint64)) * P1
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def pieces(texts: list[str], least: int = LEAST, reach: int = REACH) -> tuple[np.ndarray, ...]:
    """(text number, start, windows) of each piece, and the hashes of its prefixes."""
    cp, bounds = _points(texts)
    size = np.diff(bounds)
    windows = np.maximum(size - least + 1, 0)
    doc = np.repeat(np.arange(len(texts)), windows)
    s = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + bounds[doc]
    if not len(s):
        return (np.zeros(0, np.int64),) * 6
    space = cp == 0x20
    words = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    padded = np.r_[cp, np.zeros(PREFIXES[0], cp.dtype)]
    value = np.r_[_prefix_hash(padded, words, PREFIXES[0]).view(np.uint64), np.uint64(0)]
    words = np.r_[words, 1 << 62]
    low, high = np.searchsorted(words, s, side="right"), np.searchsorted(words, s + reach, side="right")
    best = low.copy()
    for k in range(1, int((high - low).max())):  # at most one word start in two code points
        at = np.minimum(low + k, len(words) - 1)
        best = np.where((low + k < high) & (value[at] < value[best]), at, best)
    place = np.where(low < high, words[best], s)
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
    at = place[first]
    return (doc[first], s[first] - bounds[doc[first]], np.diff(first, append=len(s)), *(_prefix_hash(cp, at, k) for k in PREFIXES))


def _cut(batches: Iterator[pa.RecordBatch], counted: int, least: int) -> Iterator[pa.RecordBatch]:
    """Pieces of texts; with `counted` only the number of windows for each of the first so many prefix lengths together."""
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            texts = part.column("text").to_pylist()
            doc, pos, n, *h = pieces(texts, least)
            names = [f"h{k}" for k in PREFIXES]
            if counted:
                both, inverse = np.unique(np.stack(h[:counted]), axis=1, return_inverse=True)
                yield pa.RecordBatch.from_arrays([*map(pa.array, both), pa.array(np.bincount(inverse.ravel(), n, both.shape[1]).astype(np.int64))], names=[*names[:counted], "n"])
                continue
            text = [texts[d][p : p + k + least - 1] for d, p, k in zip(doc.tolist(), pos.tolist(), n.tolist())]
            own = [pa.array(part.column(c).to_numpy()[doc]) for c in ("k1", "k2", "nc", "na")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32)), *map(pa.array, h), pa.array(text, pa.string())], names=["k1", "k2", "nc", "na", "pos", "n", *names, "piece"])


def lcp_sorted(code: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes (start and size each in code), and the common prefix of each with the one before it (0 of the first)."""
    width = int(sizes.max())
    rows = np.lib.stride_tricks.sliding_window_view(np.r_[code, np.zeros(width, code.dtype)], width)[starts]
    rows = np.where(np.arange(width) < sizes[:, None], rows, 0).astype(code.dtype)
    order = np.argsort(rows.view(f"S{width * rows.itemsize}").ravel(), kind="stable")
    ordered, size = rows[order], sizes[order]
    differ = ordered[1:] != ordered[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.r_[0, np.minimum(common, np.minimum(size[1:], size[:-1]))]


def nodes(cols: dict[str, np.ndarray], texts: list[str], least: int) -> tuple[np.ndarray, ...]:
    """Shared ranges of the pieces of whole groups: (piece, role, first window, last window); role 0 as chunk, 1 as verse."""
    cp, bounds = _points(texts)
    alphabet, code = np.unique(cp, return_inverse=True)
    code = code.reshape(-1) + 1
    n = cols["n"].astype(np.int64)
    piece = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    kind = np.uint8 if len(alphabet) < 255 else ">u2" if len(alphabet) < 65535 else ">u4"
    starts = bounds[piece] + offset
    order, common = lcp_sorted(code.astype(kind), starts, bounds[piece + 1] - starts)
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(common < least) - 1  # the outermost nodes of depth least: deeper ones only refine them
    _, record = np.unique(np.stack([cols["k1"], cols["k2"]]), axis=1, return_inverse=True)
    record = record.ravel()[piece]
    _, one = np.unique(node * (record.max() + 1) + record, return_index=True)  # a record counts once under a node
    total = int(node.max()) + 1
    chunks = np.bincount(node[one], cols["nc"][piece[one]], total)
    verses = np.bincount(node[one], cols["na"][piece[one]], total)
    out = []
    for role, shared, has in ((0, (chunks >= 2) | (verses >= 1), cols["nc"]), (1, verses >= 2, cols["na"])):
        flag = shared[node] & (has[piece] > 0)
        starts = np.flatnonzero(flag & ~np.r_[False, flag[:-1] & (piece[1:] == piece[:-1])])
        ends = np.flatnonzero(flag & ~np.r_[flag[1:] & (piece[1:] == piece[:-1]), False])
        out.append((piece[starts], np.full(len(starts), role, np.int8), offset[starts], offset[ends]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _trees(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Subtrees of one partition, whose rows come sorted by group. Whole groups are sorted together up to BATCH windows."""
    held: list[pa.RecordBatch] = []
    windows = 0

    def finish() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        cols = {c: t.column(c).to_numpy() for c in ("k1", "k2", "nc", "na", "n", "pos")}
        piece, role, a, z = nodes(cols, t.column("piece").to_pylist(), least)
        pos = cols["pos"][piece]
        return pa.RecordBatch.from_arrays([pa.array(cols["k1"][piece]), pa.array(cols["k2"][piece]), pa.array(role.astype(np.int32)), pa.array((pos + a).astype(np.int32)), pa.array((pos + z).astype(np.int32))], names=["k1", "k2", "role", "a", "z"])

    last = None
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column("g").to_numpy()
        n = np.cumsum(b.column("n").to_numpy().astype(np.int64))
        at = 0
        for k in np.flatnonzero(np.r_[g[0] != last, g[1:] != g[:-1]]).tolist():  # places where a group begins
            if windows + (n[k - 1] if k else 0) - (n[at - 1] if at else 0) >= BATCH:
                if k > at:
                    held.append(b.slice(at, k - at))
                if held:
                    yield finish()
                held, windows, at = [], 0, k
        held.append(b.slice(at))
        windows += int(n[-1] - (n[at - 1] if at else 0))
        last = g[-1]
    if held:
        yield finish()


def _over(counts: DataFrame, key: str, limit: int) -> DataFrame | None:
    """The groups over the limit; None where there are none."""
    over = checkpoint(counts.groupBy(key).agg(F.sum("n").alias("n")).where(F.col("n") > limit).select(key))  # at most windows / limit rows
    return None if over.isEmpty() else over


def _join(df: DataFrame, small: DataFrame, key: str, how: str) -> DataFrame:
    """df with the few keys of small: broadcast where they are counted to be under 64 MB."""
    return df.join(F.broadcast(small) if small.count() < 4 << 20 else small, key, how)


def shared_ranges(texts: DataFrame, least: int = LEAST, limit: int = LIMIT) -> DataFrame:
    """`k1, k2, role, a, z`: for a text (k1, k2) ranges of window starts that also stand in another record.

    `texts` (k1, k2, nc, na, text) has each text once, with the number of records of each role. A chunk's window is shared if another
    chunk or any verse holds it, a verse's if another verse does."""
    c = F.col
    count = lambda k: texts.select("text").mapInArrow(lambda it: _cut(it, k, least), ", ".join(f"h{x} long" for x in PREFIXES[:k]) + ", n long")
    cut = texts.select("k1", "k2", "nc", "na", "text").mapInArrow(lambda it: _cut(it, 0, least), PIECE)
    group, over = F.lit(None).cast("long"), None
    for k, length in enumerate(PREFIXES):
        name = f"h{length}"
        counts = count(k + 1)
        counts = counts if over is None else _join(counts, over, f"h{PREFIXES[k - 1]}", "left_semi")
        over = _over(counts, name, limit)
        if over is None:
            group = F.coalesce(group, c(name))
            break
        cut = _join(cut, over.withColumn(f"over{length}", F.lit(True)), name, "left")
        group = F.coalesce(group, F.when(c(f"over{length}").isNull(), c(name)))
    columns = ["k1", "k2", "nc", "na", "pos", "n", "piece"]
    cut = cut.withColumn("g", group)
    grouped = cut.where("g is not null").select("g", *columns)
    if over is None:
        return _forest(grouped, least)
    each = F.posexplode(F.transform(F.sequence(F.lit(1), c("n")), lambda i: F.substring("piece", i, F.lit(least)))).alias("i", "piece")
    alone = cut.where("g is null").select("k1", "k2", "nc", "na", "pos", each)
    alone = alone.select(F.xxhash64("piece").alias("g"), F.xxhash64(F.lit("window"), "piece").alias("g2"), "k1", "k2", "nc", "na", (c("pos") + c("i")).alias("pos"), F.lit(1).alias("n"), "piece")
    often = _over(alone.groupBy("g").agg(F.count("*").alias("n")), "g", limit)
    if often is None:
        return _forest(grouped.unionByName(alone.select("g", *columns)), least)
    alone = _join(alone, often.withColumn("often", F.lit(True)), "g", "left")
    node = checkpoint(alone.where("often").groupBy("g", "g2", "k1", "k2").agg(F.first("nc").alias("nc"), F.first("na").alias("na")).groupBy("g", "g2").agg(F.sum("nc").alias("c"), F.sum("na").alias("v")))
    small = node.count() < 2 << 20  # at most windows / limit rows
    hot = alone.where("often").join(F.broadcast(node) if small else node, ["g", "g2"])
    roles = F.array(F.when((c("nc") > 0) & ((c("c") >= 2) | (c("v") >= 1)), F.lit(0)), F.when((c("na") > 0) & (c("v") >= 2), F.lit(1)))
    hot = hot.select("k1", "k2", F.explode(roles).alias("role"), c("pos").alias("a"), c("pos").alias("z")).where("role is not null")
    return _forest(grouped.unionByName(alone.where("often is null").select("g", *columns)), least).unionByName(hot)


def _forest(grouped: DataFrame, least: int) -> DataFrame:
    return grouped.repartition("g").sortWithinPartitions("g").mapInArrow(lambda it: _trees(it, least), "k1 long, k2 long, role int, a int, z int")


def keys() -> list:
    """128 bits that stand for a text."""
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), F.col("text")).alias("k2")]


def shared(texts: DataFrame, least: int = LEAST, limit: int = LIMIT) -> DataFrame:
    """`k1, k2, role, spans, covered`: per text and role the maximal stretches made of shared windows, and how many code points they cover."""
    c = F.col
    ranges = shared_ranges(texts, least, limit)
    lists = ranges.groupBy("k1", "k2", "role").agg(F.sort_array(F.collect_list(F.struct("a", "z"))).alias("r"))  # of one text
    start = F.struct(F.lit(0).alias("spans"), F.lit(0).alias("covered"), F.lit(-1).alias("end"))

    def step(acc: object, x: object) -> object:
        stop = x["z"] + least
        new = x["a"] > acc["end"]
        return F.struct((acc["spans"] + new.cast("int")).alias("spans"), (acc["covered"] + F.greatest(F.lit(0), stop - F.greatest(x["a"], acc["end"]))).alias("covered"), F.greatest(acc["end"], stop).alias("end"))

    done = lists.select("k1", "k2", "role", F.aggregate("r", start, step).alias("s"))
    return done.select("k1", "k2", "role", c("s.spans").alias("spans"), c("s.covered").alias("covered"))


def records(chunks: DataFrame, verses: DataFrame) -> DataFrame:
    """`rec_key, role, text`: a chunk's earliest delivery once, and the verses. Texts as stored."""
    c = F.col
    once = chunks.groupBy("session_id", "chunk_index").agg(F.min(F.struct("received_at", "corrected_text")).alias("r"))
    a = once.select(F.concat(F.lit("chunk:"), "session_id", F.lit(":"), "chunk_index").alias("rec_key"), F.lit(0).alias("role"), c("r.corrected_text").alias("text"))
    b = verses.select(F.concat(F.lit("ayah:"), "surah", F.lit(":"), "ayah").alias("rec_key"), F.lit(1).alias("role"), "text")
    return a.unionByName(b)


def report(records: DataFrame, least: int = LEAST, limit: int = LIMIT) -> DataFrame:
    """`rec_key, role, spans, covered, length` of the records that share a span; others have no row.

    Null texts and texts under `least` code points hold no window. The records are read once and written with the hashes of their
    texts. Equal texts are taken once, so a text that a third of all records repeat is one row until the report, where the records
    of one text are met by its one row: broadcast where that table is small, else a join whose crowded keys adaptive execution splits."""
    c = F.col
    own = written(records.where(F.length("text") >= least).select("rec_key", "role", F.length("text").alias("length"), *keys(), "text"))
    texts = own.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.sum(1 - c("role")).cast("int").alias("nc"), F.sum("role").cast("int").alias("na"))
    done = shared(written(texts), least, limit)
    return own.drop("text").join(done, ["k1", "k2", "role"]).select("rec_key", "role", "spans", "covered", "length")
