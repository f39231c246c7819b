"""Filling containers of fixed capacity: minimum bin slack on the table of lengths.

How containers are filled depends only on how many items there are of each length, and there are at most `capacity` lengths.
So the search runs on the driver over that table, whatever the number of items: the largest length left opens a container, a
bitset subset-sum over the lengths left finds the fullest combination that fits with it, and the combination is taken as
often as the counts allow before the next search. The items are then dealt to their places by rank within their length, in
one narrow stage against the (bounded) table of combinations. Items above the capacity, which have to be cut anyway, are laid
end to end and cut to measure: first into the space that the others leave unused, the rest into containers of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasm.session import checkpoint


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> list[tuple[int, int]]:
    """The fullest multiset of lengths (descending) that fits into room, as (length, how many); ties: the larger lengths."""
    full = (1 << room + 1) - 1
    reach, steps = 1, []
    for n in lengths:
        if n > room:
            continue
        most, k = min(counts[n], room // n), 1
        while most > 0:
            k = min(k, most)
            new = reach | (reach << k * n) & full
            if new != reach:
                steps.append((n, k, reach))
                reach = new
            most -= k
            k *= 2
        if reach >> room & 1:
            break
    left = reach.bit_length() - 1
    took: dict[int, int] = {}
    for n, k, before in reversed(steps):
        if not before >> left & 1:
            took[n] = took.get(n, 0) + k
            left -= k * n
    return sorted(took.items(), reverse=True)


def combinations(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(containers, [(length, how many in each)]) until every item has a place. Each entry uses up one length at least."""
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    while left:
        lengths = sorted(left, reverse=True)
        top = lengths[0]
        left[top] -= 1
        inside = dict(fullest(capacity - top, [n for n in lengths if left[n]], left))
        left[top] += 1
        inside[top] = inside.get(top, 0) + 1
        times = min(left[n] // k for n, k in inside.items())
        out.append((times, sorted(inside.items(), reverse=True)))
        for n, k in inside.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return out


def places(combos: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, container, place, how many in each container), sorted by length and rank."""
    rows, ranks, container = [], {}, 0
    for times, inside in combos:
        place = 0
        for n, k in inside:
            rows.append((n, ranks.get(n, 0), container, place, k))
            ranks[n] = ranks.get(n, 0) + times * k
            place += k
        container += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, seen = -1, 0
    for b in batches:
        if not b.num_rows:
            continue
        n = b.column("size").to_numpy(zero_copy_only=False)
        first = np.r_[True, n[1:] != n[:-1]]
        begin = np.maximum.accumulate(np.where(first, np.arange(len(n)), 0))
        rank = np.arange(len(n)) - begin
        if n[0] == last:
            rank[: int(np.argmax(n != last)) if (n != last).any() else len(n)] += seen
        last, seen = int(n[-1]), int(rank[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(rank.astype(np.int64))], names=[*b.schema.names, "part", "nth"])


def gaps(combos: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> np.ndarray:
    """Rows (first token on the tape, space, container, place) of the space left, as many containers of one space in a row as there
    are; the last row, of whole containers, has no end."""
    rows, tape, container = [], 0, 0
    for times, inside in combos:
        space = capacity - sum(n * k for n, k in inside)
        if space:
            rows.append((tape, space, container, sum(k for _, k in inside)))
            tape += times * space
        container += times
    return np.array([*rows, (tape, capacity, container, 0)], dtype=np.int64)


def cut(begin: int, size: int, table: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(container, place, from token, size) of the pieces of an item that lies on the tape from begin. It is longer than any space,
    so a space holds the end of one item and the start of the next at most."""
    out, pos = [], begin
    while pos < begin + size:
        tape, space, container, place = table[np.searchsorted(table[:, 0], pos, side="right") - 1].tolist()
        nth, inside = divmod(pos - tape, space)
        stop = min(begin + size, pos - inside + space)
        out.append((container + nth, place + (inside > 0), pos - begin, stop - pos))
        pos = stop
    return out


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """`container, place, <key>, piece, from_token, size` for each item, or each piece of an item above the capacity.

    Items whose size is null or below 1 get no row. Only items above the capacity are cut. Repeated rows are items of their own.
    Containers count from 0 without holes. Ties between items of one length are broken by key. Space stays unused only where the
    items to be cut do not suffice to fill it, and in one last container."""
    if not 1 <= capacity <= 1 << 20:
        raise ValueError("capacity must be between 1 and 2**20: the search keeps a table of that many lengths on the driver")
    c = F.col
    # written once: ranges are drawn from a pass of their own, and counting the sizes may cost much
    sized = checkpoint(items.select(c(key).alias("key"), c(size).cast("long").alias("size")).where("size >= 1"))
    kind = dict(sized.dtypes)["key"]
    # sorted in ranges: a length of which a third of all items are takes as many partitions as it needs
    order = sized.where(c("size") <= capacity).repartitionByRange("size", "key").sortWithinPartitions("size", "key")
    ranked = checkpoint(order.mapInArrow(_rank, f"key {kind}, size long, part int, nth long"))
    # a length spans whole partitions but for the first and last: at most partitions + capacity rows come to the driver
    held = ranked.groupBy("size", "part").agg(F.count("*").alias("n")).orderBy("size", "part").collect()
    counts: dict[int, int] = {}
    starts = {}
    for r in held:
        starts[r["part"], r["size"]] = counts.get(r["size"], 0)
        counts[r["size"]] = counts.get(r["size"], 0) + r["n"]
    combos = combinations(counts, capacity)
    table, space = places(combos), gaps(combos, capacity)
    names = ["container", "place", key, "piece", "from_token", "size"]
    ddl = f"container long, place int, `{key}` {kind}, piece int, from_token long, size long"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table[:, 0] << 42) + table[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            n, part = b.column("size").to_numpy(), b.column("part").to_numpy()
            change = np.flatnonzero(np.r_[True, (n[1:] != n[:-1]) | (part[1:] != part[:-1])])
            add = np.array([starts[int(part[i]), int(n[i])] for i in change])
            rank = b.column("nth").to_numpy() + np.repeat(add, np.diff(change, append=len(n)))
            row = table[np.searchsorted(keys, (n << 42) + rank, side="right") - 1]
            by, at = np.divmod(rank - row[:, 1], row[:, 4])
            none = np.zeros(len(n), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(row[:, 2] + by), pa.array((row[:, 3] + at).astype(np.int32)), b.column("key"), pa.array(none.astype(np.int32)), pa.array(none), pa.array(n)], names=names)

    long = sized.where(c("size") > capacity).repartitionByRange("size", "key").sortWithinPartitions("size", "key")
    tape = checkpoint(long.mapInArrow(_lay, f"key {kind}, size long, part int, at long"))
    parts = tape.groupBy("part").agg(F.sum("size").alias("n")).orderBy("part").collect()  # a row per partition
    offset = dict(zip((r["part"] for r in parts), np.cumsum([0, *[r["n"] for r in parts]]).tolist()))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, out = [], []
            for k, n, part, at in zip(*(b.column(i).to_pylist() for i in range(4))):
                got = cut(offset[part] + at, n, space)
                keys += [k] * len(got)
                out += [(w, p, i, f, s) for i, (w, p, f, s) in enumerate(got)]
            if out:
                w, p, i, f, s = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(p, pa.int32()), pa.array(keys, b.column(0).type), pa.array(i, pa.int32()), pa.array(f, pa.int64()), pa.array(s, pa.int64())], names=names)

    return ranked.mapInArrow(deal, ddl).unionByName(tape.mapInArrow(pieces, ddl))


def _lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and where each item begins on its tape."""
    from pyspark import TaskContext

    part, done = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.column("size").to_numpy(zero_copy_only=False)
        ends = np.cumsum(n) + done
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part, np.int32)), pa.array((ends - n).astype(np.int64))], names=[*b.schema.names, "part", "at"])
        done = int(ends[-1]) if len(ends) else done
