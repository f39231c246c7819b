"""Percentiles of large numeric columns from mergeable summaries: dyadic Count-sketches.

A value becomes a 20-bit code that keeps the order: the upper 20 bits of its 32-bit float (sign, exponent, 11 bits of the
fraction). So a code stands for values within a relative 2**-11 of each other, its middle is within 2**-12 of each of them.
For each of the 20 binary resolutions of the code a summary counts how many values lie under each node: exactly where there are
at most EXACT nodes, in a signed Count-sketch of DEPTH x WIDTH counters below. All counters are sums of weights, so summaries of
days or partitions are merged by addition, and a value is taken out again by adding it with weight -1.

Every answer descends the counters, from the coarsest resolution to the finest. A summary of few values is kept as the list of its
codes and weights: a shorter encoding of the same counters, which are filled from it before they are asked (SPARSE says where the
list stops being the shorter one and is of no consequence for an answer). The rank of an answer is off by at most `rank_error` x n:
3 standard errors of the estimates at the sketched levels, from the second moments that the counters themselves hold.

Values are counted in the tasks that hold them after repeats are dropped, and summaries are added in two steps, before and after
the shuffle. So a task sends one summary of bounded size for each key it meets, and a key of any size is a sum of that many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, EXACT, DEPTH, WIDTH, SPARSE = 20, 2048, 5, 1024, 1024
SKETCHED = BITS - EXACT.bit_length() + 1  # levels 0 .. SKETCHED-1 have more than EXACT nodes
CELLS = SKETCHED * DEPTH * WIDTH + sum(1 << BITS - k for k in range(SKETCHED, BITS))
EXACT_AT = {k: SKETCHED * DEPTH * WIDTH + sum(1 << BITS - j for j in range(SKETCHED, k)) for k in range(SKETCHED, BITS)}
#: Rows that a task counts at once.
HELD = 1 << 19
VALUE_ERROR = 2.0**-12
PROBABILITIES = (0.5, 0.9, 0.95, 0.99)


def encode(x: np.ndarray) -> np.ndarray:
    """Codes of doubles, in the same order. -0.0 counts as 0.0; infinities have codes of their own at the ends."""
    with np.errstate(over="ignore"):
        bits = (x + 0.0).astype(np.float32).view(np.uint32)
    return (np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)) >> np.uint32(32 - BITS)).astype(np.int32)


def decode(code: int) -> float:
    """The middle of the values with this code; 0.0 for the code of 0."""
    low, high = (np.array([c], np.uint64) << np.uint64(32 - BITS) for c in (code, code + 1))
    edge = []
    for b in (low, high):
        b = b.astype(np.uint32)
        edge.append(float(np.where(b >> 31, b & np.uint32(0x7FFFFFFF), ~b).astype(np.uint32).view(np.float32)[0]))
    if edge[0] == 0 or not all(np.isfinite(edge)):
        return edge[0]
    return (edge[0] + edge[1]) / 2


def _hash(node: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    h = (node.astype(np.uint64) + np.uint64((level * DEPTH + row + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return (h % np.uint64(WIDTH)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1)


def add(cells: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> None:
    for level in range(SKETCHED):
        for row in range(DEPTH):
            at, sign = _hash(codes >> level, level, row)
            k = (level * DEPTH + row) * WIDTH
            cells[k : k + WIDTH] += np.bincount(at, sign * weights, WIDTH).astype(np.int64)
    for level, k in EXACT_AT.items():
        size = 1 << BITS - level
        cells[k : k + size] += np.bincount(codes >> level, weights, size).astype(np.int64)


class Summary:
    """Sum of any number of lists of codes and of counters."""

    def __init__(self) -> None:
        self.codes, self.weights, self.cells = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        self._more: list[tuple[np.ndarray, np.ndarray]] = []
        self._held = 0

    def add(self, codes: np.ndarray | None, weights: np.ndarray | None, cells: np.ndarray | None) -> None:
        if cells is not None and len(cells):
            self.cells = cells.astype(np.int64) if self.cells is None else self.cells + cells
        if codes is not None and len(codes):
            self._more.append((codes, weights))
            self._held += len(codes)
            if self._held > 16 * SPARSE:
                self._settle()

    def _settle(self, fill: bool = False) -> None:
        if self._more:
            codes, inverse = np.unique(np.concatenate([self.codes, *[c for c, _ in self._more]]), return_inverse=True)
            weights = np.bincount(inverse, np.concatenate([self.weights, *[w for _, w in self._more]]), len(codes)).astype(np.int64)
            self.codes, self.weights = codes[weights != 0], weights[weights != 0]
            self._more, self._held = [], 0
        if fill and self.cells is None or len(self.codes) and (fill or self.cells is not None or len(self.codes) > SPARSE):
            if self.cells is None:
                self.cells = np.zeros(CELLS, np.int64)
            add(self.cells, self.codes, self.weights)
            self.codes, self.weights = self.codes[:0], self.weights[:0]

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        self._settle()
        return self.codes, self.weights, self.cells

    def counters(self) -> np.ndarray:
        self._settle(fill=True)
        return self.cells

    def count(self) -> int:
        return int(self.counters()[-2:].sum())

    def _under(self, nodes: np.ndarray, level: int) -> np.ndarray:
        """Estimates of the values under each node."""
        cells = self.counters()
        if level >= SKETCHED:
            return cells[EXACT_AT[level] + nodes].astype(float)
        got = np.empty((DEPTH, len(nodes)))
        for row in range(DEPTH):
            at, sign = _hash(nodes, level, row)
            got[row] = sign * cells[(level * DEPTH + row) * WIDTH + at]
        return np.median(got, axis=0)

    def quantiles(self, ps: Sequence[float] = PROBABILITIES) -> list[float | None]:
        """The least code that at least p x n values do not exceed, as its middle value, for each p; None of nothing."""
        n = self.count()
        if n <= 0:
            return [None] * len(ps)
        rank = np.array([max(1.0, np.ceil(p * n - 1e-9)) for p in ps])
        node, whole = np.zeros(len(ps), np.int64), np.full(len(ps), float(n))
        for level in range(BITS - 1, -1, -1):
            left = np.clip(self._under(2 * node, level), 0.0, whole)
            right = rank > left
            node, rank, whole = 2 * node + right, np.where(right, rank - left, rank), np.where(right, whole - left, left)
        return [decode(int(x)) for x in node]

    def rank_error(self) -> float:
        """Bound on the error of an answer's rank, as a share of n."""
        n = self.count()
        if n <= 0:
            return 0.0
        rows = np.sort(self.cells[: SKETCHED * DEPTH * WIDTH].astype(float).reshape(SKETCHED, DEPTH, WIDTH) ** 2, axis=2)
        # another node meets one of the WIDTH / 64 heaviest in most of its rows once in 26,000 times; else the median passes over it
        second = np.median(rows[:, :, : -WIDTH // 64].sum(axis=2), axis=1)
        return float(min(1.0, 3 * np.sqrt((second / WIDTH).sum()) / n))


def _codes(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a column of doubles, and which of them are values (not null, not NaN)."""
    v = x.to_numpy(zero_copy_only=False).astype(float)
    ok = ~np.isnan(v)
    return encode(np.where(ok, v, 0.0)).astype(np.int64), ok


def _fill(batches: Iterator[pa.RecordBatch], metrics: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Summaries of the rows (day, group, metrics) of a task, one for each day, group and metric in every HELD rows."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def finish() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        day = t.column(0).combine_chunks().cast(pa.int32())
        group = t.column(1).combine_chunks().dictionary_encode("encode")
        days = np.where(day.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int32).min, day.fill_null(0).to_numpy()).astype(np.int64)
        names, which = np.unique(days, return_inverse=True)
        key = which * len(group.dictionary) + group.indices.to_numpy()
        for k, metric in enumerate(metrics):
            code, ok = _codes(t.column(2 + k).combine_chunks())
            pairs, weights = np.unique((key[ok] << BITS) + code[ok], return_counts=True)
            own = pairs >> BITS
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
            bounds = np.r_[first, len(own)]
            d, g = np.divmod(own[first], max(1, len(group.dictionary)))
            out = [(c, w, None) if len(c) <= SPARSE else _summed(c, w) for c, w in ((pairs[a:z] & (1 << BITS) - 1, weights[a:z]) for a, z in zip(bounds[:-1], bounds[1:]))]
            date = pa.array(np.where(names[d] == np.iinfo(np.int32).min, 0, names[d]).astype(np.int32), mask=names[d] == np.iinfo(np.int32).min).cast(pa.date32())
            yield from _batches([date, group.dictionary.take(pa.array(g)), pa.array([metric] * len(first), pa.string())], out, schema)

    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
            if rows >= HELD:
                yield from finish()
                held, rows = [], 0
    if held:
        yield from finish()


def _summed(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    s = Summary()
    s.add(codes, weights, None)
    return s.parts()


def _list(xs: list[np.ndarray | None]) -> pa.ListArray:
    sizes = [0 if x is None else len(x) for x in xs]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate([x for x in xs if x is not None]) if sum(sizes) else np.zeros(0, np.int64), pa.int64()))


def _batches(keys: list[pa.Array], parts: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of at most 1,000 summaries, the counters of which stay below 2 GB."""
    for at in range(0, len(parts), 1000):
        some = parts[at : at + 1000]
        yield pa.RecordBatch.from_arrays([*[k.slice(at, len(some)) for k in keys], *[_list([p[i] for p in some]) for i in range(3)]], schema=schema)


def daily(df: DataFrame, ident: str, group: str, day: str | Column, metrics: list[str], arrived: str) -> DataFrame:
    """`day, group, metric, codes, weights, cells`: one summary per day, group and metric, each ident counted once.

    Of repeated idents the earliest `arrived` row counts. Null and NaN values are left out; a null group is a group of its own;
    a null ident is one ident; an empty table gives no rows; other columns are ignored. Keep this table (write() partitions it by
    day); merge() and summarize() join any of its days, subtract() takes days out again."""
    c = F.col
    from pyspark.sql.pandas.types import to_arrow_type

    date = F.to_date(c(day)) if isinstance(day, str) else day
    rows = df.select(c(ident).alias("i"), c(arrived).alias("a"), date.alias("day"), c(group).alias("grp"), *[c(m).cast("double").alias(f"m{k}") for k, m in enumerate(metrics)])
    names = ["day", "grp", *[f"m{k}" for k in range(len(metrics))]]
    once = rows.groupBy("i").agg(F.min(F.struct("a", *names)).alias("r")).select(*[c(f"r.{n}") for n in names])
    kind = once.schema["grp"].dataType
    schema = pa.schema([("day", pa.date32()), ("group", to_arrow_type(kind)), ("metric", pa.string()), *_LISTS])
    filled = once.mapInArrow(lambda it: _fill(it, metrics, schema), f"day date, `group` {kind.simpleString()}, metric string, {_PARTS}")
    return _gathered(filled, ["day", "group", "metric"], False)


def _add(batches: Iterator[pa.RecordBatch], keys: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Before a shuffle: the summaries of a task added up by key, as far as HELD counters and codes allow at once."""
    sums: dict[tuple, Summary] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        cols = [pa.array(x, f.type) for x, f in zip(zip(*sums), schema)] if sums else []
        if sums:
            yield from _batches(cols, [s.parts() for s in sums.values()], schema)
        sums.clear()

    for b in batches:
        for key, (codes, weights, cells) in _rows(b, keys):
            s = sums.get(key)
            if s is None:
                s = sums[key] = Summary()
                held += CELLS if cells is not None else 0
            elif cells is not None and s.cells is None:
                held += CELLS
            s.add(codes, weights, cells)
            held += len(codes)
            if held >= 16 * HELD:
                yield from flush()
                held = 0
    yield from flush()


def _rows(b: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, tuple]]:
    """(key, (codes, weights, counters)) of each row."""
    names = list(zip(*[b.column(k).to_pylist() for k in range(keys)]))
    views = []
    for k in range(keys, keys + 3):
        col = b.column(k)
        views.append((col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)))
    (co, c), (wo, w), (so, s) = views
    for i, key in enumerate(names):
        yield key, (c[co[i] : co[i + 1]], w[wo[i] : wo[i + 1]], s[so[i] : so[i + 1]] if so[i + 1] > so[i] else None)


def _sums(batches: Iterator[pa.RecordBatch], keys: int, finish: Callable[[Summary], tuple], build: Callable[[list[tuple], list[tuple]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What finish gives for each run of rows with equal keys; rows come sorted by them."""
    now: tuple | None = None
    summary = Summary()
    heads: list[tuple] = []
    out: list[tuple] = []
    for b in batches:
        for key, parts in _rows(b, keys):
            if key != now:
                if now is not None:
                    heads.append(now)
                    out.append(finish(summary))
                    if len(out) >= 256:
                        yield from build(heads, out)
                        heads, out = [], []
                now, summary = key, Summary()
            summary.add(*parts)
    if now is not None:
        heads.append(now)
        out.append(finish(summary))
    if out:
        yield from build(heads, out)


_PARTS = "codes array<bigint>, weights array<bigint>, cells array<bigint>"
_LISTS = [(n, pa.list_(pa.int64())) for n in ("codes", "weights", "cells")]


def _head(df: DataFrame, keys: list[str]) -> tuple[list[pa.Field], str]:
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [df.schema[k] for k in keys]
    return [pa.field(f.name, to_arrow_type(f.dataType)) for f in fields], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def _gathered(summaries: DataFrame, keys: list[str], before: bool = True) -> DataFrame:
    """Summaries of the same keys added up; `before`: also in the tasks that send them."""
    own, ddl = _head(summaries, keys)
    schema = pa.schema([*own, *_LISTS])
    rows = summaries.select(*keys, "codes", "weights", "cells")
    if before:
        rows = rows.mapInArrow(lambda it: _add(it, len(keys), schema), f"{ddl}, {_PARTS}")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    build = lambda heads, out: _batches([pa.array(x, f.type) for x, f in zip(zip(*heads), own)], out, schema)
    return rows.mapInArrow(lambda it: _sums(it, len(keys), Summary.parts, build), f"{ddl}, {_PARTS}")


def merge(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries of the same keys added up: `keys, codes, weights, cells`."""
    return _gathered(summaries, keys)


def subtract(summaries: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """`summaries` without the values counted in `gone` (a part of them): days, partitions or single rows taken out again."""
    less = gone.select(*keys, "codes", F.transform("weights", lambda w: -w).alias("weights"), F.transform("cells", lambda w: -w).alias("cells"))
    return _gathered(summaries.select(*keys, "codes", "weights", "cells").unionByName(less), keys)


def write(summaries: DataFrame, path: str) -> None:
    """The daily table, a folder for each day: a day that is computed again replaces its own."""
    summaries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def summarize(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """`keys, n, p50, p90, p95, p99, rank_error, value_error` over all summaries with the same keys.

    p is the least value that at least p of the values do not exceed, to within `rank_error` (share of n) in rank and
    `value_error` (relative) in value. Keys without values have no row. A task holds one sum, of bounded size, at a time."""
    names = [f"p{round(100 * p)}" for p in PROBABILITIES]
    own, ddl = _head(summaries, keys)
    kinds = [pa.int64(), *[pa.float64()] * (len(names) + 2)]
    schema = pa.schema([*own, *zip(["n", *names, "rank_error", "value_error"], kinds)])

    def build(heads: list[tuple], out: list[tuple]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([*zip(*heads), *zip(*out)], schema)], schema=schema)

    done = lambda s: (s.count(), *s.quantiles(), s.rank_error(), VALUE_ERROR)
    # the tasks that hold the summaries add them first: a key of which a third of all are is one row from each of them
    ahead = pa.schema([*own, *_LISTS])
    rows = summaries.select(*keys, "codes", "weights", "cells").mapInArrow(lambda it: _add(it, len(keys), ahead), f"{ddl}, {_PARTS}")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    values = "n bigint, " + ", ".join(f"{n} double" for n in [*names, "rank_error", "value_error"])
    return rows.mapInArrow(lambda it: _sums(it, len(keys), done, build), f"{ddl}, {values}").where("n > 0")
