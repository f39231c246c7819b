"""Repeated consecutive events: each run of equal events of an entity becomes one row.

Events become symbols (Unicode code points), the ordered events of a block become one string, and a back-reference finds the
runs in it; their spans are mapped to the rows' times. An entity may be split over tasks anywhere: rows are range partitioned
on (entity, order), and runs that touch the edge of a partition are joined afterwards from at most two rows per partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasm.session import checkpoint

RUN = re.compile(r"([^\0])\1*", re.DOTALL)
PIECE = "entity string, event long, first_index long, last_index long, n long, from_s double, to_s double, part int, edge int"


def symbols(event: np.ndarray, entity_starts: np.ndarray) -> tuple[str, np.ndarray]:
    """The events as one symbol each, with a NUL before every entity's first; and the row of each symbol (-1 for a NUL)."""
    _, code = np.unique(event, return_inverse=True)
    code = code.astype(np.uint32) + 1
    code[code >= 0xD800] += 0x800  # no surrogates
    rows = np.insert(np.arange(len(event)), entity_starts, -1)
    out = np.insert(code, entity_starts, 0).astype("<u4")
    return out.tobytes().decode("utf-32-le"), rows


def _pieces(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Runs of one partition. edge: 1 touches the partition's start, 2 its end, 3 both, 0 neither; only edges may be under least."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    schema = pa.schema([("entity", pa.string()), ("event", pa.int64()), ("first_index", pa.int64()), ("last_index", pa.int64()), ("n", pa.int64()), ("from_s", pa.float64()), ("to_s", pa.float64()), ("part", pa.int32()), ("edge", pa.int32())])

    def build(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    opened: list | None = None  # the run that may go on in the next batch
    first = True
    for b in batches:
        if not b.num_rows:
            continue
        entity, event = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
        ent = pc.fill_null(entity, "")
        null = entity.is_null().to_numpy(zero_copy_only=False)
        differs = pc.not_equal(ent[1:], ent[:-1]).to_numpy(zero_copy_only=False) | (null[1:] != null[:-1]) if b.num_rows > 1 else np.zeros(0, bool)
        text, rows = symbols(event, np.flatnonzero(np.r_[True, differs]))
        index = b.column(2).to_pylist()
        start, end = b.column(3).to_pylist(), b.column(4).to_pylist()
        out = []
        for m in RUN.finditer(text):
            i, j = int(rows[m.start()]), int(rows[m.end() - 1])
            new = [entity[i].as_py() if i == 0 or j == b.num_rows - 1 or j - i + 1 >= least else None, int(event[i]), index[i], index[j], j - i + 1, start[i], end[j], part, 0]
            if opened is not None and i == 0:
                if opened[0] == new[0] and opened[1] == new[1]:
                    opened[3], opened[4], opened[6] = new[3], opened[4] + new[4], new[6]
                    new = opened
                elif opened[4] >= least or opened[8]:
                    out.append(opened)
                opened = None
            elif i == 0 and first:
                new[8] = 1
            if j == b.num_rows - 1:
                opened = new
            elif new[4] >= least or new[8]:
                out.append(new)
        first = False
        yield build(out)
    if opened is not None:
        opened[8] |= 2
        yield build([opened])


def collapse_runs(df: DataFrame, entity: str, index: str, event: str | Column, start: str, end: str, arrived: str, least: int = 1) -> DataFrame:
    """Runs of `least` or more successive equal events: `entity, event, first_index, last_index, n, from_s, to_s, seconds`.

    Each (entity, index) counts once, by its earliest `arrived` row; rows with a null event are left out; the order is start,
    then index (a null start comes first). A null entity is an entity of its own. Ties of start are broken by index. An empty
    table gives no rows; other columns are ignored. `event` is an integer column or expression: pass a canonical form (a bucket,
    a rank) to treat near-identical events alike.
    """
    c = F.col
    value = c(event) if isinstance(event, str) else event
    rows = df.select(c(entity).alias("entity"), value.cast("long").alias("event"), c(index).cast("long").alias("ix"), c(start).cast("double").alias("s"), c(end).cast("double").alias("e"), c(arrived).alias("a"))
    once = rows.groupBy("entity", "ix").agg(F.min(F.struct("a", "event", "s", "e")).alias("r"))
    once = once.where("r.event is not null").select("entity", "r.event", "ix", "r.s", "r.e")
    spread = once.repartitionByRange(c("entity"), c("s"), c("ix")).sortWithinPartitions("entity", "s", "ix")
    # written once: both uses below must see the same partitions
    pieces = checkpoint(spread.mapInArrow(lambda it: _pieces(it, least), PIECE))
    edges = pieces.where("edge > 0")
    # at most two rows a partition: one window without a key is bounded by the number of partitions
    w = Window.orderBy("part", F.col("edge") == 2)
    same = F.lag("entity").over(w).eqNullSafe(c("entity")) & (F.lag("event").over(w) == c("event")) & (F.lag("edge").over(w) >= 2) & c("edge").isin(1, 3)
    joined = edges.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("pos", F.struct("part", F.col("edge") == 2)).withColumn("g", F.sum("new").over(w))
    joined = joined.groupBy("g").agg(F.min_by("entity", "pos").alias("entity"), F.min_by("event", "pos").alias("event"), F.min_by("first_index", "pos").alias("first_index"), F.max_by("last_index", "pos").alias("last_index"), F.sum("n").alias("n"), F.min_by("from_s", "pos").alias("from_s"), F.max_by("to_s", "pos").alias("to_s"))
    runs = pieces.where("edge = 0").drop("part", "edge").unionByName(joined.drop("g"))
    return runs.where(c("n") >= least).withColumn("seconds", c("to_s") - c("from_s"))
