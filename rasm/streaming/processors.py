"""Structured Streaming forms: stateful processors over the kernels of the batch folds, and windowed aggregates with watermarks.

Every kernel has its state as a typed row (`TYPED`), held in RocksDB by a StatefulProcessor; a key that hears nothing for `idle_ms` is
dropped by a timer. Rows of a micro-batch are taken in their order, so a stream gives what the batch fold gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rasm import kernels as k

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Delta:
    """Whether a source sends all its samples so far or only the new ones: settled by the second fragment being over 1.5 x the first."""

    def __init__(self) -> None:
        self.calls, self.first, self.seen, self.all = 0, 0, 0, False

    def update(self, n: int) -> tuple[int, int]:
        """(start, end) within the fragment of the samples that are new."""
        self.calls += 1
        if self.calls == 1:
            self.first = self.seen = n
            return 0, n
        if self.calls == 2:
            self.all = n > 1.5 * self.first
        start = min(self.seen, n) if self.all else 0
        self.seen = max(self.seen, n) if self.all else self.seen + n
        return start, n


class Last:
    """The last value that went out."""

    value: str | None = None


class Statuses:
    """The sticky statuses of words."""

    def __init__(self) -> None:
        self.of: dict[int, str | None] = {}


def _lock(cls: type) -> tuple:
    def load(r: tuple) -> k.Lock:
        s = cls()
        s.history, s.locked, s.missed = [(int(a), float(b), float(c)) for a, b, c in (r[0] or [])], None if r[1] is None else int(r[1]), int(r[2])
        return s

    return "history array<struct<surah: int, score: double, margin: double>>, locked int, missed int", lambda s: (list(s.history), s.locked, s.missed), load


def _fields(cls: type, ddl: str, *names: str) -> tuple:
    def load(r: tuple) -> Any:
        s = cls()
        for n, v in zip(names, r):
            setattr(s, n, [tuple(x) if isinstance(x, (tuple, list)) else x for x in v] if isinstance(v, (list, tuple)) else v)
        return s

    return ddl, lambda s: tuple(getattr(s, n) for n in names), load


def _statuses(r: tuple) -> Statuses:
    s = Statuses()
    s.of = {int(a): b for a, b in (r[0] or [])}
    return s


def _correction(r: tuple) -> k.Correction:
    s = k.Correction()
    s.state, s.kind, s.attempts, s.words, s.number = r[0], r[1], int(r[2]), list(r[3] or []), int(r[4])
    if s.state != "LISTENING":
        s.history = [{"kind": s.kind, "attempts": s.attempts, "resolved": False}]
    return s


#: kernel -> (type of the state, state to row, row to state)
TYPED: dict[type, tuple[str, Callable[[Any], tuple], Callable[[tuple], Any]]] = {
    k.Lock: _lock(k.Lock),
    k.VotingLock: _lock(k.VotingLock),
    k.Correction: ("state string, kind string, attempts int, words array<string>, number int", lambda s: (s.state, s.kind, s.attempts, list(s.words), s.number), _correction),
    k.Chunker: _fields(k.Chunker, "committed long, segments array<struct<a: long, z: long>>", "committed", "segments"),
    k.Pairing: _fields(k.Pairing, "next int, waiting array<struct<i: int, a: double, z: double>>", "next", "waiting"),
    Delta: _fields(Delta, "calls int, first long, seen long, whole boolean", "calls", "first", "seen", "all"),
    Last: _fields(Last, "value string", "value"),
    Statuses: ("words array<struct<w: int, status: string>>", lambda s: (list(s.of.items()),), _statuses),
}


class Fold(StatefulProcessor):
    """step(state, row) over the rows of a key; it gives a dict, a list of them, or None."""

    def __init__(self, key: str, order: str, new: type, step: Callable[[Any, dict], Any], names: list[str], idle_ms: int | None):
        self.key, self.order, self.new, self.step, self.names, self.idle_ms = key, order, new, step, names, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", TYPED[self.new][0])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        _, dump, load = TYPED[self.new]
        s = load(tuple(self.state.get())) if self.state.exists() else self.new()
        each = [r for f in rows for r in f.to_dict("records")]
        done = []
        for r in sorted(each, key=lambda r: r[self.order]):
            got = self.step(s, {n: None if isinstance(v, float) and v != v or v is pd.NA or v is pd.NaT else v for n, v in r.items()})
            for x in got if isinstance(got, list) else [got] if got is not None else []:
                done.append({self.key: key[0], self.order: r[self.order], **x})
        self.state.update(dump(s))
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(done, columns=self.names)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=self.names)

    def close(self) -> None:
        pass


def stateful(df: DataFrame, key: str, order: str, new: type, step: Callable[[Any, dict], Any], out: str, idle_ms: int | None = None) -> DataFrame:
    """What step gives for the rows of each key, in `order` within a micro-batch, with the typed state of `new` kept between them."""
    from pyspark.sql.types import StructType

    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = StructType.fromDDL(out)
    return df.groupBy(key).transformWithStateInPandas(Fold(key, order, new, step, schema.names, idle_ms), schema, "append", "ProcessingTime" if idle_ms else "None")


def _int(x: Any) -> int | None:
    return None if x is None else int(x)


def lock_stream(df: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """session_id, chunk_index, state, locked from a stream of (session_id, chunk_index, surah, score, margin)."""

    def step(s: k.Lock, r: dict) -> dict:
        state, locked = s.update(_int(r["surah"]), r["score"], r["margin"])
        return {"state": state, "locked": locked}

    return stateful(df, "session_id", "chunk_index", k.Lock, step, "session_id string, chunk_index int, state string, locked int", idle_ms)


def voting_lock_stream(df: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """As lock_stream, with the votes of sure matches: (.., matched, ayah, confidence, heard)."""

    def step(s: k.VotingLock, r: dict) -> dict:
        state, locked = s.update(_int(r["surah"]), r["score"], r["margin"], _int(r["matched"]), _int(r["ayah"]), r["confidence"], _int(r["heard"]) or 0)
        return {"state": state, "locked": locked}

    return stateful(df, "session_id", "chunk_index", k.VotingLock, step, "session_id string, chunk_index int, state string, locked int", idle_ms)


def correction_stream(df: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """session_id, chunk_index, action, fsm, kind, attempts from (session_id, chunk_index, verdict, confidence, wrong, vowels, played); `played` is
    the number of the correction whose playback has ended since, -1 for the one that is open."""
    many = lambda v: [] if v is None else list(v)

    def step(s: k.Correction, r: dict) -> dict:
        played = _int(r["played"])
        action = s.update(r["verdict"], r["confidence"], many(r["wrong"]), s.number if played == -1 else played, many(r["vowels"]))
        return {"action": action, "fsm": s.state, "kind": s.kind, "attempts": s.attempts}

    return stateful(df, "session_id", "chunk_index", k.Correction, step, "session_id string, chunk_index int, action string, fsm string, kind string, attempts int", idle_ms)


def chunk_stream(df: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """session_id, seq, start, end of chunks from (session_id, seq, kind, start, end, total): speech segments, pauses and the stop."""

    def step(s: k.Chunker, r: dict) -> list[dict]:
        return [{"start": a, "end": z} for a, z in s.update(r["kind"], _int(r["start"]), _int(r["end"]), int(r["total"]))]

    return stateful(df, "session_id", "seq", k.Chunker, step, "session_id string, seq long, start long, end long", idle_ms)


def paired_stream(df: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """session_id, seq, chunk_index, start, end of each result from (session_id, seq, kind, start, end): pending, discard, result."""

    def step(s: k.Pairing, r: dict) -> dict | None:
        got = s.update(r["kind"], r["start"], r["end"])
        return None if got is None else dict(zip(("chunk_index", "start", "end"), got))

    return stateful(df, "session_id", "seq", k.Pairing, step, "session_id string, seq long, chunk_index int, start double, end double", idle_ms)


def changes(df: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """session_id, seq, value of the rows whose value differs from the one that went out last."""

    def step(s: Last, r: dict) -> dict | None:
        if r["value"] == s.value:
            return None
        s.value = r["value"]
        return {"value": r["value"]}

    return stateful(df, "session_id", "seq", Last, step, "session_id string, seq long, value string", idle_ms)


def delta_stream(df: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """session_id, seq, new_from, new_to from (session_id, seq, samples): the new part of each fragment."""

    def step(s: Delta, r: dict) -> dict:
        a, z = s.update(int(r["samples"]))
        return {"new_from": a, "new_to": z}

    return stateful(df, "session_id", "seq", Delta, step, "session_id string, seq long, new_from int, new_to int", idle_ms)


def status_stream(df: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """session_id, seq, word, status from (session_id, seq, word, status): statuses that stay once correct."""

    def step(s: Statuses, r: dict) -> dict:
        w = int(r["word"])
        s.of[w] = k.sticky(s.of.get(w), r["status"])
        return {"word": w, "status": s.of[w]}

    return stateful(df, "session_id", "seq", Statuses, step, "session_id string, seq long, word int, status string", idle_ms)


def windowed(df: DataFrame, ts: str, size: str, late: str, slide: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts per (sliding) window of event time; rows later than `late` are dropped and finished windows leave the state."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(df: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    return df.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deliveries(df: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Each key's first delivery; the keys are kept for `late` only."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


# What a session start has where it does not say.
DEFAULTS = {"start_ayah": 1, "use_vad": True, "correction_mode": "balanced", "qari_mode": False, "asr_engine": "standard"}


def starts(df: DataFrame, ts: str, late: str) -> DataFrame:
    """Session starts, each session's first, with defaults for what is missing. Any number of sessions are active at once."""
    own = [F.coalesce(x, F.lit(DEFAULTS[x])).alias(x) if x in DEFAULTS else F.col(x) for x in df.columns]
    return deliveries(df.select(*own), ["session_id"], ts, late)


def run(df: DataFrame, sink: str, path: str, checkpoint: str, every: str | None = "150 milliseconds") -> Any:
    """A query that looks for new rows `every` so often, or once over all there are (None)."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return df.writeStream.format(sink).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()


def health(spark: SparkSession) -> list[dict]:
    """Name, whether it is active, its message and error, and the rows a second of each streaming query."""
    out = []
    for q in spark.streams.active:
        last = q.lastProgress
        error = q.exception()
        out.append({"name": q.name, "active": q.isActive, "message": q.status["message"], "error": None if error is None else str(error), "rows_per_second": None if last is None else last["processedRowsPerSecond"]})
    return out
