"""What a session is in the state of after each chunk: folds over its chunks in order, by the kernels the streams use too.

Chunks are sorted within hash partitions and folded as a stream of batches: a task holds one session's state, not its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasm import kernels as k


def fold(df: DataFrame, key: str, order: list[str], new: Callable[[], object], step: Callable[[object, dict], dict], schema: str, columns: list[str]) -> DataFrame:
    """key, order and what step gives for each row; `new` makes the state of a session."""
    kinds = dict(df.dtypes)
    head = [key, *order]
    cols = [*head, *[x for x in columns if x not in head]]
    out = ", ".join(f"`{n}` {kinds[n]}" for n in head) + ", " + schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r[key] != current:
                    current, state = r[key], new()
                rows.append({**{n: r[n] for n in head}, **step(state, r)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(out))
    return df.select(*cols).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, out)


def locks(df: DataFrame, key: str = "session_id", order: str = "chunk_index") -> DataFrame:
    """state, locked: the chapter lock after each chunk, from `surah, score, margin` of its best candidate."""

    def step(s: k.Lock, r: dict) -> dict:
        state, locked = s.update(r["surah"], r["score"], r["margin"])
        return {"state": state, "locked": locked}

    return fold(df, key, [order], k.Lock, step, "state string, locked int", ["surah", "score", "margin"])


def voting_locks(df: DataFrame, key: str = "session_id", order: str = "chunk_index") -> DataFrame:
    """As locks, with the votes of sure matches: `matched, ayah, confidence, heard` (texts heard so far)."""

    def step(s: k.VotingLock, r: dict) -> dict:
        state, locked = s.update(r["surah"], r["score"], r["margin"], r["matched"], r["ayah"], r["confidence"], r["heard"] or 0)
        return {"state": state, "locked": locked}

    return fold(df, key, [order], k.VotingLock, step, "state string, locked int", ["surah", "score", "margin", "matched", "ayah", "confidence", "heard"])


def chunks(df: DataFrame, key: str = "session_id", order: str = "seq") -> DataFrame:
    """start, end of the chunks that rows (`kind, start, end, total`: speech segments, pauses and the stop) let go."""

    def step(s: k.Chunker, r: dict) -> dict:
        return {"out": [{"start": a, "end": z} for a, z in s.update(r["kind"], r["start"], r["end"], r["total"])]}

    out = fold(df, key, [order], k.Chunker, step, "out array<struct<start: bigint, end: bigint>>", ["kind", "start", "end", "total"])
    return out.select(key, order, F.inline("out"))


def corrections(df: DataFrame, key: str = "session_id", order: str = "chunk_index") -> DataFrame:
    """action, fsm, kind, attempts: from `verdict, confidence, wrong, vowels`; playback is taken to end before the next chunk."""

    def step(s: k.Correction, r: dict) -> dict:
        action = s.update(r["verdict"], r["confidence"], r["wrong"] or [], s.number, r["vowels"] or [], r[order])
        del s.history[:-1]  # the fold keeps the open entry only
        return {"action": action, "fsm": s.state, "kind": s.kind, "attempts": s.attempts}

    return fold(df, key, [order], k.Correction, step, "action string, fsm string, kind string, attempts int", ["verdict", "confidence", "wrong", "vowels"])


def progress(df: DataFrame, key: str = "session_id", order: str = "chunk_index", jump: int = 2) -> DataFrame:
    """pointer: the verse expected after each chunk. Advances past a match of verdict ok or minor, or of CER <= 1.10 and coverage
    >= 0.20, by at most `jump` unless the confidence is 0.92 or more."""

    class Pointer:
        at = 1

    def step(s: Pointer, r: dict) -> dict:
        good = r["verdict"] in ("ok", "minor") or (r["cer"] is not None and r["coverage"] is not None and r["cer"] <= 1.10 and r["coverage"] >= 0.20)
        if r["matched_ayah"] is not None and good:
            to = max(s.at, r["matched_ayah"] + 1)
            s.at = min(to, s.at + jump) if (r["confidence"] or 0.0) < 0.92 else to
        return {"pointer": s.at}

    return fold(df, key, [order], Pointer, step, "pointer int", ["matched_ayah", "verdict", "cer", "coverage", "confidence"])


def transcripts(df: DataFrame, key: str = "session_id", order: str = "chunk_index", text: str = "text", norm: str = "norm") -> DataFrame:
    """kept: each chunk's words without those that repeat the end of the chunk before (the whole chunk, not what was kept of it)."""

    class Last:
        norm: list[str] = []

    def step(s: Last, r: dict) -> dict:
        words, own = (r[text] or "").split(), (r[norm] or "").split()
        if not words:
            return {"kept": ""}
        cut = k.overlap(s.norm, own)
        s.norm = own
        return {"kept": " ".join(words[cut:])}

    return fold(df, key, [order], Last, step, "kept string", [text, norm])


def fragments(df: DataFrame, key: str = "session_id", order: str = "chunk_index", text: str = "text", ref: str = "ref") -> DataFrame:
    """carried, fragment: each text with the fragment before it in front, without a last word that only begins a reference word."""

    class Rest:
        text = ""

    def step(s: Rest, r: dict) -> dict:
        words = f"{s.text} {r[text] or ''}".split()
        known = r[ref] or []
        s.text = ""
        if words and words[-1] not in known and any(x.startswith(words[-1]) and len(x) > len(words[-1]) for x in known):
            s.text = words.pop()
        return {"carried": " ".join(words), "fragment": s.text}

    return fold(df, key, [order], Rest, step, "carried string, fragment string", [text, ref])


def word_statuses(df: DataFrame, key: list[str], at: str, status: str, seq: str) -> DataFrame:
    """key, at, status: the sticky status of each word (correct once seen stays, else the latest), as an aggregate."""
    c = F.col
    ok = F.max(c(status) == "correct")
    last = F.max_by(status, seq)
    return df.where(c(status).isNotNull()).groupBy(*key, at).agg(F.when(ok, "correct").otherwise(last).alias("status"))


def healed(df: DataFrame, key: str, order: str, said: str, ref: str, voweled: str) -> DataFrame:
    """`key, statuses`: the words of each verse after all that was said of it (arrays of words), by kernels.heard_statuses; `key` names a
    session's verse."""

    class Words:
        of: list | None = None

    def step(s: Words, r: dict) -> dict:
        s.of = k.heard_statuses(r[said] or [], r[ref] or [], s.of if s.of is not None else [None] * len(r[ref] or []), set(r[voweled] or []))
        return {"statuses": s.of}

    each = fold(df, key, [order], Words, step, "statuses array<string>", [said, ref, voweled])
    return each.groupBy(key).agg(F.max_by("statuses", order).alias("statuses"))


def progressed(df: DataFrame, key: str = "session_id", order: str = "chunk_index", share: float = 0.60) -> DataFrame:
    """`key, matched_ayah, cer, wer, confidence, low_share, verdict` of whole sessions: the verse before the pointer, and means. Where `share`
    of the chunks are of low confidence the pointer is not trusted: no verse, no means, and the text goes by the rules alone."""
    c = F.col
    last = progress(df, key, order).groupBy(key).agg(F.max_by("pointer", order).alias("pointer"))
    sums = df.groupBy(key).agg(F.avg("cer").alias("cer"), F.avg("wer").alias("wer"), F.avg("confidence").alias("confidence"), F.avg(F.when(c("confidence_level") == "low", 1.0).otherwise(0.0)).alias("low_share"))
    weak = c("low_share") >= share
    means = [F.when(~weak, F.round(x, 8)).alias(x) for x in ("cer", "wer", "confidence")]
    return sums.join(last, key).select(key, F.when(~weak, c("pointer") - 1).alias("matched_ayah"), *means, F.round("low_share", 6).alias("low_share"), F.when(weak, "fallback_fullpass_rule_only").otherwise("progressive").alias("verdict"))


def without_stale(pending: DataFrame, gone: DataFrame, key: str, index: str, at: str, within: float) -> DataFrame:
    """`pending` without the rows that start less than `within` from another row of `gone` of the same session: met in buckets of time."""
    c = F.col
    bucket = F.floor(c(at) / within)
    near = gone.select(c(key).alias("gone_key"), c(index).alias("gone_index"), c(at).alias("gone_at"), F.explode(F.sequence(bucket - 1, bucket + 1)).alias("gone_bucket"))
    same = (c(key) == c("gone_key")) & (bucket == c("gone_bucket")) & (c(index) != c("gone_index")) & (F.abs(c(at) - c("gone_at")) < within)
    return pending.join(near, same, "left_anti")
