"""Session windows over audio and events: hopping windows, silence gaps, folding of short groups, rolling buffers, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hopping(length: Column, size: int, step: int, least_tail: int) -> Column:
    """Windows (start, end) of `size` samples every `step` from 0; the last, shorter one if it has `least_tail` samples or more."""
    starts = F.when(length > 0, F.sequence(F.lit(0).cast("long"), length - 1, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    each = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, length).alias("end")))
    ended = F.filter(each, lambda w, i: (i == 0) | (F.get(each, i - 1)["end"] < length))
    return F.filter(ended, lambda w: (w["end"] - w["start"] == size) | (w["end"] - w["start"] >= least_tail))


def silences(df: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """`key, session_start, session_end, n`: events less than `gap` apart (session windows; end includes the gap)."""
    s = df.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def fold_blips(df: DataFrame, key: str, start: str, end: str, least: float) -> DataFrame:
    """`key, from_s, to_s`: intervals in order, where one shorter than `least` takes in the next until the sum is long enough.

    For intervals of a bounded entity (one session's chunks): they are folded as one array."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e"))))
    empty = F.array().cast("array<struct<s:double,e:double>>")
    begin = F.struct(empty.alias("out"), F.lit(None).cast("double").alias("s"), F.lit(None).cast("double").alias("e"))

    def step(a: Column, x: Column) -> Column:
        s = F.coalesce(a["s"], x["s"].cast("double"))
        e = F.greatest(F.coalesce(a["e"], x["e"].cast("double")), x["e"].cast("double"))
        closed = e - s >= least
        out = F.when(closed, F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"))))).otherwise(a["out"])
        return F.struct(out.alias("out"), F.when(closed, None).otherwise(s).alias("s"), F.when(closed, None).otherwise(e).alias("e"))

    def finish(a: Column) -> Column:
        return F.when(a["s"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e")))))

    return df.groupBy(key).agg(rows.alias("r")).select(key, F.inline(F.aggregate("r", begin, step, finish)).alias("from_s", "to_s"))


def rolling(df: DataFrame, key: str, order: list[str], text: str, n: int = 8) -> DataFrame:
    """Each row with the last n texts up to it, joined by two spaces."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - n, 0)
    return df.withColumn("buffer", F.array_join(F.collect_list(text).over(w), "  "))


def rms(x: Column) -> Column:
    """Root mean square of an array; 0.0 of an empty one."""
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return F.when(F.size(x) == 0, F.lit(0.0)).otherwise(F.sqrt(total / F.size(x)))


def peak(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, F.abs)), F.lit(0.0))


def pad(x: Column, n: int) -> Column:
    """x cut or filled with zeros to n values."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0).cast("float"), n)), 1, n)


def quietest(x: Column, width: int, low: int, high: int) -> Column:
    """Start (from 0), within low..high, of the window of `width` values with the least energy, the first of equals."""
    energy = lambda i: F.round(F.aggregate(F.slice(x, i + 1, width), F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")), 9)
    return F.array_min(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda i: F.struct(energy(i).alias("e"), i.alias("i"))))["i"]


def gate(duration: Column, level: Column) -> Column:
    """skipped under 1.5 s or an RMS of 0.005, else decode."""
    return F.when((duration < 1.5) | (level < 0.005), "skipped").otherwise("decode")


def segment_range(segments: Column, first: Column, last: Column) -> Column:
    """(start_ms, end_ms) over the segments [word, .., start, end] whose word, counted from 0 or 1, lies in first..last."""
    own = F.filter(segments, lambda s: s[0].between(first, last + 1))
    return F.when(F.size(own) > 0, F.struct(F.array_min(F.transform(own, lambda s: F.element_at(s, -2))).alias("start_ms"), F.array_max(F.transform(own, lambda s: F.element_at(s, -1))).alias("end_ms")))


def frames(x: Column, n: int = 200, width: int = 26) -> Column:
    """Feature rows (arrays of `width`) cut or filled with rows of zeros to n."""
    zero = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), width), n)
    return F.slice(F.concat(F.coalesce(x, F.array().cast("array<array<float>>")), zero), 1, n)


def rule_result(p: Column, least: float = 0.5) -> Column:
    """(followed, confidence in percent) of a rule model's probability."""
    return F.struct((p >= least).alias("followed"), (p * 100).alias("confidence"))
