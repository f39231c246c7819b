"""From recognized chunks to verdicts, and from whole sessions to verses: the operators in one plan.

Between the stateless parts stand two folds: the lock, which the guard's matches vote in, and the correction. A chunk is matched with
the verse after the one that its session had reached before (the session's start where there is none)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasm.functions import columns as col
from rasm.functions import text as tx
from rasm.operators import align, corpus, guard, retrieve, sessions, windows
from rasm.session import broadcast_if_small, spread, written

#: How far matching looks while a correction is open, and else: (back, ahead, verses of a run).
STRICT, WIDE = (0, 0, 1), (5, 10, 8)


def combined(first: Column, second: Column) -> tuple[Column, Column]:
    """(first, second) of two recognizers without repeats of the whole text; the first is the second's where it heard nothing."""
    once = lambda t: F.array_join(tx.tile(tx.tokens(tx.display(t))), " ")
    a, b = once(first), once(second)
    return F.when(a == "", b).otherwise(a), b


def word_scores(df: DataFrame, text: str, ref: str) -> DataFrame:
    """df with `words` (annotations against the verse without what is still to come), `shown` (minor slips put right), `teach` (phrases to
    be taught) and `word_verdict`: error with any word worse than minor, minor, ok, or null of no words. A null verse has no words."""
    c = F.col
    t = tx.tokens(tx.fix_rules(c(text)))
    hyp = F.array_join(tx.drop_partial_tail(t, tx.tokens(c(ref))), " ")
    first = written(df.withColumn("_hyp", hyp).withColumn("_words", align.annotations(c("_hyp"), c(ref), F.lit(None))))  # used many times
    out = spread(first).withColumn("words", align.spoken(c("_words"))).drop("_words")
    some = lambda p: F.exists("words", p)
    verdict = F.when(some(lambda x: ~x["status"].isin("correct", "minor")), "error").when(some(lambda x: x["status"] == "minor"), "minor").when(F.size("words") > 0, "ok")
    fixed = align.minor_fixes(c("words"))
    shown = F.coalesce(F.nullif(fixed, F.lit("")), c("_hyp"))
    return out.withColumns({"shown": shown, "teach": align.teachable(c("words")), "word_verdict": verdict}).drop("_hyp")


def strict(df: DataFrame, fsm: str, current: str, matched: str, verdict: str) -> DataFrame:
    """While a correction is open a match counts only for the verse that is being corrected: another is put there, as an error."""
    c = F.col
    open_ = c(fsm).isin("CORRECTING", "VERIFYING") & c(current).isNotNull() & ~c(matched).eqNullSafe(c(current))
    return df.withColumns({matched: F.when(open_, c(current)).otherwise(c(matched)), verdict: F.when(open_, "error").otherwise(c(verdict))})


def bounds(fsm: Column) -> Column:
    """(back, ahead, most) of the match that a chunk gets in this state."""
    as_struct = lambda b: F.struct(*[F.lit(x).alias(n) for x, n in zip(b, ("back", "ahead", "most"))])
    return F.when(fsm.isin("CORRECTING", "VERIFYING"), as_struct(STRICT)).otherwise(as_struct(WIDE))


def chunks(df: DataFrame, starts: DataFrame, verses: DataFrame) -> DataFrame:
    """`session_id, chunk_index, verdict, surah, ayah, corrected, teach, state, locked, action, fsm` of chunks (session_id, chunk_index, seconds,
    level, raw, second, reached), with their sessions' `starts` (session_id, surah, start_ayah).

    Too short or faint ones, and those that are invocations only, are skipped: they have no verse and change neither fold."""
    c = F.col
    keys = ["session_id", "chunk_index"]
    ref = corpus.reference(verses)
    one, two = combined(c("raw"), c("second"))
    rows = spread(df.join(starts.select("session_id", c("surah").alias("given"), "start_ayah"), "session_id", "left"), *keys)
    rows = rows.withColumns({"text": F.coalesce(one, F.lit("")), "other": two}).withColumn("analysed", guard.strip_invocations(c("text"), "words"))
    quiet = windows.gate(c("seconds"), c("level")) == "skipped"
    rows = rows.withColumn("skipped", F.coalesce(quiet, F.lit(False)) | col.only_invocations(c("text"), c("analysed")))
    at = F.lag("reached").over(Window.partitionBy("session_id").orderBy("chunk_index"))
    rows = written(rows.withColumn("due", F.coalesce(at, c("start_ayah"), F.lit(1))))
    heard = rows.where("not skipped")
    hyp = heard.select(*keys, c("given").alias("surah"), c("due").alias("expected"), c("analysed").alias("raw"))
    back, ahead, most = WIDE
    g = guard.guard(hyp, ref, corpus.spans(ref, most), keys, auto=True, back=back, ahead=ahead)
    g = g.select(*keys, "surah", c("first_ayah").alias("matched"), "confidence", "verdict", "corrected").join(heard.select(*keys, "due", "analysed", "given"), keys)
    g = guard.forced(g, ref).withColumn("verdict", F.when(c("wrong"), "error").otherwise(c("verdict"))).drop("text")
    text = ref.select(c("surah").alias("s"), c("ayah").alias("a"), c("norm_text").alias("verse"))
    g = g.join(broadcast_if_small(text), (c("surah") == c("s")) & (c("matched") == c("a")), "left").drop("s", "a")
    g = written(word_scores(spread(g, *keys), "analysed", "verse"))
    g = g.withColumn("verdict", F.when(c("wrong"), "error").otherwise(F.coalesce("word_verdict", "verdict")))
    n = F.count("*").over(Window.partitionBy("session_id").orderBy("chunk_index").rowsBetween(-7, 0))
    votes = g.select(*keys, c("surah").alias("matched"), c("matched").alias("ayah"), "confidence", n.alias("heard"), *[F.lit(None).cast(t).alias(x) for x, t in (("surah", "int"), ("score", "double"), ("margin", "double"))])
    locks = sessions.voting_locks(votes)
    wrong = g.select(*keys, "verdict", "confidence", F.transform("teach", lambda x: x["text"]).alias("wrong"), F.array().cast("array<string>").alias("vowels"))
    fsm = sessions.corrections(wrong).select(*keys, "action", "fsm")
    done = g.select(*keys, "verdict", "surah", c("matched").alias("ayah"), c("shown").alias("corrected"), "teach").join(locks, keys).join(fsm, keys)
    none = rows.where("skipped").select(*keys, F.lit("skipped").alias("verdict"))
    return done.unionByName(none, allowMissingColumns=True)


def redecode(n: Column, rate: int = 16_000) -> Column:
    """Windows (start, end) over a session of n samples: one, or above 30 s windows of 25 s that overlap by 2 s."""
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), n.cast("long").alias("end")))
    return F.when(n > 30 * rate, windows.hopping(n.cast("long"), 25 * rate, 23 * rate, 1)).otherwise(whole)


def upload(texts: DataFrame, key: str, ref: DataFrame) -> DataFrame:
    """`key` and verse and verdict of the guard, the first verse of the path search and the best chapter by reranking, of texts
    (key, surah, expected, raw).

    Equal uploads are worked on once, under one of their keys."""
    c = F.col
    same = ["surah", "expected", "raw"]
    first = F.first(key).over(Window.partitionBy(*same).orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    every = spread(texts.select(key, *same), *same).withColumn("_first", first)
    own = c(key) == c("_first")
    every = written(every.select(key, "_first", *[F.when(own, c(x)).alias(x) for x in same]))
    texts = every.where(own).select(key, *same)
    norm = tx.normalize(c("raw"))
    q = texts.select(key, norm.alias("norm"), tx.words(norm).alias("words"))
    g = guard.guard(texts, ref, corpus.spans(ref, WIDE[2]), [key], back=2, ahead=10).select(key, c("surah").alias("guard_surah"), c("first_ayah").alias("guard_ayah"), "verdict")
    begin = retrieve.beginnings(q, key, ref)
    best = retrieve.rerank(q.where("norm <> ''"), key, ref, best=True, once=True).select(key, "surah", "score")
    each = g.join(begin, key, "left").join(best, key, "left").withColumnRenamed(key, "_first")
    out = every.select(key, "_first").join(each, "_first")
    return out.select(key, "guard_surah", "guard_ayah", "verdict", c("global_idx").alias("path_verse"), c("confidence").alias("path_confidence"), "surah", "score")
