"""Evaluation: means, confusion, precision and recall, corpus rates, n-gram counts, word verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasm.functions import text as tx

# The short vowels that a word verdict looks at (fatha, damma, kasra).
SHORT = tx.span("064E-0650")


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.where(F.col(true).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(true).alias("true_label"), F.col(pred).alias("pred_label")).agg(F.count("*").alias("n"))


def label_metrics(cells: DataFrame) -> DataFrame:
    """`label, tp, fp, fn, precision, recall, f1` from a confusion table; 0 where undefined."""
    c = F.col
    hit = F.when(c("true_label") == c("pred_label"), c("n")).otherwise(0)
    by = lambda k: cells.groupBy(c(k).alias("label")).agg(F.sum("n").alias(k[:4]), F.sum(hit).alias("tp" if k == "true_label" else "tp_"))
    both = by("true_label").join(by("pred_label").drop("tp_"), "label", "full")
    both = both.select("label", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("tp", "true", "pred")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    both = both.withColumns({"precision": ratio(c("tp"), c("pred")), "recall": ratio(c("tp"), c("true"))})
    f1 = ratio(2 * c("precision") * c("recall"), c("precision") + c("recall"))
    return both.select("label", "tp", (c("pred") - c("tp")).alias("fp"), (c("true") - c("tp")).alias("fn"), "precision", "recall", f1.alias("f1"))


def ngram_counts(texts: DataFrame, words: Column, most: int) -> DataFrame:
    """`n, gram, cnt, share` of orders 1 to `most`, sentences between <s> and </s>; share of all of its order."""
    padded = F.concat(F.array(F.lit("<s>")), words, F.array(F.lit("</s>")))

    def order(n: int) -> Column:
        at = F.when(F.size("p") >= n, F.sequence(F.lit(1), F.size("p") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("p", i, n), " ").alias("gram")))

    grams = F.flatten(F.array(*[order(n) for n in range(1, most + 1)]))
    counted = texts.select(padded.alias("p")).select(F.inline(grams)).groupBy("n", "gram").agg(F.count("*").alias("cnt"))
    totals = counted.groupBy("n").agg(F.sum("cnt").alias("total"))
    return counted.join(F.broadcast(totals), "n").select("n", "gram", "cnt", (F.col("cnt") / F.col("total")).alias("share"))


def arpa_lines(counts: DataFrame) -> DataFrame:
    """`n, gram, line` of an ARPA file's sections: log10 of the share, gram, back-off 0 below the highest order."""
    most = counts.agg(F.max("n").alias("top"))
    p = F.format_string("%.6f", F.log10("share"))
    tail = F.when(F.col("n") < F.col("top"), F.lit("\t0.000000")).otherwise("")
    return counts.crossJoin(F.broadcast(most)).select("n", "gram", F.concat(p, F.lit("\t"), "gram", tail).alias("line"))


def micro_rates(df: DataFrame, hyp: str, ref: str) -> DataFrame:
    """All edits over all reference words and characters (not the mean of rates)."""
    from rasm.functions import metrics as m

    c = F.col
    h, r = tx.tokens(c(hyp)), tx.tokens(c(ref))
    sums = df.agg(F.sum(m.token_edits(h, r)).alias("word_edits"), F.sum(F.size(r)).alias("words"), F.sum(F.levenshtein(c(hyp), c(ref))).alias("char_edits"), F.sum(F.length(ref)).alias("chars"))
    return sums.select("word_edits", "words", "char_edits", "chars", F.round(c("word_edits") / c("words"), 8).alias("wer"), F.round(c("char_edits") / c("chars"), 8).alias("cer"))


def word_verdict(pred: Column, ref: Column, last: Column) -> tuple[Column, Column]:
    """(word, vowels): the word is correct if the skeletons are equal; its vowels, in the clusters both mark (the last base of
    a last word is left out), are correct, incorrect, or not_applicable if the word is wrong or there is nothing to compare."""
    word = F.when(tx.skeleton(pred) == tx.skeleton(ref), "correct").otherwise("incorrect")
    (pb, pm), (rb, rm) = tx.clusters(pred), tx.clusters(ref)
    n = F.size(rb) - F.when(last, 1).otherwise(0)
    only = lambda x: F.regexp_replace(x, f"[^{SHORT}]", "")
    at = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: (only(F.get(pm, i)) != "") & (only(F.get(rm, i)) != ""))
    vowels = F.when((word != "correct") | (F.size(pb) != F.size(rb)) | (F.size(at) == 0), "not_applicable").when(F.exists(at, lambda i: only(F.get(pm, i)) != only(F.get(rm, i))), "incorrect").otherwise("correct")
    return word, vowels


def worst(df: DataFrame, by: str, k: int, ties: list[str]) -> DataFrame:
    """The k rows with the highest value: takes part sorts, not a sort of all."""
    return df.where(F.col(by).isNotNull() & ~F.isnan(by)).orderBy(F.desc(by), *ties).limit(k)


def vote(df: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """`key, value, n`: the value most rows of a key have, the one seen first of equals."""
    per = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(at).alias("first"))
    return per.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "first", value)).alias("b")).select(key, f"b.{value}", (-F.col("b.m")).alias("n"))


def detected(df: DataFrame, key: str, order: str, surah: Column, state: Column, locked: Column) -> DataFrame:
    """`key, surah`: the chapter that a session locked last, else the one most of its rows have (the first seen of equals)."""
    rows = df.select(key, order, surah.alias("surah"), F.when(state == "ACTIVE", locked).alias("locked"))
    last = rows.where("locked is not null").groupBy(key).agg(F.max_by("locked", order).alias("locked"))
    return vote(rows, key, "surah", order).join(last, key, "full").select(key, F.coalesce("locked", "surah").alias("surah"))


def latest(df: DataFrame, keys: list[str], arrived: str, columns: list[str], first: bool = True) -> DataFrame:
    """One row per key: the earliest (or latest) to arrive."""
    pick = F.min_by if first else F.max_by
    return df.groupBy(*keys).agg(pick(F.struct(*columns), arrived).alias("r")).select(*keys, *[f"r.{c}" for c in columns])


def running_max(value: Column, *keys: str, order: list) -> Column:
    return F.max(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
