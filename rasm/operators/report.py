"""Reports of evaluations and sessions as tables, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasm.operators import evaluate
from rasm.session import broadcast_if_small


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def display_stats(df: DataFrame, key: str, words: str) -> DataFrame:
    """`key, total_words, correct, minor, major, uncertain, accuracy` of arrays of word annotations; accuracy in percent, 0 of no words."""
    c = F.col
    w = F.coalesce(c(words), F.array())
    n = lambda s: F.sum(F.size(F.filter(w, lambda x: x["status"] == s))).alias(s)
    sums = df.groupBy(key).agg(F.sum(F.size(w)).alias("total_words"), *map(n, ("correct", "minor", "major", "uncertain")))
    return sums.withColumn("accuracy", F.round(ratio(c("correct") * 100.0, c("total_words")), 4))


def class_report(cells: DataFrame) -> DataFrame:
    """`label, tp, support, precision, recall, f1, accuracy, macro_f1` of a confusion table, whose labels are few; 0 where undefined."""
    c = F.col
    each = evaluate.label_metrics(cells)
    total = cells.agg(F.sum("n").alias("all"), F.sum(F.when(c("true_label") == c("pred_label"), c("n")).otherwise(0)).alias("right"))
    out = each.crossJoin(F.broadcast(total)).withColumn("macro_f1", F.avg("f1").over(Window.partitionBy("all")))  # one row
    return out.select("label", "tp", (c("tp") + c("fn")).alias("support"), *[F.round(x, 8).alias(x) for x in ("precision", "recall", "f1")], F.round(ratio(c("right"), c("all")), 8).alias("accuracy"), F.round("macro_f1", 8).alias("macro_f1"))


def rule_report(df: DataFrame, rule: str, true: str, pred: str) -> DataFrame:
    """`rule, n, tp, fp, fn, tn, accuracy, precision, recall, f1` of yes and no for each rule, and of all together (pooled)."""
    c = F.col
    n = lambda x, name: F.count_if(x).alias(name)
    t, p = c(true), c(pred)
    k = df.rollup(rule).agg(F.count("*").alias("n"), n(t & p, "tp"), n(~t & p, "fp"), n(t & ~p, "fn"), n(~t & ~p, "tn"))
    k = k.withColumns({"p": ratio(c("tp"), c("tp") + c("fp")), "q": ratio(c("tp"), c("tp") + c("fn"))})
    f1 = ratio(2 * c("p") * c("q"), c("p") + c("q"))
    return k.select(F.coalesce(c(rule), F.lit("pooled")).alias("rule"), "n", "tp", "fp", "fn", "tn", *[F.round(x, 4).alias(m) for x, m in ((ratio(c("tp") + c("tn"), c("n")), "accuracy"), (c("p"), "precision"), (c("q"), "recall"), (f1, "f1"))])


def eval_report(evals: DataFrame, worst: int = 20) -> DataFrame:
    """`section, name, line` of a whole evaluation: totals, verdicts, chapters, and the worst rows with their rank."""
    c = F.col

    def rate(x: Column) -> Column:  # four places, halves up
        n = F.round(x * 10_000).cast("long")
        return F.concat(F.floor(n / 10_000), F.lit("."), F.lpad((n % 10_000).cast("string"), 4, "0"))

    row = lambda section, name, *line: [F.lit(section).alias("section"), F.coalesce(name.cast("string"), F.lit("-")).alias("name"), F.concat_ws(" ", *line).alias("line")]
    total = evals.agg(F.count("*").alias("n"), F.avg("corrected_wer").alias("w"), F.avg("corrected_cer").alias("e")).select(*row("total", F.lit("all"), c("n"), rate(c("w")), rate(c("e"))))
    verdicts = evals.groupBy("verdict").agg(F.count("*").alias("n")).select(*row("verdict", c("verdict"), c("n")))
    chapters = evals.groupBy("surah").agg(F.count("*").alias("n"), F.avg("corrected_wer").alias("w")).select(*row("surah", c("surah"), c("n"), rate(c("w"))))
    last = evaluate.worst(evals, "corrected_wer", worst, ["eval_id"]).withColumn("i", F.row_number().over(Window.orderBy(F.desc("corrected_wer"), "eval_id")))  # of `worst` rows
    return total.unionByName(verdicts).unionByName(chapters).unionByName(last.select(*row("worst", c("i"), c("eval_id"), rate(c("corrected_wer")))))


def stem(path: Column) -> Column:
    """A file's name without folder and extension; '' of what has none."""
    return F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1)


def with_audio(labels: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Labels joined with the audio files of the same stem."""
    return files.join(broadcast_if_small(labels), key)


def write_report(lines: DataFrame, path: str) -> None:
    """As JSON, as CSV, and as one sorted text file: a report is small by its nature."""
    lines.write.mode("overwrite").json(f"{path}/json")
    lines.write.mode("overwrite").csv(f"{path}/csv", header=True)
    lines.orderBy(*lines.columns).select(F.concat_ws("\t", *[F.col(x).cast("string") for x in lines.columns]).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/text")
